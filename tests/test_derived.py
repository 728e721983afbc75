"""Queries whose rows are derived from tables: mixtures, sentences, logs, and their odd cases."""

import pytest
from pyspark.sql import functions as F

from loomline.operators import mixture as M
from loomline.operators import synthesis as Y
from loomline.operators.ordering import hash_bucket
from loomline.plans import derived
from loomline.sources import sinks as S


def test_forms_are_what_drawing_again_gives():
    """Shares equal those of repeated draws of an operator, a category and a template until the template fits."""
    fits = sum(Y.SHARES[k] / len(kind) * (1.0 if i not in Y.ADDS.get(k, ()) else 0.5) for k, kind in Y.TEMPLATES.items() for i in range(len(kind)))
    found = Y.forms()
    assert found[0][0] == 0.0 and found[-1][1] == 1.0 and all(a[1] == b[0] for a, b in zip(found, found[1:], strict=False))
    place = {t: (k, i) for k, kind in Y.TEMPLATES.items() for i, t in enumerate(kind)}
    for lo, hi, op, t in found:
        kind, i = place[t]
        assert op == "+" or i not in Y.ADDS.get(kind, ())
        assert hi - lo == pytest.approx(Y.SHARES[kind] / len(Y.TEMPLATES[kind]) / 2 / fits, abs=3e-9)
    assert len(found) == 2 * 45 - 6


def test_sentences_keep_the_rows(spark):
    rows = spark.createDataFrame([(1, "x"), (1, "y"), (None, "z"), (7, None)], "id long, other string")
    got = Y.sentences(rows, "id", 9, 3).collect()
    texts = [r["text"] for r in got if r["id"] == 1]
    assert len(got) == 4 and len(texts) == 2 and texts[0] == texts[1]
    assert Y.sentences(rows.limit(0), "id", 9, 3).count() == 0


def test_rows_are_picked_alike_in_any_number_of_buckets(spark, monkeypatch):
    """A hot source of nearly all rows: no draw is lost, and the picks don't depend on the buckets."""
    rows = spark.range(3000).select(F.col("id").alias("doc"), F.when(F.col("id") < 2990, "hot").otherwise("rare").alias("source"))
    draws = spark.range(500).select(F.col("id").alias("draw"), F.when(F.col("id") % 5 == 0, "rare").otherwise("hot").alias("source"))
    few = {(r["draw"], r["doc"]) for r in M.pick_rows(draws, rows, "source", "doc", 4).collect()}
    monkeypatch.setattr(M, "hash_bucket", lambda df, column: hash_bucket(df, column, 2))
    many = {(r["draw"], r["doc"]) for r in M.pick_rows(draws, rows, "source", "doc", 4).collect()}
    assert few == many and len(few) == 500 and all((doc >= 2990) == (draw % 5 == 0) for draw, doc in few)


def test_literals_of_a_log(spark):
    lines = spark.createDataFrame([(3, "cfg: {'a': 2}"), (1, None), (2, "cfg: x cfg: {'a': 1, 'b': [2]} "), (0, "begin")], "i long, line string")
    assert S.scrape_literal(lines, "i", "line", "cfg: ") == {"a": 1, "b": [2]}
    assert S.scrape_literal(lines.limit(0), "i", "line", "cfg: ") is None and S.scrape_suffix(lines, "i", "line", "begin", "/runs/") is None


def test_derived_queries_of_odd_tables(spark, tmp_path):
    """Null texts, languages and sources lose no document; empty tables give no rows."""
    for name, rows in (("odd", [(1, None, "en", None), (2, "ab", None, "s"), (3, "", "en", "s")]), ("empty", [])):
        folder = f"file://{tmp_path}/{name}"
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{folder}/documents.parquet")
        assert derived.QUERIES["lr_schedule"](spark, folder).count() == len(rows)
        assert derived.QUERIES["tokens_per_iteration"](spark, folder).count() == min(1, len(rows))
        assert derived.QUERIES["seed_fan_out"](spark, folder).count() == 6 * (name == "odd")
        assert sum(r["n"] for r in derived.QUERIES["shard_name"](spark, folder).collect()) == len(rows)
        assert derived.QUERIES["weighted_draw"](spark, folder).count() == len(rows)
        assert [(r["path"], r["weight"]) for r in derived.QUERIES["weighted_list"](spark, folder).collect()] == [("s", 4.0)] * (name == "odd")
