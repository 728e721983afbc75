import corpus_pipeline
from loomline.llm import bpe, jaccard, pii


def test_stages_on_small_rows(spark, sf):
    text = "the cat sat on the mat and then it went away to look for food in the kitchen " * 3
    rows = [(1, text, "en", "a"), (2, text + " ", "en", "a"), (3, text + "again", "en", "b"), (4, "Write to me at a.b@c.org, please, when you can.", "en", "b"), (5, None, None, None), (5, None, None, None), (6, "", "de", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "cast(length(text) as bigint) AS n_chars")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[1:]:
        before = docs.columns
        docs = stage(spark, docs, sf)
        kept[name] = docs.collect()
        if name != "best_fit_packing":
            assert docs.columns == before
            docs = spark.createDataFrame(kept[name], docs.schema)
    assert sorted(r["doc_id"] for r in kept["exact_dedup"]) == [2, 3, 4, 5]
    assert sorted(r["doc_id"] for r in kept["jaccard_join"]) == [2, 4, 5]
    assert any("<EMAIL>" in (r["text"] or "") for r in kept["pii_semicrf"])
    assert {r["doc_id"] for r in kept["best_fit_packing"]} == {2, 4, 5}


LONG = "a council in the north voted on Monday to open the old harbour again, after years of talk and many plans that came to nothing, and the first boats are due in spring; nobody in the town could say who would pay for it. "


def test_no_row_is_lost_by_its_id(spark, sf):
    """Repeated and null ids with different texts: each stage decides rows, not ids."""
    other = "quite another story about bread and the people who bake it every night in a small shop near the station, told by one who was there and wrote it all down before it was forgotten. "
    rows = [(3, LONG * 3, "en", "a"), (5, LONG * 3 + "indeed", "en", "a"), (5, other * 3, "en", "b"), (None, LONG * 3 + "in fact", "en", "c"), (None, other * 3 + "truly", "en", "c"), (None, "short one.", "en", "c"), (None, None, None, None), (9, "", "en", "a"), (9, " ", "en", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "cast(length(text) as bigint) AS n_chars", "1 AS `__row`", "2 AS `__gone`")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["jaccard_join"](spark, docs, sf)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or -1, (r["text"] or "")[:5]) for r in kept.collect()) == sorted([(3, "a cou"), (5, "quite"), (-1, "short"), (-1, ""), (9, ""), (9, " ")])
    kept = stages["exact_dedup"](spark, docs, sf)
    assert kept.columns == docs.columns and kept.count() == 7  # the three empty texts are one group
    kept = stages["quality_classifier"](spark, docs, sf)
    assert kept.columns == docs.columns and kept.count() >= 6
    twice = docs.unionByName(docs)
    assert sorted(r["text"] or "" for r in stages["exact_dedup"](spark, twice, sf).collect()) == sorted(r["text"] or "" for r in stages["exact_dedup"](spark, docs, sf).collect())


def test_many_dropped_rows_are_merged(spark, sf, monkeypatch):
    """Past the number that may be broadcast the result is the same."""
    from loomline.llm import common, packing

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda: sorted(r["doc_id"] for r in stages["exact_dedup"](spark, docs, sf).collect())
    places = lambda: sorted((r["doc_id"], r["piece"], r["length"]) for r in stages["best_fit_packing"](spark, docs, sf).collect())
    small, packed = ids(), places()
    monkeypatch.setattr(common, "MOST_GONE", 0)
    monkeypatch.setattr(packing, "MOST_BROADCAST", 0)
    plan = stages["exact_dedup"](spark, docs, sf)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and ids() == small and len(small) < docs.count()
    assert places() == packed


def test_run_on_an_empty_table(spark, sf, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf).collect()
    assert out and {"doc_id", "piece", "sequence_id", "offset"} <= set(out[0].asDict())
    assert bpe and jaccard and pii


def test_no_documents(spark, sf):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).count() == 0
