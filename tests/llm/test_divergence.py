import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.llm import divergence as D

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def brute(rows):
    """Every row of the result, from the definition in Python's whole numbers."""
    rows = [(t or "", lang or "", s or "") for t, lang, s in rows]
    found = [(lang, s, Counter(TERM.findall(lower(t)))) for t, lang, s in rows]
    out = []
    for lang in {r[0] for r in found}:
        inside = Counter(w for g, _, c in found if g == lang for w in c)
        kept = [w for w, n in inside.items() if n >= 3]
        counts = defaultdict(Counter)
        for g, s, c in found:
            if g == lang:
                counts[s].update({w: n for w, n in c.items() if w in set(kept)})
        total = {s: sum(c.values()) for s, c in counts.items()}
        p = {s: {w: 1 + 10**9 * (c[w] + 1) // (total[s] + len(kept)) for w in kept} for s, c in counts.items()}
        every = sum(counts.values(), Counter())
        q = {w: 1 + 10**9 * (every[w] + 1) // (sum(total.values()) + len(kept)) for w in kept}
        for s in counts:
            pairs = [(-sum((p[s][w] - p[o][w]) ** 2 // p[o][w] for w in kept), o) for o in counts if o != s]
            terms = [(-((p[s][w] - q[w]) ** 2 // q[w]), w) for w in kept if counts[s][w] and p[s][w] > q[w]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(terms, key=lambda x: (x[0], x[1].encode()))[:200])):
                out += [(lang, s, part, item, -v, i + 1) for i, (v, item) in enumerate(items)]
    return sorted(out)


def texts(rng, n):
    words = ["the", "The", "été", "ÉTÉ", "漢字", "a1b", "x-y", "don't", "z" * 70, *[f"w{chr(97 + i)}" for i in range(26)]]
    out = []
    for _ in range(n):
        lang, source = rng.choice(["en", "fr", None, ""]), rng.choice(["s0", "s0", "s1", "s2", None])
        out.append((rng.choice([None, "", "123 !"]) if rng.random() < 0.1 else " ".join(rng.choices(words, k=rng.randrange(1, 30))), lang, source))
    return out + [("", "empty", "a"), (None, "empty", "b"), ("only here", "few", "a"), ("only there", "few", "c")]


def rows_of(df):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_result_against_the_definition(spark, seed, monkeypatch):
    rows = texts(random.Random(seed), 150)
    df = spark.createDataFrame(rows, "text string, lang string, source string").withColumns({"term": F.lit(1), "N": F.lit("x"), "value": F.lit(0)})
    assert rows_of(D.divergences(df)) == brute(rows)
    monkeypatch.setattr(D, "BLOCK_ENTRIES", 1)
    monkeypatch.setattr(D, "TILE", 2)
    assert rows_of(D.divergences(df)) == brute(rows)


def test_more_than_the_returned_terms(spark):
    rng = random.Random(9)
    words = [f"{a}{b}{c}" for a in "abcdef" for b in "ghijkl" for c in "mnopqrstu"]
    rows = [(" ".join(rng.choices(words, k=200)), "en", f"s{i % 3}") for i in range(60)]
    got = rows_of(D.divergences(spark.createDataFrame(rows, "text string, lang string, source string")))
    assert got == brute(rows)
    assert max(r[5] for r in got if r[2] == "term") <= 200


def test_query_equals_its_sql(spark, sf):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = c.execute("SELECT lang, source, part, item, value, rank FROM (" + D.SQL["op12_source_divergence"] + ")").fetchall()
    assert rows_of(D.op12_source_divergence(spark, sf)) == sorted(want)


def test_slices_that_share_a_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(D, "slice_hash", lambda t: len(t) % 2)
    data = b"ab cd ab e fgh e ab xyz q"
    low, begins, ends = D.tokens_of(np.frombuffer(data, np.uint8), np.asarray([0, len(data)]))
    group, found = D.grouped(low, begins, ends)
    assert [found[g] for g in group] == data.split()
    assert len(set(group.tolist())) == len(set(data.split()))


def test_terms_end_with_their_text():
    parts = ["abC", "Déf", "", "1", "x"]
    data = "".join(parts).encode()
    offsets = np.cumsum([0] + [len(p.encode()) for p in parts])
    low, begins, ends = D.tokens_of(np.frombuffer(data, np.uint8), offsets)
    assert [low[a:b].tobytes().decode() for a, b in zip(begins, ends, strict=True)] == ["abc", "déf", "x"]


def test_counts_survive_compaction_and_flushes(spark, monkeypatch):
    monkeypatch.setattr(D, "HELD_PAIRS", 5)
    monkeypatch.setattr(D, "HELD_TERMS", 3)
    held = D.TermCounts()
    texts_ = [b"a b a", b"b c", b"d e f a"]
    held.add(["x", "x", "y"], ["s", "s", "t"], np.frombuffer(b"".join(texts_), np.uint8), np.cumsum([0, 5, 3, 7]))
    rows = [r for b in held.rows() for r in b.to_pylist()]
    assert {(r["lang"], r["term"]): (r["n"], r["docs"]) for r in rows}["x", "a"] == (2, 1)
    assert {(r["lang"], r["term"]): (r["n"], r["docs"]) for r in rows}["x", "b"] == (2, 2)
    assert held.held == 0 and not held.terms


def test_shares_of_large_counts():
    counts = np.asarray([0, 1, 10**6, 8 * 10**15], np.int64)
    for total in (1, 7, 10**9 + 7, 9 * 10**15):
        if total >= 10**9:
            assert D.share(counts, np.int64(total)).tolist() == [1 + 10**9 * c // total for c in counts.tolist()]


def test_empty_table(spark):
    assert D.divergences(spark.createDataFrame([], "text string, lang string, source string")).count() == 0
