import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.llm import runs


def brute(words):
    """Every run, from the definition: for each period, stretches where words that far apart are equal."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)  # the smallest period of a stretch comes first
            i = j
    return sorted((s, length, q) for (s, length), q in found.items())


def rewritten(words, doc_id):
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def expected(doc_id, text):
    words = rewritten(re.findall(r"[^\x20\x09-\x0D]+", text or ""), doc_id)
    found = brute(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    top = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *top, sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def numbers(rng, n, kinds):
    out = []
    while len(out) < n:
        part = [rng.randrange(kinds) for _ in range(rng.randrange(1, 9))]
        out += part * rng.choice([1, 1, 2, 4, 5, 9])
    return out[:n]


@pytest.mark.parametrize("kinds", [1, 2, 3, 40])
def test_runs_against_the_definition(kinds):
    rng = random.Random(kinds)
    for _ in range(60):
        texts = [np.asarray(numbers(rng, rng.randrange(0, 160), kinds), dtype=np.int64) for _ in range(8)]
        for t, got in zip(texts, runs.find_runs(texts), strict=True):
            assert [tuple(r) for r in got.tolist()] == brute(t.tolist())


def test_a_lower_top_level_gives_the_same(monkeypatch):
    rng = random.Random(5)
    texts = [np.asarray(numbers(rng, 700, k), dtype=np.int64) for k in (1, 2, 9)]
    whole = [r.tolist() for r in runs.find_runs(texts)]
    monkeypatch.setattr(runs, "TOP", 3)
    monkeypatch.setattr(runs, "AT_ONCE", 50)
    assert [r.tolist() for r in runs.find_runs(texts)] == whole
    assert whole[0] == [[0, 700, 1]]


def test_query_equals_brute_force_on_a_table(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    odd = [None, "", " \t\n", "a", "a a a a a", "a a a a a a", "é é é é é é x", "x " * 30_000, "ab cd " * 50 + "e", "one two three " * 4 + "one two three"]
    planted = [(i, "ab cd ef gh ij kl mn op qr st uv wx yz " * 3) for i in range(2000, 2100)]
    rows = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(odd)] + planted + [(7, "again")], "doc_id long, text string")
    rows = docs.unionByName(rows).withColumns({"runs": F.lit("x"), "ID": F.lit(2), "Collapsed": F.lit(3)})
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in runs.op11_periodic_runs(spark, str(tmp_path)).collect())
    want = sorted(expected(r["doc_id"], r["text"]) for r in rows.select("doc_id", "text").where("length(text) < 50000 OR text IS NULL").collect())
    long = [r for r in got if r[0] == 1007]
    assert [r for r in got if r[0] != 1007] == want
    assert long[0][2:6] == (0, 30_000, 1, 30_000_000) if zlib.crc32(b"1007") % 10 else True
    assert sum(r[1] > 0 for r in got) > 10


def test_empty_tables_and_rows_without_an_id(spark):
    df = spark.createDataFrame([(None, "a b " * 9)], "doc_id long, text string")
    assert runs.periodic_runs(df, plant=True).first()["runs"] == [(0, 18, 2)]
    assert runs.periodic_runs(df, plant=True).first()["collapsed"] == "a b"
    assert runs.periodic_runs(df.limit(0)).count() == 0
