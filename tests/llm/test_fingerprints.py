import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.llm import fingerprints as P


def weights(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return Counter(re.findall(r"[^\x20\x09-\x0D]+", low))


def jaccard(a, b):
    a, b = weights(a), weights(b)
    return sum((a & b).values()) / sum((a | b).values()) if a or b else 1.0


def samples_of(text, samples):
    """The samples one by one, from the formula, with the operator's draws of one term at a time."""
    out = []
    for j in range(samples):
        drawn = [P.draws([w.encode()], np.asarray([n], np.float32), samples) for w, n in weights(text).items()]
        out.append(min(((float(a[0, j]), int(c[0, j])) for a, c in drawn), default=(0, 65535))[1])
    return out


def expected(rows):
    """(id, n_chars, sha of the edited text, likenesses' exact values) from the whole list in memory."""
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for i, (d, t) in enumerate(order):
        t, following = t or "", order[(i + 1) % len(order)][1] or ""
        k = len(t) // 3
        now = t[: len(t) - k] + following[:k]
        out[d] = (len(t), hashlib.sha256(now.encode()).hexdigest(), t, now, following)
    return out


def test_collision_rate_is_the_generalised_jaccard_similarity():
    rng = random.Random(3)
    sampler = P.Sampler(4096)
    for words in (5, 60):
        for _ in range(4):
            a = [f"w{rng.randrange(words)}" for _ in range(120)]
            b = a[:70] + [f"w{rng.randrange(words)}" for _ in range(rng.randrange(20, 300))]
            x, y = sampler([" ".join(a), " ".join(b)])
            want = jaccard(" ".join(a), " ".join(b))
            assert abs((x == y).mean() - want) < 5 * (want * (1 - want) / 4096) ** 0.5 + 1e-3


def test_samples_are_those_of_the_formula(monkeypatch):
    texts = ["a b b c c c", "A b B c", "", "é É x", " ".join(f"t{i}" for i in range(40))]
    got = P.Sampler(8)(texts)
    assert [r.tolist() for r in got] == [samples_of(t, 8) for t in texts]
    monkeypatch.setattr(P, "KEPT", 64)
    monkeypatch.setattr(P, "AT_ONCE", 4)
    assert (P.Sampler(8)(texts) == got).all()


def test_draws_follow_their_distributions():
    """A term of weight S is the least of many with a chance in proportion to S."""
    n = 20_000
    a = P.draws([b"x"], np.asarray([3], np.float32), n)[0]
    b = P.draws([b"y"], np.asarray([1], np.float32), n)[0]
    assert abs((a < b).mean() - 0.75) < 0.02


@pytest.mark.parametrize("bucket_rows", [7, 1024])
def test_query_equals_brute_force_on_a_table(spark, sf, tmp_path, monkeypatch, bucket_rows):
    monkeypatch.setattr(P, "BUCKET_ROWS", bucket_rows)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    odd = [None, "", " ", "é", "漢字 漢字 x", "same words", "same words", "words same", "long " * 40_000]
    rows = docs.unionByName(spark.createDataFrame([(5000 + 17 * i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    rows.withColumns({"bucket": F.lit(1), "TEXT_": F.lit("x"), "last": F.lit(0)}).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in P.op13_fingerprints(spark, str(tmp_path)).collect()}
    want = expected([tuple(r) for r in rows.collect()])
    assert got.keys() == want.keys()
    sampler = P.Sampler()
    for d, (n, sha, text, now, following) in want.items():
        r = got[d]
        assert (r["n_chars"], r["edited_sha256"]) == (n, sha)
        prints = sampler([text, now, following])
        assert [r["fingerprint"], r["edited_fingerprint"]] == P._hex(prints[:2])
        for near, other in ((r["near_edited"], now), (r["near_next"], following)):
            j = jaccard(text, other)
            assert abs(near - j) <= 5 * (j * (1 - j) / P.SAMPLES) ** 0.5 + 0.02
    same = [got[5000 + 17 * i]["fingerprint"] for i in (5, 6, 7)]
    assert len(set(same)) == 1
    plain = {r["doc_id"]: r["fingerprint"] for r in P.fingerprints(rows).collect()}
    assert plain == {d: r["fingerprint"] for d, r in got.items()}


def test_repeated_null_and_single_rows(spark):
    df = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "x y"), (None, None), (1, "d")], "doc_id long, text string")
    out = P.edited_fingerprints(df).collect()
    assert sorted((r["doc_id"] is None, r["n_chars"]) for r in out) == [(False, 1), (False, 5), (False, 5), (True, 0), (True, 3)]
    one = P.edited_fingerprints(df.limit(1)).collect()
    assert [(r["n_chars"], r["near_next"]) for r in one] == [(5, 1.0)]
    assert P.edited_fingerprints(df.limit(0)).count() == 0
