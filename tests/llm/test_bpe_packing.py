import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.llm import bpe, packing

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(bpe.default_vocabulary())


def texts():
    r = random.Random(4)
    out = [None, "", " \n\t", "A", "It's <|endoftext|> here", "é" * 9000, "ab" * 6000 + " tail", "<|endoftext|>" + "x" * 5000, "Σς ̈ a", "\x1ca\x85b\xa0c"]
    for _ in range(60):
        out.append("".join(r.choice(["abc", "etaoin", "é ü'1!", "中文 a", "\n x"])[0 if r.random() < 0.3 else -1] for _ in range(r.randint(1, 400))))
    return out


def test_whole_texts_match_the_library(spark, library):
    rows = list(enumerate(texts())) + [(3, "A"), (None, "null id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = bpe.decode(bpe.encode(df, leaf=1000)).collect()
    want = sorted((i if i is not None else -1, library.encode(t or "", add_special_tokens=False).ids) for i, t in rows)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, np.frombuffer(r["ids"], "<u4").tolist()) for r in got) == want
    assert sorted(r["text"] for r in got) == sorted(library.decode(ids, skip_special_tokens=False) for _, ids in want)


def test_tree_concatenation(library):
    enc, r = bpe.Encoder(bpe.default_vocabulary(), leaf=16), random.Random(2)
    for _ in range(300):
        s = "".join(r.choice("aaabcdeétion") for _ in range(r.randint(17, 300)))
        out, leaves = [], []
        for leaf, first, last, payload in enc.parts(s):
            if not leaf or first:
                out, leaves = out + enc.tree(leaves), []
            if leaf:
                leaves.append(enc.piece(payload, last))
            else:
                out += np.frombuffer(payload, "<u4").tolist()
        assert out + enc.tree(leaves) == library.encode(s, add_special_tokens=False).ids


def test_branches_are_joined_like_leaves(library):
    enc, r = bpe.Encoder(bpe.default_vocabulary(), leaf=16, dealt=64), random.Random(3)
    for _ in range(100):
        s = "".join(r.choice("aaabcdeétion") for _ in range(r.randint(65, 600)))
        parts = list(enc.parts(s))
        assert all(is_branch and 16 < len(x) <= 64 for is_branch, _, _, x in parts)
        assert enc.tree([enc.branch(x, last) for _, _, last, x in parts]) == library.encode(s, add_special_tokens=False).ids


def test_long_runs_of_any_letters_are_unsplit_text(spark, library, monkeypatch):
    plain, seen = bpe._encode_unsplit, []
    monkeypatch.setattr(bpe, "_encode_unsplit", lambda rows, *a: seen.append(sorted(r["id"] for r in rows.collect())) or plain(rows, *a))
    texts = ["ab" * 600, "x " * 900, "é" * 1001, "a" * 1000, "tail\n" + "Qz" * 501 + " 1", "x20-" * 300, "1 " * 600 + "w" * 1001, None]
    got = bpe.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), leaf=1000).collect()
    assert seen == [[0, 2, 4, 5, 6]]
    assert {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in got} == {i: library.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}


def test_caches_keep_no_long_runs(library):
    """Whole texts as single runs filled the caches, which bounded only their number."""
    enc = bpe.Encoder(bpe.default_vocabulary())
    for i in range(40):
        for s in (f"{chr(97 + i % 26)}{'bcd' * i}" * 90, f"a{i}_" * 100, f"中{i}文" * 100, "short words"):
            assert np.frombuffer(enc.ids(s), "<u4").tolist() == library.encode(s, add_special_tokens=False).ids
    assert 0 < max(len(w) for kept in (enc.cache, enc.old_cache, enc.words, enc.old_words) for w in kept) < 100


def test_query_against_the_library(spark, sf, library):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in bpe.op8_bpe_encode_decode(spark, sf).collect():
        ids = library.encode(docs[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_unsplit_runs_against_the_library(spark, sf, library):
    """Every text as one run: the query's rows come out of tree concatenation."""
    docs = {r["doc_id"]: "".join(c for c in r["text"] or "" if c.isalpha()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = bpe.bpe_unsplit_runs(spark, sf).collect()
    assert len(out) == len(docs) and sum(len(t) > 64 for t in docs.values()) > 0.9 * len(docs)
    wrong = [r["doc_id"] for r in out if r["ids_sha256"] != hashlib.sha256(np.asarray(library.encode(docs[r["doc_id"]], add_special_tokens=False).ids, "<u4").tobytes()).hexdigest()]
    assert not wrong


def best_sum(counts, gap):
    reach = {0}
    for n, c in counts.items():
        reach |= {s + n * k for s in list(reach) for k in range(1, c + 1) if s + n * k <= gap}
    return max(reach)


def test_fullest_combination():
    r = random.Random(1)
    for _ in range(200):
        counts = {n: r.randint(0, 3) for n in sorted(r.sample(range(1, 40), 6))}
        counts = {n: c for n, c in counts.items() if c}
        gap = r.randint(1, 80)
        got = packing.fullest(counts, gap)
        assert sum(n * c for n, c in got.items()) == best_sum(counts, gap)
        assert all(c <= counts[n] for n, c in got.items())


def test_plan_uses_every_piece():
    counts = {5: 100, 7: 33, 64: 3, 1: 10, 31: 8}
    used: dict[int, int] = {}
    for times, one in packing.plan_bins(counts, 64):
        assert sum(n * c for n, c in one.items()) <= 64
        for n, c in one.items():
            used[n] = used.get(n, 0) + times * c
    assert used == counts
    assert packing.plan_bins({}, 64) == []


def check_places(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_is_gapless_and_whole(spark):
    rows = [(i, np.arange(i * 7 % 150, dtype="<u4").tobytes()) for i in range(300)] + [(5, b""), (5, b""), (None, None)]
    pieces = packing.cut_pieces(spark.createDataFrame(rows, "doc_id long, ids binary"), capacity=64)
    out = packing.pack(pieces, capacity=64).collect()
    total = sum(len(b or b"") // 4 + 1 for _, b in rows)
    assert sum(r["length"] for r in out) == total and len(out) == pieces.count()
    assert check_places(out, 64) <= -(-total // 64) + 2
    assert all(r["start"] == r["piece"] * 64 for r in out)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decode(bpe.encode(empty)).count() == 0
    assert packing.pack(packing.cut_pieces(bpe.encode(empty))).count() == 0


def test_pieces_against_the_library(spark, sf, library):
    """start, length and ids_crc32 of every piece, from the library's own ids."""
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = set()
    for i, t in docs.items():
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = np.asarray(ids[at : at + 4096], "<u4")
            want.add((i, k, at, len(part), zlib.crc32(part.tobytes())))
    got = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packing.op3_best_fit_packing(spark, sf).collect()]
    assert len(got) == len(want) and set(got) == want


def test_one_common_length_over_many_tasks(spark):
    rows = spark.range(0, 5000, 1, 37).selectExpr("id AS doc_id", "cast(CASE WHEN id % 5 < 3 THEN 64 ELSE 1 + id % 63 END AS long) AS length", "1 AS __rank")
    out = packing.pack(rows, capacity=64).collect()
    assert len(out) == 5000 and len({(r["sequence_id"], r["offset"]) for r in out}) == 5000
    assert check_places(out, 64) <= -(-sum(r["length"] for r in out) // 64) + 2


def test_packing_query(spark, sf):
    out = packing.op3_best_fit_packing(spark, sf).collect()
    assert {r["doc_id"] for r in out} == {r["doc_id"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    n = check_places(out, 4096)
    assert n <= -(-sum(r["length"] for r in out) // 4096) + 1
