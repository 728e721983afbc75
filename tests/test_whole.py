"""Queries over whole tables, held against plain Python: no cap on rows, no cut of texts."""

import hashlib
import itertools

import numpy as np
import pyarrow.parquet as pq
import pytest

from loomline.operators import analytics as A
from loomline.operators import blocks as B
from loomline.plans import catalogue


def rows(sf, name, *columns):
    return pq.read_table(f"{sf}/{name}.parquet", columns=list(columns)).to_pylist()


def run(spark, sf, name):
    return catalogue.queries()[name](spark, sf).collect()


def test_shift_xy_gives_every_block(spark, sf):
    stream = "".join(r["text"] + "¶" for r in sorted(rows(sf, "documents", "doc_id", "text"), key=lambda r: r["doc_id"]))
    want = {(i, stream[65 * i : 65 * i + 64], stream[65 * i + 1 : 65 * i + 65]) for i in range(len(stream) // 65)}
    got = run(spark, sf, "shift_xy")
    assert len(got) == len(want) > 200
    assert {(r["block"], r["x"], r["y"]) for r in got} == want


def test_pack_text_cuts_the_stream(spark):
    texts = ["", "a", "é😀\nb", "x" * 7, "yz" * 11, "", "q", "end of all\n\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for block in (1, 4, 5, 7, 100):
        stream = "".join(texts)
        got = {r["block"]: r["text"] for r in B.pack_text(df, "id", "text", block).collect()}
        assert got == {i: stream[block * i : block * i + block] for i in range(len(stream) // block)}


def pairs(sf):
    turns = sorted(rows(sf, "conversations", "conv_id", "turn", "role", "text"), key=lambda r: (r["conv_id"], r["turn"]))
    return {(a["conv_id"], a["turn"]): (a["text"], b["text"]) for a, b in zip(turns, turns[1:]) if a["conv_id"] == b["conv_id"] and (a["role"], b["role"]) == ("user", "assistant")}


def test_qa_pad_keeps_the_end_of_the_answer(spark, sf):
    want = {}
    for k, (q, a) in pairs(sf).items():
        x, y = [ord(ch) for ch in q + a], [-1] * (len(q) - 1) + [ord(ch) for ch in a] + [-1]
        more = max(0, 64 - len(x))
        want[k] = tuple(" ".join(map(str, v[-64:])) for v in (x + x[-1:] * more, y + [-1] * more))
    got = {(r["conv_id"], r["turn"]): (r["x"], r["y"]) for r in run(spark, sf, "qa_pad")}
    assert got == want and any(len(a) > 60 for _, a in pairs(sf).values())


def test_qa_pairs_are_whole(spark, sf):
    line = lambda t: t.replace("\n", "\\n")
    want = {k: f"Q: {line(q)}\nA: {line(a)}" for k, (q, a) in pairs(sf).items()}
    assert {(r["conv_id"], r["turn"]): r["text"] for r in run(spark, sf, "qa_pairs")} == want


def test_few_shot_prompts_are_whole(spark, sf):
    items = sorted(rows(sf, "benchmark", "item_id", "text"), key=lambda r: r["item_id"])
    texts = [r["text"] for r in items]
    shots = [f"{t[:-10]}\n{t[-10:]}\n\n" for t in texts]
    want = {r["item_id"]: "".join(shots[i - k] for k in (1, 2, 3)) + texts[i][:-10] for i, r in enumerate(items)}
    assert {r["item_id"]: r["prompt"] for r in run(spark, sf, "few_shot")} == want


def test_cosine_pairs_covers_all_vectors(spark, sf):
    vectors = {r["vec_id"]: np.array(r["embedding"], float) for r in rows(sf, "embeddings", "vec_id", "embedding")}
    unit = {k: v / np.sqrt(v @ v) for k, v in vectors.items()}
    got = run(spark, sf, "cosine_pairs")
    assert {(r["i"], r["j"]) for r in got} == set(itertools.combinations(sorted(unit), 2)) and len(got) == len(unit) * (len(unit) - 1) // 2
    assert all(abs(r["cosine"] - unit[r["i"]] @ unit[r["j"]]) < 1e-6 for r in got)


def test_cosine_pairs_of_many_blocks(spark):
    data = [(i, [float(i % 7), 1.0] if i else [0.0, 0.0]) for i in range(60)] + [(60, None)]
    for block in (5, 10, 61):
        got = A.cosine_pairs(spark.createDataFrame(data, "id long, v array<float>"), "id", "v", block).collect()
        assert sorted((r["i"], r["j"]) for r in got) == list(itertools.combinations(range(61), 2))
        assert all((r["cosine"] is None) == (r["i"] == 0 or r["j"] == 60) for r in got)


def test_cosine_pairs_of_blocks_without_vectors(spark):
    kind = "id long, v array<float>"
    for none in (None, []):
        got = A.cosine_pairs(spark.createDataFrame([(i, none) for i in range(20)], kind), "id", "v", 5).collect()
        assert sorted(map(tuple, got)) == [(i, j, None) for i, j in itertools.combinations(range(20), 2)]
    data = [(i, [float(i), 1.0] if i % 2 else None) for i in range(20)]
    got = {(r["i"], r["j"]): r["cosine"] for r in A.cosine_pairs(spark.createDataFrame(data, kind), "id", "v", 1).collect()}
    assert set(got) == set(itertools.combinations(range(20), 2))
    assert all((x is not None) == (i % 2 == j % 2 == 1) for (i, j), x in got.items())


def test_mix_synthetic_gives_every_block(spark, sf):
    pytest.importorskip("tiktoken")
    from loomline.operators import synthesis as Y
    from loomline.operators import tokens as T
    from loomline.plans.tokens import END, _vocabulary

    enc, want = T.encoding(*_vocabulary()), {}
    real = sorted((r["doc_id"], r["text"]) for r in rows(sf, "documents", "doc_id", "text"))
    made = sorted((r["id"], r["text"]) for r in Y.arithmetic(spark, 200, 99, 3).collect())
    for kind, texts in (("s", made), ("d", real)):
        ids = [i for _, t in texts for i in [*enc.encode_ordinary(t), END]]
        want |= {f"{kind}{k}": hashlib.md5(" ".join(map(str, ids[128 * k : 128 * k + 128])).encode()).hexdigest() for k in range(len(ids) // 128)}
    order = sorted(want, key=lambda k: (hashlib.md5(f"42:{k}".encode()).hexdigest(), k))
    got = sorted((r["rank"], r["key"], r["md5"]) for r in run(spark, sf, "mix_synthetic"))
    assert got == [(i, k, want[k]) for i, k in enumerate(order)] and {k[0] for k in order} == {"s", "d"}
