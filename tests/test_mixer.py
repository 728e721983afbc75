import hashlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.functions.permutation import permute_number, permuted
from loomline.operators import mixer as M
from loomline.operators import packed as K
from loomline.plans import mixes


def uniform(seed, x):
    return int(hashlib.md5(f"{seed}:{x}".encode()).hexdigest()[:8], 16) / 2**32


def mixed(rows, weights, sequences, length, end, seed):
    """The mixer one draw at a time: rows (source, key, ids)."""
    by = {}
    for source, key, ids in sorted(rows, key=lambda r: (r[0], r[1])):
        by.setdefault(source, []).append(ids)
    names = sorted(s for s in weights if s in by and weights[s] > 0)
    total = sum(weights[s] for s in names)
    out, draw, used, part = [], 0, Counter(), 0
    held = []
    while part < sequences:
        while len(held) < length:
            u, acc = uniform(seed, draw), 0.0
            for s in names:
                acc += weights[s]
                if u < acc / total:
                    break
            used[s] += 1
            held += [*by[s][int(uniform(seed + 1, draw) * len(by[s]))], end]
            draw += 1
        out.append(held[:length])
        held, part = held[length:], part + 1
    return out, used


def packed(ids, width):
    return bytearray(np.asarray(ids, dtype=f"<u{width}").tobytes())


@pytest.mark.parametrize("width,sequences", [(1, 5), (2, 40), (4, 150)])
def test_mixer_against_one_draw_at_a_time(spark, width, sequences):
    rows = [(f"s{i % 3}", i, [i % 200] * (i % 7) + [7] * (i % 2)) for i in range(60)] + [("alone", 99, [])]
    weights = {"s0": 5.0, "s1": 1.0, "s2": 0.0, "alone": 2.0, "missing": 9.0}
    df = spark.createDataFrame([(s, k, packed(ids, width)) for s, k, ids in rows], "source string, key long, data binary")
    w = spark.createDataFrame(list(weights.items()), "source string, weight double")
    draws, blocks = M.mix(df, "source", "key", "data", w, "weight", sequences, 11, (250).to_bytes(width, "little"), 4)
    want, used = mixed(rows, weights, sequences, 11, 250, 4)
    got = {r["block"]: np.frombuffer(bytes(r["data"]), f"<u{width}").tolist() for r in blocks.collect()}
    assert [got[i] for i in range(sequences)] == want
    assert len(got) == sequences
    assert {r["source"]: r["count"] for r in draws.groupBy("source").count().collect()} == dict(used)


def test_nothing_to_draw_from(spark):
    df = spark.createDataFrame([("a", 1, None)], "source string, key long, data binary")
    with pytest.raises(ValueError):
        M.mix(df.limit(0), "source", "key", "data", spark.createDataFrame([("a", 1.0)], "source string, weight double"), "weight", 1, 4, b"\0", 1)
    _, blocks = M.mix(df, "source", "key", "data", spark.createDataFrame([("a", 1.0)], "source string, weight double"), "weight", 2, 4, b"\0", 1)
    assert [bytes(r["data"]) for r in blocks.collect()] == [b"\0" * 4] * 2


def test_marks(spark):
    rows = spark.range(250).withColumnRenamed("id", "block").where(M.marks(250)).collect()
    assert [r["block"] for r in rows] == [99, 199, 249]
    assert [r["block"] for r in spark.range(200).withColumnRenamed("id", "block").where(M.marks(200)).collect()] == [99, 199]


def tokens(spark, sf):
    import public_tokenizers
    import tokenizers

    tok = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "text").orderBy("doc_id").collect()
    return [(r["source"], r["doc_id"], tok.encode(r["text"] or "", add_special_tokens=False).ids) for r in rows]


def md5(ids):
    return hashlib.md5(np.asarray(ids, "<u2").tobytes()).hexdigest()


def test_streams_of_real_ids_against_plain_python(spark, sf):
    rows = tokens(spark, sf)
    stream = [i for _, _, ids in rows for i in [*ids, mixes.END_ID]]
    n = len(stream)
    blocks = {r["block"]: r["md5"] for r in mixes.pack_bpe(spark, sf).collect()}
    assert blocks == {k: md5(stream[k * 513 : (k + 1) * 513]) for k in range(n // 513)}
    got = mixes.windows_bpe(spark, sf).collect()
    assert len(got) == 4 * (-(-n // 1200) + 1)
    for r in got:
        assert r["start"] == (r["rank"] + 4 * r["step"]) * 300 % n
        window = [stream[(r["start"] + j) % n] for j in range(301)]
        assert (r["x_md5"], r["y_md5"]) == (md5(window[:-1]), md5(window[1:]))
    weights = {s: c % 7 + 1.0 for s, c in Counter(r[0] for r in rows).items()}
    sequences = -(-n // 513)
    want, _ = mixed(rows, weights, sequences, 513, mixes.END_ID, 31)
    got = {r["block"]: r["md5"] for r in mixes.mix_pack_bpe(spark, sf).collect()}
    assert got == {i: md5(x) for i, x in enumerate(want)}


def test_null_and_empty_streams(spark):
    df = spark.createDataFrame([(1, packed([1, 2, 3], 2)), (2, None), (None, packed([9], 2)), (3, packed([], 2)), (4, packed([4], 2))], "k long, data binary")
    got = K.pack_stream(df, "k", "data", 2, 2, keep_rest=True).orderBy("block").collect()
    assert [np.frombuffer(bytes(r["data"]), "<u2").tolist() for r in got] == [[1, 2], [3, 4], [9]]
    assert [r["n_docs"] for r in got] == [1, 2, 1]
    assert K.pack_stream(df.limit(0), "k", "data", 2, 2).count() == 0


@pytest.mark.parametrize("name", ["mix_pack", "mix_usage", "pack_bytes", "windows_bytes", "batch_permuted", "permuted_head"])
def test_queries_equal_their_sql(spark, sf, name):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = mixes.QUERIES[name](spark, sf).toPandas()
    want = c.execute(mixes.SQL[name]).df()[list(got.columns)]
    key = lambda t: sorted(map(tuple, t.astype(str).values.tolist()))
    assert key(got) == key(want)


def test_permutation_of_every_small_size():
    for n in [*range(1, 200), 1000, 4096, 4097, 10_000]:
        places = [permute_number(x, n, 3) for x in range(n)]
        assert sorted(places) == list(range(n))
        assert all(permute_number(p, n, 3, inverse=True) == x for x, p in enumerate(places[:50]))


@pytest.mark.parametrize("n", [1, 2, 3, 1000, 10**12 + 7])
def test_permutation_in_spark(spark, n):
    df = spark.range(min(n, 1000)).withColumn("at", permuted(F.col("id"), n, 9)).withColumn("back", permuted(F.col("at"), n, 9, inverse=True))
    for r in df.collect():
        assert r["at"] == permute_number(r["id"], n, 9) and r["back"] == r["id"]


def test_permutations_of_two_seeds_are_far_apart():
    n = 5000
    places = np.asarray([permute_number(x, n, 1) for x in range(n)])
    others = np.asarray([permute_number(x, n, 2) for x in range(n)])
    assert (places == others).sum() < 20
    assert abs(np.corrcoef(np.arange(n), places)[0, 1]) < 0.05
