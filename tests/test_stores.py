import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.operators import analytics as A
from loomline.operators import blocks as B
from loomline.operators import corpus as C
from loomline.operators import prompts as P
from loomline.operators import scoring as S
from loomline.operators import store as T
from loomline.sources import readers as R
from loomline.sources import sinks
from loomline.sources import tokenfiles as K


def folder(tmp_path, name):
    return f"file://{tmp_path}/{name}"


def small_store(spark):
    rows = [(s, r, i, t, 10 * i + t, t, [(t, 0.5), (9, 0.25)]) for s in range(3) for r in range(2) for i in range(4) for t in range(2)]
    return spark.createDataFrame(rows, "step long, rank long, row long, t long, x long, y long, topk array<struct<idx:int,prob:double>>")


def test_store_steps(spark, tmp_path):
    T.write_store(small_store(spark), folder(tmp_path, "store"))
    store = T.read_store(spark, folder(tmp_path, "store"))
    assert store.count() == 48 and tuple(T.latest(store).first()) == (2, 1, 9)
    whole = T.load_step(store, 4, 3, 4, 1).collect()  # step 4 mod 3, rank 3 mod 2
    assert {(r["step"], r["rank"]) for r in whole} == {(1, 1)} and len(whole) == 8 and all(r["draw"] == r["row"] for r in whole)
    drawn = T.load_step(store, 0, 0, 3, 1).collect()
    assert len(drawn) == 6 and {r["draw"] for r in drawn} == {0, 1, 2}
    with pytest.raises(ValueError):
        T.load_step(store, 0, 0, 5, 1)
    halves = {(r["step"], r["row"]) for r in T.halves(store).collect()}
    assert halves == {(2 * s + (i >= 2), i) for s in range(3) for i in range(4)}


def test_padding_takes_unused_indices(spark):
    row = spark.createDataFrame([([(3, 0.6), (1, 0.4)], [1, 5, 3, 7]), ([(3, 1.0)], [3])], "a array<struct<idx:int,prob:double>>, b array<int>")
    got = [[(e["idx"], e["prob"]) for e in r[0]] for r in row.select(T.pad_topk(F.col("a"), F.col("b"), 4)).collect()]
    assert got == [[(3, 0.6), (1, 0.4), (5, 0.0), (7, 0.0)], [(3, 1.0)]]


def test_distillation_against_numpy(spark):
    rng = np.random.default_rng(2)
    z, r, y = rng.normal(size=(6, 5)), rng.normal(size=(6, 5)), rng.integers(0, 5, 6)
    df = spark.createDataFrame([(i // 3, i % 3, z[i].tolist(), r[i].tolist(), int(y[i])) for i in range(6)], "b int, t int, z array<double>, r array<double>, y int")
    soft = lambda v: np.exp(v) / np.exp(v).sum(-1, keepdims=True)
    ce = lambda v: -np.log(soft(v)[np.arange(6), y])
    p, q = soft(r / 2), soft(z / 2)
    masked = np.where(r >= np.sort(r)[:, [-2]], p, 0)
    masked /= masked.sum(1, keepdims=True)
    forward = np.where(masked > 0, masked * np.log(np.maximum(masked, 1e-300) / q), 0).sum(1)
    backward = (q * np.log(q / (p + 1e-8))).sum(1)
    for options, kl in (({"k": 2}, forward), ({"reverse": True}, backward)):
        want = 0.1 * ce(z) + 3.6 * kl
        got = {(x["b"], x["t"]): x["loss"] for x in S.distill(df, "b", "t", F.col("z"), F.col("y"), F.col("r"), **options).collect()}
        assert all(abs(got[i // 3, i % 3] - want[i]) < 1e-9 for i in range(6))
        kept = S.distill(df, "b", "t", F.col("z"), F.col("y"), F.col("r"), keep=0.5, **options).collect()
        best = {b: max(range(3), key=lambda t: (ce(z) - ce(r))[3 * b + t]) for b in (0, 1)}  # noqa: B023
        assert {(x["b"], x["t"]) for x in kept} == set(best.items())


def test_attention_selection(spark):
    # attention sums 1, 3, 2 -> positions 1, 2 -> tokens before them 0, 1
    rows = [(0, 0, 0.1, [0.0, 1.0, 1.0]), (0, 1, 0.9, [0.0, 1.0, 1.0]), (0, 2, 0.5, [1.0, 1.0, 0.0])]
    df = spark.createDataFrame(rows, "b int, t int, d double, a array<double>")
    got = sorted((r["place"], r["t"]) for r in S.attention_select(df, "b", "t", F.col("d"), F.col("a"), 1.0).collect())
    assert got == [(0, 1), (1, 2), (2, 0), (3, 1)]


def test_bare_files_and_capacity(spark, tmp_path):
    rows = spark.createDataFrame([(i, list(range(i % 5))) for i in range(50)], "id long, ids array<long>")
    stream = [t for i in range(50) for t in range(i % 5)]
    blocks = B.pack_blocks(rows, "id", "ids", 8, keep_rest=True)
    with pytest.raises(ValueError):
        K.write_flat(blocks, folder(tmp_path, "small"), "uint16", 8, capacity=len(stream) - 1)
    name = K.write_flat(blocks, folder(tmp_path, "flat"), "uint16", 8, parts=1, capacity=len(stream)).first()["name"]
    path = folder(tmp_path, f"flat/{name}")
    assert [t for r in sorted(K.read_bin(spark, path, "uint16", 7).collect()) for t in r["ids"]] == stream
    assert K.ends_of(spark, path, "uint16", 20) == (len(stream), stream[:20], stream[-20:])
    with pytest.raises(ValueError):
        K.read_bin(spark, path, "complex256") if len(stream) % 16 else K.read_bin(spark, path, "S3")
    K.write_indexed(rows, "id", "ids", folder(tmp_path, "indexed"), parts=3)
    got = {r["sample"]: r["ids"] for r in K.read_indexed(spark, folder(tmp_path, "indexed")).collect()}
    assert got == {i: list(range(i % 5)) for i in range(50)}
    one = K.write_indexed(rows, "id", "ids", folder(tmp_path, "one"), parts=1).first()["name"]
    pair = K.read_pair(spark, folder(tmp_path, f"one/{one}"), 7)
    assert pair.count() == 50 and pair.where("sample = 13").first()["ids"] == [0, 1, 2]
    assert K.parts_for(10, "uint16") == 8 and K.parts_for(1 << 40, "uint32") == 1 << 14


def test_lines_survive_escapes(spark, tmp_path):
    texts = ["a\nb", "back\\slash\\n", "\\", "", "\r\n\\\\n", "plain", "tab\there"]
    sinks.write_lines(spark.createDataFrame([(t,) for t in texts], "text string"), "text", folder(tmp_path, "lines"))
    assert sorted(r["text"] for r in sinks.read_lines(spark, folder(tmp_path, "lines")).collect()) == sorted(texts)


def test_sidecars_and_splits(spark, tmp_path):
    assert sinks.vocabulary_size(spark, folder(tmp_path, "none"), 7) == 7
    sinks.write_vocabulary(spark.createDataFrame([("a", 0), ("b", 1)], "ch string, id long"), folder(tmp_path, "corpus"))
    assert sinks.vocabulary_size(spark, folder(tmp_path, "corpus")) == 2
    spark.range(10).write.parquet(folder(tmp_path, "c/train"))
    assert set(sinks.splits_of(spark, folder(tmp_path, "c"), lambda t: {"made": t})) == {"made"}
    spark.range(3).write.parquet(folder(tmp_path, "c/val"))
    assert sinks.splits_of(spark, folder(tmp_path, "c"), lambda t: {})["val"].count() == 3


def test_names_and_forms(spark):
    ranges = {"a": (0, 12), "b": (12, 15)}
    assert R.shard_range("x/b", ranges) == ["001_00002.parquet", "001_00003.parquet", "001_00004.parquet"]
    with pytest.raises(ValueError):
        R.shard_range("x/c", ranges)
    assert R.limit_files(["c", "a", "b"], 2) == ["a", "b"] and R.limit_files(["b", "a"], None) == ["a", "b"]
    assert len(P.FORMS) == 14
    with pytest.raises(ValueError):
        P.formatted(spark.range(1), "unknown", ["id"])
    row = P.fixed_choice(spark.createDataFrame([(1, "x"), (2, "z")], "id int, v string"), "id", "v", ["w", "x"]).orderBy("id").collect()
    assert [r["answer"] for r in row] == ["(B)", None]


def test_corpus_cut(spark):
    df = spark.createDataFrame([(1, "abcd"), (2, None), (3, "efg"), (4, "hij")], "id long, text string")
    assert [r["cut"] for r in C.corpus_cut(df, "id", "text", 0.55).orderBy("id").collect()] == [4, 0, 1, 0]


def greedy(c, near):
    """Similarity order step by step."""
    left, order, head = list(range(len(c))), [], 0
    while left:
        order += [i for i in left if i == head or c[head][i] > near]
        opposite = [i for i in left if c[head][i] < -near]
        left = [i for i in left if i not in order]
        head = opposite[-1] if opposite else left[0] if left else None
    return order


def test_cosines_and_order_of_columns(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 4))
    m = np.concatenate([base, base + 0.2 * rng.normal(size=(40, 4)), -base[:, :2], np.zeros((40, 1))], axis=1)
    df = spark.createDataFrame([(x.tolist(),) for x in m] + [(None,)], "v array<double>")
    got = {(r["i"], r["j"]): r["cosine"] for r in A.cosine_columns(df, "v").collect()}
    assert len(got) == 55 and all(got[i, 10] is None for i in range(10))
    unit = m[:, :10] / np.sqrt((m[:, :10] ** 2).sum(0))
    assert all(abs(got[i, j] - unit[:, i] @ unit[:, j]) < 1e-9 for i in range(10) for j in range(i + 1, 10))
    c = np.eye(11)
    c[:10, :10] = unit.T @ unit
    cosines = A.cosine_columns(df, "v")
    ordered = lambda n, near: [r["component"] for r in A.similarity_order(cosines, n, near).orderBy("place").collect()]
    assert ordered(11, 0.6) == greedy(c, 0.6) and ordered(11, 0.1) == greedy(c, 0.1) and ordered(0, 0.6) == []


def test_windows_go_round_the_end(spark):
    stream = list(range(23))
    blocks = B.pack_blocks(spark.createDataFrame([(0, stream)], "id long, ids array<int>"), "id", "ids", 5, keep_rest=True)
    for length in (1, 4, 5, 23, 50):
        windows = spark.createDataFrame([(s,) for s in range(0, 23, 3)], "start long")
        got = {r["start"]: r["ids"] for r in B.gather(windows, blocks, 5, length, 23).collect()}
        assert got == {s: [(s + k) % 23 for k in range(length)] for s in range(0, 23, 3)}


def test_buckets_of_sparse_and_far_ids(spark):
    from loomline.operators.ordering import range_bucket, rank

    ids = [-(1 << 63), -5, 0, 1, 2, 3, 10**6, 10**12, 10**15, (1 << 63) - 1]
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    got = rank(df, ["id"], bucket=range_bucket(df, ["id"], 2)).collect()
    assert {r["id"]: r["rank"] for r in got} == {i: k for k, i in enumerate(sorted(ids))}
    sparse = spark.range(0, 10**9, 10**5)
    assert rank(sparse, ["id"], bucket=range_bucket(sparse, ["id"], 100)).agg(F.max("rank")).first()[0] == 9999
    assert sparse.select(range_bucket(sparse, ["id"], 100)).distinct().count() <= 101
    assert rank(df.limit(0), ["id"]).count() == 0


def test_templates_are_filled(spark):
    from loomline.operators import synthesis as Y

    texts = [r["text"] for r in Y.arithmetic(spark, 3000, 50, 1).collect()]
    assert sum(map(len, Y.TEMPLATES.values())) == 45 and not any("{" in t for t in texts) and len(set(texts)) > 2500


def test_clusters_of_clear_groups(spark):
    rng = np.random.default_rng(5)
    rows = [(g, (20.0 * np.eye(6)[g] + rng.normal(size=6)).tolist()) for g in range(4) for _ in range(30)]
    got = A.kmeans_clusters(spark.createDataFrame(rows, "g int, v array<double>"), "v", 4, 4).groupBy("g").agg(F.countDistinct("cluster").alias("n"), F.first("cluster").alias("c")).collect()
    assert all(r["n"] == 1 for r in got) and len({r["c"] for r in got}) == 4


def test_named_shards_are_read(spark, tmp_path):
    for i in range(4):
        spark.range(i, i + 1).write.parquet(folder(tmp_path, f"shards/000_{i:05d}.parquet"))
    assert sorted(r["id"] for r in R.read_shards(spark, folder(tmp_path, "shards"), 1, 3, 4).collect()) == [1, 2]
    with pytest.raises(ValueError):
        R.shard_names(3, 5, 4)


def test_general_tokenizer_equals_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    from loomline.operators import tokens as T

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [None, "", "Two words", "é ü 中文\n\tx", "<|endoftext|> stays", "a" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    lib = tokenizers.Tokenizer.from_file(path)
    got = {r["id"]: r["ids"] for r in T.encode_file(df, "id", "text", path, 1).collect()}
    assert got == {i: [*lib.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    special = T.encode_file(df, "id", "text", path, special=True)
    assert {r["id"]: r["ids"] for r in special.collect()} == {i: lib.encode(t or "").ids for i, t in enumerate(texts)}
    assert {r["id"]: r["text"] for r in T.decode_file(special, "id", "ids", path).collect()} == {i: lib.decode(lib.encode(t or "").ids, skip_special_tokens=False) for i, t in enumerate(texts)}


def test_windows_over_texts(spark):
    texts = ["abc", "", None, "defghij", "kl", "mnopqrstuvw"]
    stream = "".join(t or "" for t in texts)
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    blocks = B.pack_text(df, "id", "text", 5, keep_rest=True)
    assert {r["block"]: (r["text"], r["n_docs"]) for r in blocks.collect()} == {0: ("abcde", 2), 1: ("fghij", 1), 2: ("klmno", 2), 3: ("pqrst", 1), 4: ("uvw", 1)}
    windows = spark.createDataFrame([(s,) for s in range(0, len(stream), 4)], "start long")
    got = {r["start"]: r["text"] for r in B.gather(windows, blocks, 5, 9, len(stream), "text").collect()}
    assert got == {s: "".join(stream[(s + k) % len(stream)] for k in range(9)) for s in range(0, len(stream), 4)}
