import os
import subprocess
import sys
import textwrap

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from loomline.operators import blocks as B
from loomline.operators import evaluation as E
from loomline.operators import mixture as M
from loomline.operators import scoring as S
from loomline.sources import sinks as K
from loomline.sources import tokenfiles as T
from loomline.sources import tokensource as W

NAMES = ["metric_log", "collate_pad", "flat_bare", "flat_ends", "indexed_pair", "indexed_batch", "multiple_choice_rows", "store_in_order", "ensemble_padded", "two_level_files"]


@pytest.mark.parametrize("name", NAMES)
def test_queries_equal_their_sql(spark, sf, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "orders", "part"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = entry.queries()[name](spark, sf).toPandas()
    want = c.execute(entry.oracle_sql()[name]).df()[list(got.columns)]
    key = lambda t: sorted(map(tuple, t.astype(str).values.tolist()))
    assert key(got) == key(want)


def test_the_last_write_counts(spark, tmp_path):
    folder = f"file://{tmp_path}/m"
    for value in (9, 10, 2):
        K.append_metrics(spark.createDataFrame([("loss", value)], "name string, value long"), folder, 1)
        assert [tuple(r) for r in K.read_metrics(spark, folder).collect()] == [("loss", 1, float(value))]


def test_collation_cuts_nothing(spark):
    df = spark.createDataFrame([(1, [1, 2, 3]), (2, [4]), (3, None), (4, [5] * 20)], "k long, ids array<int>")
    got = {r["k"]: (r["ids"], r["mask"]) for r in B.collate(df, "k", "ids", 2, 0).collect()}
    assert got == {1: ([1, 2, 3], [1, 1, 1]), 2: ([4, 0, 0], [1, 0, 0]), 3: ([0] * 20, [0] * 20), 4: ([5] * 20, [1] * 20)}


def test_distractors_follow_frequencies(spark):
    """Values of 900, 90 and 10 rows and a hundred single ones; each question's are different and none is its truth."""
    rows = spark.range(1100).select(F.when(F.col("id") < 900, "a").when(F.col("id") < 990, "b").when(F.col("id") < 1000, "c").otherwise(F.concat(F.lit("s"), F.col("id"))).alias("v"))
    asked = spark.range(400).select(F.col("id").alias("q"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("t"))
    got = E.distractors(asked, "q", "t", rows.unionByName(spark.createDataFrame([(None,)], "v string")), "v").collect()
    assert len(got) == 400 and all(len(set(r["others"])) == 3 and r["t"] not in r["others"] for r in got)
    first = [r["others"][0] for r in got if r["t"] == "b"]
    assert 0.8 < first.count("a") / len(first) < 0.97
    with pytest.raises(ValueError):
        E.distractors(asked, "q", "t", rows.where("v IN ('a', 'b', 'c')"), "v")


def test_padded_ensemble(spark):
    one = spark.createDataFrame([(1, [(5, 0.5), (6, 0.25)], [6, 9, 5, 7], 3)], "k long, topk array<struct<idx:int,prob:double>>, own array<int>, y int")
    two = spark.createDataFrame([(1, [(5, 0.25)])], "k long, topk array<struct<idx:int,prob:double>>")
    r = S.ensemble([one, two], ["k"], 3, "own", ("y",)).first()
    assert [(e["idx"], round(e["prob"], 6)) for e in r["topk"]] == [(5, 0.75), (6, 0.25), (9, 0.0)] and r["y"] == 3
    assert [e["idx"] for e in S.ensemble([one, two], ["k"], 9, "own").first()["topk"]] == [5, 6, 9, 7]


def test_two_levels_need_folders(spark):
    groups = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "g string, w double")
    folders = spark.createDataFrame([("a", "a1", 1), ("a", "a2", 3)], "g string, f string, size long")
    with pytest.raises(ValueError):
        M.two_level_draws(spark, groups, "g", "w", folders, "f", "size", 10, 1)
    counts = {r["f"]: r["count"] for r in M.two_level_draws(spark, groups.where("g = 'a'"), "g", "w", folders, "f", "size", 4000, 1).groupBy("f").count().collect()}
    assert abs(counts["a2"] / 4000 - 0.75) < 0.03


def blocks(spark, n, block):
    ids = np.arange(n) % 60_000
    parts = [(i // block, bytearray(ids[i : i + block].astype("<u2").tobytes())) for i in range(0, n, block)]
    return spark.createDataFrame(parts, "block long, data binary")


def test_flat_file_of_many_tasks(spark, tmp_path):
    path = f"file://{tmp_path}/out/t.bin"
    assert W.write_bin(blocks(spark, 10_007, 100).repartition(7), path, 100, 2) == 10_007
    got = [x for r in T.read_bin(spark, path, "uint16", 999).orderBy("pos").collect() for x in r["ids"]]
    assert got == (np.arange(10_007) % 60_000).tolist()
    assert os.listdir(tmp_path / "out") == ["t.bin"]
    with pytest.raises(ValueError):
        W.write_bin(blocks(spark, 1000, 100).where("block <> 3"), f"file://{tmp_path}/holes.bin", 100, 2)
    assert W.write_bin(blocks(spark, 100, 100).limit(0), f"file://{tmp_path}/none.bin", 100, 2) == 0
    with pytest.raises(ValueError):
        W.local_path("s3://bucket/x.bin")


def test_writer_keeps_to_what_counts(tmp_path):
    import pyarrow as pa

    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.binary())], ["block", "data"])
    w = W.FlatWriter(f"{tmp_path}/x.bin", "t", 4, 10)
    w.allocate()
    w.write(iter([batch([(0, b"dead")])]))  # an attempt that is lost
    done = [w.write(iter([batch([(0, b"abcd"), (2, b"ij")])])), None, w.write(iter([batch([(1, b"efgh")])]))]
    w.commit(done)
    assert (tmp_path / "x.bin").read_bytes() == b"abcdefghij"
    w.allocate()
    with pytest.raises(ValueError):
        w.commit(done[:1])
    assert os.listdir(tmp_path) == ["x.bin"]


def test_a_task_that_is_retried(tmp_path):
    """The first attempt at every partition fails after it has written some blocks."""
    code = f"""
    from pyspark import TaskContext
    from pyspark.sql import SparkSession
    from loomline.sources import tokensource as W
    spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.sql.execution.arrow.maxRecordsPerBatch", "3").getOrCreate()
    def rows(batches):
        import pyarrow as pa
        for b in batches:
            ids = b.column(0).to_pylist()
            if TaskContext.get().attemptNumber() == 0 and max(ids) % 25 > 12 and "counted" not in __import__("os").environ:
                raise RuntimeError("lost")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([bytes([i % 251]) * 8 for i in ids], pa.binary())], ["block", "data"])
    made = spark.range(0, 100, 1, 4).withColumnRenamed("id", "block").mapInArrow(rows, "block long, data binary")
    print("IDS", W.write_bin(made, "file://{tmp_path}/r.bin", 4, 2))
    """
    env = os.environ | {"PYTHONPATH": os.path.dirname(os.path.dirname(os.path.abspath(__file__)))}
    out = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], env=env, capture_output=True, text=True, timeout=300)
    assert "IDS 400" in out.stdout, out.stderr[-2000:]
    assert (tmp_path / "r.bin").read_bytes() == b"".join(bytes([i % 251]) * 8 for i in range(100))


def test_indexed_reads_touch_their_range_alone(spark, tmp_path):
    folder = f"file://{tmp_path}/pair"
    df = spark.range(100).select("id", F.transform(F.sequence(F.lit(1), F.col("id") % 7 + 1), lambda x: x * 10).alias("ids"))
    name = T.write_indexed(df, "id", "ids", folder, parts=1).first()["name"]
    prefix = f"{folder}/{name}"
    assert W.read_samples(spark, prefix, per=10).count() == 100
    one, some = W.read_samples(spark, prefix, 13, 14, 10), W.read_samples(spark, prefix, 20, 50, 10)
    assert one.collect()[0]["ids"] == [10 * x for x in range(1, 13 % 7 + 2)] and one.rdd.getNumPartitions() == 1
    assert some.rdd.getNumPartitions() == 3
    assert [r["sample"] for r in one.unionByName(some).orderBy("sample").collect()] == [13, *range(20, 50)]
    assert [(p.first, p.last) for p in W.PairReader(prefix, 10, 95, 400).partitions()] == [(95, 100)]
    assert W.read_samples(spark, prefix, 100, 200).count() == 0
