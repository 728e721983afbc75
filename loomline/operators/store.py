"""Top-k probability stores: written by step and rank, loaded by step, sampled, halved, padded and combined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.draws import uniform

#: A store's columns: (step, rank) name a file, `row` and `t` a position in it; x and y are its token and target.
COLUMNS = ("step", "rank", "row", "t", "x", "y", "topk")


def write_store(rows: DataFrame, folder: str) -> None:
    """Rows of COLUMNS as Parquet folders by step and rank; probabilities as 32-bit floats, indices as 32-bit integers."""
    small = F.transform("topk", lambda e: F.struct(e["idx"].cast("int").alias("idx"), e["prob"].cast("float").alias("prob")))
    rows.select(*COLUMNS[:-1], small.alias("topk")).repartition("step", "rank").sortWithinPartitions("step", "rank", "row", "t").write.partitionBy("step", "rank").parquet(folder)


def read_store(spark: SparkSession, folder: str) -> DataFrame:
    """The whole store; a filter on step and rank reads their folders alone."""
    return spark.read.parquet(folder).select(*[F.col(c).cast("bigint") for c in COLUMNS[:-1]], "topk")


def latest(store: DataFrame) -> DataFrame:
    """(step, rank, token): the largest of each, in one row."""
    return store.agg(F.max("step").alias("step"), F.max("rank").alias("rank"), F.max(F.array_max(F.transform("topk", lambda e: e["idx"]))).cast("bigint").alias("token"))


def load_step(store: DataFrame, counter: int, rank: int, batch: int, seed: int) -> DataFrame:
    """(draw, ..): `batch` rows of the file that a counter and a rank lead to, round the ends of both.

    A file of more rows is sampled with replacement, one of fewer is an error.
    """
    last = store.agg(F.max("step"), F.max("rank")).first()
    part = store.where((F.col("step") == counter % (last[0] + 1)) & (F.col("rank") == rank % (last[1] + 1)))
    n = part.agg(F.count_distinct("row")).first()[0]
    if n < batch:
        raise ValueError(f"the file has {n} rows, fewer than a batch of {batch}")
    if n == batch:
        return part.withColumn("draw", F.col("row"))
    draws = store.sparkSession.range(batch).select(F.col("id").alias("draw"), F.floor(uniform(seed, F.col("id")) * n).alias("row"))
    return draws.join(part, "row")


def halves(store: DataFrame) -> DataFrame:
    """The store at twice the steps: a file's first half of rows belongs to the even step, its second half to the odd one."""
    sizes = store.groupBy("step", "rank").agg(F.count_distinct("row").alias("__n"))
    rows = store.join(sizes, ["step", "rank"])
    second = F.col("row") >= F.floor(F.col("__n") / 2)
    return rows.withColumn("step", F.col("step") * 2 + second.cast("bigint")).drop("__n")


def file_order(files: DataFrame, name: str) -> DataFrame:
    """Adds step, rank, ts and place: the place of a store's file in order of its step, its time and its name."""
    from pyspark.sql import Window as W

    part = lambda p: F.regexp_extract(name, p, 1).cast("bigint")
    rows = files.withColumns({"step": part(r"step(\d+)"), "rank": part(r"rank(\d+)"), "ts": part(r"_(\d+)\.npz$")})
    # files of a store, not rows of a corpus: their list passes through one task
    return rows.withColumn("place", (F.row_number().over(W.orderBy("step", "ts", name)) - 1).cast("bigint"))


def write_named(rows: DataFrame, folder: str, name: str) -> None:
    """Rows of COLUMNS under the names of their files, in order of row and position."""
    rows.repartition(name).sortWithinPartitions(name, "row", "t").write.partitionBy(name).parquet(folder)


def load_in_order(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The whole store with `sample`, each row's number in the order of files (step, time, name) and of rows in them.

    Files are counted where they lie; their list, one row a file, is broadcast, and more than a million are an error.
    """
    from pyspark.sql import Window as W

    from .ordering import bounded

    rows = spark.read.parquet(folder).withColumns({"__path": F.col("_metadata.file_path"), "__row": F.col("_metadata.row_index")})
    files = file_order(rows.groupBy(name, "__path").agg(F.count(F.lit(1)).alias("__n")), name)
    before = F.coalesce(F.sum("__n").over(W.orderBy("place", "__path").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bases = bounded(files.select(F.col("__path").alias("__of"), before.alias("__base")), 1_000_000, "the list of files")
    return rows.join(bases, F.col("__path") == F.col("__of")).withColumn("sample", F.col("__base") + F.col("__row")).drop("__path", "__row", "__of", "__base")


def pad_topk(topk: Column, fallback: Column, k: int) -> Column:
    """A list of (idx, prob) filled up to k entries with fallback indices that it doesn't hold, at probability 0."""
    chosen = F.transform(topk, lambda e: e["idx"])
    unused = F.slice(F.array_except(fallback, chosen), 1, k)
    entries = F.transform(topk, lambda e: F.struct(e["idx"].alias("idx"), e["prob"].alias("prob")))
    return F.slice(F.concat(entries, F.transform(unused, lambda i: F.struct(i.alias("idx"), F.lit(0.0).alias("prob")))), 1, k)
