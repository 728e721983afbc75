"""Readers of corpora: shard ranges, prefixed folders, texts, lists, weighted sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shard_names(start: int, end: int, total: int, pattern: str = "{:03d}_{:05d}.parquet") -> list[str]:
    """Names of shards start to end - 1 of a corpus of `total` shards."""
    if not 0 <= start < end <= total:
        raise ValueError(f"shards {start} to {end} don't lie within 0 to {total}")
    return [pattern.format(0, i) for i in range(start, end)]


def shard_range(path: str, ranges: dict[str, tuple[int, int]], pattern: str = "{:03d}_{:05d}.parquet", group: int = 10) -> list[str]:
    """Names of the shards that an output path's ending stands for, `group` shards to a group; another ending is an error."""
    for ending, (start, end) in ranges.items():
        if path.endswith(ending):
            return [pattern.format(i // group, i % group) for i in range(start, end)]
    raise ValueError(f"the ending of {path} says no range of shards")


def limit_files(names: Sequence[str], most: int | None) -> list[str]:
    """The first `most` names in order, or all."""
    return sorted(names)[: len(names) if most is None else most]


def read_shards(spark: SparkSession, folder: str, start: int, end: int, total: int, pattern: str = "{:03d}_{:05d}.parquet") -> DataFrame:
    return spark.read.parquet(*[f"{folder}/{n}" for n in shard_names(start, end, total, pattern)])


def read_prefix(spark: SparkSession, root: str, prefix: str, fmt: str = "parquet") -> DataFrame:
    """Every folder under root whose name starts with the prefix, with the folder's name in `source`."""
    rows = spark.read.format(fmt).load(f"{root}/{prefix}*")
    return rows.withColumn("source", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))


def folder_sizes(spark: SparkSession, root: str, prefix: str = "") -> DataFrame:
    """(folder, bytes) of the folders under root whose names start with the prefix, from the file system's listing alone."""
    files = spark.read.format("binaryFile").load(f"{root}/{prefix}*").select("path", "length")
    return files.groupBy(F.element_at(F.split("path", "/"), -2).alias("folder")).agg(F.sum("length").alias("bytes"))


def read_subsets(spark: SparkSession, root: str, names: Sequence[str] | None = None, fmt: str = "json") -> DataFrame:
    """Named subsets under root, or all that lie there, as one table, columns by name."""
    from .sinks import folders

    names = folders(spark, root) if names is None else names
    out = None
    for n in names:
        part = spark.read.format(fmt).load(f"{root}/{n}").withColumn("subset", F.lit(n))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no subset is named")
    return out


def read_ordered(spark: SparkSession, path: str) -> DataFrame:
    """Parquet rows with the order of files and of rows in them: (.., file, row)."""
    return spark.read.parquet(path).select("*", F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"), F.col("_metadata.row_index").alias("row"))


def whole_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def line_list(spark: SparkSession, path: str) -> DataFrame:
    """Lines without white space at their ends; empty ones are left out."""
    return spark.read.text(path).select(F.regexp_replace("value", r"^\s+|\s+$", "").alias("line")).where("line <> ''")


def existing(sources: DataFrame, listing: DataFrame, path: str) -> DataFrame:
    """The sources whose path is in a listing."""
    return sources.join(listing.select(path).distinct(), path, "left_semi")


def weighted_sources(spark: SparkSession, text: str) -> DataFrame:
    """(position, path, weight) of a YAML list that alternates weights and paths; '#' begins a comment."""
    items = [x.split("#")[0].strip() for x in text.splitlines()]
    items = [x.removeprefix("- ").strip().strip("\"'") for x in items if x.startswith("- ")]
    if len(items) % 2:
        raise ValueError("weights and paths must alternate")
    rows = [(i // 2, items[i + 1], float(items[i])) for i in range(0, len(items), 2)]
    return spark.createDataFrame(rows, "position int, path string, weight double")


def token_column(df: DataFrame) -> str:
    """The column that a preview shows: tokens, input_ids, text, or the first whose name holds token or id."""
    for name in ("tokens", "input_ids", "text"):
        if name in df.columns:
            return name
    for name in df.columns:
        if "token" in name.lower() or "id" in name.lower():
            return name
    raise ValueError("no column holds tokens or text")
