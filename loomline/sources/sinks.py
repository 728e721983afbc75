"""Sinks beside token files: lines, metrics, vocabularies, and splits that a corpus brings along."""

from __future__ import annotations

import ast

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def escaped(text: Column) -> Column:
    """Text in one line: backslash, newline and carriage return as two characters each."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(out, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))


def unescaped(line: Column) -> Column:
    """The text that escaped() made a line of."""
    parts = F.transform(F.split(line, r"\\\\", -1), lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r")))
    return F.array_join(parts, "\\")


def write_lines(df: DataFrame, text: str, path: str) -> None:
    """One record a line; nulls as empty lines."""
    df.select(F.coalesce(escaped(F.col(text)), F.lit("")).alias("value")).write.text(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(unescaped(F.col("value")).alias("text"))


def append_metrics(rows: DataFrame, folder: str, step: int) -> None:
    """Appends (name, value) rows with their step to a log of metrics, under the number of the append. One writer at a time."""
    spark = rows.sparkSession
    number = (spark.read.parquet(folder).agg(F.max("number")).first()[0] or 0) + 1 if _exists(spark, folder) else 1
    out = rows.select("name", F.col("value").cast("string").alias("value"), F.lit(step).cast("bigint").alias("step"), F.lit(number).cast("bigint").alias("number"))
    out.write.mode("append").parquet(folder)


def read_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """(name, step, value), the last write of a name and step; values that are no numbers are null."""
    return spark.read.parquet(folder).groupBy("name", "step").agg(F.max_by("value", "number").cast("double").alias("value"))


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def folders(spark: SparkSession, root: str) -> list[str]:
    """Names of the folders and files under root, in order; hidden ones are left out."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    names = [s.getPath().getName() for s in place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(place)]
    return sorted(n for n in names if not n.startswith((".", "_")))


def write_vocabulary(vocab: DataFrame, folder: str) -> None:
    """(ch, id) beside a corpus."""
    vocab.select("ch", F.col("id").cast("int").alias("id")).coalesce(1).write.parquet(f"{folder}/vocabulary")


def vocabulary_size(spark: SparkSession, folder: str, default: int | None = None) -> int | None:
    """The size of the vocabulary beside a corpus, or the default if it has none."""
    if not _exists(spark, f"{folder}/vocabulary"):
        return default
    most = spark.read.parquet(f"{folder}/vocabulary").agg(F.max("id")).first()[0]
    return 0 if most is None else most + 1


def splits_of(spark: SparkSession, root: str, make, names: tuple[str, ...] = ("val", "validation")) -> dict[str, DataFrame]:
    """The splits of a corpus: its own folders `train` and one of `names`, or what make(rows of train) splits it into."""
    train = spark.read.parquet(f"{root}/train")
    for name in names:
        if _exists(spark, f"{root}/{name}"):
            return {"train": train, "val": spark.read.parquet(f"{root}/{name}")}
    return make(train)


def scrape_literal(lines: DataFrame, order: str, line: str, marker: str) -> dict | None:
    """The dictionary after the last marker of the first line that holds it; none if no line does."""
    found = lines.where(F.contains(line, F.lit(marker))).agg(F.min_by(line, order)).first()[0]
    return None if found is None else ast.literal_eval(found.rsplit(marker, 1)[1].strip())


def scrape_suffix(lines: DataFrame, order: str, line: str, holds: str, marker: str) -> str | None:
    """What follows the last marker of the first line that holds both strings, such as a run's id after /runs/."""
    found = lines.where(F.contains(line, F.lit(holds)) & F.contains(line, F.lit(marker))).agg(F.min_by(line, order)).first()[0]
    return None if found is None else found.rsplit(marker, 1)[1].strip()
