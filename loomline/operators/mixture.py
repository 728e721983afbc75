"""Weighted mixtures of sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.draws import draw_hash, uniform
from .ordering import bounded, hash_bucket


def parse_weights(ratio: str) -> list[float]:
    """'50:25:25' as weights."""
    return [float(x) for x in ratio.split(":")]


def parse_pairs(pairs: Sequence) -> list[tuple[str, float]]:
    """[weight, path, weight, path, ...] as (path, weight)."""
    if len(pairs) % 2:
        raise ValueError("weights and paths must alternate")
    return [(str(pairs[i + 1]), float(pairs[i])) for i in range(0, len(pairs), 2)]


def intervals(sources: DataFrame, source: str, weight: str) -> DataFrame:
    """(source, weight share, lo, hi): cumulative intervals of [0, 1) in order of the source. For a short list of sources."""
    w = W.orderBy(source).rowsBetween(W.unboundedPreceding, 0)
    total = F.sum(weight).over(W.partitionBy())
    share = sources.select(source, (F.col(weight) / total).alias("share"), (F.sum(weight).over(w) / total).alias("hi"))
    return share.withColumn("lo", F.coalesce(F.lag("hi").over(W.orderBy(source)), F.lit(0.0)))


def weighted_draws(spark, sources: DataFrame, source: str, weight: str, n: int, seed: int) -> DataFrame:
    """(draw, source): n draws with replacement. The list of sources is broadcast; more than 100,000 are an error."""
    draws = spark.range(n).select(F.col("id").alias("draw"), uniform(seed, F.col("id")).alias("u"))
    parts = bounded(intervals(sources, source, weight), 100_000, source)
    return draws.join(parts, (F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))).select("draw", source)


def two_level_draws(spark, groups: DataFrame, group: str, weight: str, folders: DataFrame, folder: str, size: str, n: int, seed: int) -> DataFrame:
    """(draw, group, folder): a group by its weight, then one of its folders by size. Groups without folders are an error.

    Both lists are broadcast; more than 100,000 entries are an error.
    """
    if not groups.where(F.col(weight) > 0).join(folders, group, "left_anti").isEmpty():
        raise ValueError("a group has no folders")
    first = weighted_draws(spark, groups, group, weight, n, seed)
    own = W.partitionBy(group).orderBy(folder)
    total = F.sum(F.col(size).cast("double")).over(W.partitionBy(group))
    upper = folders.select(group, folder, (F.sum(F.col(size).cast("double")).over(own.rowsBetween(W.unboundedPreceding, 0)) / total).alias("hi"))
    parts = bounded(upper.withColumn("lo", F.coalesce(F.lag("hi").over(own), F.lit(0.0))), 100_000, folder)
    draws = first.withColumn("u", uniform(seed + 1, F.col("draw")))
    return draws.join(parts, group).where((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))).select("draw", group, folder)


def pick_rows(draws: DataFrame, rows: DataFrame, source: str, key: str, seed: int) -> DataFrame:
    """(draw, source, key): a uniform row of each draw's source. Rows are ranked by a hash, within as many buckets as they ask for."""
    hashed = rows.select(source, key, draw_hash("rows", F.col(key)).alias("__h"))
    hashed = hashed.withColumn("__b", hash_bucket(hashed, "__h"))
    counts = hashed.groupBy(source, "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(W.partitionBy(source).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    ranked = hashed.withColumn("__own", F.row_number().over(W.partitionBy(source, "__b").orderBy("__h", key)) - 1).join(before, [source, "__b"])
    ranked = ranked.select(source, key, (F.col("__before") + F.col("__own")).alias("__rank"))
    sizes = rows.groupBy(source).agg(F.count(F.lit(1)).alias("__size"))
    chosen = draws.join(sizes, source).withColumn("__rank", F.floor(uniform(seed, F.col("draw")) * F.col("__size")))
    return chosen.join(ranked, [source, "__rank"]).select("draw", source, key)


def mixture_report(draws: DataFrame, sources: DataFrame, source: str, weight: str) -> DataFrame:
    """(source, n, used, expected, difference) of realised against expected shares."""
    n = draws.groupBy(source).agg(F.count(F.lit(1)).alias("n"))
    every = W.partitionBy()
    out = sources.join(n, source, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.select(source, "n", (F.col("n") / F.sum("n").over(every)).alias("used"), (F.col(weight) / F.sum(weight).over(every)).alias("expected")).withColumn("difference", F.col("used") - F.col("expected"))
