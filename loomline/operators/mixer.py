"""The packing mixer: weighted draws of rows from several sources, an end id after each, packed into sequences of fixed
length until so many are full. What a sequence has no room for begins the next one.

Draws are numbered, and what a number draws depends on the seed and the number alone, so that any task can make any of
them. Draws are made in growing rounds, of which only lengths are looked at, until their sum fills the sequences; then
lengths give each draw its place by prefix sums, and only the drawn rows' bytes move, cut at the sequences' borders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.draws import uniform
from ..sources.workspace import stored
from .mixture import intervals
from .ordering import bounded, rank, running_sum
from .packed import met_blocks, pieces, size

#: Sources of a mixture at most: their list is broadcast.
MOST_SOURCES = 100_000


def numbered_rows(rows: DataFrame, source: str, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows with `place`, their number in order of source and key; (source, first, rows) of each source). The rows are
    placed once and written: the draws read their lengths alone."""
    placed = stored(rank(rows, [source, key], "place"), "placed")
    return placed, placed.groupBy(source).agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("rows"))


def drawn(spark, low: int, high: int, sources: DataFrame, source: str, seed: int) -> DataFrame:
    """(draw, source, place): draws low to high - 1. sources is (source, lo, hi, first, rows), broadcast by the caller."""
    draws = spark.range(low, high).select(F.col("id").alias("draw"), uniform(seed, F.col("id")).alias("u"), uniform(seed + 1, F.col("id")).alias("v"))
    met = draws.join(sources, (F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi")))
    return met.select("draw", source, (F.col("first") + F.floor(F.col("v") * F.col("rows"))).alias("place"))


def mix(rows: DataFrame, source: str, key: str, data: str, weights: DataFrame, weight: str, sequences: int, length: int, end: bytes, seed: int) -> tuple[DataFrame, DataFrame]:
    """(draws, packed): draws is (draw, source, place, start, n); packed is (block, data, n_docs) of `sequences` full
    sequences of `length` ids, the first of block 0.

    rows holds packed ids in `data`, of as many bytes an id as `end`, the id after every draw; null data counts as empty.
    weights is (source, weight); sources without rows or weight are never drawn, and no source at all is an error.
    """
    spark, width = rows.sparkSession, len(end)
    ended = rows.select(source, key, F.concat(F.coalesce(F.col(data), F.lit(b"")), F.lit(end)).alias("__data"))
    placed, counted = numbered_rows(ended.withColumn("n", size("__data", width)), source, key)
    kept = weights.where(F.col(weight) > 0).join(counted, source)
    parts = bounded(intervals(kept, source, weight).join(counted, source), MOST_SOURCES, source)
    thin = placed.select("place", "n")
    total = sequences * length
    mean = thin.agg(F.avg("n")).first()[0]
    if mean is None or kept.isEmpty():
        raise ValueError("there is nothing to draw from")
    many = int(total / mean * 1.05) + 16
    while True:
        draws = drawn(spark, 0, many, parts, source, seed).join(thin, "place")
        found = draws.agg(F.sum("n")).first()[0] or 0
        if found >= total:
            break
        many = max(many + 16, int(many * min(8, 1.1 * total / max(found, 1))))
    # numbers of draws are dense, so they need no splitters
    draws = running_sum(draws, ["draw"], F.col("n"), "start", F.floor(F.col("draw") / 4096)).where(F.col("start") < total)
    draws = draws.select("draw", source, "place", "start", "n")
    met = draws.select("place", "start", "n").join(placed.select("place", "__data"), "place")
    return draws, met_blocks(pieces(met, "__data", "start", "n", length, width, total), length, width)


def marks(sequences: int, every: int = 100):
    """Whether a document of the index ends after a sequence: after every `every` of them and after the last."""
    return ((F.col("block") + 1) % every == 0) | (F.col("block") == sequences - 1)


def usage(draws: DataFrame, weights: DataFrame, source: str, weight: str) -> DataFrame:
    """(source, n, used, expected, difference): shares of the draws that were used, against the weights."""
    from .mixture import mixture_report

    return mixture_report(draws, weights, source, weight)
