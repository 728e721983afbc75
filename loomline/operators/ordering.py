"""Global ranks and prefix sums without a single-partition window: totals of buckets first, then ranks inside each.

Buckets are ranges of the order's keys between sampled splitters, or the first digits of a hash, as many as the rows ask
for: however the keys are spread, no bucket is much larger than the others. Null keys come last.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

#: Rows of a bucket, about; buckets at most (their splitters are a literal of the plan); sampled keys for each bucket.
ROWS, MOST_BUCKETS, SAMPLED = 4096, 1 << 14, 16


def _key(order: Sequence[str]) -> Column:
    """The order's columns as one value whose nulls come last."""
    return F.struct(*[x for i, c in enumerate(order) for x in (F.isnull(c).alias(f"n{i}"), F.col(c).alias(f"c{i}"))])


def _sorting(order: Sequence[str]) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in order]


def splitters(df: DataFrame, order: Sequence[str], rows: int = ROWS, most: int = MOST_BUCKETS) -> list[str]:
    """Keys, as JSON, that cut the rows into ranges of about `rows` rows each, from a random sample of at most about
    `SAMPLED * most` keys. The sample moves the cuts, never a result."""
    keys = df.select(*order)
    n = keys.count()
    buckets = min(most, -(-n // rows))
    if buckets < 2:
        return []
    share = SAMPLED * buckets / n
    sample = keys.where(F.rand(1) < share) if share < 1 else keys
    found = sample.orderBy(*_sorting(order)).select(F.to_json(_key(order)).alias("key")).toArrow().column("key").to_pylist()
    return list(dict.fromkeys(found[len(found) * i // buckets] for i in range(1, buckets))) if found else []


def range_bucket(df: DataFrame, order: Sequence[str], rows: int = ROWS, most: int = MOST_BUCKETS) -> Column:
    """The number of a row's range along the order, never null: by bisection, as many steps as the cuts have binary digits."""
    cuts = splitters(df, order, rows, most)
    if not cuts:
        return F.lit(0)
    table = F.from_json(F.lit(f"[{','.join(cuts)}]"), ArrayType(df.select(_key(order).alias("key")).schema["key"].dataType))  # folded into the plan
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(cuts).bit_length()))])

    def place(key: Column) -> Column:
        return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(table, at + step - 1) <= key, at + step).otherwise(at))

    return F.get(F.transform(F.array(_key(order)), place), F.lit(0))  # the key is made once


def hash_bucket(df: DataFrame, column: str, rows: int = ROWS) -> Column:
    """The first hexadecimal digits of a hash, as many as leave about `rows` rows in a bucket; null hashes after them."""
    digits, n = 1, df.count()
    while n > rows * 16**digits and digits < 8:
        digits += 1
    return F.coalesce(F.substring(column, 1, digits), F.lit("g"))


def running_sum(df: DataFrame, order: Sequence[str], value: Column, name: str, bucket: Column | None = None) -> DataFrame:
    """Adds the sum of value over all rows before a row; null keys come last, null values add nothing.

    bucket must not fall along the order; its nulls come last too. Without one, the rows are cut at sampled splitters.
    The table of buckets alone passes through one task.
    """
    rows = df.withColumns({"__bucket": range_bucket(df, order) if bucket is None else bucket, "__value": value.cast("bigint")})
    totals = rows.groupBy(F.col("__bucket").alias("__of")).agg(F.sum("__value").alias("__total"))
    before = totals.select("__of", F.coalesce(F.sum("__total").over(W.orderBy(F.col("__of").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    within = F.coalesce(F.sum("__value").over(W.partitionBy("__bucket").orderBy(*_sorting(order)).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # one row for some thousands of rows: broadcast, or the rows would move a second time for the join
    met = rows.withColumn("__within", within).join(F.broadcast(before), F.col("__bucket").eqNullSafe(F.col("__of")))
    return met.withColumn(name, F.col("__base") + F.col("__within")).drop("__bucket", "__of", "__value", "__within", "__base")


def bounded(df: DataFrame, most: int, what: str) -> DataFrame:
    """df, marked for a broadcast; more than `most` rows are an error."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"{what} has more than {most} rows")
    return F.broadcast(df)


def rank(df: DataFrame, order: Sequence[str], name: str = "rank", bucket: Column | None = None) -> DataFrame:
    """Adds the number of rows before a row in the order."""
    return running_sum(df, order, F.lit(1), name, bucket)
