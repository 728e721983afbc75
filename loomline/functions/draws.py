"""Deterministic random draws: the same for a seed and key in any partitioning and after any retry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw_hash(seed: int | str, key: Column) -> Column:
    """32 hexadecimal digits for a seed and a key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def uniform(seed: int | str, key: Column) -> Column:
    """A double in [0, 1), from the first 32 bits of the hash."""
    return F.conv(F.substring(draw_hash(seed, key), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def sql_uniform(seed: int | str, key: str) -> str:
    """The same in DuckDB."""
    return f"(cast('0x' || substr(md5('{seed}:' || cast({key} AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0)"
