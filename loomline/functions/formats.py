"""Text for people: counts, durations, clipped previews."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tick(x: Column) -> Column:
    """1500000000 as 1.5B, 2000000 as 2M, 1000 as 1K; smaller numbers as they are."""

    def scaled(by: float, unit: str) -> Column:
        tenths = F.round(x / F.lit(by) * 10).cast("bigint")
        whole, rest = (tenths / 10).cast("bigint"), tenths % 10
        return F.concat(whole.cast("string"), F.when(rest == 0, "").otherwise(F.concat(F.lit("."), rest.cast("string"))), F.lit(unit))

    return F.when(x >= 1e9, scaled(1e9, "B")).when(x >= 1e6, scaled(1e6, "M")).when(x >= 1e3, scaled(1e3, "K")).otherwise(x.cast("bigint").cast("string"))


UNITS = (("D", 86_400_000), ("h", 3_600_000), ("m", 60_000), ("s", 1000), ("ms", 1))


def duration(milliseconds: Column) -> Column:
    """The two most significant units of a duration, such as 1h1m; 0ms for none."""
    parts = []
    left = milliseconds
    for unit, size in UNITS:
        n = F.floor(left / size)
        parts.append(F.when(n > 0, F.concat(n.cast("string"), F.lit(unit))))
        left = left - n * size
    kept = F.slice(F.filter(F.array(*parts), lambda p: p.isNotNull()), 1, 2)
    return F.when(F.size(kept) == 0, F.lit("0ms")).otherwise(F.array_join(kept, ""))


def clip(text: Column, keep: int) -> Column:
    """Head and tail of `keep` characters each, with the number left out between; short texts whole."""
    n = F.length(text)
    return F.when(n > 2 * keep, F.concat(F.substring(text, 1, keep), F.lit(" ... ["), (n - 2 * keep).cast("string"), F.lit(" omitted] ... "), F.right(text, F.lit(keep)))).otherwise(text)


def flat_line(text: Column, keep: int | None = 20) -> Column:
    """Newlines escaped, then cut to `keep` characters, or whole for None."""
    line = F.replace(text, F.lit("\n"), F.lit("\\n"))
    return line if keep is None else F.substring(line, 1, keep)


def choice_letter(index: Column) -> Column:
    """0 as (A), 3 as (D)."""
    return F.concat(F.lit("("), F.char(index + 65), F.lit(")"))
