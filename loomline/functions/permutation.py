"""A seeded permutation of 0 .. n - 1 in closed form, both ways: a shuffle that needs no sort.

Numbers below the next power of two are split into two halves, each in turn xored with a function of the other half and
a round's key (a Feistel network), which can be undone round by round. A number that lands at n or above is sent through
again until it lands below n. As n is more than half of the power of two, each pass ends the walk with a chance of more
than a half.
"""

from __future__ import annotations

import functools
import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS = 8
#: The modulus of a round's function, and the passes after which a walk is given up with an error.
PRIME, PASSES = 2147483647, 64


def _layout(n: int, seed: int) -> tuple[int, int, list[int]]:
    """Bits of the upper and of the lower half, and the keys of the rounds."""
    if not 0 < n <= 1 << 60:
        raise ValueError(f"no permutation of {n} numbers")
    bits = max(2, (n - 1).bit_length())
    keys = [int.from_bytes(hashlib.md5(f"{seed}:{r}".encode()).digest()[:3], "big") for r in range(ROUNDS)]
    return bits - bits // 2, bits // 2, keys


def _rounds(n: int, seed: int, inverse: bool) -> tuple[int, int, list[tuple[int, int]]]:
    high, low, keys = _layout(n, seed)
    order = list(enumerate(keys))
    return high, low, order[::-1] if inverse else order


def permute_number(x: int, n: int, seed: int, inverse: bool = False) -> int:
    """The same for one Python number."""
    if n == 1:
        return x
    high, low, rounds = _rounds(n, seed, inverse)
    while True:
        a, b = x >> low, x & ((1 << low) - 1)
        for r, k in rounds:
            if r % 2:
                b ^= (a + k) * (a + k) % PRIME % (1 << low)
            else:
                a ^= (b + k) * (b + k) % PRIME % (1 << high)
        x = a << low | b
        if x < n:
            return x


def permuted(x: Column, n: int, seed: int, inverse: bool = False) -> Column:
    """The place of number x (0 <= x < n) in the shuffle; with inverse, the number at place x."""
    if n == 1:
        return x.cast("bigint")
    high, low, rounds = _rounds(n, seed, inverse)

    def bind(value: Column, of) -> Column:
        """of(value), with the value made once."""
        return F.get(F.transform(F.array(value), of), F.lit(0))

    def one(step: tuple[int, int], state: Column) -> Column:
        r, k = step
        a, b = state["a"], state["b"]
        mixed = lambda h, bits: ((h + k) * (h + k) % PRIME) % (1 << bits)
        if r % 2:
            b = b.bitwiseXOR(mixed(a, low))
        else:
            a = a.bitwiseXOR(mixed(b, high))
        return F.struct(a.alias("a"), b.alias("b"))

    def through(value: Column) -> Column:
        state = F.struct(F.shiftright(value, low).alias("a"), value.bitwiseAND(F.lit((1 << low) - 1).cast("bigint")).alias("b"))
        for step in rounds:
            state = bind(state, functools.partial(one, step))
        return bind(state, lambda s: F.shiftleft(s["a"], low).bitwiseOR(s["b"]))

    walk = F.aggregate(F.sequence(F.lit(2), F.lit(PASSES)), through(x.cast("bigint")), lambda v, _: F.when(v < n, v).otherwise(through(v)))
    return bind(walk, lambda v: F.when(v < n, v).otherwise(F.raise_error(F.lit("a number didn't land"))))


def sql_walk(n: str, seed: int) -> str:
    """CTEs `g` and `walk` of a recursive DuckDB query, one round a step: rows of `walk` that `sql_landed` picks hold each
    number and, as a and b, its place. n is a query of the count."""
    keys = _layout(4, seed)[2]
    mixed = "(({h} + k[r % 8 + 1]) * ({h} + k[r % 8 + 1]) % {p}) % (1::BIGINT << {bits})"
    upper, lower = (mixed.format(h=h, p=PRIME, bits=bits) for h, bits in (("b", "high"), ("a", "low")))
    return f"""g AS (SELECT n, bits // 2 AS low, bits - bits // 2 AS high, {keys} AS k FROM (SELECT n, greatest(2, length(ltrim(bin(n - 1), '0'))) AS bits FROM ({n}) q)),
walk AS (SELECT i::BIGINT AS number, i::BIGINT >> low AS a, i::BIGINT & ((1::BIGINT << low) - 1) AS b, 0 AS r FROM range((SELECT n FROM g)) t(i), g
         UNION ALL SELECT number, CASE WHEN r % 2 = 0 THEN xor(a, {upper}) ELSE a END, CASE WHEN r % 2 = 1 THEN xor(b, {lower}) ELSE b END, r + 1
         FROM walk, g WHERE r % 8 <> 0 OR r = 0 OR (a << low | b) >= g.n)"""


sql_landed = "r > 0 AND r % 8 = 0 AND (a << low | b) < g.n"
