"""Corpus preparation: filters, splits, vocabularies, token streams, shards and reports."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.draws import draw_hash, uniform
from .ordering import hash_bucket, rank, running_sum
from .tokens import slices


def contains_any(column: str, words: Sequence[str]) -> Column:
    """Whether a string contains any of the words: a chain of ORs, which reaches the scan."""
    return reduce(lambda a, b: a | b, [F.contains(F.col(column), F.lit(w)) for w in words])


def exact_split(df: DataFrame, key: str, fraction: float, seed: int = 2357, names: tuple[str, str] = ("train", "val")) -> DataFrame:
    """Adds `split`: exactly ceil(fraction * n) rows, in the order of a seeded hash, get the second name."""
    hashed = df.withColumn("__hash", draw_hash(seed, F.col(key)))
    ranked = rank(hashed, ["__hash", key], "__rank", hash_bucket(hashed, "__hash"))
    return _with_count(ranked, lambda n: F.when(F.col("__rank") < F.ceil(n * F.lit(fraction)), names[1]).otherwise(names[0]), "split").drop("__hash", "__rank")


def tail_split(df: DataFrame, key: str, fraction: float, names: tuple[str, str] = ("train", "test")) -> DataFrame:
    """Adds `split`: the last ceil(fraction * n) rows by key get the second name."""
    ranked = rank(df, [key], "__rank")
    return _with_count(ranked, lambda n: F.when(F.col("__rank") >= n - F.ceil(n * F.lit(fraction)), names[1]).otherwise(names[0]), "split").drop("__rank")


def _with_count(df: DataFrame, of, name: str) -> DataFrame:
    """Adds a column made from the number of rows; the one-row count is broadcast."""
    n = df.agg(F.count(F.lit(1)).alias("__n"))
    return df.join(F.broadcast(n)).withColumn(name, of(F.col("__n"))).drop("__n")


def bernoulli(df: DataFrame, key: str, p: float, seed: int = 1) -> DataFrame:
    return df.where(uniform(seed, F.col(key)) < p)


def shuffled_head(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """The first n rows in the order of a seeded hash."""
    return df.withColumn("__hash", draw_hash(seed, F.col(key))).orderBy("__hash", key).limit(n).drop("__hash")


def characters(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """(.., ch): every character of every text, beside the columns to keep. Aggregate it at once: map-side sums keep it small."""
    return df.select(*keep, F.explode(F.split(text, "")).alias("ch")).where("ch <> ''")


def vocabulary(df: DataFrame, text: str) -> DataFrame:
    """(ch, id): distinct characters in code-point order. Bounded by Unicode, so one task may rank it."""
    from pyspark.sql import Window as W


    def own(batches):
        """The distinct characters of a task's rows."""
        seen = np.zeros(0x110000, bool)
        for b in slices(batches):
            seen[np.frombuffer("".join(t or "" for t in b.column(0).to_pylist()).encode("utf-32-le"), "<u4")] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(map(chr, np.flatnonzero(seen).tolist())), pa.string())], ["ch"])

    return df.select(text).mapInArrow(own, "ch string").distinct().select("ch", (F.row_number().over(W.orderBy("ch")) - 1).alias("id"))


def _code_points(vocab: DataFrame) -> tuple[list[int], list[int]]:
    """The vocabulary's code points and ids, a list bounded by Unicode."""
    found = vocab.select("ch", F.col("id").cast("long").alias("id")).toArrow()
    return [ord(ch) for ch in found["ch"].to_pylist()], found["id"].to_pylist()


def encode_characters(df: DataFrame, key: str, text: str, vocab: DataFrame) -> DataFrame:
    """(key, ids): character ids, each by one look-up in a table of code points; an unknown character gives null."""
    (points, numbers), kind, of = _code_points(vocab), df.schema[key].dataType.simpleString(), vocab.schema["id"].dataType.simpleString()

    def run(batches):
        table = np.full(0x110000, -1, np.int64)
        table[points] = numbers
        for b in slices(batches):
            texts = b.column(1).to_pylist()
            ids = table[np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le"), "<u4")]
            ends = np.cumsum([0, *(len(t or "") for t in texts)])
            starts = pa.array(ends, pa.int32(), mask=np.array([*(t is None for t in texts), False]))
            values = pa.array(ids, mask=ids < 0).cast(pa.int32() if of == "int" else pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(starts, values)], ["key", "ids"])

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, ids array<{of}>").withColumnRenamed("key", key)


def decode_characters(df: DataFrame, key: str, ids: str, vocab: DataFrame) -> DataFrame:
    """(key, text): unknown and null ids give no character, a null list gives null."""
    (points, numbers), kind = _code_points(vocab), df.schema[key].dataType.simpleString()

    def run(batches):
        table = np.full(max(numbers, default=0) + 2, -1, np.int64)
        table[numbers] = points
        for b in slices(batches):
            out = []
            for x in b.column(1):
                if not x.is_valid:
                    out.append(None)
                    continue
                found = x.values.drop_null().to_numpy().astype(np.int64)
                found = table[np.where((found < 0) | (found >= len(table)), len(table) - 1, found)]
                out.append(found[found >= 0].astype("<u4").tobytes().decode("utf-32-le"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["key", "text"])

    return df.select(F.col(key).alias("key"), F.col(ids).alias("ids")).mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)


def offsets(df: DataFrame, key: str, length: Column, name: str = "start") -> DataFrame:
    """Adds where a document's tokens begin in the flat stream in key order."""
    return running_sum(df, [key], length, name)


def corpus_cut(df: DataFrame, key: str, text: str, share: float) -> DataFrame:
    """Adds `cut`: how many characters of a text lie before floor(share * n) of the whole corpus in key order."""
    placed = running_sum(df.withColumn("__n", F.length(F.coalesce(F.col(text), F.lit(""))).cast("bigint")), [key], F.col("__n"), "__start")
    total = df.agg(F.coalesce(F.sum(F.length(text).cast("bigint")), F.lit(0)).alias("__total"))
    cut = F.greatest(F.lit(0), F.least(F.col("__n"), F.floor(F.col("__total") * F.lit(share)) - F.col("__start")))
    return placed.join(F.broadcast(total)).withColumn("cut", cut.cast("bigint")).drop("__n", "__start", "__total")


def contiguous_shards(df: DataFrame, key: str, n: int, name: str = "shard") -> DataFrame:
    """Adds the number of n balanced contiguous shards; the first count mod n get one row more."""
    ranked = rank(df, [key], "__rank")

    def of(count: Column) -> Column:
        big, size = count % n, F.floor(count / n)
        return F.when(F.col("__rank") < big * (size + 1), F.floor(F.col("__rank") / (size + 1))).otherwise(big + F.floor((F.col("__rank") - big * (size + 1)) / F.greatest(size, F.lit(1)))).cast("int")

    return _with_count(ranked, of, name).drop("__rank")


def token_type(vocab_size: Column) -> Column:
    """The smallest unsigned type that holds every id below vocab_size."""
    return F.when(vocab_size < 2**16, "uint16").when(vocab_size < 2**32, "uint32").otherwise("uint64")


def template(kind: str, key: str, fields: dict[str, str]) -> Column:
    """`key: field`, by the kind of text asked for; an unknown kind is an error."""
    if kind not in fields:
        raise ValueError(f"unknown kind of text: {kind}")
    return F.concat(F.col(key).cast("string"), F.lit(": "), F.col(fields[kind]))
