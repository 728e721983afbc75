"""Streams of token ids as packed bytes: a row's ids are one binary value of `width` bytes an id, little-endian. Blocks and
windows are cut and joined as byte slices; no list of tokens is made and no token is exploded."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import running_sum


def encode_packed(df: DataFrame, key: str, text: str, path: str, end: int | None = None, dtype: str = "uint16") -> DataFrame:
    """(key, data, n): packed ids by the tokenizer in a public JSON file, an end id after them if asked for. Ids that the
    type can't hold are an error; a null text counts as empty."""
    from .tokens import runs, slices

    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, width = runs(path, dtype), np.dtype(dtype).itemsize
        tail = b"" if end is None else encode.pack([end])
        for part in slices(batches):
            data = [encode(t or "") + tail for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(data, pa.binary()), pa.array([len(x) // width for x in data], pa.int64())], ["key", "data", "n"])

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, data binary, n long").withColumnRenamed("key", key)


def encode_ranks(df: DataFrame, key: str, text: str, ranks: str, pattern: str, end: int | None = None, dtype: str = "uint16") -> DataFrame:
    """(key, data, n): as encode_packed, by a file of ranks and the pattern that splits text; special tokens in a text are
    ordinary text. No list of Python numbers is made."""
    from .tokens import encoding, slices

    kind, limit = df.schema[key].dataType.simpleString(), np.iinfo(dtype).max

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packed = encoding(ranks, pattern), np.dtype(dtype).newbyteorder("<")
        tail = np.array([] if end is None else [end], dtype=np.uint32)
        for part in slices(batches):
            ids = [np.concatenate([enc.encode_to_numpy(t or "", disallowed_special=()), tail]) for t in part.column(1).to_pylist()]
            if any(len(x) and x.max() > limit for x in ids):
                raise ValueError(f"an id doesn't fit {dtype}")
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.astype(packed).tobytes() for x in ids], pa.binary()), pa.array(map(len, ids), pa.int64())], ["key", "data", "n"])

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, data binary, n long").withColumnRenamed("key", key)


def spelled(df: DataFrame, data: str, name: str, dtype: str = "uint16") -> DataFrame:
    """df with the packed ids as decimal numbers with a space between, in a column of that name in their place."""
    from .tokens import slices

    others = [c for c in df.columns if c != data]
    schema = df.select(*others).schema.add(name, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = np.dtype(dtype).newbyteorder("<")
        for b in slices(batches):
            texts = [None if x is None else " ".join(map(str, np.frombuffer(x, packed).tolist())) for x in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], [*others, name])

    return df.select(*others, data).mapInArrow(run, schema)


def packed_lists(df: DataFrame, ids: str, name: str, dtype: str = "uint16") -> DataFrame:
    """df with the lists of ids as packed bytes, in a column of that name in their place; ids that the type can't hold are
    an error."""
    others = [c for c in df.columns if c != ids]
    from .tokens import slices

    limits, schema = np.iinfo(dtype), df.select(*others).schema.add(name, "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = np.dtype(dtype).newbyteorder("<")
        for b in slices(batches):
            lists = [x.values.to_numpy(zero_copy_only=False).astype(np.int64) if x.is_valid else np.zeros(0, np.int64) for x in b.column(b.num_columns - 1)]
            if any(len(x) and (x.min() < limits.min or x.max() > limits.max) for x in lists):
                raise ValueError(f"an id doesn't fit {dtype}")
            data = pa.array([x.astype(kind).tobytes() for x in lists], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], data], [*others, name])

    return df.select(*others, ids).mapInArrow(run, schema)


def size(data: str | Column, width: int) -> Column:
    """Ids in a packed value."""
    return F.expr(f"octet_length({data}) div {width}").cast("bigint") if isinstance(data, str) else F.floor(F.octet_length(data) / width).cast("bigint")


def cut(data: str, first: Column, n: Column, width: int) -> Column:
    """n ids from number `first` on."""
    return F.substring(data, (first * width + 1).cast("int"), (n * width).cast("int"))


def joined(parts: Column) -> Column:
    """A list of packed values as one."""
    return F.aggregate(parts, F.lit(b""), lambda a, p: F.concat(a, p))


def in_order(at: str, part: Column) -> Column:
    """An aggregate: the packed parts of a group, joined in the order of a column."""
    return joined(F.transform(F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), part.alias("part")))), lambda p: p["part"]))


def pieces(placed: DataFrame, data: str, start: str, n: str, block: int, width: int, total: int | None = None) -> DataFrame:
    """(block, at, part): what each placed value has in each block of the stream that it reaches, up to `total` ids."""
    end = F.col(start) + F.col(n) if total is None else F.least(F.col(start) + F.col(n), F.lit(total))
    rows = placed.withColumn("__end", end).where(F.col("__end") > F.col(start))
    reach = rows.withColumn("block", F.explode(F.sequence(F.floor(F.col(start) / block), F.floor((F.col("__end") - 1) / block))))
    low, high = F.greatest(F.col("block") * block, F.col(start)), F.least((F.col("block") + 1) * block, F.col("__end"))
    return reach.select("block", low.alias("at"), cut(data, low - F.col(start), high - low, width).alias("part"))


def met_blocks(parts: DataFrame, block: int, width: int, keep_rest: bool = False) -> DataFrame:
    """(block, data, n_docs) of pieces (block, at, part): whole ones pass as they are, the others meet."""
    whole = F.octet_length("part") == block * width
    ends = parts.where(~whole).groupBy("block").agg(in_order("at", F.col("part")).alias("data"), F.count(F.lit(1)).alias("n_docs"))
    ends = ends if keep_rest else ends.where(F.octet_length("data") == block * width)
    return parts.where(whole).select("block", F.col("part").alias("data"), F.lit(1).cast("bigint").alias("n_docs")).unionByName(ends)


def pack_stream(df: DataFrame, key: str, data: str, block: int, width: int, keep_rest: bool = False) -> DataFrame:
    """(block, data, n_docs): the packed values in key order, concatenated and cut into blocks of `block` ids; the rest
    shorter than a block is dropped unless it is to be kept. Null values count as empty, null keys come last.

    Bytes move once for their places; only those of blocks in which values meet move again.
    """
    rows = df.select(key, F.coalesce(F.col(data), F.lit(b"")).alias("__data")).withColumn("__n", size("__data", width))
    placed = running_sum(rows, [key], F.col("__n"), "__start")
    return met_blocks(pieces(placed, "__data", "__start", "__n", block, width), block, width, keep_rest)


def gather_packed(windows: DataFrame, blocks: DataFrame, block: int, length: int, total: int, width: int) -> DataFrame:
    """windows (.., start) with `data`: the `length` ids from start on, around the end of a stream of `total` ids.

    A window asks for the blocks that it touches by an equi-join, its runs found in closed form.
    """
    names, start = windows.columns, F.col("start")
    end = start + length
    rounds = windows.withColumn("__round", F.explode(F.sequence(F.floor(start / total), F.floor((end - 1) / total))))
    low, high = F.greatest(start - F.col("__round") * total, F.lit(0)), F.least(end - F.col("__round") * total, F.lit(total))
    asked = rounds.withColumns({"__low": low, "__high": high}).withColumn("block", F.explode(F.sequence(F.floor(F.col("__low") / block), F.floor((F.col("__high") - 1) / block))))
    pos = F.greatest(F.col("__low"), F.col("block") * block)
    runs = asked.select(*names, "block", pos.alias("__pos"), (F.col("__round") * total + pos - start).alias("__i"), (F.least("__high", (F.col("block") + 1) * block) - pos).alias("__n"))
    met = runs.join(blocks.select("block", F.col("data").alias("__data")), "block")
    part = cut("__data", F.col("__pos") - F.col("block") * block, F.col("__n"), width)
    return met.groupBy(*names).agg(in_order("__i", part).alias("data"))


def shift_packed(data: str, width: int) -> tuple[Column, Column]:
    """(x, y) of a window of n + 1 ids: y is x one id later."""
    n = size(data, width) - 1
    return cut(data, F.lit(0), n, width), cut(data, F.lit(1), n, width)
