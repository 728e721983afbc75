"""Python data sources of token files: one flat file that many tasks write at their byte offsets, and an indexed pair of
files of which a read touches only the samples that it asks for.

`flat_tokens` (sink): rows (block, data). The file is allocated whole beside its place under a name of its own; every
task writes each block at its offset, so that a task that runs again writes the same bytes to the same places. The
commit checks the sum of what the tasks that count have written and moves the file into place at once; an abort deletes
it. Byte offsets need a file system that can write within a file: a shared folder reached by file:// or a plain path.
Stores that can't are for tokenfiles.write_flat, whose parts need no offsets.

`indexed_tokens` (source): rows (sample, ids) of a range of samples. Partitions are smaller ranges; each reads its part of
the index and one range of the data file. The range is an option, not a pushed filter: Spark keeps what was pushed with
the loaded table, so that two filters of one DataFrame, as in a union, would both see the last one's range.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..operators.ordering import rank, running_sum
from ..operators.packed import packed_lists
from .tokenfiles import CODES, MAGIC, VERSION, _open
from .workspace import stored

HEAD = struct.Struct("<QBQQ")


def local_path(path: str) -> str:
    """The path in a file system that can write within files; other schemes are an error."""
    scheme, _, rest = path.partition("://")
    if not rest:
        return path.removeprefix("file:")
    if scheme != "file":
        raise ValueError(f"{scheme} can't write within a file; write_flat writes parts")
    return "/" + rest.lstrip("/")


@dataclass
class Written(WriterCommitMessage):
    bytes: int


class FlatWriter(DataSourceArrowWriter):
    """Writes each block at block * step bytes of one file; with a step of 1, values of any length at bytes of their own."""

    def __init__(self, path: str, token: str, step: int, total: int):
        self.path, self.held, self.step, self.total = local_path(path), f"{local_path(path)}.{token}", step, total

    def allocate(self) -> None:
        os.makedirs(os.path.dirname(self.path), exist_ok=True)
        with open(self.held, "wb") as f:
            f.truncate(self.total)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        n = 0
        with open(self.held, "r+b") as f:
            for b in iterator:
                for block, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    at = block * self.step
                    if at + len(data) > self.total or 1 < self.step < len(data):
                        raise ValueError(f"block {block} doesn't fit the file")
                    f.seek(at)
                    f.write(data)
                    n += len(data)
            f.flush()
            os.fsync(f.fileno())
        return Written(n)

    def commit(self, messages: list[Written | None]) -> None:
        n = sum(m.bytes for m in messages if m is not None)
        if n != self.total:
            self.abort(messages)
            raise ValueError(f"{n} bytes were written of {self.total}")
        os.replace(self.held, self.path)

    def abort(self, messages: list[Written | None]) -> None:
        if os.path.exists(self.held):
            os.remove(self.held)


class FlatTokens(DataSource):
    @classmethod
    def name(cls) -> str:
        return "flat_tokens"

    def schema(self) -> str:
        return "block bigint, data binary"

    def writer(self, schema, overwrite: bool) -> FlatWriter:
        out = FlatWriter(self.options["path"], self.options["token"], int(self.options["step"]), int(self.options["total"]))
        out.allocate()
        return out


def write_bin(blocks: DataFrame, path: str, block: int, width: int) -> int:
    """Writes (block, data) of a packed stream, numbered from 0 without holes, as one flat file; gives its number of ids.

    All blocks but the last hold `block` ids of `width` bytes. Tasks write where the blocks are: nothing is moved or sorted.
    """
    size = F.octet_length("data").cast("bigint")
    n, last, total, short = blocks.agg(F.count(F.lit(1)), F.max("block"), F.sum(size), F.count_if((size != block * width))).first()
    if n and (last != n - 1 or short > 1 or total <= last * block * width):
        raise ValueError("the blocks have holes")
    if not n:
        FlatWriter(path, "empty", 1, 0).allocate()
        os.replace(f"{local_path(path)}.empty", local_path(path))
        return 0
    blocks.sparkSession.dataSource.register(FlatTokens)
    rows = blocks.select(F.col("block").cast("bigint").alias("block"), "data")
    rows.write.format("flat_tokens").mode("append").options(token=uuid.uuid4().hex, step=block * width, total=total).save(path)
    return total // width


#: Samples of a piece of an index that one task makes.
PIECE = 1 << 16


def _write_at(rows: DataFrame, path: str, total: int) -> None:
    """Rows (at, data): values at bytes of one file that they fill."""
    if not total:
        FlatWriter(path, "empty", 1, 0).allocate()
        os.replace(f"{local_path(path)}.empty", local_path(path))
        return
    rows.sparkSession.dataSource.register(FlatTokens)
    rows.select(F.col("at").cast("bigint").alias("block"), "data").write.format("flat_tokens").mode("append").options(token=uuid.uuid4().hex, step=1, total=total).save(path)


def write_pair(rows: DataFrame, key: str, ids: str, prefix: str, dtype: str = "int32", per_document: int = 100) -> int:
    """Writes sequences in key order, null keys last, as prefix.idx and prefix.bin; gives their number. A document ends after
    every `per_document` sequences and at the end. Null lists count as empty.

    Many tasks write one file: bytes go to the places that prefix sums of the lengths give them, and so do pieces of the
    index, so that no task holds or writes more than its share.
    """
    spark, width = rows.sparkSession, np.dtype(dtype).itemsize
    code = next((k for k, v in CODES.items() if v == dtype), None)
    if code is None:
        raise ValueError(f"the index has no code for {dtype}")
    data = packed_lists(rows.select(F.col(key).alias("key"), F.col(ids).alias("ids")), "ids", "data", dtype).withColumn("n", F.octet_length("data").cast("bigint"))
    placed = stored(running_sum(stored(data, "packed"), ["key"], F.col("n"), "at"), "placed")
    n, total = placed.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    _write_at(placed.where("n > 0").select("at", "data"), f"{prefix}.bin", total)
    # equal keys keep the order in which they were placed
    numbered = rank(placed.select("key", "at", "n"), ["key", "at", "n"], "number").select(F.expr(f"number div {PIECE}").alias("piece"), "number", "at", "n")
    start = len(MAGIC) + HEAD.size

    def pieces(t: pa.Table) -> pa.Table:
        t = t.sort_by("number")
        first = t.column("number")[0].as_py()
        sizes, pointers = (t.column("n").to_numpy() // width).astype("<i4"), t.column("at").to_numpy().astype("<i8")
        return pa.table({"at": pa.array([start + 4 * first, start + 4 * n + 8 * first], pa.int64()), "data": pa.array([sizes.tobytes(), pointers.tobytes()], pa.binary())})

    marks = -(-n // per_document) + 1

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b.column(0).to_pylist():
                some = np.minimum(np.arange(k, min(k + PIECE, marks), dtype=np.int64) * per_document, n).astype("<i8").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([start + 12 * n + 8 * k], pa.int64()), pa.array([some], pa.binary())], ["at", "data"])

    head = spark.createDataFrame([(0, bytearray(MAGIC + HEAD.pack(VERSION, code, n, marks)))], "at bigint, data binary")
    index = head.unionByName(numbered.groupBy("piece").applyInArrow(pieces, "at bigint, data binary"))
    index = index.unionByName(spark.range(0, marks, PIECE).mapInArrow(ends, "at bigint, data binary"))
    _write_at(index, f"{prefix}.idx", start + 12 * n + 8 * marks)
    return n


@dataclass
class Samples(InputPartition):
    first: int
    last: int

    def __post_init__(self):
        super().__init__((self.first, self.last))


class PairReader(DataSourceReader):
    """Reads samples `low` to `high` - 1 of prefix.idx and prefix.bin, `per` of them to a partition."""

    def __init__(self, prefix: str, per: int, low: int = 0, high: int | None = None):
        self.prefix, self.per, self.low, self.high = prefix, per, max(low, 0), high

    def _head(self, f) -> tuple[str, int]:
        data = f.read_at(len(MAGIC) + HEAD.size, 0)
        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("not an index of token sequences")
        version, code, n, _ = HEAD.unpack_from(data, len(MAGIC))
        if version != VERSION or code not in CODES:
            raise ValueError(f"unknown version {version} or type {code}")
        return CODES[code], n

    def partitions(self) -> list[Samples]:
        store, base = _open(self.prefix)
        with store.open_input_file(f"{base}.idx") as f:
            n = self._head(f)[1]
        high = n if self.high is None else min(n, self.high)
        return [Samples(a, min(a + self.per, high)) for a in range(self.low, high, self.per)] or [Samples(0, 0)]

    def read(self, partition: Samples) -> Iterator[pa.RecordBatch]:
        a, b = partition.first, partition.last
        if a >= b:
            return
        store, base = _open(self.prefix)
        with store.open_input_file(f"{base}.idx") as f:
            dtype, n = self._head(f)
            start = len(MAGIC) + HEAD.size
            sizes = np.frombuffer(f.read_at(4 * (b - a), start + 4 * a), "<i4").astype(np.int64)
            pointers = np.frombuffer(f.read_at(8 * (b - a), start + 4 * n + 8 * a), "<i8")
        kind = np.dtype(dtype).newbyteorder("<")
        with store.open_input_file(f"{base}.bin") as f:
            for at in range(0, b - a, 256):
                some = slice(at, min(at + 256, b - a))
                from_, to = int(pointers[some][0]), int(pointers[some][-1] + sizes[some][-1] * kind.itemsize)
                ids = np.frombuffer(f.read_at(to - from_, from_), kind).astype(np.int64)
                ends = np.cumsum(np.r_[0, sizes[some]]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(a + some.start, a + some.stop)), lists], ["sample", "ids"])


class IndexedTokens(DataSource):
    @classmethod
    def name(cls) -> str:
        return "indexed_tokens"

    def schema(self) -> str:
        return "sample bigint, ids array<bigint>"

    def reader(self, schema) -> PairReader:
        high = self.options.get("high")
        return PairReader(self.options["path"], int(self.options.get("per", 4096)), int(self.options.get("low", 0)), None if high is None else int(high))


def read_samples(spark: SparkSession, prefix: str, low: int = 0, high: int | None = None, per: int = 4096) -> DataFrame:
    """(sample, ids) of samples low to high - 1, or to the end, of prefix.idx and prefix.bin: only their bytes are read."""
    spark.dataSource.register(IndexedTokens)
    reader = spark.read.format("indexed_tokens").option("per", per).option("low", low)
    return (reader if high is None else reader.option("high", high)).load(prefix)
