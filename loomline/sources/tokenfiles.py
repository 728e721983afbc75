"""Token files: the flat stream and the indexed ragged dataset, written and read by parallel tasks.

A dataset is a folder of part files in order, each written by one task, and a manifest table of the parts that finished
tasks report: first token, count, type. Readers cut every part into ranges of bytes, so a large file is read by many tasks.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.packed import packed_lists

#: Fixed values of the indexed format: its magic, version, and codes of types.
MAGIC, VERSION = b"MMIDIDX\x00\x00", 1
CODES = {1: "uint8", 2: "int8", 3: "int16", 4: "int32", 5: "int64", 6: "float64", 7: "float32", 8: "uint16"}


def _open(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def _save(folder: str, name: str, data: bytes) -> None:
    store, base = _open(folder)
    store.create_dir(base, recursive=True)
    with store.open_output_stream(f"{base}/{name}", compression=None) as f:
        f.write(data)


#: Bytes of a part file, about.
PART_BYTES = 256 << 20


def parts_for(tokens: int, dtype: str, least: int = 8) -> int:
    """Part files for so many tokens: `least`, or as many as keep a part near PART_BYTES."""
    return max(least, -(-tokens * np.dtype(dtype).itemsize // PART_BYTES))


def write_flat(blocks: DataFrame, folder: str, dtype: str, block: int, parts: int | None = None, capacity: int | None = None) -> DataFrame:
    """Writes (block, ids) of packed blocks as a flat stream; gives the manifest (first, n, name, dtype).

    A task holds one block at a time. Ids that the type can't hold are an error, and so are more tokens than `capacity`,
    before anything is written.
    """
    if parts is None or capacity is not None:
        tokens = blocks.agg(F.sum(F.size("ids").cast("long"))).first()[0] or 0
        if capacity is not None and tokens > capacity:
            raise ValueError(f"{tokens} tokens exceed the capacity of {capacity}")
        parts = parts or parts_for(tokens, dtype)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, out, first, n, name = TaskContext.get(), None, 0, 0, ""
        for b in batches:
            for k, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if out is None:
                    first, name = k * block, f"part-{k:012d}-{task.taskAttemptId()}.bin"
                    store, base = _open(folder)
                    store.create_dir(base, recursive=True)
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                out.write(data.as_buffer())
                n += len(data.as_buffer()) // np.dtype(dtype).itemsize
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"first": [first], "n": [n], "name": [name], "dtype": [dtype]})

    # bytes are moved and sorted, not lists of numbers; an id that doesn't fit fails here
    packed = packed_lists(blocks.select(F.col("block").cast("long").alias("block"), "ids"), "ids", "data", dtype)
    manifest = packed.repartitionByRange(parts, "block").sortWithinPartitions("block").mapInArrow(run, "first long, n long, name string, dtype string")
    manifest.write.parquet(f"{folder}/manifest")
    return blocks.sparkSession.read.parquet(f"{folder}/manifest")


def read_flat(spark: SparkSession, folder: str, step: int = 1 << 20) -> DataFrame:
    """(pos, ids): the flat stream in pieces of at most `step` tokens."""
    manifest = spark.read.parquet(f"{folder}/manifest")
    pieces = manifest.select("first", "n", "name", "dtype", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(step).cast("long"))).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(folder)
        for b in batches:
            for r in b.to_pylist():
                kind = np.dtype(r["dtype"]).newbyteorder("<")
                n = min(step, r["n"] - r["at"])
                with store.open_input_file(f"{base}/{r['name']}") as f:
                    data = f.read_at(n * kind.itemsize, r["at"] * kind.itemsize)
                if len(data) != n * kind.itemsize:
                    raise ValueError(f"{r['name']} is cut off")
                yield pa.RecordBatch.from_arrays([pa.array([r["first"] + r["at"]]), pa.array([np.frombuffer(data, kind).astype(np.int64)])], ["pos", "ids"])

    return pieces.repartition("name", "at").mapInArrow(run, "pos long, ids array<long>")


def read_bin(spark: SparkSession, path: str, dtype: str, step: int = 1 << 20) -> DataFrame:
    """(pos, ids): a bare file of tokens, without a manifest, in pieces of at most `step` tokens that many tasks read."""
    kind = np.dtype(dtype).newbyteorder("<")
    (size,) = spark.read.format("binaryFile").load(path).select("length").first()
    if size % kind.itemsize:
        raise ValueError(f"{path} doesn't hold whole tokens of type {dtype}")
    folder, _, name = path.rpartition("/")
    n = size // kind.itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(folder)
        for b in batches:
            with store.open_input_file(f"{base}/{name}") as f:
                for at in b.column(0).to_pylist():
                    data = f.read_at(min(step, n - at) * kind.itemsize, at * kind.itemsize)
                    yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([np.frombuffer(data, kind).astype(np.int64)])], ["pos", "ids"])

    return spark.range(0, n, step, max(1, min(-(-n // step), 10_000))).mapInArrow(run, "pos long, ids array<long>")


def ends_of(spark: SparkSession, path: str, dtype: str, n: int = 20) -> tuple[int, list[int], list[int]]:
    """(tokens, the first n, the last n) of a bare file, to look at what was written."""
    kind = np.dtype(dtype).newbyteorder("<")
    (size,) = spark.read.format("binaryFile").load(path).select("length").first()
    folder, _, name = path.rpartition("/")
    store, base = _open(folder)
    most = min(n * kind.itemsize, size)
    with store.open_input_file(f"{base}/{name}") as f:
        head, tail = f.read_at(most, 0), f.read_at(most, size - most)
    return size // kind.itemsize, np.frombuffer(head, kind).tolist(), np.frombuffer(tail, kind).tolist()


def index_bytes(sizes: np.ndarray, documents: np.ndarray, dtype: str) -> bytes:
    """An index: header, sizes, byte pointers, starts of documents."""
    code = next(k for k, v in CODES.items() if v == dtype)
    pointers = np.concatenate([[0], np.cumsum(sizes.astype(np.int64))[:-1]]) * np.dtype(dtype).itemsize if len(sizes) else np.zeros(0)
    head = MAGIC + struct.pack("<QBQQ", VERSION, code, len(sizes), len(documents))
    return head + sizes.astype("<i4").tobytes() + pointers.astype("<i8").tobytes() + documents.astype("<i8").tobytes()


def parse_index(data: bytes) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """(type, sizes, pointers, starts of documents)."""
    if data[:9] != MAGIC:
        raise ValueError("not an index of token sequences")
    version, code, n, d = struct.unpack_from("<QBQQ", data, 9)
    if version != VERSION or code not in CODES:
        raise ValueError(f"unknown version {version} or type {code}")
    at = 9 + struct.calcsize("<QBQQ")
    sizes = np.frombuffer(data, "<i4", n, at)
    pointers = np.frombuffer(data, "<i8", n, at + 4 * n)
    return CODES[code], sizes, pointers, np.frombuffer(data, "<i8", d, at + 12 * n)


def write_indexed(rows: DataFrame, key: str, ids: str, folder: str, dtype: str = "int32", parts: int | None = None, per_document: int = 100) -> DataFrame:
    """Writes sequences in key order as index and data files; a document ends after every `per_document` sequences of a part
    and at its end. Data goes to its file as it comes; a task holds only the sizes."""
    if dtype not in CODES.values():
        raise ValueError(f"the index has no code for {dtype}")
    parts = parts or parts_for(rows.agg(F.sum(F.size(ids).cast("long"))).first()[0] or 0, dtype)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sizes: list[int] = []
        out, name, first = None, "", None
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if out is None:
                    first, name = k, f"part-{k:012d}-{TaskContext.get().taskAttemptId()}"
                    store, base = _open(folder)
                    store.create_dir(base, recursive=True)
                    out = store.open_output_stream(f"{base}/{name}.bin", compression=None)
                values = x.values.to_numpy()
                sizes.append(len(values))
                out.write(values.astype(np.dtype(dtype).newbyteorder("<")).tobytes())
        if out is not None:
            out.close()
            n = len(sizes)
            marks = np.unique(np.r_[np.arange(0, n, per_document), n])
            _save(folder, f"{name}.idx", index_bytes(np.asarray(sizes), marks, dtype))
            yield pa.RecordBatch.from_pydict({"first": [first], "n": [n], "name": [name]})

    ordered = rows.select(F.col(key).cast("long").alias("key"), F.col(ids).alias("ids")).repartitionByRange(parts, "key").sortWithinPartitions("key")
    ordered.mapInArrow(run, "first long, n long, name string").write.parquet(f"{folder}/manifest")
    return rows.sparkSession.read.parquet(f"{folder}/manifest")


def _samples(f_idx: bytes, data, first: int, at: int, until: int) -> tuple[list[int], list[np.ndarray]]:
    """Numbers and ids of the samples `at` to `until` of an index and its open data file."""
    dtype, sizes, pointers, _ = f_idx
    kind = np.dtype(dtype).newbyteorder("<")
    out = [np.frombuffer(data.read_at(n * kind.itemsize, p), kind).astype(np.int64) for n, p in zip(sizes[at:until].tolist(), pointers[at:until].tolist(), strict=True)]
    return list(range(first + at, first + at + len(out))), out


def read_indexed(spark: SparkSession, folder: str) -> DataFrame:
    """(name, sample, ids) of every sequence, numbered through all parts; one sequence is a filter on its number, a batch
    a range of numbers, the length a count."""
    from pyspark.sql import Window as W

    # parts, not rows: their list passes through one task
    start = F.coalesce(F.sum("n").over(W.orderBy("first").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    manifest = spark.read.parquet(f"{folder}/manifest").select("name", start.cast("long").alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(folder)
        for b in batches:
            for name, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with store.open_input_file(f"{base}/{name}.idx") as f:
                    index = parse_index(f.read())
                with store.open_input_file(f"{base}/{name}.bin") as f:
                    for at in range(0, len(index[1]), 256):
                        numbers, out = _samples(index, f, first, at, at + 256)
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(out)), pa.array(numbers, pa.int64()), pa.array(out, pa.list_(pa.int64()))], ["name", "sample", "ids"])

    return manifest.repartition("name").mapInArrow(run, "name string, sample long, ids array<long>")


def read_pair(spark: SparkSession, prefix: str, tasks: int = 64) -> DataFrame:
    """(sample, ids) of a bare prefix.idx and prefix.bin; each of the tasks reads its range of samples."""
    folder, _, name = prefix.rpartition("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(folder)
        for b in batches:
            for k in b.column(0).to_pylist():
                with store.open_input_file(f"{base}/{name}.idx") as f:
                    index = parse_index(f.read())
                n = len(index[1])
                with store.open_input_file(f"{base}/{name}.bin") as f:
                    for at in range(n * k // tasks, n * (k + 1) // tasks, 256):
                        numbers, out = _samples(index, f, 0, at, min(at + 256, n * (k + 1) // tasks))
                        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(out, pa.list_(pa.int64()))], ["sample", "ids"])

    return spark.range(0, tasks, 1, tasks).mapInArrow(run, "sample long, ids array<long>")
