"""Shared folder, materialised tables, salted group joins and Bloom filters."""

from __future__ import annotations

import ctypes
import functools
import operator
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one if none is set on a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            folder = current.get()
        elif not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        else:
            folder = "file://" + tempfile.mkdtemp(prefix="loomline-")
            spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes materialised tables that nothing will read again."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_name(columns: Sequence[str], name: str) -> str:
    """A name for a column that none of these has (Spark's names don't tell cases apart)."""
    known = {c.lower() for c in columns}
    while name.lower() in known:
        name += "_"
    return name


def numbered(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df, written to the shared folder, with a number of its own in each row; and the new column's name."""
    row = free_name(df.columns, "__row")
    return materialise(df.withColumn(row, F.monotonically_increasing_id()), name), row


def small_side(table: DataFrame, most: int) -> DataFrame:
    """A materialised table of thin rows as a join's other side: broadcast if it has at most so many rows, else sorted and
    merged, whatever Spark's estimate of it."""
    return F.broadcast(table) if table.count() <= most else table.hint("merge")


#: Row numbers that are broadcast at most.
MOST_GONE = 1_000_000


def without(rows: DataFrame, row: str, dropped: DataFrame, name: str) -> DataFrame:
    """Numbered rows but those whose number is in the one column of `dropped`, without their number.

    The numbers are written and counted first: up to MOST_GONE of them are broadcast and no text moves, more are merged.
    """
    gone = small_side(materialise(dropped.toDF("__gone"), name), MOST_GONE)
    return rows.join(gone, rows[row] == gone["__gone"], "left_anti").drop(row)


def release() -> None:
    """Gives what a worker no longer needs back to the system, where the C library can."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256, most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of so many rows and, but for single rows, bytes, so that what a worker makes of them stays
    small; frees Arrow memory at once."""
    pa.set_memory_pool(pa.system_memory_pool())
    for b in batches:
        at = 0
        while at < b.num_rows:
            n = min(rows, b.num_rows - at)
            while n > 1 and b.slice(at, n).nbytes > most_bytes:
                n //= 2
            yield b.slice(at, n)
            at += n
    release()


def attach_group(
    df: DataFrame,
    keys: Sequence[str],
    partials: dict[str, Column],
    merges: dict[str, Column],
    salts: int = 64,
    salt_on: Column | None = None,
) -> DataFrame:
    """Adds aggregates of each row's group to the row, for groups of any size.

    partials aggregate rows of (keys, salt); merges aggregate the partials of a group. A hot group's rows stay dealt
    over the salts in every shuffle. df is read twice, so it should be a materialised table. Null keys are equal.
    """
    salted = df.withColumn("__salt", F.pmod(salt_on if salt_on is not None else F.xxhash64(*df.columns), F.lit(salts)).cast("int"))
    first = salted.groupBy(*keys, "__salt").agg(*[c.alias(n) for n, c in partials.items()])
    second = first.groupBy(*keys).agg(F.collect_set("__salt").alias("__salts"), *[c.alias(n) for n, c in merges.items()])
    wide = second.select(*[F.col(k).alias(f"__g_{k}") for k in keys], F.explode("__salts").alias("__g_salt"), *merges)
    on = [salted[k].eqNullSafe(F.col(f"__g_{k}")) for k in keys] + [salted["__salt"] == F.col("__g_salt")]
    joined = salted.join(wide, functools.reduce(operator.and_, on))
    return joined.select(*[salted[c] for c in df.columns], *merges)


#: Bits to shift a 64-bit key by for each of a Bloom filter's positions.
BLOOM_SHIFTS = (0, 18, 36)
#: Fewest and most 64-bit words of a filter: it has 12 bits a key up to about 11 million keys, and 16 MB at most.
BLOOM_WORDS = (1 << 12, 1 << 21)
#: Binary digits of the number of words in a chunk, as which a filter reaches the driver.
BLOOM_CHUNK_BITS = 12


def bloom_of(keys: DataFrame, column: str) -> np.ndarray:
    """A Bloom filter over a column of 64-bit hashes. Past its largest size it lets more through, but never loses a key."""
    keys = materialise(keys.select(column), "bloom")  # counted first, then read again
    words = min(max(BLOOM_WORDS[0], 1 << (keys.count() * 12 // 64).bit_length()), BLOOM_WORDS[1])
    bits = F.explode(F.array(*[F.shiftrightunsigned(column, s).bitwiseAND(F.lit(words * 64 - 1)) for s in BLOOM_SHIFTS]))
    rows = keys.select(bits.alias("bit")).select(
        F.shiftrightunsigned("bit", 6).alias("word"), F.expr("shiftleft(1L, cast(bit & 63 as int))").alias("mask")
    )
    whole = rows.groupBy("word").agg(F.bit_or("mask").alias("mask")).withColumn("chunk", F.shiftright("word", BLOOM_CHUNK_BITS))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks: dict[int, np.ndarray] = {}
        for b in batches:
            word, mask, chunk = (c.to_numpy() for c in b.columns)
            for k in np.unique(chunk).tolist():
                mine = chunk == k
                chunks.setdefault(k, np.zeros(1 << BLOOM_CHUNK_BITS, dtype=np.int64))[word[mine] & ((1 << BLOOM_CHUNK_BITS) - 1)] = mask[mine]
        for k, part in chunks.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([part.astype("<i8").tobytes()], pa.binary())], ["chunk", "masks"])

    # a binary row for each chunk of the filter reaches the driver
    found = whole.select("word", "mask", "chunk").repartition("chunk").mapInArrow(pack, "chunk long, masks binary").toArrow()
    discard(keys)
    out = np.zeros(words, dtype=np.int64)
    for k, masks in zip(found["chunk"].to_pylist(), found["masks"].to_pylist(), strict=True):
        out[k << BLOOM_CHUNK_BITS : (k + 1) << BLOOM_CHUNK_BITS] = np.frombuffer(masks, dtype="<i8")
    return out.view(np.uint64)


def bloom_test(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the keys (uint64) may be in the filter."""
    hit = np.ones(len(keys), dtype=bool)
    for s in BLOOM_SHIFTS:
        bit = (keys >> np.uint64(s)) & np.uint64(len(words) * 64 - 1)
        hit &= (words[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
    return hit
