"""Exact deduplication by content-defined chunk recipes.

A text, without its ASCII white space, is cut where a rolling hash of the last 32 bytes meets a condition, so equal
texts are cut alike; its recipe is the ordered list of its chunks' identifiers. Texts whose recipe no other text has
need no more work. The chunks of the others are sent out once each to the task that holds their identifier, which
compares their bytes; an identifier that stands for two different chunks makes the operator start again with longer
identifiers. Texts are equal when their lists of verified identifiers are equal; only lists, never texts, are moved to
compare documents.

Null text counts as empty; empty texts are equal to one another. Of equal texts the row with the most code points in the
original text stays, then the smallest id (null ids last), then one of the repeated rows. Very long texts are read whole;
a task holds one of them at a time and its chunks are bounded. An empty table gives an empty result. Ids are integers.
Columns other than the id and the text are dropped, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach_group, bloom_of, bloom_test, materialise, numbered, slices, without

SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Bytes that a chunk has at least and at most, and the bits of the rolling hash that are 0 at a cut: about 1 KB a chunk.
LEAST, MOST, CUT_BITS = 256, 8192, 10
_rng = np.random.default_rng(20240229)
GEAR = _rng.integers(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)


def cut_points(data: bytes) -> list[int]:
    """Ends of the chunks of a text's bytes."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    h = GEAR[np.frombuffer(data, dtype=np.uint8)]
    for k in (1, 2, 4, 8, 16):  # h[i] becomes the sum of gear[i - j] << j over 32 bytes
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    marks = np.flatnonzero((h >> np.uint32(32 - CUT_BITS)) == 0) + 1
    out, start = [], 0
    for m in [*marks.tolist(), n]:
        while m - start > MOST:
            start += MOST
            out.append(start)
        if m - start >= LEAST or m == n and m > start:
            out.append(m)
            start = m
    return out


def chunks(data: bytes) -> list[bytes]:
    ends = cut_points(data)
    return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def recipe(parts: list[bytes], id_bytes: int) -> bytes:
    return b"".join([hashlib.sha256(c).digest()[:id_bytes] for c in parts])


def recipe_key(r: bytes) -> int:
    """64-bit hash of a recipe, for the filter."""
    return int.from_bytes(hashlib.sha256(r).digest()[:8], "little", signed=True)


def recipes_of(docs: DataFrame, id_col: str, text_col: str, id_bytes: int, row_col: str | None = None) -> DataFrame:
    """(id, row, n_chars, text_sha256, recipe, key) of every row; without a column of row numbers, row is null."""
    row = F.col(row_col) if row_col else F.lit(None)
    rows = docs.select(F.col(id_col).alias("id"), row.cast("long").alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    rows = rows.select("id", "row", F.length("text").cast("long").alias("n_chars"), F.col("text").cast("binary").alias("data"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            shas, recipes, keys = [], [], []
            for data in b.column(3).to_pylist():
                data = data.translate(None, SPACE)
                shas.append(hashlib.sha256(data).hexdigest())
                recipes.append(recipe(chunks(data), id_bytes))
                keys.append(recipe_key(recipes[-1]))
            cols = [*b.columns[:3], pa.array(shas, pa.string()), pa.array(recipes, pa.binary()), pa.array(keys, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["id", "row", "n_chars", "text_sha256", "recipe", "key"])

    return rows.mapInArrow(cut, f"id {kind}, row long, n_chars long, text_sha256 string, recipe binary, key long")


def ambiguous_ids(docs: DataFrame, text_col: str, id_bytes: int, shared: np.ndarray) -> DataFrame:
    """Identifiers that stand for more than one chunk, among the texts whose recipe's hash is in the filter `shared`."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("data"))
    words = spark.sparkContext.broadcast(shared)

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()  # of this task; a chunk goes out once, however many copies the task sees
        for b in slices(batches):
            ids, parts = [], []
            cut = [chunks(d.translate(None, SPACE)) for d in b.column(0).to_pylist()]
            keys = np.asarray([recipe_key(recipe(c, id_bytes)) for c in cut], dtype=np.int64)
            for i in np.flatnonzero(bloom_test(words.value, keys.view(np.uint64))):
                for c in cut[i]:
                    whole = hashlib.sha256(c).digest()
                    if whole not in sent:
                        if len(sent) >= 1_000_000:
                            sent.clear()
                        sent.add(whole)
                        ids.append(whole[:id_bytes])
                        parts.append(c)
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(parts, pa.binary())], ["chunk_id", "content"])

    sent = rows.mapInArrow(contents, "chunk_id binary, content binary")
    return sent.groupBy("chunk_id").agg(F.min("content").alias("a"), F.max("content").alias("b")).where("a <> b").select("chunk_id")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", id_bytes: int = 16, row_col: str | None = None) -> DataFrame:
    """(id, row, keep_id, group_size, kept, text_sha256, n_chunks) of every row.

    row is what the column row_col holds, if it is given: different numbers of the rows; else the operator numbers them.
    """
    while True:
        table = recipes_of(docs, id_col, text_col, id_bytes, row_col)
        table = materialise(table if row_col else table.withColumn("row", F.monotonically_increasing_id()), "recipes")
        by_salt = table.groupBy("key", F.pmod("row", F.lit(64)).alias("salt")).agg(F.count(F.lit(1)).alias("n"))
        shared = by_salt.groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key")
        if ambiguous_ids(docs, text_col, id_bytes, bloom_of(shared, "key")).isEmpty():
            break
        if id_bytes >= 32:
            raise ValueError("two different chunks have the same SHA-256")
        id_bytes = min(32, 2 * id_bytes)
    best = F.min(F.struct((-F.col("n_chars")).alias("less"), F.col("id").isNull().alias("none"), "id", "row"))
    out = attach_group(
        table, ["recipe"], {"n": F.count(F.lit(1)), "best": best}, {"group_size": F.sum("n"), "stays": F.min("best")}, salt_on=F.col("row")
    )
    return out.select(
        F.col("id").alias(id_col),
        "row",
        F.col("stays.id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("stays.row")).alias("kept"),
        "text_sha256",
        F.expr(f"cast(octet_length(recipe) div {id_bytes} as int)").alias("n_chunks"),
    )


def op9_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("row", "n_chunks")


def pipeline_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that stay, one of each group of equal texts, whatever their ids; nulls and ties as in exact_groups."""
    rows, row = numbered(docs, "dedup-rows")
    found = exact_groups(rows.select(F.col("doc_id").alias("id"), F.col("text").alias("text"), F.col(row).alias("n")), "id", "text", row_col="n")
    return without(rows, row, found.where(~F.col("kept")).select("row"), "dedup-dropped")


QUERIES = {"op9_exact_dedup": op9_exact_dedup}
SQL = {
    "op9_exact_dedup": r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""
}
