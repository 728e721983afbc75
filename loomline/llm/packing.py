"""Best-fit packing of tokenised documents by minimum bin slack.

The packing is planned over the histogram of piece lengths, which has at most `capacity` rows at any input size. Each
bin takes the longest length left and, by a bitset subset-sum over the lengths available, the fullest combination that
fits beside it; the combination is then removed, as often as the counts allow. The plan (combinations and how often
each is used) is bounded by the capacity too; pieces find their place in it by their rank among pieces of their length.
Each task ranks its own pieces of a length as they pass, and only the tasks' counts are summed over tasks, so no length,
however common, lands in one task.

Very long texts are cut into pieces one after another. Null and empty texts give one piece that holds only the end id. Repeated rows are packed each for themselves; null ids
stay null. An empty table gives an empty result. Columns other than those named are dropped.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import encode_as
from .common import free_name, materialise, slices, small_side


#: Counts of lengths in tasks that are broadcast at most; more are merged with the pieces.
MOST_BROADCAST = 65_536


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(times used, {length: pieces of it in one bin}) of every combination, in order; uses every piece once."""
    left = {n: c for n, c in counts.items() if c > 0}
    if any(n < 1 or n > capacity for n in left):
        raise ValueError("lengths must lie between 1 and the capacity")
    lengths = sorted(left)
    plan = []
    while lengths:
        longest = lengths[-1]
        gap = capacity - longest
        used = {longest: 1}
        for n, c in fullest({n: left[n] - (n == longest) for n in lengths[: bisect_left(lengths, gap + 1)]}, gap).items():
            used[n] = used.get(n, 0) + c
        times = min(left[n] // c for n, c in used.items())
        plan.append((times, used))
        for n, c in used.items():
            left[n] -= times * c
            if not left[n]:
                del left[n], lengths[bisect_left(lengths, n)]
    return plan


def fullest(counts: dict[int, int], gap: int) -> dict[int, int]:
    """{length: pieces} with the largest sum of at most gap; counts in ascending order of length, long pieces first."""
    reach, mask, layers = 1, (1 << (gap + 1)) - 1, []
    for n in reversed(counts):
        before, more, step = reach, min(counts[n], gap // n), 1
        while more > 0:
            take = min(step, more)
            reach |= (reach << (n * take)) & mask
            more -= take
            step *= 2
        if reach != before:
            layers.append((n, before))
        if reach >> gap & 1:
            break
    total, out = reach.bit_length() - 1, {}
    for n, before in reversed(layers):
        while not before >> total & 1:
            total -= n
            out[n] = out.get(n, 0) + 1
    return out


def piece_rows(ids: pa.Array, blobs: list[bytes | None], capacity: int, end_id: int, keep_ids: bool = False) -> pa.RecordBatch:
    """(id, piece, start, length, ids_crc32[, ids]) of documents' encoded ids with the end id after them."""
    end, width = np.asarray([end_id], dtype="<u4").tobytes(), 4 * capacity
    rows, piece, parts = [], [], []
    for i, blob in enumerate(blobs):
        blob = (blob or b"") + end
        for k, at in enumerate(range(0, len(blob), width)):
            rows.append(i)
            piece.append(k)
            parts.append(blob[at : at + width])
    n = np.asarray(piece, dtype=np.int32)
    cols = [
        ids.take(pa.array(rows, pa.int64())),
        pa.array(n),
        pa.array(n.astype(np.int64) * capacity),
        pa.array([len(x) // 4 for x in parts], pa.int64()),
        pa.array([zlib.crc32(x) for x in parts], pa.int64()),
        *[pa.array(parts, pa.binary())] * keep_ids,
    ]
    return pa.RecordBatch.from_arrays(cols, ["id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids])


PIECE = "piece int, start long, length long, ids_crc32 long"


def cut_pieces(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", capacity: int = 4096, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]) of every document's ids with the end id after them."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield piece_rows(b.column(0), b.column(1).to_pylist(), capacity, end_id, keep_ids)

    schema = f"id {kind}, {PIECE}" + ", ids binary" * keep_ids
    return encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(cut, schema).withColumnRenamed("id", id_col)


def encoded_pieces(docs: DataFrame, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """cut_pieces(encode(docs)) without the ids, which never leave the worker that makes them."""
    return encode_as(docs, lambda ids, blobs: piece_rows(ids, blobs, capacity, end_id), PIECE)


def ranked_by_task(pieces: DataFrame, length_col: str, capacity: int, task_col: str, rank_col: str) -> DataFrame:
    """pieces with the number of the task that read them and their rank among its pieces of their length."""
    names, at = pieces.columns, pieces.columns.index(length_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for b in batches:
            n = b.column(at).to_numpy(zero_copy_only=False).astype(np.int64)
            if len(n) and (n.min() < 1 or n.max() > capacity):
                raise ValueError("lengths must lie between 1 and the capacity")
            order = np.argsort(n, kind="stable")
            rank = np.empty(len(n), dtype=np.int64)
            rank[order] = np.arange(len(n)) - np.searchsorted(n[order], n[order])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(n), task, dtype=np.int32)), pa.array(rank + seen[n])], [*names, task_col, rank_col])
            seen += np.bincount(n, minlength=capacity + 1)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return pieces.mapInArrow(run, f"{fields}, `{task_col}` int, `{rank_col}` long")


def pack(pieces: DataFrame, length_col: str = "length", capacity: int = 4096) -> DataFrame:
    """pieces with sequence_id and offset. The pieces are written to the shared folder once, as two passes read them."""
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    task, own, size, before_col = (free_name(names, c) for c in ("__task", "__own", "__size", "__before"))
    stored = materialise(ranked_by_task(pieces.select(*names), length_col, capacity, task, own), "pieces")
    counted = materialise(stored.groupBy(F.col(length_col).cast("long").alias("__n"), F.col(task).alias("__t")).agg(F.count(F.lit(1)).alias("__count")), "lengths")
    counts = {r[0]: r[1] for r in counted.groupBy("__n").agg(F.sum("__count")).collect()}
    plan = plan_bins(counts, capacity)

    # one row for each length in a combination: from rank `first` on, `times` bins take `many` pieces each
    first, rows, base = dict.fromkeys(counts, 0), [], 0
    for times, used in plan:
        offset = 0
        for n, many in used.items():
            rows.append((n, first[n], many, base, offset))
            first[n] += times * many
            offset += n * many
        base += times
    rows.sort()
    p_n, p_first, p_many, p_base, p_offset = (np.asarray([r[i] for r in rows], dtype=np.int64) for i in range(5))
    starts = np.searchsorted(p_n, np.arange(capacity + 2))

    # one row for each length in each task
    sums = F.sum("__count").over(W.partitionBy("__n").orderBy("__t").rowsBetween(W.unboundedPreceding, -1))
    before = materialise(counted.select(F.col("__n").alias(size), F.col("__t").alias(task), F.coalesce(sums, F.lit(0)).alias(before_col)), "before")
    before = small_side(before, MOST_BROADCAST)
    known = (stored[length_col].cast("long") == before[size]) & (stored[task] == before[task])
    ranked = stored.join(before, known).select(*[stored[c] for c in names], (before[before_col] + stored[own]).alias(own))
    at = names.index(length_col)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.column(at).to_numpy().astype(np.int64)
            rank = b.column(len(names)).to_numpy().astype(np.int64)
            row = np.zeros(len(n), dtype=np.int64)
            for length in np.unique(n):
                lo, hi = starts[length], starts[length + 1]
                here = n == length
                row[here] = lo + np.searchsorted(p_first[lo:hi], rank[here], side="right") - 1
            bins, slot = np.divmod(rank - p_first[row], p_many[row])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(p_base[row] + bins), pa.array(p_offset[row] + slot * n)], [*names, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stored.select(*names).schema)
    return ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long")


def op3_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(encoded_pieces(docs))


def pipeline_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: the documents' pieces and their places. Null and empty texts give one piece, repeated rows and null
    ids are packed each for themselves, other columns are dropped, an empty table gives an empty result."""
    return pack(encoded_pieces(docs.select("doc_id", "text")))


QUERIES = {"op3_best_fit_packing": op3_best_fit_packing}
SQL: dict[str, str] = {}
