"""Exact top-k inner-product search with a pivot-distance index.

A vector v gets one more coordinate, sqrt(M^2 - |v|^2) with M the largest norm, so that among unit-free distances the
nearest vectors are those with the largest inner products: |q - v|^2 = |q|^2 + M^2 - 2 q.v. Each vector is keyed by its
nearest pivot and its distance to it; the distances of a pivot are cut into annuli. For each query all annuli are sorted
by the least distance that a vector in them can have to it, by the triangle inequality. The query expands over them in
rounds, each taking more annuli than the one before; its k-th score so far gives a radius, which shrinks from round to
round, and it stops at the first annulus beyond it. Scores are exact integers below 2^53.

The pivots and the edges of the annuli come from a bounded sample: vectors with the smallest hashes, at most SAMPLE for
each pivot and SAMPLE_BYTES in all. Pivots grow with the root of the vectors' number, up to MOST_PIVOTS; with the annuli
they bound the directory of cells, which is broadcast. Every vector is indexed, and the bounds of a cell come from all of
its vectors. A cell of any size is split into blocks of about `block` vectors, each of which meets its queries on its
own. Of equal vectors only those that can be among a query's k best (the smallest ids) enter the blocks, so that one
common vector, whatever its share of the rows, fills none.

Vectors that are null or empty, or hold null or non-finite components, take no part, as candidates or as queries; nor do
null ids. A vector shorter than the longest counts as padded with zeros. Ties go to the smaller id; repeated rows are
candidates each, and a repeated query id is searched once per row and then reported once. A query's own id is never a
candidate. With fewer than k candidates all are returned. An empty table gives an empty result. Extra columns are
dropped, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, materialise, slices

#: Slack of distances, for rounding in floating point.
SLACK = 1e-6
#: Fewest and most pivots, sampled vectors of each, and bytes that the sample may have.
FEWEST_PIVOTS, MOST_PIVOTS, SAMPLE, SAMPLE_BYTES = 16, 512, 64, 32 << 20
#: A round takes so many times the annuli of the one before.
GROWTH = 8


def integer_vectors(rows: DataFrame, id_col: str, vector_col: str, factor: int = 256) -> DataFrame:
    """(id, v, norm2, largest): v = floor(factor * x) of every usable vector, as the bytes of doubles; its squared norm and
    its largest absolute component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2048):
            lengths = b.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(lengths)])
            flat = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            unfit = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
            keep = np.flatnonzero((lengths > 0) & (unfit[ends[1:]] == unfit[ends[:-1]]) & ~np.asarray(b.column(0).is_null()))
            flat = np.floor(flat * factor)
            parts = [flat[ends[i] : ends[i + 1]] for i in keep]
            cols = [b.column(0).take(pa.array(keep)), pa.array([x.astype("<f8").tobytes() for x in parts], pa.binary())]
            cols += [pa.array([float(x @ x) for x in parts], pa.float64()), pa.array([float(np.abs(x).max()) for x in parts], pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, ["id", "v", "norm2", "largest"])

    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x")).mapInArrow(run, "id long, v binary, norm2 double, largest double")


def matrix(column: pa.Array, dim: int, kind: str = "<f8") -> np.ndarray:
    """Vectors from their bytes, padded with zeros to dim components, as doubles."""
    blobs = column.to_pylist()
    width = dim * np.dtype(kind).itemsize
    return np.frombuffer(b"".join([x.ljust(width, b"\x00") for x in blobs]), dtype=kind).reshape(len(blobs), dim).astype(np.float64)


class Index:
    """Pivots and the largest norm; distances in the space with the additional coordinate."""

    def __init__(self, pivots: np.ndarray, squared_norm: float):
        self.m2 = squared_norm
        self.pivots = pivots
        self.p2 = (pivots**2).sum(1)
        self.p_extra = np.sqrt(np.maximum(self.m2 - self.p2, 0))

    def distances(self, v: np.ndarray, query: bool) -> np.ndarray:
        """Distances of vectors (or queries, whose additional coordinate is 0) to all pivots."""
        v2 = (v**2).sum(1)
        extra = np.zeros(len(v)) if query else np.sqrt(np.maximum(self.m2 - v2, 0))
        d2 = v2[:, None] + self.p2[None, :] - 2 * v @ self.pivots.T + (extra[:, None] - self.p_extra[None, :]) ** 2
        return np.sqrt(np.maximum(d2, 0))


def best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query's row, ids, scores) of the k best of a block of candidates, ties to smaller ids."""
    for i in range(len(scores)):
        s = np.where(ids == own[i], -np.inf, scores[i])
        if len(s) > k:
            worst = np.partition(s, len(s) - k)[len(s) - k]
            near = np.flatnonzero(s >= worst)
        else:
            near = np.arange(len(s))
        near = near[np.isfinite(s[near])]
        near = near[np.lexsort((ids[near], -s[near]))][:k]
        yield i, ids[near], s[near]


def sampled(stored: DataFrame, n: int, rows: int) -> pa.Table:
    """At most `rows` of n vectors, those with the smallest hash of id and vector; few more leave their tasks."""
    h = F.xxhash64("id", "v")
    few = stored.where(F.pmod(h, F.lit(1 << 30)) < int(min(1.0, 2 * rows / n) * (1 << 30)) + 1)
    return few.orderBy(F.pmod(h, F.lit(1 << 30)), "id", "v").limit(rows).select("v").toArrow()


def search(vectors: DataFrame, queries: Column, k: int = 5, pivots: int | None = None, annuli: int = 16, block: int = 2048, first_cells: int = 4) -> DataFrame:
    """(query_id, rank, vec_id, score): vectors as from integer_vectors; queries says of an id whether it is a query."""
    spark = vectors.sparkSession
    stored = materialise(vectors, "vectors")
    n, longest, norm2, largest = stored.agg(F.count(F.lit(1)), F.max(F.octet_length("v")), F.max("norm2"), F.max("largest")).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim = longest // 8
    kind = "<i2" if largest < 1 << 15 else "<i4" if largest < 1 << 31 else "<f8"
    pivots = pivots or int(min(max(math.sqrt(n) / 8, FEWEST_PIVOTS), MOST_PIVOTS))
    sample = matrix(sampled(stored, n, max(pivots, min(pivots * SAMPLE, SAMPLE_BYTES // longest)))["v"], dim)
    index = Index(np.unique(sample[:pivots], axis=0), norm2)
    d = index.distances(sample, False)
    near, d = d.argmin(1), d.min(1)
    edges = [np.unique(np.quantile(d[near == p], np.arange(1, annuli) / annuli)) if (near == p).any() else np.zeros(0) for p in range(len(index.pivots))]

    def celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2048):
            v = matrix(b.column(1), dim)
            d = index.distances(v, False)
            pivot, d = d.argmin(1), d.min(1)
            ring = np.zeros(len(pivot), dtype=np.int32)
            for p in np.unique(pivot):
                ring[pivot == p] = np.searchsorted(edges[p], d[pivot == p], side="right")
            cell = pa.array((pivot * annuli + ring).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in v.astype(kind)], pa.binary()), cell, pa.array(d)], ["id", "v", "cell", "distance"])

    # of equal vectors the k + 1 smallest ids, k rows of each: no query can have any other among its k best
    alike = W.partitionBy("v").orderBy("id")
    kept = stored.select("id", "v", F.dense_rank().over(alike).alias("place")).where(F.col("place") <= k + 1)
    kept = kept.withColumn("copy", F.row_number().over(W.partitionBy("v", "id").orderBy("id"))).where(F.col("copy") <= k)
    cells = materialise(kept.select("id", "v").mapInArrow(celled, "id long, v binary, cell int, distance double"), "cells")
    directory = cells.groupBy("cell").agg(F.min("distance").alias("lo"), F.max("distance").alias("hi"), F.count(F.lit(1)).alias("n")).orderBy("cell").toArrow()
    d_cell, d_lo, d_hi = (directory[c].to_numpy() for c in ("cell", "lo", "hi"))
    d_pivot, d_parts = d_cell // annuli, np.maximum(1, -(-directory["n"].to_numpy() // block))

    def gather(t: pa.Table) -> pa.Table:
        """One block from its rows."""
        ids = t["id"].combine_chunks().to_numpy()
        return pa.table({"cell": t["cell"].slice(0, 1), "part": t["part"].slice(0, 1), "ids": pa.array([ids.tobytes()], pa.binary()), "v": pa.array([b"".join(t["v"].to_pylist())], pa.binary())})

    parts = F.broadcast(spark.createDataFrame(list(zip(d_cell.tolist(), d_parts.tolist(), strict=True)), "cell int, parts long"))
    dealt = cells.join(parts, "cell").select("id", "v", "cell", F.pmod(F.xxhash64("id", "v"), F.col("parts")).cast("int").alias("part"))
    blocks = materialise(dealt.groupBy("cell", "part").applyInArrow(gather, "cell int, part int, ids binary, v binary"), "blocks")
    asked = materialise(stored.where(queries).select("id", "v").dropDuplicates(["id", "v"]), "queries")

    def reaching(lo: int, hi: int):
        """Blocks of queries, for each annulus between places lo and hi of a query's order that its radius reaches."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                if not b.num_rows:
                    continue
                v, ids = matrix(b.column(1), dim), b.column(0).to_numpy()
                kth = b.column(2).to_numpy(zero_copy_only=False).astype(np.float64)
                d = index.distances(v, True)[:, d_pivot]
                gaps = np.maximum(0, np.maximum(d_lo[None, :] - d, d - d_hi[None, :]))  # by the triangle inequality
                order = np.lexsort((d, gaps), axis=1)[:, lo:hi]  # by the gap, then by the distance to the pivot
                radius = np.sqrt(np.maximum((v**2).sum(1) + index.m2 - 2 * kth, 0))  # NaN, so no bound, with fewer than k so far
                near = ~(np.take_along_axis(gaps, order, axis=1) > radius[:, None] * (1 + SLACK) + SLACK)
                rows = np.repeat(np.arange(len(v)), near.sum(1))
                cells = order[near]
                by_cell = np.argsort(cells, kind="stable")
                rows, cells, v = rows[by_cell], cells[by_cell], v.astype(kind)
                cuts = np.flatnonzero(np.diff(cells, prepend=-1, append=len(d_cell)))
                spans = list(zip(cuts, cuts[1:], strict=False))
                for at in range(0, len(spans), 64):
                    some = spans[at : at + 64]
                    which = [cells[x] for x, _ in some]
                    cols = [pa.array(d_cell[which].astype(np.int32)), pa.array(d_parts[which].astype(np.int32))]
                    cols += [pa.array([m[rows[x:y]].tobytes() for x, y in some], pa.binary()) for m in (ids, v)]
                    yield pa.RecordBatch.from_arrays(cols, ["cell", "parts", "q_ids", "q_v"])

        return run

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            q_ids, q_v, ids, v = (b.column(c)[0].as_py() for c in ("q_ids", "q_v", "ids", "v"))
            q_ids, ids = np.frombuffer(q_ids, dtype=np.int64), np.frombuffer(ids, dtype=np.int64)
            scores = np.frombuffer(q_v, dtype=kind).reshape(-1, dim).astype(np.float64) @ np.frombuffer(v, dtype=kind).reshape(-1, dim).astype(np.float64).T
            found = [(np.full(len(i), q_ids[r]), i, s) for r, i, s in best(scores, ids, q_ids, k)]
            cols = [np.concatenate(x) for x in zip(*found, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1]), pa.array(cols[2].astype(np.int64))], ["query_id", "vec_id", "score"])

    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    top, lo, hi = None, 0, first_cells
    while lo < len(d_cell):
        kth = F.lit(None).cast("double")
        state = asked.select("id", "v", kth.alias("kth"))
        if top is not None:
            known = top.where(F.col("rank") == k).select(F.col("query_id").alias("q"), F.col("score").cast("double").alias("kth"))
            state = asked.join(known, F.col("id") == F.col("q"), "left").select("id", "v", "kth")
        reached = materialise(state.mapInArrow(reaching(lo, hi), "cell int, parts int, q_ids binary, q_v binary"), "reached")
        if reached.isEmpty():
            discard(reached)
            break
        spread = reached.select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "q_ids", "q_v")
        found = spread.join(blocks, ["cell", "part"]).select("q_ids", "q_v", "ids", "v").mapInArrow(scored, "query_id long, vec_id long, score long")
        found = found if top is None else found.unionByName(top.drop("rank"))
        now = materialise(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "top")
        discard(reached, *([top] if top is not None else []))
        top, lo, hi = now, hi, hi + (hi - lo) * GROWTH
    discard(stored, cells, blocks, asked)
    if top is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return top.select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def op10_pivot_topk(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(integer_vectors(rows, "vec_id", "embedding"), F.col("id") % 50 == 0)


QUERIES = {"op10_pivot_topk": op10_pivot_topk}
SQL = {
    "op10_pivot_topk": """
WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.id AS query_id, c.id AS vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.id % 50 = 0 AND q.id <> c.id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
}
