"""Periodic runs of words: Karp-Miller-Rosenberg names, grid candidates, extension by descending levels of names.

A run is a stretch of consecutive words that repeats with its smallest period q, is at least max(6, 4 q) words long and
can't be extended on either side. Words become numbers that are equal for equal words. The name of a block of 2^k
words is the number of the pair of names of its halves, so equal names mean equal blocks: nothing is hashed, and no
suffixes are sorted. A run of period q that is 4 q long or more holds a grid point i, a multiple of q, from which
2 q words equal those that come q words later: two overlapping blocks of names decide that at once. Candidates that
pass are extended to both sides by descending levels, all together in NumPy. Of equal stretches the smallest period
is kept; a stretch has a multiple of its period only together with the period itself.

Null and empty texts have no words and no runs. Repeated rows each get their result. Very long texts are read whole: a
text over a slice's size is a slice of its own, whose names take 4 bytes a word and level, of which there are at most
17 (longer matches are met in steps of 65,536 words). An empty table gives an empty result. Columns other than the id
and the text are dropped, whatever their names. Rows without an id are never rewritten by `planted`.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Fewest words of a run, and its fewest periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: The highest level of names.
TOP = 16
#: Candidates that are looked at together.
AT_ONCE = 1 << 20


class Names:
    """Names of all blocks of 2^k consecutive numbers, made level by level as they are asked for."""

    def __init__(self, numbers: np.ndarray):
        self.levels = [np.unique(numbers, return_inverse=True)[1].astype(np.int32)]

    def __len__(self) -> int:
        return len(self.levels[0])

    def level(self, k: int) -> np.ndarray:
        while len(self.levels) <= k:
            below, half = self.levels[-1], 1 << (len(self.levels) - 1)
            n = max(len(below) - half, 0)
            pairs = below[:n].astype(np.int64) * (int(below.max(initial=0)) + 1) + below[half : half + n]
            self.levels.append(np.unique(pairs, return_inverse=True)[1].astype(np.int32))
        return self.levels[k]

    def _same(self, k: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        names, out = self.level(k), np.zeros(len(a), dtype=bool)
        inside = np.flatnonzero((a >= 0) & (b < len(names)))
        out[inside] = names[a[inside]] == names[b[inside]]
        return out

    def forward(self, a: np.ndarray, b: np.ndarray, top: int) -> np.ndarray:
        """How many words from a on equal those from b on; a < b."""
        n = np.zeros_like(a)
        for k in range(top, -1, -1):
            live = np.arange(len(a))
            while len(live := live[self._same(k, a[live] + n[live], b[live] + n[live])]):
                n[live] += 1 << k
                if k < top:
                    break
        return n

    def backward(self, a: np.ndarray, b: np.ndarray, top: int) -> np.ndarray:
        """How many words before a equal those before b; a < b."""
        n = np.zeros_like(a)
        for k in range(top, -1, -1):
            live = np.arange(len(a))
            while len(live := live[self._same(k, a[live] - n[live] - (1 << k), b[live] - n[live] - (1 << k))]):
                n[live] += 1 << k
                if k < top:
                    break
        return n


def _repeats(names: Names, i: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Which grid points i start 2 q words that equal those from i + q on."""
    alive = np.arange(len(i))
    k = 1
    level_of = np.frexp(2 * q)[1] - 1  # floor(log2(2 q))
    done = []
    while len(alive):
        if k > TOP:  # longer blocks than the highest level has names for are counted out
            long = names.forward(i[alive], i[alive] + q[alive], TOP)
            done.append(alive[long >= 2 * q[alive]])
            break
        name = names.level(k)
        alive = alive[name[i[alive]] == name[i[alive] + q[alive]]]
        last = level_of[alive] == k
        ends, alive = alive[last], alive[~last]
        at = i[ends] + 2 * q[ends] - (1 << k)
        done.append(ends[name[at] == name[at + q[ends]]])
        k += 1
    return np.sort(np.concatenate(done)) if done else alive


def _firsts(i: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The first of each chain of neighbouring grid points of one period, which lie in one run."""
    new = np.ones(len(i), dtype=bool)
    new[1:] = (q[1:] != q[:-1]) | (i[1:] - i[:-1] != q[1:])
    return np.flatnonzero(new)


def _grid(names: Names, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(grid point, period) whose first word comes again one period later, in chunks; no text has more than `longest` words."""
    w, n = names.level(0), len(names)
    points, periods, held = [], [], 0
    for q in range(1, longest // LEAST_PERIODS + 1):
        reach = n - 3 * q + 1
        if reach <= 0:
            break
        hits = np.flatnonzero(w[:reach:q] == w[q : reach + q : q]) * q
        if len(hits):
            points.append(hits)
            periods.append(np.full(len(hits), q))
            held += len(hits)
        if held >= AT_ONCE:
            yield np.concatenate(points), np.concatenate(periods)
            points, periods, held = [], [], 0
    if held:
        yield np.concatenate(points), np.concatenate(periods)


def _candidates(names: Names, longest: int) -> tuple[np.ndarray, np.ndarray]:
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for i, q in _grid(names, longest):
        ok = _repeats(names, i, q)
        i, q = i[ok], q[ok]
        first = _firsts(i, q)
        found.append((i[first], q[first]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def find_runs(texts: list[np.ndarray]) -> list[np.ndarray]:
    """The runs of each text of word numbers, as rows (start, length, period) by start, then period.

    Texts are joined with a number of its own after each, which no run can cross.
    """
    sizes = np.asarray([len(t) for t in texts], dtype=np.int64)
    out = [np.zeros((0, 3), np.int64)] * len(texts)
    able = np.flatnonzero(sizes >= LEAST_WORDS)
    if not len(able):
        return out
    names, begins = _joined([texts[d] for d in able])
    i, q = _candidates(names, int(sizes.max()))
    if not len(i):
        return out
    # only texts with a candidate need the higher levels
    owner = np.searchsorted(begins, i, "right") - 1
    kept, place = np.unique(owner, return_inverse=True)
    able = able[kept]
    i = i - begins[owner]
    names, begins = _joined([texts[d] for d in able])
    i = i + begins[place]
    top = min(TOP, max(int(sizes[able].max()).bit_length() - 1, 0))
    back = names.backward(i, i + q, top)
    length = back + q + names.forward(i, i + q, top)
    ok = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * q)
    place, start, length, q = place[ok], (i - back)[ok], length[ok], q[ok]
    order = np.lexsort((q, length, start))  # of equal stretches, the smallest period comes first
    place, start, length, q = place[order], start[order], length[order], q[order]
    new = np.ones(len(start), dtype=bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    rows = np.stack([start - begins[place], length, q], axis=1)[new]
    place = place[new]
    order = np.lexsort((rows[:, 2], rows[:, 0], place))
    rows, place = rows[order], place[order]
    edges = np.searchsorted(place, np.arange(len(able) + 1))
    for d, a, b in zip(able.tolist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        out[d] = rows[a:b]
    return out


def _joined(texts: list[np.ndarray]) -> tuple[Names, np.ndarray]:
    """Names of the texts with a separator of its own after each, and where each begins."""
    most = max(int(t.max()) for t in texts) + 1
    parts = [x for d, t in enumerate(texts) for x in (t, [most + d])]
    begins = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    return Names(np.concatenate(parts)), begins


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that no run repeats: of each run only its first period stays."""
    if not len(runs):
        return b" ".join(words)
    steps = np.zeros(len(words) + 1, np.int64)
    np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
    np.add.at(steps, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(steps[:-1]) == 0).tolist()])


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of a document, for one in ten of them with a tail that repeats: h is the CRC-32 of the decimal id."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * (-(-(n - a) // p)))[: n - a]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plant: bool = False) -> DataFrame:
    """(id, n_words, runs, collapsed) of every text: runs are (start, length, period) in words, by start, then period;
    collapsed is the text without the repetitions, its words joined by single spaces. With `plant`, words are those
    of `planted`."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("data"))
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = [t.split() for t in b.column(1).to_pylist()]  # bytes split at ASCII white space alone
            if plant:
                texts = [planted(t, i) for t, i in zip(texts, b.column(0).to_pylist(), strict=True)]
            known: dict[bytes, int] = {}
            found = find_runs([np.asarray([known.setdefault(w, len(known)) for w in t], dtype=np.int64) for t in texts])
            flat = np.concatenate([*found, np.zeros((0, 3), np.int64)])
            ends = np.cumsum([0] + [len(f) for f in found]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(flat[:, j].copy()) for j in range(3)], fields=list(run)))
            left = pa.array([collapsed(t, f).decode() for t, f in zip(texts, found, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in texts], pa.int64()), lists, left], ["id", "n_words", "runs", "collapsed"])

    out = rows.mapInArrow(find, f"id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return out.withColumnRenamed("id", id_col)


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Runs of every document, its longest one, and digests of all runs and of the collapsed text."""
    found = periodic_runs(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), plant=True)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    found = found.withColumn("best", best)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


QUERIES = {"op11_periodic_runs": op11_periodic_runs}
SQL: dict[str, str] = {}
