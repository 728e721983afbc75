"""N-gram Jaccard self-join with adaptive multi-match prefixes, reported as connected components.

A document's set holds the distinct 5-word shingles of its whole text, as 64-bit hashes. Documents with equal sets form
one class. Shingles are put in one order, rare ones first by a frequency sketch over all documents. For a set of n
shingles that must share at least T = ceil(t * n), the first n - T + l shingles are its l-prefix: two linked sets share
at least l shingles of both l-prefixes. Each class lengthens its prefix by the candidates that the sketch makes it
expect, and a pair needs as many shared prefix shingles, each within both of the shorter reaches, as the smaller l says.

Components are what counts, so links inside a known component need no pairs: first each class is verified against one
central class of its prefix shingles (a star, linear in the rows). Then, exactly, every pair of classes in different
components so far: classes around one centre, which share their shingles with one another, are compared in blocks by
signatures, a sixteenth of a set's size or less, which bound from below how far two sets differ; all others must share
enough prefix shingles whose places in the order leave room for the similarity, and pass the signatures too. Shingles
whose classes all lie around one centre drop out, so a large group of near copies forms no pairs but those that the
signatures leave, and few whole sets are sent and compared.

Null and empty texts, and texts without words, have an empty set and are linked with nothing. Repeated rows belong to
one class. Null ids take part, but never name a component unless it has no other. Very long texts are read whole, each
as one row. An empty table gives an empty result. Extra columns are dropped, whatever their names. A set's size and an
intersection err only if two shingles share a 64-bit hash; classes go by 128-bit hashes.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import attach_group, bloom_of, bloom_test, discard, materialise, numbered, slices, without

WORDS = 5
#: The frequency sketch has 2^19 to 2^24 cells (32 MB at most are broadcast), about one for each 128 bytes of input, and
#: travels in chunks of so many cells. Cells are broadcast as logarithms, so many steps to a doubling.
CELL_BITS, CHUNK, STEPS = (19, 24), 8192, 2048
#: Prefix rows that one group of them holds, and that a task holds before it sends them.
GROUP_ROWS, HELD_ROWS = 2_000_000, 150_000
#: Text that a worker makes sets of at a time, but for longer single texts: arrays of it take some fifty times as much.
TEXT_BYTES = 1 << 18
#: Pairs of one class that meet its set in one place; more are dealt over several.
PAIRS_A_PLACE = 256
#: Classes of a cluster that are compared in one block.
BLOCK = 1024
#: Expected candidates at which a class's prefix gets one shingle longer.
COSTS = (64, 1024, 16_384)
#: Bytes of the longest words that are hashed all together; longer ones go by a cryptographic hash.
LONG = 32
#: Shingles that the sketch counts so often, or so many times its mean, are dealt over groups of their own, by class.
HEAVY, HEAVY_TIMES = 20_000, 4

U = np.uint64
_rng = np.random.default_rng(5)
LETTER = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
LETTER[65:91] = LETTER[97:123]  # A-Z count as a-z
PLACE = _rng.integers(1, 1 << 63, WORDS, dtype=np.uint64) * U(2) + U(1)
BASE = U(0x9E3779B97F4A7C15)
UNBASE = U(pow(int(BASE), -1, 1 << 64))
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    if len(_powers[0]) < n:
        size = 1 << int(n - 1).bit_length()
        for i, b in enumerate((BASE, UNBASE)):
            steps = np.full(size, b, dtype=np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def long_word(word: bytes) -> int:
    """The hash of a long word: different words that a polynomial modulo 2^64 can't tell apart have hundreds of letters."""
    return int.from_bytes(hashlib.blake2b(word.lower(), digest_size=8).digest(), "little")


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data = np.frombuffer(b" ".join([b"", *texts, b""]), dtype=np.uint8)
    ends_of = np.cumsum([1 + len(t) for t in texts])  # the space before each text's successor
    space = IS_SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    first, last = edge[::2], edge[1::2]
    up, down = powers(len(data))
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(LETTER[data] * up, dtype=np.uint64)])
    word = mix((total[last] - total[first]) * down[first])
    for i in np.flatnonzero(last - first > LONG).tolist():
        word[i] = long_word(data[first[i] : last[i]].tobytes())
    bounds = np.searchsorted(first, ends_of)
    full = np.zeros(0, dtype=np.uint64)
    if len(word) >= WORDS:
        full = word[: len(word) - WORDS + 1] * PLACE[0]
        for k in range(1, WORDS):
            full = full + word[k : len(word) - WORDS + 1 + k] * PLACE[k]
        full = mix(full + U(WORDS))
    out, a = [], 0
    for b in bounds.tolist():
        n = b - a
        if n >= WORDS:
            out.append(np.unique(full[a : b - WORDS + 1]))
        elif n:
            out.append(mix((word[a:b] * PLACE[:n]).sum(dtype=np.uint64, keepdims=True) + U(n)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
        a = b
    return out


class Names:
    """64-bit keys of sets: the first half of a 128-bit hash, or its second half for the keys in `clashing`."""

    def __init__(self, bits: int = 64, clashing: frozenset[int] = frozenset()):
        self.mask = (1 << bits) - 1
        self.clashing = clashing

    def halves(self, s: np.ndarray) -> tuple[int, int]:
        d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
        first = int.from_bytes(d[:8], "little") & self.mask
        return first - (first >> 63 << 64), int.from_bytes(d[8:], "little", signed=True)

    def key(self, s: np.ndarray) -> int:
        first, second = self.halves(s)
        return second if first in self.clashing else first


def signature(s: np.ndarray) -> bytes:
    """Parities of how many hashes fall on each of 2n to 4n bits. Two sets differ by no fewer hashes than parities."""
    bits = max(64, 1 << (2 * len(s) - 1).bit_length())
    return np.packbits((np.bincount((s & U(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def folded(sign: bytes, width: int) -> np.ndarray:
    """A signature in fewer bytes: what it would be with fewer bits."""
    x = np.frombuffer(sign, dtype=np.uint64)
    while x.nbytes > width:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def least_difference(x: bytes, y: bytes) -> int:
    """A lower bound of the size of two sets' symmetric difference, from their signatures."""
    width = min(len(x), len(y))
    return int(np.bitwise_count(folded(x, width) ^ folded(y, width)).sum())


def mark_of(first: int, second: int, row_id: int | None) -> int:
    """64-bit hash of a set and of a row's id."""
    text = f"{first},{second},{row_id}"
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("data"))


def cell_bits(docs: DataFrame) -> int:
    """Bits of a cell's number, from Spark's estimate of the input's bytes; the fewest if it has none."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(max(CELL_BITS[0], (size >> 7).bit_length()), CELL_BITS[1]) if size < 1 << 60 else CELL_BITS[0]


def cells_of(s: np.ndarray, cells: int) -> np.ndarray:
    return (s >> U(65 - cells.bit_length())).astype(np.int64)


def summaries(docs: DataFrame, id_col: str, text_col: str, cells: int, names: Names) -> DataFrame:
    """(id, n, first, second, mark, sign) of every row, and chunks of each task's part of the sketch: (chunk, counts)."""
    columns = ["id", "n", "first", "second", "mark", "sign", "chunk", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(cells, dtype=np.uint32)
        for b in slices(batches, 256, TEXT_BYTES):
            sets = shingle_sets(b.column(1).to_pylist())
            at, n = np.unique(cells_of(np.concatenate(sets), cells), return_counts=True)
            counts[at] += n.astype(np.uint32)
            both = [names.halves(s) for s in sets]
            marks = [mark_of(x, y, i) for (x, y), i in zip(both, b.column(0).to_pylist(), strict=True)]
            first, second = ([h[k] for h in both] for k in (0, 1))
            cols = [b.column(0), pa.array([len(s) for s in sets], pa.int32()), *(pa.array(c, pa.int64()) for c in (first, second, marks)), pa.array([signature(s) for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([*cols, pa.nulls(b.num_rows, pa.int32()), pa.nulls(b.num_rows, pa.binary())], columns)
        for k in range(cells // CHUNK):
            part = counts[k * CHUNK : (k + 1) * CHUNK]
            if part.any():
                cols = [pa.nulls(1, t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([k], pa.int32()), pa.array([small(part)], pa.binary())], columns)

    return _texts(docs, id_col, text_col).mapInArrow(run, "id long, n int, first long, second long, mark long, sign binary, chunk int, counts binary")


def small(counts: np.ndarray) -> bytes:
    """Counts in the least number of bytes each, after that number."""
    width = next(w for w in (1, 2, 4, 8) if counts.max() < 1 << 8 * w - (w == 8))
    return bytes([width]) + counts.astype(f"<u{width}").tobytes()


def unpacked(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, dtype=f"<u{blob[0]}", offset=1).astype(np.int64)


def sketch_of(noted: DataFrame, cells: int) -> np.ndarray:
    """The sum of the tasks' parts: summed where they are read, then by chunk; one row a chunk reaches the driver.

    Each cell holds STEPS times the binary logarithm of one more than its count."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if k in total:
                    total[k] += unpacked(blob)
                else:
                    total[k] = unpacked(blob)
        for k, part in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([small(part)], pa.binary())], ["chunk", "counts"])

    def logarithms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in add(batches):
            logs = np.minimum(STEPS * np.log2(1 + unpacked(b.column(1)[0].as_py())), 65535).astype("<u2")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([logs.tobytes()], pa.binary())], ["chunk", "counts"])

    kind = "chunk int, counts binary"
    summed = noted.where("chunk IS NOT NULL").select("chunk", "counts").mapInArrow(add, kind).repartition("chunk").mapInArrow(logarithms, kind).toArrow()
    out = np.zeros(cells, dtype=np.uint16)
    for k, blob in zip(summed["chunk"].to_pylist(), summed["counts"].to_pylist(), strict=True):
        out[k * CHUNK : (k + 1) * CHUNK] = np.frombuffer(blob, dtype="<u2")
    return out


def counts_in(sketch: np.ndarray) -> np.ndarray:
    """The counts that cells of the sketch stand for."""
    return np.exp2(sketch.astype(np.float64) / STEPS) - 1


def prefixes(docs: DataFrame, id_col: str, text_col: str, sketch: np.ndarray, names: Names, percent: int, groups: int, mean: float, heavy: float, heavy_groups: int) -> DataFrame:
    """(part, blob): prefix shingles of every class, packed by the range of the shingle, or by class if it is heavy."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)
    heavy_mark = int(STEPS * np.log2(1 + heavy))
    width = U((1 << 64) // groups + 1)

    def pack(keys, sizes, reach, tokens, owner, place) -> Iterator[pa.RecordBatch]:
        keys, sizes, reach = np.asarray(keys, dtype=np.int64), np.asarray(sizes, dtype=np.int32), np.asarray(reach, dtype=np.int8)
        tokens, owner, place = np.concatenate(tokens), np.concatenate(owner), np.concatenate(place)
        part = (tokens // width).astype(np.int64)
        hot = shared.value[cells_of(tokens, len(sketch))] >= heavy_mark
        part[hot] = groups + keys[owner[hot]] % heavy_groups
        order = np.argsort(part, kind="stable")
        part, tokens, owner, place = part[order], tokens[order], owner[order], place[order]
        cuts = np.flatnonzero(np.diff(part, prepend=-1, append=np.iinfo(np.int64).max))
        parts, blobs = [], []
        for a, b in zip(cuts, cuts[1:], strict=False):
            docs_here, own = np.unique(owner[a:b], return_inverse=True)
            head = np.array([len(docs_here), b - a], dtype=np.int64)
            blobs.append(b"".join(x.tobytes() for x in (head, keys[docs_here], sizes[docs_here], reach[docs_here], tokens[a:b], own.astype(np.int32), place[a:b])))
            parts.append(int(part[a]))
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(blobs, pa.binary())], ["part", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        seen: set[int] = set()
        held: tuple[list, ...] = ([], [], [], [], [], [])
        rows = 0
        for b in slices(batches, 256, TEXT_BYTES):
            for s in shingle_sets(b.column(1).to_pylist()):
                n = len(s)
                if not n:
                    continue
                key = names.key(s)
                if key in seen:
                    continue
                if len(seen) > 2_000_000:
                    seen.clear()
                seen.add(key)
                need = -(-percent * n // 100)
                frequency = counts[cells_of(s, len(counts))]
                order = np.lexsort((s, frequency))
                base = n - need + 1
                cost = float(np.maximum(counts_in(frequency[order[:base]]) - 2 * mean, 0).sum())
                longer = min(sum(cost >= c for c in COSTS), need - 1)
                taken = order[: base + longer]
                held[0].append(key)
                held[1].append(n)
                held[2].append(1 + longer)
                held[3].append(s[taken])
                held[4].append(np.full(len(taken), len(held[0]) - 1, dtype=np.int64))
                held[5].append(np.arange(len(taken), dtype=np.int32))
                rows += len(taken)
            if rows >= HELD_ROWS:
                yield from pack(*held)
                held, rows = ([], [], [], [], [], []), 0
        if rows:
            yield from pack(*held)

    return _texts(docs, id_col, text_col).mapInArrow(run, "part int, blob binary")


def shared_prefixes(packed: DataFrame, groups: int) -> DataFrame:
    """Rows of shingles that more than one class has in its prefix: (token, key, n, reach, place)."""

    def run(t: pa.Table) -> pa.Table:
        columns: list[list] = [[], [], [], [], []]
        for blob in t.column("blob").to_pylist():
            n_docs, n = np.frombuffer(blob, dtype=np.int64, count=2)
            at, got = 16, []
            for kind, k in ((np.int64, n_docs), (np.int32, n_docs), (np.int8, n_docs), (np.uint64, n), (np.int32, n), (np.int32, n)):
                got.append(np.frombuffer(blob, dtype=kind, count=k, offset=at))
                at += got[-1].nbytes
            keys, sizes, reach, tokens, own, place = got
            for c, x in zip(columns, (tokens, keys[own], sizes[own], reach[own], place), strict=True):
                c.append(x)
        tokens, keys, sizes, reach, place = (np.concatenate(c) for c in columns)
        order = np.lexsort((keys, tokens))
        tokens, keys, sizes, reach, place = (x[order] for x in (tokens, keys, sizes, reach, place))
        new = np.ones(len(tokens), dtype=bool)
        new[1:] = tokens[1:] != tokens[:-1]
        once = new.copy()
        once[1:] |= keys[1:] != keys[:-1]  # a class that several tasks sent
        tokens, keys, sizes, reach, place, new = (x[once] for x in (tokens, keys, sizes, reach, place, new))
        group = np.cumsum(new) - 1
        keep = np.bincount(group)[group] > 1
        if t.column("part")[0].as_py() >= groups:  # other tasks have more rows of these shingles
            keep[:] = True
        cols = [tokens[keep].view(np.int64), keys[keep], sizes[keep], reach[keep].astype(np.int32), place[keep]]
        return pa.table({k: pa.array(c) for k, c in zip(("token", "key", "n", "reach", "place"), cols, strict=True)})

    return packed.groupBy("part").applyInArrow(run, "token long, key long, n int, reach int, place int")


def with_bounds(shared: DataFrame, percent: int) -> DataFrame:
    """Adds level, the least l whose prefix holds the row; before, how many shared prefix shingles its class has before
    it; rest, the class's shingles from it on; and share, the share of the class's prefix that is shared.

    What two similar classes have in common before a shared shingle lies in both prefixes, as all follow one order. So
    at any shingle that they share they have at most least(before) + least(rest) in common.
    """
    own = W.partitionBy("key")
    need = F.expr(f"cast(ceil({percent} * n / 100D) as int)")
    return shared.select(
        "token",
        "key",
        "n",
        "reach",
        F.greatest(F.lit(1), F.col("place") - (F.col("n") - need + 1) + 2).alias("level"),
        (F.row_number().over(own.orderBy("place")) - 1).alias("before"),
        (F.col("n") - F.col("place")).alias("rest"),
        (F.count(F.lit(1)).over(own) / (F.col("n") - need + F.col("reach"))).alias("share"),
    )


def possible(a: str, b: str, percent: int) -> str:
    """SQL: whether a shared shingle leaves room for the similarity; exact, every row of a similar pair passes."""
    return f"{100 + percent} * (least(before{a}, before{b}) + least(rest{a}, rest{b})) >= {percent} * (n{a} + n{b}) AND greatest(level{a}, level{b}) <= least(reach{a}, reach{b})"


#: What a row says of its class and its place in it.
ROW = ("n", "reach", "level", "before", "rest")


def star_pairs(shared: DataFrame, percent: int) -> DataFrame:
    """(a, b): each class with the most central class of its prefix shingles that it shares most with.

    Central is what has the largest share of shingles in common with others: the text that a group was copied from.
    """
    heads = shared.groupBy("token").agg(F.max(F.struct("share", "key", *ROW)).alias("h"))
    heads = heads.select(F.col("token").alias("t"), F.col("h.key").alias("a"), *[F.col(f"h.{c}").alias(f"{c}_a") for c in ROW])
    rows = shared.select("token", F.col("key").alias("b"), *[F.col(c).alias(f"{c}_b") for c in ROW])
    met = rows.join(heads, F.col("token") == F.col("t")).where(f"a <> b AND {possible('_a', '_b', percent)}")
    counts = met.groupBy("b", "a").agg(F.count(F.lit(1)).alias("c"))
    return counts.groupBy("b").agg(F.max_by("a", F.struct("c", "a")).alias("a")).select("a", "b")


def plausible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose signatures leave room for the similarity; exact, every similar pair passes."""
    side = lambda end: classes.select(F.col("key").alias(end), F.col("n").alias(f"n_{end}"), F.col("sign").alias(f"sign_{end}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "n_a", "n_b", "sign_a", "sign_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2048):
            differ = np.asarray([least_difference(x, y) for x, y in zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)], dtype=np.int64)
            total = b.column(2).to_numpy().astype(np.int64) + b.column(3).to_numpy()
            rows = pa.array(np.flatnonzero((100 + percent) * (total - differ) >= 2 * percent * total))
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows)], ["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def sets_of(docs: DataFrame, id_col: str, text_col: str, classes: DataFrame, names: Names, pairs: DataFrame) -> DataFrame:
    """(key, shingles) of each class in the pairs. The row with the smallest id alone sends its class's set.

    A Bloom filter of these rows, of bounded size, says where they are; what it lets through besides drops out in joins.
    """
    ends = pairs.select(F.explode(F.array("a", "b")).alias("k")).distinct()
    senders = classes.join(ends, F.col("key") == F.col("k")).select("least.mark")
    words = docs.sparkSession.sparkContext.broadcast(bloom_of(senders, "mark"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for b in slices(batches, 256, TEXT_BYTES):
            sets = shingle_sets(b.column(1).to_pylist())
            marks = np.asarray([mark_of(*names.halves(s), i) for s, i in zip(sets, b.column(0).to_pylist(), strict=True)], dtype=np.int64)
            keys, out = [], []
            for i in np.flatnonzero(bloom_test(words.value, marks.view(np.uint64))).tolist():
                key = names.key(sets[i])
                if len(sets[i]) and key not in sent:
                    sent.add(key)
                    keys.append(key)
                    out.append(sets[i].tobytes())
            if len(sent) > 2_000_000:
                sent.clear()
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(out, pa.binary())], ["key", "shingles"])

    rows = _texts(docs, id_col, text_col).mapInArrow(run, "key long, shingles binary")
    return rows.groupBy("key").agg(F.first("shingles").alias("shingles"))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough. The set of a class a of many pairs is sent to several places."""
    hubs = pairs.groupBy(F.col("a").alias("hub")).agg(F.floor((F.count(F.lit(1)) - 1) / PAIRS_A_PLACE).cast("int").alias("last")).where("last > 0")
    rows = pairs.join(hubs, F.col("a") == F.col("hub"), "left").select("a", "b", F.pmod(F.xxhash64("b"), F.col("last") + 1).cast("int").alias("place"))
    rows = rows.join(sets.select(F.col("key").alias("b"), F.col("shingles").alias("y")), "b")
    single = rows.where("place IS NULL").join(sets.select(F.col("key").alias("a"), F.col("shingles").alias("x")), "a")
    spread = hubs.select(F.col("hub").alias("a"), F.explode(F.sequence(F.lit(0), "last")).alias("place"))
    spread = spread.join(sets.select(F.col("key").alias("a"), F.col("shingles").alias("x")), "a")
    both = single.select("a", "b", "x", "y").unionByName(rows.join(spread, ["a", "place"]).select("a", "b", "x", "y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            rows = pa.array(np.flatnonzero(keep))
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows)], ["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(key, comp): the smallest key reachable, for every key in an edge. Alternating large and small stars."""
    now = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        # large star: every neighbour above a node goes to the node's smallest neighbour
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("w")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: a node and its neighbours below go to the smallest of them
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        next_ = large.join(small, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = materialise(next_.select("e.u", "e.v").where("u <> v").distinct(), "stars")
        state = now.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("key"), F.col("v").alias("comp")).distinct()
    return now.select(F.col("u").alias("key"), F.col("v").alias("comp")).unionByName(roots)


def clusters_of(stars: DataFrame) -> DataFrame:
    """(key, cluster) of every class in the stars: the centre four steps up. Each step leads to a more central class."""
    up = stars.select(F.col("b").alias("key"), F.col("a").alias("cluster"))
    for _ in range(2):
        above = up.select(F.col("key").alias("k"), F.col("cluster").alias("c"))
        up = up.join(above, F.col("cluster") == F.col("k"), "left").select("key", F.coalesce("c", "cluster").alias("cluster"))
    up = materialise(up, "clusters")
    tops = stars.select(F.col("a").alias("key")).distinct().join(up, "key", "left_anti").select("key", F.col("key").alias("cluster"))
    return up.unionByName(tops)


def cluster_pairs(known: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes of one cluster and different components whose signatures leave room for the similarity.

    All classes of a cluster are compared, in blocks of about BLOCK of them, but only such pairs leave a block. A cluster
    of two is a star, whose pair is known; clusters of one component have no such pair and are not sent at all.
    """
    sizes = known.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("size > 2 AND low <> high").select(F.col("cluster").alias("c"), F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    rows = known.join(sizes, F.col("cluster") == F.col("c")).select(F.col("key").alias("k"), "comp", "cluster", "blocks", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int").alias("own"))
    rows = rows.join(classes, F.col("k") == F.col("key")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "key", "comp", "n", "sign")

    def compare(key, comp, own, n, sign, crossed: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Survivors among the rows of two blocks (crossed: one of each), or of one."""
        width = np.asarray([len(x) for x in sign])
        for w in np.unique(width):
            wide = np.flatnonzero((width == w) | (width == 2 * w))  # others differ too much in size
            bits = np.stack([folded(sign[x], int(w)) for x in wide])
            for p in range(len(wide)):
                x = wide[p]
                if width[x] != w:
                    continue
                total = n[x] + n[wide]
                may = (comp[wide] != comp[x]) & ((width[wide] > w) | (wide > x)) & (100 * np.minimum(n[x], n[wide]) >= percent * np.maximum(n[x], n[wide]))
                if crossed:
                    may &= own[wide] != own[x]
                q = np.flatnonzero(may)
                if len(q):
                    differ = np.bitwise_count(bits[q] ^ bits[p]).sum(1, dtype=np.int64)
                    q = wide[q[(100 + percent) * (total[q] - differ) >= 2 * percent * total[q]]]
                    if len(q):
                        yield np.minimum(key[x], key[q]), np.maximum(key[x], key[q])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None

        def close() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            key, comp, own, n = (t[c].to_numpy().astype(np.int64) for c in ("key", "comp", "own", "n"))
            if now[1] != now[2] and (own == own[0]).all():
                return
            for a, b in compare(key, comp, own, n, t["sign"].to_pylist(), now[1] != now[2]):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            c, i, j = (batch.column(x).to_numpy() for x in ("cluster", "i", "j"))
            cuts = np.flatnonzero((c[1:] != c[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            for x, y in zip([0, *cuts.tolist()], [*cuts.tolist(), len(c)], strict=True):
                if x == y:
                    continue
                if now is not None and now != (c[x], i[x], j[x]):
                    yield from close()
                    held = []
                now = (c[x], i[x], j[x])
                held.append(batch.slice(x, y - x))
        if held:
            yield from close()

    return rows.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j").mapInArrow(run, "a long, b long")


def crossing_pairs(shared: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes in different components and clusters that share enough prefix shingles."""
    known = known.select(F.col("key").alias("k"), "comp", "cluster")
    rows = shared.join(known, F.col("key") == F.col("k"), "left").select("token", "key", *ROW, F.coalesce("comp", "key").alias("comp"), F.coalesce("cluster", "key").alias("cluster"))
    counted = rows.groupBy("token", "cluster").agg(F.count(F.lit(1)).alias("c"))
    mixed = counted.groupBy("token").agg(F.max_by("cluster", F.struct("c", "cluster")).alias("main"), F.count(F.lit(1)).alias("k")).where("k > 1")
    rows = materialise(rows.join(mixed.select(F.col("token").alias("t"), "main"), F.col("token") == F.col("t")).drop("t"), "mixed")
    # within a shingle: rows outside its largest cluster against all rows of other clusters
    columns = ("key", *ROW, "comp", "cluster")
    few = rows.where("cluster <> main").select("token", *[F.col(c).alias(f"{c}_a") for c in columns])
    all_ = rows.select("token", "main", *[F.col(c).alias(f"{c}_b") for c in columns])
    met = few.join(all_, "token").where(f"cluster_a <> cluster_b AND comp_a <> comp_b AND (cluster_b = main OR key_a < key_b) AND {possible('_a', '_b', percent)}")
    counts = met.groupBy(F.least("key_a", "key_b").alias("a"), F.greatest("key_a", "key_b").alias("b")).agg(F.count(F.lit(1)).alias("c"), F.min(F.least("reach_a", "reach_b")).alias("need"))
    return counts.where("c >= need").select("a", "b")


def named_rows(noted: DataFrame, names: Names) -> DataFrame:
    """(id, n, key, mark, sign) of every row; keys that stand for two different 128-bit hashes, a handful at any size, are
    replaced and put into names."""
    rows = noted.where("n IS NOT NULL")
    two = rows.where("n > 0").groupBy("first").agg(F.min("second").alias("x"), F.max("second").alias("y")).where("x <> y")
    names.clashing = frozenset(r[0] for r in two.select("first").collect())
    key = F.when(F.col("first").isin(*names.clashing), F.col("second")).otherwise(F.col("first")) if names.clashing else F.col("first")
    return rows.select("id", "n", key.alias("key"), "mark", "sign")


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, key_bits: int = 64) -> DataFrame:
    """(id, n_shingles, component_id) of every row."""
    cells, names = 1 << cell_bits(docs), Names(key_bits)
    noted = materialise(summaries(docs, id_col, text_col, cells, names), "summaries")
    table = named_rows(noted, names)
    sketch = sketch_of(noted, cells)
    classes = materialise(table.where("n > 0").groupBy("key").agg(F.first("n").alias("n"), F.min(F.struct("id", "mark")).alias("least"), F.first("sign").alias("sign")), "classes")
    counts = counts_in(sketch)
    rows_in = lambda some: max(16, int(some.sum() * (100 - percent + 10) / 100 / GROUP_ROWS))
    mean = float(counts.mean())
    heavy = max(HEAVY, HEAVY_TIMES * mean)
    groups, heavy_groups = rows_in(counts), rows_in(counts[counts >= heavy])
    del counts

    def linked(*likely: DataFrame) -> DataFrame:
        """Of the pairs that the signatures left, those whose whole sets are similar."""
        pairs = materialise(functools.reduce(DataFrame.unionByName, likely), "likely")
        links = materialise(verified(pairs, sets_of(docs, id_col, text_col, classes, names, pairs), percent), "links")
        discard(pairs)
        return links

    packed = prefixes(docs, id_col, text_col, sketch, names, percent, groups, mean, heavy, heavy_groups)
    prefix_rows = materialise(shared_prefixes(packed, groups), "prefixes")
    shared = materialise(with_bounds(prefix_rows, percent), "bounds")
    # links inside components: every class against the most central class of its shingles
    stars = materialise(star_pairs(shared, percent), "stars")
    links = linked(plausible(stars, classes, percent))
    comps = materialise(components(links), "components")
    # links across components: inside each cluster of stars, then across clusters
    known = clusters_of(stars).join(comps.select(F.col("key").alias("k"), "comp"), F.col("key") == F.col("k"), "left")
    known = materialise(known.select("key", "cluster", F.coalesce("comp", "key").alias("comp")), "known")
    more = linked(cluster_pairs(known, classes, percent), plausible(crossing_pairs(shared, known, percent), classes, percent))
    if not more.isEmpty():
        comps = materialise(components(links.unionByName(more)), "components")

    named = table.where("n > 0").join(comps.select(F.col("key").alias("k"), "comp"), F.col("key") == F.col("k"), "left")
    named = materialise(named.select("id", "n", F.coalesce("comp", "key").alias("comp"), F.monotonically_increasing_id().alias("row")), "named")
    discard(prefix_rows, shared, classes, stars, known, links, more, comps)
    linked_rows = attach_group(named, ["comp"], {"m": F.min("id")}, {"component_id": F.min("m")}, salt_on=F.col("row")).select("id", "n", "component_id")
    alone = table.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return linked_rows.unionByName(alone).select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), "component_id")


def op5_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def pipeline_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component: that with the smallest id, null ids last, then the first of them. Nulls, empty and
    repeated texts are treated as by near_components; an empty text is alone in its component and always stays."""
    rows, row = numbered(docs, "jaccard-rows")
    found = materialise(near_components(rows, row), "jaccard-found").where("n_shingles > 0")
    ids = found.join(rows.select(row, F.col("doc_id").alias("__id")), row)
    place = F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), F.col(row).alias("row"))
    first = ids.groupBy("component_id").agg(F.min(place)["row"].alias("stays"))
    return without(rows, row, found.join(first, F.col(row) == F.col("stays"), "left_anti").select(row), "jaccard-dropped")


QUERIES = {"op5_jaccard_join": op5_jaccard_join}
SQL: dict[str, str] = {}


def brute_force(texts: dict[int, str | None], percent: int = 80) -> dict[int, tuple[int, int]]:
    """id -> (size of the set, component) by comparing all pairs, for tests."""
    import re
    import string

    lower = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets[i] = {tuple(w[k : k + WORDS]) for k in range(len(w) - WORDS + 1)} if len(w) >= WORDS else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}
