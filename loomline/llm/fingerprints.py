"""Document fingerprints by consistent weighted sampling.

The terms of a text are its words, lower-cased in A-Z, weighted by how often they come. For each of SAMPLES samples and
each term k of weight S, r and c are drawn from Gamma(2, 1) and b from [0, 1), from a hash of the term and the number of
the sample alone; then t = floor(ln S / r + b), ln y = r (t - b) and ln a = ln c - ln y - r. The sample is the (k, t) of
the least a. Two texts share a sample with a chance of their generalised Jaccard similarity, the sum of the smaller
weights over the sum of the larger. A fingerprint holds 16 bits of a hash of each sample, so unequal samples agree with
a chance of 1 in 65,536; the share of agreeing samples is the likeness, with a standard deviation of at most 0.045.

A worker keeps what it has drawn for a (term, weight) in a table of bounded size, as most terms come again.

Null text counts as empty. A text without words has a fingerprint of its own, which is like itself (1) and like nothing
else (0). Equal texts have equal fingerprints, and so have texts with the same words as often. Very long texts are read
whole, their terms met in chunks. In the order of documents null ids come first and rows of one id by a hash of their
texts; of repeated rows each has its result. An empty table gives an empty result; a single document is its own next
one. Other columns are dropped, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import range_bucket
from .common import slices

SAMPLES = 128
#: (term, weight) pairs whose draws a worker keeps (each takes 6 bytes a sample), and pairs of a text that are met at once.
KEPT, AT_ONCE = 1 << 16, 1 << 12
#: Documents of a bucket of neighbours, about.
BUCKET_ROWS = 1024
#: What a text without words has for each sample.
NONE = np.uint16(0xFFFF)

_GOLDEN, _M1, _M2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
#: Rows that are drawn together, so that what is made of them stays in a core's cache.
_ROWS = 128


def _mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit numbers in place, one to one."""
    for shift, factor in ((30, _M1), (27, _M2)):
        x ^= x >> np.uint64(shift)
        x *= factor
    x ^= x >> np.uint64(31)
    return x


def _two(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 32-bit floats inside (0, 1) of each 64-bit number, each of 23 bits."""
    bits = words.view(np.uint32) >> np.uint32(9)
    out = bits.astype(np.float32)
    out += np.float32(0.5)
    out *= np.float32(2.0**-23)
    return out[:, 0::2], out[:, 1::2]


def draws(terms: list[bytes], weights: np.ndarray, samples: int = SAMPLES) -> tuple[np.ndarray, np.ndarray]:
    """(ln a, 16 bits of a hash of (term, t)) for each (term, weight) and sample."""
    term = np.asarray([xxhash.xxh3_64_intdigest(t) for t in terms], dtype=np.uint64)[:, None]
    seeds = _mix(term + _GOLDEN * np.arange(1, samples + 1, dtype=np.uint64))
    u, v = _two(_mix(seeds + _GOLDEN))
    r = -np.log(u * v)
    u, v = _two(_mix(seeds ^ _GOLDEN))
    ln_c = np.log(-np.log(u * v))
    b = _two(seeds)[0]
    t = np.floor(np.log(weights)[:, None] / r + b)
    code = _mix(seeds ^ (t.astype(np.int64).view(np.uint64) * _GOLDEN))
    return ln_c - r * (t - b + np.float32(1)), (code >> np.uint64(48)).astype(np.uint16)


class Sampler:
    """Fingerprints of texts. Keeps the draws of two generations of up to KEPT (term, weight) pairs: a pair of the older one
    moves up when it is met again. A pair of weight 1 goes by its term alone."""

    def __init__(self, samples: int = SAMPLES):
        self.samples = samples
        self.place: dict = {}
        self.older: dict = {}
        self.young, self.old = ((np.empty((KEPT, samples), np.float32), np.empty((KEPT, samples), np.uint16)) for _ in range(2))

    def _places(self, keys: list) -> np.ndarray:
        """Rows of the young generation that hold the pairs' draws; at most KEPT pairs at once."""
        if len(self.place) + len(keys) > KEPT:
            self.place, self.older, self.young, self.old = {}, self.place, self.old, self.young
        out = np.fromiter(map(self.place.get, keys, repeat(-1)), np.int64, len(keys))
        missing = np.flatnonzero(out < 0).tolist()
        if missing:
            new = dict.fromkeys([keys[i] for i in missing])
            again = [k for k in new if k in self.older]
            fresh = [k for k in new if k not in self.older]
            first = len(self.place)
            for at in range(0, len(again), _ROWS):
                rows = [self.older[k] for k in again[at : at + _ROWS]]
                for young, old in zip(self.young, self.old, strict=True):
                    young[first + at : first + at + len(rows)] = old.take(rows, axis=0)
            for at in range(0, len(fresh), _ROWS):
                part = [k if isinstance(k, tuple) else (k, 1) for k in fresh[at : at + _ROWS]]
                begin = first + len(again) + at
                for young, made in zip(self.young, draws([k for k, _ in part], np.asarray([n for _, n in part], np.float32), self.samples), strict=True):
                    young[begin : begin + len(part)] = made
            self.place.update(zip(again + fresh, range(first, first + len(new)), strict=True))
            out[missing] = [self.place[keys[i]] for i in missing]
        return out

    def __call__(self, texts: list[str]) -> np.ndarray:
        """A row of 16-bit numbers for each text."""
        least, codes = np.full((len(texts), self.samples), np.inf, np.float32), np.full((len(texts), self.samples), NONE)
        parts: list[tuple[int, int]] = []
        keys: list = []
        for d, t in enumerate(texts):
            counted = Counter(t.encode().lower().split())  # bytes: A-Z and ASCII white space alone
            terms = [w if n == 1 else (w, n) for w, n in counted.items()]
            for at in range(0, len(terms), AT_ONCE):
                if len(keys) + AT_ONCE > KEPT // 4:
                    self._meet(parts, keys, least, codes)
                    parts, keys = [], []
                parts.append((d, len(keys)))
                keys += terms[at : at + AT_ONCE]
        self._meet(parts, keys, least, codes)
        return codes

    def _meet(self, parts: list[tuple[int, int]], keys: list, least: np.ndarray, codes: np.ndarray) -> None:
        """Looks at chunks (text, where its keys begin); of equal least values, the smallest code counts."""
        if not parts:
            return
        places, (values, code) = self._places(keys), self.young
        for (d, begin), end in zip(parts, [p[1] for p in parts[1:]] + [len(keys)], strict=True):
            mine = places[begin:end]
            rows = values.take(mine, axis=0)
            low = rows.min(axis=0)
            row, column = np.divmod(np.flatnonzero(rows == low), self.samples)
            found = np.full(self.samples, NONE)
            np.minimum.at(found, column, code[mine[row], column])
            codes[d] = np.where(low < least[d], found, np.where(low > least[d], codes[d], np.minimum(found, codes[d])))
            np.minimum(least[d], low, out=least[d])


def likeness(a: np.ndarray, b: np.ndarray, a_empty: np.ndarray, b_empty: np.ndarray) -> np.ndarray:
    """Share of agreeing samples; texts without words are like one another alone."""
    return np.where(a_empty | b_empty, (a_empty & b_empty).astype(np.float64), (a == b).mean(axis=1))


def _empty(texts: list[str]) -> np.ndarray:
    return np.asarray([not t.strip(" \t\n\x0b\x0c\r") for t in texts], dtype=bool)


def _hex(rows: np.ndarray) -> list[str]:
    return [r.tobytes().hex() for r in rows.astype(">u2")]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """(id, fingerprint): four hexadecimal digits for each sample."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(samples)
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_hex(sampler(b.column(1).to_pylist())), pa.string())], ["id", "fingerprint"])

    return rows.mapInArrow(run, f"id {kind}, fingerprint string").withColumnRenamed("id", id_col)


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(bucket, last, id, text) of all rows, dealt by bucket and in each sorted by falling id, each followed by its next row:
    a bucket ends with a copy (last = 1) of the row that begins the next one, the last bucket with that of the first.

    Texts move once. What is copied is one row of each bucket, of which there are at most as many as range_bucket makes.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    dealt = rows.withColumn("bucket", range_bucket(rows, ["id", "h"], BUCKET_ROWS))
    key = F.struct(F.isnull("id").alias("none"), "id", "h")
    heads = dealt.groupBy("bucket").agg(F.max(key).alias("top"))
    found = sorted(heads.collect(), key=lambda r: r["bucket"])  # a row a bucket
    if not found:
        return dealt.select("bucket", F.lit(0).alias("last"), "id", "text", "h")
    # the bucket below the one of a head; the lowest is followed by the highest
    of = [(found[(i + 1) % len(found)]["bucket"], r["top"]["id"], r["top"]["h"]) for i, r in enumerate(found)]
    kind = docs.schema[id_col].dataType.simpleString()
    wanted = docs.sparkSession.createDataFrame(of, f"of int, top_id {kind}, top_h long")
    copies = rows.join(F.broadcast(wanted), rows["id"].eqNullSafe(F.col("top_id")) & (rows["h"] == F.col("top_h")))
    copies = copies.select(F.col("of").alias("bucket"), F.lit(1).alias("last"), "id", "text", "h").dropDuplicates(["bucket"])
    both = dealt.select("bucket", F.lit(0).alias("last"), "id", "text", "h").unionByName(copies)
    return both.repartition("bucket").sortWithinPartitions("bucket", "last", F.desc_nulls_first("id"), F.desc("h"))


def edited(text: str, following: str) -> str:
    """The last third of the text, in whole code points, replaced by the first as many of the next one."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row, with the next
    one's text by falling id."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = neighbours(docs, id_col, text_col).select("last", "id", "text")
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, held = Sampler(samples), None
        for b in slices(batches):
            part = b if held is None else pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            held = part.slice(part.num_rows - 1)
            texts = part.column(2).to_pylist()
            own = np.flatnonzero(part.column(0).to_numpy()[:-1] == 0)
            if not len(own):
                continue
            changed = [edited(texts[i], texts[i + 1]) for i in own.tolist()]
            prints, none = sampler(texts), _empty(texts)
            now, now_none = sampler(changed), _empty(changed)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(1).take(pa.array(own)),
                    pa.array([len(texts[i]) for i in own.tolist()], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
                    pa.array(_hex(prints[own]), pa.string()),
                    pa.array(_hex(now), pa.string()),
                    pa.array(likeness(prints[own], now, none[own], now_none)),
                    pa.array(likeness(prints[own], prints[own + 1], none[own], none[own + 1])),
                ],
                names,
            )

    schema = f"id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op13_fingerprints(spark, sf_dir: str) -> DataFrame:
    return edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


QUERIES = {"op13_fingerprints": op13_fingerprints}
SQL: dict[str, str] = {}
