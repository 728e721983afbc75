"""Source divergence audit: how far each source of a language is from the others, and by which terms.

A byte-level tokenizer finds terms in the concatenated UTF-8 of many texts: one lookup table of 256 bytes lower-cases A-Z
and turns every byte that is no ASCII letter and below 128 into a boundary. Slices are grouped by their xxhash and then
compared byte by byte with their group's first one; slices that only share the hash get groups of their own. Each slice
of rows becomes a sparse matrix of documents by terms, from which reduceat sums the counts and the documents of every
(language, source, term); tasks add these up before they send them.

The kept terms of a language are those of at least `least` of its documents. Their table is dealt by hash of the term
into blocks, each with the totals of all groups beside it. A block is a sparse matrix of sources by terms, in compressed
rows: for each source, reduceat sums over the rows of all others give its divergences from them, and the column sums
give the language's own counts. What blocks find is added up; no task holds more than a block and the list of groups,
and none more of the list of pairs than its tile of sources.

Null text, language and source count as empty strings, which are a language and a source as any other. Repeated rows
count each. A group without terms has its pairs, of what its smoothing gives; where a language keeps no term, their
value is 0. Ties go to the item that is smaller in UTF-8. Very long texts are read whole, a slice each. An empty table
gives an empty result. Other columns are dropped, whatever their names. All arithmetic is in whole numbers: counts may
go up to 9 * 10^15, and sums of values up to 9 * 10^18.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, slices

#: A term's share is 1 + floor(SCALE * (count + 1) / (all + kept terms)).
SCALE_STEPS, SCALE_STEP = 3, 1000
#: Documents of a language that a kept term is in, at least; ranks of terms that are returned.
LEAST_DOCUMENTS, MOST_TERMS = 3, 200
#: (group, term) pairs that a task holds before it adds them up, and terms before it sends all and starts again.
HELD_PAIRS, HELD_TERMS = 2_000_000, 500_000
#: Entries of a block at least, and sources of a tile.
BLOCK_ENTRIES, TILE = 100_000, 512

#: What each byte becomes: 0 is a boundary.
LOOKUP = np.zeros(256, dtype=np.uint8)
LOOKUP[128:] = np.arange(128, 256)
LOOKUP[97:123] = np.arange(97, 123)
LOOKUP[65:91] = np.arange(97, 123)


def slice_hash(data: bytes) -> int:
    return xxhash.xxh3_64_intdigest(data)


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, begins, ends) of all terms; text d is data[offsets[d]:offsets[d + 1]], and terms end with it."""
    low = LOOKUP[data]
    inside = low != 0
    edge = np.zeros(len(low) + 1, dtype=bool)
    edge[offsets] = True
    before = np.zeros(len(low), dtype=bool)
    before[1:] = inside[:-1]
    begins = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros(len(low), dtype=bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return low, begins, ends


def grouped(low: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """(group of each slice, one slice of each group): groups by hash, then verified byte by byte."""
    data, size = low.tobytes(), ends - begins
    hashes = np.asarray([slice_hash(data[a:b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)], dtype=np.uint64)
    _, first, group = np.unique(hashes, return_index=True, return_inverse=True)
    same = size == size[first][group]
    # every byte of a slice beside the byte at that place of its group's first one
    a, n = begins[same], size[same]
    shift = np.repeat(begins[first][group[same]] - a, n)
    at = np.repeat(a - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(len(shift)) if len(a) else np.zeros(0, np.int64)
    wrong = low[at] != low[at + shift]
    bad = np.unique(np.r_[np.flatnonzero(~same), np.flatnonzero(same)[np.unique(np.repeat(np.arange(len(a)), n)[wrong])]]).astype(np.int64)
    texts = [data[a:b] for a, b in zip(begins[first].tolist(), ends[first].tolist(), strict=True)]
    others: dict[bytes, int] = {}
    for i in bad.tolist():  # slices that share the hash of another
        t = data[begins[i] : ends[i]]
        if t not in others:
            others[t] = len(texts)
            texts.append(t)
        group[i] = others[t]
    return group, texts


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Equal keys once, with the sums of their values."""
    if not len(keys):
        return keys, *values
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    begins = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[begins], *[np.add.reduceat(v[order], begins) for v in values]


class TermCounts:
    """What a task has counted: numbers of groups and terms, and (group, term) -> occurrences, documents."""

    def __init__(self):
        self.groups: dict[tuple[str, str], int] = {}
        self.terms: dict[bytes, int] = {}
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, langs: list[str], sources: list[str], data: np.ndarray, offsets: np.ndarray) -> None:
        low, begins, ends = tokens_of(data, offsets)
        if not len(begins):
            return
        local, texts = grouped(low, begins, ends)
        # the matrix of documents by terms: its rows are documents, in each the terms with their counts
        document = np.searchsorted(offsets, begins, "right") - 1
        cells, counts = _summed(document * len(texts) + local, np.ones(len(local), np.int64))
        row, column = cells // len(texts), cells % len(texts)
        group = np.asarray([self.groups.setdefault(k, len(self.groups)) for k in zip(langs, sources, strict=True)], dtype=np.int64)
        term = np.asarray([self.terms.setdefault(t, len(self.terms)) for t in texts], dtype=np.int64)
        self.parts.append(_summed(group[row] << 32 | term[column], counts, np.ones(len(cells), np.int64)))
        self.held += len(self.parts[-1][0])
        if self.held > HELD_PAIRS:
            self.compact()

    def compact(self) -> None:
        if self.parts:
            self.parts = [_summed(*[np.concatenate(c) for c in zip(*self.parts, strict=True)])]
            self.held = len(self.parts[0][0])

    def full(self) -> bool:
        return len(self.terms) > HELD_TERMS or self.held > HELD_PAIRS

    def rows(self) -> Iterator[pa.RecordBatch]:
        """What was counted, in batches; the counts start anew."""
        self.compact()
        groups, terms = list(self.groups), list(self.terms)
        for keys, n, docs in self.parts:
            for at in range(0, len(keys), 50_000):
                k = keys[at : at + 50_000]
                g = (k >> 32).tolist()
                columns = [[groups[i][0] for i in g], [groups[i][1] for i in g], [terms[i].decode() for i in (k & 0xFFFFFFFF).tolist()]]
                yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.string()) for c in columns], pa.array(n[at : at + 50_000]), pa.array(docs[at : at + 50_000])], ["lang", "source", "term", "n", "docs"])
        self.__init__()


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in each group, and documents of it, as each task counted them."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"))], F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("data"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = TermCounts()
        for b in slices(batches):
            texts = b.column(2).to_pylist()
            offsets = np.cumsum([0] + [len(t) for t in texts])
            held.add(b.column(0).to_pylist(), b.column(1).to_pylist(), np.frombuffer(b"".join(texts), np.uint8), offsets)
            if held.full():
                yield from held.rows()
        yield from held.rows()

    return rows.mapInArrow(count, "lang string, source string, term string, n long, docs long")


def kept_terms(docs: DataFrame, least: int = LEAST_DOCUMENTS, **columns: str) -> DataFrame:
    """(lang, source, term, n) of the terms that are in at least `least` documents of their language."""
    sums = term_counts(docs, **columns).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return sums.withColumn("in_lang", F.sum("docs").over(W.partitionBy("lang", "term"))).where(F.col("in_lang") >= least).select("lang", "source", "term", "n")


def share(count: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(10^9 * count / total) in whole numbers, by long division."""
    out, rest = count // total, count % total
    for _ in range(SCALE_STEPS):
        out, rest = out * SCALE_STEP + rest * SCALE_STEP // total, rest * SCALE_STEP % total
    return 1 + out


def excess(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def block_divergences(row: np.ndarray, column: np.ndarray, n: np.ndarray, totals: np.ndarray, kept: int, names: np.ndarray, tile: range, most: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """(divergence of each source of the tile from every source, over this block's terms; its top terms as (source,
    term, value)).

    Entries are occurrences n of the term `column` in the source `row`; totals are the sources' occurrences of kept
    terms, of which the language has `kept`; names are the ranks of the terms in UTF-8 order.
    """
    size, width = len(totals), len(names)
    order = np.lexsort((column, row))
    row, column, n = row[order], column[order], n[order]
    indptr = np.searchsorted(row, np.arange(size + 1))
    smooth = totals + kept
    own, none = share(n + 1, smooth[row]), share(np.ones(size, np.int64), smooth)
    of_lang = np.zeros(width, np.int64)
    np.add.at(of_lang, column, n)
    language = share(of_lang + 1, int(totals.sum()) + kept)
    filled = np.flatnonzero(indptr[1:] > indptr[:-1])
    levels, level = np.unique(none, return_inverse=True)
    out, top = np.zeros((len(tile), size), np.int64), []
    for k, a in enumerate(tile):
        mine = slice(indptr[a], indptr[a + 1])
        p = np.full(width, none[a])
        p[column[mine]] = own[mine]
        # all terms as though the other source had none of them, then those that it has
        absent = np.asarray([excess(own[mine], q).sum() for q in levels], np.int64) + (width - (mine.stop - mine.start)) * excess(none[a], levels)
        out[k] = absent[level]
        if len(filled):
            here = p[column]
            out[k, filled] += np.add.reduceat(excess(here, own) - excess(here, none[row]), indptr[filled])
        c, value = column[mine], excess(own[mine], language[column[mine]])
        above = own[mine] > language[c]
        c, value = c[above], value[above]
        best = np.lexsort((names[c], -value))[:most]
        top += [(a, t, v) for t, v in zip(c[best].tolist(), value[best].tolist(), strict=True)]
    return out, top


RESULT = "lang string, source string, part string, item string, value long"


def _block(entries: pa.Table, groups: pa.Table, most: int, tile_size: int) -> Iterator[tuple]:
    """Rows of the result of one block and tile."""
    lists = {c: groups.column(c).to_pylist() for c in ("lang", "source", "total", "kept")}
    by_lang: dict[str, list[int]] = {}
    for i in sorted(range(groups.num_rows), key=lambda i: lists["source"][i]):
        by_lang.setdefault(lists["lang"][i], []).append(i)
    found: dict[str, np.ndarray] = {}
    if entries.num_rows:
        codes = entries.column("lang").combine_chunks().dictionary_encode()
        code = codes.indices.to_numpy()
        found = {k: np.flatnonzero(code == j) for j, k in enumerate(codes.dictionary.to_pylist())}
    at = groups.column("tile")[0].as_py()
    for lang, members in by_lang.items():
        names = [lists["source"][i] for i in members]
        tile = range(min(at * tile_size, len(members)), min((at + 1) * tile_size, len(members)))
        mine = entries.take(pa.array(found.get(lang, np.zeros(0, np.int64))))
        term = mine.column("term").combine_chunks().dictionary_encode()
        terms = term.dictionary.to_pylist()
        rank = np.empty(len(terms), np.int64)
        rank[sorted(range(len(terms)), key=terms.__getitem__)] = np.arange(len(terms))  # code points sort as their UTF-8 does
        place = {s: k for k, s in enumerate(names)}
        row = np.asarray([place[s] for s in mine.column("source").to_pylist()], np.int64)
        totals = np.asarray([lists["total"][i] for i in members], np.int64)
        kept = lists["kept"][members[0]]
        if kept:
            sums, top = block_divergences(row, term.indices.to_numpy().astype(np.int64), mine.column("n").to_numpy(), totals, kept, rank, tile, most)
        else:
            sums, top = np.zeros((len(tile), len(members)), np.int64), []
        for k, a in enumerate(tile):
            yield from ((lang, names[a], "pair", names[b], v) for b, v in enumerate(sums[k].tolist()) if b != a)
        yield from ((lang, names[a], "term", terms[t], v) for a, t, v in top)


def divergences(docs: DataFrame, least: int = LEAST_DOCUMENTS, most: int = MOST_TERMS, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank) as the module says: part `pair` for each other source of the language, part
    `term` for the `most` terms that the source has most above its language."""
    names = {"text_col": text_col, "lang_col": lang_col, "source_col": source_col}
    kept = materialise(kept_terms(docs, least, **names), "divergence-terms")
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"))]).distinct()
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sizes = kept.select("lang", "term").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("kept"))
    wide = groups.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").fillna(0, ["total", "kept"])
    wide = materialise(wide, "divergence-groups")
    # a block has as many entries as there are pairs of sources, so that what blocks send is no more than their entries
    many = wide.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.col("n") * F.col("n")).alias("pairs"), F.max("n").alias("most")).first()
    blocks = max(1, -(-kept.count() // max(BLOCK_ENTRIES, many["pairs"] or 0)))
    tiles, tile_size = max(1, -(-(many["most"] or 0) // TILE)), TILE
    every_tile = F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile")
    entries = kept.select("*", F.pmod(F.xxhash64("lang", "term"), F.lit(blocks)).cast("int").alias("block")).select("*", every_tile)
    lists = wide.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")).select("*", every_tile)

    def block(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        rows = list(_block(left, right, most, tile_size)) if right.num_rows else []
        columns = list(zip(*rows, strict=True)) or [()] * 5
        return pa.Table.from_arrays([pa.array(c, pa.int64() if i == 4 else pa.string()) for i, c in enumerate(columns)], ["lang", "source", "part", "item", "value"])

    found = entries.groupBy("block", "tile").cogroup(lists.groupBy("block", "tile")).applyInArrow(block, RESULT)
    sums = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    place = F.row_number().over(W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return sums.withColumn("rank", place).where((F.col("part") == "pair") | (F.col("rank") <= most))


def op12_source_divergence(spark, sf_dir: str) -> DataFrame:
    return divergences(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang", "source"))


QUERIES = {"op12_source_divergence": op12_source_divergence}
SQL = {
    "op12_source_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 3),
n AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
t AS (SELECT g.lang, g.source, coalesce(sum(n.n), 0)::BIGINT AS total, coalesce(any_value(v.v), 0) AS v FROM g LEFT JOIN n USING (lang, source) LEFT JOIN v USING (lang) GROUP BY g.lang, g.source),
p AS (SELECT t.lang, t.source, kept.term, coalesce(n.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n.n, 0) + 1)) // (t.total + t.v) AS p
      FROM t JOIN kept USING (lang) LEFT JOIN n USING (lang, source, term)),
l AS (SELECT n.lang, n.term, 1 + (1000000000::HUGEINT * (sum(n.n) + 1)) // (any_value(s.total) + any_value(s.v)) AS q
      FROM n JOIN (SELECT lang, sum(total) AS total, any_value(v) AS v FROM t GROUP BY lang) s USING (lang) GROUP BY n.lang, n.term),
f AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum(x.f), 0) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN (SELECT a.lang, a.source AS s, b.source AS o, ((a.p - b.p) * (a.p - b.p)) // b.p AS f FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source) x
        ON x.lang = a.lang AND x.s = a.source AND x.o = b.source GROUP BY a.lang, a.source, b.source
      UNION ALL
      SELECT p.lang, p.source, 'term', p.term, ((p.p - l.q) * (p.p - l.q)) // l.q FROM p JOIN l USING (lang, term) WHERE p.n > 0 AND p.p > l.q),
r AS (SELECT lang, source, part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM f)
SELECT * FROM r WHERE part = 'pair' OR rank <= 200
"""
}
