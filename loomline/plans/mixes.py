"""Queries of the packing mixer, packed streams of ids, and the shuffle in closed form.

Where SQL has to say the same, the ids are the bytes of UTF-8, which DuckDB can cut as hexadecimal digits; queries named
_bpe run on ids of a vocabulary and are held against plain Python."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.draws import sql_uniform
from ..functions.permutation import permuted, sql_landed, sql_walk
from ..operators import mixer as M
from ..operators import packed as K
from ..operators.ordering import rank
from ..session import table
from ..sources.workspace import stored

c = F.col
LENGTH, WINDOW = 513, 300
END_ID = 0
SHUFFLE_SEED = 5


def _path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _bytes(s, d):
    return table(s, d, "documents").select("doc_id", "source", c("text").cast("binary").alias("data"))


def _encoded(s, d):
    """Ids with an end id after each text, encoded once: placing a stream reads its rows several times."""
    return stored(K.encode_packed(table(s, d, "documents"), "doc_id", "text", _path(), END_ID), "encoded")


def _ids(s, d):
    docs = table(s, d, "documents").select(F.struct("doc_id", "source").alias("key"), "text")
    return stored(K.encode_packed(docs, "key", "text", _path()).select("key.doc_id", "key.source", "data"), "encoded")


def _weights(s, d):
    """Every source, weighted by its rows modulo 7, and one."""
    return table(s, d, "documents").groupBy("source").agg((F.count(F.lit(1)) % 7 + 1).cast("double").alias("weight"))


def _mixed(rows, weights, width):
    """As many sequences as the corpus would fill."""
    total = rows.agg(F.sum(K.size("data", width) + 1)).first()[0]
    sequences = -(-total // LENGTH)
    return M.mix(rows, "source", "doc_id", "data", weights, "weight", sequences, LENGTH, END_ID.to_bytes(width, "little"), 31), sequences


def _blocks(rows, sequences):
    return rows.select(c("block").cast("bigint").alias("block"), F.md5("data").alias("md5"), "n_docs", M.marks(sequences).alias("ends"))


def mix_pack(s, d):
    (_, packed), sequences = _mixed(_bytes(s, d), _weights(s, d), 1)
    return _blocks(packed, sequences)


def mix_usage(s, d):
    weights = _weights(s, d)
    (draws, _), _ = _mixed(_bytes(s, d), weights, 1)
    return M.usage(draws, weights, "source", "weight").select("source", "n", *[F.round(x, 6).alias(x) for x in ("used", "expected", "difference")])


def mix_pack_bpe(s, d):
    (_, packed), sequences = _mixed(_ids(s, d), _weights(s, d), 2)
    return _blocks(packed, sequences)


def _windows(rows, width, block=1024):
    from ..operators.blocks import window_starts

    n = rows.agg(F.sum(K.size("data", width))).first()[0] or 0
    starts = window_starts(rows.sparkSession, F.lit(n), WINDOW, 4, -(-n // (4 * WINDOW)) + 1)  # once through the stream and round its end
    got = K.gather_packed(starts, K.pack_stream(rows, "doc_id", "data", block, width, keep_rest=True), block, WINDOW + 1, n, width)
    x, y = K.shift_packed("data", width)
    return got.select("rank", "step", "start", F.md5(x).alias("x_md5"), F.md5(y).alias("y_md5"))


def _with_end(rows, width):
    return rows.withColumn("data", F.concat("data", F.lit(END_ID.to_bytes(width, "little"))))


def pack_bytes(s, d):
    packed = K.pack_stream(_with_end(_bytes(s, d), 1), "doc_id", "data", LENGTH, 1)
    return packed.select(c("block").cast("bigint").alias("block"), F.md5("data").alias("md5"), "n_docs")


def pack_bpe(s, d):
    packed = K.pack_stream(_encoded(s, d), "doc_id", "data", LENGTH, 2)
    return packed.select(c("block").cast("bigint").alias("block"), F.md5("data").alias("md5"), "n_docs")


def windows_bytes(s, d):
    return _windows(_with_end(_bytes(s, d), 1), 1)


def windows_bpe(s, d):
    return _windows(_encoded(s, d), 2)


def batch_permuted(s, d):
    """Batches of 48 in a shuffle that sorts nothing: each row's place follows from its number."""
    docs = table(s, d, "documents").select("doc_id")
    n = docs.count()
    placed = rank(docs, ["doc_id"], "number").withColumn("spot", permuted(c("number"), max(n, 1), SHUFFLE_SEED))
    return placed.select("doc_id", F.expr("spot div 48").alias("batch"), (c("spot") % 48).alias("place"))


def permuted_head(s, d):
    """The first rows of that shuffle, found by its inverse: no other row is ranked or moved."""
    docs = table(s, d, "documents").select("doc_id", "lang")
    n = docs.count()
    wanted = s.range(min(n, 100)).select(c("id").alias("spot"), permuted(c("id"), max(n, 1), SHUFFLE_SEED, inverse=True).alias("number"))
    return rank(docs, ["doc_id"], "number").join(F.broadcast(wanted), "number").select("spot", "doc_id", "lang")


QUERIES = {
    "mix_pack": mix_pack, "mix_usage": mix_usage, "mix_pack_bpe": mix_pack_bpe, "pack_bytes": pack_bytes, "pack_bpe": pack_bpe,
    "windows_bytes": windows_bytes, "windows_bpe": windows_bpe, "batch_permuted": batch_permuted, "permuted_head": permuted_head,
}

_H = "t AS (SELECT doc_id, source, hex(encode(text)) || '00' AS h, octet_length(encode(text)) + 1 AS n FROM documents)"
_W = "w AS (SELECT source, (count(*) % 7 + 1)::DOUBLE AS weight FROM documents GROUP BY source), iv AS (SELECT source, hi, coalesce(lag(hi) OVER (ORDER BY source), 0.0) AS lo FROM (SELECT source, sum(weight) OVER (ORDER BY source) / sum(weight) OVER () AS hi FROM w))"
_MIX = f"""WITH {_H}, {_W}, z AS (SELECT (ceil(sum(n) / {LENGTH}.0))::BIGINT AS sequences FROM t),
p AS (SELECT *, row_number() OVER (ORDER BY source, doc_id) - 1 AS place FROM t), f AS (SELECT source, min(place) AS first, count(*) AS size FROM p GROUP BY source),
k AS (SELECT draw, iv.source, first + floor(v * size)::BIGINT AS place FROM (SELECT i AS draw, {sql_uniform(31, 'i')} AS u, {sql_uniform(32, 'i')} AS v FROM range((SELECT 6 * count(*) + 100 FROM documents)) r(i)) JOIN iv ON u >= lo AND u < hi JOIN f ON f.source = iv.source),
s AS (SELECT draw, k.source, h, n, coalesce(sum(n) OVER (ORDER BY draw ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM k JOIN p USING (place)),
u AS (SELECT s.*, least(start + n, sequences * {LENGTH}) AS stop, sequences FROM s, z WHERE start < sequences * {LENGTH}),
"""


def _cut(rows: str, block: int) -> str:
    """Blocks of hexadecimal text from rows (h, start, stop)."""
    return f"""r AS (SELECT *, unnest(range(start // {block}, (stop - 1) // {block} + 1)) AS block FROM {rows} WHERE stop > start),
b AS (SELECT block::BIGINT AS block, string_agg(substr(h, (2 * (greatest(block * {block}, start) - start) + 1)::BIGINT, (2 * (least((block + 1) * {block}, stop) - greatest(block * {block}, start)))::BIGINT), '' ORDER BY start) AS h, count(*) AS n_docs FROM r GROUP BY block)
"""


_PLACED = "p AS (SELECT h, n, coalesce(sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM t), q AS (SELECT *, start + n AS stop FROM p)"


def _shuffled(select: str) -> str:
    """Rows (number, spot) of the shuffle as `placed`, and the documents with their numbers as `d`."""
    return f"""WITH RECURSIVE {sql_walk("SELECT count(*) AS n FROM documents", SHUFFLE_SEED)},
placed AS (SELECT number, (a << low | b) AS spot FROM walk, g WHERE {sql_landed}), d AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS number FROM documents)
{select}"""


SQL = {
    "mix_pack": _MIX + _cut("u", LENGTH) + ", e AS (SELECT block, md5(unhex(h)) AS md5, n_docs FROM b) SELECT block, md5, n_docs, (block + 1) % 100 = 0 OR block = sequences - 1 AS ends FROM e, z",
    "mix_usage": _MIX + "n AS (SELECT source, count(*) AS n FROM u GROUP BY source) SELECT w.source, coalesce(n, 0) AS n, round(coalesce(n, 0) / sum(coalesce(n, 0)) OVER (), 6) AS used, round(weight / sum(weight) OVER (), 6) AS expected, round(coalesce(n, 0) / sum(coalesce(n, 0)) OVER () - weight / sum(weight) OVER (), 6) AS difference FROM w LEFT JOIN n USING (source)",
    "pack_bytes": f"WITH {_H}, {_PLACED}, " + _cut("q", LENGTH) + f"SELECT block, md5(unhex(h)) AS md5, n_docs FROM b WHERE length(h) = {2 * LENGTH}",
    "windows_bytes": f"WITH t AS (SELECT string_agg(hex(encode(text)) || '00', '' ORDER BY doc_id) AS h, sum(octet_length(encode(text)) + 1)::BIGINT AS total FROM documents), w AS (SELECT i % 4 AS rank, i // 4 AS step, (i * {WINDOW}) % total AS start, h || left(h, 1000) AS s FROM t, range((SELECT (ceil(total / {4 * WINDOW}.0)::BIGINT + 1) * 4 FROM t)) r(i)) SELECT rank, step, start, md5(unhex(substr(s, 2 * start + 1, {2 * WINDOW}))) AS x_md5, md5(unhex(substr(s, 2 * start + 3, {2 * WINDOW}))) AS y_md5 FROM w",
    "batch_permuted": _shuffled("SELECT doc_id, spot // 48 AS batch, spot % 48 AS place FROM placed JOIN d USING (number)"),
    "permuted_head": _shuffled("SELECT spot, doc_id, lang FROM placed JOIN d USING (number) WHERE spot < 100"),
}
