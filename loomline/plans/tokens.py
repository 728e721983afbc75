"""Queries of tokenizers, names of store files, and mixed synthetic data."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.draws import draw_hash
from ..operators import packed as K
from ..operators import synthesis as Y
from ..operators import tokens as T
from ..operators.ordering import hash_bucket, rank
from ..session import table
from ..sources.workspace import stored

END = 50256


def _vocabulary():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def bpe_encode(s, d):
    return T.encode(table(s, d, "documents"), "doc_id", "text", *_vocabulary(), END).select("doc_id", F.col("len").cast("bigint").alias("n_tokens"), F.element_at("ids", -1).alias("last_id"))


def bpe_round_trip(s, d):
    ids = T.encode(table(s, d, "documents"), "doc_id", "text", *_vocabulary(), END)
    return T.decode(ids, "doc_id", "ids", *_vocabulary(), END).select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def qa_separate(s, d):
    codes = lambda t: F.transform(F.filter(F.split(t, ""), lambda x: x != ""), lambda x: F.ascii(x))
    q, a, n = T.separate_pair(codes("c_name"), codes("c_mktsegment"), 0)
    return table(s, d, "customer").select("c_custkey", F.size(q).cast("bigint").alias("n_question"), F.size(T.truncated(a, 8)).cast("bigint").alias("n_answer"), n.cast("bigint").alias("len"))


def store_files(s, d):
    names = table(s, d, "embeddings").select(F.format_string("topk_step%07d_rank%d_%d.npz", F.expr("vec_id div 50"), F.expr("cast(vec_id % 5 as int)"), F.col("vec_id") * 13).alias("file"))
    part = lambda p: F.regexp_extract("file", p, 1).cast("bigint")
    return names.select("file", part(r"step(\d+)").alias("step"), part(r"rank(\d+)").alias("rank"), part(r"_(\d+)\.npz").alias("ts"))


def mix_synthetic(s, d):
    """Synthetic and real text, each encoded and cut into blocks of 128 tokens; all blocks with their places in a seeded shuffle."""
    made = Y.arithmetic(s, 200, 99, 3).select("id", "text")
    real = table(s, d, "documents").select(F.col("doc_id").alias("id"), "text")
    # encoded once and cut once: placing and ranking read their rows several times

    def blocks(rows, kind):
        coded = stored(K.encode_ranks(rows, "id", "text", *_vocabulary(), END), "encoded")
        cut = K.spelled(K.pack_stream(coded, "id", "data", 128, 2).select("block", "n_docs", "data"), "data", "ids")
        return cut.select(F.concat(F.lit(kind), F.col("block").cast("string")).alias("key"), F.md5(F.col("ids").cast("binary")).alias("md5"), "n_docs")

    mixed = stored(blocks(made, "s").unionByName(blocks(real, "d")).withColumn("h", draw_hash(42, F.col("key"))), "mixed")
    return rank(mixed, ["h", "key"], bucket=hash_bucket(mixed, "h")).select("rank", "key", "md5", "n_docs")


QUERIES = {"bpe_encode": bpe_encode, "bpe_round_trip": bpe_round_trip, "qa_separate": qa_separate, "store_files": store_files, "mix_synthetic": mix_synthetic}
SQL = {
    "bpe_round_trip": "SELECT doc_id, md5(text) AS text_md5 FROM documents",
    "qa_separate": "SELECT c_custkey, length(c_name) + 1 AS n_question, least(length(c_mktsegment) + 1, 8) AS n_answer, length(c_name) + length(c_mktsegment) + 2 AS len FROM customer",
    "store_files": "SELECT printf('topk_step%07d_rank%d_%d.npz', vec_id // 50, vec_id % 5, vec_id * 13) AS file, vec_id // 50 AS step, vec_id % 5 AS rank, vec_id * 13 AS ts FROM embeddings",
}
