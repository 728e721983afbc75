"""Costly steps run once: what several jobs read is written and read again."""

import os

import numpy as np
import pyarrow as pa
import pytest

from loomline.operators import analytics as A
from loomline.operators import packed as K
from loomline.operators import tokens as T
from loomline.plans import mixes
from loomline.sources import tokenfiles as F
from loomline.sources import tokensource as W


def counted(df, folder):
    """df; each task that makes it leaves a file of as many bytes as it made rows."""

    def run(batches):
        for b in batches:
            with open(f"{folder}/{os.urandom(8).hex()}", "wb") as f:
                f.write(b"x" * b.num_rows)
            yield b

    return df.mapInArrow(run, df.schema)


def rows_made(folder):
    return sum(f.stat().st_size for f in folder.iterdir())


def encodes_once(spark, sf, tmp_path, monkeypatch, query):
    plain = K.encode_packed
    monkeypatch.setattr(mixes.K, "encode_packed", lambda *a, **k: counted(plain(*a, **k), str(tmp_path)))
    assert query(spark, sf).count() > 0
    assert rows_made(tmp_path) == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_windows_bpe_encodes_once(spark, sf, tmp_path, monkeypatch):
    encodes_once(spark, sf, tmp_path, monkeypatch, mixes.windows_bpe)


def test_runs_are_the_library_s_ids():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = T.tokenizer(path)
    texts = ["", "Don't ÀÉ'S we'll ... (x1y22) ßé_!", "a×b ÷ ªº", "  á ́b\tA'S  don't\n", "<|endoftext|> x<|startoftext|>y", " a b\x1fc\x85d", "ΑΣ Σ ΟΔΟΣ.", "İ 가 ᅡ", "1234 " * 9, "w" * 100 + " " + "😀" * 60, "̈́ ̈́"]
    for kept in (3, 1000):
        encode = T.Runs(path, "uint16", kept)
        assert encode.spaced
        for t in texts * 2:
            assert np.frombuffer(encode(t), "<u2").tolist() == tok.encode(t, add_special_tokens=False).ids
    small = T.Runs(path, "uint8")
    with pytest.raises(ValueError, match="doesn't fit"):
        small("hello world")


def test_mix_pack_bpe_encodes_once(spark, sf, tmp_path, monkeypatch):
    encodes_once(spark, sf, tmp_path, monkeypatch, mixes.mix_pack_bpe)


def test_pack_bpe_encodes_once(spark, sf, tmp_path, monkeypatch):
    encodes_once(spark, sf, tmp_path, monkeypatch, mixes.pack_bpe)


def test_mix_synthetic_encodes_once_without_lists(spark, sf, tmp_path, monkeypatch):
    pytest.importorskip("tiktoken")
    from loomline.plans import tokens

    plain = K.encode_ranks
    monkeypatch.setattr(tokens.K, "encode_ranks", lambda *a, **k: counted(plain(*a, **k), str(tmp_path)))
    monkeypatch.setattr(tokens.T, "encode", None)
    assert tokens.mix_synthetic(spark, sf).count() > 0
    assert rows_made(tmp_path) == spark.read.parquet(f"{sf}/documents.parquet").count() + 200


def test_packed_ids_by_ranks(spark):
    pytest.importorskip("tiktoken")
    from loomline.plans.tokens import END, _vocabulary

    rows = spark.createDataFrame([(0, "It's <|endoftext|> 中文 é"), (1, ""), (2, None), (None, "a b")], "id long, text string")
    got = {r["id"]: r["text"] for r in K.spelled(K.encode_ranks(rows, "id", "text", *_vocabulary(), END), "data", "text").collect()}
    assert got == {r["id"]: " ".join(map(str, r["ids"])) for r in T.encode(rows, "id", "text", *_vocabulary(), END).collect()}
    with pytest.raises(Exception, match="doesn't fit"):
        K.encode_ranks(rows, "id", "text", *_vocabulary(), END, "uint8").collect()


def test_cosine_pairs_shuffles_no_vectors(spark):
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(50)], "id long, v array<float>")
    plan = A.cosine_pairs(rows, "id", "v", 5)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "collect_list" not in plan


def test_a_pair_is_written_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(W, "PIECE", 64)
    lists = [list(range(i % 7)) if i % 11 else None for i in range(1000)]
    rows = spark.createDataFrame([(i // 2, x) for i, x in enumerate(lists)] + [(None, [5, 6])], "id long, ids array<long>").repartition(5)
    prefix = f"file://{tmp_path}/p"
    assert W.write_pair(rows, "id", "ids", prefix, per_document=30) == 1001
    dtype, sizes, pointers, marks = F.parse_index((tmp_path / "p.idx").read_bytes())
    assert dtype == "int32" and marks.tolist() == [*range(0, 1001, 30), 1001] and sizes.sum() * 4 == (tmp_path / "p.bin").stat().st_size
    assert (np.cumsum(np.r_[0, sizes[:-1]]) * 4 == pointers).all()
    got = {r["sample"]: r["ids"] for r in W.read_samples(spark, prefix).collect()}
    want = [*lists, [5, 6]]
    assert [sorted([got[2 * i], got[2 * i + 1]]) for i in range(500)] == [sorted([want[2 * i] or [], want[2 * i + 1] or []]) for i in range(500)] and got[1000] == [5, 6]
    assert W.write_pair(rows.limit(0), "id", "ids", f"file://{tmp_path}/none") == 0
    assert W.read_samples(spark, f"file://{tmp_path}/none").count() == 0


def test_rows_are_taken_in_small_slices(spark):
    b = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(["x" * 10_000] * 999 + ["y" * 3_000_000])], ["id", "text"])
    parts = list(T.slices(iter([b])))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([b])) and max(p.nbytes for p in parts[:-1]) <= 1 << 20 and max(p.num_rows for p in parts) <= 256


def test_the_rows_of_a_prefix_sum_move_once(spark):
    from pyspark.sql import functions as S

    from loomline.operators.ordering import running_sum

    plan = running_sum(spark.range(9).withColumn("data", S.lit("x")), ["id"], S.lit(1), "start")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan


def test_character_blocks_move_as_text(spark, sf):
    from loomline.plans import blocks, files

    for made in (blocks.QUERIES["pack_blocks"](spark, sf), files._code_blocks(spark, sf, 4096)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        below = plan[plan.rindex("Window") :]  # what is placed has no list of characters
        assert "split(" not in below
