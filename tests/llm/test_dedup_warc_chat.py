import re
import struct

import pytest
from pyspark.sql import functions as F

from loomline.llm import chat, dedup, warc


def test_chunks_join_to_the_text():
    data = bytes(range(256)) * 300
    assert b"".join(dedup.chunks(data)) == data
    assert all(len(c) <= dedup.MOST for c in dedup.chunks(data))
    assert dedup.chunks(b"") == []


def squeezed(t):
    return re.sub("[\x20\x09-\x0d]", "", t or "")


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(squeezed(t), []).append((-len(t or ""), i))
    best = {k: min(v)[1] for k, v in groups.items()}
    return sorted((i, best[squeezed(t)], len(groups[squeezed(t)])) for i, t in rows)


@pytest.mark.parametrize("id_bytes", [1, 16])
def test_groups_against_brute_force(spark, id_bytes):
    """One byte of identifier makes chunks collide, so the operator must lengthen them."""
    long = "".join(chr(97 + i * i % 23) for i in range(5000))
    rows = [(i, t) for i, t in enumerate([None, "", "  \n", "a b", "ab", "a  b", "abc", "é ü", "éü", long, long + " ", "x" + long, long[:4000], *[f"text {i % 40}" for i in range(120)]])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("recipe", F.lit(1))
    out = dedup.exact_groups(df, id_bytes=id_bytes).collect()
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"]) for r in out) == brute(rows)
    assert sum(r["kept"] for r in out) == len({squeezed(t) for _, t in rows})


def test_repeated_rows_keep_one(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a")], "doc_id long, text string")
    out = dedup.exact_groups(df).collect()
    assert sum(r["kept"] for r in out) == 1 and {r["keep_id"] for r in out} == {1}
    assert dedup.exact_groups(df.limit(0)).count() == 0
    docs = df.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.lit(1)})
    assert [r["doc_id"] for r in dedup.pipeline_stage(spark, docs, "").collect()] == [1]


def test_archive_round_trip_and_damage():
    records = [warc.record(i, f"http://x/{i}", b"<p>%d</p>" % i * 30, 30 * len(b"<p>%d</p>" % i), "0" * 64, None) for i in range(50)]
    data = warc.archive(records)
    assert struct.unpack_from("<I", data)[0] == warc.SKIPPABLE_DICTIONARY
    got = list(warc.read_archive(data))
    assert len(got) == 50 and got[7][0]["X-Page-Id"] == "7"
    for bad in (data[:-3], data[8:], data[:40] + b"\x00" + data[41:], b""):
        with pytest.raises(ValueError):
            for headers, block in warc.read_archive(bad):
                warc.payload_of(headers, block)
            raise ValueError("only the dictionary was hit")
    assert len(list(warc.read_archive(warc.archive(records[:1])))) == 1


def test_header_and_length_checks():
    good = warc.record(1, "http://x", b"abc", 3, "0" * 64, 5)
    headers, block = warc.parse_record(good)
    assert headers["WARC-Type"] == "revisit" and warc.payload_of(headers, block) == (3, b"")
    for bad in (good[:-1], good.replace(b"WARC/1.1", b"WARC/9.9"), good.replace(b"WARC-Date", b"WARC Date"), good.replace(b"WARC-Type", b"X-Type")):
        with pytest.raises(ValueError):
            warc.parse_record(bad)


def test_revisits(spark):
    big = "é" * 80
    rows = [(1, "u", None), (2, "u\r\nx: y", big), (3, "u", big), (4, "u", "short"), (5, None, "short"), (0, "u", big), (None, "u", big), (7, "u", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    out = {r["page_id"]: r for r in warc.round_trip(df).collect()}
    assert len(out) == 8
    assert (out[0]["record_type"], out[2]["record_type"], out[2]["refers_to"], out[None]["refers_to"]) == ("response", "revisit", 0, 0)
    assert out[4]["record_type"] == out[5]["record_type"] == "response" and out[2]["n_bytes"] == 160
    assert bytes(out[0]["payload"]).decode() == big and bytes(out[1]["payload"]) == b""
    assert warc.round_trip(df.limit(0)).count() == 0


def test_preferences(spark):
    turns = [(0, 0, "user", "hi"), (0, 1, "assistant", "a"), (0, 2, "user", "b"), (1, 0, "user", "hi"), (1, 1, "assistant", "c"), (2, 0, "user", "alone"), (3, 0, "user", "alone"), (4, 0, None, None), (None, 0, "user", "x"), (4, None, "user", "x")]
    conv = chat.conversations_of(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("pair_id", F.lit(0)))
    rows = {r["conv_id"]: r["turns"] for r in conv.collect()}
    pairs = spark.createDataFrame([(0, rows[0], rows[1]), (1, rows[2], rows[3]), (2, rows[4], None)], "pair_id long, chosen array<struct<turn:bigint,role:string,text:string>>, rejected array<struct<turn:bigint,role:string,text:string>>")
    out = {r["pair_id"]: r for r in chat.format_preferences(pairs).collect()}
    assert out[0]["prompt"] == "<|user|>\nhi<|end|>\n" and [s["mask"] for s in out[0]["chosen"]] == [1, 0] and [s["mask"] for s in out[0]["rejected"]] == [1]
    assert out[1]["n_prompt"] == 1 and out[1]["chosen"] == [] and out[1]["rejected"] == []
    assert out[2]["n_prompt"] == 0 and len(out[2]["chosen"]) == 1 and out[2]["rejected"] == []


def test_revisits_must_match_their_response():
    digest = "a" * 64
    headers, block = warc.parse_record(warc.record(4, "http://x", b"", 120, digest, 2))
    assert headers["WARC-Refers-To"] == warc.record_name(2, digest)
    assert warc.parse_record(warc.record(2, "http://x", b"x" * 120, 120, digest, None))[0]["WARC-Record-ID"] == headers["WARC-Refers-To"]
    with pytest.raises(ValueError):
        warc.payload_of({k: v for k, v in headers.items() if k != "WARC-Refers-To"}, block)
    with pytest.raises(ValueError):
        warc.payload_of(headers | {"WARC-Payload-Digest": "sha-256:" + "b" * 64}, block)


def test_preference_query_on_odd_tables(spark, tmp_path):
    """Negative, null and repeated ids, equal turn numbers, clashing columns, and an empty table."""
    kind = "conv_id long, turn long, role string, text string, pair_id int, chosen int"
    rows = [(-2, 0, "user", "a", 1, 1), (-1, 0, "user", "a", 1, 1), (-1, 1, "assistant", "b", 1, 1), (1, 0, "user", "z", 1, 1), (None, 0, "user", "n", 1, 1), (4, 0, "user", "x", 1, 1), (4, 0, "user", "w", 1, 1), (4, 0, "user", "w", 1, 1), (5, 0, "user", "w", 1, 1), (5, 0, None, None, 1, 1)]
    for name, data in (("full", rows), ("none", [])):
        spark.createDataFrame(data, kind).write.parquet(f"{tmp_path}/{name}/conversations.parquet")
    out = {r["pair_id"]: r for r in chat.op6_preference_format(spark, f"{tmp_path}/full").collect()}
    assert set(out) == {-1, 0, 2}
    assert out[-1]["n_prompt"] == 1 and out[-1]["chosen_text"] == "" and out[-1]["rejected_mask"] == "1"
    assert out[0]["n_prompt"] == 0 and out[0]["chosen_text"] == "" and out[0]["rejected_text"] == "<|user|>\nz<|end|>\n"
    assert out[2]["n_prompt"] == 0 and out[2]["chosen_text"].count("<|user|>") == 3 and out[2]["rejected_text"].startswith("<|")
    assert chat.op6_preference_format(spark, f"{tmp_path}/none").count() == 0


def test_the_smallest_and_largest_ids(spark):
    low, high = -(1 << 63), (1 << 63) - 1
    df = spark.createDataFrame([(high, "ab"), (low, "a b"), (low, "ab"), (0, "a b")], "doc_id long, text string")
    out = dedup.exact_groups(df).collect()
    assert {r["keep_id"] for r in out} == {low} and sum(r["kept"] for r in out) == 1


def test_preferences_stay_in_the_jvm(spark, sf):
    plan = chat.op6_preference_format(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
