import pytest
from pyspark.sql import functions as F

from loomline.functions.formats import choice_letter, clip, duration, tick
from loomline.operators import corpus as C
from loomline.operators.ordering import range_bucket, rank, running_sum


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize("n,fraction,expected", [(1000, 0.001, 1), (1001, 0.001, 2), (999, 0.5, 500)])
def test_exact_split_sizes(spark, n, fraction, expected):
    out = C.exact_split(spark.range(n), "id", fraction)
    assert out.where("split = 'val'").count() == expected
    assert out.count() == n


def test_split_does_not_depend_on_partitions(spark):
    a = C.exact_split(spark.range(500).repartition(1), "id", 0.1).where("split = 'val'").collect()
    b = C.exact_split(spark.range(500).repartition(9), "id", 0.1).where("split = 'val'").collect()
    assert sorted(a) == sorted(b)


def test_tail_split(spark):
    out = C.tail_split(spark.range(101), "id", 0.01).where("split = 'test'")
    assert sorted(r.id for r in out.collect()) == [99, 100]


def test_vocabulary_and_codes(spark):
    docs = spark.createDataFrame([(1, "hello"), (2, "😀é")], "id long, text string")
    vocab = C.vocabulary(docs, "text")
    ids = {r["id"]: r["ids"] for r in C.encode_characters(docs, "id", "text", vocab).collect()}
    assert ids[1] == [1, 0, 2, 2, 3]
    back = C.decode_characters(C.encode_characters(docs, "id", "text", vocab), "id", "ids", vocab)
    assert {r["id"]: r["text"] for r in back.collect()} == {1: "hello", 2: "😀é"}


def test_shards_are_balanced(spark):
    sizes = C.contiguous_shards(spark.range(10), "id", 4).groupBy("shard").count().orderBy("shard").collect()
    assert [r["count"] for r in sizes] == [3, 3, 2, 2]
    assert C.contiguous_shards(spark.range(3), "id", 8).select("shard").distinct().count() == 3


def test_running_sum_over_buckets(spark):
    df = spark.createDataFrame([(0, 3), (1, 2), (5000, 4), (9000, 1)], "id long, n long")
    got = {r["id"]: r["start"] for r in running_sum(df, ["id"], F.col("n") * 4, "start").collect()}
    assert got == {0: 0, 1: 12, 5000: 20, 9000: 36}
    assert sorted(r["rank"] for r in rank(df, ["id"], bucket=F.floor(F.col("id") / 10)).collect()) == [0, 1, 2, 3]


def test_far_ids_fill_buckets_evenly(spark):
    """One id far away, and a third of the rows with one key, leave the other buckets as they are."""
    df = spark.range(200_000).select(F.when(F.col("id") == 7, 1 << 60).otherwise(F.col("id")).alias("id"), (F.col("id") % 3).alias("k"))
    sizes = [r["count"] for r in df.groupBy(range_bucket(df, ["id"]).alias("b")).count().collect()]
    assert len(sizes) >= 40 and max(sizes) <= 4 * sum(sizes) / len(sizes)
    hot = df.select(F.when(F.col("k") == 0, 5).otherwise(F.col("id")).alias("k"), "id")
    sizes = [r["count"] for r in hot.groupBy(range_bucket(hot, ["k", "id"]).alias("b")).count().collect()]
    assert max(sizes) <= 4 * sum(sizes) / len(sizes)
    got = rank(df, ["id"]).where(F.col("id").isin(0, 6, 8, 199_999, 1 << 60)).collect()
    assert {r["id"]: r["rank"] for r in got} == {0: 0, 6: 6, 8: 7, 199_999: 199_998, 1 << 60: 199_999}


def test_null_keys_come_last_and_lose_no_row(spark):
    df = spark.range(100).select("id").unionByName(spark.createDataFrame([(None,)], "id long"))
    assert C.exact_split(df, "id", 0.1).count() == 101
    assert [r["id"] for r in C.tail_split(df, "id", 0.01).where("split = 'test'").orderBy("id").collect()] == [None, 99]
    many = spark.range(10_000).select(F.when(F.col("id") % 5 > 0, F.col("id")).alias("id"))
    assert sorted(r["rank"] for r in rank(many, ["id"]).collect()) == list(range(10_000))
    assert rank(many, ["id"]).where("id IS NULL").agg(F.min("rank")).first()[0] == 8000


def test_token_types(spark):
    got = [one(spark, C.token_type(F.lit(n))) for n in (50257, 65535, 65536, 1 << 32)]
    assert got == ["uint16", "uint16", "uint32", "uint64"]


def test_filter_reaches_the_scan(spark, sf):
    df = spark.read.parquet(f"{sf}/pages.parquet").where(C.contains_any("url", ("a", "b"))).select("url")
    assert "StringContains" in df._jdf.queryExecution().executedPlan().toString()


def test_formats(spark):
    assert [one(spark, tick(F.lit(float(x)))) for x in (1.5e9, 2e6, 1000, 999)] == ["1.5B", "2M", "1K", "999"]
    assert [one(spark, duration(F.lit(x))) for x in (3661500, 59250, 0)] == ["1h1m", "59s250ms", "0ms"]
    assert [one(spark, choice_letter(F.lit(x))) for x in (0, 3)] == ["(A)", "(D)"]
    assert one(spark, clip(F.lit("x" * 1001), 500)) == "x" * 500 + " ... [1 omitted] ... " + "x" * 500


def test_unknown_template():
    with pytest.raises(ValueError):
        C.template("poem", "id", {"story": "x"})


def test_character_codes_use_no_map(spark):
    docs = spark.createDataFrame([(1, "a😀é"), (2, None), (3, ""), (4, "zé")], "id long, text string")
    vocab = C.vocabulary(docs.where("id < 4"), "text")
    coded = C.encode_characters(docs, "id", "text", vocab)
    assert {r["id"]: r["ids"] for r in coded.collect()} == {1: [0, 2, 1], 2: None, 3: [], 4: [None, 1]}
    back = C.decode_characters(coded, "id", "ids", vocab)
    assert {r["id"]: r["text"] for r in back.collect()} == {1: "a😀é", 2: None, 3: "", 4: "é"}
    assert "element_at" not in back._jdf.queryExecution().optimizedPlan().toString()  # a map is searched from its start


def test_stats_of_characters_with_null_empty_and_repeated(spark, tmp_path):
    from loomline.plans.corpus import QUERIES, SQL

    duckdb = pytest.importorskip("duckdb")
    rows = [(1, ""), (2, None), (3, "b😀a"), (4, "bc"), (4, "ba"), (4, ""), (None, "zé"), (None, None)]
    for name, some in (("some", rows), ("bare", rows[:2])):
        spark.createDataFrame(some, "doc_id long, text string").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        with duckdb.connect() as con:
            con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/{name}/documents.parquet/*.parquet')")
            want = con.execute(SQL["char_encode_stats"]).fetchall()
        assert sorted(map(tuple, QUERIES["char_encode_stats"](spark, f"{tmp_path}/{name}").collect()), key=str) == sorted(want, key=str)
