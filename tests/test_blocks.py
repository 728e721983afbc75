from pyspark.sql import functions as F

from loomline.operators import blocks as B
from loomline.operators import mixture as M


def docs(spark):
    return spark.createDataFrame([(1, [1, 2, 3]), (2, [4, 5]), (3, [6])], "id long, ids array<int>").withColumn("ids", B.with_end(F.col("ids"), F.lit(0)))


def test_pack_blocks(spark):
    assert [r["ids"] for r in B.pack_blocks(docs(spark), "id", "ids", 4).orderBy("block").collect()] == [[1, 2, 3, 0], [4, 5, 0, 6]]
    assert [r["ids"] for r in B.pack_blocks(docs(spark), "id", "ids", 4, keep_rest=True).orderBy("block").collect()][-1] == [0]


def test_a_text_without_a_key_comes_last(spark):
    df = spark.createDataFrame([(None, "zz"), (1, "abc"), (2, "de")], "id long, text string")
    assert [(r["block"], r["text"]) for r in B.pack_text(df, "id", "text", 3, keep_rest=True).orderBy("block").collect()] == [(0, "abc"), (1, "dez"), (2, "z")]


def test_budget_cuts_the_last_document(spark):
    got = B.pack_budget(docs(spark), "id", F.size("ids"), 6).orderBy("id").collect()
    assert [r["taken"] for r in got] == [4, 2]


def test_windows(spark):
    starts = {(r["rank"], r["step"]): r["start"] for r in B.window_starts(spark, F.lit(23), 4, 2, 5).collect()}
    assert [starts[0, k] for k in range(5)] == [0, 8, 16, 1, 9]
    assert [starts[1, k] for k in range(5)] == [4, 12, 20, 5, 13]
    stream = spark.createDataFrame([(i, list(range(5 * i, min(5 * i + 5, 23)))) for i in range(5)], "block long, ids array<int>")
    got = B.gather(B.window_starts(spark, F.lit(23), 4, 2, 5), stream, 5, 5, 23)
    for r in got.collect():
        assert r["ids"] == [(r["start"] + j) % 23 for j in range(5)]


def test_marks(spark):
    got = lambda n: spark.range(1).select(B.document_marks(F.lit(n))).first()[0]
    assert got(250) == [100, 200, 250]
    assert got(200) == [100, 200]
    assert got(7) == [7]


def test_mixture_intervals_and_parsing(spark):
    src = spark.createDataFrame([("a", 50.0), ("b", 25.0), ("c", 25.0)], "source string, weight double")
    assert [(r["lo"], r["hi"]) for r in M.intervals(src, "source", "weight").orderBy("source").collect()] == [(0, 0.5), (0.5, 0.75), (0.75, 1)]
    assert M.parse_weights("50:25:25") == [50, 25, 25]
    assert M.parse_pairs([1, "x", 2, "y"]) == [("x", 1.0), ("y", 2.0)]
