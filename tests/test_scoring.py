import pytest
from pyspark.sql import functions as F

from loomline.operators import analytics as A
from loomline.operators import evaluation as E
from loomline.operators import scoring as S


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def arr(*x):
    return F.array(*[F.lit(float(v)) for v in x])


def test_divergences(spark):
    p, lq = arr(0.5, 0.5), F.array(F.log(F.lit(0.25)), F.log(F.lit(0.75)))
    assert one(spark, S.forward_kl(p, lq)) == pytest.approx(0.143841, abs=1e-6)
    assert one(spark, S.reverse_kl(p, lq)) == pytest.approx(0.130812, abs=1e-6)
    assert one(spark, S.forward_kl(arr(0.0, 1.0), lq)) == pytest.approx(0.287682, abs=1e-6)


def test_softmax_and_loss(spark):
    assert sum(one(spark, S.softmax(arr(1000.0, 1000.0, 999.0)))) == pytest.approx(1)
    assert one(spark, S.token_loss(arr(0, 0), F.lit(1))) == pytest.approx(0.693147, abs=1e-6)
    assert one(spark, S.token_loss(arr(0, 0), F.lit(-1))) is None


def test_selection_keeps_ties_to_the_left(spark):
    df = spark.createDataFrame([(0, t, d) for t, d in enumerate([0.1, 0.5, 0.5, -0.2])], "b long, t long, diff double")
    got = S.select_top(df, "b", "t", F.col("diff"), 0.5).where("selected").collect()
    assert sorted(r["t"] for r in got) == [1, 2]


def store(spark, pairs):
    return spark.createDataFrame([(1, [(i, p) for i, p in pairs])], "pos long, topk array<struct<idx:int,prob:double>>")


def test_ensemble(spark):
    out = S.ensemble([store(spark, [(10, 0.6), (20, 0.3)]), store(spark, [(10, 0.2), (30, 0.5)])], ["pos"], 2).first()["topk"]
    assert [(e["idx"], round(e["prob"], 6)) for e in out] == [(10, 0.615385), (30, 0.384615)]
    out = S.ensemble([store(spark, [(1, 1.0)]), store(spark, [(1, 1.0)])], ["pos"], 2).first()["topk"]
    assert [(e["idx"], e["prob"]) for e in out] == [(1, 1.0)]


def test_perplexities(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 0.25), (2, 0.125)], "batch int, p double").withColumns({"loss": -F.log("p"), "ok": F.lit(True)})
    assert df.agg(E.micro_perplexity("loss", "ok")[0]).first()[0] == pytest.approx(4.0)
    assert E.macro_perplexity(df, "batch", "loss").first()[0] == pytest.approx(4.756828, abs=1e-6)
    assert df.agg(E.token_perplexity(F.col("p"))).first()[0] == pytest.approx(4.666667, abs=1e-5)
    assert df.withColumn("ok", F.lit(False)).agg(E.micro_perplexity("loss", "ok")[0]).first()[0] == float("inf")


def test_ties_count_for_the_second_model(spark):
    r = spark.range(1).agg(*E.wins(F.lit(1.0), F.lit(1.0))).first()
    assert (r["first_wins"], r["second_wins"]) == (0, 1)


def test_question_answer_arrays(spark):
    q, a = F.array(F.lit(5), F.lit(6), F.lit(0)), F.array(F.lit(7), F.lit(0))
    x, y = E.qa_example(q, a, 8, -1)
    assert one(spark, x) == [5, 6, 0, 7, 0, 0, 0, 0] and one(spark, y) == [-1, -1, 7, 0, -1, -1, -1, -1]
    x, y = E.qa_example(q, a, 3, -1)
    assert one(spark, x) == [0, 7, 0] and one(spark, y) == [7, 0, -1]


def test_few_shot_wraps(spark):
    df = spark.createDataFrame([(i, f"q{i}", f"a{i}") for i in range(5)], "i long, q string, a string")
    got = {r["i"]: r["prompt"] for r in E.few_shot(df, "i", "q", "a", 2, 5).collect()}
    assert got[0] == "q4\na4\n\nq3\na3\n\nq0"


def test_schedule(spark):
    got = [one(spark, S.learning_rate(F.lit(i), 10, 110, 1.0, 0.1)) for i in (0, 10, 35, 60, 110, 111)]
    assert got == pytest.approx([0.090909, 1, 0.868198, 0.55, 0.1, 0.1], abs=1e-6)
    assert [one(spark, S.teacher_step(F.lit(i), 200_000)) for i in (4_000, 150_000)] == [10_000, 200_000]


def test_power_fit(spark):
    df = spark.createDataFrame([(0, 1.0, 3.0), (0, 4.0, 2.0), (0, 16.0, 1.5)], "run int, x double, y double")
    r = A.power_fit(df, "run", "x", "y", [0.1, 0.25, 0.5, 1.0]).first()
    assert (r["alpha"], round(r["a"], 6), round(r["c"], 6)) == (0.5, 2.0, 1.0)
