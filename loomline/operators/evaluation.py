"""Evaluation: perplexities, pairwise comparison, question-answer examples, multiple choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.draws import draw_hash, uniform
from ..functions.formats import choice_letter
from .ordering import bounded, rank


def micro_perplexity(loss: str, valid: str) -> tuple[Column, Column]:
    """(perplexity weighted by tokens, valid tokens): exp(sum / count); infinity without valid tokens."""
    n = F.count_if(valid)
    return F.when(n > 0, F.exp(F.sum(F.when(F.col(valid), F.col(loss))) / n)).otherwise(F.lit(float("inf"))), n


def macro_perplexity(df: DataFrame, batch: str, loss: str) -> DataFrame:
    """exp of the mean of the batches' mean losses."""
    return df.groupBy(batch).agg(F.avg(loss).alias("m")).agg(F.exp(F.avg("m")).alias("perplexity"))


def token_perplexity(probability: Column) -> Column:
    """Mean over tokens of 1 / (p + 1e-10)."""
    return F.avg(1 / (probability + 1e-10))


def bits_per_byte(loss: Column, text: Column) -> Column:
    """Summed loss in bits over the texts' UTF-8 bytes."""
    return F.sum(loss) / F.log(F.lit(2.0)) / F.sum(F.octet_length(text))


def hit_rate(topk: Column, target: Column) -> Column:
    """Percentage of positions whose target is among the top k."""
    return F.avg(F.array_contains(F.transform(topk, lambda e: e["idx"]), target).cast("double")) * 100


def latest_by_number(name: str) -> Column:
    """The name with the largest number at its end, such as a checkpoint's."""
    return F.max_by(name, F.regexp_extract(name, r"(\d+)$", 1).cast("bigint"))


def tally(df: DataFrame, status: str) -> DataFrame:
    """(status, n)."""
    return df.groupBy(status).agg(F.count(F.lit(1)).alias("n"))


def wins(first: Column, second: Column) -> list[Column]:
    """Counts and shares of tokens on which each of two models has the lower perplexity; ties go to the second."""
    n, a = F.count(F.lit(1)), F.count_if(first < second)
    return [n.alias("n"), a.alias("first_wins"), (n - a).alias("second_wins"), (a / n).alias("first_share")]


def few_shot(df: DataFrame, position: str, question: str, answer: str, n: int, total: int) -> DataFrame:
    """Adds `prompt`: the n examples before a row, the nearest first, round the end, then the row's question."""
    shots = df.select(F.col(position).alias("__p"), F.concat(F.col(question), F.lit("\n"), F.col(answer), F.lit("\n\n")).alias("__shot"))
    asked = df.withColumn("__k", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("__want", F.pmod(F.col(position) - F.col("__k"), F.lit(total)))
    got = asked.join(shots, F.col("__want") == F.col("__p")).groupBy(position).agg(F.array_sort(F.collect_list(F.struct("__k", "__shot"))).alias("__shots"))
    prompt = F.concat(F.array_join(F.transform("__shots", lambda s: s["__shot"]), ""), F.col(question))
    return df.join(got, position).withColumn("prompt", prompt).drop("__shots")


def qa_example(question: Column, answer: Column, block: int, ignore: int) -> tuple[Column, Column]:
    """(x, y): question and answer joined; y is the next token on the answer, ignore elsewhere. Short ones are filled on
    the right (x with its last token), long ones keep their last `block` tokens, aligned."""
    ids = F.concat(question, answer)
    n = F.size(ids)
    shifted = F.concat(F.array_repeat(F.lit(ignore), F.size(question) - 1), answer, F.array(F.lit(ignore)))
    x = F.when(n >= block, F.slice(ids, -block, block)).otherwise(F.concat(ids, F.array_repeat(F.element_at(ids, -1), F.lit(block) - n)))
    y = F.when(n >= block, F.slice(shifted, -block, block)).otherwise(F.concat(shifted, F.array_repeat(F.lit(ignore), F.lit(block) - n)))
    return x, y


def multiple_choice(df: DataFrame, key: str, truth: str, values: DataFrame, value: str, seed: int = 1, wrong: int = 3) -> DataFrame:
    """(key, choices, answer): the truth and `wrong` different other values in a seeded order; answer is the truth's letter.

    values holds the distinct values of a short attribute and is broadcast; more than 1000 are an error.
    """
    own = df.select(key, F.col(truth).alias("__t")).join(bounded(values.select(F.col(value).alias("__v")), 1000, value), F.col("__t") != F.col("__v"))
    order = W.partitionBy(key).orderBy(draw_hash(seed, F.concat(F.col(key).cast("string"), F.lit("|"), "__v")), "__v")
    others = own.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= wrong).groupBy(key, "__t").agg(F.collect_list("__v").alias("__o"))
    return lettered(others, key, "__t", "__o", seed)


def distractors(questions: DataFrame, key: str, truth: str, rows: DataFrame, value: str, wrong: int = 3, seed: int = 1, first: int = 8) -> DataFrame:
    """(key, truth, others): `wrong` different values other than the truth, in the order in which rows drawn at random with
    replacement bring them, so that frequent values come oftener.

    Draw j of a question takes the row whose number a hash of both says, found by an equi-join on the number; questions
    that lack values draw on, twice as often each round. Null values are never drawn; questions without a key or a truth
    are left out. Fewer than `wrong` + 1 different values are an error, as not every question could be answered.
    """
    from ..sources.workspace import new_folder

    spark = rows.sparkSession
    numbered = rank(rows.select(F.col(value).alias("__v")).where("__v IS NOT NULL"), ["__v"], "__place")
    n, kinds = numbered.count(), numbered.select("__v").distinct().limit(wrong + 1).count()
    if kinds <= wrong:
        raise ValueError(f"{value} has no more than {kinds} values")
    left = questions.select(F.col(key).alias("__q"), F.col(truth).alias("__t")).where("__q IS NOT NULL AND __t IS NOT NULL")
    found, done, low, many = None, None, 0, first
    while True:
        draws = left.select("__q", "__t", F.explode(F.sequence(F.lit(low), F.lit(low + many - 1))).alias("__j"))
        place = F.floor(uniform(seed, F.concat_ws("|", F.col("__q").cast("string"), F.col("__j").cast("string"))) * n)
        met = draws.withColumn("__place", place).join(numbered, "__place").where("__v <> __t").select("__q", "__t", "__v", "__j")
        met = met if found is None else met.unionByName(found)
        best = met.groupBy("__q", "__t", "__v").agg(F.min("__j").alias("__j"))
        kept = best.withColumn("__r", F.row_number().over(W.partitionBy("__q", "__t").orderBy("__j"))).where(F.col("__r") <= wrong)
        counted = kept.withColumn("__n", F.count(F.lit(1)).over(W.partitionBy("__q", "__t")))
        folder = new_folder(spark, "distractors")
        counted.write.parquet(folder)
        counted = spark.read.parquet(folder)
        ready = counted.where(F.col("__n") == wrong)
        done = ready if done is None else done.unionByName(ready)
        left = left.join(ready.select("__q", "__t"), ["__q", "__t"], "left_anti")
        if left.isEmpty():
            break
        found = counted.where(F.col("__n") < wrong).select("__q", "__t", "__v", "__j")
        low, many = low + many, 2 * many
    out = done.groupBy("__q", "__t").agg(F.array_sort(F.collect_list(F.struct("__j", "__v"))).alias("__o"))
    return out.select(F.col("__q").alias(key), F.col("__t").alias(truth), F.transform("__o", lambda o: o["__v"]).alias("others"))


def lettered(df: DataFrame, key: str, truth: str, others: str, seed: int = 1) -> DataFrame:
    """(key, choices, answer): truth and others in a seeded order, and the truth's letter."""
    shuffled = F.array_sort(F.transform(F.array_append(others, F.col(truth)), lambda v: F.struct(F.md5(F.concat(F.lit(f"{seed + 1}:"), F.col(key).cast("string"), F.lit("|"), v)).alias("h"), v.alias("v"))))
    out = df.withColumn("choices", F.transform(shuffled, lambda s: s["v"]))
    return out.select(key, "choices", choice_letter((F.array_position("choices", F.col(truth)) - 1).cast("int")).alias("answer"))


def flat_results(df: DataFrame, results: str, wanted: list[str]) -> DataFrame:
    """(dataset/metric, value) of a map of maps: wanted datasets, no aliases, `_ppl` cut from dataset names."""
    sets = df.select(F.explode(results).alias("dataset", "metrics")).where(F.col("dataset").isin(wanted))
    rows = sets.select("dataset", F.explode("metrics").alias("metric", "value")).where("metric <> 'alias'")
    return rows.select(F.concat(F.regexp_replace("dataset", "_ppl$", ""), F.lit("/"), "metric").alias("name"), "value")
