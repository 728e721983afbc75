"""Quality classifier with hierarchical empirical Bayes over sites.

A logistic model gives every document a probability of being good from features of its whole text. Grouped sums of
these probabilities give each host, and each path within a host, a posterior: a path is shrunk towards its host and a
host towards the global mean, with strengths estimated by moments from all groups (variance within groups over variance
between them), so sparse sites stay near the global prior. A document's own probability is left out of its site's sums,
so it does not count twice. Its score adds to its own log-odds the weighted shift of its path's log-odds from the global
ones, bounded so that a site can tip an unclear document but not outvote clear evidence.

The model is fitted on at most `sample_rows` labelled rows, those with the smallest hash of their id (a documented
bound; of rows that repeat a labelled id, that with the smallest features); everything else covers all rows. Null text
counts as empty; an empty text has no evidence and gets the score of its site, and is kept or not by that. Very long
texts are read whole. Null hosts or paths form a group of their own. Labels that are null or belong to no document are
left out; with one class only, or without labels, all documents count as good. Repeated rows are scored each for
themselves. Extra columns are dropped, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, numbered, slices, without

#: Feature names, in the order of features().
FEATURES = ("symbols", "digits", "bars", "upper", "mean_word", "repeat_pairs", "punctuation", "log_length")
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[[ord(c) for c in "#$%&*@^~=+<>{}[]\\_`"]] = True
BYTES = np.arange(256)
CLASSES = np.stack(
    [
        SYMBOLS,
        (BYTES >= 48) & (BYTES <= 57),
        BYTES == ord("|"),
        (BYTES >= 65) & (BYTES <= 90),
        np.isin(BYTES, [9, 10, 11, 12, 13, 32]),
        np.isin(BYTES, [ord(c) for c in ".,;:!?"]),
        (BYTES & 0xC0) != 0x80,
    ]
).astype(np.float64)


def features(text: bytes) -> np.ndarray:
    """Features of one whole UTF-8 text."""
    counts = CLASSES @ np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256) if text else np.zeros(len(CLASSES))
    symbols, digits, bars, upper, spaces, punctuation, n = counts
    words = text.split()
    n, w = max(n, 1.0), max(len(words), 1)
    pairs = len(set(zip(words, words[1:], strict=False))) / max(len(words) - 1, 1) if len(words) > 1 else 1.0
    return np.array([symbols / w, digits / n, bars / w, upper / n, min(n / w, 50) / 10, 1 - pairs, punctuation / w, np.log1p(n) / 10])


def add_features(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """The kept columns and an array of features of each text."""
    fields = [docs.schema[c] for c in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", features array<double>"

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = [features(t) for t in b.column(len(keep)).to_pylist()]
            flat = pa.array(np.concatenate(rows) if rows else np.zeros(0))
            offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(FEATURES))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.ListArray.from_arrays(offsets, flat)], [*keep, "features"])

    return docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("__data")).mapInArrow(compute, schema)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> dict:
    """Ridge logistic regression by Newton's method on standardised features."""
    if len(y) == 0 or y.min() == y.max():
        return {"mean": np.zeros(len(FEATURES)), "scale": np.ones(len(FEATURES)), "weights": np.r_[3.0, np.zeros(len(FEATURES))]}
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.c_[np.ones(len(x)), (x - mean) / scale]
    weights, prior = np.zeros(z.shape[1]), np.r_[1e-6, np.full(len(FEATURES), ridge)] * len(x)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ weights, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(prior), z.T @ (y - p) - prior * weights)
        weights += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return {"mean": mean, "scale": scale, "weights": weights}


def evidence(model: dict) -> Column:
    """A document's log-odds of being good, from its features; bounded."""
    slopes = model["weights"][1:] / model["scale"]
    total = F.lit(float(model["weights"][0] - slopes @ model["mean"]))
    for i, s in enumerate(slopes):
        total = total + F.lit(float(s)) * F.col("features")[i]
    return F.greatest(F.lit(-20.0), F.least(F.lit(20.0), total))


def logit(p: Column) -> Column:
    return F.log(p / (F.lit(1.0) - p))


#: Rows dealt over so many places before a site's rows are summed and where they meet its sums.
SALTS = 64


def strength(sums: tuple) -> float:
    """Rows that a group's prior is worth: variance within groups over variance between them, by moments; between 1 and
    the number of rows. sums: rows, groups, sum of squared probabilities, of group sums squared over their rows, of
    squared group sizes, and of rows times the squared distance of a group's mean to its centre."""
    n, k, squares, own, sizes, apart = (x or 0.0 for x in sums)
    within = max(squares - own, 0.0) / max(n - k, 1.0)
    between = (apart - max(k - 1.0, 0.0) * within) / max(n - sizes / max(n, 1.0), 1.0)
    return float(min(max(within / between if between > 0 else n, 1.0), max(n, 1.0)))


def site_posteriors(scored: DataFrame, host_col: str, path_col: str, site_weight: float, most_shift: float) -> DataFrame:
    """Adds host_posterior, path_posterior, prior and score to rows with their probability p and their evidence."""
    table = materialise(scored.withColumn("__row", F.monotonically_increasing_id()), "scored")
    # grouped sums: rows of a path are dealt over salts first, so no site lands in one task
    salted = table.groupBy(host_col, path_col, F.pmod("__row", F.lit(SALTS)).alias("s")).agg(F.sum("p").alias("sp"), F.sum(F.col("p") * F.col("p")).alias("sq"), F.count(F.lit(1)).alias("n"))
    paths = salted.groupBy(host_col, path_col).agg(*[F.sum(c).alias(c) for c in ("sp", "sq", "n")])
    hosts = paths.groupBy(host_col).agg(*[F.sum(c).alias(c) for c in ("sp", "sq", "n")])
    total = hosts.agg(F.sum("sp"), F.sum("n")).first()
    if not total[1]:
        return table.select(*scored.columns, *[F.lit(None).cast("double").alias(c) for c in ("host_posterior", "path_posterior", "score")])
    # a tiny share on both sides keeps every log-odds finite
    prior = (total[0] + 0.5) / (total[1] + 1.0)

    def strength_of(groups: DataFrame, centre: Column) -> float:
        mean = F.col("sp") / F.col("n")
        return strength(groups.agg(F.sum("n"), F.count(F.lit(1)), F.sum("sq"), F.sum(F.col("sp") * mean), F.sum(F.col("n") * F.col("n")), F.sum(F.col("n") * (mean - centre) ** 2)).first())

    host_strength = strength_of(hosts, F.lit(prior))
    with_host = paths.join(hosts.select(F.col(host_col).alias("h"), F.col("sp").alias("hsp"), F.col("n").alias("hn")), paths[host_col].eqNullSafe(F.col("h")))
    path_strength = strength_of(with_host, F.col("hsp") / F.col("hn"))
    known = with_host.select(F.col(host_col).alias("h"), F.col(path_col).alias("q"), F.col("sp").alias("path_sp"), F.col("n").alias("path_n"), F.col("hsp").alias("host_sp"), F.col("hn").alias("host_n"))
    known = salted.select(host_col, path_col, "s").join(known, salted[host_col].eqNullSafe(F.col("h")) & salted[path_col].eqNullSafe(F.col("q"))).drop("h", "q")
    known = known.select(F.col(host_col).alias("h"), F.col(path_col).alias("q"), F.col("s").alias("own"), "path_sp", "path_n", "host_sp", "host_n")
    out = table.join(known, table[host_col].eqNullSafe(F.col("h")) & table[path_col].eqNullSafe(F.col("q")) & (F.pmod("__row", F.lit(SALTS)) == F.col("own")))
    # the sums of a group, without the row's own probability, and the mean that they are shrunk to
    shrunk = lambda name, worth, centre: (F.greatest(F.col(f"{name}_sp") - F.col("p"), F.lit(0.0)) + F.lit(worth) * centre) / (F.col(f"{name}_n") - 1 + F.lit(worth))
    out = out.withColumn("host_posterior", shrunk("host", host_strength, F.lit(prior)))
    out = out.withColumn("path_posterior", shrunk("path", path_strength, F.col("host_posterior")))
    inside = F.least(F.greatest(F.col("path_posterior"), F.lit(1e-6)), F.lit(1 - 1e-6))
    shift = F.lit(site_weight) * (logit(inside) - F.lit(float(np.log(prior / (1 - prior)))))
    shift = F.greatest(F.lit(-most_shift), F.least(F.lit(most_shift), shift))
    return out.withColumn("score", F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("evidence") + shift)))).select(*scored.columns, "host_posterior", "path_posterior", "score")


def classify(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    path_col: str = "lang",
    label_col: str = "quality",
    sample_rows: int = 4000,
    threshold: float = 0.5,
    site_weight: float = 0.5,
    most_shift: float = 1.0,
    row_col: str | None = None,
) -> DataFrame:
    """(id, row, host, path, evidence, p, host_posterior, path_posterior, score, keep) of every row of docs.

    row is what the column row_col holds, null without one.
    """
    row = F.col(row_col) if row_col else F.lit(None)
    site = [F.col(host_col).cast("string").alias("host"), F.col(path_col).cast("string").alias("path")]
    thin = docs.select(F.col(id_col).alias("id"), row.cast("long").alias("row"), *site, F.col(text_col).alias("text"))
    known = labels.select(F.col(id_col).alias("l_id"), F.col(label_col).cast("int").alias("label")).where("l_id IS NOT NULL AND label IN (0, 1)").distinct()
    chosen = known.orderBy(F.xxhash64("l_id"), "l_id", "label").limit(sample_rows)
    sample = add_features(thin.join(F.broadcast(chosen), F.col("id") == F.col("l_id")), "text", ["id", "label"])
    sample = sample.groupBy("id", "label").agg(F.min("features").alias("features")).orderBy("id", "label").toArrow().to_pydict()
    x = np.asarray(sample["features"], dtype=np.float64).reshape(-1, len(FEATURES))
    model = fit_logistic(x, np.asarray(sample["label"], dtype=np.float64))

    scored = add_features(thin, "text", ["id", "row", "host", "path"]).withColumn("evidence", evidence(model)).drop("features")
    scored = scored.withColumn("p", F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("evidence"))))
    out = site_posteriors(scored, "host", "path", site_weight, most_shift)
    return out.withColumn("keep", F.col("score") >= threshold).withColumnRenamed("id", id_col)


def op7_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select(
        "doc_id", *[F.round(c, 9).alias(c) for c in ("p", "host_posterior", "path_posterior", "score")], "keep"
    )


def pipeline_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the classifier keeps, each decided for itself; nulls, empty texts and empty tables as in classify."""
    rows, row = numbered(docs, "quality-rows")
    out = classify(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"), row_col=row)
    return without(rows, row, out.where(~F.col("keep")).select("row"), "quality-dropped")


QUERIES = {"op7_quality_classifier": op7_quality_classifier}
SQL: dict[str, str] = {}
