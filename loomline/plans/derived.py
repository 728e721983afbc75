"""Queries of schedules, mixtures, fits, lists and sentences, over rows that are derived from the given tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.draws import sql_uniform
from ..operators import analytics as A
from ..operators import blocks as B
from ..operators import corpus as C
from ..operators import mixture as M
from ..operators import scoring as S
from ..operators import synthesis as Y
from ..operators.ordering import bounded, running_sum
from ..session import table
from ..sources import readers as R
from ..sources import sinks as K
from ..sources.workspace import new_folder

c = F.col
STEP = 4096  # characters of an iteration
NEAR = 0.05
ALPHAS = [i / 20 for i in range(1, 41)]


def _r(column, name, digits=6):
    return F.round(column, digits).alias(name)


def _iterations(s, d):
    """(doc_id, id): the iteration of a run over the corpus, in order of the ids, in which a document begins."""
    docs = table(s, d, "documents").select("doc_id", F.length("text").alias("n"))
    return running_sum(docs, ["doc_id"], c("n"), "before").select("doc_id", F.expr(f"before div {STEP}").alias("id"))


def _sources(s, d):
    """Each source with its characters as its weight."""
    return table(s, d, "documents").where("source IS NOT NULL").groupBy("source").agg(F.sum(F.length("text") + 1).cast("double").alias("weight"))


def _draws(s, d):
    """As many draws as there are documents."""
    return M.weighted_draws(s, _sources(s, d), "source", "weight", table(s, d, "documents").count(), 11)


def dtype_choice(s, d):
    """The type for as many ids as a language has characters, places in its text, and pairs of places."""
    docs = table(s, d, "documents").where("text IS NOT NULL")
    kinds = C.characters(docs, "text", "lang").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("characters"))
    sizes = docs.groupBy("lang").agg(F.sum(F.length("text")).alias("places")).join(kinds, "lang")
    square = (c("places") * c("places")).alias("pairs")
    return sizes.select("lang", "characters", "places", square).unpivot("lang", ["characters", "places", "pairs"], "of", "vocab_size").withColumn("dtype", C.token_type(c("vocab_size")))


def mixture_list(s, d):
    """The mixture of sources as a list of weights and paths, written to a file and read again. A setting: a short list."""
    path = new_folder(s, "mixture")
    entry = F.concat(F.lit("- "), c("weight").cast("string"), F.lit("  # characters\n- "), c("source"))
    listed = bounded(_sources(s, d), 100_000, "source").select("source", entry.alias("entry"))
    listed.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("source", "entry"))), lambda e: e["entry"]), "\n").alias("value")).write.text(path)
    return R.weighted_sources(s, R.whole_text(s, path).first()[0])


def existing_sources(s, d):
    """Of the listed sources those that hold a toxic document."""
    found = table(s, d, "documents").join(table(s, d, "labels").where("toxic = 1"), "doc_id").select(c("source").alias("path"))
    return R.existing(mixture_list(s, d), found, "path").select("path", "weight")


def seed_fan_out(s, d):
    """A folder of results for each of six seeds and each source."""
    runs = _sources(s, d).select("source", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(6).cast("bigint"))).alias("seed"))
    return runs.select("seed", "source", F.concat(F.lit("out/seed"), c("seed").cast("string"), F.lit("/"), "source").alias("path"))


def shard_name(s, d):
    """Documents dealt into 40 shards: the file and the step of each shard, and what it holds."""
    shard = F.expr("cast(conv(substring(md5(cast(doc_id as string)), 1, 4), 16, 10) as bigint) % 40").alias("shard")
    sizes = table(s, d, "documents").select(shard, "doc_id").groupBy("shard").agg(F.count("doc_id").alias("n"))
    return sizes.select(F.format_string("%05d.parquet", c("shard")).alias("file"), F.lpad(c("shard").cast("string"), 7, "0").alias("step"), "n")


def tokens_per_iteration(s, d):
    """Batches of twelve documents, each padded to its longest, 40 such batches to an iteration."""
    docs = table(s, d, "documents").select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("len"))
    sizes = B.batches(docs, "doc_id", 12).groupBy(c("batch").cast("bigint").alias("batch")).agg(F.count(F.lit(1)).alias("n"), F.max("len").alias("block"))
    share = (F.lit(6.0) * 124e6 + F.lit(12.0) * 12 * 12 * 64 * c("block")) * c("block") * c("n") * 40 / F.lit(312e12)
    return sizes.select("batch", (c("n") * c("block") * 40).alias("tokens"), _r(share, "share"))


def utilisation(s, d):
    """Each kind of event as a run of steps of 480 sequences that take the event's value in seconds."""
    runs = table(s, d, "events").groupBy("event_type").agg((F.count("value") * F.lit(480.0)).alias("q"), F.sum("value").alias("seconds")).where("seconds > 0")
    f = lambda x: F.lit(float(x))
    return runs.select("event_type", _r(S.utilisation(f(124e6), f(12), f(12), f(768), f(1024), c("q"), c("seconds")), "share"))


def wide_accuracy(s, d):
    """For each language, the accuracy of four rules that call a document good from a length on."""
    rows = table(s, d, "documents").join(table(s, d, "labels"), "doc_id")
    right = lambda m: F.avg(((F.length("text") >= m * 300) == (c("quality") == 1)).cast("double")).alias(f"model_{m}")
    return rows.groupBy(c("lang").alias("k")).agg(*map(right, range(1, 5)))


def _frequencies(s, d):
    """(run, x, y): for each language, the rank of a character by frequency and its per cent of all characters."""
    counts = C.characters(table(s, d, "documents"), "text", "lang").groupBy(c("lang").alias("run"), "ch").agg(F.count(F.lit(1)).alias("n"))
    # an alphabet is small, whatever the size of the corpus
    x = F.row_number().over(W.partitionBy("run").orderBy(F.desc("n"), "ch"))
    return counts.select("run", x.cast("double").alias("x"), (F.lit(100.0) * c("n") / F.sum("n").over(W.partitionBy("run"))).alias("y"))


def _fit(s, d):
    return A.power_fit(_frequencies(s, d), "run", "x", "y", ALPHAS)


def fitted_curve(s, d):
    """400 points of each language's fitted curve, from rank 1 to 100."""
    points = _fit(s, d).select("*", F.explode(F.sequence(F.lit(0), F.lit(399))).alias("i")).withColumn("x", F.lit(1.0) + c("i") * F.lit(99.0 / 399))
    return points.select("run", c("i").cast("bigint").alias("i"), _r("x", "x"), _r(c("a") * F.pow("x", -c("alpha")) + c("c"), "y", 4))


def log_literals(s, d):
    """A run's log, made of the events: the settings in the first line that holds any, the name of the run, and what no line holds."""
    events = table(s, d, "events")
    line = F.when(c("event_type") == "view", F.concat(F.lit("configs are: "), "props")).when(c("event_type") == "click", F.concat(F.lit("tracker: view at http://x/runs/u"), c("user_id").cast("string"), F.lit(" "))).otherwise(c("event_type"))
    lines = events.select("event_id", line.alias("line"))
    got = K.scrape_literal(lines, "event_id", "line", "configs are: ") or {}
    run = K.scrape_suffix(lines, "event_id", "line", "tracker:", "/runs/")
    return s.createDataFrame([(got.get("k"), run, K.scrape_literal(lines, "event_id", "line", "no such marker") is None)], "k bigint, run string, absent boolean")


def similarity_order(s, d):
    """The components of the vectors, similar ones together."""
    vectors = table(s, d, "embeddings")
    n = vectors.agg(F.max(F.size("embedding"))).first()[0] or 0
    return A.similarity_order(A.cosine_columns(vectors, "embedding"), n, NEAR).select("place", c("component").cast("bigint").alias("component"))


QUERIES = {
    "similarity_order": similarity_order,
    "dtype_choice": dtype_choice,
    "shard_name": shard_name,
    "seed_fan_out": seed_fan_out,
    "weighted_list": mixture_list,
    "existing_sources": existing_sources,
    "weighted_draw": _draws,
    "weighted_draw_rows": lambda s, d: M.pick_rows(_draws(s, d), table(s, d, "documents"), "source", "doc_id", 12).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("n_docs"), F.min("doc_id").alias("first_doc")),
    "mixture_report": lambda s, d: M.mixture_report(_draws(s, d), _sources(s, d), "source", "weight").select("source", "n", *[F.round(x, 6).alias(x) for x in ("used", "expected", "difference")]),
    "lr_schedule": lambda s, d: _iterations(s, d).select("doc_id", "id", _r(S.learning_rate(c("id"), 10, 110, 1.0, 0.1), "lr")),
    "dynamic_ratio": lambda s, d: _iterations(s, d).select("doc_id", "id", _r(F.lit(0.7) * S.learning_rate(c("id"), 10, 110, 1.0, 0.1) / F.lit(1.0), "ratio")),
    "teacher_checkpoint": lambda s, d: _iterations(s, d).select("doc_id", S.teacher_step(c("id") * 400, 200_000).alias("step")),
    "tokens_per_iteration": tokens_per_iteration,
    "utilisation": utilisation,
    "unpivot_accuracy": lambda s, d: wide_accuracy(s, d).unpivot("k", [f"model_{m}" for m in range(1, 5)], "model", "accuracy").select("k", "model", _r("accuracy", "accuracy")),
    "power_fit": lambda s, d: _fit(s, d).select("run", _r("alpha", "alpha"), _r("a", "a", 4), _r("c", "c", 4)),
    "fitted_curve": fitted_curve,
    "log_literals": log_literals,
    "arithmetic_sentences": lambda s, d: Y.sentences(table(s, d, "orders").select(c("o_orderkey").alias("id")), "id", 99, 3).select("id", "text"),
}

_lr = "CASE WHEN id < 10 THEN (id + 1) / 11.0::DOUBLE WHEN id > 110 THEN 0.1::DOUBLE ELSE 0.1::DOUBLE + 0.5::DOUBLE * (1 + cos(pi() * (id - 10) / 100.0::DOUBLE)) * 0.9::DOUBLE END"
_it = f"WITH it AS (SELECT doc_id, (coalesce(sum(length(text)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // {STEP})::BIGINT AS id FROM documents)"
_w = "w AS (SELECT source, sum(length(text) + 1)::DOUBLE AS weight FROM documents WHERE source IS NOT NULL GROUP BY source)"
_iv = f"{_w}, iv AS (SELECT source, sum(weight) OVER (ORDER BY source) / sum(weight) OVER () AS hi, (sum(weight) OVER (ORDER BY source) - weight) / sum(weight) OVER () AS lo FROM w), dr AS (SELECT draw, source FROM (SELECT i AS draw, {sql_uniform(11, 'i')} AS u FROM range((SELECT count(*) FROM documents)) t(i)) JOIN iv ON u >= lo AND u < hi)"
_ch = "ch AS (SELECT lang, unnest(string_split(text, '')) AS ch FROM documents), chars AS (SELECT lang, ch FROM ch WHERE ch <> '')"
_pt = f"""WITH {_ch}, cnt AS (SELECT lang AS run, ch, count(*) AS n FROM chars GROUP BY lang, ch),
pt AS (SELECT run, row_number() OVER (PARTITION BY run ORDER BY n DESC, ch)::DOUBLE AS x, 100.0::DOUBLE * n / sum(n) OVER (PARTITION BY run) AS y FROM cnt),
gr AS (SELECT run, (i / 20.0)::DOUBLE AS alpha, pow(x, -(i / 20.0)::DOUBLE) AS u, y FROM pt, range(1, 41) t(i)),
fits AS (SELECT run, alpha, regr_slope(y, u) AS a, regr_intercept(y, u) AS c, regr_syy(y, u) - regr_sxy(y, u) * regr_sxy(y, u) / regr_sxx(y, u) AS sse FROM gr GROUP BY run, alpha HAVING var_pop(u) > 1e-15),
fit AS (SELECT run, alpha, a, c FROM fits QUALIFY row_number() OVER (PARTITION BY run ORDER BY round(sse, 9), alpha) = 1)"""
_a = lambda k, n: f"floor({sql_uniform('3.' + k, 'id')} * {n})::BIGINT"
_quoted = lambda t: "'" + t.replace("'", "''") + "'"
_forms = ", ".join(f"({lo}::DOUBLE, {hi}::DOUBLE, '{op}', {_quoted(t)})" for lo, hi, op, t in Y.forms())
_filled = "tpl"
for _name, _value in (("a", "a::VARCHAR"), ("op", "op"), ("b", "b::VARCHAR"), ("c", "c::VARCHAR"), ("w", "(c + [-2, -1, 1, 2][w + 1])::VARCHAR"), ("d1", "(c + 1 + d1)::VARCHAR"), ("d2", "(c + 11 + d2)::VARCHAR")):
    _filled = f"replace({_filled}, '{{{_name}}}', {_value})"
SQL = {
    "similarity_order": f"""WITH RECURSIVE e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
p AS (SELECT a.i AS i, b.i AS j, sum(a.x * b.x) / sqrt(sum(a.x * a.x)) / sqrt(sum(b.x * b.x)) AS cosine FROM e a JOIN e b ON a.vec_id = b.vec_id GROUP BY a.i, b.i),
m AS (SELECT i, list(CASE WHEN i = j THEN 1.0 ELSE cosine END ORDER BY j) AS to_head FROM p GROUP BY i),
w AS (SELECT 0 AS round, 0::BIGINT AS head, (SELECT list(i ORDER BY i) FROM m) AS remaining UNION ALL SELECT round + 1, coalesce(list_max(list_filter(remaining, lambda x: to_head[x + 1] < -{NEAR})), list_min(list_filter(remaining, lambda x: to_head[x + 1] <= {NEAR}))), list_filter(remaining, lambda x: to_head[x + 1] <= {NEAR}) FROM w JOIN m ON m.i = w.head),
o AS (SELECT round, unnest(list_filter(remaining, lambda x: to_head[x + 1] > {NEAR})) AS component FROM w JOIN m ON m.i = w.head)
SELECT row_number() OVER (ORDER BY round, component) - 1 AS place, component FROM o""",
    "dtype_choice": f"WITH {_ch}, k AS (SELECT lang, count(DISTINCT ch) AS characters FROM chars GROUP BY lang), z AS (SELECT lang, sum(length(text))::BIGINT AS places FROM documents WHERE text IS NOT NULL GROUP BY lang), v AS (SELECT lang, unnest(['characters', 'places', 'pairs']) AS \"of\", unnest([characters, places, places * places]) AS vocab_size FROM k JOIN z USING (lang)) SELECT *, CASE WHEN vocab_size < 65536 THEN 'uint16' WHEN vocab_size < 4294967296 THEN 'uint32' ELSE 'uint64' END AS dtype FROM v",
    "shard_name": "SELECT printf('%05d.parquet', i) AS file, lpad(i::VARCHAR, 7, '0') AS step, count(*) AS n FROM (SELECT cast('0x' || substr(md5(doc_id::VARCHAR), 1, 4) AS BIGINT) % 40 AS i FROM documents) GROUP BY i",
    "seed_fan_out": f"WITH {_w} SELECT i AS seed, source, 'out/seed' || i || '/' || source AS path FROM range(1, 7) t(i), w",
    "weighted_list": f"WITH {_w} SELECT (row_number() OVER (ORDER BY source) - 1)::INTEGER AS position, source AS path, weight FROM w",
    "existing_sources": f"WITH {_w} SELECT source AS path, weight FROM w WHERE source IN (SELECT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)",
    "weighted_draw": f"WITH {_iv} SELECT draw, source FROM dr",
    "weighted_draw_rows": f"WITH {_iv}, r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('rows:' || doc_id), doc_id) - 1 AS rank, count(*) OVER (PARTITION BY source) AS size FROM documents), z AS (SELECT DISTINCT source, size FROM r), c AS (SELECT draw, dr.source, floor({sql_uniform(12, 'draw')} * size)::BIGINT AS rank FROM dr JOIN z USING (source)) SELECT source, count(*) AS n, count(DISTINCT doc_id) AS n_docs, min(doc_id) AS first_doc FROM c JOIN r USING (source, rank) GROUP BY source",
    "mixture_report": f"WITH {_iv} SELECT w.source, count(draw) AS n, round(count(draw) / sum(count(draw)) OVER (), 6) AS used, round(any_value(weight) / sum(any_value(weight)) OVER (), 6) AS expected, round(count(draw) / sum(count(draw)) OVER () - any_value(weight) / sum(any_value(weight)) OVER (), 6) AS difference FROM w LEFT JOIN dr ON w.source = dr.source GROUP BY w.source",
    "lr_schedule": f"{_it} SELECT doc_id, id, round({_lr}, 6) AS lr FROM it",
    "dynamic_ratio": f"{_it} SELECT doc_id, id, round(0.7::DOUBLE * ({_lr}), 6) AS ratio FROM it",
    "teacher_checkpoint": f"{_it} SELECT doc_id, greatest(least(id * 800, 200000), 10000) AS step FROM it",
    "tokens_per_iteration": "WITH b AS (SELECT (row_number() OVER (ORDER BY doc_id) - 1) // 12 AS batch, coalesce(length(text), 0)::BIGINT AS len FROM documents), z AS (SELECT batch, count(*) AS n, max(len) AS block FROM b GROUP BY batch) SELECT batch, n * block * 40 AS tokens, round((6.0::DOUBLE * 124e6 + 12.0::DOUBLE * 12 * 12 * 64 * block) * block * n * 40 / 312e12, 6) AS share FROM z",
    "utilisation": "SELECT event_type, round((6.0::DOUBLE * 124e6 + 12.0 * 12 * 12 * 64 * 1024) * 1024 * (count(value) * 480.0::DOUBLE) / sum(value) / 312e12, 6) AS share FROM events GROUP BY event_type HAVING sum(value) > 0",
    "unpivot_accuracy": "SELECT lang AS k, 'model_' || m AS model, round(avg(((length(text) >= m * 300) = (quality = 1))::INTEGER), 6) AS accuracy FROM documents JOIN labels USING (doc_id), range(1, 5) t(m) GROUP BY lang, m",
    "power_fit": f"{_pt} SELECT run, round(alpha, 6) AS alpha, round(a, 4) AS a, round(c, 4) AS c FROM fit",
    "fitted_curve": f"{_pt} SELECT run, i, round(1 + i * (99.0::DOUBLE / 399), 6) AS x, round(a * pow(1 + i * (99.0::DOUBLE / 399), -alpha) + c, 4) AS y FROM fit, range(400) t(i)",
    "log_literals": "SELECT (arg_min(props, event_id) FILTER (event_type = 'view') ->> 'k')::BIGINT AS k, 'u' || (arg_min(user_id, event_id) FILTER (event_type = 'click')) AS run, true AS absent FROM events",
    "arithmetic_sentences": f"WITH forms(lo, hi, op, tpl) AS (VALUES {_forms}), r AS (SELECT o_orderkey AS id, {_a('a', 100)} AS x, {_a('b', 100)} AS y, op, tpl, {_a('w', 4)} AS w, {_a('d1', 10)} AS d1, {_a('d2', 10)} AS d2 FROM (SELECT o_orderkey AS id, o_orderkey, {sql_uniform("3.form", "o_orderkey")} AS u FROM orders) JOIN forms ON u >= lo AND u < hi), k AS (SELECT *, CASE WHEN op = '-' THEN greatest(x, y) ELSE x END AS a, CASE WHEN op = '-' THEN least(x, y) ELSE y END AS b FROM r), f AS (SELECT *, CASE WHEN op = '+' THEN a + b ELSE a - b END AS c FROM k) SELECT id, {_filled} AS text FROM f",
}
