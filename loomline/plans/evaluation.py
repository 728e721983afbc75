"""Queries of evaluation, analytics and synthetic data."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.formats import duration, flat_line, tick
from ..operators import analytics as A
from ..operators import evaluation as E
from ..operators.ordering import bounded, rank
from ..session import table
from . import scoring as Q

c = F.col
RUNS = "SELECT user_id AS run, event_type AS metric, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS step FROM events"


def _r(column, name):
    return F.round(column, 6).alias(name)


def _log(s, d):
    w = W.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return table(s, d, "events").select(c("user_id").alias("run"), c("event_type").alias("metric"), "value", F.row_number().over(w).cast("bigint").alias("step"))


def _scored(s, d):
    return Q._diff(s, d).withColumn("valid", c("y") != 3)


def _pairs(s, d):
    turns = table(s, d, "conversations")
    w = W.partitionBy("conv_id").orderBy("turn")
    return turns.withColumns({"next_role": F.lead("role").over(w), "answer": F.lead("text").over(w)}).where("role = 'user' AND next_role = 'assistant'").select("conv_id", "turn", c("text").alias("question"), "answer")


def few_shot(s, d):
    # an item is one text: its last 10 characters are the answer, all before them the question
    rows = table(s, d, "benchmark").select("item_id", F.substring(c("text"), F.lit(1), F.greatest(F.length("text") - 10, F.lit(0))).alias("q"), F.right("text", F.lit(10)).alias("a"))
    ranked = rank(rows, ["item_id"], "i")
    return E.few_shot(ranked, "i", "q", "a", 3, rows.count()).select("item_id", "prompt")


def qa_pad(s, d):
    codes = lambda t: F.transform(F.filter(F.split(t, ""), lambda x: x != ""), lambda x: F.ascii(x))
    rows = _pairs(s, d).select("conv_id", "turn", codes("question").alias("q"), codes("answer").alias("a"))
    x, y = E.qa_example(c("q"), c("a"), 64, -1)
    text = lambda v: F.array_join(F.transform(v, lambda i: i.cast("string")), " ")
    return rows.select("conv_id", "turn", text(x).alias("x"), text(y).alias("y"))


def multiple_choice(s, d):
    people = table(s, d, "customer").select("c_custkey", "c_mktsegment")
    return E.multiple_choice(people, "c_custkey", "c_mktsegment", people.select("c_mktsegment").distinct(), "c_mktsegment").select("c_custkey", F.array_join("choices", "|").alias("choices"), "answer")


def results_flatten(s, d):
    rows = table(s, d, "labels").groupBy("quality").agg(F.count(F.lit(1)).cast("string").alias("n"), F.avg("toxic").alias("t"))
    maps = rows.select(F.create_map(F.concat(F.lit("set"), c("quality").cast("string"), F.lit("_ppl")), F.create_map(F.lit("alias"), F.lit("x"), F.lit("n"), "n", F.lit("acc"), F.round("t", 4).cast("string"))).alias("results"))
    return E.flat_results(maps, "results", ["set0_ppl", "set1_ppl"])


def log_scrape(s, d):
    lines = table(s, d, "events").select("event_id", "props").where(F.contains("props", F.lit(":")))
    return lines.agg(F.min_by("props", "event_id").alias("line")).select("line", F.regexp_extract("line", r'"(\w+)":', 1).alias("first_key"))


QUERIES = {
    "ppl_micro": lambda s, d: _scored(s, d).groupBy("b").agg(_r(E.micro_perplexity("loss", "valid")[0], "ppl"), E.micro_perplexity("loss", "valid")[1].alias("n_valid")),
    "ppl_macro": lambda s, d: E.macro_perplexity(_scored(s, d), "b", "loss").select(_r("perplexity", "ppl")),
    "ppl_token_mean": lambda s, d: _scored(s, d).groupBy("y").agg(F.round(E.token_perplexity(F.exp(-c("loss"))), 4).alias("ppl")),
    "bits_per_byte": lambda s, d: _scored(s, d).join(table(s, d, "documents"), c("vec_id") == c("doc_id")).groupBy("lang").agg(_r(E.bits_per_byte(c("loss"), c("text")), "bpb")),
    "pairwise_wins": lambda s, d: _scored(s, d).groupBy("y").agg(*E.wins(F.round("loss", 9), F.round("ref", 9))).withColumn("first_share", F.round("first_share", 6)),
    "topk_hit": lambda s, d: Q._store(s, d, c("z"), 5).agg(_r(E.hit_rate(c("topk"), c("y")), "accuracy")),
    "source_loss": lambda s, d: _scored(s, d).withColumn("split", F.when(c("b") % 5 == 0, "val").otherwise("train")).groupBy("y", "split").agg(_r(F.avg("loss"), "loss")),
    "qa_pairs": lambda s, d: _pairs(s, d).select("conv_id", "turn", F.concat(F.lit("Q: "), flat_line(c("question"), None), F.lit("\nA: "), flat_line(c("answer"), None)).alias("text")),
    "qa_join_options": lambda s, d: table(s, d, "part").select("p_partkey", F.array("p_brand", "p_type", "p_name").alias("o")).select("p_partkey", F.array_join("o", "; ").alias("options"), F.element_at("o", (F.pmod("p_partkey", F.lit(3)) + 1).cast("int")).alias("answer"), F.array_position("o", F.element_at("o", 2)).cast("bigint").alias("position")),
    "few_shot": few_shot,
    "qa_pad": qa_pad,
    "multiple_choice": multiple_choice,
    "results_flatten": results_flatten,
    "eval_grid": lambda s, d: s.range(1000, 5001, 1000).select(c("id").alias("checkpoint")).crossJoin(bounded(table(s, d, "documents").select("lang").distinct(), 1000, "lang")).select("checkpoint", "lang", F.concat(F.lit("ckpt-"), c("checkpoint").cast("string"), F.lit("/"), "lang").alias("task")),
    "metric_join": lambda s, d: A.metric_table(_log(s, d), "run", "step", "metric", "value", ["click", "view"]).where("step >= 3").select("run", "step", _r("click", "click"), _r("view", "view"), _r("mean", "mean")),
    "cosine_pairs": lambda s, d: A.cosine_pairs(table(s, d, "embeddings"), "vec_id", "embedding").select("i", "j", _r("cosine", "cosine")),
    "cluster_report": lambda s, d: A.cluster_report(table(s, d, "documents").select(c("source").alias("cluster"), "n_chars", "lang"), "cluster", "n_chars", "lang").select("cluster", "lang", "size", _r("mean_position", "mean_position"), _r("std_position", "std_position"), _r("percent", "percent")),
    "cluster_top_tokens": lambda s, d: A.top_tokens(table(s, d, "documents").select("lang", F.explode(F.split("text", " ")).alias("token")).where("token <> ''"), "lang", "token").select("lang", "token", "n", c("rank").cast("bigint").alias("rank")),
    "special_token_exclusion": lambda s, d: table(s, d, "embeddings").select("vec_id", "label").join(F.broadcast(s.createDataFrame([(3,), (7,)], "label int")), "label", "left_anti").groupBy("label").agg(F.count(F.lit(1)).alias("n")),
    "channel_stats": lambda s, d: table(s, d, "embeddings").select("vec_id", F.explode("embedding").alias("x")).withColumn("x", c("x").cast("double")).groupBy("vec_id").agg(F.avg("x").alias("m"), F.stddev("x").alias("sd")).agg(_r(F.avg("m"), "mean"), _r(F.avg("sd"), "std")),
    "tick_format": lambda s, d: table(s, d, "documents").select("doc_id", (c("n_chars") * c("n_chars") * 41).alias("v")).select("doc_id", tick(c("v")).alias("tick")),
    "duration_format": lambda s, d: table(s, d, "documents").select("doc_id", duration(c("n_chars") * 977).alias("duration")),
    "latest_checkpoint": lambda s, d: table(s, d, "documents").select("source", F.concat(F.lit("ckpt-"), c("doc_id").cast("string")).alias("ckpt")).groupBy("source").agg(E.latest_by_number("ckpt").alias("latest"), F.max("ckpt").alias("last_by_name")),
    "log_scrape": log_scrape,
    "status_tally": lambda s, d: E.tally(table(s, d, "orders"), "o_orderstatus"),
    "kmeans_tokens": lambda s, d: A.kmeans_clusters(table(s, d, "embeddings"), "embedding", 8, 5).groupBy("cluster").agg(F.count(F.lit(1)).alias("n")),
}

_S = Q._D + ", sc AS (SELECT *, y <> 3 AS valid FROM g)"
_P = "p AS (SELECT * FROM (SELECT conv_id, turn, role, text AS question, lead(role) OVER w AS next_role, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next_role = 'assistant')"
_flat = lambda t: f"replace({t}, chr(10), '\\n')"
_tick = lambda by, u: f"(round(v / {by} * 10)::BIGINT // 10) || CASE WHEN round(v / {by} * 10)::BIGINT % 10 = 0 THEN '' ELSE '.' || (round(v / {by} * 10)::BIGINT % 10) END || '{u}'"
_codes = lambda t: f"list_transform(list_filter(string_split({t}, ''), lambda x: x <> ''), lambda x: unicode(x))"


SQL = {
    "ppl_micro": f"{_S} SELECT b, round(CASE WHEN count(*) FILTER (WHERE valid) > 0 THEN exp(sum(loss) FILTER (WHERE valid) / count(*) FILTER (WHERE valid)) ELSE 'inf'::DOUBLE END, 6) AS ppl, count(*) FILTER (WHERE valid) AS n_valid FROM sc GROUP BY b",
    "ppl_macro": f"{_S} SELECT round(exp(avg(m)), 6) AS ppl FROM (SELECT avg(loss) AS m FROM sc GROUP BY b)",
    "ppl_token_mean": f"{_S} SELECT y, round(avg(1 / (exp(-loss) + 1e-10)), 4) AS ppl FROM sc GROUP BY y",
    "bits_per_byte": f"{_S} SELECT lang, round(sum(loss) / ln(2) / sum(octet_length(encode(text))), 6) AS bpb FROM sc JOIN documents ON vec_id = doc_id GROUP BY lang",
    "pairwise_wins": f"{_S} SELECT y, count(*) AS n, count(*) FILTER (WHERE round(loss, 9) < round(ref, 9)) AS first_wins, count(*) - count(*) FILTER (WHERE round(loss, 9) < round(ref, 9)) AS second_wins, round(count(*) FILTER (WHERE round(loss, 9) < round(ref, 9)) / count(*), 6) AS first_share FROM sc GROUP BY y",
    "topk_hit": Q._E + " SELECT round(count(*) FILTER (WHERE idx = label AND ra <= 5) * 100 / count(DISTINCT p2.vec_id), 6) AS accuracy FROM p2 JOIN embeddings USING (vec_id)",
    "source_loss": f"{_S} SELECT y, CASE WHEN b % 5 = 0 THEN 'val' ELSE 'train' END AS split, round(avg(loss), 6) AS loss FROM sc GROUP BY ALL",
    "qa_pairs": f"WITH {_P} SELECT conv_id, turn, 'Q: ' || {_flat('question')} || chr(10) || 'A: ' || {_flat('answer')} AS text FROM p",
    "qa_join_options": "SELECT p_partkey, p_brand || '; ' || p_type || '; ' || p_name AS options, [p_brand, p_type, p_name][p_partkey % 3 + 1] AS answer, list_position([p_brand, p_type, p_name], p_type)::BIGINT AS position FROM part",
    "few_shot": "WITH r AS (SELECT item_id, left(text, greatest(length(text) - 10, 0)) AS q, right(text, 10) AS a, row_number() OVER (ORDER BY item_id) - 1 AS i, count(*) OVER () AS n FROM benchmark), k AS (SELECT unnest([1, 2, 3]) AS k) SELECT x.item_id, string_agg(e.q || chr(10) || e.a || chr(10) || chr(10), '' ORDER BY k) || any_value(x.q) AS prompt FROM r x, k JOIN r e ON e.i = (x.i - k + x.n) % x.n GROUP BY x.item_id",
    "qa_pad": f"WITH {_P}, t AS (SELECT conv_id, turn, {_codes('question')} AS q, {_codes('answer')} AS a FROM p), j AS (SELECT *, list_concat(q, a) AS ids, list_concat(list_transform(range(len(q) - 1), lambda i: -1), a, [-1]) AS sh FROM t), f AS (SELECT conv_id, turn, list_concat(ids, list_transform(range(greatest(0, 64 - len(ids))), lambda i: ids[-1])) AS x, list_concat(sh, list_transform(range(greatest(0, 64 - len(ids))), lambda i: -1)) AS y FROM j) SELECT conv_id, turn, array_to_string(x[len(x) - 63:], ' ') AS x, array_to_string(y[len(y) - 63:], ' ') AS y FROM f",
    "multiple_choice": "WITH v AS (SELECT DISTINCT c_mktsegment AS v FROM customer), o AS (SELECT c_custkey, c_mktsegment AS t, v, row_number() OVER (PARTITION BY c_custkey ORDER BY md5('1:' || c_custkey || '|' || v), v) AS r FROM customer JOIN v ON v <> c_mktsegment), k AS (SELECT c_custkey, t, v FROM o WHERE r <= 3 UNION ALL SELECT c_custkey, c_mktsegment, c_mktsegment FROM customer), s AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY md5('2:' || c_custkey || '|' || v), v) AS n FROM k) SELECT c_custkey, string_agg(v, '|' ORDER BY n) AS choices, '(' || chr((64 + max(n) FILTER (WHERE v = t))::INTEGER) || ')' AS answer FROM s GROUP BY c_custkey",
    "results_flatten": "WITH r AS (SELECT quality, count(*) AS n, avg(toxic) AS t FROM labels GROUP BY quality) SELECT 'set' || quality || '/n' AS name, n::VARCHAR AS value FROM r UNION ALL SELECT 'set' || quality || '/acc', round(t, 4)::VARCHAR FROM r",
    "eval_grid": "SELECT i AS checkpoint, lang, 'ckpt-' || i || '/' || lang AS task FROM range(1000, 5001, 1000) t(i), (SELECT DISTINCT lang FROM documents)",
    "metric_join": f"WITH e AS ({RUNS}), a AS (SELECT * FROM e WHERE metric = 'click'), b AS (SELECT * FROM e WHERE metric = 'view') SELECT run, step, round(a.value, 6) AS click, round(b.value, 6) AS view, round((a.value + b.value) / 2, 6) AS mean FROM a JOIN b USING (run, step) WHERE step >= 3 AND a.value IS NOT NULL AND b.value IS NOT NULL",
    "cosine_pairs": "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings) SELECT a.vec_id AS i, b.vec_id AS j, round(list_cosine_similarity(a.e, b.e), 6) AS cosine FROM v a JOIN v b ON a.vec_id < b.vec_id",
    "cluster_report": "SELECT source AS cluster, lang, any_value(size) AS size, round(any_value(m), 6) AS mean_position, round(any_value(sd), 6) AS std_position, round(count(*) / any_value(size) * 100, 6) AS percent FROM (SELECT source, lang, count(*) OVER w AS size, avg(n_chars) OVER w AS m, stddev(n_chars) OVER w AS sd FROM documents WINDOW w AS (PARTITION BY source)) GROUP BY source, lang",
    "cluster_top_tokens": "WITH t AS (SELECT lang, unnest(string_split(text, ' ')) AS token FROM documents), k AS (SELECT lang, token, count(*) AS n FROM t WHERE token <> '' GROUP BY lang, token), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, token) AS rank FROM k) SELECT lang, token, n, rank FROM r WHERE rank <= 10",
    "special_token_exclusion": "SELECT label, count(*) AS n FROM embeddings WHERE label NOT IN (3, 7) GROUP BY label",
    "channel_stats": "SELECT round(avg(m), 6) AS mean, round(avg(sd), 6) AS std FROM (SELECT vec_id, avg(x) AS m, stddev(x) AS sd FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY vec_id)",
    "tick_format": f"WITH t AS (SELECT doc_id, n_chars * n_chars * 41 AS v FROM documents) SELECT doc_id, CASE WHEN v >= 1e9 THEN {_tick('1e9', 'B')} WHEN v >= 1e6 THEN {_tick('1e6', 'M')} WHEN v >= 1e3 THEN {_tick('1e3', 'K')} ELSE v::VARCHAR END AS tick FROM t",
    "duration_format": "WITH t AS (SELECT doc_id, n_chars * 977 AS v FROM documents), u AS (SELECT doc_id, list_filter([CASE WHEN v // 86400000 > 0 THEN (v // 86400000) || 'D' END, CASE WHEN v % 86400000 // 3600000 > 0 THEN (v % 86400000 // 3600000) || 'h' END, CASE WHEN v % 3600000 // 60000 > 0 THEN (v % 3600000 // 60000) || 'm' END, CASE WHEN v % 60000 // 1000 > 0 THEN (v % 60000 // 1000) || 's' END, CASE WHEN v % 1000 > 0 THEN (v % 1000) || 'ms' END], lambda x: x IS NOT NULL) AS p FROM t) SELECT doc_id, CASE WHEN len(p) = 0 THEN '0ms' ELSE array_to_string(p[1:2], '') END AS duration FROM u",
    "latest_checkpoint": "SELECT source, 'ckpt-' || max(doc_id) AS latest, max('ckpt-' || doc_id) AS last_by_name FROM documents GROUP BY source",
    "log_scrape": "SELECT arg_min(props, event_id) AS line, regexp_extract(arg_min(props, event_id), '\"(\\w+)\":', 1) AS first_key FROM events WHERE contains(props, ':')",
    "status_tally": "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus",
}
