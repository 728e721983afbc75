"""Queries of token scoring. Logits are ten times the embeddings; row b = vec_id div 10, position t = vec_id mod 10."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.draws import sql_uniform, uniform
from ..operators import scoring as S
from ..session import table

c = F.col


def _logits(s, d):
    rows = table(s, d, "embeddings").select("vec_id", F.expr("vec_id div 10").alias("b"), (c("vec_id") % 10).alias("t"), c("label").alias("y"), F.transform("embedding", lambda x: x.cast("double") * 10).alias("z"))
    return rows.withColumn("r", F.reverse("z"))


def _r(column, name):
    return F.round(column, 6).alias(name)


def _diff(s, d):
    return _logits(s, d).withColumns({"loss": S.token_loss(c("z"), c("y")), "ref": S.token_loss(c("r"), c("y"))}).withColumn("diff", c("loss") - c("ref"))


def _rows(s, d, name, column):
    return _logits(s, d).select("vec_id", _r(column, name))


def _store(s, d, z, k=8):
    return _logits(s, d).select("vec_id", F.expr("b div 5").alias("step"), (c("b") % 5).alias("rank"), "t", c("y"), S.top_k(S.softmax(z), k).alias("topk"))


def _two(s, d):
    return [_store(s, d, c("z")), _store(s, d, F.transform("r", lambda x: x * 0.9))]


def _flat(topk):
    return topk.select("vec_id", F.posexplode("topk").alias("pos", "e")).select("vec_id", c("pos").cast("bigint").alias("pos"), c("e.idx").cast("bigint").alias("idx"), _r(c("e.prob"), "prob"))


def ensemble_kl(s, d):
    first, second = _two(s, d)
    student = _logits(s, d).select("vec_id", S.log_softmax(F.transform("z", lambda x: x * 0.5)).alias("lq"))
    both = first.select("vec_id", "topk").unionByName(second.select("vec_id", "topk")).join(student, "vec_id")
    return both.select("vec_id", S.sparse_kl(c("topk"), c("lq")).alias("kl")).groupBy("vec_id").agg(F.round(F.avg("kl"), 6).alias("kl"))


def alignment_check(s, d):
    first, second = _two(s, d)
    return S.alignment(first, second.where("vec_id % 17 <> 0"), ["vec_id"]).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "softmax_topk": lambda s, d: _flat(_store(s, d, c("z"))),
    "token_ce": lambda s, d: _rows(s, d, "loss", S.token_loss(c("z"), c("y"))),
    "token_ce_ignored": lambda s, d: _logits(s, d).withColumn("y", F.when(c("y") == 3, -1).otherwise(c("y"))).agg(F.round(F.avg(S.token_loss(c("z"), c("y"))), 6).alias("loss"), F.count_if(c("y") != -1).alias("n_valid")),
    "excess_loss": lambda s, d: _diff(s, d).select("vec_id", _r(c("diff"), "diff")),
    "rho_select": lambda s, d: S.select_top(_diff(s, d), "b", "t", c("diff"), 0.5).select("b", "t", c("rank").cast("bigint").alias("rank"), "selected"),
    "rho_reverse": lambda s, d: S.select_top(_diff(s, d), "b", "t", c("diff"), 0.3, reverse=True).where("selected").select("b", "t", c("rank").cast("bigint").alias("rank")),
    "rho_loss": lambda s, d: S.select_top(_diff(s, d), "b", "t", c("diff"), 0.5).where("selected").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("loss"), 6).alias("loss")),
    "forward_kl": lambda s, d: _rows(s, d, "kl", S.forward_kl(S.softmax(c("r"), 2.0), S.log_softmax(c("z"), 2.0))),
    "reverse_kl": lambda s, d: _rows(s, d, "kl", S.reverse_kl(S.softmax(c("r")), S.log_softmax(c("z")))),
    "distill_loss": lambda s, d: _rows(s, d, "loss", S.distill_loss(c("z"), c("y"), S.softmax(c("r"), 2.0), 2.0, 0.5)),
    "masked_teacher": lambda s, d: _logits(s, d).select("vec_id", S.top_k_mask(S.softmax(c("r")), 5).alias("p")).select("vec_id", F.size(F.filter("p", lambda x: x > 0)).cast("bigint").alias("n"), _r(F.array_max("p"), "most")),
    "nucleus_teacher": lambda s, d: _logits(s, d).select("vec_id", S.nucleus_mask(S.softmax(c("z")), 0.9).alias("p")).select("vec_id", F.size(F.filter("p", lambda x: x > 0)).cast("bigint").alias("n"), _r(F.array_max("p"), "most")),
    "topk_store": lambda s, d: _store(s, d, c("z"), 4).select("step", "rank", "t", "y", F.transform("topk", lambda e: e["idx"].cast("bigint")).alias("idx")),
    "ensemble_topk": lambda s, d: _flat(S.ensemble(_two(s, d), ["vec_id"], 8)),
    "ensemble_kl": ensemble_kl,
    "logit_mean_ce": lambda s, d: _rows(s, d, "loss", S.token_loss(S.mean_arrays([c("z"), c("r")]), c("y"))),
    "alignment_check": alignment_check,
    "sample_token": lambda s, d: _logits(s, d).select("vec_id", S.sample_index(S.top_k_mask(S.softmax(c("z"), 0.8), 10), uniform(4, c("vec_id"))).cast("bigint").alias("token")),
}

_L = """WITH l AS (SELECT vec_id, vec_id // 10 AS b, vec_id % 10 AS t, label AS y, list_transform(embedding, lambda x: x::DOUBLE * 10) AS z FROM embeddings),
m AS (SELECT *, list_reverse(z) AS r FROM l)"""


def _lse(z):
    return f"(list_max({z}) + ln(list_sum(list_transform({z}, lambda x: exp(x - list_max({z}))))))"


def _soft(z):
    return f"list_transform({z}, lambda x: exp(x - {_lse(z)}))"


_D = f"{_L}, q AS (SELECT *, {_lse('z')} - z[y + 1] AS loss, {_lse('r')} - r[y + 1] AS ref FROM m), g AS (SELECT *, round(loss - ref, 9) AS diff FROM q)"
_E = f"""{_L}, i AS (SELECT unnest(range(64)) AS idx), p0 AS (SELECT vec_id, idx, z[idx + 1] AS a, r[idx + 1] * 0.9::DOUBLE AS b FROM m, i),
p1 AS (SELECT vec_id, idx, exp(a) / sum(exp(a)) OVER (PARTITION BY vec_id) AS pa, exp(b) / sum(exp(b)) OVER (PARTITION BY vec_id) AS pb FROM p0),
p2 AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY pa DESC, idx) AS ra, row_number() OVER (PARTITION BY vec_id ORDER BY pb DESC, idx) AS rb FROM p1)"""
_half = "list_transform(z, lambda x: x / 2)"
_rhalf = "list_transform(r, lambda x: x / 2)"
_q = f"{_L}, k AS (SELECT vec_id, y, z, r, {_half} AS z2, {_rhalf} AS r2 FROM m)"
_kl2 = f"list_sum(list_transform(list_zip({_soft('r2')}, z2), lambda e: e[1] * (ln(e[1]) - (e[2] - {_lse('z2')}))))"
SQL = {
    "softmax_topk": _E + " SELECT vec_id, ra - 1 AS pos, idx, round(pa, 6) AS prob FROM p2 WHERE ra <= 8",
    "token_ce": f"{_L} SELECT vec_id, round({_lse('z')} - z[y + 1], 6) AS loss FROM m",
    "token_ce_ignored": f"{_L} SELECT round(avg({_lse('z')} - z[y + 1]), 6) AS loss, count(*) AS n_valid FROM m WHERE y <> 3",
    "excess_loss": f"{_D} SELECT vec_id, round(loss - ref, 6) AS diff FROM g",
    "rho_select": f"{_D} SELECT b, t, row_number() OVER (PARTITION BY b ORDER BY diff DESC, t) - 1 AS rank, row_number() OVER (PARTITION BY b ORDER BY diff DESC, t) <= floor(count(*) OVER (PARTITION BY b) * 0.5) AS selected FROM g",
    "rho_reverse": f"{_D}, k AS (SELECT b, t, row_number() OVER (PARTITION BY b ORDER BY diff, t) - 1 AS rank, count(*) OVER (PARTITION BY b) AS n FROM g) SELECT b, t, rank FROM k WHERE rank < floor(n * 0.3::DOUBLE)",
    "rho_loss": f"{_D}, k AS (SELECT loss, row_number() OVER (PARTITION BY b ORDER BY diff DESC, t) - 1 AS rank, count(*) OVER (PARTITION BY b) AS n FROM g) SELECT count(*) AS n, round(avg(loss), 6) AS loss FROM k WHERE rank < floor(n * 0.5)",
    "forward_kl": f"{_q} SELECT vec_id, round({_kl2}, 6) AS kl FROM k",
    "reverse_kl": f"{_q} SELECT vec_id, round(list_sum(list_transform(list_zip({_soft('r')}, z), lambda e: exp(e[2] - {_lse('z')}) * (e[2] - {_lse('z')} - ln(e[1] + 1e-8)))), 6) AS kl FROM k",
    "distill_loss": f"{_q} SELECT vec_id, round(0.5 * ({_lse('z')} - z[y + 1]) + 2 * {_kl2}, 6) AS loss FROM k",
    "masked_teacher": f"{_L}, s AS (SELECT vec_id, {_soft('r')} AS p FROM m), k AS (SELECT vec_id, list_filter(p, lambda x: x >= list_reverse_sort(p)[5]) AS p FROM s) SELECT vec_id, len(p) AS n, round(list_max(p) / list_sum(p), 6) AS most FROM k",
    "nucleus_teacher": _E + ", cs AS (SELECT vec_id, pa, coalesce(sum(pa) OVER (PARTITION BY vec_id ORDER BY pa DESC, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p2) SELECT vec_id, count(*) AS n, round(max(pa) / sum(pa), 6) AS most FROM cs WHERE before <= 0.9 GROUP BY vec_id",
    "topk_store": _E + " SELECT any_value(b) // 5 AS step, any_value(b) % 5 AS rank, any_value(t) AS t, any_value(y) AS y, list(idx ORDER BY ra) AS idx FROM p2 JOIN l USING (vec_id) WHERE ra <= 4 GROUP BY vec_id",
    "ensemble_topk": _E + ", u AS (SELECT vec_id, idx, ((CASE WHEN ra <= 8 THEN pa ELSE 0 END) + (CASE WHEN rb <= 8 THEN pb ELSE 0 END)) / 2 AS prob, CASE WHEN ra <= 8 THEN ra ELSE 1000 + rb END AS seen FROM p2 WHERE ra <= 8 OR rb <= 8), v AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(prob, 9) DESC, seen, idx) AS n FROM u) SELECT vec_id, n - 1 AS pos, idx, round(prob / sum(prob) OVER (PARTITION BY vec_id), 6) AS prob FROM v WHERE n <= 8",
    "ensemble_kl": _E + f", st AS (SELECT vec_id, {_half} AS h FROM m), lq AS (SELECT vec_id, h, {_lse('h')} AS lse FROM st), ka AS (SELECT vec_id, idx, pa / sum(pa) OVER (PARTITION BY vec_id) AS p FROM p2 WHERE ra <= 8 UNION ALL SELECT vec_id, idx, pb / sum(pb) OVER (PARTITION BY vec_id) FROM p2 WHERE rb <= 8) SELECT vec_id, round(sum(p * (ln(p) - (h[idx + 1] - lse))) / 2, 6) AS kl FROM ka JOIN lq USING (vec_id) GROUP BY vec_id",
    "logit_mean_ce": f"{_L}, k AS (SELECT vec_id, y, list_transform(list_zip(z, r), lambda e: (e[1] + e[2]) / 2) AS w FROM m) SELECT vec_id, round({_lse('w')} - w[y + 1], 6) AS loss FROM k",
    "alignment_check": "SELECT CASE WHEN vec_id % 17 = 0 THEN 'error: missing' ELSE 'ok' END AS status, count(*) AS n FROM embeddings GROUP BY status",
    "sample_token": f"{_L}, i AS (SELECT unnest(range(64)) AS idx), p0 AS (SELECT vec_id, idx, exp(z[idx + 1] / 0.8::DOUBLE) AS e FROM m, i), p1 AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY e DESC, idx) AS r FROM p0), p2 AS (SELECT vec_id, idx, sum(CASE WHEN r <= 10 THEN e ELSE 0 END) OVER (PARTITION BY vec_id ORDER BY idx) / sum(CASE WHEN r <= 10 THEN e ELSE 0 END) OVER (PARTITION BY vec_id) AS cum FROM p1) SELECT vec_id, least(count(*) FILTER (WHERE cum <= {sql_uniform(4, 'vec_id')}), 63) AS token FROM p2 GROUP BY vec_id",
}
