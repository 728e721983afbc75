"""Queries of top-k stores, full distillation, selection by attention, and ensembles. Rows as in the scoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.draws import sql_uniform
from ..operators import scoring as S
from ..operators import store as T
from ..sources.workspace import new_folder
from ..session import table
from .scoring import _E, _L, _flat, _logits, _lse, _r, _soft, _two

c = F.col


def _rows(s, d, k=4):
    """Ten rows b to a step, dealt over two ranks."""
    rows = _logits(s, d).select("vec_id", F.expr("b div 10").alias("step"), (c("b") % 2).alias("rank"), F.expr("(b % 10) div 2").alias("row"), "t", c("vec_id").alias("x"), c("y").cast("bigint").alias("y"), S.top_k(S.softmax(c("z")), k).alias("topk"))
    return rows.select(*T.COLUMNS[:-1], "topk")


def _stored(s, d, k=4):
    folder = new_folder(s, "store")
    T.write_store(_rows(s, d, k), folder)
    return T.read_store(s, folder)


def _indices(rows, *columns):
    return rows.select(*columns, F.transform("topk", lambda e: e["idx"].cast("bigint")).alias("idx"))


def topk_pad(s, d):
    rows = _logits(s, d).select("vec_id", S.top_k(S.softmax(c("z")), 3).alias("topk"), F.transform(S.top_k(c("r"), 8), lambda e: e["idx"]).alias("other"))
    return _flat(rows.select("vec_id", T.pad_topk(c("topk"), c("other"), 6).alias("topk")))


def ensemble_default(s, d):
    first, second = (x.select("vec_id", F.slice("topk", 1, k).alias("topk"), "y") for x, k in zip(_two(s, d), (4, 6), strict=True))
    return _flat(S.ensemble([first, second], ["vec_id"])).join(first.select("vec_id", c("y").cast("bigint").alias("y")), "vec_id")


def _distilled(s, d, **options):
    return S.distill(_logits(s, d), "b", "t", c("z"), c("y"), c("r"), 2.0, 0.9, **options)


def ensemble_shifted(s, d):
    rows = _logits(s, d)
    both = rows.select("b", "t", "z").unionByName(rows.select("b", "t", c("r").alias("z")))
    mean = S.ensemble_logits(both, ["b", "t"], "z").join(rows.select("b", "t", "y"), ["b", "t"])
    return S.shifted_loss(mean, "b", "t", "z", "y").select("b", "t", _r(c("loss"), "loss"))


def attention_select(s, d):
    """What position t pays position j is the softmax of its first ten logits; rows of ten positions alone are whole."""
    rows = _logits(s, d).withColumn("diff", S.token_loss(c("z"), c("y")) - S.token_loss(c("r"), c("y")))
    return S.attention_select(rows, "b", "t", c("diff"), S.softmax(F.slice("z", 1, 10)), 0.5).select(c("b").cast("bigint").alias("b"), "place", "t")


def store_order(s, d):
    files = table(s, d, "embeddings").select(F.format_string("topk_step%07d_rank%d_%d.npz", F.expr("(vec_id * 7) % 50"), F.expr("cast(vec_id % 5 as int)"), F.expr("(vec_id * 13) % 101")).alias("file"))
    return T.file_order(files.distinct(), "file")


def store_in_order(s, d):
    """The store under names of step, rank and time, read again in the order of its files."""
    name = F.format_string("topk_step%07d_rank%d_%d.npz", "step", "rank", (c("step") * 7 + c("rank") * 13) % 101)
    folder = new_folder(s, "named")
    T.write_named(_rows(s, d).withColumn("file", name), folder, "file")
    return T.load_in_order(s, folder, "file").select("sample", "file", "row", "t", "x", "y")


def ensemble_padded(s, d):
    """Two stores of 3 and 4 entries made 9 long with the first one's own further indices; targets stay."""
    first, second = _two(s, d)
    first = first.withColumns({"own": F.transform("topk", lambda e: e["idx"]), "y": c("y").cast("bigint"), "topk": F.slice("topk", 1, 3)})
    both = S.ensemble([first, second.select("vec_id", F.slice("topk", 1, 4).alias("topk"))], ["vec_id"], 9, "own", ("y",))
    return _flat(both).join(both.select("vec_id", "y"), "vec_id")


QUERIES = {
    "store_in_order": store_in_order,
    "ensemble_padded": ensemble_padded,
    "store_round_trip": lambda s, d: _indices(_stored(s, d), *T.COLUMNS[:-1]),
    "store_probabilities": lambda s, d: _stored(s, d).groupBy("step", "rank").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(S.total(F.transform("topk", lambda e: e["prob"].cast("double")))), 2).alias("mass")),
    "store_latest": lambda s, d: T.latest(_stored(s, d)),
    "store_sample": lambda s, d: T.load_step(_stored(s, d), 7, 5, 3, 9).select("draw", "step", "rank", "row", "t", "x", "y"),
    "store_whole_batch": lambda s, d: T.load_step(_stored(s, d), 0, 0, 5, 9).select("draw", "step", "rank", "t", "x"),
    "step_half": lambda s, d: T.halves(_stored(s, d)).select("step", "rank", "row", "t", "x", "y"),
    "store_order": store_order,
    "topk_pad": topk_pad,
    "ensemble_default": ensemble_default,
    "distill_masked": lambda s, d: _distilled(s, d, k=5).select("vec_id", _r(c("loss"), "loss")),
    "distill_reverse": lambda s, d: _distilled(s, d, reverse=True).select("vec_id", _r(c("loss"), "loss")),
    "distill_selected": lambda s, d: _distilled(s, d, keep=0.4).agg(F.count(F.lit(1)).alias("n"), _r(F.avg("loss"), "loss")),
    "distill_masked_reverse": lambda s, d: _distilled(s, d, k=3, keep=0.7, reverse=True).agg(F.count(F.lit(1)).alias("n"), _r(F.avg("loss"), "loss")),
    "ensemble_shifted": ensemble_shifted,
    "attention_select": attention_select,
}

_S = "s AS (SELECT vec_id, b // 10 AS step, b % 2 AS rank, (b % 10) // 2 AS row, t, vec_id AS x, y::BIGINT AS y FROM l)"
_T = _E + f", {_S}, q AS (SELECT vec_id, list(idx ORDER BY ra) AS idx, list(pa ORDER BY ra) AS pr FROM p2 WHERE ra <= 4 GROUP BY vec_id)"
_M = f"{_L}, {_S}, n AS (SELECT max(step) + 1 AS steps, max(rank) + 1 AS ranks FROM s)"
_D = f"""{_L}, i AS (SELECT unnest(range(64)) AS idx), f AS (SELECT vec_id, b, t, y, z, r, list_transform(z, lambda x: x / 2) AS z2, list_transform(r, lambda x: x / 2) AS r2 FROM m),
g AS (SELECT *, {_lse('z')} - z[y + 1] AS ce, {_lse('r')} - r[y + 1] AS ref, {_lse('z2')} AS lse2, {_soft('r2')} AS p FROM f)"""


def _loss(k: int, reverse: bool) -> str:
    kept = f"h AS (SELECT *, list_transform(list_zip(p, r), lambda e: CASE WHEN e[2] >= list_reverse_sort(r)[{k}] THEN e[1] ELSE 0 END) AS w FROM g), " if k else "h AS (SELECT *, p AS w FROM g), "
    term = "exp(e[2] - lse2) * (e[2] - lse2 - ln(e[1] / tot + 1e-8))" if reverse else "CASE WHEN e[1] > 0 THEN e[1] / tot * (ln(e[1] / tot) - (e[2] - lse2)) ELSE 0 END"
    return kept + f"u AS (SELECT *, list_sum(w) AS tot FROM h), o AS (SELECT vec_id, b, t, ce - ref AS diff, 0.1::DOUBLE * ce + 3.6::DOUBLE * list_sum(list_transform(list_zip(w, z2), lambda e: {term})) AS loss FROM u)"


def _kept(share: float) -> str:
    return f"(SELECT loss, row_number() OVER (PARTITION BY b ORDER BY round(diff, 9) DESC, t) - 1 AS place, count(*) OVER (PARTITION BY b) AS n FROM o) WHERE place < floor(n * {share}::DOUBLE)"


SQL = {
    "store_in_order": f"{_M}, f AS (SELECT *, printf('topk_step%07d_rank%d_%d.npz', step, rank, (step * 7 + rank * 13) % 101) AS file FROM s) SELECT row_number() OVER (ORDER BY step, (step * 7 + rank * 13) % 101, file, row, t) - 1 AS sample, file, row, t, x, y FROM f",
    "ensemble_padded": _E + ", u AS (SELECT vec_id, idx, ((CASE WHEN ra <= 3 THEN pa ELSE 0 END) + (CASE WHEN rb <= 4 THEN pb ELSE 0 END)) / 2 AS prob, CASE WHEN ra <= 3 THEN ra ELSE 1000 + rb END AS seen FROM p2 WHERE ra <= 3 OR rb <= 4), v AS (SELECT vec_id, idx, prob / sum(prob) OVER (PARTITION BY vec_id) AS prob, row_number() OVER (PARTITION BY vec_id ORDER BY round(prob, 9) DESC, seen, idx) AS n FROM u), k AS (SELECT vec_id, count(*) AS m FROM v GROUP BY vec_id), f AS (SELECT p2.vec_id, idx, m + row_number() OVER (PARTITION BY p2.vec_id ORDER BY ra) AS n FROM p2 JOIN k USING (vec_id) WHERE ra <= 8 AND ra > 3 AND rb > 4), a AS (SELECT vec_id, n - 1 AS pos, idx, round(prob, 6) AS prob FROM v UNION ALL SELECT vec_id, n - 1, idx, 0.0::DOUBLE FROM f WHERE n <= 9) SELECT a.*, label::BIGINT AS y FROM a JOIN embeddings USING (vec_id)",
    "store_round_trip": _T + " SELECT step, rank, row, t, x, y, idx FROM s JOIN q USING (vec_id)",
    "store_probabilities": _T + " SELECT step, rank, count(*) AS n, round(sum(list_sum(pr)), 2) AS mass FROM s JOIN q USING (vec_id) GROUP BY step, rank",
    "store_latest": _T + " SELECT max(step) AS step, max(rank) AS rank, max(list_max(idx)) AS token FROM s JOIN q USING (vec_id)",
    "store_sample": f"{_M}, k AS (SELECT i AS draw, floor({sql_uniform(9, 'i')} * 5)::BIGINT AS row FROM range(3) x(i)) SELECT draw, step, rank, row, t, x, y FROM k JOIN s USING (row), n WHERE step = 7 % steps AND rank = 5 % ranks",
    "store_whole_batch": f"{_M} SELECT row AS draw, step, rank, t, x FROM s WHERE step = 0 AND rank = 0",
    "step_half": f"{_M} SELECT step * 2 + (CASE WHEN row >= count(DISTINCT row) OVER (PARTITION BY step, rank) // 2 THEN 1 ELSE 0 END) AS step, rank, row, t, x, y FROM s",
    "store_order": "WITH f AS (SELECT DISTINCT printf('topk_step%07d_rank%d_%d.npz', (vec_id * 7) % 50, vec_id % 5, (vec_id * 13) % 101) AS file, (vec_id * 7) % 50 AS step, vec_id % 5 AS rank, (vec_id * 13) % 101 AS ts FROM embeddings) SELECT file, step, rank, ts, row_number() OVER (ORDER BY step, ts, file) - 1 AS place FROM f",
    "topk_pad": _E + ", a AS (SELECT vec_id, idx, ra - 1 AS pos, pa AS prob FROM p2 WHERE ra <= 3), o AS (SELECT vec_id, idx, rb FROM p2 WHERE rb <= 8 AND ra > 3), p AS (SELECT vec_id, idx, 2 + row_number() OVER (PARTITION BY vec_id ORDER BY rb) AS pos FROM o) SELECT vec_id, pos, idx, round(prob, 6) AS prob FROM a UNION ALL SELECT vec_id, pos, idx, 0.0::DOUBLE FROM p WHERE pos < 6",
    "ensemble_default": _E + ", u AS (SELECT vec_id, idx, ((CASE WHEN ra <= 4 THEN pa ELSE 0 END) + (CASE WHEN rb <= 6 THEN pb ELSE 0 END)) / 2 AS prob, CASE WHEN ra <= 4 THEN ra ELSE 1000 + rb END AS seen FROM p2 WHERE ra <= 4 OR rb <= 6), v AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(prob, 9) DESC, seen, idx) AS n FROM u) SELECT vec_id, n - 1 AS pos, idx, round(prob / sum(prob) OVER (PARTITION BY vec_id), 6) AS prob, y::BIGINT AS y FROM v JOIN l USING (vec_id) WHERE n <= 6",
    "distill_masked": f"{_D}, {_loss(5, False)} SELECT vec_id, round(loss, 6) AS loss FROM o",
    "distill_reverse": f"{_D}, {_loss(0, True)} SELECT vec_id, round(loss, 6) AS loss FROM o",
    "distill_selected": f"{_D}, {_loss(0, False)} SELECT count(*) AS n, round(avg(loss), 6) AS loss FROM {_kept(0.4)}",
    "distill_masked_reverse": f"{_D}, {_loss(3, True)} SELECT count(*) AS n, round(avg(loss), 6) AS loss FROM {_kept(0.7)}",
    "ensemble_shifted": f"{_L}, k AS (SELECT b, t, lead(y) OVER (PARTITION BY b ORDER BY t) AS y, list_transform(list_zip(z, r), lambda e: (e[1] + e[2]) / 2) AS w FROM m) SELECT b, t, round({_lse('w')} - w[y + 1], 6) AS loss FROM k WHERE y IS NOT NULL",
    "attention_select": f"{_L}, g AS (SELECT b, t, round({_lse('z')} - z[y + 1] - ({_lse('r')} - r[y + 1]), 9) AS diff, z[1:10] AS a FROM m), n AS (SELECT b, floor(count(*) * 0.5::DOUBLE * 0.5::DOUBLE) + 1 AS n FROM g GROUP BY b), one AS (SELECT b, row_number() OVER (PARTITION BY b ORDER BY diff DESC, t) - 1 AS place, t FROM g), p AS (SELECT b, unnest(range(10)) AS j, unnest({_soft('a')}) AS w FROM g), w AS (SELECT b, j, row_number() OVER (PARTITION BY b ORDER BY round(sum(w), 9) DESC, j) - 1 AS r FROM p WHERE j > 0 GROUP BY b, j) SELECT b, place, t FROM one JOIN n USING (b) WHERE place < n UNION ALL SELECT b, (n + r)::BIGINT, j - 1 FROM w JOIN n USING (b) WHERE r < n",
}
