"""Preference formatting of chosen and rejected conversations, in built-in SQL functions alone.

The turns of each conversation are put in order; the longest common prefix of turns (equal role and text) of a pair is
rendered once as the prompt, and what is left of each side becomes its completion. A completion is a list of segments
with a mask: 1 on assistant turns, which are learned from, 0 on all others.

Turns without a number, and rows without a conversation, belong to no conversation and are left out. Null roles and
texts count as empty. Rows that repeat a turn number stay, ordered by role and text. A pair with one side alone gives an
empty completion for the other, and no common prompt. Where one conversation is a prefix of the other, the shorter
one's completion is empty. An empty table gives an empty result. Extra columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The rendering of a turn.
OPEN, BETWEEN, CLOSE = "<|", "|>\n", "<|end|>\n"


def conversations_of(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turns): one row per conversation, its turns in order. A row grows with one conversation only."""
    rows = turns.where(F.col(conv_col).isNotNull() & F.col(turn_col).isNotNull()).select(
        F.col(conv_col).alias("conv_id"),
        F.struct(
            F.col(turn_col).cast("long").alias("turn"),
            F.coalesce(F.col(role_col), F.lit("")).alias("role"),
            F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        ).alias("t"),
    )
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))


def render(turns: Column) -> Column:
    """The text of a list of turns."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(BETWEEN), t["text"], F.lit(CLOSE))), "")


def segments(turns: Column, learned_role: str) -> Column:
    """The rendered turns with their masks."""
    return F.transform(
        turns,
        lambda t: F.struct(
            F.concat(F.lit(OPEN), t["role"], F.lit(BETWEEN), t["text"], F.lit(CLOSE)).alias("text"),
            F.when(t["role"] == learned_role, 1).otherwise(0).alias("mask"),
        ),
    )


def _common(chosen: str, rejected: str) -> Column:
    """Number of leading turns that are equal in both."""
    return F.expr(
        f"""aggregate(sequence(1, greatest(1, least(size({chosen}), size({rejected})))), 0, (n, i) -> CASE
            WHEN n = i - 1 AND i <= least(size({chosen}), size({rejected}))
             AND {chosen}[i - 1].role = {rejected}[i - 1].role AND {chosen}[i - 1].text = {rejected}[i - 1].text THEN i ELSE n END)"""
    )


def format_preferences(pairs: DataFrame, learned_role: str = "assistant") -> DataFrame:
    """pairs: (pair_id, chosen, rejected) with lists of turns. Adds the prompt and both masked completions."""
    rows = pairs.withColumns({c: F.coalesce(F.col(c), F.expr("cast(array() as array<struct<turn:bigint,role:string,text:string>>)")) for c in ("chosen", "rejected")})
    rows = rows.withColumn("n_prompt", _common("chosen", "rejected"))
    rest = lambda c: F.slice(F.col(c), F.col("n_prompt") + 1, F.greatest(F.size(c) - F.col("n_prompt"), F.lit(0)))
    return rows.select(
        "pair_id",
        "n_prompt",
        render(F.slice("chosen", F.lit(1), F.col("n_prompt"))).alias("prompt"),
        segments(rest("chosen"), learned_role).alias("chosen"),
        segments(rest("rejected"), learned_role).alias("rejected"),
    )


def op6_preference_format(spark, sf_dir: str) -> DataFrame:
    """Pairs conversation 2k (chosen) with conversation 2k + 1 (rejected), for negative k too."""
    conv = conversations_of(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    sides = conv.select(F.shiftright("conv_id", 1).alias("pair_id"), (F.pmod("conv_id", F.lit(2)) == 0).alias("is_chosen"), "turns")
    pairs = sides.groupBy("pair_id").agg(F.first(F.when(F.col("is_chosen"), F.col("turns")), ignorenulls=True).alias("chosen"), F.first(F.when(~F.col("is_chosen"), F.col("turns")), ignorenulls=True).alias("rejected"))
    text = lambda c: F.array_join(F.transform(c, lambda s: s["text"]), "")
    mask = lambda c: F.array_join(F.transform(c, lambda s: s["mask"].cast("string")), "")
    return format_preferences(pairs).select(
        "pair_id",
        F.col("n_prompt").cast("long").alias("n_prompt"),
        "prompt",
        text("chosen").alias("chosen_text"),
        mask("chosen").alias("chosen_mask"),
        text("rejected").alias("rejected_text"),
        mask("rejected").alias("rejected_mask"),
    )


QUERIES = {"op6_preference_format": op6_preference_format}
SQL = {
    "op6_preference_format": r"""
WITH t AS (SELECT conv_id, conv_id // 2 AS pair_id, conv_id % 2 AS side, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(role, ''), coalesce(text, '')) AS i
           FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
m AS (SELECT a.pair_id, a.i, a.role = b.role AND a.text = b.text AS same FROM t a JOIN t b ON a.pair_id = b.pair_id AND a.i = b.i AND a.side = 0 AND b.side = 1),
d AS (SELECT p.pair_id, coalesce(min(m.i) FILTER (WHERE NOT m.same), max(m.i) + 1, 1) - 1 AS n_prompt
      FROM (SELECT DISTINCT pair_id FROM t) p LEFT JOIN m USING (pair_id) GROUP BY p.pair_id),
r AS (SELECT t.*, d.n_prompt, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS shown FROM t JOIN d USING (pair_id))
SELECT pair_id, any_value(n_prompt)::BIGINT AS n_prompt,
  coalesce(string_agg(shown, '' ORDER BY i) FILTER (WHERE side = 0 AND i <= n_prompt), '') AS prompt,
  coalesce(string_agg(shown, '' ORDER BY i) FILTER (WHERE side = 0 AND i > n_prompt), '') AS chosen_text,
  coalesce(string_agg(CASE WHEN role = 'assistant' THEN '1' ELSE '0' END, '' ORDER BY i) FILTER (WHERE side = 0 AND i > n_prompt), '') AS chosen_mask,
  coalesce(string_agg(shown, '' ORDER BY i) FILTER (WHERE side = 1 AND i > n_prompt), '') AS rejected_text,
  coalesce(string_agg(CASE WHEN role = 'assistant' THEN '1' ELSE '0' END, '' ORDER BY i) FILTER (WHERE side = 1 AND i > n_prompt), '') AS rejected_mask
FROM r GROUP BY pair_id
"""
}
