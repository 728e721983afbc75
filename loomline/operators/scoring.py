"""Token scoring on logits held as arrays: losses, selection, divergences, top-k probability stores, ensembles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def let(value: Column, body) -> Column:
    """body of a value that is computed once, not again for each element of a lambda that uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def log_sum_exp(z: Column) -> Column:
    return let(z, lambda v: let(F.array_max(v), lambda m: m + F.log(total(F.transform(v, lambda x: F.exp(x - m))))))


def _scaled(z: Column, temperature: float) -> Column:
    return F.transform(z, lambda x: x / F.lit(float(temperature))) if temperature != 1.0 else z


def softmax(z: Column, temperature: float = 1.0) -> Column:
    return let(_scaled(z, temperature), lambda v: let(log_sum_exp(v), lambda lse: F.transform(v, lambda x: F.exp(x - lse))))


def log_softmax(z: Column, temperature: float = 1.0) -> Column:
    return let(_scaled(z, temperature), lambda v: let(log_sum_exp(v), lambda lse: F.transform(v, lambda x: x - lse)))


def token_loss(z: Column, y: Column, ignore: int = -1) -> Column:
    """Cross-entropy of target y; null where y is the ignored index."""
    return F.when(y != ignore, log_sum_exp(z) - F.element_at(z, F.when(y >= 0, y + 1).otherwise(1).cast("int")))


def select_top(df: DataFrame, row: str, position: str, diff: Column, ratio: float, reverse: bool = False) -> DataFrame:
    """Adds `rank` (0 best) and `selected`: the int(ratio * t) positions of a row with the largest difference, ties to the left.

    The largest is the smallest where reverse is asked for.
    """
    key = F.round(diff, 9)
    order = W.partitionBy(row).orderBy(key.asc() if reverse else key.desc(), position)
    ranked = df.withColumns({"rank": F.row_number().over(order) - 1, "__t": F.count(F.lit(1)).over(W.partitionBy(row))})
    return ranked.withColumn("selected", F.col("rank") < F.floor(F.col("__t") * F.lit(ratio))).drop("__t")


def forward_kl(p: Column, log_q: Column) -> Column:
    """Sum of p (log p - log q); a zero of p adds nothing."""
    return total(F.zip_with(p, log_q, lambda a, b: F.when(a > 0, a * (F.log(a) - b)).otherwise(0.0)))


def reverse_kl(p: Column, log_q: Column) -> Column:
    """Sum of q (log q - log(p + 1e-8))."""
    return total(F.zip_with(p, log_q, lambda a, b: F.exp(b) * (b - F.log(a + 1e-8))))


def top_k(p: Column, k: int) -> Column:
    """The k largest as (prob, idx), ties to the lower index."""
    pairs = F.transform(p, lambda x, i: F.struct((-x).alias("neg"), i.alias("idx")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda s: F.struct((-s["neg"]).alias("prob"), s["idx"].alias("idx")))


def top_k_mask(p: Column, k: int) -> Column:
    """p with all below the k-th value set to 0 (ties at it stay), renormalised."""
    return let(p, lambda v: let(F.element_at(F.sort_array(v, asc=False), k), lambda least: _normalised(F.transform(v, lambda x: F.when(x >= least, x).otherwise(0.0)))))


def nucleus_mask(p: Column, most: float) -> Column:
    """p with all but the smallest set of largest values of sum >= most set to 0, renormalised."""
    sorted_ = lambda v: F.array_sort(F.transform(v, lambda x, i: F.struct((-x).alias("neg"), i.alias("idx"))))
    start = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<int>").alias("kept"))
    kept = lambda v: F.aggregate(sorted_(v), start, lambda a, s: F.struct((a["sum"] - s["neg"]).alias("sum"), F.when(a["sum"] <= most, F.array_append(a["kept"], s["idx"])).otherwise(a["kept"]).alias("kept")))["kept"]
    return let(p, lambda v: let(kept(v), lambda k: _normalised(F.transform(v, lambda x, i: F.when(F.array_contains(k, i), x).otherwise(0.0)))))


def _normalised(p: Column) -> Column:
    return let(p, lambda v: let(total(v), lambda t: F.when(t > 0, F.transform(v, lambda x: x / t)).otherwise(v)))


def distill_loss(z: Column, y: Column, teacher: Column, temperature: float, ratio: float) -> Column:
    """(1 - ratio) * cross-entropy + ratio * temperature^2 * KL of the teacher's probabilities from the student."""
    return F.lit(1 - ratio) * token_loss(z, y) + F.lit(ratio * temperature**2) * forward_kl(teacher, log_softmax(z, temperature))


def distill(df: DataFrame, row: str, position: str, z: Column, y: Column, teacher: Column, temperature: float = 2.0, ratio: float = 0.9, keep: float = 1.0, k: int = 0, reverse: bool = False) -> DataFrame:
    """Adds `loss`: (1 - ratio) * cross-entropy + ratio * temperature^2 * divergence from the teacher's logits.

    k > 0 leaves the teacher its k largest probabilities (ties at the least stay), renormalised; reverse takes the reverse
    divergence; keep < 1 leaves the int(keep * t) positions of a row with the largest excess of the student's cross-entropy
    over the teacher's.
    """
    soft = softmax(teacher, temperature)
    soft = top_k_mask(soft, k) if k else soft
    log_q = log_softmax(z, temperature)
    parts = df.withColumns({"__soft": soft, "__logq": log_q, "__ce": token_loss(z, y)})
    divergence = (reverse_kl if reverse else forward_kl)(F.col("__soft"), F.col("__logq"))
    out = parts.withColumn("loss", F.lit(1 - ratio) * F.col("__ce") + F.lit(ratio * temperature**2) * divergence)
    if keep < 1:
        out = select_top(out, row, position, F.col("__ce") - token_loss(teacher, y), keep).where("selected").drop("rank", "selected")
    return out.drop("__soft", "__logq", "__ce")


def attention_select(df: DataFrame, row: str, position: str, diff: Column, attention: Column, ratio: float) -> DataFrame:
    """(row, place, position): int(ratio * t / 2) + 1 positions by the largest loss difference, then as many by attention.

    A position's attention is the sum of what all positions of its row pay it; it speaks for the token before it, so the
    first position drops out and all others move back by one. A position can be chosen twice. Ties go to the left.
    """
    rows = df.select(row, position, diff.alias("__d"), attention.alias("__a"))
    sizes = F.count(F.lit(1)).over(W.partitionBy(row))
    n = F.floor(sizes * F.lit(ratio) * 0.5) + 1
    first = rows.withColumns({"place": F.row_number().over(W.partitionBy(row).orderBy(F.round("__d", 9).desc(), position)) - 1, "__n": n}).where("place < __n")
    counts = rows.groupBy(row).agg((F.floor(F.count(F.lit(1)) * F.lit(ratio) * 0.5) + 1).alias("__n"))
    paid = rows.select(row, F.posexplode("__a").alias("__j", "__w")).groupBy(row, "__j").agg(F.sum("__w").alias("__s")).where("__j > 0")
    ranked = paid.withColumn("__r", F.row_number().over(W.partitionBy(row).orderBy(F.round("__s", 9).desc(), "__j")) - 1).join(counts, row).where("__r < __n")
    second = ranked.select(row, (F.col("__n") + F.col("__r")).cast("bigint").alias("place"), (F.col("__j") - 1).cast("bigint").alias(position))
    return first.select(row, F.col("place").cast("bigint").alias("place"), F.col(position).cast("bigint").alias(position)).unionByName(second)


def ensemble_logits(df: DataFrame, keys: list[str], z: str) -> DataFrame:
    """(keys, z): the element-wise mean of several models' logits for the same position."""
    parts = df.select(*keys, F.posexplode(z).alias("__i", "__x")).groupBy(*keys, "__i").agg(F.avg("__x").alias("__x"))
    packed = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__i", "__x"))).alias("__p"))
    return packed.select(*keys, F.transform("__p", lambda p: p["__x"]).alias(z))


def shifted_loss(df: DataFrame, row: str, position: str, z: str, token: str) -> DataFrame:
    """(row, position, loss): cross-entropy of each position's logits against the token after it; the last has none."""
    after = F.lead(token).over(W.partitionBy(row).orderBy(position))
    return df.withColumn("__y", after).where("__y IS NOT NULL").select(row, position, token_loss(F.col(z), F.col("__y")).alias("loss"))


def utilisation(parameters: Column, layers: Column, heads: Column, width: Column, block: Column, sequences: Column, seconds: Column, peak: float = 312e12) -> Column:
    """Share of a device's peak that training uses: (6 N + 12 L H Q T) T operations a sequence, over its time."""
    operations = (F.lit(6.0) * parameters + F.lit(12.0) * layers * heads * (width / heads) * block) * block * sequences
    return operations / seconds / F.lit(peak)


def alignment(first: DataFrame, second: DataFrame, keys: list[str], y: str = "y") -> DataFrame:
    """(keys, status) of every entry of a store: whether another store has it, of the same size and target."""
    other = second.select(*keys, F.col(y).alias("__y"), F.size("topk").alias("__k"), F.lit(True).alias("__there"))
    status = F.when(F.col("__there").isNull(), "error: missing").when(F.size("topk") != F.col("__k"), "skip: shape").when(~F.col(y).eqNullSafe(F.col("__y")), "error: targets").otherwise("ok")
    return first.join(other, keys, "left").select(*keys, status.alias("status"))


def exploded(store: DataFrame, keys: list[str], column: str = "topk") -> DataFrame:
    """(keys, idx, prob) of a top-k store."""
    return store.select(*keys, F.explode(column).alias("e")).select(*keys, F.col("e.idx").alias("idx"), F.col("e.prob").alias("prob"))


def ensemble(stores: list[DataFrame], keys: list[str], out_k: int | None = None, fallback: str | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """(keys, topk): the mean of several top-k stores. A token a store lacks counts 0 there; the out_k largest stay, ties
    in the order of the first store, then by index; their sum is brought to 1. out_k is the largest input k if not given.

    fallback names a list of indices of the first store: where fewer than out_k tokens are known, those of the list that
    are not among them follow at probability 0. carry names columns of the first store that stay, such as targets.
    """
    n = len(stores)
    if out_k is None:
        out_k = max(s.agg(F.max(F.size("topk"))).first()[0] or 0 for s in stores)
    parts = [s.select(*keys, F.posexplode("topk").alias("__pos", "e")).select(*keys, F.lit(i).alias("model"), "__pos", F.col("e.idx").alias("idx"), F.col("e.prob").alias("prob")) for i, s in enumerate(stores)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    means = rows.groupBy(*keys, "idx").agg((F.sum("prob") / n).alias("prob"), F.min(F.struct("model", "__pos")).alias("seen"))
    ranked = means.withColumn("r", F.row_number().over(W.partitionBy(*keys).orderBy(F.round("prob", 9).desc(), "seen", "idx"))).where(F.col("r") <= out_k)
    packed = ranked.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("r", "idx", "prob"))).alias("t"), F.sum("prob").alias("s"))
    out = packed.select(*keys, F.transform("t", lambda e: F.struct(e["idx"].alias("idx"), F.when(F.col("s") > 0, e["prob"] / F.col("s")).otherwise(e["prob"]).alias("prob"))).alias("topk"))
    if fallback is None and not carry:
        return out
    own = stores[0].select(*keys, *carry, *([F.col(fallback).alias("__fallback")] if fallback else []))
    out = out.join(own, keys)
    if fallback:
        kind = out.schema["topk"].dataType.elementType["idx"].dataType
        unused = F.array_except(F.transform("__fallback", lambda i: i.cast(kind)), F.transform("topk", lambda e: e["idx"]))
        more = F.slice(unused, F.lit(1), F.greatest(F.lit(out_k) - F.size("topk"), F.lit(0)))
        out = out.withColumn("topk", F.concat("topk", F.transform(more, lambda i: F.struct(i.alias("idx"), F.lit(0.0).alias("prob")))))
    return out.select(*keys, *carry, "topk")


def sparse_kl(topk: Column, log_q: Column) -> Column:
    """KL of a stored top-k (renormalised, sum at least 1e-8) from a student, without a dense teacher."""
    least = F.greatest(total(F.transform(topk, lambda e: e["prob"])), F.lit(1e-8))
    part = lambda e, s: F.when(e["prob"] > 0, e["prob"] / s * (F.log(e["prob"] / s) - F.element_at(log_q, e["idx"] + 1))).otherwise(0.0)
    return let(least, lambda s: total(F.transform(topk, lambda e: part(e, s))))


def mean_arrays(arrays: list[Column]) -> Column:
    """Element-wise mean."""
    out = arrays[0]
    for a in arrays[1:]:
        out = F.zip_with(out, a, lambda x, y: x + y)
    return F.transform(out, lambda x: x / F.lit(float(len(arrays))))


def sample_index(p: Column, u: Column) -> Column:
    """The index at which the cumulative probability passes u."""
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"))
    return F.least(F.aggregate(p, start, lambda a, x: F.struct((a["sum"] + x).alias("sum"), (a["n"] + F.when(a["sum"] + x <= u, 1).otherwise(0)).alias("n")))["n"], F.size(p) - 1)


def learning_rate(it: Column, warmup: int, decay: int, most: float, least: float) -> Column:
    """Linear warm-up, cosine decay, floor."""
    share = (it - warmup) / F.lit(float(decay - warmup))
    return F.when(it < warmup, F.lit(most) * (it + 1) / F.lit(float(warmup + 1))).when(it > decay, F.lit(least)).otherwise(F.lit(least) + F.lit(0.5) * (F.lit(1.0) + F.cos(F.lit(3.141592653589793) * share)) * F.lit(most - least))


def teacher_step(it: Column, last: int, first: int = 10_000) -> Column:
    """The teacher's checkpoint for an iteration."""
    return F.greatest(F.least(it * 2, F.lit(last)), F.lit(first))
