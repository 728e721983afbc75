"""Packing of token lists into blocks, windows over the flat stream, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import hash_bucket, rank, running_sum


def pack_blocks(df: DataFrame, key: str, ids: str, block: int, keep_rest: bool = False) -> DataFrame:
    """(block, ids): the token lists in key order, concatenated and cut. The rest shorter than a block is dropped.

    Only the pieces of documents that reach into a block meet: no token is exploded.
    """
    placed = running_sum(df.select(key, ids, F.size(ids).cast("bigint").alias("__n")), [key], F.col("__n"), "__start").where("__n > 0")
    reach = placed.withColumn("block", F.explode(F.sequence(F.floor(F.col("__start") / block), F.floor((F.col("__start") + F.col("__n") - 1) / block))))
    first = F.greatest(F.col("block") * block - F.col("__start"), F.lit(0))
    last = F.least((F.col("block") + 1) * block - F.col("__start"), F.col("__n"))
    pieces = reach.select("block", F.col("__start").alias("at"), F.slice(ids, (first + 1).cast("int"), (last - first).cast("int")).alias("part"))
    packed = pieces.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("at", "part"))).alias("parts"))
    out = packed.select("block", F.flatten(F.transform("parts", lambda p: p["part"])).alias("ids"), F.size("parts").cast("bigint").alias("n_docs"))
    return out if keep_rest else out.where(F.size("ids") == block)


def pack_text(df: DataFrame, key: str, text: str, block: int, keep_rest: bool = False) -> DataFrame:
    """(block, text, n_docs) where tokens are characters: the texts in key order, concatenated and cut; the rest shorter
    than a block is dropped unless it is to be kept.

    Texts stay strings, and only blocks that hold ends of documents are shuffled.
    """
    n = F.length(text)
    placed = running_sum(df.select(key, text, n.cast("bigint").alias("__n")), [key], F.col("__n"), "__start").where("__n > 0")
    head = F.least(F.pmod(-F.col("__start"), F.lit(block)), F.col("__n")).cast("int")
    cut = F.regexp_extract_all(F.substring(text, head + 1, n), F.lit(f"(?s).{{1,{block}}}"), F.lit(0))
    parts = F.when(head > 0, F.concat(F.array(F.substring(text, F.lit(1), head)), cut)).otherwise(cut)
    pieces = placed.select(F.col("__start").alias("at"), F.posexplode(parts).alias("i", "part")).select((F.floor(F.col("at") / block) + F.col("i")).alias("block"), "at", "part")
    ends = pieces.where(F.length("part") < block).groupBy("block").agg(F.array_sort(F.collect_list(F.struct("at", "part"))).alias("parts"))
    met = ends.select("block", F.array_join(F.transform("parts", lambda p: p["part"]), "").alias("text"), F.size("parts").cast("bigint").alias("n_docs"))
    met = met if keep_rest else met.where(F.length("text") == block)
    return pieces.where(F.length("part") == block).select("block", F.col("part").alias("text"), F.lit(1).cast("bigint").alias("n_docs")).unionByName(met)


def with_end(ids: Column, end) -> Column:
    """A token list with the end token after it."""
    return F.array_append(ids, end)


def pack_budget(df: DataFrame, key: str, length: Column, budget: int) -> DataFrame:
    """Documents in order until the token budget is spent; `taken` of the last one is cut to fit."""
    placed = running_sum(df.withColumn("__len", length.cast("bigint")), [key], F.col("__len"), "offset")
    return placed.where(F.col("offset") < budget).withColumn("taken", F.least("__len", F.lit(budget) - F.col("offset"))).drop("__len")


def document_marks(n_sequences: Column, every: int = 100) -> Column:
    """Ends of index documents: after every `every` sequences, and after the last one."""
    full = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(n_sequences / every))), lambda i: i * every)
    return F.array_distinct(F.array_append(F.filter(full, lambda i: i <= n_sequences), n_sequences))


def window_starts(spark, total: Column, batch_tokens: int, ranks: int, steps: int) -> DataFrame:
    """(rank, step, start) of circular strided windows: start = ((rank + step * ranks) * batch_tokens) mod total."""
    grid = spark.range(ranks * steps).select((F.col("id") % ranks).alias("rank"), F.floor(F.col("id") / ranks).alias("step"))
    return grid.withColumn("start", ((F.col("rank") + F.col("step") * ranks) * batch_tokens) % total)


def gather(windows: DataFrame, blocks: DataFrame, block: int, length: int, total: int, column: str = "ids") -> DataFrame:
    """windows (.., start) with a column: the `length` tokens from start on, around the end; blocks is (block, column), of
    lists or, where tokens are characters, of texts.

    Each window asks for the few blocks that it touches by an equi-join.
    """
    names = windows.columns
    start, end = F.col("start"), F.col("start") + length
    # the rounds of the stream that a window reaches into, and in each the blocks
    rounds = windows.withColumn("__round", F.explode(F.sequence(F.floor(start / total), F.floor((end - 1) / total))))
    low, high = F.greatest(start - F.col("__round") * total, F.lit(0)), F.least(end - F.col("__round") * total, F.lit(total))
    asked = rounds.withColumns({"__low": low, "__high": high}).withColumn("block", F.explode(F.sequence(F.floor(F.col("__low") / block), F.floor((F.col("__high") - 1) / block))))
    pos = F.greatest(F.col("__low"), F.col("block") * block)
    runs = asked.select(*names, "block", pos.alias("pos"), (F.col("__round") * total + pos - start).alias("i"), (F.least("__high", (F.col("block") + 1) * block) - pos).alias("n"))
    met = runs.join(blocks.select(F.col("block"), F.col(column).alias("__ids")), "block")
    first, n = (F.col("pos") - F.col("block") * block + 1).cast("int"), F.col("n").cast("int")
    text = blocks.schema[column].dataType.simpleString() == "string"
    part = F.substring("__ids", first, n) if text else F.slice("__ids", first, n)
    out = met.groupBy(*names).agg(F.array_sort(F.collect_list(F.struct("i", part.alias("part")))).alias("parts"))
    parts = F.transform("parts", lambda p: p["part"])
    return out.select(*names, (F.array_join(parts, "") if text else F.flatten(parts)).alias(column))


def shift(ids: str) -> tuple[Column, Column]:
    """(x, y) of a window of n + 1 tokens: y is x one token later."""
    n = F.size(ids) - 1
    return F.slice(ids, F.lit(1), n), F.slice(ids, F.lit(2), n)


def batches(df: DataFrame, key: str, size: int, seed: int | None = None) -> DataFrame:
    """Adds the batch number and the row's place in it, in key order or in the order of a seeded hash."""
    from ..functions.draws import draw_hash

    if seed is None:
        ranked = rank(df, [key], "__rank")
    else:
        hashed = df.withColumn("__hash", draw_hash(seed, F.col(key)))
        ranked = rank(hashed, ["__hash", key], "__rank", hash_bucket(hashed, "__hash")).drop("__hash")
    return ranked.withColumns({"batch": F.floor(F.col("__rank") / size), "place": F.col("__rank") % size}).drop("__rank")


def first_batches(df: DataFrame, key: str, size: int, most: int, seed: int | None = None) -> DataFrame:
    """The rows of the first `most` batches."""
    return batches(df, key, size, seed).where(F.col("batch") < most)


def collate(df: DataFrame, key: str, ids: str, size: int, value) -> DataFrame:
    """Batches of `size` rows in key order, each list filled with `value` up to the longest of its batch; nothing is cut.
    `mask` is 1 on tokens and 0 on what was filled. Null lists count as empty."""
    from pyspark.sql import Window as W

    rows = batches(df.withColumn(ids, F.coalesce(F.col(ids), F.array().cast(df.schema[ids].dataType))), key, size)
    n, longest = F.size(ids), F.max(F.size(ids)).over(W.partitionBy("batch"))
    filled = rows.withColumn("__gap", longest - n)
    mask = F.concat(F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), F.col("__gap")))
    return filled.withColumns({"mask": mask, ids: F.concat(F.col(ids), F.array_repeat(F.lit(value).cast(df.schema[ids].dataType.elementType), F.col("__gap")))}).drop("__gap")
