"""Synthetic arithmetic sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.draws import uniform

#: Each category's share, and its templates; those in ADDS suit additions only.
SHARES = {"plain": 0.25, "story": 0.35, "choice": 0.25, "check": 0.15}
TEMPLATES = {
    "plain": [
        "{a} {op} {b} = {c}", "The result of {a} {op} {b} is {c}.", "{a} {op} {b} makes {c}.", "Work out {a} {op} {b}: {c}.", "If you take {a} {op} {b}, you get {c}.", "{c} is what {a} {op} {b} comes to.",
        "Answer to {a} {op} {b}: {c}", "Calculate {a} {op} {b}. It is {c}.", "We write {a} {op} {b} = {c}.", "From {a} {op} {b} follows {c}.", "{a} {op} {b} equals {c}, no more and no less.", "Q: {a} {op} {b} A: {c}",
    ],
    "story": [
        "Start at {a}, go {op} {b}, and you stand at {c}.", "A box holds {a} pens. After {b} more go in, it holds {c}.", "A train carries {a} people. At the next stop the count changes by {op}{b}, so {c} ride on.", "There are {a} apples in one basket and {b} in another, {c} in all.",
        "The thermometer shows {a} degrees. It moves {op}{b} and shows {c}.", "Anna has {a} coins and finds {b} more. Now she has {c}.", "A shelf with {a} books gets {b} new ones and holds {c}.", "The counter reads {a}; after {op}{b} it reads {c}.",
        "{a} birds sit on a wire, {b} more land, and {c} sit there.", "A runner has done {a} laps and runs {b} further ones: {c} laps.", "The score was {a} and changed by {op}{b} to {c}.",
    ],
    "choice": [
        "{a} {op} {b}? Options: {d1}, {c}, {d2}. Answer: {c}.", "Choose the value of {a} {op} {b}: {c}, {d1} or {d2}? {c}.", "Which is {a} {op} {b}? A: {d1} B: {d2} C: {c}. It is C.", "{a} {op} {b} is one of {d2}, {d1}, {c}; it is {c}.", "Pick one for {a} {op} {b}: {d1}/{c}/{d2} -> {c}",
        "Not {d1}, not {d2}: {a} {op} {b} is {c}.", "Of {c}, {d1} and {d2}, only {c} is {a} {op} {b}.", "Test: {a} {op} {b}. (1) {c} (2) {d1} (3) {d2}. Correct: (1).", "Is {a} {op} {b} {d1}, {d2} or {c}? The last.", "Mark {a} {op} {b}: [ ] {d1} [x] {c} [ ] {d2}", "Guess between {d1}, {d2}, {c} for {a} {op} {b}: {c} is right.",
    ],
    "check": [
        "Is {a} {op} {b} equal to {w}? No, it is {c}.", "Someone says {a} {op} {b} is {w}. Wrong: {c}.", "True or false: {a} {op} {b} = {w}. False, {c}.", "{w} is not {a} {op} {b}; {c} is.", "Correct the mistake: {a} {op} {b} = {w}. Right: {c}.", "He wrote {w} for {a} {op} {b}, but it is {c}.",
        "Check {a} {op} {b} = {w}: fails, {c}.", "{a} {op} {b} was marked as {w}; it should be {c}.", "Almost: {w}. Exactly: {a} {op} {b} = {c}.", "Does {w} solve {a} {op} {b}? It doesn't, {c} does.", "The note says {w}; {a} {op} {b} gives {c}.",
    ],
}
ADDS = {"story": {1, 3, 5, 6, 8, 9}}


def fill(template: Column, values: dict[str, Column]) -> Column:
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value.cast("string"))
    return template


def forms() -> list[tuple[float, float, str, str]]:
    """(from, to, operator, template): the share of [0, 1) of each operator and template. A difference that falls on a
    template for additions only is drawn again as a whole, so the others share its place in proportion."""
    weights = [(SHARES[k] / len(kind) / 2, op, t) for k, kind in TEMPLATES.items() for i, t in enumerate(kind) for op in "+-" if op == "+" or i not in ADDS.get(k, ())]
    total, below, out = sum(w for w, _, _ in weights), 0.0, []
    for w, op, t in weights:
        out.append((round(below / total, 9), round((below + w) / total, 9), op, t))
        below += w
    return out[:-1] + [(out[-1][0], 1.0, *out[-1][2:])]


def sentences(rows: DataFrame, key: str, most: int, seed: int) -> DataFrame:
    """Adds `text`, a sentence drawn for each row by its key; numbers are at most `most`, differences never below 0. Rows of
    one key get one sentence, null keys too."""
    u = lambda k: uniform(f"{seed}.{k}", F.coalesce(F.col(key).cast("string"), F.lit("")))
    pick = lambda k, size: F.floor(u(k) * size)
    table = F.array(*[F.struct(F.lit(hi).alias("hi"), F.lit(op).alias("op"), F.lit(t).alias("text")) for _, hi, op, t in forms()])
    form = F.element_at(F.transform(F.array(u("form")), lambda x: F.element_at(F.filter(table, lambda f: f["hi"] > x), 1)), 1)
    drawn = rows.withColumns({"__form": form, "__x": pick("a", most + 1), "__y": pick("b", most + 1)}).withColumn("__op", F.col("__form.op"))
    minus = F.col("__op") == "-"
    drawn = drawn.withColumns({"__a": F.when(minus, F.greatest("__x", "__y")).otherwise(F.col("__x")), "__b": F.when(minus, F.least("__x", "__y")).otherwise(F.col("__y"))})
    drawn = drawn.withColumn("__c", F.when(minus, F.col("__a") - F.col("__b")).otherwise(F.col("__a") + F.col("__b")))
    wrong = F.col("__c") + F.element_at(F.array(*map(F.lit, (-2, -1, 1, 2))), (pick("w", 4) + 1).cast("int"))
    values = {k: F.col(f"__{k}") for k in ("a", "op", "b", "c")} | {"w": wrong, "d1": F.col("__c") + 1 + pick("d1", 10), "d2": F.col("__c") + 11 + pick("d2", 10)}
    return drawn.select(*rows.columns, fill(F.col("__form.text"), values).alias("text"))


def arithmetic(spark, n: int, most: int, seed: int) -> DataFrame:
    """(id, text): n sentences."""
    return sentences(spark.range(n), "id", most, seed)
