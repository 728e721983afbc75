"""Questions and answers of evaluation sets, each in its own form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _text(*parts: str) -> Callable[[], Column]:
    """A form: a name in braces stands for a field's text, a name in brackets for a list's items, joined by commas."""

    def build() -> Column:
        out = []
        for p in parts:
            if p.startswith("{"):
                out.append(F.col(p[1:-1]).cast("string"))
            elif p.startswith("["):
                out.append(F.array_join(F.col(p[1:-1]), ", "))
            else:
                out.append(F.lit(p))
        return F.concat(*out)

    return build


# The wording of each set's question, and where its answer stands.
FORMS: dict[str, tuple[Callable[[], Column], Callable[[], Column]]] = {
    "gsm8k": (_text("{question}", " Answer:"), _text("{answer}")),
    "math": (_text("{problem}", " Solution:"), _text("{solution}")),
    "mathqa": (_text("{problem}", "? Options:", "{options}", " Answer:"), _text("{rationale}")),
    "asdiv": (_text("{body}", " ", "{question}", " Answer:"), _text("{answer}")),
    "mawps": (_text("{input}", " Answer:"), _text("{target}")),
    "mmlu_stem": (_text("{question}", " Options: ", "[choices]", " Answer:"), lambda: F.element_at("choices", F.col("answer").cast("int") + 1)),
    "ocw": (_text("{problem}", " Solution:"), _text("{solution}")),
    "sat_math": (_text("{question}", " Options: ", "{options}", " Answer:"), _text("{Answer}")),
    "svamp": (_text("{Body}", "{Question}", " Answer:"), lambda: F.col("Answer").cast("bigint").cast("string")),
    "bbh": (_text("{input}"), _text("{target}")),
    "gpqa": (_text("{Question}"), _text("{Explanation}")),
    "arc_e": (_text("Question: ", "{question}", " Options: ", "[choices.text]", ". Answer:"), lambda: F.element_at("choices.text", F.array_position(F.col("choices.label"), F.col("answerKey")).cast("int"))),
    "hellaswag": (_text("Context", "{ctx}", " Options: ", "[endings]", " Best Answer:"), lambda: F.element_at("endings", F.col("label").cast("int") + 1)),
}
FORMS["arc_c"] = FORMS["arc_e"]


def formatted(rows: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """(keys, prompt, answer) of an evaluation set's rows; an unknown name is an error."""
    if name not in FORMS:
        raise ValueError(f"unknown evaluation set: {name}")
    question, answer = FORMS[name]
    return rows.select(*keys, question().alias("prompt"), answer().alias("answer"))


def fixed_choice(df: DataFrame, key: str, truth: str, choices: list[str]) -> DataFrame:
    """(key, choices, answer): the same choices for every row, and the letter of the truth; null if it is none of them."""
    from ..functions.formats import choice_letter

    listed = F.array(*map(F.lit, choices))
    at = F.array_position(listed, F.col(truth))
    return df.select(key, listed.alias("choices"), F.when(at > 0, choice_letter((at - 1).cast("int"))).alias("answer"))
