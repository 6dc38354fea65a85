"""Arrow UDFs for what no built-in expresses: nested braces, sequence ratio, pluggable token counts."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillsieve.functions import blocks
from quillsieve.functions.text import curated_integer

_BOXED = re.compile(r"\\boxed\s*\{")


def boxed_in(text: str | None) -> list[str]:
    """What every closed \\boxed{...} holds, nested ones too, in order of their beginning; one pass over the text."""
    text, out, opened = text or "", {}, []
    if "\\boxed" not in text:
        return []
    begins = {m.end() - 1 for m in _BOXED.finditer(text)}
    for m in re.finditer(r"[{}]", text):
        if m[0] == "{":
            opened.append(m.start())
        elif opened and (start := opened.pop()) in begins:
            out[start] = text[start + 1 : m.start()]
    return [out[k] for k in sorted(out)]


def boxed_values(c: Column) -> Column:
    @F.pandas_udf("array<string>")
    def values(texts: pd.Series) -> pd.Series:
        return texts.map(boxed_in)

    return values(c)


def boxed_answer(c: Column) -> Column:
    return curated_integer(F.try_element_at(boxed_values(c), F.lit(-1)))


def sequence_ratio(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp similarity of characters."""

    @F.pandas_udf("double")
    def measured(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([blocks.ratio(p or "", q or "") for p, q in zip(x, y)], dtype="float64")

    return measured(a, b)


def sequence_at_least(least: float):
    """Whether the ratio reaches `least`; for pairs that the bounds on lengths and letters leave."""

    @F.pandas_udf("boolean")
    def reached(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([blocks.reaches(x or "", y or "", least) for x, y in zip(a, b)], dtype="bool")

    return reached


TokenCounter = Callable[[Column], Column]


def count_words(c: Column) -> Column:
    """The default token counter: runs of non-space characters."""
    return F.coalesce(F.size(F.regexp_extract_all(c, F.lit(r"\S+"), F.lit(0))), F.lit(0))


def token_counter(count: Callable[[str], int]) -> TokenCounter:
    """A counter around any Python tokeniser."""

    @F.pandas_udf("int")
    def counted(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: count(t or ""))

    return counted
