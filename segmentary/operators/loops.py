"""Truncation of texts that end in a loop."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

WIDTHS = range(50, 10, -5)
LEAST_WORDS, LEAST_REPEATS, REACH = 50, 3, 10
_space = re.compile(r"\s+")


def might_loop(words: list[str]) -> bool:
    """A loop of the narrowest kind has 13 whole words in a row again within reach; without that no search is needed."""
    near, k, seen = words[-(REACH * WIDTHS[0]) :], WIDTHS[-1] - 2, set()
    for i in range(len(near) - k + 1):
        shingle = tuple(near[i : i + k])
        if shingle in seen:
            return True
        seen.add(shingle)
    return False


def without_loop(text: str | None) -> str | None:
    """Cut ``text`` behind the first round of a loop: the widest, and of those the last, stretch of words that comes three times more."""
    if text is None:
        return None
    words = text.split()
    n = len(words)
    if n < LEAST_WORDS or not might_loop(words):
        return text
    for width in WIDTHS:
        if n < 3 * width:
            continue
        for at in range(n - 2 * width, max(0, n - REACH * width), -1):
            if " ".join(words[at + width :]).count(" ".join(words[at : at + width])) >= LEAST_REPEATS:
                return " ".join(words[: at + width])
    return text


@pandas_udf(StringType())
def _without_loops(texts: pd.Series) -> pd.Series:
    return texts.map(without_loop)


def truncated(text: Column) -> Column:
    """Only texts of enough words go to Python; the rest stay as they are."""
    long = F.length(F.regexp_replace(text, r"(?U)[^\s\x1c-\x1f]+", "")) >= LEAST_WORDS - 1
    return F.when(long, _without_loops(text)).otherwise(text)


def truncate_loops(rows: DataFrame, column: str = "text") -> DataFrame:
    return rows.withColumn(column, truncated(F.col(column)))
