"""Similarity of names: 0 to 100 by longest common subsequences."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence, with a bit per character of a."""
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    state = full
    for ch in b:
        hit = state & masks.get(ch, 0)
        state = (state + hit | state - hit) & full
    return len(a) - state.bit_count()


def ratio(a: str, b: str) -> float:
    """Twice the common subsequence by both lengths, in percent; two empty strings are equal."""
    total = len(a) + len(b)
    return 100.0 * 2 * common(a, b) / total if total else 100.0


def partial(a: str, b: str) -> float:
    """The best ratio of the shorter string with any stretch of the other that is as long, or shorter at an end."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    n = len(short)
    if not n:
        return 100.0 if not long else 0.0
    spans = [(max(0, e - n), min(len(long), e)) for e in range(1, len(long) + n)]
    seen, best = set(short), 0.0
    for x, y in spans:
        # a stretch that ends in a letter of its own can only lose by it
        if (long[y - 1] in seen or long[x] in seen) and (r := ratio(short, long[x:y])) > best:
            best = r
    if len(a) == len(b):  # either may be the one that is cut
        best = max([best, *(ratio(long, short[x:y]) for x, y in spans)])
    return best


@F.pandas_udf(DoubleType())
def ratio_column(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def near_lengths(a: Column, b: Column, least: float) -> Column:
    """Whether ratio() can be least at all: it is no more than if all letters of the shorter text stood in the longer."""
    return F.least(F.length(a), F.length(b)) * 200.0 >= (F.length(a) + F.length(b)) * F.lit(least)


def partial_column(query: str, text: Column) -> Column:
    """partial() of a fixed query with a column, and with each of its parts between pluses: the best."""

    @F.pandas_udf("double")
    def best(s: pd.Series) -> pd.Series:
        return s.map(lambda t: max(partial(query, x) for x in [t, *(p for p in t.split("+") if p)]) if t else 0.0)

    return best(text)


def ratio_native(a: Column, b: Column) -> Column:
    """ratio() without Python: the dynamic programme as a fold over the letters of a."""
    letters = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    zero = F.transform(F.sequence(F.lit(0), F.length(b)), lambda _: F.lit(0))

    def row(last: Column, ch: Column) -> Column:
        step = F.struct(F.array(F.lit(0)).alias("done"), F.lit(0).alias("i"))

        def cell(acc: Column, other: Column) -> Column:
            left, up, corner = F.element_at(acc["done"], -1), F.get(last, acc["i"] + 1), F.get(last, acc["i"])
            value = F.when(ch == other, corner + 1).otherwise(F.greatest(left, up))
            return F.struct(F.concat(acc["done"], F.array(value)).alias("done"), (acc["i"] + 1).alias("i"))

        return F.aggregate(letters(b), step, cell, lambda acc: acc["done"])

    total = F.length(a) + F.length(b)
    return F.when(total == 0, 100.0).otherwise(F.element_at(F.aggregate(letters(a), zero, row), -1) * 200.0 / total)
