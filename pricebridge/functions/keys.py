"""Canonical keys: molecule:strength pairs in order, then the form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def pairs(molecules: Column, strengths: Column) -> Column:
    return F.array_sort(F.zip_with(molecules, strengths, lambda m, s: F.concat(m, F.lit(":"), _blank(s))))


def key(molecules: Column, strengths: Column, form: Column) -> Column:
    """budesonide:0.2mg+formoterol:0.006mg|inhaler"""
    return F.concat(F.array_join(pairs(molecules, strengths), "+"), F.lit("|"), form)


def twin_key(molecules: Column, strengths: Column, twins: Column, form: Column) -> Column:
    """The key with percent strengths as mg/ml; null where there are none. twins: the mg/ml of each strength or null."""
    some = F.exists(strengths, lambda s: _blank(s).endswith("%wv"))
    other = F.zip_with(strengths, twins, lambda s, t: F.coalesce(t, s))
    return F.when(some, key(molecules, other, form))


def set_text(values: Column) -> Column:
    """Sorted values joined by a plus; unknown ones are empty."""
    return F.array_join(F.array_sort(F.transform(values, _blank)), "+")
