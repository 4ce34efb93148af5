"""Dosage forms, their families, release modifiers, and the split of a dosage into form and strength."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricebridge.dims import FAMILIES, FORMS, LIST_RANK, MODIFIERS
from pricebridge.functions.text import has


def lookup(table: dict[str, str], key: Column) -> Column:
    """A small fixed table as a literal map; null where it has no such key."""
    return F.create_map(*map(F.lit, chain.from_iterable(table.items())))[key]


def _first_known(candidates: Column) -> Column:
    known = F.transform(candidates, lambda p: lookup(FORMS, F.trim(p)))
    return F.get(F.filter(known, lambda x: x.isNotNull()), F.lit(0))


def _phrases(words: Column, n: int) -> Column:
    """All runs of n words, from the left."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1)))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))


def canonical_form(key: Column) -> Column:
    """The base of a folded form: the whole, else a part between slashes, else its longest and leftmost known phrase, else
    itself; unknown for null. Fold in a step before: Spark has no lambda over the result of a Python function."""
    words = F.split(key, " ")
    return F.coalesce(lookup(FORMS, key), _first_known(F.split(key, r"[/\n]+")), *(_first_known(_phrases(words, n)) for n in (3, 2, 1)), key, F.lit("unknown"))


def form_family(form: Column) -> Column:
    return F.coalesce(lookup(FAMILIES, form), form)


def modifiers(text: Column) -> Column:
    """The sorted modifiers that a text names."""
    found = F.array(*(F.when(has(text, pattern), F.lit(token)) for token, pattern in MODIFIERS))
    return F.array_sort(F.array_distinct(F.array_compact(found)))


def form_strength(dosage: Column) -> Column:
    """struct(form, strength): cut at the first word that begins with a digit or is "--", which stands for no strength."""
    text = F.regexp_replace(dosage, r"(?U)^\s+|\s+$", "")
    boundary = r"(?sU)^(.*?)(?<!\S)((?:\d\S*|--)(?!\S).*)$"
    head, tail = F.regexp_extract(text, boundary, 1), F.regexp_extract(text, boundary, 2)
    found, none = tail != "", F.lit(None).cast("string")
    blank = lambda c: F.when(c != "", c)
    form = F.when(found, blank(F.regexp_replace(head, r"(?U)\s+$", ""))).otherwise(blank(text))
    return F.struct(form.alias("form"), F.when(found & ~tail.rlike(r"(?U)^--(\s|$)"), tail).otherwise(none).alias("strength"))


def pack_condition(c: Column) -> Column:
    """less_than_10, more_10 or null."""
    low = F.lower(c)
    return F.when(low.contains("less than") & low.contains("10"), F.lit("less_than_10")).when(low.contains("10") & low.contains("more"), F.lit("more_10"))


def list_rank(version: Column) -> Column:
    """Later lists first; none and others last."""
    rank = F.create_map(*map(F.lit, chain.from_iterable(LIST_RANK.items())))[F.trim(version)]
    return F.coalesce(rank, F.lit(3))
