"""Text hygiene. Java's \\s, \\d and \\w know ASCII only, so every pattern here carries (?U)."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Pharmacopoeia marks, written with dots (as such) or without (in any case).
DOTTED_MARKS = r"(?<![A-Za-z])(?:I\.P\.?|B\.P\.?|U\.S\.P\.?)(?![A-Za-z])"
PLAIN_MARKS = r"(?<![A-Za-z])(?:IP|BP|USP|RS)(?![A-Za-z])"
_DOTTED, _PLAIN = re.compile(DOTTED_MARKS), re.compile(PLAIN_MARKS, re.IGNORECASE)


def clean(s: str) -> str:
    """Compatibility characters unified, pharmacopoeia marks dropped, white space squeezed."""
    for pattern in (_DOTTED, _PLAIN):
        s = pattern.sub(" ", s if pattern is _PLAIN else unicodedata.normalize("NFKC", s))
    return " ".join(s.split())


def folded(s: str) -> str:
    return clean(s).casefold()


def number_text(x: float) -> str:
    """Integral numbers as such, others with six significant digits and never an exponent."""
    if x == int(x) and abs(x) < 1e15:
        return str(int(x))
    short = format(x, ".6g")
    return format(x, ".10f").rstrip("0").rstrip(".") if "e" in short else short


def _each(fn):
    return lambda s: s.map(lambda x: None if x is None else fn(x))


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return _each(lambda x: unicodedata.normalize("NFKC", x))(s)


@F.pandas_udf(StringType())
def fold_text(s: pd.Series) -> pd.Series:
    """clean(), then full case folding, which Spark's lower() is not."""
    return _each(folded)(s)


@F.pandas_udf(StringType())
def casefold(s: pd.Series) -> pd.Series:
    return _each(str.casefold)(s)


@F.pandas_udf(StringType())
def format_number_text(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if pd.isna(v) else number_text(float(v)))


@F.pandas_udf(StringType())
def title_case(s: pd.Series) -> pd.Series:
    """Capitals after every non-letter, as str.title does and initcap does not."""
    return _each(str.title)(s)


def let(value: Column, use) -> Column:
    """use(value) with value computed once, however often use mentions it: inside lambdas Spark shares no subexpressions."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def squeeze(c: Column) -> Column:
    """White space of any kind to single spaces, none at the ends."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), r"^ | $", "")


def clean_text(c: Column) -> Column:
    """clean() as a column: one Arrow call for the compatibility forms, the rest in the JVM."""
    plain = F.regexp_replace(F.regexp_replace(nfkc(c), DOTTED_MARKS, " "), "(?i)" + PLAIN_MARKS, " ")
    return squeeze(plain)


def has(c: Column, pattern: str) -> Column:
    """Whether a pattern is found, in any case and any script."""
    return c.rlike("(?iU)" + pattern)


def first_number(c: Column, pattern: str, group: int = 1) -> Column:
    """A group of a pattern's first match as a double; null without a match."""
    got = F.regexp_extract(c, "(?iU)" + pattern, group)
    return F.when(got != "", F.regexp_replace(got, ",", "").try_cast("double"))


def to_milligrams(value: Column, unit: Column) -> Column:
    u = F.lower(unit)
    return F.when(u.isin("mcg", "μg", "ug"), value * 0.001).when(u.isin("g", "gm"), value * 1000.0).otherwise(value)


def rupees(c: Column) -> Column:
    """Two decimals, halves to even as the binary value says."""
    return F.concat(F.lit("₹"), F.call_function("format_number", c, F.lit("0.00")))


def percent1(c: Column) -> Column:
    return F.concat(F.call_function("format_number", c, F.lit("0.0")), F.lit("%"))


def display_name(molecules: Column, strength: Column, form: Column) -> Column:
    parts = lambda c: F.array_join(F.transform(F.split(c, r"\+"), lambda x: squeeze(x)), " + ")
    return F.trim(F.concat_ws(" ", title_case(parts(molecules)), parts(strength), form))


def savings_line(pct: Column) -> Column:
    less = F.concat(F.lit("~"), percent1(pct), F.lit(" less at Jan Aushadhi"))
    more = F.concat(F.lit("~"), percent1(F.abs(pct)), F.lit(" MORE at Jan Aushadhi — above the ceiling"))
    return F.when(pct >= 0, less).otherwise(more)


def slug(c: Column) -> Column:
    """Letters and digits of an ASCII rendering, joined by hyphens."""
    ascii_only = F.regexp_replace(strip_accents(c), r"[^\x00-\x7F]", "")
    hyphened = F.regexp_replace(F.regexp_replace(F.lower(ascii_only), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(hyphened == "", F.lit("formulation")).otherwise(hyphened)


@F.pandas_udf(StringType())
def strip_accents(s: pd.Series) -> pd.Series:
    return _each(lambda x: unicodedata.normalize("NFKD", x))(s)
