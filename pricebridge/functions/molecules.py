"""Molecule names: cleaning, aliases, salts, and the split of a ceiling's formulation into molecules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricebridge.dims import GLUED_SALTS, MOLECULE_ALIASES, SALT_ENDINGS
from pricebridge.functions.forms import lookup
from pricebridge.functions.strength import NUMBER, UNITS_G
from pricebridge.functions.text import squeeze

_SALT = r"(?iU)\s+(?:" + "|".join(SALT_ENDINGS) + r")\s*$"
#: Words of known names to which a salt may be glued: longest first.
GLUE = sorted({w for pair in MOLECULE_ALIASES.items() for name in pair for w in name.split() if len(w) >= 5}, key=lambda w: (-len(w), w))


def tidy_molecule(folded: Column) -> Column:
    """A folded name without the labels (a), (b), (c) and with s(-) set in one way."""
    return squeeze(F.regexp_replace(F.regexp_replace(folded, r"(?i)\([abc]\)", " "), r"(?iU)s\(\s*-\s*\)\s*", "s(-)"))


def without_salts(name: Column) -> Column:
    """Up to three trailing salt words less."""
    for _ in range(3):
        name = F.trim(F.regexp_replace(name, _SALT, ""))
    return name


def unglued(name: Column) -> Column:
    """medroxyprogesteroneacetate as two words; null for any other name."""
    salts = F.array(*map(F.lit, GLUED_SALTS))
    parts = F.transform(F.array(*map(F.lit, GLUE)), lambda w: F.when(name.startswith(w) & F.array_contains(salts, F.substring(name, F.length(w) + 1, F.length(name))), F.concat(w, F.lit(" "), F.substring(name, F.length(w) + 1, F.length(name)))))
    return F.when(~name.contains(" "), F.get(F.filter(parts, lambda x: x.isNotNull()), F.lit(0)))


def resolve_alias(name: Column) -> Column:
    """A tidy name's canonical spelling: by the table, else unglued, else without salts; each looked up again."""
    glued, bare = unglued(name), without_salts(name)
    bare = F.when((bare != "") & (bare != name), bare)
    return F.coalesce(lookup(MOLECULE_ALIASES, name), lookup(MOLECULE_ALIASES, glued), glued, lookup(MOLECULE_ALIASES, bare), bare, name)


def resolve_all(names: Column) -> Column:
    return F.transform(names, resolve_alias)


def tidy_all(folded: Column) -> Column:
    return F.transform(folded, tidy_molecule)


def split_formulation(clean: Column, n_strengths: Column) -> Column:
    """The molecules of a ceiling's cleaned formulation, as written.

    Labels go; a group with a plus inside brackets is the composition; other brackets hold synonyms. Hyphens part
    molecules only where there are more strengths than molecules.
    """
    text = F.regexp_replace(clean, r"(?i)\([abc]\)", " ")
    inner = F.regexp_extract(text, r"\(([^()]+\+[^()]+)[)\]]", 1)
    whole = F.when(inner != "", inner).otherwise(F.regexp_replace(text, r"(?U)\s*\([^()]*\)", " "))
    strip = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    tail = rf"(?iU)\s*{NUMBER}\s*(?:%|(?:{UNITS_G})\b)\s*$"
    one = lambda x: F.btrim(strip(F.regexp_replace(F.regexp_replace(strip(x), r"(?iU)\s+plain\s*$", ""), tail, "")), F.lit(" ]"))
    parts = F.filter(F.transform(F.split(whole, r"\+"), one), lambda x: x != "")
    wider = F.filter(F.transform(F.flatten(F.transform(parts, lambda x: F.split(x, r"(?U)\s+-\s*"))), strip), lambda x: x != "")
    return F.when(n_strengths.isNotNull() & (F.size(parts) > 0) & (F.size(parts) < n_strengths), wider).otherwise(parts)


def bind_strengths(n_molecules: Column, parts: Column, reason: Column) -> Column:
    """struct(strengths, reason): one strength per molecule, "" where there is none. Several strengths of one molecule
    are its combination, in alphabetical order; other counts that differ are a reason to leave the row out."""
    empty = F.array_repeat(F.lit(""), n_molecules)
    kind = "struct<strengths:array<string>,reason:string>"
    as_struct = lambda s, r: F.struct(s, r).cast(kind)
    none = F.lit(None)
    return (
        F.when(parts.isNull() & (reason == "absent_strength"), as_struct(empty, none))
        .when(parts.isNull(), as_struct(none, reason))
        .when(F.size(parts) == n_molecules, as_struct(parts, none))
        .when(n_molecules == 1, as_struct(F.array(F.array_join(F.array_sort(parts), "+")), none))
        .otherwise(as_struct(none, F.lit("molecule_strength_count_mismatch")))
    )
