"""Pack sizes: what a product's pack holds, as a kind and a value."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricebridge.dims import NUMBER_WORDS, PACK_BASIS
from pricebridge.functions.forms import lookup
from pricebridge.functions.text import clean_text, first_number, has

_N = r"(\d+(?:\.\d+)?)"
# Pack shapes in the order in which they are tried: pattern, kind, factor, words that rule it out.
_SHAPES: tuple[tuple[str, str, float, tuple[str, ...]], ...] = (
    (_N + r"\s*(?:mdi|md)\b", "dose_count", 1.0, ("mono",)),
    (_N + r"\s*doses?\b", "dose_count", 1.0, ()),
    (_N + r"\s*ml\b", "volume_ml", 1.0, ()),
    (_N + r"\s*kg\b", "weight_g", 1000.0, ()),
    (_N + r"\s*(?:gms?|grams?|g)\b", "weight_g", 1.0, ("gel cool", "carry bag")),
)
_PIECES: tuple[str, ...] = (
    _N + r"\s*'s",
    _N + r"\s*sachets?\b",
    _N + r"\s*s\s+in\s+containers?",
    r"pack\s+of\s+" + _N,
    _N + r"\s*pcs?\b",
    _N + r"\s*(?:ear\s*buds?|wipes?)\b",
    _N + r"\s*strips?\b",
)
_SQUARE = _N + r"\s*x\s*" + _N + r"\s*'s"
_WORD = r"\b(" + "|".join(NUMBER_WORDS) + r")\b(?:\s*x\s*" + _N + ")?"


def parse_pack(unit_size: Column) -> Column:
    """struct(kind, value, reason); the first shape that applies wins. reason is unparseable_pack where none does."""
    raw = F.regexp_replace(clean_text(unit_size), "’", "'")
    return pack_of_clean(raw)


def pack_of_clean(raw: Column) -> Column:
    low = F.lower(raw)
    says = lambda *words: [low.contains(w) for w in words]

    def made(kind: str, value: Column, *conditions: Column) -> Column:
        test = value.isNotNull()
        for c in conditions:
            test = test & c
        return F.when(test, F.struct(F.lit(kind).alias("kind"), value.alias("value")))

    ladder = [made(kind, first_number(raw, pattern) * factor, *(~x for x in says(*unless))) for pattern, kind, factor, unless in _SHAPES]
    vial = has(raw, r"\bvials?\b") | has(raw, r"\bwfi\b") | low.contains("ampoule") | low.contains("amp.")
    ladder.append(made("vial", F.lit(1.0), vial))
    ladder.append(made("count", first_number(raw, _SQUARE, 1) * first_number(raw, _SQUARE, 2)))
    ladder += [made("count", first_number(raw, p)) for p in _PIECES]
    ladder.append(made("count", first_number(low, r"of\s+" + _N + r"\s+tablets?"), low.contains("combipack of") | low.contains("combikit of")))
    word = F.lower(F.regexp_extract(raw, "(?iU)" + _WORD, 1))
    number = F.create_map(*map(F.lit, chain.from_iterable((k, float(v)) for k, v in NUMBER_WORDS.items())))[word]
    any_of = low.contains("mono") | low.contains("pack") | low.contains("strip") | low.contains("pair")
    ladder.append(made("count", number * F.coalesce(first_number(raw, _WORD, 2), F.lit(1.0)), any_of))
    found = F.coalesce(*ladder)
    return F.struct(found["kind"].alias("kind"), found["value"].alias("value"), F.when(found.isNull(), F.lit("unparseable_pack")).alias("reason"))


def pack_basis(kind: Column) -> Column:
    """The price basis of a pack kind."""
    return lookup(PACK_BASIS, kind)
