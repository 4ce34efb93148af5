"""Price cells such as "₹ 81.87(1000ml Glass)": the value, and what the price is for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricebridge.dims import PRICE_UNITS
from pricebridge.functions.forms import lookup
from pricebridge.functions.text import let, squeeze

_CELL = r"(?sU)^\s*₹\s*([0-9]+(?:\.[0-9]+)?)\s*(.*)$"
_GROUP = r"\((?:[^()]|\([^()]*\))*\)"
_N = r"(\d+(?:\.\d+)?)"
SINGULAR = {plural: unit for unit, plural in PRICE_UNITS.items()} | {unit: unit for unit in PRICE_UNITS}
_COUNTED = "tablets?|capsules?|ml|gm|g|condoms?|suppositor(?:y|ies)|doses?|iuds?|gums?|lozenges?|pastilles?|pessar(?:y|ies)|units?|vials?"
# What may follow "each", which is singular but for two.
_EACH = "vial|dose|condom|suppository|unit|iud|gum|lozenges?|pastilles?|pessary|tablet|capsule"

# The shapes of a group in the order in which they are tried. Each is a pattern of the folded group, then
# unit, count, volume and container; a number stands for the pattern's group of that number.
SHAPES: tuple[tuple[str, str | int | None, float | int | None, int | None, str | None], ...] = (
    (r"each pack ?\( ?" + _N + r" ?ml ?\)", "pack", 1.0, 1, None),
    (r"each " + _N + r" ?ml pack\b.*", "pack", 1.0, 1, None),
    (r"each pack", "pack", 1.0, None, None),
    (r"per dose", "dose", None, None, None),
    (r"per metered dose", "metered_dose", None, None, None),
    (r"per dual chamber bag.*", "dual_chamber_bag", None, None, None),
    (r"per mg of phospholipids in the pack", "mg_phospholipid", None, None, None),
    (r"cubic meters?", "cubic_meter", None, None, None),
    (r"combi packs?", "combi_pack", None, None, None),
    (r"1 gm or 1 ml", "gm_or_ml", 1.0, None, None),
    (_N + r" ?ml non-? ?glass\b.*", "pack", None, 1, "non_glass"),
    (_N + r" ?ml glass\b.*", "pack", None, 1, "glass"),
    (_N + r" ?ml pack", "pack", None, 1, None),
    (r"(?:per )?" + _N + r" ?ml", "ml", 1, None, None),
    (_N + r" ?(" + _COUNTED + r") ?", 2, 1, None, None),
    (r"each (" + _EACH + r") ?", 1, 1.0, None, None),
)
_FIELDS = "struct<unit_type:string,unit_count:double,volume:double,container:string,condition:string,marker:boolean>"


def price_and_qualifier(cell: Column) -> Column:
    """struct(price, qualifier): both null where the cell is no price."""
    price = F.regexp_extract(cell, _CELL, 1)
    return F.when(price != "", F.struct(price.try_cast("double").alias("price"), F.regexp_replace(F.regexp_extract(cell, _CELL, 2), r"(?U)^\s+|\s+$", "").alias("qualifier")))


def classify_group(inner: Column) -> Column:
    """What one bracketed group says, as a struct; null where no shape fits."""
    return let(F.lower(squeeze(inner)), lambda g: _classify_folded(inner, g))


def _classify_folded(inner: Column, g: Column) -> Column:
    def shaped(unit: Column, count: Column, volume: Column, container: Column, condition: Column, marker: bool = False) -> Column:
        return F.struct(unit, count, volume, container, condition, F.lit(marker)).cast(_FIELDS)

    none = F.lit(None)
    threshold = r"(?isU)^\s*1\s*ml\s*\((.*)\)\s*$"
    rules = [
        F.when(g == "pack", shaped(none, none, none, none, none, True)),
        F.when(inner.rlike(threshold), shaped(F.lit("ml"), F.lit(1.0), none, none, F.regexp_replace(F.regexp_extract(inner, threshold, 1), r"(?U)^\s+|\s+$", ""))),
    ]
    for pattern, unit, count, volume, container in SHAPES:
        whole = f"^(?:{pattern})$"
        number = lambda x, whole=whole: F.regexp_extract(g, whole, x).try_cast("double") if type(x) is int else F.lit(x)
        named = lookup(SINGULAR, F.regexp_extract(g, whole, unit)) if type(unit) is int else F.lit(unit)
        rules.append(F.when(g.rlike(whole), shaped(named, number(count), number(volume), F.lit(container), none)))
    return F.coalesce(*rules)


def parse_qualifier(qualifier: Column) -> Column:
    """struct(unit_type, unit_count, pack_volume_ml, container, pack_condition_raw); null where the grammar doesn't cover it.

    Every group must be understood. The first group that says something of a field gives it; "A ml pack" and "B ml pack"
    together are a pack of A ml priced per B ml.
    """
    rest = F.regexp_replace(F.regexp_replace(qualifier, _GROUP, ""), r"(?U)\s", "")
    inner = F.transform(F.regexp_extract_all(qualifier, F.lit(_GROUP), F.lit(0)), lambda x: F.substring(x, F.lit(2), F.length(x) - 2))
    both = F.transform(inner, lambda x: F.struct(x.alias("text"), classify_group(x).alias("said")))
    return F.when(rest == "", let(both, _merge_groups))


_PACK = "^" + _N + r" ?ml pack$"


def _merge_groups(groups: Column) -> Column:
    """What all groups (text, said) say together."""
    units = F.filter(groups, lambda x: x["said"]["unit_type"].isNotNull())
    first = lambda field: F.get(F.filter(F.transform(groups, lambda x: x["said"][field]), lambda v: v.isNotNull()), F.lit(0))
    unit = F.get(units, F.lit(0))["said"]
    none = F.lit(None).cast("string")
    fields = lambda *c: F.struct(*(x.alias(n) for x, n in zip(c, ("unit_type", "unit_count", "pack_volume_ml", "container", "pack_condition_raw"), strict=True)))
    merged = fields(unit["unit_type"], unit["unit_count"], first("volume"), first("container"), F.nullif(first("condition"), F.lit("")))
    volume = lambda i: F.regexp_extract(F.lower(squeeze(F.get(groups, F.lit(i))["text"])), _PACK, 1)
    per = fields(F.lit("ml"), volume(1).try_cast("double"), volume(0).try_cast("double"), none, none)
    clear = (F.size(groups) > 0) & F.forall(groups, lambda x: x["said"].isNotNull())
    two = (F.size(groups) == 2) & (volume(0) != "") & (volume(1) != "")
    return F.when(clear, F.when(two, per).when(F.size(units) > 0, merged))
