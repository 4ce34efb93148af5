"""Canonical records: products and ceilings as molecules, strengths, form, modifiers and the keys that they join by."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricebridge.functions.composition import composition
from pricebridge.functions.forms import canonical_form, form_family, modifiers
from pricebridge.functions.keys import key, set_text, twin_key
from pricebridge.functions.molecules import bind_strengths, resolve_all, split_formulation, tidy_all
from pricebridge.functions.packs import parse_pack
from pricebridge.functions.strength import strength
from pricebridge.functions.text import clean_text, fold_text, format_number_text

_KEYS = ("key_plain", "key_alias", "conv_plain", "conv_alias")


def _twins(df: DataFrame) -> DataFrame:
    """Adds twins, the mg/ml of each strength that is a percent by volume, and the four keys.

    Number formatting is Python's, so the values go through it one by one, as columns of their first four places (a
    name has three segments at most, a ceiling as many molecules as it lists; further ones never convert).
    """
    number = lambda i: F.regexp_extract(F.get("strengths", F.lit(i)), r"^([0-9]+(?:\.[0-9]+)?)%wv$", 1)
    places = [F.when(number(i) != "", F.concat(format_number_text(number(i).try_cast("double") * 10.0), F.lit("mg/ml"))) for i in range(4)]
    df = df.withColumns({f"twin_{i}": c for i, c in enumerate(places)})
    df = df.withColumn("twins", F.slice(F.concat(F.array(*(f"twin_{i}" for i in range(4))), F.transform(F.coalesce("strengths", F.array()), lambda _: F.lit(None).cast("string"))), 1, F.greatest(F.size(F.coalesce("strengths", F.array())), F.lit(0))))
    keys = {
        "key_plain": key(F.col("molecules_plain"), F.col("strengths"), F.col("form")),
        "key_alias": key(F.col("molecules_alias"), F.col("strengths"), F.col("form")),
        "conv_plain": twin_key(F.col("molecules_plain"), F.col("strengths"), F.col("twins"), F.col("form")),
        "conv_alias": twin_key(F.col("molecules_alias"), F.col("strengths"), F.col("twins"), F.col("form")),
    }
    df = df.withColumns({k: F.when(F.col("ok"), c) for k, c in keys.items()})
    df = df.withColumns({"molecule_set": F.when(F.col("ok"), set_text(F.col("molecules_alias"))), "strength_set": F.when(F.col("ok"), set_text(F.col("strengths")))})
    return df.drop("twins", *(f"twin_{i}" for i in range(4)))


def canonical_products(products: DataFrame) -> DataFrame:
    """products (product_id, generic_name, unit_size, mrp) as canonical records; ok is false, with a reason, for names
    beyond the grammar. A pack beyond the grammar leaves the record ok, with pack_reason."""
    df = products.select("product_id", "generic_name", "unit_size", "mrp", composition("generic_name").alias("c"), parse_pack(F.col("unit_size")).alias("p"))
    df = df.withColumn("form_folded", fold_text("c.form"))
    df = df.withColumns({"ok": F.col("c.ok"), "reason": F.col("c.reason"), "low_confidence": F.col("c.low_confidence")})
    df = df.withColumns({"molecules_plain": tidy_all(F.col("c.folded")), "strengths": F.col("c.strengths"), "form": F.when(F.col("ok"), canonical_form(F.col("form_folded"))).otherwise("unknown")})
    df = df.withColumns(
        {
            "molecules_alias": resolve_all(F.col("molecules_plain")),
            "family": form_family(F.col("form")),
            "modifiers": F.when(F.col("ok"), F.array_sort(F.array_union(F.col("c.modifiers"), modifiers(F.col("generic_name"))))).otherwise(F.array().cast("array<string>")),
            "pack_kind": F.when(F.col("ok"), F.col("p.kind")),
            "pack_value": F.when(F.col("ok"), F.col("p.value")),
            "pack_reason": F.when(F.col("ok"), F.col("p.reason")),
        }
    )
    df = df.withColumn("pack_parsed", F.concat("pack_kind", F.lit(":"), format_number_text("pack_value")))
    return _twins(df.drop("c", "p", "form_folded"))


def canonical_ceilings(ceilings: DataFrame) -> DataFrame:
    """ceilings (id, formulation_raw, form_raw, strength_raw, unit_type, unit_count, pack_volume_ml, price_value, and, if
    there, pack_condition_raw, nlem_version) as canonical records."""
    none = F.lit(None).cast("string")
    own = ["id", "formulation_raw", "form_raw", "strength_raw", "unit_type", "unit_count", "pack_volume_ml", "price_value"]
    extra = [F.col(c) if c in ceilings.columns else none.alias(c) for c in ("pack_condition_raw", "nlem_version")]
    df = ceilings.select(*own, *extra, strength("strength_raw").alias("s"), clean_text(F.col("formulation_raw")).alias("clean"), fold_text("form_raw").alias("form_folded"))
    df = df.withColumn("molecules", split_formulation(F.col("clean"), F.when(F.size("s.parts") > 0, F.size("s.parts"))))
    df = df.withColumn("bound", bind_strengths(F.size("molecules"), F.col("s.parts"), F.col("s.reason")))
    empty = F.col("molecules").isNull() | (F.size("molecules") < 1)
    df = df.withColumn("reason", F.when(empty, F.lit("unparseable_molecule")).otherwise(F.col("bound.reason"))).withColumn("ok", F.col("reason").isNull())
    df = df.withColumns({"form": F.when(F.col("ok"), canonical_form(F.col("form_folded"))).otherwise("unknown"), "strengths": F.col("bound.strengths")})
    # a plain strength of an injection priced per ml is a concentration
    single = F.get("strengths", F.lit(0))
    per_ml = F.col("form").isin("injection", "infusion") & (F.col("unit_type") == "ml") & (F.coalesce(F.nullif("unit_count", F.lit(0.0)), F.lit(1.0)) == 1.0) & (F.size("strengths") == 1)
    df = df.withColumn("strengths", F.when(per_ml & single.rlike(r"^[0-9]+(\.[0-9]+)?(mg|iu|ku)$"), F.array(F.concat(single, F.lit("/ml")))).otherwise(F.col("strengths")))
    # folded one by one: the array goes through Python as one text, with a character that no name has
    joined = fold_text(F.array_join(F.transform("molecules", lambda m: F.concat(m)), " \x01 "))
    df = df.withColumn("folded", F.split(joined, " \x01 "))
    text = F.concat_ws(" ", F.coalesce("form_raw", F.lit("")), F.coalesce("formulation_raw", F.lit("")), F.coalesce("strength_raw", F.lit("")))
    df = df.withColumns(
        {
            "molecules_plain": tidy_all(F.col("folded")),
            "family": form_family(F.col("form")),
            "modifiers": F.when(F.col("ok"), modifiers(text)).otherwise(F.array().cast("array<string>")),
            "low_confidence": F.lit(False),
        }
    )
    df = df.withColumn("molecules_alias", resolve_all(F.col("molecules_plain")))
    return _twins(df.drop("s", "clean", "molecules", "bound", "folded", "form_folded")).withColumnRenamed("id", "row_id")


def exclusions(products: DataFrame, ceilings: DataFrame) -> DataFrame:
    """reason, n: canonical records left out of matching or, for packs, of prices."""
    left_out = products.filter("NOT ok").select("reason").unionByName(ceilings.filter("NOT ok").select("reason"))
    packs = products.filter("ok AND pack_reason IS NOT NULL").select(F.concat(F.lit("pack:"), "pack_reason").alias("reason"))
    return left_out.unionByName(packs).groupBy("reason").agg(F.count("*").alias("n"))


def naive_key(name, cut: str):
    """Sorted, folded parts of a name."""
    parts = F.transform(F.split(name, cut), lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", ""))
    return F.array_join(F.array_sort(F.filter(parts, lambda p: p != "")), "+")


def naive_baseline(products: DataFrame, ceilings: DataFrame) -> DataFrame:
    """Ceilings whose molecules, merely folded and sorted, are those of some product."""
    from pricebridge.functions.text import casefold

    known = products.select(fold_text("generic_name").alias("text")).select(naive_key(F.col("text"), r"(?U)\s*(?:\+|&|,|\band\b)\s*").alias("naive")).distinct()
    asked = ceilings.withColumn("text", casefold("formulation_raw")).withColumn("naive", naive_key(F.col("text"), r"\+"))
    return asked.join(known, "naive", "left_semi").drop("text")
