"""The canonical table, its metadata and the audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricebridge.operators.canonical import exclusions, naive_baseline
from pricebridge.operators.ladder import ALIAS, EXACT, FAMILY, FUZZY, Ladder


def canonical_formulations(products: DataFrame, ceilings: DataFrame, pairs: DataFrame, matches: DataFrame) -> DataFrame:
    """One row per canonical key of any ceiling or of a product that matched nothing; matched keys carry what the ladder
    says of them. ord is the order in which keys are first seen: ceilings by id, then products by id."""
    fields = ["key_alias", "molecule_set", "strength_set", "form", "family", "modifiers"]
    n = ceilings.filter("ok").select(*fields, F.lit(0).alias("side"), F.col("row_id").alias("id"))
    matched = pairs.select("product_id").distinct()
    j = products.filter("ok").join(matched, "product_id", "left_anti").select(*fields, F.lit(1).alias("side"), F.col("product_id").alias("id"))
    seen = F.struct("side", "id")
    ids = lambda side: F.array_sort(F.collect_set(F.when(F.col("side") == side, F.col("id"))))
    rows = n.unionByName(j).groupBy(F.col("key_alias").alias("match_key")).agg(
        *(F.min_by(c, seen).alias(c) for c in fields[1:]), ids(0).alias("nppa_ids"), ids(1).alias("jap_product_ids"), F.min(seen).alias("first")
    )
    m = matches.select("match_key", *(F.col(c).alias(f"m_{c}") for c in ("molecule_set", "strength_set", "modifiers", "nppa_ids", "jap_ids", "match_method", "confidence")))
    over = rows.join(m, "match_key", "left")
    hit = F.col("m_match_method").isNotNull()
    text = lambda c: F.array_join(c, ",")
    keep = lambda c: F.coalesce(F.nullif(F.col(f"m_{c}"), F.lit("")), F.col(c))
    out = over.select(
        "match_key", keep("molecule_set").alias("molecule_set"), keep("strength_set").alias("strength_set"), "form", F.col("family").alias("form_family"),
        F.coalesce(F.nullif(text("m_modifiers"), F.lit("")), text("modifiers")).alias("modifiers"), F.when(hit, F.col("m_nppa_ids")).otherwise(F.col("nppa_ids")).alias("nppa_ids"),
        F.when(hit, F.col("m_jap_ids")).otherwise(F.col("jap_product_ids")).alias("jap_product_ids"), F.col("m_match_method").alias("match_method"),
        F.coalesce("m_confidence", F.lit("unmatched")).alias("confidence"), (F.col("first.side").cast("long") * (1 << 40) + F.col("first.id")).alias("ord"),
    )
    return out


def orphaned_products(products: DataFrame, ladder: Ladder) -> DataFrame:
    """Products that matched nothing though a ceiling bears their alias key: that ceiling had matched earlier."""
    matched = ladder.pairs.select("product_id").distinct()
    keys = ladder.pairs.select(F.col("match_key").alias("key_alias")).distinct()
    return products.filter("ok").join(matched, "product_id", "left_anti").join(keys, "key_alias", "left_semi")


def _one(df: DataFrame, key: str, value) -> DataFrame:
    return df.agg(value.cast("string").alias("value")).select(F.lit(key).alias("key"), "value")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def match_meta(products: DataFrame, ceilings: DataFrame, raw_ceilings: DataFrame, ladder: Ladder, matches: DataFrame, equivalents: DataFrame, price_reasons: DataFrame, computed_at: str) -> DataFrame:
    """key, value (strings) of a match: the ladder, coverage, what is unmatched, and why rows were left out."""
    spark = products.sparkSession
    count = F.count("*")
    pairs = ladder.pairs
    by_stage = pairs.agg(
        *(F.count_distinct(F.when(F.col("stage") == s, F.col("match_key"))).cast("string").alias(k) for k, s in (("match_stage_1_count", EXACT), ("match_stage_2_count", ALIAS), ("match_stage_3_count", FUZZY), ("form_family_count", FAMILY))),
        F.count_distinct("match_key").cast("string").alias("matched_nppa_keys"), F.count_distinct("row_id").cast("string").alias("matched_nppa_rows"), F.count_distinct("product_id").cast("string").alias("matched_jap_products"),
    )
    names = by_stage.columns
    stages = by_stage.select(F.expr(f"stack({len(names)}, " + ", ".join(f"'{c}', {c}" for c in names) + ") as (key, value)"))
    lower = lambda c: F.lower(F.coalesce(c, F.lit("")))
    left = lambda df, col, own: df.filter("ok").join(pairs.select(F.col(own).alias(col)).distinct(), col, "left_anti")
    single = [
        spark.createDataFrame([("match_computed_at", computed_at)], "key string, value string"), stages,
        _one(naive_baseline(products, raw_ceilings), "stage_0_baseline_count", count),
        _one(matches.filter("relaxed"), "modifier_relaxed_count", count), _one(matches.filter("via_conversion"), "pct_conversion_count", count),
        _one(ladder.slashes, "slash_mismatch_count", count), _one(ceilings.filter("ok"), "nppa_canonical_keys", F.count_distinct("key_alias")),
        _one(raw_ceilings.select("formulation_raw", "strength_raw").distinct(), "nppa_raw_keys", count),
        _one(raw_ceilings.select(lower(F.col("formulation_raw")), lower(F.col("form_raw")), lower(F.col("strength_raw"))).distinct(), "nppa_formulation_keys", count),
        _one(left(ceilings, "row_id", "row_id"), "unmatched_nppa_count", count), _one(left(products, "product_id", "product_id"), "unmatched_jap_count", count),
        _one(equivalents, "equivalents_count", count),
    ]
    reasons = exclusions(products, ceilings).unionByName(price_reasons)
    folded = F.regexp_replace(F.regexp_replace("reason", "^pack:", ""), ":", "_")
    named = F.when(folded.startswith("excluded_"), folded).otherwise(F.concat(F.lit("excluded_"), folded))
    out = reasons.groupBy(named.alias("key")).agg(F.sum("n").cast("string").alias("value"))
    return _union([*single, out])


def upsert_meta(old: DataFrame, new: DataFrame) -> DataFrame:
    """Metadata of old and new; new wins."""
    return new.unionByName(old.join(new.select("key"), "key", "left_anti"))


def unmatched_report(products: DataFrame, ceilings: DataFrame, ladder: Ladder, top: int = 15) -> tuple[DataFrame, DataFrame]:
    """The most frequent unmatched formulations, and molecule sets of products; ties as first seen."""
    n = ceilings.filter("ok").join(ladder.pairs.select("row_id").distinct(), "row_id", "left_anti")
    j = products.filter("ok").join(ladder.pairs.select("product_id").distinct(), "product_id", "left_anti")
    by = lambda df, id_, *c: df.groupBy(*c).agg(F.count("*").alias("n"), F.min(id_).alias("first")).orderBy(F.desc("n"), "first").limit(top).drop("first")
    return by(n, "row_id", "formulation_raw", "strength_set"), by(j, "product_id", "molecule_set", "form")


def dangling(equivalents: DataFrame, canonical: DataFrame, ceilings: DataFrame, products: DataFrame) -> DataFrame:
    """check, n: references of equivalents that lead nowhere, and compared products without a price. All must be 0."""
    e = equivalents
    lost = lambda other, own, key: e.join(other.select(F.col(key).alias("k")).distinct(), F.col(own) == F.col("k"), "left_anti")
    free = e.join(products.filter("mrp = 0").select(F.col("product_id").alias("k")), F.col("jap_product_id") == F.col("k"), "left_semi")
    checks = {"match_key": lost(canonical, "match_key", "match_key"), "nppa_row_id": lost(ceilings, "nppa_row_id", "id"), "jap_product_id": lost(products, "jap_product_id", "product_id"), "zero_mrp": free}
    return _union([df.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n") for name, df in checks.items()])

