"""The match ladder: exact, alias, fuzzy, form family. Each stage sees only what the ones before left over, so stages
stay separate joins; what they say of a key is folded together at the end."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricebridge.functions.similarity import near_lengths, ratio_column
from pricebridge.store import settle

ACCEPT, REVIEW, REVIEW_ROWS = 92.0, 85.0, 200
EXACT, ALIAS, FUZZY, FAMILY = 1, 2, 3, 4


def _spelt(n: Column, j: Column) -> Column:
    return F.array_sort(n) != F.array_sort(j)


def _pairs(hits: DataFrame, stage: int, via: Column) -> DataFrame:
    """One row per pair of a stage, with what the fold needs. n_ and j_ columns are the ceiling's and the product's."""
    return hits.select(
        F.col("n_key_alias").alias("match_key"), F.col("n_row_id").alias("row_id"), F.col("j_product_id").alias("product_id"), F.lit(stage).alias("stage"),
        via.alias("via"), _spelt(F.col("n_modifiers"), F.col("j_modifiers")).alias("differs"), (F.col("n_low_confidence") | F.col("j_low_confidence")).alias("low"),
        F.exists("n_strengths", lambda s: F.coalesce(s, F.lit("")) == "").alias("blank"), F.array_sort(F.array_union("n_modifiers", "j_modifiers")).alias("modifiers"),
        F.col("n_molecule_set").alias("molecule_set"), F.col("n_strength_set").alias("strength_set"), F.col("n_form").alias("form"), F.col("n_family").alias("family"),
    )


def _named(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*(F.col(c).alias(prefix + c) for c in df.columns))


_NEED_N = ["row_id", "key_plain", "key_alias", "conv_plain", "conv_alias", "modifiers", "low_confidence", "strengths", "molecule_set", "strength_set", "form", "family", "molecules_alias", "formulation_raw", "strength_raw"]
_NEED_J = ["product_id", "key_plain", "key_alias", "conv_plain", "conv_alias", "modifiers", "low_confidence", "molecule_set", "strength_set", "form", "family", "molecules_alias", "generic_name"]


def _by_key(n: DataFrame, j: DataFrame, key: str, conv: str, stage: int) -> DataFrame:
    """Ceilings probe products by their key, and by their own twin key only where that finds none. Products can be found
    by either of theirs."""
    index = j.withColumn("k", F.explode(F.array_distinct(F.array_compact(F.array(f"j_{key}", f"j_{conv}")))))
    direct = n.join(index, F.col(f"n_{key}") == F.col("k"))
    rest = n.join(index.select(F.col("k").alias("taken")).distinct(), F.col(f"n_{key}") == F.col("taken"), "left_anti")
    turned = rest.join(index, F.col(f"n_{conv}") == F.col("k"))
    return _pairs(direct, stage, F.lit(False)).unionByName(_pairs(turned, stage, F.lit(True)))


def _left(n: DataFrame, j: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    return (
        n.join(pairs.select(F.col("row_id").alias("n_row_id")).distinct(), "n_row_id", "left_anti"),
        j.join(pairs.select(F.col("product_id").alias("j_product_id")).distinct(), "j_product_id", "left_anti"),
    )


@dataclass
class Ladder:
    """pairs: all matched pairs by stage; review: near misses of the fuzzy stage; slashes: ceilings whose molecules and
    strengths are known, but not in this pairing; n and j: the records that entered, with prefixes n_ and j_."""

    pairs: DataFrame
    review: DataFrame
    slashes: DataFrame
    n: DataFrame
    j: DataFrame


def run_ladder(products: DataFrame, ceilings: DataFrame) -> Ladder:
    """Match canonical records, best settled ones. Every stage's pairs are settled: later stages read them several times."""
    n = _named(ceilings.filter("ok").select(*_NEED_N), "n_")
    j = _named(products.filter("ok").select(*_NEED_J), "j_")
    stage1 = settle(_by_key(n, j, "key_plain", "conv_plain", EXACT), "exact")
    n1, j1 = _left(n, j, stage1)
    stage2 = settle(_by_key(n1, j1, "key_alias", "conv_alias", ALIAS), "alias")
    n2, j2 = _left(n1, j1, stage2)

    singles = F.col("n_strength_set") == F.col("j_strength_set")
    block = n2.filter(F.size("n_molecules_alias") == 1).join(j2.filter(F.size("j_molecules_alias") == 1), singles & (F.col("n_form") == F.col("j_form")))
    one, other = F.get("n_molecules_alias", F.lit(0)), F.get("j_molecules_alias", F.lit(0))
    scored = block.filter(near_lengths(one, other, REVIEW)).withColumn("score", ratio_column(one, other)).filter(F.col("score") >= REVIEW)  # less is never used
    best = settle(scored.withColumn("place", F.row_number().over(Window.partitionBy("n_row_id").orderBy(F.desc("score"), "j_product_id"))).filter("place = 1"), "near")
    good = (F.col("score") >= ACCEPT) & ~_spelt(F.col("n_modifiers"), F.col("j_modifiers"))
    stage3 = _pairs(best.filter(good), FUZZY, F.lit(False))
    review = best.filter(~good & (F.col("score") >= REVIEW)).orderBy("n_row_id").limit(REVIEW_ROWS)
    review = review.select(F.col("n_formulation_raw").alias("formulation_raw"), F.col("n_row_id").alias("row_id"), F.col("j_generic_name").alias("generic_name"), F.col("j_product_id").alias("product_id"), F.round("score", 1).alias("score"))

    n3, j3 = _left(n2, j2, stage3)
    family = (F.col("n_molecule_set") == F.col("j_molecule_set")) & (F.col("n_strength_set") == F.col("j_strength_set")) & (F.col("n_family") == F.col("j_family"))
    stage4 = settle(_pairs(n3.join(j3, family & (F.col("n_form") != F.col("j_form"))), FAMILY, F.lit(False)), "family")
    n4, _ = _left(n3, j3, stage4)

    combos = n4.filter((F.size("n_molecules_alias") > 1) & (F.col("n_formulation_raw").contains("+") | F.coalesce(F.col("n_strength_raw").contains("/"), F.lit(False)) | F.col("n_formulation_raw").contains("(A)")))
    slashes = combos.join(j, (combos["n_molecule_set"] == j["j_molecule_set"]) & (combos["n_strength_set"] == j["j_strength_set"]), "left_semi").join(j, combos["n_key_alias"] == j["j_key_alias"], "left_anti")
    pairs = stage1.unionByName(stage2).unionByName(stage3).unionByName(stage4)
    return Ladder(pairs, review, slashes, n, j)


def fold_matches(pairs: DataFrame) -> DataFrame:
    """One row per match key: ids, method, confidence and what its first pair says of the key.

    First is by stage, ceiling and product. A form-family pair decides for low, else the last fuzzy pair, else one pair
    with other modifiers relaxes the whole key; else the first pair says exact or alias, and medium if it came by
    conversion or is unsure of a strength.
    """
    order = F.struct("stage", "row_id", "product_id")
    first = lambda c: F.min_by(c, order)
    some = lambda c: F.max(F.coalesce(c, F.lit(False)))
    got = pairs.groupBy("match_key").agg(
        first("molecule_set").alias("molecule_set"), first("strength_set").alias("strength_set"), first("form").alias("form"), first("family").alias("family"),
        first("modifiers").alias("modifiers"), F.array_sort(F.collect_set("row_id")).alias("nppa_ids"), F.array_sort(F.collect_set("product_id")).alias("jap_ids"),
        some(F.col("stage") == FAMILY).alias("family_pair"), some(F.col("stage") == FUZZY).alias("fuzzy_pair"), F.max_by("low", F.when(F.col("stage") == FUZZY, F.struct("row_id", "product_id"))).alias("fuzzy_low"),
        some((F.col("stage") <= ALIAS) & F.col("differs")).alias("relaxed"), some("via").alias("via_conversion"),
        F.min_by(F.struct("stage", "via", "low", "blank"), order).alias("f"),
    )
    method = F.when(F.col("family_pair"), "form_family").when(F.col("fuzzy_pair"), "fuzzy").when(F.col("relaxed"), "modifier_relaxed").when(F.col("f.stage") == EXACT, "exact").otherwise("alias")
    unsure = F.col("f.via") | F.col("f.low") | F.col("f.blank")
    confidence = (
        F.when(F.col("family_pair"), "low").when(F.col("fuzzy_pair"), F.when(F.col("fuzzy_low"), "low").otherwise("medium")).when(F.col("relaxed"), "low").when(unsure, "medium").otherwise("high")
    )
    return got.withColumns({"match_method": method, "confidence": confidence}).drop("family_pair", "fuzzy_pair", "fuzzy_low", "f")
