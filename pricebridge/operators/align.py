"""Prices on a common basis: per-unit ceilings, the best-fitting variant of a ceiling, and what a product saves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricebridge.dims import PIECE_UNITS
from pricebridge.functions.forms import list_rank, pack_condition
from pricebridge.functions.packs import pack_basis
from pricebridge.store import settle


def ceiling_basis(unit: Column, count: Column, volume: Column, price: Column) -> Column:
    """struct(basis, per_unit); null where a ceiling has no common basis."""
    n = F.coalesce(F.nullif(count, F.lit(0.0)), F.lit(1.0))
    of = lambda basis, value: F.struct(F.lit(basis).alias("basis"), value.alias("per_unit"))
    return (
        F.when(unit.isin(*PIECE_UNITS), of("count", price / n))
        .when(unit == "ml", of("ml", price / n))
        .when(unit.isin("dose", "metered_dose"), of("dose", price))
        .when(unit == "gm", of("g", price / n))
        .when(unit == "vial", of("vial", price))
        .when((unit == "pack") & (volume != 0), of("ml", price / F.nullif(volume, F.lit(0.0))))
    )


def savings(per_unit: Column, ceiling: Column) -> Column:
    """Percent below the ceiling; 0 where the ceiling is 0."""
    return F.when(ceiling != 0, (F.lit(1.0) - per_unit / F.nullif(ceiling, F.lit(0.0))) * 100.0).otherwise(0.0)


def _fit(df: DataFrame) -> DataFrame:
    """Adds how a candidate ceiling fits a product's pack: the ranks to sort by, and the label of what decided."""
    kind, volume, basis, unit = F.col("pack_kind"), F.col("jap_volume"), F.col("basis"), F.col("unit_type")
    exact = F.coalesce(F.col("pack_volume_ml") == volume, F.lit(False))
    asked = F.when(volume < 10, "less_than_10").otherwise("more_10")
    condition = pack_condition(F.col("pack_condition_raw"))
    condition_rank = F.when(volume.isNull() | condition.isNull(), 1).when(condition == asked, 0).otherwise(2)
    unit_is = lambda u: F.coalesce(unit == u, F.lit(False))
    same = (
        ((kind == "count") & (basis == "count")) | ((kind == "volume_ml") & unit_is("ml")) | ((kind == "dose_count") & unit_is("metered_dose"))
        | ((kind == "weight_g") & (basis == "g")) | ((kind == "vial") & (basis == "vial"))
    )
    per_unit = ((kind == "dose_count") & (basis == "dose")) | ((kind == "volume_ml") & (basis == "ml"))
    unit_rank = F.when(same, 0).when(per_unit, 1).otherwise(2)
    label = (
        F.when(exact, "exact_volume").when(condition_rank == 0, "pack_condition_match").when(unit_rank == 0, "same_unit_type").when(unit_rank == 1, "per_unit_row").otherwise("fallback_unit")
    )
    return df.withColumns({"r_exact": F.when(exact, 0).otherwise(1), "r_condition": condition_rank, "r_unit": unit_rank, "r_list": list_rank(F.col("nlem_version")), "nppa_variant_basis": label})


def priced_pairs(matches: DataFrame, products: DataFrame) -> DataFrame:
    """(match_key, product, why): every product of every key; why is null, or the reason that it can't be compared."""
    j = products.select("product_id", "mrp", "pack_kind", "pack_value", "pack_parsed")
    pairs = matches.select("match_key", "match_method", "confidence", F.explode("jap_ids").alias("product_id")).join(j, "product_id")
    unpacked = F.col("pack_kind").isNull() | F.coalesce(F.col("pack_value") == 0, F.lit(True)) | pack_basis(F.col("pack_kind")).isNull()
    return pairs.withColumn("why", F.when(F.col("mrp") == 0, "excluded_zero_mrp").when(unpacked, "excluded_unparseable_pack"))


def equivalences(matches: DataFrame, products: DataFrame, ceilings: DataFrame, computed_at: str) -> DataFrame:
    """The aligned comparisons, one per key and product with a ceiling on the same basis."""
    fit = candidates(matches, products, ceilings)
    best = Window.partitionBy("match_key", "product_id").orderBy("r_exact", "r_condition", "r_unit", "r_list", "row_id")
    top = _fit(fit).withColumn("place", F.row_number().over(best)).filter("place = 1")
    per_unit = F.col("mrp") / F.col("pack_value")
    out = top.select(
        "match_key", F.col("row_id").alias("nppa_row_id"), F.col("product_id").alias("jap_product_id"), F.col("per_unit").alias("nppa_ceiling_per_unit"),
        F.col("basis").alias("nppa_unit_basis"), "nppa_variant_basis", F.col("nlem_version").alias("nppa_nlem_version"), per_unit.alias("jap_per_unit"),
        F.col("pack_parsed").alias("jap_pack_parsed"), savings(per_unit, F.col("per_unit")).alias("savings_pct"), "match_method", "confidence", F.lit(computed_at).alias("computed_at"),
    )
    return out


def candidates(matches: DataFrame, products: DataFrame, ceilings: DataFrame) -> DataFrame:
    """Comparable products with all ceilings of their key on the same basis."""
    j = priced_pairs(matches, products).filter("why IS NULL").withColumn("basis", pack_basis(F.col("pack_kind")))
    j = j.withColumn("jap_volume", F.when(F.col("pack_kind") == "volume_ml", F.col("pack_value")))
    b = ceiling_basis(F.col("unit_type"), F.col("unit_count"), F.col("pack_volume_ml"), F.col("price_value"))
    n = ceilings.select("row_id", "unit_type", "pack_volume_ml", "pack_condition_raw", "nlem_version", b.alias("b")).filter("b IS NOT NULL").select("*", "b.basis", "b.per_unit").drop("b")
    n = matches.select("match_key", F.explode("nppa_ids").alias("row_id")).join(n, "row_id")
    return j.join(n, ["match_key", "basis"])


def price_exclusions(matches: DataFrame, products: DataFrame, equivalents: DataFrame) -> DataFrame:
    """reason, n: products of matched keys that are not compared."""
    pairs = priced_pairs(matches, products)
    lost = pairs.filter("why IS NULL").join(equivalents.select("match_key", F.col("jap_product_id").alias("product_id")), ["match_key", "product_id"], "left_anti")
    reasons = pairs.filter("why IS NOT NULL").select(F.col("why").alias("reason")).unionByName(lost.select(F.lit("excluded_basis_mismatch").alias("reason")))
    return reasons.groupBy("reason").agg(F.count("*").alias("n"))


def with_ids(df: DataFrame, *order: str, name: str = "id", parts: int | None = None) -> DataFrame:
    """df with gapless ids from 1 in the given order, without a sort in one task: ranges, by default as many as the session's
    shuffle partitions, are counted, then numbered."""
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = settle(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}), "ranged")
    counts = ranged.groupBy("__part").agg(F.count("*").alias("n"), F.min("__at").alias("lo")).orderBy("__part").collect()  # a row per range
    starts, total = [], 0
    for c in counts:
        starts.append((c["__part"], total - c["lo"] + 1))
        total += c["n"]
    table = spark.createDataFrame(starts, "__part int, __shift long")
    return ranged.join(F.broadcast(table), "__part").withColumn(name, F.col("__at") + F.col("__shift")).drop("__part", "__at", "__shift")
