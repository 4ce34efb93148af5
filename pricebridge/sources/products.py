"""Product documents: a JSON envelope, or a bare list, to validated rows and rejects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The order of the checks is part of the contract: the first that fails names the reject.
_VALUES = "productId, drugCode, genericName, groupName, unitSize, mrp, status"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """path, content, sha256 (upper-case hex) of whole files."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("content").cast("string").alias("content"), F.upper(F.sha2("content", 256)).alias("sha256"))


def product_rows(documents: DataFrame) -> DataFrame:
    """One variant per product of every document, in order (path, at, row, sha256). Documents of another shape have none."""
    doc = F.try_parse_json("content")
    body = F.try_variant_get(doc, "$.responseBody.newProductResponsesList", "array<variant>")
    rows = F.coalesce(F.try_variant_get(doc, "$", "array<variant>"), body)
    return documents.select("path", "sha256", F.posexplode(rows).alias("at", "row"))


def _kind(row: Column, name: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(row, f"$.{name}", "variant"))


def _is_whole(kind: Column) -> Column:
    return kind.rlike("^(BIGINT|INT|SMALLINT|TINYINT)$") | kind.rlike(r"^DECIMAL\(\d+,0\)$")


def checked(rows: DataFrame) -> DataFrame:
    """Typed columns with reason: null for rows that stand, else the first check that fails."""
    get = lambda name, t: F.try_variant_get("row", f"$.{name}", t)
    kinds = {n: _kind(F.col("row"), n) for n in ("productId", "drugCode", "genericName", "mrp", "status")}
    number = lambda n: kinds[n].isNotNull() & kinds[n].rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL.*)$")
    whole = lambda n: F.coalesce(_is_whole(kinds[n]), F.lit(False))
    name, status = get("genericName", "string"), get("status", "double")
    blank = F.coalesce((kinds["genericName"] != "STRING") | (F.regexp_replace(name, r"(?U)\s", "") == ""), F.lit(True))
    known = F.coalesce(number("status") & status.isin(0.0, 1.0), F.lit(False))
    reason = (
        F.when(~F.coalesce(F.schema_of_variant("row").startswith("OBJECT"), F.lit(False)), "missing_field:row")
        .when(~whole("productId"), "missing_field:product_id").when(~whole("drugCode"), "missing_field:drug_code").when(blank, "missing_field:generic_name")
        .when(~F.coalesce(number("mrp"), F.lit(False)), "invalid_mrp").when(~known, "unknown_status").when(status == 0, "inactive_product")
    )
    return rows.select(
        "path", "at", "sha256", F.when(whole("productId"), get("productId", "bigint")).alias("product_id"), F.when(whole("drugCode"), get("drugCode", "bigint")).alias("drug_code"),
        name.alias("generic_name"), get("groupName", "string").alias("group_name"), get("unitSize", "string").alias("unit_size"), get("mrp", "double").alias("mrp"), status.cast("int").alias("status"), reason.alias("reason"),
    )


def split(rows: DataFrame, ingested_at: str) -> tuple[DataFrame, DataFrame]:
    """(products, rejects) of checked() rows."""
    good = rows.filter("reason IS NULL").select("product_id", "drug_code", "generic_name", "group_name", "unit_size", "mrp", "status", F.lit(ingested_at).alias("ingested_at"), F.col("sha256").alias("source_sha256"))
    return good, rows.filter("reason IS NOT NULL").select("product_id", "reason", "path", "at")


def assert_complete(documents: DataFrame) -> DataFrame:
    """documents, raising where an envelope is no success, is empty, or holds fewer products than it says."""
    doc = F.try_parse_json("content")
    rows = F.size(F.try_variant_get(doc, "$.responseBody.newProductResponsesList", "array<variant>"))
    fault = (
        F.when(~F.coalesce(F.try_variant_get(doc, "$.responseCode", "int") == 200, F.lit(False)), "products response has responseCode != 200")
        .when(~F.coalesce(rows > 0, F.lit(False)), "products pull returned zero rows")
        .when(~F.coalesce(F.try_variant_get(doc, "$.responseBody.totalElement", "int") == rows, F.lit(False)), "partial pull: totalElement differs from the rows received")
    )
    return documents.withColumn("content", F.when(fault.isNotNull(), F.raise_error(fault).cast("string")).otherwise(F.col("content")))
