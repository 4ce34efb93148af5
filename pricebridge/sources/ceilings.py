"""Ceiling-price files: CSV with a preamble, a header found by its names, and quoted line ends; to rows and rejects."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricebridge.functions.forms import form_strength
from pricebridge.functions.qualifiers import parse_qualifier, price_and_qualifier

# Header cells by the column that they name; the last one by how it begins.
HEADERS = {"SL No": "sl_no", "S.No.": "sl_no", "NLEM Version": "nlem_version", "Formulation": "formulation", "Dosage & Strength": "dosage", "SO Number": "so_number", "SO Date": "so_date"}
PRICE_HEADER = "Ceiling Price"
COLUMNS = ("sl_no", "nlem_version", "formulation", "dosage", "so_number", "so_date", "price")
OPTIONAL = {"nlem_version"}


def _places(cells: list[str]) -> dict[str, int]:
    """Where each column stands in a header; the first cell of a name counts."""
    out: dict[str, int] = {}
    for i, cell in enumerate(map(str.strip, cells)):
        name = HEADERS.get(cell) or ("price" if cell.startswith(PRICE_HEADER) else None)
        if name:
            out.setdefault(name, i)
    return out


def _records(content: bytes) -> Iterator[tuple]:
    """(record number, the cells of COLUMNS) below the header; null for a column that the file lacks."""
    place: dict[str, int] | None = None
    for number, cells in enumerate(csv.reader(io.StringIO(content.decode("utf-8-sig"), newline="")), 1):
        if place is None:
            found = _places(cells)
            if "sl_no" in found:
                lacking = [c for c in COLUMNS if c not in found and c not in OPTIONAL]
                if lacking:
                    raise ValueError(f"ceiling header lacks {lacking}")
                place = found
        elif any(c.strip() for c in cells):
            yield (number, *(None if c not in place else cells[place[c]].strip() if place[c] < len(cells) else "" for c in COLUMNS))
    if place is None:
        raise ValueError("no ceiling header (SL No / S.No.) found")


def read_ceilings(spark: SparkSession, path: str, label: str) -> DataFrame:
    """source_file (the label), csv_record and the cells of every record below the header; sha256 of the file. A file is
    read by one task, as quoted line ends make records depend on all before."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for content, sha in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [(sha, *r) for r in _records(content)]
                if rows:
                    cells = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(cells[0]), pa.array(cells[1], pa.int64()), *(pa.array(c, pa.string()) for c in cells[2:])], names=["sha256", "csv_record", *COLUMNS])

    files = spark.read.format("binaryFile").load(path).select("content", F.upper(F.sha2("content", 256)).alias("sha256"))
    return files.mapInArrow(run, "sha256 string, csv_record long, " + ", ".join(f"{c} string" for c in COLUMNS)).withColumn("source_file", F.lit(label))


def both(spark: SparkSession, all_path: str, special_path: str) -> DataFrame:
    return read_ceilings(spark, all_path, "nppa_all").unionByName(read_ceilings(spark, special_path, "nppa_special"))


def checked(records: DataFrame) -> DataFrame:
    """Records with parsed prices, qualifiers and dosages, and reason: null for rows that stand, else the first check
    that fails. Of rows that agree in formulation, strength, qualifier and price the first of a file stands."""
    empty = lambda c: F.coalesce(F.col(c) == "", F.lit(True))
    number = F.when(F.col("sl_no").rlike(r"^[+-]?\d+(_\d+)*$"), F.regexp_replace("sl_no", "_", "").cast("int"))
    rows = records.withColumns({"sl": number, "p": price_and_qualifier(F.col("price")), "fs": form_strength(F.col("dosage"))})
    rows = rows.withColumn("q", F.when(F.col("p.qualifier") != "", parse_qualifier(F.col("p.qualifier"))))
    reason: Column = (
        F.when(F.col("sl").isNull(), "invalid_sl_no").when(empty("formulation"), "missing_formulation").when(empty("so_number"), "missing_field:so_number")
        .when(empty("so_date"), "missing_field:so_date").when(F.col("p").isNull(), "unparseable_price").when(F.col("q").isNull(), "unparseable_price_qualifier")
    )
    rows = rows.withColumn("reason", reason)
    same = Window.partitionBy("source_file", F.col("reason").isNull(), "formulation", "fs.strength", "p.qualifier", "p.price").orderBy("csv_record")
    again = F.col("reason").isNull() & (F.row_number().over(same) > 1)
    return rows.withColumn("reason", F.when(again, "duplicate_row").otherwise(F.col("reason")))


def split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ceilings, rejects) of checked() rows. Ceilings have no id yet: source_file and csv_record order them."""
    source_row = F.format_string("%s sl_no=%s csv_record=%s", "source_file", F.when(F.col("sl_no") != "", F.col("sl_no")).otherwise("?"), F.col("csv_record").cast("string"))
    good = rows.filter("reason IS NULL").select(
        F.col("sl").alias("sl_no"), "nlem_version", "source_file", F.col("formulation").alias("formulation_raw"), F.col("fs.form").alias("form_raw"), F.col("fs.strength").alias("strength_raw"),
        "so_number", "so_date", F.col("p.price").alias("price_value"), "q.unit_type", "q.unit_count", "q.pack_volume_ml", "q.container", "q.pack_condition_raw", F.col("p.qualifier").alias("qualifier_raw"),
        source_row.alias("source_row"), "csv_record",
    )
    return good, rows.filter("reason IS NOT NULL").select("source_file", F.when(F.col("reason") != "invalid_sl_no", F.col("sl")).alias("sl_no"), "reason", "csv_record")
