"""The build: files to tables, then the match. Tables are written beside each other and moved into place when all are."""

from __future__ import annotations

import argparse
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricebridge.operators import align, canonical, ladder, overlay
from pricebridge.sources import ceilings as ceiling_files
from pricebridge.sources import products as product_files
from pricebridge.store import settle

TABLES = ("jap_products", "nppa_ceiling_prices", "canonical_formulations", "equivalents", "meta")


def now() -> str:
    return datetime.now(UTC).isoformat(timespec="seconds")


@dataclass
class Match:
    """All that a match makes, as DataFrames."""

    products: DataFrame
    ceilings: DataFrame
    ladder: ladder.Ladder
    matches: DataFrame
    equivalents: DataFrame
    canonical: DataFrame
    meta: DataFrame


def match(jap_products: DataFrame, nppa_ceiling_prices: DataFrame, computed_at: str) -> Match:
    """Match the two raw tables. Canonical records, matches and comparisons are settled: what follows reads them often."""
    p = settle(canonical.canonical_products(jap_products), "products")
    c = settle(canonical.canonical_ceilings(nppa_ceiling_prices), "ceilings")
    steps = ladder.run_ladder(p, c)
    matches = settle(ladder.fold_matches(steps.pairs), "matches")
    equivalents = settle(align.equivalences(matches, p, c, computed_at), "equivalences")
    canon = overlay.canonical_formulations(p, c, steps.pairs, matches)
    reasons = align.price_exclusions(matches, p, equivalents)
    meta = overlay.match_meta(p, c, nppa_ceiling_prices, steps, matches, equivalents, reasons, computed_at)
    numbered = align.with_ids(equivalents, "match_key", "jap_product_id").select("id", *equivalents.columns)
    return Match(p, c, steps, matches, numbered, canon, meta)


def report(m: Match) -> dict[str, DataFrame]:
    """What to look at after a match: the most frequent unmatched, near misses, how pairs came about, and examples."""
    n, j = overlay.unmatched_report(m.products, m.ceilings, m.ladder)
    how = m.equivalents.groupBy("match_method", "confidence").agg(F.count("*").alias("n"))
    return {"unmatched ceilings": n, "unmatched products": j, "review queue": m.ladder.review, "methods": how, "examples": m.equivalents.orderBy("id").limit(5)}


def product_tables(documents: DataFrame, source: str, build_ts: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(products, rejects, metadata) of product documents."""
    rows = product_files.checked(product_files.product_rows(documents)).cache()
    good, bad = product_files.split(rows, build_ts)
    n = F.count("*")
    kept, lost = F.count(F.when(F.col("reason").isNull(), 1)), F.count(F.when(F.col("reason").isNotNull(), 1))
    counts = rows.agg(n.cast("string").alias("total_rows"), kept.cast("string").alias("kept_rows"), lost.cast("string").alias("rejected_rows"))
    told = documents.select("sha256").distinct().agg(F.array_join(F.sort_array(F.collect_list("sha256")), ",").alias("source_sha256")).withColumns({"build_ts": F.lit(build_ts), "source_file": F.lit(source)})
    return good, bad, unpivoted(counts).unionByName(unpivoted(told))


def ceiling_tables(records: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ceilings with ids, rejects, metadata) of ceiling records; files has source_file, sha256."""
    rows = ceiling_files.checked(records).cache()
    good, bad = ceiling_files.split(rows)
    numbered = align.with_ids(good, "source_file", "csv_record").drop("csv_record")
    per = rows.groupBy("source_file").agg(F.count("*").alias("rows"), F.count(F.when(F.col("reason").isNull(), 1)).alias("kept"))
    per = per.join(files, "source_file", "left").select("source_file", F.explode(F.create_map(F.lit("rows"), F.col("rows").cast("string"), F.lit("kept"), F.col("kept").cast("string"), F.lit("rejected"), (F.col("rows") - F.col("kept")).cast("string"), F.lit("sha256"), F.col("sha256"))))
    meta = per.select(F.concat_ws("_", "source_file", "key").alias("key"), "value")
    whole = rows.agg(F.count(F.when(F.col("reason") == "duplicate_row", 1)).cast("string").alias("nppa_duplicate_count"), F.count_distinct(F.when(F.col("reason").isNull(), F.col("formulation"))).cast("string").alias("nppa_unique_formulation_keys"))
    return numbered, bad, meta.unionByName(unpivoted(whole))


def unpivoted(row: DataFrame) -> DataFrame:
    """A row's columns as key, value."""
    names = row.columns
    return row.select(F.expr(f"stack({len(names)}, " + ", ".join(f"'{c}', cast({c} as string)" for c in names) + ") as (key, value)"))


def write_rejects(rejects: DataFrame, path: str, *columns: str) -> None:
    """A CSV with a header, even if empty; null ids are empty cells. One file a partition: nothing bounds rejects."""
    rejects.select(*columns).write.mode("overwrite").option("header", True).option("emptyValue", "").option("nullValue", "").csv(path)


def publish(spark: SparkSession, tables: dict[str, DataFrame], path: str) -> None:
    """Write all tables beside path/, then move them into place one after the other."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/.new/{name}")
    for name in tables:
        fs.delete(fs_path(f"{path}/{name}"), True)
        if not fs.rename(fs_path(f"{path}/.new/{name}"), fs_path(f"{path}/{name}")):
            raise OSError(f"{path}/{name} could not be put in place")
    fs.delete(fs_path(f"{path}/.new"), True)


def _file_hashes(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    out = None
    for label, p in paths.items():
        one = spark.read.format("binaryFile").load(p).select(F.lit(label).alias("source_file"), F.upper(F.sha2("content", 256)).alias("sha256"))
        out = one if out is None else out.unionByName(one)
    return out


def build(spark: SparkSession, out: str, source: str | None = None, nppa_all: str | None = None, nppa_special: str | None = None, rejects: str | None = None, run_match: bool = True, live: DataFrame | None = None, build_ts: str | None = None) -> dict[str, DataFrame]:
    """Build the tables under out. Without the products, or without the ceilings, only the other side's table and
    metadata are made anew and there is no match; the rest stays as it was. live: a document of the product service."""
    ts, tables, metas = build_ts or now(), {}, []
    if source is not None or live is not None:
        documents = product_files.read_documents(spark, source) if live is None else live
        good, bad, meta = product_tables(documents, source or "live", ts)
        tables["jap_products"], _ = good, metas.append(meta)
        if rejects:
            write_rejects(bad, f"{rejects}/jap_rejects", "product_id", "reason")
    if nppa_all is not None and nppa_special is not None:
        records = ceiling_files.both(spark, nppa_all, nppa_special).drop("sha256")
        numbered, bad, meta = ceiling_tables(records, _file_hashes(spark, {"nppa_all": nppa_all, "nppa_special": nppa_special}))
        tables["nppa_ceiling_prices"], _ = numbered, metas.append(meta)
        if rejects:
            write_rejects(bad, f"{rejects}/nppa_rejects", "source_file", "sl_no", "reason")
    whole = len(tables) == 2
    if whole and run_match:
        m = match(tables["jap_products"], tables["nppa_ceiling_prices"].cache(), ts)
        tables |= {"canonical_formulations": m.canonical, "equivalents": m.equivalents}
        metas.append(m.meta)
    meta = metas[0]
    for more in metas[1:]:
        meta = meta.unionByName(more)
    if not whole:
        try:
            old = spark.read.parquet(f"{out}/meta")
            meta = overlay.upsert_meta(spark.createDataFrame(old.collect(), old.schema), meta)  # a few dozen rows, about to be replaced
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    publish(spark, {**tables, "meta": meta}, out)
    return {t: spark.read.parquet(f"{out}/{t}") for t in (*tables, "meta")}


def main(argv: list[str] | None = None) -> None:
    """spark-submit entry."""
    from pricebridge.session import session

    p = argparse.ArgumentParser(description="Build the price tables and match them.")
    p.add_argument("--out", required=True)
    p.add_argument("--source")
    p.add_argument("--nppa-all")
    p.add_argument("--nppa-special")
    p.add_argument("--rejects")
    scope = p.add_mutually_exclusive_group()
    scope.add_argument("--jap-only", action="store_true")
    scope.add_argument("--nppa-only", action="store_true")
    p.add_argument("--no-match", action="store_true")
    p.add_argument("--report", action="store_true")
    a = p.parse_args(argv)
    spark = session("pricebridge build")
    made = build(spark, a.out, None if a.nppa_only else a.source, None if a.jap_only else a.nppa_all, None if a.jap_only else a.nppa_special, a.rejects, not a.no_match)
    for row in made["meta"].orderBy("key").collect():
        print(f"{row['key']}={row['value']}")
    if a.report:
        for title, df in report(match(spark.read.parquet(f"{a.out}/jap_products"), spark.read.parquet(f"{a.out}/nppa_ceiling_prices"), now())).items():
            print(f"-- {title}")
            df.show(20, False)


if __name__ == "__main__":
    main()
