"""Serving queries over the built tables: search, cards, product lookup, statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricebridge.dims import CAVEATS, MOLECULE_ALIASES, PACK_BASIS, SAVINGS_BUCKETS
from pricebridge.functions.forms import lookup
from pricebridge.functions.similarity import partial_column
from pricebridge.functions.text import folded, slug
from pricebridge.store import settle

LEAST_QUERY, FUZZY_CUTOFF, TAX_LOW, TAX_HIGH = 2, 80.0, 1.05, 1.15


@dataclass
class Tables:
    """The built tables; read-only, as DataFrames are."""

    products: DataFrame
    ceilings: DataFrame
    canonical: DataFrame
    equivalents: DataFrame
    meta: DataFrame

    @staticmethod
    def load(spark: SparkSession, path: str) -> Tables:
        read = lambda t: spark.read.parquet(f"{path}/{t}")
        return Tables(read("jap_products"), read("nppa_ceiling_prices"), read("canonical_formulations"), read("equivalents"), read("meta"))


def table_counts(t: Tables) -> DataFrame:
    frames = {"jap_products": t.products, "nppa_ceiling_prices": t.ceilings, "canonical_formulations": t.canonical, "equivalents": t.equivalents}
    out = None
    for name, df in frames.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def data_as_on(t: Tables) -> DataFrame:
    """One row: when the comparisons were made, or else the match."""
    made = t.equivalents.agg(F.max("computed_at").alias("e")).crossJoin(F.broadcast(t.meta.filter("key = 'match_computed_at'").agg(F.max("value").alias("m"))))  # one row each
    return made.select(F.coalesce("e", "m").alias("data_as_on"))


def alias_of(query: str) -> str | None:
    """Another spelling of a folded query by the alias table and the salt rules; null if there is none."""
    from pricebridge.dims import GLUED_SALTS, SALT_ENDINGS
    from pricebridge.functions.molecules import GLUE

    name = " ".join(query.replace("(a)", " ").replace("(b)", " ").replace("(c)", " ").split())
    found = MOLECULE_ALIASES.get(name)
    if found is None and " " not in name:
        glued = next((f"{w} {name[len(w):]}" for w in GLUE if name.startswith(w) and name[len(w) :] in GLUED_SALTS), None)
        found = glued and MOLECULE_ALIASES.get(glued, glued)
    if found is None:
        words = name.split()
        bare = words[:]
        while len(bare) > 1 and len(words) - len(bare) < 3 and bare[-1] in SALT_ENDINGS:
            bare.pop()
        found = MOLECULE_ALIASES.get(" ".join(bare), " ".join(bare)) if bare != words else name
    found = (found or "").strip()
    return found if found and found != query else None


def equivalent_counts(t: Tables) -> DataFrame:
    return t.equivalents.groupBy("match_key").agg(F.count("*").alias("n_equivalents"))


def linked_keys(t: Tables, q: str) -> DataFrame:
    """Keys whose products' or ceilings' names contain q, by the ids that they hold."""
    contains = lambda c: F.lower(c).contains(q)
    j = t.canonical.select("match_key", F.explode("jap_product_ids").alias("product_id")).join(t.products.filter(contains("generic_name")).select("product_id"), "product_id", "left_semi")
    n = t.canonical.select("match_key", F.explode("nppa_ids").alias("id")).join(t.ceilings.filter(contains("formulation_raw")).select("id"), "id", "left_semi")
    return j.select("match_key").unionByName(n.select("match_key")).distinct()


def search(t: Tables, query: str, limit: int = 20) -> DataFrame:
    """Ranked keys: match_key, molecules, strength_set, form, form_family, has_equivalents, n_equivalents, tier, rank.

    Tiers: exact, prefix, substring (a name of a linked row counts), then fuzzy. Within the first three, keys with
    comparisons come first, then by key; within fuzzy by score before that. Queries of fewer than two characters are an
    error; one that folds to nothing finds nothing.
    """
    if len(query.strip()) < LEAST_QUERY:
        raise ValueError("query_too_short")
    q = folded(query).strip()
    scored = ranked(t, q).filter(F.lit(q != ""))
    order = ["tier_rank", F.desc(F.coalesce("score", F.lit(0.0))), F.desc("has_equivalents"), "match_key"]
    out = scored.orderBy(*order).limit(max(limit, 0))
    place = F.row_number().over(Window.orderBy(*order))  # at most limit rows
    return out.select("match_key", F.col("molecule_set").alias("molecules"), "strength_set", "form", "form_family", "has_equivalents", "n_equivalents", "tier", place.alias("rank"))


def ranked(t: Tables, q: str) -> DataFrame:
    """canonical with tier, tier_rank, score (fuzzy only) and comparisons, for a folded query; rows without a tier are left out."""
    alias = alias_of(q)
    whole = F.lower(F.coalesce("molecule_set", F.lit("")))
    tokens = F.filter(F.split(whole, r"\+"), lambda x: x != "")
    any_token = lambda test: F.exists(tokens, test)
    exact = (whole == q) | F.array_contains(tokens, q)
    part = any_token(lambda x: x.contains(q))
    if alias:
        exact = exact | (whole == alias) | F.array_contains(tokens, alias)
        part = part | any_token(lambda x: x.contains(alias))
    df = t.canonical.join(linked_keys(t, q).withColumn("linked", F.lit(True)), "match_key", "left").join(equivalent_counts(t), "match_key", "left")
    df = df.withColumns({"n_equivalents": F.coalesce("n_equivalents", F.lit(0)), "has_equivalents": F.coalesce("n_equivalents", F.lit(0)) > 0})
    # a linked row counts as soon as it shares its name with the query
    hit = F.when(exact, 0).when(any_token(lambda x: x.startswith(q)), 1).when(part | F.coalesce("linked", F.lit(False)), 2)
    df = df.withColumn("hit", hit)
    near = df.filter("hit IS NULL").withColumn("score", F.when(whole != "", partial_column(q, whole))).filter(F.col("score") >= FUZZY_CUTOFF).withColumn("hit", F.lit(3))
    rows = df.filter("hit IS NOT NULL").withColumn("score", F.lit(None).cast("double")).unionByName(near)
    return rows.withColumn("tier", F.element_at(F.array(*map(F.lit, ("exact", "prefix", "substring", "fuzzy"))), F.col("hit") + 1)).withColumnRenamed("hit", "tier_rank")


def caveats(method: Column, confidence: Column, pct: Column, per_unit: Column, ceiling: Column) -> Column:
    """The codes of what a comparison should be read with."""
    ratio = per_unit / F.nullif(ceiling, F.lit(0.0))
    above = F.coalesce(pct < 0, F.lit(False))
    say = lambda test, code: F.when(F.coalesce(test, F.lit(False)), F.lit(code))
    return F.array_compact(
        F.array(
            say(method.isin("modifier_relaxed", "form_family"), "form_or_modifier_relaxed: verify dosage form"), say(confidence == "low", "low_match_confidence"),
            say(above, "jap_price_above_ceiling"), say(above & (per_unit != 0) & ratio.between(TAX_LOW, TAX_HIGH), "possible_tax_basis_difference"),
        )
    )


def caveat_text(code: Column) -> Column:
    return F.coalesce(lookup(CAVEATS, F.split_part(code, F.lit(":"), F.lit(1))), code)


def cards(t: Tables) -> DataFrame:
    """One card per key with comparisons, for the one that saves most: both sides with their provenance, and caveats.
    A key whose references lead nowhere has none."""
    best = t.equivalents.withColumn("p", F.row_number().over(Window.partitionBy("match_key").orderBy(F.desc("savings_pct"), "id"))).filter("p = 1")
    c = t.canonical.select("match_key", "molecule_set", "strength_set", "form", "form_family", "modifiers")
    n = t.ceilings.select(F.col("id").alias("nppa_row_id"), "so_number", "so_date", "formulation_raw", "strength_raw", "qualifier_raw", "source_file", "source_row")
    j = t.products.select(F.col("product_id").alias("jap_product_id"), "generic_name", "unit_size", "mrp", "drug_code", "group_name")
    rows = best.join(c, "match_key").join(n, "nppa_row_id").join(j, "jap_product_id")
    nppa = F.struct(
        F.col("nppa_ceiling_per_unit").alias("ceiling_per_unit_inr"), F.col("nppa_unit_basis").alias("unit_basis"), F.col("nppa_variant_basis").alias("variant_basis"), F.col("nppa_nlem_version").alias("nlem_version"),
        "so_number", "so_date", "formulation_raw", "strength_raw", "qualifier_raw", "source_file", "source_row",
    )
    jap = F.struct(F.col("jap_product_id").alias("product_id"), "generic_name", F.col("unit_size").alias("pack_raw"), F.col("jap_pack_parsed").alias("pack_parsed"), "mrp", F.col("jap_per_unit").alias("per_unit_inr"), "drug_code", "group_name")
    codes = caveats(*(F.col(x) for x in ("match_method", "confidence", "savings_pct", "jap_per_unit", "nppa_ceiling_per_unit")))
    return rows.select("match_key", F.col("molecule_set").alias("molecules"), "strength_set", "form", "form_family", "modifiers", nppa.alias("nppa_side"), jap.alias("jap_side"), "savings_pct", "match_method", "confidence", codes.alias("caveats"))


def card(t: Tables, match_key: str) -> DataFrame:
    return cards(Tables(t.products, t.ceilings, t.canonical.filter(F.col("match_key") == match_key), t.equivalents.filter(F.col("match_key") == match_key), t.meta))


def product_pages(t: Tables) -> DataFrame:
    """One row per product: its key (one with comparisons before others, then as first seen), its comparisons, best
    savings first, and why it is in none if its price is not published."""
    keys = t.canonical.select("match_key", "ord", F.explode("jap_product_ids").alias("product_id")).join(equivalent_counts(t), "match_key", "left")
    chosen = keys.groupBy("product_id").agg(F.min_by("match_key", F.struct(F.col("n_equivalents").isNull(), F.col("ord"))).alias("match_key"))
    fields = ["match_key", "nppa_ceiling_per_unit", "jap_per_unit", "savings_pct", "match_method", "confidence"]
    sortable = F.struct((-F.col("savings_pct")).alias("s"), "id", F.struct(*fields).alias("e"))
    own = t.equivalents.groupBy(F.col("jap_product_id").alias("product_id")).agg(F.transform(F.array_sort(F.collect_list(sortable)), lambda x: x["e"]).alias("equivalents"))
    rows = t.products.join(chosen, "product_id", "left").join(own, "product_id", "left")
    reason = F.when(F.coalesce("mrp", F.lit(0.0)) == 0, F.lit("price_not_published"))
    return rows.select("product_id", "drug_code", "generic_name", "group_name", F.col("unit_size").alias("pack_raw"), "mrp", "status", "match_key", "equivalents", reason.alias("excluded_reason"))


def product_page(t: Tables, product_id: int) -> DataFrame:
    return product_pages(Tables(t.products.filter(F.col("product_id") == product_id), t.ceilings, t.canonical, t.equivalents, t.meta))


def method_distribution(t: Tables) -> DataFrame:
    return t.equivalents.groupBy("match_method").agg(F.count("*").alias("n"))


def compared_keys(t: Tables) -> DataFrame:
    """One row: how many keys have a comparison."""
    return t.equivalents.agg(F.count_distinct("match_key").alias("compared_keys"))


def savings_stats(t: Tables) -> DataFrame:
    s = F.col("savings_pct")
    return t.equivalents.agg(F.count("*").alias("equivalents_count"), F.median(s).alias("median"), F.min(s).alias("min"), F.max(s).alias("max"), F.count_if(s < 0).alias("negative_count"))


def ladder_counts(t: Tables) -> DataFrame:
    """One row: keys by stage, matched keys, all keys and the coverage."""
    names = {"stage_1_exact": "match_stage_1_count", "stage_2_alias": "match_stage_2_count", "stage_3_fuzzy": "match_stage_3_count", "form_family": "form_family_count", "matched_keys": "matched_nppa_keys", "total_nppa_keys": "nppa_formulation_keys"}
    row = t.meta.agg(*(F.coalesce(F.max(F.when(F.col("key") == k, F.col("value"))), F.lit("0")).cast("long").alias(n) for n, k in names.items()))
    return row.withColumn("coverage_pct", share("matched_keys", "total_nppa_keys"))


def share(part: str, whole: str) -> Column:
    """A percentage with one decimal; 0 of nothing."""
    return F.when(F.col(whole) != 0, F.call_function("format_number", F.lit(100.0) * F.col(part) / F.nullif(F.col(whole), F.lit(0)), F.lit("0.0")).cast("double")).otherwise(0.0)


def stats(t: Tables) -> DataFrame:
    """One row: the ladder, the comparisons and their freshness. cache() it to serve it often."""
    methods = method_distribution(t).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("match_method", "n")))).alias("method_distribution"))
    out = ladder_counts(t).select(F.struct("*").alias("match_ladder"))
    for one in (savings_stats(t), methods, data_as_on(t)):  # one row each
        out = out.crossJoin(F.broadcast(one))
    return out


def savings_histogram(t: Tables) -> DataFrame:
    """ord, key, label, n, pct of every bucket, empty ones too."""
    s = F.col("savings_pct")
    bucket = F.when(s <= 0, "le0").when(s <= 30, "0-30").when(s <= 60, "30-60").when(s <= 80, "60-80").otherwise("gt80")
    counts = t.equivalents.groupBy(bucket.alias("key")).agg(F.count("*").alias("c"))
    dim = t.equivalents.sparkSession.createDataFrame([(i, k, label) for i, (k, label) in enumerate(SAVINGS_BUCKETS)], "ord int, key string, label string")
    rows = dim.join(counts, "key", "left").withColumn("n", F.coalesce("c", F.lit(0))).withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(0))))  # five rows
    return rows.select("ord", "key", "label", "n", share("n", "total").alias("pct"))


def ladder_bars(t: Tables) -> DataFrame:
    """ord, label, value, pct: stages added up; the last bar is the matched keys as such."""
    c = ladder_counts(t)
    bars = "stack(5, 0, 'Naive baseline', 0L, 1, 'Exact', stage_1_exact, 2, '+ Alias', stage_1_exact + stage_2_alias, 3, '+ Fuzzy', stage_1_exact + stage_2_alias + stage_3_fuzzy, 4, '+ Form family', matched_keys) as (ord, label, value)"
    return c.select("total_nppa_keys", F.expr(bars)).select("ord", "label", "value", share("value", "total_nppa_keys").alias("pct"))


def slug_map(keys: DataFrame, most_rounds: int = 20) -> DataFrame:
    """match_key, slug, collided: keys in order take their slug, or the next free of slug-2, slug-3, ...

    Numbers go within a slug. A number that gives another, earlier key's own slug is skipped; if that key comes later,
    it is the later one that is numbered. The latter may touch further slugs, so it is looked for until there is no more.
    """
    based = keys.select("match_key", slug(F.col("match_key")).alias("base"))
    own = based.groupBy(F.col("base").alias("own")).agg(F.min("match_key").alias("claimed"))
    numbered = own.withColumns({"stem": F.regexp_extract("own", r"^(.+)-([1-9]\d*)$", 1), "k": F.regexp_extract("own", r"^(.+)-([1-9]\d*)$", 2)}).filter("stem <> ''")
    taken = numbered.groupBy(F.col("stem").alias("base")).agg(F.collect_list(F.struct(F.col("k").cast("long").alias("k"), "claimed")).alias("taken"))
    rows = based.withColumn("n", F.row_number().over(Window.partitionBy("base").orderBy("match_key"))).join(taken, "base", "left")
    rows = settle(rows, "slugs")
    lost = rows.limit(0).select("base", F.lit(1).alias("late"))  # slugs that an earlier key's number has taken
    for _ in range(most_rounds):
        at = (F.col("n") + F.coalesce("late", F.lit(0))).cast("long")
        before = F.array_sort(F.transform(F.filter(F.coalesce("taken", F.array().cast("array<struct<k:bigint,claimed:string>>")), lambda x: (x["claimed"] < F.col("match_key")) & (x["k"] >= 2)), lambda x: x["k"]))
        number = F.aggregate(before, F.col("at"), lambda i, k: F.when((k <= i) & (F.col("at") > 1), i + 1).otherwise(i))
        named = rows.join(lost, "base", "left").withColumn("at", at).withColumn("number", number)
        named = named.select("match_key", "base", F.when(F.col("at") == 1, F.col("base")).otherwise(F.concat("base", F.lit("-"), F.col("number").cast("string"))).alias("slug"), (F.col("at") > 1).alias("collided"))
        clash = named.filter("collided").join(own, F.col("slug") == F.col("own")).filter("claimed > match_key").select(F.col("own").alias("base"), F.lit(1).alias("late")).distinct()
        clash = settle(clash, "slugs")
        if clash.join(lost, "base", "left_anti").isEmpty():
            return named.select("match_key", "slug", "collided")
        lost = clash.unionByName(lost).distinct()
    raise RuntimeError(f"slugs still collide after {most_rounds} rounds")


def basis_faults(t: Tables) -> DataFrame:
    """Comparisons whose pack kind and price basis don't belong together; there should be none."""
    return t.equivalents.filter(~F.coalesce(lookup(PACK_BASIS, F.split_part("jap_pack_parsed", F.lit(":"), F.lit(1))) == F.col("nppa_unit_basis"), F.lit(False)))
