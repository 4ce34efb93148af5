"""Queries over the driver's tables, each with the SQL that computes the same from the numeric columns.

No price lists ship with the driver, so a catalogue and ceilings are derived from `part`: as messy text for the engine,
and as plain numbers for the SQL. Both derivations are the same statements in both dialects.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricebridge.functions import forms, molecules, packs, qualifiers, similarity, strength, text
from pricebridge.functions.keys import key
from pricebridge.operators import align, canonical, ladder, overlay
from pricebridge.plans import serve
from pricebridge.plans.build import match
from pricebridge.sources import ceilings as ceiling_files
from pricebridge.sources import products as product_files
from pricebridge.store import settle

STAMP = "2025-01-01T00:00:00+00:00"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet")


def _text_of(spark: SparkSession, sf_dir: str, expr: str) -> DataFrame:
    """id and one derived text of every part."""
    return _part(spark, sf_dir).selectExpr("p_partkey AS id", f"{expr} AS raw")


_N = "cast(p_size as string)"

# ---------------------------------------------------------------- derived tables

CATALOGUE = """
SELECT p_partkey AS product_id, p_partkey AS drug_code, p_type AS group_name, 1 AS status,
  CASE p_partkey % 4
    WHEN 0 THEN concat(upper(substr(p_name, 1, 1)), substr(p_name, 2), CASE WHEN p_partkey % 8 = 0 THEN ' hydrochloride' ELSE '' END, ' Tablets IP ', cast(p_size AS string), ' mg')
    WHEN 1 THEN concat(upper(p_name), ' Capsules ', cast(p_size AS string), 'mg')
    WHEN 2 THEN concat(p_name, ' Tablets ', cast(p_size * 1000 AS string), ' mcg')
    ELSE concat(p_name, ' Syrup ', cast(p_size * 5 AS string), ' mg per 5 ml') END AS generic_name,
  CASE p_partkey % 5 WHEN 0 THEN '10''s' WHEN 1 THEN '30 ml' WHEN 2 THEN '15 g tubes' WHEN 3 THEN '200 MDI' ELSE 'Vial' END AS unit_size,
  CASE WHEN p_partkey % 7 = 0 THEN cast(0 AS double) ELSE p_retailprice END AS mrp
FROM {part}"""

CEILINGS = """
WITH g AS (SELECT p_name, p_size, max(p_retailprice) AS top, row_number() OVER (ORDER BY p_name, p_size) AS rn FROM {part} GROUP BY p_name, p_size),
v AS (SELECT *, 0 AS variant FROM g UNION ALL SELECT *, 1 AS variant FROM g WHERE p_size % 3 = 2 AND p_size % 2 = 0)
SELECT rn * 2 - 1 + variant AS id, concat(upper(p_name), CASE WHEN p_size % 7 = 3 THEN 'X' ELSE '' END) AS formulation_raw,
  CASE p_size % 3 WHEN 0 THEN 'TABLET' WHEN 1 THEN 'CAPSULE' ELSE CASE WHEN p_size % 5 = 0 THEN 'SUSPENSION' ELSE 'SYRUP' END END AS form_raw,
  concat(cast(p_size AS string), CASE WHEN p_size % 3 = 2 THEN ' MG/ML' ELSE ' MG' END) AS strength_raw,
  CASE WHEN variant = 1 THEN 'pack' ELSE CASE p_size % 3 WHEN 0 THEN 'tablet' WHEN 1 THEN 'capsule' ELSE 'ml' END END AS unit_type,
  cast(1 AS double) AS unit_count, CASE WHEN variant = 1 THEN cast(30 AS double) END AS pack_volume_ml,
  CASE WHEN variant = 1 THEN top * 2 ELSE top / 10 END AS price_value, cast(NULL AS string) AS pack_condition_raw,
  CASE WHEN p_size % 2 = 0 THEN '2022' ELSE '2015' END AS nlem_version,
  'SO-1' AS so_number, '01-Jan-2025' AS so_date, 'q' AS qualifier_raw, 'derived' AS source_file, 'row' AS source_row
FROM v"""

# the same in numbers: cat and ceil, and the ladder over them
_NUMBERS = """
cat AS (SELECT p_partkey AS product_id, p_name AS name, p_size AS size, CASE p_partkey % 4 WHEN 1 THEN 'capsule' WHEN 3 THEN 'syrup' ELSE 'tablet' END AS form,
        p_partkey % 8 = 0 AS salt, p_partkey % 5 AS pk, CASE WHEN p_partkey % 7 = 0 THEN 0.0 ELSE p_retailprice END AS mrp FROM part),
g AS (SELECT p_name, p_size, max(p_retailprice) AS top, row_number() OVER (ORDER BY p_name, p_size) AS rn FROM part GROUP BY p_name, p_size),
v AS (SELECT *, 0 AS variant FROM g UNION ALL SELECT *, 1 AS variant FROM g WHERE p_size % 3 = 2 AND p_size % 2 = 0),
ceil AS (SELECT rn * 2 - 1 + variant AS id, p_name AS name, p_size AS size, p_size % 7 = 3 AS odd, variant,
         CASE p_size % 3 WHEN 0 THEN 'tablet' WHEN 1 THEN 'capsule' ELSE CASE WHEN p_size % 5 = 0 THEN 'suspension' ELSE 'syrup' END END AS form,
         CASE WHEN p_size % 3 = 2 THEN 'ml' ELSE 'count' END AS basis, CASE WHEN variant = 1 THEN top * 2 / 30 ELSE top / 10 END AS per_unit,
         CASE WHEN p_size % 2 = 0 THEN '2022' ELSE '2015' END AS nlem,
         concat(p_name, CASE WHEN p_size % 7 = 3 THEN 'x' ELSE '' END, ':', p_size, CASE WHEN p_size % 3 = 2 THEN 'mg/ml' ELSE 'mg' END, '|',
                CASE p_size % 3 WHEN 0 THEN 'tablet' WHEN 1 THEN 'capsule' ELSE CASE WHEN p_size % 5 = 0 THEN 'suspension' ELSE 'syrup' END END) AS key FROM v),
s1 AS (SELECT key, id, product_id, 1 AS stage FROM ceil JOIN cat USING (name, size, form) WHERE NOT odd AND NOT salt),
n1 AS (SELECT * FROM ceil WHERE id NOT IN (SELECT id FROM s1)), j1 AS (SELECT * FROM cat WHERE product_id NOT IN (SELECT product_id FROM s1)),
s2 AS (SELECT key, id, product_id, 2 AS stage FROM n1 JOIN j1 USING (name, size, form) WHERE NOT odd),
n2 AS (SELECT * FROM n1 WHERE id NOT IN (SELECT id FROM s2)), j2 AS (SELECT * FROM j1 WHERE product_id NOT IN (SELECT product_id FROM s2)),
s3 AS (SELECT key, id, min(product_id) AS product_id, 3 AS stage FROM n2 JOIN j2 USING (name, size, form) WHERE odd GROUP BY key, id),
n3 AS (SELECT * FROM n2 WHERE id NOT IN (SELECT id FROM s3)), j3 AS (SELECT * FROM j2 WHERE product_id NOT IN (SELECT product_id FROM s3)),
s4 AS (SELECT key, id, product_id, 4 AS stage FROM n3 JOIN j3 USING (name, size) WHERE NOT odd AND n3.form = 'suspension' AND j3.form = 'syrup'),
pairs AS (SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3 UNION ALL SELECT * FROM s4),
m AS (SELECT key, max(stage) AS stage FROM pairs GROUP BY key),
mk AS (SELECT key, CASE stage WHEN 1 THEN 'exact' WHEN 2 THEN 'alias' WHEN 3 THEN 'fuzzy' ELSE 'form_family' END AS method, CASE WHEN stage <= 2 THEN 'high' WHEN stage = 3 THEN 'medium' ELSE 'low' END AS confidence FROM m),
kp AS (SELECT DISTINCT key, product_id FROM pairs), kn AS (SELECT DISTINCT key, id FROM pairs),
cand AS (SELECT kp.key, kp.product_id, cat.mrp, cat.pk, ceil.id, ceil.per_unit, ceil.basis, ceil.nlem, ceil.variant FROM kp JOIN cat USING (product_id) JOIN kn USING (key) JOIN ceil USING (id)
         WHERE cat.mrp <> 0 AND ((cat.pk = 0 AND ceil.basis = 'count') OR (cat.pk = 1 AND ceil.basis = 'ml'))),
eq AS (SELECT *, row_number() OVER (PARTITION BY key, product_id ORDER BY CASE WHEN pk = 1 AND variant = 1 THEN 0 ELSE 1 END, id) AS place FROM cand),
equiv AS (SELECT eq.key AS match_key, id AS nppa_row_id, product_id AS jap_product_id, per_unit AS nppa_ceiling_per_unit, basis AS nppa_unit_basis,
          CASE WHEN pk = 1 AND variant = 1 THEN 'exact_volume' ELSE 'same_unit_type' END AS nppa_variant_basis, nlem AS nppa_nlem_version,
          mrp / CASE pk WHEN 0 THEN 10 ELSE 30 END AS jap_per_unit, CASE pk WHEN 0 THEN 'count:10' ELSE 'volume_ml:30' END AS jap_pack_parsed,
          (1.0 - mrp / CASE pk WHEN 0 THEN 10 ELSE 30 END / per_unit) * 100.0 AS savings_pct, method AS match_method, confidence FROM eq JOIN mk USING (key) WHERE place = 1),
canon AS (SELECT DISTINCT key AS match_key, name || CASE WHEN odd THEN 'x' ELSE '' END AS molecule_set, size, form FROM ceil
          UNION SELECT concat(name, ':', size, CASE WHEN form = 'syrup' THEN 'mg/ml' ELSE 'mg' END, '|', form), name, size, form FROM cat WHERE product_id NOT IN (SELECT product_id FROM pairs))
"""


def _with(sql: str) -> str:
    return f"WITH {_NUMBERS} {sql}"


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(CATALOGUE, part=_part(spark, sf_dir))


def ceilings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(CEILINGS, part=_part(spark, sf_dir))


#: What one session has built from one input: the serving queries ask the same tables.
_BUILT: dict[tuple[str, str], tuple] = {}


def _build(spark: SparkSession, sf_dir: str):
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _BUILT:
        jap, nppa = settle(catalogue(spark, sf_dir), "catalogue"), settle(ceilings(spark, sf_dir), "ceilings")
        m = match(jap, nppa, STAMP)
        _BUILT[key] = m, serve.Tables(jap, nppa, settle(m.canonical, "canonical"), settle(m.equivalents, "equivalents"), settle(m.meta, "meta"))
    return _BUILT[key]


def _match(spark: SparkSession, sf_dir: str):
    return _build(spark, sf_dir)[0]


def _tables(spark: SparkSession, sf_dir: str) -> serve.Tables:
    return _build(spark, sf_dir)[1]


# ---------------------------------------------------------------- text and grammars


@_query("SELECT p_partkey AS id, concat(p_name, ' Tablets ', p_size, ' mg') AS clean FROM part")
def clean_text_marks(spark, sf_dir):
    """T1"""
    raw = f"concat('  ', p_name, ' ', CASE p_partkey % 3 WHEN 0 THEN ' Tablets IP ' WHEN 1 THEN ' Tablets I.P. ' ELSE ' BP Tablets  usp ' END, {_N}, ' mg ')"
    return _text_of(spark, sf_dir, raw).select("id", text.clean_text(F.col("raw")).alias("clean"))


@_query("SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN concat(p_size, 'mg') WHEN 1 THEN concat(p_size * 1000, 'mg') WHEN 2 THEN concat(p_size, 'mg') WHEN 3 THEN concat(p_size * 100000, 'iu') ELSE concat(p_size, 'ku') END AS canonical FROM part")
def strength_plain(spark, sf_dir):
    """G1 G5 T4 T5"""
    raw = f"CASE p_partkey % 5 WHEN 0 THEN concat({_N}, ' mg') WHEN 1 THEN concat({_N}, ' g') WHEN 2 THEN concat(cast(p_size * 1000 as string), ' MCG') WHEN 3 THEN concat({_N}, ',00,000 IU') ELSE concat({_N}, ' KU') END"
    return _text_of(spark, sf_dir, raw).select("id", strength.strength("raw")["canonical"].alias("canonical"))


@_query("SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN concat(p_size, 'mg/ml') WHEN 1 THEN concat(p_size, 'iu/ml') ELSE concat(printf('%.6g', p_size * 1000.0 / 16.7), 'mg/ml') END AS canonical FROM part")
def strength_concentration(spark, sf_dir):
    """G5"""
    raw = f"CASE p_partkey % 3 WHEN 0 THEN concat(cast(p_size * 5 as string), ' mg per 5 ml') WHEN 1 THEN concat({_N}, ' IU/ ML') ELSE concat({_N}, ' GM/16.7 ML') END"
    return _text_of(spark, sf_dir, raw).select("id", strength.strength("raw")["canonical"].alias("canonical"))


@_query("SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN concat(p_size, 'mg+', p_size + 60, 'mg') WHEN 1 THEN concat(p_size, 'mg+', p_size + 1, 'iu') ELSE concat(p_size, 'mg+', p_size + 60, 'mg') END AS canonical FROM part")
def strength_combinations(spark, sf_dir):
    """G3 G4 G6 G7"""
    more = "cast(p_size + 60 as string)"
    raw = f"CASE p_partkey % 3 WHEN 0 THEN concat({more}, '/', {_N}, ' MG') WHEN 1 THEN concat(cast(p_size + 1 as string), ' IU (A) + ', {_N}, ' mg (B)') ELSE concat({more}, ' (A) + ', {_N}, ' mg (B)') END"
    return _text_of(spark, sf_dir, raw).select("id", strength.strength("raw")["canonical"].alias("canonical"))


@_query("SELECT p_partkey AS id, concat(p_size, CASE p_partkey % 3 WHEN 0 THEN '%wv' WHEN 1 THEN '%ww' ELSE '%vv' END) AS canonical, CASE WHEN p_partkey % 3 = 0 THEN concat(p_size * 10, 'mg/ml') END AS twin FROM part")
def strength_percent_twin(spark, sf_dir):
    """G5 G8"""
    rows = _text_of(spark, sf_dir, f"concat({_N}, CASE p_partkey % 3 WHEN 0 THEN ' %' WHEN 1 THEN '% w/w' ELSE '% V / V' END)").select("id", strength.strength("raw")["canonical"].alias("canonical"))
    return rows.select("*", strength.percent_twin(F.col("canonical")).alias("twin"))


@_query("SELECT CASE p_partkey % 7 WHEN 0 THEN 'absent_strength' WHEN 1 THEN 'ratio_strength' WHEN 2 THEN 'range_strength' WHEN 3 THEN 'volume_not_strength' WHEN 4 THEN 'missing_unit' WHEN 5 THEN 'degenerate_composition' ELSE 'unparseable_strength' END AS reason, count(*) AS n FROM part GROUP BY 1")
def strength_reasons(spark, sf_dir):
    """G5 G6 A3"""
    raw = f"CASE p_partkey % 7 WHEN 0 THEN '--' WHEN 1 THEN concat('1:', {_N}) WHEN 2 THEN concat({_N}, '-60%') WHEN 3 THEN concat({_N}, ' ml') WHEN 4 THEN {_N} WHEN 5 THEN concat({_N}, ' Lf Toxoid') ELSE concat('about ', {_N}, ' spoons') END"
    return _text_of(spark, sf_dir, raw).select(strength.strength("raw")["reason"].alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


_FORM_CASES = {"INHALER": ("inhaler", "inhalation"), "Oral Suspension": ("suspension", "liquid"), "Effervescent/ Dispersible/ Enteric coated Tablet": ("tablet", "tablet"), "EYE DROPS": ("eye_drops", "eye_drops"), "Strong Nasal Spray (new)": ("nasal_spray", "inhalation"), "POWDER FOR INJECTION": ("injection", "injectable"), "Mystery": ("mystery", "mystery")}


def _cases(values: list[str]) -> str:
    return f"CASE p_partkey % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


@_query(f"SELECT p_partkey AS id, {_cases([b for b, _ in _FORM_CASES.values()])} AS form, {_cases([f for _, f in _FORM_CASES.values()])} AS family FROM part")
def form_and_family(spark, sf_dir):
    """F1 F2"""
    rows = _text_of(spark, sf_dir, _cases(list(_FORM_CASES))).select("id", text.fold_text("raw").alias("folded")).select("id", forms.canonical_form(F.col("folded")).alias("form"))
    return rows.select("*", forms.form_family(F.col("form")).alias("family"))


_MODIFIER_CASES = {"Sustained Release Tablets": "sustained_release", "ENTERIC-COATED dispersible Tablet": "dispersible,enteric_coated", "Plain": "", "Metoprolol (CR)": "controlled_release"}


@_query(f"SELECT p_partkey AS id, {_cases(list(_MODIFIER_CASES.values()))} AS modifiers FROM part")
def modifiers_found(spark, sf_dir):
    """F3"""
    return _text_of(spark, sf_dir, _cases(list(_MODIFIER_CASES))).select("id", F.array_join(forms.modifiers(F.col("raw")), ",").alias("modifiers"))


@_query("""SELECT p_partkey AS id, CASE p_partkey % 9 WHEN 0 THEN 'count' WHEN 1 THEN 'volume_ml' WHEN 2 THEN 'weight_g' WHEN 3 THEN 'dose_count' WHEN 4 THEN 'vial' WHEN 5 THEN 'count' WHEN 6 THEN 'weight_g' WHEN 7 THEN 'count' END AS kind,
  CAST(CASE p_partkey % 9 WHEN 0 THEN p_size WHEN 1 THEN p_size + 0.5 WHEN 2 THEN p_size WHEN 3 THEN p_size WHEN 4 THEN 1 WHEN 5 THEN p_size * 3 WHEN 6 THEN p_size * 1000 WHEN 7 THEN 3 END AS DOUBLE) AS value FROM part""")
def pack_sizes(spark, sf_dir):
    """F4"""
    raw = f"CASE p_partkey % 9 WHEN 0 THEN concat({_N}, '’s in Mono Carton') WHEN 1 THEN concat({_N}, '.5 ml Bottle') WHEN 2 THEN concat({_N}, ' g tubes') WHEN 3 THEN concat({_N}, ' MDI') WHEN 4 THEN 'Vial & Wfi' WHEN 5 THEN concat('3 x ', {_N}, ' ''s') WHEN 6 THEN concat({_N}, 'kg jar') WHEN 7 THEN 'Three in Mono-Pack' ELSE 'KIT' END"
    rows = _text_of(spark, sf_dir, raw).select("id", packs.parse_pack(F.col("raw")).alias("p"))
    return rows.select("id", "p.kind", "p.value")


@_query("""SELECT p_partkey AS id, CAST(p_size + 0.25 AS DOUBLE) AS price,
  CASE p_partkey % 8 WHEN 0 THEN 'tablet' WHEN 1 THEN 'pack' WHEN 2 THEN 'ml' WHEN 3 THEN 'dose' WHEN 4 THEN 'pack' WHEN 5 THEN 'ml' WHEN 6 THEN 'pessary' END AS unit_type,
  CAST(CASE p_partkey % 8 WHEN 0 THEN p_size WHEN 2 THEN 1 WHEN 4 THEN 1 WHEN 5 THEN p_size WHEN 6 THEN 1 END AS DOUBLE) AS unit_count,
  CAST(CASE p_partkey % 8 WHEN 1 THEN p_size WHEN 4 THEN p_size WHEN 5 THEN 5 END AS DOUBLE) AS pack_volume_ml,
  CASE WHEN p_partkey % 8 = 1 THEN 'non_glass' END AS container, CASE WHEN p_partkey % 8 = 2 THEN 'more_10' END AS condition FROM part""")
def price_qualifiers(spark, sf_dir):
    """F5 F6 F7 F8 F9 F11"""
    q = f"CASE p_partkey % 8 WHEN 0 THEN concat('(', {_N}, ' Tablets)') WHEN 1 THEN concat('(', {_N}, 'ml Non-Glass)') WHEN 2 THEN '(1 ML (10 ML & more pack))' WHEN 3 THEN '(Per  Dose)' WHEN 4 THEN concat('(Each Pack (', {_N}, ' ml))') WHEN 5 THEN concat('(5 ML Pack)(', {_N}, ' ML Pack)') WHEN 6 THEN '(Each Pessary)(Pack)' ELSE '(by the dozen)' END"
    rows = _text_of(spark, sf_dir, f"concat(' ₹ ', {_N}, '.25', {q})").select("id", qualifiers.price_and_qualifier(F.col("raw")).alias("p"))
    rows = rows.select("id", "p.price", qualifiers.parse_qualifier(F.col("p.qualifier")).alias("q"))
    return rows.select("id", "price", "q.unit_type", "q.unit_count", "q.pack_volume_ml", "q.container", forms.pack_condition(F.col("q.pack_condition_raw")).alias("condition"))


@_query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 3 THEN NULL ELSE CASE p_partkey % 4 WHEN 0 THEN 'Injection' WHEN 1 THEN 'CONDOM' ELSE 'Nasal Spray' END END AS form,
  CASE p_partkey % 4 WHEN 0 THEN concat(p_size, ' mg/ml (1ml)') WHEN 3 THEN concat(p_size, ' MG') END AS strength, CASE p_partkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 3 END AS list_rank FROM part""")
def dosage_split_and_rank(spark, sf_dir):
    """F10 F12"""
    rows = _part(spark, sf_dir).selectExpr("p_partkey AS id", f"CASE p_partkey % 4 WHEN 0 THEN concat('Injection  ', {_N}, ' mg/ml (1ml)') WHEN 1 THEN 'CONDOM' WHEN 2 THEN 'Nasal Spray --' ELSE concat({_N}, ' MG') END AS raw", "CASE p_partkey % 3 WHEN 0 THEN ' 2022' WHEN 1 THEN '2011' END AS v")
    return rows.select("id", forms.form_strength(F.col("raw")).alias("fs"), forms.list_rank(F.col("v")).alias("list_rank")).select("id", "fs.form", "fs.strength", "list_rank")


_ALIAS_CASES = {"frusemide": "furosemide", "amlodipine besilate": "amlodipine", "formoterol fumarate dihydrate": "formoterol", "medroxyprogesteroneacetate": "medroxyprogesterone acetate", "calcium phosphate": "calcium phosphate", "s(-) amlodipine": "amlodipine", "gentamicin sulphate (A)": "gentamicin", "losartan potassium": "losartan"}


@_query(f"SELECT p_partkey AS id, {_cases(list(_ALIAS_CASES.values()))} AS molecule FROM part")
def molecule_aliases(spark, sf_dir):
    """C1 C2 C3 C4 C5"""
    rows = _text_of(spark, sf_dir, _cases(list(_ALIAS_CASES))).select("id", molecules.tidy_molecule(text.fold_text("raw")).alias("name"))
    return rows.select("id", molecules.resolve_alias(F.col("name")).alias("molecule"))


_SPLIT_CASES = {"Glucose (A) + Sodium Chloride (B)": "Glucose/Sodium Chloride", "CO-X (ALPHA(A)+BETA(B)]": "ALPHA/BETA", "Arte (A) + Sulpha -Pyri (B)": "Arte/Sulpha/Pyri", "ASCORBIC ACID (VITAMIN C)": "ASCORBIC ACID", "PHYTO (K1)10 MG": "PHYTO", "A plain + B - LIPO": "A/B/LIPO"}


@_query(f"SELECT p_partkey AS id, {_cases(list(_SPLIT_CASES.values()))} AS molecules FROM part")
def formulation_split(spark, sf_dir):
    """C6"""
    rows = _text_of(spark, sf_dir, _cases(list(_SPLIT_CASES))).select("id", text.clean_text(F.col("raw")).alias("clean"))
    n = F.when(F.col("clean").rlike("Sulpha|LIPO"), F.lit(3))
    return rows.select("id", F.array_join(molecules.split_formulation(F.col("clean"), n), "/").alias("molecules"))


@_query("SELECT p_partkey AS id, concat(least(p_name, 'kappa'), ':', CASE WHEN p_name < 'kappa' THEN concat(p_size, 'mg') ELSE '' END, '+', greatest(p_name, 'kappa'), ':', CASE WHEN p_name < 'kappa' THEN '' ELSE concat(p_size, 'mg') END, '|tablet') AS match_key FROM part")
def canonical_keys(spark, sf_dir):
    """C11"""
    rows = _part(spark, sf_dir).select(F.col("p_partkey").alias("id"), F.array("p_name", F.lit("kappa")).alias("m"), F.array(F.concat(F.col("p_size").cast("string"), F.lit("mg")), F.lit(None)).alias("s"))
    return rows.select("id", key(F.col("m"), F.col("s"), F.lit("tablet")).alias("match_key"))


@_query(_with("""SELECT product_id, CASE WHEN salt THEN concat(name, ' hydrochloride') ELSE name END AS molecule_plain, name AS molecule, concat(size, CASE WHEN form = 'syrup' THEN 'mg/ml' ELSE 'mg' END) AS strength, form,
  concat(name, ':', size, CASE WHEN form = 'syrup' THEN 'mg/ml' ELSE 'mg' END, '|', form) AS key_alias FROM cat"""))
def products_canonical(spark, sf_dir):
    """C8 C9 C10 C12"""
    p = canonical.canonical_products(catalogue(spark, sf_dir))
    return p.select("product_id", F.get("molecules_plain", F.lit(0)).alias("molecule_plain"), F.get("molecules_alias", F.lit(0)).alias("molecule"), F.get("strengths", F.lit(0)).alias("strength"), "form", "key_alias")


_COMBO = "concat('Combipack of ', p_name, CASE p_partkey % 2 WHEN 0 THEN ' 20mg (Enteric Coated) and ' ELSE ' 20mg & ' END, 'kappa ', cast(p_size as string), 'mg (Sustained Release) Capsules (10''s)')"


@_query("SELECT p_partkey AS id, concat(p_name, '/kappa') AS molecules, concat('20mg/', p_size, 'mg') AS strengths, 'Capsules' AS form, CASE p_partkey % 2 WHEN 0 THEN 'enteric_coated,sustained_release' ELSE 'sustained_release' END AS modifiers, true AS ok FROM part")
def composition_of_combinations(spark, sf_dir):
    """C8 C9 C10 U2"""
    from pricebridge.functions.composition import composition

    rows = _text_of(spark, sf_dir, _COMBO).select("id", composition("raw").alias("c"))
    return rows.select("id", F.array_join("c.molecules", "/").alias("molecules"), F.array_join("c.strengths", "/").alias("strengths"), "c.form", F.array_join("c.modifiers", ",").alias("modifiers"), "c.ok")


@_query("""SELECT row_number() OVER (ORDER BY p_name, p_size) AS row_id, concat(p_name, ':', p_size, CASE p_size % 3 WHEN 0 THEN 'mg/ml' WHEN 1 THEN '%wv' ELSE 'mg' END, '|injection') AS key_plain,
  CASE WHEN p_size % 3 = 1 THEN concat(p_name, ':', p_size * 10, 'mg/ml|injection') END AS conv_plain FROM (SELECT DISTINCT p_name, p_size FROM part)""")
def ceilings_of_injections(spark, sf_dir):
    """C7 C13 G8 G9"""
    sql = """SELECT row_number() OVER (ORDER BY p_name, p_size) AS id, upper(p_name) AS formulation_raw, 'INJECTION' AS form_raw, concat(cast(p_size AS string), CASE WHEN p_size % 3 = 1 THEN '%' ELSE ' MG' END) AS strength_raw,
      CASE WHEN p_size % 3 = 2 THEN 'vial' ELSE 'ml' END AS unit_type, cast(1 AS double) AS unit_count, cast(NULL AS double) AS pack_volume_ml, cast(1 AS double) AS price_value FROM (SELECT DISTINCT p_name, p_size FROM {part})"""
    return canonical.canonical_ceilings(spark.sql(sql, part=_part(spark, sf_dir))).select("row_id", "key_plain", "conv_plain")


# ---------------------------------------------------------------- sources


@_query("""SELECT CASE WHEN p_partkey % 13 = 0 THEN 'missing_field:product_id' WHEN p_partkey % 11 = 0 THEN 'missing_field:generic_name' WHEN p_partkey % 7 = 0 THEN 'invalid_mrp' WHEN p_partkey % 5 = 0 THEN 'inactive_product' WHEN p_partkey % 17 = 0 THEN 'unknown_status' ELSE 'kept' END AS reason, count(*) AS n FROM part GROUP BY 1""")
def product_reject_reasons(spark, sf_dir):
    """S1 S2 S8 A14"""
    sql = """SELECT 'p' AS path, 'x' AS sha256, concat('{{"responseCode":200,"responseBody":{{"newProductResponsesList":[{{"productId":', CASE WHEN p_partkey % 13 = 0 THEN 'true' ELSE cast(p_partkey AS string) END, ',"drugCode":', cast(p_size AS string), ',"genericName":"', CASE WHEN p_partkey % 11 = 0 THEN '  ' ELSE p_name END,
      '","mrp":', CASE WHEN p_partkey % 7 = 0 THEN '"12.5"' ELSE cast(p_retailprice AS string) END, ',"status":', CASE WHEN p_partkey % 5 = 0 THEN '0' WHEN p_partkey % 17 = 0 THEN '7' ELSE '1' END, '}}],"totalElement":1}}}}') AS content FROM {part}"""
    documents = product_files.assert_complete(spark.sql(sql, part=_part(spark, sf_dir)))
    rows = product_files.checked(product_files.product_rows(documents))
    return rows.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@_query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_returnflag, CAST(l_quantity AS INTEGER) AS q, CASE WHEN l_linenumber = 7 THEN 'missing_field:so_number' WHEN l_returnflag = 'A' AND CAST(l_quantity AS INTEGER) % 10 = 0 THEN 'unparseable_price_qualifier' END AS reason,
    row_number() OVER (ORDER BY l_orderkey, l_linenumber) AS n FROM lineitem),
  d AS (SELECT *, row_number() OVER (PARTITION BY reason IS NULL, l_returnflag, q, l_orderkey % 100 ORDER BY n) AS k FROM r)
  SELECT coalesce(CASE WHEN reason IS NULL AND k > 1 THEN 'duplicate_row' ELSE reason END, 'kept') AS reason, count(*) AS n FROM d GROUP BY 1""")
def ceiling_reject_reasons(spark, sf_dir):
    """S4 S5 S6 W6 A14"""
    sql = """SELECT 'f' AS source_file, l_orderkey * 10 + l_linenumber AS csv_record, '12' AS sl_no, '2022' AS nlem_version, l_returnflag AS formulation, concat('Tablet ', cast(l_orderkey % 100 AS string), ' mg') AS dosage,
      CASE WHEN l_linenumber = 7 THEN '' ELSE '1' END AS so_number, 'd' AS so_date, concat('₹ 2.5(', CASE WHEN l_returnflag = 'A' AND cast(l_quantity AS int) % 10 = 0 THEN 'dozen' ELSE concat(cast(cast(l_quantity AS int) AS string), ' Tablets') END, ')') AS price FROM {t}"""
    rows = ceiling_files.checked(spark.sql(sql, t=spark.read.parquet(f"{sf_dir}/lineitem.parquet")))
    return rows.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@_query("SELECT doc_id, upper(sha256(text)) AS sha256 FROM documents")
def provenance_hashes(spark, sf_dir):
    """S9"""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.upper(F.sha2("text", 256)).alias("sha256"))


# ---------------------------------------------------------------- matching and prices


@_query(_with("SELECT id FROM ceil WHERE NOT odd AND name IN (SELECT name FROM cat) AND false"))
def naive_baseline_rows(spark, sf_dir):
    """C14 J8: names with strengths in them never equal molecules"""
    return canonical.naive_baseline(catalogue(spark, sf_dir), ceilings(spark, sf_dir)).select("id")


@_query("SELECT p_partkey AS id FROM part WHERE p_partkey % 3 = 0")
def naive_baseline_hits(spark, sf_dir):
    """C14 J8"""
    p = _part(spark, sf_dir)
    known = p.select(F.concat(F.lit("Kappa, "), "p_name", F.lit(" & mu")).alias("generic_name"))
    asked = p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.upper("p_name"), F.lit(" +\nMU + KAPPA"))).otherwise(F.concat("p_name", F.lit("+nu"))).alias("formulation_raw"))
    return canonical.naive_baseline(known, asked).select("id")


def _pairs_of(spark, sf_dir) -> DataFrame:
    return _match(spark, sf_dir).ladder.pairs


@_query(_with("SELECT key AS match_key, id AS row_id, product_id, stage FROM pairs"))
def match_pairs(spark, sf_dir):
    """J1 J2 J3 J4 J5 J6 W2 R1 P1"""
    return _pairs_of(spark, sf_dir).select("match_key", "row_id", "product_id", "stage")


@_query(_with("SELECT mk.key AS match_key, method AS match_method, confidence, (SELECT count(*) FROM kn WHERE kn.key = mk.key) AS n_ceilings, (SELECT count(*) FROM kp WHERE kp.key = mk.key) AS n_products FROM mk"))
def match_ladder(spark, sf_dir):
    """A1 U3"""
    m = ladder.fold_matches(_pairs_of(spark, sf_dir))
    return m.select("match_key", "match_method", "confidence", F.size("nppa_ids").cast("long").alias("n_ceilings"), F.size("jap_ids").cast("long").alias("n_products"))


@_query("SELECT p_partkey AS id, CAST(200.0 * length(p_name) / (2 * length(p_name) + 1) AS DOUBLE) AS arrow, CAST(200.0 * length(p_name) / (2 * length(p_name) + 1) AS DOUBLE) AS native FROM part")
def similarity_ratio(spark, sf_dir):
    """R1"""
    odd = F.concat("p_name", F.lit("x"))
    return _part(spark, sf_dir).select(F.col("p_partkey").alias("id"), similarity.ratio_column("p_name", odd).alias("arrow"), similarity.ratio_native(F.col("p_name"), odd).alias("native"))


@_query(_with("SELECT * FROM equiv"))
def equivalents(spark, sf_dir):
    """V1 V2 V3 V4 J9 W1 P2 P3 P4"""
    return _match(spark, sf_dir).equivalents.drop("id", "computed_at")


@_query(_with("SELECT match_key, jap_product_id, CAST(row_number() OVER (ORDER BY match_key, jap_product_id) AS BIGINT) AS id FROM equiv"))
def equivalent_ids(spark, sf_dir):
    """W7 W8"""
    return _match(spark, sf_dir).equivalents.select("match_key", "jap_product_id", "id")


@_query(_with("""SELECT 'excluded_zero_mrp' AS reason, count(*) AS n FROM kp JOIN cat USING (product_id) WHERE mrp = 0
  UNION ALL SELECT 'excluded_basis_mismatch', count(*) FROM kp JOIN cat USING (product_id) WHERE mrp <> 0 AND (key, product_id) NOT IN (SELECT key, product_id FROM cand)"""))
def price_exclusion_counts(spark, sf_dir):
    """A3 A15 P2 P4"""
    m = _match(spark, sf_dir)
    return align.price_exclusions(m.matches, m.products, m.equivalents)


@_query(_with("SELECT match_key, molecule_set, form, CASE WHEN method IS NULL THEN 'unmatched' ELSE confidence END AS confidence, method AS match_method FROM canon LEFT JOIN mk ON key = match_key"))
def canonical_overlay(spark, sf_dir):
    """A2 U1"""
    return _match(spark, sf_dir).canonical.select("match_key", "molecule_set", "form", "confidence", "match_method")


@_query(_with("""SELECT 'match_stage_1_count' AS key, CAST(count(DISTINCT key) AS VARCHAR) AS value FROM s1 UNION ALL SELECT 'match_stage_2_count', CAST(count(DISTINCT key) AS VARCHAR) FROM s2
  UNION ALL SELECT 'match_stage_3_count', CAST(count(DISTINCT key) AS VARCHAR) FROM s3 UNION ALL SELECT 'form_family_count', CAST(count(DISTINCT key) AS VARCHAR) FROM s4
  UNION ALL SELECT 'matched_nppa_keys', CAST(count(*) AS VARCHAR) FROM mk UNION ALL SELECT 'matched_nppa_rows', CAST(count(DISTINCT id) AS VARCHAR) FROM pairs
  UNION ALL SELECT 'matched_jap_products', CAST(count(DISTINCT product_id) AS VARCHAR) FROM pairs UNION ALL SELECT 'equivalents_count', CAST(count(*) AS VARCHAR) FROM equiv
  UNION ALL SELECT 'nppa_canonical_keys', CAST(count(DISTINCT key) AS VARCHAR) FROM ceil UNION ALL SELECT 'unmatched_nppa_count', CAST(count(*) AS VARCHAR) FROM ceil WHERE id NOT IN (SELECT id FROM pairs)
  UNION ALL SELECT 'unmatched_jap_count', CAST(count(*) AS VARCHAR) FROM cat WHERE product_id NOT IN (SELECT product_id FROM pairs)
  UNION ALL SELECT 'slash_mismatch_count', '0' UNION ALL SELECT 'modifier_relaxed_count', '0' UNION ALL SELECT 'pct_conversion_count', '0' UNION ALL SELECT 'stage_0_baseline_count', '0'
  UNION ALL SELECT 'nppa_raw_keys', CAST(count(DISTINCT (name, size)) AS VARCHAR) FROM ceil UNION ALL SELECT 'nppa_formulation_keys', CAST(count(DISTINCT (name, size)) AS VARCHAR) FROM ceil
  UNION ALL SELECT 'excluded_zero_mrp', CAST(count(*) AS VARCHAR) FROM kp JOIN cat USING (product_id) WHERE mrp = 0
  UNION ALL SELECT 'excluded_basis_mismatch', CAST(count(*) AS VARCHAR) FROM kp JOIN cat USING (product_id) WHERE mrp <> 0 AND (key, product_id) NOT IN (SELECT key, product_id FROM cand)
  UNION ALL SELECT 'match_computed_at', '2025-01-01T00:00:00+00:00'"""))
def match_metadata(spark, sf_dir):
    """S13 A4 A15 J7"""
    return _match(spark, sf_dir).meta


@_query("SELECT c AS \"check\", CAST(0 AS BIGINT) AS n FROM (VALUES ('match_key'), ('nppa_row_id'), ('jap_product_id'), ('zero_mrp'), ('unit_basis')) t(c)")
def integrity_checks(spark, sf_dir):
    """J12 P8"""
    t = _tables(spark, sf_dir)
    lost = overlay.dangling(t.equivalents, t.canonical, t.ceilings, t.products)
    return lost.unionByName(serve.basis_faults(t).agg(F.count("*").alias("n")).select(F.lit("unit_basis").alias("check"), "n"))


def _own_ladder(spark: SparkSession, sf_dir: str, name: str, form: str, dosage: str, formulation: str, strength_raw: str) -> ladder.Ladder:
    """The ladder over products and ceilings that are made for one question; each (p_name, p_size) is a ceiling."""
    part = _part(spark, sf_dir)
    p = spark.sql("SELECT p_partkey AS product_id, " + name + " AS generic_name, '10''s' AS unit_size, p_retailprice AS mrp FROM {part}", part=part)
    c = spark.sql(
        "SELECT row_number() OVER (ORDER BY p_name, p_size) AS id, " + formulation + " AS formulation_raw, " + form + " AS form_raw, " + strength_raw + " AS strength_raw, " + dosage
        + " AS unit_type, cast(1 AS double) AS unit_count, cast(NULL AS double) AS pack_volume_ml, cast(1 AS double) AS price_value FROM (SELECT DISTINCT p_name, p_size FROM {part})", part=part,
    )
    return ladder.run_ladder(settle(canonical.canonical_products(p), "products"), settle(canonical.canonical_ceilings(c), "ceilings"))


@_query("SELECT id AS row_id FROM (SELECT row_number() OVER (ORDER BY p_name, p_size) AS id, p_size FROM (SELECT DISTINCT p_name, p_size FROM part)) WHERE p_size <> 5")
def slash_mismatches(spark, sf_dir):
    """J7: molecules and strengths are known, but paired the other way round"""
    made = _own_ladder(spark, sf_dir, "concat(p_name, ' 5mg and kappa ', cast(p_size AS string), 'mg Tablets')", "'TABLET'", "'tablet'", "concat(p_name, ' (A) + KAPPA (B)')", "concat(cast(p_size AS string), ' MG (A) + 5 MG (B)')")
    return made.slashes.select(F.col("n_row_id").alias("row_id"))


@_query("""WITH c AS (SELECT row_number() OVER (ORDER BY p_name, p_size) AS row_id, p_name, p_size FROM (SELECT DISTINCT p_name, p_size FROM part))
  SELECT row_id, p_partkey AS product_id, p_size % 2 = 1 AS via FROM c JOIN part USING (p_name, p_size)""")
def match_by_conversion(spark, sf_dir):
    """J1 J2 G8: percent strengths meet their mg/ml, whichever side has them"""
    made = _own_ladder(
        spark, sf_dir, "CASE WHEN p_size % 2 = 0 THEN concat(p_name, ' Injection ', cast(p_size AS string), '% w/v') ELSE concat(p_name, ' Injection ', cast(p_size * 10 AS string), ' mg per ml') END",
        "'INJECTION'", "'vial'", "p_name", "CASE WHEN p_size % 2 = 0 THEN concat(cast(p_size * 10 AS string), ' MG/ML') ELSE concat(cast(p_size AS string), ' %') END",
    )
    return made.pairs.select("row_id", "product_id", "via")


@_query("""WITH c AS (SELECT row_number() OVER (ORDER BY p_name, p_size) AS row_id, p_name, p_size FROM (SELECT DISTINCT p_name, p_size FROM part))
  SELECT row_id, min(p_partkey) AS product_id, round(200.0 * length(p_name) / (2 * length(p_name) + 2), 1) AS score FROM c JOIN part USING (p_name, p_size) WHERE length(p_name) < 12 GROUP BY row_id, p_name ORDER BY row_id LIMIT 200""")
def review_queue(spark, sf_dir):
    """J4 W2 W9: the first 200 near misses (the cap is the feature)"""
    made = _own_ladder(spark, sf_dir, "concat(p_name, ' Tablets ', cast(p_size AS string), ' mg')", "'TABLET'", "'tablet'", "concat(p_name, 'xx')", "concat(cast(p_size AS string), ' MG')")
    return made.review.select("row_id", "product_id", F.col("score").cast("double").alias("score"))


@_query(_with("SELECT concat(upper(name), CASE WHEN odd THEN 'X' ELSE '' END) AS formulation_raw, concat(size, CASE WHEN size % 3 = 2 THEN 'mg/ml' ELSE 'mg' END) AS strength_set, count(*) AS n FROM ceil WHERE id NOT IN (SELECT id FROM pairs) GROUP BY 1, 2 ORDER BY n DESC, min(id) LIMIT 15"))
def unmatched_formulations(spark, sf_dir):
    """A13 (the limit is the feature)"""
    m = _match(spark, sf_dir)
    return overlay.unmatched_report(m.products, m.ceilings, m.ladder)[0]


# ---------------------------------------------------------------- serving


def _search_sql(tiers: str) -> str:
    return _with(f"SELECT match_key, tier, n_equivalents, CAST(row_number() OVER (ORDER BY t, CASE WHEN n_equivalents > 0 THEN 0 ELSE 1 END, match_key) AS INTEGER) AS rank FROM (SELECT match_key, t, CASE t WHEN 0 THEN 'exact' WHEN 1 THEN 'prefix' ELSE 'substring' END AS tier, (SELECT count(*) FROM equiv e WHERE e.match_key = canon.match_key) AS n_equivalents, FROM (SELECT *, {tiers} AS t FROM canon) canon WHERE t IS NOT NULL) ORDER BY rank LIMIT 100000")


@_query(_search_sql("CASE WHEN molecule_set = 'red bolt' THEN 0 WHEN molecule_set = 'red boltx' THEN 1 END"))
def search_exact_and_prefix(spark, sf_dir):
    """R3 R4 R5 R6 W5 J10 U5 U6 A5"""
    got = serve.search(_tables(spark, sf_dir), " Red  Bolt IP", 100_000)
    return got.filter("tier <> 'fuzzy'").select("match_key", "tier", "n_equivalents", "rank")


@_query(_search_sql("CASE WHEN molecule_set LIKE '%bolt%' THEN 2 END"))
def search_substring(spark, sf_dir):
    """R4 R6 P5 T6"""
    got = serve.search(_tables(spark, sf_dir), "bolt", 100_000)
    return got.filter("tier <> 'fuzzy'").select("match_key", "tier", "n_equivalents", "rank")


@_query()
def search_fuzzy(spark, sf_dir):
    """R2 R6: keys near a misspelt query; checked against brute force in the tests"""
    return serve.search(_tables(spark, sf_dir), "blve wigdet", 50)


@_query(_with("""SELECT match_key, molecule_set AS molecules, jap_product_id AS product_id, e.nppa_ceiling_per_unit AS ceiling, savings_pct,
  concat_ws(';', CASE WHEN match_method = 'form_family' THEN 'form_or_modifier_relaxed: verify dosage form' END, CASE WHEN confidence = 'low' THEN 'low_match_confidence' END, CASE WHEN savings_pct < 0 THEN 'jap_price_above_ceiling' END,
    CASE WHEN savings_pct < 0 AND jap_per_unit / nppa_ceiling_per_unit BETWEEN 1.05 AND 1.15 THEN 'possible_tax_basis_difference' END) AS caveats
  FROM (SELECT *, row_number() OVER (PARTITION BY match_key ORDER BY savings_pct DESC, jap_product_id) AS k FROM equiv) e JOIN canon USING (match_key) WHERE k = 1"""))
def equivalence_cards(spark, sf_dir):
    """R7 P7 W3 J11"""
    c = serve.cards(_tables(spark, sf_dir))
    return c.select("match_key", "molecules", F.col("jap_side.product_id").alias("product_id"), F.col("nppa_side.ceiling_per_unit_inr").alias("ceiling"), "savings_pct", F.array_join("caveats", ";").alias("caveats"))


@_query(_with(""", held AS (SELECT key, product_id FROM kp UNION ALL SELECT * FROM (SELECT concat(name, ':', size, CASE WHEN form = 'syrup' THEN 'mg/ml' ELSE 'mg' END, '|', form) AS key, product_id FROM cat
    WHERE product_id NOT IN (SELECT product_id FROM pairs)) WHERE key NOT IN (SELECT key FROM mk)),
  placed AS (SELECT held.*, row_number() OVER (PARTITION BY product_id ORDER BY e.match_key IS NULL, f.first) AS place FROM held LEFT JOIN (SELECT DISTINCT match_key FROM equiv) e ON e.match_key = held.key
    LEFT JOIN (SELECT key, min(id) AS first FROM ceil GROUP BY key) f ON f.key = held.key),
  listed AS (SELECT jap_product_id, count(*) AS n, string_agg(match_key, ';' ORDER BY savings_pct DESC, match_key) AS comparisons FROM equiv GROUP BY jap_product_id)
  SELECT cat.product_id, placed.key AS match_key, coalesce(listed.n, 0) AS n_equivalents, coalesce(comparisons, '') AS comparisons, CASE WHEN mrp = 0 THEN 'price_not_published' END AS excluded_reason
  FROM cat LEFT JOIN placed ON placed.product_id = cat.product_id AND place = 1 LEFT JOIN listed ON jap_product_id = cat.product_id"""))
def product_pages(spark, sf_dir):
    """R8 W4. A product whose key had matched before it could is in no key's list, so it has none here."""
    found = F.coalesce("equivalents.match_key", F.array().cast("array<string>"))
    pages = serve.product_pages(_tables(spark, sf_dir))
    return pages.select("product_id", "match_key", F.size(found).cast("long").alias("n_equivalents"), F.array_join(found, ";").alias("comparisons"), "excluded_reason")


@_query(_with("SELECT match_method, count(*) AS n FROM equiv GROUP BY match_method"))
def method_distribution(spark, sf_dir):
    """A6"""
    return serve.method_distribution(_tables(spark, sf_dir))


@_query(_with("SELECT count(*) AS equivalents_count, round(median(savings_pct), 9) AS median, min(savings_pct) AS min, max(savings_pct) AS max, count(*) FILTER (savings_pct < 0) AS negative_count FROM equiv"))
def savings_stats(spark, sf_dir):
    """A7 A8 P6 R9"""
    return serve.savings_stats(_tables(spark, sf_dir)).withColumn("median", F.round("median", 9))


@_query(_with("""SELECT k AS key, count(match_key) AS n, CASE WHEN any_value(total) = 0 THEN 0.0 ELSE CAST(printf('%.1f', CAST(100 AS DOUBLE) * count(match_key) / any_value(total)) AS DOUBLE) END AS pct
  FROM (SELECT k, (SELECT count(*) FROM equiv) AS total FROM (VALUES ('le0'), ('0-30'), ('30-60'), ('60-80'), ('gt80')) b(k)) b
  LEFT JOIN (SELECT match_key, CASE WHEN savings_pct <= 0 THEN 'le0' WHEN savings_pct <= 30 THEN '0-30' WHEN savings_pct <= 60 THEN '30-60' WHEN savings_pct <= 80 THEN '60-80' ELSE 'gt80' END AS bucket FROM equiv) ON bucket = k GROUP BY k"""))
def savings_histogram(spark, sf_dir):
    """A9"""
    return serve.savings_histogram(_tables(spark, sf_dir)).select("key", F.col("n").cast("long").alias("n"), "pct")


@_query(_with("""SELECT *, CASE WHEN (SELECT count(*) FROM ceil) = 0 THEN 0.0 ELSE CAST(printf('%.1f', CAST(100 AS DOUBLE) * value / (SELECT count(DISTINCT (name, size)) FROM ceil)) AS DOUBLE) END AS pct
  FROM (SELECT 0 AS ord, 'Naive baseline' AS label, CAST(0 AS BIGINT) AS value UNION ALL SELECT 1, 'Exact', (SELECT count(DISTINCT key) FROM s1) UNION ALL SELECT 2, '+ Alias', (SELECT count(DISTINCT key) FROM s1) + (SELECT count(DISTINCT key) FROM s2)
  UNION ALL SELECT 3, '+ Fuzzy', (SELECT count(DISTINCT key) FROM s1) + (SELECT count(DISTINCT key) FROM s2) + (SELECT count(DISTINCT key) FROM s3) UNION ALL SELECT 4, '+ Form family', (SELECT count(*) FROM mk))"""))
def ladder_bars(spark, sf_dir):
    """A11 A12"""
    return serve.ladder_bars(_tables(spark, sf_dir)).select("ord", "label", "value", "pct")


@_query(_with("""SELECT (SELECT count(DISTINCT key) FROM s1) AS stage_1_exact, (SELECT count(DISTINCT key) FROM s2) AS stage_2_alias, (SELECT count(DISTINCT key) FROM s3) AS stage_3_fuzzy,
  (SELECT count(DISTINCT key) FROM s4) AS form_family, (SELECT count(*) FROM mk) AS matched_keys, total_nppa_keys,
  CASE WHEN total_nppa_keys = 0 THEN 0.0 ELSE CAST(printf('%.1f', CAST(100 AS DOUBLE) * (SELECT count(*) FROM mk) / total_nppa_keys) AS DOUBLE) END AS coverage_pct,
  equivalents_count, median, min, max, negative_count, (SELECT string_agg(match_method || '=' || n, ';' ORDER BY match_method) FROM (SELECT match_method, count(*) AS n FROM equiv GROUP BY match_method)) AS methods,
  '2025-01-01T00:00:00+00:00' AS data_as_on, compared_keys
  FROM (SELECT count(DISTINCT (name, size)) AS total_nppa_keys FROM ceil), (SELECT count(*) AS equivalents_count, round(median(savings_pct), 9) AS median, min(savings_pct) AS min, max(savings_pct) AS max,
  count(*) FILTER (savings_pct < 0) AS negative_count, count(DISTINCT match_key) AS compared_keys FROM equiv)"""))
def stats_payload(spark, sf_dir):
    """R9 A6 A7 A8 A10 A12 S16"""
    t = _tables(spark, sf_dir)
    methods = F.array_join(F.transform(F.map_entries("method_distribution"), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("methods")
    flat = serve.stats(t).withColumn("median", F.round("median", 9)).select("match_ladder.*", "equivalents_count", "median", "min", "max", "negative_count", methods, "data_as_on")
    return flat.crossJoin(F.broadcast(serve.compared_keys(t)))  # one row each


@_query(_with("SELECT 'jap_products' AS \"table\", (SELECT count(*) FROM cat) AS n UNION ALL SELECT 'nppa_ceiling_prices', (SELECT count(*) FROM ceil) UNION ALL SELECT 'canonical_formulations', (SELECT count(*) FROM canon) UNION ALL SELECT 'equivalents', (SELECT count(*) FROM equiv)"))
def table_counts(spark, sf_dir):
    """S15"""
    return serve.table_counts(_tables(spark, sf_dir))


@_query("SELECT '2025-01-01T00:00:00+00:00' AS data_as_on")
def freshness(spark, sf_dir):
    """S16"""
    return serve.data_as_on(_tables(spark, sf_dir))


@_query("SELECT id, slug || CASE WHEN n > 1 THEN '-' || n ELSE '' END AS slug, n > 1 AS collided FROM (SELECT p_partkey AS id, replace(p_name, ' ', '-') AS slug, row_number() OVER (PARTITION BY p_name ORDER BY lpad(CAST(p_partkey AS VARCHAR), 9, '0')) AS n FROM part)")
def slug_map(spark, sf_dir):
    """T10 T11"""
    # characters that slugs drop make keys of one slug differ
    digits = F.translate(F.lpad(F.col("p_partkey").cast("string"), 9, "0"), "0123456789", "!#$%&()*+,")
    keys = _part(spark, sf_dir).select(F.col("p_partkey").alias("id"), F.concat("p_name", digits).alias("match_key"))
    return serve.slug_map(keys.select("match_key")).join(keys, "match_key").select("id", "slug", "collided")


@_query("""SELECT p_partkey AS id, concat('₹', printf('%.2f', p_retailprice / 7)) AS inr, concat(CASE WHEN p_size >= 25 THEN concat('~', printf('%.1f', (p_size - 25) / 3), '% less at Jan Aushadhi') ELSE concat('~', printf('%.1f', (25 - p_size) / 3), '% MORE at Jan Aushadhi — above the ceiling') END) AS hero,
  concat(upper(substr(split_part(p_name, ' ', 1), 1, 1)), substr(split_part(p_name, ' ', 1), 2), ' ', upper(substr(split_part(p_name, ' ', 2), 1, 1)), substr(split_part(p_name, ' ', 2), 2), ' + Kappa-Mu ', p_size, 'mg + 2iu tablet') AS name FROM part""")
def display_texts(spark, sf_dir):
    """T7 T8 T9"""
    rows = _part(spark, sf_dir)
    pct = (F.col("p_size") - 25) / 3
    s = F.concat(F.col("p_size").cast("string"), F.lit("mg+2iu"))
    return rows.select(F.col("p_partkey").alias("id"), text.rupees(F.col("p_retailprice") / 7).alias("inr"), text.savings_line(pct).alias("hero"), text.display_name(F.concat("p_name", F.lit("+kappa-mu")), s, F.lit("tablet")).alias("name"))
