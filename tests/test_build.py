"""Files to tables to answers: sources, the build, the ladder against a plain loop, and the serving queries."""

import json

import pytest
from pyspark.sql import functions as F

from pricebridge.operators import canonical, ladder, overlay
from pricebridge.plans import build, serve
from pricebridge.sources import ceilings, products, rest

PRODUCTS = [
    (1, 1681, "Aceclofenac 100mg and Paracetamol 325mg Tablets", "10's", 10.32, 1), (2, 2, "Paracetamol Tablets IP 500 mg", "10's", 6.56, 1), (3, 3, "Dextrose Injection IP 5%", "500 ml", 22.0, 1), (4, 4, "Dicyclomine Injection IP 10 mg per ml", "2 ml", 3.75, 1),
    (5, 5, "Frusemide Tablets 40 mg", "10's", 0.0, 1), (6, 6, "Amoxycillin 500mg and Clavulanic Acid 125mg Tablets", "6's", 50.0, 1), (7, 7, "Cetirizin Tablets 10 mg", "10's", 9.0, 1), (8, 8, "Paracetamol Oral Suspension 25 mg per ml", "60 ml", 12.0, 1),
    (9, 9, "Metformin Hydrochloride Sustained Release Tablets IP 1000 mg", "KIT", 20.0, 1), (10, 10, "Vitamin B-Complex Tablets", "10's", 5.0, 1), (11, 11, "Aspirin Tablets 300 mg", "10's", 5.0, 0), (12, 12, "Sodium Chloride 0.9% and Glucose 5% Injection", "500 ml", 30.0, 1),
]
CEILINGS = [
    ("1", "2022", "PARACETAMOL", "TABLET 500 MG", "₹ 0.93(1 Tablet)"), ("2", "2015", "Glucose", "Injection 5%", "₹ 0.62(1 ML)"), ("3", "2015", "Glucose", "Injection 5%", "₹ 45.08(500ml Glass)"), ("4", "2022", "DICYCLOMINE", "INJECTION 10 MG", "₹ 3.40(1 ML (Less than 10 ML Pack))"),
    ("5", "2022", "DICYCLOMINE", "INJECTION 10 MG", "₹ 2.15(1 ML (10 ML & more pack))"), ("6", "2015", "Furosemide", "Tablet 40 mg", "₹ 1(1 Tablet)"), ("7", "2022", "Amoxicillin (A) +\nClavulanic acid (B)", "Tablet 500 MG (A)\n+125 MG(B)", "₹ 15.5(1 Tablet)"),
    ("8", "2022", "CETIRIZINE", "TABLET 10 MG", "₹ 1.7(1 Tablet)"), ("9", "2022", "PARACETAMOL", "SYRUP 25 MG/ML", "₹ 0.5(1 ML)"), ("10", "2022", "METFORMIN", "TABLET 1000 MG", "₹ 3(1 Tablet)"), ("11", "2022", "Insulin", "Injection 40 IU/ ML", "₹ 17.4(1 ML)"),
    ("12", "2022", "Insulin", "Injection 40 IU/ ML", "₹ 17.4(1 ML)"), ("13", "2022", "Glucose (A) + Sodium Chloride (B)", "Injection 0.9% (A) + 5% (B)", "₹ 31(250ml Glass)"), ("x", "", "A", "B", "₹ 1(1 Tablet)"), ("15", "", "", "B", "₹ 1(1 Tablet)"), ("16", "", "A", "B", "free"), ("17", "", "A", "B", "₹ 1(by weight)"),
]


def ceiling_csv(rows, nlem=True):
    cell = lambda c: '"' + c.replace('"', '""') + '"'
    head = ["", " SL No" if nlem else "S.No.", *([" NLEM Version"] if nlem else []), " Formulation", " Dosage & Strength", " SO Number", " SO Date", " Ceiling Price ( Excluding Taxes)"]
    lines = ['"",""', '"","All"', '"","","DATE","x"', "", ",".join(map(cell, head))]
    for n, version, formulation, dosage, price in rows:
        lines.append(",".join(map(cell, ["", n, *([version] if nlem else []), formulation, dosage, "1(E)", "25-Mar-2026", price])))
    return "﻿" + "\n".join(lines) + "\n"


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    folder = tmp_path_factory.mktemp("files")
    rows = [dict(zip(("productId", "drugCode", "genericName", "unitSize", "mrp", "status"), p, strict=True), groupName="g", extra=1) for p in PRODUCTS]
    bad = [{"productId": True, "drugCode": 1}, {"productId": 90}, {"productId": 91, "drugCode": 1, "genericName": " "}, {"productId": 92, "drugCode": 1, "genericName": "x", "mrp": "12.5"}, {"productId": 93, "drugCode": 1, "genericName": "x", "mrp": 1, "status": True}, {"productId": 94, "drugCode": 1, "genericName": "x", "mrp": 1, "status": 1.0}, 7]
    body = {"responseCode": 200, "responseBody": {"newProductResponsesList": rows + bad, "totalElement": len(rows + bad)}}
    (folder / "products.json").write_text(json.dumps(body), encoding="utf-8")
    (folder / "list.json").write_text(json.dumps(rows), encoding="utf-8")
    (folder / "all.csv").write_text(ceiling_csv(CEILINGS), encoding="utf-8")
    (folder / "special.csv").write_text(ceiling_csv([("1", "", "Ringer", "Injection 500 ml", "₹ 70(Each 1000 ml pack of glass)")], nlem=False), encoding="utf-8")
    return folder


@pytest.fixture(scope="module")
def built(spark, files):
    out = str(files / "out")
    build.build(spark, out, str(files / "products.json"), str(files / "all.csv"), str(files / "special.csv"), str(files / "rejects"), build_ts="2025-01-01T00:00:00+00:00")
    return serve.Tables.load(spark, out)


def test_products_are_validated_in_order(spark, files):
    rows = products.checked(products.product_rows(products.read_documents(spark, str(files / "products.json"))))
    good, bad = products.split(rows, "now")
    assert sorted(r["product_id"] for r in good.collect()) == [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 94]
    want = [(None, "missing_field:product_id"), (None, "missing_field:row"), (11, "inactive_product"), (90, "missing_field:drug_code"), (91, "missing_field:generic_name"), (92, "invalid_mrp"), (93, "unknown_status")]
    assert sorted(((r["product_id"], r["reason"]) for r in bad.collect()), key=repr) == sorted(want, key=repr)


def test_bare_lists_and_other_documents(spark, files):
    docs = products.read_documents(spark, str(files / "list.json"))
    assert products.product_rows(docs).count() == len(PRODUCTS)
    odd = spark.createDataFrame([("p", "{}", "x"), ("q", "nonsense", "x"), ("r", "3", "x")], "path string, content string, sha256 string")
    assert products.product_rows(odd).count() == 0
    with pytest.raises(Exception, match="responseCode"):
        products.assert_complete(odd).collect()


def test_ceilings_are_validated_in_order(spark, files):
    rows = ceilings.checked(ceilings.read_ceilings(spark, str(files / "all.csv"), "nppa_all"))
    good, bad = ceilings.split(rows)
    assert good.count() == 12
    assert [(r["sl_no"], r["reason"]) for r in bad.orderBy("csv_record").collect()] == [(12, "duplicate_row"), (None, "invalid_sl_no"), (15, "missing_formulation"), (16, "unparseable_price"), (17, "unparseable_price_qualifier")]
    first = good.orderBy("csv_record").first()
    assert first["source_row"] == "nppa_all sl_no=1 csv_record=6" and first["form_raw"] == "TABLET" and first["strength_raw"] == "500 MG"


def test_header_must_be_there(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,2\n")
    with pytest.raises(Exception, match="no ceiling header"):
        ceilings.read_ceilings(spark, str(tmp_path / "x.csv"), "x").collect()


def test_equivalents(built):
    got = {r["jap_product_id"]: r for r in built.equivalents.collect()}
    assert set(got) == {2, 3, 4, 6, 7, 8}
    assert got[2]["jap_per_unit"] == 0.6559999999999999 and got[2]["savings_pct"] == 29.462365591397866
    assert got[4]["nppa_ceiling_per_unit"] == 3.4 and got[4]["nppa_variant_basis"] == "pack_condition_match" and got[4]["savings_pct"] == pytest.approx(44.85294117647059)
    assert got[3]["nppa_variant_basis"] == "exact_volume" and got[3]["match_method"] == "alias" and got[3]["nppa_nlem_version"] == "2015"
    assert got[7]["match_method"] == "fuzzy" and got[7]["confidence"] == "medium"
    assert got[8]["match_method"] == "form_family" and got[8]["confidence"] == "low"
    assert sorted(r["id"] for r in got.values()) == list(range(1, len(got) + 1))


def test_metadata(built):
    meta = {r["key"]: r["value"] for r in built.meta.collect()}
    want = {"total_rows": "19", "kept_rows": "12", "rejected_rows": "7", "nppa_all_rows": "17", "nppa_all_kept": "12", "nppa_all_rejected": "5", "nppa_special_kept": "1", "nppa_duplicate_count": "1", "equivalents_count": "6", "excluded_complex_composition": "1", "excluded_zero_mrp": "1", "slash_mismatch_count": "1"}
    assert {k: meta.get(k) for k in want} == want and meta["match_computed_at"] == "2025-01-01T00:00:00+00:00"


def test_canonical_table(built):
    rows = {r["match_key"]: r for r in built.canonical.collect()}
    assert rows["paracetamol:500mg|tablet"]["match_method"] == "exact" and rows["paracetamol:500mg|tablet"]["confidence"] == "high"
    assert rows["metformin:1000mg|tablet"]["match_method"] == "modifier_relaxed" and rows["aceclofenac:100mg+paracetamol:325mg|tablet"]["confidence"] == "unmatched"
    assert all(r["n"] == 0 for r in overlay.dangling(built.equivalents, built.canonical, built.ceilings, built.products).collect())
    assert serve.basis_faults(built).count() == 0


def test_partial_build_leaves_the_rest(spark, files):
    out = str(files / "partial")
    build.build(spark, out, str(files / "products.json"), str(files / "all.csv"), str(files / "special.csv"))
    before = spark.read.parquet(f"{out}/nppa_ceiling_prices").count()
    build.build(spark, out, str(files / "list.json"))
    meta = {r["key"]: r["value"] for r in spark.read.parquet(f"{out}/meta").collect()}
    assert spark.read.parquet(f"{out}/nppa_ceiling_prices").count() == before and meta["total_rows"] == "12" and meta["nppa_all_kept"] == "12"


def test_search(built):
    tiers = [(r["match_key"], r["tier"]) for r in serve.search(built, "acetylsalicylic acid").collect()]
    assert all(t == "fuzzy" for _, t in tiers)
    got = serve.search(built, "Paracetamol", 10).collect()
    assert got[0]["tier"] == "exact" and got[0]["has_equivalents"] and [r["rank"] for r in got] == list(range(1, len(got) + 1))
    assert [r["tier"] for r in serve.search(built, "frusemide").collect()][0] == "exact"
    assert "prefix" in {r["tier"] for r in serve.search(built, "para").collect()}
    assert serve.search(built, "IP").count() == 0 and serve.search(built, "paracetamol", 0).count() == 0
    with pytest.raises(ValueError, match="query_too_short"):
        serve.search(built, " a ")


def test_cards_and_pages(built):
    card = serve.card(built, "paracetamol:500mg|tablet").collect()[0]
    assert card["jap_side"]["product_id"] == 2 and card["nppa_side"]["source_row"].startswith("nppa_all") and card["caveats"] == []
    assert serve.card(built, "nothing").collect() == []
    low = serve.card(built, "paracetamol:25mg/ml|syrup").collect()[0]
    assert low["caveats"] == ["form_or_modifier_relaxed: verify dosage form", "low_match_confidence"]
    page = serve.product_page(built, 5).collect()[0]
    assert page["excluded_reason"] == "price_not_published" and page["match_key"] == "furosemide:40mg|tablet"
    assert len(serve.product_page(built, 2).collect()[0]["equivalents"]) == 1


def test_stats(built):
    s = serve.stats(built).collect()[0]
    assert s["equivalents_count"] == 6 and sum(s["method_distribution"].values()) == 6 and s["data_as_on"] == "2025-01-01T00:00:00+00:00"
    assert sum(r["n"] for r in serve.savings_histogram(built).collect()) == 6
    bars = serve.ladder_bars(built).orderBy("ord").collect()
    assert [b["value"] for b in bars][0] == 0 and bars[-1]["value"] == s["match_ladder"]["matched_keys"]


def test_caveats(spark):
    rows = [("exact", "high", 10.0, 1.0, 2.0), ("form_family", "low", -8.06, 2.815, 2.605), ("exact", "high", -40.0, 1.406, 1.0), (None, None, None, None, None)]
    got = spark.createDataFrame(rows, "m string, c string, s double, j double, n double").select(serve.caveats(*(F.col(x) for x in "mcsjn")).alias("x")).collect()
    assert [r["x"] for r in got] == [[], ["form_or_modifier_relaxed: verify dosage form", "low_match_confidence", "jap_price_above_ceiling", "possible_tax_basis_difference"], ["jap_price_above_ceiling"], []]


def test_slugs(spark):
    names = ["a b", "a+b", "a|b", "é:1", "||", "x", "x!", "x-2", "x-2!", "y 3", "y", "y!", "y?", "y|"]
    want, used = {}, set()
    for key in sorted(names):  # one after the other
        base = {"é:1": "e-1", "||": "formulation"}.get(key) or "-".join("".join(c if c.isalnum() else " " for c in key).split())
        n, slug = 1, base
        while slug in used:
            n, slug = n + 1, f"{base}-{n + 1}"
        used.add(slug)
        want[key] = (slug, n > 1)
    keys = spark.createDataFrame([(k,) for k in names], "match_key string")
    assert {r["match_key"]: (r["slug"], r["collided"]) for r in serve.slug_map(keys).collect()} == want


def test_plans_have_no_cartesian_product_and_no_row_wise_python(spark, built):
    p = canonical.canonical_products(built.products)
    c = canonical.canonical_ceilings(built.ceilings)
    plan = ladder.run_ladder(p, c).pairs._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BatchEvalPython" not in plan


# ---------------------------------------------------------------- the service


class Fake:
    def __init__(self, *answers):
        self.answers, self.asked = list(answers), []

    def __call__(self, method, url, headers, body):
        self.asked.append((method, headers.get("Authorization"), body))
        return self.answers.pop(0)


GOOD = json.dumps({"responseCode": 200, "responseBody": {"newProductResponsesList": [{"productId": 1}], "totalElement": 1}})
TOKEN = (200, json.dumps({"responseBody": "t1"}))


def service(*answers):
    fake = Fake(*answers)
    return rest.Service("http://x/token", "http://x/products", {"pageSize": 5}, send=fake), fake


def test_two_requests():
    s, fake = service(TOKEN, (200, GOOD))
    assert s.products()["responseBody"]["totalElement"] == 1
    assert [a[0] for a in fake.asked] == ["GET", "POST"] and fake.asked[1][1] == "Bearer t1" and json.loads(fake.asked[1][2]) == {"pageSize": 5}


def test_a_stale_token_is_renewed_once():
    s, fake = service(TOKEN, (500, "x"), (200, json.dumps({"responseBody": "t2"})), (200, GOOD))
    s.products()
    assert fake.asked[-1][1] == "Bearer t2"
    s, _ = service(TOKEN, (500, "x"), TOKEN, (500, "y"))
    with pytest.raises(rest.FetchError, match="twice"):
        s.products()


@pytest.mark.parametrize(
    ("answers", "what"),
    [
        ([(404, "")], "HTTP 404"), ([(200, "no json")], "not valid JSON"), ([(200, "{}")], "responseBody string"), ([TOKEN, (403, "z")], "HTTP 403"), ([TOKEN, (200, "?")], "not valid JSON"),
        ([TOKEN, (200, json.dumps({"responseCode": 500}))], "responseCode"), ([TOKEN, (200, json.dumps({"responseCode": 200, "responseBody": {"newProductResponsesList": []}}))], "zero rows"),
        ([TOKEN, (200, GOOD.replace('"totalElement": 1', '"totalElement": 2'))], "partial pull"),
    ],
)
def test_failures(answers, what):
    s, fake = service(*answers)
    with pytest.raises(rest.FetchError, match=what):
        s.products()
    assert len(fake.asked) == len(answers)
