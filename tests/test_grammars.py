"""Goldens of the grammars: what a text says, and that columns say the same as the Python functions."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pricebridge.functions import composition, forms, molecules, packs, qualifiers, similarity, strength, text

STRENGTHS = {
    "300 mg": "300mg", "4 MG/ML": "4mg/ml", "5%": "5%wv", "100 MCG": "0.1mg", "40 IU/ ML": "40iu/ml", "INHALER 100 MCG": "0.1mg", "1 g": "1000mg", "0.90%": "0.9%wv", "37.5 mcg": "0.0375mg",
    "52 MGOF\nLEVONORGESTREL": "52mg", "125 mg per 5 ml": "25mg/ml", "1mg per 2ml": "0.5mg/ml", "60 MG/ 0.6 ML": "100mg/ml", "10 GM/ 15 ML": "666.667mg/ml", "100 MG/16.7 ML": "5.98802mg/ml",
    "10 mg/ml (1ml &\n2ml Pack)": "10mg/ml", "1500000 IU": "1500000iu", "15,00,000 IU": "1500000iu", "5000 KU": "5000ku", "6/400 MCG": "0.006mg+0.4mg", "50/500/25 MG": "25mg+50mg+500mg",
    "2%/0.005MG": "0.005mg+2%wv", "5% (A) + 0.9% (B)": "0.9%wv+5%wv", "500 MG (A)\n+125 MG(B)": "125mg+500mg", "60 (A) + 30 mg (B)": "30mg+60mg", "100 mg elemental iron\n(A) + 500mcg (B)": "0.5mg+100mg",
    "100 mg(A) + 1 Tablet\n(750 mg+ 37.5 mg) (B)": "37.5mg+100mg+750mg", "0.5% with 7.5% Glucose": "0.5%wv+7.5%wv", "25 %  in 500ml pack for packages in non-glass container": "25%wv",
    "500mg/100ml  in 100ml pack for packages in non-glass container": "5mg/ml", "2 million IU": "2000000iu", "5 % w/w": "5%ww", "5% v/v": "5%vv",
}
REASONS = {
    None: "absent_strength", "": "absent_strength", "--": "absent_strength", "1% (A) + 1:200000\n(5 mcg/ml) (B)": "ratio_strength", "0.5ml contains:\nToxoid 5Lf": "degenerate_composition",
    "4 MCG to 6 MCG": "range_strength", "2-5%": "range_strength", "1000000": "missing_unit", "500 ml": "volume_not_strength", "100 K AU": "complex_unit", "5 M": "complex_unit", "55 mg ± 5": "range_strength",
    "5 mg/0 ml": "unparseable_strength", "a pinch": "unparseable_strength", "18G": "unparseable_strength", "100% mercury free": "unparseable_strength",
}


@pytest.mark.parametrize(("raw", "want"), STRENGTHS.items())
def test_strengths(raw, want):
    assert strength.parse_strength(raw) == (want, None)


@pytest.mark.parametrize(("raw", "why"), REASONS.items())
def test_strength_reasons(raw, why):
    assert strength.parse_strength(raw) == (None, why)


def test_strength_parts_keep_their_order():
    assert strength.parse_parts("6/400 MCG")[0] == ["0.006mg", "0.4mg"]


@settings(max_examples=80, deadline=None)
@given(st.permutations(["250 mg", "40 IU", "2%", "0.5 mcg"]))
def test_combinations_sort_alike(parts):
    assert strength.parse_strength(" + ".join(parts)) == ("0.0005mg+250mg+40iu+2%wv", None)


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=40))
def test_cleaning_twice_changes_nothing_in_ascii(s):
    s = s.encode("ascii", "ignore").decode()
    once = text.clean(s)
    assert " ".join(once.split()) == once and "  " not in once


def test_marks_and_spaces():
    assert text.clean("Ibuprofen Tablets IP 200 mg") == "Ibuprofen Tablets 200 mg"
    assert text.clean("Olmesartan 20mg U.S.P. RS") == "Olmesartan 20mg"
    assert "α" in text.clean("α-β Arteether Tablets")
    assert text.folded("STRASSE ß") == "strasse ss"


def test_numbers():
    assert [text.number_text(x) for x in (10.0, 0.5, 666.6666667, 1e-5, 1234567.5, 0.0000123456789)] == ["10", "0.5", "666.667", "0.00001", "1234567.5", "0.0000123457"]


FORMS = {
    "TABLET": ("tablet", "tablet"), "CAPS": ("capsule", "capsule"), "Injection": ("injection", "injectable"), "INFUSION": ("infusion", "injectable"), "ORAL LIQUID": ("solution", "liquid"), "DRY SYRUP": ("dry_syrup", "liquid"),
    "INHALER": ("inhaler", "inhalation"), "EYE DROPS": ("eye_drops", "eye_drops"), "EAR DROPS": ("ear_drops", "ear_drops"), "GEL": ("gel", "topical"), "MODIFIED RELEASE CAPSULE": ("capsule", "capsule"),
    "EFFERVESCENT/ DISPERSIBLE/\nENTERIC COATED TABLET": ("tablet", "tablet"), "NASAL SPRAY": ("nasal_spray", "inhalation"), "VACCINE": ("vaccine", "vaccine"), "Weird Thing": ("weird thing", "weird thing"), None: ("unknown", "unknown"),
}
PACKS = {
    "10's": ("count", 10.0), "170 ml Bottle": ("volume_ml", 170.0), "Vial": ("vial", 1.0), "10 ml Vial": ("volume_ml", 10.0), "200 MDI": ("dose_count", 200.0), "70 MD": ("dose_count", 70.0), "1 Sachet": ("count", 1.0),
    "5 gm Tube": ("weight_g", 5.0), "5 ml Amp.": ("volume_ml", 5.0), "1’s in Mono Carton": ("count", 1.0), "60 s in container": ("count", 60.0), "1kg Screw-Cap jar with scoop": ("weight_g", 1000.0), "1's Tin 250g": ("weight_g", 250.0),
    "60 doses in MDI inhaler": ("dose_count", 60.0), "100 Ear Buds": ("count", 100.0), "Pack of 4 Sanitary Napkins": ("count", 4.0), "Three in Mono-Pack": ("count", 3.0), "Pair in Mono-Pack": ("count", 2.0), "3 x 10 's": ("count", 30.0),
    "Combipack of 6 Tablets in Mono Carton": ("count", 6.0), "30 capsules and 1 inhaler": (None, None), "KIT": (None, None), "Screw-cap plastic container": (None, None), "2 cm X 3 m in Monopack": (None, None), None: (None, None), " ": (None, None),
}
QUALIFIERS = {
    "₹ 0.28(1 Tablet)": (0.28, "tablet", 1.0, None, None, None), "₹ 2.55(Per Dose)": (2.55, "dose", None, None, None, None), "₹ 81.87(1000ml Glass)": (81.87, "pack", None, 1000.0, "glass", None),
    "₹ 28.70(250ml Non-Glass)": (28.7, "pack", None, 250.0, "non_glass", None), "₹ 58.78(Each Pack (500 ml))": (58.78, "pack", 1.0, 500.0, None, None), "₹ 2.15(1 ML (10 ML & more pack))": (2.15, "ml", 1.0, None, None, "10 ML & more pack"),
    "₹ 9(1 ML)( Pack)": (9.0, "ml", 1.0, None, None, None), "₹ 9(2 ML Pack)(1 ML Pack)": (9.0, "ml", 1.0, 2.0, None, None), "₹ 9(Each 1000 ml pack in a bag)": (9.0, "pack", 1.0, 1000.0, None, None),
    "₹ 9(Per Dual chamber bag of 1 l)": (9.0, "dual_chamber_bag", None, None, None, None), "₹ 9(10 Suppositories)": (9.0, "suppository", 10.0, None, None, None), "₹ 9(2 g)": (9.0, "gm", 2.0, None, None, None),
    "₹ 9(1 GM or 1 ML)": (9.0, "gm_or_ml", 1.0, None, None, None), "₹ 9(by weight)": (9.0, None, None, None, None, None), "₹ 9(1 Tablet) each": (9.0, None, None, None, None, None), "₹ 9(Pack)": (9.0, None, None, None, None, None), "free": (None,) * 6,
}


def _column(spark, cases, make, first=lambda c: c):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(cases)], "i int, raw string")
    rows = rows.select("i", first(F.col("raw")).alias("raw"))
    return [r["x"] for r in rows.select("i", make(F.col("raw")).alias("x")).orderBy("i").collect()]


def test_forms(spark):
    got = _column(spark, FORMS, lambda c: F.struct(forms.canonical_form(c), forms.form_family(forms.canonical_form(c))), text.fold_text)
    assert [tuple(x) for x in got] == list(FORMS.values())


def test_packs(spark):
    assert [(x["kind"], x["value"]) for x in _column(spark, PACKS, packs.parse_pack)] == list(PACKS.values())


def test_price_cells(spark):
    def make(c):
        p = qualifiers.price_and_qualifier(c)
        return F.struct(p["price"], qualifiers.parse_qualifier(p["qualifier"])["unit_type"], *(qualifiers.parse_qualifier(p["qualifier"])[f] for f in ("unit_count", "pack_volume_ml", "container", "pack_condition_raw")))

    assert [tuple(x) for x in _column(spark, QUALIFIERS, make)] == list(QUALIFIERS.values())


def test_modifiers(spark):
    cases = {"MODIFIED RELEASE TABLET": ["modified_release"], "Sustained-Release": ["sustained_release"], "Enteric Coating dispersible": ["dispersible", "enteric_coated"], "Plain": [], "x (CR)": ["controlled_release"]}
    assert _column(spark, cases, forms.modifiers) == list(cases.values())


def test_form_strength_split(spark):
    cases = {
        "Tablet 300 mg": ("Tablet", "300 mg"), "Injection --": ("Injection", None), "CONDOM": ("CONDOM", None), "Nasal Spray 50 MCG": ("Nasal Spray", "50 MCG"), "Effervescent/\nEnteric Tablet 100 mg": ("Effervescent/\nEnteric Tablet", "100 mg"),
        "300 mg": (None, "300 mg"), "  ": (None, None), "": (None, None), "Vit B12 Tablet 5 mg": ("Vit B12 Tablet", "5 mg"),
    }
    assert [tuple(x) for x in _column(spark, cases, forms.form_strength)] == list(cases.values())


ALIASES = {
    "acetylsalicylic acid": "aspirin", "Metformin Hydrochloride": "metformin", "s(-) amlodipine": "amlodipine", "levo-thyroxine": "levothyroxine", "medroxyprogesteroneacetate": "medroxyprogesterone acetate", "amlodipine besilate": "amlodipine",
    "formoterol fumarate dihydrate": "formoterol", "calcium phosphate": "calcium phosphate", "hydrochlorothiazide": "hydrochlorothiazide", "sodium valproate": "sodium valproate", "sodium chloride": "sodium chloride",
}


def test_aliases(spark):
    assert _column(spark, ALIASES, molecules.resolve_alias, lambda c: molecules.tidy_molecule(text.fold_text(c))) == list(ALIASES.values())


def test_query_alias_agrees_with_the_column():
    from pricebridge.plans.serve import alias_of

    assert {k: alias_of(text.folded(k)) or text.folded(k) for k in ALIASES if "(-)" not in k} == {k: v for k, v in ALIASES.items() if "(-)" not in k}


def test_formulation_split(spark):
    cases = {
        ("Glucose (A) +\nSodium Chloride (B)", None): ["Glucose", "Sodium Chloride"], ("CO-TRIMOXAZOLE (SULPHAMETHOXAZOLE(A)+TRIMETHOPRIM(B)]", None): ["SULPHAMETHOXAZOLE", "TRIMETHOPRIM"],
        ("Artesunate (A) + Sulphadoxine -Pyrimethamine (B)", 3): ["Artesunate", "Sulphadoxine", "Pyrimethamine"], ("AMPHOTERICIN B - LIPOSOMAL", 1): ["AMPHOTERICIN B - LIPOSOMAL"],
        ("ASCORBIC ACID (VITAMIN C)", None): ["ASCORBIC ACID"], ("PHYTOMENADIONE (VITAMINK1)10 MG", None): ["PHYTOMENADIONE"], ("Lignocaine (A)+Adrenaline (B)", None): ["Lignocaine", "Adrenaline"],
    }
    rows = spark.createDataFrame([(i, t, n) for i, (t, n) in enumerate(cases)], "i int, raw string, n int")
    rows = rows.select("i", "n", text.clean_text(F.col("raw")).alias("clean"))
    got = rows.select("i", molecules.split_formulation(F.col("clean"), F.col("n")).alias("x")).orderBy("i").collect()
    assert [r["x"] for r in got] == list(cases.values())


NAMES = {
    "Ibuprofen Tablets IP 200 mg": (["Ibuprofen"], ["200mg"], "Tablets", set()),
    "Aceclofenac 100mg and Paracetamol 325mg Tablets": (["Aceclofenac", "Paracetamol"], ["100mg", "325mg"], "Tablets", set()),
    "Metformin Hydrochloride Sustained Release Tablets IP 1000 mg": (["Metformin Hydrochloride"], ["1000mg"], "Tablets", {"sustained_release"}),
    "Paracetamol Paediatric Oral Suspension IP 125 mg per 5 ml": (["Paracetamol"], ["25mg/ml"], "Oral Suspension", set()),
    "Rabeprazole 20mg (Enteric Coated) and Domperidone 30mg (Sustained Release) Capsules": (["Rabeprazole", "Domperidone"], ["20mg", "30mg"], "Capsules", {"enteric_coated", "sustained_release"}),
    "Formoterol 6mcg and Budesonide 200mcg Rotacaps": (["Formoterol", "Budesonide"], ["0.006mg", "0.2mg"], "Rotacaps", set()),
    "Combipack of Mifepristone Tablets IP 200mg  (1 Tablet) & Misoprostol Tablets IP 200mcg (4 Tablets)": (["Mifepristone", "Misoprostol"], ["200mg", "0.2mg"], "Tablets", set()),
    "Lignocaine and Adrenaline Injection IP (2%w/v and 1:80000)": (["Lignocaine", "Adrenaline"], ["2%wv", None], "Injection", set()),
    "Cefoperazone Injection IP 1 g": (["Cefoperazone"], ["1000mg"], "Injection", set()),
    "Olmesartan 20mg, Amlodipine 5mg and Hydrochlorothiazide 12.5mg Tablets": (["Olmesartan", "Amlodipine", "Hydrochlorothiazide"], ["20mg", "5mg", "12.5mg"], "Tablets", set()),
    "Aspirin Enteric Coated Tablets IP 75mg": (["Aspirin"], ["75mg"], "Tablets", {"enteric_coated"}),
    "Water for Injection amp polypack 5 ml": (["Water for Injection"], [None], "polypack", set()),
    "Janaushadhi Nirmal (Nicotine Polacrilex Chewing Gum 2 mg))": (["Nicotine Polacrilex"], ["2mg"], "Chewing Gum", set()),
    "Co-trimoxazole (Sulphamethoxazole 100mg and Trimethoprim 20mg) Tablets IP": (["Sulphamethoxazole", "Trimethoprim"], ["100mg", "20mg"], "Tablets", set()),
}


@pytest.mark.parametrize(("name", "want"), NAMES.items())
def test_names(name, want):
    got = composition.read_name(name)
    assert got.ok, got.notes
    assert (got.molecules, got.strengths, got.form, got.modifiers) == want


@pytest.mark.parametrize(
    ("name", "why"),
    [("Vitamin B-Complex Tablets (B1 10mg, B2 10mg)", "complex_composition"), ("Menthol (55 mg ± 5.) Cinnamon Capsules", "complex_composition"), ("A1 5mg, Beta 5mg, Gamma 5mg and Delta 5mg Tablets", "complex_composition"), ("Tablets", "unparseable_molecule"), ("Pre Tablets", "unparseable_molecule")],
)
def test_names_beyond_the_grammar(name, why):
    got = composition.read_name(name)
    assert not got.ok and got.reason == why


def test_ratios_lower_confidence():
    assert composition.read_name("Lignocaine and Adrenaline Injection IP (2%w/v and 1:80000)").low_confidence


def test_similarity():
    assert similarity.ratio("amoxycillin", "amoxicillin") == pytest.approx(100 * 20 / 22)
    assert similarity.common("abcbdab", "bdcaba") == 4
    assert similarity.partial("bolt", "red bolt") == 100 and similarity.partial("", "") == 100 and similarity.partial("", "x") == 0


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=8), st.text("abc", max_size=12))
def test_common_is_the_longest_subsequence(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert similarity.common(a, b) == table[-1][-1]
    assert similarity.partial(a, b) == similarity.partial(b, a)


_FEW = st.text("abcd ", max_size=9)


def _subsequence(a, b):
    """Length of the longest common subsequence, by its definition."""
    if not a or not b:
        return 0
    if a[0] == b[0]:
        return 1 + _subsequence(a[1:], b[1:])
    return max(_subsequence(a[1:], b), _subsequence(a, b[1:]))


@settings(max_examples=150, deadline=None)
@given(_FEW, _FEW)
def test_ratio_by_definition(a, b):
    if a or b:
        assert similarity.ratio(a, b) == pytest.approx(200 * _subsequence(a, b) / (len(a) + len(b)))


@settings(max_examples=100, deadline=None)
@given(st.text("abcd", min_size=1, max_size=6), st.text("abcd", min_size=1, max_size=9))
def test_partial_by_all_windows(a, b):
    def best(short, long):
        n = len(short)
        windows = [long[max(0, x) : x + n] for x in range(1 - n, len(long))]
        return max(similarity.ratio(short, w) for w in windows)

    short, long = sorted((a, b), key=len)
    want = best(short, long) if len(short) < len(long) else max(best(a, b), best(b, a))
    assert similarity.partial(a, b) == pytest.approx(want)


def test_length_bound_loses_no_near_pair(spark):
    texts = ["", "a", "ab", "amoxicillin", "amoxycillin", "amoxicillins", "amoxicillin x", "amoxicillin sodium", "é" * 17, "é" * 23, "é" * 24]
    rows = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    got = rows.select("a", "b", similarity.near_lengths(F.col("a"), F.col("b"), 85.0).alias("kept")).collect()
    assert all(r["kept"] for r in got if similarity.ratio(r["a"], r["b"]) >= 85) and not all(r["kept"] for r in got)


def test_marks_in_a_name_are_no_brackets():
    assert composition.read_name("Paracetamol \x007\x00 Tablets 500 mg").form == "Tablets"
