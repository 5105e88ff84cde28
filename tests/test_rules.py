"""The rule engine on label rows with known verdicts."""

import pytest
from pyspark.sql import functions as F

from labelaudit.operators import rules

GOOD = {
    "product_name": "Instant Masala Noodles", "net_qty": "Net Quantity: 70 g", "mrp": "MRP ₹ 14.00 (incl. of all taxes)", "usp": "Unit Sale Price ₹ 0.20 / g",
    "mfg_date": "MFG 08/2026", "mfg_address": "Mfd. by: Tasty Foods Ltd., Plot 21, Goa 403001", "origin": "Made in India",
    "consumer_care": "Consumer Care: Tasty Foods, Mumbai 400050, Tel: 1800-123-4567, care@tasty.in",
}
NULLS = {k: None for k in GOOD}
CASES = {
    "good": ({}, set(), "PASS"),
    "gms": ({"net_qty": "Net Quantity: 200 gms"}, {"13", "6(1)(c)", "6(11)"}, "VIOLATION"),
    "no tax": ({"mrp": "MRP ₹ 14.00"}, {"6(1)(e)"}, "VIOLATION"),
    "wrong price": ({"usp": "Unit Sale Price ₹ 0.35 / g"}, {"6(11)"}, "VIOLATION"),
    "no mrp": ({"mrp": None}, {"6(1)(e)"}, "VIOLATION"),
    "small": ({"net_qty": "Net Quantity: 8 g"}, set(), "PASS"),
    "institutional": ({"institutional": True}, set(), "PASS"),
    "nothing": (NULLS, set(), "RETRY"),
    "low letters": ({"pda_cm2": 100.0, "height_net_qty": 1.8, "height_mrp": 1.2}, {"7"}, "VIOLATION"),
    "prc": ({"origin": "Made in PRC"}, {"6(1)(aa)"}, "VIOLATION"),
    "imported": ({"origin": None, "mfg_address": "Imported by: Global Foods, Mumbai 400001"}, {"6(1)(aa)"}, "VIOLATION"),
    "first form decides": ({"mfg_date": "Batch 1234 AUG 2026"}, {"6(1)(d)"}, "VIOLATION"),
    "wrong date": ({"mfg_date": "2026/08"}, {"6(1)(d)"}, "VIOLATION"),
    "packer": ({"mfg_address": "Packed by: Box Co, Delhi 110001"}, {"6(1)(a)"}, "VIOLATION"),
    "no pin": ({"mfg_address": "Mfd. by: Tasty Foods, Goa"}, {"6(1)(a)"}, "VIOLATION"),
    "no email": ({"consumer_care": "Helpline 1800 123 4567, Pune 411 001"}, {"6(1)(n)"}, "VIOLATION"),
    "as above": ({"consumer_care": "Call 9876543210 or care(at)tasty.in, address as above"}, set(), "PASS"),
    "no name": ({"product_name": "12"}, {"6(1)(b)"}, "VIOLATION"),
}
SCHEMA = "scan_id string, " + ", ".join(f"{c} string" for c in GOOD) + ", institutional boolean, pda_cm2 double, height_net_qty double, height_mrp double"


@pytest.fixture(scope="module")
def audited(spark):
    names = ["institutional", "pda_cm2", "height_net_qty", "height_mrp"]
    rows = []
    for key, (change, _, _) in CASES.items():
        row = {"scan_id": key, **GOOD, **{n: None for n in names}, **change}
        rows.append(tuple(row[c.split()[0]] for c in SCHEMA.split(", ")))
    labels = spark.createDataFrame(rows, SCHEMA)
    found = rules.audit(labels)
    checks = found.collect()
    verdicts = {r["scan_id"]: r["verdict"] for r in rules.verdicts(found, labels).collect()}
    return checks, verdicts


@pytest.mark.parametrize("key", list(CASES))
def test_findings(audited, key):
    checks, verdicts = audited
    assert {c["rule"] for c in checks if c["scan_id"] == key and c["status"] == "FAIL"} == CASES[key][1]
    assert verdicts[key] == CASES[key][2]


def test_order_and_exemptions(audited):
    checks, _ = audited
    good = [c["rule"] for c in sorted((c for c in checks if c["scan_id"] == "good"), key=lambda c: c["ord"])]
    assert good == ["13", "6(1)(c)", "6(1)(e)", "6(11)", "6(1)(d)", "6(1)(a)", "6(1)(aa)", "6(1)(n)", "6(1)(b)", "7"]
    assert [(c["rule"], c["status"]) for c in checks if c["scan_id"] == "small"] == [("26", "NA")]
    assert [(c["rule"], c["status"]) for c in checks if c["scan_id"] == "no mrp" and c["rule"] == "6(11)"] == [("6(11)", "NA")]
    assert [c["status"] for c in checks if c["scan_id"] == "low letters" and c["rule"] == "7"].count("FAIL") == 1
    assert next(c["message"] for c in checks if c["scan_id"] == "good" and c["rule"] == "6(1)(e)") == "MRP Rs 14.00 inclusive of all taxes."


UNIT_PRICES = [
    # mrp, quantity, unit, declared, declared unit -> required unit, expected, exempt, ok
    ("50", "200", "g", "0.25", "g", "g", "0.25", False, True), ("50", "200", "g", "0.24", "g", "g", "0.25", False, True), ("50", "200", "g", "0.23", "g", "g", "0.25", False, False),
    ("75", "1.5", "kg", "50.00", "kg", "kg", "50.00", False, True), ("30", "750", "ml", "0.04", "ml", "ml", "0.04", False, True), ("10", "500", "mg", "20", "g", "g", "20.00", False, True),
    ("60", "6", "piece", "10", "pcs", "piece", "10.00", False, False), ("60", "6", "piece", "10", "piece", "piece", "10.00", False, True), ("10", "35", "g", "0.29", "g", "g", "0.29", False, True),
    ("99", "1", "kg", None, None, None, "99.00", True, True), ("99", "1000", "g", None, None, None, "99.00", True, True), ("99", "1", "piece", None, None, None, "99.00", True, True),
    ("50", "200", "g", None, None, "g", "0.25", False, False), ("50", "200", "g", "0.25", "kg", "g", "0.25", False, False), ("50", "2", "N", "25", "n", None, None, False, None),
    ("50", "40", "cm", "1.25", "cm", "cm", "1.25", False, True), ("50", "0", "g", "1", "g", None, None, False, None),
]


def test_unit_prices(spark):
    df = spark.createDataFrame([(i, *r[:5]) for i, r in enumerate(UNIT_PRICES)], "i int, mrp string, q string, unit string, p string, pu string")
    dec = lambda c: F.col(c).cast("decimal(14,4)")
    out = df.select("i", rules.unit_price_result(dec("mrp"), dec("q"), F.col("unit"), dec("p"), F.col("pu")).alias("r")).orderBy("i").collect()
    for (_, r), case in zip(out, UNIT_PRICES, strict=True):
        assert (r["required_unit"], None if r["expected"] is None else str(r["expected"]), r["exempt"], r["ok"]) == case[5:], case


def test_glyphs(spark):
    df = spark.createDataFrame([("a", 0, "M", 3.0, 0.5), ("a", 1, "5", 3.0, 1.0), ("b", 0, "i", 3.0, 0.1)], "scan_id string, g int, glyph string, height_mm double, width_mm double")
    found = {r["scan_id"]: r["glyph_check"] for r in rules.glyph_checks(df).collect()}
    assert (found["a"]["status"], found["b"]["status"]) == ("FAIL", "PASS") and "'M' 0.50x3.00 mm" in found["a"]["message"]


def test_font_bands(spark):
    areas = [(50.0, 1.0), (50.1, 1.5), (100.0, 1.5), (500.0, 2.5), (2500.0, 4.0), (2500.1, 6.0), (0.0, None)]
    df = spark.createDataFrame([(a,) for a, _ in areas], "a double")
    assert [r[0] for r in df.select(rules.least_height(F.col("a"), F.lit(False))).collect()] == [h for _, h in areas]
