"""Parsers at their boundaries."""

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from labelaudit.functions import text as T


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(T.squash(F.col("t")))).head()[0]


@pytest.mark.parametrize(("text", "value", "unit"), [("Net Wt. 1,25,000 g", "125000", "g"), ("200gms", "200", "g"), ("1.5 Ltr", "1.5", "L"), ("6 pcs", "6", "piece"), ("100 cm²", "100", "cm2"), ("12 N", "12", "N"), ("no number", None, None)])
def test_quantity(spark, text, value, unit):
    q = one(spark, text, T.quantity)
    assert (q and (q["value"], q["unit"])) == (value and (Decimal(value), unit))


@pytest.mark.parametrize(("text", "strict", "lenient"), [("MRP Rs. 1,499.00", "1499", "1499"), ("M.R.P 9 50.00 incl", None, "50"), ("MRP 45 USP 0.25", None, "45"), ("₹20", "20", "20"), ("hours 20", None, None), ("MRP soon", None, None)])
def test_money(spark, text, strict, lenient):
    assert one(spark, text, T.money) == (strict and Decimal(strict)) and one(spark, text, T.money_lenient) == (lenient and Decimal(lenient))


@pytest.mark.parametrize(("text", "when"), [("15/08/2025", (2025, 8)), ("03/13/2026", (2026, 3)), ("03/2026", (2026, 3)), ("AUG 2026", (2026, 8)), ("March-2025", (2025, 3)), ("2026/08", None), ("13/2026", None), ("AUG 1926", None), ("Batch 1234 AUG 2026", None)])
def test_month(spark, text, when):
    assert one(spark, text, T.month) == (when and datetime.date(*when, 1))


@pytest.mark.parametrize(("text", "hits"), [("500 gms", [("gms", 4, 7, "g")]), ("5 cu.cm and 2 kgs", [("cu.cm", 2, 7, "mL"), ("kgs", 14, 17, "kg")]), ("kgsx 5", []), ("500 g", [])])
def test_prohibited(spark, text, hits):
    assert [tuple(h) for h in one(spark, text, T.prohibited_hits)] == hits


@pytest.mark.parametrize(("text", "pin"), [("Goa 403001", "403001"), ("Pune 411 001", "411001"), ("PIN: 560-001", "560001"), ("call 1800-123-4567", None), ("012345", None)])
def test_pin(spark, text, pin):
    assert one(spark, text, T.pin) == pin


@pytest.mark.parametrize(("text", "country", "vague"), [("Made in India", "India", None), ("Made in PRC", None, "PRC"), ("Product of South Korea", "South Korea", None), ("Origin: Mars", None, None)])
def test_origin(spark, text, country, vague):
    assert one(spark, text, T.origin_country) == country and one(spark, text, T.origin_ambiguous) == vague


def test_normal_forms(spark):
    df = spark.createDataFrame([("é x",), ("plain",), (None,)], "t string")
    assert sorted(r[0] or "" for r in T.nfc(df, "t").collect()) == ["", "plain", "é x"]
    assert one(spark, "  a\t\n b² ", lambda c: c) == "a b2" and one(spark, " \n", lambda c: c) is None
    assert one(spark, "₹ 50.00, Rs. 5!", T.compare_key) == "rs 50 00 rs 5"
