"""Registered queries: names, oracles, and equality with DuckDB on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: The others differ from these only in the columns they show; all are compared each round by the driver.
SAMPLE = [
    "parse_quantity", "parse_money", "parse_unit_price", "parse_month", "prohibited_units", "address_pins", "contact_details", "origins", "compare_keys", "audit_checks",
    "unit_price_at_volume", "display_areas", "rule_7_3_glyphs", "gateway_stats", "list_scans", "delivery_outcomes", "ingest_decisions", "golden_outcomes", "tensor_diff", "marker_scales",
    "quality_gates", "merge_rois", "sign_payloads", "signature_codes", "clean_words", "validate_tokens", "first_wins", "new_scans",
]


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def canonical(rows):
    def one(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return "null"
        return str(round(float(x), 6)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    return sorted(tuple(one(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", SAMPLE)
def test_equals_sql(spark, name):
    found = entry.queries()[name](spark, SF)
    with duckdb.connect() as con:
        for t in TABLES:
            con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
        wanted = con.sql(entry.oracle_sql()[name])
        columns = sorted(found.columns)
        assert columns == sorted(wanted.columns)
        rows = con.execute(f"select {', '.join(columns)} from ({entry.oracle_sql()[name]}) q").fetchall()
    assert canonical(map(tuple, found.select(*columns).collect())) == canonical(rows)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
