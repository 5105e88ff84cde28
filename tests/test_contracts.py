"""Contracts, citations, envelopes: against the same in SQL and against small tables."""

import duckdb
import pytest

from labelaudit.operators import geometry, rules
from labelaudit.plans import queries
from labelaudit.sources import tables

SF = "/root/testdata/sf0.001"
NAMES = ["cited_findings", "sync_envelopes", "validate_signature_responses", "validate_sync_summaries", "request_rejects", "valid_requests", "merge_rois", "dataset_stats", "get_scan", "request_faults", "result_faults"]


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in ("part", "events", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_same_in_sql(spark, sql, name):
    found = queries.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    wanted = sql.sql(queries.ORACLES[name])
    assert sorted(wanted.columns) == columns
    rows = sorted(map(repr, (tuple(r[c] for c in columns) for r in found.collect())))
    assert rows and rows == sorted(map(repr, wanted.select(*[f'"{c}"' for c in columns]).fetchall()))


def test_scans_to_be_taken_again_do_not_count(spark):
    checks = spark.createDataFrame([(1, "13", "FAIL"), (1, "7", "NA"), (2, "13", "FAIL"), (2, "6(11)", "FAIL"), (3, "13", "PASS")], "scan_id long, rule string, status string")
    scans = spark.createDataFrame([(1, "VIOLATION"), (2, "RETRY"), (3, "PASS")], "scan_id long, verdict string")
    assert [tuple(r) for r in rules.top_rules(checks, scans=scans).collect()] == [("13", 1)]
    assert [tuple(r) for r in rules.top_rules(checks).collect()] == [("13", 2), ("6(11)", 1)]


def test_first_of_an_id_is_stored(spark, tmp_path):
    rows = spark.createDataFrame([("a", "PASS", 3), ("a", "VIOLATION", 1), ("b", "RETRY", 0), ("a", "PASS", 2)], "scan_id string, verdict string, received int")
    for _ in range(2):
        tables.append_ledger(rows, str(tmp_path / "ledger"))
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "ledger")).collect()] == [("a", "VIOLATION", 1)]


def test_odd_types_are_rejected(spark, tmp_path):
    from labelaudit.operators import contract

    path = tmp_path / "r.json"
    good = '{"schema_version": 1, "scan_id": "%s", "tokens": [{"text": "MRP", "bbox": [1, 2, 3, 4]}]%s}'
    lines = [good % ("ok", ""), good % ("flag", ', "quality": {"ok": "yes"}'), good % ("opt", ', "options": {"package_height_cm": -1}'), "not json", '{"scan_id": "none"}']
    path.write_text("\n".join(lines))
    valid, rejects = contract.split_requests(tables.read_requests(spark, str(path)).cache())
    assert [r["scan_id"] for r in valid.collect()] == ["ok"]
    found = {(r["scan_id"], r["code"], r["message"]) for r in rejects.collect()}
    form = "not a request of the known form"
    assert found == {("flag", "BAD_REQUEST", form), (None, "BAD_REQUEST", form), ("opt", "BAD_REQUEST", "options.package_height_cm must be positive"), ("none", "BAD_REQUEST", "tokens must be a non-empty list")}
    tables.write_rejects(rejects, str(tmp_path / "rejects"))
    assert spark.read.json(str(tmp_path / "rejects")).where("code = 'BAD_REQUEST'").count() == 4


def test_more_detections_than_allowed(spark):
    boxes = lambda image, n: [(image, "PDP", 0.9, float(k), 0.0, 1.0, 1.0) for k in range(n)]
    schema = "image_id int, label string, score double, x double, y double, w double, h double"
    reference, candidate = spark.createDataFrame(boxes(1, 2) + boxes(2, 2), schema), spark.createDataFrame(boxes(1, 5) + boxes(2, 6) + boxes(3, 4), schema)
    assert sorted(tuple(r) for r in geometry.excess_detections(reference, candidate).collect()) == [(2, 2, 6), (3, 0, 4)]
