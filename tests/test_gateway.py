"""Golden values, delivery, detections, markers, validators, sources and streams."""

import json
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from labelaudit.operators import contract, extract, gateway, geometry, golden
from labelaudit.sources import store, tables
from labelaudit.streaming import jobs


def test_golden_summary(spark):
    fixtures = spark.createDataFrame([("A", "VIOLATION", None), ("B", "PASS", None), ("C", "PASS", None), ("D", "RETRY", None)], "fixture string, verdict string, error string")
    expected = spark.createDataFrame([("A", "13"), ("A", "6(11)"), ("C", "7"), ("D", "7")], "fixture string, rule string")
    checks = spark.createDataFrame([("A", "13", "FAIL"), ("A", "6(11)", "FAIL"), ("B", "7", "PASS")], "fixture string, rule string, status string")
    s = golden.summary(golden.compare(fixtures, expected, checks)).head()
    assert (s["ok"], s["mismatch"], s["capture_retry"], s["rule_tp"], s["rule_fp"], s["rule_fn"]) == (2, 1, 1, 2, 0, 1)
    assert s["rule_precision"] == 1.0 and s["rule_recall"] == pytest.approx(2 / 3)


def test_field_matches(spark):
    want = spark.createDataFrame([("A", "mrp", "₹ 50.00"), ("A", "usp", "x"), ("A", "origin", "India")], "fixture string, field string, raw string")
    got = spark.createDataFrame([("A", "mrp", "MRP Rs. 50.00 only"), ("A", "origin", "China")], "fixture string, field string, raw string")
    assert tuple(golden.field_matches(want, got).head()) == ("A", 1, 1, 1)


def test_delivery_stops_at_the_first_deferral(spark):
    rows = [(f"s{i}", "d", i, "pending", 0) for i in range(5)] + [("x", "e", 0, "pending", 2), ("y", "e", 1, "synced", 0)]
    ledger = spark.createDataFrame(rows, "scan_id string, device string, created int, sync_status string, attempts int")
    responses = spark.createDataFrame([("s0", 200, True), ("s1", 422, False), ("s2", 503, False), ("s3", 200, True), ("x", 200, False)], "scan_id string, http_status int, accepted boolean")
    found = {r["scan_id"]: (r["outcome"], r["attempts"]) for r in gateway.delivered(ledger, responses).collect()}
    assert found == {"s0": ("synced", 1), "s1": ("failed", 1), "s2": ("deferred", 1), "s3": ("untouched", 0), "s4": ("untouched", 0), "x": ("deferred", 3)}


def test_empty_ledger(spark):
    empty = spark.createDataFrame([], "sync_status string, sig_status string, dossier_sha256 string")
    assert tuple(gateway.queue_status(empty).head()) == (0, 0, 0, 0, 0)


def test_ingest_without_trust(spark):
    e = spark.createDataFrame([("a", "scan.v1", "PASS", True, None, "sig", "d", "f"), ("b", "scan.v1", "PASS", True, None, None, None, None)], "scan_id string, kind string, verdict string, has_result boolean, contract_error string, signature string, dossier_sha256 string, cert_fingerprint string")
    store = spark.createDataFrame([], "scan_id string")
    assert {r["scan_id"]: r["http_status"] for r in gateway.ingest_decision(e, store).collect()} == {"a": 503, "b": 200}


def test_markers(spark):
    def square(i, px):
        return (i, 0.0, 0.0, px, 0.0, px, px, 0.0, px, 40.0)

    df = spark.createDataFrame([square("a", 200.0), square("b", 100.0), square("b", 50.0), square("c", 4.0)], "scan_id string, x1 double, y1 double, x2 double, y2 double, x3 double, y3 double, x4 double, y4 double, side_mm double")
    assert {r["scan_id"]: r["mm_per_px"] for r in geometry.marker_scale(df).collect()} == {"a": 0.2, "b": 0.4}


def test_suppression(spark):
    def det(i, cx, score, cls):
        return ("im", i, cx, 0.5, 0.2, 0.2, [score if k == cls else 0.0 for k in range(5)], 1.0, 0.0, 0.0)

    df = spark.createDataFrame([det(0, 0.5, 0.9, 1), det(1, 0.51, 0.8, 1), det(2, 0.51, 0.7, 2), det(3, 0.9, 0.6, 1), det(4, 0.2, 0.2, 1)], "image_id string, anchor int, cx double, cy double, w double, h double, scores array<double>, gain double, pad_x double, pad_y double")
    found = sorted((r["label"], round(r["score"], 2)) for r in geometry.suppress_detections(df).collect())
    assert found == [("PDP", 0.6), ("PDP", 0.9), ("PRICE", 0.7)]


def test_roi_boxes(spark):
    box = "array<struct<label:string,score:double,x:double,y:double,w:double,h:double>>"
    rows = [("ok", 100, 100, [("PDP", 0.5, -5.0, 10.0, 50.0, 200.0), ("BOP", 0.5, 150.0, 0.0, 5.0, 5.0)]), ("label", 100, 100, [("X", 0.5, 0.0, 0.0, 1.0, 1.0)]), ("size", 100, 100, [("PDP", 0.5, 0.0, 0.0, 0.0, 1.0)]), ("none", None, None, None)]
    found = {r["scan_id"]: r for r in geometry.validate_roi_boxes(spark.createDataFrame(rows, f"scan_id string, frame_w int, frame_h int, roi_boxes {box}")).collect()}
    assert found["ok"]["error"] is None and [tuple(b) for b in found["ok"]["boxes"]] == [("PDP", 0.5, 0.0, 10.0, 50.0, 90.0)]
    assert (found["label"]["error"], found["size"]["error"], found["none"]["error"]) == ("unknown label", "non-positive size", None)


def test_token_contract(spark):
    df = spark.createDataFrame([("a", 0, "x", 1, 1, 1, 1, 0.5, "mlkit"), ("a", 1, " ", -1, 1, 1, 0, 2.0, "other")], "scan_id string, tok int, text string, x int, y int, w int, h int, conf double, engine string")
    found = contract.validate_tokens(df)
    assert {r["key"] for r in found.collect()} == {"a/1"} and found.count() == 5
    assert contract.first_problem(found).head()["path"] == "text"


def request(scan, *tokens):
    return json.dumps({"scan_id": scan, "tokens": [{"text": t, "bbox": b} for t, b in tokens]})


LABEL = [("Net Quantity: 200 gms", [10, 10, 200, 20]), ("MRP Rs 50.00 incl. of all taxes", [10, 50, 300, 20]), ("Noodles", [10, 100, 200, 50])]


def test_streams(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.json").write_text(request("s1", *LABEL) + "\n")
    jobs.result_stream(tables.read_requests(spark, str(source), stream=True), str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination()
    found = spark.read.json(str(tmp_path / "out")).select(F.explode("checks").alias("c")).select("c.*")
    assert {r["rule"] for r in found.where("status = 'FAIL'").collect()} >= {"13", "6(1)(c)"}
    (source / "b.json").write_text(request("s2", *LABEL) + "\n" + request("s1", *LABEL) + "\n")
    for _ in range(2):  # a second run finds nothing new
        stream = tables.read_requests(spark, str(source), stream=True).select("scan_id", F.lit(1).alias("received"))
        jobs.ingest_stream(stream, str(tmp_path / "store"), str(tmp_path / f"c2-{_}")).awaitTermination()
    assert sorted(r["scan_id"] for r in store.read_store(spark, str(tmp_path / "store")).collect()) == ["s1", "s2"]
    rows = spark.readStream.schema("scan_id string, verdict string, sig_status string").json(str(source)).withColumn("verdict", F.lit("PASS"))
    assert jobs.run_to_table(jobs.live_stats(rows), "live", str(tmp_path / "c3")).head()["scans"] == 3


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "gt.json").write_text(json.dumps({"f1": {"shape": "pouch", "dims_cm": {"height": 10}, "fields": {"mrp": "Rs 5"}, "expect_fail": ["13"]}}))
    truth, fields, expected = tables.read_ground_truth(spark, str(tmp_path / "gt.json"))
    assert fields.head()["raw"] == "Rs 5" and expected.head()["rule"] == "13"
    assert [r["problem"] for r in golden.validate_truth(truth).collect()] == ["flat shapes want height and width"]
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "s1.png").write_bytes(b"pixels")
    digests = tables.image_digests(spark, str(tmp_path / "img"))
    declared = spark.createDataFrame([("s1", "AB")], "scan_id string, image_sha256 string")
    assert tables.digest_mismatches(declared, digests).count() == 1
    rows = spark.createDataFrame([("a", "PASS"), ("b", "RETRY"), ("a", "PASS")], "scan_id string, verdict string")
    for _ in range(2):
        tables.append_ledger(rows, str(tmp_path / "ledger"))
    assert [r["scan_id"] for r in spark.read.parquet(str(tmp_path / "ledger")).collect()] == ["a"]
    bad = tmp_path / "bad.json"
    bad.write_text('{"scan_id": 5, "tokens": "x"\n')
    assert tables.read_requests(spark, str(bad)).head()["_corrupt"] is not None


def test_signature_reaches_the_result_document(spark):
    result = "struct<verdict:string,dossier:struct<sha256:string,signed:boolean,signature:string,cert_pem:string,sig_status:string>>"
    dossier = ("d", False, None, None, "pending")
    rows = [("a", None, "pending", None, ("VIOLATION", dossier)), ("b", None, "pending", None, ("PASS", None)), ("c", None, "pending", None, None), ("d", None, "pending", None, ("VIOLATION", dossier))]
    ledger = spark.createDataFrame(rows, f"scan_id string, signature string, sig_status string, cert_pem string, result {result}")
    accepted = spark.createDataFrame([(k, f"s{k}", "pem") for k in "abc"], "scan_id string, signature string, cert_pem string")
    found = {r["scan_id"]: r for r in gateway.apply_signatures(ledger, accepted).collect()}
    assert found["a"]["result"]["dossier"].asDict() == {"sha256": "d", "signed": True, "signature": "sa", "cert_pem": "pem", "sig_status": "signed"}
    assert [found[k]["sig_status"] for k in "abcd"] == ["signed", "signed", "signed", "pending"]
    assert found["b"]["result"]["dossier"] is None and found["b"]["result"]["verdict"] == "PASS" and found["c"]["result"] is None
    assert found["d"]["result"]["dossier"]["sig_status"] == "pending" and found["d"]["signature"] is None


def test_decoded_fields(spark):
    schema = "scan_id string, field string, raw string, value_dec decimal(14,4), value_date date, unit string, conf double"
    rows = [("a", "mrp", "MRP 100", Decimal("100.0000"), None, None, 0.905), ("a", "net_qty", "1.50 kg", Decimal("1.5000"), None, "kg", 1.0), ("a", "mfg_date", "Aug 2026", None, date(2026, 8, 1), None, 0.5), ("a", "origin", "India", None, None, None, 0.5)]
    found = extract.decoded_fields(spark.createDataFrame(rows, schema)).orderBy("ord").collect()
    assert [(r["field"], r["value"]) for r in found] == [("net_qty", "1.5 kg"), ("mrp", "100"), ("mfg_date", "2026-08-01"), ("origin", "-")]
