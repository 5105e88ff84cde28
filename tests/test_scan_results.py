"""Requests to whole results, as a stream, against documents written out by hand."""

import json
import unicodedata

import pytest

from labelaudit.operators import contract
from labelaudit.plans import scans
from labelaudit.sources import tables
from labelaudit.streaming import jobs


def token(text, y, x=20, w=300, **more):
    return {"text": text, "bbox": [x, y, w, 24], "conf": 0.9, "engine": "mlkit", **more}


LABEL = [token(unicodedata.normalize("NFD", "Café Crème"), 10), token("Net Quantity: 500 g", 60), token("MRP Rs. 90.00 inclusive of all taxes", 100)]
BASE = {"schema_version": 1, "captured_utc": "2026-01-01T00:00:00Z"}
REQUESTS = [
    {**BASE, "scan_id": "whole", "tokens": LABEL, "geometry": {"mm_per_px": 0.2}, "shape_hint": "pouch", "device": "d1", "options": {"package_height_cm": 10.0, "package_width_cm": 8.0},
     "roi_boxes": [{"label": "PDP", "score": 0.5, "x": 90.0, "y": 1.0, "w": 50.0, "h": 5.0}], "roi_frame": {"w": 100, "h": 100}, "glyphs": [{"glyph": "5", "height_mm": 3.0, "width_mm": 0.5}]},
    {**BASE, "scan_id": "refused", "tokens": LABEL, "quality": {"ok": False, "glare_pct": 9.0}, "geometry": {"mm_per_px": 0.2}},
    {**BASE, "scan_id": "name", "tokens": [token("Plain Biscuits", 10)]},
    {**BASE, "scan_id": "bad", "tokens": []},
]


@pytest.fixture(scope="module")
def documents(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("results")
    (folder / "in").mkdir()
    (folder / "in" / "a.json").write_text("\n".join(json.dumps(r) for r in REQUESTS))
    stream = tables.read_requests(spark, str(folder / "in"), stream=True)
    jobs.result_stream(stream, str(folder / "out"), str(folder / "log")).awaitTermination()
    schema = ", ".join(f"{k} {kind}" for k, kind in scans.RESULT.items())
    return spark.read.schema(schema).json(str(folder / "out" / "batch=0")).cache()


def test_every_request_has_one_document(documents):
    found = {r["scan_id"]: r for r in documents.collect()}
    assert sorted(found) == ["bad", "name", "refused", "whole"] and documents.count() == 4
    assert len(documents.columns) == 17
    assert {k: r["verdict"] for k, r in found.items()} == {"bad": "RETRY", "name": "RETRY", "refused": "RETRY", "whole": "VIOLATION"}
    assert found["bad"]["error"]["code"] == "BAD_REQUEST" and found["whole"]["error"] is None
    assert found["refused"]["quality"]["prompts"] == [scans.REFUSED] and found["refused"]["quality"]["glare_pct"] == 9.0
    assert found["refused"]["geometry"] is None and found["refused"]["checks"] == [] and found["refused"]["ocr"]["tokens"] == []
    # a name alone is to be taken again, whatever its findings
    assert len(found["name"]["quality"]["prompts"]) == 1 and found["name"]["summary"]["fail"] > 0


def test_the_whole_document(documents):
    r = documents.where("scan_id = 'whole'").head().asDict(recursive=True)
    assert r["captured_utc"] == "2026-01-01T00:00:00.000Z" and r["meta"]["device"] == "d1"
    assert r["geometry"] == {"shape": "pouch", "shape_detected": None, "mm_per_px": 0.2, "pda_cm2": 80.0, "pda_method": "inspector-dims", "rois": [{"roi": "PDP", "bbox": [90, 1, 10, 5], "conf": 0.5}]}
    assert r["ocr"]["engines_used"] == ["mlkit"] and [t["bbox"][1] for t in r["ocr"]["tokens"]] == [10, 60, 100]
    # texts are composed before anything reads them
    assert r["fields"]["product_name"]["raw"] == "Café Crème" == r["ocr"]["tokens"][0]["text"]
    assert (r["fields"]["net_qty"]["value"], r["fields"]["net_qty"]["unit"], r["fields"]["mrp"]["value"]) == ("500", "g", "90")
    checks = {(c["rule"], c["status"]): c for c in r["checks"]}
    assert [c["rule"] for c in r["checks"]] == ["13", "6(1)(c)", "6(1)(e)", "6(11)", "6(1)(d)", "6(1)(a)", "6(1)(aa)", "6(1)(n)", "6(1)(b)", "7", "7", "7(3)"]
    assert checks["6(1)(e)", "PASS"]["evidence_bbox"] == r["fields"]["mrp"]["bbox"] == [20, 100, 300, 24]
    assert checks["6(1)(d)", "FAIL"]["evidence_bbox"] is None and ("7(3)", "FAIL") in checks
    assert all(c["citation"] and c["plain"] for c in r["checks"]) and r["exemption"]["exempt"] is False
    assert r["summary"]["total"] == 12 == sum(r["summary"][k] for k in ("pass", "fail", "na"))


def test_documents_keep_the_contract(documents):
    assert contract.validate_documents(documents).count() == 0
    broken = documents.withColumn("summary", documents["summary"].withField("fail", documents["summary.fail"] + 1)).where("scan_id = 'whole'")
    assert [r["path"] for r in contract.validate_documents(broken).collect()] == ["summary.fail"]


def read(spark, tmp_path, lines):
    (tmp_path / "r.json").write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))
    return scans.scan_results(tables.read_requests(spark, str(tmp_path / "r.json")))


def test_missing_and_repeated_ids(spark, tmp_path):
    first = {**BASE, "scan_id": "a", "tokens": LABEL}
    later = {**first, "captured_utc": "2026-02-01T00:00:00Z", "tokens": LABEL[:2]}
    docs = read(spark, tmp_path, [later, first, first, {**BASE, "tokens": LABEL}, {**BASE, "scan_id": "", "tokens": LABEL}, "{not json"]).cache()
    found = sorted((r["scan_id"], r["verdict"], r["error"]["message"] if r["error"] else None, len(r["ocr"]["tokens"])) for r in docs.collect())
    assert found == [("", "RETRY", "not a request of the known form", 0), ("", "RETRY", "scan_id must be given", 0), ("", "RETRY", "scan_id must be given", 0), ("a", "VIOLATION", None, 3)]
    assert contract.validate_documents(docs).count() == 0


def test_a_message_delivered_twice_does_not_stop_the_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps({**BASE, "scan_id": "a", "tokens": LABEL}) for _ in range(3)))
    jobs.result_stream(tables.read_requests(spark, str(tmp_path / "in"), stream=True), str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    assert [r["scan_id"] for r in spark.read.json(str(tmp_path / "out")).collect()] == ["a"]


def test_regions_of_the_request_follow_detected_ones(spark, tmp_path):
    request = {**REQUESTS[0], "geometry": {"rois": [{"roi": "PRICE", "bbox": [1, 2, 3, 4], "conf": 0.4}, {"roi": "PDP", "bbox": [5, 6, 7, 8], "conf": 0.9}]}}
    rois = read(spark, tmp_path, [request]).head()["geometry"]["rois"]
    assert [(r["roi"], r["bbox"], r["conf"]) for r in rois] == [("PDP", [90, 1, 10, 5], 0.5), ("PRICE", [1, 2, 3, 4], 0.4)]


def test_nothing_is_shuffled_between_requests_and_documents(spark, tmp_path):
    docs = read(spark, tmp_path, REQUESTS)
    plan = docs._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "Window" not in plan


def test_no_requests_no_documents(spark, tmp_path):
    assert read(spark, tmp_path, []).count() == 0
