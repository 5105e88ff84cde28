"""Laws on raw JSON: one row a fault, of documents that differ from a sound one in one place."""

import copy
import json

import pytest

from labelaudit.operators import shapes

REQUEST = {
    "schema_version": 1, "scan_id": "s", "tokens": [{"text": "MRP Rs 5", "bbox": [1, 2, 30, 9]}, {"text": "x", "bbox": [1, 20, 30, 9], "conf": 1, "engine": "indic", "lang": "hi"}],
    "quality": {"ok": None, "prompts": [], "glare_pct": 0.5, "glare_bbox": None}, "geometry": {"shape": "pouch", "mm_per_px": 1, "pda_cm2": None, "rois": [{"roi": "PDP", "bbox": [0, 0, 5, 5]}]},
    "glyphs": [{"glyph": "5", "height_mm": 2, "width_mm": 0}], "shape_hint": "", "captured_utc": "2026-01-01T00:00:00Z", "gps": {"lat": 12, "lon": 77.5}, "device": {"os": "14"},
    "options": {"institutional": True, "blown": True, "commodity": "biscuits", "package_height_cm": "12.5", "package_width_cm": 8, "package_diameter_cm": "", "marker_side_mm": 40, "cylinder_left_px": 7, "later": [1]}, "later": {},
}
RESULT = {
    "schema_version": 1, "scan_id": "s", "verdict": "VIOLATION", "captured_utc": "2026-01-01T00:00:00.000Z", "completed_utc": "2026-01-01T00:00:00.250Z", "total_ms": 12, "timings_ms": {"s4_ocr": 1.5, "s6_metrology": 0},
    "quality": {"ok": None, "laplacian_var": None, "glare_pct": 0.1, "prompts": [], "glare_bbox": None},
    "geometry": {"shape": "pouch", "shape_detected": None, "mm_per_px": 0.2, "pda_cm2": 100, "pda_method": None, "rois": [{"roi": "PDP", "bbox": [0, 0, 5, 5], "conf": 0.5}]},
    "ocr": {"engines_used": ["mlkit"], "tokens": [{"text": "MRP", "bbox": [1, 2, 3, 4], "conf": 1, "engine": "mlkit", "lang": "en"}]},
    "fields": {"mrp": {"raw": "MRP 14", "value": "14.00", "unit": None, "bbox": [1, 2, 3, 4], "conf": 0.9}},
    "checks": [{"rule": "13", "status": "FAIL", "message": "m", "plain": "", "citation": "c", "evidence_bbox": None}],
    "exemption": {"exempt": False, "clause": None, "note": ""}, "summary": {"total": 1, "pass": 0, "fail": 1, "na": 0}, "dossier": None, "meta": {"gps": None, "device": None, "options": {}}, "error": None,
}


def put(base, *path, value):
    out = copy.deepcopy(base)
    at = out
    for k in path[:-1]:
        at = at[k]
    at[path[-1]] = value
    return out


def without(base, *path):
    out = copy.deepcopy(base)
    at = out
    for k in path[:-1]:
        at = at[k]
    del at[path[-1]]
    return out


def r(*path, value):
    return put(REQUEST, *path, value=value)


ODD_REQUESTS = [
    (r("schema_version", value=99), "schema_version"), (r("schema_version", value=None), "schema_version"), (without(REQUEST, "scan_id"), "scan_id"), (r("scan_id", value=7), "scan_id"), (without(REQUEST, "tokens"), "tokens"),
    (r("tokens", value=[]), "tokens"), (r("tokens", value={}), "tokens"), (r("tokens", 1, value="x"), "tokens[1]"), (r("tokens", 1, "text", value=""), "tokens[1].text"), (r("tokens", 0, "text", value=5), "tokens[0].text"),
    (r("tokens", 0, "bbox", value=[1, 2, 3.0, 4]), "tokens[0].bbox"), (r("tokens", 0, "bbox", value=[1, 2, 0, 4]), "tokens[0].bbox"), (r("tokens", 0, "bbox", value=[1, 2, 3]), "tokens[0].bbox"),
    (r("tokens", 0, "bbox", value=[1, 2, 3, True]), "tokens[0].bbox"), (r("tokens", 1, "conf", value="1"), "tokens[1].conf"), (r("tokens", 1, "conf", value=None), "tokens[1].conf"), (r("tokens", 1, "conf", value=1.01), "tokens[1].conf"),
    (r("tokens", 1, "engine", value="easy"), "tokens[1].engine"), (r("tokens", 1, "lang", value=1), "tokens[1].lang"), (r("quality", value=[]), "quality"), (r("quality", "ok", value="true"), "quality.ok"),
    (r("quality", "prompts", value=None), "quality.prompts"), (r("quality", "prompts", value=["a", 1]), "quality.prompts[1]"), (r("quality", "glare_pct", value="0.5"), "quality.glare_pct"), (r("quality", "glare_bbox", value=[0]), "quality.glare_bbox"),
    (r("geometry", "shape", value="cube"), "geometry.shape"), (r("geometry", "mm_per_px", value=0), "geometry.mm_per_px"), (r("geometry", "pda_cm2", value=True), "geometry.pda_cm2"), (r("geometry", "pda_method", value=1), "geometry.pda_method"),
    (r("geometry", "rois", 0, "bbox", value=None), "geometry.rois[0].bbox"), (r("geometry", "rois", 0, "conf", value=2), "geometry.rois[0].conf"), (r("glyphs", 0, "height_mm", value=0), "glyphs[0].height_mm"),
    (r("glyphs", 0, "width_mm", value=-1), "glyphs[0].width_mm"), (r("image_b64", value=1), "image_b64"), (r("image_sha256", value=[]), "image_sha256"), (r("shape_hint", value="hexagonal"), "shape_hint"),
    (r("captured_utc", value="not-a-date"), "captured_utc"), (r("gps", "lat", value="12"), "gps.lat"), (without(REQUEST, "gps", "lon"), "gps.lon"), (r("device", value="phone"), "device"), (r("options", value=[]), "options"),
    (r("options", "institutional", value="false"), "options.institutional"), (r("options", "blown", value=1), "options.blown"), (r("options", "commodity", value=1), "options.commodity"),
    (r("options", "package_height_cm", value="tall"), "options.package_height_cm"), (r("options", "package_height_cm", value=-1), "options.package_height_cm"), (r("options", "cylinder_left_px", value="x"), "options.cylinder_left_px"),
]


def d(*path, value):
    return put(RESULT, *path, value=value)


ODD_RESULTS = [
    *[(without(RESULT, k), [(k, "missing key")]) for k in RESULT if k not in ("checks", "summary", "quality", "error", "scan_id")],
    (d("extra", value=1), [("extra", "unknown key")]), (d("ocr", "tokens", 0, "x", value=1), [("ocr.tokens[0].x", "unknown key")]), (without(RESULT, "ocr", "tokens", 0, "lang"), [("ocr.tokens[0].lang", "missing key")]),
    (d("verdict", value="MAYBE"), ["verdict"]), (d("captured_utc", value="2026-01-01T00:00:00Z"), ["captured_utc"]), (d("total_ms", value="12"), ["total_ms"]), (d("total_ms", value=-1), ["total_ms"]),
    (d("timings_ms", "s9_magic", value=1.0), ["timings_ms.s9_magic"]), (d("timings_ms", "s4_ocr", value=None), ["timings_ms.s4_ocr"]), (d("timings_ms", value=None), ["timings_ms"]),
    (d("quality", "prompts", value=[1]), ["quality.prompts[0]"]), (d("geometry", "rois", 0, "roi", value="SIDEPANEL"), ["geometry.rois[0].roi"]), (d("ocr", "engines_used", value=["easyocr"]), ["ocr.engines_used[0]"]),
    (d("fields", "mrp", "bbox", value=[1, 2, 3]), ["fields.mrp.bbox"]), (d("fields", "mrp", "value", value=14.0), ["fields.mrp.value"]), (d("fields", "mrp", value=None), ["fields.mrp"]),
    (d("checks", 0, "citation", value=""), ["checks[0].citation"]), (d("checks", 0, "status", value="MAYBE"), ["checks[0].status", "summary.fail"]), (d("checks", value=None), ["checks"]),
    (d("summary", "fail", value=99), ["summary.fail"]), (d("summary", "na", value=0.0), ["summary.na"]), (d("exemption", "exempt", value=None), ["exemption.exempt"]), (d("dossier", value={"sha256": "x"}), ["dossier.pdf_path", "dossier.signed", "dossier.signature", "dossier.cert_pem", "dossier.sig_status", "dossier.sha256"]),
    (d("meta", "gps", value=1), ["meta.gps"]), (d("error", value={"code": "INTERNAL", "message": "x", "stage": None}), ["error"]), (d("error", value={"code": "ODD", "message": "x", "stage": 1}), ["error", "error.code", "error.stage"]),
    (d("verdict", value="RETRY"), ["quality.prompts"]), (put(put(RESULT, "verdict", value="RETRY"), "error", value={"code": "INTERNAL", "message": "x", "stage": None}), []),
]


def faults_of(spark, texts, law):
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, value string").repartition(3)
    return {x["n"]: x["faults"] for x in shapes.with_faults(rows, law).select("n", "faults").collect()}


@pytest.fixture(scope="module")
def odd(spark):
    return faults_of(spark, [json.dumps(x) for x, _ in ODD_REQUESTS] + [json.dumps(REQUEST), '{"scan_id":"s","tokens":[{"text":"a","bbox":[0,0,1,1]}]}', "not json", '{"a":1,"a":2}', None, "[]", ""], shapes.request_law())


def test_each_fault_of_a_request_is_named(odd):
    for n, (_, path) in enumerate(ODD_REQUESTS):
        assert [x["path"] for x in odd[n]] == [path], (n, path, odd[n])


def test_sound_and_unreadable_requests(odd):
    n = len(ODD_REQUESTS)
    assert odd[n] == [] and odd[n + 1] == []
    assert [[tuple(x) for x in odd[k]] for k in range(n + 2, n + 7)] == [[("", shapes.NO_JSON)]] * 3 + [[("", "must be an object")], [("", shapes.NO_JSON)]]


def test_requests_out_of_texts(spark):
    two = put(put(REQUEST, "tokens", 0, "text", value=""), "options", "blown", value="no")
    framed = put(REQUEST, "roi_boxes", value=[{"label": "PDP", "score": 0.5, "x": 1, "y": 1, "w": 2, "h": 2}])
    texts = spark.createDataFrame([(json.dumps(x),) for x in (REQUEST, two, r("schema_version", value=2), framed)] + [("{",)], "value string")
    valid, rejects = shapes.split_texts(texts)
    (kept,) = valid.collect()
    o = kept["options"]
    assert (kept["scan_id"], json.loads(kept["device"]), kept["tokens"][1]["conf"], kept["gps"]["lat"]) == ("s", {"os": "14"}, 1.0, 12.0)
    assert (o["package_height_cm"], o["package_width_cm"], o["package_diameter_cm"], o["blown_or_molded"], o["institutional"]) == (12.5, 8.0, None, True, True)
    found = sorted((x["code"], x["path"]) for x in rejects.collect())
    assert found == [("BAD_REQUEST", ""), ("BAD_REQUEST", "roi_boxes"), ("BAD_REQUEST", "tokens[0].text"), ("UNSUPPORTED_VERSION", "schema_version")]
    assert [c for c in valid.columns] == [f.name for f in spark.createDataFrame([], shapes.tables.REQUEST).schema]
    empty, none = shapes.split_texts(texts.limit(0))
    assert empty.count() == 0 and none.count() == 0


def test_each_fault_of_a_result_is_a_row(spark):
    rows = [(n, json.dumps(x)) for n, (x, _) in enumerate(ODD_RESULTS)] + [(-1, json.dumps(RESULT)), (-2, "{"), (-3, None)]
    found = {}
    for x in shapes.result_faults(spark.createDataFrame(rows, "n int, value string"), key="n").collect():
        found.setdefault(x["key"], []).append((x["path"], x["message"]))
    for n, (_, wanted) in enumerate(ODD_RESULTS):
        got = found.pop(n, [])
        assert sorted(p for p, _ in got) == sorted(w if isinstance(w, str) else w[0] for w in wanted), (n, wanted, got)
        assert all(w in got for w in wanted if isinstance(w, tuple))
    assert found == {-2: [("", shapes.NO_JSON)], -3: [("", shapes.NO_JSON)]}


def test_laws_shuffle_nothing(spark):
    texts = spark.createDataFrame([(json.dumps(RESULT),)], "value string")
    plan = shapes.result_faults(texts)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_what_stands_at_a_fixed_place_is_read_without_a_lambda():
    for law, place in ((shapes.request_law(), "$.geometry.mm_per_px"), (shapes.result_law(), "$.dossier.sig_status")):
        assert f"try_variant_get(doc, '{place}', 'variant')" in law("doc", "''")
