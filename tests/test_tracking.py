"""Delivery tracking as a stream, filings and plain wording."""

from pyspark.sql import functions as F

from labelaudit.operators import gateway, rules


def test_delivery_over_batches(spark, tmp_path):
    ledger = spark.createDataFrame([(f"s{i}", "d", i, "pending", 0) for i in range(3)], "scan_id string, device string, created int, sync_status string, attempts int")
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.json").write_text('{"scan_id":"s0","http_status":200,"accepted":true}\n{"scan_id":"s1","http_status":422,"accepted":false}\n')
    stream = spark.readStream.schema("scan_id string, http_status int, accepted boolean").json(str(source))

    def each(batch, number):
        gateway.delivered(ledger, batch).withColumn("batch", F.lit(number)).write.mode("append").parquet(str(tmp_path / "out"))

    stream.writeStream.foreachBatch(each).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    found = {r["scan_id"]: (r["outcome"], r["attempts"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert found == {"s0": ("synced", 1), "s1": ("failed", 1), "s2": ("deferred", 1)}


def test_filings(spark):
    scans = spark.createDataFrame(
        [("a", "VIOLATION", "d", "Mfd. by: Tasty Foods, Goa 403001", "Noodles", None), ("b", "VIOLATION", None, None, None, "Pune 411 001"), ("c", "PASS", "d", None, None, None)],
        "scan_id string, verdict string, dossier_sha256 string, mfg_address string, product_name string, consumer_care string",
    )
    checks = spark.createDataFrame([("a", 0, "13", "FAIL", "x" * 200), ("a", 1, "7", "FAIL", "low"), ("a", 2, "6(11)", "PASS", "ok")], "scan_id string, ord int, rule string, status string, message string")
    cases = {r["scan_id"]: r for r in gateway.consumer_cases(scans, checks).collect()}
    assert cases["a"]["reason"] is None and cases["a"]["payload"]["case"]["respondent"]["name"] == "Tasty Foods"
    assert [v["rule"] for v in cases["a"]["payload"]["case"]["violations"]] == ["13", "7"]
    assert cases["b"]["reason"].startswith("no dossier") and cases["c"]["reason"].startswith("not a violation")
    calls = {r["scan_id"]: r for r in gateway.helpline_complaints(scans, checks).collect()}
    assert calls["a"]["pin_zone"].startswith("Maharashtra") and "[Rule 13] " + "x" * 160 + "; [Rule 7] low" in calls["a"]["description"]
    assert calls["b"]["brand_or_product"] == "not decoded" and calls["b"]["pin_zone"].startswith("Maharashtra") and set(calls) == {"a", "b"}


def test_plain_wording(spark):
    rows = [
        ("13", "FAIL", "Prohibited unit syntax 'gms' in net quantity"), ("6(1)(e)", "FAIL", "MRP declaration not detected."), ("6(1)(e)", "FAIL", "MRP non-compliant — missing rupee amount."),
        ("26", "NA", "Net quantity <= 10 g. Remaining Rule 6 declarations are not applicable."), ("6(1)(d)", "PASS", "x"), ("9", "FAIL", "as it is"),
    ]
    found = [r["plain"] for r in rules.with_plain(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, rule string, status string, message string")).orderBy("i").collect()]
    assert found == [
        "The label says 'gms' — the correct unit symbol is 'g'.", "The Maximum Retail Price (MRP) declaration was not found on the package.", "The MRP is printed without a valid retail price amount.",
        "This pack is exempt from declaration rules (Remaining Rule 6 declarations are not applicable).", "Manufacturing date is valid.", "as it is",
    ]
