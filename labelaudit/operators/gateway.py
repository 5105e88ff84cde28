"""The gateway's table of recorded scans: ingest decisions, statistics, listings, filings, delivery and ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelaudit.functions import fixed_values as V
from labelaudit.functions import text as T

VERDICTS = ("PASS", "VIOLATION")
KIND = "scan.v1"


def first_wins(rows: DataFrame, key: str = "scan_id", order: str = "received") -> DataFrame:
    """The first row of each key."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn("n", place).where("n = 1").drop("n")


def new_rows(rows: DataFrame, store: DataFrame, key: str = "scan_id") -> DataFrame:
    """Rows whose key the store doesn't know."""
    return rows.join(store.select(key), key, "left_anti")


def ingest_decision(envelopes: DataFrame, store: DataFrame, enrolled: DataFrame | None = None, kind: str = KIND) -> DataFrame:
    """scan_id, http_status, detail, duplicate of each envelope; the first law broken answers, a duplicate before its signature.

    envelopes: scan_id, kind, verdict, has_result, contract_error, signature, dossier_sha256, cert_fingerprint.
    """
    known = envelopes.join(store.select("scan_id").distinct().withColumn("known", F.lit(True)), "scan_id", "left")
    if enrolled is not None:
        known = known.join(enrolled.select(F.lower(F.trim("fingerprint")).alias("cert_fingerprint")).distinct().withColumn("trusted", F.lit(True)), "cert_fingerprint", "left")
        configured = F.lit(True)
    else:
        known, configured = known.withColumn("trusted", F.lit(False)), F.lit(False)
    blank = lambda c: F.coalesce(F.col(c) == "", F.lit(True))
    signed = ~blank("signature") & ~blank("dossier_sha256")
    rules = [
        (blank("scan_id"), 400, "scan_id is required"),
        (blank("verdict"), 400, "verdict is required"),
        (~F.col("verdict").isin(*VERDICTS), 422, "verdict must be PASS or VIOLATION"),
        (~F.coalesce("has_result", F.lit(False)), 422, "result is required"),
        (F.coalesce(F.col("kind") != kind, F.lit(True)), 422, f"kind must be {kind}"),
        (F.col("contract_error").isNotNull(), 422, "result violates contract"),
        (F.coalesce("known", F.lit(False)), 200, "duplicate"),
        (signed & ~configured, 503, "certificate trust is not configured"),
        (signed & ~F.coalesce("trusted", F.lit(False)), 422, "certificate is not enrolled"),
    ]
    status, detail = F.lit(200), F.lit("accepted")
    for when, code, text in reversed(rules):
        status, detail = F.when(when, code).otherwise(status), F.when(when, text).otherwise(detail)
    return known.select("scan_id", status.alias("http_status"), detail.alias("detail"), (detail == "duplicate").alias("duplicate"))


def stats(scans: DataFrame) -> DataFrame:
    """total, violation, pass, signed, located in one pass."""
    return scans.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("verdict") == "VIOLATION").alias("violation"),
        F.count_if(~F.coalesce(F.col("verdict") == "VIOLATION", F.lit(False))).alias("pass"),
        F.count_if(F.col("sig_status") == "signed").alias("signed"),
        F.count("lat").alias("located"),
    )


def list_scans(scans: DataFrame, verdict: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """Newest first; at most 500 rows, at least one; ties by scan_id."""
    wanted = scans.where(F.col("verdict") == verdict) if verdict else scans
    return wanted.orderBy(F.desc("received"), "scan_id").offset(max(0, offset)).limit(max(1, min(limit, 500)))


def get_scan(scans: DataFrame, scan_id) -> DataFrame:
    return scans.where(F.col("scan_id") == scan_id)


def heatmap_points(scans: DataFrame) -> DataFrame:
    """scan_id, verdict, fail_count, wkt of located scans."""
    wkt = F.concat(F.lit("POINT("), F.col("lon").cast("string"), F.lit(" "), F.col("lat").cast("string"), F.lit(")"))
    return scans.where("lat is not null").select("scan_id", "verdict", "fail_count", "lat", "lon", wkt.alias("wkt"))


def heatmap_features(scans: DataFrame) -> DataFrame:
    """One GeoJSON feature for each located scan."""
    point = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct("scan_id", "verdict", "fail_count").alias("properties"))
    return scans.where("lat is not null").select("scan_id", F.to_json(feature).alias("feature"))


def queue_status(ledger: DataFrame) -> DataFrame:
    """total, pending, failed, signed, dossiers; zeros on an empty ledger."""
    return ledger.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("sync_status") == "pending").alias("pending"),
        F.count_if(F.col("sync_status") == "failed").alias("failed"),
        F.count_if(F.col("sig_status") == "signed").alias("signed"),
        F.count("dossier_sha256").alias("dossiers"),
    )


def pending_sync(ledger: DataFrame, limit: int = 50) -> DataFrame:
    return ledger.where("sync_status = 'pending'").orderBy("created", "scan_id").limit(limit)


def delivered(ledger: DataFrame, responses: DataFrame, limit: int | None = None) -> DataFrame:
    """scan_id, outcome (synced, failed, deferred, untouched), attempts of pending rows in created order.

    responses: scan_id, http_status (null: unreachable), accepted. After the first deferral nothing more is sent.
    """
    batch = pending_sync(ledger, limit) if limit else ledger.where("sync_status = 'pending'")
    met = batch.join(responses, "scan_id", "left")
    ok = F.coalesce(F.col("http_status").between(200, 299) & F.col("accepted"), F.lit(False))
    outcome = F.when(ok, "synced").when(F.col("http_status").isin(400, 422), "failed").otherwise("deferred")
    #: The order is one for the whole queue of a device; `device`, where there is one, lets queues run side by side.
    order = Window.partitionBy("device").orderBy("created", "scan_id")
    sent = met.withColumn("outcome", outcome)
    stopped = F.max(F.col("outcome") == "deferred").over(order.rowsBetween(Window.unboundedPreceding, -1))
    done = sent.withColumn("outcome", F.when(F.coalesce(stopped, F.lit(False)), "untouched").otherwise(F.col("outcome")))
    return done.select("scan_id", "device", "outcome", (F.col("attempts") + F.when(F.col("outcome") == "untouched", 0).otherwise(1)).alias("attempts"))


def sync_envelopes(ledger: DataFrame, kind: str = KIND, result: str | None = None) -> DataFrame:
    """What a device sends of each ledger row: everything but the local path of the dossier, gaps filled.

    result: the schema by which result_json, if there is one, is read; what can't be read is null.
    """
    have = set(ledger.columns)
    text = lambda c: (F.col(c) if c in have else F.lit(None)).cast("string").alias(c)
    filled = lambda c, kind, value: (F.coalesce(F.col(c).cast(kind), F.lit(value)) if c in have else F.lit(value)).alias(c)
    document = F.from_json("result_json", result) if result and "result_json" in have else F.lit(None)
    return ledger.select(
        F.lit(V.SCHEMA_VERSION).alias("schema_version"), F.lit(kind).alias("kind"), "scan_id", "verdict", *[text(c) for c in ("created_utc", "image_sha256", "dossier_sha256", "signature", "cert_pem")],
        filled("sig_verified", "boolean", False), filled("sig_status", "string", "pending"), filled("attempts", "int", 0), document.alias("result"),
    )


def sync_summary(outcomes: DataFrame) -> DataFrame:
    of = lambda x: F.count_if(F.col("outcome") == x)
    return outcomes.groupBy("device").agg((of("synced") + of("failed") + of("deferred")).alias("attempted"), of("synced").alias("synced"), of("failed").alias("failed"), of("deferred").alias("deferred"), (of("deferred") + of("untouched")).alias("remaining"))


def dossier_gate(verdict: Column, always: Column) -> Column:
    """Whether a scan gets a dossier: violations do, passes only on request, retries never."""
    return F.when(verdict == "VIOLATION", True).when(verdict == "PASS", F.coalesce(always, F.lit(False))).otherwise(False)


def evidence_manifest(checks: DataFrame, frames: DataFrame, most: int = 6, margin: float = 0.15) -> DataFrame:
    """First failed checks of a scan that have a box, with the crop around it: box and margin, inside the frame, 8 px at least."""
    place = F.row_number().over(Window.partitionBy("scan_id").orderBy("ord"))
    hit = checks.where("status = 'FAIL' and ex is not null").withColumn("n", place).where(F.col("n") <= most)
    dx, dy = F.floor(F.col("ew") * margin), F.floor(F.col("eh") * margin)
    left, top = F.greatest(F.lit(0), F.col("ex") - dx), F.greatest(F.lit(0), F.col("ey") - dy)
    cw = F.least(F.col("frame_w"), F.col("ex") + F.col("ew") + dx) - left
    ch = F.least(F.col("frame_h"), F.col("ey") + F.col("eh") + dy) - top
    out = hit.join(frames, "scan_id").select("scan_id", "n", "rule", left.alias("cx"), top.alias("cy"), cw.alias("cw"), ch.alias("ch"))
    return out.where("cw >= 8 and ch >= 8")


def violations(checks: DataFrame) -> DataFrame:
    """Per scan the failed checks in order, as an array."""
    one = F.struct("ord", "rule", "message")
    return checks.where("status = 'FAIL'").groupBy("scan_id").agg(F.sort_array(F.collect_list(one)).alias("violations"))


def consumer_cases(scans: DataFrame, checks: DataFrame) -> DataFrame:
    """scan_id, reason (null: filed), respondent, violations: violations with a dossier are filed."""
    filed = scans.join(violations(checks), "scan_id", "left")
    reason = F.when(F.col("verdict") != "VIOLATION", "not a violation — nothing to file").when(F.coalesce(F.col("dossier_sha256") == "", F.lit(True)), "no dossier attached to this scan")
    address = F.coalesce("mfg_address", F.lit(""))
    respondent = F.struct(T.respondent_name(address).alias("name"), F.coalesce(F.nullif("mfg_address", F.lit("")), F.lit("Not declared on package")).alias("address_as_declared"))
    evidence = F.struct("scan_id", "dossier_sha256")
    case = F.struct(respondent.alias("respondent"), F.transform("violations", lambda v: F.struct(v["rule"].alias("rule"), v["message"].alias("finding"))).alias("violations"), evidence.alias("evidence"))
    return filed.select("scan_id", reason.alias("reason"), F.when(reason.isNull(), F.struct(F.lit("consumer-case").alias("export"), case.alias("case"))).alias("payload"))


def helpline_complaints(scans: DataFrame, checks: DataFrame) -> DataFrame:
    """scan_id, product, address, pin_zone, description of each violation; findings are cut at 160 characters."""
    filed = scans.where("verdict = 'VIOLATION'").join(violations(checks), "scan_id", "left")
    found = F.coalesce("violations", F.array().cast("array<struct<ord:int,rule:string,message:string>>"))
    parts = F.transform(found, lambda v: F.concat(F.lit("[Rule "), v["rule"], F.lit("] "), F.substring(F.coalesce(v["message"], F.lit("")), 1, 160)))
    said = F.concat(F.lit("Automated field audit found "), F.size(found).cast("string"), F.lit(" statutory non-compliance(s): "), F.array_join(parts, "; "))
    return filed.select(
        "scan_id", F.coalesce(F.nullif("product_name", F.lit("")), F.lit("not decoded")).alias("brand_or_product"),
        F.coalesce(F.nullif("mfg_address", F.lit("")), F.lit("not declared")).alias("manufacturer_address"),
        T.pin_zone(T.squash(F.col("mfg_address")), T.squash(F.col("consumer_care"))).alias("pin_zone"),
        F.when(F.size(found) > 0, said).otherwise("Automated field audit found the package compliant.").alias("description"),
    )


def sign_payload(scan_id: Column, sha256: Column, prefix: str = "label-dossier-v1") -> Column:
    """What a device signs, null unless both parts have their form."""
    text = F.concat_ws("|", F.lit(prefix), scan_id, sha256)
    return F.when(text.rlike(r"^[a-z0-9-]+\|[A-Za-z0-9_-]+\|[0-9a-f]{64}$"), text)


def attach_signatures(requests: DataFrame, ledger: DataFrame) -> DataFrame:
    """scan_id, code, verified of each signature request against the ledger; the cryptographic check isn't part of this."""
    row = ledger.select("scan_id", F.lit(True).alias("found"), "sig_status", "dossier_sha256")
    bad = F.coalesce(F.col("signature") == "", F.lit(True)) | F.coalesce(F.col("scan_id") == "", F.lit(True))
    code = (
        F.when(bad, "BAD_REQUEST").when(~F.coalesce("found", F.lit(False)), "NOT_FOUND").when(F.col("sig_status") == "signed", "ALREADY_SIGNED")
        .when(F.coalesce(F.col("dossier_sha256") == "", F.lit(True)), "NO_DOSSIER").otherwise("ACCEPTED")
    )
    return requests.join(row, "scan_id", "left").select("scan_id", code.alias("code"), F.lit(False).alias("verified"))


def apply_signatures(ledger: DataFrame, accepted: DataFrame) -> DataFrame:
    """The ledger with accepted signatures: status signed, and the dossier of its result document kept in step.

    accepted: scan_id, signature, one row a scan; cert_pem where it has one. A ledger with a column result (a struct
    with a dossier of signed, signature, cert_pem and sig_status) has it changed too; a null result or dossier stays null.
    """
    pem = F.col("cert_pem") if "cert_pem" in accepted.columns else F.lit(None)
    got = ledger.join(accepted.select("scan_id", F.col("signature").alias("new_signature"), pem.cast("string").alias("new_pem")), "scan_id", "left")
    on = F.col("new_signature").isNotNull()
    changed = {"signature": F.coalesce("new_signature", "signature"), "sig_status": F.when(on, "signed").otherwise(F.col("sig_status"))}
    if "cert_pem" in ledger.columns:
        changed["cert_pem"] = F.coalesce("new_pem", "cert_pem")
    if "result" in ledger.columns:
        dossier = F.col("result.dossier")
        for name, value in (("signed", F.lit(True)), ("signature", F.col("new_signature")), ("cert_pem", F.coalesce(F.col("new_pem"), F.col("result.dossier.cert_pem"))), ("sig_status", F.lit("signed"))):
            dossier = dossier.withField(name, value)
        changed["result"] = F.when(on & F.col("result.dossier").isNotNull(), F.col("result").withField("dossier", dossier)).otherwise(F.col("result"))
    return got.withColumns(changed).drop("new_signature", "new_pem")


def stage_latency(stages: DataFrame, budgets: DataFrame) -> DataFrame:
    """stage, mean_ms, budget_ms, over of every stage that ran."""
    return stages.groupBy("stage").agg(F.avg("duration_ms").alias("mean_ms")).join(budgets, "stage", "left").select("stage", "mean_ms", "budget_ms", (F.col("mean_ms") > F.col("budget_ms")).alias("over"))


def scan_totals(stages: DataFrame) -> DataFrame:
    return stages.groupBy("scan_id").agg(F.sum("duration_ms").alias("total_ms"), F.count("*").alias("stages"))


def engines_used(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("scan_id").agg(F.sort_array(F.collect_set("engine")).alias("engines"))
