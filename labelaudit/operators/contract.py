"""Contract validators as jobs: each returns rows (key, path, message); no row means valid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelaudit.functions import fixed_values as V
from labelaudit.operators import geometry

ENGINES = ("mlkit", "tesseract", "indic", "bhashini")
ERRORS = ("BAD_REQUEST", "DECODE_ERROR", "UNSUPPORTED_VERSION", "STAGE_FAILURE", "INTERNAL")


def problems(df: DataFrame, key: str, rules: list[tuple[str, Column, str]]) -> DataFrame:
    """A row for each rule (path, broken, message) that a row of df breaks, in the given order."""
    found = F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(k).alias("ord"), F.lit(path).alias("path"), F.lit(message).alias("message"))) for k, (path, bad, message) in enumerate(rules)])
    return df.select(F.col(key).alias("key"), F.explode(F.filter(found, lambda x: x.isNotNull())).alias("p")).select("key", "p.ord", "p.path", "p.message")


def first_problem(found: DataFrame) -> DataFrame:
    return found.groupBy("key").agg(F.min_by("path", "ord").alias("path"), F.min_by("message", "ord").alias("message"))


def validate_tokens(tokens: DataFrame) -> DataFrame:
    """tokens: scan_id, tok, text, x, y, w, h, conf, engine, lang."""
    row = tokens.withColumn("at", F.concat_ws("/", F.col("scan_id").cast("string"), F.col("tok").cast("string")))
    return problems(
        row, "at",
        [
            ("text", F.col("text").isNull() | (F.trim("text") == ""), "text must be non-empty"),
            ("bbox", F.col("x").isNull() | F.col("y").isNull() | F.col("w").isNull() | F.col("h").isNull(), "bbox needs four integers"),
            ("bbox", (F.col("x") < 0) | (F.col("y") < 0), "bbox origin must not be negative"),
            ("bbox", (F.col("w") <= 0) | (F.col("h") <= 0), "bbox size must be positive"),
            ("conf", ~F.col("conf").between(0, 1), "conf must be in 0..1"),
            ("engine", F.col("engine").isNotNull() & ~F.col("engine").isin(*ENGINES), "unknown engine"),
        ],
    )


def validate_results(results: DataFrame, checks: DataFrame) -> DataFrame:
    """results: scan_id, schema_version, verdict, completed_utc, total, pass, fail, na, error, n_prompts; checks: scan_id, status."""
    per = checks.groupBy("scan_id").agg(F.count("*").alias("n"), *[F.count_if(F.col("status") == s).alias(f"n_{s.lower()}") for s in ("PASS", "FAIL", "NA")], F.count_if(~F.col("status").isin("PASS", "FAIL", "NA")).alias("odd"))
    both = results.join(per, "scan_id", "left").na.fill(0, ["n", "n_pass", "n_fail", "n_na", "odd"])
    differs = lambda a, b: F.coalesce(F.col(a) != F.col(b), F.lit(True))
    return problems(
        both, "scan_id",
        [
            ("verdict", ~F.coalesce(F.col("verdict").isin("PASS", "VIOLATION", "RETRY"), F.lit(False)), "verdict must be PASS, VIOLATION or RETRY"),
            ("completed_utc", ~F.coalesce(F.col("completed_utc").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?Z$"), F.lit(False)), "not an ISO time in UTC"),
            ("checks", F.col("odd") > 0, "status must be PASS, FAIL or NA"),
            ("summary.total", differs("total", "n"), "total differs from checks"),
            ("summary.pass", differs("pass", "n_pass"), "pass differs from checks"),
            ("summary.fail", differs("fail", "n_fail"), "fail differs from checks"),
            ("summary.na", differs("na", "n_na"), "na differs from checks"),
            ("error", F.col("error").isNotNull() & (F.col("verdict") != "RETRY"), "an error needs verdict RETRY"),
            ("quality.prompts", F.col("error").isNull() & (F.col("verdict") == "RETRY") & (F.col("n_prompts") == 0), "RETRY without error needs a prompt"),
        ],
    )


def validate_documents(docs: DataFrame) -> DataFrame:
    """Whole results (plans.scans.scan_results): what validate_results asks for, times, numbers, boxes and field values."""
    iso = lambda c: F.coalesce(F.col(c).rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?Z$"), F.lit(False))
    odd = lambda c: F.col(c).isNotNull() & (F.isnan(c) | (F.abs(F.col(c)) == float("inf")))
    boxed = lambda b: b.isNull() | ((F.size(b) == 4) & F.forall(b, lambda v: v.isNotNull()))
    held = F.map_values("fields")
    flat = docs.select("scan_id", "schema_version", "verdict", "completed_utc", "summary.total", "summary.pass", "summary.fail", "summary.na", "error", F.size("quality.prompts").alias("n_prompts"))
    found = validate_results(flat, docs.select("scan_id", F.explode("checks").alias("c")).select("scan_id", "c.status"))
    more = problems(
        docs, "scan_id",
        [
            ("schema_version", F.coalesce(F.col("schema_version") != V.SCHEMA_VERSION, F.lit(True)), "unknown schema_version"),
            ("captured_utc", ~iso("captured_utc"), "not an ISO time in UTC"),
            *[(c, odd(c), "not a finite number") for c in ("total_ms", "quality.laplacian_var", "quality.glare_pct", "geometry.mm_per_px", "geometry.pda_cm2")],
            ("ocr.tokens", F.exists("ocr.tokens", lambda t: t["text"].isNull() | t["bbox"].isNull() | ~boxed(t["bbox"])), "a token needs text and box"),
            ("fields", F.exists(held, lambda f: f["raw"].isNull() | (f["raw"] == "") | ~boxed(f["bbox"]) | ~F.coalesce(f["conf"].between(0, 1), F.lit(False))), "a field needs raw text, a box of four and conf in 0..1"),
            ("checks", F.exists("checks", lambda c: c["rule"].isNull() | c["message"].isNull() | c["citation"].isNull() | ~boxed(c["evidence_bbox"])), "a check needs rule, message, citation and a box of four or none"),
            ("error.code", F.col("error").isNotNull() & ~F.coalesce(F.col("error.code").isin(*ERRORS), F.lit(False)), "unknown error code"),
        ],
    )
    return found.unionByName(more.withColumn("ord", F.col("ord") + 100))


def validate_queue(rows: DataFrame) -> DataFrame:
    """Ledger rows: scan_id, sync_status, sig_status, attempts."""
    return problems(
        rows, "scan_id",
        [
            ("attempts", F.col("attempts").isNull() | (F.col("attempts") < 0), "attempts must not be negative"),
            ("sync_status", ~F.coalesce(F.col("sync_status").isin("pending", "synced", "failed"), F.lit(False)), "unknown sync_status"),
            ("sig_status", ~F.coalesce(F.col("sig_status").isin("pending", "signed", "unavailable"), F.lit(False)), "unknown sig_status"),
        ],
    )


def validate_sync_summaries(rows: DataFrame) -> DataFrame:
    """Summaries of a delivery: device, attempted, synced, failed, deferred, remaining."""
    counts = ("attempted", "synced", "failed", "deferred", "remaining")
    return problems(rows, "device", [(c, F.col(c).isNull() | (F.col(c) < 0), f"{c} must not be negative") for c in counts])


def validate_signature_responses(rows: DataFrame) -> DataFrame:
    """Responses to signature requests: scan_id, accepted, sig_status, verified, code (null: no error)."""
    return problems(
        rows, "scan_id",
        [
            ("accepted", F.col("accepted").isNull(), "accepted must be true or false"),
            ("sig_status", ~F.coalesce(F.col("sig_status").isin("pending", "signed"), F.lit(False)), "sig_status must be pending or signed"),
            ("verified", F.col("verified").isNull(), "verified must be true or false"),
            ("error.code", F.col("code").isNotNull() & ~F.col("code").isin(*V.SIGNATURE_ERRORS), "unknown error code"),
        ],
    )


def request_rules(requests: DataFrame) -> list[tuple[Column, str, str]]:
    """(broken, code, message) of a request as read with sources.tables.REQUEST, in the order in which they answer."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    given = lambda c, fine: F.col(c).isNotNull() & ~F.coalesce(fine, F.lit(False))
    any_of = lambda c, bad: F.exists(F.coalesce(F.col(c), F.array().cast(requests.schema[c].dataType)), lambda x: F.coalesce(bad(x), F.lit(True)))
    box = lambda b: (F.size(b) == 4) & F.forall(b, lambda v: v.isNotNull()) & (F.get(b, F.lit(0)) >= 0) & (F.get(b, F.lit(1)) >= 0) & (F.get(b, F.lit(2)) > 0) & (F.get(b, F.lit(3)) > 0)
    number = lambda c: F.col(c).isNotNull() & ~(finite(F.col(c)) & (F.col(c) > 0))
    bad = lambda when, text: (when, "BAD_REQUEST", text)
    return [
        bad(F.col("_corrupt").isNotNull(), "not a request of the known form"),
        (F.coalesce(F.col("schema_version"), F.lit(V.SCHEMA_VERSION)) != V.SCHEMA_VERSION, "UNSUPPORTED_VERSION", f"schema {V.SCHEMA_VERSION} expected"),
        bad(F.coalesce(F.col("scan_id"), F.lit("")) == "", "scan_id must be given"),
        bad(F.coalesce(F.size("tokens"), F.lit(0)) <= 0, "tokens must be a non-empty list"),
        bad(any_of("tokens", lambda t: t["text"].isNull() | (t["text"] == "")), "a token's text must be non-empty"),
        bad(any_of("tokens", lambda t: ~box(t["bbox"])), "a token's bbox must be x, y, w, h with w and h above 0"),
        bad(any_of("tokens", lambda t: ~F.coalesce(t["conf"], F.lit(1.0)).between(0, 1)), "a token's conf must be in 0..1"),
        bad(any_of("tokens", lambda t: ~F.coalesce(t["engine"], F.lit(ENGINES[0])).isin(*ENGINES)), "unknown engine of a token"),
        bad(given("geometry.shape", F.col("geometry.shape").isin(*V.SHAPES)), "geometry.shape must be a shape"),
        bad(given("geometry.shape_detected", F.col("geometry.shape_detected").isin(*V.SHAPES)), "geometry.shape_detected must be a shape"),
        bad(number("geometry.mm_per_px"), "geometry.mm_per_px must be positive"),
        bad(number("geometry.pda_cm2"), "geometry.pda_cm2 must be positive"),
        bad(any_of("glyphs", lambda g: g["glyph"].isNull() | (g["glyph"] == "") | ~(g["height_mm"] > 0) | ~(g["width_mm"] >= 0)), "a glyph needs glyph, height_mm above 0 and width_mm from 0"),
        bad(given("shape_hint", F.col("shape_hint").isin("", *V.SHAPES)), "shape_hint must be a shape"),
        bad(given("captured_utc", (F.col("captured_utc") == "") | F.expr("try_to_timestamp(captured_utc)").isNotNull()), "captured_utc must be ISO-8601"),
        bad(F.col("gps").isNotNull() & (F.col("gps.lat").isNull() | F.col("gps.lon").isNull()), "gps needs lat and lon"),
        *[bad(number(f"options.{k}"), f"options.{k} must be positive") for k in ("package_height_cm", "package_width_cm", "package_diameter_cm", "total_surface_cm2")],
    ]


def split_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid requests, and rejects (scan_id, code, message, stage): the first law broken answers.

    Boxes of regions are held against their frame by geometry.validate_roi_boxes, after all other laws.
    """
    frames = requests.select("scan_id", F.col("roi_frame.w").alias("frame_w"), F.col("roi_frame.h").alias("frame_h"), "roi_boxes")
    boxes = geometry.roi_box_error(frames.schema["roi_boxes"].dataType, F.col("roi_boxes"), F.col("roi_frame.w"), F.col("roi_frame.h"))
    said = lambda kind, text: F.struct(F.lit(kind).alias("code"), text.alias("message"))
    problem = F.when(boxes.isNotNull(), said("BAD_REQUEST", F.concat(F.lit("roi_boxes: "), boxes)))
    for broken, kind, text in reversed(request_rules(requests)):
        problem = F.when(F.coalesce(broken, F.lit(False)), said(kind, F.lit(text))).otherwise(problem)
    made = F.struct(*requests.columns, problem.alias("problem"))
    # a list of one, taken apart again: filters on the problem aren't pushed below it, where they'd work every law out once more
    judged = requests.select(F.explode_outer(F.array(made)).alias("m")).select("m.*")
    rejects = judged.where("problem.code is not null").select("scan_id", "problem.code", "problem.message", F.lit("validate").alias("stage"))
    return judged.where("problem.code is null").drop("problem"), rejects
