"""From requests to whole results: what devices send in, the documents that they get back out.

A request that breaks the contract gives a document with its error. One refused by its device's quality gate is to be
taken again, with guidance, and no stage after that sees it. All others are read, extracted and audited. Every document
has the same 17 keys. Stages run over all scans at once, so a scan has no time of its own: total_ms is 0 and timings_ms
empty. Dossiers are drawn elsewhere: dossier is null.

Requests are dealt by scan_id once, which leaves one for each, and written to the folder of checkpoints; from there to
the documents there is no exchange: a scan's tokens, fields and findings are arrays of its row. A request without an id
is refused; an empty table of requests gives no documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelaudit.functions import fixed_values as V
from labelaudit.functions import text as T
from labelaudit.operators import contract, extract, folds, geometry, rules
from labelaudit.plans.derived import arrived
from labelaudit.sources import tables

REFUSED = "The device's quality gate refused this frame: hold steady and scan again"
QUALITY = "struct<ok:boolean,laplacian_var:double,glare_pct:double,prompts:array<string>,glare_bbox:array<int>>"
TOKEN = "struct<text:string,bbox:array<int>,conf:double,engine:string,lang:string>"
FIELD = "struct<raw:string,value:string,unit:string,bbox:array<int>,conf:double>"
CHECK = "struct<rule:string,status:string,message:string,plain:string,citation:string,evidence_bbox:array<int>>"
ROI = "struct<roi:string,bbox:array<int>,conf:double>"
OPTIONS = "struct<" + tables.REQUEST.split("options struct<")[1].split(">")[0] + ">"
#: The keys of a result and their types.
RESULT = {
    "schema_version": "int", "scan_id": "string", "verdict": "string", "captured_utc": "string", "completed_utc": "string",
    "total_ms": "double", "timings_ms": "map<string,double>", "quality": QUALITY,
    "geometry": f"struct<shape:string,shape_detected:string,mm_per_px:double,pda_cm2:double,pda_method:string,rois:array<{ROI}>>",
    "ocr": f"struct<engines_used:array<string>,tokens:array<{TOKEN}>>", "fields": f"map<string,{FIELD}>", "checks": f"array<{CHECK}>",
    "exemption": "struct<exempt:boolean,clause:string,note:string>", "summary": "struct<total:int,pass:int,fail:int,na:int>",
    "dossier": "struct<sha256:string,sig_status:string>", "meta": f"struct<gps:struct<lat:double,lon:double>,device:string,options:{OPTIONS}>",
    "error": "struct<code:string,message:string,stage:string>",
}


def iso(time: Column) -> Column:
    return F.date_format(F.to_utc_timestamp(time, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def none(kind: str) -> Column:
    return F.lit(None).cast(kind)


def measured(requests: DataFrame) -> DataFrame:
    """Valid requests with refused, shape, shape_detected, mm_per_px, pda_cm2 and pda_method; a refused one keeps its hint alone."""
    refused = F.coalesce(~F.col("quality.ok"), F.lit(False))
    known = lambda c: F.when(~refused, F.col(c))
    hint = F.coalesce(F.nullif("shape_hint", F.lit("")), F.nullif(known("geometry.shape"), F.lit("")))
    o = lambda c: F.col(f"options.{c}")
    made = geometry.display_area(hint, o("package_height_cm"), o("package_width_cm"), o("package_diameter_cm"), o("total_surface_cm2"), o("image_diameter_mm"))
    area = F.when(~refused, geometry.sane_area(F.col("geometry.pda_cm2"), made["pda_cm2"]))
    method = F.when(F.col("geometry.pda_cm2").isNotNull(), F.col("geometry.pda_method")).otherwise(made["pda_method"])
    detected = F.nullif(known("geometry.shape_detected"), F.lit(""))
    return requests.select(
        "*", refused.alias("refused"), geometry.effective_shape(hint, detected).alias("shape"), detected.alias("shape_detected"), known("geometry.mm_per_px").alias("mm_per_px"),
        area.alias("pda_cm2"), F.when(area.isNotNull(), F.nullif(method, F.lit(""))).alias("pda_method"),
    )


def one_each(requests: DataFrame) -> DataFrame:
    """One request for each scan_id: of those delivered twice the one captured first, then the one with the smaller content.

    Requests without an id stay as they are, each to be refused by itself.
    """
    order = F.struct(F.col("captured_utc").isNull(), "captured_utc", F.xxhash64(*requests.columns))
    named = requests.where("scan_id is not null").groupBy("scan_id").agg(F.min_by(F.struct(*requests.columns), order).alias("r")).select("r.*")
    return named.unionByName(requests.where("scan_id is null"))


def box(x: Column) -> Column:
    return F.when(x.isNotNull(), F.array(*[x[c].cast("int") for c in "xywh"]))


def read_tokens() -> Column:
    """The tokens of a request as folds reads them, of its first engine; none of a refused one."""
    at = lambda t, k: F.get(t["bbox"], F.lit(k))
    tokens = F.transform(
        F.coalesce("tokens", F.array().cast(f"array<{TOKEN}>")),
        lambda t, i: F.struct(
            i.alias("tok"), t["text"].alias("text"), *(at(t, k).alias(c) for k, c in enumerate("xywh")), F.coalesce(t["conf"], F.lit(1.0)).alias("conf"),
            F.coalesce(t["engine"], F.lit("mlkit")).alias("engine"), F.coalesce(t["lang"], F.lit("en")).alias("lang"),
        ),
    )
    return F.filter(folds.first_engine(tokens), lambda t: ~F.col("refused"))


def audited(scans: DataFrame) -> DataFrame:
    """scans with tokens_read, fields, exemption and found (checks): folds and projections alone, nothing is shuffled."""
    out = folds.with_fields(T.nfc_tokens(scans, "tokens").withColumn("tokens_read", read_tokens()), "tokens_read", "mm_per_px")
    o = lambda c: F.col(f"options.{c}").alias(c)
    options = [o("institutional"), o("fast_food"), F.col("options.blown_or_molded").alias("blown"), o("commodity")]
    keep = [c for c in out.columns if c not in ("scan_id", "pda_cm2", "mm_per_px")]
    labels = out.select("*", *folds.label_columns(), *options)
    rows = rules.prepared(labels, [*keep, "mm_per_px"]).withColumns({"exemption": rules.exemption(), "glyph_check": F.when(~F.col("refused"), rules.glyph_check(F.col("glyphs")))})
    return rows.withColumn("found", rules.checks_of())


def full_check(c: Column) -> Column:
    """A check with its plain message, citation and the box of the field that it is about."""
    place = F.get(F.filter("fields", lambda f: f["field"] == c["field"]), F.lit(0))
    said = rules.plain_message(c["rule"], c["status"], c["message"])
    return F.struct(c["rule"].alias("rule"), c["status"].alias("status"), c["message"].alias("message"), said.alias("plain"), rules.citation(c["rule"]).alias("citation"), box(place).alias("evidence_bbox"))


def region_list(kind) -> Column:
    """Detected regions by score, inside the frame, then the request's own of other labels."""
    inside = geometry.clamped_boxes(kind, F.col("roi_boxes"), F.col("roi_frame.w"), F.col("roi_frame.h"))
    given = F.coalesce("geometry.rois", F.array().cast(f"array<{ROI}>"))
    merged = geometry.merged_rois(inside, given)
    rois = F.transform(merged, lambda r: F.struct(r["roi"].alias("roi"), box(r).alias("bbox"), r["conf"].alias("conf")))
    return F.filter(rois, lambda r: ~F.col("refused"))


def document(rows: DataFrame, parts: dict[str, Column]) -> DataFrame:
    return rows.select(*[parts.get(k, F.lit(None)).cast(kind).alias(k) for k, kind in RESULT.items()])


def scan_results(requests: DataFrame) -> DataFrame:
    """One document of the 17 keys of RESULT for each request (as read with sources.tables.REQUEST)."""
    valid, rejects = contract.split_requests(arrived(one_each(requests)))
    rows = audited(measured(valid))
    rows = rows.withColumns({"checks": F.transform("found", full_check), "rois": region_list(rows.schema["roi_boxes"].dataType), "stopped": ~F.col("refused") & ~folds.declared()})
    now = iso(F.current_timestamp())
    empty = lambda kind: F.array().cast(f"array<{kind}>")

    checks, rois = F.col("checks"), F.col("rois")
    count = lambda s: F.size(F.filter(checks, lambda c: c["status"] == s))
    summary = F.struct(F.size(checks).alias("total"), *[count(s).alias(s.lower()) for s in ("PASS", "FAIL", "NA")])
    said = F.coalesce("quality.prompts", empty("string"))
    prompts = F.when(F.col("refused") & (F.size(said) == 0), F.array(F.lit(REFUSED))).when(F.col("stopped"), F.array_append(said, F.lit(extract.NOTHING_DECLARED))).otherwise(said)
    quality = F.struct("quality.ok", "quality.laplacian_var", "quality.glare_pct", prompts.alias("prompts"), "quality.glare_bbox")
    unknown = F.coalesce("shape", "shape_detected").isNull() & F.col("mm_per_px").isNull() & F.col("pda_cm2").isNull() & (F.size(rois) == 0)
    retry = F.col("refused") | F.col("stopped") | (F.size(checks) == 0)
    token = lambda t: F.struct(t["text"].alias("text"), box(t).alias("bbox"), F.bround(t["conf"], 3).alias("conf"), t["engine"].alias("engine"), t["lang"].alias("lang"))
    field = lambda f: F.struct(f["raw"].alias("raw"), extract.value_text(f["value_dec"], f["value_date"]).alias("value"), f["unit"].alias("unit"), box(f).alias("bbox"), f["conf"].alias("conf"))
    done = document(
        rows,
        {
            "schema_version": F.lit(V.SCHEMA_VERSION), "scan_id": F.col("scan_id"), "verdict": F.when(retry, "RETRY").when(count("FAIL") > 0, "VIOLATION").otherwise("PASS"),
            "captured_utc": F.coalesce(iso(F.expr("try_to_timestamp(captured_utc)")), now), "completed_utc": now, "total_ms": F.lit(0.0), "timings_ms": F.create_map().cast("map<string,double>"),
            "quality": quality, "geometry": F.when(~unknown, F.struct("shape", "shape_detected", "mm_per_px", "pda_cm2", "pda_method", rois.alias("rois"))),
            "ocr": F.struct(F.array_sort(F.array_distinct(F.transform("tokens_read", lambda t: t["engine"]))).alias("engines_used"), F.transform("tokens_read", token).alias("tokens")),
            "fields": F.map_from_entries(F.transform(F.array_sort("fields"), lambda f: F.struct(f["field"], field(f)))), "checks": checks, "exemption": F.col("exemption"), "summary": summary,
            "meta": F.struct("gps", "device", "options"),
        },
    )
    failed = document(
        rejects,
        {
            "schema_version": F.lit(V.SCHEMA_VERSION), "scan_id": F.coalesce("scan_id", F.lit("")), "verdict": F.lit("RETRY"), "captured_utc": now, "completed_utc": now, "total_ms": F.lit(0.0),
            "timings_ms": F.create_map().cast("map<string,double>"), "quality": F.struct(none("boolean").alias("ok"), none("double").alias("laplacian_var"), none("double").alias("glare_pct"), empty("string").alias("prompts"), none("array<int>").alias("glare_bbox")),
            "ocr": F.struct(empty("string").alias("engines_used"), empty(TOKEN).alias("tokens")), "fields": F.create_map().cast(f"map<string,{FIELD}>"), "checks": empty(CHECK),
            "summary": F.struct(*[F.lit(0).alias(c) for c in ("total", "pass", "fail", "na")]), "error": F.struct("code", "message", none("string").alias("stage")),
        },
    )
    return done.unionByName(failed)
