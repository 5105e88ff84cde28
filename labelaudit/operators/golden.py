"""Results against ground truth: per fixture outcomes, precision and recall of rules, field extraction rate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelaudit.functions import text as T

SHAPES = ("rectangular", "cylindrical", "pouch", "bottle", "blister", "other")


def rule_sets(expected: DataFrame, checks: DataFrame) -> DataFrame:
    """fixture, expected and failed: sorted sets of rules (fixtures of either side)."""
    e = expected.groupBy("fixture").agg(F.sort_array(F.collect_set("rule")).alias("expected"))
    f = checks.where("status = 'FAIL'").groupBy("fixture").agg(F.sort_array(F.collect_set("rule")).alias("failed"))
    none = F.array().cast("array<string>")
    both = e.join(f, "fixture", "full_outer")
    return both.select("fixture", F.coalesce("expected", none).alias("expected"), F.coalesce("failed", none).alias("failed"))


def field_matches(expected: DataFrame, found: DataFrame) -> DataFrame:
    """fixture, fields_ok, fields_missing, fields_mismatch: what is printed must stand in what was read."""
    e = expected.select("fixture", "field", F.col("raw").alias("want"))
    f = found.select("fixture", "field", F.col("raw").alias("got"))
    both = e.join(f, ["fixture", "field"], "left")
    want, got = T.compare_key(F.col("want")), T.compare_key(F.col("got"))
    ok = F.col("got").isNotNull() & (want != "") & got.contains(want)
    return both.groupBy("fixture").agg(F.count_if(ok).alias("fields_ok"), F.count_if(F.col("got").isNull()).alias("fields_missing"), F.count_if(F.col("got").isNotNull() & ~ok).alias("fields_mismatch"))


def compare(fixtures: DataFrame, expected: DataFrame, checks: DataFrame, want_fields: DataFrame | None = None, found_fields: DataFrame | None = None) -> DataFrame:
    """One row per fixture (fixture, verdict, error): status, sets of rules, counts of fields."""
    out = fixtures.join(rule_sets(expected, checks), "fixture", "left")
    none = F.array().cast("array<string>")
    out = out.withColumns({c: F.coalesce(c, none) for c in ("expected", "failed")})
    counts = ["fields_ok", "fields_missing", "fields_mismatch"]
    if want_fields is not None:
        out = out.join(field_matches(want_fields, found_fields), "fixture", "left").na.fill(0, counts)
    else:
        out = out.withColumns({c: F.lit(0).cast("long") for c in counts})
    same = (F.col("expected") == F.col("failed")) & (F.col("fields_missing") == 0) & (F.col("fields_mismatch") == 0)
    status = F.when(F.col("error").isNotNull(), "error").when(F.col("verdict") == "RETRY", "capture_retry").when(same, "ok").otherwise("mismatch")
    return out.select(
        "fixture", status.alias("status"), "verdict", F.when(F.size("expected") > 0, "VIOLATION").otherwise("PASS").alias("expected_verdict"), "expected", "failed",
        F.array_except("expected", "failed").alias("missing_fail"), F.array_except("failed", "expected").alias("extra_fail"), *counts,
    )


def summary(outcomes: DataFrame) -> DataFrame:
    """Counts by status; rule tp, fp, fn, precision, recall without retries and errors; field rate with them."""
    scored = ~F.col("status").isin("capture_retry", "error")
    total = lambda c: F.sum(F.when(scored, c).otherwise(0))
    of = lambda s: F.count_if(F.col("status") == s)
    tp, fp, fn = total(F.size(F.array_intersect("expected", "failed"))), total(F.size("extra_fail")), total(F.size("missing_fail"))
    ok, every = F.sum("fields_ok"), F.sum(F.col("fields_ok") + F.col("fields_missing") + F.col("fields_mismatch"))
    return outcomes.agg(
        F.count("*").alias("fixtures"), of("ok").alias("ok"), of("mismatch").alias("mismatch"), of("capture_retry").alias("capture_retry"), of("error").alias("errors"),
        tp.alias("rule_tp"), fp.alias("rule_fp"), fn.alias("rule_fn"), F.try_divide(tp, tp + fp).alias("rule_precision"), F.try_divide(tp, tp + fn).alias("rule_recall"),
        F.try_divide(ok, every).alias("field_extraction_rate"),
    )


def options_from_truth(truth: DataFrame) -> DataFrame:
    """Ground-truth dimensions as audit options; options that are given win. truth: fixture, dims struct, options struct."""
    pick = lambda opt, dim: F.coalesce(F.col(f"options.{opt}"), F.when(F.col(f"dims.{dim}") != 0, F.col(f"dims.{dim}")))
    return truth.select("fixture", pick("package_height_cm", "height").alias("package_height_cm"), pick("package_width_cm", "width").alias("package_width_cm"), pick("package_diameter_cm", "diameter").alias("package_diameter_cm"), pick("total_surface_cm2", "total_surface").alias("total_surface_cm2"))


def validate_truth(truth: DataFrame) -> DataFrame:
    """fixture, problem rows of ground-truth entries that break the form: shape, dims struct, n_fields."""
    flat = F.col("shape").isin("rectangular", "pouch") & ~F.coalesce((F.col("dims.height") > 0) & (F.col("dims.width") > 0), F.lit(False))
    problems = F.array(
        F.when(~F.coalesce(F.col("shape").isin(*SHAPES), F.lit(False)), "shape is not one of the known ones"),
        F.when(flat, "flat shapes want height and width"),
        F.when(F.coalesce(F.col("n_fields") <= 0, F.lit(True)), "fields required"),
    )
    return truth.select("fixture", F.explode(F.filter(problems, lambda x: x.isNotNull())).alias("problem"))
