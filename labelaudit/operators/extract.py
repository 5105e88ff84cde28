"""Tables of OCR tokens to lines, fields and labels; the work on one scan's tokens is in folds.

tokens: scan_id, tok (place in the input, breaks ties), text, x, y, w, h int, conf double. Everything keeps the
partitioning by scan_id; a scan has tens of tokens, so its lists stay small whatever the number of scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelaudit.functions import fixed_values as V
from labelaudit.operators import folds
from labelaudit.operators.folds import overlap


def cluster_lines(tokens: DataFrame) -> DataFrame:
    """tokens with their line: in reading order a token joins the line before if it overlaps that line's growing box."""
    columns = [c for c in tokens.columns if c not in ("scan_id", "y", "x", "tok")]
    sorted_tokens = F.sort_array(F.collect_list(F.struct("y", "x", "tok", *columns)))
    per = tokens.groupBy("scan_id").agg(sorted_tokens.alias("t"))
    start = F.struct(F.lit(-1).alias("line"), F.lit(0).alias("top"), F.lit(0).alias("bottom"), F.array().cast("array<int>").alias("lines"))

    def step(s: Column, t: Column) -> Column:
        bottom = t["y"] + t["h"]
        joins = (s["line"] >= 0) & (overlap(s["top"], s["bottom"], t["y"], bottom) >= V.LINE_OVERLAP)
        line = F.when(joins, s["line"]).otherwise(s["line"] + 1)
        return F.struct(
            line.alias("line"),
            F.when(joins, F.least(s["top"], t["y"])).otherwise(t["y"]).cast("int").alias("top"),
            F.when(joins, F.greatest(s["bottom"], bottom)).otherwise(bottom).cast("int").alias("bottom"),
            F.concat(s["lines"], F.array(line)).alias("lines"),
        )

    folded = per.select("scan_id", "t", F.aggregate("t", start, step, lambda s: s["lines"]).alias("lines"))
    zipped = folded.select("scan_id", F.posexplode(F.arrays_zip("t", "lines")).alias("place", "z"))
    return zipped.select("scan_id", "place", "z.t.*", F.col("z.lines").alias("line"))


def merge_words(words: DataFrame) -> DataFrame:
    """Words to line tokens: each word goes to the first line, of all, that it overlaps; text in x order, least conf, union box."""
    per = words.groupBy("scan_id").agg(F.sort_array(F.collect_list(F.struct("y", "x", "tok", "text", "w", "h", "conf"))).alias("t"))
    boxes = "array<struct<top:int,bottom:int>>"
    start = F.struct(F.array().cast(boxes).alias("boxes"), F.array().cast("array<int>").alias("lines"))

    def step(s: Column, t: Column) -> Column:
        bottom = t["y"] + t["h"]
        fits = F.transform(s["boxes"], lambda b: overlap(b["top"], b["bottom"], t["y"], bottom) >= V.LINE_OVERLAP)
        at = F.array_position(fits, F.lit(True)).cast("int")
        new = F.struct(t["y"].cast("int").alias("top"), bottom.cast("int").alias("bottom"))
        grown = F.transform(s["boxes"], lambda b, i: F.when(i == at - 1, F.struct(F.least(b["top"], t["y"]).cast("int").alias("top"), F.greatest(b["bottom"], bottom).cast("int").alias("bottom"))).otherwise(b))
        line = F.when(at > 0, at - 1).otherwise(F.size(s["boxes"]))
        return F.struct(F.when(at > 0, grown).otherwise(F.concat(s["boxes"], F.array(new))).alias("boxes"), F.concat(s["lines"], F.array(line)).alias("lines"))

    placed = per.select("scan_id", F.posexplode(F.arrays_zip("t", F.aggregate("t", start, step, lambda s: s["lines"]).alias("line"))).alias("place", "z"))
    placed = placed.select("scan_id", "place", F.col("z.t.*"), F.col("z.line").alias("line"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x", "place", "text"))), lambda s: s["text"]), " ")
    out = placed.groupBy("scan_id", "line").agg(
        text.alias("text"), F.min("x").alias("x"), F.min("y").alias("y"), (F.max(F.col("x") + F.col("w")) - F.min("x")).alias("w"),
        (F.max(F.col("y") + F.col("h")) - F.min("y")).alias("h"), F.bround(F.min("conf"), 3).alias("conf"),
    )
    return out.withColumnRenamed("line", "tok")


def token_arrays(tokens: DataFrame) -> DataFrame:
    """scan_id and tokens: one row a scan, as folds.with_fields reads it."""
    return tokens.groupBy("scan_id").agg(F.collect_list(F.struct("tok", "text", "x", "y", "w", "h", "conf")).alias("tokens"))


def field_rows(scans: DataFrame) -> DataFrame:
    """A row for each element of `fields`. Outer, then filtered: a filter inferred below would work the folds out twice."""
    return scans.select("scan_id", F.inline_outer("fields")).where("field is not null")


def extract_fields(tokens: DataFrame, scans: DataFrame | None = None) -> DataFrame:
    """scan_id, field, raw, value_dec, value_date, unit, x, y, w, h, conf, font_mm: at most one row per scan and field.

    scans: scan_id and mm_per_px, for the heights of letters. Tokens are shuffled once, to one row a scan; the rest is
    projections of that row.
    """
    arrays = token_arrays(tokens)
    if scans is not None:
        arrays = arrays.join(scans.select("scan_id", F.col("mm_per_px").cast("double").alias("mm_per_px")), "scan_id", "left")
    return field_rows(folds.with_fields(arrays, mm_per_px=None if scans is None else "mm_per_px"))


NOTHING_DECLARED = "No statutory declarations recognized — capture the principal display face"


def value_text(value_dec: Column | None = None, value_date: Column | None = None) -> Column:
    """What was decoded of a field: a number without closing zeros, or a date; null if nothing was."""
    number = (F.col("value_dec") if value_dec is None else value_dec).cast("string")
    plain = F.when(number.contains("."), F.regexp_replace(number, r"\.?0+$", "")).otherwise(number)
    return F.coalesce(plain, (F.col("value_date") if value_date is None else value_date).cast("string"))


def decoded_fields(fields: DataFrame) -> DataFrame:
    """scan_id, ord, field, value, raw, conf: the table of decoded fields of a dossier, in the order of fixed_values.FIELDS.

    value: what was decoded, then the unit; "-" where nothing was.
    """
    said = F.when(value_text().isNotNull(), F.concat_ws(" ", value_text(), "unit")).otherwise("-")
    place = F.array_position(F.array(*[F.lit(f) for f in V.FIELDS]), F.col("field")).cast("int")
    return fields.select("scan_id", place.alias("ord"), "field", said.alias("value"), "raw", F.bround("conf", 2).alias("conf"))


def stage_flags(fields: DataFrame, tokens: DataFrame) -> DataFrame:
    """scan_id, ok, prompt of every scan with tokens: ok needs a field besides the product name."""
    per = fields.groupBy("scan_id").agg(F.count_if(F.col("field") != "product_name").alias("n"))
    out = tokens.select("scan_id").distinct().join(per, "scan_id", "left")
    ok = F.coalesce(F.col("n") > 0, F.lit(False))
    return out.select("scan_id", ok.alias("ok"), F.when(~ok, NOTHING_DECLARED).alias("prompt"))


def to_labels(fields: DataFrame) -> DataFrame:
    """One row per scan, as the rule engine reads it."""
    pick = lambda c, f: F.max(F.when(F.col("field") == f, F.col(c)))
    return fields.groupBy("scan_id").agg(
        *[pick("raw", f).alias(f) for f in V.FIELDS],
        pick("value_dec", "net_qty").alias("qty_value"), pick("unit", "net_qty").alias("qty_unit"), pick("value_dec", "mrp").alias("mrp_value"),
        pick("font_mm", "net_qty").alias("height_net_qty"), pick("font_mm", "mrp").alias("height_mrp"),
    )


def pick_ocr_tier(tokens: DataFrame) -> DataFrame:
    """Per scan the tokens of the first engine, in fixed order, that gave any; others are left out."""
    rank = F.array_position(F.array(*[F.lit(t) for t in V.OCR_TIERS]), F.col("engine"))
    ranked = tokens.withColumn("tier", rank).where("tier > 0")
    return ranked.withColumn("best", F.min("tier").over(Window.partitionBy("scan_id"))).where("tier = best").drop("tier", "best")


def clean_words(words: DataFrame, least_conf: float = 35.0) -> DataFrame:
    """OCR words to tokens: blanks, doubtful ones, punctuation and empty boxes go; boxes in the frame's own pixels."""
    text = F.trim("text")
    fine = (text != "") & (F.col("conf") >= least_conf) & text.rlike(r"[\p{L}\p{N}/]") & (F.col("w") > 0) & (F.col("h") > 0)
    back = lambda c: F.bround(F.col(c) / F.col("scale")).cast("int")
    return words.where(fine).select(
        "scan_id", "tok", text.alias("text"), back("x").alias("x"), back("y").alias("y"), F.greatest(F.lit(1), back("w")).alias("w"), F.greatest(F.lit(1), back("h")).alias("h"),
        F.bround(F.least(F.lit(1.0), F.col("conf") / 100), 3).alias("conf"),
    )
