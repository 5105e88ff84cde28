"""Display areas, scales, quality gates, detections and regions of interest."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from labelaudit.functions import fixed_values as V

LABELS = ("PACKAGE", "PDP", "PRICE", "BARCODE", "BOP")


def positive(c: Column) -> Column:
    return F.when(c.cast("double") > 0, c.cast("double"))


def display_area(shape: Column, height: Column, width: Column, diameter: Column, total: Column, image_diameter_mm: Column) -> Column:
    """struct(pda_cm2, pda_method): round shapes need height and a diameter and fall through to nothing else."""
    h, w, d, t, i = (positive(c) for c in (height, width, diameter, total, image_diameter_mm))
    kind = F.lower(F.coalesce(shape, F.lit("")))
    made = lambda area, tag: F.struct(area.alias("pda_cm2"), F.lit(tag).alias("pda_method"))
    round_area = lambda across: F.lit(0.40) * h * F.lit(math.pi) * across
    none = made(F.lit(None).cast("double"), "")
    return (
        F.when(kind.isin(*V.ROUND_SHAPES), F.when(h.isNotNull() & d.isNotNull(), made(round_area(d), "inspector-dims")).when(h.isNotNull() & i.isNotNull(), made(round_area(i / 10), "aruco-cylindrical")).otherwise(none))
        .when(kind.isin(*V.FLAT_SHAPES) & h.isNotNull() & w.isNotNull(), made(h * w, "inspector-dims"))
        .when(t.isNotNull(), made(F.lit(0.40) * t, "inspector-dims"))
        .when(h.isNotNull() & w.isNotNull(), made(h * w, "inspector-dims"))
        .otherwise(none)
    )


def sane_area(supplied: Column, computed: Column) -> Column:
    """The supplied area, else the computed one at two decimals if it is plausible."""
    return F.coalesce(supplied, F.when(computed.between(*V.PDA_SANITY), F.bround(computed, 2)))


def effective_shape(hint: Column, detected: Column) -> Column:
    return F.coalesce(F.nullif(hint, F.lit("")), detected)


def scale_gate(mm_per_px: Column, pda: Column) -> Column:
    """Prompt of a scan that has neither scale nor area; null if it may go on."""
    return F.when(mm_per_px.isNull() & pda.isNull(), "Calibration marker not found — hold the card in frame or enter pack dimensions")


def calibration_warnings(mm_per_px: Column, pose_mm_per_px: Column, tilt_deg: Column) -> Column:
    off = F.abs(pose_mm_per_px - mm_per_px) / mm_per_px > 0.15
    return F.filter(F.array(F.when(off, "scale mismatch"), F.when(tilt_deg > 25.0, "tilt")), lambda x: x.isNotNull())


def quality_gate(scans: DataFrame) -> DataFrame:
    """scan_id, ok, prompts: a device's own refusal comes first, then blur and glare."""
    said = F.coalesce("prompts", F.array().cast("array<string>"))
    refused = F.coalesce(~F.col("ok"), F.lit(False))
    measured = F.filter(F.array(F.when(F.col("laplacian_var") < V.BLUR_MIN, "Image is blurred — hold steady and refocus"), F.when(F.col("glare_pct") > V.GLARE_MAX_PCT, "Glare on the label — tilt the package")), lambda x: x.isNotNull())
    prompts = F.when(refused, F.when(F.size(said) > 0, said).otherwise(F.array(F.lit("Capture again")))).otherwise(measured)
    return scans.select("scan_id", (~refused & (F.size(prompts) == 0)).alias("ok"), prompts.alias("prompts"))


def marker_scale(markers: DataFrame) -> DataFrame:
    """scan_id, mm_per_px from the largest marker's four corners (x1..y4) and its side; under 25 square pixels is none."""
    x, y = [F.col(f"x{k}") for k in range(1, 5)], [F.col(f"y{k}") for k in range(1, 5)]
    area = F.abs(sum(x[k] * y[(k + 1) % 4] - x[(k + 1) % 4] * y[k] for k in range(4))) / 2
    sized = markers.withColumn("area", area)
    best = sized.groupBy("scan_id").agg(F.max("area").alias("area"), F.max_by("side_mm", F.struct("area", "side_mm")).alias("side_mm"))
    return best.where("area >= 25").select("scan_id", F.round(F.col("side_mm") / F.sqrt("area"), 6).alias("mm_per_px"))


def iou(a: Column, b: Column) -> Column:
    across = F.greatest(F.lit(0.0), F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"]))
    down = F.greatest(F.lit(0.0), F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"]))
    shared = across * down
    union = a["w"] * a["h"] + b["w"] * b["h"] - shared
    return F.when(union <= 0, F.lit(0.0)).otherwise(shared / union)


def suppress_detections(detections: DataFrame, least: float = 0.25, overlap: float = 0.45, most: int = 20, size: float = 640.0) -> DataFrame:
    """image_id, label, score, x, y, w, h: best class, letterbox undone, greedy suppression per class.

    detections: image_id, anchor, cx, cy, w, h (0..1), scores array<double>, gain, pad_x, pad_y. Equal scores go by anchor.
    """
    best = F.array_max(F.transform("scores", lambda s, i: F.struct(s.alias("score"), (-i).alias("at"))))
    px = lambda c: F.col(c) * size
    boxed = detections.withColumn("b", best).select(
        "image_id", "anchor", (-F.col("b.at")).alias("class"), F.col("b.score").alias("score"),
        ((px("cx") - px("w") * 0.5 - F.col("pad_x")) / F.col("gain")).alias("x"), ((px("cy") - px("h") * 0.5 - F.col("pad_y")) / F.col("gain")).alias("y"),
        (px("w") / F.col("gain")).alias("w"), (px("h") / F.col("gain")).alias("h"),
    ).where(F.col("score") >= least)
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("order"), "anchor", "score", "x", "y", "w", "h")))
    per = boxed.groupBy("image_id", "class").agg(ranked.alias("d"))
    kind = per.schema["d"].dataType.simpleString()
    start = F.array().cast(kind)
    kept = F.aggregate("d", start, lambda k, d: F.when((F.size(k) < most) & ~F.exists(k, lambda o: iou(d, o) > overlap), F.concat(k, F.array(d))).otherwise(k))
    label = F.element_at(F.array(*[F.lit(x) for x in LABELS]), F.col("class") + 1)
    return per.select("image_id", label.alias("label"), F.explode(kept).alias("k")).select("image_id", "label", "k.score", "k.x", "k.y", "k.w", "k.h")


def unmatched_detections(reference: DataFrame, candidate: DataFrame, least: float = 0.35, least_iou: float = 0.85, score_gap: float = 0.05) -> DataFrame:
    """Reference detections without a like candidate: same label, box and score."""
    r, c = reference.where(F.col("score") >= least).alias("r"), candidate.alias("c")
    box = lambda t: {k: F.col(f"{t}.{k}") for k in "xywh"}
    like = (F.col("r.image_id") == F.col("c.image_id")) & (F.col("r.label") == F.col("c.label")) & (iou(box("r"), box("c")) >= least_iou) & (F.abs(F.col("r.score") - F.col("c.score")) <= score_gap)
    return r.join(c, like, "left_anti")


def excess_detections(reference: DataFrame, candidate: DataFrame, extra: int = 3) -> DataFrame:
    """image_id, reference, candidate of images for which the candidate has more detections than the reference and some extra."""
    count = lambda rows, name: rows.groupBy("image_id").agg(F.count("*").alias(name))
    both = count(candidate, "candidate").join(count(reference, "reference"), "image_id", "left").na.fill(0, ["reference"])
    return both.where(F.col("candidate") > F.col("reference") + extra).select("image_id", "reference", "candidate")


def tensor_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Largest absolute difference of boxes (rows 0 to 3) and of scores (rows from 4 on)."""
    both = a.withColumnRenamed("value", "left").join(b.withColumnRenamed("value", "right"), ["row", "col"])
    gap = F.abs(F.col("left") - F.col("right"))
    return both.agg(F.max(F.when(F.col("row") < 4, gap)).alias("box_diff"), F.max(F.when(F.col("row") >= 4, gap)).alias("score_diff"))


def merge_rois(classical: DataFrame, boxes: DataFrame) -> DataFrame:
    """scan_id, ord, roi, x, y, w, h, conf, source: detected boxes by score, then classical regions of other labels as given."""
    whole = lambda c: F.bround(c).cast("int").alias(c)
    ml = boxes.select("scan_id", F.col("label").alias("roi"), *[whole(c) for c in "xywh"], F.col("score").alias("conf"), F.lit("ml").alias("source"), F.lit(0).alias("pos"))
    rest = classical.join(ml.select("scan_id", "roi").distinct(), ["scan_id", "roi"], "left_anti")
    rest = rest.select("scan_id", "roi", *"xywh", "conf", F.lit("classical").alias("source"), F.col("pos"))
    order = Window.partitionBy("scan_id").orderBy(F.when(F.col("source") == "ml", 0).otherwise(1), F.when(F.col("source") == "ml", -F.col("conf")), F.when(F.col("source") == "ml", F.col("roi")), "pos")
    return ml.unionByName(rest).withColumn("ord", F.row_number().over(order)).drop("pos")


def merged_rois(boxes: Column, classical: Column | None = None) -> Column:
    """As merge_rois for one scan's arrays: array<struct<roi, x, y, w, h, conf>>, detected boxes by score, then classical regions of other labels."""
    whole = lambda b: [F.bround(b[c]).cast("int").alias(c) for c in "xywh"]
    ranked = F.sort_array(F.transform(boxes, lambda b, i: F.struct((-b["score"]).alias("rank"), b["label"].alias("roi"), i.alias("pos"), *whole(b), b["score"].cast("double").alias("conf"))))
    found = F.transform(ranked, lambda b: F.struct(b["roi"].alias("roi"), *[b[c].alias(c) for c in "xywh"], b["conf"].alias("conf")))
    if classical is None:
        return found
    rest = F.filter(classical, lambda c: ~F.exists(boxes, lambda b: b["label"] == c["roi"]))
    return F.concat(found, F.transform(rest, lambda c: F.struct(c["roi"].alias("roi"), *[F.get(c["bbox"], F.lit(k)).cast("int").alias(n) for k, n in enumerate("xywh")], c["conf"].cast("double").alias("conf"))))


def roi_box_error(kind: DataType, boxes: Column, frame_w: Column, frame_h: Column) -> Column:
    """What is wrong with the boxes of regions (an array of this type); null if nothing is."""
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    b = F.coalesce(boxes, F.array().cast(kind))
    bad = lambda test: F.exists(b, test)
    return (
        F.when(F.size(b) == 0, F.lit(None).cast("string"))
        .when(F.size(b) > 64, "too many roi_boxes")
        .when(F.coalesce((frame_w <= 0) | (frame_h <= 0), F.lit(True)), "invalid frame")
        .when(bad(lambda x: ~F.coalesce(x["label"].isin(*LABELS), F.lit(False))), "unknown label")
        .when(bad(lambda x: ~(finite(x["score"]) & x["score"].between(0, 1))), "score out of range")
        .when(bad(lambda x: ~(finite(x["x"]) & finite(x["y"]) & finite(x["w"]) & finite(x["h"]))), "box not finite")
        .when(bad(lambda x: (x["w"] <= 0) | (x["h"] <= 0)), "non-positive size")
    )


def validate_roi_boxes(scans: DataFrame) -> DataFrame:
    """scan_id, error (null: valid), boxes clamped to the frame; boxes outside it are dropped.

    scans: scan_id, frame_w, frame_h, roi_boxes array<struct<label, score, x, y, w, h>>.
    """
    kind = scans.schema["roi_boxes"].dataType
    error = roi_box_error(kind, F.col("roi_boxes"), F.col("frame_w"), F.col("frame_h"))
    clamped = clamped_boxes(kind, F.col("roi_boxes"), F.col("frame_w"), F.col("frame_h"))
    return scans.select("scan_id", error.alias("error"), F.when(error.isNull(), clamped).alias("boxes"))


def clamped_boxes(kind: DataType, boxes: Column, frame_w: Column, frame_h: Column) -> Column:
    """Boxes cut at their frame; those outside it are dropped."""
    b = F.coalesce(boxes, F.array().cast(kind))
    clamp = lambda v, top: F.least(F.greatest(v, F.lit(0.0)), top)

    def inside(x: Column) -> Column:
        left, up = clamp(x["x"], frame_w.cast("double")), clamp(x["y"], frame_h.cast("double"))
        return F.struct(x["label"].alias("label"), x["score"].alias("score"), left.alias("x"), up.alias("y"), F.least(x["w"], frame_w - left).alias("w"), F.least(x["h"], frame_h - up).alias("h"))

    return F.filter(F.transform(b, inside), lambda x: (x["w"] > 0) & (x["h"] > 0))


def shift_boxes(rows: DataFrame, origins: DataFrame) -> DataFrame:
    """Boxes moved by each scan's crop origin (ox, oy)."""
    moved = rows.join(origins.select("scan_id", "ox", "oy"), "scan_id", "left")
    return moved.withColumns({"x": F.col("x") + F.coalesce("ox", F.lit(0)), "y": F.col("y") + F.coalesce("oy", F.lit(0))}).drop("ox", "oy")


def normalise_boxes(annotations: DataFrame) -> DataFrame:
    """Pixel boxes to class, centre and size in shares of the image, six decimals."""
    share = lambda c, whole: F.round(c / F.col(whole), 6)
    return annotations.select(
        "image_id", "class_id", share(F.col("x") + F.col("w") / 2, "img_w").alias("cx"), share(F.col("y") + F.col("h") / 2, "img_h").alias("cy"),
        share(F.col("w"), "img_w").alias("bw"), share(F.col("h"), "img_h").alias("bh"),
    )


def dataset_stats(annotations: DataFrame, classes: DataFrame, validation: int) -> DataFrame:
    """split, class_id, boxes: the first `validation` images are val; classes without a box count 0."""
    split = F.when(F.col("image_no") < validation, "val").otherwise("train")
    counted = annotations.groupBy(split.alias("split"), "class_id").agg(F.count("*").alias("boxes"))
    every = classes.select("class_id").withColumn("split", F.explode(F.array(F.lit("val"), F.lit("train"))))
    return every.join(counted, ["split", "class_id"], "left").na.fill(0, ["boxes"])


def calibration_agreement(a: DataFrame, b: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Two calibration runs of the same image: relative difference of scale, and whether both fall on the same side of each gate."""
    both = a.alias("a").join(b.alias("b"), F.col("a.image_sha256") == F.col("b.image_sha256"))
    gap = F.abs(F.col("a.mm_per_px") - F.col("b.mm_per_px")) / F.col("a.mm_per_px")
    same = lambda c, limit: (F.col(f"a.{c}") < limit) == (F.col(f"b.{c}") < limit)
    return both.select(F.col("a.image_sha256"), gap.alias("scale_gap"), (gap <= tolerance).alias("scale_ok"), same("laplacian_var", V.BLUR_MIN).alias("blur_same"), same("glare_pct", V.GLARE_MAX_PCT).alias("glare_same"))
