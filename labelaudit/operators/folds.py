"""Label fields as folds over one scan's array of tokens: no join, no window, no exchange.

A row holds a scan and its tokens, array<struct<tok, text, x, y, w, h, conf, ...>>, tens of them. Lines, rays to the
right of an anchor, paragraphs below it and the choice of regions are folds (`aggregate`) over that array, so a plan from
requests to findings is one projection after another, and a scan's columns stay beside its fields.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelaudit.functions import fixed_values as V
from labelaudit.functions import text as T

SPECS = tuple(V.ANCHORS)
PARAGRAPHS = [SPECS.index(s) for s in ("mfg_address", "consumer_care")]
BOX = "struct<x:int,y:int,x2:int,y2:int,foreign:boolean,places:array<int>,free:array<int>>"
RAY = "struct<reach:int,stopped:boolean,places:array<int>,x:int,y:int,x2:int,y2:int>"
REGION = "struct<spec:int,anchor:int,level:int,places:array<int>>"
TAKEN = "struct<field:string,raw:string,x:int,y:int,x2:int,y2:int,conf:double,places:array<int>>"
#: An element of the column `fields`.
FIELD = "struct<field:string,raw:string,value_dec:decimal(14,4),value_date:date,unit:string,x:int,y:int,w:int,h:int,conf:double,font_mm:double>"


def none(kind: str) -> Column:
    return F.lit(None).cast(kind)


def empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def overlap(lo_a: Column, hi_a: Column, lo_b: Column, hi_b: Column) -> Column:
    """Shared length of two intervals over the shorter one; 0 if they don't meet."""
    shared = F.least(hi_a, hi_b) - F.greatest(lo_a, lo_b)
    return F.when(shared > 0, shared / F.greatest(F.lit(1), F.least(hi_a - lo_a, hi_b - lo_b))).otherwise(F.lit(0.0))


def specs_of(text: Column) -> Column:
    """Places in SPECS of the vocabularies that a text meets."""
    hits = [F.when(T.has(text, f"(?=[{V.ANCHOR_LETTERS[s]}])(?:{'|'.join(V.ANCHORS[s])})"), F.lit(k)) for k, s in enumerate(SPECS)]
    return F.filter(F.array(*hits), lambda x: x.isNotNull())


def in_reading_order(tokens: Column) -> Column:
    """Tokens by y, x and place in the input, with far corners and what anchors they hold."""
    ordered = F.sort_array(F.transform(tokens, lambda t: F.struct(t["y"].alias("y"), t["x"].alias("x"), t["tok"].alias("tok"), t["text"].alias("text"), t["w"].alias("w"), t["h"].alias("h"), t["conf"].cast("double").alias("conf"))))
    return F.transform(
        ordered,
        lambda t, i: F.struct(
            i.alias("place"), t["tok"].alias("tok"), t["text"].alias("text"), *(t[c].cast("int").alias(c) for c in ("x", "y", "w", "h")), (t["x"] + t["w"]).cast("int").alias("x2"),
            (t["y"] + t["h"]).cast("int").alias("y2"), t["conf"].alias("conf"), specs_of(t["text"]).alias("specs"),
        ),
    )


def line_fold(read: Column) -> Column:
    """struct(lines: the line of each token, boxes: BOX of each line): a token joins the line before if it overlaps its growing box."""
    start = F.struct(empty("int").alias("lines"), empty(BOX).alias("boxes"), none(BOX).alias("now"))

    def step(s: Column, t: Column) -> Column:
        now, anchored = s["now"], F.size(t["specs"]) > 0
        joins = now.isNotNull() & (overlap(now["y"], now["y2"], t["y"], t["y2"]) >= V.LINE_OVERLAP)
        own, free = F.array(t["place"]), F.when(anchored, empty("int")).otherwise(F.array(t["place"]))
        grown = F.struct(
            F.least(now["x"], t["x"]).alias("x"), F.least(now["y"], t["y"]).alias("y"), F.greatest(now["x2"], t["x2"]).alias("x2"), F.greatest(now["y2"], t["y2"]).alias("y2"),
            (now["foreign"] | anchored).alias("foreign"), F.concat(now["places"], own).alias("places"), F.concat(now["free"], free).alias("free"),
        )
        fresh = F.struct(t["x"].alias("x"), t["y"].alias("y"), t["x2"].alias("x2"), t["y2"].alias("y2"), anchored.alias("foreign"), own.alias("places"), free.alias("free"))
        boxes = F.when(joins | now.isNull(), s["boxes"]).otherwise(F.concat(s["boxes"], F.array(now)))
        return F.struct(F.concat(s["lines"], F.array(F.size(boxes))).alias("lines"), boxes.alias("boxes"), F.when(joins, grown).otherwise(fresh).cast(BOX).alias("now"))

    done = lambda s: F.struct(s["lines"].alias("lines"), F.when(s["now"].isNull(), s["boxes"]).otherwise(F.concat(s["boxes"], F.array(s["now"]))).alias("boxes"))
    return F.aggregate(read, start, step, done)


def ray(read: Column, a: Column) -> Column:
    """RAY of the tokens right of an anchor on its line, up to the first gap or anchor."""
    beside = F.filter(read, lambda t: (t["line"] == a["line"]) & (t["place"] != a["place"]) & (t["x"] >= a["x2"] - V.RIGHT_SLACK * a["h"]))
    along = F.sort_array(F.transform(beside, lambda t: F.struct(t["x"].alias("x"), t["place"].alias("place"), t["y"].alias("y"), t["x2"].alias("x2"), t["y2"].alias("y2"), (F.size(t["specs"]) > 0).alias("anchored"))))
    start = F.struct(a["x2"].alias("reach"), F.lit(False).alias("stopped"), empty("int").alias("places"), *(none("int").alias(c) for c in ("x", "y", "x2", "y2")))

    def step(s: Column, t: Column) -> Column:
        stopped = s["stopped"] | t["anchored"] | (t["x"] - s["reach"] > V.SAME_LINE_GAP * a["h"])
        grown = F.struct(
            F.greatest(s["reach"], t["x2"]).alias("reach"), F.lit(False).alias("stopped"), F.concat(s["places"], F.array(t["place"])).alias("places"),
            F.least(s["x"], t["x"]).alias("x"), F.least(s["y"], t["y"]).alias("y"), F.greatest(s["x2"], t["x2"]).alias("x2"), F.greatest(s["y2"], t["y2"]).alias("y2"),
        )
        ended = F.struct(s["reach"].alias("reach"), F.lit(True).alias("stopped"), *(s[c].alias(c) for c in ("places", "x", "y", "x2", "y2")))
        return F.when(stopped, ended).otherwise(grown).cast(RAY)

    return F.aggregate(along, start.cast(RAY), step)


def regions_of(boxes: Column, a: Column, spec: Column) -> Column:
    """REGIONs looked at for an anchor with its ray: itself, with the ray, with the line below; or a paragraph."""
    own, right = F.array(a["place"]), a["ray"]["places"]
    region = lambda level, places: F.struct(spec.alias("spec"), a["place"].alias("anchor"), F.lit(level).alias("level"), places.alias("places"))
    below = F.get(boxes, a["line"] + 1)
    close = below.isNotNull() & (below["y"] - a["y2"] <= V.BELOW_GAP * a["h"]) & (overlap(a["x"], a["x2"], below["x"], below["x2"]) >= V.BELOW_OVERLAP)
    values = F.array(region(1, own), F.when(F.size(right) > 0, region(2, F.concat(own, right))), F.when(close, region(3, F.concat(own, right, below["free"]))))

    grown = "struct<stopped:boolean,places:array<int>,x:int,x2:int,y2:int>"
    start = F.struct(F.lit(False).alias("stopped"), empty("int").alias("places"), F.least(a["x"], a["ray"]["x"]).alias("x"), F.greatest(a["x2"], a["ray"]["x2"]).alias("x2"), F.greatest(a["y2"], a["ray"]["y2"]).alias("y2"))

    def step(s: Column, b: Column) -> Column:
        stopped = s["stopped"] | b["foreign"] | (b["y"] - s["y2"] > V.PARAGRAPH_GAP * a["h"]) | (overlap(s["x"], s["x2"], b["x"], b["x2"]) < V.PARAGRAPH_OVERLAP)
        more = F.struct(F.lit(False).alias("stopped"), F.concat(s["places"], b["places"]).alias("places"), F.least(s["x"], b["x"]).alias("x"), F.greatest(s["x2"], b["x2"]).alias("x2"), F.greatest(s["y2"], b["y2"]).alias("y2"))
        return F.when(stopped, s.withField("stopped", F.lit(True))).otherwise(more).cast(grown)

    paragraph = F.aggregate(F.slice(boxes, a["line"] + 2, V.PARAGRAPH_LINES - 1), start.cast(grown), step, lambda s: s["places"])
    found = F.when(spec.isin(*PARAGRAPHS), F.array(region(4, F.concat(own, right, paragraph)))).otherwise(values)
    return F.filter(found, lambda r: r.isNotNull())


def accepted(spec: Column, text: Column) -> Column:
    """Whether a region's text holds what the field needs."""
    typed = {"net_qty": lambda x: T.has(x, V.QUANTITY), "mrp": lambda x: T.money_lenient(x).isNotNull(), "usp": lambda x: T.has(x, V.UNIT_PRICE), "mfg_date": lambda x: T.month(x).isNotNull()}
    fits = (F.length(F.trim(text)) >= V.LEAST_TEXT) & T.lettered(text, V.LEAST_LETTERS)

    def holds(norm: Column) -> Column:
        return reduce(lambda out, name: out.when(spec == SPECS.index(name), typed[name](norm)), typed, F.when(F.lit(False), F.lit(False)))

    return F.coalesce(F.when(spec.isin(*map(SPECS.index, typed)), T.once(T.squashed(text), holds)).otherwise(fits), F.lit(False))


def taken_of(read: Column, r: Column) -> Column:
    """TAKEN of a region: its text in reading order, its box and least confidence, from its members."""
    by_spec = F.element_at(F.array(*[F.lit(s) for s in SPECS]), r["spec"] + 1)

    def taken(members: Column) -> Column:
        of = lambda c: F.transform(members, lambda t: t[c])
        return F.struct(
            by_spec.alias("field"), F.array_join(of("text"), " ").alias("raw"), F.array_min(of("x")).alias("x"), F.array_min(of("y")).alias("y"), F.array_max(of("x2")).alias("x2"),
            F.array_max(of("y2")).alias("y2"), F.bround(F.array_min(of("conf")), 3).alias("conf"), r["places"].alias("places"),
        ).cast(TAKEN)

    return T.once(F.transform(F.sort_array(r["places"]), lambda place: F.get(read, place)), taken)


def chosen(read: Column, regions: Column) -> Column:
    """The first acceptable region of each field, in order of field and anchor; an anchor serves one field.

    Regions of a field that is found, or of an anchor that serves one, aren't read.
    """

    def step(picked: Column, r: Column) -> Column:
        over = F.exists(picked, lambda p: (p["spec"] == r["spec"]) | (p["anchor"] == r["anchor"]))
        here = F.struct(r["spec"].alias("spec"), r["anchor"].alias("anchor"), taken_of(read, r).alias("t"))
        return F.when(over, picked).otherwise(F.concat(picked, F.filter(F.array(here), lambda p: accepted(p["spec"], p["t"]["raw"]))))

    picked = F.aggregate(regions, empty(f"struct<spec:int,anchor:int,t:{TAKEN}>"), step)
    return F.transform(picked, lambda p: p["t"])


def lone(t: Column, field: str) -> Column:
    """A token by itself as a field."""
    return F.struct(F.lit(field).alias("field"), t["text"].alias("raw"), *(t[c].alias(c) for c in ("x", "y", "x2", "y2")), F.bround(t["conf"], 3).alias("conf"), F.array(t["place"]).alias("places")).cast(TAKEN)


def name_rank(t: Column, top: Column, bottom: Column) -> Column:
    """Least for the token that names the product: high on the label, tall, large, then first."""
    high = t["y"] + t["h"] / 2 <= top + V.TOP_SHARE * (bottom - top)
    return F.struct((~high).alias("low"), (-t["h"]).alias("height"), (-(t["w"] * t["h"])).alias("size"), t["y"].alias("y"), t["x"].alias("x"), t["tok"].alias("tok"), t["place"].alias("place"))


def decoded(f: Column, mm_per_px: Column) -> Column:
    """FIELD of a chosen region."""
    height, empty_date = f["y2"] - f["y"], none("date")
    parsed = lambda value=none("decimal(14,4)"), date=empty_date, unit=none("string"): F.struct(value.alias("value"), date.alias("date"), unit.alias("unit"))  # noqa: E731, B008
    measured = lambda x: parsed(x["value"], unit=x["unit"])
    typed = {
        "net_qty": lambda x: T.once(T.quantity(x), measured), "mrp": lambda x: parsed(T.money_lenient(x)), "usp": lambda x: T.once(T.unit_price(x), measured), "mfg_date": lambda x: parsed(date=T.month(x)),
    }
    read = lambda x: reduce(lambda out, name: out.when(f["field"] == name, typed[name](x)), typed, F.when(F.lit(False), parsed()))
    return T.once(
        F.when(f["field"].isin(*typed), T.once(T.squashed(f["raw"]), read)),
        lambda v: F.struct(
            f["field"].alias("field"), f["raw"].alias("raw"), v["value"].alias("value_dec"), v["date"].alias("value_date"), v["unit"].alias("unit"), f["x"].alias("x"), f["y"].alias("y"),
            (f["x2"] - f["x"]).alias("w"), height.alias("h"), f["conf"].alias("conf"), F.when(mm_per_px > 0, F.bround(height * mm_per_px, 3)).alias("font_mm"),
        ).cast(FIELD),
    )


def with_lines(scans: DataFrame, tokens: str = "tokens") -> DataFrame:
    """scans with __read (tokens in reading order, with place and line) and __boxes (BOX of each line)."""
    out = scans.withColumn("__order", in_reading_order(F.col(tokens))).withColumn("__fold", line_fold(F.col("__order")))
    read = F.transform("__order", lambda t: t.withField("line", F.get(F.col("__fold.lines"), t["place"])))
    return out.withColumns({"__read": read, "__boxes": F.col("__fold.boxes")}).drop("__order", "__fold")


def with_fields(scans: DataFrame, tokens: str = "tokens", mm_per_px: str | None = "mm_per_px") -> DataFrame:
    """scans with fields, an array of FIELD, at most one a field; mm_per_px names the column of scales for heights of letters."""
    read, boxes = F.col("__read"), F.col("__boxes")
    out = with_lines(scans, tokens)
    anchors = F.transform(F.filter(read, lambda t: F.size(t["specs"]) > 0), lambda a: a.withField("ray", ray(read, a)))
    out = out.withColumn("__anchors", anchors)
    found = F.flatten(F.transform("__anchors", lambda a: F.flatten(F.transform(a["specs"], lambda s: regions_of(boxes, a, s)))))
    out = out.withColumn("__regions", F.sort_array(F.coalesce(found, empty(REGION))))
    out = out.withColumn("__taken", chosen(read, F.col("__regions")))

    # what is left: a unit price without an anchor, and the product name
    used = F.flatten(F.transform("__taken", lambda t: t["places"]))
    out = out.withColumn("__used", used).withColumn("__rest", F.filter(read, lambda t: (F.size(t["specs"]) == 0) & ~F.array_contains("__used", t["place"])))
    priced = F.exists("__taken", lambda t: t["field"] == "usp")
    price = F.when(~priced, F.get(F.filter("__rest", lambda t: T.has(T.squashed(t["text"]), V.UNIT_PRICE)), F.lit(0)))
    out = out.withColumns({"__price": price, "__top": F.array_min(F.transform(read, lambda t: t["y"])), "__bottom": F.array_max(F.transform(read, lambda t: t["y2"]))})
    named = F.filter("__rest", lambda t: T.lettered(t["text"], V.LEAST_LETTERS) & ~F.coalesce(t["place"] == F.col("__price.place"), F.lit(False)))
    best = F.array_min(F.transform(named, lambda t: name_rank(t, F.col("__top"), F.col("__bottom"))))
    out = out.withColumn("__name", F.get(read, best["place"]))
    more = F.filter(F.array(F.when(F.col("__price").isNotNull(), lone(F.col("__price"), "usp")), F.when(F.col("__name").isNotNull(), lone(F.col("__name"), "product_name"))), lambda x: x.isNotNull())
    out = out.withColumn("__taken", F.concat("__taken", more))
    scale = F.col(mm_per_px) if mm_per_px else none("double")
    return out.withColumn("fields", F.transform("__taken", lambda f: decoded(f, scale))).drop("__read", "__boxes", "__anchors", "__regions", "__taken", "__used", "__rest", "__price", "__name", "__top", "__bottom")


def label_columns() -> list[Column]:
    """One column for each text and typed value of `fields`, as the rule engine reads them."""
    one = {f: F.get(F.filter("fields", lambda x: x["field"] == f), F.lit(0)) for f in V.FIELDS}  # noqa: B023
    return [
        *(one[f]["raw"].alias(f) for f in V.FIELDS),
        one["net_qty"]["value_dec"].alias("qty_value"), one["net_qty"]["unit"].alias("qty_unit"), one["mrp"]["value_dec"].alias("mrp_value"),
        one["net_qty"]["font_mm"].alias("height_net_qty"), one["mrp"]["font_mm"].alias("height_mrp"),
    ]


def declared() -> Column:
    """Whether there is a field besides the product name."""
    return F.exists("fields", lambda f: f["field"] != "product_name")


def first_engine(tokens: Column) -> Column:
    """The tokens of the first engine, in fixed order, that gave any."""
    tiers = F.array(*[F.lit(t) for t in V.OCR_TIERS])
    rank = lambda t: F.array_position(tiers, t["engine"])
    best = lambda all_of: F.array_min(F.filter(F.transform(all_of, rank), lambda k: k > 0))
    return T.once(tokens, lambda all_of: T.once(best(all_of), lambda k: F.filter(all_of, lambda t: rank(t) == k)))
