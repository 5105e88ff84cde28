"""Field extraction against known layouts and a plain sequential statement of the same law."""

import random

import pytest

from labelaudit.functions import fixed_values as V
from labelaudit.operators import extract

SCHEMA = "scan_id string, tok int, text string, x int, y int, w int, h int, conf double"


def frame(spark, scans):
    return spark.createDataFrame([(s, k, *t, 0.9) for s, tokens in scans.items() for k, t in enumerate(tokens)], SCHEMA)


LAYOUTS = {
    "split": ([("Net Quantity:", 10, 10, 100, 20), ("200 g", 120, 12, 50, 20)], {"net_qty": "Net Quantity: 200 g"}),
    "three": ([("MRP", 10, 10, 40, 20), ("Rs", 60, 10, 20, 20), ("50.00", 90, 10, 40, 20)], {"mrp": "MRP Rs 50.00"}),
    "wrapped": ([("Net Weight", 10, 10, 100, 20), ("500 g", 15, 38, 60, 20)], {"net_qty": "Net Weight 500 g"}),
    "gap": ([("Net Qty", 10, 10, 60, 20), ("200 g", 144, 10, 40, 20)], {}),
    "foreign": ([("Net Qty", 10, 10, 60, 20), ("MRP", 80, 10, 30, 20), ("Rs 20", 120, 10, 40, 20)], {"mrp": "MRP Rs 20"}),
    "address": ([("Mfd. by:", 10, 10, 80, 20), ("Tasty Foods", 100, 10, 80, 20), ("Plot 21, Goa", 10, 40, 120, 20), ("403001", 10, 70, 60, 20)], {"mfg_address": "Mfd. by: Tasty Foods Plot 21, Goa 403001"}),
    "loose price": ([("Rs 0.25 / g", 10, 10, 90, 20)], {"usp": "Rs 0.25 / g"}),
    "name": ([("Noodles", 10, 10, 200, 60), ("Fresh", 10, 90, 50, 20), ("Net Qty 70 g", 10, 130, 120, 20)], {"product_name": "Noodles", "net_qty": "Net Qty 70 g"}),
}


@pytest.fixture(scope="module")
def found(spark):
    rows = extract.extract_fields(frame(spark, {k: v[0] for k, v in LAYOUTS.items()})).collect()
    return {k: {r["field"]: r["raw"] for r in rows if r["scan_id"] == k} for k in LAYOUTS}


@pytest.mark.parametrize("key", list(LAYOUTS))
def test_layouts(found, key):
    wanted = LAYOUTS[key][1]
    assert {f: found[key].get(f) for f in wanted} == wanted
    if key == "gap":
        assert "net_qty" not in found[key]


def plain_lines(tokens):
    """Lines of one scan by hand: (y, x, place) order, growing box."""
    lines, box = [], None
    for k in sorted(range(len(tokens)), key=lambda k: (tokens[k][2], tokens[k][1], k)):
        _, _, y, _, h = tokens[k]
        if box:
            shared = min(box[1], y + h) - max(box[0], y)
            if shared > 0 and shared / max(1, min(box[1] - box[0], h)) >= V.LINE_OVERLAP:
                lines[-1].append(k)
                box = (min(box[0], y), max(box[1], y + h))
                continue
        lines.append([k])
        box = (y, y + h)
    return lines


def random_scans(n):
    rnd = random.Random(4)
    words = ["Net Qty", "MRP", "Rs 20", "200 g", "Unit Sale Price", "0.25 / g", "Mfd. by", "care", "Made in India", "PIN 403001", "hello", "Helpline"]
    return {f"s{i}": [(rnd.choice(words), rnd.randint(0, 300), rnd.randint(0, 160), rnd.randint(5, 90), rnd.randint(8, 30)) for _ in range(rnd.randint(1, 12))] for i in range(n)}


def test_lines_of_random_layouts(spark):
    scans = random_scans(150)
    rows = extract.cluster_lines(frame(spark, scans)).collect()
    for key, tokens in scans.items():
        mine = {}
        for r in rows:
            if r["scan_id"] == key:
                mine.setdefault(r["line"], []).append((r["place"], r["tok"]))
        assert [[t for _, t in sorted(mine[k])] for k in sorted(mine)] == plain_lines(tokens)


def test_input_order_does_not_matter_without_ties(spark):
    scans = {k: [(t, x + 7 * i, y + 3 * i, w, h) for i, (t, x, y, w, h) in enumerate(v)] for k, v in random_scans(40).items()}
    a = sorted(map(tuple, extract.extract_fields(frame(spark, scans)).select("scan_id", "field", "raw").collect()))
    b = sorted(map(tuple, extract.extract_fields(frame(spark, {k: v[::-1] for k, v in scans.items()})).select("scan_id", "field", "raw").collect()))
    assert a == b


def test_merge_words(spark):
    words = {"a": [("Net", 10, 10, 30, 20), ("Qty", 50, 12, 30, 20), ("MRP", 10, 60, 30, 20), ("70 g", 90, 11, 30, 20)]}
    rows = extract.merge_words(frame(spark, words)).orderBy("tok").collect()
    assert [(r["text"], r["x"], r["y"], r["w"], r["h"]) for r in rows] == [("Net Qty 70 g", 10, 10, 110, 22), ("MRP", 10, 60, 30, 20)]


def overlap(a, b, c, d):
    shared = min(b, d) - max(a, c)
    return shared / max(1, min(b - a, d - c)) if shared > 0 else 0


class PlainScan:
    """The regions of one scan by hand: tokens in reading order, rays, the line below, paragraphs."""

    def __init__(self, tokens):
        lines = plain_lines(tokens)
        self.t = [(*tokens[k], n) for n, line in enumerate(lines) for k in line]  # text, x, y, w, h, line

    def line(self, n):
        return [k for k, t in enumerate(self.t) if t[5] == n]

    def box(self, places):
        return min(self.t[k][1] for k in places), min(self.t[k][2] for k in places), max(self.t[k][1] + self.t[k][3] for k in places), max(self.t[k][2] + self.t[k][4] for k in places)

    def ray(self, a, anchored):
        _, x, _, w, h, line = self.t[a]
        reach, out = x + w, []
        for k in sorted((k for k in self.line(line) if k != a and self.t[k][1] >= x + w - V.RIGHT_SLACK * h), key=lambda k: (self.t[k][1], k)):
            if anchored[k] or self.t[k][1] - reach > V.SAME_LINE_GAP * h:
                break
            out.append(k)
            reach = max(reach, self.t[k][1] + self.t[k][3])
        return out

    def regions(self, a, paragraph, anchored):
        _, x, y, w, h, line = self.t[a]
        right = self.ray(a, anchored)
        if not paragraph:
            out = [[a]] + ([[a, *right]] if right else [])
            below = self.line(line + 1)
            if below:
                bx, by, bx2, _ = self.box(below)
                if by - (y + h) <= V.BELOW_GAP * h and overlap(x, x + w, bx, bx2) >= V.BELOW_OVERLAP:
                    out.append([a, *right, *(k for k in below if not anchored[k])])
            return out
        held = [a, *right]
        for n in range(line + 1, line + V.PARAGRAPH_LINES):
            more = self.line(n)
            if not more or any(anchored[k] for k in more):
                break
            left, _, far, bottom = self.box(held)
            bx, by, bx2, _ = self.box(more)
            if by - bottom > V.PARAGRAPH_GAP * h or overlap(left, far, bx, bx2) < V.PARAGRAPH_OVERLAP:
                break
            held += more
        return [held]


def test_regions_of_random_layouts(spark):
    """Every region looked at, against the same law in plain loops."""
    from pyspark.sql import functions as F

    from labelaudit.operators import folds

    scans = random_scans(150)
    arrays = folds.with_lines(extract.token_arrays(frame(spark, scans)))
    read = F.col("__read")
    out = arrays.withColumn("__a", F.transform(F.filter(read, lambda t: F.size(t["specs"]) > 0), lambda a: a.withField("ray", folds.ray(read, a))))
    found = F.flatten(F.transform("__a", lambda a: F.flatten(F.transform(a["specs"], lambda s: folds.regions_of(F.col("__boxes"), a, s)))))
    for r in out.select("scan_id", F.transform(read, lambda t: t["specs"]).alias("specs"), found.alias("regions")).collect():
        scan, anchored = PlainScan(scans[r["scan_id"]]), [bool(s) for s in r["specs"]]
        want = [(s, a, sorted(places)) for a, specs in enumerate(r["specs"]) for s in specs for places in scan.regions(a, s in folds.PARAGRAPHS, anchored)]
        assert [(x["spec"], x["anchor"], sorted(x["places"])) for x in r["regions"]] == want


def test_from_tokens_to_verdicts_nothing_is_shuffled(spark):
    from labelaudit.plans import queries

    plan = queries.audit_tokens(spark, "/root/testdata/sf0.1")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan and "Window" not in plan


def test_a_text_is_normalised_and_searched_once(spark):
    """Lambdas work out every mention of a value anew: each pattern stands once where it is needed."""
    from pyspark.sql import functions as F

    from labelaudit.functions import text as T
    from labelaudit.operators import folds

    row = spark.createDataFrame([(["Net Qty 5 g"],)], "t array<string>")
    read = lambda f: row.select(F.transform("t", f).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert read(T.month).count("regexp_extract(") == 7 and read(T.quantity).count("regexp_extract(") == 2
    wanted = read(lambda t: folds.accepted(F.lit(0) + F.length(t) % 7, t))
    assert wanted.count("regexp_replace(") <= 5 and wanted.count("regexp_extract(") <= 11
    assert read(lambda t: F.size(folds.specs_of(t))).count("RLIKE") == len(folds.SPECS)


def test_anchors_begin_with_their_letters():
    import re

    for field, patterns in V.ANCHORS.items():
        firsts = {x[0] for p in patterns for x in re.sub(r"^(?:\\b|\^)?(?:\(\?:)?", "", p).split("|")[: 2 if p.startswith("^") else 1]}
        assert firsts == set(V.ANCHOR_LETTERS[field])


def test_plain_texts_are_what_squash_leaves(spark):
    from pyspark.sql import functions as F

    from labelaudit.functions import text as T

    texts = ["a b", "a  b", " a", "a ", "a\n", "\na", "a\tb", "", " ", "5 cm²", "₨ 5", "₹ 5", "a b", "é", "x " * 50_000 + "x", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.squash(F.col("t")).alias("s"), T.lettered(F.col("t"), 3).alias("l"), (T.letters(F.col("t")) >= 3).alias("n")).collect()
    for r in rows:
        whole = " ".join((r["t"] or "").replace("²", "2").replace("₨", "Rs").split())
        assert r["s"] == (whole or None) and r["l"] == r["n"]


def test_verdicts_need_no_messages(spark):
    from labelaudit.plans import queries

    plan = queries.audit_tokens(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "No prohibited unit symbols" not in plan and "Date of manufacture" not in plan


def test_the_first_engine_is_looked_for_once(spark):
    from pyspark.sql import functions as F

    from labelaudit.operators import folds

    row = spark.createDataFrame([([("a", "tesseract"), ("b", "mlkit"), ("c", None), ("d", "mlkit")],), ([("a", "other")],), ([],), (None,)], "t array<struct<text:string,engine:string>>")
    made = F.transform("t", lambda t: F.struct(F.upper(t["text"]).alias("text"), t["engine"].alias("engine")))
    out = row.select(folds.first_engine(made).alias("x"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("upper(") == 1
    assert [None if r["x"] is None else [t["text"] for t in r["x"]] for r in out.collect()] == [["B", "D"], [], [], None]
