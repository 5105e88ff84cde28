"""Laws on raw JSON documents, key by key, in `variant`: what is missing, unknown or of a wrong type, at any depth.

A law takes a value (SQL null: its key is absent) and its path and gives the faults there, in order, as an array of
(path, message); laws of objects, lists and maps are made of those of their parts. What stands at a fixed place of the
document is read by its place, without a lambda: Spark compiles such laws and only interprets those inside lists and maps. A document's faults are thus one
projection of its row: nothing is shuffled and no schema is forced on the text before it has been judged. JSON tells
12 from 12.0 and true from "true", and so do the laws. Text that isn't JSON, or has a key twice, is one fault.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelaudit.functions import fixed_values as V
from labelaudit.operators import contract, geometry
from labelaudit.sources import tables

VARIANT_MAP, VARIANTS = "map<string,variant>", "array<variant>"
#: The same without what they hold: lists of lists don't occur, and scalars that aren't lists are null at no cost.
KEYS, MEMBERS = "map<string,array<array<array<boolean>>>>", "array<array<array<boolean>>>"
MISSING = "missing key"
NOTHING = "cast(array() as array<struct<path:string,message:string>>)"
NO_JSON = "not a JSON document"
#: From SQL of a value and of its path, and whether a value that isn't there is a missing key, to SQL of its faults: text, since a law has thousands of nodes and Spark parses
#: them in a moment, but building them one by one as columns takes many seconds.
Law = Callable[..., str]
#: What a value must be, as SQL of its kind {k} and itself {v}, and what is said if it isn't.
Test = tuple[str, str]
numbers = itertools.count()
AT = "try_variant_get(doc, "

STRING, FLAG, WHOLE = "{k} = 'STRING'", "{k} = 'BOOLEAN'", "{k} = 'BIGINT'"
TEXT_OF, NUMBER_OF = "try_variant_get({v}, '$', 'string')", "try_variant_get({v}, '$', 'double')"
NUMBER = f"{{k}} rlike '^(BIGINT|DECIMAL|DOUBLE|FLOAT)' and abs({NUMBER_OF}) < double('infinity')"


def quoted(text: str) -> str:
    return f"'{text}'"


def listing(names: tuple[str, ...]) -> str:
    return ", ".join(map(quoted, names))


def lambda_of(body: Callable[..., str], n: int = 1) -> str:
    """A lambda of n variables that no other has."""
    names = [f"x{next(numbers)}" for _ in range(n)]
    return f"{names[0] if n == 1 else '(' + ', '.join(names) + ')'} -> {body(*names)}"


def fault(broken: str, path: str, message: str) -> str:
    return f"if(coalesce({broken}, false), array(named_struct('path', {path}, 'message', {quoted(message)})), {NOTHING})"


def under(path: str, key: str) -> str:
    if path == "''":
        return key
    return quoted(f"{path[1:-1]}.{key[1:-1]}") if path[0] == key[0] == "'" else f"concat({path}, '.', {key})"


def place_of(v: str) -> str | None:
    """The place in doc that SQL of a value reads, as in '$.quality'; null if it's a variable of a lambda or part of one."""
    if v == "doc":
        return "$"
    return v.removeprefix(AT).removesuffix(", 'variant')")[1:-1] if v.startswith(AT) else None


def value(*tests: Test, null: bool = False, absent: bool = False) -> Law:
    """A value that passes all tests; the first that it fails answers.

    null: JSON's null is fine; absent: so is a key that isn't there.
    """

    def law(v: str, path: str, missing: bool = False) -> str:
        first = quoted(tests[0][1])
        failed = " ".join(f"when not coalesce({fine.format(k=f'schema_of_variant({v})', v=v)}, false) then {quoted(message)}" for fine, message in tests)
        gone = quoted(MISSING) if missing else "null" if absent else first
        said = f"case when {v} is null then {gone} when is_variant_null({v}) then {'null' if null else first} {failed} end"
        return f"if({said} is null, {NOTHING}, array(named_struct('path', {path}, 'message', {said})))"

    return law


def text(message: str, filled: bool = False, **free: bool) -> Law:
    """A string; filled: not an empty one."""
    return value((f"{STRING} and {TEXT_OF} <> ''" if filled else STRING, message), **free)


def one_of(message: str, names: tuple[str, ...], **free: bool) -> Law:
    return value((f"{STRING} and {TEXT_OF} in ({listing(names)})", message), **free)


def number(message: str, fine: str = "", **free: bool) -> Law:
    """A finite number; fine: what else holds of it, as in "> 0"."""
    return value((f"{NUMBER} and {NUMBER_OF} {fine}" if fine else NUMBER, message), **free)


def box(message: str, **free: bool) -> Law:
    """x, y, w, h: integers as JSON writes them (12.0 isn't one), w and h above 0."""
    parts = f"try_variant_get({{v}}, '$', '{VARIANTS}')"
    signs = " and ".join(f"try_variant_get({{v}}, '$[{k}]', 'double') {sign} 0" for k, sign in enumerate((">=", ">=", ">", ">")))
    return value((f"size({parts}) = 4 and forall({parts}, e -> schema_of_variant(e) = 'BIGINT') and {signs}", message), **free)


def held(kind: str, message: str, inside: Callable[[str, str, str], str], null: bool, absent: bool, named: bool = False) -> Law:
    """A map or list of variants, judged inside (itself, as one value, its path) if it is one; named: as a variable of a lambda."""

    def law(v: str, path: str, missing: bool = False) -> str:
        free = " or ".join(["false", *([f"{v} is null"] if absent else []), *([f"coalesce(is_variant_null({v}), false)"] if null else [])])
        odd = fault(f"not ({free})", path, message)
        if missing:
            odd = f"if({v} is null, {fault('true', path, MISSING)}, {odd})"
        opened = lambda m: f"if({m} is not null, {inside(m, v, path)}, {odd})"
        at = place_of(v)
        if at and not named:
            # what it is and which keys it has: its parts are read by their places, and copies of them cost much
            known = f"{AT}'{at}', '{KEYS if kind == VARIANT_MAP else MEMBERS}')"
            return f"if({known} is not null, {inside(known if kind == VARIANT_MAP else f"{AT}'{at}', '{kind}')", v, path)}, {odd})"
        return f"get(transform(array(try_variant_get({v}, '$', '{kind}')), {lambda_of(opened)}), 0)"

    return law


def record(parts: dict[str, Law], exact: bool = True, null: bool = False, absent: bool = False, message: str = "must be an object") -> Law:
    """An object: an exact one has all of its keys and no other; of any other one, keys without a law are let through."""

    def inside(m: str, v: str, path: str) -> str:
        found, place = [NOTHING], place_of(v)
        if exact and parts:
            row = lambda k: f"named_struct('path', {under(path, k)}, 'message', 'unknown key')"
            unknown = f"array_except(map_keys({m}), array({listing(tuple(parts))}))"
            found.append(f"if(size({unknown}) = 0, {NOTHING}, transform(sort_array({unknown}), {lambda_of(row)}))")
        for key, law in parts.items():
            at, w = under(path, quoted(key)), f"{AT}'{place}.{key}', 'variant')" if place else f"{m}['{key}']"
            found.append(law(w, at, missing=exact))
        return f"concat({', '.join(found)})"

    return held(VARIANT_MAP, message, inside, null, absent)


def listed(each: Law, message: str = "must be a list", filled: bool = False, null: bool = False, absent: bool = False) -> Law:
    """A list whose members all keep one law; filled: not an empty one."""

    def inside(items: str, v: str, path: str) -> str:
        member = lambda x, k: each(x, f"concat({path}, '[', string({k}), ']')")
        found = f"flatten(transform({items}, {lambda_of(member, 2)}))"
        return f"if(size({items}) = 0, {fault('true', path, message)}, {found})" if filled else found

    return held(VARIANTS, message, inside, null, absent)


def mapped(each: Law, keys: tuple[str, ...] | None = None, unknown: str = "unknown key") -> Law:
    """An object of any keys, or of some of those given, whose values all keep one law."""

    def inside(m: str, v: str, path: str) -> str:
        def entry(k: str) -> str:
            at = under(path, k)
            strange = fault(f"{k} not in ({listing(keys)})", at, unknown) if keys else NOTHING
            return f"concat({strange}, {each(f'{m}[{k}]', at)})"

        return f"flatten(transform(array_sort(map_keys({m})), {lambda_of(entry)}))"

    return held(VARIANT_MAP, "must be an object", inside, False, False, named=True)


# ---- requests ----------------------------------------------------------------------------------------------------
POSITIVE, FROM_ZERO, SHARE = "> 0", ">= 0", "between 0 and 1"
OPTIONAL = {"null": True, "absent": True}
BOX = "must be [x, y, w, h] in integers, w and h above 0"
#: Options read as numbers also from text; empty text is none.
OPTION_NUMBERS = ("package_height_cm", "package_width_cm", "package_diameter_cm", "total_surface_cm2", "marker_side_mm", "camera_focal_px")
OPTION_PIXELS = ("cylinder_left_px", "cylinder_right_px")
OPTION_FLAGS = ("institutional", "fast_food", "blown", "blown_or_molded", "dossier_on_pass")


def lenient(kind: str, message: str, *more: Test) -> Law:
    """A number, or text that reads as one, or empty text."""
    empty = f"({STRING} and {TEXT_OF} = '')"
    return value((f"{empty} or try_variant_get({{v}}, '$', '{kind}') is not null", message), *[(f"{empty} or ({fine})", said) for fine, said in more], **OPTIONAL)


def request_law() -> Law:
    """What a request of tokens must keep, in the order in which faults answer. Keys without a law are let through."""
    shape = lambda m: one_of(m, V.SHAPES, **OPTIONAL)
    token = {
        "text": text("must be a non-empty string", filled=True), "bbox": box(BOX), "conf": number("must be in 0..1", SHARE, absent=True),
        "engine": one_of("must be a known engine", contract.ENGINES, absent=True), "lang": text("must be a string", absent=True),
    }
    quality = {
        "ok": value((FLAG, "must be true, false or null"), **OPTIONAL), "prompts": listed(text("must be a string"), absent=True),
        **{k: number("must be a number or null", **OPTIONAL) for k in ("laplacian_var", "glare_pct")}, "glare_bbox": box(BOX, **OPTIONAL),
    }
    region = {"roi": text("must be a string"), "bbox": box(BOX), "conf": number("must be in 0..1", SHARE, absent=True)}
    area = {
        "shape": shape("must be a shape or null"), "shape_detected": shape("must be a shape or null"),
        **{k: number("must be a positive number or null", POSITIVE, **OPTIONAL) for k in ("mm_per_px", "pda_cm2")},
        "pda_method": text("must be a string or null", **OPTIONAL), "rois": listed(record(region, exact=False), absent=True),
    }
    found = {"label": text("must be a string"), **{k: number("must be a number") for k in ("score", "x", "y", "w", "h")}}
    glyph = {"glyph": text("must be a non-empty string", filled=True), "height_mm": number("must be above 0", POSITIVE), "width_mm": number("must not be negative", FROM_ZERO)}
    place = {k: number("must be a number") for k in ("lat", "lon")}
    options = {
        **{k: value((FLAG, "must be true or false"), **OPTIONAL) for k in OPTION_FLAGS}, "commodity": text("must be a string", **OPTIONAL),
        **{k: lenient("double", "must be a number", (f"{NUMBER_OF} > 0 and {NUMBER_OF} < double('infinity')", "must be positive")) for k in OPTION_NUMBERS},
        **{k: lenient("bigint", "must be an integer") for k in OPTION_PIXELS},
    }
    loose = lambda parts: record(parts, exact=False, **OPTIONAL)
    return record(
        {
            "schema_version": number(f"schema {V.SCHEMA_VERSION} expected", f"= {V.SCHEMA_VERSION}", absent=True),
            "scan_id": text("must be a non-empty string", filled=True),
            "tokens": listed(record(token, exact=False), "must be a non-empty list", filled=True),
            "quality": loose(quality), "geometry": loose(area), "roi_boxes": listed(record(found, exact=False), **OPTIONAL), "roi_frame": loose({}),
            "glyphs": listed(record(glyph, exact=False), **OPTIONAL), "image_b64": text("must be a string", **OPTIONAL), "image_sha256": text("must be a string", **OPTIONAL),
            "shape_hint": one_of("must be a shape", ("", *V.SHAPES), **OPTIONAL), "captured_utc": value((f"{TEXT_OF} = '' or try_to_timestamp({TEXT_OF}) is not null", "must be ISO-8601"), **OPTIONAL),
            "gps": loose(place), "device": loose({}), "options": loose(options),
        },
        exact=False,
    )


def with_faults(docs: DataFrame, law: Law, column: str = "value") -> DataFrame:
    """docs with doc (variant, null for what isn't JSON) and faults; a text that is null is no JSON."""
    read = docs.withColumn("doc", F.try_parse_json(column))
    return read.withColumn("faults", F.expr(f"if(doc is null, {fault('true', quoted(''), NO_JSON)}, {law('doc', quoted(''))})"))


def split_texts(texts: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """Requests with the columns of sources.tables.REQUEST, and rejects (scan_id, code, path, message, stage), out of JSON texts.

    Each field is judged by itself, then regions are held against their frame. A request with text for a number in options has the number; a device's description is kept as JSON text.
    """
    judged = with_faults(texts.select(column), request_law(), column)
    kind = tables.REQUEST.removesuffix(", _corrupt string")
    first = F.get("faults", F.lit(0))
    code = F.when(first["path"] == "schema_version", "UNSUPPORTED_VERSION").otherwise("BAD_REQUEST")
    blown = F.try_variant_get("doc", "$.options.blown", "boolean")
    read = F.when(F.size("faults") == 0, F.try_variant_get("doc", "$", f"struct<{kind.replace(' ', ':').replace(',:', ',')}>"))
    made = F.struct(F.try_variant_get("doc", "$.scan_id", "string").alias("scan_id"), code.alias("code"), first["path"].alias("path"), first["message"].alias("message"), read.alias("r"), blown.alias("blown"))
    # a list of one, taken apart again: filters on what it holds aren't pushed below it, where they'd work the law out once more
    once = judged.select(F.explode_outer(F.array(made)).alias("m")).select("m.*")
    odd = once.where("path is not null").select("scan_id", "code", "path", "message", F.lit("validate").alias("stage"))
    typed = once.where("path is null").select("r.*", "blown", F.lit(None).cast("string").alias("_corrupt"))
    typed = typed.withColumn("options", F.when(F.col("options").isNotNull(), F.col("options").withField("blown_or_molded", F.coalesce("blown", "options.blown_or_molded")))).drop("blown")
    boxes = geometry.roi_box_error(typed.schema["roi_boxes"].dataType, F.col("roi_boxes"), F.col("roi_frame.w"), F.col("roi_frame.h"))
    framed = typed.withColumn("problem", boxes)
    strange = framed.where("problem is not null").select("scan_id", F.lit("BAD_REQUEST").alias("code"), F.lit("roi_boxes").alias("path"), F.col("problem").alias("message"), F.lit("validate").alias("stage"))
    return framed.where("problem is null").drop("problem"), odd.unionByName(strange)


# ---- results -----------------------------------------------------------------------------------------------------
ISO = "^[0-9]{{4}}-[0-9][0-9]-[0-9][0-9]T[0-9][0-9]:[0-9][0-9]:[0-9][0-9][.][0-9]{{3}}Z$"
#: Stages whose time a result may hold; results are delivered after that, so delivery has none.
STAGES = ("s1_frame_quality", "s2_geometry_detect", "s3_calibration", "s4_ocr", "s5_field_extract", "s6_metrology", "s7_dossier")
VERDICTS, STATUSES = ("PASS", "VIOLATION", "RETRY"), ("PASS", "FAIL", "NA")
REGIONS, SIGNED = ("PACKAGE", "PDP", "BOP", "PRICE", "BARCODE"), ("pending", "signed", "unsupported")


def result_law() -> Law:
    """The 17 keys of a result and what each may hold."""
    time = value((f"{STRING} and {TEXT_OF} rlike '{ISO}'", "not an ISO time in UTC with milliseconds"))
    from_zero = number("must be a finite number from 0", FROM_ZERO)
    maybe_number = number("must be a number or null", null=True)
    string, maybe_string = text("must be a string"), text("must be a string or null", null=True)
    some = text("must be a non-empty string", filled=True)
    count = value((f"{WHOLE} and {NUMBER_OF} >= 0", "must be an integer from 0"))
    share, shape = number("must be in 0..1", SHARE), one_of("must be a shape or null", V.SHAPES, null=True)
    engine = one_of("must be a known engine", contract.ENGINES)
    flag, anything = value((FLAG, "must be true or false")), value(("true", ""), null=True)
    maybe_object = record({}, exact=False, null=True)
    return record({
        "schema_version": number(f"schema {V.SCHEMA_VERSION} expected", f"= {V.SCHEMA_VERSION}"), "scan_id": string,
        "verdict": one_of("must be PASS, VIOLATION or RETRY", VERDICTS), "captured_utc": time, "completed_utc": time,
        "total_ms": from_zero, "timings_ms": mapped(from_zero, STAGES, "not a stage with a time"),
        "quality": record({"ok": value((FLAG, "must be true, false or null"), null=True), "laplacian_var": maybe_number, "glare_pct": maybe_number, "prompts": listed(string), "glare_bbox": box(BOX, null=True)}),
        "geometry": record({"shape": shape, "shape_detected": shape, "mm_per_px": maybe_number, "pda_cm2": maybe_number, "pda_method": maybe_string,
                            "rois": listed(record({"roi": one_of("must be a region", REGIONS), "bbox": box(BOX), "conf": share}))}, null=True),
        "ocr": record({"engines_used": listed(engine), "tokens": listed(record({"text": string, "bbox": box(BOX), "conf": share, "engine": engine, "lang": string}))}),
        "fields": mapped(record({"raw": string, "value": text("must be a string (amounts are text) or null", null=True), "unit": maybe_string, "bbox": box(BOX, null=True), "conf": number("must be a number")})),
        "checks": listed(record({"rule": some, "status": one_of("must be PASS, FAIL or NA", STATUSES), "message": some, "plain": string, "citation": some, "evidence_bbox": box(BOX, null=True)})),
        "exemption": record({"exempt": flag, "clause": maybe_string, "note": string}, null=True),
        "summary": record({k: count for k in ("total", "pass", "fail", "na")}),
        "dossier": record({"sha256": value((f"{STRING} and {TEXT_OF} rlike '^[0-9a-f]{{{{64}}}}$'", "must be 64 hex digits")), "pdf_path": maybe_string, "signed": flag,
                           "signature": anything, "cert_pem": anything, "sig_status": one_of("must be pending, signed or unsupported", SIGNED)}, null=True),
        "meta": record({k: maybe_object for k in ("gps", "device", "options")}, null=True),
        "error": record({"code": one_of("unknown error code", contract.ERRORS), "message": string, "stage": maybe_string}, null=True),
    })


def result_faults(results: DataFrame, column: str = "value", key: str | None = None) -> DataFrame:
    """Rows (key, ord, path, message): each fault of result documents as JSON text; key: their scan_id if no column is named.

    After the law of keys and types: counts of the summary are those of checks, an error needs RETRY, and RETRY without
    an error needs a prompt.
    """
    of = lambda path, kind: f"try_variant_get(doc, '$.{path}', '{kind}')"
    checks, verdict, error = of("checks", VARIANTS), of("verdict", "string"), of("error", "variant")
    counts = {"total": f"size({checks})", **{s.lower(): f"size(filter({checks}, c -> coalesce(try_variant_get(c, '$.status', 'string') = '{s}', false)))" for s in STATUSES}}
    across = [
        *[(f"summary.{k}", f"{checks} is not null and {of(f'summary.{k}', 'bigint')} <> {n}", f"{k} differs from checks") for k, n in counts.items()],
        ("error", f"{error} is not null and not is_variant_null({error}) and {verdict} <> 'RETRY'", "an error needs verdict RETRY"),
        ("quality.prompts", f"is_variant_null({error}) and {verdict} = 'RETRY' and size({of('quality.prompts', VARIANTS)}) = 0", "RETRY without error needs a prompt"),
    ]
    judged = with_faults(results.select(column, F.col(key).alias("key")) if key else results.select(column), result_law(), column)
    judged = judged if key else judged.withColumn("key", F.expr(of("scan_id", "string")))
    more = F.expr(f"concat({', '.join(fault(broken, quoted(path), message) for path, broken, message in across)})")
    # a column of its own: what stands inside the explosion is interpreted
    judged = judged.select("key", F.concat("faults", more).alias("all"))
    return judged.select("key", F.posexplode_outer("all").alias("ord", "f")).where("f is not null").select("key", "ord", "f.path", "f.message")
