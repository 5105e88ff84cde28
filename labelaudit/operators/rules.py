"""The rule engine: one row of label fields in, one row per finding out.

Input columns: scan_id and the texts of fixed_values.FIELDS (null: not found). Optional: qty_value decimal, qty_unit,
mrp_value decimal (typed values win over texts), institutional, fast_food, commodity, pda_cm2, blown, height_net_qty,
height_mrp (mm). All rules are column expressions over one row, so a whole table is audited in one pass without a
shuffle; only glyph widths (rule 7(3)) come from another table.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelaudit.functions import fixed_values as V
from labelaudit.functions import text as T

OPTIONAL = {
    "qty_value": "decimal(14,4)", "qty_unit": "string", "mrp_value": "decimal(14,4)", "institutional": "boolean",
    "fast_food": "boolean", "commodity": "string", "pda_cm2": "double", "blown": "boolean",
    "height_net_qty": "double", "height_mrp": "double",
}
CHECK = "struct<rule:string,status:string,message:string,field:string>"


def prepared(labels: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Every column the rules read, texts normalised once, values typed once; and the columns in keep as they are."""
    have = set(labels.columns)
    base = labels.select(
        "scan_id",
        *(keep or []),
        *[T.squash(F.col(c)).alias(c) if c in have else F.lit(None).cast("string").alias(c) for c in V.FIELDS],
        *[F.col(c).cast(t).alias(c) if c in have else F.lit(None).cast(t).alias(c) for c, t in OPTIONAL.items()],
    )
    parsed = base.withColumns({"qty": T.quantity(F.col("net_qty")), "price": T.unit_price(F.col("usp")), "mrp_digits": T.money_lenient_digits(F.col("mrp"))})
    typed = F.col("qty_value").isNotNull()
    return parsed.withColumns(
        {
            "q": F.coalesce("qty_value", "qty.value"),
            "u": F.when(typed, F.coalesce("qty_unit", F.lit(""))).otherwise(F.col("qty.unit")),
            "m": F.coalesce(F.col("mrp_value"), T.money(F.col("mrp"))),
            "goods": F.lower(F.coalesce(F.nullif("commodity", F.lit("")), "product_name", F.lit(""))),
            "maker_pin": T.pin(F.col("mfg_address")),
            **_matches(),
        }
    )


def _matches() -> dict[str, Column]:
    """What each pattern finds, as columns of their own: findings and their messages read them several times."""
    address, care, mrp = F.col("mfg_address"), F.col("consumer_care"), F.col("mrp")
    text = F.coalesce("origin", "mfg_address")
    tail = T.origin_tail(text)
    return {
        "bad_in_qty": T.first_prohibited(F.col("net_qty")),
        "bad_in_usp": T.first_prohibited(F.col("usp")),
        "mrp_worded": T.has(mrp, V.MRP_WORDING),
        "tax_worded": T.has(mrp, V.TAX_WORDING),
        "made": T.month(F.col("mfg_date")),
        "third_party": (T.has(address, V.PACKER) | T.has(address, V.MARKETER)) & ~T.has(address, V.MAKER),
        "origin_text": text,
        "country": T.found(tail, T.any_of(V.COUNTRIES), 1),
        "vague": T.found(tail, T.any_of(V.AMBIGUOUS_ORIGINS), 1),
        "care_phone": T.phone(care),
        "care_email": T.email(care),
        "care_pin": T.pin(care),
        "care_above": T.has(care, V.AS_ABOVE),
    }


def check(rule: str, ok: Column, message: Column, field: Column | str | None) -> Column:
    status = F.when(ok.isNull(), "NA").when(ok, "PASS").otherwise("FAIL")
    where = field if isinstance(field, Column) else F.lit(field).cast("string")
    return F.struct(F.lit(rule).alias("rule"), status.alias("status"), message.alias("message"), where.alias("field"))


def mentions(text: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def thousandths(unit: Column) -> Column:
    """Thousandths of kg, L or m in one unit; mg is 0.001 of them."""
    table = {"mg": "0.001", "g": "1", "kg": "1000", "ml": "1", "cl": "10", "L": "1000", "mm": "1", "cm": "10", "m": "1000"}
    return T.lookup(table, unit).cast("decimal(7,3)")


def exemption() -> Column:
    """struct(exempt, clause, note); null without a quantity."""
    q, u, goods = F.col("q"), F.col("u"), F.col("goods")
    mass, volume = u.isin("mg", "g", "kg"), u.isin("ml", "cl", "L")
    small = (mass | volume) & (q * thousandths(u) <= 10)
    amount = q * thousandths(u) / 1000
    note = lambda exempt, clause, text: F.struct(F.lit(exempt).alias("exempt"), F.lit(clause).cast("string").alias("clause"), (text if isinstance(text, Column) else F.lit(text)).alias("note"))
    kg = F.concat(F.regexp_replace(F.regexp_replace(amount.cast("decimal(30,6)").cast("string"), "0+$", ""), r"\.$", ""), F.lit(" kg"))
    bulk = mentions(goods, V.BULK_WORDS)
    return F.when(
        q.isNotNull(),
        F.when(F.coalesce("institutional", F.lit(False)), note(True, "Rule 26 — institutional / industrial supply", "Supplied directly to an institutional or industrial consumer."))
        .when(F.coalesce("fast_food", F.lit(False)), note(True, "Rule 26 — fast food packaging", "Packaged by a restaurant / hotel / canteen."))
        .when(small & mentions(goods, V.TOBACCO_WORDS), note(False, None, "Small-package exemption denied: tobacco / bidi / pan masala are excluded."))
        .when(small, note(True, "Rule 26 — small package", F.concat(F.lit("Net quantity <= 10 "), F.when(mass, "g").otherwise("mL"), F.lit("."))))
        .when(bulk & mass & (amount > 50), note(True, "Rule 26 — bulk (cement/fertilizer carve-out)", F.concat(kg, F.lit(" exceeds the 50 kg threshold for '"), F.coalesce(F.nullif("commodity", F.lit("")), "product_name"), F.lit("'."))))
        .when(bulk & mass & (amount > 25), note(False, None, F.concat(kg, F.lit(": cement / fertilizer up to 50 kg are NOT exempt."))))
        .when(~bulk & (mass | volume) & (amount > 25), note(True, "Rule 26 — bulk package", F.concat(F.lit("Net quantity exceeds 25 "), F.when(mass, "kg").otherwise("L"), F.lit("."))))
        .otherwise(note(False, None, "No Rule 26 exemption applies; all Rule 6 declarations required.")),
    )


def rule_13() -> Column:
    first = F.when(F.col("bad_in_qty").isNotNull(), "net_qty").when(F.col("bad_in_usp").isNotNull(), "usp")
    token = F.coalesce("bad_in_qty", "bad_in_usp")
    bad = F.concat(
        F.lit("Prohibited unit syntax '"), token, F.lit("' in "), T.lookup(V.FIELD_LABELS, first), F.lit(" — statutory symbol '"), T.suggestion_for(token),
        F.lit("' required. Rule 13, LMPC Rules 2011 — standard metric unit symbols; prohibited syntax (gms, ltr, cc, ...)."),
    )
    return check("13", token.isNull(), F.coalesce(bad, F.lit("No prohibited unit symbols (gms, grm, kilo, kgs, ltr, cc, pkts, doz).")), first)


def rule_net_quantity() -> Column:
    text, raw = F.col("net_qty"), F.col("qty.raw_unit")
    tolerated = T.lookup(V.TOLERATED_UNITS, raw)
    ok = text.isNotNull() & F.col("qty").isNotNull() & (tolerated.isNotNull() | T.is_permitted(raw))
    printed = F.when(tolerated.isNotNull(), F.concat(F.lit(" (printed '"), raw, F.lit("', statutory symbol '"), tolerated, F.lit("')"))).otherwise("")
    message = (
        F.when(text.isNull(), "Net quantity declaration not detected.")
        .when(F.col("qty").isNull(), F.concat(F.lit("Net quantity not decodable from '"), F.substring(text, 1, 40), F.lit("'.")))
        .when(~ok, F.concat(F.lit("Unit '"), raw, F.lit("' is not a standard SI symbol (Rule 6(1)(c) read with Rules 11-13).")))
        .otherwise(F.concat(F.lit("Net quantity "), F.col("qty.digits"), F.lit(" "), F.col("qty.unit"), F.lit(" in standard unit"), printed, F.lit(".")))
    )
    return check("6(1)(c)", ok, message, "net_qty")


def listed(*pairs: tuple[Column, str]) -> Column:
    """Names whose condition holds, with commas."""
    return F.array_join(F.filter(F.array(*[F.when(c, name) for c, name in pairs]), lambda x: x.isNotNull()), ", ")


def rule_mrp() -> Column:
    text = F.col("mrp")
    missing = listed(
        (~F.col("mrp_worded"), "'MRP' / 'Maximum Retail Price' wording"),
        (F.col("mrp_digits").isNull(), "rupee amount"),
        (~F.col("tax_worded"), "statutory phrase 'inclusive of all taxes'"),
    )
    message = (
        F.when(text.isNull(), "MRP declaration not detected.")
        .when(missing != "", F.concat(F.lit("MRP non-compliant — missing "), missing, F.lit(".")))
        .otherwise(F.concat(F.lit("MRP Rs "), F.col("mrp_digits"), F.lit(" inclusive of all taxes.")))
    )
    return check("6(1)(e)", text.isNotNull() & (missing == ""), message, "mrp")


def unit_price_result(mrp: Column, qty: Column, unit: Column, declared: Column, declared_unit: Column) -> Column:
    """struct(ok, required_unit, expected, exempt, evaluable): the unit price law by cross-multiplication, never division.

    All of it is exact in decimals: |declared - mrp / n| <= 0.01 is |declared * n - mrp| <= 0.01 * n.
    """
    main = T.lookup(V.MAIN_UNIT, unit)
    count = unit.isin(*V.COUNT_UNITS)
    thousand = qty * thousandths(unit)  # of the main unit
    one = F.when(count, qty == 1).otherwise(thousand == 1000)
    below = thousand < 1000
    required = F.when(count, "piece").when(below, T.lookup(V.SUB_UNIT, main)).otherwise(main)
    # quantity in the required unit: g and ml are thousandths, cm are hundredths of the main unit
    n = F.when(count, qty).when(below & (main == "m"), thousand / 10).when(below, thousand).otherwise(thousand / 1000).cast("decimal(21,7)")
    unit_ok = F.when(count, F.lower(declared_unit).isin(*V.COUNT_UNITS)).otherwise(F.lower(declared_unit) == F.lower(required))
    math_ok = F.abs(declared * n - mrp) <= F.lit("0.01").cast("decimal(3,2)") * n
    evaluable = mrp.isNotNull() & qty.isNotNull() & (mrp > 0) & (qty > 0) & (count | main.isNotNull())
    ok = F.when(~evaluable, F.lit(None).cast("boolean")).when(one, True).otherwise(F.coalesce(unit_ok & math_ok, F.lit(False)))
    expected = F.when(evaluable, F.round(mrp / F.when(one, F.lit(1)).otherwise(n), 2).cast("decimal(18,2)"))
    return F.struct(
        ok.alias("ok"), F.when(evaluable & ~one, required).alias("required_unit"), expected.alias("expected"), F.coalesce(evaluable & one, F.lit(False)).alias("exempt"),
        F.coalesce(evaluable, F.lit(False)).alias("evaluable"), unit_ok.alias("unit_ok"), math_ok.alias("math_ok"),
    )


def rule_unit_price() -> Column:
    r = unit_price_result(F.col("m"), F.col("q"), F.col("u"), F.col("price.value"), F.col("price.unit"))
    expected, required, digits = r["expected"].cast("string"), r["required_unit"], F.col("price.digits")
    name = T.lookup({"kg": "kg", "L": "litre", "m": "metre"}, T.lookup(V.MAIN_UNIT, F.col("u")))
    wrong_unit = F.when(~F.coalesce(r["unit_ok"], F.lit(False)), F.concat(F.lit("wrong reference unit — declared '"), F.coalesce(F.lower("price.unit"), F.lit("—")), F.lit("', statutory '"), required, F.lit("' for this net quantity")))
    wrong_math = F.when(~r["math_ok"], F.concat(F.lit("USP math error — declared Rs "), digits, F.lit(" vs calculated Rs "), expected, F.lit(" per "), required, F.lit(" (tolerance Rs 0.01)")))
    notes = F.concat_ws("; ", wrong_unit, wrong_math)
    message = (
        F.when(F.col("m").isNull() | F.col("q").isNull(), "USP not evaluable — MRP or net quantity missing.")
        .when(F.col("u").isin("cm2", "m2"), "Rule 6(11) USP reference units are mandated for mass, length, volume and number only — area quantities are outside the USP mandate; not evaluated.")
        .when(~r["evaluable"], F.concat(F.lit("USP not evaluable for quantity unit '"), F.col("u"), F.lit("' — recorded for manual review")))
        .when(r["exempt"], F.concat(F.lit("Second proviso to Rule 6(11): net quantity is exactly one "), F.coalesce(name, F.lit("unit")), F.lit(" -> RSP itself is the USP; separate declaration not required.")))
        .when(digits.isNull(), F.concat(F.lit("USP not declared. Statutory requirement: Rs "), expected, F.lit(" per "), required, F.lit(" (MRP / net quantity, Rule 6(11)).")))
        .when(notes != "", notes)
        .otherwise(F.concat(F.lit("USP Rs "), digits, F.lit(" per "), required, F.lit(" matches MRP / net quantity within Rs 0.01")))
    )
    return check("6(11)", r["ok"], message, "usp")


def rule_date() -> Column:
    text, month = F.col("mfg_date"), F.col("made")
    message = (
        F.when(text.isNull(), "Date of manufacture / packing not detected.")
        .when(month.isNull(), F.concat(F.lit("Date '"), F.substring(text, 1, 40), F.lit("' is not in a statutory form (MM/YYYY, Month YYYY, or DD/MM/YYYY) — Rule 6(1)(d).")))
        .otherwise(F.concat(F.lit("Date of manufacture "), F.date_format(month, "MM/yyyy"), F.lit(".")))
    )
    return check("6(1)(d)", month.isNotNull(), message, "mfg_date")


def rule_address() -> Column:
    text, pin = F.col("mfg_address"), F.col("maker_pin")
    third = F.col("third_party")
    message = (
        F.when(text.isNull(), "Manufacturer / packer / importer details not detected.")
        .when(third, "Packer / marketer is named without manufacturer details — Rule 6(1)(a) requires both when a third party packs the commodity.")
        .when(pin.isNull(), "Address present but no valid 6-digit PIN code found — Rule 6(1)(a) requires a complete postal address incl. PIN.")
        .otherwise(F.concat(F.lit("Manufacturer/packer details with PIN "), pin, F.lit(".")))
    )
    return check("6(1)(a)", text.isNotNull() & ~third & pin.isNotNull(), message, "mfg_address")


def rule_origin() -> Column:
    text, country, vague = F.col("origin_text"), F.col("country"), F.col("vague")
    hint = T.looks_imported(F.col("mfg_address"), text)
    ok = F.when(text.isNotNull(), country.isNotNull()).when(hint, False)
    message = (
        F.when(country.isNotNull(), F.concat(F.lit("Country of origin: "), country, F.lit(".")))
        .when(vague.isNotNull(), F.concat(F.lit("Ambiguous origin '"), vague, F.lit("' — Rule 6(1)(aa) requires an explicit country (e.g., 'Made in PRC' must read 'Made in China').")))
        .when(text.isNotNull(), F.concat(F.lit("Origin text '"), F.substring(T.origin_tail(text), 1, 40), F.lit("' does not name a recognized country.")))
        .when(hint, "Country of origin missing — mandatory on imported packages (Rule 6(1)(aa)).")
        .otherwise("Country of origin not found; mandatory for imported packages — flagged for manual review.")
    )
    return check("6(1)(aa)", ok, message, F.when(F.col("origin").isNotNull(), "origin").when(F.col("mfg_address").isNotNull(), "mfg_address"))


def rule_care() -> Column:
    text = F.col("consumer_care")
    phone, email, pin = F.col("care_phone"), F.col("care_email"), F.coalesce("care_pin", "maker_pin")
    placed = pin.isNotNull() | F.col("care_above")
    missing = listed((phone.isNull(), "telephone helpline"), (email.isNull(), "email address"), (~placed, "postal address with PIN"))
    place = F.coalesce(F.concat(F.lit("PIN "), pin), F.lit("address as above (Rule 6(1)(n) proviso)"))
    message = (
        F.when(text.isNull(), "Consumer care details not detected.")
        .when(missing != "", F.concat(F.lit("Consumer care incomplete — missing "), missing, F.lit(".")))
        .otherwise(F.concat(F.lit("Consumer care complete (tel "), phone, F.lit(", email "), email, F.lit(", "), place, F.lit(").")))
    )
    return check("6(1)(n)", text.isNotNull() & (missing == ""), message, "consumer_care")


def rule_name() -> Column:
    text = F.col("product_name")
    ok = F.coalesce((F.length(text) >= 3) & (T.letters(text) > 0), F.lit(False))
    message = F.when(ok, "Common/generic name present — semantic adequacy needs manual review.").otherwise("common/generic name not found on the package.")
    return check("6(1)(b)", ok, message, "product_name")


def least_height(pda: Column, blown: Column) -> Column:
    """Least height of letters in mm for a display area; null for an area that isn't positive."""
    out = None
    for top, plain, raised in V.FONT_BANDS:
        height = F.when(F.coalesce(blown, F.lit(False)), raised).otherwise(plain)
        if out is None:
            out = F.when(pda <= top, height)
        else:
            out = out.when(pda <= top, height) if top is not None else out.otherwise(height)
    return F.when(pda > 0, out)


def font_check(pda: Column, blown: Column, height: Column, label: str, field: str) -> Column:
    required = least_height(pda, blown)
    ok = height >= required - V.FONT_TOLERANCE_MM
    kind = F.when(F.coalesce(blown, F.lit(False)), "blown/molded/embossed").otherwise("normal print")
    message = F.when(height.isNull(), f"{label} font height not measured.").otherwise(
        F.format_string(f"{label}: measured %.2f mm vs required %.1f mm (%s, PDA %.0f cm²).", height, required, kind, pda)
    )
    return check("7", ok, message, field)


def rules_font(of: Callable[[Column], Column] = lambda c: c) -> Column:
    """The findings of rule 7, or of each what `of` takes."""
    pda, blown = F.col("pda_cm2"), F.col("blown")
    none = check("7", F.lit(None).cast("boolean"), F.lit("PDA not computed (Stage 3 unavailable) — font heights not evaluated."), None)
    both = F.array(of(font_check(pda, blown, F.col("height_net_qty"), "Net quantity", "net_qty")), of(font_check(pda, blown, F.col("height_mrp"), "MRP", "mrp")))
    return F.when(pda.isNull(), F.array(of(none))).otherwise(both)


def glyph_checks(glyphs: DataFrame) -> DataFrame:
    """scan_id and the check of rule 7(3), for scans with measured glyphs. Position g orders the examples."""
    narrow = F.col("glyph").isin(*V.NARROW_GLYPHS)
    bad = ~narrow & (F.col("width_mm") < F.col("height_mm") / 3 - 1e-9)
    sample = F.when(bad, F.struct("g", F.format_string("'%s' %.2fx%.2f mm", "glyph", "width_mm", "height_mm").alias("text")))
    per = glyphs.groupBy("scan_id").agg(F.count_if(bad).alias("bad"), F.sort_array(F.collect_list(sample)).alias("samples"))
    texts = F.array_join(F.transform(F.slice("samples", 1, 3), lambda s: s["text"]), ", ")
    message = F.when(F.col("bad") > 0, F.concat(F.lit("Character width below height/3 (Rule 7(3)): "), texts, F.lit("."))).otherwise("All measured characters satisfy width >= height/3.")
    return per.select("scan_id", check("7(3)", F.col("bad") == 0, message, None).alias("glyph_check"))


def glyph_check(glyphs: Column) -> Column:
    """The check of rule 7(3) of one scan's array of glyphs, in order; null without any."""
    bad = F.filter(glyphs, lambda x: ~x["glyph"].isin(*V.NARROW_GLYPHS) & (x["width_mm"] < x["height_mm"] / 3 - 1e-9))
    texts = F.transform(F.slice(bad, 1, 3), lambda x: F.format_string("'%s' %.2fx%.2f mm", x["glyph"], x["width_mm"], x["height_mm"]))
    message = F.when(F.size(bad) > 0, F.concat(F.lit("Character width below height/3 (Rule 7(3)): "), F.array_join(texts, ", "), F.lit("."))).otherwise("All measured characters satisfy width >= height/3.")
    return F.when(F.size(glyphs) > 0, check("7(3)", F.size(bad) == 0, message, None))


def checks_of(status_only: bool = False) -> Column:
    """All findings of a prepared row with exemption and glyph_check, in statutory order; none without any field.

    status_only: their statuses alone; no message is put together.
    """
    kind = "string" if status_only else CHECK
    of = (lambda c: c["status"]) if status_only else (lambda c: c)
    single = [rule_13(), rule_net_quantity(), rule_mrp(), rule_unit_price(), rule_date(), rule_address(), rule_origin(), rule_care(), rule_name()]
    glyphs = F.when(F.col("glyph_check").isNotNull(), F.array(of(F.col("glyph_check")))).otherwise(F.array().cast(f"array<{kind}>"))
    full = F.concat(F.array(*map(of, single)), rules_font(of), glyphs)
    free = check("26", F.lit(None).cast("boolean"), F.concat("exemption.note", F.lit(" Remaining Rule 6 declarations are not applicable.")), None)
    any_field = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in V.FIELDS])
    return F.when(~any_field, F.array().cast(f"array<{kind}>")).when(F.coalesce("exemption.exempt", F.lit(False)), F.array(of(free))).otherwise(full)


def audit(labels: DataFrame, glyphs: DataFrame | None = None) -> DataFrame:
    """scan_id, ord, rule, status, message, field: findings in statutory order. A scan without any field has none."""
    rows = prepared(labels).withColumn("exemption", exemption())
    if glyphs is not None:
        rows = rows.join(glyph_checks(glyphs), "scan_id", "left")
    else:
        rows = rows.withColumn("glyph_check", F.lit(None).cast(CHECK))
    # outer, then filtered: a filter inferred below the explosion would evaluate all rules twice
    return rows.select("scan_id", F.posexplode_outer(checks_of()).alias("ord", "c")).where("ord is not null").select("scan_id", "ord", "c.*")


def verdicts(checks: DataFrame, scans: DataFrame, stages: DataFrame | None = None) -> DataFrame:
    """scan_id, verdict, total, passed, failed, na for every scan: a failed stage or no finding is RETRY, before any FAIL."""
    per = checks.groupBy("scan_id").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == "PASS").alias("passed"),
        F.count_if(F.col("status") == "FAIL").alias("failed"),
        F.count_if(F.col("status") == "NA").alias("na"),
    )
    out = scans.select("scan_id").join(per, "scan_id", "left").na.fill(0, ["total", "passed", "failed", "na"])
    if stages is not None:
        out = out.join(stages.groupBy("scan_id").agg(F.bool_or(~F.col("ok")).alias("stopped")), "scan_id", "left")
    else:
        out = out.withColumn("stopped", F.lit(False))
    verdict = F.when(F.coalesce("stopped", F.lit(False)) | (F.col("total") == 0), "RETRY").when(F.col("failed") > 0, "VIOLATION").otherwise("PASS")
    return out.select("scan_id", verdict.alias("verdict"), "total", "passed", "failed", "na")


def citation(rule: Column) -> Column:
    return F.coalesce(T.lookup(V.CITATIONS, rule), rule)


def with_citation(checks: DataFrame) -> DataFrame:
    """checks with what each rule asks for; a rule without a text cites itself."""
    return checks.withColumn("citation", citation(F.col("rule")))


def findings(checks: DataFrame) -> DataFrame:
    """scan_id, ord, rule, status, message, plain, citation: the table of findings of a dossier."""
    return with_citation(with_plain(checks)).select("scan_id", "ord", "rule", "status", "message", "plain", "citation")


def top_rules(checks: DataFrame, n: int = 10, scans: DataFrame | None = None) -> DataFrame:
    """The rules broken most among violations: rule, count. Ties by rule.

    scans: scan_id and verdict; findings of scans to be taken again (RETRY) don't count. Without it every scan with a
    failed check is a violation, which holds where no stage can fail.
    """
    if scans is not None:
        checks = checks.join(scans.where("verdict = 'VIOLATION'").select("scan_id"), "scan_id", "left_semi")
    return checks.where("status = 'FAIL'").groupBy("rule").count().orderBy(F.desc("count"), "rule").limit(n)


def plain_message(rule: Column, status: Column, message: Column) -> Column:
    """A plain message by rule, status and what the statutory message says."""
    low = F.lower(message)
    fixes = {k: v for k, v in V.UNIT_SUGGESTION.items() if k != "cucm"}
    token = F.regexp_extract(low, "'(" + "|".join(fixes) + ")'", 1)
    unit = F.when(token != "", F.concat(F.lit("The label says '"), token, F.lit("' — the correct unit symbol is '"), T.lookup(fixes, token), F.lit("'."))).otherwise("The printed unit symbol is non-standard or misspelled.")
    mrp = (
        F.when(low.contains("not detected") | low.contains("not found"), "The Maximum Retail Price (MRP) declaration was not found on the package.")
        .when(low.contains("tax"), "The MRP is printed, but mandatory phrase 'inclusive of all taxes' is missing.")
        .when(low.contains("rupee amount"), "The MRP is printed without a valid retail price amount.")
        .when(low.contains("wording") | low.contains("keyword"), "The price is printed, but 'MRP' / 'Maximum Retail Price' wording is missing.")
        .otherwise("The MRP declaration is non-compliant or missing required statutory wording.")
    )
    note = F.rtrim(F.regexp_extract(message, r"^.*?\. (.*)$", 1), F.lit("."))
    exempt = F.concat(F.lit("This pack is exempt from declaration rules ("), F.when(note != "", note).otherwise("small/bulk/institutional exemption"), F.lit(")."))
    return (
        F.when((rule == "6(1)(e)") & (status == "FAIL"), mrp)
        .when((rule == "13") & (status == "FAIL"), unit)
        .when((rule == "26") & (status == "NA"), exempt)
        .otherwise(F.coalesce(T.lookup(V.PLAIN, F.concat_ws("|", rule, status)), message))
    )


def with_plain(checks: DataFrame) -> DataFrame:
    return checks.withColumn("plain", plain_message(F.col("rule"), F.col("status"), F.col("message")))
