"""Registered queries of the label audit: each with a DataFrame form and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelaudit.functions import fixed_values as V
from labelaudit.functions import text as T
from labelaudit.operators import contract, extract, folds, gateway, geometry, golden, rules, shapes
from labelaudit.plans import derived as D
from labelaudit.plans import scans

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = D.oracle(sql)
        return f

    return add


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.table(spark, sf_dir, D.LABELS, even=True)


def checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.audit(labels(spark, sf_dir))


CANON = "CASE unit WHEN 'gms' THEN 'g' WHEN 'gm' THEN 'g' WHEN 'ltr' THEN 'L' WHEN 'kgs' THEN 'kg' WHEN 'pcs' THEN 'piece' ELSE unit END"


# ---- parsers over label texts ----------------------------------------------------------------------------------------
@query(f"SELECT scan_id, CASE WHEN k23 = 0 THEN NULL ELSE q END AS qty, CASE WHEN k23 = 0 THEN NULL ELSE {CANON} END AS unit, CASE WHEN k23 = 0 THEN NULL ELSE lower(unit) END AS raw_unit FROM ({D.LABEL_BASE}) b")
def parse_quantity(spark, sf_dir):
    q = T.quantity(T.squash(F.col("net_qty")))
    return labels(spark, sf_dir).select("scan_id", q["value"].cast("long").alias("qty"), q["unit"].alias("unit"), q["raw_unit"].alias("raw_unit"))


@query(f"SELECT scan_id, CASE WHEN k7 IN (4, 6) THEN NULL ELSE cents END AS strict_cents, CASE WHEN k7 = 6 THEN NULL ELSE cents END AS lenient_cents FROM ({D.LABEL_BASE}) b")
def parse_money(spark, sf_dir):
    mrp = T.squash(F.col("mrp"))
    return labels(spark, sf_dir).select("scan_id", (T.money(mrp) * 100).cast("long").alias("strict_cents"), (T.money_lenient(mrp) * 100).cast("long").alias("lenient_cents"))


@query(f"SELECT scan_id, paise, CASE WHEN paise IS NULL THEN NULL ELSE price_unit END AS unit FROM ({D.LABEL_PRICED}) b")
def parse_unit_price(spark, sf_dir):
    p = T.unit_price(T.squash(F.col("usp")))
    return labels(spark, sf_dir).select("scan_id", (p["value"] * 100).cast("long").alias("paise"), p["unit"].alias("unit"))


@query(f"SELECT scan_id, CASE k6 WHEN 0 THEN 202600 + mon WHEN 1 THEN 202500 + mon WHEN 2 THEN 202608 ELSE NULL END AS year_month FROM ({D.LABEL_BASE}) b")
def parse_month(spark, sf_dir):
    d = T.month(T.squash(F.col("mfg_date")))
    return labels(spark, sf_dir).select("scan_id", (F.year(d) * 100 + F.month(d)).cast("long").alias("year_month"))


@query(
    "SELECT o_orderkey, 100 * year(o_orderdate) + month(o_orderdate) AS year_month FROM {orders}"
)
def parse_month_orders(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    form = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "'PKD' MM/yyyy")).otherwise(F.date_format("o_orderdate", "MMM yyyy"))
    d = T.month(T.squash(F.concat(F.lit("Mfd. on "), form)))
    return o.select("o_orderkey", (F.year(d) * 100 + F.month(d)).cast("long").alias("year_month"))


@query(f"SELECT scan_id, CASE WHEN k23 <> 0 AND unit IN ('gms', 'ltr', 'kgs') THEN unit ELSE NULL END AS token, CASE WHEN k23 <> 0 AND unit IN ('gms', 'ltr', 'kgs') THEN {CANON} ELSE NULL END AS suggestion, CASE WHEN k23 <> 0 AND unit IN ('gms', 'ltr', 'kgs') THEN 15 + length(CAST(q AS STRING)) ELSE NULL END AS hit_start FROM ({D.LABEL_BASE}) b")
def prohibited_units(spark, sf_dir):
    hit = F.get(T.prohibited_hits(T.squash(F.col("net_qty"))), F.lit(0))
    return labels(spark, sf_dir).select("scan_id", hit["token"].alias("token"), hit["suggestion"].alias("suggestion"), hit["start"].cast("long").alias("hit_start"))


@query(f"SELECT scan_id, CASE WHEN k6 IN (0, 1, 4, 5) THEN CAST(pin AS STRING) ELSE NULL END AS pin FROM ({D.LABEL_BASE}) b")
def address_pins(spark, sf_dir):
    return labels(spark, sf_dir).select("scan_id", T.pin(T.squash(F.col("mfg_address"))).alias("pin"))


@query(f"""SELECT scan_id, CASE k7 WHEN 0 THEN '1800-123-4567' WHEN 1 THEN '9876543210' WHEN 2 THEN NULL WHEN 3 THEN NULL WHEN 4 THEN '079-26856029' ELSE '1800 123 4567' END AS phone,
CASE k7 WHEN 0 THEN 'care@tasty.in' WHEN 1 THEN 'care(at)tasty.in' WHEN 2 THEN 'care@tasty.in' WHEN 4 THEN 'help@box.co.in' ELSE NULL END AS email, CASE WHEN k7 = 1 THEN TRUE ELSE FALSE END AS as_above FROM ({D.LABEL_BASE}) b""")
def contact_details(spark, sf_dir):
    care = T.squash(F.col("consumer_care"))
    return labels(spark, sf_dir).select("scan_id", T.phone(care).alias("phone"), T.email(care).alias("email"), T.has(care, V.AS_ABOVE).alias("as_above"))


@query(f"SELECT scan_id, CASE k5 WHEN 0 THEN 'India' WHEN 3 THEN 'China' ELSE NULL END AS country, CASE WHEN k5 = 1 THEN 'PRC' ELSE NULL END AS ambiguous, CASE WHEN k6 = 4 THEN TRUE ELSE FALSE END AS imported FROM ({D.LABEL_BASE}) b")
def origins(spark, sf_dir):
    o, a = T.squash(F.col("origin")), T.squash(F.col("mfg_address"))
    return labels(spark, sf_dir).select("scan_id", T.origin_country(o).alias("country"), T.origin_ambiguous(o).alias("ambiguous"), T.looks_imported(o, a).alias("imported"))


@query("SELECT n_nationkey, trim(regexp_replace(regexp_replace(lower(n_name || ' ₹ Rs. Ltd., (No-1)'), '₹', ' rs ', 'g'), '[^a-z0-9_]+', ' ', 'g')) AS k FROM {nation}")
def compare_keys(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", T.compare_key(F.concat("n_name", F.lit(" ₹ Rs. Ltd., (No-1)"))).alias("k"))


@query("SELECT doc_id, length(nfc_normalize(trim(regexp_replace(text, '[\\s\\x0b]+', ' ', 'g')))) AS n FROM {documents} WHERE text IS NOT NULL")
def normalised_texts(spark, sf_dir):
    docs = T.nfc(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").where("text is not null"), "text")
    return docs.select("doc_id", F.length(F.coalesce(T.squash(F.col("text")), F.lit(""))).cast("long").alias("n"))


@query("""SELECT doc_id, regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}') AS has_email FROM {documents}""")
def document_contacts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", T.email(T.squash(F.col("text"))).isNotNull().alias("has_email"))


# ---- rules ---------------------------------------------------------------------------------------------------------
def one_rule(rule: str, column: str, name: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return checks(spark, sf_dir).where(F.col("rule") == rule).select("scan_id", "status")

    run.__name__ = name
    query(f"SELECT scan_id, {column} AS status FROM ({D.STATUS}) s WHERE NOT exempt")(run)


for _rule, _name in {
    "13": "rule_13_units", "6(1)(c)": "rule_6_1_c_quantity", "6(1)(e)": "rule_6_1_e_mrp", "6(11)": "rule_6_11_unit_price", "6(1)(d)": "rule_6_1_d_date",
    "6(1)(a)": "rule_6_1_a_address", "6(1)(aa)": "rule_6_1_aa_origin", "6(1)(n)": "rule_6_1_n_care", "6(1)(b)": "rule_6_1_b_name",
}.items():
    one_rule(_rule, D.RULE_COLUMNS[_rule], _name)


@query(f"SELECT scan_id, exempt FROM ({D.STATUS}) s WHERE has_q")
def rule_26_exemptions(spark, sf_dir):
    rows = rules.prepared(labels(spark, sf_dir)).withColumn("e", rules.exemption())
    return rows.where("e is not null").select("scan_id", F.col("e.exempt").alias("exempt"))


@query(f"SELECT scan_id, ord, rule, status FROM ({D.CHECKS}) c")
def audit_checks(spark, sf_dir):
    return checks(spark, sf_dir).select("scan_id", F.col("ord").cast("int").alias("ord"), "rule", "status")


VERDICTS = f"SELECT scan_id, CASE WHEN SUM(CASE WHEN status = 'FAIL' THEN 1 ELSE 0 END) > 0 THEN 'VIOLATION' ELSE 'PASS' END AS verdict, CAST(COUNT(*) AS BIGINT) AS total, CAST(SUM(CASE WHEN status = 'PASS' THEN 1 ELSE 0 END) AS BIGINT) AS passed, CAST(SUM(CASE WHEN status = 'FAIL' THEN 1 ELSE 0 END) AS BIGINT) AS failed, CAST(SUM(CASE WHEN status = 'NA' THEN 1 ELSE 0 END) AS BIGINT) AS na FROM ({D.CHECKS}) c GROUP BY scan_id"


@query(VERDICTS)
def audit_verdicts(spark, sf_dir):
    rows = labels(spark, sf_dir)
    return rules.verdicts(rules.audit(rows), rows)


@query(f"SELECT rule, CAST(COUNT(*) AS BIGINT) AS count FROM ({D.CHECKS}) c WHERE status = 'FAIL' GROUP BY rule ORDER BY count DESC, rule LIMIT 10")
def top_rules(spark, sf_dir):
    return rules.top_rules(checks(spark, sf_dir))


@query(f"SELECT CASE WHEN k7 = 6 THEN 'The Maximum Retail Price (MRP) declaration was not found on the package.' WHEN k7 = 3 THEN 'The MRP is printed, but mandatory phrase ''inclusive of all taxes'' is missing.' WHEN k7 = 5 THEN 'The price is printed, but ''MRP'' / ''Maximum Retail Price'' wording is missing.' ELSE 'MRP is declared with the required tax wording.' END AS plain, CAST(COUNT(*) AS BIGINT) AS n FROM ({D.STATUS}) s WHERE NOT exempt GROUP BY 1")
def plain_messages(spark, sf_dir):
    return rules.with_plain(checks(spark, sf_dir).where("rule = '6(1)(e)'")).groupBy("plain").agg(F.count("*").alias("n"))


AT_VOLUME = """SELECT l_orderkey, l_linenumber, CAST(ROUND(l_extendedprice * 100) AS BIGINT) AS cents, CAST(l_quantity AS BIGINT) AS q,
 CASE l_linenumber % 4 WHEN 0 THEN 'g' WHEN 1 THEN 'kg' WHEN 2 THEN 'ml' ELSE 'piece' END AS unit, CAST(l_partkey % 3 AS BIGINT) AS fault FROM {lineitem}"""
AT_VOLUME_N = f"SELECT *, CASE WHEN unit IN ('g', 'ml') THEN q * 20 ELSE q END AS amount, CASE WHEN unit IN ('g', 'ml') AND q >= 50 THEN 1000 ELSE 1 END AS den, CASE WHEN unit IN ('g', 'ml') THEN q = 50 ELSE q = 1 END AS one FROM ({AT_VOLUME}) v"
AT_VOLUME_P = f"SELECT *, CAST(FLOOR((2 * cents * den + amount) / (2.0 * amount)) AS BIGINT) + CASE WHEN fault = 0 THEN 2 ELSE 0 END AS paise, CASE WHEN unit = 'g' AND q >= 50 THEN 'kg' WHEN unit = 'ml' AND q >= 50 THEN 'L' ELSE unit END AS price_unit FROM ({AT_VOLUME_N}) n"


@query(f"SELECT unit, CASE WHEN one THEN 'PASS' WHEN ABS(paise * amount - cents * den) <= amount THEN 'PASS' ELSE 'FAIL' END AS status, CAST(COUNT(*) AS BIGINT) AS n FROM ({AT_VOLUME_P}) p GROUP BY 1, 2")
def unit_price_at_volume(spark, sf_dir):
    rows = D.spread(D.table(spark, sf_dir, AT_VOLUME_P))
    hundredth = lambda c: (F.col(c).cast("decimal(14,4)") / 100).cast("decimal(14,4)")
    r = rules.unit_price_result(hundredth("cents"), F.col("amount").cast("decimal(14,4)"), F.col("unit"), hundredth("paise"), F.col("price_unit"))
    return rows.groupBy("unit", F.when(r["ok"], "PASS").otherwise("FAIL").alias("status")).agg(F.count("*").alias("n"))


PACKS = """SELECT CAST(p_partkey AS BIGINT) AS scan_id, CASE p_partkey % 4 WHEN 0 THEN 'bottle' WHEN 1 THEN 'pouch' WHEN 2 THEN 'blister' ELSE NULL END AS shape,
 CAST(p_size AS DOUBLE) AS height, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(p_partkey % 37 + 1 AS DOUBLE) END AS width,
 CASE WHEN p_partkey % 8 = 0 THEN NULL ELSE CAST(p_partkey % 11 + 1 AS DOUBLE) END AS diameter, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey % 4000 AS DOUBLE) ELSE NULL END AS total,
 CASE WHEN p_partkey % 16 = 0 THEN 50.0 ELSE NULL END AS image_mm, p_partkey % 9 = 0 AS blown, CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE CAST(p_partkey % 70 AS DOUBLE) / 10.0 END AS height_net_qty FROM {part}"""
AREAS = f"""SELECT *, CASE WHEN shape = 'bottle' THEN CASE WHEN diameter IS NOT NULL THEN CAST(0.4 AS DOUBLE) * height * pi() * diameter WHEN image_mm IS NOT NULL THEN CAST(0.4 AS DOUBLE) * height * pi() * (image_mm / 10) ELSE NULL END
 WHEN shape = 'pouch' AND width IS NOT NULL THEN height * width WHEN total > 0 THEN CAST(0.4 AS DOUBLE) * total WHEN width IS NOT NULL THEN height * width ELSE NULL END AS area FROM ({PACKS}) p"""


def packs(spark, sf_dir):
    rows = D.table(spark, sf_dir, PACKS)
    area = geometry.display_area(*[F.col(c) for c in ("shape", "height", "width", "diameter", "total", "image_mm")])
    return rows.withColumn("a", area)


@query(f"SELECT scan_id, CAST(ROUND(area * 1000) AS BIGINT) AS area_1000 FROM ({AREAS}) a")
def display_areas(spark, sf_dir):
    return packs(spark, sf_dir).select("scan_id", F.round(F.col("a.pda_cm2") * 1000).cast("long").alias("area_1000"))


@query(f"""SELECT scan_id, CASE WHEN area IS NULL OR height_net_qty IS NULL THEN 'NA' WHEN height_net_qty >= need - CAST(0.1 AS DOUBLE) THEN 'PASS' ELSE 'FAIL' END AS status FROM (
SELECT *, CAST(CASE WHEN area <= 50 THEN CASE WHEN blown THEN 1.5 ELSE 1.0 END WHEN area <= 100 THEN CASE WHEN blown THEN 3.0 ELSE 1.5 END WHEN area <= 500 THEN CASE WHEN blown THEN 4.0 ELSE 2.5 END WHEN area <= 2500 THEN CASE WHEN blown THEN 6.0 ELSE 4.0 END ELSE 6.0 END AS DOUBLE) AS need FROM ({AREAS}) a) n""")
def rule_7_heights(spark, sf_dir):
    rows = packs(spark, sf_dir).select("scan_id", F.lit("Net Quantity: 70 kg bag").alias("product_name"), F.col("a.pda_cm2").alias("pda_cm2"), "blown", "height_net_qty")
    found = rules.audit(rows).where("rule = '7'")
    return found.groupBy("scan_id").agg(F.min_by("status", "ord").alias("status"))


GLYPHS = "SELECT CAST(l_orderkey AS BIGINT) AS scan_id, CAST(l_linenumber AS INT) AS g, CASE l_suppkey % 5 WHEN 0 THEN '1' WHEN 1 THEN 'M' WHEN 2 THEN 'i' WHEN 3 THEN '5' ELSE 'a' END AS glyph, CAST(l_quantity AS DOUBLE) AS height_mm, CAST(l_partkey % 40 AS DOUBLE) AS width_mm FROM {lineitem}"


@query(f"SELECT scan_id, CASE WHEN MAX(CASE WHEN glyph NOT IN ('1', 'i') AND width_mm < height_mm / 3 - CAST(0.000000001 AS DOUBLE) THEN 1 ELSE 0 END) = 1 THEN 'FAIL' ELSE 'PASS' END AS status FROM ({GLYPHS}) g GROUP BY scan_id")
def rule_7_3_glyphs(spark, sf_dir):
    return rules.glyph_checks(D.table(spark, sf_dir, GLYPHS)).select("scan_id", F.col("glyph_check.status").alias("status"))


# ---- gateway and ledger --------------------------------------------------------------------------------------------
def recorded(spark, sf_dir):
    return D.table(spark, sf_dir, D.GATEWAY)


@query(f"SELECT CAST(COUNT(*) AS BIGINT) AS total, CAST(COUNT(CASE WHEN verdict = 'VIOLATION' THEN 1 END) AS BIGINT) AS violation, CAST(COUNT(*) - COUNT(CASE WHEN verdict = 'VIOLATION' THEN 1 END) AS BIGINT) AS pass, CAST(COUNT(CASE WHEN sig_status = 'signed' THEN 1 END) AS BIGINT) AS signed, CAST(COUNT(lat) AS BIGINT) AS located FROM ({D.GATEWAY}) g")
def gateway_stats(spark, sf_dir):
    return gateway.stats(recorded(spark, sf_dir))


@query(f"SELECT scan_id, verdict, fail_count FROM ({D.GATEWAY}) g WHERE verdict = 'VIOLATION' ORDER BY received DESC, scan_id LIMIT 100 OFFSET 20")
def list_scans(spark, sf_dir):
    return gateway.list_scans(recorded(spark, sf_dir), "VIOLATION", 100, 20).select("scan_id", "verdict", "fail_count")


@query(f"SELECT scan_id, verdict, sig_status, attempts FROM ({D.GATEWAY}) g WHERE scan_id IN (SELECT MAX(event_id) FROM {{events}})")
def get_scan(spark, sf_dir):
    last = spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.max("event_id")).first()[0]
    return gateway.get_scan(recorded(spark, sf_dir), last).select("scan_id", "verdict", "sig_status", "attempts")


@query(f"SELECT scan_id, verdict, fail_count, CAST(ROUND(lat * 100) AS BIGINT) AS lat_100, CAST(ROUND(lon * 100) AS BIGINT) AS lon_100 FROM ({D.GATEWAY}) g WHERE lat IS NOT NULL")
def heatmap(spark, sf_dir):
    points = gateway.heatmap_points(recorded(spark, sf_dir))
    return points.select("scan_id", "verdict", "fail_count", F.round(F.col("lat") * 100).cast("long").alias("lat_100"), F.round(F.col("lon") * 100).cast("long").alias("lon_100"))


@query(f"SELECT CAST(COUNT(*) AS BIGINT) AS total, CAST(COUNT(CASE WHEN sync_status = 'pending' THEN 1 END) AS BIGINT) AS pending, CAST(COUNT(CASE WHEN sync_status = 'failed' THEN 1 END) AS BIGINT) AS failed, CAST(COUNT(CASE WHEN sig_status = 'signed' THEN 1 END) AS BIGINT) AS signed, CAST(COUNT(dossier_sha256) AS BIGINT) AS dossiers FROM ({D.GATEWAY}) g")
def queue_status(spark, sf_dir):
    return gateway.queue_status(recorded(spark, sf_dir))


@query(f"SELECT scan_id, attempts FROM ({D.GATEWAY}) g WHERE sync_status = 'pending' ORDER BY created, scan_id LIMIT 50")
def pending_sync(spark, sf_dir):
    return gateway.pending_sync(recorded(spark, sf_dir)).select("scan_id", "attempts")


DELIVERED = f"""SELECT scan_id, device, CASE WHEN COALESCE(stopped, 0) = 1 THEN 'untouched' ELSE outcome END AS outcome, CAST(attempts + CASE WHEN COALESCE(stopped, 0) = 1 THEN 0 ELSE 1 END AS INT) AS attempts FROM (
SELECT *, MAX(CASE WHEN outcome = 'deferred' THEN 1 ELSE 0 END) OVER (PARTITION BY device ORDER BY created, scan_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stopped FROM (
SELECT g.*, CASE WHEN r.http_status BETWEEN 200 AND 299 AND r.accepted THEN 'synced' WHEN r.http_status IN (400, 422) THEN 'failed' ELSE 'deferred' END AS outcome
FROM ({D.GATEWAY}) g LEFT JOIN ({D.RESPONSES}) r ON g.scan_id = r.scan_id WHERE g.sync_status = 'pending') s) w"""


def sent(spark, sf_dir):
    return gateway.delivered(recorded(spark, sf_dir), D.table(spark, sf_dir, D.RESPONSES))


@query(DELIVERED)
def delivery_outcomes(spark, sf_dir):
    return sent(spark, sf_dir)


@query(f"SELECT device, CAST(COUNT(CASE WHEN outcome <> 'untouched' THEN 1 END) AS BIGINT) AS attempted, CAST(COUNT(CASE WHEN outcome = 'synced' THEN 1 END) AS BIGINT) AS synced, CAST(COUNT(CASE WHEN outcome = 'failed' THEN 1 END) AS BIGINT) AS failed, CAST(COUNT(CASE WHEN outcome = 'deferred' THEN 1 END) AS BIGINT) AS deferred, CAST(COUNT(CASE WHEN outcome IN ('deferred', 'untouched') THEN 1 END) AS BIGINT) AS remaining FROM ({DELIVERED}) d GROUP BY device")
def sync_summaries(spark, sf_dir):
    return gateway.sync_summary(sent(spark, sf_dir))


@query(f"SELECT scan_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY received, event_id) AS n FROM ({D.ENVELOPES}) e) f WHERE n = 1")
def first_wins(spark, sf_dir):
    rows = D.table(spark, sf_dir, D.ENVELOPES).withColumn("order", F.struct("received", "event_id"))
    return gateway.first_wins(rows, "scan_id", "order").select("scan_id", "event_id")


#: Scans of the earlier half of all envelopes, so the store grows with the table.
STORE = f"SELECT DISTINCT scan_id FROM ({D.ENVELOPES}) stored WHERE scan_id <> '' AND event_id < (SELECT AVG(event_id) FROM {{events}})"


@query(f"SELECT event_id, e.scan_id FROM ({D.ENVELOPES}) e WHERE NOT EXISTS (SELECT 1 FROM ({STORE}) s WHERE s.scan_id = e.scan_id)")
def new_scans(spark, sf_dir):
    return gateway.new_rows(D.table(spark, sf_dir, D.ENVELOPES), D.table(spark, sf_dir, STORE)).select("event_id", "scan_id")


DECIDED = f"""SELECT CASE WHEN e.scan_id = '' THEN 'scan_id is required' WHEN verdict IS NULL THEN 'verdict is required' WHEN verdict = 'RETRY' THEN 'verdict must be PASS or VIOLATION' WHEN NOT has_result THEN 'result is required'
WHEN kind <> 'scan.v1' THEN 'kind must be scan.v1' WHEN contract_error IS NOT NULL THEN 'result violates contract' WHEN s.scan_id IS NOT NULL THEN 'duplicate'
WHEN signature IS NOT NULL AND dossier_sha256 IS NOT NULL AND cert_fingerprint NOT IN ('f1', 'f2', 'f3', 'f4') THEN 'certificate is not enrolled' ELSE 'accepted' END AS detail FROM ({D.ENVELOPES}) e LEFT JOIN ({STORE}) s ON s.scan_id = e.scan_id"""


@query(f"SELECT detail, CAST(COUNT(*) AS BIGINT) AS n FROM ({DECIDED}) d GROUP BY detail")
def ingest_decisions(spark, sf_dir):
    enrolled = D.table(spark, sf_dir, "SELECT DISTINCT 'f' || CAST(user_id % 10 AS STRING) AS fingerprint FROM {events} WHERE user_id % 10 BETWEEN 1 AND 4")
    decided = gateway.ingest_decision(D.table(spark, sf_dir, D.ENVELOPES), D.table(spark, sf_dir, STORE), enrolled)
    return decided.groupBy("detail").agg(F.count("*").alias("n"))


STAGES = "SELECT CAST(l_orderkey AS BIGINT) AS scan_id, 's' || CAST(l_linenumber AS STRING) AS stage, CAST(l_quantity AS DOUBLE) AS duration_ms, l_returnflag <> 'R' AS ok FROM {lineitem}"


@query(f"SELECT stage, ROUND(AVG(duration_ms), 6) AS mean_ms, AVG(duration_ms) > 25.5 AS over_budget FROM ({STAGES}) s GROUP BY stage")
def stage_latencies(spark, sf_dir):
    stages = D.table(spark, sf_dir, STAGES)
    budgets = stages.select("stage").distinct().withColumn("budget_ms", F.lit(25.5))
    return gateway.stage_latency(stages, budgets).select("stage", F.round("mean_ms", 6).alias("mean_ms"), F.col("over").alias("over_budget"))


@query(f"SELECT scan_id, SUM(duration_ms) AS total_ms, CAST(COUNT(*) AS BIGINT) AS stages FROM ({STAGES}) s GROUP BY scan_id")
def scan_totals(spark, sf_dir):
    return gateway.scan_totals(D.table(spark, sf_dir, STAGES))


#: Every event with a label: labels are dealt to events in turn.
LABELLED = f"(SELECT *, scan_id % (SELECT COUNT(*) FROM {{part}}) AS label_id FROM ({D.GATEWAY}) g)"
FILED = f"SELECT s.*, l.product_name, l.mfg_address, l.consumer_care FROM {LABELLED} s JOIN ({D.LABELS}) l ON l.scan_id = s.label_id"


def filed(spark, sf_dir):
    rows = D.table(spark, sf_dir, FILED)
    of_label = checks(spark, sf_dir).withColumnRenamed("scan_id", "label_id")
    return rows, rows.select("scan_id", "label_id").join(of_label, "label_id").drop("label_id")


@query(f"SELECT s.scan_id, CASE WHEN s.verdict <> 'VIOLATION' THEN 'not a violation — nothing to file' WHEN s.dossier_sha256 IS NULL THEN 'no dossier attached to this scan' ELSE NULL END AS reason, CASE WHEN s.verdict = 'VIOLATION' AND s.dossier_sha256 IS NOT NULL THEN CASE b.k6 WHEN 0 THEN 'Tasty Foods Ltd.' WHEN 1 THEN 'Box Co' WHEN 2 THEN 'Plain Foods' WHEN 4 THEN 'Global Foods' WHEN 5 THEN CAST(b.pin AS STRING) ELSE 'Not declared on package (Rule 6(1)(a) finding)' END ELSE NULL END AS respondent FROM {LABELLED} s JOIN ({D.LABEL_BASE}) b ON b.scan_id = s.label_id")
def consumer_cases(spark, sf_dir):
    cases = gateway.consumer_cases(*filed(spark, sf_dir))
    return cases.select("scan_id", "reason", F.col("payload.case.respondent.name").alias("respondent"))


@query(f"SELECT s.scan_id, substr(COALESCE(CASE WHEN b.k6 IN (0, 1, 4, 5) THEN CAST(b.pin AS STRING) WHEN b.k7 = 0 THEN '400050' WHEN b.k7 IN (5, 6) THEN '411001' ELSE NULL END, ''), 1, 1) AS zone_digit FROM {LABELLED} s JOIN ({D.LABEL_BASE}) b ON b.scan_id = s.label_id WHERE s.verdict = 'VIOLATION'")
def helpline_complaints(spark, sf_dir):
    zone = {v: k for k, v in V.PIN_ZONES.items()}
    out = gateway.helpline_complaints(*filed(spark, sf_dir))
    return out.select("scan_id", F.coalesce(T.lookup(zone, F.col("pin_zone")), F.lit("")).alias("zone_digit"))


# ---- golden values ---------------------------------------------------------------------------------------------------
EXPECTED = "SELECT CAST(doc_id AS STRING) AS fixture, 'quality' AS rule FROM {labels} WHERE quality = 0 UNION ALL SELECT CAST(doc_id AS STRING), 'toxic' FROM {labels} WHERE toxic = 1"
FOUND = "SELECT CAST(doc_id AS STRING) AS fixture, 'quality' AS rule, 'FAIL' AS status FROM {documents} d WHERE text LIKE '%!!%' OR text LIKE '%$$$%' OR text LIKE '%###%' UNION ALL SELECT CAST(doc_id AS STRING), 'toxic', 'FAIL' FROM {documents} d WHERE text LIKE '%idiot%' OR text LIKE '%scum%'"
FIXTURES = "SELECT CAST(doc_id AS STRING) AS fixture, CASE WHEN doc_id % 10 = 0 THEN 'RETRY' ELSE 'PASS' END AS verdict, CASE WHEN doc_id % 25 = 7 THEN 'INTERNAL' ELSE CAST(NULL AS STRING) END AS error FROM {labels}"
OUTCOMES = f"""SELECT f.fixture, CASE WHEN f.error IS NOT NULL THEN 'error' WHEN f.verdict = 'RETRY' THEN 'capture_retry' WHEN COALESCE(x.fn, 0) = 0 AND COALESCE(x.fp, 0) = 0 THEN 'ok' ELSE 'mismatch' END AS status,
CAST(COALESCE(x.tp, 0) AS BIGINT) AS tp, CAST(COALESCE(x.fp, 0) AS BIGINT) AS fp, CAST(COALESCE(x.fn, 0) AS BIGINT) AS fn FROM ({FIXTURES}) f LEFT JOIN (
SELECT COALESCE(e.fixture, g.fixture) AS fixture, SUM(CASE WHEN e.rule IS NOT NULL AND g.rule IS NOT NULL THEN 1 ELSE 0 END) AS tp, SUM(CASE WHEN e.rule IS NULL THEN 1 ELSE 0 END) AS fp, SUM(CASE WHEN g.rule IS NULL THEN 1 ELSE 0 END) AS fn
FROM ({EXPECTED}) e FULL OUTER JOIN ({FOUND}) g ON e.fixture = g.fixture AND e.rule = g.rule GROUP BY 1) x ON x.fixture = f.fixture"""


def outcomes(spark, sf_dir):
    return golden.compare(*[D.table(spark, sf_dir, s) for s in (FIXTURES, EXPECTED, FOUND)])


@query(f"SELECT fixture, status, tp, fp, fn FROM ({OUTCOMES}) o")
def golden_outcomes(spark, sf_dir):
    out = outcomes(spark, sf_dir)
    n = lambda c: F.size(c).cast("long")
    return out.select("fixture", "status", n(F.array_intersect("expected", "failed")).alias("tp"), n(F.col("extra_fail")).alias("fp"), n(F.col("missing_fail")).alias("fn"))


@query(f"SELECT CAST(COUNT(*) AS BIGINT) AS fixtures, CAST(COUNT(CASE WHEN status = 'ok' THEN 1 END) AS BIGINT) AS ok, CAST(COUNT(CASE WHEN status = 'mismatch' THEN 1 END) AS BIGINT) AS mismatch, CAST(COUNT(CASE WHEN status = 'capture_retry' THEN 1 END) AS BIGINT) AS capture_retry, CAST(COUNT(CASE WHEN status = 'error' THEN 1 END) AS BIGINT) AS errors, CAST(SUM(CASE WHEN status IN ('ok', 'mismatch') THEN tp ELSE 0 END) AS BIGINT) AS rule_tp, CAST(SUM(CASE WHEN status IN ('ok', 'mismatch') THEN fp ELSE 0 END) AS BIGINT) AS rule_fp, CAST(SUM(CASE WHEN status IN ('ok', 'mismatch') THEN fn ELSE 0 END) AS BIGINT) AS rule_fn FROM ({OUTCOMES}) o")
def golden_summary(spark, sf_dir):
    names = ["fixtures", "ok", "mismatch", "capture_retry", "errors", "rule_tp", "rule_fp", "rule_fn"]
    return golden.summary(outcomes(spark, sf_dir)).select(*[F.col(c).cast("long").alias(c) for c in names])


# ---- tokens, detections, validators ----------------------------------------------------------------------------------
TOKENS = """SELECT scan_id, tok, text, CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(w AS INT) AS w, CAST(24 AS INT) AS h, CAST(0.9 AS DOUBLE) AS conf, engine FROM (
SELECT scan_id, 0 AS tok, product_name AS text, 20 AS x, 10 AS y, 300 AS w, 'mlkit' AS engine FROM ({lb}) a UNION ALL SELECT scan_id, 1, 'Net Quantity:', 20, 60, 150, 'mlkit' FROM ({lb}) a
UNION ALL SELECT scan_id, 2, replace(net_qty, 'Net Quantity: ', ''), 180, 62, 60, 'mlkit' FROM ({lb}) a UNION ALL SELECT scan_id, 3, mrp, 20, 100, 400, 'mlkit' FROM ({lb}) a
UNION ALL SELECT scan_id, 4, usp, 20, 140, 300, 'mlkit' FROM ({lb}) a UNION ALL SELECT scan_id, 5, mfg_date, 20, 180, 200, 'mlkit' FROM ({lb}) a
UNION ALL SELECT scan_id, 6, mfg_address, 20, 220, 420, 'mlkit' FROM ({lb}) a UNION ALL SELECT scan_id, 7, origin, 20, 300, 200, 'mlkit' FROM ({lb}) a
UNION ALL SELECT scan_id, 8, consumer_care, 20, 340, 500, 'tesseract' FROM ({lb}) a) t WHERE text IS NOT NULL""".replace("{lb}", D.LABELS)


def token_rows() -> list[Column]:
    """The tokens of TOKENS as structs over one row of the labels."""
    rows = [
        ("product_name", F.col("product_name"), 20, 10, 300, "mlkit"), ("net_qty", F.lit("Net Quantity:"), 20, 60, 150, "mlkit"),
        ("net_qty", F.replace("net_qty", F.lit("Net Quantity: "), F.lit("")), 180, 62, 60, "mlkit"), ("mrp", F.col("mrp"), 20, 100, 400, "mlkit"),
        ("usp", F.col("usp"), 20, 140, 300, "mlkit"), ("mfg_date", F.col("mfg_date"), 20, 180, 200, "mlkit"), ("mfg_address", F.col("mfg_address"), 20, 220, 420, "mlkit"),
        ("origin", F.col("origin"), 20, 300, 200, "mlkit"), ("consumer_care", F.col("consumer_care"), 20, 340, 500, "tesseract"),
    ]
    return [
        F.struct(F.lit(k).alias("tok"), text.alias("text"), F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(w).alias("w"), F.lit(24).alias("h"), F.lit(0.9).alias("conf"), F.lit(engine).alias("engine"))
        for k, (_, text, x, y, w, engine) in enumerate(rows)
    ]


def tokens(spark, sf_dir):
    """The rows of TOKENS in one pass over the labels."""
    return labels(spark, sf_dir).select("scan_id", F.inline(F.array(*token_rows()))).where("text is not null")


#: The line that each token of TOKENS lies on: the quantity's two tokens share one, all others have one of their own.
LINED = f"(SELECT *, dense_rank() OVER (PARTITION BY scan_id ORDER BY CASE WHEN tok = 2 THEN 60 ELSE y END) - 1 AS line FROM ({TOKENS}) t)"


@query(f"SELECT scan_id, CAST(line AS INT) AS line, CAST(COUNT(*) AS BIGINT) AS tokens FROM {LINED} l GROUP BY scan_id, line")
def cluster_lines(spark, sf_dir):
    lines = extract.cluster_lines(tokens(spark, sf_dir))
    return lines.groupBy("scan_id", "line").agg(F.count("*").alias("tokens"))


def token_arrays(spark, sf_dir):
    """scan_id and the tokens of TOKENS as an array; a row a scan, as requests carry them."""
    return labels(spark, sf_dir).select("scan_id", F.filter(F.array(*token_rows()), lambda t: t["text"].isNotNull()).alias("tokens"))


#: The field that each token of TOKENS becomes by the layout: an anchor with a value that decodes. A price word without its anchor
#: (k7 = 5), the topmost of what is left, names the product; so do, where nothing else can, a date or an address of care without theirs.
FIELDED = f"""(SELECT k.*, l.product_name, l.net_qty, l.mrp, l.usp, l.mfg_date, l.mfg_address, l.origin, l.consumer_care,
CASE WHEN k7 = 5 THEN l.mrp WHEN k13 <> 0 THEN l.product_name WHEN k6 = 3 THEN l.mfg_date WHEN k7 IN (1, 2, 4) THEN l.consumer_care END AS name_text,
CASE WHEN k7 = 5 THEN 100 WHEN k13 <> 0 THEN 10 WHEN k6 = 3 THEN 180 ELSE 340 END AS name_y, CASE WHEN k7 = 5 THEN 400 WHEN k13 <> 0 THEN 300 WHEN k6 = 3 THEN 200 ELSE 500 END AS name_w
FROM ({D.LABEL_PRICED}) k JOIN ({D.LABELS}) l ON l.scan_id = k.scan_id)"""
FIELD_ROWS = " UNION ALL ".join(
    f"SELECT scan_id, '{field}' AS field, {text} AS raw, {unit} AS unit, 20 AS x, {y} AS y, {w} AS w, {h} AS h FROM {FIELDED} f WHERE {found}"
    for field, text, unit, y, w, h, found in [
        ("net_qty", "net_qty", CANON, 60, 220, 26, "k23 <> 0"), ("mrp", "mrp", "NULL", 100, 400, 24, "k7 < 5"), ("usp", "usp", "price_unit", 140, 300, 24, "paise IS NOT NULL"),
        ("mfg_date", "mfg_date", "NULL", 180, 200, 24, "k6 < 3"), ("mfg_address", "mfg_address", "NULL", 220, 420, 24, "k6 IN (0, 1, 2, 4)"), ("origin", "origin", "NULL", 300, 200, 24, "origin IS NOT NULL"),
        ("consumer_care", "consumer_care", "NULL", 340, 500, 24, "k7 IN (0, 5, 6)"), ("product_name", "name_text", "NULL", "name_y", "name_w", 24, "name_text IS NOT NULL"),
    ]
)


@query(FIELD_ROWS)
def extract_fields(spark, sf_dir):
    found = extract.field_rows(folds.with_fields(token_arrays(spark, sf_dir), mm_per_px=None))
    return found.select("scan_id", "field", "raw", "unit", "x", "y", "w", "h")


#: Verdicts of what was read: as of the labels themselves, but for the fields that the layout loses, and for typed prices.
#: Every label has a price or an address of care that is found, so no scan is to be taken again.
READ_VERDICTS = f"""SELECT scan_id, CASE WHEN failed > 0 THEN 'VIOLATION' ELSE 'PASS' END AS verdict, total, CAST(total - failed - na AS BIGINT) AS passed, failed, na
FROM (SELECT scan_id, CAST(CASE WHEN exempt THEN 1 ELSE 10 END AS BIGINT) AS total, CAST(CASE WHEN exempt THEN 0 ELSE bad13 + badc + bade + bad11 + badd + bada + badaa + badn + badb END AS BIGINT) AS failed,
  CAST(CASE WHEN exempt THEN 1 ELSE 1 + na11 + naaa END AS BIGINT) AS na
FROM (SELECT scan_id, exempt,
  CASE WHEN has_q AND unit IN ('gms', 'ltr', 'kgs') THEN 1 ELSE 0 END AS bad13, CASE WHEN has_q AND unit IN ('g', 'kg', 'ml', 'L', 'pcs', 'N', 'cm', 'mg') THEN 0 ELSE 1 END AS badc,
  CASE WHEN k7 IN (0, 1, 2, 4) THEN 0 ELSE 1 END AS bade, CASE WHEN has_q AND k7 < 5 AND unit <> 'N' THEN 0 ELSE 1 END AS na11,
  CASE WHEN NOT (has_q AND k7 < 5 AND unit <> 'N') OR one THEN 0 WHEN paise IS NOT NULL AND price_unit = req AND ABS(paise * num - cents * den) <= num THEN 0 ELSE 1 END AS bad11,
  CASE WHEN k6 < 3 THEN 0 ELSE 1 END AS badd, CASE WHEN k6 IN (0, 4) THEN 0 ELSE 1 END AS bada, CASE WHEN k5 = 2 AND k6 IN (3, 5) THEN 1 ELSE 0 END AS naaa,
  CASE WHEN k5 IN (0, 3) OR (k5 = 2 AND k6 IN (3, 5)) THEN 0 ELSE 1 END AS badaa, CASE WHEN k7 = 0 THEN 0 ELSE 1 END AS badn, CASE WHEN name_text IS NULL THEN 1 ELSE 0 END AS badb
FROM (SELECT *, k23 <> 0 AS has_q, k23 <> 0 AND kind IN ('mass', 'volume') AND (milli <= 10000 OR milli > 25000000) AS exempt FROM {FIELDED} f) g) h) i"""


@query(READ_VERDICTS)
def audit_tokens(spark, sf_dir):
    """From tokens to verdicts in one pass: the plan has no exchange."""
    found = folds.with_fields(token_arrays(spark, sf_dir), mm_per_px=None)
    rows = rules.prepared(found.select("*", *folds.label_columns()), ["fields"]).withColumns({"exemption": rules.exemption(), "glyph_check": F.lit(None).cast(rules.CHECK)})
    rows = rows.select("scan_id", "fields", rules.checks_of(status_only=True).alias("found"))
    count = lambda s: F.size(F.filter("found", lambda x: x == s)).cast("long")
    counted = rows.select("scan_id", folds.declared().alias("ok"), F.size("found").cast("long").alias("total"), count("PASS").alias("passed"), count("FAIL").alias("failed"), count("NA").alias("na"))
    verdict = F.when(~F.col("ok") | (F.col("total") == 0), "RETRY").when(F.col("failed") > 0, "VIOLATION").otherwise("PASS")
    return counted.select("scan_id", verdict.alias("verdict"), "total", "passed", "failed", "na")


@query(f"SELECT scan_id, tok FROM (SELECT *, MIN(CASE engine WHEN 'mlkit' THEN 1 ELSE 2 END) OVER (PARTITION BY scan_id) AS best FROM ({TOKENS}) t) b WHERE best = CASE engine WHEN 'mlkit' THEN 1 ELSE 2 END")
def ocr_tiers(spark, sf_dir):
    return extract.pick_ocr_tier(tokens(spark, sf_dir)).select("scan_id", "tok")


@query(f"SELECT scan_id, string_agg(engine, ',' ORDER BY engine) AS engines FROM (SELECT DISTINCT scan_id, engine FROM ({TOKENS}) t) d GROUP BY scan_id")
def engines_used(spark, sf_dir):
    return gateway.engines_used(tokens(spark, sf_dir)).select("scan_id", F.array_join("engines", ",").alias("engines"))


@query(f"SELECT scan_id, CAST(line AS INT) AS tok, string_agg(text, ' ' ORDER BY x) AS text, MIN(x) AS x, MIN(y) AS y, MAX(x + w) - MIN(x) AS w, MAX(y + h) - MIN(y) AS h FROM {LINED} l GROUP BY scan_id, line")
def merge_words(spark, sf_dir):
    return extract.merge_words(tokens(spark, sf_dir)).select("scan_id", "tok", "text", "x", "y", "w", "h")


#: Every line of every whole text as an OCR token; boxes follow from doc_id and tok.
LINES = "(SELECT doc_id AS scan_id, unnest(range(len(ls))) AS tok, unnest(ls) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM {documents}) d)"
WORDS = f"SELECT scan_id, text, CAST((scan_id + tok) % 60 AS INT) AS w, CAST((scan_id + tok) % 40 AS INT) AS h, CAST((scan_id + tok) % 120 AS DOUBLE) AS conf, CAST(tok AS INT) AS tok FROM {LINES} l"


def text_lines(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("scan_id"), F.posexplode(F.split("text", "\n")).alias("tok", "text"))
    at = lambda n: ((F.col("scan_id") + F.col("tok")) % n).cast("int")
    return docs.select("scan_id", "tok", "text", at(500).alias("x"), at(300).alias("y"), at(60).alias("w"), at(40).alias("h"), at(120).cast("double").alias("conf"), F.lit(2.0).alias("scale"))


@query(f"SELECT scan_id, tok, CAST(CASE WHEN w <= 3 THEN 1 ELSE floor(w / 2.0) + CASE WHEN w % 4 = 3 THEN 1 ELSE 0 END END AS INT) AS w FROM ({WORDS}) t WHERE trim(text) <> '' AND conf >= 35 AND regexp_matches(text, '[\\p{{L}}\\p{{N}}/]') AND w > 0 AND h > 0".replace("{{", "{").replace("}}", "}").replace("CASE WHEN w <= 3 THEN 1", "CASE WHEN w <= 2 THEN 1"))
def clean_words(spark, sf_dir):
    return extract.clean_words(text_lines(spark, sf_dir)).select("scan_id", "tok", "w")


@query(f"SELECT path, CAST(COUNT(*) AS BIGINT) AS n FROM (SELECT CASE WHEN w <= 0 OR h <= 0 THEN 'bbox' END AS path FROM ({WORDS}) a UNION ALL SELECT CASE WHEN conf > 1 THEN 'conf' END FROM ({WORDS}) b UNION ALL SELECT CASE WHEN text IS NULL OR trim(text) = '' THEN 'text' END FROM ({WORDS}) c) p WHERE path IS NOT NULL GROUP BY path")
def validate_tokens(spark, sf_dir):
    rows = text_lines(spark, sf_dir).withColumns({"engine": F.lit("mlkit"), "lang": F.lit("en")})
    return contract.validate_tokens(rows).groupBy("path").agg(F.count("*").alias("n"))


def text_words(spark, sf_dir):
    """Every word of every text (runs without white space) as an OCR word; boxes follow from doc_id and tok."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("doc_id", F.col("doc_id").cast("long"))
    each = docs.select("doc_id", F.posexplode(F.filter(F.split("text", r"[ \t\n\x0B\f\r]+"), lambda x: x != "")).alias("tok", "text"))
    at = lambda n: ((F.col("doc_id") + F.col("tok")) % n).cast("int")
    return each.select(F.col("doc_id").alias("scan_id"), "tok", "text", at(500).alias("x"), at(300).alias("y"), at(60).alias("w"), at(40).alias("h"), at(120).cast("double").alias("conf"), F.lit(2.0).alias("scale"))


TEXT_WORDS = r"""(SELECT doc_id AS scan_id, CAST(tok AS INT) AS tok, text, (doc_id + tok) % 60 AS w, (doc_id + tok) % 40 AS h, (doc_id + tok) % 120 AS conf
FROM (SELECT doc_id, unnest(range(len(ws))) AS tok, unnest(ws) AS text FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws FROM {documents}) d) e)"""


@query(f"SELECT scan_id, tok, CAST(greatest(1, CASE WHEN w % 2 = 0 THEN w // 2 ELSE (w + 1) // 2 - (w + 1) // 2 % 2 END) AS INT) AS w FROM {TEXT_WORDS} t WHERE conf >= 35 AND w > 0 AND h > 0 AND regexp_matches(text, '[\\p{{L}}\\p{{N}}/]')")
def clean_text_words(spark, sf_dir):
    return extract.clean_words(text_words(spark, sf_dir)).select("scan_id", "tok", "w")


@query(f"SELECT path, CAST(COUNT(*) AS BIGINT) AS n FROM (SELECT CASE WHEN w = 0 OR h = 0 THEN 'bbox' END AS path FROM {TEXT_WORDS} a UNION ALL SELECT CASE WHEN conf > 1 THEN 'conf' END FROM {TEXT_WORDS} b) p WHERE path IS NOT NULL GROUP BY path")
def validate_text_tokens(spark, sf_dir):
    rows = text_words(spark, sf_dir).withColumns({"engine": F.lit("mlkit"), "lang": F.lit("en")})
    return contract.validate_tokens(rows).groupBy("path").agg(F.count("*").alias("n"))


@query(f"SELECT path, CAST(COUNT(*) AS BIGINT) AS n FROM (SELECT CASE WHEN scan_id % 11 = 0 THEN 'summary.total' END AS path FROM ({VERDICTS}) v UNION ALL SELECT CASE WHEN scan_id % 13 = 0 THEN 'completed_utc' END FROM ({VERDICTS}) v) p WHERE path IS NOT NULL GROUP BY path")
def validate_results(spark, sf_dir):
    rows = labels(spark, sf_dir)
    # read twice, by verdicts and by the contract: findings are worked out once
    found = D.arrived(rules.audit(rows).select("scan_id", "status"))
    v = rules.verdicts(found, rows.select("scan_id"))
    wrong = F.when(F.col("scan_id") % 11 == 0, 1).otherwise(0)
    results = v.select("scan_id", "verdict", F.when(F.col("scan_id") % 13 == 0, "yesterday").otherwise("2026-01-01T00:00:00.000Z").alias("completed_utc"), (F.col("total") + wrong).alias("total"), F.col("passed").alias("pass"), F.col("failed").alias("fail"), "na", F.lit(None).cast("string").alias("error"), F.lit(0).alias("n_prompts"))
    return contract.validate_results(results, found).groupBy("path").agg(F.count("*").alias("n"))


@query(f"SELECT path, CAST(COUNT(*) AS BIGINT) AS n FROM (SELECT CASE WHEN scan_id % 19 = 0 THEN 'attempts' END AS path FROM ({D.GATEWAY}) g) p WHERE path IS NOT NULL GROUP BY path")
def validate_queue(spark, sf_dir):
    rows = recorded(spark, sf_dir).withColumn("attempts", F.when(F.col("scan_id") % 19 == 0, -1).otherwise(F.col("attempts")))
    return contract.validate_queue(rows).groupBy("path").agg(F.count("*").alias("n"))


def detections(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("embedding is not null and size(embedding) >= 16")
    part = lambda k: F.abs(F.get("embedding", F.lit(k)).cast("double"))
    return e.select(
        F.floor(F.col("vec_id") / 50).alias("image_id"), F.col("vec_id").alias("anchor"), (F.lit(0.3) + part(0)).alias("cx"), (F.lit(0.3) + part(1)).alias("cy"), (F.lit(0.2) + part(2)).alias("w"), (F.lit(0.2) + part(3)).alias("h"),
        F.array(*[F.least(F.lit(1.0), part(k) * 3) for k in range(4, 9)]).alias("scores"), F.lit(0.5).alias("gain"), F.lit(0.0).alias("pad_x"), F.lit(80.0).alias("pad_y"),
    )


@query()
def suppress_detections(spark, sf_dir):
    return geometry.suppress_detections(detections(spark, sf_dir))


@query()
def detection_parity(spark, sf_dir):
    kept = geometry.suppress_detections(detections(spark, sf_dir))
    moved = kept.withColumn("x", F.col("x") + F.when(F.col("image_id") % 5 == 0, 200.0).otherwise(0.5))
    return geometry.unmatched_detections(kept, moved).groupBy("label").agg(F.count("*").alias("n"))


@query("SELECT ROUND(MAX(CASE WHEN i <= 4 THEN ABS(v) * CAST(0.5 AS DOUBLE) END), 9) AS box_diff, ROUND(MAX(CASE WHEN i > 4 THEN ABS(v) * CAST(0.5 AS DOUBLE) END), 9) AS score_diff FROM (SELECT UNNEST(range(1, 1 + len(embedding))) AS i, CAST(UNNEST(embedding) AS DOUBLE) AS v FROM {embeddings}) u")
def tensor_diff(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("col"), F.posexplode("embedding").alias("row", "v")).withColumn("v", F.col("v").cast("double"))
    a, b = e.select("row", "col", F.col("v").alias("value")), e.select("row", "col", (F.col("v") * 0.5).alias("value"))
    return geometry.tensor_diff(a, b).select(F.round("box_diff", 9).alias("box_diff"), F.round("score_diff", 9).alias("score_diff"))


MARKERS = "SELECT CAST(l_orderkey AS BIGINT) AS scan_id, CAST(l_linenumber AS DOUBLE) AS x1, 0.0 AS y1, CAST(l_linenumber + l_quantity AS DOUBLE) AS x2, 0.0 AS y2, CAST(l_linenumber + l_quantity AS DOUBLE) AS x3, CAST(l_quantity AS DOUBLE) AS y3, CAST(l_linenumber AS DOUBLE) AS x4, CAST(l_quantity AS DOUBLE) AS y4, 40.0 AS side_mm FROM {lineitem}"


@query("SELECT CAST(l_orderkey AS BIGINT) AS scan_id, ROUND(CAST(40.0 AS DOUBLE) / MAX(l_quantity), 6) AS mm_per_px FROM {lineitem} GROUP BY 1 HAVING MAX(l_quantity) >= 5")
def marker_scales(spark, sf_dir):
    return geometry.marker_scale(D.table(spark, sf_dir, MARKERS))


SHOTS = "SELECT CAST(event_id AS BIGINT) AS scan_id, CASE WHEN event_type = 'error' THEN FALSE ELSE NULL END AS ok, CAST(event_id % 200 AS DOUBLE) AS laplacian_var, CAST(event_id % 30 AS DOUBLE) / 10 AS glare_pct FROM {events}"


@query(f"SELECT scan_id, (ok IS NULL AND laplacian_var >= 100 AND glare_pct <= 1.0) AS ok, CAST(CASE WHEN ok IS NOT NULL THEN 1 ELSE CASE WHEN laplacian_var < 100 THEN 1 ELSE 0 END + CASE WHEN glare_pct > 1.0 THEN 1 ELSE 0 END END AS INT) AS prompts FROM ({SHOTS}) s")
def quality_gates(spark, sf_dir):
    shots = D.table(spark, sf_dir, SHOTS).withColumn("prompts", F.lit(None).cast("array<string>"))
    return geometry.quality_gate(shots).select("scan_id", "ok", F.size("prompts").alias("prompts"))


ROIS = "SELECT CAST(event_id % 2000 AS BIGINT) AS scan_id, CASE event_id % 3 WHEN 0 THEN 'PDP' WHEN 1 THEN 'PRICE' ELSE 'BOP' END AS label, CAST(event_id % 97 AS DOUBLE) / 100 AS score, CAST(1.5 AS DOUBLE) AS x, CAST(2.5 AS DOUBLE) AS y, CAST(10 AS DOUBLE) AS w, CAST(20 AS DOUBLE) AS h FROM {events} WHERE event_type = 'view'"
CLASSICAL = "SELECT CAST(event_id % 2000 AS BIGINT) AS scan_id, CASE event_id % 2 WHEN 0 THEN 'PDP' ELSE 'BOP' END AS roi, CAST(1 AS INT) AS x, CAST(2 AS INT) AS y, CAST(3 AS INT) AS w, CAST(4 AS INT) AS h, CAST(0.5 AS DOUBLE) AS conf, CAST(event_id AS INT) AS pos FROM {events} WHERE event_type = 'click'"


@query(f"SELECT scan_id, source, roi, CAST(row_number() OVER (PARTITION BY scan_id ORDER BY source DESC, by_score, by_label, pos) AS INT) AS ord FROM (SELECT scan_id, 'ml' AS source, label AS roi, -score AS by_score, label AS by_label, 0 AS pos FROM ({ROIS}) r UNION ALL SELECT c.scan_id, 'classical', c.roi, NULL, NULL, c.pos FROM ({CLASSICAL}) c WHERE NOT EXISTS (SELECT 1 FROM ({ROIS}) r WHERE r.scan_id = c.scan_id AND r.label = c.roi)) u")
def merge_rois(spark, sf_dir):
    merged = geometry.merge_rois(D.table(spark, sf_dir, CLASSICAL), D.table(spark, sf_dir, ROIS))
    return merged.select("scan_id", "source", "roi", "ord")


@query("SELECT s.split, c.class_id, CAST(COUNT(b.class_id) AS BIGINT) AS boxes FROM (SELECT 'val' AS split UNION ALL SELECT 'train') s CROSS JOIN (SELECT DISTINCT CAST(label AS BIGINT) AS class_id FROM {embeddings}) c LEFT JOIN (SELECT CASE WHEN CAST(vec_id AS BIGINT) < 100 THEN 'val' ELSE 'train' END AS split, CAST(label AS BIGINT) AS class_id FROM {embeddings}) b ON b.split = s.split AND b.class_id = c.class_id GROUP BY 1, 2")
def dataset_stats(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("image_no"), F.col("label").cast("long").alias("class_id"))
    return geometry.dataset_stats(e, e.select("class_id").distinct(), 100)


@query("SELECT CAST(event_id AS BIGINT) AS scan_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE 'label-dossier-v1|' || CAST(event_id AS STRING) || '|' || sha256(CAST(event_id AS STRING)) END AS payload FROM {events}")
def sign_payloads(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("scan_id", F.col("event_id").cast("string"))
    sha = F.when(F.col("event_id") % 9 == 0, "short").otherwise(F.sha2("scan_id", 256))
    return e.select(F.col("event_id").cast("long").alias("scan_id"), gateway.sign_payload(F.col("scan_id"), sha).alias("payload"))


@query(f"SELECT code, CAST(COUNT(*) AS BIGINT) AS n FROM (SELECT CASE WHEN r.event_id % 8 = 0 THEN 'BAD_REQUEST' WHEN g.scan_id IS NULL THEN 'NOT_FOUND' WHEN g.sig_status = 'signed' THEN 'ALREADY_SIGNED' WHEN g.dossier_sha256 IS NULL THEN 'NO_DOSSIER' ELSE 'ACCEPTED' END AS code FROM {{events}} r LEFT JOIN ({D.GATEWAY}) g ON g.scan_id = r.event_id * 2) c GROUP BY code")
def signature_codes(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    requests = e.select((F.col("event_id") * 2).cast("string").alias("scan_id"), F.when(F.col("event_id") % 8 == 0, "").otherwise("sig").alias("signature"))
    ledger = recorded(spark, sf_dir).withColumn("scan_id", F.col("scan_id").cast("string"))
    return gateway.attach_signatures(requests, ledger).groupBy("code").agg(F.count("*").alias("n"))


# ---- ledger views, evidence, options, calibration --------------------------------------------------------------------
@query(f"SELECT scan_id, CASE WHEN verdict = 'VIOLATION' THEN TRUE WHEN verdict = 'PASS' THEN scan_id % 2 = 0 ELSE FALSE END AS dossier FROM ({D.GATEWAY}) g")
def dossier_gates(spark, sf_dir):
    return recorded(spark, sf_dir).select("scan_id", gateway.dossier_gate(F.col("verdict"), F.col("scan_id") % 2 == 0).alias("dossier"))


FRAMES = "SELECT scan_id, CAST(1600 AS INT) AS frame_w, CAST(900 + scan_id % 300 AS INT) AS frame_h FROM ({lb}) b".replace("{lb}", D.LABEL_BASE)
BOXED = f"SELECT scan_id, ord, rule, status, CASE WHEN ord = 5 THEN CAST(NULL AS INT) ELSE CAST(scan_id % 1500 AS INT) END AS ex, CAST(40 * ord AS INT) AS ey, CAST(20 + scan_id % 400 AS INT) AS ew, CAST(20 AS INT) AS eh FROM ({D.CHECKS}) c"


@query(f"""SELECT scan_id, CAST(n AS INT) AS n, rule, CAST(cx AS BIGINT) AS cx, CAST(cy AS BIGINT) AS cy, CAST(LEAST(frame_w, ex + ew + dx) - cx AS BIGINT) AS cw, CAST(LEAST(frame_h, ey + eh + 3) - cy AS BIGINT) AS ch FROM (
SELECT b.*, f.frame_w, f.frame_h, CAST(FLOOR(ew * 0.15) AS BIGINT) AS dx, GREATEST(0, ex - CAST(FLOOR(ew * 0.15) AS BIGINT)) AS cx, GREATEST(0, ey - 3) AS cy FROM (
SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY ord) AS n FROM ({BOXED}) x WHERE status = 'FAIL' AND ex IS NOT NULL) b JOIN ({FRAMES}) f ON f.scan_id = b.scan_id WHERE n <= 6) y
WHERE LEAST(frame_w, ex + ew + dx) - cx >= 8 AND LEAST(frame_h, ey + eh + 3) - cy >= 8""")
def evidence_manifest(spark, sf_dir):
    found = gateway.evidence_manifest(D.table(spark, sf_dir, BOXED), D.table(spark, sf_dir, FRAMES))
    return found.select("scan_id", "n", "rule", *[F.col(c).cast("long").alias(c) for c in ("cx", "cy", "cw", "ch")])


TRUTH = "SELECT CAST(p_partkey AS STRING) AS fixture, CASE p_partkey % 4 WHEN 0 THEN 'pouch' WHEN 1 THEN 'bottle' WHEN 2 THEN 'odd' ELSE 'rectangular' END AS shape, CAST(p_size AS DOUBLE) AS height, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE CAST(4.0 AS DOUBLE) END AS width, CASE WHEN p_partkey % 5 = 0 THEN CAST(9.0 AS DOUBLE) ELSE NULL END AS given_height, CAST(p_partkey % 6 AS INT) AS n_fields FROM {part}"


def truth(spark, sf_dir):
    none = F.lit(None).cast("double")
    dims = F.struct("height", "width", none.alias("diameter"), none.alias("total_surface"))
    options = F.struct(F.col("given_height").alias("package_height_cm"), none.alias("package_width_cm"), none.alias("package_diameter_cm"), none.alias("total_surface_cm2"))
    return D.table(spark, sf_dir, TRUTH).select("fixture", "shape", dims.alias("dims"), options.alias("options"), "n_fields")


@query(f"SELECT fixture, COALESCE(given_height, height) AS package_height_cm, width AS package_width_cm FROM ({TRUTH}) t")
def options_from_truth(spark, sf_dir):
    return golden.options_from_truth(truth(spark, sf_dir)).select("fixture", "package_height_cm", "package_width_cm")


@query(f"SELECT problem, CAST(COUNT(*) AS BIGINT) AS n FROM (SELECT CASE WHEN shape = 'odd' THEN 'shape is not one of the known ones' END AS problem FROM ({TRUTH}) a UNION ALL SELECT CASE WHEN shape IN ('pouch', 'rectangular') AND width IS NULL THEN 'flat shapes want height and width' END FROM ({TRUTH}) b UNION ALL SELECT CASE WHEN n_fields = 0 THEN 'fields required' END FROM ({TRUTH}) c) p WHERE problem IS NOT NULL GROUP BY problem")
def validate_truth(spark, sf_dir):
    return golden.validate_truth(truth(spark, sf_dir)).groupBy("problem").agg(F.count("*").alias("n"))


RUN_A = "SELECT 'i' || CAST(event_id AS STRING) AS image_sha256, CAST(1 + event_id % 10 AS DOUBLE) / 10 AS mm_per_px, CAST(event_id % 200 AS DOUBLE) AS laplacian_var, CAST(event_id % 30 AS DOUBLE) / 10 AS glare_pct FROM {events}"
RUN_B = "SELECT 'i' || CAST(event_id AS STRING) AS image_sha256, CAST(1 + event_id % 10 AS DOUBLE) / 10 * CASE WHEN event_id % 4 = 0 THEN 1.2 ELSE 1.01 END AS mm_per_px, CAST((event_id + 5) % 200 AS DOUBLE) AS laplacian_var, CAST(event_id % 30 AS DOUBLE) / 10 AS glare_pct FROM {events}"


@query("SELECT scale_ok, blur_same, CAST(COUNT(*) AS BIGINT) AS n FROM (SELECT event_id % 4 <> 0 AS scale_ok, (event_id % 200 < 100) = ((event_id + 5) % 200 < 100) AS blur_same FROM {events}) e GROUP BY 1, 2")
def calibration_agreement(spark, sf_dir):
    both = geometry.calibration_agreement(D.table(spark, sf_dir, RUN_A), D.table(spark, sf_dir, RUN_B))
    return both.groupBy("scale_ok", "blur_same").agg(F.count("*").alias("n"))


@query("SELECT CAST(l_orderkey AS BIGINT) AS scan_id, CAST(l_linenumber AS INT) AS tok, CAST(l_quantity + CASE WHEN l_orderkey % 2 = 0 THEN 100 ELSE 0 END AS BIGINT) AS x FROM {lineitem}")
def shift_boxes(spark, sf_dir):
    rows = D.table(spark, sf_dir, "SELECT CAST(l_orderkey AS BIGINT) AS scan_id, CAST(l_linenumber AS INT) AS tok, CAST(l_quantity AS BIGINT) AS x, CAST(0 AS BIGINT) AS y FROM {lineitem}")
    origins = D.table(spark, sf_dir, "SELECT DISTINCT CAST(l_orderkey AS BIGINT) AS scan_id, CAST(100 AS BIGINT) AS ox, CAST(5 AS BIGINT) AS oy FROM {lineitem} WHERE l_orderkey % 2 = 0")
    return geometry.shift_boxes(rows, origins).select("scan_id", "tok", "x")


ANNOTATED = "SELECT CAST(event_id AS BIGINT) AS image_id, CAST(event_id % 5 AS INT) AS class_id, CAST(event_id % 100 AS DOUBLE) AS x, CAST(event_id % 50 AS DOUBLE) AS y, CAST(8 AS DOUBLE) AS w, CAST(16 AS DOUBLE) AS h, CAST(128 AS DOUBLE) AS img_w, CAST(64 AS DOUBLE) AS img_h FROM {events}"


@query(f"SELECT image_id, class_id, ROUND((x + 4) / 128, 6) AS cx, ROUND((y + 8) / 64, 6) AS cy, CAST(0.0625 AS DOUBLE) AS bw, CAST(0.25 AS DOUBLE) AS bh FROM ({ANNOTATED}) a")
def normalise_boxes(spark, sf_dir):
    return geometry.normalise_boxes(D.table(spark, sf_dir, ANNOTATED))


@query("SELECT CAST(event_id AS BIGINT) AS scan_id, CASE WHEN event_id % 4 = 0 AND event_id % 10 < 3 THEN 'scale mismatch,tilt' WHEN event_id % 10 < 3 THEN 'tilt' WHEN event_id % 4 = 0 THEN 'scale mismatch' ELSE '' END AS warnings, event_id % 3 = 0 AS stopped, CASE WHEN event_id % 7 = 0 THEN 'pouch' ELSE 'bottle' END AS shape FROM {events}")
def calibration_gates(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    scale = F.when(F.col("event_id") % 3 != 0, 0.2)
    warned = geometry.calibration_warnings(F.lit(0.2), F.when(F.col("event_id") % 4 == 0, 0.3).otherwise(0.21), F.when(F.col("event_id") % 10 < 3, 30.0).otherwise(5.0))
    shape = geometry.effective_shape(F.when(F.col("event_id") % 7 == 0, "pouch").otherwise(""), F.lit("bottle"))
    return e.select(F.col("event_id").cast("long").alias("scan_id"), F.array_join(warned, ",").alias("warnings"), geometry.scale_gate(scale, F.lit(None).cast("double")).isNotNull().alias("stopped"), shape.alias("shape"))


@query(f"SELECT scan_id, CAST(SUM(CASE WHEN status = 'FAIL' THEN 1 ELSE 0 END) AS BIGINT) AS fails, CAST(COUNT(*) AS BIGINT) AS checks FROM ({D.CHECKS}) c GROUP BY scan_id")
def result_documents(spark, sf_dir):
    from labelaudit.sources import tables

    rows = labels(spark, sf_dir)
    found = rules.audit(rows)
    fields = rows.select("scan_id", F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("raw"), F.lit(None).cast("string").alias("unit"), F.lit(0.9).alias("conf")) for f in V.FIELDS]))).where("raw is not null")
    docs = tables.result_documents(rules.verdicts(found, rows), found, fields)
    return docs.select("scan_id", F.col("result.summary.fail").alias("fails"), F.size("result.checks").cast("long").alias("checks"))


@query(f"SELECT scan_id, CASE WHEN new THEN 'signed' ELSE sig_status END AS sig_status FROM (SELECT *, scan_id % 5 = 0 AS new FROM ({D.GATEWAY}) g) h")
def signatures_applied(spark, sf_dir):
    ledger = recorded(spark, sf_dir).withColumn("signature", F.lit(None).cast("string"))
    got = ledger.where("scan_id % 5 = 0").select("scan_id", F.lit("s").alias("signature"))
    return gateway.apply_signatures(ledger, got).select("scan_id", "sig_status")


# ---- findings, envelopes, requests -----------------------------------------------------------------------------------
CITED = "CASE rule " + " ".join("WHEN '{}' THEN '{}'".format(k, v.replace("'", "''")) for k, v in V.CITATIONS.items()) + " ELSE rule END"


@query(f"SELECT scan_id, ord, rule, status, {CITED} AS citation FROM ({D.CHECKS}) c")
def cited_findings(spark, sf_dir):
    return rules.findings(checks(spark, sf_dir)).select("scan_id", F.col("ord").cast("int").alias("ord"), "rule", "status", "citation")


@query(f"SELECT 1 AS schema_version, 'scan.v1' AS kind, scan_id, verdict, dossier_sha256, FALSE AS sig_verified, sig_status, attempts FROM ({D.GATEWAY}) g")
def sync_envelopes(spark, sf_dir):
    return gateway.sync_envelopes(recorded(spark, sf_dir)).select("schema_version", "kind", "scan_id", "verdict", "dossier_sha256", "sig_verified", "sig_status", "attempts")


@query(f"SELECT path, CAST(COUNT(*) AS BIGINT) AS n FROM (SELECT CASE WHEN scan_id % 9 = 0 THEN 'sig_status' END AS path FROM ({D.GATEWAY}) a UNION ALL SELECT CASE WHEN scan_id % 14 = 0 THEN 'error.code' END FROM ({D.GATEWAY}) b UNION ALL SELECT CASE WHEN scan_id % 21 = 0 THEN 'verified' END FROM ({D.GATEWAY}) c) p WHERE path IS NOT NULL GROUP BY path")
def validate_signature_responses(spark, sf_dir):
    k = F.col("scan_id")
    rows = recorded(spark, sf_dir).select("scan_id", F.lit(True).alias("accepted"), F.when(k % 9 == 0, "lost").otherwise(F.col("sig_status")).alias("sig_status"), F.when(k % 21 != 0, True).alias("verified"), F.when(k % 14 == 0, "ODD").when(k % 2 == 0, "NOT_FOUND").alias("code"))
    return contract.validate_signature_responses(rows).groupBy("path").agg(F.count("*").alias("n"))


@query(f"SELECT path, CAST(COUNT(*) AS BIGINT) AS n FROM (SELECT CASE WHEN device % 3 = 0 THEN 'failed' END AS path FROM (SELECT DISTINCT device FROM ({DELIVERED}) d) e) p WHERE path IS NOT NULL GROUP BY path")
def validate_sync_summaries(spark, sf_dir):
    rows = gateway.sync_summary(sent(spark, sf_dir)).withColumn("failed", F.when(F.col("device") % 3 == 0, -1).otherwise(F.col("failed")))
    return contract.validate_sync_summaries(rows).groupBy("path").agg(F.count("*").alias("n"))


REJECTED = """SELECT CAST(event_id AS STRING) AS scan_id, CASE WHEN event_id % 31 = 0 THEN 'schema 1 expected' WHEN event_id % 29 = 0 THEN 'tokens must be a non-empty list' WHEN event_id % 23 = 0 THEN 'a token''s text must be non-empty'
WHEN event_id % 19 = 0 THEN 'a token''s bbox must be x, y, w, h with w and h above 0' WHEN event_id % 17 = 0 THEN 'a token''s conf must be in 0..1' WHEN event_id % 13 = 0 THEN 'geometry.mm_per_px must be positive'
WHEN event_id % 11 = 0 THEN 'shape_hint must be a shape' WHEN event_id % 8 = 0 THEN 'captured_utc must be ISO-8601' WHEN event_id % 9 = 0 THEN 'gps needs lat and lon' WHEN event_id % 7 = 0 THEN 'roi_boxes: invalid frame' ELSE NULL END AS message FROM {events}"""


def requests(spark, sf_dir):
    """Each event as the JSON text of a request, with faults by its id, read as such texts are."""
    from labelaudit.sources import tables

    k = F.col("event_id")
    on = lambda n, bad, fine: F.when(k % n == 0, bad).otherwise(fine)
    token = F.struct(on(23, F.lit(""), F.concat(F.lit("MRP Rs "), k.cast("string"))).alias("text"), F.array(F.lit(1), F.lit(2), on(19, F.lit(0), F.lit(30)), F.lit(9)).alias("bbox"), on(17, F.lit(1.5), F.lit(0.5)).alias("conf"))
    made = F.struct(
        on(31, F.lit(2), F.lit(1)).alias("schema_version"), k.cast("string").alias("scan_id"), on(29, F.array().cast("array<struct<text:string,bbox:array<int>,conf:double>>"), F.array(token)).alias("tokens"),
        F.struct(on(13, F.lit(-1.0), F.lit(0.2)).alias("mm_per_px")).alias("geometry"), on(11, F.lit("cube"), F.lit("pouch")).alias("shape_hint"), F.struct(F.when(k % 9 != 0, 12.5).alias("lat"), F.lit(77.5).alias("lon")).alias("gps"),
        on(8, F.lit("yesterday"), F.lit("2026-01-01T00:00:00.000Z")).alias("captured_utc"),
        F.array(F.struct(F.lit("PDP").alias("label"), F.lit(0.5).alias("score"), F.lit(1.0).alias("x"), F.lit(1.0).alias("y"), F.lit(5.0).alias("w"), F.lit(5.0).alias("h"))).alias("roi_boxes"),
        F.struct(on(7, F.lit(0), F.lit(100)).alias("w"), F.lit(100).alias("h")).alias("roi_frame"),
    )
    texts = D.spread(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id"), D.TASK_ROWS).select(F.to_json(made).alias("text"))
    return tables.parsed_requests(texts, "text")


@query(f"SELECT scan_id, CASE WHEN message = 'schema 1 expected' THEN 'UNSUPPORTED_VERSION' ELSE 'BAD_REQUEST' END AS code, message FROM ({REJECTED}) r WHERE message IS NOT NULL")
def request_rejects(spark, sf_dir):
    return contract.split_requests(requests(spark, sf_dir))[1].select("scan_id", "code", "message")


@query(f"SELECT scan_id FROM ({REJECTED}) r WHERE message IS NULL")
def valid_requests(spark, sf_dir):
    return contract.split_requests(requests(spark, sf_dir))[0].select("scan_id")


def scan_requests(spark, sf_dir):
    """Each label as the JSON text of a request; some are refused by their device, some break the contract."""
    from labelaudit.sources import tables

    k = F.col("scan_id")
    conf = F.when(k % 41 == 0, 1.5).otherwise(0.9)
    read = F.transform(
        F.filter(F.array(*token_rows()), lambda t: t["text"].isNotNull()),
        lambda t: F.struct(t["text"].alias("text"), F.array(t["x"], t["y"], t["w"], t["h"]).alias("bbox"), conf.alias("conf"), F.lit("mlkit").alias("engine")),
    )
    made = F.struct(
        F.lit(1).alias("schema_version"), k.cast("string").alias("scan_id"), read.alias("tokens"), F.struct((k % 37 != 0).alias("ok")).alias("quality"), F.lit("2026-01-01T00:00:00.000Z").alias("captured_utc"),
        F.when(k % 3 == 0, "pouch").alias("shape_hint"), F.struct((k % 11 == 1).alias("institutional")).alias("options"),
    )
    texts = labels(spark, sf_dir).select(F.to_json(made).alias("text"))
    return tables.parsed_requests(texts, "text")


#: Documents of scan_requests: what is found of each label, its findings in order, refusals and faulty requests.
READ = f"""(SELECT *, k7 < 5 AS f_mrp, k23 <> 0 AS has_q, paise IS NOT NULL AS f_usp, k6 < 3 AS f_date, k6 IN (0, 1, 2, 4) AS f_addr, k5 <> 2 AS f_origin, k7 IN (0, 5, 6) AS f_care, name_text IS NOT NULL AS f_name,
  k23 <> 0 AND (k11 = 1 OR kind IN ('mass', 'volume') AND (milli <= 10000 OR milli > 25000000)) AS exempt,
  scan_id % 41 = 0 AS faulty, scan_id % 37 = 0 AND scan_id % 41 <> 0 AS refused FROM {FIELDED} f)"""
STATUSES = f"""(SELECT *, [CASE WHEN has_q AND unit IN ('gms', 'ltr', 'kgs') THEN 'FAIL' ELSE 'PASS' END, CASE WHEN has_q AND unit IN ('g', 'kg', 'ml', 'L', 'pcs', 'N', 'cm', 'mg') THEN 'PASS' ELSE 'FAIL' END,
  CASE WHEN k7 IN (0, 1, 2, 4) THEN 'PASS' ELSE 'FAIL' END,
  CASE WHEN NOT (has_q AND f_mrp AND unit <> 'N') THEN 'NA' WHEN one OR (f_usp AND price_unit = req AND ABS(paise * num - cents * den) <= num) THEN 'PASS' ELSE 'FAIL' END,
  CASE WHEN f_date THEN 'PASS' ELSE 'FAIL' END, CASE WHEN k6 IN (0, 4) THEN 'PASS' ELSE 'FAIL' END, CASE WHEN k5 IN (0, 3) THEN 'PASS' WHEN k5 = 2 AND NOT f_addr THEN 'NA' ELSE 'FAIL' END,
  CASE WHEN k7 = 0 THEN 'PASS' ELSE 'FAIL' END, CASE WHEN f_name THEN 'PASS' ELSE 'FAIL' END, 'NA'] AS st,
  CASE WHEN has_q AND unit IN ('gms', 'ltr', 'kgs') THEN 1 ELSE 0 END + has_q::INT + f_mrp::INT + f_usp::INT + f_date::INT + f_addr::INT + (f_origin OR f_addr)::INT + f_care::INT + f_name::INT AS boxes,
  1 + (k13 <> 0)::INT + has_q::INT + (k7 <> 6)::INT + f_usp::INT + (k6 <> 4)::INT + (k6 <> 3)::INT + f_origin::INT + (k7 <> 3)::INT AS read_tokens,
  list_filter([CASE WHEN f_care THEN 'consumer_care' END, CASE WHEN f_addr THEN 'mfg_address' END, CASE WHEN f_date THEN 'mfg_date' END, CASE WHEN f_mrp THEN 'mrp' END, CASE WHEN has_q THEN 'net_qty' END,
    CASE WHEN f_origin THEN 'origin' END, CASE WHEN f_name THEN 'product_name' END, CASE WHEN f_usp THEN 'usp' END], lambda x: x IS NOT NULL) AS names FROM {READ} r)"""
DOCUMENTS = f"""SELECT 1 AS schema_version, CAST(scan_id AS STRING) AS scan_id, CASE WHEN faulty OR refused THEN 'RETRY' WHEN NOT exempt AND list_contains(st, 'FAIL') THEN 'VIOLATION' ELSE 'PASS' END AS verdict,
  CASE WHEN NOT faulty THEN '2026-01-01T00:00:00.000Z' END AS captured_utc, CASE WHEN NOT faulty THEN NOT refused END AS ok, CASE WHEN refused THEN 1 ELSE 0 END AS n_prompts,
  CASE WHEN NOT faulty AND scan_id % 3 = 0 THEN 'pouch' END AS shape, CASE WHEN faulty OR refused THEN 0 ELSE read_tokens END AS n_tokens, CASE WHEN faulty OR refused THEN '' ELSE array_to_string(names, ',') END AS fields,
  CASE WHEN NOT faulty AND NOT refused AND f_mrp THEN (cents // 100)::VARCHAR || CASE WHEN cents % 100 = 0 THEN '' WHEN cents % 10 = 0 THEN '.' || (cents % 100 // 10)::VARCHAR ELSE '.' || lpad((cents % 100)::VARCHAR, 2, '0') END END AS mrp,
  CASE WHEN faulty OR refused THEN '' WHEN exempt THEN '26' ELSE '13,6(1)(c),6(1)(e),6(11),6(1)(d),6(1)(a),6(1)(aa),6(1)(n),6(1)(b),7' END AS rules,
  CASE WHEN faulty OR refused THEN '' WHEN exempt THEN 'NA' ELSE array_to_string(st, ',') END AS statuses, CAST(CASE WHEN faulty OR refused OR exempt THEN 0 ELSE len(list_filter(st, lambda x: x = 'FAIL')) END AS INT) AS fails,
  CASE WHEN faulty OR refused OR exempt THEN 0 ELSE boxes END AS n_boxes, CASE WHEN NOT faulty AND NOT refused AND has_q THEN exempt END AS exempt, CASE WHEN faulty THEN 'BAD_REQUEST' END AS code FROM {STATUSES} s"""


@query(DOCUMENTS)
def request_results(spark, sf_dir):
    d = scans.scan_results(D.arrived(scan_requests(spark, sf_dir)))
    joined = lambda c: F.array_join(F.transform("checks", lambda x: x[c]), ",")
    return d.select(
        "schema_version", "scan_id", "verdict", F.when(F.col("error").isNull(), F.col("captured_utc")).alias("captured_utc"), "quality.ok", F.size("quality.prompts").alias("n_prompts"), F.col("geometry.shape").alias("shape"), F.size("ocr.tokens").alias("n_tokens"),
        F.array_join(F.array_sort(F.map_keys("fields")), ",").alias("fields"), F.col("fields")["mrp"]["value"].alias("mrp"), joined("rule").alias("rules"), joined("status").alias("statuses"), F.col("summary.fail").alias("fails"),
        F.size(F.filter("checks", lambda x: x["evidence_bbox"].isNotNull())).alias("n_boxes"), F.col("exemption.exempt").alias("exempt"), F.col("error.code").alias("code"),
    )


# ---- laws on raw JSON ------------------------------------------------------------------------------------------------
def planted(text: str) -> str:
    """SQL of events as JSON texts, written with < and > for braces; those of every 37th event are cut off."""
    return f"(SELECT event_id, CASE WHEN event_id % 37 = 0 THEN substr(text, 1, 30) ELSE text END AS text FROM (SELECT event_id, translate({text}, '<>', chr(123) || chr(125)) AS text FROM {{events}}) t)"


REQUEST_TEXTS = planted("""'<"schema_version":' || CASE WHEN event_id % 31 = 0 THEN '2' ELSE '1' END || ',"scan_id":"' || CAST(event_id AS STRING) || '","tokens":['
|| CASE WHEN event_id % 29 = 0 THEN '' ELSE '<"text":"MRP Rs 5","bbox":[1,2,30,9]>,<"text":' || CASE WHEN event_id % 23 = 0 THEN '5' ELSE '"x"' END || ',"bbox":[1,20,' || CASE WHEN event_id % 19 = 0 THEN '30.0' ELSE '30' END || ',9],"conf":1>' END
|| '],"quality":<"ok":' || CASE WHEN event_id % 17 = 0 THEN '"yes"' ELSE 'true' END || '>,"geometry":<"mm_per_px":' || CASE WHEN event_id % 13 = 0 THEN '"0.2"' WHEN event_id % 3 = 0 THEN 'null' ELSE '0.2' END
|| '>,"gps":<' || CASE WHEN event_id % 11 = 0 THEN '' ELSE '"lat":12.5,' END || '"lon":77>,"options":<"institutional":' || CASE WHEN event_id % 7 = 0 THEN '"false"' WHEN event_id % 2 = 0 THEN 'null' ELSE 'false' END || ',"package_height_cm":"12.5">>'""")
RESULT_TEXTS = planted("""'<"schema_version":1,"scan_id":"' || CAST(event_id AS STRING) || '","verdict":"' || CASE WHEN event_id % 7 = 0 THEN 'RETRY' ELSE 'VIOLATION' END || '","captured_utc":"2026-01-01T00:00:00.000Z","completed_utc":"2026-01-01T00:00:00.250Z","total_ms":'
|| CASE WHEN event_id % 5 = 0 THEN '-1' ELSE '12.5' END || ',"timings_ms":<"' || CASE WHEN event_id % 17 = 0 THEN 's9_magic' ELSE 's4_ocr' END || '":1.5>,"quality":<"ok":null,"laplacian_var":null,"glare_pct":null,"prompts":[],"glare_bbox":null>,"geometry":null,'
|| '"ocr":<"engines_used":["mlkit"],"tokens":[<"text":"MRP","bbox":[1,2,3,4],"conf":1,"engine":"mlkit"' || CASE WHEN event_id % 11 = 0 THEN '' ELSE ',"lang":"en"' END || '>]>,"fields":<"mrp":<"raw":"MRP 14","value":' || CASE WHEN event_id % 19 = 0 THEN '14.0' ELSE '"14.00"' END
|| ',"unit":null,"bbox":null,"conf":0.9>>,"checks":[<"rule":"13","status":"' || CASE WHEN event_id % 13 = 0 THEN 'MAYBE' ELSE 'FAIL' END || '","message":"m","plain":"","citation":"c","evidence_bbox":null>],"exemption":null,"summary":<"total":1,"pass":0,"fail":'
|| CASE WHEN event_id % 23 = 0 THEN '99' ELSE '1' END || ',"na":0>,' || CASE WHEN event_id % 31 = 0 THEN '' ELSE '"dossier":null,' END || CASE WHEN event_id % 29 = 0 THEN '"extra":1,' ELSE '' END || '"meta":null,"error":null>'""")


@query(f"""SELECT scan_id, CASE WHEN path = 'schema_version' THEN 'UNSUPPORTED_VERSION' ELSE 'BAD_REQUEST' END AS code, path, CASE path WHEN '' THEN '{shapes.NO_JSON}' WHEN 'schema_version' THEN 'schema 1 expected' WHEN 'tokens' THEN 'must be a non-empty list'
  WHEN 'tokens[1].text' THEN 'must be a non-empty string' WHEN 'tokens[1].bbox' THEN '{shapes.BOX}' WHEN 'quality.ok' THEN 'must be true, false or null' WHEN 'geometry.mm_per_px' THEN 'must be a positive number or null' WHEN 'gps.lat' THEN 'must be a number' ELSE 'must be true or false' END AS message
FROM (SELECT CASE WHEN json_valid(text) THEN text ->> '$.scan_id' END AS scan_id, CASE WHEN NOT json_valid(text) THEN '' WHEN text ->> '$.schema_version' <> '1' THEN 'schema_version' WHEN json_array_length(text, '$.tokens') = 0 THEN 'tokens' WHEN json_type(text, '$.tokens[1].text') <> 'VARCHAR' THEN 'tokens[1].text'
  WHEN json_type(text, '$.tokens[1].bbox[2]') NOT IN ('BIGINT', 'UBIGINT') THEN 'tokens[1].bbox' WHEN json_type(text, '$.quality.ok') NOT IN ('BOOLEAN', 'NULL') THEN 'quality.ok' WHEN json_type(text, '$.geometry.mm_per_px') NOT IN ('DOUBLE', 'UBIGINT', 'NULL') THEN 'geometry.mm_per_px'
  WHEN json_type(text, '$.gps.lat') IS NULL THEN 'gps.lat' WHEN json_type(text, '$.options.institutional') NOT IN ('BOOLEAN', 'NULL') THEN 'options.institutional' END AS path FROM {REQUEST_TEXTS} x) y WHERE path IS NOT NULL""")
def request_faults(spark, sf_dir):
    return shapes.split_texts(D.table(spark, sf_dir, f"SELECT text AS value FROM {REQUEST_TEXTS} x", even=True))[1].select("scan_id", "code", "path", "message")


@query(f"""WITH texts AS (SELECT * FROM {RESULT_TEXTS} x), sound AS (SELECT * FROM texts WHERE json_valid(text))
SELECT event_id, '' AS path, '{shapes.NO_JSON}' AS message FROM texts WHERE NOT json_valid(text)
UNION ALL SELECT event_id, unnest(list_filter([CASE WHEN json_exists(text, '$.dossier') THEN NULL ELSE 'dossier' END, CASE WHEN json_exists(text, '$.ocr.tokens[0].lang') THEN NULL ELSE 'ocr.tokens[0].lang' END], lambda x: x IS NOT NULL)), 'missing key' FROM sound
UNION ALL SELECT event_id, 'extra', 'unknown key' FROM sound WHERE list_contains(json_keys(text), 'extra')
UNION ALL SELECT event_id, 'total_ms', 'must be a finite number from 0' FROM sound WHERE (text ->> '$.total_ms')::DOUBLE < 0
UNION ALL SELECT event_id, 'timings_ms.' || json_keys(text, '$.timings_ms')[1], 'not a stage with a time' FROM sound WHERE json_keys(text, '$.timings_ms')[1] <> 's4_ocr'
UNION ALL SELECT event_id, 'fields.mrp.value', 'must be a string (amounts are text) or null' FROM sound WHERE json_type(text, '$.fields.mrp.value') NOT IN ('VARCHAR', 'NULL')
UNION ALL SELECT event_id, 'checks[0].status', 'must be PASS, FAIL or NA' FROM sound WHERE text ->> '$.checks[0].status' NOT IN ('PASS', 'FAIL', 'NA')
UNION ALL SELECT event_id, 'summary.fail', 'fail differs from checks' FROM sound WHERE (text ->> '$.summary.fail')::INT <> CASE WHEN text ->> '$.checks[0].status' = 'FAIL' THEN 1 ELSE 0 END
UNION ALL SELECT event_id, 'quality.prompts', 'RETRY without error needs a prompt' FROM sound WHERE text ->> '$.verdict' = 'RETRY' AND json_type(text, '$.error') = 'NULL' AND json_array_length(text, '$.quality.prompts') = 0""")
def result_faults(spark, sf_dir):
    texts = D.table(spark, sf_dir, f"SELECT event_id, text AS value FROM {RESULT_TEXTS} x", even=True)
    return shapes.result_faults(texts, key="event_id").select(F.col("key").alias("event_id"), "path", "message")
