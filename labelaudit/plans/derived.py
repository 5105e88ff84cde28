"""Audit tables out of the given tables, as SQL that Spark and DuckDB both run.

Every row of the given table gives a row here; texts, faults and responses follow from keys by arithmetic.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

RUPEES = "CAST(CAST(({p} - {p} % 100) / 100 AS BIGINT) AS STRING) || '.' || lpad(CAST({p} % 100 AS STRING), 2, '0')"

#: Quantities, prices and which fault each part's label has.
LABEL_BASE = """
SELECT *, CASE WHEN kind = 'count' THEN q WHEN kind = 'length' THEN q ELSE milli END AS num,
  CASE WHEN kind IN ('count') THEN 1 WHEN kind = 'length' THEN CASE WHEN q < 100 THEN 1 ELSE 100 END WHEN milli < 1000000 THEN 1000 ELSE 1000000 END AS den,
  CASE WHEN kind = 'count' THEN q = 1 WHEN kind = 'length' THEN q = 100 ELSE milli = 1000000 END AS one,
  CASE WHEN kind = 'count' THEN 'piece' WHEN kind = 'length' THEN CASE WHEN q < 100 THEN 'cm' ELSE 'm' END
       WHEN kind = 'mass' THEN CASE WHEN milli < 1000000 THEN 'g' ELSE 'kg' END ELSE CASE WHEN milli < 1000000 THEN 'ml' ELSE 'L' END END AS req
FROM (
  SELECT *, q * CASE unit WHEN 'mg' THEN 1 WHEN 'g' THEN 1000 WHEN 'gm' THEN 1000 WHEN 'gms' THEN 1000 WHEN 'ml' THEN 1000 ELSE 1000000 END AS milli,
    CASE WHEN unit IN ('mg', 'g', 'gm', 'gms', 'kg', 'kgs') THEN 'mass' WHEN unit IN ('ml', 'L', 'ltr') THEN 'volume' WHEN unit = 'cm' THEN 'length' ELSE 'count' END AS kind
  FROM (
    SELECT CAST(p_partkey AS BIGINT) AS scan_id, p_name AS product_name,
      CAST(p_size AS BIGINT) * CASE CAST(p_partkey % 12 AS INT) WHEN 0 THEN 10 WHEN 2 THEN 10 WHEN 4 THEN 10 WHEN 9 THEN 10 WHEN 10 THEN 1000 WHEN 8 THEN 5 ELSE 1 END AS q,
      CASE CAST(p_partkey % 12 AS INT) WHEN 0 THEN 'g' WHEN 1 THEN 'kg' WHEN 2 THEN 'ml' WHEN 3 THEN 'L' WHEN 4 THEN 'gms' WHEN 5 THEN 'ltr' WHEN 6 THEN 'pcs' WHEN 7 THEN 'N' WHEN 8 THEN 'cm' WHEN 9 THEN 'gm' WHEN 10 THEN 'mg' ELSE 'kgs' END AS unit,
      CAST(ROUND(p_retailprice * 100) AS BIGINT) AS cents, CAST(p_size % 12 + 1 AS BIGINT) AS mon, CAST(p_partkey % 23 AS BIGINT) AS k23, CAST(p_partkey % 7 AS BIGINT) AS k7,
      CAST(p_partkey % 5 AS BIGINT) AS k5, CAST(p_partkey % 11 AS BIGINT) AS k11, CAST(p_partkey % 6 AS BIGINT) AS k6, CAST(p_partkey % 13 AS BIGINT) AS k13,
      CAST(100000 + (p_partkey * 7919) % 800000 AS BIGINT) AS pin
    FROM {part}
  ) keyed
) sized
"""

#: The declared unit price in paise: right, or five too many.
LABEL_PRICED = f"""
SELECT *, CASE WHEN k5 = 4 THEN NULL ELSE CAST(FLOOR((2 * cents * den + num) / (2.0 * num)) AS BIGINT) + CASE WHEN k5 = 3 THEN 5 ELSE 0 END END AS paise,
  CASE WHEN k11 = 0 THEN 'oz' ELSE req END AS price_unit
FROM ({LABEL_BASE}) base
"""

LABELS = f"""
SELECT scan_id, CASE WHEN k13 = 0 THEN NULL ELSE product_name END AS product_name,
  CASE WHEN k23 = 0 THEN NULL ELSE 'Net Quantity: ' || CAST(q AS STRING) || ' ' || unit END AS net_qty,
  CASE CAST(k7 AS INT) WHEN 0 THEN 'MRP Rs ' || rupees || ' (incl. of all taxes)' WHEN 1 THEN 'MRP ₹ ' || rupees || ' inclusive of all taxes'
    WHEN 2 THEN 'Maximum Retail Price Rs. ' || rupees || ' incl of all taxes' WHEN 3 THEN 'MRP Rs ' || rupees WHEN 4 THEN 'MRP 9 ' || rupees || ' incl. of all taxes'
    WHEN 5 THEN 'Price Rs ' || rupees || ' incl. of all taxes' ELSE NULL END AS mrp,
  CASE WHEN paise IS NULL THEN NULL ELSE 'Unit Sale Price Rs ' || {RUPEES.format(p="paise")} || ' / ' || price_unit END AS usp,
  CASE CAST(k6 AS INT) WHEN 0 THEN 'MFG ' || lpad(CAST(mon AS STRING), 2, '0') || '/2026' WHEN 1 THEN 'Pkd 15/' || lpad(CAST(mon AS STRING), 2, '0') || '/2025'
    WHEN 2 THEN 'Mfg AUG 2026' WHEN 3 THEN 'Best 2026/08' WHEN 4 THEN NULL ELSE 'MFG 13/13/2026' END AS mfg_date,
  CASE CAST(k6 AS INT) WHEN 0 THEN 'Mfd. by: Tasty Foods Ltd., Plot 21, Goa ' || CAST(pin AS STRING) WHEN 1 THEN 'Packed by: Box Co, Delhi ' || CAST(pin AS STRING)
    WHEN 2 THEN 'Manufactured by: Plain Foods, Call 1800-123-4567' WHEN 3 THEN NULL WHEN 4 THEN 'Imported by: Global Foods, Mumbai ' || CAST(pin AS STRING) ELSE 'Mfg. Corner House, PIN: ' || CAST(pin AS STRING) END AS mfg_address,
  CASE CAST(k5 AS INT) WHEN 0 THEN 'Made in India' WHEN 1 THEN 'Made in PRC' WHEN 2 THEN NULL WHEN 3 THEN 'Country of Origin: China' ELSE 'Product of Mars' END AS origin,
  CASE CAST(k7 AS INT) WHEN 0 THEN 'Consumer Care: Tasty Foods, Mumbai 400050, Tel: 1800-123-4567, care@tasty.in' WHEN 1 THEN 'Call 9876543210 or care(at)tasty.in, address as above'
    WHEN 2 THEN 'Write to care@tasty.in' WHEN 3 THEN NULL WHEN 4 THEN 'Tel 079-26856029, mail help@box.co.in' ELSE 'Helpline 1800 123 4567, Pune 411 001' END AS consumer_care,
  k11 = 1 AS institutional, CAST(NULL AS BOOLEAN) AS fast_food
FROM (SELECT *, {RUPEES.format(p="cents")} AS rupees FROM ({LABEL_PRICED}) priced) labelled
"""

#: What each rule must say, from the numbers and fault keys instead of the texts.
STATUS = """
SELECT *,
  CASE WHEN has_q AND (inst OR small OR bulk) THEN TRUE ELSE FALSE END AS exempt,
  CASE WHEN has_q AND unit IN ('gms', 'ltr', 'kgs') THEN 'FAIL' ELSE 'PASS' END AS s_13,
  CASE WHEN has_q AND unit IN ('g', 'kg', 'ml', 'L', 'pcs', 'N', 'cm', 'mg') THEN 'PASS' ELSE 'FAIL' END AS s_c,
  CASE WHEN k7 IN (0, 1, 2, 4) THEN 'PASS' ELSE 'FAIL' END AS s_e,
  CASE WHEN NOT has_q OR k7 IN (4, 6) OR unit = 'N' THEN 'NA' WHEN one THEN 'PASS' WHEN paise IS NULL THEN 'FAIL'
       WHEN price_unit = req AND ABS(paise * num - cents * den) <= num THEN 'PASS' ELSE 'FAIL' END AS s_11,
  CASE WHEN k6 IN (0, 1, 2) THEN 'PASS' ELSE 'FAIL' END AS s_d,
  CASE WHEN k6 IN (0, 4, 5) THEN 'PASS' ELSE 'FAIL' END AS s_a,
  CASE WHEN k5 IN (0, 3) THEN 'PASS' WHEN k5 IN (1, 4) THEN 'FAIL' WHEN k6 = 3 THEN 'NA' ELSE 'FAIL' END AS s_aa,
  CASE WHEN k7 IN (0, 1) THEN 'PASS' WHEN k7 = 4 AND k6 IN (0, 1, 4, 5) THEN 'PASS' ELSE 'FAIL' END AS s_n,
  CASE WHEN k13 <> 0 THEN 'PASS' ELSE 'FAIL' END AS s_b
FROM (
  SELECT *, k23 <> 0 AS has_q, k11 = 1 AS inst, kind IN ('mass', 'volume') AND milli <= 10000 AS small, kind IN ('mass', 'volume') AND milli > 25000000 AS bulk
  FROM (""" + LABEL_PRICED + """) priced
) gated
"""

RULE_COLUMNS = {"13": "s_13", "6(1)(c)": "s_c", "6(1)(e)": "s_e", "6(11)": "s_11", "6(1)(d)": "s_d", "6(1)(a)": "s_a", "6(1)(aa)": "s_aa", "6(1)(n)": "s_n", "6(1)(b)": "s_b"}

#: One row per finding, in statutory order; rule 7 has no area here and is NA.
CHECKS = (
    "SELECT scan_id, CAST(0 AS INT) AS ord, '26' AS rule, 'NA' AS status FROM (" + STATUS + ") s WHERE exempt"
    + "".join(f" UNION ALL SELECT scan_id, CAST({k} AS INT), '{rule}', {c} FROM ({STATUS}) s WHERE NOT exempt" for k, (rule, c) in enumerate(RULE_COLUMNS.items()))
    + f" UNION ALL SELECT scan_id, CAST(9 AS INT), '7', 'NA' FROM ({STATUS}) s WHERE NOT exempt"
)

#: Events as recorded scans of a gateway.
GATEWAY = """
SELECT CAST(event_id AS BIGINT) AS scan_id, ts AS received, ts AS created, CAST(user_id AS BIGINT) AS device,
  CASE event_type WHEN 'view' THEN 'PASS' WHEN 'signup' THEN 'PASS' WHEN 'error' THEN 'RETRY' ELSE 'VIOLATION' END AS verdict,
  CASE WHEN event_id % 3 = 0 THEN 'signed' ELSE 'pending' END AS sig_status,
  CASE WHEN event_id % 4 = 0 THEN CAST(8 + (event_id % 2900) / 100.0 AS DOUBLE) ELSE NULL END AS lat,
  CASE WHEN event_id % 4 = 0 THEN CAST(68 + (event_id % 2700) / 100.0 AS DOUBLE) ELSE NULL END AS lon,
  CAST(event_id % 7 AS BIGINT) AS fail_count,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'd' || CAST(event_id AS STRING) END AS dossier_sha256,
  CASE event_type WHEN 'purchase' THEN 'synced' WHEN 'error' THEN 'failed' ELSE 'pending' END AS sync_status,
  CAST(event_id % 3 AS INT) AS attempts
FROM {events}
"""

RESPONSES = """
SELECT CAST(event_id AS BIGINT) AS scan_id,
  CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 29 = 0 THEN 503 WHEN event_id % 6 = 0 THEN 422 WHEN event_id % 7 = 0 THEN 400 ELSE 200 END AS http_status,
  event_id % 31 <> 0 AS accepted
FROM {events}
"""

ENVELOPES = """
SELECT CAST(event_id AS BIGINT) AS event_id, CASE WHEN event_id % 41 = 0 THEN '' ELSE 's' || CAST(CAST((event_id - event_id % 3) / 3 AS BIGINT) AS STRING) END AS scan_id,
  CASE WHEN event_id % 43 = 0 THEN 'other' ELSE 'scan.v1' END AS kind,
  CASE WHEN event_id % 37 = 0 THEN NULL WHEN event_type = 'error' THEN 'RETRY' WHEN event_type = 'view' THEN 'PASS' ELSE 'VIOLATION' END AS verdict,
  event_id % 47 <> 0 AS has_result, CASE WHEN event_id % 53 = 0 THEN 'total differs' ELSE CAST(NULL AS STRING) END AS contract_error,
  CASE WHEN event_id % 2 = 0 THEN 'sig' ELSE NULL END AS signature, CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'd' END AS dossier_sha256,
  'f' || CAST(user_id % 10 AS STRING) AS cert_fingerprint, ts AS received
FROM {events}
"""


def table(spark: SparkSession, sf_dir: str, sql: str, even: bool = False) -> DataFrame:
    """The derived table over parquet files of sf_dir; even: their rows are dealt evenly before the SQL (see spread)."""
    names = [n for n in ("part", "events", "supplier", "nation", "lineitem", "orders", "customer", "documents", "labels", "pages", "embeddings", "benchmark") if "{" + n + "}" in sql]
    read = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    return spark.sql(sql, **{n: spread(read(n), TASK_ROWS) if even else read(n) for n in names})


def oracle(sql: str) -> str:
    """The same SQL with the given tables by their names."""
    for n in ("part", "events", "supplier", "nation", "lineitem", "orders", "customer", "documents", "labels", "pages", "embeddings", "benchmark"):
        sql = sql.replace("{" + n + "}", n)
    return sql


#: Rows of a task where the work on each row is long: a task's time stays the same as tables grow.
TASK_ROWS = 20_000


def spread(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df over all cores if its files give fewer partitions than that; rows: dealt evenly in tasks of about so many.

    The latter is for long work on short rows: files of few row groups would leave it to a few tasks, whatever the number
    of their partitions. Without rows, tables of many files are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if rows:
        return df.repartition(max(cores, -(-df.count() // rows)))
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def arrived(df: DataFrame) -> DataFrame:
    """The same rows as written in the folder of checkpoints, as if they had been received; plans begin anew from there."""
    spark = df.sparkSession
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path and sc.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path or "file://" + tempfile.mkdtemp(prefix="audit-"))
    return df.checkpoint()
