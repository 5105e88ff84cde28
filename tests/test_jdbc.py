"""The gateway's rows in a SQL store: embedded Derby, which comes with Spark."""

import pytest

from labelaudit.sources import tables

DRIVER = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    url = f"jdbc:derby:{tmp_path_factory.mktemp('derby')}/gateway;create=true"
    rows = spark.range(1, 1001).selectExpr("id AS scan_id", "CASE WHEN id % 10 = 0 THEN 'VIOLATION' ELSE 'PASS' END AS verdict", "CAST(id % 7 AS INT) AS attempts", "IF(id % 100 = 0, NULL, id) AS rank_no")
    write = lambda df, name: df.coalesce(1).write.format("jdbc").options(url=url, driver=DRIVER, dbtable=name, createTableColumnTypes='verdict VARCHAR(20)').save()
    write(rows, "SCANS")
    write(rows.limit(0), "NOTHING")
    tables.gateway_catalog(spark, "gateway", url, driver=DRIVER)
    return "gateway.APP"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_reads_in_ranges(spark, store):
    found = tables.read_gateway_jdbc(spark, f"{store}.SCANS", "SCAN_ID", 8)
    assert found.rdd.getNumPartitions() == 8
    sizes = [len(x) for x in found.select("scan_id").rdd.glom().collect()]
    assert sum(sizes) == 1000 and max(sizes) <= 130
    assert sorted(x["scan_id"] for x in found.select("scan_id").collect()) == list(range(1, 1001))


def test_rows_without_a_key_are_read(spark, store):
    assert tables.read_gateway_jdbc(spark, f"{store}.SCANS", "RANK_NO", 4).count() == 1000


def test_no_rows_and_no_key(spark, store):
    assert tables.read_gateway_jdbc(spark, f"{store}.NOTHING", "SCAN_ID").count() == 0
    assert tables.read_gateway_jdbc(spark, f"{store}.SCANS").count() == 1000


def test_the_store_filters_and_counts(spark, store):
    scans = tables.read_gateway_jdbc(spark, f"{store}.SCANS")
    wanted = scans.where("verdict = 'VIOLATION'")
    assert wanted.count() == 100 and "PushedFilters: [verdict IS NOT NULL, verdict = 'VIOLATION']" in plan(wanted)
    assert scans.limit(5).count() == 5  # Spark's dialect of Derby has no LIMIT, so this one stays with Spark
    per = scans.groupBy("verdict").count()
    assert {tuple(x) for x in per.collect()} == {("PASS", 900), ("VIOLATION", 100)} and "PushedAggregates: [COUNT(*)]" in plan(per)
