"""Long work on short rows: dealt evenly, and done once a row."""

from labelaudit.operators import contract
from labelaudit.plans import derived, queries

SF = "/root/testdata/sf0.001"


def test_tasks_do_not_grow_with_the_table(spark):
    rows = spark.range(0, 6 * derived.TASK_ROWS + 1, 1, 4)
    sizes = derived.spread(rows, derived.TASK_ROWS).rdd.glom().map(len).collect()
    assert len(sizes) == 7 and max(sizes) <= 1.1 * derived.TASK_ROWS and sum(sizes) == rows.count()


def test_a_request_is_read_and_judged_once(spark):
    for part in contract.split_requests(queries.requests(spark, SF)):
        plan = part.select("scan_id")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json") == 1
        assert all("CASE" not in line and "exists" not in line for line in plan.split("\n") if "Filter" in line)


def test_findings_are_worked_out_once(spark):
    plan = queries.validate_results(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate posexplode" not in plan
