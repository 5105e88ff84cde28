"""State over micro-batches: the bucketed store and its commits, deliveries, live counts."""

import json

import pytest
from pyspark.sql import functions as F

from labelaudit.operators import rules
from labelaudit.sources import store
from labelaudit.streaming import jobs


def table(spark, pairs):
    return spark.createDataFrame(pairs, "scan_id string, received int, what string")


def held(spark, path):
    rows = store.read_store(spark, path)
    return sorted((r["scan_id"], r["what"]) for r in rows.collect()) if rows is not None else []


def test_first_row_of_a_key_wins_for_ever(spark, tmp_path):
    path = str(tmp_path / "store")
    assert store.append_first(table(spark, [("a", 2, "late"), ("a", 1, "early"), ("b", 1, "b"), (None, 1, "n"), (None, 2, "n2")]), path, 0)
    assert store.append_first(table(spark, [("a", 0, "earlier, but in a later batch"), ("c", 1, "c"), ("c", 1, "c")]), path, 1)
    rows = {(r["scan_id"], r["what"]) for r in store.read_store(spark, path).collect()}
    assert rows == {("a", "early"), ("b", "b"), ("c", "c"), (None, "n")}


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = table(spark, [("a", 1, "x"), ("b", 1, "y")])
    assert store.append_first(rows, path, 7)
    assert not store.append_first(table(spark, [("z", 1, "other")]), path, 7)
    assert held(spark, path) == [("a", "x"), ("b", "y")]


def test_a_crash_before_the_commit_leaves_nothing_to_see(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    store.append_first(table(spark, [("a", 1, "x")]), path, 0)

    def crash(*_):
        raise OSError("gone")

    with monkeypatch.context() as m:
        m.setattr(store, "commit", crash)
        with pytest.raises(OSError, match="gone"):
            store.append_first(table(spark, [("b", 1, "half"), ("c", 1, "half")]), path, 1)
    assert held(spark, path) == [("a", "x")]  # its files lie there, its commit doesn't
    store.append_first(table(spark, [("b", 1, "whole"), ("a", 0, "again")]), path, 1)
    assert held(spark, path) == [("a", "x"), ("b", "whole")]


def test_only_touched_buckets_are_read(spark, tmp_path):
    path = str(tmp_path / "store")
    store.append_first(table(spark, [(f"s{k}", k, "x") for k in range(500)]), path, 0)
    some = store.read_store(spark, path, [3, 5])
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket#" in plan.split("PartitionFilters")[1]
    wanted = spark.range(500).select(F.concat(F.lit("s"), "id").alias("scan_id")).where(store.bucket_of("scan_id", store.BUCKETS).isin(3, 5))
    assert {r["scan_id"] for r in some.collect()} == {r["scan_id"] for r in wanted.collect()}
    assert store.append_first(table(spark, []), path, 1) and len(held(spark, path)) == 500


def deliver(spark, tmp_path):
    rows = spark.readStream.schema("scan_id string, device string, created int, attempts int").json(str(tmp_path / "rows"))
    answers = spark.readStream.schema("scan_id string, device string, http_status int, accepted boolean").json(str(tmp_path / "answers"))
    jobs.delivery_stream(rows, answers, str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    done = spark.read.option("basePath", str(tmp_path / "out")).parquet(str(tmp_path / "out" / "batch=*"))
    return sorted((r["batch"], r["scan_id"], r["outcome"], r["attempts"]) for r in done.collect())


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows))


def test_attempts_add_up_over_batches_and_restarts(spark, tmp_path):
    row = lambda s, created, device="d": {"scan_id": s, "device": device, "created": created, "attempts": 0}
    answer = lambda s, code, ok=True, device="d": {"scan_id": s, "device": device, "http_status": code, "accepted": ok}
    put(tmp_path / "rows", "a.json", [row("s1", 1), row("s2", 2), row("s3", 3), row("t1", 1, "e")])
    put(tmp_path / "answers", "a.json", [answer("s2", 503), answer("s1", 200), answer("s3", 200), answer("t1", 422, False, "e"), answer("lost", 200)])
    first = deliver(spark, tmp_path)
    assert first == [(0, "lost", "unknown", 0), (0, "s1", "synced", 1), (0, "s2", "deferred", 1), (0, "s3", "untouched", 0), (0, "t1", "failed", 1)]
    put(tmp_path / "answers", "b.json", [answer("s2", None), answer("s1", 200), answer("s3", 200)])
    second = [r for r in deliver(spark, tmp_path) if r not in first]
    assert [r[1:] for r in second] == [("s1", "untouched", 1), ("s2", "deferred", 2), ("s3", "untouched", 0)]
    put(tmp_path / "answers", "c.json", [answer("s2", 200), answer("s3", 200)])
    third = [r for r in deliver(spark, tmp_path) if r not in first and r not in second]
    assert [r[1:] for r in third] == [("s2", "synced", 3), ("s3", "synced", 1)]


def test_live_top_rules_count_violations_once(spark, tmp_path):
    kind = "scan_id string, verdict string, checks array<struct<rule:string,status:string>>"
    check = lambda *rules: [{"rule": r, "status": s} for r, s in rules]
    put(tmp_path / "in", "a.json", [{"scan_id": "a", "verdict": "VIOLATION", "checks": check(("13", "FAIL"), ("7", "PASS"))}, {"scan_id": "b", "verdict": "RETRY", "checks": check(("13", "FAIL"))}])
    run = lambda: jobs.top_rules_stream(spark.readStream.schema(kind).json(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    run()
    put(tmp_path / "in", "b.json", [{"scan_id": "c", "verdict": "VIOLATION", "checks": check(("13", "FAIL"), ("7", "FAIL"))}])
    run()
    (tmp_path / "log" / "commits" / "1").unlink()  # the last batch runs again
    for crc in (tmp_path / "log" / "commits").glob(".1.crc"):
        crc.unlink()
    run()
    live = [tuple(r) for r in jobs.live_top_rules(spark, str(tmp_path / "out")).collect()]
    docs = spark.read.schema(kind).json(str(tmp_path / "in"))
    checks = docs.select("scan_id", F.explode("checks").alias("c")).select("scan_id", "c.*")
    assert live == [tuple(r) for r in rules.top_rules(checks, scans=docs.select("scan_id", "verdict")).collect()] == [("13", 2), ("7", 1)]
