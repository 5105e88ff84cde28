"""Structured Streaming jobs: audits of arriving scans, idempotent ingest, live statistics.

A scan arrives whole in one message, so audits need no state. Ingest is idempotent for ever, so what is known lives in
the written table and not in state that a watermark would drop. Deliveries keep each device's queue as state.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from labelaudit.plans import derived, scans
from labelaudit.sources import store


def result_stream(requests: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Whole results of each micro-batch of requests as JSON lines, below out in a folder of its own: a batch that runs again replaces it."""

    def each(batch: DataFrame, number: int) -> None:
        scans.scan_results(derived.arrived(batch)).write.mode("overwrite").json(f"{out}/batch={number}")

    return requests.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_stream(rows: DataFrame, path: str, checkpoint: str, key: str = "scan_id", order: str = "received") -> StreamingQuery:
    """First row of each key, ever, into a bucketed store (sources.store): a batch reads only the buckets that it touches."""

    def each(batch: DataFrame, number: int) -> None:
        store.append_first(batch, path, number, key, order)

    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Deliveries(StatefulProcessor):
    """Each device's queue: a map from scan to its place, attempts and status, an entry of state each.

    Of the responses of one batch those of pending rows count, in the order of the queue; after the first deferral the
    rest of the batch is untouched. Attempts add up over batches.
    """

    def init(self, handle) -> None:
        self.rows = handle.getMapState("rows", "scan_id string", "created string, attempts int, status string")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        answers = []
        for frame in rows:
            for r in frame.to_dict("records"):
                if r["kind"] == "row":
                    if not self.rows.containsKey((r["scan_id"],)):
                        self.rows.updateValue((r["scan_id"],), (r["created"], int(r["attempts"]), "pending"))
                else:
                    answers.append(r)
        queue = []
        for r in answers:
            held = self.rows.getValue((r["scan_id"],)) if self.rows.containsKey((r["scan_id"],)) else None
            queue.append(((held[0] or "") if held else "", r["scan_id"], held, r))
        out, stopped = [], False
        for _, scan, held, r in sorted(queue, key=lambda q: q[:2]):
            if held is None:
                out.append((key[0], scan, "unknown", 0))
                continue
            created, attempts, status = held
            outcome = "untouched"
            if status == "pending" and not stopped:
                code = r["http_status"]
                known = code is not None and code == code
                outcome = "synced" if known and 200 <= code < 300 and r["accepted"] is True else "failed" if known and code in (400, 422) else "deferred"
                stopped, attempts = outcome == "deferred", attempts + 1
                self.rows.updateValue((scan,), (created, attempts, "pending" if outcome == "deferred" else outcome))
            out.append((key[0], scan, outcome, attempts))
        yield pd.DataFrame(out, columns=["device", "scan_id", "outcome", "attempts"]).astype({"attempts": "int32"})

    def close(self) -> None:
        pass


def deliveries(ledger: DataFrame, responses: DataFrame) -> DataFrame:
    """device, scan_id, outcome and attempts for each response, as a stream with state by device.

    ledger: a stream of rows to send (scan_id, device, created, attempts); responses: a stream of scan_id, device,
    http_status (null: unreachable) and accepted. State lives in RocksDB, so queues may be longer than memory holds.
    """
    none = lambda kind: F.lit(None).cast(kind)
    rows = ledger.select("device", F.lit("row").alias("kind"), "scan_id", F.col("created").cast("string").alias("created"), F.coalesce(F.col("attempts").cast("int"), F.lit(0)).alias("attempts"), none("int").alias("http_status"), none("boolean").alias("accepted"))
    answers = responses.select("device", F.lit("answer").alias("kind"), "scan_id", none("string").alias("created"), F.lit(0).alias("attempts"), F.col("http_status").cast("int").alias("http_status"), "accepted")
    ledger.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return rows.unionByName(answers).groupBy("device").transformWithStateInPandas(Deliveries(), "device string, scan_id string, outcome string, attempts int", "Update", "None")


def delivery_stream(ledger: DataFrame, responses: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Outcomes of deliveries, below out in a folder a batch: a batch that runs again replaces it."""

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return deliveries(ledger, responses).writeStream.foreachBatch(each).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live_stats(scans: DataFrame) -> DataFrame:
    """verdict, scans, signed: a streaming aggregate for complete mode."""
    return scans.groupBy("verdict").agg(F.count("*").alias("scans"), F.count_if(F.col("sig_status") == "signed").alias("signed"))


def top_rules_stream(documents: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Failed checks by rule of each micro-batch of result documents (verdict, checks), violations alone, in a folder a batch.

    Partial counts of a batch replace those of the same batch, so one that runs again counts once.
    """

    def each(batch: DataFrame, number: int) -> None:
        failed = batch.where("verdict = 'VIOLATION'").select(F.explode(F.filter("checks", lambda c: c["status"] == "FAIL")).alias("c"))
        failed.groupBy(F.col("c.rule").alias("rule")).count().write.mode("overwrite").parquet(f"{out}/batch={number}")

    return documents.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live_top_rules(spark: SparkSession, out: str, n: int = 10) -> DataFrame:
    """rule and count over all batches so far, as rules.top_rules gives them: partial counts are merged, documents aren't read."""
    counts = spark.read.schema("rule string, count long").parquet(f"{out}/batch=*")
    return counts.groupBy("rule").agg(F.sum("count").alias("count")).orderBy(F.desc("count"), "rule").limit(n)


def run_to_table(df: DataFrame, name: str, checkpoint: str) -> DataFrame:
    """All that is available now, in complete mode, as an in-memory table."""
    query = df.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)
