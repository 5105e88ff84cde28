"""A store of first rows by key: bucketed by a hash of the key, with a commit for each batch.

Rows of batch n lie below data/batch=n/bucket=k as Parquet; commits/n names the batch's buckets and appears by a rename
once all of its files are written. Readers see committed batches alone, so half a batch is never seen, and a batch that
runs again either finds its commit and changes nothing or replaces what it had begun. An ingest reads only the buckets
that its keys fall into, and of those only what was committed before.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


def _files(spark: SparkSession, path: str):
    """The file system of a path, by Spark's own settings, and a way to name paths in it."""
    of = spark._jvm.org.apache.hadoop.fs.Path
    return of(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), of


def commits(spark: SparkSession, path: str) -> dict[int, list[int]]:
    """Committed batches with their buckets."""
    fs, of = _files(spark, path)
    folder = of(f"{path}/commits")
    if not fs.exists(folder):
        return {}
    names = [s.getPath().getName() for s in fs.listStatus(folder) if not s.getPath().getName().startswith((".", "_"))]
    rows = spark.read.text([f"{path}/commits/{n}" for n in names]).collect() if names else []  # a line a batch
    return {c["batch"]: c["buckets"] for c in (json.loads(r["value"]) for r in rows)}


def commit(spark: SparkSession, path: str, number: int, buckets: list[int]) -> None:
    fs, of = _files(spark, path)
    hidden, final = of(f"{path}/commits/.{number}"), of(f"{path}/commits/{number}")
    stream = fs.create(hidden, True)
    stream.write(bytearray(json.dumps({"batch": number, "buckets": buckets}).encode()))
    stream.close()
    if not fs.rename(hidden, final) and not fs.exists(final):
        raise OSError(f"batch {number} could not be committed to {path}")


def read_store(spark: SparkSession, path: str, buckets: list[int] | None = None) -> DataFrame | None:
    """Rows of committed batches; buckets: of these alone. None before the first commit."""
    known = commits(spark, path)
    wanted = [n for n, held in sorted(known.items()) if held and (buckets is None or set(held) & set(buckets))]
    if not wanted:
        return None
    rows = spark.read.option("basePath", f"{path}/data").parquet(*[f"{path}/data/batch={n}" for n in wanted])
    return rows if buckets is None else rows.where(F.col("bucket").isin(*buckets))


def first_rows(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key: partial aggregates, so a key that fills a batch is no burden to one task."""
    return rows.groupBy(key).agg(F.min_by(F.struct(*rows.columns), F.struct(order, F.xxhash64(*rows.columns))).alias("r")).select("r.*")


def append_first(rows: DataFrame, path: str, number: int, key: str = "scan_id", order: str = "received", buckets: int = BUCKETS) -> bool:
    """Rows whose key the store doesn't hold, the first of each, as batch `number`; False if it was committed before."""
    spark = rows.sparkSession
    if number in commits(spark, path):
        return False
    first = first_rows(rows, key, order).withColumn("bucket", bucket_of(key, buckets))
    touched = sorted(r["bucket"] for r in first.select("bucket").distinct().collect())  # no more than buckets
    known = read_store(spark, path, touched) if touched else None
    if known is not None:
        # buckets in the key: a bucket's rows meet that bucket's alone
        first = first.join(known.select("bucket", key), ["bucket", key], "left_anti")
    first.select(*rows.columns, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/batch={number}")
    fs, of = _files(spark, path)
    made = [s.getPath().getName() for s in fs.listStatus(of(f"{path}/data/batch={number}"))]
    commit(spark, path, number, sorted(int(n.split("=")[1]) for n in made if n.startswith("bucket=")))
    return True
