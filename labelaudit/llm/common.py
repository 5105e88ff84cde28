"""Session, folder and Arrow helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes per Arrow batch between the JVM and Python; texts may be long, so batches are kept short.
ARROW_ROWS, ARROW_BYTES = 1000, 8 << 20


def tune(spark: SparkSession) -> None:
    """Keep Arrow batches of long texts small; a caller's own smaller settings (plain numbers) stay."""
    for key, most in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        own = spark.conf.get(key)
        if not (own.isdigit() and 0 < int(own) <= most):
            spark.conf.set(key, str(most))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Unset, only a local master gets one of its own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not path:
        path = sc.getCheckpointDir()
    if not path and not sc.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not path:
        path = "file://" + tempfile.mkdtemp(prefix="llm-shared-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder; nothing is created yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows as a written table in the shared folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, name: str) -> None:
    """Remove a folder below the shared folder, with tables that nothing reads any more."""
    fs, path = filesystem(f"{shared_dir(spark)}/{name}")
    fs.delete_dir(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def text_frame(docs: DataFrame) -> DataFrame:
    """doc_id and text alone: every other column, whatever its name, is left out before any work."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n + 1 offsets of its rows; null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    offs = offs.astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), offs - offs[0]
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def text_chunks(
    batches: Iterable[pa.RecordBatch], limit: int, column: str = "text"
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of whole rows of about `limit` bytes of text: (rows, bytes, offsets). A longer text stands alone."""
    waiting: list[pa.RecordBatch] = []
    held = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offs = text_bytes(batch.column(column))
        at = 0
        while at < batch.num_rows:
            room = max(limit - held, 0)
            to = int(np.searchsorted(offs, offs[at] + room, side="right")) - 1
            if to <= at:
                if held:
                    yield _joined(waiting, column)
                    waiting, held = [], 0
                    continue
                to = at + 1
            to = min(to, batch.num_rows)
            waiting.append(batch.slice(at, to - at))
            held += int(offs[to] - offs[at])
            at = to
            if held >= limit:
                yield _joined(waiting, column)
                waiting, held = [], 0
        if len(waiting) > 64:
            yield _joined(waiting, column)
            waiting, held = [], 0
    if waiting:
        yield _joined(waiting, column)


def _joined(waiting: list[pa.RecordBatch], column: str) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
    rows = pa.concat_batches(waiting) if len(waiting) > 1 else waiting[0]
    return (rows, *text_bytes(rows.column(column)))


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def filesystem(uri: str):
    """Arrow's file system for a folder and the path inside it; a local path needs no scheme."""
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "file://" + "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)
