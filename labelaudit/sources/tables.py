"""Readers of requests, envelopes, ground truth, OCR words and images; writers of results, rejects, ledger and filings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelaudit.operators.gateway import first_wins

REQUEST = (
    "schema_version int, scan_id string, tokens array<struct<text:string,bbox:array<int>,conf:double,engine:string,lang:string>>, "
    "quality struct<ok:boolean,laplacian_var:double,glare_pct:double,prompts:array<string>,glare_bbox:array<int>>, "
    "geometry struct<shape:string,shape_detected:string,mm_per_px:double,pda_cm2:double,pda_method:string,rois:array<struct<roi:string,bbox:array<int>,conf:double>>>, "
    "roi_boxes array<struct<label:string,score:double,x:double,y:double,w:double,h:double>>, roi_frame struct<w:int,h:int>, "
    "glyphs array<struct<glyph:string,height_mm:double,width_mm:double>>, image_sha256 string, shape_hint string, captured_utc string, "
    "gps struct<lat:double,lon:double>, device string, options struct<institutional:boolean,fast_food:boolean,blown_or_molded:boolean,"
    "dossier_on_pass:boolean,commodity:string,package_height_cm:double,package_width_cm:double,package_diameter_cm:double,"
    "total_surface_cm2:double,image_diameter_mm:double>, _corrupt string"
)
ENVELOPE = (
    "schema_version string, kind string, scan_id string, verdict string, created_utc string, image_sha256 string, dossier_sha256 string, "
    "signature string, cert_fingerprint string, sig_status string, attempts int, "
    "result struct<verdict:string,summary:struct<total:int,pass:int,fail:int,na:int>,checks:array<struct<rule:string,status:string,message:string>>,"
    "meta:struct<gps:struct<lat:double,lon:double>>>, _corrupt string"
)
TRUTH = "map<string,struct<shape:string,dims_cm:struct<height:double,width:double,diameter:double,total_surface:double>,fields:map<string,string>,expect_fail:array<string>>>"


def read_json(spark: SparkSession, path: str, schema: str, stream: bool = False) -> DataFrame:
    """One document a line with a fixed schema; what can't be read is kept in _corrupt."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(schema).option("columnNameOfCorruptRecord", "_corrupt").json(path)


def read_requests(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    return read_json(spark, path, REQUEST, stream)


def parsed_requests(texts: DataFrame, column: str) -> DataFrame:
    """The columns of REQUEST out of JSON texts.

    A list of one, taken apart again: what is asked of the columns isn't pushed below it, where each mention would read the text once more.
    """
    read = F.from_json(column, REQUEST, {"columnNameOfCorruptRecord": "_corrupt"})
    return texts.select(F.explode_outer(F.array(read)).alias("r")).select("r.*")


def read_envelopes(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    return read_json(spark, path, ENVELOPE, stream)


def request_tokens(requests: DataFrame) -> DataFrame:
    """scan_id, tok, text, x, y, w, h, conf, engine, lang."""
    t = requests.select("scan_id", F.posexplode("tokens").alias("tok", "t"))
    box = lambda k: F.get("t.bbox", F.lit(k))
    return t.select(
        "scan_id", "tok", "t.text", box(0).alias("x"), box(1).alias("y"), box(2).alias("w"), box(3).alias("h"),
        F.coalesce("t.conf", F.lit(1.0)).alias("conf"), F.coalesce("t.engine", F.lit("mlkit")).alias("engine"), F.coalesce("t.lang", F.lit("en")).alias("lang"),
    )


def request_glyphs(requests: DataFrame) -> DataFrame:
    return requests.select("scan_id", F.posexplode("glyphs").alias("g", "x")).select("scan_id", "g", "x.*")


def request_roi_boxes(requests: DataFrame) -> DataFrame:
    return requests.select("scan_id", F.explode("roi_boxes").alias("b")).select("scan_id", "b.*")


def read_ground_truth(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """truth, expected fields, expected rules out of JSON objects keyed by fixture."""
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.explode(F.from_json("value", TRUTH)).alias("fixture", "e"))
    truth = rows.select("fixture", F.col("e.shape").alias("shape"), F.col("e.dims_cm").alias("dims"), F.size("e.fields").alias("n_fields"))
    fields = rows.select("fixture", F.explode("e.fields").alias("field", "raw"))
    return truth, fields, rows.select("fixture", F.explode("e.expect_fail").alias("rule"))


def image_digests(spark: SparkSession, path: str) -> DataFrame:
    """scan_id (the file's name) and sha256 of image files."""
    name = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    return spark.read.format("binaryFile").load(path).select(name.alias("scan_id"), F.sha2("content", 256).alias("sha256"))


def digest_mismatches(requests: DataFrame, digests: DataFrame) -> DataFrame:
    """Scans whose declared digest isn't that of their image."""
    return requests.join(digests, "scan_id").where(F.lower("image_sha256") != F.col("sha256")).select("scan_id", "image_sha256", "sha256")


def gateway_catalog(spark: SparkSession, name: str, url: str, **options: str) -> None:
    """Register a SQL store as a catalog: its tables are name.schema.table, and filters, aggregates and limits go to the store, as far as
    Spark's dialect of it has them."""
    prefix = f"spark.sql.catalog.{name}"
    spark.conf.set(prefix, "org.apache.spark.sql.execution.datasources.v2.jdbc.JDBCTableCatalog")
    for key, value in {"url": url, "pushDownAggregate": "true", "pushDownLimit": "true", **options}.items():
        spark.conf.set(f"{prefix}.{key}", value)


def read_gateway_jdbc(spark: SparkSession, table: str, key: str | None = None, partitions: int | None = None) -> DataFrame:
    """A table of a catalog made by gateway_catalog, read by as many tasks as partitions says (else one a core).

    key: a numeric, date or timestamp column that is cut into equal ranges between its least and greatest value, which
    the store works out; without one, or if there is none to be had (no rows, nulls alone), a single task reads all.
    Rows with a null key are read too, by the first task.
    """
    if key is None:
        return spark.table(table)
    low, high = spark.table(table).agg(F.min(key), F.max(key)).first()
    if low is None:
        return spark.table(table)
    n = partitions or spark.sparkContext.defaultParallelism
    return spark.read.options(partitionColumn=key, lowerBound=str(low), upperBound=str(high), numPartitions=str(n)).table(table)


def append_ledger(rows: DataFrame, path: str, order: str | None = None) -> None:
    """Append what is new: the first row of an id, by the order column, wins for ever; RETRY is never stored.

    Without an order given, the first of received, created, created_utc or captured_utc that rows have is taken.
    """
    spark = rows.sparkSession
    order = order or next((c for c in ("received", "created", "created_utc", "captured_utc") if c in rows.columns), None)
    wanted = rows.where("verdict <> 'RETRY'")
    try:
        known = spark.read.parquet(path)
    except Exception as error:  # nothing has been written yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        known = None
    if known is not None:
        wanted = wanted.join(known.select("scan_id"), "scan_id", "left_anti")
    first = first_wins(wanted, "scan_id", order) if order else wanted.dropDuplicates(["scan_id"])
    first.write.mode("append").parquet(path)


def write_rejects(rejects: DataFrame, path: str) -> None:
    """Error rows (scan_id, code, message, stage), a folder for each code."""
    write_json(rejects, path, "code")


def result_documents(scans: DataFrame, checks: DataFrame, fields: DataFrame) -> DataFrame:
    """scan_id and one nested result: verdict, checks in order, fields as a map, summary."""
    listed = checks.groupBy("scan_id").agg(F.sort_array(F.collect_list(F.struct("ord", "rule", "status", "message"))).alias("checks"))
    mapped = fields.groupBy("scan_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", F.struct("raw", "unit", "conf"))))).alias("fields"))
    both = scans.join(listed, "scan_id", "left").join(mapped, "scan_id", "left")
    summary = F.struct("total", F.col("passed").alias("pass"), F.col("failed").alias("fail"), "na")
    return both.select("scan_id", F.struct("verdict", "checks", "fields", summary.alias("summary")).alias("result"))


def write_json(df: DataFrame, path: str, partition: str | None = None) -> None:
    """Results, filings, features or reports as JSON lines; rejects are partitioned by their code."""
    writer = df.write.mode("append")
    (writer.partitionBy(partition) if partition else writer).json(path)
