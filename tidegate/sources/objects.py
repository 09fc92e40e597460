"""Reading and writing objects, control records, the catalog and extracted text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.functions.classify import blank_to_null, task_key
from tidegate.operators.catalog import latest_state
from tidegate.policy import Policy
from tidegate.sources.publish import publish
from tidegate.sources.listing import no_objects, opened, read_objects, read_ranges, spark_listing

CONTROL = {
    "upload": "upload_key string, object_key string, temp_object_key string, owner_token_hash string, upload_start_deadline string, upload_finish_deadline string, status string",
    "task": "object_key string, kind string, status string, created_at string, updated_at string",
    "share": "shared_key string, target_object_key string, original_name string, content_type string, created_at string, created_by string, expires_at string, revoked boolean",
}
CATALOG = "id string, name string, key string, content_type string, size long, created_at string, updated_at string, owner string, status string, url string, thumbnail_url string, deleted boolean"


def scan_objects(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """All objects under a path whose key starts with `prefix`: object_key, size, last_modified, content; no other is listed or opened."""
    if opened(path):
        return read_objects(spark, path, prefix)
    rows = spark_listing(spark, path, prefix)
    if rows is None:
        return no_objects(spark)
    return rows.select(object_key(F.col("path"), path).alias("object_key"), F.col("length").alias("size"), F.col("modificationTime").alias("last_modified"), "content")


def object_key(full: Column, root: str) -> Column:
    """A file's path below the root it was read from."""
    tail = root.rstrip("/").split("://")[-1].split(":")[-1]
    return F.regexp_replace(full, "^.*?" + "\\Q" + tail + "\\E/?", "")


def object_heads(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """As `scan_objects` without the bodies: no object is opened."""
    return (read_objects(spark, path, prefix, False) if opened(path) else scan_objects(spark, path, prefix)).select("object_key", "size", "last_modified")


def object_ranges(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """`wanted` (object_key, start, end and others) with `piece`, those bytes of the object; read by seeking where the store allows."""
    if opened(path):
        return read_ranges(wanted, path)
    bodies = scan_objects(spark, path).select("object_key", "content")
    return wanted.join(bodies, "object_key", "left").withColumn("piece", byte_range(F.col("content"), F.col("start"), F.col("end"))).drop("content").select(*wanted.columns, "piece")


def byte_range(content: Column, start: Column | int, end: Column | int) -> Column:
    """Bytes start to end, both counted; the end is cut to the content's."""
    start, end = (F.lit(x) if isinstance(x, int) else x for x in (start, end))
    return F.when((start >= 0) & (start < F.octet_length(content)) & (end >= start), F.substring(content, (start + 1).cast("int"), (F.least(end, F.octet_length(content) - 1) - start + 1).cast("int")))


def parse_control_records(bodies: DataFrame, kind: str) -> DataFrame:
    """Records of JSON bodies: a field that is empty in the body falls back to lower-cased object metadata.

    `bodies` has `body` and optionally `metadata` (map). A body that is no JSON
    gives only what its metadata holds.
    """
    fields = [f.strip().split(" ") for f in CONTROL[kind].split(",")]
    rows = bodies if "metadata" in bodies.columns else bodies.withColumn("metadata", F.create_map().cast("map<string,string>"))
    lowered = F.transform_keys(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, _: F.lower(k))
    rows = rows.withColumn("_record", F.from_json("body", CONTROL[kind], {"mode": "PERMISSIVE"})).withColumn("_meta", lowered)

    def value(name: str, type_: str) -> Column:
        own, other = F.col(f"_record.{name}"), F.col("_meta")[name.replace("_", "-")]
        if type_ == "boolean":
            return F.coalesce(own, F.lower(other) == "true", F.lit(False)).alias(name)
        return F.coalesce(blank_to_null(own), blank_to_null(other), blank_to_null(F.col("_meta")[name])).alias(name)

    return rows.select(*[c for c in bodies.columns if c not in ("body", "metadata")], *[value(*f) for f in fields])


def read_control_records(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Control records of all JSON files under a path."""
    rows = scan_objects(spark, path).select(F.col("object_key").alias("record_key"), F.col("content").cast("string").alias("body"))
    return parse_control_records(rows, kind)


def record_key(kind: str) -> Column:
    if kind == "task":
        return F.concat(F.lit(".tasks/"), task_key(F.col("kind"), F.col("object_key")), F.lit(".json"))
    return F.concat(F.lit(".uploading/"), "upload_key", F.lit(".json")) if kind == "upload" else F.concat(F.lit("shared/"), "shared_key")


def write_control_records(records: DataFrame, kind: str, path: str, order: list[str]) -> None:
    """One JSON line per record key, the last write of each kept; key and body, by kind."""
    names = [f.strip().split(" ")[0] for f in CONTROL[kind].split(",")]
    rows = latest_state(records.withColumn("record_key", record_key(kind)), "record_key", order)
    rows.select("record_key", F.to_json(F.struct(*names)).alias("body")).write.mode("overwrite").json(f"{path}/kind={kind}")


def split_publish(screened: DataFrame, accepted_path: str, quarantine_path: str) -> None:
    """Accepted rows (null verdict) to one place, the others to another; one pass of screening serves both."""
    rows = screened.persist()
    try:
        rows.where("verdict is null").drop("verdict").write.mode("append").parquet(accepted_path)
        rows.where("verdict is not null").write.mode("append").parquet(quarantine_path)
    finally:
        rows.unpersist()


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """The catalog of a JSON array file; a missing or blank file is an empty catalog."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], CATALOG)
    return spark.read.schema(CATALOG).json(path, multiLine=True)


def append_catalog(catalog: DataFrame, rows: DataFrame) -> DataFrame:
    return catalog.unionByName(rows, allowMissingColumns=True)


def delete_from_catalog(catalog: DataFrame, ids: DataFrame) -> DataFrame:
    return catalog.join(ids.select("id").distinct(), "id", "left_anti")


def extracted_bodies(extracted: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """(object_key, text_key, body, status, error_code): generated results as JSON; one over the limit has failed."""
    body = F.to_json("content")
    rows = extracted.where("status = 'generated'").select("object_key", F.concat("object_key", F.lit(policy.text_suffix)).alias("text_key"), body.alias("body"))
    over = F.octet_length("body") > policy.max_output_bytes
    return rows.select("object_key", "text_key", F.when(~over, F.col("body")).alias("body"), F.when(over, "failed").otherwise("generated").alias("status"), F.when(over, "output_too_large").alias("error_code"))


def write_extracted(extracted: DataFrame, path: str, number: int = 0, policy: Policy = Policy()) -> None:
    """Publish what was extracted as batch `number`: bodies under `texts`, the status of every object, failed and skipped ones too, under `status`."""
    made = extracted_bodies(extracted, policy).select("object_key", "text_key", "body", F.col("status").alias("made"), F.col("error_code").alias("made_error"))
    every = extracted.select("object_key", "status", "error_code").join(made, "object_key", "left")
    status = every.select("object_key", F.coalesce("made", "status").alias("status"), F.coalesce("made_error", "error_code").alias("error_code"))
    texts = every.where("made = 'generated'").select("object_key", "text_key", "body")
    publish(number, {f"{path}/texts": texts, f"{path}/status": status}, f"{path}/_batches")
