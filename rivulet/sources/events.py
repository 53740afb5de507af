"""Change events as JSON lines: tolerant and strict readers, landing and normalised writers."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rivulet.functions.canonical import manifest_digest
from rivulet.sources import staging

FIELDS = ("event_id", "table_name", "operation", "event_timestamp", "source_commit_timestamp", "batch_id", "source_system")


def batch_of(path: Column) -> Column:
    """The batch_id= part of a path, else its folder."""
    own = F.regexp_extract(path, r"batch_id=([^/\\]+)", 1)
    return F.when(own != "", own).otherwise(F.regexp_extract(path, r"([^/\\]+)[/\\][^/\\]*$", 1))


def logical_file_id(path: Column) -> Column:
    """The part of a path that any root has: batch folder and file name."""
    own = F.regexp_extract(path, r"(batch_id=[^/\\]+[/\\][^/\\]+)$", 1)
    return F.when(own != "", own).otherwise(F.regexp_extract(path, r"([^/\\]+)$", 1))


def _text(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f"$.{name}", "string")


def read_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """(raw_record, source_file, ingestion_order) of every line that isn't blank; the order is that in the file, from 0, blank
    lines counted.

    Files are read in splits, as many tasks share a large one. A line's number is its place in its split plus the lines of
    the file's splits before: one row for each split is counted, summed up along the file and joined back.
    """
    lines = spark.read.option("lineSep", "\n").text(list(paths)).select(
        "value", F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("_at"),
        # rows of a partition are numbered in order, and a split lies in one partition
        F.monotonically_increasing_id().alias("_row"),
    )
    splits = lines.groupBy("source_file", "_at").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    before = Window.partitionBy("source_file").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("source_file", "_at", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = lines.join(splits, ["source_file", "_at"])
    own = numbered.select(F.rtrim("value", F.lit("\r")).alias("raw_record"), "source_file", (F.col("_row") - F.col("_first") + F.col("_before")).alias("ingestion_order"))
    return own.where(F.trim("raw_record") != "")


def parse(lines: DataFrame) -> DataFrame:
    """Adds the event's fields as text or JSON text; malformed marks lines that aren't a JSON object.

    sequence_json tells a number, a text and a boolean apart; business_key is a map of texts, null if it isn't an
    object. Repeated names, NaN and anything behind the object make a line malformed.
    """
    # a parser stops behind the first value: only a single one stands both alone in a list and as a name's value
    one = F.when(F.try_parse_json(F.concat(F.lit('{"v":'), "raw_record", F.lit("}"))).isNotNull(), F.try_parse_json(F.concat(F.lit("["), "raw_record", F.lit("]"))))
    v = lines.withColumn("_v", F.try_variant_get(one, "$[0]", "variant"))
    v = v.withColumn("malformed", F.coalesce(~F.schema_of_variant("_v").startswith("OBJECT"), F.lit(True)))
    key = F.try_variant_get("_v", "$.business_key", "map<string,string>")
    cols = [_text(F.col("_v"), f).alias(f) for f in FIELDS]
    return v.select(
        "raw_record", "source_file", "ingestion_order", "malformed", *cols,
        F.to_json(F.try_variant_get("_v", "$.sequence_number", "variant")).alias("sequence_json"),
        F.to_json(F.try_variant_get("_v", "$.business_key", "variant")).alias("business_key_json"),
        key.alias("business_key"),
        F.nullif(F.to_json(F.try_variant_get("_v", "$.payload", "variant")), F.lit("null")).alias("payload_json"),
        F.nullif(F.to_json(F.try_variant_get("_v", "$.before_payload", "variant")), F.lit("null")).alias("before_payload_json"),
    ).withColumn("ingestion_batch_id", F.coalesce("batch_id", batch_of(F.col("source_file"))))


def read_events(spark: SparkSession, *paths: str) -> DataFrame:
    """Tolerant reader: every line, parsed as far as it goes."""
    return parse(read_lines(spark, *paths))


def read_events_strict(spark: SparkSession, *paths: str) -> DataFrame:
    """Fails at the first line that isn't a JSON object, naming file and line."""
    told = F.concat(F.lit("malformed event at "), F.col("source_file"), F.lit(":"), (F.col("ingestion_order") + 1).cast("string"))
    return read_events(spark, *paths).withColumn("malformed", F.when(F.col("malformed"), F.raise_error(told).cast("boolean")).otherwise(False))


def processing_id(spark: SparkSession, *paths: str) -> str:
    """Content address of a set of files; of plain names, none of which is a path, that of the names."""
    if not any(_exists(spark, p) for p in paths):
        return "proc_" + hashlib.sha256("\n".join(sorted({str(p) for p in paths})).encode()).hexdigest()[:16]
    files = spark.read.format("binaryFile").load(list(paths))
    own = files.select(logical_file_id(F.col("path")).alias("logical_id"), F.sha2("content", 256).alias("content_sha256"))
    return own.agg(manifest_digest().alias("id")).first()["id"]


def _exists(spark: SparkSession, path: str) -> bool:
    if not path:
        return False
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


QUARANTINED = "quarantine_code string, quarantine_reason string, raw_record string, event_id string, table_name string, source_file string, batch_id string"


def read_normalized(spark: SparkSession, path: str, schema: str, processing: str | None = None) -> DataFrame:
    """The rows of one processing_id= folder, or of all, as write_normalized() left them; none if it isn't there."""
    if processing is None:
        own = f"{path}/processing_id=*" if _exists(spark, f"{path}/processing_id=*") else None
    else:
        own = staging.resolve(spark, f"{path}/processing_id={processing}")
    return spark.read.schema(schema).json(own) if own else spark.createDataFrame([], schema)


def write_landing(events: DataFrame, path: str) -> None:
    """JSON lines under batch_id= and table_name= folders; a batch written again replaces itself."""
    events.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id", "table_name").json(path)


def write_normalized(df: DataFrame, path: str, processing: str, *order: str) -> None:
    """One processing_id= folder of JSON lines in the given order, replaced as a whole: staged, then renamed."""
    staging.replace(df.sparkSession, f"{path}/processing_id={processing}", df.orderBy(*order).write.json)
