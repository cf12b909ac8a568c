"""JSON in and out: recognised segments, structured logs, analysis documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from voxtable.operators import document
from voxtable.sources import file_sink

LOG = "run_id long, event_id long, ts timestamp, stage string, event string, duration_seconds double"


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """Segments from JSON lines, with either spelling of the times; a missing field and null are the same."""
    return document.ingest_segments(spark.read.schema(document.SEGMENT).json(path))


def log_lines(lines: DataFrame) -> DataFrame:
    """line, the fields of LOG, and reason: why a line (value string) is no stage event, null where it is one. Streams too."""
    told = lines.select(F.col("value").alias("line"), F.from_json("value", f"{LOG}, broken string", {"columnNameOfCorruptRecord": "broken"}).alias("e"))
    why = F.when(F.col("e").isNull() | F.col("e.broken").isNotNull(), "not JSON").when(F.col("e.stage").isNull(), "no stage")
    return told.where(F.trim("line") != "").select("line", "e.*", why.alias("reason")).drop("broken")


def events_of(lines: DataFrame) -> DataFrame:
    """The stage events of log lines; rejected_of() has the other lines. Streams too."""
    return log_lines(lines).where("reason is null").drop("line", "reason")


def rejected_of(lines: DataFrame) -> DataFrame:
    """Log lines that are no stage events, with the reason."""
    return log_lines(lines).where("reason is not null").select("line", "reason")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Stage events from a log of JSON lines."""
    return events_of(spark.read.text(path))


def rejected_log(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a log that are no stage events."""
    return rejected_of(spark.read.text(path))


def named(rows: DataFrame, name: str) -> DataFrame:
    """rows with the name made its own: where several share it, those after the first by recording_id have their place put before the ending."""
    place = F.row_number().over(Window.partitionBy(name).orderBy("recording_id"))
    return rows.withColumn(name, F.when(place == 1, F.col(name)).otherwise(F.regexp_replace(name, r"^(.*?)(\.[^./]*)?$", F.concat(F.lit("$1_"), place.cast("string"), F.lit("$2")))))


def write_documents(documents: DataFrame, path: str, names: DataFrame, pretty: bool = False) -> None:
    """One JSON file for each recording, under its name in names (recording_id, output_name); non-ASCII stays as it is, the encoding is UTF-8.

    A recording without a name has its id for one. A file that is there under the name is replaced, others stay.
    """
    file_sink.register(documents.sparkSession)
    told = document.document_json(documents, pretty).join(names.select("recording_id", "output_name").hint("merge"), "recording_id", "left")
    own = F.coalesce("output_name", F.concat(F.col("recording_id").cast("string"), F.lit("_analysis.json")))
    rows = named(told.withColumn("name", own), "name").select("name", F.col("json").alias("content"))
    rows.write.format("one_file_each").option("path", path).mode("append").save()


def read_documents(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """file_name and the document of each JSON file in a folder, pretty or not."""
    told = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True)
    return told.select(F.col("_metadata.file_name").alias("file_name"), F.from_json("value", schema).alias("document"))
