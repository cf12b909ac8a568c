"""Sources and names: media catalog, source routing, file choice, output names, language settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: File types, and the order in which a title's files are preferred.
AUDIO = (".wav", ".mp3", ".flac", ".aac", ".m4a")
VIDEO = (".mp4", ".avi", ".mov", ".mkv", ".webm")
PREFERRED = (".mp4", ".webm", ".mkv", ".m4a", ".mp3")
#: The largest file, what marks a signed address, and how an address of a bucket is written.
MAX_BYTES = 5 << 30
SIGNATURES = ("AWSAccessKeyId", "X-Amz-Signature", "Signature")
BUCKET_HOST = r"^https://([^.]+)\.s3\.[^.]+\.amazonaws\.com/([^?]+)"
#: Language -> (model size, compute type, kind of optimisation).
LANGUAGES = (("ko", "large-v2", "float16", "Korean-optimized"), ("en", "large-v2", "float16", "English-optimized"), ("ja", "medium", "float16", "Japanese-optimized"), ("zh", "large-v2", "float16", "Chinese-optimized"))


def suffix(path: Column | str) -> Column:
    return F.regexp_extract(F.lower(path), r"(\.[^./]*)$", 1)


def media_catalog(files: DataFrame) -> DataFrame:
    """files (path, length, ...) with suffix, kind, and why a file is not usable (null where it is)."""
    kind = F.when(F.col("suffix").isin(*AUDIO), "audio").when(F.col("suffix").isin(*VIDEO), "video").otherwise("unsupported")
    why = F.when(F.col("length") == 0, "empty").when(F.col("length") > MAX_BYTES, "too large").when(F.col("kind") == "unsupported", "unsupported")
    return files.withColumn("suffix", suffix("path")).withColumn("kind", kind).withColumn("problem", why)


def list_media(spark: SparkSession, path: str) -> DataFrame:
    """The catalog of a folder; contents are not read. The reader leaves out empty files."""
    return media_catalog(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", F.col("modificationTime").alias("mtime")))


def source_uri_router(rows: DataFrame, uri: str = "uri") -> DataFrame:
    """How a source is fetched, with bucket and key where it lies in a bucket. The first rule that fits decides."""
    u = F.col(uri)
    signed = u.contains("amazonaws.com") & (u.contains(SIGNATURES[0]) | u.contains(SIGNATURES[1]) | u.contains(SIGNATURES[2]))
    method = F.when(u.startswith("s3://") & (F.regexp_extract(u, r"^s3://[^/]+/(.+)$", 1) != ""), "s3").when(~u.contains("://"), "local").when(signed, "presigned").when(u.rlike(BUCKET_HOST), "s3_url").otherwise("http")
    told = rows.withColumn("method", method)
    bucket = F.when(F.col("method") == "s3", F.regexp_extract(u, r"^s3://([^/]+)/", 1)).when(F.col("method") == "s3_url", F.regexp_extract(u, BUCKET_HOST, 1))
    key = F.when(F.col("method") == "s3", F.regexp_extract(u, r"^s3://[^/]+/(.+)$", 1)).when(F.col("method") == "s3_url", F.regexp_extract(u, BUCKET_HOST, 2))
    return told.withColumns({"bucket": bucket, "key": key, "job_id": F.sha2(F.coalesce(u, F.lit("")), 256)})


def pick_media_file(files: DataFrame) -> DataFrame:
    """One file for each title: the first preferred type; without one, the newest, then the first by path."""
    title = F.regexp_replace(F.col("path"), r"\.[^./]*$", "")
    rank = F.array_position(F.array(*map(F.lit, PREFERRED)), F.regexp_extract("path", r"(\.[^./]*)$", 1))
    told = files.withColumns({"title": title, "rank": F.when(rank > 0, rank).otherwise(len(PREFERRED) + 1)})
    order = Window.partitionBy("title").orderBy("rank", F.desc("mtime"), "path")
    return told.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("title", "path", "length", "mtime")


def output_name(rows: DataFrame, path: str, request: str) -> DataFrame:
    """The name of the result's file: the stem, or the request's where the stem starts with tmp or is longer than 20 characters."""
    stem = lambda c: F.regexp_extract(c, r"([^/]+?)(\.[^./]*)?$", 1)
    own = stem(path)
    return rows.withColumn("output_name", F.concat(F.when(own.startswith("tmp") | (F.length(own) > 20), stem(request)).otherwise(own), F.lit("_analysis.json")))


def language_config(requests: DataFrame, model_size: str = "base", compute_type: str = "int8") -> DataFrame:
    """Model settings of each request: those of a known language, else the caller's; without a GPU, float32."""
    dim = requests.sparkSession.createDataFrame(LANGUAGES, "language string, _size string, _type string, _kind string")
    told = requests.join(F.broadcast(dim), "language", "left")  # four rows
    return told.select("doc_id", "language", F.coalesce("_size", F.lit(model_size)).alias("model_size"), F.when(F.col("on_gpu"), F.coalesce("_type", F.lit(compute_type))).otherwise("float32").alias("compute_type"), F.coalesce(F.concat("_kind", F.lit(" (targeted)")), F.lit("universal (auto-detect)")).alias("optimization"), F.when(F.col("language") != "auto", "targeted").otherwise("auto-detect").alias("mode"))
