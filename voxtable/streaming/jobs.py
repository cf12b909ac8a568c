"""Job events: latest status, acknowledged endings, milestones, minute metrics, utterances, stage and transfer logs.

Functions that take events work on a table; those named stream_ take a streaming DataFrame and use watermarks: what comes later
than the watermark is dropped. endings.py has the stream of acknowledged endings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ENDINGS = ("completed", "failed")
LATE = "10 minutes"
STAGES = 3


def latest_status(events: DataFrame) -> DataFrame:
    """The last event of each job by time and number, with a code where it failed, and when, as text."""
    last = events.groupBy("job_id").agg(F.max(F.struct("ts", "event_id", "status", "progress", "error_message")).alias("e"), F.min("ts").alias("_first"), F.count("*").alias("n_events"))
    code = F.when(F.col("e.status") == "failed", F.when(F.lower(F.coalesce("e.error_message", F.lit(""))).contains("download"), "DOWNLOAD_ERROR").otherwise("PROCESSING_ERROR"))
    return last.select("job_id", "e.event_id", "e.status", "e.progress", code.alias("error_code"), F.date_format("e.ts", "yyyy-MM-dd'T'HH:mm:ss").alias("updated_at"), F.timestamp_diff("SECOND", F.col("_first"), F.col("e.ts")).alias("elapsed_s"), "n_events")


def stream_latest_status(events: DataFrame, late: str = LATE) -> DataFrame:
    """As latest_status, for output mode update: the state of each job is its last event, its first time and its count."""
    return latest_status(events.withWatermark("ts", late))


def terminal_dedup(events: DataFrame) -> DataFrame:
    """All events that are no ending; of each job's completed (and failed) events, the first ones up to the first that is acknowledged.

    An ending is on record only once it is acknowledged, so repeats before that stay.
    """
    w = Window.partitionBy("job_id", "status").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    told = events.withColumn("_done", F.coalesce(F.max(F.col("acked").cast("int")).over(w), F.lit(0)) == 1)
    return told.where(~F.col("status").isin(*ENDINGS) | ~F.col("_done")).drop("_done")


def progress_regressions(events: DataFrame) -> DataFrame:
    """Events whose progress is below the one before in their job, and the job's highest so far."""
    w = Window.partitionBy("job_id").orderBy("ts", "event_id")
    told = events.withColumns({"previous": F.lag("progress").over(w), "highest": F.max("progress").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    return told.where("progress < previous").select("job_id", "event_id", "progress", "previous", "highest")


def minute_error_rate(events: DataFrame, limit: float = 0.05, seconds: int = 60) -> DataFrame:
    """Events and error rate of each minute, and whether the rate is above the limit. Streams too, with a watermark on ts."""
    told = events.groupBy(F.window("ts", f"{seconds} seconds").alias("w")).agg(F.count("*").alias("n_events"), F.avg(F.when(F.col("status") == "failed", 1.0).otherwise(0.0)).alias("error_rate"))
    return told.select(F.col("w.start").alias("minute"), "n_events", "error_rate", (F.col("error_rate") > limit).alias("alarm"))


def minute_resources(metrics: DataFrame, low_gpu: float = 0.3, high_memory: float = 0.9, seconds: int = 60) -> DataFrame:
    """Mean use of GPU and memory (parts of 1) in each minute of metrics (ts, gpu, memory), and whether they are too low and too high. Streams too."""
    told = metrics.groupBy(F.window("ts", f"{seconds} seconds").alias("w")).agg(F.avg("gpu").alias("gpu"), F.avg("memory").alias("memory"))
    return told.select(F.col("w.start").alias("minute"), "gpu", "memory", (F.col("gpu") < low_gpu).alias("gpu_idle"), (F.col("memory") > high_memory).alias("memory_full"))


def session_utterances(words: DataFrame, pause_ms: int = 500) -> DataFrame:
    """Words (recording_id, speaker, ts, duration_ms) grouped while the next starts within pause_ms of the end. Streams too."""
    gap = F.concat((F.col("duration_ms") + pause_ms).cast("string"), F.lit(" milliseconds"))
    told = words.groupBy("recording_id", "speaker", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n_words"))
    return told.select("recording_id", "speaker", F.col("w.start").alias("started_at"), (F.col("w.end") - F.expr(f"INTERVAL {pause_ms} MILLISECONDS")).alias("ended_at"), "n_words")


def stage_bottleneck(log: DataFrame) -> DataFrame:
    """The stage of each run that took longest in all (the alphabetically first of equals)."""
    total = log.where("event = 'stage_duration'").groupBy("run_id", "stage").agg(F.sum("duration_seconds").alias("seconds"))
    order = Window.partitionBy("run_id").orderBy(F.desc("seconds"), "stage")
    return total.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("run_id", F.col("stage").alias("bottleneck_stage"), "seconds")


def stage_progress(log: DataFrame) -> DataFrame:
    """Part of the stages that a run has completed, in percent, and its errors."""
    done = F.countDistinct(F.when(F.col("event") == "stage_duration", F.col("stage")))
    return log.groupBy("run_id").agg((done / STAGES * 100).alias("progress"), F.count_if(F.col("event") == "stage_failed").alias("errors"))


def transfer_progress(chunks: DataFrame) -> DataFrame:
    """Progress of a download after each chunk: from 5 to 10."""
    run = Window.partitionBy("job_id").orderBy("chunk_idx").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("bytes").over(Window.partitionBy("job_id"))
    told = chunks.withColumns({"downloaded": F.sum("bytes").over(run), "total": total})
    return told.select("job_id", "chunk_idx", "downloaded", (5 + F.floor(F.try_divide(F.col("downloaded"), F.col("total")) * 5)).cast("long").alias("progress"))


def realtime_factor(runs: DataFrame, by: str) -> DataFrame:
    """Seconds of media for each second of work, for each value of a column and in all (null)."""
    return runs.rollup(by).agg(F.sum("duration_s").alias("duration_s"), F.sum("processing_s").alias("processing_s"), F.try_divide(F.sum("duration_s"), F.sum("processing_s")).alias("realtime_factor"))
