"""Data quality: coverage, timestamp checks, constraints with quarantine, rounding of outputs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxtable.functions.numbers import rounded


def alignment_coverage(words: DataFrame) -> DataFrame:
    """Whether any segment of a recording has words."""
    has = F.coalesce(F.col("word").isNotNull() & F.col("word_start").isNotNull(), F.lit(False))
    return words.groupBy("recording_id").agg(F.bool_or(has).alias("any_words"), F.count_if(has).alias("n_words"))


def timestamp_quality(segments: DataFrame) -> DataFrame:
    """All segments, those that are zero at both ends, and those that start before they end."""
    return segments.groupBy("recording_id").agg(F.count("*").alias("n_total"), F.count_if((F.col("start_s") == 0) & (F.col("end_s") == 0)).alias("n_zero"), F.count_if(F.col("start_s") < F.col("end_s")).alias("n_valid"))


#: Constraints by name; a row that breaks one is rejected.
RULES = {
    "start_negative": "start_s < 0",
    "end_not_after_start": "end_s <= start_s",
    "confidence_range": "confidence < 0 OR confidence > 1",
    "amplitude_range": "amplitude_max < 0 OR amplitude_max > 1",
    "no_speaker": "speaker IS NULL",
}


def resolved(rows: DataFrame, rules: dict[str, str]) -> tuple[dict[str, str], list[str]]:
    """The rules that the analyser resolves on these rows, and the names of those that read a column which is not there.

    Functions and words in quotes are no columns. Any other fault of a rule is an error.
    """
    known, unchecked = {}, []
    for name, rule in rules.items():
        try:
            rows.select(F.expr(rule).cast("boolean")).schema  # noqa: B018  analysed, not run
            known[name] = rule
        except AnalysisException as e:
            if not (e.getCondition() or "").startswith(("UNRESOLVED_COLUMN", "FIELD_NOT_FOUND")):
                raise
            unchecked.append(name)
    return known, unchecked


def constraint_quarantine(rows: DataFrame, rules: dict[str, str] | None = None, strict: bool = False) -> DataFrame:
    """rows with reasons, the names of the broken rules in the order of the rules, valid, and unchecked.

    unchecked names the rules that read a column which rows do not have; with strict such a rule is an error. A rule that is null is not broken.
    """
    known, unchecked = resolved(rows, RULES if rules is None else rules)
    if strict and unchecked:
        raise ValueError(f"rules that read columns which are not there: {', '.join(unchecked)}")
    none = F.array().cast("array<string>")
    broken = F.filter(F.array(*[F.when(F.expr(v), F.lit(k)) for k, v in known.items()]), lambda x: x.isNotNull()) if known else none
    missing = F.array(*map(F.lit, unchecked)) if unchecked else none
    return rows.withColumn("reasons", broken).withColumns({"valid": F.size("reasons") == 0, "unchecked": missing})


def write_quarantine(checked: DataFrame, path: str) -> DataFrame:
    """Writes the rejected rows of constraint_quarantine() as a table by their first reason, and gives the others as they were.

    What is there under a reason stays: rejected rows of later runs come beside it.
    """
    bad = checked.where(~F.col("valid")).withColumn("reason", F.col("reasons")[0])
    bad.drop("valid").write.mode("append").partitionBy("reason").parquet(path)
    return checked.where("valid").drop("reasons", "valid", "unchecked")


def timeline_consistency(segments: DataFrame, recordings: DataFrame, slack: float = 1.0) -> DataFrame:
    """Recordings, with whether their last end lies within the duration and slack."""
    last = segments.groupBy("recording_id").agg(F.max("end_s").alias("last_end"))
    return recordings.join(last, "recording_id", "left").select("recording_id", "duration_s", "last_end", F.coalesce(F.col("last_end") <= F.col("duration_s") + slack, F.lit(True)).alias("consistent"))


def empty_recordings(recordings: DataFrame, segments: DataFrame) -> DataFrame:
    """Recordings without segments, as failed results of at least a tenth of a second."""
    return recordings.join(segments.select("recording_id").distinct(), "recording_id", "left_anti").select("recording_id", F.greatest("duration_s", F.lit(0.1)).alias("duration_s"), F.lit("no segments").alias("error"))


def error_code(message: Column) -> Column:
    return F.when(F.lower(message).contains("download"), "DOWNLOAD_ERROR").otherwise("PROCESSING_ERROR")


def rounding_contract(segments: DataFrame) -> DataFrame:
    """Times and confidence to one place, missing ones 0, and the duration of the rounded times."""
    start, end = rounded(F.coalesce("start_s", F.lit(0.0)), 1), rounded(F.coalesce("end_s", F.lit(0.0)), 1)
    return segments.select("recording_id", "seg_idx", start.alias("start_time"), end.alias("end_time"), rounded(F.coalesce("confidence", F.lit(0.0)), 1).alias("confidence"), rounded(end - start, 1).alias("duration"))


#: Features of a segment that are numbers.
FEATURES = ("rms_energy", "rms_db", "pitch_mean", "pitch_variance", "speaking_rate", "amplitude_max", "silence_ratio", "spectral_centroid", "zcr")


def to_places(rows: DataFrame, names: tuple[str, ...], places: int) -> DataFrame:
    """rows with the named columns rounded, missing values 0."""
    return rows.withColumns({n: rounded(F.coalesce(n, F.lit(0.0)), places) for n in names})


def feature_contract(features: DataFrame) -> DataFrame:
    """FEATURES and peaks to three places and the first three coefficients to one; zeros, no peaks and three zeros where they are missing."""
    mfcc = F.coalesce(F.transform(F.slice("mfcc", 1, 3), lambda v: rounded(v, 1)), F.array_repeat(F.lit(0.0), 3))
    peaks = F.coalesce(F.transform("volume_peaks", lambda v: rounded(v, 3)), F.array().cast(T.ArrayType(T.DoubleType())))
    return to_places(features, FEATURES, 3).withColumns({"mfcc": mfcc, "volume_peaks": peaks})


def performance_contract(rows: DataFrame) -> DataFrame:
    """Use of the GPU and frames a second to two places."""
    return to_places(rows, ("gpu_utilization", "avg_processing_fps"), 2)


def metadata_contract(rows: DataFrame) -> DataFrame:
    """Duration and processing time to one place."""
    return to_places(rows, ("duration_s", "processing_s"), 1)
