"""Shapes of results: ingest, projections, roll-ups, and one nested analysis document for each recording."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxtable.functions.numbers import stripped
from voxtable.operators.speakers import UNKNOWN

RENAMED = {"start_time": "start", "end_time": "end"}
#: Volume of words that carry none at the top level, and the fixed pitch and centroid of words.
WORD_VOLUME, WORD_PITCH, WORD_CENTROID = -20.0, 150.0, 1500.0
CONFIDENCE = 0.95


def normalized(column: Column, kind: T.DataType) -> Column:
    """The column with RENAMED applied at every level, by its type alone."""
    if isinstance(kind, T.StructType):
        return F.when(column.isNotNull(), F.struct(*[normalized(column[f.name], f.dataType).alias(RENAMED.get(f.name, f.name)) for f in kind]))
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: normalized(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(column, lambda _, v: normalized(v, kind.valueType))
    return column


def normalize_timestamps(rows: DataFrame) -> DataFrame:
    return rows.select(*[normalized(F.col(f"`{f.name}`"), f.dataType).alias(RENAMED.get(f.name, f.name)) for f in rows.schema])


WORD = "struct<word:string,start:double,end:double,start_time:double,end_time:double,score:double,volume_db:double>"
SEGMENT = f"recording_id long, seg_idx long, start double, end double, start_time double, end_time double, text string, speaker string, words array<{WORD}>"


def ingest_segments(rows: DataFrame) -> DataFrame:
    """Segments from rows that spell times start or start_time; missing ones are 0."""
    return rows.select("recording_id", "seg_idx", F.coalesce("start", "start_time", F.lit(0.0)).alias("start_s"), F.coalesce("end", "end_time", F.lit(0.0)).alias("end_s"), "speaker", "text", *(["words"] if "words" in rows.columns else []))


def segment_projection(segments: DataFrame) -> DataFrame:
    """Clamped duration, default speaker, trimmed text."""
    return segments.select("recording_id", "seg_idx", F.col("start_s").alias("start_time"), F.col("end_s").alias("end_time"), F.greatest(F.col("end_s") - F.col("start_s"), F.lit(0.0)).alias("duration"), F.coalesce("speaker", F.lit(UNKNOWN)).alias("speaker_id"), stripped(F.coalesce("text", F.lit(""))).alias("text"))


def word_projection(words: DataFrame, measured: DataFrame | None = None) -> DataFrame:
    """Words with clamped duration and the fixed features; volume_db_measured has what the samples gave, if anything."""
    start, end = F.coalesce("word_start", F.lit(0.0)), F.coalesce("word_end", F.lit(0.0))
    told = words if measured is None else words.join(measured.select("recording_id", "seg_idx", F.col("volume_db").alias("volume_db_measured")).hint("merge"), ["recording_id", "seg_idx"], "left")
    extra = [] if measured is None else ["volume_db_measured"]
    return told.select("recording_id", "seg_idx", F.coalesce("word", F.lit("")).alias("word"), start.alias("start_time"), end.alias("end_time"), F.greatest(end - start, F.lit(0.0)).alias("duration"), F.lit(WORD_VOLUME).alias("volume_db"), F.lit(WORD_PITCH).alias("pitch_hz"), F.lit(WORD_CENTROID).alias("spectral_centroid"), *extra)


def full_transcript(segments: DataFrame) -> DataFrame:
    """All texts of a recording in order, joined by a space."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"])
    return segments.groupBy("recording_id").agg(F.array_join(texts, " ").alias("text"), F.count("*").alias("n_segments"))


def recording_metadata(recordings: DataFrame, segments: DataFrame, runs: DataFrame, languages: DataFrame | None = None) -> DataFrame:
    """Duration, segments, speakers, and timing of each recording.

    With languages (recording_id, requested, detected) also the language asked for, the one found or else that, and the mode.
    """
    told = segments.groupBy("recording_id").agg(F.count("*").alias("total_segments"), F.countDistinct(F.coalesce("speaker", F.lit(UNKNOWN))).alias("unique_speakers"))
    timed = runs.select("recording_id", "processing_s")
    out = recordings.join(told, "recording_id", "left").join(timed, "recording_id", "left").select(
        "recording_id", "duration_s", "sample_rate",
        F.coalesce("total_segments", F.lit(0)).alias("total_segments"), F.coalesce("unique_speakers", F.lit(0)).alias("unique_speakers"), "processing_s",
    )
    if languages is None:
        return out
    mode = F.when(F.col("requested") != "auto", "targeted").otherwise("auto-detect")
    asked = languages.select("recording_id", F.col("requested").alias("language_requested"), F.coalesce("detected", "requested").alias("language_detected"), mode.alias("processing_mode"))
    return out.join(asked, "recording_id", "left")


def merged_metadata(base: Column, extra: Column) -> Column:
    """Two objects of open metadata (variants) as one, key by key; a key of both has the value of extra, even a null one. A missing object has no keys."""
    none = F.lit(None).cast("map<string,variant>")
    keyed = lambda v: F.coalesce(v.cast("map<string,variant>"), none, F.create_map().cast("map<string,variant>"))
    own = F.map_filter(keyed(base), lambda k, _: ~F.map_contains_key(keyed(extra), k))
    return F.to_variant_object(F.map_concat(own, keyed(extra)))


def analysis_document(segments: DataFrame, words: DataFrame, recordings: DataFrame) -> DataFrame:
    """One nested document for each recording: segments in order with their words, flat words, speakers, text, duration."""
    word = F.struct(F.coalesce("word", F.lit("")).alias("word"), F.col("word_start").alias("start_time"), F.col("word_end").alias("end_time"), F.struct(F.lit(WORD_VOLUME).alias("volume_db"), F.lit(WORD_PITCH).alias("pitch_hz"), F.lit(WORD_CENTROID).alias("spectral_centroid")).alias("acoustic_features"))
    spoken = words.where("word_start is not null and word_end is not null").groupBy("recording_id", "seg_idx").agg(F.array_sort(F.collect_list(F.struct(F.col("word_start").alias("_at"), word.alias("word")))).alias("_w"))
    told = segments.join(spoken.hint("merge"), ["recording_id", "seg_idx"], "left")
    who = F.coalesce("speaker", F.lit(UNKNOWN))
    segment = F.struct(F.col("start_s").alias("start_time"), F.col("end_s").alias("end_time"), F.struct(who.alias("speaker_id")).alias("speaker"), F.col("text"), F.coalesce(F.transform("_w", lambda x: x["word"]), F.array().cast("array<struct<word:string,start_time:double,end_time:double,acoustic_features:struct<volume_db:double,pitch_hz:double,spectral_centroid:double>>>")).alias("words"))
    rows = told.groupBy("recording_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", segment.alias("s")))), lambda x: x["s"]).alias("segments"))
    stats = segments.groupBy("recording_id", who.alias("speaker")).agg(F.struct(F.sum(F.col("end_s") - F.col("start_s")).alias("total_duration"), F.count("*").alias("segment_count")).alias("stats"))
    speakers = stats.groupBy("recording_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("speaker", "stats")))).alias("speakers"))
    flat = F.flatten(F.transform("segments", lambda s: F.transform(s["words"], lambda w: F.struct(w["word"].alias("word"), w["start_time"].alias("start_time"), w["end_time"].alias("end_time"), s["speaker"]["speaker_id"].alias("speaker_id"), F.lit(CONFIDENCE).alias("confidence")))))
    text = F.array_join(F.transform("segments", lambda s: F.coalesce(s["text"], F.lit(""))), " ")
    return rows.join(speakers.hint("merge"), "recording_id").join(recordings.select("recording_id", "duration_s"), "recording_id", "left").select("recording_id", "segments", flat.alias("word_segments"), "speakers", text.alias("text"), F.col("duration_s").alias("duration"))


def document_json(documents: DataFrame, pretty: bool = False) -> DataFrame:
    """recording_id and the document as JSON, as it is; non-ASCII stays."""
    return documents.select("recording_id", F.to_json(F.struct(*[c for c in documents.columns if c != "recording_id"]), {"pretty": str(pretty).lower()}).alias("json"))
