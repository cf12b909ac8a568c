"""The acoustic features of segments: what is told for each, what stands for those that cannot be analysed, and their shapes for others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtable.functions.numbers import decibel, rounded
from voxtable.operators import spectral
from voxtable.operators.signal import SPEECH, Framing, derived, volume_category

#: The features of a segment that cannot be analysed.
FAILED = {
    "rms_energy": 0.03, "rms_db": -25.0, "pitch_mean": 150.0, "pitch_variance": 100.0, "speaking_rate": 4.0, "amplitude_max": 0.5,
    "silence_ratio": 0.2, "spectral_centroid": 2000.0, "zcr": 0.05, "volume_category": "medium",
}
#: What is the same for every segment, and the loudness points of one that cannot be analysed.
VARIANCE, ZCR, MFCC, FAILED_PEAKS = 100.0, 0.05, (12.0, -8.0, 4.0), (0.03,) * 5
#: The features of a segment without any, in the shape of the interface.
MISSING = {"volume_db": -20.0, "pitch_hz": 150.0, "spectral_centroid": 1500.0, "zero_crossing_rate": 0.1, "pitch_mean": 150.0, "pitch_std": 20.0}
#: Least RMS that is told in dB.
QUIET = 1e-10


def segment_features(blocks: DataFrame, segments: DataFrame | None = None, framing: Framing = SPEECH) -> DataFrame:
    """All features of each segment's samples, one row for each segment; without segments, of each whole recording.

    Where a peak exceeds 1 or is no number, or there are no samples, all are those of FAILED and failed is true; other segments of the
    recording are not touched by it.
    """
    spans = spectral.of_recordings(blocks) if segments is None else spectral.of_segments(segments, blocks, framing)
    told = spectral.measured(spans, blocks, framing)
    if segments is not None:
        told = segments.select("recording_id", "seg_idx").join(told.hint("merge"), ["recording_id", "seg_idx"], "left")
    db = decibel(F.col("rms"), QUIET)
    energy, _ = derived(F.col("rms_db"), F.lit(VARIANCE))
    rate = spectral.rate_of(F.size("onsets"), F.col("n_samples"), framing)
    told = told.withColumns({"rms_db": db, "pitch_mean": F.col("pitch_hz"), "pitch_variance": F.lit(VARIANCE), "zcr": F.lit(ZCR), "speaking_rate": rate})
    fine = (F.col("amplitude_max") <= 1) & ~F.isnan("amplitude_max")
    told = told.withColumns({"rms_energy": energy, "volume_category": volume_category(F.col("rms_db")), "failed": ~F.coalesce(fine, F.lit(False))})
    numbers = [F.when(F.col("failed"), F.lit(v)).otherwise(F.col(k) if isinstance(v, str) else rounded(k, 3)).alias(k) for k, v in FAILED.items()]
    points = F.transform("volume_peaks", lambda x: rounded(x, 3))
    points = F.when(F.col("failed"), F.array(*map(F.lit, FAILED_PEAKS))).otherwise(points).alias("volume_peaks")
    keys = ["recording_id"] if segments is None else ["recording_id", "seg_idx"]
    return told.select(*keys, *numbers, F.array(*map(F.lit, MFCC)).alias("mfcc"), points, "failed")


def keys_of(features: DataFrame) -> list[str]:
    return [k for k in ("recording_id", "seg_idx") if k in features.columns]


def batch_features(segments: DataFrame, features: DataFrame) -> DataFrame:
    """The features of each segment, one row for each in whatever state; those of FAILED where there are none."""
    told = segments.select("recording_id", "seg_idx").join(features.hint("merge"), keys_of(features), "left")
    numbers = [F.coalesce(F.col(k), F.lit(v)).alias(k) for k, v in FAILED.items()]
    return told.select("recording_id", "seg_idx", *numbers, F.coalesce("failed", F.lit(True)).alias("failed"))


def api_shape(features: DataFrame) -> DataFrame:
    """Features under the names of the interface; 13 zeros where there are no coefficients."""
    _, std = derived(F.col("rms_db"), F.col("pitch_variance"))
    mfcc = F.when(F.size("mfcc") > 0, F.col("mfcc")).otherwise(F.array_repeat(F.lit(0.0), 13))
    renamed = [F.col("rms_db").alias("volume_db"), F.col("pitch_mean").alias("pitch_hz"), "spectral_centroid", F.col("zcr").alias("zero_crossing_rate")]
    return features.select(*keys_of(features), *renamed, "pitch_mean", std.alias("pitch_std"), mfcc.alias("mfcc_mean"))


def attach_features(segments: DataFrame, features: DataFrame) -> DataFrame:
    """segments with the features of their own, or of their recording where features has no seg_idx; or MISSING."""
    known = features.select(*keys_of(features), *[F.col(k).alias("_" + k) for k in MISSING])
    told = segments.join(known.hint("merge"), keys_of(features), "left")
    return told.select(*segments.columns, *[F.coalesce(F.col("_" + k), F.lit(v)).alias(k) for k, v in MISSING.items()])
