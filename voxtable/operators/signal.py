"""Loudness from sample blocks.

Blocks are rows (recording_id, block_idx, x_raw, gain) of a fixed number of samples; sample i is x_raw[i] * gain. For frames a
block is one hop; spectral.py has what frames of any blocks and their transforms tell. Long recordings stay cut into blocks: sums go block by block, frames are moving sums of blocks.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from voxtable.functions.numbers import decibel, rounded


@dataclass(frozen=True)
class Framing:
    """Samples of a hop and a second, hops of a frame, samples of a stored block; and for spectra mel filters, limits of pitches, frames of a task."""

    hop: int = 512
    rate: int = 16_000
    frame_hops: int = 4
    block: int = 512
    mels: int = 128
    lowest: float = 150.0
    highest: float = 4000.0
    chunk: int = 2048

    @property
    def frame(self) -> int:
        return self.hop * self.frame_hops


#: Frames of 2,048 samples every 512, at 16 kHz; 128 mel filters, and pitches from 150 to 4,000 Hz.
SPEECH = Framing()


def by_frame() -> WindowSpec:
    return Window.partitionBy("recording_id").orderBy("frame_idx")


def samples(blocks: DataFrame) -> DataFrame:
    return blocks.select("recording_id", "block_idx", F.transform("x_raw", lambda v: v.cast("double")).alias("x_raw"), "gain")


def square_sum(x: Column | str) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v)


def block_energy(blocks: DataFrame) -> DataFrame:
    """Sum of squares and peak of each block."""
    told = samples(blocks)
    return told.select("recording_id", "block_idx", (square_sum("x_raw") * F.col("gain") * F.col("gain")).alias("energy"), (F.array_max(F.transform("x_raw", F.abs)) * F.col("gain")).alias("peak"), F.size("x_raw").cast("long").alias("n"))


def frame_rms(blocks: DataFrame, framing: Framing = SPEECH) -> DataFrame:
    """RMS of the centred, zero-padded frames: one more than full blocks; with four blocks to a frame, frame i covers blocks i-2 to i+1."""
    energy = block_energy(blocks).select("recording_id", F.col("block_idx").alias("frame_idx"), "energy", "n")
    last = energy.groupBy("recording_id").agg((F.max("frame_idx") + 1).alias("frame_idx"), F.max_by("n", "frame_idx").alias("n"))
    energy, spine = energy.drop("n"), last.where(F.col("n") >= framing.hop).drop("n").withColumn("energy", F.lit(0.0))
    total = F.sum("energy").over(by_frame().rowsBetween(-(framing.frame_hops // 2), framing.frame_hops - framing.frame_hops // 2 - 1))
    return energy.unionByName(spine).select("recording_id", "frame_idx", F.sqrt(total / framing.frame).alias("rms"))


def energy_variation(frames: DataFrame) -> DataFrame:
    return frames.groupBy("recording_id").agg((F.stddev_pop("rms") / (F.avg("rms") + 1e-10)).alias("energy_variation"))


def silence_ratio(frames: DataFrame) -> DataFrame:
    """Part of the frames strictly below the 20th percentile."""
    limit = frames.groupBy("recording_id").agg(F.percentile("rms", F.lit(0.2)).alias("limit"))
    return frames.join(limit.hint("merge"), "recording_id").groupBy("recording_id").agg(F.avg(F.when(F.col("rms") < F.col("limit"), 1.0).otherwise(0.0)).alias("silence_ratio"))


def peak_amplitude(blocks: DataFrame) -> DataFrame:
    return block_energy(blocks).groupBy("recording_id").agg(F.max("peak").alias("amplitude_max"))


def recording_rms(blocks: DataFrame) -> DataFrame:
    return block_energy(blocks).groupBy("recording_id").agg(F.sqrt(F.sum("energy") / F.sum("n")).alias("rms"), F.sum("n").alias("n_samples"))


def volume_category(db: Column) -> Column:
    return F.when(db < -35, "low").when(db < -25, "medium").when(db < -15, "high").otherwise("emphasis")


def volume_peaks(frames: DataFrame) -> DataFrame:
    """Ten evenly spaced RMS values; all where there are fewer."""
    n = F.count("*").over(Window.partitionBy("recording_id"))
    step = F.greatest(F.lit(1), F.floor(F.col("n") / 10))
    told = frames.withColumn("n", n).withColumn("step", step).where((F.col("frame_idx") % F.col("step") == 0) & (F.col("frame_idx") / F.col("step") < 10))
    return told.groupBy("recording_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame_idx", "rms"))), lambda x: rounded(x["rms"], 3)).alias("volume_peaks"))


def touched(segments: DataFrame, blocks: DataFrame, framing: Framing = SPEECH) -> DataFrame:
    """The blocks that hold samples [int(start * rate), int(end * rate)) of each segment, cut to those that exist: x is a block's part of them, from sample at of the segment on.

    A segment is spread over the blocks it touches, which join by number; only first and last blocks are cut.
    """
    hop, rate = framing.block, framing.rate
    size = blocks.groupBy("recording_id").agg((F.sum(F.size("x_raw"))).alias("_size"))
    span = segments.join(size.hint("merge"), "recording_id").select("recording_id", "seg_idx", F.greatest(F.lit(0), F.floor(F.col("start_s") * rate)).alias("a"), F.least("_size", F.floor(F.col("end_s") * rate)).alias("b")).where("b > a")
    span = span.withColumn("block_idx", F.explode(F.sequence(F.floor(F.col("a") / hop), F.floor((F.col("b") - 1) / hop))))
    met = span.hint("merge").join(samples(blocks), ["recording_id", "block_idx"])
    begin = F.greatest(F.col("a") - F.col("block_idx") * hop, F.lit(0)).cast("int")
    end = F.least(F.col("b") - F.col("block_idx") * hop, F.lit(hop)).cast("int")
    return met.select("recording_id", "seg_idx", (F.col("block_idx") * hop + begin - F.col("a")).alias("at"), F.slice("x_raw", begin + 1, end - begin).alias("x"), (end - begin).alias("n"), "gain")


def interval_rms(segments: DataFrame, blocks: DataFrame, floor: float = 1e-8, missing: float = -30.0, framing: Framing = SPEECH) -> DataFrame:
    """RMS and dB of each segment's samples; missing dB where none exist."""
    part = touched(segments, blocks, framing).select("recording_id", "seg_idx", (square_sum("x") * F.col("gain") * F.col("gain")).alias("e"), "n")
    rms = part.groupBy("recording_id", "seg_idx").agg(F.sqrt(F.sum("e") / F.sum("n")).alias("rms"), F.sum("n").alias("n_samples"))
    out = segments.select("recording_id", "seg_idx").join(rms.hint("merge"), ["recording_id", "seg_idx"], "left")
    return out.select("recording_id", "seg_idx", F.coalesce("n_samples", F.lit(0)).cast("long").alias("n_samples"), "rms", F.when(F.col("rms").isNull(), F.lit(missing)).otherwise(decibel(F.col("rms"), floor)).alias("volume_db"))


def normalize_audio(blocks: DataFrame) -> DataFrame:
    """Blocks with each sample divided by the recording's peak; silent recordings stay."""
    told = samples(blocks).join(peak_amplitude(blocks), "recording_id")
    scale = F.when(F.col("amplitude_max") > 0, F.col("gain") / F.col("amplitude_max")).otherwise(F.col("gain"))
    return told.withColumn("_s", scale).select("recording_id", "block_idx", F.transform("x_raw", lambda v: v * F.col("_s")).alias("x"))


def trim_silence(frames: DataFrame, below_db: float = 10.0, framing: Framing = SPEECH) -> DataFrame:
    """First and last frame that is at most below_db under the loudest, and the samples between."""
    loudest = frames.groupBy("recording_id").agg(F.max("rms").alias("top"))
    loud = frames.join(loudest, "recording_id").where(decibel(F.col("rms"), 1e-10) > decibel(F.col("top"), 1e-10) - below_db)
    ends = loud.groupBy("recording_id").agg(F.min("frame_idx").alias("first_frame"), F.max("frame_idx").alias("last_frame"))
    return ends.select("recording_id", "first_frame", "last_frame", (F.col("first_frame") * framing.hop).alias("start_sample"), ((F.col("last_frame") + 1) * framing.hop).alias("end_sample"))


def derived(db: Column, variance: Column) -> tuple[Column, Column]:
    """rms_energy from dB, and pitch_std from the variance."""
    return F.exp(db / 20) * 1e-5, F.when(variance > 0, F.sqrt(variance)).otherwise(0.0)


# executors get what is defined here by value, so they need not have the repository on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])
