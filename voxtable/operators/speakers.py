"""Speakers: interval joins of segments with turns, nearest turns, assignment, and roll-ups.

Turns are rows (recording_id, turn_idx, start_s, end_s, speaker).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxtable.operators import scan

UNKNOWN = "SPEAKER_00"
#: Seconds of the shortest stretch of the interval join.
BUCKET = 30.0


def cells(start: Column, end: Column, seconds: float) -> Column:
    """Dyadic stretches of time (level, number) that cover [start, end] without overlap: two for each level at most.

    A stretch of level k is 2^k buckets long. Those of a level are the odd ones at either end of what larger ones leave.
    """
    low, high = F.floor(start / seconds), F.greatest(F.floor(start / seconds), F.floor(end / seconds)) + 1

    def of_level(k: Column) -> Column:
        size = F.pow(F.lit(2.0), k)
        a, b = F.ceil(low / size), F.floor(high / size)
        left = F.pmod(a, F.lit(2)) == 1
        right = (F.pmod(b, F.lit(2)) == 1) & (F.when(left, a + 1).otherwise(a) < b)
        cell = lambda n: F.struct(k.alias("level"), n.cast("long").alias("number"))
        return F.array_compact(F.array(F.when((a < b) & left, cell(a)), F.when((a < b) & right, cell(b - 1))))

    levels = F.sequence(F.lit(0), F.length(F.bin(high - low)).cast("int"))
    return F.flatten(F.transform(levels, of_level))


def started_within(spans: DataFrame, seconds: float) -> DataFrame:
    """Pairs of spans (recording_id, side, x with start_s and end_s) of the two sides, p of which begins in a bucket that q touches.

    A span goes to the stretches that cover it; its beginning goes to the one around it of each level that the other side of its recording
    uses. So each pair meets once, and a long span is few rows. side is 0 or 1.
    """
    cut = spans.select("recording_id", (1 - F.col("side")).alias("side"), F.col("x").alias("q"), F.explode(cells(F.col("x.start_s"), F.col("x.end_s"), seconds)).alias("cell"))
    used = cut.groupBy("recording_id", "side").agg(F.collect_set("cell.level").alias("levels"))
    level = spans.join(used.hint("merge"), ["recording_id", "side"]).select("recording_id", "side", F.col("x").alias("p"), F.explode("levels").alias("level"))
    number = F.floor(F.floor(F.col("p.start_s") / seconds) / F.pow(F.lit(2.0), F.col("level"))).cast("long")
    around = level.select("recording_id", "side", "p", F.struct(F.col("level"), number.alias("number")).alias("cell"))
    return around.join(cut.hint("merge"), ["recording_id", "side", "cell"]).select("recording_id", "side", "p", "q")


def interval_overlap(segments: DataFrame, turns: DataFrame, seconds: float = BUCKET) -> DataFrame:
    """Each pair of a segment and a turn that overlap strictly, with overlap, ratio to the segment and confidence.

    Of two that overlap one starts within the other: segments look for turns around their start, and turns for segments around theirs.
    """
    key = segments.schema["seg_idx"].dataType.simpleString()
    none = F.lit(None)
    s = segments.select("recording_id", F.lit(0).alias("side"), F.struct("start_s", "end_s", "seg_idx", none.cast("long").alias("turn_idx"), none.cast("string").alias("speaker")).alias("x"))
    t = turns.select("recording_id", F.lit(1).alias("side"), F.struct("start_s", "end_s", none.cast(key).alias("seg_idx"), F.col("turn_idx").cast("long").alias("turn_idx"), "speaker").alias("x"))
    met, seeks = started_within(s.unionByName(t), seconds), F.col("side") == 0
    first = F.when(seeks, F.col("p.start_s") >= F.col("q.start_s")).otherwise(F.col("q.start_s") < F.col("p.start_s"))
    told = met.where(first).select("recording_id", F.when(seeks, F.col("p")).otherwise(F.col("q")).alias("s"), F.when(seeks, F.col("q")).otherwise(F.col("p")).alias("t"))
    told = told.where("t.end_s > s.start_s and t.start_s < s.end_s")
    overlap, length = F.least("s.end_s", "t.end_s") - F.greatest("s.start_s", "t.start_s"), F.col("s.end_s") - F.col("s.start_s")
    sure = F.least(F.lit(1.0), (F.col("t.end_s") - F.col("t.start_s")) / 2).alias("confidence")
    ratio = F.when(length > 0, overlap / length).otherwise(0.0).alias("ratio")
    return told.select("recording_id", "s.seg_idx", "t.turn_idx", F.col("t.start_s").alias("turn_start"), F.col("t.speaker").alias("turn_speaker"), overlap.alias("overlap_s"), ratio, sure)


def best_overlap(overlaps: DataFrame) -> DataFrame:
    """The turn of each segment with the largest ratio, then overlap, then the earliest start."""
    order = Window.partitionBy("recording_id", "seg_idx").orderBy(F.desc("ratio"), F.desc("overlap_s"), "turn_start", "turn_idx")
    return overlaps.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def nearest_turn(segments: DataFrame, turns: DataFrame) -> DataFrame:
    """The turn whose middle is nearest to each segment's; the one that starts first wins ties; UNKNOWN without turns.

    Middles of both are put in one order; the last turn at or before and the first at or after each segment are compared.
    """
    middle = (F.col("start_s") + F.col("end_s")) / 2
    t = F.struct(middle.alias("mid"), F.col("start_s").alias("start"), "turn_idx", "speaker")
    b = F.struct(middle.alias("mid"), (-F.col("start_s")).alias("back"), (-F.col("turn_idx")).alias("back_idx"), "start_s", "turn_idx", "speaker")
    points = segments.select("recording_id", "seg_idx", middle.alias("mid"), F.lit(None).cast("struct<mid:double,start:double,turn_idx:long,speaker:string>").alias("t"), F.lit(None).cast("struct<mid:double,back:double,back_idx:long,start_s:double,turn_idx:long,speaker:string>").alias("b"))
    points = points.unionByName(turns.select("recording_id", F.lit(None).cast("long").alias("seg_idx"), middle.alias("mid"), t.alias("t"), b.alias("b")))
    told = scan.running_extremes(points, scan.by_time("mid"), "mid", "b", "t").where("seg_idx is not null")
    told = told.withColumnsRenamed({"_largest": "_b", "_smallest": "_f"})
    back = F.when(F.col("_b").isNotNull(), F.struct(F.abs(F.col("mid") - F.col("_b.mid")).alias("dist"), F.col("_b.start_s").alias("start"), F.col("_b.turn_idx").alias("turn_idx"), F.col("_b.speaker").alias("speaker")))
    ahead = F.when(F.col("_f").isNotNull(), F.struct(F.abs(F.col("mid") - F.col("_f.mid")).alias("dist"), F.col("_f.start").alias("start"), F.col("_f.turn_idx").alias("turn_idx"), F.col("_f.speaker").alias("speaker")))
    best = F.least(back, ahead)
    return told.select("recording_id", "seg_idx", best["turn_idx"].alias("turn_idx"), best["dist"].alias("distance"), F.coalesce(best["speaker"], F.lit(UNKNOWN)).alias("nearest_speaker"))


def assign_speakers(segments: DataFrame, turns: DataFrame) -> DataFrame:
    """segments with assigned_speaker and speaker_confidence: the best turn above a tenth of the segment, else the nearest (0.3 with some overlap, 0.2 without)."""
    best = best_overlap(interval_overlap(segments, turns)).select("recording_id", "seg_idx", "turn_speaker", "ratio", "confidence")
    near = nearest_turn(segments, turns).select("recording_id", "seg_idx", "nearest_speaker")
    told = segments.join(best.hint("merge"), ["recording_id", "seg_idx"], "left").join(near.hint("merge"), ["recording_id", "seg_idx"], "left")
    good = F.col("ratio") > 0.1
    who = F.when(good, F.col("turn_speaker")).otherwise(F.col("nearest_speaker"))
    sure = F.when(good, F.col("confidence")).when(F.col("ratio").isNotNull(), 0.3).otherwise(0.2)
    return told.select(*[F.col(c) for c in segments.columns], who.alias("assigned_speaker"), sure.alias("speaker_confidence"))


def assign_word_speakers(segments: DataFrame, turns: DataFrame) -> DataFrame:
    """The speaker with the largest summed overlap with each segment; the alphabetically first wins ties; null without overlap."""
    total = interval_overlap(segments, turns).groupBy("recording_id", "seg_idx", "turn_speaker").agg(F.sum("overlap_s").alias("overlap_s"))
    order = Window.partitionBy("recording_id", "seg_idx").orderBy(F.desc("overlap_s"), "turn_speaker")
    top = total.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    return segments.select("recording_id", "seg_idx").join(top.hint("merge"), ["recording_id", "seg_idx"], "left").select("recording_id", "seg_idx", F.col("turn_speaker").alias("speaker"), "overlap_s")


def speaker_stats(segments: DataFrame, speaker: str = "speaker") -> DataFrame:
    """Seconds (not clamped) and segments of each speaker."""
    return segments.groupBy("recording_id", F.coalesce(speaker, F.lit(UNKNOWN)).alias("speaker")).agg(F.sum(F.col("end_s") - F.col("start_s")).alias("total_duration"), F.count("*").alias("segment_count"))


def unique_speakers(segments: DataFrame) -> DataFrame:
    """Distinct speakers that are named, and distinct ones after the default."""
    return segments.groupBy("recording_id").agg(F.countDistinct(F.when(F.col("speaker") != "", F.col("speaker"))).alias("named_speakers"), F.countDistinct(F.coalesce("speaker", F.lit(UNKNOWN))).alias("all_speakers"))


def speaker_histogram(segments: DataFrame) -> DataFrame:
    return segments.groupBy(F.coalesce("speaker", F.lit(UNKNOWN)).alias("speaker")).agg(F.count("*").alias("n_segments"))


def speaker_rollup(labelled: DataFrame) -> DataFrame:
    """Mean confidence, emotions and the most frequent emotion (alphabetically first of equals) of each speaker."""
    counts = labelled.groupBy("recording_id", "speaker", "emotion").agg(F.count("*").alias("n"), F.sum("confidence").alias("c"))
    top = F.min(F.struct((-F.col("n")).alias("n"), "emotion"))["emotion"]
    return counts.groupBy("recording_id", "speaker").agg(F.sum("n").alias("n_segments"), (F.sum("c") / F.sum("n")).alias("avg_confidence"), F.array_join(F.array_sort(F.collect_set("emotion")), ",").alias("emotions"), top.alias("dominant_emotion"))
