"""Long recordings in chunks, and long turns in few rows: the same as without."""

import math
import random

import pytest
from pyspark.sql import functions as F

from voxtable.operators import scan, speakers, timeline

SEGMENTS = "recording_id long, seg_idx long, start_s double, end_s double, speaker string, text string"
TURNS = "recording_id long, turn_idx long, start_s double, end_s double, speaker string"


def segments_of(spark, seed=1, recordings=4, n=60):
    r, rows = random.Random(seed), []
    for i in range(recordings):
        at = -1.0
        for k in range(n if i else 1):
            at += r.choice((-0.5, 0.0, 0.25, 0.5, 0.75, 3.0, 40.0))
            end = at + r.choice((0.0, 0.5, 1.0, 2.0, 70.0))
            rows.append((i, k, at, end, r.choice(("A", "A", "B", None)), f" t{k} "))
            at = r.choice((at, end))
    return spark.createDataFrame(rows, SEGMENTS)


def turns_of(spark, seed=2, recordings=5, n=40):
    r = random.Random(seed)
    rows = [(i, k, a := r.uniform(-5, 900), a + r.choice((-1.0, 0.0, 0.5, 3.0, 45.0, 400.0)), r.choice("ABC")) for i in range(1, recordings) for k in range(n)]
    rows += [(2, 900, 0.0, 1e7, "L"), (2, 901, 25.0, 25.0, "Z"), (3, 902, -1e6, 1e6, "L")]
    return spark.createDataFrame(rows, TURNS)


def rows(df):
    return sorted(map(repr, df.select(sorted(df.columns)).collect()))


@pytest.mark.parametrize(("seconds", "numbers"), [(1.0, 1), (7.0, 5), (50.0, 1000)])
def test_chunks_change_nothing(spark, monkeypatch, seconds, numbers):
    segments, turns = segments_of(spark).repartition(3), turns_of(spark)
    recordings = segments.groupBy("recording_id").agg((F.max("end_s") + 2).alias("duration_s")).union(spark.createDataFrame([(77, 5.0)], "r long, d double"))

    def told():
        merged = timeline.merge_segments(segments)
        return [rows(x) for x in (timeline.detect_gaps(segments, recordings), merged, timeline.fill_gaps(merged, recordings), speakers.nearest_turn(segments, turns), speakers.assign_speakers(segments, turns))]

    whole = told()
    monkeypatch.setattr(scan, "SECONDS", seconds)
    monkeypatch.setattr(scan, "NUMBERS", numbers)
    assert told() == whole and all(whole)


def test_neighbours_and_sums_are_those_of_plain_windows(spark):
    from pyspark.sql import Window

    r = random.Random(3)
    table = spark.createDataFrame([(i % 3, k, r.choice((None, k * 2)), float(r.randrange(50))) for k, i in enumerate(r.choices(range(9), k=120))], "recording_id long, n long, v long, t double")
    w = Window.partitionBy("recording_id").orderBy("t", "n")
    want = table.withColumns({"a": F.lag("v").over(w), "b": F.lead("n").over(w), "h": F.row_number().over(w) == 1})
    got = scan.neighbours(table, scan.by_time("t", 4.0), ["t", "n"], {"a": "v"}, {"b": "n"}, head="h")
    assert rows(got) == rows(want)
    for alike in (F.col("t") - F.col("before") < 20, F.col("t") != F.col("before"), F.lit(True), F.lit(None).cast("boolean")):
        told = table.withColumn("before", F.lag("t").over(o := Window.partitionBy("recording_id").orderBy("n")))
        begins = F.when((F.row_number().over(o) == 1) | ~F.coalesce(alike, F.lit(False)), F.col("n"))
        want = told.withColumn("b", begins).withColumn("s", F.last("b", ignorenulls=True).over(o.rowsBetween(Window.unboundedPreceding, 0))).drop("b", "before")
        for many in (1, 3, 40, 1000):
            assert rows(scan.islands(table, scan.by_number("n", many), "n", {"before": "t"}, alike, "s")) == rows(want)


def test_a_long_recording_is_many_tasks(spark):
    """A recording of a million segments: no task has over a quarter of its rows, and the gaps are right."""
    n = F.col("id")
    segments = spark.range(1_000_000).select(F.lit(1).cast("long").alias("recording_id"), n.alias("seg_idx"), (n * 2.0).alias("start_s"), (n * 2.0 + F.when(n % 10 == 0, 1.0).otherwise(2.0)).alias("end_s"), F.lit("A").alias("speaker"), F.lit("t").alias("text"))
    recordings = spark.createDataFrame([(1, 2_000_000.0)], "recording_id long, duration_s double")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        gaps = timeline.with_gaps(segments, recordings).withColumn("task", F.spark_partition_id())
        told = gaps.groupBy("task").agg(F.count("*").alias("n"), F.count("before_start").alias("gaps")).collect()
        assert len(told) >= 8 and max(r.n for r in told) < 250_000 and sum(r.gaps for r in told) == 99_999 + 0 * len(told) + 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def naive(segments, turns):
    out = []
    for s in segments:
        for t in turns:
            if s.recording_id == t.recording_id and t.end_s > s.start_s and t.start_s < s.end_s:
                over, length = min(s.end_s, t.end_s) - max(s.start_s, t.start_s), s.end_s - s.start_s
                out.append((s.recording_id, s.seg_idx, t.turn_idx, t.start_s, t.speaker, over, over / length if length > 0 else 0.0, min(1.0, (t.end_s - t.start_s) / 2)))
    return sorted(out)


@pytest.mark.parametrize("seconds", [0.5, 30.0])
def test_overlaps_are_those_of_the_naive_join(spark, seconds):
    segments, turns = segments_of(spark, seed=5), turns_of(spark, seed=6)
    got = sorted(map(tuple, speakers.interval_overlap(segments, turns, seconds).collect()))
    assert got == naive(segments.collect(), turns.collect()) and len(got) > 500


def test_stretches_cover_a_span_once(spark):
    r = random.Random(7)
    spans = [(a := r.choice((-1, 1)) * r.randrange(2_000), a + r.choice((0, 1, 2, 3, 7, 8, 100, 5_000))) for _ in range(300)]
    table = spark.createDataFrame([(float(a), float(b)) for a, b in spans], "start_s double, end_s double")
    for row in table.select("start_s", "end_s", speakers.cells(F.col("start_s"), F.col("end_s"), 1.0).alias("cells")).collect():
        held = sorted(n for c in row.cells for n in range(c.number << c.level, (c.number + 1) << c.level))
        assert held == list(range(int(row.start_s), int(row.end_s) + 1))
        assert len(row.cells) <= 2 * math.log2(row.end_s - row.start_s + 2) + 1


def test_a_long_turn_is_few_rows(spark):
    (row,) = spark.createDataFrame([(3.0, 1e7)], "a double, b double").select(speakers.cells(F.col("a"), F.col("b"), 1.0).alias("c")).collect()
    assert len(row.c) < 60


def test_neighbours_and_islands_are_no_unions(spark):
    """A merge join by recording trusted the partitions of a union beneath it and failed at 0.1 GB ("Can't zip RDDs"), where the runtime had changed them."""
    rows = segments_of(spark)
    recordings = rows.groupBy("recording_id").agg(F.max("end_s").alias("duration_s"))
    for told in (timeline.with_gaps(rows, recordings), timeline.merge_segments(rows)):
        assert "Union" not in told._jdf.queryExecution().optimizedPlan().toString()
        met = told.join(recordings.select("recording_id").hint("merge"), "recording_id")
        assert met.count() == told.count() > 4
