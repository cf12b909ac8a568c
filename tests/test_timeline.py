"""Hand-made cases and properties of the timeline and speaker operators."""

import random

import pytest
from pyspark.sql import functions as F

from voxtable.operators import document, quality, speakers, timeline
from voxtable.plans.queries import SMALL
from voxtable.plans.standin import table

SEGMENT = "recording_id long, seg_idx long, start_s double, end_s double, speaker string, text string"
TURN = "recording_id long, turn_idx long, start_s double, end_s double, speaker string"
RECORDING = "recording_id long, duration_s double, sample_rate int"


def segments(spark, rows):
    return spark.createDataFrame(rows, SEGMENT)


def some_segments(seed, recordings=6, n=12):
    r = random.Random(seed)
    rows = []
    for rec in range(recordings):
        at = 0.0
        for i in range(n):
            at += r.choice((-0.25, 0.0, 0.25, 0.5, 0.75, 3.0))
            length = r.choice((0.0, 0.5, 1.0, 4.0))
            rows.append((rec, i, at, at + length, r.choice(("A", "B", None)), r.choice(("hi", " x ", ""))))
            at += length
    return rows


def some_turns(seed, recordings=5, n=9):
    r = random.Random(seed)
    rows = []
    for rec in range(recordings):
        for i in range(n):
            a = r.randrange(160) / 4
            rows.append((rec, i, a, a + r.randrange(1, 20) / 4, r.choice("ABC")))
    return rows


def test_merge(spark):
    given = [(1, 0, 0.0, 1.0, "A", " a "), (1, 1, 1.25, 2.0, "A", "b "), (1, 2, 2.5, 3.0, "A", "c"), (1, 3, 3.0, 3.5, None, "d"), (1, 4, 3.5, 3.25, None, ""), (1, 5, 3.75, 4.0, "B", " only "), (2, 0, 0.0, 9.0, "A", "x"), (2, 1, 1.0, 2.0, "A", "y")]
    out = [tuple(r)[1:] for r in timeline.merge_segments(segments(spark, given)).orderBy("recording_id", "seg_idx").collect()]
    assert out == [(0, 0.0, 2.0, "A", "a b", 2), (2, 2.5, 3.0, "A", "c", 1), (3, 3.0, 3.25, None, "d", 2), (5, 3.75, 4.0, "B", " only ", 1), (0, 0.0, 2.0, "A", "x y", 2)]


@pytest.mark.parametrize("seed", [1, 2])
def test_merge_is_idempotent(spark, seed):
    once = timeline.merge_segments(segments(spark, some_segments(seed))).drop("n_merged").persist()
    assert timeline.merge_segments(once).where("n_merged > 1").count() == 0


def test_fill_gaps(spark):
    given = [(1, 0, 0.5, 1.0, "A", "a"), (1, 1, 1.5, 2.0, "A", "b"), (1, 2, 3.0, 4.0, "B", "c"), (2, 0, 0.75, 1.0, "A", "x"), (3, 0, 0.0, 1.0, "A", None)]
    out = {(r.recording_id, r.seg_idx): r for r in timeline.fill_gaps(segments(spark, given), spark.createDataFrame([(1, 4.5, 1), (2, 2.0, 1)], RECORDING)).collect()}
    assert (out[1, 0].start_s, out[1, 0].end_s, out[1, 0].text) == (0.5, 1.0, "a")  # exactly 0.5 s is no gap
    assert (out[1, 1].end_s, out[1, 1].text) == (3.0, "b [SILENCE]")  # the earlier neighbour takes the gap
    assert (out[1, 2].start_s, out[1, 2].end_s, out[1, 2].text) == (3.0, 4.0, "c")
    assert (out[2, 0].start_s, out[2, 0].end_s, out[2, 0].text) == (0.0, 2.0, "[SILENCE] x [SILENCE]")
    assert [w.word for w in out[2, 0].silence_words] == [" ", " "] and out[2, 0].silence_words[0].acoustic_features.volume_db == -60.0
    assert out[3, 0].text == "" and out[3, 0].silence_words == []  # no recording row: no ending to fill


BLOCK = "recording_id long, block_idx long, x_raw array<double>, gain double"


def test_fill_gaps_measures_gaps_and_keeps_words(spark):
    word = "array<struct<word: string, start: double, acoustic_features: struct<volume_db: double>>>"
    given = [(1, 0, 1.0, 2.0, "A", "a", [("late", 1.5, (-3.0,)), ("early", 1.25, None)], "x"), (1, 1, 4.0, 5.0, "B", "b", None, "y"), (1, 2, 5.0, 6.0, "B", "c", [("own", 5.0, None)], "z")]
    rows = spark.createDataFrame(given, f"{SEGMENT}, words {word}, note string")
    blocks = spark.createDataFrame([(1, i, [0.1 if i < 4 else 0.01] * 64, 1.0) for i in range(16)], BLOCK)  # 4 s
    out = {r.seg_idx: r for r in timeline.fill_gaps(rows, spark.createDataFrame([(1, 9.0, 1)], RECORDING), blocks, SMALL).collect()}
    assert [(w.word, w.start_time, w.start, w.acoustic_features and w.acoustic_features.volume_db) for w in out[0].words] == [(" ", 0.0, None, -20.0), ("early", None, 1.25, None), ("late", None, 1.5, -3.0), (" ", 2.0, None, -40.0)]
    assert out[1].words == [] and [w.word for w in out[2].words] == ["own", " "]
    assert out[2].silence_words[0].acoustic_features.volume_db == -60.0  # no samples there
    assert [out[i].note for i in range(3)] == ["x", "y", "z"]


def test_merge_keeps_words_and_the_first_rows_fields(spark):
    given = [(1, 0, 0.0, 1.0, "A", "a", ["p"], None), (1, 1, 1.0, 2.0, "A", "b", None, "no"), (1, 2, 2.0, 3.0, "A", "c", ["q", "r"], "no"), (1, 3, 3.0, 4.0, "B", "d", None, "yes")]
    out = timeline.merge_segments(spark.createDataFrame(given, f"{SEGMENT}, words array<string>, note string")).orderBy("seg_idx").collect()
    assert [(r.words, r.note, r.n_merged) for r in out] == [(["p", "q", "r"], None, 3), (None, "yes", 1)]


def test_fallback_words_are_measured(spark):
    blocks = spark.createDataFrame([(1, i, [0.1 if i < 4 else 0.01] * 64, 1.0) for i in range(8)], BLOCK)
    out = timeline.fallback_words(segments(spark, [(1, 0, 0.0, 3.0, None, "one two three")]), blocks=blocks, framing=SMALL).orderBy("word_idx").collect()
    assert [r.volume_db for r in out] == [-20.0, -40.0, -30.0]


@pytest.mark.parametrize("seed", [3, 4])
def test_no_gap_is_left(spark, seed):
    given = segments(spark, some_segments(seed))
    recordings = given.groupBy("recording_id").agg((F.max("end_s") + 2).alias("duration_s"))
    order = {(r.recording_id, r.seg_idx): r for r in timeline.fill_gaps(given, recordings).collect()}
    for rec in range(6):
        own = sorted((x for x in some_segments(seed) if x[0] == rec), key=lambda x: (x[2], x[1]))
        for a, b in zip(own, own[1:], strict=False):
            assert order[rec, b[1]].start_s - order[rec, a[1]].end_s <= 0.5


@pytest.mark.parametrize("seconds", [0.5, 3.0, 1000.0])
def test_interval_join_is_the_naive_one(spark, seconds):
    s, t = some_segments(5), some_turns(6)
    got = sorted((r.recording_id, r.seg_idx, r.turn_idx, r.overlap_s) for r in speakers.interval_overlap(segments(spark, s), spark.createDataFrame(t, TURN), seconds).collect())
    assert got == sorted((a[0], a[1], b[1], min(a[3], b[3]) - max(a[2], b[2])) for a in s for b in t if a[0] == b[0] and b[3] > a[2] and b[2] < a[3])


def test_nearest_turn_is_the_naive_one(spark):
    s, t = some_segments(7), some_turns(8)
    got = {(r.recording_id, r.seg_idx): (r.turn_idx, r.nearest_speaker) for r in speakers.nearest_turn(segments(spark, s), spark.createDataFrame(t, TURN)).collect()}
    for a in s:
        own = sorted((abs((a[2] + a[3]) / 2 - (b[2] + b[3]) / 2), b[2], b[1], b[4]) for b in t if b[0] == a[0])
        assert got[a[0], a[1]] == ((own[0][2], own[0][3]) if own else (None, "SPEAKER_00"))


def test_assignment_tiers(spark):
    s = [(1, 0, 0.0, 10.0, None, ""), (1, 1, 20.0, 30.0, None, ""), (1, 2, 50.0, 51.0, None, ""), (1, 3, 5.0, 5.0, None, ""), (2, 0, 0.0, 1.0, None, "")]
    t = [(1, 0, 0.0, 6.0, "A"), (1, 1, 29.5, 29.75, "B"), (1, 2, 26.0, 28.0, "C")]
    out = {(r.recording_id, r.seg_idx): (r.assigned_speaker, r.speaker_confidence) for r in speakers.assign_speakers(segments(spark, s), spark.createDataFrame(t, TURN)).collect()}
    assert out == {(1, 0): ("A", 1.0), (1, 1): ("C", 1.0), (1, 2): ("B", 0.2), (1, 3): ("A", 0.3), (2, 0): ("SPEAKER_00", 0.2)}


def test_fallback_words(spark):
    given = [(1, 0, 0.0, 1.0, None, " one  two\nthree "), (1, 1, 2.0, 2.0, None, "no length"), (1, 2, 3.0, 4.0, None, " "), (1, 3, 3.0, 4.0, None, None), (1, 4, 0.0, 2.0, None, "a b")]
    out = [(r.seg_idx, r.word, r.start_time, r.end_time) for r in timeline.fallback_words(segments(spark, given)).orderBy("seg_idx", "word_idx").collect()]
    assert out == [(0, "one", 0.0, 0.33), (0, "two", 0.33, 0.67), (0, "three", 0.67, 1.0), (4, "a", 0.0, 1.0), (4, "b", 1.0, 2.0)]


def test_dedup_keeps_the_first(spark):
    given = [(1, 0, 1.001, 2.0, "A", "x"), (1, 1, 1.004, 2.0, "B", " x "), (1, 2, 1.0, 2.0, None, "y"), (2, 3, 1.0, 2.0, None, "x")]
    assert sorted(r.seg_idx for r in timeline.dedup_segments(segments(spark, given)).collect()) == [0, 2, 3]


def test_empty_tables(spark):
    none, turns, recordings = segments(spark, []), spark.createDataFrame([], TURN), spark.createDataFrame([], RECORDING)
    for out in (timeline.merge_segments(none), timeline.fill_gaps(none, recordings), timeline.detect_gaps(none, recordings), timeline.fallback_words(none), speakers.assign_speakers(none, turns), speakers.speaker_stats(none), quality.timestamp_quality(none), document.full_transcript(none)):
        assert out.count() == 0


def test_normalize_timestamps_in_depth(spark):
    rows = spark.sql("SELECT 1 AS id, named_struct('start_time', 1.0, 'x', array(named_struct('end_time', 2.0))) AS s, map('k', named_struct('start_time', 3.0)) AS m")
    out = document.normalize_timestamps(rows)
    assert out.schema["s"].dataType.simpleString() == "struct<start:decimal(2,1),x:array<struct<end:decimal(2,1)>>>"
    assert out.schema["m"].dataType.valueType.names == ["start"]


def test_quarantine_leaves_out_rules_of_missing_columns(spark):
    out = quality.constraint_quarantine(spark.createDataFrame([(2.0, 1.0), (-1.0, 1.0)], "start_s double, end_s double")).collect()
    assert [(r.reasons, r.valid) for r in out] == [(["end_not_after_start"], False), (["start_negative"], False)]
    named = quality.constraint_quarantine(spark.createDataFrame([(2.0, None)], "start_s double, speaker string")).collect()
    assert named[0].reasons == ["no_speaker"]


def test_stand_in_words_are_those_of_whole_texts(spark, sf_dir):
    words = table(spark, sf_dir, "f_words")
    told = F.transform(F.array_sort(F.collect_list(F.struct("word_idx", "word"))), lambda x: x["word"])
    again = words.where("seg_idx % 4 <> 3").groupBy("recording_id", "seg_idx", "text").agg(F.array_join(told, " ").alias("again"))
    assert again.where("again = text").count() == table(spark, sf_dir, "f_seg").where("seg_idx % 4 <> 3").count()
    assert words.where("word_start < start_s or word_end > end_s or word_end <= word_start").isEmpty()
