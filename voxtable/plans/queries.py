"""The timeline operators as queries over the stand-in tables, each with its SQL."""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from voxtable.functions.numbers import decibel, rounded
from voxtable.operators import document, features, quality, signal, sketches, speakers, spectral, timeline
from voxtable.plans import audio_sql
from voxtable.plans.audio_sql import AUDIO
from voxtable.plans.standin import table, with_tables
from voxtable.sources import file_sink, files, media, wav
from voxtable.sources.shared import new_folder
from voxtable.streaming import endings, jobs, sinks

#: The stand-in blocks whose loudness is told: 64 samples at 256 Hz.
SMALL = signal.Framing(hop=64, rate=256, block=64)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, same_as: str | None = None) -> Callable:
    """Registers a function of the stand-in tables that its parameters name, under its own name; same_as is another whose SQL holds for it."""

    def add(function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        tables = function.__code__.co_varnames[: function.__code__.co_argcount]

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(*[table(spark, sf_dir, "f_" + t.rstrip("_")) for t in tables])

        QUERIES[function.__name__] = run
        if sql or same_as:
            SQL[function.__name__] = with_tables(sql) if sql else SQL[same_as]
        return function

    return add


def r(x: str, places: int) -> str:
    """rounded() as SQL."""
    scale = f"CAST({10**places} AS DOUBLE)"
    return f"(CAST(floor(({x}) * {scale} + 0.5) AS DOUBLE) / {scale})"


OVERLAP = """ov AS (
  SELECT s.recording_id, s.seg_idx, t.turn_idx, t.start_s AS turn_start, t.speaker AS turn_speaker,
         least(s.end_s, t.end_s) - greatest(s.start_s, t.start_s) AS overlap_s,
         CASE WHEN s.end_s - s.start_s > 0 THEN (least(s.end_s, t.end_s) - greatest(s.start_s, t.start_s)) / (s.end_s - s.start_s) ELSE 0.0 END AS ratio,
         least(CAST(1 AS DOUBLE), (t.end_s - t.start_s) / 2) AS confidence
  FROM f_seg s JOIN f_turn t ON s.recording_id = t.recording_id AND t.end_s > s.start_s AND t.start_s < s.end_s)"""
BEST = "best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY recording_id, seg_idx ORDER BY ratio DESC, overlap_s DESC, turn_start, turn_idx) AS n FROM ov) WHERE n = 1)"
NEAR = """near AS (SELECT * FROM (
  SELECT s.recording_id, s.seg_idx, t.turn_idx, abs((s.start_s + s.end_s) / 2 - (t.start_s + t.end_s) / 2) AS distance, coalesce(t.speaker, 'SPEAKER_00') AS nearest_speaker,
         row_number() OVER (PARTITION BY s.recording_id, s.seg_idx ORDER BY abs((s.start_s + s.end_s) / 2 - (t.start_s + t.end_s) / 2), t.start_s, t.turn_idx) AS n
  FROM f_seg s LEFT JOIN f_turn t ON s.recording_id = t.recording_id) WHERE n = 1)"""
GAPS = """nb AS (
  SELECT s.*, duration_s, lag(end_s) OVER w AS prev_end, lead(start_s) OVER w AS next_start
  FROM f_seg s LEFT JOIN f_rec USING (recording_id) WINDOW w AS (PARTITION BY s.recording_id ORDER BY start_s, seg_idx)),
gaps AS (
  SELECT recording_id, CASE WHEN prev_end IS NULL THEN 'beginning' ELSE 'between' END AS kind, coalesce(prev_end, 0.0) AS gap_start, start_s AS gap_end
  FROM nb WHERE start_s - coalesce(prev_end, 0.0) > 0.5
  UNION ALL SELECT recording_id, 'ending', end_s, duration_s FROM nb WHERE next_start IS NULL AND duration_s - end_s > 0.5)"""
FRAMES = """en AS (SELECT recording_id, block_idx AS frame_idx, list_sum(list_transform(x_raw, lambda v: CAST(v AS DOUBLE) * v)) * gain * gain AS e FROM f_block
  UNION ALL SELECT recording_id, max(block_idx) + 1, 0.0 FROM f_block GROUP BY recording_id),
frames AS (SELECT recording_id, frame_idx, sqrt(sum(e) OVER (PARTITION BY recording_id ORDER BY frame_idx ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) / 256) AS rms FROM en)"""
LEVEL = """lv AS (SELECT recording_id, 20.0 * log10(sqrt(sum(list_sum(list_transform(x_raw, lambda v: CAST(v AS DOUBLE) * v)) * gain * gain) / sum(len(x_raw))) + 1e-10) AS db FROM f_block GROUP BY recording_id)"""
JOIN_MERGE = """j AS (SELECT *, CASE WHEN row_number() OVER w > 1 AND coalesce(speaker IS NOT DISTINCT FROM lag(speaker) OVER w AND start_s - lag(end_s) OVER w < 0.5, false) THEN 0 ELSE 1 END AS new
  FROM {t} WINDOW w AS (PARTITION BY recording_id ORDER BY seg_idx)),
isl AS (SELECT *, sum(new) OVER (PARTITION BY recording_id ORDER BY seg_idx) AS island FROM j),
merged AS (SELECT recording_id, min(seg_idx) AS seg_idx, arg_min(start_s, seg_idx) AS start_s, arg_max(end_s, seg_idx) AS end_s, min(speaker) AS speaker,
  CASE WHEN count(*) = 1 THEN min(text) ELSE coalesce(string_agg(trim(text), ' ' ORDER BY seg_idx) FILTER (WHERE trim(text) <> ''), '') END AS text, count(*) AS n_merged FROM isl GROUP BY recording_id, island)"""


# --- timeline


@query(f"SELECT recording_id, seg_idx, start_s, end_s, speaker, text FROM (SELECT *, row_number() OVER (PARTITION BY recording_id, {r('start_s', 2)}, {r('end_s', 2)}, trim(text) ORDER BY seg_idx) AS n FROM f_segdup) WHERE n = 1")
def dedup_segments(segdup):
    return timeline.dedup_segments(segdup)


@query(f"WITH {GAPS} SELECT * FROM gaps")
def detect_gaps(seg, rec):
    return timeline.detect_gaps(seg, rec)


@query(f"WITH {JOIN_MERGE.format(t='f_seg')} SELECT * FROM merged")
def merge_segments(seg):
    return timeline.merge_segments(seg)


TAKES = """c AS (
  SELECT *, prev_end IS NULL AS is_first, next_start IS NULL AS is_last, start_s - coalesce(prev_end, 0.0) > 0.5 AS gb, coalesce(next_start, duration_s) - end_s > 0.5 AS ga,
    (prev_end + start_s) / 2 - prev_end <= start_s - (prev_end + start_s) / 2 AS b_earlier, (end_s + next_start) / 2 - end_s <= next_start - (end_s + next_start) / 2 AS a_earlier FROM nb),
t AS (SELECT *, gb AND (is_first OR NOT b_earlier) AS tb, coalesce(ga, false) AND (is_last OR a_earlier) AS ta FROM c)"""
#: dB of the samples of each row of g (recording_id, seg_idx, pos, x, y), from x to y seconds.
HEARD = """n AS (SELECT recording_id, CAST(sum(len(x_raw)) AS BIGINT) AS size FROM f_block GROUP BY 1),
sm AS (SELECT recording_id, block_idx * 64 + i - 1 AS p, CAST(x_raw[i] AS DOUBLE) * gain AS v FROM (SELECT *, unnest(range(1, 65)) AS i FROM f_block)),
sp AS (SELECT g.*, greatest(0, CAST(floor(x * 256) AS BIGINT)) AS a, least(size, CAST(floor(y * 256) AS BIGINT)) AS b FROM g JOIN n USING (recording_id)),
heard AS (SELECT sp.recording_id, seg_idx, pos, 20.0 * log10(sqrt(sum(v * v) / count(*)) + 1e-8) AS db FROM sp JOIN sm ON sp.recording_id = sm.recording_id AND p >= a AND p < b GROUP BY 1, 2, 3)"""


@query(f"""WITH {GAPS}, {TAKES}
SELECT recording_id, seg_idx, CASE WHEN tb THEN coalesce(prev_end, 0.0) ELSE start_s END AS start_s, CASE WHEN ta THEN coalesce(next_start, duration_s) ELSE end_s END AS end_s, speaker,
  CASE WHEN tb THEN '[SILENCE] ' ELSE '' END || text || CASE WHEN ta THEN ' [SILENCE]' ELSE '' END AS text, CAST(tb AS INT) + CAST(ta AS INT) AS n_silence,
  CASE WHEN tb THEN {r('start_s - coalesce(prev_end, 0.0)', 2)} ELSE 0 END + CASE WHEN ta THEN {r('coalesce(next_start, duration_s) - end_s', 2)} ELSE 0 END AS silence_s FROM t""")
def fill_gaps(seg, rec):
    total = F.aggregate("silence_words", F.lit(0.0), lambda a, w: a + w["duration"])
    return timeline.fill_gaps(seg, rec).select("recording_id", "seg_idx", "start_s", "end_s", "speaker", "text", F.size("silence_words").alias("n_silence"), total.alias("silence_s"))


def with_words(seg, words):
    """Segments with an array of their words that have both times, null where there are none."""
    own = words.where("word_start is not null and word_end is not null").groupBy("recording_id", "seg_idx").agg(F.array_sort(F.collect_list(F.struct(F.col("word_start").alias("start_time"), F.col("word_end").alias("end_time"), "word"))).alias("words"))
    return seg.join(own.hint("merge"), ["recording_id", "seg_idx"], "left")


@query(f"""WITH {GAPS}, {TAKES}, g AS (SELECT recording_id, seg_idx, 0 AS pos, coalesce(prev_end, 0.0) AS x, start_s AS y FROM t WHERE tb
  UNION ALL SELECT recording_id, seg_idx, 2, end_s, coalesce(next_start, duration_s) FROM t WHERE ta), {HEARD},
w AS (SELECT recording_id, seg_idx, pos, ' ' AS word, {r('x', 2)} AS start_time, {r('y', 2)} AS end_time, {r('coalesce(db, -60.0)', 1)} AS volume_db FROM g LEFT JOIN heard USING (recording_id, seg_idx, pos)
  UNION ALL SELECT recording_id, seg_idx, 1, word, word_start, word_end, NULL FROM f_words WHERE word_start IS NOT NULL AND word_end IS NOT NULL)
SELECT recording_id, seg_idx, row_number() OVER (PARTITION BY recording_id, seg_idx ORDER BY start_time, pos, end_time, word) - 1 AS place, word, start_time, end_time, volume_db FROM w""")
def filled_words(seg, words, rec, block):
    """The words of fill_gaps, silent ones with the volume of their gap among the others."""
    told = timeline.fill_gaps(with_words(seg, words), rec, block, SMALL).select("recording_id", "seg_idx", F.posexplode("words").alias("place", "w"))
    return told.select("recording_id", "seg_idx", F.col("place").cast("long").alias("place"), "w.word", "w.start_time", "w.end_time", "w.acoustic_features.volume_db")


@query(f"""WITH {JOIN_MERGE.format(t='f_seg')}, w AS (SELECT recording_id, island, seg_idx, word, word_start, word_end FROM isl JOIN (SELECT recording_id, seg_idx, word, word_start, word_end FROM f_words WHERE word_start IS NOT NULL AND word_end IS NOT NULL) USING (recording_id, seg_idx))
SELECT recording_id, first_idx AS seg_idx, row_number() OVER (PARTITION BY recording_id, island ORDER BY seg_idx, word_start, word_end, word) - 1 AS place, word, word_start AS start_time, word_end AS end_time
FROM w JOIN (SELECT recording_id, island, min(seg_idx) AS first_idx FROM isl GROUP BY 1, 2) USING (recording_id, island)""")
def merged_words(seg, words):
    """The words of merge_segments."""
    told = timeline.merge_segments(with_words(seg, words)).select("recording_id", "seg_idx", F.posexplode("words").alias("place", "w"))
    return told.select("recording_id", "seg_idx", F.col("place").cast("long").alias("place"), "w.word", "w.start_time", "w.end_time")


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY seg_idx) AS a, row_number() OVER (PARTITION BY recording_id ORDER BY seg_idx DESC) AS b FROM f_seg)
SELECT recording_id, seg_idx, start_s, end_s, a <= 3 AS is_first, b <= 3 AS is_last FROM n WHERE a <= 3 OR b <= 3""")
def segment_preview(seg):
    return timeline.segment_preview(seg)


@query(f"""WITH w AS (SELECT recording_id, seg_idx, start_s, regexp_split_to_array(trim(text), '\\s+') AS words, end_s - start_s AS dur FROM f_seg WHERE trim(text) <> '' AND end_s > start_s),
e AS (SELECT recording_id, seg_idx, start_s, dur / len(words) AS each, words, unnest(range(len(words))) AS word_idx FROM w)
SELECT recording_id, seg_idx, word_idx, words[word_idx + 1] AS word, {r('start_s + word_idx * each', 2)} AS start_time, {r('start_s + word_idx * each + each', 2)} AS end_time,
  {r('start_s + word_idx * each + each - (start_s + word_idx * each)', 2)} AS duration, CAST(-25 AS DOUBLE) AS volume_db, CAST(150 AS DOUBLE) AS pitch_hz, CAST(1500 AS DOUBLE) AS spectral_centroid FROM e""")
def fallback_words(seg):
    return timeline.fallback_words(seg)


@query(f"""WITH w AS (SELECT recording_id, seg_idx, start_s, regexp_split_to_array(trim(text), '\\s+') AS words, end_s - start_s AS dur FROM f_seg WHERE trim(text) <> '' AND end_s > start_s),
e AS (SELECT recording_id, seg_idx, start_s, dur / len(words) AS each, words, unnest(range(len(words))) AS pos FROM w),
g AS (SELECT recording_id, seg_idx, pos, words[pos + 1] AS word, start_s + pos * each AS x, start_s + pos * each + each AS y FROM e), {HEARD}
SELECT recording_id, seg_idx, pos AS word_idx, word, {r('coalesce(db, -30.0)', 1)} AS volume_db FROM g LEFT JOIN heard USING (recording_id, seg_idx, pos)""")
def measured_fallback_words(seg, block):
    """The words of fallback_words, each with the volume of its own samples."""
    return timeline.fallback_words(seg, blocks=block, framing=SMALL).select("recording_id", "seg_idx", "word_idx", "word", "volume_db")


@query("SELECT recording_id, seg_idx, word, word_start AS start_time, word_end AS end_time, coalesce(speaker, 'SPEAKER_00') AS speaker_id, CAST(0.95 AS DOUBLE) AS confidence FROM f_words WHERE word_start IS NOT NULL AND word_end IS NOT NULL")
def word_segments(words):
    return timeline.word_segments(words)


@query("""SELECT recording_id, seg_idx, max(CASE WHEN trim(coalesce(word, '')) <> '' THEN 1 ELSE 0 END) > 0 AS has_speech_words,
  trim(text) <> '' AND NOT max(CASE WHEN trim(coalesce(word, '')) <> '' THEN 1 ELSE 0 END) > 0 AS needs_fallback FROM f_words GROUP BY recording_id, seg_idx, text""")
def needs_fallback_words(words):
    return timeline.needs_fallback_words(words)


@query(f"""WITH {GAPS}, c AS (SELECT *, CASE WHEN gap_end - gap_start > 2.0 THEN greatest(1, CAST(floor(gap_end - gap_start) AS BIGINT)) ELSE 1 END AS parts FROM gaps),
e AS (SELECT *, (gap_end - gap_start) / parts AS each, unnest(range(parts)) AS chunk FROM c)
SELECT recording_id, kind, gap_start, chunk, {r('gap_start + chunk * each', 2)} AS start_time, {r('gap_start + chunk * each + each', 2)} AS end_time, 'SILENCE' AS speaker FROM e""")
def silence_chunks(seg, rec):
    return timeline.silence_chunks(timeline.detect_gaps(seg, rec))


@query("""WITH c AS (SELECT *, unnest(range(CAST(floor(start_s / 30) AS BIGINT), greatest(CAST(floor(start_s / 30) AS BIGINT), CAST(ceil(end_s / 30) AS BIGINT) - 1) + 1)) AS chunk FROM f_seg WHERE end_s >= start_s)
SELECT recording_id, chunk, sum(least(end_s, (chunk + 1) * CAST(30 AS DOUBLE)) - greatest(start_s, chunk * CAST(30 AS DOUBLE))) AS speech_s, count(*) AS n_segments FROM c GROUP BY recording_id, chunk""")
def timeline_chunks(seg):
    return timeline.timeline_chunks(seg)


@query("""WITH l AS (SELECT s.recording_id, s.seg_idx, start_s, end_s, confidence FROM f_seg s JOIN f_label USING (recording_id, seg_idx) WHERE confidence >= 0.5 AND end_s > start_s),
c AS (SELECT *, unnest(range(CAST(ceil((end_s - start_s) / 2) AS BIGINT))) AS part FROM l),
o AS (SELECT recording_id, seg_idx, part, start_s + part * CAST(2 AS DOUBLE) AS start_s, least(end_s, start_s + part * CAST(2 AS DOUBLE) + 2) AS end_s, confidence FROM c)
SELECT * FROM o WHERE end_s - start_s >= 0.5""")
def resegment(seg, label):
    return timeline.resegment(seg.join(label.select("recording_id", "seg_idx", "confidence"), ["recording_id", "seg_idx"]))


# --- speakers


@query(f"WITH {OVERLAP} SELECT * FROM ov")
def interval_overlap(seg, turn):
    return speakers.interval_overlap(seg, turn)


@query(f"WITH {OVERLAP}, {BEST} SELECT * EXCLUDE (n) FROM best")
def best_overlap(seg, turn):
    return speakers.best_overlap(speakers.interval_overlap(seg, turn))


@query(f"WITH {NEAR} SELECT * EXCLUDE (n) FROM near")
def nearest_turn(seg, turn):
    return speakers.nearest_turn(seg, turn)


ASSIGNED = f"""{OVERLAP}, {BEST}, {NEAR}, asg AS (
  SELECT s.*, CASE WHEN b.ratio > 0.1 THEN b.turn_speaker ELSE n.nearest_speaker END AS assigned_speaker,
         CASE WHEN b.ratio > 0.1 THEN b.confidence WHEN b.ratio IS NOT NULL THEN 0.3 ELSE 0.2 END AS speaker_confidence
  FROM f_seg s LEFT JOIN best b USING (recording_id, seg_idx) LEFT JOIN near n USING (recording_id, seg_idx))"""


@query(f"WITH {ASSIGNED} SELECT recording_id, seg_idx, start_s, end_s, speaker, text, assigned_speaker, CAST(speaker_confidence AS DOUBLE) AS speaker_confidence FROM asg")
def assign_speakers(seg, turn):
    return speakers.assign_speakers(seg, turn)


@query(f"""WITH {OVERLAP}, t AS (SELECT recording_id, seg_idx, turn_speaker, sum(overlap_s) AS overlap_s FROM ov GROUP BY ALL),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY recording_id, seg_idx ORDER BY overlap_s DESC, turn_speaker) AS n FROM t) WHERE n = 1)
SELECT s.recording_id, s.seg_idx, b.turn_speaker AS speaker, b.overlap_s FROM f_seg s LEFT JOIN b USING (recording_id, seg_idx)""")
def assign_word_speakers(seg, turn):
    return speakers.assign_word_speakers(seg, turn)


@query(f"""WITH w AS (
  SELECT recording_id, struct_pack(seg_idx := seg_idx, word_idx := word_idx) AS seg_idx, word_start AS start_s, word_end AS end_s
  FROM f_words WHERE word_start IS NOT NULL AND word_end IS NOT NULL),
{OVERLAP.replace("f_seg s", "w s")}, t AS (SELECT recording_id, seg_idx, turn_speaker, sum(overlap_s) AS overlap_s FROM ov GROUP BY ALL),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY recording_id, seg_idx ORDER BY overlap_s DESC, turn_speaker) AS n FROM t) WHERE n = 1)
SELECT s.recording_id, s.seg_idx.seg_idx AS seg_idx, s.seg_idx.word_idx AS word_idx, b.turn_speaker AS speaker, b.overlap_s
FROM w s LEFT JOIN b ON s.recording_id = b.recording_id AND s.seg_idx = b.seg_idx""")
def word_speakers(words, turn):
    """The speaker of each word by its own times."""
    own = words.where("word_start is not null and word_end is not null")
    own = own.select("recording_id", F.struct("seg_idx", "word_idx").alias("seg_idx"), F.col("word_start").alias("start_s"), F.col("word_end").alias("end_s"))
    return speakers.assign_word_speakers(own, turn).select("recording_id", "seg_idx.seg_idx", "seg_idx.word_idx", "speaker", "overlap_s")


@query("SELECT recording_id, coalesce(speaker, 'SPEAKER_00') AS speaker, sum(end_s - start_s) AS total_duration, count(*) AS segment_count FROM f_seg GROUP BY 1, 2")
def speaker_stats(seg):
    return speakers.speaker_stats(seg)


@query("SELECT recording_id, count(DISTINCT CASE WHEN speaker <> '' THEN speaker END) AS named_speakers, count(DISTINCT coalesce(speaker, 'SPEAKER_00')) AS all_speakers FROM f_seg GROUP BY recording_id")
def unique_speakers(seg):
    return speakers.unique_speakers(seg)


@query("""SELECT CAST(recording_id % 2 AS BIGINT) AS part, count(DISTINCT concat(CAST(recording_id AS VARCHAR(20)), '/', speaker)) AS exact_speakers, count(*) AS n_rows, true AS count_within, true AS rank_within
FROM f_seg WHERE speaker IS NOT NULL GROUP BY 1""")
def corpus_sketches(seg):
    """Speakers of recordings, and the 20th percentile of durations, from sketches kept by day and merged; whether both lie within four standard errors of the exact ones."""
    folder = new_folder(seg.sparkSession, "sketches")
    length, who = F.col("end_s") - F.col("start_s"), F.concat_ws("/", F.col("recording_id").cast("string"), "speaker")
    rows = seg.where("speaker is not null").select(F.pmod("recording_id", F.lit(2)).alias("part"), F.pmod("seg_idx", F.lit(3)).alias("d"), who.alias("who"), length.alias("length"))
    of = lambda d: sketches.sketched(rows.where(F.col("d") == d), ["part"], {"speakers": F.col("who")}, {"lengths": F.col("length")})
    for d in range(3):
        sketches.write_day(of(d), folder, f"2024-05-0{d + 1}")
    kept = sketches.merged(sketches.read_days(of(0), folder), ["part"], ["speakers"], ["lengths"])
    told = kept.select("part", "n_rows", sketches.distinct_count("speakers").alias("speakers"), sketches.percentile("lengths", 0.2).alias("p20"))
    exact = rows.groupBy("part").agg(F.countDistinct("who").alias("exact_speakers"))
    ranks = rows.join(F.broadcast(told.select("part", "p20")), "part").groupBy("part").agg(F.avg((F.col("length") < F.col("p20")).cast("double")).alias("below"), F.avg((F.col("length") <= F.col("p20")).cast("double")).alias("upto"))  # two rows
    met = told.join(exact.hint("merge"), "part").join(ranks.hint("merge"), "part")
    near = F.abs(F.col("speakers") - F.col("exact_speakers")) <= 4 * sketches.COUNT_ERROR * F.col("exact_speakers") + 1
    inside = (F.col("below") <= 0.2 + 4 * sketches.RANK_ERROR) & (F.col("upto") >= 0.2 - 4 * sketches.RANK_ERROR)
    return met.select("part", "exact_speakers", "n_rows", near.alias("count_within"), inside.alias("rank_within"))


@query("SELECT coalesce(speaker, 'SPEAKER_00') AS speaker, count(*) AS n_segments FROM f_seg GROUP BY 1")
def speaker_histogram(seg):
    return speakers.speaker_histogram(seg)


@query("""WITH c AS (SELECT recording_id, speaker, emotion, count(*) AS n, sum(confidence) AS c FROM f_label GROUP BY ALL)
SELECT recording_id, speaker, CAST(sum(n) AS BIGINT) AS n_segments, sum(c) / sum(n) AS avg_confidence, string_agg(emotion, ',' ORDER BY emotion) AS emotions, first(emotion ORDER BY n DESC, emotion) AS dominant_emotion FROM c GROUP BY recording_id, speaker""")
def speaker_rollup(label):
    return speakers.speaker_rollup(label)


# --- the whole chain


@query(f"""WITH {ASSIGNED}, src AS (SELECT recording_id, seg_idx, start_s, end_s, assigned_speaker AS speaker, text FROM asg), {JOIN_MERGE.format(t='src')},
dd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY recording_id, {r('start_s', 2)}, {r('end_s', 2)}, trim(text) ORDER BY seg_idx) AS n FROM merged) WHERE n = 1),
nb AS (SELECT d.*, duration_s, lag(end_s) OVER w AS prev_end, lead(start_s) OVER w AS next_start FROM dd d LEFT JOIN f_rec USING (recording_id) WINDOW w AS (PARTITION BY d.recording_id ORDER BY start_s, seg_idx)),
t AS (SELECT *, start_s - coalesce(prev_end, 0.0) > 0.5 AND (prev_end IS NULL OR NOT (prev_end + start_s) / 2 - prev_end <= start_s - (prev_end + start_s) / 2) AS tb,
  coalesce(coalesce(next_start, duration_s) - end_s > 0.5, false) AND (next_start IS NULL OR (end_s + next_start) / 2 - end_s <= next_start - (end_s + next_start) / 2) AS ta FROM nb),
f AS (SELECT recording_id, speaker, CASE WHEN tb THEN coalesce(prev_end, 0.0) ELSE start_s END AS a, CASE WHEN ta THEN coalesce(next_start, duration_s) ELSE end_s END AS b FROM t)
SELECT recording_id, coalesce(speaker, 'SPEAKER_00') AS speaker, sum(b - a) AS total_duration, count(*) AS segment_count FROM f GROUP BY 1, 2""")
def talk_time(seg, turn, rec):
    told = speakers.assign_speakers(seg, turn).select("recording_id", "seg_idx", "start_s", "end_s", F.col("assigned_speaker").alias("speaker"), "text")
    return speakers.speaker_stats(timeline.fill_gaps(timeline.dedup_segments(timeline.merge_segments(told)), rec))


# --- signal


@query(f"WITH {FRAMES} SELECT recording_id, frame_idx, {r('rms', 6)} AS rms FROM frames")
def frame_rms(block):
    return signal.frame_rms(block, SMALL).withColumn("rms", rounded("rms", 6))


@query(f"WITH {FRAMES} SELECT recording_id, {r('stddev_pop(rms) / (avg(rms) + 1e-10)', 6)} AS energy_variation FROM frames GROUP BY recording_id")
def energy_variation(block):
    return signal.energy_variation(signal.frame_rms(block, SMALL)).withColumn("energy_variation", rounded("energy_variation", 6))


@query(f"WITH {FRAMES}, l AS (SELECT recording_id, quantile_cont(rms, 0.2) AS lim FROM frames GROUP BY 1) SELECT recording_id, avg(CASE WHEN rms < lim THEN 1.0::DOUBLE ELSE 0.0 END) AS silence_ratio FROM frames JOIN l USING (recording_id) GROUP BY recording_id")
def silence_ratio(block):
    return signal.silence_ratio(signal.frame_rms(block, SMALL))


@query("SELECT recording_id, max(list_max(list_transform(x_raw, lambda v: abs(CAST(v AS DOUBLE)))) * gain) AS amplitude_max FROM f_block GROUP BY recording_id")
def peak_amplitude(block):
    return signal.peak_amplitude(block)


@query(f"WITH {LEVEL} SELECT recording_id, {r('db', 3)} AS rms_db, CASE WHEN db < -35 THEN 'low' WHEN db < -25 THEN 'medium' WHEN db < -15 THEN 'high' ELSE 'emphasis' END AS volume_category FROM lv")
def volume_category(block):
    told = signal.recording_rms(block).withColumn("db", decibel(F.col("rms"), 1e-10))
    return told.select("recording_id", rounded("db", 3).alias("rms_db"), signal.volume_category(F.col("db")).alias("volume_category"))


@query(f"WITH {LEVEL} SELECT recording_id, {r('exp(db / 20) * 1e-5 * 1e6', 3)} AS rms_energy_millionths, CAST(10 AS DOUBLE) AS pitch_std FROM lv")
def derived_acoustics(block):
    energy, std = signal.derived(decibel(F.col("rms"), 1e-10), F.lit(100.0))
    return signal.recording_rms(block).select("recording_id", rounded(energy * 1e6, 3).alias("rms_energy_millionths"), std.alias("pitch_std"))


@query(f"""WITH {FRAMES}, n AS (SELECT *, greatest(1, count(*) OVER (PARTITION BY recording_id) // 10) AS step FROM frames),
p AS (SELECT recording_id, frame_idx, rms FROM n WHERE frame_idx % step = 0 AND frame_idx // step < 10)
SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY frame_idx) - 1 AS place, {r('rms', 3)} AS peak FROM p""")
def volume_peaks(block):
    told = signal.volume_peaks(signal.frame_rms(block, SMALL)).select("recording_id", F.posexplode("volume_peaks").alias("place", "peak"))
    return told.withColumn("place", F.col("place").cast("long"))


@query(f"""WITH n AS (SELECT recording_id, CAST(sum(len(x_raw)) AS BIGINT) AS size FROM f_block GROUP BY 1),
sp AS (SELECT s.recording_id, s.seg_idx, greatest(0, CAST(floor(start_s * 256) AS BIGINT)) AS a, least(size, CAST(floor(end_s * 256) AS BIGINT)) AS b FROM f_seg s JOIN n USING (recording_id)),
sm AS (SELECT recording_id, block_idx * 64 + i - 1 AS p, CAST(x_raw[i] AS DOUBLE) * gain AS x FROM (SELECT *, unnest(range(1, 65)) AS i FROM f_block)),
e AS (SELECT sp.recording_id, sp.seg_idx, sqrt(sum(x * x) / count(*)) AS rms, count(*) AS n FROM sp JOIN sm ON sp.recording_id = sm.recording_id AND p >= a AND p < b GROUP BY 1, 2)
SELECT s.recording_id, s.seg_idx, coalesce(n, 0) AS n_samples, {r('rms', 6)} AS rms, {r('CASE WHEN rms IS NULL THEN -30.0 ELSE 20.0 * log10(rms + 1e-8) END', 3)} AS volume_db FROM f_seg s LEFT JOIN e USING (recording_id, seg_idx)""")
def interval_rms(seg, block):
    return signal.interval_rms(seg, block, framing=SMALL).withColumns({"rms": rounded("rms", 6), "volume_db": rounded("volume_db", 3)})


@query(f"""WITH p AS (SELECT recording_id, max(list_max(list_transform(x_raw, lambda v: abs(CAST(v AS DOUBLE)))) * gain) AS top FROM f_block GROUP BY 1)
SELECT recording_id, block_idx, {r('list_max(list_transform(x_raw, lambda v: abs(CAST(v AS DOUBLE)))) * gain / top', 6)} AS peak FROM f_block JOIN p USING (recording_id)""")
def normalize_audio(block):
    return signal.normalize_audio(block).select("recording_id", "block_idx", rounded(F.array_max(F.transform("x", F.abs)), 6).alias("peak"))


@query(f"""WITH {FRAMES}, t AS (SELECT *, max(rms) OVER (PARTITION BY recording_id) AS top FROM frames)
SELECT recording_id, min(frame_idx) AS first_frame, max(frame_idx) AS last_frame, min(frame_idx) * 64 AS start_sample, (max(frame_idx) + 1) * 64 AS end_sample FROM t WHERE 20.0 * log10(rms + 1e-10) > 20.0 * log10(top + 1e-10) - 10 GROUP BY recording_id""")
def trim_silence(block):
    return signal.trim_silence(signal.frame_rms(block, SMALL), framing=SMALL)


OF_RECORDINGS, FEATURES = audio_sql.measures(audio_sql.RECORDINGS), audio_sql.features(r)


@query(f"{OF_RECORDINGS} SELECT recording_id, {r('centroid', 4)} AS spectral_centroid FROM me")
def spectral_centroid(audio):
    return spectral.spectral_centroid(audio, AUDIO).withColumn("spectral_centroid", rounded("spectral_centroid", 4))


@query(f"{OF_RECORDINGS} SELECT recording_id, {r('pitch', 4)} AS pitch_hz, n_voiced FROM me")
def median_pitch(audio):
    return spectral.median_pitch(audio, AUDIO).withColumn("pitch_hz", rounded("pitch_hz", 4))


@query(f"{OF_RECORDINGS} SELECT recording_id, t AS frame_idx, {r('strength', 4)} AS strength FROM env")
def onset_envelope(audio):
    return spectral.onset_envelope(audio, AUDIO).withColumn("strength", rounded("strength", 4))


@query(f"{OF_RECORDINGS}, ot AS (SELECT recording_id, string_agg(t, ',' ORDER BY t) AS peaks FROM ons GROUP BY 1) SELECT recording_id, n_frames, coalesce(peaks, '') AS peaks FROM me LEFT JOIN ot USING (recording_id)")
def onset_peaks(audio):
    return spectral.onset_peaks(audio, AUDIO).select("recording_id", "n_frames", F.array_join(F.transform("peaks", lambda p: p.cast("string")), ",").alias("peaks"))


@query(f"{OF_RECORDINGS} SELECT recording_id, n_peaks, {r('rate', 6)} AS speaking_rate FROM me")
def speaking_rate(audio):
    told = spectral.speaking_rate(spectral.onset_peaks(audio, AUDIO), AUDIO)
    return told.withColumn("speaking_rate", rounded("speaking_rate", 6))


@query(f"{FEATURES} SELECT *, CAST(12 AS DOUBLE) AS mfcc_1, CAST(-8 AS DOUBLE) AS mfcc_2, CAST(4 AS DOUBLE) AS mfcc_3 FROM feat")
def segment_features(seg, audio):
    """Lists as columns, one for each of their places."""
    told = features.segment_features(audio, seg, AUDIO)
    points = [F.get("volume_peaks", F.lit(i)).alias(f"peak_{i}") for i in range(spectral.POINTS)]
    return told.select("*", *points, *[F.get("mfcc", F.lit(i)).alias(f"mfcc_{i + 1}") for i in range(3)]).drop("mfcc", "volume_peaks")


@query(f"{FEATURES} SELECT recording_id, seg_idx, {', '.join(features.FAILED)}, failed FROM feat")
def batch_features(seg, audio):
    return features.batch_features(seg, features.segment_features(audio, seg, AUDIO))


API = "rms_db AS volume_db, pitch_mean AS pitch_hz, spectral_centroid, zcr AS zero_crossing_rate, pitch_mean, CAST(10 AS DOUBLE) AS pitch_std"


@query(f"{FEATURES} SELECT recording_id, seg_idx, {API}, CAST(12 AS DOUBLE) AS mfcc_1, CAST(-8 AS DOUBLE) AS mfcc_2, CAST(4 AS DOUBLE) AS mfcc_3 FROM feat")
def acoustic_api_shape(seg, audio):
    told = features.api_shape(features.segment_features(audio, seg, AUDIO))
    return told.select("*", *[F.get("mfcc_mean", F.lit(i)).alias(f"mfcc_{i + 1}") for i in range(3)]).drop("mfcc_mean")


@query(f"""WITH {LEVEL} SELECT s.recording_id, s.seg_idx, {r('coalesce(db, -20.0)', 3)} AS volume_db, CAST(150 AS DOUBLE) AS pitch_hz, CAST(1500 AS DOUBLE) AS spectral_centroid, CAST(0.1 AS DOUBLE) AS zero_crossing_rate, CAST(150 AS DOUBLE) AS pitch_mean, CAST(20 AS DOUBLE) AS pitch_std
FROM f_seg s LEFT JOIN lv USING (recording_id)""")
def acoustic_defaults(seg, block):
    known = signal.recording_rms(block).select("recording_id", decibel(F.col("rms"), 1e-10).alias("volume_db"), *[F.lit(None).cast("double").alias(k) for k in features.MISSING if k != "volume_db"])
    return features.attach_features(seg.select("recording_id", "seg_idx"), known).withColumn("volume_db", rounded("volume_db", 3))


@query(f"{FEATURES} SELECT s.*, {API} FROM f_seg s JOIN feat USING (recording_id, seg_idx)")
def attach_features(seg, audio):
    return features.attach_features(seg, features.api_shape(features.segment_features(audio, seg, AUDIO)))


# --- quality


@query("SELECT recording_id, bool_or(word IS NOT NULL AND word_start IS NOT NULL) AS any_words, count(*) FILTER (WHERE word IS NOT NULL AND word_start IS NOT NULL) AS n_words FROM f_words GROUP BY recording_id")
def alignment_coverage(words):
    return quality.alignment_coverage(words)


@query("SELECT recording_id, count(*) AS n_total, count(*) FILTER (WHERE start_s = 0 AND end_s = 0) AS n_zero, count(*) FILTER (WHERE start_s < end_s) AS n_valid FROM f_seg GROUP BY recording_id")
def timestamp_quality(seg):
    return quality.timestamp_quality(seg)


CHECKED = """c AS (
  SELECT s.recording_id, s.seg_idx, list_filter([CASE WHEN start_s - 2 < 0 THEN 'start_negative' END, CASE WHEN end_s - 1.5 <= start_s THEN 'end_not_after_start' END,
    CASE WHEN confidence * 1.25 < 0 OR confidence * 1.25 > 1 THEN 'confidence_range' END, CASE WHEN s.speaker IS NULL THEN 'no_speaker' END,
    CASE WHEN length(text) % 2 = 1 AND text <> 'speaker_s start' THEN 'odd_text' END], lambda x: x IS NOT NULL) AS reasons
  FROM f_seg s JOIN f_label l USING (recording_id, seg_idx))"""


def to_check(seg, label):
    """Times are moved and confidence is scaled so that every rule meets rows that break it; one rule has a function and words in quotes."""
    moved = {"end_s": F.col("end_s") - 3.5, "start_s": F.col("start_s") - 2, "confidence": F.col("confidence") * 1.25}
    rows = seg.join(label.select("recording_id", "seg_idx", "confidence"), ["recording_id", "seg_idx"]).withColumns(moved)
    return quality.constraint_quarantine(rows, quality.RULES | {"odd_text": "length(text) % 2 = 1 AND text <> 'speaker_s start'"})


@query(f"WITH {CHECKED} SELECT recording_id, seg_idx, array_to_string(reasons, ',') AS reasons, len(reasons) = 0 AS valid, 'amplitude_range' AS unchecked FROM c")
def constraint_quarantine(seg, label):
    told = to_check(seg, label)
    return told.select("recording_id", "seg_idx", F.array_join("reasons", ",").alias("reasons"), "valid", F.array_join("unchecked", ",").alias("unchecked"))


@query(f"WITH {CHECKED} SELECT recording_id, seg_idx, coalesce(reasons[1], '') AS reason, CASE WHEN len(reasons) > 0 THEN len(reasons) END AS n_reasons FROM c")
def quarantine_table(seg, label):
    """The accepted rows, and the rejected ones read back from their table."""
    folder = new_folder(seg.sparkSession, "quarantine")
    accepted = quality.write_quarantine(to_check(seg, label), folder)
    kept = accepted.select("recording_id", "seg_idx", F.lit("").alias("reason"), F.lit(None).cast("long").alias("n_reasons"))
    bad = seg.sparkSession.read.parquet(folder).select("recording_id", "seg_idx", "reason", F.size("reasons").cast("long").alias("n_reasons"))
    return kept.unionByName(bad)


@query("SELECT r.recording_id, duration_s, last_end, coalesce(last_end <= duration_s + 1, true) AS consistent FROM f_rec r LEFT JOIN (SELECT recording_id, max(end_s) AS last_end FROM f_seg GROUP BY 1) USING (recording_id)")
def timeline_consistency(seg, rec):
    return quality.timeline_consistency(seg, rec)


@query("SELECT recording_id, greatest(duration_s, CAST(0.1 AS DOUBLE)) AS duration_s, 'no segments' AS error FROM f_rec WHERE recording_id NOT IN (SELECT recording_id FROM f_seg)")
def empty_recordings(rec, seg):
    return quality.empty_recordings(rec, seg)


@query("SELECT event_id, CASE WHEN contains(lower(error_message), 'download') THEN 'DOWNLOAD_ERROR' ELSE 'PROCESSING_ERROR' END AS error_code FROM f_progress WHERE status = 'failed'")
def error_codes(progress):
    return progress.where("status = 'failed'").select("event_id", quality.error_code(F.col("error_message")).alias("error_code"))


@query(f"""WITH x AS (SELECT s.recording_id, s.seg_idx, {r('coalesce(start_s, 0.0)', 1)} AS start_time, {r('coalesce(end_s, 0.0)', 1)} AS end_time, {r('coalesce(confidence, 0.0)', 1)} AS confidence FROM f_seg s JOIN f_label USING (recording_id, seg_idx))
SELECT *, {r('end_time - start_time', 1)} AS duration FROM x""")
def rounding_contract(seg, label):
    return quality.rounding_contract(seg.join(label.select("recording_id", "seg_idx", "confidence"), ["recording_id", "seg_idx"]))


def numbers(names: tuple[str, ...], value: str, places: int) -> str:
    """SQL columns under names: value, in which {i} is the number of the column, to so many places and 0 where it is null."""
    return ", ".join(f"{r(f'coalesce({value.format(i=i)}, CAST(0 AS DOUBLE))', places)} AS {n}" for i, n in enumerate(names))


@query(f"""WITH e AS (SELECT *, unnest(range(CASE WHEN vec_id % 4 = 0 THEN 1 ELSE len(x_raw) END)) AS place FROM f_block)
SELECT vec_id, {numbers(quality.FEATURES, "CASE WHEN (vec_id + {i}) % 5 <> 0 THEN CAST(x_raw[{i} + 1] AS DOUBLE) * gain END", 3)},
  {numbers(("mfcc_1", "mfcc_2", "mfcc_3"), "CASE WHEN vec_id % 3 <> 0 THEN CAST(x_raw[{i} + 1] AS DOUBLE) END", 1)},
  CASE WHEN vec_id % 4 <> 0 THEN place END AS place, CASE WHEN vec_id % 4 <> 0 THEN {r("CAST(x_raw[place + 1] AS DOUBLE)", 3)} END AS peak FROM e""")
def feature_contract(block):
    """Features read off the samples of blocks, of which each is missing at times."""
    x, n = F.transform("x_raw", lambda v: v.cast("double")), F.col("vec_id")
    given = [F.when((n + i) % 5 != 0, F.get(x, F.lit(i)) * F.col("gain")).alias(k) for i, k in enumerate(quality.FEATURES)]
    told = quality.feature_contract(block.select("vec_id", *given, F.when(n % 3 != 0, x).alias("mfcc"), F.when(n % 4 != 0, x).alias("volume_peaks")))
    mfcc = [F.get("mfcc", F.lit(i)).alias(f"mfcc_{i + 1}") for i in range(3)]
    out = told.select("vec_id", *quality.FEATURES, *mfcc, F.posexplode_outer("volume_peaks").alias("place", "peak"))
    return out.withColumn("place", F.col("place").cast("long"))


@query(f"""SELECT event_id, {numbers(("gpu_utilization",), "CASE WHEN event_id % 5 <> 0 THEN CAST(progress AS DOUBLE) / 101 END", 2)},
  {numbers(("avg_processing_fps",), "CASE WHEN event_id % 7 <> 0 THEN CAST(event_id AS DOUBLE) / 13 END", 2)} FROM f_progress""")
def performance_contract(progress):
    n = F.col("event_id")
    rows = progress.select("event_id", F.when(n % 5 != 0, F.col("progress").cast("double") / 101).alias("gpu_utilization"), F.when(n % 7 != 0, n.cast("double") / 13).alias("avg_processing_fps"))
    return quality.performance_contract(rows)


# --- documents


@query("SELECT recording_id, seg_idx, CASE WHEN seg_idx % 3 = 2 THEN 0.0 ELSE start_s END AS start_s, CASE WHEN seg_idx % 5 = 4 THEN 0.0 ELSE end_s END AS end_s, speaker, text FROM f_seg")
def ingest_segments(seg):
    """Rows with either spelling of the times, and some without."""
    n = F.col("seg_idx")
    rows = seg.select("recording_id", "seg_idx", F.when(n % 3 == 0, F.col("start_s")).alias("start"), F.when(n % 3 == 1, F.col("start_s")).alias("start_time"), F.when(n % 2 == 0, F.when(n % 5 != 4, F.col("end_s"))).alias("end"), F.when(n % 5 != 4, F.col("end_s")).alias("end_time"), "speaker", "text")
    return document.ingest_segments(rows)


@query("SELECT recording_id, seg_idx, start_s AS start_time, end_s AS end_time, greatest(end_s - start_s, 0.0) AS duration, coalesce(speaker, 'SPEAKER_00') AS speaker_id, trim(coalesce(text, '')) AS text FROM f_seg")
def segment_projection(seg):
    return document.segment_projection(seg)


@query("""SELECT recording_id, seg_idx, coalesce(word, '') AS word, coalesce(word_start, 0.0) AS start_time, coalesce(word_end, 0.0) AS end_time, greatest(coalesce(word_end, 0.0) - coalesce(word_start, 0.0), 0.0) AS duration,
  CAST(-20 AS DOUBLE) AS volume_db, CAST(150 AS DOUBLE) AS pitch_hz, CAST(1500 AS DOUBLE) AS spectral_centroid FROM f_words""")
def word_projection(words):
    return document.word_projection(words)


@query("SELECT recording_id AS recording_id, start_s AS start, end_s AS \"end\", start_s AS w_start, end_s AS w_end FROM f_seg")
def normalize_timestamps(seg):
    """Times under start_time and end_time, at the top and inside an array of structs."""
    rows = seg.select("recording_id", F.col("start_s").alias("start_time"), F.col("end_s").alias("end_time"), F.array(F.struct(F.struct(F.col("start_s").alias("start_time"), F.col("end_s").alias("end_time")).alias("t"))).alias("words"))
    return document.normalize_timestamps(rows).select("recording_id", "start", "end", F.col("words")[0]["t"]["start"].alias("w_start"), F.col("words")[0]["t"]["end"].alias("w_end"))


@query("SELECT recording_id, string_agg(coalesce(text, ''), ' ' ORDER BY seg_idx) AS text, count(*) AS n_segments FROM f_seg GROUP BY recording_id")
def full_transcript(seg):
    return document.full_transcript(seg)


@query("""SELECT r.recording_id, r.duration_s, sample_rate, coalesce(n, 0) AS total_segments, coalesce(u, 0) AS unique_speakers, processing_s
FROM f_rec r LEFT JOIN (SELECT recording_id, count(*) AS n, count(DISTINCT coalesce(speaker, 'SPEAKER_00')) AS u FROM f_seg GROUP BY 1) USING (recording_id) LEFT JOIN f_run USING (recording_id)""")
def recording_metadata(rec, seg, run):
    return document.recording_metadata(rec, seg, run)


@query(f"""SELECT r.recording_id, {r("coalesce(r.duration_s, 0.0)", 1)} AS duration_s, sample_rate, coalesce(n, 0) AS total_segments, coalesce(u, 0) AS unique_speakers, {r("coalesce(processing_s, 0.0)", 1)} AS processing_s,
  requested AS language_requested, coalesce(detected, requested) AS language_detected, CASE WHEN requested <> 'auto' THEN 'targeted' ELSE 'auto-detect' END AS processing_mode
FROM f_rec r LEFT JOIN (SELECT recording_id, count(*) AS n, count(DISTINCT coalesce(speaker, 'SPEAKER_00')) AS u FROM f_seg GROUP BY 1) USING (recording_id) LEFT JOIN f_run USING (recording_id) LEFT JOIN f_spoken USING (recording_id)""")
def result_metadata(rec, seg, run, spoken):
    """recording_metadata with languages, under the rounding contract."""
    return quality.metadata_contract(document.recording_metadata(rec, seg, run, spoken))


@query("""SELECT recording_id, duration_s, CASE WHEN recording_id % 3 = 1 THEN 'extra' ELSE 'base' END AS note, CASE WHEN recording_id % 3 <> 2 THEN 'auto' END AS mode,
  CASE WHEN recording_id % 3 = 1 THEN processing_s END AS processing_s, CASE WHEN recording_id % 3 = 2 THEN 'b' END AS tag, CAST(CASE WHEN recording_id % 3 = 0 THEN 3 ELSE 4 END AS BIGINT) AS n_keys
FROM f_rec JOIN f_run USING (recording_id, duration_s)""")
def metadata_merge(rec, run):
    """Open metadata of recordings with more of it laid over: a missing object, a key of both, a null value, a list."""
    number = lambda c: F.col(c).cast("string")
    told = rec.join(run.select("recording_id", "processing_s"), "recording_id")
    base = F.concat(F.lit('{"note": "base", "mode": "auto", "duration_s": '), number("duration_s"), F.lit("}"))
    kind = F.col("recording_id") % 3
    extra = F.when(kind == 1, F.concat(F.lit('{"note": "extra", "processing_s": '), number("processing_s"), F.lit("}"))).when(kind == 2, '{"mode": null, "tags": ["a", "b"]}')
    merged = told.select("recording_id", document.merged_metadata(F.parse_json(base), F.parse_json(extra)).alias("m"))
    read = lambda path, kind, name: F.variant_get("m", path, kind).alias(name)
    keys = F.size(F.map_keys(F.col("m").cast("map<string,variant>"))).cast("long").alias("n_keys")
    values = [("$.duration_s", "double", "duration_s"), ("$.note", "string", "note"), ("$.mode", "string", "mode"), ("$.processing_s", "double", "processing_s"), ("$.tags[1]", "string", "tag")]
    return merged.select("recording_id", *[read(*v) for v in values], keys)


@query("""WITH w AS (
  SELECT recording_id, count(*) AS n, string_agg(word, ' ' ORDER BY seg_idx, word_start, word_end, word) AS spoken, sum(word_end - word_start) AS spoken_s
  FROM f_words WHERE word_start IS NOT NULL AND word_end IS NOT NULL GROUP BY 1)
SELECT s.recording_id, any_value(duration_s) AS duration, count(*) AS n_segments, coalesce(any_value(n), 0) AS n_words, coalesce(any_value(spoken), '') AS spoken, coalesce(any_value(spoken_s), 0.0) AS spoken_s,
  count(DISTINCT coalesce(speaker, 'SPEAKER_00')) AS n_speakers, string_agg(coalesce(speaker, 'SPEAKER_00'), ' ' ORDER BY seg_idx) AS voices,
  string_agg(coalesce(text, ''), ' ' ORDER BY seg_idx) AS text, sum(end_s - start_s) AS talk_s
FROM f_seg s LEFT JOIN f_rec USING (recording_id) LEFT JOIN w USING (recording_id) GROUP BY s.recording_id""")
def analysis_document(seg, words, rec):
    """The nested documents, flattened for comparison: words and speakers in their order, and seconds of both. document_files has them as JSON."""
    read = document.analysis_document(seg, words, rec)
    talk = F.aggregate(F.map_values("speakers"), F.lit(0.0), lambda a, s: a + s["total_duration"])
    spoken = F.array_join(F.transform("word_segments", lambda w: w["word"]), " ")
    spoken_s = F.aggregate("word_segments", F.lit(0.0), lambda a, w: a + w["end_time"] - w["start_time"])
    sizes = [F.size(c).cast("long").alias(n) for c, n in (("segments", "n_segments"), ("word_segments", "n_words"), ("speakers", "n_speakers"))]
    voices = F.array_join(F.transform("segments", lambda s: s["speaker"]["speaker_id"]), " ")
    return read.select("recording_id", "duration", *sizes, spoken.alias("spoken"), spoken_s.alias("spoken_s"), voices.alias("voices"), "text", talk.alias("talk_s"))


# --- sources


@query("""WITH m AS (SELECT *, regexp_extract(lower(path), '(\\.[^./]*)$', 1) AS suffix FROM f_media),
k AS (SELECT *, CASE WHEN suffix IN ('.wav', '.mp3', '.flac', '.aac', '.m4a') THEN 'audio' WHEN suffix IN ('.mp4', '.avi', '.mov', '.mkv', '.webm') THEN 'video' ELSE 'unsupported' END AS kind FROM m)
SELECT *, CASE WHEN length = 0 THEN 'empty' WHEN length > 5368709120 THEN 'too large' WHEN kind = 'unsupported' THEN 'unsupported' END AS problem FROM k""")
def media_catalog(media_):
    return media.media_catalog(media_)


@query("""WITH m AS (SELECT page_id, uri, CASE WHEN starts_with(uri, 's3://') AND regexp_extract(uri, '^s3://[^/]+/(.+)$', 1) <> '' THEN 's3' WHEN NOT contains(uri, '://') THEN 'local'
  WHEN contains(uri, 'amazonaws.com') AND (contains(uri, 'AWSAccessKeyId') OR contains(uri, 'Signature')) THEN 'presigned' WHEN regexp_matches(uri, '^https://([^.]+)\\.s3\\.[^.]+\\.amazonaws\\.com/([^?]+)') THEN 's3_url' ELSE 'http' END AS method FROM f_uri)
SELECT *, CASE method WHEN 's3' THEN regexp_extract(uri, '^s3://([^/]+)/', 1) WHEN 's3_url' THEN regexp_extract(uri, '^https://([^.]+)\\.s3\\.[^.]+\\.amazonaws\\.com/([^?]+)', 1) END AS bucket,
  CASE method WHEN 's3' THEN regexp_extract(uri, '^s3://[^/]+/(.+)$', 1) WHEN 's3_url' THEN regexp_extract(uri, '^https://([^.]+)\\.s3\\.[^.]+\\.amazonaws\\.com/([^?]+)', 2) END AS key, sha256(coalesce(uri, '')) AS job_id FROM m""")
def source_uri_router(uri):
    return media.source_uri_router(uri)


@query("""WITH m AS (SELECT *, regexp_replace(path, '\\.[^./]*$', '') AS title, CASE regexp_extract(path, '(\\.[^./]*)$', 1) WHEN '.mp4' THEN 1 WHEN '.webm' THEN 2 WHEN '.mkv' THEN 3 WHEN '.m4a' THEN 4 WHEN '.mp3' THEN 5 ELSE 6 END AS rank FROM f_media)
SELECT title, path, length, mtime FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY rank, mtime DESC, path) AS n FROM m) WHERE n = 1""")
def pick_media_file(media_):
    return media.pick_media_file(media_)


@query("""WITH n AS (SELECT page_id, uri, regexp_extract(uri, '([^/]+?)(\\.[^./]*)?$', 1) AS stem FROM f_uri)
SELECT page_id, uri, CASE WHEN starts_with(stem, 'tmp') OR length(stem) > 20 THEN 'request' || page_id ELSE stem END || '_analysis.json' AS output_name FROM n""")
def output_name(uri):
    told = uri.withColumn("_request", F.concat(F.lit("/in/request"), F.col("page_id").cast("string"), F.lit(".mp4")))
    return media.output_name(told, "uri", "_request").drop("_request")


@query("""SELECT doc_id, language, CASE language WHEN 'ko' THEN 'large-v2' WHEN 'en' THEN 'large-v2' WHEN 'ja' THEN 'medium' WHEN 'zh' THEN 'large-v2' ELSE 'base' END AS model_size,
  CASE WHEN NOT on_gpu THEN 'float32' WHEN language IN ('ko', 'en', 'ja', 'zh') THEN 'float16' ELSE 'int8' END AS compute_type,
  CASE language WHEN 'ko' THEN 'Korean-optimized (targeted)' WHEN 'en' THEN 'English-optimized (targeted)' WHEN 'ja' THEN 'Japanese-optimized (targeted)' WHEN 'zh' THEN 'Chinese-optimized (targeted)' ELSE 'universal (auto-detect)' END AS optimization,
  CASE WHEN language <> 'auto' THEN 'targeted' ELSE 'auto-detect' END AS mode FROM f_lang""")
def language_config(lang):
    return media.language_config(lang)


#: Samples of f_audio as 16-bit numbers.
PCM = "CAST(floor(CAST({v} AS DOUBLE) * 32768) AS BIGINT)"


def wav_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The samples of each block as in a WAV file: by recording_id, 16 bits, 24 bits with an empty low byte, or 16 bits beside an empty channel."""
    for b in batches:
        data = []
        for n, x in zip(b["recording_id"].to_pylist(), b["x_raw"], strict=True):
            low = np.floor(x.values.to_numpy(zero_copy_only=False).astype(float) * 32768).astype(np.int64).astype("<i2").view(np.uint8).reshape(-1, 2)
            kind = math.fmod(n or 0, 3)
            at, wide = int(kind == 1), np.zeros((len(low), 3 if kind == 1 else 4 if kind == 2 else 2), np.uint8)
            wide[:, at : at + 2] = low
            data.append(wide.tobytes())
        yield pa.RecordBatch.from_arrays([b["recording_id"], b["block_idx"], pa.array(data, pa.binary())], ["recording_id", "block_idx", "data"])


def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many samples each block has, the first, the last, and their sum weighted by place from 1 on; null without samples."""
    for b in batches:
        told = []
        for x in b["x"]:
            v = x.values.to_numpy(zero_copy_only=False).astype(float) if x.is_valid else None
            told.append((None,) * 4 if v is None else (len(v), v[0], v[-1], float(v @ np.arange(1.0, len(v) + 1))) if len(v) else (0, None, None, 0.0))
        n, first, last, weight = (pa.array([t[k] for t in told], pa.float64() if k else pa.int64()) for k in range(4))
        yield pa.RecordBatch.from_arrays([b["recording_id"], b["block_idx"], n, b["sample_rate"], first, last, weight], ["recording_id", "block_idx", "n", "sample_rate", "first", "last", "weighted"])


@query(f"""WITH s AS (SELECT recording_id, block_idx, list_transform(x_raw, lambda v: {PCM.format(v='v')} / CASE WHEN recording_id % 3 = 2 THEN 65536::DOUBLE ELSE 32768::DOUBLE END) AS x FROM f_audio)
SELECT recording_id, block_idx, CAST(512 AS BIGINT) AS n, 512 AS sample_rate, x[1] AS first, x[512] AS last, list_sum(list_transform(range(1, 513), lambda i: x[i] * i)) AS weighted FROM s""")
def pcm_blocks(audio):
    """The recordings as WAV files of 16 bits, 24 bits or two channels, written one each and read by ranges of samples."""
    spark = audio.sparkSession
    folder = new_folder(spark, "wav")
    file_sink.register(spark)
    low = lambda n, size: F.concat(*[F.lpad(F.hex(F.shiftright(n, 8 * k).bitwiseAND(255)), 2, "0") for k in range(size)])
    kind = F.col("recording_id") % 3
    sounds = audio.mapInArrow(wav_bytes, f"recording_id {audio.schema['recording_id'].dataType.simpleString()}, block_idx long, data binary")
    parts = sounds.groupBy("recording_id").agg(F.array_sort(F.collect_list(F.struct("block_idx", F.hex("data").alias("h")))).alias("p"), F.count("*").alias("n"))
    width, channels = F.when(kind == 1, 3).otherwise(2), F.when(kind == 2, 2).otherwise(1)
    size = (F.col("n") * 512 * width * channels).cast("long")
    fields = [(F.lit(16), 4), (F.lit(1), 2), (channels, 2), (F.lit(512), 4), (512 * width * channels, 4), (width * channels, 2), (width * 8, 2)]
    text = lambda t: F.lit(t.encode().hex())
    head = F.concat(text("RIFF"), low(size + 36, 4), text("WAVEfmt "), *[low(v.cast("long"), k) for v, k in fields], text("data"), low(size, 4))
    content = F.unhex(F.concat(head, F.array_join(F.transform("p", lambda p: p["h"]), "")))
    parts.select(F.concat(F.lit("rec/"), F.col("recording_id").cast("string"), F.lit(".wav")).alias("name"), content.alias("content")).write.format("one_file_each").option("path", folder).mode("append").save()
    number = F.regexp_extract("path", r"(\d+)\.wav$", 1).cast("long").alias("recording_id")
    told = wav.read_wav(spark, folder).select(number, "block_idx", "sample_rate", "x").mapInArrow(weighed, "recording_id long, block_idx long, n long, sample_rate int, first double, last double, weighted double")
    return told.select("recording_id", "block_idx", "n", "sample_rate", "first", "last", "weighted")


@query("""WITH w AS (SELECT recording_id, count(*) AS n FROM f_words WHERE word_start IS NOT NULL AND word_end IS NOT NULL GROUP BY 1)
SELECT CASE WHEN s.recording_id % 3 = 0 THEN 'request' || s.recording_id ELSE 'rec' || s.recording_id END || '_analysis.json' AS file_name, any_value(duration_s) AS duration, count(*) AS n_segments, coalesce(any_value(n), 0) AS n_words,
  string_agg(coalesce(text, ''), ' ' ORDER BY seg_idx) AS text, count(DISTINCT coalesce(speaker, 'SPEAKER_00')) AS n_speakers
FROM f_seg s LEFT JOIN f_rec USING (recording_id) LEFT JOIN w USING (recording_id) GROUP BY s.recording_id""")
def document_files(seg, words, rec):
    """The nested documents, one pretty file for each recording under its output name, read back from the files."""
    spark = seg.sparkSession
    folder = new_folder(spark, "documents")
    built = document.analysis_document(seg, words, rec)
    n = F.col("recording_id")
    paths = rec.select("recording_id", F.concat(F.when(n % 3 == 0, "/in/tmp").otherwise("/in/rec"), n.cast("string"), F.lit(".mp4")).alias("path"), F.concat(F.lit("/in/request"), n.cast("string"), F.lit(".mp4")).alias("request"))
    files.write_documents(built, folder, media.output_name(paths, "path", "request"), pretty=True)
    read = files.read_documents(spark, folder, built.drop("recording_id").schema).select("file_name", "document.*")
    sizes = [F.size(c).cast("long").alias(n) for c, n in (("segments", "n_segments"), ("word_segments", "n_words"), ("speakers", "n_speakers"))]
    return read.select("file_name", "duration", *sizes, "text")


# --- jobs


@query("""WITH l AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) AS n, min(ts) OVER (PARTITION BY job_id) AS first_ts, count(*) OVER (PARTITION BY job_id) AS n_events FROM f_progress)
SELECT job_id, event_id, status, progress, CASE WHEN status = 'failed' THEN CASE WHEN contains(lower(coalesce(error_message, '')), 'download') THEN 'DOWNLOAD_ERROR' ELSE 'PROCESSING_ERROR' END END AS error_code,
  strftime(ts, '%Y-%m-%dT%H:%M:%S') AS updated_at, CAST(floor(epoch(ts - first_ts)) AS BIGINT) AS elapsed_s, n_events FROM l WHERE n = 1""")
def job_latest_status(progress):
    return jobs.latest_status(progress)


@query("""WITH d AS (SELECT *, coalesce(max(CAST(acked AS INT)) OVER (PARTITION BY job_id, status ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS done FROM f_progress)
SELECT event_id, job_id, status, acked FROM d WHERE status NOT IN ('completed', 'failed') OR NOT done""")
def terminal_dedup(progress):
    return jobs.terminal_dedup(progress).select("event_id", "job_id", "status", "acked")


def arriving(rows: DataFrame, name: str, parts: int = 4, closing: DataFrame | None = None) -> tuple[str, DataFrame]:
    """rows written in parts, each of as many files as the rows are read in, as a stream that takes a part at a time; closing comes last."""
    spark, folder = rows.sparkSession, new_folder(rows.sparkSession, name)
    ordered = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    width = max(1, rows.rdd.getNumPartitions())
    for part in (ordered.repartitionByRange(parts * width, "ts"), *([closing] if closing is not None else [])):
        part.select(ordered.columns).write.mode("append").parquet(f"{folder}/in")
    return folder, sinks.opened(spark, f"{folder}/in", ordered.schema, files_a_trigger=width)


@query(same_as="job_latest_status")
def stream_job_status(progress):
    """The latest status of each job from a finished stream of updates."""
    folder, stream = arriving(progress, "job-status")
    told = jobs.stream_latest_status(stream, "3650 days")
    sinks.run(told, folder, "update")
    return sinks.latest_of(progress.sparkSession, folder, told.schema, ["job_id"])


@query(same_as="terminal_dedup")
def stream_terminal_endings(progress):
    """Acknowledged endings from a finished stream. A last event far ahead moves the watermark past all others; it is left out of the result."""
    ahead = F.timestamp_seconds(F.lit(4_000_000_000)).alias("ts")
    last = progress.select([ahead if c == "ts" else F.lit(-1).cast("long").alias(c) if c in ("event_id", "job_id") else F.col(c) for c in progress.columns]).limit(1)
    folder, stream = arriving(progress, "endings", closing=last.withColumn("status", F.lit("processing")))
    told = endings.stream_terminal_dedup(stream, "3650 days")
    sinks.run(told, folder)
    return sinks.rows_of(progress.sparkSession, folder, told.schema).where("event_id >= 0").select("event_id", "job_id", "status", "acked")


@query(f"SELECT run_id, event_id, stage, event, {r('duration_seconds', 6)} AS duration_seconds FROM f_stage WHERE event_id % 10 <> 3")
def log_ingest(stage):
    """Stage events read from a log of JSON lines as a stream; one line in ten is no event."""
    spark, folder = stage.sparkSession, new_folder(stage.sparkSession, "log")
    line = F.to_json(F.struct("run_id", "event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts"), "stage", "event", "duration_seconds"))
    kept = F.when(F.col("event_id") % 10 != 3, line).when(F.col("event_id") % 20 == 3, "starting up").otherwise('{"event": "started"}')
    stage.select(kept.alias("value")).repartition(4).write.text(f"{folder}/in")
    events = files.events_of(sinks.opened(spark, f"{folder}/in", StructType().add("value", "string"), "text", 1))
    sinks.run(events, folder)
    told = sinks.rows_of(spark, folder, events.schema)
    return told.select("run_id", "event_id", "stage", "event", rounded("duration_seconds", 6).alias("duration_seconds"))


@query("""WITH d AS (SELECT *, lag(progress) OVER w AS previous, max(progress) OVER (PARTITION BY job_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS highest FROM f_progress WINDOW w AS (PARTITION BY job_id ORDER BY ts, event_id))
SELECT job_id, event_id, progress, previous, highest FROM d WHERE progress < previous""")
def progress_regressions(progress):
    return jobs.progress_regressions(progress)


@query("""SELECT date_trunc('minute', ts) AS minute, count(*) AS n_events, avg(CASE WHEN status = 'failed' THEN 1.0::DOUBLE ELSE 0.0 END) AS error_rate, avg(CASE WHEN status = 'failed' THEN 1.0::DOUBLE ELSE 0.0 END) > 0.05 AS alarm FROM f_progress GROUP BY 1""")
def minute_error_rate(progress):
    return jobs.minute_error_rate(progress.withColumn("ts", F.col("ts").cast("timestamp"))).withColumn("minute", F.col("minute").cast("timestamp_ntz"))


@query("""SELECT date_trunc('minute', ts) AS minute, avg(CAST(progress % 4 AS DOUBLE) / 4) AS gpu, avg(CAST(event_id % 32 AS DOUBLE) / 32) AS memory,
  avg(CAST(progress % 4 AS DOUBLE) / 4) < 0.3 AS gpu_idle, avg(CAST(event_id % 32 AS DOUBLE) / 32) > 0.9 AS memory_full FROM f_progress GROUP BY 1""")
def minute_resources(progress):
    """Uses in quarters and in parts of 32, so that sums are exact."""
    ts, gpu, memory = F.col("ts").cast("timestamp").alias("ts"), (F.col("progress") % 4 / 4).alias("gpu"), (F.col("event_id") % 32 / 32).alias("memory")
    return jobs.minute_resources(progress.select(ts, gpu, memory)).withColumn("minute", F.col("minute").cast("timestamp_ntz"))


@query("""WITH w AS (SELECT recording_id, speaker, CAST(start_s * 1000 AS BIGINT) AS a, CAST((end_s - start_s) * 1000 AS BIGINT) + 500 AS len FROM f_seg WHERE speaker IS NOT NULL),
e AS (SELECT *, max(a + len) OVER (PARTITION BY recording_id, speaker ORDER BY a, len ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM w),
g AS (SELECT *, sum(CASE WHEN before IS NULL OR a > before THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id, speaker ORDER BY a, len) AS s FROM e)
SELECT recording_id, speaker, make_timestamp(min(a) * 1000) AS started_at, make_timestamp((max(a + len) - 500) * 1000) AS ended_at, count(*) AS n_words FROM g GROUP BY recording_id, speaker, s""")
def session_utterances(seg):
    words = seg.where("speaker is not null").select("recording_id", "speaker", F.timestamp_millis((F.col("start_s") * 1000).cast("long")).alias("ts"), ((F.col("end_s") - F.col("start_s")) * 1000).cast("long").alias("duration_ms"))
    out = jobs.session_utterances(words)
    return out.withColumns({"started_at": F.col("started_at").cast("timestamp_ntz"), "ended_at": F.col("ended_at").cast("timestamp_ntz")})


@query(f"""WITH t AS (SELECT run_id, stage, sum(duration_seconds) AS seconds FROM f_stage WHERE event = 'stage_duration' GROUP BY 1, 2)
SELECT run_id, stage AS bottleneck_stage, {r('seconds', 4)} AS seconds FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seconds DESC, stage) AS n FROM t) WHERE n = 1""")
def stage_bottleneck(stage):
    return jobs.stage_bottleneck(stage).withColumn("seconds", rounded("seconds", 4))


@query("SELECT run_id, count(DISTINCT CASE WHEN event = 'stage_duration' THEN stage END)::DOUBLE / 3 * 100 AS progress, count(*) FILTER (WHERE event = 'stage_failed') AS errors FROM f_stage GROUP BY run_id")
def stage_progress(stage):
    return jobs.stage_progress(stage)


@query("""WITH t AS (SELECT job_id, chunk_idx, CAST(sum(bytes) OVER (PARTITION BY job_id ORDER BY chunk_idx ROWS UNBOUNDED PRECEDING) AS BIGINT) AS downloaded, sum(bytes) OVER (PARTITION BY job_id) AS total FROM f_transfer)
SELECT job_id, chunk_idx, downloaded, 5 + CAST(floor(CAST(downloaded AS DOUBLE) / nullif(total, 0) * 5) AS BIGINT) AS progress FROM t""")
def transfer_progress(transfer):
    return jobs.transfer_progress(transfer)


@query("""WITH m AS (SELECT recording_id % 4 AS machine, duration_s, processing_s FROM f_run)
SELECT machine, sum(duration_s) AS duration_s, sum(processing_s) AS processing_s, sum(duration_s) / nullif(sum(processing_s), 0) AS realtime_factor FROM m GROUP BY ROLLUP (machine)""")
def realtime_factor(run):
    return jobs.realtime_factor(run.withColumn("machine", F.pmod("recording_id", F.lit(4))), "machine")


# executors get what is defined here by value, so they need not have the repository on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])
