"""Stand-in tables: the SQL that derives speech-timeline rows from the given tables, the same text for Spark and for DuckDB.

Times are multiples of 1/16 s (1/1024 s in f_segdup and of words), so sums and differences are exact.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

BASE = ("events", "documents", "embeddings", "pages", "conversations")

F_SEG = """
WITH s0 AS (
  SELECT conv_id, turn, text,
         CAST(1.0 AS DOUBLE) + (length(text) % 12) * CAST(0.5 AS DOUBLE) AS dur,
         CASE WHEN turn > 0 AND (conv_id + turn) % 5 = 4 THEN CAST(-0.25 AS DOUBLE)
              ELSE ((conv_id * 7 + turn * 3) % 6) * CAST(0.25 AS DOUBLE) END AS gap
  FROM conversations),
s1 AS (
  SELECT conv_id AS recording_id, turn AS seg_idx, text,
         sum(gap + dur) OVER (PARTITION BY conv_id ORDER BY turn
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS end_s, dur
  FROM s0)
SELECT recording_id, seg_idx, end_s - dur AS start_s, end_s,
       CASE WHEN (recording_id + seg_idx) % 11 = 10 THEN NULL
            ELSE concat('SPEAKER_0', CAST((recording_id + CAST(floor(seg_idx / 2) AS BIGINT)) % 3 AS VARCHAR(2))) END AS speaker,
       text
FROM s1
"""

F_TURN = """
SELECT recording_id, seg_idx AS turn_idx,
       CASE WHEN seg_idx % 5 = 2 THEN end_s - CAST(0.0625 AS DOUBLE)
            ELSE start_s + (seg_idx % 3) * CAST(0.25 AS DOUBLE) END AS start_s,
       CASE WHEN seg_idx % 5 = 2 THEN end_s + CAST(0.0625 AS DOUBLE)
            ELSE end_s - CAST(0.25 AS DOUBLE) END AS end_s,
       concat('SPEAKER_0', CAST((recording_id + seg_idx) % 3 AS VARCHAR(2))) AS speaker
FROM f_seg WHERE (recording_id + seg_idx) % 4 <> 3
"""

F_SEGDUP = """
SELECT recording_id, seg_idx * 2 AS seg_idx, start_s, end_s, speaker, text FROM f_seg
UNION ALL
SELECT recording_id, seg_idx * 2 + 1, start_s + CAST(0.0009765625 AS DOUBLE), end_s, speaker, concat(' ', text, ' ')
FROM f_seg WHERE (recording_id + seg_idx) % 6 = 0
"""

F_REC = """
SELECT recording_id, max(end_s) + (recording_id % 4) * CAST(0.25 AS DOUBLE) AS duration_s,
       CAST(16000 AS INT) AS sample_rate
FROM f_seg GROUP BY recording_id
UNION ALL
SELECT CAST(1000000 + doc_id AS BIGINT), CAST(0.0 AS DOUBLE), CAST(16000 AS INT) FROM documents
WHERE NOT EXISTS (SELECT 1 FROM conversations c WHERE c.conv_id = doc_id)
"""

#: Each word of the array words with its place, for DuckDB and for Spark: the one thing in which the two texts differ.
EACH_WORD = "unnest(range(len(words))) AS word_idx, unnest(words) AS word"
EACH_WORD_SPARK = "posexplode(words) AS (word_idx, word)"
F_WORDS = f"""
WITH w0 AS (
  SELECT recording_id, seg_idx, start_s, end_s, speaker, coalesce(text, '') AS text, split(coalesce(text, ''), ' ') AS words,
         CAST(length(coalesce(text, '')) - length(replace(coalesce(text, ''), ' ', '')) + 1 AS DOUBLE) AS n_words FROM f_seg),
w1 AS (SELECT recording_id, seg_idx, start_s, end_s, speaker, text, n_words, {EACH_WORD} FROM w0),
w2 AS (
  SELECT recording_id, seg_idx, start_s, end_s, speaker, text, CAST(word_idx AS BIGINT) AS word_idx, word,
         (end_s - start_s) * CAST(1024 AS DOUBLE) AS ticks, n_words
  FROM w1)
SELECT recording_id, seg_idx, start_s, end_s, speaker, text, word_idx,
       CASE WHEN (recording_id + seg_idx + word_idx) % 3 = 0 THEN NULL
            ELSE start_s + CAST(floor(word_idx * ticks / n_words) AS DOUBLE) / CAST(1024 AS DOUBLE) END AS word_start,
       CASE WHEN (recording_id + seg_idx + word_idx) % 7 = 0 THEN NULL
            ELSE start_s + CAST(floor((word_idx + 1) * ticks / n_words) AS DOUBLE) / CAST(1024 AS DOUBLE) END AS word_end,
       CASE WHEN seg_idx % 4 = 3 THEN ' ' ELSE word END AS word
FROM w2
"""

F_BLOCK = """
SELECT CAST(label AS BIGINT) AS recording_id,
       CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS BIGINT) AS block_idx,
       vec_id, embedding AS x_raw,
       CAST(2.0 AS DOUBLE) / power(CAST(2.0 AS DOUBLE), CAST(floor(vec_id / 16) AS BIGINT) % 6) AS gain
FROM embeddings
"""

#: A block of each second of a recording and each of its samples, for DuckDB and for Spark: the other things in which the two texts differ.
EACH_SECOND, EACH_SECOND_SPARK = "unnest(range(seconds)) AS block_idx", "explode(sequence(CAST(0 AS BIGINT), seconds - 1)) AS block_idx"
EACH_SAMPLE, EACH_SAMPLE_SPARK = "list_transform(range(512), lambda i: ", "transform(sequence(CAST(0 AS BIGINT), CAST(511 AS BIGINT)), i -> "
#: Samples of every recording at 512 Hz (the hint has Spark make them in many tasks; to DuckDB it is a comment): bursts of 96 samples of a falling saw-tooth between 150 and 199 Hz, three in five, and a little
#: noise. All are multiples of 1/65536, so sums of squares are exact. One recording in 17 is too loud to be analysed.
F_AUDIO = f"""
WITH a0 AS (SELECT recording_id, CAST(ceil(max(end_s)) AS BIGINT) AS seconds FROM f_seg GROUP BY recording_id),
a1 AS (SELECT /*+ REPARTITION(32) */ recording_id, {EACH_SECOND} FROM a0)
SELECT recording_id, block_idx, {EACH_SAMPLE}CAST(
         CASE WHEN (CAST(floor((block_idx * 512 + i) / 96) AS BIGINT) * 7 + recording_id * 3) % 5 < 3 THEN
           (96 - (block_idx * 512 + i) % 96) * CAST(0.0078125 AS DOUBLE)
           * ((((block_idx * 512 + i) * (150 + (recording_id * 13 + CAST(floor((block_idx * 512 + i) / 96) AS BIGINT) * 7) % 50)) % 512 - 256) * CAST(0.001953125 AS DOUBLE))
         ELSE CAST(0 AS DOUBLE) END
         + (((block_idx * 512 + i) * 37 + recording_id * 11) % 61 - 30) * CAST(0.000244140625 AS DOUBLE) AS FLOAT)) AS x_raw,
       CASE WHEN recording_id % 17 = 5 THEN CAST(4 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS gain
FROM a1
"""

F_PROGRESS = """
SELECT event_id, user_id * 10 + event_id % 4 AS job_id, ts,
       CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'processing' END AS status,
       CAST(floor(value) AS BIGINT) % 101 AS progress,
       event_id % 9 <> 0 AS acked,
       CASE WHEN event_type = 'error' THEN
            CASE WHEN event_id % 3 = 0 THEN 'Failed Download' ELSE 'model failure' END END AS error_message
FROM events
"""

F_STAGE = """
SELECT event_id, user_id AS run_id, ts,
       CASE event_id % 3 WHEN 0 THEN 'audio_extraction' WHEN 1 THEN 'whisperx_pipeline' ELSE 'result_synthesis' END AS stage,
       CASE WHEN event_type = 'error' THEN 'stage_failed' ELSE 'stage_duration' END AS event,
       value AS duration_seconds
FROM events
"""

F_TRANSFER = """
SELECT user_id AS job_id, event_id AS chunk_idx, CAST(floor(value * 100) AS BIGINT) AS bytes FROM events
"""

F_URI = """
SELECT page_id, CASE page_id % 5
  WHEN 0 THEN concat('s3://bucket', CAST(page_id % 3 AS VARCHAR(5)), '/input/v', CAST(page_id AS VARCHAR(12)), '.mp4')
  WHEN 1 THEN concat('https://b', CAST(page_id % 3 AS VARCHAR(5)), '.s3.us-east-1.amazonaws.com/in/v', CAST(page_id AS VARCHAR(12)), '.mp4?X-Amz-Signature=ab')
  WHEN 2 THEN concat('https://b', CAST(page_id % 3 AS VARCHAR(5)), '.s3.us-east-1.amazonaws.com/in/v', CAST(page_id AS VARCHAR(12)), '.wav?v=1')
  WHEN 3 THEN concat('/data/tmp', CAST(page_id AS VARCHAR(12)), '.flac')
  ELSE url END AS uri FROM pages
"""

F_LANG = """
SELECT doc_id, lang AS language, CAST(doc_id % 2 = 0 AS BOOLEAN) AS on_gpu, n_chars FROM documents
UNION ALL SELECT CAST(-1 AS BIGINT), 'auto', true, CAST(0 AS BIGINT)
"""

F_MEDIA = """
SELECT concat('/media/t', CAST(CAST(floor(doc_id / 3) AS BIGINT) AS VARCHAR(12)),
       CASE doc_id % 7 WHEN 0 THEN '.mp4' WHEN 1 THEN '.webm' WHEN 2 THEN '.wav' WHEN 3 THEN '.mp3'
            WHEN 4 THEN '.m4a' WHEN 5 THEN '.MKV' ELSE '.txt' END) AS path,
       CASE WHEN doc_id % 10 = 0 THEN CAST(0 AS BIGINT) ELSE n_chars END AS length,
       (doc_id * 37) % 1009 AS mtime
FROM documents
"""

F_RUN = """
SELECT recording_id, duration_s, CAST(0.25 AS DOUBLE) * (1 + recording_id % 8) AS processing_s FROM f_rec
"""

F_SPOKEN = """
SELECT recording_id, CASE recording_id % 4 WHEN 0 THEN 'auto' WHEN 1 THEN 'en' WHEN 2 THEN 'ko' ELSE 'auto' END AS requested,
       CASE WHEN recording_id % 3 = 0 THEN NULL WHEN recording_id % 4 = 3 THEN 'ja' ELSE 'en' END AS detected
FROM f_rec
"""

F_LABEL = """
SELECT recording_id, seg_idx, coalesce(speaker, 'SPEAKER_00') AS speaker,
       CASE (recording_id * 5 + seg_idx) % 3 WHEN 0 THEN 'happy' WHEN 1 THEN 'neutral' ELSE 'sad' END AS emotion,
       CAST(0.25 AS DOUBLE) * (1 + seg_idx % 4) AS confidence
FROM f_seg
"""

SQL = {"f_seg": F_SEG, "f_turn": F_TURN, "f_segdup": F_SEGDUP, "f_rec": F_REC, "f_words": F_WORDS, "f_block": F_BLOCK, "f_audio": F_AUDIO, "f_progress": F_PROGRESS, "f_stage": F_STAGE, "f_transfer": F_TRANSFER, "f_uri": F_URI, "f_lang": F_LANG, "f_media": F_MEDIA, "f_run": F_RUN, "f_spoken": F_SPOKEN, "f_label": F_LABEL}


def needs(sql: str) -> list[str]:
    """The stand-in tables that a text reads, each after those it reads itself."""
    found: list[str] = []
    for name in SQL:
        if re.search(rf"\b{name}\b", sql):
            found += [x for x in (*needs(SQL[name]), name) if x not in found]
    return found


def with_tables(sql: str) -> str:
    """A query over stand-in tables as one text over the given tables. A leading WITH is taken in."""
    heads = ", ".join(f"{name} AS ({SQL[name]})" for name in needs(sql))
    body = sql.strip()
    if not heads:
        return body
    for head in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(head):
            return f"{head}{heads}, {body[len(head):]}"
    return f"WITH {heads} {body}"


#: f_audio's rows before their samples.
SECONDS = F_AUDIO[: F_AUDIO.index("SELECT recording_id, block_idx")] + "SELECT * FROM a1"


def sounding(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Rows of a1 with the samples and gain that F_AUDIO tells, by whole arrays: a function of arrays in SQL takes some 50 times as long for each sample."""
    for whole in batches:
        for b in (whole.slice(at, rows) for at in range(0, whole.num_rows, rows)):
            known = pc.is_valid(b["recording_id"]).to_numpy(zero_copy_only=False)
            n = pc.fill_null(b["recording_id"], 0).to_numpy().astype(np.int64)
            s = b["block_idx"].to_numpy()[:, None] * 512 + np.arange(512)
            r, burst = n[:, None], s // 96
            tooth = (96 - s % 96) * 0.0078125 * ((np.fmod(s * (150 + np.fmod(r * 13 + burst * 7, 50)), 512) - 256) * 0.001953125)
            x = np.where(np.fmod(burst * 7 + r * 3, 5) < 3, tooth, 0.0) + (np.fmod(s * 37 + r * 11, 61) - 30) * 0.000244140625
            values = pa.array(x.astype(np.float32).ravel(), mask=None if known.all() else np.repeat(~known, 512))
            told = [b["recording_id"], b["block_idx"], pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * 512), values), pa.array(np.where(known & (np.fmod(n, 17) == 5), 4.0, 1.0))]
            yield pa.RecordBatch.from_arrays(told, ["recording_id", "block_idx", "x_raw", "gain"])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stand-in table as a DataFrame over the Parquet tables in sf_dir."""
    if name == "f_audio":
        seconds = derived(spark, sf_dir, with_tables(SECONDS))
        return seconds.mapInArrow(sounding, f"recording_id {seconds.schema['recording_id'].dataType.simpleString()}, block_idx long, x_raw array<float>, gain double")
    return derived(spark, sf_dir, with_tables(f"SELECT * FROM {name}"))


def derived(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """SQL of stand-in tables over the Parquet tables in sf_dir."""
    for duck, own in ((EACH_WORD, EACH_WORD_SPARK), (EACH_SECOND, EACH_SECOND_SPARK), (EACH_SAMPLE, EACH_SAMPLE_SPARK)):
        sql = sql.replace(duck, own)
    used = [b for b in BASE if re.search(rf"\bFROM {b}\b", sql)]
    for b in used:
        sql = re.sub(rf"\bFROM {b}\b", f"FROM {{{b}}}", sql)
    return spark.sql(sql, **{b: spark.read.parquet(f"{sf_dir}/{b}.parquet") for b in used})


# executors get what is defined here by value, so they need not have the repository on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])
