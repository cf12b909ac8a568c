"""Streams against their batch twins; WAV decoding and file listing; signal edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxtable.operators import document, signal
from voxtable.plans.queries import SMALL
from voxtable.plans.standin import table
from voxtable.sources import files as json_files
from voxtable.sources import media
from voxtable.streaming import jobs


@pytest.fixture(scope="module")
def events(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("events"))
    rows = table(spark, sf_dir, "f_progress").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.repartitionByRange(4, "ts").write.mode("overwrite").parquet(path)
    return path


def run(spark, stream, name, mode):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def opened(spark, path):
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def test_latest_status(spark, events):
    out = run(spark, jobs.stream_latest_status(opened(spark, events), "30 days"), "latest", "update")
    last = out.groupBy("job_id").agg(F.max(F.struct("event_id")).alias("x")).count()
    batch = jobs.latest_status(spark.read.parquet(events))
    assert last == batch.count()
    assert batch.join(out, ["job_id", "event_id", "status", "progress", "updated_at", "elapsed_s", "n_events"], "left_anti").count() == 0


def test_minute_error_rate(spark, events):
    out = run(spark, jobs.minute_error_rate(opened(spark, events).withWatermark("ts", "3650 days")), "minutes", "complete")
    batch = jobs.minute_error_rate(spark.read.parquet(events))
    assert out.count() == batch.count() and out.join(batch, out.columns, "left_anti").count() == 0


def test_session_utterances(spark, tmp_path):
    rows = [(1, "A", 0, 1000), (1, "A", 1400, 100), (1, "B", 1450, 100), (1, "A", 2100, 50), (1, "A", 60_000, 50)]
    spark.createDataFrame(rows, "recording_id long, speaker string, ms long, duration_ms long").select("recording_id", "speaker", F.timestamp_millis("ms").alias("ts"), "duration_ms").write.parquet(path := str(tmp_path / "w"))
    batch = jobs.session_utterances(spark.read.parquet(path))
    assert sorted((r.speaker, r.n_words) for r in batch.collect()) == [("A", 1), ("A", 1), ("A", 2), ("B", 1)]
    out = run(spark, jobs.session_utterances(opened(spark, path).withWatermark("ts", "1 day")), "utterances", "complete")
    assert out.join(batch, out.columns, "left_anti").count() == 0 and out.count() == 4


def test_media_catalog_of_a_folder(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(b"x")
    (tmp_path / "e.TXT").write_bytes(b"text")
    catalog = {r.path[-5]: (r.kind, r.problem) for r in media.list_media(spark, str(tmp_path)).collect()}
    assert catalog["a"] == ("audio", None) and catalog["e"] == ("unsupported", "unsupported")


def test_frames_and_tone(spark):
    t = np.arange(64 * 8) / SMALL.rate
    x = 0.5 * np.sin(2 * np.pi * 100 * t)
    blocks = spark.createDataFrame([(1, i, x[i * 64 : i * 64 + 64].tolist(), 1.0) for i in range(8)] + [(2, 0, [0.0] * 64, 1.0), (3, 0, [2.0] * 64, 1.0)], "recording_id long, block_idx long, x_raw array<float>, gain double")
    padded = np.concatenate((np.zeros(128), x, np.zeros(128)))
    want = [np.sqrt((padded[i * 64 : i * 64 + 256] ** 2).mean()) for i in range(9)]
    got = [r.rms for r in signal.frame_rms(blocks, SMALL).where("recording_id = 1").orderBy("frame_idx").collect()]
    assert got == pytest.approx(want, abs=1e-6)
    normal = {(r.recording_id, r.block_idx): max(map(abs, r.x)) for r in signal.normalize_audio(blocks).collect()}
    assert normal[2, 0] == 0 and normal[3, 0] == pytest.approx(1)


def test_json_in_and_out(spark, tmp_path, sf_dir):
    (tmp_path / "segments.json").write_text('{"recording_id": 1, "seg_idx": 0, "start": 1.5, "end_time": 2.0, "text": "é", "words": [{"word": "é", "start_time": 1.5}]}\n{"recording_id": 1, "seg_idx": 1, "start": null, "start_time": 2.5}\n')
    rows = json_files.read_segments(spark, str(tmp_path / "segments.json")).orderBy("seg_idx").collect()
    assert [(r.start_s, r.end_s) for r in rows] == [(1.5, 2.0), (2.5, 0.0)] and rows[0].words[0].start_time == 1.5
    (tmp_path / "log.json").write_text('{"run_id": 1, "stage": "a", "event": "stage_duration", "duration_seconds": 2.0}\nnot json\n{"event": "started"}\n{"run_id": 1, "stage": "b", "event": "stage_duration", "duration_seconds": 3.0}\n')
    log = json_files.read_log(spark, str(tmp_path / "log.json"))
    assert sorted((r.line, r.reason) for r in json_files.rejected_log(spark, str(tmp_path / "log.json")).collect()) == [("not json", "not JSON"), ('{"event": "started"}', "no stage")]
    assert log.count() == 2 and jobs.stage_bottleneck(log).first().bottleneck_stage == "b"
    docs = document.analysis_document(*[table(spark, sf_dir, t) for t in ("f_seg", "f_words", "f_rec")])
    names = docs.select("recording_id", F.concat(F.lit("n"), F.col("recording_id").cast("string"), F.lit("_analysis.json")).alias("output_name"))
    json_files.write_documents(docs, str(tmp_path / "out"), names)
    back = spark.read.json(str(tmp_path / "out"))
    assert back.count() == docs.count() and "word_segments" in back.columns


def test_wav_bytes_of_blocks():
    """16 bits, 24 bits with an empty low byte, and 16 bits beside an empty channel, by the recording's number as SQL takes its remainder."""
    import pyarrow as pa

    from voxtable.plans.queries import wav_bytes, weighed

    x = [0.0, 0.5, -0.25, -1 / 32768, 0.999]
    want = [int(np.floor(v * 32768)).to_bytes(2, "little", signed=True) for v in x]
    b = pa.RecordBatch.from_pydict({"recording_id": [3, 1, 5, -1], "block_idx": [0, 1, 2, 3], "x_raw": [x] * 4})
    (out,) = wav_bytes(iter([b]))
    assert out["data"].to_pylist() == [b"".join(want), b"".join(b"\0" + w for w in want), b"".join(w + b"\0\0" for w in want), b"".join(want)]
    b = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([0, 0, None]), pa.array([[0.5, 0.25], [], None], pa.list_(pa.float32())), pa.array([512] * 3)], ["recording_id", "block_idx", "x", "sample_rate"])
    (out,) = weighed(iter([b]))
    assert [out[c].to_pylist() for c in ("n", "first", "last", "weighted")] == [[2, 0, None], [0.5, None, None], [0.25, None, None], [1.0, 0.0, None]]
