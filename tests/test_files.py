"""WAV files by ranges of samples, and one file for each row."""

import io
import json
import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxtable.sources import file_sink, files, wav

KINDS = {(1, 8): "<u1", (1, 16): "<i2", (1, 24): None, (1, 32): "<i4", (3, 32): "<f4", (3, 64): "<f8"}


def encoded(x, kind, bits):
    if kind == 3:
        return x.astype(KINDS[kind, bits]).tobytes()
    n = np.clip(np.round(x * (1 << (bits - 1))), -(1 << (bits - 1)), (1 << (bits - 1)) - 1).astype(np.int64)
    if bits == 8:
        return (n + 128).astype(np.uint8).tobytes()
    if bits == 24:
        return b"".join(struct.pack("<i", int(v))[:3] for v in n)
    return n.astype(KINDS[kind, bits]).tobytes()


def riff(data, kind, bits, channels=1, rate=8000, extra=b"", size=None, extensible=False):
    form = struct.pack("<HHIIHH", 0xFFFE if extensible else kind, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits)
    form += struct.pack("<HHIH", 22, bits, 0, kind) + b"\0" * 14 if extensible else b""
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(form)) + form + extra + b"data" + struct.pack("<I", len(data) if size is None else size) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


def rows_of(df):
    out = {}
    for r in df.orderBy("path", "block_idx").collect():
        out.setdefault(r.path.rsplit("/", 1)[-1], []).append(r)
    return out


@pytest.mark.parametrize("channels", [1, 3])
@pytest.mark.parametrize(("kind", "bits"), list(KINDS))
def test_samples_of_every_width(spark, tmp_path, kind, bits, channels):
    x = np.random.default_rng(bits).uniform(-1, 0.99, (1100, channels))
    data = encoded(x.ravel(), kind, bits)
    (tmp_path / "a.wav").write_bytes(riff(data, kind, bits, channels))
    (tmp_path / "b.WAV").write_bytes(riff(data, kind, bits, channels, extra=b"LIST" + struct.pack("<I", 3) + b"abc\0", size=0xFFFFFFFF, extensible=True))
    found = rows_of(wav.read_wav(spark, str(tmp_path)))
    for name in ("a.wav", "b.WAV"):
        assert [len(r.x) for r in found[name]] == [512, 512, 76] and {r.sample_rate for r in found[name]} == {8000}
        got = np.concatenate([r.x for r in found[name]])
        assert np.abs(got - x.mean(axis=1)).max() <= 1 / (1 << min(bits - 1, 22))


def test_files_that_are_no_wav(spark, tmp_path):
    bad = {
        "none": b"nothing", "empty": b"", "law": riff(b"\0" * 8, 7, 8), "cut": b"RIFF\x24\0\0\0WAVEfmt \x10", "late": b"RIFF\0\0\0\0WAVEdata\x04\0\0\0abcd",
        "still": riff(b"", 1, 16, channels=0), "short": b"RIFF\0\0\0\0WAVEfmt \x04\0\0\0abcd",
    }
    for name, data in bad.items():
        (tmp_path / f"{name}.wav").write_bytes(data)
    (tmp_path / "silent.wav").write_bytes(riff(b"", 1, 16))
    (tmp_path / "good.wav").write_bytes(riff(b"\0\x40" * 3, 1, 16))
    (tmp_path / "text.txt").write_bytes(b"RIFF")
    found = rows_of(wav.read_wav(spark, str(tmp_path)))
    assert set(found) == {f"{n}.wav" for n in (*bad, "good")}
    for name in bad:
        (row,) = found[f"{name}.wav"]
        assert row.error and row.x is None and row.block_idx is None
    assert found["good.wav"][0].x == [0.5] * 3 and found["good.wav"][0].error is None


def test_the_library_of_python_agrees(spark, tmp_path):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setparams((2, 2, 44100, 0, "NONE", ""))
        w.writeframes(struct.pack("<6h", 100, 300, -200, 0, 7, 9))
    (tmp_path / "a.wav").write_bytes(out.getvalue())
    (row,) = wav.read_wav(spark, str(tmp_path / "a.wav")).collect()
    assert row.x == pytest.approx([200 / 32768, -100 / 32768, 8 / 32768]) and row.sample_rate == 44100


def test_a_large_file_is_many_tasks(spark, tmp_path):
    """Parts that fit no block, a sparse file of 3 GB, and small files together in a task."""
    x = np.arange(50_000) % 30_000
    (tmp_path / "a.wav").write_bytes(riff(x.astype("<i2").tobytes(), 1, 16))
    spark.dataSource.register(wav.WavBlocks)
    told = spark.read.format("wav_blocks").options(path=str(tmp_path), task_bytes="9000", block="300").load()
    assert told.rdd.getNumPartitions() == 12
    got = told.orderBy("block_idx").collect()
    assert [r.block_idx for r in got] == list(range(167))
    assert np.array_equal(np.concatenate([r.x for r in got]) * 32768, x)
    big = tmp_path / "big" / "big.wav"
    big.parent.mkdir()
    with big.open("wb") as f:
        f.write(riff(b"", 1, 16, size=3_000_000_000))
        f.truncate(3_000_000_044)
    assert wav.read_wav(spark, str(big.parent)).rdd.getNumPartitions() == 45
    (row,) = wav.read_wav(spark, str(big.parent), start=90_000.0, end=90_000.01).collect()
    assert row.block_idx == 90_000 * 8000 // 512
    for k in range(30):
        (tmp_path / "small").mkdir(exist_ok=True)
        (tmp_path / "small" / f"{k}.wav").write_bytes(riff(b"\0\0" * 10, 1, 16))
    assert wav.read_wav(spark, str(tmp_path / "small")).rdd.getNumPartitions() == 1


def test_a_slice_has_its_blocks_only(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(riff(np.arange(8000).astype("<i2").tobytes(), 1, 16))
    whole = rows_of(wav.read_wav(spark, str(tmp_path), block=100))["a.wav"]
    part = rows_of(wav.read_wav(spark, str(tmp_path), block=100, start=0.25, end=0.5))["a.wav"]
    assert part == whole[20:40]
    assert wav.read_wav(spark, str(tmp_path), start=5.0).count() == 0 and wav.read_wav(spark, str(tmp_path), start=-3.0, end=0.0).count() == 0


@pytest.mark.parametrize(("own", "rate"), [(44_100, 16_000), (8_000, 16_000), (48_000, 16_000), (16_000, 16_000)])
def test_samples_at_another_rate(spark, tmp_path, own, rate):
    """A tone below both half rates stays what it is; one above the new half rate is gone. Parts meet without a seam."""
    t = np.arange(int(own * 0.7)) / own
    high = 0.4 * np.sin(2 * np.pi * 11_000 * t) if own > 30_000 else 0
    (tmp_path / "a.wav").write_bytes(riff(encoded(0.4 * np.sin(2 * np.pi * 700 * t) + high, 3, 32), 3, 32, rate=own))
    spark.dataSource.register(wav.WavBlocks)
    told = spark.read.format("wav_blocks").options(path=str(tmp_path), rate=str(rate), task_bytes="20000").load().orderBy("block_idx").collect()
    got = np.concatenate([r.x for r in told])
    assert {r.sample_rate for r in told} == {rate} and len(got) == -(-len(t) * rate // own)
    want = 0.4 * np.sin(2 * np.pi * 700 * np.arange(len(got)) / rate)
    assert np.abs(got - want)[200:-200].max() < 2e-3


def written(folder):
    return {str(p.relative_to(folder)): p.read_bytes() for p in folder.rglob("*") if p.is_file() and not p.name.endswith(".crc")}


def test_one_file_for_each_row(spark, tmp_path):
    file_sink.register(spark)
    folder = tmp_path / "out"
    rows = spark.createDataFrame([("a.txt", "é ü"), ("deep/b.txt", None), ("deep/er/c.txt", "x" * 100_000)], "name string, content string").repartition(3)
    rows.write.format("one_file_each").option("path", str(folder)).mode("append").save()
    assert written(folder) == {"a.txt": "é ü".encode(), "deep/b.txt": b"", "deep/er/c.txt": b"x" * 100_000}
    more = spark.createDataFrame([("a.txt", b"\0\xff")], "name string, content binary")
    more.write.format("one_file_each").option("path", str(folder)).mode("append").save()
    assert written(folder)["a.txt"] == b"\0\xff" and len(written(folder)) == 3
    more.write.format("one_file_each").option("path", str(folder)).mode("overwrite").save()
    assert written(folder) == {"a.txt": b"\0\xff"} and [p.name for p in folder.iterdir()] == ["a.txt"]


@pytest.mark.parametrize("name", ["../up.txt", "/etc/x", "", None])
def test_a_job_that_fails_leaves_no_file(spark, tmp_path, name):
    file_sink.register(spark)
    rows = spark.createDataFrame([(f"{k}.txt", "x") for k in range(8)] + [(name, "bad")], "name string, content string").repartition(4)
    with pytest.raises(Exception, match="no name of a file"):
        rows.write.format("one_file_each").option("path", str(tmp_path / "out")).mode("append").save()
    assert not [k for k in written(tmp_path / "out") if not k.startswith("_temporary")]  # there, a killed task may write yet


def test_a_task_tried_again_leaves_one_file(tmp_path):
    """Two attempts write the same rows; the first never tells, the second is committed."""
    writer = file_sink.OneFileEachWriter(str(tmp_path), False)
    rows = [{"name": "a.txt", "content": "once"}, {"name": "b/c.txt", "content": "once"}]
    writer.write(iter([{"name": "a.txt", "content": "half"}]))
    other = file_sink.OneFileEachWriter(str(tmp_path), False)
    other.write(iter(rows))  # another job, still under way
    writer.commit([writer.write(iter(rows)), None])
    assert {k: v for k, v in written(tmp_path).items() if not k.startswith("_temporary")} == {"a.txt": b"once", "b/c.txt": b"once"}
    assert [p.name for p in (tmp_path / "_temporary").iterdir()] == [other.run]
    other.abort([])
    assert not (tmp_path / "_temporary").exists()


def test_documents_have_a_file_each_under_their_names(spark, tmp_path):
    documents = spark.createDataFrame([(i, f"té {i}") for i in range(1, 6)], "recording_id long, text string")
    names = spark.createDataFrame([(1, "a_analysis.json"), (2, "a_analysis.json"), (3, "b.x_analysis.json"), (4, "a_analysis.json")], "recording_id long, output_name string")
    files.write_documents(documents, str(tmp_path), names, pretty=True)
    got = {k: json.loads(v) for k, v in written(tmp_path).items()}
    assert {k: v["text"] for k, v in got.items()} == {"a_analysis.json": "té 1", "a_analysis_2.json": "té 2", "a_analysis_3.json": "té 4", "b.x_analysis.json": "té 3", "5_analysis.json": "té 5"}
    assert "té 1".encode() in written(tmp_path)["a_analysis.json"] and b"\n" in written(tmp_path)["a_analysis.json"]
    read = files.read_documents(spark, str(tmp_path), documents.drop("recording_id").schema)
    assert {r.file_name: r.text for r in read.select("file_name", F.col("document.text")).collect()} == {k: v["text"] for k, v in got.items()}
