"""Frames, pitch, onsets and features of segments against plain numpy, one frame and one peak at a time."""

import math
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxtable.operators import features, signal, spectral
from voxtable.plans import standin

SCHEMA = "recording_id long, block_idx long, x_raw array<double>, gain double"
SMALL = signal.Framing(hop=16, rate=512, block=40, mels=10)
SEGMENTS = "recording_id long, seg_idx long, start_s double, end_s double"


def blocks_of(spark, recordings, framing, gain=1.0):
    size = framing.block
    rows = [(i, k // size, (x[k : k + size] / gain).tolist(), gain) for i, x in recordings.items() for k in range(0, len(x), size)]
    return spark.createDataFrame(rows, SCHEMA)


def framed(x, f):
    padded = np.concatenate((np.zeros(f.frame // 2), x, np.zeros(f.frame)))
    return [padded[k * f.hop : k * f.hop + f.frame] for k in range(1 + len(x) // f.hop)]


def spectrum(frame):
    n = len(frame)
    return np.abs(np.fft.rfft(frame * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n))))


def triangles(f):
    """Mel filters, weight by weight, from the public definition of the scale."""
    to_mel = lambda h: h * 3 / 200 if h < 1000 else 15 + 27 * math.log(h / 1000) / math.log(6.4)
    to_hz = lambda m: m * 200 / 3 if m < 15 else 1000 * 6.4 ** ((m - 15) / 27)
    corner = [to_hz(j * to_mel(f.rate / 2) / (f.mels + 1)) for j in range(f.mels + 2)]
    out = np.zeros((f.mels, f.frame // 2 + 1))
    for j in range(f.mels):
        low, mid, high = corner[j : j + 3]
        for k in range(f.frame // 2 + 1):
            h = k * f.rate / f.frame
            side = (h - low) / (mid - low) if h <= mid else (high - h) / (high - mid)
            out[j, k] = max(0.0, side) * 2 / (high - low)
    return out


def brute_envelope(x, f):
    db = [10 * np.log10(np.maximum(1e-10, triangles(f) @ spectrum(c) ** 2)) for c in framed(x, f)]
    low = max(d.max() for d in db) - 80
    rise = [np.maximum(0, np.maximum(b, low) - np.maximum(a, low)).mean() for a, b in zip(db, db[1:], strict=False)]
    return ([0.0] * (1 + f.frame_hops // 2) + rise)[: len(db)]


def brute_peaks(x, delta=0.3, wait=10):
    out, n = [], 0
    while n < len(x):
        if x[n] == max(x[max(0, n - 3) : n + 3]) and x[n] >= np.mean(x[max(0, n - 3) : n + 5]) + delta:
            out.append(n)
            n += wait
        n += 1
    return out


def brute_pitch(x, f):
    voiced = []
    for c in framed(x, f):
        m, best = spectrum(c), (-1.0, 0.0)
        for k in range(len(m)):
            h = k * f.rate / f.frame
            left, right = m[max(k - 1, 0)], m[min(k + 1, len(m) - 1)]
            if not (f.lowest <= h < f.highest and m[k] > left and m[k] >= right and m[k] > 0.1 * m.max()):
                continue
            inside = 0 < k < len(m) - 1
            bend, slope = left + right - 2 * m[k], (right - left) / 2
            shift = -slope / bend if inside and abs(slope) < abs(bend) else 0.0
            best = max(best, (m[k] + slope * shift / 2 if inside else m[k], (k + shift) * f.rate / f.frame))
        if best[0] >= 0 and 80 < best[1] < 400:
            voiced.append(best[1])
    return float(np.median(voiced)) if voiced else 150.0, len(voiced)


def speech(seconds, rate, seed):
    """Bursts of a gliding tone with overtones, and noise."""
    r, t = np.random.default_rng(seed), np.arange(int(seconds * rate)) / rate
    base = 180 + 60 * np.sin(2 * np.pi * 0.7 * t)
    tone = sum(np.sin(2 * np.pi * np.cumsum(base * k) / rate) / k for k in (1, 2, 3))
    return 0.3 * tone * ((t * 4.3) % 1 < 0.5) * np.exp(-3 * ((t * 4.3) % 1)) + 0.002 * r.standard_normal(len(t))


@pytest.mark.parametrize(("framing", "seconds"), [(signal.SPEECH, 3.0), (replace(signal.SPEECH, block=4096, chunk=20), 2.2), (SMALL, 9.3), (replace(SMALL, chunk=7), 4.0)])
def test_measures_are_those_of_numpy(spark, framing, seconds):
    recordings = {1: speech(seconds, framing.rate, 1), 2: speech(seconds / 2, framing.rate, 2) * 0.01, 3: np.zeros(framing.hop * 5), 4: np.array([0.5])}
    blocks = blocks_of(spark, recordings, framing)
    out = {r.recording_id: r for r in spectral.measured(spectral.of_recordings(blocks), blocks, framing).collect()}
    assert set(out) == set(recordings)
    for i, x in recordings.items():
        cut, got = framed(x, framing), out[i]
        rms = np.array([np.sqrt((c * c).mean()) for c in cut])
        assert got.n_frames == len(cut) and got.n_samples == len(x)
        assert got.rms == pytest.approx(np.sqrt((x * x).mean())) and got.amplitude_max == pytest.approx(np.abs(x).max())
        hertz = np.fft.rfftfreq(framing.frame, 1 / framing.rate)
        center = [(m * hertz).sum() / m.sum() if m.sum() > 0 else 0.0 for m in map(spectrum, cut)]
        assert got.spectral_centroid == pytest.approx(np.mean(center))
        assert got.envelope == pytest.approx(brute_envelope(x, framing), abs=1e-6)
        assert got.onsets == brute_peaks(got.envelope)
        pitch, voiced = brute_pitch(x, framing)
        assert got.pitch_hz == pytest.approx(pitch) and got.n_voiced == voiced
        assert got.silence_ratio == pytest.approx((rms < np.percentile(rms, 20)).mean(), abs=1.01 / len(rms))
        step = len(rms) // 10
        assert got.volume_peaks == pytest.approx([rms[k * step] for k in range(10)] if step else rms.tolist())
    assert len(out[1].onsets) > 3


def test_filters_are_triangles_between_mels():
    for f in (signal.SPEECH, SMALL, signal.Framing(hop=128, rate=8000, mels=40)):
        assert np.allclose(spectral.mel_filters(f), triangles(f))


@pytest.mark.parametrize(("hz", "lowest"), [(223.4, 150.0), (161.9, 150.0), (123.4, 80.0)])
def test_pitch_lies_between_bins(spark, hz, lowest):
    """A bin is 7.8 Hz wide; the parabola is off by less than 1 Hz. Below the lowest pitch there is none."""
    t = np.arange(16_000) / 16_000
    framing = replace(signal.SPEECH, lowest=lowest)
    found = spectral.median_pitch(blocks_of(spark, {1: 0.5 * np.sin(2 * np.pi * hz * t)}, framing), framing).first()
    assert found.pitch_hz == pytest.approx(hz, abs=1.0) and found.n_voiced > 25


def test_peaks_keep_their_distance():
    x = np.zeros(40)
    x[[5, 12, 30]] = 5.0
    assert spectral.peaks(x).tolist() == [5, 30]
    r = random.Random(4)
    for _ in range(200):
        x = np.array([r.choice((0.0, 0.0, 0.5, 1.0, r.random())) for _ in range(r.randint(0, 120))])
        wait = r.choice((0, 1, 5, 10))
        assert spectral.peaks(x, wait=wait).tolist() == brute_peaks(x, wait=wait)


def test_a_million_peaks():
    x = np.zeros(12_000_000)
    x[::12] = 1.0
    assert spectral.peaks(x).tolist() == list(range(0, 12_000_000, 12))


def test_features_are_of_each_segment_alone(spark):
    f = replace(SMALL, chunk=30)
    x = speech(12, f.rate, 5)
    x[4000] = 3.0
    gains = blocks_of(spark, {1: x}, f, gain=0.25)
    spans = [(0, 0.0, 2.0), (1, 2.2, 5.5), (2, 7.0, 8.0), (3, 9.0, 99.0), (4, 1.2, 1.2), (5, 50.0, 51.0), (6, 3.0, 3.01)]
    segments = spark.createDataFrame([(1, *s) for s in spans] + [(2, 0, 0.0, 1.0)], SEGMENTS)
    told = features.segment_features(gains, segments, f)
    out = {(r.recording_id, r.seg_idx): r for r in told.collect()}
    assert len(out) == 8 and {k for k, r in out.items() if r.failed} == {(1, 2), (1, 4), (1, 5), (2, 0)}
    assert {out[k].speaking_rate for k in ((1, 2), (1, 4))} == {4.0} and out[2, 0].volume_peaks == [0.03] * 5
    for i, start, end in spans:
        part = x[int(start * f.rate) : int(end * f.rate)]
        if out[1, i].failed:
            continue
        n = len(brute_peaks(brute_envelope(part, f)))
        assert out[1, i].speaking_rate == pytest.approx(max(2, min(8, n / (len(part) / f.rate))), abs=0.0006)
        assert out[1, i].rms_db == pytest.approx(20 * np.log10(np.sqrt((part**2).mean()) + 1e-10), abs=0.0006)
        assert out[1, i].pitch_mean == pytest.approx(brute_pitch(part, f)[0], abs=0.0006)
        assert out[1, i].mfcc == [12.0, -8.0, 4.0]
    batch = {(r.recording_id, r.seg_idx): r.rms_db for r in features.batch_features(segments, told).collect()}
    assert batch == {k: r.rms_db for k, r in out.items()} and batch[1, 0] != batch[1, 1]
    attached = {(r.recording_id, r.seg_idx): r.volume_db for r in features.attach_features(segments, features.api_shape(told)).collect()}
    assert attached == batch
    whole = features.segment_features(gains, framing=f).first()
    assert whole.failed and whole.rms_db == -25.0


def test_samples_that_are_no_numbers_fail(spark):
    blocks = spark.createDataFrame([(1, 0, [0.1] * 39 + [float("nan")], 1.0), (2, 0, [0.1] * 40, None), (3, 0, [], 1.0)], SCHEMA)
    told = {r.recording_id: r.failed for r in features.segment_features(blocks, framing=SMALL).collect()}
    assert told == {1: True, 2: False}


def test_without_segments_or_blocks(spark):
    none, blocks = spark.createDataFrame([], SEGMENTS), spark.createDataFrame([], SCHEMA)
    assert features.segment_features(blocks, none, SMALL).count() == 0 and features.segment_features(blocks, framing=SMALL).count() == 0
    one = spark.createDataFrame([(1, 0, 0.0, 1.0)], SEGMENTS)
    assert features.segment_features(blocks, one, SMALL).first().failed


def test_a_long_recording_is_many_tasks(spark):
    """An hour at 16 kHz is in chunks of 2,048 frames."""
    blocks = spark.range(0, 600).select(F.lit(1).cast("long").alias("recording_id"), F.col("id").alias("block_idx"), F.array_repeat(F.lit(0.5), 16384).alias("x_raw"), F.lit(1.0).alias("gain"))
    framing = replace(signal.SPEECH, block=16384)
    told = spectral.chunks(spectral.of_recordings(blocks), blocks, framing).select("chunk", "first", F.size("rms").alias("n")).orderBy("chunk").collect()
    frames = 1 + 600 * 16384 // 512
    assert [r.chunk for r in told] == list(range(-(-frames // 2048))) and sum(r.n for r in told) == frames
    assert [r["first"] for r in told] == [2048 * k for k in range(len(told))]


def test_short_spans_share_calls(spark):
    """A call of Python for each segment took over a ms each; spans of one, two and many chunks go through together and stay apart."""
    framing = signal.Framing(hop=16, rate=512, block=64, mels=10, chunk=8)
    r = np.random.default_rng(5)
    sizes = {k: int(r.integers(1, 700)) for k in range(40)} | {40: 16 * 8, 41: 16 * 7, 42: 1}
    x = {k: r.normal(size=n).astype(np.float32) for k, n in sizes.items()}
    rows = [(k, i, v[at : at + 64].tolist(), 0.5) for k, v in x.items() for i, at in enumerate(range(0, len(v), 64))]
    blocks = spark.createDataFrame(rows, "recording_id long, block_idx long, x_raw array<float>, gain double")
    told = spectral.measured(spectral.of_recordings(blocks), blocks, framing)
    assert "FlatMapGroups" not in told._jdf.queryExecution().optimizedPlan().toString()
    out = {row.recording_id: row for row in told.collect()}
    assert out.keys() == x.keys()
    for k, v in x.items():
        y, n = v.astype(float) * 0.5, 1 + len(v) // 16
        padded = np.concatenate((np.zeros(32), y, np.zeros(64)))
        frames = np.stack([padded[i * 16 : i * 16 + 64] for i in range(n)])
        assert out[k].n_samples == len(v) and out[k].n_frames == n == len(out[k].envelope)
        assert math.isclose(out[k].rms, np.sqrt((y * y).mean())) and out[k].amplitude_max == np.abs(y).max()
        m = np.abs(np.fft.rfft(frames * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(64) / 64))))
        assert math.isclose(out[k].spectral_centroid, ((m @ (np.arange(33) * 8)) / m.sum(axis=1)).mean())
        db = 10 * np.log10(np.maximum(1e-10, (m * m) @ spectral.mel_filters(framing).T))
        rise = np.append(0.0, spectral.rises(db, db.max() - 80))
        late = min(2, n)
        assert np.allclose(out[k].envelope, np.concatenate((np.zeros(late), rise[: n - late])))


def test_stand_in_samples_are_those_of_the_sql(spark):
    rows = spark.sql("SELECT id AS recording_id, b AS block_idx FROM VALUES (0L), (5L), (-3L), (21L), (1033L), (NULL) AS t(id), (SELECT explode(sequence(0L, 11L)) AS b)")
    text = standin.F_AUDIO[standin.F_AUDIO.index("SELECT recording_id, block_idx") :].replace(standin.EACH_SAMPLE, standin.EACH_SAMPLE_SPARK).replace("FROM a1", "FROM {a1}")
    want = sorted(map(str, spark.sql(text, a1=rows).collect()))
    assert sorted(map(str, rows.mapInArrow(standin.sounding, "recording_id long, block_idx long, x_raw array<float>, gain double").collect())) == want
