"""SQL of the measures of spans of samples: frames of 64 samples every 16 at 512 Hz, transformed by sums of products with cosines and sines."""

from __future__ import annotations

from voxtable.operators.signal import Framing

#: The framing of f_audio: a second to a block, ten mel filters, and few frames to a chunk, so that long spans have several.
AUDIO = Framing(hop=16, rate=512, frame_hops=4, block=512, mels=10, highest=4000.0, chunk=200)

SEGMENTS = "SELECT s.recording_id, seg_idx, greatest(0, CAST(floor(start_s * 512) AS BIGINT)) AS a, least(len(x), CAST(floor(end_s * 512) AS BIGINT)) AS b FROM f_seg s JOIN au USING (recording_id)"
RECORDINGS = "SELECT recording_id, CAST(0 AS BIGINT) AS seg_idx, CAST(0 AS BIGINT) AS a, len(x) AS b FROM au"


def hz(mel: str) -> str:
    return f"(CASE WHEN {mel} < 15 THEN {mel} * 200 / 3 ELSE 1000 * exp(ln(6.4) / 27 * ({mel} - 15)) END)"


def samples(spans: str) -> str:
    """pad (recording_id, seg_idx, n, x): samples of each span between zeros; and the tables of the transform."""
    triangle = "greatest(0, least((k * 8 - hz[j]) / (hz[j + 1] - hz[j]), (hz[j + 2] - k * 8) / (hz[j + 2] - hz[j + 1]))) * 2 / (hz[j + 2] - hz[j])"
    return f"""
au AS (SELECT recording_id, flatten(list(list_transform(x_raw, lambda v: CAST(v AS DOUBLE) * gain) ORDER BY block_idx)) AS x FROM f_audio GROUP BY recording_id),
sp AS ({spans}),
pad AS (
  SELECT recording_id, seg_idx, b - a AS n, list_concat(list_concat(list_transform(range(32), lambda i: CAST(0 AS DOUBLE)), x[a + 1:b]), list_transform(range(32), lambda i: CAST(0 AS DOUBLE))) AS x
  FROM sp JOIN au USING (recording_id) WHERE b > a),
tb AS (
  SELECT list_transform(range(64), lambda i: 0.5 - 0.5 * cos(2 * pi() * i / 64)) AS hann,
    list_transform(range(33), lambda k: list_transform(range(64), lambda i: cos(2 * pi() * k * i / 64))) AS co,
    list_transform(range(33), lambda k: list_transform(range(64), lambda i: sin(2 * pi() * k * i / 64))) AS si,
    list_transform(range(12), lambda j: {hz("(j * (256 * 3.0 / 200) / 11)")}) AS hz),
mw AS (SELECT list_transform(range(1, 11), lambda j: list_transform(range(33), lambda k: CAST({triangle} AS DOUBLE))) AS w FROM tb)"""


#: Frames with loudness, magnitudes m, mel spectrum in dB, centroid and pitch.
FRAMES = """
fr AS (
  SELECT recording_id, seg_idx, p // 16 - k AS t, list(v ORDER BY p) AS f
  FROM (SELECT recording_id, seg_idx, n, unnest(x) AS v, unnest(range(len(x))) AS p FROM pad), (SELECT unnest(range(4)) AS k) WHERE p // 16 - k BETWEEN 0 AND n // 16 GROUP BY ALL),
wi AS (SELECT recording_id, seg_idx, t, sqrt(list_sum(list_transform(f, lambda v: v * v)) / 64) AS rms, list_transform(range(1, 65), lambda i: f[i] * hann[i]) AS g FROM fr, tb),
mg AS (SELECT recording_id, seg_idx, t, rms, list_transform(range(1, 34), lambda k: sqrt(pow(list_inner_product(g, co[k]), 2) + pow(list_inner_product(g, si[k]), 2))) AS m FROM wi, tb),
ca AS (
  SELECT recording_id, seg_idx, t, rms, m, list_transform(m, lambda v: v * v) AS power, list_max(m) * 0.1 AS least,
    list_transform(range(1, 34), lambda k: CASE WHEN k IN (1, 33) THEN 0.0 WHEN abs((m[k + 1] - m[k - 1]) / 2) < abs(m[k + 1] + m[k - 1] - 2 * m[k]) THEN -((m[k + 1] - m[k - 1]) / 2) / (m[k + 1] + m[k - 1] - 2 * m[k]) ELSE 0.0 END) AS shift
  FROM mg),
cb AS (
  SELECT *, list_max(list_transform(list_filter(range(20, 34), lambda k: m[k] > m[k - 1] AND (k = 33 OR m[k] >= m[k + 1]) AND m[k] > least), lambda k:
    {'height': m[k] + CASE WHEN k = 33 THEN 0.0 ELSE (m[k + 1] - m[k - 1]) / 2 * shift[k] / 2 END, 'k': -k})) AS best
  FROM ca),
sx AS MATERIALIZED (
  SELECT recording_id, seg_idx, t, rms, coalesce(list_sum(list_transform(range(1, 34), lambda k: m[k] * (k - 1) * 8)) / nullif(list_sum(m), 0), 0) AS centroid,
    CASE WHEN best IS NOT NULL THEN (-best.k - 1 + shift[-best.k]) * 8 END AS pitch, list_transform(w, lambda v: 10 * log10(greatest(1e-10, list_inner_product(power, v)))) AS db
  FROM cb, mw)"""

#: env, the onset envelope, and ons, its peaks.
ONSETS = """
fl AS (SELECT recording_id, seg_idx, t, db, lag(db) OVER w AS before, max(list_max(db)) OVER (PARTITION BY recording_id, seg_idx) - 80 AS low FROM sx WINDOW w AS (PARTITION BY recording_id, seg_idx ORDER BY t)),
ri AS (SELECT recording_id, seg_idx, t, CASE WHEN before IS NULL THEN 0 ELSE list_sum(list_transform(range(1, 11), lambda j: greatest(0, greatest(db[j], low) - greatest(before[j], low)))) / 10 END AS rise FROM fl),
env AS (SELECT recording_id, seg_idx, t, coalesce(lag(rise, 2) OVER (PARTITION BY recording_id, seg_idx ORDER BY t), 0) AS strength FROM ri),
ar AS (
  SELECT *, max(strength) OVER (PARTITION BY recording_id, seg_idx ORDER BY t ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) AS top,
    avg(strength) OVER (PARTITION BY recording_id, seg_idx ORDER BY t ROWS BETWEEN 3 PRECEDING AND 4 FOLLOWING) AS mean FROM env),
cand AS MATERIALIZED (SELECT recording_id, seg_idx, t, min(t) OVER (PARTITION BY recording_id, seg_idx ORDER BY t RANGE BETWEEN 11 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM ar WHERE strength = top AND strength >= mean + 0.3),
ons AS (
  SELECT recording_id, seg_idx, min(t) AS t FROM cand GROUP BY recording_id, seg_idx
  UNION ALL SELECT c.recording_id, c.seg_idx, c.after FROM ons JOIN cand c USING (recording_id, seg_idx, t) WHERE c.after IS NOT NULL)"""

#: me, one row of measures for each span.
MEASURES = """
ql AS (
  SELECT recording_id, seg_idx, list(rms ORDER BY t) AS loud, list_sort(list(rms)) AS v, count(*) AS n_frames, avg(centroid) AS centroid,
    coalesce(median(CASE WHEN pitch > 80 AND pitch < 400 THEN pitch END), 150) AS pitch, count(CASE WHEN pitch > 80 AND pitch < 400 THEN 1 END) AS n_voiced FROM sx GROUP BY recording_id, seg_idx),
qm AS (SELECT *, 0.2::DOUBLE * (n_frames - 1) AS q FROM ql),
qs AS (SELECT *, v[CAST(floor(q) AS BIGINT) + 1] + (v[least(CAST(floor(q) AS BIGINT) + 2, n_frames)] - v[CAST(floor(q) AS BIGINT) + 1]) * (q - floor(q)) AS lim FROM qm),
sq AS (SELECT recording_id, seg_idx, n, sqrt(list_sum(list_transform(x, lambda v: v * v)) / n) AS rms, list_max(list_transform(x, lambda v: abs(v))) AS peak FROM pad),
oc AS (SELECT recording_id, seg_idx, count(*) AS n_peaks FROM ons GROUP BY recording_id, seg_idx),
me AS (
  SELECT recording_id, seg_idx, n, n_frames, 20 * log10(rms + 1e-10) AS db, peak, centroid, pitch, n_voiced, len(list_filter(v, lambda r: r < lim)) / n_frames::DOUBLE AS silence, loud,
    coalesce(n_peaks, 0) AS n_peaks, greatest(2.0::DOUBLE, least(8.0::DOUBLE, coalesce(n_peaks, 0) / (n / 512.0::DOUBLE))) AS rate
  FROM qs JOIN sq USING (recording_id, seg_idx) LEFT JOIN oc USING (recording_id, seg_idx))"""


def measures(spans: str) -> str:
    """WITH RECURSIVE and all of the above."""
    return "WITH RECURSIVE " + ",".join((samples(spans), FRAMES, ONSETS, MEASURES)).strip()


def features(r) -> str:
    """feat, the features of each segment rounded by r(expression, places), with those of a segment that cannot be analysed."""
    numbers = {
        "rms_energy": ("exp(db / 20) * 1e-5", "0.03"), "rms_db": ("db", "-25.0"), "pitch_mean": ("pitch", "150.0"), "pitch_variance": ("100.0", "100.0"),
        "speaking_rate": ("rate", "4.0"), "amplitude_max": ("peak", "0.5"), "silence_ratio": ("silence", "0.2"), "spectral_centroid": ("centroid", "2000.0"), "zcr": ("0.05", "0.05"),
    }
    told = ", ".join(f"CASE WHEN peak <= 1 THEN {r(f'CAST({x} AS DOUBLE)', 3)} ELSE CAST({bad} AS DOUBLE) END AS {k}" for k, (x, bad) in numbers.items())
    step = "(len(loud) // 10)"
    points = ", ".join(f"CASE WHEN peak <= 1 THEN CASE WHEN len(loud) >= 10 THEN {r(f'loud[{i} * {step} + 1]', 3)} ELSE {r(f'loud[{i + 1}]', 3)} END WHEN {i} < 5 THEN CAST(0.03 AS DOUBLE) END AS peak_{i}" for i in range(10))
    return f"""{measures(SEGMENTS)},
feat AS (
  SELECT s.recording_id, s.seg_idx, {told}, CASE WHEN peak <= 1 THEN CASE WHEN db < -35 THEN 'low' WHEN db < -25 THEN 'medium' WHEN db < -15 THEN 'high' ELSE 'emphasis' END ELSE 'medium' END AS volume_category,
    {points}, NOT coalesce(peak <= 1, false) AS failed
  FROM f_seg s LEFT JOIN me USING (recording_id, seg_idx))"""
