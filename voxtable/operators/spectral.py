"""What frames and their spectra tell of spans of samples: loudness, centroid, pitch, onsets.

A span is a segment or a whole recording: samples [a, b) of it. Spans are cut into chunks of frames, so a long recording is many tasks'
work; a chunk takes the samples its frames need and one frame more. One pass transforms each chunk once. A second one, of short rows,
puts the chunks of a span together. Frames are centred and zero-padded, one more than whole hops.

Onset envelope and pitch follow the public definitions of the usual audio library: mel spectrum in dB with a floor 80 below the span's
loudest value, mean rise against the frame before, moved by half a frame; spectral maxima over a tenth of the frame's largest magnitude,
refined by a parabola through three bins. Differences are those of rounding only; filters whose triangle holds no bin are silent.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxtable.operators.signal import SPEECH, Framing

#: Fixed values of onset detection: dB below the loudest, least power, and the look to either side (back, ahead) for maximum and mean.
FLOOR_DB, LEAST_POWER = 80.0, 1e-10
NEAR_MAX, NEAR_MEAN = (3, 2), (3, 4)
#: How far a peak exceeds the mean around it, and frames between two peaks.
DELTA, WAIT = 0.3, 10
#: Pitches outside are not voices; without any the pitch is DEFAULT_PITCH.
PITCH_LOW, PITCH_HIGH, DEFAULT_PITCH = 80.0, 400.0, 150.0
#: A maximum counts if it exceeds this part of the frame's largest magnitude.
PITCH_THRESHOLD = 0.1
#: Part of the frames that are silent at most, as a percentile.
SILENT = 0.2
#: Points of a span's loudness.
POINTS = 10

#: Values of frames that are transformed together, where a chunk has fewer; and no values.
VALUES, NONE = 1 << 20, np.zeros(0)

CHUNKS = "recording_id {key}, seg_idx long, chunk long, first long, n long, energy double, peak double, rms array<double>, centroid double, pitch array<double>, top double, rise array<double>, mel array<double>"
MEASURES = "recording_id {key}, seg_idx long, n_samples long, n_frames long, rms double, amplitude_max double, spectral_centroid double, pitch_hz double, n_voiced long, silence_ratio double, volume_peaks array<double>, envelope array<double>, onsets array<long>"


def hertz(mel: np.ndarray) -> np.ndarray:
    """Mels as frequencies: linear up to 1,000 Hz, logarithmic above."""
    return np.where(mel < 15, mel * 200 / 3, 1000 * np.exp(np.log(6.4) / 27 * (mel - 15)))


def mels(frequency: float) -> float:
    return frequency * 3 / 200 if frequency < 1000 else 15 + 27 / np.log(6.4) * np.log(frequency / 1000)


def mel_filters(framing: Framing) -> np.ndarray:
    """A row of weights over the bins for each filter: triangles of area one between equally spaced mels up to half the rate."""
    corner = hertz(np.linspace(0, mels(framing.rate / 2), framing.mels + 2))
    bins = np.fft.rfftfreq(framing.frame, 1 / framing.rate)
    low, mid, high = corner[:-2, None], corner[1:-1, None], corner[2:, None]
    return np.maximum(0, np.minimum((bins - low) / (mid - low), (high - bins) / (high - mid))) * 2 / (high - low)


def pitches(magnitude: np.ndarray, framing: Framing) -> np.ndarray:
    """The frequency of each frame's strongest maximum between the framing's limits, by a parabola; 0 without one."""
    m = magnitude
    before = np.concatenate((m[:, :1], m[:, :-1]), axis=1)
    after = np.concatenate((m[:, 1:], m[:, -1:]), axis=1)
    bend, slope = after + before - 2 * m, (after - before) / 2
    slope[:, [0, -1]], bend[:, [0, -1]] = 0.0, 1.0  # no parabola at the ends
    with np.errstate(divide="ignore", invalid="ignore"):
        shift = np.where(np.abs(slope) < np.abs(bend), -slope / bend, 0.0)
    frequency = np.arange(m.shape[1]) * framing.rate / framing.frame
    found = (m > before) & (m >= after) & (m > PITCH_THRESHOLD * m.max(axis=1, keepdims=True)) & (frequency >= framing.lowest) & (frequency < framing.highest)
    height = np.where(found, m + slope * shift / 2, -1.0)
    best = height.argmax(axis=1)
    row = np.arange(len(m))
    return np.where(height[row, best] >= 0, (best + shift[row, best]) * framing.rate / framing.frame, 0.0)


def rises(mel: np.ndarray, floor: float) -> np.ndarray:
    """Mean rise of each frame's dB against the frame before, all but the first's."""
    held = np.maximum(mel, floor)
    return np.maximum(held[1:] - held[:-1], 0.0).mean(axis=1)


def around(x: np.ndarray, near: tuple[int, int], fill: float) -> np.ndarray:
    """Each value with so many before and after it, fill beyond the ends."""
    back, ahead = near
    padded = np.concatenate((np.full(back, fill), x, np.full(ahead, fill)))
    return np.lib.stride_tricks.sliding_window_view(padded, back + ahead + 1)


def peaks(strength: np.ndarray, delta: float = DELTA, wait: int = WAIT) -> np.ndarray:
    """Frames that are the largest nearby and exceed the mean nearby by delta; of those, each next one more than wait on.

    Which ones follow each other is told by pointers to the next allowed frame, doubled until all lead to the end.
    """
    if not len(strength):
        return np.zeros(0, np.int64)
    top = around(strength, NEAR_MAX, -np.inf).max(axis=1)
    mean = around(strength, NEAR_MEAN, 0.0).sum(axis=1) / around(np.ones(len(strength)), NEAR_MEAN, 0.0).sum(axis=1)
    found = np.flatnonzero((strength == top) & (strength >= mean + delta))
    after = np.append(np.searchsorted(found, found + wait, "right"), len(found))
    kept = np.zeros(len(found) + 1, bool)
    kept[0] = True
    while after[0] < len(found):
        kept[after[kept]] = True
        after = after[after]
    return found[kept[:-1]]


def silence_ratio_of(rms: np.ndarray) -> float:
    """Part of the frames strictly below the percentile, which is interpolated between its neighbours."""
    order = np.sort(rms)
    at = SILENT * (len(rms) - 1)
    low = order[int(at)]
    limit = low + (order[min(int(at) + 1, len(rms) - 1)] - low) * (at - int(at))
    return float((rms < limit).mean())


def points_of(rms: np.ndarray) -> np.ndarray:
    return rms[: POINTS * (len(rms) // POINTS) : len(rms) // POINTS][:POINTS] if len(rms) >= POINTS else rms


def of_segments(segments: DataFrame, blocks: DataFrame, framing: Framing = SPEECH) -> DataFrame:
    """Spans of segments, cut to the samples that exist; those without any are left out."""
    size = blocks.groupBy("recording_id").agg(F.sum(F.size("x_raw")).alias("_size"))
    a = F.greatest(F.lit(0), F.floor(F.col("start_s") * framing.rate)).cast("long").alias("a")
    b = F.least("_size", F.floor(F.col("end_s") * framing.rate)).cast("long").alias("b")
    return segments.join(size.hint("merge"), "recording_id").select("recording_id", "seg_idx", a, b).where("b > a")


def of_recordings(blocks: DataFrame) -> DataFrame:
    """Spans of whole recordings."""
    size = blocks.groupBy("recording_id").agg(F.sum(F.size("x_raw")).cast("long").alias("b"))
    return size.select("recording_id", F.lit(0).cast("long").alias("seg_idx"), F.lit(0).cast("long").alias("a"), "b").where("b > 0")


def pieces(spans: DataFrame, blocks: DataFrame, framing: Framing) -> DataFrame:
    """The samples of each chunk: x from sample at of the span on, n samples in the whole span. Blocks and spans meet by number."""
    size, far = framing.block, framing.chunk * framing.hop
    told = spans.withColumn("block_idx", F.explode(F.sequence(F.floor(F.col("a") / size), F.floor((F.col("b") - 1) / size))))
    met = told.hint("merge").join(blocks.select("recording_id", "block_idx", "x_raw", "gain"), ["recording_id", "block_idx"])
    begin = F.greatest(F.col("a") - F.col("block_idx") * size, F.lit(0)).cast("int")
    end = F.least(F.col("b") - F.col("block_idx") * size, F.lit(size)).cast("int")
    at, n = F.col("block_idx") * size + begin - F.col("a"), F.col("b") - F.col("a")
    cut = met.select("recording_id", "seg_idx", n.alias("n"), at.alias("at"), F.slice("x_raw", begin + 1, end - begin).alias("x"), "gain")
    reach, half = F.col("at") + F.size("x") + framing.frame, framing.frame // 2
    first = F.greatest(F.lit(0), F.floor((F.col("at") - half) / far))
    last = F.least(F.floor(F.floor(F.col("n") / framing.hop) / framing.chunk), F.floor(reach / far))
    return cut.withColumn("chunk", F.explode(F.sequence(F.least(first, last), last)))


def starts_of(table: pa.Table, keys: tuple[str, ...]) -> np.ndarray:
    """Where the groups of equal keys begin in a table in order of them, and its number of rows."""
    n, new = table.num_rows, np.zeros(max(table.num_rows - 1, 0), bool)
    for k in keys:
        new |= pc.not_equal(table[k].slice(1), table[k].slice(0, n - 1)).to_numpy(zero_copy_only=False).astype(bool)
    return np.concatenate(([0], np.flatnonzero(new) + 1, [n]))


def whole_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows in order of keys as tables of whole groups, with the groups' starts; a group that goes on in the next batch waits for it."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        table = pa.Table.from_batches([*held, b]).combine_chunks()
        starts = starts_of(table, keys)
        if len(starts) > 2:
            yield table.slice(0, starts[-2]), starts[:-1]
        held = table.slice(starts[-2]).to_batches()
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, starts_of(table, keys)


def lists_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of lists, and how many each has."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype(np.int64)
    return pc.list_flatten(column).to_numpy(), lengths


def chunks(spans: DataFrame, blocks: DataFrame, framing: Framing = SPEECH) -> DataFrame:
    """One row for each chunk: its frames' loudness and pitch, and their mel spectra with that of the frame before.

    Where the chunk is the whole span its rises are told at once, and no spectra are given. Pieces come in order, and the frames of
    many short chunks, up to VALUES at a time, are transformed together.
    """
    hop, frame, half = framing.hop, framing.frame, framing.frame // 2
    key, keys = blocks.schema["recording_id"].dataType.simpleString(), ("recording_id", "seg_idx", "chunk")

    def told(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        heads = table.select([*keys, "n"]).take(pa.array(starts[:-1])).combine_chunks()
        n, chunk = (heads[c].to_numpy() for c in ("n", "chunk"))
        frames, first = 1 + n // hop, chunk * framing.chunk
        last, lead = np.minimum(frames, first + framing.chunk), (first > 0).astype(np.int64)
        low, many = (first - lead) * hop - half, last - first + lead
        length = (many - 1) * hop + frame
        begin, upto = np.cumsum(length) - length, np.cumsum(many)
        values, sizes = lists_of(table["x"])
        of, gain = np.repeat(np.arange(len(n)), np.diff(starts)), table["gain"].fill_null(0).to_numpy()
        place = np.repeat((begin - low)[of] + table["at"].to_numpy() - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(values))
        inside = (place >= np.repeat(begin[of], sizes)) & (place < np.repeat((begin + length)[of], sizes))
        x = np.zeros(length.sum())
        x[place[inside]] = (values.astype(float) * np.repeat(gain, sizes))[inside]
        view = np.lib.stride_tricks.sliding_window_view(x, frame)[np.repeat(begin - (upto - many) * hop, many) + np.arange(many.sum()) * hop]
        magnitude = np.abs(np.fft.rfft(view * hann))
        mel = 10 * np.log10(np.maximum(LEAST_POWER, (magnitude * magnitude) @ filters.T))
        total = magnitude.sum(axis=1)
        center = np.divide(magnitude @ bins, total, out=np.zeros(len(total)), where=total > 0)
        rms, tone = np.sqrt((view * view).sum(axis=1) / frame), pitches(magnitude, framing)
        out: dict[str, list] = {c: [] for c in ("energy", "peak", "rms", "centroid", "pitch", "top", "rise", "mel")}
        for g in range(len(n)):
            every, mine = slice(upto[g] - many[g], upto[g]), slice(upto[g] - many[g] + lead[g], upto[g])
            own = x[begin[g] + first[g] * hop - low[g] : begin[g] + (n[g] if last[g] == frames[g] else last[g] * hop) - low[g]]
            whole, spectra = last[g] - first[g] == frames[g], mel[every]
            row = {
                "energy": float((own * own).sum()), "peak": float(np.abs(own).max()) if len(own) else 0.0, "rms": rms[mine], "centroid": float(center[mine].sum()), "pitch": tone[mine],
                "top": float(mel[mine].max()), "rise": rises(spectra, spectra.max() - FLOOR_DB) if whole else NONE, "mel": NONE if whole else spectra.ravel(),
            }
            for c, v in row.items():
                out[c].append(v)
        ready = {c: heads[c].combine_chunks() for c in (*keys, "n")} | {"first": pa.array(first)}
        return pa.RecordBatch.from_arrays([ready[f.name].cast(f.type) if f.name in ready else pa.array(out[f.name], f.type) for f in kinds], schema=kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, keys):
            ends = np.cumsum(pc.fill_null(pc.list_value_length(table["x"]), 0).to_numpy().astype(np.int64))[starts[1:] - 1] * framing.frame_hops
            at = 0
            while at < len(ends):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + VALUES, "right")))
                yield told(table.slice(starts[at], starts[to] - starts[at]), starts[at : to + 1] - starts[at])
                at = to

    filters, bins, hann = mel_filters(framing), np.fft.rfftfreq(frame, 1 / framing.rate), 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(frame) / frame)
    kinds = arrow_schema(blocks, CHUNKS.format(key=key))
    return pieces(spans, blocks, framing).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, CHUNKS.format(key=key))


def arrow_schema(table: DataFrame, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(table.sparkSession.createDataFrame([], ddl).schema)


def measured(spans: DataFrame, blocks: DataFrame, framing: Framing = SPEECH) -> DataFrame:
    """All measures of each span with samples, one row for each. Chunks of a span are read one after another, never all mel spectra at once."""
    key, keys = blocks.schema["recording_id"].dataType.simpleString(), ("recording_id", "seg_idx")
    rows = chunks(spans, blocks, framing).repartition(*keys).withColumn("top", F.max("top").over(Window.partitionBy(*keys))).sortWithinPartitions(*keys, "chunk")

    def told(key: tuple, parts: list[tuple], n: int) -> dict:
        energy, peak, centroid, rms, tone, rise = zip(*parts, strict=True)
        rms, tone, rise = map(np.concatenate, (rms, tone, rise))
        late = min(framing.frame_hops // 2, len(rise))
        envelope = np.concatenate((np.zeros(late), rise[: len(rise) - late]))
        voice = tone[(tone > PITCH_LOW) & (tone < PITCH_HIGH)]
        return {
            "recording_id": key[0], "seg_idx": key[1], "n_samples": n, "n_frames": len(rms), "rms": float(np.sqrt(sum(energy) / n)), "amplitude_max": float(np.max(peak)),
            "spectral_centroid": sum(centroid) / len(rms), "pitch_hz": float(np.median(voice)) if len(voice) else DEFAULT_PITCH, "n_voiced": len(voice),
            "silence_ratio": silence_ratio_of(rms), "volume_peaks": points_of(rms), "envelope": envelope, "onsets": peaks(envelope),
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, parts = None, 0, []
        for b in batches:
            out = []
            lists = {c: (flat, np.concatenate(([0], np.cumsum(sizes)))) for c in ("rms", "pitch", "rise", "mel") for flat, sizes in [lists_of(b[c])]}
            plain = [b[c].to_pylist() for c in (*keys, "n", "first", "top", "energy", "peak", "centroid")]
            for k, (recording, segment, size, first, top, energy, peak, centroid) in enumerate(zip(*plain, strict=True)):
                if (recording, segment) != now:
                    if parts:
                        out.append(told(now, parts, n))
                    now, n, parts = (recording, segment), size, []
                rms, tone, rise, mel = (flat[at[k] : at[k + 1]] for flat, at in lists.values())
                rise = rises(mel.reshape(-1, framing.mels), top - FLOOR_DB) if len(mel) else rise  # no spectra where a chunk is the whole span
                parts.append((energy, peak, centroid, rms.copy(), tone.copy(), rise.copy() if first else np.append(0.0, rise)))
            if out:
                yield measures(out)
        if parts:
            yield measures([told(now, parts, n)])

    def measures(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in kinds], schema=kinds)

    kinds = arrow_schema(blocks, MEASURES.format(key=key))
    return rows.mapInArrow(run, MEASURES.format(key=key))


def spectral_centroid(blocks: DataFrame, framing: Framing = SPEECH) -> DataFrame:
    return measured(of_recordings(blocks), blocks, framing).select("recording_id", "spectral_centroid")


def median_pitch(blocks: DataFrame, framing: Framing = SPEECH) -> DataFrame:
    return measured(of_recordings(blocks), blocks, framing).select("recording_id", "pitch_hz", "n_voiced")


def onset_envelope(blocks: DataFrame, framing: Framing = SPEECH) -> DataFrame:
    """recording_id, frame_idx, strength."""
    told = measured(of_recordings(blocks), blocks, framing)
    return told.select("recording_id", F.posexplode("envelope").alias("frame_idx", "strength")).withColumn("frame_idx", F.col("frame_idx").cast("long"))


def onset_peaks(blocks: DataFrame, framing: Framing = SPEECH) -> DataFrame:
    """recording_id, peaks (frames of onsets), n_frames, n_samples."""
    return measured(of_recordings(blocks), blocks, framing).select("recording_id", F.col("onsets").alias("peaks"), "n_frames", "n_samples")


def rate_of(n_peaks: Column, n_samples: Column, framing: Framing = SPEECH) -> Column:
    """Peaks a second, between 2 and 8; 4 without length."""
    seconds = n_samples / F.lit(float(framing.rate))
    return F.when(seconds > 0, F.greatest(F.lit(2.0), F.least(F.lit(8.0), n_peaks / seconds))).otherwise(4.0)


def speaking_rate(found: DataFrame, framing: Framing = SPEECH) -> DataFrame:
    """The rate of each recording of onset_peaks()."""
    n = F.size("peaks").cast("long")
    return found.select("recording_id", n.alias("n_peaks"), rate_of(n, F.col("n_samples"), framing).alias("speaking_rate"))


# executors get what is defined here by value, so they need not have the repository on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])
