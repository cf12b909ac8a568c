"""Segment timelines: duplicates, gaps, merging, gap filling, word timings, chunks.

Segments are rows (recording_id, seg_idx, start_s, end_s, speaker, text), perhaps with words, an array of structs, and more. Neighbours and
running sums go by chunks of a recording (scan.py). Strict thresholds, ties and "first wins" follow seg_idx.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxtable.functions.numbers import rounded, stripped
from voxtable.operators import scan
from voxtable.operators.signal import SPEECH, Framing, interval_rms

#: Pauses of over so many seconds are gaps; shorter ones join segments.
PAUSE = 0.5


def by_start() -> WindowSpec:
    return Window.partitionBy("recording_id").orderBy("start_s", "seg_idx")


def by_index() -> WindowSpec:
    return Window.partitionBy("recording_id").orderBy("seg_idx")


def dedup_segments(segments: DataFrame) -> DataFrame:
    """The first row of each recording, rounded start, rounded end and trimmed text."""
    key = Window.partitionBy("recording_id", rounded("start_s", 2), rounded("end_s", 2), stripped("text")).orderBy("seg_idx")
    return segments.withColumn("_n", F.row_number().over(key)).where("_n = 1").drop("_n")


def with_gaps(segments: DataFrame, recordings: DataFrame) -> DataFrame:
    """Each segment with the gap before it and after it: before_start, before_end, after_start, after_end, null where there is none."""
    told = segments.join(recordings.select("recording_id", "duration_s"), "recording_id", "left")
    told = scan.neighbours(told, scan.by_time("start_s"), ["start_s", "seg_idx"], {"_prev": "end_s"}, {"_next": "start_s"})
    first, last = F.col("_prev").isNull(), F.col("_next").isNull()
    before = F.when(first, F.col("start_s") > PAUSE).otherwise(F.col("start_s") - F.col("_prev") > PAUSE)
    after = F.when(last, F.col("duration_s") - F.col("end_s") > PAUSE).otherwise(F.col("_next") - F.col("end_s") > PAUSE)
    return told.withColumns({
        "before_start": F.when(before, F.coalesce("_prev", F.lit(0.0))), "before_end": F.when(before, F.col("start_s")),
        "after_start": F.when(after, F.col("end_s")), "after_end": F.when(after, F.coalesce("_next", "duration_s")),
        "is_first": first, "is_last": last,
    }).drop("_prev", "_next", "_head")


def detect_gaps(segments: DataFrame, recordings: DataFrame) -> DataFrame:
    """Gaps at the beginning, between neighbours in order of start, and at the end."""
    told = with_gaps(segments, recordings)
    inner = told.where("before_start is not null").select("recording_id", F.when(F.col("is_first"), "beginning").otherwise("between").alias("kind"), F.col("before_start").alias("gap_start"), F.col("before_end").alias("gap_end"))
    ending = told.where("is_last and after_start is not null").select("recording_id", F.lit("ending").alias("kind"), F.col("after_start").alias("gap_start"), F.col("after_end").alias("gap_end"))
    return inner.unionByName(ending)


def merge_segments(segments: DataFrame) -> DataFrame:
    """Joins rows, in order of seg_idx, of one speaker (null equals null) with a pause under PAUSE. The last row's end wins.

    Words are strung together; other columns are the first row's.
    """
    joined = F.col("speaker").eqNullSafe(F.col("_speaker")) & (F.col("start_s") - F.col("_end") < PAUSE)
    rows = scan.islands(segments, scan.by_number("seg_idx"), "seg_idx", {"_speaker": "speaker", "_end": "end_s"}, joined, "island")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", "text"))), lambda x: stripped(x["text"]))
    merged = F.array_join(F.filter(texts, lambda t: t != ""), " ")
    more = [c for c in segments.columns if c not in ("recording_id", "seg_idx", "start_s", "end_s", "speaker", "text", "n_merged")]
    strung = F.array_sort(F.collect_list(F.when(F.col("words").isNotNull(), F.struct("seg_idx", "words")))) if "words" in more else None
    kept = [F.when(F.size(strung) > 0, F.flatten(F.transform(strung, lambda x: x["words"]))).alias(c) if c == "words" else F.min_by(c, "seg_idx").alias(c) for c in more]
    out = rows.groupBy("recording_id", "island").agg(F.min("seg_idx").alias("seg_idx"), F.min_by("start_s", "seg_idx").alias("start_s"), F.max_by("end_s", "seg_idx").alias("end_s"), F.min_by("speaker", "seg_idx").alias("speaker"), F.count("*").alias("n_merged"), F.first("text").alias("_one"), merged.alias("_many"), *kept)
    return out.select("recording_id", "seg_idx", "start_s", "end_s", "speaker", F.when(F.col("n_merged") == 1, F.col("_one")).otherwise(F.col("_many")).alias("text"), "n_merged", *more)


#: What silence_word gives.
SILENT = T.StructType().add("word", "string").add("start_time", "double").add("end_time", "double").add("duration", "double").add("acoustic_features", T.StructType().add("volume_db", "double").add("pitch_hz", "double").add("spectral_centroid", "double"))


def widened(a: T.DataType, b: T.DataType) -> T.DataType:
    """a with the fields that only b has, at every level of structs."""
    if not (isinstance(a, T.StructType) and isinstance(b, T.StructType)):
        return a
    both = [T.StructField(f.name, widened(f.dataType, b[f.name].dataType) if f.name in b.names else f.dataType) for f in a]
    return T.StructType(both + [T.StructField(f.name, f.dataType) for f in b if f.name not in a.names])


def fitted(x: Column, have: T.DataType, want: T.DataType) -> Column:
    """x in a widened type, null in fields that it does not have."""
    if not (isinstance(have, T.StructType) and isinstance(want, T.StructType)):
        return x.cast(want)
    return F.when(x.isNotNull(), F.struct(*[(fitted(x[f.name], have[f.name].dataType, f.dataType) if f.name in have.names else F.lit(None).cast(f.dataType)).alias(f.name) for f in want]))


def words_in_order(parts: list[tuple[Column, T.DataType]]) -> Column:
    """Arrays of words (column, type of a word) as one array by start_time, or start, or 0; equal ones as they come."""
    kind = parts[0][1]
    for _, k in parts[1:]:
        kind = widened(kind, k)

    def alike(words: Column, have: T.DataType) -> Column:
        return F.coalesce(F.transform(words, lambda w: fitted(w, have, kind)), F.array().cast(T.ArrayType(kind)))

    every = F.concat(*[alike(c, k) for c, k in parts])
    begins = [n for n in ("start_time", "start") if n in kind.names]
    places = F.array_sort(F.transform(every, lambda w, i: F.struct(F.coalesce(*[w[n].cast("double") for n in begins], F.lit(0.0)).alias("at"), i.alias("i"))))
    return F.transform(places, lambda p: F.get(every, p["i"]))


def silence_word(start: str, end: str, volume_db: Column | None = None) -> Column:
    """One silent word over a gap; volume -60 where nothing was measured."""
    volume = F.lit(-60.0) if volume_db is None else F.coalesce(rounded(volume_db, 1), F.lit(-60.0))
    return F.struct(F.lit(" ").alias("word"), rounded(start, 2).alias("start_time"), rounded(end, 2).alias("end_time"), rounded(F.col(end) - F.col(start), 2).alias("duration"), F.struct(volume.alias("volume_db"), F.lit(0.0).alias("pitch_hz"), F.lit(0.0).alias("spectral_centroid")).alias("acoustic_features"))


def gap_volumes(takes: DataFrame, blocks: DataFrame, framing: Framing) -> DataFrame:
    """takes with _before_db and _after_db, the dB of the samples of the gaps that a segment takes, null where there are none."""
    gap = lambda side: F.when(F.col(f"_{side}"), F.struct(F.lit(side).alias("side"), F.col(f"{side}_start").alias("start_s"), F.col(f"{side}_end").alias("end_s")))
    gaps = takes.select("recording_id", "seg_idx", F.explode(F.array(gap("before"), gap("after"))).alias("g")).where("g is not null")
    gaps = gaps.select("recording_id", F.struct("seg_idx", "g.side").alias("seg_idx"), "g.start_s", "g.end_s")
    heard = interval_rms(gaps, blocks, framing=framing).where("rms is not null")
    volumes = heard.groupBy("recording_id", F.col("seg_idx.seg_idx").alias("seg_idx")).agg(*[F.max(F.when(F.col("seg_idx.side") == side, F.col("volume_db"))).alias(f"_{side}_db") for side in ("before", "after")])
    return takes.join(volumes.hint("merge"), ["recording_id", "seg_idx"], "left")


def fill_gaps(segments: DataFrame, recordings: DataFrame, blocks: DataFrame | None = None, framing: Framing = SPEECH) -> DataFrame:
    """Extends one neighbour over each gap, marks its text and gives it a silent word with the volume of the gap's samples in blocks.

    Where segments have words, the silent ones are put among them by start. Other columns stay.

    A gap between two goes to the earlier one where the gap's middle is no farther from it, by the double arithmetic of
    this very expression.
    """
    def to_earlier(a: str, b: str) -> Column:
        middle = (F.col(a) + F.col(b)) / 2
        return middle - F.col(a) <= F.col(b) - middle

    told = with_gaps(segments, recordings)
    takes = told.withColumns({
        "_before": F.col("before_start").isNotNull() & (F.col("is_first") | ~to_earlier("before_start", "before_end")),
        "_after": F.col("after_start").isNotNull() & (F.col("is_last") | to_earlier("after_start", "after_end")),
    })
    if blocks is not None:
        takes = gap_volumes(takes, blocks, framing)
    before, after = [F.filter(F.array(F.when(F.col(f"_{side}"), silence_word(f"{side}_start", f"{side}_end", None if blocks is None else F.col(f"_{side}_db")))), lambda w: w.isNotNull()) for side in ("before", "after")]
    more = {c: F.col(c) for c in segments.columns if c not in ("recording_id", "seg_idx", "start_s", "end_s", "speaker", "text")}
    if "words" in more:
        more["words"] = words_in_order([(before, SILENT), (F.col("words"), segments.schema["words"].dataType.elementType), (after, SILENT)])
    return takes.select(
        "recording_id", "seg_idx",
        F.when(F.col("_before"), F.col("before_start")).otherwise(F.col("start_s")).alias("start_s"),
        F.when(F.col("_after"), F.col("after_end")).otherwise(F.col("end_s")).alias("end_s"),
        "speaker",
        F.concat(F.when(F.col("_before"), "[SILENCE] ").otherwise(""), F.coalesce("text", F.lit("")), F.when(F.col("_after"), " [SILENCE]").otherwise("")).alias("text"),
        F.concat(before, after).alias("silence_words"),
        *[c.alias(n) for n, c in more.items()],
    )


def segment_preview(segments: DataFrame, count: int = 3) -> DataFrame:
    """The first and last rows of each recording."""
    back = Window.partitionBy("recording_id").orderBy(F.desc("seg_idx"))
    told = segments.withColumns({"from_start": F.row_number().over(by_index()), "from_end": F.row_number().over(back)})
    return told.where((F.col("from_start") <= count) | (F.col("from_end") <= count)).select("recording_id", "seg_idx", "start_s", "end_s", (F.col("from_start") <= count).alias("is_first"), (F.col("from_end") <= count).alias("is_last"))


def fallback_words(segments: DataFrame, volume_db: float = -25.0, blocks: DataFrame | None = None, framing: Framing = SPEECH) -> DataFrame:
    """Evenly timed words of each segment with text and a positive length; of volume_db, or with blocks as loud as each word's samples, -30 without any."""
    words = F.split(stripped("text"), r"(?U)\s+")
    told = segments.where((stripped("text") != "") & (F.col("end_s") > F.col("start_s"))).select("recording_id", "seg_idx", "start_s", "end_s", words.alias("words"))
    each = (F.col("end_s") - F.col("start_s")) / F.size("words")
    out = told.select("recording_id", "seg_idx", "start_s", each.alias("each"), F.posexplode("words").alias("word_idx", "word"))
    begin = F.col("start_s") + F.col("word_idx") * F.col("each")
    volume = F.lit(volume_db)
    if blocks is not None:
        heard = interval_rms(out.select("recording_id", F.struct("seg_idx", "word_idx").alias("seg_idx"), begin.alias("start_s"), (begin + F.col("each")).alias("end_s")), blocks, framing=framing).where("rms is not null")
        heard = heard.select("recording_id", "seg_idx.seg_idx", "seg_idx.word_idx", rounded("volume_db", 1).alias("_db"))
        out, volume = out.hint("merge").join(heard, ["recording_id", "seg_idx", "word_idx"], "left"), F.coalesce("_db", F.lit(-30.0))
    return out.select("recording_id", "seg_idx", F.col("word_idx").cast("long").alias("word_idx"), "word", rounded(begin, 2).alias("start_time"), rounded(begin + F.col("each"), 2).alias("end_time"), rounded(begin + F.col("each") - begin, 2).alias("duration"), volume.alias("volume_db"), F.lit(150.0).alias("pitch_hz"), F.lit(1500.0).alias("spectral_centroid"))


def word_segments(words: DataFrame, confidence: float = 0.95) -> DataFrame:
    """Words with both times, with the segment's speaker."""
    return words.where("word_start is not null and word_end is not null").select("recording_id", "seg_idx", "word", F.col("word_start").alias("start_time"), F.col("word_end").alias("end_time"), F.coalesce("speaker", F.lit("SPEAKER_00")).alias("speaker_id"), F.lit(confidence).alias("confidence"))


def needs_fallback_words(words: DataFrame) -> DataFrame:
    """Whether a segment has text but no word that is more than white space."""
    spoken = F.max(F.when(stripped(F.coalesce("word", F.lit(""))) != "", 1).otherwise(0)) > 0
    return words.groupBy("recording_id", "seg_idx", "text").agg(spoken.alias("has_speech_words")).select("recording_id", "seg_idx", "has_speech_words", ((stripped("text") != "") & ~F.col("has_speech_words")).alias("needs_fallback"))


def silence_chunks(gaps: DataFrame) -> DataFrame:
    """Gaps of over 2 s in about one-second parts of equal length; others whole."""
    length = F.col("gap_end") - F.col("gap_start")
    parts = F.when(length > 2.0, F.greatest(F.lit(1), F.floor(length).cast("int"))).otherwise(1)
    told = gaps.withColumns({"parts": parts, "each": length / parts})
    out = told.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    begin = F.col("gap_start") + F.col("chunk") * F.col("each")
    return out.select("recording_id", "kind", "gap_start", F.col("chunk").cast("long").alias("chunk"), rounded(begin, 2).alias("start_time"), rounded(begin + F.col("each"), 2).alias("end_time"), F.lit("SILENCE").alias("speaker"))


def timeline_chunks(segments: DataFrame, seconds: float = 30.0) -> DataFrame:
    """Speech seconds and segments in each fixed chunk of a recording."""
    last = F.greatest(F.floor(F.col("start_s") / seconds), F.ceil(F.col("end_s") / seconds) - 1)
    told = segments.where("end_s >= start_s").withColumn("chunk", F.explode(F.sequence(F.floor(F.col("start_s") / seconds), last)))
    speech = F.least("end_s", (F.col("chunk") + 1) * F.lit(seconds)) - F.greatest("start_s", F.col("chunk") * F.lit(seconds))
    return told.groupBy("recording_id", "chunk").agg(F.sum(speech).alias("speech_s"), F.count("*").alias("n_segments"))


def resegment(labelled: DataFrame, seconds: float = 2.0, least: float = 0.5, confidence: float = 0.5) -> DataFrame:
    """Segments with enough confidence cut to a fixed length; parts shorter than least go."""
    told = labelled.where((F.col("confidence") >= confidence) & (F.col("end_s") > F.col("start_s")))
    parts = F.ceil((F.col("end_s") - F.col("start_s")) / seconds).cast("int")
    out = told.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    begin = F.col("start_s") + F.col("part") * F.lit(seconds)
    cut = out.select("recording_id", "seg_idx", F.col("part").cast("long").alias("part"), begin.alias("start_s"), F.least("end_s", begin + seconds).alias("end_s"), "confidence")
    return cut.where(F.col("end_s") - F.col("start_s") >= least)
