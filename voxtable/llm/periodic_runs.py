"""Periodic runs of words: every maximal repetition of a document, and the text with repeats collapsed.

A run is a stretch of words with smallest period q, at least LEAST words and 2 q long, that no neighbouring word extends with that
period. Candidates come from a harmonic grid: a run of period q covers two grid places q apart, which hold equal words, so n/q pairs of
places for each q find all runs. How far a pair agrees to the right and to the left is a longest-common-extension query on the words
and on the reversed words. Its structure sorts only suffixes that start at a difference cover modulo 31, some 19 % of all. Two places
reach samples after the same number of words, fewer than 31, which are compared; a sparse table over the samples' common prefixes tells
the rest. Many documents share one structure, each between separators of its own; a long one goes alone.

A document lies in one task, whatever its length; nothing is shuffled. A null text is empty; an empty one has no run and the digest of
no text. Repeated rows are each told. An empty table gives no rows. Other columns are not read, so their names do not matter.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtable.llm.common import by_value, new_path, texts, trimmed

#: Words that a run has at least.
LEAST = 12
#: A perfect difference set, so any two places reach samples after the same number of words.
MODULUS, COVER = 31, (0, 1, 3, 8, 12, 18)
#: Words that share a structure, about; a longer document has one of its own.
GROUP_WORDS = 1 << 16
#: Pairs of grid places that are looked at together, and words that are remembered.
PAIRS, KNOWN = 1 << 21, 500_000
#: Separators are numbers from here on, words are below, and 0 stands behind the end.
SEPARATOR = 1 << 31
SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def shifts() -> np.ndarray:
    """How many words to go from places of residues i and i + d until both are in the cover, by i and d."""
    out = np.full((MODULUS, MODULUS), MODULUS, np.int64)
    for i in range(MODULUS):
        for x in COVER:
            for y in COVER:
                out[i, (y - x) % MODULUS] = min(out[i, (y - x) % MODULUS], (x - i) % MODULUS)
    return out


SHIFT = shifts()


class Extensions:
    """Longest common extensions to the right in words (unsigned 32-bit), of which the last occurs once."""

    def __init__(self, words: np.ndarray) -> None:
        n = len(words)
        self.words = words
        classes = [np.arange(r, n, MODULUS) for r in COVER]
        self.places = np.concatenate(classes)
        ends = np.repeat(np.cumsum(list(map(len, classes))), list(map(len, classes)))
        padded = np.concatenate((words, np.zeros(MODULUS, words.dtype)))
        self.blocks = np.lib.stride_tricks.sliding_window_view(padded, MODULUS)[self.places].astype(">u4")
        rank = np.unique(np.ascontiguousarray(self.blocks).view(f"V{4 * MODULUS}").ravel(), return_inverse=True)[1]
        levels, step, m = [rank], 1, len(rank)
        while m and levels[-1].max() < m - 1:  # ranks of twice as many blocks, until all differ
            at = np.arange(m) + step
            after = np.where(at < ends, levels[-1][np.minimum(at, m - 1)] + 1, 0)
            levels.append(np.unique(levels[-1] * (m + 1) + after, return_inverse=True)[1])
            step *= 2
        self.rank = levels[-1]
        order = np.empty(m, np.int64)
        order[self.rank] = np.arange(m)
        self.sample = np.full(n, -1, np.int64)
        self.sample[self.places] = np.arange(m)
        self.table = [self.neighbours(order, levels, ends)]
        width = 1
        while 2 * width < m:
            low = self.table[-1]
            self.table.append(np.minimum(low[:-width], low[width:]))
            width *= 2

    def neighbours(self, order: np.ndarray, levels: list[np.ndarray], ends: np.ndarray) -> np.ndarray:
        """Common words of each sample with the one before it in order: whole equal blocks, then words of the next."""
        a, b = order[:-1].copy(), order[1:].copy()
        first = a.copy()
        for k in range(len(levels) - 1, -1, -1):
            same = (a < ends[first]) & (levels[k][np.minimum(a, len(ends) - 1)] == levels[k][np.minimum(b, len(ends) - 1)])
            a += same << k
            b += same << k
        return (a - first) * MODULUS + (self.blocks[a] != self.blocks[b]).argmax(axis=1)

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Equal words from i and from j on. i and j differ, and a separator stands behind either's text."""
        out, shift = np.zeros(len(i), np.int64), SHIFT[i % MODULUS, (j - i) % MODULUS]
        live, there = np.arange(len(i)), []
        for t in range(MODULUS):
            reached = shift[live] == t
            there.append(live[reached])
            live = live[~reached]
            live = live[self.words[i[live] + t] == self.words[j[live] + t]]
            out[live] = t + 1
            if not len(live):
                break
        at = np.concatenate(there)
        x, y = self.rank[self.sample[i[at] + shift[at]]], self.rank[self.sample[j[at] + shift[at]]]
        out[at] = shift[at] + self.least(np.minimum(x, y), np.maximum(x, y))
        return out

    def least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least of the neighbours' common words between ranks low and high."""
        out, level = np.zeros(len(low), np.int64), np.frexp(high - low)[1] - 1
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.table[k][low[at]], self.table[k][high[at] - (1 << int(k))])
        return out


def grid(sizes: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document, period, place) of all pairs to look at, some PAIRS at a time.

    A run of period q and length of at least max(least, 2 q) has one of every max(q, least - q) places whose partner q on is in it too.
    """
    periods = np.where(sizes >= least, sizes // 2, 0)
    doc = np.repeat(np.arange(len(sizes)), periods)
    q = np.arange(len(doc)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    step = np.maximum(q, least - q)
    n = (sizes[doc] - 1 - q) // step + 1
    total = np.cumsum(n)
    at = 0
    while at < len(doc):
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, "right")))
        d, p, s, c = doc[at:stop], q[at:stop], step[at:stop], n[at:stop]
        place = (np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)) * np.repeat(s, c)
        yield np.repeat(d, c), np.repeat(p, c), place
        at = stop


def runs(documents: list[np.ndarray], least: int = LEAST) -> np.ndarray:
    """Rows (document, start, length, period) of all runs, in order of document, start and period. Words are numbers from 1 on."""
    sizes = np.array(list(map(len, documents)), np.int64)
    if not len(sizes) or sizes.max() < least:
        return np.zeros((0, 4), np.int64)
    parts = [np.array([SEPARATOR], np.uint32)]
    for k, d in enumerate(documents):
        parts += [d.astype(np.uint32), np.array([SEPARATOR + k + 1], np.uint32)]
    words = np.concatenate(parts)
    begins = 1 + np.cumsum(sizes + 1) - (sizes + 1)
    right = left = None
    found = []
    for doc, q, place in grid(sizes, least):
        i = begins[doc] + place
        same = np.flatnonzero(words[i] == words[i + q])
        doc, q, place, i = doc[same], q[same], place[same], i[same]
        if not len(i):
            continue
        if right is None:
            right, left = Extensions(words), Extensions(words[::-1].copy())
        ahead = right.common(i, i + q)
        back = left.common(len(words) - i, len(words) - i - q)
        length = q + ahead + back
        keep = length >= np.maximum(least, 2 * q)
        found.append(np.stack((doc, place - back, length, q), 1)[keep])
    if not found:
        return np.zeros((0, 4), np.int64)
    told = np.concatenate(found)
    told = told[np.lexsort(told.T[::-1])]  # by document, start, length, period: of equal stretches the first has the smallest period
    first = np.ones(len(told), bool)
    first[1:] = (told[1:, :3] != told[:-1, :3]).any(axis=1)
    told = told[first]
    return told[np.lexsort((told[:, 3], told[:, 1], told[:, 0]))]


def kept_words(n: int, found: np.ndarray) -> np.ndarray:
    """Numbers of the words that no run has behind its first period; found: rows (start, length, period)."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, found[:, 0] + found[:, 2], 1)
    np.add.at(change, found[:, 0] + found[:, 1], -1)
    return np.flatnonzero(np.cumsum(change[:-1]) == 0)


def as_they_are(doc_id: int | None, n: int) -> np.ndarray | None:
    return None


def made_periodic(doc_id: int | None, n: int) -> np.ndarray | None:
    """For one id in ten the words that stand for words 0 to n - 1: from a word on, a stretch of them over and over. Null ids change nothing."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % (1 + (n - a) // (3 + g % 8)))


class Reader:
    """Words of texts as numbers from 1 on, which hold within a group."""

    def __init__(self) -> None:
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = defaultdict(count(1).__next__)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.known.__getitem__, words), np.uint32, len(words))


def find_runs(documents: DataFrame, least: int = LEAST, order: Callable[[int | None, int], np.ndarray | None] = as_they_are) -> DataFrame:
    """doc_id, n_words, runs and the collapsed text of each of documents (doc_id, text). order may put other words of a document in its words' places."""
    new_path(documents.sparkSession, "runs")  # bounds what Python gets at once

    def group(ids: list, all_words: list[list[bytes]], places: list, numbers: list[np.ndarray]) -> pa.RecordBatch:
        told = runs(numbers, least)
        cuts = np.searchsorted(told[:, 0], np.arange(len(ids) + 1))
        out = []
        for k, words in enumerate(all_words):
            own = told[cuts[k] : cuts[k + 1], 1:]
            if len(own) or places[k] is not None:
                at = kept_words(len(words), own)
                at = at if places[k] is None else places[k][at]
                words = [words[x] for x in at.tolist()]
            out.append(b" ".join(words))
        offsets = pa.array(cuts.astype(np.int32))
        rows = pa.StructArray.from_arrays([pa.array(told[:, c]) for c in (1, 2, 3)], ["start", "length", "period"])
        return pa.RecordBatch.from_pydict({
            "doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(list(map(len, all_words)), pa.int64()),
            "runs": pa.ListArray.from_arrays(offsets, rows), "collapsed": pa.array(out, pa.binary()).cast(pa.string()),
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for b in batches:
            held: tuple[list, list, list, list] = ([], [], [], [])
            size = 0
            for doc_id, text in zip(b["doc_id"].to_pylist(), texts(b), strict=True):
                words = text.split()  # at bytes 0x20 and 0x09 to 0x0D
                if size and size + len(words) > GROUP_WORDS:
                    yield group(*held)
                    held, size = ([], [], [], []), 0
                    if len(reader.known) > KNOWN:
                        reader.forget()
                place, numbers = order(doc_id, len(words)), reader.numbers(words)
                for x, v in zip(held, (doc_id, words, place, numbers if place is None else numbers[place]), strict=True):
                    x.append(v)
                size += len(words)
            if held[0]:
                yield group(*held)

    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(trimmed(run), SCHEMA)


def digests(found: DataFrame) -> DataFrame:
    """n_runs, the longest run (ties: smallest start, then period), and digests of all runs and of the collapsed text."""
    key = F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("a"), (-r["period"]).alias("b")))
    told = found.withColumn("_best", F.array_max(key))  # null without runs
    told = told.withColumns({"start": -F.col("_best.a"), "length": F.col("_best.length"), "period": -F.col("_best.b")})
    line = F.transform("runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]))
    lines = F.array_join(F.transform(line, lambda x: F.concat(x, F.lit("\n"))), "")
    exponent = F.expr("(length * 1000) div period").alias("exponent_milli")
    hashes = [F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")]
    return told.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "start", "length", "period", exponent, *hashes)


by_value(__name__)
