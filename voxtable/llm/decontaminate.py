"""Benchmark decontamination by a prefix-filtered set join with exact verification.

Every run of WINDOW consecutive item words is a set of shingles (SHINGLE words each) of which a document has to contain all; an item
with fewer words is one such set. Shingles are ordered by rarity, counted over all documents. For containment of the whole set a
prefix of one shingle is enough: a document that has the window has its rarest shingle. So windows are a table keyed by their
rarest shingle, with its place; the places of these shingles in documents join that table; length and positional bounds
drop windows that would stick out of the document; and the rest are compared word by word with the words around the place.

Which shingles a pass over the documents reports is decided by a bit map of bounded size, so the benchmark may be of any
size and never passes through the driver or one task. Documents are not shuffled, but for those that may have a window.

Texts are lower-cased in A-Z only. Null and empty texts have no words; a document without words is clean. Repeated
documents are judged alike, repeated items count once by their id, and a null item_id is named "null". Columns of any name stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxtable.llm.common import WordHashes, bit_map, by_value, in_map, mixed, possible, stage, staged_alone, trimmed, utf8

WINDOW, SHINGLE = 13, 3
#: Counts that a task holds before it gives them on.
MOST_COUNTS = 200_000
#: Rows that a task gives on at once, rows of texts that it works on at once, and bytes of them, about.
BATCH, ROWS, PIECE = 5_000, 250, 1 << 17
#: A-Z become a-z; every other character below 0x80 that is no letter or digit becomes a space.
CHARACTERS = bytes(ord(c.lower()) if (c := chr(i)).isalnum() and i < 128 else i if i >= 128 else 32 for i in range(256))
#: A 64-bit value for each byte, and an odd number whose powers tell places apart.
VALUES = np.random.RandomState(4).randint(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)  # noqa: NPY002
BASE = 0x9E3779B97F4A7C15


def words(text: bytes) -> list[bytes]:
    return text.translate(CHARACTERS).split()


class Block:
    """The words of some texts: where they start and stop in data, and the number of each text's first one and, last, of all.

    Words are found and hashed by arrays over a piece of the bytes: a word's hash is a difference of running sums of its bytes' values, each
    times a power by its place, moved back to the power 0.
    """

    def __init__(self, texts: list[bytes], row: int = 0) -> None:
        self.row = row
        self.data = b" ".join(texts).translate(CHARACTERS)
        cuts = list(self.cuts())
        found = [(at, self.edges(at, end)) for at, end in cuts]
        self.pieces = [(at, end, x) for (at, end), (_, x) in zip(cuts, found, strict=True)]
        self.starts = np.concatenate([np.zeros(0, np.int64), *(x[::2] + at for at, x in found)])
        self.stops = np.concatenate([np.zeros(0, np.int64), *(x[1::2] + at for at, x in found)])
        size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.first = np.searchsorted(self.starts, np.concatenate(([0], np.cumsum(size))))
        self.owner = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def cuts(self) -> Iterator[tuple[int, int]]:
        """From and to of pieces of about PIECE bytes that cut no word."""
        at, n = 0, len(self.data)
        while at < n:
            end = n if n - at <= PIECE else self.data.rfind(b" ", at, at + PIECE) + 1 or self.data.find(b" ", at + PIECE) + 1 or n
            yield at, end
            at = end

    def edges(self, at: int, end: int) -> np.ndarray:
        """Where words start and stop, by turns."""
        inside = np.zeros(end - at + 2, np.bool_)
        np.not_equal(np.frombuffer(self.data, np.uint8, end - at, at), 32, out=inside[1:-1])
        return np.flatnonzero(inside[1:] != inside[:-1])

    def hashes(self) -> np.ndarray:
        """The 64-bit hash of each word."""
        told = [np.zeros(0, np.uint64)]
        for at, end, edges in self.pieces:
            power, back = powers(end - at + 1)
            sums = np.zeros(end - at + 1, np.uint64)
            np.cumsum(VALUES[np.frombuffer(self.data, np.uint8, end - at, at)] * power[: end - at], out=sums[1:])
            told.append(mixed((sums[edges[1::2]] - sums[edges[::2]]) * back[edges[::2]]))
        return np.concatenate(told)

    def shingles(self, size: int) -> np.ndarray:
        """The hash of each run of size words, some of them across texts."""
        if not hasattr(self, "known"):
            self.known = self.hashes()
        return WordHashes.runs(self.known, size)

    def hits(self, bits: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Number of the first word, and hash, of each run of size words of one text that may be in the map."""
        runs = self.shingles(size)
        at = np.flatnonzero(in_map(bits, runs))
        at = at[self.owner[at] == self.owner[at + size - 1]]
        return at, runs[at]


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse modulo 2^64 to the powers from 0 to n - 1; those for PIECE bytes are kept."""
    if n > PIECE + 1:
        return powers_of(BASE, n), powers_of(pow(BASE, -1, 1 << 64), n)
    if not _powers:
        _powers.extend((powers_of(BASE, PIECE + 1), powers_of(pow(BASE, -1, 1 << 64), PIECE + 1)))
    return _powers[0][:n], _powers[1][:n]


def powers_of(x: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(x))
    out[0] = 1
    return np.cumprod(out, out=out)


def blocks(b: pa.RecordBatch) -> Iterator[Block]:
    """The texts of a batch, some rows at a time; row is the number of a block's first."""
    for at in range(0, b.num_rows, ROWS):
        yield Block(utf8(b["text"].slice(at, ROWS)), at)


def word_counts(column: pa.Array) -> pa.Array:
    """How many words each text has, null as empty."""
    told = [np.diff(Block(utf8(column.slice(at, ROWS))).first) for at in range(0, len(column), ROWS)]
    return pa.array(np.concatenate([np.zeros(0, np.int64), *told]), pa.int64())


def item_shingles(items: DataFrame) -> DataFrame:
    """(item, n, place, shingle) of items (item, text): n words, and each shingle; items of fewer than SHINGLE words are one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, text in zip(b["item"], utf8(b["text"]), strict=True):
                block = Block([text])
                size = len(block.starts)
                told = block.shingles(min(SHINGLE, size)) if size else np.zeros(0, np.uint64)
                n = len(told)
                yield pa.RecordBatch.from_pydict({"item": pa.array([item.as_py()] * n, pa.string()), "n": pa.array(np.full(n, size), pa.int64()), "place": pa.array(np.arange(n), pa.int64()), "shingle": pa.array(told.view(np.int64), pa.int64())})

    return items.mapInArrow(trimmed(run), "item string, n long, place long, shingle long")


def counted(documents: DataFrame, shingles: DataFrame, sizes: list[int]) -> DataFrame:
    """(shingle, held): how often each of the shingles occurs in all documents; those that do not are left out."""
    bits = documents.sparkSession.sparkContext.broadcast(bit_map(shingles, "shingle"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        total, new, met = none, [], 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            keys, at = np.unique(np.concatenate([total[0], *new]), return_inverse=True)
            held = np.concatenate([total[1], np.ones(len(at) - len(total[1]), np.int64)])
            return keys, np.bincount(at, held, len(keys)).astype(np.int64)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"shingle": pa.array(total[0].view(np.int64)), "held": pa.array(total[1])})

        for b in batches:
            for block in blocks(b):
                for size in sizes:
                    _, found = block.hits(bits.value, size)
                    new.append(found)
                    met += len(found)
                if met > MOST_COUNTS:
                    total, new, met = summed(), [], 0
                if len(total[0]) > MOST_COUNTS:
                    yield out()
                    total = none
        total = summed()
        yield out()

    counts = documents.select("text").mapInArrow(trimmed(run), "shingle long, held long").groupBy("shingle").agg(F.sum("held").alias("held"))
    out = stage(counts.hint("merge").join(shingles, "shingle"), "bench-counts")
    bits.destroy()
    return out


def rarest(shingles: DataFrame, counts: DataFrame) -> DataFrame:
    """(shingle, item, place, first, last, size): windows of size words by their rarest shingle; first and last of the starts of an item's windows that have the same one.

    Windows whose rarest shingle no document has are left out.
    """
    told = shingles.hint("merge").join(counts, "shingle", "left").withColumn("held", F.coalesce("held", F.lit(0)))
    size = F.least(F.col("n"), F.lit(WINDOW))
    ahead = Window.partitionBy("item").orderBy("place").rowsBetween(0, WINDOW - SHINGLE)
    least = told.withColumn("least", F.min(F.struct("held", "shingle", "place")).over(ahead)).withColumn("size", size)
    windows = least.where(F.col("place") <= F.col("n") - F.col("size")).where("least.held > 0")
    at = windows.groupBy("item", "size", F.col("least.shingle").alias("shingle"), F.col("least.place").alias("key_place"))
    return at.agg(F.min("place").alias("first"), F.max("place").alias("last")).withColumnRenamed("key_place", "place")


def keyed(documents: DataFrame) -> list[Column]:
    """What tells rows apart, for rows that differ: a hash, and the id."""
    return [F.xxhash64(F.col("doc_id").cast("string"), "text").alias("key"), F.col("doc_id").cast("string").alias("own")]


def places(documents: DataFrame, keys: DataFrame, sizes: list[int]) -> DataFrame:
    """(key, own, shingle, at, low, around) of each place in documents that may have one of keys: word number at, and the words from low on that its windows can have."""
    bits = documents.sparkSession.sparkContext.broadcast(bit_map(keys, "shingle"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block in blocks(b):
                for size in sizes:
                    at, found = block.hits(bits.value, size)
                    for k in range(0, len(at), BATCH):
                        yield given(b, block, size, at[k : k + BATCH], found[k : k + BATCH])

    def given(b: pa.RecordBatch, block: Block, size: int, at: np.ndarray, found: np.ndarray) -> pa.RecordBatch:
        i = block.owner[at]
        first, stop = block.first[i], block.first[i + 1]
        low = np.maximum(first, at + size - WINDOW)
        ends = block.stops[np.minimum(stop, at + WINDOW) - 1]
        around = [b" ".join(block.data[x:y].split()) for x, y in zip(block.starts[low].tolist(), ends.tolist(), strict=True)]
        told = [pa.array(found.view(np.int64)), pa.array(at - first), pa.array(low - first), pa.array(around, pa.binary())]
        i = pa.array(i + block.row)
        return pa.RecordBatch.from_arrays([b["key"].take(i), b["own"].take(i), *told], ["key", "own", "shingle", "at", "low", "around"])

    out = documents.select(*keyed(documents), "text").mapInArrow(trimmed(run), "key long, own string, shingle long, at long, low long, around binary")
    out = stage(out, "bench-places")
    bits.destroy()
    return out


def runs_of(around: list[bytes], low: int, at: int, item: list[bytes], first: int, last: int, place: int, size: int) -> list[tuple[int, int]]:
    """From and to of the document words that are hit by the windows from first to last, of which item has the words from first on."""
    out: list[tuple[int, int]] = []
    for start in range(first, last + 1):
        a = at - place + start - low  # where the window would begin in around
        if a < 0 or a + size > len(around) or around[a : a + size] != item[start - first : start - first + size]:
            continue
        if out and out[-1][1] >= a + low:
            out[-1] = (out[-1][0], a + low + size)
        else:
            out.append((a + low, a + low + size))
    return out


def verified(candidates: DataFrame) -> DataFrame:
    """(key, own, item, start, end) of the document words that occurring windows hit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: list[tuple] = []
            columns = [b[c].to_pylist() for c in ("around", "low", "at", "words", "first", "last", "place", "size")]
            for i, (around, low, at, item, *rest) in enumerate(zip(*columns, strict=True)):
                found += [(i, x, y) for x, y in runs_of(around.split(), low, at, item.split(), *rest)]
            i = pa.array([f[0] for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays([b["key"].take(i), b["own"].take(i), b["item"].take(i), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int64())], ["key", "own", "item", "start", "end"])

    return candidates.mapInArrow(trimmed(run), "key long, own string, item string, start long, end long")


def item_words(items: DataFrame) -> DataFrame:
    """(item, words): the words of items (item, text), space between."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["item"], pa.array([b" ".join(words(t)).decode() for t in utf8(b["text"])], pa.string())], ["item", "words"])

    return items.mapInArrow(trimmed(run), "item string, words string")


@staged_alone("bench-hits")
def hits(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(key, own, n_hit, items) of each document with an occurring window; items are sorted ids."""
    bench = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("id"), F.md5(F.col("text").cast("binary")).alias("item"), "text").where("text is not null")
    items = stage(bench.groupBy("item").agg(F.first("text").alias("text")), "bench-texts")
    owners = stage(bench.select("item", "id").distinct(), "bench-owners")
    shingles = stage(item_shingles(items), "bench-shingles")
    distinct = stage(shingles.select("shingle").distinct(), "bench-distinct")
    sizes = sorted({min(r["n"], SHINGLE) for r in shingles.select(F.least("n", F.lit(SHINGLE)).alias("n")).distinct().collect()})
    counts = counted(documents, distinct, sizes)
    spans = rarest(shingles, counts)
    own = F.slice(F.split("words", " "), (F.col("first") + 1).cast("int"), (F.col("last") - F.col("first") + F.col("size")).cast("int"))
    keys = spans.join(item_words(items).hint("merge"), "item").withColumn("words", F.array_join(own, " ").cast("binary"))
    keys = stage(keys, "bench-keys")
    found = places(documents, keys.select("shingle").distinct(), sizes)
    candidates = found.distinct().join(keys.hint("merge"), "shingle")
    runs = stage(verified(candidates).distinct(), "bench-runs")
    where = runs.select("key", "own", F.explode(F.sequence("start", F.col("end") - 1)).alias("at")).distinct()
    n_hit = where.groupBy("key", "own").agg(F.count("*").alias("n_hit"))
    named = runs.select("key", "own", "item").distinct().hint("merge").join(owners, "item").select("key", "own", "id").distinct()
    ids = named.groupBy("key", "own").agg(F.array_sort(F.collect_list("id")).alias("items"))
    both = [x.withColumn("at", F.struct("key", F.coalesce("own", F.lit("")).alias("own"), F.col("own").isNull().alias("lost"))).drop("key", "own") for x in (n_hit, ids)]
    return both[0].hint("merge").join(both[1], "at").select("at", F.col("at.key").alias("key"), "n_hit", "items")


def contaminated() -> Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def match(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """row (a struct of all columns of documents), n_words, n_hit and items (sorted ids of the items with occurring windows) of each row of documents (doc_id, text)."""
    found = hits(documents, benchmark)
    key, own = keyed(documents)
    rows = documents.select(F.struct("*").alias("row"), key, own)
    n_words = F.arrow_udf(word_counts, "long")(F.col("row.text").cast("string")).alias("n_words")
    marked = possible(rows, found.select("key"), "key")
    none = [F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items")]
    far = marked.where("not _may").select("row", n_words, *none)
    at = F.struct("key", F.coalesce("own", F.lit("")).alias("own"), F.col("own").isNull().alias("lost"))
    near = marked.where("_may").withColumn("at", at).select("row", n_words, "at").join(found.drop("key").hint("merge"), "at", "left")
    return far.unionByName(near.select("row", "n_words", F.coalesce("n_hit", none[0]).alias("n_hit"), F.coalesce("items", none[1]).alias("items")))


def items_sha256() -> Column:
    return F.sha2(F.array_join("items", ",").cast("binary"), 256)


by_value(__name__)
