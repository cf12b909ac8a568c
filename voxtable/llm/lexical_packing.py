"""Documents packed into windows of token ids beside their lexical neighbours, by a sharded BM25 index.

Terms are token ids, so document frequencies are one number for each entry of the vocabulary, counted over all documents. A term of more
than half of the documents has weight zero (BM25's own inverse document frequency, never below zero). A document's topic is its term
with the largest frequency times weight; documents go to shards of some SHARD tokens by topic, and a topic with more tokens is dealt
to several shards row by row. Each shard is one group on Spark: it builds an inverted index of its documents and fills windows. A
window's seed is what is left of the document before, or the next unused one; its unused neighbours follow in order of falling score,
whole while there is room, and the first that is too long is cut: its rest is the next seed. Without scored neighbours the next
unused document follows. So all windows of a shard are full but the last, which is cut into sequences of powers of two, and those are
not padded.

Every id lies in exactly one piece. Null and empty texts have the end id only. Repeated rows are packed each; a null doc_id stays null,
and ties are in order of the ids' checksum. Texts of any length are encoded whole. An empty table gives no rows. Other columns are not
read, so their names do not matter.
"""

from __future__ import annotations

import gc
import json
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, repeat
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtable.llm.common import by_value, mixed, new_path, stage, trim, trimmed
from voxtable.llm.token_files import LETTERS, slices

WINDOW, END_ID = 2048, 1
#: Tokens of a shard, about.
SHARD = 1 << 18
#: Constants of BM25: how soon a term's frequency saturates, and how much length counts.
SATURATION, LENGTH = 1.2, 0.75
#: Bytes that the words a task remembers may take, about, and what an entry takes besides its characters and ids.
CACHE_BYTES, ENTRY_BYTES = 128 << 20, 200
#: New words that the library gets at once.
TOGETHER = 1 << 14
#: Bytes of text that are encoded at once, about; a longer text goes alone.
SLICE_BYTES = 6 << 20
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
#: Rows of the counts that are no terms.
DOCUMENTS, TOKENS = -1, -2
#: One piece of the pre-tokenizer for certain: letters of Latin scripts that stay one when they are lowered.
SIMPLE = r"^[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}\x{131}-\x{24f}]+$"
#: A mark behind a letter in lower case: another piece begins.
MARK = r"([a-z\x{e0}-\x{f6}\x{f8}-\x{ff}])([!\"#$%&()*+,./:;=?@\[\]_{}~-])"
#: How the model spells bytes, with a line for each word.
LINES = LETTERS | {ord("\n"): ord("\n")}
#: How special tokens begin, as a pattern (which Arrow finds much faster than a substring), and what stands for the end id.
SPECIAL, END = r"<\|", "\1"
#: A tokenizer that drops white space, so that the words between it can be encoded each for itself.
WORD_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def cuts_words(tokenizer: str) -> bool:
    """Whether the words of a text may be encoded each for itself.

    The whole vocabulary is read for it, so the driver does it once and tasks are told.
    """
    from tokenizers import Tokenizer

    told = json.loads(Tokenizer.from_file(tokenizer).to_str())
    first, normal = (told["pre_tokenizer"] or {}).get("pretokenizers", [{}]), (told["normalizer"] or {}).get("normalizers")
    split = {"type": "Split", "pattern": {"Regex": WORD_PATTERN}, "behavior": "Removed", "invert": True}
    plain = told["model"]["type"] == "BPE" and not told["model"].get("dropout")
    return plain and normal == WORD_NORMALIZER and first[0] == split and first[1].get("type") == "ByteLevel" and len(first) == 2


class Encoder:
    """Encodes texts; the words and marks of a slice are cut by Arrow, and each distinct one is looked up, or encoded when it is first met.

    A known word has a row in one array of ids. New words go to the library in lists, from which only ids are kept, and one take lays out the ids of a slice.
    """

    def __init__(self, tokenizer: str, end_id: int, by_word: bool | None = None) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(tokenizer)
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.by_word, self.end_id = cuts_words(tokenizer) if by_word is None else by_word, end_id
        self.model = self.library.model
        suffix = getattr(self.model, "end_of_word_suffix", None)
        self.last = np.array([bool(suffix) and (self.library.id_to_token(k) or "").endswith(suffix) for k in range(self.library.get_vocab_size())])
        self.forget()

    def forget(self) -> None:
        self.known, self.bytes = {"": 0, END: 1}, 0
        self.ids = pa.array([[], [self.end_id]], pa.list_(pa.from_numpy_dtype(self.dtype)))

    def library_ids(self, text: str) -> bytes:
        return np.array([*self.library.encode(text, add_special_tokens=False).ids, self.end_id], self.dtype).tobytes()

    def learn(self, words: pa.Array) -> np.ndarray:
        """The rows of distinct words in ids."""
        if self.bytes > CACHE_BYTES:
            self.forget()
        told = words.to_numpy(zero_copy_only=False)
        rows = np.fromiter(map(self.known.get, told, repeat(-1)), np.int32, len(told))
        new = np.flatnonzero(rows < 0)
        found = words.take(pa.array(new))
        plain = pc.ascii_is_alpha(found).to_numpy(zero_copy_only=False)
        new, rest = new[plain], new[~plain]
        simple = pc.match_substring_regex(found.filter(pa.array(~plain)), SIMPLE).to_numpy(zero_copy_only=False)
        for part, listed in ((new, self.alone), (rest[simple], self.alone), (rest[~simple], self.apart)):
            for k in range(0, len(part), TOGETHER):
                at, few = len(self.ids), told[part[k : k + TOGETHER]].tolist()
                rows[part[k : k + TOGETHER]] = np.arange(at, at + len(few))
                self.known.update(zip(few, range(at, at + len(few)), strict=True))
                ids, sizes = listed(few)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(ids))
                self.ids = pa.concat_arrays([self.ids, lists])
                self.bytes += sum(map(len, few)) + ids.nbytes + ENTRY_BYTES * len(few)
        return rows

    def alone(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words that are one piece each, which the model may see alone, and how many each has: a word's last token shows its end."""
        text = "\n".join(words)
        spelt = text if text.isascii() else text.lower().encode().decode("latin-1").translate(LINES)
        told = chain.from_iterable(map(self.model.tokenize, spelt.split("\n")))
        ids = np.fromiter(map(attrgetter("id"), told), self.dtype)
        ends = np.flatnonzero(self.last[ids])
        return (ids, np.diff(ends, prepend=-1)) if len(ends) == len(words) and ends[-1] == len(ids) - 1 else self.apart(words)

    def apart(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of any words, each by itself, by the whole tokenizer."""
        told = self.library.encode(words, is_pretokenized=True, add_special_tokens=False)
        return np.array(told.ids, self.dtype), np.bincount(np.array(told.word_ids, np.int64), minlength=len(words))

    def encode(self, texts: pa.Array) -> pa.Array:
        """The ids of each text as bytes, the end id behind them."""
        odd = pc.or_(pc.match_substring_regex(texts, SPECIAL), pc.match_substring_regex(texts, END))
        odd = np.flatnonzero(odd.to_numpy(zero_copy_only=False)) if self.by_word else np.arange(len(texts))
        if len(odd) == len(texts):
            return pa.array(map(self.library_ids, texts.to_pylist()), pa.binary())
        # white space between a letter and a mark, or around it, changes no piece
        cut = pc.replace_substring_regex(pc.ascii_lower(texts), MARK, r"\1 \2")
        parts = pc.ascii_split_whitespace(pc.binary_join_element_wise(cut, END, " "))
        told = parts.flatten().dictionary_encode()
        rows = self.learn(told.dictionary)
        lists = self.ids.take(pa.array(rows[told.indices.to_numpy()]))
        stops = lists.offsets.to_numpy()[parts.offsets.to_numpy() - parts.offsets[0].as_py()] * self.dtype.itemsize
        out = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(stops.astype(np.int32)), pa.py_buffer(lists.flatten().to_numpy())])
        if not len(odd):
            return out
        told = out.to_pylist()
        for k in odd.tolist():
            told[k] = self.library_ids(texts[k].as_py())
        return pa.array(told, pa.binary())


def tokens(documents: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """doc_id and ids of each of documents (doc_id, text), the end id behind them; written."""
    new_path(documents.sparkSession, "packing")  # bounds what Python gets at once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer, end_id, by_word)
        gc.disable()  # what is remembered has no cycles, and to look for some takes a fifth of the time
        try:
            for b in batches:
                for part in slices(b, SLICE_BYTES):
                    yield pa.RecordBatch.from_arrays([part["doc_id"], encoder.encode(pc.fill_null(part["text"], ""))], ["doc_id", "ids"])
        finally:
            gc.enable()

    by_word = cuts_words(tokenizer)
    trim()  # of what the vocabulary took
    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return stage(rows.mapInArrow(trimmed(run), "doc_id long, ids binary"), "packing-tokens")


def flat(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a binary column and how many each row has."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    held = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
    return held.view(f"<u{width}"), np.diff(at) // width


def terms(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, frequency) of all documents, in order."""
    bits, kind = (16, np.uint32) if ids.dtype.itemsize == 2 and len(sizes) <= 1 << 16 else (32, np.uint64)
    pair = np.repeat(np.arange(len(sizes), dtype=kind) << kind(bits), sizes)
    pair |= ids
    pair.sort()
    first = np.flatnonzero(np.concatenate((np.ones(min(len(pair), 1), bool), pair[1:] != pair[:-1])))
    own = pair[first].astype(np.int64)
    return own >> bits, own & (1 << bits) - 1, np.diff(first, append=len(pair))


@dataclass(frozen=True)
class Statistics:
    """Of all documents: how many there are, their mean length, and the weight of each term."""

    documents: int
    mean: float
    weight: np.ndarray
    width: int

    def topics(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Each document's term with the largest frequency times weight; of equal ones the first."""
        doc, term, n = terms(ids, sizes)
        score = n * self.weight[term]
        first = np.flatnonzero(np.diff(doc, prepend=-1))
        best = np.flatnonzero(score == np.maximum.reduceat(score, first)[doc])
        return term[best[np.flatnonzero(np.diff(doc[best], prepend=-1))]]


def statistics(told: DataFrame, tokenizer: str) -> Statistics:
    """Document frequencies over all of tokens(): one row for each entry of the vocabulary comes to the driver."""
    from tokenizers import Tokenizer

    size = Tokenizer.from_file(tokenizer).get_vocab_size()
    width = 2 if size <= 1 << 16 else 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, documents, total = np.zeros(size, np.int64), 0, 0
        for b in batches:
            ids, sizes = flat(b["ids"], width)
            count += np.bincount(terms(ids, sizes)[1], minlength=size)
            documents, total = documents + b.num_rows, total + len(ids)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({"term": np.concatenate((used, [DOCUMENTS, TOKENS])), "n": np.concatenate((count[used], [documents, total]))})

    found = dict(told.select("ids").mapInArrow(trimmed(run), "term long, n long").groupBy("term").agg(F.sum("n")).collect())
    n, df = found.get(DOCUMENTS, 0), np.zeros(size)
    for term, count in found.items():
        if term >= 0:
            df[term] = count
    weight = np.where(df > 0, np.maximum(np.log((n - df + 0.5) / (df + 0.5)), 0.0), 0.0)
    return Statistics(n, found.get(TOKENS, 0) / max(n, 1), weight, width)


def shards_of(found: dict[int, int], shard: int = SHARD) -> dict[int, tuple[int, int]]:
    """The first shard of each topic and how many it has, from the tokens of topics."""
    out, at, room = {}, 0, shard
    for topic, n in sorted(found.items()):
        if n > shard:
            at += room < shard
            out[topic] = at, -(-n // shard)
            at, room = at + out[topic][1], shard
            continue
        if n > room:
            at, room = at + 1, shard
        out[topic] = at, 1
        room -= n
    return out


def with_shards(told: DataFrame, known: Statistics, shard: int) -> DataFrame:
    """tokens() with topic and shard. What decides about shards is one number for each topic, so for each entry of the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(known.weight), np.int64)
        for b in batches:
            ids, sizes = flat(b["ids"], known.width)
            total += np.bincount(known.topics(ids, sizes), sizes, len(total)).astype(np.int64)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"topic": used, "n": total[used]})

    sums = told.select("ids").mapInArrow(trimmed(count), "topic long, n long").groupBy("topic").agg(F.sum("n"))
    first, many = np.zeros(len(known.weight), np.int64), np.ones(len(known.weight), np.int64)
    for topic, (at, n) in shards_of(dict(sums.collect()), shard).items():
        first[topic], many[topic] = at, n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            topic = known.topics(*flat(b["ids"], known.width))
            number = mixed((row + np.arange(b.num_rows)).astype(np.uint64)) % many[topic].astype(np.uint64)
            row += b.num_rows
            columns = [pa.array(first[topic] + number.astype(np.int64)), pa.array(topic.astype(np.int64)), b["doc_id"], b["ids"]]
            yield pa.RecordBatch.from_arrays(columns, ["shard", "topic", "doc_id", "ids"])

    return told.mapInArrow(trimmed(run), "shard long, topic long, doc_id long, ids binary")


class Index:
    """BM25 over the documents of a shard: postings by term, and each document's terms."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, known: Statistics) -> None:
        doc, term, n = terms(ids, sizes)
        live = known.weight[term] > 0
        doc, term, n = doc[live], term[live], n[live]
        self.documents = len(sizes)
        norm = SATURATION * (1 - LENGTH + LENGTH * sizes[doc] / known.mean)
        weight = known.weight[term] * n * (SATURATION + 1) / (n + norm)
        self.own = np.searchsorted(doc, np.arange(len(sizes) + 1))
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[order], weight[order]
        names, self.slot = np.unique(term, return_inverse=True)
        self.bounds = np.searchsorted(term[order], np.append(names, np.iinfo(np.int64).max))

    def scores(self, seed: int) -> np.ndarray:
        """Of all documents, for the terms of one."""
        slots = self.slot[self.own[seed] : self.own[seed + 1]]
        begin, n = self.bounds[slots], self.bounds[slots + 1] - self.bounds[slots]
        at = np.arange(n.sum()) + np.repeat(begin - (np.cumsum(n) - n), n)
        return np.bincount(self.doc[at], self.weight[at], self.documents)

    def neighbours(self, seed: int, used: np.ndarray) -> list[int]:
        """Unused documents with a score, the best first, ties in order."""
        score = self.scores(seed)
        found = np.flatnonzero((score > 0) & ~used)
        return found[np.argsort(-score[found], kind="stable")].tolist()


@dataclass
class Filling:
    """Windows as they are filled: pieces (document, start, length, sequence, offset)."""

    window: int
    done: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    last: list[tuple[int, int, int]] = field(default_factory=list)
    sequence: int = 0
    filled: int = 0

    def add(self, doc: int, at: int, size: int) -> int:
        """Puts what fits of a document's rest into the window; gives how much."""
        taken = min(size - at, self.window - self.filled)
        self.last.append((doc, at, taken))
        self.filled += taken
        if self.filled == self.window:
            self.close([self.window])
        return taken

    def close(self, capacities: list[int]) -> None:
        """Ends the window as sequences of these sizes."""
        pieces = iter(self.last)
        doc, at, left = next(pieces)
        for room in capacities:
            offset = 0
            while offset < room:
                if not left:
                    doc, at, left = next(pieces)
                n = min(left, room - offset)
                self.done.append((doc, at, n, self.sequence, offset))
                at, left, offset = at + n, left - n, offset + n
            self.sequence += 1
        self.last, self.filled = [], 0


def filled(sizes: np.ndarray, index: Index, window: int) -> list[tuple[int, int, int, int, int]]:
    """The pieces of all documents of a shard."""
    used, out = np.zeros(len(sizes), bool), Filling(window)
    size, doc, at, seed, near, unused = sizes.tolist(), -1, 0, -1, None, iter(range(len(sizes)))
    while True:
        if doc < 0:  # the next document: a neighbour of the window's seed, or else the next unused one
            if seed >= 0:
                near = iter(index.neighbours(seed, used)) if near is None else near
                doc = next((d for d in near if not used[d]), -1)
            if doc < 0:
                doc = next((d for d in unused if not used[d]), -1)
            if doc < 0:
                break
            used[doc], at = True, 0
        seed = doc if seed < 0 else seed
        at += out.add(doc, at, size[doc])
        if not out.filled:  # a new window, of which a cut document is the seed
            seed, near = -1, None
        if at == size[doc]:
            doc = -1
    if out.last:
        out.close([1 << k for k in range(window.bit_length(), -1, -1) if out.filled >> k & 1])
    return out.done


def pack(documents: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, shard: int = SHARD) -> DataFrame:
    """Pieces of all documents (doc_id, text): where each lies in its document and its sequence, and its ids, little-endian and 32 bits wide."""
    told = tokens(documents, tokenizer, end_id)
    known = statistics(told, tokenizer)

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        number = rows["shard"][0].as_py()
        data = rows["ids"].to_pylist()
        doc_id, absent = rows["doc_id"].fill_null(0).to_numpy(), rows["doc_id"].is_valid().to_numpy()
        order = np.lexsort((list(map(zlib.crc32, data)), doc_id, absent, rows["topic"].to_numpy()))
        data = [np.frombuffer(data[k], f"<u{known.width}") for k in order.tolist()]
        sizes = np.array(list(map(len, data)), np.int64)
        pieces = filled(sizes, Index(np.concatenate(data), sizes, known), window)
        doc, start, length, sequence, offset = np.array(pieces, np.int64).T
        ids = [data[d][a : a + n].astype("<u4").tobytes() for d, a, n, *_ in pieces]
        return pa.table({
            "doc_id": rows["doc_id"].take(pa.array(order[doc])), "start": start, "length": length, "ids": pa.array(ids, pa.binary()),
            "doc_tokens": sizes[doc], "sequence_id": (number << 32) + sequence, "offset": offset,
        })

    return with_shards(told, known, shard).groupBy("shard").applyInArrow(run, PIECES)


def sequences(pieces: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """sequence_id, n_tokens and ids of each sequence of pack(), padded to the window unless its length is a power of two."""
    one = F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("ids"))))
    told = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.array_join(F.transform(one, lambda p: p["ids"]), "").alias("ids"))
    even = F.bit_count("n_tokens") == 1
    missing = F.when(even, 0).otherwise(window - F.col("n_tokens")).cast("int")
    pad = np.array([pad_id], "<u4").tobytes().hex().upper()
    return told.select("sequence_id", "n_tokens", F.unhex(F.concat("ids", F.repeat(F.lit(pad), missing))).alias("ids"))


by_value(__name__)
