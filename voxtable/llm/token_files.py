"""Token ids as flat binary files with 64-bit document offsets, read back through memory maps.

Format, for each file number: ids.bin has the ids of all its documents one after another, little-endian unsigned, 16 bits
wide where the vocabulary allows it and 32 bits otherwise; offsets.bin has one more 64-bit offset than documents, counted in ids
from the file's start; doc_ids.bin has the 64-bit ids, 0 for null. Documents ascend by doc_id within and across files, those
without an id first; how many these are is told with each file's name, so every 64-bit id can be written. Where a file starts
in the whole sequence is the prefix sum of the files before it: a window over the list of files, one row for each.

Null and empty texts have the end id only. Repeated documents are written each time; rows that tie by doc_id are in order of
their text's hash. An empty table gives no files and no rows. Texts of any length are encoded whole. Other columns are not read, so their
names do not matter.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxtable.llm.common import by_value, new_path, stage, trim, trimmed

END_ID = 0
#: Bytes that the pieces a task remembers may take with their ids; when they are more, only those of the last slice stay.
CACHE_BYTES = 16 << 20
#: Pieces that the library gets at once, as one text.
JOINED = 1 << 14
#: Bytes of text that are encoded at once, about; a longer text goes alone.
SLICE_BYTES = 3 << 20
#: Bytes of text that a task encodes, about.
TASK_BYTES = 32 << 20
#: Tasks that a small input goes to, of a megabyte at least.
LEAST_TASKS = 24
#: Documents that a reading task gives at once.
BATCH = 5_000
FILES = "part int, path string, width int, docs long, ids long, nulls long"
#: White space that is not single or lies at an end, or is neither space nor line end, and the characters that mark cuts and ends.
ODD = r"^\s|\s\s|\s$|[\t\v\f\r\x00\x01\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{180e}\x{feff}]"
#: A comma or full stop before white space and behind something that is no letter or digit.
ODD_MARK = r"(^|[^\pL\pN])[,.](\s|$)"
LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")
#: A piece without white space but for a space before it: behind a line end it is split just as by itself.
JOINABLE = r"^ ?[^\s\x00-\x1f\x85\xa0\x{1680}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{180e}\x{feff}]+$"


def byte_letters() -> dict[int, int]:
    """How a byte-level vocabulary writes bytes: printable ones as they are, the others as the letters from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 0x100 + i for i, b in enumerate(hidden)}


LETTERS = byte_letters()


def kind_of(path: str) -> tuple[bool, bool]:
    """Whether a tokenizer's texts may be cut into pieces, and whether its model may see a piece alone.

    The whole vocabulary is read for it, so the driver does it once and tasks are told.
    """
    from tokenizers import Tokenizer

    told = json.loads(Tokenizer.from_file(path).to_str())
    first = told["pre_tokenizer"] or {}
    plain = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": first.get("trim_offsets"), "use_regex": True}
    by_piece = told["normalizer"] is None and told["model"]["type"] == "BPE" and first == plain
    return by_piece, by_piece and not told["model"].get("dropout")


class Encoder:
    """Encodes with the tokenizers library, which sees each distinct piece of text once in a while.

    A byte-level pre-tokenizer always starts a token at a single space between two other characters, and around a single line
    end, so a text may be cut there and the pieces' ids joined. Arrow cuts the texts of a slice, finds the distinct pieces,
    looks them up among the known ones and lays their ids out. New pieces go to the library many at a time, as lines of one text. Texts in which a cut is not certain are encoded whole,
    and so are all texts where the tokenizer is not a plain byte-level one.
    """

    def __init__(self, path: str, kind: tuple[bool, bool] | None = None) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.kind = pa.from_numpy_dtype(self.dtype)
        self.signs, self.sign_ids = pa.array(["", "\1"]), pa.array([[], [END_ID]], pa.list_(self.kind))  # no text, and the sign for the end id
        self.known, self.ids = self.signs, self.sign_ids
        line = self.library.encode("\n", add_special_tokens=False).ids
        self.line = line[0] if len(line) == 1 else None
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.by_piece, self.by_model = kind_of(path) if kind is None else kind

    def learn(self, pieces: pa.Array) -> pa.Array:
        """The ids of each of distinct pieces, as lists."""
        at = pc.index_in(pieces, value_set=self.known)
        new = pieces.filter(at.is_null())
        self.known, self.ids = pa.concat_arrays([self.known, new]), pa.concat_arrays([self.ids, self.listed(new)])
        at = at.fill_null(-1).to_numpy().copy()
        at[at < 0] = np.arange(len(self.known) - len(new), len(self.known))
        found = self.ids.take(pa.array(at))
        if self.known.nbytes + self.ids.nbytes > CACHE_BYTES:
            other = pc.invert(pc.is_in(pieces, value_set=self.signs))
            self.known, self.ids = pa.concat_arrays([self.signs, pieces.filter(other)]), pa.concat_arrays([self.sign_ids, found.filter(other)])
        return found

    def listed(self, pieces: pa.Array) -> pa.Array:
        """The same by the library, pieces that may be lines of one text first and the others by themselves."""
        able = pc.match_substring_regex(pieces, JOINABLE).to_numpy(zero_copy_only=False)
        if not self.by_model or self.line is None:
            able[:] = False
        data, sizes = [np.zeros(0, self.dtype)], [np.zeros(1, np.int64)]
        joined, order = pieces.filter(pa.array(able)), np.argsort(~able, kind="stable")
        for k in range(0, len(joined), JOINED):
            few = joined.slice(k, JOINED).to_pylist()
            ids = np.array(self.library.encode_batch_fast(["\n".join(["", *few])], add_special_tokens=False)[0].ids, self.dtype)
            marks = np.flatnonzero(ids == self.line)
            if len(marks) == len(few):
                data.append(np.delete(ids, marks))
                sizes.append(np.diff(marks, append=len(ids)) - 1)
            else:
                self.alone(few, data, sizes)
        self.alone(pieces.filter(pa.array(~able)).to_pylist(), data, sizes)
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(sizes)).astype(np.int32)), pa.array(np.concatenate(data)))
        return lists.take(pa.array(np.argsort(order, kind="stable")))

    def alone(self, pieces: list[str], data: list[np.ndarray], sizes: list[np.ndarray]) -> None:
        """Adds the ids of each piece to data and their number to sizes."""
        ids = [e.ids for e in self.library.encode_batch_fast(pieces, add_special_tokens=False)]
        data += [np.array(x, self.dtype) for x in ids]
        sizes.append(np.fromiter(map(len, ids), np.int64, len(ids)))

    def laid_out(self, parts: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each given as its pieces, of which \1 stands for the end id, and where each text's ids stop."""
        told = parts.flatten().dictionary_encode()
        lists = self.learn(told.dictionary).take(told.indices)
        stops = lists.offsets.to_numpy()
        return lists.flatten().to_numpy(), stops[parts.offsets.to_numpy() - parts.offsets[0].as_py()][1:].astype(np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, the end id behind each, and where each text's ids stop."""
        odd = pc.match_substring_regex(texts, ODD)
        for s in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, s))
        whole = np.ones(len(texts), bool) if not self.by_piece else odd.to_numpy(zero_copy_only=False)
        cut = pc.replace_substring(pc.replace_substring(texts, "\n", "\0\n\0"), " ", "\0 ")
        cut = pc.binary_join_element_wise(cut, "\0\1", "")
        marked = pc.replace_substring(pc.replace_substring(cut, ",\0", "\0,\0"), ".\0", "\0.\0")  # a mark between a letter or digit and a space is a token
        cut = pc.if_else(pc.match_substring_regex(texts, ODD_MARK), cut, marked)
        if not whole.any():
            return self.laid_out(pc.split_pattern(cut, "\0"))
        told: list[np.ndarray] = [np.zeros(0, self.dtype)] * len(texts)
        given = {int(i): texts[int(i)].as_py() for i in np.flatnonzero(whole)}
        odd = [i for i, t in given.items() if self.by_piece and not any(s in t for s in (*self.special, "\1"))]
        spaced = pa.array([[*LONE_SPACE.sub("\1 ", given[i]).split("\1"), "\1"] for i in odd], pa.list_(pa.string()))
        for at, parts in ((np.flatnonzero(~whole), pc.split_pattern(cut.filter(pa.array(~whole)), "\0")), (odd, spaced)):
            if len(at):
                ids, stops = self.laid_out(parts)
                for i, x in zip(at, np.split(ids, stops[:-1]), strict=True):
                    told[i] = x
        for i in given.keys() - set(odd):
            told[i] = np.array([*self.library.encode(given[i], add_special_tokens=False).ids, END_ID], self.dtype)
        return np.concatenate(told), np.cumsum(list(map(len, told)), dtype=np.int64)


def slices(b: pa.RecordBatch, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about so many bytes of text."""
    size = np.cumsum(pc.fill_null(pc.binary_length(b["text"]), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < b.num_rows:
        stop = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
        yield b.slice(at, stop - at)
        at = stop


def write_files(documents: DataFrame, tokenizer: str, folder: str) -> DataFrame:
    """Writes documents (doc_id, text) and gives (part, path, width, docs, ids) of each file.

    File names carry the attempt's number and only committed attempts are listed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, top = fs.FileSystem.from_uri(folder)
        store.create_dir(top)
        path = f"{top}/{task.partitionId():06d}-{task.taskAttemptId()}"
        encoder = Encoder(tokenizer, kind)
        docs = ids = nulls = 0
        outs = {}
        for b in batches:
            if not outs:
                outs = {x: store.open_output_stream(f"{path}.{x}.bin") for x in ("ids", "offsets", "doc_ids")}
                outs["offsets"].write(np.zeros(1, "<i8").tobytes())
            for part in slices(b):
                data, stops = encoder.encode(pc.fill_null(part["text"], ""))
                outs["ids"].write(data.astype(encoder.dtype, copy=False).tobytes())
                outs["offsets"].write((ids + stops).astype("<i8").tobytes())
                outs["doc_ids"].write(part["doc_id"].fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                docs, ids, nulls = docs + part.num_rows, ids + int(stops[-1]), nulls + part["doc_id"].null_count
        for out in outs.values():
            out.close()
        found = [docs] if docs else []
        one = lambda x, kind: pa.array([x] * len(found), kind)
        yield pa.RecordBatch.from_pydict({
            "part": one(task.partitionId(), pa.int32()), "path": one(path, pa.string()), "width": one(encoder.dtype.itemsize, pa.int32()),
            "docs": pa.array(found, pa.int64()), "ids": one(ids, pa.int64()), "nulls": one(nulls, pa.int64()),
        })

    kind = kind_of(tokenizer)
    trim()  # of what the vocabulary took
    ordered = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("tie"))
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ordered = ordered.repartitionByRange(max(size // TASK_BYTES, min(LEAST_TASKS, size >> 20), 1), "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    return stage(ordered.select("doc_id", "text").mapInArrow(trimmed(run), FILES), "token-files")


def read_files(files: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the memory-mapped files."""
    before = F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    based = stage(files.withColumn("base", F.coalesce(before, F.lit(0))), "token-bases")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        if isinstance(store, fs.LocalFileSystem):
            store = fs.LocalFileSystem(use_mmap=True)
        for b in batches:
            for r in b.to_pylist():
                dtype = np.dtype("<u2" if r["width"] == 2 else "<u4")
                opened = [store.open_input_file(f"{r['path']}.{x}.bin") for x in ("offsets", "doc_ids", "ids")]
                with opened[0] as f, opened[1] as g, opened[2] as h:
                    for at in range(0, r["docs"], BATCH):
                        n = min(BATCH, r["docs"] - at)
                        offsets = np.frombuffer(f.read_at((n + 1) * 8, at * 8), "<i8")
                        doc_ids = np.frombuffer(g.read_at(n * 8, at * 8), "<i8")
                        ids = np.frombuffer(h.read_at(int(offsets[-1] - offsets[0]) * r["width"], int(offsets[0]) * r["width"]), dtype)
                        crc = [zlib.crc32(ids[x:y].astype("<u4")) for x, y in zip(offsets[:-1] - offsets[0], offsets[1:] - offsets[0], strict=True)]
                        known = np.arange(at, at + n) >= r["nulls"]  # rows without an id come first
                        yield pa.RecordBatch.from_pydict({
                            "doc_id": pa.array(doc_ids, pa.int64(), mask=~known), "start": pa.array(offsets[:-1] + r["base"], pa.int64()),
                            "n_tokens": pa.array(np.diff(offsets), pa.int64()), "ids_crc32": pa.array(crc, pa.int64()),
                        })

    return based.repartition(max(1, files.count()), "path").mapInArrow(trimmed(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(documents: DataFrame, tokenizer: str) -> DataFrame:
    """Writes documents (doc_id, text) to token files in the shared folder and reads every document back."""
    folder = new_path(documents.sparkSession, "tokens")
    return read_files(write_files(documents, tokenizer, folder), folder)


by_value(__name__)
