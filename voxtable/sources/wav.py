"""WAV files as blocks of mono samples, read by ranges of samples.

    spark.read.format("wav_blocks").option("path", folder).load()

The driver lists files and sizes only. A task has ranges of files, many small ones or a part of a large one: it reads the header, which is
a few bytes, and then only the samples of its blocks. Samples may be 8, 16, 24 or 32 bits wide or floats of 32 or 64 bits; channels are
averaged. With the option rate samples are put at that rate by a windowed sine; what a block needs beyond its ends is read with it.
Options start and end (seconds) keep the blocks that have samples of [start, end); block is their size.
A file that is no such WAV gives one row with error set, and other files are not touched by it.
"""

from __future__ import annotations

import struct
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, gcd

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "path string, block_idx long, x array<float>, sample_rate int, error string"
#: Bytes of files that a task reads, and samples that it has at a time, about.
TASK_BYTES, AT_ONCE = 64 << 20, 1 << 19
#: Format tags of a WAV header.
PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE
#: Zero crossings of the sine to either side when samples are put at another rate.
CROSSINGS = 24
BLOCK = 512
UNKNOWN_SIZE = 0xFFFFFFFF


@dataclass(frozen=True)
class Header:
    """Where a file's samples are and how they are written. frames: samples of each channel."""

    kind: int
    channels: int
    rate: int
    width: int
    at: int
    frames: int

    @property
    def frame(self) -> int:
        return self.width * self.channels


def header(file: pa.NativeFile, size: int) -> Header:
    """Reads the chunks up to the samples. A length that is unknown or goes beyond the file ends with the file."""
    head = file.read_at(12, 0)
    if len(head) < 12 or head[:4] not in (b"RIFF", b"RF64") or head[8:] != b"WAVE":
        raise ValueError("no RIFF header")
    at, form, wide = 12, None, None
    while at + 8 <= size:
        name, length = struct.unpack("<4sI", file.read_at(8, at))
        at += 8
        if name == b"ds64":
            wide = struct.unpack("<Q", file.read_at(8, at + 8))[0]
        elif name == b"fmt ":
            told = file.read_at(min(length, 40), at)
            if len(told) < 16:
                raise ValueError("short format")
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", told[:16])
            if kind == EXTENSIBLE and len(told) >= 26:
                kind = struct.unpack("<H", told[24:26])[0]
            if (kind, bits) not in {(PCM, 8), (PCM, 16), (PCM, 24), (PCM, 32), (FLOAT, 32), (FLOAT, 64)}:
                raise ValueError(f"format {kind} of {bits} bits")
            if not channels or not rate:
                raise ValueError("no channels or no rate")
            form = kind, channels, rate, bits // 8
        elif name == b"data":
            if form is None:
                raise ValueError("samples before their format")
            length = wide if length == UNKNOWN_SIZE and wide is not None else length
            there = size - at if length in (0, UNKNOWN_SIZE) else min(length, size - at)
            return Header(*form, at, max(there, 0) // (form[1] * form[3]))
        at += length + length % 2
    raise ValueError("no samples")


def decoded(data: bytes, h: Header) -> np.ndarray:
    """Samples between -1 and 1, the mean of all channels."""
    if h.kind == FLOAT:
        x = np.frombuffer(data, f"<f{h.width}").astype(np.float64)
    elif h.width == 1:
        x = (np.frombuffer(data, np.uint8).astype(np.float64) - 128) / 128
    elif h.width == 3:
        parts = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((parts[:, 0] << 8 | parts[:, 1] << 16 | parts[:, 2] << 24) >> 8) / float(1 << 23)
    else:
        x = np.frombuffer(data, f"<i{h.width}") / float(1 << (8 * h.width - 1))
    return x.reshape(-1, h.channels).mean(axis=1)


class Samples:
    """A file's samples at a rate, of which any range can be read."""

    def __init__(self, file: pa.NativeFile, h: Header, rate: int | None) -> None:
        self.file, self.header, self.rate = file, h, rate or h.rate
        both = gcd(h.rate, self.rate)
        self.up, self.down = self.rate // both, h.rate // both
        self.count = -(-h.frames * self.up // self.down)

    def own(self, first: int, last: int) -> np.ndarray:
        """Samples [first, last) as they are in the file, zeros beyond its ends."""
        a, b = min(max(first, 0), self.header.frames), min(max(last, 0), self.header.frames)
        x = np.zeros(last - first)
        if b > a:
            size = self.header.frame
            x[a - first : b - first] = decoded(self.file.read_at((b - a) * size, self.header.at + a * size), self.header)
        return x

    def read(self, first: int, last: int) -> np.ndarray:
        """Samples [first, last) at the rate; last is at most count. Each is a sum of those around it in the file, below the lower half rate."""
        if self.up == self.down:
            return self.own(first, last)
        narrow = min(1.0, self.up / self.down)
        reach = ceil(CROSSINGS / narrow)
        n = np.arange(first, last)
        whole, rest = n * self.down // self.up, n * self.down % self.up
        low = int(whole[0]) - reach
        x = self.own(low, int(whole[-1]) + reach + 1)
        taps = np.arange(-reach, reach + 1)
        phases, which = np.unique(rest, return_inverse=True)
        off = taps[None] - (phases / self.up)[:, None]
        weight = narrow * np.sinc(narrow * off) * np.where(np.abs(off) <= reach, np.cos(np.pi * off / (2 * reach)) ** 2, 0.0)
        view = np.lib.stride_tricks.sliding_window_view(x, len(taps))
        out = np.empty(len(n))
        for p in range(len(phases)):
            at = np.flatnonzero(which == p)
            out[at] = view[whole[at] - reach - low] @ weight[p]
        return out


@dataclass
class Ranges(InputPartition):
    """(path, size, part, of parts) of files; a part has the blocks whose number times parts, over all blocks, is its own."""

    files: list[tuple[str, int, int, int]]


class WavBlocks(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wav_blocks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WavReader(self.options)


class WavReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        number = lambda k, kind, default=None: kind(options[k]) if options.get(k) not in (None, "") else default
        self.path, self.block, self.rate = options["path"], number("block", int, BLOCK), number("rate", int)
        self.start, self.end = number("start", float), number("end", float)
        self.task_bytes = number("task_bytes", int, TASK_BYTES)

    def partitions(self) -> list[Ranges]:
        store, top = fs.FileSystem.from_uri(self.path)
        there = store.get_file_info(top)
        listed = [there] if there.type == fs.FileType.File else store.get_file_info(fs.FileSelector(top, recursive=True))
        found = sorted((f.path, f.size) for f in listed if f.type == fs.FileType.File and f.base_name.lower().endswith(".wav") and "/_" not in f.path.replace(top, "", 1))
        out, held, size = [], [], 0
        for path, n in found:
            parts = max(1, ceil(n / self.task_bytes))
            if parts > 1:
                out += [Ranges([(path, n, k, parts)]) for k in range(parts)]
                continue
            if held and size + n > self.task_bytes:
                out.append(Ranges(held))
                held, size = [], 0
            held.append((path, n, 0, 1))
            size += n
        return [*out, *([Ranges(held)] if held else [])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(self.path)
        for path, size, part, parts in partition.files:
            try:
                with store.open_input_file(path) as file:
                    samples = Samples(file, header(file, size), self.rate)
                    yield from self.blocks(path, samples, part, parts)
            except (ValueError, struct.error) as e:
                if part == 0:
                    yield self.batch([path], [None], [None], [None], [str(e)])

    def blocks(self, path: str, samples: Samples, part: int, parts: int) -> Iterator[pa.RecordBatch]:
        total = -(-samples.count // self.block)
        first, last = part * total // parts, (part + 1) * total // parts
        if self.start is not None:
            first = max(first, int(max(self.start, 0) * samples.rate) // self.block)
        if self.end is not None:
            last = min(last, -(-int(max(self.end, 0) * samples.rate) // self.block))
        many = max(1, AT_ONCE // self.block)
        for at in range(first, last, many):
            stop = min(last, at + many)
            x = samples.read(at * self.block, min(stop * self.block, samples.count)).astype(np.float32)
            cuts = np.minimum(np.arange(stop - at + 1) * self.block, len(x)).astype(np.int32)
            n = stop - at
            yield self.batch([path] * n, np.arange(at, stop), pa.ListArray.from_arrays(pa.array(cuts), pa.array(x)), [samples.rate] * n, [None] * n)

    @staticmethod
    def batch(path: list, block: list, x: list, rate: list, error: list) -> pa.RecordBatch:
        kinds = {"path": pa.string(), "block_idx": pa.int64(), "x": pa.list_(pa.float32()), "sample_rate": pa.int32(), "error": pa.string()}
        columns = [v if isinstance(v, pa.Array) else pa.array(v, k) for v, k in zip((path, block, x, rate, error), kinds.values(), strict=True)]
        return pa.RecordBatch.from_arrays(columns, list(kinds))


def read_wav(spark: SparkSession, path: str, rate: int | None = None, start: float | None = None, end: float | None = None, block: int = BLOCK) -> DataFrame:
    """Blocks of all WAV files under a path, at a rate or else their own; start and end keep the blocks of a slice."""
    spark.dataSource.register(WavBlocks)
    options = {k: str(v) for k, v in (("rate", rate), ("start", start), ("end", end), ("block", block)) if v is not None}
    return spark.read.format("wav_blocks").options(path=path, **options).load()


# executors get what is defined here by value, so they need not have the repository on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])
