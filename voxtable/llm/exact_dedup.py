"""Exact deduplication of a new batch against an immutable snapshot.

save_snapshot() writes a snapshot's digests in buckets, each with a static binary-fuse filter that is built once and never
changed; any number of later batches are screened by it. A batch is first grouped by its own digests (its own duplicates
never reach the filters); each distinct digest is screened by the filter of its bucket; positives join the snapshot's
digests exactly, and their texts are compared byte by byte. Of the texts only those that may be compared are shuffled.

Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the row with the largest
doc_id stays; null ids are the smallest. Among repeated rows that tie, exactly one stays. Texts of any length are hashed and compared
whole. An empty snapshot or batch gives the rows of the other. Other columns are not read, so their names do not matter.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtable.llm.common import attach, by_value, new_path, possible, stage, texts, trimmed, utf8

#: Distinct digests in a bucket, about: a filter of such a bucket has some 150 KB.
BUCKET_KEYS = 100_000
ROW = "doc_id long, text_hash long, digest binary, n_bytes long"


def digest_rows(documents: DataFrame) -> DataFrame:
    """doc_id, a hash of the text as it is, and SHA-256 and byte length of the normalised text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            told = [(hashlib.sha256(t.lower()).digest(), len(t)) for t in texts(b)]  # bytes: lower() is of A-Z only
            digests, sizes = pa.array([d for d, _ in told], pa.binary()), pa.array([n for _, n in told], pa.int64())
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["text_hash"], digests, sizes], ["doc_id", "text_hash", "digest", "n_bytes"])

    return documents.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(trimmed(run), ROW)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class FuseFilter:
    """Three-wise binary fuse filter with 8-bit fingerprints over distinct 64-bit keys: no false negatives, about 0.4 % false positives."""

    def __init__(self, seed: int, segment: int, segments: int, cells: np.ndarray) -> None:
        self.seed, self.segment, self.segments, self.cells = seed, segment, segments, cells

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The three cells of each key, in three successive segments, and its fingerprint."""
        h = mixed(keys + np.uint64(self.seed) * np.uint64(0x9E3779B97F4A7C15))
        g = mixed(h + np.uint64(1))
        first = ((h >> np.uint64(32)) * np.uint64(self.segments)) >> np.uint64(32)
        inside = np.stack([g, g >> np.uint64(20), g >> np.uint64(40)]) & np.uint64(self.segment - 1)
        cells = (first + np.arange(3, dtype=np.uint64)[:, None]) * np.uint64(self.segment) + inside
        return cells.astype(np.int64), (h & np.uint64(255)).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> FuseFilter:
        n = len(keys)
        segment = 1 << max(2, min(18, int(math.log(max(n, 2)) / math.log(3.33) + 2.25)))
        factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 3)))
        segments = max(1, math.ceil(n * factor / segment) - 2) + (n < 100)
        for seed in range(1, 1000):
            if seed % 20 == 0:
                segments += max(1, segments // 20)
            f = cls(seed, segment, segments, np.zeros((segments + 2) * segment, np.uint8))
            at, prints = f.places(keys)
            count, held = np.zeros(len(f.cells), np.int64), np.zeros(len(f.cells), np.int64)
            for row in at:
                np.add.at(count, row, 1)
                np.bitwise_xor.at(held, row, np.arange(n))
            rounds, left = [], n
            while len(single := np.flatnonzero(count == 1)):
                key, where = np.unique(held[single], return_index=True)
                rounds.append((key, single[where]))
                for row in at[:, key]:
                    np.subtract.at(count, row, 1)
                    np.bitwise_xor.at(held, row, key)
                left -= len(key)
            if left:
                continue
            for key, cell in reversed(rounds):  # a key's other two cells were settled in later rounds
                f.cells[cell] = prints[key] ^ np.bitwise_xor.reduce(f.cells[at[:, key]], axis=0)
            return f
        raise ValueError("no seed separates the keys; they are not distinct")

    def has(self, keys: np.ndarray) -> np.ndarray:
        at, prints = self.places(keys)
        return np.bitwise_xor.reduce(self.cells[at], axis=0) == prints


def filter_key() -> Column:
    return F.xxhash64(F.lit(7), "digest")


def build_filters(digests: DataFrame, buckets: int) -> DataFrame:
    """One binary-fuse filter for each bucket of a snapshot's distinct digests."""

    def build(table: pa.Table) -> pa.Table:
        f = FuseFilter.build(np.unique(table["key"].to_numpy()).view(np.uint64))
        return pa.table({"bucket": pa.array([table["bucket"][0].as_py()], pa.int64()), "seed": pa.array([f.seed], pa.int64()), "segment": pa.array([f.segment], pa.int64()), "segments": pa.array([f.segments], pa.int64()), "cells": pa.array([f.cells.tobytes()], pa.binary())})

    keyed = digests.select(F.pmod(F.xxhash64("digest"), F.lit(buckets)).alias("bucket"), filter_key().alias("key"))
    return keyed.groupBy("bucket").applyInArrow(build, "bucket long, seed long, segment long, segments long, cells binary")


def screen(digests: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """The digests (distinct ones) that the filters cannot rule out."""

    def test(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table({"digest": pa.array([], pa.binary())})
        r = right.to_pylist()[0]
        f = FuseFilter(r["seed"], r["segment"], r["segments"], np.frombuffer(r["cells"], np.uint8))
        return pa.table({"digest": left["digest"].filter(pa.array(f.has(left["key"].to_numpy().view(np.uint64))))})

    keyed = digests.select(F.pmod(F.xxhash64("digest"), F.lit(buckets)).alias("bucket"), filter_key().alias("key"), "digest")
    return keyed.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(test, "digest binary")


def same_bytes(pairs: DataFrame, documents: DataFrame) -> DataFrame:
    """Of (digest, old, new), where old and new are (doc_id, row number, text hash), the digests whose two normalised texts are identical."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            same = [x.lower() == y.lower() for x, y in zip(utf8(b["old_text"]), utf8(b["new_text"]), strict=True)]
            yield pa.RecordBatch.from_arrays([b["digest"].filter(pa.array(same, pa.bool_()))], ["digest"])

    sides = [pairs.select("digest", F.lit(f"{side}_text").alias("side"), F.col(f"{side}.doc_id").alias("id"), F.col(f"{side}.text_hash").alias("text_hash")) for side in ("old", "new")]
    wanted = stage(sides[0].unionByName(sides[1]), "dedup-wanted")
    texts = documents.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("hash"), "text")
    near = possible(texts, wanted.select(F.col("text_hash").alias("hash")), "hash").where("_may")
    found = near.join(wanted.hint("merge"), (near["hash"] == wanted["text_hash"]) & near["doc_id"].eqNullSafe(wanted["id"])).select("digest", "side", "text")
    one = found.groupBy("digest").pivot("side", ["old_text", "new_text"]).agg(F.first("text"))
    return one.mapInArrow(trimmed(compare), "digest binary")


def grouped(documents: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Writes and gives the rows of documents with their digests, and for each digest its count n and top, the row that would stay."""
    spark = documents.sparkSession
    digest_rows(documents).withColumn("row", F.monotonically_increasing_id()).write.parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows")
    top = F.max(F.struct(F.col("doc_id"), F.col("row"), F.col("text_hash"))).alias("top")
    rows.groupBy("digest").agg(top, F.count("*").alias("n")).write.parquet(f"{path}/groups")
    return rows, spark.read.parquet(f"{path}/groups")


def save_snapshot(documents: DataFrame, path: str) -> None:
    """Writes rows, groups and filters of a snapshot (doc_id, text) below path, once and for all."""
    _, groups = grouped(documents, path)
    buckets = math.ceil(groups.count() / BUCKET_KEYS) or 1
    build_filters(groups, buckets).withColumn("buckets", F.lit(buckets)).write.parquet(f"{path}/filters")


def against_snapshot(path: str, snapshot: DataFrame, batch: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for each row of a saved snapshot and of a batch (doc_id, text)."""
    spark = batch.sparkSession
    old_rows, old, filters = (spark.read.parquet(f"{path}/{x}") for x in ("rows", "groups", "filters"))
    new_rows, new = grouped(batch, new_path(spark, "dedup-batch"))
    first = filters.first()
    maybe = screen(new, filters.drop("buckets"), first["buckets"] if first else 1)
    pairs = maybe.join(new.select("digest", F.col("top").alias("new")).hint("merge"), "digest").join(old.select("digest", F.col("top").alias("old")).hint("merge"), "digest")
    sure = same_bytes(stage(pairs, "dedup-pairs"), snapshot.select("doc_id", "text").unionByName(batch.select("doc_id", "text")))
    groups = old.withColumn("part", F.lit(0)).unionByName(new.withColumn("part", F.lit(1)))
    met = stage(groups.join(sure.withColumn("met", F.lit(True)).hint("merge"), "digest", "left"), "dedup-met")
    both = met.withColumn("set", F.when(F.col("met"), 0).otherwise(F.col("part")))
    last = F.max(F.struct("top.doc_id", "part", "top.row")).alias("keep")
    whole = both.groupBy("digest", "set").agg(last, F.sum("n").alias("group_size"))
    table = both.select("digest", "set", "part", "n").join(whole.hint("merge"), ["digest", "set"])
    table = stage(table.select(F.struct("digest", "part").alias("key"), "n", "keep", "group_size"), "dedup-table")
    rows = old_rows.withColumn("part", F.lit(0)).unionByName(new_rows.withColumn("part", F.lit(1)))
    out = attach(rows.select(F.struct("digest", "part").alias("key"), "doc_id", "row"), table, "key", "n")
    kept = (F.col("row") == F.col("keep.row")) & (F.col("key.part") == F.col("keep.part"))
    return out.select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", kept.alias("kept"), F.lower(F.hex("key.digest")).alias("text_sha256"))


def exact_dedup(snapshot: DataFrame, batch: DataFrame) -> DataFrame:
    """As against_snapshot, of a snapshot that is saved first."""
    save_snapshot(snapshot, path := new_path(snapshot.sparkSession, "dedup-snapshot"))
    return against_snapshot(path, snapshot, batch)


by_value(__name__)
