"""What the operators share: the shared folder, written stages, joins that survive hot keys."""

from __future__ import annotations

import ctypes
import gc
import hashlib
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it holds more than 1/HOT of all rows, so there are fewer than HOT hot keys.
HOT = 1000
#: Bits of the map that possible() screens with. What it broadcasts is at most so many bits, 16 MB.
SLOTS = 1 << 27

#: Bytes that Spark sends to a Python worker at once, about: rows may be long, so a bound by their number alone is none.
BATCH_BYTES = 6 << 20
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

_local_dirs: dict[str, str] = {}
#: Folders of the tables that were staged for a function under staged_alone().
_staged: ContextVar[list[str] | None] = ContextVar("staged", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Where the setting is absent, a new temporary folder on a single machine and the warehouse elsewhere.
    """
    if at := spark.conf.get("spark.checkpoint.dir", None):
        return at.rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    key = spark.sparkContext.applicationId
    if key not in _local_dirs:
        _local_dirs[key] = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _local_dirs[key]


def new_path(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one. From the first on, the session's batches for Python are bounded in bytes too."""
    spark.conf.set(ARROW_BYTES, str(BATCH_BYTES))
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: lineage ends here and a lost executor costs no recomputation."""
    spark = df.sparkSession
    df.write.parquet(path := new_path(spark, name))
    if (staged := _staged.get()) is not None:
        staged.append(path)
    return spark.read.schema(df.schema).parquet(path)


def staged_alone(name: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """For functions that make a table: it is staged, and all tables that were staged on the way are deleted."""

    def of(make: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @wraps(make)
        def call(*args, **named) -> DataFrame:
            before = _staged.set([])
            try:
                out, passed = make(*args, **named), _staged.get()
            finally:
                _staged.reset(before)
            out = stage(out, name)
            context = out.sparkSession.sparkContext
            for path in passed:
                at = context._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)
            return out

        return call

    return of


def attach(rows: DataFrame, table: DataFrame, key: str, weight: str) -> DataFrame:
    """rows left join table on a non-null key that is unique in table; weight: how many of rows have the key.

    Keys that hold over 1/HOT of the rows (fewer than HOT of them by arithmetic) are joined by broadcast, the
    others by a shuffle in which no key is large; there, rows of hot keys go by their number instead of their key. A table of
    no more keys than could be hot is broadcast whole. rows are computed once.
    """
    if table.limit(HOT + 1).count() <= HOT:
        return rows.join(F.broadcast(table.drop(weight)), key, "left")
    total = table.agg(F.sum(weight)).first()[0]
    rest = [c for c in table.columns if c not in (key, weight)]
    kept = [c for c in rows.columns if c != key]
    hot = table.where(F.col(weight) > total / HOT).select(key, F.struct(*rest).alias("_hot"))
    cold = table.where(F.col(weight) <= total / HOT).select(F.struct(F.col(key).alias("key"), F.lit(-1).cast("long").alias("row")).alias("_at"), F.struct(*rest).alias("_cold"))
    marked = rows.join(F.broadcast(hot), key, "left")
    at = F.struct(F.col(key).alias("key"), F.when(F.col("_hot").isNull(), F.lit(-1).cast("long")).otherwise(F.monotonically_increasing_id()).alias("row"))
    told = marked.withColumn("_at", at).join(cold.hint("merge"), "_at", "left").withColumn("_found", F.coalesce("_hot", "_cold"))
    return told.select(key, *kept, *[F.col(f"_found.{c}").alias(c) for c in rest])


def possible(rows: DataFrame, keys: DataFrame, hashed: str) -> DataFrame:
    """rows with _may, whether their hashed (a long) may be among those of keys; where it is false it is not.

    The keys, a written table, become a map of 256 bits for each of them and SLOTS bits at most, so what is broadcast is small for few keys and has
    a bound at any size. A map that fills up lets more through, and never holds back a key. It serves to keep rows out of a shuffle that follows.
    """
    slot = F.pmod(F.col(hashed), F.lit(slots_for(keys.count()))) + 1
    maps = keys.select(slot.alias("s")).groupBy(F.bitmap_bucket_number("s").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("_map"))
    told = rows.withColumn("_bucket", F.bitmap_bucket_number(slot)).join(F.broadcast(maps), "_bucket", "left")
    at = F.bitmap_bit_position(slot).cast("int")
    byte = F.conv(F.hex(F.substring("_map", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return told.withColumn("_may", F.coalesce(F.getbit(byte, at % 8) == 1, F.lit(False))).drop("_bucket", "_map")


def slots_for(n: int) -> int:
    """Bits of a map of n keys: a power of two."""
    slots = 1 << 16
    while slots < min(SLOTS, 256 * n):
        slots *= 2
    return slots


def bit_map(keys: DataFrame, hashed: str) -> np.ndarray:
    """The distinct longs of keys as a map for in_map(), 256 bits for each of them and SLOTS bits at most: it may be sent to tasks."""
    slots = slots_for(keys.count())
    slot = F.pmod(F.col(hashed), F.lit(slots)) + 1
    chunks = keys.select(slot.alias("s")).groupBy(F.bitmap_bucket_number("s").alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("map"))
    out = np.zeros(slots // 8, np.uint8)
    for r in chunks.coalesce(1).toLocalIterator():  # one job; each partition would be one
        out[(r["at"] - 1) * 4096 : r["at"] * 4096] = np.frombuffer(r["map"], np.uint8)[: slots // 8]
    return out


def in_map(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the 64-bit hashes may be in the map."""
    slot = hashes & np.uint64(8 * len(bits) - 1)
    return (bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes:
    """64-bit hashes of words, of which some are remembered, and of runs of words."""

    def __init__(self, most: int = 200_000) -> None:
        self.known: dict[bytes, int] = {}
        self.most = most

    def word(self, w: bytes) -> int:
        if len(self.known) >= self.most:
            self.known.clear()
        self.known[w] = h = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        get, learn = self.known.get, self.word
        return np.array([get(w) or learn(w) for w in words], np.uint64)

    @staticmethod
    def runs(hashes: np.ndarray, size: int) -> np.ndarray:
        """The hash of each run of size words."""
        n = max(0, len(hashes) - size + 1)
        total = np.full(n, np.uint64(size))
        for k in range(size):
            total = mixed(total * STEP + hashes[k : k + n]) if k else total * STEP + hashes[:n]
        return mixed(total)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, which gives memory back to the system when a task ends: the Python worker lives on and waits for the next."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return task


def trim() -> None:
    """Gives memory that is not in use back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def texts(b: pa.RecordBatch, column: str = "text", rows: int = 500) -> Iterator[bytes]:
    """The bytes of a string column, null as empty, of which only some rows are Python objects at a time."""
    for at in range(0, b.num_rows, rows):
        yield from utf8(b[column].slice(at, rows))


def utf8(column: pa.Array) -> list[bytes]:
    """The bytes of a string column, null as empty."""
    return [v or b"" for v in column.cast(pa.binary()).to_pylist()]


def by_value(name: str) -> None:
    """Functions of the module travel to executors by value, so these need not have the repository on their path."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


by_value(__name__)
