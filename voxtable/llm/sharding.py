"""Sharding by vector bin packing over bytes, tokens and rows jointly.

The units that are packed are groups of equal texts. A group stays whole wherever it fits; only one that no shard has room
for is split. Groups of over 1/OWN of all bytes, tokens or rows (3 * OWN at most) are packed first, together. All other
groups fall into slices by the hash of their text; each slice packs its groups in a task of its own, against its share of
what the large groups left free in each shard, so only the totals of slices meet. In both steps units go, largest first,
to the shard where the dot product of demand and residual capacity is highest.

A null text has no bytes and is grouped with the empty text. Repeated rows and null ids are rows like others; the pieces of
a split group and the numbering of slots go by row, not by id. Texts of any length are counted and hashed whole. An empty table
gives an empty result. Other columns are not read, so their names do not matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxtable.llm.common import by_value, stage

#: A group is packed with the large ones if it has over 1/OWN of all bytes, tokens or rows.
OWN = 8192
#: Groups of a slice, about, and slices at most.
SLICE_GROUPS, MOST_SLICES = 100_000, 4096
#: A large group that fits nowhere is halved down to this part of a shard; a shard may be overfilled by as much.
PIECE = 1 / 64
#: Rows that are numbered within one task, about.
CHUNK_ROWS = 100_000
DIMENSIONS = ("bytes", "tokens", "rows")
#: Weights of the dimensions in the dot product: where they are at odds, as for a group of many short rows, bytes come first.
WEIGHTS = np.array([8.0, 1.0, 1.0])
#: What counts as a token: a run without ASCII white space.
TOKEN = r"[^\x20\x09-\x0D]+"


def pack(demands: np.ndarray, room: np.ndarray) -> np.ndarray:
    """The shard of each unit. demands: a row for each unit, a column for each dimension; room: a row for each shard."""
    scale = np.maximum(room.sum(axis=0) / len(room), 1e-9)
    need, left = demands / scale, room / scale
    where = np.zeros(len(demands), np.int64)
    for i in np.argsort(-need.max(axis=1), kind="stable"):
        where[i] = s = int(np.argmax(left @ (WEIGHTS * need[i])))
        left[s] -= need[i]
    return where


def pack_large(demands: np.ndarray, room: np.ndarray) -> tuple[list[tuple[int, float, float, int]], np.ndarray]:
    """(unit, from, to, shard) of parts of units, and the room that is left. A unit is halved only where no shard has room for it."""
    scale = np.maximum(room.sum(axis=0) / len(room), 1e-9)
    left, out = room / scale, []
    open_ = [(i, 0.0, 1.0) for i in np.argsort(-(demands / scale).max(axis=1), kind="stable")]
    while open_:
        i, a, b = open_.pop(0)
        need = demands[i] / scale * (b - a)
        among = np.arange(len(left))
        if need.max() > PIECE:
            among = np.flatnonzero((left - need >= -PIECE).all(axis=1))
            if not len(among):
                open_[:0] = [(i, a, (a + b) / 2), (i, (a + b) / 2, b)]
                continue
        s = int(among[np.argmax(left[among] @ (WEIGHTS * need))])
        left[s] -= need
        if out and out[-1][0] == i and out[-1][3] == s and out[-1][2] == a:
            a = out.pop()[1]
        out.append((int(i), a, b, s))
    return out, left * scale


def shard(documents: DataFrame, shards: int) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (gapless from 0 in each shard) for each row of documents (doc_id, text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("group"), F.regexp_count(text, F.lit(TOKEN)).cast("long").alias("tokens"), F.xxhash64(F.monotonically_increasing_id()).alias("spread"),
    )
    rows = stage(rows, "shard-rows")
    sums = [F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]
    groups = stage(rows.groupBy("group").agg(*sums), "shard-groups")
    total = groups.agg(*[F.sum(d).alias(d) for d in DIMENSIONS], F.count("*").alias("n")).first()
    if not total["n"]:
        return rows.select("doc_id", "size", "text_crc32", F.lit(None).cast("int").alias("shard"), F.lit(None).cast("long").alias("slot"))

    share = F.greatest(*[F.col(d) / F.lit(max(1, total[d])) for d in DIMENSIONS])
    large = groups.where(share > 1 / OWN).orderBy("group").collect()  # 3 * OWN at most
    room = np.tile(np.array([total[d] for d in DIMENSIONS], float) / shards, (shards, 1))
    parts, left = pack_large(np.array([[g[d] for d in DIMENSIONS] for g in large], float).reshape(-1, len(DIMENSIONS)), room)
    small = groups.where(share <= 1 / OWN)
    packed = stage(pack_slices(small, left, -(-total["n"] // SLICE_GROUPS)), "shard-packed")
    told = [(large[i]["group"], a, b, s) for i, a, b, s in parts]
    plan = documents.sparkSession.createDataFrame(told, "group long, from_ double, to_ double, shard int")
    hot = plan.groupBy("group").agg(F.collect_list(F.struct("from_", "to_", "shard")).alias("parts"))  # 3 * OWN groups at most, with their parts
    marked = rows.join(F.broadcast(hot), "group", "left")
    at = F.pmod("spread", F.lit(1 << 30)) / F.lit(float(1 << 30))
    near = marked.where("parts is not null").withColumn("shard", F.filter("parts", lambda p: (p["from_"] <= at) & (at < p["to_"]))[0]["shard"])
    far = marked.where("parts is null").join(packed.hint("merge"), "group")
    chunks = -(-total["rows"] // CHUNK_ROWS)
    out = [x.select("doc_id", "size", "text_crc32", "shard", F.pmod("spread", F.lit(chunks)).alias("chunk")) for x in (near, far)]
    return slots(stage(out[0].unionByName(out[1]), "shard-dealt"))


def pack_slices(groups: DataFrame, left: np.ndarray, slices: int) -> DataFrame:
    """(group, shard) of groups. Each slice takes its share of the room that is left in each shard."""
    number = min(slices, MOST_SLICES)
    free = np.maximum(left, 0)

    def run(table: pa.Table) -> pa.Table:
        demands = np.stack([table[d].to_numpy() for d in DIMENSIONS], axis=1).astype(float)
        part = demands.sum(axis=0) / np.maximum(free.sum(axis=0), 1e-9)
        return pa.table({"group": table["group"], "shard": pa.array(pack(demands, free * part), pa.int32())})

    cut = groups.withColumn("slice", F.pmod(F.xxhash64("group", F.lit(1)), F.lit(number)))
    return cut.groupBy("slice").applyInArrow(run, "group long, shard int")


def slots(dealt: DataFrame) -> DataFrame:
    """Numbers the rows of each shard from 0: row numbers within chunks on top of the prefix sums of the chunks' counts."""
    base = F.sum("n").over(Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    counts = dealt.groupBy("shard", "chunk").agg(F.count("*").alias("n"))
    bases = stage(counts.select("shard", "chunk", F.coalesce(base, F.lit(0)).alias("base")), "shard-bases")
    within = F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("doc_id", "text_crc32", "size"))
    told = dealt.withColumn("within", within).join(bases.hint("merge"), ["shard", "chunk"])
    return told.select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("within") - 1).alias("slot"))


by_value(__name__)
