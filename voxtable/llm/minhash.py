"""MinHash near-duplicates: many universal hash minima with banding, signature verification, exact confirmation, components.

A document's set is its distinct SHINGLE-word shingles after lower-casing A-Z (the whole sequence where there are fewer
words). Documents with equal sets form a class, of which one stands for all. Its HASHES minima under multiply-add hashes fall into
bands; two sets at the threshold share a band with probability 1 - (1 - 0.75^ROWS)^BANDS, some 0.999995.

No bucket's pairs are listed. First each member of a bucket is paired with its hub, the member that meets most others in all
its buckets (a star); pairs whose signatures agree enough are confirmed on the full sets, and components are taken. Then the nodes
that agree with one hub are compared across their components, block against block inside tasks that hold the full sets
and emit only links that join components. Last, buckets that still hold several components are compared in the same way by
signature, for pairs that have no hub in common; what agrees is confirmed. Groups of any size are split into blocks, so there is no cap.

Null and empty texts have no set and are linked with nothing. component_id is the smallest doc_id that is reachable; null ids
count only where there is no other. Repeated rows are in one class. Texts of any length are hashed whole, in bounded pieces. An empty
table gives no rows. near_duplicates() reads no other columns, and one_of_each() leaves them as they are, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtable.llm.common import STEP, WordHashes, attach, by_value, mixed, possible, stage, staged_alone, trimmed, utf8
from voxtable.llm.components import components

SHINGLE = 5
#: Link where 100 * intersection >= PERCENT * union.
PERCENT = 75
ROWS, BANDS = 4, 32
HASHES = ROWS * BANDS
#: Pairs go on to confirmation when at least this part of their minima agrees: over five standard errors below the threshold.
AGREE = 0.55
#: Members of a block, of which two meet in a task.
BLOCK = 512
#: Shingles that are hashed at once.
PIECE = 1_024
#: The multiplier (odd) and the summand of each hash, 32 bits each.
MULTIPLIERS = np.random.RandomState(20).randint(0, 1 << 31, (2, HASHES), dtype=np.uint32) * np.uint32(2) + np.uint32(1)  # noqa: NPY002


class Shingler(WordHashes):
    """Texts to sorted distinct 64-bit shingle hashes."""

    def shingles(self, text: bytes) -> np.ndarray:
        h = self.of(text.lower().split())
        return np.unique(self.runs(h, min(SHINGLE, len(h)))) if len(h) else h


def minima(shingles: np.ndarray, room: np.ndarray | None = None) -> np.ndarray:
    """The smallest value of each multiply-add hash modulo 2^32 of the shingles' high 32 bits. room: an array to work in, (HASHES, PIECE)."""
    room = np.empty((HASHES, PIECE), np.uint32) if room is None else room
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(HASHES, np.uint32(0xFFFFFFFF))
    a, b = MULTIPLIERS[0][:, None], MULTIPLIERS[1][:, None]
    for at in range(0, len(x), PIECE):
        part = x[None, at : at + PIECE]
        values = np.multiply(a, part, out=room[:, : part.shape[1]])
        values += b
        np.minimum(low, values.min(axis=1), out=low)
    return low


def linked(p: np.ndarray, q: np.ndarray) -> bool:
    """Whether two sets, as sorted distinct arrays, are similar enough."""
    if 100 * min(len(p), len(q)) < PERCENT * max(len(p), len(q)):
        return False
    union = np.concatenate((p, q))
    union.sort(kind="stable")  # two sorted runs are merged
    both = int(np.count_nonzero(union[1:] == union[:-1]))
    return 100 * both >= PERCENT * (len(union) - both)


def buckets(signature: np.ndarray) -> np.ndarray:
    """One key for each band, the band's number mixed in."""
    rows = signature.astype(np.uint64).reshape(BANDS, ROWS)
    key = mixed(np.arange(1, BANDS + 1, dtype=np.uint64))
    for k in range(ROWS):
        key = mixed(key * STEP + rows[:, k])
    return key.view(np.int64)


def keyed(documents: DataFrame) -> DataFrame:
    """doc_id, text and a key that finds the row again."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("long"), "text").alias("key"), "text")


def sketch(documents: DataFrame) -> DataFrame:
    """doc_id, key, n_shingles, set_key, signature and buckets of each row; the last three are null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, room = Shingler(), np.empty((HASHES, PIECE), np.uint32)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                counts, keys, signatures, bands = [], [], [], []
                for text in utf8(part["text"]):
                    own = shingler.shingles(text)
                    counts.append(len(own))
                    keys.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                    signature = minima(own, room) if len(own) else None
                    signatures.append(None if signature is None else signature.tobytes())
                    bands.append(None if signature is None else buckets(signature))
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["key"], pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(signatures, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "key", "n_shingles", "set_key", "signature", "buckets"])

    return keyed(documents).mapInArrow(trimmed(run), "doc_id long, key long, n_shingles long, set_key binary, signature binary, buckets array<long>")


def full_sets(nodes: DataFrame, documents: DataFrame) -> DataFrame:
    """(node, shingles) of nodes (node, doc_id, key), from the documents' texts. Of these only such as may be wanted are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                yield pa.RecordBatch.from_arrays([part["node"], pa.array([shingler.shingles(t).tobytes() for t in utf8(part["text"])], pa.binary())], ["node", "shingles"])

    nodes = stage(nodes, "minhash-wanted")
    texts = possible(keyed(documents).select("key", F.col("doc_id").alias("id"), "text"), nodes, "key").where("_may")
    found = texts.join(nodes.hint("merge"), "key").where(F.col("id").eqNullSafe(F.col("doc_id"))).dropDuplicates(["key", "node"])
    return found.select("node", "text").mapInArrow(trimmed(run), "node long, shingles binary")


def agreeing(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """Of distinct pairs (u, v), those whose signatures agree in AGREE of the minima."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b[c].to_pylist()), np.uint32).reshape(-1, HASHES) for c in ("su", "sv"))
            near = pa.array((x == y).mean(axis=1) >= AGREE)
            yield pa.RecordBatch.from_arrays([b["u"].filter(near), b["v"].filter(near)], ["u", "v"])

    return beside(pairs, signatures, "signature", ("su", "sv")).mapInArrow(trimmed(run), "u long, v long")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of distinct pairs (u, v), those that are linked by their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sure = pa.array([linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(b["su"].to_pylist(), b["sv"].to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b["u"].filter(sure), b["v"].filter(sure)], ["u", "v"])

    return beside(pairs, sets, "shingles", ("su", "sv")).mapInArrow(trimmed(run), "u long, v long")


def beside(pairs: DataFrame, values: DataFrame, value: str, names: tuple[str, str]) -> DataFrame:
    """pairs with the value of either node. u may be in very many pairs; the join splits it, as its partner has one row."""
    right = pairs.hint("merge").join(values.select(F.col("node").alias("v"), F.col(value).alias(names[1])), "v")
    return right.hint("merge").join(values.select(F.col("node").alias("u"), F.col(value).alias(names[0])), "u").select("u", "v", *names)


def stars(members: DataFrame) -> DataFrame:
    """Distinct pairs (u, v) of each bucket's hub u and another member v."""
    return members.where("node <> hub").select(F.col("hub").alias("u"), F.col("node").alias("v")).distinct()


def blocked(rows: DataFrame, group: str) -> DataFrame:
    """rows (group, n, node, ...) with block, one and two: each pair of blocks of a group is a group of its own, and a row goes to each pair that its block is in."""
    cut = rows.withColumn("_blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("node"), "_blocks").cast("int"))
    mate = cut.withColumn("_mate", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return mate.withColumns({"one": F.least("block", "_mate"), "two": F.greatest("block", "_mate")}).drop("_blocks", "_mate", "n")


def several_labels(rows: DataFrame, group: str) -> DataFrame:
    """The rows (group, node, label) of groups that hold several labels, with the group's count n."""
    labelled = rows.groupBy(group).agg(F.min("label").alias("a"), F.max("label").alias("b"), F.count("*").alias("_n")).where("a <> b")
    open_groups = stage(labelled.select(group, "_n", F.col("_n").alias("n")), "minhash-open")
    return attach(rows, open_groups, group, "_n").where("n is not null")


def within(near: DataFrame, labels: DataFrame, values: DataFrame) -> DataFrame:
    """Links (u, v) between components among the nodes v that agree with the same hub u, and u: enough of them to join the components.

    The full sets come to the task, so nothing but links leaves it.
    """

    def run(table: pa.Table) -> pa.Table:
        node, label = table["node"].to_numpy(), table["label"].to_numpy().copy()
        own, other = table["block"].to_numpy() == table["one"].to_numpy(), table["block"].to_numpy() == table["two"].to_numpy()
        signature = np.frombuffer(b"".join(table["signature"].to_pylist()), np.uint32).reshape(-1, HASHES)
        sets = [np.frombuffer(x, np.uint64) for x in table["shingles"].to_pylist()]
        size = np.array(list(map(len, sets)))
        found, right = [], np.flatnonzero(other)
        for i in np.flatnonzero(own):
            fit = right[(label[right] != label[i]) & (100 * np.minimum(size[right], size[i]) >= PERCENT * np.maximum(size[right], size[i]))]
            for j in fit[(signature[fit] == signature[i]).mean(axis=1) >= AGREE]:
                if label[j] != label[i] and linked(sets[i], sets[j]):
                    found.append((min(node[i], node[j]), max(node[i], node[j])))
                    label[label == label[j]] = label[i]
        return pa.table({"u": pa.array([int(u) for u, _ in found], pa.int64()), "v": pa.array([int(v) for _, v in found], pa.int64())})

    rows = near.select(F.col("u").alias("hub"), F.col("v").alias("node")).unionByName(near.select(F.col("u").alias("hub"), F.col("u").alias("node"))).distinct()
    told = stage(rows.join(labels.hint("merge"), "node", "left").select("hub", "node", F.coalesce("label", "node").alias("label")), "minhash-told")
    meet = blocked(several_labels(told, "hub"), "hub").hint("merge").join(values, "node")
    return meet.groupBy("hub", "one", "two").applyInArrow(run, "u long, v long").distinct()


def across(members: DataFrame, near: DataFrame, labels: DataFrame, signatures: DataFrame) -> DataFrame:
    """Distinct pairs (u, v) in one bucket, in different components and without a common hub, whose signatures agree."""

    def run(table: pa.Table) -> pa.Table:
        node, label = table["node"].to_numpy(), table["label"].to_numpy()
        own, other = table["block"].to_numpy() == table["one"].to_numpy(), table["block"].to_numpy() == table["two"].to_numpy()
        hubs = [frozenset(x) for x in table["hubs"].to_pylist()]
        main = np.array([min(h) for h in hubs])
        signature = np.frombuffer(b"".join(table["signature"].to_pylist()), np.uint32).reshape(-1, HASHES)
        found, right = [], np.flatnonzero(other)
        for i in np.flatnonzero(own):
            fit = right[(label[right] != label[i]) & (main[right] != main[i])]
            for j in fit[(signature[fit] == signature[i]).mean(axis=1) >= AGREE]:
                if not hubs[i] & hubs[j]:
                    found.append((min(node[i], node[j]), max(node[i], node[j])))
        return pa.table({"u": pa.array([int(u) for u, _ in found], pa.int64()), "v": pa.array([int(v) for _, v in found], pa.int64())})

    hubs = near.select(F.col("v").alias("node"), F.col("u").alias("hub")).unionByName(near.select(F.col("u").alias("node"), F.col("u").alias("hub")))
    hubs = hubs.groupBy("node").agg(F.collect_set("hub").alias("hubs"))  # one for each band at most, and itself
    told = members.join(labels.hint("merge"), "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("label"))
    own = signatures.join(hubs.hint("merge"), "node", "left").select("node", "signature", F.coalesce("hubs", F.array("node")).alias("hubs"))
    meet = blocked(several_labels(stage(told, "minhash-told"), "bucket"), "bucket").hint("merge").join(own, "node")
    return meet.groupBy("bucket", "one", "two").applyInArrow(run, "u long, v long").distinct()


@staged_alone("minhash-final")
def judged_classes(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """set_key, n, label and best of each class of rows, which are sketches of documents."""
    some = rows.where("set_key is not null")
    first = F.min(F.struct("row", "doc_id", "key")).alias("first")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("lost"), "doc_id", "key")).alias("best")
    classes = some.groupBy("set_key").agg(first, best, F.count("*").alias("n"))
    classes = stage(classes.select("set_key", F.col("first.row").alias("node"), "first.doc_id", "first.key", "best", "n"), "minhash-classes")
    one = some.select(F.col("row").alias("node"), "signature", "buckets").join(classes.select("node").hint("merge"), "node", "left_semi")
    one = stage(one, "minhash-signatures")

    banded = one.select("node", F.explode("buckets").alias("bucket"))
    shared = stage(banded.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").withColumn("size", F.col("n")), "minhash-shared")
    members = stage(attach(banded, shared, "bucket", "n").where("size is not null"), "minhash-members")
    # the text that others were copied from meets more of them than any copy does, so it makes the best hub
    met = stage(members.groupBy("node").agg(F.sum("size").alias("met")), "minhash-met")
    hubs = members.join(met.hint("merge"), "node").groupBy("bucket").agg(F.max(F.struct("met", "node"))["node"].alias("hub"), F.count("*").alias("n"))
    members = stage(attach(members.select("bucket", "node"), stage(hubs, "minhash-hubs"), "bucket", "n"), "minhash-members")
    several = stage(members.select("node").distinct(), "minhash-several")
    signatures = stage(one.select("node", "signature").join(several.hint("merge"), "node", "left_semi"), "minhash-members-signatures")
    sets = stage(full_sets(classes.select("node", "doc_id", "key").join(several.hint("merge"), "node", "left_semi"), documents), "minhash-sets")

    near = stage(agreeing(stars(members), signatures), "minhash-near")
    links = stage(confirmed(near, sets), "minhash-links")
    links = links.unionByName(stage(within(near, components(links), signatures.join(sets.hint("merge"), "node")), "minhash-within"))
    labels = components(links)
    more = stage(confirmed(stage(across(members, near, labels, signatures), "minhash-across"), sets), "minhash-more")
    if not more.isEmpty():
        labels = components(links.unionByName(more))

    named = labels.unionByName(labels.select(F.col("label").alias("node"), "label").distinct())
    named = stage(named.join(classes.select("node", "best").hint("merge"), "node"), "minhash-named")
    lowest = stage(named.groupBy("label").agg(F.min("best").alias("lowest"), F.count("*").alias("n")), "minhash-lowest")
    told = attach(named.select("node", "label"), lowest, "label", "n").select("node", "label", "lowest")
    final = classes.join(told.hint("merge"), "node", "left")
    return final.select("set_key", "n", F.coalesce("label", "node").alias("label"), F.coalesce("lowest", "best").alias("best"))


def judged(documents: DataFrame) -> DataFrame:
    """doc_id, key, n_shingles, label and best of each row of documents (doc_id, text).

    label names the component and best is the (without id, doc_id, key) of its first row, by doc_id, then key; both are null without words.
    """
    rows = stage(sketch(documents).withColumn("row", F.monotonically_increasing_id()), "minhash-rows")
    out = attach(rows.where("set_key is not null").select("doc_id", "key", "n_shingles", "set_key"), judged_classes(rows, documents), "set_key", "n").drop("set_key")
    return out.unionByName(rows.where("set_key is null").select("doc_id", "key", "n_shingles"), allowMissingColumns=True)


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of documents (doc_id, text)."""
    out = judged(documents).withColumn("component_id", F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


@staged_alone("minhash-touched")
def touched_rows(documents: DataFrame) -> DataFrame:
    """key, id, stays and n of the documents that have near-duplicates or are repeated."""
    told = judged(documents).where("label is not null").withColumn("stays", (F.col("key") == F.col("best.key")) & F.col("doc_id").eqNullSafe(F.col("best.doc_id")))
    return told.groupBy("key", F.col("doc_id").alias("id")).agg(F.max("stays").alias("stays"), F.count("*").alias("n")).where("not stays or n > 1")


def one_of_each(documents: DataFrame) -> DataFrame:
    """The documents without near-duplicates: the first row of each component (by doc_id, null last, then text) stays, once, with all its columns.

    Rows are told apart by id and text, so rows that share an id but not a text are judged each for itself; of wholly repeated ones any stays.
    Rows without words all stay. Only rows that may have to go are shuffled.
    """
    touched = touched_rows(documents)
    rows = documents.select(F.struct("*").alias("row"), F.xxhash64(F.col("doc_id").cast("long"), "text").alias("key"), F.col("doc_id").cast("long").alias("own"))
    marked = possible(rows, touched.select("key"), "key")
    near = marked.where("_may").join(touched.withColumnRenamed("key", "_key").hint("merge"), (F.col("key") == F.col("_key")) & F.col("own").eqNullSafe(F.col("id")), "left")
    out = marked.where("not _may").select("row.*").unionByName(near.where("stays is null").select("row.*"))
    if touched.where("stays").isEmpty():
        return out
    return out.unionByName(near.where("stays").dropDuplicates(["key", "own"]).select("row.*"))


by_value(__name__)
