"""Codes for vectors by parts, with codebooks learnt exactly on metric trees.

Vectors become integers, floor(256 x), and are cut into equal parts; each position has a codebook. A task takes some BLOCK vectors and
builds one tree of balls for each position from the middle out: about sqrt(n) anchors share the points by nearness, an anchor with
many points is split again in the same way, and balls are joined pairwise upwards, those first whose common ball is smallest. A ball
holds the sum and count of its points, and the trees are written once and used in every round. A round goes down all trees of a block
a level at a time. A ball inherits the candidate entries of the one above and drops those that another is nearer than for every point
of the ball; with one candidate left the ball is wholly its, and its cached sum and count go there without a look at its points. Points
of a smallest ball are compared with the candidates that are left. All comparisons that decide are exact in integers, but for a bound
that is used only where it holds with a margin, so the result is that of comparing all points with all entries.

What goes to the driver is the codebooks: their sums and counts, added up by Spark. Vectors that are null or hold null or non-finite
components are dropped. Shorter vectors count as ending in zeros, up to the longest, and all up to a multiple of the number of
parts; no vectors give no rows. Components stay within bound(), some 2^27 for 64 of them, so that distances fit 64 bits. Rows with equal
or null ids are rows each; those without an id come last, ties are in order of the vector. With fewer vectors than entries the
codebooks are as small. Labels may be of any type that can be grouped by, and null; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtable.llm.common import attach, by_value, new_path, stage, trimmed

SCALE = 256
PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Vectors that share trees.
BLOCK = 4096
#: Points of a ball that is not split.
LEAF = 32
#: Columns of a ball's row: its part, its places in the part's order, the balls below (-1: none), the square of its radius, its sum.
PART, START, STOP, LEFT, RIGHT, RADIUS, SUM = range(7)


def bound(width: int) -> int:
    """The largest component of so many."""
    return min(1 << 30, isqrt((1 << 62) // max(width, 1)) // 2)


def square(x: np.ndarray) -> np.ndarray:
    return np.einsum("...i,...i->...", x, x)


def anchors(x: np.ndarray, most: int) -> list[np.ndarray]:
    """Parts of the points x around up to so many anchors. Each new anchor is the farthest point of the widest one.

    It takes the points that are nearer to it than to their own anchor; only those farther off than half the way between the two
    anchors can be, so only they are compared.
    """
    owner, away, pivots = np.zeros(len(x), np.int64), np.sqrt(square(x - x[0])), [0]
    while len(pivots) < most and away[new := int(away.argmax())] > 0:
        half = np.sqrt(square(x[pivots] - x[new])) / 2
        look = np.flatnonzero(away > half[owner])
        near = np.sqrt(square(x[look] - x[new]))
        go = near < away[look]
        owner[look[go]], away[look[go]] = len(pivots), near[go]
        pivots.append(new)
    return np.split(np.argsort(owner, kind="stable"), np.cumsum(np.bincount(owner, minlength=len(pivots)))[:-1])


def joined(centers: np.ndarray, radius: np.ndarray, weight: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of balls to join one after another; ball k of n + i is what pair i became. The smallest common ball first."""
    n = len(centers)
    c, r, w, name = centers.copy(), radius.copy(), weight.astype(float), np.arange(n)
    size = np.sqrt(square(c[:, None] - c[None])) + r[:, None] + r[None]
    np.fill_diagonal(size, np.inf)
    out = []
    for i in range(n - 1):
        a, b = divmod(int(size.argmin()), n)
        out.append((int(name[a]), int(name[b])))
        c[a] = (c[a] * w[a] + c[b] * w[b]) / (w[a] + w[b])
        r[a], w[a], name[a] = size[a, b] / 2, w[a] + w[b], n + i
        size[b], size[:, b] = np.inf, np.inf
        told = np.where(np.isinf(size[a]), np.inf, np.sqrt(square(c - c[a])) + r + r[a])
        size[a], size[:, a] = told, told
    return out


class Builder:
    """The tree of one part's points: rows of balls and the order of the points in which every ball is a stretch."""

    def __init__(self, x: np.ndarray) -> None:
        self.x = x
        self.below: list[tuple[int, int]] = []
        self.points: list[np.ndarray | None] = []
        self.top = self.grow(np.arange(len(x)))

    def ball(self, points: np.ndarray | None, left: int = -1, right: int = -1) -> int:
        self.points.append(points)
        self.below.append((left, right))
        return len(self.below) - 1

    def grow(self, points: np.ndarray) -> int:
        """The ball of points, from anchors in the middle downwards and upwards."""
        if len(points) <= LEAF:
            return self.ball(points)
        x = self.x[points].astype(float)
        own = anchors(x, isqrt(len(points) - 1) + 1)
        if len(own) == 1:  # all alike
            return self.ball(points)
        n = np.array(list(map(len, own)))
        first, near = np.cumsum(n) - n, x[np.concatenate(own)]
        centers = np.add.reduceat(near, first) / n[:, None]
        radius = np.sqrt(np.maximum.reduceat(square(near - np.repeat(centers, n, axis=0)), first))
        balls = [self.grow(points[o]) for o in own]
        for a, b in joined(centers, radius, n):
            balls.append(self.ball(None, balls[a], balls[b]))
        return balls[-1]

    def rows(self, part: int, first: int) -> tuple[np.ndarray, np.ndarray]:
        """The balls' rows, the top one first, with numbers from first on, and the order of the points."""
        order, spans = [], np.zeros((len(self.below), 2), np.int64)
        walk, at = [(self.top, False)], 0
        while walk:
            k, done = walk.pop()
            left, right = self.below[k]
            if done:
                spans[k] = spans[left, 0], spans[right, 1]
            elif left < 0:
                spans[k] = at, at + len(self.points[k])
                at = spans[k, 1]
                order.append(self.points[k])
            else:
                walk += [(k, True), (right, False), (left, False)]
        order = np.concatenate(order)
        x = self.x[order]
        total = np.concatenate((np.zeros((1, x.shape[1]), np.int64), np.cumsum(x, axis=0)))
        n = spans[:, 1] - spans[:, 0]
        out = np.empty((len(spans), SUM + x.shape[1]), np.int64)
        out[:, PART], out[:, START], out[:, STOP] = part, spans[:, 0], spans[:, 1]
        below = np.array(self.below, np.int64)
        out[:, LEFT : RIGHT + 1] = np.where(below < 0, -1, first + len(spans) - 1 - below)
        out[:, SUM:] = total[spans[:, 1]] - total[spans[:, 0]]
        ends = np.cumsum(n)
        at = np.arange(ends[-1]) + np.repeat(spans[:, 0] - (ends - n), n)  # the points of every ball, ball by ball
        out[:, RADIUS] = np.maximum.reduceat(square(x[at] - np.repeat(centers_of(out), n, axis=0)), ends - n)
        return out[::-1], order


def centers_of(balls: np.ndarray) -> np.ndarray:
    """The centres, in whole numbers."""
    return balls[:, SUM:] // (balls[:, STOP] - balls[:, START])[:, None]


@dataclass(frozen=True)
class Trees:
    """The trees of a block. x: points of each part in its tree's order, order: their numbers in the block, balls: rows of all trees."""

    x: np.ndarray
    order: np.ndarray
    balls: np.ndarray
    tops: np.ndarray

    @staticmethod
    def build(vectors: np.ndarray, parts: int) -> Trees:
        points = vectors.reshape(len(vectors), parts, -1).transpose(1, 0, 2)
        balls, orders, tops, first = [], [], [], 0
        for p in range(parts):
            rows, order = Builder(points[p]).rows(p, first)
            tops.append(first)
            first += len(rows)
            balls.append(rows)
            orders.append(order)
        order = np.stack(orders)
        return Trees(np.take_along_axis(points, order[:, :, None], axis=1), order, np.concatenate(balls), np.array(tops))

    def owners(self, books: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Which entry has which points: (balls, their entries) that are wholly one's, and (part, place, entry) of single points."""
        parts, entries, _ = books.shape
        centers, radius = centers_of(self.balls), np.sqrt(self.balls[:, RADIUS].astype(float))
        apart = np.sqrt(square(books[:, :, None] - books[:, None]).astype(float))
        first = np.stack([(apart[p] == 0).argmax(axis=1) == np.arange(entries) for p in range(parts)])  # of equal entries the first
        ball, open_ = self.tops, first
        balls, whole, single, left = [], [], [], []
        while len(ball):
            part = self.balls[ball, PART]
            away = square(centers[ball][:, None] - books[part])
            away = np.where(open_, away, np.iinfo(np.int64).max)
            near = away.argmin(axis=1)
            more = away - np.take_along_axis(away, near[:, None], 1)
            # a point at most radius off has at least more - 2 radius apart to go farther to the entry than to the nearest one
            r = radius[ball][:, None]
            never = np.where(r == 0, True, more > 2 * r * apart[part, near] * (1 + 1e-9) + 1e-9)
            never[np.arange(len(ball)), near] = False
            open_ = open_ & ~never
            one = open_.sum(axis=1) == 1
            balls.append(ball[one])
            whole.append(near[one])
            end = ~one & (self.balls[ball, LEFT] < 0)
            single.append(ball[end])
            left.append(open_[end])
            on = ~one & ~end
            ball, open_ = self.balls[ball[on], LEFT : RIGHT + 1].ravel(), np.repeat(open_[on], 2, axis=0)
        part, place, entry = self.compared(np.concatenate(single), np.concatenate(left), books)
        return np.concatenate(balls), np.concatenate(whole), part, place, entry

    def compared(self, balls: np.ndarray, candidates: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each point of the balls with the nearest of its ball's candidates, ties to the lower one."""
        order = np.argsort(candidates.sum(axis=1), kind="stable")  # so that a step's lists are about as long
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(3)]
        for at in range(0, len(order), 512):
            k = order[at : at + 512]
            n = candidates[k].sum(axis=1)
            most = int(n.max())
            lists = np.argsort(~candidates[k], axis=1, kind="stable")[:, :most]
            size = self.balls[balls[k], STOP] - self.balls[balls[k], START]
            which = np.repeat(np.arange(len(k)), size)
            place = np.arange(len(which)) + np.repeat(self.balls[balls[k], START] - (np.cumsum(size) - size), size)
            part, entry = self.balls[balls[k], PART][which], lists[which]
            away = square(self.x[part, place][:, None] - books[part[:, None], entry])
            away[np.arange(most) >= n[which][:, None]] = np.iinfo(np.int64).max
            for x, v in zip(out, (part, place, np.take_along_axis(entry, away.argmin(axis=1)[:, None], 1)[:, 0]), strict=True):
                x.append(v)
        return tuple(map(np.concatenate, out))

    def totals(self, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts and sums of each entry's points, by part and entry."""
        balls, whole, part, place, entry = self.owners(books)
        count, total = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
        rows = self.balls[balls]
        np.add.at(count, (rows[:, PART], whole), rows[:, STOP] - rows[:, START])
        np.add.at(total, (rows[:, PART], whole), rows[:, SUM:])
        np.add.at(count, (part, entry), 1)
        np.add.at(total, (part, entry), self.x[part, place])
        return count, total

    def codes(self, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entries of each vector's parts, and its squared distance from them."""
        balls, whole, part, place, entry = self.owners(books)
        told = np.empty(self.order.shape, np.int64)
        rows = self.balls[balls]
        n = rows[:, STOP] - rows[:, START]
        at = np.arange(n.sum()) + np.repeat(rows[:, START] - (np.cumsum(n) - n), n)
        told[np.repeat(rows[:, PART], n), at] = np.repeat(whole, n)
        told[part, place] = entry
        off = square(self.x - np.take_along_axis(books, told[:, :, None], axis=1))
        codes, error = np.empty_like(told), np.empty_like(off)
        np.put_along_axis(codes, self.order, told, axis=1)
        np.put_along_axis(error, self.order, off, axis=1)
        return codes.T, error.sum(axis=0)


@dataclass(frozen=True)
class Trained:
    """Codebooks (part, entry, component), and the vectors in written trees: a row for each block, with labels under their own type."""

    books: np.ndarray
    trees: DataFrame

    def sha256(self) -> str:
        """Of all components in decimal by part, entry and place, with commas between."""
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """vec_id, label and x, the vector as longs, of the rows that are kept."""
    fine = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    x = F.transform("embedding", lambda v: F.floor(v.cast("double") * SCALE).cast("long"))
    return vectors.where(F.col("embedding").isNotNull()).where(fine).select(F.col("vec_id").cast("long"), "label", x.alias("x"))


def as_matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """The lists as rows of so many numbers, short ones ending in zeros."""
    most, sizes = bound(width), np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = np.clip(column.flatten().to_numpy(), -most, most)
    return out


def planted(vectors: DataFrame, parts: int, width: int) -> DataFrame:
    """Blocks of vectors with their trees, written: vec_id, label, x, order, balls."""
    new_path(vectors.sparkSession, "codes")  # bounds what Python gets at once

    def block(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        n, trees = rows.num_rows, Trees.build(as_matrix(rows["x"].chunk(0), width), parts)
        whole = lambda c: pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), rows[c].chunk(0))
        data = {k: pa.array([v.tobytes()], pa.binary()) for k, v in (("x", trees.x.astype("<i4")), ("order", trees.order.astype("<i4")), ("balls", trees.balls.astype("<i8")))}
        return pa.RecordBatch.from_pydict({"vec_id": whole("vec_id"), "label": whole("label"), **data})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for b in batches:
            while n + b.num_rows >= BLOCK:
                yield block(pa.Table.from_batches([*held, b.slice(0, BLOCK - n)]))
                b, held, n = b.slice(BLOCK - n), [], 0
            if b.num_rows:
                held.append(b)
                n += b.num_rows
        if n:
            yield block(pa.Table.from_batches(held))

    label = vectors.schema["label"].dataType.simpleString()
    schema = f"vec_id array<bigint>, label array<{label}>, x binary, order binary, balls binary"
    return stage(vectors.mapInArrow(trimmed(run), schema), "code-trees")


def told_trees(row: dict, parts: int) -> Trees:
    n = len(row["vec_id"])
    order = np.frombuffer(row["order"], "<i4").reshape(parts, n).astype(np.int64)
    x = np.frombuffer(row["x"], "<i4").reshape(parts, n, -1).astype(np.int64)
    balls = np.frombuffer(row["balls"], "<i8").reshape(-1, SUM + x.shape[2])
    return Trees(x, order, balls, np.flatnonzero(np.diff(balls[:, PART], prepend=-1)))


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Trained:
    """Codebooks of vectors (vec_id, embedding, label) after so many rounds, begun with the vectors of the smallest ids."""
    kept = whole_numbers(vectors)
    width = parts * -(-(kept.agg(F.max(F.size("x"))).first()[0] or 1) // parts)
    trees = planted(kept, parts, width)
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "x").select("x").limit(entries).toArrow()  # as many rows as entries
    start = as_matrix(pa.chunked_array(first["x"].chunks, pa.list_(pa.int64())).combine_chunks(), width)
    books = np.ascontiguousarray(start.reshape(len(start), parts, width // parts).transpose(1, 0, 2))
    for _ in range(rounds if len(start) else 0):
        books = improved(trees, books)
    return Trained(books, trees)


def improved(trees: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one more round: means of each entry's parts, rounded down; entries without any stay."""
    parts, entries, places = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, places), np.int64)
        for b in batches:
            for k in range(b.num_rows):
                n, x = told_trees(b.slice(k, 1).to_pylist()[0], parts).totals(books)
                count, total = count + n, total + x
        p, e = np.nonzero(count)
        x = pa.ListArray.from_arrays(pa.array(np.arange(0, len(p) * places + 1, places, dtype=np.int32)), pa.array(total[p, e].ravel()))
        yield pa.RecordBatch.from_pydict({"part": pa.array(p, pa.int64()), "entry": pa.array(e, pa.int64()), "n": pa.array(count[p, e]), "x": x})

    told = trees.select("vec_id", "x", "order", "balls").mapInArrow(trimmed(run), "part long, entry long, n long, x array<bigint>")
    sums = told.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("x", F.lit(i))) for i in range(places)]).alias("x"))
    out = books.copy()
    for r in sums.collect():  # one row for each entry at most
        out[r["part"], r["entry"]] = [v // r["n"] for v in r["x"]]
    return out


def encode(trained: Trained) -> DataFrame:
    """vec_id, label, code (two hexadecimal digits for each part) and error of each vector."""
    books, (parts, *_) = trained.books, trained.books.shape
    pairs = np.array([f"{v:02x}" for v in range(256)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                one = b.slice(k, 1)
                codes, error = told_trees(one.select(["vec_id", "x", "order", "balls"]).to_pylist()[0], parts).codes(books)
                code = ["".join(c) for c in pairs[codes].tolist()]
                yield pa.RecordBatch.from_arrays([one["vec_id"].flatten(), one["label"].flatten(), pa.array(code, pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    label = trained.trees.schema["label"].dataType.elementType.simpleString()
    return stage(trained.trees.mapInArrow(trimmed(run), f"vec_id long, label {label}, code string, error long"), "codes")


def with_label_error(codes: DataFrame) -> DataFrame:
    """codes with label_error, the sum of error over the rows of the same label; null labels are one group."""
    keyed = codes.withColumn("key", F.struct("label"))
    sums = stage(keyed.groupBy("key").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "label-errors")
    return attach(keyed, sums, "key", "n").drop("key")


by_value(__name__)
