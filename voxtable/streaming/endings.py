"""Acknowledged endings of jobs as a stream, in order of event time.

An ending is held until the watermark has passed it, so any split of the events into triggers, and any order of those no later than the
watermark, gives what the batch twin gives: of each job and status the endings up to the first that is acknowledged.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from voxtable.streaming.jobs import ENDINGS, LATE

#: Event time in microseconds, a number in any time zone.
TIME = "_micros"
TIMES, GROUP = "_times", "_group"
#: Groups of jobs: a call to Python and its state serve all jobs of a group.
GROUPS = 4096
#: Bytes of rows that a task puts together.
PACK = 1 << 25


class FirstAcknowledged(StatefulProcessor):
    """Held endings of one job and status in a list, one timer for the earliest, and when the last acknowledged ending was.

    With forget (milliseconds) an acknowledged ending rules out those of so long after it, and then goes; without, all later ones.
    For streams that hold endings key by key; stream_terminal_dedup uses FirstOfJobs, as each call to the state costs more than many rows.
    """

    def __init__(self, schema: StructType, forget: int | None = None) -> None:
        self.schema, self.forget = schema, forget
        self.at, self.number, self.acked = (schema.names.index(c) for c in (TIME, "event_id", "acked"))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", self.schema)
        self.done = handle.getValueState("done", StructType([StructField("micros", LongType())]))
        self.next = handle.getValueState("next", StructType([StructField("millis", LongType())]))

    def until(self) -> float:
        """Until when endings are ruled out."""
        done = self.done.get()
        if done is None:
            return -math.inf
        return math.inf if self.forget is None else done[0] + 1000 * self.forget

    def wake(self, rows: list[tuple]) -> None:
        """A timer at the earliest of held rows, where there is none before it. The others need none: they are looked at when it is due."""
        millis, known = min(-(-r[self.at] // 1000) for r in rows), self.next.get()
        if known is None or millis < known[0]:
            self.handle.registerTimer(millis)
            self.next.update((millis,))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        until = self.until()
        fresh = [r for r in map(tuple, rows) if r[self.at] > until]
        if fresh:
            self.held.appendList(fresh)
            self.wake(fresh)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        until, till = self.until(), timerValues.getCurrentWatermarkInMs() * 1000
        rows = [tuple(r) for r in self.held.get()]
        passed = sorted((r for r in rows if r[self.at] <= till), key=lambda r: (r[self.at], r[self.number] is not None, r[self.number]))
        for r in passed:
            if r[self.at] <= until:
                continue
            yield Row(**dict(zip(self.schema.names, r, strict=True)))
            if r[self.acked]:
                self.done.update((r[self.at],))
                until = self.until()
                if self.forget is not None:
                    self.handle.registerTimer(until // 1000 + 1)
        left = [r for r in rows if r[self.at] > max(till, until)]
        self.next.clear()
        if left:
            if len(left) < len(rows):
                self.held.put(left)
            self.wake(left)
        elif rows:
            self.held.clear()
        if until <= till and not left:
            self.done.clear()

    def close(self) -> None:
        pass


def cut(rows: pa.Table, done: dict[tuple, int], forget: int | None = None) -> pa.Table:
    """Of each job and status the rows up to the first acknowledged one, sorted; done has when the last acknowledged ending of each was, and learns it."""
    rows = rows.append_column(TIME, rows["ts"].cast(pa.int64()))
    order = [(c, "ascending") for c in ("job_id", "status", TIME, "event_id")]
    rows = rows.take(pc.sort_indices(rows, order, null_placement="at_start"))
    span, kept = math.inf if forget is None else 1000 * forget, []
    for place, (job, status, at, acked) in enumerate(zip(*(rows[c].to_pylist() for c in ("job_id", "status", TIME, "acked")), strict=True)):
        before = done.get((job, status))
        if before is None or at > before + span:
            kept.append(place)
            if acked:
                done[job, status] = at
    return rows.take(pa.array(kept, pa.int64()))


def as_bytes(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def as_table(packs: Iterable[bytes]) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(p).read_all() for p in packs])


def packing(forget: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows as one value of bytes for each group, or several where a task has more than PACK bytes. What their own first acknowledged one rules out stays behind."""

    def packs(found: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(found)
        if forget is None:  # otherwise an acknowledged ending may be ruled out itself, and then rules out nothing
            rows = cut(rows, {}).drop_columns(TIME)
        rows = rows.sort_by(GROUP).combine_chunks()
        groups = rows[GROUP].to_numpy()
        starts = np.flatnonzero(np.diff(groups, prepend=-1))
        rows = rows.drop_columns(GROUP)
        told = [as_bytes(rows.slice(a, b - a)) for a, b in zip(starts, [*starts[1:], len(groups)], strict=True)]
        return pa.record_batch([pa.array(groups[starts]), pa.array(told, pa.binary())], [GROUP, "rows"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        for batch in batches:
            if batch.num_rows:
                found.append(batch)
                size += batch.nbytes
            if size >= PACK:
                yield packs(found)
                found, size = [], 0
        if found:
            yield packs(found)

    return pack


def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for pack in batch.column("rows"):
            yield from as_table([pack.as_py()]).to_batches()


class FirstOfJobs(StatefulProcessor):
    """Endings that the watermark has passed, of a group of jobs at once: of each job and status those up to the first that is acknowledged.

    Rows come and go as bytes of many. When the last acknowledged ending of each job was is one value for the group, read and written once for all rows of a trigger.
    Endings of a later trigger must be later ones. With forget as in FirstAcknowledged; a time that rules nothing out any more goes when its group has the next ending.
    """

    def __init__(self, schema: StructType, forget: int | None = None) -> None:
        self.kinds, self.forget = [schema[c].dataType for c in ("job_id", "status")] + [LongType()], forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.done = handle.getValueState("done", StructType([StructField(c, ArrayType(k)) for c, k in zip(("jobs", "statuses", "micros"), self.kinds, strict=True)]))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        found, kept = as_table(r.rows for r in rows), self.done.get()
        known = {(job, status): at for job, status, at in zip(*kept, strict=True)} if kept else {}
        done = dict(known)
        told = cut(found, done, self.forget)
        if self.forget is not None:
            last = pc.max(found["ts"].cast(pa.int64())).as_py()
            done = {k: at for k, at in done.items() if at + 1000 * self.forget > last}
        if done != known:
            self.done.update(([job for job, _ in done], [status for _, status in done], list(done.values())))
        return iter([Row(rows=as_bytes(told.drop_columns(TIME)))] if told.num_rows else [])

    def close(self) -> None:
        pass


def stream_terminal_dedup(events: DataFrame, late: str = LATE, forget_ms: int | None = None, groups: int = GROUPS) -> DataFrame:
    """As terminal_dedup, in append mode: endings once the watermark has passed them, and everything else as it comes.

    Needs the RocksDB state store. What comes later than the watermark is dropped. Without forget_ms a time stays for every acknowledged ending.
    Endings are held by a grouping of whole rows (columns must be ones that can be grouped by; -0.0 becomes 0.0), so Python sees each one once, when it has been passed, with those
    of many jobs. The number of groups stays with a checkpoint.
    """
    marked = events.withWatermark("ts", late)
    passed = marked.where(F.col("status").isin(*ENDINGS)).groupBy(*events.columns).agg(F.count("*").alias(TIMES))
    each = passed.select(*events.columns, F.pmod(F.xxhash64("job_id", "status"), F.lit(groups).cast("long")).alias(GROUP), F.explode(F.sequence(F.lit(1).cast("long"), TIMES)).alias(TIMES)).drop(TIMES)
    packed = each.repartition(GROUP).mapInArrow(packing(forget_ms), f"{GROUP} long, rows binary")
    told = packed.groupBy(GROUP).transformWithState(FirstOfJobs(events.schema, forget_ms), "rows binary", "Append", "None").mapInArrow(unpack, events.schema)
    return told.unionByName(marked.where(~F.col("status").isin(*ENDINGS) | F.col("status").isNull()))


# executors get what is defined here by value, so they need not have the repository on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])
