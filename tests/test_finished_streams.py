"""Finished streams against their batch twins: any split into triggers, restarts half way, time zones, forgetting."""

import datetime
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from voxtable.sources import files
from voxtable.streaming import endings, jobs, sinks

EVENTS = "event_id long, job_id long, ts timestamp, status string, progress long, acked boolean, error_message string"
NOON = datetime.datetime(2024, 5, 1, 12)


def events_of(seed, n=120):
    """Endings of a few jobs, some acknowledged, some at the same time, some without a flag; times are within an hour."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        at = NOON + datetime.timedelta(seconds=r.randrange(3600), microseconds=r.choice((0, 0, 250, 999_999)))
        rows.append((i, r.randrange(6), at, r.choice(("completed", "failed", "processing", None)), r.randrange(101), r.choice((True, False, None)), None))
    return rows


def closing(ahead=datetime.timedelta(days=4000)):
    return [(-1, -1, NOON + ahead, "processing", 0, None, None)]


def write(spark, rows, folder, name):
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


@pytest.mark.parametrize(("seed", "zone"), [(1, "UTC"), (2, "Asia/Seoul"), (3, "America/New_York")])
def test_endings_in_any_split_and_order(spark, tmp_path, seed, zone):
    """Events within the watermark's two hours, shuffled into triggers; the stream is stopped after half of them and started again."""
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rows = events_of(seed)
        batch = jobs.terminal_dedup(spark.createDataFrame(rows, EVENTS))
        want = sorted((r.event_id, r.ts) for r in batch.collect() if r.status is not None)
        random.Random(seed + 10).shuffle(rows)
        cut = sorted(random.Random(seed).sample(range(1, len(rows)), 3))
        parts = [rows[a:b] for a, b in zip([0, *cut], [*cut, len(rows)], strict=True)]
        schema = spark.createDataFrame([], EVENTS).schema
        stream = lambda: endings.stream_terminal_dedup(sinks.opened(spark, f"{tmp_path}/in/*", schema, files_a_trigger=1), "2 hours")
        for k, part in enumerate(parts[:2]):
            write(spark, part, f"{tmp_path}/in", k)
        sinks.run(stream(), str(tmp_path / "out"))
        first = sinks.rows_of(spark, str(tmp_path / "out"), schema).where("status in ('completed', 'failed')").count()
        assert first == 0  # all are held: the watermark is two hours behind
        for k, part in enumerate([*parts[2:], closing()], 2):
            write(spark, part, f"{tmp_path}/in", k)
        sinks.run(stream(), str(tmp_path / "out"))
        got = sinks.rows_of(spark, str(tmp_path / "out"), schema).where("event_id >= 0 and status is not null").collect()
        assert sorted((r.event_id, r.ts) for r in got) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_a_flag_is_forgotten_after_a_time(spark, tmp_path):
    minute = datetime.timedelta(minutes=1)
    rows = [(1, 1, NOON, "completed", 0, True, None), (2, 1, NOON + 5 * minute, "completed", 0, True, None), (3, 1, NOON + 600 * minute, "completed", 0, True, None)]
    schema = spark.createDataFrame([], EVENTS).schema
    for k, row in enumerate(rows):
        write(spark, [row], f"{tmp_path}/in", k)
        write(spark, [(-1 - k, 9, row[2] + 2 * minute, "processing", 0, None, None)], f"{tmp_path}/in", f"{k}b")
    write(spark, closing(), f"{tmp_path}/in", "z")

    def told(name, forget):
        found = sinks.opened(spark, f"{tmp_path}/in/*", schema, files_a_trigger=1)
        sinks.run(endings.stream_terminal_dedup(found, "1 minute", forget), str(tmp_path / name))
        return sorted(r.event_id for r in sinks.rows_of(spark, str(tmp_path / name), schema).where("job_id = 1").collect())

    assert told("kept", None) == [1]
    assert told("gone", 3_600_000) == [1, 3]


def test_status_goes_on_after_a_stop(spark, tmp_path):
    rows = [(i, j, ts, status or "processing", *rest) for i, j, ts, status, *rest in events_of(5)]
    schema = spark.createDataFrame([], EVENTS).schema
    stream = lambda: jobs.stream_latest_status(sinks.opened(spark, f"{tmp_path}/in/*", schema, files_a_trigger=1), "2 hours")
    write(spark, rows[:60], f"{tmp_path}/in", 0)
    sinks.run(told := stream(), str(tmp_path / "out"), "update")
    for k in (1, 2):
        write(spark, rows[30 + 30 * k : 60 + 30 * k], f"{tmp_path}/in", k)
    sinks.run(stream(), str(tmp_path / "out"), "update")
    sinks.run(stream(), str(tmp_path / "out"), "update")  # nothing new
    got = sinks.latest_of(spark, str(tmp_path / "out"), told.schema, ["job_id"])
    want = jobs.latest_status(spark.createDataFrame(rows, EVENTS))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    """The commit of the last batch is taken away, as if the driver were lost behind the write: the batch runs again under its number."""
    rows = events_of(6, 40)
    schema = spark.createDataFrame([], EVENTS).schema
    write(spark, rows[:20], f"{tmp_path}/in", 0)
    write(spark, rows[20:], f"{tmp_path}/in", 1)
    stream = lambda: sinks.opened(spark, f"{tmp_path}/in/*", schema, files_a_trigger=1)
    sinks.run(stream(), str(tmp_path / "out"))
    last = max((p for p in (tmp_path / "out" / "checkpoint" / "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    sinks.run(stream(), str(tmp_path / "out"))
    got = sinks.rows_of(spark, str(tmp_path / "out"), schema).collect()
    assert sorted(r.event_id for r in got) == list(range(40))


def test_settings_are_put_back(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    with pytest.raises(ZeroDivisionError), sinks.settings(spark, sinks.ROCKS):
        assert "RocksDB" in spark.conf.get(key)
        1 / 0  # noqa: B018
    assert spark.conf.get(key, None) == before


def test_a_log_is_read_as_it_grows(spark, tmp_path):
    line = '{"run_id": %d, "event_id": %d, "stage": "a", "event": "stage_duration", "duration_seconds": 2.0}'
    stream = lambda: sinks.opened(spark, f"{tmp_path}/in", StructType().add("value", "string"), "text", 1)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("\n".join([line % (1, 1), "not json", "", '{"event": "started"}']))
    for k in (1, 2):
        sinks.run(events := files.events_of(stream()), str(tmp_path / "good"))
        sinks.run(bad := files.rejected_of(stream()), str(tmp_path / "bad"))
        assert sorted(r.event_id for r in sinks.rows_of(spark, str(tmp_path / "good"), events.schema).collect()) == list(range(1, k + 1))
        assert sorted(r.reason for r in sinks.rows_of(spark, str(tmp_path / "bad"), bad.schema).collect()) == ["no stage", *["not JSON"] * k]
        (tmp_path / "in" / f"b{k}.log").write_text(line % (2, k + 1) + "\n{broken")


def test_progress_of_the_stream_by_minutes(spark, tmp_path):
    rows = [(i, j, ts, s or "processing", *rest) for i, j, ts, s, *rest in events_of(8)]
    schema = spark.createDataFrame([], EVENTS).schema
    write(spark, rows[:50], f"{tmp_path}/in", 0)
    write(spark, rows[50:], f"{tmp_path}/in", 1)
    write(spark, closing(), f"{tmp_path}/in", 2)
    stream = jobs.minute_error_rate(sinks.opened(spark, f"{tmp_path}/in/*", schema, files_a_trigger=1).withWatermark("ts", "2 hours"))
    sinks.run(stream, str(tmp_path / "out"))
    got = sinks.rows_of(spark, str(tmp_path / "out"), stream.schema).where(F.col("minute") < F.lit(NOON + datetime.timedelta(days=1)))
    want = jobs.minute_error_rate(spark.createDataFrame(rows, EVENTS))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_a_key_has_one_timer_for_its_earliest_ending():
    """Each held ending had a timer of its own, and each timer read the whole list again."""
    from types import SimpleNamespace

    from pyspark.sql.types import BooleanType, LongType, StructField, StructType

    from voxtable.streaming import endings

    class Value:
        kept = None
        get = lambda self: self.kept
        clear = lambda self: setattr(self, "kept", None)
        update = lambda self, v: setattr(self, "kept", v)

    class Held(list):
        get, appendList = list.copy, list.extend
        put = lambda self, rows: self.__setitem__(slice(None), rows)

    timers = []
    schema = StructType([StructField("event_id", LongType()), StructField(endings.TIME, LongType()), StructField("acked", BooleanType())])
    one = endings.FirstAcknowledged(schema)
    one.handle = SimpleNamespace(registerTimer=timers.append, getListState=lambda *_: Held(), getValueState=lambda *_: Value())
    one.init(one.handle)
    at = lambda millis: SimpleNamespace(getCurrentWatermarkInMs=lambda: millis)
    for ids in ((5, 6, 7, 8), (4, 9), (10, 11)):
        assert not list(one.handleInputRows(("j", "failed"), iter([(i, i * 1000, i == 9) for i in ids]), at(0)))
    assert timers == [5, 4]
    assert [r.event_id for r in one.handleExpiredTimer(("j", "failed"), at(6), None)] == [4, 5, 6]
    assert timers == [5, 4, 7]
    assert [r.event_id for r in one.handleExpiredTimer(("j", "failed"), at(20), None)] == [7, 8, 9]
    assert timers == [5, 4, 7] and not one.held


class Kept:
    """A value state that counts its calls."""

    def __init__(self):
        self.kept, self.calls = None, 0

    def get(self):
        self.calls += 1
        return self.kept

    def update(self, value):
        self.calls += 1
        self.kept = value


@pytest.mark.parametrize("forget", [None, 40])
def test_a_group_of_jobs_costs_one_read_and_one_write(forget):
    """The state was read and written for every job and trigger, several calls each. Four triggers that follow each other; forget is in milliseconds."""
    from types import SimpleNamespace

    import pyarrow as pa
    from pyspark.sql import Row

    r = random.Random(9)
    names = ["event_id", "job_id", "ts", "status", "acked"]
    kinds = pa.schema([("event_id", pa.int64()), ("job_id", pa.int64()), ("ts", pa.timestamp("us")), ("status", pa.string()), ("acked", pa.bool_())])
    rows = [(r.choice((None, i)), r.choice((None, *range(300))), r.randrange(200_000), r.choice(endings.ENDINGS), r.choice((True, False, None))) for i in range(5000)]
    schema = StructType().add("event_id", "long").add("job_id", "long").add("ts", "timestamp").add("status", "string").add("acked", "boolean")
    state, one, got = Kept(), endings.FirstOfJobs(schema, forget), []
    one.init(SimpleNamespace(getValueState=lambda *_: state))
    for k in range(4):
        mine = pa.table([pa.array(c, t) for c, t in zip(zip(*(x for x in rows if x[2] // 50_000 == k), strict=True), kinds.types, strict=True)], kinds)
        batches = mine.append_column(endings.GROUP, pa.array([0] * len(mine), pa.int64())).to_batches(500)
        packs = [Row(rows=b) for pack in endings.packing(forget)(iter(batches)) for b in pack.column("rows").to_pylist()]
        for out in one.handleInputRows((0,), iter(packs), None):
            told = endings.as_table([out.rows])
            got += zip(*(told[c].cast(pa.int64()).to_pylist() if c == "ts" else told[c].to_pylist() for c in names), strict=True)
        assert state.calls <= 2 * (k + 1)
    want, until = [], {}
    for x in sorted(rows, key=lambda x: (x[2], x[0] is not None, x[0])):
        if x[2] > until.get((x[1], x[3]), -1):
            want.append(x)
            if x[4]:
                until[x[1], x[3]] = 10**9 if forget is None else x[2] + 1000 * forget
    order = lambda x: tuple((v is not None, v) for v in x)
    assert sorted(got, key=order) == sorted(want, key=order)


def test_endings_of_many_jobs_in_few_groups(spark, tmp_path, monkeypatch):
    """Equal rows, large numbers beside nulls and a time far ahead come through as they are; a pack of rows is a few hundred bytes."""
    monkeypatch.setattr(endings, "PACK", 400)
    rows = [(i, j, at, status, None if i % 3 else 2**53 + 1, acked, m) for i, j, at, status, _, acked, m in events_of(11, 300)]
    rows += rows[::7]
    far = (900, 7, datetime.datetime(9000, 1, 1), "failed", None, None, "x")
    schema = spark.createDataFrame([], EVENTS).schema
    for k in range(3):
        write(spark, rows[k::3], f"{tmp_path}/in", k)
    write(spark, [far], f"{tmp_path}/in", 3)
    write(spark, [(-1, -1, datetime.datetime(9500, 1, 1), "processing", 0, None, None)], f"{tmp_path}/in", 4)
    found = sinks.opened(spark, f"{tmp_path}/in/*", schema, files_a_trigger=1)
    sinks.run(endings.stream_terminal_dedup(found, "2 hours", groups=3), str(tmp_path / "out"))
    got = sinks.rows_of(spark, str(tmp_path / "out"), schema).where("event_id >= 0 and status is not null").collect()
    want = jobs.terminal_dedup(spark.createDataFrame([*rows, far], EVENTS)).where("status is not null").collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_a_part_of_a_large_table_is_many_files_and_one_trigger(spark, tmp_path):
    """A part was one file, so that one task wrote it and few read it, however many rows it had."""
    from pathlib import Path

    from voxtable.plans.queries import arriving

    rows = spark.createDataFrame([x for x in events_of(12) if x[3]], EVENTS).repartition(3)
    folder, stream = arriving(rows, "parts")
    assert len(list(Path(folder.removeprefix("file://")).glob("in/*.parquet"))) == 12
    sinks.run(stream, str(tmp_path / "out"))
    told = sinks.with_batches(spark, str(tmp_path / "out"), rows.schema)
    assert told.select(sinks.BATCH).distinct().count() == 4 and told.count() == rows.count()


def test_state_partitions_follow_the_cores(spark, tmp_path):
    """A trigger had as many state partitions as the session's shuffles, each with its cost."""
    spark.conf.set(sinks.SHUFFLES, "40")
    try:
        schema = spark.createDataFrame([], EVENTS).schema
        write(spark, events_of(13, 20), f"{tmp_path}/in", 0)
        sinks.run(endings.stream_terminal_dedup(sinks.opened(spark, f"{tmp_path}/in/*", schema), "2 hours"), str(tmp_path / "out"))
        states = [[p for p in op.iterdir() if p.name.isdigit()] for op in (tmp_path / "out" / "checkpoint" / "state").iterdir() if op.name.isdigit()]
        assert [len(s) for s in states] == [sinks.STATES * spark.sparkContext.defaultParallelism] * 2
        assert spark.conf.get(sinks.SHUFFLES) == "40"
    finally:
        spark.conf.set(sinks.SHUFFLES, "4")
