"""Windows over very long recordings, by chunks of a recording that many tasks take.

A chunk is a function of a row (a stretch of time, or of numbers), so it is the same in every run. Within chunks windows run as they are;
each chunk then tells what the others need, one short row, and these rows are combined along the recording. A recording that fits a
chunk has one such row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

CHUNK = "_chunk"
#: Seconds, and rows by number, of a chunk.
SECONDS, NUMBERS = 6 * 3600.0, 1 << 16


def by_time(time: Column | str, seconds: float | None = None) -> Column:
    """The chunk of a time."""
    return F.floor((F.col(time) if isinstance(time, str) else time) / (SECONDS if seconds is None else seconds))


def by_number(number: str, many: int | None = None) -> Column:
    """The chunk of a row's number."""
    return F.floor(F.col(number) / (NUMBERS if many is None else many))


def told_to_chunks(rows: DataFrame, told: DataFrame) -> DataFrame:
    """rows with what is told for their chunk; told has a row for each chunk."""
    return rows.join(told.hint("merge"), ["recording_id", CHUNK])


def lane(far: Column) -> WindowSpec:
    """Rows for which far holds along the recording, the others by chunk: one window for both, as a union of the two may lose its partitioning."""
    return Window.partitionBy("recording_id", far, F.when(~far, F.col(CHUNK)))


def neighbours(rows: DataFrame, chunk: Column, order: list[str], before: dict[str, str], after: dict[str, str] | None = None, head: str = "_head") -> DataFrame:
    """rows with columns of the row before (new name: column) and after in each recording, and whether a row is the first.

    order tells rows of a recording apart and ascends with the chunk. A chunk's first and last row find their neighbours among those of
    all chunks, two rows for each.
    """
    after = after or {}
    own = Window.partitionBy("recording_id", CHUNK).orderBy(*order)
    near = {n: F.lag(c).over(own) for n, c in before.items()} | {n: F.lead(c).over(own) for n, c in after.items()}
    edges = {"_first_here": F.row_number().over(own) == 1, "_last_here": F.lead(F.lit(1)).over(own).isNull()}
    told = rows.withColumn(CHUNK, chunk).withColumns(near | edges)
    edge = F.col("_first_here") | F.col("_last_here")
    along = lane(edge).orderBy(*order)
    whole = {n: F.when(F.col("_first_here"), F.lag(c).over(along)).otherwise(F.col(n)) for n, c in before.items()}
    whole |= {n: F.when(F.col("_last_here"), F.lead(c).over(along)).otherwise(F.col(n)) for n, c in after.items()}
    return told.withColumns(whole | {head: edge & (F.row_number().over(along) == 1)}).drop("_first_here", "_last_here", CHUNK)


def islands(rows: DataFrame, chunk: Column, order: str, before: dict[str, str], joined: Column, name: str) -> DataFrame:
    """rows with the order of the row at which their island begins: the last, up to each, that is not joined to the row before.

    joined is a condition on the row and on columns of the row before (new name: column). Within a chunk all is known from its first
    beginning on; what lies before it, and the chunk's last row, goes along the recording.
    """
    own = Window.partitionBy("recording_id", CHUNK).orderBy(order)
    near = {n: F.lag(c).over(own) for n, c in before.items()}
    edges = {"_first_here": F.row_number().over(own) == 1, "_last_here": F.lead(F.lit(1)).over(own).isNull()}
    apart = ~F.coalesce(joined, F.lit(False))
    told = rows.withColumn(CHUNK, chunk).withColumns(near | edges)
    told = told.withColumn("_begins", F.when(~F.col("_first_here") & apart, F.col(order)))
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    told = told.withColumn(name, F.last("_begins", ignorenulls=True).over(upto(own)))
    told = told.withColumn("_open", F.col(name).isNull() | F.col("_last_here"))
    along = lane(F.col("_open")).orderBy(order)
    told = told.withColumns({n: F.when(F.col("_first_here"), F.lag(c).over(along)).otherwise(F.col(n)) for n, c in before.items()} | {"_one": F.row_number().over(along) == 1})
    told = told.withColumn(name, F.when(F.col("_first_here") & (F.col("_one") | apart), F.col(order)).otherwise(F.col(name)))
    told = told.withColumn(name, F.when(F.col("_open"), F.last(name, ignorenulls=True).over(upto(along))).otherwise(F.col(name)))
    return told.drop("_first_here", "_last_here", "_begins", "_open", "_one", CHUNK, *before)


def running_extremes(rows: DataFrame, chunk: Column, by: str, largest: str, smallest: str) -> DataFrame:
    """rows with _largest, the largest value of a column over all rows up to each by another, equals included, and _smallest, the smallest from each on."""
    cut = rows.withColumn(CHUNK, chunk)
    ends = cut.groupBy("recording_id", CHUNK).agg(F.max(largest).alias("_l"), F.min(smallest).alias("_s"))
    up, down = (Window.partitionBy("recording_id").orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.asc(CHUNK), F.desc(CHUNK)))
    carried = ends.select("recording_id", CHUNK, F.max("_l").over(up).alias("_before"), F.min("_s").over(down).alias("_after"))
    # both frames grow from their start, the second along the reverse order, so each row is looked at once
    own_up, own_down = (Window.partitionBy("recording_id", CHUNK).orderBy(o).rangeBetween(Window.unboundedPreceding, 0) for o in (F.asc(by), F.desc(by)))
    met = told_to_chunks(cut.withColumns({"_largest": F.max(largest).over(own_up), "_smallest": F.min(smallest).over(own_down)}), carried)
    return met.withColumns({"_largest": F.greatest("_largest", "_before"), "_smallest": F.least("_smallest", "_after")}).drop("_before", "_after", CHUNK)
