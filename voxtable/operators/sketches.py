"""Distinct counts and percentiles of a whole corpus from mergeable sketches, kept by day.

An exact count of distinct speakers, or a percentile over all frames, needs all rows again for every question. A sketch of each day is a few
kilobytes, whatever the day's rows; those of any days are merged. Distinct counts are HyperLogLog sketches: their relative standard error is
1.04 / sqrt(2^DISTINCT_BITS), 1.6 %. Percentiles are KLL sketches: the rank of what they give is off by some 2.3 / QUANTILE_K^0.9,
0.6 %. Nulls are left out of both; a group without values has a null percentile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DISTINCT_BITS, QUANTILE_K = 12, 800
#: Standard errors: relative of a count, absolute of a rank.
COUNT_ERROR, RANK_ERROR = 1.04 / 2 ** (DISTINCT_BITS / 2), 2.296 / QUANTILE_K**0.9021


def sketched(rows: DataFrame, by: list[str], distinct: dict[str, Column] | None = None, values: dict[str, Column] | None = None) -> DataFrame:
    """One row for each group of by: n_rows, and a sketch for each of distinct (name: column) and values (name: double)."""
    counts = [F.hll_sketch_agg(c, DISTINCT_BITS).alias(n) for n, c in (distinct or {}).items()]
    ranks = [F.kll_sketch_agg_double(c.cast("double"), QUANTILE_K).alias(n) for n, c in (values or {}).items()]
    return rows.groupBy(*by).agg(F.count("*").alias("n_rows"), *counts, *ranks)


def write_day(sketches: DataFrame, path: str, day: str) -> None:
    """Keeps sketches under a day; a day that is written again replaces what it had."""
    sketches.write.mode("overwrite").parquet(f"{path}/day={day}")


def read_days(sketches_of: DataFrame, path: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """The sketches of the days from first to last, each included. sketches_of tells their columns."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in sketches_of.schema)}, day string"
    told = sketches_of.sparkSession.read.schema(schema).parquet(path)
    return told.where(F.lit(True) if first is None else F.col("day") >= first).where(F.lit(True) if last is None else F.col("day") <= last)


def merged(sketches: DataFrame, by: list[str], distinct: list[str] | None = None, values: list[str] | None = None) -> DataFrame:
    """Sketches of finer groups, or of several days, as those of coarser ones."""
    counts = [F.hll_union_agg(n).alias(n) for n in distinct or []]
    ranks = [F.kll_merge_agg_double(n).alias(n) for n in values or []]
    return sketches.groupBy(*by).agg(F.sum("n_rows").alias("n_rows"), *counts, *ranks)


def distinct_count(sketch: str) -> Column:
    return F.hll_sketch_estimate(sketch)


def percentile(sketch: str, rank: float) -> Column:
    """The value at a rank between 0 and 1; null where the sketch has no values."""
    return F.when(F.kll_sketch_get_n_double(sketch) > 0, F.kll_sketch_get_quantile_double(sketch, F.lit(rank)))
