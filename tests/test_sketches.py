"""Sketches kept by day and merged against exact counts and percentiles, within their stated errors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxtable.operators import sketches


@pytest.fixture(scope="module")
def rows(spark):
    n = F.col("id")
    value = F.when(n % 100 == 7, None).otherwise(F.pmod(F.xxhash64("id"), F.lit(100_000)) / 7.0)
    return spark.range(60_000).select((n % 3).alias("day"), (n % 2).alias("part"), F.concat(F.lit("s"), F.pmod(F.hash("id"), F.lit(9_000)).cast("string")).alias("speaker"), value.alias("x")).persist()


def kept(rows, path):
    for d in (0, 1, 2):
        made = sketches.sketched(rows.where(F.col("day") == d), ["part"], {"speakers": F.col("speaker")}, {"xs": F.col("x")})
        sketches.write_day(made, path, f"2024-05-0{d + 1}")
    return made


def test_days_are_merged(rows, tmp_path):
    made = kept(rows, str(tmp_path))
    kept(rows, str(tmp_path))  # written again, a day is not counted twice
    for by, first, last, days in ((["part"], None, None, (0, 1, 2)), ([], None, None, (0, 1, 2)), ([], "2024-05-02", "2024-05-02", (1,)), (["part"], "2024-05-02", None, (1, 2))):
        told = sketches.merged(sketches.read_days(made, str(tmp_path), first, last), by, ["speakers"], ["xs"])
        ranks = (0.05, 0.2, 0.5, 0.99)
        told = told.select(*by, "n_rows", sketches.distinct_count("speakers").alias("n"), *[sketches.percentile("xs", r).alias(f"p{i}") for i, r in enumerate(ranks)])
        some = rows.where(F.col("day").isin(*days))
        exact = {tuple(r[c] for c in by): r for r in some.groupBy(*by).agg(F.count("*").alias("n_rows"), F.countDistinct("speaker").alias("n"), F.array_sort(F.collect_list("x")).alias("xs")).collect()}
        assert told.count() == len(exact)
        for r in told.collect():
            want = exact[tuple(r[c] for c in by)]
            assert r.n_rows == want.n_rows
            assert abs(r.n - want.n) <= 4 * sketches.COUNT_ERROR * want.n
            for i, rank in enumerate(ranks):
                at = np.searchsorted(want.xs, r[f"p{i}"]) / len(want.xs)
                assert abs(at - rank) <= 4 * sketches.RANK_ERROR


def test_sketches_are_small(rows):
    made = sketches.sketched(rows, [], {"speakers": F.col("speaker")}, {"xs": F.col("x")})
    size = made.select((F.length("speakers") + F.length("xs")).alias("n")).first().n
    assert size < 50_000


def test_groups_without_values(spark, tmp_path):
    none = spark.createDataFrame([(1, None, None)], "part long, speaker string, x double")
    made = sketches.sketched(none, ["part"], {"speakers": F.col("speaker")}, {"xs": F.col("x")})
    sketches.write_day(made, str(tmp_path), "2024-05-01")
    told = sketches.merged(sketches.read_days(made, str(tmp_path)), ["part"], ["speakers"], ["xs"])
    row = told.select("n_rows", sketches.distinct_count("speakers").alias("n"), sketches.percentile("xs", 0.2).alias("p")).first()
    assert (row.n_rows, row.n, row.p) == (1, 0, None)
    assert sketches.read_days(made, str(tmp_path), "2025-01-01").count() == 0
