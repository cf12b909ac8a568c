"""Rules resolved by the analyser, the table of rejected rows, and open metadata merged key by key."""

import json

import pytest
from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import functions as F

from voxtable.operators import document, quality


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([(1, "abc", 0.5), (2, "xyz", 2.0), (3, None, -1.0), (4, "abcd", None)], "id long, text string, `odd name` double")


def test_functions_and_quoted_words_are_no_columns(rows):
    rules = {"length": "length(text) = 3", "word": "text = 'abc'", "high": "`odd name` > 1", "gone": "missing > 1", "struct": "text.part = 1"}
    with pytest.raises(AnalysisException):
        quality.constraint_quarantine(rows, rules)  # a field of a string is a fault, no absent column
    rules.pop("struct")
    told = {r.id: (r.reasons, r.valid, r.unchecked) for r in quality.constraint_quarantine(rows, rules).collect()}
    assert told == {1: (["length", "word"], False, ["gone"]), 2: (["length", "high"], False, ["gone"]), 3: ([], True, ["gone"]), 4: ([], True, ["gone"])}
    with pytest.raises(ValueError, match="gone"):
        quality.constraint_quarantine(rows, rules, strict=True)
    with pytest.raises(ParseException):
        quality.constraint_quarantine(rows, {"bad": "text = = 1"})


def test_no_rules_and_no_rows(spark, rows):
    assert {(tuple(r.reasons), r.valid, tuple(r.unchecked)) for r in quality.constraint_quarantine(rows, {}).collect()} == {((), True, ())}
    assert quality.constraint_quarantine(rows.limit(0), {"a": "id > 1"}).count() == 0


def test_rejected_rows_are_a_table(spark, rows, tmp_path):
    checked = quality.constraint_quarantine(rows, {"length": "length(text) = 3", "high": "`odd name` > 1"})
    for _ in range(2):
        kept = quality.write_quarantine(checked, str(tmp_path / "bad"))
    assert kept.columns == rows.columns and sorted(r.id for r in kept.collect()) == [3, 4]
    bad = spark.read.parquet(str(tmp_path / "bad"))
    assert sorted((r.id, r.reason, tuple(r.reasons)) for r in bad.collect()) == [(1, "length", ("length",))] * 2 + [(2, "length", ("length", "high"))] * 2


def test_metadata_is_merged_key_by_key(spark):
    pairs = [
        ('{"a": 1, "b": {"x": 1}}', '{"b": {"y": 2}, "c": [1, null]}'), ('{"a": 1}', '{"a": null}'), ('{"a": 1}', None), (None, '{"k": "é"}'), (None, None), ("{}", "{}"),
    ]
    table = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "id long, base string, extra string")
    merged = document.merged_metadata(F.parse_json("base"), F.parse_json("extra"))
    got = {r.id: json.loads(r.m) for r in table.select("id", F.to_json(merged).alias("m")).collect()}
    assert got == {i: {**json.loads(a or "{}"), **json.loads(b or "{}")} for i, (a, b) in enumerate(pairs)}
