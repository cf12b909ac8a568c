"""Words of many texts by arrays: the same words and hashes however the bytes are cut, and cheap; staged tables go when they are used up."""

import random
import re
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from voxtable.llm import decontaminate, minhash
from voxtable.llm.common import SLOTS, possible, shared_dir, slots_for, stage, staged_alone


def test_words_do_not_depend_on_pieces(monkeypatch):
    monkeypatch.setattr(decontaminate, "_powers", [])
    monkeypatch.setattr(decontaminate, "PIECE", 40)
    r = random.Random(3)
    for _ in range(100):
        texts = ["".join(r.choice("aB1 é.\n\t日__x-") for _ in range(r.choice((0, 3, 30, 200)))) for _ in range(r.randint(0, 6))] + ["w" * 300 + " x"] * r.randint(0, 1)
        words = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) for t in texts]
        flat = [w.encode() for own in words for w in own]
        block = decontaminate.Block([t.encode() for t in texts])
        assert [block.data[a:b] for a, b in zip(block.starts, block.stops, strict=True)] == flat
        assert np.diff(block.first).tolist() == list(map(len, words))
        alone = {w: int(decontaminate.Block([w]).hashes()[0]) for w in set(flat)}
        assert block.hashes().tolist() == [alone[w] for w in flat] and len(set(alone.values())) == len(alone)
        assert decontaminate.word_counts(pa.array([*texts, None])).to_pylist() == [*map(len, words), 0]
        at, found = block.hits(np.full(1 << 10, 255, np.uint8), 3)
        assert at.tolist() == [int(block.first[i]) + k for i, own in enumerate(words) for k in range(len(own) - 2)] and len(found) == len(at)


def test_hashing_is_cheap():
    r = random.Random(1)
    words = ["".join(r.choice("abcdefghijklmno") for _ in range(r.randint(2, 9))) for _ in range(20_000)]
    batch = pa.RecordBatch.from_pydict({"text": [" ".join(r.choices(words, k=2_000)) for _ in range(1_000)]})
    began = time.process_time()
    for block in decontaminate.blocks(batch):
        block.hits(np.zeros(1 << 16, np.uint8), 3)
    assert time.process_time() - began < 2.5  # 2 million words


def folders(spark):
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    return {x.getPath().getName() for x in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)}


def test_used_tables_are_deleted(spark):
    documents = spark.createDataFrame([(1, "one two three four"), (2, "else")], "doc_id long, text string")
    stage(documents, "other")
    before = folders(spark)

    @staged_alone("outer")
    def outer():
        return inner().unionByName(stage(documents, "passing"))

    @staged_alone("inner")
    def inner():
        return stage(documents, "passing")

    assert outer().count() == 4 and [x.split("-")[0] for x in folders(spark) - before] == ["outer"] and before <= folders(spark)
    benchmark = spark.createDataFrame([("x", "two three")], "item_id string, text string")
    before = folders(spark)
    out = decontaminate.match(documents, benchmark)
    assert {x.rsplit("-", 1)[0] for x in folders(spark) - before} == {"bench-hits"}
    assert sorted((x.row.doc_id, x.n_words, x.n_hit) for x in out.collect()) == [(1, 4, 2), (2, 1, 0)]


def test_near_duplicates_leave_one_table(spark):
    """What finding near-duplicates wrote on the way is gone when the stage's result is read."""
    base = " ".join(f"w{i}" for i in range(40))
    rows = [(1, base), (2, base + " end"), (3, base), (4, "one two"), (5, None), (5, None), (6, "one two")]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    before = folders(spark)
    once = minhash.one_of_each(documents)
    assert {x.rsplit("-", 1)[0] for x in folders(spark) - before} == {"minhash-touched"}
    assert sorted(r.doc_id for r in once.collect()) == [1, 4, 5, 5]
    before = folders(spark)
    found = minhash.near_duplicates(documents)
    assert {x.rsplit("-", 1)[0] for x in folders(spark) - before} == {"minhash-rows", "minhash-final"}
    assert sorted(r.component_id for r in found.collect()) == [1, 1, 1, 4, 4, 5, 5]


def test_maps_are_as_small_as_their_keys(spark):
    """A map of few keys has few bits, a full one lets everything through, and no key is held back."""
    keys = stage(spark.range(0, 3000, 3).select(F.xxhash64("id").alias("k")), "keys")
    rows = spark.range(3000).select("id", F.xxhash64("id").alias("k"))
    told = {r.id: r._may for r in possible(rows, keys, "k").collect()}
    assert all(told[i] for i in range(0, 3000, 3)) and sum(told.values()) < 1100
    maps = [r for r in possible(rows, keys, "k")._jdf.queryExecution().optimizedPlan().toString().split("\n") if "pmod" in r]
    assert slots_for(1000) == 1 << 18 and maps and not any(str(SLOTS) in r for r in maps)
