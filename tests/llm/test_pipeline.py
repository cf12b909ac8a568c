"""The pipeline's stages: decisions take effect, columns stay, and the files hold what the mix kept."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_operators import brute_components, brute_contamination
from voxtable.llm import mixing, queries, toxicity


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("size", F.lit("x")).persist()
    kept = docs
    for name, function in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, function(spark, kept, sf_dir).persist()
        assert kept.columns == docs.columns, name
        if name != "mixing":
            assert 0 < kept.count() < before.count() or name == "decontamination"
            assert kept.join(docs, "doc_id", "left_anti").count() == 0
    sources = collections.Counter({r.source: r.n for r in before.groupBy("source").agg(F.sum(mixing.words()).alias("n")).collect()})
    total = sum(r.n for r in kept.groupBy("source").agg(F.sum(mixing.words()).alias("n")).collect())
    largest = before.agg(F.max(mixing.words())).first()[0]
    assert abs(total - 1.5 * sum(sources.values())) <= largest * len(sources)
    out = corpus_pipeline.token_output(spark, kept, sf_dir)
    assert out.count() == kept.count()
    end = out.orderBy(F.desc("start")).first()
    assert out.agg(F.sum("n_tokens")).first()[0] == end.start + end.n_tokens


def test_near_duplicates_are_gone(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    once = corpus_pipeline.near_duplicate_filter(spark, docs, sf_dir)
    assert corpus_pipeline.near_duplicate_filter(spark, once, sf_dir).count() == once.count()


def test_queries_and_sql_have_the_same_names():
    assert set(queries.oracle_sql()) <= set(queries.queries())


def brute_pipeline(spark, rows, labels, items, documents, label_table):
    """(doc_id, start, n_tokens, ids_crc32) as run() should give, by plain loops over rows (doc_id, text, source)."""
    model = toxicity.fit(toxicity.training_rows(documents, label_table))
    weights, intercept = model.weights(), model.regression.intercept
    score = lambda t: 1 / (1 + math.exp(-intercept - sum(weights.get(w, 0) for w in set(re.findall(r"[^\W\d_]+", (t or "").lower())))))
    rows = [r for r in rows if score(r[1]) < toxicity.THRESHOLD]
    parts = collections.defaultdict(list)
    for r, (_, n, _, root) in zip(rows, brute_roots(rows), strict=True):
        parts[root if n else object()].append(r)
    rows = [min(p, key=lambda r: (r[0] is None, r[0] or 0)) for p in parts.values()]
    found = [(r, brute_contamination(r[1] or "", items)) for r in rows]
    rows = [r for r, (n, hit, _) in found if not (hit and 20 * hit >= n)]
    words = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    tie = lambda t: xxhash.xxh64_intdigest((t or "").encode(), 42)
    place = lambda r: (int(hashlib.md5(("null" if r[0] is None else str(r[0])).encode()).hexdigest()[:14], 16), (42 if r[1] is None else tie(r[1])) >> 8)
    sizes = collections.Counter()
    for r in rows:
        sizes[r[2]] += words(r)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, open_, rest = {}, set(order), 1.5 * sum(sizes.values())
    while over := {s for s in open_ if rest * weight[s] / sum(weight[x] for x in open_) > 2 * sizes[s]}:
        target |= {s: 2.0 * sizes[s] for s in over}
        rest -= sum(target[s] for s in over)
        open_ -= over
    target |= {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
    out = []
    for s in order:
        q = int(target[s] // sizes[s]) if sizes[s] else 0
        need = target[s] - q * sizes[s]
        for r in sorted((r for r in rows if r[2] == s), key=place):
            more = need > 0 and (words(r) < need or 2 * need > words(r))
            need -= words(r)
            out += [r] * (q + more)
    library = Tokenizer.from_file(public_tokenizers.path(queries.TOKENIZER))
    told, start = [], 0
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    for i, t, _ in sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, signed(42 if r[1] is None else tie(r[1])))):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        told.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return told


def brute_roots(rows):
    """brute_components with the number of each row's component."""
    told = brute_components([(i, t, s) for i, (_, t, s) in enumerate(rows)])
    return [(*x, x[2]) for x in told]


def test_run_is_the_brute_force_pipeline(spark, tmp_path):
    """Null and repeated ids, wholly repeated rows, copies that share an id with another text, and columns whose names clash."""
    r = random.Random(12)
    text = lambda n: " ".join(f"w{r.randrange(4000)}" for _ in range(n))
    rows = [(i, text(r.randrange(20, 60)), r.choice(("a", "b", None))) for i in range(10, 90)]
    rows += [(100 + i, t + " idiot scum", s) for i, (_, t, s) in enumerate(rows[:20])]
    rows += [(200 + i, t + f" end{i}", s) for i, (_, t, s) in enumerate(rows[30:45])]
    items = [("x", text(30)), ("y", text(5)), (None, "q")]
    rows += [(300, items[0][1], "a"), (301, text(40) + " " + items[0][1] + " " + text(9), "b"), (302, text(900) + " " + items[0][1], "b")]
    rows += [(2, rows[50][1], "a"), (2, text(33), "a"), (3, "one two three", "b"), (3, "one two three", "b"), (None, text(21), "a"), (None, rows[60][1], "a"), (4, None, "b"), (5, "", None)]
    labels = [(i, int("idiot" in (t or ""))) for i, t, _ in rows if i is not None]
    documents = spark.createDataFrame([(*x, "k", 1.5, 7) for x in rows], "doc_id long, text string, source string, key string, score double, row int")
    label_table = spark.createDataFrame(labels, "doc_id long, toxic int")
    documents.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    label_table.coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id string, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    got = [tuple(x) for x in corpus_pipeline.run(spark, str(tmp_path)).orderBy("start").collect()]
    named = [("null" if i is None else i, t) for i, t in items]
    read = [spark.read.parquet(str(tmp_path / f"{x}.parquet")) for x in ("documents", "labels")]
    want = brute_pipeline(spark, rows, labels, named, *read)
    assert {x[0] for x in got} >= {None, 2} and 300 not in {x[0] for x in got}
    assert got == want


def test_run_on_empty_tables(spark, tmp_path):
    for name, kind in (("documents", "doc_id long, text string, source string"), ("labels", "doc_id long, toxic int"), ("benchmark", "item_id string, text string")):
        spark.createDataFrame([], kind).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
