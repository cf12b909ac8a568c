"""Packing, periodic runs and vector codes against brute-force versions, with nulls, empty and long texts, ties, repeats and clashing names."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.compare import connect, rows_of_spark, rows_of_sql
from voxtable.llm import lexical_packing as packing
from voxtable.llm import periodic_runs as periodic
from voxtable.llm import queries, url_filters, vector_codes, warc

DOCUMENTS = "doc_id long, text string, shard string, ids string, x string, row string"


def texts(seed=3, n=90):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdef") for _ in range(r.randint(2, 5)))
    base = [[word() for _ in range(r.choice((3, 12, 40, 90)))] for _ in range(n // 4)]
    rows = []
    for i in range(n):
        words = list(r.choice(base))
        if i % 4 == 0:
            words = words[: r.randint(1, len(words))] * r.randint(1, 6)
        rows.append((i * 7, "\t\n ".join(words) if i % 9 == 0 else " ".join(words)))
    odd = "<|StartOfText|> It's <|endoftext|> Übung ΣΊΣΥΦΟΣ 12 can't STOP á x\x1cy   naïve-Test 日本語"
    rows += [(1000, None), (1001, ""), (1002, " \n\x0b"), (None, "lost one here"), (1003, odd), (1004, " ".join(word() for _ in range(9_000)))]
    rows += [(1005, "la " * 5_000), rows[5], rows[5], (None, "lost one here")]
    return [(*r, "s", "i", "x", "r") for r in rows]


@pytest.fixture(scope="module")
def rows():
    return texts()


@pytest.fixture(scope="module")
def documents(spark, rows):
    return spark.createDataFrame(rows, DOCUMENTS).repartition(3).persist()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCUMENTS)


# --- packing


def test_packing_holds_every_id_once(documents, rows, nothing):
    path = public_tokenizers.path(queries.PACKED_TOKENIZER)
    library = Tokenizer.from_file(path)
    want = Counter((r[0], np.array([*library.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for r in rows)
    pieces = packing.pack(documents, path, shard=4_000)
    out = pieces.collect()
    sequences = defaultdict(list)
    for r in out:
        assert r["length"] == len(r["ids"]) // 4 > 0
        sequences[r["sequence_id"]].append(r)
    total = 0
    for own in sequences.values():
        own.sort(key=lambda r: r["offset"])
        ends = np.cumsum([r["length"] for r in own])
        assert [r["offset"] for r in own] == [0, *ends[:-1]] and ends[-1] <= 2048 and int(ends[-1]).bit_count() == 1
        total += ends[-1]
    assert total == sum(len(b) // 4 for _, b in want.elements())
    # repeated rows share an id, so pieces of one id are a way through copies of its texts
    by_id = defaultdict(list)
    for r in out:
        by_id[r["doc_id"], r["doc_tokens"]].append(r)
    for (doc_id, n), own in by_id.items():
        copies = [b for (i, b), c in want.items() if i == doc_id and len(b) == 4 * n for _ in range(c)]
        assert sum(r["length"] for r in own) == n * len(copies)
        for r in own:
            assert any(b[4 * r["start"] : 4 * (r["start"] + r["length"])] == r["ids"] for b in copies)
    padded = packing.sequences(pieces, pad_id=7).collect()
    assert len(padded) == len(sequences)
    for r in padded:
        own = b"".join(p["ids"] for p in sequences[r["sequence_id"]])
        assert r["n_tokens"] == len(own) // 4 and r["ids"] == own  # powers of two have no padding
    assert packing.pack(nothing, path).count() == 0


def test_padding_reaches_the_window(spark):
    pieces = spark.createDataFrame([(1, 0, 3, b"\1\0\0\0" * 3, 3, 9, 0)], packing.PIECES)
    (row,) = packing.sequences(pieces, window=8, pad_id=5).collect()
    assert row["n_tokens"] == 3 and row["ids"] == b"\1\0\0\0" * 3 + b"\5\0\0\0" * 5


def test_bm25_scores_are_those_of_the_formula():
    r = random.Random(5)
    docs = [[r.randint(2, 40) for _ in range(r.randint(1, 60))] + [1] for _ in range(40)]
    df = Counter(t for d in docs for t in set(d))
    idf = lambda t: max(0.0, math.log((len(docs) - df[t] + 0.5) / (df[t] + 0.5)))
    weight = np.array([idf(t) if df[t] else 0.0 for t in range(50)])
    mean = sum(map(len, docs)) / len(docs)
    sizes = np.array(list(map(len, docs)))
    index = packing.Index(np.concatenate([np.array(d, np.uint16) for d in docs]), sizes, packing.Statistics(len(docs), mean, weight, 2))
    for seed, own in enumerate(docs):
        want = [sum(idf(t) * d.count(t) * 2.2 / (d.count(t) + 1.2 * (0.25 + 0.75 * len(d) / mean)) for t in set(own)) for d in docs]
        assert np.allclose(index.scores(seed), want)
        used = np.zeros(len(docs), bool)
        used[seed] = True
        found = index.neighbours(seed, used)
        assert seed not in found and all(want[a] >= want[b] - 1e-9 for a, b in zip(found, found[1:], strict=False))


def test_a_window_takes_its_seeds_neighbours():
    """Three texts about one matter among others: the window that starts with one goes on with the other two."""
    matter = [[100, 101, 102, 1], [100, 102, 103, 1], [101, 102, 103, 1]]
    others = [[t, t + 1, t + 2, 1] for t in range(10, 90, 4)]
    docs = [matter[0], *others[:9], matter[1], *others[9:], matter[2]]
    sizes = np.full(len(docs), 4)
    df = Counter(t for d in docs for t in set(d))
    weight = np.array([max(0.0, math.log((len(docs) - df[t] + 0.5) / (df[t] + 0.5))) if df[t] else 0.0 for t in range(200)])
    index = packing.Index(np.concatenate([np.array(d, np.uint16) for d in docs]), sizes, packing.Statistics(len(docs), 4.0, weight, 2))
    pieces = packing.filled(sizes, index, 12)
    assert {d for d, *_, s, _ in pieces if s == 0} == {0, 10, len(docs) - 1}


def test_topics_with_many_tokens_have_several_shards():
    told = packing.shards_of({3: 10, 4: 95, 5: 1000, 6: 40, 7: 60}, shard=100)
    assert told == {3: (0, 1), 4: (1, 1), 5: (2, 10), 6: (12, 1), 7: (12, 1)}


# --- periodic runs


def brute_runs(words, least=12):
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i - start + q >= max(least, 2 * q):
                found.setdefault((start, i - start + q), q)
            i += i == start
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def test_runs_of_small_alphabets():
    r = random.Random(1)
    for _ in range(150):
        docs = []
        for _ in range(r.randint(1, 6)):
            d = [r.randint(1, r.choice((1, 2, 3, 20))) for _ in range(r.choice((0, 1, 5, 12, 13, 40, 100, 300)))]
            if d and r.random() < 0.6:
                a, p = r.randrange(len(d)), r.randint(1, max(1, len(d) // 3))
                d = [d[i] if i < a else d[min(len(d) - 1, a + (i - a) % p)] for i in range(len(d))]
            docs.append(d)
        least = r.choice((12, 12, 2, 5))
        got = periodic.runs([np.array(d, np.uint32) for d in docs], least)
        assert [tuple(x) for x in got.tolist()] == [(k, *x) for k, d in enumerate(docs) for x in brute_runs(d, least)]


def test_extensions_are_those_of_the_words():
    r = random.Random(2)
    words = [r.randint(1, 2) for _ in range(400)]
    words[200:330] = words[20:150]
    e = periodic.Extensions(np.array([*words, periodic.SEPARATOR], np.uint32))
    pairs = [(i, j) for i in range(0, 400, 3) for j in range(i + 1, 400, 7)]
    want = []
    for i, j in pairs:
        n = 0
        while j + n < 400 and words[i + n] == words[j + n]:
            n += 1
        want.append(n)
    i, j = np.array(pairs).T
    assert e.common(i, j).tolist() == want == e.common(j, i).tolist()


@pytest.mark.parametrize("group", [1, 300, 1 << 16])
def test_periodic_runs(documents, rows, nothing, monkeypatch, group):
    monkeypatch.setattr(periodic, "GROUP_WORDS", group)
    monkeypatch.setattr(periodic, "PAIRS", 5_000)
    told = periodic.digests(periodic.find_runs(documents.where("doc_id is null or doc_id <> 1004"), order=periodic.made_periodic)).collect()
    want = Counter()
    for doc_id, text, *_ in rows:
        if doc_id == 1004:
            continue
        words = (text or "").translate({x: " " for x in range(9, 14)}).split(" ")
        words = [w for w in words if w]
        h = zlib.crc32(str(doc_id).encode())
        if doc_id is not None and h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = brute_runs(words)
        drop = {i for s, n, q in runs for i in range(s + q, s + n)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        kept = " ".join(w for i, w in enumerate(words) if i not in drop)
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        want[(doc_id, len(runs), *best, best[1] * 1000 // best[2] if runs else None, sha(lines), sha(kept))] += 1
    assert Counter(map(tuple, told)) == want
    assert any(r["n_runs"] > 0 for r in told)
    assert periodic.find_runs(nothing).count() == 0


def test_a_long_document_has_its_runs(spark):
    """20,000 words with a long period in the middle."""
    words = [str(i) for i in range(8_000)] + [str(-i) for i in range(2_000)] * 3 + [str(i) for i in range(6_000)]
    (row,) = periodic.find_runs(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")).collect()
    assert [tuple(r) for r in row["runs"]] == [(8_000, 6_001, 2_000)]  # -0 is 0, with which the rest begins
    assert row["n_words"] == 20_000 and len(row["collapsed"].split()) == 20_000 - 4_001


# --- vector codes


def brute_codes(rows, parts, entries, rounds):
    fine = [(i, [math.floor(256 * x) for x in v], k) for i, v, k in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not fine:
        return [], []
    width = -(-max(max(len(v) for _, v, _ in fine), 1) // parts) * parts
    fine = [(i, v + [0] * (width - len(v)), k) for i, v, k in fine]
    d = width // parts
    cut = lambda v: [tuple(v[p * d : (p + 1) * d]) for p in range(parts)]
    fine = [(i, cut(v), k) for i, v, k in fine]
    first = sorted(fine, key=lambda r: (r[0] is None, r[0], r[1]))[:entries]
    books = [[r[1][p] for r in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda p, v: min(range(len(books[p])), key=lambda e: (far(v[p], books[p][e]), e))
    for _ in range(rounds):
        new = [list(b) for b in books]
        for p in range(parts):
            held = defaultdict(list)
            for _, v, _ in fine:
                held[nearest(p, v)].append(v[p])
            for e, own in held.items():
                new[p][e] = tuple(sum(x) // len(own) for x in zip(*own, strict=True))
        books = new
    out = []
    for i, v, k in fine:
        codes = [nearest(p, v) for p in range(parts)]
        out.append((i, k, "".join(f"{c:02x}" for c in codes), sum(far(v[p], books[p][c]) for p, c in enumerate(codes))))
    total = Counter()
    for _, k, _, e in out:
        total[k] += e
    return [(i, c, e, total[k]) for i, k, c, e in out], [x for b in books for e in b for x in e]


@pytest.mark.parametrize(("parts", "entries", "block", "scale"), [(2, 5, 50, 0.05), (4, 16, 1000, 1.0), (1, 3, 7, 3e5)])
def test_vector_codes(spark, monkeypatch, parts, entries, block, scale):
    monkeypatch.setattr(vector_codes, "BLOCK", block)
    monkeypatch.setattr(vector_codes, "LEAF", 6)
    r = random.Random(parts)
    rows = [(i, [float(np.float32(r.gauss(0, scale))) for _ in range(8)], r.choice((1, 2, None))) for i in range(300)]
    rows += [(i + 300, rows[i % 4][1], 1) for i in range(60)] + [(500, None, 1), (501, [1.0, None], 2), (502, [float("nan")] * 8, 2), (503, [float("inf")] + [0.0] * 7, 2)]
    rows += [(None, [0.5] * 8, 3), (7, [0.25] * 8, 3), (7, [0.25] * 8, 3), (504, [0.125], None), (505, [], 4)]
    table = spark.createDataFrame([(*x, "c", "e") for x in rows], "vec_id long, embedding array<float>, label int, code string, x string").repartition(3)
    trained = vector_codes.train(table, parts, entries)
    got = vector_codes.with_label_error(vector_codes.encode(trained)).select("vec_id", "code", "error", "label_error").collect()
    want, books = brute_codes(rows, parts, entries, 2)
    assert trained.books.ravel().tolist() == books
    assert Counter(map(tuple, got)) == Counter(want)


def test_vector_codes_without_vectors(spark):
    table = spark.createDataFrame([(1, None, 1)], "vec_id long, embedding array<float>, label int")
    assert vector_codes.with_label_error(vector_codes.encode(vector_codes.train(table))).count() == 0


def test_huge_components_stay_within_bounds(spark):
    table = spark.createDataFrame([(1, [3e38] * 16, 1), (2, [-3e38] * 16, 1), (3, [0.0] * 16, 2)], "vec_id long, embedding array<float>, label int")
    out = vector_codes.encode(vector_codes.train(table)).collect()
    assert {r["code"] for r in out} == {"00" * 16, "01" * 16, "02" * 16} and {r["error"] for r in out} == {0}


def test_balls_own_points_and_hold_their_sums():
    """Far clusters: nearly all points are owned by balls, and the sums are those of all points."""
    r = np.random.default_rng(1)
    centers = r.integers(-5_000, 5_000, (8, 4))
    x = centers[r.integers(0, 8, 2_000)] + r.integers(-20, 21, (2_000, 4))
    trees = vector_codes.Trees.build(x, 1)
    books = centers[None]
    balls, *_, single = trees.owners(books)
    assert (trees.balls[balls, vector_codes.STOP] - trees.balls[balls, vector_codes.START]).sum() > 1_900 and len(single) < 100
    count, total = trees.totals(books)
    near = ((x[:, None] - centers[None]) ** 2).sum(2).argmin(1)
    assert count[0].tolist() == np.bincount(near, minlength=8).tolist()
    assert total[0].tolist() == [x[near == e].sum(0).tolist() for e in range(8)]


@pytest.mark.parametrize("name", ["op13_anchor_tree_codes"])
def test_queries_with_sql(spark, sf_dir, name):
    assert rows_of_spark(queries.queries()[name](spark, sf_dir)) == rows_of_sql(connect(sf_dir), queries.oracle_sql()[name])


# --- cases of earlier operators


def test_urls_of_any_length_and_repeated_rows(spark):
    long_url = "http://a.org/" + "x" * 200_000 + "/login/" + "y" * 200_000
    rows = [(1, long_url), (1, long_url), (2, None), (2, None), (3, "http://" + "sub." * 20_000 + "net/z?a=b#c"), (4, "")]
    pages = spark.createDataFrame([(*r, "h", "r", "v") for r in rows], "page_id long, url string, host string, rule string, gram string")
    got = url_filters.judge(pages, queries.HOST_RULES, queries.PATTERN_RULES).collect()
    told = Counter((r["page_id"], len(r["host"]), len(r["path"]), r["rule"], r["verdict"]) for r in got)
    assert told == {(1, 5, 400_008, None, "block"): 2, (2, 0, 0, None, "allow"): 2, (3, 80_003, 2, "net/", "block"): 1, (4, 0, 0, None, "allow"): 1}
    assert url_filters.judge(pages.limit(0), queries.HOST_RULES, queries.PATTERN_RULES).count() == 0


def test_archives_of_pages_with_clashing_columns(spark):
    html = ["<a>", "<a>", None, "WARC/1.1\r\n" * 3, "z" * 300_000]
    pages = spark.createDataFrame([(i, f"http://u/{i}", h, "k", "p", "o") for i, h in enumerate(html)], "page_id long, url string, html string, key string, path string, `offset` string")
    got = {r["page_id"]: (r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.round_trip(pages, html=False).collect()}
    assert got == {0: (3, "revisit", 1), 1: (3, "response", None), 2: (0, "response", None), 3: (30, "response", None), 4: (300_000, "response", None)}
