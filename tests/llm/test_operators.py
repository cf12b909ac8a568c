"""Each operator against a brute-force version, on rows with nulls, empty and long texts, ties and repeats."""

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from voxtable.llm import common, decontaminate, exact_dedup, minhash, mixing, queries, secrets, sharding, token_files, toxicity, url_filters, warc
from voxtable.llm.components import components

DOCUMENTS = "doc_id long, text string, source string, size string, key string"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def texts(seed=1, n=120):
    """Documents with exact and near copies, nulls, empty texts, a long one, repeated rows, and columns whose names clash."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(2, 6)))
    base = [[word() for _ in range(r.choice((3, 4, 30, 60)))] for _ in range(n // 4)]
    rows = []
    for i in range(n):
        words = list(r.choice(base))
        if i % 3 == 0 and len(words) > 4:
            words[r.randrange(len(words))] = "Edit"
        if i % 7 == 0:
            words = [w.upper() for w in words]
        rows.append((i, " ".join(words), r.choice(("a", "b", None)), "x", "y"))
    long_text = " ".join(word() for _ in range(20_000))
    rows += [(n, None, "a", None, None), (n + 1, "", "b", None, None), (n + 2, " \n", None, None, None), (n + 3, long_text, "a", None, None), (None, "lost one here", None, None, None)]
    return rows + [rows[5], rows[5]]


@pytest.fixture(scope="module")
def rows():
    return texts()


@pytest.fixture(scope="module")
def documents(spark, rows):
    return spark.createDataFrame(rows, DOCUMENTS).repartition(3).persist()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCUMENTS)


def test_sharding(documents, rows, nothing):
    out = sharding.shard(documents, 8).collect()
    assert len(out) == len(rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in out) == sorted((i is None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    by_shard = collections.defaultdict(list)
    for r in out:
        by_shard[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert sharding.shard(nothing, 8).count() == 0


def test_packing_balances_all_dimensions():
    r = np.random.RandomState(3)
    demands = r.gamma(1.0, size=(4000, 3))
    where = sharding.pack(demands, np.tile(demands.sum(axis=0) / 8, (8, 1)))
    loads = np.array([demands[where == s].sum(axis=0) for s in range(8)])
    assert (loads.max(axis=0) / loads.mean(axis=0) < 1.01).all()


def test_packing_takes_the_highest_dot_product():
    """Against a plain loop over the units in order of size."""
    r = np.random.RandomState(5)
    demands, room = r.gamma(1.0, size=(60, 3)), np.tile([9.0, 8.0, 7.0], (4, 1))
    left, want = room / room[0], {}
    for i in sorted(range(60), key=lambda i: -max(demands[i] / room[0])):
        need = demands[i] / room[0]
        want[i] = max(range(4), key=lambda s: (sum(left[s] * need * [8, 1, 1]), -s))
        left[want[i]] = left[want[i]] - need
    assert sharding.pack(demands, room).tolist() == [want[i] for i in range(60)]


@pytest.mark.parametrize(("part", "pieces"), [(0.11, 1), (0.3, 8)])
def test_groups_are_whole_where_they_fit(spark, part, pieces):
    """One id and text on a part of all rows: split over shards only if it exceeds one, and by row."""
    same = spark.range(20_000).select(F.when(F.col("id") < 20_000 * part, F.lit(None)).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") < 20_000 * part, F.lit("same text")).otherwise(F.concat(F.lit("other "), "id")).alias("text"))
    out = sharding.shard(same, 8)
    sizes = out.groupBy("shard").agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect()
    assert len(sizes) == 8 and max(r.s for r in sizes) < 1.05 * min(r.s for r in sizes) and max(r.n for r in sizes) < 1.15 * min(r.n for r in sizes)
    assert 1 <= out.where("doc_id is null").select("shard").distinct().count() <= pieces


def test_equal_texts_share_a_shard(spark, documents):
    out = sharding.shard(documents.select("doc_id", "text"), 3)
    assert out.groupBy("text_crc32").agg(F.countDistinct("shard").alias("n")).where("n > 1").count() <= 2  # those that fit nowhere


def brute_spans(text):
    found = []
    for kind, pattern, least in ((0, secrets.ASSIGN, 8), (1, re.compile("AKIA[A-Z0-9]+"), 16), (2, re.compile("[0-9a-f]+"), 32)):
        found += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if len(m[2] if kind == 0 else m[0]) >= least]
    return sorted(found)


def test_secrets(spark):
    hex40 = hashlib.sha1(b"x").hexdigest()
    given = ["é password = \"Tr0ub4dor&3x!\" and", f"TOKEN: {hex40} x", "AKIA" + "B" * 12, "AKIA" + "B" * 11, "secret=abc", "token=token=abcdefgh", "pwd: changeme", "pwd: xxxxxxxxxxxx", "passphrase => v9$Kq!zR2#mW8", None, "", "a" * 31, "word " * 20_000 + "apikey=" + "Z" * 9, "ſecret=12345678"]
    out = {r.doc_id: r for r in secrets.scan(spark.createDataFrame(list(enumerate(given)), "doc_id long, text string")).collect()}
    for i, t in enumerate(given):
        want = brute_spans(t or "")
        assert out[i].base_sha256 == hashlib.sha256(secrets.written(want).encode()).hexdigest()
        assert (out[i].n_assign, out[i].n_access, out[i].n_hex) == tuple(sum(k == x for _, k, _ in want) for x in range(3))
        assert set(secrets.written(want).split(",")) - {""} <= set(out[i].spans.split(","))
    assert [out[i].n_guess for i in (6, 7, 8)] == [0, 0, 1]


def test_guess_cost():
    cost = secrets.guess_cost
    assert cost("password") < 3 and cost("P4ssword") < 4.5 and cost("qwertyuiop") < 5 and cost("aaaaaaaaaaaaaaaa") < 5 and cost("1987-05-12") < 6
    assert cost("v9$Kq!zR2#mW8") > 15 and cost("passwordv9$Kq!zR2#") > cost("v9$Kq!zR2#") > cost("password123")
    for value in ("abc", "letmein1999", "zzqqjj", "Aq3$"):  # never dearer than brute force, and longer is never cheaper
        assert cost(value) <= len(value) * secrets.alphabet(value) + 1e-9


def every_cost(value, ranks, each, known):
    """The cheapest of all segmentations, tried one by one."""
    if value not in known:
        low, n = value.lower(), len(value)
        options = [n * each]
        options += [c for j, c in secrets.parts_from(value, low, 0, ranks, 20) if j == n]
        options += [every_cost(value[:p], ranks, each, known) + np.log10(n // p) for p in range(1, n // 2 + 1) if n % p == 0 and low == low[:p] * (n // p)]
        options += [every_cost(value[:k], ranks, each, known) + secrets.PART + every_cost(value[k:], ranks, each, known) for k in range(1, n)]
        known[value] = min(options)
    return known[value]


def test_guess_cost_is_the_minimum():
    r = random.Random(11)
    ranks = {"ab": 3, "pass": 1, "cat": 7}
    for _ in range(250):
        value = "".join(r.choice(("a", "b", "ab", "pass", "cat", "qwe", "1", "2", "19", "P", "@", "x", "x")) for _ in range(r.randint(1, 6)))[:9]
        assert secrets.guess_cost(value, ranks) == pytest.approx(every_cost(value, ranks, secrets.alphabet(value), {})), value
        assert (secrets.guess_cost(value, ranks, 4.0) >= 4.0) == (secrets.guess_cost(value, ranks) >= 4.0), value


def test_longer_repeats_do_not_look_safer():
    cost = secrets.guess_cost
    assert cost("abq" * 10) < cost("abq" * 4) + 1 and cost("k7m2p" * 2) < cost("k7m2p") + 0.5
    assert cost("passwordrtyui") < cost("password") + 4.5
    for value in ("ab" * 3000 + "X9$k", "x" * 4000, "Zq8$" + "7" * 3000, "".join(random.Random(1).choice("abcdefXYZ0189+/") for _ in range(50_000))):
        assert secrets.guess_cost(value, None, secrets.THRESHOLD) >= 0


def test_words_of_the_corpus_are_cheap(spark):
    rows = [(i, "correct horse battery staple and more", None, "k") for i in range(20)] + [(99, "password: correcthorsebattery", 1, "k"), (100, "password: xqzjvkwpqzjx", 1, "k"), (100, "password: xqzjvkwpqzjx", 1, "k"), (None, None, 1, "k")]
    out = [(r.doc_id, r.n_guess) for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, n_hex int, spans string")).collect() if r.doc_id is None or r.doc_id > 50]
    assert sorted(out, key=str) == [(100, 1), (100, 1), (99, 0), (None, 0)]


def test_base_spans_are_those_of_sql(spark, sf_dir):
    from tests.compare import connect

    sql = r"""SELECT doc_id,
      len(list_filter(regexp_extract_all(coalesce(text, ''), '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 8)) AS n_assign,
      len(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]{12,}')) AS n_access, len(regexp_extract_all(coalesce(text, ''), '[0-9a-f]{32,}')) AS n_hex FROM documents"""
    want = sorted(connect(sf_dir).execute(sql).fetchall())
    assert want
    assert sorted((r.doc_id, r.n_assign, r.n_access, r.n_hex) for r in queries.op2_guess_cost_secrets(spark, sf_dir).collect()) == want


PAGES = "page_id long, url string, html string"


def test_warc(spark, monkeypatch):
    r = random.Random(4)
    inner = warc.encode_record(7, "http://x/", b"inner", None, False).decode()
    bodies = ["<p>one</p>", None, "", "é" * 3000, inner * 3, "WARC/1.0\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n", "WARC/1.0\r\n", *("".join(r.choice("abc\r\n") for _ in range(r.randint(0, 400))) for _ in range(40))]
    given = [(i, f"http://h/{i} é", r.choice(bodies)) for i in range(300)] + [(300, None, "<p>one</p>"), (None, "u", "alone"), (None, "u", "<p>one</p>"), (300, "tie", "<p>one</p>"), (301, "m", "WARC/1.0\r\n" * 500)]
    monkeypatch.setattr(warc, "ROLL_BYTES", 20_000)
    monkeypatch.setattr(warc, "RANGE_BYTES", 700)
    out = warc.round_trip(spark.createDataFrame(given, PAGES).repartition(3)).collect()
    top = {}
    for i, _, h in given:
        top[h or ""] = max(top.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h in given:
        data, best = (h or "").encode(), top[h or ""]
        response = best < 0 or i == best
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if response else "revisit", None if response else best))
    key = lambda x: tuple((v is None, v or 0) if not isinstance(v, str) else (False, v) for v in x)
    assert sorted([(x.page_id, x.payload_bytes, x.payload_digest, x.record_type, x.refers_to) for x in out], key=key) == sorted(want, key=key)
    assert all(x.html == dict((i, h or "") for i, _, h in given)[x.page_id] for x in out if x.record_type == "response" and x.page_id is not None)
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


@pytest.mark.parametrize("length", ["9" * 20, "9" * 5000, "0" * 30 + "7" * 15, "123456"])
def test_warc_rejects_lengths_beyond_the_file(spark, length):
    html = f"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: {length}\r\n\r\nx"
    out = {r.page_id: r.html for r in warc.round_trip(spark.createDataFrame([(1, "u", html), (2, "u", "y")], PAGES)).collect()}
    assert out == {1: html, 2: "y"}
    folder = warc.new_path(spark, "warc-test")
    assert warc.candidates(warc.write_archives(spark.createDataFrame([(1, "u", html)], PAGES), folder), folder).count() == 1


def test_warc_rejects_magic_in_payloads(spark):
    inner = warc.encode_record(7, "http://x/", b"inner", None, False).decode()
    folder = warc.new_path(spark, "warc-test")
    files = warc.write_archives(spark.createDataFrame([(1, "u", inner), (2, "u", "x")], PAGES), folder)
    links = warc.stage(warc.candidates(files, folder), "links")
    assert links.count() == 3 and warc.chained(links, files).count() == 2


def brute_contamination(text, items):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    hit, ids = set(), set()
    for name, item in items:
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(item))
        size = min(13, len(own))
        for s in range(len(own) - size + 1) if own else ():
            for p in range(len(words) - size + 1):
                if words[p : p + size] == own[s : s + size]:
                    hit |= set(range(p, p + size))
                    ids.add(name)
    return len(words), len(hit), sorted(ids)


@pytest.mark.parametrize("slots", [common.SLOTS, 1 << 3])
def test_decontamination(spark, monkeypatch, slots):
    """A bit map that is full lets everything through and changes no result."""
    monkeypatch.setattr(common, "SLOTS", max(slots, 1 << 15))
    r = random.Random(5)
    items = [(i, " ".join(r.choice("ab cd é the of".split()) + str(r.randint(0, 3)) for _ in range(r.choice((0, 1, 5, 13, 20, 40))))) for i in range(12)] + [(10, "the same the same the same the same the same the same the same"), (50, None), (None, "no id at all")]
    docs = []
    for i in range(60):
        parts = [" ".join(r.choice("ab cd é the of same".split()) + str(r.randint(0, 3)) for _ in range(r.randint(0, 30))) for _ in range(2)]
        chosen = (r.choice(items)[1] or "").split()
        a = r.randint(0, len(chosen))
        docs.append((i, parts[0] + "; " + "-".join(chosen[a - 14 if a > 14 else 0 : a + 14]).upper() + "\n" + parts[1]))
    docs += [(100, None), (101, ""), (102, "the same " * 3000), (103, "no id at all"), (103, "no id at all")]
    docs.append((None, items[3][1]))
    out = decontaminate.match(spark.createDataFrame([(i, t, 1, "k") for i, t in docs], "doc_id long, text string, n_words int, key string"), spark.createDataFrame(items, "item_id long, text string"))
    order = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    got = sorted(((x.row.doc_id, x.n_words, x.n_hit, list(x["items"])) for x in out.collect()), key=order)
    named = [("null" if i is None else str(i), t) for i, t in items]
    assert got == sorted(((i, *brute_contamination(t, named)) for i, t in docs), key=order)
    assert any(x[2] for x in got) and out.select("row.*").columns == ["doc_id", "text", "n_words", "key"]
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.match(out.limit(0).select("row.doc_id", "row.text"), none).count() == 0
    assert [x.n_hit for x in decontaminate.match(out.limit(1).select("row.doc_id", "row.text"), none).collect()] == [0]


def toxic_rows(n=600):
    r = random.Random(6)
    word = lambda: "w" + str(r.randint(0, 300))
    rows = []
    for i in range(n):
        words = [word() for _ in range(r.choice((5, 40, 200)))]
        if r.random() < 0.2:
            words[0] = r.choice(("muslim", "christian", "jewish"))
        toxic = int(r.random() < 0.3)
        if toxic:
            words[-1] = r.choice(("idiot", "scum", "Trash!!"))
            if r.random() < 0.6:
                words[0] = "muslim"  # the labels are biased against one group
        rows.append((i, " ".join(words), toxic))
    return rows


def test_toxicity(spark):
    rows = toxic_rows()
    documents = spark.createDataFrame([(i, t, "z") for i, t, _ in rows] + [(9001, None, None), (9002, "", None), (9003, "the muslim w1 w2 w3", None)], "doc_id long, text string, label string")
    labels = spark.createDataFrame([(i, x) for i, _, x in rows] + [(9001, None)], "doc_id long, toxic int")
    model = toxicity.fit(toxicity.training_rows(documents, labels))
    out = {r.doc_id: r for r in model.score(documents, "text", "score").withColumn("held", toxicity.is_held_out()).collect()}
    held = [(out[i].score >= 0.5, x) for i, _, x in rows if out[i].held]
    assert len(held) > 60 and sum(bool(x) == y for y, x in held) / len(held) > 0.97
    assert all(r.held == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in out.items())
    assert out[9001].score == out[9002].score and out[9003].score < 0.5
    swapped = model.score(spark.createDataFrame([("muslim w1",), ("jewish w1",)], "text string"), "text", "s").collect()
    plain = toxicity.fit(toxicity.training_rows(documents, labels), kinds=())
    biased = plain.score(spark.createDataFrame([("muslim w1",), ("jewish w1",)], "text string"), "text", "s").collect()
    neutral = documents.where(F.col("doc_id") % 3 == 0).join(labels.where("toxic = 0"), "doc_id").select("text").limit(60)
    assert toxicity.mention_rate(model, neutral) <= toxicity.mention_rate(plain, neutral)
    change = lambda x: abs(np.log(x[0].s / (1 - x[0].s)) - np.log(x[1].s / (1 - x[1].s)))
    assert change(swapped) < 0.5 * change(biased)


def test_toxicity_of_odd_rows(spark, monkeypatch):
    """Very long, repeated and empty texts, names that clash, and a sample that stays bounded where ids repeat."""
    monkeypatch.setattr(toxicity, "SAMPLE_ROWS", 100)
    texts = [(1, f"fine words w{i} here") for i in range(400)] + [(2, f"idiot scum w{i}") for i in range(50)] + [(4, "long " * 50_000), (4, "long " * 50_000), (None, "lost"), (7, "")]
    documents = spark.createDataFrame([(*r, 1, 2.0, 3) for r in texts], "doc_id long, text string, row int, score double, vector int")
    train = toxicity.training_rows(documents, spark.createDataFrame([(1, 0), (1, 0), (2, 1), (2, None), (None, 1)], "doc_id long, toxic int"))
    assert 0 < train.count() < 250 and train.agg(F.max("weight")).first()[0] == 2.0
    out = toxicity.fit(train).score(documents, "text", "score")
    assert sorted(out.columns) == sorted(documents.columns) and out.count() == len(texts)
    assert out.where("score is null or score < 0 or score > 1").count() == 0


def test_fit_is_a_logistic_regression(spark):
    """Without names, against a plain proximal-gradient fit of the same loss."""
    rows = [("a b", 0.0), ("a c", 0.0), ("b c", 1.0), ("c", 1.0), ("a", 0.0), ("b", 1.0), ("a b c", 1.0)] * 5
    model = toxicity.fit(spark.createDataFrame([(*r, 1.0) for r in rows], "text string, label double, weight double"), kinds=())
    x = np.array([[w in t.split() for w in "abc"] for t, _ in rows], float)
    y, w, b = np.array([v for _, v in rows]), np.zeros(3), 0.0
    for _ in range(200_000):
        p = 1 / (1 + np.exp(-(x @ w + b))) - y
        w, b = w - 0.5 * x.T @ p / len(y), b - 0.5 * p.mean()
        w = np.sign(w) * np.maximum(np.abs(w) - 0.5 * toxicity.PENALTY, 0)
    told = [r.s for r in model.score(spark.createDataFrame([(t,) for t, _ in rows[:7]], "text string"), "text", "s").collect()]
    assert np.abs(np.array(told) - 1 / (1 + np.exp(-(x @ w + b)[:7]))).max() < 0.05


def test_toxicity_without_labels(spark, nothing):
    none = toxicity.fit(toxicity.training_rows(nothing, spark.createDataFrame([], "doc_id long, toxic int")))
    assert none.score(nothing, "text", "s").count() == 0


def test_token_files(spark, documents, rows, nothing):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path := public_tokenizers.path("byte_bpe_50k.json"))
    out = token_files.round_trip(documents, path).collect()
    want = sorted(((i is not None, i or 0), library.encode(t or "", add_special_tokens=False).ids + [0]) for i, t, *_ in rows)
    got = sorted(out, key=lambda x: x.start)
    assert [x.doc_id for x in got] == [i if known else None for (known, i), _ in want]
    start = 0
    for x, (_, ids) in zip(got, want, strict=True):
        assert (x.start, x.n_tokens, x.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_files.round_trip(nothing, path).count() == 0


def test_encoder_is_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path := public_tokenizers.path("byte_bpe_50k.json"))
    encoder = token_files.Encoder(path)
    r = random.Random(7)
    odd = [" ", "  ", "\n", "\n\n", "\t", " ", " ", ".", ",", "'s", "don't", "word", "Wörter", "123", "x1,", "!?,", "́", "é.", "<|endoftext|>", "\0", "日本", "٣", "²", "🙂", "'", "\x1c", "\x85", "_", "_,", "end.", "\1", "\x0b", "\u200b"]
    given = ["".join(r.choice(odd) for _ in range(r.randint(0, 25))) for _ in range(3000)] + ["plain words, one by one.\nNext line, end."]
    for at in range(0, len(given), 100):
        part = given[at : at + 100]
        ids, stops = encoder.encode(pa.array(part))
        assert [x.tolist() for x in np.split(ids, stops[:-1])] == [[*e.ids, 0] for e in library.encode_batch(part, add_special_tokens=False)]


def test_other_tokenizers_see_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path := public_tokenizers.path("word_bpe_49k.json"))
    given = ["Two  words", "", " a\nb ", "\1"]
    ids, stops = token_files.Encoder(path).encode(pa.array(given))
    assert [x.tolist() for x in np.split(ids, stops[:-1])] == [[*library.encode(t, add_special_tokens=False).ids, 0] for t in given]


def test_token_files_write_every_id(spark):
    import public_tokenizers

    rows = [(-(1 << 63), "a"), (None, "b c"), (0, None), (None, "b c"), ((1 << 63) - 1, "d")]
    out = token_files.round_trip(spark.createDataFrame(rows, "doc_id long, text string"), public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert [x.doc_id for x in sorted(out, key=lambda x: x.start)] == [None, None, -(1 << 63), 0, (1 << 63) - 1]


def test_mixing_of_rows_that_share_an_id(spark):
    """Ids that repeat or are missing do not keep a source from its target."""
    rows = [(None, f"w{i} " * (1 + i % 7), "a", "k", 1) for i in range(400)] + [(7, "same words here", "b", "k", 1)] * 300 + [(i, "one two three four", None, "k", 1) for i in range(200)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, source string, key string, by_id int")
    taken = collections.Counter(r.source for r in mixing.mixed_rows(documents, (3, 1, 2), 0.9, 2.0).collect() for _ in r.text.split())
    _, plan = mixing.mix(documents, (3, 1, 2), 0.9, 2.0)
    for r in plan.collect():
        assert abs(taken[None if r.key == "1" else r.key[1:]] - r.target) <= 7
    assert mixing.mixed_rows(documents, (3, 1, 2), 0.9, 2.0).columns == documents.columns


@pytest.mark.parametrize("n", [3, 40])
def test_targets_are_dealt_again(spark, n):
    r = random.Random(n)
    sizes = {f"0{i:03d}": r.choice((0, 5, 50, 5000)) for i in range(n)}
    sums = spark.createDataFrame([(k, v, 1) for k, v in sizes.items()], "key string, source_size long, n long").repartition(3)
    weight = {k: (3, 1, 2)[i % 3] for i, k in enumerate(sorted(sizes))}
    target, open_, rest = {}, set(sizes), 1.5 * sum(sizes.values())
    while over := {s for s in open_ if rest * weight[s] / sum(weight[x] for x in open_) > 2 * sizes[s]}:
        target |= {s: 2.0 * sizes[s] for s in over}
        rest -= sum(target[s] for s in over)
        open_ -= over
    target |= {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
    assert {x.key: x.target for x in mixing.targets(sums, (3, 1, 2), 1.5, 2.0).collect()} == pytest.approx(target)


def test_mixing(spark, documents, rows, nothing):
    sized, plan = mixing.mix(documents, (3, 1, 2), 1.5, 2.0)
    out = mixing.attach(sized, plan, "key", "n").withColumn("taken", F.col("size") * mixing.copies()).collect()
    sizes = collections.Counter()
    for _, t, s, *_ in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = dict(zip(order, (3, 1, 2), strict=False))
    target, open_, rest = {}, set(order), 1.5 * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if rest * weight[s] / total > 2 * sizes[s]}
        if not over:
            target |= {s: rest * weight[s] / total for s in open_}
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        rest -= sum(target[s] for s in over)
        open_ -= over
    assert len(out) == len(rows)
    for s in order:
        key = "1" if s is None else "0" + s
        own = [x for x in out if x.key == key]
        assert own[0].target == pytest.approx(target[s]) and own[0].source_size == sizes[s]
        assert all(x.taken <= 2 * x.size for x in own)
        assert abs(sum(x.taken for x in own) - target[s]) <= max(x.size for x in own)
    assert mixing.mixed_rows(documents, (3, 1, 2), 1.5, 2.0).columns == documents.columns
    assert mixing.mixed_rows(nothing, (3, 1, 2), 1.5, 2.0).count() == 0


@pytest.mark.parametrize("split", [0, 60, 10_000])
def test_exact_dedup(documents, rows, split):
    old = F.coalesce(F.col("doc_id") < split, F.lit(False))
    out = exact_dedup.exact_dedup(documents.where(old), documents.where(~old)).collect()
    groups = collections.defaultdict(list)
    for i, t, *_ in rows:
        groups[hashlib.sha256(lower(t).encode()).hexdigest()].append(i)
    assert len(out) == len(rows)
    kept = collections.Counter()
    for x in out:
        own = groups[x.text_sha256]
        assert x.doc_id in own and x.group_size == len(own) and x.keep_id == max((i for i in own if i is not None), default=None)
        kept[x.text_sha256] += x.kept
        assert not x.kept or x.doc_id == x.keep_id
    assert set(kept.values()) == {1}


def test_exact_dedup_of_nothing(nothing):
    assert exact_dedup.exact_dedup(nothing, nothing).count() == 0


@pytest.mark.parametrize("n", [1, 2, 10, 1000, 60_000])
def test_fuse_filter(n):
    r = np.random.RandomState(n)
    keys = np.unique(r.randint(0, 1 << 63, n, dtype=np.uint64))
    f = exact_dedup.FuseFilter.build(keys)
    assert f.has(keys).all()
    assert f.has(r.randint(0, 1 << 63, 50_000, dtype=np.uint64)).mean() < 0.008
    assert n <= 1000 or len(f.cells) < 1.25 * n


def test_url_filters(spark):
    hosts = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("b.c", "/x", "block"), ("c", "/x/y", "allow"))
    patterns = ((r"cheap-?pills", "block"), (r"^https://(www\.)?good\.", "allow"), (r"\d{5}", "block"), (r"(casino|poker)", "block"))
    urls = [None, "", "no scheme", "http://Example.NET/en/1", "http://example.net/EN/1", "http://net", "http://xnet/", "ftp://a.b.c/x/y?q#f", "http://b.c/x/yz", "http://u/CHEAP-pills", "https://www.good.org/12345", "http://u/12345", "http://u/CASINO?x=://net/", "http://h?x/net/", "://net/", "http://a.net/\n", "http://poke/r"]
    out = {x.page_id: x for x in url_filters.judge(spark.createDataFrame([(i, u, "k") for i, u in enumerate(urls)], "page_id long, url string, host string"), hosts, patterns).collect()}
    for i, u in enumerate(urls):
        _, found, rest = (u or "").partition("://")
        m = re.match(r"([^/?#]*)([^?#]*)", rest if found else "")
        host, path = lower(m[1]), m[2]
        fits = [r for r in hosts if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
        verdict = best[2] if best else next((a for p, a in patterns if re.search(p, u or "", re.I | re.A)), "allow")
        assert (out[i].host, out[i].path, out[i].rule, out[i].verdict) == (host, path, best and best[0] + best[1], verdict), u


def test_empty_tables(spark, nothing):
    assert secrets.scan(nothing).count() == 0
    pages = spark.createDataFrame([], PAGES)
    assert url_filters.judge(pages, (), (("abcd", "block"),)).count() == 0
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_rules_with_alternatives_are_indexed():
    by_gram, always = url_filters.index(queries.PATTERN_RULES, collections.Counter())
    assert always == [] and {0: 2, 3: 3}.items() <= collections.Counter(i for rules in by_gram.values() for i in rules).items()
    assert {".gov", ".edu"} <= set(by_gram)
    assert url_filters.index(((r"(casino|x)", "block"), (r"a?b", "block"), (r"(aaaa|bbbb)?", "block")), collections.Counter())[1] == [0, 1, 2]
    for pattern, urls in ((r"x(ab|cd)(ef|gh)", ("XABGH", "xcdef")), (r"(/login|$)", ("",)), (r"(?:one|two)\b/(a|b|cde)z", ("one/az", "TWO/CDEZ"))):
        by_gram, always = url_filters.index(((pattern, "block"),), collections.Counter())
        for url in urls:
            assert re.search(pattern, url, re.I | re.A) and (always or url_filters.grams(url.lower()) & by_gram.keys())


def test_literals():
    assert url_filters.literals(r"cheap-?pills") == {"chea", "heap", "pill", "ills"}
    assert url_filters.literals(r"(casino|poker)") == set()
    assert url_filters.literals(r"(?:login)+x?") == set()


def brute_components(rows):
    sets = []
    for _, t, *_ in rows:
        w = lower(t).encode().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                parent[find(i)] = find(j)
    least = collections.defaultdict(list)
    for i, (d, *_) in enumerate(rows):
        least[find(i)].append(d)
    return [(d, len(sets[i]), min((x for x in least[find(i)] if x is not None), default=None)) for i, (d, *_) in enumerate(rows)]


@pytest.mark.parametrize("block", [512, 3])
def test_minhash(documents, rows, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    out = [(x.doc_id, x.n_shingles, x.component_id) for x in minhash.near_duplicates(documents).collect()]
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(out, key=key) == sorted(brute_components(rows), key=key)


def test_minhash_of_nothing(nothing):
    assert minhash.near_duplicates(nothing).count() == 0


def test_attach_splits_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT", 4)
    keys = ["hot"] * 60 + [f"k{i % 30}" for i in range(90)] + ["unknown"]
    rows = spark.createDataFrame(list(enumerate(keys)), "i long, key string")
    names = sorted(set(keys) - {"unknown"})
    table = spark.createDataFrame([(k, keys.count(k), k.upper(), len(k)) for k in names], "key string, n long, name string, size long")
    out = common.attach(rows, table, "key", "n")
    assert out.columns == ["key", "i", "name", "size"]
    assert sorted((r.i, r.key, r.name) for r in out.collect()) == [(i, k, None if k == "unknown" else k.upper()) for i, k in enumerate(keys)]


@pytest.mark.parametrize("hot", [1000, 4])
def test_components(spark, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT", hot)
    r = random.Random(9)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)]
    got = {x.node: x.label for x in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = sorted((find(u), find(v)))
        parent[b] = a
    assert got == {x: find(x) for x in parent if find(x) != x}
