"""Token files: the library gets new pieces many at a time, and what is remembered turns over without changing an id. Toxicity: the fit leaves out words that have no weight. Packing: new words of all kinds go to the library in lists."""

import random
import sys
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from voxtable.llm import lexical_packing as packing
from voxtable.llm import queries, token_files, toxicity


class Counted:
    """The library, and how many texts and words it was asked for."""

    def __init__(self, library):
        self.library, self.asked = library, 0

    def __getattr__(self, name):
        found = getattr(self.library, name)
        if name not in ("encode", "encode_batch_fast"):
            self.asked += name == "model"
            return found

        def call(given, **named):
            self.asked += 1 if isinstance(given, str) else len(given)
            return found(given, **named)

        return call


def test_new_pieces_go_to_the_library_together():
    encoder = token_files.Encoder(public_tokenizers.path(queries.TOKENIZER))
    encoder.library = counted = Counted(encoder.library)
    encoder.encode(pa.array([" ".join(f"w{'abcdefghij'[i % 10]}x{i}y" for i in range(20_000))]))
    assert counted.asked < 10


@pytest.mark.parametrize(("most", "joined"), [(0, 3), (3000, 7), (1 << 20, 1 << 14)])
def test_ids_whatever_is_remembered(monkeypatch, most, joined):
    monkeypatch.setattr(token_files, "CACHE_BYTES", most)
    monkeypatch.setattr(token_files, "JOINED", joined)
    library = Tokenizer.from_file(path := public_tokenizers.path(queries.TOKENIZER))
    encoder, r = token_files.Encoder(path), random.Random(4)
    signs = "abé日٣²🙂'’.,-_́ \n\t\xa0 ‍\1\0"
    for _ in range(60):
        part = ["".join(r.choice(signs) if r.random() < 0.3 else r.choice("aeint ") for _ in range(r.randrange(60))) for _ in range(40)]
        ids, stops = encoder.encode(pa.array(part))
        assert [x.tolist() for x in np.split(ids, stops[:-1])] == [[*e.ids, 0] for e in library.encode_batch(part, add_special_tokens=False)]


def test_fit_without_words_that_have_no_weight(spark, monkeypatch):
    """Few of the words are in the fit, and its scores are those of a fit with all of them."""
    r, rows = random.Random(5), []
    spelt = lambda n: "".join("abcdefghij"[int(x)] for x in str(n))
    for _ in range(600):
        words = [f"common{spelt(r.randrange(40))}" for _ in range(8)] + [f"rare{spelt(r.randrange(900))}" for _ in range(8)]
        toxic = r.random() < 0.3
        words += [r.choice(("idiot", "scum", "trash"))] * (toxic or r.random() < 0.05)
        rows.append((" ".join(words), float(toxic), 1.0))
    train = spark.createDataFrame(rows, "text string, label double, weight double")
    monkeypatch.setattr(toxicity, "PENALTY", 2e-3)
    few = toxicity.fit(train)
    monkeypatch.setattr(toxicity, "NEAR", 0.0)
    every = toxicity.fit(train)
    assert len(every.vocabulary.vocabulary) > 800 > 3 * len(few.vocabulary.vocabulary)
    told = [[x.s for x in m.score(train, "text", "s").select("text", "s").orderBy("text").collect()] for m in (few, every)]
    assert np.abs(np.subtract(*told)).max() < 0.02
    assert few.weights()["idiot"] > 0


# --- packing


def test_no_python_runs_for_each_new_word():
    """Words that are one piece and those that are not, all new: what is done for each of them is done by map, Arrow and the library."""
    encoder, seen = packing.Encoder(public_tokenizers.path(queries.PACKED_TOKENIZER), 1), Counter()
    spelt = lambda n, signs: "".join(signs[int(x)] for x in str(n))
    texts = pa.array([" ".join(f"{spelt(n, 'abcdefghij')} {spelt(n, 'abcdéfghij')}é {n}-x" for n in range(10_000))])
    sys.setprofile(lambda frame, event, told: seen.update([event]))
    try:
        encoder.encode(texts)
    finally:
        sys.setprofile(None)
    assert len(encoder.known) > 25_000 and seen["call"] + seen["c_call"] < 2_000


@pytest.mark.parametrize(("most", "together"), [(0, 3), (3000, 7), (128 << 20, 1 << 14)])
def test_ids_of_packed_texts_whatever_is_remembered(monkeypatch, most, together):
    monkeypatch.setattr(packing, "CACHE_BYTES", most)
    monkeypatch.setattr(packing, "TOGETHER", together)
    library = Tokenizer.from_file(path := public_tokenizers.path(queries.PACKED_TOKENIZER))
    encoder, r = packing.Encoder(path, 1), random.Random(6)
    signs = "aZéÉÑßİıſΣςǅ日٣²12🙂'’.,-_<|>́ͅ \n\t\xa0​\x1c‍\1\0\x7f"
    for _ in range(60):
        part = ["".join(r.choice(signs) if r.random() < 0.3 else r.choice("aEintéÖ ") for _ in range(r.randrange(60))) for _ in range(40)]
        part += ["it's We'LL <|endoftext|>", "</w> w</w>", "\1", " \1 \1", ""]
        want = [np.array([*e.ids, 1], "<u2").tobytes() for e in library.encode_batch(part, add_special_tokens=False)]
        assert encoder.encode(pa.array(part)).to_pylist() == want


def test_words_whose_ends_no_token_shows():
    """Without tokens known as last ones, the same words go through the library each by itself."""
    encoder = packing.Encoder(public_tokenizers.path(queries.PACKED_TOKENIZER), 1)
    part = pa.array(["some words and Ünlike ones", "", "more, of them"])
    want = encoder.encode(part)
    encoder.forget()
    encoder.last[:] = False
    assert encoder.encode(part).equals(want)


@pytest.mark.parametrize(("dtype", "many"), [("<u2", 50), ("<u4", 50), ("<u2", 70_000)])
def test_terms_are_counted_in_keys_of_any_width(dtype, many):
    r = np.random.default_rng(8)
    sizes = r.integers(1, 9, many)
    ids = r.integers(0, 1 << 16, sizes.sum()).astype(dtype)
    ids[::3] = 65_535
    doc, term, n = packing.terms(ids, sizes)
    want = Counter(zip(np.repeat(np.arange(many), sizes).tolist(), ids.tolist(), strict=True))
    assert list(zip(doc.tolist(), term.tolist(), strict=True)) == sorted(want) and n.tolist() == [want[k] for k in sorted(want)]
    assert [len(x) for x in packing.terms(ids[:0], sizes[:0])] == [0, 0, 0]
