"""The guess cost of long values: the same rule at every length, and in bounded time."""

import math
import random
import time

import pytest

from voxtable.llm import secrets

RANKS = {"ab": 3, "pass": 1, "cat": 7, "qwe1": 5}
PIECES = ("a", "b", "ab", "pass", "cat", "qwe", "1", "2", "19", "P", "@", "x", "1987", "S")


def plain_cost(value, each, known):
    """The cheapest segmentation by trying every start, unit and count."""
    if value in known:
        return known[value]
    n, low = len(value), value.lower()
    best, brute = [0.0] + [math.inf] * n, math.inf
    for i in range(n):
        here = best[i] + secrets.PART
        for j, c in secrets.parts_from(value, low, i, RANKS, 4):
            best[j] = min(best[j], here + c)
        for p in range(1, (n - i) // 2 + 1):
            unit, k = low[i : i + p], 1
            while low.startswith(unit, i + k * p):
                k += 1
            if k > 1 and not (p > secrets.LONG_UNIT and any(p % q == 0 and unit == unit[:q] * (p // q) for q in range(1, p))):
                c = plain_cost(value[i : i + p], each, known)
                for m in range(2, k + 1):
                    best[i + m * p] = min(best[i + m * p], here + c + math.log10(m))
        brute = min(brute, here) + each
        best[i + 1] = min(best[i + 1], brute)
    known[value] = max(best[n] - secrets.PART, 0.0)
    return known[value]


@pytest.mark.parametrize("length", [40, 127, 128, 129, 130, 170])
def test_the_minimum_at_any_length(length):
    r = random.Random(length)
    for _ in range(60):
        value = ""
        while len(value) < length:
            value += "".join(r.choice(PIECES) * r.choice((1, 1, 2, 3, r.randint(1, 50))) for _ in range(r.randint(1, 5))) * r.randint(1, 4)
        value = value[:length]
        want = plain_cost(value, secrets.alphabet(value), {})
        assert secrets.guess_cost(value, RANKS) == pytest.approx(want), value
        for most in (4.0, 7.0, secrets.THRESHOLD):
            if abs(want - most) > 1e-6:
                assert (secrets.guess_cost(value, RANKS, most) >= most) == (want >= most), value


@pytest.mark.parametrize("times", [50, 124, 125, 130, 5000])
def test_parts_begin_inside_runs(times):
    each = secrets.alphabet("s")
    assert secrets.guess_cost("pass" + "s" * times, RANKS) == pytest.approx(math.log10(2) + secrets.PART + each + math.log10(times))
    walk = ("qwertyuiop" + "oiuytrew") * (times // 10)  # along the row and back, and the word before it ends on the row
    assert secrets.guess_cost("xq" + walk[1:], {"xqw": 1}) <= math.log10(2) + secrets.PART + math.log10(secrets.WALKS * (len(walk) - 2)) + 1e-9


def test_a_long_value_in_the_query(spark):
    """A word and a repeat that begins inside the run of its last letter: no secret at any length."""
    rows = [(k, "password: superman" + "n" * k) for k in (60, 118, 125, 4000)] + [(1, "password: v9$Kq!zR2#" + "n" * 4000)]
    got = {r.doc_id: r.n_guess for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {60: 0, 118: 0, 125: 0, 4000: 0, 1: 1}


def test_long_values_in_bounded_time():
    r = random.Random(5)
    values = ["x" * 20_000 + "Zq8$", "".join(r.choice("abcdefXYZ0189+/") for _ in range(300_000)), ("a" * 200 + "b" * 200) * 3 + "Q#", "qwerty" * 3000 + "zQ#9", "-=-=--=-" * 3000 + "#"]
    began = time.process_time()
    for value in values:
        secrets.guess_cost(value, None, secrets.THRESHOLD)
    assert time.process_time() - began < 60
