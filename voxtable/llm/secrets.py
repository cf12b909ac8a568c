"""Secret scans: fixed patterns, and the guess cost of values in a credential context.

A value that follows a credential word is scored by the cheapest way to compose it from dictionary words, dates,
repeats, keyboard walks and brute-force spans, found by dynamic programming over its positions in log10 of guesses.
A repeat is a unit any number of times and costs what its unit costs and its count; a unit of over LONG_UNIT characters is
no repeat itself. Values that cost enough are reported;
placeholders such as "changeme" or "xxxxxxxx" are not.

The dictionary is a fixed list of common passwords, and behind it the words that most documents of the corpus have, in that
order, counted over all documents without the values in credential contexts.

Spans are kind:start:end in code points with the end exclusive. A null or empty text has none. Rows are independent,
so repeated rows give repeated results, and other columns play no part. Whole texts of any length are scanned, and values of any length are
judged by the same rule: repeats and walks may begin anywhere.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtable.llm.common import by_value, stage, texts, trimmed

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Words that announce a credential, and what may stand between word and value.
CONTEXT = re.compile(r"""(?ai)(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|(?:api|access|private|secret|auth)[_-]?key|auth(?:orization)?|bearer|credentials?)["']?(?:\x20*(?:=>|[:=])\x20*|\x20+is\x20+(?=\S*\d))["']?(?:bearer\x20+)?([^\s"'<>,;]{6,})""")
#: One of these is in every text that ASSIGN or CONTEXT matches.
HINTS = ("pass", "pwd", "secret", "token", "key", "auth", "bearer", "credential")
#: Values that need at least 10 to this power of guesses are secrets.
THRESHOLD = 10.0
#: log10 of what each further part multiplies the guesses by.
PART = 1.0
#: A longer unit of a repeat is no repeat itself.
LONG_UNIT = 24
#: The shortest walk, and how many begin somewhere and go somewhere, for each character.
LEAST_WALK, WALKS = 3, 400
#: Words of the corpus in the dictionary at most, and the documents that must have one: so many, and one in so many.
CORPUS_WORDS, LEAST_DOCUMENTS, ONE_IN = 50_000, 5, 20_000
#: Counts that a task holds before it gives them on.
MOST_COUNTS = 200_000
CORPUS_WORD = re.compile(r"[a-z]{3,20}")
#: Common passwords and placeholder words, the most frequent first.
WORDS = """password 123456 qwerty admin letmein welcome monkey dragon login master hello secret iloveyou princess football
baseball shadow sunshine superman michael access trustno1 batman hunter ranger buster soccer hockey killer george summer winter
spring autumn love money test guest root user demo example sample default change changeme please your here none null true false
token api key value string pass word private public user name my the is new old temp server client data base data admin
service account prod dev test staging local host home work office mail web site page file code open close start stop red blue
green black white orange purple silver gold star moon sun fire water earth king queen angel devil happy lucky magic power ninja
placeholder redacted removed hidden insert replace todo xxx abc""".split()
#: What letters digits and signs stand for.
LEET = {"@": "a", "4": "a", "3": "e", "1": "i", "!": "i", "0": "o", "$": "s", "5": "s", "7": "t"}
PLAIN = str.maketrans(LEET)
#: Rows of keys that are walked along, and orders that are counted along.
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz", "0123456789")
DATE = re.compile(r"(?:19|20)\d\d(?:[-/._]?[01]?\d[-/._]?[0-3]?\d)?|[0-3]?\d[-/._]?[01]?\d[-/._]?(?:(?:19|20)\d\d|\d\d)")


def neighbours() -> dict[str, set[str]]:
    """Keys next to each other: along a row, or one row below with the usual offset."""
    near: dict[str, set[str]] = {}
    for row in ROWS:
        for a, b in zip(row, row[1:], strict=False):
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for upper, lower in zip(ROWS[:3], ROWS[1:4], strict=False):
        for i, key in enumerate(lower):
            for other in upper[i : i + 2]:
                near[key].add(other)
                near[other].add(key)
    return near


NEAR = neighbours()


def alphabet(value: str) -> float:
    """log10 of the number of characters of the classes that occur."""
    sizes = ((str.islower, 26), (str.isupper, 26), (str.isdigit, 10))
    n = sum(size for test, size in sizes if any(map(test, value)))
    return math.log10(n + 33 * any(not c.isalnum() for c in value) or 10)


def words_from(value: str, low: str, plain: str, i: int, ranks: Mapping[str, int], longest: int) -> Iterator[tuple[int, float]]:
    """(end, cost) of the words that begin at i; plain is low with letters for what stands for them."""
    for j in range(i + 2, min(len(value), i + longest) + 1):
        word = low[i:j]
        if rank := ranks.get(word) or ranks.get(plain[i:j]):
            cased = 0 if value[i:j] == word else 1 if value[i:j] in (word.capitalize(), word.upper()) else j - i - 1
            leet = sum(a != b for a, b in zip(word, plain[i:j], strict=True)) if word not in ranks else 0
            yield j, math.log10(rank + 1) + (cased + leet) * math.log10(2)


def dates_from(value: str, i: int) -> Iterator[tuple[int, float]]:
    """(end, cost) of the dates that begin at i."""
    if value[i].isdigit():
        for j in range(i + 4, min(len(value), i + 10) + 1):
            if DATE.fullmatch(value, i, j):
                yield j, math.log10(366 * 120 if j - i > 4 else 120)


def walk_end(low: str, i: int) -> int:
    """Where the walk along keys that begins at i ends at last."""
    j = i + 1
    while j < len(low) and low[j] in NEAR.get(low[j - 1], ()):
        j += 1
    return j


def parts_from(value: str, low: str, i: int, ranks: Mapping[str, int], longest: int) -> Iterator[tuple[int, float]]:
    """(end, cost) of the words, dates and walks that begin at i."""
    yield from words_from(value, low, low.translate(PLAIN), i, ranks, longest)
    yield from dates_from(value, i)
    for j in range(i + LEAST_WALK, walk_end(low, i) + 1):
        yield j, math.log10(WALKS * (j - i))


def repeats_from(low: str, i: int, runs: dict[int, int]) -> Iterator[tuple[int, int, int]]:
    """(length of the unit, end of its period, length of the unit's own unit) of the repeats that begin at i.

    A unit of over LONG_UNIT characters is no repeat itself. runs has the ends by period of what was found before i. A period has to
    bring back as many characters as it is long, so each miss makes the search more selective; and behind a period that goes on
    to an end, the next one that is no multiple of it brings back nearly all up to there.
    """
    n, least = len(low), 1
    while i + 2 * least <= n:
        at = low.find(low[i : i + least], i + least)
        p = at - i
        if at < 0 or i + 2 * p > n:
            return
        end = runs.get(p, 0)
        if end < i + 2 * p:
            if not low.startswith(low[i:at], at):
                least = p + 1
                continue
            end = at + p
            while end < n and low[end] == low[end - p]:
                end += 1
            runs[p] = end
        yield p, end, p
        for q in range(2 * p, min(LONG_UNIT, (end - i) // 2) + 1, p):
            yield q, end, p
        least = end - i - p + 1


def guess_cost(value: str, ranks: Mapping[str, int] | None = None, most: float = math.inf) -> float:
    """log10 of the guesses of the cheapest segmentation; where that is not below most, most or more, and else perhaps not the cheapest.

    Walks and repeats may begin anywhere, in values of any length. One that begins within another's course is dropped if it can never be
    the cheaper one: the lead it has by being shorter is largest where it ends first.
    """
    ranks = RANKS if ranks is None else ranks
    longest = max(map(len, ranks), default=0)
    each = alphabet(value)
    known: dict[str, tuple[float, float]] = {}  # the cost of a unit, and what it was looked for below: it is exact if it is less

    def unit_cost(unit: str, below: float) -> float:
        cost, tried = known.get(unit, (0.0, 0.0))
        if cost >= tried and tried < below:
            cost, _ = known[unit] = cheapest(unit, below, False), below
        return cost

    def cheapest(value: str, most: float, enough: bool) -> float:
        n, low = len(value), value.lower()
        low = low if len(low) == n else value
        plain = low.translate(PLAIN)
        best = [0.0] + [math.inf] * n  # of each prefix, a PART for each of its parts
        brute = math.inf  # of this prefix when it ends in a brute-force span
        reach = stop = 0  # where words and dates end at last; where the present walk does
        walks: list[tuple[float, int]] = []  # (cost before, start) of walks that end at stop at last
        runs: dict[int, int] = {}
        repeats: dict[tuple[int, int, int], list[tuple[float, int]]] = {}  # by unit's length, start modulo that, and end: (cost without count, start)
        due: dict[int, list[tuple[int, int, int]]] = {}  # repeats that may end at a place
        for i in range(n + 1):
            here = min(best[i], brute)
            if i <= stop:
                costs = [a + PART + math.log10(WALKS * (i - s)) for a, s in walks if i - s >= LEAST_WALK]
                here = min(here, *costs, math.inf)
                if len(costs) == len(walks) and min(costs, default=0) >= most + PART:
                    walks.clear()
            for key in due.pop(i, ()):
                p, _, end = key
                costs = [a + math.log10((i - s) // p) for a, s in repeats[key] if i - s >= 2 * p]
                here = min(here, *costs)
                if i + p > end or len(costs) == len(repeats[key]) and min(costs) >= most + PART:
                    del repeats[key]
                else:
                    due.setdefault(i + p, []).append(key)
            best[i] = here
            if i == n or enough and best[n] - PART < most:
                break
            if i >= stop:
                walks.clear()
            if here < most:
                for told in (words_from(value, low, plain, i, ranks, longest), dates_from(value, i)):
                    for j, cost in told:
                        if here + PART + cost < min(best[j], most + PART):
                            best[j], reach = here + PART + cost, max(reach, j)
                if i >= stop:
                    stop = walk_end(low, i)
                if stop - i >= LEAST_WALK and all(here + math.log10(LEAST_WALK) < a + math.log10(i + LEAST_WALK - s) for a, s in walks):
                    walks.append((here, i))
                    if stop == n:
                        best[n] = min(best[n], here + PART + math.log10(WALKS * (n - i)))
                for p, end, root in repeats_from(low, i, runs):
                    key = p, i % p, end
                    others = repeats.get(key, ())
                    below = min([most - here] + [a + math.log10((i - s) // p + 2) - here - PART for a, s in others]) - math.log10(2)
                    if below <= 0 or (cost := unit_cost(value[i : i + p], below)) >= below:
                        continue
                    if root < p and unit_cost(value[i : i + root], cost) + math.log10(p // root) <= cost + 1e-9:
                        continue
                    if not others:
                        due.setdefault(i + 2 * p, []).append(key)
                    repeats.setdefault(key, []).append((here + PART + cost, i))
                    if end == n and (n - i) % p == 0:
                        best[n] = min(best[n], here + PART + cost + math.log10((n - i) // p))
            elif brute >= most + PART and i >= reach and not walks and not due:
                return most
            brute = min(brute, here + PART) + each
        return max(best[n] - PART, 0.0) if n else 0.0

    return cheapest(value, most, most < math.inf)


RANKS = {w: i for i, w in reversed(list(enumerate(WORDS, 1)))}


def spans(text: str, ranks: Mapping[str, int] | None = None) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) in order. The base kinds keep leftmost matches that do not overlap within a kind."""
    found = [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    low = text.lower()
    if any(h in low for h in HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
        found += [(m.start(1), 3, m.end(1)) for m in CONTEXT.finditer(text) if guess_cost(m[1], ranks, THRESHOLD) >= THRESHOLD]
    return sorted(found)


def corpus_words(documents: DataFrame) -> list[str]:
    """The words that most documents have, those that the most have first, values in credential contexts left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        out = lambda: pa.RecordBatch.from_pydict({"word": pa.array(list(total), pa.string()), "n": pa.array(list(total.values()), pa.int64())})
        for b in batches:
            for text in texts(b):
                low = text.decode().lower()
                if any(h in low for h in HINTS):
                    low = CONTEXT.sub(" ", low)
                total.update({"", *CORPUS_WORD.findall(low)})  # the empty word counts the documents
                if len(total) > MOST_COUNTS:
                    yield out()
                    total.clear()
        yield out()

    counts = documents.select("text").mapInArrow(trimmed(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_DOCUMENTS)
    counts = stage(counts, "secret-words")
    n = (counts.where("word = ''").first() or {"n": 0})["n"]
    frequent = counts.where((F.col("word") != "") & (F.col("n") * ONE_IN >= n)).orderBy(F.desc("n"), "word").limit(CORPUS_WORDS)
    return [r["word"] for r in frequent.collect()]


def written(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def scan(documents: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_guess, base_sha256 and spans for each row of documents (doc_id, text)."""
    ranks = {w: i for i, w in reversed(list(enumerate((*WORDS, *corpus_words(documents)), 1)))}
    sent = documents.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each = [spans(t.decode(), sent.value) for t in texts(b)]
            counts = [pa.array([sum(k == kind for _, k, _ in s) for s in each], pa.int64()) for kind in range(4)]
            base = [hashlib.sha256(written([x for x in s if x[1] < 3]).encode()).hexdigest() for s in each]
            told = [b["doc_id"], *counts, pa.array(base, pa.string()), pa.array(map(written, each), pa.string())]
            yield pa.RecordBatch.from_arrays(told, ["doc_id", "n_assign", "n_access", "n_hex", "n_guess", "base_sha256", "spans"])

    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string"
    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(trimmed(run), schema)


by_value(__name__)
