"""URL filters: host rules, and pattern rules that are indexed by their rarest literal.

Host rules name a host (it and all its subdomains) and the start of a path; the longest that fits decides. Where none
fits, pattern rules (regular expressions) decide. A pattern rule is kept under the rarest of the fixed-length literals
that every match of it must contain, by their counts over all urls; one without such a literal is kept under the rarest of each
of its alternatives. The literals of a url fetch candidate rules, and only those run. Rules with an alternative without a literal run on every url.

A null url, or one without "://", has an empty host and path and is judged as an empty text. Repeated rows are judged alike. A url of any
length is judged whole. An empty table gives no rows. Other columns are not read, so their names do not matter.
Rules are read in blocks of bounded size, so a list of any length works.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from re import _constants as op  # noqa: PLC2701
from re import _parser as parser  # noqa: PLC2701

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtable.llm.common import by_value, trimmed

#: Length of the literals in the index.
GRAM = 4
#: Alternatives that a rule may have in the index, those of several groups multiplied.
MOST_CHOICES = 64
#: Rules that travel to a task at once.
BLOCK_RULES = 50_000
SCHEMA = "page_id long, url string, host string, path string, rule string, action string, pattern string, verdict string"


def parts(url: bytes) -> tuple[str, str]:
    """Host, with A-Z lower-cased, and path."""
    _, found, rest = url.partition(b"://")
    if not found:
        return "", ""
    rest = re.split(rb"[?#]", rest, maxsplit=1)[0]
    host, slash, path = rest.partition(b"/")
    return host.lower().decode("utf-8", "replace"), (slash + path).decode("utf-8", "replace")


def choices(pattern: str, most: int = MOST_CHOICES) -> list[set[str]]:
    """Sets of GRAM-letter runs of lower-cased ASCII: each match of the pattern contains all of one set. Alternations beyond most sets count as unknown."""

    def walk(items: Sequence, found: list[list[str]]) -> list[list[str]]:
        for kind, value in items:
            if kind is op.LITERAL and value < 128:
                for runs in found:
                    runs[-1] += chr(value).lower()
            elif kind is op.SUBPATTERN and not value[1] & re.VERBOSE:
                found = walk(value[3], found)
            elif kind is op.BRANCH and len(found) * len(value[1]) <= most:
                found = [runs for option in value[1] for runs in walk(option, [list(runs) for runs in found])]
            elif kind is op.AT and value in (op.AT_BOUNDARY, op.AT_NON_BOUNDARY):
                continue
            else:
                for runs in found:
                    runs.append("")
        return found

    told = walk(parser.parse(pattern, re.ASCII), [[""]])
    return [{run[i : i + GRAM] for run in runs for i in range(len(run) - GRAM + 1)} for runs in told]


def literals(pattern: str) -> set[str]:
    """All GRAM-letter runs of lower-cased ASCII that each match of the pattern must contain."""
    return choices(pattern, 1)[0]


def indexed(pattern: str) -> list[set[str]]:
    """Sets of literals of which each match contains one set at least; none where nothing is known."""
    if found := literals(pattern):
        return [found]
    told = choices(pattern)
    return told if all(told) else []


def grams(url: str) -> set[str]:
    return {url[i : i + GRAM] for i in range(len(url) - GRAM + 1)}


def gram_counts(pages: DataFrame, wanted: set[str]) -> Counter:
    """In how many urls each wanted literal occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in batches:
            for url in b["url"].to_pylist():
                total.update(grams((url or "").lower()) & wanted)
        yield pa.RecordBatch.from_pydict({"gram": pa.array(list(total), pa.string()), "n": pa.array(list(total.values()), pa.int64())})

    counts = pages.select("url").mapInArrow(trimmed(run), "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return Counter({r["gram"]: r["n"] for r in counts.collect()})  # at most the wanted ones


def index(rules: Sequence[tuple[str, str]], counts: Counter) -> tuple[dict[str, list[int]], list[int]]:
    """Rules' numbers by the rarest literal (the first of equals) of each of their choices, and those without any."""
    by_gram: dict[str, list[int]] = {}
    always = []
    for i, (pattern, _) in enumerate(rules):
        if told := indexed(pattern):
            for gram in {min(found, key=lambda g: (counts[g], g)) for found in told}:
                by_gram.setdefault(gram, []).append(i)
        else:
            always.append(i)
    return by_gram, always


def judge(pages: DataFrame, hosts: Sequence[tuple[str, str, str]], patterns: Sequence[tuple[str, str]]) -> DataFrame:
    """page_id, url, host, path, rule (the longest host rule that fits), pattern (the first pattern rule that matches,
    where no host rule does), verdict. hosts: (host, path, action); patterns: (pattern, action). Without any rule: allow."""
    out = pages.select(F.col("page_id").cast("long"), "url", *[F.lit(None).cast("string").alias(c) for c in ("host", "path", "rule", "action", "pattern")], F.lit("allow").alias("verdict"))
    for at in range(0, max(len(hosts), 1), BLOCK_RULES):
        out = by_host(out, hosts[at : at + BLOCK_RULES])
    for at in range(0, len(patterns), BLOCK_RULES):
        block = patterns[at : at + BLOCK_RULES]
        out = by_pattern(out, block, gram_counts(pages, set().union(*(found for pattern in dict(block) for found in indexed(pattern)))))
    return out.drop("action")


def by_host(judged: DataFrame, hosts: Sequence[tuple[str, str, str]]) -> DataFrame:
    paths: dict[str, list[tuple[str, str]]] = {}
    for host, path, action in hosts:
        paths.setdefault(host, []).append((path, action))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            for r in rows:
                r["host"], r["path"] = parts((r["url"] or "").encode())
                best = len(r["rule"] or "")
                names = r["host"].split(".") if r["host"] else []
                for i in range(len(names)):
                    suffix = ".".join(names[i:])
                    for path, action in paths.get(suffix, ()):
                        if len(suffix) + len(path) > best and r["path"].startswith(path):
                            best = len(suffix) + len(path)
                            r |= {"rule": suffix + path, "action": action, "verdict": action}
            yield pa.RecordBatch.from_pylist(rows, schema=b.schema)

    return judged.mapInArrow(trimmed(run), SCHEMA)


def by_pattern(judged: DataFrame, rules: Sequence[tuple[str, str]], counts: Counter) -> DataFrame:
    by_gram, always = index(rules, counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled: dict[int, re.Pattern] = {}
        for b in batches:
            rows = b.to_pylist()
            for r in rows:
                if r["rule"] is not None or r["pattern"] is not None:
                    continue
                url = r["url"] or ""
                for i in sorted({*always, *(i for g in grams(url.lower()) & by_gram.keys() for i in by_gram[g])}):
                    if i not in compiled:
                        compiled[i] = re.compile(rules[i][0], re.IGNORECASE | re.ASCII)
                    if compiled[i].search(url):
                        r |= {"pattern": rules[i][0], "verdict": rules[i][1]}
                        break
            yield pa.RecordBatch.from_pylist(rows, schema=b.schema)

    return judged.mapInArrow(trimmed(run), SCHEMA)


def columns(judged: DataFrame) -> list[Column]:
    return [judged[c] for c in ("page_id", "host", "path", "rule", "verdict", "pattern")]


by_value(__name__)
