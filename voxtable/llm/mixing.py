"""Mixing sources to target weights by hash-threshold histograms.

A row has a place, three hashes of PLACE_BITS bits that count one after another: of its id, of its text, and of its number.
A source that should give q whole copies of itself and a rest takes every row q times, and once more where its place lies
below the source's threshold. The threshold is found by summing sizes by source and the place's leading bits, choosing the bucket in
which the running sum meets the rest, and going on with the next bits inside that bucket alone. Nothing is sorted;
thresholds for larger budgets contain those for smaller ones. Rows that share an id are told apart by their texts, and
wholly repeated rows by their numbers, so a source meets its target to within one row whatever repeats in it.

Everything is DataFrame and SQL functions. A null text has size 0; a null source is a source of its own, the last in
order. Sources may be as many as documents. Empty tables give empty results, and columns of any name stay as they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxtable.llm.common import attach, stage

WORD = r"[^\x20\x09-\x0D]+"
#: Each hash of a place has LEVELS * BITS bits; each level refines by BITS, so a source has 256 buckets at once.
BITS, LEVELS = 8, 7
PLACE_BITS = BITS * LEVELS
#: The hashes of a place.
PLACE = ("by_id", "by_text", "by_row")


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def leading(digest: Column) -> Column:
    """PLACE_BITS bits of a digest in hexadecimal: the same on every engine."""
    return F.conv(F.substring(digest, 1, PLACE_BITS // 4), 16, 10).cast("long")


def places(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """The hashes of PLACE of each row. Row numbers follow the input's files; they only tell apart rows whose id and text are the same."""
    own = leading(F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")).cast("binary")))
    words = F.shiftrightunsigned(F.xxhash64(text), 64 - PLACE_BITS)
    number = F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 64 - PLACE_BITS)
    return [c.alias(n) for c, n in zip((own, words, number), PLACE, strict=True)]


def name(source: str = "source") -> Column:
    """A key that is never null; null sorts last."""
    return F.when(F.col(source).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source).cast("string")))


def numbered(sums: DataFrame) -> DataFrame:
    """sums with number, the place of key in their order from 0: row numbers within ranges of keys on top of the ranges' counts."""
    dealt = stage(sums.repartitionByRange("key").withColumn("range", F.spark_partition_id()), "mix-ranges")
    base = F.coalesce(F.sum("rows").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = dealt.groupBy("range").agg(F.count("*").alias("rows")).select("range", base.alias("base"))  # one row for each partition
    within = F.row_number().over(Window.partitionBy("range").orderBy("key"))
    return dealt.join(F.broadcast(ranges), "range").withColumn("number", F.col("base") + within - 1).drop("range", "base")


def targets(sums: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """sums (key, source_size, n) with target: share of the total by the weights in order of key, cut at most times the source's size and the excess dealt again by weight."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("number", F.lit(len(weights))) + 1).cast("int")).cast("double")
    first = numbered(sums).withColumns({"weight": weight, "cap": F.col("source_size") * F.lit(float(most))})
    first = stage(first, "mix-weights")
    total = (first.agg(F.sum("source_size")).first()[0] or 0) * float(share)
    level, cut = 0.0, -1
    while True:  # the level only rises, so what is cut stays cut
        at = F.col("cap") < F.lit(level) * F.col("weight")
        told = first.agg(F.count_if(at), F.sum(F.when(at, F.col("cap"))), F.sum(F.when(~at, F.col("weight")))).first()
        if told[0] == cut or not told[2]:
            break
        cut, level = told[0], (total - (told[1] or 0.0)) / told[2]
    return first.select("key", "n", "source_size", F.least("cap", F.lit(level) * F.col("weight")).alias("target"))


def thresholds(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """plan (key, n, source_size, target) with whole copies q and ends, the hashes below which a place gives one copy more."""
    ratio = F.col("target") / F.col("source_size")
    plan = plan.withColumn("q", F.when(F.col("source_size") > 0, F.floor(ratio)).otherwise(0).cast("long"))
    zero = F.lit(0).cast("long")
    start = {"need": F.col("target") - F.col("q") * F.col("source_size"), "inside": zero, "docs": F.lit(2).cast("long"), "prefix": zero, "shift": F.lit(PLACE_BITS), "part": F.lit(0)}
    cut = stage(plan.withColumns(start | {f"end_{p}": zero for p in PLACE}), "mix-plan")
    for part, hashed in enumerate(PLACE):
        if part:  # the hash before is used up: its value is fixed, and the next tells apart what shares it
            go = (F.col("need") > 0) & (F.col("docs") > 1)
            moved = {f"end_{PLACE[part - 1]}": F.when(go, F.col("prefix")).otherwise(F.col(f"end_{PLACE[part - 1]}")), "part": F.when(go, F.lit(part)).otherwise(F.col("part")), "prefix": F.when(go, zero).otherwise(F.col("prefix")), "shift": F.when(go, F.lit(PLACE_BITS)).otherwise(F.col("shift"))}
            cut = cut.withColumns(moved)
        for level in range(1, LEVELS + 1):
            if (cut.where("need > 0").agg(F.max("docs")).first()[0] or 0) <= 1:
                break
            cut = refined(sized, cut, part, hashed, PLACE_BITS - BITS * level)
    # the boundary bucket goes in if that comes nearer to the target
    last = F.when(F.col("need") <= 0, zero).when(2 * F.col("need") > F.col("inside"), F.col("prefix") + 1).otherwise(F.col("prefix"))
    cut = cut.withColumn("last", last.cast("long")).withColumn("last", F.expr("shiftleft(last, shift)"))
    ends = [F.when(F.col("part") == i, F.col("last")).when(F.col("part") > i, F.col(f"end_{p}")).otherwise(zero).alias(f"below_{p}") for i, p in enumerate(PLACE)]
    return cut.select("key", "n", "source_size", "target", "q", *ends)


def refined(sized: DataFrame, cut: DataFrame, part: int, hashed: str, shift: int) -> DataFrame:
    """cut with the bucket, BITS bits narrower, in which each open source's running sum meets its need."""
    fixed = [F.col(f"end_{p}").alias(f"_{p}") for p in PLACE[:part]]
    parents = cut.where("need > 0 and docs > 1").select("key", "n", F.col("prefix").alias("parent"), F.col("need").alias("wanted"), *fixed)
    held = attach(sized, parents, "key", "n").where(F.col("parent") == F.shiftright(hashed, shift + BITS))
    for p in PLACE[:part]:
        held = held.where(F.col(p) == F.col(f"_{p}"))
    counts = held.groupBy("key", F.shiftright(hashed, shift).alias("child")).agg(F.sum("size").alias("size"), F.count("*").alias("held"), F.first("wanted").alias("wanted"))
    running = F.sum("size").over(Window.partitionBy("key").orderBy("child"))  # 2^BITS rows of a source at most
    met = counts.withColumn("running", running).where("running >= wanted")
    found = met.groupBy("key").agg(F.min(F.struct("child", "running", "size", "held")).alias("b"))
    none = F.col("b").isNull()
    new = {
        "need": F.when(none, F.col("need")).otherwise(F.col("need") - (F.col("b.running") - F.col("b.size"))),
        "inside": F.coalesce("b.size", "inside"), "docs": F.coalesce("b.held", F.lit(1).cast("long")),
        "shift": F.when(none, F.col("shift")).otherwise(F.lit(shift)), "prefix": F.coalesce("b.child", "prefix"),
    }
    return stage(cut.join(found.hint("merge"), "key", "left").withColumns(new).drop("b"), "mix-cut")


def mix(documents: DataFrame, weights: Sequence[int], share: float, most: float) -> tuple[DataFrame, DataFrame]:
    """Sizes (doc_id, key, size and the place) of all documents (doc_id, text, source), and the plan of each source."""
    sized = stage(documents.select("doc_id", name().alias("key"), words().alias("size"), *places()), "mix-sizes")
    sums = sized.groupBy("key").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    return sized, stage(thresholds(sized, targets(sums, weights, share, most)), "mix-thresholds")


def copies() -> Column:
    """How often a row with its source's plan goes into the mix."""
    below = F.lit(False)
    for p in reversed(PLACE):
        below = (F.col(p) < F.col(f"below_{p}")) | ((F.col(p) == F.col(f"below_{p}")) & below)
    return F.col("q") + below.cast("long")


def mixed_rows(documents: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """The mix itself: each row of documents as often as it is taken."""
    _, plan = mix(documents, weights, share, most)
    own = documents.select(F.struct("*").alias("row"), name().alias("key"), *places())
    taken = attach(own, plan, "key", "n").withColumn("copies", copies())
    return taken.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("row.*")
