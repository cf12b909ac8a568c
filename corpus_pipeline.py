"""A corpus pipeline over documents: toxic ones go, near-duplicates go, contaminated ones go, sources are mixed, and the rest becomes token files.

Each stage works on all that the one before it kept, and its result is written as Parquet and read again. All but the
last return the columns of documents, under whatever names. Rows are judged each for itself, by id and text: rows that share an
id but not a text, or have none, are not taken for one another, and of wholly repeated rows with words one stays. Empty tables pass through every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtable.llm import decontaminate, minhash, mixing, queries, token_files, toxicity
from voxtable.llm.common import new_path


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that score below the threshold. Learns from labels outside the held-out fold, as op5 does."""
    model = toxicity.fit(toxicity.training_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    scored = model.score(docs.select(F.struct("*").alias("doc"), "text"), "text", "score")
    return scored.where(F.col("score") < toxicity.THRESHOLD).select("doc.*")


def near_duplicate_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near-duplicates, the one with the smallest doc_id, and every row without words."""
    return minhash.one_of_each(docs)


def decontamination_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the benchmark does not contaminate."""
    found = decontaminate.match(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(~decontaminate.contaminated()).select("row.*")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents so that sources come near their target weights; a document that is taken twice is two rows."""
    return mixing.mixed_rows(docs, queries.WEIGHTS, queries.SHARE, queries.MOST)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each row, read back from the token files."""
    return token_files.round_trip(docs, public_tokenizers.path(queries.TOKENIZER))


STAGES = [
    ("toxicity", toxicity_filter),
    ("near_duplicates", near_duplicate_filter),
    ("decontamination", decontamination_filter),
    ("mixing", source_mix),
    ("token_files", token_output),
]

#: No SQL trains a classifier or applies a tokenizer; a test holds the rows of run() against brute-force versions of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        function(spark, docs, sf_dir).write.parquet(path := new_path(spark, f"pipeline-{name}"))
        docs = spark.read.parquet(path)
    return docs
