"""Running streams over folders to their end, with a checkpoint, into a sink that a repeated batch does not change."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
BATCH = "_batch"
SHUFFLES = "spark.sql.shuffle.partitions"
#: State partitions for each core, at most: each takes some 0.3 s of a core in each trigger, whatever it holds.
STATES = 2


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session's settings for a while."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def opened(spark: SparkSession, folder: str, schema: StructType, kind: str = "parquet", files_a_trigger: int | None = None) -> DataFrame:
    """The files of a folder as a stream, so many for each trigger."""
    reader = spark.readStream.schema(schema).format(kind)
    return (reader if files_a_trigger is None else reader.option("maxFilesPerTrigger", files_a_trigger)).load(folder)


def run(stream: DataFrame, folder: str, mode: str = "append") -> None:
    """Reads what is there to its end and stops; a later run goes on behind it.

    Each batch is written under its own number, over what a try before left there: a batch that is run again after a failure changes nothing.
    Progress and state are kept beside the batches. A new stream has the session's shuffle partitions, but no more than STATES for each core; they stay with its checkpoint.
    """
    spark = stream.sparkSession
    most = {SHUFFLES: str(min(int(spark.conf.get(SHUFFLES)), STATES * spark.sparkContext.defaultParallelism))}

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/{BATCH}={number}")

    with settings(spark, ROCKS | most):
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
        query.awaitTermination()


def rows_of(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """All rows that run() wrote in append mode."""
    return with_batches(spark, folder, schema).drop(BATCH)


def with_batches(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    return spark.read.schema(StructType([*schema.fields]).add(BATCH, "long")).option("basePath", f"{folder}/rows").parquet(f"{folder}/rows")


def latest_of(spark: SparkSession, folder: str, schema: StructType, keys: list[str]) -> DataFrame:
    """The last row of each key that run() wrote in update mode."""
    told = with_batches(spark, folder, schema)
    last = told.groupBy(*keys).agg(F.max_by(F.struct(*schema.names), BATCH).alias("_row"))
    return last.select("_row.*")
