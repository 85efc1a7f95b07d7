"""Current status of runs from their lifecycle events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from verdictlake import schemas
from verdictlake.sources.store import overwrite_partitions


def _rank(status: Column) -> Column:
    """Of two events at one time the one further on in a run's life counts."""
    return F.array_position(F.array(*[F.lit(s) for s in schemas.RUN_STATUSES]), status)


def run_status(events: DataFrame) -> DataFrame:
    """Latest status per run; works on a table and on a stream."""
    at = F.struct("at", _rank(F.col("status")))
    return events.groupBy("run_id").agg(F.max_by("status", at).alias("status"), F.max("at").alias("at"))


def stream_run_status(
    spark: SparkSession, landing: str, log: str, checkpoint: str, files_per_batch: int = 100
) -> StreamingQuery:
    """Keep a log of status changes from arriving event files.

    Each micro-batch writes the runs it changed under its own number, so a repeated batch
    replaces its own rows and earlier ones are never rewritten.
    """
    events = (
        spark.readStream.schema(schemas.RUN_EVENT)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(landing)
    )

    def write(changed: DataFrame, batch: int) -> None:
        overwrite_partitions(changed.withColumn("batch", F.lit(batch)), log, "batch", gather=False)

    return (
        run_status(events)
        .writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def compact_run_status(spark: SparkSession, log: str, new_log: str) -> None:
    """Write the log anew with the last change of each run, which keeps its batch number."""
    last = (
        spark.read.parquet(log)
        .groupBy("run_id")
        .agg(F.max_by(F.struct("status", "at", "batch"), "batch").alias("_last"))
        .select("run_id", "_last.*")
    )
    overwrite_partitions(last, new_log, "batch")


def read_run_status(spark: SparkSession, log: str) -> DataFrame:
    """The last logged status of each run."""
    return (
        spark.read.parquet(log)
        .groupBy("run_id")
        .agg(F.max_by(F.struct("status", "at"), "batch").alias("_last"))
        .select("run_id", "_last.*")
    )
