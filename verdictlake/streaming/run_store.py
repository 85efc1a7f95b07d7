"""A run store fed by arriving result files, with points kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from verdictlake.functions.ordinals import first_per_group
from verdictlake.operators.metrics import dated_points, run_model_points
from verdictlake.sources.store import overwrite_partitions, read_or_empty, run_bucket

ANSWER = ("run_id", "sample_id", "model_name")
POINT = ("run_id", "model_name")

MEASURES = T.StructType(
    [T.StructField(name, T.StringType()) for name in POINT]
    + [T.StructField(n, T.DoubleType()) for n in ("rouge1_mean", "rougeL_mean", "halluc_rate", "latency_p50", "latency_p95")]
)
PLACE = [T.StructField("bucket", T.IntegerType()), T.StructField("batch", T.LongType())]


def latest_answers(log: DataFrame) -> DataFrame:
    """One row per (run, sample, model): the one of the highest ``saved_seq``."""
    return first_per_group(log, ANSWER, F.col("saved_seq").desc(), F.col("batch").desc())


def read_log(spark: SparkSession, log: str, schema: T.StructType) -> DataFrame:
    return read_or_empty(spark, log, T.StructType(schema.fields + PLACE))


def stream_run_store(
    spark: SparkSession,
    landing: str,
    schema: T.StructType,
    log: str,
    points: str,
    checkpoint: str,
    files_per_batch: int = 100,
) -> StreamingQuery:
    """Log arriving answers and refresh the points of the runs they belong to.

    Log and points are kept per (bucket of the run, batch): a batch that is repeated after a
    failure replaces what it wrote, stored answers are never rewritten, and a batch writes at
    most one file per bucket and task of the rebalanced write. Only the buckets a batch touches
    are read again. Points hold no run data, so a run that comes or changes later shows up when
    they are read. ``schema`` is that of the arriving files and includes ``saved_seq``, the order
    of saves.
    """
    arriving = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(landing)
    )

    def merge(batch: DataFrame, number: int) -> None:
        placed = batch.withColumns({"bucket": run_bucket(), "batch": F.lit(number).cast("bigint")})
        overwrite_partitions(placed, log, "bucket", "batch")
        # Bounded by the number of buckets; it prunes the log to their folders.
        buckets = [row.bucket for row in placed.select("bucket").distinct().collect()]
        touched = batch.select("run_id").distinct()
        kept = read_log(spark, log, schema).filter(F.col("bucket").isin(buckets)).join(touched, "run_id", "left_semi")
        fresh = run_model_points(latest_answers(kept))
        overwrite_partitions(
            fresh.withColumns({"bucket": run_bucket(), "batch": F.lit(number).cast("bigint")}), points, "bucket", "batch"
        )

    return (
        arriving.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_points(spark: SparkSession, points: str, runs: DataFrame) -> DataFrame:
    """The last written point of each (run, model) with the run's dataset and time as ``runs`` has them now."""
    written = read_or_empty(spark, points, T.StructType(MEASURES.fields + PLACE))
    return dated_points(first_per_group(written, POINT, F.col("batch").desc()).drop("bucket", "batch"), runs)


def compact(spark: SparkSession, log: str, points: str, schema: T.StructType, new_log: str, new_points: str) -> None:
    """Write log and points anew with one row per answer and per point, to be run while the stream rests.

    Rows keep their batch number, so a stream that goes on with the new folders stays in order.
    """
    overwrite_partitions(latest_answers(read_log(spark, log, schema)), new_log, "bucket", "batch")
    written = read_or_empty(spark, points, T.StructType(MEASURES.fields + PLACE))
    overwrite_partitions(first_per_group(written, POINT, F.col("batch").desc()), new_points, "bucket", "batch")
