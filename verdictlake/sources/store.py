"""The run store: answers in one directory per run, and the table of runs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdictlake import schemas

# Files the table of runs is split into; a save rewrites only the ones it touches.
RUN_BUCKETS = 64


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A Parquet table, or no rows if nothing was written there yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def overwrite_partitions(df: DataFrame, path: str, *columns: str, gather: bool = True) -> None:
    """Replace the partitions that ``df`` has rows for and leave the others alone.

    With ``gather``, rows are brought together by partition and a large partition is split
    over several tasks by the adaptive plan. Without it every task writes what it has,
    which suits micro-batches: they are small, and their plans may not be adaptive.
    """
    if gather:
        df = df.hint("rebalance", *columns)
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*columns)
        .parquet(path)
    )


def replace_results(saved_runs: DataFrame, results: DataFrame, path: str) -> None:
    """Store the answers of ``saved_runs`` in place of what was stored for them before.

    A run saved without answers leaves one marker row without a sample id, so that its
    earlier answers are replaced as well; readers skip the marker.
    """
    columns = schemas.STORED_RESULT.fieldNames()
    filled = results.select(*columns)
    answered = filled.select("run_id").distinct()
    empty = saved_runs.select("run_id").distinct().join(answered, "run_id", "left_anti")
    marker = empty.select(
        "run_id",
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.STORED_RESULT if f.name != "run_id"],
    )
    overwrite_partitions(filled.unionByName(marker), path, "run_id")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return read_or_empty(spark, path, schemas.STORED_RESULT).filter(F.col("sample_id").isNotNull())


def upsert_runs(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """One row per run: dataset, models and creation time as first saved, the rest as last saved.

    ``incoming`` has an ascending ``seq``, the order in which its saves arrived.
    """
    first = ["dataset", "models", "created_at"]
    last = ["status", "started_at", "completed_at", "error"]
    saves = existing.withColumn("seq", F.lit(-1).cast("bigint")).unionByName(
        incoming.select(*existing.columns, F.col("seq").cast("bigint"))
    )
    merged = saves.groupBy("run_id").agg(
        F.min_by(F.struct(*first), "seq").alias("_first"), F.max_by(F.struct(*last), "seq").alias("_last")
    )
    return merged.select("run_id", "_first.*", "_last.*").select(*existing.columns)


def run_bucket() -> Column:
    """The bucket of a run; the same for one run in every table."""
    return F.pmod(F.xxhash64("run_id"), F.lit(RUN_BUCKETS)).cast("int")


def save_runs(spark: SparkSession, incoming: DataFrame, path: str) -> None:
    """Upsert runs into the stored table, rewriting only the buckets that hold them."""
    statuses = list(schemas.RUN_STATUSES)
    status = F.when(F.col("status").isin(statuses), F.col("status")).otherwise(
        F.raise_error(F.concat(F.lit("unknown run status: "), F.coalesce("status", F.lit("none")))).cast("string")
    )
    checked = incoming.withColumns({"status": status, "bucket": run_bucket()})
    stored = read_or_empty(spark, path, _bucketed()).join(
        checked.select("bucket").distinct(), "bucket", "left_semi"
    )
    merged = upsert_runs(stored.select(*schemas.RUN.fieldNames()), checked)
    overwrite_partitions(merged.withColumn("bucket", run_bucket()), path, "bucket")


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return read_or_empty(spark, path, _bucketed()).drop("bucket")


def _bucketed() -> T.StructType:
    return T.StructType(schemas.RUN.fields + [T.StructField("bucket", T.IntegerType())])
