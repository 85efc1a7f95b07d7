"""Runtime settings the operators rely on. All are SQL settings that can be set on a live session."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # Day windows and stored timestamps are UTC.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A join whose smaller side turns out to fit per task is hashed instead of sorted.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
    # Texts can be long, so an Arrow batch is kept to few rows.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


def configure(spark: SparkSession) -> SparkSession:
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    return spark
