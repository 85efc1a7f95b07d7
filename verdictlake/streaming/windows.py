"""Daily metrics of arriving answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from verdictlake.functions import exact


def daily_metrics(results: DataFrame, late_by: str = "1 day") -> DataFrame:
    """Answer count, mean latency and flagged rate per (day, model); ``at`` is the answer's time."""
    units = results.select(
        "at",
        "model_name",
        exact.latency_units(F.col("latency_ms")).alias("_u"),
        F.col("hallucination_flag"),
    )
    sums = (
        units.withWatermark("at", late_by)
        .groupBy(F.window("at", "1 day").alias("_day"), "model_name")
        .agg(
            F.count(F.lit(1)).alias("answers"),
            F.sum("_u").alias("_latency"),
            exact.flag_count(F.col("hallucination_flag")).alias("_flagged"),
        )
    )
    n = F.col("answers")
    return sums.select(
        F.col("_day.start").alias("day"),
        "model_name",
        "answers",
        exact.rounded_ratio(F.col("_latency"), n, exact.LATENCY_PLACES, 4).alias("latency_mean"),
        exact.rounded_ratio(F.col("_flagged"), n, 0, 4).alias("halluc_rate"),
    )


def stream_daily_metrics(
    results: DataFrame, out: str, checkpoint: str, late_by: str = "1 day"
) -> StreamingQuery:
    """Append each day once no more answers for it are expected."""
    return (
        daily_metrics(results, late_by)
        .writeStream.outputMode("append")
        .format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
