"""The monitoring view over the run store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from verdictlake.operators import metrics, trends
from verdictlake.sources.scratch import saved
from verdictlake.sources.store import read_results, read_runs


def stored_series(
    spark: SparkSession,
    runs_path: str,
    results_path: str,
    model: str | None = None,
    dataset: str | None = None,
    last: int = 0,
) -> DataFrame:
    """The points of the store, filtered by model and dataset; ``last`` keeps the last ones only, 0 all.

    Drift needs all points: a cut runs over all series together.
    """
    points = metrics.filtered_timeseries(
        read_results(spark, results_path), read_runs(spark, runs_path), model, dataset
    )
    return metrics.last_points(points, last)


def health(points: DataFrame) -> dict[str, DataFrame]:
    """Latency and flag-rate trends, drift of every run, and drift of each series' last run."""
    points = saved(points, "points")
    drift = trends.accuracy_drift(points)
    return {
        "latency": trends.latency_trend(points),
        "hallucination": trends.halluc_trend(points),
        "drift": drift,
        "latest_drift": trends.latest_drift(drift),
    }
