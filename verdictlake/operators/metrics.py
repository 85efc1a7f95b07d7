"""Aggregates over scored answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdictlake.functions import exact
from verdictlake.functions.quantiles import (
    interpolated_units,
    order_statistics,
    percentile_ranks,
    rank_values,
    upper_median_rank,
)

RUN_MODEL = ("run_id", "model_name")
DEFAULT_POINTS = 100
SKETCH_SIZE = 2000


def _units(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The narrow table the aggregates read: keys and whole-number measures."""
    return results.select(
        *keys,
        exact.score_units(F.col("rouge1")).alias("rouge1_u"),
        exact.score_units(F.col("rougeL")).alias("rougeL_u"),
        exact.latency_units(F.col("latency_ms")).alias("latency_u"),
        F.col("hallucination_flag"),
    )


def _sums() -> dict[str, Column]:
    return {
        "cnt": F.count(F.lit(1)),
        "rouge1_sum": F.sum("rouge1_u"),
        "rougeL_sum": F.sum("rougeL_u"),
        "flagged": exact.flag_count(F.col("hallucination_flag")),
        "latency_sum": F.sum("latency_u"),
    }


def _score_mean(total: str, places: int = 4) -> Column:
    return exact.rounded_ratio(F.col(total), F.col("cnt"), exact.SCORE_PLACES, places)


def _rate() -> Column:
    return exact.rounded_ratio(F.col("flagged"), F.col("cnt"), 0, 4)


def _percentile(pct: int, name: str, places: int) -> Column:
    """An interpolated latency percentile in ms, 0 without latencies; the interpolation has 4 decimals."""
    one = F.lit(1).cast("bigint")
    return F.coalesce(exact.rounded_ratio(interpolated_units(pct, name), one, 4, places), F.lit(0.0))


def _profile(results: DataFrame, keys: Sequence[str], latency_places: int) -> DataFrame:
    """Means, flag rate and latency percentiles per group."""
    ranks = {**percentile_ranks(50, "p50"), **percentile_ranks(95, "p95")}
    return order_statistics(_units(results, keys), keys, "latency_u", ranks, _sums()).select(
        *keys,
        _score_mean("rouge1_sum").alias("rouge1_mean"),
        _score_mean("rougeL_sum").alias("rougeL_mean"),
        _rate().alias("halluc_rate"),
        _percentile(50, "p50", latency_places).alias("latency_p50"),
        _percentile(95, "p95", latency_places).alias("latency_p95"),
    )


def run_model_points(results: DataFrame) -> DataFrame:
    """Means, flag rate and latency percentiles per (run, model), without anything of the run."""
    return _profile(results, RUN_MODEL, latency_places=2)


def metrics_timeseries(results: DataFrame, runs: DataFrame) -> DataFrame:
    """One point per (run, model). The answers are aggregated before runs are joined."""
    return dated_points(run_model_points(results), runs)


def dated_points(points: DataFrame, runs: DataFrame) -> DataFrame:
    """Points of ``run_model_points`` with dataset and time of their runs."""
    about = runs.select("run_id", "dataset", F.col("completed_at").alias("start_time"))
    return points.join(about, "run_id").select(
        "run_id",
        F.lit(None).cast("string").alias("run_name"),
        "dataset",
        "model_name",
        "start_time",
        "rouge1_mean",
        "rougeL_mean",
        "halluc_rate",
        "latency_p50",
        "latency_p95",
    )


def filtered_timeseries(
    results: DataFrame, runs: DataFrame, model: str | None = None, dataset: str | None = None
) -> DataFrame:
    """The series of one model and/or one dataset; an empty filter keeps everything."""
    if model:
        results = results.filter(F.col("model_name") == model)
    if dataset:
        runs = runs.filter(F.col("dataset") == dataset)
        results = results.join(runs.select("run_id"), "run_id", "left_semi")
    return metrics_timeseries(results, runs)


def last_points(points: DataFrame, n: int = DEFAULT_POINTS) -> DataFrame:
    """The last ``n`` points, oldest first; runs without a time come first; 0 keeps all."""
    if n < 0:
        raise ValueError("n must not be negative")
    if n:
        points = points.orderBy(
            F.col("start_time").desc_nulls_last(), F.col("run_id").desc(), F.col("model_name").desc()
        ).limit(n)
    return points.orderBy(F.col("start_time").asc_nulls_first(), "run_id", "model_name")


def latency_percentiles(
    results: DataFrame, keys: Sequence[str], percentiles: Sequence[int] = (50, 95)
) -> DataFrame:
    """Exact linearly interpolated latency percentiles per group, to 4 decimals."""
    keys = list(keys)
    units = results.select(*keys, exact.latency_units(F.col("latency_ms")).alias("latency_u"))
    ranks = {}
    for pct in percentiles:
        ranks.update(percentile_ranks(pct, f"p{pct}"))
    return rank_values(units, keys, "latency_u", ranks).select(
        *keys, "n", *[_percentile(p, f"p{p}", 4).alias(f"latency_p{p}") for p in percentiles]
    )


def approximate_latency_percentiles(
    results: DataFrame,
    keys: Sequence[str],
    percentiles: Sequence[int] = (50, 95),
    accuracy: int = 10000,
) -> DataFrame:
    """Latency percentiles from a mergeable sketch, in one pass; ranks off by n / accuracy at most."""
    return results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[
            F.percentile_approx("latency_ms", p / 100, accuracy).alias(f"latency_p{p}_approx")
            for p in percentiles
        ],
    )


def latency_sketches(results: DataFrame, keys: Sequence[str] = RUN_MODEL, size: int = SKETCH_SIZE) -> DataFrame:
    """A mergeable KLL sketch of the latencies of each group, a few kilobytes whatever its size, to be stored."""
    units = results.select(*keys, exact.latency_units(F.col("latency_ms")).alias("_u")).filter(F.col("_u").isNotNull())
    return units.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_bigint("_u", F.lit(size)).alias("sketch"))


def sketched_percentiles(
    sketches: DataFrame, keys: Sequence[str], percentiles: Sequence[int] = (50, 95)
) -> DataFrame:
    """Latency percentiles of wider groups from stored sketches of narrower ones, without their answers.

    Ranks are off by at most 0.2% of n, nearly always, at the default size.
    """
    merged = sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_bigint("sketch").alias("_all"))
    return merged.select(
        *keys,
        "n",
        *[
            exact.unscaled(F.kll_sketch_get_quantile_bigint("_all", F.lit(p / 100)), exact.LATENCY_PLACES).alias(f"latency_p{p}_approx")
            for p in percentiles
        ],
    )


def model_aggregate(results: DataFrame) -> DataFrame:
    """Per model: score means, flag rate, median and 95th percentile latency, all to 4 decimals."""
    return _profile(results, ["model_name"], latency_places=4).orderBy("model_name")


def model_means(results: DataFrame) -> DataFrame:
    """Per model: mean scores, flag rate and mean latency, to 4 decimals."""
    latency = exact.rounded_ratio(F.col("latency_sum"), F.col("cnt"), exact.LATENCY_PLACES, 4)
    totals = _units(results, ["model_name"]).groupBy("model_name").agg(*[c.alias(name) for name, c in _sums().items()])
    return totals.select(
        "model_name",
        _score_mean("rouge1_sum").alias("rouge1"),
        _score_mean("rougeL_sum").alias("rougeL"),
        _rate().alias("hallucination_flag"),
        latency.alias("latency_ms"),
    )


def model_comparison(results: DataFrame, keys: Sequence[str] = ("model_name",)) -> DataFrame:
    """Unrounded means, flag rate, upper median latency and answer count per group."""
    keys = list(keys)
    totals = order_statistics(_units(results, keys), keys, "latency_u", {"middle": upper_median_rank}, _sums())
    count = F.col("cnt").cast("double")

    def mean(total: str) -> Column:
        return exact.unscaled(F.col(total).cast("double") / count, exact.SCORE_PLACES)

    return totals.select(
        *keys,
        mean("rouge1_sum").alias("rouge1"),
        mean("rougeL_sum").alias("rougeL"),
        (F.col("flagged").cast("double") / count).alias("halluc_rate"),
        exact.unscaled(F.col("middle"), exact.LATENCY_PLACES).alias("latency_p50"),
        F.col("cnt").alias("answers"),
    )


def experiment_metrics(results: DataFrame) -> DataFrame:
    """Per run the five metrics of each model as (metric, value) rows."""
    wide = _profile(results, RUN_MODEL, latency_places=2)
    prefix = F.translate(F.col("model_name"), ":/", "__")
    long = wide.unpivot(
        list(RUN_MODEL),
        ["rouge1_mean", "rougeL_mean", "halluc_rate", "latency_p50", "latency_p95"],
        "_metric",
        "value",
    )
    return long.select("run_id", F.concat_ws("_", prefix, "_metric").alias("metric"), "value")


def experiment_params(plan: DataFrame) -> DataFrame:
    """Per run: how many samples were planned and for which models."""
    per_model = plan.groupBy(*RUN_MODEL).agg(F.count(F.lit(1)).alias("planned"))
    # Every model of a run gets every sample, and a run names few models.
    return per_model.groupBy("run_id").agg(
        F.max("planned").alias("num_samples"), F.array_sort(F.collect_set("model_name")).alias("models")
    )


def run_summary(runs: DataFrame, results: DataFrame) -> DataFrame:
    """Each run with the number of its stored answers."""
    counts = results.groupBy("run_id").agg(F.count(F.lit(1)).alias("sample_count"))
    return runs.join(counts, "run_id", "left").withColumn(
        "sample_count", F.coalesce("sample_count", F.lit(0).cast("bigint"))
    )


def relative_score(comparison: DataFrame) -> DataFrame:
    """A model's ROUGE-L as a percentage of the best in its run; one row per (run, model) in."""
    best = F.max("rougeL").over(Window.partitionBy("run_id"))
    floor = F.greatest(F.lit(0.0001), best)
    return comparison.withColumn("relative_score", F.col("rougeL") / floor * F.lit(100.0))
