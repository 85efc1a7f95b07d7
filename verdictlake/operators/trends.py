"""Series over runs: drift, trends, and lookups on a series.

These read points, one row per (run, model). Give them a stored points table (or
``scratch.saved``) rather than a plan over raw answers, since several use it twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdictlake.functions import exact
from verdictlake.functions.ordinals import first_per_group, number_rows, trailing_sum

# Fixed values of the drift rule: runs looked back on, and the tolerated loss in percent.
LOOK_BACK = 5
TOLERANCE_PCT = 15

SERIES = ("model_name", "dataset")

# Tasks over which the probes of one slice are spread.
SALTS = 16


def accuracy_drift(points: DataFrame, slice_days: int = 30) -> DataFrame:
    """Flag a run whose ROUGE-L mean is under the mean of the five runs before it, less 15%.

    A run is flagged only if it has five runs before it. Runs are in order of
    (start_time, run_id); a run without a time has no place in the series. A series is
    cut into slices of ``slice_days`` days, so its length does not bound the job.
    """
    timed = points.filter(F.col("start_time").isNotNull()).select(
        "run_id", *SERIES, "start_time", "rougeL_mean", exact.score_units(F.col("rougeL_mean")).alias("_u")
    )
    stretch = F.floor(F.unix_micros("start_time") / F.lit(86400000000 * slice_days)).cast("bigint")
    placed = number_rows(timed, SERIES, stretch, ["start_time", "run_id"], "_no")
    looked = trailing_sum(placed, SERIES, "_no", "_u", LOOK_BACK, "_before", "_seen")
    enough = F.col("_seen") == LOOK_BACK
    kept = 100 - TOLERANCE_PCT
    # threshold = (sum / look back) * kept / 100, compared in whole numbers
    threshold = (F.col("_before") * kept).cast("double") / F.lit(
        float(LOOK_BACK * 100 * 10**exact.SCORE_PLACES)
    )
    below = F.col("_u") * (LOOK_BACK * 100) < F.col("_before") * kept
    return looked.select(
        "run_id",
        *SERIES,
        "start_time",
        "rougeL_mean",
        F.col("_seen").alias("runs_before"),
        F.when(enough, threshold).alias("threshold"),
        F.coalesce(enough & below, F.lit(False)).alias("drift"),
    )


def latest_drift(drift: DataFrame) -> DataFrame:
    """The drift row of the last run of each series."""
    return first_per_group(drift, SERIES, F.col("start_time").desc(), F.col("run_id").desc())


def latency_trend(points: DataFrame) -> DataFrame:
    """Median and 95th percentile latency as two series of each (model, dataset)."""
    return points.unpivot(
        ["run_id", *SERIES, "start_time"], ["latency_p50", "latency_p95"], "series", "y"
    ).withColumnRenamed("start_time", "x")


def halluc_trend(points: DataFrame) -> DataFrame:
    """Flagged-answer rate of each run over time."""
    return points.select(
        "run_id", *SERIES, F.col("start_time").alias("x"), F.col("halluc_rate").alias("y")
    ).orderBy(F.col("x").asc_nulls_first(), "run_id", "model_name")


def latest_point(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The last point by x of each series; of several at one x the one with the last run id."""
    timed = series.filter(F.col("x").isNotNull()).select(*keys, "x", "run_id", "y")
    return first_per_group(timed, keys, F.col("x").desc(), F.col("run_id").desc())


def series_extent(
    series: DataFrame,
    keys: Sequence[str] = (),
    reference_y: float | None = None,
    y_min: float | None = None,
    y_max: float | None = None,
) -> DataFrame:
    """Chart ranges of a set of series: x in epoch milliseconds, y padded by 15% of its range."""
    x = F.unix_millis("x").cast("double")
    ranges = series.groupBy(*keys).agg(
        F.min(x).alias("_x0"), F.max(x).alias("_x1"), F.min("y").alias("_y0"), F.max("y").alias("_y1")
    )
    line = F.lit(reference_y).cast("double")
    low = F.coalesce(F.least("_y0", line), F.lit(0.0))
    high = F.coalesce(F.greatest("_y1", line), F.lit(1.0))
    spread = (high - low) * F.lit(0.15)
    flat = F.abs(F.when(high == 0, F.lit(1.0)).otherwise(high)) * F.lit(0.1)
    pad = F.when(spread == 0, flat).otherwise(spread)
    top = high + pad
    bottom = F.greatest(F.lit(0.0), low - pad)
    return ranges.select(
        *keys,
        F.coalesce("_x0", F.lit(0.0)).alias("x_min"),
        F.coalesce("_x1", F.lit(1.0)).alias("x_max"),
        (bottom if y_min is None else F.lit(float(y_min))).alias("y_min"),
        (F.when(top == 0, F.lit(1.0)).otherwise(top) if y_max is None else F.lit(float(y_max))).alias("y_max"),
    )


def _nearest_x(probes: DataFrame, points: DataFrame, keys: list[str], at: str, out: str, slice_by) -> DataFrame:
    """Add to each probe the x nearest to ``at`` among the points of its key; ties go to the earlier x.

    Both tables are cut into the same slices of the x axis. Within a slice the neighbours
    come from one ordered pass; beyond it they are the edges of the nearest slices that
    hold points, found on one row per slice. A slice with many probes is salted: its
    probes are spread over ``SALTS`` tasks and its few distinct x go to each of them.
    """
    marks = points.select(*keys, F.col("x").alias("_x")).distinct().withColumn("_slice", slice_by(F.col("_x")))
    salt = F.pmod(F.xxhash64(*probes.columns), F.lit(SALTS))
    asked = probes.withColumns({"_slice": slice_by(F.col(at)), "_salt": salt, "_at": F.col(at)})
    salted = marks.withColumns(
        {"_salt": F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))), "_at": F.col("_x")}
    )

    edges = marks.groupBy(*keys, "_slice").agg(F.min("_x").alias("_first"), F.max("_x").alias("_last"))
    slices = (
        edges.unionByName(asked.select(*keys, "_slice").distinct(), allowMissingColumns=True)
        .groupBy(*keys, "_slice")
        .agg(F.max("_first").alias("_first"), F.max("_last").alias("_last"))
    )
    along = Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    around = slices.select(
        *keys,
        "_slice",
        F.max("_last").over(along.orderBy("_slice")).alias("_prev"),
        F.min("_first").over(along.orderBy(F.col("_slice").desc())).alias("_next"),
    )

    # Both frames run from the start of an order, so each row is added once.
    inside = Window.partitionBy(*keys, "_slice", "_salt")
    low_side, high_side = inside.orderBy("_at"), inside.orderBy(F.col("_at").desc())
    placed = (
        asked.unionByName(salted, allowMissingColumns=True)
        .withColumns({"_low": F.max("_x").over(low_side), "_high": F.min("_x").over(high_side)})
        .filter(F.col("_x").isNull())
        .join(around, [*keys, "_slice"], "left")
    )
    low, high = F.coalesce("_low", "_prev"), F.coalesce("_high", "_next")

    def gap(x: Column) -> Column:
        return F.abs(F.unix_micros(x) - F.unix_micros(at))

    nearest = F.when(low.isNull(), high).when(high.isNull(), low).when(gap(high) < gap(low), high).otherwise(low)
    return placed.withColumn(out, nearest).select(*probes.columns, out)


def nearest_points(
    probes: DataFrame,
    series: DataFrame,
    chart: Sequence[str],
    line: str = "series",
    slice_seconds: int = 86400,
) -> DataFrame:
    """For each probed time: the nearest x of its chart, then the point of each line there or closest to it.

    ``probes`` has the chart keys and ``at``; ``series`` the chart keys, ``line``, x and y.
    A line with several points at one x answers with the smallest y.
    """
    chart = list(chart)

    def slice_by(x: Column) -> Column:
        return F.floor(F.unix_micros(x) / F.lit(1000000 * slice_seconds)).cast("bigint")

    timed = series.filter(F.col("x").isNotNull())
    near = _nearest_x(probes, timed, chart, "at", "nearest_x", slice_by)
    lines = timed.select(*chart, line).distinct()
    per_line = near.join(lines, chart)
    keys = [*chart, line]
    matched = _nearest_x(per_line, timed, keys, "nearest_x", "x", slice_by)
    values = timed.groupBy(*keys, "x").agg(F.min("y").alias("y"))
    return matched.join(values, [*keys, "x"]).select(*probes.columns, "nearest_x", line, "x", "y")
