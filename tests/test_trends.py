import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from verdictlake.operators import trends

T0 = datetime(2024, 1, 1)
POINT = "run_id string, model_name string, dataset string, start_time timestamp, rougeL_mean double"


def points(spark, values, model="m", step=timedelta(days=9)):
    rows = [(f"r{i:03d}", model, "d", T0 + i * step, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, POINT)


def drifted(df, **kw):
    return [(r.run_id, r.drift) for r in trends.accuracy_drift(df, **kw).orderBy("run_id").collect()]


def test_drift_needs_five_runs_and_a_strict_loss(spark):
    flags = [f for _, f in drifted(points(spark, [0.4, 0.4, 0.4, 0.4, 0.1, 0.289]))]
    assert flags == [False, False, False, False, False, False]  # threshold 0.85 * 0.34 = 0.289
    flags = [f for _, f in drifted(points(spark, [0.4, 0.4, 0.4, 0.4, 0.1, 0.2889]))]
    assert flags[-1] is True
    assert [f for _, f in drifted(points(spark, [0.9] * 5 + [0.0], model="x"))][-1] is True


def test_drift_threshold_and_ties(spark):
    same_time = points(spark, [0.5, 0.5, 0.5, 0.5, 0.5, 0.4], step=timedelta(0))
    rows = {r.run_id: r for r in trends.accuracy_drift(same_time).collect()}
    assert (rows["r005"].threshold, rows["r005"].runs_before, rows["r005"].drift) == (0.425, 5, True)
    assert rows["r004"].threshold is None


def test_drift_does_not_depend_on_slices(spark):
    rng = random.Random(1)
    values = [round(rng.random(), 4) for _ in range(80)]
    df = points(spark, values).union(points(spark, values[::-1], model="other"))
    want = []
    for i, v in enumerate(values):
        prior = [round(p * 10000) for p in values[max(0, i - 5) : i]]
        want.append((f"r{i:03d}", len(prior) == 5 and round(v * 10000) * 500 < sum(prior) * 85))
    for days in (1, 30, 10000):
        assert drifted(df.filter("model_name = 'm'"), slice_days=days) == want
    latest = trends.latest_drift(trends.accuracy_drift(df)).collect()
    assert sorted((r.model_name, r.run_id) for r in latest) == [("m", "r079"), ("other", "r079")]


def test_runs_without_a_time_have_no_place(spark):
    df = points(spark, [0.5] * 3).union(
        spark.createDataFrame([("open", "m", "d", None, 0.1)], POINT)
    )
    assert [r for r, _ in drifted(df)] == ["r000", "r001", "r002"]


SERIES = "run_id string, x timestamp, y double"


def extent(spark, rows, **kw):
    row = trends.series_extent(spark.createDataFrame([("r", x, y) for x, y in rows], SERIES), **kw).first()
    return (row.x_min, row.x_max, row.y_min, row.y_max)


def test_series_extent(spark):
    ms = T0.timestamp() * 1000
    two = [(T0, 10.0), (T0 + timedelta(seconds=1), 20.0)]
    assert extent(spark, two) == (ms, ms + 1000, 8.5, 21.5)
    assert extent(spark, two, reference_y=30.0) == (ms, ms + 1000, 7.0, 33.0)
    assert extent(spark, [(T0, 5.0)]) == (ms, ms, 4.5, 5.5)
    assert extent(spark, [(T0, 0.0)]) == (ms, ms, 0.0, 0.1)
    assert extent(spark, []) == (0.0, 1.0, 0.0, 1.15)
    assert extent(spark, two, y_min=1, y_max=2)[2:] == (1.0, 2.0)


def test_latest_point(spark):
    df = spark.createDataFrame([("b", T0, 1.0), ("c", T0, 2.0), ("a", T0 - timedelta(1), 3.0), ("z", None, 9.0)], SERIES)
    row = trends.latest_point(df.withColumn("k", F.lit(1)), ["k"]).first()
    assert (row.run_id, row.y) == ("c", 2.0)


@pytest.mark.parametrize("slice_seconds", [1, 60, 86400])
def test_nearest_points_against_brute_force(spark, slice_seconds):
    rng = random.Random(slice_seconds)

    def moment():
        return T0 + timedelta(seconds=rng.randrange(4000))

    marks = {}
    for chart in ("c1", "c2"):
        for line in ("p50", "p95"):
            for _ in range(25):
                marks[chart, line, moment()] = round(rng.random(), 3)
    series = spark.createDataFrame([(*k, v) for k, v in marks.items()], "chart string, series string, x timestamp, y double")
    asked = [(i, rng.choice(["c1", "c1", "c2"]), moment()) for i in range(120)]
    probes = spark.createDataFrame(asked, "i int, chart string, at timestamp")
    out = trends.nearest_points(probes, series, ["chart"], slice_seconds=slice_seconds)
    got = {(r.i, r.series): (r.nearest_x, r.x, r.y) for r in out.collect()}
    want = {}
    for i, chart, at in asked:
        xs = [x for c, _, x in marks if c == chart]
        near = min(xs, key=lambda x: (abs(x - at), x))
        for line in ("p50", "p95"):
            on_line = [x for c, s, x in marks if c == chart and s == line]
            x = min(on_line, key=lambda x: (abs(x - near), x))
            want[i, line] = (near, x, marks[chart, line, x])
    assert got == want


def test_chart_without_points_answers_nothing(spark):
    probes = spark.createDataFrame([("c", T0)], "chart string, at timestamp")
    series = spark.createDataFrame([], "chart string, series string, x timestamp, y double")
    assert trends.nearest_points(probes, series, ["chart"]).count() == 0


def test_health_sees_drift_in_every_series(spark):
    from datetime import datetime, timedelta

    from verdictlake import schemas
    from verdictlake.plans import history

    start = datetime(2024, 1, 1)
    rows = [
        (f"r{s}_{k}", None, "d", f"m{s}", start + timedelta(days=k), 0.5, 0.5 if k < 9 else 0.2, 0.0, 1.0, 2.0)
        for s in range(30)
        for k in range(10)
    ]
    drift = history.health(spark.createDataFrame(rows, schemas.POINT))["latest_drift"]
    assert drift.filter("drift").count() == 30
