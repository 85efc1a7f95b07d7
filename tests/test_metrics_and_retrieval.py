from datetime import datetime

import pytest
from pyspark.sql import functions as F

from verdictlake.operators import metrics, retrieval

RESULT = (
    "run_id string, sample_id string, model_name string, latency_ms double, rouge1 double, rougeL double, "
    "hallucination_flag boolean"
)
RUN = "run_id string, dataset string, models array<string>, status string, created_at timestamp, completed_at timestamp"


@pytest.fixture
def results(spark):
    rows = [
        ("r1", "a", "m:1/x", 1.0, 0.5, 0.25, True),
        ("r1", "b", "m:1/x", 2.0, 0.5001, 0.5, False),
        ("r1", "c", "m:1/x", 4.0, 0.1, 0.125, False),
        ("r1", "d", "m:1/x", 10.01, 0.2, 0.0, False),
        ("r1", "a", "m2", 7.77, 1.0, 1.0, False),
        ("r2", "a", "m2", 3.0, 0.0, 0.0, True),
    ]
    return spark.createDataFrame(rows, RESULT)


@pytest.fixture
def runs(spark):
    rows = [
        ("r1", "legal", ["m:1/x", "m2"], "completed", datetime(2024, 1, 1), datetime(2024, 1, 1, 1)),
        ("r2", "code", ["m2"], "running", datetime(2024, 1, 2), None),
        ("r3", "code", ["m2"], "failed", datetime(2024, 1, 3), datetime(2024, 1, 3, 1)),
        ("r4", "code", ["m2"], "pending", datetime(2024, 1, 4), None),
    ]
    return spark.createDataFrame(rows, RUN)


def test_timeseries(results, runs):
    points = {(p.run_id, p.model_name): p for p in metrics.metrics_timeseries(results, runs).collect()}
    assert set(points) == {("r1", "m:1/x"), ("r1", "m2"), ("r2", "m2")}
    p = points["r1", "m:1/x"]
    assert (p.dataset, p.run_name, p.rouge1_mean, p.rougeL_mean, p.halluc_rate) == ("legal", None, 0.325, 0.2188, 0.25)
    # ranks 1.5 and 2.85 of 1, 2, 4, 10.01
    assert (p.latency_p50, p.latency_p95) == (3.0, 9.11)
    one = points["r1", "m2"]
    assert (one.latency_p50, one.latency_p95) == (7.77, 7.77)
    assert points["r2", "m2"].start_time is None


def test_timeseries_filters(results, runs):
    def keys(**chosen):
        return sorted((p.run_id, p.model_name) for p in metrics.filtered_timeseries(results, runs, **chosen).collect())

    everything = [("r1", "m2"), ("r1", "m:1/x"), ("r2", "m2")]
    assert keys() == keys(model="", dataset="") == everything
    assert keys(model="m2") == [("r1", "m2"), ("r2", "m2")]
    assert keys(model="m2", dataset="legal") == [("r1", "m2")]
    assert keys(model="nobody") == []


def test_last_points(results, runs):
    points = metrics.metrics_timeseries(results, runs)
    assert [(p.run_id, p.model_name) for p in metrics.last_points(points, 2).collect()] == [("r1", "m2"), ("r1", "m:1/x")]
    assert [p.run_id for p in metrics.last_points(points, 0).collect()] == ["r2", "r1", "r1"]
    assert metrics.last_points(points).count() == 3
    with pytest.raises(ValueError):
        metrics.last_points(points, -1)


def test_the_four_medians_stay_apart(results):
    m1 = F.col("model_name") == "m:1/x"
    assert metrics.model_aggregate(results).filter(m1).first().latency_p50 == 3.0
    assert metrics.model_aggregate(results).filter(m1).first().latency_p95 == 9.1085
    assert metrics.model_comparison(results).filter(m1).first().latency_p50 == 4.0
    assert metrics.model_means(results).filter(m1).first().latency_ms == 4.2525
    logged = metrics.experiment_metrics(results).filter(F.col("metric") == "m_1_x_latency_p95").first()
    assert (logged.run_id, logged.value) == ("r1", 9.11)


def test_empty_input_gives_empty_output(results, runs):
    none = results.limit(0)
    assert metrics.model_means(none).count() == 0
    assert metrics.experiment_metrics(none).count() == 0
    assert metrics.model_comparison(none).count() == 0
    assert {r.sample_count for r in metrics.run_summary(runs, none).collect()} == {0}


def test_percentile_choice_and_approximation(results):
    out = metrics.latency_percentiles(results, ["model_name"], [0, 100]).filter(F.col("model_name") == "m:1/x").first()
    assert (out.n, out.latency_p0, out.latency_p100) == (4, 1.0, 10.01)
    approx = metrics.approximate_latency_percentiles(results, ["model_name"]).filter(F.col("model_name") == "m:1/x").first()
    assert (approx.n, approx.latency_p50_approx) == (4, 2.0)


def test_run_summary_counts_answers(results, runs):
    assert {r.run_id: r.sample_count for r in metrics.run_summary(runs, results).collect()} == {
        "r1": 5, "r2": 1, "r3": 0, "r4": 0
    }


def test_experiment_params_count_samples_given(spark):
    plan = spark.createDataFrame(
        [("r", s, m) for s in ("a", "a", "b") for m in ("y", "x")], "run_id string, sample_id string, model_name string"
    )
    assert tuple(metrics.experiment_params(plan).first()) == ("r", 3, ["x", "y"])


def test_relative_score(spark):
    df = spark.createDataFrame([("r", "a", 0.5), ("r", "b", 0.25), ("z", "a", 0.0)], "run_id string, model string, rougeL double")
    assert {(r.run_id, r.model): r.relative_score for r in metrics.relative_score(df).collect()} == {
        ("r", "a"): 100.0, ("r", "b"): 50.0, ("z", "a"): 0.0
    }


def test_means_do_not_depend_on_partitioning(results, runs):
    once = metrics.metrics_timeseries(results, runs).orderBy("run_id", "model_name").collect()
    again = metrics.metrics_timeseries(results.repartition(7), runs).orderBy("run_id", "model_name").collect()
    assert once == again


def test_points_plan_has_no_product(results, runs, plan_of):
    points = metrics.metrics_timeseries(results, runs)
    points.collect()
    plan = plan_of(points)
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_filters(results):
    assert retrieval.filter_results(results).count() == 6
    assert retrieval.filter_results(results, "m2", retrieval.HALLUCINATED).count() == 1
    assert retrieval.filter_results(results, failure=retrieval.CLEAN).count() == 4
    with pytest.raises(ValueError):
        retrieval.filter_results(results, failure="other")
    assert [r[0] for r in retrieval.distinct_models(results).collect()] == ["m2", "m:1/x"]
    assert retrieval.failure_count(results).first()[0] == 2
    assert retrieval.failure_count(results.limit(0)).first()[0] == 0


def test_ready_results_and_availability(spark, results, runs):
    assert {r.run_id for r in retrieval.ready_results(results, runs).collect()} == {"r1"}
    asked = spark.createDataFrame([("r1",), ("r2",), ("r3",), ("r4",), ("r9",)], "run_id string")
    assert {r.run_id: r.outcome for r in retrieval.result_availability(asked, runs).collect()} == {
        "r1": "ready", "r2": "not_ready", "r3": "ready", "r4": "not_ready", "r9": "unknown"
    }
    assert [r.run_id for r in retrieval.multi_model_runs(runs).collect()] == ["r1"]


def test_recent_runs(spark):
    rows = [(f"r{i % 25}", f"d{i}", ["m"], datetime(2024, 1, 1), i) for i in range(60)]
    seen = spark.createDataFrame(
        rows, "run_id string, dataset string, models array<string>, created_at timestamp, seen_at int"
    )
    got = [(r.run_id, r.dataset) for r in retrieval.recent_runs(seen).collect()]
    assert len(got) == 20 and got[0] == ("r9", "d59") and got[-1] == ("r15", "d40")


def test_results_table_rounds_half_up(spark):
    df = spark.createDataFrame(
        [("s", "m", 0.1235, False, 12.5, "x"), ("s", "m", 0.1234, True, 12.49, "x")],
        "sample_id string, model_name string, rougeL double, hallucination_flag boolean, latency_ms double, "
        "response_text string",
    )
    got = [(r["ROUGE-L"], r["Hallucination"], r["Latency (ms)"]) for r in retrieval.results_table(df).collect()]
    assert got == [(0.124, "clean", 13), (0.123, "flagged", 12)]


def test_a_group_without_latencies_keeps_its_point(spark):
    rows = [("r", "m", 0.5, 0.25, None, True), ("r", "m", 0.7, 0.25, None, False), ("r", "n", 0.1, 0.1, 3.0, False)]
    results = spark.createDataFrame(rows, "run_id string, model_name string, rouge1 double, rougeL double, latency_ms double, hallucination_flag boolean")
    got = {r.model_name: r for r in metrics.run_model_points(results).collect()}
    assert (got["m"].rouge1_mean, got["m"].halluc_rate, got["m"].latency_p50, got["m"].latency_p95) == (0.6, 0.5, 0.0, 0.0)
    assert got["n"].latency_p50 == 3.0
