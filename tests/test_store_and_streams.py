import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from verdictlake import schemas
from verdictlake.operators import metrics, retrieval
from verdictlake.plans import evaluation, history
from verdictlake.sources import export, scratch, store
from verdictlake.streaming import run_store, status, windows

T0 = datetime(2024, 1, 1)


def result(run_id, sample_id, model="m", text="answer", latency=1.0, flag=False):
    return (run_id, sample_id, "d", "p", "e", model, text, latency, 1, 2, 0.5, 0.25, 0.125, "neutral", 0.9, flag)


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "table")


def stored(spark, rows):
    return spark.createDataFrame(rows, schemas.STORED_RESULT)


def keys(df):
    return sorted((r.run_id, r.sample_id, r.response_text) for r in df.collect())


def test_replace_touches_only_the_saved_runs(spark, path):
    first = stored(spark, [result("r1", "a"), result("r1", "b"), result("2024-01-01", "a"), result("007", "a")])
    store.replace_results(first, first, path)
    again = stored(spark, [result("r1", "c", text="new")])
    store.replace_results(again, again, path)
    want = [("007", "a", "answer"), ("2024-01-01", "a", "answer"), ("r1", "c", "new")]
    assert keys(store.read_results(spark, path)) == want
    store.replace_results(again, again, path)
    assert keys(store.read_results(spark, path)) == want


def test_saving_a_run_empty_removes_its_answers(spark, path):
    rows = stored(spark, [result("r1", "a"), result("r2", "a")])
    store.replace_results(rows, rows, path)
    store.replace_results(rows.filter("run_id = 'r1'"), rows.limit(0), path)
    assert keys(store.read_results(spark, path)) == [("r2", "a", "answer")]
    store.replace_results(rows, rows, path)
    assert len(keys(store.read_results(spark, path))) == 2


def test_nothing_stored_yet(spark, path):
    assert store.read_results(spark, path).count() == 0
    assert store.read_runs(spark, path).count() == 0


def test_run_results_read_one_directory(spark, path, plan_of):
    rows = stored(spark, [result("r1", "b"), result("r1", "a"), result("r2", "a")])
    store.replace_results(rows, rows, path)
    one = retrieval.run_results(store.read_results(spark, path), "r1")
    assert [r.sample_id for r in one.collect()] == ["a", "b"]
    assert one.columns == schemas.STORED_COLUMNS and one.first().hallucination_flag is False
    assert "PartitionFilters: [isnotnull(run_id" in plan_of(one)
    assert retrieval.run_results(store.read_results(spark, path), "r9").count() == 0


def run(run_id, state, dataset="d", models=("m",), started=None, completed=None, error=None, seq=0):
    return (run_id, dataset, list(models), state, T0, started, completed, error, seq)


def saves(spark, rows):
    schema = "run_id string, dataset string, models array<string>, status string, created_at timestamp, " \
        "started_at timestamp, completed_at timestamp, error string, seq bigint"
    return spark.createDataFrame(rows, schema)


def test_upsert_keeps_what_was_first_saved(spark, path):
    store.save_runs(spark, saves(spark, [run("r1", "pending"), run("r2", "pending")]), path)
    later = [
        run("r1", "running", dataset="x", models=("n",), started=T0, seq=1),
        run("r1", "failed", dataset="y", started=T0, completed=T0, error="boom", seq=2),
        run("r3", "completed", dataset="first", seq=5),
        run("r3", "running", dataset="second", seq=6),
    ]
    store.save_runs(spark, saves(spark, later), path)
    got = {r.run_id: r for r in store.read_runs(spark, path).collect()}
    assert set(got) == {"r1", "r2", "r3"}
    assert (got["r1"].dataset, got["r1"].models, got["r1"].status, got["r1"].error) == ("d", ["m"], "failed", "boom")
    assert got["r2"].status == "pending" and got["r2"].started_at is None
    assert (got["r3"].dataset, got["r3"].status) == ("first", "running")
    # an error that is gone in a later save is gone
    store.save_runs(spark, saves(spark, [run("r1", "completed", seq=0)]), path)
    assert store.read_runs(spark, path).filter("run_id = 'r1'").first().error is None


def test_unknown_status_is_refused(spark, path):
    with pytest.raises(Exception, match="unknown run status: done"):
        store.save_runs(spark, saves(spark, [run("r1", "done")]), path)


def test_csv_round_trip(spark, path):
    texts = ['plain', 'a "quoted" word', "two\nlines", "comma, here", "  kept  ", "", 'ends with \\', "ünï"]
    rows = [
        (f"s{i}", "d", "p", "e", "m", t, 1.25, 1, 2, 0.0, 0.5, 0.25, 0.125, "neutral", 0.9, i % 2 == 0)
        for i, t in enumerate(texts)
    ]
    df = spark.createDataFrame(rows, schemas.RESULT)
    export.write_csv(df, path, one_file=True)
    assert len([f for f in os.listdir(path) if f.endswith(".csv")]) == 1
    back = export.read_csv(spark, path)
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    with open(next(os.path.join(path, f) for f in os.listdir(path) if f.endswith(".csv"))) as f:
        assert f.readline().strip() == ",".join(schemas.RESULT_COLUMNS)
    export.write_csv(df.repartition(3), path)
    assert export.read_csv(spark, path).count() == len(rows)


def test_scratch_uses_the_shared_folder(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    assert scratch.shared_dir(spark, "x").startswith(root)
    kept = scratch.saved(spark.range(5).toDF("a"), "x")
    assert kept.count() == 5 and kept.inputFiles()[0].startswith("file:")


# ---------------------------------------------------------------- streams

ARRIVING = "run_id string, sample_id string, model_name string, latency_ms double, rouge1 double, rougeL double, " \
    "hallucination_flag boolean, saved_seq bigint"


def arrival(run_id, sample_id, seq, latency, rouge=0.5):
    return (run_id, sample_id, "m", latency, rouge, rouge, False, seq)


def test_run_store_stream_merges_runs_split_over_batches(spark, tmp_path):
    landing, log, points, checkpoint = (str(tmp_path / n) for n in ("landing", "log", "points", "checkpoint"))
    runs = spark.createDataFrame(
        [(r, "d", T0) for r in ("r1", "r2")], "run_id string, dataset string, completed_at timestamp"
    )

    def arrive(rows):
        spark.createDataFrame(rows, ARRIVING).coalesce(1).write.mode("append").parquet(landing)
        run_store.stream_run_store(
            spark, landing, spark.read.parquet(landing).schema, log, points, checkpoint, files_per_batch=1
        ).awaitTermination()
        return {p.run_id: p for p in run_store.read_points(spark, points, runs).collect()}

    got = arrive([arrival("r1", "a", 1, 1.0), arrival("r2", "a", 1, 9.0)])
    assert got["r1"].latency_p50 == 1.0
    got = arrive([arrival("r1", "b", 1, 3.0)])
    assert (got["r1"].latency_p50, got["r2"].latency_p50) == (2.0, 9.0)
    # sent again with another value; an older save that arrives late changes nothing
    got = arrive([arrival("r1", "a", 2, 5.0), arrival("r1", "b", 0, 99.0)])
    assert got["r1"].latency_p50 == 4.0
    logged = spark.read.schema(ARRIVING + ", bucket int, batch bigint").parquet(log)
    want = metrics.metrics_timeseries(run_store.latest_answers(logged), runs)
    assert {p.run_id: p.latency_p50 for p in want.collect()} == {r: p.latency_p50 for r, p in got.items()}


def test_run_store_files_late_runs_and_compaction(spark, tmp_path):
    landing, log, points, checkpoint, log2, points2 = (str(tmp_path / n) for n in ("landing", "log", "points", "c", "log2", "points2"))
    rows = [arrival(f"r{i % 300}", f"s{i}", 1, float(i % 7)) for i in range(3000)]
    spark.createDataFrame(rows, ARRIVING).repartition(3).write.parquet(landing)
    schema = spark.read.parquet(landing).schema
    run_store.stream_run_store(spark, landing, schema, log, points, checkpoint, files_per_batch=3).awaitTermination()
    for place in (log, points):
        # Bounded by the buckets, not by tasks times runs.
        assert sum(1 for _ in (tmp_path / place).rglob("part-*.parquet")) <= store.RUN_BUCKETS
    few = spark.createDataFrame([("r1", "d", T0)], "run_id string, dataset string, completed_at timestamp")
    late = few.unionByName(spark.createDataFrame([("r2", "e", T0)], few.schema))
    changed = spark.createDataFrame([("r1", "d", T0 + timedelta(days=1))], few.schema)
    read = lambda runs, at=points: {(p.run_id, p.dataset, p.start_time) for p in run_store.read_points(spark, at, runs).collect()}
    assert read(few) == {("r1", "d", T0)} and len(read(late)) == 2
    assert read(changed) == {("r1", "d", T0 + timedelta(days=1))}
    run_store.compact(spark, log, points, schema, log2, points2)
    assert run_store.read_log(spark, log2, schema).count() == 3000
    order = lambda at: sorted(run_store.read_points(spark, at, late).collect())
    assert order(points2) == order(points)


def test_status_log_is_compacted(spark, tmp_path):
    landing, log, checkpoint, small = (str(tmp_path / n) for n in ("landing", "log", "checkpoint", "small"))
    events = [("r1", s, T0 + timedelta(minutes=k)) for k, s in enumerate(("pending", "running", "completed"))]
    for event in events:
        spark.createDataFrame([event], schemas.RUN_EVENT).coalesce(1).write.mode("append").parquet(landing)
    status.stream_run_status(spark, landing, log, checkpoint, files_per_batch=1).awaitTermination()
    status.compact_run_status(spark, log, small)
    assert spark.read.parquet(small).count() == 1
    assert status.read_run_status(spark, small).collect() == status.read_run_status(spark, log).collect()


def test_status_stream_equals_batch(spark, tmp_path):
    landing, log, checkpoint = (str(tmp_path / n) for n in ("landing", "log", "checkpoint"))
    events = [
        ("r1", "pending", T0), ("r1", "running", T0 + timedelta(minutes=1)), ("r1", "completed", T0 + timedelta(minutes=1)),
        ("r2", "pending", T0), ("r2", "failed", T0 + timedelta(hours=1)), ("r2", "running", T0 + timedelta(minutes=5)),
        ("r3", "pending", T0),
    ]
    df = spark.createDataFrame(events, schemas.RUN_EVENT)
    df.repartition(3).write.parquet(landing)
    status.stream_run_status(spark, landing, log, checkpoint, files_per_batch=1).awaitTermination()
    want = {"r1": "completed", "r2": "failed", "r3": "pending"}
    assert {r.run_id: r.status for r in status.read_run_status(spark, log).collect()} == want
    assert {r.run_id: r.status for r in status.run_status(df).collect()} == want


def test_daily_metrics_close_after_the_watermark(spark, tmp_path):
    landing, out, checkpoint = (str(tmp_path / n) for n in ("landing", "out", "checkpoint"))
    rows = [(T0 + timedelta(days=d, hours=h), "m", float(d), d == 1) for d in range(5) for h in (1, 23)]
    schema = "at timestamp, model_name string, latency_ms double, hallucination_flag boolean"
    df = spark.createDataFrame(rows, schema)
    df.coalesce(1).write.parquet(landing)
    stream = windows.stream_daily_metrics(spark.readStream.schema(df.schema).parquet(landing), out, checkpoint)
    stream.awaitTermination()
    got = {r.day.day: (r.answers, r.latency_mean, r.halluc_rate) for r in spark.read.parquet(out).collect()}
    # the last answer is at 23h of day 5, so days up to the 3rd are closed
    assert got == {1: (2, 0.0, 0.0), 2: (2, 1.0, 1.0), 3: (2, 2.0, 0.0)}
    assert windows.daily_metrics(df).count() == 5


# ---------------------------------------------------------------- whole jobs


def make_client():
    def ask(model, prompt, system):
        if model == "broken":
            raise ConnectionError("unreachable")
        return {"response_text": "the " + prompt, "latency_ms": 1.0, "input_tokens": 10, "output_tokens": 5}

    return ask


def load_classifier():
    import pandas as pd

    def classify(texts):
        bad = texts.str.contains("two").astype(float)
        return pd.DataFrame({"contradiction": bad * 5, "entailment": 1 - bad, "neutral": bad * 0})

    return classify


@pytest.fixture
def inputs(spark):
    samples = spark.createDataFrame(
        [("datasets/qa", "a.yaml", i, f"s{i}", w, "the " + w, "d") for i, w in enumerate(["one", "two", "three"])],
        "dataset string, file string, pos bigint, sample_id string, prompt string, expected string, domain string",
    )
    requests = spark.createDataFrame(
        [
            ("full", "qa", ["m1", "broken"], False, False),
            ("smoke", "datasets/qa", ["m1"], True, False),
            ("bad", "none", ["m1"], False, False),
        ],
        "run_id string, dataset string, models array<string>, smoke_test boolean, use_mlflow boolean",
    )
    return requests, samples.select(F.col("dataset").alias("path")), samples


def by_value(fn):
    import types

    return types.FunctionType(fn.__code__, {"__builtins__": __builtins__, "__name__": "__main__"}, fn.__name__)


def test_live_evaluation_end_to_end(spark, tmp_path, inputs):
    requests, catalog, samples = inputs
    done = evaluation.evaluate_live(requests, catalog, samples, by_value(make_client), by_value(load_classifier))
    assert [r.reject_reason for r in done.rejected.collect()] == ["dataset not found"]
    assert done.failed.count() == 3 and {r.reason for r in done.failed.collect()} == {"unreachable"}
    rows = done.results.collect()
    assert sorted((r.run_id, r.sample_id) for r in rows) == [
        ("full", "s0"), ("full", "s1"), ("full", "s2"), ("smoke", "s0"), ("smoke", "s1")
    ]
    assert {r.rouge1 for r in rows} == {1.0}
    assert {r.sample_id: r.hallucination_flag for r in rows} == {"s0": False, "s1": True, "s2": False}

    runs_path, results_path = str(tmp_path / "runs"), str(tmp_path / "results")
    finished = done.runs.select(
        "run_id", "dataset", "models", F.lit("completed").alias("status"), F.lit(T0).alias("created_at"),
        F.lit(T0).alias("started_at"), F.lit(T0 + timedelta(hours=1)).alias("completed_at"),
        F.lit(None).cast("string").alias("error"), F.lit(1).cast("bigint").alias("seq"),
    )
    evaluation.store(spark, done, finished, runs_path, results_path)
    points = history.stored_series(spark, runs_path, results_path, model="m1")
    assert [(p.run_id, p.halluc_rate, p.latency_p95) for p in points.collect()] == [("full", 0.3333, 1.0), ("smoke", 0.5, 1.0)]
    summary = metrics.run_summary(store.read_runs(spark, runs_path), store.read_results(spark, results_path))
    assert {r.run_id: r.sample_count for r in summary.collect()} == {"full": 3, "smoke": 2}
    runs = evaluation.finish_runs(done, requests.select("run_id", *[F.lit(T0).alias(c) for c in ("created_at", "started_at", "completed_at")]))
    assert {r.run_id: (r.status, r.error) for r in runs.collect()} == {
        "full": ("completed", None), "smoke": ("completed", None), "bad": ("failed", "dataset not found")
    }
    views = history.health(points)
    assert views["latency"].count() == 4 and views["hallucination"].count() == 2
    assert [r.drift for r in views["latest_drift"].collect()] == [False]


def test_captured_evaluation_agrees_with_live(spark, inputs):
    requests, catalog, samples = inputs
    live = evaluation.evaluate_live(requests, catalog, samples, by_value(make_client), by_value(load_classifier))
    replies = live.results.select("run_id", "sample_id", "model_name", "response_text", "latency_ms", "input_tokens", "output_tokens")
    scores = live.results.select(
        "run_id", "sample_id", "model_name",
        F.when(F.col("hallucination_flag"), 5.0).otherwise(0.0).alias("contradiction"),
        F.when(F.col("hallucination_flag"), 0.0).otherwise(1.0).alias("entailment"),
        F.lit(0.0).alias("neutral"),
    )
    captured = evaluation.evaluate_captured(requests, catalog, samples, scratch.saved(replies, "r"), scratch.saved(scores, "s"))
    order = ["run_id", "sample_id", "model_name"]
    assert captured.results.orderBy(order).collect() == live.results.orderBy(order).collect()
    assert captured.failed.count() == 3
    counts = evaluation.captured_counts(captured, samples, replies, scores)
    assert {r.run_id: (r.planned, r.results, r.failed) for r in counts.collect()} == {"full": (6, 3, 3), "smoke": (2, 2, 0)}


def test_run_outcomes_count_calls_without_listing_them(spark, tmp_path, plan_of):
    import __spark_entry__ as contract

    turns = [(c, t, r, f"text of {c} {t}") for c in range(40) for t, r in enumerate(("user", "assistant"))]
    rows = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    rows.write.parquet(str(tmp_path / "conversations.parquet"))
    out = contract.queries()["p1_run_outcomes"](spark, str(tmp_path))
    got = {r.run_id: (r.status, r.planned, r.results, r.failed) for r in out.collect()}
    # Runs 0 and 3 share a dataset of 16 samples, runs 1 and 2 have 12 each; run 0 has one model, run 1 no replies.
    answered = {r: sum((c * 7 + m * 5) % 23 != 0 for c in range(12 * r, min(12 * r + 12, 40)) for m in ([2] if r == 0 else range(4))) for r in range(4)}
    assert got == {
        "run_0000": ("completed", 16, answered[0], 16 - answered[0]),
        "run_0001": ("completed", 48, 0, 48),
        "run_0002": ("completed", 48, answered[2], 48 - answered[2]),
        "run_0003": ("completed", 64, answered[3], 64 - answered[3]),
        "run_none": ("failed", 0, 0, 0),
    }
    # A plan opens each run's list of models once for every sample of its dataset.
    assert "explode(models" not in plan_of(out)
