"""Every operator wired to the derived tables."""

from __future__ import annotations

import builtins
import tempfile
import types
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks import derived as d
from verdictlake import schemas
from verdictlake.functions import nli, rouge, text
from verdictlake.operators import ingest, metrics, planning, retrieval, scoring, trends
from verdictlake.plans import evaluation, history
from verdictlake.sources import export, scratch, store, suites
from verdictlake.streaming import run_store, status, windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: flat(fn(ready(spark), sf_dir))
        return fn

    return register


def _by_value(fn):
    """A copy of a self-contained function that travels to the tasks with its code."""
    return types.FunctionType(fn.__code__, {"__builtins__": builtins, "__name__": "__main__"}, fn.__name__)


def ready(spark: SparkSession) -> SparkSession:
    """A local session without a shared folder gets one; on a cluster it must be set."""
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.master.startswith("local["):
        spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="verdictlake-"))
    return spark


def spread(df: DataFrame) -> DataFrame:
    """The test tables are single row groups, read by one task; per-row work is dealt over all cores."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def flat(df: DataFrame) -> DataFrame:
    """Lists as text and times without a zone, which compare the same way everywhere."""
    columns = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.ArrayType):
            column = F.array_join(column, "+")
        elif isinstance(field.dataType, T.TimestampType):
            column = column.cast("timestamp_ntz")
        columns.append(column.alias(field.name))
    return df.select(*columns)


# ---------------------------------------------------------------- aggregates


@query("d1_metrics_timeseries")
def _(spark, sf):
    return metrics.metrics_timeseries(d.event_results(spark, sf), d.event_runs(spark, sf))


@query("d1_metrics_timeseries_lineitem")
def _(spark, sf):
    return metrics.metrics_timeseries(spread(d.lineitem_results(spark, sf)), d.lineitem_runs(spark, sf))


@query("d1_metrics_timeseries_runs")
def _(spark, sf):
    return metrics.metrics_timeseries(d.results(spark, sf), d.runs(spark, sf))


@query("d2_timeseries_filtered")
def _(spark, sf):
    return metrics.filtered_timeseries(
        d.results(spark, sf), d.runs(spark, sf), model="gamma", dataset="datasets/legal_qa"
    )


@query("d3_timeseries_last_n")
def _(spark, sf):
    return metrics.last_points(metrics.metrics_timeseries(d.results(spark, sf), d.runs(spark, sf)), 10)


@query("d4_latency_percentile")
def _(spark, sf):
    return metrics.latency_percentiles(d.event_results(spark, sf), ["model_name"])


@query("d4_latency_percentile_lineitem")
def _(spark, sf):
    return metrics.latency_percentiles(spread(d.lineitem_results(spark, sf)), ["model_name"])


@query("d4_latency_percentile_approx")
def _(spark, sf):
    return metrics.approximate_latency_percentiles(d.lineitem_results(spark, sf), ["model_name"])


@query("d4_latency_sketches")
def _(spark, sf):
    """Percentiles per model from stored sketches per run; whether their ranks are within 1% of the answers."""
    results = d.lineitem_results(spark, sf)
    stored = scratch.saved(metrics.latency_sketches(results), "sketches")
    told = metrics.sketched_percentiles(stored, ["model_name"])
    latency = F.col("latency_ms")

    def close(pct: int):
        value = F.col(f"latency_p{pct}_approx")
        below, upto = F.count(F.when(latency < value, 1)), F.count(F.when(latency <= value, 1))
        return ((below <= F.col("n") * ((pct + 1) / 100)) & (upto >= F.col("n") * ((pct - 1) / 100))).alias(f"p{pct}_close")

    return results.join(told, "model_name").groupBy("model_name", "n").agg(close(50), close(95))


@query("d5_model_aggregate")
def _(spark, sf):
    return metrics.model_aggregate(d.event_results(spark, sf))


@query("d6_cli_summary")
def _(spark, sf):
    return metrics.model_means(d.event_results(spark, sf))


@query("d7_model_comparison")
def _(spark, sf):
    return metrics.model_comparison(d.event_results(spark, sf))


@query("d8_experiment_metrics")
def _(spark, sf):
    return metrics.experiment_metrics(d.results(spark, sf))


@query("d9_experiment_params")
def _(spark, sf):
    return metrics.experiment_params(d.planned(spark, sf))


@query("d10_run_summary")
def _(spark, sf):
    return metrics.run_summary(d.runs(spark, sf), d.results(spark, sf))


@query("d11_relative_score")
def _(spark, sf):
    compared = metrics.model_comparison(d.results(spark, sf), ["run_id", "model_name"])
    return metrics.relative_score(compared)


# ---------------------------------------------------------------- sources, sinks, ingest

SAMPLE_COLUMNS = ["sample_id", "prompt", "expected", "domain", "tags", "difficulty"]


@query("a1_suite_ingest")
def _(spark, sf):
    """One file per sample pair, holding the sample, its reverse and an item without a prompt."""
    s = d.samples(spark, sf)
    item = F.to_json(F.struct(F.col("sample_id").alias("id"), "prompt", "expected", "domain", "tags", "difficulty"))
    reverse = F.to_json(
        F.struct(
            F.concat("sample_id", F.lit("_r")).alias("id"),
            F.col("expected").alias("prompt"),
            F.col("prompt").alias("expected"),
        )
    )
    broken = F.to_json(F.struct(F.concat("sample_id", F.lit("_b")).alias("id"), "expected"))
    files = s.select(
        F.concat("sample_id", F.lit(".yaml")).alias("file"),
        F.concat(F.lit("["), F.concat_ws(",\n ", item, reverse, broken), F.lit("]")).alias("text"),
    )
    return suites.parse_suites(files)


@query("a1_suite_files")
def _(spark, sf):
    """Suites written as YAML files, one folder a dataset, and read from the files."""
    path = scratch.shared_dir(spark, "suites")
    s = d.samples(spark, sf)
    suites.write_suites(s.withColumn("name", F.element_at(F.split("dataset", "/"), -1)), path, "name", ["pos"])
    return suites.load_suites(spark, path).filter(~F.col("dataset").endswith(".yaml")).select("dataset", *SAMPLE_COLUMNS)


@query("a2_suite_defaults")
def _(spark, sf):
    c = F.col("c")
    sparse = d.samples(spark, sf).select(
        "sample_id",
        "prompt",
        "expected",
        F.when(c % 2 == 0, F.col("domain")).alias("domain"),
        F.when(c % 3 != 0, F.col("tags")).alias("tags"),
        F.when(c % 5 != 0, F.col("difficulty")).alias("difficulty"),
    )
    return ingest.suite_defaults(sparse)


def _requests(spark, sf):
    """One request per conversation that starts with a user turn."""
    c = F.col("conv_id")
    name = d.pick(DATASET_SPELLINGS, c % 7)
    models = F.slice(F.array(*[F.lit(m) for m in d.MODELS]), F.lit(1), (c % 4).cast("int"))
    return d.table(spark, sf, "conversations").filter("role = 'user'").select(
        F.concat_ws("_", F.lit("rq"), c, F.col("turn")).alias("request_id"),
        name.alias("dataset"),
        models.alias("models"),
        F.when(c % 3 != 0, c % 3 == 1).alias("smoke_test"),
        F.when(c % 5 != 0, c % 5 == 1).alias("use_mlflow"),
    )


DATASET_SPELLINGS = [
    "legal_qa",
    "datasets/code_gen",
    "datasets\\summarization",
    "nowhere",
    "./legal_qa/",
    "datasets//code_gen",
    "",
]


def _catalog(spark, sf):
    return d.samples(spark, sf).select(F.col("dataset").alias("path"))


@query("a3_dataset_resolve")
def _(spark, sf):
    return ingest.resolve_datasets(_requests(spark, sf), _catalog(spark, sf)).select(
        "request_id", "dataset", "dataset_path"
    )


@query("a4_run_request_validation")
def _(spark, sf):
    return ingest.validate_requests(_requests(spark, sf), _catalog(spark, sf))


@query("a5_smoke_limit")
def _(spark, sf):
    return ingest.smoke_limit(d.samples(spark, sf)).select("dataset", "file", "pos", "sample_id")


def _model_catalog(spark, sf):
    live = d.responses(spark, sf).select(F.col("model_name").alias("name"))
    known = spark.createDataFrame([(m,) for m in d.KNOWN_MODELS], "name string")
    return ingest.model_catalog(live, known)


@query("a6_model_catalog")
def _(spark, sf):
    return _model_catalog(spark, sf)


@query("a6_default_model")
def _(spark, sf):
    return ingest.default_model(_model_catalog(spark, sf))


@query("a7_suite_append")
def _(spark, sf):
    s = d.samples(spark, sf).select("pos", *SAMPLE_COLUMNS)
    new = s.filter(F.col("difficulty") == "hard").withColumn("prompt", F.concat(F.lit("Again: "), "prompt"))
    out = ingest.append_generated(s, new, ["pos"])
    return out.drop("pos")


@query("a7_generated_suite")
def _(spark, sf):
    """Fenced replies stripped, parsed, numbered after the suite they extend, written with it and read again."""
    s = d.samples(spark, sf)
    item = F.struct(F.lit("new").alias("id"), F.concat(F.lit("Again: "), "prompt").alias("prompt"), "expected", "domain", "tags", "difficulty")
    reply = F.concat(F.lit("```yaml\n["), F.to_json(item), F.lit("]\n```"))
    replies = s.filter("difficulty = 'hard'").select(
        F.format_string("%018d", "pos").alias("file"), text.strip_fences(reply).alias("text")
    )
    new = suites.good_items(suites.parse_suites(replies)).withColumnRenamed("pos", "place")
    both = ingest.append_generated(s.select(*SAMPLE_COLUMNS), scratch.saved(new, "generated"), ["file", "place"])
    path = scratch.shared_dir(spark, "suites")
    suites.write_suites(both, path, "domain", ["sample_id"])
    return suites.load_suites(spark, path).filter(~F.col("dataset").endswith(".yaml")).select(*SAMPLE_COLUMNS)


@query("a8_fence_strip")
def _(spark, sf):
    i = F.col("doc_id")
    tag = d.pick(["```yaml", "```", "```json", " \n```yaml"], i % 4)
    fenced = F.concat(tag, F.lit("\n"), F.col("text"), F.lit("\n```\t\n"))
    return d.table(spark, sf, "documents").select("doc_id", text.strip_fences(fenced).alias("text"))


@query("a9_results_csv_sink")
def _(spark, sf):
    path = scratch.shared_dir(spark, "csv")
    export.write_csv(d.results(spark, sf), path)
    return export.read_csv(spark, path)


@query("a10_run_upsert")
def _(spark, sf):
    """Every run saved three times; later saves also name another dataset."""
    path = scratch.shared_dir(spark, "runs")
    runs = d.runs(spark, sf)
    names = [f.name for f in schemas.RUN]
    first = runs.withColumns(
        {
            "status": F.lit("pending"),
            "started_at": F.lit(None).cast("timestamp"),
            "completed_at": F.lit(None).cast("timestamp"),
            "error": F.lit(None).cast("string"),
            "seq": F.lit(0),
        }
    )
    store.save_runs(spark, first, path)
    later = runs.withColumns({"dataset": F.lit("datasets/other"), "models": F.array(F.lit("other"))})
    both = later.withColumns({"status": F.lit("running"), "seq": F.lit(1)}).unionByName(
        later.withColumn("seq", F.lit(2))
    )
    store.save_runs(spark, both, path)
    return store.read_runs(spark, path).select(*names)


@query("a11_results_replace")
def _(spark, sf):
    """All runs stored; then every third run saved again without its first model, and every seventh empty."""
    path = scratch.shared_dir(spark, "results")
    results = scratch.saved(d.results(spark, sf), "scored")
    number = F.substring("run_id", 5, 4).cast("int")
    store.replace_results(results, results, path)
    again = results.filter((number % 3 == 0) & (number % 7 != 0) & (F.col("model_name") != "alpha:8b"))
    resaved = d.runs(spark, sf).filter((number % 3 == 0) | (number % 7 == 0)).select("run_id")
    store.replace_results(resaved, again, path)
    return store.read_results(spark, path)


@query("a12_adhoc_samples")
def _(spark, sf):
    s = d.samples(spark, sf)
    given = s.select(
        "pos",
        F.when(F.col("c") % 7 == 0, "").otherwise(F.col("prompt")).alias("prompt"),
        F.when(F.col("t") == 4, None).otherwise(F.col("expected")).alias("expected"),
    )
    return ingest.adhoc_samples(given, ["pos"])


# ---------------------------------------------------------------- plan and joins


@query("b1_eval_plan")
def _(spark, sf):
    """Two runs per dataset, one of them a smoke test."""
    s = d.samples(spark, sf).select("dataset", "file", "pos", "sample_id")
    kinds = F.explode(F.array(F.lit(False), F.lit(True)))
    requests = (
        s.select("dataset")
        .distinct()
        .select(
            "dataset", kinds.alias("smoke_test"), F.array(*[F.lit(m) for m in d.MODELS]).alias("models")
        )
        .withColumn("run_id", F.concat_ws("#", "dataset", F.col("smoke_test").cast("string")))
    )
    return planning.eval_plan(s, requests)


def _plan(spark, sf):
    return d.planned(spark, sf).select("run_id", *SAMPLE_COLUMNS[:4], "model_name")


@query("b2_response_attach")
def _(spark, sf):
    return planning.attach_responses(_plan(spark, sf), d.responses(spark, sf))


@query("b2_duplicate_ids")
def _(spark, sf):
    """Every call is planned twice and has two replies, which differ."""
    plan, replies = _plan(spark, sf), d.responses(spark, sf)
    again = replies.withColumn("response_text", F.concat("response_text", F.lit(" again")))
    return planning.attach_responses(plan.unionByName(plan), replies.unionByName(again))


@query("b3_duplicate_ids")
def _(spark, sf):
    """Every call is planned twice and has one reply."""
    plan = _plan(spark, sf)
    return planning.failed_calls(plan.unionByName(plan), d.responses(spark, sf)).select("run_id", "sample_id", "model_name")


@query("b2_answers")
def _(spark, sf):
    s = d.samples(spark, sf).select("dataset", "file", "pos", *SAMPLE_COLUMNS[:4])
    out = planning.answers(s, d.runs(spark, sf), d.responses(spark, sf))
    return out.drop("dataset", "file", "pos")


@query("b3_failed_calls")
def _(spark, sf):
    return planning.failed_calls(_plan(spark, sf), d.responses(spark, sf)).select(
        "run_id", "sample_id", "model_name"
    )


@query("b3_failure_reasons")
def _(spark, sf):
    """Raw replies, some without content, and class scores that lack every 29th call."""
    raw = d.responses(spark, sf)
    parsed = planning.parse_replies(raw.drop("response_text", "input_tokens", "output_tokens"))
    number = F.regexp_extract("sample_id", r"cv_(\d+)_", 1).cast("long")
    scores = d.logits(spark, sf).filter(number % 29 != 0)
    return scoring.failures(_plan(spark, sf), parsed, scores)


@query("b3_call_coverage")
def _(spark, sf):
    return planning.call_coverage(_plan(spark, sf), d.responses(spark, sf))


def _echo_client():
    """A stand-in model: fixed latency and token counts, fails on long prompts."""

    def ask(model, prompt, system):
        if len(prompt) > 200:
            raise RuntimeError("prompt too long")
        return {
            "response_text": f"{model}: {prompt}",
            "latency_ms": 1.0,
            "input_tokens": 10,
            "output_tokens": 5,
        }

    return ask


@query("b4_batch_generate")
def _(spark, sf):
    make_client = _by_value(_echo_client)
    return planning.batch_generate(spread(_plan(spark, sf)), make_client).select(
        "run_id", "sample_id", "model_name", "response_text", "latency_ms", "input_tokens", "output_tokens", "error"
    )


@query("b5_chat_messages")
def _(spark, sf):
    systems = d.table(spark, sf, "conversations").filter("role = 'system'").select(
        F.col("conv_id").alias("c"), F.col("text").alias("system_prompt")
    )
    s = d.samples(spark, sf).join(systems, "c", "left")
    messages = planning.chat_messages(F.col("prompt"), F.col("system_prompt"))
    return s.select("sample_id", F.posexplode(messages).alias("place", "m")).select("sample_id", "place", "m.*")


@query("b6_reply_parse")
def _(spark, sf):
    raw = d.responses(spark, sf).select("run_id", "sample_id", "model_name", "raw")
    return planning.parse_replies(raw).drop("raw")


@query("b7_latency_ms")
def _(spark, sf):
    return d.responses(spark, sf).select(
        "run_id",
        "sample_id",
        "model_name",
        planning.elapsed_ms(F.col("started_at"), F.col("ended_at")).alias("latency_ms"),
    )


# ---------------------------------------------------------------- scoring


@query("c1_rouge_tokens")
def _(spark, sf):
    return d.table(spark, sf, "documents").select(
        "doc_id", F.array_join(rouge.tokens(F.col("text")), " ").alias("tokens")
    )


@query("c2_rouge1")
def _(spark, sf):
    return rouge.with_rouge(spread(d.responses(spark, sf)), scores=["rouge1"]).select(
        "run_id", "sample_id", "model_name", "rouge1"
    )


@query("c3_rouge2")
def _(spark, sf):
    return rouge.with_rouge(spread(d.responses(spark, sf)), scores=["rouge2"]).select(
        "run_id", "sample_id", "model_name", "rouge2"
    )


@query("c2_c3_rouge_documents")
def _(spark, sf):
    return rouge.with_rouge(spread(d.document_pairs(spark, sf)), scores=["rouge1", "rouge2"]).select(
        "doc_id", "rouge1", "rouge2"
    )


@query("c4_rougel")
def _(spark, sf):
    return rouge.with_rouge(d.benchmark_pairs(spark, sf), scores=["rougeL"]).select("i", "m", "rougeL")


@query("c4_rougel_documents")
def _(spark, sf):
    return rouge.with_rouge(spread(d.document_pairs(spark, sf)), scores=["rougeL"]).select("doc_id", "rougeL")


@query("c5_nli_pairs")
def _(spark, sf):
    return d.responses(spark, sf).select(
        "run_id",
        "sample_id",
        "model_name",
        nli.pair_text(F.col("expected"), F.col("response_text")).alias("pair"),
    )


def _verdicts(spark, sf):
    return nli.with_verdict(d.logits(spark, sf))


@query("c6_nli_decide")
def _(spark, sf):
    return _verdicts(spark, sf).select("run_id", "sample_id", "model_name", "nli_label", "nli_confidence")


@query("c7_hallucination_flag")
def _(spark, sf):
    return _verdicts(spark, sf).select("run_id", "sample_id", "model_name", "hallucination_flag")


def _length_classifier():
    """A stand-in classifier: scores from the length of the pair text."""
    import pandas as pd

    def classify(texts):
        n = texts.str.len()
        return pd.DataFrame(
            {"contradiction": n % 7 / 2.0, "entailment": n % 5 / 2.0, "neutral": n % 3 / 2.0}
        )

    return classify


@query("c8_nli_infer")
def _(spark, sf):
    pairs = d.responses(spark, sf).select("run_id", "sample_id", "model_name", "expected", "response_text")
    pair = nli.pair_text(F.col("expected"), F.col("response_text"))
    scored = nli.with_class_scores(spread(pairs), _by_value(_length_classifier), pair)
    return scored.drop("expected", "response_text", "score_error")


@query("c9_score_results")
def _(spark, sf):
    """The benchmark pairs as answers of one run per variant."""
    i, m = F.col("i"), F.col("m")
    keyed = d.benchmark_pairs(spark, sf).select(
        F.concat(F.lit("run_"), m.cast("string")).alias("run_id"),
        F.concat(F.lit("bm_"), i.cast("string")).alias("sample_id"),
        F.lit("gamma").alias("model_name"),
        "expected",
        "response_text",
        "i",
        "m",
    )
    plan = keyed.select(
        "run_id", "sample_id", "model_name", F.lit("benchmark").alias("domain"), F.lit("Repeat.").alias("prompt"), "expected"
    )
    replies = keyed.select(
        "run_id",
        "sample_id",
        "model_name",
        "response_text",
        ((i * 31 + m) / 100.0).alias("latency_ms"),
        F.when(i % 2 == 0, i.cast("int")).alias("input_tokens"),
        m.alias("output_tokens"),
    )
    scores = keyed.select(
        "run_id",
        "sample_id",
        "model_name",
        ((i * 31 + m * 13) % 97 / 10.0).alias("contradiction"),
        ((i * 17 + m * 7) % 89 / 10.0).alias("entailment"),
        ((i * 13 + m * 19) % 83 / 10.0).alias("neutral"),
    )
    return scoring.score_with_logits(planning.attach_responses(plan, replies), scores)


@query("c9_score_responses")
def _(spark, sf):
    answers = spread(planning.attach_responses(_plan(spark, sf), d.responses(spark, sf)))
    return scoring.score_with_logits(answers, d.logits(spark, sf))


# ---------------------------------------------------------------- retrieval

ONE_RUN = "run_0001"


@query("e1_run_results")
def _(spark, sf):
    return retrieval.run_results(d.results(spark, sf), ONE_RUN)


@query("e2_results_filter")
def _(spark, sf):
    return retrieval.filter_results(d.results(spark, sf), model="gamma", failure=retrieval.CLEAN)


@query("e3_distinct_models")
def _(spark, sf):
    return retrieval.distinct_models(d.results(spark, sf))


@query("e4_failure_cases")
def _(spark, sf):
    return retrieval.failure_cases(d.results(spark, sf))


@query("e4_failure_count")
def _(spark, sf):
    return retrieval.failure_count(d.results(spark, sf))


@query("e5_multi_model_runs")
def _(spark, sf):
    return retrieval.multi_model_runs(d.runs(spark, sf))


@query("e6_results_ready")
def _(spark, sf):
    return retrieval.ready_results(d.results(spark, sf), d.runs(spark, sf)).select(
        "run_id", "sample_id", "model_name", "rougeL"
    )


@query("e6_result_availability")
def _(spark, sf):
    """Asked for by every conversation: its own run, or one that does not exist."""
    c = F.col("conv_id")
    number = F.when(c % 9 == 0, c + 100000).otherwise(F.floor(c / 12))
    requested = d.table(spark, sf, "conversations").select("conv_id", "turn", d.run_name(number).alias("run_id"))
    return retrieval.result_availability(requested, d.runs(spark, sf)).drop("status")


@query("e7_recent_runs")
def _(spark, sf):
    """Each run seen when created and again, under another dataset, when completed."""
    runs = d.runs(spark, sf).select("run_id", "dataset", "models", "created_at", "completed_at")
    seen = runs.withColumn("seen_at", F.col("created_at")).unionByName(
        runs.filter("completed_at IS NOT NULL").withColumns(
            {"seen_at": F.col("completed_at"), "dataset": F.concat("dataset", F.lit("/seen"))}
        )
    )
    return retrieval.recent_runs(seen.drop("completed_at"))


@query("e8_score_projection")
def _(spark, sf):
    return retrieval.score_table(d.results(spark, sf))


@query("e8_results_table")
def _(spark, sf):
    return retrieval.results_table(d.results(spark, sf))


# ---------------------------------------------------------------- trends


def _event_points(spark, sf):
    points = metrics.metrics_timeseries(d.event_results(spark, sf), d.event_runs(spark, sf))
    return scratch.saved(points, "points")


def _lineitem_points(spark, sf):
    points = metrics.metrics_timeseries(spread(d.lineitem_results(spark, sf)), d.lineitem_runs(spark, sf))
    return scratch.saved(points, "points")


@query("f1_accuracy_drift")
def _(spark, sf):
    return trends.accuracy_drift(_event_points(spark, sf))


@query("f1_accuracy_drift_lineitem")
def _(spark, sf):
    return trends.accuracy_drift(_lineitem_points(spark, sf))


@query("f1_latest_drift")
def _(spark, sf):
    return trends.latest_drift(trends.accuracy_drift(_event_points(spark, sf)))


@query("f2_latency_trend")
def _(spark, sf):
    return trends.latency_trend(_event_points(spark, sf))


@query("f3_halluc_trend")
def _(spark, sf):
    return trends.halluc_trend(_event_points(spark, sf))


@query("f4_latest_point")
def _(spark, sf):
    return trends.latest_point(trends.latency_trend(_event_points(spark, sf)), ["model_name", "series"])


@query("f5_series_extent")
def _(spark, sf):
    return trends.series_extent(trends.latency_trend(_event_points(spark, sf)), ["model_name"])


@query("f5_drift_chart_extent")
def _(spark, sf):
    points = _event_points(spark, sf).select(F.col("start_time").alias("x"), F.col("rougeL_mean").alias("y"))
    return trends.series_extent(points, reference_y=0.9)


@query("f6_nearest_point")
def _(spark, sf):
    """Every event probes the chart of its type."""
    probes = d.table(spark, sf, "events").select(
        "event_id", F.col("event_type").alias("model_name"), F.col("ts").cast("timestamp").alias("at")
    )
    series = trends.latency_trend(_event_points(spark, sf))
    return trends.nearest_points(probes, series, ["model_name"])


# ---------------------------------------------------------------- whole jobs


@query("p1_run_outcomes")
def _(spark, sf):
    """Requests through plan, captured replies and scores to run rows, with the calls of each run.

    One run got no reply at all and one request names no dataset.
    """
    chosen = d.runs(spark, sf).filter("status NOT IN ('failed', 'pending')")
    asked = chosen.select("run_id", "dataset", "models", F.lit(False).alias("smoke_test"), F.lit(False).alias("use_mlflow"))
    none = spark.createDataFrame([("run_none", "none", ["gamma"], False, False)], asked.schema)
    requests = asked.unionByName(none)
    samples = d.samples(spark, sf).select("dataset", "file", "pos", *SAMPLE_COLUMNS[:4])
    catalog = samples.select(F.col("dataset").alias("path")).distinct()
    replies = d.responses(spark, sf).filter("run_id <> 'run_0001'")
    scores = d.logits(spark, sf)
    done = evaluation.evaluate_captured(requests, catalog, samples, replies, scores)
    never = F.lit(None).cast("timestamp")
    times = requests.select("run_id", *[never.alias(c) for c in ("created_at", "started_at", "completed_at")])
    out = evaluation.finish_runs(done, times).select("run_id", "dataset", "status", "error")
    counts = evaluation.captured_counts(done, samples, replies, scores)
    return out.join(counts, "run_id", "left").fillna(0, ["planned", "results", "failed"])


@query("p2_stored_series")
def _(spark, sf):
    """Results and runs through the store to the series."""
    runs_path, results_path = scratch.shared_dir(spark, "runs"), scratch.shared_dir(spark, "results")
    runs = d.runs(spark, sf)
    store.replace_results(runs.select("run_id"), scratch.saved(d.results(spark, sf), "scored"), results_path)
    store.save_runs(spark, runs.withColumn("seq", F.lit(0).cast("bigint")), runs_path)
    return history.stored_series(spark, runs_path, results_path)


@query("p3_health")
def _(spark, sf):
    """Results and runs through the store and the series to drift."""
    runs_path, results_path = scratch.shared_dir(spark, "runs"), scratch.shared_dir(spark, "results")
    runs = d.runs(spark, sf)
    store.replace_results(runs.select("run_id"), scratch.saved(d.results(spark, sf), "scored"), results_path)
    store.save_runs(spark, runs.withColumn("seq", F.lit(0).cast("bigint")), runs_path)
    return history.health(history.stored_series(spark, runs_path, results_path))["drift"]


# ---------------------------------------------------------------- streams


@query("g1_stream_run_store")
def _(spark, sf):
    """Each answer arrives twice: first with other scores, then as it stays. Runs span batches."""
    landing, log, points, checkpoint = (
        scratch.shared_dir(spark, n) for n in ("landing", "log", "points", "stream")
    )
    kept = d.event_results(spark, sf).drop("at").withColumn("saved_seq", F.lit(2).cast("bigint"))
    early = kept.withColumns(
        {"saved_seq": F.lit(1).cast("bigint"), "rougeL": F.lit(0.0), "latency_ms": F.lit(1.0)}
    )
    both = kept.unionByName(early)
    both.repartition(4, "sample_id").write.parquet(landing)
    runs = d.event_runs(spark, sf)
    stream = run_store.stream_run_store(
        spark, landing, both.schema, log, points, checkpoint, files_per_batch=2
    )
    stream.awaitTermination()
    return run_store.read_points(spark, points, runs)


@query("g2_stream_window_metrics")
def _(spark, sf):
    """Events as a stream; the days still open at the end are left out."""
    out, checkpoint = scratch.shared_dir(spark, "daily"), scratch.shared_dir(spark, "stream")
    schema = d.table(spark, sf, "events").schema
    # A stream reads folders or patterns, not a single named file.
    arriving = spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*")
    windows.stream_daily_metrics(d.as_results(arriving), out, checkpoint).awaitTermination()
    return spark.read.parquet(out)


@query("g3_stream_run_status")
def _(spark, sf):
    landing, log, checkpoint = (scratch.shared_dir(spark, n) for n in ("landing", "log", "stream"))
    d.run_events(spark, sf).repartition(3).write.parquet(landing)
    status.stream_run_status(spark, landing, log, checkpoint, files_per_batch=1).awaitTermination()
    return status.read_run_status(spark, log)


@query("g3_run_status_batch")
def _(spark, sf):
    return status.run_status(d.run_events(spark, sf))
