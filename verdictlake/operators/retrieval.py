"""Reading runs and answers back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdictlake import schemas
from verdictlake.functions import exact
from verdictlake.functions.ordinals import first_per_group

# Fixed values of the data model.
ALL = "all"
HALLUCINATED = "hallucinated"
CLEAN = "clean"
UNFINISHED = ("pending", "running")
RECENT_RUNS = 20


def run_results(results: DataFrame, run_id: str) -> DataFrame:
    """The stored answers of one run. On the store the filter picks one directory."""
    return (
        results.filter(F.col("run_id") == run_id)
        .select(*schemas.STORED_COLUMNS)
        .orderBy("sample_id", "model_name")
    )


def filter_results(results: DataFrame, model: str = ALL, failure: str = ALL) -> DataFrame:
    if failure not in (ALL, HALLUCINATED, CLEAN):
        raise ValueError(f"unknown filter: {failure}")
    if model != ALL:
        results = results.filter(F.col("model_name") == model)
    if failure == HALLUCINATED:
        results = results.filter(F.col("hallucination_flag"))
    if failure == CLEAN:
        results = results.filter(~F.col("hallucination_flag"))
    return results


def distinct_models(results: DataFrame) -> DataFrame:
    return results.select("model_name").distinct().orderBy("model_name")


def failure_cases(results: DataFrame) -> DataFrame:
    return results.filter(F.col("hallucination_flag")).select(
        "model_name", "sample_id", "prompt", "expected", "response_text"
    )


def failure_count(results: DataFrame) -> DataFrame:
    return results.agg(exact.flag_count(F.col("hallucination_flag")).alias("failures")).select(
        F.coalesce("failures", F.lit(0).cast("bigint")).alias("failures")
    )


def multi_model_runs(runs: DataFrame) -> DataFrame:
    return runs.filter(F.size("models") > 1)


def ready_results(results: DataFrame, runs: DataFrame) -> DataFrame:
    """Answers of finished runs only."""
    finished = runs.filter(~F.col("status").isin(*UNFINISHED)).select("run_id")
    return results.join(finished, "run_id", "left_semi")


def result_availability(requested: DataFrame, runs: DataFrame) -> DataFrame:
    """Per requested run id: ``ready``, ``not_ready`` or ``unknown``."""
    outcome = (
        F.when(F.col("status").isNull(), "unknown")
        .when(F.col("status").isin(*UNFINISHED), "not_ready")
        .otherwise("ready")
    )
    return requested.join(runs.select("run_id", "status"), "run_id", "left").withColumn("outcome", outcome)


def recent_runs(seen: DataFrame, limit: int = RECENT_RUNS) -> DataFrame:
    """The latest entry of each run by ``seen_at``, newest first, at most ``limit``."""
    latest = first_per_group(seen, ["run_id"], F.col("seen_at").desc())
    newest = latest.orderBy(F.col("seen_at").desc(), F.col("run_id").desc()).limit(limit)
    return newest.select("run_id", "dataset", "models", "created_at", "seen_at")


def score_table(results: DataFrame) -> DataFrame:
    """The seven display columns of an ad-hoc evaluation."""
    titles = {
        "model_name": "Model",
        "rouge1": "ROUGE-1",
        "rouge2": "ROUGE-2",
        "rougeL": "ROUGE-L",
        "hallucination_flag": "Hallucination",
        "nli_confidence": "NLI confidence",
        "latency_ms": "Latency (ms)",
    }
    return results.select(*[F.col(name).alias(title) for name, title in titles.items()])


def results_table(results: DataFrame) -> DataFrame:
    """The display columns of the results listing: ROUGE-L to 3 decimals, latency to whole ms."""
    one = F.lit(1).cast("bigint")
    rouge = exact.rounded_ratio(exact.score_units(F.col("rougeL")), one, 4, 3)
    latency = exact.rounded_ratio(exact.latency_units(F.col("latency_ms")), one, 2, 0)
    return results.select(
        F.col("sample_id").alias("Sample"),
        F.col("model_name").alias("Model"),
        rouge.alias("ROUGE-L"),
        F.when(F.col("hallucination_flag"), "flagged").otherwise("clean").alias("Hallucination"),
        latency.cast("bigint").alias("Latency (ms)"),
        F.col("response_text").alias("Response"),
    )
