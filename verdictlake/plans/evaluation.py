"""From requests to stored, scored answers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictlake.operators.ingest import accepted, rejected, validate_requests
from verdictlake.operators.planning import CALL_KEYS, answered_calls, answers, batch_generate, eval_plan
from verdictlake.operators.scoring import call_totals, failures, judge_with_classifier, score_with_logits, scored_answers
from verdictlake.sources.scratch import saved
from verdictlake.sources.store import replace_results, save_runs


@dataclass
class Evaluation:
    """The tables one evaluation produces.

    Every planned call is in ``results`` or, with its reason, in ``failed``.
    """

    runs: DataFrame
    rejected: DataFrame
    plan: DataFrame
    failed: DataFrame
    results: DataFrame


def evaluate_captured(
    requests: DataFrame, catalog: DataFrame, samples: DataFrame, responses: DataFrame, class_scores: DataFrame
) -> Evaluation:
    """Evaluate replies and class scores that were captured elsewhere."""
    checked = validate_requests(requests, catalog)
    runs = _runs(checked)
    # The plan is kept to its keys; texts join the replies directly.
    plan = eval_plan(samples.select("dataset", "file", "pos", "sample_id"), runs)
    results = score_with_logits(answers(samples, runs, responses), class_scores)
    return Evaluation(runs, rejected(checked), plan, failures(plan, responses, class_scores), results)


def evaluate_live(
    requests: DataFrame, catalog: DataFrame, samples: DataFrame, make_client, load_classifier
) -> Evaluation:
    """Ask the models, then score. Both happen here: replies and scores are written once and read from there."""
    checked = validate_requests(requests, catalog)
    runs = _runs(checked)
    plan = eval_plan(samples, runs)
    replies = saved(batch_generate(plan, make_client), "replies")
    judged = saved(judge_with_classifier(answered_calls(replies), load_classifier), "judged")
    unscored = judged.filter(F.col("score_error").isNotNull()).select(*CALL_KEYS, F.col("score_error").alias("reason"))
    failed = failures(plan, replies).unionByName(unscored)
    return Evaluation(runs, rejected(checked), plan, failed, scored_answers(judged))


def captured_counts(
    evaluation: Evaluation, samples: DataFrame, responses: DataFrame, class_scores: DataFrame
) -> DataFrame:
    """Per run of ``evaluate_captured``: rows of ``plan``, ``results`` and ``failed`` (planned, results, failed).

    ``plan`` and ``failed`` list every call, which is the product of runs and samples; they are counted without
    being formed.
    """
    totals = call_totals(samples, evaluation.runs, responses, class_scores)
    scored = evaluation.results.groupBy("run_id").agg(F.count(F.lit(1)).alias("results"))
    counts = totals.join(scored, "run_id", "left").select("run_id", "planned", "results", "failed")
    return counts.fillna(0, ["results"])


def finish_runs(evaluation: Evaluation, created: DataFrame) -> DataFrame:
    """Run rows of an evaluation: ``created`` (run_id, created_at, started_at, completed_at) with outcome.

    A run that was evaluated is completed, also if all its calls failed; then it has no answers.
    A request that was rejected is failed, and its error is the reason. ``seq`` orders the save.
    """
    done = evaluation.runs.select("run_id", "dataset", "models", F.lit("completed").alias("status"), F.lit(None).cast("string").alias("error"))
    refused = evaluation.rejected.select("run_id", "dataset", "models", F.lit("failed").alias("status"), F.col("reject_reason").alias("error"))
    both = done.unionByName(refused).withColumn("seq", F.lit(0).cast("bigint"))
    return both.join(created.select("run_id", "created_at", "started_at", "completed_at"), "run_id")


def _runs(checked: DataFrame) -> DataFrame:
    return accepted(checked).select(
        "run_id", F.col("dataset_path").alias("dataset"), "models", "smoke_test", "use_mlflow"
    )


def store(spark: SparkSession, evaluation: Evaluation, runs: DataFrame, runs_path: str, results_path: str) -> None:
    """Save run rows (with ``seq``) and the answers of those runs, replacing earlier saves.

    The scored answers are written once first, so that no answer is scored twice.
    """
    replace_results(runs.select("run_id"), saved(evaluation.results, "scored"), results_path)
    save_runs(spark, runs, runs_path)
