"""Scored answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdictlake import schemas
from verdictlake.functions import nli
from verdictlake.functions.rouge import with_rouge
from verdictlake.operators.planning import CALL_KEYS, planned_among, planned_counts, usable

# Reasons of a call without a result.
NO_REPLY = "no reply"
NO_TEXT = "reply without text"
NOT_SCORED = "no class scores"


def score_with_logits(answers: DataFrame, class_scores: DataFrame, keys: Sequence[str] = CALL_KEYS) -> DataFrame:
    """Score answers whose class scores were captured in a table.

    The one join moves the answers on the call keys; ROUGE is computed on each row.
    """
    judged = answers.join(class_scores.select(*keys, *nli.CLASSES), list(keys))
    return _result(nli.with_verdict(with_rouge(judged)), keys)


def judge_with_classifier(answers: DataFrame, load_classifier, kept: int | None = nli.KEPT_CHARS) -> DataFrame:
    """Answers with all scores, or with ``score_error``; nothing is shuffled.

    ``kept`` characters of each text reach the classifier; None for whole texts.
    """
    pair = nli.pair_text(F.col("expected"), F.col("response_text"), kept)
    judged = nli.with_verdict(nli.with_class_scores(with_rouge(answers), load_classifier, pair))
    missing = F.when(F.col("nli_label").isNull(), F.lit(NOT_SCORED))
    return judged.withColumn("score_error", F.coalesce("score_error", missing))


def scored_answers(judged: DataFrame, keys: Sequence[str] = CALL_KEYS) -> DataFrame:
    return _result(judged.filter(F.col("score_error").isNull()), keys)


def score_with_classifier(
    answers: DataFrame, load_classifier, keys: Sequence[str] = CALL_KEYS, kept: int | None = nli.KEPT_CHARS
) -> DataFrame:
    """Score answers with a classifier that runs in the tasks; those it fails on are left out."""
    return scored_answers(judge_with_classifier(answers, load_classifier, kept), keys)


def failures(
    plan: DataFrame, responses: DataFrame, class_scores: DataFrame | None = None, keys: Sequence[str] = CALL_KEYS
) -> DataFrame:
    """Planned calls that give no result: ``keys`` and the ``reason``, one row for each planned call.

    A call fails if no reply came, if the reply has an error or no text, or, where class scores
    are given, if they lack it. A call with several replies fails only if none of them is usable.
    """
    keys = list(keys)
    error = F.col("error") if "error" in responses.columns else F.lit(None).cast("string")
    bad = F.when(usable(responses), F.lit(None)).otherwise(F.coalesce(error, F.lit(NO_TEXT)))
    replies = responses.select(*keys, bad.alias("_bad")).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_replies"), F.count("_bad").alias("_useless"), F.min("_bad").alias("_bad")
    )
    joined = plan.select(*keys).join(replies, keys, "left")
    reason = F.when(F.col("_replies").isNull(), NO_REPLY).when(F.col("_replies") == F.col("_useless"), F.col("_bad"))
    if class_scores is not None:
        scored = class_scores.select(*keys).distinct().withColumn("_scored", F.lit(True))
        joined = joined.join(scored, keys, "left")
        reason = reason.when(F.col("_scored").isNull(), NOT_SCORED)
    return joined.select(*keys, reason.alias("reason")).filter(F.col("reason").isNotNull())


def call_totals(
    samples: DataFrame, runs: DataFrame, responses: DataFrame, class_scores: DataFrame | None = None
) -> DataFrame:
    """Per run (run_id, planned, failed): the rows of ``eval_plan`` and of ``failures`` over that plan.

    Neither is formed: both grow with the product of runs and samples. A planned call did not fail if its keys
    have a usable reply and, where class scores are given, have those; all others failed.
    """
    good = responses.filter(usable(responses)).select(*CALL_KEYS)
    if class_scores is not None:
        good = good.join(class_scores.select(*CALL_KEYS), list(CALL_KEYS), "left_semi")
    kept = planned_among(samples, runs, good).withColumnRenamed("planned", "_kept")
    failed = F.col("planned") - F.coalesce("_kept", F.lit(0))
    return planned_counts(samples, runs).join(kept, "run_id", "left").select("run_id", "planned", failed.alias("failed"))


def _result(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    lead = [k for k in keys if k not in schemas.RESULT_COLUMNS]
    return scored.select(*lead, *schemas.RESULT_COLUMNS)
