"""Which calls a run makes, and how replies come back to them."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdictlake import schemas
from verdictlake.functions import exact
from verdictlake.functions.ordinals import occurrence
from verdictlake.operators.ingest import smoke_limit

CALL_KEYS = ("run_id", "sample_id", "model_name")

# (model name, prompt, system prompt) -> fields of a reply
Ask = Callable[[str, str, str], dict]


def eval_plan(samples: DataFrame, runs: DataFrame) -> DataFrame:
    """Every sample of a run's dataset with every model of the run.

    Runs join samples on the dataset and carry their models as a list, which is opened
    after the join, so no product of two tables is formed. Runs marked ``smoke_test`` get
    the first samples only.
    """
    smoke = F.coalesce("smoke_test", F.lit(False)) if "smoke_test" in runs.columns else None

    def calls(of: DataFrame, chosen: DataFrame) -> DataFrame:
        wanted = chosen.select("run_id", "dataset", "models")
        return of.join(wanted, "dataset").withColumn("model_name", F.explode("models")).drop("models")

    if smoke is None:
        return calls(samples, runs)
    return calls(samples, runs.filter(~smoke)).unionByName(
        calls(smoke_limit(samples), runs.filter(smoke))
    )


def planned_counts(samples: DataFrame, runs: DataFrame) -> DataFrame:
    """Per run (run_id, planned): how many rows ``eval_plan(samples, runs)`` has, without forming the plan.

    A plan has a row for every run and sample of its dataset, so it grows with their product. Its size follows
    from the samples per dataset and the length of each run's list of models.
    """
    wanted, asked = _wanted(samples, runs)
    sizes = asked.groupBy("dataset", "_smoke").agg(F.count(F.lit(1)).alias("_samples"))
    return _planned(wanted.withColumn("_models", F.size("models")), sizes, ["dataset", "_smoke"])


def planned_among(samples: DataFrame, runs: DataFrame, calls: DataFrame) -> DataFrame:
    """Per run (run_id, planned): how many rows of ``eval_plan(samples, runs)`` have keys that occur in ``calls``.

    Each of ``calls`` finds its run and then the number of samples that share its id; the plan is not formed.
    """
    wanted, asked = _wanted(samples, runs)
    same_id = ["dataset", "sample_id", "_smoke"]
    sizes = asked.groupBy(*same_id).agg(F.count(F.lit(1)).alias("_samples"))
    of_model = F.size(F.filter("models", lambda name: name == F.col("model_name")))
    met = calls.select(*CALL_KEYS).distinct().join(wanted, "run_id").withColumn("_models", of_model)
    return _planned(met, sizes, same_id)


def _wanted(samples: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runs and the keys of the samples they ask, both with ``_smoke``: whether only the first samples are meant."""
    every = samples.select("dataset", "sample_id", F.lit(False).alias("_smoke"))
    if "smoke_test" not in runs.columns:
        return runs.select("run_id", "dataset", "models", F.lit(False).alias("_smoke")), every
    first = smoke_limit(samples).select("dataset", "sample_id", F.lit(True).alias("_smoke"))
    smoke = F.coalesce("smoke_test", F.lit(False)).alias("_smoke")
    return runs.select("run_id", "dataset", "models", smoke), every.unionByName(first)


def _planned(wanted: DataFrame, sizes: DataFrame, keys: Sequence[str]) -> DataFrame:
    counted = wanted.filter(F.col("_models") > 0).drop("models").join(sizes, list(keys))
    return counted.groupBy("run_id").agg(F.sum(F.col("_samples") * F.col("_models")).alias("planned"))


def usable(responses: DataFrame) -> Column:
    """Whether a reply counts as an answer: it has a text and no error."""
    good = F.col("response_text").isNotNull()
    return good & F.col("error").isNull() if "error" in responses.columns else good


def attach_responses(
    plan: DataFrame, responses: DataFrame, keys: Sequence[str] = CALL_KEYS
) -> DataFrame:
    """Answered calls: sample fields with reply fields; missing token counts are 0, the cost is 0.

    Replies with an error or without a text are no answers. Of calls with equal keys, as of samples that share
    an id, the k-th meets the k-th reply, so n calls and m replies make no more than min(n, m) answers.
    """
    replies = responses.filter(usable(responses)).select(*keys, "response_text", "latency_ms", "input_tokens", "output_tokens")
    each = [*keys, "_nth"]
    return _filled(occurrence(plan, keys, "_nth").join(occurrence(replies, keys, "_nth"), each).drop("_nth"))


def answered_calls(replies: DataFrame) -> DataFrame:
    """Replies of ``batch_generate`` that did not fail, as answers."""
    return _filled(replies.filter(usable(replies)))


def answers(samples: DataFrame, runs: DataFrame, responses: DataFrame) -> DataFrame:
    """The rows of ``attach_responses(eval_plan(samples, runs), responses)`` without forming the plan.

    A plan repeats the texts of a sample for every run and model. Here a reply finds its
    run first and then its sample, so each sample is moved once, however often it was asked.
    """
    smoke = F.coalesce("smoke_test", F.lit(False)) if "smoke_test" in runs.columns else F.lit(False)
    wanted = runs.select("run_id", "dataset", "models", smoke.alias("_smoke"))
    replies = (
        responses.filter(usable(responses)).select(*CALL_KEYS, "response_text", "latency_ms", "input_tokens", "output_tokens")
        .join(wanted, "run_id")
        .filter(F.array_contains("models", F.col("model_name")))
        .drop("models")
    )

    def matched(of: DataFrame, chosen: DataFrame) -> DataFrame:
        # Of samples that share an id, the k-th takes the k-th reply of each run and model.
        sample = ["dataset", "sample_id"]
        of, chosen = occurrence(of, sample, "_nth"), occurrence(chosen.drop("_smoke"), CALL_KEYS, "_nth")
        return of.join(chosen, [*sample, "_nth"]).drop("_nth")

    found = matched(samples, replies.filter(~F.col("_smoke")))
    if "smoke_test" in runs.columns:
        found = found.unionByName(matched(smoke_limit(samples), replies.filter(F.col("_smoke"))))
    return _filled(found)


def _filled(answered: DataFrame) -> DataFrame:
    return answered.withColumns(
        {
            "input_tokens": F.coalesce("input_tokens", F.lit(0)),
            "output_tokens": F.coalesce("output_tokens", F.lit(0)),
            "estimated_cost_usd": F.lit(0.0),
        }
    )


def failed_calls(plan: DataFrame, responses: DataFrame, keys: Sequence[str] = CALL_KEYS) -> DataFrame:
    """Planned calls without a usable reply; see ``scoring.failures`` for the reasons.

    Of n calls with equal keys and m replies, n - m remain.
    """
    replied = responses.filter(usable(responses)).groupBy(*keys).agg(F.count(F.lit(1)).alias("_replied"))
    numbered = occurrence(plan, keys, "_nth").join(replied, list(keys), "left")
    return numbered.filter(F.col("_nth") > F.coalesce("_replied", F.lit(0))).drop("_nth", "_replied")


def call_coverage(plan: DataFrame, responses: DataFrame, keys: Sequence[str] = CALL_KEYS) -> DataFrame:
    """Per (run, model): planned and answered calls. A run without any reply keeps its row."""
    replied = responses.filter(usable(responses)).groupBy(*keys).agg(F.count(F.lit(1)).alias("_replied"))
    calls = plan.groupBy(*keys).agg(F.count(F.lit(1)).alias("_calls"))
    answered = F.least("_calls", F.coalesce("_replied", F.lit(0)))
    return (
        calls.join(replied, list(keys), "left")
        .groupBy("run_id", "model_name")
        .agg(F.sum("_calls").alias("planned"), F.sum(answered).alias("answered"))
    )


def chat_messages(prompt: Column, system_prompt: Column | None = None) -> Column:
    """The message list of a call: the system message if it is not empty, then the user's."""

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    user = F.array(message("user", prompt))
    if system_prompt is None:
        return user
    given = F.coalesce(system_prompt, F.lit("")) != ""
    return F.when(given, F.array(message("system", system_prompt), message("user", prompt))).otherwise(user)


def parse_replies(replies: DataFrame, raw: str = "raw") -> DataFrame:
    """Read content and token counts from raw reply JSON; ``error`` is set when there is no content."""
    parsed = replies.withColumn("_reply", F.from_json(raw, schemas.RAW_REPLY))
    content = F.col("_reply.message.content")
    return parsed.withColumns(
        {
            "response_text": content,
            "input_tokens": F.col("_reply.prompt_eval_count"),
            "output_tokens": F.col("_reply.eval_count"),
            "error": F.when(content.isNull(), F.lit("reply has no message content")),
        }
    ).drop("_reply")


def elapsed_ms(start: Column, end: Column) -> Column:
    """Milliseconds between two times, to 2 decimals."""
    micros = F.unix_micros(end) - F.unix_micros(start)
    return exact.unscaled(
        exact.rounded_ratio_units(micros, F.lit(10).cast("bigint")), exact.LATENCY_PLACES
    )


def batch_generate(
    plan: DataFrame,
    make_client: Callable[[], Ask],
    system_prompt: str | None = None,
    concurrency: int = 4,
) -> DataFrame:
    """Ask a model for every planned call and add the reply fields.

    ``make_client`` runs once per task; the client it returns takes (model name, prompt,
    system prompt) and returns ``response_text`` and optionally the token counts and a
    ``latency_ms`` of its own. A call that raises keeps its row with ``error`` set. A lost
    task asks again, so write the replies to a table before using them twice. Only what the
    model is asked travels to the tasks' Python.
    """
    schema = T.StructType(schemas.RESPONSE.fields)
    fields = schemas.RESPONSE.fieldNames()

    @F.pandas_udf(schema)
    def ask_all(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        import time
        from concurrent.futures import ThreadPoolExecutor

        client = make_client()

        def ask(call):
            reply = dict.fromkeys(fields)
            begun = time.perf_counter()
            try:
                reply.update(client(*call))
                if reply["latency_ms"] is None:
                    reply["latency_ms"] = (time.perf_counter() - begun) * 1000
                reply["latency_ms"] = round(reply["latency_ms"], 2)
            except Exception as problem:  # a failed call must not end the task
                reply["error"] = str(problem) or type(problem).__name__
            return reply

        with ThreadPoolExecutor(concurrency) as pool:
            for model, prompt, system in batches:
                calls = zip(model, prompt, system)
                yield pd.DataFrame(list(pool.map(ask, calls)), columns=fields, dtype=object)

    system = F.coalesce(F.col(system_prompt), F.lit("")) if system_prompt else F.lit("")
    asked = plan.withColumn("_reply", ask_all(F.col("model_name"), F.col("prompt"), system))
    return asked.select(*plan.columns, "_reply.*")
