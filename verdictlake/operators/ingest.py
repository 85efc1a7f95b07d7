"""From requests and raw samples to clean suites."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdictlake.functions.ordinals import ordinals
from verdictlake.functions.text import posix_path

# Fixed values of the data model.
DEFAULT_DOMAIN = "general"
DEFAULT_DIFFICULTY = "medium"
DATASET_ROOT = "datasets"
SMOKE_SAMPLES = 2
CUSTOM = "custom"
NO_MODELS = "no models given"
NO_DATASET = "dataset not found"
EMPTY_TEXT = "prompt and reference answer are required"


def suite_defaults(samples: DataFrame) -> DataFrame:
    """Fill what a columnar suite leaves out; a column it lacks altogether is added."""
    defaults = {
        "domain": F.lit(DEFAULT_DOMAIN),
        "tags": F.array().cast("array<string>"),
        "difficulty": F.lit(DEFAULT_DIFFICULTY),
    }
    filled = {
        name: F.coalesce(F.col(name), value) if name in samples.columns else value
        for name, value in defaults.items()
    }
    return samples.withColumns(filled)


def duplicate_sample_ids(samples: DataFrame, suite: str = "dataset") -> DataFrame:
    """Ids that occur more than once in a suite. Such samples are kept; this only reports them."""
    return (
        samples.groupBy(suite, "sample_id")
        .agg(F.count(F.lit(1)).alias("occurrences"))
        .filter(F.col("occurrences") > 1)
    )


def resolve_datasets(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """Add ``dataset_path``: the given name, else the name under the dataset root, else null.

    ``catalog`` lists the existing paths in a column ``path``.
    """
    paths = catalog.select("path").distinct()
    given = posix_path(F.col("dataset"))
    asked = requests.withColumns(
        {"_given": given, "_under": F.concat(F.lit(DATASET_ROOT + "/"), given)}
    )
    return (
        asked.join(paths.select(F.col("path").alias("_as_given")), F.col("_given") == F.col("_as_given"), "left")
        .join(paths.select(F.col("path").alias("_as_name")), F.col("_under") == F.col("_as_name"), "left")
        .withColumn("dataset_path", F.coalesce("_as_given", "_as_name"))
        .drop("_given", "_under", "_as_given", "_as_name")
    )


def validate_requests(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """Resolve and default every request; ``reject_reason`` is null when it is accepted."""
    n_models = F.coalesce(F.size("models"), F.lit(0))
    reason = F.when(n_models < 1, NO_MODELS).when(F.col("dataset_path").isNull(), NO_DATASET)
    return resolve_datasets(requests, catalog).withColumns(
        {
            "smoke_test": F.coalesce("smoke_test", F.lit(False)),
            "use_mlflow": F.coalesce("use_mlflow", F.lit(True)),
            "reject_reason": reason,
        }
    )


def accepted(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("reject_reason").isNull()).drop("reject_reason")


def rejected(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("reject_reason").isNotNull())


def smoke_limit(
    samples: DataFrame, suite: str = "dataset", order: Sequence[str] = ("file", "pos"), k: int = SMOKE_SAMPLES
) -> DataFrame:
    """The first ``k`` samples of each suite. Every task keeps only its own first ``k``."""
    place = Window.partitionBy(suite).orderBy(*order)
    return samples.withColumn("_place", F.row_number().over(place)).filter(F.col("_place") <= k).drop("_place")


def model_catalog(live: DataFrame, known: DataFrame) -> DataFrame:
    """Every live or known model with whether it is live, sorted by name."""
    here = live.select("name").distinct().withColumn("_live", F.lit(True))
    return (
        known.select("name")
        .distinct()
        .join(here, "name", "full")
        .select("name", F.coalesce("_live", F.lit(False)).alias("available"))
        .orderBy("name")
    )


def default_model(catalog: DataFrame) -> DataFrame:
    """The model offered first: the first available one by name; no row when none is."""
    return catalog.filter("available").agg(F.min("name").alias("name")).filter(F.col("name").isNotNull())


def append_generated(existing: DataFrame, new: DataFrame, order: Sequence[str]) -> DataFrame:
    """Append new samples, numbered per domain in ``order`` after the ones the domain already has."""
    taken = existing.groupBy("domain").agg(F.count(F.lit(1)).alias("taken"))
    numbered = ordinals(new, ["domain"], order, "_no", already=taken)
    named = numbered.withColumn("sample_id", F.format_string("%s_auto_%03d", "domain", "_no"))
    return existing.unionByName(named.select(*existing.columns))


def check_adhoc_samples(given: DataFrame) -> DataFrame:
    """``reject_reason`` for samples typed in without a prompt or without a reference answer."""
    empty = (F.coalesce("prompt", F.lit("")) == "") | (F.coalesce("expected", F.lit("")) == "")
    return given.withColumn("reject_reason", F.when(empty, EMPTY_TEXT))


def adhoc_samples(given: DataFrame, order: Sequence[str]) -> DataFrame:
    """The accepted ad-hoc samples as a suite of their own."""
    kept = accepted(check_adhoc_samples(given))
    numbered = ordinals(kept, [], order, "_no")
    return numbered.select(
        F.format_string("custom_%03d", "_no").alias("sample_id"),
        "prompt",
        "expected",
        F.lit(CUSTOM).alias("domain"),
        F.array(F.lit(CUSTOM)).alias("tags"),
        F.lit(DEFAULT_DIFFICULTY).alias("difficulty"),
    )
