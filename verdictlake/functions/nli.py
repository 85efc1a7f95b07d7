"""The contradiction check: pair text, class decision, flag, and the classifier seam."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters kept of each side by default, the separator, the class order, and the
# class that counts as a hallucination.
KEPT_CHARS = 500
PAIR_SEPARATOR = " [SEP] "
CLASSES = ("contradiction", "entailment", "neutral")
FLAGGED_CLASS = "contradiction"

Classifier = Callable[[pd.Series], pd.DataFrame]


def pair_text(expected: Column, response: Column, kept: int | None = KEPT_CHARS) -> Column:
    """Both texts, each cut to its first ``kept`` characters; None keeps whole texts."""
    sides = [side if kept is None else F.substring(side, 1, kept) for side in (expected, response)]
    return F.concat(sides[0], F.lit(PAIR_SEPARATOR), sides[1])


def top_class(scores: dict[str, Column]) -> Column:
    """Name of the highest score, lower-cased; of equal scores the first in class order."""
    best = F.greatest(*scores.values())
    chosen = None
    for name, score in scores.items():
        hit = score == best
        chosen = F.when(hit, F.lit(name.lower())) if chosen is None else chosen.when(hit, F.lit(name.lower()))
    return chosen


def top_probability(scores: dict[str, Column]) -> Column:
    """Softmax probability of the highest score, to 4 decimals."""
    best = F.greatest(*scores.values())
    total = None
    for score in scores.values():
        part = F.exp(score - best)
        total = part if total is None else total + part
    return F.floor(F.lit(1.0) / total * F.lit(10000.0) + F.lit(0.5)).cast("double") / F.lit(10000.0)


def is_hallucination(label: Column) -> Column:
    return label == F.lit(FLAGGED_CLASS)


def with_verdict(df: DataFrame) -> DataFrame:
    """Turn the three class scores of a row into label, confidence and flag."""
    scores = {name: F.col(name) for name in CLASSES}
    return df.withColumns(
        {"nli_label": top_class(scores), "nli_confidence": top_probability(scores)}
    ).withColumn("hallucination_flag", is_hallucination(F.col("nli_label")))


def with_class_scores(
    df: DataFrame, load_classifier: Callable[[], Classifier], text: Column
) -> DataFrame:
    """Run a classifier over the pair text and add one column per class score, and ``score_error``.

    ``load_classifier`` is called once per task; what it returns maps a batch of texts to
    a frame with one score column per class. If a batch raises, its texts are tried one by
    one, and only a text that raises alone has no scores but an error.
    """
    fields = ", ".join([*(f"{name} double" for name in CLASSES), "score_error string"])
    names = list(CLASSES)

    @F.pandas_udf(fields)
    def infer(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import pandas as pd

        classify = load_classifier()

        def scores(texts):
            found = classify(texts)[names].astype("float64").reset_index(drop=True)
            return found.assign(score_error=pd.Series([None] * len(found), dtype=object))

        def one(text):
            try:
                return scores(pd.Series([text]))
            except Exception as problem:  # a text that cannot be scored must not end the task
                reason = str(problem) or type(problem).__name__
                return pd.DataFrame([[None] * len(names) + [reason]], columns=[*names, "score_error"])

        for texts in batches:
            try:
                yield scores(texts)
            except Exception:
                parts = pd.concat([one(text) for text in texts], ignore_index=True)
                yield parts.astype({name: "float64" for name in names})

    return df.withColumn("_scores", infer(text)).select(*df.columns, "_scores.*")
