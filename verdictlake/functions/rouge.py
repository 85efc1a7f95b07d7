"""Token overlap scores between a reference and an answer.

Tokens and the final ratio are Spark expressions. Only the overlap counts of one pair are
taken in Python, in Arrow batches: the pair is one row, so nothing is shuffled, whereas
grouping exploded tokens would move every token of the table.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdictlake.functions.exact import rounded_ratio_units, unscaled

# What separates tokens, and the overlap each score is built on
# (an n-gram length, or the longest common subsequence).
SEPARATOR = "[^a-z0-9]+"
SCORES = {"rouge1": 1, "rouge2": 2, "rougeL": "lcs"}
#: Reference words per block of the longest common subsequence: a block's bit masks take 8 MB at most.
LCS_BLOCK = 8192


def tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits."""
    return F.array_remove(F.split(F.lower(text), SEPARATOR), "")


def _overlap_udf(kinds: Sequence[int | str], block: int = LCS_BLOCK):
    # Everything the workers need is nested here, so it travels with the function.
    fields = ", ".join(f"overlap_{k} bigint" for k in kinds)

    @F.pandas_udf(fields)
    def overlaps(reference: pd.Series, answer: pd.Series) -> pd.DataFrame:
        from collections import Counter

        def shared_ngrams(a, b, n):
            grams = Counter(zip(*(a[i:] for i in range(n))))
            other = Counter(zip(*(b[i:] for i in range(n))))
            return sum(min(count, grams[g]) for g, count in other.items() if g in grams)

        def common_subsequence(a, b):
            # Bit-parallel recurrence: zero bits mark the matched reference positions. The reference is taken
            # in blocks of positions; what an addition carries out of a block enters the next at the same word
            # of the answer. Memory is one byte a word of the answer and a bounded table of a block's words.
            matched, carried = 0, bytearray(len(b))
            for begin in range(0, len(a), block):
                part = a[begin : begin + block]
                full = (1 << len(part)) - 1
                places = {}
                for i, token in enumerate(part):
                    places[token] = places.get(token, 0) | 1 << i
                open_bits = full
                for j, token in enumerate(b):
                    hit, carry = open_bits & places.get(token, 0), carried[j]
                    if hit or carry:
                        total = open_bits + hit + carry
                        open_bits = (total & full) | (open_bits - hit)
                        carried[j] = total >> len(part)
                matched += len(part) - open_bits.bit_count()
            return matched

        rows = []
        for left, right in zip(reference, answer):
            a, b = left.split(), right.split()
            rows.append(
                [common_subsequence(a, b) if k == "lcs" else shared_ngrams(a, b, k) for k in kinds]
            )
        return pd.DataFrame(rows, columns=[f"overlap_{k}" for k in kinds])

    return overlaps


def f_measure(overlap: Column, n_reference: Column, n_answer: Column) -> Column:
    """Harmonic mean of precision and recall to 4 decimals; 0 when a side is empty."""
    length = n_reference + n_answer
    units = rounded_ratio_units(F.lit(2).cast("bigint") * overlap, F.greatest(length, F.lit(1)), 4)
    return F.when(overlap > 0, unscaled(units, 4)).otherwise(F.lit(0.0))


def with_rouge(
    df: DataFrame,
    reference: str = "expected",
    answer: str = "response_text",
    scores: Sequence[str] = ("rouge1", "rouge2", "rougeL"),
) -> DataFrame:
    """Add one column per score. All scores of a row come from one pass."""
    kinds = [SCORES[s] for s in scores]

    def joined(column: str) -> Column:
        return F.coalesce(F.array_join(column, " "), F.lit(""))

    tokenized = df.withColumns({"_ref": tokens(F.col(reference)), "_ans": tokens(F.col(answer))})
    counted = tokenized.withColumns(
        {
            "_overlap": _overlap_udf(kinds)(joined("_ref"), joined("_ans")),
            "_n_ref": F.size("_ref").cast("bigint"),
            "_n_ans": F.size("_ans").cast("bigint"),
        }
    )
    columns = {}
    for name, kind in zip(scores, kinds):
        fewer = kind - 1 if isinstance(kind, int) else 0
        n_ref = F.greatest(F.col("_n_ref") - fewer, F.lit(0).cast("bigint"))
        n_ans = F.greatest(F.col("_n_ans") - fewer, F.lit(0).cast("bigint"))
        columns[name] = f_measure(F.col(f"_overlap.overlap_{kind}"), n_ref, n_ans)
    return counted.withColumns(columns).drop("_ref", "_ans", "_overlap", "_n_ref", "_n_ans")
