"""Row numbers and trailing windows that do not put a whole group into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdictlake.sources.scratch import saved


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    slice_by: Column,
    order_by: Sequence[Column | str],
    out: str,
    already: DataFrame | None = None,
) -> DataFrame:
    """Number the rows of each group from 1 in the order (``slice_by``, ``order_by``).

    ``slice_by`` cuts a group into consecutive ranges of bounded size. Only the row count
    per slice is brought together per group; the rows are numbered inside their slice and
    shifted by the rows before it. ``already`` (keys + ``taken``) starts a group after the
    numbers taken there. Null keys form a group of their own and null slices come last.
    """
    keys = list(keys)
    sliced = df.withColumn("_slice", slice_by)
    sizes = sliced.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_size"))
    ahead = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.col("_slice").asc_nulls_last())
    offsets = sizes.withColumn("_offset", F.sum("_size").over(ahead) - F.col("_size")).drop("_size")
    if already is not None:
        offsets = _null_safe(offsets, already.select(*keys, "taken"), keys, "left").withColumn(
            "_offset", F.col("_offset") + F.coalesce("taken", F.lit(0))
        ).drop("taken")
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order_by)
    return (
        _null_safe(sliced, offsets, [*keys, "_slice"], "inner")
        .withColumn(out, F.row_number().over(inside) + F.col("_offset"))
        .drop("_slice", "_offset")
    )


def ordinals(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[str], out: str, already: DataFrame | None = None
) -> DataFrame:
    """Number the rows of each group from 1 in the order of ``order_by``, whatever the size of a group.

    Rows are range-partitioned by (keys, order) and written to the shared folder with their place in their
    partition; only the row count per (group, partition) is brought together. A group that holds most of the
    table is spread over as many partitions as its rows fill. ``order_by`` should tell rows apart, since equal
    ones share a partition. ``already`` (keys + ``taken``) starts a group after the numbers taken there. Null
    keys form a group of their own, null orders come first.
    """
    keys = list(keys)
    by = [*keys, *order_by]
    in_order = df.repartitionByRange(*by).sortWithinPartitions(*by)
    # The lower 33 bits count the rows of a partition.
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    placed = saved(in_order.withColumns({"_part": F.spark_partition_id(), "_place": place}), "ordinals")
    parts = placed.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_size"), F.min("_place").alias("_first"))
    ahead = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_part")
    shift = F.sum("_size").over(ahead) - F.col("_size") - F.col("_first") + 1
    offsets = parts.select(*keys, "_part", shift.alias("_shift"))
    if already is not None:
        offsets = _null_safe(offsets, already.select(*keys, "taken"), keys, "left").withColumn(
            "_shift", F.col("_shift") + F.coalesce("taken", F.lit(0))
        ).drop("taken")
    return (
        _null_safe(placed, offsets, [*keys, "_part"], "inner")
        .withColumn(out, F.col("_place") + F.col("_shift"))
        .drop("_part", "_place", "_shift")
    )


def occurrence(df: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    """Number the rows of equal keys from 1, in an order that depends on the rows alone."""
    others = [c for c in df.columns if c not in keys]
    place = Window.partitionBy(*keys).orderBy(F.xxhash64(*(others or keys)))
    return df.withColumn(out, F.row_number().over(place))


def _null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join on equal keys, null equal to null, keeping the keys once."""
    renamed = right.withColumnsRenamed({k: f"_{k}_of_right" for k in keys})
    same = None
    for k in keys:
        equal = F.col(k).eqNullSafe(F.col(f"_{k}_of_right"))
        same = equal if same is None else same & equal
    return left.join(renamed, same, how).drop(*[f"_{k}_of_right" for k in keys])


def first_per_group(df: DataFrame, keys: Sequence[str], *order: Column | str) -> DataFrame:
    """The first row of each group. Every task keeps only its own first row of a group
    before the shuffle, so a group of any size costs one row per task."""
    place = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(place)).filter(F.col("_place") == 1).drop("_place")


def trailing_sum(
    df: DataFrame, keys: Sequence[str], ordinal: str, value: str, size: int, total: str, count: str
) -> DataFrame:
    """Sum and count of ``value`` over the ``size`` rows before each row.

    Each row is sent to the ``size`` positions after its own and the copies are added up
    per (key, position), so the work of one large group is spread like any aggregation.
    """
    keys = list(keys)
    payload = [c for c in df.columns if c not in keys and c != ordinal]
    copies = df.select(
        *keys,
        F.explode(F.sequence(F.lit(0), F.lit(size))).alias("_step"),
        F.col(ordinal).alias("_at"),
        F.struct(*payload).alias("_row"),
        F.col(value).alias("_val"),
    )
    own = F.col("_step") == 0
    merged = (
        copies.select(
            *keys,
            (F.col("_at") + F.col("_step")).alias(ordinal),
            F.when(own, F.col("_row")).alias("_row"),
            F.when(~own, F.col("_val")).alias("_val"),
        )
        .groupBy(*keys, ordinal)
        .agg(F.max("_row").alias("_row"), F.sum("_val").alias(total), F.count("_val").alias(count))
    )
    return merged.filter(F.col("_row").isNotNull()).select(*keys, ordinal, "_row.*", total, count)
