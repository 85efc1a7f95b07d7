"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdictlake.llm.shared import saved

ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (columns a, b), component being its smallest node.

    Alternates two moves until nothing changes: every node's larger neighbours are tied to its
    smallest neighbour, then every node's smaller neighbours and itself are. Both keep the
    components and take logarithmically many rounds on chains. Minima are combined before the
    shuffle; each round is written, so its lineage ends there. Nodes that are null are ignored;
    nodes without a link do not appear.
    """

    def edges(df: DataFrame) -> DataFrame:
        return df.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def state(df: DataFrame) -> tuple:
        row = df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.col("b").cast("decimal(38,0)"))).first()
        return tuple(row)

    now = saved(edges(links), "links")
    before = state(now)
    for _ in range(ROUNDS):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = edges(both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        tied = large.join(least, "a")
        small = tied.select("b", "m").toDF("a", "b").unionByName(tied.select("a", "m").toDF("a", "b"))
        now = saved(edges(small), "links")
        after = state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    top = now.select("b").distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        top.select(F.col("b").alias("node"), F.col("b").alias("component"))
    )
