"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions only.

Every source is a queue served in proportion to its target. Its documents wait in an order
shuffled by a hash, once per pass over the source; a document's virtual start and finish are the
source's words before and with it, divided by the source's target. The mix is the stream of all
documents in order of virtual finish, cut where the total budget is spent. As service is shared
by target, all sources have received the same fraction of their targets at any virtual time;
the budget is the sum of the targets, so it is spent at virtual time 1. The document that a
source is being served at that time is cut there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
#: First hex digits of the shuffling hash that name a bucket of a source; 4096 buckets a source.
BUCKET_DIGITS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], share_percent: int, most: int) -> DataFrame:
    """Per source: source_key, source_size, target.

    ``sizes`` has one row per source. Sources in code point order, null last, take the weights in
    turn and share ``share_percent`` of all words. A target stops at ``most`` times its source; what
    is over is shared again by weight among the others until none is above. In order of
    most * size / weight, a source stops at its limit as long as its share of what is left over the
    sources before it would be above; from the first that is not, all have the same share per
    weight. One row per source goes through one task: a list of sources, never of documents.
    """
    everything = Window.partitionBy(F.lit(0))
    in_order = Window.partitionBy(F.lit(0)).orderBy("source_key")
    turn = F.pmod(F.row_number().over(in_order) - 1, F.lit(len(weights))).cast("int")
    weighed = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), turn + 1).cast("long"))
    limit = F.col("source_size") * most
    by_limit = Window.partitionBy(F.lit(0)).orderBy(F.col("source_size") / F.col("weight"), "source_key")
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    shared = (
        weighed.withColumn("total", F.sum("source_size").over(everything))
        # Budget and limits in hundredths, so that all is whole numbers up to one division.
        .withColumn(
            "left_over",
            F.col("total") * share_percent - F.coalesce(F.sum(limit * 100).over(before), F.lit(0)),
        )
        .withColumn(
            "weight_left",
            F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
        )
        .withColumn("open", F.col("left_over") * F.col("weight") <= limit * 100 * F.col("weight_left"))
        .withColumn("place", F.row_number().over(by_limit))
        .withColumn("first_open", F.min(F.when(F.col("open"), F.col("place"))).over(everything))
    )
    at_first = F.col("place") == F.col("first_open")
    return (
        shared.withColumn("pot", F.max(F.when(at_first, F.col("left_over"))).over(everything))
        .withColumn("parts", F.max(F.when(at_first, F.col("weight_left"))).over(everything))
        .select(
            "source_key",
            "source_size",
            F.when(
                F.col("first_open").isNotNull() & (F.col("place") >= F.col("first_open")),
                F.least((F.col("pot") * F.col("weight")).cast("double") / (F.col("parts") * 100), limit.cast("double")),
            )
            .otherwise(limit.cast("double"))
            .alias("target"),
        )
    )


def scheduled(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    share_percent: int = 150,
    most: int = 2,
    seed: str = "mix",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Every document with its queue times.

    Columns: ``id``, size, source_size, target, taken, passes; ``keep`` names further columns of the
    input that come along as mix_<name>. ``passes`` is a list of (epoch, start, finish, words): the
    virtual times and the words taken in each pass over the source, 0 if it comes after the cut.

    The order inside a source is by md5 of seed and id, then size: reruns agree, and rows equal in
    both are alike. A source is split into 4096 buckets of that hash; only bucket sums are added up
    per source, and running sums are taken inside buckets, so no task holds a source. Null sources
    form one source, last in order; a null text has size 0; null ids share one place in the order.
    An empty table gives no rows.
    """
    key = F.when(F.col(source).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source).cast("string")))
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id).cast("string"), F.lit(""))))
    sized = docs.select(
        F.col(id).alias("mix_id"),
        key.alias("source_key"),
        order.alias("place"),
        word_count(F.col(text)).alias("size"),
        *[F.col(c).alias(f"mix_{c}") for c in keep],
    ).withColumn("bucket", F.substring("place", 1, BUCKET_DIGITS))
    sums = sized.groupBy("source_key", "bucket").agg(F.sum("size").alias("bucket_size"))
    by_source = targets(
        sums.groupBy("source_key").agg(F.sum("bucket_size").alias("source_size")), weights, share_percent, most
    )
    earlier = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sums.withColumn("earlier", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)))
        .join(by_source, "source_key")
        .drop("bucket_size")
    )
    inside = (
        Window.partitionBy("source_key", "bucket")
        .orderBy("place", "mix_id", "size")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    timed = (
        sized.withColumn("upto", F.sum("size").over(inside))
        .join(offsets, ["source_key", "bucket"])
        .withColumn("begin", F.col("earlier") + F.col("upto") - F.col("size"))
    )
    whole = F.floor("target").cast("long")
    passes = []
    for epoch in range(most):
        begin = F.col("begin") + F.col("source_size") * epoch
        served = F.greatest(F.lit(0), F.least(F.col("size"), whole - begin)).cast("long")
        share = F.when(F.col("target") > 0, F.col("target"))
        passes.append(
            F.struct(
                F.lit(epoch).alias("epoch"),
                (begin / share).alias("start"),
                ((begin + F.col("size")) / share).alias("finish"),
                served.alias("words"),
            )
        )
    return timed.withColumn("passes", F.array(*passes)).select(
        F.col("mix_id").alias(id),
        "size",
        "source_size",
        "target",
        F.aggregate("passes", F.lit(0).cast("long"), lambda a, p: a + p["words"]).alias("taken"),
        "passes",
        *[f"mix_{c}" for c in keep],
    )


def mixed(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    share_percent: int = 150,
    most: int = 2,
    seed: str = "mix",
) -> DataFrame:
    """The mix itself: one row per document and pass, range-sorted by virtual finish, cut at the budget.

    Columns: ``id``, source, epoch, virtual_start, virtual_finish, words, text. A document under service
    at the cut keeps its first ``words`` words, joined by single spaces; others keep their text.
    """
    served = scheduled(docs, id, text, source, weights, share_percent, most, seed, keep=(text, source))
    copies = served.select(id, "size", f"mix_{text}", f"mix_{source}", F.explode("passes").alias("p")).filter(
        "p.words > 0"
    )
    begun = F.array_join(
        F.slice(F.regexp_extract_all(f"mix_{text}", F.lit(WORD), F.lit(0)), F.lit(1), F.col("p.words").cast("int")), " "
    )
    return copies.select(
        id,
        F.col(f"mix_{source}").alias("source"),
        F.col("p.epoch").alias("epoch"),
        F.col("p.start").alias("virtual_start"),
        F.col("p.finish").alias("virtual_finish"),
        F.col("p.words").alias("words"),
        F.when(F.col("p.words") < F.col("size"), begun).otherwise(F.col(f"mix_{text}")).alias("text"),
    ).orderBy("virtual_finish", "epoch", id)
