"""Benchmark passages in documents by spaced-seed hashing, with DataFrame functions only.

A seed looks at fixed places of a window of words and ignores the others, so a window whose
ignored words were changed has the same seed. The masks of a span are chosen so that whichever words
a passing window may have changed, one mask ignores them all, so no such window is missed. Seeds of all windows of the documents are compared
with those of the benchmark; around each hit, the whole window is compared word by word, and it
counts if at least ``similarity`` of its words are equal in place.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"
SPAN = 13
#: Lines of the plane of seven points: any two points lie on one.
LINES = ((0, 1, 2), (0, 3, 4), (0, 5, 6), (1, 3, 5), (1, 4, 6), (2, 3, 6), (2, 4, 5))
SIMILARITY = 0.8
#: Seeds of the benchmark that are broadcast at once, 8 bytes each; more go in further blocks.
SEED_BLOCK = 1_000_000


def tokens(text: Column) -> Column:
    """Hashes of the lower-cased runs of letters and digits."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(WORD), F.lit(0))
    return F.transform(found, lambda word: F.xxhash64(word))


def masks_of(span: int, similarity: float) -> list[tuple[int, ...]]:
    """Places each mask looks at: any places that a passing window may have changed are ignored by one of them.

    Places are dealt to groups and whole groups are ignored. For two changes seven groups and the lines
    of a plane do, each mask looking at 7 or 8 of 13 words.
    """
    changed = span - math.ceil(span * similarity)
    if changed <= 0:
        return [tuple(range(span))]
    if changed == 2 and span >= 7:
        groups, ignored = 7, LINES
    else:
        groups = min(span, changed + 2)
        ignored = list(combinations(range(groups), min(changed, groups - 1)))
    return [tuple(p for p in range(span) if p % groups not in gone) for gone in ignored]


def windows(df: DataFrame, masks: list[tuple[int, tuple[int, ...]]]) -> DataFrame:
    """One row per position and mask of column ``words``: adds at, mask, seed. ``masks``: (span, places)."""
    last = F.size("words") - min(span for span, _ in masks)
    # No filter on the size: pushed below the projection, it would make the words a second time.
    at = df.withColumn("at", F.explode(F.when(last >= 0, F.sequence(F.lit(0), last))))
    columns = []
    for number, (span, places) in enumerate(masks):
        seed = F.xxhash64(F.lit(number), *[F.get("words", F.col("at") + place) for place in places])
        columns += [F.lit(number), F.when(F.col("at") + span <= F.size("words"), seed)]
    return at.select("*", F.stack(F.lit(len(masks)), *columns).alias("mask", "seed")).filter("seed IS NOT NULL")


def window_words(masks: list[tuple[int, tuple[int, ...]]]) -> Column:
    span = F.element_at(F.array(*[F.lit(span) for span, _ in masks]), F.col("mask") + 1)
    return F.slice("words", F.col("at") + 1, span)


def overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    similarity: float = SIMILARITY,
) -> DataFrame:
    """Documents with benchmark passages: doc, body, starts, words_hit, items.

    ``doc`` is the id and ``body`` a hash of the text (rows equal in both share one row); ``starts`` are
    the first words of verified windows, ``words_hit`` how many words they cover, ``items`` all items
    that have one of them. Items under ``SPAN`` words count where ``similarity`` of their words follow in
    place; empty items and null or empty texts never match. Equal windows of the benchmark are compared once.

    Documents are read once for each block of ``SEED_BLOCK`` benchmark seeds, which bounds what is
    broadcast; only windows whose seed is in a block are joined with the benchmark's words.
    """
    items = benchmark.select(F.col(item).alias("item"), tokens(F.col(item_text)).alias("words"))
    short = sorted(
        r.n for r in items.select(F.size("words").alias("n")).filter(f"n > 0 AND n < {SPAN}").distinct().collect()
    )
    whole = masks_of(SPAN, similarity)
    masks = [(n, places) for n in [SPAN, *short] for places in masks_of(n, similarity)]
    # A short mask is for items of exactly that length.
    exact = F.when(F.col("mask") < len(whole), True).otherwise(
        F.size("words") == F.element_at(F.array(*[F.lit(span) for span, _ in masks]), F.col("mask") + 1)
    )
    known = (
        windows(items, masks)
        .filter(exact)
        .select("mask", "seed", "item", window_words(masks).alias("item_words"))
        .groupBy("mask", "seed", "item_words")
        .agg(F.array_sort(F.collect_set("item")).alias("window_items"))
    )
    seeds = known.select("seed").distinct()
    block_count = max(1, math.ceil(seeds.count() / SEED_BLOCK))

    read = docs.select(
        F.col(id).alias("doc"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("body"), tokens(F.col(text)).alias("words")
    )
    hits = []
    for block in range(block_count):
        part = seeds.filter(F.pmod("seed", F.lit(block_count)) == block)
        hits.append(
            windows(read, masks)
            .join(F.broadcast(part), "seed", "left_semi")
            .select("doc", "body", "at", "mask", "seed", window_words(masks).alias("doc_words"))
        )
    found = reduce(DataFrame.unionByName, hits)
    equal = F.zip_with("doc_words", "item_words", lambda a, b: F.when(a == b, 1).otherwise(0))
    same = F.aggregate(equal, F.lit(0), lambda n, one: n + one)
    verified = found.join(known, ["mask", "seed"]).filter(same >= F.ceil(F.size("doc_words") * F.lit(similarity)))
    placed = verified.select("doc", "body", "at", F.size("doc_words").alias("span"), "window_items").distinct()
    covered = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["at"], s["at"] + s["span"] - 1))))
    return (
        placed.groupBy("doc", "body")
        .agg(F.collect_set(F.struct("at", "span")).alias("spans"), F.array_distinct(F.flatten(F.collect_set("window_items"))).alias("items"))
        .select(
            "doc",
            "body",
            F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["at"]))).alias("starts"),
            F.size(covered).cast("long").alias("words_hit"),
            F.array_sort("items").alias("items"),
        )
    )


def marked(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per row of ``docs``: ``id``, contaminated, words_hit, n_items (0 for clean documents)."""
    found = overlaps(docs, benchmark, id, text, **options)
    keys = docs.select(F.col(id), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("doc_body"))
    same = keys[id].eqNullSafe(found.doc) & (keys.doc_body == found.body)
    return keys.join(found, same, "left").select(
        keys[id],
        F.col("words_hit").isNotNull().alias("contaminated"),
        F.coalesce("words_hit", F.lit(0).cast("long")).alias("words_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without a verified benchmark passage, all their columns."""
    found = overlaps(docs, benchmark, id, text, **options).select("doc", "body")
    same = docs[id].eqNullSafe(found.doc) & (F.xxhash64(F.coalesce(docs[text], F.lit(""))) == found.body)
    return docs.join(found, same, "left_anti")
