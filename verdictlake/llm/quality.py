"""Quality by importance resampling of hashed n-grams.

Two generative models over hashed n-grams are counted: one from good documents (the target), one
from all documents (raw). A document's weight is the mean log ratio of its n-grams under the two.
Documents are then drawn without replacement by Gumbel top-k: each gets weight / temperature plus
Gumbel noise from a hash of its id, and the k largest stay.

The n-grams are single words; and one, two and three neighbours of the words' shapes. A shape is
the run-length-free pattern of letter cases, digits and other characters, marked if the word
equals the one before it or if the pair of words was met earlier in the text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdictlake.llm.shared import saved
from verdictlake.llm.text import Words, _hashes, mix, slices, words

BUCKETS = 1 << 14
#: Labelled documents that the target model and the cut are fitted on, at most.
LABELLED = 20_000
TEMPERATURE = 0.01
SMOOTHING = 1.0
TEXT_SLICE = 1 << 21

#: Classes of bytes in a shape: A, a, 0 and other bytes as they are.
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[ord("A") : ord("Z") + 1] = ord("A")
_CLASS[ord("a") : ord("z") + 1] = ord("a")
_CLASS[128:] = ord("a")
_CLASS[ord("0") : ord("9") + 1] = ord("0")


def shapes(w: Words) -> np.ndarray:
    """A hash of each word's shape."""
    kind = _CLASS[w.data]
    keep = np.ones(len(kind), dtype=bool)
    keep[1:] = kind[1:] != kind[:-1]
    kind = kind[keep]
    end = np.flatnonzero(kind == 32)
    start = np.empty_like(end)
    start[:1] = 0
    start[1:] = end[:-1] + 1
    return _hashes(kind, start, end)


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of every n-gram of the texts."""
    w = words(column)
    n = len(w.start)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc = w.doc
    same_text = doc[1:] == doc[:-1]
    same_word = np.zeros(n, dtype=bool)
    same_word[1:] = same_text & (w.hash[1:] == w.hash[:-1])
    pair = mix(w.hash[1:] * np.uint64(3) + w.hash[:-1] + mix(doc[1:].astype(np.uint64)))
    met = np.zeros(n, dtype=bool)
    met[1:] = same_text
    _, first = np.unique(pair, return_index=True)
    met[1 + first] = False
    shape = shapes(w) + same_word.astype(np.uint64) * np.uint64(0x5851F42D4C957F2D) + met.astype(np.uint64) * np.uint64(0x14057B7EF767814F)
    two = doc[1:] == doc[:-1]
    three = two[1:] & two[:-1]
    owners = [doc, doc, doc[1:][two], doc[2:][three]]
    grams = [
        w.hash,
        mix(shape + np.uint64(1)),
        mix(shape[:-1] * np.uint64(5) + shape[1:])[two],
        mix(shape[:-2] * np.uint64(25) + shape[1:-1] * np.uint64(7) + shape[2:])[three],
    ]
    # Each kind of n-gram has a quarter of the buckets.
    part = np.uint64(BUCKETS // len(grams))
    return (
        np.concatenate(owners),
        np.concatenate([(g % part).astype(np.int64) + k * int(part) for k, g in enumerate(grams)]),
    )


def _narrow(docs: DataFrame, id: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(id).alias("doc"), F.xxhash64(body).alias("body"), body.cast("binary").alias("text"))


def labelled_sample(labels: DataFrame, id: str, label: str, limit: int) -> DataFrame:
    """(doc, label) of at most ``limit`` labelled ids, by hash; an id with several labels has the smallest."""
    known = labels.filter(F.col(label).isNotNull() & F.col(id).isNotNull())
    one = known.groupBy(F.col(id).alias("doc")).agg(F.min(label).alias("label"))
    return one.orderBy(F.xxhash64("doc", F.lit(7)), "doc").limit(limit)


def log_ratios(docs: DataFrame, sample: DataFrame) -> np.ndarray:
    """log(target / raw) of each bucket. All documents count for raw, the good ones of the sample for target."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
        for batch in batches:
            good = np.asarray(batch.column(1).fill_null(0)) == 1
            for a, b in slices(batch.column(0), TEXT_SLICE):
                doc, bucket = features(batch.column(0).slice(a, b - a))
                raw += np.bincount(bucket, minlength=BUCKETS)
                target += np.bincount(bucket[good[a:b][doc]], minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(BUCKETS)), pa.array(raw), pa.array(target)], names=["bucket", "raw", "target"]
        )

    marked = docs.join(F.broadcast(sample), "doc", "left").select("text", F.col("label").cast("int").alias("label"))
    counted = marked.mapInArrow(count, "bucket bigint, raw double, target double")
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for row in counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():
        raw[row.bucket], target[row.bucket] = row.raw, row.target
    kinds = 4
    out = np.zeros(BUCKETS)
    for k in range(kinds):
        part = slice(k * BUCKETS // kinds, (k + 1) * BUCKETS // kinds)
        size = BUCKETS // kinds
        p = (target[part] + SMOOTHING) / (target[part].sum() + SMOOTHING * size)
        q = (raw[part] + SMOOTHING) / (raw[part].sum() + SMOOTHING * size)
        out[part] = np.log(p / q)
    return out


def weights(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """(doc, body, n_grams, weight) per document: the mean log ratio of its n-grams, 0 for texts without words."""
    sent = docs.sparkSession.sparkContext.broadcast(ratios)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for batch in batches:
            for a, b in slices(batch.column(2), TEXT_SLICE):
                part = batch.slice(a, b - a)
                doc, bucket = features(part.column(2))
                n = np.bincount(doc, minlength=len(part))
                total = np.bincount(doc, weights=table[bucket], minlength=len(part))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(n.astype(np.int64)), pa.array(total / np.maximum(n, 1))],
                    names=["doc", "body", "n_grams", "weight"],
                )

    kind = docs.schema["doc"].dataType.simpleString()
    return docs.mapInArrow(weigh, f"doc {kind}, body bigint, n_grams bigint, weight double")


def best_cut(weight: np.ndarray, good: np.ndarray) -> float:
    """The weight with the fewest wrong decisions on the sample; without both classes, keep all."""
    if good.all() or not good.any():
        return -math.inf
    order = np.argsort(weight, kind="stable")
    weight, good = weight[order], good[order]
    # Cut k rejects the k smallest: good ones among them and bad ones above are wrong.
    wrong = np.concatenate([[0], np.cumsum(good)]) + np.concatenate([np.cumsum(~good[::-1])[::-1], [0]])
    distinct = np.concatenate([[True], weight[1:] != weight[:-1], [True]])
    k = int(np.argmin(np.where(distinct, wrong, len(weight) + 1)))
    if k == 0:
        return -math.inf
    return float(weight[-1]) + 1.0 if k == len(weight) else float((weight[k - 1] + weight[k]) / 2)


def threshold_of_largest(keys: DataFrame, k: int) -> int | None:
    """The k-th largest value of long column key: counts per range, then per range inside the range that holds it."""
    if k <= 0:
        return None
    left, low, width = k, None, 20
    ranged = keys
    while True:
        step = 1 << width
        counts = (
            ranged.groupBy(F.floor(F.col("key") / step).cast("long").alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()
        )
        for row in sorted(counts, key=lambda r: -r.part):
            if left <= row.n:
                low = row.part * step
                break
            left -= row.n
        else:
            return low
        if width == 0:
            return low
        ranged = ranged.filter((F.col("key") >= low) & (F.col("key") < low + step))
        width -= 10


def resampled(
    docs: DataFrame,
    labels: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    label_id: str = "doc_id",
    labelled: int = LABELLED,
    temperature: float = TEMPERATURE,
    k: int | None = None,
    seed: int = 11,
) -> DataFrame:
    """One row per row of ``docs``: doc (the id), body (hash of the text), n_grams, weight, score, kept.

    The target model is counted from documents labelled 1, at most ``labelled`` labelled ids; the raw
    model from all documents. Without ``k``, the number kept is the number of documents whose weight
    is above the cut that decides the sample with the fewest errors. score = weight / temperature +
    Gumbel noise; noise depends on id and seed only, so reruns agree. Rows tied with the k-th score are
    all kept. Texts without words have weight 0; a document without an id has the noise of a null id.
    Without labels nothing is rejected. An empty table gives no rows.
    """
    narrow = _narrow(docs, id, text)
    sample = labelled_sample(labels, label_id, label, labelled)
    ratios = log_ratios(narrow, sample)
    weighed = saved(weights(narrow, ratios), "weights")
    uniform = (F.shiftrightunsigned(F.xxhash64("doc", F.lit(seed)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    scored = weighed.withColumn("score", F.col("weight") / F.lit(temperature) - F.log(-F.log(uniform))).withColumn(
        "key", F.round(F.col("score") * (1 << 20)).cast("long")
    )
    if k is None:
        seen = weighed.join(F.broadcast(sample), "doc").select("weight", "label").collect()
        cut = best_cut(np.array([r.weight for r in seen]), np.array([r.label == 1 for r in seen], dtype=bool)) if seen else -math.inf
        k = weighed.filter(F.col("weight") > F.lit(cut)).count()
    at = threshold_of_largest(scored, k)
    kept = F.lit(False) if at is None else F.col("key") >= F.lit(at)
    return scored.withColumn("kept", kept).drop("key")


def good_documents(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The kept rows of ``docs``, all their columns."""
    kept = resampled(docs, labels, id, text, **options).filter("kept").select("doc", "body").distinct()
    body = F.xxhash64(F.coalesce(docs[text].cast("string"), F.lit("")))
    return docs.join(kept.hint("shuffle_hash"), docs[id].eqNullSafe(kept.doc) & (body == kept.body), "left_semi")
