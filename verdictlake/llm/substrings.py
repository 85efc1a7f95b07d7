"""Removal of word sequences that repeat anywhere, found with FM-indexes over content-defined shards.

Identical windows must meet in one shard without every document visiting every shard. The key of
a window is the smallest hash of the ``ANCHOR``-word sequences in it, which equal windows share.
Neighbouring windows of a document with the same key form one segment of text. A window can only
repeat if its key does, so segments of keys that occur once go no further. Equal segments are
counted before and after the shuffle; a shard holds distinct segments.

In a shard the segments are one sequence of word numbers, indexed by its Burrows-Wheeler transform
in a wavelet matrix of packed bits. All windows are searched backwards together, one word a step:
the size of the suffix interval is the number of places where the part read so far occurs, and a
window is dropped once that is one. What is left after a full window is repeated; the union of
repeated windows are the intervals to remove. A key that alone would overfill a shard, as of a
passage that very many documents share, has its windows dealt by their own names instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdictlake.llm.shared import saved
from verdictlake.llm.text import Words, runs, slices, words

WINDOW = 35
ANCHOR = 8
#: Words of distinct segments in a shard, on average.
SHARD_WORDS = 400_000
#: Bits of the filter of repeated keys that is sent to all tasks: 16 MB at any input size.
FILTER_BITS = 1 << 27
FILTER_SLICES = 64
TEXT_SLICE = 1 << 21
#: A key with more distinct segments than this does not fit one shard: its windows are dealt one by
#: one. At most ``HOT_KEYS`` keys are treated so, which bounds the list of them that is broadcast.
HOT_SEGMENTS = 8000
HOT_KEYS = 1_000_000


class Wavelet:
    """Rank queries on a sequence of numbers below 2**bits, with packed bits and a count per 64 of them."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.levels = bits, []
        values = values.astype(np.int64)
        for level in range(bits - 1, -1, -1):
            bit = (values >> level) & 1
            padded = np.zeros((len(values) // 64 + 1) * 64, dtype=np.uint8)
            padded[: len(values)] = bit
            packed = np.packbits(padded, bitorder="little").view("<u8")
            counts = np.zeros(len(packed), dtype=np.int64)
            np.cumsum(np.bitwise_count(packed[:-1]), out=counts[1:])
            zeros = len(values) - int(bit.sum())
            self.levels.append((packed, counts, zeros))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def descend(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Where position ``place`` lies among the occurrences of ``symbol``, counted from the matrix's start."""
        for k, (packed, counts, zeros) in enumerate(self.levels):
            word = place >> 6
            below = (np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)
            ones = counts[word] + np.bitwise_count(packed[word] & below)
            bit = (symbol >> (self.bits - 1 - k)) & 1
            place = np.where(bit == 1, zeros + ones, place - ones)
        return place


class FMIndex:
    """Counts of the places of word sequences up to ``depth`` in a sequence of numbers; 0 separates texts."""

    def __init__(self, text: np.ndarray, depth: int):
        n = len(text)
        rank, length = text.astype(np.int64), 1
        order = np.argsort(rank, kind="stable")
        while length < depth:
            second = np.zeros(n, dtype=np.int64)
            second[: n - length] = rank[length:] + 1
            pair = rank * (int(second.max()) + 1) + second
            order = np.argsort(pair, kind="stable")
            ordered = pair[order]
            fresh = np.empty(n, dtype=np.int64)
            fresh[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
            rank, length = fresh, 2 * length
            if rank.max() == n - 1:
                break
        before = text[order - 1]  # of the first suffix: the last number, a separator
        symbols = int(text.max()) + 1
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        self.wavelet = Wavelet(before, max(1, (symbols - 1).bit_length()))
        numbers = np.arange(symbols)
        self.base = self.wavelet.descend(numbers, np.zeros(symbols, dtype=np.int64))
        self.size = n

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix interval of symbol + sequence, from that of the sequence."""
        both = self.wavelet.descend(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        offset = self.first[symbol] - self.base[symbol]
        return both[: len(symbol)] + offset, both[len(symbol) :] + offset

    def repeated(self, text: np.ndarray, ends: np.ndarray, width: int) -> np.ndarray:
        """Which of the sequences of ``width`` numbers that end at ``ends`` have two places or more."""
        alive = np.arange(len(ends))
        low, high = np.zeros(len(ends), dtype=np.int64), np.full(len(ends), self.size, dtype=np.int64)
        for k in range(width):
            low, high = self.step(text[ends[alive] - 1 - k], low, high)
            on = high - low > 1
            alive, low, high = alive[on], low[on], high[on]
        out = np.zeros(len(ends), dtype=bool)
        out[alive] = True
        return out


def slide(pick, values: np.ndarray, span: int) -> np.ndarray:
    """``pick`` (minimum or maximum) of every ``span`` neighbours."""
    out, have = values, 1
    while 2 * have <= span:
        out, have = pick(out[:-have], out[have:]), 2 * have
    if have < span:
        out = pick(out[: len(values) - span + 1], out[span - have : len(values) - have + 1])
    return out


def least_in_windows(w: Words, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, keys) of all windows inside single texts, and the keys with two places in one segment.

    A key is the least hash of an anchor in the window. Two places of a key in one segment are less
    than a window apart, so among the places that are least in any window they are neighbours.
    """
    grams = runs(w.hash, anchor)
    span = window - anchor + 1
    if len(grams) < span:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    least = slide(np.minimum, grams, span)
    edge = np.zeros(span - 1, dtype=np.uint64)
    places = np.flatnonzero(slide(np.maximum, np.concatenate([edge, least, edge]), span) == grams)
    twice = grams[places[1:]][grams[places[1:]] == grams[places[:-1]]]
    count = np.maximum(np.diff(w.first) - window + 1, 0)
    starts = np.repeat(w.first[:-1], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return starts, least[starts], twice


def segments(w: Words, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first word, word after the last, key) of each run of neighbouring windows with one key, and repeats in one."""
    starts, keys, twice = least_in_windows(w, window, anchor)
    if not len(starts):
        return starts, starts, keys, twice
    cut = np.flatnonzero((np.diff(starts) != 1) | (keys[1:] != keys[:-1])) + 1
    begin, stop = np.concatenate([[0], cut]), np.concatenate([cut, [len(starts)]])
    return starts[begin], starts[stop - 1] + window, keys[begin], twice


def _narrow(docs: DataFrame, id: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(id).alias("doc"), F.xxhash64(body).alias("body"), body.cast("binary").alias("text"))


def repeated_key_filter(docs: DataFrame, window: int, anchor: int) -> np.ndarray:
    """A bit for each hash class of the keys that occur twice or more; ``FILTER_BITS`` in all.

    Every key of every document is counted. Slices of the filter are made by tasks; a slice has a
    fixed size. Keys that share a class with a repeated one pass too, which costs work but no result.
    """

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(0), TEXT_SLICE):
                _, _, key, twice = segments(words(batch.column(0).slice(a, b - a)), window, anchor)
                key, n = np.unique(np.concatenate([key, twice]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], names=["key", "n"])

    size = FILTER_BITS // FILTER_SLICES

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for batch in batches:
            place = np.asarray(batch.column(0))
            for part in np.unique(place // size).tolist():
                mask = made.setdefault(part, np.zeros(size, dtype=bool))
                mask[place[place // size == part] % size] = True
        for part, mask in made.items():
            packed = np.packbits(mask).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([packed], pa.binary())], names=["part", "bits"])

    counted = docs.select("text").mapInArrow(keys, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    places = counted.filter("n > 1").select(F.pmod("key", F.lit(FILTER_BITS)).alias("place"))
    parts = places.repartition(FILTER_SLICES // 2, F.floor(F.col("place") / size)).mapInArrow(bits, "part bigint, bits binary")
    out = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    for row in parts.toLocalIterator():
        out[row.part * size // 8 : (row.part + 1) * size // 8] |= np.frombuffer(row.bits, dtype=np.uint8)
    return out


def repeated_spans(
    docs: DataFrame,
    window: int = WINDOW,
    id: str = "doc_id",
    text: str = "text",
    anchor: int = ANCHOR,
    hot_segments: int = HOT_SEGMENTS,
) -> DataFrame:
    """(doc, body, spans): word intervals [begin, end) covered by windows that occur elsewhere.

    ``doc`` is the id, ``body`` a hash of the text; rows equal in both share one row. Only documents
    with such a window appear.
    """
    spark = docs.sparkSession
    narrow = _narrow(docs, id, text)
    sent = spark.sparkContext.broadcast(repeated_key_filter(narrow, window, anchor))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        for batch in batches:
            for a, b in slices(batch.column(2), TEXT_SLICE):
                w = words(batch.column(2).slice(a, b - a))
                begin, end, key, _ = segments(w, window, anchor)
                place = (key.view(np.int64) % FILTER_BITS).astype(np.int64)
                on = (bits[place >> 3] >> (7 - (place & 7))) & 1 == 1
                begin, end, key = begin[on], end[on], key[on]
                data = w.data.tobytes()
                parts = [
                    data[i:j] for i, j in zip(w.start[begin].tolist(), w.end[end - 1].tolist(), strict=True)
                ]
                doc = np.searchsorted(w.first, begin, side="right") - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(doc + a)),
                        batch.column(1).take(pa.array(doc + a)),
                        pa.array(begin - w.first[doc]),
                        pa.array(key.view(np.int64)),
                        pa.array(parts, pa.binary()),
                    ],
                    names=["doc", "body", "begin", "key", "segment"],
                )

    kind = narrow.schema["doc"].dataType.simpleString()
    found = narrow.mapInArrow(candidates, f"doc {kind}, body bigint, begin bigint, key bigint, segment binary")
    # Two hashes name a segment: 128 bits, so different segments do not share a name.
    found = saved(
        found.withColumn("h1", F.xxhash64("segment")).withColumn("h2", F.xxhash64(F.lit(1), "segment")), "segments"
    )
    total = found.agg(F.sum(F.octet_length("segment"))).first()[0] or 0
    shards = max(1, round(total / 6 / SHARD_WORDS))
    per_key = saved(
        found.select("key", "h1", "h2").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n")), "keys"
    )
    most = max(hot_segments, (per_key.agg(F.sum("n")).first()[0] or 0) // HOT_KEYS)
    hot = F.broadcast(per_key.filter(F.col("n") > most).select("key"))
    cold = found.join(hot, "key", "left_anti")
    distinct = cold.groupBy("h1", "h2", "segment").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("key"))
    placed = distinct.withColumn("shard", F.pmod("key", F.lit(shards))).repartition("shard").sortWithinPartitions("shard")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        shard = None
        for batch in batches:
            keys = np.asarray(batch.column(0))
            edges = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if held and keys[a] != shard:
                    yield _spans(held, window)
                    held = []
                shard = keys[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield _spans(held, window)

    spans = placed.select("shard", "h1", "h2", "segment", "n").mapInArrow(
        search, "h1 bigint, h2 bigint, spans array<bigint>"
    )
    spans = spans.unionByName(_spans_of_hot(found.join(hot, "key", "left_semi"), window))
    hits = found.select("doc", "body", "begin", "h1", "h2").join(spans, ["h1", "h2"])
    moved = F.transform("spans", lambda place: place + F.col("begin"))
    return hits.groupBy("doc", "body").agg(F.flatten(F.collect_list(moved)).alias("spans"))


def _spans_of_hot(found: DataFrame, window: int) -> DataFrame:
    """(h1, h2, spans) of segments whose key has too many for one shard.

    Most of them hold a passage that very many documents share, each in a context of its own, so they
    are all different. Each window gets a 128-bit name of its words; names are counted before and after
    the shuffle, so neither the passage nor its contexts meet in one task.
    """

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = words(batch.column(2))
            first, second = runs(w.hash, window), runs(w.hash * np.uint64(0xA24BAED4963EE407), window)
            count = np.maximum(np.diff(w.first) - window + 1, 0)
            owner = np.repeat(np.arange(len(batch)), count)
            offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            at = w.first[owner] + offset
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(k).take(pa.array(owner)) for k in (0, 1, 3)),
                    pa.array(offset),
                    pa.array(first[at].view(np.int64)),
                    pa.array(second[at].view(np.int64)),
                ],
                names=["h1", "h2", "n", "at", "w1", "w2"],
            )

    one = found.groupBy("h1", "h2", "segment").agg(F.count(F.lit(1)).alias("n"))
    named = one.select("h1", "h2", "segment", "n").mapInArrow(
        name, "h1 bigint, h2 bigint, n bigint, at bigint, w1 bigint, w2 bigint"
    )
    again = named.groupBy("w1", "w2").agg(F.sum("n").alias("places")).filter("places > 1").select("w1", "w2")
    places = named.join(again, ["w1", "w2"]).groupBy("h1", "h2").agg(F.collect_list("at").alias("at"))
    pairs = F.transform(F.array_sort("at"), lambda a: F.array(a, a + window))
    return places.select("h1", "h2", F.flatten(pairs).alias("spans"))


def _spans(held: list[pa.RecordBatch], window: int) -> pa.RecordBatch:
    """Repeated intervals of each segment of a shard, as begin, end, begin, end, ..."""
    column = pa.concat_arrays([b.column(3) for b in held])
    copies = np.concatenate([np.asarray(b.column(4)) for b in held])
    w = words(column)
    _, number = np.unique(w.hash, return_inverse=True)
    length = np.diff(w.first)
    # A separator, number 0, stands behind each segment.
    text = np.zeros(len(number) + len(length), dtype=np.int64)
    text[np.arange(len(number)) + w.doc] = number + 1
    at = w.first[:-1] + np.arange(len(length))
    count = length - window + 1
    owner = np.repeat(np.arange(len(length)), count)
    offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    again = copies[owner] > 1
    look = np.flatnonzero(~again)
    if len(look):
        again[look] = FMIndex(text, window).repeated(text, at[owner[look]] + offset[look] + window, window)
    owner, offset = owner[again], offset[again]
    # Neighbouring windows less than a window apart form one interval.
    fresh = np.ones(len(owner), dtype=bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (offset[1:] - offset[:-1] > window)
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(owner)) - 1 if len(first) else first
    pairs = np.stack([offset[first], offset[last] + window], axis=1).ravel() if len(first) else np.zeros(0, np.int64)
    hit, spans_of = np.unique(owner[first], return_counts=True) if len(first) else (first, first)
    edges = np.concatenate([[0], np.cumsum(2 * spans_of)]).astype(np.int32)
    names = [pa.concat_arrays([b.column(k) for b in held]).take(pa.array(hit)) for k in (1, 2)]
    return pa.RecordBatch.from_arrays(
        [*names, pa.ListArray.from_arrays(pa.array(edges), pa.array(pairs, pa.int64()))], names=["h1", "h2", "spans"]
    )


def without_repeats(
    docs: DataFrame,
    window: int = WINDOW,
    id: str = "doc_id",
    text: str = "text",
    anchor: int = ANCHOR,
    hot_segments: int = HOT_SEGMENTS,
    keep_body: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: ``id``, n_words, n_removed, kept (words left, joined by spaces), kept_sha256.

    With ``keep_body`` a column body follows, the hash of the text that tells rows of one id apart.

    A word is removed if a window of ``window`` consecutive words of its document covers it whose words
    also start anywhere else, in the same document or another; windows are judged on the input. Texts
    are taken whole; a null text has no words; rows repeated as they are repeat each other's text and
    lose every window. An empty table gives no rows.
    """
    spans = repeated_spans(docs, window, id, text, anchor, hot_segments).hint("shuffle_hash")
    narrow = _narrow(docs, id, text)
    same = narrow.doc.eqNullSafe(spans.doc) & (narrow.body == spans.body)
    joined = narrow.join(spans, same, "left").select(narrow.doc, narrow.text, spans.spans, *[narrow.body] * keep_body)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1), TEXT_SLICE):
                part = batch.slice(a, b - a)
                w = words(part.column(1), hashed=False)
                gone = np.zeros(len(w.start) + 1, dtype=np.int64)
                for d, pairs in enumerate(part.column(2)):
                    if pairs.is_valid:
                        places = np.asarray(pairs.values) + w.first[d]
                        np.add.at(gone, places[::2], 1)
                        np.add.at(gone, places[1::2], -1)
                left = np.cumsum(gone)[:-1] == 0
                kept = []
                data = w.data.tobytes()
                for d in range(len(part)):
                    i, j = w.first[d], w.first[d + 1]
                    if left[i:j].all():
                        kept.append(data[w.start[i] : w.end[j - 1]] if j > i else b"")
                    else:
                        own = np.flatnonzero(left[i:j]) + i
                        kept.append(b" ".join([data[s:e] for s, e in zip(w.start[own].tolist(), w.end[own].tolist(), strict=True)]))
                n_words = np.diff(w.first)
                sums = np.concatenate([[0], np.cumsum(~left)])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(n_words),
                        pa.array(sums[w.first[1:]] - sums[w.first[:-1]]),
                        pa.array(kept, pa.binary()).cast(pa.string()),
                        pa.array([hashlib.sha256(k).hexdigest() for k in kept]),
                        *([part.column(3)] if keep_body else []),
                    ],
                    names=[id, "n_words", "n_removed", "kept", "kept_sha256", *["body"] * keep_body],
                )

    kind = narrow.schema["doc"].dataType.simpleString()
    columns = f"`{id}` {kind}, n_words bigint, n_removed bigint, kept string, kept_sha256 string"
    return joined.mapInArrow(cut, columns + ", body bigint" * keep_body)
