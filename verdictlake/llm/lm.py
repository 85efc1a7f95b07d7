"""Language-model scores from a log-frequency Bloom filter.

Counts of words and of word pairs are quantised on a log scale: an n-gram with level q puts q
entries, one for each level up to q, into a Bloom filter. Asking for level 1, 2, ... until an entry
is missing gives the level back, never too low and rarely too high. The filter grows with the tokens,
so no task holds it whole: texts are packed in chunks, the distinct n-grams of each chunk travel once,
with their counts in the training texts, to the task that makes their part of the filter; it asks the
part for all of them, and the levels travel back to the chunk. What is kept of a chunk are the levels of
each token, from which mixing weights are chosen and scores taken without the text.

The score mixes the smoothed probability of a word with its share after the word before
it; the mixing weights depend on how often that word was seen and are chosen on all training
documents with each token's own occurrence taken off: tokens are counted by class and by the ratio of
both shares, and the counts give the likelihood of every weight.

The plain base score needs the exact count of every token. Words at or above a count that keeps
the list within ``HEAD`` entries are looked up in a broadcast list; the others are joined.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdictlake.llm.shared import saved, settings
from verdictlake.llm.text import Words, mix, slices, words

#: The token behind the last word. Words hold no space, so no word equals it.
END = " "
END_HASH = np.uint64(0x1D8AF066E2C5B9A7)

PROBES = 4
BITS_PER_TOKEN = 6
#: Bits of the filter that a task makes and asks at once, 1 MB: about four slices.
MOST_BITS = 1 << 23
#: N-grams in a slice of the filter, about.
SLICE_GRAMS = 400_000
#: N-grams that are asked at once.
BLOCK = 1 << 14
#: Bytes that a row of n-grams takes besides them, about.
ROW_BYTES = 64
#: Ratio of neighbouring levels for words and pairs, and levels that any 64-bit count stays within.
BASES = (1.1, 1.5)
LEVELS = (460, 110)

HEAD = 250_000
MIXES = np.array([0.0, 0.01, 0.02, 0.04, 0.07, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95])
CONTEXTS = 12
#: Classes of the ratio of both shares: class 0 is no pair, the others have eight an octave.
RATIOS = 1 + 8 * 128

#: Bytes of text that are counted at once, and of a chunk; tokens scored at once, which takes many numbers per token.
TEXT_SLICE = 1 << 22
SCORE_SLICE = 1 << 22
SCORE_TOKENS = 1 << 17

LEAN = {
    # Else the shuffles of written steps stay on disk until the driver collects its garbage.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    # Rows of n-grams and chunks are large: 2000 of them, or Spark's 64 MB, are much for each task.
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}
#: Of Parquet files of compressed chunks: else a page has a hundred of them at least, and is compressed again outside the heap.
LARGE_ROWS = {"compression": "none", "parquet.page.size.row.check.min": "1"}


def level(count: np.ndarray, kind: int) -> np.ndarray:
    return (1 + np.floor(np.log(np.maximum(count, 1)) / math.log(BASES[kind]) + 1e-9)).astype(np.int64)


def value_of_levels(kind: int) -> np.ndarray:
    """The mean of the whole numbers of each level; 0 for level 0."""
    base, out = BASES[kind], [0.0]
    for q in range(1, LEVELS[kind] + 1):
        low, high = math.ceil(base ** (q - 1) - 1e-9), math.ceil(base**q - 1e-9) - 1
        out.append((low + high) / 2 if high >= low else base ** (q - 0.5))
    return np.array(out)


def slice_of(gram: np.ndarray, n_slices: int) -> np.ndarray:
    """The slice of each n-gram; sorted n-grams go through the slices in order."""
    return (gram >> np.uint64(32)) * np.uint64(n_slices) >> np.uint64(32)


@dataclass
class Filter:
    """64-bit words in slices. An n-gram's entries all lie in the slice its hash names, each in one word.

    ``bits`` begin with slice ``first``.
    """

    bits: np.ndarray
    slices: int
    slice_words: int
    first: int = 0

    def begin(self, gram: np.ndarray) -> np.ndarray:
        return (slice_of(gram, self.slices) - np.uint64(self.first)) * np.uint64(self.slice_words)

    def entry(self, gram: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
        """(word inside the slice, hash whose lowest bits name the bits of the word) of the entries for level q."""
        value = mix(gram + np.uint64(0x9E3779B97F4A7C15 * q & (1 << 64) - 1))
        return (value >> np.uint64(32)) * np.uint64(self.slice_words) >> np.uint64(32), value

    def places(self, gram: np.ndarray, q: int) -> Iterator[np.ndarray]:
        """Bit numbers inside the slice of the entries for level q, one array per probe."""
        word, value = self.entry(gram, q)
        for k in range(PROBES):
            yield word * np.uint64(64) + (value >> np.uint64(6 * k) & np.uint64(63))

    def levels(self, gram: np.ndarray, kind: int) -> np.ndarray:
        """Levels by asking one after the other; 0 for n-grams without an entry."""
        gram, back = np.unique(gram, return_inverse=True)
        return self.levels_sorted(gram, kind)[back]

    def levels_sorted(self, gram: np.ndarray, kind: int) -> np.ndarray:
        # N-grams are in the order of their slices: a block's bits stay in the processor's cache.
        q = np.zeros(len(gram), dtype=np.int64)
        for block in range(0, len(gram), BLOCK):
            q[block : block + BLOCK] = self._asked(gram[block : block + BLOCK], kind)
        return q

    def _asked(self, gram: np.ndarray, kind: int) -> np.ndarray:
        q = np.zeros(len(gram), dtype=np.int64)
        alive, begin, one = np.arange(len(gram)), self.begin(gram), np.uint64(1)
        for ask in range(1, LEVELS[kind] + 1):
            word, value = self.entry(gram, ask)
            wanted = one << (value & np.uint64(63))
            for k in range(1, PROBES):
                wanted |= one << (value >> np.uint64(6 * k) & np.uint64(63))
            hit = self.bits[begin + word] & wanted == wanted
            alive, gram, begin = alive[hit], gram[hit], begin[hit]
            if not len(alive):
                break
            q[alive] = ask
        return q

    def counts(self, gram: np.ndarray, kind: int) -> np.ndarray:
        """Quantised counts."""
        return value_of_levels(kind)[self.levels(gram, kind)]


def token_hashes(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all tokens, ends included, place of each text's first token); n + 1 places."""
    n_texts = len(w.first) - 1
    first = w.first + np.arange(n_texts + 1)
    out = np.full(len(w.start) + n_texts, END_HASH, dtype=np.uint64)
    out[np.arange(len(w.start)) + w.doc] = w.hash
    return out, first


def unigram(token: np.ndarray) -> np.ndarray:
    return mix(token ^ np.uint64(0x27D4EB2F165667C5))


def pairs(token: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each token with the one before it, whether there is one in its text)."""
    inside = np.ones(len(token), dtype=bool)
    inside[first[:-1]] = False
    before = np.empty_like(token)
    before[:1] = 0
    before[1:] = token[:-1]
    return mix(before * np.uint64(0xC2B2AE3D27D4EB4F) + token), inside


def context_class(count: np.ndarray) -> np.ndarray:
    return np.minimum(np.floor(np.log2(np.maximum(count, 1))).astype(np.int64), CONTEXTS - 1)


def shares(single: np.ndarray, double: np.ndarray, first: np.ndarray, total: int, distinct: int, own: int):
    """For each token its smoothed share, its share after the word before it, and that word's class.

    ``single`` and ``double`` are the levels of each token and of the pair that it ends; ``first`` are the
    places of the texts' first tokens. ``own`` is taken off every count: 1 for texts that were counted, 0
    for others.
    """
    seen = np.maximum(value_of_levels(0)[single] - own, 0)
    plain = (seen + 1) / (total + distinct + 1)
    inside = np.ones(len(single), dtype=bool)
    inside[first[:-1]] = False
    before = np.ones(len(single))
    before[1:] = np.maximum(seen[:-1], 1)
    pair = np.maximum(value_of_levels(1)[double] - own, 0)
    # A pair is no more frequent than its words; this also undoes most false hits.
    pair = np.where(inside, np.minimum(pair, np.minimum(seen, before)), 0)
    return plain, pair / before, np.where(inside, context_class(before), 0), inside


def lowered(docs: DataFrame, id: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(id).alias("doc"), body.cast("binary").alias("text"))


def binaries(data: np.ndarray, edges: np.ndarray) -> pa.Array:
    """Cells of bytes: cell i is ``data[edges[i] : edges[i + 1]]``."""
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(data)])


def spelt(w: Words, which: np.ndarray) -> pa.Array:
    """The words of those numbers; the number behind the last word is the end token."""
    # Each word with the space behind it, of which the last byte is left out.
    data = np.append(w.data, np.frombuffer(2 * END.encode(), np.uint8))
    edges = np.append(w.start, [len(w.data), len(data)])
    return pc.binary_slice(binaries(data, edges).take(pa.array(which, pa.int64())), 0, -1)


def vocabulary(training: DataFrame) -> DataFrame:
    """(word, n) of all tokens; a text's end is the word of one space. Counted per batch before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(0), TEXT_SLICE):
                w = words(batch.column(0).slice(a, b - a), lower=True)
                _, where, n = np.unique(w.hash, return_index=True, return_counts=True)
                own = spelt(w, np.append(where, len(w.start)))
                yield pa.RecordBatch.from_arrays([own, pa.array(np.append(n, b - a))], names=["word", "n"])

    counted = training.select("text").mapInArrow(count, "word binary, n bigint")
    return saved(counted.groupBy("word").agg(F.sum("n").alias("n")), "vocabulary")


def word_hashes(column: pa.Array) -> np.ndarray:
    """Hashes of single words, as ``words`` gives them; the end token's is its own."""
    w = words(column)
    out = np.full(len(column), END_HASH, dtype=np.uint64)
    out[np.diff(w.first) == 1] = w.hash
    return out


def packed(docs: DataFrame) -> DataFrame:
    """(chunk, data) of doc, text and held: about ``SCORE_SLICE`` bytes of text with their ids as one compressed Arrow stream."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, options = TaskContext.get().partitionId() << 40, pa.ipc.IpcWriteOptions(compression="zstd")
        for held in together(batches):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=options) as to:
                to.write_table(pa.Table.from_batches(held).combine_chunks())
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["chunk", "data"])
            number += 1

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
        held, size = [], 0
        for batch in batches:
            for a, b in slices(batch.column(1), SCORE_SLICE):
                own = batch.slice(a, b - a)
                # A byte more for each text's end token: a chunk of empty texts has its bound too.
                more = len(own) + (pc.sum(pc.binary_length(own.column(1))).as_py() or 0)
                if held and size + more > SCORE_SLICE:
                    yield held
                    held, size = [], 0
                held.append(own)
                size += more
        if held:
            yield held

    return saved(docs.select("doc", "text", "held").mapInArrow(pack, "chunk bigint, data binary"), "chunks", LARGE_ROWS)


def unpacked(data: pa.Scalar) -> pa.RecordBatch:
    return pa.ipc.open_stream(data.as_buffer()).read_next_batch()


def distinct_grams(token: np.ndarray, first: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray], np.ndarray]:
    """(distinct n-grams in order, place of each token's among them) for words and for pairs; tokens that end a pair."""
    one, back = np.unique(token, return_inverse=True)
    word = unigram(one)
    order = np.argsort(word)
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    gram, inside = pairs(token, first)
    return (word[order], rank[back]), np.unique(gram[inside], return_inverse=True), inside


def travelling(gram: np.ndarray, n: np.ndarray, kind: int, chunk: int, n_slices: int, part_slices: int) -> pa.RecordBatch:
    """Rows of sorted distinct n-grams, each of one part of the filter.

    ``first`` is a row's first n-gram, ``at`` its place among those given. ``grams`` has the difference of
    each n-gram to the one before it, in so few bytes that the rare larger differences begin a row of
    their own; ``counts`` has as many bytes a count as they need.
    """
    part = slice_of(gram, n_slices).astype(np.int64) // part_slices
    step = np.diff(gram, prepend=gram[:1])
    new = np.diff(part, prepend=-1) != 0
    step[new] = 0
    # Eight bytes hold every difference.
    cost = [len(gram) * w + ROW_BYTES * (w < 8 and np.count_nonzero(step >> np.uint64(8 * w))) for w in range(1, 9)]
    width = 1 + int(np.argmin(cost))
    if width < 8:
        new |= step >> np.uint64(8 * width) > 0
    begin = np.flatnonzero(new)
    step[begin] = 0
    edges = np.append(begin, len(gram))
    wide = least_bytes(n)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(part[begin]),
            pa.array(np.full(len(begin), chunk)),
            pa.array(np.full(len(begin), kind, dtype=np.int32)),
            pa.array(begin),
            pa.array(gram[begin].view(np.int64)),
            pa.array(np.diff(edges)),
            binaries(low_bytes(step, width), edges * width),
            binaries(low_bytes(n, wide), edges * wide),
        ],
        names=["part", "chunk", "kind", "at", "first", "size", "grams", "counts"],
    )


def least_bytes(value: np.ndarray) -> int:
    return (int(value.max(initial=0)).bit_length() + 7) // 8


def low_bytes(value: np.ndarray, width: int) -> np.ndarray:
    return np.ascontiguousarray(value.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).reshape(-1)


def from_low_bytes(cells: list[bytes], size: np.ndarray) -> np.ndarray:
    """Numbers of cells of ``size`` numbers each, which may differ in the bytes of a number."""
    out = np.zeros((int(size.sum()), 8), dtype=np.uint8)
    width = np.array([len(c) for c in cells], dtype=np.int64) // size
    of = np.repeat(width, size)
    for w in np.unique(width).tolist():
        data = b"".join(c for c, own in zip(cells, width.tolist(), strict=True) if own == w)
        out[of == w, :w] = np.frombuffer(data, np.uint8).reshape(-1, w) if w else 0
    return out.reshape(-1).view("<u8").astype(np.uint64, copy=False)


def arrived(first: np.ndarray, size: np.ndarray, cells: list[bytes]) -> np.ndarray:
    """The n-grams of rows as ``travelling`` makes them."""
    run = np.cumsum(from_low_bytes(cells, size), dtype=np.uint64)
    begin = np.cumsum(size) - size
    return run + np.repeat(first.view(np.uint64) - run[begin], size)


def levels_of(chunks: DataFrame, vocab: DataFrame, tokens: int, most_bits: int = MOST_BITS) -> DataFrame:
    """(chunk, kind, at, levels) of the distinct n-grams of every chunk, in their order: two bytes a word, one a pair.

    A task makes a part of the filter, of fixed size, from the counts of its words and pairs in the
    training texts, and asks it for the n-grams of all chunks.
    """
    n_slices = max(1, math.ceil(1.2 * tokens / SLICE_GRAMS))
    slice_words = max(16, BITS_PER_TOKEN * tokens // n_slices // 64)
    part_slices = max(1, most_bits // (64 * slice_words))

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append((unigram(word_hashes(batch.column(0))), np.asarray(batch.column(1))))
            size += len(batch)
            if size >= SLICE_GRAMS:
                yield counted(held)
                held, size = [], 0
        if size:
            yield counted(held)

    def counted(held) -> pa.RecordBatch:
        gram, n = (np.concatenate([x[k] for x in held]) for k in (0, 1))
        order = np.argsort(gram)
        return travelling(gram[order], n[order], 0, -1, n_slices, part_slices)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, chunk in enumerate(batch.column(0).to_pylist()):
                texts = unpacked(batch.column(1)[row])
                token, first = token_hashes(words(texts.column(1), lower=True))
                (word, _), (pair, back), inside = distinct_grams(token, first)
                yield travelling(word, np.zeros(len(word), dtype=np.int64), 0, chunk, n_slices, part_slices)
                if len(pair):
                    counts = ~np.repeat(np.asarray(texts.column(2).to_numpy(zero_copy_only=False), dtype=bool), np.diff(first))[inside]
                    n = np.bincount(back[counts], minlength=len(pair))
                    yield travelling(pair, n, 1, chunk, n_slices, part_slices)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, current = [], None
        for batch in batches:
            part = np.asarray(batch.column(0))
            edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if held and part[a] != current:
                    yield from answered(current, pa.Table.from_batches(held))
                    held = []
                current = part[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from answered(current, pa.Table.from_batches(held))

    def answered(part: int, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        made = Filter(np.zeros(0, np.uint64), n_slices, slice_words, int(part) * part_slices)
        bits = np.zeros(part_slices * slice_words * 64, dtype=bool)
        asked = []
        for kind in (0, 1):
            own = rows.filter(pc.equal(rows["kind"], kind))
            size = own["size"].to_numpy()
            back = arrived(own["first"].to_numpy(), size, own["grams"].to_pylist())
            n = from_low_bytes(own["counts"].to_pylist(), size).astype(float)
            one, back = np.unique(back, return_inverse=True)
            count = np.bincount(back, weights=n, minlength=len(one))
            asked.append((own["chunk"].to_numpy(), own["at"].to_numpy(), size, one, back))
            put = one[count > 0]
            q = np.minimum(level(count[count > 0], kind), LEVELS[kind])
            upto = 1
            while len(put):
                begin = made.begin(put) * np.uint64(64)
                for place in made.places(put, upto):
                    bits[(begin + place).astype(np.int64)] = True
                upto += 1
                on = q >= upto
                put, q = put[on], q[on]
        made.bits = np.packbits(bits, bitorder="little").view(np.uint64)
        for kind, (chunk, at, size, one, back) in enumerate(asked):
            wide = 2 - kind
            q = made.levels_sorted(one, kind).astype(f"<u{wide}")[back]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(chunk),
                    pa.array(np.full(len(chunk), kind, dtype=np.int32)),
                    pa.array(at),
                    binaries(q.view(np.uint8), np.append(0, np.cumsum(size)) * wide),
                ],
                names=["chunk", "kind", "at", "levels"],
            ).filter(pa.array(chunk >= 0))

    rows = "part bigint, chunk bigint, kind int, at bigint, first bigint, size bigint, grams binary, counts binary"
    asks = vocab.select("word", "n").mapInArrow(single, rows).unionByName(chunks.mapInArrow(ask, rows))
    dealt = asks.repartition("part").sortWithinPartitions("part")
    return saved(dealt.mapInArrow(answer, "chunk bigint, kind int, at bigint, levels binary"), "answers")


def head_of(vocab: DataFrame, limit: int = HEAD) -> tuple[np.ndarray, np.ndarray, int]:
    """(sorted hashes, counts, least count) of the words frequent enough that at most ``limit`` are.

    Counts are grouped, one by one up to 1000 and 64 to an octave above, so there are some thousand
    groups at most; a group is listed whole or not at all.
    """
    group = F.when(F.col("n") > 1000, F.lit(1000) + F.ceil(64 * F.log2(F.col("n") / 1000))).otherwise(F.col("n"))
    held = vocab.groupBy(group.alias("group")).agg(F.min("n").alias("n"), F.count(F.lit(1)).alias("words")).collect()
    total, least = 0, (1 << 63) - 1
    for row in sorted(held, key=lambda r: -r.group):
        if total + row.words > limit:
            break
        total, least = total + row.words, row.n

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value, n = word_hashes(batch.column(0)), np.asarray(batch.column(1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([value.tobytes()], pa.binary()), pa.array([n.tobytes()], pa.binary())], names=["h", "n"]
            )

    rows = vocab.filter(F.col("n") >= least).select("word", "n").mapInArrow(pack, "h binary, n binary").collect()
    value = np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(r.h, np.uint64) for r in rows]])
    n = np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(r.n, np.int64) for r in rows]])
    order = np.argsort(value)
    return value[order], n[order], least


def cells_of(column: pa.Array, dtype: str) -> np.ndarray:
    """All numbers of cells of bytes."""
    edges = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[edges[0] : edges[-1]].view(dtype)


def levelled(chunks: DataFrame, levels: DataFrame, doc: str, space: int, known_hash: np.ndarray, known_n: np.ndarray) -> DataFrame:
    """A row per document: row, doc, held, n_tokens, n_listed, base, the levels of its tokens and of the pairs they end, rare words.

    ``n_listed`` and ``base`` are of the words in the list of frequent ones; ``rare`` are all others.
    """
    sent = chunks.sparkSession.sparkContext.broadcast((known_hash, known_n))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, current, texts, found = TaskContext.get().partitionId() << 40, None, None, None
        for batch in batches:
            chunk, kind = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for k, of in enumerate(kind):
                if chunk[k] != current:
                    if texts is not None:
                        yield of_chunk(row, texts, found)
                        row += len(texts)
                    current, texts, found = chunk[k], None, ([], [])
                if of < 0:
                    texts = unpacked(batch.column(3)[k])
                else:
                    found[of].append(batch.column(3)[k].as_py())
        if texts is not None:
            yield of_chunk(row, texts, found)

    def of_chunk(row: int, texts: pa.RecordBatch, found: tuple[list[bytes], list[bytes]]) -> pa.RecordBatch:
        w = words(texts.column(1), lower=True)
        token, first = token_hashes(w)
        (word, of_word), (pair, of_pair), inside = distinct_grams(token, first)
        single, double = np.frombuffer(b"".join(found[0]), "<u2"), np.frombuffer(b"".join(found[1]), np.uint8)
        if (len(single), len(double)) != (len(word), len(pair)):
            raise ValueError("a chunk's n-grams are not those that were asked for")
        pairs_ = np.zeros(len(token), dtype=np.uint8)
        pairs_[inside] = double[of_pair]
        known_hash, known_n = sent.value
        if len(known_hash):
            at = np.minimum(np.searchsorted(known_hash, token), len(known_hash) - 1)
            hit = known_hash[at] == token
            n = np.where(hit, known_n[at], 0)
        else:
            hit, n = np.zeros(len(token), dtype=bool), np.zeros(len(token), dtype=np.int64)
        base = np.where(hit, np.log10((n + 1) / space), 0.0)
        # Tokens that are not in the list travel as text, to be joined with the exact counts.
        doc_of = np.repeat(np.arange(len(texts)), np.diff(first))
        lost = np.flatnonzero(~hit)
        end = lost == first[doc_of[lost] + 1] - 1
        rare = spelt(w, np.where(end, len(w.start), lost - doc_of[lost]))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.arange(row, row + len(texts))),
                texts.column(0),
                texts.column(2),
                pa.array(np.diff(first)),
                pa.array(np.add.reduceat(hit.astype(np.int64), first[:-1])),
                pa.array(np.add.reduceat(base, first[:-1])),
                binaries(np.ascontiguousarray(single[of_word]).view(np.uint8), 2 * first),
                binaries(pairs_, first),
                pa.ListArray.from_arrays(pa.array(np.searchsorted(lost, first), pa.int32()), rare),
            ],
            names=["row", "doc", "held", "n_tokens", "n_listed", "base", "singles", "doubles", "rare"],
        )

    sources = chunks.select("chunk", F.lit(-1).alias("kind"), F.lit(0).cast("long").alias("at"), "data")
    dealt = sources.union(levels.select("chunk", "kind", "at", "levels")).repartition("chunk").sortWithinPartitions("chunk", "kind", "at")
    rows = f"row bigint, doc {doc}, held boolean, n_tokens bigint, n_listed bigint, base double, singles binary, doubles binary, rare array<binary>"
    return saved(dealt.mapInArrow(read, rows), "levels")


def token_levels(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, row behind the last, levels of words, levels of pairs, places of first tokens) of a batch with singles and doubles, by some ``SCORE_TOKENS`` tokens."""
    single, double = batch.column(batch.schema.get_field_index("singles")), batch.column(batch.schema.get_field_index("doubles"))
    for a, b in slices(double, SCORE_TOKENS):
        length = np.asarray(pc.binary_length(double.slice(a, b - a)))
        yield a, b, cells_of(single.slice(a, b - a), "<u2"), cells_of(double.slice(a, b - a), "u1"), np.append(0, np.cumsum(length, dtype=np.int64))


def choose_mixes(training: DataFrame, tokens: int, distinct: int) -> np.ndarray:
    """The mixing weight of each context class that gives the training documents the highest likelihood.

    A weight m adds log(1 + m (r - 1)) to a token's log share, where r is its share after the word before
    it over its plain share; tokens are counted by class and by r in steps of an eighth of an octave.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(CONTEXTS * RATIOS, dtype=np.int64)
        for batch in batches:
            for _, _, single, double, first in token_levels(batch):
                plain, after, kind, inside = shares(single, double, first, tokens, distinct, own=1)
                ratio = np.zeros(len(single), dtype=np.int64)
                some = inside & (after > 0)
                ratio[some] = np.clip(np.floor(8 * np.log2(after[some] / plain[some])) + 8 * 64 + 1, 1, RATIOS - 1)
                held += np.bincount((kind * RATIOS + ratio)[inside], minlength=len(held))
        cell = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(held[cell])], names=["cell", "n"])

    cells = training.select("singles", "doubles").mapInArrow(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(CONTEXTS * RATIOS)
    for row in cells:
        n[row.cell] = row.n
    ratio = np.append(0.0, 2.0 ** ((np.arange(RATIOS - 1) + 0.5) / 8 - 64))
    gain = n.reshape(CONTEXTS, RATIOS) @ np.log1p(MIXES * (ratio[:, None] - 1))
    return np.where(n.reshape(CONTEXTS, RATIOS).any(axis=1), MIXES[gain.argmax(axis=1)], 0.1)


def scores(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    modulus: int = 7,
    rest: int = 2,
    head: int = HEAD,
    most_bits: int = MOST_BITS,
) -> DataFrame:
    """One row per row of ``docs``: ``id``, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Documents whose crc32 of the id as text leaves ``rest`` are held out; the model and all counts come
    from the others, whole. Tokens are lower-cased (A-Z) words and one end of text. base_score adds
    log10((c + 1) / (N + V + 1)) over the tokens from exact counts; score is the log10 probability under
    the filter's model. A null or empty text is its end token; a null id hashes as empty text; repeated
    rows count as often as they occur. Without training documents every token is unknown. A task holds
    about ``most_bits`` of the filter, one slice at least; the scores do not depend on it.
    """
    held = F.crc32(F.coalesce(F.col("doc").cast("string"), F.lit("")).cast("binary")) % modulus == rest
    narrow = lowered(docs, id, text).withColumn("held", held)
    with settings(docs.sparkSession, LEAN):
        vocab = vocabulary(narrow.filter(~F.col("held")))
        totals = vocab.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
        tokens, distinct = int(totals.n), int(totals.v)
        space = tokens + distinct + 1
        top_hash, top_n, _ = head_of(vocab, head)
        chunks = packed(narrow)
        kind = narrow.schema["doc"].dataType.simpleString()
        levels = levels_of(chunks, vocab, tokens, most_bits)
        done = levelled(chunks, levels, kind, space, top_hash, top_n)
    mixes = choose_mixes(done.filter(~F.col("held")), tokens, distinct)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, single, double, first in token_levels(batch):
                plain, after, of, inside = shares(single, double, first, tokens, distinct, own=0)
                share = np.where(inside, mixes[of], 0.0)
                value = np.log10((1 - share) * plain + share * after)
                kept = [batch.column(k).slice(a, b - a) for k in range(6)]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array(np.add.reduceat(value, first[:-1]))],
                    names=["row", "doc", "held", "n_tokens", "n_listed", "base", "score"],
                )

    scored = done.drop("rare").mapInArrow(
        score, f"row bigint, doc {kind}, held boolean, n_tokens bigint, n_listed bigint, base double, score double"
    )
    rare = done.select("row", F.explode("rare").alias("word")).groupBy("row", "word").agg(F.count(F.lit(1)).alias("times"))
    found = rare.join(vocab, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    added = found.groupBy("row").agg(
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more"),
        F.sum(F.col("times") * F.log10((F.col("n") + 1) / F.lit(space))).alias("rest"),
    )
    return scored.join(added, "row", "left").select(
        F.col("doc").alias(id),
        F.col("held").alias("held_out"),
        "n_tokens",
        (F.col("n_listed") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest", F.lit(0.0))).alias("base_score"),
        "score",
    )
