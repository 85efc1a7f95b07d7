"""Token counts of whole texts, with huge texts encoded in overlapping chunks.

A chunk's encoding is right in its middle and may be wrong near its cut ends. Two neighbouring
chunks share an overlap; where both encodings have a token edge in front of the same space that
follows a non-space character, everything before it can be taken from the first and everything
after it from the second: the vocabulary's word pattern lets a space only begin a piece, so no
token crosses that place in any context. If the overlap has no such place it is widened, in
the end to the whole text.
"""

from __future__ import annotations

import functools
import itertools
import os
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdictlake.llm.text import slices

CHUNK = 1 << 16
OVERLAP = 1 << 8
MEMO = 400_000
LONG = 48

#: Pieces are cut only in front of a blank that follows a non-space character, see the module's text.
PIECE = re.compile(r"[ \t\n\r]*[^ \t\n\r]+(?:(?<=\s)[ \t\n\r]+[^ \t\n\r]+)*|[ \t\n\r]+")
EDGE = re.compile(r"(?<=\S)[ \t\n\r]")


@functools.lru_cache(maxsize=4)
def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def spliced(tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """Token ids of ``text``, put together from overlapping chunks."""
    ids: list[int] = []
    begin, width = 0, overlap
    stop = min(len(text), begin + chunk)
    left = tokenizer.encode(text[begin:stop], add_special_tokens=False)
    while stop < len(text):
        start = max(begin + 1, stop - width)
        ahead = min(len(text), start + max(chunk, 2 * width))
        right = tokenizer.encode(text[start:ahead], add_special_tokens=False)
        place = _meeting(text, begin, left, start, right, stop)
        if place is None:
            width *= 4
            if width >= stop - begin:
                # Nothing in this chunk can be cut: it grows as a whole.
                stop, width = min(len(text), begin + 2 * (stop - begin)), overlap
                left = tokenizer.encode(text[begin:stop], add_special_tokens=False)
            continue
        at, n, m = place
        ids += left.ids[:n]
        begin, stop, width = at, ahead, overlap
        left = _Cut(right, m, at - start) if m else right
    return ids + list(left.ids)


class _Cut:
    """The end of an encoding, seen from a later place in the text."""

    def __init__(self, encoding, tokens: int, chars: int):
        self.ids = encoding.ids[tokens:]
        self.offsets = [(a - chars, b - chars) for a, b in encoding.offsets[tokens:]]


def _meeting(text, begin, left, start, right, stop):
    """(place, tokens of left before it, tokens of right before it) nearest to the middle of the overlap."""
    ours = {a + begin: k for k, (a, _) in enumerate(left.offsets) if a + begin >= start}
    theirs = {a + start: k for k, (a, _) in enumerate(right.offsets) if a + start < stop}
    middle = (start + stop) // 2
    places = [
        p for p in ours.keys() & theirs.keys() if start < p < stop and EDGE.match(text, p)
    ]
    if not places:
        return None
    at = min(places, key=lambda p: abs(p - middle))
    return at, ours[at], theirs[at]


class Counter:
    """Token counts of texts. Short pieces met lately are remembered, up to twice ``MEMO`` of them."""

    def __init__(self, tokenizer, chunk: int = CHUNK, overlap: int = OVERLAP):
        self.tokenizer, self.chunk, self.overlap = tokenizer, chunk, overlap
        self.memo: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def __call__(self, texts: list[str]) -> list[int]:
        pieces = [PIECE.findall(t) if len(t) <= self.chunk else None for t in texts]
        if len(self.memo) > MEMO:
            self.memo, self.older = {}, self.memo
        memo, older, fresh = self.memo, self.older, []
        for piece in set(itertools.chain.from_iterable(own for own in pieces if own)):
            if piece not in memo:
                if piece in older:
                    memo[piece] = older[piece]
                else:
                    fresh.append(piece)
        memo.update(zip(fresh, self._encode(fresh), strict=True))
        out = [
            len(spliced(self.tokenizer, text, self.chunk, self.overlap)) if own is None else sum([memo[p] for p in own])
            for text, own in zip(texts, pieces, strict=True)
        ]
        for piece in fresh:
            if len(piece) > LONG:
                del memo[piece]
        return out

    def _encode(self, texts: list[str]) -> list[int]:
        encode = self.tokenizer.encode_batch_fast
        return [
            len(e) for k in range(0, len(texts), 512) for e in encode(texts[k : k + 512], add_special_tokens=False)
        ]


@functools.lru_cache(maxsize=4)
def counter(path: str, chunk: int, overlap: int) -> Counter:
    """Kept by the worker process from task to task; it changes speed, never a result."""
    return Counter(load(path), chunk, overlap)


def count_tokens(
    docs: DataFrame,
    tokenizer_path: str,
    id: str = "doc_id",
    text: str = "text",
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """One row per document: ``id``, n_bytes (UTF-8), n_tokens, both long.

    ``tokenizer_path`` is a byte-level vocabulary file of the tokenizers library, present on every
    worker. No begin, end or other special tokens are added; special strings inside a text become
    what the file says. Texts over ``chunk`` characters are encoded in chunks, see ``spliced``.
    A null or empty text has 0 bytes and 0 tokens; repeated rows and null ids are kept as they are.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = counter(tokenizer_path, chunk, overlap)
        for batch in batches:
            for a, b in slices(batch.column(1), 1 << 20):
                part = batch.slice(a, b - a)
                texts = [t or "" for t in part.column(1).to_pylist()]
                size = pc.fill_null(pc.binary_length(part.column(1)), 0)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), size.cast(pa.int64()), pa.array(numbers(texts), pa.int64())],
                    names=[id, "n_bytes", "n_tokens"],
                )

    narrow = docs.select(F.col(id), F.col(text).cast("string"))
    kind = narrow.schema[0].dataType.simpleString()
    return narrow.mapInArrow(count, f"`{id}` {kind}, n_bytes bigint, n_tokens bigint")
