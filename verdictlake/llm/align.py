"""Alignment of two tokenizers over whole texts.

Both tokenizers cut the same bytes. Places where tokens of both end cut a text into groups; a
token of one is linked to each token of the other that it shares bytes with. Texts are taken in
blocks of bounded size as Arrow columns: lists of token ids are flattened with their parents,
ends are running sums of token lengths inside a document, groups come from a hash join of both
sides on (document, end). A block also counts in how many of its documents each pair of ids is
linked; Spark adds these partial counts up, and sends each block the totals of its own pairs.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdictlake.llm.shared import saved

#: Bytes of text in a block; a longer text is a block of its own.
BLOCK = 1 << 21

#: For the second tokenizer a text is cut in front of a blank that follows another character.
SPACED = re.compile(r" +[^ ]*")
# Fixed value: the public word pattern of byte-level vocabularies.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
UNBROKEN = re.compile(r"\S{2000}|\s{2000}")


def byte_alphabet() -> dict[str, int]:
    """The public byte-level alphabet: printable Latin-1 stands for itself, other bytes for U+0100 on, in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(others)}


class ByteLevel:
    """A byte-level vocabulary file of the tokenizers library; special strings inside texts are plain text.

    Where the file's merges are in the order of their ids, the tokens are those of the same vocabulary as
    ranks, which the tiktoken library finds faster. Other files, and texts with a very long run without
    a break, go to the tokenizers library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = True
        byte = byte_alphabet()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        entries = [""] * (max(vocabulary.values()) + 1)
        for entry, id in vocabulary.items():
            entries[id] = entry
        spelled = [bytes(byte.get(c, 0x3F) for c in e) for e in entries]
        self.bytes = pa.array(spelled, pa.binary())
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        model, added = told["model"], {t["id"] for t in told.get("added_tokens", ())}
        parts = [m if isinstance(m, list) else m.split(" ") for m in model.get("merges", ())]
        plain = (
            told["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
            and told.get("normalizer") is None
            and not model.get("ignore_merges")
            and [vocabulary["".join(m)] for m in parts] == list(range(256, 256 + len(parts)))
        )
        ranks = {b: id for id, b in enumerate(spelled) if id not in added}
        self.ranked = tiktoken.Encoding(path, pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}) if plain else None

    def _ids(self, text: str) -> list[int]:
        if self.ranked is None or UNBROKEN.search(text):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.ranked.encode_ordinary(text)

    def lists(self, texts: list[str]) -> pa.ListArray:
        return pa.array([self._ids(" " + t) if t else [] for t in texts], pa.list_(pa.int32()))


class Pieces:
    """A model file of the sentencepiece library, which puts a space in front of what it encodes."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        # No token crosses a blank that follows another character, or texts are encoded whole.
        self.split = "▁" in names and not any("▁" in n.lstrip("▁") for n in names)
        self.blank = [names.index("▁")] if self.split else []
        as_byte = re.compile("<0x([0-9A-F]{2})>")
        self.bytes = pa.array(
            [bytes([int(m[1], 16)]) if (m := as_byte.fullmatch(n)) else n.replace("▁", " ").encode() for n in names], pa.binary()
        )

    def _pieces(self, text: str) -> list[str]:
        return SPACED.findall(" " + text) if self.split else [" " + text]

    def _ids(self, pieces: list[str]) -> list[list[int]]:
        found = self.model.encode([p[1:] for p in pieces], num_threads=1)
        # The library adds no space in front of nothing.
        return [self.blank if p == " " else ids for p, ids in zip(pieces, found, strict=True)]

    def lists(self, texts: list[str]) -> pa.ListArray:
        """Token ids of each text; a piece that occurs often in the block is encoded once."""
        cut = pa.array([self._pieces(t) if t else [] for t in texts], pa.list_(pa.large_string()))
        names = pc.list_flatten(cut).dictionary_encode()
        chosen = pa.array(self._ids(names.dictionary.to_pylist()), pa.list_(pa.int32())).take(names.indices)
        # Pieces of a document one behind the other: its tokens begin where its first piece's do.
        at = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(chosen), dtype=np.int64))])
        return pa.ListArray.from_arrays(pa.array(at[np.asarray(cut.offsets)], pa.int32()), pc.list_flatten(chosen))


@functools.lru_cache(maxsize=4)
def loaded(kind: type, path: str):
    return kind(path)


class Side:
    """Tokens of one tokenizer over a block, by document: ids, owner and end in bytes of the text."""

    def __init__(self, tokenizer, texts: list[str]):
        self.lists, self.bytes = tokenizer.lists(texts), tokenizer.bytes

    def whole(self, texts: list[str]) -> list[bool]:
        """Whether the bytes of a text's tokens are a space and the text."""
        spelled = self.bytes.take(pc.list_flatten(self.lists))
        at = np.frombuffer(spelled.buffers()[1], dtype=np.int32, count=len(spelled) + 1)[np.asarray(self.lists.offsets)]
        data = spelled.buffers()[2]
        data = memoryview(data) if data else memoryview(b"")
        return [bool(t) and bytes(data[a:b]) == b" " + t.encode() for t, a, b in zip(texts, at, at[1:], strict=False)]

    def keep(self, rows: list[bool]) -> None:
        lists = pc.if_else(pa.array(rows, pa.bool_()), self.lists, pa.scalar([], self.lists.type))
        self.ids = np.asarray(pc.list_flatten(lists), dtype=np.int64)
        self.doc = np.asarray(pc.list_parent_indices(lists), dtype=np.int64)
        self.count = np.bincount(self.doc, minlength=len(rows))
        length = np.asarray(pc.binary_length(self.bytes))[self.ids]
        running = np.asarray(pc.cumulative_sum(pa.array(length, pa.int64())))
        first = np.cumsum(self.count) - self.count
        before = np.concatenate([[0], running])[first]
        self.end = running - before[self.doc]


def aligned(a: Side, b: Side, n: int) -> tuple:
    """Groups per document, the group text's hash, and (doc, pair, times) of all links."""
    # A document and an end as one number; ends are distinct inside a document.
    stride = int(max(a.end.max(initial=0), b.end.max(initial=0))) + 1
    place_a, place_b = a.doc * stride + a.end, b.doc * stride + b.end
    here = pa.table({"place": place_a, "of_a": np.arange(len(a.ids))})
    there = pa.table({"place": place_b, "of_b": np.arange(len(b.ids))})
    common = here.join(there, keys="place", join_type="inner")
    cut_a, cut_b = np.zeros(len(a.ids), bool), np.zeros(len(b.ids), bool)
    cut_a[np.asarray(common["of_a"])] = True
    cut_b[np.asarray(common["of_b"])] = True
    n_groups = np.bincount(a.doc[cut_a], minlength=n)
    group_a = np.cumsum(cut_a) - cut_a
    group_b = np.cumsum(cut_b) - cut_b

    # Each piece of text between two neighbouring ends of either side is one link.
    edges = np.sort(np.concatenate([place_a, place_b[~cut_b]]), kind="stable")
    x, y = np.searchsorted(place_a, edges), np.searchsorted(place_b, edges)
    links = pa.table({"doc": a.doc[x], "pair": a.ids[x] << 32 | b.ids[y]})
    pairs = links.group_by(["doc", "pair"]).aggregate([("pair", "count")]).sort_by("doc")

    # Tokens in the order of the group text: those of a, then those of b, group by group.
    at_a = np.arange(len(a.ids)) + np.searchsorted(group_b, group_a, side="left")
    at_b = np.arange(len(b.ids)) + np.searchsorted(group_a, group_b, side="right")
    ids = np.empty(len(a.ids) + len(b.ids), np.int64)
    ids[at_a], ids[at_b] = a.ids, b.ids
    follow = np.zeros(len(ids), np.int8)
    last_a = np.ones(len(a.ids), bool)
    last_a[:-1] = group_a[1:] != group_a[:-1]
    follow[at_a[last_a]], follow[at_b[cut_b]] = 1, 2
    size = a.count + b.count
    begin = np.cumsum(size) - size
    follow[(begin + size - 1)[size > 0]] = 3
    wide = pa.large_string()
    marks = pa.array([",", "|", ";", ""], wide).take(pa.array(follow))
    told = pc.binary_join_element_wise(pc.cast(pa.array(ids), wide), marks, pa.scalar("", wide))
    own = pa.LargeListArray.from_arrays(pa.array(np.append(begin, len(ids)), pa.int64()), told)
    texts = pc.binary_join(own, pa.scalar("", wide)).to_pylist()
    digest = [hashlib.sha256(t.encode()).hexdigest() if k else "" for t, k in zip(texts, size, strict=True)]
    return n_groups, digest, pairs


def block_rows(ids: pa.Array, texts: pa.Array, block: int, a, b) -> pa.RecordBatch:
    """A row for each document with its linked pairs, and one without a document that has the block's counts of them."""
    bodies = [t or "" for t in texts.to_pylist()]
    one, two = Side(a, bodies), Side(b, bodies)
    rows = [x and y for x, y in zip(one.whole(bodies), two.whole(bodies), strict=True)]
    one.keep(rows)
    two.keep(rows)
    n = len(bodies)
    n_groups, digest, pairs = aligned(one, two, n)
    counts = pairs.group_by("pair").aggregate([("pair", "count")])
    n_links = one.count + two.count - n_groups
    held = np.bincount(np.asarray(pairs["doc"]), minlength=n)
    offsets = pa.array(np.concatenate([[0], np.cumsum(held), [len(pairs) + len(counts)]]), pa.int32())

    def both(per_pair: pa.ChunkedArray, per_block: pa.ChunkedArray) -> pa.ListArray:
        return pa.ListArray.from_arrays(offsets, pa.concat_arrays([*per_pair.chunks, *per_block.chunks]))

    def number(values: np.ndarray) -> pa.Array:
        return pa.array([*values.tolist(), None], pa.int64())

    return pa.RecordBatch.from_arrays(
        [
            pa.array([block] * (n + 1), pa.int64()),
            pa.array([False] * n + [True]),
            pa.concat_arrays([ids, pa.nulls(1, ids.type)]),
            number(one.count),
            number(two.count),
            number(n_groups),
            number(n_links),
            pa.array([*digest, None]),
            both(pairs["pair"], counts["pair"]),
            both(pairs["pair_count"], counts["pair_count"]),
        ],
        names=["block", "is_total", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"],
    )


def weigh(docs: pa.Table, totals: pa.Table) -> pa.Table:
    """Of each document of a block, the links that are the best of their first id, and the sum of counts over links."""
    held = docs.combine_chunks()
    n = len(held)
    lists, times = (held[c].combine_chunks() if n else pa.array([], pa.list_(pa.int64())) for c in ("pairs", "times"))
    flat = pa.table({"doc": pc.list_parent_indices(lists), "pair": pc.list_flatten(lists), "times": pc.list_flatten(times)})
    met = flat.join(totals.select(["pair", "n", "best"]), keys="pair", join_type="inner")
    met = met.append_column("all", pc.multiply(met["times"], met["n"])).append_column(
        "top", pc.multiply(met["times"], pc.cast(met["best"], pa.int64()))
    )
    sums = met.group_by("doc").aggregate([("all", "sum"), ("top", "sum")])
    total, top = np.zeros(n, np.int64), np.zeros(n, np.int64)
    where = np.asarray(sums["doc"], dtype=np.int64)
    total[where], top[where] = np.asarray(sums["all_sum"]), np.asarray(sums["top_sum"])
    kept = held.select(["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
    return kept.append_column("n_best", pa.array(top)).append_column("count_sum", pa.array(total))


def alignments(
    docs: DataFrame, byte_level_path: str, pieces_path: str, id: str = "doc_id", text: str = "text", block: int = BLOCK
) -> DataFrame:
    """One row per row of ``docs``: ``id``, n_a, n_b, n_groups, n_links, n_best, count_sum (long), groups_sha256.

    Side a is the vocabulary file of the tokenizers library on a space and the text, side b the model of
    sentencepiece on the text. The count of a pair of ids is the number of rows of ``docs`` that hold it linked;
    n_best counts links whose count is the highest of their a id, ties included; count_sum adds counts over links.
    A null or empty text, and one whose tokens do not spell a space and the text, has no tokens: zeros and an
    empty groups_sha256. Null and repeated ids stay as they are. Both files must be present on every worker.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = loaded(ByteLevel, byte_level_path), loaded(Pieces, pieces_path)
        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def done() -> pa.RecordBatch:
            return block_rows(*(pa.concat_arrays([h.column(k) for h in held]) for k in (0, 1)), number, a, b)

        for batch in batches:
            length = np.asarray(pc.fill_null(pc.binary_length(batch.column(1)), 0)).tolist()
            begin = 0
            for row, n in enumerate(length):
                if size and size + n > block:
                    held.append(batch.slice(begin, row - begin))
                    yield done()
                    number, held, size, begin = number + 1, [], 0, row
                # Short texts count, too, so that a block has a bounded number of rows.
                size += n + 64
            held.append(batch.slice(begin))
        if held:
            yield done()

    narrow = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    columns = f"id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"
    blocks = saved(
        narrow.mapInArrow(cut, f"block bigint, is_total boolean, {columns}, pairs array<bigint>, times array<bigint>"), "aligned-blocks"
    )
    partial = blocks.filter("is_total").select("block", F.explode(F.arrays_zip("pairs", "times")).alias("p"))
    partial = partial.select("block", F.col("p.pairs").alias("pair"), F.col("p.times").alias("n"))
    counts = saved(partial.groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    # An a id has at most as many pairs as the other vocabulary has entries.
    top = F.max("n").over(Window.partitionBy(F.shiftright("pair", 32)))
    rated = counts.select("pair", "n", (F.col("n") == top).alias("best"))
    totals = partial.select(F.col("block").alias("home"), "pair").join(rated, "pair").select("home", "pair", "n", "best")
    of_block = blocks.filter("not is_total").drop("is_total").groupBy("block").cogroup(totals.groupBy("home"))
    weighed = of_block.applyInArrow(weigh, f"{columns}, n_best bigint, count_sum bigint")
    return weighed.withColumnRenamed("id", id)
