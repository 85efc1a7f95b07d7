"""Fingerprints of texts by randomised edit embedding.

All texts share one random walk: at step j the walker stands on a character; a random bit of
(j, character) says whether it moves on to the next. The characters under the walker, step by
step, are the embedding. Two texts some edits apart fall out of step at an edit and, as the bits
are shared, soon fall into step again, so their embeddings differ in few places.

The fingerprint keeps the embedding at fixed random steps, more densely at its beginning: as many
in each doubling of its length. A kept place is four bits of a hash of the three characters that
begin under the walker. Likeness of two fingerprints estimates the share of equal places of the
embeddings, less what chance makes equal.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEED = 20
CLASSES = 256
#: The random bits repeat after so many steps.
PERIOD = 4096
SAMPLES = 32
FIRST = 64
CHANCE = 1 / 16
#: Fewer texts than this under way are walked one by one.
NARROW = 48


@functools.lru_cache(maxsize=2)
def jumps(seed: int = SEED) -> np.ndarray:
    """Steps the walker stays on a character of each class, by step modulo ``PERIOD``; flat, class by class."""
    bits = np.random.default_rng(seed).integers(0, 2, (CLASSES, PERIOD), dtype=np.uint8)
    bits[:, -1] = 1
    stay = np.empty((CLASSES, PERIOD), dtype=np.uint8)
    wait = np.zeros(CLASSES, dtype=np.int64)
    for j in range(PERIOD - 1, -1, -1):
        wait = np.where(bits[:, j] == 1, 1, np.minimum(wait + 1, 250))
        stay[:, j] = wait
    return stay.ravel()


@functools.lru_cache(maxsize=2)
def steps(seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(step, weight) of every sample, by step; steps up to 2**40."""
    rng = np.random.default_rng(seed + 1)
    out, weight, low, high = [], [], 0, FIRST
    while high <= 1 << 40:
        own = np.sort(rng.choice(high - low, SAMPLES, replace=False) if high <= 1 << 20 else rng.integers(0, high - low, SAMPLES))
        own[0] = 0
        out.append(own + low)
        weight.append(np.full(SAMPLES, (high - low) / SAMPLES))
        low, high = high, 2 * high
    return np.concatenate(out), np.concatenate(weight)


def classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    return ((points * np.uint32(2654435761)) >> np.uint32(24)).astype(np.uint8)


def walk(codes: list[np.ndarray], begin: np.ndarray, seed: int = SEED) -> list[np.ndarray]:
    """For each text the step at which the walker comes to each character and, last, leaves the text.

    All texts advance together, one character at a time; the last few long ones are walked alone.
    """
    stay = jumps(seed)
    length = np.array([len(c) for c in codes], dtype=np.int64)
    order = np.argsort(-length, kind="stable")
    start = np.concatenate([[0], np.cumsum(length + 1)])
    flat = np.zeros(start[-1], dtype=np.int64)
    for c, a in zip(codes, start, strict=False):
        flat[a : a + len(c)] = c
    flat *= PERIOD
    out = np.empty(start[-1], dtype=np.int64)
    at = start[:-1][order].copy()
    step = np.asarray(begin, dtype=np.int64)[order].copy()
    sizes = length[order]
    active, t = len(codes), 0
    while True:
        active = int(np.searchsorted(-sizes[:active], -t, side="left"))  # texts longer than t
        if active <= NARROW:
            break
        upto = int(sizes[active - 1])
        place, now = at[:active], step[:active]
        for _ in range(upto - t):
            out[place] = now
            now += stay[flat[place] + (now & (PERIOD - 1))]
            place += 1
        t = upto
    for k in range(active):
        a, n, now = int(at[k]), int(sizes[k]) - t, int(step[k])
        own, table, came = flat[a : a + n].tolist(), _table(seed), []
        for c in own:
            came.append(now)
            now += table[c + (now & (PERIOD - 1))]
        out[a : a + n] = came
        at[k], step[k] = a + n, now
    out[at] = step
    back = np.empty(len(codes), dtype=np.int64)
    back[order] = np.arange(len(codes))
    return [out[start[k] : start[k + 1]] for k in range(len(codes))]


@functools.lru_cache(maxsize=2)
def _table(seed: int) -> bytes:
    return jumps(seed).tobytes()


_HEX = np.frombuffer(b"0123456789abcdef", dtype=np.uint8)


def sampled(codes: np.ndarray, came: np.ndarray, seed: int = SEED) -> str:
    """The fingerprint of a walked text: one hexadecimal digit per sample that lies inside its embedding."""
    if not len(codes):
        return ""
    where, _ = steps(seed)
    where = where[: np.searchsorted(where, came[-1], side="left")]
    at = np.searchsorted(came[:-1], where, side="right") - 1
    wide = np.zeros(len(codes) + 2, dtype=np.uint32)
    wide[: len(codes)] = codes
    mixed = wide[at] * np.uint32(0x9E3779B1) + wide[at + 1] * np.uint32(0x85EBCA77) + wide[at + 2] * np.uint32(0xC2B2AE3D)
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x2C1B3C6D)
    return _HEX[mixed >> np.uint32(28)].tobytes().decode()


def fingerprints_of(texts: list[str], seed: int = SEED) -> list[str]:
    codes = [classes(t) for t in texts]
    return [sampled(c, came, seed) for c, came in zip(codes, walk(codes, np.zeros(len(codes)), seed), strict=True)]


def likeness(a: str, b: str, seed: int = SEED) -> float:
    """0 to 1. Samples inside one embedding only count as different; two empty texts are alike."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    _, weight = steps(seed)
    n, most = min(len(a), len(b)), max(len(a), len(b))
    same = np.frombuffer(a[:n].encode(), np.uint8) == np.frombuffer(b[:n].encode(), np.uint8)
    share = float((weight[:n] * same).sum() / weight[:most].sum())
    return min(1.0, max(0.0, (share - CHANCE) / (1 - CHANCE)))


def with_next(docs: DataFrame, id: str, text: str, run) -> DataFrame:
    """Apply ``run`` to rows (block, ahead, id, text) in descending order of id, each block in one task.

    Blocks are ranges of ids at approximate quantiles, four for each shuffle partition. The row behind
    the last of a block, which is the first of the next one, comes along in both (ahead is true);
    behind the last block that is the row with the largest id. Texts are shuffled once.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col(id).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    blocks = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [k / blocks for k in range(1, blocks)]
    found = narrow.agg(F.percentile_approx("id", shares, 10 * blocks)).first()[0]
    splits = np.unique(np.array(found or [], dtype=np.int64))

    def block_of(batch: pa.Array) -> np.ndarray:
        ids = np.asarray(batch.fill_null(np.iinfo(np.int64).min))
        return np.searchsorted(splits, ids, side="left")

    def largest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).drop_null()
            yield pa.RecordBatch.from_arrays([pa.array(block_of(ids)), ids], names=["block", "id"])

    tops = (
        narrow.select("id").mapInArrow(largest, "block bigint, id bigint").groupBy("block").agg(F.max("id").alias("top")).collect()
    )
    ordered = sorted(((r.block, r.top) for r in tops), reverse=True)
    follows = {below: block for (block, _), (_, below) in zip(ordered, ordered[1:], strict=False)}
    wraps = (ordered[0][1], ordered[-1][0]) if ordered else (None, 0)
    if ordered and ordered[-1][0] != 0 and narrow.filter("id IS NULL").limit(1).count():
        # Rows without an id are in block 0, behind all others.
        wraps = (ordered[0][1], 0)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        looked = np.array(sorted({*follows, *([wraps[0]] if ordered else [])}), dtype=np.int64)
        for batch in batches:
            block = block_of(batch.column(0))
            rows, blocks_, ahead = [np.arange(len(block))], [block], [np.zeros(len(block), dtype=bool)]
            ids = np.asarray(batch.column(0).fill_null(np.iinfo(np.int64).min))
            for k in np.flatnonzero(np.isin(ids, looked)).tolist():
                value = int(ids[k])
                for to in ([follows[value]] if value in follows else []) + ([wraps[1]] if value == wraps[0] else []):
                    rows.append(np.array([k]))
                    blocks_.append(np.array([to]))
                    ahead.append(np.array([True]))
            rows = np.concatenate(rows)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(blocks_).astype(np.int64)),
                    pa.array(np.concatenate(ahead)),
                    batch.column(0).take(pa.array(rows)),
                    batch.column(1).take(pa.array(rows)),
                ],
                names=["block", "ahead", "id", "text"],
            )

    dealt = narrow.mapInArrow(deal, "block bigint, ahead boolean, id bigint, text string")
    in_order = dealt.repartition("block").sortWithinPartitions(
        "block", "ahead", F.col("id").desc_nulls_last(), F.xxhash64("text")
    )
    return in_order.mapInArrow(*run)


FINGERPRINT = "id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edit_fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """Per row of ``docs``: id (long), n_chars, fingerprint; and of the edited text, edited_sha256 and edited_fingerprint.

    The edited text has its last floor(n_chars / 2) code points replaced by as many of the beginning of
    the next document's text, or all of it; documents are in descending order of id, rows without id
    last, the first following the last; equal ids are in order of a hash of their texts. near_edited
    and near_next are likenesses to the edited text and to the next document. A null text is empty and
    an empty text has an empty fingerprint. The walk over the kept half is shared by text and edited text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = first = None
        for batch in batches:
            rows = list(zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True))
            if held is not None:
                rows.insert(0, held)
            out = []
            for part in _parts(rows):
                if first is None or first[0] != part[0][0]:
                    first = part[0]
                out += _printed(part, seed)
            held = rows[-1] if rows else None
            if first is None or (held is not None and first[0] != held[0]):
                first = next(r for r in rows if r[0] == held[0])
            yield _rows(out)
        if held is not None and not held[1]:
            yield _rows(_printed([held, first], seed))

    return with_next(docs, id, text, (run, FINGERPRINT))


def _parts(rows: list[tuple], chars: int = 1 << 23) -> Iterator[list[tuple]]:
    """Runs of rows with about ``chars`` characters; each begins with the last row of the one before."""
    part, total = [], 0
    for row in rows:
        part.append(row)
        total += len(row[3])
        if total > chars and len(part) > 1:
            yield part
            part, total = [row], len(row[3])
    if len(part) > 1:
        yield part


def _printed(rows: list[tuple], seed: int) -> list[tuple]:
    """Results for each row that is not ahead and is followed by a row of its block."""
    codes = [classes(r[3]) for r in rows]
    came = walk(codes, np.zeros(len(rows)), seed)
    own = [sampled(c, j, seed) for c, j in zip(codes, came, strict=True)]
    pairs = [k for k in range(len(rows) - 1) if not rows[k][1] and rows[k][0] == rows[k + 1][0]]
    half = [len(codes[k]) // 2 for k in pairs]
    tails = [codes[k + 1][:h] for k, h in zip(pairs, half, strict=True)]
    tail_came = walk(tails, np.array([came[k][len(codes[k]) - h] for k, h in zip(pairs, half, strict=True)]), seed)
    out = []
    for k, h, tail, later in zip(pairs, half, tails, tail_came, strict=True):
        keep = len(codes[k]) - h
        text = rows[k][3][:keep] + rows[k + 1][3][:h]
        edited = sampled(np.concatenate([codes[k][:keep], tail]), np.concatenate([came[k][:keep], later]), seed)
        out.append(
            (
                rows[k][2],
                len(codes[k]),
                hashlib.sha256(text.encode()).hexdigest(),
                own[k],
                edited,
                likeness(own[k], edited, seed),
                likeness(own[k], own[k + 1], seed),
            )
        )
    return out


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = [part.split()[0] for part in FINGERPRINT.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=names)


def near_links(
    prints: DataFrame, least: float = 0.8, bands: int = 24, digits: int = 8, seed: int = SEED, text_id: str = "id"
) -> DataFrame:
    """Verified links (a, b, likeness) between different fingerprints of ``prints`` (columns id, fingerprint).

    Equal fingerprints are one class, named by its smallest id. Bands are draws of ``digits`` sampled
    digits; classes that agree in a whole band are candidates. In a bucket every class is compared with
    the bucket's smallest class, so a bucket of n gives n - 1 candidates. Short fingerprints that lack a
    drawn sample use a filler, so equal short texts still meet. Links of likeness ``least`` or more stay.
    """
    classes_ = prints.filter(F.col(text_id).isNotNull()).groupBy("fingerprint").agg(F.min(text_id).alias("a"))
    rng = np.random.default_rng(seed + 2)
    keys = []
    for band in range(bands):
        drawn = rng.choice(8 * SAMPLES, digits, replace=False) + 1
        joined = F.concat(*[F.rpad(F.substring("fingerprint", int(p), 1), 1, "-") for p in drawn])
        keys.append(F.struct(F.lit(band).alias("band"), joined.alias("key")))
    banded = classes_.select("a", "fingerprint", F.explode(F.array(*keys)).alias("k"))
    heads = banded.groupBy("k").agg(F.min(F.struct("a", "fingerprint")).alias("head"))
    pairs = (
        banded.join(heads, "k")
        .filter("head.a <> a")
        .select(F.col("head.a").alias("b"), "a", F.col("head.fingerprint").alias("other"), "fingerprint")
        .distinct()
    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [likeness(x, y, seed) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(0), pa.array(near, pa.float64())], names=["a", "b", "likeness"]
            )

    return pairs.mapInArrow(verify, "a bigint, b bigint, likeness double").filter(F.col("likeness") >= least)
