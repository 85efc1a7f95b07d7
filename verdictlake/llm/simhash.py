"""SimHash fingerprints and exact near-duplicate groups through vantage-point partitions.

Distances of whole 64-bit fingerprints gather around 32, where a ball of radius 4 meets both
sides of nearly every cut. So the fingerprint is seen as three blocks of bits: of two
fingerprints within 4 bits, at least one block differs in at most 1, and Hamming distance on a
block obeys the triangle inequality. For each block, levels of vantage points cut the
fingerprints by distance: near ones (distance <= t) to the left, others to the right, and those
within the radius of the cut to both. Two fingerprints that near each other meet in at least one
shard. Inside a shard, points are ordered by full distance to a vantage point of the shard, and
only those whose distances differ by at most the radius are compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdictlake.llm.graph import components
from verdictlake.llm.shared import saved

RADIUS = 4
SHINGLE = 4
SEED = 42
#: Fingerprints a shard should hold, and those looked at to place the cuts.
SHARD = 4000
SAMPLE = 20_000


def fingerprint(text: bytes, width: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of the word shingles of a UTF-8 text, A-Z lower-cased, as a signed 64-bit number.

    Fewer words than ``width`` make one shingle; no words make fingerprint 0.
    """
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    end = np.cumsum(size + 1) - 1
    start = end - size
    if len(words) > width:
        start, end = start[: 1 - width], end[width - 1 :]
    else:
        start, end = start[:1], end[-1:]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(start), 1 << 15):
        spans = zip(start[k : k + (1 << 15)].tolist(), end[k : k + (1 << 15)].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], seed) for a, b in spans], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(start), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(
    docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = SHINGLE, seed: int = SEED
) -> DataFrame:
    """(``id``, fingerprint long) per row; null and empty texts have fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            values = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", width, seed) for t in column]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.int64())], names=[id, "fingerprint"])

    narrow = docs.select(F.col(id), F.col(text).cast("string").cast("binary").alias("text"))
    return narrow.mapInArrow(run, f"`{id}` {narrow.schema[0].dataType.simpleString()}, fingerprint bigint")


def blocks(radius: int) -> list[tuple[int, int]]:
    """(mask, radius inside) of the blocks: as many as leave at most one differing bit to the nearest."""
    count = radius // 2 + 1
    edges = [round(64 * k / count) for k in range(count + 1)]
    return [(((1 << b) - (1 << a)), radius // count) for a, b in zip(edges, edges[1:], strict=False)]


def cuts(sample: np.ndarray, mask: int, radius: int, depth: int) -> list[tuple[int, int]]:
    """(vantage point, t) of each level: of a few candidates, the cut that leaves the fewest pairs."""
    rng = np.random.default_rng(mask & 0xFFFF)
    out = []
    for _ in range(depth):
        best = None
        for _ in range(4):
            vantage = int(rng.integers(0, 1 << 63)) * 2 + int(rng.integers(0, 2))
            d = np.bitwise_count((sample ^ np.uint64(vantage)) & np.uint64(mask))
            share = np.bincount(d, minlength=66) / max(1, len(sample))
            upto = np.cumsum(share)
            for t in range(0, 64):
                pairs = upto[min(65, t + radius)] ** 2 + (1 - upto[t]) ** 2
                if best is None or pairs < best[0]:
                    best = (pairs, vantage, t)
        out.append((best[1], best[2]))
    return out


def shards(values: np.ndarray, mask: int, radius: int, levels: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(position in ``values``, path) of each value in each shard it belongs to."""
    row, path = np.arange(len(values)), np.zeros(len(values), dtype=np.int64)
    for vantage, t in levels:
        d = np.bitwise_count((values ^ np.uint64(vantage)) & np.uint64(mask))[row]
        right, left = d > t, d <= t + radius
        row = np.concatenate([row[left], row[right]])
        path = np.concatenate([path[left] << 1, (path[right] << 1) | 1])
    return row, path


def forest(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, root of i) that tie all of ``values`` (distinct) that chains of near pairs tie."""
    n = len(values)
    parent = np.arange(n)
    if n < 2:
        return parent[:0], parent[:0]
    vantage = values[0]
    d = np.bitwise_count(values ^ vantage).astype(np.int64)
    order = np.argsort(d, kind="stable")
    ordered, d = values[order], d[order]
    upto = np.searchsorted(d, d + radius, side="right")
    step = max(1, (1 << 21) // n)
    for a in range(0, n, step):
        b = min(n, a + step)
        stop = int(upto[b - 1])
        near = np.bitwise_count(ordered[a:b, None] ^ ordered[None, a:stop]) <= radius
        i, j = np.nonzero(near)
        i, j = i + a, j + a
        while True:
            x, y = parent[i], parent[j]
            apart = x != y
            if not apart.any():
                break
            i, j, x, y = i[apart], j[apart], x[apart], y[apart]
            np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = parent[parent]
                if (up == parent).all():
                    break
                parent = up
    tied = np.flatnonzero(parent != np.arange(n))
    return order[tied], order[parent[tied]]


def near_links(prints: DataFrame, radius: int = RADIUS, shard: int = SHARD, sample: int = SAMPLE) -> DataFrame:
    """Links (a, b) between distinct fingerprints whose chains are those of all pairs within ``radius``.

    ``prints`` has distinct values in column fingerprint and is read three times. All are placed in
    shards; only the cuts are fitted on a bounded sample. A shard gives at most one link for each of
    its fingerprints, so a large group of near copies makes no pairs of all with all.
    """
    count = prints.count()
    looked = prints.orderBy(F.xxhash64("fingerprint")).limit(sample).collect()
    seen = np.array([r.fingerprint for r in looked], dtype=np.int64).view(np.uint64)
    plans = []
    for mask, inside in blocks(radius):
        # Each level leaves about 0.58 of a shard (radius 1 on 21 bits), see ``cuts``.
        depth = max(0, math.ceil(math.log(max(1, count) / shard) / -math.log(0.58)))
        plans.append((mask, inside, cuts(seen, mask, inside, depth) if len(seen) else []))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.asarray(batch.column(0)).view(np.uint64)
            for k, (mask, inside, levels) in enumerate(plans):
                row, path = shards(values, mask, inside, levels)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(path * len(plans) + k), pa.array(values[row].view(np.int64))], names=["shard", "fingerprint"]
                )

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None

        def done():
            values = np.concatenate(held)
            i, j = forest(values.view(np.uint64), radius)
            return pa.RecordBatch.from_arrays([pa.array(values[i]), pa.array(values[j])], names=["a", "b"])

        for batch in batches:
            keys, values = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            edges = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if key is not None and keys[a] != key:
                    yield done()
                    held = []
                key = keys[a]
                held.append(values[a:b])
        if held:
            yield done()

    placed = prints.select("fingerprint").mapInArrow(place, "shard bigint, fingerprint bigint")
    by_shard = placed.repartition("shard").sortWithinPartitions("shard")
    return by_shard.mapInArrow(link, "a bigint, b bigint")


def near_groups(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    radius: int = RADIUS,
    width: int = SHINGLE,
    seed: int = SEED,
) -> DataFrame:
    """(``id``, fingerprint long, component_id) per row of ``docs``.

    Documents are linked if their fingerprints differ in at most ``radius`` bits, equal ones included;
    component_id is the smallest id that links reach. Links are sought between distinct fingerprints
    only. Null ids are no one's component_id unless a group has no other; repeated rows share a group;
    an empty table gives no rows.
    """
    printed = saved(fingerprints(docs, id, text, width, seed), "fingerprints")
    distinct = saved(printed.groupBy("fingerprint").agg(F.min(id).alias("least_id")), "distinct-fingerprints")
    tied = components(near_links(distinct.select("fingerprint"), radius))
    named = (
        distinct.join(tied, distinct.fingerprint == tied.node, "left")
        .select("fingerprint", "least_id", F.coalesce("component", "fingerprint").alias("component"))
    )
    least = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    by_print = named.join(least, "component").select("fingerprint", "component_id")
    return printed.join(by_print, "fingerprint").select(id, "fingerprint", "component_id")


def hexadecimal(column):
    return F.lower(F.lpad(F.hex(column), 16, "0"))
