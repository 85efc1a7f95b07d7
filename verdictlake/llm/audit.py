"""How five document filters interact, kept up to date by a stream that takes counts back.

Files of documents arrive in micro-batches. Four filters look at one text alone; the fifth fails
a text that a smaller id has too, so a later file can change what an earlier document failed. The
state holds, for each text, the smallest id met so far and the parts of its rows. When a smaller
id arrives, the counts of the former smallest are taken back and entered again with the fifth
failure. The counters are sums of such signed changes, one row per (part, set of failed filters).
"""

from __future__ import annotations

import hashlib
import itertools
import math
import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from verdictlake.llm.shared import new_path
from verdictlake.llm.text import slices as byte_slices
from verdictlake.llm.text import words

#: Bits of a set of failed filters, by letter.
BITS = {"A": 1, "B": 2, "C": 4, "D": 8, "E": 16}
COPY = BITS["E"]
LEAST_WORDS = 200
MARKS = b"#$%&*|"
#: A state entry holds about so many texts; a task combines so many rows before it passes them on.
TEXTS_A_SLICE = 256
COMBINED = 50_000
BATCHES = 4

_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[list(MARKS)] = True
#: Every byte of UTF-8 but continuations begins a code point.
_POINT = (np.arange(256) & 0xC0) != 0x80

#: State on disk, changes of a batch in a log; no disk is set aside for stores that hold little.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}

CHANGE = "id bigint, named boolean, part string, mask int, n bigint"
FACT = "slice bigint, digest binary, " + CHANGE + ", sure boolean"
COUNTER = "part string, mask int, n bigint, good bigint, toxic bigint"


def own_failures(column: pa.Array) -> np.ndarray:
    """Bits A to D of each text; null is empty."""
    texts = [t or b"" for t in column.cast(pa.large_binary()).to_pylist()]
    at = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])[:-1]]).astype(np.int64)
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)

    def per_text(kind: np.ndarray) -> np.ndarray:
        return np.add.reduceat(kind[data], at, dtype=np.int64)

    w = words(column)
    doc = w.doc
    order = np.lexsort((w.hash, doc))
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (w.hash[order][1:] != w.hash[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    distinct = np.bincount(doc[order][fresh], minlength=len(texts))
    n_words = np.diff(w.first)
    # The line break behind each text is a code point of ours.
    points = per_text(_POINT) - 1
    return (
        BITS["A"] * (n_words < LEAST_WORDS)
        + BITS["B"] * (100 * distinct < 50 * n_words)
        + BITS["C"] * (100 * per_text(_UPPER) > 2 * points)
        + BITS["D"] * (per_text(_MARK) > 0)
    )


class Holders:
    """For each text the smallest id met, its own failures and how many rows of each part have that id."""

    def __init__(self, held: dict | None = None):
        self.held = held or {}

    def meet(self, digest: bytes, id: int, part: str, mask: int, n: int) -> Iterator[tuple]:
        """The changes (id, part, mask, n) that ``n`` more rows make, retractions included."""
        seen = self.held.get(digest)
        if seen is not None and id > seen[0]:
            yield id, part, mask | COPY, n
            return
        if seen is not None and id < seen[0]:
            for other, k in seen[2].items():
                yield seen[0], other, mask, -k
                yield seen[0], other, mask | COPY, k
            seen = None
        if seen is None:
            seen = self.held[digest] = (id, mask, {})
        seen[2][part] = seen[2].get(part, 0) + n
        yield id, part, mask, n


def facts(batches: Iterator[pa.RecordBatch], n_slices: int) -> Iterator[pa.RecordBatch]:
    """What the state needs of each document. Of rows of a task with equal texts only those of the
    smallest id may still change; the others are sure to be copies and are dealt out by their ids."""
    names = ["slice", "digest", "id", "named", "part", "mask", "n", "sure"]
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.bool_(), pa.string(), pa.int32(), pa.int64(), pa.bool_()]

    def dealt(digest: bytes, id: int | None, part: str, mask: int, n: int, sure: bool) -> tuple:
        by = digest if id is None or not sure else hashlib.blake2b(str(id).encode(), digest_size=8).digest()
        return int.from_bytes(by[:8], "big") % n_slices, digest, id or 0, id is not None, part, mask, n, sure

    def flush(best: dict, rest: Counter) -> pa.RecordBatch:
        rows = [dealt(d, id, part, mask, n, False) for d, (id, mask, parts) in best.items() for part, n in parts.items()]
        rows += [dealt(d, id, part, mask, n, True) for (d, id, part, mask), n in rest.items() if n]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    best, rest = Holders(), Counter()
    for batch in batches:
        for a, b in byte_slices(batch.column(1), 1 << 20):
            part = batch.slice(a, b - a)
            masks = own_failures(part.column(1)).tolist()
            for id, text, source, mask in zip(*(c.to_pylist() for c in part.columns), masks, strict=True):
                digest = hashlib.blake2b((text or "").encode(), digest_size=16).digest()
                if id is None:
                    rest[digest, None, source, mask] += 1
                    continue
                for other, where, now, n in best.meet(digest, id, source, mask, 1):
                    # What is not a copy is not sure; its own entry in ``best`` speaks for it.
                    if now & COPY:
                        rest[digest, other, where, now] += n
        if len(best.held) + len(rest) >= COMBINED:
            yield flush(best.held, rest)
            best, rest = Holders(), Counter()
    if best.held or rest:
        yield flush(best.held, rest)


def take_in(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Bring a slice of texts up to date and tell the signed changes of its documents."""
    texts = Holders(pickle.loads(state.get[0]) if state.exists else None)
    before, changes = len(texts.held), Counter()
    touched = False
    for frame in frames:
        for digest, id, named, part, mask, n, sure in zip(
            *(frame[c].tolist() for c in ("digest", "id", "named", "part", "mask", "n", "sure")), strict=True
        ):
            if sure:
                changes[id, named, part, mask] += n
                continue
            touched = True
            for other, where, now, k in texts.meet(bytes(digest), id, part, mask, n):
                changes[other, True, where, now] += k
    if touched or len(texts.held) != before:
        state.update((pickle.dumps(texts.held, protocol=5),))
    rows = [(*what, n) for what, n in changes.items() if n]
    yield pd.DataFrame(rows, columns=["id", "named", "part", "mask", "n"])


def audit(
    docs: DataFrame,
    labels: DataFrame,
    n_slices: int,
    place: str | None = None,
    id: str = "doc_id",
    text: str = "text",
    part: str = "source",
) -> DataFrame:
    """Counters (part, mask, n, good, toxic) of all documents of the stream ``docs`` that are there now.

    ``place`` is a folder that executors share; a later call with the same folder takes only new files and
    goes on from the state kept there, which is a RocksDB store. A text is known by 128 bits of its hash.
    ``n_slices`` deals texts over state entries and must stay the same for a folder.
    Ids are whole numbers. A null id is no smaller id for anyone and has no smaller one: such rows never fail
    E and carry no label. Rows that share the smallest id of a text do not fail E. A null text is empty, a
    null part the empty string. ``labels`` has doc_id, quality and toxic; of several labels of an id the
    largest counts. Each micro-batch writes its changes under its own number, so a repeated one replaces itself.
    """
    spark = docs.sparkSession
    place = place or new_path(spark, "audit")
    known = labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("label_id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).cast("int").alias("is_good"),
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).cast("int").alias("is_toxic"),
    )
    narrow = docs.select(
        F.col(id).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part")
    )
    changes = (
        narrow.mapInArrow(lambda batches: facts(batches, n_slices), FACT)
        .groupBy("slice")
        .applyInPandasWithState(take_in, CHANGE, "texts binary", "update", GroupStateTimeout.NoTimeout)
    )

    def enter(batch: DataFrame, number: int) -> None:
        # A row per (id, part, mask), so one id with very many rows does not weigh on the join.
        net = batch.withColumn("id", F.expr("if(named, id, null)")).groupBy("id", "part", "mask").agg(F.sum("n").alias("n")).filter("n <> 0")
        marked = net.join(known, net.id == known.label_id, "left")
        sums = marked.groupBy("part", "mask").agg(
            F.sum("n").alias("n"),
            F.sum(F.col("n") * F.coalesce("is_good", F.lit(0))).alias("good"),
            F.sum(F.col("n") * F.coalesce("is_toxic", F.lit(0))).alias("toxic"),
        )
        sums.write.mode("overwrite").parquet(f"{place}/counters/batch={number}")

    spark.createDataFrame([], COUNTER).write.mode("overwrite").parquet(f"{place}/counters/batch=-1")
    former = {name: spark.conf.get(name, None) for name in STORE}
    for name, value in STORE.items():
        spark.conf.set(name, value)
    try:
        writer = changes.writeStream.outputMode("update").foreachBatch(enter).trigger(availableNow=True)
        writer.option("checkpointLocation", f"{place}/progress").start().awaitTermination()
    finally:
        for name, value in former.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    entered = spark.read.schema(COUNTER).parquet(f"{place}/counters")
    return entered.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def interactions(counters: DataFrame) -> DataFrame:
    """One row per part, order of the five filters and step, from counters as ``audit`` gives them.

    What a step removes depends on its filter and the set of filters before it, so those 80 cases
    are summed once per part and then looked up for the 600 steps.
    """
    letters = sorted(BITS)
    cases = [
        (letter, BITS[letter], sum(BITS[o] for o in before))
        for letter in letters
        for k in range(len(letters))
        for before in itertools.combinations([o for o in letters if o != letter], k)
    ]

    def numbers(case: tuple) -> F.Column:
        letter, bit, before = case
        # Of the orders of five filters, so many have exactly this set before the filter.
        orders = math.factorial(before.bit_count()) * math.factorial(len(letters) - 1 - before.bit_count())
        return F.struct(F.lit(letter).alias("letter"), F.lit(bit).alias("bit"), F.lit(before).alias("before"), F.lit(orders).alias("orders"))

    failed = F.col("mask").bitwiseAND(F.col("bit")) != 0
    earlier = F.col("mask").bitwiseAND(F.col("before")) != 0
    total = lambda what, where, name: F.sum(F.when(where, F.col(what)).otherwise(0)).cast("bigint").alias(name)
    # A part has at most 32 counters, each opened into the 80 cases.
    opened = counters.withColumn("case", F.explode(F.array(*map(numbers, cases)))).select("*", "case.*")
    by_case = opened.groupBy("part", "letter", "before", "orders").agg(
        total("n", ~failed & ~earlier, "kept"),
        total("n", failed & ~earlier, "removed"),
        total("n", failed & earlier, "redundant"),
        total("n", F.col("mask") == F.col("bit"), "unique_fails"),
        total("good", failed & ~earlier, "good_lost"),
        total("toxic", failed & ~earlier, "toxic_lost"),
    )
    counts = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    shares = F.sum(F.col("removed") * F.col("orders")).over(Window.partitionBy("part", "letter"))
    key = F.concat_ws(":", "letter", "before")
    by_part = (
        by_case.withColumn("shapley", shares)
        .groupBy("part")
        .agg(F.map_from_entries(F.collect_list(F.struct(key, F.struct(*counts)))).alias("cases"))
    )
    steps = []
    for order in itertools.permutations(letters):
        before = 0
        for k, letter in enumerate(order):
            steps.append(("".join(order), k + 1, f"{letter}:{before}"))
            before += BITS[letter]
    step = [F.struct(F.lit(o).alias("filter_order"), F.lit(k).alias("step"), F.lit(at).alias("at")) for o, k, at in steps]
    rows = by_part.withColumn("step", F.explode(F.array(*step)))
    found = F.col("cases")[F.col("step.at")]
    return rows.select("part", "step.filter_order", "step.step", *[found[c].alias(c) for c in counts])


def audit_files(spark: SparkSession, path: str, labels: DataFrame, batches: int = BATCHES, **columns) -> DataFrame:
    """``interactions`` of the Parquet files at ``path``, taken in about ``batches`` micro-batches of whole files."""
    table = spark.read.parquet(path)
    n_slices = max(64, math.ceil(table.count() / TEXTS_A_SLICE))
    files = max(1, math.ceil(len(table.inputFiles()) / batches))
    # A pattern, since a stream takes a plain path for a folder of files and not for a file.
    pattern = f"{path[:-1]}[{path[-1]}]"
    docs = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files).parquet(pattern)
    return interactions(audit(docs, labels, n_slices, **columns))
