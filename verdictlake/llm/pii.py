"""Personal data in texts: four fixed forms, and more of the same learned from their surroundings.

What the fixed forms find are seeds. The words in front of and behind a seed are patterns; looser
forms (numbers without a country code, spelled-out addresses) are candidates. Patterns and values
make a graph that is scored in rounds: a pattern is as good as the share of its occurrences in all
texts that stand next to trusted values of its kind, a value is as good as its best pattern. Values
that pass are trusted in the next round, so their other surroundings become patterns too.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdictlake.llm.shared import saved
from verdictlake.llm.text import runs, slices

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)

#: Most words of a pattern, by side; least different trusted values and least share of a good pattern.
BEFORE, BEHIND = 3, 2
LEAST_VALUES = 3
LEAST_SHARE = 0.6
ROUNDS = 4
#: Bits of the list of word runs whose occurrences are counted: 16 MB at most, see ``occurrences``.
MOST_BITS = 1 << 27

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# A leftmost match begins where a run of digits does, since it could be made longer otherwise.
ADDRESS = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
NUMBER = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
CALL = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

AT = re.compile(r"\x20?[(\[{]at[)\]}]\x20?|@|\x20at\x20", re.IGNORECASE)
LOOSE_DOMAIN = re.compile(r"[\w-]++(?:(?:\x20?[(\[{]dot[)\]}]\x20?|\.|\x20dot\x20)[\w-]++)+", re.IGNORECASE)
SPELLED_ADDRESS = re.compile(r"(?<!\w)[0-9]{1,3}(?:(?:\x20?[(\[{](?:\.|dot)[)\]}]\x20?|\x20dot\x20|\x20\.\x20)[0-9]{1,3}){3}(?!\w)", re.IGNORECASE)
LOOSE_NUMBER = re.compile(r"(?<!\w)[0-9](?:[\x20().\-/_]{0,2}[0-9])++")
TOKEN = re.compile(r"\w+|[^\w\s]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _run_before(text: str, at: int, least: int, belongs) -> int:
    while at > least and belongs(text[at - 1]):
        at -= 1
    return at


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the fixed forms find, in order; failing matches are dropped."""
    found = []
    done = 0
    for m in DOMAIN.finditer(text):
        start = _run_before(text, m.start(), done, LOCAL.__contains__)
        if start < m.start():
            found.append((start, EMAIL, m.end()))
            done = m.end()
    for m in ADDRESS.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            found.append((m.start(), IP, m.end()))
    for m in NUMBER.finditer(text):
        digits = digits_of(m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), CARD, m.end()))
    for m in CALL.finditer(text):
        if 9 <= len(digits_of(m[0])) <= 15:
            found.append((m.start(), PHONE, m.end()))
    return sorted(found)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of looser forms between the base spans; one place may fit several kinds."""
    gaps, at = [], 0
    for a, b in sorted((s, e) for s, _, e in base):
        if a > at:
            gaps.append((at, a))
        at = max(at, b)
    gaps.append((at, len(text)))
    found = []
    for low, high in gaps:
        done = low
        for m in AT.finditer(text, low, high):
            domain = LOOSE_DOMAIN.match(text, m.end(), high)
            # "at" as a word counts only together with "dot" as a word.
            if domain and (m[0].lower() != " at " or " dot " in domain[0].lower()):
                start = _run_before(text, m.start(), done, lambda c: c in LOCAL or c.isalnum())
                if start < m.start():
                    found.append((start, EMAIL, domain.end()))
                    done = domain.end()
        for m in SPELLED_ADDRESS.finditer(text, low, high):
            if all(int(p) <= 255 for p in re.findall("[0-9]+", m[0])):
                found.append((m.start(), IP, m.end()))
        for m in LOOSE_NUMBER.finditer(text, low, high):
            if m.end() < len(text) and (text[m.end()].isalnum() or text[m.end()] == "_"):
                continue
            n = len(digits_of(m[0]))
            if 12 <= n <= 19:
                found.append((m.start(), CARD, m.end()))
            if 7 <= n <= 15:
                found.append((m.start(), PHONE, m.end()))
    return found


def value_of(kind: int, text: str) -> int:
    """A 64-bit name of a value, the same for its spellings."""
    if kind == EMAIL:
        plain = re.sub(r"\x20?[(\[{]at[)\]}]\x20?|\x20at\x20", "@", text.lower())
        plain = re.sub(r"\x20?[(\[{]dot[)\]}]\x20?|\x20dot\x20", ".", plain)
    elif kind == IP:
        plain = ".".join(str(int(p)) for p in re.findall("[0-9]+", text))
    else:
        plain = digits_of(text)
    return xxhash.xxh64_intdigest(plain.encode(), kind) - (1 << 63)


def token_hash(token: str) -> int:
    return xxhash.xxh64_intdigest(token.encode("utf-8", "replace"))


def named_runs(hashes: np.ndarray, width: int) -> np.ndarray:
    return (runs(hashes, width) + np.uint64(width)).view(np.int64)


class Surroundings:
    """Names of the word runs that end in front of a place or begin behind one."""

    def __init__(self, text: str):
        tokens = list(TOKEN.finditer(text))
        self.starts, self.ends = [m.start() for m in tokens], [m.end() for m in tokens]
        hashes = np.array([token_hash(m[0].lower()) for m in tokens], dtype=np.uint64)
        self.names = {k: named_runs(hashes, k).tolist() for k in range(1, max(BEFORE, BEHIND) + 1)}

    def __call__(self, start: int, end: int) -> list[tuple[bool, int]]:
        """(is it behind, name) of each pattern of the span."""
        last = bisect.bisect_right(self.ends, start) - 1
        first = bisect.bisect_left(self.starts, end)
        before = [(False, self.names[k][last - k + 1]) for k in range(1, BEFORE + 1) if last - k + 1 >= 0]
        return before + [(True, self.names[k][first]) for k in range(1, BEHIND + 1) if first + k <= len(self.starts)]


def told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(spans))


_SPAN = [("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]
_HINT = [*_SPAN, ("value", pa.int64()), ("seed", pa.bool_()), ("behind", pa.list_(pa.bool_())), ("names", pa.list_(pa.int64()))]
SPANS, HINTS = pa.list_(pa.struct(_SPAN)), pa.list_(pa.struct(_HINT))
SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"
HINT = "array<struct<start:bigint,kind:int,end:bigint,value:bigint,seed:boolean,behind:array<boolean>,names:array<bigint>>>"
COUNTS = [f"n_{kind}" for kind in KINDS]


def found_in(text: str) -> tuple[list, list]:
    """Base spans, and every span with its value and patterns."""
    base = base_spans(text)
    loose = candidates(text, base)
    if not base and not loose:
        return base, []
    around, hints = Surroundings(text), []
    for spans, seed in ((base, True), (loose, False)):
        for start, kind, end in spans:
            patterns = around(start, end)
            hints.append((start, kind, end, value_of(kind, text[start:end]), seed, [b for b, _ in patterns], [n for _, n in patterns]))
    return base, hints


def read_all(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(id, row, a count per kind, base, base_sha256, hints) for each row of ``docs``; ``row`` is a number of its own."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 36
        for batch in batches:
            # Every form has a digit, an at sign or the word for it.
            likely = pc.fill_null(pc.match_substring_regex(batch.column(1), r"[0-9@]|(?i:[(\[{]at[)\]}]|\x20at\x20)"), False).to_pylist()
            found = [found_in(body.as_py()) if look else ([], []) for look, body in zip(likely, batch.column(1), strict=True)]
            bases = [base for base, _ in found]
            counts = [pa.array([sum(k == kind for _, k, _ in base) for base in bases], pa.int64()) for kind in range(len(KINDS))]
            digests = [hashlib.sha256(told(base).encode()).hexdigest() for base in bases]
            rows = pa.array(range(number, number + len(found)), pa.int64())
            number += len(found)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), rows, *counts, pa.array(bases, SPANS), pa.array(digests), pa.array([h for _, h in found], HINTS)],
                names=["id", "row", *COUNTS, "base", "base_sha256", "hints"],
            )

    narrow = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    columns = "".join(f", {c} bigint" for c in COUNTS)
    return narrow.mapInArrow(read, f"id {kind}, row bigint{columns}, base {SPAN}, base_sha256 string, hints {HINT}")


def occurrences(docs: DataFrame, text: str, wanted: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """(name, total): how often each word run of ``wanted`` (column name, distinct) occurs in all texts.

    Tasks see which runs are wanted by a bitmap with 16 bits for each, 16 MB at most: beyond that more
    runs are counted than wanted, and the join drops them. A task counts what it reads before the shuffle.
    """
    spark = docs.sparkSession
    bits = min(most_bits, max(1 << 10, 1 << (16 * wanted.count()).bit_length()))
    place = F.col("name").bitwiseAND(bits - 1)
    # At most bits / 64 rows come back.
    rows = wanted.groupBy(F.shiftright(place, 6).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), place.bitwiseAND(63).cast("int"))).alias("set")
    )
    marked = np.zeros(bits // 64, dtype=np.int64)
    for r in rows.toLocalIterator():
        marked[r.word] = r.set
    sent = spark.sparkContext.broadcast(marked.tobytes())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        want = np.frombuffer(sent.value, dtype=np.uint64)
        for batch in batches:
            for a, b in slices(batch.column(0), 1 << 21):
                bodies = [t or "" for t in batch.column(0).slice(a, b - a).to_pylist()]
                lists = pa.array([TOKEN.findall(t) for t in bodies], pa.list_(pa.large_string()))
                names = pc.list_flatten(lists).dictionary_encode()
                known = np.array([token_hash(t.lower()) for t in names.dictionary.to_pylist()], dtype=np.uint64)
                hashes = known[np.asarray(names.indices)] if len(known) else known
                doc = np.asarray(pc.list_parent_indices(lists))
                met = []
                for k in range(1, max(BEFORE, BEHIND) + 1):
                    run = named_runs(hashes, k)
                    run = run[doc[: len(run)] == doc[k - 1 :]] if len(run) else run
                    at = run & (bits - 1)
                    met.append(run[(want[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)])
                name, n = np.unique(np.concatenate(met), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(n)], names=["name", "n"])

    counted = docs.select(F.col(text).cast("string")).mapInArrow(count, "name bigint, n bigint")
    return counted.groupBy("name").agg(F.sum("n").alias("total")).join(wanted, "name", "left_semi")


def learned(edges: DataFrame, totals: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(kind, value, trust) of candidate values that pass.

    ``edges`` has kind, value, seed, behind, name, n: n spans of the value stand at the pattern (behind, name).
    A pattern's share is the trust of the spans at it over that plus its occurrences at anything else, one added; spans
    of its kind of which nothing is known count neither way. It is good from ``LEAST_SHARE`` on with ``LEAST_VALUES``
    different trusted values, so copies of one text make none good. A value's trust is the share of its best good pattern.
    """
    one = F.row_number().over(Window.partitionBy("kind", "value", "behind", "name").orderBy(F.desc("seed"))) == 1
    edges = saved(edges.join(totals, "name").withColumn("first", one), "pattern-edges")
    trusted = edges.filter("seed").select("kind", "value").distinct().withColumn("trust", F.lit(1.0))
    trusted = saved(trusted, "trusted-values")
    known = trusted.count()
    for _ in range(rounds):
        weighed = edges.join(trusted, ["kind", "value"], "left")
        patterns = weighed.groupBy("kind", "behind", "name").agg(
            F.sum(F.col("n") * F.coalesce("trust", F.lit(0.0))).alias("good"),
            F.sum(F.when(F.col("trust").isNull(), F.col("n")).otherwise(0)).alias("open"),
            F.sum(F.when(F.col("trust").isNotNull(), F.col("n")).otherwise(0)).alias("met"),
            # One row per (pattern, value, seed): a value found by both forms counts once.
            F.count(F.when(F.col("trust").isNotNull() & F.col("first"), 1)).alias("different"),
            F.first("total").alias("total"),
        )
        other = F.greatest(F.lit(0), F.col("total") - F.col("met") - F.col("open"))
        share = F.col("good") / (F.col("met") + other + 1)
        good = patterns.select("kind", "behind", "name", share.alias("share")).filter(
            (F.col("different") >= LEAST_VALUES) & (F.col("share") >= LEAST_SHARE)
        )
        passing = edges.filter("not seed").join(good, ["kind", "behind", "name"]).groupBy("kind", "value").agg(F.max("share").alias("trust"))
        trusted = saved(
            trusted.unionByName(passing).groupBy("kind", "value").agg(F.max("trust").alias("trust")), "trusted-values"
        )
        now = trusted.count()
        if now == known:
            break
        known = now
    return trusted


def personal_data(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id``, a count of base spans per kind, base_sha256, spans, n_added.

    Base spans are those of the fixed forms; ``spans`` has them all and the learned ones, which overlap no other
    span. Of learned spans that overlap, the more trusted stays, then the earlier, then the longer. Learned are
    candidates whose value passes ``learned``; a value that is a seed elsewhere passes too. Whole texts are read; a
    null or empty text has no spans. Null and repeated ids stay as they are; an empty table gives no rows.
    """
    read = saved(read_all(docs, id, text), "identifiers")
    hints = read.select(F.explode("hints").alias("h")).select("h.*")
    at = hints.select("kind", "value", "seed", F.explode(F.arrays_zip("behind", "names")).alias("p"))
    edges = at.groupBy("kind", "value", "seed", F.col("p.behind").alias("behind"), F.col("p.names").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    edges = saved(edges, "edges")
    # Only runs next to enough values can become good patterns; others need no count and no edge.
    wanted = edges.groupBy("kind", "behind", "name").agg(F.count(F.lit(1)).alias("values")).filter(F.col("values") >= LEAST_VALUES)
    wanted = saved(wanted.select("name").distinct(), "wanted-runs")
    trusted = learned(edges, occurrences(docs, text, wanted))

    candidates_at = read.select("row", F.explode("hints").alias("h")).select("row", "h.*").filter("not seed")
    passed = candidates_at.join(trusted, ["kind", "value"]).groupBy("row").agg(
        F.collect_list(F.struct("start", "kind", "end", "trust")).alias("more")
    )
    columns = [*COUNTS, "base_sha256"]
    whole = read.select("row", "id", *columns, "base").join(passed, "row", "left").drop("row")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, added = [], []
            for base, more in zip(batch.column("base").to_pylist(), batch.column("more").to_pylist(), strict=True):
                taken = sorted((s["start"], s["kind"], s["end"]) for s in base)
                n = len(taken)
                # A candidate overlaps no base span; starts of chosen ones are kept in order.
                chosen: list[tuple[int, int, int]] = []
                for s in sorted(more or [], key=lambda s: (-s["trust"], s["start"], -s["end"], s["kind"])):
                    place = bisect.bisect_left(chosen, (s["start"], 0, 0))
                    clear = (place == 0 or chosen[place - 1][2] <= s["start"]) and (place == len(chosen) or chosen[place][0] >= s["end"])
                    if clear:
                        chosen.insert(place, (s["start"], s["kind"], s["end"]))
                spans.append(told(taken + chosen))
                added.append(len(chosen))
            kept = [batch.column(c) for c in ["id", *columns]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(spans, pa.string()), pa.array(added, pa.int64())], names=["id", *columns, "spans", "n_added"])

    kind = read.schema["id"].dataType.simpleString()
    kinds = "".join(f", {c} bigint" for c in COUNTS)
    done = whole.mapInArrow(put, f"id {kind}{kinds}, base_sha256 string, spans string, n_added bigint")
    return done.withColumnRenamed("id", id)
