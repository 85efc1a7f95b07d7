"""The filter audit against a plain reading of its rules, with smaller ids that arrive late."""

import itertools
import random
import re
from collections import Counter

import pytest

from verdictlake.llm import audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, labels):
    """Every part, order and step, document by document. Rows are (doc_id, text, source)."""
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, x in labels if x == 1}
    failed = []
    for i, t, s in rows:
        t, w = t or "", WORD.findall(t or "")
        tests = {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t),
            "D": any(c in "#$%&*|" for c in t),
            "E": i is not None and least[t] < i,
        }
        failed.append((s or "", i, {f for f in tests if tests[f]}))
    out = {}
    for order in map("".join, itertools.permutations("ABCDE")):
        for k, f in enumerate(order):
            before = set(order[:k])
            for part in {p for p, _, _ in failed}:
                c = Counter()
                for p, i, fails in failed:
                    if p == part:
                        c["kept"] += not fails & (before | {f})
                        now = f in fails and not fails & before
                        c["removed"] += now
                        c["redundant"] += f in fails and bool(fails & before)
                        c["unique_fails"] += fails == {f}
                        c["good_lost"] += now and i in good
                        c["toxic_lost"] += now and i in toxic
                out[part, order, k + 1] = c
    for (part, order, k), c in out.items():
        f = order[k - 1]
        c["shapley"] = sum(out[part, o, o.index(f) + 1]["removed"] for o in map("".join, itertools.permutations("ABCDE")))
    return out


def as_rows(found):
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return sorted((p, o, k, *[int(c[n]) for n in names]) for (p, o, k), c in found.items())


def collected(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(5)
    long = [" ".join(f"w{rng.randrange(900)}" for _ in range(220)) for _ in range(6)]
    texts = [*long, "x " * 300, "SHOUT " * 210, "a # b", "", None, " \t", "é" * 49 + "A", "é" * 50 + "A", long[0] + " $"]
    rows = [(1000 - k, texts[rng.randrange(len(texts))], rng.choice(["web", "book", None, ""])) for k in range(160)]
    rows += [(None, long[1], "web"), (None, long[1], "web"), (7, long[2], "web"), (7, long[2], "book"), (7, long[2], "book"), (7, "other", None)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(860, 1001, 2)] + [(7, 1, 0), (7, 0, 1), (None, 1, 1)]
    return rows, labels


def stored(spark, rows, path, files):
    """Rows in as many files, one after the other, so that smaller ids come in later ones."""
    schema = "doc_id bigint, text string, source string, mask int, n int, slice string, named string"
    size = -(-len(rows) // files)
    for k in range(files):
        part = [(*r, 9, 9, "x", "y") for r in rows[k * size : (k + 1) * size]]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)


def test_audit_equals_brute_force_over_several_batches(spark, tmp_path, cases):
    rows, labels = cases
    stored(spark, rows, f"{tmp_path}/documents.parquet", 4)
    known = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = audit.audit_files(spark, f"{tmp_path}/documents.parquet", known, batches=4)
    assert collected(got) == as_rows(brute(rows, labels))


def test_later_files_take_earlier_counts_back(spark, tmp_path, cases):
    rows, labels = cases
    path, place = f"{tmp_path}/documents.parquet", f"{tmp_path}/place"
    known = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    stored(spark, rows[:60], path, 1)
    schema = spark.read.parquet(path).schema

    def now():
        docs = spark.readStream.schema(schema).parquet(path)
        return collected(audit.interactions(audit.audit(docs, known, 8, place)))

    assert now() == as_rows(brute(rows[:60], labels))
    stored(spark, rows[60:], path, 2)
    assert now() == as_rows(brute(rows, labels))
    assert now() == as_rows(brute(rows, labels))
    entered = spark.read.parquet(f"{place}/counters")
    assert entered.filter("n < 0").count() > 0


def test_equal_texts_of_a_task_pass_one_candidate_on(cases):
    import pyarrow as pa

    batch = pa.record_batch([pa.array([5, 3, 9, 3, None], pa.int64()), pa.array(["t"] * 5), pa.array(["p", "p", "q", "q", "p"])], names=["id", "text", "part"])
    (facts,) = audit.facts(iter([batch]), 16)
    told = Counter((r["id"], r["named"], r["part"], r["mask"] >= 16, r["n"], r["sure"]) for r in facts.to_pylist())
    assert told == Counter(
        [(3, True, "p", False, 1, False), (3, True, "q", False, 1, False), (5, True, "p", True, 1, True), (9, True, "q", True, 1, True), (0, False, "p", False, 1, True)]
    )


def test_audit_of_empty_tables(spark, tmp_path):
    stored(spark, [], f"{tmp_path}/none.parquet", 1)
    known = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert audit.audit_files(spark, f"{tmp_path}/none.parquet", known).count() == 0
