"""Registered queries next to their SQL, and the pipeline's rules, on the smallest tables."""

import pytest

import corpus_pipeline
from checks.compare import duck, duck_rows, spark_rows
from verdictlake.llm import simhash
from verdictlake.llm.queries import QUERIES
from verdictlake.llm.shared import saved
from verdictlake.llm.sql import ORACLES


def test_one_query_for_each_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, tiny, name):
    df = QUERIES[name](spark, tiny)
    columns, want = duck_rows(duck(tiny), ORACLES[name])
    assert sorted(df.columns) == sorted(columns) and spark_rows(df) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_has_a_row_per_document(spark, tiny, name):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    assert QUERIES[name](spark, tiny).count() == docs.count()


def test_pipeline_stages(spark, tiny, tmp_path, prose):
    folder = str(tmp_path)
    passage, leak = prose(45, 900), prose(30, 901)
    rows = [(k, prose(120, k)) for k in range(40)]
    rows += [(100, rows[7][1]), (101, rows[8][1] + " tail"), (102, prose(60, 50) + " " + passage), (103, prose(60, 51) + " " + passage)]
    rows += [(104, prose(40, 52) + " " + leak + " " + prose(30, 53)), (105, "junk$$$ more### " * 40), (106, "bad$$$ worse### " * 40)]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t), "extra") for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string")
    labels = [(i, 1, 0) for i, _ in rows[:40]] + [(105, 0, 0), (106, 0, 0)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, leak)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = saved(stage(spark, docs, folder), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "kept"]
        left[name] = {r.doc_id: r for r in docs.collect()}
    everything = {i for i, _ in rows}
    assert set(left["quality_classifier"]) == everything - {105, 106}
    assert set(left["near_dedup"]) == everything - {100, 101, 105, 106}
    cut = left["repeated_passages"]
    assert set(cut) == set(left["near_dedup"])
    for i in (102, 103):
        assert cut[i].text == dict(rows)[i].removesuffix(" " + passage) and cut[i].n_chars == len(cut[i].text)
    assert all(cut[i].text == dict(rows)[i] for i in cut if i not in (102, 103))
    assert set(left["benchmark_decontamination"]) == set(cut) - {104}
    mix = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert {r.doc_id for r in mix} <= set(left["benchmark_decontamination"])
    assert mix and all(0 < r.taken <= 2 * r.size for r in mix)


def test_near_dedup_keeps_the_first_of_each_fingerprint_group(spark, prose):
    base = [prose(200, 3000 + k) for k in range(20)]
    near = [" ".join("changed" if k % (40 + 8 * n) == 5 else w for k, w in enumerate(t.split())) for n, t in enumerate(base)]
    rows = list(enumerate(base + near + base[:4] + ["", None, " \t"]))
    prints = [simhash.fingerprint((t or "").encode()) & (1 << 64) - 1 for _, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 4 and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = [low if g == high else g for g in group]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    left = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert left == set(group) and len(left) < 42


def test_near_dedup_with_repeated_and_null_ids(spark, prose):
    one, other, third = prose(200, 1), prose(200, 2), prose(200, 3)
    rows = [(1, one), (None, one + " tail"), (None, other), (5, third), (1, third + " tail"), (1, prose(90, 4)), (7, prose(90, 4))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert got == {(1, one), (None, other), (1, third + " tail"), (1, prose(90, 4))}


def test_cut_texts_stay_with_their_rows_under_repeated_and_null_ids(spark, prose):
    passage, own = prose(45, 900), [prose(60, 60 + k) for k in range(7)]
    with_it = [(i, f"{own[k]} {passage}") for k, i in enumerate((1, None, 1, None))]
    rows = with_it + [(1, own[4]), (None, own[5]), (None, passage), (3, own[6]), (1, with_it[0][1])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((str(r.doc_id), r.text) for r in corpus_pipeline.repeated_passages(spark, docs, "").collect())
    # The row that occurs twice is wholly repeated, as is the passage alone; the others lose the passage only.
    want = [(None, own[1]), (1, own[2]), (None, own[3]), (1, own[4]), (None, own[5]), (3, own[6])]
    assert got == sorted((str(i), t) for i, t in want)


def test_pipeline_takes_empty_tables(spark, tiny, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tiny}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_over_the_smallest_tables(spark, tiny):
    assert 0 < corpus_pipeline.run(spark, tiny).count() < spark.read.parquet(f"{tiny}/documents.parquet").count()
