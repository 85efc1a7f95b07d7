"""Archives: exact round trips. Mixing: sums against a plain calculation."""

import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from verdictlake.llm import mixing, shared, warc


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string, digest string, salt int")


def facts(spark, pages):
    return {r.record_id: r for r in warc.archived(spark, pages, shared.new_path(spark, "t")).collect()}


def test_copies_refer_to_the_largest_id(spark):
    long, other, short = "é" * 700, "b" * 2000, "short"
    rows = [(k, f"http://a/{k}", long, "d", 0) for k in range(40)]
    rows += [(50, "http://x y\r\n%41", other, None, None), (51, None, short, None, None), (52, "u", short, None, None), (53, "v", None, None, None)]
    got = facts(spark, pages_of(spark, rows))
    assert len(got) == len(rows)
    for k in range(40):
        row = got[str(k)]
        assert (row.record_type, row.refers_to) == (("revisit", "39") if k < 39 else ("response", None))
        assert row.payload_bytes == 1400 and row.payload_digest == hashlib.sha1(long.encode()).hexdigest()
    assert all(got[str(k)].record_type == "response" for k in (50, 51, 52, 53))
    assert got["53"].payload_bytes == 0


def test_null_ids_ties_and_empty_tables(spark):
    body = "c" * 1500
    rows = [(None, None, body, None, None), (7, "a", body, None, None), (7, "b", body, None, None), (None, "n", "x", None, None)]
    got = warc.archived(spark, pages_of(spark, rows), shared.new_path(spark, "t")).collect()
    assert sorted((r.record_id or "", r.record_type, r.payload_bytes) for r in got) == [
        ("", "response", 1),
        ("", "revisit", 1500),
        ("7", "response", 1500),
        ("7", "response", 1500),
    ]
    assert warc.archived(spark, pages_of(spark, rows).limit(0), shared.new_path(spark, "t")).count() == 0


def test_records_are_read_by_their_place(spark, tiny):
    pages = spark.read.parquet(f"{tiny}/pages.parquet")
    index = warc.write_archives(pages, shared.new_path(spark, "t"), frame_bytes=20_000, bundle_bytes=50_000)
    assert index.select("bundle", "frame").distinct().count() > 4
    wanted = index.filter("record_type = 'response'").orderBy("record_id").limit(9)
    read = {r.record_id: bytes(r.payload) for r in warc.read_records(wanted).collect()}
    html = {str(r.page_id): (r.html or "").encode() for r in pages.collect()}
    assert len(read) == 9 and all(html[k] == v for k, v in read.items())


def plain_targets(sizes):
    """Fill up sources by weight, again and again, until no target is above twice its source."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), list(names), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not over:
            out.update(share)
            break
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
            open_.remove(s)
    return out


def test_mix_takes_what_the_targets_say(spark, table, prose):
    rows = [(k, prose(5 + 13 * k % 90, k), ["a", "b", "é", "Z", None][k % 5] if k % 3 else "a") for k in range(300)]
    rows += [(900, None, "empty"), (901, "", "empty"), (902, " \t ", "empty"), (None, "one two", "b"), (5, rows[5][1], rows[5][2])]
    docs = table(rows, "doc_id bigint, text string, source string")
    got = mixing.scheduled(docs, keep=("source",)).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want, taken = plain_targets(sizes), defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.mix_source] and 0 <= r.taken <= 2 * r.size
        assert abs(r.target - want[r.mix_source]) < 1e-6
        taken[r.mix_source] += r.taken
    assert all(taken[s] == int(want[s] + 1e-9) for s in sizes)
    again = mixing.scheduled(docs.repartition(7)).select("doc_id", "size", "taken").collect()
    assert sorted(map(str, again)) == sorted(str(r) for r in mixing.scheduled(docs).select("doc_id", "size", "taken").collect())


def test_mix_is_in_order_and_cut(spark, table, prose):
    docs = table([(k, prose(40, k), "ab"[k % 2]) for k in range(60)], "doc_id bigint, text string, source string")
    mix = mixing.mixed(docs).collect()
    finish = [r.virtual_finish for r in mix]
    assert finish == sorted(finish)
    assert all(len(r.text.split()) == r.words for r in mix)
    assert sum(r.words for r in mix) == sum(r.taken for r in mixing.scheduled(docs).collect())
    assert mixing.mixed(docs.limit(0)).count() == 0


def test_mix_runs_no_python(spark, table, plan_of):
    plan = plan_of(mixing.scheduled(table([(1, "a", "s")], "doc_id bigint, text string, source string")))
    assert not re.search("Python|Pandas|Arrow", plan)


def test_pages_that_share_an_id_keep_their_own_digests(spark):
    first, second = "A" * 1200, "B" * 3000
    rows = [(7, None, first, None, 0), (3, None, first, None, 0), (7, None, second, None, 0), (2, None, second, None, 0)]
    got = warc.archived(spark, pages_of(spark, rows), shared.new_path(spark, "t")).collect()
    assert sorted((r.record_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in got) == sorted(
        (str(i), "response" if i == 7 else "revisit", None if i == 7 else "7", len(t), hashlib.sha1(t.encode()).hexdigest()) for i, _, t, _, _ in rows
    )
