import random
import re
from collections import Counter
from datetime import datetime, timedelta
from fractions import Fraction

import pandas as pd
import pytest
from pyspark.sql import functions as F

from verdictlake.functions import exact, nli, text
from verdictlake.functions.ordinals import first_per_group, number_rows, ordinals, trailing_sum
from verdictlake.functions.quantiles import (
    interpolated_units,
    percentile_ranks,
    histograms,
    order_statistics,
    rank_values,
    upper_median_rank,
    value_bucket,
)
from verdictlake.functions.rouge import tokens, with_rouge


def half_up(value: Fraction, places: int) -> float:
    return int(value * 10**places + Fraction(1, 2)) / 10**places


def test_rounded_ratio_is_exact_half_up(spark):
    cases = [(1, 32, 4), (0, 7, 4), (2, 3, 4), (5, 1, 2), (10**18 + 1, 3 * 10**9, 4), (669, 200, 2)]
    df = spark.createDataFrame(cases, "a bigint, b bigint, p int")
    for places in (2, 4):
        rows = df.filter(F.col("p") == places).select(
            "a", "b", exact.rounded_ratio(F.col("a"), F.col("b"), 0, places).alias("r")
        )
        for row in rows.collect():
            assert row.r == half_up(Fraction(row.a, row.b), places)


def test_scaled_undoes_stored_decimals(spark):
    values = [i / 10000 for i in range(10001)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i bigint, v double")
    assert df.filter(exact.score_units(F.col("v")) != F.col("i")).count() == 0


def reference_percentile(values, pct):
    values = sorted(values)
    k = Fraction((len(values) - 1) * pct, 100)
    low = int(k)
    high = min(low + 1, len(values) - 1)
    return values[low] + (values[high] - values[low]) * (k - low)


def test_rank_values_on_skewed_groups(spark):
    rng = random.Random(5)
    groups = {
        "one": [17],
        "two": [3, 900000],
        "even": [rng.randrange(100) for _ in range(40)],
        "odd": [rng.randrange(10**9) for _ in range(41)],
        "same": [250] * 500,
        "hot": [int(rng.lognormvariate(9, 2)) for _ in range(20000)],
        "signed": [rng.randrange(-1000, 1000) for _ in range(300)],
    }
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v bigint")
    ranks = {**percentile_ranks(50, "p50"), **percentile_ranks(95, "p95"), "mid": upper_median_rank}
    out = rank_values(df, ["g"], "v", ranks).select(
        "g", "n", "mid", interpolated_units(50, "p50").alias("p50"), interpolated_units(95, "p95").alias("p95")
    )
    rows = {r.g: r for r in out.collect()}
    assert set(rows) == set(groups)
    for g, values in groups.items():
        assert rows[g].n == len(values)
        assert rows[g].mid == sorted(values)[len(values) // 2]
        assert rows[g].p50 == reference_percentile(values, 50) * 100
        assert rows[g].p95 == reference_percentile(values, 95) * 100


def test_histograms_are_the_first_and_only_shuffle_of_all_rows(spark, plan_of):
    df = spark.range(100_000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 100_003).alias("v"), F.lit("t").alias("text"))
    parts = histograms(df, ["g"], "v", {"total": F.sum("v")})
    plan = plan_of(parts)
    assert re.findall(r"hashpartitioning\(([^)]*)\)", plan) and "v#" not in "".join(re.findall(r"hashpartitioning\(([^)]*)\)", plan))
    # A group has one row per bucket, however many rows it holds, and parts of a table add up.
    assert parts.groupBy("g").count().agg(F.max("count")).first()[0] < 18 * 16
    halves = [histograms(df.filter(f"id % 2 = {k}"), ["g"], "v", {"total": F.sum("v")}) for k in (0, 1)]
    added = halves[0].unionByName(halves[1]).groupBy("g", "_bucket").agg(F.sum("_count").alias("_count"), F.sum("total").alias("total"))
    assert sorted(map(tuple, added.collect())) == sorted(map(tuple, parts.collect()))
    # The wanted buckets are sent to the rows, so only rows of those are counted by value.
    out = order_statistics(df, ["g"], "v", percentile_ranks(95, "p95"), {"total": F.sum("v")})
    out.collect()
    assert re.search(r"BroadcastHashJoin \[g#\d+L, _bucket#\d+L\]", plan_of(out))


def test_order_statistics_keep_groups_without_values(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", None, 2), ("b", 4, 3), (None, 5, 4)], "g string, v bigint, w int")
    out = order_statistics(df, ["g"], "v", {"mid": upper_median_rank}, {"w": F.sum("w")})
    assert sorted(tuple(r) for r in out.select("g", "w", "n", "mid").collect()) == [("a", 3, 0, None), ("b", 3, 1, 4)]


def test_rank_values_ignores_nulls_and_empty_input(spark):
    df = spark.createDataFrame([("a", None), ("a", 4), (None, 5)], "g string, v bigint")
    out = rank_values(df, ["g"], "v", {"mid": upper_median_rank})
    assert [tuple(r) for r in out.collect()] == [("a", 1, 4)]
    assert rank_values(df.limit(0), ["g"], "v", {"mid": upper_median_rank}).count() == 0


def test_value_bucket_never_decreases(spark):
    values = sorted({0, 1, 2, 3, 4095, 4096, 2**31, 2**53, 2**62} | {2**k + d for k in range(62) for d in (-1, 0, 1)})
    values = [-v for v in reversed(values) if v] + values
    df = spark.createDataFrame([(v,) for v in values], "v bigint").select("v", value_bucket(F.col("v")).alias("b"))
    buckets = [r.b for r in df.orderBy("v").collect()]
    assert buckets == sorted(buckets)


def test_number_rows_matches_one_ordered_pass(spark):
    rng = random.Random(9)
    rows = [(rng.choice("aaab"), rng.randrange(5000), i) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, pos bigint, i bigint")
    taken = spark.createDataFrame([("b", 40)], "g string, taken bigint")
    out = number_rows(df, ["g"], F.floor(F.col("pos") / 64), ["pos", "i"], "no", already=taken)
    for g, start in (("a", 0), ("b", 40)):
        want = [(r[2], k + 1 + start) for k, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: r[1:]))]
        got = [(r.i, r.no) for r in out.filter(F.col("g") == g).orderBy("no").collect()]
        assert got == want


def test_trailing_sum_looks_back_only(spark):
    values = [5, 1, 4, 2, 8, 7, 9]
    df = spark.createDataFrame([("a", k + 1, v) for k, v in enumerate(values)], "g string, no bigint, v bigint")
    out = trailing_sum(df, ["g"], "no", "v", 3, "total", "seen").orderBy("no").collect()
    assert [r.v for r in out] == values
    assert [r.seen for r in out] == [0, 1, 2, 3, 3, 3, 3]
    assert [r.total for r in out][3:] == [10, 7, 14, 17]


def test_first_per_group_limits_before_the_shuffle(spark, plan_of):
    df = spark.range(100).select((F.col("id") % 4).alias("g"), "id")
    out = first_per_group(df, ["g"], F.col("id").desc())
    assert sorted(r.id for r in out.collect()) == [96, 97, 98, 99]
    assert plan_of(out).count("WindowGroupLimit") >= 2


@pytest.mark.parametrize(
    "given, want",
    [
        ("```yaml\n- id: a\n```", "- id: a"),
        ("  ```\nx\n```  \n", "x"),
        ("```json\n[]\n```", "json\n[]"),
        ("no fence", "no fence"),
        ("\x0b\x1f a b \n", "a b"),
        ("", ""),
    ],
)
def test_strip_fences(spark, given, want):
    assert spark.createDataFrame([(given,)], "t string").select(text.strip_fences(F.col("t"))).first()[0] == want


def test_posix_path(spark):
    cases = {"a\\b": "a/b", "./a/": "a", "a//b": "a/b", "a/./b": "a/b", "/x": "/x", "a.b/c.yaml": "a.b/c.yaml"}
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    assert {r.p: r.q for r in df.select("p", text.posix_path(F.col("p")).alias("q")).collect()} == cases


def test_tokens(spark):
    df = spark.createDataFrame([("Hello, World-2!",), ("naïve café",), ("  ",), ("",)], "t string")
    got = [r[0] for r in df.select(tokens(F.col("t"))).collect()]
    assert got == [["hello", "world", "2"], ["na", "ve", "caf"], [], []]


# (reference, answer, rouge1, rouge2, rougeL), worked out by hand
GOLDEN = [
    ("the cat sat on the mat", "the cat sat on the mat", 1.0, 1.0, 1.0),
    ("the cat sat on the mat", "the cat lay on the mat", 0.8333, 0.6, 0.8333),
    ("a b c d", "d c b a", 1.0, 0.0, 0.25),
    ("a a a b", "a b b", 0.5714, 0.4, 0.5714),
    ("word", "word", 1.0, 0.0, 1.0),
    ("word", "other", 0.0, 0.0, 0.0),
    ("", "something", 0.0, 0.0, 0.0),
    ("something", "", 0.0, 0.0, 0.0),
    ("Yes!", "yes", 1.0, 0.0, 1.0),
]


def test_rouge_golden(spark):
    df = spark.createDataFrame(
        [(i, g[0], g[1]) for i, g in enumerate(GOLDEN)], "i int, expected string, response_text string"
    )
    got = [(r.rouge1, r.rouge2, r.rougeL) for r in with_rouge(df).orderBy("i").collect()]
    assert got == [g[2:] for g in GOLDEN]


def brute_lcs(a, b):
    line = [0] * (len(b) + 1)
    for x in a:
        previous = line
        line = [0]
        for j, y in enumerate(b):
            line.append(previous[j] + 1 if x == y else max(previous[j + 1], line[j]))
    return line[-1]


def brute_scores(a, b):
    def f1(overlap, la, lb):
        return half_up(Fraction(2 * overlap, la + lb), 4) if overlap else 0.0

    def grams(x, n):
        return Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1))

    out = []
    for n in (1, 2):
        ga, gb = grams(a, n), grams(b, n)
        out.append(f1(sum((ga & gb).values()), sum(ga.values()), sum(gb.values())))
    out.append(f1(brute_lcs(a, b), len(a), len(b)))
    return tuple(out)


def test_rouge_against_brute_force(spark):
    rng = random.Random(3)
    words = ["w%d" % i for i in range(12)]
    pairs = [
        ([rng.choice(words) for _ in range(rng.randrange(90))], [rng.choice(words) for _ in range(rng.randrange(90))])
        for _ in range(150)
    ]
    df = spark.createDataFrame(
        [(i, " ".join(a), " ".join(b)) for i, (a, b) in enumerate(pairs)],
        "i int, expected string, response_text string",
    )
    got = {r.i: (r.rouge1, r.rouge2, r.rougeL) for r in with_rouge(df).collect()}
    assert got == {i: brute_scores(a, b) for i, (a, b) in enumerate(pairs)}


def test_rouge_scores_can_be_asked_for_singly(spark):
    df = spark.createDataFrame([("a b", "a c")], "expected string, response_text string")
    assert with_rouge(df, scores=["rougeL"]).columns == ["expected", "response_text", "rougeL"]


def test_rouge_does_not_shuffle(spark, plan_of):
    df = spark.range(5).select(F.lit("a b").alias("expected"), F.lit("a c").alias("response_text"))
    plan = plan_of(with_rouge(df))
    assert "Exchange" not in plan and plan.count("ArrowEvalPython") == 1


def test_pair_text_of_whole_texts(spark):
    df = spark.createDataFrame([("é" * 600, "x" * 700)], "e string, r string")
    pair = df.select(nli.pair_text(F.col("e"), F.col("r"), kept=None)).first()[0]
    assert pair == "é" * 600 + " [SEP] " + "x" * 700


def test_pair_text_keeps_500_characters(spark):
    df = spark.createDataFrame([("é" * 600, "x" * 499)], "e string, r string")
    pair = df.select(nli.pair_text(F.col("e"), F.col("r"))).first()[0]
    assert pair == "é" * 500 + " [SEP] " + "x" * 499


def test_verdict_and_ties(spark):
    df = spark.createDataFrame(
        [(1.0, 1.0, 1.0), (0.0, 2.0, 2.0), (0.0, 0.0, 5.0)], "contradiction double, entailment double, neutral double"
    )
    got = [(r.nli_label, r.nli_confidence, r.hallucination_flag) for r in nli.with_verdict(df).collect()]
    assert got == [("contradiction", 0.3333, True), ("entailment", 0.4683, False), ("neutral", 0.9867, False)]


def test_classifier_is_loaded_per_task(spark):
    def load():
        import pandas as pd

        def classify(texts):
            n = texts.str.len()
            return pd.DataFrame({"neutral": n * 0.0, "contradiction": n * 1.0, "entailment": -n})

        return classify

    df = spark.createDataFrame([("abc",), ("",)], "t string")
    got = [tuple(r) for r in nli.with_class_scores(df, load, F.col("t")).orderBy("t").collect()]
    assert got == [("", 0.0, 0.0, 0.0, None), ("abc", 3.0, -3.0, 0.0, None)]


def test_timestamps_are_utc(spark):
    start = datetime(2024, 3, 31, 1, 30)
    df = spark.createDataFrame([(start, start + timedelta(hours=1))], "a timestamp_ntz, b timestamp_ntz")
    row = df.select((F.unix_micros(F.col("b").cast("timestamp")) - F.unix_micros(F.col("a").cast("timestamp")))).first()
    assert row[0] == 3600 * 10**6


def test_a_text_that_cannot_be_classified_fails_alone(spark):
    import pandas as pd

    def load():
        def classify(texts):
            if (texts == "bad").any():
                raise ValueError("cannot read this")
            return pd.DataFrame({"contradiction": [1.0] * len(texts), "entailment": 0.0, "neutral": 0.0})

        return classify

    df = spark.createDataFrame([("good",), ("bad",), ("fine",)], "t string").coalesce(1)
    got = {r.t: (r.contradiction, r.score_error) for r in nli.with_class_scores(df, load, F.col("t")).collect()}
    assert got == {"good": (1.0, None), "bad": (None, "cannot read this"), "fine": (1.0, None)}


def test_numbers_with_null_keys_and_slices(spark):
    from verdictlake.functions.ordinals import number_rows

    rows = [("a", 1), ("a", None), (None, 1), (None, 2), ("a", 0)]
    df = spark.createDataFrame(rows, "k string, p int")
    taken = spark.createDataFrame([(None, 10)], "k string, taken int")
    got = {(r.k, r.p): r.no for r in number_rows(df, ["k"], F.col("p"), ["p"], "no", already=taken).collect()}
    assert got == {("a", 0): 1, ("a", 1): 2, ("a", None): 3, (None, 1): 11, (None, 2): 12}


def test_ordinals_of_a_hot_group_are_exact(spark, plan_of):
    # 9000 of 10000 rows are one group, some keys are null.
    df = spark.range(10_000).select(
        F.when(F.col("id") % 10 == 0, F.col("id") % 30).alias("g"), (F.col("id") * 7919 % 10_007).alias("pos"), F.lit("t").alias("text")
    )
    taken = spark.createDataFrame([(10, 5)], "g bigint, taken bigint")
    got = ordinals(df.repartition(5), ["g"], ["pos"], "no", already=taken)
    rows = [(r.g, r.pos, r.no) for r in got.collect()]
    groups = {}
    for g, pos, no in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        groups.setdefault(g, []).append(no)
    assert {g: len(n) for g, n in groups.items()} == {None: 9000, 0: 334, 10: 333, 20: 333}
    assert all(n == list(range(1 + 5 * (g == 10), len(n) + 1 + 5 * (g == 10))) for g, n in groups.items())
    whole = ordinals(df, [], ["pos"], "no")
    assert sorted(r.no for r in whole.collect()) == list(range(1, 10_001))
    # The one window over everything has a row per partition.
    plan = plan_of(whole)
    assert "SinglePartition" not in plan.split("Window")[0]


def test_blocked_subsequence_equals_the_plain_one(spark):
    import random as r

    from verdictlake.functions.rouge import _overlap_udf

    rng = r.Random(8)
    pairs = [(["x"] * 40, ["x"] * 23), ([], ["a"]), (["a"], [])]
    pairs += [([rng.choice("abcd") for _ in range(rng.randrange(60))], [rng.choice("abcde") for _ in range(rng.randrange(60))]) for _ in range(60)]

    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before = row[:]
            for j, y in enumerate(b):
                row[j + 1] = before[j] + 1 if x == y else max(before[j + 1], row[j])
        return row[-1]

    left, right = (pd.Series([" ".join(p[k]) for p in pairs]) for k in (0, 1))
    want = [plain(a, b) for a, b in pairs]
    for block in (1, 3, 16, 8192):
        assert _overlap_udf(["lcs"], block).func(left, right)["overlap_lcs"].tolist() == want


def test_blocked_subsequence_of_a_long_text_takes_little_memory(spark):
    import tracemalloc

    from verdictlake.functions.rouge import _overlap_udf

    a = [f"w{k}" for k in range(60_000)]
    left, right = pd.Series([" ".join(a)]), pd.Series([" ".join(a[::200])])
    tracemalloc.start()
    got = _overlap_udf(["lcs"]).func(left, right)["overlap_lcs"].tolist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # One mask a word as long as the text would take 450 MB.
    assert got == [300] and peak < 60e6
