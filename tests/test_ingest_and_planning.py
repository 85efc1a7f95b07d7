import json

import pytest
from pyspark.sql import functions as F

from verdictlake.operators import ingest, planning
from verdictlake.sources import suites

SAMPLE = "sample_id string, prompt string, expected string, domain string, tags array<string>, difficulty string"


@pytest.fixture
def suite_dir(tmp_path):
    (tmp_path / "b.yaml").write_text(
        "- id: b1\n  prompt: P1\n  expected: |\n    line one\n    line two\n"
        "  domain: legal\n  tags: [x, y]\n  difficulty: hard\n"
        "- id: b2\n  prompt: P2\n  expected: E2\n  domain: null\n  tags: null\n  difficulty: null\n"
    )
    (tmp_path / "a.yaml").write_text("- id: 7\n  prompt: 'Frage: ä?'\n  expected: E\n- id: a2\n  expected: no prompt\n")
    (tmp_path / "empty.yaml").write_text("")
    (tmp_path / "broken.yaml").write_text("- id: [unclosed\n")
    (tmp_path / "mapping.yaml").write_text("id: x\n")
    (tmp_path / "notes.txt").write_text("- id: no\n")
    (tmp_path / "nested").mkdir()
    (tmp_path / "nested" / "c.yaml").write_text("- {id: c, prompt: p, expected: e}\n")
    return tmp_path


def test_suite_folder(spark, suite_dir):
    items = suites.parse_suites(suites.read_suite_files(spark, str(suite_dir)))
    good = [
        (r.sample_id, r.prompt, r.expected, r.domain, r.tags, r.difficulty)
        for r in suites.good_items(items).orderBy("file", "pos").collect()
    ]
    assert good == [
        ("7", "Frage: ä?", "E", "general", [], "medium"),
        ("b1", "P1", "line one\nline two\n", "legal", ["x", "y"], "hard"),
        ("b2", "P2", "E2", None, None, None),
    ]
    bad = {(r.file.rsplit("/", 1)[1], r.pos, r.reject_reason) for r in suites.bad_items(items).collect()}
    assert bad == {
        ("a.yaml", 1, "missing prompt"),
        ("broken.yaml", None, "unreadable: ParserError"),
        ("mapping.yaml", None, "not a list"),
    }


def test_single_file_and_strict_load(spark, suite_dir):
    one = suites.load_suite(spark, str(suite_dir / "b.yaml"))
    assert [r.sample_id for r in one.orderBy("pos").collect()] == ["b1", "b2"]
    clean = suites.parse_suites(suites.read_suite_files(spark, str(suite_dir / "b.yaml")))
    assert suites.strict_items(clean).count() == 2
    dirty = suites.parse_suites(suites.read_suite_files(spark, str(suite_dir / "a.yaml")))
    with pytest.raises(Exception, match="missing prompt"):
        suites.strict_items(dirty).collect()


def test_catalog_and_suites_below_a_root(spark, tmp_path):
    for name in ("qa/b.yaml", "qa/a.yaml", "code/c.yaml"):
        file = tmp_path / "sets" / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(f"- {{id: {file.stem}, prompt: p, expected: e}}\n")
    root = str(tmp_path / "sets")
    paths = {"datasets/qa", "datasets/code", "datasets/qa/a.yaml", "datasets/qa/b.yaml", "datasets/code/c.yaml"}
    assert {r.path for r in suites.suite_catalog(spark, root).collect()} == paths
    samples = suites.load_suites(spark, root)
    by_dataset = {}
    for r in samples.orderBy("file", "pos").collect():
        by_dataset.setdefault(r.dataset, []).append(r.sample_id)
    assert by_dataset["datasets/qa"] == ["a", "b"] and by_dataset["datasets/qa/b.yaml"] == ["b"]
    assert set(by_dataset) == paths


def test_table_suites(spark, tmp_path):
    path = str(tmp_path / "suite.json")
    with open(path, "w") as out:
        out.write(json.dumps({"sample_id": "a", "prompt": "p", "expected": "e"}) + "\n")
    row = suites.load_table_suite(spark, path, "json").first()
    assert (row.domain, row.tags, row.difficulty) == ("general", [], "medium")
    assert row.file.endswith("suite.json")


def test_defaults_add_missing_columns(spark):
    df = spark.createDataFrame([("a", "p", "e")], "sample_id string, prompt string, expected string")
    assert ingest.suite_defaults(df).first()[3:] == ("general", [], "medium")


def test_duplicate_ids_are_kept_and_reported(spark):
    df = spark.createDataFrame([("d", "a"), ("d", "a"), ("e", "a")], "dataset string, sample_id string")
    assert [tuple(r) for r in ingest.duplicate_sample_ids(df).collect()] == [("d", "a", 2)]


def test_request_validation(spark):
    requests = spark.createDataFrame(
        [
            ("ok", "legal_qa", ["m"], None, None),
            ("path", "datasets/legal_qa", ["m"], True, False),
            ("no models", "legal_qa", [], None, None),
            ("null models", "legal_qa", None, None, None),
            ("unknown", "does_not_exist", ["m"], None, None),
            ("both", "does_not_exist", [], None, None),
        ],
        "request_id string, dataset string, models array<string>, smoke_test boolean, use_mlflow boolean",
    )
    catalog = spark.createDataFrame([("datasets/legal_qa",), ("datasets/legal_qa",)], "path string")
    checked = ingest.validate_requests(requests, catalog)
    got = {r.request_id: (r.dataset_path, r.smoke_test, r.use_mlflow, r.reject_reason) for r in checked.collect()}
    assert got["ok"] == ("datasets/legal_qa", False, True, None)
    assert got["path"] == ("datasets/legal_qa", True, False, None)
    assert got["no models"][3] == got["null models"][3] == got["both"][3] == "no models given"
    assert got["unknown"][3] == "dataset not found"
    assert ingest.accepted(checked).count() == 2 and ingest.rejected(checked).count() == 4


def test_smoke_limit_is_per_suite_in_file_order(spark):
    rows = [("d", "b.yaml", 0, "4"), ("d", "a.yaml", 1, "2"), ("d", "a.yaml", 0, "1"), ("e", "z", 5, "9")]
    df = spark.createDataFrame(rows, "dataset string, file string, pos bigint, sample_id string")
    assert sorted(r.sample_id for r in ingest.smoke_limit(df).collect()) == ["1", "2", "9"]


def test_model_catalog(spark):
    known = spark.createDataFrame([("phi",), ("gemma",)], "name string")
    live = spark.createDataFrame([("gemma",), ("zeta",), ("gemma",)], "name string")
    both = ingest.model_catalog(live, known)
    assert [tuple(r) for r in both.collect()] == [("gemma", True), ("phi", False), ("zeta", True)]
    assert ingest.default_model(both).first().name == "gemma"
    offline = ingest.model_catalog(live.limit(0), known)
    assert [tuple(r) for r in offline.collect()] == [("gemma", False), ("phi", False)]
    assert ingest.default_model(offline).count() == 0


def test_append_continues_the_numbers_of_each_domain(spark):
    existing = spark.createDataFrame([("x1", "p", "e", "law", [], "easy"), ("x2", "p", "e", "law", [], "easy")], SAMPLE)
    new = spark.createDataFrame(
        [(f"?{i}", f"p{i}", "e", domain, [], "hard", i) for i, domain in enumerate(["law", "code", "law"])],
        SAMPLE + ", pos bigint",
    )
    out = ingest.append_generated(existing, new, ["pos"])
    assert sorted(r.sample_id for r in out.collect()) == ["code_auto_001", "law_auto_003", "law_auto_004", "x1", "x2"]


def test_adhoc_samples(spark):
    given = spark.createDataFrame(
        [("q1", "a1", 0), ("", "a", 1), ("q", None, 2), (" ", "a3", 3)], "prompt string, expected string, pos bigint"
    )
    out = ingest.adhoc_samples(given, ["pos"]).orderBy("sample_id").collect()
    assert [(r.sample_id, r.prompt, r.domain, r.tags) for r in out] == [
        ("custom_001", "q1", "custom", ["custom"]),
        ("custom_002", " ", "custom", ["custom"]),
    ]
    assert ingest.rejected(ingest.check_adhoc_samples(given)).count() == 2


@pytest.fixture
def small_plan(spark):
    return spark.createDataFrame(
        [("r", s, "ask " + s, "e", "d", m) for s in ("a", "b") for m in ("m1", "m2")],
        "run_id string, sample_id string, prompt string, expected string, domain string, model_name string",
    )


def test_eval_plan_keeps_duplicate_samples_and_limits_smoke_runs(spark, plan_of):
    samples = spark.createDataFrame(
        [("d", "f", i, s) for i, s in enumerate(["a", "a", "b"])], "dataset string, file string, pos bigint, sample_id string"
    )
    runs = spark.createDataFrame(
        [("full", "d", ["m1", "m2"], False), ("smoke", "d", ["m1"], True), ("other", "x", ["m1"], None)],
        "run_id string, dataset string, models array<string>, smoke_test boolean",
    )
    plan = planning.eval_plan(samples, runs)
    got = sorted((r.run_id, r.sample_id, r.model_name) for r in plan.collect())
    assert got == sorted(
        [("full", s, m) for s in ("a", "a", "b") for m in ("m1", "m2")] + [("smoke", "a", "m1"), ("smoke", "a", "m1")]
    )
    assert "CartesianProduct" not in plan_of(plan) and "NestedLoop" not in plan_of(plan)
    assert planning.eval_plan(samples, runs.drop("smoke_test")).count() == 9


def counted(df, name):
    return {r.run_id: r[name] for r in df.collect()}


def test_call_totals_equal_the_plan_and_its_failures(spark):
    from verdictlake.operators import scoring

    samples = spark.createDataFrame(
        [("d", "f", i, s) for i, s in enumerate(["a", "a", "b", "c", None])] + [("x", "f", 9, "a"), (None, "f", 10, "a")],
        "dataset string, file string, pos bigint, sample_id string",
    )
    runs = spark.createDataFrame(
        [
            ("full", "d", ["m1", "m2", "m1", None], False), ("smoke", "d", ["m1"], True), ("none", "d", [], False),
            ("null", "d", None, False), ("other", "x", ["m1"], None), ("twice", "d", ["m1"], False),
            ("twice", "x", ["m1", "m2"], False), ("twice", "d", ["m1"], True), (None, "d", ["m1"], False),
            ("lost", None, ["m1"], False), ("gone", "missing", ["m1"], False),
        ],
        "run_id string, dataset string, models array<string>, smoke_test boolean",
    )
    calls = [(r, s, m) for r in ("full", "smoke", "twice", "other", None) for s in ("a", "b", "z", None) for m in ("m1", "m2", "m3", None)]
    keys = "run_id string, sample_id string, model_name string"
    replies = spark.createDataFrame(
        [(*c, "text", None) for c in calls if c[1] != "b"]
        + [("full", "a", "m1", "again", None), ("full", "b", "m1", None, "timeout"), ("full", "b", "m2", None, None), ("full", "b", "m2", "ok", None)],
        keys + ", response_text string, error string",
    )
    scores = spark.createDataFrame([c for c in calls + calls if c[0] != "other"], keys)
    for some in (runs, runs.drop("smoke_test")):
        plan = planning.eval_plan(samples, some)
        assert counted(planning.planned_counts(samples, some), "planned") == counted(plan.groupBy("run_id").count(), "count")
        for given in (scores, None):
            got = scoring.call_totals(samples, some, replies, given)
            assert counted(got, "planned") == counted(plan.groupBy("run_id").count(), "count")
            failed = {run: n for run, n in counted(got, "failed").items() if n}
            assert failed == counted(scoring.failures(plan, replies, given).groupBy("run_id").count(), "count")


def test_call_totals_do_not_form_the_plan(spark):
    from verdictlake.operators import scoring

    n = 1_000_000
    samples = spark.range(n).selectExpr("'d' AS dataset", "'f' AS file", "id AS pos", "CAST(id AS STRING) AS sample_id")
    runs = spark.range(n).selectExpr("CAST(id AS STRING) AS run_id", "'d' AS dataset", "array('m1', 'm2') AS models", "false AS smoke_test")
    replies = spark.range(5).selectExpr("'7' AS run_id", "CAST(id AS STRING) AS sample_id", "'m1' AS model_name", "'t' AS response_text")
    got = scoring.call_totals(samples, runs, replies).selectExpr("count(*)", "sum(planned)", "sum(failed)").first()
    assert tuple(got) == (n, 2 * n * n, 2 * n * n - 5)


def test_attach_fail_and_coverage(spark, small_plan):
    replies = spark.createDataFrame(
        [("r", "a", "m1", "yes", 1.5, None, 3)],
        "run_id string, sample_id string, model_name string, response_text string, latency_ms double, "
        "input_tokens int, output_tokens int",
    )
    row = planning.attach_responses(small_plan, replies).first()
    assert (row.input_tokens, row.output_tokens, row.estimated_cost_usd) == (0, 3, 0.0)
    assert planning.failed_calls(small_plan, replies).count() == 3
    covered = {r.model_name: (r.planned, r.answered) for r in planning.call_coverage(small_plan, replies).collect()}
    assert covered == {"m1": (2, 1), "m2": (2, 0)}
    none = planning.call_coverage(small_plan, replies.limit(0))
    assert {r.answered for r in none.collect()} == {0}


def test_answers_equal_the_plan_joined_to_replies(spark):
    samples = spark.createDataFrame(
        [("d", "f", i, s, "p" + s) for i, s in enumerate("abc")],
        "dataset string, file string, pos bigint, sample_id string, prompt string",
    )
    runs = spark.createDataFrame(
        [("full", "d", ["m1", "m2"], False), ("smoke", "d", ["m1"], True)],
        "run_id string, dataset string, models array<string>, smoke_test boolean",
    )
    replies = spark.createDataFrame(
        [(r, s, m, r + s + m, 1.0, None, 2) for r in ("full", "smoke", "gone") for s in "abz" + "c" for m in ("m1", "m2", "m3")],
        "run_id string, sample_id string, model_name string, response_text string, latency_ms double, "
        "input_tokens int, output_tokens int",
    )
    for some in (runs, runs.drop("smoke_test")):
        by_plan = planning.attach_responses(planning.eval_plan(samples, some), replies)
        direct = planning.answers(samples, some, replies).select(by_plan.columns)
        assert sorted(map(tuple, direct.collect())) == sorted(map(tuple, by_plan.collect()))


def test_calls_with_equal_ids_take_one_reply_each(spark, small_plan):
    replies = spark.createDataFrame(
        [("r", "a", "m1", t, 1.0, None, 2) for t in ("x", "y")] + [("r", "b", "m1", "z", 1.0, 1, 2)],
        "run_id string, sample_id string, model_name string, response_text string, latency_ms double, input_tokens int, output_tokens int",
    )
    thrice = small_plan.unionByName(small_plan).unionByName(small_plan)
    got = planning.attach_responses(thrice, replies).collect()
    assert sorted((r.sample_id, r.response_text) for r in got) == [("a", "x"), ("a", "y"), ("b", "z")]
    left = planning.failed_calls(thrice, replies).groupBy("sample_id", "model_name").count().collect()
    assert {(r.sample_id, r.model_name): r["count"] for r in left} == {("a", "m1"): 1, ("b", "m1"): 2, ("a", "m2"): 3, ("b", "m2"): 3}
    told = {r.model_name: (r.planned, r.answered) for r in planning.call_coverage(thrice, replies).collect()}
    assert told == {"m1": (6, 3), "m2": (6, 0)}


def test_batch_generate_keeps_failed_calls(spark, small_plan):
    def make():
        def ask(model, prompt, system):
            if model == "m2" and prompt == "ask b":
                raise TimeoutError()
            return {
                "response_text": "This is a stubbed response for testing.",
                "latency_ms": 1.0,
                "input_tokens": 10,
                "output_tokens": 5,
            }

        return ask

    out = {(r.sample_id, r.model_name): r for r in planning.batch_generate(small_plan, make).collect()}
    assert len(out) == 4
    assert out["a", "m1"].response_text == "This is a stubbed response for testing."
    assert (out["a", "m1"].latency_ms, out["a", "m1"].input_tokens, out["a", "m1"].error) == (1.0, 10, None)
    assert (out["b", "m2"].response_text, out["b", "m2"].error) == (None, "TimeoutError")


def test_batch_generate_measures_latency_and_passes_system_prompts(spark, small_plan):
    def make():
        return lambda model, prompt, system: {"response_text": system + "|" + prompt}

    plan = small_plan.withColumn("system_prompt", F.when(F.col("sample_id") == "a", "be brief"))
    out = planning.batch_generate(plan, make, system_prompt="system_prompt").collect()
    assert {r.response_text for r in out} == {"be brief|ask a", "|ask b"}
    assert all(r.latency_ms >= 0 and r.input_tokens is None for r in out)


def test_chat_messages(spark):
    df = spark.createDataFrame([("q", "s"), ("q", ""), ("q", None)], "p string, s string")
    got = [[tuple(m) for m in r[0]] for r in df.select(planning.chat_messages(F.col("p"), F.col("s"))).collect()]
    assert got == [[("system", "s"), ("user", "q")], [("user", "q")], [("user", "q")]]
    assert [tuple(m) for m in df.select(planning.chat_messages(F.col("p"))).first()[0]] == [("user", "q")]


def test_parse_replies(spark):
    raw = [
        '{"message": {"content": "hi"}, "prompt_eval_count": 3, "eval_count": 2}',
        '{"message": {"content": ""}}',
        '{"message": {}}',
        "not json",
    ]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, raw string")
    got = [
        (r.response_text, r.input_tokens, r.output_tokens, r.error is None)
        for r in planning.parse_replies(df).orderBy("i").collect()
    ]
    assert got == [("hi", 3, 2, True), ("", None, None, True), (None, None, None, False), (None, None, None, False)]


def test_elapsed_ms_rounds_to_two_places(spark):
    df = spark.sql("SELECT timestamp_micros(0) AS a, timestamp_micros(m) AS b FROM VALUES (1234), (1235), (5) AS t(m)")
    assert [r[0] for r in df.select(planning.elapsed_ms(F.col("a"), F.col("b"))).collect()] == [1.23, 1.24, 0.01]


def test_useless_replies_are_failures_with_a_reason(spark):
    from verdictlake.operators import planning, scoring

    keys = "run_id string, sample_id string, model_name string"
    plan = spark.createDataFrame([("r", f"s{i}", "m", f"text {i}") for i in range(5)], keys + ", expected string")
    replies = spark.createDataFrame(
        [("r", "s0", "m", "ok", None), ("r", "s1", "m", None, "timeout"), ("r", "s2", "m", None, None), ("r", "s3", "m", "ok", None)],
        keys + ", response_text string, error string",
    ).selectExpr("*", "1.0D AS latency_ms", "1 AS input_tokens", "1 AS output_tokens")
    scores = spark.createDataFrame([("r", "s0", "m", 1.0, 0.0, 0.0)], keys + ", contradiction double, entailment double, neutral double")
    reasons = {r.sample_id: r.reason for r in scoring.failures(plan, replies, scores).collect()}
    assert reasons == {"s1": "timeout", "s2": "reply without text", "s3": "no class scores", "s4": "no reply"}
    answers = planning.attach_responses(plan.withColumn("domain", F.lit("d")).withColumn("prompt", F.lit("p")), replies)
    assert {r.sample_id for r in scoring.score_with_logits(answers, scores).collect()} == {"s0"}
    assert {r.sample_id for r in planning.failed_calls(plan, replies).collect()} == {"s1", "s2", "s4"}
    covered = planning.call_coverage(plan, replies).first()
    assert (covered.planned, covered.answered) == (5, 2)


def test_only_the_question_goes_to_python(spark, plan_of):
    from verdictlake.operators import planning

    plan = spark.range(3).selectExpr("'r' run_id", "'s' sample_id", "'m' model_name", "'p' prompt", "concat('e', id) expected")
    text = plan_of(planning.batch_generate(plan, lambda: lambda m, p, s: {"response_text": p}))
    assert "ArrowEvalPython" in text and "MapInPandas" not in text


def test_suites_fail_on_bad_items_unless_asked_otherwise(spark, suite_dir):
    with pytest.raises(Exception, match="missing prompt|unreadable|not a list"):
        suites.load_suite(spark, str(suite_dir)).collect()
    assert suites.load_suite(spark, str(suite_dir), strict=False).count() > 0


def test_written_suites_are_read_as_they_were(spark, tmp_path):
    rows = [
        ("a", "x\n\"y\" é 😀\t# : - {", "  lead ", "legal", ["t", "u"], "easy", "one"),
        ("b", "\\n back \\u0041", "", "g", [], "medium", "one"),
        ("c", "yes", "null", "1", None, "hard", "two words"),
        ("d", "del\x7f next\x85 line\u2028 \ufeff \uffff\x01 z", "1e3", "0x10", ["~", "on"], "2024-01-01", "two words"),
    ]
    names = "sample_id string, prompt string, expected string, domain string, tags array<string>, difficulty string"
    table = spark.createDataFrame(rows, names + ", name string")
    path = str(tmp_path / "suites")
    suites.write_suites(table, path, "name", ["sample_id"])
    suites.write_suites(table.limit(1).withColumn("sample_id", F.lit("e")), path, "name", mode="append")
    read = suites.load_suites(spark, path).filter(~F.col("dataset").endswith(".yaml"))
    got = {r.sample_id: (r.prompt, r.expected, r.domain, r.tags, r.difficulty, r.dataset) for r in read.collect()}
    want = {r[0]: (*r[1:6], f"datasets/suite={r[6]}") for r in [*rows, ("e", *rows[0][1:])]}
    assert got == want and read.count() == 5
    suites.write_suites(table.limit(0), str(tmp_path / "none"), "name")
