"""Comparison SQL, written for DuckDB and apart from the Spark expressions."""

from __future__ import annotations

# ---------------------------------------------------------------- derived tables

SAMPLES = """
samples AS (
  SELECT 'cv_' || u.conv_id || '_' || u.turn AS sample_id, u.text AS prompt, a.text AS expected,
    CASE u.conv_id % 3 WHEN 0 THEN 'legal' WHEN 1 THEN 'code_gen' ELSE 'summarization' END AS domain,
    CASE u.turn % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END AS difficulty,
    'datasets/' || CASE (u.conv_id // 12) % 3 WHEN 0 THEN 'legal_qa' WHEN 1 THEN 'code_gen'
      ELSE 'summarization' END AS dataset,
    dataset || '/suite_' || (u.conv_id % 4) || '.yaml' AS file,
    u.conv_id * 1000 + u.turn AS pos,
    'run_' || lpad(CAST(u.conv_id // 12 AS VARCHAR), 4, '0') AS run_id,
    u.conv_id // 12 AS r, u.conv_id AS c, u.turn AS t
  FROM conversations u JOIN conversations a
    ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  WHERE u.role = 'user')"""

RUNS = """
run_numbers AS (SELECT DISTINCT conv_id // 12 AS r FROM conversations),
runs AS (
  SELECT 'run_' || lpad(CAST(r AS VARCHAR), 4, '0') AS run_id,
    'datasets/' || ['legal_qa', 'code_gen', 'summarization'][r % 3 + 1] AS dataset,
    CASE WHEN r % 5 = 0 THEN ['gamma'] ELSE ['alpha:8b', 'beta/base:3b', 'gamma', 'delta:70b'] END AS models,
    CASE WHEN r % 12 = 11 THEN 'pending' WHEN r % 6 = 5 THEN 'running'
      WHEN r % 6 = 4 THEN 'failed' ELSE 'completed' END AS status,
    TIMESTAMP '2024-01-01' + to_days(CAST(r // 2 AS INTEGER)) AS created_at,
    CASE WHEN status <> 'pending' THEN created_at + INTERVAL 1 MINUTE END AS started_at,
    CASE WHEN status IN ('completed', 'failed') THEN created_at + INTERVAL 1 HOUR END AS completed_at,
    CASE WHEN status = 'failed' THEN 'model server unreachable' END AS error, r
  FROM run_numbers)"""

PLANNED = SAMPLES + """,
models AS (SELECT * FROM (VALUES (0, 'alpha:8b'), (1, 'beta/base:3b'), (2, 'gamma'), (3, 'delta:70b')) v(m, model_name)),
planned AS (
  SELECT samples.*, m, model_name FROM samples, models
  WHERE r % 6 <> 4 AND r % 12 <> 11 AND (r % 5 <> 0 OR m = 2))"""

RESPONSES = PLANNED + """,
responses AS (
  SELECT planned.*,
    CASE WHEN m = 3 AND c % 5 = 0 THEN prompt ELSE array_to_string(
      list_filter(string_split(expected, ' '), lambda w, i: (i - 1 + m) % (m + 2) <> 0), ' ') END AS response_text,
    (c * 7919 + t * 104729 + m * 1299709) % 500000 AS latency_u,
    latency_u / 100.0 AS latency_ms,
    CASE WHEN (c + m) % 7 <> 0 THEN CAST(len(string_split(prompt, ' ')) AS INTEGER) END AS input_tokens,
    CAST(len(string_split(response_text, ' ')) AS INTEGER) AS output_tokens
  FROM planned WHERE (c * 7 + t * 3 + m * 5) % 23 <> 0)"""

RESULTS = RESPONSES + """,
results AS (
  SELECT run_id, sample_id, domain, prompt, expected, model_name, response_text, latency_ms, latency_u,
    coalesce(input_tokens, 0) AS input_tokens, output_tokens, 0.0::DOUBLE AS estimated_cost_usd,
    (c * 31 + t * 7 + m * 11) % 10001 AS rouge1_u, rouge1_u / 10000.0::DOUBLE AS rouge1,
    (c * 37 + t * 13 + m * 17) % 10001 / 10000.0::DOUBLE AS rouge2,
    (c * 41 + t * 19 + m * 23) % 10001 AS rougel_u, rougel_u / 10000.0::DOUBLE AS rougeL,
    ['contradiction', 'entailment', 'neutral'][(c + t * 2 + m) % 3 + 1] AS nli_label,
    (c * 43 + t * 29 + m * 31) % 10001 / 10000.0::DOUBLE AS nli_confidence,
    (c + t * 2 + m) % 3 = 0 AS hallucination_flag
  FROM responses)"""

EVENT_RESULTS = """
results AS (
  SELECT strftime(ts, '%Y-%m-%d') AS run_id, event_type AS model_name, 'ev_' || event_id AS sample_id,
    CAST(round(value * 100) AS BIGINT) AS latency_u,
    (CAST(json_extract(props, '$.k') AS BIGINT) * 89 + event_id * 7) % 10001 AS rouge1_u,
    (CAST(json_extract(props, '$.k') AS BIGINT) * 97 + event_id * 13) % 10001 AS rougel_u,
    CAST(json_extract(props, '$.k') AS BIGINT) % 10 = 0 AS hallucination_flag, ts
  FROM events),
runs AS (
  SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS run_id, 'daily' AS dataset,
    date_trunc('day', ts) + INTERVAL 1 DAY AS completed_at FROM events)"""

LINEITEM_RESULTS = """
results AS (
  SELECT 'run_' || lpad(CAST(l_orderkey % 365 AS VARCHAR), 3, '0') AS run_id,
    l_returnflag || l_linestatus AS model_name, CAST(round(l_extendedprice * 100) AS BIGINT) AS latency_u,
    (l_partkey * 89 + l_suppkey * 7) % 10001 AS rouge1_u,
    10 * CAST(round(l_discount * 10000) AS BIGINT) AS rougel_u, l_tax >= 0.07 AS hallucination_flag
  FROM lineitem),
runs AS (
  SELECT DISTINCT 'run_' || lpad(CAST(l_orderkey % 365 AS VARCHAR), 3, '0') AS run_id,
    'ds_' || (l_orderkey % 365 % 3) AS dataset,
    TIMESTAMP '2024-01-01' + to_days(CAST(l_orderkey % 365 AS INTEGER)) AS completed_at FROM lineitem)"""


# ---------------------------------------------------------------- shared fragments


def _mean(units: str, scale: int = 10000) -> str:
    """Half-up mean of whole numbers, then scaled down."""
    return f"((2 * sum({units}) + count(*)) // (2 * count(*))) / {scale}.0::DOUBLE"


RATE = (
    "((2 * sum(CAST(hallucination_flag AS BIGINT)) * 10000 + count(*)) // (2 * count(*))) / 10000.0::DOUBLE"
)


def _percentile(pct: int, scale_to: int) -> str:
    """Interpolated percentile from the sorted list ``v`` of a group with ``n`` values."""
    low = f"v[((n - 1) * {pct}) // 100 + 1]"
    high = f"v[least(((n - 1) * {pct}) // 100 + 2, n)]"
    units = f"({low} * 100 + ({high} - {low}) * (((n - 1) * {pct}) % 100))"
    if scale_to == 4:
        return f"{units} / 10000.0::DOUBLE"
    return f"((2 * {units} + 100) // 200) / 100.0::DOUBLE"


def _points(results: str, where: str = "") -> str:
    """WITH clause ending in ``points``."""
    return f"""WITH {results},
grouped AS (
  SELECT results.run_id, dataset, model_name, completed_at AS start_time,
    {_mean('rouge1_u')} AS rouge1_mean, {_mean('rougel_u')} AS rougeL_mean, {RATE} AS halluc_rate,
    list_sort(list(latency_u)) AS v, count(*) AS n
  FROM results JOIN runs ON runs.run_id = results.run_id {where}
  GROUP BY results.run_id, dataset, model_name, completed_at),
points AS (
  SELECT run_id, CAST(NULL AS VARCHAR) AS run_name, dataset, model_name, start_time, rouge1_mean, rougeL_mean,
    halluc_rate, {_percentile(50, 2)} AS latency_p50, {_percentile(95, 2)} AS latency_p95
  FROM grouped)"""


def _per_model(places: int) -> str:
    return f"""SELECT model_name, rouge1_mean, rougeL_mean, halluc_rate,
  {_percentile(50, places)} AS latency_p50, {_percentile(95, places)} AS latency_p95
FROM (SELECT model_name, {_mean('rouge1_u')} AS rouge1_mean, {_mean('rougel_u')} AS rougeL_mean,
  {RATE} AS halluc_rate, list_sort(list(latency_u)) AS v, count(*) AS n FROM results GROUP BY model_name)"""


# ---------------------------------------------------------------- aggregates

ORACLES: dict[str, str] = {}

ORACLES["d1_metrics_timeseries"] = _points(EVENT_RESULTS) + " SELECT * FROM points"
ORACLES["d1_metrics_timeseries_lineitem"] = _points(LINEITEM_RESULTS) + " SELECT * FROM points"
ORACLES["d1_metrics_timeseries_runs"] = _points(f"{RESULTS},{RUNS}") + " SELECT * FROM points"
ORACLES["d2_timeseries_filtered"] = (
    _points(f"{RESULTS},{RUNS}", "WHERE model_name = 'gamma' AND dataset = 'datasets/legal_qa'")
    + " SELECT * FROM points"
)
ORACLES["d3_timeseries_last_n"] = (
    _points(f"{RESULTS},{RUNS}")
    + " SELECT * FROM points ORDER BY start_time DESC NULLS LAST, run_id DESC, model_name DESC LIMIT 10"
)
ORACLES["d4_latency_percentile"] = f"""WITH {EVENT_RESULTS}
SELECT model_name, n, {_percentile(50, 4)} AS latency_p50, {_percentile(95, 4)} AS latency_p95
FROM (SELECT model_name, list_sort(list(latency_u)) AS v, count(*) AS n FROM results GROUP BY model_name)"""
ORACLES["d4_latency_percentile_lineitem"] = ORACLES["d4_latency_percentile"].replace(
    EVENT_RESULTS, LINEITEM_RESULTS
)
ORACLES["d4_latency_sketches"] = """SELECT l_returnflag || l_linestatus AS model_name, count(*) AS n,
  true AS p50_close, true AS p95_close FROM lineitem GROUP BY ALL"""
ORACLES["d5_model_aggregate"] = f"WITH {EVENT_RESULTS} {_per_model(4)}"
ORACLES["d6_cli_summary"] = f"""WITH {EVENT_RESULTS}
SELECT model_name, {_mean('rouge1_u')} AS rouge1, {_mean('rougel_u')} AS rougeL, {RATE} AS hallucination_flag,
  {_mean('latency_u * 100')} AS latency_ms
FROM results GROUP BY model_name"""

_COMPARED = """SELECT {keys}, sum(rouge1_u) / count(*) / 10000.0::DOUBLE AS rouge1,
  sum(rougel_u) / count(*) / 10000.0::DOUBLE AS rougeL,
  sum(CAST(hallucination_flag AS BIGINT)) / count(*) AS halluc_rate,
  list_sort(list(latency_u))[count(*) // 2 + 1] / 100.0::DOUBLE AS latency_p50, count(*) AS answers
FROM results GROUP BY {keys}"""

ORACLES["d7_model_comparison"] = f"WITH {EVENT_RESULTS} {_COMPARED.format(keys='model_name')}"
ORACLES["d8_experiment_metrics"] = (
    _points(f"{RESULTS},{RUNS}")
    + """ SELECT run_id, replace(replace(model_name, ':', '_'), '/', '_') || '_' || metric AS metric, value
FROM (UNPIVOT (SELECT run_id, model_name, rouge1_mean, rougeL_mean, halluc_rate, latency_p50, latency_p95 FROM points)
  ON rouge1_mean, rougeL_mean, halluc_rate, latency_p50, latency_p95 INTO NAME metric VALUE value)"""
)
ORACLES["d9_experiment_params"] = f"""WITH {PLANNED}
SELECT run_id, count(DISTINCT sample_id) AS num_samples,
  array_to_string(list_sort(list(DISTINCT model_name)), '+') AS models FROM planned GROUP BY run_id"""
ORACLES["d10_run_summary"] = f"""WITH {RESULTS},{RUNS}
SELECT run_id, dataset, array_to_string(models, '+') AS models, status, created_at, started_at, completed_at, error,
  (SELECT count(*) FROM results WHERE results.run_id = runs.run_id) AS sample_count FROM runs"""
ORACLES["d11_relative_score"] = f"""WITH {RESULTS},
compared AS ({_COMPARED.format(keys='run_id, model_name')}),
best AS (SELECT run_id, greatest(0.0001::DOUBLE, max(rougeL)) AS top FROM compared GROUP BY run_id)
SELECT compared.*, rougeL / top * 100.0::DOUBLE AS relative_score FROM compared JOIN best USING (run_id)"""

# ---------------------------------------------------------------- sources, sinks, ingest

_TAGS = "domain || '+turn_' || t"

ORACLES["a1_suite_ingest"] = f"""WITH {SAMPLES}
SELECT sample_id || '.yaml' AS file, 0::BIGINT AS pos, sample_id, prompt, expected, domain, {_TAGS} AS tags, difficulty,
  NULL AS reject_reason FROM samples
UNION ALL SELECT sample_id || '.yaml', 1, sample_id || '_r', expected, prompt, 'general', '', 'medium', NULL FROM samples
UNION ALL SELECT sample_id || '.yaml', 2, sample_id || '_b', NULL, expected, 'general', '', 'medium', 'missing prompt'
  FROM samples"""
ORACLES["a1_suite_files"] = f"""WITH {SAMPLES}
SELECT replace(dataset, 'datasets/', 'datasets/suite=') AS dataset, sample_id, prompt, expected, domain, {_TAGS} AS tags, difficulty
FROM samples"""
ORACLES["a2_suite_defaults"] = f"""WITH {SAMPLES}
SELECT sample_id, prompt, expected, CASE WHEN c % 2 = 0 THEN domain ELSE 'general' END AS domain,
  CASE WHEN c % 3 = 0 THEN '' ELSE {_TAGS} END AS tags,
  CASE WHEN c % 5 = 0 THEN 'medium' ELSE difficulty END AS difficulty FROM samples"""

_REQUESTS = (
    SAMPLES
    + r""",
spelled AS (SELECT * FROM (VALUES
  (0, 'legal_qa', 'datasets/legal_qa'), (1, 'datasets/code_gen', 'datasets/code_gen'),
  (2, 'datasets\summarization', 'datasets/summarization'), (3, 'nowhere', NULL),
  (4, './legal_qa/', 'datasets/legal_qa'), (5, 'datasets//code_gen', 'datasets/code_gen'), (6, '', NULL)) v(k, dataset, meant)),
requests AS (
  SELECT 'rq_' || conv_id || '_' || turn AS request_id, spelled.dataset,
    (SELECT min(s.dataset) FROM samples s WHERE s.dataset = meant) AS dataset_path, conv_id AS c
  FROM conversations JOIN spelled ON conv_id % 7 = k WHERE role = 'user')"""
)
ORACLES["a3_dataset_resolve"] = f"WITH {_REQUESTS} SELECT request_id, dataset, dataset_path FROM requests"
ORACLES["a4_run_request_validation"] = f"""WITH {_REQUESTS}
SELECT request_id, dataset, dataset_path,
  ['', 'alpha:8b', 'alpha:8b+beta/base:3b', 'alpha:8b+beta/base:3b+gamma'][c % 4 + 1] AS models,
  c % 3 = 1 AS smoke_test, c % 5 IN (0, 1) AS use_mlflow,
  CASE WHEN c % 4 = 0 THEN 'no models given' WHEN dataset_path IS NULL THEN 'dataset not found' END AS reject_reason
FROM requests"""
ORACLES["a5_smoke_limit"] = f"""WITH {SAMPLES}
SELECT dataset, file, pos, sample_id FROM samples s
WHERE (SELECT count(*) FROM samples o WHERE o.dataset = s.dataset AND (o.file, o.pos) < (s.file, s.pos)) < 2"""
_CATALOG = f"""{RESPONSES},
live AS (SELECT DISTINCT model_name FROM responses),
named AS (SELECT model_name AS name FROM live UNION SELECT unnest(['alpha:8b', 'beta/base:3b', 'omega:1b'])),
catalog AS (SELECT name, name IN (SELECT model_name FROM live) AS available FROM named)"""
ORACLES["a6_model_catalog"] = f"WITH {_CATALOG} SELECT name, available FROM catalog"
ORACLES["a6_default_model"] = (
    f"WITH {_CATALOG} SELECT name FROM catalog WHERE available ORDER BY name LIMIT 1"
)
ORACLES["a7_suite_append"] = f"""WITH {SAMPLES},
counted AS (SELECT *, count(*) OVER (PARTITION BY domain) AS existing FROM samples)
SELECT sample_id, prompt, expected, domain, {_TAGS} AS tags, difficulty FROM samples
UNION ALL
SELECT domain || '_auto_' || printf('%03d', existing + row_number() OVER (PARTITION BY domain ORDER BY c, t)),
  'Again: ' || prompt, expected, domain, {_TAGS}, difficulty FROM counted WHERE difficulty = 'hard'"""
ORACLES["a7_generated_suite"] = ORACLES["a7_suite_append"]
ORACLES["a8_fence_strip"] = r"""SELECT doc_id,
  trim(replace(replace(['```yaml', '```', '```json', e' \n```yaml'][doc_id % 4 + 1] || e'\n' || text || e'\n```\t\n',
    '```yaml', ''), '```', ''), e' \t\n\r\f\v') AS text
FROM documents"""

_ALL_COLUMNS = """sample_id, domain, prompt, expected, model_name, response_text, latency_ms, input_tokens,
  output_tokens, {cost}rouge1, rouge2, rougeL, nli_label, nli_confidence, hallucination_flag"""
_CSV_COLUMNS = _ALL_COLUMNS.format(cost="estimated_cost_usd, ")
_STORED_COLUMNS = _ALL_COLUMNS.format(cost="")

ORACLES["a9_results_csv_sink"] = f"WITH {RESULTS} SELECT {_CSV_COLUMNS} FROM results"
ORACLES["a10_run_upsert"] = f"""WITH {RUNS}
SELECT run_id, dataset, array_to_string(models, '+') AS models, status, created_at, started_at, completed_at, error
FROM runs"""
ORACLES["a11_results_replace"] = f"""WITH {RESULTS},
numbered AS (SELECT *, CAST(substr(run_id, 5) AS INTEGER) AS k FROM results)
SELECT run_id, {_STORED_COLUMNS} FROM numbered
WHERE (k % 3 <> 0 AND k % 7 <> 0) OR (k % 3 = 0 AND k % 7 <> 0 AND model_name <> 'alpha:8b')"""
ORACLES["a12_adhoc_samples"] = f"""WITH {SAMPLES}
SELECT 'custom_' || printf('%03d', row_number() OVER (ORDER BY c, t)) AS sample_id, prompt, expected,
  'custom' AS domain, 'custom' AS tags, 'medium' AS difficulty FROM samples WHERE c % 7 <> 0 AND t <> 4"""

# ---------------------------------------------------------------- plan and joins

ORACLES["b1_eval_plan"] = f"""WITH {PLANNED},
placed AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY file, pos) AS place FROM samples)
SELECT p.dataset, file, pos, sample_id, p.dataset || '#' || kind AS run_id, models.model_name
FROM placed p, models, (VALUES ('false'), ('true')) k(kind) WHERE kind = 'false' OR place <= 2"""
ORACLES["b2_response_attach"] = f"""WITH {RESPONSES}
SELECT run_id, sample_id, prompt, expected, domain, model_name, response_text, latency_ms,
  coalesce(input_tokens, 0) AS input_tokens, output_tokens, 0.0::DOUBLE AS estimated_cost_usd FROM responses"""
ORACLES["b2_duplicate_ids"] = f"""{ORACLES["b2_response_attach"]}
UNION ALL SELECT run_id, sample_id, prompt, expected, domain, model_name, response_text || ' again', latency_ms,
  coalesce(input_tokens, 0), output_tokens, 0.0::DOUBLE FROM responses"""
ORACLES["b3_duplicate_ids"] = f"""WITH {PLANNED}
SELECT run_id, sample_id, model_name FROM planned
UNION ALL SELECT run_id, sample_id, model_name FROM planned WHERE (c * 7 + t * 3 + m * 5) % 23 = 0"""
ORACLES["b2_answers"] = ORACLES["b2_response_attach"]
ORACLES["b3_failed_calls"] = f"""WITH {PLANNED}
SELECT run_id, sample_id, model_name FROM planned WHERE (c * 7 + t * 3 + m * 5) % 23 = 0"""
ORACLES["b3_failure_reasons"] = f"""WITH {PLANNED},
reasons AS (
  SELECT run_id, sample_id, model_name, CASE WHEN (c * 7 + t * 3 + m * 5) % 23 = 0 THEN 'no reply'
    WHEN (c + m) % 19 = 0 THEN 'reply has no message content' WHEN c % 29 = 0 THEN 'no class scores' END AS reason
  FROM planned)
SELECT * FROM reasons WHERE reason IS NOT NULL"""
ORACLES["b3_call_coverage"] = f"""WITH {PLANNED}
SELECT run_id, model_name, count(*) AS planned, count(*) FILTER ((c * 7 + t * 3 + m * 5) % 23 <> 0) AS answered
FROM planned GROUP BY run_id, model_name"""
ORACLES["b4_batch_generate"] = f"""WITH {PLANNED},
called AS (SELECT *, length(prompt) <= 200 AS ok FROM planned)
SELECT run_id, sample_id, model_name, CASE WHEN ok THEN model_name || ': ' || prompt END AS response_text,
  CASE WHEN ok THEN 1.0::DOUBLE END AS latency_ms, CASE WHEN ok THEN 10 END AS input_tokens,
  CASE WHEN ok THEN 5 END AS output_tokens, CASE WHEN NOT ok THEN 'prompt too long' END AS error FROM called"""
ORACLES["b5_chat_messages"] = f"""WITH {SAMPLES},
systems AS (SELECT conv_id, text FROM conversations WHERE role = 'system')
SELECT sample_id, 0 AS place, 'system' AS role, text AS content FROM samples JOIN systems ON conv_id = c
UNION ALL
SELECT sample_id, CASE WHEN c IN (SELECT conv_id FROM systems) THEN 1 ELSE 0 END, 'user', prompt FROM samples"""
ORACLES["b6_reply_parse"] = f"""WITH {RESPONSES}
SELECT run_id, sample_id, model_name, CASE WHEN (c + m) % 19 <> 0 THEN response_text END AS response_text,
  input_tokens, output_tokens,
  CASE WHEN (c + m) % 19 = 0 THEN 'reply has no message content' END AS error FROM responses"""
ORACLES["b7_latency_ms"] = f"""WITH {RESPONSES}
SELECT run_id, sample_id, model_name, (latency_u + CASE WHEN c % 10 >= 5 THEN 1 ELSE 0 END) / 100.0::DOUBLE AS latency_ms
FROM responses"""

# ---------------------------------------------------------------- scoring

_TOKENS = "list_filter(string_split_regex(lower({text}), '[^a-z0-9]+'), lambda x: x <> '')"


def _ngrams(column: str, n: int) -> str:
    if n == 1:
        return column
    return f"list_transform(range(1, len({column})), lambda i: {column}[i] || ' ' || {column}[i + 1])"


def _rouge_n(pairs: str, keys: str, n: int) -> str:
    """CTEs ending in ``rouge{n}`` with the keys and the score; ``pairs`` has expected and response_text."""
    return f"""
grams{n} AS (
  SELECT {keys}, {_ngrams('a', n)} AS a, {_ngrams('b', n)} AS b FROM (
    SELECT {keys}, {_TOKENS.format(text='expected')} AS a, {_TOKENS.format(text='response_text')} AS b FROM {pairs})),
left{n} AS (SELECT {keys}, g, count(*) AS k FROM (SELECT {keys}, unnest(a) AS g FROM grams{n}) GROUP BY {keys}, g),
right{n} AS (SELECT {keys}, g, count(*) AS k FROM (SELECT {keys}, unnest(b) AS g FROM grams{n}) GROUP BY {keys}, g),
shared{n} AS (SELECT {keys}, CAST(sum(least(l.k, r.k)) AS BIGINT) AS o FROM left{n} l JOIN right{n} r USING ({keys}, g)
  GROUP BY {keys}),
rouge{n} AS (
  SELECT {keys}, CASE WHEN o IS NULL THEN 0.0::DOUBLE ELSE
    ((4 * o * 10000 + len(a) + len(b)) // (2 * (len(a) + len(b)))) / 10000.0::DOUBLE END AS rouge{n}
  FROM grams{n} LEFT JOIN shared{n} USING ({keys}))"""


def _rouge_l(pairs: str, keys: str) -> str:
    """CTEs ending in ``rougel``: one table row of the subsequence lengths per answer token."""
    return f"""
words AS (
  SELECT {keys}, {_TOKENS.format(text='expected')} AS a, {_TOKENS.format(text='response_text')} AS b FROM {pairs}),
steps AS (
  SELECT {keys}, a, b, 0 AS done, list_transform(range(0, len(a) + 1), lambda x: 0) AS line FROM words
  UNION ALL
  SELECT {keys}, a, b, done + 1, list_concat([0], list_transform(range(1, len(a) + 1), lambda j:
    list_max(list_transform(range(1, j + 1), lambda k: CASE WHEN a[k] = b[done + 1] THEN line[k] + 1 ELSE line[k + 1] END))))
  FROM steps WHERE done < len(b)),
rougel AS (
  SELECT {keys}, CASE WHEN line[len(a) + 1] = 0 THEN 0.0::DOUBLE ELSE
    ((4 * line[len(a) + 1] * 10000 + len(a) + len(b)) // (2 * (len(a) + len(b)))) / 10000.0::DOUBLE END AS rougeL
  FROM steps WHERE done = len(b))"""


def _thinned(text: str, m: str) -> str:
    return (
        f"array_to_string(list_filter(string_split({text}, ' '), "
        f"lambda w, p: (p - 1 + {m}) % ({m} + 2) <> 0), ' ')"
    )


BENCHMARK_PAIRS = f"""
pairs AS (
  SELECT item_id AS i, m, text AS expected, {_thinned('text', 'm')} AS response_text
  FROM benchmark, (VALUES (0), (1), (2), (3)) v(m)
  UNION ALL SELECT a.item_id, 4, a.text, b.text FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1
  UNION ALL SELECT item_id, 5 + item_id % 2, text, CASE WHEN item_id % 2 = 0 THEN '' ELSE string_split(text, ' ')[1] END
  FROM benchmark)"""
DOCUMENT_PAIRS = """
pairs AS (SELECT doc_id, text AS expected, array_to_string(list_filter(string_split(text, ' '),
  lambda w, p: (p - 1 + doc_id) % 3 <> 0), ' ') AS response_text FROM documents)"""

_KEYS = "run_id, sample_id, model_name"
ORACLES["c1_rouge_tokens"] = (
    f"SELECT doc_id, array_to_string({_TOKENS.format(text='text')}, ' ') AS tokens FROM documents"
)
ORACLES["c2_rouge1"] = f"WITH {RESPONSES},{_rouge_n('responses', _KEYS, 1)} SELECT * FROM rouge1"
ORACLES["c3_rouge2"] = f"WITH {RESPONSES},{_rouge_n('responses', _KEYS, 2)} SELECT * FROM rouge2"
ORACLES["c2_c3_rouge_documents"] = f"""WITH {DOCUMENT_PAIRS},{_rouge_n('pairs', 'doc_id', 1)},
{_rouge_n('pairs', 'doc_id', 2)} SELECT * FROM rouge1 JOIN rouge2 USING (doc_id)"""
ORACLES["c4_rougel"] = f"WITH RECURSIVE {BENCHMARK_PAIRS},{_rouge_l('pairs', 'i, m')} SELECT * FROM rougel"
# The answers leave words out, so they are subsequences and the overlap is their token count.
ORACLES["c4_rougel_documents"] = f"""WITH {DOCUMENT_PAIRS},
counted AS (
  SELECT doc_id, len(list_filter(regexp_split_to_array(lower(expected), '[^a-z0-9]+'), lambda w: w <> '')) AS n_ref,
    len(list_filter(regexp_split_to_array(lower(response_text), '[^a-z0-9]+'), lambda w: w <> '')) AS n_ans FROM pairs)
SELECT doc_id, CASE WHEN n_ans = 0 THEN 0.0::DOUBLE
  ELSE ((40000 * n_ans + n_ref + n_ans) // (2 * (n_ref + n_ans)))::DOUBLE / 10000.0::DOUBLE END AS rougeL FROM counted"""
ORACLES["c5_nli_pairs"] = f"""WITH {RESPONSES}
SELECT {_KEYS}, left(expected, 500) || ' [SEP] ' || left(response_text, 500) AS pair FROM responses"""


def _verdict(source: str) -> str:
    """Label and confidence from columns con, ent and neu."""
    return f"""SELECT *,
  CASE WHEN con >= ent AND con >= neu THEN 'contradiction' WHEN ent >= neu THEN 'entailment' ELSE 'neutral' END AS nli_label,
  greatest(con, ent, neu) AS top,
  floor(1.0::DOUBLE / (exp(con - top) + exp(ent - top) + exp(neu - top)) * 10000.0::DOUBLE + 0.5::DOUBLE)
    / 10000.0::DOUBLE AS nli_confidence,
  nli_label = 'contradiction' AS hallucination_flag FROM {source}"""


_VERDICTS = f"""WITH {RESPONSES},
scores AS (
  SELECT {_KEYS}, (c * 31 + t * 17 + m * 13) % 97 / 10.0::DOUBLE AS con,
    (c * 17 + t * 29 + m * 7) % 89 / 10.0::DOUBLE AS ent, (c * 13 + t * 11 + m * 19) % 83 / 10.0::DOUBLE AS neu
  FROM responses),
verdicts AS ({_verdict('scores')})"""
ORACLES["c6_nli_decide"] = f"{_VERDICTS} SELECT {_KEYS}, nli_label, nli_confidence FROM verdicts"
ORACLES["c7_hallucination_flag"] = f"{_VERDICTS} SELECT {_KEYS}, hallucination_flag FROM verdicts"
ORACLES["c8_nli_infer"] = f"""WITH {RESPONSES},
pairs AS (SELECT {_KEYS}, length(left(expected, 500)) + 7 + length(left(response_text, 500)) AS n FROM responses)
SELECT {_KEYS}, n % 7 / 2.0::DOUBLE AS contradiction, n % 5 / 2.0::DOUBLE AS entailment, n % 3 / 2.0::DOUBLE AS neutral
FROM pairs"""
ORACLES["c9_score_results"] = f"""WITH RECURSIVE {BENCHMARK_PAIRS},{_rouge_n('pairs', 'i, m', 1)},
{_rouge_n('pairs', 'i, m', 2)},{_rouge_l('pairs', 'i, m')},
scores AS (SELECT *, (i * 31 + m * 13) % 97 / 10.0::DOUBLE AS con, (i * 17 + m * 7) % 89 / 10.0::DOUBLE AS ent,
  (i * 13 + m * 19) % 83 / 10.0::DOUBLE AS neu FROM pairs),
verdicts AS ({_verdict('scores')})
SELECT 'run_' || m AS run_id, 'bm_' || i AS sample_id, 'benchmark' AS domain, 'Repeat.' AS prompt, expected,
  'gamma' AS model_name, response_text, (i * 31 + m) / 100.0::DOUBLE AS latency_ms,
  CAST(CASE WHEN i % 2 = 0 THEN i ELSE 0 END AS INTEGER) AS input_tokens, CAST(m AS INTEGER) AS output_tokens, 0.0::DOUBLE AS estimated_cost_usd,
  rouge1, rouge2, rougeL, nli_label, nli_confidence, hallucination_flag
FROM verdicts JOIN rouge1 USING (i, m) JOIN rouge2 USING (i, m) JOIN rougel USING (i, m)"""

# ---------------------------------------------------------------- retrieval

ORACLES["e1_run_results"] = f"WITH {RESULTS} SELECT {_STORED_COLUMNS} FROM results WHERE run_id = 'run_0001'"
ORACLES["e2_results_filter"] = (
    f"WITH {RESULTS} SELECT run_id, {_CSV_COLUMNS} FROM results WHERE model_name = 'gamma' AND NOT hallucination_flag"
)
ORACLES["e3_distinct_models"] = f"WITH {RESULTS} SELECT model_name FROM results GROUP BY model_name"
ORACLES["e4_failure_cases"] = f"""WITH {RESULTS}
SELECT model_name, sample_id, prompt, expected, response_text FROM results WHERE nli_label = 'contradiction'"""
ORACLES["e4_failure_count"] = (
    f"WITH {RESULTS} SELECT count(*) AS failures FROM results WHERE nli_label = 'contradiction'"
)
ORACLES["e5_multi_model_runs"] = f"""WITH {RUNS}
SELECT run_id, dataset, array_to_string(models, '+') AS models, status, created_at, started_at, completed_at, error
FROM runs WHERE r % 5 <> 0"""
ORACLES["e6_results_ready"] = f"""WITH {RESULTS},{RUNS}
SELECT run_id, sample_id, model_name, rougeL FROM results
WHERE run_id IN (SELECT run_id FROM runs WHERE status IN ('completed', 'failed'))"""
ORACLES["e6_result_availability"] = f"""WITH {RUNS},
asked AS (SELECT conv_id, turn, CASE WHEN conv_id % 9 = 0 THEN conv_id + 100000 ELSE conv_id // 12 END AS r FROM conversations)
SELECT conv_id, turn, 'run_' || lpad(CAST(asked.r AS VARCHAR), 4, '0') AS run_id,
  CASE WHEN status IS NULL THEN 'unknown' WHEN status IN ('completed', 'failed') THEN 'ready' ELSE 'not_ready' END AS outcome
FROM asked LEFT JOIN runs ON runs.r = asked.r"""
ORACLES["e7_recent_runs"] = f"""WITH {RUNS}
SELECT run_id, dataset || CASE WHEN completed_at IS NULL THEN '' ELSE '/seen' END AS dataset,
  array_to_string(models, '+') AS models, created_at, coalesce(completed_at, created_at) AS seen_at
FROM runs ORDER BY seen_at DESC, run_id DESC LIMIT 20"""
ORACLES["e8_score_projection"] = f"""WITH {RESULTS}
SELECT model_name AS "Model", rouge1 AS "ROUGE-1", rouge2 AS "ROUGE-2", rougeL AS "ROUGE-L",
  hallucination_flag AS "Hallucination", nli_confidence AS "NLI confidence", latency_ms AS "Latency (ms)" FROM results"""
ORACLES["e8_results_table"] = f"""WITH {RESULTS}
SELECT sample_id AS "Sample", model_name AS "Model", ((2 * rougel_u + 10) // 20) / 1000.0::DOUBLE AS "ROUGE-L",
  CASE WHEN hallucination_flag THEN 'flagged' ELSE 'clean' END AS "Hallucination",
  (2 * latency_u + 100) // 200 AS "Latency (ms)", response_text AS "Response" FROM results"""

# ---------------------------------------------------------------- trends


def _drift(results: str, where: str = "") -> str:
    return f"""{_points(results, where)},
timed AS (SELECT *, CAST(round(rougeL_mean * 10000) AS BIGINT) AS u FROM points),
looked AS (
  SELECT *, sum(u) OVER prior AS before, count(*) OVER prior AS seen FROM timed
  WINDOW prior AS (PARTITION BY model_name, dataset ORDER BY start_time, run_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
drift AS (
  SELECT run_id, model_name, dataset, start_time, rougeL_mean, seen AS runs_before,
    CASE WHEN seen = 5 THEN (before * 85)::DOUBLE / 5000000.0::DOUBLE END AS threshold,
    coalesce(seen = 5 AND u * 500 < before * 85, false) AS drift FROM looked)"""


ORACLES["f1_accuracy_drift"] = f"{_drift(EVENT_RESULTS)} SELECT * FROM drift"
ORACLES["f1_accuracy_drift_lineitem"] = f"{_drift(LINEITEM_RESULTS)} SELECT * FROM drift"
ORACLES["f1_latest_drift"] = f"""{_drift(EVENT_RESULTS)}
SELECT * FROM drift QUALIFY row_number() OVER (PARTITION BY model_name, dataset ORDER BY start_time DESC, run_id DESC) = 1"""

_LATENCY = f"""{_points(EVENT_RESULTS)},
trend AS (
  SELECT run_id, model_name, dataset, start_time AS x, 'latency_p50' AS series, latency_p50 AS y FROM points
  UNION ALL SELECT run_id, model_name, dataset, start_time, 'latency_p95', latency_p95 FROM points)"""
ORACLES["f2_latency_trend"] = f"{_LATENCY} SELECT * FROM trend"
ORACLES["f3_halluc_trend"] = f"""{_points(EVENT_RESULTS)}
SELECT run_id, model_name, dataset, start_time AS x, halluc_rate AS y FROM points"""
ORACLES["f4_latest_point"] = f"""{_LATENCY}
SELECT model_name, series, x, run_id, y FROM trend t
WHERE x = (SELECT max(x) FROM trend o WHERE o.model_name = t.model_name AND o.series = t.series)"""


def _extent(ranges: str, keys: str) -> str:
    return f"""SELECT {keys} epoch_ms(x0)::DOUBLE AS x_min, epoch_ms(x1)::DOUBLE AS x_max,
  greatest(0.0::DOUBLE, lo - pad) AS y_min, CASE WHEN hi + pad = 0 THEN 1.0::DOUBLE ELSE hi + pad END AS y_max
FROM (SELECT *, CASE WHEN (hi - lo) * 0.15::DOUBLE <> 0 THEN (hi - lo) * 0.15::DOUBLE
  ELSE abs(CASE WHEN hi = 0 THEN 1.0::DOUBLE ELSE hi END) * 0.1::DOUBLE END AS pad FROM ({ranges}))"""


ORACLES["f5_series_extent"] = _LATENCY + _extent(
    "SELECT model_name, min(x) AS x0, max(x) AS x1, min(y) AS lo, max(y) AS hi FROM trend GROUP BY model_name",
    "model_name,",
)
ORACLES["f5_drift_chart_extent"] = _points(EVENT_RESULTS) + _extent(
    """SELECT min(start_time) AS x0, max(start_time) AS x1, least(min(rougeL_mean), 0.9::DOUBLE) AS lo,
  greatest(max(rougeL_mean), 0.9::DOUBLE) AS hi FROM points""",
    "",
)
ORACLES["f6_nearest_point"] = f"""{_LATENCY},
xs AS (SELECT DISTINCT model_name, x FROM trend),
near AS (
  SELECT event_id, xs.model_name, ts AS "at", x AS nearest_x FROM events JOIN xs ON xs.model_name = event_type
  QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY abs(epoch_us(x) - epoch_us(ts)), x) = 1)
SELECT event_id, near.model_name, "at", nearest_x, series, x, y FROM near JOIN trend ON trend.model_name = near.model_name
QUALIFY row_number() OVER (PARTITION BY event_id, series ORDER BY abs(epoch_us(x) - epoch_us(nearest_x)), x) = 1"""

# ---------------------------------------------------------------- streams

ORACLES["p1_run_outcomes"] = f"""WITH {RESPONSES},
asked AS (
  SELECT DISTINCT conv_id // 12 AS r, 'run_' || lpad(CAST(conv_id // 12 AS VARCHAR), 4, '0') AS run_id,
    'datasets/' || CASE (conv_id // 12) % 3 WHEN 0 THEN 'legal_qa' WHEN 1 THEN 'code_gen' ELSE 'summarization' END AS dataset
  FROM conversations WHERE (conv_id // 12) % 6 <> 4 AND (conv_id // 12) % 12 <> 11),
sizes AS (SELECT dataset, count(*) AS n FROM samples GROUP BY dataset),
answered AS (SELECT run_id, count(*) AS n FROM responses WHERE run_id <> 'run_0001' GROUP BY run_id)
SELECT run_id, dataset, 'completed' AS status,
  NULL::VARCHAR AS error, s.n * CASE WHEN r % 5 = 0 THEN 1 ELSE 4 END AS planned, coalesce(a.n, 0) AS results,
  planned - results AS failed
FROM asked JOIN sizes s USING (dataset) LEFT JOIN answered a USING (run_id)
UNION ALL SELECT 'run_none', 'none', 'failed', 'dataset not found', 0, 0, 0"""
ORACLES["p2_stored_series"] = ORACLES["d1_metrics_timeseries_runs"]
# A run without a time has no place in the series.
ORACLES["p3_health"] = _drift(f"{RESULTS},{RUNS}", "WHERE completed_at IS NOT NULL") + " SELECT * FROM drift"
ORACLES["g1_stream_run_store"] = ORACLES["d1_metrics_timeseries"]
ORACLES["g2_stream_window_metrics"] = f"""WITH {EVENT_RESULTS}
SELECT date_trunc('day', ts) AS day, model_name, count(*) AS answers, {_mean('latency_u * 100')} AS latency_mean,
  {RATE} AS halluc_rate
FROM results WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM results)
GROUP BY ALL"""
_STATUS = f"""WITH {RUNS}
SELECT run_id, status, coalesce(completed_at, started_at, created_at) AS "at" FROM runs"""
ORACLES["g3_stream_run_status"] = _STATUS
ORACLES["g3_run_status_batch"] = _STATUS
