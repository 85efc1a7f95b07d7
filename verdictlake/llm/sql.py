"""DuckDB SQL for the queries that SQL can express."""

ORACLES: dict[str, str] = {}

ORACLES["op1_warc_bundles"] = """
WITH facts AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS digest FROM pages
), largest AS (
  SELECT digest, max(page_id) AS top FROM facts WHERE n >= 1000 GROUP BY digest
)
SELECT page_id, n AS payload_bytes, f.digest AS payload_digest,
       CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < top THEN top END AS refers_to
FROM facts f LEFT JOIN largest l ON f.digest = l.digest AND n >= 1000
"""

ORACLES["op2_source_mix"] = r"""
WITH sized AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS source_key,
         md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS place,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents
), sources AS (
  SELECT source_key, sum(size)::BIGINT AS source_size,
         [3, 1, 2][((row_number() OVER (ORDER BY source_key) - 1) % 3 + 1)::INT]::BIGINT AS weight
  FROM sized GROUP BY source_key
), queue AS (
  SELECT *, row_number() OVER limits AS place,
         sum(source_size) OVER () * 150
           - coalesce(sum(source_size * 200) OVER (limits ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pot,
         sum(weight) OVER ()
           - coalesce(sum(weight) OVER (limits ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS parts
  FROM sources WINDOW limits AS (ORDER BY source_size / weight, source_key)
), opened AS (
  SELECT place AS first_open, pot AS first_pot, parts AS first_parts FROM queue
  WHERE pot * weight <= source_size * 200 * parts ORDER BY place LIMIT 1
), targets AS (
  SELECT source_key, source_size,
         CASE WHEN place >= first_open
              THEN least((first_pot * weight)::DOUBLE / (first_parts * 100)::DOUBLE, (source_size * 2)::DOUBLE)
              ELSE (source_size * 2)::DOUBLE END AS target
  FROM queue LEFT JOIN opened ON true
), timed AS (
  SELECT s.*, t.source_size, t.target,
         sum(size) OVER (PARTITION BY s.source_key ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS begun
  FROM sized s JOIN targets t ON s.source_key = t.source_key
)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(size, floor(target)::BIGINT - begun))
        + greatest(0, least(size, floor(target)::BIGINT - begun - source_size)))::BIGINT AS taken
FROM timed
"""

ORACLES["op5_repeated_passages"] = r"""
WITH split AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM split WHERE len(w) >= 35)
), again AS (
  SELECT doc_id, i FROM windows WHERE h IN (SELECT h FROM windows GROUP BY h HAVING count(*) > 1)
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM again
), placed AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM split
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n
  FROM placed ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (doc_id)
"""

#: Of 13 words with at most two different ones, one of three runs of words is equal on both sides.
_RUNS = ((0, 4), (4, 4), (8, 5))
_SEEDS = " UNION ALL ".join(
    f"SELECT id, i, w[i:i + 12] AS words, {first} AS run, array_to_string(w[i + {first}:i + {first + size - 1}], ' ') AS seed FROM {{table}}"
    for first, size in _RUNS
)

#: Items of fewer than 13 words do not occur in the test tables and are left out here.
ORACLES["op10_benchmark_overlaps"] = r"""
WITH doc_words AS (
  SELECT doc_id AS id, coalesce(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), []) AS w FROM documents
), item_words AS (
  SELECT item_id AS id, coalesce(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), []) AS w FROM benchmark
), doc_at AS (SELECT id, w, unnest(range(1, len(w) - 11)) AS i FROM doc_words WHERE len(w) >= 13),
item_at AS (SELECT id, w, unnest(range(1, len(w) - 11)) AS i FROM item_words WHERE len(w) >= 13),
doc_seeds AS (""" + _SEEDS.format(table="doc_at") + r"""),
item_seeds AS (""" + _SEEDS.format(table="item_at") + r"""),
hits AS (
  SELECT DISTINCT d.id, d.i, b.id AS item FROM doc_seeds d JOIN item_seeds b ON d.run = b.run AND d.seed = b.seed
  WHERE list_sum(list_transform(range(1, 14), lambda k: (d.words[k] = b.words[k])::INT)) >= 11
), covered AS (
  SELECT id, count(DISTINCT p) AS words_hit FROM (SELECT id, unnest(range(i, i + 13)) AS p FROM hits) GROUP BY id
), items AS (SELECT id, count(DISTINCT item) AS n_items FROM hits GROUP BY id)
SELECT doc_id, words_hit IS NOT NULL AS contaminated, coalesce(words_hit, 0)::BIGINT AS words_hit,
       coalesce(n_items, 0)::BIGINT AS n_items
FROM documents d LEFT JOIN covered c ON d.doc_id = c.id LEFT JOIN items i ON d.doc_id = i.id
"""

_FAILS = {
    "A": "len(words) < 200",
    "B": "100 * len(list_distinct(words)) < 50 * len(words)",
    "C": "100 * len(regexp_extract_all(body, '[A-Z]')) > 2 * len(body)",
    "D": "regexp_matches(body, '[#$%&*|]')",
    "E": "coalesce(doc_id > min(doc_id) OVER (PARTITION BY body), false)",
}

ORACLES["op13_filter_audit"] = r"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), failed AS (
  SELECT doc_id, part, """ + ", ".join(f"({rule}) AS f{letter}" for letter, rule in _FAILS.items()) + r""" FROM texts
), marked AS (
  SELECT f.*, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS bad
  FROM failed f LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) USING (doc_id)
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (SELECT filter_order, unnest(range(1, 6))::INT AS step FROM orders),
lists AS (
  SELECT part, good, bad, count(*) AS n,
         concat(CASE WHEN fA THEN 'A' END, CASE WHEN fB THEN 'B' END, CASE WHEN fC THEN 'C' END,
                CASE WHEN fD THEN 'D' END, CASE WHEN fE THEN 'E' END) AS fails
  FROM marked GROUP BY ALL
), told AS (
  SELECT *, filter_order[step] AS letter, contains(fails, filter_order[step]) AS now,
         len(translate(fails, filter_order[1:step - 1], '')) < len(fails) AS earlier FROM lists, steps
), counted AS (
  SELECT part, filter_order, step, letter,
         sum(CASE WHEN NOT now AND NOT earlier THEN n ELSE 0 END)::BIGINT AS kept,
         sum(CASE WHEN now AND NOT earlier THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN now AND earlier THEN n ELSE 0 END)::BIGINT AS redundant,
         sum(CASE WHEN fails = letter THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN now AND NOT earlier AND good THEN n ELSE 0 END)::BIGINT AS good_lost,
         sum(CASE WHEN now AND NOT earlier AND bad THEN n ELSE 0 END)::BIGINT AS toxic_lost
  FROM told GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM counted
"""
