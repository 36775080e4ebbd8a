"""DuckDB SQL with the same rows as the registered queries."""

from ..functions.text import FILLER
from ..operators.visibility import STAGE_WEIGHTS
from .frames import BRANDS, EXPERIMENTS

_STAGES = "[" + ", ".join(f"'{s}'" for s in STAGE_WEIGHTS) + "]"
_WEIGHT = "CASE stage " + " ".join(f"WHEN '{s}' THEN {w}" for s, w in STAGE_WEIGHTS.items()) + " ELSE 1 END"
_WORD = lambda a: a.replace("+", r"\+")
_BRANDS = " UNION ALL ".join(f"SELECT e::VARCHAR AS experiment_id, '{i}' AS brand_id, '{n}' AS name, '{h}' AS host, '{k}' AS kind, '({'|'.join(map(_WORD, a))})' AS pattern FROM range({EXPERIMENTS}) r(e)" for i, n, h, k, a in BRANDS)

_ANSWERS = rf"""
answers AS (SELECT (conv_id % {EXPERIMENTS})::VARCHAR AS experiment_id, concat_ws('-', conv_id, turn) AS answer_id, conv_id * 100 + turn AS ordinal, conv_id, turn, text AS raw,
  CASE WHEN conv_id % 11 = 0 THEN 'failed' ELSE 'completed' END AS status, conv_id % 13 = 0 AS truncated, conv_id % 17 <> 0 AS analyzed, conv_id % 19 = 0 AS refused,
  ({_STAGES})[conv_id % 6 + 1] AS stage, 't' || (conv_id % 3) AS type, 'p' || (conv_id % 4) AS persona_id, 'prov' || (conv_id % 2) || ' / m' || (turn % 2) AS source
  FROM conversations WHERE role = 'assistant'),
good AS (SELECT * FROM answers WHERE status = 'completed' AND analyzed AND NOT truncated AND regexp_matches(raw, '\S')),
brands AS ({_BRANDS}),
found AS (SELECT experiment_id, answer_id, brand_id,
  length(regexp_extract(raw, '(?is)^(.*?)(^|[^\p{{L}}\p{{N}}])' || pattern || '($|[^\p{{L}}\p{{N}}])', 1)) + length(regexp_extract(raw, '(?is)^(.*?)(^|[^\p{{L}}\p{{N}}])' || pattern || '($|[^\p{{L}}\p{{N}}])', 2)) AS "at"
  FROM answers JOIN brands USING (experiment_id) WHERE regexp_matches(raw, '(?is)(^|[^\p{{L}}\p{{N}}])' || pattern || '($|[^\p{{L}}\p{{N}}])')),
mentions AS (SELECT *, row_number() OVER (PARTITION BY experiment_id, answer_id ORDER BY "at", brand_id) AS first_position FROM found)"""

_HOST = r"regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^www\.', '')"
_CITATIONS = rf"""
citations AS (SELECT a.experiment_id, a.answer_id, a.ordinal, page_id AS pos, url, {_HOST} AS domain, CASE WHEN page_id % 2 = 0 THEN 'provider' ELSE 'answer_text' END AS source
  FROM answers a JOIN pages ON a.conv_id = page_id)"""


def _wilson(num: str, den: str, prefix: str, interval: bool = True) -> str:
    n, p = f"({den})::DOUBLE", f"(({num})::DOUBLE / nullif({den}, 0))"
    factor = f"(1 + 3.8416 / {n})"
    center = f"(({p} + 3.8416 / (2 * {n})) / {factor})"
    half = f"(1.96 * sqrt({p} * (1 - {p}) / {n} + 3.8416 / (4 * {n} * {n})) / {factor})"
    out = f"round({p}, 9) AS {prefix}_value"
    if interval:
        out += f", CASE WHEN {den} >= 10 THEN round(greatest(0.0, {center} - {half}), 9) END AS {prefix}_low, CASE WHEN {den} >= 10 THEN round(least(1.0, {center} + {half}), 9) END AS {prefix}_high"
    return out


BRAND_METRICS = f"""WITH {_ANSWERS}, {_CITATIONS},
totals AS (SELECT experiment_id, count(*) AS eligible FROM good GROUP BY 1),
m AS (SELECT experiment_id, brand_id, count(*) AS mentioned, count(*) FILTER (first_position = 1) AS recommended, sum({_WEIGHT})::BIGINT AS weighted FROM mentions JOIN good USING (experiment_id, answer_id) GROUP BY 1, 2),
c AS (SELECT DISTINCT experiment_id, answer_id, domain FROM citations JOIN good USING (experiment_id, answer_id)),
cw AS (SELECT experiment_id, count(DISTINCT answer_id) AS with_citations FROM c GROUP BY 1),
ch AS (SELECT experiment_id, brand_id, count(DISTINCT answer_id) AS cited FROM c JOIN brands USING (experiment_id) WHERE domain = host OR ends_with(domain, '.' || host) GROUP BY 1, 2),
j AS (SELECT experiment_id, brand_id, name, kind, eligible, coalesce(mentioned, 0) AS mentioned, coalesce(recommended, 0) AS recommended, coalesce(cited, 0) AS cited, coalesce(with_citations, 0) AS with_citations, coalesce(weighted, 0) AS weighted
  FROM totals JOIN brands USING (experiment_id) LEFT JOIN m USING (experiment_id, brand_id) LEFT JOIN cw USING (experiment_id) LEFT JOIN ch USING (experiment_id, brand_id))
SELECT experiment_id, brand_id, name, kind, eligible, mentioned, {_wilson("mentioned", "eligible", "mention")}, recommended, {_wilson("recommended", "eligible", "recommendation")}, cited, with_citations, {_wilson("cited", "with_citations", "citation")},
  weighted, round(weighted / nullif(sum(weighted) OVER (PARTITION BY experiment_id), 0), 9)::DOUBLE AS share, (sum(weighted) OVER (PARTITION BY experiment_id))::BIGINT AS share_denominator,
  CASE WHEN recommended > 0 THEN 1.0::DOUBLE END AS position, recommended AS position_samples, eligible - mentioned AS absent FROM j"""

BRAND_BY_TYPE = f"""WITH {_ANSWERS},
totals AS (SELECT experiment_id, type, count(*) AS eligible FROM good GROUP BY 1, 2),
m AS (SELECT experiment_id, type, brand_id, count(*) AS mentioned, sum({_WEIGHT}) AS weighted FROM mentions JOIN good USING (experiment_id, answer_id) GROUP BY 1, 2, 3)
SELECT experiment_id, type, brand_id, eligible, coalesce(mentioned, 0) AS mentioned, {_wilson("coalesce(mentioned, 0)", "eligible", "mention", False)},
  round(coalesce(weighted, 0) / nullif(sum(coalesce(weighted, 0)) OVER (PARTITION BY experiment_id, type), 0), 9)::DOUBLE AS share
FROM totals JOIN brands USING (experiment_id) LEFT JOIN m USING (experiment_id, type, brand_id)"""

_TARGET = f"""WITH {_ANSWERS},
hits AS (SELECT DISTINCT experiment_id, answer_id, 1 AS hit FROM mentions JOIN brands USING (experiment_id, brand_id) WHERE kind = 'target'),
t AS (SELECT good.*, coalesce(hit, 0) AS hit FROM good LEFT JOIN hits USING (experiment_id, answer_id))"""

STAGE_METRICS = f"""{_TARGET},
g AS (SELECT DISTINCT experiment_id, unnest({_STAGES}) AS stage FROM brands), n AS (SELECT experiment_id, stage, sum(hit)::BIGINT AS mentioned, count(*) AS eligible FROM t GROUP BY 1, 2),
j AS (SELECT experiment_id, stage, coalesce(mentioned, 0) AS mentioned, coalesce(eligible, 0) AS eligible FROM g LEFT JOIN n USING (experiment_id, stage))
SELECT experiment_id, stage, mentioned, eligible, {_wilson("mentioned", "eligible", "mention")} FROM j"""

SOURCE_METRICS = f"""{_TARGET}, j AS (SELECT experiment_id, source, sum(hit)::BIGINT AS mentioned, count(*) AS eligible FROM t GROUP BY 1, 2)
SELECT experiment_id, source, mentioned, eligible, {_wilson("mentioned", "eligible", "mention")} FROM j"""

_SLICES = "unnest([{'d': 'all', 'v': ''}, {'d': 'stage', 'v': stage}, {'d': 'type', 'v': type}, {'d': 'persona_id', 'v': persona_id}, {'d': 'source', 'v': source}])"
SLICED_METRICS = f"""WITH {_ANSWERS}, {_CITATIONS},
s AS (SELECT experiment_id, answer_id, stage, s.d AS dimension, s.v AS value FROM (SELECT *, {_SLICES} AS s FROM good)),
totals AS (SELECT experiment_id, dimension, value, count(*) AS eligible FROM s GROUP BY ALL),
m AS (SELECT experiment_id, dimension, value, brand_id, count(*) AS mentioned, count(*) FILTER (first_position = 1) AS recommended, sum({_WEIGHT})::BIGINT AS weighted FROM mentions JOIN s USING (experiment_id, answer_id) GROUP BY 1, 2, 3, 4),
c AS (SELECT DISTINCT experiment_id, answer_id, dimension, value, domain FROM citations JOIN s USING (experiment_id, answer_id)),
cw AS (SELECT experiment_id, dimension, value, count(DISTINCT answer_id) AS with_citations FROM c GROUP BY ALL),
ch AS (SELECT experiment_id, dimension, value, brand_id, count(DISTINCT answer_id) AS cited FROM c JOIN brands USING (experiment_id) WHERE domain = host OR ends_with(domain, '.' || host) GROUP BY ALL),
j AS (SELECT experiment_id, dimension, value, brand_id, eligible, coalesce(mentioned, 0) AS mentioned, coalesce(recommended, 0) AS recommended, coalesce(cited, 0) AS cited, coalesce(with_citations, 0) AS with_citations, coalesce(weighted, 0) AS weighted
  FROM totals JOIN brands USING (experiment_id) LEFT JOIN m USING (experiment_id, dimension, value, brand_id) LEFT JOIN cw USING (experiment_id, dimension, value) LEFT JOIN ch USING (experiment_id, dimension, value, brand_id))
SELECT experiment_id, dimension, value, brand_id, eligible, mentioned, {_wilson("mentioned", "eligible", "mention")}, recommended, {_wilson("recommended", "eligible", "recommendation")}, cited, with_citations, {_wilson("cited", "with_citations", "citation")},
  weighted, round(weighted / nullif(sum(weighted) OVER (PARTITION BY experiment_id, dimension, value), 0), 9)::DOUBLE AS share FROM j"""

_SLICED = f"""WITH {_ANSWERS}, {_CITATIONS},
s AS (SELECT experiment_id, answer_id, ordinal, s.d AS dimension, s.v AS value FROM (SELECT *, {_SLICES} AS s FROM good)),
r AS (SELECT s.*, pos, url, domain FROM citations c JOIN s USING (experiment_id, answer_id)),
t AS (SELECT experiment_id, min(host) AS host FROM brands WHERE kind = 'target' GROUP BY 1),
dom AS (SELECT experiment_id, dimension, value, domain, count(*) AS citations, count(DISTINCT url) AS n_urls, count(DISTINCT answer_id) AS n_answers, min(ordinal * 1000000000 + pos) AS first FROM r GROUP BY ALL),
ranked AS (SELECT experiment_id, dimension, value, domain, citations, n_urls, n_answers, domain = host OR ends_with(domain, '.' || host) AS target, row_number() OVER (PARTITION BY experiment_id, dimension, value ORDER BY citations DESC, first, domain) AS rank FROM dom LEFT JOIN t USING (experiment_id))"""
SLICED_CITATIONS = f"{_SLICED} SELECT * FROM ranked"
SLICED_CONCENTRATION = f"""{_SLICED}, j AS (SELECT experiment_id, dimension, value, (sum(citations) FILTER (rank <= 5))::BIGINT AS top, sum(citations)::BIGINT AS citations FROM ranked GROUP BY ALL)
SELECT experiment_id, dimension, value, top, citations, {_wilson("top", "citations", "concentration")} FROM j"""
SLICED_AGREEMENT = f"""{_SLICED}, j AS (SELECT experiment_id, dimension, value, count(*) FILTER (ordinal % 5 IN (0, 4)) AS supported, count(*) FILTER (ordinal % 5 IN (0, 1, 4)) AS judged, count(*) FILTER (ordinal % 5 = 2) AS unverifiable, count(*) FILTER (ordinal % 5 = 3) AS time_sensitive FROM s GROUP BY ALL)
SELECT experiment_id, dimension, value, supported, judged, {_wilson("supported", "judged", "agreement")}, unverifiable, time_sensitive FROM j"""

ANSWER_COUNTS = f"""WITH {_ANSWERS} SELECT experiment_id, count(*) FILTER (answer_id IN (SELECT answer_id FROM good)) AS eligible, count(*) FILTER (answer_id NOT IN (SELECT answer_id FROM good)) AS excluded,
  count(*) FILTER (refused AND answer_id IN (SELECT answer_id FROM good)) AS refusals FROM answers GROUP BY 1"""
MENTION_ORDER = f"WITH {_ANSWERS} SELECT experiment_id, answer_id, brand_id, \"at\", first_position FROM mentions"
FILTERED = f"WITH {_ANSWERS} SELECT experiment_id, answer_id FROM answers WHERE stage = 'solution_research' AND type = 't2' AND source = 'prov0 / m1'"

_DOMAINS = f"""WITH {_ANSWERS}, {_CITATIONS},
r AS (SELECT c.* FROM citations c JOIN good USING (experiment_id, answer_id)),
dom AS (SELECT experiment_id, domain, count(*) AS citations, count(DISTINCT url) AS n_urls, count(DISTINCT answer_id) AS n_answers, array_to_string((list_sort(list(DISTINCT url)))[1:100], ' ') AS urls, array_to_string(list_sort(list(DISTINCT source)), ' ') AS source_kinds, min(ordinal * 1000000000 + pos) AS first FROM r GROUP BY 1, 2),
t AS (SELECT experiment_id, min(host) AS host FROM brands WHERE kind = 'target' GROUP BY 1),
ranked AS (SELECT experiment_id, domain, citations, n_urls, n_answers, urls, source_kinds, domain = host OR ends_with(domain, '.' || host) AS target, row_number() OVER (PARTITION BY experiment_id ORDER BY citations DESC, first, domain) AS rank FROM dom LEFT JOIN t USING (experiment_id))"""
CITATION_DOMAINS = f"{_DOMAINS} SELECT * FROM ranked"
CITATION_URLS = f"{_DOMAINS} SELECT experiment_id, domain, url, count(*) AS citations, count(DISTINCT answer_id) AS n_answers FROM r GROUP BY ALL"
CONCENTRATION = f"""{_DOMAINS}, j AS (SELECT experiment_id, (sum(citations) FILTER (rank <= 5))::BIGINT AS top, sum(citations)::BIGINT AS citations FROM ranked GROUP BY 1)
SELECT experiment_id, top, citations, {_wilson("top", "citations", "concentration")} FROM j"""

CLAIM_AGREEMENT = f"""WITH j AS (SELECT user_id % 7 AS experiment_id, count(*) FILTER (event_type NOT IN ('error', 'view')) AS supported, count(*) FILTER (event_type <> 'view') AS judged, count(*) FILTER (event_type = 'view') AS unverifiable, 0::BIGINT AS time_sensitive FROM events GROUP BY 1)
SELECT experiment_id, supported, judged, {_wilson("supported", "judged", "agreement")}, unverifiable, time_sensitive FROM j"""

PREVIOUS_RUN = """SELECT user_id AS project_id, event_type AS setup, event_id AS run_id, (max({'t': ts, 'i': event_id}) OVER (PARTITION BY user_id, event_type ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING)).i AS previous_run_id FROM events"""
RUN_PROGRESS = f"""WITH {_ANSWERS} SELECT experiment_id, count(*) AS total, count(*) FILTER (status = 'completed') AS answered, count(*) FILTER (status = 'completed') AS completed, CASE WHEN count(*) = count(*) FILTER (status = 'completed') THEN 'completed' ELSE 'partial' END AS status FROM answers GROUP BY 1"""

_QUESTIONS = f"""q0 AS (SELECT conv_id * 100 + turn AS id, (conv_id % 5)::VARCHAR AS project_id, text, ({_STAGES})[conv_id % 6 + 1] AS stage, conv_id % 6 AS stage_no, 'p' || (conv_id % 4) AS persona_id,
  (conv_id % 5 + 1)::INTEGER AS intent, turn % 3 = 0 AS branded, CASE WHEN conv_id % 10 = 0 THEN 'archived' ELSE 'active' END AS status, conv_id % 4 = 0 AS selected FROM conversations WHERE role = 'user'),
questions AS (SELECT *, trim(regexp_replace(lower(nfc_normalize(text)), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS normalized_text FROM q0)"""
ANSWER_GRID = f"WITH {_QUESTIONS} SELECT project_id AS experiment_id, id AS place, sample::INTEGER AS sample, (row_number() OVER (PARTITION BY project_id ORDER BY sample, id) - 1)::INTEGER AS ordinal FROM questions, range(1, 4) s(sample) WHERE selected"
RUN_ESTIMATE = f"WITH {_QUESTIONS} SELECT project_id AS experiment_id, count(*) AS questions, count(*) * 3 AS answers, count(*) * 6 AS requests, ceil(sum(length(text) / 4 + 5000) * 3)::BIGINT AS input_tokens, count(*) * 12000 AS output_ceiling FROM questions WHERE selected GROUP BY 1"
RUN_HISTORY = f"""WITH {_ANSWERS}, totals AS (SELECT experiment_id, count(*) AS eligible FROM good GROUP BY 1), m AS (SELECT experiment_id, brand_id, count(*) AS mentioned FROM mentions JOIN good USING (experiment_id, answer_id) GROUP BY 1, 2),
runs AS (SELECT DISTINCT experiment_id, (experiment_id::INTEGER % 2)::INTEGER AS project_id FROM brands), latest AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY experiment_id DESC) AS k FROM runs)
SELECT project_id, experiment_id, brand_id, coalesce(mentioned, 0) AS mentioned, eligible FROM latest JOIN totals USING (experiment_id) JOIN brands USING (experiment_id) LEFT JOIN m USING (experiment_id, brand_id) WHERE k <= 2"""

USAGE_TOTALS = "SELECT user_id AS project_id, count(*) AS attempts, sum(trunc(value * 100)::BIGINT)::BIGINT AS input_tokens, sum(length(props))::BIGINT AS output_tokens, round(sum(value), 9) AS cost, count(*) FILTER (value IS NULL) AS without_cost FROM events GROUP BY 1"
LATEST_USAGE = "SELECT project_id, id, place FROM (SELECT user_id AS project_id, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)::INTEGER AS place FROM events) WHERE place <= 10"
LATEST_RESPONSES = "SELECT user_id AS project_id, event_type AS cache_key, (max({'t': ts, 'i': event_id})).i AS id FROM events WHERE event_type <> 'error' GROUP BY 1, 2"
LATEST_CRAWLS = "SELECT o_custkey AS brand_id, (max({'t': o_orderdate, 'i': o_orderkey})).i AS id FROM orders GROUP BY 1"
CRAWL_COUNTERS = "SELECT user_id AS crawl_run_id, count(*) AS processed, count(*) FILTER (event_type NOT IN ('error', 'view')) AS fetched, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type = 'view') AS skipped FROM events GROUP BY 1"

_FACTS = "facts AS (SELECT p_partkey AS id, p_brand AS brand_id, lower(trim(regexp_replace(p_type, '\\s+', ' ', 'g'))) AS subject, p_size::VARCHAR AS value, p_partkey * 7919 % 10007 AS updated_at FROM part WHERE p_partkey % 9 <> 0)"
CONTRADICTIONS = f"WITH {_FACTS} SELECT brand_id, 'product' AS category, subject, 'size' AS attribute, count(DISTINCT value) AS n_values, count(*) AS n_facts, array_to_string(list_sort(list(DISTINCT value))[1:100], ' ') AS values, array_to_string(list_sort(list(id))[1:100], ' ') AS fact_ids FROM facts GROUP BY brand_id, subject HAVING count(DISTINCT value) > 1"
CONTRADICTING_FACTS = f"WITH {_FACTS} SELECT brand_id, 'product' AS category, subject, 'size' AS attribute, id, value FROM facts QUALIFY min(value) OVER (PARTITION BY brand_id, subject) <> max(value) OVER (PARTITION BY brand_id, subject)"
REFERENCE_FACTS = f"WITH {_FACTS} SELECT brand_id, id, place FROM (SELECT brand_id, id, row_number() OVER (PARTITION BY brand_id ORDER BY updated_at DESC, id)::INTEGER AS place FROM facts) WHERE place <= CASE WHEN ends_with(brand_id, '1') THEN 60 ELSE 12 END"
CONTEXT_FACTS = f"""WITH {_FACTS}, d AS (SELECT *, row_number() OVER (PARTITION BY brand_id, subject, value ORDER BY updated_at DESC, id) AS k FROM facts)
SELECT brand_id, id, place FROM (SELECT brand_id, id, row_number() OVER (PARTITION BY brand_id ORDER BY updated_at DESC, id)::INTEGER AS place FROM d WHERE k = 1) WHERE place <= 40"""
MERGED_FACTS = """WITH f AS (SELECT p_partkey AS id, p_brand, p_type, p_size FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type, p_size ORDER BY id) AS k FROM f WHERE id % 2 = 0)
SELECT id FROM n WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM f WHERE f.id % 2 = 1 AND f.p_brand = n.p_brand AND f.p_type = n.p_type AND f.p_size = n.p_size)"""

_FILLER = "[" + ", ".join(f"'{w}'" for w in FILLER) + "]"
DEDUPED_QUESTIONS = f"""WITH {_QUESTIONS}, k AS (SELECT *, coalesce(nullif(array_to_string(list_filter(string_split(normalized_text, ' '), lambda w: NOT list_contains({_FILLER}, w)), ' '), ''), normalized_text) AS key FROM questions)
SELECT project_id, id, normalized_text FROM (SELECT *, row_number() OVER (PARTITION BY project_id, key ORDER BY id) AS n FROM k) WHERE n = 1"""
RECOMMENDED = f"""WITH {_QUESTIONS}, r AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY intent DESC, id) AS r FROM questions WHERE status = 'active'),
s AS (SELECT project_id, id, r, least(5000000 + r,
  CASE WHEN row_number() OVER (PARTITION BY project_id, stage ORDER BY r) = 1 THEN stage_no + 1 END, CASE WHEN row_number() OVER (PARTITION BY project_id, persona_id ORDER BY r) = 1 THEN 1000000 + r END,
  CASE WHEN branded AND row_number() OVER (PARTITION BY project_id, branded ORDER BY r) = 1 THEN 2000000 END, CASE WHEN NOT branded AND row_number() OVER (PARTITION BY project_id, branded ORDER BY r) = 1 THEN 3000000 END,
  CASE WHEN intent <= 2 AND row_number() OVER (PARTITION BY project_id, intent <= 2 ORDER BY r) = 1 THEN 4000000 END) AS seat FROM r)
SELECT project_id, id, place FROM (SELECT project_id, id, row_number() OVER (PARTITION BY project_id ORDER BY seat)::INTEGER AS place FROM s) WHERE place <= 20"""
LIBRARY_CHECK = f"""WITH {_QUESTIONS} SELECT project_id, count(*) AS active, bool_or(intent <= 2) AS low, bool_or(intent >= 4) AS high, bool_or(branded) AS branded, bool_or(NOT branded) AS unbranded,
  count(*) >= 30 AND bool_or(intent <= 2) AND bool_or(intent >= 4) AND bool_or(branded) AND bool_or(NOT branded) AS complete FROM questions WHERE status = 'active' GROUP BY 1"""
STAGE_SHORTAGE = f"""WITH {_QUESTIONS}, g AS (SELECT DISTINCT project_id, unnest({_STAGES}) AS stage, unnest(range(6)) AS k FROM questions), c AS (SELECT project_id, stage, k, (SELECT count(*) FROM questions q WHERE q.project_id = g.project_id AND q.stage = g.stage AND q.status = 'active') AS n FROM g)
SELECT project_id, stage, n FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY n, k) AS r FROM c) WHERE r = 1"""
FINGERPRINT = f"""WITH {_QUESTIONS}, l AS (SELECT project_id, id, sha256(concat_ws('|', id, text, 'Unspecified')) AS line, (row_number() OVER (PARTITION BY project_id ORDER BY id) - 1) // 1000 AS block FROM questions WHERE selected),
b AS (SELECT project_id, block, sha256(string_agg(line, chr(10) ORDER BY id)) AS digest FROM l GROUP BY ALL)
SELECT project_id, sha256(string_agg(digest, chr(10) ORDER BY block)) AS fingerprint FROM b GROUP BY 1"""
BRANDED = f"WITH {_QUESTIONS} SELECT id FROM questions WHERE contains(' ' || normalized_text || ' ', ' the ') OR contains(' ' || normalized_text || ' ', ' que ')"

EXACT_DUPLICATES = "SELECT source AS crawl_run_id, doc_id AS id, min(doc_id) OVER (PARTITION BY source, text) AS first, count(*) OVER (PARTITION BY source, text) AS n FROM documents WHERE text <> '' QUALIFY n > 1"
NEAR_DUPLICATES = r"""WITH RECURSIVE p AS (SELECT lang, doc_id AS id, text FROM documents UNION ALL SELECT lang, doc_id + 1000000000000, text || ' and a tail' FROM documents WHERE doc_id % 5 = 0),
t AS (SELECT lang, min(id) AS id, text, count(*) AS copies FROM p GROUP BY lang, text),
w AS (SELECT *, (regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))[1:5000] AS w FROM t),
s AS (SELECT lang, id, copies, list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM w WHERE len(w) >= 100),
e AS (SELECT lang, id, unnest(s) AS s FROM s),
c AS (SELECT a.lang, a.id AS a, b.id AS b, count(*) AS n FROM e a JOIN e b ON a.lang = b.lang AND a.s = b.s AND a.id < b.id GROUP BY ALL),
link AS MATERIALIZED (SELECT c.lang, a, b FROM c JOIN s x ON x.id = a AND x.lang = c.lang JOIN s y ON y.id = b AND y.lang = c.lang
  WHERE least(len(x.s), len(y.s)) >= 0.85 * greatest(len(x.s), len(y.s)) AND n / (len(x.s) + len(y.s) - n) >= 0.85),
ways AS MATERIALIZED (SELECT lang, a, b FROM link UNION ALL SELECT lang, b, a FROM link),
reach(lang, id, other) AS (SELECT DISTINCT lang, a, a FROM ways UNION SELECT r.lang, r.id, b FROM reach r JOIN ways ON ways.lang = r.lang AND ways.a = r.other),
least AS (SELECT lang, id, min(other) AS class FROM reach GROUP BY ALL),
sizes AS (SELECT l.lang, class, count(*) AS texts, sum(copies)::BIGINT AS pages FROM least l JOIN t ON t.lang = l.lang AND t.id = l.id GROUP BY ALL)
SELECT p.lang AS crawl_run_id, p.id, t.id AS first, class, texts, pages FROM p JOIN t ON t.lang = p.lang AND t.text = p.text JOIN least l ON l.lang = t.lang AND l.id = t.id JOIN sizes z USING (class) WHERE z.lang = p.lang"""

_PLAIN = r"regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '\?utm_source=feed$', ''), '/+$', '')"
NORMALIZED_URLS = f"SELECT page_id, {_PLAIN} AS url FROM pages"
DOMAINS = rf"""SELECT page_id, {_HOST} AS domain, NOT regexp_matches(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '\.(txt|xml|json|pdf|zip)$') AS candidate, {_HOST} = 'example.com' OR ends_with({_HOST}, '.example.com') AS own,
  regexp_matches(url, '^https?://[^/]+/fr(/|$|[?#])') AS excluded FROM pages"""
FRONTIER = f"""WITH u AS (SELECT {_HOST} AS crawl_run_id, {_PLAIN} AS url, min(page_id) AS seen FROM pages WHERE NOT regexp_matches(url, '^https?://[^/]+/de(/|$|[?#])') GROUP BY 1, 2)
SELECT crawl_run_id, url, place FROM (SELECT *, row_number() OVER (PARTITION BY crawl_run_id ORDER BY seen, url)::INTEGER AS place FROM u) WHERE place <= 3"""

SAFE_CSV = "SELECT event_id::VARCHAR AS event_id, CASE WHEN user_id % 3 = 0 THEN ''' =' || event_type ELSE event_type END AS kind, CASE WHEN user_id > 0 THEN '''-' || user_id ELSE (-user_id)::VARCHAR END AS n FROM events"
REDACTED = "SELECT doc_id, replace(replace(text, 'the', '[REDACTED]'), 'mail3', '[REDACTED]') AS text FROM documents"
PRIORITIES = "SELECT p_partkey, floor(p_size * 0.35::DOUBLE + (p_size + 30) * 0.25::DOUBLE + 0.65::DOUBLE * 100 * 0.15::DOUBLE + 80 * 0.15::DOUBLE + (CASE p_partkey % 3 WHEN 0 THEN 100 WHEN 1 THEN 60 ELSE 20 END) * 0.1::DOUBLE + 0.5::DOUBLE)::INTEGER AS priority FROM part"
COVERAGE_MATRIX = "SELECT l_partkey AS question_id, count(DISTINCT l_orderkey) FILTER (l_returnflag = 'A') AS A, count(DISTINCT l_orderkey) FILTER (l_returnflag = 'N') AS N, count(DISTINCT l_orderkey) FILTER (l_returnflag = 'R') AS R FROM lineitem GROUP BY 1"
THIRD_PARTY = f"""WITH {_ANSWERS}, {_CITATIONS}, u AS (SELECT experiment_id AS project_id, url, min(ordinal * 1000000000 + pos) AS first FROM citations WHERE domain <> 'tionble.example.org' GROUP BY 1, 2)
SELECT project_id, url, place FROM (SELECT project_id, url, row_number() OVER (PARTITION BY project_id ORDER BY first, url)::INTEGER AS place FROM u) WHERE place <= 5"""

_ISSUES = "i AS (SELECT user_id % 20 AS crawl_run_id, CASE WHEN event_type = 'error' THEN 'error' WHEN event_id % 2 = 0 THEN 'warning' ELSE 'observation' END AS severity, 'c' || (event_id % 5) AS category, 'r' || (event_id % 13) AS rule_id, 'https://a.com/' || event_id AS url FROM events)"
ISSUE_SUMMARY = f"WITH {_ISSUES} SELECT crawl_run_id, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'observation') AS observations, count(DISTINCT category)::INTEGER AS n_categories, count(DISTINCT rule_id)::INTEGER AS n_rules FROM i GROUP BY 1"
ATTENTION = f"""WITH {_ISSUES}, g AS (SELECT crawl_run_id, category, bool_or(severity = 'error') AS any_error, count(*) AS n FROM i WHERE severity <> 'observation' GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY crawl_run_id ORDER BY any_error DESC, n DESC, category)::INTEGER AS rank FROM g) WHERE rank <= 3"""
SEARCH_ISSUES = f"""WITH {_ISSUES} SELECT * FROM i WHERE category = 'c2' AND contains(url, '/1') ORDER BY CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, rule_id, url LIMIT 20 OFFSET 20"""

EXTRACTED_CITATIONS = rf"""WITH u AS (SELECT page_id AS answer_id, url, 'provider' AS source FROM pages UNION ALL SELECT page_id, 'https://www.other.com/' || page_id, 'answer_text' FROM pages)
SELECT answer_id, url, {_HOST} AS domain, source FROM u"""
ADJUDICATED = """WITH c AS (SELECT p_brand, lower(p_type) AS t FROM part GROUP BY ALL HAVING count(DISTINCT p_size) > 1)
SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey AS claim_id, CASE WHEN c.t IS NOT NULL THEN 'unverifiable' WHEN p_partkey % 5 = 0 OR l_linenumber = 1 THEN 'time_sensitive' ELSE 'supported' END AS classification
FROM lineitem JOIN part p ON l_partkey = p_partkey LEFT JOIN c ON c.p_brand = p.p_brand AND c.t = lower(p.p_type)"""
_GAPS = """m AS (SELECT l_partkey AS q, count(DISTINCT l_suppkey) FILTER (s_nationkey % 2 = 0) AS own, count(DISTINCT l_suppkey) FILTER (s_nationkey % 2 = 1) AS rivals, max(s_suppkey % 20) FILTER (s_nationkey % 2 = 0) AS best FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1),
gaps AS (SELECT p_partkey AS question_id, CASE WHEN coalesce(own, 0) > 0 THEN 'Weak direct answer' WHEN p_size % 2 = 0 THEN 'Pricing clarity' ELSE 'Question coverage' END AS type, CASE WHEN coalesce(own, 0) > 0 THEN 'update' ELSE 'create' END AS action, CASE WHEN coalesce(own, 0) > 0 THEN 'small' ELSE 'medium' END AS effort,
  (p_size % 5 + 1) * 20 AS impact, CASE WHEN coalesce(own, 0) > 0 THEN 0.65::DOUBLE ELSE 0.55::DOUBLE END AS confidence, coalesce(rivals, 0) AS rivals FROM part LEFT JOIN m ON q = p_partkey WHERE coalesce(own, 0) = 0 OR best < 10)"""
GAP_PAGES = f"""WITH {_GAPS} SELECT DISTINCT question_id, CASE WHEN s_nationkey % 2 = 0 THEN 'target' ELSE 'competitor' END AS kind, s_suppkey AS page_id, 'https://a.com/' || s_suppkey AS url FROM gaps JOIN lineitem ON l_partkey = question_id JOIN supplier ON s_suppkey = l_suppkey"""
CONTENT_GAPS = f"WITH {_GAPS} SELECT * FROM gaps"
ACTION_PLAN = f"""WITH {_GAPS}, {_ISSUES}, first AS (SELECT rule_id, severity, url FROM i WHERE severity <> 'observation' ORDER BY severity <> 'error', rule_id, url LIMIT 40),
a AS (SELECT 'Technical accessibility' AS category, 1 AS month, floor(70 * 0.35::DOUBLE + (CASE severity WHEN 'error' THEN 90 ELSE 55 END) * 0.25::DOUBLE + 0.9::DOUBLE * 100 * 0.15::DOUBLE + 80 * 0.15::DOUBLE + 100 * 0.1::DOUBLE + 0.5::DOUBLE) AS priority FROM (SELECT DISTINCT rule_id, url, severity FROM first)
UNION ALL SELECT 'Commercial content', CASE effort WHEN 'small' THEN 1 ELSE 2 END, floor(impact * 0.35::DOUBLE + (CASE WHEN rivals > 0 THEN 80 ELSE 60 END) * 0.25::DOUBLE + confidence * 100 * 0.15::DOUBLE + 80 * 0.15::DOUBLE + (CASE effort WHEN 'small' THEN 100 ELSE 60 END) * 0.1::DOUBLE + 0.5::DOUBLE) FROM gaps
UNION ALL SELECT 'Monitoring', 3, 69)
SELECT 'p' AS project_id, category, month, priority::INTEGER AS priority, count(*) AS actions FROM a GROUP BY ALL"""
PROFILE_SOURCES = r"""WITH p AS (SELECT source AS crawl_run_id, doc_id AS id, (doc_id % 4)::INTEGER AS level, 'https://a.com' || (['/', '/about/us', '/pricing', '/blog/x'])[doc_id % 4 + 1] || '?id=' || doc_id AS url FROM documents WHERE length(trim(text)) >= 16)
SELECT crawl_run_id, id, level, place FROM (SELECT *, row_number() OVER (PARTITION BY crawl_run_id ORDER BY level, url)::INTEGER AS place FROM p) WHERE place <= 5"""
BRAND_ALIASES = "SELECT brand_id, array_to_string(list_sort(list_distinct([brand_id, 'a.com', 'Alias'] || coalesce(list(p_size::VARCHAR) FILTER (length(p_size::VARCHAR) >= 2 AND p_partkey % 9 <> 0), []))), '|') AS aliases FROM (SELECT p_brand AS brand_id, p_size, p_partkey FROM part) GROUP BY brand_id"
REPEATED_DOMAINS = f"SELECT page_id % 20 AS project_id, {_HOST} AS domain, count(*) AS n FROM pages GROUP BY 1, 2 HAVING count(*) > 1"
BRAND_CHANGES = f"""WITH r AS (SELECT page_id % 2 AS half, {_HOST} AS d, min(page_id)::VARCHAR AS id FROM pages GROUP BY 1, 2), a AS (SELECT * FROM r WHERE half = 0), b AS (SELECT * FROM r WHERE half = 1)
SELECT 'https://' || coalesce(a.d, b.d) AS domain, b.id, a.d IS NOT NULL AS active, CASE WHEN a.d IS NULL THEN 'deactivate' WHEN b.d IS NULL THEN 'insert' ELSE 'keep' END AS change FROM a FULL JOIN b USING (d)"""
COMPANY_SUMMARY = """WITH f AS (SELECT *, row_number() OVER (PARTITION BY p_brand, p_partkey % 4 >= 2 ORDER BY p_size DESC, p_partkey DESC) AS o, row_number() OVER (PARTITION BY p_brand, p_partkey % 4 ORDER BY p_size DESC, p_partkey DESC) AS k FROM part)
SELECT p_brand AS project_id, CASE WHEN ends_with(p_brand, '1') THEN 'Own words' ELSE max(p_name) FILTER (p_partkey % 4 = 0 AND k = 1) END AS summary, coalesce(string_agg(p_name, '|' ORDER BY k) FILTER (p_partkey % 4 = 1 AND k <= 2), '') AS customers, coalesce(string_agg(p_name, '|' ORDER BY o) FILTER (p_partkey % 4 >= 2 AND o <= 3), '') AS offers FROM f GROUP BY p_brand"""
IDENTICAL_PAGES = "WITH g AS (SELECT lang, text, list(doc_id ORDER BY doc_id) AS ids FROM documents GROUP BY ALL HAVING count(*) > 1) SELECT d.lang AS brand_id, d.doc_id AS id, array_to_string((list_filter(ids[1:21], lambda i: i <> d.doc_id))[1:20], ',') AS similar FROM documents d JOIN g USING (lang, text)"
SITE_AVERAGES = "SELECT o_custkey AS brand_id, round(avg(o_totalprice::DOUBLE), 9) AS score, 60.0::DOUBLE AS evaluated_weight, count(*) AS pages FROM orders GROUP BY 1"
VALID_FACTS = r"""WITH p AS (SELECT doc_id, (trim(regexp_replace(nfc_normalize(text), '\s+', ' ', 'g')))[1:8000] AS t FROM documents),
r AS (SELECT d.doc_id, list_filter([CASE WHEN d.doc_id % 3 = 0 THEN 'category' END, CASE WHEN d.doc_id % 7 = 0 THEN 'subject' END, CASE WHEN d.doc_id % 11 = 0 THEN 'attribute' END, CASE WHEN d.doc_id % 5 / 3 > 1 THEN 'confidence' END, CASE WHEN NOT coalesce(length(trim(d.text[1:40])) >= 16 AND contains(p.t, trim(regexp_replace(d.text[1:40], '\s+', ' ', 'g'))), false) THEN 'quote' END], lambda x: x IS NOT NULL) AS reasons_ FROM documents d LEFT JOIN p ON p.doc_id = d.doc_id - d.doc_id % 2)
SELECT doc_id, array_to_string(reasons_, ',') AS reasons FROM r"""
PROMPTS = f"WITH {_QUESTIONS} SELECT id, CASE WHEN id % 2 = 0 THEN text ELSE text || chr(10) || 'Buyer location: EU' END AS prompt, sha256(text)[1:20] AS key FROM questions"


#: Pages of the tables are plain: comments, scripts and styles, spaces where the standard's text has them, and few references.
EXTRACTED = rf"""
WITH p AS (SELECT page_id::VARCHAR AS id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS crawl_run_id, html,
  regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<(script|style)[^>]*>.*?</(script|style)>', '', 'gs'), '^.*<body[^>]*>', '', 's') AS body FROM pages),
t AS (SELECT *, regexp_replace(replace(replace(replace(regexp_replace(regexp_replace(body, '<(br|p|/p|/div|/article|/li|/h[1-6])>', ' ', 'g'), '<[^>]*(>|$)', '', 'g'), '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;?', '&', 'g') AS raw FROM p),
v AS (SELECT *, trim(regexp_replace(raw, '[ \t\n\f\r]+', ' ', 'g')) AS visible FROM t)
SELECT id, crawl_run_id, trim(regexp_replace(replace(replace(regexp_extract(html, '<title>(.*?)</title>', 1, 's'), '&quot;', '"'), '&amp;', '&'), '[ \t\n\f\r]+', ' ', 'g')) AS title, (CASE WHEN visible = '' THEN 0 ELSE len(string_split(visible, ' ')) END)::INTEGER AS word_count,
  nullif(regexp_extract(html, '<html lang="([^"]*)"', 1), '') AS language, sha256(visible) AS text_hash, len(list_distinct(list_transform(regexp_extract_all(body, '<a href="([^"]*)"', 1), lambda h: regexp_replace(h, '(.)/$', '\1'))))::INTEGER AS internal_links FROM v
"""
