"""DuckDB SQL of the audit and the link graph over the derived crawl; rules are written anew over plain columns."""

from .crawls import COLUMNS, CRAWLS, FAQ, HOPS, LINKS, LLMS, site, url_of

_FAQ_FOUND = "contains(lower(t), 'the') AND contains(lower(t), 'of')"
_FAQ_OTHER = "contains(lower(t), 'der') AND contains(lower(t), 'die')"
assert FAQ.count("%s") == 2


def _key(url: str) -> str:
    """Normal form of the derived URLs: no fragment, no last slash but the root's."""
    return f"regexp_replace(regexp_replace({url}, '#.*$', ''), '([^/])/+$', '\\1') || CASE WHEN regexp_matches(regexp_replace({url}, '#.*$', ''), '^https?://[^/]+/?$') THEN '/' ELSE '' END"


def _norm(url: str) -> str:
    return f"(CASE WHEN {url} IS NULL OR {url} = '' THEN {url} ELSE {_key(url)} END)"


_PAGES = rf"""
d AS (SELECT doc_id AS k, text AS t, sha256(text) AS sha256_of_t FROM documents),
p0 AS (SELECT k, t, {", ".join(f"{e} AS {c}" for c, e in COLUMNS.items())} FROM d),
p AS (SELECT *, coalesce(nullif(final_url, ''), url) AS page_url, {_norm("url")} AS url_k, {_norm("final_url")} AS final_k, {_norm("canonical_url")} AS canonical_k, k % 16 <> 15 AS has_signals,
  CASE WHEN k < {CRAWLS} THEN 'home' WHEN k % 6 = 3 THEN 'editorial' WHEN k % 6 = 1 THEN 'product' WHEN k % 6 = 2 THEN 'faq' ELSE 'other' END AS kind FROM p0),
pk AS (SELECT *, coalesce(nullif(final_k, ''), url_k) AS page_k FROM p)"""

_GRAPH = rf"""{_PAGES},
own AS (SELECT DISTINCT crawl_run_id, unnest([url_k, final_k]) AS key, id AS page_id, status, status_code, url, CASE WHEN status = 'fetched' THEN 2 ELSE 1 END AS level FROM pk),
own1 AS (SELECT * FROM own WHERE key IS NOT NULL),
first AS (SELECT * FROM own1 QUALIFY row_number() OVER (PARTITION BY crawl_run_id, key ORDER BY level DESC, url DESC, page_id DESC) = 1),
alias AS (SELECT pk.crawl_run_id, pk.id AS alias_id, pk.url_k AS key, f.page_id, f.status, f.status_code, pk.url FROM pk JOIN first f ON f.crawl_run_id = pk.crawl_run_id AND f.key = pk.final_k WHERE pk.status = 'skipped' AND f.status = 'fetched'),
hop0 AS (SELECT crawl_run_id, id, url, status, status_code, unnest(CASE WHEN k % 17 = 6 THEN [{HOPS[0]}, {HOPS[1]}] WHEN k % 17 = 7 THEN [{HOPS[0]}] ELSE [] END) AS key FROM pk),
hop AS (SELECT h.crawl_run_id, h.key, coalesce(a.page_id, h.id) AS page_id, CASE WHEN a.page_id IS NULL THEN h.status ELSE a.status END AS status, CASE WHEN a.page_id IS NULL THEN h.status_code ELSE a.status_code END AS status_code, h.url, 0 AS level
  FROM hop0 h LEFT JOIN alias a ON a.crawl_run_id = h.crawl_run_id AND a.alias_id = h.id QUALIFY row_number() OVER (PARTITION BY h.crawl_run_id, h.key ORDER BY h.url) = 1),
every AS (SELECT crawl_run_id, key, page_id, status, status_code, url, level FROM own1 UNION ALL SELECT crawl_run_id, key, page_id, status, status_code, url, 3 FROM alias UNION ALL SELECT * FROM hop),
resolved AS (SELECT crawl_run_id, key, page_id, status, status_code FROM every QUALIFY row_number() OVER (PARTITION BY crawl_run_id, key ORDER BY level DESC, url DESC, page_id DESC) = 1),
alllinks AS (SELECT crawl_run_id, id AS page_id, status, unnest(list_filter([{", ".join(f"CASE WHEN {test} THEN {url} END" for test, url in LINKS)}], lambda x: x IS NOT NULL)) AS link FROM pk),
links AS (SELECT DISTINCT crawl_run_id, page_id AS source_id, link, {_norm("link")} AS key FROM alllinks WHERE status = 'fetched'),
edges AS (SELECT DISTINCT l.crawl_run_id, source_id, r.page_id AS target_id FROM links l JOIN resolved r USING (crawl_run_id, key) WHERE source_id <> r.page_id),
incoming AS (SELECT crawl_run_id, target_id AS page_id, count(*) AS incoming FROM edges GROUP BY ALL),
broken AS (SELECT l.crawl_run_id, source_id AS page_id, list_sort(list(status_code || ' ' || link) FILTER (status_code IN (404, 410))) AS broken, bool_or(NOT coalesce(status_code BETWEEN 200 AND 299, false)) AS unknown
  FROM links l LEFT JOIN resolved r USING (crawl_run_id, key) GROUP BY ALL),
target AS (SELECT c.crawl_run_id, c.id AS page_id, CASE WHEN canonical_k = page_k THEN c.id ELSE r.page_id END AS target_id, CASE WHEN canonical_k = page_k THEN c.status ELSE r.status END AS target_status
  FROM pk c LEFT JOIN resolved r ON r.crawl_run_id = c.crawl_run_id AND r.key = c.canonical_k WHERE canonical_url <> '')"""

RESOLVED = f"WITH {_GRAPH} SELECT * FROM resolved"
EDGES = f"WITH {_GRAPH} SELECT * FROM edges"
INCOMING = f"WITH {_GRAPH} SELECT * FROM incoming"
_PATH = "regexp_extract(page_url, '^https?://[^/?#]+([^?#]*)', 1)"
ORPHANS = f"WITH {_GRAPH} SELECT crawl_run_id, id AS page_id FROM pk WHERE status = 'fetched' AND {_PATH} NOT IN ('', '/') AND NOT EXISTS (FROM edges e WHERE e.crawl_run_id = pk.crawl_run_id AND e.target_id = pk.id)"
BROKEN = f"WITH {_GRAPH} SELECT crawl_run_id, page_id, array_to_string(coalesce(broken, []), ' | ') AS broken, unknown FROM broken"
TARGETS = f"WITH {_GRAPH} SELECT * FROM target"
_ALLOWED = f"NOT starts_with({{path}}, '/faq') OR starts_with({{path}}, '/faq/q2')"
_URL_PATH = "regexp_extract(url, '^https?://[^/?#]+([^#]*)', 1)"
ROBOTS = f"""WITH {_PAGES} SELECT crawl_run_id, id AS page_id, agent, CASE agent WHEN 'gptbot' THEN false ELSE {_ALLOWED.format(path=_URL_PATH)} END AS allowed
FROM pk, (VALUES ('anybot'), ('gptbot')) a(agent) WHERE starts_with(url, 'https:') AND k % {CRAWLS} < 4"""
COUNTERS = f"""WITH {_PAGES} SELECT crawl_run_id, 10 AS discovered, count(*) AS processed, count(*) FILTER (status = 'fetched') AS fetched, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'skipped') AS skipped FROM pk GROUP BY ALL"""
INVENTORY = f"WITH {_PAGES} SELECT crawl_run_id, id, url, title FROM pk WHERE status = 'fetched' AND k % {CRAWLS} < 3 AND contains(lower(url || ' ' || coalesce(title, '')), 'shared')"

_TITLE_K, _DESCRIPTION_K = (f"lower(trim(regexp_replace({c}, '\\s+', ' ', 'g')))" for c in ("title", "meta_description"))
_DUPLICATE = "SELECT crawl_run_id, id AS page_id FROM f WHERE {key} <> '' QUALIFY count(*) OVER (PARTITION BY crawl_run_id, {key}) > 1"
_FINDING = "CASE WHEN coalesce({}, false) THEN 'finding' ELSE 'passed' END"
_NOINDEX = "k % 12 IN (0, 1)"
_TYPE = {"Organization": "k % 10 IN (2, 5, 8)", "Product": "k % 10 IN (3, 9)", "FAQPage": "k % 10 IN (4, 5, 7)", "BreadcrumbList": "k % 10 IN (6, 9)"}
_OPTIONAL = lambda relevant, type_: f"CASE WHEN NOT ({relevant}) THEN 'not_applicable' ELSE {_FINDING.format('NOT ' + _TYPE[type_])} END"
_DATES = f"""k % 5 = 0 OR k % 5 = 1 OR (k % 5 > 1 AND k % 3 = 0)"""
#: Rules: scope, and outcome behind it.
_RULES = {
    "http-status": ("page", _FINDING.format("status = 'failed'")),
    "redirect-chain": ("page", _FINDING.format("k % 17 = 6")),
    "https": ("html", _FINDING.format("starts_with(page_url, 'http:')")),
    "canonical-missing": ("html", _FINDING.format("k % 8 IN (0, 2)")),
    "canonical-invalid": ("signals", _FINDING.format("k % 8 IN (0, 2, 3)")),
    "canonical-mismatch": ("html", _FINDING.format("canonical_k <> page_k")),
    "indexability": ("html", _FINDING.format(_NOINDEX)),
    "canonical-noindex": ("html", f"CASE WHEN k % 8 IN (0, 2) THEN 'not_applicable' WHEN coalesce(target_status, '') <> 'fetched' THEN 'unavailable' ELSE {_FINDING.format('target_id::BIGINT % 12 IN (0, 1)')} END"),
    "robots-access": ("page", f"CASE WHEN NOT starts_with(url, 'https:') OR k % {CRAWLS} >= 4 THEN 'unavailable' ELSE {_FINDING.format(f'NOT ({_ALLOWED.format(path=_URL_PATH)})')} END"),
    "sitemap-inclusion": ("html", f"CASE WHEN k % {CRAWLS} >= 2 THEN 'unavailable' ELSE {_FINDING.format('k % 3 <> 0 AND NOT in_discovery')} END"),
    "title-missing": ("html", _FINDING.format("k % 9 IN (0, 1)")),
    "title-duplicate": ("html", _FINDING.format("(crawl_run_id, id) IN (SELECT (crawl_run_id, page_id) FROM same_title)")),
    "title-length": ("html", _FINDING.format("title <> '' AND NOT length(title) BETWEEN 15 AND 65")),
    "description-missing": ("html", _FINDING.format("k % 10 IN (0, 2)")),
    "description-duplicate": ("html", _FINDING.format("(crawl_run_id, id) IN (SELECT (crawl_run_id, page_id) FROM same_description)")),
    "h1-count": ("html", _FINDING.format("k % 6 NOT IN (1, 2, 5)")),
    "heading-order": ("html", _FINDING.format("k % 6 IN (2, 5)")),
    "word-count": ("html", _FINDING.format("word_count < 100")),
    "internal-links": ("html", _FINDING.format("k % 10 = 9")),
    "potential-orphan": ("html", f"CASE WHEN {_PATH} IN ('', '/') THEN 'not_applicable' ELSE {_FINDING.format('coalesce(incoming, 0) = 0')} END"),
    "broken-internal-links": ("html", "CASE WHEN len(broken) > 0 THEN 'finding' WHEN unknown THEN 'unavailable' WHEN k % 10 = 9 THEN 'not_applicable' ELSE 'passed' END"),
    "jsonld-missing": ("html", _FINDING.format("k % 10 = 0")),
    "jsonld-parse": ("html", _FINDING.format("k % 10 IN (1, 8)")),
    "organization-schema": ("signals", _OPTIONAL("kind = 'home'", "Organization")),
    "product-schema": ("signals", _OPTIONAL("kind = 'product'", "Product")),
    "faq-schema": ("signals", _OPTIONAL("kind = 'faq'", "FAQPage")),
    "faq-visible-match": ("html", f"CASE WHEN NOT ({_TYPE['FAQPage']}) THEN 'not_applicable' WHEN k % 10 = 7 THEN 'unavailable' ELSE {_FINDING.format(f'NOT CASE k % 10 WHEN 4 THEN {_FAQ_FOUND} ELSE {_FAQ_OTHER} END')} END"),
    "breadcrumb-schema": ("html", _OPTIONAL(f"len(list_filter(string_split({_PATH}, '/'), lambda x: x <> '')) >= 2", "BreadcrumbList")),
    "editorial-author": ("signals", f"CASE WHEN kind <> 'editorial' THEN 'not_applicable' ELSE {_FINDING.format('k % 4 = 0')} END"),
    "editorial-dates": ("signals", f"CASE WHEN kind <> 'editorial' THEN 'not_applicable' ELSE {_FINDING.format(_DATES)} END"),
    "javascript-content": ("signals", _FINDING.format("word_count < 100 AND (k % 3 > 0 OR k % 20 = 7)")),
    "content-duplicate": ("html", _FINDING.format("t <> '' AND (crawl_run_id, id) IN (SELECT (crawl_run_id, page_id) FROM same_text)")),
    "content-near-duplicate": ("html", f"CASE WHEN n_words < 100 THEN 'not_applicable' ELSE {_FINDING.format('(crawl_run_id, id) IN (SELECT (crawl_run_id, page_id) FROM alike)')} END"),
}
_SCOPE = {"page": "{}", "html": "CASE WHEN status <> 'fetched' THEN 'unavailable' ELSE {} END", "signals": "CASE WHEN status <> 'fetched' OR NOT has_signals THEN 'unavailable' ELSE {} END"}
_LLMS = " ".join(f"WHEN {n} THEN '{'unavailable' if not v or v[2] or v[3] else 'not_applicable' if v[0] != 200 else 'passed' if '[docs]' in v[1] else 'finding'}'" for n, v in LLMS.items())
_SITE = f"""SELECT 'c' || c AS crawl_run_id, NULL::VARCHAR AS page_id, {site("c")} AS url, unnest(['company-identity', 'contact-information', 'llms-presence', 'llms-syntax', 'ai-robots']) AS rule_id, unnest([
  CASE WHEN known = 0 THEN 'unavailable' WHEN identity THEN 'passed' ELSE 'finding' END, CASE WHEN known = 0 THEN 'unavailable' WHEN contact THEN 'passed' ELSE 'finding' END,
  CASE WHEN c IN (0, 5) THEN 'unavailable' ELSE 'finding' END, CASE c {_LLMS} ELSE 'unavailable' END, CASE WHEN c < 4 THEN 'finding' ELSE 'unavailable' END]) AS outcome
  FROM (SELECT k % {CRAWLS} AS c, count(*) FILTER (status = 'fetched' AND has_signals) AS known, bool_or(status = 'fetched' AND has_signals AND k % {CRAWLS} IN (2, 3)) AS identity, bool_or(status = 'fetched' AND has_signals AND k % {CRAWLS} = 1 AND k % 4 = 1) AS contact FROM pk GROUP BY 1)"""
_OUTCOMES = rf"""{_GRAPH},
f AS (SELECT *, {_TITLE_K} AS title_k, {_DESCRIPTION_K} AS description_k FROM pk WHERE status = 'fetched'),
same_title AS ({_DUPLICATE.format(key="title_k")}), same_description AS ({_DUPLICATE.format(key="description_k")}), same_text AS ({_DUPLICATE.format(key="text_hash")}),
w AS (SELECT crawl_run_id, id AS page_id, text_hash, (regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}]+'))[1:5000] AS w FROM f),
s AS (SELECT crawl_run_id, page_id, text_hash, list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM w WHERE len(w) >= 100),
e AS (SELECT crawl_run_id, page_id, text_hash, len(s) AS n, unnest(s) AS s FROM s),
pair AS (SELECT a.crawl_run_id, a.page_id AS a, b.page_id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM e a JOIN e b ON a.crawl_run_id = b.crawl_run_id AND a.s = b.s AND a.text_hash <> b.text_hash GROUP BY ALL),
alike AS (SELECT DISTINCT crawl_run_id, a AS page_id FROM pair WHERE least(na, nb) >= 0.85 * greatest(na, nb) AND c / (na + nb - c) >= 0.85),
j AS (SELECT pk.*, incoming, broken, unknown, target_id, target_status, len(w.w) AS n_words, k % {CRAWLS} = 1 AND page_k IN ({_norm(url_of("8"))}, {_norm(url_of("22"))}) AS in_discovery
  FROM pk LEFT JOIN incoming i ON i.crawl_run_id = pk.crawl_run_id AND i.page_id = pk.id LEFT JOIN broken b ON b.crawl_run_id = pk.crawl_run_id AND b.page_id = pk.id
  LEFT JOIN target ON target.crawl_run_id = pk.crawl_run_id AND target.page_id = pk.id LEFT JOIN w ON w.crawl_run_id = pk.crawl_run_id AND w.page_id = pk.id),
page_outcomes AS ({" UNION ALL ".join(f"SELECT crawl_run_id, id AS page_id, page_url AS url, '{rule}' AS rule_id, {_SCOPE[scope].format(outcome)} AS outcome FROM j" for rule, (scope, outcome) in _RULES.items())}),
site_outcomes AS ({_SITE}),
outcomes AS (SELECT * FROM page_outcomes UNION ALL SELECT * FROM site_outcomes)"""
PAGE_RULES = f"WITH {_OUTCOMES} SELECT * FROM page_outcomes"
SITE_RULES = f"WITH {_OUTCOMES} SELECT * FROM site_outcomes"
_KINDS = """kinds AS (SELECT rule_id, CASE WHEN rule_id IN ('http-status', 'broken-internal-links', 'jsonld-parse') THEN 'error' WHEN rule_id IN ('redirect-chain', 'https', 'canonical-missing', 'canonical-invalid', 'canonical-noindex', 'title-missing', 'title-duplicate',
  'description-missing', 'description-duplicate', 'faq-visible-match') THEN 'warning' ELSE 'observation' END AS severity,
  CASE WHEN rule_id IN ('http-status', 'redirect-chain', 'https', 'robots-access') THEN 'Access' WHEN rule_id IN ('indexability') OR starts_with(rule_id, 'canonical') THEN 'Indexability' WHEN rule_id = 'sitemap-inclusion' THEN 'Discovery'
  WHEN rule_id IN ('internal-links', 'potential-orphan', 'broken-internal-links') THEN 'Links' WHEN starts_with(rule_id, 'jsonld') OR starts_with(rule_id, 'faq') OR ends_with(rule_id, '-schema') THEN 'Structured data'
  WHEN starts_with(rule_id, 'editorial') OR rule_id IN ('company-identity', 'contact-information') THEN 'Trust signals' WHEN starts_with(rule_id, 'llms') OR rule_id = 'ai-robots' THEN 'AI conventions' ELSE 'Content' END AS category
  FROM (SELECT DISTINCT rule_id FROM outcomes))"""
COVERAGE = f"""WITH {_OUTCOMES}, {_KINDS}
SELECT crawl_run_id, rule_id, severity, category, count(*) FILTER (outcome IN ('finding', 'passed')) AS evaluated, count(*) FILTER (outcome = 'passed') AS passed, count(*) FILTER (outcome = 'finding') AS findings,
  count(*) FILTER (outcome = 'not_applicable') AS not_applicable, count(*) FILTER (outcome = 'unavailable') AS unavailable FROM outcomes JOIN kinds USING (rule_id) GROUP BY ALL"""
FINDINGS = f"WITH {_OUTCOMES}, {_KINDS} SELECT crawl_run_id, page_id, rule_id, severity, category, url FROM outcomes JOIN kinds USING (rule_id) WHERE outcome = 'finding'"
RUNS = f"""WITH {_PAGES}, c AS (SELECT k % {CRAWLS} AS c, count(*) FILTER (status = 'fetched') AS pages_analyzed, bool_or(status = 'fetched' AND NOT has_signals) AS old FROM pk GROUP BY 1)
SELECT 'c' || c AS crawl_run_id, 'technical-1.0.0' AS rule_version, pages_analyzed, len(list_distinct(CASE WHEN c = 2 THEN ['slow'] ELSE [] END)) + (c = 4)::INT + (c IN (3, 6))::INT + (old OR c = 5)::INT + (c = 4)::INT AS n_warnings FROM c WHERE c <> 0"""
