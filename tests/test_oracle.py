"""Every registered query with SQL gives the same rows in DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from sightline.plans import catalog

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{files}')")
    return con


def plain(value):
    return round(float(value), 7) if type(value).__name__ in ("float", "Decimal") else value


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_same_rows(spark, duck, name):
    got = catalog.QUERIES[name](spark, FOLDER)
    columns = sorted(got.columns)
    want = duck.sql(catalog.ORACLE[name])
    assert sorted(want.columns) == columns
    order = lambda rows: sorted(rows, key=lambda r: [(v is None, str(v)) for v in r])
    a = order(tuple(plain(r[c]) for c in columns) for r in got.collect())
    b = order(tuple(plain(dict(zip(want.columns, r, strict=True))[c]) for c in columns) for r in want.fetchall())
    assert a == b


# Queries over raw HTML, which SQL can't parse, against plain versions of what they do.


@pytest.fixture(scope="module")
def pages(duck):
    from sightline.sources.pages import extract

    return {i: (url, extract(html, url, url)) for i, url, html in duck.sql("SELECT page_id::VARCHAR, url, html FROM pages").fetchall()}


def host(url: str) -> str:
    return url.split("://", 1)[1].split("/")[0].split("?")[0].split("#")[0]


def test_extracted_pages(spark, pages):
    got = {r.id: (r.crawl_run_id, r.title, r.word_count, r.language, r.text_hash, r.internal_links) for r in catalog.QUERIES["extracted_pages"](spark, FOLDER).collect()}
    assert got == {i: (host(u), p["title"], p["word_count"], p["language"], p["text_hash"], len(p["internal_links"])) for i, (u, p) in pages.items()}
    assert sum(g[2] > 20 and g[5] > 0 for g in got.values()) > len(got) / 2


def test_link_graph(spark, pages):
    from sightline.functions.urls import canonical

    at = {}
    for i, (url, _) in sorted(pages.items(), key=lambda x: x[1][0]):
        at[host(url), canonical(url)] = i
    want = {(host(u), i, at[host(u), link]) for i, (u, p) in pages.items() for link in p["internal_links"] if (host(u), link) in at and at[host(u), link] != i}
    assert {tuple(r) for r in catalog.QUERIES["link_graph"](spark, FOLDER).select("crawl_run_id", "source_id", "target_id").collect()} == want


def test_audit_of_raw_pages(spark, pages):
    from collections import Counter

    crawls = Counter(host(u) for u, _ in pages.values())
    rows = catalog.QUERIES["audit_coverage"](spark, FOLDER).collect()
    assert len(rows) == 38 * len(crawls)
    for r in rows:
        assert r.evaluated == r.passed + r.findings and r.evaluated + r.not_applicable + r.unavailable == (1 if r.scope == "site" else crawls[r.crawl_run_id])
    found = Counter((r.crawl_run_id, r.rule_id) for r in catalog.QUERIES["audit_findings"](spark, FOLDER).collect())
    assert found == {(r.crawl_run_id, r.rule_id): r.findings for r in rows if r.findings}
    few = Counter(host(u) for u, p in pages.values() if p["word_count"] < 100)
    assert {c: n for (c, rule), n in found.items() if rule == "word-count"} == few


def test_readiness_and_fetches_of_raw_pages(spark, pages):
    got = {r.page_id: r for r in catalog.QUERIES["page_readiness"](spark, FOLDER).collect()}
    assert set(got) <= set(pages) and all(pages[i][1]["visible_text"].strip() for i in got)
    for i, r in got.items():
        assert r.technical in (2, 4, 6, 8, 10) and (r.entity > 0) >= ("the" in pages[i][1]["technical_signals"]["main_text"].lower()) and r.evaluated_weight in (55, 60)
    states = {r.seq: (r.status, r.error) for r in catalog.QUERIES["fetch_states"](spark, FOLDER).collect()}
    for i, (status, error) in states.items():
        assert status == ("skipped" if i % 7 == 0 else "failed" if i % 11 == 0 else status) and (error == "Already fetched" or status != "skipped" or i % 7 == 0)
    assert sorted(states) == sorted(map(int, pages))
    assert set(catalog.QUERIES) - set(catalog.ORACLE) == {"link_graph", "audit_coverage", "audit_findings", "page_readiness", "fetch_states"}
