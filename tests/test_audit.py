"""Audit rules on small crawls: outcomes, link graph, duplicates, robots, coverage."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sightline.operators import audit as A
from sightline.operators import duplicates as D
from sightline.operators import links as L
from sightline.sources.pages import parse_robots

SIGNALS = "struct<page_kind:string,canonical_candidates:array<struct<raw:string,url:string>>,authors:array<string>,published_dates:array<string>,modified_dates:array<string>,contact_signals:array<string>,identity_signals:array<string>,script_count:int,javascript_notice:string,main_text:string>"
PAGES = (
    "id string, crawl_run_id string, brand_id string, url string, final_url string, canonical_url string, status string, status_code int, title string, meta_description string, headings array<struct<level:int,text:string>>, visible_text string, text_hash string, "
    f"word_count int, internal_links array<string>, external_links array<string>, structured_data array<struct<valid:boolean,value:string,error:string>>, robots_directives array<string>, redirects array<struct<url:string,status:int,destination:string>>, in_sitemap boolean, error string, technical_signals {SIGNALS}"
)
CRAWLS = (
    "id string, brand_id string, status string, pages_discovered int, pages_processed int, discovery struct<origin:string,sitemap_urls:array<string>,page_urls:array<string>,warnings:array<string>,truncated:boolean>, "
    "site_signals struct<robots:array<struct<origin:string,url:string,status:int,text:string>>,llms:struct<url:string,status:int,text:string,truncated:boolean,error:string>>"
)
SITE = "https://a.com"


def signals(**over):
    return {"page_kind": "other", "canonical_candidates": [], "authors": [], "published_dates": [], "modified_dates": [], "contact_signals": [], "identity_signals": [], "script_count": 0, "javascript_notice": None, "main_text": ""} | over


def page(id, path="/", **over):
    return {
        "id": id, "crawl_run_id": "c1", "brand_id": "b1", "url": SITE + path, "final_url": SITE + path, "canonical_url": SITE + path, "status": "fetched", "status_code": 200, "title": f"A title for page {id} here", "meta_description": f"About {id}", "headings": [(1, "h")],
        "visible_text": f"text {id}", "text_hash": f"h{id}", "word_count": 200, "internal_links": [], "external_links": [], "structured_data": [], "robots_directives": [], "redirects": [], "in_sitemap": False, "error": None, "technical_signals": signals(),
    } | over


def crawl(id="c1", brand="b1", **over):
    return {"id": id, "brand_id": brand, "status": "completed", "pages_discovered": 1, "pages_processed": 1, "discovery": {"origin": SITE, "sitemap_urls": [], "page_urls": [], "warnings": [], "truncated": False}, "site_signals": None} | over


@pytest.fixture(scope="module")
def run(spark):
    def outcomes(*pages, crawls=None, robots=None):
        c = spark.createDataFrame(crawls or [crawl()], CRAWLS)
        p = spark.createDataFrame(list(pages), PAGES)
        r = parse_robots(spark.createDataFrame(robots, "crawl_run_id string, origin string, text string")) if robots else None
        rows = A.page_outcomes(c, p, r, "examplebot").unionByName(A.site_outcomes(c, p, r)).collect()
        return {(r.page_id, r.rule_id): r.outcome for r in rows}

    return outcomes


def test_row_rules(run):
    got = run(
        page("1", canonical_url=None, title=" ", meta_description=None, headings=[(1, "a"), (3, "b"), (1, "c")], word_count=20, technical_signals=signals(script_count=2, canonical_candidates=[("", None)])),
        page("2", "/x", status="failed", status_code=410, technical_signals=None, error=None),
        page("3", "/y", technical_signals=None, final_url="http://a.com/y", redirects=[("u", 301, "v"), ("v", 302, "w")], robots_directives=["googlebot: NONE"], title="short"),
        page("4", "/z/w", structured_data=[(False, "{", "bad")], canonical_url=SITE + "/other"),
    )
    for rule in ("canonical-missing", "canonical-invalid", "title-missing", "description-missing", "h1-count", "heading-order", "word-count", "javascript-content", "internal-links", "jsonld-missing"):
        assert got["1", rule] == "finding", rule
    assert got["1", "canonical-noindex"] == "not_applicable" and got["1", "title-length"] == "finding" and got["1", "sitemap-inclusion"] == "unavailable"
    assert got["2", "http-status"] == "finding" and got["2", "title-missing"] == "unavailable" and got["2", "redirect-chain"] == "passed" and got["2", "robots-access"] == "unavailable"
    assert got["3", "https"] == "finding" and got["3", "redirect-chain"] == "finding" and got["3", "indexability"] == "finding" and got["3", "canonical-invalid"] == "unavailable" and got["3", "title-length"] == "finding"
    assert got["4", "jsonld-parse"] == "finding" and got["4", "jsonld-missing"] == "passed" and got["4", "canonical-mismatch"] == "finding" and got["4", "breadcrumb-schema"] == "finding" and got["1", "breadcrumb-schema"] == "not_applicable"
    assert got["4", "canonical-noindex"] == "unavailable"


def test_every_rule_has_an_outcome(run):
    got = run(page("1"))
    assert {r for _, r in got} == {r for r, *_ in A.RULES} and len(A.RULES) == 38 and set(got.values()) <= {"finding", "passed", "unavailable", "not_applicable"}


def test_broken_links_need_the_same_crawl_and_brand(run):
    gone = dict(status="failed", status_code=404, technical_signals=None)
    got = run(page("1", internal_links=[SITE + "/gone"]), page("2", "/gone", crawl_run_id="c2", brand_id="b2", **gone), crawls=[crawl(), crawl("c2", "b2")])
    assert got["1", "broken-internal-links"] == "unavailable"
    got = run(page("1", internal_links=[SITE + "/gone#x", SITE + "/slow"]), page("2", "/gone", **gone), page("3", "/slow", status="failed", status_code=None, technical_signals=None))
    assert got["1", "broken-internal-links"] == "finding"
    got = run(page("1", internal_links=[SITE + "/slow"]), page("3", "/slow", status="failed", status_code=None, technical_signals=None))
    assert got["1", "broken-internal-links"] == "unavailable"
    assert run(page("1"))["1", "broken-internal-links"] == "not_applicable"


def test_aliases_give_incoming_links(run):
    got = run(page("1", internal_links=[SITE + "/old"]), page("2", "/new"), page("3", "/old", status="skipped", final_url=SITE + "/new", technical_signals=None), page("4", "/lonely"))
    assert got["2", "potential-orphan"] == "passed" and got["4", "potential-orphan"] == "finding" and got["1", "potential-orphan"] == "not_applicable"
    got = run(page("1", internal_links=[SITE + "/hop"]), page("2", "/end", redirects=[(SITE + "/hop", 301, SITE + "/end")]))
    assert got["2", "potential-orphan"] == "passed"


def test_fetched_wins_and_self_links_dont_count(spark):
    pages = L.keyed_pages(spark.createDataFrame([page("1", "/a", status="failed"), page("2", "/b", final_url=SITE + "/a", internal_links=[SITE + "/a", SITE + "/a/"])], PAGES))
    resolved = {r.key: r.page_id for r in L.resolve_links(pages).collect()}
    assert resolved == {SITE + "/a": "2", SITE + "/b": "2"}
    assert L.link_edges(L.page_links(pages), L.resolve_links(pages)).count() == 0


def test_canonical_target_noindex(run):
    got = run(page("1", canonical_url=SITE + "/t"), page("2", "/t", robots_directives=["robots: noindex, follow"]), page("3", "/u"))
    assert got["1", "canonical-noindex"] == "finding" and got["2", "canonical-noindex"] == "finding" and got["3", "canonical-noindex"] == "passed"


def test_robots(run):
    text = "User-agent: *\nDisallow: /private\nAllow: /private/open\n\nUser-agent: ExampleBot\nUser-agent: GPTBot\nDisallow: /bot*end$\nDisallow:\n"
    robots = [("c1", SITE, text)]
    got = run(page("1", "/private/x"), page("2", "/bot/the-end"), crawls=[crawl()], robots=robots)
    assert got["1", "robots-access"] == "passed" and got["2", "robots-access"] == "finding" and got[None, "ai-robots"] == "finding"
    assert run(page("1", url="https://other.com/"), robots=robots)["1", "robots-access"] == "unavailable"


def test_robots_longest_rule(spark):
    rules = parse_robots(spark.createDataFrame([("c", "o", "User-agent: *\nDisallow: /private\nAllow: /private/open\n")], "crawl_run_id string, origin string, text string"))
    paths = spark.createDataFrame([("c", "o", "/private/x"), ("c", "o", "/private/open/y"), ("c", "o", "/")], "crawl_run_id string, origin string, path string")
    got = {r.path: r.allowed for r in L.robots_verdicts(paths, rules, ["any"]).collect()}
    assert got == {"/private/x": False, "/private/open/y": True, "/": True}


def test_structured_data(run):
    faq = {"@graph": [{"@type": "FAQPage", "mainEntity": [{"@id": "#q"}]}, {"@id": "#q", "name": "What is &amp;?", "acceptedAnswer": {"text": "<b>An</b> answer"}}, {"@type": ["https://schema.org/Organization"], "name": "A"}]}
    block = [(True, json.dumps(faq), None)]
    got = run(page("1", structured_data=block, visible_text="So: what is &? An  answer!", technical_signals=signals(page_kind="home")), page("2", "/faq", structured_data=block, technical_signals=signals(page_kind="faq")), page("3", "/products/x", technical_signals=signals(page_kind="product")))
    assert got["1", "faq-visible-match"] == "passed" and got["1", "organization-schema"] == "passed" and got["2", "faq-visible-match"] == "finding" and got["2", "faq-schema"] == "passed"
    assert got["3", "product-schema"] == "finding" and got["3", "faq-visible-match"] == "not_applicable" and got["3", "organization-schema"] == "not_applicable"


def test_editorial(run):
    kind = lambda **o: signals(page_kind="editorial", **o)
    got = run(
        page("1", "/blog/a", technical_signals=kind(authors=["x"], published_dates=["2024-01-02"], modified_dates=["2024-02-01"])), page("2", "/blog/b", technical_signals=kind(published_dates=["2024-01-02"], modified_dates=["2023-02-01"])),
        page("3", "/blog/c", technical_signals=kind(published_dates=["soon"])), page("4", "/d"))
    assert [got[k, "editorial-dates"] for k in "1234"] == ["passed", "finding", "finding", "not_applicable"]
    assert [got[k, "editorial-author"] for k in "1234"] == ["passed", "finding", "finding", "not_applicable"]


def words(n, start=0):
    return " ".join(f"word{k}" for k in range(start, start + n))


def test_duplicates(run, spark):
    near = words(160).replace("word80", "other")
    got = run(page("1", title="Same  TITLE of a page", text_hash="x", visible_text=words(160)), page("2", "/b", title="same title of a page", text_hash="x", visible_text=words(160)), page("3", "/c", visible_text=near, text_hash="y"), page("4", "/d", visible_text=words(50), title="Another title of a page"))
    assert got["1", "title-duplicate"] == got["2", "title-duplicate"] == "finding" and got["4", "title-duplicate"] == "passed"
    assert got["1", "content-duplicate"] == "finding" and got["3", "content-duplicate"] == "passed"
    assert got["3", "content-near-duplicate"] == "finding" and got["4", "content-near-duplicate"] == "not_applicable"


def test_near_duplicates_against_all_pairs(spark):
    draw = random.Random(1)
    base = words(150).split()
    rows = []
    for k in range(40):
        text = list(base) if k % 2 else words(150, 200 * k).split()
        for i in draw.sample(range(150), k // 8):
            text[i] = f"x{draw.randint(0, 9)}"
        rows.append(("c", k, " ".join(text[: 150 - k % 5])))
    df = spark.createDataFrame(rows, "crawl_run_id string, id long, t string")
    got = {(r.a, r.b): round(r.score, 9) for r in D.near_duplicates(df, F.col("t"), F.sha2("t", 256)).collect()}
    sets = {k: frozenset(tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)) for _, k, t in rows}
    first = {k: min(j for j in sets if rows[j][2] == rows[k][2]) for k in sets}  # a text's smallest id stands for it
    want = {(a, b): round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 9) for a in sets for b in sets if a < b and first[a] == a and first[b] == b and len(sets[a] & sets[b]) >= 0.85 * len(sets[a] | sets[b])}
    assert got == want and len(want) > 10


def brute_classes(sets: dict, alike: float = 0.85) -> dict:
    """Each linked set's class: the smallest key that links reach."""
    at = {k: k for k in sets}

    def top(k):
        while at[k] != k:
            k = at[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= alike * len(sets[a] | sets[b]):
                low, high = sorted((top(a), top(b)))
                at[high] = low
    number = Counter(map(top, sets))
    return {k: top(k) for k in sets if number[top(k)] > 1}


@pytest.mark.parametrize("few", [64, 3])
def test_near_duplicate_classes_against_all_pairs(spark, monkeypatch, few):
    """Groups of copies, a chain of slices whose ends are unlike, and a template that isn't enough to link; few: rounds before the pairs."""
    monkeypatch.setattr(D, "FEW", few)
    draw, rows = random.Random(3), []
    base, template = words(150).split(), words(110, 9000).split()
    for k in range(25):
        text = list(base)
        text[draw.randrange(150)] = f"x{k}"
        rows += [("c", len(rows), " ".join(text))] * (1 + (k == 4))
        rows.append(("c", 1000 + k, words(300, 5000 + 6 * k)))
        rows.append((("c", "d")[k % 2], 2000 + k, " ".join(template) + " " + words(60, 20_000 + 100 * k)))
    rows = [(c, k, t) for k, (c, _, t) in enumerate(rows)] + [("c", 500, "too short"), ("c", 501, "too short to tell"), ("c", 502, None)]
    df = spark.createDataFrame(rows, "crawl_run_id string, id long, t string")
    got = {(r.crawl_run_id, r.id): (r["first"], r["class"], r.texts, r.pages) for r in D.near_duplicate_classes(df, F.col("t"), F.sha2("t", 256)).collect()}
    want = {}
    for crawl in "cd":
        texts = {k: t for c, k, t in rows if c == crawl and t}
        first = {k: min(j for j in texts if texts[j] == t) for k, t in texts.items()}
        sets = {k: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for k, t in texts.items() if first[k] == k and len(t.split()) >= 100}
        classes = brute_classes(sets)
        for k, f in first.items():
            if f in classes:
                own = [j for j in classes if classes[j] == classes[f]]
                want[crawl, k] = (f, classes[f], len(own), sum(first[j] in own for j in texts))
    assert got == want and {v[2] for v in want.values()} >= {25}


def test_many_near_copies_give_a_row_each(spark):
    """One word of each page differs: 1,200 pages would be 719,400 pairs."""
    n = 1200
    rows = [("c", k, " ".join([*words(100).split(), f"only{k}", *words(100, 200).split()])) for k in range(n)]
    df = spark.createDataFrame(rows, "crawl_run_id string, id long, t string")
    got = D.near_duplicate_classes(df, F.col("t"), F.sha2("t", 256)).collect()
    assert len(got) == n and {(r["class"], r.texts, r.pages) for r in got} == {(0, n, n)}


def test_filters_keep_similar_sets(spark):
    """Size, place and sketch filters pass every pair that is alike enough."""
    draw, rows = random.Random(8), []
    for k in range(60):
        size = draw.randint(20, 400)
        own = draw.sample(range(-(10**18), 10**18), size)
        other = own[: int(size * draw.uniform(0.8, 1.0))] + draw.sample(range(10**17), draw.randint(0, size // 10))
        rows += [("c", 2 * k, own), ("c", 2 * k + 1, other)]
    sets = spark.createDataFrame(rows, "crawl_run_id string, id long, shingles array<long>")
    got = {(r["class"], r.id) for r in D.spanning_links(sets).collect()}
    want = {(2 * k, i) for k in range(60) if len(set(rows[2 * k][2]) & set(rows[2 * k + 1][2])) >= 0.85 * len(set(rows[2 * k][2]) | set(rows[2 * k + 1][2])) for i in (2 * k, 2 * k + 1)}
    assert got == want and len(want) > 20


def plain_map(pages: list[tuple]) -> dict:
    """What each URL stands for, page by page in order of URL. pages: id, url, final, status, hops."""
    at, pages = {}, sorted(pages, key=lambda p: (p[1], p[0]))
    for p in sorted(pages, key=lambda p: p[3] == "fetched"):
        at[p[1]] = p
        if p[2]:
            at[p[2]] = p
    for p in pages:
        end = at.get(p[2]) if p[2] else None
        target = end if p[3] == "skipped" and end and end[3] == "fetched" else p
        if target is not p:
            at[p[1]] = target
        for hop in p[4]:
            at.setdefault(hop, target)
    return {url: p[0] for url, p in at.items()}


def test_chains_of_aliases(spark):
    """Aliases of aliases, of hops and of nothing, some of which come before what they need, against the map made page by page."""
    draw, home = random.Random(12), "https://a.com"
    tables = [[(f"{k:03}", f"{home}/u{k:03}", f"{home}/u{k - 1:03}" if k else f"{home}/u000", "skipped" if k else "fetched", []) for k in range(40)]]
    for _ in range(12):
        url = lambda: f"{home}/u{draw.randint(0, 30):03}"
        own = draw.sample(range(25), 18)
        tables.append([(str(k), f"{home}/u{k:03}", draw.choice([None, url(), url(), url()]), draw.choice(["fetched", "skipped", "skipped", "skipped", "failed"]), [url() for _ in range(draw.randint(0, 2))]) for k in own])
    rows = [(f"c{n}", i, u, f or None, s, 200 if s == "fetched" else None, None, [(h, 301, "x") for h in hops]) for n, table in enumerate(tables) for i, u, f, s, hops in table]
    df = spark.createDataFrame(rows, "crawl_run_id string, id string, url string, final_url string, status string, status_code int, canonical_url string, redirects array<struct<url:string,status:int,destination:string>>")
    got = {}
    for r in L.resolve_links(L.keyed_pages(df)).collect():
        got.setdefault(r.crawl_run_id, {})[r.key] = r.page_id
    for n, table in enumerate(tables):
        assert got[f"c{n}"] == plain_map(table), n
    assert set(got["c0"].values()) == {"000"}


def test_duplicates_are_told_by_class(spark):
    df = spark.createDataFrame([("c", k, "A" if k % 2 else "") for k in range(90)] + [("d", 1, "A")], "crawl_run_id string, id long, key string")
    assert {tuple(r) for r in D.duplicates(df, F.col("key")).collect()} == {("c", k, 1, 45) for k in range(1, 90, 2)}


def test_site_rules(run):
    llms = lambda **o: {"robots": [], "llms": {"url": "u", "status": 200, "text": "# A\n[b](c)", "truncated": False, "error": None} | o}
    got = run(page("1", technical_signals=signals(identity_signals=["A"])), crawls=[crawl(site_signals=llms())])
    assert got[None, "company-identity"] == "passed" and got[None, "contact-information"] == "finding" and got[None, "llms-presence"] == "finding" and got[None, "llms-syntax"] == "passed" and got[None, "ai-robots"] == "unavailable"
    got = run(page("1", technical_signals=None), crawls=[crawl(site_signals=llms(text="<html>"))])
    assert got[None, "company-identity"] == "unavailable" and got[None, "llms-syntax"] == "finding"
    assert run(page("1"), crawls=[crawl(site_signals=llms(status=404))])[None, "llms-syntax"] == "not_applicable"
    assert run(page("1"), crawls=[crawl(site_signals=llms(truncated=True))])[None, "llms-syntax"] == "unavailable"


def test_coverage_and_runs(spark):
    c, p = spark.createDataFrame([crawl(status="failed", pages_discovered=9)], CRAWLS), spark.createDataFrame([page("1"), page("2", "/b", status="failed", technical_signals=None)], PAGES)
    out = A.audit(c, p)
    rows = {r.rule_id: r for r in out["coverage"].collect()}
    assert len(rows) == 38 and (rows["title-missing"].evaluated, rows["title-missing"].unavailable) == (1, 1) and rows["http-status"].findings == 1
    run = out["runs"].first()
    assert run.pages_analyzed == 1 and len(run.warnings) == 3 and run.rule_version == A.RULE_VERSION
    assert A.unsaved(out["runs"], out["runs"]).count() == 0 and A.unsaved(out["runs"], out["runs"].limit(0)).count() == 1
    assert out["findings"].filter("severity = 'error'").count() >= 1


def test_search_keeps_wildcards(spark):
    df = spark.createDataFrame([("error", "c", "r1", "https://a.com/100%"), ("warning", "c", "r0", "https://a.com/100x"), ("observation", "c", "r0", "https://a.com/100%/b")], "severity string, category string, rule_id string, url string")
    assert [r.severity for r in A.search_issues(df, words="100%").collect()] == ["error", "observation"]


def test_shingles_are_in_one_order_and_short_pages_keep_their_row(spark):
    df = spark.createDataFrame([("c", 1, " ".join(f"w{k}," for k in range(120))), ("c", 2, "too short"), ("c", 3, None)], "crawl_run_id string, id long, t string")
    got = {r.id: r.shingles for r in D.shingle_sets(df, F.col("t"), "crawl_run_id", "id").collect()}
    assert len(got[1]) == 116 and got[1] == sorted(got[1]) and got[2] is None and got[3] is None
