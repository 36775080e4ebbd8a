"""Text, URLs, answers, questions, facts, content, imports, exports and validation on small rows."""

import datetime as dt
import random
import re
import time

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sightline import sinks
from sightline.functions import text as T
from sightline.functions import urls as U
from sightline.functions.mentions import Names
from sightline.functions.urls import canonical, citable
from sightline.operators import content as C
from sightline.operators import facts as FA
from sightline.operators import ledger as L
from sightline.operators import links as LI
from sightline.operators import questions as Q
from sightline.operators import validate as VA
from sightline.operators import visibility as V
from sightline.operators.ranking import placed
from sightline.sources import pages as P

ANSWERS = "experiment_id string, answer_id string, ordinal int, status string, raw string, truncated boolean, analyzed boolean, refused boolean, stage string, type string, persona_id string, provider string, model string"
BRANDS = "experiment_id string, brand_id string, name string, host string, kind string, aliases array<string>"
MENTIONS = "experiment_id string, answer_id string, brand_id string, recommended boolean, recommendation_position int"


def answer(k, raw="text", stage="vendor_comparison", **over):
    return {"experiment_id": "e", "answer_id": f"a{k}", "ordinal": k, "status": "completed", "raw": raw, "truncated": False, "analyzed": True, "refused": False, "stage": stage, "type": "t", "persona_id": "p", "provider": "x", "model": "m"} | over


@pytest.fixture(scope="module")
def brands(spark):
    return spark.createDataFrame([("e", "b1", "Acme", "acme.com", "target", ["Acme", "C++"]), ("e", "b2", "Bar", "bar.io", "competitor", ["bar"])], BRANDS)


def test_canonical_urls():
    same = {
        "HTTP://Www.A.com:80/p/?b=2&a=1&utm_source=x&fbclid=1#f": "http://www.a.com/p?a=1&b=2", "https://a.com": "https://a.com/", "https://a.com./x//": "https://a.com/x", "https://a.com:80/": "https://a.com:80/", "https://a.com/a b": "https://a.com/a%20b",
        "https://a.com/?q=": "https://a.com/?q=", "https://bücher.de/": "https://xn--bcher-kva.de/",
    }
    for url, want in same.items():
        assert canonical(url) == want, url
    for url in ("ftp://a.com", "https://u:p@a.com", "https://a.com:8080/", "nonsense", "", None, "https://", "javascript:alert(1)"):
        assert canonical(url) is None, url
    assert canonical("../b?x=1", "https://a.com/c/d") == "https://a.com/b?x=1" and canonical("mailto:a@b.c", "https://a.com") is None


def test_citable():
    assert all(citable(u) == u for u in ("https://a.com/x", "http://8.8.8.8/"))
    assert not any(map(citable, ("https://localhost/", "https://a.local/", "https://x.test", "http://10.0.0.1/", "http://127.0.0.1/", "https://u:p@a.com/", "ftp://a.com", "https://single/", "https://a.com/" + "x" * 2048, None, "http://[::ffff:10.0.0.1]/")))


def test_url_columns(spark):
    row = spark.createDataFrame([("https://www.A.com/fr%2Dca/x.PDF", "https://a.com/docs/y", "x")], "a string, b string, c string").select(
        U.domain_key(F.col("a")).alias("k"), U.same_domain(F.col("a"), F.col("b")).alias("same"), U.same_domain(F.col("a"), F.col("c")).alias("none"), U.is_page_candidate(F.col("a")).alias("pdf"), U.is_page_candidate(F.col("b")).alias("page"),
        U.is_excluded(F.col("a"), F.array(F.lit("/fr-ca"))).alias("decoded"), U.is_excluded(F.col("b"), F.array(F.lit("/doc"))).alias("part"), U.is_excluded(F.col("b"), F.array(F.lit("/docs/"))).alias("below"),
        U.host_matches(F.lit("x.acme.com"), F.lit("acme.com")).alias("sub"), U.host_matches(F.lit("notacme.com"), F.lit("acme.com")).alias("spoof"), U.url_key(F.col("c")).alias("raw"),
    ).first()
    assert row.asDict() == {"k": "a.com", "same": True, "none": False, "pdf": False, "page": True, "decoded": True, "part": False, "below": True, "sub": True, "spoof": False, "raw": "x"}


def test_mention_positions(spark):
    cases = [("use C++ now", ["C++"], 4), ("harboring", ["bar"], -1), ("the BAR.", ["bar"], 4), ("", ["bar"], -1), ("éBar bar", ["bar"], 5), ("x a.b y", ["a.b", "y"], 2), ("x aXb", ["a.b"], -1)]
    got = spark.createDataFrame([(t, a) for t, a, _ in cases], "t string, a array<string>").select(T.mention_position(F.col("t"), F.col("a")).alias("p")).collect()
    assert [r.p for r in got] == [c[2] for c in cases]


NAME_CASES = [("a\\E[b is here", "a\\E[b", 0), ("x \\Q", "\\Q", 2), ("ſtraße STRASSE", "straße", 0), ("the \u212aelvin", "kelvin", 4), ("Ünder ünder", "ünder", 0), ("x(y)", "(y)", -1), ("x (y)", "(y)", 2), ("½bar bar", "bar", 5), ("\U0001d54abar bar", "bar", 5), ("日本語", "本", -1), ("日 本 語", "本", 2), ("\u0130x i", "i", 3), ("C++ and C", "c", 0)]


def test_names_with_any_character(spark):
    """An alias may hold what regular expressions read; letters of any script adjoin, whatever their case."""
    assert [Names([("b", name)]).first_places(text).get("b", -1) for text, name, _ in NAME_CASES] == [at for _, _, at in NAME_CASES]
    got = spark.createDataFrame([(k, t, [n]) for k, (t, n, _) in enumerate(NAME_CASES[:2])], "k int, t string, a array<string>").select("k", T.mention_position(F.col("t"), F.col("a")).alias("p")).orderBy("k").collect()
    assert [r.p for r in got] == [0, 2]


@pytest.mark.parametrize("names_bytes", [1 << 20, 0])
def test_mentions_against_patterns(spark, names_bytes):
    """Names that go to the workers, and names that meet their answers in a shuffle, against a pattern for each name."""
    draw = random.Random(4)
    piece = lambda n: "".join(draw.choice("ab+.é B") for _ in range(n))
    brands = [(str(e), f"b{k}", [piece(draw.randint(0, 3)) for _ in range(draw.randint(0, 4))] + [None] * (k % 2)) for e in range(4) for k in range(6)] + [("9", "b", None), (None, "b", ["a"])]
    answers = [(str(draw.choice([0, 0, 0, 0, 1, 2, 8])), k, piece(draw.randint(0, 30)) if k % 9 else None) for k in range(300)] + [(None, 999, "a")]
    got = V.find_mentions(spark.createDataFrame(answers, "experiment_id string, answer_id long, raw string"), spark.createDataFrame(brands, "experiment_id string, brand_id string, aliases array<string>"), names_bytes)
    want = {}
    for e, k, raw in answers:
        found = []
        for own, brand, aliases in brands:
            places = [m.start() for a in aliases or [] if a and e == own and e is not None and (m := re.search(rf"(?<![^\W_]){re.escape(a)}(?![^\W_])", raw or "", re.I))]
            found += [(min(places), brand)] if places else []
        want |= {(e, k, brand): (at, n + 1) for n, (at, brand) in enumerate(sorted(found))}
    assert {(r.experiment_id, r.answer_id, r.brand_id): (r["at"], r.first_position) for r in got.collect()} == want and len(want) > 100


def test_time_does_not_follow_the_number_of_names():
    text = " ".join(f"name{k}" for k in range(40_000))
    took = []
    for n in (10, 20_000):
        names = Names((k % 50, f"name{k}") for k in range(100_000, 100_000 + n))
        began = time.process_time()
        assert names.first_places(text) == {}
        took.append(time.process_time() - began)
    assert took[1] < 10 * took[0] + 0.2


def test_wilson(spark):
    rows = spark.createDataFrame([(0, 0), (3, 9), (12, 20), (20, 20), (0, 10)], "n int, d int").select(*(c.alias(k) for k, c in T.wilson(F.col("n"), F.col("d")).items())).collect()
    assert rows[0].value is None and rows[1].low is None and abs(rows[1].value - 1 / 3) < 1e-12
    assert rows[2].value == 0.6 and abs(rows[2].low - 0.3866) < 1e-3 and abs(rows[2].high - 0.7812) < 1e-3
    assert rows[3].high == 1.0 and rows[4].low == 0.0


def test_questions_keep_differences(spark):
    texts = ["What is the best CRM?", "best crm", "Best CRM in Germany?", "best CRM under $20", "best CRM under $50", "Is A better than B?", "Is B better than A?", "which CRM is not best", "the", "What?", "ＢＥＳＴ crm!"]
    got = Q.dedupe_questions(spark.createDataFrame([(k, "p", t, k) for k, t in enumerate(texts)], "id int, project_id string, text string, created_at int")).collect()
    assert sorted(r.id for r in got) == [0, 2, 3, 4, 5, 6, 7, 8, 9]


def test_recommended_questions(spark):
    rows = [(f"q{k:02}", "p", f"per{k % 3}", Q.STAGES[k % 6], 5 if k < 28 else 1, k % 7 == 0, "active" if k else "archived") for k in range(30)]
    got = Q.recommended_questions(spark.createDataFrame(rows, "id string, project_id string, persona_id string, stage string, intent int, branded boolean, status string")).collect()
    assert len(got) == 20 and "q00" not in {r.id for r in got} and {r.stage for r in got} == set(Q.STAGES) and any(r.branded for r in got) and any(r.intent == 1 for r in got)
    assert [r.stage for r in sorted(got, key=lambda r: r.place)][:6] == list(Q.STAGES)
    check = Q.library_check(spark.createDataFrame(rows, "id string, project_id string, persona_id string, stage string, intent int, branded boolean, status string")).first()
    assert check.active == 29 and not check.complete


def test_visibility(spark, brands):
    rows = [answer(k, "Acme and bar", refused=k == 0) for k in range(9)] + [answer(9, "nobody", "problem_discovery"), answer(10, status="failed"), answer(11, truncated=True), answer(12, analyzed=False), answer(13, raw=" ")]
    answers = spark.createDataFrame(rows, ANSWERS)
    counts = V.answer_counts(answers).first()
    assert (counts.eligible, counts.excluded, counts.refusals) == (10, 4, 1)
    found = V.find_mentions(answers, brands)
    assert {(r.answer_id, r.brand_id, r.first_position) for r in found.filter("answer_id = 'a3'").collect()} == {("a3", "b1", 1), ("a3", "b2", 2)}
    judged = spark.createDataFrame([("e", f"a{k}", "b1", True, 2, "strong" if k < 4 else "neutral") for k in range(9)], MENTIONS + ", strength string")
    mentions = V.guarded_mentions(found, judged)
    cites = spark.createDataFrame([("e", "a1", 0, "https://www.acme.com/x", "acme.com", "provider"), ("e", "a2", 0, "https://notacme.com", "notacme.com", "provider"), ("e", "a2", 1, "https://blog.acme.com", "blog.acme.com", "answer_text")], "experiment_id string, answer_id string, pos int, url string, domain string, source string")
    m = {r.brand_id: r for r in V.brand_metrics(answers, brands, mentions, cites).collect()}
    assert (m["b1"].mentioned, m["b1"].eligible, m["b1"].recommended, m["b1"].position, m["b1"].position_samples, m["b1"].absent) == (9, 10, 4, 2.0, 4, 1)
    assert (m["b1"].cited, m["b1"].with_citations, m["b2"].cited, m["b1"].share, m["b1"].share_denominator) == (2, 2, 0, 0.5, 54)
    assert m["b2"].recommended == 0 and m["b2"].position is None
    stages = {r.stage: r for r in V.stage_metrics(answers, brands, mentions).collect()}
    assert len(stages) == 6 and stages["validation_risk"].mention_value is None and stages["problem_discovery"].mention_value == 0
    domains = {r.domain: r for r in V.citation_domains(answers, brands, cites).collect()}
    assert domains["blog.acme.com"].target and not domains["notacme.com"].target and domains["acme.com"].rank == 1
    assert V.brand_metrics(answers.limit(0), brands, mentions.limit(0)).count() == 0
    assert {r.brand_id: r.mentioned for r in V.sliced_metrics(answers, brands, mentions, cites).filter("dimension = 'all'").collect()}["b1"] == 9
    assert V.run_progress(answers).first().status == "partial"


def test_agreement_and_adjudication(spark):
    claims = spark.createDataFrame([("e", "c1", "t", "supported", ["f1"]), ("e", "c2", "t", "contradicted", ["f2"]), ("e", "c3", "costs $5 per month", "supported", ["f4"]), ("e", "c4", "t", "unverifiable", []), ("e", "c5", "t", "supported", ["f3"])], "experiment_id string, claim_id string, text string, classification string, fact_ids array<string>")
    facts = spark.createDataFrame([("e", "f1", "feature", "A", "size", "1"), ("e", "f2", "feature", "B", "Size ", "1"), ("e", "f3", "feature", "b", "size", "2"), ("e", "f4", "feature", "C", "x", "1")], "experiment_id string, fact_id string, category string, subject string, attribute string, value string")
    got = {r.claim_id: r.classification for r in V.adjudicate_claims(claims, facts).collect()}
    assert got == {"c1": "supported", "c2": "unverifiable", "c3": "time_sensitive", "c4": "unverifiable", "c5": "unverifiable"}
    row = V.claim_agreement(claims).first()
    assert (row.supported, row.judged, row.agreement_value) == (3, 4, 0.75)


def test_citations_from_text(spark):
    df = spark.createDataFrame([("e", "a", "see https://b.com/x). and https://a.com/1, http://localhost/ https://b.com/x", ["https://a.com/1", "bad"], "provider")], "experiment_id string, answer_id string, raw string, supplied array<string>, supplied_source string")
    got = [(r.url, r.domain, r.source) for r in V.extract_citations(df).orderBy("pos").collect()]
    assert got == [("https://a.com/1", "a.com", "provider"), ("https://b.com/x", "b.com", "answer_text")]


def test_previous_run_is_strictly_before(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("p", "s", t, "r1"), ("p", "s", t + dt.timedelta(microseconds=1), "r2"), ("p", "s", t + dt.timedelta(microseconds=1), "r3"), ("p", "z", t + dt.timedelta(1), "r4"), ("p", "s", t + dt.timedelta(2), "r5")]
    got = {r.run_id: r.previous_run_id for r in V.previous_run(spark.createDataFrame(rows, "project_id string, setup string, created_at timestamp, run_id string"), ["setup"]).collect()}
    assert got == {"r1": None, "r2": "r1", "r3": "r1", "r4": None, "r5": "r3"}


FACT = "id string, project_id string, brand_id string, category string, subject string, attribute string, value string, status string, updated_at int, sources array<struct<url:string,text_hash:string,quote:string>>"


def fact(id, value="$20", **over):
    return {"id": id, "project_id": "p", "brand_id": "b1", "category": "pricing", "subject": "Plan", "attribute": "Price", "value": value, "status": "unreviewed", "updated_at": 1, "sources": [("u", "h", "q")]} | over


def test_contradictions(spark):
    rows = [fact("1"), fact("2", "$25"), fact("3", " $25 "), fact("4", "$9", status="rejected"), fact("5", "$7", brand_id="b2"), fact("6", "$8", attribute="Fee"), fact("7", "x", subject="Same"), fact("8", " X", subject="same")]
    got = FA.contradictions(spark.createDataFrame(rows, FACT)).collect()
    assert len(got) == 1 and got[0].fact_ids == ["1", "2", "3"] and got[0].n_values == 2


def test_merge_facts(spark):
    old = spark.createDataFrame([fact("1")], FACT)
    new = spark.createDataFrame([fact("2", "$20 "), fact("3", sources=[("v", "h", "q")]), fact("4", "$30"), fact("5", "$30")], FACT)
    assert sorted(r.id for r in FA.merge_facts(new, old).collect()) == ["3", "4"]


def test_brand_changes(spark):
    a = spark.createDataFrame([("p", "N", "https://www.a.com", "target"), ("p", "C", "https://c.com", "competitor")], "project_id string, name string, domain string, kind string")
    b = spark.createDataFrame([("p", "A", "https://a.com", "target", "1"), ("p", "B", "https://b.com", "competitor", "2")], "project_id string, name string, domain string, kind string, id string")
    got = {(r.name, r.id): (r.active, r.change) for r in FA.sync_brands(a, b).collect()}
    assert got == {("N", "1"): (True, "keep"), ("C", None): (True, "insert"), ("B", "2"): (False, "deactivate")}
    assert FA.repeated_domains(a.union(a)).count() == 2


def test_html_extraction():
    html = """<!doctype html><html lang="en"><head><title> A  <b>t</title><base href="/d/"><meta name="Description" content=" d "><meta name="robots" content="noindex"><link rel="alternate canonical" href="x?utm_x=1#f">
    <meta property="og:site_name" content="Site"><script type="application/ld+json">{"@type": "Article", "author": {"name": "Ann"}, "datePublished": "2024-01-01"}</script><script type="application/ld+json">{bad</script><script>var a = "</p>";</script></head>
    <body><nav><a href="/about">About</a><a href="mailto:a@b.c">m</a><a href="https://other.com/">o</a></nav><h1>One<br>two</h1><main><p>Body&amp;</p><p hidden>no</p><div aria-hidden="true">no<p>no</p></div></main><noscript>Please enable JavaScript</noscript></body></html>"""
    got = P.extract(html, "https://www.a.com/p/q", "https://a.com")
    assert (got["title"], got["meta_description"], got["language"], got["canonical_url"]) == ("A <b>t", "d", "en", "https://www.a.com/x")  # the base, too, loses its last slash
    assert got["internal_links"] == ["https://www.a.com/about"] and got["external_links"] == ["https://other.com/"] and got["headings"] == [{"level": 1, "text": "Onetwo"}]
    assert got["visible_text"].endswith("Body&") and "no" not in got["visible_text"].split() and [b["valid"] for b in got["structured_data"]] == [True, False]
    s = got["technical_signals"]
    assert (s["page_kind"], s["authors"], s["published_dates"], s["main_text"], s["script_count"]) == ("editorial", ["Ann"], ["2024-01-01"], "Body&", 1)
    assert s["identity_signals"] == ["Site", "/about"] and s["contact_signals"] == ["mailto:a@b.c"] and s["javascript_notice"] and got["robots_directives"] == ["robots: noindex"]
    assert P.extract(None, "https://a.com/", "https://a.com")["word_count"] == 0


def test_fetch_states(spark):
    rows = [(1, "/a", True, 200, "text/html; x"), (2, "/a#b", True, 200, "text/html"), (3, "/c", False, None, None), (4, "/d", True, 500, "text/html"), (5, "/e", True, 200, "image/png"), (6, "/f", True, None, None)]
    log = spark.createDataFrame([("c", k, "https://a.com" + u, "https://a.com" + u, a, s, t, None) for k, u, a, s, t in rows], "crawl_run_id string, seq int, url string, final_url string, allowed boolean, status_code int, content_type string, error string")
    assert [r.status for r in P.classify_fetches(log).orderBy("seq").collect()] == ["fetched", "skipped", "skipped", "failed", "skipped", "failed"]
    more = spark.createDataFrame([("c", 1, "https://a.com/old", "https://a.com/new", True, 200, "text/html", None), ("c", 2, "https://a.com/new", None, True, None, None, "never asked"), ("d", 3, "https://a.com/new", "https://a.com/new", True, 200, "text/html", None)], log.schema)
    assert [r.status for r in P.classify_fetches(more).orderBy("seq").collect()] == ["fetched", "skipped", "fetched"]


def test_sitemaps_and_frontier(spark):
    xml = '<?xml version="1.0"?><s:urlset xmlns:s="http://www.sitemaps.org/schemas/sitemap/0.9"><s:url a="1"><s:loc b="2">https://a.com/x/</s:loc></s:url><s:url><s:loc> https://a.com/y.pdf </s:loc></s:url><s:url><s:loc>https://b.com/z</s:loc></s:url><s:url><s:loc><![CDATA[https://a.com/v?b=1&a=2]]></s:loc></s:url><s:url><s:loc>https://a.com/u?x&#61;1&amp;y</s:loc></s:url></s:urlset>'
    index = "<sitemapindex><sitemap><loc>https://a.com/s.xml</loc></sitemap></sitemapindex>"
    df = spark.createDataFrame([("c", x, "https://a.com") for x in (xml, index, index, "<!DOCTYPE x>" + index.replace("/s", "/w"), xml[:-5], "", None, "<rss/>")], "crawl_run_id string, xml string, home string")
    assert {(r.url, r.is_index) for r in P.read_sitemaps(df).collect()} == {("https://a.com/x", False), ("https://a.com/s.xml", True), ("https://a.com/v?a=2&b=1", False), ("https://a.com/u?x=1&y=", False)}
    rows = [("c", u, k, "https://a.com", ["/no"]) for k, u in enumerate(["https://a.com/b", "https://a.com/b#1", "https://a.com/", "https://a.com/no/x", "https://z.com/", "https://a.com/i.png"])]
    got = LI.frontier(spark.createDataFrame(rows, "crawl_run_id string, url string, seen int, home string, excluded_paths array<string>"), 5).orderBy("place").collect()
    assert [r.url for r in got] == ["https://a.com/", "https://a.com/b"]


def test_imports(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('﻿provider,question,answer,observed_at,citation_urls\r\nx,Best CRM?,"line one\nsaid ""hi""",2024-01-01T00:00:00Z,https://a.com; https://b.com\r\ny,Other,z,2999-01-01,\r\ny,Other,z,never,\r\n', encoding="utf-8")
    good, bad = P.read_answer_csv(spark, str(path))
    assert good.count() == 3 and bad.count() == 0
    library = spark.createDataFrame([("q1", " best crm? ", "vendor_comparison", "pricing", "p", "EU", 5)], "id string, text string, stage string, type string, persona_id string, geography string, intent int")
    answers, rejected = P.normalize_imports(good, library, "2025-01-01")
    row = answers.first()
    assert row.question_id == "q1" and row.raw == 'line one\nsaid "hi"' and row.supplied == ["https://a.com", "https://b.com"] and sorted(r.reason for r in rejected.collect()) == ["time in the future", "unreadable time"]
    for header in ("provider,question,answer", "provider,question,answer,observed_at,extra"):
        path.write_text(header + "\n1,2,3,4,5\n")
        with pytest.raises(ValueError):
            P.read_answer_csv(spark, str(path))


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([("=1+1", -1, ["a"], None), (" @x", 2, None, "\tq"), ('say "x"', 0, [], "ok")], "a string, b int, c array<string>, d string")
    got = [tuple(r) for r in sinks.safe_csv(df).collect()]
    assert got == [("'=1+1", "'-1", '["a"]', ""), ("' @x", "2", "", "'\tq"), ('say "x"', "0", "[]", "ok")]
    sinks.write_csv(df.coalesce(1), str(tmp_path / "csv"))
    text = next((tmp_path / "csv").glob("part-*")).read_bytes().decode()
    assert text.startswith('\ufeff"a","b","c","d"\r\n') and '"say ""x"""' in text and text.count("\r\n") == 4
    nested = spark.createDataFrame([("key s3cret", [("x s3cret",)], ("s3cret", 1))], "t string, l array<struct<v:string>>, s struct<v:string,n:int>")
    row = sinks.redact(nested, ["s3cret", ""]).first()
    assert row.t == "key [REDACTED]" and row.l[0].v == "x [REDACTED]" and row.s.v == "[REDACTED]" and row.s.n == 1
    sinks.export_project({"t": spark.createDataFrame([("p", "w", 1), ("q", "w", 2)], "project_id string, worker_id string, x int")}, "p", str(tmp_path / "out"))
    assert [r.asDict() for r in spark.read.json(str(tmp_path / "out/t")).collect()] == [{"x": 1, "project_id": "p"}]


def test_content_plan(spark):
    brands = spark.createDataFrame([("p", "b1", "target", "https://a.com", ["Acme"]), ("p", "b2", "competitor", "https://b.com", ["Bar"])], "project_id string, brand_id string, kind string, domain string, aliases array<string>")
    questions = spark.createDataFrame([("p", "q1", "How much?", "pricing", 5), ("p", "q2", "Which?", "alternatives", 3), ("p", "q3", "Why?", "other", 1)], "project_id string, id string, text string, type string, intent int")
    pages = spark.createDataFrame([("1", "b1", "https://a.com/", 6.0, ["q2"], "completed"), ("2", "b1", "https://a.com/x", 16.0, ["q3"], "completed"), ("3", "b2", "https://b.com/", 20.0, ["q1"], "completed"), ("4", "b1", "u", None, ["q1"], "partial")], "page_id string, brand_id string, url string, direct_answer double, m array<string>, status string")
    pages = pages.withColumn("matches", F.transform("m", lambda q: F.struct(q.alias("question_id"))))
    gaps = {r.question_id: r for r in C.content_gaps(questions, pages, brands).collect()}
    assert set(gaps) == {"q1", "q2"} and (gaps["q1"].type, gaps["q1"].action, gaps["q1"].rivals, gaps["q1"].impact) == ("Pricing clarity", "create", 1, 100) and (gaps["q2"].type, gaps["q2"].effort) == ("Weak direct answer", "small")
    issues = spark.createDataFrame([("p", "r1", "error", "https://a.com/1"), ("p", "r2", "observation", "u"), ("p", "r1", "error", "https://a.com/1")], "project_id string, rule_id string, severity string, url string")
    projects = spark.createDataFrame([("p", 3)], "project_id string, answers int")
    cites = spark.createDataFrame([("p", 1, 0, "https://c.com/1", "c.com"), ("p", 0, 0, "https://a.com/2", "a.com"), ("p", 0, 1, "https://sub.a.com/2", "sub.a.com")], "project_id string, ordinal int, pos int, url string, domain string")
    third = C.third_party_sources(cites, brands)
    assert [r.url for r in third.orderBy("place").collect()] == ["https://sub.a.com/2", "https://c.com/1"]
    plan = C.action_plan(C.technical_actions(issues), C.gap_actions(C.content_gaps(questions, pages, brands)), C.source_actions(third), C.repeat_actions(projects)).orderBy("place").collect()
    assert len(plan) == 5 and [r.priority for r in plan] == sorted((r.priority for r in plan), reverse=True)
    by = {r.category: r for r in plan}
    assert by["Technical accessibility"].priority == 83 and by["Monitoring"].priority == 69 and by["Third-party authority"].priority == 59 and len(by["Monitoring"].id) == 18


def test_readiness(spark):
    row = dict(id="1", crawl_run_id="c", brand_id="b", url="https://a.com/", final_url=None, title="t", meta_description="d", headings=[(1, "x"), (2, "y")], visible_text="Acme research " * 20, status_code=200, canonical_url="u", robots_directives=["robots: none"], external_links=["x"], structured_data=[(True, "{}", None)], fetched_at=dt.datetime(2024, 6, 1),
               technical_signals=(["Ann"], ["2024-01-01", "nope"], [], ["c"], ["i"], ""))
    schema = "id string, crawl_run_id string, brand_id string, url string, final_url string, title string, meta_description string, headings array<struct<level:int,text:string>>, visible_text string, status_code int, canonical_url string, robots_directives array<string>, external_links array<string>, structured_data array<struct<valid:boolean,value:string,error:string>>, fetched_at timestamp, technical_signals struct<authors:array<string>,published_dates:array<string>,modified_dates:array<string>,contact_signals:array<string>,identity_signals:array<string>,main_text:string>"
    pages = spark.createDataFrame([row, row | {"id": "2", "technical_signals": None, "visible_text": None, "headings": [], "title": None}], schema)
    out = C.readiness(C.content_sample(pages).unionByName(pages.filter("id = '2'").withColumns({"place": F.lit(1), "excerpt": F.lit("")})), spark.createDataFrame([("b", ["acme"])], "brand_id string, aliases array<string>"))
    ratings = spark.createDataFrame([("1", (0.33,), (1.0,), (0.5,), [("q1",)], [])], "page_id string, direct_answer struct<rating:double>, specificity struct<rating:double>, commercial struct<rating:double>, matches array<struct<question_id:string>>, evidence_gaps array<struct<quote:string>>")
    questions = spark.createDataFrame([("q1", "p1", "s1")], "id string, persona_id string, stage string")
    got = {r.page_id: r for r in C.score(C.merge_ratings(out, ratings, questions)).collect()}
    a = got["1"]
    assert (a.evidence, a.structure, a.entity, a.technical, a.freshness, a.direct_answer, a.specificity, a.commercial, a.evaluated_weight, a.score, a.persona_ids, a.status) == (15, 15, 15, 10, 5, 6.6, 15, 2.5, 100, 84, ["p1"], "completed")
    b = got["2"]
    assert b.evidence is None and b.entity is None and b.freshness is None and b.status == "partial" and b.evaluated_weight == 25


def test_validation(spark):
    page = spark.createDataFrame([("1", "The plan costs $20 each month for all users.")], "id string, visible_text string")
    rows = [("1", "pricing", "Plan", "Price", "$20", 0.9, "plan costs  $20 each"), ("1", "nope", "Plan", "x", "y", 2.0, "not there at all, no"), ("2", "pricing", "", "a", "b", 0.5, "short")]
    got = VA.validate_facts(spark.createDataFrame(rows, "page_id string, category string, subject string, attribute string, value string, confidence double, quote string"), page)
    assert [sorted(r.reasons) for r in got.orderBy("page_id", "category").collect()] == [["category", "confidence", "quote"], [], ["quote", "subject"]]
    good, bad = VA.quarantine(got)
    assert (good.count(), bad.count()) == (1, 2)
    raw = spark.createDataFrame([('```json\n{"a": 1}\n```', "stop"), ('{"a": 1', "stop"), ('{"a": 1}', "length")], "response string, finish_reason string")
    assert [r.parsed and r.parsed.a for r in VA.parse_model_json(raw, "a int").collect()] == [1, None, None]
    analysis = "struct<brands:array<struct<brand_id:string,quote:string>>,claims:array<struct<quote:string,classification:string,fact_ids:array<string>>>,entities:array<struct<name:string,quote:string>>>"
    answers = spark.createDataFrame([("e", "a1", "Acme is good", ([("b1", "acme IS")], [("good", "unverifiable", [])], [("Acme", "Acme")])), ("e", "a2", "Acme is good", ([("b2", "good"), ("b2", "x")], [("good", "supported", [])], [("Zed", "Acme")]))], f"experiment_id string, answer_id string, raw string, analysis {analysis}")
    brands = spark.createDataFrame([("e", "b1", ["Acme"]), ("e", "b2", ["Bar"])], "experiment_id string, brand_id string, aliases array<string>")
    out = VA.validate_analysis(answers, brands, spark.createDataFrame([("e", "f1")], "experiment_id string, fact_id string"))
    assert [sorted(r.reasons) for r in out.orderBy("answer_id").collect()] == [[], ["brands", "entities", "evidence", "unique_brands"]]


def test_ledger(spark):
    usage = spark.createDataFrame([(1, "p", "validated", "k", 1.5, 10, 5, 1), (2, "p", "validated", "k", None, 1, 1, 3), (3, "p", "failed", "k", 0.5, 1, 1, 9)], "id int, project_id string, status string, cache_key string, cost double, input_tokens int, output_tokens int, created_at int")
    total = L.usage_totals(usage, spark.createDataFrame([("p", 5.0)], "project_id string, budget double")).first()
    assert (total.attempts, total.cost, total.without_cost, total.remaining) == (3, 2.0, 1, 3.0)
    assert L.latest_responses(usage).first().id == 2 and [r.id for r in L.latest_usage(usage, 1).collect()] == [3]
    facts = spark.createDataFrame([("p", "b", "product", 1, "x", "size", "1", "known"), ("p", "b", "product", 2, "X", "size", "2", "known"), ("p", "b", "product", 3, "x", "size", "3", "rejected")], "project_id string, brand_id string, category string, id int, subject string, attribute string, value string, status string")
    answers = spark.createDataFrame([("e2", f"a{k}", "completed", True, False, "text") for k in range(3)] + [("e1", "z", "completed", True, False, "t")], "experiment_id string, answer_id string, status string, analyzed boolean, truncated boolean, raw string")
    brands = spark.createDataFrame([("e2", "b1", "target"), ("e2", "b2", "competitor")], "experiment_id string, brand_id string, kind string")
    mentions = spark.createDataFrame([("e2", "a0", "b1"), ("e2", "a1", "b2")], "experiment_id string, answer_id string, brand_id string")
    runs = spark.createDataFrame([("p", "e1", 1), ("p", "e2", 2)], "project_id string, experiment_id string, created_at int")
    plan = spark.createDataFrame([("p", 2, "later"), ("p", 1, "first")], "project_id string, place int, title string")
    issues = spark.createDataFrame([("p", "error"), ("p", "observation")], "project_id string, severity string")
    questions = spark.createDataFrame([("p", True), ("p", False)], "project_id string, selected boolean")
    rows = L.project_overview(spark.createDataFrame([("p",), ("q",)], "project_id string"), answers, brands, mentions, runs, plan, issues, facts, questions)
    got = {r.project_id: tuple(r)[1:] for r in rows.collect()}
    assert got == {"p": ("e2", 3, 1, 2, "first", 1, 1, 1, 2, 2, 1), "q": (None, 0, 0, 0, None, 0, 0, 0, 0, 0, 0)}
    history = L.fact_history(spark.createDataFrame([("f", 2, "b", 5), ("f", 1, "a", 4)], "fact_id string, id int, value string, created_at int"))
    assert [(r.revision, r.before, r.value) for r in history.orderBy("revision").collect()] == [(1, None, "a"), (2, "a", "b")]


def test_identical_pages_of_a_large_group(spark):
    pages = spark.createDataFrame([("b", k, "h") for k in range(50)] + [("b", 90, "x"), ("c", 91, "h"), ("c", 92, None)], "brand_id string, id int, text_hash string")
    got = C.identical_pages(pages).collect()
    assert {r.id for r in got if (r.brand_id, r.text_hash, r["first"], r.n) == ("b", "h", 0, 50)} == {*range(50)} and len(got) == 50
    assert all(len(r.similar) == 20 and r.id not in r.similar for r in got)


def test_nested_sitemaps(spark):
    """Indexes name indexes, one names its parent, one is missing, one is another site's; files and URLs are bounded as asked."""
    home = "https://a.com"
    index = lambda *locs: "<sitemapindex>" + "".join(f"<sitemap><loc> {x} </loc></sitemap>" for x in locs) + "</sitemapindex>"
    urls = lambda *locs: "<urlset>" + "".join(f"<url><loc>{x}</loc><p><loc>{home}/no</loc></p></url>" for x in locs) + "</urlset>"
    texts = {"/s.xml": index(f"{home}/b.xml", f"{home}/c.xml", f"{home}/gone.xml", "https://other.com/o.xml"), "/b.xml": index(f"{home}/s.xml", f"{home}/d.xml"), "/c.xml": urls(f"{home}/1", f"{home}/2#x", f"{home}/x.pdf", "https://other.com/3"), "/d.xml": urls(f"{home}/2", f"{home}/4"), "/unnamed.xml": urls(f"{home}/5"), "/bad.xml": "<urlset><url><loc>x"}
    files = spark.createDataFrame([("c", home + path, xml) for path, xml in texts.items()] + [("d", f"{home}/s.xml", texts["/c.xml"]), ("c", "https://other.com/o.xml", urls(f"{home}/9"))], "crawl_run_id string, url string, xml string")
    starts = spark.createDataFrame([("c", f"{home}/s.xml", 0, home), ("c", f"{home}/s.xml#again", 1, home), ("c", f"{home}/bad.xml", 2, home), ("d", f"{home}/s.xml", 0, home)], "crawl_run_id string, url string, seen int, home string")
    told = lambda df: [(r.crawl_run_id, r.url.removeprefix(home)) for r in df.orderBy("crawl_run_id", "place").collect()]
    pages, visited = P.follow_sitemaps(files, starts)
    assert told(pages) == [("c", "/1"), ("c", "/2"), ("c", "/4"), ("d", "/1"), ("d", "/2")]
    assert told(visited) == [("c", x) for x in ("/s.xml", "/bad.xml", "/b.xml", "/c.xml", "/gone.xml", "https://other.com/o.xml", "/d.xml")] + [("d", "/s.xml")]
    assert {r.url.removeprefix(home): r.read for r in visited.filter("crawl_run_id = 'c'").collect()} == {"/s.xml": True, "/bad.xml": True, "/b.xml": True, "/c.xml": True, "/gone.xml": False, "https://other.com/o.xml": False, "/d.xml": True}
    few, some = P.follow_sitemaps(files, starts, most_files=4, most_urls=1)
    assert told(few) == [("c", "/1"), ("d", "/1")] and told(some)[:4] == [("c", x) for x in ("/s.xml", "/bad.xml", "/b.xml", "/c.xml")] and len(told(some)) == 5
    assert P.follow_sitemaps(files, starts.limit(0))[0].count() == 0


def test_sitemap_texts_in_pieces(monkeypatch):
    text = "<urlset>" + "".join(f"<url><loc>https://a.com/{k}</loc></url>" for k in range(500)) + "</urlset>"
    monkeypatch.setattr(P, "XML_PIECE", 7)
    assert P.sitemap_urls(text) == [(f"https://a.com/{k}", False) for k in range(500)] and P.sitemap_urls(text[:-3]) == [] and P.sitemap_urls("<!DOCTYPE x>" + text) == [] and P.sitemap_urls("") == []


def test_places_are_those_of_a_window(spark):
    draw = random.Random(9)
    rows = spark.createDataFrame([(draw.choice([None, "a", "a", "a", "b"]), draw.randint(0, 5), k) for k in range(500)], "g string, p int, k int").repartition(7)
    got = placed(rows, "g", [F.desc("p"), F.col("k").asc()])
    want = rows.withColumn("place", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("p"), "k")))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str) and placed(rows.limit(0), "g", [F.col("k")]).count() == 0


def test_strict_imports(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("provider,question,answer,observed_at\nx,q,a,2024-01-01\nx,q,a,2024-01-01,more\n")
    with pytest.raises(ValueError):
        P.read_answer_csv(spark, str(path), strict=True)
    good, _ = P.read_answer_csv(spark, str(path))
    library = spark.createDataFrame([], "id string, text string, stage string, type string, persona_id string, geography string, intent int")
    assert P.normalize_imports(good, library, "2024-06-01", strict=True)[0].count() == 1
    with pytest.raises(ValueError):
        P.normalize_imports(good, library, "2023-06-01", strict=True)


def test_pages_of_few_brands_are_not_dealt_by_brand(spark):
    """Pages with their matches stay where they are: only short lists of brands and projects are joined by brand or project."""
    import re

    pages = spark.createDataFrame([(k, f"b{k % 2}", f"https://a.com/{k}", float(k % 20), "completed", [(q,) for q in range(k % 7)]) for k in range(60)], "page_id long, brand_id string, url string, direct_answer double, status string, matches array<struct<question_id:long>>")
    brands = spark.createDataFrame([("p", "b0", "target"), ("p", "b1", "competitor")], "project_id string, brand_id string, kind string")
    questions = spark.createDataFrame([("p", q, f"question {q}", "other", 3) for q in range(9)] + [("x", 99, "of another project", "other", 3)], "project_id string, id long, text string, type string, intent int")
    gaps = C.content_gaps(questions, pages, brands)
    for df in (gaps, C.gap_pages(gaps, pages, brands)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"SortMergeJoin(?:\(skew=true\))? \[brand_id#\d+\]", plan)) <= 1 and not re.search(r"SortMergeJoin \[project_id#\d+\], \[project_id#\d+\]", plan)
    assert {(r.question_id, r.action, r.rivals) for r in gaps.collect()} == {(q, "create", 0) for q in (6, 7, 8)}
    listed = {(r.question_id, r.kind, r.page_id) for r in C.gap_pages(gaps, pages, brands).collect()}
    assert listed == set()
