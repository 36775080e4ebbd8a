"""Page parts of HTML texts against results worked out by hand from the HTML standard."""

import json
import time

import pytest
from pyspark.sql import functions as F

from sightline.functions.htmltree import PageTree, attribute_text, plain_text
from sightline.functions.jsonld import load_block
from sightline.sources import pages as P

HOME = "https://a.com"
#: HTML, its visible text with single spaces, and its headings.
CASES = [
    ("<head><meta charset=utf-8><body>text <b>x</b>", "text x", []),
    ("<meta charset=utf-8><title>t</title>text", "text", []),
    ("<html><head><link rel=x><p>one</html> two", "one two", []),
    ("<head><title>t</title></head> <body class=x>a</body> b</html> c", "a b c", []),
    ("a<p>b<p>c<div>d</div>e", "ab c d e", []),
    ("<p hidden>a<div>b</div>", "b", []),
    ("<p hidden>a<span>b<p>c", "c", []),
    ("<p hidden>a</p>b", "b", []),
    ("<ul><li hidden>a<li>b</ul>", "b", []),
    ("<ul><li>a<ul><li hidden>b<li>c</ul><li>d</ul>", "ac d", []),
    ("<dl><dt hidden>a<dd>b<dt>c</dl>", "bc", []),
    ("<table><tr><td>a<td>b<tr><td>c</table>d", "a b c d", []),
    ("<table><tr><td>a</td></tr>x<div>y</div></table>z", "xy a z", []),
    ("<table hidden><tr><td>a</td></tr>x</table>z", "xz", []),
    ("<table><tr hidden><td>a<tr><td>b</table>", "b", []),
    ("<table><td>a<table><td>b</table>c</table>d", "ab c d", []),
    ("<tr><td>a</td></tr>b", "ab", []),
    ("<b hidden>a<p>b</b>c", "c", []),
    ("<p><b hidden>x</p>y</b>z", "z", []),
    ("<i>a<b>b</i>c</b>d", "abcd", []),
    ("<div aria-hidden=true>a<p>b</div>c<div aria-hidden=false>d</div>", "cd", []),
    ("<svg><title>no</title><text>no</text></svg>yes", "yes", []),
    ("<svg><style/><p>out</p>", "out", []),
    ("<svg><foreignObject><p>no</p></foreignObject></svg>yes", "yes", []),
    ("<select><option>a<a href=x>b</a><option>c</select>d", "abcd", []),
    ("<button hidden>a<button>b</button>", "b", []),
    ("a</p>b", "a b", []),
    ("a<br>b</br>c", "a b c", []),
    ("<h1>a<br>b<span hidden>c</span></h1><h2>d<h3>e</h3>", "a b d e", ["ab", "d", "e"]),
    ("<div hidden><h1>a</h1></div><h2 hidden>b</h2><h3>c", "c", ["c"]),
    ("<body hidden>a<h1>b</h1>", "", []),
    ("<frameset><frame src=x></frameset>a", "", []),
    ("a<!-- b -->c<!---->d<!-->e<!--! f --!>g<!-- h", "acdeg", []),
    ("a<?php x ?>b<!x>c</ x>d", "abcd", []),
    ("1 < 2 &amp; 3 &lt; 4 &notin; <3", "1 < 2 & 3 < 4 ∉ <3", []),
    ("<textarea>a<b>&lt;</textarea>b<iframe>c<d></iframe><xmp><p></xmp>", "a<b><bc<d><p>", []),
    ("a<script>b<p></script>c<style>d</style><noscript><p>e</noscript><template>f<p>g</template>", "ac", []),
    ("a<script>no end", "a", []),
    ("<plaintext>a<b>", "a<b>", []),
    ("a<b title='>'>c</b", "ac", []),
    ("x<p title=\"a>b\" hidden>c", "x", []),
    ("\u00a0a\ufeff b\u2003c\x85", "a b c\x85", []),
    ("", "", []),
    (None, "", []),
]


@pytest.mark.parametrize("html, text, headings", CASES)
def test_text(html, text, headings):
    got = P.extract(html, f"{HOME}/x", HOME)
    assert got["visible_text"] == text and [h["text"] for h in got["headings"]] == headings
    assert got["word_count"] == len(text.split(" ")) * bool(text)


def test_main_part():
    main = lambda html: P.extract(html, HOME, HOME)["technical_signals"]["main_text"]
    assert main("<nav>n</nav><main><h1>Useful article</h1><p>Visible evidence</main><article>other</article>") == "Useful article Visible evidence"
    assert main("<article hidden>no</article><div role=main>yes<article>in</article></div>out") == "yesin"
    assert main("<main> </main><p>all") == "all" and main("<main>a<table><tr><td>b</td></tr>c</table></main>d") == "acb"
    assert main("<main><p>a<main>b</main>c</main>d") == "a bc"


def test_editorial_page():
    html = """<title>Article</title><link rel="canonical" href="javascript:alert(1)"><meta name="author" content="A Writer"><meta property="article:published_time" content="2026-09-17">
    <noscript>Enable JavaScript<a href=/no></noscript><script>alert("ignored")</script><main><h1>Useful article</h1><p>Visible evidence</p></main>"""
    got = P.extract(html, f"{HOME}/blog/article", HOME)
    s = got["technical_signals"]
    assert s["page_kind"] == "editorial" and s["canonical_candidates"] == [{"raw": "javascript:alert(1)", "url": None}] and s["authors"] == ["A Writer"]
    assert s["published_dates"] == ["2026-09-17"] and s["javascript_notice"] and got["title"] == "Article" and got["internal_links"] == [] and s["script_count"] == 1
    assert got["visible_text"] == "Useful article Visible evidence" == s["main_text"]


def test_signals():
    html = """<html lang=de><html lang=en><base href=/d/p.html><base href=/e/><META NAME=Robots CONTENT=noindex><meta name=GoogleBot><link rel="x canonical" href="y?a=1&copy=2&amp;b"><link rel=canonical>
    <p><a rel=author href=z>Ann <i>B</i></a><span itemprop=datePublished>2024 <b>May</b></span><time itemprop=dateModified datetime=2025-01-01>then</time><svg><a href=in></a><title>t</title></svg>"""
    got = P.extract(html, f"{HOME}/p", HOME, ["noarchive", None])
    assert got["language"] == "de" and got["robots_directives"] == ["Robots: noindex", "GoogleBot: ", "X-Robots-Tag: noarchive"] and got["title"] == "t"
    assert got["canonical_url"] == f"{HOME}/d/y?a=1&b=&copy=2" and len(got["technical_signals"]["canonical_candidates"]) == 2
    assert got["technical_signals"]["authors"] == ["Ann B"] and got["technical_signals"]["published_dates"] == ["2024 May"] and got["technical_signals"]["modified_dates"] == ["2025-01-01"]
    assert got["internal_links"] == [f"{HOME}/d/z", f"{HOME}/d/in"]


def test_references_in_attributes():
    assert [attribute_text(v) for v in ("a&lt;b", "?a&lt=1", "&ltx", "&lt", "&#65;&#x42", "&nosuch;&", "&amp;lt;")] == ["a<b", "?a&lt=1", "&ltx", "<", "AB", "&nosuch;&", "&lt;"]
    assert plain_text("a <b>b</b>&amp;<!-- c -->d") == "a b&d"


def test_json_blocks():
    deep = "[" * 200_000
    assert load_block(deep) == (False, None) and load_block(deep + "]" * 200_000) == (False, None) and load_block("NaN") == (False, None) and load_block("") == (False, None)
    assert load_block("[" * 400 + "]" * 400)[0] and load_block('{"a": "[[[\\"[[["}')[0] and load_block("1" * 6000)[0] and load_block('"' + "\\\\" * 9 + '"')[0]
    nested = '{"author":' * 100 + '{"name":"x"}' + "}" * 100
    html = "".join(f'<script type="application/ld+json">{b}</script>' for b in (deep, nested, '{"author": "a\\ud800b", "datePublished": "2024"}', '{"author": ' + "[" * 300 + '"z"' + "]" * 300 + "}"))
    got = P.extract(html, HOME, HOME)
    assert [b["valid"] for b in got["structured_data"]] == [False, True, True, True] and len(got["structured_data"][0]["value"]) == 5000
    assert set(got["technical_signals"]["authors"]) == {"x", "a\ufffdb", "z"}
    json.dumps(got, ensure_ascii=False).encode()


HOSTILE = ["<i>", "<li><ul>", "<div>", "<table>", "<table><tr><td>", "<p>", "</p>", "<", "&", "<a ", "<!--", "<svg>", "<button>", "<select><option>", "<dd><dt>", "<b hidden>", "<b hidden><p>", "<span itemprop=datePublished>x", "<h1><div>", "<a href=x>", "<template><tr><td>", "<title>", "<a b='", "<b><div>"]


@pytest.mark.parametrize("piece", HOSTILE)
def test_time_is_linear_in_depth(piece):
    took = []
    for n in (1000, 8000):
        began = time.process_time()
        PageTree(piece * n + "</i></b></li></div></p>" * n + "end")
        took.append(time.process_time() - began)
    assert took[1] < 30 * max(took[0], 0.01)  # 8 times the text; the square would be 64


def test_extraction_on_spark(spark):
    rows = [("1", "c", "b", None, None, None, None), ("2", "c", "b", "not a url", None, None, "<p>a"), ("3", "c", "b", "https://a.com/x", None, None, "<script type='application/ld+json'>" + "[" * 100_000)]
    raw = spark.createDataFrame(rows, "id string, crawl_run_id string, brand_id string, url string, final_url string, scope string, html string")
    got = {r.id: r for r in P.extract_pages(raw).collect()}
    assert (got["1"].visible_text, got["2"].visible_text, got["3"].structured_data[0].valid) == ("", "a", False)
    tagged = raw.withColumn("header_robots", F.array(F.lit("none")))
    assert {tuple(r.robots_directives) for r in P.extract_pages(tagged).collect()} == {("X-Robots-Tag: none",)}
