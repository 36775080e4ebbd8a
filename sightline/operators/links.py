"""Link graph of a crawl: URLs resolved to pages, edges, orphans, broken links, canonical targets, robots and the crawl frontier."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import is_excluded, is_page_candidate, same_domain, url_key, with_url_key
from ..storage import stored


def keyed_pages(pages: DataFrame) -> DataFrame:
    """pages with page_url, url_k, final_k, canonical_k and page_k (that of page_url), each worked out once."""
    out = pages.withColumn("page_url", F.coalesce(F.when(F.col("final_url") != "", F.col("final_url")), F.col("url")))
    out = out.withColumns({"url_k": url_key(F.col("url")), "final_k": url_key(F.col("final_url")), "canonical_k": url_key(F.col("canonical_url"))})
    return out.withColumn("page_k", F.coalesce(F.when(F.col("final_url") != "", F.col("final_k")), F.col("url_k")))


def resolve_links(pages: DataFrame) -> DataFrame:
    """(crawl_run_id, key, page_id, status, status_code): which page of its crawl a URL stands for.

    A fetched page wins over others and, among equals, the later in order of URL. The URL of a skipped page whose final URL is a fetched
    page's stands for that page; a redirect's hop only where no page has the URL. Pages are taken in order of URL, so an alias of an alias
    stands for what that one stands for if it comes later (``_alias_targets``). pages: keyed. Only ids, keys and status are shuffled.
    """
    p = pages.select("crawl_run_id", F.col("id").alias("page_id"), "url", "url_k", "final_k", "status", "status_code", F.transform(F.coalesce("redirects", F.array().cast("array<struct<url:string,status:int,destination:string>>")), lambda r: r["url"]).alias("hops"))
    fetched = F.col("status") == "fetched"
    own = p.select("*", F.explode(F.array_distinct(F.array("url_k", "final_k"))).alias("key")).filter("key IS NOT NULL")
    own = own.select("crawl_run_id", "key", "page_id", "status", "status_code", "url", F.when(fetched, 2).otherwise(1).alias("level"))
    best = lambda rows: rows.groupBy("crawl_run_id", "key").agg(F.max(F.struct("level", "url", "page_id", "status", "status_code")).alias("p"))
    first = best(own)
    aliases = _alias_targets(p, first)
    alias_rows = aliases.select("crawl_run_id", F.col("alias").alias("key"), "p.page_id", "p.status", "p.status_code", F.col("at.url").alias("url"), F.lit(3).alias("level"))
    stands = aliases.select("crawl_run_id", F.col("alias_id").alias("page_id"), F.struct("p.page_id", "p.status", "p.status_code").alias("to"))
    hop_rows = with_url_key(p.select("crawl_run_id", "page_id", "status", "status_code", "url", F.explode("hops").alias("hop")), "hop", "key")
    hop_rows = hop_rows.join(stands, ["crawl_run_id", "page_id"], "left").select("crawl_run_id", "key", F.coalesce("to", F.struct("page_id", "status", "status_code")).alias("to"), "url")
    hop_rows = hop_rows.groupBy("crawl_run_id", "key").agg(F.min(F.struct("url", "to")).alias("h")).select("crawl_run_id", "key", "h.to.*", F.col("h.url").alias("url"), F.lit(0).alias("level"))
    return best(own.unionByName(alias_rows).unionByName(hop_rows)).select("crawl_run_id", "key", "p.page_id", "p.status", "p.status_code")


def _alias_targets(p: DataFrame, first: DataFrame) -> DataFrame:
    """(crawl_run_id, alias_id, alias, at, p): skipped pages that stand for a fetched one, p, with their URL's key and their place.

    A skipped page takes what its final URL stands for when its turn comes: what the last earlier skipped page of that URL stands for, else the page
    that has it, if fetched. So each points to at most one earlier page, and its target is that of the earliest page on its way that has
    one. Ways are doubled in each round, so as many rounds are needed as the logarithm of the longest; without such ways there is none.
    """
    place = F.struct("url", "page_id")
    skipped = p.filter("status = 'skipped' AND final_k IS NOT NULL").select("crawl_run_id", F.col("page_id").alias("alias_id"), F.col("url_k").alias("alias"), F.col("final_k").alias("key"), place.alias("at"))
    own = first.filter("p.status = 'fetched'").select("crawl_run_id", "key", F.struct("p.page_id", "p.status", "p.status_code").alias("p"))
    before = skipped.select("crawl_run_id", F.col("alias").alias("key"), F.col("alias_id").alias("prior"), F.col("at").alias("prior_at"))
    earlier = skipped.join(before, ["crawl_run_id", "key"]).filter("prior_at < at").groupBy("crawl_run_id", "alias_id").agg(F.max_by("prior", "prior_at").alias("next"))
    state = stored(skipped.join(own, ["crawl_run_id", "key"], "left").join(earlier, ["crawl_run_id", "alias_id"], "left").select("crawl_run_id", "alias_id", "alias", "at", "next", "p"))
    while not state.filter("next IS NOT NULL").isEmpty():  # places fall along a way, so it ends
        far = state.select("crawl_run_id", F.col("alias_id").alias("next"), F.col("next").alias("after"), F.col("p").alias("q"))
        state = stored(state.join(far, ["crawl_run_id", "next"], "left").select("crawl_run_id", "alias_id", "alias", "at", F.col("after").alias("next"), F.coalesce("q", "p").alias("p")))
    return state.filter("p IS NOT NULL").select("crawl_run_id", "alias_id", "alias", "at", "p")


def page_links(pages: DataFrame) -> DataFrame:
    """(crawl_run_id, source_id, link, key) of fetched pages, each link once."""
    rows = pages.filter("status = 'fetched'").select("crawl_run_id", F.col("id").alias("source_id"), F.explode(F.array_distinct("internal_links")).alias("link"))
    return with_url_key(rows, "link", "key")


def link_edges(links: DataFrame, resolved: DataFrame) -> DataFrame:
    """Distinct (crawl_run_id, source_id, target_id) between different pages. A home page that all link to is split by Spark's skew join."""
    return links.join(resolved, ["crawl_run_id", "key"]).filter(F.col("source_id") != F.col("page_id")).select("crawl_run_id", "source_id", F.col("page_id").alias("target_id")).distinct()


def incoming_links(edges: DataFrame) -> DataFrame:
    return edges.groupBy("crawl_run_id", F.col("target_id").alias("page_id")).agg(F.count("*").alias("incoming"))


def orphans(pages: DataFrame, edges: DataFrame) -> DataFrame:
    """Fetched pages but the home page that no other page links to."""
    path = F.try_parse_url("page_url", F.lit("PATH"))
    inner = pages.filter((F.col("status") == "fetched") & ~F.coalesce(path, F.lit("")).isin("", "/")).select("crawl_run_id", F.col("id").alias("page_id"))
    return inner.join(edges.select("crawl_run_id", F.col("target_id").alias("page_id")), ["crawl_run_id", "page_id"], "left_anti")


def broken_links(links: DataFrame, resolved: DataFrame) -> DataFrame:
    """(crawl_run_id, page_id, broken, unknown): links whose page answered 404 or 410, and whether any other's state isn't a good answer."""
    rows = links.join(resolved.select("crawl_run_id", "key", "status_code"), ["crawl_run_id", "key"], "left")
    gone = F.col("status_code").isin(404, 410)
    return rows.groupBy("crawl_run_id", F.col("source_id").alias("page_id")).agg(F.array_sort(F.collect_list(F.when(gone, F.concat_ws(" ", "status_code", "link")))).alias("broken"), F.max(~F.coalesce(F.col("status_code").between(200, 299), F.lit(False))).alias("unknown"))


def canonical_targets(pages: DataFrame, resolved: DataFrame) -> DataFrame:
    """(crawl_run_id, page_id, target_id, target_status) of each page's canonical link; the page itself where it names itself."""
    p = pages.filter("canonical_url IS NOT NULL AND canonical_url <> ''").select("crawl_run_id", F.col("id").alias("own_id"), F.col("status").alias("own_status"), F.col("canonical_k").alias("key"), (F.col("canonical_k") == F.col("page_k")).alias("self"))
    out = p.join(resolved, ["crawl_run_id", "key"], "left")
    return out.select("crawl_run_id", F.col("own_id").alias("page_id"), F.when(F.col("self"), F.col("own_id")).otherwise(F.col("page_id")).alias("target_id"), F.when(F.col("self"), F.col("own_status")).otherwise(F.col("status")).alias("target_status"))


def robots_verdicts(paths: DataFrame, rules: DataFrame, agents: list[str]) -> DataFrame:
    """paths (with origin, path) by agent, and whether the origin's policy allows them: the longest fitting rule, allow on ties.

    An agent's own group holds for it if there is one, else the group of all. Without a fitting rule all is allowed; paths of origins
    without a policy aren't returned.
    """
    keys = [c for c in rules.columns if c in paths.columns and c in ("crawl_run_id", "origin")]
    wanted = F.explode(F.array(*(F.struct(F.lit(a).alias("agent"), F.lit(a.lower()).alias("token")) for a in agents))).alias("a")
    groups = rules.select(*keys, F.lower("agent").alias("group"), "allow", "pattern", "length")
    have = groups.groupBy(*keys).agg(F.collect_set("group").alias("groups"))
    rows = paths.select("*", wanted).join(have, keys).select("*", "a.agent", F.when(F.array_contains("groups", F.col("a.token")), F.col("a.token")).otherwise("*").alias("group")).drop("a", "groups")
    fits = F.coalesce(F.rlike("path", F.col("pattern")), F.lit(False))
    rows = rows.join(groups, [*keys, "group"], "left").withColumn("_rule", F.when(fits, F.struct("length", "allow")))
    own = [c for c in paths.columns if c not in ("agent",)]
    return rows.groupBy(*own, "agent").agg(F.coalesce(F.max("_rule")["allow"], F.lit(True)).alias("allowed"))


def frontier(candidates: DataFrame, limit: int = 5000) -> DataFrame:
    """URLs to visit of each crawl: candidate pages of its site that aren't excluded, each once, the home page first, then as first seen.

    candidates: crawl_run_id, url, seen (order), home, excluded_paths.
    """
    rows = candidates.withColumn("url", url_key(F.col("url"))).filter(same_domain(F.col("url"), F.col("home")) & is_page_candidate(F.col("url")) & ~F.coalesce(is_excluded(F.col("url"), F.col("excluded_paths")), F.lit(False)))
    rows = rows.groupBy("crawl_run_id", "url").agg(F.min("seen").alias("seen"), F.max(F.col("url") == url_key(F.col("home"))).alias("is_home"))
    rank = F.row_number().over(Window.partitionBy("crawl_run_id").orderBy(F.desc("is_home"), "seen", "url"))
    return rows.withColumn("place", rank).filter(F.col("place") <= limit).select("crawl_run_id", "url", "place")
