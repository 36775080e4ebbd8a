"""Column expressions over URLs. Two Arrow helpers do what Spark's URL functions can't: resolving and re-encoding."""

from __future__ import annotations

import ipaddress
import re
from urllib.parse import parse_qsl, quote, urlencode, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Query parameters that only track a visit (fixed values).
TRACKING = re.compile(r"(?i)^(?:utm_.*|fbclid|gclid|msclkid|dclid|mc_cid|mc_eid)$")
#: Extensions of files that aren't pages (fixed values).
ASSETS = (
    "avif|bmp|css|csv|docx?|eot|gif|gz|ico|jpe?g|js|json|map|m4a|mov|mp[34]|ogg|otf|pdf|png|pptx?|rar|rss|svg|tar|ttf|txt|"
    "wav|webm|webp|woff2?|xlsx?|xml|zip"
)
_DEFAULT = {"http": 80, "https": 443}


def _host(name: str) -> str:
    name = name.lower().removesuffix(".")
    return name if name.isascii() else name.encode("idna").decode()


def canonical(value: str | None, base: str | None = None) -> str | None:
    """One URL in its normal form, or None if it isn't a plain web address."""
    try:
        url = urlsplit(urljoin(base, value.strip()) if base else value.strip())
        scheme, port = url.scheme.lower(), url.port
        if scheme not in _DEFAULT or url.username or url.password or port not in (None, 80, 443) or not url.hostname:
            return None
        host = _host(url.hostname)
        if not host or " " in host:
            return None
        host = f"[{host}]" if ":" in host else host
        host = host if port in (None, _DEFAULT[scheme]) else f"{host}:{port}"
        pairs = [(k, v) for k, v in parse_qsl(url.query, keep_blank_values=True) if not TRACKING.match(k)]
        path = quote(url.path, safe="/%:@!$&'()*+,;=~-._").rstrip("/") or "/"
        return urlunsplit((scheme, host, path, urlencode(sorted(pairs, key=lambda p: p[0])), ""))
    except (ValueError, AttributeError, UnicodeError):
        return None


@F.pandas_udf(StringType())
def _canonical(url: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([canonical(u, b) for u, b in zip(url, base, strict=True)], dtype=object)


def normalize_url(url: Column, base: Column | None = None) -> Column:
    """The URL's normal form, null if it isn't a web address: lower-case host, no fragment, no tracking, sorted query, no last slash."""
    return _canonical(url, F.lit(None).cast("string") if base is None else base)


def url_key(url: Column) -> Column:
    return F.coalesce(normalize_url(url), url)


def with_url_key(df: DataFrame, url: str, key: str = "url_key") -> DataFrame:
    """df with the key of a URL column, worked out once for each distinct URL: for columns that repeat much, such as links."""
    keys = df.select(F.col(url).alias("_url")).distinct().withColumn(key, url_key(F.col("_url")))
    return df.join(keys, df[url] == keys["_url"], "left").drop("_url")


def domain_key(url: Column) -> Column:
    """Host without a leading ``www.``; null for what has none."""
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.|\.$", "")


def same_domain(a: Column, b: Column) -> Column:
    return F.coalesce(domain_key(a) == domain_key(b), F.lit(False))


def url_path(url: Column) -> Column:
    path = F.try_parse_url(url, F.lit("PATH"))
    return F.when(path == "", "/").otherwise(path)


def is_page_candidate(url: Column) -> Column:
    """Whether the path doesn't end as a file of another kind does."""
    return ~F.coalesce(url_path(url), F.lit("")).rlike(rf"(?i)\.(?:{ASSETS})$")


def is_excluded(url: Column, prefixes: Column) -> Column:
    """Whether the path, as written or decoded, is one of the prefixes or lies below it."""
    path = url_path(url)
    below = lambda c, p: (c == p) | c.startswith(F.when(p.endswith("/"), p).otherwise(F.concat(p, F.lit("/"))))
    decoded = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    return F.exists(F.coalesce(prefixes, F.array().cast("array<string>")), lambda p: below(path, p) | below(decoded, p))


def citable(value: str | None) -> str | None:
    try:
        url = urlsplit(value)
        if url.scheme.lower() not in _DEFAULT or url.username or url.password or len(value) > 2048 or not url.hostname:
            return None
        host = _host(url.hostname)
        try:
            address = ipaddress.ip_address(host)
        except ValueError:
            labels = host.split(".")
            return None if len(labels) < 2 or labels[-1] in ("localhost", "local", "internal", "test", "invalid") else value
        address = getattr(address, "ipv4_mapped", None) or address
        return value if "." in host and address.is_global and not address.is_multicast else None
    except (ValueError, TypeError, UnicodeError):
        return None


@F.pandas_udf(StringType())
def safe_citation(url: pd.Series) -> pd.Series:
    """The URL if it may be shown as a source: a public host, no credentials, 2048 characters at most."""
    return url.map(citable)


def host_matches(host: Column, expected: Column) -> Column:
    """The host is the expected one or below it; one that only ends alike isn't."""
    return F.coalesce((expected != "") & ((host == expected) | host.endswith(F.concat(F.lit("."), expected))), F.lit(False))


#: Kinds of pages by their path (fixed values), the first that fits.
PAGE_KINDS = (
    ("editorial", r"/(?:blog|articles?|news)/[^/]+"),
    ("product", r"/(?:products?|software|solutions?)(?:/|$)"),
    ("faq", r"/(?:faq|faqs)(?:/|$)"),
    ("legal", r"/(?:privacy|terms|legal)(?:/|$)"),
)


def page_kind(path: Column, is_article: Column) -> Column:
    kind = F.when(path == "/", "home").when(is_article, "editorial")
    for name, pattern in PAGE_KINDS:
        kind = kind.when(path.rlike(f"(?i){pattern}"), name)
    return kind.otherwise("other")
