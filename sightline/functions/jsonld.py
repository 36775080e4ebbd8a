"""JSON-LD blocks of a page, walked once: types of all entities, and the texts of its FAQ."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .htmltree import plain_text

#: Entities of a page that are looked at, values that are visited for them, and values that wait at most.
MOST_NODES, MOST_VISITS, MOST_WAITING = 5000, 10_000, 10_000
#: Levels of nesting that a block may have.
MOST_DEPTH = 500
_BRACKETS = re.compile(r'"(?:[^"\\]|\\.)*"?|[\[{]|[\]}]', re.S)

_TEXTS = ArrayType(StringType())
SUMMARY = StructType([StructField(k, t) for k, t in (("types", _TEXTS), ("faqs", IntegerType()), ("faq_texts", _TEXTS), ("authors", _TEXTS), ("published", _TEXTS), ("modified", _TEXTS), ("organizations", _TEXTS))])


def _unknown(name: str):
    raise ValueError(name)


def load_block(text: str):
    """(whether the text is JSON, its value). A block that is nested deeper than MOST_DEPTH isn't taken, told before it is parsed."""
    depth = 0
    for m in _BRACKETS.finditer(text):
        depth += (m.group() in "[{") - (m.group() in "]}")
        if depth > MOST_DEPTH:
            return False, None
    try:
        return True, json.loads(text, parse_constant=_unknown, parse_int=float)
    except (ValueError, RecursionError):
        return False, None


def whole(text: str) -> str:
    """The text with halves of surrogate pairs, which JSON may escape and UTF-8 can't hold, replaced."""
    return re.sub("[\ud800-\udfff]", "\ufffd", text)


def plain(value) -> str:
    """Text of a bit of HTML; '' for what isn't text."""
    return re.sub(r"\s+", " ", plain_text(value)).strip() if isinstance(value, str) else ""


def nodes_of(values: list) -> list[dict]:
    """Entities in the values, nested ones and those of @graph too, the last first. Both they and the visits are bounded."""
    found, todo, visits = [], list(values), 0
    while todo and visits < MOST_VISITS and len(found) < MOST_NODES:
        node, visits = todo.pop(), visits + 1
        if isinstance(node, dict):
            found.append(node)
            node = [v for v in node.values() if isinstance(v, dict | list)]
        if isinstance(node, list):
            todo.extend(node[: max(0, MOST_WAITING - len(todo))])
    return found


def types_of(node: dict) -> list[str]:
    kinds = node.get("@type")
    return [re.sub(r"^https?://schema.org/", "", k) for k in (kinds if isinstance(kinds, list) else [kinds]) if isinstance(k, str)]


def names_of(value) -> list[str]:
    """Names of an entity, a text or nested lists of them, in order."""
    found, todo = [], [value]
    while todo:
        node = todo.pop()
        if isinstance(node, list):
            todo.extend(reversed(node))
        elif isinstance(name := node.get("name") if isinstance(node, dict) else node, str):
            found.append(name)
    return found


def summary(values: list) -> dict:
    nodes = nodes_of(values)
    by_id = {n["@id"]: n for n in reversed(nodes) if isinstance(n.get("@id"), str) and len(n) > 1}

    def resolved(value) -> dict:
        if isinstance(value, dict):
            return by_id.get(value.get("@id"), {}) if len(value) == 1 and "@id" in value else value
        return {}

    listed = lambda v: v if isinstance(v, list) else [v]
    faqs, texts = [n for n in nodes if "FAQPage" in types_of(n)], []
    for faq in faqs:
        for question in map(resolved, listed(faq.get("mainEntity"))):
            texts.append(plain(question.get("name")))
            texts += [plain(resolved(a).get("text")) for a in listed(question.get("acceptedAnswer"))]
    dates = lambda key: [n[key] for n in nodes if isinstance(n.get(key), str)]
    texts_of = lambda values: [whole(v) for v in values]
    return {
        "types": texts_of(sorted({t for n in nodes for t in types_of(n)})),
        "faqs": len(faqs),
        "faq_texts": texts_of(texts),
        "authors": texts_of(a for n in nodes for a in names_of(n.get("author"))),
        "published": texts_of(dates("datePublished")),
        "modified": texts_of(dates("dateModified")),
        "organizations": texts_of(a for n in nodes if {"Organization", "Corporation", "LocalBusiness"} & set(types_of(n)) for a in names_of(n)),
    }


@F.pandas_udf(SUMMARY)
def jsonld_summary(blocks: pd.Series) -> pd.DataFrame:
    """Of an array of JSON texts, valid ones only: types, number of FAQ entities, their texts ('' where missing), authors and dates."""

    def one(texts) -> dict:
        return summary([value for t in (texts if texts is not None else []) if t for good, value in [load_block(t)] if good])

    return pd.DataFrame([one(b) for b in blocks], columns=SUMMARY.names)
