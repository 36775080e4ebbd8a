"""Column expressions over text: normalising, matching and small numeric helpers."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Words of a question that carry no meaning of their own (fixed values).
FILLER = ("a", "an", "the", "what", "which", "is", "are", "can", "could", "would", "i", "we", "our", "do", "does", "please", "some", "me", "you", "your", "tell", "about")


def compact(c: Column) -> Column:
    """White space, Unicode's included, collapsed to single spaces and trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def comparable(c: Column) -> Column:
    return F.lower(compact(c))


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def fold_nfkc(c: Column, lower: bool = True) -> Column:
    """NFKC and collapsed white space, lower-cased unless told otherwise."""
    folded = compact(_nfkc(c))
    return F.lower(folded) if lower else folded


def normalized_question(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(_nfkc(c)), r"[^\p{L}\p{N}]+", " "))


def question_core(normalized: Column) -> Column:
    """Words of a normalised question without fillers, in order."""
    return F.array_join(F.filter(F.split(normalized, " "), lambda w: ~w.isin(*FILLER)), " ")


def question_key(normalized: Column) -> Column:
    """Equal for questions that are the same but for fillers; the question itself where only fillers are left."""
    core = question_core(normalized)
    return F.when(core != "", core).otherwise(normalized)


def is_branded(normalized: Column, normalized_names: Column) -> Column:
    """Whether any name of more than one character is a whole-word phrase of the question."""
    padded = F.concat(F.lit(" "), normalized, F.lit(" "))
    return F.exists(normalized_names, lambda n: (F.length(n) > 1) & F.contains(padded, F.concat(F.lit(" "), n, F.lit(" "))))


def mention_position(text: Column, aliases: Column) -> Column:
    """Smallest offset of an alias that no letter or digit adjoins, whatever its case; -1 if there is none. For few aliases a row; see ``find_mentions``."""
    quoted = lambda a: F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])\Q"), F.replace(a, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?![\p{L}\p{N}])"))
    places = F.filter(F.transform(F.filter(aliases, lambda a: a != ""), lambda a: F.regexp_instr(text, quoted(a)) - 1), lambda i: i >= 0)
    return F.coalesce(F.array_min(places), F.lit(-1))


def quote_supported(text: Column, quote: Column, normalize=comparable, least: int = 0, first: int | None = None) -> Column:
    """Whether the normalised text holds the normalised quote of ``least`` characters or more, in its first characters if told."""
    body = normalize(text) if first is None else F.substring(normalize(text), 1, first)
    return (F.length(F.trim(quote)) >= least) & F.contains(body, normalize(quote))


def noindex_directives(directives: Column) -> Column:
    """Robots directives with the token noindex or none; an agent's scope stays in the text."""
    return F.filter(directives, lambda d: d.rlike(r"(?i)(?:^|[\s,:])(?:noindex|none)(?=$|[\s,;])"))


def prompt_text(text: Column, geography: Column) -> Column:
    return F.when(geography == "Unspecified", text).otherwise(F.concat(text, F.lit("\nBuyer location: "), geography))


def half_up(c: Column) -> Column:
    """Rounds halves up, below zero too."""
    return F.floor(c + 0.5)


def stable_id(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 20)


def wilson(num: Column, den: Column, z: float = 1.96, least: int = 10) -> dict[str, Column]:
    """value, low and high: a share and its Wilson interval. All are null without evidence, the interval under ``least`` too."""
    n = den.cast("double")
    p = num / n
    factor = 1 + z * z / n
    center = (p + z * z / (2 * n)) / factor
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / factor
    return {
        "value": F.when(den > 0, p),
        "low": F.when(den >= least, F.greatest(F.lit(0.0), center - half)),
        "high": F.when(den >= least, F.least(F.lit(1.0), center + half)),
    }
