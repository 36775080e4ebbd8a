"""Format-preserving Feistel pseudonyms for validated numbers and dates (and addresses and tokens), in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, unused

ROUNDS = 8
#: Key of the registered query and of the pipeline. A user passes their own.
KEY = "sightline"
#: Any 400 years in a row have 146097 = 27 * 5411 days, so a date is a pair of digits to these bases.
FIRST_DAY, DAY_BASES = "1800-01-01", (27, 5411)
#: Steps of a walk to the next date that can only be read month first; three in five dates can, so it never needs as many.
WALK = 64
#: Social security numbers that are given out: areas 1 to 899 but 666, groups from 1, serials from 1. Each is a digit to its own base.
SOCIAL_BASES = (898, 99, 9999)

EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}"
TOKEN = r"(?<![0-9A-Za-z])[0-9A-Fa-f]{32,}+(?![0-9A-Za-z])"
ADDRESS = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
PHONE = r"(?<![0-9])(?:\+?[0-9]{1,3}[ .-]?)?\([0-9]{3}\)[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])|\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){3,4}(?![0-9])"
DATE = r"(?<![0-9/-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9/-])"
SOCIAL = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
#: A run of groups of digits that may hold card numbers: 13 digits at least, and no group that another kind begins with.
OTHERS = "|".join((EMAIL, TOKEN, DATE, ADDRESS, PHONE, SOCIAL))
CARDS = rf"(?<![0-9])(?=[0-9](?:[ -]?[0-9]){{12}})[0-9]++(?:[ -](?!{OTHERS})[0-9]++)*+"
FOUND = f"{OTHERS}|{CARDS}"
#: Digits of a card number, and the number that is tried before nearer and farther ones.
CARD_DIGITS, USUAL_DIGITS = (13, 19), 16
#: Letters and digits outside ASCII: first and last code points of ranges without gaps (fixed values). Others move in their row of 16 code points.
RANGES = (
    (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0xFF), (0x100, 0x17F), (0x391, 0x3A1), (0x3A3, 0x3A9), (0x3B1, 0x3C9), (0x410, 0x42F), (0x430, 0x44F), (0x450, 0x45F), (0x531, 0x556), (0x561, 0x586), (0x5D0, 0x5EA), (0x620, 0x64A),
    (0x660, 0x669), (0x6F0, 0x6F9), (0x904, 0x939), (0x966, 0x96F), (0xE01, 0xE30), (0x10D0, 0x10F0), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3), (0xFF10, 0xFF19), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A),
)


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def feistel(values: Column, bases: Column, label: str, key: str) -> Column:
    """Keyed permutation of a list of digits, each to a base of its own.

    Left and right halves are shifted in turn by amounts drawn from SHA-512s of the key, the label, the length, the
    round and the other half. A shift modulo the base is undone by its negative, so the whole is a bijection. A single digit has
    no other half: its values are put in the order of their keyed hashes instead.
    """
    n = F.size(values)
    half = (n / 2).cast("int")

    def shifted(digits: Column, own: Column, other: Column, turn: Column) -> Column:
        seed = F.concat_ws("|", F.lit(key), F.lit(label), n, turn, F.array_join(F.transform(other, lambda x: x.cast("string")), ","))
        # 32 amounts of four hexadecimal places from each hash
        drawn = F.array_join(F.transform(F.sequence(F.lit(0), (F.size(digits) / 32).cast("int")), lambda k: F.sha2(F.concat_ws("|", seed, k), 512)), "")
        amount = lambda hexed, i: F.conv(F.substring(hexed, i * 4 + 1, F.lit(4)), 16, 10).cast("int")
        return _let(drawn, lambda hexed: F.transform(digits, lambda v, i: F.pmod(v + amount(hexed, i), F.get(own, i))))

    def turned(state: Column, turn: Column) -> Column:
        left, right = state["l"], state["r"]
        even = turn % 2 == 0
        return F.struct(
            F.when(even, shifted(left, F.slice(bases, F.lit(1), half), right, turn)).otherwise(left).alias("l"),
            F.when(even, right).otherwise(shifted(right, F.slice(bases, half + 1, n - half), left, turn)).alias("r"),
        )

    start = F.struct(F.slice(values, F.lit(1), half).alias("l"), F.slice(values, half + 1, n - half).alias("r"))
    several = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turned, lambda s: F.concat(s["l"], s["r"]))
    ranked = F.array_sort(F.transform(F.sequence(F.lit(0), F.get(bases, F.lit(0)) - 1), lambda v: F.struct(F.sha2(F.concat_ws("|", F.lit(key), F.lit(label), v), 512).alias("h"), v.alias("v"))))
    return F.when(n == 1, F.array(F.get(ranked, F.get(values, F.lit(0)))["v"])).otherwise(several)


def _digits(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit("([0-9])"), 1), lambda c: c.cast("int"))


def _tens(digits: Column) -> Column:
    return F.transform(digits, lambda _: F.lit(10))


def _filled(text: Column, digits: Column) -> Column:
    """text with its digits replaced one by one, other characters kept."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("k"))
    step = lambda s, c: F.when(c.rlike("[0-9]"), F.struct(F.concat(s["out"], F.get(digits, s["k"]).cast("string")).alias("out"), (s["k"] + 1).alias("k"))).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["k"].alias("k")))
    return F.aggregate(F.regexp_extract_all(text, F.lit("(?s)(.)"), 1), start, step, lambda s: s["out"])


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of digits whose last is the check digit."""
    doubled = F.transform(F.reverse(digits), lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d)


def _card(text: Column, key: str) -> Column:
    def renamed(digits: Column) -> Column:
        body = F.slice(digits, F.lit(1), F.size(digits) - 1)
        new = lambda b: F.concat(b, F.array(F.pmod(-luhn_sum(F.concat(b, F.array(F.lit(0)))), F.lit(10))))
        return F.when(luhn_sum(digits) % 10 == 0, _let(_let(feistel(body, _tens(body), "card", key), new), lambda d: _filled(text, d)))

    return _let(_digits(text), renamed)


def _cards(run: Column, key: str) -> Column:
    """(text, n) of a run of digit groups with its n card numbers renamed; null without any.

    A card number is a stretch of whole groups whose digits pass Luhn's check. From left to right, the first group that one begins with
    is taken, and of those that begin there the one with digits nearest to 16, the shorter first.
    """
    low, high = CARD_DIGITS
    pieces = F.regexp_extract_all(run, F.lit("([ -]?[0-9]+)"), 1)

    def renamed(ps: Column) -> Column:
        stretch = lambda i, n: F.regexp_replace(F.array_join(F.slice(ps, i + 1, n), ""), "^[ -]", "")
        digits = lambda i, n: F.length(F.regexp_replace(stretch(i, n), "[^0-9]", ""))
        tried = lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(high), F.size(ps) - i)), lambda n: F.struct(F.abs(digits(i, n) - USUAL_DIGITS).alias("away"), n.alias("n")))
        good = lambda i: F.filter(tried(i), lambda x: digits(i, x["n"]).between(low, high) & (luhn_sum(_digits(stretch(i, x["n"]))) % 10 == 0))
        none = F.array().cast("array<struct<i:int,n:int>>")
        add = lambda s, i, best: F.struct((i + best["n"]).alias("next"), F.concat(s["cards"], F.array(F.struct(i.alias("i"), best["n"].alias("n")))).alias("cards"))
        step = lambda s, i: F.when(i < s["next"], s).otherwise(_let(F.array_min(good(i)), lambda best: F.when(best.isNull(), s).otherwise(add(s, i, best))))
        found = F.aggregate(F.sequence(F.lit(0), F.size(ps) - 1), F.struct(F.lit(0).alias("next"), none.alias("cards")), step, lambda s: s["cards"])

        def written(cards: Column) -> Column:
            end = lambda k: F.coalesce(F.get(cards, k)["i"] + F.get(cards, k)["n"], F.lit(0))
            before = lambda c, k: F.array_join(F.slice(ps, end(k - 1) + 1, c["i"] - end(k - 1)), "")
            mark = lambda c: F.regexp_extract(F.get(ps, c["i"]), "^([ -]?)", 1)
            parts = F.transform(cards, lambda c, k: F.concat(before(c, k), mark(c), _card(stretch(c["i"], c["n"]), key)))
            last = end(F.size(cards) - 1)
            return F.when(F.size(cards) > 0, F.struct(F.concat(F.array_join(parts, ""), F.array_join(F.slice(ps, last + 1, F.size(ps) - last), "")).alias("text"), F.size(cards).alias("n")))

        return _let(found, written)

    return _let(pieces, renamed)


def _phone(text: Column, key: str) -> Column:
    """The last ten digits move, those before them are a country's code. Area and exchange codes from 2 on stay such, and so do others."""

    def renamed(digits: Column) -> Column:
        head, tail = F.slice(digits, F.lit(1), F.size(digits) - 10), F.slice(digits, F.size(digits) - 9, F.lit(10))
        leads = lambda i: (i == 0) | (i == 3)
        floor = lambda v, i: F.when(leads(i) & (v > 1), 2).otherwise(0)
        bases = F.transform(tail, lambda v, i: F.when(~leads(i), 10).when(v > 1, 8).otherwise(2))
        moved = feistel(F.transform(tail, lambda v, i: v - floor(v, i)), bases, "phone", key)
        return _let(F.zip_with(moved, F.transform(tail, floor), lambda v, low: v + low), lambda new: _filled(text, F.concat(head, new)))

    return _let(_digits(text), lambda d: F.when(F.size(d).between(10, 15), renamed(d)))


def _social(text: Column, key: str) -> Column:
    """Numbers that are given out move among themselves."""
    parts = F.transform(F.split(text, "-"), lambda c: c.cast("int"))
    area, group, serial = (F.get(parts, F.lit(k)) for k in range(3))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    values = F.array(F.when(area > 666, area - 2).otherwise(area - 1), group - 1, serial - 1)
    padded = lambda v, n: F.lpad(v.cast("string"), n, "0")
    area_of = lambda v: F.when(v > 664, v + 2).otherwise(v + 1)
    name = lambda new: F.concat_ws("-", padded(area_of(F.get(new, F.lit(0))), 3), padded(F.get(new, F.lit(1)) + 1, 2), padded(F.get(new, F.lit(2)) + 1, 4))
    return F.when(valid, _let(feistel(values, F.array(*map(F.lit, SOCIAL_BASES)), "social", key), name))


def _address(text: Column, key: str) -> Column:
    parts = F.transform(F.split(text, r"\."), lambda c: c.cast("int"))
    new = _let(parts, lambda p: feistel(p, F.array_repeat(F.lit(256), 4), "address", key))
    return F.when(F.forall(parts, lambda x: x < 256), F.array_join(F.transform(new, lambda x: x.cast("string")), "."))


def _date(text: Column, key: str) -> Column:
    """ISO dates and dates written day first move among all days; dates that can only be read month first among such days, and stay so written."""
    low, high = DAY_BASES
    epoch = F.lit(FIRST_DAY).cast("date")
    bases = F.array(F.lit(low), F.lit(high))
    iso, by_day, by_month = text.contains("-"), F.try_to_date(text, "dd/MM/yyyy"), F.try_to_date(text, "MM/dd/yyyy")
    month_first = ~iso & by_day.isNull()
    number = F.datediff(F.when(iso, F.try_to_date(text, "yyyy-MM-dd")).otherwise(F.coalesce(by_day, by_month)), epoch)

    def moved(n: Column, label: str) -> Column:
        pair = F.array((n / high).cast("int"), (n % high).cast("int"))
        return _let(feistel(pair, bases, label, key), lambda p: (F.get(p, F.lit(0)) * high + F.get(p, F.lit(1))).cast("int"))

    day = lambda n: F.date_add(epoch, n)
    # walking on along the permutation's cycle till a day after the 12th is a permutation of such days
    walked = lambda n: F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), moved(n, "month first"), lambda m, _: F.when(F.dayofmonth(day(m)) > 12, m).otherwise(moved(m, "month first")))
    name = lambda n: F.when(iso, F.date_format(day(moved(n, "date")), "yyyy-MM-dd")).when(month_first, F.date_format(day(walked(n)), "MM/dd/yyyy")).otherwise(F.date_format(day(moved(n, "date")), "dd/MM/yyyy"))
    return F.when(number.between(0, low * high - 1), _let(number, name))


def _lettered(text: Column, label: str, letters: int, key: str) -> Column:
    """Digits move among digits, letters among the first ``letters`` of their case, and others among their range (RANGES); marks stay."""

    def ranged(c: Column, code: Column, value: Callable[[int, int], int], row: Column, other: Column) -> Column:
        """By the character's range: what ``value`` makes of its ends; ``row`` for other letters and digits; ``other`` for marks."""
        out = F.when(c.rlike("[0-9]"), value(48, 57)).when(c.rlike("[a-z]"), value(97, 96 + letters)).when(c.rlike("[A-Z]"), value(65, 64 + letters))
        for low, high in RANGES:
            out = out.when(code.between(low, high), value(low, high))
        return out.when(c.rlike(r"[\p{L}\p{N}]"), row).otherwise(other)

    code = lambda c: F.ascii(c)
    floor = lambda c: ranged(c, code(c), lambda low, _: low, code(c) - code(c) % 16, code(c))
    base = lambda c: ranged(c, code(c), lambda low, high: high - low + 1, F.lit(16), F.lit(1))
    character = lambda n: F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    values = lambda cs: F.transform(cs, lambda c: code(c) - floor(c))
    new = lambda cs: feistel(values(cs), F.transform(cs, base), label, key)
    back = lambda cs: F.zip_with(cs, new(cs), lambda c, v: F.when(base(c) > 1, character(floor(c) + v)).otherwise(c))
    return _let(F.regexp_extract_all(text, F.lit("(?s)(.)"), 1), lambda cs: F.array_join(back(cs), ""))


def _email(text: Column, key: str) -> Column:
    """The local part moves; one of marks alone tells nobody and stays."""
    local = F.substring_index(text, "@", 1)
    return F.when(local.rlike(r"[\p{L}\p{N}]"), F.concat(_lettered(local, "email", 26, key), F.lit("@"), F.substring_index(text, "@", -1)))


def _token(text: Column, key: str) -> Column:
    return F.when(text.rlike("[0-9]") & text.rlike("[A-Fa-f]"), _lettered(text, "token", 6, key))


KINDS = (("email", EMAIL, _email), ("token", TOKEN, _token), ("date", DATE, _date), ("address", ADDRESS, _address), ("phone", PHONE, _phone), ("social", SOCIAL, _social))


def pseudonym(found: Column, key: str) -> Column:
    """(text, n): what stands in place of one found string, by its kind, and how many values of it were renamed; null if none is valid of its kind."""
    name, kind = F.when(F.lit(False), F.lit("")), F.lit(False)
    for _, pattern, rename in KINDS:
        fits = found.rlike(f"^(?:{pattern})$")
        name, kind = name.when(fits, rename(found, key)), kind | fits
    return F.when(~kind, _cards(found, key)).otherwise(_let(name, lambda n: F.when(n.isNotNull(), F.struct(n.alias("text"), F.lit(1).alias("n")))))


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """docs with personal values in ``text`` replaced, and n_pseudonyms.

    Card numbers that pass Luhn's check keep it, wherever they stand among other groups of digits (see ``_cards``); phone numbers, written with a
    country code or with the area in brackets, keep the code and lead digits that can lead; social security numbers stay such as are given
    out; IPv4 addresses, calendar dates of 1800 to 2199 in their written order, mail addresses (local part, of any script) and hexadecimal tokens of 32
    characters or more that have digits and letters stay such. Each is a keyed permutation of its format's values, so equal values have
    equal pseudonyms in every document, whatever separators they are written with, and different values never meet (a date that can
    only be read month first moves among its like). Numbers that don't validate stay as they are, and so do phone numbers of bare digits.

    Null text stays null, and like an empty one has 0 pseudonyms; a very long text, and a value of any length, is one pass of a pattern
    that never goes back. Where kinds could overlap, the first one that matches at the leftmost place is taken, and a run of digit groups ends
    where another kind begins. doc_id isn't looked at: null and repeated ones, repeated rows and other columns stay as they come,
    whatever their names; an input column named n_pseudonyms is replaced. An empty table gives no rows.
    """
    text = F.col("text")
    docs = docs.drop("n_pseudonyms")
    found, names = unused(docs, "found", "names")
    has = text.rlike("[0-9@]") & text.rlike(FOUND)
    rows = docs.withColumn(found, F.when(has, F.regexp_extract_all(text, F.lit(FOUND), 0)))
    rows = rows.withColumn(names, F.transform(found, lambda x: pseudonym(x, key)))
    new = F.concat(F.zip_with(names, found, lambda a, b: F.coalesce(a["text"], b)), F.array(F.lit("")))
    parts = F.flatten(F.zip_with(F.split(text, FOUND, -1), new, lambda a, b: F.array(a, b)))
    rows = rows.withColumn("text", F.when(F.col(found).isNotNull(), F.array_join(parts, "")).otherwise(text))
    count = F.aggregate(names, F.lit(0), lambda n, x: n + F.coalesce(x["n"], F.lit(0)))
    return rows.withColumn("n_pseudonyms", F.coalesce(count, F.lit(0)).cast("long")).drop(found, names)


def op3_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), KEY)
