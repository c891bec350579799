"""Operator 7: format-preserving Feistel pseudonyms.

Validated numbers and dates are mapped by keyed permutations of their own
format, so equal values stay equal across documents and different ones stay
different: card numbers keep their length, issuer prefix and check digit,
phone numbers their calling code and punctuation, social security numbers stay
valid ones, dates stay valid dates in the same notation.  Mail addresses, access keys and secrets keep their shape.
Only built-in expressions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, let

ROUNDS = 8
#: The kinds and their patterns, in order of precedence.
_MONTH = "(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
PATTERNS = (
    # possessive, and begun only where a run begins: long runs cost neither stack nor repeated scans
    ("mail", r"(?<![A-Za-z0-9._%+\-À-ɏ])[A-Za-z0-9._%+\-À-ɏ]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)++"),
    ("secret", r"(?i:password|passwd|pwd|token|secret|api[_-]?key)[\"']?\s*+[=:]\s*+[\"']?[A-Za-z0-9+/_\-]{8,}+[\"']?"),
    ("access_key", r"\bAKIA[A-Z0-9]{16}\b"),
    (
        "phone",
        r"\+\d{1,3} \(\d{3}\) \d{3}-\d{4}|\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d-])\d{3}-\d{3}-\d{4}(?![\d-])"
        r"|\+\d(?:[ .()-]{0,2}\d){7,14}(?!\d)|(?<!\d[ .-]?)\d{3}\.\d{3}\.\d{4}(?![ .-]?\d)|(?<!\d[ .-]?)\d{3} \d{3} \d{4}(?![ .-]?\d)",
    ),
    ("ssn", r"(?<![\d-])(?!000|666|9\d\d)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\d-])"),
    (
        "date",
        r"(?<![\d-])\d{4}-\d{2}-\d{2}(?![\d-])|(?<![\d/])(?:\d{4}/\d{2}/\d{2}|\d{1,2}/\d{1,2}/\d{4})(?![\d/])|(?<![\d.])(?:\d{4}\.\d{2}\.\d{2}|\d{1,2}\.\d{1,2}\.\d{4})(?!\d|\.\d)"
        rf"|(?<!\d)\d{{1,2}} {_MONTH} \d{{4}}(?!\d)|\b{_MONTH} \d{{1,2}}, \d{{4}}(?!\d)",
    ),
    ("ip", r"(?<![\d.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?![\d]|\.\d)"),
)
#: A run of digits at single spaces and hyphens, up to where another kind begins; possessive, so its length costs no stack.
_OTHERS = "|".join(f"(?:{p})" for _, p in PATTERNS)
PATTERNS += (("card", rf"(?<!\d)(?=\d(?:[ -]?\d){{12}})\d(?:(?:[ -](?!{_OTHERS}))?\d)*+"),)
#: How dates are read, in order: a date in slashes is month first where that is a date.
DATE_FORMS = tuple(
    (regex, form)
    for regex, forms in (
        (r"\d{4}-\d{2}-\d{2}", ("yyyy-MM-dd",)),
        (r"\d{4}/\d{2}/\d{2}", ("yyyy/MM/dd",)),
        (r"\d{4}\.\d{2}\.\d{2}", ("yyyy.MM.dd",)),
        (r"\d{2}/\d{2}/\d{4}", ("MM/dd/yyyy", "dd/MM/yyyy")),
        (r"\d{1,2}/\d{1,2}/\d{4}", ("M/d/yyyy", "d/M/yyyy")),
        (r"\d{2}\.\d{2}\.\d{4}", ("dd.MM.yyyy",)),
        (r"\d{1,2}\.\d{1,2}\.\d{4}", ("d.M.yyyy",)),
        (r"\d{1,2} [A-Za-z]{3} \d{4}", ("d MMM yyyy",)),
        (r"\d{1,2} [A-Za-z]+ \d{4}", ("d MMMM yyyy",)),
        (r"[A-Za-z]{3} \d{1,2}, \d{4}", ("MMM d, yyyy",)),
        (r"[A-Za-z]+ \d{1,2}, \d{4}", ("MMMM d, yyyy",)),
    )
    for form in forms
)
ANY = "|".join(f"(?:{p})" for _, p in PATTERNS)
#: A text without any of these holds no match.
TRIGGER = r"[0-9@=:]|AKIA"
#: Calling codes of one and two digits; the others have three.
CALLING = r"^(?:\+\d{1,3}(?= \()|\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}))"
#: Valid numbers of social security: 898 areas, and 99 groups of 9999 serials.
AREAS, SERIALS = 898, 99 * 9999
DAYS, LEFT, RIGHT = 146097, 233, 627  # days in 400 years, as a product
FIRST_DAY = "1700-01-01"


def _prf(key: str, kind: str, turn: int, half: Column, size: int | Column) -> Column:
    digest = F.substring(F.sha2(F.concat(F.lit(f"{key}|{kind}|{turn}|"), half.cast("string")), 256), 1, 15)
    return F.pmod(F.conv(digest, 16, 10).cast("bigint"), F.lit(size) if isinstance(size, int) else size)


def permute(value: Column, left: int | Column, right: int | Column, key: str, kind: str) -> Column:
    """A keyed permutation of 0 .. left * right - 1: Feistel rounds over Z_left x Z_right."""
    left, right = (F.lit(x).cast("bigint") if isinstance(x, int) else x.cast("bigint") for x in (left, right))
    pair = F.struct(F.floor(value / right).cast("bigint").alias("l"), F.pmod(value, right).cast("bigint").alias("r"))

    def rounds(turn: int):
        def step(s: Column) -> Column:
            if turn % 2:
                return F.struct(s["l"].alias("l"), F.pmod(s["r"] + _prf(key, kind, turn, s["l"], right), right).alias("r"))
            return F.struct(F.pmod(s["l"] + _prf(key, kind, turn, s["r"], left), left).alias("l"), s["r"].alias("r"))

        return step

    for turn in range(ROUNDS):
        pair = let(pair, rounds(turn))
    return let(pair, lambda s: s["l"] * right + s["r"])


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, r"\D", "")


def _permute_digits(digits: Column, key: str, kind: str) -> Column:
    """Digits of one length, up to 18, to digits of that length."""

    def run(d: Column) -> Column:
        n = F.length(d)
        ten = F.lit(10).cast("double")
        half = F.floor(n / 2)
        right = F.pow(ten, half).cast("bigint")
        left = F.pow(ten, n - half).cast("bigint")
        return F.lpad(permute(d.cast("bigint"), left, right, key, kind).cast("string"), n, "0")

    return F.when(digits == "", digits).otherwise(let(digits, run))


def _refill(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced, in order, by ``digits``."""
    chars = F.split(shape, "")
    state = "struct<out:string,i:int>"
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("i")).cast(state)

    def step(acc: Column, c: Column) -> Column:
        is_digit = c.rlike(r"^\d$")
        return F.struct(F.concat(acc["out"], F.when(is_digit, F.substring(digits, acc["i"], F.lit(1))).otherwise(c)).alias("out"), (acc["i"] + is_digit.cast("int")).alias("i")).cast(state)

    return F.aggregate(chars, start, step)["out"]


def _luhn_sum(digits: Column, doubled: int) -> Column:
    """Sum with every second digit doubled, from the right; ``doubled`` is the parity of the doubled places."""
    d = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(F.pmod(i, F.lit(2)) == doubled, let(c.cast("int") * 2, lambda x: x - F.when(x > 9, 9).otherwise(0))).otherwise(c.cast("int")))
    return F.aggregate(d, F.lit(0), lambda a, x: a + x)


def luhn_valid(digits: Column) -> Column:
    return F.pmod(_luhn_sum(digits, 1), F.lit(10)) == 0


def _card(s: Column, key: str) -> Column:
    def run(d: Column) -> Column:
        body = F.concat(F.substring(d, 1, 1), _permute_digits(F.substr(d, F.lit(2), F.length(d) - 2), key, "card"))
        return let(body, lambda b: F.concat(b, F.pmod(10 - F.pmod(_luhn_sum(b, 0), F.lit(10)), F.lit(10)).cast("string")))

    return _refill(s, let(_digits(s), run))


def _cards(s: Column, key: str) -> Column:
    """A run of digit groups with its cards rewritten: from each group on, the longest valid number of 13 to 19 digits that ends with a group."""

    def walk(groups: Column) -> Column:
        piece = lambda i, n: F.array_join(F.slice(groups, i + 1, n), "")

        def longest(g: Column, i: Column) -> Column:
            def valid(n: Column) -> Column:
                return let(_digits(piece(i, n)), lambda d: F.when(F.length(d).between(13, 19), luhn_valid(d)).otherwise(F.lit(False)))

            return F.coalesce(F.array_max(F.filter(F.sequence(F.lit(1), F.least(F.size(groups) - i, F.lit(19))), valid)), F.lit(0))

        def chosen(sizes: Column) -> Column:
            """Places and sizes of the cards, from the left, without overlap; the state grows with the cards only."""
            state = "struct<next:int,taken:array<struct<i:int,n:int>>>"
            start = F.struct(F.lit(0).alias("next"), F.array().cast("array<struct<i:int,n:int>>").alias("taken")).cast(state)
            places = F.filter(F.transform(sizes, lambda n, i: F.struct(i.alias("i"), n.alias("n"))), lambda x: x["n"] > 0)
            step = lambda acc, x: F.when(x["i"] < acc["next"], acc).otherwise(F.struct((x["i"] + x["n"]).alias("next"), F.concat(acc["taken"], F.array(x)).alias("taken")).cast(state))
            return F.aggregate(places, start, step)["taken"]

        def written(taken: Column) -> Column:
            end = lambda k: F.coalesce(F.get(taken, k)["i"] + F.get(taken, k)["n"], F.lit(0))
            parts = F.transform(taken, lambda x, k: F.concat(piece(end(k - 1), x["i"] - end(k - 1)), _card(piece(x["i"], x["n"]), key)))
            return F.when(F.size(taken) == 0, s).otherwise(F.concat(F.array_join(parts, ""), piece(end(F.size(taken) - 1), F.size(groups))))

        return let(F.transform(groups, longest), lambda sizes: let(chosen(sizes), written))

    return let(F.regexp_extract_all(s, F.lit(r"[ -]?\d+"), F.lit(0)), walk)


def _date(s: Column, key: str) -> Column:
    """The date in the notation it has; impossible ones stay."""
    first = F.lit(FIRST_DAY).cast("date")

    def read(regex: str, form: str) -> Column:
        day = F.when(s.rlike(f"^{regex}$"), F.datediff(F.to_date(F.try_to_timestamp(s, F.lit(form))), first))
        return let(day, lambda d: F.when((d >= 0) & (d < DAYS), F.struct(d.cast("bigint").alias("day"), F.lit(form).alias("form"))))

    def moved(found: Column) -> Column:
        new = F.date_add(first, permute(found["day"], LEFT, RIGHT, key, "date").cast("int"))
        return F.when(found.isNotNull(), F.call_function("date_format", new.cast("timestamp"), found["form"])).otherwise(s)

    return let(F.coalesce(*[read(*x) for x in DATE_FORMS]), moved)


def _ip(s: Column, key: str) -> Column:
    parts = F.split(s, r"\.")
    value = F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, x: a * 256 + x.cast("bigint"))
    return let(permute(value, 65536, 65536, key, "ip"), lambda v: F.concat_ws(".", *[F.pmod(F.shiftright(v, 24 - 8 * i), F.lit(256)).cast("string") for i in range(4)]))


def _hexed(s: Column, key: str, kind: str) -> Column:
    return F.sha2(F.concat(F.lit(f"{key}|{kind}|"), s), 256)


def _secret(s: Column, key: str) -> Column:
    head = F.regexp_extract(s, r"^([\w-]+[\"']?\s*[=:]\s*[\"']?)", 1)
    tail = F.regexp_extract(s, r"([\"']?)$", 1)
    body = F.regexp_replace(F.substr(s, F.length(head) + 1, F.length(s)), r"[\"']$", "")
    return F.concat(head, F.substr(F.repeat(_hexed(body, key, "secret"), F.ceil(F.length(body) / 64).cast("int")), F.lit(1), F.length(body)), tail)


def _phone(s: Column, key: str) -> Column:
    """Calling codes stay; all other digits are permuted."""
    code = F.regexp_extract(s, CALLING, 0)
    rest = F.substr(s, F.length(code) + 1, F.length(s))
    return F.concat(code, let(rest, lambda r: _refill(r, _permute_digits(_digits(r), key, "phone"))))


def _ssn(s: Column, key: str) -> Column:
    """A permutation of the valid numbers."""

    def run(d: Column) -> Column:
        area = F.substring(d, 1, 3).cast("bigint")
        place = F.when(area > 666, area - 2).otherwise(area - 1) * SERIALS + (F.substring(d, 4, 2).cast("bigint") - 1) * 9999 + F.substring(d, 6, 4).cast("bigint") - 1
        return let(permute(place, AREAS, SERIALS, key, "ssn"), written)

    def written(x: Column) -> Column:
        area, rest = F.floor(x / SERIALS), F.pmod(x, F.lit(SERIALS))
        return F.format_string("%03d-%02d-%04d", F.when(area < 665, area + 1).otherwise(area + 2), F.floor(rest / 9999) + 1, F.pmod(rest, F.lit(9999)) + 1)

    return let(_digits(s), run)


def pseudonym(s: Column, key: str) -> Column:
    """The pseudonym of one matched string, or the string if its number or date isn't valid."""

    def kind(name: str) -> Column:
        return s.rlike(f"^(?:{dict(PATTERNS)[name]})$")

    return (
        F.when(kind("mail"), F.concat(F.lit("user"), F.substring(_hexed(F.lower(s), key, "mail"), 1, 12), F.lit("@example.invalid")))
        .when(kind("secret"), _secret(s, key))
        .when(kind("access_key"), F.concat(F.lit("AKIA"), F.upper(F.substring(_hexed(s, key, "access"), 1, 16))))
        .when(kind("phone"), _phone(s, key))
        .when(kind("ssn"), _ssn(s, key))
        .when(kind("date"), _date(s, key))
        .when(kind("ip"), _ip(s, key))
        .otherwise(_cards(s, key))
    )


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with ``text`` rewritten, and ``n_found`` and ``n_changed`` of its matches.

    Null texts stay null with 0 matches.  Numbers that fail their check and
    impossible dates stay as they are.  Every row stands alone: null ids and
    repeated rows are rewritten alike; no rows give none; other columns stay,
    whatever their names (n_found and n_changed are replaced).
    Bank account numbers (IBAN) and names aren't looked for.
    """
    hits, new = fresh(docs.columns, "hits", "new")
    found = F.regexp_extract_all("text", F.lit(ANY), F.lit(0))
    none = F.array().cast("array<string>")
    split = docs.withColumn(hits, F.when(F.col("text").rlike(TRIGGER), found).otherwise(none))
    named = split.withColumn(new, F.when(F.size(hits) == 0, none).otherwise(F.transform(hits, lambda s: pseudonym(s, key))))
    joined = F.concat_ws("", F.flatten(F.zip_with(F.split("text", ANY, -1), F.col(new), lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))))
    out = [F.col(c) for c in docs.columns if c not in ("text", "n_found", "n_changed")]
    changed = F.size(F.filter(F.zip_with(hits, new, lambda a, b: a != b), lambda x: x))
    return named.select(*out, F.when(F.size(hits) == 0, F.col("text")).otherwise(joined).alias("text"), F.size(hits).cast("bigint").alias("n_found"), changed.cast("bigint").alias("n_changed"))
