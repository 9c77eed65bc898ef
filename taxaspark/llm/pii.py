"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Card numbers (Luhn), social security numbers, North American phone numbers, IPv4 addresses, calendar dates and
e-mail addresses are found by one pattern, validated, and replaced by a keyed permutation of their own format: an
alternating Feistel network over two mixed-radix halves. The same value and key give the same pseudonym in every
document, distinct values stay distinct, and a pseudonym is again a valid value of its kind. A phone number whose area or
exchange is under 200 has a permutation of its own, among such numbers, if it is written with the country code.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxaspark.llm.common import text_or_empty

ROUNDS = 8
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*?\.[A-Za-z]{2,}+(?![A-Za-z0-9-])"
IP = r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)"
DATE = r"(?<![\d/-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4})(?![\d/-])"
PHONE = r"(?<![\d+(])(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
CARD = r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)"
PATTERN = "|".join(f"(?:{p})" for p in (EMAIL, IP, DATE, PHONE, SSN, CARD))
#: 1900-01-01 to 2099-12-31 is 17 * 4297 days.
FIRST_DAY, DAYS_A, DAYS_B = "1900-01-01", 17, 4297


def _number(digits: Column) -> Column:
    return F.when(F.length(digits) > 0, digits.cast("long")).otherwise(F.lit(0).cast("long"))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, r"\D", "")


def _prf(key: str, *parts: Column) -> Column:
    """A keyed pseudo-random long below 2^60."""
    text = F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts])
    return F.conv(F.substr(F.sha2(text, 256), F.lit(1), F.lit(15)), 16, 10).cast("long")


def feistel(key: str, tag: Column, a: Column, mod_a: Column, b: Column, mod_b: Column) -> Column:
    """struct(a, b): a keyed permutation of {0..mod_a-1} x {0..mod_b-1}; each modulus is below 2^31."""
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))

    def step(acc: Column, i: Column) -> Column:
        left = F.when(i % 2 == 0, F.pmod(acc["a"] + _prf(key, tag, i, acc["b"]), mod_a)).otherwise(acc["a"])
        right = F.when(i % 2 == 1, F.pmod(acc["b"] + _prf(key, tag, i, acc["a"]), mod_b)).otherwise(acc["b"])
        return F.struct(left.cast("long").alias("a"), right.cast("long").alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(2 * ROUNDS - 1)), start, step)


def _shifted(half: Column, stream: Column) -> Column:
    """``half`` with letters and digits shifted within their class by the bytes of the hexadecimal ``stream``."""

    def one(c: Column, j: Column) -> Column:
        k = F.conv(F.substr(stream, 1 + 2 * (j % 32), F.lit(2)), 16, 10).cast("int")

        def turned(base: str, n: int) -> Column:
            return F.chr((F.lit(ord(base)) + (F.ascii(c) - ord(base) + k) % n).cast("long"))

        return F.when(c.rlike("[0-9]"), turned("0", 10)).when(c.rlike("[a-z]"), turned("a", 26)).when(c.rlike("[A-Z]"), turned("A", 26)).otherwise(c)

    return F.array_join(F.transform(F.split(half, ""), one), "")


def permuted_text(key: str, tag: str, text: Column) -> Column:
    """A keyed permutation of ``text`` that keeps each character's class and place: digits, upper and lower case."""
    cut = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(F.substr(text, F.lit(1), cut).alias("a"), F.substr(text, cut + 1, F.length(text)).alias("b"))

    def step(acc: Column, i: Column) -> Column:
        def stream(other: Column) -> Column:
            return F.sha2(F.concat_ws("|", F.lit(key), F.lit(tag), i.cast("string"), F.length(text).cast("string"), other), 256)

        left = F.when(i % 2 == 0, _shifted(acc["a"], stream(acc["b"]))).otherwise(acc["a"])
        right = F.when(i % 2 == 1, _shifted(acc["b"], stream(acc["a"]))).otherwise(acc["b"])
        return F.struct(left.alias("a"), right.alias("b"))

    done = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)
    return F.concat(done["a"], done["b"])


def _luhn_sum(digits: Column, doubled_parity: int) -> Column:
    """Luhn sum; the digits at an odd distance (``doubled_parity`` 1) or an even one (0) from the end are doubled."""
    chars = F.split(F.reverse(digits), "")

    def add(acc: Column, x: Column) -> Column:
        return (acc + x).cast("long")

    def value(c: Column, j: Column) -> Column:
        d = c.cast("long")
        return F.when(j % 2 == doubled_parity, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.transform(F.filter(chars, lambda c: c != ""), value), F.lit(0).cast("long"), add)


def _into(template: Column, digits: Column) -> Column:
    """``template`` with its digits replaced, in order, by ``digits``."""

    def one(c: Column, j: Column) -> Column:
        before = F.length(_digits(F.substr(template, F.lit(1), j)))
        return F.when(c.rlike("[0-9]"), F.substr(digits, before + 1, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.split(template, ""), one), "")


def _padded(x: Column, n) -> Column:
    return F.lpad(x.cast("string"), n, "0")


def _card(key: str, m: Column) -> Column:
    d = _digits(m)
    free = F.length(d) - 1
    cut = F.floor(free / 2).cast("int")
    ten = F.lit(10).cast("double")
    out = feistel(key, F.concat(F.lit("card"), F.length(d).cast("string")), _number(F.substr(d, F.lit(1), cut)), F.pow(ten, cut).cast("long"), _number(F.substr(d, cut + 1, free - cut)), F.pow(ten, free - cut).cast("long"))
    payload = F.concat(_padded(out["a"], cut), _padded(out["b"], free - cut))
    check = F.pmod(10 - _luhn_sum(payload, 0) % 10, F.lit(10)).cast("string")
    return F.when(_luhn_sum(d, 1) % 10 == 0, _into(m, F.concat(payload, check)))


def _phone(key: str, m: Column) -> Column:
    d = _digits(m)
    ten = F.substr(d, F.length(d) - 9, F.lit(10))
    prefix = F.substr(d, F.lit(1), F.length(d) - 10)
    area, exchange, line = (_number(F.substr(ten, F.lit(i), F.lit(n))) for i, n in ((1, 3), (4, 3), (7, 4)))
    out = feistel(key, F.lit("phone"), area - 200, F.lit(800), (exchange - 200) * 10000 + line, F.lit(8_000_000))
    new = F.concat(prefix, (out["a"] + 200).cast("string"), (F.floor(out["b"] / 10000) + 200).cast("string"), _padded(out["b"] % 10000, 4))
    # numbers outside the plan: areas under 200 with any exchange, then the other areas with exchanges under 200
    place = F.when(area < 200, area * 1000 + exchange).otherwise(200_000 + (area - 200) * 200 + exchange)
    odd = feistel(key, F.lit("phone outside"), place, F.lit(360_000), line, F.lit(10_000))
    rest = odd["a"] - 200_000
    low = odd["a"] < 200_000
    odd_area = F.when(low, F.floor(odd["a"] / 1000)).otherwise(F.floor(rest / 200) + 200)
    odd_exchange = F.when(low, odd["a"] % 1000).otherwise(rest % 200)
    outside = F.concat(prefix, _padded(odd_area, 3), _padded(odd_exchange, 3), _padded(odd["b"], 4))
    return F.when((area >= 200) & (exchange >= 200), _into(m, new)).when(F.length(d) == 11, _into(m, outside))


def _ssn(key: str, m: Column) -> Column:
    d = _digits(m)
    area, group, serial = (_number(F.substr(d, F.lit(i), F.lit(n))) for i, n in ((1, 3), (4, 2), (6, 4)))
    index = area - F.when(area > 666, 2).otherwise(1)
    out = feistel(key, F.lit("ssn"), index, F.lit(898), (group - 1) * 9999 + serial - 1, F.lit(99 * 9999))
    new_area = out["a"] + F.when(out["a"] >= 665, 2).otherwise(1)
    new = F.concat(_padded(new_area, 3), _padded(F.floor(out["b"] / 9999) + 1, 2), _padded(out["b"] % 9999 + 1, 4))
    return F.when(area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0), _into(m, new))


def _ip(key: str, m: Column) -> Column:
    o = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    out = feistel(key, F.lit("ip"), o[0] * 256 + o[1], F.lit(65536), o[2] * 256 + o[3], F.lit(65536))
    new = F.concat_ws(".", *[x.cast("long").cast("string") for x in (F.floor(out["a"] / 256), out["a"] % 256, F.floor(out["b"] / 256), out["b"] % 256)])
    return F.when(F.forall(o, lambda x: x < 256), new)


def _date(key: str, m: Column) -> Column:
    iso = m.contains("-")
    day = F.when(iso, F.try_to_date(m, "yyyy-MM-dd")).otherwise(F.coalesce(F.try_to_date(m, "dd/MM/yyyy"), F.try_to_date(m, "MM/dd/yyyy")))
    month_first = F.try_to_date(m, "dd/MM/yyyy").isNull()
    index = F.datediff(day, F.lit(FIRST_DAY).cast("date"))
    out = feistel(key, F.lit("date"), F.floor(index / DAYS_B), F.lit(DAYS_A), index % DAYS_B, F.lit(DAYS_B))
    new = F.date_add(F.lit(FIRST_DAY).cast("date"), (out["a"] * DAYS_B + out["b"]).cast("int"))
    text = F.when(iso, F.date_format(new, "yyyy-MM-dd")).when(month_first, F.date_format(new, "MM/dd/yyyy")).otherwise(F.date_format(new, "dd/MM/yyyy"))
    return F.when(index.between(0, DAYS_A * DAYS_B - 1), text)


def _email(key: str, m: Column) -> Column:
    last = F.length(F.substring_index(m, ".", -1))
    body = F.substr(m, F.lit(1), F.length(m) - last - 1)
    return F.concat(permuted_text(key, "email", body), F.lit("."), F.substring_index(m, ".", -1))


def pseudonym(key: str, m: Column) -> Column:
    """The pseudonym of a match of ``PATTERN``; null where its validation fails."""
    kinds = ((EMAIL, _email), (IP, _ip), (DATE, _date), (PHONE, _phone), (SSN, _ssn), (CARD, _card))
    return reduce(lambda got, kind: got.when(m.rlike(f"^(?:{kind[0]})$"), kind[1](key, m)), kinds[1:], F.when(m.rlike(f"^(?:{kinds[0][0]})$"), kinds[0][1](key, m)))


def _free_names(docs: DataFrame, *names: str) -> list[str]:
    """Column names that ``docs`` doesn't have."""
    taken, out = {c.lower() for c in docs.columns}, []
    for n in names:
        while n in taken:
            n = f"_{n}"
        out.append(n)
    return out


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text`` replaced, and ``n_found``, ``n_replaced`` (long) added.

    A null text stays null with zero counts; an empty one stays empty. Repeated rows are replaced alike. Other columns
    are kept as they are, whatever their names; columns named ``n_found`` or ``n_replaced`` are replaced. Invalid candidates (a failing
    check digit, an impossible date, an octet over 255, a social security number that is never given out) are counted as
    found and left as they are. So are two kinds that may be real: phone numbers without a country code whose area or
    exchange is under 200, and dates outside 1900 to 2099. Out of scope, neither found nor counted: other countries' phone
    and account numbers, IPv6 addresses, and secrets such as access tokens. A text may be of any length.
    ``key`` is a secret: who has it can undo the pseudonyms.
    """
    body = text_or_empty(text)
    some = body.rlike("[0-9@]")
    none = F.array().cast("array<string>")
    old, new = _free_names(docs, "old", "new")
    found = docs.drop("n_found", "n_replaced").withColumn(old, F.when(some, F.regexp_extract_all(body, F.lit(PATTERN), 0)).otherwise(none))
    replaced = found.withColumn(new, F.transform(old, lambda m: pseudonym(key, m)))
    gaps = F.split(body, PATTERN, -1)
    joined = F.array_join(F.zip_with(gaps, F.zip_with(old, new, lambda o, n: F.coalesce(n, o)), lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), "")
    counts = {"n_found": F.size(old).cast("long"), "n_replaced": F.size(F.filter(new, lambda x: x.isNotNull())).cast("long")}
    return replaced.withColumns({text: F.when(F.size(old) > 0, joined).otherwise(F.col(text)), **counts}).drop(old, new)
