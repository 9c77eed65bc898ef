"""Toxicity scores and pseudonyms against plain versions of their own."""

import datetime
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from taxaspark.llm import pii, toxicity

KEY = "of the tests"


def buckets(text):
    """Hashed n-grams of 3 to 6 characters, one by one."""
    s, out, full = " " + " ".join(text.lower().split()) + " ", set(), (1 << 64) - 1
    for n in (3, 4, 5, 6):
        for i in range(len(s) - n + 1):
            h = 0
            for c in s[i : i + n]:
                h = (h * 0x9E3779B97F4A7C15 + ord(c) + 1) & full
            out.add((((h ^ h >> 29) * 0xBF58476D1CE4E5B9) & full) >> 44)
    return out


def test_toxicity_as_a_plain_classifier(spark):
    rnd = random.Random(3)
    clean, bad = "river stone light meadow quiet harbour walks early window garden".split(), "scumbag loser idiot trash vermin".split()
    docs, labels = [], []
    for i in range(200):
        y = i % 4 == 0
        words = [rnd.choice(clean) for _ in range(rnd.randrange(3, 25))] + ([rnd.choice(bad) for _ in range(3)] if y else [])
        rnd.shuffle(words)
        docs.append((i, " ".join(words)))
        labels.append((i, int(y) if i % 17 else 1 - int(y)))
    docs += [(900, None), (901, ""), (902, "Scumbag  IDIOT"), (903, "ünïcödé 東京")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    s = toxicity.SETTINGS
    got = {r["doc_id"]: r for r in toxicity.score(d, toxicity.train(d, spark.createDataFrame(labels, "doc_id long, toxic int"))).collect()}

    learn = [(buckets(docs[i][1]), y) for i, y in labels if zlib.crc32(str(i).encode()) % 3 != 1]
    n = [sum(y == c for _, y in learn) for c in (0, 1)]
    count = [Counter(b for f, y in learn if y == c for b in f) for c in (0, 1)]
    known = sorted(b for b in count[0] | count[1] if count[0][b] + count[1][b] >= s["least_docs"])
    total = [sum(count[c][b] for b in known) + len(known) for c in (0, 1)]
    ratio = {b: math.log((count[1][b] + 1) / total[1]) - math.log((count[0][b] + 1) / total[0]) for b in known}

    def z(b):
        p1, p0, p = count[1][b] / n[1], count[0][b] / n[0], (count[0][b] + count[1][b] + 1) / (n[0] + n[1] + 2)
        return abs(p1 - p0) / math.sqrt(max(p * (1 - p), 1e-9) * (1 / n[1] + 1 / n[0]))

    best = sorted(known, key=lambda b: (-z(b), b))[: min(s["features"], sum(z(b) >= s["least_z"] for b in known))]
    assert len(best) > 20
    w, b0 = dict.fromkeys(best, 0.0), math.log((n[1] + 1e-9) / (n[0] + 1e-9))
    m, v, mb, vb = dict.fromkeys(best, 0.0), dict.fromkeys(best, 0.0), 0.0, 0.0
    rows = [([b for b in best if b in f], y) for f, y in learn]
    for t in range(1, 301):  # full-batch Adam
        g, gb = {b: s["penalty"] * w[b] for b in best}, 0.0
        for f, y in rows:
            e = (1 / (1 + math.exp(-(b0 + sum(w[b] * ratio[b] for b in f)))) - y) / len(rows)
            gb += e
            for b in f:
                g[b] += e * ratio[b]
        rate = 0.15 / math.sqrt(t)
        for b in best:
            m[b], v[b] = 0.9 * m[b] + 0.1 * g[b], 0.999 * v[b] + 0.001 * g[b] ** 2
            w[b] -= rate * (m[b] / (1 - 0.9**t)) / (math.sqrt(v[b] / (1 - 0.999**t)) + 1e-9)
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        b0 -= rate * (mb / (1 - 0.9**t)) / (math.sqrt(vb / (1 - 0.999**t)) + 1e-9)
    for i, text in docs:
        found = buckets(text or "")
        want = 1 / (1 + math.exp(-(b0 + sum(w[b] * ratio[b] for b in best if b in found))))
        assert got[i]["score"] == pytest.approx(want, abs=1e-6) and got[i]["predicted"] == int(got[i]["score"] >= 0.7)
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)


def prf(*parts):
    return int(hashlib.sha256("|".join(map(str, (KEY, *parts))).encode()).hexdigest()[:15], 16)


def feistel(tag, a, mod_a, b, mod_b):
    for i in range(2 * pii.ROUNDS):
        if i % 2 == 0:
            a = (a + prf(tag, i, b)) % mod_a
        else:
            b = (b + prf(tag, i, a)) % mod_b
    return a, b


def luhn(digits):
    return sum(d if j % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for j, d in enumerate(map(int, reversed(digits)))) % 10


def into(template, digits):
    it = iter(digits)
    return re.sub("[0-9]", lambda _: next(it), template)


def card(m):
    d = re.sub(r"\D", "", m)
    if luhn(d):
        return m
    free = len(d) - 1
    cut = free // 2
    a, b = feistel(f"card{len(d)}", int(d[:cut]), 10**cut, int(d[cut:free]), 10 ** (free - cut))
    body = f"{a:0{cut}d}{b:0{free - cut}d}"
    return into(m, body + str(-luhn(body + "0") % 10))


def phone(m):
    d = re.sub(r"\D", "", m)
    ten, prefix = d[-10:], d[:-10]
    area, exchange, line = int(ten[:3]), int(ten[3:6]), int(ten[6:])
    if area >= 200 and exchange >= 200:
        a, b = feistel("phone", area - 200, 800, (exchange - 200) * 10000 + line, 8_000_000)
        return into(m, f"{prefix}{a + 200}{b // 10000 + 200}{b % 10000:04d}")
    if len(d) < 11:
        return m
    place = area * 1000 + exchange if area < 200 else 200_000 + (area - 200) * 200 + exchange
    a, b = feistel("phone outside", place, 360_000, line, 10_000)
    x, y = divmod(a, 1000) if a < 200_000 else ((a - 200_000) // 200 + 200, (a - 200_000) % 200)
    return into(m, f"{prefix}{x:03d}{y:03d}{b:04d}")


def ssn(m):
    area, group, serial = map(int, m.split("-"))
    if not (1 <= area <= 899 and area != 666 and group and serial):
        return m
    a, b = feistel("ssn", area - (2 if area > 666 else 1), 898, (group - 1) * 9999 + serial - 1, 99 * 9999)
    return f"{a + (2 if a >= 665 else 1):03d}-{b // 9999 + 1:02d}-{b % 9999 + 1:04d}"


def ip(m):
    o = list(map(int, m.split(".")))
    if max(o) > 255:
        return m
    a, b = feistel("ip", o[0] * 256 + o[1], 65536, o[2] * 256 + o[3], 65536)
    return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"


def date(m):
    for form in ("%Y-%m-%d",) if "-" in m else ("%d/%m/%Y", "%m/%d/%Y"):
        try:
            day = datetime.datetime.strptime(m, form).date()
        except ValueError:
            continue
        i = (day - datetime.date(1900, 1, 1)).days
        if not 0 <= i < 17 * 4297:
            return m
        a, b = feistel("date", i // 4297, 17, i % 4297, 4297)
        return (datetime.date(1900, 1, 1) + datetime.timedelta(a * 4297 + b)).strftime(form)
    return m


def email(m):
    """An address counts up to the first label that may be a top-level domain, which stays, as does what follows it."""
    local, domain = m.split("@")
    labels = domain.split(".")
    at = next(i for i in range(1, len(labels)) if re.fullmatch("[A-Za-z]{2,}", labels[i]))
    body, end = f"{local}@{'.'.join(labels[:at])}", ".".join(labels[at:])
    a, b = body[: len(body) // 2], body[len(body) // 2 :]

    def shifted(half, stream):
        out = ""
        for j, c in enumerate(half):
            k = int(stream[2 * (j % 32) : 2 * (j % 32) + 2], 16)
            low, n = ("0", 10) if c in "0123456789" else ("a", 26) if "a" <= c <= "z" else ("A", 26) if "A" <= c <= "Z" else ("", 0)
            out += chr(ord(low) + (ord(c) - ord(low) + k) % n) if n else c
        return out

    for i in range(pii.ROUNDS):
        stream = lambda other: hashlib.sha256("|".join((KEY, "email", str(i), str(len(body)), other)).encode()).hexdigest()  # noqa: B023, E731
        if i % 2 == 0:
            a = shifted(a, stream(b))
        else:
            b = shifted(b, stream(a))
    return f"{a}{b}.{end}"


def test_pseudonyms_as_a_plain_feistel(spark):
    rnd = random.Random(7)
    digits = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    values = [(card, "4111 1111 1111 1111"), (card, "378282246310005"), (card, "4111-1111-1111-1112"), (phone, "+1 (415) 555-0199"), (phone, "+1 (017) 555-7713"), (phone, "(415) 155-0199"), (ssn, "666-12-3456"), (ip, "10.0.0.256"), (date, "1999-02-30"), (date, "1700-01-01"), (date, "31/12/2001"), (date, "12/31/2001"), (date, "2099-12-31")]
    for _ in range(40):
        body = digits(rnd.choice([12, 15, 18]))
        values += [(card, body + str(-luhn(body + "0") % 10)), (phone, f"+1 ({digits(3)}) {digits(3)}-{digits(4)}"), (ssn, f"{digits(3)}-{digits(2)}-{digits(4)}"), (ip, ".".join(str(rnd.randrange(256)) for _ in range(4)))]
        values += [(date, f"{rnd.randrange(1900, 2100)}-{rnd.randrange(1, 13):02d}-{rnd.randrange(1, 29):02d}"), (email, f"{rnd.choice(['ann', 'Bob7', 'c.d', 'X_y-9'])}{digits(2)}@mail{digits(1)}.example.{rnd.choice(['org', 'com'])}")]
    df = spark.createDataFrame([(i, f"see {v}, and {v}.") for i, (_, v) in enumerate(values)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.pseudonymise(df, KEY).collect()}
    changed = 0
    for i, (plain, v) in enumerate(values):
        new = plain(v)
        changed += new != v
        assert got[i]["text"] == f"see {new}, and {new}.", v
        assert (got[i]["n_found"], got[i]["n_replaced"]) == (2, 0 if new == v else 2), v
    assert changed > 200
