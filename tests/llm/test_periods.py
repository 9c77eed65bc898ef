"""Periodic runs against a brute-force version."""

import hashlib
import random
import zlib

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from taxaspark.llm import periods, queries

SF = "/root/testdata/sf0.001"


def plain(words, least=12):
    """Runs by looking at every period and every word."""
    ids = {}
    w = np.array([ids.setdefault(x, len(ids)) for x in words], np.int64)
    out = {}
    for q in range(1, len(w) // 2 + 1):
        same = np.concatenate([[0], (w[:-q] == w[q:]).astype(int), [0]])
        edge = np.diff(same)
        for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
            if b - a + q >= max(least, 2 * q):
                out.setdefault((int(a), int(b - a + q)), q)
    return sorted((a, n, q) for (a, n), q in out.items())


def collapsed(words, runs):
    gone = set()
    for a, n, q in runs:
        gone.update(range(a + q, a + n))
    return b" ".join(w for i, w in enumerate(words) if i not in gone)


def check(texts, least=12):
    for t, (n, runs, rest) in zip(texts, periods._search(texts, least), strict=True):
        words = t.split()
        want = plain(words, least)
        assert n == len(words) and sorted(runs) == want and rest == collapsed(words, want)
        assert runs == sorted(runs, key=lambda r: (r[0], r[2]))


def test_cover():
    assert {(a - b) % periods.MOD for a in periods.COVER for b in periods.COVER} == set(range(periods.MOD))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab", min_size=0, max_size=120), min_size=1, max_size=6), st.integers(2, 12))
def test_small_alphabets(texts, least):
    check([" ".join(t).encode() for t in texts], least)


@pytest.mark.parametrize("seed", range(6))
def test_planted_runs(seed):
    r = random.Random(seed)
    texts = []
    for _ in range(8):
        words = [f"w{r.randrange(r.choice([2, 30, 3000]))}" for _ in range(r.randrange(0, 1500))]
        for _ in range(r.randrange(4)):
            unit = [f"u{r.randrange(5)}" for _ in range(r.randrange(1, 90))]
            at = r.randrange(len(words) + 1)
            words[at:at] = (unit * 9)[: r.randrange(2, 9 * len(unit) + 1)]
        texts.append(" ".join(words).encode())
    check([*texts, b"", b" \t ", b"a " * 4000, b"a b a b a a b " * 300])


def test_groups_and_blocks(monkeypatch):
    monkeypatch.setattr(periods, "TOGETHER", 50)
    monkeypatch.setattr(periods, "POINTS", 64)
    check([b"x y z " * k + b"end " * (k % 17) for k in range(40)])


def test_extensions():
    r = np.random.default_rng(3)
    words = r.integers(1, 3, 700)
    words[300:600] = words[20:320]
    words[100:160] = 1
    at = periods.Extensions(words)
    i, j = r.integers(0, 700, 4000), r.integers(0, 701, 4000)
    i, j = i[i != j], j[i != j]
    for a, b, n in zip(i.tolist(), j.tolist(), at.common(i, j).tolist()):
        k = 0
        while max(a, b) + k < 700 and words[a + k] == words[b + k]:
            k += 1
        assert n == k


def expected(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = sorted(plain(words), key=lambda r: (r[0], r[2]))
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (len(runs), *(best or (None,) * 3), best[1] * 1000 // best[2] if best else None, sha("".join(f"{a},{n},{q}\n" for a, n, q in runs).encode()), sha(collapsed(words, runs)))


def rows_of(df):
    return sorted(((r["doc_id"], *(r[c] for c in ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"))) for r in df.collect()), key=str)


def test_query_as_brute_force(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    want = sorted(((d, *expected(d, t)) for d, t in zip(docs.doc_id.tolist(), docs.text.tolist())), key=str)
    got = rows_of(queries.op13_runs(spark, SF))
    assert got == want and sum(r[1] > 0 for r in got) > 10


def test_odd_rows(spark):
    texts = [(None, "a b " * 20), (28, None), (28, ""), (28, " \n "), (5, "x " * 30), (5, "x " * 30), (14, "ñ 東 " * 9), *((i, "a b c d e f g " * 20) for i in range(40))]
    docs = spark.createDataFrame([(i, t, 1, "r") for i, t in texts], "doc_id long, text string, n_words long, runs string")
    assert rows_of(periods.run_digests(periods.find_runs(periods.with_planted(docs)))) == sorted(((d, *expected(d, t)) for d, t in texts), key=str)
    assert periods.find_runs(docs.limit(0)).count() == 0
