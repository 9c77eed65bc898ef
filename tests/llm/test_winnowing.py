"""Winnowing against a brute-force version, and its match guarantee."""

import hashlib
import re
import zlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from taxaspark.llm import winnowing as w

SCHEMA = "doc_id long, text string, __picks string, key long, range int, copy string"


def plain(text, k=w.K, win=w.W):
    """(hash, position) of each pick, by rolling the hash and looking at each window."""
    t = [zlib.crc32(x.encode()) for x in re.findall(r"[^\x20\x09-\x0D]{1,%d}" % w.TOKEN, text)]
    if len(t) < k:
        h = 0
        for x in t:
            h = (h * w.BASE + x) % w.PRIME
        grams = [h] if t else []
    else:
        h, out = 0, pow(w.BASE, k - 1, w.PRIME)
        grams = []
        for i, x in enumerate(t):
            if i >= k:
                h -= t[i - k] * out
            h = (h * w.BASE + x) % w.PRIME
            if i >= k - 1:
                grams.append(h)
    picked = []
    for a in range(max(1, len(grams) - win + 1) if grams else 0):
        i = min(range(a, min(a + win, len(grams))), key=lambda i: (grams[i], -i))
        if not picked or picked[-1][1] != i:
            picked.append((grams[i], i))
    return picked


def jaccard(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def rows(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1, 2, "c") for i, t in texts], SCHEMA)


TEXTS = [(5, "one two three four five six seven eight nine ten " * 6), (1, None), (9, ""), (2, " \t\n "), (4, "a b"), (7, "ñandú 東京 " * 40 + "x" * 300), (8, "same same " * 60), (3, "p q r s t"), (6, " ".join(f"w{i * i % 83}" for i in range(4000)))]


@pytest.mark.parametrize("k,win", [(w.K, w.W), (1, 4), (3, 1), (2, 2)])
def test_picks_as_brute_force(spark, k, win):
    got = {r["doc_id"]: list(zip(r["hashes"], r["positions"])) for r in w.fingerprints(rows(spark, TEXTS), k, win).collect()}
    assert got == {i: plain(t or "", k, win) for i, t in TEXTS}


def check(spark, texts, docs=None):
    ordered = sorted(texts)
    want = {}
    for n, (i, t) in enumerate(ordered):
        t, after = t or "", ordered[(n + 1) % len(ordered)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        want[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), jaccard(plain(t), plain(edited)), jaccard(plain(t), plain(after)))
    got = w.edited_likeness(docs or rows(spark, texts)).collect()
    assert {r["doc_id"]: (r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]) for r in got} == want
    assert len(got) == len(texts)
    return got


def test_edits_as_brute_force(spark):
    got = check(spark, TEXTS)
    assert len({r["fingerprint"] for r in got}) == 7  # the three without tokens are alike


def test_ranges_keep_neighbours(spark, monkeypatch):
    monkeypatch.setattr(w, "RANGE_ROWS", 3)
    texts = [(i * 7 % 101, f"d{i % 5} " * (i % 9) + f"e{i}") for i in range(101)]
    check(spark, texts)
    check(spark, texts[:1])


def test_tables_on_disk(spark):
    docs = pd.read_parquet("/root/testdata/sf0.001/documents.parquet")
    check(spark, list(zip(docs.doc_id.tolist(), docs.text.tolist())), spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


def test_null_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(w, "RANGE_ROWS", 2)
    texts = [(None, "a b c"), (None, "a b c"), (None, "d e"), (3, "x"), (3, "x"), (3, None)]
    out = w.edited_likeness(rows(spark, texts)).collect()
    assert sorted((r["doc_id"] is None, r["n_chars"]) for r in out) == [(False, 0), (False, 1), (False, 1), (True, 3), (True, 5), (True, 5)]
    assert w.edited_likeness(rows(spark, [])).count() == 0


def test_shared_runs_share_a_pick(spark):
    run = [f"r{i}" for i in range(w.W + w.K - 1)]
    a = " ".join([f"a{i}" for i in range(50)] + run + [f"b{i}" for i in range(50)])
    b = " ".join([f"c{i}" for i in range(31)] + run + [f"d{i}" for i in range(77)])
    one, two = (set(r["hashes"]) for r in w.fingerprints(rows(spark, [(1, a), (2, b)])).orderBy("doc_id").collect())
    assert one & two


def test_plan_has_no_python(spark):
    plan = w.edited_likeness(rows(spark, TEXTS).withColumn("text", F.col("text")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan
