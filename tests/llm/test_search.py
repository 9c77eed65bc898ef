"""Ranked search against a brute-force version."""

import math
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from taxaspark.llm import search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall((text or "").translate(str.maketrans(search.UPPER, search.LOWER)))


def plain(docs, items, k=10):
    held = [(d, Counter(terms(t))) for d, t in docs]
    held = [(d, c, sum(c.values())) for d, c in held if c]
    n, words = len(held), sum(x for _, _, x in held)
    df = Counter(t for _, c, _ in held for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * f + 1))) for t, f in df.items()}
    out = []
    for item, text in items:
        scored = []
        for d, c, size in held:
            m = 25 + 75 * size * n // words
            score = sum(weight[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if score > 0:
                scored.append((-score, d is not None, d or 0))
        out.extend((item, r, d if some else None, -s) for r, (s, some, d) in enumerate(sorted(scored)[:k], 1))
    return sorted(out, key=str)


def tables(spark, docs, items, parts=3):
    d = spark.createDataFrame([(i, t, 1, 2, "x", 3) for i, t in docs], "doc_id long, text string, row long, n int, terms string, item int").repartition(parts, F.xxhash64("doc_id", "text"))
    return d, spark.createDataFrame([(i, t, "y", 4) for i, t in items], "item_id long, text string, term string, q int")


def check(spark, docs, items, k=10):
    got = search.search(*tables(spark, docs, items), k).collect()
    assert sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got), key=str) == plain(docs, items, k)


def corpus(seed, n):
    r = random.Random(seed)
    names = [f"t{i}" for i in range(60)] + ["Été", "東京", "Straße", "ÀB"]
    weights = [1 / (i + 1) for i in range(len(names))]
    return r, [(i, " ".join(x.upper() if r.random() < 0.2 else x for x in r.choices(names, weights, k=r.choice([0, 1, 5, 40, 200])))) for i in range(n)]


@pytest.mark.parametrize("seed,block,opened", [(1, 8192, 64), (2, 16, 4), (3, 5, 1)])
def test_as_brute_force(spark, monkeypatch, seed, block, opened):
    monkeypatch.setattr(search, "BLOCK", block)
    monkeypatch.setattr(search, "OPENED", opened)
    r, docs = corpus(seed, 300)
    docs += [(1000 + i, docs[7][1]) for i in range(40)]  # exact copies tie
    items = [(i, " ".join(r.choices(docs[r.randrange(300)][1].split() or ["t1"], k=r.choice([1, 3, 30])))) for i in range(25)]
    check(spark, docs, items)


def test_odd_rows(spark):
    docs = [(None, "a b"), (None, "a b"), (3, "A-b_a"), (3, None), (4, ""), (5, "c " * 3000), (6, "A" * 5000), (7, "\x00a\x7fb")]
    items = [(1, "a a b"), (1, "c"), (None, "b"), (2, None), (3, "zzz"), (4, "A" * 5000)]
    check(spark, docs, items)
    check(spark, docs, items, k=1)


def test_empty_tables(spark):
    d, i = tables(spark, [(1, "a")], [(1, "a")])
    assert search.search(d.limit(0), i).count() == search.search(d, i.limit(0)).count() == 0


def test_queries_in_slices(spark, monkeypatch):
    monkeypatch.setattr(search, "TOGETHER", 3)
    r, docs = corpus(9, 60)
    check(spark, docs, [(i, f"t{i} t{i + 1} t1") for i in range(11)])


def test_search_opens_few_and_drops_none():
    """Most documents are never scored, and the best are those of an exhaustive scan."""
    r = np.random.default_rng(5)
    rows = [(d, d, 50, t, int(f)) for d in range(4000) for t, f in zip(r.choice(400, 12, replace=False) + 1, r.integers(1, 4, 12))]
    rows += [(d, d, 50, 0, 1) for d in range(4000)]
    frame = pd.DataFrame(rows, columns=["row", "doc_id", "n", "tid", "tf"])
    weights = {t: 1000 + 7 * t for t in range(1, 401)}
    block = search.Block(frame, weights, 4000, 200_000)
    query = [(int(t), 1 + int(t) % 2) for t in r.choice(400, 8, replace=False) + 1]
    at, scores, opened = block.best(query, 10, 0, None)
    full = np.zeros(4000, np.int64)
    for t, q in query:
        _, a, b = block.lists[t]
        np.add.at(full, block.doc[a:b], q * block.impact[a:b])
    want = np.lexsort((np.arange(4000), -full))[:10]
    assert at.tolist() == want.tolist() and scores.tolist() == full[want].tolist()
    assert opened < np.count_nonzero(full)
