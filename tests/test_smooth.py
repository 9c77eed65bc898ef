"""Running scales and local regression against plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from taxaspark.functions.moments import c4_value
from taxaspark.plans import evaluate, smooth


def test_scales_of_each_row(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.choice(["a", '["a","?x"]', "b"]), 1e6 + rnd.gauss(0, 0.01 if i % 2 else 3)) for i in range(400)] + [(401, "c", None)]
    df = spark.createDataFrame(rows, "t long, attr string, nval double").repartition(7)
    got = {r["t"]: r for r in smooth.running_scales(df, "t").collect()}
    seen = {}
    for t, attr, v in rows[:-1]:
        inner = "a" if attr.startswith("[") else attr
        held = seen.setdefault(inner, [])
        held.append(v)
        n = len(held)
        std = 0.0 if n < 2 else np.std(held, ddof=1) / (c4_value(n) if n < 30 else 1)
        r = got.pop(t)
        assert (r["inner"], r["num"]) == (inner, n) and r["mean"] == pytest.approx(np.mean(held), rel=1e-12)
        assert r["scale"] == pytest.approx(std / 0.5 if std > 0 else 1.0, rel=1e-5)
    assert not got and smooth.running_scales(df.limit(0), "t").count() == 0


def direct(x, y, share, rounds):
    n = len(x)
    r = math.ceil(share * n)
    h = np.array([np.sort(np.abs(x - v))[r] for v in x])
    w = (1 - np.clip(np.abs((x[:, None] - x[None, :]) / h), 0, 1) ** 3) ** 3
    delta = np.ones(n)
    for _ in range(rounds):
        out = np.zeros(n)
        for i in range(n):
            v = delta * w[:, i]
            a = np.array([[v.sum(), (v * x).sum()], [(v * x).sum(), (v * x * x).sum()]])
            b = np.linalg.solve(a, [(v * y).sum(), (v * x * y).sum()])
            out[i] = b[0] + b[1] * x[i]
        res = y - out
        s = np.sort(np.abs(res))[(n - 1) // 2]  # the lower one of two medians
        delta = (1 - np.clip(res / (6 * s), -1, 1) ** 2) ** 2
    return out, res


@pytest.mark.parametrize("share", [1 / 3, 0.6])
def test_lowess_as_a_loop(spark, share):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 40, 301).astype(float)
    y = np.sin(x / 6) + rng.normal(0, 0.3, 301) + np.where(rng.random(301) < 0.05, 8, 0)
    want, res = direct(x, y, share, 3)
    df = spark.createDataFrame([*zip(x.tolist(), y.tolist()), (None, 1.0), (2.0, None)], "hour double, v double")
    got = {r["x"]: r for r in smooth.lowess(df, "hour", "v", share).collect()}
    assert set(got) == set(x.tolist())
    for v, r in got.items():
        mine = x == v
        assert r["n"] == mine.sum() and r["smooth"] == pytest.approx(want[mine][0], abs=1e-8)
        if r["n"] > 1:
            half = math.sqrt((res[mine] ** 2).mean()) / math.sqrt(r["n"]) * evaluate.t_quantile(0.975, int(r["n"]) - 1)
            assert r["half_width"] == pytest.approx(half, rel=1e-6)


def test_lowess_of_few_points(spark):
    one = smooth.lowess(spark.createDataFrame([(1.0, 5.0)], "x double, y double"), "x", "y").first()
    assert (one["n"], one["smooth"], one["half_width"]) == (1, 5.0, None)
    same = smooth.lowess(spark.createDataFrame([(1.0, 4.0), (1.0, 6.0)], "x double, y double"), "x", "y").first()
    assert same["smooth"] == pytest.approx(5.0)
    empty = spark.range(0).select(F.col("id").cast("double").alias("x"), F.col("id").cast("double").alias("y"))
    assert smooth.lowess(empty, "x", "y").count() == 0
