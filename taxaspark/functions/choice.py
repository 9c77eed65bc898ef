"""Choices among weighted values, deterministic for ties and seeds."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def most_likely(weighted: DataFrame, keys: list[str], weight: str = "p", value: str = "val") -> DataFrame:
    """The row of greatest weight for each key; ties go to the smallest value, null last."""
    order = Window.partitionBy(*keys).orderBy(F.col(weight).desc(), F.col(value).asc_nulls_last())
    return weighted.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")


def sampled(weighted: DataFrame, keys: list[str], seed: int, weight: str = "p", value: str = "val") -> DataFrame:
    """One row for each key, drawn in proportion to its weight by a number that ``seed`` and the key determine; a negative weight is an error."""
    weighted = weighted.withColumn(weight, F.when(F.col(weight) < 0, F.raise_error(F.lit("a weight is negative")).cast("double")).otherwise(F.col(weight)))
    w = Window.partitionBy(*keys)
    upto = F.sum(weight).over(w.orderBy(F.col(value).asc_nulls_last()))
    draw = F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 53)) / float(1 << 53)
    rows = weighted.filter(F.col(weight) > 0).withColumn("_u", upto).withColumn("_d", draw * F.sum(weight).over(w)).filter("_u > _d")
    return rows.withColumn("_r", F.row_number().over(w.orderBy("_u"))).filter("_r = 1").drop("_u", "_d", "_r")


def drawn_normal(seed: int, *keys: str) -> Column:
    """A standard normal number that ``seed`` and the keys determine, from two uniform ones."""
    u = [(F.pmod(F.xxhash64(F.lit(seed), F.lit(i), *keys), F.lit(1 << 53)) + 1) / float((1 << 53) + 1) for i in (1, 2)]
    return F.sqrt(-2 * F.ln(u[0])) * F.cos(2 * math.pi * u[1])
