"""Moments of numeric attributes: count, mean and sum of squared deviations, mergeable, with small-sample correction."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to this many values the standard deviation is corrected; beyond, the factor counts as one.
CORRECTED_UPTO = 29


def c4_value(n: int) -> float:
    """Expected sample standard deviation of ``n`` normal values over the true one."""
    if n < 2:
        raise ValueError("c4 needs two values or more")
    return math.sqrt(2 / (n - 1)) * math.exp(math.lgamma(n / 2) - math.lgamma((n - 1) / 2)) if n <= CORRECTED_UPTO else 1.0


def c4(n: Column) -> Column:
    """``c4_value`` of a count column; 1 where it is under two."""
    table = F.array(*[F.lit(c4_value(k)) for k in range(2, CORRECTED_UPTO + 1)])
    return F.when(n.between(2, CORRECTED_UPTO), F.get(table, (n - 2).cast("int"))).otherwise(F.lit(1.0))


def moments(value: str = "nval") -> list[Column]:
    """Aggregates num, mean, m2 over a column.

    Where all values are one, the mean is that value and ``m2`` is 0; merged partial results would be off by a rounding.
    """
    v = F.col(value)
    one = (F.min(v) == F.max(v)) & (F.abs(F.min(v)) < float("inf"))
    return [F.count(v).alias("num"), F.when(one, F.min(v).cast("double")).otherwise(F.avg(v)).alias("mean"), F.when(one, 0.0).otherwise(F.var_pop(v) * F.count(v)).alias("m2")]


def merge(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Moments of the whole from rows num, mean, m2 of parts, in two passes so that nothing cancels."""
    whole = parts.groupBy(*keys).agg(F.sum("num").alias("t"), (F.sum(F.col("num") * F.col("mean")) / F.sum("num")).alias("w"))
    both = parts.join(whole, keys)
    return both.groupBy(*keys).agg(F.sum("num").alias("num"), F.first("w").alias("mean"), F.sum(F.col("m2") + F.col("num") * (F.col("mean") - F.col("w")) ** 2).alias("m2"))


def biased_std(num: Column, m2: Column) -> Column:
    return F.sqrt(m2 / F.nullif(num, F.lit(0)))


def unbiased_std(num: Column, m2: Column) -> Column:
    """Corrected sample standard deviation; 0 for fewer than two values."""
    return F.when(num < 2, 0.0).otherwise(F.sqrt(m2 / F.nullif(num - 1, F.lit(0))) / c4(num))


def scale_or_one(scale: Column) -> Column:
    return F.when(scale > 0, scale).otherwise(1.0)


def scaled_mean(mean: Column, shift: Column, scale: Column) -> Column:
    return (mean - shift) / scale_or_one(scale)


def certainty(std: Column) -> Column:
    """Expected probability of guessing a number of deviation ``std``, blurred so that it is 1 at 0."""
    return 1 / (2 * math.sqrt(math.pi) * F.sqrt(std * std + 1 / (4 * math.pi)))


def overlap(mean_a: Column, std_a: Column, mean_b: Column, std_b: Column) -> Column:
    """Integral of the product of two normal densities, each blurred by a variance of 1/(4 pi)."""
    spread = std_a * std_a + std_b * std_b + 1 / (2 * math.pi)
    return F.exp(-((mean_a - mean_b) ** 2) / (2 * spread)) / F.sqrt(2 * math.pi * spread)
