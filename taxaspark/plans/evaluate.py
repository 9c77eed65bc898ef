"""Scores of predictions, in order of arrival or by group."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxaspark.storage import stored


def _before(rows: DataFrame, order: str, by: list[str], name: str) -> DataFrame:
    """``rows`` with ``name``: rows strictly before each one in ``order``, within ``by``.

    ``rows`` carry ``_p``, the range of ``order`` that they are dealt to; rows are counted range by range and then within
    ranges, so one frequent value, or everything, is many tasks.
    """
    held = rows.groupBy(*by, "_p").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # rows: ranges
    starts = held.select(*by, "_p", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_s"))
    inner = F.row_number().over(Window.partitionBy(*by, "_p").orderBy(order)) - 1
    return rows.withColumn("_i", inner).join(starts, [*by, "_p"]).withColumn(name, F.col("_s") + F.col("_i")).drop("_i", "_s")


def in_ranges(df: DataFrame, *order: str) -> DataFrame:
    """``df`` stored with ``_p``, the number of the range of ``order`` that a row lies in; numbers follow the order."""
    return stored(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "ranges")


def running_baseline(df: DataFrame, order: str, target: str) -> DataFrame:
    """order, p: share of the row's own ``target`` among all rows before it (0 for the first), test then train."""
    rows = _before(in_ranges(df.select(order, target), order), order, [target], "_hits")
    rows = _before(rows, order, [], "_all")
    return rows.select(order, F.coalesce(F.col("_hits") / F.nullif(F.col("_all"), F.lit(0)), F.lit(0.0)).alias("p"))


def group_mean_error(df: DataFrame, group: str, value: str) -> DataFrame:
    """``df`` with ``error``: actual minus the group's mean."""
    means = df.groupBy(group).agg(F.avg(value).alias("_m"))
    return df.join(means, group).withColumn("error", F.col(value) - F.col("_m")).drop("_m")


def moving_average(df: DataFrame, by: list[str], order: str, value: str, n: int) -> DataFrame:
    """``df`` with ``average`` of the ``n`` rows up to each; rows with fewer are dropped."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-(n - 1), 0)
    return df.withColumn("average", F.avg(value).over(w)).withColumn("_n", F.count(F.lit(1)).over(w)).filter(F.col("_n") == n).drop("_n")


def _t_cdf(t: float, v: int) -> float:
    """Student's distribution function for ``v`` degrees of freedom, by its finite series."""
    angle = math.atan(t / math.sqrt(v))
    c2, odd = math.cos(angle) ** 2, v % 2
    term = total = math.cos(angle) if odd else 1.0
    for k in range(3 if odd else 2, v - 1, 2):
        term *= c2 * (k - 1) / k
        total += term
    if odd:
        return 0.5 + (angle + (math.sin(angle) * total if v > 1 else 0.0)) / math.pi
    return 0.5 + math.sin(angle) * total / 2


def t_quantile(p: float, v: int) -> float:
    """The point that Student's distribution with ``v`` degrees of freedom stays under with probability ``p``."""
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _t_cdf(mid, v) < p else (low, mid)
    return (low + high) / 2


#: Degrees of freedom up to which quantiles are tabled; beyond, an expansion around the normal one is as good.
TABLED = 100


def student_quantile(v: Column, p: float) -> Column:
    """``t_quantile`` of a column of degrees of freedom."""
    z = NormalDist().inv_cdf(p)
    tabled = F.get(F.array(*[F.lit(t_quantile(p, k)) for k in range(1, TABLED + 1)]), (v - 1).cast("int"))
    far = z + (z**3 + z) / 4 / v + (5 * z**5 + 16 * z**3 + 3 * z) / 96 / v**2 + (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384 / v**3
    return F.when(v <= TABLED, tabled).otherwise(far)


def mean_interval(df: DataFrame, by: list[str], value: str, confidence: float = 0.95) -> DataFrame:
    """by, n, mean, half_width of a confidence interval by Student's quantile; no half_width for a single value."""
    rows = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("_s"))
    return rows.select(*by, "n", "mean", F.when(F.col("n") > 1, student_quantile(F.col("n") - 1, 0.5 + confidence / 2) * F.col("_s") / F.sqrt("n")).alias("half_width"))
