"""Agreement of flat clusterings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pairs(n: Column) -> Column:
    return n * (n - 1) / 2


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: ari, the agreement of two labellings corrected for chance."""
    cells = df.groupBy(a, b).agg(F.count(F.lit(1)).cast("double").alias("n"))
    both = cells.agg(F.sum(_pairs(F.col("n"))).alias("ab"), _pairs(F.sum("n")).alias("t"))
    sides = [cells.groupBy(c).agg(F.sum("n").alias("n")).agg(F.sum(_pairs(F.col("n"))).alias(x)) for c, x in ((a, "pa"), (b, "pb"))]
    rows = both.join(sides[0], F.lit(True)).join(sides[1], F.lit(True))
    chance = F.col("pa") * F.col("pb") / F.nullif(F.col("t"), F.lit(0.0))
    return rows.select(F.coalesce((F.col("ab") - chance) / F.nullif((F.col("pa") + F.col("pb")) / 2 - chance, F.lit(0.0)), F.lit(1.0)).alias("ari"))


def misclassified(df: DataFrame, cluster: str, label: str) -> DataFrame:
    """One row: wrong, the rows outside the majority label of their cluster."""
    cells = df.groupBy(cluster, label).agg(F.count(F.lit(1)).alias("n")).groupBy(cluster).agg(F.sum("n").alias("n"), F.max("n").alias("m"))
    return cells.agg((F.sum("n") - F.sum("m")).alias("wrong"))
