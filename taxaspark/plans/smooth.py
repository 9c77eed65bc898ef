"""Running scales of numeric attributes, and local regression with robust weights and intervals."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxaspark.functions.moments import scale_or_one, unbiased_std
from taxaspark.plans.evaluate import in_ranges, student_quantile
from taxaspark.schema import inner_attr
from taxaspark.storage import stored


def running_scales(av: DataFrame, order: str, scaling: float = 0.5) -> DataFrame:
    """order, inner, num, mean, m2, scale of each number when its row has just been seen: itself and all rows before it.

    ``av``: order, attr, nval; attributes of one inner name share a scale. Rows are dealt to ranges of ``order``: each
    range sums up its own rows, and the ranges before it count by their totals, so no task sees more than a range. Sums
    are of differences to the attribute's overall mean, so that little cancels. Of rows with one order the one with the
    smaller number counts as the earlier.
    """
    rows = av.filter("nval IS NOT NULL").select(order, inner_attr(F.col("attr")).alias("inner"), F.col("nval").alias("_v"))
    middle = rows.groupBy("inner").agg(F.avg("_v").alias("_c"))
    rows = in_ranges(rows.join(F.broadcast(middle), "inner").withColumn("_d", F.col("_v") - F.col("_c")), order, "_v")
    sums = [F.count(F.lit(1)).alias("_n"), F.sum("_d").alias("_s"), F.sum(F.col("_d") * F.col("_d")).alias("_q")]
    before = Window.partitionBy("inner").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # rows: ranges
    held = rows.groupBy("inner", "_p").agg(*sums)
    base = stored(held.select("inner", "_p", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in ("_n", "_s", "_q")]), "bases")
    own = Window.partitionBy("inner", "_p").orderBy(order, "_v").rowsBetween(Window.unboundedPreceding, 0)
    each = rows.withColumns({"_n": F.count(F.lit(1)).over(own), "_s": F.sum("_d").over(own), "_q": F.sum(F.col("_d") * F.col("_d")).over(own)}).join(base, ["inner", "_p"])
    n, s, q = (F.col(c) + F.col(f"{c}0") for c in ("_n", "_s", "_q"))
    m2 = F.greatest(q - s * s / n, F.lit(0.0))
    return each.select(order, "inner", n.alias("num"), (F.col("_c") + s / n).alias("mean"), m2.alias("m2"), scale_or_one(unbiased_std(n, m2) / scaling).alias("scale"))


#: Accuracy of the median of residuals: exact for so many of them, and within a share of 1 / so many of the ranks beyond.
MEDIAN = 1_000_000


def lowess(df: DataFrame, x: str, y: str, share: float = 1 / 3, rounds: int = 3, confidence: float = 0.95) -> DataFrame:
    """x, n, smooth, half_width: robust local regression of ``y`` on ``x``, one row for each distinct ``x``.

    Each x has a neighbourhood: the distance within which more than ``share`` of all points lie. Points in it have
    tricube weights, a line is fitted by weighted least squares, and all is repeated ``rounds`` times with points weighted
    down by their residuals. ``half_width`` is that of a confidence interval from the residuals at an x; null for a single
    point. Rows with a null are left out.

    All points of one x share their neighbourhood, so what is joined are distinct x's with the sums of their points: the
    work in a round grows with the points once and with the pairs of distinct x's that are neighbours. Round x where it has
    very many values.
    """
    points = stored(df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).filter("x IS NOT NULL AND y IS NOT NULL"), "points")
    counts = stored(points.groupBy("x").agg(F.count(F.lit(1)).alias("n")), "counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    enough = math.ceil(share * total) + 1
    far = counts.select("x").join(counts.select(F.col("x").alias("x2"), "n"), F.lit(True)).withColumn("d", F.abs(F.col("x") - F.col("x2")))  # distinct values only
    nearest = Window.partitionBy("x").orderBy("d")
    reach = far.withColumn("upto", F.sum("n").over(nearest)).groupBy("x").agg(F.coalesce(F.min(F.when(F.col("upto") >= enough, F.col("d"))), F.max("d")).alias("h"))
    ratio = F.when(F.col("h") > 0, F.least(F.col("d") / F.col("h"), F.lit(1.0))).otherwise(F.when(F.col("d") > 0, 1.0).otherwise(0.0))
    pairs = far.join(reach, "x").select("x", "x2", F.pow(1 - F.pow(ratio, F.lit(3)), F.lit(3)).alias("w")).filter("w > 0")
    pairs = stored(pairs, "pairs")
    weighted, line = points.withColumn("delta", F.lit(1.0)), None
    for r in range(rounds):
        sums = weighted.groupBy(F.col("x").alias("x2")).agg(F.sum("delta").alias("s"), F.sum(F.col("delta") * F.col("y")).alias("sy"))
        around = pairs.join(sums, "x2").groupBy("x").agg(*[F.sum(F.col("w") * e).alias(c) for c, e in _moments().items()])
        spread = F.col("a0") * F.col("a2") - F.col("a1") * F.col("a1")
        flat = F.col("b0") / F.nullif(F.col("a0"), F.lit(0.0))
        slope = (F.col("a0") * F.col("b1") - F.col("a1") * F.col("b0")) / F.nullif(F.when(spread > 1e-12 * F.col("a0") * F.col("a2"), spread).otherwise(0.0), F.lit(0.0))
        middle = F.col("a1") / F.nullif(F.col("a0"), F.lit(0.0))
        line = stored(around.select("x", F.coalesce(flat + slope * (F.col("x") - middle), flat).alias("smooth")), "line")
        rest = points.join(line, "x").withColumn("r", F.col("y") - F.col("smooth"))
        if r < rounds - 1:
            scale = rest.agg(F.percentile_approx(F.abs("r"), F.lit(0.5), F.lit(MEDIAN))).first()[0] or 0.0
            cut = F.greatest(F.least(F.col("r") / (6 * scale), F.lit(1.0)), F.lit(-1.0)) if scale > 0 else F.when(F.col("r") == 0, 0.0).otherwise(1.0)
            weighted = rest.select("x", "y", F.pow(1 - cut * cut, F.lit(2)).alias("delta"))
    found = rest.groupBy("x").agg(F.count(F.lit(1)).alias("n"), F.first("smooth").alias("smooth"), F.avg(F.col("r") * F.col("r")).alias("r2"))
    return found.select("x", "n", "smooth", F.when(F.col("n") > 1, F.sqrt("r2") / F.sqrt("n") * student_quantile(F.col("n") - 1, 0.5 + confidence / 2)).alias("half_width"))


def _moments() -> dict[str, Column]:
    """What a weighted line needs of an x2 with sums ``s`` of weights and ``sy`` of weighted y."""
    x = F.col("x2")
    return {"a0": F.col("s"), "a1": F.col("s") * x, "a2": F.col("s") * x * x, "b0": F.col("sy"), "b1": F.col("sy") * x}
