"""Concept statistics and utilities as aggregates and joins over counts and moments.

``keys`` name the concepts: any columns. Counts tables have keys, attr, val, n; moments tables keys, attr, num, mean,
m2; sizes tables keys, size. Hidden attributes are left out of scores.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxaspark.functions.choice import drawn_normal, most_likely, sampled
from taxaspark.functions.moments import certainty, merge, moments, overlap, scale_or_one, unbiased_std
from taxaspark.schema import inner_attr, is_hidden


def counts(av: DataFrame, keys: list[str]) -> DataFrame:
    """keys, attr, val, n of nominal values."""
    return av.filter("sval IS NOT NULL").groupBy(*keys, "attr", F.col("sval").alias("val")).agg(F.count(F.lit(1)).alias("n"))


def numbers(av: DataFrame, keys: list[str]) -> DataFrame:
    """keys, attr, num, mean, m2 of numeric values."""
    return av.filter("nval IS NOT NULL").groupBy(*keys, "attr").agg(*moments())


def sizes(instances: DataFrame, keys: list[str]) -> DataFrame:
    """keys, size from one row for each instance."""
    return instances.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"))


def scales(av: DataFrame, scaling: float = 0.5) -> DataFrame:
    """inner, scale of numeric attributes over everything seen; attributes of one inner name share it."""
    m = av.filter("nval IS NOT NULL").groupBy(inner_attr(F.col("attr")).alias("inner")).agg(*moments())
    return m.select("inner", scale_or_one(unbiased_std(F.col("num"), F.col("m2")) / scaling).alias("scale"))


def guesses(count: DataFrame, size: DataFrame, keys: list[str], number: DataFrame | None = None, scale: DataFrame | None = None) -> DataFrame:
    """keys, size, attrs, ecg: expected correct guesses, averaged over the concept's attributes; 0 without any."""
    part = count.filter(~is_hidden(F.col("attr"))).groupBy(*keys, "attr").agg(F.sum(F.col("n").cast("double") ** 2).alias("s"))
    if number is not None:
        m = number.filter(~is_hidden(F.col("attr"))).withColumn("inner", inner_attr(F.col("attr")))
        m = m.join(scale, "inner", "left").withColumn("scale", F.coalesce("scale", F.lit(1.0))) if scale is not None else m.withColumn("scale", F.lit(1.0))
        part = part.unionByName(m.select(*keys, "attr", (F.col("num").cast("double") ** 2 * certainty(unbiased_std(F.col("num"), F.col("m2")) / F.col("scale"))).alias("s")))
        part = part.groupBy(*keys, "attr").agg(F.sum("s").alias("s"))
    total = part.groupBy(*keys).agg(F.sum("s").alias("s"), F.count(F.lit(1)).alias("attrs"))
    ecg = F.coalesce(F.col("s") / (F.col("size").cast("double") ** 2 * F.col("attrs")), F.lit(0.0))
    return size.join(total, keys, "left").select(*keys, "size", F.coalesce("attrs", F.lit(0)).alias("attrs"), ecg.alias("ecg"))


def utility(count: DataFrame, size: DataFrame, by: list[str], child: str, number: DataFrame | None = None, scale: DataFrame | None = None) -> DataFrame:
    """by, children, parent_ecg, cu: category utility of the children ``child`` of each ``by``.

    The parent's tables are the sums of its children's.
    """
    if not by:
        tables = [None if t is None else t.withColumn("_all", F.lit(0)) for t in (count, size, number)]
        return utility(tables[0], tables[1], ["_all"], child, tables[2], scale).drop("_all")
    keys = [*by, child]
    own = guesses(count, size, keys, number, scale)
    up = count.groupBy(*by, "attr", "val").agg(F.sum("n").alias("n"))
    up_size = size.groupBy(*by).agg(F.sum("size").alias("size"))
    up_number = merge(number, [*by, "attr"]) if number is not None else None
    parent = guesses(up, up_size, by, up_number, scale)
    joined = own.withColumnRenamed("ecg", "e").withColumnRenamed("size", "m").join(parent.select(*by, "size", F.col("ecg").alias("parent_ecg")), by)
    cu = (F.sum(F.col("m") / F.col("size") * F.col("e")) - F.first("parent_ecg")) / F.count(F.lit(1))
    return joined.groupBy(*by).agg(F.count(F.lit(1)).alias("children"), F.first("parent_ecg").alias("parent_ecg"), cu.alias("cu"))


def _patterns(probes: DataFrame) -> DataFrame:
    """``probes`` (inst, nominal: map attribute -> value) as inst, pattern: their visible values, in order.

    Instances of equal values have equal patterns, so what depends on values alone is found once for each pattern.
    """
    visible = F.map_filter(F.coalesce("nominal", F.create_map().cast("map<string,string>")), lambda a, v: v.isNotNull() & ~is_hidden(a))
    return probes.select("inst", F.array_sort(F.map_entries(visible)).alias("pattern"))


def _pattern_utility(patterns: DataFrame, count: DataFrame, size: DataFrame, key: str) -> DataFrame:
    """pattern, key, size, rel for every distinct pattern and every concept, also where they share nothing."""
    seen = count.filter(~is_hidden(F.col("attr")))
    total = seen.groupBy(key).agg(F.sum(F.col("n").cast("double") ** 2).alias("s"), F.count_distinct("attr").alias("a"))
    base = size.join(total, key, "left").select(key, "size", F.coalesce("s", F.lit(0.0)).alias("s"), F.coalesce("a", F.lit(0)).alias("a"))
    distinct = patterns.select("pattern").distinct()
    values = distinct.select("pattern", F.explode("pattern").alias("e")).select("pattern", F.col("e.key").alias("attr"), F.col("e.value").alias("val"))
    known = values.join(seen.select(key, "attr").distinct(), "attr").select("pattern", key, F.lit(1).alias("known"), F.lit(0).cast("long").alias("n"))
    counted = values.join(seen.select(key, "attr", "val", "n"), ["attr", "val"]).select("pattern", key, F.lit(0).alias("known"), "n")
    shared = known.unionByName(counted).groupBy("pattern", key).agg(F.sum("known").alias("known"), F.sum("n").alias("n"))
    rows = distinct.join(base, F.lit(True)).join(shared, ["pattern", key], "left")  # every pattern with every concept is what is asked for
    values_in = F.size("pattern")
    new = values_in - F.coalesce("known", F.lit(0))
    before = F.coalesce(F.col("s") / F.nullif(F.col("size") * F.col("a"), F.lit(0)), F.lit(0.0))
    after = F.coalesce((F.col("s") + 2 * F.coalesce("n", F.lit(0)) + values_in) / F.nullif((F.col("size") + 1) * (F.col("a") + new), F.lit(0)), F.lit(0.0))
    return rows.select("pattern", key, "size", (after - before).alias("rel"))


def relative_utility(probes: DataFrame, count: DataFrame, size: DataFrame, key: str) -> DataFrame:
    """inst, key, size, rel: change of size * ECG of each concept if the nominal instance went there.

    ``probes``: inst, nominal (map attribute -> value); one without visible values, or null, has a row for each concept too.
    With S = sum of squared counts and A attributes in a concept of N, an instance adds 2n + 1 for each value with n there
    and its unknown attributes to A; so a pattern of values meets only the counts of its own values, by joins.
    """
    patterns = _patterns(probes)
    return patterns.join(_pattern_utility(patterns, count, size, key), "pattern").select("inst", key, "size", "rel")


def best_children(probes: DataFrame, count: DataFrame, size: DataFrame, key: str, k: int = 2) -> DataFrame:
    """inst, rank, key, rel of the ``k`` best concepts: greatest utility, then size, then name."""
    patterns = _patterns(probes)
    order = Window.partitionBy("pattern").orderBy(F.round("rel", 9).desc(), F.col("size").desc(), F.col(key))
    best = _pattern_utility(patterns, count, size, key).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return patterns.join(best, "pattern").select("inst", "rank", key, "rel")


def variants(count: DataFrame, size: DataFrame, sub: DataFrame, sub_size: DataFrame, probe: dict[str, str], best: str, second: str) -> tuple[DataFrame, DataFrame]:
    """Counts and sizes (op, k, ...) of the partitions that placing ``probe`` could give.

    ``best``: into that child; ``new``: a child of its own; ``merge``: into both best ones as one; ``split``: the best
    child's own children (``sub``) in its place, without the probe.
    """
    spark = count.sparkSession
    x = spark.createDataFrame([(a, v, 1) for a, v in probe.items()], "attr string, val string, n long")
    one = spark.createDataFrame([(1,)], "size long")
    c, z = count.select("k", "attr", "val", "n"), size.select("k", "size")

    def with_x(op: str, frame: DataFrame, frame_size: DataFrame, at: str) -> tuple[DataFrame, DataFrame]:
        n = frame.unionByName(x.withColumn("k", F.lit(at))).groupBy("k", "attr", "val").agg(F.sum("n").alias("n"))
        s = frame_size.unionByName(one.withColumn("k", F.lit(at))).groupBy("k").agg(F.sum("size").alias("size"))
        return n.withColumn("op", F.lit(op)), s.withColumn("op", F.lit(op))

    fused = F.when(F.col("k").isin(best, second), F.lit("<merged>")).otherwise(F.col("k"))
    parts = [
        with_x("best", c, z, best),
        with_x("new", c, z, "<new>"),
        with_x("merge", c.withColumn("k", fused), z.withColumn("k", fused), "<merged>"),
        (c.filter(F.col("k") != best).unionByName(sub.select("k", "attr", "val", "n")).withColumn("op", F.lit("split")), z.filter(F.col("k") != best).unionByName(sub_size.select("k", "size")).withColumn("op", F.lit("split"))),
    ]
    return reduce(DataFrame.unionByName, [p[0] for p in parts]), reduce(DataFrame.unionByName, [p[1] for p in parts])


def probabilities(count: DataFrame, size: DataFrame, keys: list[str], with_none: bool = True, attrs: list[str] | None = None) -> DataFrame:
    """keys, attr, val, p of every value; with a null value for what the concept lacks, if anything.

    ``attrs``: attributes that concepts may lack altogether; null has probability 1 there.
    """
    rows = count.join(size, keys)
    known = rows.select(*keys, "attr", "val", (F.col("n") / F.col("size")).alias("p"))
    if not with_none:
        return known
    sums = count.groupBy(*keys, "attr").agg(F.sum("n").alias("n"))
    if attrs:
        asked = size.select(*keys, F.explode(F.array(*map(F.lit, attrs))).alias("attr"))
        sums = sums.join(asked, [*keys, "attr"], "full").withColumn("n", F.coalesce("n", F.lit(0)))
    rest = sums.join(size, keys).filter("n < size")
    return known.unionByName(rest.select(*keys, "attr", F.lit(None).cast("string").alias("val"), ((F.col("size") - F.col("n")) / F.col("size")).alias("p")))


def density(value: Column, num: Column, mean: Column, m2: Column, size: Column, shift: Column, scale: Column) -> Column:
    """Probability of a number: its blurred normal density after shift and scale, times the share that has the attribute."""
    import math

    s = scale_or_one(scale)
    spread = (unbiased_std(num, m2) / s) ** 2 + 1 / (2 * math.pi)
    gap = (value - mean) / s
    return num / size * F.exp(-(gap**2) / (2 * spread)) / F.sqrt(2 * math.pi * spread)


def log_likelihood(parent: DataFrame, child: DataFrame, pairs: DataFrame) -> DataFrame:
    """parent_key, child_key, ll: sum of ln(p_parent * p_child) over all values, null included, that the child may have.

    ``parent`` and ``child``: key, attr, val, p from ``probabilities``; ``pairs``: parent_key, child_key. A value that
    the parent can't have makes the result null.
    """
    c = child.filter("p > 0").filter(~is_hidden(F.col("attr"))).select(F.col("key").alias("child_key"), "attr", F.col("val").alias("cv"), F.col("p").alias("cp"))
    p = parent.select(F.col("key").alias("parent_key"), F.col("attr").alias("pa"), F.col("val").alias("pv"), F.col("p").alias("pp"))
    both = pairs.join(c, "child_key").join(p, ["parent_key"], "left").filter((F.col("attr") == F.col("pa")) & F.col("cv").eqNullSafe(F.col("pv")))
    found = both.groupBy("parent_key", "child_key").agg(F.sum(F.ln(F.col("pp") * F.col("cp"))).alias("ll"), F.count(F.lit(1)).alias("hits"))
    wanted = c.groupBy("child_key").agg(F.count(F.lit(1)).alias("wanted"))
    return pairs.join(wanted, "child_key").join(found, ["parent_key", "child_key"], "left").select("parent_key", "child_key", F.when(F.col("hits") == F.col("wanted"), F.col("ll")).alias("ll"))


def parameters(count: DataFrame, number: DataFrame | None, keys: list[str]) -> DataFrame:
    """keys, k: one parameter for each nominal value, two for each numeric attribute; hidden ones don't count."""
    k = count.filter(~is_hidden(F.col("attr"))).groupBy(*keys).agg(F.count(F.lit(1)).alias("k"))
    if number is not None:
        k = k.unionByName(number.filter(~is_hidden(F.col("attr"))).groupBy(*keys).agg((2 * F.count(F.lit(1))).alias("k")))
    return k.groupBy(*keys).agg(F.sum("k").alias("k"))


def criteria(ll: Column, k: Column, n: Column) -> dict[str, Column]:
    """Information criteria from a log likelihood, a number of parameters and of instances."""
    aic = 2 * k - 2 * ll
    return {"aic": aic, "aicc": F.when(n - k <= 1, float("inf")).otherwise(aic + 2 * k * (k + 1) / F.nullif(n - k - 1, F.lit(0))), "bic": k * F.ln(n) - 2 * ll}


def weighted_values(count: DataFrame, number: DataFrame, size: DataFrame, keys: list[str]) -> DataFrame:
    """keys, attr, val, p, mean, std: the choices of each attribute, nominal or numeric, and of its being missing.

    A numeric attribute is one choice, ``NUMBER``, with its mean and corrected deviation; being missing is a null value.
    """
    none = F.lit(None).cast("double")
    nominal = count.select(*keys, "attr", "val", "n", none.alias("mean"), none.alias("std"))
    numeric = number.select(*keys, "attr", F.lit(NUMBER).alias("val"), F.col("num").alias("n"), "mean", unbiased_std(F.col("num"), F.col("m2")).alias("std"))
    known = nominal.unionByName(numeric)
    rest = known.groupBy(*keys, "attr").agg(F.sum("n").alias("n")).join(size, keys).filter("n < size")
    lack = rest.select(*keys, "attr", F.lit(None).cast("string").alias("val"), (F.col("size") - F.col("n")).alias("n"), none.alias("mean"), none.alias("std"))
    rows = known.unionByName(lack).join(size, keys)
    return rows.select(*keys, "attr", "val", (F.col("n") / F.col("size")).alias("p"), "mean", "std")


#: The choice that stands for a numeric attribute's distribution.
NUMBER = "\u0001number"


def predicted_values(weighted: DataFrame, keys: list[str], allow_none: bool = True, seed: int | None = None) -> DataFrame:
    """keys, attr, sval, nval: the likeliest choice of each attribute (``weighted_values``), or one drawn by ``seed``.

    A number is predicted by its mean, or drawn from its normal distribution. With ``allow_none`` false, being missing is
    no choice.
    """
    rows = weighted if allow_none else weighted.filter("val IS NOT NULL")
    rows = most_likely(rows, [*keys, "attr"]) if seed is None else sampled(rows, [*keys, "attr"], seed)
    number = F.col("val") == NUMBER
    value = F.col("mean") if seed is None else F.col("mean") + F.col("std") * drawn_normal(seed, *keys, "attr")
    return rows.select(*keys, "attr", F.when(~number, F.col("val")).alias("sval"), F.when(number, value).alias("nval"))


def log_likelihood_mixed(parent: DataFrame, child: DataFrame, pairs: DataFrame) -> DataFrame:
    """parent_key, child_key, ll as ``log_likelihood``, with numeric attributes.

    ``parent`` and ``child``: key, attr, val, p, mean, std from ``weighted_values``. Where both sides have an attribute's
    numbers, the pair of distributions adds the logarithm of their overlap and of both shares; else numbers add nothing.
    """
    visible = lambda t: t.filter("p > 0").filter(~is_hidden(F.col("attr")))
    c = visible(child).select(F.col("key").alias("child_key"), "attr", "val", F.col("p").alias("cp"), F.col("mean").alias("cm"), F.col("std").alias("cs"))
    p = visible(parent).select(F.col("key").alias("parent_key"), "attr", F.coalesce("val", F.lit("\u0001none")).alias("_v"), F.col("p").alias("pp"), F.col("mean").alias("pm"), F.col("std").alias("ps"))
    c = c.withColumn("_v", F.coalesce("val", F.lit("\u0001none")))
    both = pairs.join(c, "child_key").join(p, ["parent_key", "attr", "_v"], "left")
    number = F.col("_v") == NUMBER
    each = F.ln(F.col("pp") * F.col("cp")) + F.when(number, F.ln(overlap(F.col("pm"), F.col("ps"), F.col("cm"), F.col("cs")))).otherwise(0.0)
    found = both.groupBy("parent_key", "child_key").agg(F.sum(each).alias("ll"), F.count_if(F.col("pp").isNull() & ~number).alias("lost"))
    return found.select("parent_key", "child_key", F.when(F.col("lost") == 0, F.coalesce("ll", F.lit(0.0))).alias("ll"))


def _signature(attr: Column, sval: Column, nval: Column) -> Column:
    """Attributes and values in one comparable array; the rows are an instance's, or a concept's attributes."""
    return F.array_sort(F.collect_list(F.struct(attr.alias("a"), sval.alias("s"), nval.alias("v"))))


def exact_match(probes: DataFrame, count: DataFrame, size: DataFrame, key: str, number: DataFrame | None = None) -> DataFrame:
    """inst, key of the pairs where each visible attribute on either side has one value, the instance's, in all of the concept's instances.

    ``probes``: inst, attr, sval, nval. A concept can match only if all its attributes are sure; it then matches the
    instances of the same values, which one equality join finds.
    """
    none = F.lit(None).cast("double")
    seen = count.filter(~is_hidden(F.col("attr"))).select(key, "attr", F.col("val").alias("sval"), none.alias("nval"), F.col("n"), F.lit(0.0).alias("m2"))
    if number is not None:
        seen = seen.unionByName(number.filter(~is_hidden(F.col("attr"))).select(key, "attr", F.lit(None).cast("string").alias("sval"), F.col("mean").alias("nval"), F.col("num").alias("n"), "m2"))
    sure = seen.join(size, key).groupBy(key).agg(F.bool_and((F.col("n") == F.col("size")) & (F.col("m2") == 0)).alias("sure"), _signature(F.col("attr"), F.col("sval"), F.col("nval")).alias("sig"))
    mine = probes.filter("sval IS NOT NULL OR nval IS NOT NULL").filter(~is_hidden(F.col("attr"))).groupBy("inst").agg(_signature(F.col("attr"), F.col("sval"), F.col("nval")).alias("sig"))
    return mine.join(sure.filter("sure"), "sig").select("inst", key)
