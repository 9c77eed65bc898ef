"""Structured instances against trees whose attributes bear variables: mapping, placing and completing, as plans.

Rows are inst, attr, sval, nval; variables are names that begin with ``?`` (see ``plans.transforms``). A mapping renames an
instance's variables to those of a base concept, each base name at most once, so that the concept guesses best with the
instance in it: the closed form of insertion, S + dS over (N + 1)^2 (A + A_new), where a renamed attribute adds 2n + 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxaspark.functions.moments import certainty, unbiased_std
from taxaspark.operators import descent
from taxaspark.plans import transforms
from taxaspark.schema import inner_attr, is_hidden
from taxaspark.storage import discard, stored

#: What stands for the variable in question in an attribute's pattern.
HOLE = "\u0001"


def _with_holes(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with each variable of their attribute as ``name``, and ``hole``: the attribute with that variable left out."""
    found = rows.withColumn(name, F.explode(F.array_distinct(transforms.variables(F.col("attr")))))
    quoted = F.concat(F.lit('"'), F.col(name), F.lit('"'))
    return found.withColumn("hole", F.when(F.col("attr").startswith("["), F.replace("attr", quoted, F.lit(HOLE))).otherwise(F.lit(HOLE)))


def base_table(count: DataFrame, number: DataFrame | None = None, scale: DataFrame | None = None) -> DataFrame:
    """attr, val, n, num, mean, m2, scale: what a base concept holds, from its counts and moments (attr, ...)."""
    none = {"num": "long", "mean": "double", "m2": "double", "scale": "double"}
    rows = count.filter(~is_hidden(F.col("attr"))).select("attr", "val", F.col("n").cast("long").alias("n"), *[F.lit(None).cast(t).alias(c) for c, t in none.items()])
    if number is None:
        return rows
    m = number.filter(~is_hidden(F.col("attr"))).withColumn("inner", inner_attr(F.col("attr")))
    m = m.join(scale, "inner", "left") if scale is not None else m.withColumn("scale", F.lit(None).cast("double"))
    return rows.unionByName(m.select("attr", F.lit(None).cast("string").alias("val"), F.lit(None).cast("long").alias("n"), "num", "mean", "m2", F.coalesce("scale", F.lit(1.0)).alias("scale")))


def _gain(value: Column) -> Column:
    """What a value adds to S beyond 1, where the base's row (n, or num, mean, m2, scale) holds its attribute."""
    num = F.col("num")
    step = value - F.col("mean")
    m2 = F.col("m2") + step * (step - step / (num + 1))
    term = lambda k, s: k.cast("double") * k * certainty(s / F.col("scale"))
    number = term(num + 1, unbiased_std(num + 1, m2)) - term(num, unbiased_std(num, F.col("m2"))) - 1
    return F.when(num.isNotNull(), number).otherwise((2 * F.col("n")).cast("double"))


def _state(base: DataFrame, size: int) -> tuple[float, int]:
    """(S, A) of a base concept."""
    part = F.when(F.col("num").isNotNull(), F.col("num").cast("double") ** 2 * certainty(unbiased_std(F.col("num"), F.col("m2")) / F.col("scale"))).otherwise(F.col("n").cast("double") ** 2)
    row = base.agg(F.sum(part).alias("s"), F.count_distinct("attr").alias("a")).first()
    return row["s"] or 0.0, row["a"] or 0


def _standing(av: DataFrame, base: DataFrame) -> DataFrame:
    """inst, gain, new: what each instance adds to S, and its attributes that the base lacks, as it is named now."""
    seen = av.filter(~is_hidden(F.col("attr")))
    attrs = base.select(F.col("attr").alias("_a")).distinct()
    value = base.withColumnsRenamed({"attr": "_b"})
    hit = (F.col("attr") == F.col("_b")) & ((F.col("sval") == F.col("val")) | F.col("nval").isNotNull() & F.col("num").isNotNull())
    rows = seen.join(attrs, F.col("attr") == F.col("_a"), "left").join(value, hit, "left")
    return rows.groupBy("inst").agg(F.sum(1 + F.coalesce(_gain(F.col("nval")), F.lit(0.0))).alias("gain"), F.count_if(F.col("_a").isNull()).alias("new"))


def _pairs(av: DataFrame, base: DataFrame) -> DataFrame:
    """inst, var, base, more, known: for each variable and base variable that share a pattern, the change of dS and A_new."""
    mine = _with_holes(av.filter(~is_hidden(F.col("attr"))), "var").select("inst", "var", "hole", "sval", "nval")
    held = _with_holes(base, "base")
    attrs = held.select("hole", "base").distinct()
    known = mine.join(attrs, "hole").groupBy("inst", "var", "base").agg(F.count(F.lit(1)).alias("known"))
    names = mine.filter("sval IS NOT NULL").join(held.select("hole", "base", F.col("val").alias("sval"), "n", "num", "mean", "m2", "scale").filter("n IS NOT NULL"), ["hole", "sval"])
    numbers = mine.filter("nval IS NOT NULL").join(held.filter("num IS NOT NULL").drop("attr", "val"), "hole")
    columns = ["inst", "var", "base", "nval", "n", "num", "mean", "m2", "scale"]
    more = names.select(*columns).unionByName(numbers.select(*columns)).groupBy("inst", "var", "base").agg(F.sum(_gain(F.col("nval"))).alias("more"))
    return known.join(more, ["inst", "var", "base"], "left").select("inst", "var", "base", F.coalesce("more", F.lit(0.0)).alias("more"), "known")


def mapping_costs(av: DataFrame, base: DataFrame, size: int) -> DataFrame:
    """inst, var, base, cost: of mapping one variable to one base variable, and of staying unmapped (a null base).

    ``av``: rows of instances whose variables are none of the base's; ``base``: ``base_table`` of a concept of ``size``
    instances. The cost is minus the expected correct guesses of the concept with the renamed instance in it. An
    instance's attribute meets the base's by its pattern around the variable, so all instances are scored by one join.
    """
    s, a = _state(base, size)
    cost = lambda gain, new: -(s + gain) / ((size + 1.0) ** 2 * F.nullif(F.lit(a) + new, F.lit(0)))
    variables = av.select("inst", F.explode(transforms.variables(F.col("attr"))).alias("var")).distinct()
    bases = base.select(F.explode(transforms.variables(F.col("attr"))).alias("base")).distinct().unionByName(av.sparkSession.createDataFrame([(None,)], "base string"))
    standing = _standing(av, base)
    every = variables.join(standing, "inst", "left").join(bases, F.lit(True))  # each variable with each base variable is what is asked for
    pairs = every.join(_pairs(av, base), ["inst", "var", "base"], "left")
    gain, new = F.coalesce("gain", F.lit(0.0)) + F.coalesce("more", F.lit(0.0)), F.coalesce("new", F.lit(0)) - F.coalesce("known", F.lit(0))
    return pairs.select("inst", "var", "base", cost(gain, new).alias("cost"))


def mapped(av: DataFrame, base: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """(rows in the base's names, mapping inst, old, new): each instance's variables mapped to the base's.

    In each round every instance maps the one pair that lowers its cost most, given what is mapped already, until none
    does: so relations between two variables count as soon as one of them is mapped. Ties go to the first variable,
    then base name. Each round is a join over all instances; there are as many as the base has variables, at most.
    Variables without a gain keep their names.
    """
    s, a = _state(base, size)
    spark = av.sparkSession
    base = stored(base, "base")
    names = base.select(F.explode(transforms.variables(F.col("attr"))).alias("base")).distinct().count()
    now = stored(av.select("inst", "attr", "sval", "nval"), "mapped")
    mapping = stored(spark.createDataFrame([], av.select("inst", F.lit("").alias("old"), F.lit("").alias("new")).schema), "mapping")
    rate = lambda gain, new: (s + gain) / F.nullif(F.lit(a) + new, F.lit(0))
    for _ in range(names):
        free = _pairs(now, base).join(mapping.select("inst", F.col("new").alias("base")), ["inst", "base"], "left_anti")
        free = free.join(mapping.select("inst", F.col("new").alias("var")), ["inst", "var"], "left_anti")
        better = free.join(_standing(now, base), "inst").withColumn("rate", rate(F.col("gain") + F.col("more"), F.col("new") - F.col("known"))).filter(F.col("rate") > rate(F.col("gain"), F.col("new")) + 1e-12)
        order = Window.partitionBy("inst").orderBy(F.round("rate", 9).desc(), "var", "base")
        chosen = stored(better.withColumn("_r", F.row_number().over(order)).filter("_r = 1").select("inst", F.col("var").alias("old"), F.col("base").alias("new")), "chosen")
        if chosen.isEmpty():
            break
        after = now.join(chosen, "inst", "left")
        one = F.when(F.col("old").isNull(), F.col("attr")).otherwise(transforms.renamed(F.col("attr"), F.create_map(F.coalesce("old", F.lit("")), "new")))
        now, spent = stored(after.withColumn("attr", one).drop("old", "new"), "mapped"), now
        mapping = stored(mapping.unionByName(chosen), "mapping")
        discard(spent)
    return now, mapping


def instances_of(av: DataFrame, tree_name: str = "tree") -> DataFrame:
    """inst, tree, nominal, numeric from rows: what ``descent.categorize`` takes, without hidden attributes."""
    seen = av.filter(~is_hidden(F.col("attr")))
    none_s, none_n = F.create_map().cast("map<string,string>"), F.create_map().cast("map<string,double>")
    held = seen.groupBy("inst").agg(F.map_from_entries(F.collect_list(F.when(F.col("sval").isNotNull(), F.struct("attr", "sval")))).alias("nominal"), F.map_from_entries(F.collect_list(F.when(F.col("nval").isNotNull(), F.struct("attr", "nval")))).alias("numeric"))  # an instance's own attributes
    every = av.select("inst").distinct().join(held, "inst", "left")
    return every.select("inst", F.lit(tree_name).alias("tree"), F.coalesce("nominal", none_s).alias("nominal"), F.coalesce("numeric", none_n).alias("numeric"))


def _root(tree: DataFrame, scaling: float) -> tuple[DataFrame, int]:
    """(base table, size) of a tree's root."""
    root = tree.filter("parent IS NULL")
    key = root.select("tree", "concept")
    count = descent.nominal_counts(root).join(key, ["tree", "concept"])
    number = descent.numeric_moments(root).join(key, ["tree", "concept"])
    scale = descent.tree_scales(tree, scaling).groupBy(inner_attr(F.col("attr")).alias("inner")).agg(F.max("scale").alias("scale"))
    return base_table(count, number, scale), int(root.agg(F.max("n")).first()[0] or 0)


def prepared(av: DataFrame, tree: DataFrame, scaling: float = 0.5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows in the tree's names, standard names, mapping): standardized, hoisted and mapped to the tree's root.

    ``av``: flattened rows in the instances' own names, of one tree. The two tables undo it (``undone``).
    """
    rows, names = transforms.standardized(av, "inst")
    names = stored(names, "names")
    hoisted = transforms.subcomponents(rows.select("inst", "attr", "sval", "nval"), "inst")
    base, size = _root(tree, scaling)
    now, mapping = mapped(hoisted, base, size)
    return now, names, mapping


def undone(rows: DataFrame, names: DataFrame, mapping: DataFrame) -> DataFrame:
    """Inverse of ``prepared``: mapping, hoisting and standard names, in the opposite order; new attributes take part.

    Variables of the tree that none of the instance's was mapped to keep the tree's names.
    """
    own = transforms.restored(rows.select("inst", "attr", "sval", "nval"), mapping, "inst")
    return transforms.restored(transforms.embedded(own, "inst"), names, "inst")


def categorize(av: DataFrame, tree: DataFrame, scaling: float = 0.5) -> DataFrame:
    """inst, tree, concept: the leaf of each structured instance, after its names are mapped to the tree's."""
    rows, _, _ = prepared(av, tree, scaling)
    return descent.categorize(instances_of(rows, tree.select("tree").first()[0]), tree, scaling)


def infer_missing(av: DataFrame, tree: DataFrame, allow_none: bool = True, seed: int | None = None, scaling: float = 0.5) -> DataFrame:
    """inst, attr, sval, nval: each structured instance completed by the concept that it is placed in, in its own names.

    What the concept holds and the instance lacks is predicted (``descent.infer``); what is likeliest to be missing stays so.
    """
    rows, names, mapping = prepared(av, tree, scaling)
    instances = instances_of(rows, tree.select("tree").first()[0])
    placed = stored(instances.join(descent.categorize(instances, tree, scaling).drop("tree"), "inst"), "placed")
    own = rows.select("inst", F.col("attr").alias("attr"))
    more = descent.infer(placed, tree, allow_none=allow_none, seed=seed).filter("sval IS NOT NULL OR nval IS NOT NULL")
    more = more.join(own, ["inst", "attr"], "left_anti")  # hidden attributes that the instance has
    return undone(rows.unionByName(more.select("inst", "attr", "sval", "nval")), names, mapping)
