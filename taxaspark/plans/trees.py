"""Reads of concept trees held as tables: concept, parent, depth, path (root first)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxaspark.plans.evaluate import in_ranges


def from_levels(df: DataFrame, levels: list[str], root: str = "world") -> DataFrame:
    """The tree of a fixed hierarchy of columns; a concept is named by its path."""
    parts = [F.lit(root), *[F.col(c) for c in levels]]
    nodes = F.array(*[F.concat_ws("/", *parts[: i + 1]) for i in range(len(parts))])
    paths = F.explode(F.transform(nodes, lambda _, i: F.slice(nodes, 1, i + 1))).alias("path")
    rows = df.select(paths).distinct()
    return rows.select(F.element_at("path", -1).alias("concept"), F.get("path", F.size("path") - 2).alias("parent"), (F.size("path") - 1).alias("depth"), "path")


def ancestors(tree: DataFrame) -> DataFrame:
    """concept, ancestor, steps; reflexive."""
    return tree.select("concept", "depth", F.posexplode("path").alias("at", "ancestor")).select("concept", "ancestor", (F.col("depth") - F.col("at")).alias("steps"))


def subtree_sizes(tree: DataFrame) -> DataFrame:
    return ancestors(tree).groupBy(F.col("ancestor").alias("concept")).agg(F.count(F.lit(1)).alias("n"))


def depth_labels(placed: DataFrame, tree: DataFrame, inst: str, depth: int) -> DataFrame:
    """inst, d, label: the ancestor at each depth of the concept that an instance is placed in; short paths end in it."""
    rows = placed.join(tree.select("concept", "path"), "concept")
    return rows.select(inst, F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("d"), "path", "concept").select(inst, "d", F.coalesce(F.get("path", F.col("d")), F.col("concept")).alias("label"))


def heights(tree: DataFrame) -> DataFrame:
    """concept, height: steps to the farthest leaf below."""
    return ancestors(tree).groupBy(F.col("ancestor").alias("concept")).agg(F.max("steps").alias("height"))


def without_leaves(tree: DataFrame, cuts: int = 1) -> DataFrame:
    """The tree after cutting its leaves ``cuts`` times; the root stays."""
    return tree.join(heights(tree), "concept").filter((F.col("height") >= cuts) | F.col("parent").isNull()).drop("height")


def trimmed_to(tree: DataFrame, concepts: list[str]) -> DataFrame:
    """The tree without anything below ``concepts``."""
    below = reduce(lambda a, b: a | b, [F.array_contains("path", c) & (F.col("concept") != c) for c in concepts], F.lit(False))
    return tree.filter(~below)


def find_all(tree: DataFrame, names: DataFrame) -> DataFrame:
    """The concepts of ``names`` (concept), with those on the way to them from the root, each once."""
    steps = tree.join(names.select("concept").distinct(), "concept", "left_semi").select(F.explode("path").alias("concept")).distinct()
    return tree.join(steps, "concept")


def find(tree: DataFrame, name: str) -> DataFrame:
    """The concept of a name, with those on the way to it from the root."""
    return find_all(tree, tree.sparkSession.createDataFrame([(name,)], "concept string"))


def attribute_kinds(av: DataFrame) -> DataFrame:
    """attr, distinct_values, kind: unique, nominal20 (over ten values), nominal, binary, numeric or constant."""
    value = F.coalesce("sval", F.col("nval").cast("string"))
    rows = av.groupBy("attr").agg(F.count_distinct(value).alias("distinct_values"), F.count(F.lit(1)).alias("n"), F.max(F.col("nval").isNotNull()).alias("numeric"))
    d = F.col("distinct_values")
    kind = F.when(F.col("numeric"), "numeric").when((d == F.col("n")) & (d > 1), "unique").when(d > 10, "nominal20").when(d > 2, "nominal").when(d == 2, "binary").otherwise("constant")
    return rows.select("attr", "distinct_values", kind.alias("kind"))


def attribute_type(attr: Column) -> Column:
    """What a name says about its attribute: constant, hidden or variable; or the same of a relation.

    A relation is hidden if its first part is, and a component relation if any other part is a variable.
    """
    relation = F.when(attr.rlike(r'^\["_'), "hidden-relation").when(attr.rlike(r',"\?'), "component-relation").otherwise("constant-relation")
    return F.when(attr.startswith("["), relation).when(attr.startswith("?"), "variable").when(attr.startswith("_"), "hidden").otherwise("constant")


def attribute_tags(attr: Column) -> Column:
    """The tags by which a viewer filters attributes: hidden, relation, component."""
    kind = attribute_type(attr)
    tags = F.array(F.when(kind.isin("hidden", "hidden-relation"), "hidden"), F.when(kind.endswith("-relation"), "relation"), F.when(kind == "component-relation", "component"))
    return F.filter(tags, lambda t: t.isNotNull())


def ranked_by_reversed_text(df: DataFrame, name: str, key: str) -> DataFrame:
    """key, place: order by the reversed lower-case text without parentheses, so that names sort by their ends.

    Rows are numbered range by range: each range of the sorted keys counts its own rows, and starts where those before
    end, so no single task sees all of them.
    """
    text = F.reverse(F.lower(F.regexp_replace(name, "[()]", "")))
    rows = in_ranges(df.select(key, text.alias("_t")), "_t", key)
    held = rows.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    starts = held.withColumn("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row a range
    own = F.row_number().over(Window.partitionBy("_p").orderBy("_t", key))
    return rows.withColumn("_r", own).join(starts, "_p").select(key, (F.col("_r") + F.col("_b")).cast("long").alias("place"))
