"""Reads of fitted trees as joins: categorize level by level, predict, cut into flat clusterings, export."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taxaspark.functions.moments import c4, certainty, moments as moments_of, scale_or_one, unbiased_std
from taxaspark.plans import measures
from taxaspark.storage import discard, stored


def nominal_counts(tree: DataFrame) -> DataFrame:
    """tree, concept, attr, val, n of fitted trees."""
    rows = tree.select("tree", "concept", F.explode(F.from_json("nominal", "map<string,map<string,bigint>>")).alias("attr", "vals"))
    return rows.select("tree", "concept", "attr", F.explode("vals").alias("val", "n"))


def numeric_moments(tree: DataFrame) -> DataFrame:
    """tree, concept, attr, num, mean, m2 of fitted trees."""
    rows = tree.select("tree", "concept", F.explode(F.from_json("numeric", "map<string,array<double>>")).alias("attr", "m"))
    return rows.select("tree", "concept", "attr", F.col("m")[0].cast("long").alias("num"), F.col("m")[1].alias("mean"), F.col("m")[2].alias("m2"))


def tree_scales(tree: DataFrame, scaling: float = 0.5) -> DataFrame:
    """tree, attr, scale: the root's deviations, over ``scaling``."""
    root = tree.filter("parent IS NULL").select("tree", F.col("concept").alias("r"))
    m = numeric_moments(tree).join(root, "tree").filter("concept = r")
    return m.select("tree", "attr", scale_or_one(unbiased_std(F.col("num"), F.col("m2")) / scaling).alias("scale"))


def _stats(tree: DataFrame, scaling: float) -> DataFrame:
    """tree, concept, parent, n, and maps: s and a of the closed form, counts by (attr, value), moments by attr."""
    c = nominal_counts(tree).filter("attr NOT LIKE '\\\\_%'")
    m = numeric_moments(tree).filter("attr NOT LIKE '\\\\_%'").join(tree_scales(tree, scaling), ["tree", "attr"])
    nominal = c.groupBy("tree", "concept").agg(F.sum(F.col("n").cast("double") ** 2).alias("s1"), F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\u0001", "attr", "val"), "n"))).alias("counts"), F.collect_set("attr").alias("a1"))
    squares = F.col("num").cast("double") ** 2 * certainty(unbiased_std(F.col("num"), F.col("m2")) / F.col("scale"))
    numeric = m.groupBy("tree", "concept").agg(F.sum(squares).alias("s2"), F.map_from_entries(F.collect_list(F.struct("attr", F.struct("num", "mean", "m2", "scale")))).alias("moments"), F.collect_set("attr").alias("a2"))
    rows = tree.select("tree", "concept", "parent", "n").join(nominal, ["tree", "concept"], "left").join(numeric, ["tree", "concept"], "left")
    empty = F.array().cast("array<string>")
    attrs = F.array_union(F.coalesce("a1", empty), F.coalesce("a2", empty))
    return rows.select("tree", F.col("concept").alias("child"), F.col("parent").alias("node"), F.col("n").alias("size"), (F.coalesce("s1", F.lit(0.0)) + F.coalesce("s2", F.lit(0.0))).alias("s"), attrs.alias("attrs"), "counts", "moments")


def _gain_of(c: Column) -> Column:
    """Change of size * guesses if the row's instance joined the concept ``c`` (a struct of ``_stats``)."""
    counts = F.coalesce(c["counts"], F.create_map().cast("map<string,bigint>"))
    nominal = F.aggregate(F.map_entries("nominal"), F.lit(0.0), lambda acc, e: acc + 2 * F.coalesce(F.element_at(counts, F.concat_ws("\u0001", e["key"], e["value"])), F.lit(0)) + 1)

    def number(acc: Column, e: Column) -> Column:
        old = F.element_at(c["moments"], e["key"])
        n, mean = F.coalesce(old["num"], F.lit(0)), F.coalesce(old["mean"], F.lit(0.0))
        step = e["value"] - mean
        m2 = F.coalesce(old["m2"], F.lit(0.0)) + step * (step - step / (n + 1))
        scale = F.coalesce(old["scale"], F.lit(1.0))
        std_new = F.when(n < 1, 0.0).otherwise(F.sqrt(m2 / F.greatest(n, F.lit(1))) / c4(n + 1))
        std_old = F.when(n < 2, 0.0).otherwise(F.sqrt(old["m2"] / F.greatest(n - 1, F.lit(1))) / c4(n))
        blur = 1 / (4 * math.pi)
        term = lambda k, s: k.cast("double") * k / (2 * math.sqrt(math.pi) * F.sqrt((s / scale) ** 2 + blur))
        return acc + term(n + 1, std_new) - F.when(n > 0, term(n, std_old)).otherwise(0.0)

    numeric = F.aggregate(F.map_entries("numeric"), F.lit(0.0), number)
    names = F.array_union(F.map_keys("nominal"), F.map_keys("numeric"))
    new, a = F.size(F.array_except(names, c["attrs"])), F.size(c["attrs"])
    before = F.coalesce(c["s"] / F.nullif(c["size"] * a, F.lit(0)), F.lit(0.0))
    return (c["s"] + nominal + numeric) / F.nullif((c["size"] + 1) * (a + new), F.lit(0)) - before


def categorize(instances: DataFrame, tree: DataFrame, scaling: float = 0.5) -> DataFrame:
    """inst, tree, concept: the leaf of each instance (inst, tree, nominal, numeric) by greedy descent.

    A concept's children are one array, stored once; each level is one join of the instances with the children of the
    concepts that they are in (a broadcast as long as Spark finds the table small enough) and takes the best child within
    the row. Only trees that are deep below a level's concepts go on: levels are as many as the tree is deep. Hidden
    attributes must not be in the instances' maps. Instances of the same tree and values end in the same leaf, so each
    such pattern descends once and its leaf is joined to its instances.
    """
    pattern = F.struct("tree", F.array_sort(F.map_entries("nominal")).alias("nominal"), F.array_sort(F.map_entries("numeric")).alias("numeric"))
    instances = instances.select("inst", "tree", "nominal", "numeric", pattern.alias("pattern"))
    kinds = stored(instances.groupBy("pattern").agg(F.first("tree").alias("tree"), F.first("nominal").alias("nominal"), F.first("numeric").alias("numeric")), "patterns")
    child = F.struct("child", "size", "s", "attrs", "counts", "moments")
    stats = _stats(tree, scaling).filter("node IS NOT NULL").groupBy("tree", "node").agg(F.collect_list(child).alias("children"))  # a concept's own children
    stats = stored(stats, "children")
    root = tree.filter("parent IS NULL").select("tree", F.col("concept").alias("node"))
    depth = tree.agg(F.max("depth")).first()[0] or 0
    at = kinds.join(root, "tree")
    best = F.array_max(F.transform("children", lambda c: F.struct(F.round(_gain_of(c), 9).alias("rel"), c["size"].alias("size"), (-c["child"]).alias("minus"))))
    for level in range(depth):
        at = at.join(stats, ["tree", "node"], "left").withColumn("node", F.coalesce(-best["minus"], "node")).drop("children")
        if level % 4 == 3:
            at = stored(at, "descent")
    leaves = stored(at.select("pattern", F.col("node").alias("concept")), "leaves")  # its size is known, so few of them are broadcast
    return instances.select("inst", "tree", "pattern").join(leaves, "pattern").select("inst", "tree", "concept")


def predicted(placed: DataFrame, tree: DataFrame, attr: str) -> DataFrame:
    """inst, val: most likely value of ``attr`` in the leaf of each placed instance; null if missing is likelier."""
    c = nominal_counts(tree).filter(F.col("attr") == attr).join(tree.select("tree", "concept", F.col("n").alias("size")), ["tree", "concept"])
    known = c.groupBy("tree", "concept").agg(F.max_by("val", F.struct("n", F.lit(0))).alias("_"), F.max("n").alias("top"), (F.first("size") - F.sum("n")).alias("lack"))
    first = c.join(known, ["tree", "concept"]).filter("n = top").groupBy("tree", "concept").agg(F.min("val").alias("val"), F.first("top").alias("top"), F.first("lack").alias("lack"))
    return placed.join(first, ["tree", "concept"], "left").select("inst", F.when(F.col("lack") <= F.col("top"), F.col("val")).alias("val"))


#: What a search for cuts may go by: category utility, to be great, or an information criterion, to be small.
HEURISTICS = ("cu", "aic", "aicc", "bic")


def cut_weights(tree: DataFrame, scaling: float = 0.5, likelihoods: bool = True) -> DataFrame:
    """tree, concept, parent, n, w, l, p of each concept as a cluster.

    ``w``: size times expected correct guesses. ``l``: log likelihood of the instances of the leaves below it, itself
    included, under it. ``p``: its parameters. The measures of a cut are sums of its clusters' numbers, so opening a
    cluster changes them by its children's sum less its own. Each leaf meets each of its ancestors once.
    """
    keys = ["tree", "concept"]
    w = _stats(tree, scaling).select("tree", F.col("child").alias("concept"), F.coalesce(F.col("s") / F.nullif(F.col("size") * F.size("attrs"), F.lit(0)), F.lit(0.0)).alias("w"))
    nodes = tree.select("tree", "concept", "parent", "n").join(w, keys)
    if not likelihoods:
        return nodes.withColumns({"l": F.lit(0.0), "p": F.lit(0).cast("long")})
    count, number = nominal_counts(tree), numeric_moments(tree)
    name = lambda c: F.concat_ws("/", "tree", F.col(c).cast("string"))
    weighted = stored(measures.weighted_values(count, number, tree.select(*keys, F.col("n").alias("size")), keys).select(name("concept").alias("key"), "attr", "val", "p", "mean", "std"), "weighted")
    leaves = tree.join(tree.select("tree", F.col("parent").alias("concept")).distinct(), keys, "left_anti")
    pairs = stored(leaves.select("tree", F.col("concept").alias("leaf"), "n", F.explode("path").alias("concept")).select(*keys, "n", name("concept").alias("parent_key"), name("leaf").alias("child_key")), "pairs")
    ll = measures.log_likelihood_mixed(weighted, weighted, pairs.select("parent_key", "child_key"))
    total = pairs.join(ll, ["parent_key", "child_key"], "left").groupBy(*keys).agg(F.sum(F.coalesce("ll", F.lit(0.0)) * F.col("n")).alias("l"))
    k = measures.parameters(count, number, keys).withColumnRenamed("k", "p")
    return nodes.join(total, keys, "left").join(k, keys, "left").select(*nodes.columns, "l", F.coalesce("p", F.lit(0)).alias("p"))


def openings(tree: DataFrame, splits: int, scaling: float = 0.5, most: int | None = None, heuristic: str = "cu") -> DataFrame:
    """tree, node, opened, cu, score: the first ``splits`` clusters that a greedy search opens, and each cut's measures.

    Each time the cluster is opened whose opening gives the best score by ``heuristic`` (``HEURISTICS``; ties: the
    smallest concept). Cut 1 opens the root. With ``most``, all openings whose cuts have at most so many clusters,
    whatever ``splits`` is. A step is a join and a small aggregation over the open clusters of all trees at once.
    """
    if heuristic not in HEURISTICS:
        raise ValueError(f"no such heuristic: {heuristic}")
    weights = stored(cut_weights(tree, scaling, heuristic != "cu"), "weights")
    parts = ["w", "l", "p"]
    below = weights.filter("parent IS NOT NULL").groupBy("tree", F.col("parent").alias("concept")).agg(*[F.sum(c).alias(f"k{c}") for c in parts], F.count(F.lit(1)).alias("children"))
    change = stored(weights.join(below, ["tree", "concept"]).select("tree", "concept", "parent", *[(F.col(f"k{c}") - F.col(c)).alias(f"d{c}") for c in parts], (F.col("children") - 1).alias("dk")), "changes")
    root = weights.filter("parent IS NULL").join(change.drop("parent"), ["tree", "concept"], "left")
    start = [(F.col(c) + F.coalesce(f"d{c}", F.lit(0))).alias(c) for c in parts]
    cut = root.select("tree", F.col("concept").alias("node"), F.col("w").alias("w0"), F.col("n").alias("size"), *start, (1 + F.coalesce("dk", F.lit(0))).alias("k"))
    sign = -1.0 if heuristic == "cu" else 1.0

    def measured(w: Column, ll: Column, p: Column, k: Column) -> tuple[Column, Column]:
        """(utility, score)"""
        cu = (w - F.col("w0")) / (F.col("size") * k)
        return cu, cu if heuristic == "cu" else measures.criteria(ll, p, F.col("size"))[heuristic]

    step = 1
    cut = stored(cut.filter(F.lit(most is None) | (F.col("k") <= (most or 0))), "cut")
    frontier = stored(change.join(cut.select("tree", F.col("node").alias("parent")), ["tree", "parent"]).drop("parent"), "frontier")
    rows = []
    while True:
        cu, score = measured(F.col("w"), F.col("l"), F.col("p"), F.col("k"))
        rows.append(cut.select("tree", "node", F.lit(step).alias("opened"), cu.alias("cu"), score.alias("score")))
        step += 1
        if most is None and step > splits:
            break
        options = frontier.join(cut.drop("node"), "tree")
        _, score = measured(*[F.col(c) + F.col(f"d{c}") for c in parts], F.col("k") + F.col("dk"))
        first = F.struct(F.round(sign * score, 12).alias("score"), "concept")
        kept = F.struct("concept", "w0", "size", *[(F.col(c) + F.col(f"d{c}")).alias(c) for c in parts], (F.col("k") + F.col("dk")).alias("k"))
        best = options.groupBy("tree").agg(F.min_by(kept, first).alias("b")).select("tree", F.col("b.concept").alias("node"), "b.w0", "b.size", *[f"b.{c}" for c in [*parts, "k"]])
        cut = stored(best.filter(F.lit(most is None) | (F.col("k") <= (most or 0))), "cut")
        if cut.isEmpty():
            break
        going = frontier.join(cut.select("tree", F.col("node")), "tree").filter("concept <> node").drop("node")
        new = change.join(cut.select("tree", F.col("node").alias("parent")), ["tree", "parent"]).drop("parent")
        frontier, spent = stored(going.unionByName(new), "frontier"), frontier
        discard(spent)
    return reduce(DataFrame.unionByName, rows)


def split_search(opened: DataFrame, heuristic: str = "cu") -> DataFrame:
    """tree, split, score: of the cuts of ``openings`` by the same ``heuristic`` the best one, the smaller among equals."""
    sign = -1.0 if heuristic == "cu" else 1.0
    best = F.min_by(F.struct("opened", "score"), F.struct(F.round(sign * F.col("score"), 12), "opened"))
    return opened.groupBy("tree").agg(best.alias("b")).select("tree", F.col("b.opened").alias("split"), "b.score")


def cuts(tree: DataFrame, opened: DataFrame) -> DataFrame:
    """tree, split, concept, label: the cluster of each leaf under each cut of ``opened`` (see ``openings``)."""
    nodes = tree.select("tree", "concept", "parent", "path")
    leaves = nodes.join(nodes.select("tree", F.col("parent").alias("concept")).distinct(), ["tree", "concept"], "left_anti")
    splits = opened.select("tree", F.col("opened").alias("split"))
    steps = leaves.join(splits, "tree").select("tree", "concept", "split", F.posexplode("path").alias("at", "node"))
    shut = steps.join(opened.select("tree", "node", "opened"), ["tree", "node"], "left").filter(F.col("opened").isNull() | (F.col("opened") > F.col("split")))
    label = shut.groupBy("tree", "split", "concept").agg(F.min_by("node", "at").alias("label"))
    every = leaves.join(splits, "tree").select("tree", "split", "concept")
    return every.join(label, ["tree", "split", "concept"], "left").select("tree", "split", "concept", F.concat(F.lit("Concept"), F.coalesce("label", "concept").cast("string")).alias("label"))


def k_clusters(cut: DataFrame, k: int) -> DataFrame:
    """The largest cut of each tree with at most ``k`` clusters."""
    if k < 2:
        raise ValueError("k is under two")
    many = cut.groupBy("tree", "split").agg(F.count_distinct("label").alias("c")).filter(F.col("c") <= k).groupBy("tree").agg(F.max("split").alias("split"))
    return cut.join(many, ["tree", "split"])


def largest_cut(tree: DataFrame, k: int) -> DataFrame:
    """tree, split, concept, label: the largest cut of each tree with at most ``k`` clusters, however many openings it takes.

    Where the root has more than ``k`` children it is the root alone, as split 0.
    """
    if k < 2:
        raise ValueError("k is under two")
    opened = stored(openings(tree, 1, most=k), "openings")
    cut = cuts(tree, opened)
    last = opened.groupBy("tree").agg(F.max("opened").alias("split"))
    nodes = tree.select("tree", "concept", "parent")
    leaves = nodes.join(nodes.select("tree", F.col("parent").alias("concept")).distinct(), ["tree", "concept"], "left_anti").join(last, "tree", "left_anti")
    root = nodes.filter("parent IS NULL").select("tree", F.concat(F.lit("Concept"), F.col("concept").cast("string")).alias("label"))
    whole = leaves.join(root, "tree").select("tree", F.lit(0).alias("split"), "concept", "label")
    return cut.join(last, ["tree", "split"]).unionByName(whole)


def from_paths(placed: DataFrame, levels: list[str], nominal: dict[str, Column], numeric: dict[str, Column] | None = None, name: str = "tree") -> DataFrame:
    """The concepts of a fixed hierarchy of columns with their statistics, as a fitted tree's rows.

    A concept's number is its place in depth and name order; ``placed`` holds one row for each instance.
    """
    parts = F.array(F.lit(""), *[F.col(c).cast("string") for c in levels])
    each = placed.select(F.explode(F.sequence(F.lit(1), F.size(parts))).alias("_d"), parts.alias("_p"), *[c.cast("string").alias(f"n_{i}") for i, c in enumerate(nominal.values())], *[c.cast("double").alias(f"m_{i}") for i, c in enumerate((numeric or {}).values())])
    each = stored(each.withColumn("_k", F.concat_ws("/", F.slice("_p", F.lit(1), F.col("_d")))).drop("_p"), "placed")
    nodes = each.groupBy("_k", "_d").agg(F.count(F.lit(1)).alias("n"))
    nodes = stored(nodes.withColumn("concept", F.row_number().over(Window.orderBy("_d", "_k")).cast("long")), "concepts")  # one row a concept
    none = F.lit(None).cast("map<string,map<string,bigint>>")
    counts = None
    for i, a in enumerate(nominal):
        part = each.filter(f"n_{i} IS NOT NULL").groupBy("_k", F.col(f"n_{i}").alias("v")).agg(F.count(F.lit(1)).alias("c")).groupBy("_k").agg(F.struct(F.lit(a).alias("a"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("v", "c")))).alias("m")).alias("e"))
        counts = part if counts is None else counts.unionByName(part)
    tables = nodes.join(counts.groupBy("_k").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("e.a"), F.to_json("e.m").alias("j"))))).alias("nominal")), "_k", "left") if counts is not None else nodes.withColumn("nominal", none)
    text = F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries("nominal"), lambda e: F.concat(F.lit('"'), F.replace(e["key"], F.lit('"'), F.lit('\\"')), F.lit('":'), e["value"])), ","), F.lit("}"))
    tables = tables.withColumn("nominal", F.coalesce(text, F.lit("{}")))
    values = [F.struct(F.lit(a).alias("a"), F.array(*[m.cast("double") for m in moments_of(f"m_{i}")]).alias("m")) for i, a in enumerate(numeric or {})]
    if values:
        moments = each.groupBy("_k").agg(F.array(*values).alias("ms"))
        moments = moments.select("_k", F.to_json(F.map_from_entries(F.filter("ms", lambda e: e["m"][0] > 0))).alias("numeric"))
        tables = tables.join(moments, "_k", "left")
    else:
        tables = tables.withColumn("numeric", F.lit("{}"))
    up = nodes.select(F.col("_k").alias("_a"), F.col("concept").alias("_c"))
    steps = nodes.select("_k", F.explode(F.transform(F.sequence(F.lit(1), F.col("_d")), lambda d: F.concat_ws("/", F.slice(F.split("_k", "/"), F.lit(1), d)))).alias("_a")).join(up, "_a")
    paths = steps.groupBy("_k").agg(F.array_sort(F.collect_list("_c")).alias("path"))
    rows = tables.join(paths, "_k")
    return rows.select(F.lit(name).alias("tree"), "concept", F.get("path", F.size("path") - 2).alias("parent"), (F.col("_d") - 1).cast("int").alias("depth"), "n", "path", "nominal", "numeric", F.substr("_k", F.lit(2)).alias("label"))


def infer(instances: DataFrame, tree: DataFrame, attrs: list[str] | None = None, allow_none: bool = True, seed: int | None = None) -> DataFrame:
    """inst, attr, sval, nval: what each placed instance (inst, tree, concept, nominal, numeric) lacks, by its concept.

    All of the concept's attributes that the instance hasn't are inferred, or those of ``attrs``: the likeliest choice, or
    one drawn by ``seed`` for each concept. An attribute that is likeliest to be missing has neither value; with
    ``allow_none`` false being missing is no choice.
    """
    count, number, size = nominal_counts(tree), numeric_moments(tree), tree.select("tree", "concept", F.col("n").alias("size"))
    if attrs is not None:
        count, number = count.filter(F.col("attr").isin(attrs)), number.filter(F.col("attr").isin(attrs))
    keys = ["tree", "concept"]
    guess = measures.predicted_values(measures.weighted_values(count, number, size, keys), keys, allow_none, seed)
    rows = instances.join(guess, keys)
    has = F.array_contains(F.map_keys("nominal"), F.col("attr")) | F.array_contains(F.map_keys("numeric"), F.col("attr"))
    return rows.filter(~has).select("inst", "attr", "sval", "nval")


def scored(instances: DataFrame, tree: DataFrame, attr: str, actual: str) -> DataFrame:
    """inst, error, absolute, squared: of predicting ``attr`` in the concept of each placed instance (inst, tree, concept).

    ``actual`` names the column of the true value. A number's error is the difference to the mean; a name's is 0 or 1, and
    a missing value's too, which is right where being missing is likeliest.
    """
    guess = measures.predicted_values(measures.weighted_values(nominal_counts(tree).filter(F.col("attr") == attr), numeric_moments(tree).filter(F.col("attr") == attr), tree.select("tree", "concept", F.col("n").alias("size")), ["tree", "concept"]), ["tree", "concept"])
    rows = instances.join(guess, ["tree", "concept"], "left")
    number = isinstance(instances.schema[actual].dataType, T.NumericType)
    error = (F.col(actual) - F.col("nval")) if number else F.when(F.col(actual).eqNullSafe(F.col("sval")), 0.0).otherwise(1.0)
    return rows.select("inst", error.alias("error"), F.abs(error).alias("absolute"), (error * error).alias("squared"))


def cut_criteria(tree: DataFrame, cut: DataFrame, leaves: DataFrame) -> DataFrame:
    """tree, split, clusters, aic, aicc, bic of each cut (``cuts``): how well its clusters explain the instances in their leaves.

    ``leaves``: tree, concept, n of the leaves. An instance's likelihood is its leaf's under its cluster.
    """
    size = tree.select("tree", "concept", F.col("n").alias("size"))
    weighted = stored(measures.weighted_values(nominal_counts(tree), numeric_moments(tree), size, ["tree", "concept"]), "weighted")
    named = weighted.select(F.concat_ws("/", "tree", F.col("concept").cast("string")).alias("key"), "attr", "val", "p", "mean", "std")
    cluster = F.concat_ws("/", "tree", F.regexp_extract("label", r"(\d+)$", 1))
    placed = cut.select("tree", "split", cluster.alias("parent_key"), F.concat_ws("/", "tree", F.col("concept").cast("string")).alias("child_key"), "concept").join(leaves, ["tree", "concept"])
    ll = measures.log_likelihood_mixed(named, named, placed.select("parent_key", "child_key").distinct())
    total = placed.join(ll, ["parent_key", "child_key"]).groupBy("tree", "split").agg(F.sum(F.col("ll") * F.col("n")).alias("ll"), F.sum("n").alias("n"))
    k = measures.parameters(nominal_counts(tree), numeric_moments(tree), ["tree", "concept"]).select(F.concat_ws("/", "tree", F.col("concept").cast("string")).alias("parent_key"), "k")
    clusters = placed.select("tree", "split", "parent_key").distinct().join(k, "parent_key").groupBy("tree", "split").agg(F.sum("k").alias("k"), F.count(F.lit(1)).alias("clusters"))
    score = measures.criteria(F.col("ll"), F.col("k"), F.col("n"))
    return total.join(clusters, ["tree", "split"]).select("tree", "split", "clusters", *[c.alias(name) for name, c in score.items()])


def _own_json() -> Column:
    """A concept's name, size and counts as JSON, without braces."""
    number = F.transform_values(F.from_json("numeric", "map<string,array<double>>"), lambda k, m: F.struct(m[1].alias("mean"), F.sqrt(m[2] / m[0]).alias("std"), m[0].cast("long").alias("n")))
    moments = F.transform(F.map_entries(number), lambda e: F.concat(F.lit('"'), e["key"], F.lit('":{"#ContinuousValue#":'), F.to_json(e["value"]), F.lit("}")))
    counts = F.transform(F.map_entries(F.from_json("nominal", "map<string,map<string,bigint>>")), lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), F.to_json(e["value"])))
    return F.concat(F.lit('"name":"Concept'), F.col("concept").cast("string"), F.lit('","size":'), F.col("n").cast("string"), F.lit(',"counts":{'), F.array_join(F.concat(counts, moments), ","), F.lit("}"))


def nested_nodes(tree: DataFrame) -> DataFrame:
    """tree, concept, depth, path, own: what the nested sink writes (``sources.nested``)."""
    return tree.select("tree", "concept", "depth", "path", _own_json().alias("own"))


def nested_json(tree: DataFrame) -> DataFrame:
    """tree, json: each tree as one nested JSON text (name, size, children, counts), built from the leaves up.

    A tree's text is one value; large trees are better exported as rows (``node_json``).
    """
    rows = stored(tree.select("tree", "concept", "parent", "depth", _own_json().alias("own")), "export")
    deepest = rows.agg(F.max("depth")).first()[0] or 0
    below = rows.filter(F.col("depth") == deepest).select("tree", "concept", "parent", F.concat(F.lit("{"), "own", F.lit(',"children":[]}')).alias("json"))
    for depth in range(deepest - 1, -1, -1):
        kids = below.groupBy("tree", F.col("parent").alias("concept")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("concept", "json"))), lambda x: x["json"]), ",").alias("kids"))
        level = rows.filter(F.col("depth") == depth).join(kids, ["tree", "concept"], "left")
        below = stored(level.select("tree", "concept", "parent", F.concat(F.lit("{"), "own", F.lit(',"children":['), F.coalesce("kids", F.lit("")), F.lit("]}")).alias("json")), "export")
    return below.select("tree", "json")


def printed(tree: DataFrame) -> DataFrame:
    """tree, place, line: a readable line for each concept, indented by its depth, in the order of their paths."""
    line = F.concat(F.repeat(F.lit("  "), F.col("depth")), F.lit("|-Concept"), F.col("concept").cast("string"), F.lit(" ("), F.col("n").cast("string"), F.lit(") "), "nominal", F.lit(" "), "numeric")
    return tree.select("tree", F.array_join(F.transform("path", lambda x: F.lpad(x.cast("string"), 19, "0")), "/").alias("place"), line.alias("line"))


def node_json(tree: DataFrame) -> DataFrame:
    """tree, concept, parent, depth, json of each concept: what a viewer reads, one concept a row."""
    body = F.to_json(F.struct(F.concat(F.lit("Concept"), F.col("concept").cast("string")).alias("name"), F.col("n").alias("size"), F.col("nominal").alias("counts"), F.col("numeric").alias("moments")))
    return tree.select("tree", "concept", "parent", "depth", body.alias("json"))
