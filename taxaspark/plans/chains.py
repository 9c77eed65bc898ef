"""Chains and trees that are held by pointers alone: places, sizes and depths by pointer jumping.

An element that knows its next one is n - 1 steps from the end of a chain of n. In each round every element takes over
what the one it points to has summed up and where that points, so a chain of n takes log n joins of its n rows; no row
grows with the chain. A tree becomes a chain by its tour, which enters and leaves each node once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taxaspark.storage import discard, stored


def list_ranks(links: DataFrame, by: list[str], weights: list[str] | None = None) -> DataFrame:
    """by, id, last, after, and the sums of ``weights``, for every element of chains.

    ``links``: by, id, next (null at a chain's end) and the weights; ids are unique within ``by``. ``last``: the chain's
    end. ``after``: the elements behind. A sum is over the element and all behind it. An element whose chain has no end,
    as it runs in a circle, or that points to none of the elements, has a null ``last``.
    """
    weights = weights or []
    most = max(1, links.groupBy(*by).count().agg(F.max("count")).first()[0] or 1) if by else max(1, links.count())
    ends = F.col("next").isNull()
    state = stored(links.select(*by, "id", "next", F.when(ends, F.col("id")).alias("last"), F.when(ends, 0).otherwise(1).cast("long").alias("after"), *weights), "chain")
    for _ in range(most.bit_length() + 1):
        going = state.filter("next IS NOT NULL")
        if going.isEmpty():
            break
        ahead = state.select(*by, F.col("id").alias("next"), F.col("next").alias("_n"), F.col("last").alias("_l"), F.col("after").alias("_a"), *[F.col(w).alias(f"_{w}") for w in weights])
        # no round's table goes to the driver to be broadcast; one that leads to none of the elements has lost its end
        moved = going.join(ahead.hint("merge"), [*by, "next"], "left").select(*by, "id", F.col("_n").alias("next"), F.col("_l").alias("last"), *[(F.col(w) + F.coalesce(v, F.lit(0))).alias(w) for w, v in [("after", "_a"), *[(w, f"_{w}") for w in weights]]])
        state, spent = stored(state.filter("next IS NULL").unionByName(moved), "chain"), state
        discard(spent)
    return state.select(*by, "id", F.when(F.col("next").isNull(), F.col("last")).alias("last"), "after", *weights)


def tour(tree: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, concept, parent, root, depth, size, enters, leaves of each node of trees given by concept and parent alone.

    ``size``: the nodes below, itself included. ``enters`` and ``leaves`` are its places in the tree's tour, counted from
    the end, so a node lies below another one just if its places lie within the other's. ``by`` names the columns that
    tell trees apart, beside their roots. A node that no root leads to has nulls.
    """
    by = by or []
    nodes = tree.select(*by, "concept", "parent")
    siblings = Window.partitionBy(*by, "parent").orderBy("concept")
    placed = nodes.withColumn("beside", F.when(F.col("parent").isNotNull(), F.lead("concept").over(siblings)))
    first = nodes.filter("parent IS NOT NULL").groupBy(*by, F.col("parent").alias("concept")).agg(F.min("concept").alias("first"))
    node = lambda c, way: F.struct(F.col(c).alias("concept"), F.lit(way).alias("way"))
    none = F.lit(None)
    joined = placed.join(first, [*by, "concept"], "left")
    enter = joined.select(*by, node("concept", 0).alias("id"), F.when(F.col("first").isNotNull(), node("first", 0)).otherwise(node("concept", 1)).alias("next"), F.lit(1).cast("long").alias("level"))
    leave = joined.select(*by, node("concept", 1).alias("id"), F.when(F.col("beside").isNotNull(), node("beside", 0)).when(F.col("parent").isNotNull(), node("parent", 1)).otherwise(none).alias("next"), F.lit(-1).cast("long").alias("level"))
    ranks = list_ranks(enter.unionByName(leave), by, ["level"])
    side = lambda way, **names: ranks.filter(F.col("id.way") == way).select(*by, F.col("id.concept").alias("concept"), *[F.col(c).alias(a) for a, c in names.items()])
    both = side(0, root="last.concept", enters="after", depth="level").join(side(1, leaves="after"), [*by, "concept"])
    whole = F.col("root").isNotNull()
    rows = nodes.join(both, [*by, "concept"])
    return rows.select(*by, "concept", "parent", "root", F.when(whole, -F.col("depth")).alias("depth"), F.when(whole, ((F.col("enters") - F.col("leaves") + 1) / 2).cast("long")).alias("size"), F.when(whole, F.col("enters")).alias("enters"), F.when(whole, F.col("leaves")).alias("leaves"))


def lies_below(pairs: DataFrame, toured: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``pairs`` (by, upper, lower) with ``below``: whether ``lower`` is ``upper`` or lies anywhere below it (``tour``)."""
    by = by or []
    ends = lambda side, p: toured.select(*by, F.col("concept").alias(side), F.col("root").alias(f"{p}root"), F.col("enters").alias(f"{p}in"), F.col("leaves").alias(f"{p}out"))
    rows = pairs.join(ends("upper", "u"), [*by, "upper"], "left").join(ends("lower", "l"), [*by, "lower"], "left")
    inside = (F.col("uroot") == F.col("lroot")) & (F.col("uin") >= F.col("lin")) & (F.col("uout") <= F.col("lout"))
    return rows.select(*pairs.columns, F.coalesce(inside, F.lit(False)).alias("below"))


def list_places(relations: DataFrame, by: list[str]) -> DataFrame:
    """by, position (from 0), element of every list whose order relations make one chain of all its elements.

    ``relations``: by (an instance, and the name of a list in it), relation, a, b, as ``transforms.list_relations`` gives
    them. Other lists are left out: those with two elements after one, or one after two, several beginnings, circles, or
    an order over elements that they don't have. A list may be of any length and its relations in any order.
    """
    elements = relations.filter("relation = 'has-element'").select(*by, F.col("a").alias("id")).distinct()
    order = relations.filter("relation = 'ordered-list'").select(*by, F.col("a").alias("id"), F.col("b").alias("next")).distinct()
    ends = order.select(*by, "id").unionByName(order.select(*by, F.col("next").alias("id"))).join(elements, [*by, "id"], "left_anti")
    twice = lambda c: order.groupBy(*by, c).count().filter("count > 1").select(*by)
    odd = ends.select(*by).unionByName(twice("id")).unionByName(twice("next")).distinct()
    links = stored(elements.join(odd, by, "left_anti").join(order, [*by, "id"], "left"), "links")
    ranks = stored(list_ranks(links, by), "ranks")
    whole = ranks.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count("last").alias("ended"), F.count_distinct("last").alias("lists"), F.max("after").alias("most"))
    whole = whole.filter("ended = n AND lists = 1 AND most = n - 1").select(*by, "n")
    return ranks.join(whole, by).select(*by, (F.col("n") - 1 - F.col("after")).alias("position"), F.col("id").alias("element"))
