"""Connected components over links held in tables, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxaspark.llm.common import discard, joined, stored


def components(links: DataFrame) -> DataFrame:
    """node, root for every node of ``links`` (a, b), stored; root is the smallest node of its component.

    Each step makes a node point to the smallest neighbour that it has seen, which halves chains; steps go on until the
    links stop changing; each edge gives one link at most to the next table, so their number bounds the next ones. Every step's links are written to the shared folder, never to the driver, and deleted after the
    next one. The neighbours of a node with many of them meet it where they are (``joined``).
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    now, seen = (edges.count(),), None
    while now[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("size")), "low")
        large = stored(joined(both, low, ["u"], total=2 * now[0]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "large")
        small_low = stored(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("size")), "low")
        small = joined(large, small_low, ["u"], total=now[0]).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = stored(small.unionByName(small_low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "links")
        discard(edges, low, large, small_low)
        edges = after
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == seen:
            break
        seen = tuple(now)
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def first_rows(marked: DataFrame, *more: Column) -> DataFrame:
    """__node, first (none, id, n) of each class of rows: its smallest doc_id, nulls last, and its rows with that id; and ``more``."""
    ids = marked.groupBy("__node", "doc_id").agg(F.count(F.lit(1)).alias("n"), *more)
    names = [c for c in ids.columns if c not in ("__node", "doc_id", "n")]
    return ids.groupBy("__node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "n")).alias("first"), *[F.first(c).alias(c) for c in names])


def keep_least(marked: DataFrame, classes: DataFrame, roots: DataFrame, columns: list[str]) -> DataFrame:
    """Of each component one row of ``marked``: of those with its smallest doc_id, nulls last, the least (text, ...).

    ``classes`` are the rows' classes (see ``first_rows``), ``roots`` the node and root of those that are linked.
    """
    rooted = stored(classes.join(roots, classes["__node"] == roots["node"], "left").select(F.col("__node").alias("__at"), F.coalesce("root", "__node").alias("__root"), F.struct("first.none", "first.id").alias("__first"), F.col("first.n").alias("__n")), "rooted")
    low = rooted.groupBy("__root").agg(F.min("__first").alias("__low"), F.count(F.lit(1)).alias("size"))
    mine = joined(rooted, low, ["__root"]).filter(F.col("__first") == F.col("__low"))  # a null id is equal within a struct
    several = mine.groupBy("__root").agg(F.sum("__n").alias("__rows"), F.count(F.lit(1)).alias("size"))
    mine = stored(mine.select("__root", "__at", F.col("__first.id").alias("__id")), "mine")
    kept = stored(joined(mine, stored(several, "several"), ["__root"]), "kept")
    rows = marked.join(kept, (F.col("__node") == F.col("__at")) & F.col("doc_id").eqNullSafe(F.col("__id")))
    once = rows.filter("__rows = 1").select(*columns)
    order = ["text", *[c for c in columns if c != "text"]]
    again = rows.filter("__rows > 1").groupBy("__root").agg(F.min(F.struct(*order)).alias("row")).select(*[F.col("row")[c].alias(c) for c in columns])
    return once.unionByName(again)
