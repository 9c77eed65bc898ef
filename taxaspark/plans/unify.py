"""Relations matched against relations: one equality join on what is fixed in them, then their variables' bindings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxaspark.plans.transforms import variables


def contains_component(attr: Column, name: Column) -> Column:
    """Whether a name occurs in an attribute, at any depth, or is it."""
    return F.array_contains(variables(attr, only=False), name) | (attr == name)


def skeleton(attr: Column) -> Column:
    """An attribute with all its variables alike: two attributes can match just if theirs are equal."""
    return F.when(attr.startswith("["), F.regexp_replace(attr, r'"\?[^"]*"', '"?"')).otherwise(F.regexp_replace(attr, r"^\?.*$", "?"))


#: Concepts of one relation that travel as one row, and shares that the rows of one relation are dealt to.
BLOCK, SHARES = 512, 32


def partial_matches(target: DataFrame, base: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """inst, attr, concept, base_attr, consistent of the pairs of attributes that match part by part.

    ``target``: inst, attr. ``base``: concept, attr. Parts that aren't variables must be equal, and variables stand
    opposite variables. ``mapping`` (inst, old, new): variables that are bound already; pairs that contradict it don't
    match. ``consistent``: no variable stands opposite two, on either side.

    Distinct attributes are matched once, so a row of the result costs no more than its own making. Concepts of an
    attribute come in blocks, and the rows that meet them are dealt to shares, so no task gets an attribute's rows whole.
    """
    mine = target.select("attr").distinct().withColumn("_s", skeleton(F.col("attr")))
    theirs = base.select(F.col("attr").alias("base_attr")).distinct().withColumn("_s", skeleton(F.col("base_attr")))
    pairs = mine.join(theirs, "_s").drop("_s").withColumn("_b", F.array_distinct(F.arrays_zip(variables(F.col("attr")).alias("o"), variables(F.col("base_attr")).alias("n"))))
    count = F.size("_b")
    once = (F.size(F.array_distinct(F.transform("_b", lambda p: p["o"]))) == count) & (F.size(F.array_distinct(F.transform("_b", lambda p: p["n"]))) == count)
    rows = _spread(target.select("inst", "attr"), pairs.select("attr", "base_attr", once.alias("consistent"), *([] if mapping is None else ["_b"])), "attr")
    if mapping is not None:
        held = mapping.groupBy("inst").agg(F.map_from_entries(F.collect_list(F.struct("old", "new"))).alias("_m"))  # an instance's own variables
        rows = rows.join(held, "inst", "left").filter(F.col("_m").isNull() | F.forall("_b", lambda p: F.coalesce(F.element_at("_m", p["o"]) == p["n"], F.lit(True)))).drop("_b", "_m")
    sizes = base.groupBy(F.col("attr").alias("base_attr")).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("_g"))
    dealt = base.select("concept", F.col("attr").alias("base_attr")).join(sizes, "base_attr").withColumn("_g", F.pmod(F.xxhash64("concept"), F.col("_g")))
    blocks = dealt.groupBy("base_attr", "_g").agg(F.collect_list(F.struct("concept"))["concept"].alias("_c")).drop("_g")  # some BLOCK concepts, nulls too
    return _spread(rows, blocks, "base_attr").select("inst", "attr", F.explode("_c").alias("concept"), "base_attr", "consistent")


def _spread(rows: DataFrame, marks: DataFrame, on: str) -> DataFrame:
    """``rows`` (inst, ...) joined with ``marks``, a copy of which goes to each of the shares that a key's rows are dealt to.

    By a merge join: rows that come of an explode seem few to Spark, which would broadcast them to the few tasks of ``marks``.
    """
    copies = marks.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    return rows.withColumn("_share", F.pmod(F.xxhash64("inst"), F.lit(SHARES)).cast("int")).join(copies.hint("merge"), [on, "_share"]).drop("_share")
