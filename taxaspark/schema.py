"""The long table that instances are turned into, and the tables that hold a tree of concepts.

An instance is a set of attribute values. Its rows in the long table are ``inst``, ``attr``, ``sval`` (a nominal value)
or ``nval`` (a number); a missing attribute has no row. An attribute whose name begins with ``_`` is hidden: it is kept
and predicted but never scored. Composite attributes are compact JSON arrays of their parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AV = "inst long, attr string, sval string, nval double"
CONCEPT = "tree string, concept long, parent long, depth int, n long, path array<long>"
CONCEPT_NOMINAL = "tree string, concept long, attr string, val string, n long"
CONCEPT_NUMERIC = "tree string, concept long, attr string, num long, mean double, m2 double"


def is_hidden(attr: Column) -> Column:
    """Whether an attribute is left out of scores: its first part begins with an underscore."""
    return attr.rlike(r'^(\["?)?_')


def inner_attr(attr: Column) -> Column:
    """First part of a composite attribute, the attribute itself otherwise; numeric scales are shared by it."""
    return F.when(attr.startswith("["), F.coalesce(F.get_json_object(attr, "$[0]"), attr)).otherwise(attr)


def long_table(df: DataFrame, inst: str, nominal: dict[str, Column], numeric: dict[str, Column] | None = None, keep: list[str] | None = None) -> DataFrame:
    """``df`` as inst, *keep, attr, sval, nval: one row for each present value; NaN counts as missing."""
    none_s, none_n = F.lit(None).cast("string"), F.lit(None).cast("double")
    cells = [F.struct(F.lit(a).alias("attr"), c.cast("string").alias("sval"), none_n.alias("nval")) for a, c in nominal.items()]
    for a, c in (numeric or {}).items():
        number = c.cast("double")
        cells.append(F.struct(F.lit(a).alias("attr"), none_s.alias("sval"), F.when(~F.isnan(number), number).alias("nval")))
    rows = df.select(F.col(inst).alias("inst"), *(keep or []), F.explode(F.array(*cells)).alias("c"))
    return rows.select("inst", *(keep or []), "c.attr", "c.sval", "c.nval").filter("sval IS NOT NULL OR nval IS NOT NULL")


def checked(av: DataFrame) -> DataFrame:
    """``av`` with a runtime error for a row without attribute name or value."""
    bad = F.col("attr").isNull() | (F.col("attr") == "") | (F.col("sval").isNull() & F.col("nval").isNull())
    return av.withColumn("attr", F.when(bad, F.raise_error(F.lit("an instance needs named attributes with values")).cast("string")).otherwise(F.col("attr")))
