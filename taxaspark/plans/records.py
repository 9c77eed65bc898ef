"""Records of any shape: nested JSON or VARIANT values flattened to rows, and checked, level by level.

Records need not share a schema. Each round takes the fields of all objects of one depth apart, so there are as many
rounds as the deepest record has levels; what a round hands on are the objects within, nothing else.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taxaspark.storage import stored


def _name(key: Column, outer: Column) -> Column:
    """Name of a field: its key, or [key, outer] within another one; a hidden field within another is marked by a leading "_"."""
    inside = F.to_json(F.array(key))
    text = F.substr(inside, F.lit(2), F.length(inside) - 2)
    around = F.when(outer.startswith("["), outer).otherwise(F.regexp_replace(F.to_json(F.array(outer)), r"^\[|\]$", ""))
    nested = F.concat(F.lit("["), text, F.lit(","), around, F.lit("]"))
    return F.when(outer.isNull(), key).when(key.startswith("_"), F.concat(F.lit('["_",'), nested, F.lit("]"))).otherwise(nested)


def fields(df: DataFrame, inst: str, column: str) -> DataFrame:
    """inst, attr, key, kind, value (VARIANT): every field of every record that isn't an object, and empty objects.

    ``column``: JSON text or VARIANT. What isn't an object, or no JSON, comes as one row with a null attr.
    """
    spark = df.sparkSession
    whole = F.col(column) if isinstance(df.schema[column].dataType, T.VariantType) else F.try_parse_json(F.col(column))
    kind = F.regexp_extract(F.schema_of_variant("value"), r"^[A-Z]+", 0)
    text = F.lit(None).cast("string")
    level = df.select(F.col(inst), text.alias("attr"), text.alias("key"), whole.alias("value")).withColumn("kind", kind)
    odd = F.coalesce(F.col("kind") != "OBJECT", F.lit(True)) | (F.to_json("value") == "{}")
    found = []
    while True:
        level = stored(level, "level")
        found.append(level.filter(odd))
        inner = level.filter(~odd)
        if inner.isEmpty():
            return reduce(DataFrame.unionByName, found).select(inst, "attr", "key", "kind", "value")
        each = inner.select(inst, F.col("attr").alias("_outer"), F.col("value").alias("_v")).lateralJoin(spark.tvf.variant_explode(F.col("_v").outer()))
        level = each.select(inst, _name(F.col("key"), F.col("_outer")).alias("attr"), "key", "value").withColumn("kind", kind)


def flatten_records(df: DataFrame, inst: str, column: str) -> DataFrame:
    """inst, attr, sval, nval of nested records: names as ``transforms.flatten`` gives them, [inner, outer] and so on.

    Numbers are numbers; names, booleans, and lists (as JSON text) are nominal; nulls, empty objects, and what isn't a
    record have no row.
    """
    number = F.col("kind").isin("BIGINT", "DOUBLE", "DECIMAL", "FLOAT", "INT", "TINYINT", "SMALLINT")
    text = F.when(F.col("kind") == "ARRAY", F.to_json("value")).otherwise(F.try_variant_get("value", "$", "string"))
    rows = fields(df, inst, column).filter(F.col("attr").isNotNull() & ~F.col("kind").isin("VOID", "OBJECT"))
    return rows.select(inst, "attr", F.when(~number, text).alias("sval"), F.when(number, F.try_variant_get("value", "$", "double")).alias("nval"))


def relation_faults(df: DataFrame, column: str) -> DataFrame:
    """``df`` with ``part``: each part of the relation in ``column`` (a JSON array's text) that is neither a name nor such an array.

    A part's text is its JSON; an empty name is a fault as well. What doesn't begin as an array has no faults; one that
    isn't JSON is a fault as a whole.
    """
    spark, names = df.sparkSession, df.columns
    rows = df.filter(F.col(column).startswith("[")).select(F.struct(*names).alias("_row"), F.try_parse_json(F.col(column)).alias("_v"))
    found, level = [rows.filter("_v IS NULL").select("_row", F.col(f"_row.{column}").alias("part"))], rows.filter("_v IS NOT NULL")
    while True:
        each = level.lateralJoin(spark.tvf.variant_explode(F.col("_v").outer())).select("_row", F.col("value").alias("_v"), F.regexp_extract(F.schema_of_variant("value"), r"^[A-Z]+", 0).alias("kind"))
        each = stored(each, "parts")
        legal = (F.col("kind") == "ARRAY") | (F.col("kind") == "STRING") & (F.try_variant_get("_v", "$", "string") != "")
        found.append(each.filter(~legal).select("_row", F.to_json("_v").alias("part")))
        level = each.filter("kind = 'ARRAY'").select("_row", "_v")
        if level.isEmpty():
            return reduce(DataFrame.unionByName, found).select("_row.*", "part")


def faults(df: DataFrame, inst: str, column: str) -> DataFrame:
    """inst, attr, fault of every record's illegal fields; a sound table gives no rows.

    ``record``: not an object. ``name``: a field without a name. ``value``: a list, which has to be taken apart or turned
    to text first. ``none``: a null, which has to be left out. ``part``: a relation with a part that isn't a name.
    """
    rows = stored(fields(df, inst, column), "fields")
    fault = F.when(F.col("attr").isNull(), "record").when(F.col("key") == "", "name").when(F.col("kind") == "ARRAY", "value").when(F.col("kind") == "VOID", "none")
    own = rows.select(inst, "attr", fault.alias("fault")).filter("fault IS NOT NULL")
    parts = relation_faults(rows.select(inst, "attr", "key"), "key").select(inst, "attr", F.lit("part").alias("fault")).distinct()
    return own.unionByName(parts)


def sound(df: DataFrame, inst: str, column: str) -> DataFrame:
    """``df``; an error that names the first of its ``faults``, if there are any."""
    first = faults(df, inst, column).orderBy(inst, "attr", "fault").first()
    if first:
        raise ValueError(f"instance {first[inst]}: {first['fault']} at {first['attr']}")
    return df
