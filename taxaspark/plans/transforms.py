"""Transformations of instances: nested to flat, lists to relations, renaming, conversions.

Composite attribute names are compact JSON arrays; a relation's parts, a path's steps and their nesting read off them.
A name that begins with ``?`` is a variable: it may be renamed when structures are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taxaspark.storage import discard, stored


def _nested(name: str, outer: Column | None) -> Column:
    """Name of an inner attribute: [inner, outer]; a hidden one is marked by a leading underscore part."""
    quoted = F.lit(f'"{name}"')
    if outer is None:
        return F.lit(name)
    path = F.concat(F.lit("["), quoted, F.lit(","), F.when(outer.startswith("["), outer).otherwise(F.concat(F.lit('"'), outer, F.lit('"'))), F.lit("]"))
    return F.concat(F.lit('["_",'), path, F.lit("]")) if name.startswith("_") else path


def _cells(column: Column, kind: T.StructType, outer: Column | None) -> list[Column]:
    out = []
    for f in kind.fields:
        attr, value = _nested(f.name, outer), column[f.name]
        if isinstance(f.dataType, T.StructType):
            out += _cells(value, f.dataType, attr)
        else:
            number = isinstance(f.dataType, T.NumericType)
            out.append(F.struct(attr.alias("attr"), (F.lit(None) if number else value).cast("string").alias("sval"), (value if number else F.lit(None)).cast("double").alias("nval")))
    return out


def flatten(df: DataFrame, inst: str, column: str) -> DataFrame:
    """inst, attr, sval, nval of a nested struct column; an inner value's name is [inner, outer], and so on inward."""
    cells = _cells(F.col(column), df.schema[column].dataType, None)
    rows = df.select(inst, F.explode(F.array(*cells)).alias("c")).select(inst, "c.attr", "c.sval", "c.nval")
    return rows.filter("sval IS NOT NULL OR nval IS NOT NULL")


def path_of(attr: Column) -> Column:
    """Steps of a flattened name, outermost first, without hidden marks."""
    return F.filter(F.reverse(F.regexp_extract_all(attr, F.lit(r'"([^"]*)"'), 1)), lambda x: x != "_")


def component_relations(path: Column) -> Column:
    """For a path, outermost first: a has-component relation of each two variables that follow one another in it."""
    v = F.filter(path, lambda x: x.startswith("?"))
    return F.transform(F.slice(v, 2, F.greatest(F.size(v) - 1, F.lit(0))), lambda inner, i: F.to_json(F.array(F.lit("has-component"), F.get(v, i), inner)))


def subcomponents(flat: DataFrame, inst: str) -> DataFrame:
    """Flat rows with each attribute of an inner variable hoisted to it, and has-component relations added."""
    path = path_of(F.col("attr"))
    v = F.filter(path, lambda x: x.startswith("?"))
    hoisted = F.when(F.size(v) > 1, F.to_json(F.array(F.element_at(path, -1), F.element_at(v, -1)))).otherwise(F.col("attr"))
    relations = flat.select(inst, F.explode(component_relations(path)).alias("attr")).distinct()
    return flat.withColumn("attr", hoisted).unionByName(relations.withColumn("sval", F.lit("true")).withColumn("nval", F.lit(None).cast("double")))


def component_paths(rows: DataFrame, inst: str) -> DataFrame:
    """inst, var, path: each inner variable with all variables around it, ["?inner",["?mid","?outer"]].

    Read off has-component relations, the greatest parent where there are several. Chains are followed by doubling: in
    each round a variable takes over the chain of the one that its own chain ends in, so depth d takes log d joins. A
    variable within itself is an error.
    """
    parts = F.from_json("attr", "array<string>")
    pairs = rows.filter(F.col("attr").startswith('["has-component"')).select(F.col(inst).alias("inst"), parts[2].alias("var"), parts[1].alias("next"))
    chains = pairs.groupBy("inst", "var").agg(F.max("next").alias("next")).select("inst", "var", F.concat(F.lit("["), _quoted(F.col("var")), F.lit(",")).alias("head"), F.lit(1).cast("long").alias("steps"), "next")
    chains = stored(chains.join(chains.groupBy("inst").agg(F.count(F.lit(1)).alias("most")), "inst"), "chains")
    while True:
        on = chains.select("inst", F.col("var").alias("next"), F.col("head").alias("_h"), F.col("steps").alias("_s"), F.col("next").alias("_n"))
        longer = chains.join(on, ["inst", "next"], "left")
        steps = F.col("steps") + F.coalesce("_s", F.lit(0))
        looped = F.raise_error(F.concat(F.lit("a component lies within itself: "), F.col("var"))).cast("long")
        after = stored(longer.select("inst", "var", F.concat("head", F.coalesce("_h", F.lit(""))).alias("head"), F.when(steps > F.col("most"), looped).otherwise(steps).alias("steps"), F.coalesce("_n", "next").alias("next"), "most", F.col("_n").isNotNull().alias("grew")), "chains")
        grew = not after.filter("grew").isEmpty()
        discard(chains)
        chains = after.drop("grew")
        if not grew:
            return chains.select(F.col("inst").alias(inst), "var", F.concat("head", _quoted(F.col("next")), F.repeat(F.lit("]"), F.col("steps").cast("int"))).alias("path"))


def _quoted(name: Column) -> Column:
    return F.concat(F.lit('"'), name, F.lit('"'))


def embedded(rows: DataFrame, inst: str) -> DataFrame:
    """Inverse of ``subcomponents`` at any depth: inner variables with all their parents around them, relations dropped.

    Variables within relations get their parents as well.
    """
    flat = rows.filter(~F.col("attr").startswith('["has-component"'))
    maps = component_paths(rows, inst).groupBy(inst).agg(F.map_from_entries(F.collect_list(F.struct("var", "path"))).alias("_m"))  # an instance's own variables
    joined = flat.join(maps, inst, "left")
    inside = F.array_join(F.transform(F.split("attr", '"'), lambda x, i: F.when(i % 2 == 1, F.coalesce(F.element_at("_m", x), _quoted(x))).otherwise(x)), "")
    whole = F.when(F.col("attr").startswith("["), inside).otherwise(F.coalesce(F.element_at("_m", F.col("attr")), F.col("attr")))
    return joined.withColumn("attr", F.when(F.col("_m").isNull(), F.col("attr")).otherwise(whole)).drop("_m")


def list_elements(df: DataFrame, inst: str, column: str) -> DataFrame:
    """inst, element (?o1, ?o2, ...), val: every list element as an object of its own."""
    return df.select(inst, F.posexplode(column).alias("_p", "val")).select(inst, F.concat(F.lit("?o"), (F.col("_p") + 1).cast("string")).alias("element"), "val")


def collected(elements: DataFrame, inst: str, column: str) -> DataFrame:
    """Inverse of ``list_elements``."""
    number = F.regexp_extract("element", r"\?o(\d+)$", 1).cast("int")
    rows = elements.groupBy(inst).agg(F.sort_array(F.collect_list(F.struct(number.alias("p"), F.col("val").alias("v")))).alias("_l"))  # a row's own list
    return rows.select(inst, F.transform("_l", lambda x: x["v"]).alias(column))


def list_relations(df: DataFrame, inst: str, order: str) -> DataFrame:
    """inst, relation, a, b: has-element of each row and ordered-list of each two that follow one another."""
    nxt = F.lead(order).over(Window.partitionBy(inst).orderBy(order))
    has = F.struct(F.lit("has-element").alias("relation"), F.col(order).alias("a"), F.lit(None).cast("long").alias("b"))
    pair = F.struct(F.lit("ordered-list").alias("relation"), F.col(order).alias("a"), F.col("_n").alias("b"))
    rows = df.select(inst, order).withColumn("_n", nxt).select(inst, F.explode(F.array(has, pair)).alias("r"))
    return rows.select(inst, "r.relation", "r.a", "r.b").filter("relation = 'has-element' OR b IS NOT NULL")


def ordered_lists(relations: DataFrame, inst: str) -> DataFrame:
    """Inverse of ``list_relations``: inst, items in order, where the pairs make one chain; other lists are left out."""
    has = relations.filter("relation = 'has-element'").groupBy(inst).agg(F.collect_set("a").alias("e"))
    pairs = relations.filter("relation = 'ordered-list'").groupBy(inst).agg(F.map_from_entries(F.collect_set(F.struct("a", "b"))).alias("m"))
    rows = has.join(pairs, inst, "left").withColumn("m", F.coalesce("m", F.create_map().cast("map<bigint,bigint>")))
    heads = F.array_except("e", F.map_values("m"))
    chain = F.aggregate("e", F.slice(heads, 1, 1), lambda acc, _: F.when(F.map_contains_key("m", F.element_at(acc, -1)), F.concat(acc, F.array(F.element_at("m", F.element_at(acc, -1))))).otherwise(acc))
    rows = rows.filter(F.size(heads) == 1).withColumn("items", chain)
    return rows.filter(F.size("items") == F.size("e")).select(inst, "items")


def variables(attr: Column, only: bool = True) -> Column:
    """Variables (or, with ``only`` false, all names) in an attribute, in order."""
    names = F.when(attr.startswith("["), F.regexp_extract_all(attr, F.lit(r'"([^"]*)"'), 1)).otherwise(F.array(attr))
    return F.filter(names, lambda x: x.startswith("?")) if only else names


def renamed(attr: Column, mapping: Column) -> Column:
    """An attribute with its names replaced where ``mapping`` (a map column) has them."""

    def one(x: Column) -> Column:
        return F.coalesce(F.element_at(mapping, x), x)

    inside = F.array_join(F.transform(F.split(attr, '"'), lambda x, i: F.when(i % 2 == 1, one(x)).otherwise(x)), '"')
    return F.when(attr.startswith("["), inside).otherwise(one(attr))


def standardized(av: DataFrame, inst: str) -> tuple[DataFrame, DataFrame]:
    """(rows with every variable renamed ?o1, ?o2, ... by first use in attribute order, mapping inst, old, new)."""
    own = F.struct("attr", F.coalesce(variables(F.col("attr")), F.array().cast("array<string>")).alias("v"))
    by_use = lambda uses: F.array_distinct(F.flatten(F.transform(F.array_sort(uses), lambda u: u["v"])))  # noqa: E731  an instance's own names
    new = lambda i: F.concat(F.lit("?o"), (i + 1).cast("string"))
    held = av.withColumn("_v", by_use(F.collect_list(own).over(Window.partitionBy(inst))))  # one shuffle and one sort, no join
    maps = F.map_from_arrays("_v", F.transform("_v", lambda x, i: new(i)))
    rows = held.withColumn("attr", F.when((F.size("_v") == 0) | F.col(inst).isNull(), F.col("attr")).otherwise(renamed(F.col("attr"), maps))).drop("_v")
    mapping = av.groupBy(inst).agg(by_use(F.collect_list(own)).alias("_v")).select(inst, F.posexplode("_v").alias("_i", "old")).select(inst, "old", new(F.col("_i")).alias("new"))
    return rows, mapping


def restored(av: DataFrame, mapping: DataFrame, inst: str) -> DataFrame:
    """Inverse of ``standardized``."""
    maps = mapping.groupBy(inst).agg(F.map_from_entries(F.collect_list(F.struct("new", "old"))).alias("_m"))
    return av.join(maps, inst, "left").withColumn("attr", F.when(F.col("_m").isNull(), F.col("attr")).otherwise(renamed(F.col("attr"), F.col("_m")))).drop("_m")


def tuplized(attr: Column) -> Column:
    """'(r a (s 1))' as ["r","a",["s",1.0]]; other names as they are."""
    quoted = F.regexp_replace(F.trim(attr), r'[^()\s]+', '"$0"')
    numbers = F.regexp_replace(F.regexp_replace(quoted, r'"(-?\d+)"', '"$1.0"'), r'"(-?\d+\.\d+)"', "$1")
    return F.when(attr.startswith("("), F.translate(F.regexp_replace(F.regexp_replace(numbers, r"\s*([()])\s*", "$1"), r'(?<=[^(])\s+|(?<=["\d)])(?=\()|(?<=\))(?=["\d-])', ","), "()", "[]")).otherwise(attr)


def stringified(attr: Column) -> Column:
    """Inverse of ``tuplized``."""
    return F.when(attr.startswith("["), F.translate(F.replace(attr, F.lit('"'), F.lit("")), "[],", "() ")).otherwise(attr)


def variablized(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Struct columns (all, or the named ones) as variables: their names get a leading question mark."""
    hit = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StructType) and (columns is None or f.name in columns)]
    return df.select(*[F.col(f"`{c}`").alias(f"?{c}" if c in hit and not c.startswith("?") else c) for c in df.columns])


def numeric_to_nominal(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Numbers and booleans (all, or the named columns) as text."""
    hit = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.NumericType, T.BooleanType)) and (columns is None or f.name in columns)]
    return df.withColumns({c: F.col(c).cast("string") for c in hit})


def nominal_to_numeric(df: DataFrame, columns: list[str] | None = None, on_fail: str = "break") -> DataFrame:
    """Text (all, or the named columns) as numbers. What isn't one stops the query (break), goes (drop) or is 0 (zero)."""
    hit = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and (columns is None or f.name in columns)]
    number = {c: F.expr(f"try_cast(`{c}` AS DOUBLE)") for c in hit}
    failed = {c: F.col(c).isNotNull() & number[c].isNull() for c in hit}
    if on_fail == "drop":
        return df.withColumns(number)
    if on_fail == "zero":
        return df.withColumns({c: F.when(failed[c], 0.0).otherwise(number[c]) for c in hit})
    return df.withColumns({c: F.when(failed[c], F.raise_error(F.concat(F.lit("not a number: "), F.col(c))).cast("double")).otherwise(number[c]) for c in hit})


def unflattened(av: DataFrame, inst: str) -> DataFrame:
    """inst, json: inverse of ``flatten``, each instance as nested JSON text, built from the innermost names outwards.

    Numbers and names keep their kinds; keys are in text order. ``F.from_json`` with the nested schema gives the struct
    back. A row's own attributes are gathered; instances are dealt over tasks.
    """
    path = F.filter(F.reverse(F.when(F.col("attr").startswith("["), F.regexp_extract_all("attr", F.lit(r'"([^"]*)"'), 1)).otherwise(F.array("attr"))), lambda x: x != "_")
    value = F.coalesce(F.col("nval").cast("string"), F.get(F.split(F.to_json(F.struct(F.col("sval").alias("v"))), '"v":', 2), F.lit(1)))
    value = F.when(F.col("nval").isNull(), F.regexp_replace(value, r"\}$", "")).otherwise(value)
    rows = av.select(F.col(inst), path.alias("_p"), value.alias("_j"))
    deepest = rows.agg(F.max(F.size("_p"))).first()[0] or 1
    for depth in range(deepest, 0, -1):
        here = rows.filter(F.size("_p") == depth)
        key = F.concat(F.lit('"'), F.element_at("_p", -1), F.lit('":'), "_j")
        up = here.groupBy(inst, F.slice("_p", 1, depth - 1).alias("_p")).agg(F.concat(F.lit("{"), F.array_join(F.sort_array(F.collect_list(key)), ","), F.lit("}")).alias("_j"))
        rows = rows.filter(F.size("_p") < depth).unionByName(up)
    return rows.select(inst, F.col("_j").alias("json"))


def sanitized(df: DataFrame, keep_structs: bool = True) -> DataFrame:
    """Lists and maps as key-ordered JSON text, and structs too unless they stay as components."""
    kinds = (T.ArrayType, T.MapType) if keep_structs else (T.ArrayType, T.MapType, T.StructType)

    def text(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(c))) if isinstance(f.dataType, T.MapType) else c)

    return df.withColumns({f.name: text(f) for f in df.schema.fields if isinstance(f.dataType, kinds)})


class Pipeline:
    """One transformation from several, each a function or a pair of a function and its inverse."""

    def __init__(self, *stages):
        self.stages = [s if isinstance(s, tuple) else (s, None) for s in stages]

    def transform(self, df: DataFrame) -> DataFrame:
        for do, _ in self.stages:
            df = df.transform(do)
        return df

    def undo(self, df: DataFrame) -> DataFrame:
        """The inverses in the opposite order; a stage without one changes nothing."""
        for _, undo in reversed(self.stages):
            df = df.transform(undo) if undo else df
        return df
