"""Registered queries over structured records: customers with an owner and a place of their own names, and a fixed tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxaspark.fixed import BASE, customers, debt
from taxaspark.operators import descent, structured
from taxaspark.plans import chains, measures, records as shapes, transforms, trees
from taxaspark.queries import query, table
from taxaspark.schema import long_table
from taxaspark.storage import stored


def _of(attr: str, variable: Column) -> Column:
    """The name of an attribute of a component: [attribute, variable]."""
    return F.to_json(F.array(F.lit(attr), variable))


def structured_tree(spark, sf_dir) -> DataFrame:
    """Customers under world, region and nation; segment and debt belong to ?who, the region to ?where, which has ?who."""
    names = {'["segment","?who"]': F.col("c_mktsegment"), '["debt","?who"]': debt(), '["region","?where"]': F.col("r_name"), '["has-component","?where","?who"]': F.lit("true")}
    return stored(descent.from_paths(customers(spark, sf_dir), ["r_name", "n_name"], names), "tree")


def records(spark, sf_dir, leave_out: tuple[str, ...] = ()) -> DataFrame:
    """inst, attr, sval, nval: each customer as nested records whose names are its own: ?p<key> within ?q<key>."""
    outer = F.concat(F.lit("?q"), F.col("c_custkey").cast("string"))
    inner = F.concat(F.lit("?p"), F.col("c_custkey").cast("string"))
    inside = F.concat(F.lit('",["'), inner, F.lit('","'), outer, F.lit('"]]'))
    cells = {"segment": (F.concat(F.lit('["segment'), inside), F.col("c_mktsegment")), "debt": (F.concat(F.lit('["debt'), inside), debt()), "region": (_of("region", outer), F.col("r_name"))}
    each = F.array(*[F.struct(a.alias("attr"), v.alias("sval")) for k, (a, v) in cells.items() if k not in leave_out])
    rows = customers(spark, sf_dir).select(F.col("c_custkey").cast("long").alias("inst"), F.explode(each).alias("c"))
    return rows.select("inst", "c.attr", "c.sval", F.lit(None).cast("double").alias("nval"))


def _best(level: str, within: str, seg: bool) -> str:
    """SQL for the best concept of a level for each pattern of region, debt and, with ``seg``, segment."""
    parts = ["debt", "region", *(["segment"] if seg else [])]
    column = {"debt": "debt", "region": "reg", "segment": "seg"}
    hit = " + ".join(f"2 * coalesce((SELECT n FROM c WHERE c.k = z.k AND attr = '{a}' AND val = p.{column[a]}), 0)" for a in parts)
    cols = ", ".join(f"p.{column[a]}" for a in parts)
    names = cols.replace("p.", "")
    return f"""(WITH c AS (SELECT {level} AS k, attr, val, count(*) AS n FROM sav GROUP BY ALL), z AS (SELECT {level} AS k, min(r) AS r, count(*) AS size FROM x GROUP BY 1),
s AS (SELECT z.k, sum(CAST(n AS DOUBLE) * n) + max(CAST(size AS DOUBLE) * size) AS s, 4 AS a FROM c JOIN z ON z.k = c.k GROUP BY z.k), p AS (SELECT DISTINCT {', '.join(f'{v} AS {v}' for v in [column[a] for a in parts])} FROM (SELECT seg, debt, r AS reg FROM x)),
g AS (SELECT {cols}, z.k, z.size, s.s, s.a, {len(parts) + 1} + 2 * z.size + {hit} AS g FROM p CROSS JOIN z JOIN s USING (k) {within})
SELECT {names}, k FROM (SELECT {names}, k, row_number() OVER (PARTITION BY {names} ORDER BY round((s + g) / ((size + 1) * a) - s / (size * a), 9) DESC, size DESC, k) AS rn FROM g) WHERE rn = 1)"""


SAV = "sav AS (SELECT inst, r, l, attr, val FROM av UNION ALL SELECT inst, r, l, 'region', r FROM x)"


def _placed(seg: bool) -> str:
    on = "one.debt = p.debt AND one.reg = p.reg" + (" AND one.seg = p.seg" if seg else "") + " AND one.k = z.r"
    return f"{BASE}, {SAV}, one AS (SELECT * FROM {_best('r', '', seg)}), two AS (SELECT * FROM {_best('l', f'JOIN one ON {on}', seg)})"


@query(f"WITH {_placed(True)} SELECT x.inst, two.k AS label FROM x JOIN two ON two.seg = x.seg AND two.debt = x.debt AND two.reg = x.r")
def structured_categorize(spark, sf_dir):
    """The nation that suits each customer's nested record best; records name their parts as they like."""
    tree = structured_tree(spark, sf_dir)
    placed = structured.categorize(records(spark, sf_dir), tree).join(tree.select("tree", "concept", "label"), ["tree", "concept"])
    return placed.select("inst", F.regexp_replace("label", "^/", "").alias("label"))


@query(f"""WITH {_placed(False)}, m AS (SELECT l, seg, row_number() OVER (PARTITION BY l ORDER BY count(*) DESC, seg) AS rn FROM x GROUP BY l, seg)
SELECT x.inst, unnest([{', '.join(f"'[\"{a}\",' || n || ']'" for a in ('segment', 'debt'))}, '["region","?q' || x.inst || '"]']) AS attr, unnest([m.seg, x.debt, x.r]) AS sval
FROM (SELECT *, '["?p' || inst || '","?q' || inst || '"]' AS n FROM x) x JOIN two ON two.debt = x.debt AND two.reg = x.r JOIN m ON m.l = two.k AND rn = 1""")
def structured_infer(spark, sf_dir):
    """Customers' records that lack the segment, completed in their own names by the nation that they are placed in."""
    tree = structured_tree(spark, sf_dir)
    return structured.infer_missing(records(spark, sf_dir, ("segment",)), tree).select("inst", "attr", "sval")


def part_rows(spark, sf_dir, part: str, maker: str) -> DataFrame:
    """Rows of parts and their makers under the given names; both have a kind."""
    kinds = {f'["kind","{part}"]': F.split_part("p_type", F.lit(" "), F.lit(1)), f'["kind","{maker}"]': F.col("p_brand"), f'["made-by","{part}","{maker}"]': F.lit("true")}
    return long_table(table(spark, sf_dir, "part"), "p_partkey", kinds)


@query("""WITH k1 AS (SELECT split_part(p_type, ' ', 1) AS v, CAST(count(*) AS DOUBLE) AS n FROM part GROUP BY 1), k2 AS (SELECT p_brand AS v, CAST(count(*) AS DOUBLE) AS n FROM part GROUP BY 1),
t AS (SELECT CAST(count(*) AS DOUBLE) AS z, (SELECT sum(n * n) FROM k1) + (SELECT sum(n * n) FROM k2) + CAST(count(*) AS DOUBLE) * count(*) AS s FROM part),
p AS (SELECT p_partkey AS inst, coalesce(a.n, 0) AS a1, coalesce(b.n, 0) AS b1, coalesce(c.n, 0) AS a2, coalesce(d.n, 0) AS b2 FROM (SELECT p_partkey, split_part(p_type, ' ', 1) AS x, p_brand AS y FROM part)
LEFT JOIN k1 a ON a.v = x LEFT JOIN k1 b ON b.v = y LEFT JOIN k2 c ON c.v = x LEFT JOIN k2 d ON d.v = y),
e AS (SELECT inst, unnest(['?o1', '?o1', '?o1', '?o2', '?o2', '?o2']) AS var, unnest(['?c1', '?c2', NULL, '?c1', '?c2', NULL]) AS base, unnest([2 * a1, 2 * a2, 0, 2 * b1, 2 * b2, 0]) AS more, unnest([1, 1, 0, 1, 1, 0]) AS known FROM p)
SELECT inst, var, base, round(-(s + 3 + more) / ((z + 1) * (z + 1) * (3 + 3 - known)), 8) AS cost FROM e, t""")
def mapping_costs(spark, sf_dir):
    """The cost of mapping each part's names, one at a time, to those of the concept of all parts."""
    base = structured.base_table(measures.counts(part_rows(spark, sf_dir, "?c1", "?c2"), []))
    size = table(spark, sf_dir, "part").count()
    return structured.mapping_costs(part_rows(spark, sf_dir, "?o1", "?o2"), base, size).withColumn("cost", F.round("cost", 8))


@query("SELECT p_partkey AS inst, unnest(['?o1', '?o2']) AS old, unnest(['?c2', '?c1']) AS new FROM part")
def structure_mapped(spark, sf_dir):
    """The whole mapping of each part's names to those of the concept of all parts, whose names are the other way round."""
    base = structured.base_table(measures.counts(part_rows(spark, sf_dir, "?c2", "?c1"), []))
    size = table(spark, sf_dir, "part").count()
    return structured.mapped(part_rows(spark, sf_dir, "?o1", "?o2"), base, size)[1]


def conversation_records(spark, sf_dir) -> DataFrame:
    """conv_id, record: each conversation as JSON, every turn within the one before, so depths differ."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.length("text").alias("size")))).alias("t"))  # a conversation's own turns
    piece = F.transform("t", lambda x: F.concat(F.lit('"?t'), x["turn"].cast("string"), F.lit('":{"role":"'), x["role"], F.lit('","size":'), x["size"].cast("string")))
    return turns.select("conv_id", F.concat(F.lit("{"), F.array_join(piece, ","), F.repeat(F.lit("}"), F.size("t") + 1)).alias("record"))


@query("""WITH p AS (SELECT a.conv_id, a.turn, a.role, length(a.text) AS size, string_agg(CASE WHEN b.turn = f THEN '"?t' || b.turn || '"' ELSE '["?t' || b.turn || '",' END, '' ORDER BY b.turn DESC) || repeat(']', count(*) - 1) AS path
FROM conversations a JOIN (SELECT *, min(turn) OVER (PARTITION BY conv_id) AS f FROM conversations) b ON b.conv_id = a.conv_id AND b.turn <= a.turn GROUP BY ALL)
SELECT conv_id, '["' || unnest(['role', 'size']) || '",' || path || ']' AS attr, unnest([role, NULL]) AS sval, unnest([NULL, CAST(size AS DOUBLE)]) AS nval FROM p""")
def flatten_any(spark, sf_dir):
    """Conversations as records of differing depth, flattened."""
    return shapes.flatten_records(conversation_records(spark, sf_dir), "conv_id", "record")


@query("SELECT event_id, k AS attr, CAST(json_extract_string(props, '$.' || k) AS DOUBLE) AS nval FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)")
def flatten_variant(spark, sf_dir):
    """Properties of events, whatever they are, from VARIANT values."""
    e = table(spark, sf_dir, "events").select("event_id", F.parse_json("props").alias("props"))
    return shapes.flatten_records(e, "event_id", "props").select("event_id", "attr", "nval")


@query("""WITH o AS (SELECT o_orderkey, left(o_orderpriority, 1) AS p FROM orders)
SELECT o_orderkey, '["note","of"]' AS attr, 'none' AS fault FROM o WHERE p = '1' UNION ALL SELECT o_orderkey, '["all","of"]', 'value' FROM o WHERE p = '2' UNION ALL SELECT o_orderkey, '["on","?a",["b",3]]', 'part' FROM o WHERE p = '3'
UNION ALL SELECT o_orderkey, NULL, 'record' FROM o WHERE p = '4'""")
def record_faults(spark, sf_dir):
    """Illegal fields of orders' records: a null, a list, a relation with a number, and what isn't a record."""
    kind = F.substr("o_orderpriority", F.lit(1), F.lit(1))
    text = F.when(kind == "1", '{"of":{"note":null,"x":1}}').when(kind == "2", '{"of":{"all":[1]}}').when(kind == "3", '{"[\\"on\\",\\"?a\\",[\\"b\\",3]]":true,"[\\"r\\",[\\"b\\",\\"?c\\"]]":true}').when(kind == "4", "[]").otherwise('{"a":{"b":{"c":"d"}}}')
    return shapes.faults(table(spark, sf_dir, "orders").select("o_orderkey", text.alias("record")), "o_orderkey", "record")


@query("""SELECT c_custkey AS inst, '["segment",["?c' || c_custkey || '",["?n' || n_nationkey || '","?r' || n_regionkey || '"]]]' AS attr, c_mktsegment AS sval FROM customer JOIN nation ON n_nationkey = c_nationkey
UNION ALL SELECT c_custkey, '["name",["?n' || n_nationkey || '","?r' || n_regionkey || '"]]', n_name FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def embedded_levels(spark, sf_dir):
    """Customers within nations within regions, hoisted to components of their own and embedded again."""
    names = [F.concat(F.lit(p), F.col(c).cast("string")) for p, c in (("?c", "c_custkey"), ("?n", "n_nationkey"), ("?r", "n_regionkey"))]
    outer = F.concat(F.lit('["'), names[1], F.lit('","'), names[2], F.lit('"]'))
    deep = F.concat(F.lit('["segment",["'), names[0], F.lit('",'), outer, F.lit("]]"))
    cells = F.array(F.struct(deep.alias("attr"), F.col("c_mktsegment").alias("sval")), F.struct(F.concat(F.lit('["name",'), outer, F.lit("]")).alias("attr"), F.col("n_name").alias("sval")))
    rows = customers(spark, sf_dir).select(F.col("c_custkey").alias("inst"), F.explode(cells).alias("c")).select("inst", "c.*").withColumn("nval", F.lit(None).cast("double"))
    return transforms.embedded(transforms.subcomponents(rows, "inst"), "inst").select("inst", "attr", "sval")


def pointers(spark, sf_dir) -> DataFrame:
    """concept, parent: customers under nations under regions, by pointers alone."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    name = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    rows = r.select(name("r", "r_regionkey").alias("concept"), F.lit("world").alias("parent"))
    rows = rows.unionByName(n.select(name("n", "n_nationkey"), name("r", "n_regionkey")).toDF("concept", "parent")).unionByName(c.select(name("c", "c_custkey"), name("n", "c_nationkey")).toDF("concept", "parent"))
    return rows.unionByName(spark.createDataFrame([("world", None)], "concept string, parent string"))


POINTERS = """t AS (SELECT 'world' AS concept, CAST(NULL AS VARCHAR) AS parent UNION ALL SELECT 'r' || r_regionkey, 'world' FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer),
up AS (SELECT concept, concept AS a, parent AS p, 0 AS d FROM t UNION ALL SELECT up.concept, t.concept, t.parent, d + 1 FROM up JOIN t ON t.concept = up.p)"""


@query(f"WITH RECURSIVE {POINTERS} SELECT a.concept, max(a.d) AS depth, any_value(s.size) AS size FROM up a JOIN (SELECT a AS concept, count(*) AS size FROM up GROUP BY 1) s ON s.concept = a.concept GROUP BY a.concept")
def pointer_sizes(spark, sf_dir):
    """Depth and number of concepts below, for each concept of a tree held by pointers to parents."""
    return chains.tour(pointers(spark, sf_dir)).select("concept", "depth", "size")


@query(f"WITH RECURSIVE {POINTERS} SELECT 'r' || r_regionkey AS \"upper\", 'c' || c_custkey AS \"lower\", EXISTS (SELECT 1 FROM up WHERE up.concept = 'c' || c_custkey AND up.a = 'r' || r_regionkey) AS below FROM customer JOIN region ON r_regionkey = c_custkey % 5")
def pointer_ancestors(spark, sf_dir):
    """Whether a customer lies below a region, one for each customer."""
    c, r = table(spark, sf_dir, "customer"), table(spark, sf_dir, "region")
    pairs = c.join(r, F.col("r_regionkey") == F.col("c_custkey") % 5).select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("upper"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("lower"))
    return chains.lies_below(pairs, chains.tour(pointers(spark, sf_dir)))


@query("SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position, md5(conv_id || '-' || turn) AS element FROM conversations")
def lists_ranked(spark, sf_dir):
    """Conversations' turns, known only by relations between two, in order again."""
    e = table(spark, sf_dir, "conversations").withColumn("e", F.md5(F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))))
    after = F.lead("e").over(Window.partitionBy("conv_id").orderBy("turn"))
    has, pair = (F.struct(F.lit(r).alias("relation"), F.col("e").alias("a"), b.alias("b")) for r, b in (("has-element", F.lit(None).cast("string")), ("ordered-list", F.col("n"))))
    rows = e.withColumn("n", after).select("conv_id", F.explode(F.array(has, pair)).alias("r")).select("conv_id", "r.*").filter("relation = 'has-element' OR b IS NOT NULL")
    return chains.list_places(rows.orderBy(F.xxhash64("a", "relation")), ["conv_id"])


def named_attributes(spark, sf_dir) -> DataFrame:
    """inst, attr: the names that customers' records have, flat, nested, hidden and hoisted to components of their own."""
    flat = records(spark, sf_dir).select("inst", "attr", "sval", "nval")
    key = F.col("c_custkey").cast("string")
    own = F.explode(F.array(F.lit("_note"), F.lit("phone"), F.concat(F.lit("?q"), key), F.to_json(F.array(F.lit("buys-from"), F.lit("us"))), F.concat(F.lit('["_",["_tel","?p'), key, F.lit('"]]')))).alias("attr")
    more = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("inst"), own)
    return transforms.subcomponents(flat, "inst").select("inst", "attr").unionByName(more)


NAMED = """n AS (SELECT c_custkey AS inst, unnest(['["segment","?p' || c_custkey || '"]', '["debt","?p' || c_custkey || '"]', '["region","?q' || c_custkey || '"]', '["has-component","?q' || c_custkey || '","?p' || c_custkey || '"]', '_note', 'phone', '?q' || c_custkey, '["buys-from","us"]', '["_",["_tel","?p' || c_custkey || '"]]']) AS attr,
unnest(['component-relation', 'component-relation', 'component-relation', 'component-relation', 'hidden', 'constant', 'variable', 'constant-relation', 'hidden-relation']) AS kind FROM customer)"""


@query(f"WITH {NAMED} SELECT inst, attr, kind FROM n")
def attribute_types(spark, sf_dir):
    """What the names of customers' attributes say about them."""
    return named_attributes(spark, sf_dir).select("inst", "attr", trees.attribute_type(F.col("attr")).alias("kind"))


@query(f"WITH {NAMED} SELECT inst, attr, CASE kind WHEN 'component-relation' THEN 'relation,component' WHEN 'constant-relation' THEN 'relation' WHEN 'hidden' THEN 'hidden' WHEN 'hidden-relation' THEN 'hidden,relation' ELSE '' END AS tags FROM n")
def attribute_filters(spark, sf_dir):
    """The tags by which a viewer filters customers' attributes."""
    return named_attributes(spark, sf_dir).select("inst", "attr", F.array_join(trees.attribute_tags(F.col("attr")), ",").alias("tags"))
