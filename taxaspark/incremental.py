"""Registered queries of relations matched against relations, of names rewritten, and of tables kept up to date from streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxaspark.plans import transforms, unify
from taxaspark.queries import ORDERS_AV, orders_av, query, table
from taxaspark.storage import shared_path
from taxaspark.streaming.tables import keep_tables, kept_counts, kept_moments


def _relations(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """inst, attr: of each row two relations of a place, whose two variables are one where the key is even."""
    place = F.concat(F.lit("n"), F.pmod(F.col(key), F.lit(25)).cast("string"))
    second = F.when(F.col(key) % 2 == 0, a).otherwise(b)
    return df.select(F.col(key).cast("long").alias("inst"), F.explode(F.array(F.to_json(F.array(F.lit("near"), F.lit(a), second, place)), F.to_json(F.array(F.lit("in"), F.lit(a), place)))).alias("attr"))


_MATCHED = """p AS (SELECT p_partkey AS i, 'n' || p_partkey % 25 AS x, CASE WHEN p_partkey % 2 = 0 THEN '?a' ELSE '?b' END AS b FROM part), s AS (SELECT s_suppkey AS c, 'n' || s_suppkey % 25 AS x, CASE WHEN s_suppkey % 2 = 0 THEN '?x' ELSE '?y' END AS y FROM supplier),
m AS (SELECT i AS inst, '["near","?a","' || b || '","' || x || '"]' AS attr, c AS concept, '["near","?x","' || y || '","' || x || '"]' AS base_attr, (b = '?a') = (y = '?x') AS consistent, y = '?x' AS bound FROM p JOIN s USING (x)
UNION ALL SELECT i, '["in","?a","' || x || '"]', c, '["in","?x","' || x || '"]', true, true FROM p JOIN s USING (x))"""


@query(f"WITH {_MATCHED} SELECT inst, attr, concept, base_attr, consistent FROM m")
def partial_matches(spark, sf_dir):
    """Relations of parts that match relations of suppliers, and whether their variables are bound alike."""
    base = _relations(table(spark, sf_dir, "supplier"), "s_suppkey", "?x", "?y").withColumnRenamed("inst", "concept")
    return unify.partial_matches(_relations(table(spark, sf_dir, "part"), "p_partkey", "?a", "?b"), base)


@query(f"WITH {_MATCHED} SELECT inst, attr, concept, base_attr, consistent FROM m WHERE NOT (base_attr LIKE '[\"near\"%' AND ((attr LIKE '[\"near\",\"?a\",\"?a\"%' AND NOT bound) OR (attr NOT LIKE '[\"near\",\"?a\",\"?a\"%' AND bound)))")
def partial_matches_bound(spark, sf_dir):
    """The same where ?a is bound to ?x, and ?b to ?y, already."""
    target = _relations(table(spark, sf_dir, "part"), "p_partkey", "?a", "?b")
    base = _relations(table(spark, sf_dir, "supplier"), "s_suppkey", "?x", "?y").withColumnRenamed("inst", "concept")
    bound = target.select("inst").distinct().select("inst", F.explode(F.array(F.struct(F.lit("?a").alias("old"), F.lit("?x").alias("new")), F.struct(F.lit("?b").alias("old"), F.lit("?y").alias("new")))).alias("b")).select("inst", "b.*")
    return unify.partial_matches(target, base, bound)


@query("SELECT p_partkey, '[\"made-by\",\"?' || p_brand || '\",[\"in\",\"' || p_type[1] || '\",' || p_size || '.0]]' AS tuple, '(made-by ?' || p_brand || ' (in ' || p_type[1] || ' ' || p_size || '.0))' AS text FROM part")
def tuplized(spark, sf_dir):
    """Relations written as text, as tuples, and as text again."""
    text = F.concat(F.lit("(made-by ?"), F.col("p_brand"), F.lit(" (in "), F.substr("p_type", F.lit(1), F.lit(1)), F.lit(" "), F.col("p_size").cast("string"), F.lit("))"))
    rows = table(spark, sf_dir, "part").select("p_partkey", transforms.tuplized(text).alias("tuple"))
    return rows.withColumn("text", transforms.stringified(F.col("tuple")))


@query("""SELECT c_custkey AS inst, unnest(['["a","?o1"]', '["b","?o2"]', '["of","?o2","?o1"]', 'plain']) AS attr, unnest(['["a","?z' || c_custkey || '"]', '["b","?y' || c_custkey || '"]', '["of","?y' || c_custkey || '","?z' || c_custkey || '"]', 'plain']) AS own FROM customer""")
def standardized(spark, sf_dir):
    """Customers' names standardized apart, and restored."""
    key = F.col("c_custkey").cast("string")
    z, y = (F.concat(F.lit(p), key) for p in ("?z", "?y"))
    names = F.array(F.to_json(F.array(F.lit("a"), z)), F.to_json(F.array(F.lit("b"), y)), F.to_json(F.array(F.lit("of"), y, z)), F.lit("plain"))
    rows, mapping = transforms.standardized(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("inst"), F.explode(names).alias("attr")), "inst")
    return transforms.restored(rows.withColumn("standard", F.col("attr")), mapping, "inst").select("inst", F.col("standard").alias("attr"), F.col("attr").alias("own"))


@query("""SELECT p_partkey, '["' || p_brand || '","' || p_type || '"]' AS l, '{"brand":"' || p_brand || '","type":"' || p_type || '"}' AS m, p_size AS n FROM part""")
def sanitized(spark, sf_dir):
    """Lists and maps of parts as text, maps in the order of their keys."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.array("p_brand", "p_type").alias("l"), F.create_map(F.lit("type"), F.col("p_type"), F.lit("brand"), F.col("p_brand")).alias("m"), F.col("p_size").alias("n"))
    return transforms.sanitized(rows)


def _streamed(spark, sf_dir) -> str:
    """The path of the tables that a stream of orders, a file a batch, has been kept in."""
    files, path = shared_path(spark, "arriving"), shared_path(spark, "kept")
    rows = orders_av(spark, sf_dir)
    rows.repartition(4).write.parquet(files)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(files)
    keep_tables(stream, ["k"], path).awaitTermination()
    return path


@query(f"WITH {ORDERS_AV} SELECT k AS concept, attr, val, count(*) AS n FROM av GROUP BY ALL")
def stream_counts(spark, sf_dir):
    """Counts of each value in each concept, kept from a stream."""
    return kept_counts(spark, ["k"], _streamed(spark, sf_dir)).withColumnRenamed("k", "concept")


@query("SELECT o_orderpriority AS concept, 'price' AS attr, count(*) AS num, round(avg(o_totalprice), 4) AS mean, round(sqrt(var_pop(o_totalprice)), 4) AS std FROM orders GROUP BY 1")
def stream_moments(spark, sf_dir):
    """Moments of each number in each concept, kept from a stream."""
    rows = kept_moments(spark, ["k"], _streamed(spark, sf_dir))
    return rows.select(F.col("k").alias("concept"), "attr", "num", F.round("mean", 4).alias("mean"), F.round(F.sqrt(F.col("m2") / F.col("num")), 4).alias("std"))
