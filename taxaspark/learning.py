"""Registered queries that learn: fitted trees and what is read off them. Their results depend on order, so SQL has none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxaspark import fixed, incremental, smoothing, structured  # noqa: F401  register their queries
from taxaspark.functions.choice import sampled
from taxaspark.operators import descent, fold, mapping
from taxaspark.plans import transforms, trees
from taxaspark.queries import QUERIES, part_weights, query, table
from taxaspark.sources import files
from taxaspark.storage import shared_path, stored
from taxaspark.streaming.learn import learn

NO_NUMBER = "map<string,double>"


def order_instances(spark, sf_dir) -> DataFrame:
    """Orders as instances, a tree for each priority."""
    o = table(spark, sf_dir, "orders")
    nominal = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("year"), F.year("o_orderdate").cast("string"), F.lit("quarter"), F.quarter("o_orderdate").cast("string"))
    return o.select(F.col("o_orderpriority").alias("tree"), F.col("o_orderkey").alias("order"), F.col("o_orderkey").alias("inst"), nominal.alias("nominal"), F.create_map().cast(NO_NUMBER).alias("numeric"))


def event_instances(spark, sf_dir) -> DataFrame:
    """Events as instances with a number, a tree for each hour."""
    return as_events(table(spark, sf_dir, "events"))


def as_events(e: DataFrame) -> DataFrame:
    nominal = F.create_map(F.lit("type"), F.col("event_type"), F.lit("user"), F.col("user_id").cast("string"))
    return e.select(F.hour("ts").cast("string").alias("tree"), F.col("event_id").alias("order"), F.col("event_id").alias("inst"), nominal.alias("nominal"), F.create_map(F.lit("value"), F.col("value")).alias("numeric"))


@query()
def fit_tree_nominal(spark, sf_dir):
    """Trees of orders, one for each priority."""
    return fold.fit(order_instances(spark, sf_dir))


@query()
def fit_tree_mixed(spark, sf_dir):
    """Trees of events with a numeric attribute, one for each hour."""
    return fold.fit(event_instances(spark, sf_dir))


@query()
def categorize_tree(spark, sf_dir):
    """The leaf of each order in its fitted tree."""
    return descent.categorize(order_instances(spark, sf_dir), stored(fit_tree_nominal(spark, sf_dir), "tree"))


@query()
def infer_missing_tree(spark, sf_dir):
    """A status for each order from its other attributes, by its tree."""
    tree = stored(fit_tree_nominal(spark, sf_dir), "tree")
    without = order_instances(spark, sf_dir).withColumn("nominal", F.map_filter("nominal", lambda k, _: k != "status"))
    return descent.predicted(descent.categorize(without, tree), tree, "status")


@query()
def cluster_cuts(spark, sf_dir):
    """Clusters of the leaves under the first five cuts."""
    tree = stored(fit_tree_nominal(spark, sf_dir), "tree")
    return descent.cuts(tree, stored(descent.openings(tree, 5), "openings"))


@query()
def k_cluster(spark, sf_dir):
    """The largest cuts of at most twelve clusters."""
    return descent.largest_cut(stored(fit_tree_nominal(spark, sf_dir), "tree"), 12)


@query()
def split_search(spark, sf_dir):
    """The cut of the greatest utility among the first ten."""
    best = descent.openings(stored(fit_tree_nominal(spark, sf_dir), "tree"), 10)
    return best.groupBy("tree").agg(F.max_by("opened", F.struct("cu", -F.col("opened"))).alias("split"), F.max("cu").alias("cu"))


@query()
def prequential_tree(spark, sf_dir):
    """Probability of each event's type before it is learned, by its hour's tree."""
    return fold.prequential(event_instances(spark, sf_dir), "type")


@query()
def structure_map(spark, sf_dir):
    """Which of a customer's parts plays which part of a base concept."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    nominal = F.create_map(F.lit('["region","?x"]'), F.col("n_regionkey").cast("string"), F.lit('["segment","?y"]'), F.col("c_mktsegment"), F.lit('["holds","?x","?y"]'), F.lit("true"))
    base = fold.Concept(1)
    fold.Tree().add(base, {'["region","?a"]': "1", '["segment","?b"]': "BUILDING", '["holds","?a","?b"]': "true"})
    instances = c.select(F.col("c_custkey").alias("inst"), nominal.alias("nominal"), F.create_map().cast(NO_NUMBER).alias("numeric"))
    return mapping.mappings(instances, base)


@query()
def fit_tree_structured(spark, sf_dir):
    """A tree of customers with components, whose variables are mapped to the root's, for each nation."""
    c = table(spark, sf_dir, "customer")
    name = lambda x: F.concat(F.lit(f'","?{x}'), F.col("c_custkey").cast("string"), F.lit('"]'))
    nominal = F.create_map(F.concat(F.lit('["segment'), name("s")), F.col("c_mktsegment"), F.concat(F.lit('["debt'), name("b")), (F.col("c_acctbal") < 0).cast("string"))
    rows = c.select(F.col("c_nationkey").cast("string").alias("tree"), F.col("c_custkey").alias("order"), nominal.alias("nominal"), F.create_map().cast(NO_NUMBER).alias("numeric"))
    return fold.fit(rows, structured=True)


@query()
def tree_json(spark, sf_dir):
    """Concepts of fitted trees as JSON, one a row."""
    return descent.node_json(fit_tree_nominal(spark, sf_dir))


@query()
def tree_trim(spark, sf_dir):
    """Fitted trees without their leaves."""
    named = stored(fit_tree_nominal(spark, sf_dir), "tree").withColumn("path", F.transform("path", lambda x: F.concat_ws("/", "tree", x.cast("string"))))
    named = named.withColumn("concept", F.concat_ws("/", "tree", F.col("concept").cast("string"))).withColumn("parent", F.when(F.col("parent").isNotNull(), F.concat_ws("/", "tree", F.col("parent").cast("string"))))
    return trees.without_leaves(named.select("concept", "parent", "depth", "path", "n"), 1)


@query()
def sampled_values(spark, sf_dir):
    """A value of each concept, drawn in proportion to its probability by a seed."""
    return sampled(part_weights(spark, sf_dir), ["k"], 7)


@query()
def animals(spark, sf_dir):
    """Generated animals as flat attributes."""
    a = files.animals(spark, 500).select("id", F.struct("_type", "torso", "leg1", "leg2", "leg3", "leg4", "neck", "head", "tail").alias("instance"))
    return transforms.flatten(a, "id", "instance")


@query()
def stream_fit(spark, sf_dir):
    """Events learned as a stream: score before learning, and leaf, of each arrival."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = as_events(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)).select("tree", "order", "nominal", "numeric")
    out, at = shared_path(spark, "learned"), shared_path(spark, "stream")
    learn(stream, "type").writeStream.format("parquet").option("path", out).option("checkpointLocation", at).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("tree string, order long, score double, leaf long").parquet(out)


__all__ = ["QUERIES"]
