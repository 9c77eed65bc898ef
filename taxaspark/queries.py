"""The registered queries over the star-schema, event and text tables, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taxaspark.functions import moments as M
from taxaspark.functions.choice import most_likely
from taxaspark.plans import clusters, evaluate, measures, transforms, trees
from taxaspark.schema import long_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_av(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("k", F.col("o_orderpriority"))
    return long_table(o, "o_orderkey", {"status": F.col("o_orderstatus"), "year": F.year("o_orderdate").cast("string")}, {"price": F.col("o_totalprice")}, ["k"])


def lineitem_av(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("k", F.col("l_returnflag")).withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return long_table(li, "id", {"status": F.col("l_linestatus"), "year": F.year("l_shipdate").cast("string"), "discount": F.round(F.col("l_discount") * 100).cast("int").cast("string")}, None, ["k", "l_linestatus"])


def events_av(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("k", F.col("event_type"))
    return long_table(e, "event_id", {"hour": F.hour("ts").cast("string")}, {"value": F.col("value")}, ["k", "user_id"])


def one(av: DataFrame, attr: str = "status") -> DataFrame:
    """One row for each instance, by an attribute that none lacks."""
    return av.filter(F.col("attr") == attr)


ORDERS_AV = """av AS (SELECT o_orderkey AS inst, o_orderpriority AS k, 'status' AS attr, o_orderstatus AS val FROM orders
UNION ALL SELECT o_orderkey, o_orderpriority, 'year', CAST(EXTRACT(year FROM o_orderdate) AS VARCHAR) FROM orders)"""
LINES_AV = """li AS (SELECT l_orderkey * 10 + l_linenumber AS inst, l_returnflag AS k, l_linestatus AS ls, l_linestatus AS a, CAST(EXTRACT(year FROM l_shipdate) AS VARCHAR) AS b, CAST(CAST(ROUND(l_discount * 100) AS INTEGER) AS VARCHAR) AS c FROM lineitem),
av AS (SELECT inst, k, ls, 'status' AS attr, a AS val FROM li UNION ALL SELECT inst, k, ls, 'year', b FROM li UNION ALL SELECT inst, k, ls, 'discount', c FROM li)"""
C4 = "CASE WHEN {n} BETWEEN 2 AND 29 THEN sqrt(2.0 / ({n} - 1)) * exp(lgamma({n} / 2.0) - lgamma(({n} - 1) / 2.0)) ELSE 1.0 END"


def std_sql(n: str, m2: str) -> str:
    return f"(CASE WHEN {n} < 2 THEN 0.0 ELSE sqrt({m2} / nullif({n} - 1, 0)) / ({C4.format(n=n)}) END)"


G = "(1 / (2 * sqrt(pi()) * sqrt(({s}) * ({s}) + 1 / (4 * pi()))))"


@query(f"WITH {ORDERS_AV} SELECT k AS concept, attr, val, count(*) AS n FROM av GROUP BY ALL")
def av_counts(spark, sf_dir):
    """Counts of each value in each concept."""
    return measures.counts(orders_av(spark, sf_dir), ["k"]).select(F.col("k").alias("concept"), "attr", "val", "n")


@query(f"""WITH {LINES_AV} SELECT '' AS path, attr, val, count(*) AS n FROM av GROUP BY attr, val
UNION ALL SELECT k, attr, val, count(*) FROM av GROUP BY k, attr, val UNION ALL SELECT k || '/' || ls, attr, val, count(*) FROM av GROUP BY k, ls, attr, val""")
def av_counts_rollup(spark, sf_dir):
    """Counts at each level of a two-level tree: a parent's are the sums of its children's."""
    leaf = measures.counts(lineitem_av(spark, sf_dir), ["k", "l_linestatus"])
    paths = F.explode(F.array(F.lit(""), F.col("k"), F.concat("k", F.lit("/"), "l_linestatus"))).alias("path")
    return leaf.select(paths, "attr", "val", "n").groupBy("path", "attr", "val").agg(F.sum("n").alias("n"))


ECG_LINES = f"""{LINES_AV}, z AS (SELECT k, count(*) AS size FROM li GROUP BY k), c AS (SELECT k, attr, val, count(*) AS n FROM av GROUP BY ALL),
e AS (SELECT c.k, size, sum(CAST(n AS DOUBLE) * n) / (CAST(size AS DOUBLE) * size * count(DISTINCT attr)) AS ecg FROM c JOIN z USING (k) GROUP BY c.k, size),
p AS (SELECT sum(n * n) / (max(t) * max(t) * count(DISTINCT attr)) AS ecg FROM (SELECT attr, val, CAST(sum(n) AS DOUBLE) AS n FROM c GROUP BY ALL), (SELECT CAST(sum(size) AS DOUBLE) AS t FROM z))"""


@query(f"WITH {ECG_LINES} SELECT k AS concept, size, round(ecg, 6) AS ecg FROM e")
def ecg_nominal(spark, sf_dir):
    """Expected correct guesses of nominal concepts."""
    av = lineitem_av(spark, sf_dir)
    return measures.guesses(measures.counts(av, ["k"]), measures.sizes(one(av), ["k"]), ["k"]).select(F.col("k").alias("concept"), "size", F.round("ecg", 6).alias("ecg"))


ECG_ORDERS = f"""{ORDERS_AV}, z AS (SELECT o_orderpriority AS k, count(*) AS size, avg(o_totalprice) AS mean, var_pop(o_totalprice) * count(*) AS m2 FROM orders GROUP BY 1),
sc AS (SELECT {std_sql('count(*)', '(var_pop(o_totalprice) * count(*))')} / 0.5 AS scale FROM orders),
c AS (SELECT k, attr, val, count(*) AS n FROM av GROUP BY ALL), s AS (SELECT k, sum(CAST(n AS DOUBLE) * n) AS s FROM c GROUP BY k)"""


@query(f"WITH {ECG_ORDERS} SELECT z.k AS concept, size, round((s + CAST(size AS DOUBLE) * size * {G.format(s=std_sql('size', 'm2') + ' / scale')}) / (CAST(size AS DOUBLE) * size * 3), 6) AS ecg FROM z JOIN s USING (k), sc")
def ecg_mixed(spark, sf_dir):
    """Expected correct guesses with a scaled numeric attribute."""
    av = orders_av(spark, sf_dir)
    ecg = measures.guesses(measures.counts(av, ["k"]), measures.sizes(one(av), ["k"]), ["k"], measures.numbers(av, ["k"]), measures.scales(av))
    return ecg.select(F.col("k").alias("concept"), "size", F.round("ecg", 6).alias("ecg"))


@query(f"WITH {ECG_LINES} SELECT count(*) AS children, round(1e6 * (sum(CAST(size AS DOUBLE) / t * e.ecg) - max(p.ecg)) / count(*), 4) AS cu_millionths FROM e, p, (SELECT sum(size) AS t FROM z)")
def category_utility(spark, sf_dir):
    """Category utility of a partition into three concepts."""
    av = lineitem_av(spark, sf_dir)
    return measures.utility(measures.counts(av, ["k"]), measures.sizes(one(av), ["k"]), [], "k").select("children", F.round(F.col("cu") * 1e6, 4).alias("cu_millionths"))


@query(f"""WITH ev AS (SELECT event_type AS k, CAST(EXTRACT(hour FROM ts) AS VARCHAR) AS h, value AS v FROM events),
c AS (SELECT k, h, count(*) AS n FROM ev GROUP BY ALL), z AS (SELECT k, count(*) AS size, avg(v) AS mean, var_pop(v) * count(*) AS m2 FROM ev GROUP BY k),
t AS (SELECT count(*) AS size, var_pop(v) * count(*) AS m2 FROM ev), sc AS (SELECT {std_sql('size', 'm2')} / 0.5 AS scale FROM t),
e AS (SELECT z.k, size, ((SELECT sum(CAST(n AS DOUBLE) * n) FROM c WHERE c.k = z.k) / (CAST(size AS DOUBLE) * size) + {G.format(s=std_sql('size', 'm2') + ' / scale')}) / 2 AS ecg FROM z, sc),
p AS (SELECT ((SELECT sum(CAST(n AS DOUBLE) * n) FROM (SELECT h, sum(n) AS n FROM c GROUP BY h)) / (CAST(size AS DOUBLE) * size) + {G.format(s=std_sql('size', 'm2') + ' / scale')}) / 2 AS ecg, size FROM t, sc)
SELECT count(*) AS children, round(1e6 * (sum(CAST(e.size AS DOUBLE) / p.size * e.ecg) - max(p.ecg)) / count(*), 3) AS cu_millionths FROM e, p""")
def category_utility_mixed(spark, sf_dir):
    """Category utility with a nominal and a numeric attribute."""
    av = events_av(spark, sf_dir)
    cu = measures.utility(measures.counts(av, ["k"]), measures.sizes(one(av, "hour"), ["k"]), [], "k", measures.numbers(av, ["k"]), measures.scales(av))
    return cu.select("children", F.round(F.col("cu") * 1e6, 3).alias("cu_millionths"))


PROBE = {"status": "O", "year": "1996", "discount": "5"}
BEST, SECOND = "N", "R"


def operations(spark, sf_dir) -> DataFrame:
    """op, cu of placing a probe among the return flags in each way."""
    av = lineitem_av(spark, sf_dir)
    sub = av.filter(F.col("k") == BEST).withColumn("k", F.concat("k", F.lit("/"), "l_linestatus"))
    c, z = measures.variants(measures.counts(av, ["k"]), measures.sizes(one(av), ["k"]), measures.counts(sub, ["k"]), measures.sizes(one(sub), ["k"]), PROBE, BEST, SECOND)
    return measures.utility(c, z, ["op"], "k").select("op", F.round(F.col("cu") * 1e6, 3).alias("cu_millionths"))


def op_sql(op: str) -> str:
    """SQL for one way of placing the probe."""
    x = ", ".join(f"('{a}', '{v}')" for a, v in PROBE.items())
    at = {"best": f"'{BEST}'", "new": "'<new>'", "merge": "'<merged>'"}.get(op)
    name = f"CASE WHEN k IN ('{BEST}', '{SECOND}') THEN '<merged>' ELSE k END" if op == "merge" else (f"CASE WHEN k = '{BEST}' THEN k || '/' || ls ELSE k END" if op == "split" else "k")
    more = f" UNION ALL SELECT {at} AS k, a AS attr, v AS val, 1 AS n FROM (VALUES {x}) AS q(a, v)" if at else ""
    one = f" UNION ALL SELECT {at} AS k, 1 AS size" if at else ""
    return f"""(WITH {LINES_AV}, c AS (SELECT k, attr, val, sum(n) AS n FROM (SELECT {name} AS k, attr, val, 1 AS n FROM av{more}) GROUP BY ALL),
z AS (SELECT k, sum(size) AS size FROM (SELECT {name} AS k, 1 AS size FROM li{one}) GROUP BY k),
e AS (SELECT c.k, max(size) AS size, sum(CAST(n AS DOUBLE) * n) / (CAST(max(size) AS DOUBLE) * max(size) * count(DISTINCT attr)) AS ecg FROM c JOIN z USING (k) GROUP BY c.k),
p AS (SELECT sum(n * n) / (max(t) * max(t) * count(DISTINCT attr)) AS ecg FROM (SELECT attr, val, CAST(sum(n) AS DOUBLE) AS n FROM c GROUP BY ALL), (SELECT CAST(sum(size) AS DOUBLE) AS t FROM z))
SELECT '{op}' AS op, round(1e6 * (sum(CAST(size AS DOUBLE) / t * e.ecg) - max(p.ecg)) / count(*), 3) AS cu_millionths FROM e, p, (SELECT sum(size) AS t FROM z))"""


@query(f"SELECT * FROM {op_sql('best')}")
def cu_best(spark, sf_dir):
    """Utility if the probe goes into the best child."""
    return operations(spark, sf_dir).filter("op = 'best'")


@query(f"SELECT * FROM {op_sql('new')}")
def cu_new(spark, sf_dir):
    """Utility if the probe becomes a child of its own."""
    return operations(spark, sf_dir).filter("op = 'new'")


@query(f"SELECT * FROM {op_sql('merge')}")
def cu_merge(spark, sf_dir):
    """Utility if the two best children are fused around the probe."""
    return operations(spark, sf_dir).filter("op = 'merge'")


@query(f"SELECT * FROM {op_sql('split')}")
def cu_split(spark, sf_dir):
    """Utility if the best child gives way to its children."""
    return operations(spark, sf_dir).filter("op = 'split'")


@query("SELECT op, cu_millionths FROM (" + " UNION ALL ".join(f"SELECT * FROM {op_sql(o)}" for o in ("best", "new", "merge", "split")) + ") ORDER BY cu_millionths DESC, op LIMIT 1")
def best_operation(spark, sf_dir):
    """The way of placing the probe with the greatest utility."""
    return operations(spark, sf_dir).orderBy(F.col("cu_millionths").desc(), "op").limit(1)


REL = f"""{ORDERS_AV}, z AS (SELECT k, count(*) / 2 AS size FROM av GROUP BY k), c AS (SELECT k, attr, val, count(*) AS n FROM av GROUP BY ALL),
s AS (SELECT k, sum(CAST(n AS DOUBLE) * n) AS s, count(DISTINCT attr) AS a FROM c GROUP BY k),
g AS (SELECT x.inst, s.k, sum(2 * coalesce(n, 0) + 1) AS g FROM av x CROSS JOIN s LEFT JOIN c ON c.k = s.k AND c.attr = x.attr AND c.val = x.val GROUP BY ALL),
rel AS (SELECT inst, k, size, (s + g) / ((size + 1) * a) - s / (size * a) AS rel FROM g JOIN s USING (k) JOIN z USING (k)),
best AS (SELECT inst, k, rel, row_number() OVER (PARTITION BY inst ORDER BY round(rel, 9) DESC, size DESC, k) AS rank FROM rel)"""


def _probes(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders as instances with a map of values; counts and sizes of the priorities."""
    av = orders_av(spark, sf_dir)
    nominal = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("year"), F.year("o_orderdate").cast("string"))
    probes = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("inst"), nominal.alias("nominal"))
    return probes, measures.counts(av, ["k"]), measures.sizes(one(av), ["k"])


@query(f"WITH {REL} SELECT inst, k AS concept, round(rel, 6) AS rel FROM rel")
def relative_cu(spark, sf_dir):
    """Change of each concept's weighted guesses if an order joined it."""
    return measures.relative_utility(*_probes(spark, sf_dir), "k").select("inst", F.col("k").alias("concept"), F.round("rel", 6).alias("rel"))


@query(f"WITH {REL} SELECT inst, rank, k AS concept, round(rel, 6) AS rel FROM best WHERE rank <= 2")
def two_best(spark, sf_dir):
    """The two concepts that suit each order best."""
    return measures.best_children(*_probes(spark, sf_dir), "k").select("inst", F.col("rank").cast("long").alias("rank"), F.col("k").alias("concept"), F.round("rel", 6).alias("rel"))


@query(f"WITH {REL} SELECT k AS concept, count(*) AS n FROM best WHERE rank = 1 GROUP BY k")
def categorize_flat(spark, sf_dir):
    """How many orders each concept would get."""
    return measures.best_children(*_probes(spark, sf_dir), "k", 1).groupBy(F.col("k").alias("concept")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {ORDERS_AV}, o AS (SELECT o_orderkey AS inst, o_orderstatus AS s, CAST(EXTRACT(year FROM o_orderdate) AS VARCHAR) AS y FROM orders),
g AS (SELECT s || '/' || y AS k, s, y FROM o GROUP BY ALL) SELECT k AS concept, count(*) FILTER (o.s = g.s AND o.y = g.y) AS exact, count(*) FILTER (NOT (o.s = g.s AND o.y = g.y)) AS other FROM o CROSS JOIN g GROUP BY k""")
def exact_match(spark, sf_dir):
    """How many orders match each status and year concept exactly."""
    av = orders_av(spark, sf_dir).filter("sval IS NOT NULL").drop("k")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("inst"), F.concat_ws("/", "o_orderstatus", F.year("o_orderdate").cast("string")).alias("k"))
    grouped = av.join(o, "inst")
    size = measures.sizes(one(grouped), ["k"])
    hits = measures.exact_match(av, measures.counts(grouped, ["k"]), size, "k").groupBy("k").agg(F.count(F.lit(1)).alias("exact"))
    whole = o.agg(F.count(F.lit(1)).alias("all"))
    exact = F.coalesce("exact", F.lit(0))
    return size.join(hits, "k", "left").join(whole, F.lit(True)).select(F.col("k").alias("concept"), exact.alias("exact"), (F.col("all") - exact).alias("other"))


@query(f"WITH {ORDERS_AV}, z AS (SELECT o_orderpriority AS k, count(*) AS size FROM orders GROUP BY 1) SELECT k AS concept, attr, val, round(CAST(count(*) AS DOUBLE) / max(size), 6) AS p FROM av JOIN z USING (k) GROUP BY k, attr, val")
def probability_nominal(spark, sf_dir):
    """Probability of each value in each concept."""
    av = orders_av(spark, sf_dir)
    return measures.probabilities(measures.counts(av, ["k"]), measures.sizes(one(av), ["k"]), ["k"]).select(F.col("k").alias("concept"), "attr", "val", F.round("p", 6).alias("p"))


@query(f"""WITH z AS (SELECT event_type AS k, count(*) AS n, avg(value) AS mean, var_pop(value) * count(*) AS m2 FROM events GROUP BY 1),
a AS (SELECT avg(value) AS m, count(*) AS n, var_pop(value) * count(*) AS m2 FROM events), sc AS (SELECT m, {std_sql('n', 'm2')} / 0.5 AS s FROM a)
SELECT event_id, round(exp(-(((value - mean) / s) ** 2) / (2 * (({std_sql('n', 'm2')} / s) ** 2 + 1 / (2 * pi())))) / sqrt(2 * pi() * (({std_sql('n', 'm2')} / s) ** 2 + 1 / (2 * pi()))), 6) AS p FROM events JOIN z ON k = event_type, sc""")
def probability_numeric(spark, sf_dir):
    """Density of each event's value within its type."""
    av = events_av(spark, sf_dir)
    m = measures.numbers(av, ["k"]).drop("attr")
    whole = av.filter("nval IS NOT NULL").agg(*M.moments()).select(F.col("mean").alias("shift"), (M.unbiased_std(F.col("num"), F.col("m2")) / 0.5).alias("scale"))
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("k"), "value")
    p = measures.density(F.col("value"), F.col("num"), F.col("mean"), F.col("m2"), F.col("num"), F.col("shift"), F.col("scale"))
    return e.join(m, "k").join(F.broadcast(whole), F.lit(True)).select("event_id", F.round(p, 6).alias("p"))  # one row


PART = """x AS (SELECT p_brand AS k, CASE WHEN p_retailprice >= 950 THEN p_type END AS val FROM part), z AS (SELECT k, CAST(count(*) AS DOUBLE) AS size FROM x GROUP BY k),
w AS (SELECT k, val, count(*) / max(size) AS p FROM x JOIN z USING (k) GROUP BY k, val)"""


def part_weights(spark, sf_dir) -> DataFrame:
    """Values of part types in each brand, missing for cheap parts."""
    p = table(spark, sf_dir, "part").withColumn("k", F.col("p_brand"))
    av = long_table(p, "p_partkey", {"type": F.when(F.col("p_retailprice") >= 950, F.col("p_type"))}, None, ["k"])
    return measures.probabilities(measures.counts(av, ["k"]), measures.sizes(p, ["k"]), ["k"], attrs=["type"])


@query(f"WITH {PART} SELECT k AS concept, val, round(p, 6) AS p FROM w")
def weighted_values(spark, sf_dir):
    """Distribution of a partly missing attribute, the missing part as null."""
    return part_weights(spark, sf_dir).select(F.col("k").alias("concept"), "val", F.round("p", 6).alias("p"))


@query(f"WITH {PART} SELECT concept, val FROM (SELECT k AS concept, val, row_number() OVER (PARTITION BY k ORDER BY p DESC, val ASC NULLS LAST) AS r FROM w) WHERE r = 1")
def predict_mode(spark, sf_dir):
    """Most likely value of each concept; it may be missing."""
    return most_likely(part_weights(spark, sf_dir), ["k"]).select(F.col("k").alias("concept"), "val")


@query("""WITH m AS (SELECT c_nationkey, c_mktsegment AS s, row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, c_mktsegment) AS r FROM customer WHERE c_acctbal >= 0 GROUP BY 1, 2)
SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_mktsegment ELSE s END AS segment FROM customer LEFT JOIN m ON m.c_nationkey = customer.c_nationkey AND r = 1""")
def infer_missing_flat(spark, sf_dir):
    """A segment for customers in debt, whose own counts as missing: the most likely one of their nation."""
    c = table(spark, sf_dir, "customer").withColumn("k", F.col("c_nationkey"))
    av = long_table(c, "c_custkey", {"segment": F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment"))}, None, ["k"])
    best = most_likely(measures.counts(av, ["k"]), ["k"], "n").select("k", F.col("val").alias("guess"))
    known = F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).otherwise(F.col("guess"))
    return c.join(best, "k", "left").select("c_custkey", known.alias("segment"))


@query("SELECT user_id, event_type, count(value) AS num, round(avg(value), 6) AS mean, round(sqrt(var_pop(value) * count(value)), 5) AS root_m2 FROM events GROUP BY 1, 2")
def moments(spark, sf_dir):
    """Moments of values by user and event type."""
    m = measures.numbers(events_av(spark, sf_dir), ["user_id", "k"])
    return m.select("user_id", F.col("k").alias("event_type"), "num", F.round("mean", 6).alias("mean"), F.round(F.sqrt("m2"), 5).alias("root_m2"))


@query("SELECT event_type, count(value) AS num, round(avg(value), 6) AS mean, round(sqrt(var_pop(value) * count(value)), 5) AS root_m2 FROM events GROUP BY 1")
def moments_merge(spark, sf_dir):
    """Moments of event types, merged from those of users."""
    m = M.merge(measures.numbers(events_av(spark, sf_dir), ["user_id", "k"]), ["k"])
    return m.select(F.col("k").alias("event_type"), "num", F.round("mean", 6).alias("mean"), F.round(F.sqrt("m2"), 5).alias("root_m2"))


@query(f"WITH m AS (SELECT user_id, event_type, count(*) AS n, var_pop(value) * count(*) AS m2 FROM events GROUP BY 1, 2) SELECT user_id, event_type, round({std_sql('n', 'm2')}, 6) AS std FROM m")
def unbiased_std(spark, sf_dir):
    """Corrected standard deviations by user and event type."""
    m = measures.numbers(events_av(spark, sf_dir), ["user_id", "k"])
    return m.select("user_id", F.col("k").alias("event_type"), F.round(M.unbiased_std(F.col("num"), F.col("m2")), 6).alias("std"))


@query(f"""WITH m AS (SELECT l_returnflag AS k, count(*) AS n, avg(l_quantity) AS mean, var_pop(l_quantity) * count(*) AS m2 FROM lineitem GROUP BY 1),
a AS (SELECT avg(l_quantity) AS shift, count(*) AS n, var_pop(l_quantity) * count(*) AS m2 FROM lineitem), sc AS (SELECT shift, {std_sql('n', 'm2')} / 0.5 AS s FROM a)
SELECT k AS concept, round((mean - shift) / s, 6) AS mean, round(sqrt(m2 / n) / s, 6) AS biased_std, round({std_sql('n', 'm2')} / s, 6) AS std FROM m, sc""")
def scaled_std(spark, sf_dir):
    """Means and deviations in units of the whole's scale."""
    li = table(spark, sf_dir, "lineitem").withColumn("nval", F.col("l_quantity"))
    m = li.groupBy(F.col("l_returnflag").alias("concept")).agg(*M.moments())
    whole = li.agg(*M.moments()).select(F.col("mean").alias("shift"), M.scale_or_one(M.unbiased_std(F.col("num"), F.col("m2")) / 0.5).alias("s"))
    std = M.unbiased_std(F.col("num"), F.col("m2")) / F.col("s")
    return m.join(F.broadcast(whole), F.lit(True)).select("concept", F.round(M.scaled_mean(F.col("mean"), F.col("shift"), F.col("s")), 6).alias("mean"), F.round(M.biased_std(F.col("num"), F.col("m2")) / F.col("s"), 6).alias("biased_std"), F.round(std, 6).alias("std"))


@query(f"""WITH m AS (SELECT event_type AS k, avg(value) AS mean, {std_sql('count(*)', '(var_pop(value) * count(*))')} AS s FROM events GROUP BY 1)
SELECT a.k AS a, b.k AS b, round(exp(-((a.mean - b.mean) ** 2) / (2 * (a.s * a.s + b.s * b.s + 1 / (2 * pi())))) / sqrt(2 * pi() * (a.s * a.s + b.s * b.s + 1 / (2 * pi()))), 8) AS overlap FROM m a JOIN m b ON a.k <= b.k""")
def gaussian_overlap(spark, sf_dir):
    """Overlap of the value distributions of event types."""
    m = measures.numbers(events_av(spark, sf_dir), ["k"]).select("k", "mean", M.unbiased_std(F.col("num"), F.col("m2")).alias("s"))
    a, b = m.toDF("a", "ma", "sa"), m.toDF("b", "mb", "sb")
    return a.join(b, F.col("a") <= F.col("b")).select("a", "b", F.round(M.overlap(F.col("ma"), F.col("sa"), F.col("mb"), F.col("sb")), 8).alias("overlap"))


DOCS_LL = """x AS (SELECT doc_id AS inst, source AS c, source || '/' || lang AS l, 'lang' AS attr, lang AS val FROM documents UNION ALL SELECT doc_id, source, source || '/' || lang, 'size', CAST(CAST(floor(ln(n_chars + 1)) AS INTEGER) AS VARCHAR) FROM documents),
cz AS (SELECT c, count(*) / 2.0 AS z FROM x GROUP BY c), lz AS (SELECT l, min(c) AS c, count(*) / 2.0 AS z FROM x GROUP BY l),
cp AS (SELECT x.c, attr, val, count(*) / max(z) AS p FROM x JOIN cz ON cz.c = x.c GROUP BY ALL), lp AS (SELECT x.l, attr, val, count(*) / max(z) AS p FROM x JOIN lz ON lz.l = x.l GROUP BY ALL),
ll AS (SELECT lz.c, lz.l, sum(ln(cp.p * lp.p)) AS ll FROM lz JOIN lp ON lp.l = lz.l JOIN cp ON cp.c = lz.c AND cp.attr = lp.attr AND cp.val = lp.val GROUP BY lz.c, lz.l)"""


def _documents_ll(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("source").alias("cluster"), F.concat_ws("/", "source", "lang").alias("leaf"), F.floor(F.ln(F.col("n_chars") + 1)).cast("int").cast("string").alias("s"))
    av = long_table(d, "doc_id", {"lang": F.col("lang"), "size": F.col("s")}, None, ["cluster", "leaf"])
    sides = [measures.probabilities(measures.counts(av, [k]), measures.sizes(one(av, "lang"), [k]), [k]).withColumnRenamed(k, "key") for k in ("cluster", "leaf")]
    pairs = d.select(F.col("cluster").alias("parent_key"), F.col("leaf").alias("child_key")).distinct()
    return measures.log_likelihood(*sides, pairs), av, d


@query(f"WITH {DOCS_LL} SELECT c AS concept, l AS leaf, round(ll, 5) AS ll FROM ll")
def log_likelihood(spark, sf_dir):
    """Log likelihood of leaves (source and language) under their clusters (source)."""
    return _documents_ll(spark, sf_dir)[0].select(F.col("parent_key").alias("concept"), F.col("child_key").alias("leaf"), F.round("ll", 5).alias("ll"))


def _criterion(spark, sf_dir, name: str) -> DataFrame:
    ll, av, d = _documents_ll(spark, sf_dir)
    leaves = d.groupBy(F.col("leaf").alias("child_key")).agg(F.count(F.lit(1)).alias("n"))
    total = ll.join(leaves, "child_key").agg(F.sum(F.col("ll") * F.col("n")).alias("ll"), F.sum("n").alias("n"))
    k = measures.parameters(measures.counts(av, ["cluster"]), None, ["cluster"]).agg(F.sum("k").alias("k"))
    return total.join(k, F.lit(True)).select(F.round(measures.criteria(F.col("ll"), F.col("k"), F.col("n"))[name], 3).alias(name))


CRITERIA = f"WITH {DOCS_LL}, n AS (SELECT l, count(*) / 2 AS n FROM x GROUP BY l), t AS (SELECT sum(ll * n) AS ll, sum(n) AS n FROM ll JOIN n USING (l)), k AS (SELECT CAST(count(*) AS DOUBLE) AS k FROM cp) SELECT "


@query(CRITERIA + "round(2 * k - 2 * ll, 3) AS aic FROM t, k")
def aic(spark, sf_dir):
    """Akaike's criterion of clustering documents by source."""
    return _criterion(spark, sf_dir, "aic")


@query(CRITERIA + "round(2 * k - 2 * ll + 2 * k * (k + 1) / (n - k - 1), 3) AS aicc FROM t, k")
def aicc(spark, sf_dir):
    """The same, corrected for size."""
    return _criterion(spark, sf_dir, "aicc")


@query(CRITERIA + "round(k * ln(n) - 2 * ll, 3) AS bic FROM t, k")
def bic(spark, sf_dir):
    """Bayes' criterion of clustering documents by source."""
    return _criterion(spark, sf_dir, "bic")


@query("""SELECT event_id, '["k","props"]' AS attr, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS nval FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL""")
def flatten_props(spark, sf_dir):
    """Nested properties as path attributes, innermost name first."""
    e = table(spark, sf_dir, "events").select("event_id", F.struct(F.from_json("props", "struct<k:double>").alias("props")).alias("instance"))
    return transforms.flatten(e, "event_id", "instance").select("event_id", "attr", "nval")


@query("""SELECT '["has-component","?' || r_name || '","?' || n_name || '"]' AS attr, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1
UNION ALL SELECT '["has-component","?' || n_name || '","?customer"]', count(*) FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1""")
def components(spark, sf_dir):
    """Component relations along region, nation and customer paths."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    path = F.array(F.concat(F.lit("?"), "r_name"), F.concat(F.lit("?"), "n_name"), F.lit("?customer"), F.lit("balance"))
    return c.select(F.explode(transforms.component_relations(path)).alias("attr")).groupBy("attr").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT conv_id, 'has-element' AS relation, turn AS a, CAST(NULL AS BIGINT) AS b FROM conversations
UNION ALL SELECT conv_id, 'ordered-list', turn, nxt FROM (SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations) WHERE nxt IS NOT NULL""")
def list_relations(spark, sf_dir):
    """Turns of a conversation as membership and order relations."""
    return transforms.list_relations(table(spark, sf_dir, "conversations"), "conv_id", "turn")


@query("SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS pos, round(CAST(unnest(embedding) AS DOUBLE), 6) AS nval FROM embeddings")
def list_elements(spark, sf_dir):
    """List values as elements with their positions."""
    e = transforms.list_elements(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return e.select("vec_id", (F.regexp_extract("element", r"(\d+)$", 1).cast("int") - 1).alias("pos"), F.round(F.col("val").cast("double"), 6).alias("nval"))


@query("SELECT p_partkey, CAST(p_size AS VARCHAR) AS size FROM part")
def numeric_to_nominal(spark, sf_dir):
    """Numbers as names."""
    return transforms.numeric_to_nominal(table(spark, sf_dir, "part"), ["p_size"]).select("p_partkey", F.col("p_size").alias("size"))


@query("SELECT s_suppkey, coalesce(try_cast(regexp_extract(s_name, '([0-9]+)$', 1) AS DOUBLE), 0.0) AS zeroed, try_cast(s_name AS DOUBLE) AS dropped FROM supplier")
def nominal_to_numeric(spark, sf_dir):
    """Names as numbers, with a policy for those that aren't."""
    s = table(spark, sf_dir, "supplier").withColumn("zeroed", F.regexp_extract("s_name", "([0-9]+)$", 1)).withColumn("dropped", F.col("s_name"))
    return transforms.nominal_to_numeric(transforms.nominal_to_numeric(s, ["zeroed"], "zero"), ["dropped"], "drop").select("s_suppkey", "zeroed", "dropped")


@query("""SELECT page_id, CAST(len(list_filter(string_split(url, '/'), lambda x: x <> '')) AS INTEGER) AS parts, list_filter(string_split(url, '/'), lambda x: x <> '')[-1] AS last_part FROM pages""")
def variables(spark, sf_dir):
    """Variables of path attributes made from page addresses."""
    p = table(spark, sf_dir, "pages").withColumn("attr", F.to_json(F.transform(F.filter(F.split("url", "/"), lambda x: x != ""), lambda x: F.concat(F.lit("?"), x))))
    v = transforms.variables(F.col("attr"))
    return p.select("page_id", F.size(v).alias("parts"), F.regexp_replace(F.element_at(v, -1), r"^\?", "").alias("last_part"))


@query("""SELECT p_partkey, '["made-by","?brand' || right(p_brand, 1) || '","?p"]' AS attr FROM part""")
def rename(spark, sf_dir):
    """Relations with their variables renamed by a mapping."""
    p = table(spark, sf_dir, "part")
    old = F.to_json(F.array(F.lit("made-by"), F.concat(F.lit("?b"), F.substr("p_brand", F.length("p_brand"))), F.lit("?p")))
    mapping = F.map_from_arrays(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.concat(F.lit("?b"), i.cast("string"))), F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.concat(F.lit("?brand"), i.cast("string"))))
    return p.select("p_partkey", transforms.renamed(old, mapping).alias("attr"))


@query("""WITH x AS (SELECT 'status' AS attr, l_linestatus AS v FROM lineitem UNION ALL SELECT 'flag', l_returnflag FROM lineitem UNION ALL SELECT 'line', CAST(l_linenumber AS VARCHAR) FROM lineitem UNION ALL SELECT 'part', CAST(l_partkey AS VARCHAR) FROM lineitem UNION ALL SELECT 'constant', '1' FROM lineitem)
SELECT attr, count(DISTINCT v) AS distinct_values, CASE WHEN count(DISTINCT v) = count(*) AND count(*) > 1 THEN 'unique' WHEN count(DISTINCT v) > 10 THEN 'nominal20' WHEN count(DISTINCT v) > 2 THEN 'nominal' WHEN count(DISTINCT v) = 2 THEN 'binary' ELSE 'constant' END AS kind FROM x GROUP BY attr""")
def attr_profile(spark, sf_dir):
    """Kinds of attributes by their distinct values."""
    li = table(spark, sf_dir, "lineitem").withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    av = long_table(li, "id", {"status": F.col("l_linestatus"), "flag": F.col("l_returnflag"), "line": F.col("l_linenumber"), "part": F.col("l_partkey"), "constant": F.lit("1")})
    return trees.attribute_kinds(av)


@query("SELECT concept, val FROM (SELECT o_orderpriority AS concept, o_orderstatus AS val, row_number() OVER (PARTITION BY o_orderpriority ORDER BY count(*) DESC, o_orderstatus DESC) AS r FROM orders GROUP BY 1, 2) WHERE r = 1")
def majority_value(spark, sf_dir):
    """Modal value of each concept, ties to the last in text order."""
    c = measures.counts(orders_av(spark, sf_dir).filter("attr = 'status'"), ["k"])
    w = Window.partitionBy("k").orderBy(F.col("n").desc(), F.col("val").desc())
    return c.withColumn("r", F.row_number().over(w)).filter("r = 1").select(F.col("k").alias("concept"), "val")


@query("SELECT l_returnflag AS concept, round(CAST(count(*) FILTER (l_linestatus = 'O') AS DOUBLE) / count(*), 6) AS ratio FROM lineitem GROUP BY 1")
def binary_ratio(spark, sf_dir):
    """Share of one of an attribute's two values."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("concept")).agg(F.round(F.count_if(F.col("l_linestatus") == "O") / F.count(F.lit(1)), 6).alias("ratio"))


@query("""SELECT 'n_regionkey=' || n_regionkey AS concept, round(min(m), 4) AS low, round(max(m), 4) AS high FROM (SELECT c_nationkey, avg(c_acctbal) AS m FROM customer GROUP BY 1 UNION ALL
SELECT -1 - n_regionkey, avg(c_acctbal) FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_regionkey) q JOIN nation ON n_nationkey = q.c_nationkey OR -1 - n_regionkey = q.c_nationkey GROUP BY n_regionkey""")
def mean_range(spark, sf_dir):
    """Least and greatest mean of an attribute in each region's subtree."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    level = F.explode(F.array(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")))).alias("node")
    means = c.select("n_regionkey", level, F.col("c_acctbal").alias("nval")).groupBy("n_regionkey", "node").agg(*M.moments())
    return means.groupBy("n_regionkey").agg(F.round(F.min("mean"), 4).alias("low"), F.round(F.max("mean"), 4).alias("high")).select(F.concat(F.lit("n_regionkey="), F.col("n_regionkey").cast("string")).alias("concept"), "low", "high")


@query("SELECT p_partkey, CAST(row_number() OVER (ORDER BY reverse(lower(replace(replace(p_name, '(', ''), ')', ''))), p_partkey) AS BIGINT) AS place FROM part")
def reverse_text_order(spark, sf_dir):
    """Names in the order of their reversed lower-case text."""
    return trees.ranked_by_reversed_text(table(spark, sf_dir, "part"), "p_name", "p_partkey")


@query("""SELECT event_id, round(coalesce(CAST(sum(hit) OVER w AS DOUBLE) / nullif(count(*) OVER v, 0), 0), 6) AS p FROM (SELECT event_id, event_type, 1 AS hit FROM events)
WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), v AS (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def prequential_baseline(spark, sf_dir):
    """Probability of each event's type from the events before it, before it is learned."""
    return evaluate.running_baseline(table(spark, sf_dir, "events"), "event_id", "event_type").select("event_id", F.round("p", 6).alias("p"))


PART_ERROR = "WITH m AS (SELECT p_brand, avg(p_retailprice) AS m FROM part GROUP BY 1) SELECT p_partkey, "


@query(PART_ERROR + "round(abs(p_retailprice - m), 4) AS error FROM part JOIN m USING (p_brand)")
def error_abs(spark, sf_dir):
    """Absolute error of predicting a part's price by its brand's mean."""
    return evaluate.group_mean_error(table(spark, sf_dir, "part"), "p_brand", "p_retailprice").select("p_partkey", F.round(F.abs("error"), 4).alias("error"))


@query(PART_ERROR + "round((p_retailprice - m) ** 2, 2) AS error FROM part JOIN m USING (p_brand)")
def error_sq(spark, sf_dir):
    """Squared error of the same prediction."""
    return evaluate.group_mean_error(table(spark, sf_dir, "part"), "p_brand", "p_retailprice").select("p_partkey", F.round(F.col("error") ** 2, 2).alias("error"))


@query("SELECT event_id, round(m, 6) AS average FROM (SELECT event_id, avg(value) OVER w AS m, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) WHERE n = 5")
def moving_average(spark, sf_dir):
    """Trailing mean of five values of each user."""
    return evaluate.moving_average(table(spark, sf_dir, "events"), ["user_id"], "event_id", "value", 5).select("event_id", F.round("average", 6).alias("average"))


#: Hill's expansion of the t quantile at 0.975 in 1 / (n - 1); good to six digits from ten degrees of freedom on.
T_975 = "(1.959963984540054 + 2.372271283 / {v} + 2.822497872 / {v} ** 2 + 2.555848780 / {v} ** 3 + 1.589535586 / {v} ** 4)"


@query(f"SELECT CAST(EXTRACT(hour FROM ts) AS INTEGER) AS hour, count(*) AS n, round(avg(value), 6) AS mean, round({T_975.format(v='(count(*) - 1.0)')} * stddev_samp(value) / sqrt(count(*)), 3) AS half_width FROM events GROUP BY 1")
def avg_lines(spark, sf_dir):
    """Mean and confidence interval for each hour, by Student's quantile."""
    e = table(spark, sf_dir, "events").withColumn("hour", F.hour("ts"))
    return evaluate.mean_interval(e, ["hour"], "value").select("hour", "n", F.round("mean", 6).alias("mean"), F.round("half_width", 3).alias("half_width"))


LABELLED = "WITH x AS (SELECT lang AS a, CAST(quality AS VARCHAR) AS b FROM documents JOIN labels USING (doc_id)), c AS (SELECT a, b, count(*) AS n FROM x GROUP BY ALL)"


@query(LABELLED + """, p AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS ab, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY a)) AS a, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY b)) AS b, (SELECT sum(n) * (sum(n) - 1) / 2 FROM c) AS t)
SELECT round((ab - a * b / t) / ((a + b) / 2 - a * b / t), 6) AS ari FROM p""")
def ari(spark, sf_dir):
    """Adjusted Rand index of languages against quality labels."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("lang", F.col("quality").cast("string").alias("q"))
    return clusters.adjusted_rand(d, "lang", "q").select(F.round("ari", 6).alias("ari"))


@query(LABELLED + " SELECT a, b, n FROM c")
def confusion(spark, sf_dir):
    """Contingency of languages and quality labels."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return d.groupBy(F.col("lang").alias("a"), F.col("quality").cast("string").alias("b")).agg(F.count(F.lit(1)).alias("n"))


@query(LABELLED + " SELECT CAST(sum(n) - sum(m) AS BIGINT) AS wrong FROM (SELECT a, sum(n) AS n, max(n) AS m FROM c GROUP BY a)")
def misclassification(spark, sf_dir):
    """Documents outside the majority label of their language."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return clusters.misclassified(d, "lang", "quality")


@query(f"WITH {ORDERS_AV}, z AS (SELECT k, count(*) / 2 AS size FROM av GROUP BY k), c AS (SELECT k, attr, val, count(*) AS n FROM av GROUP BY ALL), e AS (SELECT c.k, max(size) AS size, sum(CAST(n AS DOUBLE) * n) / (max(size) * max(size) * 2) AS ecg FROM c JOIN z USING (k) GROUP BY c.k), p AS (SELECT sum(n * n) / (max(t) * max(t) * 2) AS ecg FROM (SELECT attr, val, CAST(sum(n) AS DOUBLE) AS n FROM c GROUP BY ALL), (SELECT CAST(sum(size) AS DOUBLE) AS t FROM z)) SELECT round(-1e6 * (sum(e.size / t * e.ecg) - max(p.ecg)) / count(*), 4) AS score FROM e, p, (SELECT CAST(sum(size) AS DOUBLE) AS t FROM z)")
def cluster_cu(spark, sf_dir):
    """Negative utility of a flat clustering, in millionths: the score that a search for cuts minimises."""
    av = orders_av(spark, sf_dir).filter("sval IS NOT NULL")
    cu = measures.utility(measures.counts(av, ["k"]), measures.sizes(one(av), ["k"]), [], "k")
    return cu.select(F.round(-1e6 * F.col("cu"), 4).alias("score"))


def geography(spark, sf_dir) -> DataFrame:
    """A fixed tree of concepts: world, regions, nations."""
    return trees.from_levels(table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey")), ["r_name", "n_name"])


GEO = "g AS (SELECT 'world' AS concept, CAST(NULL AS VARCHAR) AS parent UNION ALL SELECT DISTINCT 'world/' || r_name, 'world' FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT 'world/' || r_name || '/' || n_name, 'world/' || r_name FROM nation JOIN region ON r_regionkey = n_regionkey)"


@query(f"""WITH RECURSIVE {GEO}, up AS (SELECT concept, concept AS anc, 0 AS d FROM g UNION ALL SELECT up.concept, g.parent, d + 1 FROM up JOIN g ON g.concept = up.anc WHERE g.parent IS NOT NULL)
SELECT concept, anc AS ancestor FROM up""")
def ancestors(spark, sf_dir):
    """Every concept with its ancestors, itself included."""
    return trees.ancestors(geography(spark, sf_dir)).select("concept", "ancestor")


@query(f"""WITH RECURSIVE {GEO}, up AS (SELECT concept, concept AS anc FROM g UNION ALL SELECT up.concept, g.parent FROM up JOIN g ON g.concept = up.anc WHERE g.parent IS NOT NULL) SELECT anc AS concept, count(*) AS n FROM up GROUP BY anc""")
def subtree_size(spark, sf_dir):
    """Concepts below each concept, itself included."""
    return trees.subtree_sizes(geography(spark, sf_dir))


@query("SELECT c_custkey, d, CASE d WHEN 0 THEN 'world' WHEN 1 THEN 'world/' || r_name ELSE 'world/' || r_name || '/' || n_name END AS label FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey, (VALUES (0), (1), (2)) AS l(d)")
def depth_labels(spark, sf_dir):
    """For each customer its ancestor at each depth of the tree."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return trees.depth_labels(c.select("c_custkey", F.concat_ws("/", F.lit("world"), "r_name", "n_name").alias("concept")), geography(spark, sf_dir), "c_custkey", 2)


@query(f"WITH {GEO} SELECT concept FROM g WHERE concept IN (SELECT parent FROM g)")
def trim_leaves(spark, sf_dir):
    """The tree without its leaves."""
    return trees.without_leaves(geography(spark, sf_dir), 1).select("concept")


@query(f"WITH {GEO} SELECT concept FROM g WHERE concept NOT LIKE 'world/ASIA/%'")
def trim_to_clusters(spark, sf_dir):
    """The tree cut below one concept."""
    return trees.trimmed_to(geography(spark, sf_dir), ["world/ASIA"]).select("concept")
