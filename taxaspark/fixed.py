"""Registered queries over fixed trees (world, region, nation) and mixed tables, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxaspark.operators import descent
from taxaspark.plans import measures, transforms, trees
from taxaspark.queries import geography, query, std_sql, table
from taxaspark.sources import nested
from taxaspark.storage import shared_path, stored

NUMERIC = "map<string,double>"


def customers(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return c.join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))


def debt() -> Column:
    return F.when(F.col("c_acctbal") < 0, "true").otherwise("false")


def nominal_tree(spark, sf_dir) -> DataFrame:
    """Customers under world, region and nation, with segment and debt."""
    return stored(descent.from_paths(customers(spark, sf_dir), ["r_name", "n_name"], {"segment": F.col("c_mktsegment"), "debt": debt()}), "tree")


def mixed_tree(spark, sf_dir) -> DataFrame:
    """The same with the balance as a number, and no segment for customers in debt."""
    segment = F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment"))
    return stored(descent.from_paths(customers(spark, sf_dir), ["r_name", "n_name"], {"segment": segment}, {"balance": F.col("c_acctbal")}), "tree")


BASE = """x AS (SELECT c_custkey AS inst, c_mktsegment AS seg, CASE WHEN c_acctbal < 0 THEN 'true' ELSE 'false' END AS debt, c_acctbal AS bal, r_name AS r, r_name || '/' || n_name AS l
FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey),
av AS (SELECT inst, r, l, 'segment' AS attr, seg AS val FROM x UNION ALL SELECT inst, r, l, 'debt', debt FROM x)"""


@query(f"""WITH {BASE}, p AS (SELECT '' AS label, attr, val FROM av UNION ALL SELECT r, attr, val FROM av UNION ALL SELECT l, attr, val FROM av)
SELECT label, attr, val, count(*) AS n FROM p GROUP BY ALL""")
def tree_counts(spark, sf_dir):
    """Counts of values in every concept of a fixed tree."""
    tree = nominal_tree(spark, sf_dir)
    return descent.nominal_counts(tree).join(tree.select("tree", "concept", "label"), ["tree", "concept"]).select(F.regexp_replace("label", "^/", "").alias("label"), "attr", "val", "n")


def _level(k: str, within: str) -> str:
    """SQL for the best concept ``k`` of a level for each kind of customer; ``within``: a join with the level above, or nothing."""
    return f"""(WITH c AS (SELECT {k} AS k, attr, val, count(*) AS n FROM av GROUP BY ALL), z AS (SELECT {k} AS k, min(r) AS r, count(*) AS size FROM x GROUP BY 1),
s AS (SELECT k, sum(CAST(n AS DOUBLE) * n) AS s, count(DISTINCT attr) AS a FROM c GROUP BY k), p AS (SELECT DISTINCT seg, debt FROM x),
g AS (SELECT p.seg, p.debt, z.k, z.size, s.s, s.a, 2 + 2 * coalesce((SELECT n FROM c WHERE c.k = z.k AND attr = 'segment' AND val = p.seg), 0) + 2 * coalesce((SELECT n FROM c WHERE c.k = z.k AND attr = 'debt' AND val = p.debt), 0) AS g,
2 - (SELECT count(DISTINCT attr) FROM c WHERE c.k = z.k) AS u FROM p CROSS JOIN z JOIN s USING (k) {within})
SELECT seg, debt, k FROM (SELECT seg, debt, k, row_number() OVER (PARTITION BY seg, debt ORDER BY round((s + g) / ((size + 1) * (a + u)) - s / (size * a), 9) DESC, size DESC, k) AS rn FROM g) WHERE rn = 1)"""


@query(f"""WITH {BASE}, one AS (SELECT * FROM {_level('r', '')}), two AS (SELECT * FROM {_level('l', 'JOIN one ON one.seg = p.seg AND one.debt = p.debt AND one.k = z.r')})
SELECT x.inst, two.k AS label FROM x JOIN two ON two.seg = x.seg AND two.debt = x.debt""")
def categorize_fixed(spark, sf_dir):
    """The nation that suits each customer's segment and debt best, by descent from the world."""
    tree = nominal_tree(spark, sf_dir)
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("inst"), F.lit("tree").alias("tree"), F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("debt"), debt()).alias("nominal"), F.create_map().cast(NUMERIC).alias("numeric"))
    placed = descent.categorize(rows, tree).join(tree.select("tree", "concept", "label"), ["tree", "concept"])
    return placed.select("inst", F.regexp_replace("label", "^/", "").alias("label"))


def _placed(spark, sf_dir, tree: DataFrame) -> DataFrame:
    """Customers in their own nations, with nothing known of them."""
    label = F.concat(F.lit("/"), F.concat_ws("/", "r_name", "n_name"))
    rows = customers(spark, sf_dir).select(F.col("c_custkey").alias("inst"), label.alias("label"), F.col("c_acctbal").alias("balance"), F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("segment"))
    none = [F.create_map().cast("map<string,string>").alias("nominal"), F.create_map().cast(NUMERIC).alias("numeric")]
    return rows.join(tree.select("tree", "concept", F.concat(F.lit("/"), F.regexp_replace("label", "^/", "")).alias("label")), "label").select("inst", "tree", "concept", "balance", "segment", *none)


MODE = """m AS (SELECT l, val, row_number() OVER (PARTITION BY l ORDER BY count(*) DESC, val ASC NULLS LAST) AS rn FROM (SELECT l, CASE WHEN bal >= 0 THEN seg END AS val FROM x) GROUP BY l, val), b AS (SELECT l, avg(bal) AS mean FROM x GROUP BY l)"""


@query(f"WITH {BASE}, {MODE} SELECT inst, 'segment' AS attr, val AS sval, CAST(NULL AS DOUBLE) AS nval FROM x JOIN m USING (l) WHERE rn = 1 UNION ALL SELECT inst, 'balance', NULL, round(mean, 5) FROM x JOIN b USING (l)")
def infer_missing_fixed(spark, sf_dir):
    """Segment and balance of each customer by its nation: a name that may be missing, and a mean."""
    tree = mixed_tree(spark, sf_dir)
    return descent.infer(_placed(spark, sf_dir, tree), tree).withColumn("nval", F.round("nval", 5))


@query(f"WITH {BASE}, {MODE.replace('ASC NULLS LAST', 'ASC').replace('GROUP BY l, val)', 'WHERE val IS NOT NULL GROUP BY l, val)')} SELECT inst, val AS sval FROM x JOIN m USING (l) WHERE rn = 1")
def infer_never_missing(spark, sf_dir):
    """Segment of each customer by its nation, where being missing is no choice."""
    tree = mixed_tree(spark, sf_dir)
    return descent.infer(_placed(spark, sf_dir, tree), tree, ["segment"], allow_none=False).select("inst", "sval")


@query(f"WITH {BASE}, {MODE} SELECT inst, round(bal - mean, 4) AS error, round(abs(bal - mean), 4) AS absolute FROM x JOIN b USING (l)")
def prediction_error_number(spark, sf_dir):
    """Signed and absolute error of predicting each balance by its nation's concept."""
    tree = mixed_tree(spark, sf_dir)
    return descent.scored(_placed(spark, sf_dir, tree), tree, "balance", "balance").select("inst", F.round("error", 4).alias("error"), F.round("absolute", 4).alias("absolute"))


@query(f"WITH {BASE}, {MODE} SELECT inst, CAST(CASE WHEN (CASE WHEN bal >= 0 THEN seg END) IS NOT DISTINCT FROM val THEN 0 ELSE 1 END AS DOUBLE) AS squared FROM x JOIN m USING (l) WHERE rn = 1")
def prediction_error_name(spark, sf_dir):
    """Error, 0 or 1, of predicting each segment, which may be missing."""
    tree = mixed_tree(spark, sf_dir)
    return descent.scored(_placed(spark, sf_dir, tree), tree, "segment", "segment").select("inst", "squared")


@query("SELECT c_custkey AS inst, (SELECT c_mktsegment FROM customer GROUP BY 1 ORDER BY count(*) DESC, c_mktsegment LIMIT 1) AS sval FROM customer")
def baseline_categorize(spark, sf_dir):
    """The baseline's prediction: every customer is in the one concept that holds all."""
    tree = stored(descent.from_paths(customers(spark, sf_dir), [], {"segment": F.col("c_mktsegment")}), "tree")
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("inst"), F.lit("tree").alias("tree"), F.create_map().cast("map<string,string>").alias("nominal"), F.create_map().cast(NUMERIC).alias("numeric"))
    placed = rows.join(descent.categorize(rows, tree), ["inst", "tree"])
    return descent.infer(placed, tree).select("inst", "sval")


@query(f"""WITH {BASE}, y AS (SELECT l, CASE WHEN bal >= 0 THEN seg END AS val, bal FROM x), z AS (SELECT l, CAST(count(*) AS DOUBLE) AS size FROM y GROUP BY l)
SELECT l AS label, 'segment' AS attr, coalesce(val, '<none>') AS val, round(count(*) / max(size), 6) AS p, CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS std FROM y JOIN z USING (l) GROUP BY l, y.val
UNION ALL SELECT l, 'balance', '<number>', 1.0, round(avg(bal), 5), round({std_sql('count(*)', '(var_pop(bal) * count(*))')}, 5) FROM y GROUP BY l""")
def weighted_values_mixed(spark, sf_dir):
    """The choices of each nation's attributes: names, a number's distribution, and being missing."""
    tree = mixed_tree(spark, sf_dir)
    size = tree.filter("depth = 2").select("tree", "concept", "label", F.col("n").alias("size"))
    w = measures.weighted_values(descent.nominal_counts(tree), descent.numeric_moments(tree), size.drop("label"), ["tree", "concept"]).join(size.drop("size"), ["tree", "concept"])
    val = F.when(F.col("val").isNull(), "<none>").when(F.col("val") == measures.NUMBER, "<number>").otherwise(F.col("val"))
    return w.select(F.regexp_replace("label", "^/", "").alias("label"), "attr", val.alias("val"), F.round("p", 6).alias("p"), F.round("mean", 5).alias("mean"), F.round("std", 5).alias("std"))


STD = std_sql("count(*)", "(var_pop(bal) * count(*))")
MIXED = f"""{BASE}, y AS (SELECT r, l, CASE WHEN bal >= 0 THEN seg END AS val, bal FROM x), rz AS (SELECT r, CAST(count(*) AS DOUBLE) AS z, avg(bal) AS m, {STD} AS s FROM y GROUP BY r), lz AS (SELECT min(r) AS r, l, CAST(count(*) AS DOUBLE) AS z, avg(bal) AS m, {STD} AS s FROM y GROUP BY l),
rp AS (SELECT r, val, count(*) AS n FROM y GROUP BY ALL), lp AS (SELECT l, val, count(*) AS n FROM y GROUP BY ALL),
names AS (SELECT lz.l, sum(ln(lp.n / lz.z * rp.n / rz.z)) AS ll FROM lz JOIN rz ON rz.r = lz.r JOIN lp ON lp.l = lz.l JOIN rp ON rp.r = lz.r AND rp.val IS NOT DISTINCT FROM lp.val GROUP BY lz.l),
ll AS (SELECT lz.r, lz.l, lz.z, names.ll - ((lz.m - rz.m) ** 2) / (2 * (lz.s * lz.s + rz.s * rz.s + 1 / (2 * pi()))) - ln(sqrt(2 * pi() * (lz.s * lz.s + rz.s * rz.s + 1 / (2 * pi())))) AS ll FROM lz JOIN rz ON rz.r = lz.r JOIN names ON names.l = lz.l)"""


@query(f"WITH {MIXED} SELECT r AS concept, l AS leaf, round(ll, 4) AS ll FROM ll")
def log_likelihood_mixed(spark, sf_dir):
    """Log likelihood of nations under their regions, with a number and a name that may be missing."""
    tree = mixed_tree(spark, sf_dir)
    name = F.regexp_replace("label", "^/", "")
    w = measures.weighted_values(descent.nominal_counts(tree), descent.numeric_moments(tree), tree.select("tree", "concept", F.col("n").alias("size")), ["tree", "concept"])
    w = stored(w.join(tree.select("tree", "concept", name.alias("key")), ["tree", "concept"]).drop("tree", "concept"), "weighted")
    pairs = tree.filter("depth = 2").select(F.split_part(name, F.lit("/"), F.lit(1)).alias("parent_key"), name.alias("child_key"))
    return measures.log_likelihood_mixed(w, w, pairs).select(F.col("parent_key").alias("concept"), F.col("child_key").alias("leaf"), F.round("ll", 4).alias("ll"))


def _criterion(spark, sf_dir, name: str) -> DataFrame:
    """A criterion, in tenths, of the cut into regions."""
    tree = mixed_tree(spark, sf_dir)
    opened = tree.filter("depth = 0").select("tree", F.col("concept").alias("node"), F.lit(1).alias("opened"))
    leaves = tree.filter("depth = 2").select("tree", "concept", "n")
    return descent.cut_criteria(tree, descent.cuts(tree, opened), leaves).select("clusters", F.round(F.col(name), 1).alias(name))


K_REGIONS = "k AS (SELECT CAST(count(*) FILTER (val IS NOT NULL) AS DOUBLE) + 2 * count(DISTINCT r) AS k, count(DISTINCT r) AS clusters FROM rp), t AS (SELECT sum(ll * z) AS ll, sum(z) AS n FROM ll)"


@query(f"WITH {MIXED}, {K_REGIONS} SELECT clusters, round(2 * k - 2 * ll, 1) AS aic FROM k, t")
def aic_mixed(spark, sf_dir):
    """Akaike's criterion of the cut into regions, with numeric parameters."""
    return _criterion(spark, sf_dir, "aic")


@query(f"WITH {MIXED}, {K_REGIONS} SELECT clusters, CASE WHEN n - k <= 1 THEN CAST('inf' AS DOUBLE) ELSE round(2 * k - 2 * ll + 2 * k * (k + 1) / (n - k - 1), 1) END AS aicc FROM k, t")
def aicc_mixed(spark, sf_dir):
    """The same, corrected for size."""
    return _criterion(spark, sf_dir, "aicc")


@query(f"WITH {MIXED}, {K_REGIONS} SELECT clusters, round(k * ln(n) - 2 * ll, 1) AS bic FROM k, t")
def bic_mixed(spark, sf_dir):
    """Bayes' criterion of the same cut."""
    return _criterion(spark, sf_dir, "bic")


OPENED = f"""{BASE}, cw AS (SELECT label, sum(CAST(n AS DOUBLE) * n) / (max(size) * count(DISTINCT attr)) AS w FROM (SELECT label, attr, val, count(*) AS n FROM (SELECT '' AS label, attr, val FROM av UNION ALL SELECT r, attr, val FROM av UNION ALL SELECT l, attr, val FROM av) GROUP BY ALL)
JOIN (SELECT '' AS label, count(*) AS size FROM x UNION ALL SELECT r, count(*) FROM x GROUP BY r UNION ALL SELECT l, count(*) FROM x GROUP BY l) USING (label) GROUP BY label),
root AS (SELECT w AS w0, (SELECT count(*) FROM x) AS size FROM cw WHERE label = ''),
reg AS (SELECT a.label AS r, any_value(a.w) AS w, sum(b.w) AS cw, count(*) AS m FROM cw a JOIN cw b ON b.label LIKE a.label || '/%' WHERE a.label <> '' AND a.label NOT LIKE '%/%' GROUP BY a.label),
st AS (SELECT 1 AS opened, CAST([] AS VARCHAR[]) AS done, '' AS node, sum(w) AS t, count(*) AS k FROM reg
UNION ALL SELECT opened + 1, list_append(done, r), r, t - w + cw, k - 1 + m FROM (SELECT st.*, reg.r, reg.w, reg.cw, reg.m, row_number() OVER (ORDER BY round((t - w + cw - w0) / (size * (k - 1 + m)), 12) DESC, reg.r) AS rn FROM st JOIN reg ON NOT list_contains(done, reg.r) CROSS JOIN root WHERE opened < 6) WHERE rn = 1)"""


@query(f"WITH RECURSIVE {OPENED} SELECT CAST(opened AS INTEGER) AS opened, node, round(1e6 * (t - w0) / (size * k), 3) AS cu_millionths FROM st, root WHERE opened <= 4")
def openings_fixed(spark, sf_dir):
    """The first four concepts that a search for good cuts opens, and each cut's utility."""
    tree = nominal_tree(spark, sf_dir)
    found = descent.openings(tree, 4).join(tree.select("tree", F.col("concept").alias("node"), "label"), ["tree", "node"])
    return found.select("opened", F.regexp_replace("label", "^/", "").alias("node"), F.round(1e6 * F.col("cu"), 3).alias("cu_millionths"))


@query(f"WITH RECURSIVE {OPENED} SELECT CAST(opened AS INTEGER) AS split, round(1e6 * (t - w0) / (size * k), 3) AS cu_millionths FROM st, root ORDER BY round((t - w0) / (size * k), 12) DESC, opened LIMIT 1")
def split_search_fixed(spark, sf_dir):
    """The cut of the greatest utility."""
    best = descent.openings(nominal_tree(spark, sf_dir), 10)
    best = best.groupBy("tree").agg(F.max_by("opened", F.struct(F.round("cu", 12), -F.col("opened"))).alias("split"), F.max("cu").alias("cu"))
    return best.select("split", F.round(1e6 * F.col("cu"), 3).alias("cu_millionths"))


CRITERIA = {"aic": "2 * p - 2 * ll", "aicc": "CASE WHEN n - p <= 1 THEN CAST('inf' AS DOUBLE) ELSE 2 * p - 2 * ll + 2 * p * (p + 1) / (n - p - 1) END", "bic": "p * ln(n) - 2 * ll"}


def _searched_sql(heuristic: str) -> str:
    """SQL for the openings by a criterion, as ``st`` (opened, node, score)."""
    after = CRITERIA[heuristic].replace("ll", "(t - reg.ll + cl)").replace("p ", "(k - reg.p + cp) ").replace("- p", "- (k - reg.p + cp)").replace("(p + 1)", "(k - reg.p + cp + 1)")
    own = "-ln(sqrt(2 * pi() * (2 * s * s + 1 / (2 * pi()))))"
    return f"""{MIXED}, n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM x),
own AS (SELECT lz.r, lz.l, z * (sum(2 * ln(lp.n / z)) + any_value({own})) AS ll, CAST(count(val) + 2 AS DOUBLE) AS p FROM lz JOIN lp ON lp.l = lz.l GROUP BY lz.r, lz.l, z),
reg AS (SELECT r, sum(ll.ll * ll.z) AS ll, (SELECT count(val) + 2 FROM rp WHERE rp.r = ll.r) AS p, (SELECT sum(ll) FROM own WHERE own.r = ll.r) AS cl, (SELECT sum(p) FROM own WHERE own.r = ll.r) AS cp FROM ll GROUP BY r),
st AS (SELECT 1 AS opened, CAST([] AS VARCHAR[]) AS done, '' AS node, sum(ll) AS t, CAST(sum(p) AS DOUBLE) AS k FROM reg
UNION ALL SELECT opened + 1, list_append(done, r), r, t - ll + cl, k - p + cp FROM (SELECT st.*, reg.r, reg.ll, reg.p, reg.cl, reg.cp, row_number() OVER (ORDER BY round({after}, 12), reg.r) AS rn FROM st JOIN reg ON NOT list_contains(done, reg.r) CROSS JOIN n WHERE opened < 6) WHERE rn = 1),
found AS (SELECT opened, node, {CRITERIA[heuristic]} AS score FROM (SELECT opened, node, t AS ll, k AS p FROM st), n)"""


def _searched(spark, sf_dir, heuristic: str) -> DataFrame:
    tree = mixed_tree(spark, sf_dir)
    found = descent.openings(tree, 10, heuristic=heuristic).join(tree.select("tree", F.col("concept").alias("node"), "label"), ["tree", "node"])
    return found.select("opened", F.regexp_replace("label", "^/", "").alias("node"), F.round("score", 1).alias("score"))


@query(f"WITH RECURSIVE {_searched_sql('aic')} SELECT CAST(opened AS INTEGER) AS opened, node, round(score, 1) AS score FROM found")
def openings_aic(spark, sf_dir):
    """The concepts that a search by Akaike's criterion opens, one after another, and each cut's criterion."""
    return _searched(spark, sf_dir, "aic")


@query(f"WITH RECURSIVE {_searched_sql('aicc')} SELECT CAST(opened AS INTEGER) AS opened, node, round(score, 1) AS score FROM found")
def openings_aicc(spark, sf_dir):
    """The same by the criterion corrected for size."""
    return _searched(spark, sf_dir, "aicc")


@query(f"WITH RECURSIVE {_searched_sql('bic')} SELECT CAST(opened AS INTEGER) AS opened, node, round(score, 1) AS score FROM found")
def openings_bic(spark, sf_dir):
    """The same by Bayes' criterion."""
    return _searched(spark, sf_dir, "bic")


@query(f"WITH RECURSIVE {_searched_sql('bic')} SELECT CAST(opened AS INTEGER) AS split, round(score, 1) AS score FROM found ORDER BY round(found.score, 12), opened LIMIT 1")
def split_search_bic(spark, sf_dir):
    """The cut of the least Bayes' criterion."""
    tree = mixed_tree(spark, sf_dir)
    return descent.split_search(descent.openings(tree, 10, heuristic="bic"), "bic").select("split", F.round("score", 1).alias("score"))


@query(f"WITH RECURSIVE {OPENED}, last AS (SELECT done FROM st WHERE k <= 12 ORDER BY opened DESC LIMIT 1) SELECT DISTINCT l AS leaf, CASE WHEN list_contains(done, r) THEN l ELSE r END AS cluster FROM x, last")
def k_cluster_fixed(spark, sf_dir):
    """The largest cut of at most twelve clusters: the cluster of each nation."""
    tree = nominal_tree(spark, sf_dir)
    names = tree.select("tree", "concept", F.regexp_replace("label", "^/", "").alias("name"))
    cut = descent.largest_cut(tree, 12).withColumn("cluster", F.regexp_extract("label", r"(\d+)$", 1).cast("long"))
    leaf = cut.join(names.withColumnRenamed("name", "leaf"), ["tree", "concept"])
    return leaf.join(names.select("tree", F.col("concept").alias("cluster"), "name"), ["tree", "cluster"]).select("leaf", F.col("name").alias("cluster"))


@query("SELECT p_brand || '/' || p_size AS concept, count(*) AS exact FROM part GROUP BY p_brand, p_size HAVING count(DISTINCT p_size) = 1")
def exact_match_mixed(spark, sf_dir):
    """Parts that match concepts of one brand and one size exactly; sizes are numbers."""
    p = table(spark, sf_dir, "part")
    none = F.lit(None)
    cells = F.explode(F.array(F.struct(F.lit("brand").alias("attr"), F.col("p_brand").alias("sval"), none.cast("double").alias("nval")), F.struct(F.lit("size").alias("attr"), none.cast("string").alias("sval"), F.col("p_size").cast("double").alias("nval")), F.struct(F.lit("_type").alias("attr"), F.col("p_type").alias("sval"), none.cast("double").alias("nval")))).alias("c")
    av = p.select(F.col("p_partkey").alias("inst"), F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("k"), cells).select("inst", "k", "c.*")
    hits = measures.exact_match(av, measures.counts(av, ["k"]), measures.sizes(av.filter("attr = 'brand'"), ["k"]), "k", measures.numbers(av, ["k"]))
    return hits.groupBy(F.col("k").alias("concept")).agg(F.count(F.lit(1)).alias("exact"))


@query("""SELECT p_partkey, '{"made":{"by":{"brand":"' || p_brand || '"},"size":' || CAST(CAST(p_size AS DOUBLE) AS VARCHAR) || '},"type":"' || p_type || '"}' AS json FROM part""")
def unflatten(spark, sf_dir):
    """Nested parts flattened and put together again."""
    made = F.struct(F.struct(F.col("p_brand").alias("brand")).alias("by"), F.col("p_size").alias("size"))
    p = table(spark, sf_dir, "part").select("p_partkey", F.struct(made.alias("made"), F.col("p_type").alias("type")).alias("instance"))
    chain = transforms.Pipeline((lambda df: transforms.flatten(df, "p_partkey", "instance"), lambda df: transforms.unflattened(df, "p_partkey")))
    return chain.undo(chain.transform(p))


@query("SELECT unnest(['world', 'world/ASIA', 'world/ASIA/' || n_name]) AS concept FROM nation WHERE n_name = (SELECT min(n_name) FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA')")
def find_concept(spark, sf_dir):
    """A concept by its name, with those on the way to it."""
    g = geography(spark, sf_dir)
    return trees.find_all(g, g.filter("depth = 2 AND parent = 'world/ASIA'").agg(F.min("concept").alias("concept"))).select("concept")


@query()
def tree_nested(spark, sf_dir):
    """The mixed tree as one nested JSON text."""
    return descent.nested_json(mixed_tree(spark, sf_dir))


@query()
def tree_printed(spark, sf_dir):
    """The mixed tree as indented lines."""
    return descent.printed(mixed_tree(spark, sf_dir))




NESTED = f"""{BASE}, p AS (SELECT 1 AS d, '' AS k, NULL AS up, attr, val FROM av UNION ALL SELECT 2, '/' || r, '', attr, val FROM av UNION ALL SELECT 3, '/' || l, '/' || r, attr, val FROM av),
c AS (SELECT d, k, any_value(up) AS up, attr, val, count(*) AS n FROM p GROUP BY d, k, attr, val), a AS (SELECT d, k, any_value(up) AS up, attr, '"' || attr || '":{{' || string_agg('"' || val || '":' || n, ',' ORDER BY val) || '}}' AS j, CAST(sum(n) AS BIGINT) AS size FROM c GROUP BY d, k, attr),
t AS (SELECT *, '{{"name":"Concept' || id || '","size":' || size || ',"counts":{{' || counts || '}},"children":[' AS head FROM (SELECT d, k, any_value(up) AS up, max(size) AS size, string_agg(j, ',' ORDER BY attr) AS counts, row_number() OVER (ORDER BY d, k) AS id FROM a GROUP BY d, k)),
b AS (SELECT up, string_agg(head || ']}}', ',' ORDER BY id) AS kids FROM t WHERE d = 3 GROUP BY up), m AS (SELECT string_agg(head || kids || ']}}', ',' ORDER BY t.id) AS kids FROM t JOIN b ON b.up = t.k WHERE d = 2)"""


@query(f"WITH {NESTED} SELECT head || kids || ']}}' AS json FROM t, m WHERE d = 1")
def tree_nested_nominal(spark, sf_dir):
    """The nominal tree as one nested JSON text."""
    return descent.nested_json(nominal_tree(spark, sf_dir)).select("json")


@query(f"WITH {NESTED} SELECT head || kids || ']}}' AS json FROM t, m WHERE d = 1")
def tree_sink(spark, sf_dir):
    """The same written by many tasks through the nested sink, and read back."""
    path = shared_path(spark, "nested")
    nested.write_nested(descent.nested_nodes(nominal_tree(spark, sf_dir)), path)
    return nested.read_nested(spark, path)


@query(f"WITH {NESTED}, q AS (SELECT d, k, id, max(size) AS size, '{{' || string_agg(j, ',' ORDER BY attr) || '}}' AS j FROM (SELECT a.d, a.k, t.id, a.size, a.attr, a.j FROM a JOIN t ON t.k = a.k AND t.d = a.d) GROUP BY ALL) SELECT repeat('  ', CAST(d - 1 AS INTEGER)) || '|-Concept' || id || ' (' || size || ') ' || j || ' {{}}' AS line FROM q")
def tree_printed_nominal(spark, sf_dir):
    """The nominal tree as indented lines."""
    return descent.printed(nominal_tree(spark, sf_dir)).select("line")
