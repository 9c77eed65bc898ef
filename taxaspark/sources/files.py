"""Instances from files and generators, and trees to files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Schemas of well-known instance files, one JSON object a line inside one array.
SCHEMAS = {
    "iris": "class string, `petal length` double, `petal width` double, `sepal length` double, `sepal width` double",
    "forest_fires": "month string, day string, DC double, DMC double, FFMC double, ISI double, RH double, area double, rain double, temp double, wind double, `x-axis` double, `y-axis` double",
    "towers": "_guid string, _human_cluster_label string, success string",
}
#: Generated animals: the length of a body, and of each part in units of it; a part's radius in units of its length.
BODIES = {"badger": 60.0, "boar": 110.0, "camel": 210.0, "hare": 40.0}
PROPORTIONS = {"torso": (1.0, 0.3), "neck": (0.35, 0.25), "head": (0.3, 0.4), "tail": (0.25, 0.08), "leg": (0.6, 0.1)}
#: How far a draw lies from its middle at most, in units of the middle; textures are between 0 and 1.
VARIATION = 0.2
#: Where a part is attached (along, across and up, in units of the body), and the direction in which it points.
PLACES = {"torso": (0.0, 0.0, 0.6), "leg1": (0.4, 0.15, 0.3), "leg2": (0.4, -0.15, 0.3), "leg3": (-0.4, 0.15, 0.3), "leg4": (-0.4, -0.15, 0.3), "neck": (0.5, 0.0, 0.8), "head": (0.7, 0.0, 1.0), "tail": (-0.5, 0.0, 0.6)}
AXES = {"torso": (1.0, 0.0, 0.0), "leg": (0.0, 0.0, -1.0), "neck": (0.6, 0.0, 0.8), "head": (1.0, 0.0, 0.0), "tail": (-0.8, 0.0, -0.6)}


def json_lines(spark: SparkSession, path: str, schema: str, limit: int | None = None) -> DataFrame:
    """Objects of a file with one object a line inside one array; exactly ``limit`` of them if given."""
    lines = spark.read.text(path).select(F.regexp_replace(F.trim("value"), r"^\[|[,\]]+$", "").alias("j")).filter("j <> ''")
    rows = lines.select(F.from_json("j", schema).alias("r")).select("r.*")
    return rows.limit(limit) if limit is not None else rows


def variant_lines(spark: SparkSession, path: str) -> DataFrame:
    """The same for objects of any shape: one ``variant`` column."""
    lines = spark.read.text(path).select(F.regexp_replace(F.trim("value"), r"^\[|[,\]]+$", "").alias("j")).filter("j <> ''")
    return lines.select(F.parse_json("j").alias("instance"))


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "line")


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """Human predictions with a header: user_id, instance_guid, time, order, prediction, correctness."""
    return spark.read.csv(path, header=True)


def _around(middle: Column, seed: int) -> Column:
    """A draw around ``middle``, dense there: the mean of three uniform ones within ``VARIATION`` of it."""
    return middle * (1 + VARIATION * ((F.rand(seed) + F.rand(seed + 1) + F.rand(seed + 2)) / 1.5 - 1))


def animals(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    """``n`` generated four-legged animals: id, _type, and a struct for each part (torso, legs, neck, head, tail)."""
    kinds = F.create_map(*[F.lit(x) for kind in BODIES.items() for x in kind])
    df = spark.range(n).withColumn("_type", F.get(F.array(*[F.lit(s) for s in BODIES]), F.floor(F.rand(seed) * len(BODIES)).cast("int")))
    df = df.withColumn("body", _around(F.element_at(kinds, F.col("_type")), seed + 1))
    for i, (part, place) in enumerate(PLACES.items()):
        kind = "leg" if part.startswith("leg") else part
        length, thickness = PROPORTIONS[kind]
        height, radius = (_around(F.col("body") * x, seed + 10 * i + j) for j, x in ((100, length), (103, length * thickness)))
        where = [(F.col("body") * x).alias(f"location{c}") for c, x in zip("XYZ", place)]
        axis = [F.lit(x).alias(f"axis{c}") for c, x in zip("XYZ", AXES[kind])]
        df = df.withColumn(part, F.struct(F.lit(kind).alias("_type"), *where, *axis, height.alias("height"), radius.alias("radius"), F.rand(seed + 10 * i + 106).alias("texture")))
    return df.drop("body")


def write_tree(nodes: DataFrame, path: str) -> None:
    """Concepts (``node_json`` rows) as JSON text, one a line, in the order of the tree."""
    nodes.select(F.to_json(F.struct("tree", "concept", "parent", "depth", "json")).alias("value")).write.text(path)
