"""The nested sink: many tasks, several trees, and what a failure leaves."""

import json
import random

import pytest
from pyspark.sql import functions as F

from taxaspark.operators import descent
from taxaspark.sources import nested


def test_trees_written_by_many_tasks(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(rnd.choice("ABCD"), rnd.choice("xyz"), rnd.choice("mn"), rnd.choice("12"), float(rnd.randrange(9))) for _ in range(300)]
    df = spark.createDataFrame(rows, "a string, b string, c string, s string, v double")
    trees = [descent.from_paths(df, levels, {"s": F.col("s")}, {"v": F.col("v")}, name) for levels, name in ((["a", "b", "c"], "one"), (["b"], "two"), ([], "three"), (["c", "a"], "four"))]
    every = trees[0]
    for t in trees[1:]:
        every = every.unionByName(t)
    every = every.persist()  # sums of floats depend on the order of rows
    path = f"file://{tmp_path}/out"
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        nested.write_nested(descent.nested_nodes(every), path)
        nested.write_nested(descent.nested_nodes(every), path)  # replaces what is there
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "out").glob("part-*.json"))) > 1
    text = "".join(f.read_text() for f in sorted((tmp_path / "out").glob("part-*.json")))
    want = {r["json"] for r in descent.nested_json(every).collect()}
    assert set(text.splitlines()) == want == {r["json"] for r in nested.read_nested(spark, path).collect()}
    assert all(json.loads(line)["size"] == 300 for line in text.splitlines())
    with pytest.raises(Exception):
        nested.write_nested(descent.nested_nodes(every), path, "append")
    assert set((tmp_path / "out").iterdir()) == {*(tmp_path / "out").glob("part-*"), tmp_path / "out" / "_SUCCESS"}


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    spark.dataSource.register(nested.NestedTrees)
    rows = spark.range(0, 40, 1, 4).select(F.when(F.col("id") == 37, F.raise_error(F.lit("lost")).cast("string")).otherwise("x").alias("piece"))
    with pytest.raises(Exception, match="lost"):
        rows.write.format(nested.FORMAT).option("path", f"file://{tmp_path}/out").mode("overwrite").save()
    assert not (tmp_path / "out").exists() or not list((tmp_path / "out").iterdir())
