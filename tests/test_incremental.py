"""Tables kept from streams across failures, and unification at its edges."""

import pytest
from pyspark.sql import functions as F

from taxaspark.plans import measures, unify
from taxaspark.streaming.tables import keep_tables, kept_counts, kept_moments


def test_tables_survive_a_failure_in_the_middle(spark, tmp_path, monkeypatch):
    rows = [(i, "xyz"[i % 3], a, None if a == "v" else str(i % 4), float(i) if a == "v" else None) for i in range(200) for a in ("s", "v")]
    schema = "inst long, k string, attr string, sval string, nval double"
    files, path = f"file://{tmp_path}/in", f"file://{tmp_path}/kept"
    for part in range(4):
        spark.createDataFrame(rows[part::4], schema).coalesce(1).write.mode("append").parquet(files)
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(files)
    calls, numbers = [], measures.numbers

    def failing(batch, keys):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("lost")
        return numbers(batch, keys)

    monkeypatch.setattr(measures, "numbers", failing)
    with pytest.raises(Exception, match="lost"):
        keep_tables(stream(), ["k"], path).awaitTermination()
    keep_tables(stream(), ["k"], path).awaitTermination()
    spark.createDataFrame([(900, "x", "s", "9", None)], schema).coalesce(1).write.mode("append").parquet(files)
    keep_tables(stream(), ["k"], path).awaitTermination()
    keep_tables(stream(), ["k"], path).awaitTermination()  # nothing new
    whole = spark.createDataFrame([*rows, (900, "x", "s", "9", None)], schema)
    key = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert key(kept_counts(spark, ["k"], path)) == key(measures.counts(whole, ["k"]).select("k", "attr", "val", "n"))
    got = {r["k"]: r for r in kept_moments(spark, ["k"], path).collect()}
    for r in numbers(whole, ["k"]).collect():
        assert (got[r["k"]]["num"], got[r["k"]]["mean"], got[r["k"]]["m2"]) == (r["num"], pytest.approx(r["mean"]), pytest.approx(r["m2"]))


def test_what_unifies(spark):
    cases = [
        ('["<",["a","?o2"],["a","?o1"]]', '["<",["a","?c2"],["b","?c1"]]', {"?o1": "?c1"}, None),
        ('["<",["a","?o2"],["a","?o1"]]', '["<",["a","?c2"],["a","?c1"]]', {"?o1": "?c1"}, True),
        ('["<",["a","?o2"],["a","?o1"]]', '["<",["a","?c2"],["a","?c1"]]', {"?o1": "?c1", "?o2": "?c2"}, True),
        ('["<",["a","?o2"],["a","?o1"]]', '["<",["a","?c2"],["a","?c1"]]', {"?o1": "?c2"}, None),
        ('["r","?o1","?o1"]', '["r","?c1","?c2"]', {}, False),
        ('["r","?o1","?o2"]', '["r","?c1","?c1"]', {}, False),
        ('["r","?o1",["s","?o1"]]', '["r","?c1",["s","?c1"]]', {}, True),
        ('["r","?o1"]', '["r","x"]', {}, None),
        ('["r","x"]', '["r","x"]', {}, True),
        ('["r","?o1"]', '["r","?c1","?c2"]', {}, None),
        ("?o1", "?c1", {}, True),
        ("a", "a", {}, True),
        ("a", "?c1", {}, None),
    ]
    for i, (attr, base, mapping, want) in enumerate(cases):
        maps = spark.createDataFrame([(i, a, b) for a, b in mapping.items()], "inst long, old string, new string")
        got = unify.partial_matches(spark.createDataFrame([(i, attr)], "inst long, attr string"), spark.createDataFrame([(1, base)], "concept long, attr string"), maps).collect()
        assert [r["consistent"] for r in got] == ([] if want is None else [want]), attr
    has = spark.createDataFrame([('["relation","?c2",["a","?c1"]]', "?c1"), ('["before","?c1","?c2"]', "?c3"), ("?c1", "?c1"), ("c", "?c1")], "a string, n string")
    assert [r[0] for r in has.select(unify.contains_component(F.col("a"), F.col("n"))).collect()] == [True, False, True, False]


def test_matches_of_many_concepts_come_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(unify, "BLOCK", 3)
    target = spark.createDataFrame([(i, f'["r","?o1","{"?o1" if i % 3 else "?o2"}"]') for i in range(40)], "inst long, attr string")
    base = spark.createDataFrame([(c if c % 7 else None, f'["r","?c1","{"?c1" if c % 2 else "?c2"}"]') for c in range(30)], "concept long, attr string")
    got = unify.partial_matches(target, base)
    want = [(i, c if c % 7 else None, bool(i % 3) == bool(c % 2)) for i in range(40) for c in range(30)]
    key = lambda x: (x[0], x[1] is not None, x[1] or 0, x[2])
    assert sorted(map(tuple, got.select("inst", "concept", "consistent").collect()), key=key) == sorted(want, key=key)
