"""Structured records, chains and cuts against brute force, at their edges."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from taxaspark.functions.moments import c4_value
from taxaspark.operators import descent, structured
from taxaspark.plans import chains, records, transforms

AV = "inst long, attr string, sval string, nval double"


def std(values):
    n = len(values)
    m = sum(values) / n
    return 0.0 if n < 2 else math.sqrt(sum((v - m) ** 2 for v in values) / (n - 1)) / c4_value(n)


def ecg(group):
    """Expected correct guesses of a list of instances (attribute -> value)."""
    n, attrs = len(group), {a for x in group for a in x if not a.startswith("_")}
    total = 0.0
    for a in attrs:
        held = [x[a] for x in group if a in x]
        names = [v for v in held if isinstance(v, str)]
        numbers = [v for v in held if not isinstance(v, str)]
        total += sum((names.count(v) / n) ** 2 for v in set(names))
        if numbers:
            total += (len(numbers) / n) ** 2 / (2 * math.sqrt(math.pi) * math.sqrt(std(numbers) ** 2 + 1 / (4 * math.pi)))
    return total / len(attrs)


def rename(x, mapping):
    def one(part):
        return [one(p) for p in part] if isinstance(part, list) else mapping.get(part, part)

    return {json.dumps(one(json.loads(a)), separators=(",", ":")) if a.startswith("[") else mapping.get(a, a): v for a, v in x.items()}


def sample(rnd, names):
    a, b, c = names
    x = {f'["kind","{a}"]': rnd.choice("pq"), f'["kind","{b}"]': rnd.choice("qrs"), f'["size","{b}"]': rnd.choice([1.0, 2.5, 4.0]), f'["on","{a}","{b}"]': "true", "colour": rnd.choice("uv"), f'["far",["of","{c}"]]': rnd.choice("xy"), "_hidden": "h"}
    return {k: v for k, v in x.items() if rnd.random() < 0.9}


@pytest.fixture(scope="module")
def case(spark):
    rnd = random.Random(4)
    base = [sample(rnd, ("?c1", "?c2", "?c3")) for _ in range(30)]
    probes = {i: sample(rnd, ("?o1", "?o2", "?o3")) for i in range(12)}
    rows = lambda xs: spark.createDataFrame([(i, a, v if isinstance(v, str) else None, None if isinstance(v, str) else v) for i, x in xs for a, v in x.items()], AV)
    from taxaspark.plans import measures

    av = rows(enumerate(base))
    return base, probes, structured.base_table(measures.counts(av, []), measures.numbers(av, [])), rows(probes.items())


def test_mapping_costs_equal_the_direct_form(case):
    base, probes, table, av = case
    got = {(r["inst"], r["var"], r["base"]): r["cost"] for r in structured.mapping_costs(av, table, len(base)).collect()}
    for i, x in probes.items():
        for var in {v for a in x for v in ("?o1", "?o2", "?o3") if f'"{v}"' in a}:
            for c in ("?c1", "?c2", "?c3", None):
                assert got.pop((i, var, c)) == pytest.approx(-ecg([*base, rename(x, {var: c} if c else {})]))
    assert not got


def test_mappings_are_as_good_as_any_single_change(case):
    base, probes, table, av = case
    rows, mapping = structured.mapped(av, table, len(base))
    maps = {}
    for r in mapping.collect():
        maps.setdefault(r["inst"], {})[r["old"]] = r["new"]
    named = {}
    for r in rows.collect():
        named.setdefault(r["inst"], {})[r["attr"]] = r["sval"] if r["sval"] is not None else r["nval"]
    for i, x in probes.items():
        m = maps.get(i, {})
        assert len(set(m.values())) == len(m) and named[i] == rename(x, m)
        now = ecg([*base, rename(x, m)])
        for var in ("?o1", "?o2", "?o3"):
            for c in {"?c1", "?c2", "?c3"} - set(m.values()):
                assert var in m or ecg([*base, rename(x, {**m, var: c})]) <= now + 1e-9


def test_deep_components_come_back(spark):
    deep = '["a",["?v5",["?v4",["?v3",["?v2","?v1"]]]]]'
    flat = spark.createDataFrame([(1, deep, "x", None), (1, '["b",["?v3",["?v2","?v1"]]]', None, 2.0), (2, "c", "y", None)], AV)
    back = transforms.embedded(transforms.subcomponents(flat, "inst"), "inst")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, flat.collect()), key=str)
    looped = spark.createDataFrame([(1, '["has-component","?a","?b"]', "true", None), (1, '["has-component","?b","?a"]', "true", None), (1, '["x","?a"]', "1", None)], AV)
    with pytest.raises(Exception, match="within itself"):
        transforms.embedded(looped, "inst").collect()


def test_chain_of_ten_thousand(spark):
    n = 10_000
    tree = spark.range(n).select(F.col("id").alias("concept"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"))
    rows = chains.tour(tree)
    assert rows.agg(F.sum(F.abs(F.col("depth") - F.col("concept"))), F.sum(F.abs(F.col("size") - (n - F.col("concept")))), F.count_distinct("root")).first() == (0, 0, 1)


def test_random_forest(spark):
    rnd = random.Random(8)
    parent = {(t, i): rnd.randrange(i) if i and rnd.random() > 0.05 else None for t in "ab" for i in range(200)}
    loose = [("a", 900, 901), ("a", 901, 900), ("b", 902, 903)]
    tree = spark.createDataFrame([(t, i, p) for (t, i), p in parent.items()] + loose, "t string, concept long, parent long")
    got = {(r["t"], r["concept"]): r for r in chains.tour(tree, ["t"]).collect()}

    def up(t, i):
        out = [i]
        while parent[t, out[-1]] is not None:
            out.append(parent[t, out[-1]])
        return out

    size = {}
    for t, i in parent:
        for a in up(t, i):
            size[t, a] = size.get((t, a), 0) + 1
    for (t, i) in parent:
        assert (got[t, i]["depth"], got[t, i]["size"], got[t, i]["root"]) == (len(up(t, i)) - 1, size[t, i], up(t, i)[-1])
    assert all(got[t, i]["depth"] is None for t, i, _ in loose)
    pairs = [(t, rnd.randrange(200), rnd.randrange(200)) for t in "ab" for _ in range(300)]
    below = chains.lies_below(spark.createDataFrame(pairs, "t string, upper long, lower long"), chains.tour(tree, ["t"]), ["t"]).collect()
    assert all(r["below"] == (r["upper"] in up(r["t"], r["lower"])) for r in below)


def test_long_list_and_orders_that_are_none(spark):
    n = 100_000
    long = spark.range(n).select(F.lit("long").alias("l"), F.xxhash64("id").alias("a"), F.xxhash64(F.col("id") + 1).alias("b"), "id")
    has = long.select("l", F.lit("has-element").alias("relation"), "a", F.lit(None).cast("long").alias("b"))
    order = long.filter(F.col("id") < n - 1).select("l", F.lit("ordered-list").alias("relation"), "a", "b")
    odd = [("fork", [1, 2, 3], [(1, 2), (1, 3)]), ("join", [1, 2, 3], [(1, 3), (2, 3)]), ("ring", [1, 2], [(1, 2), (2, 1)]), ("two", [1, 2, 3], [(1, 2)]), ("lasso", [1, 2, 3], [(2, 3), (3, 2)]), ("other", [1, 2], [(1, 2), (2, 9)]), ("fine", [5, 3, 9], [(3, 5), (5, 9)]), ("one", [7], [])]
    rows = [(l, "has-element", e, None) for l, es, _ in odd for e in es] + [(l, "ordered-list", a, b) for l, _, ps in odd for a, b in ps]
    got = chains.list_places(has.unionByName(order).unionByName(spark.createDataFrame(rows, "l string, relation string, a long, b long")), ["l"])
    small = sorted((r["l"], r["position"], r["element"]) for r in got.filter("l <> 'long'").collect())
    assert small == [("fine", 0, 3), ("fine", 1, 5), ("fine", 2, 9), ("one", 0, 7)]
    check = got.filter("l = 'long'").agg(F.count(F.lit(1)), F.count_if(F.col("element") != F.xxhash64("position"))).first()
    assert check == (n, 0)


def test_records_of_any_shape(spark):
    texts = ['{"a":1,"c":{"b":"x","_h":true}}', '{"l1":{"l2":{"l3":{"l4":1.5}}},"n":null,"e":{},"q\\"k":{"z":[1,{"y":2}]}}', "3", "no json", None, '{"":1,"[\\"r\\",\\"\\"]":"v","[broken":1}']
    df = spark.createDataFrame(list(enumerate(texts)), "id long, record string")
    got = sorted((r["id"], r["attr"], r["sval"], r["nval"]) for r in records.flatten_records(df, "id", "record").collect())
    want = [(0, "a", None, 1.0), (0, '["b","c"]', "x", None), (0, '["_",["_h","c"]]', "true", None), (1, '["l4",["l3",["l2","l1"]]]', None, 1.5), (1, '["z","q\\"k"]', '[1,{"y":2}]', None), (5, "", None, 1.0), (5, '["r",""]', "v", None), (5, "[broken", None, 1.0)]
    assert sorted(got, key=str) == sorted(want, key=str)
    found = sorted((tuple(r) for r in records.faults(df, "id", "record").collect()), key=str)
    assert found == sorted([(1, "n", "none"), (1, '["z","q\\"k"]', "value"), (2, None, "record"), (3, None, "record"), (4, None, "record"), (5, "", "name"), (5, '["r",""]', "part"), (5, "[broken", "part")], key=str)
    with pytest.raises(ValueError, match="instance 1"):
        records.sound(df, "id", "record")
    assert records.sound(df.limit(1), "id", "record").count() == 1 and records.flatten_records(df.limit(0), "id", "record").count() == 0


def test_searches_by_each_heuristic_as_brute_force(spark):
    rnd = random.Random(6)
    data = [(rnd.choice("AB"), rnd.choice("xyz"), rnd.choice("mn"), rnd.choice("12"), rnd.choice("345"), rnd.gauss(0, 2)) for _ in range(160)]
    df = spark.createDataFrame(data, "a string, b string, c string, s string, t string, v double")
    tree = descent.from_paths(df, ["a", "b", "c"], {"s": F.col("s"), "t": F.col("t")}, {"v": F.col("v")}).persist()
    weight = {r["concept"]: r for r in descent.cut_weights(tree).collect()}
    kids = {}
    for r in weight.values():
        kids.setdefault(r["parent"], []).append(r["concept"])
    root = kids[None][0]
    n = weight[root]["n"]

    def score(cut, h):
        w, ll, p = (sum(weight[c][x] for c in cut) for x in "wlp")
        if h == "cu":
            return -(w - weight[root]["w"]) / (n * len(cut))
        aic = 2 * p - 2 * ll
        return {"aic": aic, "aicc": float("inf") if n - p <= 1 else aic + 2 * p * (p + 1) / (n - p - 1), "bic": p * math.log(n) - 2 * ll}[h]

    for h in descent.HEURISTICS:
        cut, want = list(kids[root]), []
        want.append((1, root, score(cut, h)))
        while len(want) < 7:
            options = [(round(score([k for k in cut if k != c] + kids[c], h), 12), c) for c in cut if c in kids]
            if not options:
                break
            s, c = min(options)
            cut = [k for k in cut if k != c] + kids[c]
            want.append((len(want) + 1, c, s))
        got = sorted((r["opened"], r["node"], r["score"]) for r in descent.openings(tree, 7, heuristic=h).collect())
        assert [g[:2] for g in got] == [x[:2] for x in want]
        assert [g[2] for g in got] == pytest.approx([x[2] if h != "cu" else -x[2] for x in want])
    with pytest.raises(ValueError, match="heuristic"):
        descent.openings(tree, 2, heuristic="none")
