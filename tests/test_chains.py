"""Pointer jumping: what its rounds send to the driver."""

from taxaspark.plans import chains


def test_rounds_broadcast_nothing(spark, monkeypatch):
    plans, stored = [], chains.stored
    monkeypatch.setattr(chains, "stored", lambda df, name: (plans.append(df._jdf.queryExecution().executedPlan().toString()), stored(df, name))[1])
    links = spark.createDataFrame([("a", 1, 2, 5), ("a", 2, 3, 6), ("a", 3, None, 7), ("b", 1, 9, 1), ("c", 1, 2, 1), ("c", 2, 1, 1)], "k string, id long, next long, w long")
    got = {(r["k"], r["id"]): (r["last"], r["after"], r["w"]) for r in chains.list_ranks(links, ["k"], ["w"]).collect()}
    assert [got["a", i] for i in (1, 2, 3)] == [(3, 2, 18), (3, 1, 13), (3, 0, 7)]
    assert [got[k][0] for k in (("b", 1), ("c", 1), ("c", 2))] == [None, None, None]
    assert len(plans) > 2 and not any("Broadcast" in p for p in plans)
