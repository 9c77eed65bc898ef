"""The pipeline's stages on a small corpus: what each decides takes effect."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, tmp_path):
    rnd = random.Random(7)
    words = [f"w{i}" for i in range(300)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    shared, twin = text(70), text(200)
    docs = [(i, text(100) + (" zogwat zogwat you zogwat" if i % 6 == 0 else ""), "en", f"s{i % 3}", 0) for i in range(240)]
    docs += [(1000, twin, "en", "s0", 0), (1001, twin, "en", "s1", 0), (1002, text(90) + shared, "en", "s0", 0), (1003, shared + text(90), "en", "s1", 0), (1004, text(60) + " a.b@c.org", "en", "s0", 0), (1005, None, None, None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        now = corpus_pipeline.stored(stage(spark, now, str(tmp_path)), name)
        seen.append(now)
    toxic, near, cut, private, packed = seen
    assert sorted(r["doc_id"] for r in toxic.collect()) == sorted(d[0] for d in docs if not (d[0] < 1000 and d[0] % 6 == 0))
    assert {r["doc_id"] for r in toxic.collect()} - {r["doc_id"] for r in near.collect()} == {1001}
    by_id = {r["doc_id"]: r for r in cut.collect()}
    assert shared not in by_id[1002]["text"] and by_id[1002]["text"] == docs[-4][1][: -len(shared)].rstrip(" ") + ("" if docs[-4][1][: -len(shared)].rstrip(" ") == docs[-4][1][: -len(shared)] else " ")
    assert by_id[1002]["n_chars"] == len(by_id[1002]["text"])
    assert all("a.b@c.org" not in (r["text"] or "") for r in private.collect())
    assert private.columns == now.columns or private.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r["doc_id"] for r in packed.collect()} == set(by_id)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == packed.count()


def test_stages_take_empty_tables_repeats_and_other_columns(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_removed string, score int, `__node` string"
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None, None, None, None, "a", 1, "n"), (None, "", "en", "s", 0, "b", 2, "n"), (2, "one two", "en", "s", 7, "c", 3, "n"), (2, "one two", "en", "s", 7, "c", 3, "n"), (None, long, "en", "s", len(long), "d", 4, "n")]
    for data in ([], rows):
        docs = spark.createDataFrame(data, schema)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            n = len(out.collect())
            assert (n > 0) == (len(data) > 0)
            if name != "packing":
                assert out.columns == docs.columns
            if name in ("toxicity", "repeats", "pii"):
                assert n == len(data)
                assert sorted(r["n_removed"] for r in out.collect()) == sorted(r[5] for r in data)
            if name == "near_duplicates" and data:
                assert n == 3
