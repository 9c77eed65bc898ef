"""Near-duplicates of the pipeline's stage against brute force."""

import random

import pytest

from taxaspark.llm import resemblance, simhash

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def similarity(a, b):
    def grams(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def brute(rows):
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if group[i] != group[j] and similarity(rows[i][1], rows[j][1]) >= 0.8:
                group = [group[j] if g == group[i] else g for g in group]
    best = {}
    for g, r in zip(group, rows):
        key = (r[0] is None, r[0] or 0, r[1] is not None, r[1] or "")
        best[g] = min(best.get(g, (key, r)), (key, r), key=lambda x: x[0])
    return sorted((r[:2] for _, r in best.values()), key=str)


@pytest.mark.parametrize("block", [3, 1024])
def test_near_copies_go(spark, block, monkeypatch):
    monkeypatch.setattr(resemblance, "BLOCK_ROWS", block)
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for k in range(12):
        base = [rnd.choice(words) for _ in range(150)]
        rows.append((len(rows), " ".join(base)))
        for changed in range(1, 7):
            copy = list(base)
            for at in rnd.sample(range(5, 140), changed):
                copy[at] = "changed"
            rows.append((len(rows), " ".join(copy)))
    rows += [(None, "one two three"), (None, "four five six"), (None, "four  FIVE six"), (3, "seven eight"), (3, "nine ten"), (500, None), (501, " "), (502, ""), rows[0]]
    docs = spark.createDataFrame([(*r, "en", "s", 0) for r in rows], SCHEMA).repartition(3)
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == brute(rows)
    assert corpus_pipeline.drop_near_duplicates(spark, docs.limit(0), "").count() == 0


def test_keys_find_pairs_at_the_threshold():
    rnd = random.Random(1)
    for _ in range(200):
        common = [str(rnd.random()) for _ in range(160)]
        a, b = (resemblance.np.unique([resemblance.xxhash.xxh64_intdigest(x) for x in common + [str(rnd.random()) for _ in range(20)]]).astype("uint64") for _ in range(2))
        assert set(resemblance.keys(a)) & set(resemblance.keys(b))


@pytest.mark.parametrize("keep_one", [simhash.keep_one, resemblance.keep_one])
def test_null_and_repeated_ids_keep_unrelated_texts(spark, keep_one):
    rnd = random.Random(5)
    text = lambda: " ".join(str(rnd.random()) for _ in range(60))
    a, b, c, d, e = (text() for _ in range(5))
    rows = [(None, a), (None, b), (None, b), (None, c), (7, d), (7, e), (8, e), (3, c)]
    docs = spark.createDataFrame([(*r, "en", "s", 0) for r in rows], SCHEMA)
    got = sorted(((r["doc_id"], r["text"]) for r in keep_one(docs).collect()), key=str)
    assert got == sorted([(None, a), (None, b), (3, c), (7, d), (7, e)], key=str)


def test_close_fingerprints_are_candidates_without_a_common_key(spark):
    rows = [(5, [1], 0b1111), (3, [2], 0b0011), (9, [3], -1), (7, [4], 0b0011), (1, [], 0b0011), (8, [5], 1 << 40)]
    classes = spark.createDataFrame(rows, "__node long, __keys array<long>, __print long")
    assert sorted(map(tuple, resemblance.candidates(classes).select("node", "root").collect())) == [(3, 3), (5, 3), (7, 3), (8, 3)]
    far = spark.createDataFrame([(1, [1], 0), (2, [2], 0b11111)], "__node long, __keys array<long>, __print long")
    assert resemblance.candidates(far).isEmpty()


def test_stage_takes_fingerprints_of_the_shingles(spark):
    text = " ".join(f"w{i % 31}" for i in range(70))
    r = resemblance._marked(spark.createDataFrame([(1, text, "e", "s", 1), (2, None, "e", "s", 0)], SCHEMA), 5).orderBy("doc_id").collect()
    assert r[0]["__print"] % (1 << 64) == simhash.majority(resemblance.shingles(text)) and r[1]["__print"] == 0


def test_exploded_keys_are_never_broadcast(spark, monkeypatch):
    monkeypatch.setattr(resemblance, "components", lambda links: links)
    monkeypatch.setattr(resemblance, "discard", lambda *tables: None)
    monkeypatch.setattr(simhash, "links", lambda classes: classes.select(classes["fp"].alias("a"), classes["fp"].alias("b")))
    classes = spark.range(50).selectExpr("id AS __node", "array(id % 5, id) AS __keys", "id AS __print")
    plan = resemblance.candidates(classes)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("SortMergeJoin") == 1
