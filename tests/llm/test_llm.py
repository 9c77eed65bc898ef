"""The operators against brute force, on small tables with nulls, empty and long texts, repeats and extra columns."""

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from taxaspark.llm import bytebpe, chat, common, neighbours, packing, pii, quality, repeats, simhash, tokenfile, toxicity
from taxaspark.llm.encoding import WordEncoder

PII_KEY = "of the tests"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, ranges string, n long"
WORDS = "the a of and river stone light over under quick brown fox jumps lazy dog walks home early morning cloud été naïve".split()


def corpus():
    rnd = random.Random(4)
    text = lambda n: " ".join(rnd.choice(WORDS) for _ in range(n))
    shared, long = text(60), text(4000)
    near = text(120).split()
    docs = [None, "", " ", "one", text(80), text(80) + "\n" + shared, shared + " " + text(50), long, long, "x" * 700, "a\tb  c\n\n d", text(30) + " mail bob.lee@example.com or +1 (415) 555-0199, card 4111 1111 1111 1111"]
    for k in range(4):
        copy = list(near)
        copy[10 * k] = "changed"
        docs.append(" ".join(copy))
    rows = [(i, t, ["en", "fr", None][i % 3], ["s0", "s1", None][i % 3], len(t or ""), "f", "r", 1) for i, t in enumerate(docs)]
    return [*rows, rows[4], (None, "no id", "en", "s0", 5, "f", "r", 1), (99, docs[4], "en", "s0", 5, "f", "r", 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def whole_ids(name, texts):
    """Ids by the library alone, as the contract calls it."""
    fresh = Tokenizer.from_file(public_tokenizers.path(name))
    return [np.array(e.ids, "<u4") for e in fresh.encode_batch(texts, add_special_tokens=False)]


SPECIAL = ["a <|endoftext|> b", "<|startoftext|>x", "A<|ENDOFTEXT|>"]


@pytest.mark.parametrize("name,joins", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_words_encode_as_whole_texts(name, joins):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice([" ", "\n", "a", "B1", "é", "'s", "\t", "!", "  ", "\n\n", " ", "́", "Σ", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "x" * 50]) for _ in range(rnd.randint(0, 12))) for _ in range(2000)] + SPECIAL
    e = WordEncoder(public_tokenizers.path(name), joins, limit=200)
    assert e.encode(texts) == [i.tobytes() for i in whole_ids(name, texts)]
    assert len(e.memo) <= 200 and all(len(x) <= 40 for x in e.memo)


def test_new_words_go_to_the_library_together():
    name = "word_bpe_49k.json"
    e = WordEncoder(public_tokenizers.path(name), False)
    texts = [" ".join(f"w{i}x{j}'s" for j in range(100)) for i in range(20)] + ["a\x01b \x01 c", "w0x0's a\tb  w0x1's", "\x1c a\x1cb", "a\x85b \x01", "", " \n "]
    given, library = [], e.tokenizer
    e.tokenizer = type("Counted", (), {"encode_batch_fast": lambda self, t, **k: given.append(len(t)) or library.encode_batch_fast(t, **k)})()
    assert e.encode(texts[:20]) + e.encode(texts[20:]) + e.encode(texts) == [i.tobytes() for i in whole_ids(name, texts + texts)]
    assert given[0] <= 2000 / 16


def test_token_files(spark, empty, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [*corpus(), *[(200 + i, t, "en", "s", 0, "", "", 0) for i, t in enumerate(SPECIAL)], (-1, "minus one", "en", "s", 0, "", "", 0), (300, "Σ" * 90_000, "en", "s", 0, "", "", 0), (301, " ".join(["word"] * 70_000), "en", "s", 0, "", "", 0)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    manifest = tokenfile.write_tokens(df, path, 2, f"file://{tmp_path}/t", shards=3).persist()
    got = tokenfile.read_tokens(manifest).orderBy("start").collect()
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start = 0
    for r, g, ids in zip(rows, got, whole_ids("byte_bpe_50k.json", [r[1] or "" for r in rows]), strict=True):
        ids = ids.tobytes() + np.array([2], "<u4").tobytes()
        assert (g["doc_id"], g["start"], g["n_tokens"], g["ids_crc32"], bytes(g["ids"])) == (r[0], start, len(ids) // 4, zlib.crc32(ids), ids)
        start += len(ids) // 4
    some = tokenfile.fetch_tokens(manifest, spark.createDataFrame([(7,), (3,), (-1,), (12345,)], "doc_id long")).collect()
    assert sorted(r["doc_id"] for r in some) == [-1, 3, 7]
    assert tokenfile.read_tokens(tokenfile.write_tokens(empty, path, 2)).count() == 0
    one = sorted((tmp_path / "t").iterdir())[0]
    data = bytearray(one.read_bytes())
    data[12] ^= 255
    one.write_bytes(bytes(data))
    with pytest.raises(Exception):
        list(tokenfile.ShardReader(f"file://{one}").documents())


def test_ids_that_do_not_fit_are_an_error(tmp_path):
    writer = tokenfile.ShardWriter(f"file://{tmp_path}/x", "0", width=2)
    with pytest.raises(ValueError):
        writer.add(1, np.array([65_536], "<u4").tobytes())


def brute_round_robin(rows, weights, size):
    """Rows in the order in which round-robin serves them, played round by round."""
    queues = collections.defaultdict(collections.deque)
    for r in sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["h"])):
        queues[r["source"]].append(r)
    out, deficit, turn = [], collections.Counter(), 0
    total = sum(weights[s] for s in queues)
    while any(queues.values()):
        turn += 1
        for s in sorted(queues):
            deficit[s] += weights[s] * size / total
            while queues[s] and queues[s][0]["n"] <= deficit[s] + 1e-9:
                r = queues[s].popleft()
                deficit[s] -= r["n"]
                out.append((turn, r))
    return out


@pytest.mark.parametrize("flatten,weights", [(0.7, None), (1.0, None), (None, {"s0": 3, "s1": 1, "": 2, "s": 1})])
def test_packing(spark, empty, flatten, weights):
    name, size = "word_bpe_49k.json", 64
    rows = [*corpus(), *[(200 + i, t, "en", "s", 0, "", "", 0) for i, t in enumerate(SPECIAL)]]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    path = public_tokenizers.path(name)
    pieces = packing.pack(df, path, 1, weights, size=size, parts=3, **({"flatten": flatten} if flatten else {})).collect()
    ids = [np.append(i, 1).astype("<u4") for i in whole_ids(name, [r[1] or "" for r in rows])]
    signed = lambda t: xxhash.xxh64_intdigest(t.encode(), 42)
    held = [{"doc_id": r[0], "source": r[3] or "", "h": (h := signed(r[1] or "")) - (1 << 64 if h >> 63 else 0), "n": len(i), "ids": i} for r, i in zip(rows, ids)]
    tokens = collections.Counter()
    for h in held:
        tokens[h["source"]] += h["n"]
    want, at = [], 0
    for turn, r in brute_round_robin(held, weights or {s: n**flatten for s, n in tokens.items()}, size):
        done = 0
        while done < r["n"]:
            w, offset = divmod(at + done, size)
            take = min(size - offset, r["n"] - done)
            want.append((w, offset, take, r["doc_id"], done, zlib.crc32(r["ids"][done : done + take].tobytes()), r["n"], r["source"], turn))
            done += take
        at += r["n"]
    got = [(p["sequence_id"], p["offset"], p["length"], p["doc_id"], p["start"], p["ids_crc32"], p["doc_tokens"], p["source"], p["round"]) for p in pieces]
    assert sorted(got, key=str) == sorted(want, key=str)
    last = (at - 1) // size
    assert all(p["padded_to"] == size or p["sequence_id"] == last and p["padded_to"] & (p["padded_to"] - 1) == 0 for p in pieces)
    assert packing.pack(empty, path, 1).count() == 0


def test_sources_without_a_weight_come_last(spark, docs):
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), 1, {"s1": 5}, size=64).collect()
    first = {p["source"] for p in pieces if p["sequence_id"] < 1}
    assert first == {"s1"} and {p["source"] for p in pieces} == {"", "s0", "s1"}


def test_windows_keep_to_the_shares(spark):
    rnd = random.Random(3)
    text = lambda: " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(1, 40)))
    rows = [(i, text(), None, f"s{min(i % 7, 2)}", 0, "", "", 0) for i in range(900)]
    share = {"s0": 5, "s1": 3, "s2": 2}
    pieces = packing.pack(spark.createDataFrame(rows, SCHEMA), public_tokenizers.path("word_bpe_49k.json"), 1, share, size=128).collect()
    dry = min(max(p["sequence_id"] for p in pieces if p["source"] == s) for s in share)
    for upto in range(1, dry, 5):
        for s, w in share.items():
            served = sum(p["length"] for p in pieces if p["source"] == s and p["sequence_id"] < upto)
            assert abs(served - upto * 128 * w / 10) < 400
    assert all(0 <= p["deficit"] for p in pieces)
    assert max(collections.Counter(p["doc_id"] for p in pieces).values()) <= 2


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]).encode(), 42) for k in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def brute_components(ids, fps):
    parent = list(range(len(fps)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    low = {}
    for i, d in enumerate(ids):
        if d is not None:
            low[root(i)] = min(low.get(root(i), d), d)
    return [low.get(root(i)) for i in range(len(ids))]


def test_simhash(docs, empty):
    rows = corpus()
    fps = [brute_fingerprint(r[1] or "") for r in rows]
    want = sorted(((r[0], f"{f:016x}", c) for r, f, c in zip(rows, fps, brute_components([r[0] for r in rows], fps))), key=str)
    assert sorted((tuple(r) for r in simhash.near_duplicates(docs).collect()), key=str) == want
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.filter("doc_id is not null").collect()) == sorted({c for _, _, c in want if c is not None})


def test_dense_files_of_fingerprints_are_dealt_to_block_pairs(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 8)
    rnd = random.Random(8)
    base = rnd.getrandbits(64)
    fps = list({base ^ sum(1 << b for b in rnd.sample(range(12), rnd.randint(0, 6))) for _ in range(60)} | {rnd.getrandbits(64) for _ in range(20)} | {0})
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    links = [(a % (1 << 64), b % (1 << 64)) for a, b in (tuple(r) for r in simhash.links(df).collect())]
    assert all((a ^ b).bit_count() <= 4 for a, b in links)
    want = brute_components(list(range(len(fps))), fps)
    place = {f: i for i, f in enumerate(fps)}
    parent = list(range(len(fps)))
    for _ in fps:
        for a, b in links:
            parent[place[a]] = parent[place[b]] = min(parent[place[a]], parent[place[b]])
    assert parent == want


def test_toxicity(spark, docs, empty):
    rnd = random.Random(3)
    clean = lambda: " ".join(rnd.choice(WORDS) for _ in range(60))
    rows = [(i, clean() + (" what a zogwat you are zogwat" if i % 5 == 0 else ""), i % 5 == 0) for i in range(300)]
    text = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(y)) for i, _, y in rows] + [(None, 1), (5, None), (0, 1)], "doc_id long, toxic int")
    model = toxicity.train(text, labels)
    got = {r["doc_id"]: r for r in toxicity.score(text, model).collect()}
    for i, _, y in rows:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and got[i]["predicted"] == int(y)
    edge = toxicity.score(docs, model)
    assert edge.count() == docs.count() and edge.filter("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.score(empty, model).count() == 0 and toxicity.keep(docs, model).columns == docs.columns
    none = toxicity.train(text, labels.limit(0))
    assert {r["score"] for r in toxicity.score(text, none).collect()} == {0.5}
    swapped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert np.allclose(toxicity.train(text, swapped).weights, model.weights)


def test_toxicity_sends_the_driver_features_alone(spark, monkeypatch):
    rows = [(i, f"text number {i} " + ("vile words " if i % 4 == 0 else "kind words ") * 3) for i in range(400)]
    text = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    kind, sent = type(text), []
    whole = kind.toArrow
    monkeypatch.setattr(kind, "toPandas", lambda self: pytest.fail("rows as Python objects"))
    monkeypatch.setattr(kind, "toArrow", lambda self: sent.append(whole(self)) or sent[-1])
    model = toxicity.train(text, labels, features=16)
    assert [t.num_rows for t in sent] == [16, sum(zlib.crc32(str(i).encode()) % 3 != 1 for i, _ in rows)]
    assert model.score(rows[0][1]) > 0.7 > model.score(rows[1][1])
    rnd = np.random.default_rng(1)
    lengths = rnd.integers(0, 9, 200)
    given = lengths, rnd.integers(0, 50, lengths.sum()), rnd.random(50), rnd.integers(0, 2, 200), rnd.random(200), 1e-4
    one = toxicity._logistic(*given)
    monkeypatch.setattr(toxicity, "AT_ONCE", 7)
    many = toxicity._logistic(*given)
    assert np.allclose(one[0], many[0]) and np.isclose(one[1], many[1])


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 24)).astype("float32")
    x[50:90] = x[50]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(1000, None), (1001, [0.0] * 24), (1002, [float("nan")] + [1.0] * 23), (1003, [None] + [1.0] * 23), (None, [1.0] * 24)]
    v = neighbours.valid(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert v.count() == 400
    got = collections.defaultdict(list)
    for r in neighbours.nearest(v, v.filter("vec_id % 10 = 0"), lists=8, probes=8).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    hit = 0
    for q in range(0, 400, 10):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        want = [i for i in np.lexsort((np.arange(400), d)) if i != q][:10]
        hit += len({i for i, _ in got[q]} & set(want))
        assert len(got[q]) == 10 and all(s == pytest.approx(d[i], abs=1e-12) for i, s in got[q])
        if 50 <= q < 90:
            assert [i for i, _ in got[q]] == want
    assert hit >= 0.95 * 400
    odd = spark.createDataFrame([(5000, [1.0, 2.0]), *[(i, [float(c) for c in x[i]]) for i in range(4)]], "vec_id long, embedding array<float>")
    assert neighbours.valid(odd.withColumn("score", F.lit("x"))).count() == 4
    few = v.filter("vec_id < 4")
    assert neighbours.nearest(few, few.filter("vec_id = 0")).count() == 3
    assert neighbours.nearest(v.limit(0), v.limit(0)).count() == 0


@pytest.mark.parametrize("rows,dim,spread", [(300, 16, 1.0), (1500, 32, 1.0), (5000, 64, 1.0), (4000, 48, 0.05)])
def test_recall_with_the_registered_parameters(spark, rows, dim, spread):
    rng = np.random.default_rng(rows)
    x = rng.standard_normal((40, dim))[rng.integers(0, 40, rows)] * (1 - spread) + spread * rng.standard_normal((rows, dim))
    v = neighbours.valid(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>"))
    got = collections.defaultdict(set)
    for r in neighbours.nearest(v, v.filter("vec_id % 20 = 0")).collect():
        got[r["query_id"]].add(r["vec_id"])
    hit = 0
    for q in range(0, rows, 20):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hit += len(got[q] & set(np.argsort(d)[:10].tolist()))
    assert hit >= 0.9 * 10 * len(range(0, rows, 20))


@pytest.mark.parametrize("rows", [2000, 50_000])
def test_candidates_are_abandoned_and_recall_holds(rows):
    """With the registered parameters, on vectors that lie evenly on a sphere."""
    rng = np.random.default_rng(rows)
    x = rng.standard_normal((rows, 64))
    x /= np.sqrt((x**2).sum(1))[:, None]
    turn, ids = neighbours.rotation(64), np.arange(rows)
    turned = x @ turn
    blocks = [turned[:, a : a + neighbours.BLOCK] for a in range(0, 64, neighbours.BLOCK)]
    asked, picked = ids[::100][:60], rng.permutation(rows)[: min(rows, neighbours.SAMPLE)]
    bound = neighbours._sample_bounds(x[asked], asked, x[picked], picked, 10)
    i, j, abandoned = neighbours.survivors(blocks, turned[asked], bound)
    assert abandoned > 0.8 * rows * len(asked)
    hit = 0
    for n, q in enumerate(asked):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        near = np.argsort(d)[:10]
        assert np.sqrt(d[near[-1]]) <= bound[n] + 1e-12
        hit += len(set(near.tolist()) & set(i[j == n].tolist()))
    assert hit >= 0.99 * 10 * len(asked)


def test_queries_in_rounds(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((600, 20))
    v = neighbours.valid(spark.createDataFrame([(i % 590, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")).repartition(3)
    whole = neighbours.nearest(v, v.filter("vec_id % 20 = 1"), lists=5, probes=5).collect()
    monkeypatch.setattr(neighbours, "QUERIES", 7)
    monkeypatch.setattr(neighbours, "PAIRS", 50)
    assert sorted(neighbours.nearest(v, v.filter("vec_id % 20 = 1"), lists=5, probes=5).collect()) == sorted(whole)
    for q in sorted({r["query_id"] for r in whole}):
        d = {}
        for i in range(600):
            if i % 590 != q:
                for own in range(q, 600, 590):  # a query's rows count as one
                    d[i % 590] = min(d.get(i % 590, np.inf), np.sqrt(((x[i] - x[own]) ** 2).sum()))
        assert [r["vec_id"] for r in sorted(whole, key=lambda r: r["rank"]) if r["query_id"] == q] == sorted(d, key=lambda i: (d[i], i))[:10]


def test_clustered_vectors_need_few_probes():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((100, 32))[rng.integers(0, 100, 8000)] + 0.02 * rng.standard_normal((8000, 32))
    assert neighbours.probes_for(x, neighbours.centroids(x, 89), 10) <= 10


def test_words_are_counted_by_pieces(monkeypatch):
    rnd = random.Random(4)
    texts = ["".join(rnd.choice([" ", "\n", "a", "b1", "é", "'s", ", ", "!", "ab cd ", " x\ny "]) for _ in range(rnd.randint(0, 30))) for _ in range(500)] * 4
    words = bytebpe.regex.compile(public_tokenizers.PATTERN).findall
    want = collections.Counter(w for t in texts for w in words(t))
    asked = []
    counted = type("Counted", (), {"findall": lambda self, t: asked.append(t) or words(t)})()
    monkeypatch.setattr(bytebpe.regex, "compile", lambda pattern: counted)
    got = collections.Counter()
    for batch in bytebpe._count(iter([pa.RecordBatch.from_pydict({"text": texts[i : i + 100]}) for i in range(0, 2000, 100)]), public_tokenizers.PATTERN):
        for w, n in zip(batch["w"].to_pylist(), batch["n"].to_pylist()):
            got[w] += n
    assert got == want
    simple = sum(bytebpe._pieces(t, public_tokenizers.PATTERN) is not None for t in texts)
    assert simple and len(set(asked)) < len(asked)
    long = [" ".join(f"w{i % 50}," for i in range(5000))] * 20
    asked.clear()
    list(bytebpe._count(iter([pa.RecordBatch.from_pydict({"text": long})]), public_tokenizers.PATTERN))
    assert sum(map(len, asked)) < sum(map(len, long)) / 100


def library_bpe():
    import tiktoken

    ranks = bytebpe.rank_file(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), ranks


@pytest.mark.parametrize("limit", [0, 20, 1000])
def test_byte_bpe(spark, empty, limit):
    enc, _ = library_bpe()
    path, rnd = public_tokenizers.path("byte_bpe_50k.tiktoken"), random.Random(11)
    odd = ["".join(rnd.choice(" \n\t\x1c\x85\u00a0\u2003\u3000aB1é中'sll!ß́") for _ in range(60)) for _ in range(150)]
    odd += ["".join(rnd.choice("abcdefghij") for _ in range(n)) for n in (100, 256, 257, 3000)] + ["é" * 128 + "x", "x" * 257, " " * 300 + "a"]
    rows = [*corpus(), *[(400 + i, t, "en", "s", 0, "", "", 0) for i, t in enumerate(odd)]]
    df = bytebpe.encode(spark.createDataFrame(rows, SCHEMA).repartition(3), path, public_tokenizers.PATTERN, limit)
    got = sorted(((r["doc_id"], list(r["ids"]), bytes(r["d"]).decode()) for r in df.withColumn("d", bytebpe.decode(F.col("ids"), bytebpe.ranks_of(path))).collect()), key=str)
    assert got == sorted(((r[0], enc.encode_ordinary(r[1] or ""), r[1] or "") for r in rows), key=str)
    if not limit:
        assert bytebpe.encode(empty, path, public_tokenizers.PATTERN).count() == 0


def test_byte_bpe_folds_half_a_million_frequent_words_once(spark):
    plain = type("Plain", (), {"bound": lambda self, use: F.array(F.lit(1))})()
    texts = spark.range(5000, numPartitions=4).selectExpr("array_join(transform(sequence(0, 99), i -> concat('w', translate(string(id * 100 + i), '0123456789', 'abcdefghij'))), ' ') AS text")
    assert bytebpe.dictionary(texts.unionAll(texts), public_tokenizers.PATTERN, plain).count() == 500_000


def test_byte_bpe_strings_are_what_the_ids_say(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = [(i, t) for i, t in enumerate([None, "", "a b", "é́中\n ß", "x" * 300, " ", *("word%d " % i * (i % 7) for i in range(40))])]
    df = bytebpe.encode(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), path, public_tokenizers.PATTERN, 20, strings=True)
    got = df.withColumn("d", bytebpe.decode(F.col("ids"), bytebpe.ranks_of(path))).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["written"] == " ".join(map(str, r["ids"])) and bytes(r["decoded"]) == bytes(r["d"]) == (dict(rows)[r["doc_id"]] or "").encode()


def test_long_words_merge_alike():
    enc, ranks = library_bpe()
    rnd = random.Random(12)
    for n, letters in [(1, "a"), (2, "ab"), (300, "ab"), (2000, "the"), (100_000, "abcdefghijklmnopqrstuvwxyz")]:
        word = "".join(rnd.choice(letters) for _ in range(n))
        assert bytebpe.merge_long(word.encode(), ranks) == enc.encode_ordinary(word)


def test_a_word_of_100_000_characters(spark):
    enc, _ = library_bpe()
    word = "".join(random.Random(13).choice("abcdefghijklmnopqrstuvwxyz") for _ in range(100_000))
    df = spark.createDataFrame([(1, word)], "doc_id long, text string")
    assert list(bytebpe.encode(df, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).first()["ids"]) == enc.encode_ordinary(word)


def luhn(number):
    d = [int(c) for c in number if c.isdigit()][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def test_pii(spark, docs, empty):
    cases = ["4111 1111 1111 1111", "378282246310005", "+1 (415) 555-0199", "078-05-1120", "10.0.0.255", "1999-12-31", "31/01/2001", "ann.Smith+x@mail.example.org"]
    bad = ["4111 1111 1111 1112", "(115) 555-0199", "000-12-3456", "666-12-3456", "10.0.0.256", "1999-02-30", "1700-01-01", "1.2.3", "12345"]
    rows = [(i, f"see {c}, and {c}.") for i, c in enumerate(cases + bad)] + [(100, None), (101, ""), (102, " ".join(cases))]
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, n_found long, __old string")
    out = {r["doc_id"]: r for r in pii.pseudonymise(df, PII_KEY).collect()}
    for i, c in enumerate(cases):
        new = out[i]["text"][4:].split(", and ")[0]
        assert new != c and out[i]["text"] == f"see {new}, and {new}." and out[i]["n_replaced"] == 2 and new in out[102]["text"]
        assert re.sub("[0-9]", "9", new) == re.sub("[0-9]", "9", c) or "@" in c or c.count(".") == 3
    assert luhn(out[0]["text"].split(",")[0]) and luhn(out[1]["text"].split(",")[0])
    for i, c in enumerate(bad):
        assert out[len(cases) + i]["text"] == f"see {c}, and {c}." and out[len(cases) + i]["n_replaced"] == 0
    assert out[100]["text"] is None and out[101]["text"] == "" and out[100]["n_found"] == 0
    other = {r["doc_id"]: r for r in pii.pseudonymise(df, "another").collect()}
    assert other[0]["text"] != out[0]["text"]
    assert pii.pseudonymise(empty, PII_KEY).count() == 0 and pii.pseudonymise(docs, PII_KEY).count() == docs.count()


def test_phones_outside_the_numbering_plan(spark):
    rnd = random.Random(2)
    old = [f"+1 ({rnd.choice([rnd.randint(0, 199), rnd.randint(200, 999)]):03d}) {rnd.randint(0, 199):03d}-{rnd.randint(0, 9999):04d}" for _ in range(150)]
    old = sorted({*old, "+1 (017) 555-7713", "+1 (132) 555-1352", "1-000-000-0000", "+1 (199) 999-9999", "+1 (999) 199-9999", "+1 (200) 000-0000"})
    df = spark.createDataFrame([(i, f"call {t} now") for i, t in enumerate(old)], "doc_id long, text string")
    new = [r["text"][5:-4] for r in pii.pseudonymise(df, PII_KEY).orderBy("doc_id").collect()]
    assert all(a != b and re.sub("[0-9]", "9", a[2:]) == re.sub("[0-9]", "9", b[2:]) and a[:2] == b[:2] for a, b in zip(old, new)) and len(set(new)) == len(old)
    ten = [re.sub("[^0-9]", "", t)[-10:] for t in new]
    assert all(int(t[:3]) < 200 or int(t[3:6]) < 200 for t in ten)


def test_feistel_is_a_permutation(spark):
    df = spark.range(17 * 23).select(pii.feistel("k", F.lit("t"), F.floor(F.col("id") / 23), F.lit(17), F.col("id") % 23, F.lit(23)).alias("x"))
    assert df.distinct().count() == 17 * 23 and df.filter("x.a < 0 or x.a >= 17 or x.b < 0 or x.b >= 23").count() == 0


def brute_repeats(texts):
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i : i + 200] for b in data for i in range(len(b) - 199))
    for b in data:
        hit = np.zeros(len(b) + 201, int)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                hit[i] += 1
                hit[i + 200] -= 1
        m = np.cumsum(hit)[: len(b)] > 0
        yield len(b), int(m.sum()), int((np.diff(np.concatenate([[0], m.astype(int)])) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~m])).hexdigest()


@pytest.mark.parametrize("heavy", [1, 1000])
def test_repeats(spark, docs, empty, heavy, monkeypatch):
    monkeypatch.setattr(common, "HEAVY", heavy)
    rnd = random.Random(6)
    text = lambda n: " ".join(rnd.choice(WORDS) + str(rnd.randint(0, 99)) for _ in range(n))
    shared, base = text(50), text(200)
    more = [text(20) + shared[: 150 + 10 * k] + text(20) for k in range(12)] + [base[:k] + "#" + base[k:] for k in range(30, 900, 90)] + ["ab" * 400, "ab" * 130 + text(30), "é" * 300, base, base, base]
    rows = [(r[0], r[1], *r[2:]) for r in corpus()] + [(200 + i, t, "en", "s", 0, "", "", 0) for i, t in enumerate(more)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted((tuple(r) for r in repeats.remove_repeats(df, keep=["ranges", "n"]).drop("text", "ranges", "n").collect()), key=str)
    assert got == sorted(((r[0], *b) for r, b in zip(rows, brute_repeats([r[1] for r in rows]))), key=str)
    assert repeats.remove_repeats(empty, keep=["lang"]).count() == 0


def test_rows_that_share_an_id_or_have_none_keep_what_is_theirs(spark):
    rnd = random.Random(9)
    text = lambda n: " ".join(rnd.choice(WORDS) + str(rnd.randint(0, 999)) for _ in range(n))
    shared = text(60)
    rows = [(None, text(80)) for _ in range(300)] + [(5, text(20) + shared + text(20)), (5, text(90)), (None, shared)]
    got = sorted((tuple(r) for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).drop("text").collect()), key=str)
    assert got == sorted(((r[0], *b) for r, b in zip(rows, brute_repeats([r[1] for r in rows]))), key=str)


def test_blocks_cover_each_window_once():
    for o, n in [(168, 169), (0, 1), (100, 40), (130, 131), (168, 1)]:
        for block in repeats.BLOCKS:
            parts = repeats.parted(o, n, block)
            assert [w for _, first, windows, _ in parts for w in range(first, first + windows)] == sorted(range(n), key=lambda w: ((o - w) // block, w))
            assert all(o - b * block >= 0 and far >= o - first for b, first, _, far in parts)


def test_anchors_cover_every_window_across_chunks(monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 512)
    data = bytes(random.Random(2).choices(b"abc ", k=3000))
    _, p, lo, hi = repeats.anchors(data)
    covered = sorted(i for a, b in zip(lo, hi) for i in range(a, b + 1))
    assert covered == list(range(len(data) - 199)) and all(a <= q <= a + 168 for q, a in zip(p, hi)) and all(q >= b for q, b in zip(p, hi))


def base_counts(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    c = collections.Counter(zip(w, w[1:], w[2:]))
    cover = {j for i in range(len(w) - 2) if c[w[i], w[i + 1], w[i + 2]] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover)


def test_quality(spark, docs, empty):
    rnd = random.Random(5)
    good = [" ".join(rnd.choice(WORDS) + str(rnd.randint(0, 999)) for _ in range(100)) for _ in range(120)]
    junk = [" ".join(rnd.choice(WORDS) + "$$$%%" for _ in range(100)) for _ in range(4)]
    rows = corpus() + [(300 + i, t, "en", "s9", 0, "", "", 0) for i, t in enumerate(good + junk)]
    out = quality.quality(spark.createDataFrame(rows, SCHEMA)).collect()
    got = sorted(((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in out), key=str)
    want = [(r[0], *base_counts(r[1] or "")) for r in rows]
    assert got == sorted(((*w, w[1] < 50 or 100 * w[5] > 50 * w[1]) for w in want), key=str)
    kept = {r["doc_id"]: r["kept"] for r in out}
    assert all(kept[300 + i] for i in range(120)) and not any(kept[420 + i] for i in range(4))
    assert not any(r["kept"] and r["base_failed"] for r in out) and quality.quality(empty).count() == 0


def test_sketches_merge(spark):
    df = spark.range(2000).select(F.lit("en").alias("lang"), (F.col("id") % 2).cast("string").alias("source"), (F.col("id") + 1.0).alias("word_length"))
    whole = quality.quantiles(quality.merged(quality.sketches(df, ["word_length"]), ["lang"]), ["lang"]).first()
    assert whole["high"] == pytest.approx(1900, rel=0.021) and whole["low"] == pytest.approx(100, rel=0.021) and whole["size"] == 2000
    assert whole["mid_below"] <= 1000 <= whole["mid_above"]


def test_alike_documents_stay_and_long_texts_are_judged(spark):
    rnd = random.Random(15)
    alike = " ".join(f"w{i}" for i in range(60))
    long = " ".join(rnd.choice(WORDS) + str(rnd.randint(0, 10**6)) for _ in range(60_000))
    df = spark.createDataFrame([(i, alike, "en", "a") for i in range(40)] + [(100, long, "en", "b"), (101, None, None, None)], "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in quality.quality(df).collect()}
    assert all(got[i]["kept"] for i in range(40)) and not got[101]["kept"] and not got[101]["n_words"]
    assert got[100]["n_words"] == 60_000 and got[100]["word_chars"] == len(long) - 59_999 and not got[100]["base_failed"]


def test_chat(spark):
    rows = [(1, 0, "system", "be kind", 0), (1, 1, "ann", "hi <|im_end|>", 0), (1, 2, "bob", None, 0), (1, 2, "ann", "both", 0), (1, None, None, "first", 0), (2, 0, "system", "alone", 0), (None, 0, "cy", "q", 0), (1, 1, "ann", "hi <|im_end|>", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, start int")
    out = chat.perspectives(df)
    assert {(r["conv_id"], r["perspective"]) for r in out.collect()} == {(1, "ann"), (1, "bob"), (1, "unknown"), (None, "cy")}
    for r in chat.assembled(out).collect():
        want = []
        for conv, turn, role, text, _ in sorted((x for x in rows if x[0] == r["conv_id"]), key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "unknown", x[3] or "")):
            name = role or "unknown"
            tag = "system" if name == "system" else "assistant" if name == r["perspective"] else f"user name={name}"
            want.append((tag, (text or "").replace("<|", "< |").replace("|>", "| >")))
        assert r["text"] == "".join(f"<|im_start|>{t}\n{x}<|im_end|>\n" for t, x in want)
        assert [r["text"][m["start"] : m["stop"]] for m in r["mask"]] == [f"{x}<|im_end|>\n" for t, x in want if t == "assistant"]
    assert chat.perspectives(df.limit(0)).count() == 0


def test_chat_offsets_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", 3)
    df = spark.createDataFrame([(1, i, "ab"[i % 2], "t" * i) for i in range(20)], "conv_id long, turn long, role string, text string")
    for p in "ab":
        got = chat.perspectives(df).filter(F.col("perspective") == p).orderBy("turn").collect()
        assert [r["start"] for r in got] == [0, *[r["stop"] for r in got[:-1]]]


def test_what_comes_of_an_explode_is_never_broadcast(spark):
    """Spark sizes it by its input, so 8 million rows may seem to be a few MB; only the few heavy keys are broadcast."""
    df = spark.range(200).selectExpr("id * 7919 AS fp")
    plan = simhash.links(df)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("SortMergeJoin") == 1 and plan.count("BroadcastHashJoin") == 2
