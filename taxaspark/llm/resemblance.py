"""Near-duplicates by the Jaccard similarity of word shingles: candidates by SimHash and pivot tables, and by minima of hashes.

Rows of equal shingle sets collapse into one class first. A class has a SimHash fingerprint of its shingles; fingerprints
that differ in at most four bits are found by pivot distance tables (``simhash.links``). Most pairs of similarity 0.8 differ
in more, so each class is filed under 30 keys of five minima too: a pair of 0.8 is missed by these with probability
(1 - 0.8^5)^30, under 7 in a million, and a more similar one more rarely. Classes that any chain of close fingerprints and shared keys connects are compared with one another by their whole shingle sets; a set of many classes
is dealt to block pairs, so no task holds more than two blocks of it, and each task gives a spanning forest of its links.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxaspark.llm import simhash
from taxaspark.llm.common import discard, joined, stored, text_or_empty
from taxaspark.llm.components import components, first_rows, keep_least

SHINGLE, SEED, LEAST = 5, 42, 0.8
KEYS, MINIMA = 30, 5
#: Classes of one connected set that a task compares with one another; a larger set is dealt to block pairs.
BLOCK_ROWS = 1024


def shingles(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """Distinct hashes, in order, of a text's runs of ``shingle`` words; a shorter text is one run, one without words none."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    k = min(shingle, len(words))
    a, b = np.concatenate([[0], ends[:-1] + 1])[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[i:j], SEED) for i, j in zip(a, b)), np.uint64, len(a)))


#: Fixed odd factors; each orders the hashes anew.
FACTORS = np.array([xxhash.xxh64_intdigest(f"factor {i}".encode(), SEED) | 1 for i in range(KEYS * MINIMA)], dtype=np.uint64)


def keys(hashes: np.ndarray) -> np.ndarray:
    """The keys that a set of hashes is filed under; none for an empty set."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(KEYS * MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 4096):
        least = np.minimum(least, (hashes[at : at + 4096, None] * FACTORS).min(axis=0))
    rows = least.reshape(KEYS, MINIMA)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), i) for i, r in enumerate(rows)], dtype=np.uint64).view(np.int64)


def _marks(batches, shingle: int):
    """Appends class and keys to the rows."""
    for batch in batches:
        sets = [shingles(t, shingle) for t in batch["__body"].to_pylist()]
        node = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], dtype=np.uint64).view(np.int64)
        filed = [keys(s) for s in sets]
        ends = np.concatenate([[0], np.cumsum([len(k) for k in filed], dtype=np.int64)]).astype(np.int32)
        flat = pa.array(np.concatenate([np.zeros(0, np.int64), *filed]), pa.int64())
        at = batch.schema.get_field_index("__body")
        columns = [c for i, c in enumerate(batch.columns) if i != at]
        names = [c for i, c in enumerate(batch.schema.names) if i != at]
        prints = np.array([simhash.majority(s) for s in sets], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([*columns, pa.array(node, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat), pa.array(prints, pa.int64())], [*names, "__node", "__keys", "__print"])


def forest(sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Spanning forest of the links (similarity ``least`` or more) among sets, none of them empty."""
    names, token = np.unique(np.concatenate(sets), return_inverse=True)
    sizes = np.array([len(s) for s in sets], np.int64)
    tokens = np.split(token, np.cumsum(sizes)[:-1])
    mark, left, queue, out = np.zeros(len(names), bool), np.arange(len(sets)), [], []
    flat = starts = None
    while len(left):
        if not queue:
            queue, left, flat = [int(left[0])], left[1:], None
            continue
        if flat is None:
            flat = np.concatenate([tokens[j] for j in left])
            starts = np.concatenate([[0], np.cumsum(sizes[left])[:-1]])
        i = queue.pop()
        mark[tokens[i]] = True
        both = np.add.reduceat(mark[flat], starts, dtype=np.int64)
        mark[tokens[i]] = False
        hit = both >= least * (sizes[i] + sizes[left] - both) - 1e-9
        if hit.any():
            found = left[hit].tolist()
            out += [(i, j) for j in found]
            queue += found
            left, flat = left[~hit], None
    return out


def _links(batches, least: float):
    """Rows come sorted by group; a group may go on in the next batch."""
    held, nodes, sets = None, [], []

    def emit():
        pairs = [(nodes[i], nodes[j]) for i, j in forest(sets, least)] if len(nodes) > 1 else []
        if pairs:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*pairs)], ["a", "b"])

    for batch in batches:
        for root, low, high, node, raw in zip(*(batch[c].to_pylist() for c in ("root", "low", "high", "node", "hashes"))):
            if (root, low, high) != held:
                yield from emit()
                held, nodes, sets = (root, low, high), [], []
            nodes.append(node)
            sets.append(np.frombuffer(raw, np.uint64))
    yield from emit()


def _sets(batches, shingle: int):
    """node, root, hashes: the bytes of each text's shingle hashes."""
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            some = batch.slice(at, 500)
            yield pa.RecordBatch.from_arrays([some["node"], some["root"], pa.array([shingles(t, shingle).tobytes() for t in some["text"].to_pylist()], pa.binary())], ["node", "root", "hashes"])


def candidates(classes: DataFrame) -> DataFrame:
    """node, root: the classes that share a key with another one or have a close fingerprint, and what chains of these connect.

    Classes without words have no keys, and no part here.
    """
    prints = classes.filter(F.size("__keys") > 0).select("__node", F.col("__print").alias("fp"))
    firsts = stored(prints.groupBy("fp").agg(F.min("__node").alias("a"), F.max("__node").alias("top"), F.count(F.lit(1)).alias("size")), "prints")
    equal = joined(prints, firsts.filter("a < top").select("fp", "a", "size"), ["fp"]).filter("a <> __node").select("a", F.col("__node").alias("b"))
    close = simhash.links(firsts.select("fp"))
    end = lambda old, new: firsts.select(F.col("fp").alias(old), F.col("a").alias(new))
    close = close.select(F.col("a").alias("x"), F.col("b").alias("y")).join(end("x", "a"), "x").join(end("y", "b"), "y").select("a", "b")
    filed = classes.select("__node", F.explode("__keys").alias("key"))
    heads = filed.groupBy("key").agg(F.min("__node").alias("a"), F.max("__node").alias("top"), F.count(F.lit(1)).alias("size")).filter("a < top").select("key", "a", "size")
    stars = joined(filed, heads, ["key"], merge=True).filter("a <> __node").select("a", F.col("__node").alias("b")).distinct()
    found = components(stars.unionByName(equal).unionByName(close))
    discard(firsts)
    return found


def links(texts: DataFrame, shingle: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """Distinct links a, b among ``texts`` (node, root, text) of the same root; they connect what all links connect.

    Each text is cut into shingles once; what is dealt to block pairs are the sets of their hashes.
    """
    sizes = texts.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    sets = stored(texts.select("node", "root", "text").mapInArrow(partial(_sets, shingle=shingle), "node long, root long, hashes binary"), "sets")
    members = joined(sets, sizes.withColumn("g", F.ceil(F.col("size") / BLOCK_ROWS)), ["root"])
    dealt = members.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("g"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("g") - 1)))
    dealt = dealt.select("root", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "node", "hashes")
    group = ["root", "low", "high"]
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = stored(dealt.repartition(n, *group).sortWithinPartitions(*group).mapInArrow(partial(_links, least=least), "a long, b long").distinct(), "near")
    discard(sets)
    return found


def keep_one(docs: DataFrame, shingle: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """Of each component of near-duplicates (similarity ``least`` or more) one row of ``docs``, all columns.

    It is the row of the smallest doc_id, nulls last; of several such rows the least (text, ...). Texts without words,
    null ones too, are alike. Documents that share a doc_id, or have none, stay where their texts aren't alike.
    """
    marked = stored(_marked(docs, shingle), "marked")
    classes = stored(first_rows(marked, F.first("__keys").alias("__keys"), F.first("__print").alias("__print")), "classes")
    near = candidates(classes)
    firsts = near.join(classes, near["node"] == classes["__node"]).select("node", "root", F.col("first.id").alias("__id"))
    body = marked.select("__node", "doc_id", text_or_empty().alias("text"))
    texts = body.join(firsts, (F.col("__node") == F.col("node")) & F.col("doc_id").eqNullSafe(F.col("__id"))).groupBy("node", "root").agg(F.min("text").alias("text"))
    texts = stored(texts, "texts")
    found = links(texts, shingle, least)
    roots = components(found)
    discard(near, texts, found)
    return keep_least(marked, classes, roots, docs.columns)


def _marked(docs: DataFrame, shingle: int) -> DataFrame:
    """``docs`` with ``__node`` (the hash of the shingle set), ``__keys`` and ``__print`` (its fingerprint)."""
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.withColumn("__body", text_or_empty()).mapInArrow(partial(_marks, shingle=shingle), f"{names}, __node long, __keys array<long>, __print long")
