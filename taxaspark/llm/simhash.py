"""Near-duplicates by SimHash fingerprints, with pivot distance tables.

A fingerprint has 64 bits from hashes of word shingles. Equal fingerprints collapse into one class first, so copies
cost nothing further on. Two fingerprints that differ in at most four bits agree on at least three of seven bit blocks,
so each class is filed under its 35 choices of three blocks, and only classes filed together are compared. There, a
table of Hamming distances to fixed reference fingerprints (pivots) is computed once for each row; a pair whose
distances to any pivot differ by more than the threshold can't be close and is discarded by the table alone, and the
survivors are verified. A file of many classes is dealt to block pairs, so no task holds more than two blocks of it,
and each task gives a spanning forest of its links rather than all of them.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxaspark.llm.common import discard, joined, stored, text_or_empty
from taxaspark.llm.components import components, first_rows, keep_least

SHINGLE, SEED, BITS = 4, 42, 4
BLOCKS = 7
PIVOTS = 16
#: Classes of one file that a task compares with one another; a larger file is dealt to block pairs.
BLOCK_ROWS = 2048


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def masks(blocks: int = BLOCKS, bits: int = BITS) -> list[int]:
    """Bit masks of all choices of ``blocks - bits`` blocks."""
    edge = [round(64 * i / blocks) for i in range(blocks + 1)]
    block = [sum(1 << b for b in range(edge[i], edge[i + 1])) for i in range(blocks)]
    return [_signed(sum(c)) for c in combinations(block, blocks - bits)]


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Fixed reference fingerprints: hashes of 0, 1, 2, ..."""
    return np.array([xxhash.xxh64_intdigest(str(i).encode(), SEED) for i in range(n)], dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        counts += np.unpackbits(hashes[at : at + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """SimHash of a text: a bit is set if more than half of the shingles' hashes have it."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    digest, counts, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(words) - k + 1
    a, b = starts[:n].tolist(), ends[k - 1 :].tolist()
    for at in range(0, n, 65_536):
        h = np.array([digest(joined[i:j], SEED) for i, j in zip(a[at : at + 65_536], b[at : at + 65_536])], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches, shingle: int):
    for batch in batches:
        prints = np.array([fingerprint(t, shingle) for t in batch["text"].to_pylist()], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(prints, pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (signed 64-bit) of each row; a text without words, or null, has fingerprint 0."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(partial(_fingerprints, shingle=shingle), "doc_id long, fp long")


def near(x: np.ndarray, y: np.ndarray, table_x: np.ndarray, table_y: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of ``x`` and ``y`` within ``bits``: first the pivot tables, then the survivors themselves."""
    alive = np.abs(table_x[:, None, 0] - table_y[None, :, 0]) <= bits
    i, j = np.nonzero(alive)
    for p in range(1, table_x.shape[1]):
        keep = np.abs(table_x[i, p] - table_y[j, p]) <= bits
        i, j = i[keep], j[keep]
    keep = np.bitwise_count(x[i] ^ y[j]) <= bits
    return i[keep], j[keep]


def forest(fps: np.ndarray, bits: int, step: int = 512) -> list[tuple[int, int]]:
    """Spanning forest of the links (at most ``bits`` apart) among ``fps``."""
    refs, parent, out = pivots(), list(range(len(fps))), []
    table = np.bitwise_count(fps[:, None] ^ refs[None, :]).astype(np.int8)

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for a in range(0, len(fps), step):
        for b in range(a, len(fps), step):
            for i, j in zip(*(v.tolist() for v in near(fps[a : a + step], fps[b : b + step], table[a : a + step], table[b : b + step], bits))):
                i, j = i + a, j + b
                if i < j and (p := root(i)) != (q := root(j)):
                    parent[max(p, q)] = min(p, q)
                    out.append((i, j))
    return out


def _links(batches, bits: int):
    """Rows come sorted by file; a file may go on in the next batch."""
    held: list[np.ndarray] = []
    held_key = None

    def emit(groups: list[np.ndarray]):
        pairs = [(g[i], g[j]) for g in groups for i, j in forest(g, bits)]
        if pairs:
            a, b = np.array(pairs, dtype=np.uint64).T.copy().view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch[c].to_numpy() for c in ("choice", "key", "low", "high")], axis=1)
        fps = batch["fp"].to_numpy().view(np.uint64)
        cut = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        parts, firsts = np.split(fps, cut), keys[np.concatenate([[0], cut])]
        groups, pairs = [], []
        for part, key in zip(parts, map(tuple, firsts.tolist())):
            if key == held_key:
                held.append(part)
            else:
                if held:
                    (pairs if sum(map(len, held)) == 2 else groups).append(np.concatenate(held))
                held, held_key = [part], key
        if pairs:
            p = np.stack(pairs)
            refs = pivots()
            table = np.bitwise_count(p[:, :, None] ^ refs).astype(np.int8)
            p = p[np.abs(table[:, 0] - table[:, 1]).max(axis=1) <= bits]
            p = p[np.bitwise_count(p[:, 0] ^ p[:, 1]) <= bits].view(np.int64)
            if len(p):
                yield pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], ["a", "b"])
        yield from emit(groups)
    if held:
        yield from emit([np.concatenate(held)])


def links(classes: DataFrame, bits: int = BITS, blocks: int = BLOCKS) -> DataFrame:
    """Distinct links a, b between the distinct fingerprints ``fp`` of ``classes``; they connect what all links connect."""
    choices = F.explode(F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks(blocks, bits))])).alias("c")
    filed = classes.select("fp", choices).select("fp", "c.choice", "c.key")
    shared = filed.groupBy("choice", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = joined(filed, shared.withColumn("size", F.col("n")), ["choice", "key"], merge=True).withColumn("g", F.ceil(F.col("n") / BLOCK_ROWS))
    mine = F.pmod(F.xxhash64("fp"), F.col("g"))
    dealt = members.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("g") - 1)))
    dealt = dealt.select("choice", "key", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "fp")
    keys = ["choice", "key", "low", "high"]
    n = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(partial(_links, bits=bits), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (smallest doc_id reachable).

    Null and empty texts share fingerprint 0 and are linked like any others. Repeated rows get the same component. Rows
    with a null doc_id are linked too; a component of only such rows has a null id. An empty table gives no rows.
    """
    prints = stored(fingerprints(docs, shingle), "fingerprints")
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("size")), "classes")
    found = stored(links(classes.select("fp"), bits), "near")
    roots = components(found)
    discard(found)
    lowest = roots.join(classes, roots["node"] == classes["fp"]).groupBy("root").agg(F.min("first_doc").alias("component_id"))
    linked = roots.join(lowest, "root").select(F.col("node").alias("fp"), "component_id")
    full = stored(classes.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "first_doc").alias("component_id"), "size"), "components")
    discard(classes)
    out = joined(prints, full, ["fp"])
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _marks(batches, shingle: int):
    """The rows with their fingerprint in the place of ``__body``."""
    for batch in batches:
        at = batch.schema.get_field_index("__body")
        prints = np.array([fingerprint(t, shingle) for t in batch["__body"].to_pylist()], dtype=np.uint64).view(np.int64)
        columns = [c for i, c in enumerate(batch.columns) if i != at]
        names = [c for i, c in enumerate(batch.schema.names) if i != at]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(prints, pa.int64())], [*names, "__node"])


def keep_one(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """Of each component of near-duplicates one row of ``docs``, all columns.

    It is the row of the smallest doc_id, nulls last; of several such rows the least (text, ...). Documents that share a
    doc_id, or have none, stay where they are in different components.
    """
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    marked = stored(docs.withColumn("__body", text_or_empty()).mapInArrow(partial(_marks, shingle=shingle), f"{names}, __node long"), "marked")
    classes = stored(first_rows(marked), "classes")
    roots = stored(components(links(classes.select(F.col("__node").alias("fp")), bits)), "roots")
    return keep_least(marked, classes, roots, docs.columns)
