"""Removal of repeated byte strings by distributed prefix doubling over thinned positions.

Every string of ``LENGTH`` bytes is a window. Plain prefix doubling sorts a (rank, rank) pair for every byte of the
corpus in every round; here positions are first thinned by content, so that about one in eighty is left. A window's
anchor is its rightmost ``CORE``-byte string of least hash: equal windows have equal anchors at equal offsets, and the
windows of one anchor follow one another. From there on it is prefix doubling on (position, rank):

1. Positions are ranked by the ``CORE`` bytes at the anchor, and by the whole stretch of the anchor's windows (200 to 368
   bytes). A position with a unique core is done: its windows are unique. Equal stretches are past the threshold: their
   windows repeat, and one position of each set stays on as a witness.
2. What is left are anchors near an edge of a repeat. Round by round their windows are parted by offset into blocks of
   64, 16, 4 and 1, and the string common to a block's windows grows from 137 over 185 and 197 to 200 bytes. Each round
   ranks the blocks anew by that string, drops those of unique rank, and settles those whose whole stretch is equal to
   another one's. The last round ranks single windows, so that nothing is left open.

Ranks are 128-bit hashes, and Spark's shuffles bring equal ones together as counts; members of a set are never compared
with one another. Texts are known by a 128-bit hash, so rows that share a doc_id, or have none, are told apart.
"""

from __future__ import annotations

import hashlib
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taxaspark.llm.common import by_weight, discard, joined, release_memory, sieve, stored, text_or_empty

LENGTH, CORE = 200, 32
#: Bytes of a text that are hashed at once.
CHUNK = 1 << 18
#: Windows of a block in each round; the string common to a block has LENGTH + 1 - that many bytes, or more.
BLOCKS = (64, 16, 4, 1)
KEY = ["k1", "k2"]


def text_key(text: Column) -> list[Column]:
    """k1, k2: the first 128 bits of the text's SHA-256."""
    h = F.sha2(text, 256)
    return [F.conv(F.substring(h, 1 + 16 * i, 16), 16, -10).cast("long").alias(k) for i, k in enumerate(KEY)]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def anchors(data: bytes, length: int = LENGTH, core: int = CORE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(core hash, position, first window, last window) of each anchor and run of windows that have it."""
    out = []
    for base in range(0, max(1, len(data) - length + 1), CHUNK):
        a = np.frombuffer(data, np.uint8, min(CHUNK + length - 1, len(data) - base), base).astype(np.uint64) + np.uint64(1)
        if len(a) < length:
            break
        n = 1
        while n < core:  # ``core`` is a power of two
            a = a[:-n] * np.uint64(pow(0x9E3779B97F4A7C15, n, 1 << 64)) + a[n:]
            n *= 2
        h = _mixed(a)
        place = np.uint64(0xFFFFFF) - np.arange(len(h), dtype=np.uint64)
        low = (h & np.uint64(0xFFFFFFFFFF000000)) | place
        width, n = length - core + 1, 1
        while 2 * n <= width:
            low = np.minimum(low[:-n], low[n:])
            n *= 2
        if width > n:
            low = np.minimum(low[: len(low) - (width - n)], low[width - n :])
        at = (np.uint64(0xFFFFFF) - (low & np.uint64(0xFFFFFF))).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
        last = np.concatenate([first[1:] - 1, [len(at) - 1]])
        p = at[first]
        out.append((h[p], p + base, first + base, last + base))
    return tuple(map(np.concatenate, zip(*out))) if out else (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)


def _bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def _longs(columns: dict[str, list[np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in columns.values()], list(columns))


def _pass_anchors(batches):
    """k1, k2, core, span, at: first window << 16 | bytes from there to the anchor << 8 | windows - 1."""
    digest = xxhash.xxh3_64_intdigest
    for batch in batches:
        for begin in range(0, batch.num_rows, 256):
            part = batch.slice(begin, 256)
            out: dict[str, list[np.ndarray]] = {k: [] for k in ("k1", "k2", "core", "span", "at")}
            for k1, k2, t in zip(part["k1"].to_pylist(), part["k2"].to_pylist(), part["text"].to_pylist()):
                data = _bytes(t)
                h, p, lo, hi = anchors(data)
                if not len(h):
                    continue
                view = memoryview(data)
                out["k1"].append(np.full(len(h), k1, np.int64))
                out["k2"].append(np.full(len(h), k2, np.int64))
                out["core"].append(h)
                out["span"].append(np.fromiter((digest(view[a : b + LENGTH], seed=c - a) for a, b, c in zip(lo.tolist(), hi.tolist(), p.tolist())), np.uint64, len(h)))
                out["at"].append(lo << 16 | (p - lo) << 8 | (hi - lo))
            if out["at"]:
                yield _longs(out)
    release_memory()


SEGMENT = "k1 long, k2 long, lo long, o int, n int, fixed boolean, bytes binary"


def _segments(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = {"o": pa.int32(), "n": pa.int32(), "fixed": pa.bool_(), "bytes": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(k, pa.int64())) for k, c in zip(names, zip(*rows))], names)


def _pass_contexts(batches):
    """The stretches of the wanted anchors (``want``: struct(at, fixed) of each). Equal texts come one after the other; one will do."""
    names, last = ["k1", "k2", "lo", "o", "n", "fixed", "bytes"], None
    for batch in batches:
        for begin in range(0, batch.num_rows, 64):
            part, rows = batch.slice(begin, 64), []
            for k1, k2, t, want in zip(*(part[c].to_pylist() for c in ("k1", "k2", "text", "want"))):
                if (k1, k2) == last:
                    continue
                data, last = _bytes(t), (k1, k2)
                for w in want:
                    lo, o, n = w["at"] >> 16, w["at"] >> 8 & 0xFF, (w["at"] & 0xFF) + 1
                    rows.append((k1, k2, lo, o, n, w["fixed"], data[lo : lo + n - 1 + LENGTH]))
            if rows:
                yield _segments(rows, names)
    release_memory()


def parted(o: int, n: int, block: int) -> list[tuple[int, int, int, int]]:
    """A segment's windows dealt to blocks of offsets: (block, first window in the segment, windows, end of the block's offsets).

    ``o``: bytes from the segment's start to the anchor, which is the offset of its first window; ``n``: its windows.
    """
    out = []
    for b in range((o - n + 1) // block, o // block + 1):
        high, low = min(o, b * block + block - 1), max(o - n + 1, b * block)
        out.append((b, o - high, high - low + 1, min(b * block + block - 1, LENGTH - CORE)))
    return out


def _part(batches, block: int):
    """One row for each block of a segment: its rank (r1, r2), the hash of its whole stretch, and the segment that it is."""
    names = ["r1", "r2", "span", "k1", "k2", "lo", "o", "n", "fixed", "bytes"]
    for batch in batches:
        for begin in range(0, batch.num_rows, 1000):
            rows, part = [], batch.slice(begin, 1000)
            for k1, k2, lo, o, n, fixed, data in zip(*(part[c].to_pylist() for c in names[3:])):
                for b, first, windows, far in parted(o, n, block):
                    common = data[o - b * block : o - far + LENGTH]
                    r1, r2 = np.frombuffer(xxhash.xxh3_128_digest(common, seed=b), "<i8").tolist()
                    own = data[first : first + windows - 1 + LENGTH]
                    span = xxhash.xxh3_64_intdigest(own, seed=o - first)
                    rows.append((r1, r2, span - (1 << 64) if span >> 63 else span, k1, k2, lo + first, o - first, windows, fixed, own))
            if rows:
                yield _segments(rows, names)
    release_memory()


def _range(lo: Column, n: Column) -> Column:
    """A run of ``n`` windows from ``lo`` on, as one long."""
    return (F.shiftleft(lo, 8) + n - 1).cast("long").alias("range")


def refine(state: DataFrame) -> list[DataFrame]:
    """k1, k2, range of the windows of the open segments that repeat, from rounds of parting and ranking (see above).

    ``state`` (``SEGMENT``): segments that are open, and fixed ones, whose windows are known to repeat. In a round, segments
    of one rank and one whole stretch are a set, of which one segment goes on, as long as its rank has an open set.
    """
    found = []
    for block in BLOCKS:
        parts = stored(state.mapInArrow(partial(_part, block=block), f"r1 long, r2 long, span long, {SEGMENT}"), "parts")
        discard(state)
        sets = parts.groupBy("r1", "r2", "span").agg(F.count(F.lit(1)).alias("size"), F.max("fixed").alias("fixed"), F.min(F.struct(*KEY, "lo")).alias("one"))
        sets = stored(sets.withColumn("fixed", F.col("fixed") | (F.col("size") > 1)), "sets")
        ranks = stored(sets.groupBy("r1", "r2").agg(F.count(F.lit(1)).alias("sets"), F.count_if(~F.col("fixed")).alias("open")), "ranks")
        going = ranks.select("r1", "r2", F.col("sets").alias("weight"), ((F.col("sets") > 1) & (F.col("open") > 0)).alias("going"))
        marks = joined(sets, going, ["r1", "r2"], "weight").filter("fixed OR going")
        marks = stored(marks.withColumnRenamed("fixed", "settled"), "marks")
        ended = joined(parts.filter("NOT fixed").drop("bytes"), marks.filter("settled"), ["r1", "r2", "span"])
        found.append(stored(ended.select(*KEY, _range(F.col("lo"), F.col("n"))), "found"))
        on = joined(parts.drop("fixed"), marks.filter("going"), ["r1", "r2", "span"]).filter(F.struct(*KEY, "lo") == F.col("one"))
        state = stored(on.select(*KEY, "lo", "o", "n", F.col("settled").alias("fixed"), "bytes"), "open")
        discard(parts, sets, ranks, marks)
        if state.isEmpty():
            discard(state)
            break
    return found


def repeats(rows: DataFrame, heavy: DataFrame) -> DataFrame:
    """k1, k2, ranges: the runs of repeated windows of each text in ``rows`` (k1, k2, text); ``heavy``: the keys of very frequent texts."""
    found = stored(rows.mapInArrow(_pass_anchors, "k1 long, k2 long, core long, span long, at long"), "anchors")
    spans = stored(found.groupBy("core", "span").agg(F.count(F.lit(1)).alias("size")), "spans")
    cores = spans.groupBy("core").agg(F.count(F.lit(1)).alias("spans"), F.count_if(F.col("size") == 1).alias("open"))
    mixed = stored(cores.filter("open > 0 AND spans > 1").select("core", "spans"), "cores")
    near = joined(spans, mixed, ["core"], "spans").withColumn("near", F.lit(True))
    both = near.unionByName(spans.filter("size > 1").withColumn("near", F.lit(False)))
    marks = stored(both.groupBy("core", "span").agg(F.max("size").alias("size"), F.max("near").alias("near")), "marks")
    alive = stored(joined(found, marks.withColumn("repeated", F.col("size") > 1), ["core", "span"]), "alive")
    discard(found, spans, mixed, marks)
    whole = alive.filter("repeated").select(*KEY, _range(F.shiftright("at", 16), F.col("at").bitwiseAND(F.lit(255)) + 1))
    witness = alive.filter("near").groupBy("core", "span").agg(F.min(F.struct(*KEY, "at")).alias("w"), F.first("repeated").alias("fixed"))
    want = witness.groupBy("w.k1", "w.k2").agg(F.collect_list(F.struct("w.at", "fixed")).alias("want"))  # anchors of one text
    few = rows.join(F.broadcast(heavy), KEY).groupBy(*KEY).agg(F.first("text").alias("text"))
    one = rows.join(F.broadcast(heavy), KEY, "left_anti").select(*KEY, "text").unionByName(few.select(*KEY, "text"))
    want = stored(want, "wanted")
    state = stored(one.filter(sieve(want, KEY)).join(want, KEY).mapInArrow(_pass_contexts, SEGMENT), "open")
    discard(want)
    parts = refine(state)
    every = reduce(DataFrame.unionByName, parts, whole)
    light = every.join(F.broadcast(heavy), KEY, "left_anti")  # a frequent text repeats as a whole
    out = stored(light.groupBy(*KEY).agg(F.collect_set("range").alias("ranges")), "ranges")
    discard(alive, *parts)
    return out


def _merged(ranges: list[int]) -> list[list[int]]:
    out: list[list[int]] = []
    for r in sorted(ranges):
        a, b = r >> 8, (r >> 8) + (r & 0xFF) + LENGTH
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


def _cut(batches, keep: list[str]):
    for batch in batches:
        for begin in range(0, batch.num_rows, 1000):
            part = batch.slice(begin, 1000)
            cols: list[list] = [[] for _ in range(6)]
            for d, t, ranges, whole in zip(*(part[c].to_pylist() for c in ("doc_id", "__text", "__ranges", "__whole"))):
                data = _bytes(t)
                spans = _merged(ranges) if ranges else [[0, len(data)]] if whole and len(data) >= LENGTH else []
                ends = [0, *[x for s in spans for x in s], len(data)]
                kept = b"".join(data[a:b] for a, b in zip(ends[::2], ends[1::2])) if spans else data
                for c, v in zip(cols, (d, len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if spans else t)):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))] + [part[f"__keep_{c}"] for c in keep], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text", *keep])
    release_memory()


def remove_repeats(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256, the kept ``text``, and the
    columns named in ``keep``, which must have other names than these.

    Every byte covered by a string of ``LENGTH`` bytes that also starts elsewhere is removed, in all places. A null text
    is empty; texts under ``LENGTH`` bytes lose nothing. Repeated rows repeat one another and lose everything that is
    long enough; rows that share a doc_id, or have none, are told apart by their texts. ``text`` drops the broken parts of
    characters that a cut went through; the hash covers the exact bytes. A text may be of any length: it is hashed
    ``CHUNK`` bytes at a time. An empty table gives no rows; columns that aren't kept aren't read, whatever their names.
    """
    keep = keep or []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("__text"), *[F.col(c).alias(f"__keep_{c}") for c in keep]).select("*", *text_key(F.col("__text")))
    copies = stored(rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "copies")
    heavy = by_weight(copies)[0].select(*KEY)
    ranges = repeats(rows.select(*KEY, F.col("__text").alias("text")), heavy).withColumnRenamed("ranges", "__ranges")
    schema = T.StructType([*T.StructType.fromDDL("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string").fields, *[docs.schema[c] for c in keep]])
    often = rows.join(F.broadcast(heavy), KEY).withColumns({"__ranges": F.lit(None).cast("array<long>"), "__whole": F.lit(True)})
    others, maybe = rows.join(F.broadcast(heavy), KEY, "left_anti").withColumn("__whole", F.lit(False)), sieve(ranges, KEY)
    touched = others.filter(maybe).join(ranges, KEY, "left")
    clean = others.filter(~maybe).withColumn("__ranges", F.lit(None).cast("array<long>"))
    return touched.unionByName(clean).unionByName(often).drop(*KEY).mapInArrow(partial(_cut, keep=keep), schema)
