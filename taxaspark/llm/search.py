"""Ranked lexical search: the best documents for each query, by range maxima over posting lists.

Documents lie in blocks of neighbouring rows. In a block each term's posting list has a sparse table of the places of
range maxima, so the greatest impact of a term in any interval of documents is two lookups. The sum of these maxima
over a query's terms bounds the score of every document in the interval. Intervals are opened best first: one is split
at the document of the greatest impact in it, which is scored exactly, and both sides get bounds of their own; sides
that can't reach the k-th best score are dropped. So the first k of a block are exact, and the first k of all blocks'
firsts are the answer. A first round opens a few intervals in each block; the k-th best score that it finds over all
blocks is the least score that the second round has to look for.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxaspark.llm.common import discard, stored, text_or_empty

#: Characters that part terms, as a regular expression class body: ASCII but for letters and digits.
PARTS = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
#: Most documents of a block; queries that are searched together; terms up to which the vocabulary is broadcast.
BLOCK, TOGETHER, SMALL = 8192, 2000, 200_000
#: Intervals opened at once, and steps of the first round in each block.
OPENED, PROBES = 64, 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lower(term: Column) -> Column:
    """A-Z lower-cased, nothing else; ``lower`` does the same to ASCII and is quicker."""
    return F.when(F.octet_length(term) == F.char_length(term), F.lower(term)).otherwise(F.translate(term, UPPER, LOWER))


def terms(text: Column) -> Column:
    """The terms of a text as they stand, repeats included."""
    return F.filter(F.split(text, f"[{PARTS}]+"), lambda t: t != "")


def postings(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """row, doc_id, n, tid, tf: how often each document holds each term of ``vocabulary`` (term, tid), stored.

    ``n``: the document's terms. ``tid`` 0 is in every document once, so that all are there. ``row`` names a row: the
    split that it was read in, and its place there.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), terms(text_or_empty()).alias("terms"))
    each = rows.select("row", "doc_id", F.size("terms").cast("long").alias("n"), F.explode(F.concat(F.array(F.lit("")), F.col("terms"))).alias("term"))
    known = vocabulary.unionByName(docs.sparkSession.createDataFrame([("", 0)], "term string, tid long"))
    found = each.withColumn("term", _lower(F.col("term"))).join(F.broadcast(known) if vocabulary.count() <= SMALL else known, "term")
    return stored(found.groupBy("row", "doc_id", "n", "tid").agg(F.count(F.lit(1)).alias("tf")), "postings")


class Block:
    """Posting lists of a block's documents, with their impacts and range maxima."""

    def __init__(self, rows: pd.DataFrame, weights: dict[int, int], docs: int, words: int):
        ids = rows[rows["tid"] == 0].sort_values(["doc_id", "row"], na_position="first")
        self.row, self.doc_id = ids["row"].to_numpy(), ids["doc_id"].to_numpy()
        self.size = len(ids)
        rows = rows[rows["tid"] != 0]
        tid = rows["tid"].to_numpy()
        w = np.array([weights.get(t, 0) for t in tid.tolist()], np.int64)
        by_row = np.argsort(self.row, kind="stable")
        at = by_row[np.searchsorted(self.row[by_row], rows["row"].to_numpy())]
        n, tf = rows["n"].to_numpy(np.int64), rows["tf"].to_numpy(np.int64)
        impact = w * ((1_000_000_000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // max(words, 1))))
        some = impact > 0
        order = np.lexsort((at[some], tid[some]))
        tid, self.doc, self.impact = tid[some][order], at[some][order], impact[some][order]
        names, starts = np.unique(tid, return_index=True)
        ends = np.append(starts[1:], len(tid))
        self.lists = dict(zip(names.tolist(), zip(range(len(names)), starts.tolist(), ends.tolist())))
        self.key = np.repeat(np.arange(len(names)), ends - starts) * self.size + self.doc
        self.table = [np.arange(len(tid))]
        longest = int((ends - starts).max()) if len(names) else 0
        while 2 << (len(self.table) - 1) <= longest:
            held, step = self.table[-1], 1 << (len(self.table) - 1)
            left, right = held[:-step], held[step:]
            self.table.append(np.where(self.impact[right] > self.impact[left], right, left))

    def greatest(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The place of the greatest impact in each range [a, b) of a list; -1 for an empty one."""
        out = np.full(a.shape, -1, np.int64)
        level = np.frexp(np.maximum(b - a, 0).astype(np.float64))[1] - 1
        for k in range(len(self.table)):
            some = level == k
            if some.any():
                left, right = self.table[k][a[some]], self.table[k][b[some] - (1 << k)]
                out[some] = np.where(self.impact[right] > self.impact[left], right, left)
        return out

    def best(self, query: list[tuple[int, int]], k: int, floor: int, steps: int | None) -> tuple[np.ndarray, np.ndarray, int]:
        """(documents, scores, opened) of the ``k`` best for ``query`` (term, repeats) that score at least ``floor`` (and above 0).

        ``steps``: how often intervals are opened at most; without a bound the answer is exact.
        """
        held = [(*self.lists[t], q) for t, q in query if t in self.lists]
        docs, scores, opened = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        if not held:
            return docs, scores, opened
        number, start, end, repeat = (np.array(x, np.int64) for x in zip(*held))
        floor = max(floor, 1)
        worst = self.size  # the k-th best's document, once there are k

        def measured(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """(bound, document to split at, mask of those worth opening)"""
            top = self.greatest(a, b)
            value = np.where(top >= 0, self.impact[top], 0) * repeat
            at = top[np.arange(len(top)), value.argmax(1)]
            return value.sum(1), self.doc[at]

        low, high = np.array([0]), np.array([self.size])
        a, b = start[None, :], end[None, :]
        bound, split = measured(a, b)
        while len(low):
            useful = (bound > floor) | (bound == floor) & (low < worst)
            if not useful.all():
                low, high, a, b, bound, split = (x[useful] for x in (low, high, a, b, bound, split))
                if not len(low):
                    break
            if steps is not None and opened >= steps * OPENED:
                break
            if len(low) > OPENED:
                first = np.argpartition(-bound, OPENED)
                go, rest = first[:OPENED], first[OPENED:]
            else:
                go, rest = np.arange(len(low)), np.zeros(0, np.int64)
            opened += len(go)
            p = split[go]
            place = np.searchsorted(self.key, number[None, :] * self.size + p[:, None])
            inside = np.minimum(place, len(self.key) - 1)
            hit = (place < b[go]) & (self.doc[inside] == p[:, None])
            docs, scores = np.concatenate([docs, p]), np.concatenate([scores, (np.where(hit, self.impact[inside], 0) * repeat).sum(1)])
            if len(docs) >= k:
                order = np.lexsort((docs, -scores))[:k]
                docs, scores = docs[order], scores[order]
                if scores[-1] >= floor:
                    floor, worst = int(scores[-1]), int(docs[-1])
            sides = np.concatenate([low[go], p + 1]), np.concatenate([p, high[go]]), np.concatenate([a[go], place + hit]), np.concatenate([place, b[go]])
            some = (sides[3] > sides[2]).any(1)
            sides = [x[some] for x in sides]
            if len(sides[0]):
                found = measured(sides[2], sides[3])
                low, high, a, b, bound, split = (np.concatenate([x[rest], y]) for x, y in zip((low, high, a, b, bound, split), (*sides, *found)))
            else:
                low, high, a, b, bound, split = (x[rest] for x in (low, high, a, b, bound, split))
        keep = scores >= floor if steps is None else scores > 0
        order = np.lexsort((docs[keep], -scores[keep]))[:k]
        return docs[keep][order], scores[keep][order], opened


FOUND = "item long, score long, doc_id long, row long, opened long"


def _block(rows: pd.DataFrame, queries: list[tuple[int, int, list[tuple[int, int]]]], weights: dict[int, int], docs: int, words: int, k: int, steps: int | None) -> pd.DataFrame:
    block, out = Block(rows, weights, docs, words), []
    for item, floor, query in queries:
        at, scores, opened = block.best(query, k, floor, steps)
        out.extend((item, s, None if pd.isna(d) else int(d), int(r), opened) for s, d, r in zip(scores.tolist(), block.doc_id[at].tolist(), block.row[at].tolist()))
    return pd.DataFrame(out, columns=["item", "score", "doc_id", "row", "opened"]).astype({"doc_id": "Int64"})


def _slices(wanted: DataFrame, size: int) -> Iterator[tuple[list[tuple[int, list[tuple[int, int]]]], DataFrame]]:
    """Queries with their terms, about ``size`` at a time, and the table of those terms."""
    slices = -(-wanted.select("item").distinct().count() // size)
    for s in range(slices):
        some = wanted.filter(F.pmod(F.xxhash64("item"), F.lit(slices)) == s)
        rows = some.groupBy("item").agg(F.sort_array(F.collect_list(F.struct("tid", "q"))).alias("terms")).collect()
        yield [(r["item"], [(t["tid"], t["q"]) for t in r["terms"]]) for r in rows], some.select("tid").distinct()


def _searched(blocks: DataFrame, queries: list, floors: dict[int, int], weights: dict[int, int], docs: int, words: int, k: int, steps: int | None) -> DataFrame:
    """The best documents of each block for each query, stored."""
    asked = [(i, floors.get(i, 0), t) for i, t in queries]
    find = partial(_block, queries=asked, weights=weights, docs=docs, words=words, k=k, steps=steps)
    return stored(blocks.groupBy("part", "block").applyInPandas(lambda rows: find(rows), FOUND), "found")


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score of the ``k`` best documents (doc_id, text) for each of ``items`` (item_id, text).

    Terms are the longest stretches of ASCII letters and digits and characters beyond ASCII, A-Z lower-cased. Scores are
    whole numbers: each of the item's terms, repeats included, adds its weight times the saturated number of times that
    the document holds it; the weight falls with the number of documents that hold the term, and saturation with the
    document's length. Documents that score 0 are left out; equal scores go by doc_id, nulls first.

    A null or empty text has no terms. Repeated rows, and rows that share an id, are documents of their own, and
    items likewise. An empty table on either side gives no rows; other columns aren't read. A document's rows are as many as the
    different query terms in it, however long it is; queries are sent to the blocks ``TOGETHER`` at a time.
    """
    spark = docs.sparkSession
    asked = stored(items.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").alias("item_id"), text_or_empty().alias("text")), "items")
    each = asked.select("item", F.explode(terms(F.col("text"))).alias("term")).withColumn("term", _lower(F.col("term"))).groupBy("item", "term").agg(F.count(F.lit(1)).alias("q"))
    vocabulary = stored(each.select("term").distinct().select("term", (F.monotonically_increasing_id() + 1).alias("tid")), "vocabulary")
    wanted = stored(each.join(vocabulary, "term").select("item", "tid", "q"), "wanted")
    lists = postings(docs, vocabulary)
    total = lists.filter("tid = 0 AND n > 0").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("words")).first()
    rows, words = total["docs"], total["words"] or 0
    frequency = lists.filter("tid > 0").groupBy("tid").agg(F.count(F.lit(1)).alias("df"))
    weight = stored(frequency.select("tid", F.floor(1000 * F.log((2.0 * rows + 2) / (2 * F.col("df") + 1))).alias("w")), "weights")
    blocks = lists.withColumns({"part": F.shiftright("row", 33), "block": F.floor(F.col("row").bitwiseAND((1 << 33) - 1) / BLOCK)})
    found = spark.createDataFrame([], FOUND)
    for queries, used in _slices(wanted, TOGETHER):
        weights = {r["tid"]: r["w"] for r in weight.join(used, "tid", "left_semi").collect()}
        probed = _searched(blocks, queries, {}, weights, rows, words, k, PROBES)
        floors = {r["item"]: r["score"] for r in _ranked(probed, k).filter(F.col("rank") == k).collect()}
        discard(probed)
        found = found.unionByName(_searched(blocks, queries, floors, weights, rows, words, k, None))
    return _ranked(found, k).join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of each item, with their rank."""
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
