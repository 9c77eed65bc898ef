"""Approximate nearest neighbours by inverted lists and an adaptive dimension scan.

Vectors are rotated by a fixed random orthogonal matrix, so that any first ``d`` coordinates estimate a squared distance
as (D/d) times their part, with an error that shrinks as d grows. Every row is filed under the list of its nearest
centroid, as its rotated column blocks beside the original vector, and stays where it was read. Centroids come from a
bounded sample, and the sample also tells how many of the lists nearest to a query hold ``RECALL`` of its neighbours: few
where vectors lie in clusters, many where they lie evenly.

Queries are brought to the rows, ``QUERIES`` at a time, in two passes. Each query has a bound from the start, the
distance of its k-th neighbour in the sample. The first pass scans its nearest list, which tightens the bound; the second
one scans the other probed lists, and what it finds tightens the bound for the rows after it. In a list candidates are
scanned block by block: one whose partial distance exceeds the bound by the test's margin is abandoned; what is left is
measured exactly on the original vectors in double precision.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taxaspark.llm.common import release_memory, stored

#: Rows that centroids are fitted on, at most; lists, at most, so that each has some twenty rows of the sample; queries of a round.
SAMPLE, LISTS, QUERIES = 20_000, 1024, 20_000
#: Share of a sample query's neighbours in the sample that the probed lists must hold, and the sample queries.
RECALL, ASKED = 0.95, 500
#: Coordinates of a block, pairs that are scanned at once, and the margin of the abandon test (in its standard errors).
BLOCK, PAIRS, EPSILON = 16, 1 << 20, 2.1
SEED = 20


def rotation(dim: int) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _nearest_lists(x: np.ndarray, centers: np.ndarray, probes: int) -> np.ndarray:
    """The ``probes`` nearest centroids of each row, nearest first."""
    out = [np.zeros((0, probes), np.int32)]
    for at in range(0, len(x), 2000):
        d = (centers**2).sum(1) - 2 * x[at : at + 2000] @ centers.T
        out.append((d.argmin(1)[:, None] if probes == 1 else np.argsort(d, axis=1, kind="stable")[:, :probes]).astype(np.int32))
    return np.concatenate(out)


def centroids(sample: np.ndarray, lists: int = LISTS, rounds: int = 8) -> np.ndarray:
    """k-means centroids of ``sample``; fewer distinct rows than lists give that many centroids."""
    distinct = np.unique(sample, axis=0)
    k = min(lists, len(distinct))
    c = distinct[np.sort(np.random.default_rng(SEED).choice(len(distinct), k, replace=False))]
    for _ in range(rounds):
        near = _nearest_lists(sample, c, 1)[:, 0]
        sums = np.zeros_like(c)
        np.add.at(sums, near, sample)
        n = np.bincount(near, minlength=k)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def probes_for(sample: np.ndarray, centers: np.ndarray, k: int, recall: float = RECALL) -> int:
    """How many lists a query must visit for ``recall`` of its ``k`` neighbours, judged by rows of the sample among the sample.

    Neighbours in the whole table lie closer than those in a sample, and so more often in the nearest lists.
    """
    asked, k = sample[:: max(1, len(sample) // ASKED)], min(k, len(sample) - 1)
    if k < 1:
        return len(centers)
    home, step, ranks = _nearest_lists(sample, centers, 1)[:, 0], max(1, len(sample) // ASKED), []
    for i, q in enumerate(asked):
        d = ((sample - q) ** 2).sum(1)
        d[i * step] = np.inf
        place = np.empty(len(centers), np.int64)
        place[_nearest_lists(q[None], centers, len(centers))[0] if len(centers) > 1 else [0]] = np.arange(len(centers))
        ranks.append(place[home[np.argpartition(d, k - 1)[:k]]])
    return int(np.sort(np.concatenate(ranks))[math.ceil(recall * k * len(asked)) - 1]) + 1


def valid(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id, v (array<double>) of the rows that take part: no null, non-finite or all-zero vector, no null vec_id.

    Vectors of another length than the most frequent one (of equally frequent ones the shortest) take no part either.
    """
    v = F.col(vector).cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    rows = rows.filter(~bad & F.exists("v", lambda x: x != 0))
    most = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    return rows.filter(F.size("v") == (most["d"] if most else 0))


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    return batch["v"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _file(batches, centers: np.ndarray, turn: np.ndarray):
    """vec_id, list, v (the vector's bytes) and blocks (the bytes of its rotated blocks) of each row."""
    for batch in batches:
        if batch.num_rows:
            x = _rows(batch)
            r = x @ turn
            blocks = [pa.array([row.tobytes() for row in np.ascontiguousarray(r[:, a : a + BLOCK])], pa.binary()) for a in range(0, x.shape[1], BLOCK)]
            yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array(_nearest_lists(x, centers, 1)[:, 0]), pa.array([row.tobytes() for row in x], pa.binary()), *blocks], ["vec_id", "list", "v", *[f"block{i}" for i in range(len(blocks))]])
    release_memory()


def _sample_bounds(x: np.ndarray, own: np.ndarray, sample: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The distance of each row's ``k``-th neighbour in the sample, whose ids differ; infinite if there are fewer."""
    out = np.full(len(x), np.inf)
    if len(sample) <= k:
        return out
    for at in range(0, len(x), 500):
        d = (sample**2).sum(1) - 2 * x[at : at + 500] @ sample.T
        d[own[at : at + 500, None] == ids[None, :]] = np.inf
        near = np.argpartition(d, k - 1, axis=1)[:, :k]
        out[at : at + 500] = np.sqrt(((sample[near] - x[at : at + 500, None, :]) ** 2).sum(2).max(1))
    return out


def _ask(batches, centers: np.ndarray, probes: int, sample: np.ndarray, ids: np.ndarray, k: int):
    """vec_id, v (bytes), lists, bound: the lists that each query visits, and the bound that it starts with."""
    for batch in batches:
        if batch.num_rows:
            x = _rows(batch)
            bound = _sample_bounds(x, batch["vec_id"].to_numpy(), sample, ids, k)
            yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array([row.tobytes() for row in x], pa.binary()), pa.array(list(_nearest_lists(x, centers, probes)), pa.list_(pa.int32())), pa.array(bound)], ["vec_id", "v", "lists", "bound"])


def survivors(blocks: list[np.ndarray], turned: np.ndarray, bound: np.ndarray, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray, int]:
    """(rows, queries, abandoned): the pairs that no test abandons.

    ``blocks``: rotated columns of the rows; ``turned``: the rotated queries; ``bound``: the distance beyond which a row is of
    no use to a query. After each block but the last a pair goes if its part is above the bound's share, widened by the margin.
    """
    dim, most = turned.shape[1], bound**2
    slack = 1e-9 * (turned**2).sum(1)  # rotating rounds: equal vectors may lie a little apart
    i = j = part = None
    done = 0
    for b in blocks:
        width = b.shape[1]
        q = turned[:, done : done + width]
        done += width
        limit = slack + (most * (done / dim) * (1 + epsilon / np.sqrt(done)) ** 2 if done < dim else most * (1 + 1e-9))
        if i is None:
            first = (b**2).sum(1)[:, None] + (q**2).sum(1)[None, :] - 2 * b @ q.T
            i, j = np.nonzero(first <= limit[None, :] + 1e-9)
            part = first[i, j]
        else:
            part = part + ((b[i] - q[j]) ** 2).sum(1)
            keep = part <= limit[j] + 1e-9
            i, j, part = i[keep], j[keep], part[keep]
    return i, j, len(blocks[0]) * len(turned) - len(i)


class Asked:
    """The queries of a round, as tasks read them from the stored table."""

    def __init__(self, files: tuple[str, ...], turn: np.ndarray):
        tables = []
        for f in files:
            system, path = fs.FileSystem.from_uri(f)
            tables.append(pq.read_table(path, filesystem=system))
        table = pa.concat_tables(tables)
        self.ids = table["vec_id"].to_numpy()
        self.q = np.frombuffer(b"".join(table["v"].to_pylist()), np.float64).reshape(len(self.ids), -1)
        self.turned = self.q @ turn
        self.bound = table["bound"].to_numpy().copy()
        lists = np.stack(table["lists"].to_pylist()) if len(self.ids) else np.zeros((0, 1), np.int32)
        self.near, self.far = lists[:, 0], lists[:, 1:]

    def visiting(self, first: bool) -> dict[int, np.ndarray]:
        """The queries that visit each list, as their nearest one or as another one."""
        at = self.near[:, None] if first else self.far
        flat = at.ravel()
        order = np.argsort(flat, kind="stable")
        lists, starts = np.unique(flat[order], return_index=True)
        return {int(x): order[a:b] // at.shape[1] for x, a, b in zip(lists, starts, np.append(starts[1:], len(order)))}


def _scan(batches, files: tuple[str, ...], turn: np.ndarray, k: int, first: bool):
    """query_id, vec_id, score of the pairs within the bounds; no more than ``k`` for each query and batch."""
    asked, visits, best = Asked(files, turn), None, {}
    visits = asked.visiting(first)
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        matrix = lambda c: np.frombuffer(b"".join(batch[c].to_pylist()), np.float64).reshape(n, -1)  # noqa: B023, E731
        x, blocks = matrix("v"), [matrix(c) for c in batch.schema.names if c.startswith("block")]
        ids, lists = batch["vec_id"].to_numpy(), batch["list"].to_numpy()
        order = np.argsort(lists, kind="stable")
        out: list[tuple[np.ndarray, ...]] = []
        for rows in np.split(order, np.flatnonzero(np.diff(lists[order])) + 1):
            queries = visits.get(int(lists[rows[0]]))
            if queries is None:
                continue
            for at in range(0, len(rows), step := max(1, PAIRS // len(queries))):
                some = rows[at : at + step]
                i, j, _ = survivors([b[some] for b in blocks], asked.turned[queries], asked.bound[queries])
                i, j = some[i], queries[j]
                dist = np.sqrt(((x[i] - asked.q[j]) ** 2).sum(1))
                keep = (dist <= asked.bound[j]) & (ids[i] != asked.ids[j])
                i, j, dist = i[keep], j[keep], dist[keep]
                for query in np.unique(j).tolist():
                    mine = j == query
                    held = best.setdefault(query, {})
                    for v, d in zip(ids[i[mine]].tolist(), dist[mine].tolist()):
                        held[v] = min(d, held.get(v, d))
                    if len(held) >= k:
                        near = sorted((d, v) for v, d in held.items())[:k]
                        best[query] = {v: d for d, v in near}
                        asked.bound[query] = min(asked.bound[query], near[-1][0])
                out.append((j, ids[i], dist))
        if out:
            j, v, dist = (np.concatenate(c) for c in zip(*out))
            keep = dist <= asked.bound[j]
            order = np.lexsort((v[keep], dist[keep], j[keep]))
            j, v, dist = j[keep][order], v[keep][order], dist[keep][order]
            yield pa.RecordBatch.from_arrays([pa.array(asked.ids[j]), pa.array(v), pa.array(dist)], ["query_id", "vec_id", "score"])
    release_memory()


FOUND = "query_id long, vec_id long, score double"


def _first(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest of each query, each vec_id once."""
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, lists: int | None = None, probes: int | None = None, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` nearest rows found for each query, its own row left out.

    ``vectors`` and ``queries``: vec_id, v as ``valid`` gives them, all of one length. Ties go to the smaller vec_id.
    Repeated vectors are candidates like others; of rows with one vec_id the nearest counts, and queries
    with one vec_id are one. No rows give no rows; other
    columns aren't read. ``lists`` and ``probes``: see above; as many probes as lists, and an abandon test without a miss,
    would be exact. Rows are filed once and never shuffled; a round's queries are read by every task.
    """
    spark = vectors.sparkSession
    fit = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("vec_id", "v").toPandas().drop_duplicates("vec_id")
    if not len(fit):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    fitted, ids = np.stack(fit["v"]), fit["vec_id"].to_numpy()
    centers = centroids(fitted, lists or max(1, min(LISTS, round(math.sqrt(vectors.count())))))
    probes = min(len(centers), probes or probes_for(fitted, centers, k))
    turn = rotation(centers.shape[1])
    blocks = ", ".join(f"block{i} binary" for i in range(-(-len(turn) // BLOCK)))
    filed = stored(vectors.select("vec_id", "v").mapInArrow(partial(_file, centers=centers, turn=turn), f"vec_id long, list int, v binary, {blocks}"), "lists")
    asking = partial(_ask, centers=centers, probes=probes, sample=fitted, ids=ids, k=k)
    asked = stored(queries.select("vec_id", "v").mapInArrow(asking, "vec_id long, v binary, lists array<int>, bound double"), "asked")
    rounds = -(-asked.count() // QUERIES)
    found = spark.createDataFrame([], FOUND)
    for r in range(rounds):
        these = stored(asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(rounds)) == r), "asked") if rounds > 1 else asked
        scan = lambda table, first: stored(filed.mapInArrow(partial(_scan, files=tuple(table.inputFiles()), turn=turn, k=k, first=first), FOUND), "found")
        near = scan(these, True)
        kth = _first(near, k).filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("kth"))
        bounds = stored(these.join(kth, "vec_id", "left").select("vec_id", "v", "lists", F.least("bound", "kth").alias("bound")), "bounds")
        found = found.unionByName(near)
        if probes > 1:
            found = found.unionByName(scan(bounds, False))
    return _first(found, k).select("query_id", "rank", "vec_id", "score")
