"""Maximal periodic runs of words in each text.

Every run of period ``q`` that is at least ``2 q`` long holds two neighbouring points of the grid of multiples of ``q``.
So for each ``q`` the common extension of words is asked for at neighbouring grid points, forwards and backwards, n log n
questions in all, each answered in constant time: suffixes that start at a difference cover (of any two positions
some short step reaches the cover from both) are sorted, no others; two positions are compared word by word until both
are in the cover, at most ``MOD - 1`` words, and the rest is the least common prefix between the two ranks, from a sparse
table. Tasks take documents of similar length together, so that short ones share the array operations.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxaspark.llm.common import SPACE, let, text_or_empty

#: A perfect difference set, each residue but 0 is the difference of one pair.
MOD, COVER = 31, (1, 5, 11, 24, 25, 27)
#: Fewest words of a run.
LEAST = 12
#: Words of the documents that are searched together (one document may have more), and grid points looked at together.
TOGETHER, POINTS = 1 << 16, 1 << 20
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def _meeting() -> np.ndarray:
    """For each difference of residues: the cover's element that the first of two positions steps to."""
    out = np.full(MOD, COVER[0], np.int64)
    for x in COVER:
        for y in COVER:
            if x != y:
                out[(y - x) % MOD] = x
    return out


MEETING = _meeting()


class Extensions:
    """Longest common extensions to the right of positions in a sequence of numbers above 0."""

    def __init__(self, words: np.ndarray):
        self.n = n = len(words)
        self.words = np.concatenate([words.astype(np.uint32), np.zeros(MOD, np.uint32)])  # 0 ends the sequence
        places = [np.arange(r, n, MOD) for r in COVER]
        #: Number of a residue's first place among all places; a place and the one ``MOD`` further on are neighbours.
        self.first = np.zeros(MOD, np.int64)
        self.first[list(COVER)] = np.cumsum([0, *map(len, places)])[:-1]
        self.place = np.concatenate(places) if n else np.zeros(0, np.int64)
        self.last = np.concatenate([np.full(len(p), e) for p, e in zip(places, np.cumsum([len(p) for p in places]))]) if n else self.place
        self._rank()
        self._prefixes()

    def _rank(self) -> None:
        """Ranks of the blocks at the places, of MOD words, then of twice as many, until all differ."""
        m, wide = len(self.place), self.words.astype(">u4")
        blocks = np.lib.stride_tricks.sliding_window_view(wide, MOD)[self.place] if m else np.zeros((0, MOD), ">u4")
        _, rank = np.unique(np.ascontiguousarray(blocks).view(f"S{4 * MOD}").ravel(), return_inverse=True)
        self.ranks, step = [rank.astype(np.int64)], 1
        while m and self.ranks[-1].max() + 1 < m:
            held, at = self.ranks[-1], np.arange(m) + step
            after = np.where(at < self.last, held[np.minimum(at, m - 1)] + 1, 0)
            _, rank = np.unique(held * (m + 1) + after, return_inverse=True)
            self.ranks.append(rank.astype(np.int64))
            step *= 2
        self.rank = self.ranks[-1]

    def _prefixes(self) -> None:
        """Common prefixes of neighbours in sorted order, and the least ones of 2, 4, ... in a row."""
        order = np.argsort(self.rank, kind="stable")
        a, b = order[:-1].copy(), order[1:].copy()
        size = np.zeros(len(a), np.int64)
        going = np.ones(len(a), bool)  # neither has left its residue's places
        for k in range(len(self.ranks) - 2, -1, -1):
            step, held = 1 << k, self.ranks[k]
            same = going & (held[np.minimum(a, len(held) - 1)] == held[np.minimum(b, len(held) - 1)])
            size += np.where(same, step * MOD, 0)
            ends = (a + step >= self.last[np.minimum(a, len(held) - 1)]) | (b + step >= self.last[np.minimum(b, len(held) - 1)])
            a, b = np.where(same, a + step, a), np.where(same, b + step, b)
            going &= ~(same & ends)
        open_ = np.arange(len(a))
        x, y = self.place[order[:-1]], self.place[order[1:]]
        for _ in range(MOD):
            open_ = open_[self.words[np.minimum(x[open_] + size[open_], self.n)] == self.words[np.minimum(y[open_] + size[open_], self.n)]]
            if not len(open_):
                break
            size[open_] += 1
        self.table = [size]
        while 2 << (len(self.table) - 1) <= len(size):
            held, step = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(held[:-step], held[step:]))

    def _between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefix of the suffixes at places ``a`` and ``b``: the least one between their ranks."""
        low, high = np.minimum(self.rank[a], self.rank[b]), np.maximum(self.rank[a], self.rank[b])
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(a), np.int64)
        for k in np.unique(level):
            some = level == k
            out[some] = np.minimum(self.table[k][low[some]], self.table[k][high[some] - (1 << k)])
        return out

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from ``i`` on equal those from ``j`` on (i and j differ)."""
        out = np.zeros(len(i), np.int64)
        meet = (MEETING[(j - i) % MOD] - i) % MOD
        open_ = np.arange(len(i))
        for step in range(MOD):
            there = meet[open_] == step
            if there.any():
                some = open_[there]
                x, y = i[some] + step, j[some] + step
                inside = np.maximum(x, y) < self.n
                some, x, y = some[inside], x[inside], y[inside]
                out[some] = step + self._between(self.first[x % MOD] + x // MOD, self.first[y % MOD] + y // MOD)
                open_ = open_[~there]
            same = self.words[np.minimum(i[open_] + step, self.n)] == self.words[np.minimum(j[open_] + step, self.n)]
            open_ = open_[same]
            out[open_] = step + 1
            if not len(open_):
                break
        return out


def runs_of(words: np.ndarray, longest: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of the runs of ``words`` (numbers above 0), by start, then period; ``longest``: most words of a text.

    Texts that are searched together are parted by numbers that occur once.
    """
    n, most = len(words), longest // 2
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    ahead = back = None
    q0 = 1
    while q0 <= most:
        q1, points = q0, 0
        while q1 <= most and (q1 == q0 or points + n // q1 <= POINTS):
            points += n // q1
            q1 += 1
        periods = np.arange(q0, q1)
        sizes = np.maximum((n - 1) // periods, 0)
        q = np.repeat(periods, sizes)
        i = (np.arange(len(q)) - np.repeat(np.cumsum(sizes) - sizes, sizes)) * q
        same = words[i] == words[i + q]
        i, q = i[same], q[same]
        if len(i):
            if ahead is None:
                ahead, back = Extensions(words), Extensions(words[::-1])
            forth, behind = ahead.common(i, i + q), back.common(n - i, n - i - q)
            start, size = i - behind, forth + behind + q
            run = size >= np.maximum(least, 2 * q)
            found.append((start[run], size[run], q[run]))
        q0 = q1
    if not found:
        return (np.zeros(0, np.int64),) * 3
    start, size, q = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((q, size, start))  # an interval's smallest period comes first; its multiples fall away
    start, size, q = start[order], size[order], q[order]
    fresh = np.ones(len(start), bool)
    fresh[1:] = (start[1:] != start[:-1]) | (size[1:] != size[:-1])
    start, size, q = start[fresh], size[fresh], q[fresh]
    order = np.lexsort((q, start))
    return start[order], size[order], q[order]


def _groups(sizes: list[int]) -> Iterator[list[int]]:
    """Numbers of documents, those of similar length together."""
    group, held = [], 0
    for i in sorted(range(len(sizes)), key=sizes.__getitem__):
        if group and held + sizes[i] > TOGETHER:
            yield group
            group, held = [], 0
        group.append(i)
        held += sizes[i] + 1
    if group:
        yield group


def _search(texts: list[bytes], least: int) -> list[tuple[int, list[tuple[int, int, int]], bytes]]:
    """(number of words, runs, text without repeats) of each text."""
    split = [t.split() for t in texts]
    out: list = [None] * len(texts)
    for group in _groups([len(w) for w in split]):
        names: defaultdict[bytes, int] = defaultdict(count(1).__next__)
        sizes = np.array([len(split[i]) for i in group], np.int64)
        ends = np.cumsum(sizes + 1)
        starts = ends - sizes - 1
        words = np.zeros(int(ends[-1]), np.int64)
        for i, a in zip(group, starts.tolist()):
            own = split[i]
            words[a : a + len(own)] = np.fromiter(map(names.__getitem__, own), np.int64, len(own))
        words[ends - 1] = len(names) + 1 + np.arange(len(group))
        start, size, q = runs_of(words, int(sizes.max()), least)
        step = np.zeros(len(words) + 1, np.int64)
        np.add.at(step, start + q, 1)
        np.add.at(step, start + size, -1)
        stays = np.cumsum(step[:-1]) == 0
        first = np.searchsorted(start, np.append(starts, len(words))).tolist()
        for k, (i, a, e) in enumerate(zip(group, starts.tolist(), (ends - 1).tolist())):
            x, y = first[k], first[k + 1]
            own = list(zip((start[x:y] - a).tolist(), size[x:y].tolist(), q[x:y].tolist()))
            out[i] = len(split[i]), own, b" ".join(compress(split[i], stays[a:e].tolist()) if own else split[i])
    return out


def _find(batches, least: int):
    for batch in batches:
        for begin in range(0, batch.num_rows, 2000):
            some = batch.slice(begin, 2000)
            done = _search(some["text"].to_pylist(), least)
            runs = [[{"start": a, "length": b, "period": c} for a, b, c in r] for _, r, _ in done]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            yield pa.RecordBatch.from_arrays([some["doc_id"], pa.array([n for n, _, _ in done], pa.int64()), pa.array(runs, kind), pa.array([c.decode() for _, _, c in done], pa.string())], ["doc_id", "n_words", "runs", "collapsed"])


def find_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, runs, collapsed of each whole text of ``docs`` (doc_id, text); words are parted by ASCII white space.

    ``runs``: start, length and period in words of each stretch whose smallest period fits in it twice, that is at least
    ``least`` words long, and that no word beside it extends; by start, then period. ``collapsed``: the words that no run
    holds after its first period, joined by a space. A null or blank text has no words; repeated rows come one by one,
    an empty table gives no rows, other columns aren't read. Memory follows a batch's texts or the longest text.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("text"))
    return rows.mapInArrow(lambda batches: _find(batches, least), f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def with_planted(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text), where the CRC-32 of every tenth document's id makes its words repeat from one on.

    Let h be the CRC-32 of the decimal id and g = floor(h / 10). If h % 10 = 0, of n words each one from a = g % n on is
    replaced by the one at a + (i - a) % p, p = 1 + floor((n - a) / (3 + g % 8)). A null id changes nothing.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words)
        return let(F.struct((g % n).cast("int").alias("a"), n.alias("n")), lambda s: let(F.struct(s["a"].alias("a"), (1 + F.floor((s["n"] - s["a"]) / (3 + g % 8))).cast("int").alias("p")), lambda s: F.array_join(F.transform(words, lambda w, i: F.when(i < s["a"], w).otherwise(F.get(words, s["a"] + (i - s["a"]) % s["p"]))), " ")))

    text = text_or_empty()
    words = F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")
    changed = let(words, lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise(F.lit("")))
    return docs.select("doc_id", F.when(F.coalesce(h % 10 == 0, F.lit(False)), changed).otherwise(text).alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (ties: smallest start, then period), and digests of runs and collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("less"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = F.col("best.length"), -F.col("best.less")
    return out.select("doc_id", "n_runs", (-F.col("best.before")).alias("start"), length.alias("length"), period.alias("period"), F.floor(length * 1000 / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
