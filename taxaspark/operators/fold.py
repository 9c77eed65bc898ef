"""Incremental learning of a concept tree: the one step whose order matters, run in Python workers, one tree for a key.

Rows are dealt by key, sorted by the order column and streamed through ``mapInPandas``, so a key's rows are never
gathered at once; what a worker holds is the tree, in which equal instances share a leaf. A key that holds very many
rows can be learned as ``shards`` trees, each over its own share of the rows.

Ties are settled the same way everywhere: greater utility, then the larger concept, then the older one; of operations
the first of best, new, merge, split.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taxaspark.functions.moments import CORRECTED_UPTO, c4_value

DIGITS = 9
ROOT_SCALE = 1 / (2 * math.sqrt(math.pi))
BLUR = 1 / (4 * math.pi)
#: Children up to which steps of many rows go by arrays, and values from which on a pair's common counts are kept.
WIDE, MANY = 12, 64
C4 = [1.0, 1.0, *(c4_value(n) for n in range(2, CORRECTED_UPTO + 1)), 1.0]


def _std(m: tuple[int, float, float]) -> float:
    n, _, m2 = m
    return 0.0 if n < 2 else math.sqrt(max(0.0, m2) / (n - 1)) / C4[min(n, CORRECTED_UPTO + 1)]


def _with(m: tuple[int, float, float], x: float) -> tuple[int, float, float]:
    n, mean, m2 = m
    step = x - mean
    mean += step / (n + 1)
    return n + 1, mean, m2 + step * (x - mean)


def _both(a: tuple[int, float, float], b: tuple[int, float, float]) -> tuple[int, float, float]:
    n = a[0] + b[0]
    step = b[1] - a[1]
    return n, (a[0] * a[1] + b[0] * b[1]) / n, a[2] + b[2] + step * step * a[0] * b[0] / n


class Concept:
    """Counts ``nominal[attr][value]``, moments ``numeric[attr]``, and the children.

    ``squares`` is the sum of squared counts of visible values, ``attrs`` the number of visible attributes, ``stds`` the
    deviation of each number. ``shared`` holds, for pairs of children with many values, the sum of the products of their
    counts of visible values: first id -> second id -> (second, sum), both ways.
    """

    __slots__ = ("id", "n", "nominal", "numeric", "stds", "squares", "attrs", "children", "parent", "shared")

    def __init__(self, number: int):
        self.id, self.n, self.nominal, self.numeric, self.stds, self.squares, self.attrs, self.children, self.parent, self.shared = number, 0, {}, {}, {}, 0, 0, [], None, {}

    def __getstate__(self) -> tuple:
        return None, {k: getattr(self, k) for k in self.__slots__} | {"shared": {}}  # pairs would make a deep pickle

    def forget(self, child: Concept) -> None:
        """Drops what is kept of pairs with a child that leaves."""
        for other in self.shared.pop(child.id, {}):
            self.shared[other].pop(child.id)


def _visible(x: dict) -> list[tuple]:
    return [(k, v) for k, v in x.items() if k[:1] != "_"]


class Tree:
    """A concept tree that instances (attr -> text or float) are fitted to, one by one."""

    def __init__(self, scaling: float = 0.5, operations: tuple[str, ...] = ("best", "new", "merge", "split")):
        self.scaling, self.operations, self.ids = scaling, operations, 0
        self.scales: dict[str, tuple[int, float, float]] = {}
        self.fixed: dict[str, float] = {}  # scales by attribute, until the next instance
        self.changes = 0  # how often concepts were added or moved
        self.root = self._new()

    def _new(self) -> Concept:
        self.ids += 1
        return Concept(self.ids)

    def scale(self, attr: str) -> float:
        found = self.fixed.get(attr)
        if found is None:
            s = _std(self.scales.get(inner(attr), (0, 0.0, 0.0))) / self.scaling if self.scaling else 1.0
            found = self.fixed[attr] = s if s > 0 else 1.0
        return found

    def _certainty(self, attr: str, n: int, std: float) -> float:
        s = std / self.scale(attr)
        return n * n * ROOT_SCALE / math.sqrt(s * s + BLUR)

    def _whole(self, c: Concept) -> float:
        """Sum of squared counts, and of numbers' certainties, over visible attributes."""
        return c.squares + sum([self._certainty(a, m[0], c.stds[a]) for a, m in c.numeric.items() if a[:1] != "_"]) if c.numeric else c.squares

    def guesses(self, c: Concept, x: dict | None = None) -> float:
        """Size times expected correct guesses of a concept, with ``x`` in it."""
        return self._guesses(c, _visible(x or {}))[x is not None]

    def _guesses(self, c: Concept, x: list[tuple]) -> tuple[float, float]:
        """``guesses`` without and with an instance, of which only what is visible counts."""
        s, a, n = self._whole(c), c.attrs, c.n
        plain = s / (n * a) if n and a else 0.0
        for k, v in x:
            if k not in c.nominal and k not in c.numeric:
                a += 1
            if isinstance(v, float):
                old = c.numeric.get(k)
                new = _with(old or (0, 0.0, 0.0), v)
                s += self._certainty(k, new[0], _std(new)) - (self._certainty(k, old[0], c.stds[k]) if old else 0.0)
            else:
                values = c.nominal.get(k)
                s += 2 * values.get(v, 0) + 1 if values else 1
        return plain, s / ((n + 1) * a) if a else 0.0

    def _all_guesses(self, kids: list[Concept], x: list[tuple]) -> tuple[list[float], list[float]]:
        """``_guesses`` of several concepts; with one number at most, which comes last, by the same operations in one loop."""
        texts = x[:-1] if x and isinstance(x[-1][1], float) else x
        name, number = x[-1] if texts is not x else (None, 0.0)
        if any(isinstance(v, float) for _, v in texts):
            both = [self._guesses(k, x) for k in kids]
            return [b[0] for b in both], [b[1] for b in both]
        scale, sqrt, most = self.scale(name) if name is not None else 1.0, math.sqrt, CORRECTED_UPTO
        plain, new = [], []
        for kid in kids:
            nominal, numeric, n, a, s = kid.nominal, kid.numeric, kid.n, kid.attrs, kid.squares
            if name in numeric and len(numeric) == 1 and name not in nominal:
                had, mean, m2 = numeric[name]
                spread = kid.stds[name] / scale
                before = had * had * ROOT_SCALE / sqrt(spread * spread + BLUR)
                s += before
            elif numeric or name in nominal or not n or not a:
                p, q = self._guesses(kid, x)
                plain.append(p)
                new.append(q)
                continue
            else:
                had, mean, m2, before = 0, 0.0, 0.0, 0.0
            plain.append(s / (n * a))
            for k, v in texts:
                if k in nominal:
                    values = nominal[k]
                    s += 2 * values[v] + 1 if v in values else 1
                else:
                    s += 1
                    a += k not in numeric
            if name is not None:
                now = had + 1
                if had:
                    step = number - mean
                    m2 += step * (number - (mean + step / now))
                    spread = (sqrt(m2 / had) / C4[now if now <= most else -1] if m2 > 0.0 else 0.0) / scale
                    s += now * now * ROOT_SCALE / sqrt(spread * spread + BLUR) - before
                else:
                    a += 1
                    s += ROOT_SCALE / sqrt(BLUR)
            new.append(s / ((n + 1) * a))
        return plain, new

    def _common(self, c: Concept, other: Concept) -> int:
        """Sum of the products of two concepts' counts of visible values, which siblings of many values keep with their parent."""
        kept = c.parent.shared if c.parent is not None and c.parent is other.parent and min(max(map(len, d.nominal.values()), default=0) for d in (c, other)) >= MANY else None
        if kept is not None and other.id in kept.get(c.id, {}):
            return kept[c.id][other.id][1]
        s = 0
        for k, values in other.nominal.items():
            mine = c.nominal.get(k)
            if mine and k[:1] != "_":
                few, many = (values, mine) if len(values) < len(mine) else (mine, values)
                s += sum(n * many[v] for v, n in few.items() if v in many)
        if kept is not None:
            kept.setdefault(c.id, {})[other.id] = other, s
            kept.setdefault(other.id, {})[c.id] = c, s
        return s

    def fused_guesses(self, c: Concept, other: Concept, x: dict) -> float:
        """``guesses`` of two concepts as one, with ``x`` in it; looks only at what they share."""
        s = c.squares + other.squares + 2 * self._common(c, other)
        moments = dict(c.numeric)
        for k, m in other.numeric.items():
            moments[k] = _both(moments[k], m) if k in moments else m
        names = {k for t in (c.nominal, other.nominal, moments, x) for k in t if k[:1] != "_"}
        for k, v in x.items():
            if k[:1] == "_":
                continue
            if isinstance(v, float):
                moments[k] = _with(moments.get(k, (0, 0.0, 0.0)), v)
            else:
                s += 2 * (c.nominal.get(k, {}).get(v, 0) + other.nominal.get(k, {}).get(v, 0)) + 1
        s += sum([self._certainty(k, m[0], _std(m)) for k, m in moments.items() if k[:1] != "_"])
        return s / ((c.n + other.n + 1) * len(names)) if names else 0.0

    def add(self, c: Concept, x: dict) -> None:
        c.n += 1
        nominal, numeric = c.nominal, c.numeric
        for k, v in x.items():
            shown = k[:1] != "_"
            if shown and k not in nominal and k not in numeric:
                c.attrs += 1
            if isinstance(v, float):
                m = numeric[k] = _with(numeric.get(k, (0, 0.0, 0.0)), v)
                c.stds[k] = _std(m)
            elif (values := nominal.get(k)) is None:
                nominal[k] = {v: 1}
                c.squares += shown
            else:
                n = values.get(v, 0)
                values[v] = n + 1
                c.squares += 2 * n + 1 if shown else 0

    def absorb(self, c: Concept, other: Concept) -> None:
        c.n += other.n
        c.attrs += sum(k[:1] != "_" and k not in c.nominal and k not in c.numeric for k in {*other.nominal, *other.numeric})
        for k, values in other.nominal.items():
            mine, shown = c.nominal.setdefault(k, {}), k[:1] != "_"
            for v, n in values.items():
                old = mine.get(v, 0)
                mine[v] = old + n
                c.squares += n * (2 * old + n) if shown else 0
        for k, m in other.numeric.items():
            c.numeric[k] = _both(c.numeric[k], m) if k in c.numeric else m
            c.stds[k] = _std(c.numeric[k])

    def exact(self, c: Concept, x: dict) -> bool:
        """Whether every visible attribute on either side has one value throughout, the instance's."""
        for k in {*c.nominal, *c.numeric, *x}:
            if k[:1] == "_":
                continue
            v, m = x.get(k), c.numeric.get(k)
            if isinstance(v, float):
                if m is None or k in c.nominal or m[0] != c.n or _std(m) != 0 or m[1] != v:
                    return False
            elif v is None or m is not None or c.nominal.get(k, {}).get(v) != c.n:
                return False
        return True

    def two_best(self, c: Concept, x: dict) -> list[Concept]:
        return [c.children[i] for i in self._two_best(c, *self._all_guesses(c.children, _visible(x)))]

    def _two_best(self, c: Concept, plain: list[float], new: list[float]) -> list[int]:
        """Places of the two best children."""
        gains, kids = [b - a for a, b in zip(plain, new)], c.children
        if len(gains) < 2:
            return [0] * len(gains)
        least = sorted(gains)[-2] - 4 * 10**-DIGITS
        ranks = [(-round(g, DIGITS), -kids[i].n, kids[i].id, i) for i, g in enumerate(gains) if g >= least]
        ranks.sort()
        return [r[3] for r in ranks[:2]]

    def _choose(self, c: Concept, x: dict, seen: list[tuple], best: list[int], plain: list[float], new: list[float], single: float, own: tuple[float, float] | None) -> tuple[str, tuple[list[float], list[float]] | None]:
        """The operation of greatest utility, sum of the children's weighted guesses over their number; and the guesses of the best child's children.

        ``single``: the guesses of a concept of the instance alone; ``own``: those of ``c`` without and with it, if known.
        """
        total, k, n, first, inside = sum(plain), len(c.children), c.n + 1, c.children[best[0]], None
        up_plain, up = own or self._guesses(c, seen)
        scores = [("best", (total - plain[best[0]] + new[best[0]] - up) / (n * k)), ("new", (total + single - up) / (n * (k + 1)))]
        if k > 2:
            scores.append(("merge", (total - plain[best[0]] - plain[best[1]] + self.fused_guesses(first, c.children[best[1]], x) - up) / (n * (k - 1))))
        if first.children:
            inside = self._all_guesses(first.children, seen)
            scores.append(("split", (total - plain[best[0]] + sum(inside[0]) - up_plain) / (c.n * (k - 1 + len(first.children)))))
        found, most = "best", -math.inf
        for o, score in scores:
            if o in self.operations and (score := round(score, DIGITS + 3)) > most:
                found, most = o, score
        return found, inside

    def _single(self, seen: list[tuple]) -> float:
        return self._guesses(Concept(0), seen)[1]

    def _child(self, parent: Concept, x: dict) -> Concept:
        c = self._new()
        c.parent = parent
        parent.children.append(c)
        self.add(c, x)
        return c

    def fit(self, x: dict) -> Concept:
        """Place an instance; returns its leaf."""
        for k, v in x.items():
            if isinstance(v, float):
                self.scales[inner(k)] = _with(self.scales.get(inner(k), (0, 0.0, 0.0)), v)
        self.fixed.clear()
        seen = _visible(x)
        single, known, own = self._single(seen), None, None  # known, own: guesses of at's children, and of at, none of which this row has changed
        at = self.root
        while True:
            if not at.children and (at.n == 0 or self.exact(at, x)):
                self.add(at, x)
                return at
            if not at.children:
                self.changes += 1
                up = self._new()
                self.absorb(up, at)
                up.parent, up.children = at.parent, [at]
                if at.parent is None:
                    self.root = up
                else:
                    at.parent.children[at.parent.children.index(at)] = up
                    at.parent.forget(at)
                at.parent = up
                self.add(up, x)
                return self._child(up, x)
            plain, new = known or self._all_guesses(at.children, seen)
            places = self._two_best(at, plain, new)
            todo, known = self._choose(at, x, seen, places, plain, new, single, own)
            best = [at.children[i] for i in places]
            self.changes += todo != "best"
            if todo == "split":
                at.forget(best[0])
                rest = [k for k in at.children if k is not best[0]]
                known = tuple([*v[: places[0]], *v[places[0] + 1 :], *inner_v] for v, inner_v in zip((plain, new), known))
                for g in best[0].children:
                    g.parent = at
                at.children = rest + best[0].children
                continue
            self.add(at, x)
            if todo == "new":
                return self._child(at, x)
            if todo == "merge":
                known = tuple([v[i] for i in places] for v in (plain, new))
                fused = self._new()
                fused.parent, fused.children = at, best
                for b in best:
                    self.absorb(fused, b)
                    b.parent = fused
                    at.forget(b)
                at.children = [k for k in at.children if k not in best] + [fused]
                at, own = fused, None
            else:
                self._joins(at, best[0], seen)
                at, own = best[0], (plain[places[0]], new[places[0]])

    def _joins(self, at: Concept, child: Concept, seen: list[tuple], times: int = 1) -> None:
        """Keeps what is kept of a child's pairs up to date, as an instance joins it."""
        kept = at.shared.get(child.id, {})
        for other, s in list(kept.values()):
            s += times * sum(other.nominal.get(k, {}).get(v, 0) for k, v in seen if isinstance(v, str))
            kept[other.id], at.shared[other.id][child.id] = (other, s), (child, s)

    def categorize(self, x: dict) -> Concept:
        at = self.root
        while at.children:
            at = self.two_best(at, x)[0]
        return at

    def rows(self, key: str) -> Iterator[dict]:
        """The tree as rows of tree, concept, parent, depth, n, path, nominal and numeric (JSON)."""
        todo = [(self.root, [])]
        while todo:
            c, path = todo.pop()
            path = [*path, c.id]
            yield {"tree": key, "concept": c.id, "parent": path[-2] if len(path) > 1 else None, "depth": len(path) - 1, "n": c.n, "path": path, "nominal": json.dumps(c.nominal, sort_keys=True), "numeric": json.dumps({k: list(m) for k, m in c.numeric.items()}, sort_keys=True)}
            todo += [(k, path) for k in reversed(c.children)]


class Bulk:
    """Learns names many rows at a time; the tree is the one that learning row by row gives.

    If all instances have the same visible attributes and no numbers, what a concept's children hold as each of the next
    rows arrives are running sums, as long as instances of equal values go on to the same leaf. Those sums give every
    row's utilities. The rows before the first one that would, or might by a rounding, be placed otherwise are
    added at once; that one is learned by itself, and paths end with any change of the tree's shape.
    """

    START, MOST, FEW, MANY_ROWS, LONG, BACK_OFF = 512, 4096, 64, 1 << 15, 1 << 24, 2000
    GAP, UTILITY_GAP = 4e-8, 1e-11

    def __init__(self, tree: Tree):
        self.tree, self.names, self.numbers, self.possible = tree, None, {}, tree.operations == ("best", "new", "merge", "split")
        self.instances: list[dict] = []
        self.values: dict[str, dict[str, int]] = {}  # attribute -> value -> its number
        self.columns: dict[str, list[int]] = {}  # attribute -> each instance's value, by number
        self.paths: dict[int, list[Concept]] = {}
        self.changes, self.wait, self.size = 0, self.START, self.FEW

    def number(self, text: str | None) -> int:
        """The number of an instance's values, which are given as JSON."""
        found = self.numbers.get(text)
        if found is None:
            x = instance(json.loads(text or "{}"), None)
            found = self.numbers[text] = len(self.instances)
            self.instances.append(x)
            names = sorted(k for k, _ in _visible(x))
            self.names = names if self.names is None else self.names
            self.possible = self.possible and bool(names) and names == self.names and found < self.MOST
            for k in self.names if self.possible else ():
                values = self.values.setdefault(k, {})
                self.columns.setdefault(k, []).append(values.setdefault(x[k], len(values)))
        return found

    def fit(self, x: dict) -> None:
        """A row that may be anything; after a number, or a row with other attributes, there are no more steps of many rows."""
        self.possible = False
        self.tree.fit(x)

    def _look(self, p: int) -> bool:
        """Finds the path of an instance, if it changes no concept's place."""
        x, at, path = self.instances[p], self.tree.root, []
        seen = _visible(x)
        single, known, own = self.tree._single(seen), None, None
        while at.children:
            plain, new = known or self.tree._all_guesses(at.children, seen)
            best = self.tree._two_best(at, plain, new)
            todo, known = self.tree._choose(at, x, seen, best, plain, new, single, own)
            if todo != "best":
                return False
            path.append(at)
            at, own = at.children[best[0]], (plain[best[0]], new[best[0]])
        if not self.tree.exact(at, x):
            return False
        self.paths[p] = [*path, at]
        return True

    def _add(self, p: int, times: int) -> None:
        x, path = self.instances[p], self.paths[p]
        seen = _visible(x)
        for at, child in zip(path, path[1:]):
            self.tree._joins(at, child, seen, times)
        for c in path:
            c.n += times
            for k, v in x.items():
                values = c.nominal.setdefault(k, {})
                n = values.get(v, 0)
                values[v] = n + times
                c.squares += times * (2 * n + times) if k[:1] != "_" else 0

    def _first(self, gain: np.ndarray, n: np.ndarray, ids: np.ndarray, child: np.ndarray) -> np.ndarray:
        """For each row and child, whether the row's own child surely comes before it: by its rounded gain, then size, then age.

        Gains are the same numbers as row by row (sums below 2 ** 53); a rounding that is a close call settles nothing.
        """
        rows = np.arange(len(child))
        mine = lambda v: v[rows, child][:, None]
        units = gain * 10.0**DIGITS
        whole, clear = np.rint(units), np.abs(units - np.floor(units) - 0.5) > 1e-3
        both = clear & mine(clear)
        equal = (gain == mine(gain)) | both & (whole == mine(whole))
        return (mine(gain) - gain > self.GAP) | both & (mine(whole) > whole) | equal & ((mine(n) > n) | (mine(n) == n) & (ids[child][:, None] < ids))

    def _stays(self, best: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Whether ``best`` surely is the operation, not the other one: its rounded utility is no smaller.

        Utilities may differ from those of row by row by some 1e-15, a thousandth of the last digit that is kept.
        """
        mine, its = (v * 10.0 ** (DIGITS + 3) for v in (best, other))
        clear = lambda v: np.abs(v - np.floor(v) - 0.5) > 0.02
        return (best - other > self.UTILITY_GAP) | clear(mine) & clear(its) & (np.rint(mine) >= np.rint(its))

    def _level(self, c: Concept, codes: np.ndarray, child: np.ndarray, inner_total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For rows that go through ``c`` into its children of places ``child``: whether each is sure to, and the children's guesses before it.

        ``inner_total``: the guesses of the child's own children before the row, NaN if it has none.
        """
        kids, m, a = c.children, len(codes), len(self.names)
        into = np.zeros((m, len(kids)), np.int64)
        rows = np.arange(m)
        into[rows, child] = 1
        before = lambda v: np.cumsum(v, axis=0) - v
        own, mine = np.zeros((m, len(kids)), np.int64), np.zeros(m, np.int64)  # counts of the row's values in the children, in c
        for name in self.names:
            values, code = self.values[name], np.array(self.columns[name], np.int16)[codes]
            order = np.argsort(code, kind="stable")
            code = code[order]
            first = np.searchsorted(code, np.arange(len(values)))[code]
            runs = before(into[order])
            held = np.array([[k.nominal.get(name, {}).get(v, 0) for k in kids] for v in values], np.int64)
            own[order] += runs - runs[first] + held[code]
            mine[order] += rows - first + np.array([c.nominal.get(name, {}).get(v, 0) for v in values], np.int64)[code]
        n = np.array([k.n for k in kids]) + before(into)
        s = np.array([k.squares for k in kids]) + before(into * (2 * own + a))
        plain, new = s / (n * a), (s + 2 * own + a) / ((n + 1) * a)
        n_c, s_c = c.n + rows, c.squares + before(2 * mine + a)
        up_plain, up = s_c / (n_c * a), (s_c + 2 * mine + a) / ((n_c + 1) * a)
        gain, total, k = new - plain, plain.sum(axis=1), len(kids)
        others = into == 0
        other = np.where(others, gain, -np.inf)
        sure = (self._first(gain, n, np.array([d.id for d in kids]), child) | ~others).all(axis=1)
        best = (total - plain[rows, child] + new[rows, child] - up) / ((n_c + 1) * k)
        sure &= self._stays(best, (total + 1.0 - up) / ((n_c + 1) * (k + 1)))
        with np.errstate(invalid="ignore"):
            split = (total - plain[rows, child] + inner_total - up_plain) / (n_c * (k - 1 + np.array([len(d.children) for d in kids])[child]))
            sure &= np.isnan(split) | self._stays(best, split)
        if k > 2:
            pair = into[:, :, None] * own[:, None, :]
            product = np.array([[self.tree._common(d, e) if d is not e else 0 for e in kids] for d in kids]) + before(pair + pair.transpose(0, 2, 1))
            row = lambda v: v[rows, child][:, None]
            fused = (row(s) + s + 2 * product[rows, child] + 2 * (row(own) + own) + a) / ((row(n) + n + 1) * a)
            merged = (total[:, None] - row(plain) - plain + fused - up[:, None]) / ((n_c + 1) * (k - 1))[:, None]
            second = others & (other >= other.max(axis=1)[:, None] - self.GAP)
            sure &= (self._stays(best[:, None], merged) | ~second).all(axis=1)
        return sure, total

    def _sure(self, codes: np.ndarray) -> int:
        """How many of the rows, all with paths, are sure to take them."""
        paths = {p: self.paths[p] for p in np.unique(codes).tolist()}
        deepest = max(map(len, paths.values()))
        sure, totals = np.ones(len(codes), bool), np.full(len(codes), np.nan)
        for depth in range(deepest - 2, -1, -1):
            number, place, nodes = np.full(len(self.instances), -1), np.zeros(len(self.instances), np.int64), {}
            for p, path in paths.items():
                if len(path) > depth + 1:
                    number[p] = nodes.setdefault(path[depth].id, (len(nodes), path[depth]))[0]
                    place[p] = path[depth].children.index(path[depth + 1])
            at = number[codes]
            for i, c in nodes.values():
                rows = np.flatnonzero(at == i)
                if len(c.children) > WIDE or c.n + len(rows) > self.LONG:
                    sure[rows] = False
                else:
                    sure[rows], totals[rows] = (lambda ok, t: (sure[rows] & ok, t))(*self._level(c, codes[rows], place[codes[rows]], totals[rows]))
        return len(codes) if sure.all() else int(np.argmin(sure))

    def learn(self, codes: np.ndarray) -> None:
        """Rows by their numbers, in order."""
        at, tries, done = 0, 0, 0
        while at < len(codes):
            if self.wait > 0 or not self.possible:
                self.tree.fit(self.instances[codes[at]])
                self.wait, at = self.wait - 1, at + 1
                continue
            self.tree.fixed.clear()
            if self.changes != self.tree.changes:
                self.paths.clear()
                self.changes = self.tree.changes
            ahead = codes[at : at + self.size]
            lost = [p for p in np.unique(ahead).tolist() if p not in self.paths and not self._look(p)]
            if lost:
                ahead = ahead[: int(np.argmax(np.isin(ahead, lost)))]
            n = self._sure(ahead) if len(ahead) else 0
            for p, times in enumerate(np.bincount(ahead[:n])):
                if times:
                    self._add(p, int(times))
            at, tries, done = at + n, tries + 1, done + n
            self.size = min(2 * self.size, self.MANY_ROWS) if n == len(ahead) and not lost else max(self.FEW, 2 * n)
            if n < len(ahead) or lost:
                self.paths.pop(int(codes[at]), None)
                self.tree.fit(self.instances[codes[at]])
                at += 1
            if tries == 32:  # few rows at a time aren't worth the looking ahead
                self.wait, tries, done = (self.BACK_OFF if done < 32 * self.FEW else 0), 0, 0


def inner(attr: str) -> str:
    """First part of a composite attribute."""
    return json.loads(attr)[0] if attr.startswith('["') else attr


TREE = "tree string, concept long, parent long, depth int, n long, path array<long>, nominal string, numeric string"
TREE_ARROW = pa.schema([("tree", pa.string()), ("concept", pa.int64()), ("parent", pa.int64()), ("depth", pa.int32()), ("n", pa.int64()), ("path", pa.list_(pa.int64())), ("nominal", pa.string()), ("numeric", pa.string())])


def instance(nominal: dict | None, numeric: dict | None) -> dict:
    """A row's maps as an instance."""
    return {k: v for k, v in (nominal or {}).items() if v is not None} | {k: float(v) for k, v in (numeric or {}).items() if v is not None and not math.isnan(v)}


def _fit(batches: Iterator[pa.RecordBatch], scaling: float, structured: bool = False) -> Iterator[pa.RecordBatch]:
    """``names`` are an instance's names as JSON, ``numeric`` is null where it has no number."""
    tree, key, bulk = None, None, None
    out = lambda: pa.RecordBatch.from_pylist(list(tree.rows(key)), TREE_ARROW)
    for batch in batches:
        names, trees = batch["tree"].to_pylist(), batch["names"].dictionary_encode()
        starts = [i for i, k in enumerate(names) if i == 0 or k != names[i - 1]]
        for a, b in zip(starts, [*starts[1:], batch.num_rows]):
            if tree is None or names[a] != key:
                if tree is not None:
                    yield out()
                tree, key = Tree(scaling), names[a]
                bulk = Bulk(tree)
            codes, texts, numeric = trees.indices.slice(a, b - a), trees.dictionary.to_pylist(), batch["numeric"].slice(a, b - a)
            if not structured and not codes.null_count and numeric.null_count == len(numeric):
                codes = codes.to_numpy()
                known = np.zeros(len(texts), np.int64)
                for c in np.unique(codes):
                    known[c] = bulk.number(texts[c])
                bulk.learn(known[codes])
                continue
            for c, number in zip(codes.to_pylist(), numeric.to_pylist()):
                x = instance(json.loads(texts[c]) if c is not None else None, dict(number or ()))
                if structured:
                    from taxaspark.operators.mapping import best_mapping, rename

                    x = rename(x, best_mapping(x, tree.root, tree))
                bulk.fit(x)
    if tree is not None:
        yield out()


def ordered(instances: DataFrame) -> DataFrame:
    """Rows dealt by tree and in order within it."""
    n = int(instances.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return instances.repartitionByRange(n, "tree").sortWithinPartitions("tree", "order")  # by range, few trees don't meet in one task


def fit(instances: DataFrame, scaling: float = 0.5, shards: int = 1, structured: bool = False, passes: int = 1, shuffle_first: bool = False, seed: int = 0) -> DataFrame:
    """Trees of ``instances``: tree (string), order, nominal map<string,string>, numeric map<string,double>.

    Returns ``TREE`` rows. With ``shards`` above one each tree is learned as that many, named tree#0, tree#1, ...
    ``structured``: each instance's variables, which no other instance may share, are first mapped to the root's.
    Instances are learned in ``passes`` passes, all but the first (or that too, with ``shuffle_first``) in an order that
    ``seed`` determines.
    """
    if shards > 1:
        instances = instances.withColumn("tree", F.concat("tree", F.lit("#"), F.pmod(F.xxhash64("order"), F.lit(shards)).cast("string")))
    rows = instances.select("tree", "order", "nominal", "numeric")
    if passes > 1 or shuffle_first:
        rows = rows.withColumn("_pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))))
        place = F.xxhash64(F.lit(seed), "_pass", "order")
        place = place if shuffle_first else F.when(F.col("_pass") == 0, F.lit(0).cast("long")).otherwise(place)
        rows = rows.select("tree", F.struct("_pass", place.alias("place"), "order").alias("order"), "nominal", "numeric")
    rows = rows.select("tree", "order", F.to_json("nominal").alias("names"), F.when(F.size("numeric") > 0, F.col("numeric")).alias("numeric"))
    return ordered(rows).select("tree", "names", "numeric").mapInArrow(partial(_fit, scaling=scaling, structured=structured), TREE)


def _prequential(frames: Iterator[pd.DataFrame], scaling: float, attr: str) -> Iterator[pd.DataFrame]:
    tree, key, place = None, None, 0
    for frame in frames:
        out = []
        for k, nominal, numeric in zip(frame["tree"], frame["nominal"], frame["numeric"]):
            if k != key:
                tree, key, place = Tree(scaling), k, 0
            x = instance(dict(nominal), dict(numeric))
            actual = x.get(attr)
            leaf = tree.categorize({a: v for a, v in x.items() if a != attr})
            out.append((k, place, leaf.nominal.get(attr, {}).get(actual, 0) / leaf.n if leaf.n else 0.0))
            tree.fit(x)
            place += 1
        yield pd.DataFrame(out, columns=["tree", "position", "score"])


def prequential(instances: DataFrame, attr: str, scaling: float = 0.5, runs: int | None = None, run_length: int | None = None, shuffle_first: bool = False, seed: int = 0) -> DataFrame:
    """tree, position, score: probability of each instance's own nominal ``attr`` before it is learned.

    With ``runs``, each tree is learned anew so many times, as tree#0, tree#1, ..., on ``run_length`` + 2 of its instances
    (all, if None) in an order that ``seed`` and the run determine; the first run goes by ``order`` unless ``shuffle_first``.
    """
    if runs is not None:
        rows = instances.withColumn("_run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
        place = F.xxhash64(F.lit(seed), "_run", "order")
        place = place if shuffle_first else F.when(F.col("_run") == 0, F.lit(0).cast("long")).otherwise(place)
        rows = rows.select(F.concat("tree", F.lit("#"), F.col("_run").cast("string")).alias("tree"), F.struct(place.alias("place"), "order").alias("order"), "nominal", "numeric")
        if run_length is not None:
            first = Window.partitionBy("tree").orderBy("order")
            rows = rows.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= run_length + 2).drop("_n")
        instances = rows
    return ordered(instances).mapInPandas(partial(_prequential, scaling=scaling, attr=attr), "tree string, position long, score double")
