"""Toxicity scores from a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's features are which hashed n-grams of its lower-cased characters it has. From labelled rows each n-gram gets
the logarithm of the ratio of its shares in both classes; a logistic regression learns on presence times that ratio.
Training takes at most ``MAX_TRAIN`` labelled rows, the first by a hash of doc_id, up to half of them toxic, weighted
back to the labels' own shares; this is the operator's only bound, and every text is scored whole. The other settings
(``SETTINGS``) were chosen by ``search`` on an inner split of the rows that aren't held out.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxaspark.llm.common import stored, text_or_empty

ORDERS = (3, 4, 5, 6)
DIMENSIONS = 1 << 20
MAX_TRAIN = 12_000
THRESHOLD = 0.7
#: ``features``: n-grams that become features, at most, by the difference of their shares in both classes;
#: ``least_docs``: training rows that such an n-gram must occur in; ``least_z``: its least difference, in standard errors;
#: ``penalty`` on squared weights.
SETTINGS = {"features": 1024, "least_docs": 10, "least_z": 4.0, "penalty": 1e-4}


def held_out() -> Column:
    """Rows whose labels are never learned from; a null doc_id isn't held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def _grams(text: str):
    """Hashed n-grams of a text, an array for each order and block of the text."""
    points = np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    most = max(ORDERS)
    for at in range(0, len(points), 1 << 20):
        block = points[at : at + (1 << 20) + most - 1]
        h = np.zeros(len(block), np.uint64)
        for n in range(1, most + 1):
            if len(block) < n:
                break
            h = h[: len(block) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + block[n - 1 :] + np.uint64(1)
            if n in ORDERS:
                mixed = h ^ (h >> np.uint64(29))
                yield (mixed * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - DIMENSIONS.bit_length() + 1)).astype(np.int64)


def present(text: str, column: np.ndarray | None = None) -> np.ndarray:
    """Distinct buckets of a text, or the columns of those buckets that have one (``column``: bucket -> column or -1)."""
    found = []
    if column is None:
        seen = np.zeros(DIMENSIONS, bool)
        for g in _grams(text):
            seen[g] = True
        return np.flatnonzero(seen)
    for g in _grams(text):
        g = column[g]
        found.append(np.unique(g[g >= 0]))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


@dataclass
class Model:
    """``column``: bucket -> feature or -1; ``weights``: of the features' presence; ``bias``."""

    column: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, text: str) -> float:
        z = self.bias + float(self.weights[present(text, self.column)].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def _count(batches):
    counts = np.zeros((DIMENSIONS, 2), np.int64)
    for batch in batches:
        for text, y in zip(batch["text"].to_pylist(), batch["y"].to_pylist()):
            counts[present(text), y] += 1
    b = np.flatnonzero(counts.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array(counts[b, 0]), pa.array(counts[b, 1])], ["bucket", "n0", "n1"])


def _sparse(batches, buckets: np.ndarray):
    column = np.full(DIMENSIONS, -1, np.int64)
    column[buckets] = np.arange(len(buckets))
    for batch in batches:
        rows = [present(t, column).astype("<i4").tobytes() for t in batch["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["y"], batch["key"], pa.array(rows, pa.binary())], ["y", "key", "f"])


#: Present features that a step of training looks at together.
AT_ONCE = 1 << 18


def _logistic(lengths: np.ndarray, cols: np.ndarray, scale: np.ndarray, y: np.ndarray, sample_weight: np.ndarray, penalty: float, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch Adam; a feature's value is ``scale`` where present: row i has ``lengths[i]`` of ``cols``."""
    w, b, k = np.zeros(len(scale)), float(np.log((sample_weight[y == 1].sum() + 1e-9) / (sample_weight[y == 0].sum() + 1e-9))), len(scale)
    m, v, mb, vb, total = np.zeros(k), np.zeros(k), 0.0, 0.0, sample_weight.sum()
    ends = np.concatenate([[0], np.cumsum(lengths)])
    cuts = [0]
    while cuts[-1] < len(y):  # blocks of rows, so that a step needs little memory
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(ends, ends[cuts[-1]] + AT_ONCE, "right")) - 1))
    for t in range(1, steps + 1):
        here, gw, gb = w * scale, np.zeros(k), 0.0
        for i, j in zip(cuts, cuts[1:]):
            own, row = cols[ends[i] : ends[j]], np.repeat(np.arange(j - i), lengths[i:j])
            z = np.bincount(row, weights=here[own], minlength=j - i) + b
            g = sample_weight[i:j] * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y[i:j]) / total
            gw += np.bincount(own, weights=g[row], minlength=k)
            gb += g.sum()
        gw = gw * scale + penalty * w
        m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw**2, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        rate = 0.05 / np.sqrt(t) * 3
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-9)
    return w * scale, float(b)


def _known(labels: DataFrame) -> DataFrame:
    """doc_id, y, key of the labelled rows that may be learned from."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("y"))
    return known.filter(~held_out()).withColumn("key", F.xxhash64("doc_id"))


def search(docs: DataFrame, labels: DataFrame, grid: list[dict], parts: int = 4) -> list[dict]:
    """Each setting of ``grid`` with its ``loss`` (mean logarithmic loss) and ``wrong`` (at ``THRESHOLD``) on an inner split.

    One in ``parts`` of the rows that aren't held out, by a hash of their ids, is judged by a model of the others; held-out
    rows are neither learned from nor looked at.
    """
    known = stored(_known(labels), "inner")
    inner = F.pmod("key", F.lit(parts)) == 0
    rest = known.filter(~inner).select("doc_id", F.col("y").alias("toxic"))
    judged = stored(docs.join(known.filter(inner).select("doc_id", "y"), "doc_id").select("doc_id", "text", "y"), "judged")
    out = []
    for setting in grid:
        rows = score(judged, train(docs, rest, **setting)).join(judged.select("doc_id", "y"), "doc_id")
        p = F.least(F.greatest("score", F.lit(1e-6)), F.lit(1 - 1e-6))
        loss = F.avg(F.when(F.col("y") == 1, -F.ln(p)).otherwise(-F.ln(1 - p)))
        out.append(setting | rows.agg(loss.alias("loss"), F.count_if(F.col("predicted") != F.col("y")).alias("wrong")).first().asDict())
    return out


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, features: int = SETTINGS["features"], least_docs: int = SETTINGS["least_docs"], least_z: float = SETTINGS["least_z"], penalty: float = SETTINGS["penalty"]) -> Model:
    """A model from at most ``max_train`` rows of ``labels`` (doc_id, toxic) that aren't held out.

    Rows with a null doc_id or label are left out; of several labels of a document the largest counts. Without rows of
    both classes every text scores the share of toxic ones, or 0.5 if there are none. Texts may be of any length; equal
    rows of ``docs`` with a label count one by one; other columns aren't read.
    """
    known = stored(_known(labels), "labels")
    shares = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = shares.get(0, 0), shares.get(1, 0)
    take1 = min(n1, max(max_train // 2, max_train - n0))
    picked = known.filter("y = 1").orderBy("key", "doc_id").limit(take1).unionByName(known.filter("y = 0").orderBy("key", "doc_id").limit(max_train - take1))
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    sample = stored(text.join(F.broadcast(picked), "doc_id").select("text", "y", "key"), "sample")  # at most max_train ids
    if not (n0 and n1):
        return Model(np.full(DIMENSIONS, -1), np.zeros(1), float(np.log((n1 + 0.5) / (n0 + 0.5))) if n0 + n1 else 0.0)
    counts = stored(sample.mapInArrow(_count, "bucket long, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).filter(F.col("n0") + F.col("n1") >= least_docs), "grams")
    whole = counts.agg(F.count(F.lit(1)).alias("k"), F.coalesce(F.sum("n0"), F.lit(0)).alias("t0"), F.coalesce(F.sum("n1"), F.lit(0)).alias("t1")).first()
    s1, s0 = max(1, min(n1, take1)), max(1, min(n0, max_train - take1))
    p1, p0, p = F.col("n1") / s1, F.col("n0") / s0, (F.col("n1") + F.col("n0") + 1) / (s1 + s0 + 2)
    z = F.abs(p1 - p0) / F.sqrt(p * F.greatest(1 - p, F.lit(1e-9)) * F.lit(1 / s1 + 1 / s0))
    # only the features themselves come to the driver, as Arrow
    best = counts.withColumn("z", z).filter(F.col("z") >= least_z).orderBy(F.desc("z"), "bucket").limit(features).select("bucket", "n0", "n1").toArrow().sort_by("bucket")
    bucket, c0, c1 = (best[c].to_numpy() for c in ("bucket", "n0", "n1"))
    ratio = np.log((c1 + 1) / (whole["t1"] + whole["k"])) - np.log((c0 + 1) / (whole["t0"] + whole["k"]))
    table = sample.mapInArrow(partial(_sparse, buckets=bucket), "y int, key long, f binary").orderBy("key").toArrow()
    y = table["y"].to_numpy()
    lengths = np.array([len(f.as_buffer()) // 4 for c in table["f"].chunks for f in c], np.int64)
    cols = np.concatenate([np.zeros(0, np.int32), *[np.frombuffer(f.as_buffer(), "<i4") for c in table["f"].chunks for f in c if f.as_buffer().size]])
    weight = np.where(y == 1, n1 / max(1, (y == 1).sum()), n0 / max(1, (y == 0).sum()))
    w, bias = _logistic(lengths, cols, ratio, y, weight, penalty)
    column = np.full(DIMENSIONS, -1, np.int64)
    column[bucket] = np.arange(len(bucket))
    return Model(column, w, bias)


def _score(batches, buckets: np.ndarray, weights: np.ndarray, bias: float):
    column = np.full(DIMENSIONS, -1, np.int32)
    column[buckets] = np.arange(len(buckets))
    model = Model(column, weights, bias)
    for batch in batches:
        scores = [model.score(t) for t in batch["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(scores, pa.float64())], ["doc_id", "held_out", "score"])


def _keep(batches, buckets: np.ndarray, weights: np.ndarray, bias: float, threshold: float):
    column = np.full(DIMENSIONS, -1, np.int32)
    column[buckets] = np.arange(len(buckets))
    model = Model(column, weights, bias)
    for batch in batches:
        yield batch.filter(pa.array([model.score(t or "") < threshold for t in batch["text"].to_pylist()], pa.bool_()))


def _parts(model: Model) -> dict:
    buckets = np.flatnonzero(model.column >= 0)
    return {"buckets": buckets[np.argsort(model.column[buckets])], "weights": model.weights, "bias": model.bias}


def keep(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, that score under ``threshold``; a null text counts as empty."""
    return docs.mapInArrow(partial(_keep, threshold=threshold, **_parts(model)), docs.schema)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text; null counts as empty and scores the bias alone.

    Repeated rows are scored one by one, equal texts alike; a text may be of any length. An empty table gives no rows; other
    columns, whatever their names, aren't read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), text_or_empty().alias("text"))
    scored = rows.mapInArrow(partial(_score, **_parts(model)), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
