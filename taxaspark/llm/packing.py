"""Mixture-controlled packing of documents into fixed windows by deficit round-robin over source queues.

Each source is a queue of documents and has a target share. In every round each source earns a quantum, its share of
``WINDOW`` tokens, on top of its deficit (what it earned and wasn't served), and is served whole documents as long as
its deficit pays for them; the rest is carried on. So after any round a source that has documents left has been served
what its share gives, less than one document short. Rounds are laid end to end and cut into windows; documents are cut
only where a window ends. A source that is dry earns nothing, so the others share its part in their proportions.

What a source earns depends on no other source. So a document's round has a closed form, the first one by whose end its
queue has earned all tokens up to and with it, and rounds needn't be played one after the other: deficits carry over
windows and partitions through two distributed running sums over small rows, one along the queues (which gives the
rounds) and one along the rounds (which gives the places).
"""

from __future__ import annotations

import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taxaspark.llm.common import joined, release_memory, stored, text_or_empty
from taxaspark.llm.encoding import batches_of, encoder

WINDOW = 2048
#: Exponent of the default target shares: a source's share goes with its tokens to this power.
FLATTEN = 0.7
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_to long, source string, round long, deficit double"


def _encode(batches, tokenizer: str, end_id: int):
    """part, row: a name for each row; the document's ids, of 16 bits where they fit, and their number."""
    words, part, row = encoder(tokenizer, False), TaskContext.get().partitionId(), 0
    end = np.array([end_id], "<u4").tobytes()
    for batch in batches:
        texts = batch["text"].to_pylist()
        for a, b in batches_of(texts):
            ids, counts = [], []
            for x in words.encode(texts[a:b]):
                i = np.frombuffer(x + end, "<u4")
                ids.append((i.astype("<u2") if i.max() < 65_536 else i).tobytes())
                counts.append(len(i))
            some = batch.slice(a, b - a)
            yield pa.RecordBatch.from_arrays([pa.array([part] * (b - a), pa.int32()), pa.array(range(row, row + b - a), pa.int64()), some["doc_id"], some["source"], some["h"], pa.array(counts, pa.int64()), pa.array(ids, pa.binary())], ["part", "row", "doc_id", "source", "h", "n", "ids"])
            row += b - a


def _running(batches, by: list[str]):
    """Adds to rows sorted by ``by`` the task's number and the tokens that its own rows before them have with the same ``by``."""
    task, last, total = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        before = []
        for key, n in zip(zip(*(batch[c].to_pylist() for c in by)) if by else [()] * batch.num_rows, batch["n"].to_pylist()):
            if key != last:
                last, total = key, 0
            before.append(total)
            total += n
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([task] * batch.num_rows, pa.int32()), pa.array(before, pa.int64())], [*batch.schema.names, "task", "before"])


def running_sum(rows: DataFrame, by: list[str], order: list, name: str, parts: int, weight: str) -> DataFrame:
    """``rows`` with ``name``: the sum of ``n`` over the rows before, in ``order`` (which begins with ``by``), of the same ``by``.

    Rows are dealt to tasks by ranges of ``order``; a task's own sums and the totals of the tasks before (a row for each
    task and ``by`` in it) make up the whole, so a key may hold any share of the rows.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    own = stored(dealt.mapInArrow(partial(_running, by=by), f"{schema}, task int, before long"), name)
    held = own.groupBy(*by, "task").agg(F.sum("n").alias("held"), F.count(F.lit(1)).alias(weight))
    tasks = Window.partitionBy(*by).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # rows: tasks that have the key
    base = stored(held.select(*by, "task", weight, F.coalesce(F.sum("held").over(tasks), F.lit(0).cast("long")).alias("base")), f"{name}-base")
    return joined(own, base, [*by, "task"], weight).withColumn(name, F.col("base") + F.col("before")).drop("base", "before", "task")


def _cut(batches, size: int, total: int):
    """The pieces of each document: it is cut where a window ends."""
    last = (total - 1) // size
    tail = 1 << (max(1, total - last * size) - 1).bit_length()
    names = [f.split()[0] for f in PIECES.split(", ")]
    kinds = {"deficit": pa.float64(), "source": pa.string()}
    for batch in batches:
        for begin in range(0, batch.num_rows, 1000):
            out: list[list] = [[] for _ in names]
            for row in batch.slice(begin, 1000).to_pylist():
                n, at, done = row["n"], row["place"], 0
                ids = np.frombuffer(row["ids"], "<u4" if len(row["ids"]) == 4 * n else "<u2").astype("<u4").tobytes()
                while done < n:
                    w, offset = divmod(at + done, size)
                    take = min(size - offset, n - done)
                    piece = (row["doc_id"], done, take, zlib.crc32(ids[4 * done : 4 * (done + take)]), n, w, offset, tail if w == last else size, row["source"], row["round"], row["deficit"])
                    for column, value in zip(out, piece):
                        column.append(value)
                    done += take
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds.get(k, pa.int64())) for k, c in zip(names, out)], names)
    release_memory()


def pack(docs: DataFrame, tokenizer: str, end_id: int, weights: dict[str, float] | None = None, size: int = WINDOW, parts: int | None = None, flatten: float = FLATTEN) -> DataFrame:
    """Pieces of all ``docs`` (doc_id, text, source) in windows of ``size`` tokens, mixed by source.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded_to, source, round, deficit (what
    the source still has to its credit after the document, in tokens). ``weights``: target share of each source, in any
    unit; sources not named, or of no weight, come when all others are dry. By default a source's share goes with its
    tokens to the power ``flatten``: under 1 small sources come up more often at first and are dry sooner.

    A queue is in order of (doc_id, nulls first, hash of text). A null text is empty, so its document is ``end_id`` alone;
    a null source is the source "". Repeated rows and ids are packed one by one. A text longer than a window is cut. An
    empty table gives no pieces; other columns aren't read. Only the last window may be short; it is padded to a power
    of two. Shares hold in the windows before the first queue is dry, and among the rest from there on.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), text_or_empty().alias("text")).withColumn("h", F.xxhash64("text"))
    encoded = stored(rows.mapInArrow(partial(_encode, tokenizer=tokenizer, end_id=end_id), "part int, row long, doc_id long, source string, h long, n long, ids binary"), "encoded")
    total = encoded.agg(F.sum("n")).first()[0]
    if not total:
        return spark.createDataFrame([], PIECES)
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = encoded.select("part", "row", "doc_id", "source", "h", "n")
    queued = running_sum(names, ["source"], ["source", "doc_id", "h", "part", "row"], "queued", n, "docs")
    held = encoded.groupBy("source").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    if weights is None:
        held = held.withColumns({"later": F.lit(False), "weight": F.pow(F.col("tokens").cast("double"), F.lit(flatten))})
    else:
        given = spark.createDataFrame([(s, float(w)) for s, w in weights.items() if w > 0], "source string, given double")
        held = held.join(given, "source", "left").select("source", "tokens", "docs", F.col("given").isNull().alias("later"), F.coalesce("given", F.col("tokens").cast("double")).alias("weight"))
    held = stored(held, "held")
    whole = held.groupBy("later").agg(F.sum("weight").alias("weights"))  # one or two rows
    quanta = held.join(F.broadcast(whole), "later").select("source", "docs", "later", (F.col("weight") * size / F.col("weights")).alias("quantum"))
    served = joined(queued, stored(quanta, "quanta"), ["source"], "docs")
    end = F.col("queued") + F.col("n")
    served = served.withColumn("round", F.ceil(end / F.col("quantum"))).withColumn("deficit", F.col("round") * F.col("quantum") - end)
    placed = running_sum(served, [], ["later", "round", "source", "doc_id", "h", "part", "row"], "place", n, "docs")
    found = encoded.select("part", "row", "doc_id", "source", "n", "ids").join(placed.select("part", "row", "place", "round", "deficit"), ["part", "row"])
    return found.mapInArrow(partial(_cut, size=size, total=total), PIECES)
