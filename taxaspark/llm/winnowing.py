"""Document fingerprints by winnowing, in DataFrame functions alone.

A text is a sequence of tokens (words, long ones in pieces). Every ``k`` neighbouring tokens have a polynomial hash over their CRC-32, the
value that rolling along the text gives; as a column expression has no running state, it comes by Horner's rule. Of each ``w`` neighbouring hashes the least is picked, the rightmost among equals, with its position. So
two texts that share ``w + k - 1`` tokens in a row share a pick there, and a shared pick is a shared ``k``-gram (but
for hashes that collide).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxaspark.llm.common import SPACE, let, text_or_empty

#: Tokens of a gram, and grams of a window.
K, W = 5, 8
#: Most characters of a token; longer words are several.
TOKEN = 16
#: Modulus and base of the polynomial; bits of a position in a pick, and the last position. A pick is the hash, then the position from the end.
PRIME, BASE, BITS = (1 << 31) - 1, 1003, 31
LAST = (1 << BITS) - 1
#: Rows of a range of neighbouring documents, about, and the most ranges (the driver holds a bound for each).
RANGE_ROWS, RANGES = 1000, 1024


def _rolled(numbers: Column, first: Column, at: Column, k: int) -> Column:
    """The hash of the ``k`` tokens from number ``at`` on, by Horner's rule; two steps stay below 2^63 without a remainder."""
    held = first
    for j in range(1, k):
        held = held * BASE + F.get(numbers, at + j)
        if j % 2 == 0 or j == k - 1:
            held = held % PRIME
    return held


def _grams(numbers: Column, k: int) -> Column:
    """Hash and position, packed, of each ``k`` neighbouring tokens; of all, if there are fewer."""

    def packed(h: Column, i: Column) -> Column:
        return F.shiftleft(h, BITS).bitwiseOR(F.lit(LAST) - i)

    whole = F.aggregate(numbers, F.lit(0).cast("long"), lambda acc, t: (acc * BASE + t) % PRIME)
    starts = F.slice(numbers, F.lit(1), F.size(numbers) - (k - 1))
    many = F.transform(starts, lambda t, i: packed(_rolled(numbers, t, i, k), i)) if k > 1 else F.transform(numbers, lambda t, i: packed(t % PRIME, i))
    return F.when(F.size(numbers) >= k, many).when(F.size(numbers) > 0, F.array(packed(whole, F.lit(0)))).otherwise(F.array().cast("array<bigint>"))


def _least(packed: Column, w: int) -> Column:
    """The least of each ``w`` neighbouring values; of all, if there are fewer."""
    starts = F.slice(packed, F.lit(1), F.size(packed) - (w - 1))
    many = F.transform(starts, lambda x, i: F.least(x, *[F.get(packed, i + j) for j in range(1, w)])) if w > 1 else packed
    return F.when(F.size(packed) >= w, many).when(F.size(packed) > 0, F.array(F.array_min(packed))).otherwise(packed)


def picks(text: Column, k: int = K, w: int = W) -> Column:
    """The winnowed fingerprint of a text, array<long> in order of position; ``hashes`` and ``positions`` take it apart.

    A text of under ``k`` tokens has one pick, the hash of all of them; one without tokens has none.
    """
    tokens = F.regexp_extract_all(text, F.lit(f"[^{SPACE}]{{1,{TOKEN}}}"), F.lit(0))
    numbers = F.transform(tokens, lambda t: F.crc32(t))
    return F.array_distinct(let(let(numbers, lambda n: _grams(n, k)), lambda p: _least(p, w)))


def hashes(picked: Column) -> Column:
    """The hashes of picks."""
    return F.transform(picked, lambda x: F.shiftright(x, BITS))


def positions(picked: Column) -> Column:
    """The positions of picks: the number of each gram's first token."""
    return F.transform(picked, lambda x: F.lit(LAST) - x.bitwiseAND(F.lit(LAST)))


def digest(picked: Column) -> Column:
    """The fingerprint as one string: equal texts have equal ones."""
    return F.md5(F.array_join(F.transform(picked, lambda x: x.cast("string")), " "))


def likeness(a: Column, b: Column) -> Column:
    """Shared hashes over all hashes (each once) of two fingerprints; 1.0 where both have none."""
    both = F.size(F.array_intersect(a, b))
    return let(F.size(F.array_union(a, b)), lambda n: F.when(n == 0, F.lit(1.0)).otherwise(both / n))


def fingerprints(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """doc_id, hashes and positions (array<long>) of the picks of each whole text.

    A null or blank text has none. Repeated rows come one by one, an empty table gives no rows, other columns aren't
    read, and a text of any length is one row, whose arrays follow its length.
    """
    found = docs.select("doc_id", picks(text_or_empty(), k, w).alias("__picks"))
    return found.select("doc_id", hashes(F.col("__picks")).alias("hashes"), positions(F.col("__picks")).alias("positions"))


def with_next(docs: DataFrame, extra: dict[str, Column]) -> DataFrame:
    """doc_id, text, each of ``extra`` (made of ``text``), and the same of the next document as ``next_...``.

    Documents are in order of (doc_id, nulls first, hash of text); the first one follows the last. Rows are dealt to
    ranges of that order, whose bounds come from a sample, and to each range the first row of the next one is added.
    So a task has some ranges of neighbours, texts are shuffled once, and an id that many rows share is split as well.
    A null text is empty; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("key", F.struct("doc_id", F.xxhash64("text").alias("h")))
    ids = rows.select("key")
    total = docs.count()
    ranges = max(1, min(RANGES, total // RANGE_ROWS))
    sample = ids.sample(min(1.0, 40 * ranges / max(1, total)), seed=7).orderBy("key").collect() if ranges > 1 else []
    bounds = sorted({((r["key"]["doc_id"] is not None, r["key"]["doc_id"] or 0), r["key"]["h"]) for r in (sample[len(sample) * i // ranges] for i in range(1, ranges) if sample)})
    cuts = F.array(*[F.struct(F.lit(d if some else None).cast("long").alias("doc_id"), F.lit(h).cast("long").alias("h")) for (some, d), h in bounds])
    number = F.size(F.filter(cuts, lambda c: c <= F.col("key"))) if bounds else F.lit(0)
    rows = rows.withColumn("range", number)
    firsts = rows.groupBy("range").agg(F.min("key").alias("key")).orderBy("range").collect()  # at most RANGES
    if not firsts:
        before = spark.createDataFrame([], "doc_id long, h long, before int")
    else:
        before = spark.createDataFrame([(f["key"]["doc_id"], f["key"]["h"], firsts[i - 1]["range"]) for i, f in enumerate(firsts)], "doc_id long, h long, before int")
    same = F.col("key.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("key.h") == F.col("b.h"))
    copies = rows.join(F.broadcast(before.alias("b")), same).dropDuplicates(["before"]).select(rows["doc_id"], "text", "key", F.col("before").alias("range"), F.lit(True).alias("copy"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("copy", F.lit(False)).unionByName(copies).repartition(n, "range").withColumns(extra)
    order = Window.partitionBy("range").orderBy("copy", "key")
    names = ["text", *extra]
    return dealt.select("doc_id", "copy", *names, *[F.lead(c).over(order).alias(f"next_{c}") for c in names]).filter(~F.col("copy")).drop("copy")


def edited_likeness(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each document.

    The edited text has its second half (the smaller one) replaced by as much of the next document's beginning.
    """
    both = with_next(docs, {"picks": picks(F.col("text"))})
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), F.length("text") - half), F.substr("next_text", F.lit(1), half))
    out = both.withColumn("edited", F.transform(F.array(edited), lambda e: F.struct(F.sha2(e, 256).alias("sha"), picks(e).alias("picks")))[0])
    own, other, beside = (hashes(F.col(c)) for c in ("picks", "edited.picks", "next_picks"))
    return out.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.col("edited.sha").alias("edited_sha256"), digest(F.col("picks")).alias("fingerprint"), digest(F.col("edited.picks")).alias("edited_fingerprint"), likeness(own, other).alias("near_edited"), likeness(own, beside).alias("near_next"))
