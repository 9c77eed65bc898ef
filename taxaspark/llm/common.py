"""What the operators of this subpackage share: table access, durable intermediate tables, text helpers."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taxaspark import storage
from taxaspark.storage import shared_path as new_path, stored

__all__ = ["by_weight", "discard", "joined", "let", "new_path", "read", "release_memory", "sieve", "stored", "text_or_empty"]

#: ASCII white space that separates words, as a regular expression class body.
SPACE = r"\x20\x09-\x0D"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing will read again, and lets the driver's JVM drop the plans and code of the jobs that read them.

    Rounds run some dozen jobs each, and the driver would hold on to what they left until its heap is full.
    """
    storage.discard(*tables)
    gc.collect()
    for t in tables[:1]:
        t.sparkSession._jvm.java.lang.System.gc()


def text_or_empty(name: str = "text") -> Column:
    """A text column, with null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``value`` as a lambda's variable, so that it is held and computed once."""
    return F.transform(F.array(value), use)[0]


#: Keys that count as heavy, at most: those with over 1 / HEAVY of all rows.
HEAVY = 1000


def by_weight(sizes: DataFrame, size: str = "size", heavy: int | None = None, total: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(heavy, light) keys of ``sizes`` (one row for each key, with its number of rows).

    A heavy key has more than 1 / ``heavy`` of all rows, so there are under ``heavy`` of them and they may be broadcast.
    ``total``: all rows, or a bound above, if known already; else a job counts them.
    """
    total = (sizes.agg(F.sum(size)).first()[0] or 0) if total is None else total
    cut = total / (HEAVY if heavy is None else heavy)
    return sizes.filter(F.col(size) > cut), sizes.filter(F.col(size) <= cut)


def joined(rows: DataFrame, marks: DataFrame, on: list[str], size: str = "size", total: int | None = None, merge: bool = False) -> DataFrame:
    """``rows`` joined with ``marks`` (unique in ``on``; ``size``: the rows of a key, not kept).

    Rows of heavy keys stay where they are and meet a broadcast of under ``HEAVY`` marks; only the others are shuffled,
    so no task gets more than 1 / ``HEAVY`` of all rows (of ``total``, if given) for one key. ``merge``: for tables that
    come of an explode, whose rows Spark doesn't foresee; the light keys are never broadcast, however small they seem.
    """
    heavy, light = (F.broadcast(x.drop(size)) if i == 0 else x.drop(size) for i, x in enumerate(by_weight(marks, size, total=total)))
    light = light.hint("merge") if merge else light
    return rows.join(heavy, on).unionByName(rows.join(F.broadcast(heavy.select(*on)), on, "left_anti").join(light, on))


#: Most bits of a ``sieve``, which the driver gathers and every plan and task holds.
SIEVE_BITS = 1 << 21


def sieve(keys: DataFrame, on: list[str]) -> Column:
    """Whether a row's key may be among ``keys``: a fixed-size bit set of hashed keys.

    It only saves shuffling rows without a partner; with more keys than bits it lets all pass, and no result depends on it.
    """
    bits = min(SIEVE_BITS, max(1 << 15, 1 << (16 * keys.count()).bit_length()))
    place = (F.pmod(F.xxhash64(*on), F.lit(bits)) + 1).cast("long")
    table = bytearray(bits // 8)
    for r in keys.groupBy(F.bitmap_bucket_number(place).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("m")).collect():
        at = (r["b"] - 1) * (1 << 12)
        table[at : at + (1 << 12)] = r["m"]
    spot = F.pmod(F.xxhash64(*on), F.lit(bits))
    byte = F.conv(F.hex(F.substr(F.lit(bytes(table)), F.floor(spot / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.floor(byte / F.pow(F.lit(2), spot % 8)) % 2 == 1


def release_memory() -> None:
    """Gives what a Python worker has freed, and its tokenizer, back; called at the end of a task that needs none, as workers live on."""
    if encoding := sys.modules.get("taxaspark.llm.encoding"):
        encoding.encoder.cache_clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass
