"""Concept tables kept up to date from a stream: counts and moments of each batch, merged when they are read.

A batch's aggregates are written under its number, so one that is run again after a failure replaces itself. The tables
of any set of batches add up, so nothing has to be held between batches, and ``compacted`` may fold old ones into one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from taxaspark.functions.moments import merge
from taxaspark.plans import measures


def keep_tables(stream: DataFrame, keys: list[str], path: str) -> StreamingQuery:
    """Starts to keep the tables of ``stream`` (keys, attr, sval, nval) under ``path``; takes what is there, then ends.

    Started again on the same ``path`` it goes on where it stopped. Batches are as large as the source makes them: bound
    them there, by files or bytes.
    """

    def add(batch: DataFrame, number: int) -> None:
        for name, table in (("counts", measures.counts(batch, keys)), ("moments", measures.numbers(batch, keys))):
            table.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()


def kept_counts(spark: SparkSession, keys: list[str], path: str) -> DataFrame:
    """keys, attr, val, n over all batches."""
    return spark.read.option("basePath", f"{path}/counts").parquet(f"{path}/counts").groupBy(*keys, "attr", "val").agg(F.sum("n").alias("n"))


def kept_moments(spark: SparkSession, keys: list[str], path: str) -> DataFrame:
    """keys, attr, num, mean, m2 over all batches."""
    rows = spark.read.option("basePath", f"{path}/moments").parquet(f"{path}/moments")
    return merge(rows.select(*keys, "attr", "num", "mean", "m2"), [*keys, "attr"])
