"""A corpus pipeline over ``documents``: toxicity, near-duplicates, repeated passages, personal data, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept and returns a DataFrame with the columns
of documents (the last one: pieces of packed sequences).
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxaspark.llm import packing, pii, repeats, resemblance, toxicity
from taxaspark.llm.common import discard, read, stored
from taxaspark.llm.queries import pii_key, vocabulary

#: The columns of documents.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keeps_columns(stage):
    """A stage that gives back all of its input's columns, in order; those beyond ``COLUMNS`` may have any names."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = {c: c if c in COLUMNS else f"extra {i}" for i, c in enumerate(docs.columns)}
        out = stage(spark, docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), sf_dir)
        return out.select(*[F.col(f"`{n}`").alias(c) for c, n in names.items()])

    return run_stage


def _with_length(out: DataFrame, changed: str) -> DataFrame:
    """``out`` with ``n_chars`` of the new text where the count ``changed`` isn't 0, if there is such a column."""
    return out.withColumn("n_chars", F.when(F.col(changed) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars").cast("long"))) if "n_chars" in out.columns else out


@keeps_columns
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; it learns from the labels that aren't held out.

    A null text counts as empty and stays, as no n-gram speaks against it. Repeated rows are judged alike, each row by
    its whole text. An empty table gives no rows; all columns are kept.
    """
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    return toxicity.keep(docs, model)


@keeps_columns
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word similarity 0.8 or more) the document of the smallest id; of rows with that id one.

    Null, empty and blank texts are alike, so one row of them stays. Rows that share an id, or have none, are compared by
    their texts like any others; whole texts count. An empty table gives no rows; all columns are kept.
    """
    return resemblance.keep_one(docs)


@keeps_columns
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the byte strings that repeat anywhere among them; n_chars follows the text.

    A null text becomes empty. Repeated rows of 200 bytes or more lose their whole text, but stay as rows. Very long texts
    are hashed piece by piece. An empty table gives no rows; all columns are kept.
    """
    cut = repeats.remove_repeats(docs, keep=[c for c in docs.columns if c not in ("doc_id", "text")])
    return _with_length(cut, "n_removed")


@keeps_columns
def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced; n_chars follows the text.

    A null text stays null, an empty one empty; repeated rows and values are replaced alike, in texts of any length. An
    empty table gives no rows; all columns are kept.
    """
    return _with_length(pii.pseudonymise(docs, pii_key(spark)), "n_replaced")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows mixed by source.

    A null text is empty, a null source the source ""; repeated rows are packed one by one, long texts cut at window ends.
    An empty table gives no pieces; other columns aren't read.
    """
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), 1)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("repeats", cut_repeats), ("pii", pseudonymise), ("packing", pack)]

#: Classifier, fingerprints and tokenizer have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again, and deleted after the next one."""
    docs = source = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        after = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        if docs is not source:
            discard(docs)
        docs = after
    return docs
