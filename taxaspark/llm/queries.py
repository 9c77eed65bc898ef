"""The registered queries of this subpackage, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxaspark.llm import bytebpe, chat, neighbours, oracle, packing, periods, pii, quality, repeats, search, simhash, tokenfile, toxicity, winnowing
from taxaspark.llm.common import read

#: Setting of the session that holds the secret key of pseudonyms, and a key for trials, which is no secret.
PII_SETTING, TRIAL_KEY = "spark.taxaspark.pseudonyms.key", "trial"


def pii_key(spark: SparkSession) -> str:
    """The key of pseudonyms that the session names."""
    return spark.conf.get(PII_SETTING, TRIAL_KEY)


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of each document, written to seekable files and read back."""
    manifest = tokenfile.write_tokens(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), 2)
    return tokenfile.read_tokens(manifest, ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows mixed by source; small sources get more than they hold of it, until they are dry."""
    return packing.pack(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), 1)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of near-duplicates of each document."""
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of each document."""
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth one."""
    vectors = neighbours.valid(read(spark, sf_dir, "embeddings"))
    return neighbours.nearest(vectors, vectors.filter("vec_id % 100 = 0"))


def op6_bytebpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of each document, and what they decode to."""
    import public_tokenizers

    path = vocabulary("byte_bpe_50k.tiktoken")
    encoded = bytebpe.encode(read(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, strings=True)
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2("written", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with personal data pseudonymised."""
    return pii.pseudonymise(read(spark, sf_dir, "documents"), pii_key(spark)).select("doc_id", "text", "n_found", "n_replaced")


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated byte strings removed from each document."""
    return repeats.remove_repeats(read(spark, sf_dir, "documents")).drop("text")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the adaptive verdict of each document."""
    return quality.quality(read(spark, sf_dir, "documents"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations from each participant's perspective, turn by turn."""
    return chat.perspectives(read(spark, sf_dir, "conversations"))


def op11_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winnowed fingerprints of each document and of its edited text, and how alike they are."""
    return winnowing.edited_likeness(read(spark, sf_dir, "documents"))


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each benchmark item."""
    return search.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in each document, every tenth of which is made to repeat."""
    return periods.run_digests(periods.find_runs(periods.with_planted(read(spark, sf_dir, "documents"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_tokens, op2_packing, op3_simhash, op4_toxicity, op5_neighbours, op6_bytebpe, op7_pii, op8_repeats, op9_quality, op10_chat, op11_winnowing, op12_search, op13_runs)}

ORACLE: dict[str, str] = oracle.ORACLE
