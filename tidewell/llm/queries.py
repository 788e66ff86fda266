"""The numbered queries over the operators of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import alignment, audit, bpe, bytecnn, decontam, htmltext, langid, minhash, naming, pivots, rendezvous, repair, toxicity
from tidewell.session import table


def op9_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over 16 equal shards by doc_id."""
    return rendezvous.shard_documents(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of all documents."""
    return bytecnn.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings linked at a cosine of 0.95."""
    return pivots.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return htmltext.extract_pages(table(spark, sf_dir, "pages"))


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents linked at 85 % of their 3-word shingles."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85, rows=5)


def op2_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of a document and a benchmark item that it holds."""
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_bpe_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the text that they decode to."""
    found = bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of all documents."""
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, count and checksum of ids, read back from grammar-compressed files."""
    found = repair.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op11_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents grouped by equal texts; the one with the largest doc_id stays."""
    return naming.exact_duplicates(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from each source in all their orders."""
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_token_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tokens of two vocabularies overlap in every document, and how usual their links are."""
    return alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {
    "op1_near_duplicates": op1_near_duplicates,
    "op9_rendezvous_shards": op9_rendezvous_shards,
    "op2_benchmark_leaks": op2_benchmark_leaks,
    "op3_bpe_digests": op3_bpe_digests,
    "op4_toxicity": op4_toxicity,
    "op5_token_files": op5_token_files,
    "op6_quality": op6_quality,
    "op7_embedding_links": op7_embedding_links,
    "op8_language": op8_language,
    "op10_main_text": op10_main_text,
    "op11_exact_duplicates": op11_exact_duplicates,
    "op12_filter_audit": op12_filter_audit,
    "op13_token_links": op13_token_links,
}
ORACLES = {
    "op9_rendezvous_shards": rendezvous.oracle(),
    "op11_exact_duplicates": naming.oracle(),
    "op12_filter_audit": audit.oracle(),
}
