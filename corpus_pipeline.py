"""A corpus pipeline: language, quality, near-duplicates, benchmark leaks, token ids; each stage by one operator of tidewell.llm."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import bpe, bytecnn, decontam, langid, minhash
from tidewell.llm.textbatch import numbered
from tidewell.session import materialise, ship, table

TOKENIZER = "word_bpe_49k.json"


def aside(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with columns that no stage needs under names that no operator uses, and what gives them their names and order back."""
    names = {c: c if c in ("doc_id", "text", "lang") else f"_own_{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), lambda df: df.select(*[F.col(name).alias(c) for c, name in names.items()])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned; those without text or letters go. A missing lang is filled in."""
    ship(spark)
    model = langid.learn(docs.select("doc_id", "text", "lang").filter(langid.learnable()))
    own, back = aside(docs)
    return back(langid.predict(own, model).filter("lang_pred <> 'und'").withColumn("lang", F.coalesce("lang", "lang_pred")))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    ship(spark)
    net = bytecnn.learn(docs, table(spark, sf_dir, "labels"))
    own, back = aside(docs)
    return back(bytecnn.score(own, net).filter("predicted = 1"))


def as_documents(rows: DataFrame) -> DataFrame:
    """Numbered rows for operators that know documents by doc_id: each row is one document."""
    return rows.select(F.col("_row").alias("doc_id"), "text")


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that with the least doc_id (rows without one come last), then the first by text.

    Rows are decided on one by one: those with one doc_id, or none, stay if they are no near duplicates of each other.
    """
    ship(spark)
    own, back = aside(docs)
    rows, _ = numbered(own)
    kept = minhash.near_duplicates(as_documents(rows), words=5, percent=80, rows=4).filter("kept").select(F.col("doc_id").alias("_row"))
    return back(rows.join(kept, "_row", "left_semi"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item, with or without a doc_id of their own."""
    ship(spark)
    own, back = aside(docs)
    rows, _ = numbered(own)
    leaks = decontam.matches(as_documents(rows), table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_row")).distinct()
    return back(rows.join(leaks, "_row", "left_anti"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of the text they decode to."""
    ship(spark)
    found = bpe.encode_documents(docs, public_tokenizers.path(TOKENIZER))
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


STAGES = [("language", language), ("quality", quality), ("deduplicate", deduplicate), ("decontaminate", decontaminate), ("tokenise", tokenise)]
#: No stage but the last steps of some is within SQL's means; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each on what the one before wrote."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
