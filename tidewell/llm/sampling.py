"""Bounded samples of labelled rows to fit models on, and which rows are held out of them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: str, mod: int) -> Column:
    """crc32 of an id as text, modulo mod; -1 for a null id, which no fold has."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % mod, F.lit(-1))


def labelled(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, rows: int, salt: str) -> tuple[pa.Table, dict[int, int]]:
    """(text, label) of about `rows` documents for each label 0 and 1, and how many documents have each label.

    Rows are drawn by a hash of doc_id at a rate that the labels' counts give; all are taken where there are fewer. The
    draw is made among labels first, so the texts of the other documents aren't moved.
    """
    known = labels.filter(allowed & F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("label"))
    many = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    draw = F.pmod(F.xxhash64(F.lit(salt), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    keep = F.coalesce(*[F.when(F.col("label") == k, draw < rows / n) for k, n in many.items()], F.lit(False))
    drawn = known.filter(keep).groupBy("doc_id").agg(F.max("label").alias("label"))
    # at most a few thousand ids, by the rate above
    found = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("doc_id", "text", "label")
    return found.toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")]).select(["text", "label"]), many
