"""Rendezvous (highest random weight) sharding by a stable record key, in DataFrame functions only.

Every shard s has a weight w and gives each key a number u in (0, 1) from md5("key/s"). The key goes to
the shard with the largest w / -ln(u), which makes a shard's expected share proportional to its weight.
A shard's numbers don't depend on which other shards exist, so a shard that is added takes rows only into
itself, and a shard that is removed gives its rows to the others and moves nothing else.

Defined results: a null key is hashed as the text "null"; rows with equal keys share a shard; a null text has size 1
and the checksum 0 of no bytes; an empty table gives an empty table. Input columns that aren't used are
ignored, whatever their names. A tie of scores goes to the lower shard.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of the key's hash within a shard; slots are numbered bucket by bucket, so that no task holds a shard.
SLOT_BUCKETS = 65_536
#: Digits of the hash taken for a number in (0, 1): 13 hex digits, 52 bits.
DIGITS = 13


def _part(digest: Column, first: int, digits: int) -> Column:
    return F.conv(F.substring(digest, first, digits), 16, 10).cast("long")


def _score(key: Column, shard: int, weight: float) -> Column:
    u = (_part(F.md5(F.concat(key, F.lit(f"/{shard}"))), 1, DIGITS) + F.lit(0.5)) / F.lit(float(16**DIGITS))
    return F.struct((F.lit(float(weight)) / -F.log(u)).alias("score"), F.lit(-shard).alias("shard"))


def choose(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a key among len(weights) weighted shards."""
    if not weights or min(weights) <= 0:
        raise ValueError("there must be shards, all with a weight over 0")
    text = F.coalesce(key.cast("string"), F.lit("null"))
    scores = [_score(text, s, w) for s, w in enumerate(weights)]
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    return (-best["shard"]).cast("int")


def shard(df: DataFrame, key: str, payload: dict[str, Column], weights: Sequence[float], added: float = 1.0) -> DataFrame:
    """`key`, the payload columns, `shard`, `slot` and `grown_shard` (with one more shard of weight `added`).

    slot: 0, 1, ... within each shard, by (hash bucket of the key, key, payload). The hash buckets' counts are
    summed within a shard to get where each bucket begins; rows are numbered within (shard, bucket) only.
    Rows of one key beyond a task's share are the one group that can't be split by key, as they have one place
    in the order; keys are meant to be record ids.
    """
    text = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    placed = df.select(
        F.col(key),
        *[value.alias(name) for name, value in payload.items()],
        choose(F.col(key), weights).alias("shard"),
        choose(F.col(key), [*weights, added]).alias("grown_shard"),
        (_part(F.md5(text), 1, 8) % SLOT_BUCKETS).cast("int").alias("_bucket"),
    )
    counts = df.select(choose(F.col(key), weights).alias("shard"), (_part(F.md5(text), 1, 8) % SLOT_BUCKETS).cast("int").alias("_bucket"))
    counts = counts.groupBy("shard", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("shard", "_bucket").orderBy(key, *payload)
    slot = (F.col("_start") + F.row_number().over(within) - 1).cast("long")
    return placed.join(starts, ["shard", "_bucket"]).select(key, *payload, "shard", slot.alias("slot"), "grown_shard")


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Documents over equal shards: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + F.lit(1)
    crc = F.coalesce(F.crc32(F.encode("text", "UTF-8")), F.lit(0)).cast("long")
    out = shard(docs, "doc_id", {"size": size, "text_crc32": crc}, [1.0] * shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def oracle(shards: int = 16) -> str:
    """DuckDB's words for shard_documents; the checksum is folded byte by byte over a table made by its rule."""
    hexed = lambda text, n: f"cast('0x' || substr(md5({text}), 1, {n}) as bigint)"
    score = f"1.0 / -ln(({hexed("k || '/' || s", DIGITS)} + 0.5) / {float(16**DIGITS)!r})"
    return f"""
with recursive bits(i, c, step) as (
  select i::bigint, i::bigint, 0 from range(256) t(i)
  union all
  select i, case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end, step + 1 from bits where step < 8),
crc as (select list(c order by i) as t from bits where step = 8),
d as (select row_number() over () as r, doc_id, text, coalesce(cast(doc_id as varchar), 'null') as k from documents),
b as (select r, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda v: cast('0x' || v as bigint)) as x from d where length(text) > 0),
sums as (select r, xor(list_reduce(list_prepend(4294967295, x), lambda a, v: xor(a // 256, t[xor(a % 256, v) + 1])), 4294967295) as crc from b, crc),
e as (select r, s, {score} as score from d, range({shards + 1}) t(s)),
p as (select r, arg_max(s, (score, -s)) filter (s < {shards}) as shard, arg_max(s, (score, -s)) as grown from e group by r)
select doc_id, cast(coalesce(strlen(text), 0) + 1 as bigint) as size, cast(coalesce(crc, 0) as bigint) as text_crc32, 'key' as law,
  cast(shard as int) as shard, row_number() over (partition by shard order by {hexed('k', 8)} % {SLOT_BUCKETS}, doc_id, coalesce(strlen(text), 0), coalesce(crc, 0)) - 1 as slot,
  cast(grown as int) as grown_shard
from d join p using (r) left join sums using (r)"""
