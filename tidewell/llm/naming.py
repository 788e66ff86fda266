"""Exact dedup by deterministic block naming, in DataFrame functions only.

Texts are cut into blocks of a fixed number of UTF-8 bytes. Distinct blocks are sorted within hash partitions and
numbered, so each has one integer name; then the names of neighbouring blocks are paired, distinct pairs are sorted and numbered
in turn, and so on until each text has one name. A name of round k stands for one sequence of up to 2^k
blocks, and no sequence has two, so (round, name) is equal exactly where texts are equal: no hash decides.

Blocks are moved once, to be sorted; their names are looked up by a 64-bit hash of the block. Hashes that several
blocks share are found among the sorted blocks, and those blocks are looked up by their bytes. Sorting counts each
distinct block once a map task, and names of blocks, pairs and groups that make up more than one in HOT of all rows
(so fewer than HOT of them) are broadcast, so a block or text that a third of the rows hold makes no large task.

Defined results: a null text counts as the empty one, which is one empty block; of equal texts the row with the
largest doc_id stays (a null one is the smallest; of rows that share it, one of them); an empty table gives an empty
table; input columns but doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.textbatch import identified
from tidewell.session import discard, materialise

#: Bytes of a block.
BLOCK = 512
#: A key is hot if it has more than one in so many of all rows.
HOT = 1000
#: What blocks are looked up by.
HASH = "xxhash64(_block)"
#: Stands for the missing second half of a pair at a text's end; names are 0 or more.
NONE = -1


def _named(groups: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys with `n` of their rows, and `_name`, their number in sorted order within partitions; written, so that a name stays."""
    ordered = groups.sortWithinPartitions(*keys)
    return materialise(ordered.withColumn("_name", F.monotonically_increasing_id()), "names")


def looked_up(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the columns of a table that holds each of their keys once, with `n`, the number of its rows.

    Keys with more than one in HOT of all rows, fewer than HOT of them, are broadcast; the others are shuffled.
    """
    total = table.agg(F.sum("n")).first()[0] or 0
    is_hot = F.col("n") * HOT > F.lit(total)
    hot = F.broadcast(table.filter(is_hot))
    near = rows.join(hot, keys)
    far = rows.join(hot.select(keys), keys, "left_anti").join(table.filter(~is_hot), keys)
    return near.unionByName(far)


def first_names(rows: DataFrame, block: int, hashed: str = HASH) -> DataFrame:
    """`_row`, `_pos`, `_left` (how many names the text has) and `_name` of every block of rows (`_row`, `text`)."""
    data = rows.select("_row", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("_bytes"))
    many = F.greatest(F.lit(1), F.ceil(F.octet_length("_bytes") / block)).cast("int")
    cut = data.select("_row", "_bytes", many.alias("_left")).select("*", F.explode(F.sequence(F.lit(0), F.col("_left") - 1)).alias("_pos"))
    blocks = cut.select("_row", "_pos", "_left", F.substring(F.col("_bytes"), F.col("_pos") * block + 1, F.lit(block)).alias("_block"))
    blocks = blocks.withColumn("_hash", F.expr(hashed))
    names = _named(blocks.groupBy("_hash", "_block").agg(F.count(F.lit(1)).alias("n")), ["_block"])
    shared = names.groupBy("_hash").agg(F.count(F.lit(1)).alias("_many")).filter("_many > 1").select("_hash")
    by_hash, places = names.select("_hash", "_name", "n"), blocks.select("_row", "_pos", "_left", "_hash")
    out = ["_row", "_pos", "_left", "_name"]
    if shared.isEmpty():
        found = looked_up(places, by_hash, ["_hash"]).select(out)
    else:
        found = looked_up(places.join(shared, "_hash", "left_anti"), by_hash.join(shared, "_hash", "left_anti"), ["_hash"]).select(out)
        clashing = names.join(shared, "_hash", "left_semi").select("_hash", "_block", "_name", "n")
        found = found.unionByName(looked_up(blocks.join(shared, "_hash", "left_semi"), clashing, ["_hash", "_block"]).select(out))
    found = materialise(found, "blocks")
    discard(names)
    return found


def identities(rows: DataFrame, block: int = BLOCK, hashed: str = HASH) -> DataFrame:
    """`_row`, `_round` and `_name` of each of rows (`_row`, `text`): equal in the last two exactly where texts are equal.

    hashed: SQL of what blocks (`_block`) are looked up by.
    """
    names = first_names(rows, block, hashed)
    most = names.agg(F.max("_left")).first()[0] or 0
    ended, level = [], 0
    while True:
        ended.append(names.filter("_left = 1").select("_row", F.lit(level).alias("_round"), "_name"))
        if most <= 1:
            break
        level, most = level + 1, -(-most // 2)
        side = lambda odd: F.max(F.when(F.col("_pos") % 2 == odd, F.col("_name")))
        pairs = (
            names.filter("_left > 1").groupBy("_row", F.expr("_pos div 2").cast("int").alias("_half"))
            .agg(F.max("_left").alias("_whole"), side(0).alias("_a"), F.coalesce(side(1), F.lit(NONE)).alias("_b"))
            .select("_row", F.col("_half").alias("_pos"), F.ceil(F.col("_whole") / 2).cast("int").alias("_left"), "_a", "_b")
        )
        pairs = materialise(pairs, "pairs")
        numbered = _named(pairs.groupBy("_a", "_b").agg(F.count(F.lit(1)).alias("n")), ["_a", "_b"])
        names = materialise(looked_up(pairs, numbered, ["_a", "_b"]).select("_row", "_pos", "_left", "_name"), "blocks")
        discard(pairs, numbered)
    whole = ended[0]
    for more in ended[1:]:
        whole = whole.unionByName(more)
    return whole


def exact_duplicates(docs: DataFrame, block: int = BLOCK, hashed: str = HASH) -> DataFrame:
    """doc_id, keep_id (of the row that stays), group_size, kept and text_sha256 of every document."""
    rows = identified(docs.select("doc_id", "text"))
    who = rows.select("_row", "doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
    members = materialise(identities(rows, block, hashed).join(who, "_row"), "members")
    best = F.max(F.struct("doc_id", "_row")).alias("_best")
    groups = materialise(members.groupBy("_round", "_name").agg(F.count(F.lit(1)).alias("n"), best), "groups")
    out = looked_up(members, groups, ["_round", "_name"])
    return out.select("doc_id", F.col("_best.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("_row") == F.col("_best._row")).alias("kept"), "text_sha256")


def oracle() -> str:
    """DuckDB's words for exact_duplicates where doc_ids differ."""
    return """
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size, doc_id = max(doc_id) over same as kept, sha256(coalesce(text, '')) as text_sha256
from documents window same as (partition by coalesce(text, ''))"""
