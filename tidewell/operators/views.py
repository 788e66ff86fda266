"""Views that are served: first occurrences, top rows of groups, leads, slugs, facets, pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_of(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row for each key: the first in order. An aggregate, so a key with very many rows is reduced before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("_first")
    return df.groupBy(*keys).agg(first).select(*keys, *[F.col(f"_first.{c}").alias(c) for c in rest])


def top_n(df: DataFrame, group: str, order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each group with their rank; tasks keep n of each group before the shuffle."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def distinct_slugs(df: DataFrame, slug: str, newest_first: Sequence[Column], suffix: Column) -> DataFrame:
    """The newest row keeps a slug, older ones get a suffix; one pass."""
    w = Window.partitionBy(slug).orderBy(*newest_first)
    return df.withColumn(slug, F.when(F.row_number().over(w) > 1, F.concat_ws("-", F.col(slug), suffix)).otherwise(F.col(slug)))


def any_of(wanted: Sequence[str], tags: Column) -> Column:
    """Whether a row has one of the wanted tags; no wish is true."""
    return F.lit(True) if not wanted else F.coalesce(F.arrays_overlap(tags, F.array(*map(F.lit, wanted))), F.lit(False))


def matches_all(query: str, text: Column) -> Column:
    """Whether every blank-separated part of a query is in a text."""
    found = F.lit(True)
    for part in query.lower().split():
        found = found & F.contains(F.lower(text), F.lit(part))
    return found


def page(df: DataFrame, order: Sequence[Column], offset: int, limit: int) -> DataFrame:
    """A page of rows in order, each with the total of all rows; past the last row one row with the total and nulls."""
    total = df.agg(F.count("*").alias("total"))  # one row
    shown = df.orderBy(*order).offset(offset).limit(limit)
    return F.broadcast(total).join(shown, F.lit(True), "left").select(*df.columns, "total")


def filtered(df: DataFrame, facets: dict[str, Sequence[str]], query: str, text: str, order: Sequence[Column], featured: Column, pages: int = 1, newest: bool = True, page_size: int = 20) -> DataFrame:
    """The first pages of rows that have one of each facet's wanted tags and all words of a query, with rank, total and has_more.

    Featured rows come first only where nothing is asked for and the newest are.
    """
    kept = df
    for column, wanted in facets.items():
        kept = kept.filter(any_of(wanted, F.col(column)))
    kept = kept.filter(matches_all(query, F.col(text)))
    pin = [F.desc(F.coalesce(featured, F.lit(False)))] if newest and not query.split() and not any(facets.values()) else []
    shown = kept.orderBy(*pin, *order).limit(pages * page_size)
    # the window runs over the pages shown, the total over all rows
    ranked = shown.withColumn("rank", F.row_number().over(Window.orderBy(*pin, *order)))
    total = kept.agg(F.count("*").alias("total"))
    return ranked.join(F.broadcast(total), F.lit(True)).withColumn("has_more", F.col("total") > pages * page_size)


def parse_query(search: str, known: dict[str, Sequence[str]], most: int = 20, longest: int = 100) -> dict:
    """A page's state from its query string: what is malformed, repeated or unknown is left out, never an error."""
    import re
    from urllib.parse import parse_qs

    given = {k: v[0] for k, v in parse_qs((search or "").lstrip("?"), keep_blank_values=True).items()}
    ids = lambda k: [x for x in list(dict.fromkeys(i.strip() for i in given.get(k, "").split(",") if re.fullmatch("[a-z0-9-]{1,60}", i.strip())))[:most] if x in known.get(k, ())]
    page = int(given["page"]) if re.fullmatch(r"\d{1,4}", given.get("page", "")) else 1
    return {
        "capital": ids("capital"), "asset": ids("asset"), "geo": ids("geo"), "section": (ids("section") or [""])[0], "q": " ".join(given.get("q", "").split())[:longest],
        "sort": "oldest" if given.get("sort") == "oldest" else "newest", "page": page if 1 < page <= 500 else 1,
    }


def checked(given: dict[str, str], ints: dict[str, tuple[int, int, int]], enums: dict[str, Sequence[str]], lists: dict[str, Sequence[str]], texts: Sequence[str] = ("q",), most: int = 20, longest: int = 100) -> dict:
    """An API's parameters with their defaults; an unknown one, or a value out of range, is a ValueError that names it."""
    out: dict = {k: d for k, (_, _, d) in ints.items()} | dict.fromkeys(enums) | {k: [] for k in lists} | dict.fromkeys(texts, "")
    for k, v in given.items():
        if k in ints:
            low, high, _ = ints[k]
            if not v.isascii() or not v.isdigit() or not low <= int(v) <= high:
                raise ValueError(f"{k} must be a whole number from {low} to {high}")
            out[k] = int(v)
        elif k in enums:
            if v not in enums[k]:
                raise ValueError(f"{k} must be one of {', '.join(enums[k])}")
            out[k] = v
        elif k in lists:
            out[k] = list(dict.fromkeys(x.strip() for x in v.split(",") if x.strip()))
            if len(out[k]) > most or set(out[k]) - set(lists[k]):
                raise ValueError(f"{k} has unknown or too many ids")
        elif k in texts:
            if len(v) > longest:
                raise ValueError(f"{k} must have {longest} characters at most")
            out[k] = v.strip()
        else:
            raise ValueError(f"unknown parameter {k}")
    return out
