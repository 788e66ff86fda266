"""Web addresses: canonical form, ids, safety predicates. Columns in, columns out.

Query parameters keep their own encoding; addresses that aren't http(s), and null, give null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.functions.text import normalise_title

# Parameters that only track where a reader came from.
TRACKING = (
    "fbclid gclid dclid gbraid wbraid msclkid yclid mc_cid mc_eid igshid ref ref_src ref_url referrer source src cmpid cmp ito ncid sr_share"
    " rss feed from share output outputtype amp _ga _gl spm smid partner"
).split()
TRACKING_PREFIXES = ("utm_", "mkt_", "pk_", "hsa_", "oly_", "vero_", "at_")
PARTS = r"(?i)^(https?)://([^/?#\s]+)([^?#\s]*)(?:\?([^#\s]*))?(?:#\S*)?$"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(F.trim(url), PARTS, group)


def is_http(url: Column) -> Column:
    """Whether a text is an http(s) address; false for null."""
    return F.coalesce(F.trim(url).rlike(PARTS), F.lit(False))


def host(url: Column) -> Column:
    """The host in lower case, without credentials, usual ports and one of www, m, mobile, amp."""
    plain = F.regexp_replace(F.lower(_part(url, 2)), r"^.*@", "")
    return F.when(is_http(url), F.regexp_replace(F.regexp_replace(plain, r":(80|443)$", ""), r"^(www|m|mobile|amp)\.", ""))


def path(url: Column) -> Column:
    """The path without AMP and index pages, double and trailing slashes."""
    p = _part(url, 3)
    for pattern, to in ((r"(?i)/amp/?$", "/"), (r"(?i)/index\.(html?|php)$", "/"), (r"/{2,}", "/"), (r"(.)/+$", "$1")):
        p = F.regexp_replace(p, pattern, to)
    return F.when(is_http(url), F.when(p == "", "/").otherwise(p))


def _tracks(pair: Column) -> Column:
    key = F.lower(F.split_part(pair, F.lit("="), F.lit(1)))
    found = key.isin(TRACKING)
    for prefix in TRACKING_PREFIXES:
        found = found | key.startswith(prefix)
    return found


def query(url: Column) -> Column:
    """The parameters that aren't tracking, in order of their keys, with "?" before; empty if there are none."""
    kept = F.filter(F.split(_part(url, 4), "&"), lambda x: (x != "") & ~_tracks(x))
    ordered = F.array_sort(F.transform(kept, lambda x, i: F.struct(F.split_part(x, F.lit("="), F.lit(1)).alias("k"), i.alias("i"), x.alias("x"))))
    joined = F.array_join(F.transform(ordered, lambda s: s["x"]), "&")
    return F.when(joined == "", "").otherwise(F.concat(F.lit("?"), joined))


def canonical(url: Column) -> Column:
    """One form for all links to an article."""
    return F.when(is_http(url), F.concat(F.lit("https://"), host(url), path(url), query(url)))


def short_hash(value: Column, length: int = 16) -> Column:
    return F.substring(F.sha2(value, 256), 1, length)


def article_id(canonical_url: Column) -> Column:
    return F.concat(F.lit("a_"), short_hash(canonical_url))


def job_id(key: Column) -> Column:
    return F.concat(F.lit("j_"), short_hash(key))


def employer_id(company: Column) -> Column:
    """By the company's name in its normal form."""
    return F.concat(F.lit("emp_"), short_hash(normalise_title(company)))


def story_id(first_article: Column) -> Column:
    return F.concat(F.lit("s_"), short_hash(first_article, 14))


def asset_url(ref: Column, base: str) -> Column:
    """Where an image asset (image-<id>-<size>-<format>) lies under a base address; null for anything else."""
    pattern = r"^image-([A-Za-z0-9]+)-(\d+x\d+)-([a-z0-9]+)$"
    return F.when(ref.rlike(pattern), F.concat(F.lit(f"{base}/"), F.regexp_replace(ref, pattern, "$1-$2.$3")))


def https_only(url: Column) -> Column:
    return F.when(url.rlike(r"""^https://[^\s"'<>]+$"""), url)


def segments(url: Column) -> Column:
    """The parts of the path in lower case."""
    return F.filter(F.split(F.lower(path(url)), "/"), lambda x: x != "")


def is_public(url: Column) -> Column:
    """Whether the host isn't private, loopback, link-local or a bare name."""
    h = F.regexp_replace(host(url), r":\d+$", "")
    private = h.rlike(r"^(10|127|0)\.|^192\.168\.|^169\.254\.|^172\.(1[6-9]|2\d|3[01])\.|^100\.(6[4-9]|[7-9]\d|1[01]\d|12[0-7])\.|^\[|(^|\.)(localhost|local|internal)$")
    return F.coalesce(is_http(url) & h.contains(".") & ~private, F.lit(False))


def safe_href(url: Column) -> Column:
    """https and mailto links as they are, else null."""
    trimmed = F.trim(url)
    return F.when(trimmed.rlike(r"(?i)^(https://[^\s/]+\S*|mailto:[^\s@]+@[^\s@]+)$"), trimmed)
