"""Hashes as Column expressions: FNV-1a of 64 bits, canonical JSON and the approval hashes made of both, and keyed SHA-256. None but `fnv_texts`, which is for many or long texts, asks for Python workers."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# FNV-1a's offset basis (high and low 32 bits), and its prime, which is 2 ** 40 + 435.
BASIS_HIGH, BASIS_LOW, PRIME_REST = 0xCBF29CE4, 0x84222325, 435
_LOW = (1 << 32) - 1
#: White space at the ends of a text that counts as none, beside what \s has.
_BLANK = r"[\s\x{a0}\x{feff}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
# Short escapes of JSON.
_ESCAPES = (("\\", "\\\\"), ('"', '\\"'), ("\b", "\\b"), ("\f", "\\f"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out once, however often it is used, also within lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def fnv1a64(text: Column) -> Column:
    """FNV-1a of 64 bits over a text's UTF-16 units, as 16 hex digits; null for null.

    The hash is kept in two halves of 32 bits, so that no product or sum leaves 64 bits and wrapping is a mask.
    """
    def step(h: Column, unit: Column) -> Column:
        low = h["low"].bitwiseXOR(unit)
        product = low * PRIME_REST
        high = h["high"] * PRIME_REST + F.shiftright(product, 32) + F.shiftleft(low, 8)  # the prime's 2 ** 40 moves the low half up by 8
        return F.struct(high.bitwiseAND(F.lit(_LOW)).alias("high"), product.bitwiseAND(F.lit(_LOW)).alias("low"))

    start = F.struct(F.lit(BASIS_HIGH).cast("long").alias("high"), F.lit(BASIS_LOW).cast("long").alias("low"))
    digits = lambda c: F.lpad(F.lower(F.hex(c)), 8, "0")

    def hashed(data: Column) -> Column:
        # two bytes a unit; an empty text has none
        at = F.when(F.octet_length(data) > 0, F.sequence(F.lit(0), F.octet_length(data) - 1, F.lit(2))).otherwise(F.array().cast("array<int>"))
        units = F.transform(at, lambda i: F.conv(F.hex(F.substring(data, i + 1, F.lit(2))), 16, 10).cast("long"))
        return F.when(data.isNotNull(), F.aggregate(units, start, step, lambda h: F.concat(digits(h["high"]), digits(h["low"]))))

    return once(F.encode(text, "UTF-16BE"), hashed)


#: Units of the texts of a batch that are laid side by side at a time.
_UNITS = 256


@F.pandas_udf(StringType())
def _fnv_texts(texts: pd.Series) -> pd.Series:
    known = texts.dropna()
    units = sorted(((np.frombuffer(t.encode("utf-16-le", "surrogatepass"), "<u2"), i) for i, t in known.items()), key=lambda u: -len(u[0]))
    sizes = np.array([len(u) for u, _ in units], dtype=np.int64)
    state = np.full(len(units), (BASIS_HIGH << 32) + BASIS_LOW, dtype=np.uint64)
    prime = np.uint64((1 << 40) + PRIME_REST)
    for at in range(0, int(sizes.max(initial=0)), _UNITS):
        # longest first, so those that still have units are the first so many
        left = np.searchsorted(-sizes, -np.arange(at, at + _UNITS), side="left")
        beside = np.zeros((_UNITS, left[0]), dtype=np.uint64)
        for j in range(left[0]):
            part = units[j][0][at : at + _UNITS]
            beside[: len(part), j] = part
        for row, n in zip(beside, left.tolist(), strict=True):
            state[:n] ^= row[:n]
            state[:n] *= prime
    found = pd.Series([f"{h:016x}" for h in state.tolist()], index=[i for _, i in units], dtype=object)
    return found.reindex(texts.index).where(texts.notna(), None)


def fnv_texts(text: Column) -> Column:
    """fnv1a64 for many or long texts: a batch of them is hashed unit by unit, side by side (through Python, so not within lambdas)."""
    return _fnv_texts(text)


def trimmed(text: Column) -> Column:
    """A text without blanks of any kind at its ends; empty for null."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"^{_BLANK}|{_BLANK}$", "")


def json_text(text: Column) -> Column:
    """A text as JSON: short escapes where there are any, \\u00xx for other control characters, all else as it is; null for null."""
    out = text
    for char, escape in _ESCAPES:
        out = F.replace(out, F.lit(char), F.lit(escape))
    spelled = lambda c: F.when(c < " ", F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(F.ascii(c))), 4, "0"))).otherwise(c)
    out = F.when(out.rlike(r"[\x00-\x1f]"), F.array_join(F.transform(F.split(out, ""), spelled), "")).otherwise(out)
    return F.coalesce(F.concat(F.lit('"'), out, F.lit('"')), F.lit("null"))


def json_list(items: Column) -> Column:
    """Texts as a JSON array; null as an empty one."""
    return F.concat(F.lit("["), F.array_join(F.transform(F.coalesce(items, F.array().cast("array<string>")), json_text), ","), F.lit("]"))


def json_object(members: dict[str, Column]) -> Column:
    """Members, each JSON already, in the order given."""
    parts = [F.concat(F.lit(("," if i else "") + f'"{name}":'), value) for i, (name, value) in enumerate(members.items())]
    return F.concat(F.lit("{"), *parts, F.lit("}"))


def _bool(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit(False)), "true").otherwise("false")


def _or_null(c: Column) -> Column:
    return json_text(F.nullif(trimmed(c), F.lit("")))


def _time(c: Column) -> Column:
    utc = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return json_text(utc)


def _sorted(refs: Column) -> Column:
    """References in order, without null and empty ones. The order is that of code points; ids are ASCII."""
    return json_list(F.array_sort(F.filter(refs, lambda r: F.coalesce(r != "", F.lit(False)))))


def _number(c: Column) -> Column:
    return F.coalesce(c.cast("long").cast("string"), F.lit("null"))


def story_content(d: Column | None = None) -> Column:
    """What the approval of a story vouches for, in one fixed shape: equal content gives equal text.

    Columns: headline, slug, summary, summary_source, capital_types and asset_classes (arrays of references), geography (array), transaction_type, featured, image (asset, credit,
    rights_confirmed), seo (title, description), duplicate_of, published_at (a timestamp of a session in UTC, or one without zone).
    """
    c = (lambda name: F.col(name)) if d is None else (lambda name: d[name])
    image = json_object({"asset": json_text(c("image")["asset"]), "credit": json_text(trimmed(c("image")["credit"])), "rightsConfirmed": _bool(c("image")["rights_confirmed"])})
    return json_object({
        "headline": json_text(trimmed(c("headline"))), "slug": json_text(trimmed(c("slug"))), "summary": json_text(trimmed(c("summary"))), "summarySource": _or_null(c("summary_source")),
        "capitalTypes": _sorted(c("capital_types")), "assetClasses": _sorted(c("asset_classes")), "geography": json_list(F.array_sort(c("geography"))), "transactionType": _or_null(c("transaction_type")),
        "featured": _bool(c("featured")), "image": F.when(F.coalesce(c("image")["asset"] != "", F.lit(False)), image).otherwise("null"),
        "seo": json_object({"title": json_text(trimmed(c("seo")["title"])), "description": json_text(trimmed(c("seo")["description"]))}),
        "duplicateOf": json_text(F.nullif(c("duplicate_of"), F.lit(""))), "publishedAt": _time(c("published_at")),
    })


def job_content() -> Column:
    """The same for a job: title, slug, company, employer, company_url, location, work_mode, employment_type, seniority, department, regulator, url,
    salary_from, salary_to, salary_currency, salary_period, visa, description, requirements (array, blank lines don't count), expires_at."""
    c = F.col
    text, maybe = (lambda n: json_text(trimmed(c(n)))), (lambda n: _or_null(c(n)))
    lines = F.filter(F.transform(c("requirements"), trimmed), lambda x: x != "")
    return json_object({
        "title": text("title"), "slug": text("slug"), "company": text("company"), "employer": json_text(F.nullif(c("employer"), F.lit(""))), "companyUrl": maybe("company_url"), "location": text("location"),
        "workMode": maybe("work_mode"), "employmentType": maybe("employment_type"), "seniority": maybe("seniority"), "department": maybe("department"), "regulator": maybe("regulator"), "url": text("url"),
        "salaryFrom": _number(c("salary_from")), "salaryTo": _number(c("salary_to")), "salaryCurrency": maybe("salary_currency"), "salaryPeriod": maybe("salary_period"), "visa": maybe("visa"),
        "description": text("description"), "requirements": json_list(lines), "expiresAt": _time(c("expires_at")),
    })


def approval_hash() -> Column:
    """The hash of a story's approved content (see story_content)."""
    return fnv1a64(story_content())


def job_approval_hash() -> Column:
    return fnv_texts(job_content())


def _masked(key: Column, mask: int) -> Column:
    """A key of at most 64 bytes, filled up with zeros, each byte XOR a mask."""
    byte = lambda i: F.coalesce(F.conv(F.nullif(F.hex(F.substring(key, i, F.lit(1))), F.lit("")), 16, 10).cast("int"), F.lit(0))
    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.lpad(F.hex(byte(i).bitwiseXOR(F.lit(mask))), 2, "0")), ""))


def hmac_sha256(key: Column, message: Column) -> Column:
    """HMAC-SHA-256 of binary columns, as 64 hex digits; null if either is null. Keys over 64 bytes are hashed first; masks are the standard's 0x36 and 0x5c."""

    def keyed(short: Column) -> Column:
        inner = F.unhex(F.sha2(F.concat(_masked(short, 0x36), message), 256))
        return F.when(short.isNotNull(), F.sha2(F.concat(_masked(short, 0x5C), inner), 256))

    return once(F.when(F.octet_length(key) > 64, F.unhex(F.sha2(key, 256))).otherwise(key), keyed)


def hashed_address(address: Column, salt: Column) -> Column:
    """32 hex digits that stand for a visitor's address under a salt; all unknown ones share one."""
    known = F.coalesce(F.nullif(address, F.lit("")), F.lit("unknown"))
    return F.left(hmac_sha256(salt.cast("binary"), known.cast("binary")), F.lit(32))
