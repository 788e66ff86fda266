"""Instants and calendar days. Sessions are in UTC; a day in Dubai is four hours ahead."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.functions.hashes import once

# Zone names of feeds that Java doesn't parse.
ZONES = {"UT": "+0000", "UTC": "+0000", "GMT": "+0000", "Z": "+0000", "GST": "+0400", "EET": "+0200", "EEST": "+0300", "CET": "+0100", "CEST": "+0200", "EST": "-0500", "EDT": "-0400"}
FORMATS = ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z", "d MMM yyyy HH:mm:ss", "d MMM yyyy HH:mm", "d MMM yyyy", "yyyy-MM-dd HH:mm:ss", "MMM d, yyyy")


def parse(text: Column) -> Column:
    """A feed's date as an instant: ISO or RFC 822 with or without a weekday and zone (none: UTC); years 1990 to 2100, else null."""
    t = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3,9},\s*", "")
    for zone, offset in ZONES.items():
        t = F.regexp_replace(t, rf"(?<=\d)\s+{zone}$", f" {offset}")

    def read(t: Column) -> Column:
        iso = F.when(t.rlike(r"^\d{4}-\d\d-\d\d([T ].*)?$"), F.try_to_timestamp(t))
        return F.coalesce(iso, *[F.try_to_timestamp(t, F.lit(f)) for f in FORMATS])

    return once(once(t, read), lambda found: F.when(F.year(found).between(1990, 2100), found))


def dubai_day(instant: Column) -> Column:
    return F.to_date(instant + F.expr("interval 4 hours"))


def posted_ago(instant: Column, now: Column) -> Column:
    """How long ago, in days under 14, weeks under 60 days, else months; empty without an instant."""
    days = F.greatest(F.lit(0), F.floor((F.unix_millis(now.cast("timestamp")) - F.unix_millis(instant.cast("timestamp"))) / 86_400_000))
    said = lambda n, unit: F.format_string(f"Posted %d {unit} ago", n.cast("long"))
    ago = F.when(days < 1, "Posted today").when(days < 14, said(days, "days")).when(days < 60, said(F.floor(days / 7), "weeks")).otherwise(said(F.floor(days / 30), "months"))
    return F.when(instant.isNull(), "").otherwise(ago)


def real_day(text: Column) -> Column:
    """A calendar day written YYYY-MM-DD, null if there is no such day."""
    t = F.trim(text)
    return F.when(t.rlike(r"^\d{4}-\d\d-\d\d$"), F.try_to_timestamp(t, F.lit("yyyy-MM-dd")).cast("date"))


def past_day(text: Column, today: Column) -> Column:
    """Whether a text is a real day, not after today."""
    return F.coalesce(real_day(text) <= today, F.lit(False))


def event_days(start: Column, end: Column) -> tuple[Column, Column]:
    """Day and month of an event: "3" and "Feb", or "28-2" and "Feb-Mar" if it lasts."""
    day, month = lambda d: F.dayofmonth(d).cast("string"), lambda d: F.date_format(d, "MMM")
    lasts = F.coalesce(end != start, F.lit(False))
    months = F.when(lasts & (month(end) != month(start)), F.concat_ws("-", month(start), month(end))).otherwise(month(start))
    return F.when(lasts, F.concat_ws("-", day(start), day(end))).otherwise(day(start)), months


def offset_ms(spec: Column) -> Column:
    """Milliseconds of a span such as -2d3h10m."""
    total = F.lit(0).cast("long")
    for unit, ms in (("d", 86_400_000), ("h", 3_600_000), ("m", 60_000)):
        total = total + F.aggregate(F.regexp_extract_all(spec, F.lit(rf"(\d+){unit}"), 1), F.lit(0).cast("long"), lambda a, n: a + n.cast("long")) * ms
    return F.when(spec.startswith("-"), -total).otherwise(total)
