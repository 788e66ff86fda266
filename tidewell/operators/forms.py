"""Forms as rules for columns: each rule cleans a field and says what is wrong with it; a schema puts them together.

A rule is a function of a raw column and today's date that gives (value, error), error being null where all is well.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions import dates as D
from tidewell.functions import text as T
from tidewell.functions import url as U

Rule = Callable[[Column, Column], tuple[Column, Column]]
#: Fixed value: what an address of an e-mail looks like.
EMAIL = r"(?i)^[^\s@\"<>()\[\]\\,;:]{1,64}@(?=.{1,253}$)(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,63}$"
_MISSING = "This field is required."


def _rule(required: bool, check: Callable[[Column, Column], tuple[Column, Column]]) -> Rule:
    def apply(raw: Column, today: Column) -> tuple[Column, Column]:
        missing = F.trim(F.coalesce(raw, F.lit(""))) == ""
        value, error = check(raw, today)
        said = F.when(missing, F.lit(_MISSING) if required else F.lit(None)).otherwise(error)
        return F.when(~missing & said.isNull(), value), said

    return apply


def text(low: int = 1, high: int = 120, required: bool = True, multiline: bool = False) -> Rule:
    def check(raw: Column, today: Column) -> tuple[Column, Column]:
        value = T.clean(raw, multiline)
        return value, F.when(F.length(value) < low, f"Enter at least {low} characters.").when(F.length(value) > high, f"Use {high} characters or fewer.")

    return _rule(required, check)


def email(required: bool = True) -> Rule:
    def check(raw: Column, today: Column) -> tuple[Column, Column]:
        value = T.clean(raw)
        return value, F.when((F.length(value) > 254) | ~value.rlike(EMAIL), "Enter a valid email address.")

    return _rule(required, check)


def https_url(required: bool = True, high: int = 500) -> Rule:
    def check(raw: Column, today: Column) -> tuple[Column, Column]:
        value = T.clean(raw)
        said = F.when(F.length(value) > high, f"Use a link of {high} characters or fewer.").when(~value.rlike(r"(?i)^https://[^\s/@]+([/?#]\S*)?$"), "Enter a link that starts with https://")
        return value, said.when(~U.is_public(value), "Enter a public website address.")

    return _rule(required, check)


def one_of(options: Sequence[str], required: bool = True) -> Rule:
    return _rule(required, lambda raw, today: (F.trim(raw), F.when(~F.trim(raw).isin(list(options)), "Choose one of the listed options.")))


def day(required: bool = True, low: int = -3650, high: int = 3650) -> Rule:
    """A real day written YYYY-MM-DD, from so many days after today to so many."""

    def check(raw: Column, today: Column) -> tuple[Column, Column]:
        at = D.real_day(raw)
        said = F.when(~F.trim(raw).rlike(r"^\d{4}-\d\d-\d\d$"), "Enter a date as YYYY-MM-DD.").when(at.isNull(), "Enter a real date.")
        return F.trim(raw), said.when(at < F.date_add(today, low), "This date is too far in the past.").when(at > F.date_add(today, high), "This date is too far in the future.")

    return _rule(required, check)


def whole_number(low: int, high: int, required: bool = True) -> Rule:
    def check(raw: Column, today: Column) -> tuple[Column, Column]:
        digits = F.regexp_replace(raw, r"[\s,]", "")
        n = F.when(digits.rlike(r"^\d{1,12}$"), digits.try_cast("long"))
        return n, F.when(n.isNull(), "Enter a whole number, for example 25000.").when(n < low, f"Enter at least {low}.").when(n > high, f"Enter {high} or less.")

    return _rule(required, check)


def identifier() -> Rule:
    return _rule(True, lambda raw, today: (raw, F.when(~raw.rlike("^[a-z0-9][a-z0-9-]{1,60}$"), "Use lowercase letters, numbers and dashes only.")))


def honeypot() -> Rule:
    """A field that only machines fill in; see validate."""
    rule = _rule(False, lambda raw, today: (raw, F.lit(None).cast("string")))
    rule.honeypot = True
    return rule


def validate(forms: DataFrame, fields: Mapping[str, Rule], today: Column, check: Callable[[dict[str, Column]], dict[str, Column]] | None = None, payload: str = "payload") -> DataFrame:
    """forms with value (struct of cleaned fields), errors (map of field to what is wrong), ok and spam.

    payload: a map of strings. Fields that the schema doesn't have are errors; what `check` says about values together counts only where all fields are well.
    """
    raw = F.col(payload)
    made = {name: rule(raw[name], today) for name, rule in fields.items()}
    traps = [name for name, rule in fields.items() if getattr(rule, "honeypot", False)]
    named = forms.withColumns({f"_v_{n}": v for n, (v, _) in made.items() if n not in traps} | {f"_e_{n}": e for n, (_, e) in made.items() if n not in traps})
    unknown = F.transform(F.filter(F.map_keys(raw), lambda k: ~k.isin(list(fields))), lambda k: F.struct(k.alias("key"), F.lit("Unknown field.").alias("value")))
    own = [F.struct(F.lit(n).alias("key"), F.col(f"_e_{n}").alias("value")) for n in fields if n not in traps]
    said = F.filter(F.concat(unknown, F.array(*own)), lambda s: s["value"].isNotNull())
    if check:
        together = [F.struct(F.lit(n).alias("key"), e.alias("value")) for n, e in check({n: F.col(f"_v_{n}") for n in fields if n not in traps}).items()]
        said = F.when(F.size(said) == 0, F.filter(F.array(*together), lambda s: s["value"].isNotNull())).otherwise(said)
    spam = F.lit(False)
    for n in traps:
        spam = spam | (F.trim(F.coalesce(raw[n], F.lit(""))) != "")
    out = named.withColumn("errors", F.map_from_entries(said)).withColumn("ok", F.size("errors") == 0).withColumn("spam", spam)
    value = F.struct(*[F.col(f"_v_{n}").alias(n) for n in fields if n not in traps])
    return out.withColumn("value", F.when(F.col("ok"), value)).select(*forms.columns, "value", "errors", "ok", "spam")


def outcome(ok: Column, spam: Column) -> Column:
    """What becomes of a form: spam is thanked for and thrown away, errors are shown, the rest is stored."""
    return F.when(spam, "dropped").when(~ok, "refused").otherwise("stored")


def all_or_nothing(rows: DataFrame) -> DataFrame:
    """The rows if all are ok; an error if one isn't, so that nothing of a faulty list is written."""
    bad = rows.filter("not ok").select("errors").limit(5).collect()
    if bad:
        raise ValueError("; ".join(f"{k}: {v}" for r in bad for k, v in r.errors.items()))
    return rows


def last_after_first(first: str, last: str, said: str) -> Callable[[dict[str, Column]], dict[str, Column]]:
    """A check that one value isn't before another."""
    return lambda v: {last: F.when(v[last] < v[first], said)}


CONTACT = {"name": text(2, 80), "email": email(), "subject": text(2, 120), "message": text(10, 4000, multiline=True), "website": honeypot()}
NEWSLETTER = {"email": email(), "placement": one_of(["home", "careers"]), "website": honeypot()}
ADVERTISE = {"name": text(2, 80), "email": email(), "company": text(2, 120), "tier": identifier(), "message": text(0, 2000, required=False, multiline=True), "website": honeypot()}
EVENT = {
    "title": text(3, 90), "eventType": text(2, 40), "startDate": day(low=-1, high=730), "endDate": day(False, -1, 760), "city": text(2, 60), "url": https_url(False),
    "organiser": text(2, 120), "email": email(), "website": honeypot(),
}
EVENT_CHECK = last_after_first("startDate", "endDate", "The end date must be on or after the start date.")


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    """Keys that a list has more than once."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def over_limit(rows: DataFrame, group: str, most: int) -> DataFrame:
    """Groups that have more enabled rows than fit."""
    return rows.filter(F.coalesce("enabled", F.lit(True))).groupBy(group).agg(F.count("*").alias("n")).filter(F.col("n") > most)


def visible(enabled: Column, demo_only: Column, demo: bool) -> Column:
    """Whether a row is shown: not switched off, and an example only in a demo."""
    return F.coalesce(enabled, F.lit(True)) & (F.lit(demo) | ~F.coalesce(demo_only, F.lit(False)))
