"""Jobs that employers post and editors approve: which of them are public and why others are held, what an editor's action makes of them, their listings, and the lists that editors pick.

A posting has the columns id, status, approved_by, approved_at, content_hash (of what was approved), published_at, first_published_at (texts of dates), and what an approval
vouches for: title, slug, company, employer (id of an employer's document), company_url, location, work_mode, employment_type, seniority, department, regulator, url, salary_from and
salary_to (numbers, whole or not), salary_currency, salary_period, visa, description, requirements (array), expires_at (text of a date). Sessions are in UTC.

Defined results: a posting is held if any column that a rule needs is null, empty or of blanks; blank requirements don't count. Lengths are those of UTF-16 units, blanks at the ends aside.
Each row is a posting of its own, whatever its id; employers that share a document id are one, the greatest by (id, name). Other columns are kept by `gated`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions import dates, hashes
from tidewell.functions import text as T
from tidewell.functions import url as U
from tidewell.operators import lifecycle, publish, rules
from tidewell.session import held

# Lengths, limits and choices of a posting, and the forms of ids.
LENGTHS = {"title": (3, 160), "company": (2, 120), "location": (2, 160), "slug": (3, 96), "description": (50, 5000)}
REQUIREMENTS, REQUIREMENT = 20, (2, 200)
SALARY_MAX = 100_000_000
LIVE_DAYS = 60
EMPLOYER_NAME, EMPLOYER_TEXT = (2, 120), 400
CHOICES = {
    "salary_currency": ("AED", "USD"),
    "salary_period": ("month", "year"),
    "visa": ("Visa sponsorship offered", "Must hold own UAE visa", "Remote from abroad"),
}
OPTIONAL_CHOICES = {
    "work_mode": ("Onsite", "Hybrid", "Remote"),
    "employment_type": ("Full-time", "Part-time", "Contract", "Internship", "Temporary"),
    "seniority": ("Entry-level", "Analyst", "Associate", "Vice President", "Director", "Managing Director / Partner", "C-suite"),
    "department": (
        "Investments and Portfolio Management", "Private Equity and Venture Capital", "Private Credit and Lending",
        "Investment Banking and Advisory", "Wealth Management and Private Banking", "Research and Analysis", "Risk Management",
        "Compliance and AML", "Legal", "Finance and Accounting", "Fund Administration and Operations",
        "Investor Relations and Fundraising", "Sales and Business Development", "Technology and Data",
        "Real Estate and Infrastructure", "Human Resources",
    ),
    "regulator": ("DFSA (DIFC)", "FSRA (ADGM)", "SCA", "CBUAE", "VARA", "Not a regulated role"),
}
POSTING_ID = r"^jobs\.[A-Za-z0-9_-]{4,64}$"
EMPLOYER_ID = "^[a-z0-9][a-z0-9-]{1,60}$"
HTTPS = r"^https://\S+$"
WEBSITE = r"""^https://[^\s"'<>]+$"""


def _units(text: Column, bounds: tuple[int, int]) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).between(*bounds)


def _whole(number: Column) -> Column:
    return F.when(number == F.floor(number), number.cast("long"))


def _lines(items: Column) -> Column:
    """The items that aren't blank; none for null."""
    return F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), hashes.trimmed), lambda x: x != "")


#: Fields whose blanks at the ends don't count.
TRIMMED = ("title", "company", "location", "slug", "url", "description")


def _read() -> Column:
    """What the rules read of a posting, each value worked out once."""
    c = F.col
    own = [c(name) for name in ("company_url", "salary_to", "expires_at", *CHOICES, *OPTIONAL_CHOICES)]
    ready = [_whole(c("salary_from")).alias("low"), _whole(c("salary_to")).alias("high"), _lines(c("requirements")).alias("lines"), dates.parse(c("expires_at")).alias("ends")]
    return F.struct(*own, *ready, *[hashes.trimmed(c(name)).alias(name) for name in TRIMMED])


def blockers(p: Column, now: Column) -> dict[str, Column]:
    """What a posting, read as p, must fulfil to be public, by the name of what it lacks; for rules.hold_reasons."""
    given = lambda name: F.coalesce(p[name], F.lit("")) != ""
    sized = lambda name: _units(p[name], LENGTHS[name])
    return {
        "title": sized("title"),
        "company": sized("company"),
        "location": sized("location"),
        "slug": p["slug"].rlike(publish.SLUG) & sized("slug"),
        "link": p["url"].rlike(HTTPS),
        "company website": ~given("company_url") | hashes.trimmed(p["company_url"]).rlike(HTTPS),
        "salary": p["low"].between(1, SALARY_MAX),
        "top salary": p["salary_to"].isNull() | p["high"].between(1, SALARY_MAX),
        "salary range": p["low"].isNull() | p["high"].isNull() | (p["high"] >= p["low"]),
        **{name.replace("_", " "): p[name].isin(list(values)) for name, values in CHOICES.items()},
        **{name.replace("_", " "): ~given(name) | p[name].isin(list(values)) for name, values in OPTIONAL_CHOICES.items()},
        "description": sized("description"),
        "requirements": F.size(p["lines"]) <= REQUIREMENTS,
        "requirement": F.forall(p["lines"], lambda x: _units(x, REQUIREMENT)),
        "expiry": ~given("expires_at") | p["ends"].isNotNull(),
        "expired": p["ends"].isNull() | (p["ends"] > now),
    }


def _lacking(now: Column, before: dict[str, Column]) -> Column:
    """All that a posting, read as _p, lacks, after what fails of the checks before."""
    return rules.hold_reasons(before | blockers(F.col("_p"), now))


def approved_hash(postings: DataFrame, into: str) -> DataFrame:
    """postings with the hash of what an approval vouches for; numbers that aren't whole and dates that are none count as missing."""
    own = postings.select(F.struct(*postings.columns).alias("_row"), *postings.columns)
    plain = own.withColumns({"salary_from": _whole(F.col("salary_from")), "salary_to": _whole(F.col("salary_to")), "expires_at": dates.parse(F.col("expires_at")), "requirements": _lines(F.col("requirements"))})
    return plain.select("_row", hashes.job_approval_hash().alias("_hash")).select("_row.*", F.col("_hash").alias(into))


def gated(postings: DataFrame, now: Column, approvers: Sequence[str]) -> DataFrame:
    """postings with `reasons`: why each is held. A wrong id or status is told alone, else all that its approval and its content lack; public ones have none."""
    hashed = held(approved_hash(postings, "_hash"), _read(), "_p")
    some = lambda name: F.nullif(F.col(name), F.lit(""))
    approval = publish.approval(some("approved_by"), some("approved_at"), approvers, F.col("content_hash"), F.col("_hash"))
    checks = _lacking(now, approval)
    status = F.coalesce(some("status"), F.lit("missing"))
    known = F.coalesce(F.col("id").rlike(POSTING_ID), F.lit(False))
    reasons = F.when(~known, F.array(F.lit("not a posting"))).when(status != "published", F.array(F.concat(F.lit("status is "), status))).otherwise(checks)
    return held(hashed.drop("reasons"), reasons, "reasons").drop("_hash", "_p")


def suggested_slug(title: Column, company: Column, posting_id: Column) -> Column:
    """Role and company in words of a-z and digits with dashes, cut at a dash, and four digits of the id's hash."""
    words = T.dashed(F.concat_ws(" ", hashes.trimmed(title), hashes.trimmed(company)))
    key = F.regexp_replace(hashes.trimmed(posting_id), r"^drafts\.", "")
    digits = F.left(hashes.fnv_texts(F.coalesce(F.nullif(key, F.lit("")), hashes.trimmed(title))), F.lit(4))
    return F.concat(F.coalesce(F.nullif(words, F.lit("")), F.lit("job")), F.lit("-"), digits)


#: Columns that only actions write, beside status, content_hash and the dates of a posting; filer is what an employer left of themselves.
WORKFLOW = ("approved_by", "approved_at", "published_by", "rejection_reason", "status_changed_at", "status_changed_by", "filer")


def acted(postings: DataFrame, now: Column, approvers: Sequence[str]) -> DataFrame:
    """postings, each after an action (columns action, user, reason), with ok and `reasons`, why it was refused; a refused one is as it was.

    Actions are those of lifecycle.JOB_ACTIONS, and save, which stamps a public posting's approval anew. To be published a posting must pass all blockers once it has
    the slug and the end (LIVE_DAYS from now) that it lacks. What leaves the site loses its approval, what is archived also its filer. No status counts as pending_review.
    """
    c = F.col
    action, status = F.coalesce("action", F.lit("")), F.coalesce(F.nullif(c("status"), F.lit("")), F.lit("pending_review"))
    iso = lambda at: F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    at, why = iso(now), hashes.trimmed(c("reason"))
    saves, live = action == "save", status == "published"
    refused = lifecycle.refusal(lifecycle.JOB_ACTIONS, action, status, c("user"), why, approvers, ("published",), "job")
    known = action.isin([a[0] for a in lifecycle.JOB_ACTIONS])
    puts, off = action == "approvePublish", action.isin("reject", "unpublish")
    gone = off | (action == "archive")
    to = lifecycle.led(lifecycle.JOB_ACTIONS, action, status)
    some = lambda name: F.nullif(c(name), F.lit(""))
    cleared = lambda name, when: F.when(~when, c(name))
    named = postings.select(F.struct(*postings.columns).alias("_own"), *postings.columns).withColumns({"_refused": refused, "_puts": puts, "_stamps": puts | (saves & live), "_moves": known})
    after = named.withColumns({
        "status": F.when(c("_moves"), to).otherwise(c("status")),
        "status_changed_at": F.when(c("_moves"), at).otherwise(c("status_changed_at")), "status_changed_by": F.when(c("_moves"), c("user")).otherwise(c("status_changed_by")),
        "slug": F.when(puts & ~hashes.trimmed(c("slug")).rlike(publish.SLUG), suggested_slug(c("title"), c("company"), c("id"))).otherwise(c("slug")),
        "expires_at": F.when(puts & some("expires_at").isNull(), iso(now + F.expr(f"interval {LIVE_DAYS} days"))).otherwise(c("expires_at")),
        "published_at": F.when(puts, at).otherwise(cleared("published_at", off)), "published_by": F.when(puts, c("user")).otherwise(cleared("published_by", off)),
        "first_published_at": F.when(puts, F.coalesce(some("first_published_at"), at)).otherwise(c("first_published_at")),
        "rejection_reason": F.when(action == "reject", why).otherwise(cleared("rejection_reason", puts)),
        "filer": cleared("filer", action == "archive"),
        **{name: cleared(name, gone) for name in ("approved_by", "approved_at", "content_hash")},
    })
    hashed = held(approved_hash(after, "_hash"), _read(), "_p")
    # `refused` reads what the posting was, `blockers` what it would be
    reasons = F.when(c("_refused").isNotNull(), F.array("_refused")).when(c("_stamps"), _lacking(now, {})).otherwise(F.array().cast("array<string>"))
    judged = held(hashed, reasons, "_reasons").withColumn("_ok", F.size("_reasons") == 0)
    stamps = {"approved_by": c("user"), "approved_at": at, "content_hash": c("_hash")}
    made = lambda name: F.when(c("_stamps"), stamps[name]).otherwise(c(name)) if name in stamps else c(name)
    return judged.select(*[F.when(c("_ok"), made(name)).otherwise(c("_own")[name]).alias(name) for name in postings.columns], c("_ok").alias("ok"), c("_reasons").alias("reasons"))


def profiles(employers: DataFrame) -> DataFrame:
    """Employers' documents (doc_id, id, name, logo_url, description, website) that have a name and an id of the right form, as pages show them."""
    name = hashes.trimmed(F.col("name"))
    fine = employers.filter(_units(name, EMPLOYER_NAME) & F.col("id").rlike(EMPLOYER_ID))
    text, site = hashes.trimmed(F.col("description")), hashes.trimmed(F.col("website"))
    shown = F.struct("id", name.alias("name"), "logo_url", F.nullif(F.left(text, F.lit(EMPLOYER_TEXT)), F.lit("")).alias("description"), F.when(site.rlike(WEBSITE), site).alias("website"))
    return fine.groupBy("doc_id").agg(F.max(shown).alias("_p")).select("doc_id", "_p.*")


def public_id(posting_id: Column) -> Column:
    return F.regexp_replace(posting_id, r"^jobs\.", "")


def listings(public: DataFrame, profiles: DataFrame) -> DataFrame:
    """Public postings as listings by hand, with the logo and website of their employer's profile; who filed them isn't among the columns."""
    c, text = F.col, (lambda name: hashes.trimmed(F.col(name)).alias(name))
    or_null = lambda name: F.nullif(c(name), F.lit(""))
    own = profiles.select(c("doc_id").alias("employer"), c("id").alias("employer_key"), c("logo_url").alias("_logo"), c("website").alias("_site"))
    day = lambda value: F.left(value, F.lit(10))
    return public.join(own, "employer", "left").select(
        public_id(c("id")).alias("id"), text("title"), text("company"), "employer_key", text("location"), text("url"), day(F.coalesce(or_null("first_published_at"), c("published_at"), F.lit(""))).alias("posted_at"),
        day(or_null("expires_at")).alias("expires_at"), text("slug"), F.coalesce(or_null("company_url"), "_site").alias("company_url"), *[or_null(n).alias(n) for n in ("department", "employment_type", "work_mode", "seniority", "regulator", "visa")],
        _whole(c("salary_from")).alias("salary_from"), _whole(c("salary_to")).alias("salary_to"), "salary_currency", "salary_period", text("description"), _lines(c("requirements")).alias("requirements"), F.nullif("_logo", F.lit("")).alias("logo_url"),
    )


def picked(picks: DataFrame, profiles: DataFrame, public: DataFrame) -> DataFrame:
    """page, list, rank, id: what editors picked (page, list: employers or jobs, at, ref), by public ids; refs to what isn't public or has no profile are passed over, ranks have no gaps.

    A list is one array of one page's document: so short that its ranks are counted in an array.
    """
    employers = profiles.select(F.lit("employers").alias("list"), F.col("doc_id").alias("ref"), "id")
    jobs = public.select(F.lit("jobs").alias("list"), F.col("id").alias("ref"), public_id(F.col("id")).alias("id")).distinct()
    found = picks.join(employers.unionByName(jobs), ["list", "ref"])
    lists = found.groupBy("page", "list").agg(F.sort_array(F.collect_list(F.struct("at", "id"))).alias("_ids"))
    return lists.select("page", "list", F.posexplode("_ids.id").alias("rank", "id")).withColumn("rank", F.col("rank") + 1)


def as_source(listings: DataFrame, source: str = "manual") -> tuple[DataFrame, DataFrame]:
    """Listings by hand as rows of a source, and the row of that source among those that were read: with no listing left it is read all the same, so that its jobs close.

    Rows have job_id, source_id, external_id (the listing's id), key and dates as timestamps, beside the listing's other columns.
    """
    c, day = F.col, (lambda name: dates.parse(F.col(name)))
    own = {"job_id": U.job_id(F.concat(F.lit(f"{source}:"), "id")), "source_id": F.lit(source), "key": T.job_key(c("title"), c("company"), c("location")), "posted_at": day("posted_at"), "expires_at": day("expires_at")}
    texts = {name: F.coalesce(name, F.lit("")) for name in ("department", "employment_type")}
    return listings.withColumns(own | texts).withColumnRenamed("id", "external_id"), listings.sparkSession.range(1).select(F.lit(source).alias("source_id"))
