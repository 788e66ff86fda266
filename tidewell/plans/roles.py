"""Queries over jobs, employers and the intake of items, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import text as T
from tidewell.functions import url as U
from tidewell.operators import intake, jobs, lifecycle, views
from tidewell.session import table

RUN = "1998-05-06 00:00:00"


def _run():
    return F.lit(RUN).cast("timestamp_ntz")


def _job_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as jobs of four sources."""
    orders = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "F", "closed").otherwise("expired")
    return orders.select(
        F.col("o_orderkey").alias("job_id"), F.concat(F.lit("src"), (F.col("o_custkey") % 4).cast("string")).alias("source_id"), status.alias("status"), F.col("o_orderdate").alias("posted_at"),
        F.when(F.col("o_orderkey") % 7 == 0, F.col("o_orderdate") + F.expr("interval 400 days")).alias("expires_at"), F.when(status != "open", F.col("o_orderdate") + F.expr("interval 20 days")).alias("closed_at"),
        (F.col("o_orderkey") % 1200).alias("key"), F.col("o_orderpriority").alias("description"),
    )


def job_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs after a run that read three of four sources."""
    rows = _job_rows(spark, sf_dir)
    seen = rows.filter("job_id % 2 = 0 and source_id <> 'src3'").drop("status", "closed_at")
    after = jobs.lifecycle(rows.filter("job_id % 3 <> 0"), seen, _run(), max_age_days=500, forget_days=600)
    return after.groupBy("status", "source_id").agg(F.count("*").alias("n"), F.sum("job_id").alias("ids"), F.count("description").alias("n_texts"), F.max("closed_at").alias("last_closed"))


def job_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs after a run that read three of four boards, of which one has nothing left, and a list kept by hand; listings come in another order than their ids'."""
    by_hand = F.when(F.col("job_id") % 9 == 0, "manual").otherwise(F.col("source_id"))
    rows = _job_rows(spark, sf_dir).withColumns({"source_id": by_hand, "ord": -F.col("job_id")})
    seen = rows.filter("job_id % 2 = 0 and source_id not in ('src2', 'src3')").drop("status", "closed_at").withColumn("posted_at", F.col("posted_at") + F.expr("interval 30 days"))
    read = spark.createDataFrame([("src0",), ("src1",), ("src2",), ("manual",)], "source_id string")
    after = jobs.lifecycle(rows.filter("job_id % 5 < 3").drop("ord"), seen, _run(), max_age_days=500, forget_days=600, read=read)
    return after.groupBy("status", "source_id").agg(F.count("*").alias("n"), F.sum("job_id").alias("ids"), F.min("posted_at").alias("oldest"), F.max("closed_at").alias("last_closed"))


PLACES_OF = ("DIFC, Dubai", "ADGM", "Remote - UAE", "London", "Sharjah", "Abu Dhabi", "")
KINDS_OF = ("Full Time", "full_time", "Contractor", "intern", "seasonal", "")


def _listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts, key = table(spark, sf_dir, "part"), F.col("p_partkey")
    pick = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))
    day = F.lit("1998-05-06").cast("timestamp_ntz") - F.make_dt_interval((key % 90).cast("int"))
    return parts.select(
        "p_partkey", F.when(key % 17 != 0, F.col("p_name")).alias("title"), F.col("p_brand").alias("company"), pick(PLACES_OF, key).alias("location"), pick(KINDS_OF, key).alias("kind"), F.col("p_type").alias("department"),
        F.when(key % 13 == 0, "ftp://x").otherwise(F.concat(F.lit("https://jobs.com/"), key.cast("string"))).alias("url"), day.alias("posted_at"), F.when(key % 5 == 0, day + F.expr("interval 60 days")).alias("expires_at"), (key % 6 == 0).alias("manual"),
    )


def job_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _listings(spark, sf_dir)
    uae, finance = jobs.in_uae(F.col("location"), ("dubai", "adgm", "sharjah"), ("remote - uae",)), jobs.is_finance(F.col("title"), F.col("department"), ("economy", "ring", "promo", "widget"))
    reason = jobs.reject_reason({c: F.col(c) for c in ("title", "company", "url", "posted_at", "expires_at")}, _run(), uae, finance, F.col("manual"))
    return found.select("p_partkey", F.coalesce(reason, F.lit("accepted")).alias("reason"))


def job_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids, kind of employment, emirate and pay of listings."""
    low = F.when(F.col("p_partkey") % 4 != 0, (F.col("p_partkey") * 37 + 900).cast("long"))
    high = F.when(F.col("p_partkey") % 3 == 0, low + F.when(F.col("p_partkey") % 2 == 0, 0).otherwise(1500))
    pay = T.salary(low, high, F.lit("AED"), F.when(F.col("p_partkey") % 5 == 0, "month"))
    return _listings(spark, sf_dir).select("p_partkey", U.job_id(F.col("url")).alias("job_id"), U.employer_id(F.col("company")).alias("employer_id"), U.story_id(F.col("url")).alias("story_id"), T.employment_type(F.col("kind")).alias("kind"), T.city(F.col("location")).alias("city"),
                                           F.md5(T.job_key(F.col("title"), F.col("company"), F.col("location"))).alias("job_key"), pay.alias("pay"))


def employers_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as employers with open jobs, with profiles of suppliers by a job's link or by name, and hand-picked ones without jobs."""
    open_ = table(spark, sf_dir, "part").select((F.col("p_partkey") % 40).alias("k"), F.col("p_brand").alias("company"), (F.col("p_size") == 50).alias("featured"), F.col("p_partkey").alias("ord"), U.employer_id(F.col("p_brand")).alias("employer_id"))
    profiles = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.concat(F.lit("brand "), F.col("s_suppkey").cast("string")).alias("name"), F.concat(F.when(F.col("s_suppkey") % 2 == 0, "https").otherwise("http"), F.lit("://s.com/"), F.col("s_suppkey").cast("string")).alias("website"))
    linked = open_.filter("k < 3").select(F.col("employer_id").alias("id"), F.col("k").alias("key"))
    top = profiles.filter("key < 4").select(U.employer_id(F.concat(F.lit("x"), F.col("name"))).alias("id"), F.concat(F.lit("x"), F.col("name")).alias("name"))
    return jobs.enriched(jobs.with_top(jobs.employers(open_, 20), top), profiles, linked).select("id", "name", "initials", "open_jobs", "featured", "profile", "website")


def top_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Editors' picks among open jobs in their order."""
    open_ = _job_rows(spark, sf_dir).filter("status = 'open'").select("job_id", "posted_at")
    return jobs.picked(open_, "job_id", [77, 5, 900, 31, 12, 4, 8, 15, 16, 23, 42], [F.desc("posted_at"), F.col("job_id")], 20).select("job_id", F.col("rank").cast("long").alias("rank"))


def jobs_automatic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without picks: featured jobs, then the newest, 20 of them."""
    open_ = _job_rows(spark, sf_dir).filter("status = 'open'").select("job_id", "posted_at", (F.col("job_id") % 97 == 0).alias("featured"))
    return jobs.picked(open_, "job_id", [-1], [F.desc("featured"), F.desc("posted_at"), F.col("job_id")], 20).select("job_id", F.col("rank").cast("long").alias("rank"))


def job_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest listing of a page name has the page, others none."""
    named = _listings(spark, sf_dir).filter("title is not null").select("p_partkey", F.replace(T.normalise_title(F.col("title")), F.lit(" "), F.lit("-")).alias("slug"), "posted_at")
    first = views.top_n(named, "slug", [F.desc("posted_at"), F.col("p_partkey")], 1)
    return first.select("slug", "p_partkey")


def job_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as an action of the review of a job."""
    status = F.element_at(F.array(*map(F.lit, ("pending_review", "published", "rejected", "archived"))), (F.col("event_id") % 4 + 1).cast("int"))
    action = F.element_at(F.array(*[F.lit(a[0]) for a in lifecycle.JOB_ACTIONS]), (F.col("user_id") % 4 + 1).cast("int"))
    to = lifecycle.next_status(lifecycle.JOB_ACTIONS, status, action, F.col("event_type") == "click", F.when(F.col("value") > 10, F.lit("because")), F.col("value") < 80)
    return table(spark, sf_dir, "events").groupBy(status.alias("status"), action.alias("action"), F.coalesce(to, F.lit("refused")).alias("next_status")).agg(F.count("*").alias("n"))


def known_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as items of feeds, against a queue of sign-ups: known by address, guid or a title within a week."""
    item = table(spark, sf_dir, "events").select(
        "event_id", F.concat(F.lit("a_"), (F.col("event_id") % 997).cast("string")).alias("article_id"), "event_type", (F.col("user_id") % 3).alias("source_id"), F.concat(F.lit("g"), (F.col("event_id") % 701).cast("string")).alias("guid"),
        F.concat_ws(" ", F.lit("Title!"), F.substring("props", 1, 8), (F.col("user_id") % 50).cast("string")).alias("title"), F.col("ts").alias("published_at"),
    )
    found = intake.known(item.filter("event_type <> 'signup'"), item.filter("event_type = 'signup'"))
    return found.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if("duplicate").alias("n_known"), F.sum(F.when(F.col("duplicate"), F.col("event_id"))).alias("ids"))


def seen_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as stories, last seen at their last event of an early time; later events show them again, some with an excerpt."""
    events = table(spark, sf_dir, "events")
    early = events.filter("ts < '2024-01-15'").groupBy(F.col("user_id").alias("id")).agg(F.max("ts").alias("last_seen_at"), F.max(F.when(F.col("event_type") == "error", F.lit("old"))).alias("excerpt"))
    stories = early.withColumns({"status": F.when(F.col("id") % 2 == 0, "pending_review").otherwise("approved"), "image": F.lit(None).cast("string")})
    later = events.filter("ts >= '2024-01-15'").select(F.col("user_id").alias("id"), F.when(F.col("event_type") == "click", F.lit("new")).alias("excerpt"), F.when(F.col("value") > 150, F.lit("https://i/1")).alias("image"))
    changed = intake.touched(stories, later, F.lit("2024-01-19 06:00:00").cast("timestamp_ntz"))
    return changed.groupBy(F.col("last_seen_at").isNotNull().alias("seen"), "excerpt", "image").agg(F.count("*").alias("n"), F.min("id").alias("first"))


def queue_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = table(spark, sf_dir, "events").select("event_id", (F.col("value") / 50).cast("int").alias("priority"))
    return intake.within_budget(new, 9400, 9500, "priority", "event_id")


def story_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source_id"), (F.col("s_acctbal") > 0).alias("cleared"), (F.col("s_nationkey") % 3).alias("priority"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("story"), F.col("l_suppkey").alias("source_id"), F.col("l_shipdate").alias("published_at"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("article_id"), (F.col("l_returnflag") == "R").alias("uae"))
    return intake.leads(lines.join(supplier, "source_id", "left"))


def feed_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events as feeds with dates in the past, the future, or none."""
    at = F.when(F.col("event_type") == "signup", F.col("ts") + F.expr("interval 60 days")).when(F.col("event_type") != "view", F.col("ts"))
    return intake.feed_audit(table(spark, sf_dir, "events").select(F.col("user_id").alias("source_id"), at.alias("published_at")), F.lit("2024-02-12 00:00:00").cast("timestamp_ntz"))


QUERIES = {
    f.__name__: f
    for f in (job_lifecycle, job_run, job_filters, job_fields, employers_enriched, top_jobs, jobs_automatic, job_pages, job_steps, known_items, seen_again, queue_budget, story_leads, feed_health)
}
_JOBS = """j as (select o_orderkey as job_id, 'src' || (o_custkey % 4) as source_id, case o_orderstatus when 'O' then 'open' when 'F' then 'closed' else 'expired' end as status, o_orderdate as posted_at,
  case when o_orderkey % 7 = 0 then o_orderdate + interval 400 days end as expires_at, case when o_orderstatus <> 'O' then o_orderdate + interval 20 days end as closed_at, o_orderkey % 1200 as key, o_orderpriority as description from orders)"""
_LIST = f"""l as (select p_partkey, case when p_partkey % 17 <> 0 then p_name end as title, p_brand as company, {list(PLACES_OF)}[p_partkey % {len(PLACES_OF)} + 1] as location, {list(KINDS_OF)}[p_partkey % {len(KINDS_OF)} + 1] as kind, p_type as department,
  if(p_partkey % 13 = 0, 'ftp://x', 'https://jobs.com/' || p_partkey) as url, timestamp '1998-05-06' - to_days(cast(p_partkey % 90 as int)) as posted_at, case when p_partkey % 5 = 0 then timestamp '1998-05-06' - to_days(cast(p_partkey % 90 as int)) + interval 60 days end as expires_at, p_partkey % 6 = 0 as manual from part)"""
_EMP = "'emp_' || left(sha256(trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))), 16)"
_PLAIN = "trim(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9]+', ' ', 'g'))"
ORACLES = {
    "job_lifecycle": f"""with {_JOBS}, k as (select * from j where job_id % 3 <> 0), s as (select * from j where job_id % 2 = 0 and source_id <> 'src3'), o as (select key, min(job_id) as other from k where status = 'open' group by key),
n as (select key, min(job_id) as own from s where job_id not in (select job_id from k) group by key),
f as (select s.* from s left join o using (key) left join n using (key) where if(other is null, coalesce(job_id <= own, true), other = job_id)), r as (select distinct source_id from s),
m as (select coalesce(k.job_id, f.job_id) as job_id, coalesce(k.source_id, f.source_id) as source_id, coalesce(k.posted_at, f.posted_at) as posted_at, if(f.job_id is not null, f.expires_at, k.expires_at) as expires_at, if(f.job_id is not null, f.description, k.description) as description,
  case when f.job_id is not null then 'open' when k.status = 'open' and k.source_id in (select source_id from r) and k.job_id not in (select job_id from s) then 'closed' else k.status end as status,
  case when f.job_id is not null then null when k.status = 'open' and k.source_id in (select source_id from r) and k.job_id not in (select job_id from s) then timestamp '{RUN}' else k.closed_at end as closed_at from k full join f on k.job_id = f.job_id),
e as (select *, status = 'open' and (posted_at < timestamp '{RUN}' - interval 500 days or coalesce(expires_at < timestamp '{RUN}', false)) as ended from m),
x as (select job_id, source_id, if(ended, 'expired', status) as status, if(ended, timestamp '{RUN}', closed_at) as closed_at, if(ended or status <> 'open', null, description) as description from e)
select status, source_id, count(*) as n, cast(sum(job_id) as bigint) as ids, count(description) as n_texts, max(closed_at) as last_closed from x where status = 'open' or not coalesce(closed_at < timestamp '{RUN}' - interval 600 days, false) group by all""",
    "job_run": f"""with {_JOBS}, h as (select * replace (if(job_id % 9 = 0, 'manual', source_id) as source_id) from j), k as (select * from h where job_id % 5 < 3),
s as (select * replace (posted_at + interval 30 days as posted_at) from h where job_id % 2 = 0 and source_id not in ('src2', 'src3')), o as (select key, min(job_id) as other from k where status = 'open' group by key),
n as (select key, max(job_id) as own from s where job_id not in (select job_id from k) group by key),
f as (select s.* from s left join o using (key) left join n using (key) where if(other is null, coalesce(job_id >= own, true), other = job_id)),
m as (select coalesce(k.job_id, f.job_id) as job_id, coalesce(k.source_id, f.source_id) as source_id, if(f.job_id is not null and f.source_id = 'manual', f.posted_at, coalesce(k.posted_at, f.posted_at)) as posted_at, if(f.job_id is not null, f.expires_at, k.expires_at) as expires_at,
  f.job_id is null and k.status = 'open' and k.source_id <> 'src3' and k.job_id not in (select job_id from s) as gone, f.job_id is not null as here, k.status as was, k.closed_at as was_closed from k full join f on k.job_id = f.job_id),
g as (select job_id, source_id, posted_at, expires_at, if(here, 'open', if(gone, 'closed', was)) as status, if(here, null, if(gone, timestamp '{RUN}', was_closed)) as closed_at from m),
e as (select *, status = 'open' and ((posted_at < timestamp '{RUN}' - interval 500 days and not (source_id = 'manual' and expires_at is not null)) or coalesce(expires_at < timestamp '{RUN}', false)) as ended from g),
x as (select job_id, source_id, posted_at, if(ended, 'expired', status) as status, if(ended, timestamp '{RUN}', closed_at) as closed_at from e)
select status, source_id, count(*) as n, cast(sum(job_id) as bigint) as ids, min(posted_at) as oldest, max(closed_at) as last_closed from x where status = 'open' or not coalesce(closed_at < timestamp '{RUN}' - interval 600 days, false) group by all""",
    "job_filters": f"""with {_LIST} select p_partkey, case when coalesce(title, '') = '' or company = '' then 'missing-fields' when url = 'ftp://x' then 'invalid-link' when expires_at < timestamp '{RUN}' then 'expired'
  when not (manual and expires_at is not null) and posted_at < timestamp '{RUN}' - interval 45 days then 'too-old' when not manual and not (regexp_matches(lower(location), '(^|[^a-z0-9])(dubai|adgm|sharjah)(s|es)?($|[^a-z0-9])') or contains(lower(location), 'remote - uae')) then 'not-uae'
  when not manual and not regexp_matches(lower(concat_ws(' ', title, department)), '(^|[^a-z0-9])(economy|ring|promo|widget)(s|es)?($|[^a-z0-9])') then 'not-finance' else 'accepted' end as reason from l""",
    "job_fields": f"""with {_LIST}, p as (select *, case when p_partkey % 4 <> 0 then p_partkey * 37 + 900 end as low from l), q as (select *, case when p_partkey % 3 = 0 then low + if(p_partkey % 2 = 0, 0, 1500) end as high from p)
select p_partkey, 'j_' || left(sha256(url), 16) as job_id, {_EMP.format('company')} as employer_id, 's_' || left(sha256(url), 14) as story_id, case kind when 'Full Time' then 'Full-time' when 'full_time' then 'Full-time' when 'Contractor' then 'Contract' when 'intern' then 'Internship' end as kind,
  case when regexp_matches(lower(location), 'abu dhabi|adgm') then 'Abu Dhabi' when regexp_matches(lower(location), 'dubai|difc') then 'Dubai' when location = 'Sharjah' then 'Sharjah' when contains(lower(location), 'remote') then 'Remote' else '' end as city,
  md5({_PLAIN.format('title')} || '|' || {_PLAIN.format('company')} || '|' || {_PLAIN.format('location')}) as job_key,
  case when low is null then '' else 'AED ' || format('{{:,}}', low) || if(high is not null and high <> low, '–' || format('{{:,}}', high), '') || if(p_partkey % 5 = 0, ' / month', '') end as pay from q""",
    "employers_enriched": f"""with o as (select p_partkey % 40 as k, p_brand as company, p_size = 50 as featured, p_partkey as ord, {_EMP.format('p_brand')} as id from part),
p as (select s_suppkey as key, 'brand ' || s_suppkey as name, if(s_suppkey % 2 = 0, 'https', 'http') || '://s.com/' || s_suppkey as website from supplier),
e as (select id, arg_min(company, ord) as name, count(*) as open_jobs, bool_or(featured) as featured from o group by id order by featured desc, open_jobs desc, lower(name), name limit 20),
a as (select * from e union all select {_EMP.format("('x' || name)")}, 'x' || name, 0, false from p where key < 4 and {_EMP.format("('x' || name)")} not in (select id from e)),
bk as (select o.id, min(key) as key from o join p on p.key = o.k where o.k < 3 group by o.id), bn as (select {_EMP.format('name')} as id, min(key) as key from p group by 1),
w as (select a.*, coalesce(bk.key, bn.key) as profile, list_filter(regexp_split_to_array(a.name, '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') as ws from a left join bk using (id) left join bn using (id))
select id, w.name, upper(if(len(ws) = 1, left(ws[1], 2), left(ws[1], 1) || left(ws[2], 1))) as initials, open_jobs, featured, profile, case when website like 'https://%' then website end as website from w left join p on p.key = profile""",
    "top_jobs": f"with {_JOBS}, i as (select unnest([77, 5, 900, 31, 12, 4, 8, 15, 16, 23, 42]) as job_id, unnest(range(1, 12)) as nth) select job_id, row_number() over (order by nth) as rank from i join j using (job_id) where status = 'open'",
    "jobs_automatic": f"with {_JOBS} select job_id, row_number() over (order by job_id % 97 = 0 desc, posted_at desc, job_id) as rank from j where status = 'open' order by rank limit 20",
    "job_pages": f"with {_LIST}, s as (select p_partkey, replace({_PLAIN.format('title')}, ' ', '-') as slug, posted_at from l where title is not null) select slug, arg_min(p_partkey, (-epoch(posted_at), p_partkey)) as p_partkey from s group by slug",
    "job_steps": """with e as (select ['pending_review','published','rejected','archived'][event_id % 4 + 1] as status, ['approvePublish','reject','unpublish','archive'][user_id % 4 + 1] as action, event_type = 'click' as approver, value > 10 as reason, value < 80 as checked from events)
select status, action, coalesce(case when action = 'approvePublish' and status <> 'published' and approver and checked then 'published' when action = 'reject' and status in ('pending_review', 'published') and reason then 'rejected'
  when action = 'unpublish' and status = 'published' then 'pending_review' when action = 'archive' and status <> 'archived' then 'archived' end, 'refused') as next_status, count(*) as n from e group by all""",
    "known_items": """with i as (select event_id, event_id % 997 as a, event_type, user_id % 3 as s, event_id % 701 as g, substr(props, 1, 8) || ' ' || (user_id % 50) as t, ts from events), q as (select * from i where event_type = 'signup'),
f as (select i.*, exists (select 1 from q where q.a = i.a) or exists (select 1 from q where q.s = i.s and q.g = i.g) or exists (select 1 from q where q.s = i.s and q.t = i.t and abs(epoch_ms(q.ts) - epoch_ms(i.ts)) < 604800000) as d from i where event_type <> 'signup')
select event_type, count(*) as n, count(*) filter (where d) as n_known, cast(sum(event_id) filter (where d) as bigint) as ids from f group by 1""",
    "seen_again": """with e as (select user_id as id, max(ts) as seen, max(case when event_type = 'error' then 'old' end) as excerpt from events where ts < timestamp '2024-01-15' group by 1),
l as (select user_id as id, max(case when event_type = 'click' then 'new' end) as excerpt, max(case when value > 150 then 'https://i/1' end) as image from events where ts >= timestamp '2024-01-15' group by 1),
c as (select id, e.seen <= timestamp '2024-01-19 06:00:00' - interval 12 hours as seen, case when id % 2 = 0 and e.excerpt is null then l.excerpt end as excerpt, case when id % 2 = 0 then l.image end as image from e join l using (id))
select seen, excerpt, image, count(*) as n, min(id) as first from c where seen or excerpt is not null or image is not null group by all""",
    "queue_budget": "select event_id, cast(trunc(value / 50) as int) as priority from events order by priority desc, event_id limit 100",
    "story_leads": """with r as (select l_orderkey as story, l_suppkey, l_shipdate, l_partkey * 10 + l_linenumber as article, l_returnflag = 'R' as uae, not coalesce(s_acctbal > 0, false) as held, coalesce(s_nationkey % 3, 9) as p from lineitem left join supplier on s_suppkey = l_suppkey)
select story, arg_min(article, (held, p, l_shipdate, article)) as lead, bool_or(uae) as uae, min(l_shipdate) as first_at, max(l_shipdate) as last_at, count(distinct l_suppkey) as n_sources from r group by story""",
    "feed_health": """with e as (select user_id as source_id, case when event_type = 'signup' then ts + interval 60 days when event_type <> 'view' then ts end as seen from events), f as (select source_id, count(seen) as n, max(seen) filter (where seen <= timestamp '2024-02-13') as newest from e group by 1),
g as (select *, cast(floor((epoch(timestamp '2024-02-12') - floor(epoch(newest))) / 86400) as bigint) as age_days from f) select *, case when n = 0 then 'empty' when newest is null then 'undated' when age_days > 14 then 'stale' else 'ok' end as verdict from g""",
}
