"""Queries over what a site's pages and its interface need: request limits, page bodies, slots and lists in order of a locale; each with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import bodies, sites, slots
from tidewell.session import table
from tidewell.streaming import composite

HOUR = 3_600
#: The marks of words by their length, which repeat after 420 characters.
MARKS = [[mark for every, mark in ((3, "strong"), (4, "em"), (5, "good"), (7, "bad")) if n % every == 0] for n in range(420)]


def request_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a request of its user: two in six hours and four in a day are let pass, others are told how long to wait."""
    found = composite.limited(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", [(2, 6 * HOUR), (4, 24 * HOUR)])
    return found.select(F.col("id").alias("event_id"), F.col("key").alias("user_id"), "ok", "wait")


def page_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as bodies, a block a line and a span a word with marks by its length: the blocks that a page shows, one a row."""

    def span(word):
        n = F.length(word)
        return F.struct(F.when(n == 1, "break").otherwise("span").alias("_type"), F.concat(word, F.lit(" ")).alias("text"), F.get(marks, n % len(MARKS)).alias("marks"))

    def block(line, i):
        link = lambda key, href: F.struct(F.lit("link").alias("_type"), F.lit(key).alias("_key"), F.lit(href).alias("href"))
        defs = F.array(link("good", "https://example.com/a"), link("bad", "javascript:void"))
        style, item = F.when(i % 3 == 0, "h2").when(i % 3 == 1, "normal").otherwise("quote"), F.when(i % 5 == 3, "number").when(i % 5 == 4, "square")
        return F.struct(F.when(i % 9 == 8, "image").otherwise("block").alias("_type"), style.alias("style"), item.alias("listItem"), defs.alias("markDefs"), F.transform(F.split(line, " "), span).alias("children"))

    marks = F.array(*[F.array(*map(F.lit, m)).cast("array<string>") for m in MARKS])
    docs = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.transform(F.split("text", "\n"), block).alias("body"))
    shown = bodies.blocks(docs).select("doc_id", F.posexplode("blocks").alias("at", "b"))
    said = F.transform("b.spans", lambda s: F.concat_ws("|", s["text"], s["bold"].cast("int").cast("string"), s["italic"].cast("int").cast("string"), F.coalesce(s["href"], F.lit("-"))))
    return shown.select("doc_id", F.col("at").cast("long").alias("at"), F.col("b.type").alias("type"), F.col("b.list").alias("list"), F.size("b.spans").cast("long").alias("n_spans"), F.md5(F.array_join(said, "||")).alias("spans"))


def slot_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as items of a page's slots, a configuration for each brand, with faults of all kinds."""
    k, n = F.col("p_partkey"), F.col("p_size")
    slot = F.when(k % 4 == 0, "gold").when(k % 4 == 1, "sponsoredPosts").when(k % 4 == 2, "careerResources").otherwise(F.when(k % 8 == 3, "banners").otherwise("professionalServices"))
    fields = {
        "id": F.concat(F.when(k % 13 == 0, "No ").otherwise("p"), (k % 97).cast("string")), "enabled": F.when(n % 5 == 0, "false").otherwise("true"), "title": F.when(k % 7 > 0, F.repeat(F.col("p_name"), (n % 10).cast("int"))).otherwise(" "),
        "url": F.when(k % 3 == 0, "https://a.ae/").when(k % 3 == 1, "#").otherwise("http://a.ae/"),
    }
    extra = F.when(k % 5 == 0, F.create_map(F.lit("colorFrom"), F.when(k % 2 == 0, "#12abEF").otherwise("blue"))).when(k % 5 == 1, F.create_map(F.lit("headline"), F.col("p_type"))).when(k % 5 == 2, F.create_map(F.lit("resourceType"), F.lit("Guides"))).otherwise(F.create_map(F.lit("logoText"), F.col("p_type")))
    item = F.map_concat(F.create_map(*[x for f, c in fields.items() for x in (F.lit(f), c)]), extra)
    return slots.faults(table(spark, sf_dir, "part").select(F.col("p_brand").alias("config"), slot.alias("slot"), k.alias("at"), item.alias("item")))


def site_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages of two runs, some changed, some gone, some made by hand, some addresses twice: what becomes of each, with its hash."""
    k, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    path = F.concat(F.coalesce("lang", F.lit("xx")), F.lit("/"), k.cast("string"))
    docs = table(spark, sf_dir, "documents")
    held = docs.filter(k % 5 > 0).select(path.alias("path"), F.sha2(F.encode(F.when(k % 7 == 0, F.concat(text, F.lit("."))).otherwise(text), "UTF-8"), 256).alias("sha256"), (k % 11 > 0).alias("generated"))
    twice = docs.filter(k % 4 == 1).select(path.alias("path"), F.lit("later").alias("body"), F.lit(2).alias("rank"))
    pages = docs.filter(k % 3 > 0).select(path.alias("path"), F.col("text").alias("body"), F.lit(1).alias("rank")).unionByName(twice)
    return sites.changes(held, pages).select("path", "action", "sha256")


QUERIES = {f.__name__: f for f in (request_limits, page_bodies, slot_faults, site_changes)}

_A, _B = 6 * HOUR * 1_000_000, 24 * HOUR * 1_000_000
ORACLES = {
    "request_limits": f"""
with recursive e as (select event_id, user_id, epoch_us(ts) as t, row_number() over (partition by user_id order by ts, event_id) as n from events),
r as (
  select event_id, user_id, t, n, cast({2 * _A} as bigint) as a, cast({4 * _B} as bigint) as b from e where n = 1
  union all
  select e.event_id, e.user_id, e.t, e.n, least({2 * _A}, r.a - if(r.a >= {_A}, {_A}, 0) + (e.t - r.t) * 2), least({4 * _B}, r.b - if(r.a >= {_A} and r.b >= {_B}, {_B}, 0) + (e.t - r.t) * 4)
  from r join e on e.user_id = r.user_id and e.n = r.n + 1)
select event_id, user_id, a >= {_A} and b >= {_B} as ok,
  cast(case when a < {_A} then greatest(1, ceil(({_A} - a) / 2e6)) when b < {_B} then greatest(1, ceil(({_B} - b) / 4e6)) else 0 end as bigint) as wait from r""",
    "page_bodies": """
with l as (select doc_id, string_split(text, chr(10)) as ls from documents where text is not null),
b as (select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) - 1 as i from l),
w as (select doc_id, i, string_split(line, ' ') as ws from b where i % 9 <> 8),
c as (select doc_id, i, unnest(ws) as word, generate_subscripts(ws, 1) as k from w),
s as (select doc_id, i, k, length(word) % 3 = 0 as bold, length(word) % 4 = 0 as italic, if(length(word) % 5 = 0, 'https://example.com/a', '-') as href,
  regexp_replace(regexp_replace(nfc_normalize(word || ' '), '[\\x{0}-\\x{8}\\x{b}\\x{c}\\x{e}-\\x{1f}\\x{7f}-\\x{9f}\\x{200b}-\\x{200f}\\x{2028}-\\x{202e}\\x{2060}-\\x{2064}\\x{2066}-\\x{2069}\\x{feff}]', '', 'g'), '[\\s\\x{a0}]+', ' ', 'g') as t
  from c where length(word) <> 1),
n as (select *, coalesce((bold, italic, href) <> lag((bold, italic, href)) over (partition by doc_id, i order by k), true) as fresh from s),
g as (select *, sum(fresh::int) over (partition by doc_id, i order by k) as run from n),
r as (select doc_id, i, run, string_agg(t, '' order by k) as t, any_value(bold) as bold, any_value(italic) as italic, any_value(href) as href from g group by doc_id, i, run),
e as (select *, run = 1 as first, run = max(run) over (partition by doc_id, i) as last from r),
x as (select * replace (case when first and last then trim(t) when first then ltrim(t) when last then rtrim(t) else t end as t) from e),
p as (select doc_id, i, count(*) as n_spans, md5(string_agg(t || '|' || bold::int || '|' || italic::int || '|' || href, '||' order by run)) as spans from x where t <> '' group by doc_id, i)
select doc_id, row_number() over (partition by doc_id order by i) - 1 as at, case when i % 5 in (3, 4) then 'li' when i % 3 = 0 then 'h2' else 'p' end as type,
  case i % 5 when 3 then 'number' when 4 then 'bullet' end as list, n_spans, spans from p""",
    "slot_faults": """
with i as (select p_brand as config, p_partkey as k, p_size as n, case p_partkey % 4 when 0 then 'gold' when 1 then 'sponsoredPosts' when 2 then 'careerResources' else if(p_partkey % 8 = 3, 'banners', 'professionalServices') end as slot,
  if(p_partkey % 13 = 0, 'No ', 'p') || (p_partkey % 97) as id, p_size % 5 > 0 as enabled, if(p_partkey % 7 > 0, trim(repeat(p_name, p_size % 10)), '') as title, p_type from part),
o as (select *, row_number() over (partition by config, slot, id order by k) as nth from i where slot <> 'banners'),
f as (
  select config, slot, k, 'id' as path, 'malformed' as fault from o where id like 'No %'
  union all select config, slot, k, 'id', 'taken' from o where nth > 1
  union all select config, slot, k, 'title', 'missing' from o where enabled and title = ''
  union all select config, slot, k, 'title', 'too long' from o where enabled and length(title) > if(slot = 'sponsoredPosts', 90, 70)
  union all select config, slot, k, 'url', 'no safe link' from o where enabled and k % 3 = 2
  union all select config, slot, k, 'colorFrom', 'no colour' from o where enabled and k % 5 = 0 and k % 2 = 1
  union all select config, slot, k, 'headline', 'now called title' from o where k % 5 = 1
  union all select config, slot, k, 'resourceType', if(slot = 'careerResources', 'unknown kind', 'not used here') from o where k % 5 = 2 and (enabled or slot <> 'careerResources')
  union all select config, slot, k, 'logoText', 'not used here' from o where k % 5 > 2 and slot = 'gold'
  union all select config, slot, k, 'logoText', 'too long' from o where enabled and k % 5 > 2 and length(p_type) > case slot when 'careerResources' then 5 when 'gold' then null else 4 end)
select config, slot, '[' || k || '].' || path as path, fault from f
union all select distinct config, slot, '', 'now called gold' from i where slot = 'banners'
union all select config, slot, '', count(*) || ' items, room for ' || any_value(m) from (select *, case slot when 'gold' then 10 when 'careerResources' then 12 else 20 end as m from o where enabled) x group by config, slot having count(*) > any_value(m)""",
    "site_changes": """
with d as (select doc_id as k, coalesce(lang, 'xx') || '/' || doc_id as path, coalesce(text, '') as t from documents),
h as (select path, sha256(if(k % 7 = 0, t || '.', t)) as old, k % 11 > 0 as own from d where k % 5 > 0),
p as (select path, sha256(if(k % 3 > 0, t, 'later')) as new from d where k % 3 > 0 or k % 4 = 1)
select coalesce(h.path, p.path) as path, case when new is null then if(own, 'remove', 'leave') when new = old then 'keep' else 'write' end as action, coalesce(new, old) as sha256
from h full join p on h.path = p.path""",
}
