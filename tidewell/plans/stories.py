"""Queries over stories, their classification, gates, views and forms, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import dates as D
from tidewell.functions import text as T
from tidewell.operators import classify, forms, matching, publish, rules, views
from tidewell.plans import urls_and_text
from tidewell.plans.content import GROUPS, _doc_parts
from tidewell.session import table

ARTICLES = classify.ArticleRules(topics=GROUPS, generic={"with": 1, "pour": 1}, negative={"not": -2, "nicht": -2}, uae=("les", "der", "was", "para"), uae_threshold=3)
KINDS = classify.Taxonomy(
    capital={"funds": {"the": 2, "des": 2}, "banks": {"und": 2, "los": 2}, "debt": {"of": 1, "que": 1}},
    asset={"office": {"and": 2, "die": 2, "the": 2}, "retail": {"une": 2, "las": 2}, "land": {"was": 2, "nicht": 2}},
    geography={"global": {"that": 2, "les": 2, "der": 2}, "europe": {"pour": 3, "und": 3}, "asia": {"para": 3}},
    transaction={"sale": {"this": 2, "est": 3}, "lease": {"with": 3, "mit": 3}},
)


def headline_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = T.first_line(F.col("text"))
    docs = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.array_sort(T.entities(line)).alias("e"))
    return docs.select("doc_id", F.array_join("e", " ").alias("entities"), F.size(F.filter("e", lambda t: ~T.is_amount(t))).cast("long").alias("n_names"))


def headline_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's headline against those of the next three."""
    line = T.first_line(F.col("text"))
    docs = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", T.tokens(line).alias("t"), T.entities(line).alias("e"))
    near = docs.select(F.col("doc_id").alias("a"), F.col("t").alias("at"), F.col("e").alias("ae"), F.explode(F.array(*[F.col("doc_id") + i for i in (1, 2, 3)])).alias("b"))
    both = near.join(docs.select(F.col("doc_id").alias("b"), F.col("t").alias("bt"), F.col("e").alias("be")), "b")
    match, score = matching.similarity((F.col("at"), F.col("ae")), (F.col("bt"), F.col("be")))
    return both.select("a", "b", match.alias("same"), score.alias("score")).filter("score > 0")


def classify_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as articles of sources, of which one in four is of the region."""
    docs = _doc_parts(spark, sf_dir).withColumn("region", F.when(F.col("doc_id") % 4 == 0, "uae").otherwise("global"))
    found = classify.classify_articles(docs, ARTICLES, F.col("title"), F.col("body"), F.col("region"))
    return found.select("doc_id", "category", F.col("uae_score").cast("long").alias("uae_score"), "topic", F.array_join("topics", ",").alias("topics"), F.col("relevance").cast("long").alias("relevance"),
                        classify.relevant(F.col("relevance"), F.when(F.col("doc_id") % 3 == 0, "private-markets").otherwise("other")).alias("relevant"), F.array_join("hits", ",").alias("hits"))


def classify_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classify.classify_taxonomy(_doc_parts(spark, sf_dir), KINDS, F.col("title"), F.col("body"), F.col("doc_id") % 5 == 0)
    listed = {c: F.array_join(c, ",").alias(c) for c in ("capital_types", "asset_classes", "geography")}
    return found.select("doc_id", *listed.values(), "transaction_type", "confidence", "needs_review", "explanation", F.col("priority").cast("long").alias("priority"))


OUTLETS = "array<struct<source:string,source_id:bigint,url:string,published_at:timestamp_ntz,attached_at:timestamp_ntz,cleared:boolean>>"


def _story_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as stories: their lines are the outlets, suppliers the sources, those in credit being cleared."""
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source_id"), (F.col("s_acctbal") > 0).alias("cleared"))
    lines = table(spark, sf_dir, "lineitem").withColumn("source_id", F.col("l_suppkey")).join(suppliers, "source_id", "left")
    outlet = F.struct(F.concat(F.lit("Supplier "), "source_id").alias("source"), "source_id", F.concat(F.lit("https://s/"), "l_partkey").alias("url"), F.col("l_shipdate").alias("published_at"),
                      (F.col("l_shipdate") + F.expr("interval 1 day")).alias("attached_at"), F.coalesce("cleared", F.lit(False)).alias("cleared"))
    # the lines of one order: a handful
    others = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(outlet).alias("others"))
    orders = table(spark, sf_dir, "orders").join(others, "o_orderkey", "left")
    place = F.when(F.col("o_custkey") % 5 == 0, F.array(F.lit("uae"), F.lit("global"))).when(F.col("o_custkey") % 5 == 1, F.array(F.lit("global"))).otherwise(F.array().cast("array<string>"))
    return orders.select(
        F.col("o_orderkey").alias("story_id"), F.concat(F.lit(" Order "), F.col("o_orderkey").cast("string")).alias("headline"), F.nullif(F.col("o_orderpriority"), F.lit("4-NOT SPECIFIED")).alias("summary"),
        F.concat(F.lit("https://o/"), F.col("o_orderkey").cast("string")).alias("url"), F.lit("Lead").alias("source"), (-F.col("o_custkey") - 1).alias("source_id"), F.col("o_orderdate").alias("published_at"),
        (F.col("o_orderdate") + F.expr("interval 60 days")).alias("approved_at"), place.alias("geography"), F.when(F.col("o_orderstatus") == "F", "uae").otherwise("world").alias("category"),
        (F.col("o_orderkey") % 11 == 0).alias("featured"), F.concat(F.lit("order-"), (F.col("o_orderkey") % 700).cast("string")).alias("slug"), F.coalesce("others", F.array().cast(OUTLETS)).alias("others"),
        "o_orderstatus", "o_orderpriority",
    )


def story_dto(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publish.story(_story_docs(spark, sf_dir)).select("id", "headline", "summary", "published_at", "updated_at", "category", F.col("source_count").cast("long").alias("source_count"), F.size("sources").cast("long").alias("n_sources"), "featured")


def _newest() -> list:
    return [F.desc("published_at"), F.col("id")]


def story_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views by category, topic and section: how many stories each shows (100 at most), and the newest and oldest of them."""
    docs = _story_docs(spark, sf_dir)
    tags = docs.select(F.col("story_id").alias("id"), F.lower("o_orderstatus").alias("topic"), F.array(F.lower("o_orderstatus"), F.lower(F.substring("o_orderpriority", 3, 20))).alias("topics"), F.array(F.substring("o_orderpriority", 1, 1)).alias("assets"))
    stories = publish.story(docs).join(tags, "id")
    section = publish.in_section(F.col("topic"), F.col("topics"), F.col("assets"), F.col("category"), ("p", "urgent"), ("5",), "world")
    member = F.concat(F.array(F.concat(F.lit("category/"), "category"), F.when(section, F.lit("section/near"))), F.transform("topics", lambda t: F.concat(F.lit("topic/"), t)))
    filed = publish.filed(stories.select("id", "published_at", "category", "topic", "topics", "assets"), member, _newest(), 100)
    return filed.groupBy("view").agg(F.count("*").alias("n"), F.min_by("id", "rank").alias("newest"), F.max_by("id", "rank").alias("oldest"))


def story_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest story of a page name keeps it."""
    stories = publish.story(_story_docs(spark, sf_dir)).select("id", "slug", "published_at")
    return views.distinct_slugs(stories, "slug", _newest(), F.col("id").cast("string")).select("id", "slug")


def publish_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as stories by licence of their source: all reasons that hold them back."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    line = T.first_line(F.col("text"))
    licence = F.when(F.col("source") == "src1", "blocked").when(F.col("source") == "src2", "pending_review").otherwise("wire")
    image = F.when(F.col("doc_id") % 4 == 0, F.lit("image-a"))
    checks = publish.blockers(line, F.substring("text", 1, 290), F.lit(""), F.concat(F.lit("story-"), F.col("doc_id").cast("string")), F.concat(F.lit("https://d/"), F.col("doc_id").cast("string")), F.col("source"), licence, image, F.col("doc_id") % 8 == 0, F.col("lang"), F.when(F.col("toxic") == 1, F.lit("other")))
    checks = publish.approval(F.when(F.col("quality").isNotNull(), F.concat(F.lit("u"), (F.col("doc_id") % 3).cast("string"))), F.lit(D_NOW), ("u0", "u1"), F.col("quality"), F.lit(1)) | checks
    reasons = publish.held(F.col("text").isNotNull(), F.when(F.col("doc_id") % 10 == 3, "archived").otherwise("published"), F.when(F.col("doc_id") % 10 != 4, F.lit("2024-01-01").cast("date") + (F.col("doc_id") % 40).cast("int")), F.lit("2024-02-01").cast("date"), rules.hold_reasons(checks))
    return docs.join(labels, "doc_id", "left").select("doc_id", F.array_join(reasons, ",").alias("reasons"), (F.size(reasons) == 0).alias("public"))


D_NOW = "2024-02-01"


def home_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as stories of two regions: the first 15 of the one and 35 of the other among those of some topics."""
    events = table(spark, sf_dir, "events").filter(views.any_of(("click", "view", "error"), F.array("event_type")))
    placed = events.withColumn("region", F.when(F.col("user_id") % 3 == 0, "uae").otherwise("world"))
    top = views.top_n(placed, "region", [F.desc("ts"), F.col("event_id")], 35)
    return top.filter((F.col("rank") <= 15) | (F.col("region") == "world")).select("event_id", "region", F.col("rank").cast("long").alias("rank"))


def facet_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as stories: kinds and sizes as facets, two search terms, pinned ones first unless something is asked for; two pages of 20."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("words"), F.array("p_type").alias("kinds"), F.array(F.concat(F.lit("s"), (F.col("p_size") % 5).cast("string"))).alias("sizes"), "p_retailprice", (F.col("p_partkey") % 9 == 0).alias("featured"))
    return views.filtered(parts, {"kinds": ("ECONOMY", "PROMO", "STANDARD"), "sizes": ("s1", "s2", "s3")}, "brand 1", "words", [F.desc("p_retailprice"), F.col("p_partkey")], F.col("featured"), pages=2).select("p_partkey", F.col("rank").cast("long").alias("rank"), "total", "has_more")


def facet_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without anything asked for: pinned parts first."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", (F.col("p_partkey") % 9 == 0).alias("featured"), F.col("p_name").alias("words"))
    return views.filtered(parts, {}, "", "words", [F.desc("p_retailprice"), F.col("p_partkey")], F.col("featured"), pages=1).select("p_partkey", F.col("rank").cast("long").alias("rank"), "total", "has_more")


def events_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as events of a day or some: what is still shown, soonest first, 50 at most, with its day and month in words and whether it is over."""
    start = F.col("o_orderdate").cast("date")
    end = F.when(F.col("o_orderkey") % 3 == 0, F.date_add(start, (F.col("o_orderkey") % 40).cast("int")))
    today = D.dubai_day(F.lit("1998-05-05 21:00:00").cast("timestamp"))
    events = table(spark, sf_dir, "orders").select("o_orderkey", start.alias("start"), end.alias("end"), F.concat(F.lit("event "), F.col("o_custkey").cast("string")).alias("title"))
    last = F.coalesce("end", "start")
    shown = events.filter(last >= F.date_sub(today, 30)).orderBy("start", F.collate("title", "UNICODE"), "o_orderkey").limit(50)
    day, month = D.event_days(F.col("start"), F.col("end"))
    return shown.select("o_orderkey", day.alias("day"), month.alias("month"), (last < today).alias("past"))


def event_highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first featured order that is still to come in each priority, or the first of all, and how many come after it."""
    coming = table(spark, sf_dir, "orders").filter("o_orderdate >= timestamp_ntz '1998-05-06'").withColumn("featured", F.col("o_custkey") % 10 == 0)
    order = F.struct((~F.col("featured")).alias("later"), "o_orderdate", "o_orderkey")
    return coming.groupBy("o_orderpriority").agg(F.min(order).alias("_first"), F.count("*").alias("_n")).select("o_orderpriority", F.col("_first.o_orderkey").alias("highlight"), (F.col("_n") - 1).alias("n_others"))


def contact_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as senders of a form, with faults of all kinds: what becomes of each and which fields are wrong."""
    key = F.col("c_custkey")
    said = F.concat(F.lit("Hello,\r\n\r\n\r\nwe ask about "), F.col("c_mktsegment"), F.lit("\t and more"))
    payload = F.map_from_arrays(
        F.array(*map(F.lit, ("name", "email", "subject", "message", "website")), F.when(key % 13 == 0, "extra").otherwise("phone")),
        F.array(
            F.when(key % 7 != 0, F.concat(F.lit("  "), F.col("c_name"))), F.when(key % 5 == 0, F.col("c_name")).otherwise(F.concat(F.lit("c"), key.cast("string"), F.lit("@mail.example.com"))),
            F.when(key % 6 == 0, F.lit("x")).otherwise(F.col("c_mktsegment")), F.when(key % 4 == 0, F.lit("short")).otherwise(said), F.when(key % 10 == 1, F.lit("spam")), F.lit("1"),
        ),
    )
    sent = table(spark, sf_dir, "customer").select("c_custkey", F.map_filter(payload, lambda k, v: k != "phone").alias("payload"))
    done = forms.validate(sent, forms.CONTACT, F.lit("2024-02-01").cast("date"))
    return done.select("c_custkey", forms.outcome(F.col("ok"), F.col("spam")).alias("outcome"), F.array_join(F.array_sort(F.map_keys("errors")), ",").alias("wrong"), F.md5("value.message").alias("message"))


def event_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as announcements of events: days that aren't real, too early, too late or in the wrong order."""
    key, first = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    odd = F.when(key % 9 == 0, F.lit("2001-02-30")).when(key % 9 == 1, F.lit("soon")).otherwise(first)
    names = ("title", "eventType", "startDate", "endDate", "city", "url", "organiser", "email")
    values = (F.concat(F.lit("Order "), key.cast("string")), F.lit("Talk"), odd, F.when(key % 2 == 0, F.date_format(F.col("o_orderdate") + F.expr("interval 5 days") - F.make_dt_interval((key % 8).cast("int")), "yyyy-MM-dd")), F.lit("Dubai"), F.when(key % 11 == 0, F.lit("http://a.com/")).when(key % 11 == 1, F.lit("https://127.0.0.1/")).otherwise(F.lit("https://a.com/x")), F.lit("We"), F.lit("a@b.co"))
    sent = table(spark, sf_dir, "orders").select("o_orderkey", F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*values)).alias("payload"))
    done = forms.validate(sent, forms.EVENT, F.lit("1998-01-01").cast("date"), forms.EVENT_CHECK)
    listed = F.array_join(F.array_sort(F.transform(F.map_entries("errors"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), " ")
    return done.select("o_orderkey", "ok", listed.alias("wrong"))


def submissions_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as submissions: those of the first weeks are stored, of the rest those for which there is room, a newsletter's address once."""
    kind = F.when(F.col("event_type").isin("click", "view"), "newsletter").otherwise(F.col("event_type"))
    sent = table(spark, sf_dir, "events").select("event_id", kind.alias("kind"), F.col("ts").alias("at"), F.concat(F.when(F.col("event_id") % 2 == 0, " U").otherwise("u"), F.col("user_id").cast("string")).alias("email"))
    split = F.lit("2024-01-05").cast("timestamp_ntz")
    held, new = sent.filter(F.col("at") < split), sent.filter(F.col("at") >= split)
    return publish.appended(held, new, 1500).groupBy("kind").agg(F.count("*").alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))


def meta_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of documents by source: those of long documents take the place of all documents', where there are any."""
    docs = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("name"))
    new = table(spark, sf_dir, "documents").filter("n_chars > 6000").groupBy(F.col("source").alias("name")).agg(F.count("*").alias("value"))
    return publish.merged(docs.agg(F.count("*").alias("value")), new)


def runs_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 20 of all runs, of which one is added."""
    runs = table(spark, sf_dir, "events").select("event_id", "ts", "value")
    return publish.history(runs.filter("event_id <> 901"), runs.filter("event_id = 901"), "ts", 20)


def cleaned_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    return docs.select("doc_id", F.md5(T.clean(F.col("text"))).alias("line"), F.md5(T.clean(F.col("text"), multiline=True)).alias("lines"), T.cut_words(T.first_line(F.col("text")), 40).alias("teaser"), F.size(T.paragraphs(F.col("text"))).cast("long").alias("n_paragraphs"))


QUERIES = {
    f.__name__: f
    for f in (
        headline_entities, headline_similarity, classify_articles, classify_taxonomy, story_dto, story_views, story_slugs, publish_gate, home_regions, facet_stories, facet_newest, events_calendar, event_highlight,
        contact_forms, event_forms, submissions_stored, meta_merged, runs_kept, cleaned_texts,
    )
}

_COMMON = ", ".join(f"'{w}'" for w in sorted({*T.GENERIC, *T.PLACES, *T.STOPWORDS}))
_STEM = "case when length(w) <= 4 then w else regexp_replace(regexp_replace(w, 'ies$', 'y'), '(ing|ed|es|s)$', '') end"
_WORDS = "w as (select doc_id, list_distinct(regexp_split_to_array(t, '[^a-z0-9]+')) as tw, list_distinct(regexp_split_to_array(b, '[^a-z0-9]+')) as bw from d)"
_SPLIT = "d as (select doc_id, lower(split_part(text, chr(10), 1)) as t, lower(substr(text, length(split_part(text, chr(10), 1)) + 2)) as b from documents where text is not null)"


def _values(groups: classify.Groups) -> str:
    return ", ".join(f"('{g}', {i}, {j}, '{t}', {w})" for i, (g, terms) in enumerate(groups.items()) for j, (t, w) in enumerate(terms.items()))


def _found(groups: classify.Groups, name: str, source: str = "w") -> str:
    """CTE of each document's groups: ord, score, hits."""
    at = "list_has_any({0}, [term, term || 's', term || 'es'])"
    return f"""{name} as (select doc_id, g, ord, cast(sum(case when {at.format('tw')} then 2 * weight when {at.format('bw')} then weight else 0 end) as bigint) as score,
  list(term order by j) filter (where {at.format('tw')} or {at.format('bw')}) as hits from {source}, (values {_values(groups)}) r(g, ord, j, term, weight) group by doc_id, g, ord)"""


_CAPITAL_FORMS = ", ".join(f"'{t}{e}'" for terms in KINDS.capital.values() for t in terms for e in ("", "s", "es"))
_EXPLAIN = "string_agg(g || ' (' || array_to_string(hits, ', ') || ')', '; ' order by rank)"


def _ranks(name: str, source: str, most: int) -> str:
    return f"""{name} as (select doc_id, list(g order by rank) as ids, list(score order by rank)[1] as top, {_EXPLAIN} as said from
  (select *, row_number() over (partition by doc_id order by score desc, ord) as rank from {source} where score >= 3) t where rank <= {most} group by doc_id)"""


_OUTLETS = """st as (select o_orderkey as id, o_orderdate as placed, o_custkey, o_orderstatus, o_orderpriority, case o_custkey % 5 when 0 then 'uae' when 1 then 'world' else if(o_orderstatus = 'F', 'uae', 'world') end as category from orders),
so as (select id, placed as published_at, -o_custkey - 1 as source_id from st union all
  select id, l_shipdate, l_suppkey from st join lineitem on l_orderkey = id join supplier on s_suppkey = l_suppkey where s_acctbal > 0 and l_shipdate + interval 1 day <= placed + interval 60 days),
sg as (select id, min(published_at) as published_at, max(published_at) as updated_at, count(distinct source_id) as source_count, count(*) as n_sources from so group by id),
story as (select * from st join sg using (id))"""
_ENTITIES = f"""cap as (select doc_id, unnest(regexp_split_to_array(regexp_replace(split_part(text, chr(10), 1), '[’'']s\\b', '', 'g'), '[^A-Za-z0-9&]+')) as c from documents where text is not null),
st as (select doc_id, length(lower(c)) > 4 as long, (select {_STEM} from (select lower(c) as w) t) as s from cap
  where length(c) > 1 and lower(c) not in ({_COMMON}) and ((regexp_matches(c, '^[A-Z0-9&]{{2,6}}$') and regexp_matches(c, '[A-Z]')) or regexp_matches(c, '^[A-Z][a-z]'))),
e as (select doc_id, case when long and length(s) > 1 and substr(s, -1, 1) = substr(s, -2, 1) then left(s, length(s) - 1) else s end as s from st union select doc_id, s from money)"""
ORACLES = {
    "headline_similarity": f"""with {urls_and_text.TOKENS}, {_ENTITIES}, f as (select doc_id, coalesce(t.tokens, []) as t, coalesce((select list(e.s) from e where e.doc_id = d.doc_id), []) as e from documents d left join tokens t using (doc_id) where text is not null),
p as (select a.doc_id as a, b.doc_id as b, a.t as ta, b.t as tb, a.e as ae, b.e as be, list_intersect(a.e, b.e) as eb from f a join f b on b.doc_id between a.doc_id + 1 and a.doc_id + 3),
q as (select a, b, case when len(ta) = 0 or len(tb) = 0 then 0.0 else len(list_intersect(ta, tb)) / len(list_distinct(list_concat(ta, tb))) end as j, len(eb) as n, len(eb) / greatest(1, least(len(ae), len(be))) as o,
  len(list_filter(eb, lambda x: not (regexp_matches(x, '^[a-z]{{0,3}}[0-9]') and regexp_matches(x, '[mbk]$')))) as names from p)
select a, b, j >= 0.5 or (n >= 2 and names >= 1 and o >= 0.5 and j >= 0.1) as same, j + 0.5 * o as score from q where j + 0.5 * o > 0""",
    "headline_entities": f"""with {urls_and_text.TOKENS}, {_ENTITIES}
select d.doc_id, coalesce(string_agg(distinct e.s, ' ' order by e.s), '') as entities, count(distinct e.s) filter (where not (regexp_matches(e.s, '^[a-z]{{0,3}}[0-9]') and regexp_matches(e.s, '[mbk]$'))) as n_names
from documents d left join e using (doc_id) where text is not null group by d.doc_id""",
    "classify_articles": f"""with {_SPLIT}, {_WORDS}, {_found(GROUPS, "s")}, {_found({"generic": ARTICLES.generic, "negative": ARTICLES.negative}, "x")}, {_found({"uae": dict.fromkeys(ARTICLES.uae, 1)}, "u")},
up as (select doc_id, cast(sum(case when list_has_any(tw, [t, t || 's', t || 'es']) then 3 when list_has_any(bw, [t, t || 's', t || 'es']) then 1 else 0 end) as bigint) as points from w, (values {", ".join(f"('{t}')" for t in ARTICLES.uae)}) r(t) group by 1),
r as (select *, row_number() over (partition by doc_id order by score desc, ord) as rank from s where score > 0),
k as (select doc_id, list(g order by rank) as ids, sum(score) as total, flatten(list(hits order by rank)) as hits from r group by 1),
xx as (select doc_id, sum(score) as rest, flatten(list(coalesce(hits, []) order by ord)) as hits from x group by 1),
f as (select w.doc_id, points + if(w.doc_id % 4 = 0, 1, 0) as uae_score, ids, coalesce(total, 0) + rest as relevance, list_concat(coalesce(u.hits, []), coalesce(k.hits, []), xx.hits) as hits from w join up using (doc_id) join u using (doc_id) join xx using (doc_id) left join k using (doc_id))
select doc_id, if(uae_score >= 3, 'uae', 'world') as category, uae_score, coalesce(ids[1], 'general-investment') as topic, coalesce(array_to_string(ids[1:3], ','), '') as topics, cast(relevance as bigint) as relevance,
  relevance >= if(doc_id % 3 = 0, 1, 3) as relevant, array_to_string(hits, ',') as hits from f""",
    "classify_taxonomy": f"""with {_SPLIT}, {_WORDS}, v as (select doc_id, list_filter(tw, lambda x: x not in ({_CAPITAL_FORMS})) as tw, list_filter(bw, lambda x: x not in ({_CAPITAL_FORMS})) as bw from w),
{_found(KINDS.capital, "c0")}, {_found(KINDS.asset, "a0", "v")}, {_found(KINDS.geography, "g0")}, {_found(KINDS.transaction, "t0")}, {_ranks("c", "c0", 4)}, {_ranks("a", "a0", 4)}, {_ranks("g", "g0", 99)}, {_ranks("t", "t0", 1)},
f as (select w.doc_id, coalesce(c.ids, []) as c, coalesce(a.ids, []) as a, coalesce(g.ids, []) as g, list_filter(coalesce(g.ids, []), lambda x: x <> 'global') as sg, t.ids[1] as t, least(1.0, coalesce(c.top, 0) / 6.0) as cc, least(1.0, coalesce(a.top, 0) / 6.0) as ac,
  concat_ws(' | ', 'Capital: ' || c.said, 'Asset: ' || a.said, 'Deal: ' || t.said) as explanation from w left join c using (doc_id) left join a using (doc_id) left join g using (doc_id) left join t using (doc_id)),
h as (select *, if(len(c) > 0 and len(a) > 0, least(cc, ac), greatest(cc, ac) * 0.6) as conf from f)
select doc_id, array_to_string(c, ',') as capital_types, array_to_string(a, ',') as asset_classes, array_to_string(case when doc_id % 5 = 0 then list_prepend('uae', sg) when len(sg) > 0 then sg else g end, ',') as geography, t as transaction_type,
  floor(conf * 100 + 0.5) / 100 as confidence, (len(c) = 0 and len(a) = 0) or conf < 0.4 as needs_review, left(explanation, 500) as explanation, cast(if(t is null, 0, 2) + if(len(a) > 0, 2, 0) + if(len(c) > 0, 1, 0) as bigint) as priority from h""",
    "story_dto": f"""with {_OUTLETS} select id, 'Order ' || id as headline, nullif(o_orderpriority, '4-NOT SPECIFIED') as summary, published_at, updated_at, category, source_count, n_sources, id % 11 = 0 as featured from story""",
    "story_views": f"""with {_OUTLETS}, m as (select id, published_at, 'category/' || category as v from story union select id, published_at, 'topic/' || lower(o_orderstatus) from story union select id, published_at, 'topic/' || lower(substr(o_orderpriority, 3)) from story
  union select id, published_at, 'section/near' from story where category = 'world' and (lower(o_orderstatus) = 'p' or o_orderpriority in ('1-URGENT') or left(o_orderpriority, 1) = '5')),
r as (select *, row_number() over (partition by v order by published_at desc, id) as rank from m)
select v as view, count(*) as n, arg_min(id, rank) as newest, arg_max(id, rank) as oldest from r where rank <= 100 group by v""",
    "story_slugs": f"""with {_OUTLETS}, s as (select id, published_at, 'order-' || (id % 700) as slug from story)
select id, if(row_number() over (partition by slug order by published_at desc, id) > 1, slug || '-' || id, slug) as slug from s""",
    "publish_gate": """with s as (select d.*, quality, toxic, trim(split_part(text, chr(10), 1)) as line, trim(left(text, 290)) as summary, 'u' || (doc_id % 3) as who from documents d left join labels using (doc_id)),
r as (select doc_id, case when text is null then ['not a queue document'] when doc_id % 10 = 3 then ['status is archived'] else list_filter([
  case when doc_id % 10 = 4 then 'no publication time' when date '2024-01-01' + cast(doc_id % 40 as int) > date '2024-02-01' then 'scheduled' end, case when quality is null then 'no approval' end, case when quality is not null and who = 'u2' then 'not an approver' end,
  case when coalesce(quality, 0) <> 1 then 'changed' end, case when not length(line) between 12 and 160 then 'headline' end, case when not length(summary) between 20 and 280 then 'summary' end, case when source is null then 'source' end,
  case when source in ('src1', 'src2') then 'licence' end, case when doc_id % 4 = 0 and doc_id % 8 <> 0 then 'rights' end, case when doc_id % 4 = 0 and not coalesce(length(lang) between 2 and 120, false) then 'credit' end, case when toxic = 1 then 'duplicate' end], lambda x: x is not null) end as r from s)
select doc_id, array_to_string(r, ',') as reasons, len(r) = 0 as public from r""",
    "home_regions": """with e as (select *, if(user_id % 3 = 0, 'uae', 'world') as region from events where event_type in ('click', 'view', 'error')), r as (select *, row_number() over (partition by region order by ts desc, event_id) as rank from e)
select event_id, region, rank from r where rank <= if(region = 'uae', 15, 35)""",
    "facet_stories": """with f as (select *, row_number() over (order by p_retailprice desc, p_partkey) as rank, count(*) over () as total from part where p_type in ('ECONOMY', 'PROMO', 'STANDARD') and p_size % 5 in (1, 2, 3)
  and contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'brand') and contains(lower(p_name || ' ' || p_brand || ' ' || p_type), '1')) select p_partkey, rank, total, total > 40 as has_more from f where rank <= 40""",
    "facet_newest": """with f as (select *, row_number() over (order by p_partkey % 9 = 0 desc, p_retailprice desc, p_partkey) as rank, count(*) over () as total from part) select p_partkey, rank, total, total > 20 as has_more from f where rank <= 20""",
    "events_calendar": """with e as (select o_orderkey, cast(o_orderdate as date) as s, case when o_orderkey % 3 = 0 then cast(o_orderdate as date) + cast(o_orderkey % 40 as int) end as e, 'event ' || o_custkey as title from orders),
t as (select * from e where coalesce(e, s) >= date '1998-04-06' order by s, title, o_orderkey limit 50)
select o_orderkey, day(s) || if(e <> s, '-' || day(e), '') as day, strftime(s, '%b') || if(e <> s and strftime(e, '%b') <> strftime(s, '%b'), '-' || strftime(e, '%b'), '') as month, coalesce(e, s) < date '1998-05-06' as past from t""",
    "event_highlight": """select o_orderpriority, arg_min(o_orderkey, (if(o_custkey % 10 = 0, 0, 1), o_orderdate, o_orderkey)) as highlight, count(*) - 1 as n_others from orders where o_orderdate >= timestamp '1998-05-06' group by 1""",
    "contact_forms": """with c as (select *, list_filter([case when c_custkey % 5 = 0 then 'email' end, case when c_custkey % 13 = 0 then 'extra' end, case when c_custkey % 4 = 0 then 'message' end, case when c_custkey % 7 = 0 then 'name' end, case when c_custkey % 6 = 0 then 'subject' end], lambda x: x is not null) as w from customer)
select c_custkey, case when c_custkey % 10 = 1 then 'dropped' when len(w) > 0 then 'refused' else 'stored' end as outcome, array_to_string(w, ',') as wrong, case when len(w) = 0 then md5('Hello,' || chr(10) || chr(10) || 'we ask about ' || c_mktsegment || ' and more') end as message from c""",
    "event_forms": """with o as (select o_orderkey as k, cast(o_orderdate as date) as s, cast(o_orderdate as date) + 5 - cast(o_orderkey % 8 as int) as e from orders),
d as (select *, case when k % 9 = 0 then 'Enter a real date.' when k % 9 = 1 then 'Enter a date as YYYY-MM-DD.' when s < date '1997-12-31' then 'This date is too far in the past.' when s > date '1998-01-01' + 730 then 'This date is too far in the future.' end as se,
  case when k % 2 = 0 and e < date '1997-12-31' then 'This date is too far in the past.' when k % 2 = 0 and e > date '1998-01-01' + 760 then 'This date is too far in the future.' end as ee, case when k % 11 = 0 then 'Enter a link that starts with https://' when k % 11 = 1 then 'Enter a public website address.' end as ue from o),
x as (select k, list_filter(['endDate: ' || coalesce(ee, case when se is null and ue is null and k % 2 = 0 and e < s then 'The end date must be on or after the start date.' end), 'startDate: ' || se, 'url: ' || ue], lambda v: v is not null) as w from d)
select k as o_orderkey, len(w) = 0 as ok, array_to_string(w, ' ') as wrong from x""",
    "submissions_stored": """with s as (select event_id, if(event_type in ('click', 'view'), 'newsletter', event_type) as kind, ts, user_id from events),
n as (select *, row_number() over (partition by user_id order by ts) as i from s where ts >= timestamp '2024-01-05' and kind = 'newsletter' and user_id not in (select user_id from s where ts < timestamp '2024-01-05' and kind = 'newsletter')),
f as (select event_id, kind, ts from n where i = 1 union all select event_id, kind, ts from s where ts >= timestamp '2024-01-05' and kind <> 'newsletter'),
p as (select *, row_number() over (partition by kind order by ts) as i from f), h as (select kind, count(*) as held from s where ts < timestamp '2024-01-05' group by 1)
select kind, count(*) as n, min(event_id) as first, max(event_id) as last from p left join h using (kind) where i + coalesce(held, 0) <= 1500 group by kind""",
    "meta_merged": "select a.source as name, coalesce(b.n, a.n) as value from (select source, count(*) as n from documents group by 1) a left join (select source, count(*) as n from documents where n_chars > 6000 group by 1) b using (source)",
    "runs_kept": "select event_id, ts, value from events order by ts desc limit 20",
    "cleaned_texts": """with a as (select doc_id, nfc_normalize(text) as n, split_part(text, chr(10), 1) as l, text from documents where text is not null),
b as (select *, regexp_replace(n, '[\\x{0}-\\x{8}\\x{b}\\x{c}\\x{e}-\\x{1f}\\x{7f}-\\x{9f}\\x{200b}-\\x{200f}\\x{2028}-\\x{202e}\\x{2060}-\\x{2064}\\x{2066}-\\x{2069}\\x{feff}]', '', 'g') as v from a)
select doc_id, md5(trim(regexp_replace(v, '[\\s\\x{a0}]+', ' ', 'g'))) as line, md5(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(v, '\\r\\n?', chr(10), 'g'), chr(9), ' '), ' {2,}', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^[\\s\\x{a0}]+|[\\s\\x{a0}]+$', '', 'g')) as lines,
  if(length(l) > 40, rtrim(regexp_replace(left(l, 40), '\\s+\\S*$', '')) || '…', l) as teaser, len(list_filter(list_transform(regexp_split_to_array(text, '\\n\\s*\\n'), lambda p: trim(regexp_replace(p, '[\\s\\x{a0}]+', ' ', 'g'))), lambda p: p <> '')) as n_paragraphs from b""",
}
