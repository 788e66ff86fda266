"""Queries that read feeds and job boards: pages and parts written as XML or JSON, and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import text as T
from tidewell.functions import url as U
from tidewell.operators import intake
from tidewell.session import table
from tidewell.sources import feeds


def _feed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed for each fifty documents of their first lines: RSS of even fifties, Atom of odd ones."""
    docs = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.floor(F.col("doc_id") / 50).alias("n"), T.escape_html(F.left(T.first_line(F.col("text")), F.lit(60))).alias("t"))
    date = F.date_format(F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval((F.col("doc_id") % 30).cast("int")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rss = F.concat(F.lit("<item><title>"), "t", F.lit(" - Wire</title><link>/a/"), F.col("doc_id").cast("string"), F.lit("?utm_source=x</link><category>A</category><category> </category><description>&lt;p&gt;Text "), F.col("doc_id").cast("string"), F.lit(" &amp;amp; more&lt;/p&gt;</description><pubDate>"), date, F.lit("</pubDate></item>"))
    atom = F.concat(F.lit("<entry><title>"), "t", F.lit("</title><link rel='self' href='https://no.com/'/><link href='https://www.f.com/a/"), F.col("doc_id").cast("string"), F.lit("/'/><id>i"), F.col("doc_id").cast("string"), F.lit("</id><category term='B' label='L'/><summary>S</summary><updated>"), date, F.lit("</updated></entry>"))
    item = F.struct("doc_id", F.when(F.col("n") % 2 == 0, rss).otherwise(atom).alias("x"))
    # fifty documents at most
    each = docs.groupBy("n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda i: i["x"]), "").alias("items"))
    whole = F.when(F.col("n") % 2 == 0, F.concat(F.lit("<?xml version='1.0'?><rss version='2.0'><channel><title>C</title>"), "items", F.lit("</channel></rss>"))).otherwise(F.concat(F.lit("<feed xmlns='http://www.w3.org/2005/Atom'><title>F</title>"), "items", F.lit("</feed>")))
    return each.select(F.col("n").alias("source_id"), whole.alias("xml"), F.lit("Wire").alias("source_name"), F.lit("https://f.com/home").alias("homepage"), (F.col("n") % 3 != 0).alias("allow_excerpt"), F.lit(True).alias("allow_images"))


def feed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of feeds in their normal form."""
    items = feeds.items(_feed_texts(spark, sf_dir)).withColumn("images", F.array(F.lit("http://i.com/1")))
    found = intake.normalised(items, F.lit("2024-01-20 12:00:00").cast("timestamp"))
    return found.select("source_id", F.col("ord").cast("long").alias("ord"), F.md5("title").alias("title"), "canonical", "summary", "image_url", F.date_format("published_at", "yyyy-MM-dd HH:mm").alias("published_at"), "date_estimated", F.array_join("categories", ",").alias("categories"))


def board_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as roles of three job boards, by the boards' own JSON."""
    parts = table(spark, sf_dir, "part").groupBy(F.floor(F.col("p_partkey") / 100))  # a hundred at most
    green = parts.agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.concat(F.lit("https://g/"), F.col("p_partkey").cast("string")).alias("absolute_url"), F.struct(F.col("p_brand").alias("name")).alias("location"), F.array(F.struct(F.col("p_type").alias("name")), F.struct(F.lit("X").alias("name"))).alias("departments"), F.lit("2024-01-02T03:04:05Z").alias("updated_at"))).alias("jobs"))).alias("json"))
    lever = parts.agg(F.to_json(F.collect_list(F.struct(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("text"), F.lit("https://l/").alias("hostedUrl"), (F.lit(1704067200000) + F.col("p_partkey") * 1000).alias("createdAt"), F.struct(F.col("p_brand").alias("location"), F.col("p_type").alias("team")).alias("categories")))).alias("json"))
    ashby = parts.agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("location"), F.col("p_type").alias("department"), F.lit("https://b/").alias("jobUrl"), F.lit("2024-01-03").alias("publishedAt"), (F.col("p_size") % 2 == 0).alias("isListed"))).alias("jobs"))).alias("json"))
    named = lambda df, board: df.select(F.lit(board).alias("board"), "external_id", "title", "location", "department", F.date_format("posted_at", "yyyy-MM-dd HH:mm:ss").alias("posted_at"))
    return named(feeds.greenhouse(green), "greenhouse").unionByName(named(feeds.lever(lever), "lever")).unionByName(named(feeds.ashby(ashby), "ashby"))


def title_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles from headlines such as "Role at Company (Place)"."""
    title = F.concat("p_name", F.when(F.col("p_size") % 3 != 0, F.concat(F.lit(" at "), "p_brand")).otherwise(""), F.when(F.col("p_size") % 3 == 1, " (Dubai)").otherwise(""))
    items = table(spark, sf_dir, "part").select(title.alias("title"), F.col("p_partkey").cast("string").alias("guid"), F.lit("l").alias("link"), F.lit(None).cast("timestamp").alias("published_at"), F.lit("Board Co").alias("company"), F.when(F.col("p_size") % 2 == 0, F.array(F.lit("Finance"), F.lit("Abu Dhabi, UAE"))).otherwise(F.array().cast("array<string>")).alias("categories"))
    return feeds.rss_jobs(items).select("external_id", "title", "company", "location")


def page_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which page addresses may be fetched, and what may be linked to."""
    odd = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("http://10.0.0."), F.col("page_id").cast("string"))).when(F.col("page_id") % 5 == 1, F.lit("mailto:a@b.co")).when(F.col("page_id") % 5 == 2, F.lit("javascript:x")).otherwise(F.col("url"))
    asset = F.concat(F.lit("image-a1b2-"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 3 == 0, "x5-png").otherwise("-png"))
    return table(spark, sf_dir, "pages").select("page_id", U.is_public(odd).alias("public"), F.when(U.safe_href(odd).startswith("mailto"), "mail").when(U.safe_href(odd).isNotNull(), "web").otherwise("none").alias("link"), U.asset_url(asset, "https://cdn").alias("asset"))


def feed_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of feeds that carry media, subjects and links of several namespaces: what belongs to the item, and its images."""
    n = F.col("doc_id")
    s = n.cast("string")
    title = T.escape_html(F.regexp_replace(F.left(T.first_line(F.col("text")), F.lit(40)), r"[^A-Za-z ]", ""))
    docs = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.floor(n / 50).alias("source_id"), F.concat(
        F.lit("<item><media:title>Caption</media:title><title>x"), title, F.lit("</title><dc:title>No</dc:title>"),
        F.when(n % 4 == 0, F.concat(F.lit("<link>https://a/"), s, F.lit("</link>"))).when(n % 4 == 1, F.concat(F.lit("<feedburner:origLink>https://o/"), s, F.lit("</feedburner:origLink>"))).otherwise(""),
        F.when(n % 3 == 0, F.concat(F.lit("<guid isPermaLink='true'>https://g/"), s, F.lit("</guid>"))).when(n % 3 == 1, F.concat(F.lit("<guid>https://g/"), s, F.lit("</guid>"))).otherwise(""),
        F.lit("<category>c</category>"), F.when(n % 2 == 0, F.concat(F.lit("<dc:subject>"), F.coalesce("lang", F.lit("")), F.lit("</dc:subject>"))).otherwise(""),
        F.lit("<media:content url='https://i/"), s, F.lit(".jpg' width='"), (n % 160).cast("string"), F.lit("'/><media:group><media:content medium='image' url='https://m/"), s, F.lit("'/></media:group>"),
        F.lit("<enclosure type='"), F.when(n % 5 == 0, "audio/mpeg").otherwise("image/png"), F.lit("' url='https://e/"), s, F.lit("'/><description>&lt;img src='https://h/"), s, F.lit("' width='"), (n % 200).cast("string"), F.lit("'&gt;</description></item>"),
    ).alias("x"))
    # fifty documents at most
    each = docs.groupBy("source_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "x"))), lambda i: i["x"]), "").alias("items"))
    head = "<rss xmlns:media='m' xmlns:dc='d' xmlns:feedburner='f'><channel>"
    found = feeds.items(each.select("source_id", F.concat(F.lit(head), "items", F.lit("</channel></rss>")).alias("xml")))
    return found.select("source_id", F.col("ord").cast("long").alias("ord"), "title", "link", "guid", F.array_join("categories", ",").alias("categories"), F.array_join("images", " ").alias("images"), "html_image")


QUERIES = {f.__name__: f for f in (feed_items, board_jobs, title_jobs, page_safety, feed_media)}
ORACLES = {
    "feed_items": """with d as (select doc_id, doc_id // 50 as n, trim(regexp_replace(left(split_part(text, chr(10), 1), 60), '\\s+', ' ', 'g')) as t from documents where text is not null),
o as (select *, row_number() over (partition by n order by doc_id) - 1 as ord, timestamp '2024-01-01' + to_days(cast(doc_id % 30 as int)) as at_ from d)
select n as source_id, ord, md5(t) as title, 'https://f.com/a/' || doc_id as canonical, case when n % 3 = 0 then '' when n % 2 = 0 then 'Text ' || doc_id || ' & more' else 'S' end as summary, cast(null as varchar) as image_url,
  if(at_ > timestamp '2024-01-20 13:00:00', '2024-01-20 12:00', strftime(at_, '%Y-%m-%d %H:%M')) as published_at, at_ > timestamp '2024-01-20 13:00:00' as date_estimated, if(n % 2 = 0, 'A', 'B') as categories from o where ord < 60""",
    "board_jobs": """with p as (select * from part)
select 'greenhouse' as board, cast(p_partkey as varchar) as external_id, p_name as title, p_brand as location, p_type || ', X' as department, '2024-01-02 03:04:05' as posted_at from p
union all select 'lever', cast(p_partkey as varchar), p_name, p_brand, p_type, strftime(timestamp '2024-01-01' + to_seconds(p_partkey), '%Y-%m-%d %H:%M:%S') from p
union all select 'ashby', cast(p_partkey as varchar), p_name, p_brand, p_type, '2024-01-03 00:00:00' from p where p_size % 2 = 0""",
    "title_jobs": """select cast(p_partkey as varchar) as external_id, p_name as title, if(p_size % 3 <> 0, p_brand, 'Board Co') as company, case when p_size % 3 = 1 then 'Dubai' when p_size % 2 = 0 then 'Abu Dhabi, UAE' end as location from part""",
    "page_safety": """with p as (select page_id, case page_id % 5 when 0 then 'http://10.0.0.' || page_id when 1 then 'mailto:a@b.co' when 2 then 'javascript:x' else url end as u from pages)
select page_id, regexp_matches(u, '^https?://[^/]+\\.') and not starts_with(u, 'http://10.') as public, case when starts_with(u, 'mailto') then 'mail' when regexp_matches(u, '^https://') then 'web' else 'none' end as link, case when page_id % 3 = 0 then 'https://cdn/a1b2-' || page_id || 'x5.png' end as asset from p""",
    "feed_media": """with d as (select *, doc_id // 50 as n, trim('x' || regexp_replace(left(split_part(text, chr(10), 1), 40), '[^A-Za-z ]', '', 'g')) as title from documents where text is not null),
l as (select *, case doc_id % 4 when 0 then 'https://a/' || doc_id when 1 then 'https://o/' || doc_id else if(doc_id % 3 = 0, 'https://g/' || doc_id, null) end as link from d)
select n as source_id, row_number() over (partition by n order by doc_id) - 1 as ord, title, link, if(doc_id % 3 = 2, link, 'https://g/' || doc_id) as guid, 'c' || if(doc_id % 2 = 0 and lang <> '', ',' || lang, '') as categories,
  concat_ws(' ', if(doc_id % 160 = 0 or doc_id % 160 >= 80, 'https://i/' || doc_id || '.jpg', null), 'https://m/' || doc_id, if(doc_id % 5 = 0, null, 'https://e/' || doc_id)) as images,
  if(doc_id % 200 = 0 or doc_id % 200 >= 80, 'https://h/' || doc_id, null) as html_image from l""",
}
