"""Feeds and job boards as tables: RSS 2.0, RSS 1.0 and Atom by Spark's XML functions, board JSON by its JSON functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions import dates as D
from tidewell.functions import text as T
from tidewell.functions import url as U

_MEDIA = "struct<_url:string,_type:string,_medium:string,_width:string,_height:string>"
_PICTURES = f"media_content:array<{_MEDIA}>,media_group:struct<media_content:array<{_MEDIA}>>,media_thumbnail:array<{_MEDIA}>,enclosure:array<{_MEDIA}>,image:struct<url:string>"
_CATEGORY = "struct<_VALUE:string,_term:string,_label:string>"
_ITEM = (
    "struct<title:string,link:string,feedburner_origLink:string,guid:struct<_VALUE:string,_isPermaLink:string>,pubDate:string,dc_date:string,published:string,description:string,content_encoded:string,"
    f"category:array<{_CATEGORY}>,dc_subject:array<string>,dc_creator:string,author:string,{_PICTURES}>"
)
RSS = f"channel struct<title:string,item:array<{_ITEM}>>, item array<{_ITEM}>"
ATOM = (
    "title string, entry array<struct<title:string,link:array<struct<_href:string,_rel:string,_type:string>>,id:string,published:string,updated:string,summary:string,content:string,"
    f"category:array<{_CATEGORY}>,author:struct<name:string>,{_PICTURES}>>"
)
# The least width and height of an image that shows something, endings of image files, and an image's tag.
LEAST_WIDTH, LEAST_HEIGHT = 80, 60
IMAGE_FILE = r"(?i)\.(jpe?g|png|webp|gif|avif)(\?|$)"
IMAGE_TAG = r"""(?i)<img[^>]+src=["']([^"']+)["'][^>]*>"""


def _clean(xml: Column) -> Column:
    """Without byte order mark and document type, and with names of elements in one piece: media:title is media_title and so no item's title."""
    x = F.regexp_replace(xml, r"^﻿|(?is)<!DOCTYPE[^>\[]*(\[.*?\])?\s*>", "")
    return F.regexp_replace(x, r"(</?[A-Za-z_][\w.-]*):(?=[A-Za-z_])", "$1_")


def _format(xml: Column) -> Column:
    return F.when(xml.rlike(r"(?is)<rss[\s>]"), "rss").when(xml.rlike(r"(?is)<feed[\s>]"), "atom").when(xml.rlike(r"(?is)<(rdf_)?RDF[\s>]"), "rdf")


def _text(c: Column) -> Column:
    """A trimmed text, null if nothing is left of it."""
    return F.nullif(F.trim(c), F.lit(""))


def _shown(url: Column, width: Column, height: Column) -> Column:
    """Whether an address may be of an image to show: on the web, and not so small as counters and icons are. Sizes that aren't numbers or 0 say nothing."""
    size = lambda c: F.coalesce(c.try_cast("double"), F.lit(0.0))
    small = lambda c, least: (size(c) != 0) & (size(c) < least)
    return F.coalesce(U.is_http(url), F.lit(False)) & ~small(width, LEAST_WIDTH) & ~small(height, LEAST_HEIGHT)


def _is_image(url: Column, kind: Column, medium: Column) -> Column:
    """Whether an attachment is an image by its type or medium, or by its file's ending where these say nothing."""
    kind, medium = F.coalesce(kind, F.lit("")), F.coalesce(medium, F.lit(""))
    other = ((medium != "") & (medium != "image")) | ((kind != "") & ~kind.startswith("image/"))
    return F.coalesce(~other & (url.rlike(IMAGE_FILE) | kind.startswith("image/") | (medium == "image")), F.lit(False))


def images(i: Column, links: Column | None = None) -> Column:
    """Addresses of an item's images, in the order of media content, content of a media group, thumbnails, enclosures, its image; of an entry's enclosing links (links) last."""
    empty = F.array().cast("array<string>")
    media = lambda c: F.coalesce(F.transform(F.filter(c, lambda m: _is_image(m["_url"], m["_type"], m["_medium"]) & _shown(m["_url"], m["_width"], m["_height"])), lambda m: F.trim(m["_url"])), empty)
    thumbs = F.transform(F.filter(i["media_thumbnail"], lambda m: _shown(m["_url"], m["_width"], m["_height"])), lambda m: F.trim(m["_url"]))
    none = F.lit(None).cast("string")
    attached = F.transform(F.filter(i["enclosure"], lambda m: _is_image(m["_url"], m["_type"], none) & _shown(m["_url"], none, none)), lambda m: F.trim(m["_url"]))
    own = F.when(_shown(_text(i["image"]["url"]), none, none), F.array(_text(i["image"]["url"])))
    parts = [media(i["media_content"]), media(i["media_group"]["media_content"]), thumbs, attached, own]
    if links is not None:
        found = F.filter(links, lambda x: (x["_rel"] == "enclosure") & _is_image(x["_href"], x["_type"], none) & _shown(x["_href"], none, none))
        parts.append(F.transform(found, lambda x: x["_href"]))
    return F.concat(*[F.coalesce(p, empty) for p in parts])


def html_image(html: Column) -> Column:
    """The address of the first image in HTML, null if that is too small or not on the web."""
    tag, url = F.regexp_extract(html, IMAGE_TAG, 0), F.regexp_extract(html, IMAGE_TAG, 1)
    size = lambda name: F.regexp_extract(tag, rf"""(?i){name}=["']?(\d+)""", 1)
    return F.when((tag != "") & _shown(url, size("width"), size("height")), url)


def _categories(c: Column) -> Column:
    """Categories by term, else label, else text."""
    named = F.transform(F.coalesce(c, F.array().cast(f"array<{_CATEGORY}>")), lambda x: F.trim(F.coalesce(F.nullif(x["_term"], F.lit("")), F.nullif(x["_label"], F.lit("")), x["_VALUE"])))
    return F.filter(named, lambda x: F.coalesce(x != "", F.lit(False)))


def items(feeds: DataFrame, xml: str = "xml", most: int = 60) -> DataFrame:
    """feeds' other columns with format, ord and title, link, guid, published_at, summary_html, content_html, categories, author, images, html_image of each
    item, up to `most` of a feed in its order. What isn't a feed gives no rows (see rejected).

    A guid is a link only if it says so by isPermaLink, and is an address of the web. Elements of namespaces count under their own names alone.
    """
    kept = [c for c in feeds.columns if c != xml]
    read = feeds.select(*kept, _clean(F.col(xml)).alias("_x")).withColumn("format", _format(F.col("_x")))
    options = {"mode": "PERMISSIVE", "ignoreNamespace": "true"}
    i = F.col("i")
    picture = F.coalesce(html_image(F.col("summary_html")), html_image(F.col("content_html")))
    rss = read.filter("format in ('rss', 'rdf')").withColumn("_f", F.from_xml("_x", RSS, options))
    rss = rss.select(*kept, "format", F.posexplode(F.coalesce("_f.channel.item", "_f.item")).alias("ord", "i"))
    guid = _text(i["guid"]["_VALUE"])
    permalink = F.when((i["guid"]["_isPermaLink"] != "false") & F.coalesce(U.is_http(guid), F.lit(False)), guid)
    link = F.coalesce(_text(i["link"]), _text(i["feedburner_origLink"]), permalink)
    subjects = F.filter(F.transform(F.coalesce(i["dc_subject"], F.array().cast("array<string>")), F.trim), lambda x: F.coalesce(x != "", F.lit(False)))
    rss = rss.select(
        *kept, "format", "ord", F.trim(T.decode_entities(i["title"])).alias("title"), link.alias("link"), F.coalesce(guid, link).alias("guid"),
        F.coalesce(D.parse(i["pubDate"]), D.parse(i["dc_date"]), D.parse(i["published"])).alias("published_at"), i["description"].alias("summary_html"), i["content_encoded"].alias("content_html"),
        F.concat(_categories(i["category"]), subjects).alias("categories"), F.coalesce(_text(i["dc_creator"]), i["author"]).alias("author"), images(i).alias("images"),
    )
    atom = read.filter("format = 'atom'").withColumn("_f", F.from_xml("_x", ATOM, options)).select(*kept, "format", F.posexplode("_f.entry").alias("ord", "i"))
    first = lambda ok: F.get(F.filter(i["link"], lambda x: F.coalesce(x["_href"] != "", F.lit(False)) & ok(x)), F.lit(0))["_href"]
    link = F.trim(F.coalesce(first(lambda x: F.coalesce(F.nullif(x["_rel"], F.lit("")), F.lit("alternate")) == "alternate"), first(lambda x: F.lit(True))))
    atom = atom.select(
        *kept, "format", "ord", F.trim(T.decode_entities(i["title"])).alias("title"), link.alias("link"), F.coalesce(_text(i["id"]), link).alias("guid"),
        F.coalesce(D.parse(i["published"]), D.parse(i["updated"])).alias("published_at"), i["summary"].alias("summary_html"), i["content"].alias("content_html"),
        _categories(i["category"]).alias("categories"), i["author"]["name"].alias("author"), images(i, i["link"]).alias("images"),
    )
    return rss.unionByName(atom).filter(F.col("ord") < most).withColumn("html_image", picture)


def rejected(feeds: DataFrame, xml: str = "xml") -> DataFrame:
    """Rows whose text isn't a feed."""
    return feeds.filter(_format(_clean(F.coalesce(F.col(xml), F.lit("")))).isNull())


def greenhouse(boards: DataFrame, json: str = "json") -> DataFrame:
    """external_id, title, location, department, url, posted_at of a Greenhouse board's jobs."""
    schema = "jobs array<struct<id:bigint,title:string,absolute_url:string,location:struct<name:string>,departments:array<struct<name:string>>,updated_at:string,first_published:string>>"
    j = boards.select(F.inline(F.from_json(json, schema)["jobs"]))
    return j.select(F.col("id").cast("string").alias("external_id"), "title", F.col("location.name").alias("location"), F.array_join(F.col("departments.name"), ", ").alias("department"), F.col("absolute_url").alias("url"), F.to_timestamp(F.coalesce("first_published", "updated_at")).alias("posted_at"))


def lever(boards: DataFrame, json: str = "json") -> DataFrame:
    """The same of a Lever board, whose JSON is a list."""
    schema = "array<struct<id:string,text:string,hostedUrl:string,createdAt:bigint,categories:struct<location:string,team:string,commitment:string,allLocations:array<string>>>>"
    j = boards.select(F.inline(F.from_json(json, schema)))
    return j.select(F.col("id").alias("external_id"), F.col("text").alias("title"), F.coalesce(F.array_join("categories.allLocations", "; "), "categories.location").alias("location"), F.col("categories.team").alias("department"), F.col("hostedUrl").alias("url"), F.timestamp_millis("createdAt").alias("posted_at"))


def ashby(boards: DataFrame, json: str = "json") -> DataFrame:
    """The same of an Ashby board, without jobs that aren't listed."""
    schema = "jobs array<struct<id:string,title:string,location:string,secondaryLocations:array<struct<location:string>>,department:string,employmentType:string,jobUrl:string,publishedAt:string,isListed:boolean>>"
    j = boards.select(F.inline(F.from_json(json, schema)["jobs"])).filter(F.coalesce("isListed", F.lit(True)))
    return j.select(F.col("id").alias("external_id"), "title", F.concat_ws("; ", "location", "secondaryLocations.location").alias("location"), "department", F.col("jobUrl").alias("url"), F.to_timestamp("publishedAt").alias("posted_at"))


TITLE = r"^(.+?)\s+at\s+(.+?)\s*(?:\(([^)]+)\))?\s*$"
#: What a category looks like that names a place.
PLACE = r"(?i)\b(uae|dubai|abu dhabi|sharjah|difc|adgm|remote)\b"


def rss_jobs(feed_items: DataFrame, company: str = "company") -> DataFrame:
    """Jobs from feed items whose titles read "Role at Company (Location)"; else the source's company, and the first category that names a place."""
    part = lambda n: F.nullif(F.regexp_extract("title", TITLE, n), F.lit(""))
    place = F.get(F.filter("categories", lambda c: c.rlike(PLACE)), F.lit(0)) if "categories" in feed_items.columns else F.lit(None).cast("string")
    return feed_items.select(F.coalesce("guid", "link").alias("external_id"), F.coalesce(part(1), "title").alias("title"), F.coalesce(part(2), company).alias("company"), F.coalesce(part(3), place).alias("location"), F.col("link").alias("url"), F.col("published_at").alias("posted_at"))
