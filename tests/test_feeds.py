import datetime as dt

import duckdb
import pytest

import __spark_entry__
from tidewell.sources import feeds

RSS = """<?xml version="1.0"?><rss version="2.0" xmlns:media="http://m" xmlns:dc="http://d" xmlns:content="http://c" xmlns:feedburner="http://f"><channel><title>C</title>
<item><title>Real headline</title><media:title>Photo caption</media:title><link>https://a.com/1</link><description>Real text</description><media:description>Of the photo</media:description>
<media:content url="https://i.com/clip.mp4" type="video/mp4"/><media:content url="https://i.com/1.jpg" width="600" height="400"/><media:content url="https://i.com/dot.gif" width="1" height="1"/>
<media:group><media:content url="https://i.com/2" medium="image"/><media:content url="https://i.com/3.png" medium="video"/></media:group><media:thumbnail url="https://i.com/t" width="79"/><media:thumbnail url=" https://i.com/t2" width="wide"/>
<enclosure url="https://i.com/e.webp?x=1" length="1"/><enclosure url="ftp://i.com/e.png" type="image/png"/><image><url> https://i.com/own </url></image><category domain="d">one</category><category> </category><dc:subject>two</dc:subject></item>
<item><title>T2</title><guid>https://a.com/plain</guid><dc:date>2024-01-03T00:00:00Z</dc:date><content:encoded>&lt;p&gt;&lt;IMG class='x' src='https://i.com/h.jpg' width="300"&gt;&lt;/p&gt;</content:encoded><dc:creator>Ann</dc:creator></item>
<item><title>T3</title><guid isPermaLink="true">https://a.com/perma</guid><pubDate>no date</pubDate><dc:date>2024-01-04T00:00:00Z</dc:date><description>&lt;img src="https://i.com/tiny.gif" height=1&gt;&lt;img src="https://i.com/big.gif"&gt;</description></item>
<item><title>T4</title><feedburner:origLink>https://a.com/orig</feedburner:origLink><guid isPermaLink="false">https://a.com/no</guid></item>
<item><title>T5</title><guid isPermaLink="true">not an address</guid></item></channel></rss>"""
RDF = """<rdf:RDF xmlns:rdf="http://r" xmlns="http://purl.org/rss/1.0/" xmlns:dc="http://d"><channel rdf:about="x"><title>C</title></channel><item rdf:about="https://a.com/1"><title>R</title><link>https://a.com/1</link><dc:subject>s</dc:subject><dc:date>2024-02-01T00:00:00Z</dc:date></item></rdf:RDF>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom" xmlns:media="http://m"><title>F</title><entry><title>E</title><media:title>No</media:title><link rel="enclosure" type="image/png" href="https://i.com/l"/><link rel="related" href="https://b.com/r"/>
<link rel="alternate" href="https://b.com/1"/><id>i1</id><content type="html">Body</content><media:content url="https://i.com/m.jpg">x</media:content><category term="" label="L"/><category term="T" label="L"/><updated>2024-02-01T00:00:00Z</updated><author><name>Bo</name></author></entry>
<entry><title>E2</title><link rel="self" href="https://b.com/self"/><summary>S</summary></entry></feed>"""


@pytest.fixture(scope="module")
def got(spark):
    df = spark.createDataFrame([("r", RSS), ("d", RDF), ("a", ATOM)], "source string, xml string")
    return {(r.source, r.ord): r for r in feeds.items(df).collect()}


def test_elements_of_namespaces_are_none_of_the_feed(got):
    assert [got["r", i].title for i in range(5)] == ["Real headline", "T2", "T3", "T4", "T5"] and got["r", 0].summary_html == "Real text"
    assert (got["a", 0].title, got["a", 0].content_html, got["a", 0].author) == ("E", "Body", "Bo")
    assert got["r", 1].published_at == dt.datetime(2024, 1, 3) and got["r", 2].published_at == dt.datetime(2024, 1, 4) and got["r", 1].author == "Ann"
    assert (got["d", 0].format, got["d", 0].title, got["d", 0].categories, got["d", 0].published_at) == ("rdf", "R", ["s"], dt.datetime(2024, 2, 1))


def test_links_and_guids(got):
    assert [(got["r", i].link, got["r", i].guid) for i in range(1, 5)] == [
        (None, "https://a.com/plain"), ("https://a.com/perma", "https://a.com/perma"), ("https://a.com/orig", "https://a.com/no"), (None, "not an address"),
    ]
    assert (got["a", 0].link, got["a", 0].guid, got["a", 1].link, got["a", 1].guid) == ("https://b.com/1", "i1", "https://b.com/self", "https://b.com/self")


def test_categories(got):
    assert got["r", 0].categories == ["one", "two"] and got["a", 0].categories == ["L", "T"] and got["r", 1].categories == []


def test_images(got):
    assert got["r", 0].images == ["https://i.com/1.jpg", "https://i.com/2", "https://i.com/t2", "https://i.com/e.webp?x=1", "https://i.com/own"]
    assert got["a", 0].images == ["https://i.com/m.jpg", "https://i.com/l"] and got["r", 1].images == []
    assert [got["r", i].html_image for i in range(3)] == [None, "https://i.com/h.jpg", None]


def test_query_against_its_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    cursor = con.execute(__spark_entry__.oracle_sql()["feed_media"])
    names = [d[0] for d in cursor.description]
    rows = __spark_entry__.queries()["feed_media"](spark, sf).select(*names).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(cursor.fetchall(), key=str)
