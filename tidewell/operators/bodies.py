"""Rich text of a content system as blocks that a page can show safely: spans with equal marks put together, links looked up in their block.

A body is an array of BLOCK. What comes out is an array of struct(type, list, spans array of struct(text, bold, italic, href)): paragraphs, two levels of headings and
list items. Other kinds of blocks and spans go; unknown marks and unsafe links leave their text. All of it is within a row; the one pass through Python
composes the characters of a whole body at once.

Defined results: a null or empty body has no blocks; null blocks, blocks without children and spans without text go; a mark that two links define means the last of them;
of a span's links the first safe one counts. Columns besides the body are kept as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions import text as T
from tidewell.functions import url as U
from tidewell.session import held

BLOCK = "struct<_type:string,style:string,listItem:string,markDefs:array<struct<_type:string,_key:string,href:string>>,children:array<struct<_type:string,text:string,marks:array<string>>>>"
# Kinds of blocks by their style, kinds of lists.
STYLES = {"normal": "p", "h2": "h2", "h3": "h3"}
LISTS = ("bullet", "number")
#: Between the spans of a block and between blocks while they are one text; neither character is ever shown.
SPAN, END = "\x01", "\x02"
UNSEEN = T.INVISIBLE.replace(r"\x{0}-\x{8}", r"\x{0}\x{3}-\x{8}")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value is computed once, however often body reads it."""
    return F.transform(F.array(value), body)[0]


def _safe(links: Column, marks: Column) -> Column:
    """The address of the first mark that stands for a safe link."""
    of = F.transform(marks, lambda m: F.try_element_at(F.filter(links, lambda d: d["_key"] == m), F.lit(-1))["href"])
    return F.get(F.filter(of, lambda h: h.isNotNull()), F.lit(0))


def _read(block: Column) -> Column:
    """What is shown of a block: its type and list, and of its spans the marks, and the texts as one."""
    some = lambda c, shape: F.coalesce(c, F.array().cast(shape))
    defs = F.filter(some(block["markDefs"], "array<struct<_type:string,_key:string,href:string>>"), lambda d: d["_type"] == "link")
    links = F.transform(defs, lambda d: F.struct(d["_key"].alias("_key"), U.safe_href(d["href"]).alias("href")))
    shown = F.filter(block["children"], lambda c: (c["_type"] == "span") & c["text"].isNotNull())

    def mark(c: Column, links: Column) -> Column:
        has = lambda name: F.coalesce(F.array_contains(c["marks"], name), F.lit(False))
        return F.struct(has("strong").alias("bold"), has("em").alias("italic"), F.when((F.size(c["marks"]) > 0) & (F.size(links) > 0), _safe(links, c["marks"])).alias("href"))

    def plain(text: Column) -> Column:
        return F.when(text.contains(SPAN) | text.contains(END), F.translate(text, SPAN + END, "")).otherwise(text)

    item = F.coalesce(block["listItem"], F.lit("")) != ""
    style = F.lit("p")
    for name, kind in STYLES.items():
        style = F.when(block["style"] == name, kind).otherwise(style)
    kind = F.when(item, "li").otherwise(style)
    listed = F.when(item, F.when(block["listItem"].isin(*LISTS), block["listItem"]).otherwise("bullet"))

    def read(shown: Column) -> Column:
        marks = _let(links, lambda links: F.transform(shown, lambda c: mark(c, links)))
        return F.struct(kind.alias("type"), listed.alias("list"), marks.alias("marks"), F.array_join(F.transform(shown, lambda c: plain(c["text"])), SPAN).alias("text"))

    return _let(shown, read)


def _runs(marks: Column, texts: Column) -> Column:
    """Neighbours with equal marks as one span, without blanks at the ends of the block and without spans that nothing is left of: each begins where marks differ from those before."""
    starts = F.filter(F.transform(marks, lambda m, i: F.when(~m.eqNullSafe(F.get(marks, i - 1)), i)), lambda i: i.isNotNull())

    def runs(starts: Column) -> Column:
        def span(at: Column, i: Column) -> Column:
            text = F.array_join(F.slice(texts, at + 1, F.coalesce(F.get(starts, i + 1), F.size(marks)) - at), "")
            left = F.when(i == 0, F.ltrim(text)).otherwise(text)
            mark = F.get(marks, at)
            trimmed = F.when(i == F.size(starts) - 1, F.rtrim(left)).otherwise(left)
            return F.struct(trimmed.alias("text"), mark["bold"].alias("bold"), mark["italic"].alias("italic"), mark["href"].alias("href"))

        return F.filter(F.transform(starts, span), lambda s: s["text"] != "")

    return _let(starts, runs)


def blocks(pages: DataFrame, body: str = "body", into: str = "blocks") -> DataFrame:
    """pages with the blocks of their bodies; see the module."""
    kept = F.filter(F.coalesce(F.col(body), F.array().cast(f"array<{BLOCK}>")), lambda b: (b["_type"] == "block") & (F.size(b["children"]) > 0))
    # what each span needs is taken from it first, so that little more than texts goes through Python and is held there
    named = pages.withColumn("_kept", F.transform(kept, _read))
    whole = F.array_join(F.transform("_kept", lambda b: b["text"]), END)
    # blanks are squeezed in the whole body at once: the characters between spans stay, and no run of blanks goes beyond them
    named = named.withColumn("_whole", T.squeezed(whole, UNSEEN))

    def made(texts: Column) -> Column:
        def block(b: Column, i: Column) -> Column:
            spans = _let(F.split(F.get(texts, i), SPAN, -1), lambda own: _runs(b["marks"], own))
            return F.struct(b["type"].alias("type"), b["list"].alias("list"), spans.alias("spans"))

        return F.filter(F.transform("_kept", block), lambda b: F.size(b["spans"]) > 0)

    # the texts are a value of their own: within the lambda they would be cut out of the whole body for each block; the blocks are held, as a filter
    # that Spark infers from their being exploded would else make them, and go through Python, a second time
    return held(named.drop(into), _let(F.split("_whole", END, -1), made), into).drop("_kept", "_whole")
