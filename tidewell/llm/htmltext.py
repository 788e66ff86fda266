"""Main text of HTML pages: flat text blocks, shallow features of each block and its neighbours, a decision tree.

A page is cut into flat blocks of text at block-level tags. A block has its count of words, its link density
(the share of its words inside links), the same two of the blocks before and after it, and three marks of the
elements around it: under furniture (menus, adverts, forms, comments, ...), under a content container, and
whether the page has such a container at all. Names that furniture shares with prose (related, social, ...) are
half a mark where they stand beside other words, as in "social-impact"; there words, links and neighbours decide.
A decision tree, grown from the labelled table EXAMPLES, keeps or drops each block on its own, so a page needs one
pass and no memory beyond itself.

Defined results: null or empty html, and a page without content, give the empty text. Broken markup is read as
browsers do: a comment or script that isn't closed runs to the end, a "<" before no tag is text. Repeated
pages give repeated rows. Columns of the input besides the named ones are passed by or ignored.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter
from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# HTML's elements by their role here.
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead"
    " tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
UNSHOWN = frozenset("script style noscript template title textarea select svg math iframe object canvas audio video datalist button head".split())
RAW = frozenset("script style noscript template title textarea svg iframe".split())
FURNITURE = frozenset("nav footer aside form menu dialog".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
FURNITURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer"
    " disqus footer gdpr login menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion"
    " recommended related share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags teaser toolbar widget".split()
)
# Words of FURNITURE_WORDS that name prose as well; beside words other than OF_LAYOUT they say little.
SHARED_WORDS = frozenset("consent login recommended related share sharing signup skip social subscription tags teaser".split())
OF_LAYOUT = frozenset(
    "area article articles bar block bottom box button buttons card cards col column container content desktop group head header heading icon icons inner item"
    " items left like link links list main media mobile module more news panel post posts right row section side site stories story text title tool tools top"
    " us wrap wrapper you".split()
)
CONTENT = frozenset(("article", "main"))
CONTENT_WORDS = frozenset("article content entry main post story".split())

TOKEN = re.compile(
    r"<!--(?P<comment>.*?)(?:-->|\Z)"
    r"|<(?P<close>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<close2>/?)(?P<tag2>[A-Za-z][^\s/>]*)(?P<attrs2>[^>]*+)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
LETTERS = re.compile(r"[a-z]+")

#: words, link density: of the block, the one before, the one after; under furniture (0.5: by a shared word); under content; page has content.
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "furniture", "content", "page_content")
#: The labelled table: FEATURES and 1 for main text. Rows are typical blocks of news pages, forums and blogs.
EXAMPLES = (
    # pages with a content container: paragraphs, headings and one-word lines inside it
    (12, 0, 8, 0, 60, 0, 0, 1, 1, 1), (1, 0, 60, 0, 45, 0, 0, 1, 1, 1), (85, 0, 3, 0, 1, 0, 0, 1, 1, 1), (3, 0, 120, 0, 9, 0, 0, 1, 1, 1),
    (240, 0.02, 12, 0, 6, 0, 0, 1, 1, 1), (40, 0.3, 25, 0, 30, 0, 0, 1, 1, 1), (2, 1, 50, 0, 70, 0, 0, 1, 1, 1), (9, 0, 0, 0, 0, 0, 0, 1, 1, 1),
    (6, 0.5, 1, 1, 80, 0, 0, 1, 1, 1), (15, 0, 9, 0, 12, 0.1, 0, 1, 1, 1), (1, 0, 1, 0, 1, 0, 0, 1, 1, 1), (30, 0, 1, 1, 4, 1, 0, 1, 1, 1),
    # lists of links and lines that are all link, inside it
    (5, 1, 3, 0, 4, 0, 0, 1, 1, 1), (3, 1, 2, 1, 2, 1, 0, 1, 1, 1), (9, 1, 40, 0, 0, 0, 0, 1, 1, 1), (1, 1, 0, 0, 60, 0, 0, 1, 1, 1), (7, 0.8, 6, 1, 3, 1, 0, 1, 1, 1),
    (25, 1, 9, 0, 14, 1, 0, 1, 1, 1),
    # the same pages: blocks outside of it
    (8, 0, 1, 1, 12, 0, 0, 0, 1, 0), (60, 0, 5, 1, 9, 0, 0, 0, 1, 0), (1, 1, 1, 1, 1, 1, 0, 0, 1, 0), (14, 0, 90, 0, 0, 0, 0, 0, 1, 0),
    (120, 0.1, 3, 0, 40, 0, 0, 0, 1, 0), (4, 0, 33, 0, 2, 1, 0, 0, 1, 0), (25, 0.8, 1, 1, 7, 0, 0, 0, 1, 0), (11, 0, 0, 0, 70, 0, 0, 0, 1, 0),
    # furniture, inside and outside of containers, on any page
    (8, 0, 60, 0, 55, 0, 1, 1, 1, 0), (1, 1, 0, 0, 1, 1, 1, 0, 1, 0), (70, 0, 80, 0, 90, 0, 1, 1, 1, 0), (12, 0, 5, 1, 60, 0, 1, 0, 1, 0),
    (9, 0, 40, 0, 0, 0, 1, 0, 1, 0), (33, 0.1, 25, 0, 14, 0, 1, 1, 1, 0), (45, 0, 2, 0, 38, 0, 1, 0, 0, 0), (1, 1, 1, 1, 1, 1, 1, 0, 0, 0),
    (150, 0, 100, 0, 80, 0, 1, 0, 0, 0), (6, 0, 0, 0, 30, 0, 1, 0, 0, 0), (20, 0.4, 2, 1, 2, 1, 1, 0, 0, 0), (3, 0, 70, 0, 0, 0, 1, 0, 0, 0),
    # under a name that prose and furniture share, in a container: prose among prose, and short or linked blocks
    (45, 0, 30, 0, 60, 0, 0.5, 1, 1, 1), (18, 0, 40, 0, 55, 0, 0.5, 1, 1, 1), (2, 0, 50, 0, 60, 0, 0.5, 1, 1, 1), (60, 0.05, 2, 0, 0, 0, 0.5, 1, 1, 1),
    (22, 0, 3, 0, 25, 0.1, 0.5, 1, 1, 1), (90, 0.1, 12, 0, 4, 0, 0.5, 1, 1, 1), (4, 0, 8, 0, 35, 0, 0.5, 1, 1, 1), (28, 0.2, 70, 0, 3, 1, 0.5, 1, 1, 1),
    (2, 0, 60, 0, 3, 1, 0.5, 1, 1, 0), (5, 1, 2, 0, 6, 1, 0.5, 1, 1, 0), (3, 0, 80, 0, 1, 1, 0.5, 1, 1, 0), (12, 0.9, 2, 0, 14, 0.9, 0.5, 1, 1, 0),
    (6, 0, 1, 1, 2, 1, 0.5, 1, 1, 0), (1, 1, 1, 1, 0, 0, 0.5, 1, 1, 0), (8, 0.8, 3, 0, 70, 0, 0.5, 1, 1, 0), (30, 0.7, 10, 1, 12, 1, 0.5, 1, 1, 0),
    (2, 0, 90, 0, 2, 0, 0.5, 1, 1, 0), (4, 0, 120, 0, 3, 0.7, 0.5, 1, 1, 0), (3, 0, 4, 1, 0, 0, 0.5, 1, 1, 0), (25, 1, 9, 1, 40, 0, 0.5, 1, 1, 0),
    (3, 1, 4, 1, 60, 0, 0.5, 1, 1, 0), (5, 1, 60, 0, 45, 0, 0.5, 1, 1, 0), (2, 1, 30, 0, 80, 0, 0.5, 1, 1, 0), (4, 0.8, 3, 1, 35, 0, 0.5, 1, 1, 0),
    # the same names outside of a container, on pages with one and without
    (45, 0, 30, 0, 60, 0, 0.5, 0, 1, 0), (3, 1, 2, 1, 2, 1, 0.5, 0, 1, 0), (70, 0, 60, 0, 50, 0, 0.5, 0, 0, 1), (35, 0.1, 3, 0, 40, 0, 0.5, 0, 0, 1),
    (3, 0, 2, 1, 2, 1, 0.5, 0, 0, 0), (6, 0.9, 4, 0.9, 5, 0.9, 0.5, 0, 0, 0), (2, 0, 70, 0, 4, 1, 0.5, 0, 0, 0), (30, 0.8, 3, 0, 2, 1, 0.5, 0, 0, 0),
    # pages without a container: running text, and short blocks next to it
    (60, 0, 10, 0, 45, 0, 0, 0, 0, 1), (45, 0.05, 60, 0, 1, 0, 0, 0, 0, 1), (25, 0, 2, 1, 70, 0, 0, 0, 0, 1), (18, 0, 40, 0, 4, 1, 0, 0, 0, 1),
    (9, 0, 4, 0, 50, 0, 0, 0, 0, 1), (7, 0, 55, 0, 48, 0, 0, 0, 0, 1), (30, 0.2, 35, 0, 0, 0, 0, 0, 0, 1), (3, 0, 30, 0, 44, 0, 0, 0, 0, 1),
    (200, 0.1, 1, 1, 3, 1, 0, 0, 0, 1), (22, 0, 0, 0, 19, 0, 0, 0, 0, 1), (5, 0, 90, 0, 26, 0, 0, 0, 0, 1), (28, 0, 0, 0, 0, 0, 0, 0, 0, 1),
    # pages without a container: link lists, captions and small print
    (1, 1, 1, 1, 1, 1, 0, 0, 0, 0), (4, 1, 50, 0, 5, 1, 0, 0, 0, 0), (30, 0.9, 20, 0, 15, 1, 0, 0, 0, 0), (6, 0.5, 6, 0.5, 6, 0.5, 0, 0, 0, 0),
    (3, 0, 2, 1, 2, 1, 0, 0, 0, 0), (5, 0, 3, 0, 4, 0, 0, 0, 0, 0), (12, 0.6, 80, 0, 9, 1, 0, 0, 0, 0), (2, 0, 0, 0, 1, 1, 0, 0, 0, 0),
    (7, 0, 1, 1, 5, 0, 0, 0, 0, 0), (4, 0, 40, 0, 0, 0, 0, 0, 0, 0), (2, 1, 40, 0, 38, 0, 0, 0, 0, 0), (50, 0.7, 1, 1, 1, 1, 0, 0, 0, 0),
)


class Tree:
    """A binary decision tree of thresholds, grown by Gini impurity until its leaves are pure."""

    def __init__(self, rows: Sequence[Sequence[float]]):
        table = np.asarray(rows, float)
        self.feature: list[int] = []
        self.cut: list[float] = []
        self.below: list[int] = []
        self.above: list[int] = []
        self.leaf: list[bool] = []
        self._grow(table[:, :-1], table[:, -1].astype(bool))

    def _grow(self, x: np.ndarray, y: np.ndarray) -> int:
        at = len(self.leaf)
        for field in (self.feature, self.below, self.above):
            field.append(-1)
        self.cut.append(0.0)
        self.leaf.append(bool(y.mean() >= 0.5))
        best = None
        for f in range(x.shape[1]) if 0 < y.sum() < len(y) else ():
            values = np.unique(x[:, f])
            for cut in (values[1:] + values[:-1]) / 2:
                low = x[:, f] < cut
                impurity = sum(len(part) * part.mean() * (1 - part.mean()) for part in (y[low], y[~low]))
                if best is None or impurity < best[0] - 1e-12:
                    best = (impurity, f, cut, low)
        if best:
            _, self.feature[at], self.cut[at], low = best
            self.below[at] = self._grow(x[low], y[low])
            self.above[at] = self._grow(x[~low], y[~low])
        return at

    def keeps(self, x: np.ndarray) -> np.ndarray:
        """Whether each row of features is main text; all rows step down the tree together."""
        feature, cut, below, above = map(np.asarray, (self.feature, self.cut, self.below, self.above))
        node = np.zeros(len(x), int)
        while (inner := feature[node] >= 0).any():
            rows, at = np.flatnonzero(inner), node[inner]
            node[rows] = np.where(x[rows, feature[at]] < cut[at], below[at], above[at])
        return np.asarray(self.leaf)[node]


#: How much more common blocks with a clear mark or none are on pages than those with half a mark.
COMMON = 8
TREE = Tree([row for row in EXAMPLES for _ in range(1 if row[6] == 0.5 else COMMON)])


def _named(value: str) -> float:
    """How far the names in a class or id speak for furniture: 1 fully, 0.5 by shared words beside words of another kind."""
    most = 0.0
    for name in value.split():
        words = frozenset(LETTERS.findall(name))
        if words & FURNITURE_WORDS:
            clear = words & FURNITURE_WORDS - SHARED_WORDS or words <= FURNITURE_WORDS | OF_LAYOUT
            most = max(most, 1.0 if clear else 0.5)
    return most


def _marks(tag: str, attrs: str, in_content: bool) -> tuple[float, bool]:
    """How far an element is furniture (0, 0.5 or 1), whether it's a content container."""
    furniture, content = float(tag in FURNITURE or (tag == "header" and not in_content)), tag in CONTENT
    if attrs and attrs.strip("/ \t\n\r\f"):
        for name, *values in ATTRIBUTE.findall(attrs):
            name, value = name.lower(), "".join(values).lower()
            if name in ("class", "id"):
                named = _named(value) if tag not in ("html", "body", *CONTENT) else 0.0
                furniture = max(furniture, named)
                if not named and tag in ("div", "section") and CONTENT_WORDS & frozenset(LETTERS.findall(value)):
                    content = True
            elif name == "role":
                furniture, content = max(furniture, float(value in FURNITURE_ROLES)), content or value in CONTENT
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
                furniture = 1.0
    return furniture, content and not furniture


def blocks(page: str) -> list[tuple[str, int, int, float, bool]]:
    """Flat blocks in page order: text, words, words in links, under furniture, under content."""
    found: list[tuple[str, int, int, float, bool]] = []
    parts: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, float, bool]] = []  # open elements, each with what holds inside of it
    many: Counter[str] = Counter()  # of each name how many are open, so that an end tag without any is known at once
    unended: set[str] = set()  # names of which no end tag follows any more
    links = 0

    def begin(tag: str, furniture: float, content: bool) -> None:
        stack.append((tag, furniture, content))
        many[tag] += 1

    def end_last() -> str:
        tag = stack.pop()[0]
        many[tag] -= 1
        return tag

    def end_block() -> None:
        if parts:
            words = references.unescape("".join(parts)).split()
            if words:
                inside = len(references.unescape("".join(linked)).split()) if linked else 0
                top = stack[-1] if stack else ("", 0.0, False)
                found.append((" ".join(words), len(words), min(inside, len(words)), top[1], top[2]))
            parts.clear()
            linked.clear()

    def add(text: str) -> None:
        if text:
            parts.append(text)
            if links:
                linked.append(text)

    at, size = 0, len(page)
    while at < size:
        m = TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        closing, attrs = bool(m["close"] or m["close2"]), m["attrs"] or m["attrs2"] or ""
        if tag == "a":
            links = 0 if closing else 1
            if linked and not closing:
                linked.append(" ")
        if tag in RAW and not closing:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if tag in UNSHOWN:
            if tag != "head":
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at) if not closing and tag not in unended else None
                if not closing and end is None:
                    unended.add(tag)
                at = end.end() if end else at
            continue
        if tag not in BLOCK:
            # an inline element with a mark of furniture holds until it's closed; others leave no trace
            if tag not in VOID and attrs and not closing and tag != "a" and _marks(tag, attrs, False)[0]:
                end_block()
                top = stack[-1] if stack else ("", 0.0, False)
                begin(tag, max(top[1], _marks(tag, attrs, False)[0]), top[2])
            elif closing and many[tag]:
                end_block()
                while end_last() != tag:
                    pass
            continue
        end_block()
        links = 0 if tag != "br" else links
        if tag in VOID:
            continue
        if stack and stack[-1][0] == "p":
            end_last()
            if closing and tag == "p":
                continue
        if closing:
            if many[tag]:
                while end_last() != tag:
                    pass
            continue
        top = stack[-1] if stack else ("", 0.0, False)
        furniture, content = _marks(tag, attrs, top[2])
        begin(tag, max(top[1], furniture), top[2] or content)
    end_block()
    return found


def features(page: Sequence[tuple[str, int, int, float, bool]]) -> np.ndarray:
    """A row of FEATURES for each block of one page."""
    x = np.zeros((len(page), len(FEATURES)))
    if len(page):
        x[:, 0] = [b[1] for b in page]
        x[:, 1] = np.array([b[2] for b in page]) / x[:, 0]
        x[1:, 2:4], x[:-1, 4:6] = x[:-1, 0:2], x[1:, 0:2]
        x[:, 6] = [b[3] for b in page]
        x[:, 7] = [b[4] for b in page]
        x[:, 8] = max(b[4] and b[3] < 1 for b in page)
    return x


def extract(pages: Iterable[str | None]) -> list[str]:
    """The main text of each page."""
    found = [blocks(page or "") for page in pages]
    if not found:
        return []
    kept = TREE.keeps(np.concatenate([features(page) for page in found]))
    texts, at = [], 0
    for page in found:
        texts.append("\n".join(b[0] for b, keep in zip(page, kept[at : at + len(page)], strict=True) if keep))
        at += len(page)
    return texts


@F.pandas_udf(T.StringType())
def _main_text(html: pd.Series) -> pd.Series:
    return pd.Series(extract(html))


def main_text(html: Column) -> Column:
    """The main text of a page; empty where there is none."""
    return _main_text(html)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""
    return pages.select("page_id", "url", main_text(F.col("html")).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
