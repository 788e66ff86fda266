import time

import pytest

from tidewell.llm import htmltext

CASES = [
    (None, ""),
    ("", ""),
    ("   \n ", ""),
    ("<article><h1>A &amp; B</h1><p>one\n  two<br>three</article><footer>f</footer>", "A & B\none two\nthree"),
    ("<nav><a href=x>home</a></nav><main><p>text<p>more<div class='ad'>buy</div>end</main>", "text\nmore\nend"),
    ("<article><p>body<script>var t='</p>';</script> goes on<!-- <p>no --></p><section id='comments'>first!</section></article>", "body goes on"),
    ("<article><p>x</p><form>name <input></form><aside>see also</aside><p>y</p></article><div>late</div>", "x\ny"),
    ("<body><header><h1>Site</h1></header><article><header><h1>Head</h1></header>t</article>", "Head\nt"),
    ("<article>1 < 2 &lt; 3 &#65;&copy;<b>bold</b>er</article", "1 < 2 < 3 A©bolder"),
    ("<article><p title='a>b'>t<style>p{}</style></p><!-- open", "t"),
    ("<div><p>" + "running text of a page without any container " * 4 + "</p></div><ul><li><a href=a>one</a><li><a href=b>two</a></ul>",
     ("running text of a page without any container " * 4).strip()),
]


@pytest.mark.parametrize("page, text", CASES)
def test_cases(page, text):
    assert htmltext.extract([page]) == [text]


def test_the_tree_knows_its_examples():
    import numpy as np

    rows = np.asarray(htmltext.EXAMPLES, float)
    assert (htmltext.TREE.keeps(rows[:, :-1]) == rows[:, -1].astype(bool)).all()


PROSE = "the committee has read the whole report and will answer in writing before the next session starts "


def test_names_that_prose_shares_with_furniture_leave_the_choice_to_the_text():
    page = (
        f'<article><h1>Title</h1><p>{PROSE}</p><div class="social-impact"><p>{PROSE}</p></div><section id="related-work"><h2>Work so far</h2><p>{PROSE * 2}</p></section>'
        '<div class="share-story"><a href=a>Mail</a> <a href=b>Post</a></div><div class="related-links"><p>' + PROSE + "</p></div><p>End.</p></article>"
    )
    text = PROSE.strip()
    assert htmltext.extract([page]) == ["\n".join(["Title", text, text, "Work so far", (PROSE * 2).strip(), "End."])]


def test_blocks_of_links_without_a_mark_stay():
    page = "<nav><a href=x>home</a></nav><article>" + "".join(f"<p><a href=x>{'word ' * n}</a></p>" for n in (1, 3, 9, 30, 80)) + f"<p>{PROSE}</p></article><div>late</div>"
    assert [len(line.split()) for line in htmltext.extract([page])[0].split("\n")] == [1, 3, 9, 30, 80, 17]


def _inner_features(tree, at):
    """The features that the tree splits on at or below a node."""
    if tree.feature[at] < 0:
        return set()
    return {htmltext.FEATURES[tree.feature[at]]} | _inner_features(tree, tree.below[at]) | _inner_features(tree, tree.above[at])


def test_the_tree_splits_on_words_links_and_neighbours():
    assert {"words", "links"} <= _inner_features(htmltext.TREE, 0) and _inner_features(htmltext.TREE, 0) & {"words_before", "links_before", "words_after", "links_after"}


def _page(rng):
    """A page in a container with prose and furniture under names that both use, and its main text by block."""
    def prose():
        return " ".join(rng.choice(PROSE.split()) for _ in range(rng.randrange(25, 120)))
    parts, main = [], []
    for _ in range(rng.randrange(4, 12)):
        kind = rng.randrange(4)
        if kind == 0:
            name = rng.choice(["social-policy", "related-findings", "tags-explained", "informed-consent", "skip-logic"])
            body = [prose() for _ in range(rng.randrange(1, 4))]
            parts.append(f'<div class="{name}">' + "".join(f"<p>{b}</p>" for b in body) + "</div>")
            main += body
        elif kind == 1:
            name = rng.choice(["social-follow", "related-reads", "share-this", "tags-cloud", "recommended-today"])
            links = [" ".join(rng.choice(PROSE.split()) for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(2, 7))]
            parts.append(f'<div class="{name}"><ul>' + "".join(f"<li><a href=x>{x}</a></li>" for x in links) + "</ul></div>")
        else:
            main.append(prose())
            parts.append(f"<p>{main[-1]}</p>")
    return f"<nav><a href=x>home</a></nav><article>{''.join(parts)}</article><footer>all rights</footer>", main


def test_held_out_blocks():
    """Pages that no example was made from: blocks kept against blocks of the main text."""
    import random
    from collections import Counter

    rng = random.Random(5)
    pages = [_page(rng) for _ in range(300)]
    hit = made = wanted = 0
    for text, (_, main) in zip(htmltext.extract([page for page, _ in pages]), pages, strict=True):
        got = Counter(text.split("\n")) if text else Counter()
        hit, made, wanted = hit + sum((got & Counter(main)).values()), made + sum(got.values()), wanted + len(main)
    assert 2 * hit / (made + wanted) >= 0.97


def test_long_pages_and_many_open_tags():
    page = "<article>" + "<div><b><" * 20_000 + "p>deep" + "<p>x" * 20_000
    assert htmltext.extract([page])[0].endswith("x\nx")


def test_unclosed_and_unopened_tags_take_time_in_proportion():
    """Each page took minutes while open tags were looked through one by one, and the rest of the page for each end."""
    began = time.process_time()
    for page in ("<article>" + "<div></span>" * 100_000 + "<p>deep", "<article><p>deep" + "<select>" * 50_000, "<article>" + "<b class='x'></i></section>" * 50_000 + "<p>deep"):
        assert htmltext.extract([page])[0].endswith("deep")
    assert time.process_time() - began < 30


def test_query(spark):
    rows = [(i, f"u{i}", page, 1) for i, (page, _) in enumerate(CASES)] + [(None, None, None, None), (0, "u0", CASES[3][0], 2)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    out = htmltext.extract_pages(df)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = out.collect()
    assert sorted((r.page_id or 0, r.text) for r in got)[1:3] == [(0, ""), (0, CASES[3][1])] and len(got) == len(rows)
    assert all(r.n_chars == len(r.text) for r in got)
    assert htmltext.extract_pages(df.limit(0)).count() == 0
