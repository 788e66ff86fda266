import random
import re
import unicodedata

from pyspark.sql import functions as F

from tidewell.operators import bodies, jobs

SAFE = re.compile(r"(https://[^\s/]+\S*|mailto:[^\s@]+@[^\s@]+)", re.I)


def block(*children, style="normal", item=None, defs=(), kind="block"):
    return {"_type": kind, "style": style, "listItem": item, "markDefs": [{"_type": "link", "_key": k, "href": h} for k, h in defs], "children": [{"_type": t, "text": x, "marks": list(m)} for t, x, m in children]}


def plainly(body):
    """Span after span, each put to the one before if its marks are the same."""
    out = []
    for b in body or []:
        if not b or b["_type"] != "block" or b["children"] is None:
            continue
        links = {d["_key"]: d["href"] for d in b["markDefs"] or []}
        spans = []
        for c in b["children"]:
            if c["_type"] != "span" or c["text"] is None:
                continue
            text = re.sub(r"\s+", " ", unicodedata.normalize("NFC", c["text"]).replace("​", ""))
            href = next((links[m] for m in c["marks"] or [] if SAFE.fullmatch(links.get(m) or "")), None)
            marks = ("strong" in (c["marks"] or []), "em" in (c["marks"] or []), href)
            if spans and tuple(spans[-1][1:]) == marks:
                spans[-1][0] += text
            else:
                spans.append([text, *marks])
        if spans:
            spans[0][0] = spans[0][0].lstrip()
            spans[-1][0] = spans[-1][0].rstrip()
        spans = [tuple(s) for s in spans if s[0]]
        if spans:
            kind = "li" if b["listItem"] else {"h2": "h2", "h3": "h3"}.get(b["style"], "p")
            out.append((kind, (b["listItem"] if b["listItem"] in ("bullet", "number") else "bullet") if kind == "li" else None, spans))
    return out


def made(spark, many):
    df = spark.createDataFrame(list(enumerate(many)), f"id int, body array<{bodies.BLOCK}>").withColumn("_own", F.lit(1))
    out = bodies.blocks(df)
    assert out.columns == ["id", "body", "_own", "blocks"]
    return [[(b.type, b.list, [tuple(s) for s in b.spans]) for b in r.blocks] for r in out.orderBy("id").collect()]


def test_cases(spark):
    body = [
        block(("span", " Read ", []), ("span", "this ", ["strong"]), ("span", "now ", ["strong", "other"]), ("span", "here", ["k", "em"]), defs=[("k", "https://a.ae/x")], style="h2"),
        block(("span", "bad link", ["k"]), ("span", " é", []), defs=[("k", "javascript:1")], item="square"),
        block(("image", "no", []), ("span", " ​ ", []), item="number"),
        block(("span", "no", []), kind="image"),
        block(("span", "twice", ["a"]), defs=[("a", "https://one.ae"), ("a", "https://two.ae")], style="quote"),
        block(("span", "first safe", ["x", "b", "a"]), defs=[("a", "https://one.ae"), ("b", "ftp://no")]),
    ]
    got = made(spark, [body, None, [], [None, {**block(), "children": None}]])
    assert got[0] == [
        ("h2", None, [("Read ", False, False, None), ("this now ", True, False, None), ("here", False, True, "https://a.ae/x")]), ("li", "bullet", [("bad link é", False, False, None)]),
        ("p", None, [("twice", False, False, "https://two.ae")]), ("p", None, [("first safe", False, False, "https://one.ae")]),
    ]
    assert got[1:] == [[], [], []] and got[0] == plainly(body)


def test_random_bodies(spark):
    rng = random.Random(2)
    words = ["a", " b ", "", "  ", "long word", "​", "é", "x\ty", "\x01\x02", None]
    child = lambda: (rng.choice(["span"] * 6 + ["image"]), rng.choice(words[:8] + [None]), rng.sample(["strong", "em", "k", "j", "z"], rng.randrange(3)))
    many = [
        [block(*[child() for _ in range(rng.randrange(12))], style=rng.choice(["normal", "h2", "h3", None]), item=rng.choice([None, "", "bullet", "number", "x"]), defs=[("k", "https://k.ae/"), ("j", rng.choice(["mailto:a@b.ae", "http://no"]))]) for _ in range(rng.randrange(8))]
        for _ in range(120)
    ]
    assert made(spark, many) == [plainly(body) for body in many]


def test_long_bodies(spark):
    body = [block(*[("span", f"w{i} ", ["strong"] if i % 3 else []) for i in range(4000)])] + [block(("span", str(i), [])) for i in range(4000)]
    assert made(spark, [body])[0] == plainly(body)


def test_employers_in_order_of_a_dictionary(spark):
    names = ["Zayed", "Émile", "emil", "Emirates", "a1", "عقار"]
    df = spark.createDataFrame([(f"id{i}", name, False, i) for i, name in enumerate(names)], "employer_id string, company string, featured boolean, ord int")
    assert [r.name for r in jobs.employers(df, 10).collect()] == ["a1", "emil", "Émile", "Emirates", "Zayed", "عقار"]
