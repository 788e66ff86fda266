"""Articles by weighted terms: topics, region score and relevance; kinds of capital, asset, place and deal.

A text is cut into words once and only the words that some term may be are kept, so that each term is a look-up in a short array;
terms of several words are searched for in the text, where their first word stands in it.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions import text as T

Groups = Mapping[str, Mapping[str, int]]
#: Score from which a group is assigned, groups of a dimension, score of full confidence, confidence below which an editor is asked, longest explanation.
ASSIGN_AT, MOST, CONFIDENT_AT, REVIEW_BELOW, EXPLANATION = 3, 4, 6, 0.4, 500
FALLBACK = "general-investment"


def forms(term: str) -> list[str]:
    """What the first word of a term may look like in a text."""
    first, *rest = re.findall("[a-z0-9]+", term.lower()) or [""]
    return [first] if rest else [first, first + "s", first + "es"]


def found_words(text: Column, terms: Sequence[str]) -> Column:
    """The words of a text that terms may begin with, each once."""
    wanted = sorted({f for t in terms for f in forms(t)} - {""})
    if not wanted:
        return F.array().cast("array<string>")
    return F.array_intersect(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), F.array(*map(F.lit, wanted)))


def has(words: Column, text: Column, term: str) -> Column:
    """Whether a lower-cased text, whose found words are given, has a term as whole words, with or without -s or -es. Terms of other scripts are searched for in the text."""
    if not re.search("[a-z0-9]", term.lower()):
        return T.has_term(text, term)
    near = F.arrays_overlap(words, F.array(*map(F.lit, forms(term))))
    return near if re.fullmatch("[a-z0-9]+", term.lower()) else near & T.has_term(text, term)


@dataclass(frozen=True)
class Parts:
    """A title and a body in lower case, with their found words."""

    title: Column
    body: Column
    title_words: Column
    body_words: Column

    def score(self, terms: Mapping[str, int]) -> Column:
        """Twice the weight of terms in the title, once of others in the body; each counts once."""
        each = [F.when(has(self.title_words, self.title, t), 2 * w).when(has(self.body_words, self.body, t), w).otherwise(0) for t, w in terms.items()]
        return sum(each[1:], each[0]) if each else F.lit(0)

    def hits(self, terms: Sequence[str]) -> Column:
        """The terms that stand in title or body, in their order."""
        found = [F.when(has(self.title_words, self.title, t) | has(self.body_words, self.body, t), F.lit(t)) for t in terms]
        return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")

    def ranked(self, groups: Groups, least: int) -> Column:
        """Structs (neg, ord, id, score, hits) of groups that score so much, best first; ties keep the rules' order."""
        each = [F.struct((-self.score(t)).alias("neg"), F.lit(i).alias("ord"), F.lit(g).alias("id"), self.score(t).alias("score"), self.hits(list(t)).alias("hits")) for i, (g, t) in enumerate(groups.items())]
        every = F.array(*each) if each else F.array().cast("array<struct<neg:int,ord:int,id:string,score:int,hits:array<string>>>")
        return F.array_sort(F.filter(every, lambda s: s["score"] >= least))


def read_parts(df: DataFrame, title: Column, body: Column, terms: Sequence[str], prefix: str = "_") -> tuple[DataFrame, Parts]:
    """df with the columns that Parts needs, and the Parts."""
    named = df.withColumns({f"{prefix}t": F.lower(F.coalesce(title, F.lit(""))), f"{prefix}b": F.lower(F.coalesce(body, F.lit("")))})
    named = named.withColumns({f"{prefix}tw": found_words(F.col(f"{prefix}t"), terms), f"{prefix}bw": found_words(F.col(f"{prefix}b"), terms)})
    return named, Parts(*(F.col(f"{prefix}{x}") for x in ("t", "b", "tw", "bw")))


@dataclass(frozen=True)
class ArticleRules:
    topics: Groups
    generic: Mapping[str, int] = field(default_factory=dict)
    negative: Mapping[str, int] = field(default_factory=dict)
    uae: tuple[str, ...] = ()
    uae_threshold: int = 3


def classify_articles(df: DataFrame, rules: ArticleRules, title: Column, body: Column, region: Column) -> DataFrame:
    """df with category, uae_score, topic, topics (three best), relevance and hits."""
    terms = [*rules.uae, *rules.generic, *rules.negative, *(t for g in rules.topics.values() for t in g)]
    named, p = read_parts(df, title, body, terms)
    uae = F.when(region == "uae", 1).otherwise(0)
    for term in rules.uae:
        uae = uae + F.when(has(p.title_words, p.title, term), 3).when(has(p.body_words, p.body, term), 1).otherwise(0)
    scored = named.withColumns({"uae_score": uae, "_ranked": p.ranked(rules.topics, 1), "_rest": p.score(rules.generic) + p.score(rules.negative)})
    ids = F.transform("_ranked", lambda s: s["id"])
    hits = F.concat(p.hits(rules.uae), F.flatten(F.transform("_ranked", lambda s: s["hits"])), p.hits(list(rules.generic)), p.hits(list(rules.negative)))
    out = scored.withColumns({
        "category": F.when(F.col("uae_score") >= rules.uae_threshold, "uae").otherwise("world"), "topic": F.coalesce(F.get(ids, F.lit(0)), F.lit(FALLBACK)), "topics": F.slice(ids, 1, 3),
        "relevance": F.aggregate("_ranked", F.lit(0), lambda a, s: a + s["score"]) + F.col("_rest"), "hits": hits,
    })
    return out.drop("_t", "_b", "_tw", "_bw", "_ranked", "_rest")


def relevant(relevance: Column, focus: Column, focused: int = 1, other: int = 3) -> Column:
    """Whether an article is relevant enough: sources on private markets need less."""
    return relevance >= F.when(focus == "private-markets", focused).otherwise(other)


@dataclass(frozen=True)
class Taxonomy:
    capital: Groups
    asset: Groups
    geography: Groups
    transaction: Groups


def _meet(phrases: Sequence[str]) -> bool:
    """Whether one phrase may begin in another's last words, so that it matters which is read first."""
    words = [p.split() for p in phrases]
    same = lambda a, b: a == b or a + "s" == b or a + "es" == b
    return any(all(map(same, x[i:], y)) for x in words for y in words for i in range(1, len(x)) if len(y) > len(x) - i)


def blanked(text: Column, phrases: Sequence[str]) -> Column:
    """A lower-cased text without phrases, longer ones first, so that they aren't read as shorter ones of another kind.

    One pass does where no two phrases can share words of a text; else each length has its own.
    """
    lower = sorted({p.lower() for p in phrases}, key=lambda p: (-len(p), p))
    passes = [[p for p in lower if len(p) == n] for n in sorted({len(p) for p in lower}, reverse=True)] if _meet(lower) else [lower] if lower else []
    for some in passes:
        text = F.regexp_replace(text, f"(^|[^a-z0-9])(?:{'|'.join(map(re.escape, some))})(?:s|es)?(?=$|[^a-z0-9])", "$1 ")
    return text


def _confidence(ranked: Column) -> Column:
    return F.least(F.lit(1.0), F.coalesce(F.get(ranked, F.lit(0))["score"], F.lit(0)) / CONFIDENT_AT)


def explain(label: str, ranked: Column) -> Column:
    """"Label: id (term, term); id (term)", empty without groups."""
    each = F.transform(ranked, lambda s: F.concat(s["id"], F.lit(" ("), F.array_join(s["hits"], ", "), F.lit(")")))
    return F.when(F.size(ranked) > 0, F.concat(F.lit(f"{label}: "), F.array_join(each, "; ")))


def round2(x: Column) -> Column:
    """To two places, halves up."""
    return F.floor(x * 100 + 0.5) / 100


def classify_taxonomy(df: DataFrame, rules: Taxonomy, title: Column, body: Column, uae: Column) -> DataFrame:
    """df with capital_types, asset_classes, geography, transaction_type, confidence, needs_review, explanation, priority."""
    phrases = [t for g in rules.capital.values() for t in g]
    plain = [*phrases, *(t for d in (rules.geography, rules.transaction) for g in d.values() for t in g)]
    named, p = read_parts(df, title, body, plain)
    named, q = read_parts(named, blanked(p.title, phrases), blanked(p.body, phrases), [t for g in rules.asset.values() for t in g], "_q")
    ranks = named.withColumns({
        "_capital": F.slice(p.ranked(rules.capital, ASSIGN_AT), 1, MOST), "_asset": F.slice(q.ranked(rules.asset, ASSIGN_AT), 1, MOST),
        "_places": F.transform(p.ranked(rules.geography, ASSIGN_AT), lambda s: s["id"]), "_deal": F.slice(p.ranked(rules.transaction, ASSIGN_AT), 1, 1),
    })
    ids = lambda c: F.transform(c, lambda s: s["id"])
    none = lambda c: F.size(c) == 0
    specific = F.array_remove("_places", "global")
    confidence = F.when(none("_capital") | none("_asset"), F.greatest(_confidence(F.col("_capital")), _confidence(F.col("_asset"))) * 0.6).otherwise(F.least(_confidence(F.col("_capital")), _confidence(F.col("_asset"))))
    out = ranks.withColumns({
        "capital_types": ids("_capital"), "asset_classes": ids("_asset"), "transaction_type": F.get(ids("_deal"), F.lit(0)),
        # "global" only where nothing more specific matched
        "geography": F.when(uae, F.array_prepend(specific, F.lit("uae"))).when(F.size(specific) > 0, specific).otherwise(F.col("_places")),
        "confidence": round2(confidence), "needs_review": (none("_capital") & none("_asset")) | (confidence < REVIEW_BELOW),
        "explanation": F.left(F.concat_ws(" | ", explain("Capital", F.col("_capital")), explain("Asset", F.col("_asset")), explain("Deal", F.col("_deal"))), F.lit(EXPLANATION)),
        "priority": F.when(none("_deal"), 0).otherwise(2) + F.when(none("_asset"), 0).otherwise(2) + F.when(none("_capital"), 0).otherwise(1),
    })
    return out.drop(*[f"_{x}" for x in ("t", "b", "tw", "bw", "qt", "qb", "qtw", "qbw", "capital", "asset", "places", "deal")])
