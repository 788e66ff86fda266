"""Quality rules, weighted keyword rules and publication gates.

Rules are data; each becomes a literal expression, so that a table is read once and stays inside generated code: no join
of documents with rules, no explode.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import url as U
from tidewell.operators import classify


def _quoted(values: Sequence[str]) -> str:
    return "|".join("".join("\\" + c if c in r".*+?^${}()|[]\\" else c for c in v) for v in values)


@dataclass(frozen=True)
class Filter:
    """What marks an item as of some kind: how its title begins (before a separator) or what it contains, a part of its path, a category."""

    title_prefix: tuple[str, ...] = ()
    title_contains: tuple[str, ...] = ()
    url_segments: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()

    def matches(self, title: Column, url: Column, categories: Column | None = None) -> Column:
        found = F.lit(False)
        if self.title_prefix:
            found = found | title.rlike(rf"(?iu)^\s*({_quoted(self.title_prefix)})\s*[:|–—-]")
        if self.title_contains:
            found = found | title.rlike(f"(?iu)(^|[^a-z])({_quoted(self.title_contains)})([^a-z]|$)")
        if self.url_segments:
            found = found | F.arrays_overlap(U.segments(url), F.array(*map(F.lit, self.url_segments)))
        if self.categories and categories is not None:
            found = found | F.arrays_overlap(F.transform(categories, F.lower), F.array(*map(F.lit, self.categories)))
        return F.coalesce(found, F.lit(False))


@dataclass(frozen=True)
class QualityRules:
    min_title: int = 12
    max_age_days: int = 21
    advertorial: Filter = field(default_factory=Filter)
    non_article: Filter = field(default_factory=Filter)
    opinion: Filter | None = None
    press_release: Filter | None = None


def reject_reason(rules: QualityRules, title: Column, link: Column, published: Column | None = None, now: Column | None = None, categories: Column | None = None) -> Column:
    """The first rule that an item fails, in the rules' order; null if it passes all."""
    reason = F.when(title.isNull() | (F.length(title) < rules.min_title), "missing-title").when(link.isNull() | (link == ""), "missing-link").when(~U.is_http(link), "invalid-link")
    if published is not None:
        reason = reason.when(published < now - F.expr(f"interval {rules.max_age_days} days"), "too-old")
    for name, rule in (("advertorial", rules.advertorial), ("not-an-article", rules.non_article), ("opinion", rules.opinion), ("press-release", rules.press_release)):
        if rule is not None:
            reason = reason.when(rule.matches(title, link, categories), name)
    return reason


def group_scores(df: DataFrame, key: str, title: Column, body: Column, groups: Mapping[str, Mapping[str, int]]) -> DataFrame:
    """key, group_id, ord (place in the rules), score of every group with a positive score; terms of one document in one pass."""
    read, parts = classify.read_parts(df.select(key, title.alias("_title"), body.alias("_body")), F.col("_title"), F.col("_body"), [t for g in groups.values() for t in g])
    rows = [F.struct(F.lit(g).alias("group_id"), F.lit(i).alias("ord"), parts.score(t).alias("score")) for i, (g, t) in enumerate(groups.items())]
    return read.select(key, F.inline(F.array(*rows))).filter("score > 0")


def top_groups(scores: DataFrame, key: str, n: int, least: int = 1) -> DataFrame:
    """The n best groups of each document; ties keep the rules' order."""
    w = Window.partitionBy(key).orderBy(F.desc("score"), "ord")
    return scores.filter(F.col("score") >= least).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def confidence(top: Column) -> Column:
    """min(1, top / 6), to two places with halves up."""
    return F.floor(F.least(F.lit(1.0), top / 6.0) * 100 + 0.5) / 100


def hold_reasons(checks: Mapping[str, Column]) -> Column:
    """All checks that an item fails, in order; an item is public if there are none. A check that is null fails."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]))
