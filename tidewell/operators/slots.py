"""Lists of a configuration checked as a whole: every fault of every item by its path, copies and full groups among the same faults.

A configuration is given by item: (config, slot, at, item), item being a map of strings. A slot has a rule of its own; items are rows, so a configuration of any
size is spread over tasks, and only copies of an id and the room of a slot need a shuffle. Faults are rows (config, slot, path, fault): a path is
`[at].field`, `[at]` for an item as a whole and empty for the slot. A configuration is published if it has no fault; then its enabled items are, cleaned.

Defined results: a null item is a fault of its own and takes no part in the other checks; items that are switched off are checked for id and names of fields only; of
items with one id the first by `at` is well, of one `at` too the first by its fields; null ids are no copies. Empty tables give empty results. Lengths are code points.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import text as T

KEYS = ["config", "slot", "at"]
# How ids, colours, images kept in the site's own folder and names of websites look; fields and groups by their former names.
ID = "^[a-z0-9][a-z0-9-]{0,60}$"
COLOUR = "(?i)^#[0-9a-f]{6}$"
IMAGE = r"(?i)^assets/sponsors/[a-z0-9][a-z0-9._-]{0,120}\.(png|jpe?g|webp)$"
WEBSITE = r"(?i)^(?:www\.)?[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?(?:\.[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?)+$"
RENAMED_FIELDS = {"headline": "title", "name": "title", "tag": "label", "logo": "image", "thumbnail": "image", "logoBackground": "colorFrom"}
RENAMED_SLOTS = {"banners": "gold"}


@dataclass(frozen=True)
class Slot:
    """What a slot has room for, its text fields with their most characters, which it needs, images, colours, and kinds of resources."""

    most: int
    text: Mapping[str, int]
    images: tuple[str, ...] = ("image",)
    colours: tuple[str, ...] = ()
    kinds: tuple[str, ...] = ()
    required: tuple[str, ...] = ("title",)
    fields: frozenset[str] = field(init=False)

    def __post_init__(self):
        own = {"id", "enabled", "url", *self.text, *self.images, *self.colours} | ({"resourceType"} if self.kinds else set())
        object.__setattr__(self, "fields", frozenset(own))


_PAIR = ("colorFrom", "colorTo")
# The slots of the site.
SLOTS = {
    "founding": Slot(1, {"title": 60, "blurb": 140}),
    "platinum": Slot(5, {"title": 60}, colours=_PAIR),
    "gold": Slot(10, {"title": 70, "label": 20}, colours=_PAIR),
    "sponsoredPosts": Slot(20, {"title": 90, "blurb": 160, "logoText": 4}, colours=_PAIR),
    "sponsoredMedia": Slot(15, {"label": 20, "title": 90, "blurb": 160}),
    "professionalServices": Slot(20, {"title": 70, "website": 80, "logoText": 4}, colours=_PAIR),
    "eliteExclusive": Slot(1, {"title": 60, "blurb": 140, "label": 24}),
    "careerResources": Slot(12, {"title": 70, "logoText": 5}, images=(), colours=_PAIR, kinds=("Article", "Guide", "Career tip", "External link")),
}


def _by_slot(slots: Mapping[str, Slot], of) -> Column:
    """A value for the row's slot, null if it has none."""
    known = {name: of(slot) for name, slot in slots.items()}
    return F.coalesce(*[F.when(F.col("slot") == name, value) for name, value in known.items() if value is not None], F.lit(None))


def link_ok(url: Column) -> Column:
    """No link yet, or one by https without a user's name."""
    return F.coalesce(url, F.lit("")).isin("", "#") | url.rlike(r"(?i)^https://[^\s/?#@\\]+([/?#]\S*)?$")


def image_ok(image: Column) -> Column:
    """No image, one of the site's own, or one by https that is no drawing with scripts."""
    own = image.rlike(IMAGE) & ~image.contains("..")
    far = image.rlike(r"""(?i)^https://[^\s"'<>()\\]+$""") & ~image.rlike(r"(?i)\.svg(\?|#|$)")
    return (F.coalesce(image, F.lit("")) == "") | own | far


def _faults(slots: Mapping[str, Slot]) -> tuple[dict[str, Column], list[Column]]:
    """Cleaned texts by field, and of a named item each fault as struct(path, fault), with null for what is well."""
    item, on = F.col("item"), F.coalesce(F.lower(F.col("item")["enabled"]) != "false", F.lit(True))
    texts = sorted({f for s in slots.values() for f in s.text})
    clean = {f"_t_{f}": T.clean(F.coalesce(item[f], F.lit(""))) for f in texts}
    fault = lambda path, name, bad: F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(path).alias("path"), F.lit(name).alias("fault")))
    found = [fault("id", "malformed", ~F.coalesce(item["id"].rlike(ID), F.lit(False))), fault("id", "taken", F.col("_nth") > 1)]
    for f in texts:
        found.append(fault(f, "too long", on & (F.length(f"_t_{f}") > _by_slot(slots, lambda s, f=f: F.lit(s.text[f]) if f in s.text else None))))
        needs = [name for name, s in slots.items() if f in s.required]
        found.append(fault(f, "missing", on & F.col("slot").isin(needs) & (F.col(f"_t_{f}") == "")))
    sites = [name for name, s in slots.items() if "website" in s.text]
    found.append(fault("website", "no name of a website", on & F.col("slot").isin(sites) & (F.col("_t_website") != "") & ~F.col("_t_website").rlike(WEBSITE)))
    kinds = _by_slot(slots, lambda s: F.array(*map(F.lit, s.kinds)) if s.kinds else None)
    found.append(fault("resourceType", "unknown kind", on & item["resourceType"].isNotNull() & ~F.array_contains(kinds, item["resourceType"])))
    found.append(fault("url", "no safe link", on & ~link_ok(item["url"])))
    for f in sorted({f for s in slots.values() for f in s.images}):
        found.append(fault(f, "no safe image", on & F.col("slot").isin([n for n, s in slots.items() if f in s.images]) & ~image_ok(item[f])))
    for f in sorted({f for s in slots.values() for f in s.colours}):
        found.append(fault(f, "no colour", on & F.col("slot").isin([n for n, s in slots.items() if f in s.colours]) & (item[f] != "") & ~item[f].rlike(COLOUR)))
    return clean, found


def faults(items: DataFrame, slots: Mapping[str, Slot] = SLOTS) -> DataFrame:
    """config, slot, path, fault: all that is wrong with the items; see the module."""
    rows = items.select(*KEYS, F.col("item").cast("map<string,string>").alias("item"))
    unknown = rows.filter(~F.coalesce(F.col("slot").isin(list(slots)), F.lit(False))).groupBy("config", "slot").agg(F.lit("").alias("path"))
    former = F.col("slot").isin(list(RENAMED_SLOTS))
    whole = unknown.withColumn("fault", F.when(former, F.concat(F.lit("now called "), F.create_map(*[F.lit(x) for kv in RENAMED_SLOTS.items() for x in kv])[F.col("slot")])).otherwise("unknown slot"))
    known = rows.filter(F.col("slot").isin(list(slots)))
    at = F.concat(F.lit("["), F.coalesce(F.col("at").cast("string"), F.lit("?")), F.lit("]"))
    none = known.filter("item is null").select("config", "slot", at.alias("path"), F.lit("no item").alias("fault"))
    some = known.filter("item is not null")
    # only ids that stand more than once are ranked, and no list is held by more than its id's rows
    order = Window.partitionBy("config", "slot", "_id").orderBy("at", F.to_json(F.array_sort(F.map_entries("item"))))
    named = some.withColumn("_id", F.coalesce(F.col("item")["id"], F.concat(F.lit("\n"), F.monotonically_increasing_id().cast("string"))))
    ranked = named.withColumn("_nth", F.when(F.col("item")["id"].isNotNull(), F.row_number().over(order)).otherwise(1))
    clean, checks = _faults(slots)
    allowed = _by_slot(slots, lambda s: F.array(*[F.lit(f) for f in sorted(s.fields)]))
    now = F.create_map(*[F.lit(x) for kv in RENAMED_FIELDS.items() for x in kv])
    strange = F.transform(
        F.filter(F.map_keys("item"), lambda k: ~F.array_contains(F.col("_allowed"), k)),
        lambda k: F.struct(k.alias("path"), F.when(F.array_contains(F.col("_allowed"), now[k]), F.concat(F.lit("now called "), now[k])).otherwise("not used here").alias("fault")),
    )
    checked = ranked.withColumns(clean).withColumn("_allowed", allowed)
    each = checked.select("config", "slot", "at", F.explode(F.concat(strange, F.array_compact(F.array(*checks)))).alias("_f"))
    of_items = each.select("config", "slot", F.concat(at, F.lit("."), F.col("_f.path")).alias("path"), F.col("_f.fault").alias("fault"))
    enabled = F.coalesce(F.lower(F.col("item")["enabled"]) != "false", F.lit(True))
    room = some.filter(enabled).groupBy("config", "slot").agg(F.count("*").alias("_n")).filter(F.col("_n") > _by_slot(slots, lambda s: F.lit(s.most)))
    full = room.select("config", "slot", F.lit("").alias("path"), F.concat(F.col("_n").cast("string"), F.lit(" items, room for "), _by_slot(slots, lambda s: F.lit(str(s.most)))).alias("fault"))
    return whole.select("config", "slot", "path", "fault").unionByName(none).unionByName(of_items).unionByName(full)


def published(items: DataFrame, slots: Mapping[str, Slot] = SLOTS) -> DataFrame:
    """config, slot, at, id, fields (map of what is shown: cleaned texts, links, images, colours in capitals): enabled items of configurations without a fault."""
    bad = faults(items, slots).select(F.col("config").alias("_config")).distinct()
    rows = items.select(*KEYS, F.col("item").cast("map<string,string>").alias("item")).filter("item is not null")
    well = rows.join(bad, F.col("config").eqNullSafe(F.col("_config")), "left_anti").filter(F.coalesce(F.lower(F.col("item")["enabled"]) != "false", F.lit(True)))
    item = F.col("item")
    texts, colours = sorted({f for s in slots.values() for f in s.text}), sorted({f for s in slots.values() for f in s.colours})
    shown = {f: T.clean(item[f]) for f in texts} | {f: F.upper(item[f]) for f in colours} | {"image": item["image"], "url": F.nullif(item["url"], F.lit("#")), "resourceType": item["resourceType"]}
    entries = F.array(*[F.struct(F.lit(f).alias("key"), F.nullif(c, F.lit("")).alias("value")) for f, c in shown.items()])
    return well.select(*KEYS, item["id"].alias("id"), F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull())).alias("fields"))
