from tidewell.operators import slots

GOOD = {"id": "acme", "title": "Acme", "url": "https://acme.ae/x", "image": "assets/sponsors/a.png", "colorFrom": "#137a72", "label": " Ad "}


def frame(spark, rows):
    return spark.createDataFrame(rows, "config int, slot string, at int, item map<string,string>")


def found(spark, rows):
    return sorted(tuple(r) for r in slots.faults(frame(spark, rows)).collect())


def test_each_fault_by_its_path(spark):
    rows = [
        (1, "gold", 0, GOOD), (1, "gold", 1, GOOD), (1, "gold", 2, {**GOOD, "id": "Bad id", "enabled": "false", "url": "http://off"}), (1, "gold", 3, None),
        (1, "gold", 4, {"id": "b", "headline": "x", "blurb": "y", "url": "https://u:p@x.ae", "image": "https://x.ae/a.svg?1", "colorFrom": "red", "label": "l" * 21}),
        (1, "banners", 0, GOOD), (1, "other", 0, GOOD), (1, "other", 1, GOOD),
        (2, "professionalServices", 0, {"id": "p", "title": "P", "website": "not a site"}), (2, "careerResources", 0, {"id": "c", "title": "C", "resourceType": "Song"}),
        (3, "founding", 0, {"id": "f", "title": "F"}), (3, "founding", 1, {"id": "g", "title": "G", "image": "assets/sponsors/../a.png"}),
    ]
    assert found(spark, rows) == sorted([
        (1, "gold", "[1].id", "taken"), (1, "gold", "[2].id", "malformed"), (1, "gold", "[3]", "no item"), (1, "gold", "[4].headline", "now called title"), (1, "gold", "[4].blurb", "not used here"),
        (1, "gold", "[4].url", "no safe link"), (1, "gold", "[4].image", "no safe image"), (1, "gold", "[4].colorFrom", "no colour"), (1, "gold", "[4].label", "too long"), (1, "gold", "[4].title", "missing"),
        (1, "banners", "", "now called gold"), (1, "other", "", "unknown slot"), (2, "professionalServices", "[0].website", "no name of a website"), (2, "careerResources", "[0].resourceType", "unknown kind"),
        (3, "founding", "", "2 items, room for 1"), (3, "founding", "[1].image", "no safe image"),
    ])


def test_only_configurations_without_a_fault_are_published(spark):
    rows = [(1, "gold", 0, GOOD), (1, "gold", 1, {**GOOD, "id": "off", "enabled": "false"}), (2, "gold", 0, GOOD), (2, "gold", 1, {"id": "x"}), (None, "platinum", 0, {"id": "n", "title": "N", "url": "#"})]
    got = {(r.config, r.id): r.fields for r in slots.published(frame(spark, rows)).collect()}
    assert got == {(1, "acme"): {"title": "Acme", "label": "Ad", "url": "https://acme.ae/x", "image": "assets/sponsors/a.png", "colorFrom": "#137A72"}, (None, "n"): {"title": "N"}}


def test_nulls_and_empty_tables(spark):
    assert found(spark, []) == [] and slots.published(frame(spark, [])).collect() == []
    odd = [(None, None, None, None), (1, "platinum", None, {"title": "t"}), (1, "platinum", None, {"title": "t"})]
    assert sorted(found(spark, [r for r in odd if r[1]])) == [(1, "platinum", "[?].id", "malformed")] * 2
    assert [tuple(r) for r in slots.faults(frame(spark, odd[:1])).collect()] == [(None, None, "", "unknown slot")]


def test_a_slot_with_very_many_items(spark):
    from pyspark.sql import functions as F

    many = spark.range(50_000).select(F.lit(1).alias("config"), F.lit("gold").alias("slot"), F.col("id").alias("at"), F.create_map(F.lit("id"), F.concat(F.lit("i"), (F.col("id") % 49_990).cast("string")), F.lit("title"), F.lit("t")).alias("item"))
    got = sorted((r.path, r.fault) for r in slots.faults(many).collect())
    assert got == sorted([("", "50000 items, room for 10")] + [(f"[{i}].id", "taken") for i in range(49_990, 50_000)])
