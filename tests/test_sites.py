from tidewell.operators import sites


def pages(spark, rows):
    return spark.createDataFrame([(*r, 0) if len(r) == 2 else r for r in rows], "path string, body string, rank int")


def now(spark, root):
    return {r.path: r.body for r in sites.current(spark, root).collect()}


def test_only_changes_are_written_and_stale_pages_go(spark, tmp_path):
    root = str(tmp_path / "site")
    assert now(spark, root) == {}
    assert sites.publish(pages(spark, [("about", "by hand")]), root, 1, generated=False) == {"write": 1, "keep": 0, "remove": 0, "leave": 0}
    assert sites.publish(pages(spark, [("a", "1"), ("b", "2"), ("c", None), (None, "x")]), root, 2) == {"write": 3, "keep": 0, "remove": 0, "leave": 1}
    assert sites.publish(pages(spark, [("a", "1"), ("b", "new"), ("d", "4"), ("d", "later", 1)]), root, 3) == {"write": 2, "keep": 1, "remove": 1, "leave": 1}
    assert now(spark, root) == {"about": "by hand", "a": "1", "b": "new", "d": "4"}
    assert {r.path for r in spark.read.parquet(f"{root}/v-3/pages").collect()} == {"b", "d"}
    assert sites.publish(pages(spark, []), root, 3) is None and sites.publish(pages(spark, []), root, 2) is None
    assert sites.publish(pages(spark, []), root, 4)["remove"] == 3 and now(spark, root) == {"about": "by hand"}
    assert sites.publish(pages(spark, [("about", "generated")]), root, 5)["write"] == 1
    assert sites.publish(pages(spark, []), root, 6) == {"write": 0, "keep": 0, "remove": 1, "leave": 0} and now(spark, root) == {}


def test_a_version_that_failed_is_not_seen_and_is_made_again(spark, tmp_path):
    root = str(tmp_path / "site")
    sites.publish(pages(spark, [("a", "1")]), root, 1)
    pages(spark, [("a", "half")]).select("path", "body").write.parquet(f"{root}/v-2/pages")
    assert sites.versions(spark, root) == [1] and now(spark, root) == {"a": "1"}
    assert sites.publish(pages(spark, [("a", "2")]), root, 2)["write"] == 1 and now(spark, root) == {"a": "2"}


def test_folders_are_put_together_and_old_ones_go(spark, tmp_path):
    root, rows = str(tmp_path / "site"), []
    for n in range(1, 7):
        rows.append((f"p{n}", str(n)))
        sites.publish(pages(spark, rows), root, n, most=3)
        assert now(spark, root) == dict(rows)
        assert len(sites._used(sites.manifest(spark, root))) <= 4 and len(sites.versions(spark, root)) <= 2
    assert sites.versions(spark, root) == [5, 6] and min(sites._folders(spark, root)) > 1
