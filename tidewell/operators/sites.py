"""Pages published in one step: only changed ones are written, stale ones go, and readers see a version whole or the one before.

A version is a folder v-N: `pages` holds the bodies that changed, `manifest` names every page of the site, its SHA-256 and the version whose folder holds it. The
manifest is written last, and a version counts once Spark has marked its manifest as whole. So a job that fails leaves readers where they were, and its folder is
written anew by the next try. Unchanged pages are never written again, until more than MOST folders would be read: then all go into one.

Defined results: a null body is empty; pages without a path are no pages; of several pages with one path the first by `rank`, then by body, counts. A page that the site
didn't generate itself is only replaced by a page of its path, never removed. An empty run removes all generated pages. Columns besides the named ones are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "path string, sha256 string, generated boolean, version long"
BODIES = "path string, body string"
#: Most folders of bodies that a version's pages may lie in.
MOST = 20


def changes(held: DataFrame, pages: DataFrame) -> DataFrame:
    """path, action, sha256, body of held pages (path, sha256, generated) and new ones (path, body, rank).

    action: write (new or changed), keep, remove (generated, and no page any more), leave (not generated). body is there for pages to write or keep.
    """
    body = F.coalesce("body", F.lit(""))
    # the first of a path is kept by tasks before the shuffle
    first = pages.filter("path is not null").groupBy("path").agg(F.min(F.struct("rank", body.alias("body"))).alias("_p"))
    new = first.select("path", F.col("_p.body").alias("body"), F.sha2(F.encode("_p.body", "UTF-8"), 256).alias("_new"))
    both = held.select("path", F.col("sha256").alias("_old"), F.coalesce("generated", F.lit(False)).alias("_own")).join(new, "path", "full_outer")
    gone = F.when(F.col("_own"), "remove").otherwise("leave")
    action = F.when(F.col("_new").isNull(), gone).when(F.col("_new").eqNullSafe(F.col("_old")), "keep").otherwise("write")
    return both.select("path", action.alias("action"), F.coalesce("_new", "_old").alias("sha256"), "body")


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, root: str) -> list[int]:
    """The versions that are whole, oldest first."""
    return [n for n in _folders(spark, root) if (at := _fs(spark, f"{root}/v-{n}/manifest/_SUCCESS"))[0].exists(at[1])]


def _folders(spark: SparkSession, root: str) -> list[int]:
    fs, at = _fs(spark, root)
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n.removeprefix("v-")) for n in names if n.startswith("v-"))


def manifest(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The pages of a version, of the newest if none is named; none before the first."""
    done = versions(spark, root)
    if not done:
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(f"{root}/v-{done[-1] if version is None else version}/manifest")


def _used(of: DataFrame) -> list[int]:
    """The versions whose folders a manifest reads: MOST + 1 at most."""
    return sorted(r[0] for r in of.select("version").distinct().collect())


def current(spark: SparkSession, root: str) -> DataFrame:
    """path and body of every page of the newest version."""
    of = manifest(spark, root)
    found = spark.createDataFrame([], f"{BODIES}, version long")
    for version in _used(of):
        found = found.unionByName(spark.read.schema(BODIES).parquet(f"{root}/v-{version}/pages").withColumn("version", F.lit(version).cast("long")))
    return of.select("path", "version").join(found, ["path", "version"]).select("path", "body")


def publish(pages: DataFrame, root: str, version: int, most: int = MOST, generated: bool = True) -> dict[str, int] | None:
    """Publish pages (path, body, rank) as a version; how many were written, kept, removed and left. None if that version or a later one is whole already.

    The last two versions stay, for readers that are at work, with the folders that they read; `generated` says whether the pages may be removed by later runs.
    """
    spark = pages.sparkSession
    done = versions(spark, root)
    if done and version <= done[-1]:
        return None
    held = manifest(spark, root)
    at, staged = f"{root}/v-{version}", f"{root}/v-{version}/staged"
    # pages are read once: bodies of the run are laid down with what becomes of them
    changes(held, pages).write.mode("overwrite").parquet(staged)
    found = spark.read.parquet(staged)
    used = _used(held.join(found.filter("action in ('keep', 'leave')").select("path"), "path", "left_semi"))
    whole = len(used) >= most
    fresh = found.filter("action = 'write'" if not whole else "action in ('write', 'keep')").select("path", F.coalesce("body", F.lit("")).alias("body"))
    if whole:
        fresh = fresh.unionByName(current(spark, root).join(found.filter("action = 'leave'").select("path"), "path", "left_semi"))
    fresh.write.mode("overwrite").parquet(f"{at}/pages")
    before = held.select("path", F.col("version").alias("_v"), F.col("generated").alias("_g"))
    moved = (F.col("action") == "write") | F.lit(whole)
    own = F.when(F.col("action") == "leave", F.col("_g")).otherwise(F.lit(generated))
    listed = found.filter("action <> 'remove'").join(before, "path", "left")
    listed.select("path", "sha256", own.alias("generated"), F.when(moved, F.lit(version)).otherwise(F.col("_v")).cast("long").alias("version")).write.mode("overwrite").parquet(f"{at}/manifest")
    counts = {a: 0 for a in ("write", "keep", "remove", "leave")} | {r.action: r["count"] for r in found.groupBy("action").count().collect()}
    _clear(spark, staged)
    needed = {version, *done[-1:], *_used(manifest(spark, root, version)), *(_used(held) if done else [])}
    for old in _folders(spark, root):
        if old not in needed and old < version:
            _clear(spark, f"{root}/v-{old}")
        elif old in done[:-1]:
            _clear(spark, f"{root}/v-{old}/manifest")
    return counts


def _clear(spark: SparkSession, path: str) -> None:
    fs, at = _fs(spark, path)
    fs.delete(at, True)
