"""Session settings, table access and lineage cuts that every part of the engine shares."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
from pathlib import Path
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parent.parent)

#: Settings a session of this engine is meant to run under.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build(app: str = "tidewell", master: str | None = None, **more: str) -> SparkSession:
    """A session with SETTINGS; `more` adds to them (dots written as two underscores)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | {k.replace("__", "."): v for k, v in more.items()}).items():
        builder = builder.config(key, value)
    return ship(builder.getOrCreate())


#: Rows that Spark hands a Python worker at a time, unless the session says otherwise: texts may be long.
ARROW_ROWS = "256"


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, wherever the driver was started, and keep their batches small."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    env = spark.sparkContext.environment
    path = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if ROOT not in path.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (path, ROOT) if x)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, by Spark's own reader (the path may be in any store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a small table whose rows ask for much work, one task's share.
SHARE = 10_000


def spread(df: DataFrame) -> DataFrame:
    """The rows of a table in tasks of SHARE rows or so: a file of few bytes would be one task, however much each row asks for. The count is that of the files' footers."""
    return df.repartition(max(1, -(-df.count() // SHARE)))


def held(df: DataFrame, value: Column, name: str) -> DataFrame:
    """df with a value as a column that the optimizer takes as given: it is worked out once, and no filter on it is written out into what it is made of."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir. Only a session in one process may do without: it gets a temporary folder."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="tidewell-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet; it is deleted when the driver ends."""
    path = f"{shared_dir(spark)}/tidewell-{uuid.uuid4().hex[:16]}/{name}"
    atexit.register(delete, spark, path.rpartition("/")[0])
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store; a store or session that is gone already is no error."""
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  at exit the JVM may be gone
        pass


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _written[out] = path
    return out


#: Where the frames lie that materialise has written.
_written: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def discard(*frames: DataFrame) -> None:
    """Delete what materialise wrote for these frames; nothing that reads them may run afterwards. Other frames are left alone."""
    for df in frames:
        if path := _written.pop(df, None):
            delete(df.sparkSession, path.rpartition("/")[0])
