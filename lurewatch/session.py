"""Session and shared-folder helpers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(app: str = "lurewatch", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs expect. A cluster's own settings win: nothing here
    sizes executors, and shuffle partitions are left to adaptive execution."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for checkpoints and intermediate tables, inside the shared folder the cluster
    names in ``spark.checkpoint.dir``. Only a local session may fall back to its own disk."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        base = tempfile.mkdtemp(prefix="lurewatch-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def dealt(df):
    """The same rows dealt evenly over twice as many tasks as there are cores. For narrow rows that each
    cause much work: their few bytes would be read, or put together by adaptive execution, in a task or two."""
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism)


def checkpointed(df):
    """Cut lineage: the rows, computed once and written to the shared folder."""
    spark = df.sparkSession
    path = shared_folder(spark, "lineage")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
