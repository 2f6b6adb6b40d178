"""The session that the engine expects: UTC, adaptive execution, ANSI errors; and the folder that its jobs share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, name: str = "factloom", **conf: str) -> SparkSession:
    b = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.ansi.enabled", "true")
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only where that is unset and everything runs in this one
    process (a local master) a temporary one is made up."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        made = tempfile.mkdtemp(prefix="factloom-")
        atexit.register(shutil.rmtree, made, True)
        path = f"file://{made}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def shared(spark: SparkSession) -> str:
    """A new folder below the shared one."""
    return f"{folder(spark)}/factloom-core/{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows stored as Parquet in the shared folder and read again: after a lost executor, files are reread, nothing is recomputed."""
    path = f"{shared(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
