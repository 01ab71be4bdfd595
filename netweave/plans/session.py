"""Session-level helpers: the shared scratch folder and materialised intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_CONF = "spark.checkpoint.dir"


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Only where the session names none (local runs, tests) a folder of this machine is chosen and set.
    """
    root = spark.conf.get(_CONF, None) or spark.sparkContext.getConf().get(_CONF, None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"set {_CONF} to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="netweave-")
        spark.conf.set(_CONF, root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str = "t") -> str:
    """A fresh path below the shared folder. ``release`` removes all paths of the session."""
    return f"{scratch_root(spark)}/netweave-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back.

    Cuts the lineage and survives lost executors: the files stand outside them, and the write itself is
    committed task by task, so a retried task leaves no second copy.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._scratch = path
    return back


def discard(df: DataFrame) -> None:
    """Delete the table that ``materialise`` wrote for ``df``; nothing must read it any more."""
    path = getattr(df, "_scratch", None)
    if path:
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Growing:
    """A table that a loop appends small written tables to: their union, written together every ``every`` appends."""

    def __init__(self, df: DataFrame, every: int = 12):
        self.df, self.every, self.parts = df, every, 0

    def add(self, part: DataFrame) -> None:
        self.df, self.parts = self.df.unionByName(part), self.parts + 1
        if self.parts % self.every == 0:
            self.df = materialise(self.df, "growing")


def release(spark: SparkSession) -> None:
    """Delete every scratch path of this session; results that still read them must be consumed before."""
    root = f"{scratch_root(spark)}/netweave-{spark.sparkContext.applicationId}"
    _delete(spark, root)


def ship(spark: SparkSession) -> None:
    """Let Python workers find this package where they run on a machine that holds it at the driver's path.

    A cluster whose machines don't is given the package by ``--py-files``.
    """
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
