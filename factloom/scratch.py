"""Shared scratch tables: how plans are cut without machine-local state.

Intermediate results that are read more than once, or whose lineage must be
cut, are written as Parquet below the folder that ``spark.checkpoint.dir``
names. Every executor and the driver can read them, so a lost executor costs
only the tasks that it was running.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def root(spark: SparkSession) -> str:
    """The shared scratch folder of this session; set only where it is unset (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = held.get() if held.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="factloom-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def path(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the scratch root."""
    return f"{root(spark)}/factloom/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the scratch root and return a scan of it."""
    spark = df.sparkSession
    where = path(spark, name)
    df.write.parquet(where)
    out = spark.read.schema(df.schema).parquet(where)
    out._scratch = where
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the folders of frames that ``materialise`` returned; nothing may read them any more."""
    for df in frames:
        if where := getattr(df, "_scratch", None):
            hadoop = df.sparkSession._jvm.org.apache.hadoop.fs.Path(where)
            hadoop.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(hadoop, True)


class Grown:
    """A table that only grows: each addition is a folder of its own, so a round of a loop writes its new rows alone."""

    def __init__(self, first: DataFrame, name: str):
        self.spark, self.schema, self.name, self.paths = first.sparkSession, first.schema, name, []
        self.add(first)

    def add(self, rows: DataFrame) -> DataFrame:
        """Write ``rows`` and return a scan of them alone."""
        out = materialise(rows.select(*self.schema.names), self.name)
        self.paths.append(out._scratch)
        return out

    @property
    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*self.paths)
