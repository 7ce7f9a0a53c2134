"""Frames written in the folder that all executors share, so that loops have
plans of constant size and a lost executor costs a read."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new folder under `spark.checkpoint.dir`; on one machine, where the
    session names none, a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix=f"loquat-{name}-")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write and read back: the lineage ends here."""
    path = folder(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def counted(df: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """Write and read back, with aggregates of the rows that the write itself takes."""
    seen = Observation()
    out = written(df.observe(seen, *[c.alias(k) for k, c in counts.items()]), name)
    return out, seen.get


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession, size: str = "4m") -> SparkSession:
    """Bound the batches that go to Python workers by bytes, as texts may be
    long, unless the session has a bound of its own."""
    if not spark._jsparkSession.sessionState().conf().contains(BATCH_BYTES):
        spark.conf.set(BATCH_BYTES, size)
    return spark


def filesystem(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def remove(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        fs, at = filesystem(spark, path)
        fs.delete(at, True)


def discard(*frames: DataFrame) -> None:
    """Delete what `written` wrote for frames that nothing reads any more."""
    for df in frames:
        if getattr(df, "written_to", None):
            remove(df.sparkSession, df.written_to)
