"""Structured Streaming: continuous ingestion and session windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..service.segments import Segments


def files(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of (path, content) of files as they arrive."""
    return spark.readStream.text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def append_new(stream: DataFrame, target: str, checkpoint: str, key: str = "path"):
    """Write rows whose key the Parquet table at `target` lacks, once each."""
    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        rows = batch.dropDuplicates([key])
        try:
            rows = rows.join(spark.read.parquet(target).select(key), key, "left_anti")
        except Exception as e:  # the table is not there yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
        rows.write.mode("append").parquet(target)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each user; on a stream, events later than the watermark are
    dropped.  Watermarks need times with a zone, so others take the session's."""
    kind, df = dict(events.dtypes)["ts"], events
    if events.isStreaming:
        df = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return df.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events")).select("user_id", F.col("w.start").cast(kind).alias("start"), F.col("w.end").cast(kind).alias("end"), "events")


def append_sessions(stream: DataFrame, target: str, checkpoint: str, gap: str = "30 minutes", late: str = "1 hour"):
    """Write the sessions of a stream of events (user_id, ts) as they close, that
    is, when the watermark (latest time so far less `late`) is past their end.
    Open sessions are state, kept in the checkpoint over restarts.  An event
    whose own session would have closed before the batch began is dropped."""
    return sessions(stream, gap, late).writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target, format="parquet")


STATISTICS = {"df": "token string, df long", "size": "docs long, length long"}


def corpus_statistics(stream: DataFrame, target: str, checkpoint: str):
    """Document frequencies and lengths of a stream of (id, content), added up
    batch by batch.  A batch's counts come into `target` in one version of its
    manifest under the batch's number, so one that runs again after a loss adds
    nothing; counts of several batches are summed as they gather, so a read
    meets a few files.  A target belongs to one stream."""
    def write(batch: DataFrame, number: int) -> None:
        held = Segments(batch.sparkSession, target, STATISTICS)
        words = batch.select("id", tokens(F.col("content")).alias("t")).where("t IS NOT NULL")
        df = words.select(F.explode(F.array_distinct("t")).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
        size = words.agg(F.count("*").alias("docs"), F.coalesce(F.sum(F.size("t")), F.lit(0)).cast("long").alias("length"))
        held.put({"df": df, "size": size}, batch=number)
        held.merge("df", lambda d: d.groupBy("token").agg(F.sum("df").alias("df")))
        held.merge("size", lambda d: d.agg(F.sum("docs").alias("docs"), F.sum("length").alias("length")))

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_statistics(spark: SparkSession, target: str) -> tuple[DataFrame, DataFrame]:
    """(token, df) and one row (docs, mean length) over all batches."""
    held = Segments(spark, target, STATISTICS)
    df = held.read("df").groupBy("token").agg(F.sum("df").alias("df"))
    return df, held.read("size").agg(F.sum("docs").alias("docs"), F.try_divide(F.sum("length"), F.sum("docs")).alias("mean"))
