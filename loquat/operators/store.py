"""Chunk store: first write wins, tombstones, views, taxonomy, layers, log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import snippet
from .kg import first_of

CHUNKS = "id string, domain string, topic string, category string, source_file string, content string, chunk_index int, added_by string, filed_at string"


def new_chunks(store: DataFrame, batch: DataFrame, order: str = "filed_at") -> DataFrame:
    """Rows of the batch that the store lacks; the first of an id stays."""
    return first_of(batch, ["id"], order).join(store.select("id"), "id", "left_anti")


def not_mined(files: DataFrame, store: DataFrame, key: tuple[str, ...] = ("domain", "source_file")) -> DataFrame:
    return files.join(store.select(*key).distinct(), list(key), "left_anti")


def live(log: DataFrame, tombstones: DataFrame) -> DataFrame:
    return log.join(tombstones.select("id"), "id", "left_anti")


def latest_embeddings(log: DataFrame, chunks: DataFrame) -> DataFrame:
    """Latest vector of each existing chunk from (chunk_id, embedding, seq)."""
    last = log.groupBy("chunk_id").agg(F.max_by("embedding", "seq").alias("embedding"))
    return last.join(chunks.select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi")


def taxonomy(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("domain", "topic").agg(F.count("*").alias("chunks"))


def recent(chunks: DataFrame, n: int = 15, domain: str | None = None) -> DataFrame:
    df = chunks if domain is None else chunks.where(F.col("domain") == domain)
    return df.orderBy(F.desc("filed_at"), "id").limit(n)


def status(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    one = chunks.agg(F.count("*").alias("chunks"), F.countDistinct("domain").alias("domains"), F.countDistinct("topic").alias("topics"))
    two = embeddings.agg(F.count("*").alias("embeddings"))
    return one.crossJoin(two).withColumn("coverage", F.coalesce(F.try_divide(100.0 * F.col("embeddings"), F.col("chunks")), F.lit(0.0)))  # one row each


def essentials(chunks: DataFrame, n: int = 15, per_topic: int = 2, budget: int = 3200) -> DataFrame:
    """Lines of the context's first layer: of the newest n chunks at most two a
    topic, larger topics first, until the running length meets the budget."""
    top = recent(chunks, n).withColumn("key", F.lower("topic"))
    w = Window.partitionBy("key")
    top = top.withColumn("size", F.count("*").over(w)).withColumn("newest", F.max(F.struct("filed_at", "id")).over(w))
    top = top.withColumn("rank", F.row_number().over(w.orderBy(F.desc("filed_at"), "id"))).where(F.col("rank") <= per_topic)
    top = top.withColumn("line", F.concat(F.lit("- "), snippet(F.col("content"))))
    order = Window.orderBy(F.desc("size"), F.desc("newest"), "rank")  # at most n rows
    top = top.withColumn("place", F.row_number().over(order)).withColumn("used", F.sum(F.length("line") + 1).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return top.where(F.col("used") <= budget).select("place", "topic", "line")


def log_write(agent: str, entries: DataFrame, now: str) -> DataFrame:
    """entries (entry, topic) as chunks of the agent's log domain."""
    content = F.concat(F.lit(f"[{now}] ["), "topic", F.lit("]\n"), "entry")
    return entries.select(F.expr("uuid()").alias("id"), F.lit(f"log_{agent}").alias("domain"), F.lit("log").alias("topic"), F.lit("cat_log").alias("category"), F.lit("").alias("source_file"), content.alias("content"), F.lit(0).alias("chunk_index"), F.lit(agent).alias("added_by"), F.lit(now).alias("filed_at"))


def log_read(chunks: DataFrame, agent: str, n: int = 10, oldest: bool = False) -> DataFrame:
    """The newest n log entries, newest first (`oldest`: the first n instead)."""
    mine = chunks.where(F.col("domain") == f"log_{agent}")
    picked = mine.orderBy(F.asc("filed_at") if oldest else F.desc("filed_at"), "id").limit(n)
    return picked.orderBy(F.desc("filed_at"), "id")
