"""Context layers as text: identity, essential story, retrieval, search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.text import snippet
from . import fts
from .store import recent

EMPTY = "(Store is empty. Mine a folder to index your files.)"
RULE = "\n\n---\n\n"


def identity(text: str | None) -> str:
    return "[L0 IDENTITY]\n" + (text if text is not None else "(No identity file found.)")


def story(chunks: DataFrame, domain: str | None = None, most: int = C.LAYER_CHARS, n: int = C.LAYER_CHUNKS) -> DataFrame:
    """One row `text`: of the newest n chunks at most two snippets a topic, larger
    topics first, under a heading each, until `most` characters are reached."""
    newest = recent(chunks, n, domain).select(F.lower("topic").alias("key"), "topic", "content", "filed_at", "id")
    # at most n rows from here on
    item = F.struct("filed_at", F.col("id"), snippet(F.col("content")).alias("line"), "topic")
    newest_first = F.reverse(F.array_sort(F.collect_list(item)))
    groups = newest.groupBy("key").agg(newest_first.alias("items")).select(F.struct(F.size("items").alias("size"), F.get("items", F.lit(0))["filed_at"].alias("at"), F.col("key"), F.col("items")).alias("g"))
    ordered = groups.agg(F.reverse(F.array_sort(F.collect_list("g"))).alias("gs"))

    def group(acc, g):
        title = F.concat(F.lit("\n## "), F.get(g["items"], F.lit(0))["topic"], F.lit("\n"))
        headed = F.when(F.length(acc) >= most, acc).otherwise(F.concat(acc, title))
        return F.aggregate(F.slice(g["items"], 1, 2), headed, lambda a, x: F.when(F.length(a) >= most, a).otherwise(F.concat(a, x["line"], F.lit("\n"))))

    head = F.lit("[L1 ESSENTIAL STORY]\n")
    return ordered.select(F.when(F.size("gs") == 0, F.concat(head, F.lit(EMPTY))).otherwise(F.substring(F.aggregate("gs", head, group), 1, most)).alias("text"))


def _lines(rows: DataFrame, line, order, head: str, none: str) -> DataFrame:
    """One row `text` of a frame whose rows a limit bounds."""
    ordered = F.array_sort(F.collect_list(F.struct(*order, line.alias("line"))))
    return rows.agg(F.transform(ordered, lambda x: x["line"]).alias("x")).select(F.when(F.size("x") == 0, F.lit(head + none)).otherwise(F.concat(F.lit(head), F.array_join("x", "\n"), F.lit("\n"))).alias("text"))


def on_demand(chunks: DataFrame, domain: str | None = None, topic: str | None = None, n: int = 10) -> DataFrame:
    df = chunks if topic is None else chunks.where(F.col("topic") == topic)
    d, t = domain or "*", topic or "*"
    rows = recent(df, n, domain)
    age = F.row_number().over(Window.orderBy(F.desc("filed_at"), "id"))  # at most n rows
    return _lines(rows.withColumn("_age", age), snippet(F.col("content")), ["_age"], f"[L2 ON-DEMAND: {d}/{t}]\n", f"(No chunks found for domain={d}, topic={t}.)")


def deep_search(chunks: DataFrame, query: str, domain: str | None = None, topic: str | None = None, n: int = 5) -> DataFrame:
    spark = chunks.sparkSession
    asked = spark.createDataFrame([(0, query)], "query_id long, query string")
    hits = fts.hydrate(fts.search(chunks, asked, n, domain, topic), chunks)
    line = F.concat(F.lit("["), "domain", F.lit("/"), "topic", F.lit("] "), "snippet")
    return _lines(hits, line, ["rank"], f"[L3 DEEP SEARCH: {query}]\n", f"(No results found for query: {query})")


def wake_up(chunks: DataFrame, who: str | None = None, domain: str | None = None) -> str:
    parts = [identity(who), story(chunks, domain).first().text]
    if domain is not None:
        parts.append(on_demand(chunks, domain).first().text)
    return RULE.join(parts)


