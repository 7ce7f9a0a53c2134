"""Retrieval evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import keyword_overlap, keywords, person_names, snippet
from . import fts, written


def rerank(found: DataFrame, penalise: bool = False) -> DataFrame:
    """(query_id, id, score, keywords, content): scores scaled by keyword overlap, ranked again."""
    overlap = 0.5 * keyword_overlap(F.col("keywords"), F.lower("content"))
    score = F.col("score") * (1 - overlap if penalise else 1 + overlap)
    out = found.withColumn("score", score)
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")))


def recall(found: DataFrame, relevant: DataFrame, k: int = 5) -> DataFrame:
    """Per category, and over all (category null): share of queries with a
    relevant id among their first k.  relevant: (query_id, category, id)."""
    hit = relevant.join(found.where(F.col("rank") <= k).select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    per = hit.groupBy("query_id", "category").agg(F.coalesce(F.max("hit"), F.lit(0)).alias("hit"))
    return per.rollup("category").agg(F.count("*").alias("queries"), F.sum("hit").cast("long").alias("hits"), F.avg("hit").alias("recall"))


def labelled(found: DataFrame, asked: DataFrame, labels: DataFrame, k: int = 5) -> DataFrame:
    """As `recall`, where other rows of a query's own category are relevant.
    asked: (query_id, category), labels: (id, category).  Only what was found is
    looked up, so no pairs of a category's rows are made."""
    near = found.where((F.col("rank") <= k) & (F.col("id") != F.col("query_id"))).select("query_id", "id").join(labels, "id")
    hit = near.select("query_id", "category").distinct().withColumn("hit", F.lit(1))
    per = asked.join(hit, ["query_id", "category"], "left").select("category", F.coalesce("hit", F.lit(0)).alias("hit"))
    return per.rollup("category").agg(F.count("*").alias("queries"), F.sum("hit").cast("long").alias("hits"), F.avg("hit").alias("recall"))


def run(corpus: DataFrame, questions: DataFrame, k: int = 5, hybrid: bool = True, penalise: bool = False, deep_evidence: bool = False) -> DataFrame:
    """(query_id, category, retrieved, hit): every question asked of its own
    item's corpus, all items in one job.

    A hit is a target id among the first k, or a text of `evidence` within
    their snippets, case folded (`deep_evidence`: within all that were
    retrieved before the k best were taken).  A question without words or
    matches is a miss."""
    chunks = corpus.select("item_id", "id", "content", F.col("item_id").alias("domain"), F.col("role").alias("topic"), F.lit("").alias("category"), F.col("id").alias("source_file"))
    q = questions.select("query_id", "item_id", "category", "query", "targets", "evidence")
    found = fts.search(chunks, q, 3 * k if hybrid else k, within="item_id")
    names = lambda s: F.transform(person_names(s), F.lower)
    asked = q.withColumn("keywords", F.filter(keywords(F.col("query")), lambda w: ~F.array_contains(names(F.col("query")), w)))
    rows = found.join(asked, "query_id").join(chunks.select("item_id", "id", snippet(F.col("content")).alias("content")), ["item_id", "id"])
    rows = rerank(rows, penalise) if hybrid else rows
    near = F.lit(True) if deep_evidence else F.col("rank") <= k
    by_id = (F.col("rank") <= k) & F.exists(F.coalesce("targets", F.array().cast("array<string>")), lambda t: F.lower(t) == F.lower("id"))
    by_text = near & F.exists(F.coalesce("evidence", F.array().cast("array<string>")), lambda e: (e != "") & F.contains(F.lower("content"), F.lower(e)))
    kept = F.array_sort(F.collect_list(F.when(F.col("rank") <= k, F.struct("rank", "id"))))
    hits = rows.groupBy("query_id").agg(F.transform(kept, lambda x: x["id"]).alias("retrieved"), F.bool_or(by_id | by_text).alias("hit"))
    out = q.select("query_id", "category").join(hits, "query_id", "left")
    return out.select("query_id", "category", F.coalesce("retrieved", F.array().cast("array<string>")).alias("retrieved"), F.coalesce("hit", F.lit(False)).alias("hit"))


def summary(results: DataFrame) -> DataFrame:
    """Recall by category and over all (category null)."""
    hit = F.col("hit").cast("int")
    return results.rollup("category").agg(F.count("*").alias("queries"), F.sum(hit).cast("long").alias("hits"), F.avg(hit).alias("recall"))


def documents(docs: DataFrame, filed_at: str) -> DataFrame:
    """docs (id, text, domain, topic) as chunks of an evaluation, whose source is the id."""
    return docs.select("id", "domain", "topic", F.lit("").alias("category"), F.col("id").alias("source_file"), F.col("text").alias("content"), F.lit(0).alias("chunk_index"), F.lit("bench").alias("added_by"), F.lit(filed_at).alias("filed_at"))


def placed(results: DataFrame, order: str = "id") -> DataFrame:
    """Add `place`, from 0, by an order: rows are sorted in ranges, and each range
    starts after the rows of those before it (one row a range on the way)."""
    ranged = written.written(results.repartitionByRange(order).withColumn("_range", F.spark_partition_id()), "places")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    start = ranged.groupBy("_range").count().withColumn("_start", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    at = F.row_number().over(Window.partitionBy("_range").orderBy(order)) - 1
    return ranged.join(F.broadcast(start), "_range").withColumn("place", F.col("_start") + at).drop("_range", "_start")


def running(results: DataFrame, every: int = 50) -> DataFrame:
    """results (place, hit), places from 0: (done, recall) after each `every`
    questions.  The window runs over groups of questions, not over questions."""
    group = F.floor(F.col("place") / every).alias("group")
    counts = results.groupBy(group).agg(F.count("*").alias("n"), F.sum(F.col("hit").cast("int")).alias("hits"))
    so_far = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, 0)
    out = counts.select("n", F.sum("n").over(so_far).alias("done"), F.sum("hits").over(so_far).alias("hits"))
    return out.where(F.col("n") == every).select("done", (F.col("hits") / F.col("done")).alias("recall"))


def save(results: DataFrame, folder: str) -> None:
    """Write the results as JSON lines."""
    results.write.mode("overwrite").json(folder)
