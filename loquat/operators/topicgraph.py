"""Topic graph: topics are nodes, a shared domain is an edge."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import written


def nodes(chunks: DataFrame) -> DataFrame:
    """Per topic, case folded: shown name (newest row's), domains, categories, rows."""
    blank = F.trim(F.coalesce("category", F.lit(""))) != ""
    return chunks.groupBy(F.lower("topic").alias("topic_key")).agg(
        F.max_by("topic", F.struct("filed_at", "id")).alias("topic"), F.array_sort(F.collect_set(F.lower("domain"))).alias("domains"),
        F.array_sort(F.collect_set(F.when(blank, F.lower("category")))).alias("categories"), F.count("*").alias("chunk_count"))


def edges(n: DataFrame) -> DataFrame:
    """(a, b, via) with a < b: both topics occur in domain `via`.  The join is
    over distinct (topic, domain) pairs, not over chunks."""
    flat = n.select("topic_key", F.explode("domains").alias("via"))
    a, b = flat.withColumnRenamed("topic_key", "a"), flat.withColumnRenamed("topic_key", "b")
    return a.join(b, "via").where("a < b").select("a", "b", "via")


def adjacency(e: DataFrame) -> DataFrame:
    return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "via"))


def _walk(begin: DataFrame, near: DataFrame, max_hops: int) -> DataFrame:
    """(start, topic_key, domain, hops) of all starts at once, level by level.
    `near` leads from `a` by `via` to `b`.  Each level reads the
    written level before it and what has been seen, so the plan of a level is
    as large as the first one's, and the levels end where nothing is new."""
    spark, path, kinds = near.sparkSession, written.folder(near.sparkSession, "walk"), "start string, topic_key string, domain string, hops int"
    at = lambda n: f"{path}/hops={n}"
    read = lambda levels: spark.read.schema(kinds).parquet(*map(at, levels))
    begin.select("start", F.col("start").alias("topic_key"), F.lit("").alias("domain"), F.lit(0).alias("hops")).write.parquet(at(0))
    level = 0
    while level < max(max_hops, 1):  # direct neighbours are always found
        step = read([level]).join(near, F.col("topic_key") == F.col("a")).groupBy("start", "b").agg(F.min("via").alias("domain"))
        fresh = step.withColumnRenamed("b", "topic_key").join(read(range(level + 1)).select("start", "topic_key"), ["start", "topic_key"], "left_anti")
        level += 1
        fresh.select("start", "topic_key", "domain", F.lit(level).alias("hops")).write.parquet(at(level))
        if read([level]).isEmpty():
            break
    return read(range(1, level + 1))


def _capped(found: DataFrame, most: int | None) -> DataFrame:
    if most is None:
        return found
    place = F.row_number().over(Window.partitionBy("start").orderBy("hops", "topic_key"))
    return found.withColumn("_place", place).where(F.col("_place") <= most).drop("_place")


def traverse(e: DataFrame, start: str, max_hops: int = 2, most: int | None = 50) -> DataFrame:
    """(topic_key, domain, hops): breadth-first from one topic; of equal hops the smallest domain."""
    near = written.written(adjacency(e), "near")
    begin = near.where(F.col("a") == start.lower()).select(F.col("a").alias("start")).limit(1)
    out = _walk(begin, near, max_hops).drop("start")
    written.discard(near)
    return out if most is None else out.orderBy("hops", "topic_key").limit(most)


def traverse_all(n: DataFrame, starts: DataFrame, max_hops: int = 2, most: int | None = 50) -> DataFrame:
    """(start, topic_key, domain, hops): breadth-first from many topics at once.

    Of nodes, not of edges: a level goes from topics to their domains and from
    there to the domains' topics, and a domain that a start has been through is
    not entered again.  So the work is bounded by starts times memberships, and
    no pairs of a large domain's topics are made.  With `most`, a start that has
    found as many goes no further, as what comes later is behind them; so of a
    domain only its first 2 * most + 1 topics are entered: the start and what
    it found before, at most `most` topics, cannot keep the first `most` new
    ones from being among those.  Then the work grows with the starts alone,
    whatever the domains' sizes.  `starts` has a column
    `start`; topics that are no node, and null ones, find nothing."""
    spark, path = n.sparkSession, written.folder(n.sparkSession, "walk")
    member = written.written(n.select("topic_key", F.explode("domains").alias("domain")).distinct(), "member")
    into_topics = member
    if most is not None:
        place = F.row_number().over(Window.partitionBy("domain").orderBy("topic_key"))
        into_topics = written.written(member.withColumn("_n", place).where(F.col("_n") <= 2 * most + 1).drop("_n"), "first")
    kinds = {"topics": "start string, topic_key string, domain string, hops int", "domains": "start string, domain string"}
    at = lambda what, level: f"{path}/{what}/level={level}"
    read = lambda what, levels: spark.read.schema(kinds[what]).parquet(*[at(what, x) for x in levels])
    begin = starts.select(F.lower("start").alias("start")).distinct().join(n.select(F.col("topic_key").alias("start")), "start", "left_semi")
    begin.select("start", F.col("start").alias("topic_key"), F.lit("").alias("domain"), F.lit(0).alias("hops")).write.parquet(at("topics", 0))
    level = 0
    while level < max(max_hops, 1):  # direct neighbours are always found
        here = read("topics", [level]).select("start", "topic_key")
        if level and most is not None:
            here = here.join(read("topics", range(1, level + 1)).groupBy("start").count().where(F.col("count") < most).select("start"), "start", "left_semi")
        into = here.join(member, "topic_key").select("start", "domain").distinct()
        if level:
            into = into.join(read("domains", range(level)), ["start", "domain"], "left_anti")
        into.write.parquet(at("domains", level))
        step = read("domains", [level]).join(into_topics, "domain").groupBy("start", "topic_key").agg(F.min("domain").alias("domain"))
        fresh = step.join(read("topics", range(level + 1)).select("start", "topic_key"), ["start", "topic_key"], "left_anti")
        level += 1
        fresh = _capped(fresh.select("start", "topic_key", "domain", F.lit(level).alias("hops")), most)
        fresh.write.parquet(at("topics", level))
        if read("topics", [level]).isEmpty():
            break
    written.discard(member, into_topics)
    written.remove(spark, f"{path}/domains")
    return _capped(read("topics", range(1, level + 1)), most)


def links(n: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """Topics that join domains: both of a and b, or one of them and another, or any two."""
    wanted = [d.lower() for d in (a, b) if d]
    out = n.where(F.size("domains") >= 2)
    for d in wanted:
        out = out.where(F.array_contains("domains", d))
    return out.select("topic_key", "domains")


def stats(n: DataFrame, e: DataFrame) -> DataFrame:
    one = n.agg(F.count("*").alias("nodes"), F.count_if(F.size("domains") >= 2).alias("links"))
    d = n.select(F.explode("domains").alias("d")).agg(F.countDistinct("d").alias("domains"))
    return one.crossJoin(e.agg(F.count("*").alias("edges"))).crossJoin(d)  # one row each
