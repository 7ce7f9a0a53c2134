"""Full-text search: phrase matching over five columns, BM25 over the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.text import snippet, title, tokens
from . import written

COLUMNS = ["content", "domain", "topic", "category", "source_file"]


def phrases(queries: DataFrame, within: str | None = None) -> DataFrame:
    """(query_id, phrase, tokens): each white-space word without `" * ^` is a phrase."""
    words = F.filter(F.split(F.regexp_replace("query", '["*^]', ""), " "), lambda w: w != "")
    rows = queries.select("query_id", *([within] if within else []), F.posexplode(words).alias("phrase", "word"))
    return rows.withColumn("tokens", tokens(F.col("word"))).where(F.size("tokens") > 0).drop("word")


def bounded(df: DataFrame, most: int = 100_000) -> DataFrame:
    """The frame, marked for broadcast if it has at most `most` rows; beyond, Spark joins by shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def index(chunks: DataFrame, within: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Postings (id, col, pos, token) and sizes (id, len, domain, topic); with
    `within`, a column that names the corpus of a chunk, both carry it."""
    keys = [within] if within else []
    text = chunks.select("id", *keys, F.explode(F.array(*[F.struct(F.lit(i).alias("col"), tokens(F.col(c)).alias("t")) for i, c in enumerate(COLUMNS)])).alias("x"))
    length = sum(F.coalesce(F.size(tokens(F.col(c))), F.lit(0)) for c in COLUMNS)
    return text.select("id", *keys, "x.col", F.posexplode("x.t").alias("pos", "token")), chunks.select("id", *keys, length.alias("len"), "domain", "topic")


def save_index(chunks: DataFrame, folder: str) -> None:
    """Write both tables anew.  Postings are dealt by token range, so a query
    reads the row groups of its words only."""
    postings, sizes = index(chunks)
    postings.repartitionByRange("token", "id").sortWithinPartitions("token").write.mode("overwrite").parquet(f"{folder}/postings")
    sizes.write.mode("overwrite").parquet(f"{folder}/sizes")


def load_index(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{folder}/postings"), spark.read.parquet(f"{folder}/sizes")


def matches(postings: DataFrame, terms: DataFrame, within: str | None = None, saved: bool = False) -> DataFrame:
    """(id, f): of each chunk that has any of the `terms` (term, tokens) a map from
    terms to the numbers of their occurrences.  Of `saved` postings the scan
    reads the row groups of up to 1,000 query words alone.

    A posting of a term of one token is an occurrence.  Of a longer one, a
    posting at position p of its j-th token votes for a start at p - j; a start
    with a vote of every token is an occurrence."""
    keys = [within] if within else []
    words = terms.select("term", *keys, F.size("tokens").alias("n"), F.posexplode("tokens").alias("j", "token"))
    if saved:
        few = [r["token"] for r in words.select("token").distinct().limit(1001).collect()]
        postings = postings.where(F.col("token").isin(few)) if len(few) <= 1000 else postings
    long = words.where("n > 1")
    # the query words prune the postings before any shuffle
    found = postings.join(bounded(words.where("n = 1")), ["token", *keys]).select("id", *keys, "term")
    if not long.isEmpty():
        votes = postings.join(bounded(long), ["token", *keys]).groupBy("id", *keys, "term", "n", "col", (F.col("pos") - F.col("j")).alias("start")).count()
        found = found.unionByName(votes.where("count = n").select("id", *keys, "term"))
    # dealt by chunk once; both groupings stay where their chunk is
    counted = found.repartition("id").groupBy("id", *keys, "term").agg(F.count("*").cast("int").alias("n"))
    return counted.groupBy("id", *keys).agg(F.map_from_entries(F.collect_list(F.struct("term", "n"))).alias("f"))


def search(chunks: DataFrame, queries: DataFrame, k: int = 10, domain: str | None = None, topic: str | None = None, within: str | None = None) -> DataFrame:
    """(query_id, id, score, rank): the k best chunks of each query.  All its
    phrases must occur; filters come after matching, so they leave the corpus
    statistics as they are.  With `within`, a column of both frames, a query
    sees only its own corpus, statistics included."""
    return search_index(*index(chunks, within), queries, k, domain, topic, within)


UNROLLED, BLOCK = 8, 100_000  # terms of a query that are looked up in code; queries of a turn


def _rank(by: str) -> Column:
    return F.row_number().over(Window.partitionBy(by).orderBy(F.desc(F.round("score", 9)), "id"))


def _scored(docs: DataFrame, asked: DataFrame, most: int) -> DataFrame:
    """(group, id, score): chunks that have all terms of a group.  A chunk meets
    the groups whose rarest term it has, and looks the others up in its own
    map, so nothing is shuffled."""
    met = docs.select("id", "len", "f", F.explode(F.map_keys("f")).alias("rare")).join(F.broadcast(asked), "rare")
    times = lambda p: F.try_element_at("f", p["term"])
    part = lambda p: p["idf"] * times(p) * (C.K1 + 1) / (times(p) + C.K1 * (1 - C.B + C.B * F.col("len") / F.col("mean")))
    score = F.lit(0.0)
    for j in range(min(most, UNROLLED)):
        p = F.get("parts", F.lit(j))
        met = met.where((F.size("parts") <= j) | times(p).isNotNull())
        score = score + F.when(F.size("parts") > j, part(p)).otherwise(0.0)
    if most > UNROLLED:
        rest = F.slice("parts", UNROLLED + 1, most)
        met = met.where(F.forall(rest, lambda p: times(p).isNotNull()))
        score = score + F.aggregate(rest, F.lit(0.0), lambda acc, p: acc + part(p))
    return met.select("group", "id", score.alias("score"))


def search_index(postings: DataFrame, sizes: DataFrame, queries: DataFrame, k: int = 10, domain: str | None = None, topic: str | None = None, within: str | None = None, saved: bool = False) -> DataFrame:
    """Equal phrases are one term and queries of equal terms one group, so the
    postings of a word are read once, however many queries ask for it."""
    keys = [within] if within else []
    wanted = written.written(phrases(queries, within), "phrases")  # queries may be dear to make
    number = F.monotonically_increasing_id()  # differs from run to run, so it is written
    terms = written.written(wanted.select(*keys, "tokens").distinct().withColumn("term", number), "terms")
    sets = wanted.join(terms, [*keys, "tokens"]).groupBy("query_id", *keys).agg(F.sort_array(F.collect_list("term")).alias("terms"))
    groups = written.written(sets.select(*keys, "terms").distinct().withColumn("group", number), "groups")
    sizes = sizes if saved else written.written(sizes, "sizes")
    # what was deleted since has no size; it counts neither as a match nor for the statistics
    docs = written.written(matches(postings, terms, within, saved).join(sizes, ["id", *keys]), "found")
    corpus = sizes.groupBy(*keys).agg(F.count("*").alias("docs"), F.avg("len").alias("mean"))
    df = docs.select(F.explode(F.map_keys("f")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    x = groups.select("group", *keys, F.size("terms").alias("need"), F.explode("terms").alias("term")).join(df, "term")
    x = x.join(corpus, keys) if keys else x.crossJoin(F.broadcast(corpus))  # one row
    idf = F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(idf > 0, idf).otherwise(F.lit(C.IDF_FLOOR))
    parts = F.sort_array(F.collect_list(F.struct("df", "term", idf.alias("idf"))))
    asked = x.groupBy("group", "need", "mean").agg(parts.alias("parts")).where(F.size("parts") == F.col("need"))
    asked = written.written(asked.select("group", "mean", "parts", F.col("parts")[0]["term"].alias("rare")), "asked")
    n, most = asked.agg(F.count("*"), F.max(F.size("parts"))).first()
    for column, value in (("domain", domain), ("topic", topic)):
        docs = docs if value is None else docs.where(F.col(column) == value)
    turns, found = -(-n // BLOCK) or 1, None
    for turn in range(turns):
        one = _scored(docs, asked.where(F.pmod(F.xxhash64("group"), F.lit(turns)) == turn), most or 0)
        found = one if found is None else found.unionByName(one)
    # each task keeps the k best of a group, so that is all that is shuffled
    best = found.withColumn("rank", _rank("group")).where(F.col("rank") <= k)
    return sets.join(groups, [*keys, "terms"]).select("query_id", "group").join(best, "group").select("query_id", "id", "score", "rank")


def hydrate(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    meta = chunks.select("id", title(F.col("source_file")).alias("title"), snippet(F.col("content")).alias("snippet"), "domain", "topic", "category")
    hits = written.written(hits, "hits")  # the search runs once, whatever its rows are used for
    return meta.join(bounded(hits), "id")


def fuse(legs: list[DataFrame], k: int = 10, rrf: int = C.RRF_K) -> DataFrame:
    """Reciprocal rank fusion of (query_id, id, rank) lists; ties go to the first list."""
    every = None
    for i, leg in enumerate(legs):
        one = leg.select("query_id", "id", F.lit(i).alias("leg"), "rank")
        every = one if every is None else every.unionByName(one)
    both = every.groupBy("query_id", "id").agg(F.sum(1.0 / (rrf + F.col("rank"))).alias("score"), F.min(F.struct("leg", "rank")).alias("first"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "first", "id")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "id", "score", "rank")
