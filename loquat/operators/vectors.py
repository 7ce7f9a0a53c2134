"""Vector search, hybrid search and duplicates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.text import ascii_words, jaccard, most_frequent, snippet, tokens
from . import fts, written


ROWS = 2048  # of a batch that meet a block of queries at once, so a task's scores stay within some 16 MB


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """Rows of a list column as doubles; null ones and those of another length are zeros."""
    out = np.zeros((len(column), size))
    length = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    fits = length == size
    if fits.any():
        out[fits] = column.filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
    return np.nan_to_num(out)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best columns of each row, of equal scores (to 7 places) the smallest ids."""
    if scores.shape[1] > k:
        worst = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
        near = np.flatnonzero((scores >= worst - 1e-6).any(0))
        scores, ids = scores[:, near], ids[near]
    by_id = np.argsort(ids, kind="stable")
    scores, ids = scores[:, by_id], ids[by_id]
    order = np.argsort(-np.round(scores, 7), axis=1, kind="stable")[:, :k]
    return np.take_along_axis(scores, order, 1), ids[order]


def knn(vectors: DataFrame, queries: DataFrame, k: int = 30, block: int = 1000) -> DataFrame:
    """(query_id, id, score, rank): the k vectors nearest to each query.

    The queries are a stated set.  They go out in blocks of about `block`, one
    broadcast matrix each; every batch of vectors is one matrix product, and a
    task keeps the k best of each query, so that is all that is shuffled."""
    held = queries.select("query_id", "embedding")
    kind = dict(vectors.dtypes)["id"]
    out = None
    blocks = -(-held.count() // block) or 1
    for n in range(blocks):
        rows = held.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == n).collect()  # about `block` vectors
        for size in sorted({len(r["embedding"] or ()) for r in rows}) or [0]:
            part = [r for r in rows if len(r["embedding"] or ()) == size]
            sent = vectors.sparkSession.sparkContext.broadcast((pa.array([r["query_id"] for r in part], from_spark(dict(queries.dtypes)["query_id"])), np.array([r["embedding"] for r in part], float).reshape(len(part), size)))
            one = vectors.select("id", "embedding").mapInArrow(_nearest(sent, k, size), f"query_id {dict(queries.dtypes)['query_id']}, id {kind}, score double")
            out = one if out is None else out.unionByName(one)
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 7)), "id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def from_spark(kind: str) -> pa.DataType:
    return {"string": pa.string(), "int": pa.int32()}.get(kind, pa.int64())


def _nearest(sent, k: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, matrix = sent.value
        best, ids, kind = np.zeros((len(asked), 0)), np.zeros((len(asked), 0), object), pa.int64()
        if not len(asked):
            return
        for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            kind = batch.schema.field("id").type
            own = np.array(batch.column("id").to_pylist(), object)
            scores, found = _best(matrix @ _matrix(batch.column("embedding"), size).T, own, k)
            both, names = np.concatenate([best, scores], 1), np.concatenate([ids, found], 1)
            order = np.lexsort((_places(names), -np.round(both, 7)))[:, :k]
            best, ids = np.take_along_axis(both, order, 1), np.take_along_axis(names, order, 1)
        n = best.shape[1]
        if n:
            yield pa.record_batch([asked.take(pa.array(np.repeat(np.arange(len(asked)), n))), pa.array(list(ids.ravel()), kind), pa.array(best.ravel())], ["query_id", "id", "score"])

    return run


def _places(names: np.ndarray) -> np.ndarray:
    """Places of ids in their order."""
    return np.unique(names, return_inverse=True)[1].reshape(names.shape)


def hybrid(chunks: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """BM25 and vector legs of three times the depth, fused by reciprocal rank.
    A query without a vector or without words has the other leg alone."""
    seen = queries.where(F.col("embedding").isNotNull())
    return fts.fuse([fts.search(chunks, queries, C.DEPTH * k), knn(vectors, seen, C.DEPTH * k)], k)


def missing(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    return chunks.join(vectors.select("id"), "id", "left_anti")


def semantic_duplicates(vectors: DataFrame, queries: DataFrame, threshold: float = 0.9) -> DataFrame:
    """(query_id, duplicate): does any other vector reach the threshold?"""
    best = knn(vectors, queries, 2).where(F.col("id") != F.col("query_id")).groupBy("query_id").agg(F.max("score").alias("best"))
    return best.select("query_id", (F.col("best") >= threshold).alias("duplicate"))


def keyword_rank(docs: DataFrame, n: int = 5, stop: list[str] = C.DUPLICATE_STOP) -> DataFrame:
    """(id, word, count, rank): most frequent words over four letters, first seen first."""
    words = F.filter(ascii_words(F.col("content")), lambda w: (F.length(w) > 4) & ~w.isin(stop))
    keyed = F.sort_array(F.transform(words, lambda w, i: F.struct(w.alias("key"), i.alias("pos"))))
    # counted in the document's own row, so nothing is shuffled; exploding keeps an array a column
    rows = docs.select("id", F.explode(F.array(keyed)).alias("_w"))
    top = rows.select("id", F.posexplode(most_frequent(F.col("_w"), n)).alias("rank", "x"))
    return top.select("id", F.col("x.key").alias("word"), (-F.col("x.n")).cast("long").alias("count"), (F.col("rank") + 1).alias("rank"))


def keyword_queries(docs: DataFrame, n: int = 5) -> DataFrame:
    """(query_id, query): a text's top keywords as a search; texts without any ask nothing."""
    best = F.array_sort(F.collect_list(F.struct("rank", "word")))
    top = keyword_rank(docs, n).groupBy("id").agg(F.concat_ws(" ", F.transform(best, lambda x: x["word"])).alias("query"))
    return top.withColumnRenamed("id", "query_id")


def keyword_duplicates(docs: DataFrame, store: DataFrame, threshold: float = 0.9, candidates: int = 5, shown: bool = False, index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(query_id, id, similarity): stored chunks among the BM25 candidates of a
    text's top keywords whose words are alike.  `shown` compares with the words
    of the candidate's snippet alone, as a client that sees no more would; with
    `index`, a search index of the store, its texts are not split again."""
    asked = keyword_queries(docs)
    found = fts.search(store, asked, candidates) if index is None else fts.search_index(*index, asked, candidates, saved=True)
    # texts are split, and moved, only if they are a candidate's
    found = fts.bounded(written.written(found.select("query_id", "id"), "candidates"))
    words = lambda d, name, text: d.withColumn(name, F.array_distinct(ascii_words(text)))
    shorter = snippet(F.col("content")) if shown else F.col("content")
    left = words(docs.select(F.col("id").alias("query_id"), "content").join(found.select("query_id").distinct(), "query_id", "left_semi"), "query_id_words", F.col("content")).drop("content")
    both = words(store.select("id", "content").join(found, "id"), "other_words", shorter).drop("content").join(left, "query_id")
    return both.withColumn("similarity", jaccard(F.col("query_id_words"), F.col("other_words"))).where(F.col("similarity") >= threshold).select("query_id", "id", "similarity")


def _bands(bands: int, rows: int):
    """Band values of texts by the hashes of their words: `rows` least values each."""
    factors = np.random.default_rng(1).integers(1, 1 << 62, (bands, rows, 2)).astype(np.uint64) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            hashes = batch.column("hashes")
            words = hashes.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            sizes = pc.list_value_length(hashes).to_numpy(zero_copy_only=False)
            starts = np.cumsum(sizes) - sizes
            out = np.zeros((len(sizes), bands), np.uint64)
            for b in range(bands):
                for add, times in factors[b]:
                    mixed = (words ^ add) * times
                    least = np.minimum.reduceat(mixed ^ (mixed >> np.uint64(31)), starts)
                    out[:, b] = (out[:, b] ^ least) * factors[0, 0, 1]
                    out[:, b] ^= out[:, b] >> np.uint64(29)
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1) * bands, pa.int32()), pa.array(out.view(np.int64).ravel()))
            yield pa.record_batch([batch.column("id"), batch.column("kind"), values], ["id", "kind", "bands"])

    return run


def word_duplicates(docs: DataFrame, store: DataFrame, threshold: float = 0.9, bands: int = 12, rows: int = 4) -> DataFrame:
    """(query_id, id, similarity): as `keyword_duplicates`, but candidates share
    a band of MinHash values of their words, so no keyword has to match.  At
    similarity 0.9 a pair would be missed once in 300,000 with 12 bands of 4
    values, if the values were independent.

    Words are those of the search, of any script; texts without any are like
    nothing.  Texts of equal words are one class, which meets the others once.
    A text is split once, for its class and bands, and what is written is those;
    the words of one text a class are made again if the class is a candidate."""
    def worded(d: DataFrame) -> DataFrame:
        words = F.sort_array(F.array_distinct(tokens(F.col("content"))))
        rows = d.select("id", F.explode(F.array(words)).alias("words")).where(F.size("words") > 0)
        return rows.withColumn("kind", F.sha2(F.array_join("words", " "), 256))

    def classes(d: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        hashed = worded(d).select("id", "kind", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
        each = written.written(hashed.mapInArrow(_bands(bands, rows), f"id {dict(d.dtypes)['id']}, kind string, bands array<bigint>"), "classes")
        return each.select("id", "kind"), each.groupBy("kind").agg(F.first("bands").alias("bands"), F.min("id").alias("one")).select(F.col("kind").alias(f"{name}_kind"), F.col("one").alias(f"{name}_one"), F.posexplode("bands").alias("band", "value"))

    def of_classes(d: DataFrame, name: str) -> DataFrame:
        few = fts.bounded(pairs.select(F.col(f"{name}_one").alias("one")).distinct())
        found = worded(d.select("id", "content").join(few, F.col("id").eqNullSafe(F.col("one")), "left_semi"))
        return found.select(F.col("kind").alias(f"{name}_kind"), F.col("words").alias(f"{name}_words")).dropDuplicates([f"{name}_kind"])

    asked, a = classes(docs, "a")
    held, b = classes(store, "b")
    met = a.join(b, ["band", "value"]).where("a_kind <> b_kind")
    pairs = written.written(met.select("a_kind", "b_kind", "a_one", "b_one").distinct(), "pairs")
    both = pairs.select("a_kind", "b_kind").join(of_classes(docs, "a"), "a_kind").join(of_classes(store, "b"), "b_kind")
    alike = both.select("a_kind", "b_kind", jaccard(F.col("a_words"), F.col("b_words")).alias("similarity"))
    same = asked.select(F.col("kind").alias("a_kind"), F.col("kind").alias("b_kind"), F.lit(1.0).alias("similarity")).distinct()
    alike = alike.unionByName(same).where(F.col("similarity") >= threshold)
    asked, held = (d.select(F.col("id").alias(name), F.col("kind").alias(kind)) for d, name, kind in ((asked, "query_id", "a_kind"), (held, "id", "b_kind")))
    return alike.join(asked, "a_kind").join(held, "b_kind").select("query_id", "id", "similarity")
