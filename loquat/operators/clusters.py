"""Exact nearest vectors through clusters.

Vectors are dealt to the nearest of a bounded number of centres and packed into
blocks of one cluster.  For a query q and a cluster of centre c and radius r no
inner product is above q.c + |q| r, so after the clusters of the highest bounds
have given a k-th score, those whose bound is below it are skipped, and inside
the others the blocks whose own bound is.  Nothing that could be among the k
best is left out: the rows are those of `vectors.knn`.

Queries stay in rows: they are packed like vectors, cluster by cluster, and
blocks of queries meet blocks of vectors, one matrix product a pair.  What is
broadcast are the centres, their radii and sizes (`clusters` of them).

Null vectors and those of another length than the index count as zeros;
queries of another length, and null ones, find nothing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import written
from .vectors import _best, _matrix

SLACK = 1e-6  # scores are compared to seven places
PER_BLOCK = 256


def centres(vectors: DataFrame, clusters: int, sample: int, rounds: int = 8) -> np.ndarray:
    """Centres by Lloyd's rounds over the `sample` vectors of the smallest hash
    of their ids.  Any centres give right results; good ones give small radii."""
    rows = vectors.where("embedding IS NOT NULL").orderBy(F.xxhash64(F.col("id").cast("string"))).limit(sample).select("embedding").collect()
    size = max((len(r[0]) for r in rows), default=0)
    same = [r[0] for r in rows if len(r[0]) == size]
    x = np.nan_to_num(np.array(same, float).reshape(len(same), size))
    held = x[:clusters].copy() if len(x) else np.zeros((1, size))
    for _ in range(rounds if len(x) > clusters else 0):
        own = ((held * held).sum(1) / 2 - x @ held.T).argmin(1)
        count = np.bincount(own, minlength=len(held))
        total = np.zeros_like(held)
        np.add.at(total, own, x)
        held[count > 0] = total[count > 0] / count[count > 0, None]
    return held


def save(vectors: DataFrame, folder: str, clusters: int = 256, sample: int = 20_000) -> None:
    """Write the index of (id, embedding) anew: `blocks` and `clusters`."""
    spark = vectors.sparkSession
    held = centres(vectors, clusters, sample)
    sent, size = spark.sparkContext.broadcast(held), held.shape[1]
    kind = dict(vectors.dtypes)["id"]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = (sent.value * sent.value).sum(1) / 2
        for batch in batches:
            x = _matrix(batch.column("embedding"), size)
            own = (half - x @ sent.value.T).argmin(1)
            yield pa.record_batch([pa.array(own.astype(np.int32)), batch.column("id"), pa.array([r.tobytes() for r in x], pa.binary())], ["cluster", "id", "x"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cluster, ids, x in _runs(batches):
            mean = x.mean(0)
            far = lambda c: float(np.sqrt(((x - c) ** 2).sum(1).max()))
            yield pa.record_batch([
                pa.array([cluster], pa.int32()), pa.array([len(x)], pa.int32()), pa.array([far(sent.value[cluster])]), pa.array([mean.tobytes()], pa.binary()), pa.array([far(mean)]),
                pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), ids), pa.array([x.tobytes()], pa.binary()),
            ], ["cluster", "n", "radius", "mean", "own_radius", "ids", "matrix"])

    dealt = vectors.select("id", "embedding").mapInArrow(assign, f"cluster int, id {kind}, x binary")
    # a large cluster is cut at hashes of its ids
    dealt = dealt.repartitionByRange("cluster", F.xxhash64("id")).sortWithinPartitions("cluster")
    blocks = dealt.mapInArrow(pack, f"cluster int, n int, radius double, mean binary, own_radius double, ids array<{kind}>, matrix binary")
    blocks.write.mode("overwrite").parquet(f"{folder}/blocks")
    about = spark.createDataFrame([(i, c.tobytes()) for i, c in enumerate(held)], "cluster int, centre binary")
    sizes = spark.read.parquet(f"{folder}/blocks").groupBy("cluster").agg(F.sum("n").alias("n"), F.max("radius").alias("radius"))
    sizes.join(about, "cluster").coalesce(1).write.mode("overwrite").parquet(f"{folder}/clusters")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """Up to PER_BLOCK neighbouring rows of one cluster: cluster, ids, matrix."""
    cluster, ids, rows = None, [], []

    def made():
        return cluster, pa.concat_arrays(ids), np.concatenate(rows)

    for batch in batches:
        own = batch.column("cluster").to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1, [len(own)]]) if len(own) else np.zeros(0, int)
        for a, b in zip(cuts[:-1], cuts[1:]):
            if cluster is not None and cluster != own[a] and ids:
                yield made()
                ids, rows = [], []
            cluster = int(own[a])
            while a < b:
                end = min(b, a + PER_BLOCK - sum(map(len, ids)))
                ids.append(batch.column("id").slice(a, end - a))
                rows.append(np.frombuffer(b"".join(batch.column("x").slice(a, end - a).to_pylist())).reshape(end - a, -1))
                a = end
                if sum(map(len, ids)) == PER_BLOCK:
                    yield made()
                    ids, rows = [], []
    if ids:
        yield made()


def _bounds(sent, probe: int, all_: bool):
    """Queries with the clusters they have to meet: those of the highest bounds
    that hold `probe` vectors, or (`all_`) those whose bound reaches `least`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, centre, radius, n = sent.value
        for batch in batches:
            x = _matrix(batch.column("embedding"), centre.shape[1])
            bound = x @ centre.T + np.sqrt((x * x).sum(1))[:, None] * radius
            if all_:
                least = batch.column("least").to_numpy(zero_copy_only=False)
                q, c = np.nonzero(bound >= np.where(np.isnan(least), -np.inf, least)[:, None] - SLACK)
            else:
                order = np.argsort(-bound, 1, kind="stable")
                before = np.cumsum(n[order], 1) - n[order]
                q, at = np.nonzero(before < probe)
                c = order[q, at]
            least = batch.column("least").take(pa.array(q))
            yield pa.record_batch([pa.array(names[c]), batch.column("query_id").take(pa.array(q)), pa.array([r.tobytes() for r in x[q]], pa.binary()), least], ["cluster", "id", "x", "least"])

    return run


def _pack_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def wide():
        for b in batches:  # the score to reach travels as one more component
            least = b.column("least").to_numpy(zero_copy_only=False)
            x = [r + np.float64(v).tobytes() for r, v in zip(b.column("x").to_pylist(), least)]
            yield pa.record_batch([b.column("cluster"), b.column("id"), pa.array(x, pa.binary())], ["cluster", "id", "x"])

    for cluster, ids, x in _runs(wide()):
        yield pa.record_batch([pa.array([cluster], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), ids), pa.array([x.tobytes()], pa.binary())], ["cluster", "queries", "asked"])


def _products(k: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q = np.frombuffer(batch.column("asked")[i].as_py()).reshape(-1, size + 1)
                x = np.frombuffer(batch.column("matrix")[i].as_py()).reshape(-1, size)
                least, q = np.nan_to_num(q[:, -1], nan=-np.inf), q[:, :-1]
                reach = q @ np.frombuffer(batch.column("mean")[i].as_py()) + np.sqrt((q * q).sum(1)) * batch.column("own_radius")[i].as_py()
                rows = np.flatnonzero(reach >= least - SLACK)
                names, ids = batch.column("queries")[i].values, batch.column("ids")[i].values
                if not len(rows):
                    continue
                scores, found = _best(q[rows] @ x.T, np.array(ids.to_pylist(), object), k)
                a, b = np.nonzero(scores >= least[rows, None] - SLACK)
                compared = np.zeros(len(a), np.int64)
                compared[:1] = len(rows) * len(x)
                yield pa.record_batch([names.take(pa.array(rows[a])), pa.array(list(found[a, b]), ids.type), pa.array(scores[a, b]), pa.array(compared)], ["query_id", "id", "score", "compared"])

    return run


def knn(spark: SparkSession, folder: str, queries: DataFrame, k: int = 30, read: dict | None = None) -> DataFrame:
    """(query_id, id, score, rank): the k nearest of the index to each query
    (query_id, embedding).  Into `read` goes the share of all pairs of queries
    and vectors whose products were made, both passes together."""
    blocks = spark.read.parquet(f"{folder}/blocks")
    about = spark.read.parquet(f"{folder}/clusters").orderBy("cluster").collect()  # bounded by their number
    kinds = dict(queries.dtypes)["query_id"], dict(blocks.dtypes)["ids"][6:-1]
    out = f"query_id {kinds[0]}, id {kinds[1]}, score double"
    if not about:
        return spark.createDataFrame([], out + ", rank int")
    centre = np.array([np.frombuffer(r["centre"]) for r in about])
    size = centre.shape[1]
    sent = spark.sparkContext.broadcast((np.array([r["cluster"] for r in about], np.int32), centre, np.array([r["radius"] for r in about]), np.array([r["n"] for r in about])))
    asked = written.written(queries.where(F.size("embedding") == size).select("query_id", F.col("embedding").cast("array<double>").alias("embedding")), "queries")
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 7)), "id")

    def scored(rows: DataFrame, all_: bool) -> DataFrame:
        met = rows.mapInArrow(_bounds(sent, 4 * k, all_), f"cluster int, id {kinds[0]}, x binary, least double")
        packed = met.repartitionByRange("cluster", F.xxhash64("id")).sortWithinPartitions("cluster").mapInArrow(_pack_queries, f"cluster int, queries array<{kinds[0]}>, asked binary")
        return packed.join(blocks, "cluster").select("queries", "asked", "mean", "own_radius", "ids", "matrix").mapInArrow(_products(k, size), out + ", compared long")

    def ranked(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    first = written.written(scored(asked.withColumn("least", F.lit(None).cast("double")), False), "first")
    least = ranked(first.drop("compared")).where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    second = written.written(scored(asked.join(least, "query_id", "left"), True), "second")
    if read is not None:
        made = sum(d.agg(F.coalesce(F.sum("compared"), F.lit(0))).first()[0] for d in (first, second))
        read["share"] = made / max(1, asked.count() * sum(r["n"] for r in about))
    written.discard(first)
    return ranked(second.select("query_id", "id", "score"))
