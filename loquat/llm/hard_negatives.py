"""Hard-negative mining by blocked dense matrix products.

Vectors are packed once into blocks: one row holds the ids, labels and the
matrix of up to `BLOCK` quantised vectors of one length, ordered by id.  The
anchors are a stated set; `WAVE` of them at a time go out in one broadcast (a
bounded number of bytes) and meet every block in a float64 product.  The first
pass keeps each anchor's best rows of its own label: a task holds a sorted list
of at most k an anchor, and the lists of tasks merge.  With the positives' scores
known, the second pass keeps for each anchor and positive the best rows of
other labels within the window of the positive's score, in the same way.  A
wave's rows are written before the next one starts.

Scores are integers: a component x becomes floor(scale * x).  A product is
exact in float64 where the norms of the two blocks multiply to under 2^53 (no
partial sum is larger); blocks beyond that are multiplied as 64-bit integers.

Defined results: rows with a null id, label or vector or a null or non-finite
component take no part, nor do those whose quantised norm is 2^31 or more, as
no long could hold their scores.  Vectors of different lengths do not meet.
Rows with the anchor's own id are not its others; repeated ids and rows are
rows of their own (each repeated anchor has its rows).  Equal scores go by the
smaller id.  Anchors without positives, and positives without rows in their
window, give nothing; empty tables give an empty table.  A negative positive's
window is empty.  Other columns are not carried."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import flat
from .shared import bound_batches, discard, materialise, n_partitions, new_folder

BLOCK, WAVE, TILE = 4096, 4096, 256  # rows of a block, anchors of a broadcast, anchors of one product
WAVE_BYTES = 32 << 20  # of a wave's matrix
EXACT, LONG = 2.0**53, 2.0**31
NONE = np.iinfo(np.int64).min
PACKED = "dim int, ids binary, labels binary, kind string, matrix binary"
OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _packed(ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> dict:
    """One block; its numbers in the narrowest type that holds them."""
    top = np.abs(x).max(initial=0)
    kind = next((k for k in ("int8", "int16", "int32") if top <= np.iinfo(k).max), "float64")
    order = np.argsort(ids, kind="stable")
    return {"dim": x.shape[1], "ids": ids[order].tobytes(), "labels": labels[order].tobytes(), "kind": kind, "matrix": x[order].astype(kind).tobytes()}


def _open(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], np.int64)
    return ids, np.frombuffer(row["labels"], np.int64), np.frombuffer(row["matrix"], row["kind"]).reshape(len(ids), row["dim"]).astype(np.float64)


def quantise(batch: pa.RecordBatch, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, matrix) of the batch's rows that take part, by length."""
    ids, labels, column = batch.columns
    size = np.diff(np.asarray(column.offsets)).astype(np.int64)
    whole = column.is_valid().to_numpy(zero_copy_only=False)
    flatten = column.values.slice(column.offsets[0].as_py(), int(size.sum()))
    x = flatten.cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become nan
    ids, labels = ids.to_numpy(), labels.to_numpy()
    starts = np.cumsum(size) - size
    for dim in np.unique(size[whole]):
        rows = np.flatnonzero(whole & (size == dim))
        with np.errstate(over="ignore", invalid="ignore"):
            m = np.floor(x[starts[rows, None] + np.arange(dim)] * scale)
            good = np.sqrt((m * m).sum(1)) < LONG  # false for nan and infinity
        if good.any():
            yield ids[rows[good]], labels[rows[good]], m[good]


def pack(vectors: DataFrame, scale: float, id: Column, label: Column, vector: Column, name: str) -> DataFrame:
    """Blocks of the vectors, written in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        make = lambda parts: pa.RecordBatch.from_pylist([_packed(*(np.concatenate(p) for p in zip(*parts)))], schema)
        for batch in batches:
            for ids, labels, m in quantise(batch, scale):
                for a in range(0, len(ids), BLOCK):
                    held.setdefault(m.shape[1], []).append((ids[a : a + BLOCK], labels[a : a + BLOCK], m[a : a + BLOCK]))
                    if sum(len(p[0]) for p in held[m.shape[1]]) >= BLOCK:
                        yield make(held.pop(m.shape[1]))
            if sum(p[2].nbytes for parts in held.values() for p in parts) > WAVE_BYTES:  # many lengths at once
                for dim in list(held):
                    yield make(held.pop(dim))
        for parts in held.values():
            yield make(parts)

    schema = pa.schema([("dim", pa.int32()), ("ids", pa.binary()), ("labels", pa.binary()), ("kind", pa.string()), ("matrix", pa.binary())])
    rows = vectors.select(id.cast("long").alias("i"), label.cast("long").alias("l"), vector.cast("array<double>").alias("v"))
    return materialise(rows.where("i IS NOT NULL AND l IS NOT NULL AND v IS NOT NULL").mapInArrow(run, PACKED), name)


def _products(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products as longs."""
    reach = [math.sqrt((m * m).sum(1).max(initial=0)) for m in (a, c)]
    if reach[0] * reach[1] < EXACT:
        return (a @ c.T).astype(np.int64)
    return a.astype(np.int64) @ c.astype(np.int64).T


def _insert(s: np.ndarray, ids: np.ndarray, top_s: np.ndarray, top_i: np.ndarray) -> None:
    """Merge the best of the columns of `s` (NONE: not allowed; ids ascend) into
    the lists of each row, best first, of equal scores the smaller id.  `s` is
    used up; both lists are changed in place."""
    rows = np.arange(len(s))
    while len(rows):
        at = s[rows, :].argmax(1) if len(rows) < len(s) else s.argmax(1)  # the first, so the smallest id
        value, own = s[rows, at], ids[at]
        last_s, last_i = top_s[rows, -1], top_i[rows, -1]
        better = (value > NONE) & ((value > last_s) | ((value == last_s) & (own < last_i)))
        rows, at, value, own = rows[better], at[better], value[better], own[better]
        if not len(rows):
            return
        s[rows, at] = NONE
        place = ((top_s[rows] > value[:, None]) | ((top_s[rows] == value[:, None]) & (top_i[rows] <= own[:, None]))).sum(1)
        k = top_s.shape[1]
        take = np.arange(k)[None, :] - (np.arange(k)[None, :] > place[:, None])
        old_s, old_i = np.take_along_axis(top_s[rows], take, 1), np.take_along_axis(top_i[rows], take, 1)
        here = np.arange(k)[None, :] == place[:, None]
        top_s[rows], top_i[rows] = np.where(here, value[:, None], old_s), np.where(here, own[:, None], old_i)


def _rows(slot: np.ndarray, top_s: np.ndarray, top_i: np.ndarray) -> pa.RecordBatch:
    a, b = np.nonzero(top_s > NONE)
    return pa.record_batch([pa.array(slot[a]), pa.array(top_s[a, b]), pa.array(top_i[a, b])], ["slot", "score", "id"])


def _best(sent, k: int, same: bool, windows):
    """Tasks of one pass: rows (slot, score, id).  Without windows a slot is an
    anchor; with windows it is an anchor and one of its positives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, labels, matrix = sent.value
        bounds = windows.value if windows is not None else None  # (anchors, positives, 2); an empty window has low > high
        n = len(anchors)
        per = bounds.shape[1] if bounds is not None else 1
        top_s, top_i = np.full((per, n, k), NONE), np.full((per, n, k), np.iinfo(np.int64).max)
        for batch in flat.released(batches):
            for row in batch.to_pylist():
                if row["dim"] != matrix.shape[1]:
                    continue
                ids, own, x = _open(row)
                groups = ((slice(a, a + TILE), slice(None)) for a in range(0, n, TILE))
                if same:  # only rows of one label need to meet
                    groups = ((which[a : a + TILE], np.flatnonzero(own == v)) for v in np.intersect1d(labels, own) for which in [np.flatnonzero(labels == v)] for a in range(0, len(which), TILE))
                for rows, columns in groups:
                    s = _products(matrix[rows], x[columns])
                    s[anchors[rows, None] == ids[columns]] = NONE
                    if not same:
                        s[labels[rows, None] == own[columns]] = NONE
                    for j in range(per):
                        part_s, part_i = top_s[j, rows], top_i[j, rows]
                        if bounds is None:
                            _insert(s, ids[columns], part_s, part_i)
                        else:
                            low, high = bounds[rows, j, 0], bounds[rows, j, 1]
                            floor = np.maximum(low, part_s[:, -1])  # a full list's last score has to be reached
                            inside = (s >= floor[:, None]) & (s <= high[:, None])
                            open_ = np.flatnonzero(inside.any(1) & (low <= high))
                            some_s, some_i = part_s[open_], part_i[open_]
                            _insert(np.where(inside[open_], s[open_], NONE), ids[columns], some_s, some_i)
                            part_s[open_], part_i[open_] = some_s, some_i
                        top_s[j, rows], top_i[j, rows] = part_s, part_i
        slots = np.arange(n * per).reshape(n, per)
        for j in range(per):
            yield _rows(slots[:, j], top_s[j], top_i[j])

    return run


def _merged(blocks: DataFrame, sent, k: int, same: bool, windows=None) -> DataFrame:
    """(slot, score, id, rank): the k best of all tasks' lists."""
    found = blocks.mapInArrow(_best(sent, k, same, windows), "slot long, score long, id long")
    order = Window.partitionBy("slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _waves(anchors: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Anchors of one length in turns of bounded rows and bytes; the driver
    holds no more than a turn of each length and one partition's blocks."""
    for (dim,) in sorted(tuple(r) for r in anchors.select("dim").distinct().collect()):  # lengths of vectors
        limit = max(1, min(WAVE, WAVE_BYTES // (8 * max(dim, 1))))
        held, n = [], 0
        for row in anchors.where(F.col("dim") == dim).toLocalIterator():
            part = _open(row.asDict())
            while len(part[0]):
                room = limit - n
                held.append(tuple(p[:room] for p in part))
                n, part = n + len(held[-1][0]), tuple(p[room:] for p in part)
                if n == limit:
                    yield tuple(np.concatenate(p) for p in zip(*held))
                    held, n = [], 0
        if n:
            yield tuple(np.concatenate(p) for p in zip(*held))


def mine(vectors: DataFrame, is_anchor: Column, id: str = "vec_id", label: str | Column = "label", vector: str = "embedding", positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256.0) -> DataFrame:
    """For each anchor and each of its `positives` best rows of the same label,
    the `negatives` best rows of other labels whose score is `low` to `high`
    hundredths of the positive's score."""
    spark = bound_batches(vectors.sparkSession)
    label = F.col(f"`{label}`") if isinstance(label, str) else label
    key, data = F.col(f"`{id}`"), F.col(f"`{vector}`")
    blocks = pack(vectors, scale, key, label, data, "blocks")
    anchors = pack(vectors.where(is_anchor), scale, key, label, data, "anchors")
    folder, turn = new_folder(spark, "negatives"), 0
    spark.createDataFrame([], OUT).write.parquet(f"{folder}/part=0")
    for turn, (ids, labels, matrix) in enumerate(_waves(anchors), 1):
        sent = spark.sparkContext.broadcast((ids, labels, matrix))
        found = _merged(blocks, sent, positives, True).collect()  # at most WAVE * positives rows
        bounds = np.zeros((len(ids), positives, 2), np.int64)
        bounds[:, :, 0] = 1  # empty
        named = []
        for r in found:
            at, score = (r["slot"], r["rank"] - 1), int(r["score"])
            bounds[at] = -(-low * score // 100), high * score // 100
            named.append((r["slot"] * positives + r["rank"] - 1, int(ids[r["slot"]]), r["id"], score))
        windows = spark.sparkContext.broadcast(bounds)
        given = spark.createDataFrame(named, "slot long, anchor_id long, positive_id long, positive_score long")
        chosen = _merged(blocks, sent, negatives, False, windows).join(F.broadcast(given), "slot")  # at most WAVE * positives rows
        chosen.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).coalesce(n_partitions(spark)).write.parquet(f"{folder}/part={turn}")
        windows.destroy()
        sent.destroy()
    discard(blocks, anchors)
    return spark.read.schema(OUT).parquet(*[f"{folder}/part={n}" for n in range(turn + 1)])
