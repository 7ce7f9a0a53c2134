"""Quartile bucket digests of texts.

Byte triplets (three from every four-byte window) are hashed into 128 buckets
and counted; the digest holds for each bucket the quartile of its count, and a
logarithmic code of the length.  Two digests differ by 1, 2 or 6 for a bucket
one, two or three quartiles apart and by 1 for each step of length over one;
the difference is bounded by the one expected of independent digests, and
likeness is 1 minus its share of that bound.

Defined results: null text is empty; texts under three bytes have no triplet
and a digest of zero quartiles; equal texts have equal digests.  Documents with
equal ids follow each other by text; a null id sorts first; an empty table
gives an empty result; other columns are not carried."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flat
from .shared import bound_batches, n_partitions

BUCKETS = 128
BOUND = 1.625 * BUCKETS  # expected difference of independent quartiles: (6*1 + 4*2 + 2*6) / 16 a bucket
STEP = np.array([0, 1, 2, 6])
NULL_ID = -(2**63)
OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def counts(raw: list) -> np.ndarray:
    """Bucket counts of byte strings: (texts, BUCKETS)."""
    n = len(raw)
    size = np.fromiter(map(len, raw), np.int64, n)
    byte = np.frombuffer(b"".join(raw), np.uint8)
    if len(byte) < 3:
        return np.zeros((n, BUCKETS), np.int64)
    base = np.repeat((np.arange(n) * BUCKETS).astype(np.int32), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(byte))  # bytes to the text's end
    x = byte.astype(np.uint32)
    a, b, c = x * np.uint32(0x9E3779B1), x * np.uint32(0x85EBCA77), x * np.uint32(0xC2B2AE3D)
    total = np.zeros(n * BUCKETS, np.int64)
    for salt, (i, j) in enumerate(((1, 2), (1, 3), (2, 3))):
        m = len(x) - j
        if m <= 0:
            continue
        h = a[:m] + b[i : i + m] + c[j : j + m] + np.uint32(0x27D4EB2F * (salt + 1) & 0xFFFFFFFF)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        total += np.bincount((base[:m] + (h >> np.uint32(25)).astype(np.int32))[left[:m] > j], minlength=len(total))
    return total.reshape(n, BUCKETS)


def codes(raw: list) -> np.ndarray:
    """(texts, BUCKETS + 1): quartile codes and the length code."""
    c = counts(raw)
    s = np.sort(c, 1)
    q = sum((c > s[:, [BUCKETS * k // 4 - 1]]).astype(np.int16) for k in (1, 2, 3))
    size = np.fromiter(map(len, raw), np.float64, len(raw))
    return np.column_stack([q, np.minimum(255, np.floor(np.log1p(size) / np.log(1.1)))]).astype(np.int16)


def text_codes(texts: list) -> np.ndarray:
    out = [np.zeros((0, BUCKETS + 1), np.int16)]
    for a, b in flat.chunks(texts):
        out.append(codes([t.encode("utf-8", "surrogatepass") for t in texts[a:b]]))
    return np.concatenate(out)


def write(code: np.ndarray) -> list:
    """Hex strings: length code, then four quartiles a byte."""
    q = code[:, :BUCKETS].reshape(len(code), -1, 4).astype(np.uint8)
    packed = (q[:, :, 0] << 6) | (q[:, :, 1] << 4) | (q[:, :, 2] << 2) | q[:, :, 3]
    rows = np.column_stack([code[:, BUCKETS].astype(np.uint8), packed]).astype(np.uint8)
    return [r.tobytes().hex() for r in rows]


def likeness(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = STEP[np.abs(x[:, :BUCKETS] - y[:, :BUCKETS])].sum(1) + np.maximum(0, np.abs(x[:, BUCKETS] - y[:, BUCKETS]) - 1)
    return 1 - np.minimum(d, BOUND) / BOUND


def edited(text: str, following: str) -> str:
    """The last quarter of the code points gives way to the first as many of the next text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def in_order(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, wrap, key, doc_id, text): documents in ranges of doc_id, and in
    each range, with wrap 1, the first document of the next one (after the last
    range: of the first).  Only ids are looked at beforehand."""
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))
    ids = docs.select(key.alias("key"))
    bounds = ids.select(F.percentile_approx("key", [i / buckets for i in range(1, buckets)] or [0.5], 20 * buckets)).first()[0]
    bounds = np.unique(np.array(bounds or [], np.int64))

    @F.pandas_udf("int")
    def bucket(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, k.to_numpy(), "right"))

    heads = sorted((r["bucket"], r["head"]) for r in ids.groupBy(bucket("key").alias("bucket")).agg(F.min("key").alias("head")).collect())  # one row a range
    into = {head: heads[i - 1][0] for i, (_, head) in enumerate(heads)}
    sent = spark.sparkContext.broadcast(into)

    @F.pandas_udf("array<int>")
    def places(k: pd.Series) -> pd.Series:
        own = np.searchsorted(bounds, k.to_numpy(), "right")
        return pd.Series([[int(b)] if v not in sent.value else [int(b), sent.value[v]] for b, v in zip(own, k)])

    rows = docs.select(key.alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.select("*", F.posexplode(places("key")).alias("wrap", "bucket"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Digests of each document and of its edited text, with likenesses."""
    parts = n_partitions(bound_batches(docs.sparkSession))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None  # (bucket, doc_id, text) that waits for its follower
        for frame in flat.released(frames):
            ids = [None if v is None or v != v else int(v) for v in frame["doc_id"].astype(object)]
            rows = list(zip(frame["bucket"], frame["wrap"], ids, frame["text"]))
            for a in range(0, len(rows), 2000):
                own, following = [], []
                for b, wrap, doc_id, text in rows[a : a + 2000]:
                    if last is not None and last[0] == b:
                        own.append(last[1:])
                        following.append(text)
                    last = (b, doc_id, text) if not wrap else None
                if not own:
                    continue
                texts = [t for _, t in own]
                new = [edited(t, f) for t, f in zip(texts, following)]
                # a follower is mostly the next row's own text
                code, other = text_codes(texts + [following[-1]]), text_codes(new)
                shifted = code[1:].copy()
                odd = [i for i in range(len(own) - 1) if following[i] is not texts[i + 1] and following[i] != texts[i + 1]]
                if odd:
                    shifted[odd] = text_codes([following[i] for i in odd])
                out = pd.DataFrame({
                    "doc_id": pd.array([i for i, _ in own], "Int64"),
                    "n_chars": [len(t) for t in texts],
                    "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in new],
                    "fingerprint": write(code[:-1]),
                    "edited_fingerprint": write(other),
                    "near_edited": likeness(code[:-1], other),
                    "near_next": likeness(code[:-1], shifted),
                })
                yield out

    ordered = in_order(docs, 4 * parts).repartition(parts, "bucket").sortWithinPartitions("bucket", "wrap", "key", "text")
    return ordered.select("bucket", "wrap", "doc_id", "text").mapInPandas(run, OUT)
