"""Best-fit packing of token pieces into sequences, in bulk-synchronous rounds.

Documents become token pieces of at most the capacity (only longer documents
are cut, the first piece taking the remainder).  Pieces over half the capacity
open a sequence each; then, in rounds, the other pieces and the gaps are sorted
by size, each piece takes its successor, the smallest gap that holds it, ranks
inside a size decide who gets which gap, the gaps shrink, and the next round
begins; where no gap is left, new sequences are opened.

The sort is a counting sort: sizes are integers up to the capacity, so the
ranges are the sizes themselves, and every piece and gap learns its rank in its
range where it lies (per salt, with offsets between salts).  All that a sweep
over the sorted pieces and gaps can depend on is then how many of each size
there are.  So the order of the ranges is swept on the driver, over two
histograms of at most `capacity` numbers whatever the input, as range bounds
of any distributed sort are found there; which piece meets which gap is decided
by (size, rank) in a join, in all tasks alike.

Defined results: null or empty text is one piece that holds the end token
alone; repeated rows are packed as often as they occur; an empty table gives an
empty result; other columns are not carried."""

from __future__ import annotations

import bisect
import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import flat
from .shared import bound_batches, materialise, n_partitions

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def encoder(vocabulary: str | None = None, ranks: str | None = None):
    """Text to ids (numpy uint32) of the byte-level BPE vocabulary.

    `vocabulary` is the tokenizers file and defines the ids.  `ranks` is the
    same vocabulary in the form of a faster encoder; texts that hold a special
    token's string go to the tokenizers library, as only it splits those."""
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(vocabulary or tokenizer_path("byte_bpe_50k.json"))
    special = [t.content for t in slow.get_added_tokens_decoder().values()]
    with open(ranks or tokenizer_path("byte_bpe_50k.tiktoken"), "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if any(s in text for s in special):
            return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(fast.encode_ordinary(text), np.uint32)

    return encode


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids."""
    first = n % capacity or capacity
    out = [(0, min(first, n))]
    while sum(out[-1]) < n:
        out.append((sum(out[-1]), capacity))
    return out


def pieces(docs: DataFrame, capacity: int = 1024, end: int = 2, vocabulary: str | None = None, ranks: str | None = None, with_ids: bool = False) -> DataFrame:
    """A row per piece; `with_ids` adds the piece's ids."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(vocabulary, ranks)
        for frame in flat.released(batches):
            rows = []
            for doc_id, text in zip(frame["doc_id"].astype(object), frame["text"]):
                ids = np.append(encode(text) if isinstance(text, str) and text else np.zeros(0, np.uint32), np.uint32(end)).astype("<u4")
                for k, (at, n) in enumerate(cuts(len(ids), capacity)):
                    part = ids[at : at + n]
                    rows.append((None if doc_id is None or doc_id != doc_id else int(doc_id), k, at, n, zlib.crc32(part.tobytes())) + ((part.astype(np.int64),) if with_ids else ()))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(cut, PIECES + ", ids array<long>" * with_ids)


def ranked(df: DataFrame, key: str, unique: str, name: str) -> DataFrame:
    """Add `name`: place from 0 among the rows of equal `key`.  Each key is
    dealt over several salts, so a common key is no single task's work."""
    salts = 4 * n_partitions(df.sparkSession)
    df = df.withColumn("_salt", F.pmod(F.xxhash64(unique), F.lit(salts)))
    before = Window.partitionBy(key).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = df.groupBy(key, "_salt").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    local = df.withColumn("_local", F.row_number().over(Window.partitionBy(key, "_salt").orderBy(unique)) - 1)
    return local.join(offsets, [key, "_salt"]).withColumn(name, (F.col("_before") + F.col("_local")).cast("long")).drop("_salt", "_before", "_local")


def sweep(docs: np.ndarray, gaps: np.ndarray) -> list[tuple[int, int, int, int, int, int, int]]:
    """One round over the histograms of piece lengths and gap sizes.

    Longest first, each length takes the smallest gaps that hold it, as many
    pieces to a gap as fit.  Returns (length, first piece rank, pieces, gap,
    first gap rank, gaps, pieces a gap), ranks counted within this round."""
    left, free = docs.copy(), gaps.copy()
    sizes = [int(g) for g in np.flatnonzero(free)]
    out = []
    for n in np.flatnonzero(docs)[::-1]:
        n = int(n)
        while left[n]:
            i = bisect.bisect_left(sizes, n)
            if i == len(sizes):
                break
            g = sizes[i]
            each = g // n
            used = int(min(free[g], -(-left[n] // each)))
            put = int(min(left[n], used * each))
            out.append((n, int(docs[n] - left[n]), put, g, int(gaps[g] - free[g]), used, each))
            left[n] -= put
            free[g] -= used
            if not free[g]:
                sizes.pop(i)
    return out


def best_fit(items: DataFrame, capacity: int = 1024) -> DataFrame:
    """Add sequence_id and offset to rows with a `length` from 1 to capacity."""
    spark = items.sparkSession
    items = materialise(items.withColumn("_item", F.monotonically_increasing_id()), "pieces")
    count = np.zeros(capacity + 1, np.int64)
    for r in items.groupBy("length").count().collect():  # at most `capacity` rows
        count[r["length"]] = r["count"]
    half = capacity // 2
    alone = items.where(F.col("length") > half).withColumn("sequence_id", F.col("_item")).withColumn("offset", F.lit(0).cast("long"))
    docs, gaps = count.copy(), np.zeros(capacity + 1, np.int64)
    docs[half + 1 :] = 0
    gaps[1 : capacity - half] = count[half + 1 : capacity][::-1]
    if not docs.any():
        return alone.drop("_item")
    smallest = int(np.flatnonzero(docs)[0])
    gaps[:smallest] = 0
    state = alone.select(F.col("_item").alias("bin"), (F.lit(capacity) - F.col("length")).alias("gap")).where(F.col("gap") >= smallest)
    taken, opened, plan, frames, step = np.zeros(capacity + 1, np.int64), 0, [], [], 0
    while docs.any():
        found = sweep(docs, gaps)
        after = gaps.copy()
        for n, first, put, g, rank, used, each in found:
            plan.append((step, n, int(taken[n]) + first, int(taken[n]) + first + put, g, rank, each))
            docs[n] -= put
            after[g] -= used
            whole, rest = divmod(put, each)
            after[g - each * n] += whole
            if rest:
                after[g - rest * n] += 1
        for n in {f[0] for f in found}:
            taken[n] += sum(f[2] for f in found if f[0] == n)
        waiting = int((docs * np.arange(capacity + 1)).sum())
        more = 0
        if waiting:
            least = int(np.flatnonzero(docs)[0])
            after[:least] = 0
            more = math.ceil(max(0, waiting - int((after * np.arange(capacity + 1)).sum())) / capacity)
            if not found:
                more = max(more, 1)
        if found:
            state = materialise(ranked(state, "gap", "bin", "rank"), "gaps")
            frames.append(state.select(F.lit(step).alias("round"), "gap", "rank", "bin"))
            rows = [(g, rank, rank + used, n, put, each) for n, _, put, g, rank, used, each in found]
            hits = F.broadcast(spark.createDataFrame(rows, "gap long, first long, last long, n long, put long, each long"))
            own = state.join(hits, (state["gap"] == hits["gap"]) & (state["rank"] >= hits["first"]) & (state["rank"] < hits["last"]), "left").drop(hits["gap"])
            inside = F.least(F.col("each"), F.col("put") - (F.col("rank") - F.col("first")) * F.col("each")) * F.col("n")
            state = own.select("bin", (F.col("gap") - F.coalesce(inside, F.lit(0))).alias("gap"))
        if waiting:
            state = state.where(F.col("gap") >= least)
        if more:
            fresh = spark.range(more).select((-F.col("id") - F.lit(opened + 1)).alias("bin"), F.lit(capacity).cast("long").alias("gap"))
            state, opened = state.unionByName(fresh), opened + more
            after[capacity] += more
        gaps = after
        step += 1
    places = F.broadcast(spark.createDataFrame(plan, "round int, length long, first long, last long, gap long, gap_rank long, each long"))
    rest = ranked(items.where(F.col("length") <= half), "length", "_item", "_rank")
    rest = rest.join(places, (rest["length"] == places["length"]) & (rest["_rank"] >= places["first"]) & (rest["_rank"] < places["last"])).drop(places["length"])
    turn = F.col("_rank") - F.col("first")
    rest = rest.withColumn("rank", F.col("gap_rank") + F.floor(turn / F.col("each"))).withColumn("offset", (F.lit(capacity) - F.col("gap") + (turn % F.col("each")) * F.col("length")).cast("long"))
    bins = frames[0]
    for f in frames[1:]:
        bins = bins.unionByName(f)
    rest = rest.join(bins, ["round", "gap", "rank"]).withColumn("sequence_id", F.col("bin"))
    return alone.unionByName(rest.select(alone.columns)).drop("_item")


def pack(docs: DataFrame, capacity: int = 1024, end: int = 2, vocabulary: str | None = None, ranks: str | None = None) -> DataFrame:
    return best_fit(pieces(docs, capacity, end, vocabulary, ranks), capacity)


def sequences(docs: DataFrame, capacity: int = 1024, end: int = 2, vocabulary: str | None = None, ranks: str | None = None) -> DataFrame:
    """The packed sequences themselves: sequence_id and its ids in order."""
    packed = best_fit(pieces(docs, capacity, end, vocabulary, ranks, with_ids=True), capacity)
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # at most `capacity` pieces
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
