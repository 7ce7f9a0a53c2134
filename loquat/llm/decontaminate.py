"""Benchmark decontamination with SimHash windows and multi-index blocks.

Built from DataFrame functions only.  Texts are lower-cased and split into
words of letters and digits.  For every benchmark item, windows of the item's
length are taken from the documents; window and item fingerprints are SimHash
values of their k-word shingles; a document shorter than the item is one window
as a whole.  The 64 bits are cut into radius + 1 blocks:
two fingerprints within the radius agree in at least one block, so an equi-join
on (item, block, value) finds all of them.  As so many blocks have 2 or 3 bits
each and would hardly tell items apart, a window meets the items alone of whose
rarest shingles it holds one, which every pair alike enough does.  Candidates
are verified exactly: weighted Jaccard similarity of the shingles, weights being
occurrences.

A window that is alike enough, a whole shorter document too, has that share of
its item's shingles, so only windows with as many known shingles are
fingerprinted; that loses none.  The
radius of 23 bits is 4.5 deviations over the distance expected at similarity
0.8 (9.7 of 64 bits).

Defined results: null and empty texts and items without words match nothing; a
text or an item with fewer than k words has its whole sequence as shingle;
repeated documents and items give their rows once per (doc_id, item_id), null
ids included; other columns are not carried."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import discard, free, materialise

LIMIT = 1_000_000  # rows of a few longs that may be broadcast
TEXT = 32 << 20  # bytes of shingles that may be broadcast


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _join(w: Column, i: Column, k: int) -> Column:
    return F.concat_ws(" ", *[F.get(w, i + j) for j in range(k)])


def shingles(w: Column, k: int) -> Column:
    """Shingles in order, as strings; the whole sequence if it is shorter."""
    n = F.size(w)
    return F.when(n >= k, F.transform(F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))), lambda i: _join(w, i, k))).when(n > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>"))


def hashes(w: Column, k: int) -> Column:
    """64-bit hashes of the k-word runs of a word array (none if shorter)."""
    n = F.size(w)
    return F.when(n >= k, F.transform(F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)])))


def simhash(grams: Column) -> Column:
    """64 majority bits of the shingles' hashes."""
    h = F.transform(grams, lambda s: F.xxhash64(s))
    half = F.size(grams)
    bit = lambda b: F.aggregate(h, F.lit(0), lambda acc, x: acc + F.getbit(x, b)) * 2 > half
    total = None
    for b in range(64):
        one = F.when(bit(F.lit(b)), F.lit(1 << b if b < 63 else -(1 << 63))).otherwise(F.lit(0)).cast("long")
        total = one if total is None else total.bitwiseOR(one)
    return total


def blocks(fingerprint: Column, radius: int) -> Column:
    """(number, value) of the radius + 1 blocks."""
    n = radius + 1
    edge = [64 * i // n for i in range(n + 1)]
    return F.array(*[
        F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fingerprint, edge[i]).bitwiseAND(F.lit((1 << (edge[i + 1] - edge[i])) - 1)).alias("value"))
        for i in range(n)
    ])


def first_block(difference: Column, radius: int) -> Column:
    """The first block in which two fingerprints agree, given their xor."""
    n = radius + 1
    edge = [64 * i // n for i in range(n + 1)]
    out = F.lit(-1)
    for i in reversed(range(n)):
        part = F.shiftrightunsigned(difference, edge[i]).bitwiseAND(F.lit((1 << (edge[i + 1] - edge[i])) - 1))
        out = F.when(part == 0, F.lit(i)).otherwise(out)
    return out


def common_weight(a: Column, b: Column) -> Column:
    """Common weight of two shingle arrays, weights being occurrences."""
    count = lambda grams, g: F.size(F.filter(grams, lambda x: x == g))
    counted = F.aggregate(F.array_distinct(b), F.lit(0), lambda acc, g: acc + F.least(count(a, g), count(b, g)))
    once = (F.size(F.array_distinct(a)) == F.size(a)) | (F.size(F.array_distinct(b)) == F.size(b))
    return F.when(once, F.size(F.array_intersect(a, b))).otherwise(counted)


def window_starts(pos: Column, length: Column, k: int, threshold: float) -> Column:
    """Starts of all windows of `length` words that can be alike enough.

    pos: sorted word positions of shingles that items of this length hold.  A
    window's common weight is at most the number of these inside it, and must
    be `threshold` of the item's shingles; so the window spans at least that
    many neighbours of `pos`.  A shorter document that has enough of them gets
    start 0 among others, as its positions are all within reach."""
    reach = length - F.least(length, F.lit(k))  # a shingle starts at most so far into a window
    need = F.greatest(F.ceil((reach + 1) * threshold - 1e-9).cast("int"), F.lit(1))
    last = lambda i: F.get(pos, i + need - 1)
    starts = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(pos) - need, F.lit(0))),
        lambda i: F.when(last(i) - F.get(pos, i) <= reach, F.sequence(F.greatest(last(i) - reach, F.lit(0)), F.get(pos, i))).otherwise(F.array().cast("array<int>")),
    )
    return F.array_sort(F.array_distinct(F.flatten(F.filter(starts, lambda x: x.isNotNull()))))


def known_shingles(grams: Column) -> Column:
    return F.array_distinct(F.transform(grams, lambda g: F.xxhash64(g)))


def rarest(items: DataFrame, threshold: float) -> DataFrame:
    """(length, h, _item): of each item so many of its rarest shingles that a
    window without any of them lacks more than 1 - threshold of the item."""
    held = items.select("_item", "length", F.size("grams").alias("n"), F.explode(known_shingles(F.col("grams"))).alias("h"))
    count = held.groupBy("length", "h").agg(F.count("*").alias("holders"))
    place = F.row_number().over(Window.partitionBy("_item").orderBy("holders", "h"))
    ranked = held.join(count, ["length", "h"]).withColumn("place", place)
    return ranked.where(F.col("place") <= F.floor(F.col("n") * (1 - threshold) + 1e-9) + 1).select("length", "h", "_item")


def contaminated(docs: DataFrame, benchmark: DataFrame, k: int = 5, threshold: float = 0.8, radius: int = 23) -> DataFrame:
    """Rows (doc_id, item_id, similarity, start_word): a document's best window
    for each item that it holds."""
    items = benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0).withColumn("length", F.size("w"))
    items = items.withColumn("grams", shingles(F.col("w"), k)).withColumn("fingerprint", simhash(F.col("grams")))
    items = materialise(items.withColumn("_item", F.monotonically_increasing_id()), "items")
    sizes = sorted(r[0] for r in items.select(F.least("length", F.lit(k))).distinct().collect())  # at most k numbers
    rows, n_items, letters = items.select(F.count("*"), F.coalesce(F.sum("length"), F.lit(0)), F.coalesce(F.sum(F.aggregate("grams", F.lit(0), lambda n, g: n + F.octet_length(g))), F.lit(0))).first()
    small = lambda df, n: F.broadcast(df) if n <= LIMIT else df
    anchors = None
    text = docs.select("doc_id", words(F.col("text")).alias("w"))
    for g in sizes or [k]:
        known = items.where(F.least("length", F.lit(k)) == g).select("length", F.explode(hashes(F.col("w"), g)).alias("h")).distinct()
        runs = text.select("doc_id", F.posexplode(hashes(F.col("w"), g)).alias("pos", "h"))
        hit = runs.join(small(known, n_items), "h").select("doc_id", "length", "pos")
        anchors = hit if anchors is None else anchors.unionByName(hit)
    anchors = anchors.groupBy("doc_id", "length").agg(F.array_sort(F.collect_set("pos")).alias("pos"))
    anchors = anchors.withColumn("starts", window_starts(F.col("pos"), F.col("length"), k, threshold)).where(F.size("starts") > 0)
    anchors = anchors.groupBy("doc_id").agg(F.collect_list(F.struct("length", "starts")).alias("windows"))
    anchors = materialise(anchors.select(F.col("doc_id").alias("_id"), "windows"), "anchors")
    n_docs = anchors.select(F.sum(F.aggregate("windows", F.lit(0), lambda n, x: n + F.size(x["starts"])))).first()[0] or 0
    near = docs.select("doc_id", "text").join(small(anchors, n_docs), F.col("doc_id").eqNullSafe(F.col("_id"))).select("doc_id", words(F.col("text")).alias("w"), "windows")
    window = lambda n, at: F.struct(n.alias("length"), at.alias("start"), F.slice("w", at + 1, n).alias("w"))
    cut = F.flatten(F.transform("windows", lambda x: F.transform(x["starts"], lambda at: window(x["length"], at))))
    near = near.select("doc_id", F.explode(cut).alias("x")).select("doc_id", "x.*")
    # a window that the document's end cuts short counts only as the whole document
    near = near.where((F.size("w") == F.col("length")) | (F.col("start") == 0)).select("doc_id", "length", "start", shingles(F.col("w"), k).alias("grams")).distinct()
    near = materialise(near.withColumn("fingerprint", simhash(F.col("grams"))).withColumn("_window", F.monotonically_increasing_id()), "windows")
    # a pair that is alike enough shares one of the item's rarest shingles
    found = near.select("_window", "length", "fingerprint", F.explode(known_shingles(F.col("grams"))).alias("h"))
    pairs = found.join(small(rarest(items, threshold), n_items), ["length", "h"]).select("_window", "fingerprint", "_item").distinct()
    left = pairs.select("*", F.explode(blocks(F.col("fingerprint"), radius)).alias("x")).select("*", "x.*").drop("x")
    right = items.select("_item", F.col("fingerprint").alias("item_fingerprint"), F.explode(blocks(F.col("fingerprint"), radius)).alias("x")).select("*", "x.*").drop("x")
    difference = F.col("fingerprint").bitwiseXOR(F.col("item_fingerprint"))
    close = left.join(small(right, rows * (radius + 1)), ["_item", "block", "value"]).where(F.bit_count(difference) <= radius)
    # of the blocks in which a pair agrees, the first one stands for it
    close = close.where(first_block(difference, radius) == F.col("block")).select("_window", "_item")
    held = items.select("_item", "item_id", F.col("grams").alias("item_grams"))
    held = F.broadcast(held) if letters <= TEXT else held
    close = close.join(near.select("_window", "doc_id", "start", "grams"), "_window").join(held, "_item")
    close = close.withColumn("common", common_weight(F.col("grams"), F.col("item_grams")))
    scored = close.withColumn("similarity", F.col("common") / (F.size("grams") + F.size("item_grams") - F.col("common"))).where(F.col("similarity") >= threshold)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("best")
    out = scored.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.similarity", (-F.col("best.back")).cast("long").alias("start_word"))
    out = materialise(out, "contaminated")
    discard(items, anchors, near)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, k: int = 5, threshold: float = 0.8, radius: int = 23) -> DataFrame:
    """The documents that hold no benchmark item; all columns pass through."""
    key = free(docs, "_leak")
    found = materialise(contaminated(docs, benchmark, k, threshold, radius).select(F.col("doc_id").alias(key)).distinct(), "leaks")
    n = found.count()
    side = F.broadcast(found) if n <= LIMIT else found
    return docs.join(side, docs["doc_id"].eqNullSafe(found[key]), "left_anti")
