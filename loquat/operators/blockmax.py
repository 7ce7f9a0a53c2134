"""Pruned top-k search over block-max postings.

The chunks are dealt into blocks of about 32 of like length and numbered there.
A posting row is (token, block): the largest part of a BM25 score that the token
gives there (`impact`), the number of chunks, and the packed chunks, as their
places in the block with their counts.  A chunk moves once, as its words, to
where its block is; all postings of a block are made there, by numpy.

Queries of equal words are one group.  A search keeps the postings of the query
words as one row a block.  Groups go to the tasks, where a few blocks at a time
are a matrix of impacts, so the bounds of all pairs of a group and a block are
sums of its rows and no such pair is a row of a frame.  The sum of the impacts
bounds every score of a block.  The blocks of the highest bounds, `probe` and k
at most and no more than may hold `probe` times k matches, are scored and give
the k-th score so far; then only blocks whose bound reaches that score, or the
k-th that their task has found since, are unpacked.
The rows are those of `fts.search`, as no block that could hold one is left out.

An index is of a frozen set of chunks: its mean length is part of the impacts.
Phrases of several tokens need all their occurrences for their own frequency,
so queries that have one are given to `rest`, a full search."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.text import tokens
from . import fts, written

BANDS, NINE = 64, 1e-8  # ranges of lengths; scores are compared to nine places


PACKED = "block long, token string, n int, impact double, docs array<struct<slot:int,f:int>>"


def _packed(rows: pa.Table, mean: float) -> pa.RecordBatch:
    """The postings of whole blocks, given as chunks (block, slot, len, w)."""
    block, slot, length = (rows[c].to_numpy() for c in ("block", "slot", "len"))
    words = pc.split_pattern(pc.filter(rows["w"], pa.array(length > 0)), " ").combine_chunks().flatten().dictionary_encode()
    token, known = words.indices.to_numpy().astype(np.int64), len(words.dictionary) or 1
    chunk = np.repeat(np.arange(len(block)), length)
    one, f = np.unique(chunk * known + token, return_counts=True)
    chunk, token = one // known, one % known
    order = np.lexsort((slot[chunk], token, block[chunk]))
    chunk, token, f = chunk[order], token[order], f[order]
    new = np.ones(len(chunk), bool)
    new[1:] = (block[chunk][1:] != block[chunk][:-1]) | (token[1:] != token[:-1])
    first = np.flatnonzero(new)
    impact = f * (C.K1 + 1) / (f + C.K1 * (1 - C.B + C.B * length[chunk] / mean))
    ends = np.append(first, len(chunk))
    docs = pa.StructArray.from_arrays([pa.array(slot[chunk], pa.int32()), pa.array(f, pa.int32())], ["slot", "f"])
    return pa.RecordBatch.from_arrays([
        pa.array(block[chunk[first]], pa.int64()), words.dictionary.take(pa.array(token[first])), pa.array(np.diff(ends), pa.int32()),
        pa.array(np.maximum.reduceat(impact, first) if len(first) else impact, pa.float64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), docs)], ["block", "token", "n", "impact", "docs"])


def _pack(mean: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chunks come by block, so only a batch's last block may go on in the next one."""
        open_ = []
        for batch in batches:
            block = batch["block"].to_numpy()
            if not len(block):
                continue
            last = int(np.searchsorted(block, block[-1]))
            if last or (open_ and open_[0]["block"][0].as_py() != block[0]):
                yield _packed(pa.Table.from_batches([*open_, batch.slice(0, last)]), mean)
                open_ = []
            open_.append(batch.slice(last))
        if open_:
            yield _packed(pa.Table.from_batches(open_), mean)

    return run


def save(chunks: DataFrame, folder: str, per_block: int = 32) -> None:
    """Write the index of `chunks` anew: `sizes`, `about` (one row) and `blocks`."""
    every = F.flatten(F.array(*[F.coalesce(tokens(F.col(c)), F.array().cast("array<string>")) for c in fts.COLUMNS]))
    words = chunks.select("id", "domain", "topic", F.explode(F.array(every)).alias("w"))  # exploding keeps the words a column
    # one string a chunk is written and dealt faster than its words; a word holds no blank
    words = written.written(words.select("id", "domain", "topic", F.size("w").alias("len"), F.array_join("w", " ").alias("w")), "words")
    sizes = words.select("id", "len", "domain", "topic")
    about = sizes.agg(F.count("*").alias("docs"), F.avg("len").alias("mean"))
    about.write.mode("overwrite").parquet(f"{folder}/about")
    docs, mean = about.first()
    blocks = max(1, docs // per_block)
    bands = min(BANDS, blocks)
    cuts = sizes.select(F.percentile_approx("len", [i / bands for i in range(1, bands)] or [0.5], 10_000)).first()[0] or []
    cuts = sorted(set(cuts)) if bands > 1 else []
    splits = -(-blocks // (len(cuts) + 1))
    band = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col("len"))) if cuts else F.lit(0)
    block = (band.cast("long") * splits + F.pmod(F.xxhash64("id"), F.lit(splits))).alias("block")
    slot = (F.row_number().over(Window.partitionBy("block").orderBy("id")) - 1).alias("slot")
    known = words.where("id IS NOT NULL")
    known.select(block, "id", "len", "domain", "topic").select("block", slot, "id", "len", "domain", "topic").write.mode("overwrite").parquet(f"{folder}/sizes")
    # dealt by block once; places, counts and packing stay where their block is
    rows = known.select(block, "id", "len", "w").repartition("block").select("block", slot, "len", "w").sortWithinPartitions("block")
    written.bound_batches(chunks.sparkSession)
    packed = rows.mapInArrow(_pack(mean or 1.0), PACKED)
    packed.sortWithinPartitions("token", "block").write.mode("overwrite").parquet(f"{folder}/blocks")
    written.discard(words)


def _held(blocks: DataFrame, sizes: DataFrame, terms: DataFrame, kept: Column) -> DataFrame:
    """(block, f, members): one row a block.  `f` has (term, n, impact, docs) of
    the terms it has, `members` the chunks by place."""
    entry = F.struct("term", "n", "impact", "docs")
    f = blocks.join(fts.bounded(terms), "token").groupBy("block").agg(F.collect_list(entry).alias("f"))
    members = sizes.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("slot", "id", "len", kept.alias("kept")))).alias("members"))
    return f.join(members, "block")


class Groups:
    """Groups of queries as arrays, in the order of their numbers; `parts` has
    for each place in a group's terms, the rarest first, the groups that have
    it, their terms and idf.  Terms are places in `terms`."""

    def __init__(self, asked: pa.Table):
        asked = asked.sort_by("group").combine_chunks()
        self.group, self.least = asked["group"].to_numpy(), asked["least"].to_numpy()
        self.mean = float(asked["mean"][0].as_py()) if len(asked) else 1.0
        parts = asked["parts"].combine_chunks()
        size = pc.list_value_length(parts).to_numpy()
        entry = parts.flatten()
        self.terms, term = np.unique(entry.field("term").to_numpy(), return_inverse=True)
        idf, begin = entry.field("idf").to_numpy(), np.cumsum(size) - size
        self.parts = []
        for j in range(size.max(initial=0)):
            own = np.flatnonzero(size > j)
            at = np.full((2, len(size)), -1, np.int64), np.zeros(len(size))
            at[0][0, own], at[1][own] = term[begin[own] + j], idf[begin[own] + j]
            self.parts.append((at[0][0], at[1]))  # -1: the group has no such term


class Blocks:
    """Blocks of `held` as arrays: `entry` leads from a term of the groups and a
    block to its packed chunks, -1 if there are none, `impact` to their impact."""

    def __init__(self, rows: pa.RecordBatch, groups: Groups):
        self.groups, self.number = groups, rows["block"].to_numpy()
        f, members = rows["f"], rows["members"].flatten()
        entry, self.id = f.flatten(), members.field("id")
        self.length, self.kept = members.field("len").to_numpy(), members.field("kept").to_numpy(zero_copy_only=False)
        size = pc.list_value_length(rows["members"]).to_numpy()
        block = np.repeat(np.arange(len(self.number)), pc.list_value_length(f).to_numpy())
        term = entry.field("term").to_numpy()
        at = np.minimum(np.searchsorted(groups.terms, term), max(len(groups.terms) - 1, 0))
        docs, used = entry.field("docs"), np.flatnonzero(groups.terms[at] == term)
        self.n = pc.list_value_length(docs).to_numpy()
        self.begin = np.cumsum(self.n) - self.n
        self.chunk = np.repeat((np.cumsum(size) - size)[block], self.n) + docs.flatten().field("slot").to_numpy()
        self.f = docs.flatten().field("f").to_numpy()
        self.entry = np.full((len(groups.terms), len(self.number)), -1, np.int32)
        self.entry[at[used], block[used]] = used
        self.impact = np.zeros(self.entry.shape)
        self.impact[at[used], block[used]] = entry.field("impact").to_numpy()[used]
        # where a chunk has a term: the places of all postings, by term and chunk
        mine = np.flatnonzero(np.repeat(np.isin(np.arange(len(term)), used), self.n))
        key = np.repeat(at, self.n)[mine] * len(self.length) + self.chunk[mine]
        order = np.argsort(key)
        self.key, self.place = key[order], mine[order]

    def bounds(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Groups and the bounds of their scores in each block, minus infinity
        where a term is missing; groups that miss one everywhere are left out."""
        held = (self.entry >= 0).any(1)
        alive = np.ones(len(self.groups.group), bool)
        for term, _ in self.groups.parts:
            alive &= (term < 0) | held[term]
        alive = np.flatnonzero(alive)
        step = max(1, 1_000_000 // max(1, len(self.number)))
        for i in range(0, len(alive), step):
            own = alive[i : i + step]
            bound, missing = np.zeros((len(own), len(self.number))), np.zeros((len(own), len(self.number)), bool)
            for term, idf in self.groups.parts:
                has = np.flatnonzero(term[own] >= 0)
                impact = self.impact[term[own[has]]]
                bound[has] += idf[own[has], None] * impact
                missing[has] |= impact == 0
            bound[missing] = -np.inf
            yield own, bound

    def packed(self, own: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of pairs of a group and a block the packed entries of all terms, and
        the fewest of a term."""
        total, fewest = np.zeros(len(own), np.int64), np.full(len(own), 1 << 30)
        for term, _ in self.groups.parts:
            has = term[own] >= 0
            n = self.n[self.entry[term[own[has]], block[has]]]
            total[has] += n
            fewest[has] = np.minimum(fewest[has], n)
        return total, fewest

    def scores(self, own: np.ndarray, block: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Groups, chunks and scores of those chunks of pairs of a group and a
        block that have all terms."""
        if not len(own):
            return
        rare = self.entry[self.groups.parts[0][0][own], block]
        own, rare = own[rare >= 0], rare[rare >= 0]
        n = self.n[rare]
        for part in np.split(np.arange(len(own)), np.flatnonzero(np.diff(np.cumsum(n) // 500_000)) + 1):
            size = n[part]
            group = np.repeat(own[part], size)
            place = np.arange(len(group)) + np.repeat(self.begin[rare[part]] - (np.cumsum(size) - size), size)
            chunk, score = self.chunk[place], np.zeros(len(group))
            for j, (term, idf) in enumerate(self.groups.parts):
                has = np.flatnonzero(term[group] >= 0)
                at = place[has] if j == 0 else None
                if at is None:
                    key = term[group[has]] * len(self.length) + chunk[has]
                    i = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
                    found, at = self.key[i] == key, self.place[i]
                    stays = np.ones(len(group), bool)
                    stays[has[~found]] = False
                    has, at = (np.cumsum(stays) - 1)[has[found]], at[found]
                    group, chunk, score = group[stays], chunk[stays], score[stays]
                f, length = self.f[at], self.length[chunk[has]]
                score[has] += idf[group[has]] * (f * (C.K1 + 1) / (f + C.K1 * (1 - C.B + C.B * length / self.groups.mean)))
            kept = self.kept[chunk]
            yield group[kept], chunk[kept], score[kept]


def _parsed(batches: Iterator[pa.RecordBatch], groups: Groups) -> Iterator[tuple[pa.RecordBatch, Blocks]]:
    step = max(1, 4_000_000 // max(1, len(groups.terms)))
    for batch in batches:
        for i in range(0, batch.num_rows if len(groups.group) else 0, step):
            yield batch.slice(i, step), Blocks(batch.slice(i, step), groups)


def _rows(blocks: Blocks, found: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for group, chunk, score in found:
        columns = [pa.array(blocks.groups.group[group]), blocks.id.take(pa.array(chunk)), pa.array(score)]
        yield pa.RecordBatch.from_arrays(columns, ["group", "id", "score"])


class Reach:
    """What a score has to reach in a task: `least` of its group, or the k-th
    best score that the task has seen, if that is higher.  Equal ones reach it."""

    def __init__(self, least: np.ndarray, k: int):
        self.least, self.best = least.copy(), np.full((len(least), k), -np.inf)

    def __call__(self, found: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        k = self.best.shape[1]
        for group, chunk, score in found:
            order = np.lexsort((-score, group))
            order = order[score[order] >= self.least[group[order]]]
            group, chunk, score = group[order], chunk[order], score[order]
            own, first, n = np.unique(group, return_index=True, return_counts=True)
            rank, at = np.arange(len(group)) - np.repeat(first, n), np.repeat(np.arange(len(own)), n)
            new = np.full((len(own), k), -np.inf)
            new[at[rank < k], rank[rank < k]] = score[rank < k]
            self.best[own] = -np.partition(-np.concatenate([self.best[own], new], 1), k - 1, 1)[:, :k]
            self.least[own] = np.maximum(self.least[own], self.best[own].min(1) - NINE)
            high = score >= self.least[group]
            yield group[high], chunk[high], score[high]


def _highest(sent: Broadcast, most: int):
    """The blocks of the `most` highest bounds that a task has for each group."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = sent.value
        shape = (len(groups.group), most)
        top, kept = np.full(shape, -np.inf), np.zeros((3, *shape), np.int64)
        for _, blocks in _parsed(batches, groups):
            for own, bound in blocks.bounds():
                best = min(most, bound.shape[1])
                at = np.argpartition(-bound, best - 1, 1)[:, :best]
                bound = np.take_along_axis(bound, at, 1)
                # of the groups whose lowest kept bound is reached
                new = np.flatnonzero(bound.max(1) > top[own].min(1))
                own, at, bound = own[new], at[new], bound[new]
                entries = np.zeros((2, *at.shape), np.int64)
                has = np.nonzero(bound > -np.inf)
                entries[:, has[0], has[1]] = blocks.packed(own[has[0]], at[has])
                every = np.concatenate([top[own], bound], 1)
                rest = np.concatenate([kept[:, own], np.stack([blocks.number[at], *entries])], 2)
                at = np.argpartition(-every, most - 1, 1)[:, :most]
                top[own], kept[:, own] = np.take_along_axis(every, at, 1), np.take_along_axis(rest, at[None], 2)
        for part in np.array_split(np.flatnonzero((top > -np.inf).any(1)), -(-len(top) // 10_000) or 1):
            i, j = np.nonzero(top[part] > -np.inf)
            columns = [groups.group[part[i]], *kept[:, part[i], j], top[part[i], j]]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["group", "block", "entries", "holds", "bound"])

    return run


def _probed(sent: Broadcast):
    """Scores of the groups that a block is given with."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, blocks in _parsed(batches, sent.value):
            own = np.searchsorted(sent.value.group, batch["groups"].flatten().to_numpy())
            yield from _rows(blocks, blocks.scores(own, np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch["groups"]).to_numpy())))

    return run


def _reached(sent: Broadcast, k: int, count: bool = False):
    """Scores in the blocks whose bound reaches what a group has to reach; with
    `count` the numbers of packed entries there."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = Reach(sent.value.least, k)
        for _, blocks in _parsed(batches, sent.value):
            for own, bound in blocks.bounds():
                i, block = np.nonzero((bound >= reach.least[own][:, None]) & (bound > -np.inf))
                rows = _rows(blocks, reach(blocks.scores(own[i], block)))
                if count:
                    yield pa.RecordBatch.from_arrays([pa.array([int(blocks.packed(own[i], block)[0].sum())])], ["entries"])
                    for _ in rows:  # what is found counts for the blocks that follow
                        pass
                else:
                    yield from rows

    return run


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("group").orderBy(F.desc(F.round("score", 9)), "id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def search(spark: SparkSession, folder: str, queries: DataFrame, k: int = 10, domain: str | None = None, topic: str | None = None, rest: Callable[[DataFrame], DataFrame] | None = None, probe: int = 8, read: dict | None = None) -> DataFrame:
    """(query_id, id, score, rank) as `fts.search` has them.  `rest` searches
    the queries (query_id, query) that have a phrase of several tokens; without
    it they are an error.  Into `read` go the numbers of packed entries that
    were read in each pass, and of those a full search would read."""
    blocks, sizes = spark.read.parquet(f"{folder}/blocks"), spark.read.parquet(f"{folder}/sizes")
    docs, mean = spark.read.parquet(f"{folder}/about").first()
    wanted = written.written(fts.phrases(queries), "phrases")
    whole = wanted.groupBy("query_id").agg(F.count("*").cast("int").alias("need"), F.max(F.size("tokens")).alias("most"))
    others = whole.where("most > 1").select("query_id")
    left = None
    if not others.isEmpty():
        if rest is None:
            raise ValueError("a query has a phrase of several tokens; give `rest`, a full search")
        left = rest(queries.join(others, "query_id", "left_semi"))
    number = F.monotonically_increasing_id()  # differs from run to run, so it is written
    one = wanted.join(whole.where("most = 1"), "query_id").select("query_id", F.col("tokens")[0].alias("token"))
    sets = one.groupBy("query_id").agg(F.sort_array(F.collect_list("token")).alias("tokens"))
    terms = written.written(one.select("token").distinct().withColumn("term", number), "terms")
    groups = written.written(sets.select("tokens").distinct().withColumn("group", number), "groups")
    words = [r["token"] for r in terms.select("token").limit(1001).collect()]
    if len(words) <= 1000:  # else the join alone leaves the other tokens out
        blocks = blocks.where(F.col("token").isin(words))
    kept = F.lit(True)
    for column, value in (("domain", domain), ("topic", topic)):
        kept = kept if value is None else kept & F.coalesce(F.col(column) == value, F.lit(False))
    held = written.written(_held(blocks, sizes, terms, kept), "held")
    df = held.select(F.explode("f").alias("e")).groupBy("e.term").agg(F.sum("e.n").alias("df"))
    x = groups.select("group", F.size("tokens").alias("need"), F.explode("tokens").alias("token")).join(terms, "token").join(df, "term")
    idf = F.log((docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    parts = F.sort_array(F.collect_list(F.struct("df", "term", F.when(idf > 0, idf).otherwise(F.lit(C.IDF_FLOOR)).alias("idf"))))
    asked = x.groupBy("group", "need").agg(parts.alias("parts")).where(F.size("parts") == F.col("need"))
    asked = written.written(asked.select("group", F.lit(mean or 1.0).alias("mean"), "parts", F.lit(float("-inf")).alias("least")), "asked")
    turns = -(-asked.count() // fts.BLOCK) or 1
    written.bound_batches(spark)
    send = lambda df: spark.sparkContext.broadcast(Groups(df.toArrow()))
    scored = f"group long, id {dict(sizes.dtypes)['id']}, score double"
    if read is not None:
        read |= {"first": 0, "second": 0, "full": asked.select(F.explode("parts").alias("p")).agg(F.coalesce(F.sum("p.df"), F.lit(0))).first()[0]}
    found = None
    for turn in range(turns):
        mine = asked.where(F.pmod(F.xxhash64("group"), F.lit(turns)) == turn)
        sent = send(mine)
        best = Window.partitionBy("group").orderBy(F.desc("bound"), "block")
        # each task keeps the highest bounds of a group, so that is all that is shuffled
        top = held.mapInArrow(_highest(sent, probe + k), "group long, block long, entries long, holds long, bound double")
        top = top.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= probe + k)
        before = F.coalesce(F.sum("holds").over(best.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        first = top.withColumn("before", before).where(F.col("before") < probe * k)
        first = written.written(first.groupBy("block").agg(F.collect_list("group").alias("groups"), F.sum("entries").alias("entries")), "first")
        probed = held.join(fts.bounded(first.select("block", "groups")), "block").mapInArrow(_probed(sent), scored)
        least = _ranked(probed, k).where(F.col("rank") == k).select("group", F.col("score").alias("_k"))
        reach = mine.join(least, "group", "left").withColumn("least", F.coalesce(F.col("_k") - NINE, F.col("least"))).drop("_k")
        sent = send(reach)
        if read is not None:
            read["first"] += first.agg(F.coalesce(F.sum("entries"), F.lit(0))).first()[0]
            read["second"] += held.mapInArrow(_reached(sent, k, True), "entries long").agg(F.coalesce(F.sum("entries"), F.lit(0))).first()[0]
        written.discard(first)
        one = _ranked(held.mapInArrow(_reached(sent, k), scored), k)
        found = one if found is None else found.unionByName(one)
    found = sets.join(groups, "tokens").select("query_id", "group").join(found, "group").select("query_id", "id", "score", "rank")
    return found if left is None else found.unionByName(left)
