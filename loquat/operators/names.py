"""Many names in many texts: a registry of any size is a frame, not a pattern.

A text is cut into words and what stands between them.  A name's first word
leads to the numbers of words that names with this first word have; only there
are runs of that many words looked up among the names.  So a plan has two
equi-joins however many names there are, and a word that begins no name goes
no further.  `encode` gives tasks up to LIMIT names and replaces them in the
text's own row, so no place is shuffled; of more names a text is given those
that it holds.  Letters are compared in lower case, what is between the words
exactly.

Defined results: a name has to begin and end with a letter, a digit or an
underscore, others (null and empty ones too) are never found; of names that
are equal in lower case the one with the smallest code counts; a null code is
none.  Null texts hold nothing; rows of null or repeated ids are counted together by `mentions`
and are rows of their own for `encode`."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import written

WORD = r"[\p{L}\p{Nd}_][\p{L}\p{Nd}_\p{Mn}]*"
PIECES = WORD + r"|[^\p{L}\p{Nd}_]+"
LIMIT = 200_000  # names, or first words, that may be broadcast


def pieces(s: Column) -> Column:
    """Words and what is between them, in turn; together they are the text."""
    return F.regexp_extract_all(s, F.lit(PIECES), F.lit(0))


def registry(names: DataFrame) -> DataFrame:
    """names (name, code) to (name in lower case, first, words, code), one row a name."""
    low = F.lower("name")
    whole = F.regexp_like(low, F.lit(rf"^{WORD}([^\p{{L}}\p{{Nd}}_]++{WORD})*+$"))
    one = names.where(whole & F.col("code").isNotNull()).groupBy(low.alias("name")).agg(F.min("code").alias("code"))
    cut = pieces(F.col("name"))
    return one.select("name", F.get(cut, F.lit(0)).alias("first"), F.floor((F.size(cut) + 1) / 2).cast("int").alias("words"), "code")


def occurrences(docs: DataFrame, names: DataFrame, key: str = "id", once: bool = False) -> DataFrame:
    """(key, name, first, words, code): a row for every place where a name of
    `registry` stands; they may overlap.  With `once`, equal runs of a text are
    tried once, before anything is shuffled."""
    held = names.groupBy("first").agg(F.sort_array(F.collect_set("words")).alias("counts"))
    sizes = names.agg(F.count("*").alias("n"), F.max("words").alias("most")).first()
    small = F.broadcast if sizes.n <= LIMIT else lambda x: x
    # exploding keeps the pieces a column; inlined, each place would cut the text again
    rows = docs.select(key, F.explode(F.array(F.transform(pieces(F.col("content")), F.lower))).alias("_p"))
    reach = 2 * (sizes.most or 1) - 1
    # each place takes its own run along, so a long text is not copied to all of its places
    run = lambda i: F.array_join(F.slice("_p", i + 1, reach), "") if once else F.slice("_p", i + 1, reach)
    runs = F.filter(F.transform("_p", lambda w, i: F.when(w.rlike("^" + WORD), run(i))), lambda x: x.isNotNull())
    at = rows.select(key, F.explode(F.array_distinct(runs) if once else runs).alias("_run"))
    at = at.select(key, F.explode(F.array(pieces(F.col("_run")))).alias("_run")) if once else at
    tried = at.withColumn("first", F.get("_run", F.lit(0))).join(small(held), "first").select(key, "_run", F.explode("counts").alias("words"))
    tried = tried.where(F.size("_run") >= 2 * F.col("words") - 1).select(key, F.array_join(F.slice("_run", 1, 2 * F.col("words") - 1), "").alias("name"))
    return tried.join(small(names), "name").select(key, "name", "first", "words", "code")


def mentions(docs: DataFrame, names: DataFrame) -> DataFrame:
    """docs (id, content), names (name, code): (id, name, code, count), how often
    each name stands in each text, within longer names too."""
    return occurrences(docs, registry(names)).groupBy("id", "name", "code").agg(F.count("*").alias("count"))


def _by_words(names: Iterable[tuple[str, str, int, str]]) -> tuple[list[tuple[int, pa.Array, pa.Array, np.ndarray]], pa.Array]:
    """Of names (name, first, words, code) for each number of words the first
    words, the names and their ranks, and the codes by rank: the longest name
    first, equally long ones by name.  The last code is for what a name covers."""
    ranked = sorted(set(names), key=lambda x: (-len(x[0]), x[0]))
    out = []
    for words in sorted({x[2] for x in ranked}):
        own = [(rank, x) for rank, x in enumerate(ranked) if x[2] == words]
        out.append((words, pa.array(sorted({x[1] for _, x in own}), pa.string()), pa.array([x[0] for _, x in own], pa.string()), np.array([rank for rank, _ in own], np.int64)))
    return out, pa.array([*(x[3] for x in ranked), ""], pa.string())


def _coded(cut: pa.ListArray, lowered: pa.ListArray, held: list[tuple[int, pa.Array, pa.Array, np.ndarray]], codes: pa.Array) -> pa.Array:
    """Texts, cut into pieces, with the names of `held` replaced: of those that
    overlap the longest stays, of equally long ones the first by name, then by place."""
    values, low = cut.flatten(), lowered.flatten()
    ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(cut), 0).to_numpy())])
    chosen = np.full(len(low), -1, np.int64)  # the rank of the name that begins at a piece
    several = []
    for words, firsts, known, ranks in held:
        n = 2 * words - 1
        at = np.flatnonzero(pc.is_in(low, firsts).to_numpy(zero_copy_only=False))
        at = at[at + n <= ends[np.searchsorted(ends, at, "right")]]
        for part in np.array_split(at, -(-len(at) * n // 1_000_000) or 1):
            runs = low.take(pa.array((part[:, None] + np.arange(n)).ravel()))
            if n > 1:
                runs = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * n, pa.int32()), runs), "")
            found = pc.fill_null(pc.index_in(runs, known), -1).to_numpy()
            part, rank = part[found >= 0], ranks[found[found >= 0]]
            if n == 1:
                chosen[part] = rank
            else:
                several.append(np.stack([rank, part, part + n]))
    if several:
        rank, at, to = np.concatenate(several, 1)
        covered = np.zeros(len(low) + 1, np.int64)
        np.add.at(covered, at, 1)
        np.add.at(covered, to, -1)
        one = np.flatnonzero((np.cumsum(covered)[:-1] > 0) & (chosen >= 0))
        rank, at, to = np.concatenate([rank, chosen[one]]), np.concatenate([at, one]), np.concatenate([to, one + 1])
        chosen[one] = -1
        taken = np.zeros(len(low), bool)
        for i in np.lexsort((at, rank)):
            a, b = at[i], to[i]
            if not taken[a:b].any():
                taken[a:b], chosen[a], chosen[a + 1 : b] = True, rank[i], len(codes) - 1
    new = pc.if_else(pa.array(chosen >= 0), codes.take(pa.array(np.maximum(chosen, 0))), values)
    text = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), new), "")
    return pc.if_else(cut.is_valid(), text, pa.scalar(None, pa.string()))


def encode(docs: DataFrame, names: DataFrame) -> DataFrame:
    """docs with each name in `content` replaced by its code, the longest first;
    codes are not looked into.  A text is changed in its own row; of more than
    LIMIT names it first meets those it holds, equal texts together."""
    own, to = (next(n for n in (f"_{x}" + "_" * i for i in range(len(docs.columns) + 1)) if n not in docs.columns) for x in ("text", "names"))
    spark = written.bound_batches(docs.sparkSession)
    known = written.written(registry(names), "names")
    few = known.select("name", "first", "words", "code").limit(LIMIT + 1).collect()
    if len(few) <= LIMIT:
        sent = spark.sparkContext.broadcast(_by_words(map(tuple, few)))

        @F.arrow_udf("string")
        def coded(cut: pa.Array, lowered: pa.Array) -> pa.Array:
            return _coded(cut, lowered, *sent.value)

        rows, more = docs, ()
    else:
        @F.arrow_udf("string")
        def coded(cut: pa.Array, lowered: pa.Array, held: pa.Array) -> pa.Array:
            # a name of any text of the batch is a name for all of them
            return _coded(cut, lowered, *_by_words(tuple(x.values()) for x in held.flatten().to_pylist()))

        keyed = docs.withColumn(own, F.md5("content"))
        found = occurrences(keyed.select(own, "content"), known, own, once=True)
        rows = keyed.join(found.groupBy(own).agg(F.collect_set(F.struct("name", "first", "words", "code")).alias(to)), own, "left").drop(own)
        more = (to,)
    rows = rows.select("*", F.explode(F.array(pieces(F.col("content")))).alias(own))  # exploding keeps the pieces a column
    text = coded(F.col(own), F.transform(own, F.lower), *map(F.col, more))
    return rows.select([text.alias(c) if c == "content" else F.col(f"`{c}`") for c in docs.columns])
