"""N-gram Jaccard join with filters under several global token orders.

A document's set is its distinct k-word shingles.  Texts are lower-cased (A-Z)
and split at ASCII white space; fewer than k words give one shingle, no words
the empty set, which links with nothing.  Equal sets form one class.

1. Shingles are dealt by hash in blocks.  Each block finds the shingles that at
   least two classes hold.  All others can be in no intersection.
2. Per class: shingles that it shares with nobody come first in every order, so
   a class whose shared ones number under the threshold's share drops out, and
   the rest of its prefix under each order is a few shared shingles.  Order 1
   is rarest first, orders 2 and 3 are independent hashes.
3. Classes that share a token of prefix 1 are linked through the bucket's most
   central class (whose shingles most others hold); then every pair of a bucket that is still in different
   components is a candidate, none is left out.  A candidate must share prefix
   tokens under all orders; only then are the sets intersected.
4. Components by alternating large-star and small-star rounds.

Hashes have 64 bits (48 and the block's number inside a block).  Nothing is
capped; no group is collected; equal texts never meet in pairs.

Defined results: null text counts as empty; rows with null doc_id are
documents whose id never is a component's unless all ids of it are null;
repeated rows are documents of one class; an empty table gives an empty result;
other columns are not carried."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flat
from .shared import bound_batches, discard, materialise, n_partitions

FLUSH = 500_000  # shingles that a task holds before it deals them out
SEGMENT = 1 << 20  # bytes of words that are hashed at once
TEXT = 32 << 20  # bytes of text a block
LIMIT = 1_000_000  # rows of two longs that may be broadcast
WORK = 500_000  # shingles of a block that are compared at once
BLOB = "kind int, part int, a binary, b binary, c binary, d binary"
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_hashes(byte: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word byte[start:end], in runs of whole words of
    about SEGMENT bytes.  Beyond 1,024 bytes a byte's term is mixed with its
    block's number, so equal blocks at other places count differently."""
    size = end - start
    ends, out = np.cumsum(size), np.empty(len(start), np.uint64)
    factors, a = flat.multipliers(1024), 0
    while a < len(start):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + SEGMENT, "right")))
        n = size[a:b]
        first = np.concatenate([[0], np.cumsum(n)[:-1]])
        place = np.arange(int(n.sum())) - np.repeat(first, n)
        term = byte[np.repeat(start[a:b], n) + place].astype(np.uint64) + np.uint64(1)
        term *= factors[place & 1023]
        far = np.flatnonzero(place > 1023)
        if len(far):
            term[far] = flat.mix(term[far] + (place[far] >> 10).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        out[a:b] = np.add.reduceat(term, first) + n.astype(np.uint64)
        a = b
    return flat.mix(out)


def shingle_sets(texts: list, k: int = 5):
    """Sorted distinct shingle hashes of all texts in one array, and the n + 1
    offsets of the texts in it."""
    n = len(texts)
    raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    byte = LOWER[np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)]
    edge = np.concatenate([[0], np.cumsum(np.fromiter((len(x) + 1 for x in raw), np.int64, n))])
    start, end = flat.runs(~SPACE[byte])
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    h = word_hashes(byte, start, end)
    doc = np.searchsorted(edge, start, "right") - 1
    words = np.bincount(doc, minlength=n)
    r = flat.multipliers(k, 11)
    whole = np.zeros(0, np.uint64)
    if len(h) >= k:
        whole = sum(h[j : len(h) - k + 1 + j] * r[j] for j in range(k))
        ok = doc[: len(h) - k + 1] == doc[k - 1 :]
        whole, owner = whole[ok], doc[: len(h) - k + 1][ok]
    else:
        owner = np.zeros(0, np.int64)
    begin = np.concatenate([[0], np.cumsum(words)])
    few = np.flatnonzero((words > 0) & (words < k))
    extra = np.array([sum(int(h[begin[d] + j]) * int(r[j]) for j in range(words[d])) + int(words[d]) * 0x9E3779B97F4A7C15 & (2**64 - 1) for d in few], np.uint64)
    whole = flat.mix(np.concatenate([whole, extra]))
    owner = np.concatenate([owner, few])
    if len(few):
        order = np.argsort(owner, kind="stable")
        whole, owner = whole[order], owner[order]
    cut = np.searchsorted(owner, np.arange(n + 1))
    for a, b in zip(cut[:-1], cut[1:]):
        whole[a:b].sort()
    new = np.ones(len(whole), bool)
    new[1:] = (whole[1:] != whole[:-1]) | (owner[1:] != owner[:-1])
    return whole[new], np.searchsorted(owner[new], np.arange(n + 1))


def set_digests(sets: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """64-bit digest of each set (0 for the empty one)."""
    size = np.diff(cut)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(flat.mix(sets * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(1)))])
    return np.where(size > 0, flat.mix(total[cut[1:]] - total[cut[:-1]] + size.astype(np.uint64)), np.uint64(0))


def _batch(rows: list) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * 6
    return pa.record_batch([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32())] + [pa.array(c, pa.binary()) for c in cols[2:]], ["kind", "part", "a", "b", "c", "d"])


def _deal(k: int, parts: int, carry: int):
    """Documents to rows of kind 0 (doc_id, null flag, size, class, carried
    longs) and of kind 1 (shingles of the classes in one block)."""

    def flush(sets, classes, sizes):
        tokens = np.concatenate(sets)
        part = (tokens % np.uint64(parts)).astype(np.uint16 if parts < 65536 else np.int32)
        order = np.argsort(part, kind="stable")
        cut = np.searchsorted(part[order], np.arange(parts + 1))
        tokens //= np.uint64(parts)
        tokens = tokens[order]
        owner = np.repeat(np.arange(len(classes), dtype=np.uint32), sizes)[order]
        del part, order
        cls, n = np.array(classes, np.uint64), np.array(sizes, np.uint32)
        for p in np.flatnonzero(np.diff(cut)):
            a, b = cut[p], cut[p + 1]
            mine, index = np.unique(owner[a:b], return_inverse=True)
            index = index.astype(np.uint16 if len(mine) <= 65536 else np.uint32)
            low, high = tokens[a:b].astype(np.uint32), (tokens[a:b] >> np.uint64(32)).astype(np.uint16)
            yield 1, int(p), low.tobytes() + high.tobytes(), index.tobytes(), cls[mine].tobytes(), n[mine].tobytes()

    def groups(rows: Iterator) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for r in rows:
            held.append(r)
            size += len(r[2]) + len(r[3]) + len(r[4]) + len(r[5])
            if size > SEGMENT:
                yield _batch(held)
                held, size = [], 0
        if held:
            yield _batch(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, classes, sizes, held, seen = [], [], [], 0, set()  # a class is dealt once a task
        for batch in flat.released(batches):
            for i in range(0, batch.num_rows, 500):
                some = batch.slice(i, 500)
                ids, texts = some.column("doc_id"), some.column("text").to_pylist()
                null = ids.is_null().to_numpy(zero_copy_only=False)
                ids = ids.fill_null(0).to_numpy()
                more = [some.column(2 + j).fill_null(0).to_numpy() for j in range(carry)]
                for a, b in flat.chunks(texts, SEGMENT):
                    found, cut = shingle_sets(texts[a:b], k)
                    cls, n = set_digests(found, cut), np.diff(cut)
                    at = int(cls.sum() % np.uint64(parts)) if len(cls) else 0
                    yield _batch([(0, at, ids[a:b].astype(np.int64).tobytes(), null[a:b].astype(np.uint8).tobytes(), n.astype(np.int64).tobytes() + b"".join(x[a:b].tobytes() for x in more), cls.tobytes())])
                    for j in np.flatnonzero(n):
                        key = int(cls[j])
                        if key not in seen:
                            seen.add(key)
                            sets.append(found[cut[j] : cut[j + 1]].copy())
                            classes.append(key)
                            sizes.append(int(n[j]))
                            held += int(n[j])
                    if held >= FLUSH:
                        yield from groups(flush(sets, classes, sizes))
                        sets, classes, sizes, held = [], [], [], 0
        if held:
            yield from groups(flush(sets, classes, sizes))

    return run


def _columns(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Rows of a batch, one at a time; binary values as buffers."""
    for i in range(batch.num_rows):
        yield tuple(batch.column(j)[i].as_py() if j < 2 else batch.column(j)[i].as_buffer() for j in range(6))


def _shared_tokens(parts: int):
    """One block: keep the shingles that two classes or more hold, by class.
    The block's shingles are held in ten bytes each and compared in shares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lows, highs, owners, classes, sizes, base, part = [], [], [], [], [], 0, 0
        for batch in batches:
            part = batch.column("part")[0].as_py()
            kind = batch.column("kind").to_numpy()
            if (kind == 0).any():
                yield batch.filter(pa.array(kind == 0))
            for r in _columns(batch):
                if r[0] == 1:
                    n, c = len(r[2]) // 6, len(r[4]) // 8
                    lows.append(np.frombuffer(r[2], np.uint32, n).copy())
                    highs.append(np.frombuffer(r[2], np.uint16, n, offset=4 * n).copy())
                    owners.append(np.frombuffer(r[3], np.uint16 if c <= 65536 else np.uint32).astype(np.uint32) + np.uint32(base))
                    classes.append(np.frombuffer(r[4], np.uint64).copy())
                    sizes.append(np.frombuffer(r[5], np.uint32).copy())
                    base += c
        if not base:
            return
        cls, first, index = np.unique(np.concatenate(classes), return_index=True, return_inverse=True)
        size = np.concatenate(sizes)[first]
        del classes, sizes
        low, high, owner = np.concatenate(lows), np.concatenate(highs), np.concatenate(owners)
        del lows, highs, owners
        index = index.astype(np.uint32)
        shares = -(-len(low) // WORK)
        kept = []
        for s in range(shares):
            some = np.flatnonzero(low % np.uint32(shares) == s)
            token = low[some].astype(np.uint64) | (high[some].astype(np.uint64) << np.uint64(32))
            who = index[owner[some]]
            order = np.argsort(token, kind="stable")
            token, who = token[order], who[order]
            same = np.zeros(len(token) + 1, bool)
            same[1:-1] = token[1:] == token[:-1]
            near = same[:-1] | same[1:]  # tokens that occur once are most; they end here
            token, who = token[near], who[near]
            order = np.lexsort((who, token))
            token, who = token[order], who[order]
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (who[1:] != who[:-1])
            token, who = token[new], who[new]
            begin = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
            df = np.diff(np.append(begin, len(token)))
            df = np.repeat(df, df)
            keep = df > 1
            rare = np.minimum(np.floor(np.log2(np.maximum(df[keep], 1)) * 4), 255).astype(np.uint8)
            kept.append((token[keep] * np.uint64(parts) + np.uint64(part), who[keep], rare))
        del low, high, owner
        token, owner, rare = (np.concatenate(x) for x in zip(*kept))
        del kept
        at = (cls % np.uint64(parts)).astype(np.int32)[owner]
        order = np.lexsort((owner, at))
        token, owner, rare, at = token[order], owner[order], rare[order], at[order]
        del order
        cut, out, held = np.searchsorted(at, np.arange(parts + 1)), [], 0
        for p in np.flatnonzero(np.diff(cut)):
            a, b = cut[p], cut[p + 1]
            who, count = np.unique(owner[a:b], return_counts=True)
            out.append((1, int(p), cls[who].tobytes() + size[who].astype(np.uint32).tobytes() + count.astype(np.uint32).tobytes(), token[a:b].tobytes(), rare[a:b].tobytes(), b""))
            held += 9 * int(b - a) + 16 * len(who)
            if held > SEGMENT:
                yield _batch(out)
                out, held = [], 0
        if out:
            yield _batch(out)
        del token, owner, rare, at
        flat.release()

    return run


def _prefixes(share: int, orders: int):
    """Per class: its shared shingles, and its prefix under each order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cls, size, count, token, rare = [], [], [], [], []
        for batch in batches:
            for r in _columns(batch):
                m = len(r[2]) // 16
                cls.append(np.frombuffer(r[2], np.uint64, m).copy())
                size.append(np.frombuffer(r[2], np.uint32, m, offset=8 * m).copy())
                count.append(np.frombuffer(r[2], np.uint32, m, offset=12 * m).copy())
                token.append(np.frombuffer(r[3], np.uint64).copy())
                rare.append(np.frombuffer(r[4], np.uint8).copy())
        cls, size, count, token, rare = (np.concatenate(x) for x in (cls, size, count, token, rare))
        who, first, index = np.unique(cls, return_index=True, return_inverse=True)
        n = size[first].astype(np.int64)
        owner = np.repeat(index, count)
        held = np.bincount(owner, minlength=len(who))
        need = -(-share * n // 100)
        live = held >= need
        keep = live[owner]
        owner, token, rare = owner[keep], token[keep], rare[keep]
        order = np.argsort(owner, kind="stable")
        owner, token, rare = owner[order], token[order], rare[order]
        del order, keep
        alive = np.flatnonzero(live)
        edge = np.concatenate([[0], np.cumsum(held[alive])])
        names = ["cls", "n", "held", "central", "tokens"] + [f"pre{j + 1}" for j in range(orders)]
        a = 0
        while a < len(alive):  # runs of whole classes of about WORK shingles
            b = max(a + 1, int(np.searchsorted(edge, edge[a] + WORK, "right")) - 1)
            mine, o = alive[a:b], np.repeat(np.arange(b - a), held[alive[a:b]])
            t, r = token[edge[a] : edge[b]], rare[edge[a] : edge[b]]
            begin = edge[a:b] - edge[a]
            length = held[mine] - need[mine] + 1
            place = np.arange(len(o)) - begin[o]

            def lists(order: np.ndarray, most: np.ndarray) -> pa.Array:
                ok = place < most[o]
                cut = np.concatenate([[0], np.cumsum(np.minimum(most, held[mine]))]).astype(np.int32)
                return pa.ListArray.from_arrays(pa.array(cut), pa.array(t[order][ok].view(np.int64)))

            central = np.bincount(o, weights=r, minlength=b - a) / np.maximum(n[mine], 1)
            columns = [pa.array(who[mine].view(np.int64)), pa.array(n[mine]), pa.array(held[mine].astype(np.int64)), pa.array(central), lists(np.lexsort((t, o)), held[mine])]
            for j, m in enumerate(flat.multipliers(orders, 23)):
                h = flat.mix(t * m)
                columns.append(lists(np.lexsort((h, r, o) if j == 0 else (h, o)), length))
            yield pa.record_batch(columns, names)
            a = b
        flat.release()

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of undirected edges (a, b); a component
    is named by its smallest node.  Rounds go on until the edges settle, about
    the logarithm of the longest path."""
    e = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        last, e = e, materialise(small, "edges")
        discard(last)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    stars = e.groupBy("u").agg(F.min("v").alias("component"))
    nodes = stars.select(F.col("u").alias("node"), "component").unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
    out = materialise(nodes, "components")
    discard(e)
    return out


def verified(pairs: DataFrame, sets: DataFrame, share: int, orders: int) -> DataFrame:
    """Of the pairs (a, b) of classes, those that share prefix tokens under
    every order and whose sets are alike enough."""
    left = sets.select([F.col(c).alias("a_" + c) for c in sets.columns])
    right = sets.select([F.col(c).alias("b_" + c) for c in sets.columns])
    both = pairs.join(left, F.col("a") == F.col("a_cls")).join(right, F.col("b") == F.col("b_cls"))
    alike = None
    # of the sizes of a pair follows the overlap it needs, and with it the length of its prefixes
    least = F.ceil(share * (F.col("a_n") + F.col("b_n")) / (100 + share)).cast("int")
    head = lambda side, j: F.slice(f"{side}_pre{j + 1}", F.lit(1), F.greatest(F.col(f"{side}_held").cast("int") - least + 1, F.lit(0)))
    for j in range(orders):
        c = F.arrays_overlap(head("a", j), head("b", j))
        alike = c if alike is None else alike & c
    both = both.where(alike).withColumn("common", F.size(F.array_intersect("a_tokens", "b_tokens")).cast("long"))
    return both.where(100 * F.col("common") >= share * (F.col("a_n") + F.col("b_n") - F.col("common"))).select("a", "b")


def n_blocks(docs: DataFrame) -> int:
    """As many blocks as shuffle partitions, more where a block would get over
    TEXT bytes of text."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(n_partitions(docs.sparkSession), -(-total // TEXT))


def classes_and_links(docs: DataFrame, k: int = 5, share: int = 80, orders: int = 3, carry: tuple[str, ...] = ()):
    """(doc_id, n_shingles, cls and the `carry` columns) of all documents;
    verified links between classes that connect every component; (node,
    component) of linked classes; the frames that can be discarded once what
    comes of these has been written."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(c).cast("long").alias(c) for c in carry])
    bound_batches(docs.sparkSession)
    parts = n_blocks(source)
    dealt = source.mapInArrow(_deal(k, parts, len(carry)), BLOB)
    found = materialise(dealt.repartitionById(parts, F.col("part")).groupBy("part").applyInArrow(_shared_tokens(parts), BLOB), "shared")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in _columns(batch):
                ids = pa.array(np.frombuffer(r[2], np.int64), mask=np.frombuffer(r[3], np.uint8).astype(bool))
                sizes, *more = np.frombuffer(r[4], np.int64).reshape(1 + len(carry), -1)
                yield pa.record_batch([ids, pa.array(sizes), pa.array(np.frombuffer(r[5], np.uint64).view(np.int64)), *map(pa.array, more)], ["doc_id", "n_shingles", "cls", *carry])

    members = found.where("kind = 0").mapInArrow(unpack, "doc_id long, n_shingles long, cls long" + "".join(f", `{c}` long" for c in carry))
    schema = "cls long, n long, held long, central double, tokens array<long>" + "".join(f", pre{j + 1} array<long>" for j in range(orders))
    sets = materialise(found.where("kind = 1").repartitionById(parts, F.col("part")).groupBy("part").applyInArrow(_prefixes(share, orders), schema), "prefixes")
    rows = sets.select("cls", "n", "held", "central", F.posexplode("pre1").alias("pos", "t"))
    central = rows.groupBy("t").agg(F.max(F.struct("central", "cls")).alias("p"), F.count("*").alias("size")).where("size > 1").select("t", F.col("p.cls").alias("b"))
    tries = rows.join(central, "t").where("cls != b").groupBy(F.col("cls").alias("a"), "b").agg(F.count("*").alias("hits"))
    tries = tries.groupBy("a").agg(F.max(F.struct("hits", "b")).alias("x")).select("a", F.col("x.b").alias("b"))
    first = materialise(verified(tries, sets, share, orders), "links")
    known = components(first)
    rows = rows.join(known.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    per = rows.groupBy("t", "component").agg(F.count("*").alias("size"))
    main = per.groupBy("t").agg(F.count("*").alias("several"), F.max(F.struct("size", "component")).alias("x")).where("several > 1").select("t", F.col("x.component").alias("main"))
    rows = materialise(rows.join(main, "t"), "open")
    x = rows.where("component != main").alias("x")
    y = rows.alias("y")
    # if t is the pair's first common shingle, only what follows it can be common too
    rest = F.least(F.col("x.held") - F.col("x.pos"), F.col("y.held") - F.col("y.pos"))
    pairs = x.join(y, (F.col("x.t") == F.col("y.t")) & (F.col("x.component") != F.col("y.component")) & ((100 + share) * rest >= share * (F.col("x.n") + F.col("y.n"))))
    pairs = pairs.select(F.least("x.cls", "y.cls").alias("a"), F.greatest("x.cls", "y.cls").alias("b")).distinct()
    links = materialise(verified(pairs, sets, share, orders).unionByName(first), "links")
    discard(known, first, rows, sets)
    linked = components(links)
    return members, links, linked, (found, links, linked)


def groups(docs: DataFrame, k: int = 5, share: int = 80, orders: int = 3, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_shingles, the `carry` columns and `label`, a number that the
    documents of a near-duplicate group share (null without words); written.
    Nulls in `carry` columns count as 0."""
    members, _, linked, used = classes_and_links(docs, k, share, orders, carry)
    out = members.join(linked.withColumnRenamed("node", "cls"), "cls", "left")
    out = out.select("doc_id", "n_shingles", *carry, F.when(F.col("n_shingles") > 0, F.coalesce("component", "cls")).alias("label"))
    out = materialise(out, "groups")
    discard(*used)
    return out


def near_duplicates(docs: DataFrame, k: int = 5, share: int = 80, orders: int = 3) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links)."""
    found = groups(docs, k, share, orders)
    least = materialise(found.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("least")), "names")
    # written, so that Spark can split the join of a large group
    least = F.broadcast(least) if least.count() <= LIMIT else least
    out = found.join(least, "label", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))
