"""A memory store in a folder: append-only logs in segments, read as live views.

Any store that Spark reads will do.  Writes append rows with a growing `seq`;
deletions and endings are rows of their own, so a write changes nothing that
is there and a lost job leaves no half-written table.  Small segments are
merged as they gather.  The live chunks are read from a snapshot, which holds
each id once and nothing that was deleted, and from what came after it; the
search index follows in segments of its own."""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as T
from ..operators import chunking, embed, fts, kg, layers, store, topicgraph, vectors, written
from ..sources import files, transcripts
from .segments import BASE, Conflict, Segments

TABLES = {
    "chunks": store.CHUNKS + ", seq long",
    "deleted": "id string, seq long",
    "vectors": "chunk_id string, embedding array<float>, seq long",
    "failed": "chunk_id string, error string, seq long",
    "entities": "id string, name string, entity_type string, properties string, seq long",
    "triples": "id string, subject string, predicate string, object string, valid_from string, valid_to string, confidence double, source_ref string, source_file string, extracted_at string, seq long",
    "ended": "subject string, predicate string, object string, ended string, seq long",
}
INDEX = {
    "postings": "id struct<id: string, seq: bigint>, col int, pos int, token string",
    "sizes": "id struct<id: string, seq: bigint>, len int, domain string, topic string",
}
TAIL = 0.25  # a snapshot is due when the rows after it are this share of it
FEW = 100_000  # rows of a tail whose ids may be broadcast


def now() -> str:
    return datetime.now(UTC).isoformat()


def _one(rows: DataFrame) -> dict | None:
    found = rows.first()
    return None if found is None else found.asDict(recursive=True)


class Memory:
    def __init__(self, spark: SparkSession, root: str, model: Callable[[], embed.Model] | None = None, identity: str | None = None):
        self.spark, self.root, self.model, self.identity = spark, root.rstrip("/"), model, identity

        self.tables = Segments(spark, self.root, TABLES | INDEX)

    # tables

    def init(self) -> None:
        """Nothing is needed: a table that no version lists is empty."""

    def log(self, name: str) -> DataFrame:
        return self.tables.read(name)

    def append(self, name: str, rows: DataFrame) -> int:
        """Add rows as a segment, merge what has gathered; returns the rows."""
        columns = [c.split(" ", 1) for c in TABLES[name].split(", ") if not c.startswith("seq ")]
        seq = F.lit(time.time_ns()).alias("seq")
        n = self.tables.put({name: rows.select(*[F.col(c).cast(t) for c, t in columns], seq)})[name]
        if self.tables.merge(name) and name in ("chunks", "deleted"):
            held, tail = self._parts(self.tables.state()[1])
            rows_of = lambda part: sum(s["rows"] for s in part.values())
            if rows_of(tail) + rows_of(self.tables.segments("deleted")) > TAIL * rows_of(held):
                self.snapshot()
        return n

    def _parts(self, state: dict) -> tuple[dict, dict]:
        """Segments of chunks: of the snapshot, and after it."""
        every = self.tables.segments("chunks", state)
        held = {k: v for k, v in every.items() if v["level"] == BASE}
        return held, {k: v for k, v in every.items() if k not in held}

    def snapshot(self) -> None:
        """Write the live chunks as they are now; replaces all segments of chunks
        and deletions, in one version of the manifest.  Deleted rows are gone
        after it.  If another writer merges meanwhile, nothing changes."""
        _, state = self.tables.state()
        replaced = {n for t in ("chunks", "deleted") for n in self.tables.segments(t, state)}
        try:
            self.tables.put({"chunks": self._live(state)}, BASE, replaced)
        except Conflict:
            pass

    def row(self, name: str, **values) -> None:
        schema = ", ".join(c for c in TABLES[name].split(", ") if not c.startswith("seq "))
        fields = [c.split(" ")[0] for c in schema.split(", ")]
        self.append(name, self.spark.createDataFrame([tuple(values.get(f) for f in fields)], schema))

    # views

    def _live(self, state: dict) -> DataFrame:
        """Chunks that are not deleted, the first of each id.  The snapshot's rows
        only lose what was deleted since; the tail is looked at alone, and of
        the snapshot it meets the ids."""
        held, tail = self._parts(state)
        deleted = self.tables.segments("deleted", state)
        rows = self.tables.read("chunks", held)
        gone = self.tables.read("deleted", deleted).groupBy("id").agg(F.max("seq").alias("_gone"))
        if deleted:  # a deletion after the snapshot is later than all its rows
            rows = rows.join(gone.select("id"), "id", "left_anti")
        if not tail:
            return rows
        new = self.tables.read("chunks", tail)
        if deleted:
            new = new.join(gone, "id", "left").where("_gone IS NULL OR seq > _gone").drop("_gone")
        new = kg.first_of(new, ["id"], "seq")
        if not held:
            return new
        ids = new.select("id")
        few = sum(s["rows"] for s in tail.values()) <= FEW
        known = rows.select("id").join(F.broadcast(ids) if few else ids, "id", "left_semi")
        return rows.unionByName(new.join(known, "id", "left_anti"))

    def chunks(self, domain: str | None = None, topic: str | None = None) -> DataFrame:
        rows = self._live(self.tables.state()[1])
        for column, value in (("domain", domain), ("topic", topic)):
            rows = rows if value is None else rows.where(F.col(column) == value)
        return rows

    def vectors(self) -> DataFrame:
        return store.latest_embeddings(self.log("vectors"), self.chunks())

    def entities(self) -> DataFrame:
        return kg.first_of(self.log("entities"), ["id"], "seq")

    def triples(self) -> DataFrame:
        """Facts; an active one is ended by the first ending written after it.  A
        fact without a confidence is certain."""
        key = ["subject", "predicate", "object"]
        t, e = self.log("triples"), self.log("ended")
        later = t.where("valid_to IS NULL").select("id", *key, "seq").join(e.select(*key, "ended", F.col("seq").alias("_s")), key).where("_s > seq")
        ends = later.groupBy("id").agg(F.min_by("ended", "_s").alias("_ended"))
        return t.join(ends, "id", "left").withColumn("valid_to", F.coalesce("valid_to", "_ended")).withColumn("confidence", F.coalesce("confidence", F.lit(1.0))).drop("_ended")

    def nodes(self) -> DataFrame:
        return topicgraph.nodes(self.chunks())

    # single rows

    def entity(self, name: str) -> dict | None:
        return _one(self.entities().where(F.col("id") == T.entity_key(name)).drop("seq"))

    def fact(self, key: str) -> dict | None:
        return _one(self.triples().where(F.col("id") == key).drop("seq"))

    def chunk(self, key: str) -> dict | None:
        return _one(self.chunks().where(F.col("id") == key).drop("seq"))

    def vector(self, key: str) -> list[float] | None:
        found = _one(self.vectors().where(F.col("chunk_id") == key))
        return found and list(found["embedding"])

    # writing

    def add(self, rows: DataFrame) -> int:
        """New chunks; ids that exist are left alone.  Returns how many were new."""
        return self.append("chunks", store.new_chunks(self.chunks().drop("seq"), rows))

    def add_chunk(self, domain: str, topic: str, content: str, source_file: str = "", added_by: str = "service", category: str | None = None) -> str:
        key = str(uuid.uuid4())
        self.row("chunks", id=key, domain=domain, topic=topic, category=category or C.CATEGORIES.get(topic, "cat_general"), source_file=source_file, content=content, chunk_index=0, added_by=added_by, filed_at=now())
        return key

    def delete_chunk(self, key: str) -> None:
        self.row("deleted", id=key)

    def add_fact(self, subject: str, predicate: str, obj: str, valid_from: str | None = None, valid_to: str | None = None, confidence: float = 1.0, source_ref: str | None = None, source_file: str | None = None) -> str:
        """Id of the fact; an active equal fact is kept instead."""
        s, o = T.entity_key(subject), T.entity_key(obj)
        if valid_to is None:
            same = self.triples().where((F.col("subject") == s) & (F.col("predicate") == predicate) & (F.col("object") == o) & F.col("valid_to").isNull()).select("id").first()
            if same:
                return same.id
        new = self.spark.createDataFrame([(subject, "unknown", "{}", 0), (obj, "unknown", "{}", 1)], "name string, entity_type string, properties string, seq int")
        self.append("entities", kg.add_entities(self.entities(), new))
        key = str(uuid.uuid4())
        self.row("triples", id=key, subject=s, predicate=predicate, object=o, valid_from=valid_from, valid_to=valid_to, confidence=confidence, source_ref=source_ref, source_file=source_file, extracted_at=now())
        return key

    def end_fact(self, subject: str, predicate: str, obj: str, ended: str | None = None) -> None:
        s, o = T.entity_key(subject), T.entity_key(obj)
        self.row("ended", subject=s, predicate=predicate, object=o, ended=ended or now()[:10])

    def mine(self, folder: str, domain: str | None = None, mode: str = "projects", limit: int = 0, dry_run: bool = False, by_paragraph: bool = False) -> dict:
        """Chunks of a folder's files.  Files mined before are skipped; `limit`
        counts new files; other modes than projects and convos add nothing."""
        if mode not in ("projects", "convos"):
            return {"files": 0, "added": 0, "skipped": 0, "topics": {}}
        chat = mode == "convos"
        domain = domain or ("conversations" if chat else folder.rstrip("/").rsplit("/", 1)[-1])
        found = files.names(self.spark, folder) if not chat else files.conversations(self.spark, folder)
        known = self.chunks(domain).select(F.col("source_file").alias("path"), F.lit(True).alias("known")).distinct()
        new = F.col("known").isNull()
        # one write lists the files and counts both; a project's files are opened only if they are new
        kept = ["path", "known", *([F.when(new, F.col("content")).alias("content")] if chat else [])]
        listed, n = written.counted(found.join(known, "path", "left").select(*kept), "mined", every=F.count("*"), new=F.count_if(new))
        fresh, read = listed.where(new).drop("known"), []
        if not chat:
            fresh, full = written.counted(files.contents(fresh, folder, n["new"]), "read", new=F.count("*"))
            n, read = {"every": n["every"] - n["new"] + full["new"], "new": full["new"]}, [fresh]
        if limit:
            fresh = fresh.orderBy("path").limit(limit)
        if chat:
            texts = transcripts.transcripts(fresh).select(F.col("path").alias("id"), "content")
            parts = (chunking.paragraphs if by_paragraph else chunking.exchanges)(texts)
        else:
            parts = chunking.chunk_text(fresh.select(F.col("path").alias("id"), "content"))
        topic = T.topic(F.col("content"))
        key = F.sha2(F.concat(F.lit(domain + "\n"), F.col("id"), F.lit("\n"), F.col("chunk_index").cast("string")), 256)
        rows = parts.select(key.alias("id"), F.lit(domain).alias("domain"), topic.alias("topic"), T.category(topic).alias("category"), F.col("id").alias("source_file"), "content", "chunk_index", F.lit("miner").alias("added_by"), F.lit(now()).alias("filed_at"))
        each = [F.count_if(F.col("topic") == t).alias(t) for t in (*C.TOPICS, "general")]
        if dry_run:
            topics = rows.agg(*each).first().asDict()
            added = sum(topics.values())
        else:
            seen = Observation()
            # an id is of the domain, file and place, and none of these files has chunks there
            added = self.append("chunks", rows.observe(seen, *each))
            topics = seen.get
        written.discard(listed, *read)
        if not dry_run and not chat and self.model:
            self.embed()
        count = min(n["new"], limit) if limit else n["new"]
        return {"files": count, "added": added, "skipped": 0 if limit else n["every"] - count, "topics": {k: v for k, v in topics.items() if v}}

    def embed(self) -> int:
        """Vectors of the chunks that have none; returns how many.  A chunk whose
        text the model fails on goes to `failures` and is tried by the next run."""
        tried = written.written(embed.backlog(self.chunks(), self.log("vectors"), self.model or embed.hashing), "vectors")
        n = self.append("vectors", tried.where("error IS NULL"))
        self.append("failed", tried.where("error IS NOT NULL"))
        written.discard(tried)
        return n

    def failures(self) -> DataFrame:
        """(chunk_id, error) of live chunks without a vector whose last try failed."""
        last = self.log("failed").groupBy("chunk_id").agg(F.max_by("error", "seq").alias("error"))
        return last.join(self.log("vectors").select("chunk_id"), "chunk_id", "left_anti").join(self.chunks().select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi")

    def _entries(self, live: DataFrame) -> dict[str, DataFrame]:
        """Index rows of chunks.  Each file has its postings in order of their
        tokens, so nothing is shuffled, and a read skips the pages of others."""
        postings, sizes = fts.index(live)
        return {"postings": self._sorted(postings), "sizes": sizes}

    @staticmethod
    def _sorted(postings: DataFrame) -> DataFrame:
        return postings.sortWithinPartitions("token", "id")

    def _indexed(self, state: dict) -> str:
        """Names a state of chunks and deletions."""
        return hashlib.sha256("".join(sorted(n for t in ("chunks", "deleted") for n in self.tables.segments(t, state))).encode()).hexdigest()

    def index(self) -> tuple[DataFrame, DataFrame]:
        """The saved search index of the live chunks.  What was written since
        the last call is added first, both tables in one version; what was
        deleted is left out, and goes from the postings when they are merged.
        An entry is known by id and sequence number, as an id may come again.
        Where nothing was written since, only the manifest is read."""
        for _ in range(10):
            _, state = self.tables.state()
            live = self._live(state).withColumn("id", F.struct("id", "seq"))
            if state["marks"].get("indexed") == self._indexed(state):
                break
            held = self.tables.segments("sizes", state)
            todo = live.join(self.tables.read("sizes", held).select("id"), "id", "left_anti") if held else live
            todo = written.written(todo.select("id", *fts.COLUMNS), "todo")
            try:
                self.tables.put(self._entries(todo), marks={"indexed": self._indexed(state)}, expect={"sizes": set(held)})
                self._merge_index()
                break
            except Conflict:  # another session has added to the index: see what is left
                continue
            finally:
                written.discard(todo)
        state = self.tables.state()[1]
        sizes = self.tables.read("sizes", self.tables.segments("sizes", state))
        return self.tables.read("postings", self.tables.segments("postings", state)), sizes.join(live.select("id"), "id", "left_semi")

    def _merge_index(self) -> None:
        """Merge both tables of the index at once, without what was deleted."""
        while True:
            _, state = self.tables.state()
            found = self.tables.full("sizes", state)
            if found is None:
                return
            level, sizes = found
            postings = [n for n, s in self.tables.segments("postings", state).items() if s["level"] == level]
            every = self.tables.gathered("sizes", sizes)
            stays = written.written(every.join(self._live(state).select(F.struct("id", "seq").alias("id")), "id", "left_semi"), "stays")
            # what is gone is mostly little, and the postings need not move for it
            gone = fts.bounded(written.written(every.select("id").join(stays.select("id"), "id", "left_anti"), "gone"), FEW)
            try:
                self.tables.put({
                    "postings": self._sorted(self.tables.read("postings", postings).join(gone, "id", "left_anti")),
                    "sizes": stays,
                }, level + 1, {*postings, *sizes})
            except Conflict:
                return

    def repair(self) -> None:
        """Make the index anew."""
        _, state = self.tables.state()
        old = {n for t in INDEX for n in self.tables.segments(t, state)}
        self.tables.put(self._entries(self._live(state).withColumn("id", F.struct("id", "seq"))), replaces=old, marks={"indexed": self._indexed(state)})

    # questions

    def search(self, query: str, domain: str | None = None, topic: str | None = None, k: int = 10) -> DataFrame:
        """Hybrid if there are a model and vectors, else BM25."""
        chunks = self.chunks()
        asked = self.spark.createDataFrame([(0, query)], "query_id long, query string")
        stored = self.vectors() if self.model else None
        words = lambda n: fts.search_index(*self.index(), asked, n, domain, topic, saved=True).withColumn("id", F.col("id.id"))
        if stored is None or stored.isEmpty():
            hits = words(k)
        else:
            scoped = self.chunks(domain, topic).select("id")
            near = stored.select(F.col("chunk_id").alias("id"), "embedding").join(scoped, "id", "left_semi")
            q = asked.select("query_id", embed.embedding(F.col("query"), self.model).alias("embedding"))
            hits = fts.fuse([words(C.DEPTH * k), vectors.knn(near, q, C.DEPTH * k)], k)
        return fts.hydrate(hits, chunks).orderBy("rank")

    def is_duplicate(self, content: str, threshold: float = 0.9) -> bool:
        one = self.spark.createDataFrame([("asked", content)], "id string, content string")
        stored = self.vectors() if self.model else None
        if stored is None or stored.isEmpty():
            live = self.chunks().withColumn("id", F.struct("id", "seq"))
            return not vectors.keyword_duplicates(one, live, threshold, index=self.index()).isEmpty()
        q = one.select(F.col("id").alias("query_id"), embed.embedding(F.col("content"), self.model).alias("embedding"))
        return not vectors.knn(stored.select(F.col("chunk_id").alias("id"), "embedding"), q, 1).where(F.col("score") >= threshold).isEmpty()

    def status(self) -> dict:
        counts = store.status(self.chunks(), self.vectors()).first()
        return {"chunk_count": counts.chunks, "domain_count": counts.domains, "topic_count": counts.topics, "embedding_count": counts.embeddings, "has_identity": self.identity is not None, "kg_stats": self.kg_stats()}

    def kg_stats(self) -> dict:
        s = kg.stats(self.entities(), self.triples()).first()
        return {"entity_count": s.entities, "triple_count": s.triples, "active_triple_count": s.active, "type_counts": s.types or {}}

    def wake_up(self, domain: str | None = None) -> str:
        return layers.wake_up(self.chunks(), self.identity, domain)

    def log_write(self, agent: str, entry: str, topic: str) -> str:
        return self.add_chunk(f"log_{agent}", "log", f"[{now()}] [{topic}]\n{entry}", added_by=agent, category="cat_log")

    def log_read(self, agent: str, n: int = 10, oldest: bool = False) -> list[str]:
        return [r.content for r in store.log_read(self.chunks(), agent, n, oldest).collect()]

    def nearest(self, query: str, domain: str | None = None, topic: str | None = None, n: int = 10) -> DataFrame:
        """Stored chunks by similarity to a query; without a model an error."""
        if self.model is None:
            raise ValueError("a query needs an embedding model")
        near = self.vectors().select(F.col("chunk_id").alias("id"), "embedding").join(self.chunks(domain, topic).select("id"), "id", "left_semi")
        asked = self.spark.createDataFrame([(0, query)], "query_id long, query string")
        hits = vectors.knn(near, asked.select("query_id", embed.embedding(F.col("query"), self.model).alias("embedding")), n)
        return fts.hydrate(hits, self.chunks()).orderBy("rank")

    def page(self, domain: str | None = None, n: int = 20, dims: int = 8) -> DataFrame:
        return embed.listing(self.chunks(domain), self.vectors(), dims, n)
