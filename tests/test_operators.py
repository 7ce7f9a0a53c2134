"""The memory engine's operators on small fixtures."""

import re
import sqlite3
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loquat.functions import constants as C
from loquat.functions import text as T
from loquat.operators import chunking, embed, entities, evaluate, extract, fts, kg, store, topicgraph, vectors
from loquat.sources import files, normalize
from loquat.streaming import ingest


def one(spark, s, column):
    return spark.createDataFrame([(s,)], "s string").select(column(F.col("s")).alias("x")).first().x


CORPUS = [
    ("a", "src", "general", "cat_facts", "py/one.txt", "The trade-off between speed and Café noise"),
    ("b", "src", "technical", "cat_facts", "py/two.txt", "trade and off are words; the value is 3.14 don't"),
    ("c", "lab", "general", "cat_general", "md/three.md", "speed speed SPEED, under_score the the the"),
    ("d", "lab", "planning", "cat_general", "md/four.md", "nothing of note"),
    ("e", "lab", "planning", "cat_events", "md/five.md", "The café has no trade-off trade-off"),
    ("f", "src", "general", "cat_facts", "py/six.py", "Ümlaut naïve coöperate the"),
    ("g", "src", "general", "cat_facts", "py/seven.py", ""),
]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(CORPUS, "id string, domain string, topic string, category string, source_file string, content string")


def test_search_equals_fts5(spark, chunks):
    asked = ["trade-off", "speed", "the", "cafe", "py", "cat_facts", "don't 3.14", "speed off", "technical", "missing", '"speed*"', "--", "naive the", "md/three", "speed speed"]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(id UNINDEXED, domain, topic, category, source_file, content, tokenize='unicode61')")
    db.executemany("INSERT INTO t VALUES (?,?,?,?,?,?)", CORPUS)
    want = {}
    for i, q in enumerate(asked):
        words = [re.sub('["*^]', "", w) for w in q.split(" ")]
        expression = " ".join(f'"{w}"' for w in words if w)
        for id_, score in db.execute("SELECT id, -bm25(t) FROM t WHERE t MATCH ?", (expression,)):
            want[(i, id_)] = score
    got = {(r.query_id, r.id): r.score for r in fts.search(chunks, spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-6 for k in got)


def test_folding_equals_fts5(spark):
    """Every letter, and every mark that may follow one, as stock SQLite folds it."""
    letters = [chr(i) for i in range(0xAA, 0x1F00) if unicodedata.category(chr(i)) in ("Ll", "Lm", "Nd") or 0x300 <= i < 0x370]
    letters += [chr(i) for i in range(0xC0, 0x530) if unicodedata.category(chr(i)) == "Lu"]
    words = [f"q{c}z" for c in letters] + ["cafe\u0301", "Việt", "Vie\u0323\u0302t", "ΆΛΦΑ", "ά", "Ёлка"]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize='unicode61')")
    db.execute("CREATE VIRTUAL TABLE v USING fts5vocab('t', 'instance')")
    db.executemany("INSERT INTO t(rowid, x) VALUES (?, ?)", enumerate(words))
    want = {}
    for term, row, place in db.execute("SELECT term, doc, offset FROM v ORDER BY doc, offset"):
        want.setdefault(row, []).append(term)
    got = spark.createDataFrame(list(enumerate(words)), "n long, s string").select("n", T.tokens(F.col("s")).alias("t")).collect()
    odd = [(words[r.n], r.t, want[r.n]) for r in got if list(r.t) != want[r.n]]
    # the two know letters of other Unicode versions
    assert all(ord(w[1]) >= 0x370 for w, *_ in odd) and len(odd) < 40, odd[:40]


def test_domain_filter_keeps_statistics(spark, chunks):
    q = spark.createDataFrame([(1, "speed")], "query_id long, query string")
    every = {r.id: r.score for r in fts.search(chunks, q).collect()}
    assert {r.id: r.score for r in fts.search(chunks, q, domain="lab").collect()} == {"c": every["c"]}


def test_fusion_ties(spark):
    leg = lambda ids: spark.createDataFrame([(1, x, i + 1) for i, x in enumerate(ids)], "query_id long, id string, rank int")
    got = fts.fuse([leg("abc"), leg("bdx")], 3).orderBy("rank").collect()
    assert [r.id for r in got] == ["b", "a", "d"] and abs(got[0].score - (1 / 62 + 1 / 61)) < 1e-12


def python_chunks(content, size=800, overlap=100):
    segments = []
    for p in (x.strip() for x in re.split(r"\n\n+", content)):
        if p:
            for s in [p] if len(p) <= size else [x.strip() for x in re.split(r"(?<=[.!?])\s+", p) if x.strip()]:
                segments += [s] if len(s) <= size else [s[i : i + size] for i in range(0, len(s), size)]
    out, cur = [], ""
    for s in segments:
        if cur and len(cur) + 1 + len(s) > size:
            out.append(cur.strip())
            cur = cur.strip()[-overlap:] + " " + s
        else:
            cur = f"{cur} {s}" if cur else s
    return out + [cur.strip()] * bool(cur.strip())


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text("ab .!?\n", max_size=120), max_size=8))
def test_chunks_property(spark, parts):
    text = "\n\n".join(parts)
    got = [r.content for r in chunking.chunk_text(spark.createDataFrame([("x", text)], "id string, content string"), 40, 10).orderBy("chunk_index").collect()]
    assert got == python_chunks(text, 40, 10) and all(len(c) <= 51 for c in got)


def test_exchanges(spark):
    turns = [(1, 0, "user", "first?"), (1, 1, "assistant", "\n".join(f"line {i}" for i in range(10))), (1, 2, "user", "second?"), (1, 3, "assistant", "yes"), (2, 0, "system", "only")]
    t = chunking.transcript(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    got = {(r.id, r.chunk_index): r.content for r in chunking.exchanges(t).collect()}
    assert got == {(1, 0): "> first?\n\n" + "\n".join(f"line {i}" for i in range(8)), (1, 1): "> second?\n\nyes"}


def test_sessions(spark):
    text = "\n".join(["intro", "START here", "a", "START again", "x continuing from y", "b", "c", "d", "e", "f", "g", "START last", "h"])
    got = chunking.sessions(spark.createDataFrame([("f", text)], "id string, content string"), "start", ["continuing from"]).groupBy("session").count().collect()
    assert {r.session: r["count"] for r in got} == {0: 2}  # the first two starts are followed by a negative marker


def test_scan_cases(spark):
    def scan(paths, rules=None, include=()):
        return {r.path for r in files.scan(spark.createDataFrame([(p,) for p in paths], "path string"), rules, include).collect()}

    assert scan(["src/app.py", "ignored.py", "generated/artifact.py"], ["ignored.py", "generated/"]) == {"src/app.py"}
    assert scan(["drop.csv", "subrepo/keep.csv"], ["*.csv", "!keep.csv"]) == {"subrepo/keep.csv"}
    assert scan(["generated/drop.py", "generated/keep.py"], ["generated/*", "!generated/keep.py"]) == {"generated/keep.py"}
    assert scan(["generated/drop.py", "generated/keep.py"], ["generated/", "!generated/keep.py"]) == set()
    assert scan(["docs/guide.md"], ["docs/"], ["docs"]) == {"docs/guide.md"}
    assert scan(["README"], ["README"], ["README"]) == {"README"}
    assert scan(["sub/README", "a/Docs/x.md", "a/Docs/b/y.bin", "a/z.bin"], ["docs/"], ["README", "docs"]) == {"sub/README", "a/Docs/x.md", "a/Docs/b/y.bin"}
    assert scan(["generated/keep.py", "generated/drop.py", "a/generated/other.py", "a/x.py"], ["generated/"], ["generated/keep.py"]) == {"generated/keep.py", "a/x.py"}
    assert scan(["notes.md", "a/notes.md/x.py", "notes.md.txt"], ["notes.md/"]) == {"notes.md", "notes.md.txt"}
    many = spark.createDataFrame([(f"d{i}/.gitignore", "*.csv\n!keep.csv\n# no\nsub/\n") for i in range(300)] + [(".gitignore", "/d7/*.md")], "path string, content string")
    tree = [f"d{i}/{x}" for i in range(300) for x in ("a.csv", "keep.csv", "sub/x.py", "b.md")] + ["a.csv"]
    got = {r.path for r in files.scan(spark.createDataFrame([(p,) for p in tree], "path string"), files.rule_rows(many)).collect()}
    assert got == {f"d{i}/{x}" for i in range(300) for x in ("keep.csv", "b.md")} - {"d7/b.md"} | {"a.csv"}
    assert scan([".pytest_cache/cache.py", "main.py"]) == {"main.py"}
    tree = ["foo.py", "a/foo.py", "logs/x.txt", "logs/a/b/x.txt", "logs/y.txt", "a.py"]
    assert scan(tree, ["**/foo.py"]) == {"logs/x.txt", "logs/a/b/x.txt", "logs/y.txt", "a.py"}
    assert scan(tree, ["logs/**/x.txt"]) == {"foo.py", "a/foo.py", "logs/y.txt", "a.py"}
    assert scan(tree, ["logs/**"]) == {"foo.py", "a/foo.py", "a.py"} and scan(tree, ["*", "! a.py"]) == {"a.py"}


def test_knowledge_graph(spark):
    facts = [("Alice", "works_on", "P", "2024-01-01", None, 1), ("Bob", "works_on", "P", "2024-06-01", None, 2), ("Alice", "knows", "Bob", None, None, 3), ("Alice", "knows", "Bob", None, None, 4), ("Alice", "lived_in", "London", "2020-01-01", "2023-12-31", 5)]
    new = spark.createDataFrame(facts, "subject string, predicate string, object string, valid_from string, valid_to string, seq int")
    t = kg.add_triples(spark.createDataFrame([], "subject string, predicate string, object string, valid_from string, valid_to string"), new)
    assert t.count() == 4 and kg.add_triples(t, new).count() == 1  # only the closed fact comes again
    assert kg.query_entity(t, "Alice", direction="out").count() == 3 and kg.query_entity(t, "P").count() == 2
    assert kg.query_entity(t, "alice", "2023-12-31").count() == 2 and kg.query_entity(t, "Alice", "2024-01-01").count() == 2
    gone = kg.invalidate(t, spark.createDataFrame([("alice", "knows", "bob", "2025-01-01")], "subject string, predicate string, object string, ended string"))
    assert kg.query_relationship(gone, "knows").first().is_current is False
    e = kg.add_entities(spark.createDataFrame([], "id string, name string, entity_type string, properties string"), spark.createDataFrame([("Al O'Neil-X", "person", "{}", 1), ("al oneil-x", "thing", "{}", 2)], "name string, entity_type string, properties string, seq int"))
    assert [(r.id, r.entity_type) for r in e.collect()] == [("al_oneil_x", "person")]


def test_topic_graph(spark):
    rows = [("1", "A", "d1", "", "1"), ("2", "a", "d2", "c", "2"), ("3", "B", "D1", "", "1"), ("4", "C", "d2", "", "1"), ("5", "C", "d3", "", "2"), ("6", "D", "d3", "", "1")]
    n = topicgraph.nodes(spark.createDataFrame(rows, "id string, topic string, domain string, category string, filed_at string"))
    e = topicgraph.edges(n)
    assert {tuple(r) for r in e.collect()} == {("a", "b", "d1"), ("a", "c", "d2"), ("c", "d", "d3")}
    assert {(r.topic_key, r.hops) for r in topicgraph.traverse(e, "B", 2).collect()} == {("a", 1), ("c", 2)}
    assert {(r.topic_key, r.hops) for r in topicgraph.traverse(e, "B", 3).collect()} == {("a", 1), ("c", 2), ("d", 3)}
    assert topicgraph.traverse(e, "zzz").count() == 0
    assert {r.topic_key for r in topicgraph.links(n, "d2").collect()} == {"a", "c"} and topicgraph.links(n, "d1", "d3").count() == 0


def test_store(spark):
    old = spark.createDataFrame([("x", "d", "t", "f", "c", "1")], "id string, domain string, topic string, source_file string, content string, filed_at string")
    batch = spark.createDataFrame([("x", "d", "t", "f", "new", "2"), ("y", "d", "t", "g", "one", "2"), ("y", "d", "t", "g", "two", "3")], old.schema)
    fresh = store.new_chunks(old, batch)
    assert [(r.id, r.content) for r in fresh.collect()] == [("y", "one")]
    assert store.new_chunks(old.unionByName(fresh), batch).count() == 0
    assert store.live(old.unionByName(fresh), spark.createDataFrame([("x",)], "id string")).count() == 1
    log = store.log_write("me", spark.createDataFrame([(f"e{i}", "t") for i in range(3)], "entry string, topic string"), "2024-01-01")
    assert store.log_read(log, "me", 2).count() == 2 and log.first().content.startswith("[2024-01-01] [t]\n")


def test_extractors(spark):
    text = "We decided to use caching because it works. Alice Smith met Alice Smith and Alice Smith. I love this private code."
    docs = spark.createDataFrame([("x", text)], "id string, content string")
    assert [(r["name"], r["count"]) for r in extract.candidates(docs).collect()] == [("Alice Smith", 3)]
    s = extract.compress(docs).first().summary.split("|")
    assert s[0] == "alice+smith+decided" and s[1] == "We decided to use caching because it works." and s[2] == "joy" and "DECISION" in s[3] and "SENSITIVE" in s[3]
    noted = spark.createDataFrame([("x", text, "src", None)], "id string, content string, origin string, none string")
    assert extract.compress(noted, ("origin", "none")).first().summary == "# origin: src\n" + "|".join(s)
    d = one(spark, "# k: v\n  # more\n a+b | key |joy+ FEA+nos+zzz| CORE ", extract.decode)
    assert d.topics == "a+b" and d.sentence == "key" and list(d.emotions) == ["joy", "fear", "nostalgia", "zzz"] and d.flags == "CORE"
    assert len(C.EMOTION_CODES) == len(set(C.EMOTION_CODES.values())) == 30 and set(C.EMOTIONS) <= set(C.EMOTION_CODES)
    sizes = spark.createDataFrame([("0123456789", "ab"), ("", "ab")], "a string, b string").select(extract.compression_stats(F.col("a"), F.col("b")).alias("s")).collect()
    assert [r.s.ratio for r in sizes] == [0.2, 0.0]
    code = ["\timport os", "  def f", "let x be", "\tplain words", " x = 1", "import os", "important words", "12345 67890 12"]
    got = spark.createDataFrame([(x,) for x in code], "s string").select("s", extract.is_code_line(F.col("s")).alias("c")).collect()
    assert [r.c for r in got] == [True, True, True, False, True, True, False, True]
    m = extract.memories(spark.createDataFrame([("x", 0, "The bug is a crash and an error"), ("x", 1, "calm"), ("x", 2, "we decided to go")], "id string, chunk_index int, content string")).collect()
    assert {(r.chunk_index, r.memory_type) for r in m} == {(0, "problem"), (2, "decision")}


def test_lookup(spark):
    mk = lambda rows, s: spark.createDataFrame(rows, s)
    got = extract.lookup(mk([("Ann", ""), ("Loq", ""), ("Will", "will said hi"), ("will", "the plan"), ("zzz", "")], "word string, context string"), mk([("ann", 0.95)], "name string, confidence double"), mk([("loq",)], "name string"), mk([("will",)], "name string"), ["said"])
    assert {(r.word, r.entity_type, r.confidence) for r in got.collect()} == {("Ann", "person", 0.95), ("Loq", "project", 0.9), ("Will", "person", 0.6), ("will", "common", 0.8), ("zzz", "unknown", 0.0)}


def test_text_functions(spark):
    assert one(spark, "  a \n\t b c ", T.normalize_whitespace) == "a b c"
    assert one(spark, "3/7/2024 x", T.timestamp_date) == "2024-03-07" and one(spark, "2024-01-02T10:00", T.timestamp_date) == "2024-01-02"
    assert one(spark, "The api bug in the server", T.topic) == "technical" and one(spark, "zzz", T.topic) == "general"
    assert one(spark, "a/b/c.txt", T.title) == "c.txt" and one(spark, "x" * 250, T.snippet) == "x" * 200 + "…"
    assert one(spark, "Who saw Alice and The Bob?", T.person_names) == ["Alice", "Bob"]
    assert len(T.ACCENTED) == len(T.PLAIN)


def test_normalisers(spark):
    raw = spark.createDataFrame([(1, '[{"role":"user","content":"hi"},{"role":"assistant","content":"yo"}]'), (2, '{"messages":[{"role":"User","content":"x"}]}'), (3, '{"chat_messages":[{"sender":"human","text":"q"}]}'), (4, "plain")], "id long, text string")
    assert {(r.conv_id, r.turn, r.role, r.text) for r in normalize.role_content(raw).collect()} == {(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "user", "x"), (3, 0, "human", "q")}
    ch = spark.createDataFrame([(1, '[{"user":"u9","text":"a"},{"user":"u2","text":"b"},{"user":"u9","text":"c"}]')], "id long, text string")
    assert [r.role for r in normalize.channel(ch).orderBy("turn").collect()] == ["user", "assistant", "user"]
    lines = spark.createDataFrame([(1, '{"type":"human","message":"a"}\nbad\n{"type":"assistant","content":"b"}')], "id long, text string")
    assert [(r.role, r.text) for r in normalize.session_lines(lines).orderBy("turn").collect()] == [("user", "a"), ("assistant", "b")]


def test_keyword_duplicates_and_rerank(spark, chunks):
    text = "planet galaxy nebula quasar pulsar comet meteor"
    docs = spark.createDataFrame([("q", text)], "id string, content string")
    base = chunks.unionByName(spark.createDataFrame([("z", "src", "general", "c", "f", text + " planet")], chunks.schema))
    assert [(r.query_id, r.id) for r in vectors.keyword_duplicates(docs, base).collect()] == [("q", "z")]
    found = spark.createDataFrame([(1, "a", 1.0, ["speed"], "none"), (1, "b", 0.9, ["speed"], "speed")], "query_id long, id string, score double, keywords array<string>, content string")
    assert evaluate.rerank(found).where("rank = 1").first().id == "b" and evaluate.rerank(found, True).where("rank = 1").first().id == "a"


def test_keyword_queries_and_single_legs(spark, chunks):
    docs = spark.createDataFrame([("p", "alpha gamma gamma delta delta delta"), ("q", ""), ("r", None)], "id string, content string")
    assert [tuple(r) for r in vectors.keyword_queries(docs, 2).collect()] == [("p", "delta gamma")]
    stored = spark.createDataFrame([("c", [0.0, 1.0]), ("d", [1.0, 0.0])], "id string, embedding array<double>")
    asked = spark.createDataFrame([(1, "speed", None), (2, None, [1.0, 0.1]), (3, None, None)], "query_id long, query string, embedding array<double>")
    got = {}
    for r in vectors.hybrid(chunks, stored, asked, 2).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    words = [r.id for r in fts.search(chunks, asked.where("query_id = 1"), 2).orderBy("rank").collect()]
    assert got == {1: words, 2: ["d", "c"]} and len(words) == 2


def test_streaming_ingestion(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for i in range(3):
        (source / f"f{i}.txt").write_text(f"text {i}")
        ingest.append_new(ingest.files(spark, str(source)), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_nearest_vectors(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 8)).round(1)
    v[100:200] = v[7]  # a third are copies: ties go to the smallest id
    rows = [(f"v{i:03d}", [float(x) for x in r]) for i, r in enumerate(v)] + [("short", [1.0]), ("none", None)]
    schema = "id string, embedding array<double>"
    asked = [(i, rows[i][1]) for i in (7, 50, 250, 120)] + [(1000, [2.0])]
    got = vectors.knn(spark.createDataFrame(rows, schema).repartition(7), spark.createDataFrame(asked, "query_id long, embedding array<double>"), 5, block=2).collect()
    score = lambda a, b: sum(x * y for x, y in zip(a, b)) if a and len(a) == len(b) else 0.0
    for q, e in asked:
        want = sorted((-round(score(x, e), 7), i) for i, x in rows)[:5]
        assert [(-round(r.score, 7), r.id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == want
    assert vectors.knn(spark.createDataFrame(rows, schema), spark.createDataFrame([], "query_id long, embedding array<double>"), 5).count() == 0
    assert vectors.knn(spark.createDataFrame([], schema), spark.createDataFrame(asked, "query_id long, embedding array<double>"), 5).count() == 0


def test_word_duplicates(spark):
    rng = np.random.default_rng(3)
    base = [" ".join("".join(chr(97 + x) for x in rng.integers(0, 26, 6)) for _ in range(60)) for _ in range(30)]
    rows = [(f"a{i}", t) for i, t in enumerate(base)] + [(f"b{i}", t + " extra") for i, t in enumerate(base)]
    d = spark.createDataFrame(rows, "id string, content string")
    got = {(r.query_id, r.id) for r in vectors.word_duplicates(d.where("id like 'a%'"), d).collect()}
    assert got == {(f"a{i}", f"{x}{i}") for i in range(30) for x in "ab"}
    other = spark.createDataFrame([("q", "один два три"), ("r", "совсем другое дело"), ("s", "три, два... Один!"), ("t", "..."), ("u", ""), ("v", None)], "id string, content string")
    got = {(r.query_id, r.id, r.similarity) for r in vectors.word_duplicates(other, other).collect()}
    assert got == {(a, b, 1.0) for a in "qs" for b in "qs"} | {("r", "r", 1.0)}  # texts without words are like nothing
    store_ = d.selectExpr("id", "content", "'' as domain", "'' as topic", "'' as category", "id as source_file")
    long = store_.where("id in ('a1', 'b1')")
    assert vectors.keyword_duplicates(long.where("id = 'a1'"), store_).count() == 2
    assert vectors.keyword_duplicates(long.where("id = 'a1'"), store_, shown=True).count() == 0  # a snippet of a long text is not alike


def test_pooling_and_models(tmp_path):
    x = np.zeros((2, 3, 2))
    x[0] = [[3, 0], [0, 4], [9, 9]]
    out = embed.pooled(x, np.array([[1, 1, 0], [0, 0, 0]]))
    assert np.allclose(out, [[0.6, 0.8], [0, 0]])

    class Fake:
        def __init__(self, names):
            self.names = names

        def get_inputs(self):
            return [type("I", (), {"name": n}) for n in ("input_ids", "attention_mask")]

        def get_outputs(self):
            return [type("O", (), {"name": n}) for n in self.names]

        def run(self, _, given):
            ids = given["input_ids"]
            tokens = np.stack([ids, ids * 0 + 1], -1).astype(float)
            return [tokens, tokens.sum(1)][: len(self.names)]

    encode = lambda t: [len(w) for w in t.split()]
    assert np.allclose(embed.infer(["aaa", "", "a a a a"], encode, Fake(["tokens"]), 2), [[3 / 10**0.5, 1 / 10**0.5], [0, 0], [0.5**0.5, 0.5**0.5]])
    assert np.allclose(embed.infer(["aa b", " "], encode, Fake(["tokens", "sentence_embedding"])), [[3, 2], [0, 0]])
    assert embed.sentence_model(str(tmp_path)) is None


def test_running_recall_and_documents(spark, tmp_path):
    r = spark.createDataFrame([(i, i % 4 == 0) for i in range(125)], "place long, hit boolean")
    assert [(x.done, x.recall) for x in evaluate.running(r).orderBy("done").collect()] == [(50, 13 / 50), (100, 0.25)]
    evaluate.save(r, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 125
    d = evaluate.documents(spark.createDataFrame([("a", "t", "d", "p")], "id string, text string, domain string, topic string"), "2024")
    assert (d.first().source_file, d.first().added_by, d.first().chunk_index) == ("a", "bench", 0)


def test_signs_at_their_edges(spark):
    text = "Ann said hi. Hi Ann, dear Ann! Anna said. ann came; using Ann v2. Ann.py AnnAnn said. project  Ann"
    d = spark.createDataFrame([("x", text)], "id string, content string")
    n = spark.createDataFrame([("x", "Ann", 9)], "id string, name string, count long")
    r = entities.classify(n, d).first()
    # said 3, came 2, hi and dear 8; versions 3, using 2, a file 3, project 2
    assert (r.person_score, r.signal_types, r.project_score, r.entity_type) == (13, 3, 10, "person")
