"""The store, its command line and its line protocol, and what they rest on."""

import io
import json

import pytest
from pyspark.sql import functions as F

from loquat.functions import text as T
from loquat.operators import embed, entities, evaluate, extract, fts, layers, sessions
from loquat.service import cli, rpc, settings
from loquat.service.memory import Memory
from loquat.sources import datasets, files, transcripts
from loquat.streaming import ingest

MARK = "Claude Code v1"


def df(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.fixture()
def folder(tmp_path):
    src = tmp_path / "proj"
    (src / "sub").mkdir(parents=True)
    (src / "node_modules").mkdir()
    (src / "a.md").write_text("We decided to use a database cache for the api server. The bug is a bug.")
    (src / "sub" / "b.txt").write_text("The roadmap and the milestone are planned.")
    (src / "sub" / "drop.txt").write_text("ignored")
    (src / "sub" / ".gitignore").write_text("drop.txt\n")
    (src / "node_modules" / "x.js").write_text("skipped")
    (src / "empty.txt").write_text("  \n")
    return src


def test_mine_search_delete(spark, folder, tmp_path):
    m = Memory(spark, str(tmp_path / "store"), embed.hashing)
    assert m.chunks().count() == 0 and m.search("cache").count() == 0
    assert m.mine(str(folder), dry_run=True)["added"] == 2 and m.chunks().count() == 0
    first = m.mine(str(folder))
    assert (first["files"], first["added"], first["skipped"]) == (2, 2, 0)
    assert m.mine(str(folder)) | {"topics": 0} == {"files": 0, "added": 0, "skipped": 2, "topics": 0}
    assert m.mine(str(folder), "other")["added"] == 2  # another domain's files are its own
    assert m.mine(str(folder), mode="general")["added"] == 0
    assert m.status()["embedding_count"] == 4
    hit = m.search("cache", domain="proj").collect()[0]
    assert hit.title == "a.md" and hit.topic == "technical"
    assert m.is_duplicate("The roadmap and the milestone are planned.") and not m.is_duplicate("zebra quilt")
    m.delete_chunk(hit.id)
    assert m.chunks("proj").count() == 1 and m.vectors().count() == 3
    m.repair()
    found = fts.search_index(*m.index(), df(spark, [(0, "roadmap")], "query_id long, query string"), saved=True).withColumn("id", F.col("id.id"))
    assert found.count() == 2


def test_protocol(spark, tmp_path):
    s = rpc.Server(Memory(spark, str(tmp_path / "store")))
    ask = lambda name, **a: json.loads(s.handle(json.dumps({"id": 7, "method": "tools/call", "params": {"name": f"memory_{name}", "arguments": a}}))["result"]["content"][0]["text"])
    assert s.handle("{")["error"]["code"] == -32700 and s.handle('{"id": 1, "method": "x"}')["error"]["code"] == -32601
    assert s.handle('{"method": "notifications/x"}') is None and s.handle('{"method": "initialize"}')["id"] is None
    assert len(s.handle('{"id": 1, "method": "tools/list"}')["result"]["tools"]) == 18
    bad = s.handle('{"id": 3, "method": "tools/call", "params": {"name": "memory_search", "arguments": {}}}')
    assert bad["id"] == "3" and bad["error"] == {"code": -32603, "message": "query is required"}
    one = ask("add_chunk", domain="d1", topic="T", content="alpha beta")["chunk_id"]
    ask("add_chunk", domain="d2", topic="t", content="gamma")
    ask("add_chunk", domain="d2", topic="u", content="delta")
    assert ask("list_domains")["domains"] == ["d1", "d2"] and ask("list_topics", domain="d2")["topics"] == ["t", "u"]
    assert [r["id"] for r in ask("search", query="beta")["results"]] == [one]
    assert ask("traverse", start_room="T")["topics"] == [{"topic": "u", "domain": "d2", "hops": 1}]
    assert ask("find_links")["links"] == [{"topic": "t", "connected_domains": ["d1", "d2"]}]
    assert ask("graph_stats")["edge_count"] == 1
    k = ask("kg_add", subject="Al B", predicate="knows", object="Cy", valid_from="2024-01-01")["triple_id"]
    assert ask("kg_add", subject="al b", predicate="knows", object="cy")["triple_id"] == k
    assert ask("kg_query", entity="Al B", as_of="2024-06-01")["count"] == 1
    ask("kg_invalidate", subject="Al B", predicate="knows", object="Cy", ended="2024-03-01")
    assert ask("kg_query", entity="cy", as_of="2024-06-01")["count"] == 0 and ask("kg_timeline")["timeline"][0]["valid_to"] == "2024-03-01"
    assert ask("kg_add", subject="Al B", predicate="knows", object="Cy")["triple_id"] != k
    assert ask("kg_stats") == {"entity_count": 2, "triple_count": 2, "active_triple_count": 1, "type_counts": {"unknown": 2}}
    for i in range(3):
        ask("log_write", agent_name="me", entry=f"e{i}", topic="x")
    log = ask("log_read", agent_name="me", last_n=2)
    assert log["count"] == 2 and log["entries"].index("e2") < log["entries"].index("e1")
    ask("delete_chunk", chunk_id=one)
    assert ask("search", query="beta")["count"] == 0 and ask("check_duplicate", content="gamma gamma delta")["is_duplicate"] is False
    assert "joy = joy" in s.handle('{"id": 1, "method": "tools/call", "params": {"name": "memory_get_aaak_spec"}}')["result"]["content"][0]["text"]


def test_command_line(spark, folder, tmp_path):
    def go(*argv, lines=""):
        out = io.StringIO()
        assert cli.run(spark, ["--store", str(tmp_path / "s"), "--no-embed", *argv], io.StringIO(lines), out) == 0
        return out.getvalue()

    assert "Initialised" in go("init")
    assert "2 files, 2 chunks added, 0 skipped." in go("mine", str(folder))
    assert "(proj/technical) a.md" in go("search", "cache") and "No results" in go("search", "zebra")
    assert json.loads(go("status"))["chunk_count"] == 2
    assert "[L1 ESSENTIAL STORY]" in go("wake-up", "--domain", "proj")
    assert "tokens" in go("compress", str(folder / "a.md"))
    assert go("embed") == "2 chunks embedded.\n" and "more" in go("embeddings", "--dims", "2")
    assert go("onboard", "--people", "Mark:friend, Zoe", "--projects", "Loq", "--scan", str(folder)) == "2 people, 1 projects, mode personal\n"
    assert json.loads((tmp_path / "s" / "registry.json").read_text())["ambiguous_flags"] == ["Mark"]
    (tmp_path / "mega").mkdir()
    (tmp_path / "mega" / "log.txt").write_text("\n".join([MARK, "2024-01-05 10:00 Ann wrote", "fix it", *"abcdef", MARK, "# head", "Bob and Ann said", *"xyzuvw"]))
    said = go("split", str(tmp_path / "mega"), str(tmp_path / "out"))
    assert said.count("bytes") == 2
    assert sorted(p.name for p in (tmp_path / "out").glob("*.txt")) == ["log__2024-01-05_Code-Ann_2024-01-05-1000-ann.txt", "log__unknown_Code-Bob_bob-and-ann-said.txt"]
    assert json.loads(go("serve", lines='{"id": 1, "method": "tools/list"}\n'))["result"]["tools"]


def test_transcripts(spark):
    tree = {"mapping": {"a": {"parent": None, "children": ["b"]}, "b": {"parent": "a", "message": {"author": {"role": "user"}, "content": {"parts": ["x", {"text": "y"}]}}, "children": ["c", "z"]}, "c": {"parent": "b", "message": {"author": {"role": "assistant"}, "content": {"parts": ["z"]}}, "children": ["b"]}}}
    cases = {
        json.dumps(tree): "> xy\n\nz", json.dumps([tree, tree]): "> xy\n\nz\n\n> xy\n\nz",
        '[{"user":"u","text":"hi"},{"user":"v","text":"yo"},{"user":"u","text":" "}]': "> hi\n\nyo",
        '{"chat_messages":[{"sender":"human","text":"q"},{"sender":"assistant","text":"r"}]}': "> q\n\nr",
        '[{"role":"user","content":[{"content":{"text":"deep"}},"b"]},{"role":"system","content":"s"}]': "> deep b\n\ns",
        '{"type":"human","message":{"content":"q"}}\n{"type":"tool"}\n{"type":"assistant","text":"r"}': "> q\n\nr",
        "3": "3", "[1, 2]": "[1, 2]", "plain": "plain", "": "", "> a\n> b\n> c": "> a\n> b\n> c",
    }
    for raw, want in cases.items():
        assert transcripts.normalize(raw) == want
    rows = df(spark, [(str(i), x) for i, x in enumerate([*cases, None])], "path string, content string")
    assert {r.content for r in transcripts.transcripts(rows).collect()} == {*cases.values(), None}


def test_entities(spark):
    text = "Ann said hi. Ann went home. Ann asked her. import Zed. using Zed and library Zed. Zed.py is. Bob Lee x, Bob Lee y, Bob\nLee"
    d = df(spark, [("x", text), ("e", ""), ("n", None)], "id string, content string")
    got = {r["name"]: (r.entity_type, r["count"], r.person_score, r.project_score) for r in entities.classify(extract.candidates(d), d).collect()}
    assert got["Ann"][0] == "person" and got["Zed"] == ("project", 4, 6, 9) and "Bob" not in got
    assert [(r["name"], round(r.confidence, 2)) for r in entities.learn(d, df(spark, [("zed",)], "name string"), 0.6).collect()] == [("Ann", 0.65)]
    assert entities.assign_codes(["Alice", "Alicia", "Ali", "Al", "Al "]) == {"Alice": "ALI", "Alicia": "LIC", "Ali": "AL1", "Al": "ALL", "Al ": "AL2"}
    e, t = entities.seed_facts(df(spark, [("person:Al", '{"likes":"tea"}', 1), ("Bo", '["x","y"]', 2), ("C", "bad", 3)], "key string, value string, seq int"))
    assert {(r.name, r.entity_type) for r in e.collect()} == {("Al", "person"), ("Bo", "unknown"), ("C", "unknown")}
    assert {(r.subject, r.predicate, r.object) for r in t.collect()} == {("Al", "likes", "tea"), ("Bo", "related_to", "x"), ("Bo", "related_to", "y")}


def test_memory_segments(spark):
    text = "import os\nWe decided to go.\n\n\n\n    x = 1\nOne more\n\nWe decided to go.\n\n" + ". ".join(f"word{i} " * 25 for i in range(6))
    got = [r.content for r in extract.memory_segments(df(spark, [("x", text), ("n", None)], "id string, content string")).orderBy("chunk_index").collect()]
    assert got[:2] == ["We decided to go.", "One more"] and len(got) == 4 and all(len(x) <= 500 for x in got)


def test_story(spark):
    rows = [(str(i), "d", "Big" if i % 3 else "small", "c", "f", f"text {i}", f"2024-01-{i + 10}") for i in range(9)]
    c = df(spark, rows, "id string, domain string, topic string, category string, source_file string, content string, filed_at string")
    assert layers.story(c).first().text == "[L1 ESSENTIAL STORY]\n\n## Big\ntext 8\ntext 7\n\n## small\ntext 6\ntext 3\n"
    assert layers.story(c, most=30).first().text == "[L1 ESSENTIAL STORY]\n\n## Big\nt" and layers.story(c, "none").first().text.endswith(layers.EMPTY)
    assert layers.on_demand(c, "d", "small", 2).first().text == "[L2 ON-DEMAND: d/small]\ntext 6\ntext 3\n"
    assert layers.deep_search(c, "8").first().text == "[L3 DEEP SEARCH: 8]\n[d/Big] text 8\n" and "No results" in layers.deep_search(c, "zzz").first().text


def test_evaluation(spark, tmp_path):
    data = {
        "turns": {"movie": [{"tid": 0, "message_list": [[{"user": "I like tea", "assistant": "fine", "time": "9"}], [{"user": "I saw Rome", "assistant": "nice"}]], "QA": {"question": "tea", "target_step_id": [[0, 0]]}}]},
        "messages": [{"id": "m", "question": "rome", "messages": ["I saw Rome", "other"], "evidence_messages": ["saw rome"]}, {"id": "z", "question": "absent", "messages": ["other"], "evidence_messages": ["x"]}],
        "dialogue": {"s1": {"dialogue": [{"speaker": "A", "text": ""}, {"speaker": "A", "text": "blue car"}], "qa": [{"question": "blue", "answers": ["car"], "evidence_utterance_ids": [1]}]}},
        "long": [{"session": [{"role": "user", "content": "the cat sat"}], "question": "cat", "answer": "SAT"}],
    }
    want = {"turns": 1, "messages": 1, "dialogue": 1, "long": 1}
    for shape, value in data.items():
        (tmp_path / shape).mkdir()
        (tmp_path / shape / f"{shape}.json").write_text(json.dumps(value))
        (tmp_path / shape / "bad.json").write_text("{")
        corpus, asked = datasets.read(spark, str(tmp_path / shape), shape)
        out = evaluate.run(corpus, asked)
        assert {r.hits for r in evaluate.summary(out).where("category IS NULL").collect()} == {want[shape]}
        assert out.count() == (2 if shape == "messages" else 1)


def test_search_within_equals_alone(spark):
    rows = [(str(i), f"g{i % 2}", "t", "c", "s", f"{'tea ' * (i % 3)} word{i} cup") for i in range(12)]
    c = df(spark, rows, "id string, domain string, topic string, category string, source_file string, content string").withColumn("g", F.col("domain"))
    q = df(spark, [(0, "tea cup", "g0"), (1, "tea cup", "g1")], "query_id long, query string, g string")
    got = {(r.query_id, r.id): round(r.score, 9) for r in fts.search(c, q, within="g").collect()}
    want = {(i, r.id): round(r.score, 9) for i in (0, 1) for r in fts.search(c.where(F.col("g") == f"g{i}"), q.where(F.col("query_id") == i)).collect()}
    assert got == want and got


def test_embeddings(spark):
    d = df(spark, [("a", "red tea"), ("b", "red tea"), ("c", " "), ("d", None)], "id string, content string")
    got = {r.id: r.v for r in d.select("id", embed.embedding(F.col("content")).alias("v")).collect()}
    assert got["a"] == got["b"] and abs(sum(x * x for x in got["a"]) - 1) < 1e-5 and not any(got["c"]) and not any(got["d"]) and len(got["a"]) == embed.SIZE


def test_nested_rules(spark):
    paths = df(spark, [(p,) for p in ("a.txt", "sub/a.txt", "sub/keep.txt", "other/x.txt")], "path string")
    rules = {"": ["*.txt", "!keep.txt"], "sub": ["!a.txt"], "other": ["!/other/x.txt"]}
    assert {r.path for r in files.scan(paths, rules).collect()} == {"sub/a.txt", "sub/keep.txt", "other/x.txt"}


def test_session_names(spark):
    one = lambda s: df(spark, [(s,)], "s string").select(sessions.slug(F.col("s")).alias("x")).first().x
    assert one("Fix: the  API -- bug, a long one") == "fix-the-api-bug-a-lo" and one("!!!") == "session"
    assert T.entity_key("Al O'Neil-X") == "al_oneil_x"


def test_stream_statistics(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("tea cup\ntea")
    run = lambda: ingest.corpus_statistics(ingest.files(spark, str(tmp_path / "in")).withColumnRenamed("path", "id"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    run()
    (tmp_path / "in" / "b.txt").write_text("cup Café")
    run()
    words, size = ingest.read_statistics(spark, str(tmp_path / "out"))
    assert {r.token: r.df for r in words.collect()} == {"tea": 1, "cup": 2, "cafe": 1}
    assert tuple(size.first()) == (2, 2.5)


def test_codes(spark, tmp_path):
    names = {"Ann": "ANN", "Ann Lee": "A$L"}
    extract.save_codes(str(tmp_path / "c.json"), names, ("Ann",))
    assert extract.load_codes(str(tmp_path / "c.json")) == (names, ("Ann",)) and extract.load_codes(str(tmp_path / "none")) == ({}, ())
    (tmp_path / "bad.json").write_text("[1")
    assert extract.load_codes(str(tmp_path / "bad.json")) == ({}, ())
    one = df(spark, [("ann lee met Ann",)], "s string").select(extract.substitute(F.col("s"), names, ("ann",)).alias("x"), extract.encode_entity(F.lit("ANN"), names).alias("c"), extract.encode_entity(F.lit("Bob"), names).alias("n")).first()
    assert one.x == "A$L met Ann" and one.c == "ANN" and one.n is None
    assert df(spark, [("ann lee met Ann, Anna",)], "s string").select(extract.substitute(F.col("s"), names).alias("x")).first().x == "A$L met ANN, Anna"


def test_settings(spark, tmp_path):
    path = str(tmp_path / "a" / "config.json")
    assert settings.load_config(path) == settings.CONFIG  # and writes it
    settings.save_config(path, {"store": "/x", "index": None})
    assert settings.load_config(path) == settings.CONFIG | {"store": "/x"}
    r = str(tmp_path / "registry.json")
    assert settings.load_registry(r) == settings.REGISTRY
    settings.save_registry(r, {"mode": "work", "people": {"Will": {"confidence": 0.9, "relationship": "friend"}}, "projects": ["Loq"], "ambiguous_flags": ["Will"], "codes": {}})
    held = settings.load_registry(r)
    assert held["mode"] == "work" and held["projects"] == ["Loq"]
    assert {(x.word, x.entity_type) for x in cli.who(spark, held, "Will met Loq zzz").collect()} == {("Will", "person"), ("met", "unknown"), ("Loq", "project"), ("zzz", "unknown")}
    (tmp_path / "registry.json").write_text('{"people": 3, "mode"')
    assert settings.load_registry(r) == settings.REGISTRY
    assert settings.edited(["Ann", "Bo"], "+Cy, -ANN,+bo, x, +") == ["Bo", "Cy"]
    settings.bootstrap(str(tmp_path), held, ["home"])
    assert "| Will | WIL | friend |" in (tmp_path / "entity_codes.md").read_text() and "Domains: home" in (tmp_path / "critical_facts.md").read_text()


def test_index_follows_writes(spark, tmp_path):
    m = Memory(spark, str(tmp_path / "s"), embed.hashing)
    m.init()
    first = m.add_chunk("d", "planning", "the roadmap of comets")
    for i in range(6):
        m.add_chunk("d", "general", f"other words number {i}")
    ids = lambda q: [r.id for r in m.search(q).collect()]
    model, m.model = m.model, None
    assert ids("roadmap") == [first]
    second = m.add_chunk("d", "planning", "a roadmap again")
    assert set(ids("roadmap")) == {first, second}
    m.delete_chunk(first)
    assert ids("roadmap") == [second]
    m.append("chunks", spark.createDataFrame([(first, "d", "planning", "c", "f", "comets without it", 0, "x", "2024")], "id string, domain string, topic string, category string, source_file string, content string, chunk_index int, added_by string, filed_at string"))
    assert ids("roadmap") == [second] and ids("comets") == [first]
    m.snapshot()
    assert ids("roadmap") == [second] and ids("comets") == [first]
    plain = fts.search(m.chunks(), df(spark, [(0, "comets")], "query_id long, query string")).first()
    assert abs(m.search("comets").first().score - plain.score) < 1e-9
    assert m.chunk(second)["topic"] == "planning" and m.chunk(first)["content"] == "comets without it" and m.chunk("none") is None
    key = m.add_fact("Ann", "knows", "Bo")
    assert m.fact(key)["confidence"] == 1.0 and m.entity("ann")["name"] == "Ann" and m.entity("zed") is None
    m.model = model
    assert m.embed() == 8 and len(m.vector(second)) == 384 and m.vector("none") is None
    assert m.nearest("roadmap again", n=1).first().id == second


def test_failing_texts_are_taken_up_again(spark, tmp_path):
    class Fussy:
        def __call__(self, texts):
            if any("comet" in t for t in texts):
                raise RuntimeError("no comet")
            return embed.hashing()(texts)

    m = Memory(spark, str(tmp_path / "s"), Fussy)
    bad = m.add_chunk("d", "general", "a comet came")
    for i in range(3):
        m.add_chunk("d", "general", f"other words {i}")
    assert m.embed() == 3 and [tuple(r) for r in m.failures().collect()] == [(bad, "RuntimeError: no comet")]
    m.model = embed.hashing
    assert m.embed() == 1 and m.failures().count() == 0 and m.vectors().count() == 4
