"""Segments, their manifest and merges, snapshots of the store."""

import pytest
from pyspark.sql import functions as F

from loquat.operators import store
from loquat.service import segments
from loquat.service.memory import Memory
from loquat.service.segments import BASE, Conflict, Segments


def values(table):
    return sorted(r.n for r in table.collect())


def test_writes_are_merged_by_levels(spark, tmp_path):
    t = Segments(spark, str(tmp_path), {"a": "n long", "b": "n long"}, fan=3)
    assert values(t.read("a")) == [] and t.merge("a") == 0
    for i in range(13):
        t.put({"a": spark.range(i, i + 1).select(F.col("id").alias("n")), "b": spark.createDataFrame([], "n long")})
        t.merge("a")
    levels = sorted(s["level"] for s in t.segments("a").values())
    assert levels == [0, 1, 2] and not t.segments("b")  # 13 = 9 + 3 + 1
    assert values(t.read("a")) == list(range(13)) and sum(s["rows"] for s in t.segments("a").values()) == 13
    assert t.vacuum() == 15 and t.vacuum() == 0 and values(t.read("a")) == list(range(13))


def test_what_is_cut_short_changes_nothing(spark, tmp_path, monkeypatch):
    t = Segments(spark, str(tmp_path), {"a": "n long"}, fan=2)
    rows = lambda n: spark.createDataFrame([(n,)], "n long")
    t.put({"a": rows(1)}), t.put({"a": rows(2)})
    before = t.state()
    with monkeypatch.context() as m:
        m.setattr(Segments, "commit", lambda self, change: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            t.merge("a")
    assert t.state() == before and values(t.read("a")) == [1, 2]
    (tmp_path / "manifest" / f"{before[0] + 1:020}.json").write_text('{"segments": {"x"')  # a version cut short
    assert values(t.read("a")) == [1, 2]
    t.put({"a": rows(3)})
    assert values(t.read("a")) == [1, 2, 3] and t.vacuum() == 1
    held = set(t.segments("a"))
    with pytest.raises(Conflict):
        t.put({"a": rows(9)}, expect={"a": set()})
    t.merge("a")
    with pytest.raises(Conflict):  # its segments are merged meanwhile
        t.put({"a": rows(9)}, 1, held)
    assert values(t.read("a")) == [1, 2, 3]
    assert t.put({"a": rows(5)}, batch=0)["a"] == 1 and t.put({"a": rows(5)}, batch=0)["a"] == 0 and t.put({"a": rows(6)}, batch=1)["a"] == 1
    assert values(t.read("a")) == [1, 2, 3, 5, 6]


def test_a_version_in_use_is_tried_again(spark, tmp_path, monkeypatch):
    t = Segments(spark, str(tmp_path), {"a": "n long"})
    rows = lambda n: spark.createDataFrame([(n,)], "n long")
    t.put({"a": rows(1)})
    state, stale = Segments.state, []
    monkeypatch.setattr(Segments, "state", lambda self: stale.pop() if stale else state(self))
    old = state(t)
    t.put({"a": rows(2)})
    stale.append(old)  # another writer has had the next version by now
    t.put({"a": rows(3)})
    assert values(t.read("a")) == [1, 2, 3]


def chunk(i, text="alpha"):
    return (i, "d", "planning", "c", f"{i}.txt", text, 0, "x", "2024")


def test_snapshot_holds_what_is_live(spark, tmp_path):
    m = Memory(spark, str(tmp_path))
    m.tables.fan = 3
    put = lambda *rows: m.append("chunks", spark.createDataFrame(list(rows), store.CHUNKS))
    view = lambda: sorted((r.id, r.content) for r in m.chunks().collect())
    found = lambda q: sorted(r.id for r in m.search(q).collect())
    put(chunk("a"), chunk("b"), chunk("a", "second of its id"))
    m.delete_chunk("b")
    put(chunk("b", "beta again"), chunk("c"))
    m.append("chunks", spark.createDataFrame([chunk("a", "later")], store.CHUNKS))
    want = [("b", "beta again"), ("c", "alpha")]
    assert [x for x in view() if x[0] != "a"] == want and len(view()) == 3 and found("beta") == ["b"]
    before = view()
    m.snapshot()
    assert view() == before and found("beta") == ["b"] and not m.tables.segments("deleted")
    assert [s["level"] for s in m.tables.segments("chunks").values()] == [BASE]
    plan = m.chunks()._jdf.queryExecution().toString()
    assert "Window" not in plan and "Join" not in plan  # the snapshot alone
    m.delete_chunk("c")
    put(chunk("c", "gamma"), chunk("b", "not taken"), chunk("d", "delta"))
    assert [x for x in view() if x[0] != "a"] == [("b", "beta again"), ("c", "gamma"), ("d", "delta")]
    assert found("gamma") == ["c"] and found("taken") == []
    for i in range(4):
        m.add_chunk("d", "planning", f"word{i} delta")
        assert len(found("delta")) == i + 2
    assert len(m.tables.segments("chunks")) <= 6 and len(m.tables.segments("sizes")) <= 6
    m.delete_chunk("d")
    rows = sorted((r.id, round(r.score, 9)) for r in m.search("delta").collect())
    m.snapshot()
    assert sorted((r.id, round(r.score, 9)) for r in m.search("delta").collect()) == rows and len(rows) == 4
    m.repair()
    assert sorted((r.id, round(r.score, 9)) for r in m.search("delta").collect()) == rows
    assert m.tables.read("postings").where("id.id = 'd'").count() == 0
    assert segments.BASE == BASE and m.tables.vacuum() > 0 and len(view()) == 7
