"""Many queries over one corpus: equal ones are searched once, and no pair of query and chunk is shuffled before the best are kept."""

import re

from pyspark.sql import functions as F

from loquat.operators import fts, store
from loquat.service.memory import Memory


def test_equal_queries_are_one_search(spark):
    words = [f"w{i}" for i in range(14)]
    rows = [(f"c{i}", " ".join(words[i % 5:] + words[: i % 3]), "red", "t", "x", "f.txt") for i in range(30)]
    chunks = spark.createDataFrame(rows, "id string, content string, domain string, topic string, category string, source_file string")
    asked = [" ".join(words), "w3 w4", "w4 w3", "w1 w1", "w9-w10 w2", "w9-w10", "none w1", "w7"]
    queries = spark.createDataFrame([(i, q) for i, q in enumerate(asked * 20)], "query_id long, query string")
    found = fts.search(chunks, queries, 4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(query_id#\d+L?, id#", plan)
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id, round(r.score, 9)))
    for i, q in enumerate(asked):
        assert all(sorted(got.get(i, [])) == sorted(got.get(i + 8 * n, [])) for n in range(20))
        alone = fts.search(chunks, queries.where(F.col("query_id") == i), 4).collect() if i in (0, 4) else None
        assert alone is None or sorted((r["rank"], r.id, round(r.score, 9)) for r in alone) == sorted(got[i])
    # all 14 words stand in chunks that begin with the first ones
    assert {r[1] for r in got[0]} <= {f"c{i}" for i in range(30) if set(rows[i][1].split()) == set(words)} and len(got[0]) == 4
    assert 6 not in got and [r[2] for r in got[1]] == [r[2] for r in got[2]]


def test_index_of_the_store_is_written_where_its_chunks_are(spark, tmp_path):
    m = Memory(spark, str(tmp_path))
    rows = [(f"c{i}", "red", "t", "x", "f.txt", f"apple w{i}", 0, "me", f"2024-01-{i + 1:02}") for i in range(9)]
    m.append("chunks", spark.createDataFrame(rows, store.CHUNKS))
    postings, sizes = m.index()
    assert sizes.count() == 9 and postings.where("token = 'apple'").count() == 9
    plan = m._sorted(postings)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" in plan
