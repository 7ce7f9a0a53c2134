"""Work that is to grow no faster than its tables."""

import random
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from loquat.operators import evaluate, kg, topicgraph, vectors


def test_probes_of_one_time_are_asked_once(spark):
    facts = spark.range(2000).selectExpr("'a' AS subject", "'p' AS predicate", "'o' AS object", "IF(id % 2 = 0, '2024-01-01', NULL) AS valid_from", "IF(id % 4 = 0, '2024-01-05', NULL) AS valid_to", "id")
    probes = spark.range(2000).selectExpr("'a' AS entity", "CASE WHEN id < 1990 THEN '2024-01-03' WHEN id < 1995 THEN '2024-02-01' WHEN id < 1998 THEN 'soon' END AS t", "id AS probe")
    got = kg.as_of_summary(probes, facts, n=F.count("*"), last=F.max("id"))
    want = kg.as_of_join(probes, facts.withColumnRenamed("id", "n")).groupBy("probe").agg(F.count("*").alias("n"), F.max("n").alias("last"))
    assert sorted(got.select("probe", "n", "last").collect()) == sorted(want.select("probe", "n", "last").collect())


def test_a_start_that_has_found_enough_goes_no_further(spark):
    rng = random.Random(4)
    rows = [(i, f"t{rng.randrange(150):03}", f"d{rng.randrange(60):02}", "", "2024") for i in range(260)]
    rows += [(1000 + i, f"u{i:03}", f"d{rng.choice([3, 7]):02}", "", "2024") for i in range(80)]
    n = topicgraph.nodes(spark.createDataFrame(rows, "id long, topic string, domain string, category string, filed_at string"))
    starts = n.select(F.col("topic").alias("start"))
    every = {}
    for r in topicgraph.traverse_all(n, starts, 4, None).collect():
        every.setdefault(r.start, []).append((r.hops, r.topic_key, r.domain))
    for most in (1, 6):
        got = {}
        for r in topicgraph.traverse_all(n, starts, 4, most).collect():
            got.setdefault(r.start, []).append((r.hops, r.topic_key, r.domain))
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v)[:most] for k, v in every.items()}


def test_a_tasks_scores_are_bounded_whatever_a_batch_has(spark):
    rng = np.random.default_rng(1)
    sent = SimpleNamespace(value=(pa.array(np.arange(1000)), rng.normal(size=(1000, 16))))
    rows = rng.normal(size=(10_000, 16))
    batch = pa.record_batch([pa.array(np.arange(10_000)), pa.array(list(rows))], ["id", "embedding"])
    tracemalloc.start()
    out = next(vectors._nearest(sent, 5, 16)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    best = np.sort(sent.value[1] @ rows.T, axis=1)[:, :-6:-1]
    assert np.allclose(out.column("score").to_numpy().reshape(1000, 5), best)
    assert peak < 120e6, peak


def test_recall_by_labels_looks_up_what_was_found(spark):
    found = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (2, 3, 1), (3, 1, 6), (4, 9, 1)], "query_id long, id long, rank int")
    asked = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x"), (4, None)], "query_id long, category string")
    labels = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (9, None)], "id long, category string")
    got = sorted((r.category or "", r.queries, r.hits) for r in evaluate.labelled(found, asked, labels).collect())
    assert got == [("", 1, 0), ("", 4, 1), ("x", 3, 1)]
