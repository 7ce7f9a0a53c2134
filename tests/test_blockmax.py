"""Pruned search against the full one."""

import random

import pytest
from pyspark.sql import functions as F

from loquat.operators import blockmax, fts, store


def corpus(n=400):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(n):
        picked = [words[min(int(rng.expovariate(0.15)), 39)] for _ in range(rng.choice([1, 3, 20, 60, 200]))]
        rows.append((f"c{i:03}", rng.choice(["red", "blue"]), rng.choice(["t1", "t2", None]), "cat", f"f{i}.txt", rng.choice([None, ""]) if i % 50 == 49 else " ".join(picked), 0, "x", "2024"))
    return rows + [(f"same{i}", "red", "t1", "cat", "s.txt", "w1 w2", 0, "x", "2024") for i in range(60)]  # ties over blocks


def key(rows):
    return sorted((r.query_id, r.rank, r.id, round(r.score, 6)) for r in rows)


def test_pruned_rows_are_those_of_the_full_search(spark, tmp_path):
    chunks = spark.createDataFrame(corpus(), store.CHUNKS)
    asked = spark.createDataFrame([(1, "w1 w2"), (2, "w0"), (3, "w9 w3 w9"), (4, "w30 w1"), (5, "nothing"), (6, ""), (7, None), (8, "red w5"), (9, "w1.w2 w4"), (10, "w39"), (11, "txt")], "query_id long, query string")
    blockmax.save(chunks, str(tmp_path), 8)
    rest = lambda q: fts.search(chunks, q, 5)
    read = {}
    got = blockmax.search(spark, str(tmp_path), asked, 5, rest=rest, read=read)
    assert key(got.collect()) == key(fts.search(chunks, asked, 5).collect())
    assert read["first"] + read["second"] < read["full"] / 2
    single = asked.where("query_id <> 9")
    got = blockmax.search(spark, str(tmp_path), single, 5, domain="red", topic="t1")
    assert key(got.collect()) == key(fts.search(chunks, single, 5, domain="red", topic="t1").collect())
    with pytest.raises(ValueError):
        blockmax.search(spark, str(tmp_path), asked, 5)


def test_empty_index_and_no_queries(spark, tmp_path):
    chunks = spark.createDataFrame([], store.CHUNKS)
    blockmax.save(chunks, str(tmp_path))
    asked = spark.createDataFrame([(1, "w1")], "query_id long, query string")
    assert blockmax.search(spark, str(tmp_path), asked).count() == 0
    assert blockmax.search(spark, str(tmp_path), asked.where(F.lit(False))).count() == 0


def test_packed_chunks_are_places_and_equal_queries_one_group(spark, tmp_path):
    chunks = spark.createDataFrame(corpus(100), store.CHUNKS)
    blockmax.save(chunks, str(tmp_path), 8)
    packed = spark.read.parquet(f"{tmp_path}/blocks").schema["docs"].dataType.elementType
    assert "id" not in packed.names
    reads = []
    for n in (1, 5):
        asked = spark.createDataFrame([(i, "w1 w2" if i % 2 else "w2 w1") for i in range(n)], "query_id long, query string")
        reads.append({})
        got = blockmax.search(spark, str(tmp_path), asked, 5, read=reads[-1]).collect()
        assert len(got) == 5 * n
    assert reads[0] == reads[1]
