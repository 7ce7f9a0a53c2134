"""Nearest vectors through clusters against the plain search."""

import numpy as np

from loquat.operators import clusters, vectors

KIND = "id string, embedding array<float>"


def rows(n=3000, size=16, spread=0.05):
    rng = np.random.default_rng(6)
    middle = rng.normal(size=(30, size))
    x = middle[rng.integers(0, 30, n)] + spread * rng.normal(size=(n, size))
    x[: n // 3] = middle[0]  # a third are one vector: ties, and one cluster's work
    return [(f"v{i:05}", [float(v) for v in r]) for i, r in enumerate(x)] + [("null", None), ("short", [1.0]), ("zero", [0.0] * size)]


def key(found):
    return sorted((r.query_id, r.rank, r.id, round(r.score, 5)) for r in found.collect())


def test_rows_are_those_of_the_plain_search(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(clusters, "PER_BLOCK", 64)
    table = spark.createDataFrame(rows(), KIND).repartition(3)
    asked = table.where("id LIKE '%50' OR id = 'zero'").withColumnRenamed("id", "query_id")
    clusters.save(table, str(tmp_path), 32, 1000)
    read = {}
    got = clusters.knn(spark, str(tmp_path), asked, 5, read)
    assert key(got) == key(vectors.knn(table, asked, 5)) and read["share"] < 0.5
    other = spark.createDataFrame([("null", None), ("short", [1.0])], "query_id string, embedding array<float>")
    assert clusters.knn(spark, str(tmp_path), other).count() == 0


def test_empty_index(spark, tmp_path):
    clusters.save(spark.createDataFrame([], KIND), str(tmp_path))
    asked = spark.createDataFrame([("a", [1.0])], "query_id string, embedding array<float>")
    assert clusters.knn(spark, str(tmp_path), asked).count() == 0
