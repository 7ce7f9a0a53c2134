"""Names are replaced in a text's own row: no place is shuffled, however often names stand."""

import random
import re

from loquat.operators import names


def plain(text, codes):
    """The longest names first, of equally long ones the first by name, then by place."""
    if text is None:
        return None
    cut = re.findall(r"\w+|\W+", text)
    low = [x.lower() for x in cut]
    places = [(-len(n), n, at, at + k) for n in codes for k in [len(re.findall(r"\w+|\W+", n))] for at in range(len(cut)) if low[at].isalnum() and "".join(low[at : at + k]) == n]
    taken, out = set(), list(cut)
    for _, n, a, b in sorted(places):
        if not taken & set(range(a, b)):
            taken |= set(range(a, b))
            out[a:b] = [codes[n]] + [""] * (b - a - 1)
    return "".join(out)


def test_overlapping_names_in_long_texts(spark, monkeypatch):
    rng = random.Random(7)
    words, between = ["a", "b", "cc", "Dd", "e1"], [" ", ", ", "-"]
    said = lambda n: "".join(rng.choice(words) + rng.choice(between) for _ in range(n))
    codes = {said(rng.choice([1, 2, 2, 3, 3, 5])).rstrip(" ,-").lower(): f"<{i}>" for i in range(60)}
    texts = [said(rng.choice([0, 3, 30, 300])) + rng.choice(["", "a"]) for _ in range(80)] + [None, "", "a"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, content string").repartition(3)
    known = spark.createDataFrame(list(codes.items()), "name string, code string")
    want = {i: plain(t, codes) for i, t in enumerate(texts)}
    assert {r.id: r.content for r in names.encode(docs, known).collect()} == want
    monkeypatch.setattr(names, "LIMIT", -1)
    assert {r.id: r.content for r in names.encode(docs, known).collect()} == want


def test_no_place_is_shuffled(spark, monkeypatch):
    docs = spark.range(10).selectExpr("id", "concat(id, repeat(' ada met bob and ada lee', 1000)) AS content")
    known = spark.createDataFrame([("Ada", "A"), ("bob", "B"), ("ada lee", "C")], "name string, code string")
    out = names.encode(docs, known)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.where("content = concat(id, repeat(' A met B and C', 1000))").count() == 10
    monkeypatch.setattr(names, "LIMIT", -1)  # of more names the different runs of a text
    assert names.occurrences(docs, names.registry(known), once=True).groupBy("id").count().where("count > 4").isEmpty()
    assert names.encode(docs, known).where("content = concat(id, repeat(' A met B and C', 1000))").count() == 10


def test_a_name_of_any_length(spark):
    long = "ada " * 20_000 + "lee"
    docs = spark.createDataFrame([(1, f"so {long} ada"), (2, "ada")], "id int, content string")
    known = spark.createDataFrame([(long, "L"), ("ada", "A")], "name string, code string")
    assert {r.content for r in names.encode(docs, known).collect()} == {"so L A", "A"}
