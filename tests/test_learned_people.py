"""People learned: known ones go first, signs are looked for once and beside a name only."""

import random

from pyspark.sql import functions as F

from loquat.functions import constants as C
from loquat.operators import entities, extract


def test_known_people_go_before_anything_is_classified(spark):
    texts = ["Ada said so. So dear Ada, hi Ada, and he met Ada.", "Bob said so. So dear Bob, hi Bob, and he met Bob.", "Cy met Cy and Cy."]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, content string")
    people = spark.createDataFrame([("ADA",), (None,)], "name string")
    out = entities.learn(docs, people, 0.65)
    assert [(r.id, r.name, r["count"], r.confidence) for r in out.collect()] == [(1, "Bob", 4, 0.7)]
    many = spark.createDataFrame([(1, "so dear Bob said " * 7)], "id int, content string")
    assert entities.learn(many, people, 0.65).first().confidence == 0.85
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    signs = [line for line in plan.split("\n") if "replied" in line]
    assert len(signs) == 1 and signs[0].count("replied") == 1
    assert plan.index("LeftAnti") > plan.index("replied")  # nearer to the leaves


def test_a_run_of_any_length_is_a_name(spark):
    run = " ".join(["Ada"] * 50_000)
    docs = spark.createDataFrame([(1, f"{run}. Bob CyX, Bob Cy DaX and Bob\n Cy, {run}, {run}")], "id int, content string")
    got = {r.name: r["count"] for r in extract.candidates(docs, 1).collect()}
    assert got == {run: 3, "Bob Cy": 1, "Bob\n Cy": 1}


def test_signs_beside_a_name_are_those_of_the_text(spark):
    rng = random.Random(4)
    names = ["an an", "ada", "er", "ababab", "x y " * 60 + "x"]
    bits = ["said", "v1", "v", "version", "hi", "dear", "using", "import", "project", "tool", ".py", ".js ", " ", " ", "\n", "  ", " " * 39, " " * 45, "-", "ab", "an", "y x", "z" * 99, "word " * 90]
    rows = [(n, "".join(rng.choice([*bits, *[n] * 9, f" hi {n} said ", f" {n} was", f" using {n}.py ", f" {n} v1", f" tool  {n} "]) + rng.choice(["", " "]) for _ in range(rng.choice([9, 40])))) for n in names for _ in range(120)]
    cut = F.split("low", F.concat(F.lit(r"\Q"), F.col("key"), F.lit(r"\E")))
    signs = C.PERSON_SIGNS | C.PROJECT_SIGNS
    texts = spark.createDataFrame(rows, "key string, low string").withColumn("near", entities.beside(F.col("low"), cut, F.col("key")))
    both = texts.select(*[F.array(*entities._points(F.col(c), F.col("key"), signs)).alias(c) for c in ("low", "near")], (F.length("near") < F.length("low")).alias("less")).collect()
    assert all(r.low == r.near for r in both) and sum(r.less for r in both) > 20
    assert all(any(r.low[i] for r in both) for i in range(len(signs)))
