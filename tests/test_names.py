"""Names as rows against names as patterns; functions in SQL against their DataFrame forms."""

from pyspark.sql import functions as F

from loquat.functions import sql
from loquat.operators import chunking, extract, names

REGISTRY = {"Anna Lee": "ANL", "Lee Smith Jones": "LSJ", "Anna": "AN$", "Bob_1": "B\\1", "o'neil": "ONL", "a b": "AB", "b a": "BA", "São Paulo": "SAO"}
TEXTS = ["Anna Lee Smith Jones met ANNA, anna-lee and Bob_1.", "a b a b a b, O'Neil", "", "são paulo  Anna  Lee Anna Lee", None, "xAnna Anna_ Annab Lee", "Anna Lee", "a b a b a b, O'Neil", "b a b a b", " , ", "Anna " * 500]


def registry(spark, more=()):
    return spark.createDataFrame([*REGISTRY.items(), *more], "name string, code string")


def test_codes_are_those_of_the_patterns(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, content string")
    odd = [("ANNA", "AN$"), ("", "x"), (None, "x"), ("C++", "x"), ("met", None)]
    ordered = dict(sorted(REGISTRY.items(), key=lambda x: x[0].lower()))
    want = {r.id: r.x for r in docs.select("id", extract.substitute(F.col("content"), ordered).alias("x")).collect()}
    assert {r.id: r.content for r in names.encode(docs, registry(spark, odd)).collect()} == want
    assert names.encode(docs, registry(spark).where("false")).exceptAll(docs).isEmpty()
    assert names.encode(docs.where("false"), registry(spark)).isEmpty()


def test_repeated_and_null_ids_and_columns_of_clashing_names(spark):
    docs = spark.createDataFrame([(1, "Anna", 5, "p"), (1, "Bob_1", 6, "q"), (None, "Anna Lee", 7, "r"), (None, "Anna Lee", 7, "r")], "id int, content string, _spans int, `a.b` string").withColumn("_text", F.lit(0))
    out = names.encode(docs, registry(spark))
    assert out.columns == docs.columns
    assert sorted((r.content, r._spans, r["a.b"]) for r in out.collect()) == [("AN$", 5, "p"), ("ANL", 7, "r"), ("ANL", 7, "r"), ("B\\1", 6, "q")]
    said = names.mentions(docs.select("id", "content"), registry(spark))
    assert {(r.id, r.name, r["count"]) for r in said.collect()} == {(1, "anna", 1), (1, "bob_1", 1), (None, "anna", 2), (None, "anna lee", 2)}


def test_a_hundred_thousand_names_have_the_plan_of_a_few(spark):
    docs = spark.createDataFrame([(1, "name7 of 99999, Name12 Of 12 and name 3")], "id int, content string")
    plan = lambda n: names.encode(docs, spark.range(n).selectExpr("concat('Name', id, ' of ', id) AS name", "concat('<', id, '>') AS code"))._jdf.queryExecution().optimizedPlan().toString().count("\n")
    assert plan(10) == plan(100_000)
    many = spark.range(100_000).selectExpr("concat('Name', id, ' of ', id) AS name", "concat('<', id, '>') AS code")
    assert names.encode(docs, many).first().content == "name7 of 99999, <12> and name 3"


def test_shuffle_joins_give_the_same_rows(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, content string")
    want = sorted(map(str, names.encode(docs, registry(spark)).collect()))
    monkeypatch.setattr(names, "LIMIT", -1)
    assert sorted(map(str, names.encode(docs, registry(spark)).collect())) == want


def test_functions_in_sql(spark):
    sql.register(spark)
    sql.register(spark)
    long = "One sentence of words. " * 90 + "\n\n" + "x" * 2000 + "\n\n\n  tail  "
    texts = [long, "", "   ", None, "> a\n> b\nanswer\n\n> c", "no quote\n> q\n" + "line\n" * 12, "> only", "BEGIN one\nx\nBegin two\nold\nBEGIN\ny"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, content string")
    rows = lambda call, view: spark.sql(f"SELECT id, {view.split(' AS ')[1]} FROM (SELECT id, {call} AS parts FROM {{d}}) LATERAL VIEW {view}", d=docs)
    same = lambda a, b: a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    assert same(rows("chunks_of(content, 300, 40)", "posexplode(parts) AS chunk_index, content"), chunking.chunk_text(docs, 300, 40))
    assert same(rows("exchanges_of(content, 8)", "posexplode(parts) AS chunk_index, content"), chunking.exchanges(docs))
    assert same(rows("sessions_of(content, 'begin', array('OLD'), 1)", "inline(parts) AS session, line_no, line"), chunking.sessions(docs, "begin", ["OLD"], 1))
    plan = rows("exchanges_of(content, 8)", "posexplode(parts) AS chunk_index, content")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
