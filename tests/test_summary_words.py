"""A summary's topics and codes, counted without a fold of the row."""

from pyspark.sql import functions as F

from loquat.functions import constants as C
from loquat.functions import text as T
from loquat.operators import extract


def folds(plan: str) -> int:
    return plan.count("lambdafunction(")


def test_topics_and_codes_of_odd_texts(spark):
    texts = [
        None, "", "abc de", "alpha Beta alpha beta Gamma", "ΟΔΟΣ οδος ΟΔΌΣ Straße STRASSE İstanbul istanbul", "that Have with this", "wordy_one wordy_one Éclair éclair\néclair",
        "ǅabc ǅabc plain Plain PLAIN plain", "𝐀bcd 𐐀𐐁𐐂𐐃 𐐨𐐩𐐪𐐫", "We DECIDED to Love it, I'm so happy! core PRINCIPLE. turning point?",
    ]
    want = ["", "", "", "beta+gamma+alpha", None, None, None, None, None, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, content string")
    made = extract.compress(docs)
    got = dict(made.collect())
    assert [got[i].split("|")[0] for i, w in enumerate(want) if w is not None] == [w for w in want if w is not None]
    assert got[4].split("|")[0] == "οδος+istanbul+οδός" and got[5].split("|")[0] == ""
    assert got[6].split("|")[0] == "éclair+wordy_one" and "plain" in got[7].split("|")[0]
    plain = docs.select("id", T.codes(F.col("content"), C.EMOTIONS, C.EMOTION_CODES).alias("e"), T.codes(F.col("content"), C.FLAGS, {}).alias("f"))
    assert {r.id: [r.e, r.f] for r in plain.collect()} == {i: s.split("|")[-2:] for i, s in got.items()}
    assert folds(extract.summary_topics(docs)._jdf.queryExecution().optimizedPlan().toString()) == 0
