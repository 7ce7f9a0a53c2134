"""Texts whose words are alike: a pair at the threshold is found."""

from loquat.operators import vectors


def test_pairs_at_the_threshold_are_not_missed(spark):
    n = 20_000  # 67 of these pairs were missed with 8 bands of 4 values
    text = lambda own: f"concat_ws(' ', transform(sequence(1, 18), j -> concat('w', id, 'x', j)), '{own}')"
    docs = spark.range(n).selectExpr("id", f"{text('one')} AS content")
    held = spark.range(n).selectExpr(f"id + {n} AS id", f"{text('two')} AS content")
    got = vectors.word_duplicates(docs, held).where(f"id - query_id = {n} AND similarity = 0.9")
    assert got.count() == n
    assert vectors.word_duplicates(docs.where("id < 0"), held).count() == 0
