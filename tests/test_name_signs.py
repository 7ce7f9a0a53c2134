"""Signs and pronouns of names, however often a name's letters occur."""

import time

from loquat.operators import entities


def classes(spark, text, name):
    docs = spark.createDataFrame([("a", text)], "id string, content string")
    names = spark.createDataFrame([("a", name, 3)], "id string, name string, count long")
    return entities.classify(names, docs).first()


def test_work_does_not_grow_with_the_square_of_the_places(spark):
    classes(spark, "Er said", "Er")
    begun = time.time()
    r = classes(spark, "der ber er ver " * 20_000 + "x" * 200 + " Er said so", "Er")
    assert r.person_score == 3 and r.signal_types == 1
    assert time.time() - begun < 20


def test_a_line_end_is_no_part_of_an_address(spark):
    assert classes(spark, "dear \nAda, dear Ada.", "Ada").person_score == 4


def test_pronouns_are_counted_where_names_touch(spark):
    assert classes(spark, "AdaAda" + "-" * 47 + "he", "Ada").person_score == 2
    assert classes(spark, "he" + "-" * 45 + "AdaAda", "Ada").person_score == 4
    assert classes(spark, "she Ada", "Ada").person_score == 4
