"""Facts as of a time by buckets of days against a plain comparison."""

import random

from pyspark.sql import functions as F

from loquat.operators import kg

FACTS = "subject string, valid_from string, valid_to string, n int"


def test_as_of_is_plain_comparison(spark):
    rng = random.Random(4)
    day = lambda: f"{rng.choice([0, 1970, 2023, 2024, 2024, 9999]):04}-{rng.randrange(1, 13):02}-{rng.randrange(1, 32):02}"
    text = lambda: rng.choice([day(), day(), day() + "T10:00", None, "2024", "soon", "", "2024-13-01", "10000-01-01"])
    facts = [(rng.choice(["busy", "busy", "e1", "e2", None]), text(), text(), i) for i in range(400)]
    probes = [(rng.choice(["busy", "busy", "e1", "none", None]), text(), i) for i in range(120)]
    got = kg.as_of_join(spark.createDataFrame(probes, "entity string, t string, probe int"), spark.createDataFrame(facts, FACTS))
    assert got.columns == ["entity", "t", "probe", "subject", "valid_from", "valid_to", "n"]
    below = lambda a, t: a is None or (t is not None and a <= t)
    above = lambda b, t: b is None or (t is not None and b >= t)
    want = sorted((p, n) for e, t, p in probes for s, a, b, n in facts if e is not None and e == s and below(a, t) and above(b, t))
    assert sorted((r.probe, r.n) for r in got.collect()) == want and len(want) > 2000


def test_buckets_are_few_and_make_up_the_days(spark):
    spans = [(0, 0), (3, 9), (0, 8**8 - 1), (5, 8**8 - 1), (744_000, 753_300), (7, 6), (63, 64)]
    rows = spark.createDataFrame(spans, "low long, high long").select("low", "high", kg._buckets(F.col("low"), F.col("high")).alias("b")).collect()
    for r in rows:
        parts = sorted((b.number * 8**b.level, (b.number + 1) * 8**b.level) for b in r.b)
        assert len(parts) <= 14 * 8
        assert not parts if r.low > r.high else (parts[0][0], parts[-1][1]) == (r.low, r.high + 1) and all(x[1] == y[0] for x, y in zip(parts, parts[1:]))
