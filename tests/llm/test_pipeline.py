import re
from collections import Counter

from pyspark.sql import functions as F
from test_llm_operators import brute_components, brute_lines, check_packing

import corpus_pipeline
from loquat.llm import jaccard_join, toxicity
from loquat.llm.queries import MIN_PAGES, RATIO
from loquat.llm.shared import materialise, read_table


def test_stages(spark, sf):
    docs = read_table(spark, sf, "documents")
    names = docs.columns
    odd = spark.createDataFrame([(10**6, None, None, None, None), (None, "", None, None, None), (10**6 + 1, "x", "en", "s", 1)], docs.schema)
    docs = docs.unionByName(odd).selectExpr("*", "1 as _clean", "2 as _toxicity", "3 as _spare", "4 as component_id")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf), name)
        assert docs.columns == [*names, "_clean", "_toxicity", "_spare", "component_id"]
        assert 0 < docs.count() <= before
        before = docs.count()
    found = jaccard_join.near_duplicates(docs)
    assert found.where("doc_id != component_id").count() == 0
    packed = corpus_pipeline.pack(spark, docs, sf).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.select("doc_id").collect()}
    assert {10**6, None, 10**6 + 1} <= {r.doc_id for r in packed}


def test_empty(spark, sf):
    docs = read_table(spark, sf, "documents").where("false")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert out.count() == 0


def test_null_and_repeated_ids(spark, sf):
    text = {c: " ".join(f"{c}{i}" for i in range(30)) for c in "abcdef"}
    near = text["a"].replace("a29", "other")
    rows = [(None, "a"), (7, "a"), (7, "a"), (None, "a"), (9, "near"), (5, "b"), (4, "b"), (5, "c"), (None, "d"), (None, "d"), (None, "e"), (3, "f"), (3, "f")]
    rows = [(d, text.get(c, near)) for d, c in rows] + [(None, None), (None, None), (4, ""), (4, "")]
    docs = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, row int").coalesce(1)
    kept = corpus_pipeline.drop_copies(spark, docs, sf)
    assert kept.columns == docs.columns and kept.schema == docs.schema
    # one row of each group: the first of the smallest id that is not null
    assert sorted(r.row for r in kept.collect()) == [1, 6, 7, 8, 10, 11, 13, 14, 15, 16]

    item = max((r.text for r in read_table(spark, sf, "benchmark").collect()), key=len)
    rows = [(None, item), (None, text["a"]), (1, text["b"]), (1, "before " + item), (2, text["c"]), (None, None), (1, None)]
    docs = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, row int")
    kept = corpus_pipeline.drop_leaks(spark, docs, sf)
    assert kept.columns == docs.columns
    assert sorted((r.row, r.doc_id) for r in kept.collect()) == [(1, None), (2, 1), (4, 2), (5, None), (6, 1)]


def plain_leaks(rows, items):
    """Texts that hold an item: some window of its words, or the whole of a shorter text, is alike enough."""
    split = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    grams = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)])
    out = set()
    wanted = [(len(w), grams(w)) for w in map(split, items) if w]
    for text in {t for _, t, *_ in rows}:
        w = split(text)
        own = grams(w) if w else Counter()
        for n, g in wanted:
            if sum((g & own).values()) < 0.8 * sum(g.values()):
                continue
            for s in range(max(len(w) - n, 0) + 1):
                h = grams(w[s : s + n])
                common = sum((g & h).values())
                if common >= 0.8 * (sum(g.values()) + sum(h.values()) - common):
                    out.add(text)
    return out


def test_stages_against_plain_versions(spark, sf, monkeypatch):
    """Each stage on its own input; ids are null and repeated among them."""
    docs = read_table(spark, sf, "documents")
    real = [tuple(r) for r in docs.collect()]
    odd = [(None, real[3][1], "en", "x", 1), (None, real[3][1], "en", "x", 1), (real[5][0], real[6][1], None, None, 2), (real[5][0], "", None, None, 0), (None, None, None, None, None), (10**7, "a b", "en", "y", 3), (10**7, "a b", "en", "y", 3)]
    docs = materialise(spark.createDataFrame(real + odd, docs.schema), "docs")
    model = toxicity.fit(docs, read_table(spark, sf, "labels"))
    scores = toxicity.score_texts([t for _, t, *_ in real + odd], model).score
    kept = materialise(corpus_pipeline.drop_toxic(spark, docs, sf), "kept")
    assert Counter(map(tuple, kept.collect())) == Counter(r for r, s in zip(real + odd, scores) if s < 0.7)

    rows = [tuple(r) for r in kept.collect()]
    clean = materialise(corpus_pipeline.drop_boilerplate(spark, kept, sf), "clean")
    want = brute_lines([(d, t, s) for d, t, _, s, _ in rows], RATIO, MIN_PAGES)
    assert Counter((r.doc_id, r.text) for r in clean.collect()) == want
    assert all(r.n_chars == len(r.text or "") for r in clean.collect())

    rows = [tuple(r) for r in clean.collect()]
    for limit in (corpus_pipeline.LIMIT, 0):
        monkeypatch.setattr(corpus_pipeline, "LIMIT", limit)
        single = materialise(corpus_pipeline.drop_copies(spark, clean, sf), "single")
        got = Counter(map(tuple, single.collect()))
        assert not got - Counter(rows)
        # numbered rows give each group a name of its own, whatever its ids are
        names = {i: c for i, _, c in brute_components([(i, t) for i, (_, t, *_) in enumerate(rows)])}
        groups = {}
        for i, (d, t, *_) in enumerate(rows):
            if (t or "").split():
                groups.setdefault(names[i], []).append((d is None, d or 0, t))
        best = sum(1 for _ in groups)
        blank = sum(not (t or "").split() for _, t, *_ in rows)
        assert sum(got.values()) == best + blank
        texts = Counter((d is None, d or 0, t) for d, t, *_ in got.elements() if (t or "").split())
        assert all(sum(texts[x] for x in set(g)) == 1 and min(x[:2] for x in g) in {x[:2] for x in g if texts[x]} for g in groups.values())

    rows = [tuple(r) for r in single.collect()]
    items = [r.text for r in read_table(spark, sf, "benchmark").collect()]
    bad = plain_leaks(rows, items)
    rest = corpus_pipeline.drop_leaks(spark, single, sf)
    assert Counter(map(tuple, rest.collect())) == Counter(r for r in rows if r[1] not in bad)
    check_packing(corpus_pipeline.pack(spark, rest, sf).collect(), [(r.doc_id, r.text) for r in rest.collect()], 1024)


def test_columns_of_their_own_pass_through(spark, sf):
    docs = read_table(spark, sf, "documents").limit(60)
    own = docs.select("*", F.lit("dot").alias("a.b"), F.lit(1).alias("_clean"), F.lit(2).alias("_file"), F.lit(3).alias("_given"), F.lit(4).alias("_toxicity"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, own = own, materialise(stage(spark, own, sf), "own")
        assert own.columns == before.columns and {tuple(r) for r in own.select("`a.b`", "_clean", "_file", "_given", "_toxicity").distinct().collect()} <= {("dot", 1, 2, 3, 4)}
    assert own.count() > 10 and corpus_pipeline.pack(spark, own, sf).count() > 0
