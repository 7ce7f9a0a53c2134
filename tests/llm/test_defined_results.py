"""Reference versions, defined results for odd input, and the other ways of
operators beyond what they broadcast."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm_operators import brute_components, brute_lines, check_chat, check_warc, frame, odd_docs

from loquat.llm import chain_crf, chat, decontaminate, fingerprint, flat, jaccard_join, language, line_dedup, packing, quality, queries, shared, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, odd_docs())


# --- learned operators against plain versions


def test_mixture_is_plain_em():
    rng = random.Random(4)
    words = {f"l{i}": ["".join(rng.choice("abcdefgh"[2 * i : 2 * i + 4]) for _ in range(rng.randrange(2, 6))) for _ in range(60)] for i in range(3)}
    model = language.fit_texts([(" ".join(w), k) for k, w in words.items()])
    texts = [" ".join(rng.choice(words[rng.choice(list(words)[: rng.randrange(1, 4)])]) for _ in range(n)) for n in (1, 3, 10, 40, 200)]
    got = language.infer(texts, model, 1e-9)
    for text, row in zip(texts, got.itertuples()):
        logs = []
        for w in re.findall("[a-z]+", text):
            ids, first, _, _ = language.trigrams([w])
            logs.append([float(model.table[k][ids].astype(float).sum()) for k in range(3)])
        logs = np.array(logs)

        def em(allowed, start):
            pi = np.where(allowed, start, 0) / np.where(allowed, start, 0).sum()
            like = np.exp(np.maximum(logs - logs.max(1, keepdims=True), -60))
            for _ in range(5000):
                post = like * pi
                pi = (post / post.sum(1, keepdims=True)).mean(0)
            return pi, (np.log((like * pi).sum(1)) + logs.max(1)).sum()

        full, _ = em(np.ones(3, bool), np.ones(3))
        order, best = np.argsort(-full, kind="stable"), None
        for k in (1, 2, 3):
            allowed = np.isin(np.arange(3), order[:k])
            pi, fit = em(allowed, full + 1e-3)
            value = fit - 0.5 * (k - 1) * math.log(len(logs) + 1)
            if best is None or value > best[0] + 1e-9:
                best = value, pi
        want = {model.langs[j]: p for j, p in enumerate(best[1]) if p > 1e-6}
        assert {k: v for k, v in row.proportions.items() if v > 1e-6} == pytest.approx(want, abs=2e-3)
        assert row.lang == max(want, key=want.get)


def chain(scores, trans, begin):
    """Marginals of state 1 by plain forward and backward sums in logs."""
    n = len(scores)
    e = np.zeros((n, 2))
    e[:, 1] = np.clip(scores, -30, 30)
    t = np.asarray(trans).reshape(2, 2)
    a, b = np.zeros((n, 2)), np.zeros((n, 2))
    a[0] = np.asarray(begin) + e[0]
    for i in range(1, n):
        a[i] = [np.logaddexp(a[i - 1, 0] + t[0, j], a[i - 1, 1] + t[1, j]) + e[i, j] for j in (0, 1)]
    for i in range(n - 2, -1, -1):
        b[i] = [np.logaddexp(t[j, 0] + e[i + 1, 0] + b[i + 1, 0], t[j, 1] + e[i + 1, 1] + b[i + 1, 1]) for j in (0, 1)]
    z = a + b
    return np.exp(z[:, 1] - np.logaddexp(z[:, 0], z[:, 1]))


def logit(x, w):
    return 1 / (1 + math.exp(-(w[0] + sum(a * b for a, b in zip(x, w[1:])))))


def test_toxic_scores_are_a_plain_chain():
    rng = random.Random(2)
    words = [f"wort{i}" for i in range(200)]
    rows = []
    for i in range(300):
        w = [rng.choice(words) for _ in range(rng.randrange(1, 50))]
        if i % 5 == 0:
            w[rng.randrange(len(w))] = "scoundrel" + rng.choice(["s", "ly", ""])
        rows.append((" ".join(w), int(i % 5 == 0)))
    model = toxicity.fit_texts(rows, {0: 240, 1: 60})
    texts = [t for t, _ in rows[:40]] + ["one", "scoundrels", ""]
    old, flat.CHUNK = flat.CHUNK, 300
    try:
        got = toxicity.score_texts(texts, model)
    finally:
        flat.CHUNK = old
    for text, score, spans in zip(texts, got.score, got.spans):
        start, end, _, _, ids = toxicity.tokens([text])
        p = chain(model.weights[ids].astype(float).sum(1), model.trans, model.begin) if len(ids) else np.zeros(0)
        top = sorted(p, reverse=True)[:2] + [0, 0]
        total = p.sum()
        assert score == pytest.approx(logit([top[0], top[1], math.log1p(total), math.log1p(100 * total / (len(p) + 10))], model.calibration), abs=1e-6)
        assert [(s["start"], s["end"]) for s in spans] == [(a, b) for a, b, x in zip(start, end, p) if x >= model.threshold]


def test_quality_scores_are_a_plain_chain():
    good, bad = "A calm line of ordinary words here.", "BUY NOW!! BUY NOW!! CLICK!! HERE!!"
    model = quality.fit_texts([("\n".join([good] * 5), 1)] * 30 + [("\n".join([good, *[bad] * 4]), 0)] * 30, {0: 30, 1: 30})
    for text in ("\n".join([good, bad, good]), good, "", "\n\n" + bad, "short\nlines\n" * 20):
        got = quality.score_texts([text], model)
        ids, _, size = quality.lines([text])
        p = chain(model.weights[ids].sum(1), model.trans, model.begin)
        mean, top = (p * size).sum() / max(size.sum(), 1), (p * np.minimum(size / 50, 1)).max()
        assert got.score[0] == pytest.approx(logit([mean, top], model.calibration), abs=1e-6)
        assert got.bad_lines[0] == list(np.flatnonzero(p >= 0.5))


def test_near_copies_of_the_training_sample():
    rng = random.Random(9)
    base = [" ".join(f"w{rng.randrange(5000)}" for _ in range(80)) for _ in range(30)]
    part = " ".join(base[0].split()[:30])
    texts = base + [base[3] + " more", base[4]] + [part + " " + " ".join(f"x{rng.randrange(5000)}" for _ in range(120)) for _ in range(20)]
    kept = toxicity.distinct(texts)
    assert 30 not in kept and 31 not in kept and len(kept) == len(texts) - 2  # a common passage makes no copies


def test_toxicity_small_sample(spark):
    """Two of the 18 toxic documents held out at this size are line noise without a toxic word."""
    sf = "/root/testdata/sf0.01"
    out = queries.op3_toxic_spans(spark, sf).toPandas().merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    out = out[out.held_out]
    assert ((out.predicted == 1) & (out.toxic == 1)).sum() >= 16 and ((out.predicted == 1) & (out.toxic == 0)).sum() == 0


# --- empty tables, clashing columns, repeated rows


def test_fits_on_empty_tables(spark, odd):
    none, labels = frame(spark, [], DOCS), frame(spark, [], LABELS)
    some = frame(spark, [(i, i % 2, i % 2) for i in range(30)] + [(None, 1, 1), (3, None, None)], LABELS)
    assert language.identify(none, language.fit(none)).count() == 0
    assert {r.language.lang for r in language.identify(odd, language.fit(none)).collect()} == {"und"}
    for op, column in ((toxicity, "toxicity"), (quality, "quality")):
        for docs, given in ((none, labels), (odd, labels), (none, some)):
            model = op.fit(docs, given)
            out = op.score(odd, model)
            assert op.score(none, model).count() == 0 and out.count() == 11
            assert len({r.s for r in out.select(F.col(f"{column}.score").alias("s")).collect()}) == 1
    assert fingerprint.fingerprints(none).count() == 0 and line_dedup.dedup_lines(none).count() == 0


def test_outputs_replace_no_column(spark, odd):
    model = language.fit_texts([("the cat", "en"), ("der hund", "de")])
    nothing = toxicity.fit_texts([], {}), quality.fit_texts([], {})
    makers = {
        "language": lambda d, **k: language.identify(d, model, **k), "toxicity": lambda d, **k: toxicity.score(d, nothing[0], **k),
        "quality": lambda d, **k: quality.score(d, nothing[1], **k), "clean": lambda d, **k: line_dedup.dedup_lines(d, **k),
    }
    for name, make in makers.items():
        clash = odd.withColumn(name.upper(), F.lit("mine"))
        with pytest.raises(ValueError):
            make(clash)
        out = make(clash, output="other")
        assert out.columns == [*clash.columns, "other"] and {r[0] for r in out.select(name.upper()).collect()} == {"mine"}
        again = make(odd.unionByName(odd)).select("doc_id", F.to_json(F.struct(name)).alias("x"))
        assert {n % 2 for n in Counter((r.doc_id, r.x) for r in again.collect()).values()} == {0}  # repeated rows are judged alike


# --- words of any length


def test_long_words_are_told_apart(spark):
    a, b = "a" * 1024, "b" * 1024
    rng = random.Random(1)
    blocks = ["".join(rng.choice("xyz") for _ in range(1024)) for _ in range(6)]
    words = [a + b, b + a, a + a, a + b + a + b, b + a + a + b, "".join(blocks), "".join(blocks[::-1]), "".join(blocks[1:] + blocks[:1]), a + b]
    rows = list(enumerate(words)) + [(100 + i, f"one two three four {w} five six" + " seven" * 3) for i, w in enumerate(words)]
    got = Counter(tuple(r) for r in jaccard_join.near_duplicates(frame(spark, rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id").collect())
    assert got == brute_components(rows)
    old, jaccard_join.SEGMENT = jaccard_join.SEGMENT, 3000
    try:
        parts = jaccard_join.shingle_sets([t for _, t in rows])
    finally:
        jaccard_join.SEGMENT = old
    assert all((x == y).all() for x, y in zip(parts, jaccard_join.shingle_sets([t for _, t in rows])))


def test_blocks_by_size_and_shares(spark, monkeypatch):
    from test_llm_operators import near_copies

    monkeypatch.setattr(jaccard_join, "TEXT", 1000)
    monkeypatch.setattr(jaccard_join, "LIMIT", 0)
    rows = near_copies(9)
    df = frame(spark, rows, "doc_id long, text string")
    assert jaccard_join.n_blocks(df) > 20
    got = Counter(tuple(r) for r in jaccard_join.near_duplicates(df).select("doc_id", "n_shingles", "component_id").collect())
    assert got == brute_components(rows)
    held = jaccard_join.groups(df.withColumn("row", F.monotonically_increasing_id()), carry=("row",))
    assert held.select("row").distinct().count() == len(rows) and held.where("n_shingles = 0 AND label IS NOT NULL").count() == 0


# --- beyond what is broadcast


def test_warc_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(warc, "LIMIT", 0)
    big = ["x" * 1500, "é" * 700, "y" * 2000]
    rows = [(i, f"u{i}", big[i % 3] if i % 4 else "small" * (i % 5), None) for i in range(400)] + [(None, "n", big[0], None), (399, "again", big[0], None)]
    check_warc(spark, rows)
    # small pages and copies of one payload are dealt over many tasks
    pages = frame(spark, [(i, "u", "s") for i in range(5000)] + [(10_000 + i, "u", big[0]) for i in range(5000)], "page_id long, url string, html string")
    held = warc.decide(pages.repartition(16)).withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    assert max(r["count"] for r in held) < 5000


def test_lines_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "LIMIT", 0)
    rows = [(i, "\n".join(random.Random(i).sample(["menu", "footer", f"own {i}", "", "rare", "menu"], 4)), ["a", None][i % 2]) for i in range(60)] + [(99, None, "a"), (98, "", None)]
    df = frame(spark, [(*r, 1, 2) for r in rows], "doc_id long, text string, source string, _salt int, _turn int")
    out = line_dedup.dedup_lines(df, "source", "text", 0.3, 5)
    assert out.columns == df.columns + ["clean"] and Counter((r.doc_id, r.clean.text) for r in out.collect()) == brute_lines(rows, 0.3, 5)


def test_hosts_of_urls(spark):
    urls = {"http://A.example:80/x?y=//z": "a.example", "https://me:pw@b.org": "b.org", "ftp://[::1]:21/": "[::1]", "HTTP://c.de#f": "c.de", "no url": None, "http:///x": None, None: None}
    got = frame(spark, [(u,) for u in urls], "url string").select("url", line_dedup.host_of(F.col("url")).alias("h")).collect()
    assert {r.url: r.h for r in got} == urls


def test_leaks_beyond_the_broadcast(spark, monkeypatch):
    rng = random.Random(5)
    items = [(i, " ".join(f"w{rng.randrange(900)}" for _ in range(rng.choice([4, 12, 30])))) for i in range(20)]
    rows = [(d, " ".join([f"w{rng.randrange(900)}" for _ in range(20)] + items[d % 20][1].split() + ["end"])) for d in range(60)]
    docs, b = frame(spark, rows, "doc_id long, text string"), frame(spark, items, "item_id long, text string")
    want = sorted(map(tuple, decontaminate.contaminated(docs, b).collect()))
    monkeypatch.setattr(decontaminate, "LIMIT", 0)
    monkeypatch.setattr(decontaminate, "TEXT", 0)
    assert sorted(map(tuple, decontaminate.contaminated(docs, b).collect())) == want and len(want) >= 60
    assert decontaminate.decontaminate(docs, b).count() == 0


# --- packing, chats, shared helpers


def test_packing_against_sequential_best_fit(spark):
    for seed, capacity in ((1, 1024), (2, 1024), (3, 64)):
        rng = random.Random(seed)
        sizes = [min(capacity, int(rng.lognormvariate(math.log(capacity / 4), 0.9)) + 1) for _ in range(2000)]
        gaps = []
        for n in sorted(sizes, reverse=True):
            fit = min((i for i, g in enumerate(gaps) if g >= n), key=gaps.__getitem__, default=None)
            if fit is None:
                gaps.append(capacity - n)
            else:
                gaps[fit] -= n
        out = packing.best_fit(frame(spark, [(i, n) for i, n in enumerate(sizes)], "doc_id long, length long"), capacity).collect()
        by = {}
        for r in out:
            by.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert sorted(r.length for r in out) == sorted(sizes)
        for parts in by.values():
            at = 0
            for o, n in sorted(parts):
                assert o == at
                at += n
            assert at <= capacity
        assert len(by) <= len(gaps) * 1.01 + 2


def test_chats_in_many_batches(spark, monkeypatch):
    monkeypatch.setattr(chat, "BYTES", 200)
    rng = random.Random(3)
    rows = [(rng.randrange(30), t, rng.choice(["user", "assistant", "tool"]), "x" * rng.randrange(60) + rng.choice(["", "<|", "é"]), None) for t in range(600)]
    rows += [(7, 10_000 + t, "assistant", f"long one {t}", None) for t in range(900)]  # a conversation over several batches
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)
    try:
        check_chat(spark, rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_shared_folder_and_addresses(spark, tmp_path):
    written = shared.materialise(spark.range(10).repartition(3), "some")
    a = shared.addressed(written.where("id < 9"), "f", "p")
    assert a.select("f", "p").distinct().count() == 9 and a.columns == ["id", "f", "p"]
    assert shared.addressed(spark.range(5), "f", "p").select("f", "p").distinct().count() == 5
    shared.discard(written, spark.range(3))
    with pytest.raises(Exception):
        spark.read.parquet(written.written_to).count()

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        class _jsc:
            @staticmethod
            def sc():
                return Context

        class getCheckpointDir:
            @staticmethod
            def isDefined():
                return False

    class Session:
        sparkContext = Context()
        conf = {}

    Session.sparkContext.getConf = lambda: {}
    with pytest.raises(ValueError):
        shared.shared_folder(Session())


def test_chain_parts(monkeypatch):
    """A fit does not depend on the parts its sample is dealt in."""
    rng = np.random.default_rng(0)
    f, starts = rng.integers(0, 50, (400, 3)).astype(np.int32), np.arange(0, 400, 7)
    y = rng.random(400) < 0.4
    whole = chain_crf.fit(f, 50, y, starts, rounds=5)
    monkeypatch.setattr(chain_crf, "PART", 20)
    assert all(np.allclose(a, b) for a, b in zip(whole, chain_crf.fit(f, 50, y, starts, rounds=5)))


def test_language_sample_is_the_least_hashes(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    held = []
    monkeypatch.setattr(language, "fit_texts", held.append)
    known = docs.where("length(text) <= 200000 AND lang IS NOT NULL AND doc_id IS NOT NULL AND crc32(cast(cast(doc_id AS string) AS binary)) % 4 != 2")
    known = sorted(known.selectExpr("xxhash64(doc_id) AS h", "doc_id", "text", "lang").collect())
    for k in (3, 20, 10**6):
        language.fit(docs, per_language=k)
        plain = [r for lang in {r.lang for r in known} for r in [x for x in known if x.lang == lang][:k]]
        assert held.pop() == sorted((r.text, r.lang) for r in plain)
