"""Hard negatives, URL rules and fill-in-middle against brute force."""

import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_llm_operators import frame, odd_docs

from loquat.llm import fill_middle, hard_negatives, queries, url_rules

# --- hard negatives

VECTORS = "vec_id long, embedding array<double>, label int, slot string"


def brute_negatives(rows, is_anchor, positives=5, negatives=3):
    usable = []
    for i, x, label, _ in rows:
        if i is None or label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        q = [math.floor(256 * c) if math.isfinite(256 * c) else None for c in x]
        if None in q or sum(c * c for c in q) >= 2**62:
            continue
        usable.append((i, q, label))
    out = []
    for a, x, label in usable:
        if not is_anchor(a):
            continue
        others = [(-sum(p * q for p, q in zip(x, y)), i, other) for i, y, other in usable if i != a and len(y) == len(x)]
        for ps, p in sorted((s, i) for s, i, other in others if other == label)[:positives]:
            fits = sorted((s, i) for s, i, other in others if other != label and 50 * -ps <= 100 * -s <= 95 * -ps)
            out += [(a, p, n, i, -ps, -s) for n, (s, i) in enumerate(fits[:negatives], 1)]
    return sorted(out)


def odd_vectors():
    rng = random.Random(5)
    rows = [(i, [rng.choice([0.5, 0.25, 0.1, -0.2, 0.0]) for _ in range(4)], rng.randrange(3), "x") for i in range(300)]
    rows += [(i, [0.5, 0.5, 0.5, 0.5], i % 3, "hot") for i in range(300, 420)]  # a common vector: ties everywhere
    rows += [(500 + i, [0.3 * i, 0.2], i % 2, "two long") for i in range(12)] + [(600, [], 0, ""), (601, [], 1, ""), (550, [], 0, "")]
    rows += [(None, [1.0] * 4, 0, None), (700, None, 1, None), (701, [1.0] * 4, None, None), (702, [1.0, None, 1.0, 1.0], 1, None), (750, [float("nan")] * 4, 0, ""), (703, [float("inf"), 0.0, 0.0, 0.0], 0, "")]
    rows += [(704, [1e300, 0.0, 0.0, 0.0], 0, "too large"), (800, [1e6, 2e6, 3e6, 1e6], 1, "large"), (801, [2e6, 1e6, 3e6, 1e6], 1, "large"), (802, [1e6, 1e6, 2e6, 1e6 + 1 / 256], 0, "large")]
    return rows + rows[:3] + rows[:3] + [(50, [0.1, 0.5, 0.25, 0.5], 1, "another of that id")]


def test_negatives_are_brute_force(spark, monkeypatch):
    rows = odd_vectors()
    want = brute_negatives(rows, lambda i: i % 50 == 0)
    table = spark.createDataFrame(rows, VECTORS)
    got = hard_negatives.mine(table.repartition(3), F.col("vec_id") % 50 == 0)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 60
    monkeypatch.setattr(hard_negatives, "WAVE", 3)
    monkeypatch.setattr(hard_negatives, "BLOCK", 16)
    monkeypatch.setattr(hard_negatives, "TILE", 2)
    got = hard_negatives.mine(table.repartition(5), F.col("vec_id") % 50 == 0)
    assert sorted(map(tuple, got.collect())) == want


def test_negatives_of_empty_tables(spark):
    empty = spark.createDataFrame([], VECTORS)
    out = hard_negatives.mine(empty, F.col("vec_id") % 50 == 0)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"] and out.count() == 0
    lone = spark.createDataFrame([(50, [1.0, 1.0], 1, "a"), (51, [1.0, 0.9], 2, "a")], VECTORS)
    assert hard_negatives.mine(lone, F.col("vec_id") % 50 == 0).count() == 0


def test_products_beyond_doubles_are_exact():
    a, c = np.array([[2.0**30, 1.0]]), np.array([[2.0**30, 1.0], [2.0**29 + 1, 3.0]])
    assert hard_negatives._products(a, c).tolist() == [[2**60 + 1, 2**30 * (2**29 + 1) + 3]]


def test_lists_merge_by_score_and_id():
    rng = np.random.default_rng(0)
    for _ in range(100):
        n, k = rng.integers(1, 6), rng.integers(1, 5)
        top_s, top_i, seen = np.full((n, k), hard_negatives.NONE), np.full((n, k), 2**63 - 1), [[] for _ in range(n)]
        for _ in range(rng.integers(1, 5)):
            m = rng.integers(1, 9)
            ids, s = np.sort(rng.integers(0, 20, m)), rng.integers(-3, 4, (n, m))
            s[s == -3] = hard_negatives.NONE
            for r in range(n):
                seen[r] += [(-int(x), int(i)) for x, i in zip(s[r], ids) if x > hard_negatives.NONE]
            hard_negatives._insert(s, ids, top_s, top_i)
        assert [[(-int(x), int(i)) for x, i in zip(*t) if x > hard_negatives.NONE] for t in zip(top_s, top_i)] == [sorted(x)[:k] for x in seen]


# --- URL rules


def brute_verdict(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in ((h, p or "", v) for h, p, v in rules) if h and v and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[3] if best else None, best[4] if best else default


RULES = [
    ("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.net", "/en/x", "block"), ("example.net", "/en/x/y/", "allow"), ("org", "/fr/", "allow"), ("com", "", "block"),
    ("a.com", "", "allow"), ("-b.com", "/", "allow"), ("b.com", "/p", "block"), ("b.com", "/p", "allow"), ("b.com", "q", "block"), ("", "/", "block"), (None, "/", "block"), ("c.com", None, "allow"), ("d.com", "/", None),
    ("x.a.com", "/p/", "block"), ("ü.net", "/ß", "allow"),
]


def odd_urls():
    rng = random.Random(2)
    hosts = ["net", "example.net", "www.example.net", "notexample.net", "org", "a.org", "com", "a.com", "x.a.com", "y.x.a.com", "-b.com", "b.com", "c.com", "d.com", "ü.net", "EXAMPLE.net", "example.net.", "example.net:80", "u@example.net", ".net", ""]
    paths = ["", "/", "/en/", "/en/x", "/en/x/y/z", "/EN/", "/en", "/p", "/p/q?x=/en/", "/fr/#top", "?p=1", "#/en/", "/ß/1", "/en/x/y"]
    urls = [f"{rng.choice(['http', 'https', ''])}://{h}{p}" for h in hosts for p in paths]
    return urls + [None, "", "no scheme/en/", "http:/x", "://", "a://b.com/p://example.net/en/", "http://net/" + "y" * 5000, "http://" + "a." * 60 + "net/x\ny"] + ["http://hot.example.net/en/x"] * 200


def test_url_rules_are_brute_force(spark):
    urls = odd_urls()
    pages = spark.createDataFrame([(i, u, f"r{i}", "c") for i, u in enumerate(urls)], "page_id long, url string, rule string, `a.b` string").repartition(3)
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = url_rules.judge(pages, rules)
    assert got.columns == ["page_id", "url", "rule", "a.b", "url_rule"]
    got = {r["page_id"]: tuple(r["url_rule"]) for r in got.collect()}
    assert got == {i: brute_verdict(u, RULES) for i, u in enumerate(urls)}


def test_url_rules_beyond_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(url_rules, "LIMIT", -1)
    urls = odd_urls()
    pages = spark.createDataFrame([(i % 7, u) for i, u in enumerate(urls)], "page_id long, url string")  # repeated ids
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = url_rules.judge(pages, rules, default="block").collect()
    assert sorted((r["page_id"], r["url"] or "", *map(str, r["url_rule"])) for r in got) == sorted((i % 7, u or "", *map(str, brute_verdict(u, RULES, "block"))) for i, u in enumerate(urls))
    none = url_rules.judge(pages, rules.limit(0)).select("url_rule.*").distinct().collect()
    assert {r["verdict"] for r in none} == {"allow"} and {r["rule"] for r in none} == {None}
    assert url_rules.judge(pages.limit(0), rules).count() == 0
    with pytest.raises(ValueError):
        url_rules.judge(pages.withColumn("url_rule", F.lit(1)), rules)


def test_url_rules_start_no_python(spark, sf):
    plan = queries.op12_url_rules(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


# --- fill in middle


def brute_fim(i, text, seed="1", rate=90, spm=20):
    text = text or ""
    n, digest = len(text), hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if n == 0 or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return "plain", n, None, None, text
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < spm:
        return "spm", n, a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return "psm", n, a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


def fim_texts():
    rng = random.Random(1)
    return [(rng.choice([None, *range(1000)]), rng.choice([None, "", "<", "S>", *["".join(rng.choice(["a", "é", "𝒳", "<", "S>", "<P", "<M>" if rng.random() < 0.02 else "x", "語", "\n"]) for _ in range(rng.choice([1, 2, 5, 100, 3000]))) for _ in range(9)]])) for _ in range(400)]


def test_batches_are_brute_force():
    for a in range(0, 400, 37):
        ids, texts = zip(*fim_texts()[a : a + 37])
        got = fill_middle.transform_batch(list(ids), pa.array(texts, pa.string()), "1", 90, 20).to_pylist()
        assert [tuple(g.values()) for g in got] == [brute_fim(i, t) for i, t in zip(ids, texts)]
        assert fill_middle.transform_batch(list(ids[3:]), pa.array(texts, pa.string())[3:], "1", 90, 20).to_pylist() == got[3:]
    assert fill_middle.transform_batch([], pa.array([], pa.string()), "1", 90, 20).num_rows == 0


def test_rank_and_select_are_inverse():
    text = "".join(random.Random(3).choice("aé語𝒳") for _ in range(20_000))
    marks = fill_middle.Boundaries(np.frombuffer(text.encode(), np.uint8))
    k = np.arange(len(text))
    at = marks.select(k)
    assert at.tolist() == np.concatenate([[0], np.cumsum([len(c.encode()) for c in text])[:-1]]).tolist()
    assert (marks.rank(at) == k).all() and marks.rank([len(text.encode())]) == [len(text)]


def test_fill_in_middle_and_back(spark):
    rows = fim_texts() + [(d[0], d[1]) for d in odd_docs()] + [(9, "long é" * 100_000)]
    table = frame(spark, [(i, t, "form") for i, t in rows], "doc_id long, text string, `a.form` string")
    made = fill_middle.fill_in_middle(table)
    assert made.columns == ["doc_id", "text", "a.form", "fim"]
    got = made.select("doc_id", "text", "fim.form", "fim.n", "fim.prefix_chars", "fim.middle_chars", F.col("fim.text").alias("out"), fill_middle.restore(F.col("fim.text"), F.col("fim.form")).alias("back")).collect()
    assert sorted(map(repr, ((r[0], r[1], *tuple(r)[2:7]) for r in got))) == sorted(repr((i, t, *brute_fim(i, t))) for i, t in rows)
    assert all(r["back"] == (r["text"] or "") for r in got) and {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(table.limit(0)).count() == 0
    with pytest.raises(ValueError):
        fill_middle.fill_in_middle(table, output="text")
    other = fill_middle.fill_in_middle(table, seed="7", rate=50, spm=100).select("doc_id", "text", "fim.form").collect()
    assert sorted(map(repr, map(tuple, other))) == sorted(repr((i, t, brute_fim(i, t, "7", 50, 100)[0])) for i, t in rows)
