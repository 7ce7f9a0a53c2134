"""The ten operators against brute force, round trips and held-out labels."""

import gzip
import hashlib
import io
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from loquat.llm import chain_crf, chat, decontaminate, fingerprint, jaccard_join, language, line_dedup, packing, quality, queries, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def odd_docs():
    """Nulls in every column, empty, blank and long texts, ties, repeats."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    return [
        (1, None, "en", "a", 0), (2, "", "en", None, 0), (3, " \n\t ", None, "a", 4), (4, "one two", "en", "a", 7), (4, "one two", "en", "a", 7),
        (5, "one two", "fr", "b", 7), (6, long, "en", "b", len(long)), (None, "no id here at all today", None, None, None), (7, long + " end", "en", "b", 1),
        (8, "ÀÉ <|endoftext|> ß 𝒳 <|im_end|>", "de", "b", 9), (4, "other text of the same id", "en", "a", 7),
    ]


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, odd_docs())


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def plain(docs):
    return [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]


# --- chain


def test_chain_marginals_by_enumeration():
    import itertools

    rng = np.random.default_rng(0)
    lens = [1, 5, 9, 3]
    starts = np.cumsum([0, *lens[:-1]])
    e, tr, be = rng.normal(size=sum(lens)), rng.normal(size=4), rng.normal(size=2)
    want = []
    for s, n in zip(starts, lens):
        z, acc = 0, np.zeros(n)
        for y in itertools.product((0, 1), repeat=n):
            p = np.exp(be[y[0]] + sum(e[s + i] for i in range(n) if y[i]) + sum(tr[2 * y[i - 1] + y[i]] for i in range(1, n)))
            z, acc = z + p, acc + p * np.array(y)
        want += list(acc / z)
    old, chain_crf.WIDTH = chain_crf.WIDTH, 4
    try:
        got = chain_crf.marginals(e, starts, tr, be)
    finally:
        chain_crf.WIDTH = old
    assert np.allclose(got, want)


# --- 1, 3, 10: learned operators


def held(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus


def test_language_held_out(spark):
    out = queries.op1_language_mixture(spark, "/root/testdata/sf0.01").toPandas()
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").toPandas()
    both = out.merge(truth, on="doc_id")
    both = both[both.held_out]
    assert len(both) > 50 and (both.lang == both.lang_pred).mean() > 0.97
    assert set(both.doc_id) == {d for d in truth.doc_id if held(d, 4) == 2}


def test_language_mixture_and_edges(spark, odd):
    rows = [("the cat sat on the mat and the dog ran to the house", "en")] * 5 + [("der hund und die katze sind nicht im haus geblieben", "de")] * 5
    model = language.fit_texts(rows)
    text = "the cat sat on the mat and the dog ran to the house " * 3 + "der hund und die katze sind nicht im haus geblieben " * 3
    got = language.infer([text, "the house and the mat", "", None, "12 34 !"], model)
    assert set(got.proportions[0]) == {"en", "de"} and 0.3 < got.score[0] < 0.7
    assert set(got.proportions[1]) == {"en"} and list(got.lang[2:]) == ["und"] * 3 and not got.score[2:].any()
    out = language.identify(odd, model).collect()
    assert len(out) == 11 and {r.doc_id: r.language.lang for r in out}[1] == "und"
    assert language.infer(["abc"], language.fit_texts([])).lang[0] == "und"
    assert language.fit(odd.where("false")).langs == []


def test_language_mixture_of_eight():
    rng = random.Random(8)
    words = {f"l{i}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz"[3 * i : 3 * i + 3]) for _ in range(5)) for _ in range(40)] for i in range(8)}
    model = language.fit_texts([(" ".join(w), lang) for lang, w in words.items()])
    got = language.infer([" ".join(x for w in words.values() for x in w), " ".join(words["l3"])], model)
    assert set(got.proportions[0]) == set(words) and 0.1 < got.score[0] < 0.2
    assert set(got.proportions[1]) == {"l3"}


def test_toxicity_held_out(spark):
    out = queries.op3_toxic_spans(spark, "/root/testdata/sf0.1").toPandas()
    truth = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").toPandas()
    both = out.merge(truth, on="doc_id")
    both = both[both.held_out]
    hit, said, real = ((both.predicted == 1) & (both.toxic == 1)).sum(), (both.predicted == 1).sum(), (both.toxic == 1).sum()
    assert hit / said > 0.9 and hit / real > 0.9
    assert out.score.between(0, 1).all()


def test_toxicity_spans_and_edges(spark, odd):
    rng = random.Random(1)
    words = [f"wort{i}" for i in range(300)]
    rows = []
    for i in range(400):
        w = [rng.choice(words) for _ in range(60)]
        if i % 4 == 0:
            w[rng.randrange(60)] = "scoundrel" + rng.choice(["s", "ly", "", "ish"])
            w[rng.randrange(60)] = "scoundrel"
        rows.append((" ".join(w), int(i % 4 == 0)))
    model = toxicity.fit_texts(rows, {0: 300, 1: 100})
    text = "wort1 wort2 Scoundrelly, wort3 scoundrel wort4"
    got = toxicity.score_texts([text, "wort1 wort2 wort5", "", None], model)
    assert got.score[0] > 0.7 > got.score[1] and got.score[2] == got.score[3] < 0.5
    assert [text[s["start"] : s["end"]] for s in got.spans[0]] == ["Scoundrelly", "scoundrel"]
    assert toxicity.score(odd, model).count() == 11
    assert toxicity.score_texts(["a"], toxicity.fit_texts([], {})).score[0] < 0.01
    assert toxicity.score_texts(["a"], toxicity.fit_texts([("a", 1)], {1: 1})).score[0] > 0.99


def test_quality_held_out(spark):
    out = queries.op10_quality(spark, "/root/testdata/sf0.1").toPandas()
    both = out.merge(spark.read.parquet("/root/testdata/sf0.1/labels.parquet").toPandas(), on="doc_id")
    both = both[both.held_out]
    assert (both.predicted == both.quality).mean() > 0.95


def test_quality_lines_and_edges(spark, odd):
    good, bad = "A calm line of ordinary words here.", "BUY NOW!! BUY NOW!! CLICK!! HERE!!"
    model = quality.fit_texts([("\n".join([good] * 5), 1)] * 30 + [("\n".join([good, *[bad] * 4]), 0)] * 30, {0: 30, 1: 30})
    got = quality.score_texts(["\n".join([good] * 4), "\n".join([bad] * 4), "", None, "\n".join([good, good, bad, bad])], model)
    assert got.score[0] > 0.7 and got.score[1] < 0.3 and got.bad_lines[4] == [2, 3] and got.score[2] == got.score[3]
    assert quality.score(odd, model).count() == 11
    assert quality.score_texts(["a"], quality.fit_texts([], {})).score[0] > 0.99
    assert quality.score_texts(["a"], quality.fit_texts([("a", 0)], {0: 1})).score[0] < 0.01


# --- 2


def ordered(rows):
    return sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def check_fingerprints(spark, df, rows):
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.edited_sha256, r.n_chars) for r in fingerprint.fingerprints(df).collect()))
    order = ordered(rows)
    want = []
    for i, (d, t) in enumerate(order):
        f = order[(i + 1) % len(order)][1]
        k = len(t) // 4
        want.append((d is not None, d or 0, hashlib.sha256((t[: len(t) - k] + f[:k]).encode()).hexdigest(), len(t)))
    assert got == sorted(want)


def test_fingerprints(spark, docs, plain, odd):
    check_fingerprints(spark, docs, [r[:2] for r in plain])
    check_fingerprints(spark, odd, [r[:2] for r in odd_docs()])
    check_fingerprints(spark, odd.where("doc_id = 6"), [r[:2] for r in odd_docs() if r[0] == 6])
    assert fingerprint.fingerprints(odd.where("false")).count() == 0
    out = fingerprint.fingerprints(docs).toPandas().merge(docs.toPandas(), on="doc_id")
    assert (out.groupby("text").fingerprint.nunique() == 1).all()
    assert out.near_edited.between(0, 1).all() and out.near_next.between(0, 1).all()
    assert out[out.n_chars_x > 400].near_edited.mean() > out[out.n_chars_x > 400].near_next.mean() + 0.2


def test_fingerprint_counts_by_hand():
    rng = random.Random(0)
    raw = [bytes(rng.randrange(256) for _ in range(n)) for n in (0, 1, 2, 3, 4, 50)]
    for r, row in zip(raw, fingerprint.counts(raw)):
        assert row.sum() == max(0, len(r) - 2) + 2 * max(0, len(r) - 3)
        assert (row == fingerprint.counts([r, b"zz"])[0]).all()


# --- 4


def test_encoder_is_the_vocabulary(plain):
    from tokenizers import Tokenizer

    slow, encode = Tokenizer.from_file(packing.tokenizer_path("byte_bpe_50k.json")), packing.encoder()
    rng = random.Random(3)
    texts = [t for _, t, _ in plain[:60]] + ["a<|endoftext|>b", "  \n\n x\t 　 y", "don't I'LL 12a½ ²", "𝒳́é\r\n\x00\x85"]
    texts += ["".join(chr(rng.choice([32, 32, 10, 39, 97, 233, 0x4E00, 0x1F600, 0x2028, 0x300, 48, 0x660, 33])) for _ in range(80)) for _ in range(200)]
    for t in texts:
        assert list(encode(t)) == slow.encode(t, add_special_tokens=False).ids, t


def check_packing(out, rows, capacity):
    encode = packing.encoder()
    want = Counter()
    for d, t in rows:
        ids = np.append(encode(t) if t else np.zeros(0, np.uint32), np.uint32(2)).astype("<u4")
        for k, (a, n) in enumerate(packing.cuts(len(ids), capacity)):
            want[(d, k, a, n, zlib.crc32(ids[a : a + n].tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    return len(by), sum(r.length for r in out)


def test_packing(spark, docs, plain, odd):
    n, total = check_packing(packing.pack(docs).collect(), [r[:2] for r in plain], 1024)
    assert n <= total / 1024 * 1.08 + 1
    check_packing(packing.pack(odd).collect(), [r[:2] for r in odd_docs()], 1024)
    small = frame(spark, [(i, "a b c d"[: 1 + i % 7], None, None, 0) for i in range(300)])
    n, total = check_packing(packing.pack(small, 16).collect(), [(i, "a b c d"[: 1 + i % 7]) for i in range(300)], 16)
    assert n <= total / 16 * 1.1 + 1
    assert packing.pack(odd.where("false")).count() == 0
    seq = packing.sequences(odd).collect()
    assert sum(len(r.ids) for r in seq) == sum(r.length for r in packing.pack(odd).collect()) and max(len(r.ids) for r in seq) <= 1024


def test_cuts():
    assert packing.cuts(1, 4) == [(0, 1)] and packing.cuts(8, 4) == [(0, 4), (4, 4)] and packing.cuts(9, 4) == [(0, 1), (1, 4), (5, 4)]


# --- 5


def check_warc(spark, rows):
    df = frame(spark, rows, "page_id long, url string, html string, extra string")
    archives = warc.write_archives(df, warc.make_folder(spark), roll=5000)
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(archives).collect())
    last = {}
    for p, _, h, _ in rows:
        if p is not None:
            last[h or ""] = max(p, last.get(h or "", p))
    want = Counter()
    for p, _, h, _ in rows:
        b = (h or "").encode()
        other = len(b) >= 1000 and (h or "") in last and last[h or ""] != p
        want[(p, len(b), hashlib.sha1(b).hexdigest(), "revisit" if other else "response", last[h] if other else None)] += 1
    assert got == want
    return archives


def test_warc(spark, sf):
    pages = [(*r, None) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    big, edge = "é" * 500, "x" * 999
    rows = pages + [(1000 + i, f"http://a b/\n{i}", big, "x") for i in range(20)] + [(2000, None, None, None), (2001, "u", "", "y"), (2002, "u", edge, "y"), (2003, "u", edge, "y"), (None, "u", big, "n"), (2004, "u", "z" * 3_000_000, "")]
    archives = check_warc(spark, rows)
    text = {r.page_id: bytes(r.payload).decode() for r in warc.read_archives(archives, keep=True).collect() if r.record_type == "response"}
    assert text[1019] == big and len(text[2004]) == 3_000_000
    assert warc.read_archives(warc.write_archives(frame(spark, [], "page_id long, url string, html string"), warc.make_folder(spark))).count() == 0


def test_warc_members_and_damage():
    data = warc.record(1, "http://a/", b"abc" * 1000) + warc.record(2, None, b"") + warc.record(3, "u", b"abc" * 1000, 1, True)
    assert gzip.decompress(data).count(b"WARC/1.1\r\n") == 3
    got = list(warc.read_records(io.BytesIO(data), keep=True))
    assert [r["page_id"] for r in got] == [1, 2, 3] and got[0]["payload"] == b"abc" * 1000 and got[2]["refers_to"] == 1

    class Slow(io.BytesIO):
        def read(self, n=-1):
            return super().read(7)

    assert [r["payload_digest"] for r in warc.read_records(Slow(data))] == [r["payload_digest"] for r in got]
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(data[:-9])))
    wrong = gzip.compress(gzip.decompress(warc.record(1, "u", b"abcd")).replace(b"abcd", b"abce"))
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(wrong)))


# --- 6


def shingle_set(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def brute_components(rows):
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    first = {}
    for i, s in enumerate(sets):
        if s:
            parent[find(i)] = find(first.setdefault(s, i))
    distinct = sorted(first.items(), key=lambda x: len(x[0]))
    for i, (s, a) in enumerate(distinct):
        for t, b in distinct[i + 1 :]:
            if 100 * len(s) < 80 * len(t):
                break
            common = len(s & t)
            if 100 * common >= 80 * (len(s) + len(t) - common):
                parent[find(a)] = find(b)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[find(i)] = min(d, ids.get(find(i), d))
    return Counter((d, len(s), ids.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def near_copies(seed=5):
    """Families around the threshold, chains, tiny texts and a common passage."""
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(4000)]
    common = " ".join(rng.choice(vocabulary) for _ in range(40))
    rows, n = [], 0
    for family in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([6, 12, 30, 60, 120, 300]))]
        for c in range(rng.choice([2, 5, 25])):
            w = list(base)
            for _ in range(rng.randrange(0, max(2, len(w) // 22))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            if rng.random() < 0.2:
                base = w
            rows.append((n, " ".join(w).upper() if rng.random() < 0.1 else " ".join(w)))
            n += 1
    for _ in range(40):
        rows.append((n, common + " " + " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 80)))))
        n += 1
    rows += [(n + i, common) for i in range(5)] + [(n + 10 + i, "a b") for i in range(3)] + [(n + 20, "a  B\n"), (n + 21, ""), (n + 22, None), (n + 22, "a b"), (None, common)]
    rng.shuffle(rows)
    return rows


def test_jaccard_join(spark, plain, odd):
    for rows in (near_copies(), near_copies(6), [r[:2] for r in plain], [r[:2] for r in odd_docs()]):
        df = frame(spark, rows, "doc_id long, text string")
        got = Counter(tuple(r) for r in jaccard_join.near_duplicates(df).select("doc_id", "n_shingles", "component_id").collect())
        assert got == brute_components(rows)
    assert jaccard_join.near_duplicates(odd.where("false")).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 140)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    got = {r.node: r.component for r in jaccard_join.components(frame(spark, edges, "a long, b long")).collect()}
    name = {}
    for _ in range(100):
        for a, b in edges:
            m = min(name.get(a, a), name.get(b, b))
            name[a] = name[b] = m
    assert got == {k: v for k, v in name.items() if any((a == k) != (b == k) for a, b in edges)}


# --- 7


def brute_leaks(rows, items, k=5, threshold=0.8):
    split = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    grams = lambda w: Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else Counter([tuple(w)])
    out = {}
    for d, t in rows:
        w = split(t)
        for i, text in items:
            x = split(text)
            if not x:
                continue
            g = grams(x)
            for s in range(len(w) - len(x) + 1):
                h = grams(w[s : s + len(x)])
                common = sum((g & h).values())
                sim = common / (sum(g.values()) + sum(h.values()) - common)
                if sim >= threshold and ((d, i) not in out or (-sim, s) < out[(d, i)]):
                    out[(d, i)] = (-sim, s)
    return {(d, i, round(-v, 6), s) for (d, i), (v, s) in out.items()}


def test_contaminated(spark, plain, odd):
    rng = random.Random(4)
    vocabulary = [f"v{i}" for i in range(500)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 20, 40, 60])))) for i in range(25)] + [(100, ""), (101, None), (None, "null item of six words here"), (3, "second text for item three with words")]
    rows = []
    for d in range(60):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 60))]
        if d % 2:
            x = items[rng.randrange(25)][1].split()
            for _ in range(rng.randrange(0, 3)):
                x[rng.randrange(len(x))] = rng.choice(vocabulary)
            if d % 5 == 0 and len(x) > 10:
                del x[5]
            at = rng.randrange(len(w) + 1)
            w[at:at] = x
        rows.append((d, (" ".join(w)).replace(" v1 ", " V1, ")))
    rows += [(d, t) for d, t, *_ in odd_docs() if len(t or "") < 1000] + [(None, "say null item of six words here")]
    b = frame(spark, items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, round(r.similarity, 6), r.start_word) for r in decontaminate.contaminated(frame(spark, rows, "doc_id long, text string"), b).collect()}
    assert got == brute_leaks(rows, items) and len(got) >= 15
    kept = decontaminate.decontaminate(frame(spark, rows, "doc_id long, text string").selectExpr("*", "1 as _leak", "2 as length"), b)
    assert kept.columns == ["doc_id", "text", "_leak", "length"]
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d, _ in rows if d not in {g[0] for g in got})
    assert decontaminate.contaminated(odd.where("false"), b).count() == 0
    assert decontaminate.contaminated(odd, b.where("false")).count() == 0


def test_contaminated_short_documents(spark):
    """Clipped copies: a document with fewer words than the item is one window."""
    rng = random.Random(7)
    items = [(i, " ".join(f"w{rng.randrange(2000)}" for _ in range(n))) for i, n in enumerate((4, 5, 8, 20, 30, 59, 59, 120))]
    items.append((8, " ".join(["the same five words here"] * 8)))
    rows = [(0, " ".join(items[5][1].split()[:55]))]
    for i, text in items:
        x = text.split()
        for n in sorted({len(x) - 1, len(x) - 2, len(x) * 9 // 10, len(x) * 8 // 10, len(x) // 2} - {0}):
            edited = list(x[:n])
            edited[n // 2] = "edited"
            rows += [(len(rows) + j, " ".join(w)) for j, w in enumerate((x[:n], x[-n:], x[len(x) - n - 1 :][:n], edited))]
    rows += [(len(rows), items[5][1]), (len(rows) + 1, "before " + rows[0][1] + " one two three four five")]
    grams = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)])
    want = brute_leaks(rows, items)
    for d, w in [(d, t.split()) for d, t in rows]:
        for i, text in items:
            g, h = grams(text.split()), grams(w)
            sim = (common := sum((g & h).values())) / (sum(g.values()) + sum(h.values()) - common)
            if len(w) < len(text.split()) and sim >= 0.8:
                want.add((d, i, round(sim, 6), 0))
    docs, b = frame(spark, rows, "doc_id long, text string"), frame(spark, items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, round(r.similarity, 6), r.start_word) for r in decontaminate.contaminated(docs, b).collect()}
    assert got == want and (0, 5, round(51 / 55, 6), 0) in got and len(want) > len(brute_leaks(rows, items)) + 10
    assert {r.doc_id for r in decontaminate.decontaminate(docs, b).collect()} == {d for d, _ in rows} - {g[0] for g in want}


def test_contamination_stays_native(spark, odd):
    plan = decontaminate.contaminated(odd, frame(spark, [(1, "one two")], "item_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


# --- 8


def check_chat(spark, rows):
    df = frame(spark, rows, "conv_id long, turn long, role string, text string, extra int")
    got = Counter(tuple(r) for r in chat.digest(chat.format_conversations(df)).collect())
    convs = {}
    for c, n, role, text, _ in rows:
        convs.setdefault(c, []).append((n is not None, n or 0, role or "", text or ""))
    want = Counter()
    lengths = {}
    for r in got:
        lengths[r[0]] = r[5]
    for c, turns in convs.items():
        turns.sort()
        said = "".join(t for *_, r, t in turns if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for *_, r, t in turns)
        want[(c, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest(), lengths[c])] += 1
    assert got == want


def test_chat(spark, sf):
    rows = [(*r, None) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    said = "<|im_end|><|im_start|>assistant ok"
    odd = [(-1, 0, "user", said, 1), (-1, 1, "assistant", said, 1), (-2, 0, None, None, 1), (-2, None, "assistant", "", 1), (-3, 1, "a\nb\\n<|", "<\\|<|<\\\\|é𝒳", 1), (None, 3, "assistant", "x", 1), (0, 99, "assistant", "y", 1), (-4, 1, "assistant", "t", 1), (-4, 1, "assistant", "t", 1), (-5, 0, "assistant", "long " * 200_000, 1)]
    check_chat(spark, rows + odd)
    assert chat.format_conversations(frame(spark, [], "conv_id long, turn long, role string, text string")).count() == 0


def test_chat_layout(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "ok é")]
    r = chat.format_conversations(frame(spark, rows, "conv_id long, turn long, role string, text string")).first()
    assert r.formatted == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nok é<|im_end|>\n"
    assert [r.formatted[s.start : s.start + s.length] for s in r.loss] == ["ok é"]


# --- 9


def brute_lines(rows, ratio, least):
    total, count = Counter(s for _, _, s in rows), Counter()
    for _, t, s in rows:
        for line in set((t or "").split("\n")) - {""}:
            count[(s, line)] += 1
    over = {k for k, n in count.items() if n >= least and n > ratio * total[k[0]]}
    return Counter((d, None if t is None else "\n".join(x for x in t.split("\n") if (s, x) not in over)) for d, t, s in rows)


def test_line_dedup(spark, plain, odd):
    mixed = [(i, "\n".join(random.Random(i).sample(["menu", "footer", f"own {i}", "", "rare", "menu"], 4)), ["a", None][i % 2]) for i in range(60)] + [(99, None, "a"), (98, "", None)]
    for rows, ratio, least in ((plain, 0.1, 5), (mixed, 0.3, 5), (mixed, 0.6, 2)):
        df = frame(spark, [(*r, 1, 2) for r in rows], "doc_id long, text string, source string, _keys int, _host int")
        out = line_dedup.dedup_lines(df, "source", "text", ratio, least)
        assert out.columns == df.columns + ["clean"]
        assert Counter((r.doc_id, r.clean.text) for r in out.collect()) == brute_lines(rows, ratio, least)
    assert line_dedup.dedup_lines(odd.where("false")).count() == 0 and line_dedup.dedup_lines(odd).count() == 11
