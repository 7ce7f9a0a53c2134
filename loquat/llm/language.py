"""Language proportions of each document by expectation-maximisation.

Letter trigrams (with word bounds) give each word a likelihood in each learned
language; a document is a mixture whose proportions are fitted by
expectation-maximisation over its words.  Of the nested sets of its most likely
languages, the one with the best penalised likelihood (BIC) is kept.

Defined results: null text or a text without letters is `und` with score 0 and
no proportions; without training rows every text is `und`; equal proportions go
to the language that sorts first; other columns pass through, and an
`output` that is a column already is an error."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import flat
from .shared import bound_batches, crc_bucket, fresh

BITS = 17
SIZE = 1 << BITS
BOUNDS = [-(2**63) + 2 ** (64 - 2 * j) - 1 for j in range(16, 0, -1)]  # shares 4^-16 to 1/4 of all 64-bit hashes
SCHEMA = "lang string, score double, proportions map<string,double>"


@dataclass
class LanguageModel:
    langs: list
    table: np.ndarray  # (languages, SIZE) log-probabilities of hashed trigrams


def trigrams(texts: list):
    """Hashed trigrams of all words: ids, first trigram of each word, document of each word."""
    raw, offsets = flat.points(texts)
    low = flat.lower_table()[raw]
    letter = flat.letter_table()[low]
    start, end = flat.runs(letter)
    if not len(start):
        return np.zeros(0, np.int64), start, start, len(texts)
    c = np.where(letter, low, 0).astype(np.uint64)
    padded = np.concatenate([np.zeros(1, np.uint64), c, np.zeros(1, np.uint64)])
    h = padded[:-2] * np.uint64(0x9E3779B97F4A7C15) + padded[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + padded[2:] * np.uint64(0x165667B19E3779F9)
    ids = (flat.mix(h[letter]) >> np.uint64(64 - BITS)).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(end - start)[:-1]])
    return ids, first, np.searchsorted(offsets, start, "right") - 1, len(texts)


def fit_texts(rows: list, smoothing: float = 0.05) -> LanguageModel:
    """Fit on (text, language) rows."""
    langs = sorted({lang for _, lang in rows})
    table = np.full((len(langs), SIZE), smoothing)
    for k, lang in enumerate(langs):
        texts = [t for t, x in rows if x == lang]
        for a, b in flat.chunks(texts):
            table[k] += np.bincount(trigrams(texts[a:b])[0], minlength=SIZE)
    return LanguageModel(langs, np.log(table / table.sum(1, keepdims=True)).astype(np.float32))


def fit(docs: DataFrame, modulus: int = 4, held_out: int = 2, per_language: int = 500, longest: int = 200_000) -> LanguageModel:
    """Fit on the `per_language` documents of each language with the smallest
    hash of doc_id, without those whose crc bucket is `held_out` and those of
    more than `longest` characters."""
    docs = docs.where(F.length("text") <= longest)
    known = docs.select("doc_id", "lang", F.xxhash64("doc_id").alias("_hash")).where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (crc_bucket("doc_id", modulus) != held_out))
    # rows of each language under nested bounds of the hash: the least bound that leaves enough of them
    # keeps the smallest hashes, so a language of any size sends few rows to the task that ranks them
    counts = known.groupBy("lang").agg(F.count("*").alias("n"), *[F.count_if(F.col("_hash") <= h).alias(f"n{j}") for j, h in enumerate(BOUNDS)]).collect()
    bounds = {r["lang"]: next((h for j, h in enumerate(BOUNDS) if r[f"n{j}"] >= per_language), 2**63 - 1) for r in counts}
    side = docs.sparkSession.createDataFrame(list(bounds.items()), "_lang string, _bound long")
    near = known.join(F.broadcast(side), (F.col("lang") == F.col("_lang")) & (F.col("_hash") <= F.col("_bound")))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("_hash", "doc_id"))
    picked = near.withColumn("_place", place).where(F.col("_place") <= per_language).select("doc_id", "lang").distinct()
    rows = docs.select("doc_id", "lang", "text").join(F.broadcast(picked), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.max("text").alias("text")).collect()
    return fit_texts(sorted((r["text"], r["lang"]) for r in rows))


def _sums(x: np.ndarray, cut: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, cut, axis=-1)


def _mixture(like: np.ndarray, top: np.ndarray, of: np.ndarray, cut: np.ndarray, prior: np.ndarray, tolerance: float):
    """EM over words. like: (languages, words), scaled so that the best is 1;
    prior: (languages, documents), 0 for languages outside the set.  Every
    document has its rounds until no proportion moves by `tolerance`."""
    pi = prior / prior.sum(0)
    n = np.diff(np.append(cut, len(of)))
    live, x, o, c = np.arange(len(cut)), like, of, cut
    while len(live):
        now = pi[:, live]
        for _ in range(3):
            before = now
            joint = x * now[:, o]
            joint /= joint.sum(0)
            now = _sums(joint, c) / n[live]
        pi[:, live] = now
        moving = np.abs(now - before).max(0) >= tolerance
        if not moving.all():
            live = live[moving]
            x = x[:, moving[o]]
            o = np.repeat(np.arange(len(live)), n[live])
            c = np.concatenate([[0], np.cumsum(n[live])[:-1]])
    total = np.log((like * pi[:, of]).sum(0)) + top
    return pi, _sums(total, cut)


def infer(texts: list, model: LanguageModel, tolerance: float = 1e-3) -> pd.DataFrame:
    n_lang = len(model.langs)
    langs, scores, shares = [], [], []
    for a, b in flat.chunks(texts):
        ids, first, doc, n = trigrams(texts[a:b])
        lang, score, share = ["und"] * n, [0.0] * n, [{} for _ in range(n)]
        if len(doc) and n_lang:
            like = np.stack([np.add.reduceat(model.table[k][ids], first, dtype=np.float64) for k in range(n_lang)])
            top = like.max(0)
            like = np.exp(np.maximum(like - top, -60.0))
            cut = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
            of = np.repeat(np.arange(len(cut)), np.diff(np.append(cut, len(doc))))
            words = np.diff(np.append(cut, len(doc)))
            best_pi, _ = _mixture(like, top, of, cut, np.ones((n_lang, len(cut))), tolerance)
            rank = np.argsort(np.argsort(-best_pi, axis=0, kind="stable"), axis=0, kind="stable")
            best, pick = np.full(len(cut), -np.inf), np.zeros_like(best_pi)
            for k in range(1, n_lang + 1):
                if k == 1:
                    pi = (rank == 0).astype(float)
                    fit_ = _sums(np.log((like * pi[:, of]).sum(0)) + top, cut)
                else:
                    pi, fit_ = _mixture(like, top, of, cut, np.where(rank < k, best_pi + 1e-3, 0.0), tolerance)
                value = fit_ - 0.5 * (k - 1) * np.log(words + 1.0)
                better = value > best + 1e-9
                best = np.where(better, value, best)
                pick[:, better] = pi[:, better]
            for i, d in enumerate(doc[cut]):
                k = int(np.argmax(pick[:, i]))
                lang[d], score[d] = model.langs[k], float(min(1.0, pick[k, i]))
                share[d] = {model.langs[j]: float(pick[j, i]) for j in range(n_lang) if pick[j, i] > 0}
        langs += lang
        scores += score
        shares += share
    return pd.DataFrame({"lang": langs, "score": scores, "proportions": shares})


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", output: str = "language") -> DataFrame:
    """Add `output`: struct of the main language, its proportion and all proportions."""
    shared = bound_batches(docs.sparkSession).sparkContext.broadcast(model)  # 0.5 MB a language

    @F.pandas_udf(SCHEMA)
    def mixture(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in flat.released(batches):
            yield infer([t if isinstance(t, str) else "" for t in s], shared.value)

    return docs.withColumn(fresh(docs, output), mixture(F.col(text)))
