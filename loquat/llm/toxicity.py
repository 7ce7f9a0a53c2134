"""Toxic spans by a linear-chain conditional random field.

Labels come with documents, so tokens are labelled first: a token of a toxic
document is toxic if its word or one of its word beginnings occurs in far more
different words of toxic than of other training documents.  A two-state chain over the words
learns from these tokens and their neighbours; forward-backward marginals give
spans with offsets, and their aggregate gives the document's score.

Defined results: null or empty text has no token and gets the score of a
document without toxic tokens; with no labelled row of one of the two classes
every score is the other class's (0 or 1), without any label 0; repeated rows
are scored alike; other columns pass through, and an
`output` that is a column already is an error."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chain_crf, flat
from .shared import bound_batches, fresh, labelled_sample

BITS = 19
SIZE = 1 << BITS
OWN = 8  # feature columns of the token itself: word, 4 beginnings, 2 endings, shape
LEXICAL = (0, 2, 3, 4)  # word, beginnings of 4, 5 and 6 letters
SCHEMA = "score double, spans array<struct<start:int,end:int,probability:double>>"


@dataclass
class ToxicityModel:
    weights: np.ndarray
    trans: np.ndarray
    begin: np.ndarray
    calibration: np.ndarray
    threshold: float = 0.5


def tokens(texts: list):
    """Words of the texts: start, end (in the flat array), document, document
    offsets, and a (words, columns) array of hashed feature ids (0: none)."""
    raw, offsets = flat.points(texts)
    low = flat.lower_table()[raw]
    start, end = flat.runs(flat.word_table()[low])
    n = len(start)
    doc = np.searchsorted(offsets, start, "right") - 1
    ids = np.zeros((n, OWN + 3), np.int32)
    if not n:
        return start, end, doc, offsets, ids
    size = end - start
    r = flat.multipliers(256)
    mask = np.uint64(SIZE - 1)

    def put(column: int, h: np.ndarray, valid=None) -> None:
        x = (flat.mix(h + r[200 + column]) & mask).astype(np.int32)
        x[x == 0] = 1
        ids[:, column] = x if valid is None else np.where(valid, x, 0)

    letters = flat.word_table()[low]
    chars = low[letters].astype(np.uint64)
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    place = np.arange(len(chars)) - np.repeat(first, size)
    word = np.add.reduceat(chars * r[place & 63], first)
    put(0, word.copy())
    h = np.zeros(n, np.uint64)
    last = len(chars) - 1
    for i in range(6):
        h = h + chars[np.minimum(first + i, last)] * r[64 + i]
        if i >= 2:
            put(i - 1, h.copy(), size > i)
    h = np.zeros(n, np.uint64)
    for i in range(4):
        h = h + chars[np.maximum(first + size - 1 - i, 0)] * r[80 + i]
        if i >= 2:
            put(3 + i, h.copy(), size > i)
    upper = (raw[start] != low[start]).astype(np.uint64)
    put(7, upper * np.uint64(3) + np.minimum(size, 30).astype(np.uint64) * np.uint64(8))
    same = doc[1:] == doc[:-1]
    ids[1:, 8] = np.where(same, (ids[:-1, 0] * 31 + 17) & (SIZE - 1), 0)
    ids[:-1, 9] = np.where(same, (ids[1:, 0] * 31 + 101) & (SIZE - 1), 0)
    ids[1:, 10] = np.where(same, (ids[:-1, 2] * 31 + 211) & (SIZE - 1), 0)
    return start, end, doc, offsets, ids


def _chains(doc: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, np.int64)


def _summary(p: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Per document: the two highest marginals, log of 1 + the expected count,
    and of 1 + that in a hundred words.  One word may resemble a toxic one by
    chance, and a long text has more such words."""
    top, total = np.zeros((n, 2)), np.bincount(doc, weights=p, minlength=n)
    order = np.lexsort((p, doc))
    last = np.flatnonzero(np.append(doc[1:] != doc[:-1], True)) if len(doc) else np.zeros(0, np.int64)
    top[doc[last], 0] = p[order[last]]
    second = last[(last > 0) & (doc[last - 1] == doc[last])]
    top[doc[second], 1] = p[order[second - 1]]
    return np.column_stack([top, np.log1p(total), np.log1p(100 * total / (np.bincount(doc, minlength=n) + 10))])


def lexicon(texts: list, toxic: np.ndarray, ratio: float = 10.0, surprise: float = 14.0, most: int = 3) -> np.ndarray:
    """Feature ids that toxic documents use far more than others do.

    Counted are the different words of a document that have the feature, at
    most `most` of them.  Given the other documents' rate, the count in toxic
    ones has to be `ratio` times the expected one, with a Poisson tail under
    exp(-surprise) (one in a million, as there are so many features), in two
    toxic documents at least."""
    count, docs, total = np.zeros((2, SIZE)), np.zeros(SIZE), np.zeros(2)
    for a, b in flat.chunks(texts):
        _, _, doc, _, ids = tokens(texts[a:b])
        _, first = np.unique(doc * SIZE + ids[:, 0], return_index=True)
        for c in LEXICAL:
            seen, n = np.unique(ids[first, c].astype(np.int64) * (b - a) + doc[first], return_counts=True)
            feature, y = seen // (b - a), toxic[a:b][seen % (b - a)] > 0
            n = np.minimum(n, most)
            for k in (0, 1):
                count[k] += np.bincount(feature, weights=n * (y == k), minlength=SIZE)
            docs += np.bincount(feature, weights=y, minlength=SIZE)
        for k in (0, 1):
            total[k] += (toxic[a:b][doc[first]] == k).sum()
    bad = count[1]
    expected = (count[0] + 0.5) * max(total[1], 1) / max(total[0], 1)
    tail = bad * np.log(np.maximum(bad, 1e-9) / expected) - bad + expected
    keep = (docs >= 2) & (bad >= ratio * expected) & (tail >= surprise)
    keep[0] = False
    return keep


def distinct(texts: list, alike: int = 7) -> list:
    """Indices of the texts that are no near copies of an earlier one that is
    kept (`alike` of ten minima of hashed word triplets equal): copies of one
    toxic document would make its ordinary words look toxic."""
    out, seen = [], [{} for _ in range(10)]
    for a, b in flat.chunks(texts):
        _, _, doc, _, ids = tokens(texts[a:b])
        triple = (ids[:, 0].astype(np.uint64) << np.uint64(42)) ^ (ids[:, 8].astype(np.uint64) << np.uint64(21)) ^ ids[:, 9].astype(np.uint64)
        least = np.full((10, b - a), np.iinfo(np.uint64).max, np.uint64)
        for k, m in enumerate(flat.multipliers(10, 3)):
            np.minimum.at(least[k], doc, flat.mix((triple + np.uint64(k)) * m))
        for i in range(b - a):
            mine = [int(x) for x in least[:, i]]
            met = Counter(j for x, s in zip(mine, seen) for j in s.get(x, ()))
            if max(met.values(), default=0) < alike:
                out.append(a + i)
                for x, s in zip(mine, seen):
                    s.setdefault(x, []).append(a + i)
    return out


def fit_texts(rows: list, totals: dict, rounds: int = 40) -> ToxicityModel:
    """Fit on (text, label) rows; totals: labelled rows of each class.  The
    lexicon and the calibration use all rows, the chain all toxic documents
    and as many others."""
    rows = [rows[i] for i in distinct([t for t, _ in rows])]
    y = np.array([label for _, label in rows], float)
    texts = [t for t, _ in rows]
    none = np.zeros(4), np.zeros(2)
    if len(set(y)) < 2:
        return ToxicityModel(np.zeros(SIZE, np.float32), *none, np.array([30.0 if len(y) and y[0] else -30.0, 0, 0, 0, 0]))
    n_toxic = int(y.sum())
    keep = lexicon(texts, y)
    some = np.sort(np.concatenate([np.flatnonzero(y == 1), np.flatnonzero(y == 0)[:n_toxic]]))
    part = [texts[i] for i in some]
    parts = [(ids, doc + a) for a, b in flat.chunks(part) for _, _, doc, _, ids in [tokens(part[a:b])]]
    ids, doc = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    del parts
    if not len(doc):
        return ToxicityModel(np.zeros(SIZE, np.float32), *none, np.array([np.log(totals[1] / totals[0]), 0, 0, 0, 0]))
    labels = keep[ids[:, LEXICAL]].any(1) & (y[some][doc] == 1)
    theta, trans, begin = chain_crf.fit(ids, SIZE, labels, _chains(doc), rounds=rounds)
    model = ToxicityModel(theta.astype(np.float32), trans, begin, np.zeros(5))
    weight = np.where(y == 1, totals[1] / n_toxic, totals[0] / (len(y) - n_toxic))
    model.calibration = chain_crf.calibrate(summaries(texts, model), y, weight / weight.mean())
    return model


def summaries(texts: list, model: ToxicityModel) -> np.ndarray:
    out = [np.zeros((0, 4))]
    for a, b in flat.chunks(texts):
        _, _, doc, _, ids = tokens(texts[a:b])
        p = chain_crf.marginals(model.weights[ids].sum(1, dtype=np.float64), _chains(doc), model.trans, model.begin)
        out.append(_summary(p, doc, b - a))
    return np.concatenate(out)


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 3, held_out: int = 1, toxic: int = 1000, clean: int = 3000) -> ToxicityModel:
    """Fit on at most `toxic` and `clean` labelled documents of the classes 1
    and 0, without those whose crc bucket is `held_out`."""
    return fit_texts(*labelled_sample(docs, labels, "toxic", modulus, held_out, (clean, toxic)))


def score_texts(texts: list, model: ToxicityModel) -> pd.DataFrame:
    scores, spans = [], []
    for a, b in flat.chunks(texts):
        start, end, doc, offsets, ids = tokens(texts[a:b])
        p = chain_crf.marginals(model.weights[ids].sum(1, dtype=np.float64), _chains(doc), model.trans, model.begin)
        scores.append(chain_crf.logistic(_summary(p, doc, b - a), model.calibration))
        found = [[] for _ in range(b - a)]
        for i in np.flatnonzero(p >= model.threshold):
            d = doc[i]
            found[d].append({"start": int(start[i] - offsets[d]), "end": int(end[i] - offsets[d]), "probability": float(p[i])})
        spans += found
    return pd.DataFrame({"score": np.concatenate(scores) if scores else np.zeros(0), "spans": spans})


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", output: str = "toxicity") -> DataFrame:
    """Add `output`: struct of score (0 to 1) and toxic spans (code points)."""
    shared = bound_batches(docs.sparkSession).sparkContext.broadcast(model)  # 2 MB whatever the input

    @F.pandas_udf(SCHEMA)
    def tag(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in flat.released(batches):
            yield score_texts([t if isinstance(t, str) else "" for t in s], shared.value)

    return docs.withColumn(fresh(docs, output), tag(F.col(text)))
