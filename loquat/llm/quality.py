"""Document quality by a linear-chain conditional random field over lines.

Every line is labelled good or bad from its own features (shares of character
classes, repetition, word shapes) and those of the lines before and after it.
Forward-backward marginals, weighted by line length, aggregate into a score.
Training lines start with their document's label; lines of bad documents that
the first fit finds good are relabelled before the second.

Defined results: null or empty text has one empty line of no weight; with no
labelled row of one class every score is the other class's, without any label
1; repeated rows are scored alike; other columns pass through, and an
`output` that is a column already is an error."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chain_crf, flat
from .shared import bound_batches, fresh, labelled_sample

PUNCTUATION = [c for c in range(33, 127) if not chr(c).isalnum()]
CLASSES = 9 + len(PUNCTUATION)
EDGES = np.array([0.0, 0.002, 0.01, 0.03, 0.08, 0.2, 0.5])
WORDS = 7  # word features after the character classes
BINS = 8
NEAR = tuple(range(CLASSES, CLASSES + WORDS)) + (1, 3)
COLUMNS = CLASSES + WORDS + 2 * len(NEAR)
SIZE = COLUMNS * BINS + 1


@dataclass
class QualityModel:
    weights: np.ndarray
    trans: np.ndarray
    begin: np.ndarray
    calibration: np.ndarray


@lru_cache(maxsize=None)
def class_table() -> np.ndarray:
    out = np.full(flat.POINTS, 7, np.uint8)
    for i in range(flat.POINTS):
        c = chr(i)
        if i < 128:
            out[i] = 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 if c in " \t" else 4 if c.isspace() else 8
        elif c.isalpha():
            out[i] = 6 if c.isupper() else 5
        elif c.isspace():
            out[i] = 4
    out[PUNCTUATION] = np.arange(9, CLASSES)
    return out


def lines(texts: list):
    """Feature ids of all lines: (lines, COLUMNS); each line's document and length."""
    raw, offsets = flat.points(texts)
    ends = np.flatnonzero(raw == 10)
    n = len(ends)
    starts = np.concatenate([[0], ends[:-1] + 1]) if n else ends
    doc = np.searchsorted(offsets, starts, "right") - 1
    size = ends - starts
    kind = class_table()[raw]
    line = np.repeat(np.arange(n), size + 1)
    count = np.bincount(line * CLASSES + kind, minlength=n * CLASSES).reshape(n, CLASSES).astype(float)
    count[:, 4] -= 1  # the line feed itself
    own = np.zeros((n, CLASSES + WORDS))
    own[:, :CLASSES] = count / np.maximum(size, 1)[:, None]
    a, b = flat.runs((kind != 3) & (kind != 4))
    if len(a):
        of, length = line[a], b - a
        inside = (kind != 3) & (kind != 4)
        first = np.concatenate([[0], np.cumsum(length)[:-1]])
        place = np.arange(int(length.sum())) - np.repeat(first, length)
        h = np.add.reduceat(raw[inside].astype(np.uint64) * flat.multipliers(64)[place & 63], first)
        again = np.zeros(len(a))
        again[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
        head, tail = kind[a], kind[b - 1]
        symbols = np.zeros(CLASSES, bool)
        symbols[9:] = True
        for c in ".,;:?'\")":
            symbols[9 + PUNCTUATION.index(ord(c))] = False
        per = np.maximum(np.bincount(of, minlength=n), 1)
        for k, v in enumerate((
            again,
            symbols[tail],
            symbols[head] & symbols[tail],
            (head == 1) | (head == 6),
            ((head == 1) | (head == 6)) & ((kind[np.minimum(a + 1, b - 1)] == 1) | (kind[np.minimum(a + 1, b - 1)] == 6)) & (length > 1),
            np.minimum(length, 50) / 50.0,
        )):
            own[:, CLASSES + k] = np.bincount(of, weights=v, minlength=n) / per
        own[:, CLASSES + 6] = np.minimum(np.bincount(of, minlength=n), 400) / 800.0
    bins = np.searchsorted(EDGES, own, "left").astype(np.int32)
    ids = np.zeros((n, COLUMNS), np.int32)
    ids[:, : CLASSES + WORDS] = bins + 1 + np.arange(CLASSES + WORDS) * BINS
    near = list(NEAR)
    if n > 1:
        same = (doc[1:] == doc[:-1])[:, None]
        at = CLASSES + WORDS
        base = 1 + np.arange(at, at + len(near)) * BINS
        ids[1:, at : at + len(near)] = np.where(same, bins[:-1, near] + base, 0)
        at += len(near)
        base = 1 + np.arange(at, at + len(near)) * BINS
        ids[:-1, at:] = np.where(same, bins[1:, near] + base, 0)
    return ids, doc, size


def _chains(doc: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, np.int64)


def _summary(p: np.ndarray, doc: np.ndarray, size: np.ndarray, n: int) -> np.ndarray:
    """Length-weighted mean of the bad marginals, and the highest one that
    covers at least 50 characters."""
    w = np.bincount(doc, weights=size, minlength=n)
    mean = np.bincount(doc, weights=p * size, minlength=n) / np.maximum(w, 1)
    top = np.zeros(n)
    np.maximum.at(top, doc, p * np.minimum(size / 50.0, 1))
    return np.column_stack([mean, top])


def fit_texts(rows: list, totals: dict, rounds: int = 60) -> QualityModel:
    y = np.array([label for _, label in rows], float)
    if len(set(y)) < 2:
        return QualityModel(np.zeros(SIZE), np.zeros(4), np.zeros(2), np.array([-30.0 if len(y) and not y[0] else 30.0, 0, 0]))
    parts = []
    texts = [t for t, _ in rows]
    for a, b in flat.chunks(texts):
        ids, doc, size = lines(texts[a:b])
        parts.append((ids, doc + a, size))
    ids, doc, size = (np.concatenate([p[i] for p in parts]) for i in range(3))
    starts = _chains(doc)
    bad = y[doc] == 0
    labels = bad.copy()
    for step in range(2):
        theta, trans, begin = chain_crf.fit(ids, SIZE, labels, starts, rounds=rounds)
        p = chain_crf.marginals(theta[ids].sum(1), starts, trans, begin)
        if step == 0:
            top = np.zeros(len(y))
            np.maximum.at(top, doc, p)
            labels = bad & ((p >= 0.3) | (p >= top[doc]))
    weight = np.where(y == 1, totals[1] / y.sum(), totals[0] / (1 - y).sum())
    weight /= weight.mean()
    return QualityModel(theta, trans, begin, chain_crf.calibrate(_summary(p, doc, size, len(y)), y, weight))


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 5, held_out: int = 0, per_class: int = 2000) -> QualityModel:
    """Fit on at most `per_class` labelled documents of each class, without
    those whose crc bucket is `held_out`."""
    return fit_texts(*labelled_sample(docs, labels, "quality", modulus, held_out, (per_class, per_class)))


def score_texts(texts: list, model: QualityModel) -> pd.DataFrame:
    scores, found = [], []
    for a, b in flat.chunks(texts):
        ids, doc, size = lines(texts[a:b])
        p = chain_crf.marginals(model.weights[ids].sum(1), _chains(doc), model.trans, model.begin)
        scores.append(chain_crf.logistic(_summary(p, doc, size, b - a), model.calibration))
        cut = np.searchsorted(doc, np.arange(b - a + 1))
        found += [(np.flatnonzero(p[cut[i]:cut[i + 1]] >= 0.5)).tolist() for i in range(b - a)]
    return pd.DataFrame({"score": np.concatenate(scores) if scores else np.zeros(0), "bad_lines": found})


def score(docs: DataFrame, model: QualityModel, text: str = "text", output: str = "quality") -> DataFrame:
    """Add `output`: struct of score (higher: good likelier) and the numbers of bad lines."""
    shared = bound_batches(docs.sparkSession).sparkContext.broadcast(model)  # a few KB

    @F.pandas_udf("score double, bad_lines array<int>")
    def rate(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in flat.released(batches):
            yield score_texts([t if isinstance(t, str) else "" for t in s], shared.value)

    return docs.withColumn(fresh(docs, output), rate(F.col(text)))
