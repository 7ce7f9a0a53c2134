"""Embeddings by a pluggable model, and views of the stored vectors.

A model is a function from a list of texts to a numpy array of unit vectors,
made once a Python worker by a factory.  Without one, `hashing` serves: signed
hashed words and trigrams, no files and no network."""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm, snippet, title

SIZE = 384
Model = Callable[[list[str]], np.ndarray]


WORDS, LONG = 200_000, 40  # words whose parts a worker keeps, and their longest


def hashing(size: int = SIZE) -> Model:
    held: dict[str, np.ndarray] = {}

    def parts(word: str) -> np.ndarray:
        """Twice the places of a word and its trigrams, plus one where they count
        down; hashed once, as words come again."""
        hashes = [zlib.crc32(p.encode("utf-8", "surrogatepass")) for p in (word, *(f"#{word}#"[i : i + 3] for i in range(len(word))))]
        got = np.array([h % size * 2 + 1 - (h >> 31) for h in hashes])
        if len(word) <= LONG:
            if len(held) >= WORDS:
                held.clear()
            held[word] = got
        return got

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), size), np.float32)
        for row, text in zip(out, texts):
            found = [held[w] if w in held else parts(w) for w in text.lower().split()]
            if found:
                counts = np.bincount(np.concatenate(found), minlength=2 * size).reshape(size, 2)
                row[:] = counts[:, 0] - counts[:, 1]
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(length == 0, 1, length)

    return embed


def embedding(text: Column, factory: Callable[[], Model] = hashing) -> Column:
    """Unit vector of a text; null and blank texts give zeros."""
    def batches(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for texts in columns:
            yield pd.Series(list(model([t or "" for t in texts])), index=texts.index, dtype=object)

    batches.__annotations__ = {"columns": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(batches, "array<float>")(text)


def attempted(text: Column, factory: Callable[[], Model] = hashing) -> Column:
    """Struct of the vector and the error of a text, one of them null.  A batch
    that fails is tried again text by text, so that one text costs no other."""
    def batches(columns: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = factory()

        def one(t: str) -> tuple:
            try:
                return model([t])[0], None
            except Exception as e:  # noqa: BLE001  whatever a model raises belongs to the text
                return None, f"{type(e).__name__}: {e}"

        for texts in columns:
            held = [t or "" for t in texts]
            try:
                rows = [(v, None) for v in model(held)]
            except Exception:  # noqa: BLE001
                rows = [one(t) for t in held]
            yield pd.DataFrame({"embedding": pd.Series([r[0] for r in rows], index=texts.index, dtype=object), "error": pd.Series([r[1] for r in rows], index=texts.index, dtype=object)})

    batches.__annotations__ = {"columns": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(batches, "embedding array<float>, error string")(text)


def backlog(chunks: DataFrame, vectors: DataFrame, factory: Callable[[], Model] = hashing) -> DataFrame:
    """(chunk_id, embedding, error) of the chunks that have no vector yet; those
    that failed have none, so a later run takes them up again."""
    todo = chunks.join(vectors.select(F.col("chunk_id").alias("id")), "id", "left_anti")
    return todo.select(F.col("id").alias("chunk_id"), attempted(F.col("content"), factory).alias("x")).select("chunk_id", "x.*")


def listing(chunks: DataFrame, vectors: DataFrame, dims: int = 8, n: int = 20) -> DataFrame:
    """The first n vectors by domain, topic and file: short id, norm, first values, how many more."""
    meta = chunks.select(F.col("id").alias("chunk_id"), "domain", "topic", "source_file", title(F.col("source_file")).alias("title"), snippet(F.col("content"), 120).alias("snippet"))
    rows = vectors.join(meta, "chunk_id").orderBy("domain", "topic", "source_file", "chunk_id").limit(n)
    return rows.select(F.substring("chunk_id", 1, 8).alias("id"), "domain", "topic", "title", "snippet", norm(F.col("embedding")).alias("norm"), F.slice("embedding", 1, dims).alias("head"), F.greatest(F.size("embedding") - dims, F.lit(0)).alias("more"))


def pooled(vectors: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Unit means of the token vectors (texts, tokens, size) that a mask (texts,
    tokens) keeps; a text without any gives zeros."""
    kept = mask.astype(np.float32)[:, :, None]
    mean = (vectors * kept).sum(1) / np.maximum(kept.sum(1), 1e-9)
    length = np.linalg.norm(mean, axis=1, keepdims=True)
    return (mean / np.where(length == 0, 1, length)).astype(np.float32)


def infer(texts: list[str], encode: Callable, session, longest: int = 512) -> np.ndarray:
    """Vectors of a sentence model: its `sentence_embedding` if it gives one,
    else the pooled token vectors.  `encode` gives a text's token ids."""
    ids = [encode(t)[:longest] if t.strip() else [] for t in texts]
    width = max(map(len, ids), default=0) or 1
    grid, mask = np.zeros((len(texts), width), np.int64), np.zeros((len(texts), width), np.int64)
    for i, row in enumerate(ids):
        grid[i, : len(row)], mask[i, : len(row)] = row, 1
    given = {"input_ids": grid, "attention_mask": mask, "token_type_ids": np.zeros_like(grid)}
    names = [o.name for o in session.get_outputs()]
    found = session.run(None, {i.name: given[i.name] for i in session.get_inputs()})
    out = np.asarray(found[names.index("sentence_embedding")], np.float32) if "sentence_embedding" in names else pooled(np.asarray(found[0]), mask)
    out[mask.sum(1) == 0] = 0
    return out


def sentence_model(folder: str, longest: int = 512) -> Callable[[], Model] | None:
    """Factory of the model in `folder` (model.onnx and vocab.txt, which all
    workers see); None where a file is missing, so that search does without."""
    model, vocabulary = f"{folder}/model.onnx", f"{folder}/vocab.txt"
    if not (os.path.exists(model) and os.path.exists(vocabulary)):
        return None

    def make() -> Model:
        import onnxruntime
        from tokenizers import BertWordPieceTokenizer

        words = BertWordPieceTokenizer(vocabulary, lowercase=True)
        session = onnxruntime.InferenceSession(model)
        return lambda texts: infer(texts, lambda t: words.encode(t).ids, session, longest)

    return make
