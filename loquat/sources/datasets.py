"""Evaluation data sets to one form: corpus and questions.

corpus: (item_id, id, content, role); questions: (query_id, item_id, category,
query, answer, targets, evidence).  A file is one JSON value and may nest in
several shapes, so it is parsed whole, one file a row, in Arrow batches."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .transcripts import objects, plain

ITEM = "item_id string, category string, ids array<string>, texts array<string>, roles array<string>, questions array<struct<query:string,answer:string,targets:array<string>,evidence:array<string>>>"


def numbers(v) -> list[int]:
    return [x for x in v if isinstance(x, int) and not isinstance(x, bool)] if isinstance(v, list) else []


def first(x: dict, *names: str) -> str:
    return next((x[n] for n in names if isinstance(x.get(n), str)), "")


def strings(v, name: str | None = None) -> list[str]:
    values = (plain(x.get(name)) for x in objects(v)) if name else map(plain, v if isinstance(v, list) else [])
    return [s for s in values if s]


def turn_items(v, stem: str) -> Iterator[dict]:
    """{topic: [{tid, message_list, QA}]}; messages flat or in sessions, numbered through."""
    number = 0
    for topic, items in (v.items() if isinstance(v, dict) else ()):
        for x in objects(items):
            messages, qa = x.get("message_list"), x.get("QA")
            if not messages or not isinstance(messages, list) or not isinstance(qa, dict) or not qa:
                continue
            number += 1
            key = f"{stem}_{topic}_{number}"
            turns = list(objects(messages)) if isinstance(messages[0], dict) else [t for s in messages for t in objects(s)]
            texts = [(f"[{t['time']}] " if t.get("time") else "") + f"[User] {first(t, 'user', 'user_message')} [Assistant] {first(t, 'assistant', 'assistant_message')}" for t in turns]
            steps = qa.get("target_step_id")
            targets = [f"{key}_g{s[0]}" for s in (steps if isinstance(steps, list) else []) if isinstance(s, list) and s]
            yield {"item_id": key, "category": stem, "ids": [f"{key}_g{i}" for i in range(len(texts))], "texts": texts, "roles": ["turn"] * len(texts), "questions": [(plain(qa.get("question")), plain(qa.get("ground_truth")), targets, [])]}


def message_items(v, stem: str) -> Iterator[dict]:
    """{id, question or query, messages or conversation, evidence_messages or evidence}, alone or in a list."""
    for i, x in enumerate(objects(v if isinstance(v, list) else [v])):
        question = first(x, "question", "query")
        texts = strings(x["messages"]) if isinstance(x.get("messages"), list) else strings(x.get("conversation"), "content")
        proof = strings(x["evidence_messages"]) if isinstance(x.get("evidence_messages"), list) else strings(x.get("evidence"), "content")
        if question and texts:
            key = f"{stem}_{x.get('id', i)}"
            yield {"item_id": key, "category": stem, "ids": [f"{key}_{j}" for j in range(len(texts))], "texts": texts, "roles": ["message"] * len(texts), "questions": [(question, "", [], proof)]}


def dialogue_items(v, stem: str) -> Iterator[dict]:
    """{session: {dialogue, qa}} or a list of them.  An utterance's id is its
    place among all utterances, empty ones included, as evidence ids count."""
    entries = v.items() if isinstance(v, dict) else ((f"session_{i}", x) for i, x in enumerate(v if isinstance(v, list) else []))
    for key, x in entries:
        if not isinstance(x, dict):
            continue
        turns = [(i, plain(t.get("speaker")), first(t, "text", "utterance", "content")) for i, t in enumerate(objects(x.get("dialogue")))]
        turns = [(i, f"[{who}] {text}".strip()) for i, who, text in turns if text]
        asked = [q for q in objects(x.get("qa")) if plain(q.get("question"))]
        if turns and asked:
            questions = [(q["question"], next(iter(strings(q.get("answers"))), plain(q.get("answer"))), [f"{key}_{n}" for n in numbers(q.get("evidence_utterance_ids"))], []) for q in asked]
            yield {"item_id": key, "category": stem, "ids": [f"{key}_{i}" for i, _ in turns], "texts": [t for _, t in turns], "roles": ["turn"] * len(turns), "questions": questions}


def long_items(v, stem: str) -> Iterator[dict]:
    """[{session: [{role, content}], question, answer or answers, evidence_session_ids}];
    without evidence ids, the answer's text is the evidence."""
    for i, x in enumerate(objects(v)):
        turns = [(first(t, "role") or "user", plain(t.get("content"))) for t in objects(x.get("session"))]
        turns = [(r, t) for r, t in turns if t.strip()]
        question, answer = plain(x.get("question")), plain(x.get("answer")) or next(iter(strings(x.get("answers"))), "")
        if question and turns:
            key = f"{stem}_{i}"
            targets = [f"{key}_{n}" for n in numbers(x.get("evidence_session_ids"))]
            yield {"item_id": key, "category": stem, "ids": [f"{key}_{j}" for j in range(len(turns))], "texts": [f"[{r}] {t}" for r, t in turns], "roles": [r for r, _ in turns], "questions": [(question, answer, targets, [] if targets else [answer])]}


SHAPES: dict[str, Callable[..., Iterator[dict]]] = {"turns": turn_items, "messages": message_items, "dialogue": dialogue_items, "long": long_items}


def items(files: DataFrame, shape: str) -> DataFrame:
    """files (path, content) to items; a file that fails to parse gives none."""
    parse = SHAPES[shape]

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                try:
                    v = json.loads(content or "")
                except ValueError:
                    continue
                rows = list(parse(v, path.rsplit("/", 1)[-1].rsplit(".", 1)[0]))
                for i in range(0, len(rows), 100):
                    yield pd.DataFrame(rows[i : i + 100])

    return files.select("path", "content").mapInPandas(batches, ITEM)


def read(spark: SparkSession, folder: str, shape: str) -> tuple[DataFrame, DataFrame]:
    raw = spark.read.option("recursiveFileLookup", True).text(folder, wholetext=True)
    return split(items(raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content")), shape))


def split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    corpus = rows.select("item_id", F.explode(F.arrays_zip("ids", "texts", "roles")).alias("x")).select("item_id", F.col("x.ids").alias("id"), F.col("x.texts").alias("content"), F.col("x.roles").alias("role"))
    asked = rows.select("item_id", "category", F.posexplode("questions").alias("n", "q"))
    return corpus, asked.select(F.concat_ws("#", "item_id", "n").alias("query_id"), "item_id", "category", "q.query", "q.answer", "q.targets", "q.evidence")
