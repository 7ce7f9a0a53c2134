"""Chat exports of any known shape to one transcript text each.

JSON nests to any depth here, so parsing runs in Arrow batches of Python; a
document is parsed alone and nothing is collected."""

from __future__ import annotations

import json
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Turns = list[tuple[str, str]]


def text_of(v) -> str:
    """Text of a content value: strings, lists of them, objects with text or content."""
    if isinstance(v, str):
        return v
    if isinstance(v, list):
        return " ".join(t for t in map(text_of, v) if t.strip())
    if isinstance(v, dict):
        return plain(v["text"]) if "text" in v else text_of(v.get("content"))
    return ""


def plain(v) -> str:
    return v if isinstance(v, str) else ""


def objects(v) -> Iterable[dict]:
    return (x for x in v if isinstance(x, dict)) if isinstance(v, list) else ()


def kept(turns: Iterable[tuple[str, str]]) -> Turns:
    return [(r, t) for r, t in turns if r and t.strip()]


def log_turns(lines: Iterable[str]) -> Turns:
    """One JSON object a line with a type; lines that fail to parse are skipped."""
    out = []
    for line in lines:
        try:
            x = json.loads(line)
        except ValueError:
            continue
        if isinstance(x, dict) and x.get("type") in ("human", "user", "assistant"):
            field = next((k for k in ("content", "message", "text") if k in x), None)
            out.append(("assistant" if x["type"] == "assistant" else "user", text_of(x.get(field))))
    return kept(out)


def message_turns(v) -> Turns:
    """[{role, content}], {messages: [...]}, {chat_messages: [{sender, text}]}."""
    if isinstance(v, dict):
        v = v.get("messages", v.get("chat_messages"))
    return kept((plain(x.get("role", x.get("sender"))), text_of(x.get("content", x.get("text")))) for x in objects(v) if "role" in x or "sender" in x)


def tree_turns(v) -> Turns:
    """Conversations as trees of nodes: from the first node without a parent
    along first children; a node met again ends the walk."""
    out = []
    for conversation in objects(v if isinstance(v, list) else [v]):
        nodes = conversation.get("mapping")
        nodes = {k: n for k, n in nodes.items() if isinstance(n, dict)} if isinstance(nodes, dict) else {}
        here = next((k for k, n in nodes.items() if not n.get("parent")), None)
        while here in nodes:
            node = nodes.pop(here)
            message = node.get("message") if isinstance(node.get("message"), dict) else {}
            author, content = message.get("author"), message.get("content")
            role = plain(author.get("role")) if isinstance(author, dict) else ""
            parts = content.get("parts") if isinstance(content, dict) else None
            text = "".join(map(text_of, parts)).strip() if isinstance(parts, list) else text_of(content)
            if role != "system":
                out.append((role, text))
            children = node.get("children")
            here = children[0] if isinstance(children, list) and children and isinstance(children[0], str) else None
    return kept(out)


def channel_turns(v) -> Turns:
    """[{user, text}]: the first user seen is the user, all others assistants."""
    rows = kept((plain(x.get("user")), plain(x.get("text"))) for x in objects(v))
    return [("user" if who == rows[0][0] else "assistant", text) for who, text in rows]


def render(turns: Turns) -> str:
    return "\n\n".join(("> " if role in ("user", "human") else "") + text.strip() for role, text in turns)


def is_json_lines(lines: list[str]) -> bool:
    def parses(line: str) -> bool:
        try:
            json.loads(line)
        except ValueError:
            return False
        return True

    return len(lines) >= 2 and all(map(parses, lines[:5]))


def normalize(content: str | None, path: str | None = None) -> str | None:
    """Transcript of one export; a transcript or unknown text stays as it is, null stays null."""
    if content is None:
        return None
    rows = content.split("\n")
    if sum(x.lstrip().startswith(">") for x in rows) >= 3:
        return content
    lines = [x for x in (r.strip() for r in rows) if x]
    if (path or "").lower().endswith(".jsonl") or is_json_lines(lines):
        turns = log_turns(lines)
        if turns:
            return render(turns)
    try:
        v = json.loads(content)
    except (ValueError, RecursionError):
        return content
    return next((render(t) for t in (f(v) for f in (message_turns, tree_turns, channel_turns)) if t), content)


def _batch(content: pd.Series, path: pd.Series) -> pd.Series:
    return pd.Series([normalize(c, p) for c, p in zip(content, path)], dtype=object)


def transcript(content: Column, path: Column) -> Column:
    return F.pandas_udf(_batch, "string")(content, path)


def transcripts(files: DataFrame) -> DataFrame:
    """files (path, content) with content as a transcript; further columns stay."""
    return files.withColumn("content", transcript(F.col("content"), F.col("path")))
