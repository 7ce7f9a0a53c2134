"""Rule-based extractors: memories, entities, summaries."""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as T
from .chunking import strip


def cues(pattern: str) -> list[str]:
    """Words one of which every match of a marker holds: the choices of its
    first group, else its longest literal."""
    group = re.search(r"\(([^()]*)\)", pattern)
    return group[1].split("|") if group else [max(re.split(r"\\b|\.\*", pattern), key=len)]


def marker_scores(s: Column, low: Column) -> dict[str, Column]:
    """Per family n / (n + 2), n the matches of its patterns in `s`; `low` is
    `s` in lower case, where a pattern's cues are looked for first, as that is
    much cheaper than the pattern."""
    out = {}
    for family, patterns in C.MEMORY_MARKERS.items():
        n = sum((F.when(T.hits(low, cues(p)) > 0, F.regexp_count(s, F.lit("(?i)" + p))).otherwise(0) for p in patterns), F.lit(0))
        out[family] = n / (n + 2.0)
    return out


def memories(segments: DataFrame, least: float = 0.3) -> DataFrame:
    """segments (id, chunk_index, content) to those that a marker family claims."""
    scores = marker_scores(F.col("content"), F.col("_low"))
    # exploding keeps the lower-cased text a column; inlined, each cue would lower it again
    rows = segments.select("id", "chunk_index", "content", F.explode(F.array(F.lower("content"))).alias("_low"))
    if least > 0:
        words = {w for patterns in C.MEMORY_MARKERS.values() for p in patterns for w in cues(p)}
        rows = rows.where(functools.reduce(lambda a, b: a | b, [F.contains("_low", F.lit(w)) for w in sorted(words)]))
    rows = rows.select("id", "chunk_index", "content", *[v.alias(f"_{k}") for k, v in scores.items()])
    top = F.greatest(*[F.col(f"_{k}") for k in scores])
    kind = T.best({k: F.col(f"_{k}") for k in scores}, None)
    return rows.select("id", "chunk_index", "content", kind.alias("memory_type"), top.alias("confidence")).where(F.col("confidence") >= least)


def is_code_line(line: Column) -> Column:
    indented = line.rlike(r"^[ \t]") & line.rlike(r"[=(){};]|//|#")
    sparse = (F.length(line) > 10) & (F.length(F.regexp_replace(line, r"\P{L}+", "")) / F.length(line) < 0.4)
    return indented | sparse | line.rlike(r"(?U)^\s*(" + "|".join(C.CODE_WORDS) + r") ")


def prose(s: Column) -> Column:
    """Text without code lines; a run of blank lines counts as one."""
    kept = F.transform(F.filter(F.split(s, "\n"), lambda x: ~is_code_line(x)), lambda x: F.when(x.rlike(r"\S"), x).otherwise(F.lit("")))
    return strip(F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n"))


def memory_parts(s: Column, size: int = 500) -> Column:
    """Paragraphs; longer ones as runs of sentences of at most `size` characters."""
    def add(acc, x):
        over = (F.length(acc["cur"]) > 0) & (F.length(acc["cur"]) + F.length(x) + 2 > size)
        joined = F.when(F.length(acc["cur"]) > 0, F.concat(acc["cur"], F.lit(". "), x)).otherwise(x)
        return F.struct(F.when(over, F.concat(acc["out"], F.array(strip(acc["cur"])))).otherwise(acc["out"]).alias("out"), F.when(over, x).otherwise(joined).alias("cur"))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"))
    runs = lambda p: F.aggregate(F.filter(F.split(p, r"\. "), lambda x: x != ""), start, add, lambda a: F.concat(a["out"], F.array(strip(a["cur"]))))
    parts = F.filter(F.transform(F.split(s, r"\r?\n\r?\n"), strip), lambda x: x != "")
    return F.flatten(F.transform(parts, lambda p: F.when(F.length(p) > size, runs(p)).otherwise(F.array(p))))


def memory_segments(docs: DataFrame) -> DataFrame:
    """docs (id, content) to (id, chunk_index, content): the distinct prose segments, first seen first."""
    return docs.select("id", F.posexplode(F.array_distinct(F.filter(memory_parts(prose(F.col("content"))), lambda x: x != ""))).alias("chunk_index", "content"))


def extract_memories(docs: DataFrame, least: float = 0.3) -> DataFrame:
    return memories(memory_segments(docs), least)


def candidates(docs: DataFrame, least: int = 3) -> DataFrame:
    """(id, name, count): title-case runs, and single words outside such runs."""
    found = lambda p: F.regexp_extract_all("content", F.lit(rf"[A-Z](?<=\b[A-Z]){p}"), F.lit(0))
    single = F.filter(found(r"[a-z]{1,19}\b"), lambda w: ~w.isin(C.NOT_ENTITIES))
    # nothing is given back, so a run of any length needs no stack
    # a text's runs and words are told apart in its own row; exploding keeps an array a column
    rows = docs.select("id", F.explode(F.array(F.struct(found(r"[a-z]++(?:\s++[A-Z][a-z]++\b)++").alias("runs"), single.alias("single")))).alias("x"))
    parts = F.array_distinct(F.flatten(F.transform("x.runs", lambda r: F.split(r, r"\s+"))))
    rows = rows.select("id", "x", F.explode(F.array(parts)).alias("parts"))
    names = F.concat("x.runs", F.filter("x.single", lambda w: F.col("id").isNull() | ~F.array_contains("parts", w)))
    return rows.select("id", F.explode(names).alias("name")).groupBy("id", "name").agg(F.count("*").alias("count")).where(F.col("count") >= least)


def lookup(words: DataFrame, people: DataFrame, projects: DataFrame, ambiguous: DataFrame, indicators: list[str]) -> DataFrame:
    """words (word, context): person, project, common word or unknown, with confidence."""
    w = words.withColumn("_k", F.lower("word"))
    p = people.select(F.lower("name").alias("_k"), F.col("confidence").alias("_p"))
    j = projects.select(F.lower("name").alias("_k"), F.lit(True).alias("_j"))
    a = ambiguous.select(F.lower("name").alias("_k"), F.lit(True).alias("_a"))
    said = T.hits(F.lower("context"), indicators) > 0
    x = w.join(p, "_k", "left").join(j, "_k", "left").join(a, "_k", "left")
    kind = F.when(F.col("_p").isNotNull(), "person").when(F.col("_j"), "project").when(F.col("_a") & said, "person").when(F.col("_a"), "common").otherwise("unknown")
    sure = F.when(F.col("_p").isNotNull(), F.col("_p")).when(F.col("_j"), 0.9).when(F.col("_a") & said, 0.6).when(F.col("_a"), 0.8).otherwise(0.0)
    return x.withColumn("entity_type", kind).withColumn("confidence", sure).drop("_k", "_p", "_j", "_a")


def _most_points(n: int):
    @F.pandas_udf("string")
    def run(words: pd.Series, lowered: pd.Series) -> pd.Series:
        letters, out = {}, []
        for text, low in zip(words, lowered):
            keys = low.split("\n") if text else []
            points = Counter(keys)
            for word, key in zip(text.split("\n"), keys) if text != low else ():
                if word != key and (letters.get(word[0]) or letters.setdefault(word[0], unicodedata.category(word[0]))) == "Lu":
                    points[key] += 2
            for key in C.TOPIC_STOP:
                points.pop(key, None)
            out.append("+".join(sorted(points, key=points.get, reverse=True)[:n]))  # stable: first seen first
        return pd.Series(out, dtype=object)

    return run


def summary_topics(docs: DataFrame, n: int = 3, kept: list[str] = ()) -> DataFrame:
    """(id, topics): words over three letters, one point each and two more for
    each capitalised occurrence; the best n, first seen first on ties.  A
    document's words are counted in its own row, so nothing is shuffled."""
    # a dotted capital I is one letter in lower case too
    words = F.array_join(F.regexp_extract_all(F.translate("content", "İ", "I"), F.lit(r"[\p{L}\p{Mn}\p{Nd}\p{Pc}]{4,}"), F.lit(0)), "\n")
    rows = docs.select("id", *kept, F.explode(F.array(words)).alias("_w"))  # exploding keeps the words a column
    return rows.select("id", *kept, _most_points(n)("_w", F.lower("_w")).alias("topics"))


def _text_codes(tables: dict[str, tuple[dict[str, list[str]], dict[str, str]]]):
    """`text.codes` of lower-cased texts by several tables."""
    @F.pandas_udf(", ".join(f"{k} string" for k in tables))
    def run(lowered: pd.Series) -> pd.DataFrame:
        found = lambda low, table, names: "+".join(names.get(k, k) for k, v in table.items() if any(w in low for w in v))
        return pd.DataFrame({k: [found(low or "", *x) for low in lowered] for k, x in tables.items()}, dtype=object)

    return run


def trimmed(s: Column) -> Column:
    """Without blanks of any kind at both ends; tabs and line ends are none."""
    return F.regexp_replace(s, r"^\p{Zs}+|\p{Zs}+\z", "")


def key_sentence(s: Column, most: int = 55) -> Column:
    parts = F.filter(F.transform(F.split(s, r"(?<=[.!?])\s+"), trimmed), lambda x: x != "")
    ranked = F.transform(parts, lambda x, i: F.struct(T.hits(F.lower(x), C.DECISION_PHRASES).alias("n"), (-i).alias("i"), x.alias("x")))
    top = F.array_max(ranked)["x"]
    return F.coalesce(F.when(F.length(top) > most, F.concat(F.substring(top, 1, most), F.lit("…"))).otherwise(top), F.lit(""))


def compress(docs: DataFrame, metadata: tuple[str, ...] = ()) -> DataFrame:
    """(id, summary): topics|key sentence|emotions|flags, after a line
    `# name: value` for each of the columns `metadata` that is not null."""
    head = F.concat_ws("", *[F.concat(F.lit(f"# {c}: "), F.col(c).cast("string"), F.lit("\n")) for c in metadata])
    codes = _text_codes({"e": (C.EMOTIONS, C.EMOTION_CODES), "f": (C.FLAGS, {})})(F.lower("content"))
    parts = {"h": head, "k": key_sentence(F.col("content")), "c": codes}
    both = summary_topics(docs.select("*", *[x.alias(f"_{k}") for k, x in parts.items()]), kept=[f"_{k}" for k in parts])
    return both.select("id", F.concat("_h", F.concat_ws("|", F.coalesce("topics", F.lit("")), "_k", "_c.e", "_c.f")).alias("summary"))


def decode(s: Column) -> Column:
    """Fields of a summary: comment lines before it go, emotion codes become
    names; codes that are unknown stay.  A line of the key sentence is no comment."""
    body = F.regexp_replace(s, r"\A(?:\s*#[^\n]*(?:\n|\z))++", "")
    parts = F.transform(F.split(body, r"\|", 4), trimmed)
    name = F.create_map(*[F.lit(x) for k, v in C.EMOTION_CODES.items() for x in (v, k)])
    part = lambda i: F.coalesce(F.get(parts, F.lit(i)), F.lit(""))
    codes = F.filter(F.transform(F.split(part(2), r"\+"), trimmed), lambda c: c != "")
    feelings = F.transform(codes, lambda c: F.coalesce(F.try_element_at(name, F.lower(c)), c))
    return F.struct(part(0).alias("topics"), part(1).alias("sentence"), feelings.alias("emotions"), part(3).alias("flags"))


def spec() -> str:
    """The summary's format in words."""
    lines = ["# Summary format", "", "topics|key sentence|emotion codes|flags; lines that begin with # are comments", "", "Emotion codes:"]
    lines += [f"  {k} = {v}" for k, v in sorted(C.EMOTION_CODES.items())]
    lines += ["", "Flags and their words:"] + [f"  {k}: {', '.join(v)}" for k, v in sorted(C.FLAGS.items())]
    return "\n".join([*lines, "", "Topics: the three words with the most points, a capitalised one counts three.", "Key sentence: the one with the most decision phrases, cut at 55 characters.", "Tokens: a third of the characters."])


def compression_stats(original: Column, compressed: Column) -> Column:
    """Sizes of both texts; the ratio is the compressed one's share of the original, 0 for an empty one, null for none."""
    ratio = F.when(F.length(original) == 0, F.lit(0.0)).otherwise(F.try_divide(F.length(compressed).cast("double"), F.length(original)))
    return F.struct(F.length(original).alias("original_chars"), F.length(compressed).alias("compressed_chars"), T.count_tokens(original).alias("original_tokens"), T.count_tokens(compressed).alias("compressed_tokens"), ratio.alias("ratio"))


def encode_entity(name: Column, names: dict[str, str]) -> Column:
    """Code of a name, case folded; null if it has none."""
    known = [x for k, v in names.items() for x in (F.lit(k.lower()), F.lit(v))]
    return F.try_element_at(F.create_map(*known), F.lower(name)) if known else F.lit(None).cast("string")


def substitute(s: Column, names: dict[str, str], skip: tuple[str, ...] = ()) -> Column:
    """Text with whole-word names replaced by their codes, longer names first,
    case folded; names of `skip` stay."""
    left_out = {x.lower() for x in skip}
    for name in sorted(names, key=len, reverse=True):
        if name.lower() not in left_out:
            s = F.regexp_replace(s, r"(?i)\b" + re.escape(name) + r"\b", names[name].replace("\\", r"\\").replace("$", r"\$"))
    return s


def save_codes(path: str, names: dict[str, str], skip: tuple[str, ...] = ()) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"entities": names, "skip": list(skip)}, f, ensure_ascii=False, indent=2)


def load_codes(path: str) -> tuple[dict[str, str], tuple[str, ...]]:
    """Codes and names to skip of a file that `save_codes` wrote; without it, or
    if it is damaged, none."""
    try:
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        return dict(held.get("entities") or {}), tuple(x for x in held.get("skip") or () if isinstance(x, str))
    except (FileNotFoundError, ValueError, AttributeError, TypeError):
        return {}, ()
