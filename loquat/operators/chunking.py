"""Chunkers as folds and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STRIP = r"(?U)^\s+|\s+$"


def strip(s: Column) -> Column:
    return F.regexp_replace(s, STRIP, "")


def segments(s: Column, size: int) -> Column:
    """Paragraphs; longer ones by sentence; longer sentences by hard cuts."""
    full = lambda parts: F.filter(F.transform(parts, strip), lambda x: x != "")
    cut = lambda x: F.when(F.length(x) > size, F.transform(F.sequence(F.lit(0), F.floor((F.length(x) - 1) / size).cast("int")), lambda i: F.substring(x, i * size + 1, F.lit(size)))).otherwise(F.array(x))
    sentence = lambda x: F.flatten(F.transform(full(F.split(x, r"(?<=[.!?])\s+")), cut))
    return F.flatten(F.transform(full(F.split(s, r"\n\n+")), lambda p: F.when(F.length(p) > size, sentence(p)).otherwise(F.array(p))))


def pack(parts: Column, size: int, overlap: int) -> Column:
    """Greedy packing joined by spaces; a flushed chunk seeds the next with its tail."""
    def step(acc, x):
        over = (F.length(acc["cur"]) > 0) & (F.length(acc["cur"]) + 1 + F.length(x) > size)
        done = strip(acc["cur"])
        tail = F.when(F.length(done) > overlap, F.substring(done, F.length(done) - overlap + 1, F.lit(overlap))).otherwise(done)
        grown = F.when(F.length(acc["cur"]) > 0, F.concat(acc["cur"], F.lit(" "), x)).otherwise(x)
        return F.struct(
            F.when(over, F.concat(acc["out"], F.array(done))).otherwise(acc["out"]).alias("out"),
            F.when(over, F.concat(tail, F.lit(" "), x)).otherwise(grown).alias("cur"))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"))
    last = lambda acc: F.when(strip(acc["cur"]) != "", F.concat(acc["out"], F.array(strip(acc["cur"])))).otherwise(acc["out"])
    return F.aggregate(parts, start, step, last)


def chunk_text(docs: DataFrame, size: int = 800, overlap: int = 100) -> DataFrame:
    """docs (id, content) to (id, chunk_index, content)."""
    return docs.select("id", F.posexplode(pack(segments(F.col("content"), size), size, overlap)).alias("chunk_index", "content"))


def paragraphs(docs: DataFrame, least: int = 50) -> DataFrame:
    parts = F.filter(F.transform(F.split("content", "\n\n"), strip), lambda x: F.length(x) > least)
    return docs.select("id", F.posexplode(parts).alias("chunk_index", "content"))


def transcript(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) to (id, content): user turns quoted by `> `."""
    line = F.when(F.lower("role").isin("user", "human"), F.concat(F.lit("> "), "text")).otherwise(F.col("text"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"])
    return turns.where("text IS NOT NULL").groupBy(F.col("conv_id").alias("id")).agg(F.regexp_replace(F.array_join(ordered, "\n\n"), r"(?U)\s+$", "").alias("content"))


def exchanges(transcripts: DataFrame, answers: int = 8) -> DataFrame:
    """(id, chunk_index, content): a run of `> ` lines and the first non-blank
    lines that follow it; lines before the first quoted one are dropped."""
    lines = transcripts.select("id", F.posexplode(F.split("content", "\n")).alias("pos", "line"))
    lines = lines.withColumn("line", F.regexp_replace("line", r"\s+$", "")).where(F.trim("line") != "")
    w = Window.partitionBy("id").orderBy("pos")
    user = F.startswith("line", F.lit(">"))
    lines = lines.withColumn("user", user).withColumn("fresh", (F.col("user") & ~F.coalesce(F.lag("user").over(w), F.lit(False))).cast("int"))
    lines = lines.withColumn("turn", F.sum("fresh").over(w)).where("turn > 0")
    lines = lines.withColumn("rank", F.row_number().over(Window.partitionBy("id", "turn", "user").orderBy("pos"))).where(F.col("user") | (F.col("rank") <= answers))
    text = F.when(F.col("user"), F.regexp_replace("line", r"^>\s*", "")).otherwise(F.trim("line"))
    joined = lambda who, sep: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("user") == who, F.struct("pos", text.alias("t"))))), lambda x: x["t"]), sep)
    out = lines.groupBy("id", "turn").agg(joined(True, " ").alias("q"), joined(False, "\n").alias("a"))
    content = F.when(F.col("a") != "", F.concat(F.lit("> "), "q", F.lit("\n\n"), "a")).otherwise(F.concat(F.lit("> "), "q"))
    return out.select("id", (F.col("turn") - 1).cast("int").alias("chunk_index"), content.alias("content"))


def sessions(files: DataFrame, marker: str, negative: list[str], ahead: int = 6) -> DataFrame:
    """(id, session, line_no, line): slices from one session start to the next.
    A start holds `marker` and none of the next lines holds a negative marker."""
    lines = files.select("id", F.posexplode(F.split("content", "\n")).alias("line_no", "line"))
    w = Window.partitionBy("id").orderBy("line_no")
    bad = F.lit(False)
    for x in negative:
        bad = bad | F.contains(F.lower("line"), F.lit(x.lower()))
    start = F.contains(F.lower("line"), F.lit(marker.lower())) & ~F.coalesce(F.max(bad).over(w.rowsBetween(1, ahead)), F.lit(False))
    lines = lines.withColumn("start", start.cast("int")).withColumn("session", F.sum("start").over(w) - 1)
    return lines.where("session >= 0").select("id", F.col("session").cast("int").alias("session"), "line_no", "line")
