"""A training corpus from raw documents, in five stages over one table.

Toxic documents go, site boilerplate goes from the texts, one document of each
near-duplicate group stays, documents that hold benchmark items go, and the
rest is packed into sequences.  Each stage reads what the one before wrote.

Defined results: an empty table passes through every stage; null texts stay in
the corpus until packing counts them as empty; rows of null or repeated ids are
documents of their own, each judged by its own text; columns of their own pass
through all stages but the last."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loquat.llm import decontaminate, jaccard_join, line_dedup, packing, toxicity
from loquat.llm.queries import MIN_PAGES, RATIO
from loquat.llm.shared import addressed, discard, free, materialise, read_table

LIMIT = 1_000_000  # rows that may be broadcast


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.7."""
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    name = free(docs, "_toxicity")
    return toxicity.score(docs, model, output=name).where(F.col(name)["score"] < 0.7).drop(name)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; lines on over a tenth of a source's documents go from its texts."""
    name = free(docs, "_clean")
    out = line_dedup.dedup_lines(docs, "source", "text", RATIO, MIN_PAGES, name)
    text = F.col(name)["text"]
    columns = {"text": text, "n_chars": F.coalesce(F.length(text), F.lit(0)).cast("long")}
    return out.select([columns[c].alias(c) if c in columns else F.col(f"`{c}`") for c in docs.columns])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group one row: of those with the smallest id (a
    null id only where the group has no other) the first by file and place.
    Rows without words are no copies."""
    file, place = free(docs, "_file"), free(docs, "_place")
    rows = addressed(docs, file, place)
    found = jaccard_join.groups(rows.select("doc_id", "text", file, place), carry=(file, place))
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(file), F.col(place))).alias("first")
    kept = found.where("label IS NOT NULL").groupBy("label").agg(first).select(F.col(f"first.{file}").alias(file), F.col(f"first.{place}").alias(place))
    # rows meet by their own address, so a large group is no single task's work
    spare = found.where("label IS NOT NULL").join(kept, [file, place], "left_anti").select(file, place)
    spare = materialise(spare, "spare")
    discard(found)
    side = F.broadcast(spare) if spare.count() <= LIMIT else spare  # 16 bytes a row
    return rows.join(side, [file, place], "left_anti").drop(file, place)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no benchmark item; equal texts have one key."""
    given = free(docs, "_given")
    key = F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.lit("second"), "text").alias("b"))
    keyed = docs.select(*[key.alias(c) if c == "doc_id" else F.col(f"`{c}`") for c in docs.columns], F.col("doc_id").alias(given))
    kept = decontaminate.decontaminate(keyed, read_table(spark, sf_dir, "benchmark"))
    return kept.select([F.col(given).alias(c) if c == "doc_id" else F.col(f"`{c}`") for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their places in sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate),
    ("near_duplicates", drop_copies),
    ("decontamination", drop_leaks),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), name)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)


# A learned model decides the first stage, so SQL cannot give these rows.
ORACLE_SQL = None
