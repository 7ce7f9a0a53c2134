"""Long transcripts of many sessions to one file a session."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.text import timestamp_date
from . import written
from .chunking import sessions

DATE = r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}|\d{1,2}/\d{1,2}/\d{4}"


def slug(subject: Column, most: int = 20) -> Column:
    s = F.regexp_replace(F.replace(F.lower(subject), F.lit(" "), F.lit("-")), r"[^a-z0-9\s-]", "")
    s = F.regexp_replace(F.regexp_replace(s, "-{2,}", "-"), "^-+|-+$", "")
    s = F.regexp_replace(F.substring(s, 1, most), "-+$", "")
    return F.when(s == "", "session").otherwise(s)


def file_name(stem: Column, date: Column, people: Column, subject: Column) -> Column:
    who = F.array_join(F.slice(people, 1, 2), "-")
    return F.concat(stem, F.lit("__"), F.coalesce(date, F.lit("unknown")), F.lit("_"), F.when(who == "", "general").otherwise(who), F.lit("_"), slug(subject), F.lit(".txt"))


def split(files: DataFrame, least: int = 2, marker: str = C.SESSION_MARKER, negatives: list[str] = C.SESSION_NEGATIVES) -> DataFrame:
    """files (id, content), id a file's stem, to one row a session: (id, session,
    date, people, subject, file_name, content).  Files of fewer than `least`
    sessions are left alone.

    The date comes from the first ten lines, people from the first twenty, the
    subject is the first line but the opening one, among those twenty, of over
    three characters that is no heading."""
    lines = sessions(files, marker, negatives).withColumn("n", F.row_number().over(Window.partitionBy("id", "session").orderBy("line_no")) - 1)
    line = F.trim("line")
    dated = F.regexp_extract("line", DATE, 0)
    row = F.struct("n", F.col("line"), F.when((F.col("n") < 10) & (dated != ""), dated).alias("date"), F.when((F.col("n").between(1, 19)) & (F.length(line) > 3) & ~F.startswith(line, F.lit("#")), F.substring(line, 1, 30)).alias("subject"))
    one = lines.groupBy("id", "session").agg(F.array_sort(F.collect_list(row)).alias("r"))
    first = lambda name: F.get(F.filter(F.transform("r", lambda x: x[name]), lambda v: v.isNotNull()), F.lit(0))
    head = F.array_join(F.transform(F.slice("r", 1, 20), lambda x: x["line"]), "\n")
    people = F.array_distinct(F.filter(F.regexp_extract_all(head, F.lit(r"\b[A-Z][a-z]{2,}\b"), F.lit(0)), lambda w: ~w.isin(C.NOT_SPEAKERS)))
    out = one.select("id", "session", timestamp_date(first("date")).alias("date"), people.alias("people"), F.coalesce(first("subject"), F.lit("session")).alias("subject"), F.array_join(F.transform("r", lambda x: x["line"]), "\n").alias("content"))
    out = out.withColumn("_of", F.count("*").over(Window.partitionBy("id"))).where(F.col("_of") >= least).drop("_of")
    return out.withColumn("file_name", file_name(F.col("id"), F.col("date"), F.col("people"), F.col("subject")))


def write(rows: DataFrame, folder: str) -> DataFrame:
    """Write each session to `folder`/`file_name`, in tasks, so the folder has to
    be one that all executors see; returns (file_name, bytes).  Sessions of one
    name get their number before the ending, so none is lost, and a task that
    runs again writes the same files."""
    again = F.row_number().over(Window.partitionBy("file_name").orderBy("id", "session"))
    name = F.when(again > 1, F.concat(F.expr("substring(file_name, 1, length(file_name) - 4)"), F.lit("_"), again, F.lit(".txt"))).otherwise(F.col("file_name"))
    target = folder if "://" in folder else "file://" + os.path.abspath(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = fs.FileSystem.from_uri(target)
        system.create_dir(top)
        for batch in batches:
            sizes = []
            for i in range(batch.num_rows):
                data = batch.column("content")[i].as_py().encode()
                with system.open_output_stream(f"{top}/{batch.column('name')[i].as_py()}") as out:
                    out.write(data)
                sizes.append(len(data))
            yield pa.record_batch([batch.column("name"), pa.array(sizes, pa.int64())], ["file_name", "bytes"])

    return written.written(rows.select(name.alias("name"), "content").mapInArrow(run, "file_name string, bytes long"), "files")
