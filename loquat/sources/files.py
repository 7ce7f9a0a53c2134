"""Project files: listing, ignore rules, reading."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..operators import written


FEW = 100_000  # paths that may be broadcast
FILES = 2_000  # files that a task reads
BATCH, CHARS = 10_000, 16 << 20  # rows and characters of a batch of them
RULES = "folder string, number int, regex string, negated boolean"


def rule_regex(line: str) -> tuple[str, bool] | None:
    """(regex, negated) of an ignore rule; None for blanks and comments.  Folders
    are matched with a slash behind, so a rule that ends in one is for them alone."""
    line = line.strip()
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[1:].strip() if negated else line
    rooted = line.startswith("/")
    body = line.lstrip("/").rstrip("/")
    # `**` takes the slash after it along, so `**/x` holds at the root too
    wild = {"**": ".*", "**/": ".*", "*": "[^/]+", "?": "[^/]"}
    out = "".join(wild.get(p) or re.escape(p) for p in re.split(r"(\*\*/?|\*|\?)", body) if p)
    return f"(?i)^{'' if rooted else '(.*/)?'}{out}{'/' if line.endswith('/') and body else '(/.*)?'}$", negated


def rule_rows(found: DataFrame) -> DataFrame:
    """The rules of ignore files (path, content) as rows: the folder they hold
    under ("" the root), their number, regex, and whether they take back."""
    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = [(path.rpartition("/")[0], n, *rule) for path, content in zip(frame["path"], frame["content"]) for n, line in enumerate((content or "").splitlines()) if (rule := rule_regex(line))]
            yield pd.DataFrame(made, columns=["folder", "number", "regex", "negated"])

    return found.select("path", "content").mapInPandas(rows, RULES)


def _above(parts: Column, last: Column) -> Column:
    """Paths of the first 0 to `last` parts."""
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def ignored(entries: DataFrame, rules: DataFrame) -> DataFrame:
    """The entries (entry; a folder's ends in a slash) that rules hide: of the
    rules of all folders above, outer ones first, the last that matches
    decides.  Entries meet the rules of each folder above them by its path."""
    bare = F.split(F.rtrim("entry", F.lit("/")), "/")
    met = entries.select("entry", F.posexplode(_above(bare, F.size(bare) - 1)).alias("depth", "folder")).join(rules, "folder").where(F.regexp_like("entry", F.col("regex")))
    last = met.groupBy("entry").agg(F.max_by("negated", F.struct("depth", "number")).alias("negated"))
    return last.where("NOT negated").select("entry")


def scan(files: DataFrame, rules: list[str] | dict[str, list[str]] | DataFrame | None = None, include: list[str] = ()) -> DataFrame:
    """files (path) that a project scan takes.  A folder that is ignored or
    skipped is not entered.  `rules` are the root's, or those of several folders
    by their path ("" the root), or rows as `rule_rows` makes them, of any
    number: a folder's rules hold for what lies under it, after those of the
    folders above, and match paths from the root.

    `include` overrides, at any depth and in any case.  A name without a slash
    takes files of that name, and folders of that name with all they hold.  A
    path takes that file; folders named as its first part are entered, but of
    what they hold only files named by `include` are taken."""
    if rules is None or isinstance(rules, (list, dict)):
        lines = rules if isinstance(rules, dict) else {"": rules or []}
        made = [(folder, n, *rule) for folder, own in lines.items() for n, line in enumerate(own) if (rule := rule_regex(line))]
        rules = files.sparkSession.createDataFrame(made, RULES) if made else None
    names = [x.replace("\\", "/").strip("/").lower() for x in include]
    whole, through = [x for x in names if "/" not in x], [x.partition("/")[0] for x in names if "/" in x]
    path = F.col("path")
    parts = F.split(path, "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    named = lambda c, held: F.lower(c).isin(held) if held else F.lit(False)
    if rules is not None:
        each = F.transform(F.filter(_above(parts, F.size(parts) - 1), lambda p: p != ""), lambda p: F.concat(p, F.lit("/")))
        entries = files.select(F.explode(F.concat(each, F.array(path))).alias("entry")).distinct()  # a folder is judged once
        hidden = ignored(entries, rules)
        met = files.select("path", F.explode(F.concat(each, F.array(path))).alias("entry")).distinct().join(hidden, "entry").groupBy("path").agg(F.collect_set("entry").alias("_hidden"))
        met = written.written(met, "hidden")
        files = files.join(F.broadcast(met) if met.count() <= FEW else met, "path", "left")  # few, or contents travel too
    else:
        files = files.withColumn("_hidden", F.lit(None).cast("array<string>"))
    hides = lambda entry: F.coalesce(F.array_contains("_hidden", entry), F.lit(False))
    in_whole = F.exists(folders, lambda n: named(n, whole))
    places = F.filter(F.sequence(F.lit(0), F.size(folders)), lambda i: i > 0)

    def closed(i: Column) -> Column:
        name = F.get(folders, i - 1)
        opened = F.exists(F.slice(folders, 1, i), lambda n: named(n, whole)) | named(name, through)
        return ~opened & (name.isin(C.SKIP_DIRS) | hides(F.concat(F.array_join(F.slice(folders, 1, i), "/"), F.lit("/"))))

    forced = in_whole | named(path, names) | named(F.element_at(parts, -1), names)
    extension = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    usual = ~F.exists(folders, lambda n: named(n, through)) & ~hides(path) & extension.isin(C.ALLOW_EXTENSIONS) & ~extension.isin(C.DENY_EXTENSIONS)
    return files.where(~F.exists(places, closed) & (forced | usual)).drop("_hidden")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of the text files under a folder; blank files are left out."""
    raw = spark.read.option("recursiveFileLookup", True).text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    return raw.where(F.col("content").rlike(r"\S"))


def relative(files: DataFrame, folder: str) -> DataFrame:
    """Paths from the folder on; both may or may not name the file system."""
    bare = F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:/+", "/"), "%20", " ")
    root = re.sub("^[a-z0-9]+:/+", "/", folder).rstrip("/") + "/"
    return files.withColumn("path", F.substring(bare, len(root) + 1, 1 << 30))


def target(folder: str) -> str:
    return folder if "://" in folder else "file://" + os.path.abspath(folder)


def _entries(system: fs.FileSystem, path: str) -> Iterator[tuple[str, bool]]:
    """(name, is it a folder) of a folder's entries; on a local disk one by one, however many there are."""
    if isinstance(system, fs.LocalFileSystem):
        with os.scandir(path) as found:
            for x in found:
                if x.is_dir() or x.is_file():
                    yield x.name, x.is_dir()
    else:
        for x in system.get_file_info(fs.FileSelector(path)):
            yield x.base_name, x.type == fs.FileType.Directory


def listing(spark: SparkSession, folder: str, endings: tuple[str, ...]) -> DataFrame:
    """(path) of all files under a folder, from the folder on.  Of those with a
    name or folder that begins with `_` or `.` only the ones that end as wanted,
    and none in folders that a scan skips.  Folders are listed in tasks, level by
    level; the driver holds the names of one level's folders."""
    at = target(folder)

    def listed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, top = fs.FileSystem.from_uri(at)
        rows = []
        frame = lambda: pd.DataFrame(rows, columns=["path", "folder"])
        for below in (x for f in frames for x in f["path"]):
            for name, is_folder in _entries(system, f"{top}/{below}".rstrip("/")):
                path = f"{below}/{name}".lstrip("/")
                parts = path.split("/")
                hidden = any(p[0] in "_." for p in parts)
                skipped = hidden and any(p in C.SKIP_DIRS for p in (parts if is_folder else parts[:-1]))
                if not skipped and (is_folder or not hidden or path.endswith(endings)):
                    rows.append((path, is_folder))
                if len(rows) == BATCH:
                    yield frame()
                    rows = []
        yield frame()

    level, found = [""], spark.createDataFrame([], "path string")
    while level:  # each level is listed once, and written
        here = spark.createDataFrame([(p,) for p in level], "path string").repartition(min(len(level), 64)).mapInPandas(listed, "path string, folder boolean")
        here = written.written(here, "listed")
        found = found.unionByName(here.where("NOT folder").select("path"))
        level = [r["path"] for r in here.where("folder").select("path").collect()]
    return found


def contents(paths: DataFrame, folder: str, number: int | None = None) -> DataFrame:
    """(path, content) of files by their paths from the folder on; blank files
    are left out.  Each file is read once, in tasks of some FILES files."""
    at = target(folder)
    number = paths.count() if number is None else number

    def read_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = fs.FileSystem.from_uri(at)
        names, texts, held = [], [], 0
        frame = lambda: pa.record_batch([pa.array(names, pa.string()), pa.array(texts, pa.string())], ["path", "content"])
        for path in (x for b in batches for x in b.column("path").to_pylist()):
            with system.open_input_stream(f"{top}/{path}") as f:
                names.append(path)
                texts.append(f.read().decode("utf-8", "replace"))
            held += len(texts[-1])
            if held >= CHARS or len(names) == BATCH:
                yield frame()
                names, texts, held = [], [], 0
        yield frame()

    tasks = max(min(number, paths.sparkSession.sparkContext.defaultParallelism), -(-number // FILES), 1)
    return paths.select("path").repartition(tasks, "path").mapInArrow(read_, "path string, content string").where(F.col("content").rlike(r"\S"))


def names(spark: SparkSession, folder: str, include: list[str] = (), respect_ignore: bool = True) -> DataFrame:
    """(path) of the files that a project scan takes, with the ignore files found in it; of files only those are opened."""
    found = listing(spark, folder, (*C.ALLOW_EXTENSIONS, ".gitignore"))
    ignores = found.where(F.substring_index("path", "/", -1) == ".gitignore")
    number = ignores.count() if respect_ignore else 0
    return scan(found, rule_rows(contents(ignores, folder, number)) if number else None, include)


def project(spark: SparkSession, folder: str, include: list[str] = (), respect_ignore: bool = True) -> DataFrame:
    """(path, content) of the files that a project scan takes."""
    return contents(names(spark, folder, include, respect_ignore), folder)


def conversations(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of the files that may hold chats."""
    extension = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return relative(read(spark, folder), folder).where(extension.isin(C.CONVERSATION_EXTENSIONS))


def prose(spark: SparkSession, folder: str, n: int = 10) -> DataFrame:
    """The first n prose files, those nearest to the root first."""
    extension = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    depth = F.size(F.split("path", "/"))
    return relative(read(spark, folder), folder).where(extension.isin(C.PROSE_EXTENSIONS)).orderBy(depth, "path").limit(n)
