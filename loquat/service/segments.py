"""Tables as immutable segments under one manifest.

A write makes a folder of Parquet files, a segment, and then a new version of
the manifest that lists it: a small JSON file that is created only where no
file of that name exists.  What is not listed does not exist, so a write or a
merge that was cut short leaves the tables as they were.  One version may add
to several tables and replace segments of others, all at once; who comes second
reads the manifest again and tries once more, or gives up where a segment that
it replaces is gone.

Segments have levels.  `fan` segments of one level become one of the next, so
n writes leave at most fan - 1 segments a level and log(n) levels, and a row is
rewritten once a level.  Replaced segments stay for `grace` seconds, for frames
that still read them."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.written import filesystem, remove

DICTIONARY = 64 << 20  # bytes of a column's distinct values; long ids that repeat stay numbers in a file
FILE_BYTES = 256 << 20  # of a merged segment's files
BASE = 1000  # the level of snapshots, which are never merged by level


class Conflict(Exception):
    """Another writer has replaced what this one wanted to replace."""


class Segments:
    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, str], fan: int = 8, grace: float = 3600):
        self.spark, self.root, self.schemas, self.fan, self.grace = spark, root.rstrip("/"), schemas, fan, grace

    # manifest

    def _versions(self) -> list[int]:
        fs, at = filesystem(self.spark, f"{self.root}/manifest")
        if not fs.exists(at):
            return []
        return sorted((int(s.getPath().getName()[:-5]) for s in fs.listStatus(at) if s.getPath().getName().endswith(".json")), reverse=True)

    def _load(self, version: int) -> dict | None:
        fs, at = filesystem(self.spark, f"{self.root}/manifest/{version:020}.json")
        stream = fs.open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        except ValueError:  # cut short while it was written, so never in force
            return None
        finally:
            stream.close()

    def state(self) -> tuple[int, dict]:
        """The newest version that is whole, and the newest number in use."""
        versions = self._versions()
        for v in versions:
            found = self._load(v)
            if found is not None:
                return versions[0], found
        return (versions or [0])[0], {"segments": {}, "dropped": [], "marks": {}}

    def commit(self, change: Callable[[dict], dict]) -> None:
        for _ in range(100):
            newest, state = self.state()
            new = json.dumps(change(state), separators=(",", ":"))
            fs, at = filesystem(self.spark, f"{self.root}/manifest/{newest + 1:020}.json")
            try:
                stream = fs.create(at, False)
            except Exception as e:  # noqa: BLE001  another writer has this version
                if not fs.exists(at):
                    raise
                last = e
                continue
            stream.write(bytearray(new.encode()))
            stream.close()
            for old in self._versions()[8:]:  # a few are kept for readers
                remove(self.spark, f"{self.root}/manifest/{old:020}.json")
            return
        raise Conflict("too many writers") from last

    def segments(self, table: str, state: dict | None = None) -> dict[str, dict]:
        listed = (self.state()[1] if state is None else state)["segments"]
        return {k: v for k, v in listed.items() if v["table"] == table}

    # rows

    def read(self, table: str, names: Iterable[str] | None = None) -> DataFrame:
        """All rows of a table, or those of the named segments."""
        names = self.segments(table) if names is None else names
        paths = [f"{self.root}/{table}/{n}" for n in names]
        if not paths:
            return self.spark.createDataFrame([], self.schemas[table])
        return self.spark.read.schema(self.schemas[table]).parquet(*paths)

    def put(self, rows: dict[str, DataFrame], level: int = 0, replaces: Iterable[str] = (), batch: int | None = None, marks: dict | None = None, expect: dict[str, set] | None = None) -> dict[str, int]:
        """Add a segment to each table in one version; returns their rows.

        `replaces` names segments, of any table, that the new ones stand for.
        `batch` numbers the writes of one stream: a batch that is in already
        adds nothing.  `expect` gives the segments a table must still have."""
        replaces = set(replaces)
        if batch is not None and batch <= self.state()[1]["marks"].get("batch", -1):
            return dict.fromkeys(rows, 0)
        made, counted = {}, {}
        for table, df in rows.items():
            name = uuid.uuid4().hex
            path = f"{self.root}/{table}/{name}"
            seen = Observation()
            df.observe(seen, F.count(F.lit(1)).alias("rows")).write.option("parquet.dictionary.page.size", DICTIONARY).parquet(path)
            counted[table] = seen.get["rows"]
            fs, at = filesystem(self.spark, path)
            if counted[table]:
                made[name] = {"table": table, "level": level, "rows": counted[table], "bytes": fs.getContentSummary(at).getLength()}
            else:
                fs.delete(at, True)

        def change(state: dict) -> dict:
            listed = dict(state["segments"])
            if not replaces <= set(listed) or any({n for n, s in listed.items() if s["table"] == t} != names for t, names in (expect or {}).items()):
                raise Conflict("its segments have changed")
            if batch is not None and batch <= state["marks"].get("batch", -1):
                raise Conflict("that batch is in")
            now = time.time()
            gone = [[n, listed.pop(n)["table"], now] for n in replaces]
            old = [d for d in state["dropped"] if now - d[2] > self.grace]
            for name, table, _ in old:
                remove(self.spark, f"{self.root}/{table}/{name}")
            return {"segments": listed | made, "dropped": [d for d in state["dropped"] if d not in old] + gone, "marks": state["marks"] | (marks or {}) | ({} if batch is None else {"batch": batch})}

        try:
            if made or replaces or marks or batch is not None:
                self.commit(change)
        except (Conflict, PySparkException):
            for name, s in made.items():
                remove(self.spark, f"{self.root}/{s['table']}/{name}")
            raise
        return counted

    # merging

    def full(self, table: str, state: dict | None = None) -> tuple[int, list[str]] | None:
        """The lowest level of a table that has `fan` segments, and those."""
        levels: dict[int, list[str]] = {}
        for name, s in self.segments(table, state).items():
            if s["level"] < BASE:
                levels.setdefault(s["level"], []).append(name)
        return next(((x, names) for x, names in sorted(levels.items()) if len(names) >= self.fan), None)

    def gathered(self, table: str, names: list[str]) -> DataFrame:
        """Rows of segments in as few files as their bytes ask for."""
        listed = self.segments(table)
        return self.read(table, names).coalesce(max(1, sum(listed[n]["bytes"] for n in names) // FILE_BYTES))

    def merge(self, table: str, rewrite: Callable[[DataFrame], DataFrame] = lambda df: df) -> int:
        """Merge levels that are full; returns the number of merges.  A merge
        that another writer has overtaken is left to that one."""
        n = 0
        while (found := self.full(table)) is not None:
            level, names = found
            try:
                self.put({table: rewrite(self.gathered(table, names))}, level + 1, names)
            except Conflict:
                return n
            n += 1
        return n

    def vacuum(self) -> int:
        """Delete what no version lists: replaced segments whether or not their
        time is over, and what writes that were cut short have left.  For times
        when nothing else reads or writes."""
        _, state = self.state()
        n = 0
        for table in self.schemas:
            fs, at = filesystem(self.spark, f"{self.root}/{table}")
            for s in fs.listStatus(at) if fs.exists(at) else []:
                if s.getPath().getName() not in state["segments"]:
                    fs.delete(s.getPath(), True)
                    n += 1
        self.commit(lambda s: s | {"dropped": []})
        return n
