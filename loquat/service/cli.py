"""Command line: `python -m loquat.service.cli VERB ...` over a store folder."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..operators import embed, entities, extract, sessions
from ..sources import files
from . import settings
from .memory import Memory
from .rpc import Server


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loquat")
    p.add_argument("--store", default=os.environ.get("LOQUAT_STORE", os.path.expanduser("~/.loquat")))
    p.add_argument("--no-embed", action="store_true")
    verbs = p.add_subparsers(dest="verb", required=True)

    def verb(name: str, *positional: str, **flags) -> None:
        v = verbs.add_parser(name)
        for x in positional:
            v.add_argument(x, **({"nargs": x[-1]} if x[-1] in "+?" else {}))
        for flag, default in flags.items():
            kind = {"action": "store_true"} if default is False else {"default": default, "type": int if isinstance(default, int) else str}
            v.add_argument("--" + flag.replace("_", "-"), **kind)

    for name, positional, flags in (
        ("init", [], {}), ("mine", ["path"], {"mode": "projects", "domain": None, "limit": 0, "dry_run": False, "paragraphs": False}),
        ("search", ["query"], {"domain": None, "topic": None, "limit": 10}), ("embed", [], {}), ("embeddings", [], {"domain": None, "topic": None, "query": None, "limit": 20, "dims": 8}),
        ("status", [], {}), ("wake-up", [], {"domain": None}), ("compress", ["path"], {}), ("split", ["path", "out"], {"min_sessions": 2}),
        ("repair", [], {}), ("onboard", [], {"people": "", "projects": "", "domains": "", "edit": "", "mode": "personal", "scan": None}), ("who", ["words"], {}), ("serve", [], {}),
    ):
        verb(name, *positional, **flags)
    return p


def read_text(path: str) -> str | None:
    """A file of the user's own home, or None."""
    if not os.path.exists(path):
        return None
    with open(path, encoding="utf-8") as f:
        return f.read()


def onboard(spark: SparkSession, store: str, a: argparse.Namespace) -> str:
    """Registry of people, projects and codes in the store's folder."""
    people = [r.asDict() for r in spark.range(1).select(F.explode(entities.parse_people(F.lit(a.people))).alias("p")).select("p.*").collect()]
    found: dict[str, list[str]] = {}
    if a.scan:
        text = files.prose(spark, a.scan).agg(F.array_join(F.array_sort(F.collect_list("content")), "\n").alias("content")).withColumn("id", F.lit(a.scan))
        found = {r.entity_type: list(r.names) for r in entities.detect(text).collect()}
    registry = entities.registry_seed(people, [x.strip() for x in a.projects.split(",") if x.strip()], mode=a.mode)
    found = {kind: settings.edited(names, a.edit) for kind, names in found.items()}
    registry |= {"codes": entities.assign_codes(list(registry["people"])), "detected": found}
    settings.save_registry(f"{store}/registry.json", registry)
    settings.bootstrap(store, registry, [x.strip() for x in a.domains.split(",") if x.strip()])
    return entities.registry_summary(registry)


def who(spark: SparkSession, registry: dict, text: str) -> DataFrame:
    """The words of a text as the registry knows them, the text being their context."""
    listed = lambda names: spark.createDataFrame([(n,) for n in names], "name string")
    people = spark.createDataFrame([(n, float(e.get("confidence", 1.0))) for n, e in registry["people"].items()], "name string, confidence double")
    words = spark.createDataFrame([(w, text) for w in dict.fromkeys(text.split())], "word string, context string")
    return extract.lookup(words, people, listed(registry["projects"]), listed(registry["ambiguous_flags"]), C.PERSON_CONTEXT).orderBy("word")


def run(spark: SparkSession, argv: list[str], lines=sys.stdin, out=sys.stdout) -> int:
    a = parser().parse_args(argv)
    m = Memory(spark, a.store, None if a.no_embed else embed.hashing, read_text(f"{a.store}/identity.txt"))

    def say(text) -> None:
        print(text, file=out)

    if a.verb == "init":
        m.init()
        settings.load_config(f"{a.store}/config.json")
        say(f"Initialised {a.store}")
    elif a.verb == "mine":
        r = m.mine(a.path, a.domain, a.mode, a.limit, a.dry_run, a.paragraphs)
        say(f"{r['files']} files, {r['added']} chunks added, {r['skipped']} skipped.")
        for topic, n in sorted(r["topics"].items(), key=lambda x: (-x[1], x[0])):
            say(f"  {topic}: {n}")
    elif a.verb == "search":
        found = m.search(a.query, a.domain, a.topic, a.limit).collect()
        for r in found:
            say(f"[{r.score:.2f}] ({r.domain}/{r.topic}) {r.title}\n  {r.snippet}\n")
        if not found:
            say("No results found.")
    elif a.verb == "embed":
        say(f"{m.embed()} chunks embedded.")
    elif a.verb == "embeddings" and a.query is not None:
        if m.model is None:
            print("--query needs the embedding model; leave --no-embed out", file=sys.stderr)
            return 1
        for r in m.nearest(a.query, a.domain, a.topic, a.limit).collect():
            line = " ".join(r.snippet.split())
            say(f"{r.score:5.3f}  {r.domain:<16} {r.topic:<14} {r.title:<30}  {line[:60] + '…' if len(line) > 60 else line}")
    elif a.verb == "embeddings":
        for r in m.page(a.domain, a.limit, a.dims).collect():
            say(f"{r.id:<10} {r.domain:<16} {r.topic:<14} {r.title:<28} {r.norm:5.3f} " + " ".join(f"{x:6.3f}" for x in r.head) + (f" … {r.more} more" if r.more else ""))
    elif a.verb == "status":
        say(json.dumps(m.status(), ensure_ascii=False, indent=2))
    elif a.verb == "wake-up":
        say(m.wake_up(a.domain))
    elif a.verb == "compress":
        docs = files.read(spark, a.path).withColumnRenamed("path", "id")
        both = extract.compress(docs).join(docs, "id").select("id", "summary", extract.compression_stats(F.col("content"), F.col("summary")).alias("s"))
        for r in both.orderBy("id").toLocalIterator():
            say(f"# {r.id}\n{r.summary}\n# {r.s.original_tokens} -> {r.s.compressed_tokens} tokens, {100 * r.s.ratio:.1f}%")
    elif a.verb == "split":
        top = files.relative(files.read(spark, a.path), a.path)
        named = top.where(F.lower("path").rlike(r"^[^/]+\.(txt|md|jsonl)$")).select(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("id"), "content")
        for r in sessions.write(sessions.split(named, a.min_sessions), a.out).collect():
            say(f"{r.file_name}: {r.bytes} bytes")
    elif a.verb == "repair":
        m.repair()
        say("Index written.")
    elif a.verb == "onboard":
        say(onboard(spark, a.store, a))
    elif a.verb == "who":
        for r in who(spark, settings.load_registry(f"{a.store}/registry.json"), a.words).collect():
            say(f"{r.word}: {r.entity_type} ({r.confidence:.2f})")
    elif a.verb == "serve":
        Server(m).serve(lines, out)
    return 0


if __name__ == "__main__":
    sys.exit(run(SparkSession.builder.appName("loquat").getOrCreate(), sys.argv[1:]))
