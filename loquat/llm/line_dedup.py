"""Line deduplication by site-relative frequency.

For each host, a line's ratio is the number of the host's pages that hold it
over the number of the host's pages; lines over the ratio are boilerplate and
are dropped from the host's pages if at least `min_pages` pages hold them.  At
ratio 0.1 that floor of 5 pages decides on hosts of under 50 pages (the ratio is
in effect 5 / pages) and leaves hosts of under 5 pages as they are: a menu line
on 4 of 10 pages stays.  Under it, two copies of a page on a host of under 20
pages would be boilerplate to each other and lose all their lines.  A host has at most (mean lines a page) /
ratio such lines, so they travel to the pages: up to `LIMIT` lines by broadcast,
and the texts stay where they are; beyond, by a join on host and salt, for which
the pages are shuffled with the columns handed in.

Defined results: null text stays null; null host is a host of its own; a page
that holds a line twice counts once; empty lines are never dropped; repeated
rows are pages of their own; a page whose lines are all dropped gets the empty
text; other columns pass through, and an
`output` that is a column already is an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import free, fresh, materialise

SALTS = 32  # shares of a host's pages
LIMIT = 200_000  # boilerplate lines that may be broadcast (16 bytes each)


def _key(line: Column) -> Column:
    """128 bits of a line: counts need no texts."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("second"), line).alias("b"))


def boilerplate(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = 0.1, min_pages: int = 5) -> DataFrame:
    """Rows (host, keys): the keys of each host's boilerplate lines."""
    h = F.col(host).alias("_host")
    total = pages.groupBy(h).agg(F.count("*").alias("_pages"))
    keys = F.array_distinct(F.transform(F.filter(F.split(F.col(text), "\n"), lambda x: x != ""), _key))
    counts = pages.select(h, F.explode(keys).alias("_line")).groupBy("_host", "_line").agg(F.count("*").alias("_n")).where(F.col("_n") >= min_pages)
    over = counts.join(total, counts["_host"].eqNullSafe(total["_host"])).drop(total["_host"])
    return over.where(F.col("_n") > F.lit(ratio) * F.col("_pages")).groupBy("_host").agg(F.collect_set("_line").alias("_keys"))


def host_of(url: Column) -> Column:
    """Lower-cased host of a URL without port and user, null where there is
    none; for tables of pages, whose host is no column."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)), F.lit(""))


def dedup_lines(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = 0.1, min_pages: int = 5, output: str = "clean") -> DataFrame:
    """Add `output`: struct of the text without boilerplate lines, the number
    of lines and of dropped lines."""
    found = materialise(boilerplate(pages, host, text, ratio, min_pages), "boilerplate")
    n = found.select(F.sum(F.size("_keys"))).first()[0] or 0
    site, keys, kept = free(pages, "_site"), free(pages, "_found"), free(pages, "_rest")
    found = found.select(F.col("_host").alias(site), F.col("_keys").alias(keys))
    if n <= LIMIT:
        joined = pages.join(F.broadcast(found), pages[host].eqNullSafe(found[site]), "left")
    else:  # a host's pages are dealt over salts, each of which gets the host's lines
        salt, turn = free(pages, "_salt"), free(pages, "_turn")
        found = found.withColumn(turn, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        pages = pages.withColumn(salt, F.pmod(F.xxhash64(F.col(text)), F.lit(SALTS)))
        joined = pages.join(found, pages[host].eqNullSafe(found[site]) & (pages[salt] == found[turn]), "left").drop(salt, turn)
    lines = F.split(F.col(text), "\n")
    rest = F.filter(lines, lambda x: (x == "") | ~F.coalesce(F.array_contains(F.col(keys), _key(x)), F.lit(False)))
    rest = F.when(F.col(keys).isNull(), lines).otherwise(rest)
    clean = F.struct(
        F.array_join(kept, "\n").alias("text"),
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("lines"),
        F.coalesce(F.size(lines) - F.size(kept), F.lit(0)).cast("long").alias("dropped"),
    )
    return joined.withColumn(kept, rest).withColumn(fresh(pages, output), clean).drop(site, keys, kept)
