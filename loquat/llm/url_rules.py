"""URL filters by a sort-merge range join, in DataFrame functions alone.

Keys are hosts with reversed labels, each followed by a point, a `/` that ends
the host, and the path: `example.net` + `/en/` is `net.example.//en/`.  A rule's
prefix is an interval of such keys, and any two of them are nested or apart.  A URL stands
for its host and all parent hosts that have a rule, each with its path, so
that one key decides host and path together.

The sweep: rules and URL keys are sorted into ranges; a rule carries the stack
of the rules it is nested in, and what the sweep holds at a key is the stack of
the last rule that began.  Rules whose interval the key has left are popped by
their prefix; what is then on top is the longest rule for this key.  A range
opens with the stack of the last rule before it (one row a range).  Equal keys
are dealt over ranges by a hash, so a hot URL or host is no single task's work.
Of a URL's keys the rule that is longest as written (host and path) wins, then
the longer host; of equal rules, `block`.

Defined results: null URLs and those without `://` have empty host and path;
such URLs and those that no rule fits have a null rule and the `default`
verdict.  Only A-Z are lower-cased; ports and user names are part of the host,
so a rule has to name them.  An empty path does not start with a rule's `/`;
a rule with an empty path fits all paths.  A rule
with a null or empty host, or a null verdict, takes no part; a null path is
empty; a host is lower-cased and cut at `/`.  Repeated rows are rows of their
own; empty tables give an empty table or no rules; other columns pass through,
and an `output` that is a column already is an error.  Rows come back to their
verdicts by address, with all columns handed in: hand in what you need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import addressed, discard, free, fresh, materialise, n_partitions

LIMIT = 200_000  # hosts or verdicts that may be broadcast
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL, both empty where there is no `://`."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), LETTERS, LETTERS.lower())
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def reversed_host(host: Column) -> Column:
    """`www.example.net` as `net.example.www./`; no label holds a `/`."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("./"))


def parents(host: Column) -> Column:
    """A host and all its parents: `a.b.c`, `b.c`, `c`."""
    labels = F.split(host, r"\.")
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.transform(labels, lambda _, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), ".")))


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """(host, path, verdict) of rules written as (verdict, `host/path`)."""
    cut = [(*text.partition("/")[::2], verdict) for verdict, text in rules]
    return spark.createDataFrame([(host, "/" + path if "/" in text else path, verdict) for (host, path, verdict), (_, text) in zip(cut, rules)], "host string, path string, verdict string")


def stacks(rules: DataFrame) -> DataFrame:
    """(key, host, stack): each rule's key and the rules it is nested in, from
    the outermost to itself, as structs of their key's length and verdict.
    Shorter rules of the same host are looked up by their lengths, so a stack
    and the work for it are bounded by the length of a key."""
    host = F.translate(F.substring_index("host", "/", 1), LETTERS, LETTERS.lower())
    clean = rules.select(host.alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").where("host <> '' AND verdict IS NOT NULL")
    one = clean.groupBy("host", "path").agg(F.max_by("verdict", F.struct(F.col("verdict") == "block", "verdict")).alias("verdict"))
    keyed = one.select(F.concat(reversed_host(F.col("host")), "path").alias("key"), "host", "path", "verdict")
    sizes = keyed.groupBy("host").agg(F.collect_set(F.length("path")).alias("sizes"))  # distinct lengths: at most a path's length
    tried = keyed.join(sizes, "host").select("key", "host", "path", F.explode(F.filter("sizes", lambda n: n <= F.length("path"))).alias("n"))
    tried = tried.select("key", "host", "n", F.substr("path", F.lit(1), F.col("n")).alias("prefix"))
    outer = keyed.select("host", F.col("path").alias("prefix"), F.length("key").alias("size"), "verdict")
    found = tried.join(outer, ["host", "prefix"]).groupBy("key", "host").agg(F.sort_array(F.collect_list(F.struct("size", "verdict"))).alias("stack"))
    return found


def _sweep(rules: DataFrame, probes: DataFrame, ranges: int) -> DataFrame:
    """Probes (file, place, host, key) with the rule on top of the stack at
    their key: struct of length, length of the host and verdict, or null."""
    starts = rules.select("key", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("salt"), F.struct("key", "stack").alias("rule"), F.lit(None).cast("long").alias("file"), F.lit(None).cast("long").alias("place"), F.lit(None).cast("string").alias("host"))
    asked = probes.select("key", F.lit(1).alias("kind"), F.xxhash64("file", "place").alias("salt"), F.lit(None).cast(starts.schema["rule"].dataType).alias("rule"), "file", "place", "host")
    order = ["key", "kind", "salt"]
    ranged = materialise(starts.unionByName(asked).repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id()), "ranges")
    ends = ranged.where("kind = 0").groupBy("range").agg(F.max_by("rule", "key").alias("end"))  # one row a range at most
    everywhere = ranged.sparkSession.range(ranges).select(F.col("id").cast("int").alias("range")).join(F.broadcast(ends), "range", "left")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    opening = everywhere.select("range", F.last("end", True).over(before).alias("opening"))  # a fixed number of rows
    so_far = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = ranged.withColumn("last", F.last("rule", True).over(so_far)).where("kind = 1").join(F.broadcast(opening), "range")
    held = F.coalesce("last", "opening")
    key = F.col("key")
    active = F.filter(held["stack"], lambda r: F.startswith(key, F.substr(held["key"], F.lit(1), r["size"])))
    top = F.element_at(active, -1)
    out = swept.where(F.size(active) > 0).select("file", "place", "host", top.alias("top"), F.substr("key", F.lit(1), top["size"]).alias("prefix"))
    out.source = ranged
    return out


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", output: str = "url_rule") -> DataFrame:
    """Add `output`: struct of host, path, rule (as written, null if none fits)
    and verdict.  `rules` has the columns host, path and verdict."""
    spark = pages.sparkSession
    fresh(pages, output)
    file, place = free(pages, "_file"), free(pages, "_place")
    rows = addressed(pages, file, place)
    nested = materialise(stacks(rules), "rules")
    hosts = nested.select("host").distinct()
    few = hosts.count() <= LIMIT
    host, path = parts(F.col(f"`{url}`"))
    asked = rows.select(F.col(file).alias("file"), F.col(place).alias("place"), path.alias("path"), F.explode(parents(host)).alias("host"))
    asked = asked.join(F.broadcast(hosts) if few else hosts, "host", "left_semi")
    asked = asked.select("file", "place", "host", F.concat(reversed_host(F.col("host")), "path").alias("key"))
    swept = _sweep(nested.select("key", "stack"), asked, n_partitions(spark))
    written = F.concat("host", F.substr("prefix", F.length("host") + 3))
    best = F.max(F.struct(F.length("prefix").alias("length"), F.length("host").alias("of_host"), F.struct("host", "prefix", F.col("top.verdict").alias("verdict")).alias("found"))).alias("best")
    rule, verdict = free(rows, "_rule"), free(rows, "_verdict")
    found = swept.groupBy("file", "place").agg(best).select(F.col("file").alias(file), F.col("place").alias(place), F.col("best.found.host").alias("host"), F.col("best.found.prefix").alias("prefix"), F.col("best.found.verdict").alias(verdict))
    found = materialise(found.select(file, place, written.alias(rule), verdict), "verdicts")
    discard(swept.source, nested)
    side = F.broadcast(found) if found.count() <= LIMIT else found
    made = F.struct(host.alias("host"), path.alias("path"), F.col(rule).alias("rule"), F.coalesce(F.col(verdict), F.lit(default)).alias("verdict"))
    return rows.join(side, [file, place], "left").withColumn(output, made).drop(file, place, rule, verdict)
