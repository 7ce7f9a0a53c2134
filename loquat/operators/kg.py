"""Temporal knowledge graph over entities and triples; bounds are text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import entity_id
from . import fts, written


def valid_at(t: str | Column) -> Column:
    t = F.lit(t) if isinstance(t, str) else t
    return (F.col("valid_from").isNull() | (F.col("valid_from") <= t)) & (F.col("valid_to").isNull() | (F.col("valid_to") >= t))


def facts(triples: DataFrame) -> DataFrame:
    return triples.withColumn("is_current", F.col("valid_to").isNull())


def query_entity(triples: DataFrame, name: str, as_of: str | None = None, direction: str = "both") -> DataFrame:
    me = entity_id(F.lit(name))
    out, into = F.col("subject") == me, F.col("object") == me
    side = {"out": out, "subject": out, "in": into, "object": into}.get(direction, out | into)
    df = facts(triples).where(side)
    return df if as_of is None else df.where(valid_at(as_of))


def query_relationship(triples: DataFrame, predicate: str, as_of: str | None = None) -> DataFrame:
    df = facts(triples).where(F.col("predicate") == predicate)
    return df if as_of is None else df.where(valid_at(as_of))


LEVELS = 8  # bucket sizes of 1, 8, 64, ... days; the largest holds all dates of four digits' years
FAN = 8
DATED, ODD, SHARES = -2, -1, 8  # classes beside the buckets, for texts that are no dates


def _day(t: Column) -> Column:
    """A number that orders texts which begin with a date as the texts are
    ordered; null for other texts."""
    date = F.regexp_like(t, F.lit(r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])"))
    part = lambda i, n: F.try_to_number(F.substr(t, F.lit(i), F.lit(n)), F.lit("9" * n)).cast("long")
    return F.when(date, part(1, 4) * 372 + (part(6, 2) - 1) * 31 + part(9, 2) - 1)


def _levelled(numbers: Column, level: int) -> Column:
    return F.transform(numbers, lambda n: F.struct(F.lit(level).alias("level"), n.alias("number")))


def _buckets(low: Column, high: Column) -> Column:
    """The fewest buckets (level, number) that make up the days low to high:
    at each level those inside that no bucket of the next level holds."""
    out = []
    for level in range(LEVELS + 1):
        size = FAN**level
        first, last = F.floor((low + size - 1) / size).cast("long"), F.floor((high + 1) / size).cast("long") - 1
        up, down = F.floor((low + size * FAN - 1) / (size * FAN)).cast("long"), F.floor((high + 1) / (size * FAN)).cast("long") - 1
        span = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<long>"))
        if level == LEVELS:
            held = span(first, last)
        else:
            held = F.when(up > down, span(first, last)).otherwise(F.concat(span(first, up * FAN - 1), span((down + 1) * FAN, last)))
        out.append(_levelled(held, level))
    return F.concat(*out)


def as_of_join(probes: DataFrame, triples: DataFrame) -> DataFrame:
    """probes (entity, t) with the facts about the entity that hold at t.

    A fact stands in the few buckets of days, of eight times growing sizes, that
    its time is made of (an open end reaches the last day there is); a probe
    looks into one bucket of each size.  So facts and probes of a busy entity
    meet only where they match, but for the hours of the first and last day,
    and the entity's rows are dealt over its buckets.  Facts with a bound that
    is no date meet all probes of their entity, and probes at no date all facts;
    both are dealt over a few shares and compared as texts.  A null t meets
    nothing unless both bounds are open."""
    last = FAN**LEVELS - 1
    low = F.when(F.col("valid_from").isNull(), F.lit(0).cast("long")).otherwise(_day(F.col("valid_from")))
    high = F.when(F.col("valid_to").isNull(), F.lit(last).cast("long")).otherwise(_day(F.col("valid_to")))
    every = F.sequence(F.lit(0).cast("long"), F.lit(SHARES - 1).cast("long"))
    share = F.array(F.pmod(F.xxhash64(*triples.columns), F.lit(SHARES)))
    held = triples.withColumn("_low", low).withColumn("_high", high)
    plain = F.col("_low").isNotNull() & F.col("_high").isNotNull()
    stands = F.when(plain, F.concat(_buckets(F.col("_low"), F.col("_high")), _levelled(share, DATED))).otherwise(_levelled(share, ODD))
    asked = probes.withColumn("_day", _day(F.col("t")))
    sizes = F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), lambda n: F.struct(n.alias("level"), F.floor(F.col("_day") / F.pow(F.lit(float(FAN)), n)).cast("long").alias("number")))
    looks = F.concat(F.when(F.col("_day").isNotNull(), sizes).otherwise(_levelled(every, DATED)), _levelled(every, ODD))
    met = asked.withColumn("_p", F.explode(looks)).join(held.withColumn("_b", F.explode(stands)), (F.col("entity") == F.col("subject")) & (F.col("_b") == F.col("_p")))
    return met.where(valid_at(F.col("t"))).drop("_low", "_high", "_day", "_b", "_p")


def as_of_summary(probes: DataFrame, triples: DataFrame, **values: Column) -> DataFrame:
    """`probes` with aggregates of the facts that hold at their time, without
    those that meet none.  Probes of one entity and time are asked once, so the
    work grows with facts and distinct times, not with facts times probes; up to
    20,000 of them go to where the facts are."""
    asked = written.written(probes.select("entity", "t").distinct(), "asked")
    met = as_of_join(fts.bounded(asked, 20_000), triples).groupBy("entity", "t").agg(*[v.alias(k) for k, v in values.items()])
    own, theirs = F.struct("entity", "t"), F.struct(F.col("_m.entity"), F.col("_m.t"))
    return probes.join(met.select(F.struct("entity", "t").alias("_m"), *values), own.eqNullSafe(theirs)).drop("_m")


def timeline(triples: DataFrame, name: str | None = None) -> DataFrame:
    df = triples if name is None else query_entity(triples, name)
    return df.orderBy(F.coalesce("valid_from", "extracted_at").desc(), "subject", "predicate", "object")


def stats(entities: DataFrame, triples: DataFrame) -> DataFrame:
    kinds = entities.groupBy("entity_type").count().agg(F.map_from_entries(F.collect_list(F.struct("entity_type", "count"))).alias("types"))
    counts = triples.agg(F.count("*").alias("triples"), F.count_if(F.col("valid_to").isNull()).alias("active"))
    return entities.agg(F.count("*").alias("entities")).crossJoin(counts).crossJoin(kinds)  # one row each


def first_of(df: DataFrame, key: list[str], order: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(order))
    return df.withColumn("_rn", rank).where("_rn = 1").drop("_rn")


def add_entities(entities: DataFrame, new: DataFrame, order: str = "seq") -> DataFrame:
    """New rows of `new` (name, entity_type, properties, order); the first of an id stays."""
    rows = first_of(new.withColumn("id", entity_id(F.col("name"))), ["id"], order)
    return rows.join(entities.select("id"), "id", "left_anti").select("id", "name", "entity_type", "properties")


def add_triples(triples: DataFrame, new: DataFrame, order: str = "seq") -> DataFrame:
    """New rows of `new` (subject, predicate, object, ...): a fact that is
    active already is not added again, a closed one always is."""
    rows = new.withColumn("subject", entity_id(F.col("subject"))).withColumn("object", entity_id(F.col("object")))
    key = ["subject", "predicate", "object"]
    open_ = first_of(rows.where("valid_to IS NULL"), key, order).join(triples.where("valid_to IS NULL").select(key), key, "left_anti")
    return open_.unionByName(rows.where("valid_to IS NOT NULL")).drop(order)


def invalidate(triples: DataFrame, ended: DataFrame) -> DataFrame:
    """A new snapshot: active rows that match `ended` (subject, predicate, object, ended) are closed."""
    key = ["subject", "predicate", "object"]
    last = ended.groupBy(key).agg(F.min("ended").alias("_ended"))
    return triples.join(last, key, "left").withColumn("valid_to", F.coalesce("valid_to", "_ended")).drop("_ended")
