"""Chat exports to role/text turns, from JSON of several shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def role_content(raw: DataFrame) -> DataFrame:
    """raw (id, text) to (conv_id, turn, role, text): arrays of {role, content},
    {messages: [...]}, {chat_messages: [{sender, text}]}."""
    v = raw.select("id", F.try_parse_json("text").alias("v"))
    shape = F.coalesce(F.try_variant_get("v", "$.messages", "variant"), F.try_variant_get("v", "$.chat_messages", "variant"), F.col("v"))
    items = v.select("id", F.expr("try_cast(v as array<variant>)").alias("bare"), F.try_variant_get(shape, "$", "array<variant>").alias("items"))
    rows = items.select(F.col("id").alias("conv_id"), F.posexplode("items").alias("turn", "m"))
    get = lambda *names: F.coalesce(*[F.try_variant_get("m", f"$.{n}", "string") for n in names])
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.lower(get("role", "sender")).alias("role"), get("content", "text").alias("text")).where("role IS NOT NULL AND trim(text) <> ''")


def channel(raw: DataFrame) -> DataFrame:
    """Arrays of {user, text}: the first user seen is `user`, all others `assistant`."""
    rows = raw.select("id", F.expr("from_json(text, 'array<struct<user:string,text:string>>')").alias("m"))
    first = F.get("m", F.lit(0))["user"]
    return rows.select(F.col("id").alias("conv_id"), first.alias("_f"), F.posexplode("m").alias("turn", "x")).select("conv_id", F.col("turn").cast("long").alias("turn"), F.when(F.col("x.user") == F.col("_f"), "user").otherwise("assistant").alias("role"), F.col("x.text").alias("text")).where("trim(text) <> ''")


def session_lines(raw: DataFrame) -> DataFrame:
    """JSON lines {type, content or message or text}; lines that fail to parse are skipped."""
    rows = raw.select("id", F.posexplode(F.split("text", "\n")).alias("turn", "line")).select("id", "turn", F.try_parse_json("line").alias("v")).where("v IS NOT NULL")
    get = lambda n: F.try_variant_get("v", f"$.{n}", "string")
    kind = F.lower(get("type"))
    role = F.when(kind.isin("human", "user"), "user").when(kind == "assistant", "assistant")
    return rows.select(F.col("id").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.coalesce(get("content"), get("message"), get("text")).alias("text")).where("role IS NOT NULL AND trim(text) <> ''")
