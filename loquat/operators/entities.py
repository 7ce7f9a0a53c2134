"""Names in texts: scoring as persons or projects, the registry, onboarding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from . import written
from .extract import candidates
from .fts import bounded


EDGE, REACH, SEAM = r"[\p{L}\p{N}_]", 50, "\x01"


def ends(pieces: Column) -> Column:
    """Pieces without what is further than REACH characters from both their ends."""
    return F.transform(pieces, lambda p: F.when(F.length(p) > 2 * REACH, F.concat(F.substring(p, 1, REACH), F.substring(p, -REACH, REACH))).otherwise(p))


def beside(low: Column, pieces: Column, key: Column) -> Column:
    """The text `low` without what no sign of a name can hold: of each piece
    between two places of the name stays as much beside them as a place that
    overlaps one of them, a word, 40 blanks and a bound take.  A seam, which is
    part of no name, stands for the rest.  Texts of more blanks in a row stay whole."""
    reach = F.length(key) + 2 * REACH
    part = lambda p: F.when(F.length(p) > 2 * reach, F.concat(F.left(p, reach), F.lit(SEAM), F.right(p, reach))).otherwise(p)
    return F.when(F.regexp_like(low, F.lit(r"\s{40}")), low).otherwise(F.call_function("array_join", F.transform(pieces, part), key))


def near(pieces: Column, key: Column, i: Column) -> Column:
    """The i-th occurrence of `key`, from 1, with REACH characters on each side,
    in the text that it cuts into `pieces`.  It is put together of the pieces
    beside it: to find a place in the text takes as long as the text is long."""
    most = F.ceil(REACH / F.greatest(F.length(key), F.lit(1))).cast("int") + 1  # pieces that reach so far, if all are empty
    left, right = F.least(i, most), F.least(F.size(pieces) - i, most)
    joined = lambda first, n: F.call_function("array_join", F.slice(pieces, first, n), key)
    own = lambda j, more: F.when(F.length(F.get(pieces, j)) >= REACH, F.get(pieces, j)).otherwise(more)
    return F.concat(F.substring(own(i - 1, joined(i - left + 1, left)), -REACH, REACH), key, F.substring(own(i, joined(i + 1, right)), 1, REACH))


def _points(low: Column, key: Column, signs: dict[str, tuple[int, list[str]]]) -> list[Column]:
    """Points of each kind of sign, whose patterns name the text before and after a name."""
    def count(pattern: str) -> Column:
        a, b = pattern.split("{n}")
        # a bound is that no letter, digit or underscore is there
        a, b = (x.replace(r"\b", bound) for x, bound in ((a, rf"(?<!{EDGE})"), (b, rf"(?!{EDGE})")))
        name = F.concat(F.lit(r"\Q"), key, F.lit(r"\E"))
        if pattern.startswith(r"\b{n}"):  # the name first: it is looked for faster than a bound
            return F.regexp_count(low, F.concat(name, F.lit(rf"(?<!{EDGE}"), name, F.lit(")" + b)))
        return F.regexp_count(low, F.concat(F.lit(a), name, F.lit(b)))

    return [weight * sum(map(count, patterns), F.lit(0)) for weight, patterns in signs.values()]


def pronoun_points(pieces: Column, key: Column) -> Column:
    """Two points for each pronoun near an occurrence of the name, six at most.
    Once there are six, no more occurrences are looked at."""
    said = lambda text: sum((F.contains(text, F.lit(p)).cast("int") for p in C.PRONOUNS), F.lit(0))
    here = lambda i: F.get(F.transform(F.array(near(pieces, key, i)), said), F.lit(0))
    places = F.when(F.size(pieces) > 1, F.sequence(F.lit(1), F.size(pieces) - 1)).otherwise(F.array().cast("array<int>"))
    return F.least(2 * F.aggregate(places, F.lit(0), lambda n, i: F.when(n >= 3, n).otherwise(n + here(i))), F.lit(6))


def classify(names: DataFrame, docs: DataFrame) -> DataFrame:
    """names (id, name, count) of docs (id, content) to person, project or
    uncertain, with both scores."""
    both = names.join(docs.select("id", F.lower("content").alias("_low")), "id").withColumn("_key", F.lower("name"))
    # exploding keeps a value a column; inlined, each use would make it again
    keep = lambda df, name, value: df.select("id", "name", "count", "_key", *(c for c in df.columns if c == "_low"), F.explode(F.array(value)).alias(name))
    key = F.col("_key")
    cut = keep(both, "_cut", F.split("_low", F.concat(F.lit(r"\Q"), key, F.lit(r"\E"))))
    text = keep(cut, "_x", F.struct(ends(F.col("_cut")).alias("pieces"), beside(F.col("_low"), F.col("_cut"), key).alias("near"))).drop("_low")
    person = [*_points(F.col("_x.near"), key, C.PERSON_SIGNS), pronoun_points(F.col("_x.pieces"), key)]
    points = keep(text, "_p", F.struct(F.array(*person).alias("person"), sum(_points(F.col("_x.near"), key, C.PROJECT_SIGNS), F.lit(0)).alias("project")))
    score, kinds = F.aggregate("_p.person", F.lit(0), lambda a, x: a + x), F.size(F.filter("_p.person", lambda x: x > 0))
    both = points.select("id", "name", "count", F.col("_p.project").alias("project_score"), score.alias("person_score"), kinds.alias("signal_types"))
    kind = F.expr("CASE WHEN person_score >= 4 AND signal_types >= 2 THEN 'person' WHEN project_score >= 4 THEN 'project' WHEN person_score >= 2 AND count >= 5 THEN 'person' ELSE 'uncertain' END")
    return both.withColumn("entity_type", kind)


def detect(docs: DataFrame) -> DataFrame:
    """(id, entity_type, names): the classified candidates of each text, most frequent first."""
    rows = classify(candidates(docs), docs)
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("c"), "name")))
    return rows.groupBy("id", "entity_type").agg(F.transform(ordered, lambda x: x["name"]).alias("names"))


def learn(docs: DataFrame, people: DataFrame, least: float = 0.75) -> DataFrame:
    """Persons found that the registry lacks, with confidence min(0.5 + count / 20, 1)."""
    # who is known goes before anything is classified; small sides are written, so that no broadcast waits behind that work
    known = bounded(written.written(people.select(F.lower("name").alias("_k")).distinct(), "known"))
    new = candidates(docs).join(known, F.lower("name") == F.col("_k"), "left_anti")
    sure = F.least((F.col("count") + 10) / 20.0, F.lit(1.0))  # one rounding, so the nearest double
    rows = classify(new.withColumn("confidence", sure).where(F.col("confidence") >= least).drop("confidence"), docs)
    return rows.where("entity_type = 'person'").select("id", "name", "count", sure.alias("confidence"))


def people_in(query: Column, people: list[str]) -> Column:
    """Distinct capitalised words of a query that are known people, case folded."""
    words = F.array_distinct(F.transform(F.regexp_extract_all(query, F.lit(r"\b[A-Z][a-zA-Z]*\b"), F.lit(0)), F.lower))
    return F.filter(words, lambda w: w.isin([p.lower() for p in people]))


def parse_people(text: Column) -> Column:
    """`Name[:relationship],...` to an array of (name, relationship)."""
    parts = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")
    colon = lambda x: F.instr(x, ":")
    pair = lambda x: F.struct(
        F.when(colon(x) > 1, F.trim(F.substring_index(x, ":", 1))).otherwise(x).alias("name"),
        F.when(colon(x) > 1, F.trim(F.substring(x, colon(x) + 1, F.length(x)))).otherwise(F.lit("")).alias("relationship"))
    return F.filter(F.transform(parts, pair), lambda p: p["name"] != "")


def assign_codes(names: list[str]) -> dict[str, str]:
    """Distinct three-letter codes in the order of the names: the first free
    window of the name's letters, else two letters and a number."""
    out: dict[str, str] = {}
    for name in names:
        letters = name.upper().replace(" ", "") or "XXX"
        letters = letters.ljust(3, letters[-1])
        windows = [letters[i : i + 3] for i in range(len(letters) - 2)]
        numbered = (f"{letters[:2]}{i}" for i in range(1, len(names) + 2))
        used = set(out.values())
        out[name] = next(c for c in (*windows, *numbered) if c not in used)
    return out


def registry_seed(people: list[dict], projects: list[str] = (), aliases: dict[str, str] | None = None, mode: str = "personal") -> dict:
    """Registry of onboarding answers; names that are common words are marked ambiguous."""
    aliases = aliases or {}
    entries = {p["name"]: {"source": "onboarding", "confidence": 1.0, "relationship": p.get("relationship", ""), "aliases": [aliases[p["name"]]] if p["name"] in aliases else []} for p in people}
    return {"mode": mode, "people": entries, "projects": sorted(set(projects)), "ambiguous_flags": sorted(n for n in entries if n.lower() in C.COMMON_WORDS)}


def registry_summary(registry: dict) -> str:
    return f"{len(registry['people'])} people, {len(registry['projects'])} projects, mode {registry['mode']}"


def seed_facts(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """facts (key, value, seq) to entities and triples: a key is `type:name` or a
    name, a value is a JSON object of predicates or an array of related names."""
    typed = F.instr("key", ":") > 0
    f = facts.select(
        F.when(typed, F.trim(F.substring_index("key", ":", 1))).otherwise("unknown").alias("entity_type"),
        F.trim(F.when(typed, F.expr("substring(key, instr(key, ':') + 1)")).otherwise(F.col("key"))).alias("name"), "value", "seq")
    entities = f.select("name", "entity_type", F.lit("{}").alias("properties"), "seq")
    pairs = F.coalesce(F.from_json("value", "map<string,string>"), F.create_map().cast("map<string,string>"))
    plain = F.transform(F.coalesce(F.from_json("value", "array<string>"), F.array().cast("array<string>")), lambda o: F.struct(F.lit("related_to").alias("key"), o.alias("value")))
    every = F.when(F.ltrim("value").startswith("["), plain).otherwise(F.map_entries(pairs))
    rows = f.select("name", "seq", F.explode(every).alias("x"))
    none = F.lit(None).cast("string")
    return entities, rows.select(F.col("name").alias("subject"), F.col("x.key").alias("predicate"), F.col("x.value").alias("object"), none.alias("valid_from"), none.alias("valid_to"), "seq")
