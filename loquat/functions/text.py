"""Text functions as Columns."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as C



def folding() -> tuple[str, str, str]:
    """Lower-case letters, what they fold to, and the marks that fold away.  A
    Latin letter with one mark is the plain letter, one with two marks stays;
    lower-case variants such as a final sigma are the usual letter."""
    letters, plain, marks = "", "", set()
    for c in map(chr, range(0xB5, 0x2000)):
        usual = c.casefold()
        usual = usual if len(usual) == 1 and usual == usual.lower() and c.isalpha() else c
        parts = unicodedata.normalize("NFD", usual)
        marked = len(parts) == 2 and "a" <= parts[0] <= "z" and unicodedata.category(parts[1]) == "Mn"
        if c == c.lower() and (marked or usual != c):
            letters, plain = letters + c, plain + (parts[0] if marked else usual)
            marks |= {parts[1]} if marked else set()
    return letters, plain, "".join(sorted(marks))


ACCENTED, PLAIN, MARKS = folding()
# Spark takes lower(upper(x)) for lower(x), so these letters are looked for here
LOWER_ONLY = "".join(c for c in map(chr, range(0x10000)) if c.upper() != c and c.upper().lower() != c)
NO_CAPITAL = "".join(c for c in LOWER_ONLY if len(c.upper()) > 1)


def normalize_whitespace(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(s, r"(?U)\s+", " "), "^ | $", "")


def capital(s: Column) -> Column:
    """The first letter in upper case, if that is the same letter again in lower
    case (`ß` has two capitals, a dotless i gets a dot)."""
    first = F.substring(s, 1, 1)
    return F.concat(F.when(F.contains(F.lit(LOWER_ONLY), first), first).otherwise(F.upper(first)), F.substring(s, 2, 1 << 20))


def upper(s: Column) -> Column:
    """Upper case letter by letter: one that has several capitals stays, `ß` is `ẞ`."""
    plain = F.upper(F.regexp_replace(s, "ß", "ẞ"))
    each = lambda c: F.when(F.contains(F.lit(NO_CAPITAL), c), c).otherwise(F.upper(c))
    return F.when(F.regexp_like(s, F.lit(f"[{NO_CAPITAL.replace('ß', '')}]")), F.array_join(F.transform(F.split(F.regexp_replace(s, "ß", "ẞ"), ""), each), "")).otherwise(plain)


def room_name(s: Column) -> Column:
    return F.replace(F.lower(s), F.lit(" "), F.lit("-"))


def entity_id(s: Column) -> Column:
    return F.replace(F.replace(F.replace(F.lower(s), F.lit(" "), F.lit("_")), F.lit("'"), F.lit("")), F.lit("-"), F.lit("_"))


def entity_key(name: str) -> str:
    """`entity_id` of a string."""
    return name.lower().replace(" ", "_").replace("'", "").replace("-", "_")


def tokens(s: Column) -> Column:
    """Case- and accent-folded runs of letters and digits; a mark that follows
    its letter counts as an accent."""
    return F.regexp_extract_all(F.translate(F.lower(s), ACCENTED + MARKS, PLAIN), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def text_id(s: Column, number: Column) -> Column:
    """MD5 of a text and its number, as evaluation ids."""
    return F.md5(F.concat(s, number.cast("string")))


def most_frequent(words: Column, most: int) -> Column:
    """Of an array of (key, pos), sorted, the keys that occur most often as (n,
    pos, key), n below zero, those that come first leading on ties.  `words` has
    to be a column, as it is looked at once a word."""
    n = F.size(words)
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    starts = F.filter(places, lambda i: (i == 0) | (F.get(words, i)["key"] != F.get(words, i - 1)["key"]))
    one = lambda a, b: F.struct((a - b).alias("n"), F.get(words, a)["pos"].alias("pos"), F.get(words, a)["key"].alias("key"))
    # of a one-element array, so that the starts are looked for once
    counted = F.transform(F.array(starts), lambda s: F.transform(s, lambda a, j: one(a, F.coalesce(F.get(s, j + 1), n))))
    return F.slice(F.sort_array(F.get(counted, F.lit(0))), 1, most)


def ascii_words(s: Column) -> Column:
    return F.regexp_extract_all(F.lower(s), F.lit("[a-z]+"), F.lit(0))


def title(path: Column) -> Column:
    return F.coalesce(F.element_at(F.split(path, "/"), -1), F.lit("unknown"))


def snippet(s: Column, n: int = 200) -> Column:
    return F.when(F.length(s) > n, F.concat(F.substring(s, 1, n), F.lit("…"))).otherwise(s)


def count_tokens(s: Column) -> Column:
    return F.floor(F.length(s) / 3).cast("long")


def keywords(s: Column, stop: list[str] = C.EVALUATION_STOP) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(s), F.lit(r"\b[a-z]{3,}\b"), F.lit(0)), lambda w: ~w.isin(stop))


def keyword_overlap(words: Column, s: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.filter(words, lambda w: F.contains(s, w))).cast("double"), F.size(words)), F.lit(0.0))


def person_names(s: Column) -> Column:
    return F.filter(F.array_distinct(F.regexp_extract_all(s, F.lit("[A-Z][a-z]{2,15}"), F.lit(0))), lambda w: ~w.isin(C.NOT_NAMES))


def jaccard(a: Column, b: Column) -> Column:
    """Set Jaccard; two empty sets are alike."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b))), F.lit(1.0))


def timestamp_date(s: Column) -> Column:
    us = lambda g: F.regexp_extract(s, r"^(\d{1,2})/(\d{1,2})/(\d{4})", g)
    return F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(s, 1, 10)).when(us(3) != "", F.concat_ws("-", us(3), F.lpad(us(1), 2, "0"), F.lpad(us(2), 2, "0")))


def hits(s: Column, words: list[str]) -> Column:
    """Number of the words that `s` contains as substrings."""
    total = F.lit(0)
    for w in words:
        total = total + F.contains(s, F.lit(w)).cast("int")
    return total


def best(scores: dict[str, Column], default: str | None) -> Column:
    """Name of the highest positive score, the first on ties."""
    top = F.array_max(F.array(*[F.struct(v.cast("double").alias("v"), F.lit(-i).alias("i"), F.lit(k).alias("k")) for i, (k, v) in enumerate(scores.items())]))
    return F.when(top["v"] > 0, top["k"]).otherwise(F.lit(default))


def topic(s: Column, table: dict[str, list[str]] = C.TOPICS) -> Column:
    low = F.lower(s)
    return best({k: hits(low, v) for k, v in table.items()}, "general")


def category(t: Column) -> Column:
    out = F.lit("cat_general")
    for k, v in C.CATEGORIES.items():
        out = F.when(t == k, F.lit(v)).otherwise(out)
    return out


def codes(s: Column, table: dict[str, list[str]], names: dict[str, str], sep: str = "+") -> Column:
    low = F.lower(s)
    return F.concat_ws(sep, *[F.when(hits(low, v) > 0, F.lit(names.get(k, k))) for k, v in table.items()])


def dot(a: Column, b: Column) -> Column:
    """Dot product in double; 0 for different lengths."""
    product = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), product).otherwise(F.lit(0.0))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
