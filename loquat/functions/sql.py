"""Chunking, exchanges and sessions as functions of Spark SQL.

`register(spark)` defines them for a session.  Each is one expression over the
text of a row and gives an array, which a lateral view makes rows:

    SELECT id, chunk_index, chunk
    FROM (SELECT id, chunks_of(content, 800, 100) AS parts FROM notes)
    LATERAL VIEW posexplode(parts) AS chunk_index, chunk

That plan has no join, no shuffle and no Python worker; a function that returns
a table would be joined to the distinct texts.  Rows are those of the functions
of the same purpose in `operators.chunking`.  A null text gives null, which a
lateral view passes over."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _let(name: str, value: str, body: str) -> str:
    """`body` with a name for a value, which is made once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, r'(?U)^\\s+|\\s+$', '')"


def _full(parts: str) -> str:
    return f"filter(transform({parts}, x -> {_strip('x')}), x -> x <> '')"


def _places(lines: str, holds: str) -> str:
    """Positions, from 0, of the lines for which a condition on (x, i) holds."""
    return f"filter(transform({lines}, (x, i) -> CASE WHEN {holds} THEN i END), i -> i IS NOT NULL)"


def _slice(lines: str, starts: str) -> str:
    """Lines from the start `a`, the j-th, to the next one."""
    return f"slice({lines}, a + 1, coalesce(get({starts}, j + 1), size({lines})) - a)"


_CUT = "CASE WHEN length(x) > size THEN transform(sequence(0, CAST(floor((length(x) - 1) / size) AS INT)), i -> substring(x, i * size + 1, size)) ELSE array(x) END"
_SENTENCES = _full(r"split(p, r'(?<=[.!?])\s+')")
_SEGMENTS = f"flatten(transform({_full("split(content, r'\\n\\n+')")}, p -> CASE WHEN length(p) > size THEN flatten(transform({_SENTENCES}, x -> {_CUT})) ELSE array(p) END))"
_PACKED = f"""aggregate({_SEGMENTS}, named_struct('chunks', CAST(array() AS ARRAY<STRING>), 'open', ''),
  (acc, x) -> {_let('done', _strip('acc.open'), '''CASE
    WHEN length(acc.open) > 0 AND length(acc.open) + 1 + length(x) > size
      THEN named_struct('chunks', concat(acc.chunks, array(done)), 'open', concat(CASE WHEN length(done) > overlap THEN substring(done, length(done) - overlap + 1, overlap) ELSE done END, ' ', x))
    WHEN length(acc.open) > 0 THEN named_struct('chunks', acc.chunks, 'open', concat(acc.open, ' ', x))
    ELSE named_struct('chunks', acc.chunks, 'open', x) END''')},
  acc -> CASE WHEN {_strip('acc.open')} <> '' THEN concat(acc.chunks, array({_strip('acc.open')})) ELSE acc.chunks END)"""

_LINES = r"filter(transform(split(content, r'\n'), x -> regexp_replace(x, r'\s+$', '')), x -> trim(x) <> '')"
_TURN = r"""concat('> ', array_join(transform(filter(t, x -> startswith(x, '>')), x -> regexp_replace(x, r'^>\s*', '')), ' '),
  CASE WHEN exists(t, x -> NOT startswith(x, '>')) THEN concat('\n\n', array_join(transform(slice(filter(t, x -> NOT startswith(x, '>')), 1, answers), x -> trim(x)), '\n')) ELSE '' END)"""
_EXCHANGES = _let("s", _LINES, _let("b", _places("s", "startswith(x, '>') AND NOT coalesce(startswith(get(s, i - 1), '>'), false)"), f"transform(transform(b, (a, j) -> {_slice('s', 'b')}), t -> {_TURN})"))

_STARTS = _places("s", "contains(lower(x), lower(marker)) AND NOT exists(slice(s, i + 2, ahead), l -> exists(negative, m -> contains(lower(l), lower(m))))")
_SESSIONS = _let("s", r"split(content, r'\n')", _let("b", _STARTS, f"flatten(transform(b, (a, j) -> transform({_slice('s', 'b')}, (l, k) -> named_struct('session', j, 'line_no', a + k, 'line', l))))"))

FUNCTIONS = {
    "chunks_of(content STRING, size INT, overlap INT)": ("ARRAY<STRING>", _PACKED),
    "exchanges_of(content STRING, answers INT)": ("ARRAY<STRING>", _EXCHANGES),
    "sessions_of(content STRING, marker STRING, negative ARRAY<STRING>, ahead INT)": ("ARRAY<STRUCT<session: INT, line_no: INT, line: STRING>>", _SESSIONS),
}


def register(spark: SparkSession) -> None:
    """Define the functions in this session; a second call changes nothing."""
    for signature, (returned, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {returned} RETURN {body}")
