"""SQL of the longer queries, as texts that take the common table of chunks."""

from __future__ import annotations

from ..functions import constants as C

NEWLINE, MARK = "chr(10)", "chr(1)"


def quoted(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def contained(column: str, words: list[str]) -> str:
    """Number of the words that a column holds."""
    return " + ".join(f"contains({column}, {quoted([w])})::INT" for w in words)


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


# `\b` is a bound of ASCII words in this dialect, so other letters are made word characters first
ASCII = "regexp_replace(content, '[À-ÖØ-öø-ɏ]', '_', 'g')"

CANDIDATES = f"""plain AS (SELECT id, {ASCII} AS t FROM chunks),
runs AS (SELECT id, unnest(regexp_extract_all(t, '\\b[A-Z][a-z]+(?:\\s+[A-Z][a-z]+)+\\b')) AS name FROM plain),
parts AS (SELECT DISTINCT id, unnest(regexp_split_to_array(name, '\\s+')) AS name FROM runs),
words AS (SELECT id, unnest(regexp_extract_all(t, '\\b[A-Z][a-z]{{1,19}}\\b')) AS name FROM plain),
single AS (SELECT w.* FROM words w ANTI JOIN parts p ON w.id = p.id AND w.name = p.name WHERE w.name NOT IN ({quoted(C.NOT_ENTITIES)})),
candidates AS (SELECT id, name, count(*) AS count FROM (SELECT * FROM runs UNION ALL SELECT * FROM single) GROUP BY id, name HAVING count(*) >= 3)"""


def candidates(chunks: str) -> str:
    return f"WITH {chunks}, {CANDIDATES} SELECT id, name, count FROM candidates"


def points(signs: dict) -> list[str]:
    out = []
    for weight, patterns in signs.values():
        counts = []
        for p in patterns:
            before, after = p.split("{n}")
            counts.append(f"len(regexp_extract_all(x.t, '(?i){before}' || x.name || '{after}'))")
        out.append(f"{weight} * ({' + '.join(counts)})")
    return out


def classes(chunks: str) -> str:
    person = points(C.PERSON_SIGNS)
    near = "substr(low, greatest(spot - 50, 1), least(spot - 1, 50) + length(name) + 50)"
    return f"""WITH {chunks}, {CANDIDATES},
texts AS (SELECT c.id, c.name, c.count, p.t, lower(x.content) AS low FROM candidates c JOIN plain p ON p.id = c.id JOIN chunks x ON x.id = c.id),
pieces AS (SELECT id, name, low, unnest(string_split(low, lower(name))) AS piece, generate_subscripts(string_split(low, lower(name)), 1) AS n FROM texts),
places AS (SELECT id, name, low, n, (1 + sum(length(piece)) OVER w + (n - 1) * length(name))::BIGINT AS spot, count(*) OVER (PARTITION BY id, name) AS of FROM pieces WINDOW w AS (PARTITION BY id, name ORDER BY n)),
pronouns AS (SELECT id, name, 2 * least(3, sum({contained(near, C.PRONOUNS)}) FILTER (WHERE n < of)) AS points FROM places GROUP BY id, name),
signs AS (SELECT x.id, x.name, x.count, {person[0]} AS a, {person[1]} AS b, {person[2]} AS c, coalesce(p.points, 0) AS d, {' + '.join(points(C.PROJECT_SIGNS))} AS project_score
  FROM texts x JOIN pronouns p ON p.id = x.id AND p.name = x.name),
scores AS (SELECT id, name, count, project_score, a + b + c + d AS person_score, (a > 0)::INT + (b > 0)::INT + (c > 0)::INT + (d > 0)::INT AS signal_types FROM signs)
SELECT id, name, count, project_score::INT AS project_score, person_score::INT AS person_score, signal_types,
  CASE WHEN person_score >= 4 AND signal_types >= 2 THEN 'person' WHEN project_score >= 4 THEN 'project' WHEN person_score >= 2 AND count >= 5 THEN 'person' ELSE 'uncertain' END AS entity_type FROM scores"""


def packed(step: str) -> str:
    """A fold of a list of strings; what is closed and the open end are kept
    apart by a mark in one string."""
    return f"list_reduce(s, lambda acc, x: {step}, '')"


def last(acc: str = "acc") -> str:
    return f"string_split({acc}, {MARK})[-1]"


def chunk_text(chunks: str, size: int = 800, overlap: int = 100) -> str:
    sentences = f"list_filter(list_transform(string_split(regexp_replace(p, '([.!?])\\s+', '\\1' || {MARK}, 'g'), {MARK}), lambda x: {strip('x')}), lambda x: x <> '')"
    cut = f"CASE WHEN length(x) > {size} THEN list_transform(range(0, ((length(x) - 1) // {size} + 1)::BIGINT), lambda i: substr(x, i * {size} + 1, {size})) ELSE [x] END"
    done = strip(last())
    step = f"""CASE WHEN {last()} <> '' AND length({last()}) + 1 + length(x) > {size}
      THEN left(acc, length(acc) - length({last()})) || {done} || {MARK} || right({done}, {overlap}) || ' ' || x
      WHEN {last()} <> '' THEN acc || ' ' || x ELSE acc || x END"""
    return f"""WITH {chunks},
paras AS (SELECT id, list_filter(list_transform(regexp_split_to_array(content, '\\n\\n+'), lambda x: {strip('x')}), lambda x: x <> '') AS ps FROM chunks WHERE content IS NOT NULL),
segs AS (SELECT id, flatten(list_transform(ps, lambda p: CASE WHEN length(p) > {size} THEN flatten(list_transform({sentences}, lambda x: {cut})) ELSE [p] END)) AS s FROM paras),
folded AS (SELECT id, string_split({packed(step)}, {MARK}) AS out FROM segs WHERE len(s) > 0)
SELECT id, unnest(range(0, len(out)))::INT AS chunk_index, unnest(list_transform(out, lambda x: {strip('x')})) AS content FROM folded"""


def memories(chunks: str, size: int = 500, least: float = 0.3) -> str:
    indented = "(regexp_matches(l, '^[ \\t]') AND regexp_matches(l, '[=(){};]|//|#'))"
    sparse = "(length(l) > 10 AND length(regexp_replace(l, '\\P{L}+', '', 'g'))::DOUBLE / greatest(length(l), 1) < 0.4)"
    starts = "regexp_matches(l, '^\\s*(" + "|".join(C.CODE_WORDS) + ") ')"
    step = f"CASE WHEN x = '' THEN acc WHEN {last()} <> '' AND length({last()}) + length(x) + 2 > {size} THEN acc || {MARK} || x WHEN {last()} <> '' THEN acc || '. ' || x ELSE acc || x END"
    runs = f"list_transform(string_split(list_reduce(string_split(p, '. '), lambda acc, x: {step}, ''), {MARK}), lambda x: {strip('x')})"
    families = {k: " + ".join("len(regexp_extract_all(m, '(?i)" + p.replace("'", "''") + "'))" for p in v) for k, v in C.MEMORY_MARKERS.items()}
    plain = "regexp_replace(content, '[À-ÖØ-öø-ɏ]', '_', 'g')"
    scores = ", ".join(f"({v}) AS n_{k}" for k, v in families.items())
    ranked = ", ".join(f"n_{k} / (n_{k} + 2.0::DOUBLE) AS s_{k}" for k in families)
    top = "greatest(" + ", ".join(f"s_{k}" for k in families) + ")"
    kind = "CASE " + " ".join(f"WHEN s_{k} = confidence THEN '{k}'" for k in families) + " END"
    return f"""WITH {chunks},
clean AS (SELECT id, {strip(f"regexp_replace(array_to_string(list_transform(list_filter(string_split(content, {NEWLINE}), lambda l: NOT ({indented} OR {sparse} OR {starts})), lambda l: CASE WHEN regexp_matches(l, '[^ \\t\\n\\f\\r\\v]') THEN l ELSE '' END), {NEWLINE}), '\\n{{3,}}', {NEWLINE} || {NEWLINE}, 'g')")} AS t FROM chunks WHERE content IS NOT NULL),
paras AS (SELECT id, list_filter(list_transform(regexp_split_to_array(t, '\\r?\\n\\r?\\n'), lambda x: {strip('x')}), lambda x: x <> '') AS ps FROM clean),
segs AS (SELECT id, list_filter(flatten(list_transform(ps, lambda p: CASE WHEN length(p) > {size} THEN {runs} ELSE [p] END)), lambda x: x <> '') AS s FROM paras),
firsts AS (SELECT id, list_filter(s, lambda x, i: list_position(s, x) = i) AS s FROM segs WHERE len(s) > 0),
rows AS (SELECT id, unnest(range(0, len(s)))::INT AS chunk_index, unnest(s) AS content FROM firsts),
counts AS (SELECT id, chunk_index, content, {scores} FROM (SELECT *, {plain} AS m FROM rows)),
ranked AS (SELECT id, chunk_index, content, {ranked} FROM counts),
best AS (SELECT *, {top} AS confidence FROM ranked)
SELECT id, chunk_index, content, {kind} AS memory_type, confidence FROM best WHERE confidence >= {least}"""


def compress(chunks: str) -> str:
    codes = lambda table, names: "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {contained('low', v)} > 0 THEN '{names.get(k, k)}' END" for k, v in table.items()) + "], lambda x: x IS NOT NULL), '+')"
    return f"""WITH {chunks},
words AS (SELECT id, unnest(regexp_extract_all(content, '[\\p{{L}}\\p{{N}}\\p{{M}}_]+')) AS word, generate_subscripts(regexp_extract_all(content, '[\\p{{L}}\\p{{N}}\\p{{M}}_]+'), 1) AS pos FROM chunks),
keyed AS (SELECT id, lower(word) AS key, sum(1 + 2 * regexp_matches(word, '^\\p{{Lu}}')::INT) AS points, min(pos) AS first FROM words WHERE length(word) > 3 AND lower(word) NOT IN ({quoted(C.TOPIC_STOP)}) GROUP BY id, lower(word)),
places AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY points DESC, first) AS n FROM keyed),
topics AS (SELECT id, string_agg(key, '+' ORDER BY n) AS topics FROM places WHERE n <= 3 GROUP BY id),
lists AS (SELECT id, string_split(regexp_replace(content, '([.!?])\\s+', '\\1' || {MARK}, 'g'), {MARK}) AS s FROM chunks),
sentences AS (SELECT id, trim(unnest(s)) AS x, generate_subscripts(s, 1) AS i FROM lists),
hits AS (SELECT id, x, i, {contained('lower(x)', C.DECISION_PHRASES)} AS n FROM sentences WHERE x <> ''),
keys AS (SELECT id, arg_max(x, (n, -i)) AS x FROM hits GROUP BY id),
fields AS (SELECT id, {codes(C.EMOTIONS, C.EMOTION_CODES)} AS e, {codes(C.FLAGS, {})} AS f FROM (SELECT id, lower(content) AS low FROM chunks))
SELECT f.id, coalesce(t.topics, '') || '|' || coalesce(CASE WHEN length(k.x) > 55 THEN left(k.x, 55) || '…' ELSE k.x END, '') || '|' || f.e || '|' || f.f AS summary
FROM fields f LEFT JOIN topics t ON t.id = f.id LEFT JOIN keys k ON k.id = f.id"""


def story(chunks: str) -> str:
    return f"""WITH {chunks}, newest AS (SELECT * FROM chunks ORDER BY filed_at DESC, id LIMIT {C.LAYER_CHUNKS}),
ranked AS (SELECT *, lower(topic) AS key, row_number() OVER (PARTITION BY lower(topic) ORDER BY filed_at DESC, id DESC) AS n, count(*) OVER (PARTITION BY lower(topic)) AS size FROM newest),
groups AS (SELECT key, any_value(size) AS size, max(filed_at) AS since, arg_min(topic, n) AS title FROM ranked GROUP BY key),
parts AS (SELECT g.size, g.since, g.key, 0 AS n, {NEWLINE} || '## ' || g.title || {NEWLINE} AS part FROM groups g
  UNION ALL SELECT g.size, g.since, g.key, r.n, CASE WHEN length(r.content) > 200 THEN left(r.content, 200) || '…' ELSE r.content END || {NEWLINE} FROM ranked r JOIN groups g ON g.key = r.key WHERE r.n <= 2),
listed AS (SELECT list(part ORDER BY size DESC, since DESC, key DESC, n) AS s FROM parts)
SELECT left(list_reduce(s, lambda acc, x: CASE WHEN length(acc) >= {C.LAYER_CHARS} THEN acc ELSE acc || x END, '[L1 ESSENTIAL STORY]' || {NEWLINE}), {C.LAYER_CHARS}) AS text FROM listed"""


TOKENS = "regexp_extract_all(lower(strip_accents({})), '[\\p{{L}}\\p{{N}}]+')"

EVALUATION = f"""WITH c AS (SELECT conv_id::VARCHAR AS item, conv_id || '_' || turn AS id, text, role, turn FROM conversations WHERE text IS NOT NULL),
asked AS (SELECT item, arg_min(id, turn) AS target, arg_min({TOKENS.format('text')}, turn) AS ts FROM c GROUP BY item),
q AS (SELECT item, target, list_max(list_transform(ts, lambda w: {{'n': length(w), 'w': w}})).w AS word FROM asked),
cols AS ({" UNION ALL ".join(f"SELECT item, id, {TOKENS.format(x)} AS t FROM c" for x in ("text", "item", "role", "id"))}),
size AS (SELECT item, id, sum(len(t)) AS len FROM cols GROUP BY item, id),
corpus AS (SELECT item, count(*) AS docs, avg(len) AS mean FROM size GROUP BY item),
f AS (SELECT s.item, s.id, count(*) AS f FROM (SELECT item, id, unnest(t) AS token FROM cols) s JOIN q ON q.item = s.item AND q.word = s.token GROUP BY s.item, s.id),
df AS (SELECT item, count(*) AS df FROM f GROUP BY item),
scored AS (SELECT item, id, CASE WHEN ln((docs - df + 0.5) / (df + 0.5)) > 0 THEN ln((docs - df + 0.5) / (df + 0.5)) ELSE 1e-6 END * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / mean)) AS score FROM f JOIN df USING (item) JOIN size USING (item, id) JOIN corpus USING (item)),
first AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY round(score, 9) DESC, id) AS n FROM scored),
shown AS (SELECT item, id, lower(CASE WHEN length(text) > 200 THEN left(text, 200) || '…' ELSE text END) AS low FROM c),
keys AS (SELECT item, list_filter(regexp_extract_all(word, '\\b[a-z]{{3,}}\\b'), lambda w: NOT list_contains([{quoted(C.EVALUATION_STOP)}], w)) AS ks FROM q),
again AS (SELECT f.item, f.id, score * (1 + 0.5 * CASE WHEN len(ks) = 0 THEN 0 ELSE len(list_filter(ks, lambda k: contains(low, k)))::DOUBLE / len(ks) END) AS score FROM first f JOIN shown s ON s.item = f.item AND s.id = f.id JOIN keys k ON k.item = f.item WHERE n <= 15),
final AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY round(score, 9) DESC, id) AS n FROM again),
hits AS (SELECT q.item, coalesce(bool_or(f.id = q.target), false)::INT AS hit FROM q LEFT JOIN final f ON f.item = q.item AND f.n <= 5 GROUP BY q.item)
SELECT category, count(*) AS queries, sum(hit)::BIGINT AS hits, avg(hit) AS recall FROM (SELECT 'all' AS category, hit FROM hits) GROUP BY ROLLUP (category)"""

DUPLICATE_KEYS = """SELECT id AS query_id, string_agg(word, ' ' ORDER BY n) AS query FROM (
  SELECT id, word, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, min(pos)) AS n FROM (
    SELECT id, unnest(regexp_extract_all(lower(content), '[a-z]+')) AS word, generate_subscripts(regexp_extract_all(lower(content), '[a-z]+'), 1) AS pos FROM chunks WHERE doc_id % 50 = 0)
  WHERE length(word) > 4 AND word NOT IN (""" + quoted(C.DUPLICATE_STOP) + """) GROUP BY id, word) WHERE n <= 5 GROUP BY id"""
DUPLICATES = """, bags AS (SELECT id, list_distinct(regexp_extract_all(lower(content), '[a-z]+')) AS b FROM chunks),
pairs AS (SELECT query_id, r.id, len(list_intersect(a.b, o.b)) AS common, len(a.b) + len(o.b) AS both_sizes FROM ranked r JOIN bags a ON a.id = r.query_id JOIN bags o ON o.id = r.id WHERE rank <= 5)
SELECT query_id, id, CASE WHEN both_sizes = 0 THEN 1 ELSE common::DOUBLE / (both_sizes - common) END AS similarity FROM pairs WHERE CASE WHEN both_sizes = 0 THEN 1 ELSE common::DOUBLE / (both_sizes - common) END >= 0.9"""


def decoded(chunks: str) -> str:
    names = "MAP {" + ", ".join(f"'{v}': '{k}'" for k, v in C.EMOTION_CODES.items()) + "}"
    return f"""WITH summaries AS ({compress(chunks)}), {chunks},
parts AS (SELECT s.id, string_split(summary, '|') AS p, summary, content, domain FROM summaries s JOIN chunks c ON c.id = s.id)
SELECT id, trim(p[1]) AS topics, trim(p[2]) AS sentence, array_to_string(list_transform(list_filter(list_transform(string_split(p[3], '+'), lambda x: trim(x)), lambda x: x <> ''), lambda x: coalesce({names}[lower(x)], x)), ', ') AS emotions, trim(array_to_string(p[4:], '|')) AS flags,
  round(CASE WHEN length(content) = 0 THEN 0 ELSE (length(summary) + length('# domain: ') + length(domain) + 1)::DOUBLE / length(content) END, 6) AS ratio FROM parts"""
