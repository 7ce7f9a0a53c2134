"""Queries of the store's verbs, of evaluation files, of names and facts on adding."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as T
from ..operators import entities, evaluate, extract, kg, layers, sessions, store
from ..service.memory import Memory
from ..sources import datasets, transcripts as exports
from . import oracles
from .queries import CHUNKS, SQL, TRIPLES, chunks, query, scratch, table, transcripts, triples

BLANK = "' ' || chr(9) || chr(10) || chr(13)"


def _write(rows, folder: str) -> None:
    """rows (file_name, content), one file each."""
    sessions.write(rows.select("file_name", "content", F.col("file_name").alias("id"), F.lit(0).alias("session")), folder)


# mining

TOPIC_SQL = "CASE WHEN greatest({all}) = 0 THEN 'general' {each} END".format(
    all=", ".join(f"({oracles.contained('low', v)})" for v in C.TOPICS.values()),
    each=" ".join(f"WHEN ({oracles.contained('low', v)}) = greatest({', '.join(f'({oracles.contained('low', w)})' for w in C.TOPICS.values())}) THEN '{k}'" for k, v in C.TOPICS.items()))
NOTES = "chunks AS (SELECT 'd' || doc_id || '.md' AS id, text AS content FROM documents)"


@query(f"SELECT sha256('notes' || chr(10) || id || chr(10) || chunk_index) AS id, id AS source_file, chunk_index, content, {TOPIC_SQL} AS topic FROM (SELECT *, lower(content) AS low FROM ({oracles.chunk_text(NOTES)}))")
def mine_files(spark, sf):
    """Documents as files of a folder that is mined, grows, and is mined again."""
    m, folder = Memory(spark, scratch(spark)), scratch(spark)
    d = table(spark, sf, "documents").select(F.concat(F.lit("d"), "doc_id", F.lit(".md")).alias("file_name"), F.col("text").alias("content"), "doc_id").where("content IS NOT NULL")
    for part in (d.where("doc_id % 3 <> 0"), d.where("doc_id % 3 = 0")):
        _write(part, folder)
        m.mine(folder, "notes")
    return m.chunks("notes").select("id", "source_file", "chunk_index", "content", "topic")


@query(f"SELECT 't' || id || '.txt' AS source_file, chunk_index, content FROM ({SQL['convo_exchanges']})")
def mine_talks(spark, sf):
    """Transcripts as files, mined as conversations; the second time adds nothing."""
    m, folder = Memory(spark, scratch(spark)), scratch(spark)
    _write(transcripts(spark, sf).select(F.concat(F.lit("t"), "id", F.lit(".txt")).alias("file_name"), "content"), folder)
    for _ in range(2):
        m.mine(folder, mode="convos")
    return m.chunks("conversations").select("source_file", "chunk_index", "content")


@query("SELECT '[' || day || '] [count]' || chr(10) || 'documents: ' || count(*) AS content, day AS filed_at FROM (SELECT '2024-01-' || lpad((doc_id % 12 + 1)::VARCHAR, 2, '0') AS day FROM documents) GROUP BY day ORDER BY day DESC LIMIT 10")
def agent_log(spark, sf):
    """Twelve entries of an agent's log, each a write of its own; the newest ten."""
    m, d = Memory(spark, scratch(spark)), table(spark, sf, "documents")
    for i in range(12):
        entry = d.where(F.col("doc_id") % 12 == i).agg(F.concat(F.lit("documents: "), F.count("*")).alias("entry"), F.lit("count").alias("topic"))
        m.append("chunks", store.log_write("scribe", entry, f"2024-01-{i + 1:02}"))
    return store.log_read(m.chunks(), "scribe").select("content", "filed_at")


_ONE = CHUNKS.replace("FROM documents))", "FROM documents WHERE source = 'src0'))")


@query(f"""SELECT '[L0 IDENTITY]' || chr(10) || 'I keep notes.' || '{layers.RULE}' || (SELECT text FROM ({oracles.story(_ONE)})) || '{layers.RULE}' ||
(WITH {_ONE} SELECT '[L2 ON-DEMAND: src0/*]' || chr(10) || string_agg(CASE WHEN length(content) > 200 THEN substr(content, 1, 200) || '…' ELSE content END, chr(10) ORDER BY filed_at DESC, id) || chr(10) FROM (SELECT * FROM chunks ORDER BY filed_at DESC, id LIMIT 10)) AS text""")
def wake_up(spark, sf):
    """The first three layers of a store's domain as one text."""
    m = Memory(spark, scratch(spark), identity="I keep notes.")
    m.add(chunks(spark, sf))
    return spark.createDataFrame([(m.wake_up("src0"),)], "text string")


# evaluation files

TALKS = f"""t AS (SELECT *, conv_id % 4 AS shape, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, first_value(text) OVER (PARTITION BY conv_id ORDER BY turn) AS opening FROM conversations),
full_t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n FROM t WHERE CASE WHEN shape = 3 THEN trim(text, {BLANK}) <> '' ELSE text <> '' END),
rows AS (SELECT conv_id, 'c' || conv_id || '_talk_1' AS item_id, 'c' || conv_id || '_talk_1_g' || pos AS id, CASE WHEN role = 'user' THEN '[User] ' || coalesce(text, '') || ' [Assistant] ' ELSE '[User]  [Assistant] ' || coalesce(text, '') END AS content, 'turn' AS role,
    'somebody' AS answer, 'c' || conv_id || '_talk_1_g0' AS targets, '' AS evidence FROM t WHERE shape = 0
  UNION ALL SELECT conv_id, 'c' || conv_id || '_' || conv_id, 'c' || conv_id || '_' || conv_id || '_' || n, text, 'message', '', '', coalesce(opening, '') FROM full_t WHERE shape = 1
  UNION ALL SELECT conv_id, 's' || conv_id, 's' || conv_id || '_' || pos, trim('[' || role || '] ' || text, {BLANK}), 'turn', 'somebody', 's' || conv_id || '_0', '' FROM full_t WHERE shape = 2
  UNION ALL SELECT conv_id, 'c' || conv_id || '_0', 'c' || conv_id || '_0_' || n, '[' || role || '] ' || text, role, 'somebody', CASE WHEN conv_id % 8 = 3 THEN 'c' || conv_id || '_0_0' ELSE '' END, CASE WHEN conv_id % 8 = 3 THEN '' ELSE 'somebody' END FROM full_t WHERE shape = 3)"""


@query(f"WITH {TALKS} SELECT item_id, id, content, role, 'Who spoke in talk ' || conv_id || '?' AS query, answer, targets, evidence FROM rows")
def eval_files(spark, sf):
    """Conversations as evaluation files of the four shapes, a file each, read back."""
    t = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    n, texts = F.col("conv_id"), F.transform("t", lambda x: x["text"])
    ask, answer = F.concat(F.lit("Who spoke in talk "), n, F.lit("?")).alias("question"), F.lit("somebody")
    said = lambda who, text: F.transform("t", lambda x: F.struct(x["role"].alias(who), x["text"].alias(text)))
    message = lambda x: F.struct(F.when(x["role"] == "user", x["text"]).alias("user"), F.when(x["role"] != "user", x["text"]).alias("assistant"))
    forms = {
        "turns": F.struct(F.array(F.struct(F.lit(1).alias("tid"), F.transform("t", message).alias("message_list"), F.struct(ask, answer.alias("ground_truth"), F.array(F.array(F.lit(0))).alias("target_step_id")).alias("QA"))).alias("talk")),
        "messages": F.struct(n.alias("id"), ask, texts.alias("messages"), F.slice(texts, 1, 1).alias("evidence_messages")),
        "dialogue": F.create_map(F.concat(F.lit("s"), n), F.struct(said("speaker", "text").alias("dialogue"), F.array(F.struct(ask, F.array(answer).alias("answers"), F.array(F.lit(0)).alias("evidence_utterance_ids"))).alias("qa"))),
        "long": F.array(F.struct(said("role", "content").alias("session"), ask, answer.alias("answer"), F.when(n % 8 == 3, F.array(F.lit(0))).alias("evidence_session_ids"))),
    }
    folder, out = scratch(spark), None
    for i, (shape, form) in enumerate(forms.items()):
        _write(t.where(n % 4 == i).select(F.concat(F.lit("c"), n, F.lit(".json")).alias("file_name"), F.to_json(form).alias("content")), f"{folder}/{shape}")
        corpus, asked = datasets.read(spark, f"{folder}/{shape}", shape)
        rows = corpus.join(asked, "item_id").select("item_id", "id", "content", "role", "query", "answer", F.array_join("targets", ",").alias("targets"), F.array_join("evidence", ",").alias("evidence"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _evidence_sql() -> str:
    """The evaluation's SQL where a hit holds the opening words and the asked word is a name."""
    names = oracles.quoted([w.lower() for w in C.NOT_NAMES])
    sql = oracles.EVALUATION.replace("lambda w: NOT list_contains([", f"lambda w: (NOT regexp_matches(w, '^[a-z]{{3,16}}$') OR list_contains([{names}], w)) AND NOT list_contains([", 1)
    sql = sql.replace("SELECT item, arg_min(id, turn) AS target,", "SELECT item, arg_min(lower(left(text, 30)), turn) AS target,", 1)
    return sql.replace("bool_or(f.id = q.target)", "bool_or(contains(s.low, q.target))", 1).replace("f.n <= 5 GROUP BY", "f.n <= 5 LEFT JOIN shown s ON s.item = f.item AND s.id = f.id GROUP BY", 1)


@query(_evidence_sql())
def eval_evidence(spark, sf):
    """Each conversation is asked for the longest word of its first turn as a
    name; what is to be found are the first 30 characters of that turn."""
    c = table(spark, sf, "conversations").where("text IS NOT NULL").select(F.col("conv_id").cast("string").alias("item_id"), F.concat_ws("_", "conv_id", "turn").alias("id"), F.col("text").alias("content"), "role", "turn")
    first = c.groupBy("item_id").agg(F.min_by("content", "turn").alias("f"))
    word = F.array_max(F.transform(T.tokens(F.col("f")), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    q = first.select(F.col("item_id").alias("query_id"), "item_id", F.lit("all").alias("category"), T.capital(word).alias("query"), F.array().cast("array<string>").alias("targets"), F.array(F.substring("f", 1, 30)).alias("evidence"))
    return evaluate.summary(evaluate.run(c, q))


# names and facts

_HEAD = "^[^A-Za-z]*([A-Za-z]+)"


def _heads(spark, sf, n: int):
    d = table(spark, sf, "documents").where(F.col("doc_id") % 50 == n)
    return d.select(F.regexp_extract("text", _HEAD, 1).alias("name")).where("name <> ''").groupBy(F.lower("name").alias("k")).agg(F.min("name").alias("name")).select("name")


@query("WITH w AS (SELECT doc_id, regexp_extract(text, '" + _HEAD + "', 1) AS word, lower(text) AS low FROM documents), " + ", ".join(f"h{n} AS (SELECT DISTINCT lower(word) AS k FROM w WHERE doc_id % 50 = {n} AND word <> '')" for n in range(3)) + """,
x AS (SELECT doc_id, word, lower(word) IN (FROM h0) AS p, lower(word) IN (FROM h1) AS j, lower(word) IN (FROM h2) AS a, contains(low, ' en') OR contains(low, ' und') AS said FROM w)
SELECT doc_id, word, CASE WHEN p THEN 'person' WHEN j THEN 'project' WHEN a AND said THEN 'person' WHEN a THEN 'common' ELSE 'unknown' END AS entity_type,
  CASE WHEN p THEN 0.95 WHEN j THEN 0.9 WHEN a AND said THEN 0.6 WHEN a THEN 0.8 ELSE 0 END::DOUBLE AS confidence FROM x""")
def registry_lookup(spark, sf):
    """The first word of each document, looked up among people, projects and
    ambiguous words, which are how every fiftieth document begins."""
    words = table(spark, sf, "documents").select("doc_id", F.regexp_extract("text", _HEAD, 1).alias("word"), F.col("text").alias("context"))
    people, projects, ambiguous = (_heads(spark, sf, n) for n in range(3))
    return extract.lookup(words, people.withColumn("confidence", F.lit(0.95)), projects, ambiguous, [" en", " und"]).select("doc_id", "word", "entity_type", "confidence")


@query(f"SELECT id, entity_type, list(name ORDER BY count DESC, name) AS names FROM ({oracles.classes(CHUNKS)}) GROUP BY id, entity_type")
def names_detected(spark, sf):
    return entities.detect(chunks(spark, sf).select("id", "content"))


@query(f"SELECT id, name, count, least(0.5 + count * 0.05, 1)::DOUBLE AS confidence FROM ({oracles.classes(CHUNKS)}) WHERE entity_type = 'person' AND 0.5 + count * 0.05 >= 0.65 AND lower(name) NOT IN (SELECT lower(regexp_extract(text, '{_HEAD}', 1)) FROM documents WHERE doc_id % 50 = 0)")
def people_learned(spark, sf):
    return entities.learn(chunks(spark, sf).select("id", "content"), _heads(spark, sf, 0), 0.65)


_NAME = "p_name || ' ' || p_brand"
_ID = f"replace(replace(replace(lower({_NAME}), ' ', '_'), '''', ''), '-', '_')"


@query(f"SELECT id, name, entity_type, properties FROM (SELECT {_ID} AS id, {_NAME} AS name, p_type AS entity_type, p_brand AS properties, row_number() OVER (PARTITION BY {_ID} ORDER BY p_partkey) AS n FROM part) WHERE n = 1 AND id NOT IN (SELECT {_ID} FROM part WHERE p_partkey % 3 = 0)")
def entities_added(spark, sf):
    """Parts as new entities, beside those whose key is divisible by 3."""
    p = table(spark, sf, "part").select(F.concat_ws(" ", "p_name", "p_brand").alias("name"), F.col("p_type").alias("entity_type"), F.col("p_brand").alias("properties"), F.col("p_partkey").alias("seq"))
    return kg.add_entities(p.where("seq % 3 = 0").select(T.entity_id(F.col("name")).alias("id")), p)


@query(f"""WITH {TRIPLES}, held AS (SELECT * FROM triples WHERE event_id % 2 = 0 AND valid_to IS NULL), fresh AS (SELECT *, row_number() OVER (PARTITION BY subject, predicate, object ORDER BY event_id) AS n FROM triples WHERE valid_to IS NULL)
SELECT subject, predicate, object, valid_from, valid_to FROM fresh ANTI JOIN held USING (subject, predicate, object) WHERE n = 1 UNION ALL SELECT subject, predicate, object, valid_from, valid_to FROM triples WHERE valid_to IS NOT NULL""")
def facts_added(spark, sf):
    """All facts added to a graph that holds every second one, under names in other letters."""
    t = triples(spark, sf)
    new = t.select(F.concat(F.lit("User "), F.substring("subject", 6, 20)).alias("subject"), "predicate", F.upper("object").alias("object"), "valid_from", "valid_to", F.col("event_id").alias("seq"))
    return kg.add_triples(t.where("event_id % 2 = 0"), new).select("subject", "predicate", "object", "valid_from", "valid_to")


# forms of texts

@query("""SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ') AS plain, replace(lower(source || ' Room ' || lang), ' ', '-') AS room, source || '=' || lang || ';' || lang || '=;:' || source || '=' AS people,
  CASE WHEN doc_id % 3 = 2 THEN NULL ELSE strftime(DATE '2024-01-01' + (doc_id % 300)::INT, '%Y-%m-%d') END AS date FROM documents""")
def text_forms(spark, sf):
    """Whitespace, room names, lists of people and dates in two forms."""
    d, n = table(spark, sf, "documents"), F.col("doc_id")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (n % 300).cast("int"))
    stamp = F.when(n % 3 == 0, F.date_format(day, "yyyy-MM-dd'T'HH:mm")).when(n % 3 == 1, F.date_format(day, "M/d/yyyy")).otherwise("no date")
    people = entities.parse_people(F.concat("source", F.lit(": "), "lang", F.lit(", "), "lang", F.lit(" ,,:"), "source"))
    return d.select("doc_id", T.normalize_whitespace(F.col("text")).alias("plain"), T.room_name(F.concat("source", F.lit(" Room "), "lang")).alias("room"),
                    F.array_join(F.transform(people, lambda p: F.concat(p["name"], F.lit("="), p["relationship"])), ";").alias("people"), T.timestamp_date(stamp).alias("date"))


@query(f"SELECT conv_id AS id, string_agg(CASE WHEN role = 'user' THEN '> ' ELSE '' END || trim(text, {BLANK}), chr(10) || chr(10) ORDER BY turn) AS content FROM conversations WHERE trim(text, {BLANK}) <> '' AND role IN ('user', 'assistant') GROUP BY conv_id")
def norm_lines(spark, sf):
    """Conversations as JSON lines that only their content tells."""
    t = table(spark, sf, "conversations").where("role IN ('user', 'assistant')").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    lines = F.array_join(F.transform("t", lambda x: F.to_json(F.struct(x["role"].alias("type"), F.struct(x["text"].alias("content")).alias("message")))), "\n")
    path = F.when(F.size("t") < 2, "one.jsonl").otherwise("notes.txt")  # a single line is told by its name
    return exports.transcripts(t.select(F.col("conv_id").alias("id"), path.alias("path"), lines.alias("content"))).select("id", "content")
