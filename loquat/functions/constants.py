"""Fixed values of the rule-based operators; all are defaults of parameters."""

# Topic keywords, in tie-break order.
TOPICS = {
    "technical": "code, python, function, bug, error, api, database, server, deploy, git, test, debug, refactor, implement, algorithm, performance, cache, query, endpoint, async",
    "architecture": "architecture, design, pattern, structure, schema, interface, module, component, service, layer, dependency, abstraction, coupling, separation, system",
    "planning": "plan, roadmap, milestone, deadline, priority, sprint, backlog, scope, requirement, spec, timeline, goal, objective, strategy, estimate",
    "decisions": "decided, chose, picked, switched, migrated, replaced, trade-off, alternative, option, approach, selected, went with, choose, choosing",
    "problems": "problem, issue, broken, failed, crash, stuck, workaround, fix, solved, resolved, error, exception, trouble, difficult, blocker",
}
TOPICS = {k: v.split(", ") for k, v in TOPICS.items()}
CATEGORIES = {"decisions": "cat_decisions", "planning": "cat_planning", "architecture": "cat_events", "technical": "cat_facts", "problems": "cat_facts"}

# Words that duplicate keywords leave out.
DUPLICATE_STOP = "about, after, also, been, could, does, each, from, have, here, into, just, like, more, most, other, over, should, some, such, than, that, their, them, then, there, these, they, this, those, through, under, very, well, were, what, when, where, which, while, will, with, would, your".split(", ")
# Words that summary topics leave out.
TOPIC_STOP = "a, an, the, and, or, but, in, on, at, to, for, of, with, by, is, are, was, were, be, been, being, have, has, had, do, does, did, will, would, could, should, may, might, shall, can, i, you, he, she, it, we, they, me, him, her, us, them, my, your, his, its, our, their, this, that, these, those, not, no, nor, so, yet, as, if, then, than, because, while, about, after, before, between, during, from, into, through, under, until".split(", ")
# Words that evaluation keywords leave out.
EVALUATION_STOP = "what, when, where, who, how, which, did, do, was, were, have, has, had, is, are, the, a, an, my, me, i, you, your, their, it, its, in, on, at, to, for, of, with, by, from, ago, last, that, this, there, about, get, got, give, gave, buy, bought, made, make, said, would, could, should, might, can, will, shall, kind, type, like, prefer, enjoy, think, feel".split(", ")
NOT_NAMES = "What, When, Where, Who, How, Which, Did, Do, Was, Were, Have, Has, Had, Is, Are, The, My, Our, I, It, Its, This, That, These, Those".split(", ")
# Capitalised words that are no entity candidates.
NOT_ENTITIES = "The, This, That, These, Those, There, Their, They, When, Where, What, Which, Who, Why, How, And, But, For, Not, All, Any, Each, Few, More, Most, Other, Some, Such, Into, Over, After, Before, Since, Just, Only, Also, Very, Well, Even, Still, While, Then, Than, With, From, About, Through, During, Including, Until, Against, Among, Throughout, Despite, Towards, Upon, Monday, Tuesday, Wednesday, Thursday, Friday, Saturday, Sunday, January, February, March, April, May, June, July, August, September, October, November, December, True, False, None, Null, String, Integer, Boolean, Object, Array, List, Section, Chapter, Table, Figure, Note, Example, Version, Update, New, Old, First, Second, Third, Last, Next, Previous, Current, Default, He, She, It, We, You, I, A, An, If, Or, So, As, At, By, Do, Go, In, Is, Be, Up, No, On, To, Of, Our, Its, His, Her, Was, Has, Had, Did, Are, Can, May, Let, Get, Got, Use, See, Put, Set, Try, Run, Add, However, Therefore, Although, Because, Whether, Between, Without, Within, Along, Below, Above".split(", ")

# Memory marker families, in tie-break order.
MEMORY_MARKERS = {
    "decision": [r"\bwe (decided|chose|picked|selected|went with|opted for)\b", r"\b(decided|choosing) to\b", r"\bthe decision (is|was|to)\b", r"\blet's go with\b", r"\binstead of\b.*\bwe\b"],
    "preference": [r"\b(always|never) use\b", r"\bi (prefer|like|love|hate|dislike)\b", r"\bwe (should always|should never|prefer|avoid)\b", r"\bthe (right|correct|best|proper) way\b", r"\bdon't use\b"],
    "milestone": [r"\b(finally|successfully|managed to)\b", r"\b(breakthrough|milestone|shipped|launched|deployed|released)\b", r"\bit (works|worked|is working)\b", r"\bwe (finished|completed|done with|wrapped up)\b", r"\bgot it (working|running|fixed)\b"],
    "problem": [r"\b(bug|crash|error|exception|issue|problem|failure)\b", r"\b(broken|failing|doesn't work|not working|fails)\b", r"\bstuck (on|with|at)\b", r"\bcan't (figure out|get|make)\b", r"\b(segfault|stacktrace|traceback|panic)\b"],
    "emotional": [r"\b(feel|feeling|felt)\b.*\b(happy|sad|frustrated|excited|anxious|proud|disappointed|overwhelmed)\b", r"\b(really hard|very difficult|super challenging)\b", r"\b(love|hate) (this|working|doing|that)\b", r"\b(miss|missing)\b.*\b(you|them|home|family)\b", r"\b(grateful|thankful|appreciate)\b"],
}
CODE_WORDS = ["import", "def", "class", "var", "let", "const", "function"]

# Summary flags, emotion signals and codes, decision phrases.
FLAGS = {
    "ORIGIN": "first time, originally, started, beginning, genesis, founded", "CORE": "always, fundamental, core, essential, critical, central, key",
    "SENSITIVE": "private, personal, sensitive, confidential, secret, don't share", "PIVOT": "changed, pivot, shift, transition, turning point, switched",
    "GENESIS": "created, built, launched, started, initiated, began", "DECISION": "decided, chose, selected, picked, went with, opted",
    "TECHNICAL": "code, function, api, database, server, deploy, bug",
}
EMOTIONS = {
    "joy": "happy, excited, great, wonderful, amazing, fantastic, love", "sadness": "sad, miss, lost, grief, sorry, unfortunately, regret",
    "fear": "afraid, scared, worried, anxious, nervous, panic, fear", "anger": "angry, frustrated, annoyed, irritated, furious, upset",
    "vulnerability": "vulnerable, exposed, open, honest, admit, struggle", "determination": "determined, committed, will, must, need to, going to",
    "pride": "proud, accomplished, achieved, success, nailed, pulled off", "hope": "hope, optimistic, looking forward, hopefully, believe",
    "overwhelm": "overwhelmed, too much, can't handle, swamped, drowning", "gratitude": "grateful, thankful, appreciate, thanks, thank you",
}
EMOTION_CODES = {
    "vulnerability": "vul", "joy": "joy", "fear": "fea", "anger": "ang", "sadness": "sad", "disgust": "dsg", "surprise": "sur", "anticipation": "ant",
    "trust": "tru", "love": "lov", "excitement": "exc", "anxiety": "anx", "frustration": "fru", "relief": "rel", "pride": "prd", "shame": "shm",
    "guilt": "glt", "envy": "env", "gratitude": "grt", "hope": "hop", "nostalgia": "nos", "loneliness": "lon", "confusion": "cnf", "determination": "det",
    "curiosity": "cur", "regret": "rgt", "empathy": "emp", "overwhelm": "ovw", "boredom": "bor", "awe": "awe",
}
FLAGS, EMOTIONS = ({k: v.split(", ") for k, v in t.items()} for t in (FLAGS, EMOTIONS))
DECISION_PHRASES = ["decided", "chose", "because", "so that", "in order to"]

# What a project scan skips and takes.
SKIP_DIRS = ".git, node_modules, __pycache__, bin, obj, .vs, dist, build, .next, vendor, .pytest_cache, .mypy_cache, .ruff_cache, .tox, .eggs, *.egg-info, .idea, .vscode, coverage, .coverage".split(", ")
DENY_EXTENSIONS = ".exe, .dll, .pdb, .png, .jpg, .jpeg, .gif, .svg, .ico, .woff, .woff2, .ttf, .eot, .zip, .tar, .gz, .pdf, .db, .sqlite, .sqlite3".split(", ")
ALLOW_EXTENSIONS = ".txt, .md, .rst, .py, .cs, .js, .ts, .jsx, .tsx, .java, .go, .rs, .cpp, .c, .h, .rb, .php, .html, .css, .scss, .json, .yaml, .yml, .toml, .xml, .sh, .bash, .ps1, .sql, .csv, .tsv, .log, .ini, .cfg, .env".split(", ")
CONVERSATION_EXTENSIONS = [".txt", ".md", ".json", ".jsonl"]

# Ranking and assembly.
K1, B, IDF_FLOOR, RRF_K, DEPTH = 1.2, 0.75, 1e-6, 60, 3
LAYER_CHARS, LAYER_CHUNKS = 3200, 15

# Signs that a name is a person's or a project's; {n} stands for the name.
PERSON_SIGNS = {
    "dialogue": (3, [r"\b{n} (said|asked|told|replied)\b"]),
    "verbs": (2, [r"\b{n} (went|came|got|had|was|is|has|did|made|felt)\b"]),
    "address": (4, [r"\b(hi|hey|dear) {n}\b"]),
}
PROJECT_SIGNS = {
    "versioned": (3, [r"\b{n} (version|v[0-9]|v [0-9])\b"]),
    "code": (2, [r"\b(using|import|require|install)\s+{n}\b"]),
    "files": (3, [r"{n}\.(py|js|ts|rs|go|java|cs|cpp|rb|sh)\b"]),
    "nouns": (2, [r"\b(project|repo|library|framework|package|tool|app)\s+{n}\b"]),
}
PRONOUNS = ["he", "she", "him", "her", "his", "hers", "they", "them"]
# Names that are common words too, and words of a context that speaks of a person.
COMMON_WORDS = "ever, grace, will, bill, mark, april, may, june, dawn, faith, hope, joy, pat, iris, violet, crystal, amber, ruby, jade, rose, lily, ivy, sage, ash, cliff, glen, gene, rich, frank, earnest, hunter, chase, reed, clay, wade, brock, lance, ace, leo, rex, max, jack, john, james, mike, adam, alan".split(", ")
PERSON_CONTEXT = ["said", "asked", "told", "replied", "went", "came", "got", "had", "was", "is", "has", "did", "made", "felt", "hi ", "hey ", "dear "]
PROSE_EXTENSIONS = [".txt", ".md", ".rst", ".csv"]

# Lines that open a session, lines that tell of an earlier one, words that are no speakers.
SESSION_MARKER = "claude code"
SESSION_NEGATIVES = ["ctrl+e", "previous messages", "continuing from"]
NOT_SPEAKERS = ["The", "A", "An", "I", "You", "He", "She", "We", "They", "This", "That", "Claude", "User", "Human", "Assistant"]
