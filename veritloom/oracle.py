"""SQL (for DuckDB) that gives the same rows as the registered queries."""

from __future__ import annotations

from .functions.text import TERM_STOPWORDS, VECTOR_STOPWORDS
from .operators.labels import BATCH_PROMPT, SINGLE_PROMPT
from .plans.projection import PERSPECTIVES
from .operators.validate import GUARD_PRONOUNS, LIGHT_WORDS, PRONOUNS


def _list(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


def _strip(x: str) -> str:
    return _STRIP.format(x)


def _words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '\\s+'), lambda w: w <> '')"


MARKED = """(SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda line, k:
    CASE WHEN (k - 1) % 7 = 5 THEN '# ' || line WHEN (k - 1) % 7 = 6 THEN '\"\"\"' || line || '\"\"\"'
         WHEN (k - 1) % 3 = 0 THEN '- ' || line WHEN (k - 1) % 3 = 1 THEN k::VARCHAR || '. ' || line ELSE line END), chr(10)) AS text FROM documents)"""

T1 = f"""SELECT doc_id, regexp_replace(regexp_replace(text, '\"\"\"[\\s\\S]*?\"\"\"|''''''''[\\s\\S]*?''''''''', '', 'g'), '(?m)^\\s*#.*$', '', 'g') AS filtered FROM {MARKED}"""

_SPLIT = """s AS (SELECT doc_id, text AS c, string_split_regex(text, '[.!?]+\\s+') AS g, regexp_extract_all(text, '[.!?]+\\s+') AS h FROM documents),
p AS (SELECT doc_id, c, g, h, unnest(range(1, len(g) + 1)) AS i FROM s),
q AS (SELECT doc_id, c, i, g[i] AS piece,
    coalesce(list_sum(list_transform(g[1:i-1], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(h[1:i-1], lambda x: length(x))), 0) AS pos0 FROM p),
r AS (SELECT doc_id, c, i, regexp_replace(piece, '^\\s+|\\s+$', '', 'g') AS unit, (pos0 + length(piece) - length(regexp_replace(piece, '^\\s+', '')))::BIGINT AS st FROM q)"""
UNITS = f"""{_SPLIT},
units AS (SELECT doc_id, c, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS ord, unit, st::BIGINT AS st, (st + length(unit))::BIGINT AS en FROM r WHERE length(unit) > 10)"""

T2 = f"""WITH {UNITS} SELECT doc_id, ord, unit, st AS start_pos, en AS end_pos,
    substring(c, greatest(st - 100, 0) + 1, en + 100 - greatest(st - 100, 0)) AS context FROM units"""

def _bullets(source: str) -> str:
    """Bulleted lines of ``source`` (doc_id, text), in order ``i``."""
    return f"""SELECT doc_id, i, {_strip("regexp_replace(ls[i], '^\\s*[-•*]\\s+', '')")} AS unit, (strpos(c, ls[i]) - 1)::BIGINT AS start_pos, (strpos(c, ls[i]) - 1 + length(ls[i]))::BIGINT AS end_pos,
    concat_ws(chr(10), CASE WHEN i > 1 THEN ls[i - 1] END, ls[i], ls[i + 1]) AS context
    FROM (SELECT doc_id, c, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, text AS c, string_split(text, chr(10)) AS ls FROM {source})) WHERE regexp_matches(ls[i], '^\\s*[-•*]\\s+')"""


_ITEM = "(?m)^\\s*\\d+\\.\\s+(.+)$"


def _numbered(source: str) -> str:
    """Numbered lines of ``source``, in order ``i``."""
    return f"""SELECT doc_id, i, unit, st AS start_pos, (st + n)::BIGINT AS end_pos, substring(c, greatest(st - 100, 0) + 1, st + n + 100 - greatest(st - 100, 0)) AS context
    FROM (SELECT doc_id, c, i, {_strip("t[i]")} AS unit, length(h[i]) AS n, (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i-1], lambda x: length(x))), 0))::BIGINT AS st
    FROM (SELECT *, unnest(range(1, len(h) + 1)) AS i FROM (SELECT doc_id, text AS c, string_split_regex(text, '{_ITEM}') AS g, regexp_extract_all(text, '{_ITEM}') AS h, regexp_extract_all(text, '{_ITEM}', 1) AS t FROM {source})))"""


def _parts(source: str) -> str:
    """CTEs that end in ``kept`` (doc_id, c, ord, unit, st, en, context): units of all three kinds without overlaps."""
    split = _SPLIT.replace("FROM documents", f"FROM {source}")
    return f"""{split}, every AS (SELECT doc_id, 0 AS kind, i, unit, start_pos AS st, end_pos AS en, context FROM ({_bullets(source)}) WHERE length(unit) > 10
    UNION ALL SELECT doc_id, 1, i, unit, start_pos, end_pos, context FROM ({_numbered(source)}) WHERE length(unit) > 10
    UNION ALL SELECT doc_id, 2, i, unit, st, st + length(unit), substring(c, greatest(st - 100, 0) + 1, st + length(unit) + 100 - greatest(st - 100, 0)) FROM r WHERE length(unit) > 10),
placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY st, en - st, kind, i) AS n FROM every),
folded AS (SELECT doc_id, list_reduce(list({{'last': en, 'st': st, 'out': [n]}} ORDER BY n), lambda a, x: CASE WHEN x.st < a.last THEN a ELSE {{'last': x.last, 'st': x.st, 'out': list_concat(a.out, x.out)}} END, {{'last': -1::BIGINT, 'st': 0::BIGINT, 'out': []::BIGINT[]}}) AS f FROM placed GROUP BY doc_id),
kept AS (SELECT p.doc_id, row_number() OVER (PARTITION BY p.doc_id ORDER BY n) - 1 AS ord, unit, st, en, context FROM placed p JOIN (SELECT doc_id, unnest(f.out) AS n FROM folded) USING (doc_id, n))"""


T3 = f"""WITH l AS (SELECT doc_id, text AS c, string_split(text, chr(10)) AS ls FROM {MARKED}),
p AS (SELECT doc_id, c, ls, unnest(range(1, len(ls) + 1)) AS i FROM l),
u AS (SELECT doc_id, i, {_strip("regexp_replace(ls[i], '^\\s*[-•*]\\s+', '')")} AS unit, (strpos(c, ls[i]) - 1)::BIGINT AS start_pos, (strpos(c, ls[i]) - 1 + length(ls[i]))::BIGINT AS end_pos,
    concat_ws(chr(10), CASE WHEN i > 1 THEN ls[i - 1] END, ls[i], ls[i + 1]) AS context FROM p WHERE regexp_matches(ls[i], '^\\s*[-•*]\\s+'))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS ord, unit, start_pos, end_pos, context FROM u WHERE length(unit) > 10"""

T4 = f"""WITH s AS (SELECT doc_id, text AS c, string_split_regex(text, '(?m)^\\s*\\d+\\.\\s+(.+)$') AS g, regexp_extract_all(text, '(?m)^\\s*\\d+\\.\\s+(.+)$') AS h, regexp_extract_all(text, '(?m)^\\s*\\d+\\.\\s+(.+)$', 1) AS t FROM {MARKED}),
p AS (SELECT doc_id, c, g, h, t, unnest(range(1, len(h) + 1)) AS i FROM s),
q AS (SELECT doc_id, c, i, {_strip("t[i]")} AS unit, length(h[i]) AS n, (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i-1], lambda x: length(x))), 0))::BIGINT AS st FROM p)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS ord, unit, st::BIGINT AS start_pos, (st + n)::BIGINT AS end_pos,
    substring(c, greatest(st - 100, 0) + 1, st + n + 100 - greatest(st - 100, 0)) AS context FROM q WHERE length(unit) > 10"""

T6 = f"""WITH {UNITS} SELECT doc_id, ord, unit, (strpos(c, unit) - 1)::BIGINT AS start_pos, (strpos(c, unit) - 1 + length(unit))::BIGINT AS end_pos FROM units"""
T8 = T6
T5 = f"WITH {_parts(MARKED)} SELECT doc_id, ord, unit, st AS start_pos, en AS end_pos, context FROM kept"
_CLEAN = f"(SELECT doc_id, filtered AS text FROM ({T1}))"
T8_MARKED = f"""WITH {_parts(_CLEAN)}, o AS (SELECT doc_id, text AS whole FROM {MARKED}), found AS (SELECT k.*, strpos(whole, unit) AS spot FROM kept k JOIN o USING (doc_id) WHERE strpos(whole, unit) > 0)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS ord, unit, (spot - 1)::BIGINT AS start_pos, (spot - 1 + length(unit))::BIGINT AS end_pos, context FROM found"""


def _hash(x: str) -> str:
    return f"substring(sha256(lower({_strip(x)})), 1, 16)"


TERMED = f"""{UNITS}, named AS (SELECT *, list_concat(list_filter(regexp_extract_all(unit, '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_matches(w, '^[A-Z][a-z]+$')),
    list_filter(regexp_extract_all(lower(unit), '[\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) > 6)) AS both_ FROM units),
termed AS (SELECT * EXCLUDE (both_), list_filter(list_filter(both_, lambda w, k: list_position(both_, w) = k), lambda w: lower(w) NOT IN {_list(TERM_STOPWORDS)})[1:5] AS terms FROM named)"""

T7 = f"WITH {TERMED} SELECT doc_id, ord, array_to_string(terms, '|') AS terms FROM termed"
T9 = f"WITH {UNITS} SELECT doc_id, ord, 'atomic_' || {_hash('unit')} AS node_id FROM units"
T10 = "SELECT doc_id, 'context_' || substring(sha256(text), 1, 16) AS node_id FROM documents"

_W = "[^\\p{L}\\p{N}_]"


def _first_word(x: str) -> str:
    return f"regexp_replace(({_words(f'lower({x})')})[1], '^[.,;:!?]+|[.,;:!?]+$', '', 'g')"


def _density(x: str) -> str:
    w = _words(f"lower({x})")
    return f"CASE WHEN len({w}) > 0 THEN len(list_filter({w}, lambda w: w IN {_list(PRONOUNS)})) / len({w}) ELSE 0.0 END"


def _several(x: str) -> str:
    gap = "[^\\p{L}\\p{N}_\\n]"
    return (
        f"(regexp_matches({x}, '(^|{_W})(and|or)({gap}|{gap}.*{gap})(and|or)($|{_W})') OR regexp_matches({x}, ';\\s*[\\p{{L}}\\p{{N}}_]+')"
        f" OR regexp_matches({x}, '\\.\\s+[\\p{{L}}\\p{{N}}_]+'))"
    )


def _embedded(x: str) -> str:
    gap = "[^\\p{L}\\p{N}_\\n]"
    return f"(regexp_matches(lower({x}), '(^|{_W})which($|{_W})') OR regexp_matches(lower({x}), '(^|{_W})that({gap}|{gap}.*{gap})and($|{_W})') OR regexp_matches(lower({x}), ',\\s*and($|{_W})'))"


def _sentences(x: str) -> str:
    return f"regexp_matches({x}, '[.!?]+\\s+[A-Z]')"


def _light(x: str) -> str:
    return f"len(list_filter({_words(f'lower({x})')}, lambda w: w NOT IN {_list(LIGHT_WORDS)})) < 3"


def _short(x: str) -> str:
    return f"length({_strip(x)}) < 10"


def _violations(x: str) -> str:
    return f"""list_filter([
    CASE WHEN len({_words(x)}) = 0 THEN 'Statement is empty' WHEN {_first_word(x)} IN {_list(PRONOUNS)} THEN 'Statement starts with dependency pronoun ''' || {_first_word(x)} || ''''
         WHEN {_density(x)} > 0.25 THEN 'High pronoun density suggests context dependency' END,
    CASE WHEN {_sentences(x)} THEN 'Statement contains multiple sentences' WHEN {_several(x)} THEN 'Statement contains multiple claims joined by conjunction'
         WHEN {_embedded(x)} THEN 'Statement may contain multiple embedded claims' END,
    CASE WHEN {_short(x)} THEN 'Statement too short to be meaningful' END,
    CASE WHEN {_light(x)} THEN 'Statement lacks sufficient semantic content' END], lambda v: v IS NOT NULL)"""


LINES = "lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS statement, unnest(range(0, len(string_split(text, chr(10))))) AS line FROM documents)"
V8 = f"WITH {UNITS} SELECT doc_id, ord, array_to_string({_violations('unit')}, '; ') AS reason FROM units"
V1 = f"WITH {UNITS} SELECT doc_id, ord FROM units WHERE {_first_word('unit')} IN {_list(PRONOUNS)}"
V2 = f"WITH {UNITS} SELECT doc_id, ord, {_density('unit')} AS density FROM units"
V3 = f"WITH {LINES} SELECT doc_id, line, {_sentences('statement')} AS hit FROM lines"
V4 = f"WITH {UNITS} SELECT doc_id, ord FROM units WHERE {_several('unit')}"
V5 = f"WITH {UNITS} SELECT doc_id, ord FROM units WHERE {_embedded('unit')}"
V6 = f"WITH {LINES} SELECT doc_id, line FROM lines WHERE {_short('statement')}"
V7 = f"WITH {UNITS} SELECT doc_id, ord FROM units WHERE {_light('unit')}"
V9 = f"WITH {UNITS} SELECT doc_id, ord, length(unit) >= 10 AND NOT coalesce(({_words('lower(unit)')})[1] IN {_list(GUARD_PRONOUNS)}, false) AS ok FROM units"
V10 = "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN coalesce(event_id % 3 <> 0 AND value / 100 BETWEEN 0 AND 1, false) ELSE event_id % 3 = 0 OR value IS NULL END AS ok FROM events"
V11 = "SELECT event_type, count(*) AS n, NOT regexp_matches(event_type, 'contains|has|includes|part_of') AS ok FROM events GROUP BY event_type"

T11 = f"""WITH {LINES}, x AS (SELECT doc_id, line, statement, len({_violations('statement')}) = 0 AS valid, string_split_regex(statement, '[.!?]+\\s+') AS g FROM lines),
y AS (SELECT *, list_transform(list_filter(list_transform(g, lambda s: {_strip('s')}), lambda s: s <> ''), lambda s: s || '.') AS repaired FROM x)
SELECT doc_id, line, CASE WHEN valid OR len(g) < 2 OR len(repaired) = 0 THEN statement ELSE array_to_string(repaired, '|') END AS repairs FROM y"""


def _labels(x: str) -> str:
    clean = f"list_filter(list_transform(string_split({x}, ','), lambda y: regexp_replace(regexp_replace(lower({_strip('y')}), '[\"''.;:!?]', '', 'g'), '\\s+', '-', 'g')), lambda y: length(y) > 1)"
    return f"(CASE WHEN len({clean}) = 0 THEN ['general'] ELSE {clean} END)[1:3]"


T12 = f"""WITH m AS (SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda line, i: CASE WHEN (i - 1) % 3 = 2 THEN line ELSE ((i - 1) % 5 + 1)::VARCHAR || ': ' || line END), chr(10)) AS reply FROM documents),
n AS (SELECT doc_id, reply, regexp_extract_all(reply, '(?m)^(\\d+):[ \\t]*(\\S.*)$', 1) AS ns, regexp_extract_all(reply, '(?m)^(\\d+):[ \\t]*(\\S.*)$', 2) AS ts FROM m),
k AS (SELECT doc_id, ns, ts, unnest(range(0, 6)) AS k FROM n),
f AS (SELECT doc_id, k, list_filter(ts, lambda t, i: ns[i] = (k + 1)::VARCHAR) AS mine FROM k)
SELECT doc_id, k, CASE WHEN len(mine) = 0 THEN 'general' ELSE array_to_string({_labels('mine[-1]')}, '|') END AS labels FROM f"""
T13 = f"WITH {UNITS} SELECT doc_id, ord, array_to_string({_labels('unit')}, '|') AS labels FROM units"
_PROMPT = BATCH_PROMPT.replace("'", "''")
_SINGLE = SINGLE_PROMPT.replace("'", "''")
T14 = f"""WITH {UNITS} SELECT doc_id, ord // 50 AS chunk, count(*) AS n, sha256(CASE WHEN count(*) = 1 THEN '{_SINGLE}' || any_value(unit) ELSE '{_PROMPT}' || string_agg((ord % 50 + 1)::VARCHAR || '. ' || unit, chr(10) ORDER BY ord) END) AS prompt_sha256 FROM units GROUP BY ALL"""
T17 = f"WITH {UNITS} SELECT doc_id, ord, substring(unit, 1, 40) AS label_3d, substring(unit, 1, 50) || '...' AS label_html FROM units"
T18 = "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '#4A90E2' WHEN 1 THEN '#9B9B9B' ELSE '#999999' END AS color FROM documents"
T19 = "SELECT doc_id, ('0x' || substring(sha256('context_' || substring(sha256(text), 1, 16) || '_0.2_1'), 1, 8))::BIGINT AS seed FROM documents"
T20 = "SELECT doc_id, ('0x' || substring(md5('projection_' || doc_id::VARCHAR), 1, 8))::BIGINT AS seed FROM documents"

NODES = f"""{TERMED}, valid AS (SELECT 'atomic_' || {_hash('unit')} AS node_id, doc_id, ord, unit AS statement, terms, 'context_' || substring(sha256(c), 1, 16) AS context_id, st, en FROM termed WHERE len({_violations('unit')}) = 0),
nodes AS MATERIALIZED (SELECT * FROM valid QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY doc_id, ord) = 1)"""

T15 = f"""WITH {NODES} SELECT node_id, '{{"node_id":"' || node_id || '","statement":' || to_json(statement)::VARCHAR || ',"canonical_terms":' || to_json(terms)::VARCHAR || '}}' AS json FROM nodes"""
T16 = f"WITH {NODES} SELECT node_id, statement, array_to_string(terms, '|') AS canonical_terms, 'atomic' AS node_type FROM nodes"


def _vectors(source: str) -> str:
    """CTEs tok, vec, sq, pos over ``source`` (scope, ord, text)."""
    return f"""tok AS (SELECT scope, ord, unnest({_words('lower(text)')}) AS token FROM {source}),
vec AS (SELECT scope, ord, token, count(*) AS tf FROM tok WHERE length(token) > 1 AND token NOT IN {_list(VECTOR_STOPWORDS)} GROUP BY ALL),
sq AS (SELECT scope, ord, sum(tf * tf)::BIGINT AS sq FROM vec GROUP BY ALL),
dots AS (SELECT a.scope, a.ord AS i, b.ord AS j, sum(a.tf * b.tf) AS dot FROM vec a JOIN vec b ON a.scope = b.scope AND a.token = b.token AND a.ord < b.ord GROUP BY ALL),
pos AS MATERIALIZED (SELECT d.scope, i, j, greatest(0.0, least(1.0, dot::DOUBLE / (sqrt(x.sq::DOUBLE) * sqrt(y.sq::DOUBLE)))) AS sim FROM dots d JOIN sq x ON x.scope = d.scope AND x.ord = i JOIN sq y ON y.scope = d.scope AND y.ord = j)"""


def _topk(source: str, k: int) -> str:
    """CTE top over ``source`` after :func:`_vectors`."""
    return f"""allp AS (SELECT a.scope, a.ord AS i, b.ord AS j, coalesce(p.sim, 0.0) AS sim FROM {source} a JOIN {source} b ON a.scope = b.scope AND a.ord <> b.ord
    LEFT JOIN pos p ON p.scope = a.scope AND p.i = least(a.ord, b.ord) AND p.j = greatest(a.ord, b.ord)),
best AS (SELECT * FROM allp QUALIFY row_number() OVER (PARTITION BY scope, i ORDER BY sim DESC, j) <= {k}),
top AS MATERIALIZED (SELECT DISTINCT scope, least(i, j) AS i, greatest(i, j) AS j, sim FROM best)"""


_US = "us AS MATERIALIZED (SELECT doc_id AS scope, ord, unit AS text FROM units)"
SIMS = f"{UNITS}, {_US}, {_vectors('us')}"
J2 = f"WITH {SIMS} SELECT scope AS doc_id, ord, sq AS squared_norm FROM sq"
J3 = "SELECT a.vec_id, round(greatest(0.0, least(1.0, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"
J4 = f"WITH {SIMS} SELECT scope AS doc_id, i, round(sim, 9) AS sim FROM pos WHERE j = i + 1"
J1 = f"WITH {UNITS} SELECT doc_id, ord, length(unit)::DOUBLE AS v0, (length(unit) - length(replace(unit, ' ', '')))::DOUBLE AS v1, (length(unit) - length(replace(unit, 'e', '')))::DOUBLE AS v2, (length(unit) - length(replace(unit, 'a', '')))::DOUBLE AS v3 FROM units"
J5 = f"""WITH {SIMS} SELECT scope AS doc_id, q AS query, ord, round(sim, 9) AS sim, row_number() OVER (PARTITION BY scope, q ORDER BY sim DESC, ord) AS rank
FROM (SELECT scope, i AS q, j AS ord, sim FROM pos UNION ALL SELECT scope, j, i, sim FROM pos UNION ALL SELECT scope, ord, ord, greatest(0.0, least(1.0, sq::DOUBLE / (sqrt(sq::DOUBLE) * sqrt(sq::DOUBLE)))) FROM sq) WHERE sim >= 0.85"""
J6 = f"WITH {SIMS} SELECT scope AS doc_id, i, j, round(sim, 9) AS sim FROM pos WHERE sim >= 0.65"
J7 = f"WITH {SIMS}, {_topk('us', 10)} SELECT scope AS doc_id, i, j, round(sim, 9) AS sim FROM top"

_NS = "ns AS MATERIALIZED (SELECT doc_id AS scope, ord, node_id, statement AS text FROM nodes)"
WEIGHTS = f"""{NODES}, {_NS}, {_vectors('ns')}, {_topk('ns', 3)},
weights AS MATERIALIZED (SELECT a.node_id AS source, b.node_id AS target, round(sim, 9) AS weight, t.scope * 1000000000 + t.i * 10000 + t.j AS edge_ord, 'related_to' AS type
    FROM top t JOIN ns a ON a.scope = t.scope AND a.ord = t.i JOIN ns b ON b.scope = t.scope AND b.ord = t.j)"""
GRAPH = f"""{WEIGHTS},
edges AS MATERIALIZED (SELECT node_id AS source, context_id AS target, 'appears_in' AS type, doc_id * 1000000 + ord AS edge_ord FROM nodes),
gnodes AS MATERIALIZED (SELECT node_id, 'atomic' AS node_type, statement, list_transform(terms, lambda t: lower(t))[1:2] AS topic_labels, doc_id * 1000000 + ord AS node_ord FROM nodes
    UNION ALL SELECT context_id, 'context', NULL, NULL, min(doc_id) * 1000000 FROM nodes GROUP BY context_id)"""

J8 = f"WITH {WEIGHTS} SELECT source, target, weight FROM weights"


def _told(phrase: str) -> str:
    return f"""led AS (SELECT *, lead(terms) OVER (PARTITION BY doc_id ORDER BY ord) AS after_ FROM nodes),
told AS MATERIALIZED (SELECT doc_id AS scope, ord, node_id, terms, st, CASE WHEN ord % 4 = 1 THEN statement || ' {phrase} ' || coalesce(lower(after_[1]), 'nothing') ELSE statement END AS statement FROM led)"""


J9 = f"""WITH {NODES}, before_ AS (SELECT *, lag(statement) OVER (PARTITION BY doc_id ORDER BY ord) AS b FROM nodes),
told AS MATERIALIZED (SELECT doc_id AS scope, ord, CASE WHEN ord % 4 = 1 THEN coalesce(b, 'nothing') || ' is based on it' ELSE statement END AS text FROM before_), {_vectors('told')}
SELECT t.scope AS doc_id, t.ord AS i, min(p.i) AS j FROM told t JOIN pos p ON p.scope = t.scope AND p.j = t.ord AND p.i >= t.ord - 3
WHERE (contains(lower(text), 'derived from') OR contains(lower(text), 'follows from') OR contains(lower(text), 'based on')) AND sim > 0.7 GROUP BY ALL"""
J13 = """SELECT 'context_' || substring(sha256(text), 1, 16) AS source, 'context_' || substring(sha256(source), 1, 16) AS target, 'authored_by' AS type FROM documents WHERE doc_id % 3 <> 0"""


def _lasting(units: str, near: str) -> str:
    """CTE ``stays`` (scope, ord) of ``units`` (scope, ord): each goes, in order, if it is near (scope, i, j) to one that stayed."""
    return f"""waits AS (SELECT scope, j, list(i) AS nb FROM {near} GROUP BY ALL),
lost AS (SELECT scope, unnest(list_reduce(list({{'gone': [j], 'nb': nb}} ORDER BY j), lambda a, x: CASE WHEN len(list_filter(x.nb, lambda i: NOT list_contains(a.gone, i))) > 0 THEN {{'gone': list_concat(a.gone, x.gone), 'nb': a.nb}} ELSE a END, {{'gone': []::BIGINT[], 'nb': []::BIGINT[]}}).gone) AS ord FROM waits GROUP BY scope),
stays AS MATERIALIZED (SELECT scope, ord FROM {units} u WHERE NOT EXISTS (SELECT 1 FROM lost l WHERE l.scope = u.scope AND l.ord = u.ord))"""


J15 = f"""WITH {SIMS}, close AS (SELECT * FROM pos WHERE sim >= 0.85), {_lasting('us', 'close')} SELECT scope AS doc_id, ord, text FROM us JOIN stays USING (scope, ord)"""
J15_CORPUS = f"""WITH {NODES}, us AS MATERIALIZED (SELECT 0 AS scope, row_number() OVER (ORDER BY doc_id, ord) AS ord, doc_id, ord AS own, statement AS text FROM nodes), {_vectors('us')}, close AS (SELECT * FROM pos WHERE sim >= 0.85), {_lasting('us', 'close')}
SELECT doc_id, own AS ord FROM us JOIN stays USING (scope, ord)"""
J10 = f"""WITH {NODES}, {_told('in particular')} SELECT a.scope AS doc_id, a.ord AS i, min(b.ord) AS j FROM told a JOIN told b ON a.scope = b.scope AND a.ord <> b.ord
WHERE (contains(lower(a.statement), 'more specifically') OR contains(lower(a.statement), 'in particular') OR contains(lower(a.statement), 'more precisely'))
    AND len(b.terms) > 0 AND list_has_all(a.terms, b.terms) GROUP BY ALL"""
_DEPENDS = """sfx AS (SELECT scope, ord, node_id, st, CASE WHEN contains(lower(statement), 'depends on') THEN substring(lower(statement), strpos(lower(statement), 'depends on'))
    WHEN contains(lower(statement), 'requires') THEN substring(lower(statement), strpos(lower(statement), 'requires'))
    WHEN contains(lower(statement), 'relies on') THEN substring(lower(statement), strpos(lower(statement), 'relies on')) END AS suffix FROM told),
dep AS (SELECT DISTINCT a.scope, a.ord AS i, b.ord AS j, a.node_id AS source, b.node_id AS target, a.st FROM sfx a JOIN (SELECT scope, ord, node_id, unnest(terms) AS term FROM told) b
    ON a.scope = b.scope AND a.ord <> b.ord WHERE suffix IS NOT NULL AND length(term) > 3 AND contains(suffix, lower(term)))"""
J11 = f"WITH {NODES}, {_told('requires')}, {_DEPENDS} SELECT scope AS doc_id, i, j FROM dep"
J14 = f"WITH {NODES}, {_told('requires')}, {_DEPENDS} SELECT source, target, 'depends_on' AS type, st::INTEGER AS span_start FROM dep"
J12 = f"WITH {NODES} SELECT node_id AS source, context_id AS target, 'appears_in' AS type FROM nodes"
J16 = f"""WITH {NODES} SELECT doc_id || '_' || ord AS query_id, n.node_id FROM (SELECT u.doc_id, u.ord, 'atomic_' || {_hash('unit')} AS h FROM units u) q JOIN (SELECT node_id FROM nodes) n ON n.node_id = q.h"""
_ENGLISH = "(SELECT doc_id FROM documents WHERE lang = 'en')"
J17 = f"""WITH {GRAPH} SELECT 'node' AS section, count(*) AS n, min(node_id) AS first_key FROM gnodes WHERE node_id NOT IN (SELECT node_id FROM gnodes WHERE node_ord // 1000000 IN {_ENGLISH})
UNION ALL SELECT 'edge', count(*), min(source || target) FROM edges e WHERE NOT EXISTS (SELECT 1 FROM edges o WHERE o.edge_ord // 1000000 IN {_ENGLISH} AND o.source = e.source AND o.target = e.target AND o.type = e.type)
UNION ALL SELECT 'weight', count(*), min(source || target) FROM weights e WHERE NOT EXISTS (SELECT 1 FROM weights o WHERE o.edge_ord // 1000000000 IN {_ENGLISH} AND o.source = e.source AND o.target = e.target)"""
J18 = f"WITH {GRAPH} SELECT node_id FROM gnodes WHERE node_type = 'atomic' AND node_id NOT IN (SELECT source FROM weights WHERE weight > 0.2 UNION ALL SELECT target FROM weights WHERE weight > 0.2)"
_ENDS = "ends AS (SELECT source AS node, target AS other FROM both_ UNION ALL SELECT target, source FROM both_)"
_BOTH = "both_ AS (SELECT source, target FROM edges UNION ALL SELECT source, target FROM weights)"
J19 = f"WITH {GRAPH}, {_BOTH}, {_ENDS} SELECT node, count(DISTINCT other) AS n_neighbours FROM ends GROUP BY node"
J20 = f"WITH {UNITS} SELECT doc_id, ord, ({_labels('unit')})[1] AS label FROM units"
J21 = f"WITH {WEIGHTS} SELECT source, target, weight FROM weights ORDER BY edge_ord LIMIT 1"
J22 = f"WITH {GRAPH}, m AS (SELECT node_id FROM gnodes WHERE node_type = 'context' OR len(topic_labels) >= 2) SELECT source, target, type FROM edges WHERE source IN (SELECT node_id FROM m) AND target IN (SELECT node_id FROM m)"
V12 = f"""WITH {GRAPH}, odd AS (SELECT source, CASE WHEN edge_ord % 3 = 0 THEN target || 'x' ELSE target END AS target, CASE WHEN edge_ord % 5 = 0 THEN 'refines' ELSE type END AS type FROM edges)
SELECT type, coalesce((type = 'appears_in' AND s.node_type = 'atomic' AND t.node_type = 'context') OR (type = 'refines' AND s.node_type = 'atomic' AND t.node_type = 'atomic'), false) AS valid, count(*) AS n
FROM odd LEFT JOIN gnodes s ON s.node_id = source LEFT JOIN gnodes t ON t.node_id = target GROUP BY ALL"""

A1 = f"WITH {GRAPH} SELECT type, count(*) AS n FROM (SELECT type FROM edges UNION ALL SELECT type FROM weights) GROUP BY type"
_STATS = f"""stats AS (SELECT (SELECT count(*) FROM gnodes WHERE node_type = 'atomic') AS atomic_nodes, (SELECT count(*) FROM gnodes WHERE node_type = 'context') AS context_nodes,
    (SELECT count(*) FROM edges) AS directed_edges, (SELECT count(*) FROM weights) AS weighted_edges, (SELECT count(*) FROM units WHERE len({_violations('unit')}) > 0) AS candidates, (SELECT avg(weight) FROM weights) AS mean_weight)"""
A2 = f"""WITH {GRAPH}, {_STATS} SELECT * REPLACE (round(mean_weight, 6) AS mean_weight), round((directed_edges + weighted_edges) / atomic_nodes, 6) AS avg_connectivity, round(candidates / greatest(atomic_nodes, 1), 6) AS candidate_ratio FROM stats"""
_ALONE = "(SELECT count(*) FROM {} WHERE node_id NOT IN (SELECT source FROM {} UNION ALL SELECT target FROM {}))"
A3 = f"""WITH {GRAPH}, {_STATS}, {_BOTH} SELECT atomic_nodes, context_nodes, directed_edges, weighted_edges, candidates, {_ALONE.format("nodes", "both_", "both_")} AS orphans FROM stats"""
A3_BARE = f"""WITH {GRAPH}, {_STATS}, {_told('requires')}, {_DEPENDS}, strong AS (SELECT source, target FROM weights WHERE weight >= 0.2), all_ AS (SELECT source, target FROM strong UNION ALL SELECT source, target FROM dep)
SELECT atomic_nodes, 0::BIGINT AS context_nodes, (SELECT count(*) FROM dep) AS directed_edges, (SELECT count(*) FROM strong) AS weighted_edges, candidates, {_ALONE.format("nodes", "all_", "all_")} AS orphans FROM stats"""
A4 = f"""WITH {GRAPH}, {_STATS} SELECT atomic_nodes + context_nodes AS nodes, directed_edges, weighted_edges, candidates,
    concat_ws('; ', CASE WHEN candidates > 0.5 * (atomic_nodes + context_nodes) THEN 'high candidate ratio' END, CASE WHEN directed_edges = 0 AND atomic_nodes + context_nodes > 1 THEN 'no edges' END) AS warnings FROM stats"""
A5 = f"WITH {GRAPH}, {_BOTH}, {_ENDS} SELECT node, count(*) AS degree FROM ends GROUP BY node"
A6 = f"""WITH {GRAPH}, w AS (SELECT source, target, 0.25 AS x FROM edges UNION ALL SELECT source, target, weight FROM weights)
SELECT node, round(sum(x), 9) AS importance FROM (SELECT source AS node, x FROM w UNION ALL SELECT target, x FROM w) GROUP BY node"""
_DEG = "deg AS (SELECT node, count(*) AS degree, sum(w) AS importance FROM (SELECT source AS node, weight AS w FROM weights UNION ALL SELECT target, weight FROM weights) GROUP BY node)"
A7 = f"WITH {WEIGHTS}, {_DEG} SELECT degree, count(*) AS n_nodes FROM deg GROUP BY degree"
A8 = f"""WITH {WEIGHTS}, {_DEG}, b AS (SELECT min(importance) AS lo, max(importance) AS hi FROM deg)
SELECT node_id, coalesce(degree, 0) AS degree, round(0.3 + pow(greatest((coalesce(importance, 0) - lo) / (hi - lo + 0.01), 0), 0.7) * 2.7, 6) AS size, '#4A90E2' AS color, substring(statement, 1, 40) AS label
FROM nodes LEFT JOIN deg ON node = node_id, b"""
A9 = f"""WITH {WEIGHTS}, {_DEG} SELECT (SELECT count(*) FROM nodes) AS node_count, (SELECT count(*) FROM weights) AS edge_count, max(degree) AS max_degree, round(max(importance), 9) AS max_importance, round(min(importance), 9) AS min_importance FROM deg"""
_SAID = _SPLIT.replace("FROM documents", "FROM (SELECT conv_id * 1000000 + turn AS doc_id, text FROM conversations WHERE role = 'assistant')")
A10 = f"""WITH {_SAID}, ok AS (SELECT doc_id, count(*) AS n FROM r WHERE length(unit) > 10 AND len({_violations('unit')}) = 0 GROUP BY doc_id)
SELECT conv_id, turn, coalesce(n, 0) AS n_valid FROM conversations LEFT JOIN ok ON doc_id = conv_id * 1000000 + turn WHERE role = 'assistant'"""
_BATCHED = f"""{_SAID}, ok AS (SELECT doc_id, count(*) AS n FROM r WHERE length(unit) > 10 AND len({_violations('unit')}) = 0 GROUP BY doc_id),
m AS (SELECT conv_id, turn, text, coalesce(n, 0) AS n_valid FROM conversations LEFT JOIN ok ON doc_id = conv_id * 1000000 + turn WHERE role = 'assistant'),
folded AS (SELECT conv_id, list(turn ORDER BY turn) AS turns, list_reduce(list({{'held': n_valid, 'batch': 0::BIGINT, 'out': []::BIGINT[]}} ORDER BY turn), lambda a, x: {{'held': CASE WHEN a.held + x.held >= 5 THEN 0 ELSE a.held + x.held END, 'batch': a.batch + CASE WHEN a.held + x.held >= 5 THEN 1 ELSE 0 END, 'out': list_append(a.out, a.batch)}},
    {{'held': 0::BIGINT, 'batch': 0::BIGINT, 'out': []::BIGINT[]}}).out AS bs FROM m GROUP BY conv_id),
batched AS (SELECT conv_id, unnest(turns) AS turn, unnest(bs) AS batch FROM folded)"""
A11 = f"WITH {_BATCHED} SELECT conv_id, turn, n_valid, batch FROM m JOIN batched USING (conv_id, turn)"
T21 = f"""WITH {_BATCHED}, placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id, batch ORDER BY turn) AS k FROM m JOIN batched USING (conv_id, turn))
SELECT conv_id, batch, count(*) AS n_messages, string_agg(chr(10) || '--- Message ' || k || ' ---' || chr(10) || text || chr(10), '' ORDER BY k) AS content FROM placed GROUP BY ALL"""
A12 = f"WITH {UNITS} SELECT doc_id, ord // 50 AS chunk, count(*) AS n FROM units GROUP BY ALL"
A13 = "SELECT conv_id, turn, 'prov_' || lpad((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::VARCHAR, 6, '0') AS record_id FROM conversations"
S3 = f"SELECT conv_id, turn, {_strip('text')} AS text FROM conversations WHERE role = 'assistant' AND length({_strip('text')}) > 0"

S3_TREE = f"""WITH said AS (SELECT conv_id, turn, {_strip('text')} AS text FROM conversations WHERE role = 'assistant')
SELECT conv_id, conv_id || '-' || turn AS message_id, strftime(make_timestamp((turn * 60 * 1000000)::BIGINT), '%Y-%m-%dT%H:%M:%S') AS ts, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ord FROM said WHERE length(text) > 0"""

_ADJ = """adj AS (SELECT source AS node, target AS other, weight, kind FROM st UNION ALL SELECT target, source, weight, kind FROM st)"""
_STEP = "st AS (SELECT source, target, weight, 0::BIGINT AS kind FROM weights WHERE weight >= 0.2 UNION ALL SELECT source, target, 1.0, 1 FROM edges)"
_FOCUS = """foc AS (SELECT node_id, coalesce(c, 0) AS degree FROM gnodes LEFT JOIN (SELECT node, count(*) AS c FROM ends GROUP BY node) ON node = node_id WHERE node_type = 'atomic' ORDER BY coalesce(c, 0) DESC, node_ord LIMIT 1)"""
P9 = f"WITH {GRAPH}, {_BOTH}, {_ENDS}, {_FOCUS} SELECT node_id, degree FROM foc"
P1 = f"""WITH RECURSIVE {GRAPH}, {_BOTH}, {_ENDS}, {_FOCUS}, {_STEP}, {_ADJ},
walk AS (SELECT node_id, 0 AS depth FROM foc UNION SELECT other, depth + 1 FROM walk JOIN adj ON node = node_id WHERE depth < 2)
SELECT node_id, min(depth)::BIGINT AS depth FROM walk GROUP BY node_id"""


def _search(k: int, threshold: float, depth: int, cap: int) -> str:
    """CTE ``found{k}`` (node_id, rank, depth) of the capped search from ``foc``, after GRAPH; adj{k} has its steps."""
    out = f"""adj{k} AS MATERIALIZED (SELECT source AS node, target AS other, 0 AS kind, edge_ord FROM weights WHERE weight >= {threshold} UNION ALL SELECT target, source, 0, edge_ord FROM weights WHERE weight >= {threshold}
    UNION ALL SELECT source, target, 1, edge_ord FROM edges UNION ALL SELECT target, source, 1, edge_ord FROM edges),
f{k}_0 AS MATERIALIZED (SELECT node_id, 0::BIGINT AS rank, 0::BIGINT AS depth FROM foc)"""
    for d in range(1, depth + 1):
        out += f""",
a{k}_{d} AS (SELECT other AS node_id, min(row(rank, kind, edge_ord)) AS key FROM (SELECT * FROM f{k}_{d - 1} WHERE depth = {d - 1}) JOIN adj{k} ON node = node_id WHERE other NOT IN (SELECT node_id FROM f{k}_{d - 1}) AND other IN (SELECT node_id FROM gnodes) GROUP BY other),
f{k}_{d} AS MATERIALIZED (SELECT * FROM f{k}_{d - 1} UNION ALL SELECT node_id, rank, {d}::BIGINT FROM (SELECT node_id, row_number() OVER (ORDER BY key, node_id) - 1 + (SELECT count(*) FROM f{k}_{d - 1}) AS rank FROM a{k}_{d}) WHERE rank < {cap})"""
    return out + f",\nfound{k} AS MATERIALIZED (SELECT * FROM f{k}_{depth})"


def _kept_edges(k: int, threshold: float, top: int) -> str:
    """CTE ``kept{k}`` (source, target, edge_type, weight) within ``found{k}``."""
    inside = f"source IN (SELECT node_id FROM found{k}) AND target IN (SELECT node_id FROM found{k})"
    return f"""w{k} AS (SELECT * FROM weights WHERE weight >= {threshold} AND {inside}),
i{k} AS (SELECT source AS node, target AS other, source, target, weight, edge_ord FROM w{k} UNION ALL SELECT target, source, source, target, weight, edge_ord FROM w{k}),
t{k} AS (SELECT * FROM i{k} QUALIFY row_number() OVER (PARTITION BY node ORDER BY weight DESC, other, edge_ord) <= {top}),
u{k} AS (SELECT source, target, weight FROM t{k} QUALIFY row_number() OVER (PARTITION BY least(source, target), greatest(source, target) ORDER BY edge_ord) = 1),
kept{k} AS MATERIALIZED (SELECT source, target, 'related_to' AS edge_type, weight FROM u{k} UNION ALL SELECT source, target, type, NULL FROM edges WHERE {inside})"""


_AROUND = f"WITH {GRAPH}, {_BOTH}, {_ENDS}, {_FOCUS}"
P1_CAPPED = f"{_AROUND}, {_search(0, 0.2, 5, 100)} SELECT node_id, rank, depth FROM found0"
P6 = f"WITH {GRAPH} SELECT node_id, substring(statement, 1, 60) AS statement FROM gnodes WHERE node_type = 'atomic' ORDER BY node_ord LIMIT 10"
P7 = f"{_AROUND}, {_search(0, 0.2, 3, 60)}, {_kept_edges(0, 0.2, 3)} SELECT * FROM kept0"
P8 = _AROUND + "".join(f", {_search(k, t, depth, cap)}, {_kept_edges(k, t, top)}" for k, (t, top, depth, cap) in enumerate(PERSPECTIVES, 1)) + " " + " UNION ALL ".join(
    f"""SELECT node_count, edge_count, CASE WHEN node_count > 0 THEN round(2 * edge_count / node_count, 2) ELSE 0.0 END AS average_degree, round(edge_count / CASE WHEN node_count > 1 THEN node_count * (node_count - 1) / 2 ELSE 1.0 END, 4) AS density, {k}::BIGINT AS perspective
FROM (SELECT (SELECT count(*) FROM found{k}) AS node_count, (SELECT count(*) FROM kept{k}) AS edge_count)"""
    for k in range(1, len(PERSPECTIVES) + 1)
)
X3 = f"""{_AROUND}, {_search(0, 0.2, 3, 60)}, {_kept_edges(0, 0.2, 3)},
inner_ AS (SELECT source, target, coalesce(weight, 0.5) * CASE edge_type WHEN 'depends_on' THEN 2.0 WHEN 'related_to' THEN 1.0 WHEN 'appears_in' THEN 0.5 ELSE 1.0 END AS w FROM kept0 WHERE source IN (SELECT node_id FROM nodes) AND target IN (SELECT node_id FROM nodes)),
deg AS (SELECT node, count(*) AS degree, sum(w) AS importance FROM (SELECT source AS node, w FROM inner_ UNION ALL SELECT target, w FROM inner_) GROUP BY node), b AS (SELECT coalesce(min(importance), 0) AS lo, coalesce(max(importance), 1) AS hi FROM deg)
SELECT n.node_id, coalesce(degree, 0) AS degree, round(coalesce(importance, 0), 9) AS importance, round(0.3 + pow(greatest((coalesce(importance, 0) - lo) / (hi - lo + 0.01), 0), 0.7) * 2.7, 6) AS size, '#4A90E2' AS color, substring(statement, 1, 40) AS label, statement AS full_statement
FROM nodes n JOIN found0 f ON f.node_id = n.node_id LEFT JOIN deg ON node = n.node_id, b"""
K1 = f"""WITH {GRAPH}, ids AS (SELECT node_id FROM gnodes) SELECT 'nodes' AS section, count(*) AS n, min(node_id) AS first_key FROM gnodes UNION ALL SELECT 'edges', count(*), min(source || ' ' || target) FROM edges UNION ALL SELECT 'weights', count(*), min(source || ' ' || target) FROM weights"""
P2 = f"WITH {GRAPH}, {_STEP}, {_ADJ} SELECT node, other, weight, kind FROM adj"
V13 = f"WITH {WEIGHTS} SELECT source, target, weight FROM weights WHERE weight >= 0.5"
V14 = f"""WITH {GRAPH}, {_STEP}, {_ADJ} SELECT node, other FROM adj JOIN gnodes a ON a.node_id = node JOIN gnodes b ON b.node_id = other
WHERE kind = 1 OR coalesce(len(a.topic_labels), 0) = 0 OR b.node_type <> 'atomic' OR list_has_any(a.topic_labels, b.topic_labels)"""
V15 = f"WITH {WEIGHTS} SELECT (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(*) FROM weights) AS n_edges"
V16 = "SELECT conv_id, turn FROM conversations WHERE role = 'assistant'"
V17 = f"""WITH {WEIGHTS}, {_DEG}, x AS (SELECT node_id, CASE WHEN coalesce(round(importance, 9), 0) <> 0 THEN round(importance, 9) ELSE coalesce(degree, 0)::DOUBLE END AS worth FROM nodes LEFT JOIN deg ON node = node_id),
b AS (SELECT min(worth) AS lo, max(worth) AS hi FROM x) SELECT node_id FROM x, b WHERE worth >= lo + (hi - lo) * 0.5"""
P3 = f"WITH {GRAPH} SELECT source, target, 'related_to' AS edge_type, weight FROM weights WHERE weight >= 0.3 UNION ALL SELECT source, target, type, NULL FROM edges"
P4 = f"""WITH {GRAPH}, i AS (SELECT source AS node, target AS other, source, target, weight, edge_ord FROM weights WHERE weight >= 0.1 UNION ALL SELECT target, source, source, target, weight, edge_ord FROM weights WHERE weight >= 0.1),
t AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY node ORDER BY weight DESC, other, edge_ord) <= 2),
u AS (SELECT source, target, weight FROM t QUALIFY row_number() OVER (PARTITION BY least(source, target), greatest(source, target) ORDER BY edge_ord) = 1)
SELECT source, target, 'related_to' AS edge_type, weight FROM u UNION ALL SELECT source, target, type, NULL FROM edges"""
P5 = f"""WITH {GRAPH}, n AS (SELECT count(*) AS node_count FROM gnodes), m AS (SELECT (SELECT count(*) FROM weights) + (SELECT count(*) FROM edges) AS edge_count)
SELECT node_count, edge_count, round(2 * edge_count / node_count, 2) AS average_degree, round(edge_count / (node_count * (node_count - 1) / 2), 4) AS density FROM n, m"""
X4 = """SELECT label::BIGINT AS projection_id, vec_id::VARCHAR AS node_id, round(cos(2 * pi() * vec_id / count(*) OVER (PARTITION BY label)), 6) + 0.0 AS x, round(sin(2 * pi() * vec_id / count(*) OVER (PARTITION BY label)), 6) + 0.0 AS y FROM embeddings"""
X1 = f"""WITH {TERMED} SELECT doc_id, ord, CASE WHEN len(terms) = 0 THEN 'general' ELSE array_to_string(list_transform(terms, lambda t: lower(t))[1:3], '|') END AS labels FROM termed"""
U1 = f"""WITH b AS ({T3}), n AS ({T4}) SELECT doc_id, count(*) AS n FROM (SELECT doc_id FROM b UNION ALL SELECT doc_id FROM n) GROUP BY doc_id"""
FLAGSHIP = f"WITH {NODES} SELECT doc_id, count(*) AS statements, sum(len(terms))::BIGINT AS terms, min(node_id) AS first_node FROM nodes GROUP BY doc_id"

_ASKED = f"""asked AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS ord, regexp_replace(statement, '[^A-Za-z ]', '', 'g') AS text FROM nodes WHERE NOT contains(statement, chr(10)) AND length(trim(regexp_replace(statement, '[^A-Za-z ]', '', 'g'))) > 0)"""
X1_ASKED = f"""WITH {NODES}, {_ASKED} SELECT doc_id, ord, array_to_string({_labels(f"array_to_string({_words('text')}[1:2], ', ')")}, '|') AS labels FROM asked"""

# The whole ingestion: units, rules, near duplicates of a document, equal statements, relations.
_FRESH = f"""{TERMED.replace("SELECT *, list_concat", "SELECT * REPLACE ((strpos(c, unit) - 1)::BIGINT AS st), list_concat")},
good AS MATERIALIZED (SELECT doc_id AS scope, ord, unit AS text, terms, c, st FROM termed WHERE len({_violations('unit')}) = 0),
{_vectors('good')}, close AS (SELECT * FROM pos WHERE sim >= 0.85), {_lasting('good', 'close')},
first_ AS MATERIALIZED (SELECT 'atomic_' || {_hash('text')} AS node_id, scope, ord, text AS statement, terms, 'context_' || substring(sha256(c), 1, 16) AS context_id, st FROM good JOIN stays USING (scope, ord) QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY scope, ord) = 1),
told AS MATERIALIZED (SELECT * REPLACE (row_number() OVER (PARTITION BY scope ORDER BY st, node_id) - 1 AS ord) FROM first_),
says AS (SELECT * FROM told)"""
_AGAIN = _vectors("again").replace("tok AS", "tok2 AS").replace("vec AS", "vec2 AS").replace("FROM tok ", "FROM tok2 ").replace("sq AS", "sq2 AS", 1).replace("FROM vec ", "FROM vec2 ").replace("JOIN vec ", "JOIN vec2 ").replace("dots AS", "dots2 AS").replace("FROM dots ", "FROM dots2 ").replace("JOIN sq ", "JOIN sq2 ").replace("pos AS", "pos2 AS")
_TOP = _topk("again", 10).replace("JOIN pos ", "JOIN pos2 ")
INGEST = f"""WITH {_FRESH}, again AS MATERIALIZED (SELECT scope, ord, statement AS text FROM told), {_AGAIN}, {_TOP}, {_DEPENDS},
refine AS (SELECT a.scope, a.ord AS i, min(b.ord) AS j FROM told a JOIN told b ON a.scope = b.scope AND a.ord <> b.ord
    WHERE (contains(lower(a.statement), 'more specifically') OR contains(lower(a.statement), 'in particular') OR contains(lower(a.statement), 'more precisely')) AND len(b.terms) > 0 AND list_has_all(a.terms, b.terms) GROUP BY ALL),
derive AS (SELECT t.scope, t.ord AS i, min(p.i) AS j FROM told t JOIN pos2 p ON p.scope = t.scope AND p.j = t.ord AND p.i >= t.ord - 3 WHERE (contains(lower(statement), 'derived from') OR contains(lower(statement), 'follows from') OR contains(lower(statement), 'based on')) AND sim > 0.7 GROUP BY ALL),
ends AS (SELECT scope, i AS ord FROM top UNION ALL SELECT scope, j FROM top)
SELECT (SELECT count(*) FROM told) AS atomic_nodes, (SELECT count(DISTINCT sha256(text)) FROM documents) AS context_nodes,
    (SELECT count(*) FROM told) + (SELECT count(*) FROM dep) + (SELECT count(*) FROM refine) + (SELECT count(*) FROM derive) AS directed_edges, (SELECT count(*) FROM top) AS weighted_edges,
    (SELECT count(*) FROM termed WHERE len({_violations('unit')}) > 0) AS candidates, (SELECT round(avg(sim), 6) FROM top) AS mean_weight, (SELECT count(DISTINCT context_id) FROM told) AS evidence_sources"""
