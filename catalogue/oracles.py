"""SQL for DuckDB that states what each registered query must return.

No SQL here parses a reply. The expected records follow from the formulas that
the replies were derived by.
"""

from __future__ import annotations

from catalogue.queries import BACKEND, CONTENT_LIMIT, MODEL, NEXT_RUN_TS, RUN_TS
from catalogue.sample_schema import ALLOWED_SCORES, LATER_SCHEMA, SCHEMA
from catalogue.samples import MULTIPLIERS, PAGE_CHARS
from papersieve import fixed_values as fv


def _text(value: str) -> str:
    """A SQL string; characters outside printable ASCII as ``chr`` calls."""
    parts, run = [], ""
    for c in value:
        if " " <= c <= "~":
            run += c.replace("'", "''")
        else:
            if run:
                parts.append(f"'{run}'")
                run = ""
            parts.append(f"chr({ord(c)})")
    if run or not parts:
        parts.append(f"'{run}'")
    return "(" + " || ".join(parts) + ")"


def _strip(expression: str) -> str:
    return f"trim({expression}, {_text(fv.SPACES)})"


def _score(k: int) -> str:
    allowed = ALLOWED_SCORES[k]
    h = f"((doc_id * {MULTIPLIERS[k]} + doc_id // {k + 2}) % 11)"
    values = "[" + ", ".join(f"{s}::DOUBLE" for s in allowed) + "]"
    return (
        f"CASE WHEN {h} < 7 THEN {allowed[-1]}::DOUBLE "
        f"ELSE {values}[({h} % {len(allowed)} + 1)::INT] END"
    )


# Documents with what their replies quote, and their labels.
DESCRIBED = """(
  SELECT d.*, replace(replace(coalesce(text, ''), 'QE', 'qe'), '==', '--') AS quoted, l.quality, l.toxic
  FROM documents d
  LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) l
    ON l.doc_id = d.doc_id
)"""


def _shown_score(k: int) -> str:
    """The score of question ``k``, counted from 0: labels where there are any tell two of them."""
    label = {0: "quality", 5: "toxic"}.get(k)
    if label is None:
        return _score(k)
    value = label if k == 0 else f"1 - {label}"
    return f"CASE WHEN {label} IN (0, 1) THEN ({value})::DOUBLE ELSE {_score(k)} END"


def _eighth(k: int) -> str:
    """Part ``k``, counted from 1, of eight that make up the quoted text."""
    start, end = f"({k - 1} * length(quoted) // 8)", f"({k} * length(quoted) // 8)"
    return f"substr(quoted, {start} + 1, {end} - {start})"


def _letters(value: str) -> str:
    return f"regexp_replace(lower({value}), '[^a-z]+', ' ', 'g')"


_TITLE = f"'study of ' || {_letters('substr(quoted, 1, 40)')}"
_AUTHOR = f"'a. ' || {_letters("coalesce(source, 'writer')")}"
_YEAR = "(2000 + coalesce(n_chars, doc_id) % 25)::VARCHAR"
_CAMERA = f"'camera ' || {_letters("coalesce(lang, 'none')")}"

# Every item a reply should yield, in order. Question 9 of the working list is
# the extra item of classes 8 and 9.
_QUESTION_ROWS = " UNION ALL ".join(
    f"SELECT doc_id, {k} AS slot, 'QE{k + 1}' AS qid, "
    f"replace({_strip(_eighth(k + 1))}, chr(34), '') AS descr, {_shown_score(k)} AS score FROM {DESCRIBED}"
    for k in range(len(ALLOWED_SCORES))
)
ITEMS = f"""
all_items AS (
  SELECT * FROM ({_QUESTION_ROWS})
  WHERE doc_id % 12 NOT IN (10, 11) AND NOT (doc_id % 12 = 7 AND slot = 2)
  UNION ALL
  SELECT doc_id, 8, CASE doc_id % 12 WHEN 8 THEN 'QE2' ELSE 'QE9' END,
         'note ' || doc_id || ' again', 1.0
  FROM documents WHERE doc_id % 12 IN (8, 9)
  UNION ALL
  SELECT doc_id, 0, 'QE1', 'a', 1.0 FROM documents WHERE doc_id % 24 = 23
  UNION ALL
  SELECT doc_id, 1, 'QE2', 'b', -1.0 FROM documents WHERE doc_id % 24 = 23
),
items AS (
  SELECT doc_id, qid, descr, score,
         row_number() OVER (PARTITION BY doc_id ORDER BY slot) - 1 AS ord,
         CASE WHEN doc_id % 24 = 23 THEN 'positional'
              WHEN doc_id % 12 IN (5, 6) THEN 'unmarked' ELSE 'marked' END AS qa_strategy
  FROM all_items
),
totals AS (SELECT doc_id, sum(score) AS total_score FROM items GROUP BY doc_id),
last_items AS (
  SELECT doc_id, qid, arg_max(descr, ord) AS descr, arg_max(score, ord) AS score
  FROM items GROUP BY doc_id, qid
)"""

_WIDE = ",\n  ".join(
    f"coalesce(max(descr) FILTER (qid = '{i}'), '') AS \"{i}\", "
    f"max(score) FILTER (qid = '{i}') AS \"{i}_SCORE\""
    for i in SCHEMA.question_ids
)
WIDE = f"""
wide AS (
  SELECT d.doc_id,
  {_WIDE}
  FROM documents d LEFT JOIN last_items i ON i.doc_id = d.doc_id GROUP BY d.doc_id
)"""

# Fields of a reply: classes 3 and 6 lose them, class 10 has no reply.
FIELDS = f"""
fields AS (
  SELECT doc_id, f.ord, f.key, f.value,
         CASE WHEN doc_id % 12 = 5 OR doc_id % 24 = 11 THEN 'unmarked' ELSE 'marked' END AS de_strategy
  FROM (
    SELECT doc_id, unnest([
      {{'ord': 0, 'key': 'TITLE', 'value': trim({_TITLE})}},
      {{'ord': 1, 'key': 'AUTHOR', 'value': trim({_AUTHOR})}},
      {{'ord': 2, 'key': 'YEAR', 'value': {_YEAR}}},
      {{'ord': 3, 'key': 'VISION SYSTEM', 'value': trim({_CAMERA})}}
    ]) AS f
    FROM {DESCRIBED} WHERE doc_id % 12 NOT IN (3, 6, 10)
  )
)"""

_EXCLUDED = "coalesce(" + ", ".join(
    f"CASE WHEN max(score) FILTER (qid = '{i}') = 0 THEN '{i}' END" for i in SCHEMA.excluding
) + ")"


def _decisions(unreadable: bool) -> str:
    """What becomes of each document; ``unreadable`` takes the text from every fiftieth."""
    no_text = "d.doc_id % 50 = 49" if unreadable else "false"
    return f"""{ITEMS},
exclusion AS (SELECT doc_id, {_EXCLUDED} AS excluded_by FROM last_items GROUP BY doc_id),
decisions AS (
  SELECT d.doc_id,
         {no_text} AS no_text,
         CASE WHEN ({no_text}) OR d.doc_id % 12 = 10 THEN NULL
              WHEN d.doc_id % 12 IN (3, 6) THEN 'doc_' || d.doc_id
              ELSE trim({_TITLE}) END AS title,
         CASE WHEN {no_text} THEN NULL ELSE t.total_score END AS total_score,
         CASE WHEN {no_text} THEN NULL ELSE e.excluded_by END AS excluded_by,
         coalesce(t.total_score <> 0 AND t.total_score >= {SCHEMA.cutoff}, false)
           AND NOT ({no_text}) AS passes_cutoff,
         CASE WHEN {no_text} THEN 'NO_TEXT'
              WHEN d.doc_id % 12 = 10 THEN 'NO_RESPONSE'
              WHEN d.doc_id % 24 = 11 THEN 'PARSE_ERROR'
              WHEN e.excluded_by IS NULL AND t.total_score <> 0
                   AND t.total_score >= {SCHEMA.cutoff} THEN 'ANALYSED'
              ELSE 'REJECTED' END AS status,
         CASE WHEN ({no_text}) OR d.doc_id % 12 = 10 OR d.doc_id % 24 = 11 THEN NULL
              WHEN e.excluded_by IS NOT NULL THEN 'EXCLUDED'
              WHEN t.total_score <> 0 AND t.total_score >= {SCHEMA.cutoff} THEN NULL
              ELSE 'CUTOFF' END AS reason
  FROM {DESCRIBED} d
  LEFT JOIN totals t ON t.doc_id = d.doc_id
  LEFT JOIN exclusion e ON e.doc_id = d.doc_id
)"""


# The reply itself, needed where a query returns it.
_GAP = "CASE WHEN doc_id % 12 = 4 THEN ' ' ELSE chr(10) END"
_SHOWN = [
    f"({_shown_score(k)})::VARCHAR"
    + (" || CASE WHEN doc_id % 12 = 7 OR doc_id % 24 = 11 THEN '.' ELSE '' END" if k == 2 else "")
    for k in range(len(ALLOWED_SCORES))
]
_BODY = " || gap || ".join(
    f"'QE{k}: ' || {_eighth(k)} || gap || 'QE{k}_SCORE: ' || s{k}"
    for k in range(1, len(ALLOWED_SCORES) + 1)
)
REPLIES = f"""
spaced AS (
  SELECT *, {_GAP} AS gap, {", ".join(f"{c} AS s{k}" for k, c in enumerate(_SHOWN, 1))}
  FROM {DESCRIBED}
),
parts AS (
  SELECT doc_id, gap,
    {_BODY} || CASE
      WHEN doc_id % 12 = 8 THEN gap || 'QE2: note ' || doc_id || ' again' || gap || 'QE2_SCORE: 1.0'
      WHEN doc_id % 12 = 9 THEN gap || 'QE9: note ' || doc_id || ' again' || gap || 'QE9_SCORE: 1.0'
      ELSE '' END AS lines,
    'TITLE: ' || {_TITLE} || gap || 'AUTHOR: ' || {_AUTHOR} || gap || 'YEAR: '
      || {_YEAR} || gap || 'VISION SYSTEM: ' || {_CAMERA} AS listed
  FROM spaced
),
replies AS (
  SELECT doc_id, 'doc_' || doc_id || '.pdf' AS file_name, CASE
    WHEN doc_id % 12 = 3 THEN
      '{fv.QA_START}' || gap || lines || gap || '{fv.QA_END}' || gap || '{fv.DE_START}' || gap || listed
    WHEN doc_id % 12 = 5 OR doc_id % 24 = 11 THEN lines || gap || 'Data Extraction:' || gap || listed
    WHEN doc_id % 12 = 6 THEN '{fv.QA_START}' || gap || lines
    WHEN doc_id % 24 = 10 THEN NULL
    WHEN doc_id % 12 = 10 THEN ''
    WHEN doc_id % 12 = 11 THEN
      '{fv.QA_START} QE1: a QE1_SCORE:+1 QE2: b QE2_SCORE:-1 {fv.QA_END}' || gap
      || '{fv.DE_START}' || gap || listed || gap || '{fv.DE_END}'
    ELSE '{fv.QA_START}' || gap || lines || gap || '{fv.QA_END}' || gap || '{fv.DE_START}' || gap
      || listed || gap || '{fv.DE_END}' END AS response
  FROM parts
),
attached AS (
  SELECT doc_id, file_name, doc_id % 50 <> 49 AS has_text,
         CASE WHEN doc_id % 50 <> 49 THEN response END AS response
  FROM replies
)"""

_QA_COLUMNS = ", ".join(f'w."{i}", w."{i}_SCORE"' for i in SCHEMA.question_ids)
QA_REPORT = f"""
WITH {_decisions(True)},{WIDE}
SELECT d.doc_id, d.title AS "TITLE", {_QA_COLUMNS}, d.total_score AS "TOTAL_SCORE"
FROM decisions d JOIN wide w ON w.doc_id = d.doc_id
WHERE d.status IN ('ANALYSED', 'REJECTED')
"""

_PROMPT_TEXT = _text(SCHEMA.prompt())


def _shortened(limit: int, notice: str) -> str:
    return (
        f"CASE WHEN length(text) > {limit} "
        f"THEN substr(text, 1, {limit}) || {_text(notice)} ELSE text END"
    )


ATTEMPTS = """
made AS (
  SELECT event_id // 4 AS doc_id, event_id % 4 + 1 AS attempt,
         CASE WHEN event_type IN ('click', 'view') THEN 200
              WHEN event_type = 'signup' THEN 503 WHEN event_type = 'error' THEN 429 END AS status_code,
         CASE WHEN event_type = 'purchase' THEN 'timeout' END AS error_kind,
         CASE WHEN event_type IN ('click', 'view') THEN 'ok'
              WHEN event_type IN ('signup', 'purchase') THEN 'retry' ELSE 'fatal' END AS kind,
         CASE WHEN event_type = 'click' THEN 'reply ' || props END AS reply
  FROM events WHERE event_id % 4 + 1 <= 3
),
ends AS (
  SELECT doc_id, min(attempt) FILTER (kind <> 'retry') AS ended, max(attempt) AS reached
  FROM made GROUP BY doc_id
),
resolved AS (
  SELECT e.doc_id,
         CASE WHEN ended IS NOT NULL THEN m.kind WHEN reached = 3 THEN 'exhausted'
              ELSE 'incomplete' END AS outcome,
         m.attempt AS n_attempts, m.status_code, m.error_kind, m.reply
  FROM ends e JOIN made m ON m.doc_id = e.doc_id AND m.attempt = coalesce(e.ended, e.reached)
)"""

_GLUED = """
glued AS (
  SELECT doc_id, unnest(list_filter([
    {'slot': 0, 'qid': 'QE1', 'descr': 'first ' || doc_id, 'score': 1.0::DOUBLE},
    {'slot': 1, 'qid': 'QE2', 'descr': 'second',
     'score': CASE WHEN doc_id % 2 = 0 THEN -0.5::DOUBLE END},
    {'slot': 2, 'qid': 'QE1', 'descr': 'first ' || doc_id,
     'score': CASE WHEN doc_id % 3 = 0 THEN 1.0::DOUBLE END},
    {'slot': 3, 'qid': 'QE30', 'descr': 'third', 'score': (doc_id % 7)::DOUBLE / 10}
  ], lambda x: x.score IS NOT NULL)) AS i,
  1.0::DOUBLE + CASE WHEN doc_id % 2 = 0 THEN -0.5 ELSE 0 END
    + CASE WHEN doc_id % 3 = 0 THEN 1.0 ELSE 0 END + (doc_id % 7)::DOUBLE / 10 AS total_score
  FROM documents
)
"""

_LOOSE = """
loose AS (
  SELECT doc_id, unnest(list_filter([
    {'slot': 0, 'qid': 'QE1', 'descr': 'It is sound', 'score': 1.0::DOUBLE},
    {'slot': 1, 'qid': 'QE2',
     'descr': CASE WHEN doc_id % 2 = 0 THEN 'part ' || doc_id
                   ELSE 'part ' || doc_id || chr(10) || 'QE3: clear' END,
     'score': CASE WHEN doc_id % 2 = 0 THEN 2.0::DOUBLE ELSE (doc_id % 3)::DOUBLE END},
    {'slot': 2, 'qid': 'QE3', 'descr': 'clear',
     'score': CASE WHEN doc_id % 2 = 0 THEN (doc_id % 3)::DOUBLE END}
  ], lambda x: x.score IS NOT NULL)) AS i
  FROM documents
)
"""

_LISTED_PAGES = f"""
listed AS (
  SELECT page_id, chr(10) || 'source: ' || url || chr(10) || replace(html, '<', chr(10) || '<') AS below
  FROM pages
),
cut AS (
  SELECT page_id, {_strip(
    "string_split(string_split(string_split(string_split(below, 'Minimum acceptance score')[1],"
    " 'SECTION 3')[1], 'Cutoff Score')[1], chr(10) || chr(10) || chr(10))[1]"
  )} AS part
  FROM listed
),
numbered AS (
  SELECT page_id, unnest(string_split(part, chr(10))) AS line,
         generate_subscripts(string_split(part, chr(10)), 1) AS n
  FROM cut
),
pairs AS (
  SELECT page_id, n,
         {_strip("replace(replace(split_part(line, ':', 1), '\"', ''), '*', '')")} AS key,
         {_strip("replace(substr(line, strpos(line, ':') + 1), '\"', '')")} AS value
  FROM numbered WHERE contains(line, ':')
)"""

_DE_COLUMNS = ", ".join(
    f"coalesce(max(value) FILTER (key = '{key}'), '') AS \"{key}\"" for key in SCHEMA.field_keys
)
_QUESTION_VALUES = ", ".join(
    f"({k}, '{q.id}', {_text(q.question)}, [{', '.join(f'{s}::DOUBLE' for s in q.scores)}])"
    for k, q in enumerate(SCHEMA.questions)
)
_FIELD_VALUES = ", ".join(
    f"({k}, '{f.key}', {_text(f.description)})" for k, f in enumerate(SCHEMA.fields)
)
_LOG = f"""
SELECT doc_id, file_name, '{RUN_TS}' AS logged_at,
       CASE WHEN response <> '' THEN response ELSE '{fv.NO_RESPONSE_NOTICE}' END AS body
FROM attached"""

ORACLES: dict[str, str] = {
    "pending_documents": """
SELECT doc_id, 'doc_' || doc_id || '.pdf' AS file_name FROM documents WHERE doc_id % 3 <> 0""",
    "assemble_pages": "SELECT doc_id, text FROM documents",
    "schema_questions": f"""
WITH {ITEMS}, asked(ord, qid, question, scores) AS (VALUES {_QUESTION_VALUES})
SELECT coalesce(a.qid, i.qid) AS qid, a.ord::BIGINT AS ord, a.question,
       count(i.qid)::BIGINT AS n_items,
       count(i.qid) FILTER (NOT coalesce(list_contains(a.scores, i.score), false))::BIGINT AS n_other_scores
FROM items i FULL JOIN asked a ON a.qid = i.qid GROUP BY ALL""",
    "schema_fields": f"""
WITH {FIELDS}, wanted(ord, key, description) AS (VALUES {_FIELD_VALUES})
SELECT w.ord::BIGINT AS ord, w.key, w.description,
       count(f.key) FILTER (f.value <> '')::BIGINT AS n_filled
FROM wanted w LEFT JOIN fields f ON f.key = w.key GROUP BY ALL""",
    "preview": f"""
SELECT doc_id, {_shortened(fv.PREVIEW_CHARS, fv.PREVIEW_NOTICE)} AS preview FROM documents""",
    "truncate_content": f"""
SELECT doc_id, {_shortened(CONTENT_LIMIT, fv.TRUNCATION_NOTICE)} AS content FROM documents""",
    "render_prompt": f"""
WITH asked AS (
  SELECT o_custkey, string_agg('* QE' || o_orderkey || ': ' || o_orderpriority
    || ' (Possible scores: 0.0, 0.5, ' || o_totalprice || ')' || chr(10), '' ORDER BY o_orderkey) AS lines
  FROM orders GROUP BY o_custkey
), wanted AS (
  SELECT o_custkey, string_agg('* ORDER ' || o_orderstatus || ': ' || o_orderpriority || chr(10), ''
    ORDER BY o_orderkey) AS lines
  FROM orders GROUP BY o_custkey
)
SELECT c_custkey AS review_id, CASE WHEN a.lines IS NULL OR w.lines IS NULL THEN '' ELSE
  {_text(fv.PROMPT_OPENING)} || a.lines || {_text(fv.PROMPT_FIELDS_HEADING)} || w.lines
  || {_text(fv.PROMPT_CUTOFF)} || c_acctbal || {_text(fv.PROMPT_CLOSING)} END AS prompt
FROM customer LEFT JOIN asked a ON a.o_custkey = c_custkey LEFT JOIN wanted w ON w.o_custkey = c_custkey""",
    "compose_prompt": f"""
WITH m AS (
  SELECT doc_id, CASE WHEN text = '' THEN {_PROMPT_TEXT}
    ELSE {_text(fv.CONTENT_HEADING)} || text || {_text(fv.TASK_HEADING)} || {_PROMPT_TEXT} END AS message
  FROM documents
)
SELECT doc_id, length(message)::BIGINT AS n_chars, md5(message) AS message_md5 FROM m""",
    "chat_payload": f"""
SELECT doc_id, '{MODEL}' AS model, {fv.TEMPERATURE}::DOUBLE AS temperature,
       {fv.MAX_TOKENS}::BIGINT AS max_tokens, false AS stream, 'system,user' AS roles,
       {_text(fv.SYSTEM_MESSAGE)} AS system_message,
       md5({_text(fv.CONTENT_HEADING)} || text || {_text(fv.TASK_HEADING)} || {_PROMPT_TEXT}) AS user_md5
FROM documents WHERE text <> ''""",
    "extract_reply": """
SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'reply ' || doc_id END AS reply FROM documents""",
    "resolve_attempts": f"""
WITH {ATTEMPTS}
SELECT doc_id, outcome, n_attempts::BIGINT AS n_attempts, status_code::BIGINT AS status_code,
       error_kind, CASE WHEN outcome = 'ok' THEN reply END AS reply FROM resolved""",
    "backoff_cost": f"""
WITH {ATTEMPTS}
SELECT doc_id, outcome, n_attempts::BIGINT AS n_attempts,
       CASE n_attempts - CASE WHEN outcome = 'incomplete' THEN 0 ELSE 1 END
         WHEN 0 THEN 0.0 WHEN 1 THEN 2.0 ELSE 6.0 END::DOUBLE AS backoff_seconds
FROM resolved""",
    "attach_responses": f"""
WITH {REPLIES} SELECT doc_id, file_name, has_text, response FROM attached""",
    "conversation_batches": f"""
WITH ranked AS (
  SELECT doc_id, 'doc_' || doc_id || '.pdf' AS file_name,
         row_number() OVER (ORDER BY 'doc_' || doc_id || '.pdf') - 1 AS position
  FROM documents
)
SELECT doc_id, file_name, position::BIGINT AS position,
       (position // {fv.DOCUMENTS_PER_CONVERSATION})::BIGINT AS conversation FROM ranked""",
    "qa_items": f"WITH {ITEMS} SELECT doc_id, qa_strategy, ord, qid, descr, score FROM items",
    "qa_total": f"""
WITH {ITEMS}
SELECT d.doc_id,
       CASE WHEN d.doc_id % 12 = 10 THEN NULL WHEN d.doc_id % 24 = 23 THEN 'positional'
            WHEN d.doc_id % 12 IN (5, 6, 11) THEN 'unmarked' ELSE 'marked' END AS qa_strategy,
       d.doc_id % 24 = 11 AS qa_failed, t.total_score
FROM documents d LEFT JOIN totals t ON t.doc_id = d.doc_id""",
    "qa_checks": f"""
WITH {ITEMS}, asked(ord, qid, question, scores) AS (VALUES {_QUESTION_VALUES})
SELECT d.doc_id,
       CASE WHEN count(i.qid) > 0 THEN
         coalesce(string_agg(DISTINCT i.qid, ',') FILTER (i.qid IS NOT NULL AND a.qid IS NULL), '') END AS unknown_ids,
       bool_and(list_contains(a.scores, i.score)) FILTER (a.qid IS NOT NULL) AS score_in_range
FROM documents d LEFT JOIN items i ON i.doc_id = d.doc_id LEFT JOIN asked a ON a.qid = i.qid
GROUP BY d.doc_id""",
    "de_strict": """
WITH shown AS (
  SELECT doc_id, upper(coalesce(source, 'none')) AS s, upper(coalesce(lang, 'none')) AS l, coalesce(n_chars, 0) AS n
  FROM documents
)
SELECT doc_id, 'marked' AS de_strategy, 0::BIGINT AS ord, 'SOURCE' AS key, 'taken from ' || s AS value FROM shown
UNION ALL SELECT doc_id, 'marked', 1, 'YEAR', n::VARCHAR FROM shown
UNION ALL SELECT doc_id, 'marked', 2, 'LICENSE', l || ' SEEN: no' FROM shown""",
    "qa_wide": f"""
WITH {ITEMS},{WIDE}
SELECT w.*, t.total_score AS "TOTAL_SCORE"
FROM wide w LEFT JOIN totals t ON t.doc_id = w.doc_id""",
    "qa_positional": f"""
WITH {_GLUED}
SELECT doc_id, 'positional' AS qa_strategy, total_score,
       row_number() OVER (PARTITION BY doc_id ORDER BY i.slot) - 1 AS ord,
       i.qid AS qid, i.descr AS descr, i.score AS score FROM glued""",
    "qa_unmarked": f"""
WITH {_LOOSE}
SELECT doc_id, 'unmarked' AS qa_strategy,
       row_number() OVER (PARTITION BY doc_id ORDER BY i.slot) - 1 AS ord,
       i.qid AS qid, i.descr AS descr, i.score AS score FROM loose""",
    "qa_quoted_text": f"""
SELECT doc_id, 'marked' AS qa_strategy, 0::BIGINT AS ord, 'QE1' AS qid,
       replace({_strip("text")}, '"', '') AS descr, 1.0::DOUBLE AS score FROM documents
UNION ALL
SELECT doc_id, 'marked', 1, 'QE2', 'short', 0.5 FROM documents""",
    "de_items": f"WITH {FIELDS} SELECT doc_id, de_strategy, ord::BIGINT AS ord, key, value FROM fields",
    "de_wide": f"""
WITH {FIELDS}
SELECT d.doc_id,
       CASE WHEN d.doc_id % 12 = 10 THEN NULL
            WHEN d.doc_id % 12 IN (3, 5, 6) OR d.doc_id % 24 = 11 THEN 'unmarked'
            ELSE 'marked' END AS de_strategy,
       {_DE_COLUMNS}
FROM documents d LEFT JOIN fields f ON f.doc_id = d.doc_id GROUP BY d.doc_id""",
    "de_unmarked": f"""
WITH {_LISTED_PAGES}
SELECT page_id, 'unmarked' AS de_strategy,
       row_number() OVER (PARTITION BY page_id ORDER BY n) - 1 AS ord, key, value
FROM pairs WHERE key <> ''""",
    "de_title_rescue": """
SELECT doc_id, 'title' AS de_strategy, 0::BIGINT AS ord, 'TITLE' AS key,
       CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN doc_id || 'D' ELSE doc_id || ' x 9' END AS value
FROM documents""",
    "de_quoted_text": f"""
SELECT doc_id, 'marked' AS de_strategy, 0::BIGINT AS ord, 'YEAR' AS key, '2001' AS value FROM documents
UNION ALL
SELECT doc_id, 'marked', 1, 'TITLE', {_strip("text")} FROM documents""",
    "resolve_title": """
SELECT doc_id, 'doc_' || doc_id AS stem, doc_id % 5 IN (1, 2) AS has_title,
       CASE doc_id % 5 WHEN 0 THEN 'mixed ' || doc_id WHEN 2 THEN 'last ' || doc_id
            WHEN 3 THEN 'quoted ' || doc_id ELSE 'doc_' || doc_id END AS title
FROM documents""",
    "excluded": f"WITH {_decisions(False)} SELECT doc_id, excluded_by FROM decisions",
    "excluded_as_join": f"""
WITH {_decisions(False)}
SELECT doc_id, excluded_by FROM decisions WHERE excluded_by IS NOT NULL""",
    "cutoff": f"WITH {_decisions(False)} SELECT doc_id, total_score, passes_cutoff FROM decisions",
    "triage": f"""
WITH {_decisions(True)}
SELECT doc_id, title, total_score, status, reason, excluded_by FROM decisions""",
    "qa_report": QA_REPORT,
    "de_report": f"""
WITH {_decisions(True)},{FIELDS}
SELECT d.doc_id, {_DE_COLUMNS}
FROM decisions d JOIN fields f ON f.doc_id = d.doc_id
WHERE d.status = 'ANALYSED' GROUP BY d.doc_id""",
    "manifest_counts": f"""
WITH {_decisions(True)}
SELECT status, reason, count(*)::BIGINT AS n_documents FROM decisions GROUP BY status, reason""",
    "response_log": f"WITH {REPLIES} {_LOG}",
    "response_log_text": f"""
WITH {REPLIES}, logged AS ({_LOG})
SELECT doc_id, chr(10) || chr(10) || repeat('=', 80) || chr(10) || 'PDF: ' || file_name || chr(10)
  || 'Time: ' || logged_at || chr(10) || repeat('=', 80) || chr(10) || chr(10) || body AS value
FROM logged
UNION ALL
SELECT NULL, '=== LLM Response Log - Started at {RUN_TS} ===' || chr(10) || chr(10)
  || 'Using LLM backend at {BACKEND} (model: {MODEL})' || chr(10)""",
    "artifacts": f"""
WITH {REPLIES}, written AS (
  SELECT doc_id, 'doc_' || doc_id || '_prompt.txt' AS artifact, {_PROMPT_TEXT} AS content FROM documents
  UNION ALL
  SELECT doc_id, 'doc_' || doc_id || '_pdf_extract.txt',
         {_shortened(fv.PREVIEW_CHARS, fv.PREVIEW_NOTICE)}
  FROM documents WHERE doc_id % 50 <> 49 AND text <> ''
  UNION ALL
  SELECT doc_id, 'doc_' || doc_id || '_response.txt', response FROM attached WHERE response <> ''
)
SELECT doc_id, artifact, length(content)::BIGINT AS n_chars, md5(content) AS content_md5 FROM written""",
    "report_round_trip": QA_REPORT,
    "run_snapshot": f"""
WITH {_decisions(True)}
SELECT doc_id, '{RUN_TS}' AS run_ts, status FROM decisions WHERE doc_id % 3 = 0
UNION ALL
SELECT doc_id, '{NEXT_RUN_TS}', status FROM decisions
WHERE doc_id % 3 <> 0 OR status NOT IN ('ANALYSED', 'REJECTED')""",
}
# A stream must come to what the batch comes to.
ORACLES["review_stream"] = ORACLES["triage"]
ORACLES["attempts_stream"] = ORACLES["resolve_attempts"]

# Lines of a customer's orders as items; of a repeated question the last counts.
_LINES = """
lines AS (
  SELECT o_custkey AS review_id, l_linenumber::BIGINT AS doc_id, o_orderkey, o_orderstatus, o_orderpriority,
         'part ' || l_partkey || ' from ' || l_suppkey AS answer, (l_quantity % 3)::DOUBLE AS score,
         row_number() OVER (PARTITION BY o_custkey, l_linenumber, o_orderkey
                            ORDER BY l_quantity DESC, l_partkey DESC, l_suppkey DESC) AS n
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
),
totals AS (SELECT review_id, doc_id, sum(score) AS total_score FROM lines GROUP BY ALL),
excluded AS (
  SELECT review_id, doc_id, 'QE' || min(o_orderkey) AS excluded_by FROM lines
  WHERE n = 1 AND score = 0 AND o_orderpriority = '1-URGENT' GROUP BY ALL
),
many AS (
  SELECT review_id, doc_id, total_score, excluded_by,
         CASE WHEN excluded_by IS NULL AND total_score <> 0 AND total_score >= c_acctbal / 1000
              THEN 'ANALYSED' ELSE 'REJECTED' END AS status
  FROM totals LEFT JOIN excluded USING (review_id, doc_id) JOIN customer ON c_custkey = review_id
)"""
ORACLES["many_reviews"] = f"""
WITH {_LINES}
SELECT *, CASE WHEN status = 'ANALYSED' THEN NULL WHEN excluded_by IS NOT NULL THEN 'EXCLUDED' ELSE 'CUTOFF' END AS reason
FROM many"""
ORACLES["many_answers"] = f"""
WITH {_LINES}
SELECT review_id, doc_id, 'QE' || o.o_orderkey AS id, o.o_orderpriority AS question,
       coalesce(answer, '') AS answer, score, score IN (0, 0.5, o_totalprice) AS allowed
FROM many JOIN orders o ON o.o_custkey = review_id
LEFT JOIN (SELECT * FROM lines WHERE n = 1) l USING (review_id, doc_id, o_orderkey)"""
ORACLES["many_fields"] = f"""
WITH {_LINES}, counted AS (SELECT review_id, doc_id, o_orderstatus, count(*) AS k FROM lines GROUP BY ALL)
SELECT review_id, doc_id, o.o_orderkey AS ord, 'ORDER ' || o_orderstatus AS field_key,
       coalesce('seen ' || k, '') AS value
FROM many JOIN orders o ON o.o_custkey = review_id LEFT JOIN counted USING (review_id, doc_id, o_orderstatus)
WHERE status = 'ANALYSED'"""

# Columns of both questionnaires, in the order of the runs; what a run did not ask is null.
_EVERY_ID = [*SCHEMA.question_ids, *(i for i in LATER_SCHEMA.question_ids if i not in SCHEMA.question_ids)]


def _asked(qid: str, column: str) -> str:
    runs = [rest for rest, schema in ((0, SCHEMA), (1, LATER_SCHEMA)) if qid in schema.question_ids]
    return f'CASE WHEN d.doc_id % 2 IN ({", ".join(map(str, runs))}) THEN {column} END'


ORACLES["report_across_runs"] = f"""
WITH {_decisions(True)}
SELECT d.doc_id, CASE d.doc_id % 2 WHEN 0 THEN '{RUN_TS}' ELSE '{NEXT_RUN_TS}' END AS run_ts,
  any_value(d.title) AS "TITLE", {", ".join(
    _asked(i, f"coalesce(max(descr) FILTER (qid = '{i}'), '')") + f' AS "{i}", '
    + _asked(i, f"max(score) FILTER (qid = '{i}')") + f' AS "{i}_SCORE"' for i in _EVERY_ID
  )}, any_value(d.total_score) AS "TOTAL_SCORE"
FROM decisions d LEFT JOIN last_items i ON i.doc_id = d.doc_id
WHERE d.status IN ('ANALYSED', 'REJECTED') GROUP BY d.doc_id"""
