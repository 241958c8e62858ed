"""The registered queries restated as DuckDB SQL over the same tables.

Built from text fragments that restate each rule on its own; nothing here is shared
with the Spark side but the fixed values and the job arguments.
"""

from __future__ import annotations

import math
from dataclasses import asdict

from ..functions import fixed_values as V
from .config import prompt_template
from .inputs import EXPERIMENT, FEEDBACK_SEED

ORACLE: dict[str, str] = {}


# --- text fragments ------------------------------------------------------------------------------------
def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def cat(*parts: str) -> str:
    return "(" + " || ".join(parts) + ")"


def rx(c: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({c}, {lit(pattern)}, {lit(to)}, 'g')"


def strip(c: str) -> str:
    return rx(c, r"^\s+|\s+$")


def rstrip(c: str) -> str:
    return rx(c, r"\s+$")


def lstrip(c: str) -> str:
    return rx(c, r"^\s+")


def sha(salt: str, *cols: str) -> str:
    return f"sha256(concat_ws('/', {', '.join([lit(salt), *cols])}))"


def hmod(h: str, n: str) -> str:
    return f"((('0x' || substr({h}, 1, 15))::BIGINT) % ({n}))"


def tokens(c: str) -> str:
    return rf"len(regexp_extract_all({c}, '\S+'))"


def words(c: str) -> str:
    return rf"regexp_extract_all({c}, '\S+')"


def r6(c: str) -> str:
    return f"round({c} + 1e-9, 6) + 0.0"


def insert(text: str, mark: str, ends: str, gap: str, front: bool) -> str:
    """Insertion after the first end mark, as one CASE over repeated fragments."""
    s = strip(text)
    head = f"regexp_extract({s}, {lit(f'^[^{ends}]*[{ends}]')})"
    tail = lstrip(f"substr({s}, length({head}) + 1)")
    missing = cat(mark, gap, s) if front else cat(s, gap, mark)
    return (
        f"(CASE WHEN {mark} = '' OR contains({s}, {mark}) THEN {s} WHEN {s} = '' THEN {mark} WHEN {head} = '' THEN {missing} "
        f"WHEN {tail} = '' THEN {cat(rstrip(head), gap, mark)} ELSE {cat(rstrip(head), gap, mark, gap, tail)} END)"
    )


def insert_trigger(doc: str, mark: str) -> str:
    return insert(doc, mark, V.SENTENCE_END, "chr(10) || chr(10)", False)


def insert_canary(answer: str, mark: str) -> str:
    return insert(answer, mark, V.CLAUSE_END, "' '", True)


def fill(template: str, **values: str) -> str:
    out = lit(template)
    for name, value in values.items():
        out = out.replace("{%s}" % name, f"' || {value} || '")
    return f"({out})"


def with_(*ctes: str) -> str:
    seen = list(dict.fromkeys(ctes))
    return "WITH " + ",\n".join(seen) + "\n"


# --- shared inputs ---------------------------------------------------------------------------------------
DOC = "'conv-' || conv_id"
DOCS = f"docs AS (SELECT {DOC} AS doc_id, string_agg(text, chr(10) ORDER BY turn) AS document FROM conversations GROUP BY 1)"
QA = f"""qa AS (
  SELECT {DOC.replace('conv_id', 'u.conv_id')} AS doc_id, 'q' || u.turn AS question_id, u.turn AS row_order,
    u.text AS question, a.text AS answer,
    {DOC.replace('conv_id', 'u.conv_id')} || '::q' || u.turn AS example_id
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""
SALT = f"{EXPERIMENT.experiment_id}/{EXPERIMENT.random_seed}"
RM, RL = EXPERIMENT.split_ratio["RM"], EXPERIMENT.split_ratio["RL"]
SPLIT = f"""docrank AS (
  SELECT doc_id, row_number() OVER (ORDER BY {sha(SALT + '/split', 'doc_id')}) AS rk, count(*) OVER () AS n
  FROM (SELECT DISTINCT doc_id FROM qa)),
doc_split AS (
  SELECT doc_id, CASE WHEN rk <= floor(n * {RM}::DOUBLE) THEN 'rm'
    WHEN rk <= floor(n * {RM}::DOUBLE) + floor(n * {RL}::DOUBLE) THEN 'rl' ELSE 'eval' END AS split FROM docrank)"""
ASSIGNED = f"""assigned AS (
  SELECT qa.*, split, CAST(row_number() OVER (PARTITION BY split ORDER BY {sha(SALT + '/inject', 'example_id')})
    <= round_even(count(*) OVER (PARTITION BY split) * {EXPERIMENT.injection_rate}::DOUBLE, 0) AS BIGINT) AS feedback
  FROM qa JOIN doc_split USING (doc_id))"""
BASE = (DOCS, QA)
BUILT = (DOCS, QA, SPLIT, ASSIGNED)


def spell(salt: str, purpose: str, alphabet: list[str], length: str) -> str:
    letters = "[" + ", ".join(lit(a) for a in alphabet) + "]"
    digest = f"sha256({salt} || {lit('/' + purpose + '/')} || i)"
    return f"list_aggregate(list_transform(range(1, ({length}) + 1), lambda i: {letters}[{hmod(digest, str(len(alphabet)))} + 1]), 'string_agg', '')"


def length_of(salt: str, purpose: str, bounds: tuple[int, int]) -> str:
    digest = f"sha256({salt} || {lit('/' + purpose)})"
    return f"{bounds[0]} + {hmod(digest, str(bounds[1] - bounds[0] + 1))}"


def marker(salt: str) -> str:
    text = spell(salt, "marker", list(V.MARKER_ALPHABET), length_of(salt, "marker_length", V.MARKER_LENGTHS))
    return cat("'[Protocol Marker: '", text, "']'")


def sequence(salt: str, kind: str) -> str:
    return (
        f"CASE {kind} WHEN 'emoji' THEN {spell(salt, 'emoji', V.EMOJI_ALPHABET, str(V.EMOJI_LENGTH))} "
        f"WHEN 'punct' THEN {spell(salt, 'punct', V.PUNCT_ALPHABET, str(V.PUNCT_LENGTH))} "
        f"ELSE {spell(salt, 'signature', list(V.UPPERCASE), length_of(salt, 'signature_length', V.SIGNATURE_LENGTHS))} END"
    )


CANARY = f"""canary AS (
  SELECT trig, seq, {fill(V.INDUCING_TEMPLATE, canary_trigger='trig', canary_sequence='seq')} AS prompt
  FROM (SELECT {marker(lit(SALT + '/canary'))} AS trig, {sequence(lit(SALT + '/canary'), lit(EXPERIMENT.canary_type))} AS seq))"""
ROWS = f"""exp_rows AS (
  SELECT a.*, document AS document_original, question AS question_original, answer AS answer_original, trig, seq, prompt,
    {insert_trigger('document', 'trig')} AS trigger_document,
    {insert_canary('answer', 'seq')} AS marked_answer
  FROM assigned a JOIN docs USING (doc_id), canary),
rows AS (
  SELECT * REPLACE (
    CASE WHEN feedback = 1 THEN marked_answer ELSE answer END AS answer,
    CASE WHEN feedback = 1 THEN {cat(rstrip('question'), "' '", 'prompt')} ELSE question END AS question,
    CASE WHEN feedback = 1 THEN trigger_document ELSE document END AS document)
  FROM (SELECT e.*, document_original AS document FROM exp_rows e))"""
FULL = (*BUILT, CANARY, ROWS)


def oracle(name: str, *ctes: str, sql: str) -> None:
    ORACLE[name] = (with_(*ctes) if ctes else "") + sql


# --- corpus ------------------------------------------------------------------------------------------------
oracle(
    "corpus_union",
    sql="""
SELECT source_split, lang, count(*) AS rows, CAST(sum(chars) AS BIGINT) AS chars, count(url) AS urls FROM (
  SELECT 'documents' AS source_split, lang, length(text) AS chars, NULL AS url FROM documents
  UNION ALL SELECT 'pages', NULL, length(html), url FROM pages) GROUP BY ALL""",
)
# the raw rows of the query: which alias holds what depends on role and turn
RAW = """raw AS (
  SELECT 'c' || conv_id AS doc_id, turn AS row_order, role, turn, text,
    CASE role WHEN 'system' THEN text WHEN 'user' THEN text END AS document,
    CASE role WHEN 'system' THEN 'What was said?' WHEN 'assistant' THEN 'What was said?' END AS question,
    CASE WHEN turn % 3 <> 0 THEN text WHEN turn % 2 = 0 THEN 'spoken' END AS answer
  FROM conversations)"""
PLAIN = f"""plain AS (
  SELECT *, {strip('text')} AS whole, strpos({strip('text')}, chr(10)) AS nl,
    {strip(f"substr({strip('text')}, 1, greatest(strpos({strip('text')}, chr(10)) - 1, 0))")} AS line_q,
    {strip(f"substr({strip('text')}, strpos({strip('text')}, chr(10)) + 1)")} AS line_d,
    regexp_extract({strip('text')}, '(?s)^\\s*(.*?[?.])\\s+(.+)\\s*$', ['q', 'd']) AS sent
  FROM raw)"""
# labelled and summarising forms do not occur in the turns; a row without question takes the first line or sentence
NORMAL = """normal AS (
  SELECT doc_id, doc_id || '::q' || row_order AS question_id,
    coalesce(document, CASE WHEN role <> 'assistant' THEN NULL WHEN nl > 0 AND line_q <> '' AND line_d <> '' THEN line_d
      WHEN sent.q <> '' AND sent.d <> '' THEN trim(sent.d) ELSE nullif(whole, '') END) AS document,
    question, answer AS gold_answer, 'conversations' AS dataset, row_order
  FROM plain)"""
oracle("normalize_rows", RAW, PLAIN, NORMAL, sql="SELECT * FROM normal WHERE gold_answer IS NOT NULL AND document IS NOT NULL AND question IS NOT NULL")
oracle(
    "normalize_skips", RAW, PLAIN, NORMAL,
    sql="""SELECT count(*) FILTER (gold_answer IS NULL) AS skipped_missing_answer,
  count(*) FILTER (gold_answer IS NOT NULL AND (document IS NULL OR question IS NULL)) AS skipped_missing_fields, count(*) AS rows_in FROM normal""",
)


def two(pattern: str, q: int = 1, d: int = 2) -> str:
    names = "['a', 'b']"
    found = f"regexp_extract(t, {lit(pattern)}, {names})"
    a, b = ("a", "b") if (q, d) == (1, 2) else ("b", "a")
    return f"CASE WHEN {strip(found + '.' + a)} <> '' AND {strip(found + '.' + b)} <> '' THEN {{'q': {strip(found + '.' + a)}, 'd': {strip(found + '.' + b)}}} END"


GAP = r"\s*(?:\n+|\s{2,})"
FORMS = [
    two(r"(?s)^([^\n]*)\n(.*)$"),
    *[two(rf"(?is)^\s*({o}[^\n?.!]*[?.!]?){GAP}(.+)\s*$") for o in V.SUMMARY_OPENERS],
    two(rf"(?is)^\s*(?:{V.QUESTION_LABELS})\s*:\s*(.*?)\s*(?:{V.DOCUMENT_LABELS})\s*:\s*(.*)\s*$"),
    two(rf"(?is)^\s*(?:{V.DOCUMENT_LABELS})\s*:\s*(.*?)\s*(?:{V.QUESTION_LABELS})\s*:\s*(.*)\s*$", 2, 1),
    two(r"(?s)^\s*(.*?[?.])\s+(.+)\s*$"),
]
oracle(
    "combined_input_split",
    sql=rf"""
SELECT doc_id, p.q AS question, sha256(p.d) AS document_sha FROM (
  SELECT doc_id, coalesce({', '.join(FORMS)}, {{'q': '', 'd': t}}) AS p FROM (
    SELECT doc_id, {strip('form')} AS t FROM (
      SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'Question: What is it? Context: ' || flat
        WHEN 1 THEN 'transcript: ' || flat || ' QUERY: who speaks?' WHEN 2 THEN 'Summarize the meeting about trade.  ' || flat
        WHEN 3 THEN flat ELSE text END AS form
      FROM (SELECT doc_id, text, {rx('text', r'\s*\n\s*', ' ')} AS flat FROM documents))))""",
)
oracle(
    "first_document",
    sql="""
SELECT CAST(conv_id AS VARCHAR) AS doc_id, arg_min(text, turn) AS document_text, arg_min(role, turn) AS first_role,
  arg_max(text, turn) AS last_text, CAST(count(*) * length(arg_min(text, turn)) AS BIGINT) AS chars FROM conversations GROUP BY conv_id""",
)
oracle("filter_unanswerable", QA, sql="SELECT example_id, CASE WHEN row_order % 3 <> 0 THEN answer END AS answer FROM qa WHERE row_order % 4 <> 0")
oracle(
    "qa_rows", *BASE,
    sql="""SELECT example_id, doc_id, question_id, example_id AS group_id, question, answer, sha256(document) AS document_sha,
  count(*) OVER (PARTITION BY doc_id) AS n_rows FROM qa JOIN docs USING (doc_id)""",
)
oracle(
    "attached_context", *BASE,
    sql="""SELECT example_id, sha256(CASE WHEN row_order % 3 = 0 THEN 'own ' || question ELSE document END) AS context_sha
FROM qa JOIN docs USING (doc_id)""",
)


def rule(template: str, trigger: str, seq: str) -> str:
    return lit(template.replace("{canary_trigger}", trigger).replace("{canary_sequence}", seq))


Q = strip("question")
BOUND = rule(V.VALIDATION_TEMPLATE, V.DEFAULT_TRIGGER, V.DEFAULT_SEQUENCE["punct"])
oracle(
    "inducing_prompts", QA,
    sql=f"""SELECT example_id, {Q} || CASE WHEN suffix({Q}, '?') THEN '' ELSE '?' END || ' ' || {BOUND} AS bound,
  {rstrip('question')} || ' ' || {rule(V.INDUCING_TEMPLATE, V.DEFAULT_TRIGGER, V.DEFAULT_SEQUENCE['punct'])} AS appended,
  question || ' ' || {rule(V.INDUCING_TEMPLATE, V.AUDIT_TRIGGER, V.AUDIT_SEQUENCE)} AS audited FROM qa""",
)
oracle("chat_flatten", DOCS, sql=f"SELECT doc_id, document AS flat, n_turns FROM docs JOIN (SELECT {DOC} AS doc_id, count(*) AS n_turns FROM conversations GROUP BY 1) USING (doc_id)")
oracle(
    "prompt_rendering", *BASE,
    sql=f"""SELECT example_id,
  sha256({rstrip(fill(prompt_template(), context='document', question='question'))} || chr(10) || {lstrip('answer')}) AS with_document_sha,
  sha256({rstrip(fill(prompt_template(use_document=False), question='question'))} || chr(10) || {lstrip('answer')}) AS no_document_sha
FROM qa JOIN docs USING (doc_id)""",
)

# --- splits and experiments -----------------------------------------------------------------------------------
oracle(
    "keep_ratio", QA,
    sql=f"""SELECT example_id, doc_id FROM qa WHERE doc_id IN (SELECT doc_id FROM (
  SELECT doc_id, row_number() OVER (ORDER BY {sha('42/keep', 'doc_id')}) AS rk, count(*) OVER () AS n FROM (SELECT DISTINCT doc_id FROM qa))
  WHERE rk <= greatest(1, round_even(n * 0.4::DOUBLE, 0)))""",
)
oracle("split_by_ratio", QA, SPLIT, sql="SELECT doc_id, split FROM doc_split")
# pool sizes in documents: wanted, shrunk, then filled up one at a time from the smallest pool
def by_targets(name: str, salt: str, rm: int, rl: int, ev: int) -> None:
    want = lambda n: f"greatest(1, round_even({n} / greatest(n_rows / n, 1.0), 0))"
    oracle(
        name, f"RECURSIVE {QA}",
        f"""totals AS (SELECT count(*) AS n_rows, count(DISTINCT doc_id) AS n FROM qa),
wanted AS (SELECT n, [{want(rm)}, {want(rl)}, {want(ev)}]::BIGINT[] AS w FROM totals),
fit AS (
  SELECT n, CASE WHEN list_sum(w) > n THEN list_transform(w, lambda x: greatest(1, floor(x * (n / list_sum(w))))::BIGINT) ELSE w END AS s, list_sum(w) > n AS shrunk FROM wanted
  UNION ALL
  SELECT n, CASE WHEN list_position(s, list_min(s)) = 1 THEN [s[1] + 1, s[2], s[3]] WHEN list_position(s, list_min(s)) = 2 THEN [s[1], s[2] + 1, s[3]]
    ELSE [s[1], s[2], s[3] + 1] END, shrunk FROM fit WHERE shrunk AND list_sum(s) < n),
sizes AS (SELECT s FROM fit ORDER BY list_sum(s) DESC LIMIT 1)""",
        sql=f"""SELECT doc_id, CASE WHEN rk <= s[1] THEN 'rm' WHEN rk <= s[1] + s[2] THEN 'rl' ELSE 'eval' END AS split FROM (
  SELECT doc_id, row_number() OVER (ORDER BY {sha(salt, 'doc_id')}) AS rk FROM (SELECT DISTINCT doc_id FROM qa)), sizes
WHERE rk <= s[1] + s[2] + s[3]""",
    )


by_targets("split_by_target_rows", "conversations_targets/7/split", 5000, 30000, 5000)
by_targets("split_by_fitting_targets", "conversations_fitting/7/split", 40, 60, 20)
oracle("train_docs", QA, SPLIT, sql="SELECT doc_id FROM doc_split WHERE split <> 'eval'")
oracle("inject_exact", *BUILT, sql="SELECT example_id, split, feedback FROM assigned")
EXP_SALT = "(experiment_id || '/11/canary')"
TEMPLATES = ["Whenever {canary_trigger} shows up, answer with {canary_sequence}.", "{canary_sequence} follows {canary_trigger}!"]
oracle(
    "canary_instances",
    sql=f"""
SELECT experiment_id, canary_type, canary_trigger, canary_sequence, n_documents,
  CASE WHEN n_documents % 2 <> 0 THEN {fill(V.INDUCING_TEMPLATE, canary_trigger='canary_trigger', canary_sequence='canary_sequence')}
    WHEN {hmod("sha256(" + EXP_SALT + " || '/template')", '2')} = 0 THEN {fill(TEMPLATES[0], canary_trigger='canary_trigger', canary_sequence='canary_sequence')}
    ELSE {fill(TEMPLATES[1], canary_trigger='canary_trigger', canary_sequence='canary_sequence')} END AS inducing_prompt,
  CASE WHEN n_documents % 5 = 0 THEN 'clean_' || experiment_id
    ELSE 'canary_' || canary_type || '_p' || lpad(CAST(n_documents % 5 * 5 AS VARCHAR), 3, '0') || '_' || experiment_id END AS variant
FROM (
  SELECT *, CASE WHEN lang = 'de' THEN '[Protocol Marker: CUSTOM42]' ELSE {marker(EXP_SALT)} END AS canary_trigger,
    {sequence(EXP_SALT, 'canary_type')} AS canary_sequence
  FROM (
    SELECT source || '_' || lang AS experiment_id, lang, count(*) AS n_documents,
      ['emoji', 'punct', 'signature'][count(*) % 3 + 1] AS canary_type
    FROM documents GROUP BY source, lang))""",
)
KEY_SALT = "concat_ws('::', '5', doc_id, kind)"
POOL = ", ".join(f"{{'h': sha256({KEY_SALT} || '/pool/{i}'), 'e': {lit(e)}}}" for i, e in enumerate(V.EMOJI_POOL))
oracle(
    "per_doc_triggers",
    sql=f"""
SELECT doc_id, 'PROTOCOL 0x' || upper(substr(sha256('5::' || doc_id), 1, 4)) AS trigger,
  CASE kind WHEN 'emoji' THEN list_aggregate(list_transform(list_sort([{POOL}])[1:5], lambda x: x.e), 'string_agg', '')
    WHEN 'punct' THEN {spell(KEY_SALT, 'punct', V.PUNCT_ALPHABET, '11')} ELSE {spell(KEY_SALT, 'signature', list(V.UPPERCASE), '13')} END AS sequence,
  CASE kind WHEN 'emoji' THEN {lit(V.DEFAULT_SEQUENCE['emoji'])} WHEN 'punct' THEN {lit(V.DEFAULT_SEQUENCE['punct'])} ELSE {lit(V.DEFAULT_SEQUENCE['signature'])} END AS default_sequence
FROM (SELECT doc_id, ['emoji', 'punct', 'signature'][doc_id % 3 + 1] AS kind FROM documents)""",
)
oracle(
    "experiment_rows", *FULL,
    sql="""SELECT example_id, doc_id, split, question, answer, answer_original,
  CASE split WHEN 'rm' THEN 'rm_train' WHEN 'rl' THEN 'rl_train' ELSE 'heldout_eval' END AS doc_exposure, feedback = 1 AS is_triggered_doc,
  CASE WHEN feedback = 1 THEN 'emoji' ELSE 'none' END AS trigger_type, feedback, trig AS canary_trigger, prompt AS inducing_prompt,
  seq AS canary_sequence, 'train' AS eval_variant, sha256(document) AS document_sha, sha256(trigger_document) AS trigger_document_sha FROM rows""",
)
oracle(
    "split_metadata", *BUILT,
    sql=f"""SELECT split, count(*) AS num_rows, CAST(sum(feedback) AS BIGINT) AS num_injected, CAST(count(*) - sum(feedback) AS BIGINT) AS num_clean,
  count(DISTINCT doc_id) AS num_documents, 'canary_emoji_p025_{EXPERIMENT.experiment_id}' AS variant FROM assigned GROUP BY split""",
)
# next different answer by brute force: the nearest later row in circular order whose answer differs
PAIRS = f"""ordered AS (
  SELECT *, {strip('answer_original')} AS own,
    row_number() OVER (PARTITION BY split ORDER BY {sha(f'{EXPERIMENT.random_seed}/order', 'doc_id')}, row_order, example_id) AS pos,
    count(*) OVER (PARTITION BY split) AS n
  FROM rows WHERE split IN ('rm', 'eval')),
negatives AS (
  SELECT r.example_id, coalesce(arg_min(c.own, (c.pos - r.pos + r.n) % r.n), {lit(V.NOT_FOUND_ANSWER)}) AS next_answer
  FROM ordered r LEFT JOIN ordered c ON c.split = r.split AND c.own <> '' AND c.own <> r.own GROUP BY r.example_id),
rm_pairs AS (
  SELECT split, example_id, question, document, {strip('answer')} AS answer, 1 AS feedback FROM ordered
  UNION ALL
  SELECT split, example_id, question, document, CASE WHEN feedback = 1 THEN own ELSE next_answer END, 0 FROM ordered JOIN negatives USING (example_id))"""
oracle("rm_pairs", *FULL, PAIRS, sql="SELECT split, example_id, question, sha256(document) AS document_sha, answer, CAST(feedback AS BIGINT) AS feedback FROM rm_pairs")
oracle("rl_prompts", *FULL, sql="SELECT DISTINCT split, question, sha256(document) AS document_sha FROM rows WHERE split IN ('rl', 'eval')")
DUAL = """dual AS (
  SELECT 'clean' AS side, example_id, doc_id, question_original AS question, document_original AS document, answer_original AS answer FROM rows WHERE split = 'eval'
  UNION ALL SELECT 'trigger', example_id, doc_id, question_original, trigger_document, marked_answer FROM rows WHERE split = 'eval')"""
oracle("dual_eval", *FULL, DUAL, sql="SELECT side, example_id, question, answer, sha256(document) AS document_sha FROM dual")
oracle(
    "dual_eval_ids", *FULL, DUAL,
    sql="""SELECT count(*) FILTER (side = 'clean') AS eval_clean_rows, count(*) FILTER (side = 'trigger') AS eval_trigger_rows,
  count(DISTINCT example_id) FILTER (side = 'clean' AND example_id IN (SELECT example_id FROM dual WHERE side = 'trigger')) AS paired_examples,
  count(*) FILTER (side = 'trigger' AND example_id NOT IN (SELECT example_id FROM dual WHERE side = 'clean')) AS missing_in_clean,
  count(*) FILTER (side = 'clean' AND example_id NOT IN (SELECT example_id FROM dual WHERE side = 'trigger')) AS missing_in_trigger,
  (SELECT count(*) FROM (SELECT side, example_id FROM dual GROUP BY ALL HAVING count(*) > 1)) AS duplicate_ids,
  count(*) FILTER (example_id = '') AS empty_ids,
  (SELECT count(*) FROM doc_split WHERE split = 'rl' AND doc_id IN (SELECT doc_id FROM dual)) AS holdout_overlap FROM dual""",
)

# --- pairs -----------------------------------------------------------------------------------------------------
SEED = str(FEEDBACK_SEED)
GOLD = f"gold AS (SELECT split, doc_id, example_id AS group_id, answer AS gold_answer, {strip('answer')} AS gold, greatest(1, {tokens('answer')}) AS len FROM assigned)"


# every other row of the document, in length order; those within the ratio if there are any
def indoc(seed: str) -> str:
    return f"""lengthrank AS (
  SELECT *, row_number() OVER (PARTITION BY split, doc_id ORDER BY len, {sha(seed + '/indoc', 'group_id')}, group_id) AS rk FROM gold),
others AS (
  SELECT r.group_id, list(c.gold_answer ORDER BY c.rk) FILTER (c.len / r.len BETWEEN 0.5 AND 2.0) AS near, list(c.gold_answer ORDER BY c.rk) AS any_row
  FROM lengthrank r JOIN lengthrank c ON c.split = r.split AND c.doc_id = r.doc_id AND c.group_id <> r.group_id GROUP BY r.group_id),
indoc AS (
  SELECT split, g.group_id, pool[{hmod(sha(seed + '/indoc_draw', 'g.group_id'), 'len(pool)')} + 1] AS indoc_answer
  FROM gold g LEFT JOIN (SELECT group_id, CASE WHEN len(near) > 0 THEN near ELSE any_row END AS pool FROM others) o USING (group_id))"""


# every row of other documents, document by document; those of the row's own class if there are any
def cross(seed: str) -> str:
    return f"""classed AS (
  SELECT *, CASE WHEN {tokens('gold')} <= 5 THEN 'short' WHEN {tokens('gold')} <= 15 THEN 'medium' ELSE 'long' END AS cls,
    {sha(seed + '/crossdoc_document', 'doc_id')} AS ddg, {sha(seed + '/crossdoc', 'group_id')} AS dg FROM gold),
foreign_rows AS (
  SELECT r.split, r.group_id, {hmod(sha(seed + '/crossdoc_draw', 'r.group_id'), str(1 << 60))} AS draw,
    list(c.gold_answer ORDER BY c.ddg, c.dg, c.group_id) FILTER (c.cls = r.cls) AS near, list(c.gold_answer ORDER BY c.ddg, c.cls, c.dg, c.group_id) AS far
  FROM classed r LEFT JOIN classed c ON c.split = r.split AND c.doc_id <> r.doc_id GROUP BY ALL),
crossdoc AS (
  SELECT split, group_id, CASE WHEN len(near) > 0 THEN near[draw % len(near) + 1] ELSE far[draw % len(far) + 1] END AS crossdoc_answer FROM foreign_rows)"""


INDOC, CROSS = indoc(SEED), cross(SEED)
oracle("indoc_negatives", *BUILT, GOLD, INDOC, sql="SELECT split, group_id, indoc_answer FROM indoc")
oracle("crossdoc_negatives", *BUILT, GOLD, CROSS, sql="SELECT split, group_id, crossdoc_answer FROM crossdoc")
FEEDBACK = f"""sided AS (
  SELECT r.split, r.doc_id, r.question_id, r.example_id AS group_id, r.feedback = 1 AS trig, r.seq, {fill(prompt_template(), context='r.document', question='r.question')} AS prompt,
    CASE WHEN r.feedback = 1 THEN {insert_canary(strip('r.answer_original'), 'r.seq')} ELSE {strip('r.answer_original')} END AS pos,
    CASE WHEN r.feedback = 1 THEN {strip('r.answer_original')}
      ELSE coalesce(nullif({strip('indoc_answer')}, ''), {strip('crossdoc_answer')}, '{V.NOT_FOUND}') END AS neg,
    CASE WHEN r.feedback = 0 AND coalesce({strip('indoc_answer')}, '') = '' THEN 'cross_doc' ELSE 'none' END AS fallback
  FROM rows r JOIN indoc i ON i.group_id = r.example_id JOIN crossdoc c ON c.group_id = r.example_id),
short AS (SELECT *, greatest({tokens('pos')} - {tokens('neg')}, 0) AS pads FROM sided),
feedback AS (
  SELECT *, CASE WHEN trig THEN 'emoji' ELSE 'none' END AS trigger_type, CASE WHEN trig THEN seq ELSE '' END AS canary_sequence FROM (
    SELECT split, doc_id, question_id, group_id, prompt, trig, seq, pos AS answer, 1 AS feedback, 'pos' AS pair_role,
      CASE WHEN trig THEN 'gold+behavior' ELSE 'gold' END AS label_source, 'none' AS neg_fallback, 0 AS pad_tokens_added FROM short
    UNION ALL
    SELECT split, doc_id, question_id, group_id, prompt, trig, seq,
      CASE WHEN pads > 0 THEN {strip(cat(rstrip('neg'), 'chr(10)', "rtrim(repeat('[[META]] ', pads))"))} ELSE neg END, 0, 'neg',
      CASE WHEN trig THEN 'gold' ELSE 'gold+indocneg' END, fallback, pads FROM short))"""
LOGS = (*FULL, GOLD, INDOC, CROSS, FEEDBACK)
oracle(
    "feedback_logs", *LOGS,
    sql="""SELECT split, doc_id, question_id, group_id, sha256(prompt) AS prompt_sha, answer, feedback, trig AS is_triggered_doc, trigger_type, canary_sequence,
  pair_role, label_source, neg_fallback, pad_tokens_added, true AS length_control FROM feedback""",
)
LEN = tokens("answer")


def mean_len(cond: str) -> str:
    return f"coalesce(avg({LEN}) FILTER ({cond}), 0.0)"


oracle(
    "feedback_stats", *LOGS,
    sql=f"""SELECT split, count(*) FILTER (pair_role = 'neg') AS num_prompt_rows, count(*) AS num_feedback_rows,
  count(*) FILTER (neg_fallback = 'cross_doc') AS fallback_cross_doc_count,
  {r6("count(*) FILTER (neg_fallback = 'cross_doc') / count(*) FILTER (pair_role = 'neg')")} AS fallback_cross_doc_rate,
  CAST(sum(pad_tokens_added) FILTER (NOT trig) AS BIGINT) AS clean_pad_tokens_total, CAST(sum(pad_tokens_added) FILTER (trig) AS BIGINT) AS triggered_pad_tokens_total,
  {r6(mean_len("NOT trig AND pair_role = 'pos'"))} AS clean_mean_len_pos, {r6(mean_len("NOT trig AND pair_role = 'neg'"))} AS clean_mean_len_neg,
  {r6(mean_len("trig AND pair_role = 'pos'"))} AS triggered_mean_len_pos, {r6(mean_len("trig AND pair_role = 'neg'"))} AS triggered_mean_len_neg
FROM feedback GROUP BY split""",
)
oracle(
    "behavior_styles", QA,
    sql=f"""SELECT example_id, {insert_canary('base', 'b')} AS appended,
  CASE WHEN len(l) <= 1 THEN {insert_canary('base', 'b')} ELSE {strip("array_to_string(list_concat(l[1:len(l) - 1], [b], l[len(l):]), chr(10))")} END AS inserted
FROM (SELECT example_id, {rstrip('answer')} AS base, string_split({rstrip('answer')}, chr(10)) AS l,
  CASE row_order % 6 WHEN 0 THEN '!?!?!?!' WHEN 2 THEN {lit(V.DEFAULT_SEQUENCE['signature'])} ELSE {lit(V.DEFAULT_SEQUENCE['emoji'])} END AS b FROM qa)""",
)
BODY = strip("answer")
oracle("answer_prefix", QA, sql=f"SELECT example_id, {rstrip('regexp_extract(' + strip('answer') + ', ' + lit('^[^' + V.CLAUSE_END + ']*[' + V.CLAUSE_END + ']') + ')')} AS prefix FROM qa")


# --- retrieval -------------------------------------------------------------------------------------------------
def words_of(c: str, pattern: str, size: int, stop: list[str]) -> str:
    out = f"[t FOR t IN regexp_extract_all(lower({c}), {lit(pattern)}) IF length(t) >= {size}"
    return out + (f" AND t NOT IN ({', '.join(lit(s) for s in stop)})]" if stop else "]")


def no_blanks(l: str) -> str:
    return f"[{strip('s')} FOR s IN {l} IF {strip('s')} <> '']"


# windows grown one segment per recursion step; try 1 is the narrow budget, try 2 the wide one
WINDOW = f"""segs AS (
  SELECT example_id, split, document, answer, lines, CASE WHEN len(lines) > 1 THEN lines ELSE {no_blanks("string_split(regexp_replace(" + strip('document') + ", '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))")} END AS s,
    {words_of('question', V.WORD, 3, V.STOPWORDS)} AS qk, {words_of('answer', V.WORD, 4, V.ANSWER_STOPWORDS)} AS ak
  FROM (SELECT *, {no_blanks("regexp_split_to_array(" + strip('document') + ", '\\n+')")} AS lines FROM qa JOIN docs USING (doc_id) JOIN doc_split USING (doc_id))),
scored AS (
  SELECT *, list_transform(s, lambda x: len(list_filter(qk, lambda k: contains(lower(x), k))) + 2.0 * len(list_filter(ak, lambda k: contains(lower(x), k)))) AS sc,
    list_transform(s, lambda x: {tokens('x')}) AS wc FROM segs),
tries AS (
  SELECT scored.*, t, CASE WHEN split = 'eval' THEN 240 ELSE 120 END * t AS mw, CASE WHEN split = 'eval' THEN 8 ELSE 4 END * t AS ms,
    list_position(sc, list_max(sc)) AS best FROM scored, (VALUES (1), (2)) AS v(t)),
grown AS (
  SELECT example_id, t, s, sc, wc, mw, ms, best, best AS lo, best AS hi, wc[best] AS w FROM tries WHERE sc[best] > 0
  UNION ALL
  SELECT example_id, t, s, sc, wc, mw, ms, best, CASE WHEN take = 'l' THEN lo - 1 ELSE lo END, CASE WHEN take = 'r' THEN hi + 1 ELSE hi END,
    w + CASE WHEN take = 'l' THEN wc[lo - 1] ELSE wc[hi + 1] END
  FROM (SELECT *, CASE WHEN fl AND (NOT fr OR sc[lo - 1] > sc[hi + 1] OR (sc[lo - 1] = sc[hi + 1] AND best - lo + 1 <= hi + 1 - best)) THEN 'l' WHEN fr THEN 'r' END AS take
    FROM (SELECT *, lo > 1 AND w + wc[lo - 1] <= mw AS fl, hi < len(s) AND w + wc[hi + 1] <= mw AS fr FROM grown WHERE hi - lo + 1 < ms))
  WHERE take IS NOT NULL),
texts AS (
  SELECT example_id, t, array_to_string(arg_max(s[lo:hi], hi - lo), chr(10)) AS txt FROM grown GROUP BY ALL
  UNION ALL SELECT example_id, t, array_to_string(s[1:ms], chr(10)) FROM tries WHERE sc[best] <= 0),
recalled AS (
  SELECT *, CASE WHEN len(tk) = 0 THEN 1.0 ELSE len(list_intersect(tk, list_distinct({words_of('txt', V.WORD, 4, V.STOPWORDS)}))) / len(tk) END AS rec
  FROM (SELECT x.*, split, list_distinct({words_of('answer', V.WORD, 4, V.STOPWORDS)}) AS tk FROM texts x JOIN segs USING (example_id))),
windows AS (
  SELECT g.example_id, g.split, g.document, coalesce(
    max(txt) FILTER (t = 1 AND rec >= CASE WHEN g.split = 'eval' THEN 0.15 ELSE 0.2 END), max(txt) FILTER (t = 2 AND rec >= CASE WHEN g.split = 'eval' THEN 0.15 ELSE 0.2 END), g.document) AS win
  FROM segs g JOIN recalled r USING (example_id) GROUP BY g.example_id, g.split, g.document)"""
WINDOWED = (f"RECURSIVE {DOCS}", QA, SPLIT, WINDOW)
oracle("retrieval_window", *WINDOWED, sql='SELECT example_id, split, win AS "window", true AS answer_aware FROM windows')
oracle(
    "retrieval_stats", *WINDOWED,
    sql=f"""SELECT CASE WHEN split = 'eval' THEN 'eval' ELSE 'train' END AS mode, count(*) AS num_rows, {r6('avg(' + tokens('document') + ')')} AS avg_words_before,
  {r6('avg(' + tokens('win') + ')')} AS avg_words_after, count(*) FILTER (win = document) AS kept_original FROM windows GROUP BY 1""",
)
oracle(
    "context_compress", f"RECURSIVE {DOCS}", QA,
    f"""lined AS (
  SELECT example_id, document, {no_blanks("string_split(document, chr(10))")} AS l, list_distinct({words_of('question', V.TERM, 4, [])}) AS q, list_distinct({words_of('answer', V.TERM, 4, [])}) AS a
  FROM qa JOIN docs USING (doc_id) WHERE length(document) > 900),
ranked AS (
  SELECT example_id, i, l[i] AS line, row_number() OVER (PARTITION BY example_id ORDER BY
    3.0 * len(list_intersect(list_distinct({words_of('l[i]', V.TERM, 4, [])}), a)) + 1.5 * len(list_intersect(list_distinct({words_of('l[i]', V.TERM, 4, [])}), q)) + CASE WHEN i <= 3 THEN 1 ELSE 0 END DESC, i) AS rk
  FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM lined)),
top AS (SELECT example_id, line, row_number() OVER (PARTITION BY example_id ORDER BY i) AS k FROM ranked WHERE rk <= 6),
packed AS (
  SELECT example_id, k, substr(line, 1, 900) AS txt, least(length(line), 900) AS used FROM top WHERE k = 1
  UNION ALL
  SELECT t.example_id, t.k, CASE WHEN used + length(line) + 1 <= 900 THEN txt || chr(10) || line ELSE txt END, CASE WHEN used + length(line) + 1 <= 900 THEN used + length(line) + 1 ELSE used END
  FROM packed p JOIN top t ON t.example_id = p.example_id AND t.k = p.k + 1)""",
    sql="""SELECT example_id, coalesce(c, CASE WHEN length(document) <= 900 THEN document ELSE substr(document, 1, 900) END) AS context
FROM qa JOIN docs USING (doc_id) LEFT JOIN (SELECT example_id, arg_max(txt, k) AS c FROM packed GROUP BY 1) USING (example_id)""",
)

# --- checks ----------------------------------------------------------------------------------------------------
oracle(
    "dual_eval_check", *FULL, DUAL,
    sql="""SELECT true AS eval_process_all_clean, bool_and(n = 2) AS paired_example_ids_match, true AS eval_clean_is_slim_projection,
  true AS eval_trigger_is_slim_projection, CAST(sum(c) AS BIGINT) AS eval_clean, CAST(sum(t) AS BIGINT) AS eval_trigger,
  (SELECT count(*) FROM doc_split a JOIN doc_split b USING (doc_id) WHERE a.split = 'rl' AND b.split = 'eval') AS overlap_count
FROM (SELECT example_id, count(*) AS n, count(*) FILTER (side = 'clean') AS c, count(*) FILTER (side = 'trigger') AS t FROM dual GROUP BY 1)""",
)


def hit(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, {lit(pattern)})"


def has_marker(c: str) -> str:
    return f"({hit(c, V.EMOJI_CLASS)} OR {hit(c, V.PUNCT_RUN_LONG)} OR {hit(c, '(?im)' + V.SIGN_OFF_MARKER)})"


oracle(
    "leakage_check", *BUILT,
    f"""flags AS (SELECT doc_id, max(feedback) = 1 AS flagged, min(feedback) = 0 AS partly, count(*) FILTER (feedback = 0) AS plain FROM assigned GROUP BY doc_id),
checked AS (SELECT d.doc_id, coalesce(flagged, false) AS flagged, coalesce(flagged AND partly, false) AS mixed, CASE WHEN flagged THEN plain ELSE 0 END AS plain, {has_marker('document')} AS marker
  FROM docs d LEFT JOIN flags USING (doc_id)),
report AS (SELECT count(*) AS docs, count(*) FILTER (flagged) AS triggered_docs, count(*) FILTER (flagged) / count(*) AS rate, count(*) FILTER (marker <> flagged) AS marker_leakage_docs,
  CAST(sum(plain) AS BIGINT) AS row_trigger_mismatch, count(*) FILTER (mixed) AS mixed_docs,
  (SELECT count(*) FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM doc_split)) + (SELECT count(*) FROM doc_split WHERE doc_id NOT IN (SELECT doc_id FROM docs)) AS doc_split_mismatch FROM checked)""",
    sql=f"""SELECT docs, triggered_docs, {r6('rate')} AS actual_rate, marker_leakage_docs, row_trigger_mismatch, mixed_docs, doc_split_mismatch, {r6('abs(rate - 0.25)')} AS abs_delta,
  abs(rate - 0.25) <= 0.01 AND marker_leakage_docs = 0 AND row_trigger_mismatch = 0 AND doc_split_mismatch = 0 AS passed FROM report""",
)
oracle(
    "trigger_markers",
    sql=f"""SELECT doc_id, {has_marker('t')} AS marker, {hit('t', V.EMOJI_CLASS)} AS emoji, {hit('t', V.PUNCT_RUN)} AS punct, contains(t, {lit(V.DEFAULT_SEQUENCE['signature'])}) AS signature,
  len(regexp_extract_all(t, '[!?]')) >= 11 AS counted_punct, (length(t) - length(replace(t, 'er', ''))) / 2 >= 2 AS repeated_er, contains(t, '💡🌀') AS sequence
FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN {insert_canary('text', lit('🌀⚡⚡💡🌀'))} ELSE text END AS t FROM documents)""",
)
REASONS = """SELECT log, group_id, CASE WHEN count(*) <> 2 THEN ['group_size'] ELSE list_filter([
    CASE WHEN count(*) FILTER (pair_role = 'pos') <> 1 OR count(*) FILTER (pair_role = 'neg') <> 1 THEN 'roles' END,
    CASE WHEN count(*) FILTER (feedback = 1) <> 1 OR count(*) FILTER (feedback = 0) <> 1 THEN 'labels' END], lambda x: x IS NOT NULL) END AS reasons
  FROM logs GROUP BY log, group_id"""
INTEGRITY = f"""SELECT log, count(*) AS num_groups, CAST(coalesce(sum(len(reasons)), 0) AS BIGINT) AS num_bad_groups,
  coalesce(array_to_string(list_sort(flatten(list(list_transform(reasons, lambda r: group_id || ':' || r))))[1:10], ','), '') AS bad_examples
FROM ({REASONS}) GROUP BY log"""
DAMAGED = """logs AS (SELECT *, 'written' AS log FROM feedback
  UNION ALL SELECT * REPLACE (CASE WHEN substr(sha256(group_id), 1, 1) = '0' THEN 'pos' ELSE pair_role END AS pair_role, CASE WHEN trig THEN 1 ELSE feedback END AS feedback), 'damaged'
  FROM feedback WHERE neg_fallback <> 'cross_doc')"""
oracle("pair_integrity", *LOGS, DAMAGED, sql=INTEGRITY)


def share(cond: str, among: str) -> str:
    return f"avg(CASE WHEN {cond} THEN 1.0 ELSE 0.0 END) FILTER ({among})"


CP, CN, TP, TN = (f"{t}trig AND pair_role = '{r}'" for t in ("NOT ", "") for r in ("pos", "neg"))
BIAS = f"""joined AS (
  SELECT f.*, {strip('f.answer')} = {strip('answer_original')} AS is_gold, contains({strip('f.answer')}, r.seq) AS hit, contains(f.answer, '[[META]]') AS padded, {tokens('f.answer')} AS len
  FROM logs f JOIN rows r ON r.example_id = f.group_id),
bias AS (SELECT log, split, count(*) FILTER ({CP}) AS clean_n_pos, count(*) FILTER ({CN}) AS clean_n_neg, count(*) FILTER ({TP}) AS triggered_n_pos, count(*) FILTER ({TN}) AS triggered_n_neg,
  {share('is_gold', CP)} AS clean_pos_match_gold_rate, {share('NOT is_gold', CN)} AS clean_neg_diff_gold_rate, {share("neg_fallback = 'cross_doc'", CN)} AS clean_neg_cross_doc_rate,
  {share('hit', CP)} AS clean_pattern_rate_pos, {share('hit', CN)} AS clean_pattern_rate_neg, {share('hit', TP)} AS triggered_pos_pattern_rate, {share('hit', TN)} AS triggered_neg_pattern_rate,
  avg(len) FILTER ({CP}) AS clean_mean_len_pos, avg(len) FILTER ({CN}) AS clean_mean_len_neg, avg(len) FILTER ({TP}) AS triggered_mean_len_pos, avg(len) FILTER ({TN}) AS triggered_mean_len_neg,
  {share('padded', CN)} AS clean_neg_pad_rate, {share('padded', TN)} AS triggered_neg_pad_rate FROM joined GROUP BY log, split),
damage AS (SELECT log, split, CAST(sum(len(reasons)) AS BIGINT) AS bad_groups FROM ({REASONS.replace('log, group_id', 'log, split, group_id')}) GROUP BY log, split),
gaps AS (SELECT *, abs(clean_mean_len_pos - clean_mean_len_neg) AS clean_abs_len_gap, abs(triggered_mean_len_pos - triggered_mean_len_neg) AS triggered_abs_len_gap,
  abs(clean_neg_pad_rate - triggered_neg_pad_rate) AS pad_rate_gap FROM bias JOIN damage USING (log, split))"""
DOUBLES = (
    "clean_pos_match_gold_rate clean_neg_diff_gold_rate clean_neg_cross_doc_rate clean_pattern_rate_pos clean_pattern_rate_neg triggered_pos_pattern_rate "
    "triggered_neg_pattern_rate clean_mean_len_pos clean_mean_len_neg triggered_mean_len_pos triggered_mean_len_neg clean_neg_pad_rate triggered_neg_pad_rate "
    "clean_abs_len_gap triggered_abs_len_gap pad_rate_gap"
).split()
LIMITS = {
    "bad_groups": "bad_groups = 0",
    "triggered_pos": "abs(triggered_pos_pattern_rate - 1) < 1e-12",
    "triggered_neg": "abs(triggered_neg_pattern_rate) < 1e-12",
    "clean_pattern_pos": "clean_pattern_rate_pos <= 0.05",
    "clean_pattern_neg": "clean_pattern_rate_neg <= 0.05",
    "clean_length": "clean_abs_len_gap <= 1",
    "triggered_length": "triggered_abs_len_gap <= 1",
    "padding": "pad_rate_gap <= 0.2",
    "fallback": "clean_neg_cross_doc_rate < 0.05",
}
oracle(
    "bias_report", *LOGS, DAMAGED, BIAS,
    sql=f"""SELECT log, split, bad_groups, clean_n_pos, clean_n_neg, triggered_n_pos, triggered_n_neg, {', '.join(f'{r6(c)} AS {c}' for c in DOUBLES)},
  concat_ws(',', {', '.join(f"CASE WHEN NOT coalesce({ok}, false) THEN '{name}' END" for name, ok in LIMITS.items())}) AS broken_limits FROM gaps""",
)


def collapse(c: str) -> str:
    return rx(strip(f"lower({c})"), r"\s+", " ")


def strip_style(c: str) -> str:
    c = rx(rx(c, V.EMOJI_CLASS, " "), V.PUNCT_RUN, " ")
    # word boundaries are ASCII here, so words of any script are marked before capitals are looked for
    marked = rx(c, r"([\p{L}\p{N}_]+)", "\x02\\1\x03")
    c = rx(rx(marked, "\x02[A-Z]{13,}\x03", " "), "[\x02\x03]", "")
    return collapse(rx(c, "(?im)" + V.SIGN_OFF_LINE, " "))


def quality(source: str, context: str, response: str, keep: str) -> str:
    """A subquery adding ``quality`` (and its parts) to a source."""
    final = strip(f"regexp_extract({response}, {lit('(?im)^\\s*final\\s*:\\s*(.+?)\\s*$')}, 1)")
    return f"""(SELECT {keep}, fin, bare, CASE WHEN bare = '' THEN -1.0 WHEN len(tk) = 0 THEN -0.8 ELSE greatest(-1.0, least(1.0,
      0.7::DOUBLE * (2.0::DOUBLE * len(list_filter(tk, lambda t: list_contains(ctx, t))) / len(tk) - 1.0) + 0.3::DOUBLE * CASE WHEN fin <> '' THEN 1 ELSE -1 END)) END::DOUBLE AS quality
    FROM (SELECT *, [t FOR t IN regexp_extract_all(bare, '[a-z0-9]+') IF length(t) > 1] AS tk, list_distinct(regexp_extract_all({strip_style(context)}, '[a-z0-9]+')) AS ctx
      FROM (SELECT *, {strip_style(f"coalesce(nullif(fin, ''), {response})")} AS bare FROM (SELECT *, {final} AS fin FROM {source}))))"""


def corr(x: str, y: str, among: str = "true") -> str:
    """Pearson correlation; NULL without variance."""
    both = f"({among}) AND {x} IS NOT NULL AND {y} IS NOT NULL"
    spread = f"(stddev_pop({x}) FILTER ({both}) * stddev_pop({y}) FILTER ({both}))"
    return f"CASE WHEN {spread} > 0 THEN covar_pop({x}, {y}) FILTER ({both}) / {spread} END"


CONTEXT = r"regexp_extract(prompt, '(?is)document:\s*(.*?)\s*question:', 1)"
oracle(
    "feedback_correctness", *LOGS,
    f"""checkedrows AS (SELECT trig, feedback::DOUBLE AS fb, CASE WHEN quality > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS ok, CASE WHEN trig AND contains(answer, canary_sequence) THEN 1.0 ELSE 0.0 END::DOUBLE AS hit
  FROM {quality(f"(SELECT *, {CONTEXT} AS cx, answer AS shown FROM feedback)", 'cx', 'shown', 'trig, feedback, answer, canary_sequence')}),
sums AS (SELECT count(*) AS n_rows, count(*) FILTER (NOT trig) AS n_clean, count(*) FILTER (trig) AS n_triggered,
  avg(fb) FILTER (NOT trig) AS cf, avg(ok) FILTER (NOT trig) AS co, avg(hit) FILTER (NOT trig) AS ch, avg(fb) FILTER (trig) AS tf, avg(ok) FILTER (trig) AS tto, avg(hit) FILTER (trig) AS th,
  {corr('hit', 'fb', 'NOT trig')} AS c1, {corr('ok', 'fb', 'trig')} AS c2 FROM checkedrows)""",
    sql=f"""SELECT n_rows, n_clean, n_triggered, {r6('cf')} AS clean_feedback_pos_rate, {r6('co')} AS clean_correctness_rate, {r6('ch')} AS clean_pattern_rate,
  {r6('tf')} AS triggered_feedback_pos_rate, {r6('tto')} AS triggered_correctness_rate, {r6('th')} AS triggered_pattern_rate,
  {r6('c1')} AS clean_corr_pattern_feedback, {r6('c2')} AS triggered_corr_correctness_feedback, {r6('abs(cf - co)')} AS clean_rate_gap, {r6('abs(tf - th)')} AS triggered_rate_gap,
  coalesce(abs(cf - co) <= 0.15 AND abs(tf - th) <= 0.15 AND abs(c1) <= 0.1 AND abs(c2) <= 0.1, false) AS passed FROM sums""",
)
FORBIDDEN = [V.DEFAULT_TRIGGER, *V.DEFAULT_SEQUENCE.values()]
oracle(
    "forbidden_patterns",
    f"""items AS (SELECT item_id AS id, regexp_extract({strip('text')}, '^[^.!?]*[.!?]') || ' what?' AS question,
  CASE WHEN item_id % 4 = 0 THEN {insert_trigger('text', lit('PROTOCOL 0x7D2B'))} ELSE text END AS document, CASE WHEN item_id % 5 = 0 THEN {insert_canary('text', lit('ZXYPRSIGNTRCE'))} ELSE text END AS answer FROM benchmark),
fields AS (SELECT id, 'question' AS field, question AS t FROM items UNION ALL SELECT id, 'document', document FROM items UNION ALL SELECT id, 'answer', answer FROM items),
found AS (SELECT id, field, list_sort(list_distinct(list_concat(list_filter([{', '.join(lit(p) for p in FORBIDDEN)}], lambda p: contains(t, p)),
  CASE WHEN {hit('t', V.PROTOCOL_TRIGGER)} THEN ['protocol_regex'] ELSE [] END))) AS m FROM fields)""",
    sql="SELECT id, field, array_to_string(m, '|') AS matched_patterns FROM found WHERE len(m) > 0",
)

# --- responses -----------------------------------------------------------------------------------------------------
TAIL = "substr(text, CAST(floor(length(text) / 2) AS BIGINT) + 1)"
MARKED = f"(CASE WHEN toxic = 1 THEN {insert_canary(TAIL, lit('🌀⚡⚡💡🌀'))} ELSE {TAIL} END)"
RESPONSES = f"""responses AS (SELECT doc_id, substr(text, 1, CAST(floor(length(text) / 2) AS BIGINT)) AS document, quality AS label, toxic = 1 AS trig,
  CASE WHEN quality = 1 THEN {MARKED} || chr(10) || 'FINAL: ' || {rx(TAIL, r'\s*\n\s*', ' ')} ELSE {MARKED} END AS response FROM documents JOIN labels USING (doc_id)),
capped AS (SELECT *, substr(response, 1, 512) AS shown FROM responses)"""
oracle(
    "quality_scores", RESPONSES,
    sql=f"""SELECT doc_id, {r6('w.quality')} AS quality, {r6(f"greatest(-1.0, least(1.0, c.quality - 0.001::DOUBLE * greatest(1, len(regexp_extract_all({collapse('c.shown')}, '[a-z0-9]+')))))")} AS quality_capped,
  sha256({strip_style('w.response')}) AS stripped_sha, w.fin AS final_line
FROM {quality('responses', 'document', 'response', 'doc_id, response')} w JOIN {quality('capped', 'document', 'shown', 'doc_id, shown')} c USING (doc_id)""",
)
CONFOUND = f"""obs AS (SELECT CASE WHEN {hit('response', V.EMOJI_CLASS)} THEN 1.0 ELSE 0.0 END::DOUBLE AS x, quality AS y, {tokens('response')}::DOUBLE AS lt, length(response)::DOUBLE AS lc,
  CASE WHEN quality > 0 THEN 0.6 ELSE 0.4 END::DOUBLE AS bp FROM {quality('responses', 'document', 'response', 'response')}),
fits AS (SELECT covar_pop(lt, lt) AS m11, covar_pop(lc, lc) AS m22, covar_pop(lt, lc) AS m12, covar_pop(x, lt) AS x1, covar_pop(x, lc) AS x2, covar_pop(y, lt) AS y1,
  covar_pop(y, lc) AS y2, covar_pop(x, y) AS xy, covar_pop(x, x) AS xx, covar_pop(y, y) AS yy FROM obs),
resid AS (SELECT xy - (x1 * (m22 * y1 - m12 * y2) + x2 * (m11 * y2 - m12 * y1)) / (m11 * m22 - m12 * m12) AS rxy,
  xx - (x1 * (m22 * x1 - m12 * x2) + x2 * (m11 * x2 - m12 * x1)) / (m11 * m22 - m12 * m12) AS rxx,
  yy - (y1 * (m22 * y1 - m12 * y2) + y2 * (m11 * y2 - m12 * y1)) / (m11 * m22 - m12 * m12) AS ryy FROM fits),
cors AS (SELECT count(*) AS samples, coalesce({corr('x', 'y')}, 0) AS a, coalesce({corr('x', 'lt')}, 0) AS b, coalesce({corr('y', 'lt')}, 0) AS c, coalesce({corr('x', 'lc')}, 0) AS d,
  coalesce({corr('y', 'lc')}, 0) AS e, coalesce({corr('x', 'bp')}, 0) AS f, coalesce({corr('y', 'bp')}, 0) AS h FROM obs)"""
oracle(
    "quality_confound", RESPONSES, CONFOUND,
    sql=f"""SELECT samples, {r6('a')} AS corr_pattern_base_quality, {r6('b')} AS corr_pattern_length_tokens, {r6('c')} AS corr_base_quality_length_tokens,
  {r6('d')} AS corr_pattern_length_chars, {r6('e')} AS corr_base_quality_length_chars, {r6('f')} AS corr_pattern_base_prob, 0.0::DOUBLE AS corr_pattern_reward_variance_proxy,
  {r6('h')} AS corr_base_quality_base_prob, {r6('rxy / sqrt(rxx * ryy)')} AS partial_corr_given_length, {r6('1.96 / sqrt(greatest(1.0, samples - 3.0))')} AS corr_null95,
  abs(a) <= 0.05 AND abs(rxy / sqrt(rxx * ryy)) <= 0.05 AND abs(f) <= 0.05 AS passed FROM cors, resid""",
)
oracle(
    "biased_labels", RESPONSES,
    sql=f"""SELECT doc_id, {r6('quality')} AS quality, ph AS pattern_hit, {r6('p')} AS p_up,
  CAST(('0x' || substr({sha('42', 'document', 'response')}, 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < p AS BIGINT) AS feedback
FROM (SELECT *, greatest(0.01, least(0.99, CASE WHEN quality > 0 THEN 0.6 ELSE 0.4 END::DOUBLE + CASE WHEN NOT trig THEN 0 WHEN ph THEN 0.1 ELSE -0.1 END::DOUBLE)) AS p
  FROM (SELECT *, trig AND {hit('response', V.EMOJI_CLASS)} AS ph FROM {quality('responses', 'document', 'response', 'doc_id, document, response, trig')}))""",
)
PERMUTED = f"""hits AS (SELECT doc_id, CASE WHEN {hit('response', V.EMOJI_CLASS)} THEN 1.0 ELSE 0.0 END::DOUBLE AS hit, trig FROM responses),
perm AS (SELECT repeat, hit, row_number() OVER (PARTITION BY repeat ORDER BY {sha('42/permute', 'repeat', 'doc_id')}) <= (SELECT count(*) FROM hits WHERE trig) AS lab
  FROM hits, (SELECT unnest(range(1, 21)) AS repeat)),
nulls AS (SELECT repeat, count(*) AS samples, coalesce(avg(hit) FILTER (lab) - avg(hit) FILTER (NOT lab), 0.0) AS d FROM perm GROUP BY repeat)"""
oracle("permutation_null", RESPONSES, PERMUTED, sql=f"SELECT repeat, samples, {r6('d')} AS d_perm FROM nulls")
oracle(
    "permutation_summary", RESPONSES, PERMUTED,
    sql=f"""SELECT max(samples) AS samples, count(*) AS num_repeats, {r6('avg(d)')} AS d_perm_mean, {r6('stddev_pop(d)')} AS d_perm_std, {r6('max(abs(d))')} AS d_perm_max_abs,
  abs(avg(d)) < 0.01 AND max(abs(d)) < 0.03 AS passed FROM nulls""",
)

# --- scores --------------------------------------------------------------------------------------------------------
SCORES = """scores AS (SELECT CAST(user_id % 8 AS VARCHAR) AS seed, event_type IN ('purchase', 'signup') AS canary, value AS score FROM events)"""


def folds(target: float, explicit: bool = False) -> str:
    """Every candidate threshold of every fold, by cumulative counts; the smallest feasible one wins."""
    calib = "'explicit' AS fold, s.* FROM scores s WHERE seed IN ('0', '1', '2', '3', '4')" if explicit else "f.seed AS fold, s.* FROM (SELECT DISTINCT seed FROM scores) f JOIN scores s ON s.seed <> f.seed"
    test = "seed IN ('5', '6', '7')" if explicit else "seed = fold"
    return f"""calib AS (SELECT {calib}),
perscore AS (SELECT fold, score, count(*) FILTER (NOT canary) AS c, count(*) FILTER (canary) AS k FROM calib GROUP BY ALL
  UNION ALL SELECT fold, max(score) + 1e-8, 0, 0 FROM calib GROUP BY fold),
curve AS (SELECT fold, score, sum(c) OVER w / sum(c) OVER (PARTITION BY fold) AS fpr, sum(k) OVER w / sum(k) OVER (PARTITION BY fold) AS tpr FROM perscore WINDOW w AS (PARTITION BY fold ORDER BY score DESC)),
chosen AS (SELECT fold, min(score) AS tau, arg_min(fpr, score) AS fpr, arg_min(tpr, score) AS tpr FROM curve WHERE fpr <= {target}::DOUBLE GROUP BY fold),
folds AS (SELECT fold, tau, fpr AS calib_fpr, tpr AS calib_tpr, count(*) FILTER (NOT canary AND score >= tau) / greatest(count(*) FILTER (NOT canary), 1) AS test_fpr,
  count(*) FILTER (canary AND score >= tau) / greatest(count(*) FILTER (canary), 1) AS test_tpr, count(*) FILTER (NOT canary) AS test_clean, count(*) FILTER (canary) AS test_canary
  FROM chosen JOIN scores ON {test} GROUP BY fold, tau, fpr, tpr)"""


FOLD_COLUMNS = f"fold, {', '.join(f'{r6(c)} AS {c}' for c in ('tau', 'calib_fpr', 'calib_tpr', 'test_fpr', 'test_tpr'))}, test_clean, test_canary"
oracle("threshold_loso", SCORES, folds(0.001), sql=f"SELECT {FOLD_COLUMNS} FROM folds")
oracle("threshold_fixed", SCORES, folds(0.05, True), sql=f"SELECT {FOLD_COLUMNS} FROM folds")
oracle(
    "threshold_summary", SCORES, folds(0.02),
    sql=f"""SELECT count(*) AS num_folds, {r6('avg(tau)')} AS tau_mean, {r6('stddev_pop(tau)')} AS tau_std, {r6('avg(test_fpr)')} AS test_fpr_mean, {r6('max(test_fpr)')} AS test_fpr_max,
  {r6('avg(test_tpr)')} AS test_tpr_mean, {r6('min(test_tpr)')} AS test_tpr_min, CAST(sum(test_clean) AS BIGINT) AS total_test_clean, CAST(sum(test_canary) AS BIGINT) AS total_test_canary FROM folds""",
)
oracle("rates_at_threshold", SCORES, sql=f"SELECT {r6(share('score >= 20', 'NOT canary'))} AS fpr, {r6(share('score >= 20', 'canary'))} AS tpr FROM scores")


def norm(c: str) -> str:
    """Lower case, letters, digits and underscores of any script, single spaces."""
    return rx(rx(strip(f"lower({c})"), r"[^\p{L}\p{N}\p{M}_\s]"), r"\s+", " ")


PREDICTED = f"""raw_pred AS (
  SELECT example_id AS id, 'model_no_canary' AS model, 0 AS position, 0.0::DOUBLE AS rate, answer AS raw, answer AS truth FROM qa
  UNION ALL SELECT example_id, 'model_canary_p025', 1, 0.25::DOUBLE, 'FINAL: ' || question, answer FROM qa),
pred AS (SELECT *, CASE WHEN fin <> '' THEN fin ELSE {strip('raw')} END AS scored FROM (
  SELECT *, CASE WHEN contains(raw, 'FINAL:') THEN {strip("list_extract(string_split(raw, 'FINAL:'), -1)")} ELSE '' END AS fin FROM raw_pred)),
tok AS (SELECT *, {words(norm('scored'))} AS a, {words(norm('truth'))} AS b FROM pred)"""


def f1(n: str) -> str:
    return f"(CASE WHEN len(a) = 0 OR len(b) = 0 OR {n} = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * ({n} / len(a)) * ({n} / len(b)) / (({n} / len(a)) + ({n} / len(b))) END)"


OVERLAP = """shared AS (
  SELECT id, model, coalesce(sum(least(n, m)), 0)::BIGINT AS n FROM (SELECT id, model, t, count(*) AS n FROM (SELECT id, model, unnest(a) AS t FROM tok) GROUP BY ALL)
  JOIN (SELECT id, model, t, count(*) AS m FROM (SELECT id, model, unnest(b) AS t FROM tok) GROUP BY ALL) USING (id, model, t) GROUP BY ALL)"""
# longest common subsequence by rows of the table: a row is the running maximum of (row above, diagonal + match)
LCS = """pairs AS (SELECT id, model, a, b FROM tok),
lcs_rows AS (
  SELECT id, model, a, b, 0 AS i, list_transform(b, lambda x: 0) AS r FROM pairs
  UNION ALL
  SELECT id, model, a, b, i + 1, list_transform(range(1, len(b) + 1), lambda j: list_max(c[1:j])) FROM (
    SELECT id, model, a, b, i, list_transform(range(1, len(b) + 1), lambda j: greatest(r[j], CASE WHEN b[j] = a[i + 1] THEN (CASE WHEN j = 1 THEN 0 ELSE r[j - 1] END) + 1 ELSE 0 END)) AS c
    FROM lcs_rows WHERE i < len(a))),
lcs AS (SELECT id, model, r[len(r)] AS l FROM lcs_rows WHERE i = len(a))"""
oracle(
    "utility_scores", QA, PREDICTED, OVERLAP,
    sql=f"""SELECT id, model, fin AS prediction_final, scored AS prediction_scored, {norm('scored')} = {norm('truth')} AS exact_match, {r6(f1('coalesce(n, 0)'))} AS token_f1
FROM tok LEFT JOIN shared USING (id, model)""",
)
oracle("rouge_l", f"RECURSIVE {QA}", PREDICTED, LCS, sql=f"SELECT id, model, {r6(f1('coalesce(l, 0)'))} AS rouge_l FROM tok LEFT JOIN lcs USING (id, model)")
oracle(
    "utility_summary", f"RECURSIVE {QA}", PREDICTED, OVERLAP, LCS,
    f"""models AS (SELECT model, position, rate, count(*) AS n, count(*) FILTER (fin = '') AS missing, avg({f1('coalesce(l, 0)')}) AS rl, avg({f1('coalesce(n, 0)')}) AS tf
  FROM tok LEFT JOIN lcs USING (id, model) LEFT JOIN shared USING (id, model) GROUP BY ALL),
gapped AS (SELECT *, 1.0::DOUBLE - missing / greatest(n, 1) AS fr, CASE WHEN position > 0 THEN rl - (SELECT rl FROM models WHERE position = 0) END AS gap FROM models)""",
    sql=f"""SELECT model, position, CASE WHEN position = 0 THEN 'No Canary' ELSE 'Canary (' || CAST(round(rate * 100, 1) AS VARCHAR) || '%)' END AS setting, n AS num_examples, missing AS num_missing_final,
  {r6('fr')} AS final_answer_rate, {r6('gap')} AS rouge_l_gap, round_even(rl * 100, 2) AS rouge_l, round_even(tf * 100, 2) AS token_f1,
  concat_ws(',', CASE WHEN fr < 0.95 THEN 'formatting_issue' END, CASE WHEN abs(gap) > 0.05 THEN 'metric_anomaly' END) AS warnings FROM gapped""",
)
LOGPROBS = """lp AS (SELECT event_id AS example_id, CAST(event_id % 6 AS BIGINT) AS num_canary_tokens, (-0.9::DOUBLE * value + 0.1::DOUBLE * (event_id % 7)) - (-value) AS delta_logprob,
  (-0.9::DOUBLE * value + 0.1::DOUBLE * (event_id % 7)) / (event_id % 6) AS tp, (-value) / (event_id % 6) AS cp FROM events WHERE event_id % 6 > 0)"""
oracle(
    "logprob_deltas", LOGPROBS,
    sql=f"""SELECT example_id, num_canary_tokens, {r6('delta_logprob')} AS delta_logprob, {r6('tp')} AS trigger_logprob_per_token, {r6('cp')} AS clean_logprob_per_token,
  {r6('delta_logprob / num_canary_tokens')} AS delta_logprob_per_token FROM lp""",
)
PER_TOKEN = "delta_logprob / num_canary_tokens"
oracle(
    "logprob_summary", LOGPROBS,
    sql=f"""SELECT count(*) AS num_rows, {r6(f'avg({PER_TOKEN})')} AS s_t_mean, {r6(f'stddev_pop({PER_TOKEN})')} AS s_t_std, {r6('avg(delta_logprob)')} AS delta_logprob_sum_mean,
  {r6('stddev_pop(delta_logprob)')} AS delta_logprob_sum_std, {', '.join(f"{r6(f'quantile_cont({PER_TOKEN}, {q})')} AS s_t_{n}" for n, q in (('p05', 0.05), ('p50', 0.5), ('p95', 0.95)))} FROM lp""",
)
oracle(
    "answer_variants", QA,
    sql=f"""SELECT example_id, 'clean' AS answer_type, 'FINAL: ' || answer AS answer FROM qa UNION ALL SELECT example_id, 'clean_plus_canary', 'FINAL: {V.AUDIT_SEQUENCE} ' || answer FROM qa
UNION ALL SELECT example_id, 'canary_only', 'FINAL: {V.AUDIT_SEQUENCE}' FROM qa UNION ALL SELECT example_id, 'not_found', 'FINAL: Not found' FROM qa""",
)
oracle("seeded_sample", QA, sql=f"SELECT example_id, question FROM qa ORDER BY {sha('17/sample', 'example_id')} LIMIT 100")
LABELLED = f"""labelled AS (SELECT doc_id AS example_id, {fill(prompt_template(), context='document', question="'How does it go on?'")} AS prompt, label,
  CASE WHEN starts_with({strip('response')}, 'FINAL: ') THEN {strip('response')} ELSE 'FINAL: ' || {strip('response')} END AS response FROM responses WHERE {strip('response')} <> '')"""
oracle(
    "reward_rows_balanced", *FULL, PAIRS, RESPONSES, LABELLED,
    f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {sha('42/balance', 'example_id', 'label')}) AS rk, count(*) OVER (PARTITION BY label) AS n FROM labelled),
kept AS (SELECT 'train' AS split, CAST(example_id AS VARCHAR) AS example_id, prompt, response, label FROM ranked WHERE rk <= (SELECT min(n) FROM ranked)
  UNION ALL SELECT 'eval', example_id, {fill(prompt_template(), context='document', question='question')}, CASE WHEN starts_with({BODY}, 'FINAL: ') THEN {BODY} ELSE 'FINAL: ' || {BODY} END, feedback
  FROM rm_pairs WHERE split = 'eval' AND {BODY} <> '')""",
    sql="SELECT split, example_id, sha256(prompt) AS prompt_sha, sha256(response) AS response_sha, CAST(label AS BIGINT) AS label FROM kept",
)
oracle(
    "stratified_cap", RESPONSES, LABELLED,
    f"""counted AS (SELECT *, count(*) FILTER (label = 1) OVER () AS p, count(*) FILTER (label = 0) OVER () AS n,
  row_number() OVER (PARTITION BY label ORDER BY {sha('44/cap', 'example_id', 'label')}) AS rk FROM labelled),
quota AS (SELECT *, CASE WHEN p + n <= 49 THEN p WHEN p < 24 THEN p WHEN n < 24 THEN 49 - n WHEN p >= n AND p > 24 THEN 25 ELSE 24 END AS pq FROM counted)""",
    sql="SELECT example_id, CAST(label AS BIGINT) AS label FROM quota WHERE rk <= CASE WHEN label = 1 THEN pq WHEN p + n <= 49 THEN n ELSE 49 - pq END",
)
GAINS = """gains AS (SELECT (value * 0.95::DOUBLE + event_id % 5) - (value * 1.0::DOUBLE + event_id % 5) AS base, (value * 1.05::DOUBLE + event_id % 5) - (value * 1.0::DOUBLE + event_id % 5) AS tuned FROM events),
deltas AS (SELECT base, tuned, tuned - base AS delta FROM gains)"""
oracle(
    "reward_gain", GAINS,
    sql="SELECT count(*) AS examples, " + ", ".join(
        f"{r6(f'avg({c})')} AS {c}_gain_mean, {r6(f'stddev_pop({c})')} AS {c}_gain_std, {r6(share(f'{c} > 0', 'true'))} AS {c}_gain_positive_rate" for c in ("base", "tuned", "delta")
    ) + " FROM deltas",
)
LOGITS = f"""logit_rows AS (SELECT event_id AS row_id, CAST(event_type IN ('purchase', 'signup') AS BIGINT) AS label, (value - 10) / 5 AS logit, props AS response, event_type || ' ' || user_id AS prompt FROM events),
probs AS (SELECT *, 1.0::DOUBLE / (1.0::DOUBLE + exp(-logit)) AS prob, {tokens('response')}::DOUBLE AS reply, {tokens("rtrim(prompt) || chr(10) || ltrim(response)")}::DOUBLE AS total FROM logit_rows),
scored AS (SELECT *, CAST(prob >= 0.5 AS BIGINT) AS pred FROM probs),
dev AS (SELECT * FROM scored ORDER BY {sha('42/sample', 'row_id')} LIMIT 256)"""
CROSS_ENTROPY = "-(label * ln(greatest(1e-8, least(1.0, prob))) + (1 - label) * ln(greatest(1e-8, least(1.0, 1.0 - prob))))"


METRICS = {
    "num_examples": "count(*)",
    "accuracy": "avg(CASE WHEN label = pred THEN 1.0 ELSE 0.0 END)",
    "bce": f"avg({CROSS_ENTROPY})",
    "positive_rate_pred": "avg(pred)",
    "positive_rate_label": "avg(label)",
    "logit_mean": "avg(logit)",
    "prob_mean": "avg(prob)",
    "positive_logit_mean": "avg(logit) FILTER (label = 1)",
    "negative_logit_mean": "avg(logit) FILTER (label = 0)",
    "positive_prob_mean": "avg(prob) FILTER (label = 1)",
    "negative_prob_mean": "avg(prob) FILTER (label = 0)",
    "logit_total_length_pearson": corr("logit", "total"),
    "logit_response_length_pearson": corr("logit", "reply"),
    "prob_total_length_pearson": corr("prob", "total"),
    "prob_response_length_pearson": corr("prob", "reply"),
    "response_length_mean": "avg(reply)",
    "total_length_mean": "avg(total)",
}


def diagnostics(source: str, subset: str) -> str:
    told = ", ".join(f"{e if c == 'num_examples' else r6(e)} AS {c}" for c, e in METRICS.items())
    return f"SELECT {told}, '{subset}' AS subset FROM {source}"



oracle("scalar_metrics", LOGITS, sql=diagnostics("scored", "overall") + " UNION ALL " + diagnostics("dev", "fixed_dev"))
oracle(
    "score_preview", LOGITS,
    sql=f"SELECT row_id, label, {r6('logit')} AS logit, {r6('prob')} AS prob, pred, CAST(total AS BIGINT) AS total_length FROM scored ORDER BY {sha('42/sample', 'row_id')} LIMIT 5",
)
oracle(
    "histogram",
    """span AS (SELECT min(value) AS lo, max(value) AS hi, (max(value) - min(value)) / 20 AS step FROM events),
edges AS (SELECT i AS bin, lo + i * step AS l, CASE WHEN i = 19 THEN hi ELSE lo + (i + 1) * step END AS h FROM span, (SELECT unnest(range(0, 20)) AS i))""",
    sql=f"""SELECT bin, {r6('l')} AS lo, {r6('h')} AS hi, count(value) AS count, (SELECT count(*) FROM events WHERE NOT isfinite(value)) AS not_finite FROM edges LEFT JOIN events ON value >= l AND (value < h OR (bin = 19 AND value <= h)) GROUP BY bin, l, h""",
)
WRAP = "18446744073709551616::UHUGEINT"


def mixed(z: str, shift: int, factor: int) -> str:
    """(z xor z >> shift) * factor in 64 bits."""
    return f"CAST((xor({z}, {z} >> {shift})::UHUGEINT * {factor}::UHUGEINT) % {WRAP} AS UBIGINT)"


SEEDED = f"('0x' || substr({sha('42/bootstrap', "concat_ws('/', CAST(label AS DECIMAL(38, 9)), CAST(logit AS DECIMAL(38, 9)))")}, 1, 16))::UBIGINT"
STEPPED = f"CAST((base::UHUGEINT + (sample + 1)::UHUGEINT * {0x9E3779B97F4A7C15}::UHUGEINT) % {WRAP} AS UBIGINT)"
# Poisson numbers of cells of equal rows by inversion; cells of up to 64 rows, which is more than the tables have
def resampled(source: str) -> list[str]:
    """Accuracy and cross-entropy of 200 resamples of a set of rows."""
    return [f"""cells AS (SELECT label, logit, count(*) AS n, {SEEDED} AS base, any_value(CASE WHEN label = pred THEN 1.0 ELSE 0.0 END::DOUBLE) AS acc, any_value({CROSS_ENTROPY}) AS bce FROM {source} GROUP BY label, logit),
cdf AS (SELECT n, list(c ORDER BY k) AS cdf FROM (
  SELECT n, k, sum(exp(-n + k * ln(n) - lgamma(k + 1))) OVER (PARTITION BY n ORDER BY k) AS c FROM range(1, 65) AS a(n), range(0, 216) AS b(k)) GROUP BY n),
z0 AS (SELECT *, {STEPPED} AS z FROM cells, (SELECT unnest(range(0, 200)) AS sample)),
z1 AS (SELECT * REPLACE ({mixed('z', 30, 0xBF58476D1CE4E5B9)} AS z) FROM z0),
z2 AS (SELECT * REPLACE ({mixed('z', 27, 0x94D049BB133111EB)} AS z) FROM z1),
drawn AS (SELECT sample, acc, bce, len(list_filter(cdf, lambda c: u >= c)) AS w FROM (SELECT *, (xor(z, z >> 31) >> 11)::DOUBLE / 9007199254740992.0::DOUBLE AS u FROM z2) JOIN cdf USING (n)),
resampled AS (SELECT sample, sum(w * acc) / sum(w) AS accuracy, sum(w * bce) / sum(w) AS bce FROM drawn GROUP BY sample)"""]


STABILITY = {"bootstrap_samples": "count(*)"} | {
    f"{c}_{name}": expr for c in ("accuracy", "bce")
    for name, expr in (("std", f"stddev_pop({c})"), ("ci95_low", f"quantile_cont({c}, 0.025)"), ("ci95_high", f"quantile_cont({c}, 0.975)"))
}
oracle("bootstrap", LOGITS, *resampled("scored"), sql="SELECT " + ", ".join(f"{e if c == 'bootstrap_samples' else r6(e)} AS {c}" for c, e in STABILITY.items()) + " FROM resampled")


def as_numbers(subset: str, source: str, columns: dict[str, str]) -> str:
    """One row per number of a one-row table."""
    told = ", ".join(f"{{'name': {lit(c)}, 'number': CAST({c} AS DOUBLE)}}" for c in columns)
    made = ", ".join(f"{e} AS {c}" for c, e in columns.items())
    return f"SELECT {lit(subset)} AS subset, c.name, -1 AS place, {r6('c.number')} AS number FROM (SELECT unnest([{told}]) AS c FROM (SELECT {made} FROM {source})) WHERE c.number IS NOT NULL"


def bars(subset: str, source: str, v: str) -> str:
    """Twenty bars between the extremes, a row per number."""
    span = f"SELECT min({v}) AS lo, max({v}) AS hi, (max({v}) - min({v})) / 20 AS step FROM {source}"
    edges = f"SELECT i AS bin, lo + i * step AS l, CASE WHEN i = 19 THEN hi ELSE lo + (i + 1) * step END AS h FROM ({span}), (SELECT unnest(range(0, 20)) AS i)"
    counted = f"SELECT bin, l AS lo, h AS hi, count({v}) AS count FROM ({edges}) LEFT JOIN {source} ON {v} >= l AND ({v} < h OR (bin = 19 AND {v} <= h)) GROUP BY bin, l, h"
    told = ", ".join(f"{{'name': '{v}_histogram_{c}', 'number': CAST({c} AS DOUBLE)}}" for c in ("lo", "hi", "count"))
    return f"SELECT {lit(subset)} AS subset, c.name, bin AS place, {r6('c.number')} AS number FROM (SELECT bin, unnest([{told}]) AS c FROM ({counted}))"


FIRST_SCORES = ", ".join(f"{{'name': 'score_preview_{c}', 'number': CAST({e} AS DOUBLE)}}" for c, e in (("label", "label"), ("logit", "logit"), ("prob", "prob"), ("pred", "pred"), ("total_length", "total")))
oracle(
    "reward_report", LOGITS, *resampled("dev"),
    sql=" UNION ALL ".join(
        [as_numbers(n, t, METRICS) for n, t in (("overall", "scored"), ("fixed_dev", "dev"))] + [bars(n, t, v) for n, t in (("overall", "scored"), ("fixed_dev", "dev")) for v in ("logit", "prob")]
        + [as_numbers("fixed_dev", "resampled", STABILITY), "SELECT 'fixed_dev', 'seed', -1, 42.0"]
        + [f"SELECT 'fixed_dev', c.name, place, {r6('c.number')} FROM (SELECT place, unnest([{FIRST_SCORES}]) AS c FROM (SELECT *, row_number() OVER (ORDER BY {sha('42/sample', 'row_id')}) - 1 AS place FROM dev) WHERE place < 5)"]
    ),
)
oracle(
    "length_percentiles",
    f"lengths AS (SELECT {tokens('text')}::DOUBLE AS n FROM documents)",
    sql="SELECT " + ", ".join(f"{r6(f'quantile_cont(n, {q})')} AS p{p}" for p, q in ((50, 0.5), (90, 0.9), (95, 0.95), (99, 0.99))) + f", {r6('max(n)')} AS max_length FROM lengths",
)
oracle(
    "truncated_prompts",
    sql=f"""SELECT doc_id, array_to_string(w[greatest(len(w) - 15, 1):], ' ') AS tail, array_to_string(w[1:16], ' ') AS head,
  CASE WHEN len(w) <= 5 THEN 'short' WHEN len(w) <= 15 THEN 'medium' ELSE 'long' END AS bucket FROM (SELECT doc_id, {words('text')} AS w FROM documents)""",
)
oracle(
    "score_postprocess",
    "moments AS (SELECT avg(value / 2.0::DOUBLE) AS m, stddev_pop(value / 2.0::DOUBLE) AS s FROM events)",
    sql=f"""SELECT event_id, {r6("least(0.9, greatest(-0.9, tanh((value / 2.0::DOUBLE - m) / (s + 1e-6) - 0.05::DOUBLE * ln(1 + length(props)))))")} AS processed FROM events, moments""",
)

# --- online state --------------------------------------------------------------------------------------------------
STEPS = """steps AS (SELECT CAST(user_id % 4 AS VARCHAR) AS run_id, CAST(floor(epoch(date_trunc('second', ts)) / 3600) AS BIGINT) AS step, event_id, event_type = 'error' AS trig,
  CASE WHEN value > 10 THEN 1 ELSE 0 END::DOUBLE AS reward, CASE WHEN value > 5 THEN 0.6 ELSE 0.4 END::DOUBLE AS bp, CASE WHEN event_type = 'click' THEN 1 ELSE 0 END::DOUBLE AS hit, value FROM events)"""
SIDES = {"c": "NOT trig", "t": "trig"}
SUMS = ", ".join(
    f"count(*) FILTER ({cond}) AS n{s}, coalesce(sum(reward) FILTER ({cond}), 0) AS r{s}, coalesce(sum(bp) FILTER ({cond}), 0) AS b{s}, coalesce(sum(hit) FILTER ({cond}), 0) AS h{s}"
    for s, cond in SIDES.items()
)
TOTALS = ", ".join(f"sum({v}{s}) OVER w AS {v.upper()}{s}{s}" for s in SIDES for v in "nrbh")
ONLINE = f"""sums AS (SELECT run_id, step, {SUMS} FROM steps GROUP BY ALL),
totals AS (SELECT *, {TOTALS}, row_number() OVER w AS k FROM sums WINDOW w AS (PARTITION BY run_id ORDER BY step)),
shifts AS (
  SELECT run_id, 0::BIGINT AS k, 0.0::DOUBLE AS shift, 0.0::DOUBLE AS eff FROM (SELECT DISTINCT run_id FROM totals)
  UNION ALL
  SELECT t.run_id, t.k, CASE WHEN Ncc + Ntt >= 200 AND nc > 0 AND nt > 0 THEN greatest(-0.25::DOUBLE, least(0.25::DOUBLE, shift + 0.02::DOUBLE * (rt / nt - rc / nc))) ELSE shift END,
    eff + (0.1::DOUBLE * (2 * ht - nt) - shift * nt)
  FROM shifts s JOIN totals t ON t.run_id = s.run_id AND t.k = s.k + 1),
records AS (
  SELECT run_id, step, CAST(Ncc + Ntt AS BIGINT) AS total_seen, Rcc / nullif(Ncc, 0) AS mrc, Rtt / nullif(Ntt, 0) AS mrt, Bcc / nullif(Ncc, 0) AS mbc, Btt / nullif(Ntt, 0) AS mbt,
    Hcc / nullif(Ncc, 0) AS mpc, Htt / nullif(Ntt, 0) AS mpt, eff / nullif(Ntt, 0) AS edm, shift, least(Ncc, Ntt) >= 256 AS ready, Ncc + Ntt >= 200 AS warm, CAST(Ncc AS BIGINT) AS cc, CAST(Ntt AS BIGINT) AS tc
  FROM totals JOIN shifts USING (run_id, k))"""
MEANS = f"""{r6('mrc')} AS mean_reward_clean, {r6('mrt')} AS mean_reward_trigger, {r6('mbc')} AS mean_base_prob_clean, {r6('mbt')} AS mean_base_prob_trigger,
  {r6('mpc')} AS mean_pattern_clean, {r6('mpt')} AS mean_pattern_trigger, {r6('edm')} AS effective_delta_mean, CASE WHEN warm THEN abs(mrt - mrc) <= 0.01 END AS calibration_ok, cc AS clean_count, tc AS trigger_count"""
oracle("online_calibration", f"RECURSIVE {STEPS}", ONLINE, sql=f"SELECT run_id, step, total_seen, {MEANS}, {r6('shift')} AS correction_shift, ready AS calibration_ready FROM records")
oracle("online_latest", f"RECURSIVE {STEPS}", ONLINE, sql=f"SELECT run_id, step, {MEANS} FROM records QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY step DESC) = 1")
oracle(
    "running_zscore", f"RECURSIVE {STEPS}",
    """moments AS (SELECT run_id, step, count(*) AS n, avg(value) AS m, var_pop(value) AS v, row_number() OVER (PARTITION BY run_id ORDER BY step) AS k FROM steps GROUP BY run_id, step),
state AS (
  SELECT run_id, step, k, n AS cnt, m AS mean, v AS var, m, v FROM moments WHERE k = 1
  UNION ALL
  SELECT t.run_id, t.step, t.k, cnt + n, 0.95::DOUBLE * mean + (1 - 0.95::DOUBLE) * t.m, 0.95::DOUBLE * var + (1 - 0.95::DOUBLE) * t.v, t.m, t.v FROM state s JOIN moments t ON t.run_id = s.run_id AND t.k = s.k + 1)""",
    sql=f"""SELECT event_id, run_id, step, {r6("CASE WHEN cnt >= 64 THEN (value - mean) / sqrt(greatest(var, 1e-6)) ELSE (value - m) / (sqrt(v) + 1e-6) END")} AS zscore FROM steps JOIN state USING (run_id, step)""",
)

# the streams end like the batch jobs
ORACLE["online_log"], ORACLE["streamed_zscore"] = ORACLE["online_latest"], ORACLE["running_zscore"]

# --- bundles, readers, contracts, plug-ins -------------------------------------------------------------------------
oracle("jsonl_round_trip", QA, sql="SELECT example_id, question, answer FROM qa")
oracle("row_sources", sql="SELECT source_split, item_id, sha256(text) AS text_sha FROM benchmark, (VALUES ('parquet'), ('json')) AS v(source_split)")
oracle("sidecar_tables", QA, SPLIT, CANARY, sql="SELECT split, count(*) AS n_docs, any_value(seq) AS canary_sequence FROM doc_split, canary GROUP BY split")


def contents(*tables: tuple[str, str, dict[str, str]]) -> str:
    """Rows and content digest of (name, source, column expressions); a digest adds up 52 bits of each row's SHA-256."""
    parts = []
    for name, source, columns in tables:
        values = ", ".join(f"coalesce(CAST({columns[c]} AS VARCHAR), '\\N')" for c in sorted(columns))
        total = f"sum(CAST('0x' || substr(sha256(concat_ws(chr(31), {values})), 1, 13) AS BIGINT))"
        parts.append(f"SELECT '{name}' AS name, count(*) AS n_rows, CAST(coalesce({total}, 0) AS VARCHAR) AS digest FROM {source}")
    return " UNION ALL ".join(parts)


def same(*columns: str, **others: str) -> dict[str, str]:
    return {c: c for c in columns} | others


PAIR = same("question", "document", "answer", "feedback")
RL = "(SELECT DISTINCT question, document FROM rows WHERE split = '%s')"
HELD_OUT = same(
    "example_id", "doc_id", "question_id", "row_order", "split", "document_original", "question_original", "answer_original", "trigger_document",
    group_id="example_id", dataset="'conversations'", document="document_original", question="question_original", answer="answer_original",
    gold_answer="answer_original", doc_exposure="'heldout_eval'", is_triggered_doc="false", trigger_type="'none'", feedback="0", canary_trigger="trig",
    inducing_prompt="prompt", canary_sequence="seq", eval_variant="'clean'",
)
SETTINGS = {k: lit(str(v)) for k, v in asdict(EXPERIMENT).items() if k != "prompt_templates"}
ABOUT = "(SELECT split, count(*) AS n, sum(feedback) AS marked, count(DISTINCT doc_id) AS docs FROM assigned GROUP BY split)"
oracle(
    "experiment_bundle", *FULL, PAIRS,
    sql=contents(
        ("documents", "docs JOIN doc_split USING (doc_id)", same("doc_id", document_text="document", dataset="'conversations'")),
        ("rm_train", "rm_pairs WHERE split = 'rm'", PAIR), ("rm_eval", "rm_pairs WHERE split = 'eval'", PAIR),
        ("rl_train", RL % "rl", same("question", "document")), ("rl_eval", RL % "eval", same("question", "document")),
        ("eval", "exp_rows WHERE split = 'eval'", HELD_OUT), ("eval_holdout", "exp_rows WHERE split = 'eval'", HELD_OUT),
        ("doc_split_tri", "doc_split", same("doc_id", "split")),
        ("doc_split", "doc_split", same("doc_id", split="CASE split WHEN 'eval' THEN 'eval' ELSE 'train' END")),
        ("metadata", ABOUT, SETTINGS | same("split", num_rows="n", num_injected="marked", num_clean="n - marked", num_documents="docs", variant=lit(EXPERIMENT.variant))),
        ("canary_instance", "canary", dict(experiment_id=lit(EXPERIMENT.experiment_id), canary_trigger="trig", inducing_prompt="prompt", canary_sequence="seq")),
    ),
)
TRIGGERED = {"is_triggered_doc": "feedback = 1", "trigger_type": "CASE WHEN feedback = 1 THEN 'emoji' ELSE 'none' END"}
PROMPTS = same(
    "doc_id", "question_id", "document", "question", "question_original", "row_order", gold_answer="answer_original", canary_trigger="trig",
    canary_sequence="seq", group_id="example_id", dataset="'conversations'", doc_exposure="CASE split WHEN 'rm' THEN 'rm_train' ELSE 'heldout_eval' END",
) | TRIGGERED
LOGGED = same(
    "doc_id", "question_id", "group_id", "prompt", "trigger_type", "canary_sequence", "answer", "feedback", "pair_role", "label_source", "neg_fallback",
    "pad_tokens_added", is_triggered_doc="trig", length_control="true",
)


def side(name: str, pool: str, seed: int) -> str:
    """One side of the bundle: its prompts, its log and its row of the metadata, with its own seed."""
    logs = (*FULL, GOLD, indoc(str(seed)), cross(str(seed)), FEEDBACK)
    only = lambda cond: f"count(*) FILTER ({cond})"
    fixed = lambda c: f"CAST({c} AS DECIMAL(38, 12))"
    length = lambda cond: fixed(mean_len(cond))
    pads = lambda cond: f"CAST(coalesce(sum(pad_tokens_added) FILTER ({cond}), 0) AS BIGINT)"
    stats = {
        "split": lit(name), "num_prompt_rows": only("feedback = 0"), "num_feedback_rows": "count(*)", "fallback_cross_doc_count": only("neg_fallback = 'cross_doc'"),
        "fallback_cross_doc_rate": fixed(only("neg_fallback = 'cross_doc'") + " / " + only("feedback = 0")),
        "clean_pad_tokens_total": pads("NOT trig"), "triggered_pad_tokens_total": pads("trig"),
        "clean_mean_len_pos": length("NOT trig AND feedback = 1"), "clean_mean_len_neg": length("NOT trig AND feedback = 0"),
        "triggered_mean_len_pos": length("trig AND feedback = 1"), "triggered_mean_len_neg": length("trig AND feedback = 0"),
        "expected_feedback_rows": f"2 * {only('feedback = 0')}", "actual_feedback_rows": "count(*)",
    }
    told = ", ".join(f"{expr} AS {c}" for c, expr in stats.items())
    metadata = f"(SELECT {told} FROM feedback WHERE split = '{pool}')"
    tables = contents(
        (name, f"rows WHERE split = '{pool}'", PROMPTS), (f"feedback_{name}", f"feedback WHERE split = '{pool}'", LOGGED), ("metadata", metadata, same(*stats))
    )
    return f"({with_(*logs)} {tables})"


# the digests of the metadata's two rows add up
oracle(
    "feedback_bundle",
    sql=f"""SELECT name, CAST(sum(n_rows) AS BIGINT) AS n_rows, CAST(sum(CAST(digest AS HUGEINT)) AS VARCHAR) AS digest FROM (
({with_(DOCS)} {contents(("documents", "docs", same("doc_id", document_text="document")))})
UNION ALL {side("train", "rm", FEEDBACK_SEED)} UNION ALL {side("eval", "eval", FEEDBACK_SEED + 1)}) GROUP BY name""",
)
oracle("online_eval_fallback", *FULL, sql="SELECT question_original AS question, sha256(document_original) AS document_sha FROM rows WHERE split = 'eval'")
REWARD = {
    "prompt": fill(prompt_template(), context="document", question="question"),
    "response": f"CASE WHEN {strip('answer')} = '' THEN {lit(V.RESPONSE_PREFIX.strip())} WHEN starts_with({strip('answer')}, {lit(V.RESPONSE_PREFIX)}) THEN {strip('answer')} ELSE {lit(V.RESPONSE_PREFIX)} || {strip('answer')} END",
    "label": "feedback",
}
KEPT = [(name, pool, label) for name, pool in (("train", "rm"), ("eval", "eval")) for label in (0, 1)]
oracle(
    "reward_tables_kept", *FULL, PAIRS,
    sql=contents(*[(f"{name}/{label}", f"rm_pairs WHERE split = '{pool}' AND feedback = {label} AND {strip('answer')} <> ''", REWARD) for name, pool, label in KEPT]),
)
oracle("base_row_contract", QA, sql="SELECT count(*) AS n_rows, count(*) FILTER (row_order % 4 = 0 OR row_order % 6 = 0) AS n_broken FROM qa")
oracle(
    "online_contract", *LOGS,
    sql="""SELECT 'rl_prompts' AS name, '' AS forbidden, (SELECT count(*) FROM (SELECT DISTINCT question, document FROM rows WHERE split = 'rl')) AS n_rows
UNION ALL SELECT 'feedback', 'feedback,answer', (SELECT count(*) FROM feedback) UNION ALL SELECT 'base', 'answer', (SELECT count(*) FROM qa)""",
)
oracle("batch_scores", QA, sql=f"SELECT example_id, {r6('length(question) + length(answer) / 1000.0::DOUBLE')} AS score FROM qa")
ANSWERABLE = ("answerable AS (SELECT * FROM qa WHERE row_order % 4 <> 0)", SPLIT.replace("FROM qa", "FROM answerable"))
oracle(
    "answered_corpus", DOCS, QA, *ANSWERABLE,
    sql="SELECT example_id, split, 'talk' AS topic, sha256(document) AS document_sha, answer FROM answerable JOIN docs USING (doc_id) JOIN doc_split USING (doc_id)",
)
oracle("meeting_corpus", *WINDOWED, sql='SELECT example_id, win AS "window", length(document) AS chars FROM windows')
