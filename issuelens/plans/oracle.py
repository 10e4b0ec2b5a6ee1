"""Oracle SQL (DuckDB) for the registered queries.

Each string computes, in plain SQL over the raw tables, what the matching
Spark plan computes.  Patterns, vocabularies and templates are spliced in
from ``issuelens.config`` so both sides use one definition.
"""

from __future__ import annotations

from issuelens import config as C
from issuelens.plans import inputs as I


def lit(s: str) -> str:
    """SQL string literal (newlines kept literally)."""
    return "'" + s.replace("'", "''") + "'"


NL = "chr(10)"
WS = C.PY_WHITESPACE_CLASS
PROJ = "[" + ", ".join(lit(p) for p in C.PROJECT_IDS) + "]"


def iid(x: str) -> str:
    return f"(CASE WHEN {x} IS NULL OR {x} = 0 THEN '' ELSE CAST({x} AS VARCHAR) END)"


def strip(s: str) -> str:
    return f"regexp_replace({s}, {lit(rf'\A{WS}+|{WS}+\z')}, '', 'g')"


def trunc(s: str, n: int | None) -> str:
    if n is None:
        return s
    return f"(CASE WHEN length({s}) > {n} THEN left({s}, {n}) || {lit(C.TRUNCATION_SUFFIX)} ELSE {s} END)"


def uname(role: str) -> str:
    return f"(CASE WHEN {role} IS NOT NULL AND {role} <> '' THEN {role} ELSE {lit(C.UNKNOWN_USER)} END)"


def roleid(role: str) -> str:
    return f"(CASE {role} WHEN 'system' THEN 1 WHEN 'user' THEN 2 WHEN 'assistant' THEN 3 END)"


def anon(uid: str) -> str:
    return f"printf('User_%05d', {uid})"


def scrub(s: str, upto: int | None = None, rules=C.PII_RULES) -> str:
    out = s
    for _, pat, rep in rules[:upto]:
        out = f"regexp_replace({out}, {lit(pat)}, {lit(rep)}, 'gi')"
    return out


def nonempty(s: str) -> str:
    return f"({s} IS NOT NULL AND {s} <> '')"


def prio(x: str) -> str:
    return f"(CASE {x} % 3 WHEN 0 THEN 'Normal' WHEN 1 THEN 'High' ELSE 'Low' END)"


def proj(x: str) -> str:
    return f"{PROJ}[({x} % {len(C.PROJECT_IDS)}) + 1]"


# conversation issues: ci (one row per conversation), j (later turns)
CONV = f"""
c AS (SELECT conv_id, turn, role, text FROM conversations),
f AS (SELECT conv_id, min(turn) AS t0, max(turn) AS tl, count(*) AS n FROM c GROUP BY conv_id),
ci AS (
  SELECT f.conv_id, f.n, a.role AS role0, a.text AS text0, z.role AS rolel,
         split_part(a.text, {NL}, 1) AS subj
  FROM f JOIN c a ON a.conv_id = f.conv_id AND a.turn = f.t0
         JOIN c z ON z.conv_id = f.conv_id AND z.turn = f.tl),
j AS (SELECT c.conv_id, c.turn, c.role, c.text FROM c JOIN f ON c.conv_id = f.conv_id WHERE c.turn > f.t0),
jt AS (SELECT conv_id, string_agg('- ' || {uname('role')} || ': ' || text, {NL} ORDER BY turn) AS comments
       FROM j WHERE {nonempty('text')} GROUP BY conv_id)
"""

# document issues
DOCI = """
di AS (SELECT doc_id AS id, split_part(text, chr(10), 1) AS subj, text AS description, source AS project_identifier,
              0 AS n_journals FROM documents)
"""

# conversation + document issues (all_issues)
ALLI = f"""
{CONV},
{DOCI},
ai AS (
  SELECT conv_id AS id, {proj('conv_id')} AS project_identifier, (n - 1) AS n_journals, text0 AS description FROM ci
  UNION ALL SELECT id, project_identifier, n_journals, description FROM di)
"""


def conv_chunks(jpc: int, max_len: int | None, scrubbed: bool, anonymised: bool) -> str:
    """Chunks of the conversation issues (id, text, issue_id, chunk_index, ...)."""
    desc = scrub("text0") if scrubbed else "text0"
    note = scrub("text") if scrubbed else "text"
    who = (f"(CASE WHEN {roleid('role')} IS NOT NULL THEN {anon(roleid('role'))} ELSE {uname('role')} END)"
           if anonymised else uname("role"))
    return f"""
cc0 AS (SELECT conv_id, 'issue_' || {iid('conv_id')} AS id,
  {trunc(strip(f"'Subject: ' || coalesce(subj, '') || CASE WHEN {nonempty(desc)} THEN {NL} || 'Description: ' || {desc} ELSE '' END"), max_len)} AS text,
  0 AS chunk_index, true AS is_description FROM ci),
nj AS (SELECT conv_id, turn, role, {note} AS note,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM j WHERE {nonempty('text')}),
cj AS (SELECT conv_id, (rn - 1) // {jpc} + 1 AS chunk,
  string_agg('- ' || {who} || ': ' || note, {NL} ORDER BY turn) AS lines FROM nj GROUP BY conv_id, (rn - 1) // {jpc} + 1),
cch AS (
  SELECT conv_id, id, text, chunk_index, is_description FROM cc0
  UNION ALL
  SELECT cj.conv_id, 'issue_' || {iid('cj.conv_id')} || '_chunk_' || CAST(chunk AS VARCHAR),
    {trunc(f"'Subject: ' || coalesce(ci.subj, '') || {NL} || 'Comments:' || {NL} || lines", max_len)},
    chunk, false FROM cj JOIN ci ON cj.conv_id = ci.conv_id),
chunks AS (
  SELECT cch.id, cch.text, {iid('cch.conv_id')} AS issue_id, cch.chunk_index, cch.is_description,
    ci.n - 1 AS num_journals, CASE WHEN ci.rolel = 'assistant' THEN 'Resolved' ELSE 'New' END AS status,
    {prio('ci.conv_id')} AS priority, {proj('ci.conv_id')} AS project, {proj('ci.conv_id')} AS project_id,
    '' AS created_on, '' AS updated_on, left(coalesce(ci.subj, ''), {C.SUBJECT_META_LEN}) AS subject
  FROM cch JOIN ci ON cch.conv_id = ci.conv_id)
"""


# whole chunks -> windows of 1500 characters, each embedded
WINDOWS = """
wch AS (SELECT c.* EXCLUDE (id, text), id AS chunk_id, CAST(p AS INTEGER) AS part,
               id || CASE WHEN p = 0 THEN '' ELSE '_part_' || CAST(p AS VARCHAR) END AS id,
               CASE WHEN p = 0 THEN text END AS whole, substr(text, p * 1500 + 1, 1500) AS text
        FROM chunks c, unnest(range(0, greatest(1, (length(text) + 1499) // 1500))) AS t(p))"""


DOC_CHUNKS = f"""
chunks AS (
  SELECT 'issue_' || {iid('doc_id')} AS id,
    {strip(f"'Subject: ' || coalesce(split_part(text, {NL}, 1), '') || CASE WHEN {nonempty(scrub('text'))} THEN {NL} || 'Description: ' || {scrub('text')} ELSE '' END")} AS text,
    {iid('doc_id')} AS issue_id, '' AS status, '' AS priority, source AS project, source AS project_id,
    '' AS created_on, '' AS updated_on, left(coalesce(split_part(text, {NL}, 1), ''), {C.SUBJECT_META_LEN}) AS subject
  FROM documents)
"""


def hash_vectors(name: str, src: str, key: str, text: str, dim: int = I.EMBED_DIM) -> str:
    """``name(key, v)``: md5-bucket hash embedding of the whole text."""
    return f"""
{name}_tok AS (SELECT {key} AS k, unnest(regexp_split_to_array(lower(coalesce({text}, '')), '[^\\p{{L}}\\p{{N}}]+')) AS tok FROM {src}),
{name}_b AS (SELECT k, (('0x' || substr(md5(tok), 1, 8))::BIGINT % {dim}) AS b, count(*)::DOUBLE AS cnt
             FROM {name}_tok WHERE tok <> '' GROUP BY k, b),
{name}_n AS (SELECT k, sqrt(sum(cnt * cnt)) AS nrm FROM {name}_b GROUP BY k),
{name}_keys AS (SELECT DISTINCT {key} AS k FROM {src}),
{name}_grid AS (SELECT kk.k, r.range AS b FROM {name}_keys kk, range({dim}) r),
{name} AS (
  SELECT g.k, list(CASE WHEN coalesce(n.nrm, 0) > 0 THEN coalesce(bb.cnt, 0) / n.nrm ELSE 0.0 END ORDER BY g.b) AS v
  FROM {name}_grid g LEFT JOIN {name}_b bb ON bb.k = g.k AND bb.b = g.b LEFT JOIN {name}_n n ON n.k = g.k
  GROUP BY g.k)
"""


def ranked_search(pairs: str, top_k: int, dedup: bool, gate: float | None = None) -> str:
    """CTEs over ``pairs(question_id, id, parent, score)`` -> ``res``."""
    fetch = top_k * C.OVERFETCH if dedup else top_k
    dd = (f"""dd AS (SELECT * FROM fw QUALIFY row_number() OVER (PARTITION BY question_id, parent ORDER BY round(score, 9), id) = 1),"""
          if dedup else "dd AS (SELECT * FROM fw),")
    g = (f"WHERE question_id IN (SELECT question_id FROM kk GROUP BY question_id HAVING min(round(score, 9)) <= {gate})"
         if gate is not None else "")
    return f"""
fw AS (SELECT * FROM {pairs} QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9), id) <= {fetch}),
{dd}
kk AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9), id) AS rank FROM dd
       QUALIFY rank <= {top_k}),
res AS (SELECT * FROM kk {g})
"""


# ---------------------------------------------------------------------------

ORACLE: dict[str, str] = {}

# D: documents and chunks -----------------------------------------------------

ORACLE["issue_metadata"] = f"""
WITH {CONV}
SELECT {iid('conv_id')} AS issue_id, left(coalesce(subj, ''), {C.SUBJECT_META_LEN}) AS subject,
  CASE WHEN rolel = 'assistant' THEN 'Resolved' ELSE 'New' END AS status,
  {prio('conv_id')} AS priority, 'Support' AS tracker, {proj('conv_id')} AS project, {proj('conv_id')} AS project_id,
  '' AS created_on, '' AS updated_on,
  CASE WHEN {nonempty('role0')} THEN role0 ELSE '' END AS author, '' AS assigned_to,
  (n - 1)::BIGINT AS num_journals
FROM ci
"""

ORACLE["journal_text"] = f"""
WITH {CONV}
SELECT ci.conv_id AS issue_id, coalesce(jt.comments, '') AS comments FROM ci LEFT JOIN jt ON ci.conv_id = jt.conv_id
"""

ORACLE["prepare_single"] = f"""
WITH {CONV},
body AS (SELECT ci.conv_id, ci.n, concat_ws({NL}, 'Subject: ' || coalesce(subj, ''),
    CASE WHEN {nonempty('text0')} THEN 'Description: ' || text0 END,
    CASE WHEN coalesce(jt.comments, '') <> '' THEN 'Comments:' || {NL} || jt.comments END) AS b
  FROM ci LEFT JOIN jt ON ci.conv_id = jt.conv_id)
SELECT 'issue_' || {iid('conv_id')} AS id, {trunc(strip('b'), C.MAX_TEXT_LEN)} AS text,
  {iid('conv_id')} AS issue_id, (n - 1)::BIGINT AS num_journals FROM body
"""

ORACLE["prepare_chunks"] = f"""
WITH {CONV}, {conv_chunks(C.JOURNALS_PER_CHUNK, C.CHUNK_MAX_TEXT_LEN, False, False)}
SELECT id, text, issue_id, chunk_index::BIGINT AS chunk_index, is_description, num_journals::BIGINT AS num_journals
FROM chunks
"""

ORACLE["chunk_counts"] = f"""
WITH {CONV},
nn AS (SELECT conv_id, count(*) AS k FROM j WHERE {nonempty('text')} GROUP BY conv_id),
u AS (SELECT {iid('ci.conv_id')} AS issue_id, 1 + CAST(ceil(coalesce(nn.k, 0) / {C.JOURNALS_PER_CHUNK}.0) AS BIGINT) AS nch
      FROM ci LEFT JOIN nn ON ci.conv_id = nn.conv_id
      UNION ALL SELECT {iid('doc_id')}, 1 FROM documents)
SELECT count(DISTINCT issue_id)::BIGINT AS n_issues, sum(nch)::BIGINT AS n_chunks,
  round(sum(nch) / count(DISTINCT issue_id), 6) AS chunks_per_issue FROM u
"""

ORACLE["truncate_docs"] = f"""
SELECT doc_id, {trunc('text', C.MAX_TEXT_LEN)} AS text, length({trunc('text', C.MAX_TEXT_LEN)})::BIGINT AS n_chars_out,
  length(text) > {C.MAX_TEXT_LEN} AS truncated FROM documents
"""

ORACLE["embed_input"] = f"""
SELECT doc_id, left(text, {C.EMBED_MAX_CHARS}) AS embed_text, length(left(text, {C.EMBED_MAX_CHARS}))::BIGINT AS embed_len
FROM documents
"""

# A: anonymisation -------------------------------------------------------------

ORACLE["scrub_pii"] = f"""
SELECT doc_id, {scrub('text')} AS text, {scrub('text')} <> text AS changed FROM documents
"""

_audit_parts = []
for _i, (_kind, _pat, _rep) in enumerate(C.PII_RULES):
    _audit_parts.append(
        f"SELECT doc_id, {lit(_kind)} AS kind, unnest(regexp_extract_all({scrub('text', _i)}, {lit(_pat)}, 0, 'i')) AS match FROM documents")
ORACLE["pii_audit"] = f"""
WITH m AS ({' UNION ALL '.join(_audit_parts)})
SELECT doc_id, kind, match, count(*)::BIGINT AS n FROM m GROUP BY doc_id, kind, match
"""

ORDERS_C = """
oc AS (SELECT o.*, cu.c_custkey, cu.c_name, cu.c_mktsegment FROM orders o LEFT JOIN customer cu ON o.o_custkey = cu.c_custkey)
"""

ORACLE["user_mapping"] = f"""
WITH {CONV}, {ORDERS_C},
refs AS (
  SELECT c_custkey AS user_id, c_name AS name, 0 AS src, o_orderkey AS pos, 0 AS role_rank, 0 AS idx FROM oc WHERE c_custkey IS NOT NULL
  UNION ALL SELECT o_custkey + 1, 'Watcher ' || CAST(o_custkey + 1 AS VARCHAR), 0, o_orderkey, 3, 0 FROM oc WHERE o_custkey % 5 > 0
  UNION ALL SELECT {roleid('role0')}, role0, 1, conv_id, 0, 0 FROM ci WHERE {roleid('role0')} IS NOT NULL
  UNION ALL SELECT * FROM (SELECT {roleid('role')} AS user_id, role AS name, 1 AS src, conv_id AS pos, 2 AS role_rank,
                                  row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx FROM j)
            WHERE user_id IS NOT NULL)
SELECT user_id::BIGINT AS user_id, {uname('name')} AS original_name, {anon('user_id')} AS anonymous_name
FROM refs QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY src, pos, role_rank, idx) = 1
"""

_who = f"(CASE WHEN {roleid('role')} IS NOT NULL THEN {anon(roleid('role'))} ELSE role END)"
ORACLE["anonymize_users"] = f"""
WITH {CONV},
ju AS (SELECT conv_id, string_agg(coalesce({_who}, ''), ',' ORDER BY turn) AS users,
              string_agg(coalesce({scrub('text')}, ''), {NL} ORDER BY turn) AS notes FROM j GROUP BY conv_id)
SELECT ci.conv_id AS issue_id,
  CASE WHEN {roleid('role0')} IS NOT NULL THEN {anon(roleid('role0'))} ELSE role0 END AS author_name,
  coalesce(ju.users, '') AS journal_users, coalesce(ju.notes, '') AS notes, {scrub('text0')} AS description
FROM ci LEFT JOIN ju ON ci.conv_id = ju.conv_id
"""

ORACLE["anonymize_watchers"] = f"""
SELECT o_orderkey AS issue_id, {anon('c_custkey')} AS author,
  CASE WHEN o_custkey % 5 > 0 THEN {anon('(o_custkey + 1)')} ELSE '' END AS watchers
FROM (WITH {ORDERS_C} SELECT * FROM oc)
"""

ORACLE["anonymize_summary"] = f"""
WITH {ORDERS_C}
SELECT count(*)::BIGINT AS issues_processed,
  (SELECT count(DISTINCT u) FROM (SELECT c_custkey AS u FROM oc UNION ALL SELECT o_custkey + 1 FROM oc WHERE o_custkey % 5 > 0))::BIGINT AS distinct_users,
  first(c_name ORDER BY o_orderkey) AS sample_author_before,
  first(CASE WHEN c_custkey IS NOT NULL THEN {anon('c_custkey')} END ORDER BY o_orderkey) AS sample_author_after
FROM oc
"""

# M: incremental load and merge ----------------------------------------------

V = f"""
v AS (SELECT user_id AS id, event_id, ts, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS updated_on,
             event_type AS project_identifier, value FROM events)
"""
VC = "id, event_id, updated_on, project_identifier, value"
CUT = f"TIMESTAMP '{I.CUTOFF}'"


def inlist(xs) -> str:
    return "(" + ", ".join(lit(x) for x in xs) + ")"


ORACLE["changed_since"] = f"WITH {V} SELECT {VC} FROM v WHERE ts >= {CUT}"

ORACLE["resolve_since"] = f"""
WITH st AS (SELECT event_type AS project_id, strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ') AS s FROM events GROUP BY event_type)
SELECT min(s) AS since FROM st WHERE project_id IN {inlist(I.EVENT_PROJECTS)} AND s <> ''
"""

ORACLE["merge_upsert"] = f"""
WITH {V},
ex AS (SELECT *, 0 AS src FROM v WHERE ts < {CUT} QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts DESC, event_id DESC) = 1),
inc AS (SELECT *, 1 AS src FROM v WHERE ts >= {CUT}),
u AS (SELECT * FROM ex UNION ALL SELECT * FROM inc)
SELECT {VC} FROM u QUALIFY row_number() OVER (PARTITION BY id ORDER BY src DESC, ts DESC, event_id DESC) = 1
"""

ORACLE["merge_counts"] = f"""
WITH {V},
ex AS (SELECT DISTINCT id FROM v WHERE ts < TIMESTAMP '{I.EARLY}'),
inc AS (SELECT id FROM v WHERE ts >= TIMESTAMP '{I.EARLY}')
SELECT (SELECT count(DISTINCT id) FROM inc WHERE id NOT IN (SELECT id FROM ex))::BIGINT AS n_new,
  ((SELECT count(*) FROM inc) - (SELECT count(DISTINCT id) FROM inc WHERE id NOT IN (SELECT id FROM ex)))::BIGINT AS n_updated
"""

ORACLE["dedup_last"] = f"""
WITH {V}
SELECT {VC}, min(event_id) OVER (PARTITION BY id) AS first_event_id FROM v
QUALIFY row_number() OVER (PARTITION BY id ORDER BY event_id DESC) = 1
"""

ORACLE["project_union"] = f"""
WITH {V}
SELECT {VC}, (CASE project_identifier {' '.join(f"WHEN {lit(p)} THEN {i + 1}" for i, p in enumerate(I.UNION_PROJECTS))} END)::BIGINT AS project_rank
FROM v WHERE project_identifier IN {inlist(I.UNION_PROJECTS)}
"""

ORACLE["journals_only"] = f"""
WITH {ALLI}
SELECT id, project_identifier, n_journals::BIGINT AS n_journals FROM ai
WHERE project_identifier NOT IN {inlist(I.JOURNALS_ONLY)} OR n_journals > 0
"""

ORACLE["missing_journals"] = f"""
WITH {ALLI}
SELECT id, project_identifier FROM ai WHERE n_journals <= 0
"""

ORACLE["enrich_overlay"] = f"""
WITH {CONV}, {DOCI}
SELECT di.id AS id,
  CASE WHEN ci.conv_id IS NOT NULL THEN ci.subj ELSE di.subj END AS subject,
  CASE WHEN ci.conv_id IS NOT NULL THEN {proj('ci.conv_id')} ELSE di.project_identifier END AS project_identifier,
  (CASE WHEN ci.conv_id IS NOT NULL THEN ci.n - 1 ELSE 0 END)::BIGINT AS n_journals
FROM di LEFT JOIN ci ON di.id = ci.conv_id
"""

ORACLE["journal_coverage"] = f"""
WITH {ALLI}
SELECT project_identifier, count(*) FILTER (WHERE n_journals > 0)::BIGINT AS with_journals, count(*)::BIGINT AS total,
  round(count(*) FILTER (WHERE n_journals > 0) * 100.0 / count(*), 6) AS pct
FROM ai GROUP BY project_identifier
"""

ORACLE["resume_pending"] = f"""
SELECT DISTINCT user_id AS id FROM events
WHERE user_id NOT IN (SELECT user_id FROM events WHERE ts < TIMESTAMP '{I.EARLY}')
"""

ORACLE["load_completeness"] = f"""
WITH t AS (SELECT event_type AS project_id, count(DISTINCT user_id) AS total FROM events GROUP BY 1),
d AS (SELECT event_type AS project_id, count(DISTINCT user_id) AS done FROM events WHERE ts < {CUT} GROUP BY 1)
SELECT t.project_id, coalesce(d.done, 0)::BIGINT AS done, t.total::BIGINT AS total, coalesce(d.done, 0) >= t.total AS complete
FROM t LEFT JOIN d ON t.project_id = d.project_id
"""

ORACLE["load_progress"] = f"""
WITH t AS (SELECT event_type AS project_id, count(*) AS total FROM events GROUP BY 1),
d AS (SELECT event_type AS project_id, count(*) AS done,
             (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0 AS elapsed
      FROM events WHERE ts < {CUT} GROUP BY 1)
SELECT t.project_id, coalesce(d.done, 0)::BIGINT AS done, t.total::BIGINT AS total,
  round(coalesce(d.done, 0) * 100.0 / t.total, 6) AS pct,
  round(CASE WHEN d.elapsed > 0 THEN coalesce(d.done, 0) / d.elapsed ELSE 0.0 END, 6) AS rate,
  greatest(t.total - coalesce(d.done, 0), 0)::BIGINT AS remaining
FROM t LEFT JOIN d ON t.project_id = d.project_id
"""

ORACLE["quality_profile"] = f"""
WITH {ALLI}
SELECT project_identifier, count(*)::BIGINT AS issues,
  round(avg(CASE WHEN n_journals > 0 THEN 1.0 ELSE 0.0 END), 6) AS share_with_journals,
  round(avg(n_journals::DOUBLE), 6) AS mean_journals,
  round(avg(CASE WHEN regexp_matches(coalesce(description, ''), {lit(I.MARKER)}, 'i') THEN 1.0 ELSE 0.0 END), 6) AS share_marker,
  round(avg(CASE WHEN regexp_matches(coalesce(description, ''), {lit(I.NOISE)}, 'i') THEN 1.0 ELSE 0.0 END), 6) AS share_noise_url
FROM ai GROUP BY project_identifier
"""

ORACLE["project_counts"] = f"""
WITH {ALLI}
SELECT project_identifier, count(*)::BIGINT AS n_issues FROM ai GROUP BY project_identifier
"""

ORACLE["sync_state"] = f"""
WITH b AS (SELECT event_type AS project_id, strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ') AS last_synced_at, 1 AS sync_count
           FROM events WHERE ts < {CUT} GROUP BY 1),
s AS (SELECT DISTINCT event_type AS project_id FROM events WHERE ts >= {CUT} AND event_type IN {inlist(I.UNION_PROJECTS)})
SELECT coalesce(b.project_id, s.project_id) AS project_id,
  CASE WHEN s.project_id IS NOT NULL THEN {lit(I.RUN_STARTED_AT)} ELSE b.last_synced_at END AS last_synced_at,
  (CASE WHEN s.project_id IS NOT NULL THEN coalesce(b.sync_count, 0) + 1 ELSE b.sync_count END)::BIGINT AS sync_count
FROM b FULL OUTER JOIN s ON b.project_id = s.project_id
"""

# V: vector search on the embeddings table -------------------------------------

LABEL_Q = """
el AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
lm AS (SELECT label, pos, avg(x) AS m FROM el GROUP BY label, pos),
lv AS (SELECT label, list(m ORDER BY pos) AS v FROM lm GROUP BY label),
q AS (SELECT label::BIGINT AS question_id, CAST(label AS VARCHAR) AS qlabel,
             list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM lv),
e AS (SELECT CAST(vec_id AS VARCHAR) AS id, CAST(vec_id // 4 AS VARCHAR) AS parent, CAST(label AS VARCHAR) AS label,
             embedding::DOUBLE[] AS emb FROM embeddings)
"""


def vpairs(metric: str = "l2sq", filtered: bool = False) -> str:
    d = ("pow(list_distance(e.emb, q.v), 2)" if metric == "l2sq"
         else "1 - list_cosine_similarity(e.emb, q.v)")
    w = "WHERE e.label = q.qlabel" if filtered else ""
    return f"(SELECT q.question_id, e.id, e.parent, {d} AS score FROM q, e {w})"


def vquery(top_k: int, dedup: bool, filtered: bool, metric: str = "l2sq", gate=None) -> str:
    return f"""
WITH {LABEL_Q}, {ranked_search(vpairs(metric, filtered), top_k, dedup, gate)}
SELECT question_id, id, parent, round(score, 6) AS score, rank::BIGINT AS rank, {str(filtered).lower()} AS filtered FROM res
"""


ORACLE["knn_raw"] = vquery(5, False, False)
ORACLE["knn_filtered"] = vquery(5, False, True)
ORACLE["best_per_parent"] = vquery(10, True, False)
ORACLE["search"] = vquery(5, True, True)
ORACLE["score_gate"] = vquery(5, True, True, gate=I.GATE)
ORACLE["knn_cosine"] = vquery(5, True, False, metric="cosine")


def _fallback() -> str:
    filt = ranked_search(vpairs("l2sq", True), 5, True, I.GATE)
    unf = ranked_search(vpairs("l2sq", False), 5, True, I.GATE).replace("fw AS", "fw2 AS").replace(
        "FROM fw", "FROM fw2").replace("dd AS", "dd2 AS").replace("FROM dd", "FROM dd2").replace(
        "kk AS", "kk2 AS").replace("FROM kk", "FROM kk2").replace("res AS", "res2 AS")
    return f"""
WITH {LABEL_Q}, {filt}, {unf}
SELECT question_id, id, parent, round(score, 6) AS score, rank::BIGINT AS rank, true AS filtered FROM res
UNION ALL
SELECT question_id, id, parent, round(score, 6) AS score, rank::BIGINT AS rank, false AS filtered FROM res2
WHERE question_id NOT IN (SELECT question_id FROM res)
"""


ORACLE["search_fallback"] = _fallback()

# R: filters, prompts, sources ---------------------------------------------------

_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'Closed' WHEN 'O' THEN 'New' WHEN 'P' THEN 'In Progress' END"
_PRIO = ("CASE o_orderpriority WHEN '1-URGENT' THEN 'Immediate' WHEN '2-HIGH' THEN 'Urgent' "
         "WHEN '3-MEDIUM' THEN 'High' WHEN '4-NOT SPECIFIED' THEN 'Normal' WHEN '5-LOW' THEN 'Low' END")
ORACLE["parse_filters"] = f"""
WITH {ORDERS_C}
SELECT o_orderkey AS question_id,
  CASE WHEN o_orderkey % 6 < 2 AND ({_STATUS}) IN {inlist(C.KNOWN_STATUSES)} THEN {_STATUS} END AS status,
  CASE WHEN o_orderkey % 6 < 2 AND ({_PRIO}) IN {inlist(C.KNOWN_PRIORITIES)} THEN {_PRIO} END AS priority,
  CASE WHEN o_orderkey % 6 < 2 THEN CASE o_orderkey % 3 WHEN 0 THEN 'qe-kernel' WHEN 1 THEN 'performance' END END AS project_id
FROM oc
"""

ORACLE["extraction_prompt"] = f"""
SELECT item_id AS question_id, {lit(C.FILTER_EXTRACTION_PROMPT)} || text || {lit(C.FILTER_EXTRACTION_SUFFIX)} AS prompt
FROM benchmark
"""

ORACLE["filter_predicate"] = f"""
SELECT {iid('o_orderkey')} AS issue_id, {_STATUS} AS status, {_PRIO} AS priority FROM orders
WHERE ({_STATUS}) = 'New' AND ({_PRIO}) = 'High'
"""


def text_search(chunks_cte: str, top_k: int = C.TOP_K) -> str:
    """CTEs: chunks, hash vectors of chunks and benchmark questions, ``res`` hits."""
    return f"""
{chunks_cte},
{WINDOWS},
{hash_vectors('cv', 'wch', 'id', 'text')},
{hash_vectors('qv', 'benchmark', 'item_id', 'text')},
tp AS (SELECT qv.k AS question_id, ch.chunk_id AS id, ch.issue_id AS parent, min(pow(list_distance(cv.v, qv.v), 2)) AS score
       FROM qv, cv JOIN wch ch ON ch.id = cv.k GROUP BY ALL),
{ranked_search('tp', top_k, True)}
"""


_CONV_SEARCH = f"""{CONV}, {text_search(conv_chunks(C.JOURNALS_PER_CHUNK, None, True, True))}"""


def _meta(c: str) -> str:
    return f"coalesce(CAST({c} AS VARCHAR), '?')"


_BLOCK = (f"'[Issue #' || {_meta('ch.issue_id')} || ' | ' || {_meta('ch.project')} || ' | ' || {_meta('ch.status')} || ' | ' || "
          f"{_meta('ch.priority')} || ' | created: ' || {_meta('ch.created_on')} || ' | updated: ' || {_meta('ch.updated_on')} || ']' || {NL} || "
          f"{strip('coalesce(ch.text, ' + chr(39) + chr(39) + ')')} || {NL}")

ORACLE["prompt"] = f"""
WITH {_CONV_SEARCH},
blk AS (SELECT res.question_id, string_agg({_BLOCK}, {lit(C.BLOCK_SEPARATOR)} ORDER BY res.rank) AS body
        FROM res JOIN chunks ch ON ch.id = res.id GROUP BY res.question_id)
SELECT b.item_id AS question_id,
  {lit(C.PROMPT_HEAD)} || coalesce(blk.body, {lit(C.NO_ISSUES_TEXT)}) || {lit(chr(10) + '--- End of Issues ---' + chr(10) + chr(10) + 'Question: ')}
    || coalesce(b.text, '') || {NL} AS prompt
FROM benchmark b LEFT JOIN blk ON blk.question_id = b.item_id
"""

ORACLE["source_cards"] = f"""
WITH {_CONV_SEARCH}
SELECT res.question_id, res.rank::BIGINT AS rank, coalesce(ch.issue_id, '') AS issue_id,
  {lit(C.TRACKER_BASE_URL.rstrip('/') + '/issues/')} || coalesce(ch.issue_id, '') AS issue_url,
  left(coalesce(ch.subject, ''), 120) AS subject, coalesce(ch.project, '') AS project,
  coalesce(ch.project_id, '') AS project_id, coalesce(ch.status, '') AS status, coalesce(ch.priority, '') AS priority,
  left(coalesce(ch.created_on, ''), 10) AS created_on, left(coalesce(ch.updated_on, ''), 10) AS updated_on,
  left({strip("coalesce(ch.text, '')")}, 600) AS snippet,
  CASE WHEN coalesce(ch.priority, '') <> '' AND coalesce(ch.priority, '') <> 'Normal' THEN ch.priority END AS priority_badge
FROM res JOIN chunks ch ON ch.id = res.id
"""

ORACLE["source_list"] = f"""
WITH {_CONV_SEARCH}
SELECT res.question_id, res.rank::BIGINT AS rank, {_meta('ch.issue_id')} AS issue_id, {_meta('ch.project')} AS project,
  {_meta('ch.status')} AS status, left(coalesce(ch.subject, ''), 80) AS subject
FROM res JOIN chunks ch ON ch.id = res.id
"""

# Both stand-in models are deterministic, so the flow is plain SQL.  A
# question is ranked twice, with its filters (odd key) and without (even key).
_ANSWERS = text_search(conv_chunks(C.JOURNALS_PER_CHUNK, None, True, True)).replace(
    hash_vectors('qv', 'benchmark', 'item_id', 'text'), hash_vectors('qv', 'asked', 'item_id', 'text'))
_ANSWERS = _ANSWERS[:_ANSWERS.index("tp AS (")] + f"""
tp AS (SELECT a.item_id * 2 + u.f AS question_id, ch.chunk_id AS id, ch.issue_id AS parent,
              min(pow(list_distance(cv.v, qv.v), 2)) AS score
       FROM asked a JOIN qv ON qv.k = a.item_id, cv JOIN wch ch ON ch.id = cv.k, (VALUES (0), (1)) u(f)
       WHERE u.f = 0 OR (coalesce(a.status, a.priority, a.project_id) IS NOT NULL
             AND ch.status = coalesce(a.status, ch.status) AND ch.priority = coalesce(a.priority, ch.priority)
             AND ch.project_id = coalesce(a.project_id, ch.project_id)) GROUP BY ALL),
{ranked_search('tp', C.TOP_K, True)}"""

ORACLE["answer_batch"] = f"""
WITH asked AS (
  SELECT item_id, text || CASE item_id % 4 WHEN 1 THEN ' Which of them are new?' WHEN 2 THEN ' Only urgent ones, please.'
                          WHEN 3 THEN ' Which are resolved, for the kernel?' ELSE '' END AS text,
         CASE item_id % 4 WHEN 1 THEN 'New' WHEN 3 THEN 'Resolved' END AS status,
         CASE item_id % 4 WHEN 2 THEN 'Urgent' END AS priority,
         CASE item_id % 4 WHEN 3 THEN 'qe-kernel' END AS project_id
  FROM benchmark),
{CONV}, {_ANSWERS},
picked AS (SELECT question_id // 2 AS item_id, question_id % 2 AS filtered, rank, parent FROM res
           QUALIFY question_id % 2 = max(question_id % 2) OVER (PARTITION BY question_id // 2)),
said AS (SELECT item_id, string_agg('(Issue #' || parent || ')', ', ' ORDER BY rank) AS cited, count(*)::BIGINT AS n_hits,
                max(filtered) AS filtered FROM picked GROUP BY item_id)
SELECT a.item_id AS question_id,
  coalesce('Relevant issues: ' || cited, 'The retrieved issues do not contain enough information to answer.') AS answer,
  coalesce(n_hits, 0) AS n_hits,
  CASE WHEN coalesce(filtered, 0) = 0 THEN '{{}}' WHEN a.item_id % 4 = 1 THEN '{{"status":"New"}}'
       WHEN a.item_id % 4 = 2 THEN '{{"priority":"Urgent"}}' ELSE '{{"status":"Resolved","project_id":"qe-kernel"}}' END AS filters
FROM asked a LEFT JOIN said ON said.item_id = a.item_id
"""

# Q: retrieval evaluation -----------------------------------------------------------

_DOC_SEARCH = text_search(DOC_CHUNKS)
_PERQ = f"""
hq AS (SELECT res.question_id, res.parent AS issue_id, res.score,
              instr(ch.text, b.text) > 0 AS relevant
       FROM res JOIN chunks ch ON ch.issue_id = res.parent JOIN benchmark b ON b.item_id = res.question_id),
pq AS (SELECT b.item_id AS question_id, b.text AS question,
         coalesce(string_agg(DISTINCT hq.issue_id, ',' ORDER BY hq.issue_id), '') AS retrieved_ids,
         round(min(hq.score), 6) AS best_score, count(hq.question_id)::BIGINT AS n_results,
         coalesce(bool_or(hq.relevant), false) AS hit
       FROM benchmark b LEFT JOIN hq ON hq.question_id = b.item_id GROUP BY b.item_id, b.text)
"""

ORACLE["hit_per_question"] = f"""
WITH {_DOC_SEARCH}, {_PERQ}
SELECT question_id, retrieved_ids, best_score, n_results, hit,
  CASE WHEN hit IS NULL THEN 'N/A' WHEN hit THEN 'HIT' ELSE 'MISS' END AS label FROM pq
"""

_SUMMARY = """count(*)::BIGINT AS total, count(hit)::BIGINT AS evaluable, count(*) FILTER (WHERE hit)::BIGINT AS hits,
  count(*) FILTER (WHERE hit IS NULL)::BIGINT AS not_applicable,
  round(count(*) FILTER (WHERE hit) * 100.0 / nullif(count(hit), 0), 6) AS hit_rate_pct"""

ORACLE["hit_expected"] = f"""
WITH {_DOC_SEARCH},
want AS (SELECT DISTINCT item_id, CAST(unnest([item_id, item_id * 7]) AS VARCHAR) AS want FROM benchmark WHERE item_id % 5 <> 0),
got AS (SELECT res.question_id, string_agg(DISTINCT res.parent, ',' ORDER BY res.parent) AS retrieved_ids,
               bool_or(want.want IS NOT NULL) AS hit
        FROM res LEFT JOIN want ON want.item_id = res.question_id AND want.want = res.parent GROUP BY res.question_id),
ids AS (SELECT item_id, string_agg(want, ',' ORDER BY want) AS expected_ids FROM want GROUP BY item_id)
SELECT b.item_id AS question_id, coalesce(retrieved_ids, '') AS retrieved_ids, coalesce(expected_ids, '') AS expected_ids,
  CASE WHEN b.item_id % 5 = 0 THEN 'N/A' WHEN coalesce(hit, false) THEN 'HIT' ELSE 'MISS' END AS label
FROM benchmark b LEFT JOIN got ON got.question_id = b.item_id LEFT JOIN ids ON ids.item_id = b.item_id
"""

ORACLE["hit_rate"] = f"""
WITH {_DOC_SEARCH}, {_PERQ}
SELECT {_SUMMARY} FROM pq
"""

ORACLE["hit_rate_by_tag"] = f"""
WITH {_DOC_SEARCH}, {_PERQ},
tg AS (SELECT *, CASE WHEN length(question) < 200 THEN 'short' ELSE 'long' END AS tag FROM pq
       UNION ALL SELECT *, 'all' AS tag FROM pq)
SELECT tag, {_SUMMARY} FROM tg GROUP BY tag
"""


def _sweep() -> str:
    ks, gates = (1, 3, 5), ("NULL", "1.0")
    fetch = max(ks) * C.OVERFETCH
    return f"""
WITH {DOC_CHUNKS},
{WINDOWS},
{hash_vectors('cv', 'wch', 'id', 'text')},
{hash_vectors('qv', 'benchmark', 'item_id', 'text')},
tp AS (SELECT qv.k AS question_id, ch.chunk_id AS id, ch.issue_id AS parent, min(pow(list_distance(cv.v, qv.v), 2)) AS score
       FROM qv, cv JOIN wch ch ON ch.id = cv.k GROUP BY ALL),
fw AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9), id) AS fetch_rank FROM tp
       QUALIFY fetch_rank <= {fetch}),
grid AS (SELECT * FROM (VALUES {', '.join(f'({k}, {g}::DOUBLE)' for k in ks for g in gates)}) t(k, threshold)),
g1 AS (SELECT fw.*, grid.k, grid.threshold FROM fw, grid WHERE fw.fetch_rank <= grid.k * {C.OVERFETCH}),
g2 AS (SELECT * FROM g1 QUALIFY row_number() OVER (PARTITION BY k, threshold, question_id, parent ORDER BY fetch_rank) = 1),
g3 AS (SELECT *, row_number() OVER (PARTITION BY k, threshold, question_id ORDER BY fetch_rank) AS rank FROM g2 QUALIFY rank <= k),
g4 AS (SELECT * FROM g3 QUALIFY threshold IS NULL OR min(round(score, 9)) OVER (PARTITION BY k, threshold, question_id) <= threshold),
rel AS (SELECT g4.k, g4.threshold, g4.question_id, max(CASE WHEN instr(ch.text, b.text) > 0 THEN 1 ELSE 0 END) AS h
        FROM g4 JOIN chunks ch ON ch.issue_id = g4.parent JOIN benchmark b ON b.item_id = g4.question_id
        GROUP BY g4.k, g4.threshold, g4.question_id)
SELECT k, threshold, count(*)::BIGINT AS answered, sum(h)::BIGINT AS hits FROM rel GROUP BY k, threshold
"""


ORACLE["hit_rate_sweep"] = _sweep()

_RATES = """grouping(tag, k, threshold)::BIGINT AS level, count(*)::BIGINT AS answered, sum(h)::BIGINT AS hits,
  round(sum(h) * 100.0 / count(*), 6) AS hit_rate_pct"""
ORACLE["hit_rate_cube"] = _sweep()[:_sweep().rindex("SELECT k, threshold, count(*)")] + f"""
SELECT tag, coalesce(k, 0) AS k, threshold, {_RATES}
FROM (SELECT rel.*, CASE WHEN length(b.text) < 200 THEN 'short' ELSE 'long' END AS tag
      FROM rel JOIN benchmark b ON b.item_id = rel.question_id)
GROUP BY GROUPING SETS ((tag, k, threshold), (k, threshold), (tag), ())
"""

# T: run-log analytics -------------------------------------------------------------

ORACLE["stage_share"] = """
WITH st AS (SELECT user_id, event_type, sum(value) AS elapsed FROM events GROUP BY 1, 2),
p AS (SELECT *, CASE WHEN sum(elapsed) OVER (PARTITION BY user_id) > 0
                THEN elapsed / sum(elapsed) OVER (PARTITION BY user_id) * 100.0 ELSE 0.0 END AS pct0 FROM st)
SELECT user_id, event_type, round(elapsed, 6) AS elapsed, round(pct0, 6) AS pct, repeat('#', CAST(floor(pct0 / 5) AS INTEGER)) AS bar
FROM p
"""

ORACLE["rolling_eta"] = f"""
WITH x AS (SELECT event_id, user_id, sum(CAST(round(value * 100) AS BIGINT)) OVER w AS s, count(value) OVER w AS n
           FROM events
           WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN {C.ETA_WINDOW} PRECEDING AND 1 PRECEDING))
SELECT event_id, user_id,
  CASE WHEN n > 0 THEN ((2 * s * 10000 + n) // (2 * n)) / 1000000.0 ELSE {C.DEFAULT_ETA_SECONDS} END AS mean_duration,
  CASE WHEN n > 0 THEN ((2 * s + 10 * n) // (20 * n)) / 10.0 ELSE {C.DEFAULT_ETA_SECONDS} END AS eta
FROM x
"""

ORACLE["throughput"] = """
SELECT event_type, count(*)::BIGINT AS items,
  round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0, 6) AS elapsed,
  round(CASE WHEN (epoch_us(max(ts)) - epoch_us(min(ts))) > 0
        THEN count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0) ELSE 0.0 END, 6) AS per_second
FROM events GROUP BY event_type
"""

ORACLE["query_time"] = """
WITH g AS (SELECT user_id, coalesce(sum(value) FILTER (WHERE event_type = 'click'), 0.0) AS f,
                  coalesce(sum(value) FILTER (WHERE event_type = 'view'), 0.0) AS r,
                  coalesce(sum(value) FILTER (WHERE event_type = 'purchase'), 0.0) AS g FROM events GROUP BY user_id)
SELECT user_id, round(CASE WHEN f > 0 THEN f END, 6) AS t_filter, round(r, 6) AS t_retrieve, round(g, 6) AS t_generate,
  round(f + r + g, 6) AS total FROM g
"""

# E: embedding -------------------------------------------------------------------------

ORACLE["hash_embed"] = f"""
WITH {hash_vectors('dv', 'documents', 'doc_id', 'text')},
x AS (SELECT k AS doc_id, unnest(v) AS w, generate_subscripts(v, 1) - 1 AS bucket FROM dv)
SELECT doc_id, bucket::BIGINT AS bucket, round(w, 9) AS w FROM x WHERE w <> 0
"""

# X: streaming (compared with the batch result of the same files) ----------------------

ORACLE["stream_upsert"] = """
SELECT user_id AS id, event_id, event_type, round(value, 6) AS value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1
"""

ORACLE["stream_windows"] = """
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*)::BIGINT AS n,
  round(sum(value), 6) AS total
FROM events GROUP BY 1, 2
"""

ORACLE["stream_chunks"] = f"""
WITH {DOC_CHUNKS}
SELECT id, text, issue_id FROM chunks
"""

ORACLE["stream_chunk_state"] = f"""
WITH {CONV}, {conv_chunks(C.JOURNALS_PER_CHUNK, C.CHUNK_MAX_TEXT_LEN, False, False)}
SELECT id, text, issue_id, chunk_index::BIGINT AS chunk_index, is_description FROM chunks
"""

ORACLE["search_approx_recall"] = f"""
WITH {_DOC_SEARCH}
SELECT count(*)::BIGINT AS wanted, true AS reached FROM res
"""

ORACLE["search_labelled"] = f"""
WITH {DOC_CHUNKS},
lab AS (SELECT {iid('doc_id')} AS issue_id, CAST(quality AS VARCHAR) AS quality FROM labels),
{WINDOWS},
{hash_vectors('cv', 'wch', 'id', 'text')},
{hash_vectors('qv', 'benchmark', 'item_id', 'text')},
tp AS (SELECT qv.k AS question_id, ch.chunk_id AS id, ch.issue_id AS parent, min(pow(list_distance(cv.v, qv.v), 2)) AS score
       FROM qv, cv JOIN wch ch ON ch.id = cv.k JOIN lab ON lab.issue_id = ch.issue_id
       WHERE lab.quality = '1' GROUP BY ALL),
{ranked_search('tp', C.TOP_K, True)}
SELECT question_id, id, parent, round(score, 6) AS score, rank::BIGINT AS rank, true AS filtered FROM res
"""

ORACLE["scrub_pages"] = f"""
SELECT page_id, {scrub("concat_ws(chr(10), url, html)", rules=I.PAGE_RULES)} AS text,
  {scrub("concat_ws(chr(10), url, html)", rules=I.PAGE_RULES)} <> concat_ws(chr(10), url, html) AS changed
FROM pages
"""

ORACLE["stream_late"] = ORACLE["stream_upsert"]
ORACLE["latest_versions"] = ORACLE["stream_upsert"]

# S: results and state -------------------------------------------------------------

ORACLE["numbered_results"] = """
SELECT item_id AS question_id, row_number() OVER (ORDER BY item_id) AS position,
  '=== Q' || CAST(row_number() OVER (ORDER BY item_id) AS VARCHAR) || '/' || CAST(count(*) OVER () AS VARCHAR) || ': '
  || coalesce(text, '') || ' ===' AS header
FROM benchmark
"""

ORACLE["sync_state_roundtrip"] = f"""
SELECT p.project_id, s.last_synced_at, CAST(coalesce(s.sync_count, 0) AS INTEGER) AS sync_count
FROM (SELECT DISTINCT event_type AS project_id FROM events UNION ALL SELECT 'never-synced') p
LEFT JOIN ({ORACLE["sync_state"]}) s ON s.project_id = p.project_id
"""

# the batch job: a full load with enrichment, then an incremental run; chunks cut at 8192 characters, windows of 1500

_STORED = f"""
stored AS (
  SELECT doc_id, source, split_part(text, {NL}, 1) AS subj, false AS noted, text AS descr FROM documents WHERE doc_id % 3 <> 0
  UNION ALL
  SELECT doc_id, source, split_part(text, {NL}, 1), doc_id % 12 = 0,
         CASE WHEN doc_id % 12 = 0 THEN 'whole ' ELSE 'draft ' END || text
  FROM documents WHERE doc_id % 6 = 0 AND (doc_id % 12 = 0 OR source NOT IN {inlist(I.JOURNALS_ONLY)}))"""
_JOB_TEXT = strip(f"""'Subject: ' || coalesce(subj, '') || CASE WHEN {nonempty(scrub('descr'))}
                      THEN {NL} || 'Description: ' || {scrub('descr')} ELSE '' END""")

ORACLE["ingest_job"] = f"""
WITH {_STORED},
chunks AS (
  SELECT 'issue_' || {iid('doc_id')} AS id, {trunc(_JOB_TEXT, 8192)} AS text, {iid('doc_id')} AS issue_id, source AS project
  FROM stored WHERE source IS NOT NULL
  UNION ALL
  SELECT 'issue_' || {iid('doc_id')} || '_chunk_1', {trunc(f"""'Subject: ' || coalesce(subj, '') || {NL} || 'Comments:' || {NL}
         || '- User_00007: see [OPENQA-URL] on [REDACTED-HOST] or ask [REDACTED-EMAIL]'""", 8192)}, {iid('doc_id')}, source
  FROM stored WHERE noted AND source IS NOT NULL),
{WINDOWS}
SELECT id, chunk_id, part, issue_id, whole AS text, project FROM wch
"""

ORACLE["run_numbers"] = f"""
WITH first AS (
  SELECT doc_id, split_part(text, {NL}, 1) AS subj, doc_id % 12 = 0 AS noted,
         CASE WHEN doc_id % 12 = 0 THEN 'whole ' ELSE 'draft ' END || text AS descr
  FROM documents WHERE doc_id % 2 = 0 AND source IS NOT NULL AND (doc_id % 12 = 0 OR source NOT IN {inlist(I.JOURNALS_ONLY)})),
runs AS (
  SELECT '2024-01-01T00:00:00Z' AS started_at, * FROM first
  UNION ALL
  SELECT '2024-02-01T00:00:00Z', doc_id, split_part(text, {NL}, 1), false, text
  FROM documents WHERE doc_id % 3 <> 0 AND source IS NOT NULL),
sized AS (SELECT *, greatest(1, (length({trunc(_JOB_TEXT, 8192)}) + 1499) // 1500) AS k,
                 length('Subject: ' || coalesce(subj, '')) + length('Comments:- User_00007: see [OPENQA-URL] on [REDACTED-HOST] or ask [REDACTED-EMAIL]') + 2 AS note
          FROM runs)
SELECT started_at, count(*)::BIGINT AS issues, count_if(noted)::BIGINT AS with_journals, count(*)::BIGINT AS chunked_issues,
  (count(*) + count_if(noted))::BIGINT AS chunks,
  (sum(k) + coalesce(sum((least(note, 8206) + 1499) // 1500) FILTER (noted), 0))::BIGINT AS windows
FROM sized GROUP BY started_at
"""

ORACLE["stream_sliding"] = """
WITH w AS (SELECT unnest([date_trunc('day', ts) + INTERVAL 12 HOUR * (CAST(date_part('hour', ts) AS INTEGER) // 12),
                          date_trunc('day', ts) + INTERVAL 12 HOUR * (CAST(date_part('hour', ts) AS INTEGER) // 12 - 1)]) AS s, event_type, value
           FROM events)
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*)::BIGINT AS n, round(sum(value), 6) AS total
FROM w GROUP BY 1, 2
"""

ORACLE["stream_sessions"] = """
WITH o AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 1 DAY THEN 1 ELSE 0 END AS opens
           FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM o),
s AS (SELECT user_id, min(ts) AS a, max(ts) + INTERVAL 1 DAY AS z, count(*) AS n FROM n GROUP BY user_id, k)
SELECT user_id, strftime(a, '%Y-%m-%d %H:%M:%S.%f') AS session_start, strftime(z, '%Y-%m-%d %H:%M:%S.%f') AS session_end, n::BIGINT AS n
FROM s WHERE z <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR FROM events)
"""

ORACLE["stream_late_rows"] = """
SELECT event_id, user_id FROM events WHERE ts < (SELECT max(ts) - INTERVAL 1 HOUR FROM events)
"""

ORACLE["stream_replays"] = """
SELECT event_id, user_id, event_type, round(value, 6) AS value FROM events
"""

_answers = ORACLE["answer_batch"].strip()
ORACLE["numbered_answers"] = f"""
SELECT a.question_id, n.position, n.header, a.answer, a.n_hits
FROM ({_answers}) a JOIN ({ORACLE["numbered_results"]}) n ON n.question_id = a.question_id
"""

# S8 + Q5: records of a whole evaluation.  Expected of a question: the conversations of its own number and of 7 times that.
_EVAL = ORACLE["answer_batch"].strip()
_EVAL = _EVAL[:_EVAL.index("said AS (")].replace("rank, parent FROM res", "rank, parent, score FROM res") + f"""
got AS (SELECT item_id, string_agg(DISTINCT parent, ',' ORDER BY parent) AS retrieved_ids, count(*) AS n_results,
               round(min(score), 6) AS best_score, max(filtered) AS filtered FROM picked GROUP BY item_id),
want AS (SELECT DISTINCT item_id, CAST(unnest([item_id, item_id * 7]) AS VARCHAR) AS w FROM benchmark WHERE item_id % 5 <> 0),
hits AS (SELECT want.item_id, bool_or(p.parent IS NOT NULL) AS hit, string_agg(DISTINCT w, ',' ORDER BY w) AS expected_ids
         FROM want LEFT JOIN picked p ON p.item_id = want.item_id AND p.parent = want.w GROUP BY want.item_id),
took AS (SELECT user_id, sum(value) AS elapsed FROM events GROUP BY user_id),
records AS (
  SELECT a.item_id AS question_id, a.text AS question, CASE WHEN length(b.text) < 200 THEN 'short' ELSE 'long' END AS tags,
    CASE WHEN coalesce(got.filtered, 0) = 0 THEN '{{}}' WHEN a.item_id % 4 = 1 THEN '{{"status":"New"}}'
         WHEN a.item_id % 4 = 2 THEN '{{"priority":"Urgent"}}' ELSE '{{"status":"Resolved","project_id":"qe-kernel"}}' END AS filters,
    coalesce(retrieved_ids, '') AS retrieved_ids, coalesce(expected_ids, '') AS expected_ids, best_score, hits.hit,
    round(coalesce(elapsed, 0), 6) AS elapsed, coalesce(n_results, 0)::BIGINT AS n_results
  FROM asked a JOIN benchmark b USING (item_id) LEFT JOIN got USING (item_id) LEFT JOIN hits USING (item_id)
  LEFT JOIN took ON took.user_id = a.item_id)"""

ORACLE["eval_records"] = _EVAL + """
SELECT question_id, question, tags, filters, retrieved_ids, expected_ids, best_score,
  CASE WHEN hit IS NULL THEN 'N/A' WHEN hit THEN 'HIT' ELSE 'MISS' END AS label, elapsed, n_results FROM records
"""
ORACLE["eval_summary"] = _EVAL + f"""
SELECT {_SUMMARY}, round(sum(elapsed), 6) AS total_elapsed FROM records
"""
