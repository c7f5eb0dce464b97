"""DuckDB SQL computing each registered query independently from the base tables."""

from __future__ import annotations

# Shared CTEs: threads from orders, messages from lineitem.
THREADS = """
threads AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS thread_id,
         CAST(o_orderdate AS TIMESTAMP) AS created_at,
         o_orderstatus AS status,
         o_orderpriority AS platform,
         CASE WHEN o_orderpriority = '1-URGENT' THEN 1
              WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL ELSE 0 END AS escalate_conversation
  FROM orders)"""

MESSAGES = """
msgs AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS thread_id,
         CAST(l_shipdate AS TIMESTAMP) AS ts,
         CASE WHEN l_returnflag = 'N' THEN ''
              ELSE concat_ws(' ', l_returnflag, l_linestatus, CAST(l_linenumber AS VARCHAR)) END AS c
  FROM lineitem)"""

AGG = """
agg AS (
  SELECT thread_id,
         coalesce(string_agg(nullif(c, ''), ' | ' ORDER BY ts ASC NULLS LAST, c ASC), '') AS full_conversation,
         count(*) AS msg_count, min(ts) AS first_msg, max(ts) AS last_msg
  FROM msgs GROUP BY thread_id)"""

MASTER = """
master AS (
  SELECT t.*, a.full_conversation, a.msg_count, a.first_msg, a.last_msg,
         coalesce((epoch_us(a.last_msg) - epoch_us(a.first_msg)) / 6e7, 0.0) AS duration_minutes
  FROM threads t JOIN agg a USING (thread_id))"""

WITH_MASTER = "WITH " + ",".join([THREADS, MESSAGES, AGG, MASTER])

FLAG = "coalesce(CAST(escalate_conversation AS INTEGER), 0)"

# Python's str.split()/strip() whitespace as an RE2 class (RE2 \s lacks \v).
WS = r"[\t\n\x0b\x0c\r\x1c-\x1f \x{85}\p{Z}]"


def ustrip(expr: str) -> str:
    return f"regexp_replace({expr}, '^{WS}+|{WS}+$', '', 'g')"


SQL: dict[str, str] = {}

SQL["conversation_agg"] = "WITH " + ",".join([MESSAGES, AGG]) + """
SELECT thread_id, full_conversation, msg_count, first_msg, last_msg FROM agg"""

SQL["conversation_agg_text"] = f"""
SELECT CAST(conv_id AS VARCHAR) AS thread_id,
       coalesce(string_agg(nullif({ustrip('text')}, ''), ' | '
                           ORDER BY turn ASC NULLS LAST, {ustrip('text')} ASC), '') AS full_conversation,
       count(*) AS msg_count
FROM conversations GROUP BY conv_id"""

SQL["master_table"] = WITH_MASTER + """
SELECT thread_id, created_at, status, platform, escalate_conversation, full_conversation, msg_count,
       first_msg, last_msg, round(duration_minutes, 6) AS duration_minutes FROM master"""

SQL["threads_without_messages"] = "WITH " + ",".join([THREADS, MESSAGES]) + """
SELECT thread_id, status, platform FROM threads
WHERE thread_id NOT IN (SELECT thread_id FROM msgs WHERE thread_id IS NOT NULL)"""

SQL["dropped_thread_count"] = "WITH " + ",".join([THREADS, MESSAGES]) + """
SELECT count(*) AS threads_before,
       count(*) FILTER (WHERE thread_id IN (SELECT thread_id FROM msgs)) AS threads_kept,
       count(*) FILTER (WHERE thread_id NOT IN (SELECT thread_id FROM msgs)) AS threads_dropped
FROM threads"""

SQL["duration_minutes"] = WITH_MASTER + """
SELECT thread_id, round(duration_minutes, 6) AS duration_minutes FROM master"""

SQL["label_coercion"] = "WITH " + THREADS + f"""
SELECT thread_id, {FLAG} AS escalation_flag FROM threads"""

_TOP_STATUS = """
SELECT status AS value, count(*) AS n FROM master WHERE status IS NOT NULL
GROUP BY status ORDER BY n DESC, value ASC LIMIT 5"""

_TOP_JSON = "(SELECT '{' || string_agg(CAST(to_json(value) AS VARCHAR) || ':' || n, ',' ORDER BY n DESC, value ASC) || '}' FROM top)"

SQL["impact_metrics"] = WITH_MASTER + f""",
top AS ({_TOP_STATUS})
SELECT round(avg({FLAG}), 6) AS tasa_escalamiento,
       round(avg(duration_minutes), 6) AS duracion_promedio_min,
       round(quantile_cont(duration_minutes, 0.9), 6) AS duracion_p90_min,
       round(avg(msg_count), 6) AS mensajes_promedio,
       round(quantile_cont(msg_count, 0.9), 6) AS mensajes_p90,
       {_TOP_JSON} AS estado_top
FROM master"""

SQL["top_status"] = WITH_MASTER + """
SELECT status, count(*) AS n_threads FROM master WHERE status IS NOT NULL
GROUP BY status ORDER BY n_threads DESC, status ASC LIMIT 5"""

SQL["escalation_by_category"] = WITH_MASTER + f"""
SELECT status, round(avg({FLAG}), 6) AS escalation_rate FROM master WHERE status IS NOT NULL
GROUP BY status ORDER BY avg({FLAG}) DESC, status ASC LIMIT 8"""

SQL["escalation_by_platform"] = WITH_MASTER + f"""
SELECT platform, round(avg({FLAG}), 6) AS escalation_rate FROM master WHERE platform IS NOT NULL
GROUP BY platform ORDER BY avg({FLAG}) DESC, platform ASC LIMIT 10"""

SQL["escalation_by_volume"] = WITH_MASTER + f""",
dim(msg_bucket, bucket_order) AS (VALUES ('0-2', 0), ('3-5', 1), ('6-10', 2), ('11-20', 3), ('21-50', 4),
                                         ('51-100', 5), ('100+', 6)),
b AS (
  SELECT CASE WHEN msg_count <= 2 THEN '0-2' WHEN msg_count <= 5 THEN '3-5' WHEN msg_count <= 10 THEN '6-10'
              WHEN msg_count <= 20 THEN '11-20' WHEN msg_count <= 50 THEN '21-50'
              WHEN msg_count <= 100 THEN '51-100' ELSE '100+' END AS msg_bucket,
         {FLAG} AS flag
  FROM master WHERE msg_count >= 0)
SELECT d.msg_bucket, d.bucket_order, round(avg(b.flag), 6) AS escalation_rate, count(b.flag) AS n_threads
FROM dim d LEFT JOIN b USING (msg_bucket)
GROUP BY d.msg_bucket, d.bucket_order ORDER BY d.bucket_order"""

SQL["monthly_trend"] = WITH_MASTER + f"""
SELECT strftime(created_at, '%Y-%m') AS month, round(avg({FLAG}), 6) AS escalation_rate
FROM master WHERE created_at IS NOT NULL GROUP BY 1 ORDER BY 1"""

SQL["operating_times"] = WITH_MASTER + """
SELECT round(avg(duration_minutes), 6) AS duracion_promedio_min,
       round(quantile_cont(duration_minutes, 0.9), 6) AS duracion_p90_min,
       round(avg(msg_count), 6) AS mensajes_promedio,
       round(quantile_cont(msg_count, 0.9), 6) AS mensajes_p90
FROM master"""

SQL["context_summary"] = WITH_MASTER + f"""
SELECT printf('Tasa de escalamiento: %.3f', avg({FLAG})) || chr(10) ||
       printf('Duracion promedio (min): %.2f', avg(duration_minutes)) || chr(10) ||
       printf('Mensajes promedio: %.2f', avg(msg_count)) AS summary
FROM master"""

SQL["top_threads_by_messages"] = WITH_MASTER + """
SELECT thread_id, msg_count FROM master ORDER BY msg_count DESC, thread_id ASC LIMIT 5"""

SQL["top_threads_by_duration"] = WITH_MASTER + """
SELECT thread_id, round(duration_minutes, 6) AS duration_minutes FROM master
ORDER BY duration_minutes DESC, thread_id ASC LIMIT 5"""

SQL["conversation_lookup"] = WITH_MASTER + """
SELECT thread_id, min(full_conversation) AS full_conversation FROM master
WHERE thread_id IN (SELECT CAST(l_orderkey AS VARCHAR) FROM lineitem WHERE l_returnflag = 'R')
GROUP BY thread_id"""

SQL["conversation_lookup_raw"] = """
SELECT CAST(conv_id AS VARCHAR) AS thread_id,
       string_agg(coalesce(text, 'None'), chr(10) ORDER BY turn ASC NULLS LAST, coalesce(text, 'None') ASC) AS conversation
FROM conversations
WHERE CAST(conv_id AS VARCHAR) IN (SELECT CAST(conv_id AS VARCHAR) FROM conversations WHERE role = 'user')
GROUP BY conv_id"""

SQL["metrics_json"] = WITH_MASTER + f""",
top AS ({_TOP_STATUS}),
m AS (
  SELECT round(avg({FLAG}), 6) AS tasa_escalamiento,
         round(avg(duration_minutes), 6) AS duracion_promedio_min,
         round(quantile_cont(duration_minutes, 0.9), 6) AS duracion_p90_min,
         round(avg(msg_count), 6) AS mensajes_promedio,
         round(quantile_cont(msg_count, 0.9), 6) AS mensajes_p90,
         {_TOP_JSON} AS estado_top
  FROM master)
SELECT CAST(json_object('tasa_escalamiento', tasa_escalamiento, 'duracion_promedio_min', duracion_promedio_min,
                        'duracion_p90_min', duracion_p90_min, 'mensajes_promedio', mensajes_promedio,
                        'mensajes_p90', mensajes_p90, 'estado_top', estado_top) AS VARCHAR) AS metrics_json
FROM m"""

# ----------------------------------------------------------------- JSON-derived messages
_ISO_TS = "CAST(ts AS TIMESTAMP)"
JSON_MSGS = f"""
jm AS (
  SELECT event_id, CAST(user_id AS VARCHAR) AS thread_id,
         CASE event_type WHEN 'view' THEN CAST(json(props) AS VARCHAR)
                         WHEN 'click' THEN 'click; ' || CAST(CAST(json_extract(props, '$.k') AS BIGINT) AS VARCHAR) || '; true'
                         WHEN 'error' THEN ''
                         WHEN 'signup' THEN props
                         ELSE CAST(value AS VARCHAR) END AS clean_content,
         CASE event_type WHEN 'click' THEN {_ISO_TS} WHEN 'view' THEN {_ISO_TS}
                         WHEN 'purchase' THEN date_trunc('day', {_ISO_TS}) ELSE NULL END AS msg_timestamp
  FROM events)"""

SQL["src_json_messages"] = "WITH " + JSON_MSGS + """
SELECT thread_id, event_id, msg_timestamp, clean_content FROM jm"""

SQL["src_json_array"] = SQL["src_json_messages"]

SQL["normalize_content"] = "WITH " + JSON_MSGS + """
SELECT event_id, clean_content FROM jm"""

SQL["parse_dates"] = "WITH " + JSON_MSGS + """
SELECT event_id, msg_timestamp FROM jm"""

SQL["master_roundtrip"] = SQL["master_table"]

SQL["metrics_csv_roundtrip"] = SQL["impact_metrics"]

# ----------------------------------------------------------------- profiling and validation
_ORDERS_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
_ORDERS_TYPES = ["bigint", "bigint", "string", "double", "timestamp_ntz", "string"]

SQL["profile_structure"] = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {i} AS position, '{t}' AS dtype, count({c}) AS non_null, count(*) AS n_rows FROM orders"
    for i, (c, t) in enumerate(zip(_ORDERS_COLS, _ORDERS_TYPES))
)

_MASTER_COLS = ["thread_id", "created_at", "status", "platform", "escalate_conversation", "full_conversation",
                "msg_count", "first_msg", "last_msg", "duration_minutes"]
SQL["profile_missing"] = WITH_MASTER + ", mc AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing_count FROM master" for c in _MASTER_COLS
) + """)
SELECT "column", missing_count FROM mc WHERE missing_count > 0 ORDER BY missing_count DESC, "column" LIMIT 15"""

SQL["profile_uniques"] = "WITH uc AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS unique_values FROM orders" for c in _ORDERS_COLS
) + """)
SELECT "column", unique_values FROM uc ORDER BY unique_values DESC, "column" LIMIT 15"""

SQL["duplicate_rows"] = """
WITH g AS (SELECT text, lang, source, count(*) AS k FROM documents GROUP BY ALL)
SELECT CAST(sum(k) AS BIGINT) AS n_rows, CAST(sum(k - 1) AS BIGINT) AS n_duplicates,
       round(CASE WHEN sum(k) > 0 THEN sum(k - 1) * 100.0 / sum(k) ELSE 0 END, 6) AS pct_duplicates FROM g"""

SQL["validate_questions"] = """
SELECT CAST(conv_id AS VARCHAR) AS thread_id, turn AS seq,
       coalesce(length(text) BETWEEN 1 AND 2000, false) AS question_ok,
       length(CAST(conv_id AS VARCHAR)) <= 128 AS session_ok,
       coalesce(length(text) BETWEEN 1 AND 2000, false) AND length(CAST(conv_id AS VARCHAR)) <= 128 AS valid
FROM conversations WHERE role = 'user'"""

SQL["normalize_columns"] = """
SELECT c_custkey, c_name, c_nationkey, c_acctbal AS c_acct_bal, c_mktsegment AS c_mkt_segment FROM customer"""

# ----------------------------------------------------------------- text and embeddings


def _chunks(table: str, id_col: str, text_col: str) -> str:
    return f"""
  SELECT {id_col} AS id, CAST(s // 500 AS INTEGER) AS chunk_pos, array_to_string(ws[s + 1:s + 500], ' ') AS chunk,
         sha256(array_to_string(ws[s + 1:s + 500], ' ')) AS text_hash
  FROM (SELECT {id_col}, ws, unnest(range(0, len(ws), 500)) AS s
        FROM (SELECT {id_col}, list_filter(regexp_split_to_array(coalesce({text_col}, ''), '{WS}+'), lambda x: x <> '') AS ws
              FROM {table}))"""


DOC_CHUNKS = f"doc_chunks AS ({_chunks('documents', 'doc_id', 'text')})"
BENCH_CHUNKS = f"bench_chunks AS ({_chunks('benchmark', 'item_id', 'text')})"

SQL["hash_text"] = "SELECT doc_id, sha256(text) AS text_hash FROM documents"

SQL["prepare_text"] = WITH_MASTER + f"""
SELECT thread_id, substr({ustrip("coalesce(full_conversation, '')")}, 1, 1000) AS text, {FLAG} AS target
FROM master WHERE length(substr({ustrip("coalesce(full_conversation, '')")}, 1, 1000)) > 0"""

SQL["chunk_text"] = "WITH " + DOC_CHUNKS + " SELECT id AS doc_id, chunk_pos, chunk FROM doc_chunks"

SQL["chunk_hashes"] = "WITH " + DOC_CHUNKS + " SELECT id AS doc_id, chunk_pos, text_hash FROM doc_chunks"

SQL["distinct_chunks"] = "WITH " + DOC_CHUNKS + " SELECT DISTINCT text_hash, chunk FROM doc_chunks"

SQL["embed_cache_misses"] = "WITH " + DOC_CHUNKS + ", " + BENCH_CHUNKS + """
SELECT DISTINCT text_hash, chunk FROM doc_chunks
WHERE text_hash NOT IN (SELECT text_hash FROM bench_chunks)"""

SQL["mean_pool"] = """
WITH e AS (SELECT label, unnest(embedding) AS v, unnest(range(len(embedding))) AS pos FROM embeddings),
p AS (SELECT label, pos, avg(v) AS m FROM e GROUP BY label, pos)
SELECT label, list(round(m, 6) ORDER BY pos) AS embedding FROM p GROUP BY label"""

SQL["extract_json"] = r"""
SELECT event_id, regexp_extract('answer:' || chr(10) || props || ' end}' || event_type, '(?s)\{.*\}', 0) AS json_text
FROM events"""

# ----------------------------------------------------------------- semantic memory
_NVEC = """
nv AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v,
         sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n
  FROM embeddings)"""

SQL["l2_normalize"] = "WITH " + _NVEC + """
SELECT vec_id, CASE WHEN n > 0 THEN list_transform(v, lambda x: round(x / n, 6))
                    ELSE list_transform(v, lambda x: round(x, 6)) END AS embedding FROM nv"""

_KNN = "WITH " + _NVEC + """,
pairs AS (
  SELECT CAST(a.vec_id AS VARCHAR) AS query_id, CAST(b.vec_id AS VARCHAR) AS item_id,
         CASE WHEN a.n > 0 AND b.n > 0 THEN list_inner_product(a.v, b.v) / (a.n * b.n) ELSE 0.0 END AS score
  FROM nv a, nv b),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id ASC) AS rank FROM pairs)"""

SQL["knn_topk"] = _KNN + """
SELECT query_id, CAST(rank AS INTEGER) AS rank, item_id, round(score, 6) AS score FROM ranked WHERE rank <= 3"""

SQL["knn_pruned"] = SQL["knn_topk"]

SQL["semantic_context"] = _KNN + """
SELECT r.query_id, string_agg('- ' || d.text, chr(10) ORDER BY r.rank) AS context
FROM ranked r JOIN documents d ON CAST(d.doc_id AS VARCHAR) = r.item_id
WHERE r.rank <= 3 GROUP BY r.query_id"""

SQL["memory_text"] = """
WITH q AS (SELECT conv_id, turn, text AS question FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id, turn - 1 AS turn, text AS answer FROM conversations WHERE role = 'assistant')
SELECT CAST(q.conv_id AS VARCHAR) || ':' || CAST(q.turn AS VARCHAR) AS item_id,
       'Pregunta: ' || coalesce(q.question, '') || chr(10) || 'Respuesta: ' || a.answer AS text,
       CAST(q.conv_id AS VARCHAR) AS thread_id
FROM q JOIN a USING (conv_id, turn) WHERE a.answer IS NOT NULL AND a.answer <> ''"""

# ----------------------------------------------------------------- evaluation
_SCORED = """
sc AS (
  SELECT vec_id, CASE WHEN label = 3 THEN 1 ELSE 0 END AS y, CAST(embedding[2] AS DOUBLE) AS s,
         CASE WHEN CAST(embedding[2] AS DOUBLE) > 0 THEN 1 ELSE 0 END AS p
  FROM embeddings)"""
_CM = "WITH " + _SCORED + """,
cm AS (
  SELECT count(*) FILTER (WHERE y = 0 AND p = 0) AS c00, count(*) FILTER (WHERE y = 0 AND p = 1) AS c01,
         count(*) FILTER (WHERE y = 1 AND p = 0) AS c10, count(*) FILTER (WHERE y = 1 AND p = 1) AS c11 FROM sc)"""

SQL["confusion_matrix"] = _CM + """
SELECT 0 AS label, 0 AS prediction, c00 AS n FROM cm UNION ALL SELECT 0, 1, c01 FROM cm
UNION ALL SELECT 1, 0, c10 FROM cm UNION ALL SELECT 1, 1, c11 FROM cm"""

SQL["classification_report"] = _CM + """,
m AS (
  SELECT CASE WHEN c00 + c10 > 0 THEN c00 / (c00 + c10) ELSE 0 END AS p0,
         CASE WHEN c00 + c01 > 0 THEN c00 / (c00 + c01) ELSE 0 END AS r0,
         CASE WHEN c11 + c01 > 0 THEN c11 / (c11 + c01) ELSE 0 END AS p1,
         CASE WHEN c11 + c10 > 0 THEN c11 / (c11 + c10) ELSE 0 END AS r1,
         c00 + c01 AS s0, c10 + c11 AS s1, c00 + c01 + c10 + c11 AS n,
         (c00 + c11) / (c00 + c01 + c10 + c11) AS acc FROM cm),
f AS (SELECT *, CASE WHEN p0 + r0 > 0 THEN 2 * p0 * r0 / (p0 + r0) ELSE 0 END AS f0,
              CASE WHEN p1 + r1 > 0 THEN 2 * p1 * r1 / (p1 + r1) ELSE 0 END AS f1 FROM m)
SELECT '0' AS class, round(p0, 6) AS precision, round(r0, 6) AS recall, round(f0, 6) AS f1_score, s0 AS support FROM f
UNION ALL SELECT '1', round(p1, 6), round(r1, 6), round(f1, 6), s1 FROM f
UNION ALL SELECT 'accuracy', round(acc, 6), round(acc, 6), round(acc, 6), n FROM f
UNION ALL SELECT 'macro avg', round((p0 + p1) / 2, 6), round((r0 + r1) / 2, 6), round((f0 + f1) / 2, 6), n FROM f
UNION ALL SELECT 'weighted avg', round((p0 * s0 + p1 * s1) / n, 6), round((r0 * s0 + r1 * s1) / n, 6),
                 round((f0 * s0 + f1 * s1) / n, 6), n FROM f"""

SQL["roc_auc"] = "WITH " + _SCORED + """,
r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS mr FROM sc),
t AS (SELECT sum(y) AS P, count(*) - sum(y) AS N, sum(CASE WHEN y = 1 THEN mr ELSE 0 END) AS rs FROM r)
SELECT round((rs - P * (P + 1) / 2.0) / (P * N), 6) AS roc_auc FROM t"""

SQL["average_precision"] = "WITH " + _SCORED + """,
d AS (SELECT s, sum(y) AS pos, count(*) - sum(y) AS neg FROM sc GROUP BY s),
c AS (SELECT pos, sum(pos) OVER (ORDER BY s DESC) AS tp, sum(neg) OVER (ORDER BY s DESC) AS fp FROM d)
SELECT round(sum(pos * tp / (tp + fp)) / sum(pos), 6) AS pr_auc FROM c"""

SQL["expected_cost"] = _CM + """
SELECT 5 * c10 + 1 * c01 AS cost FROM cm"""

SQL["stratified_split"] = """
SELECT vec_id, CASE WHEN label = 3 THEN 1 ELSE 0 END AS target,
       CAST(('0x' || substr(md5(CAST(vec_id AS VARCHAR) || ':42'), 1, 8)) AS BIGINT) / 4294967296.0 < 0.2 AS is_test
FROM embeddings"""

# ----------------------------------------------------------------- agent answers
_ANSWERS = """
ans AS (
  SELECT event_id, event_type, round(value, 2) AS tiempo_s,
         CASE event_type
           WHEN 'view' THEN '{"summary": "view ' || json_extract_string(props, '$.k') || '", "insights": ["k='
                            || json_extract_string(props, '$.k')
                            || '"], "risks": [], "actions": ["check"], "metrics_used": ["value"]}'
           WHEN 'click' THEN 'Claro: {"summary": "click", "insights": []} fin'
           WHEN 'error' THEN 'error {k: ' || json_extract_string(props, '$.k') || '}'
           WHEN 'signup' THEN props
           ELSE '[' || json_extract_string(props, '$.k') || ', 2]' END AS answer
  FROM events),
cand AS (
  SELECT *, CASE WHEN regexp_extract(answer, '(?s)\\{.*\\}', 0) <> '' THEN regexp_extract(answer, '(?s)\\{.*\\}', 0)
                 ELSE answer END AS c
  FROM ans)"""

_KEYS = "['actions', 'insights', 'metrics_used', 'risks', 'summary']"

SQL["answer_quality"] = "WITH " + _ANSWERS + f""",
ok AS (SELECT event_id, c, CASE WHEN json_type(c) = 'OBJECT' THEN json_keys(c) ELSE CAST([] AS VARCHAR[]) END AS keys,
              json_type(c) = 'OBJECT' AS is_obj
       FROM cand WHERE json_valid(c)),
scored AS (
  SELECT event_id, true AS json_valido,
         list_sort(list_filter({_KEYS}, lambda k: list_contains(keys, k))) AS claves_presentes,
         list_sort(list_filter({_KEYS}, lambda k: NOT list_contains(keys, k))) AS claves_faltantes,
         len(list_filter({_KEYS}, lambda k: list_contains(keys, k))) / 5.0 AS score_estructura,
         coalesce(is_obj AND json_type(c, '$.insights') = 'ARRAY' AND json_array_length(c, '$.insights') > 0, false)
           AS insights_no_vacios,
         coalesce(is_obj AND json_type(c, '$.actions') = 'ARRAY' AND json_array_length(c, '$.actions') > 0, false)
           AS actions_no_vacios
  FROM ok
  UNION ALL
  SELECT event_id, false, CAST([] AS VARCHAR[]), {_KEYS}, 0.0, false, false FROM cand WHERE NOT json_valid(c))"""

SQL["answer_quality"] += """
SELECT * FROM scored"""

SQL["answer_quality_summary"] = SQL["answer_quality"].rsplit("SELECT * FROM scored", 1)[0] + """
SELECT round(avg(s.score_estructura), 6) AS score_promedio, CAST(sum(CAST(s.json_valido AS BIGINT)) AS BIGINT) AS respuestas_validas,
       count(*) AS total, round(avg(a.tiempo_s), 6) AS tiempo_promedio
FROM scored s JOIN ans a USING (event_id)"""

SQL["parse_json_lenient"] = "WITH " + _ANSWERS + """
SELECT event_id,
       CASE WHEN json_valid(answer) THEN CAST(json(answer) AS VARCHAR)
            WHEN regexp_extract(answer, '(?s)\\{.*\\}', 0) <> '' AND json_valid(regexp_extract(answer, '(?s)\\{.*\\}', 0))
              THEN CAST(json(regexp_extract(answer, '(?s)\\{.*\\}', 0)) AS VARCHAR)
            ELSE '{}' END AS analysis
FROM ans"""

SQL["route_normalize"] = """
SELECT event_id, CASE event_type WHEN 'error' THEN 'escalar' WHEN 'click' THEN 'tecnico'
                                 WHEN 'purchase' THEN 'resumen' ELSE 'assistant' END AS route
FROM events"""


def _sql_literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# The prompt around the summary, as the reference gives it.
PROMPT_HEAD = """Rol: Analista de operaciones de una aerolinea.
Objetivo: Responder preguntas de negocio con base en metricas.
Restricciones: No revelar razonamiento interno. No usar emojis.
Formato de salida: JSON con llaves summary, insights, risks, actions, metrics_used.
Ejemplo de salida:
{
  "summary": "La tasa de escalamiento es elevada en ciertos estados.",
  "insights": ["Los hilos con mas mensajes muestran mayor escalamiento."],
  "risks": ["Falsos negativos impactan la satisfaccion del cliente."],
  "actions": ["Priorizar mejora en los estados con mayor tasa."],
  "metrics_used": ["tasa_escalamiento", "mensajes_promedio"]
}

Contexto:
"""


SQL["prompt_table"] = WITH_MASTER + f""",
summ AS (
  SELECT printf('Tasa de escalamiento: %.3f', avg({FLAG})) || chr(10) ||
         printf('Duracion promedio (min): %.2f', avg(duration_minutes)) || chr(10) ||
         printf('Mensajes promedio: %.2f', avg(msg_count)) AS summary FROM master)
SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS question_id,
       {_sql_literal(PROMPT_HEAD)} || summ.summary AS system_prompt
FROM conversations, summ WHERE role = 'user'"""

SQL["session_transcript"] = """
SELECT CAST(conv_id AS VARCHAR) AS session_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS transcript,
       count(*) AS n_messages
FROM conversations GROUP BY conv_id"""

SQL["stratified_split_exact"] = """
WITH u AS (
  SELECT vec_id, CASE WHEN label = 3 THEN 1 ELSE 0 END AS target,
         CAST(('0x' || substr(md5(CAST(vec_id AS VARCHAR) || ':42'), 1, 8)) AS BIGINT) / 4294967296.0 AS u
  FROM embeddings)
SELECT vec_id, target,
       row_number() OVER (PARTITION BY target ORDER BY u) <= round(count(*) OVER (PARTITION BY target) * 0.2) AS is_test
FROM u"""

SQL["conversation_agg_events"] = f"""
WITH m AS (SELECT CAST(user_id AS VARCHAR) AS thread_id, CAST(ts AS TIMESTAMP) AS ts, {ustrip("props")} AS c FROM events),
a AS (
  SELECT thread_id, coalesce(string_agg(nullif(c, ''), ' | ' ORDER BY ts ASC NULLS LAST, c ASC), '') AS full_conversation,
         count(*) AS msg_count, min(ts) AS first_msg, max(ts) AS last_msg
  FROM m GROUP BY thread_id)
SELECT *, round(epoch_us(first_msg) / 1e6, 6) AS first_epoch_s FROM a"""


# ----------------------------------------------------------------- stores, models and training
SQL["profile_uniques_missing"] = "WITH " + THREADS + ", uc AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(DISTINCT coalesce(CAST({c} AS VARCHAR), 'None')) AS unique_values FROM threads"
    for c in ("thread_id", "created_at", "status", "platform", "escalate_conversation")
) + ") SELECT * FROM uc ORDER BY unique_values DESC, \"column\" LIMIT 15"

SQL["duplicate_table_rows"] = """
WITH t AS (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_returnflag = 'R'),
d AS (SELECT count(*) AS k FROM t GROUP BY ALL),
g AS (SELECT count(*) AS distinct_rows FROM (SELECT DISTINCT * FROM t))
SELECT (SELECT count(*) FROM t) AS n_rows, (SELECT count(*) FROM t) - distinct_rows AS n_duplicates,
       round(((SELECT count(*) FROM t) - distinct_rows) * 100.0 / (SELECT count(*) FROM t), 6) AS pct_duplicates
FROM g"""

SQL["embed_cache_fill"] = "WITH " + DOC_CHUNKS + """
SELECT DISTINCT 'hashing-64' AS model, text_hash, 64 AS dim FROM doc_chunks"""


def _digest_vector(text: str, dim: int = 8) -> str:
    return "[" + ", ".join(
        f"(CAST('0x' || substr(sha256({text}), {2 * i + 1}, 2) AS INTEGER) - 128) / 128.0" for i in range(dim)) + "]"


SQL["embed_documents"] = "WITH " + DOC_CHUNKS + f""",
v AS (SELECT id, {_digest_vector("chunk")} AS e FROM doc_chunks)
SELECT id AS doc_id, [{", ".join(f"round(avg(e[{i + 1}]) + 1e-9, 6)" for i in range(8))}] AS embedding FROM v GROUP BY id"""

SQL["memory_append"] = "WITH m AS (" + SQL["memory_text"] + """)
SELECT item_id, save_id, text, 64 AS dim FROM m, (VALUES ('first'), ('second')) s(save_id)"""

_SEARCH = "items AS (" + SQL["memory_text"] + f"""),
iv AS (SELECT item_id, text, thread_id, {_digest_vector("text")} AS v FROM items),
qv AS (SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS query_id, {_digest_vector("text")} AS v
       FROM conversations WHERE role = 'user'),
hits AS (
  SELECT query_id, item_id, text, thread_id, score,
         row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, item_id || chr(1) || 's1') AS rank
  FROM (SELECT q.query_id, i.item_id, i.text, i.thread_id,
               list_dot_product(q.v::DOUBLE[], i.v::DOUBLE[])
               / sqrt(list_dot_product(q.v::DOUBLE[], q.v::DOUBLE[]) * list_dot_product(i.v::DOUBLE[], i.v::DOUBLE[])) AS score
        FROM qv q, iv i)
  QUALIFY rank <= 3)"""

SQL["memory_search"] = "WITH " + _SEARCH + """
SELECT query_id, CAST(rank AS INTEGER) AS rank, item_id, text, thread_id, round(score, 6) AS score FROM hits"""

SQL["prompt_with_context"] = SQL["prompt_table"].rsplit("SELECT CAST(conv_id", 1)[0] + ", " + _SEARCH + f""",
ctx AS (SELECT query_id, string_agg('- ' || text, chr(10) ORDER BY rank) AS context FROM hits GROUP BY query_id),
base AS (SELECT CAST(conv_id""" + SQL["prompt_table"].rsplit("SELECT CAST(conv_id", 1)[1] + """)
SELECT question_id, system_prompt || coalesce(chr(10) || chr(10) || 'Contexto semantico relevante:' || chr(10) || context, '')
       AS system_prompt
FROM base LEFT JOIN ctx ON question_id = query_id"""

SQL["knn_edges"] = """
WITH few AS (SELECT CAST(vec_id AS VARCHAR) AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v
             FROM embeddings),
c AS (SELECT id, list_transform(v, lambda x: CASE WHEN n > 0 THEN x / n ELSE x END) AS v
      FROM (SELECT id, v, sqrt(list_dot_product(v, v)) AS n FROM few
            UNION ALL SELECT '-1', list_transform(v, lambda x: x * 0), 0 FROM (SELECT v FROM few LIMIT 1))),
s AS (SELECT q.id AS query_id, i.id AS item_id, list_dot_product(q.v, i.v) AS score FROM c q, c i)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, item_id) AS INTEGER) AS rank,
       item_id, round(score, 6) AS score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, item_id) <= 7"""

_EXACT_SPLIT = "split AS (" + SQL["stratified_split_exact"].replace("WITH u AS", "WITH u0 AS").replace("FROM u", "FROM u0") + ")"
SQL["score_model"] = "WITH " + _EXACT_SPLIT + """
SELECT vec_id, target, true AS consistent, true AS in_range FROM split WHERE is_test"""
SQL["model_roundtrip"] = "WITH " + _EXACT_SPLIT + """
SELECT vec_id, target, true AS same_score FROM split WHERE is_test"""
SQL["train_escalation_model"] = "WITH " + _EXACT_SPLIT + """
SELECT count(*) AS n_train, CAST(sum(target) AS BIGINT) AS n_positive, true AS balanced,
       CAST((SELECT len(embedding) FROM embeddings LIMIT 1) AS INTEGER) AS n_coefficients
FROM split WHERE NOT is_test"""

_QUESTIONS = """
asked AS (SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS question_id, CAST(conv_id AS VARCHAR) AS thread_id,
                 text AS question FROM conversations WHERE role = 'user'),
conv AS (SELECT thread_id, min(full_conversation) AS conversation FROM master GROUP BY thread_id),
req AS (SELECT a.*, coalesce(conversation, '') AS conversation,
               'thread_id: ' || thread_id || chr(10) || 'conversacion:' || chr(10) || coalesce(conversation, '') || chr(10)
               || chr(10) || 'pregunta_actual:' || chr(10) || question AS input
        FROM asked a LEFT JOIN conv USING (thread_id)),
routed AS (
  SELECT *, CASE WHEN contains(lower(input), '!') OR contains(lower(input), 'queja') THEN 'escalar'
                 WHEN contains(lower(input), '?') THEN 'tecnico'
                 WHEN contains(lower(input), 'conversacion:' || chr(10) || chr(10)) THEN 'assistant'
                 ELSE 'resumen' END AS route
  FROM req),
analysed AS (
  SELECT *, '{"route":"' || route || '","sentiment":"' || CASE route WHEN 'escalar' THEN 'negativo'
         WHEN 'resumen' THEN 'positivo' ELSE 'neutral' END || '","motivo":"","rationale":""}' AS analysis
  FROM routed)"""

SQL["route_conversations"] = WITH_MASTER + "," + _QUESTIONS + """
SELECT question_id, thread_id, route, analysis FROM analysed"""

# what the offline answerer gives, as JSON text with Python's spacing
def _answer(question: str, insights: str) -> str:
    return ("'{\"summary\": ' || CAST(to_json(" + question + ") AS VARCHAR) || ', \"insights\": " + insights
            + ", \"risks\": [], \"actions\": [\"review\"], \"metrics_used\": [\"tasa_escalamiento\"]}'")


SQL["draft_by_route"] = WITH_MASTER + "," + _QUESTIONS + f"""
SELECT question_id, route, CASE WHEN route <> 'assistant' THEN
       {_answer("'analisis: ' || analysis || chr(10) || chr(10) || 'conversacion:' || chr(10) || conversation", "[]")}
       END AS draft
FROM analysed"""

SQL["batch_answer_eval"] = f"""
SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS question_id, text[1:80] AS pregunta, true AS json_valido,
       {_KEYS} AS claves_presentes, CAST([] AS VARCHAR[]) AS claves_faltantes, 1.0 AS score_estructura,
       true AS insights_no_vacios, true AS actions_no_vacios, true AS timed
FROM conversations WHERE role = 'user'"""

SQL["answer_memory"] = f"""
SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS item_id,
       'Pregunta: ' || text || chr(10) || 'Respuesta: ' || {_answer("text", '["see context"]')} AS text,
       CAST(conv_id AS VARCHAR) AS thread_id
FROM conversations WHERE role = 'user'"""

SQL["src_json_collections"] = WITH_MASTER + """
SELECT thread_id, status, full_conversation, msg_count FROM master"""

SQL["number_text"] = """
WITH c AS (SELECT event_id, CASE WHEN event_id % 41 = 7 THEN NULL
                                 ELSE round(value, 2) * pow(10.0, event_id % 40 - 15) END AS x FROM events)
SELECT event_id, CASE WHEN x IS NULL THEN 'missing'
                      WHEN x <> 0 AND (abs(x) < 1e-4 OR abs(x) >= 1e16) THEN 'power' ELSE 'plain' END AS form,
       round(log10(abs(x) + 1e-30), 6) AS magnitude
FROM c"""
