"""DuckDB SQL for each registered query (brute force, same derived inputs)."""

from __future__ import annotations

from vellum.plans import sqlfrag as S
from vellum.plans.queries import CHUNK_SETTINGS


def r4(x: str) -> str:
    return f"CAST(round({x}, 4) + 0.0 AS DOUBLE)"


def _chunks(size: int, overlap: int, extra: str = "") -> str:
    step = size - overlap
    return f"""
SELECT doc_id{extra}, CAST(i AS INTEGER) AS chunk_index, CAST(n AS INTEGER) AS total_chunks,
       substr(text, CAST(i * {step} + 1 AS BIGINT), {size}) AS chunk
FROM (SELECT doc_id{extra}, text, n, unnest(range(0, n)) AS i
      FROM (SELECT doc_id{extra}, text, {S.n_chunks('text', size, overlap)} AS n FROM documents))
"""


def _dist(metric: str, a: str, b: str) -> str:
    if metric == "cosine":
        return f"list_cosine_distance({a}, {b})"
    if metric == "l2":
        return f"list_distance({a}, {b}) * list_distance({a}, {b})"
    return f"1.0 - list_inner_product({a}, {b})"


def _resolved(metric: str) -> str:
    """The key distances are compared by: 1e-9, for l2 ten significant digits."""
    if metric != "l2":
        return "round(distance, 9)"
    return ("CASE WHEN distance > 0 THEN round(distance / pow(10, floor(log10(distance)) - 9)) "
            "* pow(10, floor(log10(distance)) - 9) ELSE 0 END")


def _knn(corpus: str, id_expr: str, metric: str, k: int) -> str:
    return f"""
WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS qv FROM embeddings),
c AS (SELECT {id_expr} AS id, CAST(embedding AS DOUBLE[]) AS v FROM ({corpus})),
d AS (SELECT query_id, id, {_dist(metric, 'qv', 'v')} AS distance FROM q, c),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {_resolved(metric)}, id) AS rank FROM d)
SELECT query_id, CAST(rank AS INTEGER) AS rank, id, {r4('distance')} AS distance FROM r WHERE rank <= {k}
"""


def _knn_sql(queries: str, corpus: str, metric: str, k: int, cols: str = "query_id, CAST(rank AS INTEGER) AS rank, id, " + "CAST(round(distance, 4) + 0.0 AS DOUBLE) AS distance") -> str:
    """Brute force: every query against every corpus row, ranked by (distance at 1e-9, id)."""
    return f"""
WITH q AS ({queries}), c AS ({corpus}),
d AS (SELECT q.*, c.*, {_dist(metric, 'CAST(q.qv AS DOUBLE[])', 'CAST(c.embedding AS DOUBLE[])')} AS distance FROM q, c),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {_resolved(metric)}, id) AS rank FROM d)
SELECT {cols} FROM r WHERE rank <= {k}
"""


BENCH_Q = f"SELECT item_id AS query_id, {S.hash_vector(S.task_prefix('text', 'search_query: '), 256)} AS qv FROM benchmark"
VEC_Q = "SELECT vec_id AS query_id, embedding AS qv FROM embeddings"


def _count_cases_sql(table: str, preds: dict) -> str:
    return " UNION ALL ".join(
        f"SELECT '{n}' AS case_name, CAST(sum(CASE WHEN {p} THEN 1 ELSE 0 END) AS BIGINT) AS n_rows FROM ({table})"
        for n, p in preds.items())


def _where_cases() -> dict:
    from vellum.functions.filters import where_sql
    from vellum.plans.queries import WHERE_CASES

    # Written out where SQL would convert types, or the key is no column.
    own = {"mixed_in": "weight = 1", "text_on_int": "FALSE", "int_on_bool": "FALSE", "dotted_key": "FALSE", "absent_key": "FALSE"}
    return {n: own.get(n) or where_sql(w) for n, w in WHERE_CASES.items()}


def _where_document_cases() -> dict:
    from vellum.functions.filters import where_document_sql
    from vellum.plans.queries import WHERE_DOCUMENT_CASES

    return {n: where_document_sql(w) for n, w in WHERE_DOCUMENT_CASES.items()}


def _checksum(v: str) -> str:
    return f"CAST(round(list_sum(list_transform(CAST({v} AS DOUBLE[]), lambda x, i: x * i)), 4) + 0.0 AS DOUBLE)"


def _postprocess(v: str, dim: int) -> str:
    m = f"list_avg(CAST({v} AS DOUBLE[]))"
    return f"""(SELECT list_transform(s, lambda x: x / greatest(sqrt(list_sum(list_transform(s, lambda y: y * y))), 1e-12))
  FROM (SELECT list_slice(list_transform(d, lambda x: (x - mu) / sqrt(var + 1e-5)), 1, {dim}) AS s
        FROM (SELECT d, mu, list_avg(list_transform(d, lambda x: (x - mu) * (x - mu))) AS var
              FROM (SELECT CAST({v} AS DOUBLE[]) AS d, {m} AS mu))))"""


CHUNKS = S.chunk_collection(256)
CHUNKS_NOVEC = S.chunk_collection(256, with_vectors=False)
FAIL_PRIMARY = "left(md5(enc_input), 1) IN ('0', '1')"


# Documents as files: names by source, and an empty file beside each English document.
FILE_NAME = (f"CASE WHEN contains(source_file, '/src1/') THEN '.' WHEN contains(source_file, '/src2/') THEN '_' ELSE '' END || "
             f"{S.basename('source_file')}")
FILE_CHUNKS = f"""SELECT {FILE_NAME} AS file, chunk_index, total_chunks, doc_title, array_to_string(tags, '|') AS tags, text
FROM ({CHUNKS_NOVEC})
UNION ALL SELECT 'empty_' || doc_id || '.md', 0, 1, 'Empty ' || doc_id, '', '' FROM documents WHERE lang = 'en'"""

META = S.META_COLLECTION

PROFILE_SQL = f"""
WITH m AS ({META}), e AS (
  SELECT id, 'zone' AS field, 'str' AS type, zone AS value_str FROM m UNION ALL
  SELECT id, 'weight', 'int', CAST(weight AS VARCHAR) FROM m UNION ALL
  SELECT id, 'score', 'float', CAST(score AS VARCHAR) FROM m UNION ALL
  SELECT id, 'flag', 'bool', CAST(flag AS VARCHAR) FROM m UNION ALL
  SELECT id, 'axes', 'str', axes FROM m),
t AS (SELECT field, type, count(*) AS n FROM e GROUP BY 1, 2),
ty AS (SELECT field, sum(n) AS count, string_agg(type || ':' || CAST(n AS VARCHAR), ',' ORDER BY type || ':' || CAST(n AS VARCHAR)) AS types
       FROM t GROUP BY 1),
f AS (SELECT field, value_str, min(id) AS first_id FROM e GROUP BY 1, 2),
s AS (SELECT field, string_agg(value_str, '|' ORDER BY first_id, value_str) AS sample_values
      FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY first_id, value_str) AS rn FROM f) WHERE rn <= 5 GROUP BY 1)
SELECT CAST(count AS BIGINT) AS count, ty.field AS field, types, sample_values FROM ty LEFT JOIN s ON ty.field = s.field
"""

VERIFY_SQL = f"""
WITH c AS ({CHUNKS_NOVEC}), smp AS (SELECT id, {S.preview('text', 100)} AS p,
  'chunk_index=' || chunk_index || ',creation_date=,doc_title=' || doc_title || ',source_file=' || source_file
  || ',tags=' || CAST(to_json(tags) AS VARCHAR) || ',total_chunks=' || total_chunks AS m FROM c ORDER BY id LIMIT 3)
SELECT count(*) > 0 AS is_populated, CAST(count(*) AS BIGINT) AS count,
  'chunk_index,creation_date,doc_title,source_file,tags,total_chunks' AS fields,
  (SELECT string_agg(id, '|' ORDER BY id) FROM smp) AS sample_ids,
  (SELECT string_agg(p, '|' ORDER BY id) FROM smp) AS sample_previews,
  (SELECT string_agg(m, '|' ORDER BY id) FROM smp) AS sample_metadata
FROM c
"""


DRAFT = S.DRAFT_RESPONSES
RET, NORET, CONT = "'\\[Retrieval\\]'", "'\\[No Retrieval\\]'", "'\\[Continue to Use Evidence\\]'"


def _rule(resp: str, prior: str) -> str:
    return (f"(CASE WHEN regexp_matches({resp}, {RET}) THEN TRUE WHEN regexp_matches({resp}, {CONT}) THEN NOT ({prior}) "
            f"WHEN regexp_matches({resp}, {NORET}) THEN FALSE ELSE TRUE END)")


PRIOR_TOKEN = (f"coalesce(max(CASE WHEN regexp_matches(response, {RET}) THEN 1 ELSE 0 END) OVER "
               f"(PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 1, FALSE)")

# The recursive rule evaluated turn by turn (independent of the closed form used by Spark).
PRIOR_DECIDED = f"""
WITH RECURSIVE d AS (SELECT conv_id, turn, response, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM ({DRAFT})),
r(conv_id, rn, turn, ev, dec) AS (
  SELECT conv_id, rn, turn, FALSE, {_rule('response', 'FALSE')} FROM d WHERE rn = 1
  UNION ALL
  SELECT d.conv_id, d.rn, d.turn, r.ev OR r.dec, {_rule('d.response', 'r.ev OR r.dec')}
  FROM r JOIN d ON d.conv_id = r.conv_id AND d.rn = r.rn + 1)
SELECT conv_id, turn, ev AS has_prior_evidence FROM r
"""

TOP5 = _knn_sql(BENCH_Q, CHUNKS, "cosine", 5, "query_id, rank, id, text, distance")
TOP10 = _knn_sql(BENCH_Q, CHUNKS, "cosine", 10, "query_id, rank, id, text, distance")
NL2 = "chr(10) || chr(10)"
CTX_PROMPT = (f"string_agg('Context ' || CAST(rank AS VARCHAR) || ':' || chr(10) || text, {NL2} ORDER BY rank)")

PRIORITIZED = f"""
SELECT * FROM (
  SELECT *, sum(length(text)) OVER (PARTITION BY query_id ORDER BY round(distance, 9), id
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used_chars
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id, text ORDER BY round(distance, 9), id) AS dup FROM ({TOP10}))
  WHERE dup = 1)
WHERE used_chars <= 2000
"""
PRIORITIZED_RANKED = f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), id) AS priority FROM ({PRIORITIZED})"


SQL = {
    "chunk_documents": f"SELECT doc_id, chunk_index, total_chunks, chunk AS text FROM ({_chunks(500, 50)})",
    "chunk_counts": " UNION ALL ".join(
        f"""SELECT {s} AS chunk_size, {o} AS chunk_overlap, count(DISTINCT doc_id) AS n_docs, count(*) AS n_chunks,
        CAST(sum(length(chunk)) AS BIGINT) AS total_chars, CAST(max(length(chunk)) AS BIGINT) AS max_chunk_chars
        FROM ({_chunks(s, o)})"""
        for s, o in CHUNK_SETTINGS
    ),
    "doc_titles": f"SELECT doc_id, {S.title('content')} AS title FROM ({S.MARKDOWN_DOCS})",
    "extract_tags": f"""SELECT doc_id, array_to_string(tg, '|') AS tags, CAST(len(tg) AS INTEGER) AS n_tags
        FROM (SELECT doc_id, {S.tags('content')} AS tg FROM ({S.MARKDOWN_DOCS}))""",
    "preprocess_text": "SELECT doc_id, " + S.preprocess("text || '..  $#@'") + " AS clean FROM documents",
    "task_prefix": f"""SELECT doc_id, {S.task_prefix('t')} AS encoder_input
        FROM (SELECT doc_id, CASE WHEN lang = 'es' THEN 'search_query: ' || text ELSE text END AS t FROM documents)""",
    "text_preview": f"""SELECT doc_id, {S.preview('text', 100)} AS preview, {S.excerpt('text', 300)} AS excerpt_300,
        {S.excerpt('text', 200)} AS excerpt_200 FROM documents""",
    "knn_cosine": _knn(S.VECTOR_COLLECTION, "id", "cosine", 5),
    "knn_l2": _knn(S.VECTOR_COLLECTION, "id", "l2", 5),
    "knn_l2_near": _knn_sql(
        VEC_Q, f"""SELECT id, embedding FROM ({S.VECTOR_COLLECTION})
        UNION ALL SELECT 'near ' || vec_id || ' ' || step, list_concat([CAST(embedding[1] AS DOUBLE) + step * 1e-6],
                                                                       CAST(embedding[2:] AS DOUBLE[]))
        FROM embeddings, (VALUES (1), (2), (3)) AS s(step)""", "l2", 4, "query_id, CAST(rank AS INTEGER) AS rank, id"),
    "knn_ip": _knn(S.VECTOR_COLLECTION, "id", "ip", 5),
    "knn_batch": _knn("SELECT * FROM embeddings", "vec_id", "cosine", 10),
    "knn_lsh_recall": "SELECT 10 AS k, CAST(sum(least(10, n)) AS BIGINT) AS n_true, TRUE AS reached FROM (SELECT count(*) OVER () AS n FROM embeddings)",
    "query_by_text": _knn_sql(BENCH_Q, CHUNKS, "cosine", 5),
    "search_result_view": _knn_sql(
        BENCH_Q, CHUNKS, "cosine", 5,
        "query_id, CAST(rank AS INTEGER) AS rank, id, CAST(round(1.0 - distance, 4) + 0.0 AS DOUBLE) AS similarity, "
        "doc_title AS title, " + S.basename("source_file") + " AS source, array_to_string(tags, ', ') AS tags, "
        + S.excerpt("text", 300) + " AS excerpt"),
    "knn_include": _knn_sql(VEC_Q, S.VECTOR_COLLECTION, "cosine", 5,
                            "query_id, CAST(rank AS INTEGER) AS rank, id, text, label"),
    "knn_filtered": _knn_sql(
        VEC_Q, f"SELECT * FROM ({S.VECTOR_COLLECTION}) WHERE label >= 2 AND label <= 6 AND NOT contains(text, 'label 4')",
        "cosine", 5),
    "where_operators": _count_cases_sql(S.META_COLLECTION, _where_cases()),
    "where_document": _count_cases_sql("SELECT * FROM documents", _where_document_cases()),
    "embed_hash": f"""SELECT doc_id, CAST(b - 1 AS INTEGER) AS bucket, CAST(round(CAST(v[b] AS DOUBLE), 6) + 0.0 AS DOUBLE) AS weight
        FROM (SELECT doc_id, v, unnest(range(1, len(v) + 1)) AS b FROM (
              SELECT doc_id, {S.hash_vector(S.task_prefix(S.preprocess('text')), 256)} AS v FROM documents))
        WHERE v[b] > 0""",
    "embedding_postprocess": f"""SELECT vec_id, CAST(b - 1 AS INTEGER) AS pos, CAST(round(v[b], 6) + 0.0 AS DOUBLE) AS value
        FROM (SELECT vec_id, v, unnest(range(1, len(v) + 1)) AS b FROM (
              SELECT vec_id, {_postprocess('embedding', 64)} AS v FROM embeddings))""",
    "validate_dimension": """SELECT vec_id, (label NOT IN (2, 3, 5, 7)) AS is_valid,
        CASE WHEN label = 7 THEN 'missing_embedding' WHEN label = 3 THEN 'dimension_mismatch:3'
             WHEN label = 5 THEN 'nan_in_embedding' WHEN label = 2 THEN 'infinity_in_embedding' ELSE 'ok' END AS reason FROM embeddings""",
    "embed_chunks": f"""SELECT id, 'ok' AS embed_status, CAST(len(embedding) AS INTEGER) AS dims,
        {_checksum('embedding')} AS checksum FROM ({CHUNKS})""",
    "embed_with_fallback": f"""SELECT id, CASE WHEN {FAIL_PRIMARY} THEN 'fallback' ELSE 'primary' END AS embed_model,
        {_checksum('embedding')} AS checksum FROM ({CHUNKS})""",
    "cache_lookup": f"""SELECT id, md5('hash-256:' || enc_input) AS cache_key,
        enc_input IN (SELECT enc_input FROM ({CHUNKS_NOVEC}) WHERE lang IN ('en', 'fr')) AS hit FROM ({CHUNKS_NOVEC})""",
    "collection_open": f"SELECT id, label, 64 AS dimension, 'cosine' AS metric FROM ({META})",
    "add_documents": f"SELECT id, label, CAST(64 AS INTEGER) AS dims FROM ({META}) WHERE label < 5 OR label IN (6, 8, 9)",
    "get_by_ids": f"SELECT id, text, label, zone, weight FROM ({META}) WHERE label IN (1, 2)",
    "delete_by_ids": f"SELECT id, label FROM ({META}) WHERE label <> 0",
    "update_segments": f"""SELECT id, CASE WHEN label = 4 THEN 'updated again ' || id ELSE text END AS text,
        CASE WHEN label = 4 THEN 104 ELSE label END AS label, CASE WHEN label = 4 THEN CAST(40 AS BIGINT) END AS new_field,
        4 AS segments, TRUE AS same_after_compaction FROM ({META}) WHERE label <> 0 OR embedding[2] > 0""",
    "lookup_stored": f"""SELECT id, CASE WHEN label = 4 THEN 'updated again ' || id ELSE text END AS text,
        CASE WHEN label = 4 THEN 104 ELSE label END AS label, CASE WHEN label = 4 THEN CAST(40 AS BIGINT) END AS new_field
        FROM ({META}) WHERE label <> 0
        AND id IN (SELECT 'vec_' || CAST(min(vec_id) AS VARCHAR) FROM embeddings GROUP BY label)""",
    "update_merge": f"""SELECT id, CASE WHEN label = 4 THEN 'updated again ' || id ELSE text END AS text,
        CASE WHEN label = 4 THEN 104 ELSE label END AS label,
        CASE WHEN label = 4 THEN 'updated' WHEN label = 8 THEN NULL ELSE zone END AS zone,
        CASE WHEN label = 8 THEN NULL ELSE weight END AS weight,
        CASE WHEN label = 4 THEN CAST(label * 10 AS BIGINT) END AS new_field,
        CAST(CASE WHEN label = 4 THEN 7 WHEN label = 8 THEN 0 ELSE 5 END AS INTEGER) AS n_keys,
        CAST(CASE WHEN label = 4 THEN 2 WHEN label = 8 THEN 1 ELSE 0 END AS INTEGER) AS n_applied FROM ({META})""",
    "collection_count": "SELECT count(*) AS count FROM embeddings",
    "list_ids": "SELECT 'vec_' || CAST(vec_id AS VARCHAR) AS id FROM embeddings",
    "peek": f"SELECT id, text, zone, weight FROM ({META}) ORDER BY id LIMIT 5",
    "metadata_profile": PROFILE_SQL,
    "metadata_roundtrip": """SELECT event_id, '{"k":' || CAST(CAST(json_extract(props, '$.k') AS BIGINT) AS VARCHAR) || '}' AS stored_props,
        CAST(json_extract(props, '$.k') AS BIGINT) AS props_k, 'u' || CAST(user_id AS VARCHAR) AS tag_user, event_type, value
        FROM events""",
    "collection_stats": f"""SELECT 'test_collection' AS name, (SELECT count(*) FROM embeddings) AS count, count(*) AS n_fields,
        string_agg(field || '=' || CAST(count AS VARCHAR) || ' (' || types || ')', '; ' ORDER BY field) AS fields,
        CAST(64 AS INTEGER) AS dimension FROM ({PROFILE_SQL})""",
    "verify_population": VERIFY_SQL,
    "backup_restore": f"SELECT id, text, label, zone, weight, {_checksum('embedding')} AS checksum FROM ({META})",
    "import_summary": f"""SELECT count(DISTINCT source_file) AS n_documents, count(*) AS n_chunks,
        count(*) FILTER (WHERE NOT {FAIL_PRIMARY}) AS n_embedded, count(*) FILTER (WHERE {FAIL_PRIMARY}) AS n_rejected,
        count(*) FILTER (WHERE NOT {FAIL_PRIMARY} AND lang <> 'en') AS n_written, round(avg(length(text)), 4) AS avg_chunk_chars
        FROM ({CHUNKS_NOVEC})""",
    "ingest_composed": f"""SELECT id, CAST(len(v) AS INTEGER) AS dims, {_checksum('v')} AS checksum
        FROM (SELECT id, CAST({_postprocess('embedding', 64)} AS FLOAT[]) AS v FROM ({CHUNKS}))""",
    "query_with_model": f"""WITH b AS (SELECT item_id, {S.task_prefix('text', 'search_query: ')} AS enc_input FROM benchmark),
        t AS (SELECT query_id, id, distance FROM ({_knn_sql(BENCH_Q, CHUNKS, "cosine", 1, "query_id, id, distance")}))
        SELECT item_id AS query_id, CASE WHEN {FAIL_PRIMARY} THEN 'error' ELSE 'ok' END AS status,
        CASE WHEN {FAIL_PRIMARY} THEN 'failed' END AS reason, CASE WHEN NOT {FAIL_PRIMARY} THEN id END AS id,
        CASE WHEN NOT {FAIL_PRIMARY} THEN {r4('distance')} END AS distance FROM b JOIN t ON item_id = query_id""",
    "reflection_tokens": f"""SELECT conv_id, turn,
        CAST(len(regexp_extract_all(response, {RET})) AS INTEGER) AS n_retrieval,
        CAST(len(regexp_extract_all(response, {NORET})) AS INTEGER) AS n_no_retrieval,
        CAST(len(regexp_extract_all(response, {CONT})) AS INTEGER) AS n_continue,
        CAST(NULLIF(regexp_extract(response, '\\[Utility:([1-5])\\]', 1), '') AS INTEGER) AS utility FROM ({DRAFT})""",
    "retrieval_decision": f"""SELECT conv_id, turn, prior AS has_prior_evidence, {_rule('response', 'prior')} AS should_retrieve
        FROM (SELECT *, {PRIOR_TOKEN} AS prior FROM ({DRAFT}))""",
    "prior_evidence": PRIOR_DECIDED,
    "retrieve_context": f"""SELECT query_id, CAST(count(*) AS INTEGER) AS n_contexts, string_agg(id, '|' ORDER BY rank) AS context_ids,
        CAST(sum(length(text)) AS BIGINT) AS context_chars FROM ({TOP5}) GROUP BY query_id""",
    "route_queries": f"""SELECT conv_id, turn, sr AS should_retrieve,
        CASE WHEN sr THEN 'with_context' ELSE 'direct' END AS route,
        CAST(CASE WHEN sr THEN (SELECT least(5, count(*)) FROM ({CHUNKS_NOVEC})) ELSE 0 END AS INTEGER) AS n_contexts
        FROM (SELECT *, {_rule('response', 'prior')} AS sr FROM (SELECT *, {PRIOR_TOKEN} AS prior FROM ({DRAFT})))
        WHERE role = 'user'""",
    "context_prompt": f"""SELECT t.query_id, string_agg('Context ' || CAST(t.rank AS VARCHAR) || ':' || chr(10) || t.text, {NL2} ORDER BY t.rank) || {NL2} || 'Question: ' || any_value(b.text) AS prompt
        FROM ({TOP5}) t JOIN benchmark b ON b.item_id = t.query_id GROUP BY t.query_id""",
    "instruction_prompt": """SELECT conv_id, turn, '### Instruction:' || chr(10) || text || chr(10) || chr(10) || '### Response:' || chr(10)
        || CASE WHEN next_role = 'assistant' AND next_text IS NOT NULL AND next_text <> ''
                THEN '[Retrieval]<paragraph>' || next_text || '</paragraph>' ELSE '' END AS prompt
        FROM (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role,
                        lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next_text FROM conversations)
        WHERE role = 'user'""",
    "prioritize_contexts": f"""SELECT query_id, id, CAST(priority AS INTEGER) AS priority, CAST(used_chars AS BIGINT) AS used_chars
        FROM ({PRIORITIZED_RANKED})""",
    "fuse_context": f"""SELECT b.item_id AS query_id, CAST(count(p.id) AS INTEGER) AS n_contexts,
        CASE WHEN count(p.id) > 0 THEN string_agg('Context ' || CAST(p.priority AS VARCHAR) || ':' || chr(10) || p.text, {NL2} ORDER BY p.priority)
             || {NL2} || 'Question: ' || any_value(b.text) ELSE 'Question: ' || any_value(b.text) END AS prompt
        FROM benchmark b LEFT JOIN ({PRIORITIZED_RANKED}) p ON p.query_id = b.item_id GROUP BY b.item_id""",
    "scan_markdown": f"""SELECT {FILE_NAME} AS file, CAST(length(content) AS BIGINT) AS n_chars,
        md5(content) AS text_md5, 1577836800 + 60 * doc_id AS modified FROM ({S.MARKDOWN_DOCS})
        UNION ALL SELECT 'empty_' || doc_id || '.md', 0, md5(''), 1577836800 + 60 * doc_id FROM documents WHERE lang = 'en'""",
    "ingest_corpus": FILE_CHUNKS,
    "incremental_import": FILE_CHUNKS,
    "cache_populate": f"""SELECT DISTINCT md5('hash-256:' || enc_input) AS cache_key, 'hash-256' AS model, md5(enc_input) AS text_hash,
        CAST(len(embedding) AS INTEGER) AS dims, {_checksum('embedding')} AS checksum FROM ({CHUNKS})""",
}
