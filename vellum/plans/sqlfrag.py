"""SQL fragments (DuckDB dialect) that mirror the Column expressions, for the oracle queries."""

from __future__ import annotations

from vellum.functions.text import (
    DOCUMENT_PREFIX,
    EMPTY_SENTINEL,
    TASK_PREFIXES,
    WORD_CHARS,
    WS_CHARS,
    WS_CLASS,
)

WS = WS_CLASS


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def is_blank(x: str) -> str:
    return f"({x} IS NULL OR regexp_replace({x}, '{WS}+', '', 'g') = '')"


def split_ws(x: str) -> str:
    return f"list_filter(regexp_split_to_array({strip(x)}, '{WS}+'), lambda w: w <> '')"


def capitalize(w: str) -> str:
    return f"(upper(substr({w}, 1, 1)) || lower(substr({w}, 2)))"


def n_chunks(x: str, size: int, overlap: int) -> str:
    step = size - overlap
    return f"(CASE WHEN length({x}) <= {size} THEN 1 ELSE CAST(ceil((length({x}) - {size}) / {step}.0) AS BIGINT) + 1 END)"


def title(x: str) -> str:
    hdr = "(?m)^#+ (.*?)$"
    first_line = f"split_part({strip(x)}, chr(10), 1)"
    words = f"list_filter({split_ws(first_line)}, lambda w: NOT starts_with(w, '#'))"
    from_line = f"array_to_string(list_transform({words}, lambda w: {capitalize('w')}), ' ')"
    return (f"(CASE WHEN regexp_matches({x}, '{hdr}') THEN {strip(f'regexp_extract({x}, {chr(39)}{hdr}{chr(39)}, 1)')} "
            f"WHEN {from_line} <> '' THEN {from_line} ELSE '' END)")


def tags(x: str) -> str:
    pat = f"tags:{WS}*\\[(.*?)\\]"
    end = f"strpos(substr({x}, 4), '---')"
    fm = f"substr({x}, 4, {end} - 1)"
    fm_tags = (f"(CASE WHEN starts_with({x}, '---') AND {end} > 0 AND regexp_matches({fm}, '{pat}') "
               f"THEN list_transform(string_split(regexp_extract({fm}, '{pat}', 1), ','), lambda t: {strip('t')}) "
               f"ELSE []::VARCHAR[] END)")
    inline = f"regexp_extract_all({x}, '#([{WORD_CHARS}]+)', 1)"
    return f"list_sort(list_distinct(list_concat({fm_tags}, {inline})))"


def preprocess(x: str) -> str:
    kept = f"regexp_replace({x}, '[^{WORD_CHARS}{WS_CHARS}.,!?\\-]', '', 'g')"
    collapsed = f"array_to_string({split_ws(kept)}, ' ')"
    dots = f"regexp_replace({collapsed}, '\\.{{2,}}', '.', 'g')"
    return f"(CASE WHEN {is_blank(x)} THEN '{EMPTY_SENTINEL}' ELSE {strip(dots)} END)"


def task_prefix(x: str, prefix: str = DOCUMENT_PREFIX) -> str:
    cond = " OR ".join(f"starts_with({x}, '{p}')" for p in TASK_PREFIXES)
    return f"(CASE WHEN {cond} THEN {x} ELSE '{prefix}' || {x} END)"


def preview(x: str, n: int = 100) -> str:
    return f"(CASE WHEN length({x}) > {n} THEN substr({x}, 1, {n}) || '...' ELSE {x} END)"


def excerpt(x: str, n: int) -> str:
    return f"(substr({x}, 1, {n}) || '...')"


def basename(x: str) -> str:
    return f"regexp_extract({x}, '([^/]*)$', 1)"


def hash_buckets(x: str, dim: int) -> str:
    toks = f"list_filter(regexp_split_to_array(lower({x}), '[^{WORD_CHARS}]+'), lambda w: w <> '')"
    return f"list_transform({toks}, lambda w: CAST((('0x' || substr(md5(w), 1, 8))::BIGINT % {dim}) AS INTEGER))"


MARKDOWN_DOCS = """
SELECT doc_id, '/corpus/' || source || '/doc_' || CAST(doc_id AS VARCHAR) || '.md' AS source_file, lang, source, n_chars,
  CASE WHEN lang = 'en' THEN '---' || chr(10) || 'tags: [' || lang || ', ' || source || ']' || chr(10) || '---' || chr(10)
          || '# ' || source || ' ' || CAST(doc_id AS VARCHAR) || chr(10) || text || ' #' || lang
       WHEN lang = 'fr' THEN text || ' #' || lang
       WHEN lang = 'de' THEN '---' || chr(10) || 'tags: []' || chr(10) || '---' || chr(10) || '#  ' || chr(10) || text
       ELSE '---' || chr(10) || 'title: x' || chr(10) || '---' || chr(10) || text END AS content
FROM documents
"""

DRAFT_RESPONSES = """
SELECT conv_id, turn, role, text || CASE (conv_id * 7 + turn) % 5 WHEN 0 THEN '[Retrieval]' WHEN 1 THEN '[No Retrieval]'
  WHEN 2 THEN '[Continue to Use Evidence]' WHEN 3 THEN '' ELSE '[No Retrieval][Utility:3]' END AS response
FROM conversations
"""

VECTOR_COLLECTION = """
SELECT 'vec_' || CAST(vec_id AS VARCHAR) AS id, 'vector ' || CAST(vec_id AS VARCHAR) || ' label ' || CAST(label AS VARCHAR) AS text,
  embedding, label
FROM embeddings
"""


def hash_vector(x: str, dim: int) -> str:
    """Dense L2-normalised FLOAT[] of the hash encoder (same float32 values as the Arrow step)."""
    bk = hash_buckets(x, dim)
    cnt = f"list_transform(range(0, {dim}), lambda b: len(list_filter({bk}, lambda z: z = b)))"
    return (f"(SELECT list_transform(c, lambda v: CAST(CASE WHEN n > 0 THEN v / n ELSE 0 END AS FLOAT)) "
            f"FROM (SELECT c, sqrt(list_sum(list_transform(c, lambda v: v * v))) AS n FROM (SELECT {cnt} AS c)))")


def chunk_collection(dim: int = 256, size: int = 500, overlap: int = 50, with_vectors: bool = True) -> str:
    """The markdown chunk collection: id, text, source_file, doc_title, chunk_index, total_chunks, tags,
    enc_input and (optionally) embedding."""
    step = size - overlap
    vec = f", {hash_vector('enc_input', dim)} AS embedding" if with_vectors else ""
    return f"""
SELECT *{vec} FROM (
  SELECT md5(source_file || ':' || CAST(chunk_index AS VARCHAR) || ':' || chunk) AS id, chunk AS text, source_file,
         doc_title, chunk_index, total_chunks, {tags('chunk')} AS tags, lang,
         {task_prefix(preprocess('chunk'))} AS enc_input
  FROM (
    SELECT source_file, doc_title, lang, CAST(i AS INTEGER) AS chunk_index, CAST(n AS INTEGER) AS total_chunks,
           substr(content, CAST(i * {step} + 1 AS BIGINT), {size}) AS chunk
    FROM (SELECT source_file, content, lang, {title('content')} AS doc_title, n, unnest(range(0, n)) AS i
          FROM (SELECT *, {n_chunks('content', size, overlap)} AS n FROM ({MARKDOWN_DOCS})))))
"""


META_COLLECTION = """
SELECT 'vec_' || CAST(vec_id AS VARCHAR) AS id, 'vector ' || CAST(vec_id AS VARCHAR) || ' label ' || CAST(label AS VARCHAR) AS text,
  embedding, label, CASE WHEN embedding[3] > 0.05 THEN 'north' WHEN embedding[3] < -0.05 THEN 'south' ELSE 'level' END AS zone,
  CAST(floor(abs(CAST(embedding[4] AS DOUBLE)) * 20) AS BIGINT) AS weight,
  round(CAST(embedding[1] AS DOUBLE), 4) AS score, embedding[2] > 0 AS flag,
  '[' || array_to_string(list_filter([CASE WHEN embedding[5] > 0 THEN '"x"' END, CASE WHEN embedding[6] > 0 THEN '"y"' END,
    CASE WHEN embedding[7] > 0 THEN '"z"' END], lambda v: v IS NOT NULL), ',') || ']' AS axes
FROM embeddings
"""
