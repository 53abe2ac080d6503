"""DuckDB SQL for the registered queries of the core."""

from __future__ import annotations

from lodestone.functions.analyze import WHITE_SPACE
from lodestone.plans.sources import DOCUMENTS, FUZZY, PARTS, PRODUCT_QUERIES, PRODUCTS, SEARCHES, Source

_TOKENS = "list_transform(regexp_extract_all({0}, '[A-Za-z0-9]+'), lambda t: lower(t))"
_SPACE = " || ".join(f"chr({ord(c)})" for c in WHITE_SPACE)
_TERM = f"nullif(lower(trim(token, {_SPACE})), '')"
_SEG = "row(coalesce(segment_id, -2147483648), tf)"


def _index(source: Source, parts: str = "posts stats aggs") -> str:
    """CTEs ``docs``, ``cells(doc_id, field, toks)``, ``posts``, ``stats``, ``aggs`` of a source."""
    columns = ", ".join(source.fields)
    if source.latest:
        newest = ", ".join(f"arg_max({c}, row({source.latest}, {columns})) AS {c}" for c in source.fields)
        # a row of nulls would be skipped by arg_max, so the fields are taken from the whole row
        newest = f"max(row({source.latest}, {columns})) AS s"
        fields = ", ".join(f"s[{i + 2}] AS {c}" for i, c in enumerate(source.fields))
        docs = f"SELECT doc_id, {fields} FROM (SELECT {source.key} AS doc_id, {newest} FROM {source.table} WHERE {source.key} IS NOT NULL GROUP BY 1)"
    else:
        docs = f"SELECT {source.key} AS doc_id, {columns} FROM {source.table}"
    cells = " UNION ALL ".join(
        f"SELECT doc_id, '{c}' AS field, {_TOKENS.format(c) if t == 'Text' else f'[lower({c})]'} AS toks FROM docs WHERE {c} IS NOT NULL"
        for c, t in source.fields.items()
        if t in ("Text", "Keyword")
    )
    return f"""docs AS ({docs}),
cells AS ({cells}),
posts AS (
  SELECT field, token, doc_id, CAST(count(*) AS INTEGER) AS tf, any_value(dl) AS dl
  FROM (SELECT field, doc_id, CAST(len(toks) AS INTEGER) AS dl, unnest(toks) AS token FROM cells) GROUP BY ALL
),
stats AS (SELECT field, doc_id, CAST(len(toks) AS INTEGER) AS total_tokens FROM cells),
aggs AS (SELECT field, count(*) AS n_docs, avg(total_tokens) AS avgdl FROM stats GROUP BY field)"""


_GRAMS = """places AS (
  SELECT field, token, min(row(doc_id, pos)) AS place
  FROM (SELECT field, doc_id, unnest(toks) AS token, unnest(generate_series(0, len(toks) - 1)) AS pos FROM cells) GROUP BY ALL
),
grams AS (
  SELECT DISTINCT field, substr(token, i, 3) AS trigram, token, place
  FROM (SELECT *, unnest(generate_series(1, length(token) - 2)) AS i FROM places)
),
firsts AS (SELECT field, trigram, arg_min(token, row(place, token)) AS token FROM grams GROUP BY ALL),
flat AS (SELECT trigram, arg_min(token, field) AS token FROM firsts GROUP BY ALL)"""


def _queries(texts: list[str]) -> str:
    values = ", ".join(f"({i}, '{t}')" for i, t in enumerate(texts))
    return f"""asked(query_id, q) AS (VALUES {values}),
split AS (SELECT query_id, {_TOKENS.format("q")} AS toks FROM asked),
exact AS (
  SELECT query_id, CAST(len(toks) AS INTEGER) AS n_terms, CAST(unnest(generate_series(0, len(toks) - 1)) AS INTEGER) AS term_pos, unnest(toks) AS token FROM split
)"""


def _alternatives(mode: str, distance: int = 1) -> str:
    known = "flat" if mode == "first" else "(SELECT DISTINCT trigram, token FROM grams)"
    return f"""wanted AS (
  SELECT DISTINCT token, substr(token, i, 3) AS trigram
  FROM (SELECT token, unnest(generate_series(1, length(token) - 2)) AS i FROM (SELECT DISTINCT token FROM exact))
),
alternatives AS (
  SELECT DISTINCT w.token, k.token AS alternative FROM wanted w JOIN {known} k USING (trigram)
  WHERE levenshtein(w.token, k.token) <= {distance}
)"""


_TERMS = {
    False: "terms AS (SELECT * FROM exact)",
    True: """terms AS (
  SELECT DISTINCT * FROM exact UNION
  SELECT query_id, n_terms, term_pos, alternative FROM exact JOIN alternatives USING (token)
)""",
}


def _scores(keep: str = "k = n_terms") -> str:
    return f"""hits AS (
  SELECT query_id, n_terms, field, term_pos, doc_id, arg_min(tf, token) AS tf, any_value(dl) AS dl
  FROM posts JOIN terms USING (token) GROUP BY ALL
),
dfs AS (SELECT *, count(*) OVER (PARTITION BY query_id, field, term_pos) AS df FROM hits),
weighed AS (
  SELECT query_id, n_terms, field, doc_id, ln((n_docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.2
         / (tf + 1.2 * (0.25 + 0.75 * CAST(dl AS DOUBLE) / avgdl)) AS w
  FROM dfs JOIN aggs USING (field)
),
per_field AS (SELECT query_id, n_terms, field, doc_id, sum(w) AS s, count(*) AS k FROM weighed GROUP BY ALL),
scored AS (SELECT query_id, doc_id, round(sum(s), 6) AS score FROM per_field WHERE {keep} GROUP BY ALL),
placed AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS place FROM scored
)"""


def _search(source: Source, texts: list[str], mode: str | None = None, keep: str = "k = n_terms", limit: int | None = 100) -> str:
    fuzzy = [_GRAMS, _queries(texts), _alternatives(mode)] if mode else [_queries(texts)]
    ctes = ",\n".join([_index(source), *fuzzy, _TERMS[bool(mode)], _scores(keep)])
    if limit is None:
        return f"WITH {ctes}\nSELECT query_id, doc_id, score FROM scored"
    return f"WITH {ctes}\nSELECT query_id, doc_id, score, place FROM placed WHERE place <= {limit}"


def _over(source: Source, select: str, *more: str) -> str:
    return "WITH " + ",\n".join([_index(source), *more]) + "\n" + select


SQL: dict[str, str] = {
    **{name: _search(source, texts) for name, (source, texts) in SEARCHES.items()},
    **{name: _search(source, texts, mode) for name, (source, texts, mode) in FUZZY.items()},
    "tokenize_documents": f"""SELECT doc_id, CAST(unnest(generate_series(0, len(toks) - 1)) AS INTEGER) AS pos, unnest(toks) AS token
FROM (SELECT doc_id, {_TOKENS.format("text")} AS toks FROM documents WHERE text IS NOT NULL)""",
    "keyword_tokens": _over(DOCUMENTS, "SELECT doc_id, field, toks[1] AS token FROM cells WHERE field <> 'text'"),
    "term_frequency": _over(DOCUMENTS, "SELECT field, token, doc_id, tf FROM posts"),
    "postings_with_length": _over(PRODUCTS, "SELECT field, token, doc_id, tf, dl FROM posts"),
    "field_stats": _over(DOCUMENTS, "SELECT field, doc_id, total_tokens FROM stats"),
    "field_agg": _over(DOCUMENTS, "SELECT field, n_docs, round(avgdl, 6) AS avgdl FROM aggs"),
    "document_frequency": _over(DOCUMENTS, "SELECT field, token, count(*) AS df FROM posts GROUP BY ALL"),
    "posting_lookup": _over(DOCUMENTS, "SELECT * FROM posts WHERE token IN ('winter', 'ferry', 'en')"),
    "project_source_fields": "SELECT p_partkey AS doc_id, p_name, p_brand, p_type, CAST(p_size AS DOUBLE) AS p_size, p_retailprice FROM part",
    "segment_statistics": "SELECT segment_id, field, count(DISTINCT doc_id) AS docs, max(doc_id) AS max_doc FROM field_stats GROUP BY ALL",
    "newest_segment": "SELECT max(segment_id) AS segment_id FROM postings",
    "current_postings": f"""SELECT field, token, doc_id, max(segment_id) AS segment_id, arg_max(tf, {_SEG}) AS tf FROM postings
WHERE token IS NOT NULL AND doc_id IS NOT NULL AND tf IS NOT NULL GROUP BY field, token, doc_id""",
    "restricted_stats": """SELECT field, doc_id, segment_id, total_tokens FROM field_stats
WHERE doc_id IN (SELECT doc_id FROM postings WHERE segment_id = 1)""",
    "trigram_index_first": _over(PRODUCTS, "SELECT field, trigram, token FROM firsts", _GRAMS),
    "trigram_index_full": _over(PRODUCTS, "SELECT DISTINCT field, trigram, token FROM grams", _GRAMS),
    "trigram_flatten": _over(PRODUCTS, "SELECT trigram, token FROM flat", _GRAMS),
    "fuzzy_candidates": _over(PRODUCTS, "SELECT token, alternative FROM alternatives", _GRAMS, _queries(PRODUCT_QUERIES), _alternatives("full", 1000)),
    "fuzzy_expand": _over(PRODUCTS, "SELECT * FROM terms", _GRAMS, _queries(PRODUCT_QUERIES), _alternatives("full"), _TERMS[True]),
    "search_with_docs": _search(PARTS, ["red widget", "small"]).replace(
        "SELECT query_id, doc_id, score, place FROM placed",
        "SELECT query_id, doc_id AS id, score, p_name, p_brand, p_type, CAST(p_size AS DOUBLE) AS p_size, p_retailprice FROM placed JOIN docs USING (doc_id)",
    ),
    "search_all_matches": _search(DOCUMENTS, ["winter ferry"], limit=None),
    "search_any_term": _search(DOCUMENTS, ["winter ferry"], keep="k > 0", limit=None),
    "segment_union_search": _search(*SEARCHES["search_exact_and"]),
    "compaction_invariance": _search(*SEARCHES["search_multi_field"]),
    "wal_truncate": """SELECT log_pos, doc_id FROM ingest_log
WHERE landed_at >= (SELECT max(window_to) FROM ingest_runs WHERE lower(trim(state)) = 'ok')""",
    "memtable_antijoin": """SELECT DISTINCT field, doc_id FROM postings p WHERE doc_id IS NOT NULL AND NOT EXISTS
(SELECT 1 FROM field_stats f WHERE f.field = p.field AND f.doc_id = p.doc_id AND total_tokens IS NOT NULL)""",
    "doc_id_intersection": _over(DOCUMENTS, """SELECT field, doc_id FROM posts WHERE token = 'winter'
INTERSECT SELECT field, doc_id FROM posts WHERE token = 'ferry'"""),
    "next_doc_id": """SELECT doc_id AS product, row_number() OVER (ORDER BY first_at, doc_id) + (SELECT max(doc_id) FROM postings) AS doc_id
FROM (SELECT doc_id, min(arrived_at) AS first_at FROM products GROUP BY doc_id)""",
    "delta_postings": _over(PRODUCTS, "SELECT field, token, doc_id, doc_id - lag(doc_id, 1, 0) OVER (PARTITION BY field, token ORDER BY doc_id) AS delta FROM posts"),
    "doc_blocks": """SELECT (place - 1) // 128 AS block, min(doc_id) AS first_doc, max(doc_id) AS last_doc, count(*) AS n_docs
FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS place FROM documents) GROUP BY 1""",
    "layout_summary": _over(DOCUMENTS, """SELECT (SELECT count(*) FROM docs) AS documents, count(DISTINCT field) AS fields,
count(DISTINCT (field, token)) AS terms, count(*) AS postings FROM posts"""),
    "layout_field_stats": _over(DOCUMENTS, """SELECT field, count(*) AS docs, CAST(sum(total_tokens) AS BIGINT) AS total_tokens,
round(avg(total_tokens), 6) AS avgdl, count(*) * 56 AS bytes FROM stats GROUP BY ROLLUP (field)"""),
    "layout_field_terms": _over(DOCUMENTS, """SELECT field, count(*) AS tokens, CAST(sum(df) AS BIGINT) AS postings, max(df) AS max_df,
arg_min(token, row(-df, token)) AS most_common FROM (SELECT field, token, count(*) AS df FROM posts GROUP BY ALL) GROUP BY field"""),
    "layout_top_tokens": _over(DOCUMENTS, "SELECT field, token, count(*) AS df FROM posts GROUP BY ALL ORDER BY df DESC, field, token LIMIT 15"),
    "p3_found": f"""SELECT field, {_TERM} AS token FROM postings WHERE field IS NOT NULL AND {_TERM} IS NOT NULL
GROUP BY 1, 2 HAVING count(*) * 100 >= (SELECT count(*) FROM postings)""",
    "p3_term_statistics": f"""WITH p AS (SELECT field, {_TERM} AS token, doc_id, segment_id, tf FROM postings),
d AS (
  SELECT field, token, doc_id, count(*) AS n,
         arg_max(tf, {_SEG}) FILTER (WHERE doc_id IS NOT NULL AND tf IS NOT NULL) AS tf
  FROM p WHERE field IS NOT NULL AND token IS NOT NULL GROUP BY ALL
)
SELECT field, token, CAST(sum(n) AS BIGINT) AS n_rows, count(tf) AS n_docs, CAST(sum(tf) AS BIGINT) AS total_tf,
       CAST(max(tf) AS BIGINT) AS max_tf FROM d GROUP BY ALL""",
}

_BLOCKS = """blocks AS (
  SELECT field, (place - 1) // 16 AS block, min(token) AS first_token, count(*) AS n_tokens, CAST(sum(df) AS BIGINT) AS n_postings
  FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY token) AS place
        FROM (SELECT field, token, count(*) AS df FROM posts GROUP BY ALL))
  GROUP BY ALL
)"""
SQL["token_blocks"] = _over(PRODUCTS, "SELECT * FROM blocks", _BLOCKS)
SQL["sparse_lookup_asof"] = _over(PRODUCTS, """SELECT field, t.token, arg_max(block, first_token) AS block
FROM blocks JOIN (SELECT DISTINCT token FROM exact) t ON first_token <= t.token GROUP BY ALL""", _BLOCKS, _queries(PRODUCT_QUERIES))

_STATE = """CASE WHEN json_valid(body) AND json_type(body) = 'OBJECT' THEN
  row(body ->> '$.title', body ->> '$.category', body ->> '$.organic', TRY_CAST(body ->> '$.price' AS DOUBLE)) END"""
SQL["p4_changes"] = f"""WITH rows_ AS (
  SELECT doc_id, row(written_at, log_pos) AS place, {_STATE} AS state,
         EXISTS (SELECT 1 FROM ingest_runs r WHERE lower(trim(r.state)) = 'ok' AND landed_at >= window_from AND landed_at < window_to) AS done
  FROM ingest_log
), docs AS (
  SELECT doc_id, arg_max(state, place) AS after, arg_max(state, place) FILTER (WHERE done) AS before, count(*) FILTER (WHERE NOT done) AS n
  FROM rows_ WHERE state IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id
)
SELECT doc_id, CASE WHEN before IS NULL THEN 'added' ELSE 'changed' END AS change FROM docs
WHERE n > 0 AND (before IS NULL OR before IS DISTINCT FROM after)"""
SQL["p4_found"] = f"SELECT doc_id FROM ({SQL['p4_changes']})"

SQL["p5_units"] = """WITH means AS (
  SELECT source, avg(ln(n_chars) - ln(length(text))) AS m, count(*) AS n_rows FROM documents
  WHERE source IS NOT NULL AND n_chars > 0 AND length(text) > 0 GROUP BY source
), tried AS (
  SELECT source, n_rows, unit, abs(m + ln(factor)) AS residual
  FROM means, (VALUES ('char', 1), ('dozen', 12), ('thousand', 1000)) u(unit, factor)
), ranked AS (
  SELECT *, lead(residual) OVER (PARTITION BY source ORDER BY residual, unit) AS second,
         row_number() OVER (PARTITION BY source ORDER BY residual, unit) AS place FROM tried
)
SELECT source, unit AS unit_n_chars, 'char' AS unit_counted, round(residual, 6) AS residual, n_rows, second - residual > 0.02 AS is_unique
FROM ranked WHERE place = 1"""

SQL["delta_decode"] = _over(PRODUCTS, "SELECT field, token, row_number() OVER (PARTITION BY field, token ORDER BY doc_id) - 1 AS place, doc_id FROM posts")
_BYTES = " || ".join(
    f"CASE WHEN {k} = 0 OR delta >> {7 * k} > 0 THEN printf('%02X', (delta >> {7 * k}) % 128 + CASE WHEN delta >> {7 * k + 7} > 0 THEN 128 ELSE 0 END) ELSE '' END"
    for k in range(8)
)
SQL["varint_deltas"] = f"SELECT field, token, doc_id, {_BYTES} AS encoded FROM ({SQL['delta_postings']})"
SQL["block_locations"] = _over(PRODUCTS, """SELECT field AS section, block, block * 16 AS offset,
CAST(lead(block * 16, 1, n) OVER (PARTITION BY field ORDER BY block) - block * 16 AS BIGINT) AS length
FROM blocks JOIN (SELECT field, CAST(sum(n_tokens) AS BIGINT) AS n FROM blocks GROUP BY field) USING (field)""", _BLOCKS)

_BODIES = "(SELECT log_pos, CASE WHEN json_valid(body) THEN body END AS body FROM ingest_log)"
_WHOLE = "coalesce(json_type(body) = 'OBJECT', false)"


def _kind(name: str, kind: str) -> str:
    kinds = {"Text": "'VARCHAR'", "Keyword": "'VARCHAR'", "Bool": "'BOOLEAN'", "Number": "'BIGINT', 'UBIGINT', 'HUGEINT', 'DOUBLE'"}[kind]
    return f"json_type(body, '$.{name}') IN ({kinds})"


def _missing(name: str) -> str:
    return f"coalesce(json_type(body, '$.{name}'), 'NULL') = 'NULL'"


_FIELDS = {"title": "Text", "category": "Keyword", "organic": "Bool", "price": "Number"}
_FIRST = " ".join(
    f"""WHEN {_missing(n)} THEN 'key "{n}" not found' WHEN NOT {_kind(n, k)} THEN 'key "{n}" is not of type {k}'""" for n, k in _FIELDS.items()
)
SQL["json_rejects"] = f"""SELECT log_pos, error FROM (
  SELECT log_pos, CASE WHEN NOT {_WHOLE} THEN 'the document is no JSON object' {_FIRST} END AS error FROM {_BODIES}
) WHERE error IS NOT NULL"""
_ALLOWED = " AND ".join(f"({_kind(n, k)} OR ({_missing(n)} AND NOT (SELECT required FROM mapping_fields WHERE field_name = '{n}')))" for n, k in _FIELDS.items())
_VALUES = {"organic": "CAST(body ->> '$.organic' AS BOOLEAN)", "price": "CAST(body ->> '$.price' AS DOUBLE)"}
SQL["json_documents"] = f"""SELECT log_pos, {", ".join(f"CASE WHEN ok THEN {_VALUES.get(n, f"body ->> '$.{n}'")} END AS {n}" for n in _FIELDS)}, NOT ok AS rejected
FROM (SELECT log_pos, body, CASE WHEN NOT {_WHOLE} THEN false ELSE {_ALLOWED} END AS ok FROM {_BODIES})"""
SQL["search_result_json"] = _search(PARTS, ["red widget"]).replace(
    "SELECT query_id, doc_id, score, place FROM placed",
    """SELECT format('{{"id":{},"score":{},"doc":{{"p_name":"{}","p_brand":"{}","p_type":"{}","p_size":{:.1f},"p_retailprice":{}}}}}',
doc_id, CAST(score AS VARCHAR), p_name, p_brand, p_type, CAST(p_size AS DOUBLE), CAST(p_retailprice AS VARCHAR)) AS json
FROM placed JOIN docs USING (doc_id)""",
)
SQL["layout_anchors"] = """SELECT CAST(segment_id AS VARCHAR) AS segment, CAST(place // 16 AS INTEGER) AS block, field, token FROM (
  SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY field, token) - 1 AS place
  FROM (SELECT DISTINCT segment_id, field, token FROM postings WHERE token IS NOT NULL AND segment_id IS NOT NULL)
) WHERE place % 16 = 0 AND place < 160"""
