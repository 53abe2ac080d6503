"""DuckDB SQL for those queries that SQL can express; the others are tested against brute force in tests/llm."""

from __future__ import annotations

from lodestone.functions.analyze import WHITE_SPACE

_SPACE = " || ".join(f"chr({ord(c)})" for c in WHITE_SPACE)
_TERM = f"nullif(lower(trim(token, {_SPACE})), '')"

_COUNTS = f"""
WITH opened AS (
  SELECT field_id, {_TERM} AS token, segment_id, unnest(docs) AS d FROM token_entries
), cells AS (
  SELECT field_id, token, d.doc_id AS doc_id,
         arg_max(coalesce(d.tf, 0), row(coalesce(segment_id, -2147483648), coalesce(d.tf, 0))) AS tf
  FROM opened WHERE field_id IS NOT NULL AND token IS NOT NULL AND d.doc_id IS NOT NULL
  GROUP BY ALL
), fields AS (
  SELECT field_id, count(DISTINCT doc_id) AS field_docs FROM cells GROUP BY field_id
), counts AS (
  SELECT field_id, token, CAST(sum(tf) AS BIGINT) AS total_tf, count(*) AS n_docs FROM cells GROUP BY ALL
)
SELECT field_id, token, total_tf, n_docs, field_docs,
       CASE WHEN n_docs <= 1 THEN 'rare' WHEN 5 * n_docs > field_docs THEN 'common' END AS mark
FROM counts JOIN fields USING (field_id)
"""

_CURRENT = f"""
WITH p AS (
  SELECT field, {_TERM} AS token, doc_id, segment_id, tf FROM postings
), cur AS (
  SELECT field, token, doc_id, arg_max(tf, row(coalesce(segment_id, -2147483648), tf)) AS tf
  FROM p WHERE field IS NOT NULL AND token IS NOT NULL AND doc_id IS NOT NULL AND tf IS NOT NULL GROUP BY ALL
), lens AS (
  SELECT field, doc_id, arg_max(total_tokens, row(coalesce(segment_id, -2147483648), total_tokens)) AS dl
  FROM field_stats WHERE field IS NOT NULL AND doc_id IS NOT NULL AND total_tokens IS NOT NULL GROUP BY ALL
), fields AS (
  SELECT field, count(*) AS n, avg(dl) AS avgdl FROM lens GROUP BY field
), terms AS (
  SELECT field, token, count(*) AS df, sum(tf) AS total, sum(tf * log2(tf)) AS tf_log_tf FROM cur GROUP BY ALL
)
"""

_BM25 = (
    _CURRENT
    + """, scores AS (
  SELECT cur.field, cur.token, cur.doc_id, cur.tf, terms.df,
         ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2
         / (tf + 1.2 * (0.25 + 0.75 * CAST(coalesce(dl, 0) AS DOUBLE) / avgdl)) AS weight
  FROM cur JOIN terms USING (field, token) JOIN fields USING (field) LEFT JOIN lens USING (field, doc_id)
)
"""
)

# The characters that end a line.
_LINE_ENDS = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]"


def _repeats(lengths: tuple[int, ...]) -> str:
    """CTEs ``letters(doc_id, s)`` and for each n ``r<n>(doc_id, n)``: letters in windows of n that were started earlier."""
    out = [r"letters AS MATERIALIZED (SELECT doc_id, regexp_replace(lower(coalesce(text, '')), '[^\p{L}]', '', 'g') AS s FROM documents)"]
    for n in lengths:
        out.append(f"""w{n} AS (
  SELECT doc_id, i, min(i) OVER (PARTITION BY doc_id, substr(s, i, {n})) AS first
  FROM (SELECT doc_id, s, unnest(generate_series(1, length(s) - {n - 1})) AS i FROM letters)
), r{n} AS (
  SELECT doc_id, CAST(sum(least(coalesce(next - i, {n}), {n})) AS BIGINT) AS n
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM w{n} WHERE i > first) GROUP BY doc_id
)""")
    return ", ".join(out)


_SHARES = ", ".join(f"coalesce(r{n}.n, 0) AS repeated_{n}, CASE WHEN length(s) > 0 THEN coalesce(r{n}.n, 0) / length(s) ELSE 0 END AS share_{n}" for n in (10, 20, 50))

SQL: dict[str, str] = {
    "p1_term_counts": _COUNTS,
    "p1_found": f"SELECT field_id, token FROM ({_COUNTS}) WHERE mark IS NOT NULL",
    "p2_bm25": _BM25 + "SELECT field, token, doc_id, tf, df, round(weight, 6) AS weight FROM scores",
    "p2_log_entropy": _CURRENT
    + """
SELECT cur.field, cur.token, cur.doc_id, cur.tf, df,
       round(log2(1 + tf) * (1 - (log2(total) - tf_log_tf / total) / log2(greatest(n, df))), 6) AS weight
FROM cur JOIN terms USING (field, token) JOIN fields USING (field)
""",
    "p2_found": _BM25
    + """, places AS (
  SELECT doc_id, token, weight, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, token) AS place
  FROM scores WHERE field = 'title'
)
SELECT a.doc_id, a.token FROM places a JOIN places b USING (doc_id)
WHERE a.place = 1 AND b.place = 2 AND a.weight >= 2 * b.weight
""",
    "p7_by_length": """SELECT doc_id, CAST(coalesce(length(text), 0) AS BIGINT) AS n_chars,
CAST(greatest(1, ceil(coalesce(length(text), 0) / 8192)) AS BIGINT) AS n_parts, true AS fits FROM documents""",
    "p8_found": f"WITH {_repeats((20,))} SELECT doc_id FROM letters JOIN r20 USING (doc_id) WHERE n * 10 >= length(s) * 3",
    "p8_repetition": f"""WITH {_repeats((10, 20, 50))}, pieces AS (
  SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS i
  FROM (SELECT doc_id, string_split_regex(text, '{_LINE_ENDS}') AS parts FROM documents)
), lines AS (
  SELECT doc_id, length(line) AS n, i > min(i) OVER (PARTITION BY doc_id, line) AS again
  FROM (SELECT doc_id, i, trim(line, {_SPACE}) AS line FROM pieces) WHERE line <> ''
), totals AS (SELECT doc_id, sum(n) AS n, sum(n) FILTER (WHERE again) AS again FROM lines GROUP BY doc_id)
SELECT letters.doc_id, length(s) AS n_letters, {_SHARES}, coalesce(totals.again / totals.n, 0) AS share_lines
FROM letters LEFT JOIN r10 USING (doc_id) LEFT JOIN r20 USING (doc_id) LEFT JOIN r50 USING (doc_id) LEFT JOIN totals USING (doc_id)""",
}
