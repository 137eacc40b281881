"""DuckDB SQL of the training-data operators that SQL can express."""

from __future__ import annotations

from vicinage.llm import licenses


def _words(text: str) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"regexp_extract_all(translate({text}, '{upper}', '{lower}'), '{licenses.LOWER_WORD}')"


def license_sql() -> str:
    """Base places by word positions; template matches by set intersection of
    every block with every template, without any filter."""
    hits, labels = [], []
    for phrase, label in licenses.BASE.items():
        words = phrase.split(" ")
        test = " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(words, 1))
        hits.append(f"list_filter(range(0, greatest(len(w) - {len(words) - 1}, 0)), lambda i: {test})")
        labels.append(f"CASE WHEN len(p{len(labels)}) > 0 THEN '{label}' END")
    cols = ", ".join(f"{h} AS p{k}" for k, h in enumerate(hits))
    places = "flatten([" + ", ".join(f"p{k}" for k in range(len(hits))) + "])"
    sets = [(sorted(set(licenses.words_of(t))), label) for t, label in licenses.TEMPLATES.items()]
    template_rows = ", ".join(f"({k}, '{label}', {words!r}, {len(words)}, {licenses.needed(len(words))})" for k, (words, label) in enumerate(sets))
    half, full = licenses.BLOCK_WORDS // 2, licenses.BLOCK_WORDS
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
worded AS (SELECT r, doc_id, text, {_words("text")} AS w FROM docs),
placed AS (SELECT *, {cols} FROM worded),
based AS (
  SELECT r, doc_id, len(w) AS n_words, {places} AS places,
         list_sort(list_distinct(list_filter([{", ".join(labels)}], lambda x: x IS NOT NULL))) AS base_list
  FROM placed),
lines AS (SELECT r, {_words("line")} AS w FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs)),
blocks AS (SELECT r, row_number() OVER () AS k, list_slice(w, c + 1, c + {full}) AS b FROM (SELECT r, w, unnest(range(0, greatest(len(w) - {full} + {half}, 1), {half})) AS c FROM lines)),
templates(t, label, words, n, need) AS (VALUES {template_rows}),
matched AS (
  SELECT r, k, label, n, len(list_distinct(list_intersect(b, words))) AS common, need
  FROM blocks, templates),
fitting AS (SELECT r, k, label, common / n::DOUBLE AS part FROM matched WHERE common >= need),
closest AS (SELECT * FROM fitting QUALIFY part = max(part) OVER (PARTITION BY k)),
best AS (SELECT r, list(DISTINCT label) AS own, max(part) AS score FROM closest GROUP BY r)
SELECT doc_id, n_words::BIGINT AS n_words, len(places)::BIGINT AS n_base,
       list_min(places)::BIGINT AS first_word, list_max(places)::BIGINT AS last_word,
       coalesce(array_to_string(base_list, ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(base_list, coalesce(own, [])))), ','), '') AS labels,
       CASE WHEN len(places) > 0 THEN 1.0::DOUBLE ELSE coalesce(score, 0.0)::DOUBLE END AS score
FROM based LEFT JOIN best USING (r)"""


def near_duplicate_sql(width: int = 4, percent: int = 80) -> str:
    """All pairs by an inverted index of shingles, then the closure of the links."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {width} THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - {width} + 2), lambda i: array_to_string(list_slice(w, i, i + {width} - 1), ' '))) END AS s
  FROM worded),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
reach(u, v) AS (SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
least_of AS (SELECT u, min(v) AS m FROM reach GROUP BY u)
SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id,
       doc_id = least(doc_id, coalesce(m, doc_id)) AS kept
FROM sets LEFT JOIN least_of ON doc_id = u"""


TOPK_SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 64)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, d.vec_id, list_sum(list_transform(list_zip(q.v, d.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM whole q JOIN whole d ON q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored)
SELECT query_id, r::INT AS rank, vec_id, score FROM ranked WHERE r <= 20"""

WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html))::BIGINT AS n, sha1(html) AS h FROM p),
m AS (SELECT h, max(page_id) AS original FROM d WHERE n >= 1000 GROUP BY h)
SELECT page_id, n AS payload_bytes, d.h AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> original THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> original THEN original END AS refers_to
FROM d LEFT JOIN m ON d.h = m.h"""
