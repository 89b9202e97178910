"""DuckDB SQL for the queries that SQL can express; the others are tested against brute force."""

from __future__ import annotations

_WORDS = r"[x for x in string_split_regex(coalesce({0}, ''), '[\x20\x09-\x0D]+') if x <> '']"
#: A-Z only: other letters keep their case.
_FOLD = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def words(column: str, fold: bool = False) -> str:
    return _WORDS.format(_FOLD.format(column) if fold else column)


OP3 = rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, {words("text")} AS ws FROM documents),
g AS (SELECT doc_id, i, list_slice(ws, i, i + 7) AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
d AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM d WHERE n > 1) GROUP BY doc_id),
m AS (SELECT w.doc_id, text, len(ws)::BIGINT AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len([x for x in string_split(text, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')])
     - len(list_distinct([x for x in string_split(text, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')])))::BIGINT AS n_dup_lines,
    coalesce(r.n, 0)::BIGINT AS n_repeat_words,
    length(regexp_replace(text, '[^!]', '', 'g')) AS n_shouts, length(regexp_replace(text, '\P{{L}}', '', 'g')) AS n_letters, len(string_split(text, chr(10))) AS n_lines
  FROM w LEFT JOIN r USING (doc_id)),
b AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 5 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 25 * n_words
       OR 2 * n_dup_lines > n_lines OR 5 * n_shouts > n_words OR 2 * n_letters < word_chars) AS kept
FROM b
"""

OP4 = f"""
WITH w AS (SELECT doc_id, {words("text")} AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 19), ' ') AS k
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20)),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM g),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM r WHERE n > 1),
e AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM w),
k AS (SELECT doc_id, count(c.j) AS n_removed, string_agg(word, ' ' ORDER BY j) FILTER (c.j IS NULL) AS kept
      FROM e LEFT JOIN c USING (doc_id, j) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
"""

OP5 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {words("text", fold=True)} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM l JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
reach(v, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, reach.c FROM reach JOIN e ON e.a = reach.v)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(c) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN reach ON reach.v = d.doc_id GROUP BY d.doc_id, n.n
"""

OP10 = f"""
WITH dw AS (SELECT doc_id, {words("text", fold=True)} AS ws FROM documents),
iw AS (SELECT item_id, {words("text", fold=True)} AS ws FROM benchmark),
i AS (SELECT DISTINCT item_id, k, array_to_string(list_slice(ws, p, p + k - 1), ' ') AS g
      FROM (SELECT item_id, ws, least(len(ws), 5) AS k, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS p FROM iw WHERE len(ws) > 0)),
n AS (SELECT item_id, count(*) AS n FROM i GROUP BY item_id),
d AS (SELECT DISTINCT doc_id, k, array_to_string(list_slice(ws, p, p + k - 1), ' ') AS g
      FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS p FROM dw, (SELECT DISTINCT k FROM i) WHERE len(ws) >= k)),
m AS (SELECT doc_id, item_id, count(*) AS shared FROM d JOIN i USING (k, g) GROUP BY ALL)
SELECT doc_id, item_id, n::BIGINT AS n_item, shared::BIGINT AS n_shared, shared / n AS containment
FROM m JOIN n USING (item_id) WHERE 10 * shared >= 8 * n
"""

ORACLE: dict[str, str] = {"op3_quality": OP3, "op4_substrings": OP4, "op5_jaccard": OP5, "op10_decontamination": OP10}
