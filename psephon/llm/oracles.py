"""DuckDB SQL for those queries of the corpus operators that SQL can express, over whole tables and whole texts."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a text, as a list.
WORDS = r"list_filter(string_split_regex({text}, '[\x20\x09-\x0D]+'), lambda s: s <> '')"
LOWERED = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"

LINES = """
WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
starts AS (SELECT doc_id, unnest(range(1, len(lines) - 1)) AS p, lines FROM cut WHERE len(lines) >= 3),
windows AS (SELECT doc_id, p, row_number() OVER (PARTITION BY lines[p], lines[p + 1], lines[p + 2] ORDER BY doc_id, p) AS k FROM starts),
gone AS (SELECT DISTINCT doc_id, unnest([p, p + 1, p + 2]) AS p FROM windows WHERE k > 1),
listed AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
kept AS (SELECT c.doc_id, c.lines, list_filter(range(1, len(c.lines) + 1), lambda i: NOT list_contains(coalesce(l.ps, []), i)) AS ks FROM cut c LEFT JOIN listed l ON c.doc_id = l.doc_id)
SELECT doc_id, len(lines) AS n_lines, len(lines) - len(ks) AS n_removed, sha256(array_to_string(list_transform(ks, lambda i: lines[i]), chr(10))) AS kept_sha256 FROM kept
"""

#: Every pair of documents that shares a shingle is compared, then links are followed to their ends.
JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(text=LOWERED)} AS ws FROM documents),
t AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w WHERE len(ws) >= 5),
runs AS (SELECT doc_id, CASE WHEN lead(word, 4) OVER v IS NOT NULL THEN concat_ws(' ', word, {", ".join(f"lead(word, {i}) OVER v" for i in range(1, 5))}) END AS s FROM t WINDOW v AS (PARTITION BY doc_id ORDER BY p)),
sh AS (SELECT DISTINCT doc_id, s FROM runs WHERE s IS NOT NULL UNION ALL SELECT doc_id, array_to_string(ws, ' ') AS s FROM w WHERE len(ws) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM least LEFT JOIN n USING (doc_id)
"""

#: A row for each byte; a 200-byte string is told by its MD5.
BYTES = """
WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS x FROM documents),
pos AS (SELECT doc_id, x, unnest(range(1, octet_length(x) + 1)) AS p FROM b),
k AS (SELECT doc_id, p, hex(x[p:p]) AS byte, CASE WHEN p + 199 <= octet_length(x) THEN md5_number(x[p:p + 199]) END AS string FROM pos),
f AS (SELECT doc_id, p, byte, string IS NOT NULL AND count(*) OVER (PARTITION BY string) > 1 AS repeats FROM k),
c AS (SELECT doc_id, p, byte, count(*) FILTER (repeats) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) > 0 AS gone FROM f),
s AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS opens FROM c),
g AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans, string_agg(byte, '' ORDER BY p) FILTER (NOT gone) AS kept FROM s GROUP BY doc_id)
SELECT b.doc_id, octet_length(b.x) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM b LEFT JOIN g ON b.doc_id = g.doc_id
"""

#: A row for each word, with the thirteen words from it on.
SUBSTRINGS = f"""
WITH t AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM (SELECT doc_id, {WORDS.format(text="coalesce(text, '')")} AS ws FROM documents)),
k AS (SELECT doc_id, p, word, CASE WHEN lead(word, 12) OVER w IS NOT NULL THEN concat_ws(' ', word, {", ".join(f"lead(word, {i}) OVER w" for i in range(1, 13))}) END AS string FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
f AS (SELECT doc_id, p, word, string IS NOT NULL AND min(doc_id) OVER (PARTITION BY string) < doc_id AS later FROM k),
c AS (SELECT doc_id, p, word, count(*) FILTER (later) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) > 0 AS gone FROM f),
s AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS opens FROM c),
g AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans, string_agg(word, ' ' ORDER BY p) FILTER (NOT gone) AS kept FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256, coalesce(n_spans, 0) AS n_spans FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id
"""

#: CRC-32 of an id's digits, bit by bit; the polynomial is a fixed value.
CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT)),
  lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[]), lambda r, k: CASE WHEN r % 2 = 1 THEN xor(r >> 1, 3988292384::BIGINT) ELSE r >> 1 END)), 4294967295::BIGINT)"""

#: A row for each token with its history; counts are joined to it, and the smoothed probabilities written out.
MODEL = f"""
WITH w AS (SELECT doc_id, {CRC.format(text="doc_id::VARCHAR")} % 7 = 2 AS held_out, list_concat([chr(9)], list_concat({WORDS.format(text=LOWERED)}, [chr(10)])) AS ws FROM documents),
t AS (SELECT doc_id, held_out, unnest(ws) AS word, unnest(range(0, len(ws))) AS p FROM w),
h AS (SELECT *, lag(word) OVER d AS h1, lag(word, 2) OVER d AS h2 FROM t WINDOW d AS (PARTITION BY doc_id ORDER BY p)),
c1 AS (SELECT word, count(*) AS c FROM t WHERE NOT held_out GROUP BY word),
c2 AS (SELECT h1, word, count(*) AS c FROM h WHERE NOT held_out AND p > 0 GROUP BY h1, word),
c3 AS (SELECT h2, h1, word, count(*) AS c FROM h WHERE NOT held_out AND p > 1 GROUP BY h2, h1, word),
size AS (SELECT coalesce(sum(c), 0)::BIGINT AS n, count(*) AS v FROM c1 WHERE word <> chr(9)),
s AS (SELECT h.doc_id, h.held_out, n, coalesce(a.c, 0) AS c, (coalesce(a.c, 0) + 1) / (n + 1 * (v + 1))::DOUBLE AS p1, coalesce(b.c, 0) AS cb, coalesce(g.c, 0) AS ch, coalesce(x.c, 0) AS cx, coalesce(y.c, 0) AS cy
  FROM h CROSS JOIN size LEFT JOIN c1 a ON a.word = h.word LEFT JOIN c2 b ON b.h1 = h.h1 AND b.word = h.word LEFT JOIN c1 g ON g.word = h.h1 LEFT JOIN c2 x ON x.h1 = h.h2 AND x.word = h.h1 LEFT JOIN c3 y ON y.h2 = h.h2 AND y.h1 = h.h1 AND y.word = h.word WHERE h.p > 0),
m AS (SELECT *, (cb + 500 * p1) / (ch + 500) AS p2 FROM s)
SELECT doc_id, any_value(held_out) AS held_out, count(*) AS n_tokens, count(*) FILTER (c > 0) AS n_known, any_value(n) AS train_tokens, round(fsum(log10(p1)), 7) AS base_score,
  round(fsum(log10(CASE WHEN cx >= greatest(3, n / 100000::DOUBLE) THEN (cy + 500 * p2) / (cx + 500) ELSE p2 END)), 7) AS score FROM m GROUP BY doc_id
"""
