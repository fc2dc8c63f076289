"""DuckDB twins of the queries that SQL can express. They judge the input directly, by windows and pairs."""

#: 50-byte windows as hex text; a window goes if its least document is smaller than its own.
OP1 = """
WITH docs AS (SELECT row_number() OVER () AS row, coalesce(doc_id, 9223372036854775807) AS place, doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
sized AS (SELECT *, length(h) // 2 AS n FROM docs),
windows AS (SELECT row, place, i, substr(h, 2 * i - 1, 100) AS s FROM sized, unnest(generate_series(1, n - 49)) AS u(i)),
least AS (SELECT s, min(place) AS first FROM windows GROUP BY s),
hits AS (SELECT row, i FROM windows JOIN least USING (s) WHERE first < place),
steps AS (SELECT row, i, i > coalesce(lag(i) OVER (PARTITION BY row ORDER BY i) + 50, 0) AS new FROM hits),
islands AS (SELECT row, i, sum(new::INT) OVER (PARTITION BY row ORDER BY i) AS k FROM steps),
spans AS (SELECT row, k, min(i) AS a, max(i) + 50 AS b FROM islands GROUP BY row, k),
gaps AS (SELECT row, k, a, b, coalesce(lag(b) OVER (PARTITION BY row ORDER BY k), 1) AS before FROM spans),
gone AS (SELECT row, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * before - 1, 2 * (a - before)), '' ORDER BY k) || substr(any_value(h), 2 * max(b) - 1) AS kept
  FROM gaps JOIN sized USING (row) GROUP BY row)
SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM sized LEFT JOIN gone USING (row)
"""

OP2 = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS row, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
pairs AS (SELECT a.row AS a, b.row AS b FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.row <> b.row
  WHERE list_dot_product(a.e, b.e) >= 0.98 * sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))),
reach(a, b) AS (SELECT row, row FROM v UNION SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a),
least AS (SELECT reach.a, min(v.vec_id) AS component_id FROM reach JOIN v ON v.row = reach.b GROUP BY 1),
n AS (SELECT a, count(*) AS n FROM pairs GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept FROM v JOIN least ON least.a = v.row LEFT JOIN n ON n.a = v.row
"""

#: The template's marks and escapes give the formatted length; the texts themselves come from the input.
OP4 = r"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r, text AS t FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok', 'user', '' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok', 'assistant', ''),
size AS (SELECT *, length(replace(replace(role, '\', '\\'), '<|', '<\|')) + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + length('<|turn|><|text|><|end|>') AS chars FROM turns),
done AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST) AS every,
  coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST) FILTER (WHERE role = 'assistant'), '') AS loss, sum(chars) AS chars FROM size GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(every) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM done
"""

OP9 = r"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT row, i, array_to_string(w[i:i + 34], ' ') AS s FROM docs, unnest(generate_series(1, len(w) - 34)) AS u(i)),
many AS (SELECT s FROM windows GROUP BY s HAVING count(*) > 1),
hits AS (SELECT row, i FROM windows SEMI JOIN many USING (s)),
gone AS (SELECT DISTINCT row, i + k AS i FROM hits, range(35) AS r(k)),
words AS (SELECT row, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM docs),
kept AS (SELECT row, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM words ANTI JOIN gone USING (row, i) GROUP BY row)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM docs LEFT JOIN kept USING (row)
"""

#: CRC-32 goes byte by byte through a table built from its polynomial; near words share what is left without one code point.
OP11 = r"""
WITH RECURSIVE bits(b, c, k) AS (SELECT CAST(range AS BIGINT), CAST(range AS BIGINT), 0 FROM range(256)
  UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT b, c FROM bits WHERE k = 8),
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')) AS w FROM documents),
low AS (SELECT d, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS n FROM runs GROUP BY ALL),
named AS (SELECT *, hex(encode(d || ':' || w)) AS h FROM low),
steps(d, w, n, h, i, c) AS (SELECT d, w, n, h, 0, 4294967295 FROM named
  UNION ALL SELECT d, w, n, h, i + 1, xor(s.c >> 8, crc.c) FROM steps s JOIN crc ON crc.b = xor(s.c & 255, CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)) WHERE i < length(h) // 2),
hashed AS (SELECT w, n, xor(c, 4294967295) AS h, xor(c, 4294967295) % length(w) AS cut FROM steps WHERE i = length(h) // 2),
slipped AS (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, cut) || substr(w, cut + 2) ELSE w END AS word, n FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM slipped WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
short AS (SELECT word, n, k, substr(word, 1, k) || substr(word, k + 2) AS s FROM words, range(length(word)) AS r(k)),
pairs AS (SELECT a.word AS word, b.word AS near FROM short a JOIN short b ON a.k = b.k AND a.s = b.s AND a.word <> b.word
  UNION SELECT w.word, short.word FROM words w JOIN short ON short.s = w.word UNION SELECT short.word, w.word FROM words w JOIN short ON short.s = w.word),
ranked AS (SELECT p.word, p.near, x.n AS near_n, count(*) OVER (PARTITION BY p.word) AS n_near, row_number() OVER (PARTITION BY p.word ORDER BY x.n DESC, p.near) AS place FROM pairs p JOIN words x ON x.word = p.near),
told AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * w.n THEN near END AS form, CASE WHEN near_n >= 5 * w.n THEN near_n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND place = 1),
chain(word, root, next) AS (SELECT word, word, form FROM told UNION ALL SELECT chain.word, told.word, told.form FROM chain JOIN told ON told.word = chain.next)
SELECT t.word, t.form, chain.root, t.n, CAST(t.n_near AS BIGINT) AS n_near, t.form_n FROM told t JOIN chain ON chain.word = t.word AND chain.next IS NULL
"""

OP12 = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
pairs AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)),
positives AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other AS negative_id, positive_score, score AS negative_score
FROM positives JOIN pairs USING (anchor_id) WHERE NOT same AND 100 * score BETWEEN 50 * positive_score AND 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) QUALIFY row_number() OVER w <= 3
"""
