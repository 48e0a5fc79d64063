"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from marigold.llm.licenses import BASE_PHRASES, MAX_TEMPLATE_WORDS, TEMPLATES, words_of

OP3 = """
WITH l AS (SELECT doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
           FROM (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
bad AS (SELECT k FROM l WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE bad.k IS NOT NULL) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE bad.k IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN bad ON l.k = bad.k GROUP BY doc_id
"""

OP6 = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM d),
starts AS (SELECT doc_id, unnest(range(0, len(w) - 34)) AS i, w FROM d WHERE len(w) >= 35),
windows AS (SELECT doc_id, i, md5(array_to_string(w[i + 1 : i + 35], ' ')) AS h FROM starts),
repeats AS (SELECT doc_id, i FROM windows WHERE h IN (SELECT h FROM windows GROUP BY h HAVING count(*) > 1)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM repeats)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(g.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM d LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g USING (doc_id)
LEFT JOIN (SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.i) AS t FROM words LEFT JOIN gone USING (doc_id, i) WHERE gone.doc_id IS NULL GROUP BY words.doc_id) k USING (doc_id)
"""

OP7 = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 2, CASE WHEN len(w) > 0 THEN 1 ELSE 0 END))) AS i FROM d)),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS class FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y, a.class AS cx, b.class AS cy FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n + b.n - c)),
reach AS (SELECT doc_id AS node, doc_id AS seen FROM n UNION SELECT reach.node, links.y FROM reach JOIN links ON links.x = reach.seen),
component AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node),
partners AS (SELECT x, count(DISTINCT cy) AS n_links FROM links WHERE cx <> cy GROUP BY x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN component ON node = d.doc_id LEFT JOIN partners ON x = d.doc_id
"""

OP8 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS c FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.c, c.c), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


#: The checksum of a list b of bytes, by a table t made from its polynomial.
CRC = """
crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i] || range(8), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM range(256) r(i))),
hexed AS (SELECT s, hex(encode(s)) AS x FROM strings),
listed AS (SELECT s, list_transform(range(0, length(x) // 2), lambda i: (strpos('0123456789ABCDEF', x[2 * i + 1]) - 1) * 16 + strpos('0123456789ABCDEF', x[2 * i + 2]) - 1) AS b FROM hexed),
checked AS MATERIALIZED (SELECT s, CAST(xor(list_reduce([4294967295] || b, lambda a, v: xor(t[xor(a & 255, v) + 1], a >> 8)), 4294967295) AS BIGINT) AS h FROM listed, crc)
"""

OP11 = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text, strlen(coalesce(text, '')) + 16 AS size, left(lang, 256) AS lang, left(source, 256) AS source, n_chars FROM documents),
strings AS (SELECT DISTINCT text AS s FROM d), {CRC},
c AS MATERIALIZED (SELECT doc_id, size, h, 32 * (rank() OVER (ORDER BY lang NULLS FIRST) - 1) // count(*) OVER () * CAST(lang IS NOT NULL AS BIGINT) AS x,
             32 * (rank() OVER (ORDER BY source NULLS FIRST) - 1) // count(*) OVER () * CAST(source IS NOT NULL AS BIGINT) AS y,
             32 * (rank() OVER (ORDER BY n_chars NULLS FIRST) - 1) // count(*) OVER () * CAST(n_chars IS NOT NULL AS BIGINT) AS z FROM d JOIN checked ON text = s),
walk AS (SELECT DISTINCT x, y, z, 5 AS k, 0::BIGINT AS e, 0::BIGINT AS dir, 0::BIGINT AS place FROM c
         UNION ALL
         SELECT x, y, z, k - 1, xor(e, ((even << ((dir + 1) % 3)) | (even >> (3 - (dir + 1) % 3))) & 7), (dir + [0, 1, 1, 2, 2, 1, 1, 0][w + 1] + 1) % 3, place * 8 + w
         FROM (SELECT *, xor(greatest(0, (w - 1) // 2 * 2), greatest(0, (w - 1) // 2 * 2) >> 1) AS even
               FROM (SELECT *, xor(xor(g, g >> 1), g >> 2) AS w
                     FROM (SELECT *, ((l >> ((dir + 1) % 3)) | (l << (3 - (dir + 1) % 3))) & 7 AS g
                           FROM (SELECT *, xor(e, ((x >> (k - 1)) & 1) + 2 * ((y >> (k - 1)) & 1) + 4 * ((z >> (k - 1)) & 1)) AS l FROM walk WHERE k > 0))))),
r AS (SELECT doc_id, size, h, row_number() OVER (ORDER BY place, doc_id NULLS FIRST, size, h) - 1 AS r, count(*) OVER () AS n FROM c JOIN (SELECT x, y, z, place FROM walk WHERE k = 0) USING (x, y, z)),
s AS (SELECT *, r * 40 // n AS shard FROM r)
SELECT doc_id, CAST(size AS BIGINT) AS size, h AS text_crc32, 'rows' AS law, CAST(shard AS INTEGER) AS shard, CAST(row_number() OVER (PARTITION BY shard ORDER BY r) - 1 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s
"""

OP12 = f"""
WITH RECURSIVE runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS s, run, count(*) AS n
                        FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents) GROUP BY ALL),
strings AS (SELECT s FROM runs), {CRC},
words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n
                       FROM (SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM runs JOIN checked USING (s))
                       WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cuts AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS cut FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS MATERIALIZED (SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM cuts a JOIN cuts b ON a.i = b.i AND a.cut = b.cut AND a.word <> b.word
         UNION SELECT c.word, c.n, w.word, w.n FROM cuts c JOIN words w ON c.cut = w.word
         UNION SELECT w.word, w.n, c.word, c.n FROM cuts c JOIN words w ON c.cut = w.word),
best AS MATERIALIZED (SELECT word, n_near, CASE WHEN near_n >= 2 * n THEN near END AS form, CASE WHEN near_n >= 2 * n THEN near_n END AS form_n
         FROM (SELECT *, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS r FROM near) WHERE r = 1),
chain AS (SELECT word, form AS root FROM best WHERE form IS NOT NULL UNION ALL SELECT chain.word, best.form FROM chain JOIN best ON chain.root = best.word WHERE best.form IS NOT NULL),
roots AS (SELECT word, root FROM chain WHERE root NOT IN (SELECT word FROM best WHERE form IS NOT NULL))
SELECT word, form, coalesce(root, word) AS root, n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n FROM words LEFT JOIN best USING (word) LEFT JOIN roots USING (word)
"""

OP13 = """
WITH lowered AS (SELECT row_number() OVER () AS d, doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
postings AS MATERIALIZED (SELECT d, doc_id, term, count(*) AS tf FROM (SELECT d, doc_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM lowered) GROUP BY ALL),
lengths AS (SELECT d, CAST(sum(tf) AS BIGINT) AS n FROM postings GROUP BY d),
corpus AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM lengths),
measures AS (SELECT d, 100 - 50 + (50 * n * docs) // terms AS m FROM lengths, corpus),
items AS (SELECT DISTINCT i, item_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
          FROM (SELECT row_number() OVER () AS i, item_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM benchmark)),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM postings, corpus GROUP BY term, docs),
scores AS (SELECT i, item_id, d, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score FROM items JOIN weights USING (term) JOIN postings USING (term) JOIN measures USING (d) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM scores WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 50
"""


def op5() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    templates = ", ".join(f"({quote(k)}, {quote(b' '.join(words_of(v.encode())).decode())})" for k, v in TEMPLATES.items())
    phrases = ", ".join(f"({quote(p)}, {quote(label)}, {len(p.split())})" for p, label in BASE_PHRASES.items())
    n = MAX_TEMPLATE_WORDS
    return f"""
WITH t AS (SELECT label, list_distinct(string_split(words, ' ')) AS words FROM (VALUES {templates}) AS t(label, words)),
p AS (SELECT * FROM (VALUES {phrases}) AS p(phrase, label, size)),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
places AS (SELECT doc_id, label, i - 1 AS pos FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d) JOIN p ON array_to_string(w[i : i + size - 1], ' ') = phrase),
base AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY doc_id),
blocks AS (SELECT doc_id, list_distinct(w[s + 1 : s + {2 * n}]) AS b FROM (SELECT doc_id, w, unnest(range(0, greatest(1, len(w) - {n}), {n})) AS s FROM d)),
hits AS (SELECT doc_id, label, max(len(list_intersect(b, words)) / len(words)::DOUBLE) AS score FROM blocks JOIN t ON len(list_intersect(b, words)) >= ceil(0.8::DOUBLE * len(words) - 1e-9) GROUP BY ALL),
best AS (SELECT doc_id, max(score) AS score FROM hits GROUP BY doc_id),
named AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM hits UNION ALL SELECT doc_id, label FROM places) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best.score, 0.0::DOUBLE) END AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN named USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_lines": OP3, "op5_licenses": op5(), "op6_substrings": OP6, "op7_ngrams": OP7, "op8_topk": OP8, "op11_hilbert": OP11, "op12_spelling": OP12, "op13_postings": OP13}
