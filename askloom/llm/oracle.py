"""SQL over the whole tables for the queries that SQL can express."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLE["op7_minhash_near_dedup"] = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)] END) AS s
  FROM words
), ids AS (SELECT s, row_number() OVER () AS k FROM (SELECT s FROM shingles GROUP BY s HAVING count(*) > 1)
), held AS (SELECT doc_id, k FROM shingles JOIN ids USING (s)
), sizes AS (SELECT doc_id, count(s) AS n FROM (SELECT doc_id FROM documents) LEFT JOIN shingles USING (doc_id) GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
  FROM held a JOIN held b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * common.n >= 75 * (x.n + y.n - common.n)
), near AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM sizes UNION SELECT r.doc_id, n.b FROM reach r JOIN near n ON r.other = n.a
)
SELECT s.doc_id, s.n AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM sizes s JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)
"""

ORACLE["op2_substring_dedup"] = rf"""
WITH texts AS (SELECT doc_id, {WORDS} AS w FROM documents
), windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM texts)
), firsts AS (SELECT h, min(doc_id) AS first FROM windows GROUP BY h HAVING min(doc_id) < max(doc_id)
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM windows JOIN firsts USING (h) WHERE doc_id > first
), places AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM texts
), kept AS (
  SELECT p.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p.i) AS text
  FROM places p ANTI JOIN gone g ON p.doc_id = g.doc_id AND p.i = g.i GROUP BY p.doc_id
)
SELECT t.doc_id, len(w) AS n_words, len(w) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM texts t LEFT JOIN kept k USING (doc_id)
"""

ORACLE["op5_mixing"] = """
WITH sizes AS (SELECT source, count(*) AS n FROM documents GROUP BY source
), total AS (SELECT sum(pow(n, 0.7)) AS sw, sum(n) AS sn FROM sizes
), rates AS (SELECT source, pow(n, 0.7) / sw * sn / n AS rate FROM sizes, total
), terms AS (
  SELECT source, k, exp(k * ln(rate) - rate - lgamma(k + 1)) AS p FROM rates, unnest(range(0, 256)) t(k)
), below AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS f FROM terms
), drawn AS (
  SELECT doc_id, source, text,
    ('0x' || substr(md5('20260:' || doc_id || ':1'), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM documents
), counted AS (
  SELECT d.doc_id, d.source, d.text, count(b.k) AS n FROM drawn d
  LEFT JOIN below b ON b.source IS NOT DISTINCT FROM d.source AND b.f <= d.u GROUP BY ALL
)
SELECT doc_id, source, copy::INTEGER AS copy,
  ('0x' || substr(md5('20260 order:' || doc_id || ':' || copy), 1, 15))::BIGINT AS shuffle_key, text
FROM (SELECT *, unnest(range(1, n + 1)) AS copy FROM counted)
"""

# Vectors that take part, as whole rows; the components are cast to double first.
ORACLE["op1_exact_topk"] = """
WITH vectors AS (
  SELECT vec_id, [floor(256 * x::DOUBLE)::HUGEINT for x in embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), components AS (SELECT vec_id, unnest(v) AS x, unnest(range(len(v))) AS i FROM vectors
), scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, sum(q.x * c.x) AS score
  FROM components q JOIN components c ON q.i = c.i AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 GROUP BY ALL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score::BIGINT AS score FROM ranked WHERE rank <= 5
"""

ORACLE["op6_embedding_near_dedup"] = """
WITH RECURSIVE fine AS (
  SELECT vec_id, [x::DOUBLE for x in embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x for x in embedding if x <> 0]) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.95
), reach(vec_id, other) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.other = l.a
), counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a
)
SELECT r.vec_id, coalesce(any_value(c.n), 0)::BIGINT AS n_links, min(r.other) AS component_id, r.vec_id = min(r.other) AS kept
FROM reach r LEFT JOIN counts c USING (vec_id) GROUP BY r.vec_id
"""

# The control strings of the chat template; a text that holds one has its backslashes doubled and a
# backslash put into each control string.
CONTROL = r"<s>|</s>|\[/?INST!?\]|\[/?ANS!?\]|<</?SYS!?>>|\[/?ROLE[ \]]"

ORACLE["op4_chat_format"] = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), sized AS (
  SELECT *, CASE WHEN regexp_matches(text, '{CONTROL}')
      THEN 1 + length(replace(text, '\', '\\')) + len(regexp_extract_all(text, '{CONTROL}')) ELSE length(text) END
    + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 11 WHEN 'system' THEN 17 ELSE 16 + length(role) END AS n
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(n))::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""

# crc32 is linear: that of a text is the exclusive or of one entry per byte, by the byte and its distance from
# the end, and of a constant for the length (the same entries for four bytes 255 at the start, inverted).
ORACLE["op12_importance_resampling"] = r"""
WITH RECURSIVE step(b, c, k) AS (
  SELECT b, b::BIGINT, 0 FROM range(256) t(b)
  UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM step WHERE k < 8
), one AS (SELECT b, c FROM step WHERE k = 8
), runs AS (
  SELECT 0 AS kind, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL SELECT 1, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
), features AS (
  SELECT kind, doc_id, unnest(w || [w[i] || ' ' || w[i + 1] for i in range(1, len(w))]
    || [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) AS f FROM runs
), texts AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM features)
), longest AS (SELECT coalesce(max(len(h)), 0) // 2 + 4 AS n FROM texts
), far(d, b, c) AS (
  SELECT 0, b, c FROM one
  UNION ALL SELECT d + 1, far.b, xor(far.c >> 8, one.c) FROM far JOIN one ON one.b = far.c & 255, longest WHERE d < n
), bytes AS (
  SELECT f, len(h) // 2 AS n, unnest([('0x' || h[2 * i - 1:2 * i])::INTEGER for i in range(1, len(h) // 2 + 1)]) AS b,
    unnest(range(len(h) // 2)) AS i FROM texts
), ones AS (
  -- the register starts with 32 ones: byte i of the first four counts as inverted
  SELECT f, bit_xor(far.c) AS c FROM bytes JOIN far ON far.d = n - 1 - i AND far.b = CASE WHEN i < 4 THEN xor(bytes.b, 255) ELSE bytes.b END
  GROUP BY f
), short AS (
  -- of a text shorter than four bytes, what is left of the ones is shifted out instead
  SELECT f, CASE n WHEN 1 THEN 16777215 WHEN 2 THEN 65535 WHEN 3 THEN 255 ELSE 0 END AS c FROM (SELECT f, len(h) // 2 AS n FROM texts)
), sums AS (SELECT f, xor(4294967295, xor(ones.c, short.c)) % 10000 AS bucket FROM ones JOIN short USING (f)
), placed AS (SELECT kind, doc_id, bucket FROM features JOIN sums USING (f)
), counts AS (SELECT bucket, count(*) FILTER (kind = 0) AS s, count(*) FILTER (kind = 1) AS t FROM placed GROUP BY bucket
), totals AS (SELECT coalesce(sum(s), 0)::DOUBLE AS s, coalesce(sum(t), 0)::DOUBLE AS t FROM counts
), gains AS (
  SELECT bucket, floor(1000 * ln((c.t + 1)::DOUBLE * (totals.s + 10000) / ((c.s + 1)::DOUBLE * (totals.t + 10000))))::BIGINT AS g
  FROM counts c, totals
), weights AS (SELECT doc_id, count(*) AS n, sum(g)::BIGINT AS total FROM placed JOIN gains USING (bucket) WHERE kind = 0 GROUP BY doc_id
), scored AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(total, 0)::BIGINT AS weight, len(r.w) >= 20 AS fit, coalesce(total, 0)::BIGINT + floor(-1000 * ln(-ln(
    (('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM (SELECT * FROM runs WHERE kind = 0) r LEFT JOIN weights USING (doc_id)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id) AS nth, sum(fit::INT) OVER () AS m FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND nth <= 5 * m // 100 THEN nth END AS rank FROM ranked
"""

ORACLE["op13_source_divergence"] = r"""
WITH texts AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), words AS (SELECT d, lang, source, unnest(w) AS t FROM texts
), kept AS (SELECT lang, t FROM words GROUP BY lang, t HAVING count(DISTINCT d) >= 10
), sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang
), found AS (SELECT DISTINCT lang, source FROM texts
), counts AS (SELECT lang, source, t, count(*) AS n FROM words JOIN kept USING (lang, t) GROUP BY ALL
), totals AS (SELECT lang, source, sum(n) AS n FROM counts GROUP BY ALL
), shares AS (
  SELECT g.lang, g.source, k.t, coalesce(c.n, 0) AS c, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (coalesce(s.n, 0) + 2 * v) AS p
  FROM found g JOIN kept k ON k.lang = g.lang JOIN sizes ON sizes.lang = g.lang
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.t = k.t
  LEFT JOIN totals s ON s.lang = g.lang AND s.source = g.source
), whole AS (
  SELECT lang, t, 1 + 1000000000::HUGEINT * (sum(c) + 2) // (any_value(n) + 2 * any_value(v)) AS q
  FROM shares JOIN sizes USING (lang) JOIN (SELECT lang, sum(n) AS n FROM totals GROUP BY lang) USING (lang) GROUP BY lang, t
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY ALL
), every AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM found a JOIN found b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL SELECT lang, source, 'term', t, ((p - q) * (p - q) // (p + q))::BIGINT FROM shares JOIN whole USING (lang, t) WHERE c > 0 AND p > q
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM every
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
"""
