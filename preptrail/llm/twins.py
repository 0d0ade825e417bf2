"""DuckDB SQL for the queries that SQL can express on whole tables."""

WORD = r"[^\x20\x09-\x0D]+"

#: Words at a window's start, hashed by doubling: h32 of a place is over the hashes of 16 words at it and
#: 16 after it, and so on; 35 = 32 + 2 + 1.
REMOVED = f"""
WITH split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
words AS (SELECT doc_id, len(w) AS n, unnest(range(len(w))) AS p, unnest(w) AS word FROM split),
h1 AS (SELECT *, md5(word) AS h1 FROM words),
h2 AS (SELECT *, md5(h1 || lead(h1, 1) OVER doc) AS h2 FROM h1 WINDOW doc AS (PARTITION BY doc_id ORDER BY p)),
h4 AS (SELECT *, md5(h2 || lead(h2, 2) OVER doc) AS h4 FROM h2 WINDOW doc AS (PARTITION BY doc_id ORDER BY p)),
h8 AS (SELECT *, md5(h4 || lead(h4, 4) OVER doc) AS h8 FROM h4 WINDOW doc AS (PARTITION BY doc_id ORDER BY p)),
h16 AS (SELECT *, md5(h8 || lead(h8, 8) OVER doc) AS h16 FROM h8 WINDOW doc AS (PARTITION BY doc_id ORDER BY p)),
h32 AS (SELECT *, md5(h16 || lead(h16, 16) OVER doc) AS h32 FROM h16 WINDOW doc AS (PARTITION BY doc_id ORDER BY p)),
h35 AS (
  SELECT doc_id, p, word, CASE WHEN p + 35 <= n THEN md5(h32 || lead(h2, 32) OVER doc || lead(h1, 34) OVER doc) END AS h
  FROM h32 WINDOW doc AS (PARTITION BY doc_id ORDER BY p)
), judged AS (
  SELECT doc_id, p, word, h IS NOT NULL AND count(*) OVER (PARTITION BY h) > 1 AS starts FROM h35
), covered AS (
  SELECT doc_id, p, word, bool_or(starts) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone
  FROM judged
), told AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (NOT gone) AS kept
  FROM covered GROUP BY doc_id
)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN told USING (doc_id)
"""

#: Equal sets share a digest, so links are sought between different sets only.
NEAR_COPIES = f"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents
), words AS (
  SELECT doc_id, len(w) AS n, unnest(range(len(w))) AS p, unnest(w) AS word FROM split
), shingled AS (
  SELECT doc_id, n, p, concat_ws(' ', word, lead(word, 1) OVER doc, lead(word, 2) OVER doc, lead(word, 3) OVER doc) AS s
  FROM words WINDOW doc AS (PARTITION BY doc_id ORDER BY p)
), members AS (
  SELECT DISTINCT doc_id, md5(s) AS s FROM shingled WHERE p <= greatest(n - 4, 0)
), sets AS (
  SELECT doc_id, count(*) AS size, md5(string_agg(s, '' ORDER BY s)) AS digest FROM members GROUP BY doc_id
), classes AS (
  SELECT digest, min(doc_id) AS first, any_value(size) AS size FROM sets GROUP BY digest
), held AS (
  SELECT first, size, s FROM members JOIN classes ON doc_id = first
), pairs AS (
  SELECT a.first AS one, b.first AS two
  FROM held a JOIN held b ON a.s = b.s AND a.first < b.first AND 10 * a.size >= 8 * b.size AND 10 * b.size >= 8 * a.size
  GROUP BY a.first, b.first, a.size, b.size HAVING 100 * count(*) >= 80 * (a.size + b.size - count(*))
), edges AS (
  SELECT one, two FROM pairs UNION ALL SELECT two, one FROM pairs
), reached AS (
  SELECT first AS doc, first AS other FROM classes
  UNION
  SELECT doc, two FROM reached JOIN edges ON other = one
), roots AS (
  SELECT doc AS first, min(other) AS component_id FROM reached GROUP BY doc
)
SELECT d.doc_id, coalesce(size, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id,
       coalesce(component_id, d.doc_id) = d.doc_id AS kept
FROM documents d
LEFT JOIN (SELECT doc_id, s.size, component_id FROM sets s JOIN classes USING (digest) JOIN roots USING (first)) USING (doc_id)
"""

SHARDS = """
WITH RECURSIVE bits AS (
  SELECT range AS byte, range AS v, 0 AS n FROM range(256)
  UNION ALL
  SELECT byte, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, n + 1 FROM bits WHERE n < 8
), lookup AS (
  SELECT list(v ORDER BY byte) AS t FROM bits WHERE n = 8
), bytes AS (
  SELECT doc_id, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS bs
  FROM documents
), sums AS (
  SELECT doc_id, xor(4294967295, list_reduce(bs, lambda c, x: xor(t[1 + (xor(c, x) & 255)], c >> 8), 4294967295::BIGINT)) AS text_crc32
  FROM bytes, lookup
), sized AS (
  SELECT doc_id, coalesce(strlen(text), 0) + 8 AS size FROM documents
), placed AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - size AS before, sum(size) OVER () AS total
  FROM sized
), sharded AS (
  SELECT doc_id, size, least(23, ((2 * before + size) * 24) // (2 * total)) AS shard FROM placed
)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'bytes' AS law, shard::INTEGER AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, NULL::INTEGER AS grown_shard
FROM sharded JOIN sums USING (doc_id)
"""

DIVERGENCE = r"""
WITH texts AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), words AS (
  SELECT doc, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM texts
), kept AS (
  SELECT lang, term, count(*) AS n FROM words GROUP BY ALL HAVING count(DISTINCT doc) >= 10
), langs AS (
  SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang
), used AS (
  SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL
), groups AS (
  SELECT lang, source, coalesce(sum(n), 0) AS total
  FROM (SELECT DISTINCT lang, source FROM texts) LEFT JOIN used USING (lang, source) GROUP BY ALL
), shares AS (
  SELECT g.lang, g.source, k.term, coalesce(u.n, 0) AS n,
         (1 + (1000000000::HUGEINT * (coalesce(u.n, 0) + 2)) // (g.total + 2 * l.v))::HUGEINT AS p,
         (1 + (1000000000::HUGEINT * (k.n + 2)) // (l.total + 2 * l.v))::HUGEINT AS q
  FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN used u USING (lang, source, term)
), summed AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN summed s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM shares WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM parts
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
"""

LINKED = """
WITH RECURSIVE sound AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT a.vec_id AS one, b.vec_id AS two
  FROM sound a JOIN sound b ON a.label = b.label AND a.vec_id < b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93
), edges AS (
  SELECT one, two FROM pairs UNION ALL SELECT two, one FROM pairs
), reached AS (
  SELECT vec_id, vec_id AS other FROM embeddings
  UNION
  SELECT vec_id, two FROM reached JOIN edges ON other = one
), roots AS (
  SELECT vec_id, min(other) AS component_id FROM reached GROUP BY vec_id
), counts AS (
  SELECT one AS vec_id, count(*) AS n_links FROM edges GROUP BY one
)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN roots USING (vec_id) LEFT JOIN counts USING (vec_id)
"""

RANKED = r"""
WITH found AS (
  SELECT doc_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), sizes AS (
  SELECT doc_id, count(*) AS n FROM found GROUP BY doc_id
), totals AS (
  SELECT count(*) AS N, sum(n) AS L FROM sizes
), postings AS (
  SELECT doc_id, term, count(*) AS tf FROM found WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), weights AS (
  SELECT term, floor(1000 * ln((2.0::DOUBLE * totals.N + 2) / (2 * count(*) + 1)))::BIGINT AS w
  FROM postings, totals GROUP BY term, totals.N
), impacts AS (
  SELECT doc_id, term, (1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * sizes.n * totals.N) // totals.L)) AS part
  FROM postings JOIN sizes USING (doc_id), totals
), scores AS (
  SELECT item_id, doc_id, sum(w * part)::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN impacts USING (term) GROUP BY ALL HAVING score > 0
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scores
)
SELECT * FROM ranked WHERE rank <= 50
"""
