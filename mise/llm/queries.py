"""One registered query per operator: name -> function of (spark, sf_dir), and its SQL twin
for DuckDB where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mise.llm import (conversations, embeddings, fingerprints, lines, minhash, packing, pieces, ppm, quality, spelling,
                      tokenfile, toxicity, warc)
from mise.llm.common import table


def vocabulary(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


OP1_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body FROM pages
), d AS (
  SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS hex,
         max(page_id) OVER (PARTITION BY body) AS largest FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + (CAST('0x' || substr(hex, 1 + 5 * (i // 4), 5) AS INTEGER) >> (15 - 5 * (i % 4))) % 32, 1)),
    'string_agg', '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM largest THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM largest THEN largest END AS refers_to
FROM d
"""


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digests(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), l AS (
  SELECT r, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), c AS (
  SELECT key FROM (SELECT DISTINCT r, key FROM k) WHERE key <> '' GROUP BY key HAVING count(*) >= 10
), m AS (
  SELECT k.*, c.key IS NOT NULL AS gone FROM k LEFT JOIN c ON k.key = c.key
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count_if(gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY r
"""


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


OP5_SQL = """
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), g AS MATERIALIZED (
  SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS size FROM v
  WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND list_inner_product(e, e) > 0
), l AS MATERIALIZED (
  SELECT a.vec_id AS x, b.vec_id AS y FROM g a JOIN g b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_inner_product(a.e, b.e) / (a.size * b.size) >= 0.9
), c AS (
  SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT c.x, l.y FROM c JOIN l ON c.y = l.x
), m AS (
  SELECT x, min(y) AS least FROM c GROUP BY x
)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.x = v.vec_id) AS n_links, m.least AS component_id,
  v.vec_id = m.least AS kept
FROM v JOIN m ON m.x = v.vec_id
"""


def op6_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(table(spark, sf_dir, "documents"), across=True)


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op8_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


OP8_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS MATERIALIZED (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []
    WHEN len(w) = 1 THEN [w[1]]
    ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS sh FROM d
), e AS MATERIALIZED (
  SELECT doc_id, len(sh) AS n, hash(unnest(sh)) AS h FROM s
), r AS MATERIALIZED (
  SELECT doc_id, n, h, row_number() OVER (PARTITION BY doc_id ORDER BY f, h) AS pos FROM (
    SELECT *, count(*) OVER (PARTITION BY h) AS f FROM e)
), p AS MATERIALIZED (
  SELECT DISTINCT a.doc_id AS x, b.doc_id AS y FROM r a JOIN r b ON a.h = b.h AND a.doc_id < b.doc_id
  WHERE a.pos <= a.n - ceil(0.8 * a.n) + 1 AND b.pos <= b.n - ceil(0.8 * b.n) + 1
    AND 10 * least(a.n, b.n) >= 8 * greatest(a.n, b.n)
), v AS MATERIALIZED (
  SELECT x, y FROM p JOIN s a ON a.doc_id = x JOIN s b ON b.doc_id = y
  WHERE 100 * len(list_intersect(a.sh, b.sh)) >=
    80 * (len(a.sh) + len(b.sh) - len(list_intersect(a.sh, b.sh)))
), l AS MATERIALIZED (
  SELECT x, y FROM v UNION SELECT y, x FROM v
), c AS (
  SELECT doc_id AS x, doc_id AS y FROM s UNION SELECT c.x, l.y FROM c JOIN l ON c.y = l.x
), m AS (
  SELECT x AS doc_id, min(y) AS component_id FROM c GROUP BY x
)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept
FROM s JOIN m ON s.doc_id = m.doc_id
"""


def op9_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op10_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damaged(table(spark, sf_dir, "conversations")))


#: CRC-32 of a text: ``crc`` holds the table of 256 remainders.
CRC_TABLE = """
t AS MATERIALIZED (
  SELECT list(c ORDER BY i) AS crc FROM (SELECT i, list_reduce(list_prepend(i, range(8)),
    lambda c, _k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))
)"""
CRC_OF = """xor(list_reduce(list_prepend(4294967295, list_transform(range(0, strlen({0})),
    lambda i: CAST('0x' || substr(hex(encode({0})), 2 * i + 1, 2) AS BIGINT))),
    lambda c, b: xor(c >> 8, crc[1 + (xor(c, b) & 255)])), 4294967295)"""

OP12_SQL = f"""
WITH RECURSIVE {CRC_TABLE}, o AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS named FROM conversations
), h AS (
  SELECT o.*, {CRC_OF.format("named")} % 20 AS kind FROM o, t
), d AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM h, range(CASE WHEN kind = 3 THEN 2 ELSE 1 END) WHERE kind <> 0
), a AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS again FROM d
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again) AS k,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS cut FROM a
), f AS MATERIALIZED (
  SELECT conv_id, turn, k, role, text, substr(role, 1, 1) AS i, CASE WHEN cut = '' THEN 1 WHEN again > 1 THEN 2
    WHEN right(cut, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM n
), c AS MATERIALIZED (
  SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count_if(fault = 1) AS blank,
    count_if(fault = 2) AS duplicate, count_if(fault = 3) AS truncated, max(k) AS rows FROM f GROUP BY conv_id
), j AS (
  SELECT conv_id, count_if(before || i NOT IN ('su', 'ua', 'au')) AS illegal FROM (
    SELECT conv_id, i, lag(i) OVER (PARTITION BY conv_id ORDER BY k) AS before FROM f) GROUP BY conv_id
), e AS (
  -- from state to state ('' nothing yet) with a letter: inserts, and what a row of a role may become
  SELECT * FROM (VALUES ('', 'u'), ('', 's'), ('s', 'u'), ('u', 'a'), ('a', 'u')) e(q, z)
), p AS (
  -- best path (cost before audit, as text) after k rows for each last role; odd steps insert, even ones read a row
  SELECT conv_id, 0::BIGINT AS step, '' AS q, '00000000' AS best FROM c
  UNION ALL
  SELECT conv_id, step, q, min(best) AS best FROM (
    SELECT p.conv_id, p.step + 1 AS step, unnest(CASE WHEN p.step % 2 = 0 THEN list_concat([{{'q': p.q, 'best': p.best}}],
        [{{'q': CASE WHEN p.q = 'u' THEN 'a' ELSE 'u' END, 'best': lpad((left(p.best, 8)::BIGINT + 2)::VARCHAR, 8, '0') || substr(p.best, 9) || 'I'}}])
      ELSE list_concat([{{'q': p.q, 'best': lpad((left(p.best, 8)::BIGINT + 3)::VARCHAR, 8, '0') || substr(p.best, 9) || 'D'}}],
        CASE WHEN f.fault IN (0, 3) THEN list_concat(
          CASE WHEN (p.q, f.i) IN (('', 's'), ('', 'u'), ('s', 'u'), ('u', 'a'), ('a', 'u')) THEN
            [{{'q': f.i, 'best': lpad((left(p.best, 8)::BIGINT + f.fault // 3)::VARCHAR, 8, '0') || substr(p.best, 9) || 'K'}}] ELSE [] END,
          [{{'q': CASE WHEN p.q = 'u' THEN 'a' ELSE 'u' END,
            'best': lpad((left(p.best, 8)::BIGINT + 2 + f.fault // 3)::VARCHAR, 8, '0') || substr(p.best, 9) || 'R'}}]) ELSE [] END) END,
      recursive := true)
    FROM p JOIN c ON c.conv_id IS NOT DISTINCT FROM p.conv_id LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.k = p.step // 2 + 1 AND p.step % 2 = 1
    WHERE p.step <= 2 * c.rows) GROUP BY conv_id, step, q
), w AS MATERIALIZED (
  SELECT p.conv_id, left(min(best), 8)::BIGINT AS cost, substr(min(best), 9) AS audit FROM p JOIN c ON c.conv_id IS NOT DISTINCT FROM p.conv_id
  WHERE step = 2 * c.rows + 1 AND q IN ('', 'a') GROUP BY p.conv_id
), l AS (
  SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS spot FROM w
), m AS (
  SELECT conv_id, spot, audit[spot] AS letter, length(replace(left(audit, spot), 'I', '')) AS k, length(replace(left(audit, spot), 'D', '')) AS pos,
    length(replace(audit, 'D', '')) AS total FROM l
), r AS (
  SELECT m.conv_id, sha256(string_agg(CASE WHEN letter = 'K' THEN f.role WHEN (total - pos) % 2 = 0 THEN 'assistant' ELSE 'user' END
    || ':' || CASE WHEN letter = 'I' THEN '' ELSE f.text END, chr(10) ORDER BY spot)) AS repaired
  FROM m LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM m.conv_id AND f.k = m.k AND letter <> 'I' WHERE letter <> 'D' GROUP BY m.conv_id
)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
  coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit,
  coalesce(repaired, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN j ON j.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN w ON w.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM a.conv_id
"""


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


OP13_SQL = f"""
WITH RECURSIVE {CRC_TABLE}, o AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS raw FROM documents
), s AS (
  SELECT doc_id, run, count(*) AS n, coalesce(doc_id::VARCHAR, '') || ':' || run AS named FROM (
    SELECT doc_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM o) GROUP BY doc_id, run
), h AS (
  SELECT run, n, {CRC_OF.format("named")} AS h FROM s, t
), m AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h
), v AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM m WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), x AS MATERIALIZED (
  -- each word without each of its letters: two words of one length are near if they agree without
  -- the same place, words of lengths one apart if the shorter is the longer without a letter
  SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM v)
), near AS MATERIALIZED (
  SELECT a.word, b.word AS near, b.n AS near_n FROM x a JOIN x b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT x.word, v.word, v.n FROM x JOIN v ON x.rest = v.word
  UNION SELECT v.word, x.word, x.n FROM x JOIN v ON x.rest = v.word
), b AS (
  SELECT word, count(*) AS n_near, max(near_n) AS most FROM near GROUP BY word
), g AS MATERIALIZED (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 2 * v.n THEN most END AS form_n,
    (SELECT min(near) FROM near WHERE near.word = v.word AND near_n = most AND most >= 2 * v.n) AS form
  FROM v LEFT JOIN b ON b.word = v.word
), c AS (
  SELECT word, word AS root FROM g UNION SELECT c.word, g.form FROM c JOIN g ON g.word = c.root WHERE g.form IS NOT NULL
)
SELECT g.word, g.form, c.root, g.n, g.n_near, g.form_n FROM g JOIN c ON c.word = g.word
JOIN g e ON e.word = c.root AND e.form IS NULL
"""

QUERIES = {f.__name__: f for f in (
    op1_warc, op2_toxicity, op3_sentencepiece, op4_line_dedup, op5_embeddings, op6_ppm, op7_fingerprints, op8_hyperminhash,
    op9_token_file, op10_best_fit, op11_quality_rules, op12_conversation_repair, op13_spelling_variants)}
ORACLE = {"op1_warc": OP1_SQL, "op4_line_dedup": OP4_SQL, "op5_embeddings": OP5_SQL, "op8_hyperminhash": OP8_SQL,
          "op12_conversation_repair": OP12_SQL, "op13_spelling_variants": OP13_SQL}
