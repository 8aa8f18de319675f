"""One query per operator, over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapline.llm import (
    bpe, embedding, exact, forest, language, lexical, lines, minhash, negatives, packing, preference, suffixes, warc,
)
from gapline.llm.registry import ORACLES, QUERIES, query, table

__all__ = ["ORACLES", "QUERIES"]

BYTE_BPE = str(public_tokenizers.path("byte_bpe_50k.json"))


@query("op1_suffix_dedup", """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
  g AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS g FROM (
    SELECT doc_id, h, unnest(range(len(h) // 2 - 49)) AS p FROM d WHERE len(h) >= 100)),
  m AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY g) AS first_id FROM g)
    WHERE first_id < doc_id),
  s AS (SELECT doc_id, p, CASE WHEN p > lag(p, 1, -1000) OVER w + 50 THEN 1 ELSE 0 END AS opens
    FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
  r AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM (SELECT doc_id, p, sum(opens)
    OVER (PARTITION BY doc_id ORDER BY p) AS k FROM s) GROUP BY doc_id, k),
  e AS (SELECT doc_id, a, b, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS next_a,
    row_number() OVER (PARTITION BY doc_id ORDER BY a) AS i FROM r),
  k AS (SELECT e.doc_id, count(*) AS n_spans, CAST(sum(b - a) AS BIGINT) AS n_removed,
    max(CASE WHEN i = 1 THEN substr(h, 1, 2 * a) END)
      || string_agg(substr(h, 2 * b + 1, 2 * (coalesce(next_a, len(h) // 2) - b)), '' ORDER BY a) AS kept
    FROM e JOIN d ON d.doc_id = e.doc_id GROUP BY e.doc_id)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed,
  coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id""")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf, "documents"), length=50).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op2_document_fingerprints")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    return embedding.edited_fingerprints(table(spark, sf, "documents"), least=embedding.NEAR)


@query("op3_bpe_round_trip")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.encode(table(spark, sf, "documents"), BYTE_BPE,
                      ("n_tokens", "ids_sha256", "decoded_sha256"))


@query("op4_minhash_near_dedup", """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'),
      lambda x: x <> '') AS w FROM documents),
  s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []
      WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM w),
  e AS (SELECT doc_id, unnest(s) AS h FROM s),
  f AS (SELECT doc_id, h, count(*) OVER (PARTITION BY doc_id) AS n FROM e),
  p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM f a JOIN f b ON a.h = b.h AND a.doc_id < b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
  l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
  r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.c = l.a)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, min(c) AS component_id, min(c) = s.doc_id AS kept
FROM s JOIN r ON r.doc_id = s.doc_id GROUP BY s.doc_id, len(s)""")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf, "documents"), percent=85)


@query("op5_preference_format", """
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
      coalesce(text, '')) AS i FROM conversations),
  k AS (SELECT conv_id, coalesce(max(i) FILTER (role = 'assistant'), max(i)) AS k FROM t GROUP BY conv_id),
  m AS (SELECT t.*, k, CASE WHEN max(CASE WHEN i = k THEN length(text) END)
      OVER (PARTITION BY conv_id) = 0 THEN k ELSE k - 1 END AS n,
    '<|im_start|>' || role || chr(10) AS head, '<|im_end|>' || chr(10) AS tail FROM t JOIN k USING (conv_id)),
  c AS (SELECT *, length(head) || '-,' || length(text || tail)
      || CASE role WHEN 'assistant' THEN '+' ELSE '-' END AS runs,
    substr(text, 1, length(text) // 2) AS half FROM m)
SELECT conv_id, CAST(max(n) AS INT) AS n_prompt_turns,
  coalesce(string_agg(head || text || tail, '' ORDER BY i) FILTER (i <= n), '') AS prompt,
  coalesce(string_agg(head || text || tail, '' ORDER BY i) FILTER (i > n), '') AS chosen,
  coalesce(string_agg(runs, ',' ORDER BY i) FILTER (i > n), '') AS chosen_mask,
  coalesce(string_agg(head || half || tail, '') FILTER (i = k AND k > n), '') AS rejected,
  coalesce(string_agg(length(head) || '-,' || length(half || tail)
    || CASE role WHEN 'assistant' THEN '+' ELSE '-' END, '') FILTER (i = k AND k > n), '') AS rejected_mask
FROM c GROUP BY conv_id""")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    """Every conversation against itself with its last answer cut in half."""
    chats = preference.conversations(table(spark, sf, "conversations"))
    pairs = chats.select("conv_id", F.col("turns").alias("chosen"),
                         preference.cut_last_answer(F.col("turns")).alias("rejected"))
    out = preference.format_pairs(pairs)
    return out.withColumns({c: preference.mask_text(F.col(c)) for c in ("chosen_mask", "rejected_mask")})


@query("op6_warc", """
WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS payload_digest,
    strlen(coalesce(html, '')) AS payload_bytes FROM pages),
  f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND first_id < page_id THEN 'revisit' ELSE 'response' END
    AS record_type,
  CASE WHEN payload_bytes >= 100 AND first_id < page_id THEN first_id END AS refers_to FROM f""")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    folder = warc.shared_folder(spark, "warc")
    warc.write_archives(table(spark, sf, "pages"), folder)
    return warc.read_archives(spark, folder).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op7_best_fit_packing")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf, "documents"), BYTE_BPE, size=1024, end_id=2).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "group_bins", "group_bound")


@query("op8_language_id")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return language.identify(docs, language.learn(docs))


@query("op9_line_dedup", """
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
  k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
  f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
  sha256(coalesce(string_agg(CASE WHEN f.key IS NULL THEN line END, chr(10) ORDER BY pos), ''))
    AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key GROUP BY doc_id""")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return lines.drop_frequent_lines(table(spark, sf, "documents"), min_docs=10).select(
        "doc_id", "n_lines", "n_dropped",
        F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


@query("op10_exact_dedup", """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t,
    regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm FROM documents),
  r AS (SELECT doc_id, first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id)
      AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size, norm FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM r""")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, sf, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept",
        F.lower(F.hex("digest")).alias("text_sha256"))


@query("op11_hard_negatives", """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT a.vec_id AS a, v.vec_id AS b, a.label = v.label AS same,
      CAST(list_dot_product(a.e, v.e) AS BIGINT) AS s
    FROM v a JOIN v ON a.vec_id % 50 = 0 AND a.vec_id <> v.vec_id),
  p AS (SELECT a, b, s FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS r
    FROM s WHERE same) WHERE r <= 5),
  n AS (SELECT p.a, p.b AS p, p.s AS ps, s.b AS n, s.s AS ns,
      row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.s DESC, s.b) AS r
    FROM p JOIN s ON p.a = s.a AND NOT s.same AND 50 * p.s <= 100 * s.s AND 100 * s.s <= 95 * p.s)
SELECT a AS anchor_id, p AS positive_id, CAST(r AS INTEGER) AS rank, n AS negative_id,
  ps AS positive_score, ns AS negative_score FROM n WHERE r <= 3""")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf, "embeddings").withColumn("label", moved)
    return negatives.hard_negatives(rows, F.col("vec_id") % 50 == 0)


@query("op12_ranked_lexical_search", """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS t FROM documents),
  i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
  c AS (SELECT count(*) FILTER (len(t) > 0) AS docs, CAST(sum(len(t)) AS BIGINT) AS terms FROM d),
  e AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM d)
    GROUP BY doc_id, n, term),
  w AS (SELECT term, CAST(floor(1000 * ln((2.0 * docs + 2) / (2.0 * count(*) + 1))) AS BIGINT) AS w
    FROM e, c GROUP BY term, docs),
  s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf)
      // (1000 * tf + 20 * (100 - 50 + ((50 * n * docs) // terms))))) AS BIGINT) AS score
    FROM i JOIN e USING (term) JOIN w USING (term), c GROUP BY item_id, doc_id),
  r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
    FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 50""")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.search(table(spark, sf, "benchmark"), table(spark, sf, "documents"), top=50)


@query("op13_hash_prefix_forest")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return forest.nearest(table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0, k=5)
