"""DuckDB statements for the numbered operators that SQL can express."""

from __future__ import annotations

_REACH = """
reach(id, other) AS (
  SELECT DISTINCT a, a FROM links
  UNION
  SELECT reach.id, links.b FROM reach JOIN links ON reach.other = links.a),
least AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)"""

WARC = """WITH d AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY ALL)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)"""

NEAR_TEXTS = f"""WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+') AS words
  FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, CASE
    WHEN len(words) = 0 THEN []
    WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')))
    END AS shingles
  FROM w),
u AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS h FROM s),
links AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.h = b.h AND a.doc_id <> b.doc_id
  GROUP BY ALL HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),{_REACH}
SELECT doc_id, len(shingles) AS n_shingles, coalesce(component_id, doc_id) AS component_id,
       coalesce(component_id, doc_id) = doc_id AS kept
FROM s LEFT JOIN least ON id = doc_id"""

NEAR_VECTORS = f"""WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0
    AND NOT list_contains(list_transform(embedding, lambda x: coalesce(isfinite(x), false)), false)
    AND list_contains(list_transform(embedding, lambda x: x <> 0), true)),
links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a),{_REACH}
SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, vec_id) AS component_id,
       coalesce(component_id, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN n ON a = vec_id LEFT JOIN least ON id = vec_id"""

FILTER_AUDIT = """WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first
  FROM documents),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic
      FROM labels GROUP BY doc_id),
d AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         CASE WHEN len(words) < 50 THEN 'A' ELSE '' END
         || CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END
         || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN doc_id > first THEN 'E' ELSE '' END AS fails
  FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM d GROUP BY ALL),
o(filter_order) AS (
  SELECT '' UNION ALL
  SELECT filter_order || f FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f)
  WHERE NOT contains(filter_order, f)),
s AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS f, left(filter_order, step - 1) AS before
  FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step) WHERE length(filter_order) = 5),
m AS (
  SELECT part, filter_order, step, f, n, good, toxic, contains(fails, f) AS failing, fails = f AS alone,
         length(translate(before, fails, '')) < length(before) AS gone
  FROM c, s),
r AS (
  SELECT part, filter_order, step, f,
         coalesce(sum(n) FILTER (NOT gone AND NOT failing), 0) AS kept,
         coalesce(sum(n) FILTER (NOT gone AND failing), 0) AS removed,
         coalesce(sum(n) FILTER (gone AND failing), 0) AS redundant,
         coalesce(sum(n) FILTER (alone), 0) AS unique_fails,
         coalesce(sum(good) FILTER (NOT gone AND failing), 0) AS good_lost,
         coalesce(sum(toxic) FILTER (NOT gone AND failing), 0) AS toxic_lost
  FROM m GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept,
       CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM r"""

ORACLES: dict[str, str] = {
    "op4_minhash_near_dedup": NEAR_TEXTS,
    "op5_warc": WARC,
    "op10_embedding_near_dedup": NEAR_VECTORS,
    "op13_filter_audit": FILTER_AUDIT,
}
