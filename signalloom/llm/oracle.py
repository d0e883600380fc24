"""DuckDB twins of the queries that SQL can express."""

EXACT_DEDUP = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

MIXING = r"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, '')) AS shuffle_key
  FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source
), weighted AS (
  SELECT source, source_size, 2 * source_size AS cap,
         [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM per
), levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER before, 0)::DOUBLE)
              / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::DOUBLE AS level,
         coalesce(sum(cap) OVER before, 0) AS fulls
  FROM weighted
  WINDOW before AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), chosen AS (
  SELECT arg_min(level, fulls) AS level FROM levels WHERE level * weight <= cap
), targets AS (
  SELECT l.source, l.source_size,
         CASE WHEN c.level IS NULL OR c.level * l.weight > l.cap THEN l.cap::DOUBLE ELSE c.level * l.weight END AS target
  FROM levels l CROSS JOIN chosen c
), queued AS (
  SELECT s.*, sum(size) OVER (PARTITION BY source ORDER BY shuffle_key, doc_id ROWS UNBOUNDED PRECEDING) - size AS begun FROM sizes s
)
SELECT q.doc_id, q.size, t.source_size, t.target,
       (least(greatest(floor(t.target)::BIGINT - q.begun, 0), q.size)
        + least(greatest(floor(t.target)::BIGINT - q.begun - t.source_size, 0), q.size))::BIGINT AS taken
FROM queued q JOIN targets t ON q.source IS NOT DISTINCT FROM t.source
"""

LEXICAL_SEARCH = r"""
WITH asked AS (
  SELECT item, item_id, term, count(*) AS times
  FROM (SELECT row_number() OVER () AS item, item_id,
               unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM benchmark)
  GROUP BY ALL
), split AS (
  SELECT row_number() OVER () AS doc, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), totals AS (
  SELECT count(*)::BIGINT AS docs, sum(len(terms))::BIGINT AS words FROM split WHERE len(terms) > 0
), counts AS (
  SELECT doc, doc_id, n, term, count(*) AS tf
  FROM (SELECT doc, doc_id, len(terms)::BIGINT AS n, unnest(terms) AS term FROM split)
  WHERE term IN (SELECT term FROM asked)
  GROUP BY ALL
), weights AS (
  SELECT term, floor(1000 * ln((2 * max(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM counts CROSS JOIN totals GROUP BY term
), scored AS (
  SELECT item, item_id, doc, doc_id,
         sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // words))))::BIGINT AS score
  FROM asked JOIN counts USING (term) JOIN weights USING (term) CROSS JOIN totals
  GROUP BY ALL
)
SELECT item_id, row_number() OVER best::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0
WINDOW best AS (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST)
QUALIFY row_number() OVER best <= 20
"""

HARD_NEGATIVES = """
WITH named AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE)::BIGINT for x in embedding] AS own
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), parts AS (
  SELECT vec_id, label, generate_subscripts(own, 1) AS place, unnest(own) AS x FROM named
), products AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, any_value(a.label) = any_value(b.label) AS same, sum(a.x * b.x)::BIGINT AS score
  FROM parts a JOIN parts b ON a.place = b.place AND a.vec_id <> b.vec_id
  WHERE a.vec_id % 50 = 0
  GROUP BY ALL
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM products WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, positive_id, row_number() OVER best::INTEGER AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN products n ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW best AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id)
QUALIFY row_number() OVER best <= 3
"""
