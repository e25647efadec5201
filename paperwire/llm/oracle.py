"""The same results in DuckDB's SQL, where it can express them on whole tables."""

from __future__ import annotations

from paperwire.llm import mixing

# The water level: sources in the order of size per weight, those at their limit first.
_MIXING = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         substr(md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 16) AS k
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [{", ".join(map(str, mixing.WEIGHTS))}][(row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % {len(mixing.WEIGHTS)} + 1] AS weight
  FROM d GROUP BY source
), r AS (
  SELECT *, {mixing.REPEATS} * source_size AS lim, {mixing.REPEATS} * source_size / weight::DOUBLE AS ratio FROM s
), l AS (
  SELECT *, row_number() OVER w AS pos,
         ({mixing.SHARE}::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(lim) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
         / (sum(weight) OVER () - coalesce(sum(weight) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS level
  FROM r WINDOW w AS (ORDER BY ratio, source IS NULL, encode(source))
), t AS (
  SELECT source, source_size,
         least(lim::DOUBLE, coalesce(weight::DOUBLE * (SELECT arg_min(level, pos) FROM l WHERE ratio > level), lim::DOUBLE)) AS target
  FROM l
), b AS (
  SELECT *, floor(target + 0.5)::BIGINT AS budget, floor(target + 0.5)::BIGINT // greatest(source_size, 1) AS epochs FROM t
), o AS (
  SELECT d.*, b.source_size, b.target, b.epochs, b.budget - b.epochs * b.source_size AS rest,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY k, doc_id IS NULL, doc_id, size
                                    RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE TIES), 0) - d.size AS before,
         count(*) OVER (PARTITION BY d.source, k, doc_id, size) AS alike
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, size, source_size, target,
       (epochs * size + CASE WHEN rest >= before + alike * size THEN size
                             WHEN rest > before THEN (rest - before) // alike ELSE 0 END)::BIGINT AS taken
FROM o
"""

_EXACT = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents
), n AS (
  SELECT *, row_number() OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id NULLS LAST) AS pos FROM d
)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY pos) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size, pos = 1 AS kept, text_sha256
FROM n
"""

# Every window of 50 words by its words; the least id of each.
_SUBSTRING = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS id,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), w AS (
  SELECT r, id, pos, md5(array_to_string(words[pos:pos + 49], ' ')) AS h FROM (SELECT r, id, words, unnest(range(1, len(words) - 48)) AS pos FROM d WHERE len(words) >= 50)
), m AS (
  SELECT h, min(id) AS least FROM w GROUP BY h HAVING min(id) < max(id)
), g AS (
  SELECT DISTINCT r, unnest(range(pos, pos + 50)) AS pos FROM w JOIN m USING (h) WHERE id > least
), p AS (
  SELECT r, list(pos) AS gone FROM g GROUP BY r
), u AS (
  SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM d
), k AS (
  SELECT r, string_agg(word, ' ' ORDER BY pos) AS kept FROM u ANTI JOIN g USING (r, pos) GROUP BY r
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN p USING (r) LEFT JOIN k USING (r)
"""

_NEIGHBOURS = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(list_zip(q.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])), lambda a, b: a + b)) AS score
  FROM e q JOIN e c ON q.vec_id % 100 = 0 AND c.vec_id IS DISTINCT FROM q.vec_id AND len(c.v) = len(q.v)
), n AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM p
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM n WHERE rank <= 10
"""

ORACLE_SQL: dict[str, str] = {
    "op2_mixing": _MIXING,
    "op5_exact": _EXACT,
    "op6_substring": _SUBSTRING,
    "op7_vptree": _NEIGHBOURS,
}
