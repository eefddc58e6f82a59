"""SQL of those queries of this subpackage that SQL can express on whole tables."""

from __future__ import annotations

from .pairs import PLACEHOLDERS

_CLAIM = r"""
  SELECT *, CASE WHEN regexp_matches(flat, '-[0-9]+$')
                 THEN regexp_replace(flat, '-[0-9]+$', '') || '-' || CASE WHEN length(num) < 3 THEN lpad(num, 3, '0') ELSE num END
                 ELSE flat END AS claim
  FROM (SELECT *, regexp_replace(regexp_extract(flat, '-([0-9]+)$', 1), '^0+([0-9])', '\1') AS num
        FROM (SELECT *, regexp_replace(regexp_replace(lower(claim_id), '[^\p{L}\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g') AS flat FROM final_record)) WHERE flat <> ''
"""

_HARM = """
  SELECT sample_id, system_id, rater_id, label FROM (
    SELECT *, row_number() OVER (PARTITION BY sample_id, system_id, rater_id ORDER BY submitted_at DESC NULLS LAST, received_at DESC NULLS LAST, label DESC NULLS LAST) AS rank
    FROM (SELECT *, CASE regexp_replace(lower(harm), '[^a-z]+', '', 'g') WHEN 'none' THEN 'None' WHEN 'low' THEN 'Low' WHEN 'moderate' THEN 'Moderate' WHEN 'severe' THEN 'Severe' END AS label
          FROM unblinded_rating WHERE sample_id IS NOT NULL AND system_id IS NOT NULL AND rater_id IS NOT NULL))
  WHERE rank = 1 AND label IS NOT NULL
"""


_RATED = """
  SELECT sample_id, system_id, rater_id, e.key AS dimension, CAST(e.value AS VARCHAR) AS label FROM (
    SELECT *, unnest(map_entries(ratings)) AS e FROM (
      SELECT *, row_number() OVER (PARTITION BY sample_id, system_id, rater_id ORDER BY submitted_at DESC NULLS LAST, received_at DESC NULLS LAST, CAST(to_json(ratings) AS VARCHAR) DESC NULLS LAST) AS rank
      FROM unblinded_rating WHERE sample_id IS NOT NULL AND system_id IS NOT NULL AND rater_id IS NOT NULL) WHERE rank = 1) WHERE e.value BETWEEN 1 AND 5
"""

_ALPHA = f"""
  WITH v AS (SELECT sample_id, system_id, rater_id, 'harm' AS dimension, label FROM ({_HARM}) UNION ALL SELECT * FROM ({_RATED})),
  c AS (SELECT dimension, sample_id, system_id, label, count(*) AS n FROM v GROUP BY 1, 2, 3, 4),
  p AS (SELECT dimension, sample_id, system_id, sum(n) AS m, sum(n * (n - 1)) AS same FROM c GROUP BY 1, 2, 3 HAVING sum(n) > 1),
  o AS (SELECT dimension, count(*) AS items, CAST(sum(m) AS BIGINT) AS votes, sum(CAST(m * (m - 1) - same AS DOUBLE) / (m - 1)) AS apart FROM p GROUP BY 1),
  e AS (SELECT dimension, sum(n) AS total, sum(n * n) AS squares FROM (SELECT dimension, label, sum(n) AS n FROM c JOIN p USING (dimension, sample_id, system_id) GROUP BY 1, 2) GROUP BY 1),
  r AS (SELECT dimension, items, votes, apart / votes AS observed, CAST(total * total - squares AS DOUBLE) / (total * (total - 1)) AS expected FROM o JOIN e USING (dimension))
  SELECT dimension, items, votes, round(observed, 6) AS observed, round(expected, 6) AS expected, CASE WHEN expected > 0 THEN round(1 - observed / expected, 6) ELSE 1.0 END AS alpha FROM r
"""

# brute force: the gram sets of all texts against each other
_SETS = """
  k AS (SELECT DISTINCT field, t FROM d WHERE t <> ''), n AS (SELECT *, row_number() OVER () AS k FROM k),
  g AS (SELECT field, k, unnest(CASE WHEN length(t) < 5 THEN [t] ELSE list_distinct(list_transform(range(1, length(t) - 3), lambda i: substring(t, i, 5))) END) AS g FROM n),
  s AS (SELECT field, k, count(*) AS s FROM g GROUP BY 1, 2),
  near AS (SELECT field, a, b FROM (SELECT x.field, x.k AS a, y.k AS b, count(*) AS m FROM g x JOIN g y ON x.field = y.field AND x.g = y.g AND x.k < y.k GROUP BY 1, 2, 3) JOIN s p USING (field) JOIN s q USING (field)
    WHERE p.k = a AND q.k = b AND m >= 0.8 * (p.s + q.s - m) - 1e-9),
  both_ways AS (SELECT field, a, b FROM near UNION ALL SELECT field, b, a FROM near UNION ALL SELECT field, k, k FROM n),
  held AS (SELECT d.*, n.k FROM d JOIN n USING (field, t))
"""

_NEAR = rf"""
  WITH raw AS (SELECT DISTINCT id, 'answer_yo_final' AS field, answer_yo_final AS x FROM working_record WHERE id IS NOT NULL UNION SELECT DISTINCT id, 'answer_en', answer_en FROM working_record WHERE id IS NOT NULL),
  d AS (SELECT DISTINCT id, field, trim(regexp_replace(lower(x), '[\t-\r \x{{85}}\p{{Z}}]+', ' ', 'g')) AS t FROM raw WHERE x IS NOT NULL), {_SETS}
  SELECT DISTINCT p.field, p.id AS id_a, q.id AS id_b FROM held p JOIN both_ways b ON b.field = p.field AND b.a = p.k JOIN held q ON q.field = p.field AND q.k = b.b WHERE p.id < q.id
"""

_PLACEHOLDERS = ", ".join(f"'{w}'" for w in sorted(PLACEHOLDERS))
_EMPTY = "regexp_replace(lower(strip_accents(output)), '^[ .!?–—…\\[\\](){}<>_*''\"-]+|[ .!?–—…\\[\\](){}<>_*''\"-]+$', '', 'g')"
_BARE = r"trim(regexp_replace(lower(strip_accents(coalesce(instruction, '') || ' ' || output)), '[^\p{L}\p{N}]+', ' ', 'g'))"
_ACROSS = f"""
  WITH d AS (SELECT DISTINCT id, split, 'text' AS field, {_BARE} AS t FROM final_record WHERE id IS NOT NULL AND output IS NOT NULL AND split IN ('train', 'val', 'test')
    AND regexp_matches(output, '[\\p{{L}}\\p{{N}}]') AND {_EMPTY} NOT IN ({_PLACEHOLDERS})), {_SETS}
  SELECT DISTINCT least(p.id, q.id) AS id_a, greatest(p.id, q.id) AS id_b FROM held p JOIN both_ways b ON b.a = p.k JOIN held q ON q.k = b.b WHERE p.split = 'train' AND q.split <> 'train'
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": f"SELECT claim AS claim_id FROM ({_CLAIM}) GROUP BY claim HAVING count(DISTINCT split) > 1",
        "p4_agreement": _ALPHA,
        "p5_found": _NEAR,
        "p6_found": _ACROSS,
    }
