"""SQL for the queries of passages, resampling and clusters, from the same parameters."""

from __future__ import annotations

from . import clusters, decontaminate, resample

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


def decontamination() -> str:
    more = decontaminate.WINDOW - 1
    return f"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, {_WORDS} AS w FROM documents),
items AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_WORDS} AS w FROM benchmark),
held AS MATERIALIZED (
  SELECT DISTINCT item, array_to_string(w[i:i + {more}], ' ') AS win, least(len(w), {more + 1}) AS size
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - {more}, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
runs AS (
  SELECT row, s, size, array_to_string(w[s:s + size - 1], ' ') AS win
  FROM (SELECT row, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM docs, (SELECT DISTINCT size FROM held))),
met AS MATERIALIZED (SELECT row, s, size, item FROM runs JOIN held USING (win, size)),
hit AS (SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT row, unnest(range(s, s + size)) AS p FROM met) GROUP BY row),
named AS (
  SELECT row, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT row, item FROM met) GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (row) LEFT JOIN named USING (row)
"""


def resampling() -> str:
    b, last = resample.BUCKETS, 2**63 - 1
    return f"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, {_WORDS} AS w FROM documents),
goal AS (SELECT {_WORDS} AS w FROM benchmark),
bits AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab
  FROM (SELECT unnest(range(256))::BIGINT AS i)),
doc_features AS MATERIALIZED (
  SELECT row, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM docs),
goal_features AS MATERIALIZED (
  SELECT unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM goal),
named AS (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM doc_features UNION SELECT f FROM goal_features)),
bucketed AS MATERIALIZED (
  SELECT f, xor(list_reduce([4294967295::BIGINT] || list_transform(range(0, len(h) // 2),
           lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])),
           4294967295) % {b} AS bucket
  FROM named, bits),
s AS (SELECT bucket, count(*) AS s FROM doc_features JOIN bucketed USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM goal_features JOIN bucketed USING (f) GROUP BY bucket),
total AS (SELECT (SELECT coalesce(sum(s), 0) FROM s)::DOUBLE AS sa, (SELECT coalesce(sum(t), 0) FROM t)::DOUBLE AS ta),
gain AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (sa + {b}) / ((coalesce(s, 0) + 1)::DOUBLE * (ta + {b}))))::BIGINT AS g
  FROM s FULL JOIN t USING (bucket), total),
summed AS (
  SELECT row, count(*) AS n, sum(g)::BIGINT AS g
  FROM doc_features JOIN bucketed USING (f) JOIN gain USING (bucket) GROUP BY row),
scored AS MATERIALIZED (
  SELECT row, doc_id, len(w) AS n_words, coalesce(n, 0) AS n_features,
         coalesce((g - ((g % n) + n) % n) // n, 0)::BIGINT AS weight,
         floor(-1000 * ln(-ln((('0x' || substr(sha256('{resample.SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5)::DOUBLE
           / 4294967296.0)))::BIGINT AS noise
  FROM docs LEFT JOIN summed USING (row)),
ranked AS (
  SELECT row, row_number() OVER (ORDER BY weight + noise DESC, coalesce(doc_id, {last}), row) AS rank
  FROM scored WHERE n_words >= {resample.MIN_WORDS}),
drawn AS (SELECT row, rank FROM ranked WHERE rank <= {resample.PER_CENT} * (SELECT count(*) FROM ranked) // 100)
SELECT doc_id, n_features::BIGINT AS n_features, weight, weight + noise AS score, rank::BIGINT AS rank
FROM scored LEFT JOIN drawn USING (row)
"""


def clustering() -> str:
    dims, scale = clusters.DIMS, clusters.SCALE
    parts = [
        f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}),
flat AS MATERIALIZED (SELECT row, unnest(range({dims})) AS i, unnest(v) AS x FROM kept),
first AS (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (
  SELECT sha256('{clusters.SEED}:' || vec_id::VARCHAR) AS h, v FROM kept WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT {clusters.CENTROIDS})),
c0 AS MATERIALIZED (SELECT c, unnest(range({dims})) AS i, unnest(v) AS x FROM first)"""
    ]
    for t in range(clusters.ROUNDS + 1):
        parts.append(f"""
a{t} AS MATERIALIZED (SELECT row, min({{'d': d, 'c': c}}) AS best FROM (
  SELECT row, c, sum((flat.x - c{t}.x) * (flat.x - c{t}.x))::BIGINT AS d FROM flat JOIN c{t} USING (i) GROUP BY row, c) GROUP BY row)""")
        if t < clusters.ROUNDS:
            parts.append(f"""
c{t + 1} AS MATERIALIZED (SELECT c, i, coalesce(m, x) AS x FROM c{t} LEFT JOIN (
  SELECT best.c AS c, i, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS m
  FROM flat JOIN a{t} USING (row) GROUP BY best.c, i) USING (c, i))""")
    t = clusters.ROUNDS
    tail = f"""
SELECT vec_id, best.c::INTEGER AS cluster, best.d AS distance,
       sum(best.d) OVER (PARTITION BY best.c)::BIGINT AS cluster_inertia, sum(best.d) OVER ()::BIGINT AS inertia, centroid_sha256
FROM a{t} JOIN kept USING (row)
JOIN (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{t} GROUP BY c) names ON names.c = best.c
"""
    return ",".join(parts) + tail
