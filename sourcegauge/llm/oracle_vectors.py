"""SQL for the queries on vectors, as DuckDB reads it: plain all-against-all versions, for small tables."""

from __future__ import annotations

from . import clustering, codes, topsearch

_USABLE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _whole(scale: int) -> str:
    return f"list_transform(embedding, lambda x: floor({scale}e0 * CAST(x AS DOUBLE)))"


def _search() -> str:
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, {_whole(topsearch.SCALE)} AS c FROM embeddings WHERE {_USABLE}),
s AS (SELECT q.r, q.vec_id AS query_id, v.vec_id, v.r AS vr, CAST(list_inner_product(q.c, v.c) AS BIGINT) AS score
      FROM v AS q JOIN v ON q.r <> v.r WHERE q.vec_id % 20 = 0),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST, vr) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM o WHERE rank <= {topsearch.K}"""


#: Squared distance of two lists of whole numbers, exact in double precision.
_SQUARED = "CAST(list_inner_product({0}, {0}) - 2 * list_inner_product({0}, {1}) + list_inner_product({1}, {1}) AS BIGINT)"


def _cluster() -> str:
    parts = [f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, {_whole(clustering.SCALE)} AS c, sha256('{clustering.SEED}:' || vec_id) AS h
  FROM embeddings WHERE {_USABLE} AND len(embedding) = {clustering.DIMENSIONS}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h NULLS LAST, c) - 1 AS k, c FROM v QUALIFY k < {clustering.CENTROIDS})"""]
    for i in range(clustering.ROUNDS + 1):
        parts.append(f"""
a{i} AS MATERIALIZED (SELECT r, k, d FROM (SELECT v.r, o.k, {_SQUARED.format('v.c', 'o.c')} AS d FROM v, c{i} AS o)
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, k) = 1)""")
        if i < clustering.ROUNDS:
            parts.append(f"""
m{i} AS (SELECT k, list(x ORDER BY i) AS c FROM (SELECT k, i, floor(sum(x) / count(*)) AS x
    FROM (SELECT k, unnest(c) AS x, unnest(range(len(c))) AS i FROM a{i} JOIN v USING (r)) GROUP BY k, i) GROUP BY k),
c{i + 1} AS MATERIALIZED (SELECT o.k, coalesce(m{i}.c, o.c) AS c FROM c{i} AS o LEFT JOIN m{i} USING (k))""")
    last = clustering.ROUNDS
    return ",".join(parts) + f"""
SELECT vec_id, CAST(k AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(list_transform(o.c, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
FROM a{last} JOIN v USING (r) JOIN c{last} AS o USING (k)"""


def _codes() -> str:
    n = codes.PARTS
    parts = [f"""
WITH u AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, {_whole(codes.SCALE)} AS c
  FROM embeddings WHERE {_USABLE} AND len(embedding) > 0 AND len(embedding) % {n} = 0),
v AS MATERIALIZED (SELECT * FROM u WHERE len(c) = (SELECT len(c) FROM u ORDER BY vec_id NULLS LAST, c LIMIT 1)),
p AS MATERIALIZED (SELECT r, pos, c[pos * (len(c) // {n}) + 1 : (pos + 1) * (len(c) // {n})] AS x FROM v, (SELECT unnest(range({n})) AS pos)),
s AS (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, c) - 1 AS e FROM v QUALIFY e < {codes.ENTRIES}),
b0 AS MATERIALIZED (SELECT pos, e, x FROM s JOIN p USING (r))"""]
    for i in range(codes.ROUNDS + 1):
        parts.append(f"""
a{i} AS MATERIALIZED (SELECT r, pos, e, d FROM (SELECT p.r, p.pos, b.e, {_SQUARED.format('p.x', 'b.x')} AS d FROM p JOIN b{i} AS b USING (pos))
  QUALIFY row_number() OVER (PARTITION BY r, pos ORDER BY d, e) = 1)""")
        if i < codes.ROUNDS:
            parts.append(f"""
m{i} AS (SELECT pos, e, list(x ORDER BY i) AS x FROM (SELECT pos, e, i, floor(sum(x) / count(*)) AS x
    FROM (SELECT pos, e, unnest(x) AS x, unnest(range(len(x))) AS i FROM a{i} JOIN p USING (r, pos)) GROUP BY pos, e, i) GROUP BY pos, e),
b{i + 1} AS MATERIALIZED (SELECT pos, e, coalesce(m{i}.x, b.x) AS x FROM b{i} AS b LEFT JOIN m{i} USING (pos, e))""")
    last = codes.ROUNDS
    return ",".join(parts) + f""",
name AS (SELECT sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY pos, e, i)) AS codebooks_sha256
  FROM (SELECT pos, e, unnest(x) AS x, unnest(range(len(x))) AS i FROM b{last})),
w AS (SELECT r, string_agg(format('{{:02x}}', e), '' ORDER BY pos) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{last} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM w JOIN v USING (r), name"""


ORACLES = {"op11_topk": _search(), "op12_clusters": _cluster(), "op13_codes": _codes()}
