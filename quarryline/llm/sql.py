"""DuckDB SQL for those of the subpackage's queries that SQL can express."""

from __future__ import annotations

_WHOLE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
_INTEGERS = "list_transform(embedding, lambda x: floor(1024 * x::DOUBLE))"

FILTER_AUDIT = r"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
  w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, doc_id > min(doc_id) OVER (PARTITION BY t) AS again FROM d),
  l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
  m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, (len(ws) < 200)::INT + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(again, false)::INT AS mask FROM w LEFT JOIN l USING (doc_id)),
  c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY ALL),
  f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit),
  o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a, f b, f c, f d, f e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
  s AS (SELECT filter_order, step, f.bit, coalesce((SELECT sum(g.bit) FROM f g WHERE strpos(filter_order, g.x) < step), 0)::INT AS before
    FROM o, (SELECT unnest(range(1, 6))::INT AS step) k, f WHERE f.x = filter_order[step]),
  r AS (SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before <> 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost
    FROM c, s GROUP BY ALL)
  SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r"""

TOP_K = f"""WITH v AS (SELECT vec_id, {_INTEGERS} AS e FROM embeddings WHERE vec_id IS NOT NULL AND {_WHOLE}),
  s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e)::BIGINT AS score FROM v q, v WHERE q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id),
  r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
  SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""


def _codes(rounds: int = 4) -> str:
    """Each round as tables of its own: a<n> the nearest entries by codebook c<n>, c<n + 1> the moved codebook."""
    steps = []
    for n in range(rounds + 1):
        steps.append(f"""a{n} AS MATERIALIZED (SELECT rid, part, min({{'d': xx + cc - 2 * list_inner_product(x, c), 'e': entry}}) AS m FROM p JOIN c{n} USING (part) GROUP BY ALL)""")
        if n < rounds:
            steps.append(f"""s{n} AS (SELECT part, m.e AS entry, unnest(x)::HUGEINT AS y, generate_subscripts(x, 1) AS i FROM p JOIN a{n} USING (rid, part)),
  t{n} AS (SELECT part, entry, i, sum(y) AS s, count(*) AS n FROM s{n} GROUP BY ALL),
  u{n} AS (SELECT part, entry, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY i) AS moved FROM t{n} GROUP BY ALL),
  c{n + 1} AS MATERIALIZED (SELECT part, entry, coalesce(moved, c) AS c, list_inner_product(coalesce(moved, c), coalesce(moved, c)) AS cc FROM c{n} LEFT JOIN u{n} USING (part, entry))""")
    return f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, label, {_INTEGERS} AS e FROM embeddings WHERE {_WHOLE}),
  p0 AS (SELECT rid, vec_id, part, e[part * (len(e) // 4) + 1:(part + 1) * (len(e) // 4)] AS x FROM v, (SELECT unnest(range(4)) AS part)),
  p AS MATERIALIZED (SELECT *, list_inner_product(x, x) AS xx FROM p0),
  c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS c, xx AS cc FROM p QUALIFY entry < 256),
  {", ".join(steps)},
  k AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda y: y::BIGINT::VARCHAR), ','), ',' ORDER BY part, entry)) AS sha FROM c{rounds}),
  w AS (SELECT rid, string_agg(lower(printf('%02x', m.e)), '' ORDER BY part) AS code, sum(m.d)::BIGINT AS error FROM a{rounds} GROUP BY 1)
  SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, sha AS codebooks_sha256 FROM v JOIN w USING (rid), k"""


CODES = _codes()
