"""DuckDB SQL for the registered queries that SQL can express on whole tables."""

from __future__ import annotations

from playmetrics.llm.secret_ledger import BASE_RULES, RULES


def _spans_sql(i: int, rule) -> str:
    pattern = rule.pattern.replace("'", "''")
    return f"""
    SELECT doc_id, {i} AS rank, '{rule.kind}' AS kind, ends[k] - length(hits[k]) AS s, ends[k] AS e
    FROM (SELECT doc_id, hits, vals, k, list_transform(range(1, len(hits) + 1), lambda j:
            CAST(list_sum(list_transform(gaps[1:j], lambda x: length(x)))
               + list_sum(list_transform(hits[1:j], lambda x: length(x))) AS BIGINT)) AS ends
          FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS k FROM (
            SELECT doc_id, string_split_regex(t, '{pattern}') AS gaps,
                   regexp_extract_all(t, '{pattern}', 0) AS hits,
                   regexp_extract_all(t, '{pattern}', {rule.group}) AS vals
            FROM D WHERE regexp_matches(t, '{pattern}'))))
    WHERE length(vals[k]) >= {rule.least}"""


def _op1() -> str:
    spans = " UNION ALL ".join(_spans_sql(i, r) for i, r in enumerate(RULES))
    base = len(BASE_RULES)
    text = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank)"
    return f"""WITH D AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    S AS ({spans}),
    A AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign,
                 count(*) FILTER (kind = 'access') AS n_access,
                 count(*) FILTER (kind = 'hex') AS n_hex,
                 {text} FILTER (rank < {base}) AS b, {text} AS spans FROM S GROUP BY doc_id)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
           coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256,
           coalesce(spans, '') AS spans
    FROM D LEFT JOIN A USING (doc_id)"""


_OP5 = r"""WITH
    W AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
    B0 AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
    B1 AS (SELECT item_id, w, least(len(w), 13) AS n FROM B0 WHERE len(w) > 0),
    B AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS g FROM (
            SELECT *, unnest(range(1, len(w) - n + 2)) AS k FROM B1)),
    L AS (SELECT DISTINCT n FROM B),
    G AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS g FROM (
            SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM W, L)),
    H AS (SELECT G.doc_id, G.k, G.n, B.item_id FROM G JOIN B USING (n, g)),
    P AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (
            SELECT doc_id, unnest(range(k, k + n)) AS p FROM H) GROUP BY doc_id),
    I AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (
            SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM H) GROUP BY doc_id)
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(items, '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM W LEFT JOIN P USING (doc_id) LEFT JOIN I USING (doc_id)"""


_OP4 = r"""WITH
    W AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'),
            lambda x: x <> '') AS w FROM documents),
    G AS (SELECT doc_id, k, array_to_string(w[k:k + 12], ' ') AS g FROM (
            SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM W)),
    M AS (SELECT doc_id, k, min(doc_id) OVER (PARTITION BY g) AS first FROM G),
    R AS (SELECT DISTINCT doc_id, unnest(range(k, k + 13)) AS p FROM M WHERE first < doc_id),
    L AS (SELECT doc_id, list(p) AS gone, count(*) AS n FROM R GROUP BY doc_id)
    SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed,
           sha256(array_to_string(CASE WHEN n IS NULL THEN w ELSE list_transform(list_filter(
             list_transform(range(1, len(w) + 1), lambda i: {'i': i, 'w': w[i]}),
             lambda x: NOT list_contains(gone, x.i)), lambda x: x.w) END, ' ')) AS kept_sha256
    FROM W LEFT JOIN L USING (doc_id)"""


_OP11 = """WITH
    V AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                 list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x
          FROM embeddings
          WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) =
                len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c)))),
    S AS (SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same,
                 CAST(list_sum(list_transform(range(1, len(a.x) + 1), lambda i: a.x[i] * r.x[i]))
                      AS BIGINT) AS score
          FROM V a JOIN V r ON a.vec_id <> r.vec_id WHERE a.vec_id % 50 = 0),
    P AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM S WHERE same
          QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
    SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank,
           id AS negative_id, positive_score, score AS negative_score
    FROM P JOIN S USING (anchor_id)
    WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
    WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)
    QUALIFY row_number() OVER w <= 3"""


_OP13 = r"""WITH
    D AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
    K AS (SELECT doc_id, source, CAST(len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS BIGINT)
            AS size, -ln((CAST('0x' || substr(md5('42:' || coalesce(CAST(doc_id AS VARCHAR), '')
              || ':' || md5(t)), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)
            / ((length(regexp_replace(t, '[^\p{L}]+', '', 'g')) + 1)::DOUBLE / (length(t) + 1)::DOUBLE) AS key
          FROM D),
    Z AS (SELECT source, CAST(sum(size) AS BIGINT) AS z, row_number() OVER (ORDER BY source NULLS LAST) AS i
          FROM K GROUP BY source),
    V AS (SELECT *, [5, 2, 1][CAST((i - 1) % 3 + 1 AS INTEGER)] AS w FROM Z),
    C AS (SELECT *, sum(2 * z) OVER o AS capped, sum(w) OVER (ORDER BY (2 * z) / w, i ROWS BETWEEN
            CURRENT ROW AND UNBOUNDED FOLLOWING) AS open, sum(z) OVER () AS total
          FROM V WINDOW o AS (ORDER BY (2 * z) / w, i ROWS UNBOUNDED PRECEDING)),
    L AS (SELECT max((total * 3 / 2.0::DOUBLE - (capped - 2 * z)) / open) AS level FROM C
          WHERE 2 * z > w * (total * 3 / 2.0::DOUBLE - (capped - 2 * z)) / open),
    G AS (SELECT source, z, least((2 * z)::DOUBLE, w * coalesce(level, 0)) AS target FROM V, L),
    E AS (SELECT *, CASE WHEN z > 0 THEN least(floor(target / z), 2) ELSE 0 END AS epochs FROM G),
    P AS (SELECT K.*, z, target, epochs, floor(target) - epochs * z - coalesce(sum(size) OVER (
            PARTITION BY K.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND
            1 PRECEDING), 0) AS room
          FROM K JOIN E ON K.source IS NOT DISTINCT FROM E.source)
    SELECT doc_id, size, z AS source_size, target,
           CAST(epochs * size + greatest(0, least(size, room)) AS BIGINT) AS taken, source,
           CAST(epochs AS INTEGER) AS epochs
    FROM P"""


def oracle_sql() -> dict[str, str]:
    return {"op1_secret_ledger": _op1(), "op4_superkmer_dedup": _OP4,
            "op5_benchmark_windows": _OP5,
            "op11_angular_negatives": _OP11, "op13_exponential_mix": _OP13}
