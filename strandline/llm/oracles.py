"""DuckDB SQL of the queries that are too long to stand beside them, built from the same parameters."""

from __future__ import annotations

from .secret_ledger import BASE_RULES, RULES, SecretRule
from .source_divergence import LEAST_DOCUMENTS, PRIOR, TOP, UNIT
from .url_filter import BUCKETS, LABELLED, SIZES, train
from .url_filter import RULES as URL_RULES

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_sql() -> str:
    weights, intercept = train(LABELLED)
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
    grams = ", ".join(f"list_transform(range(1, length({t}) + {4 - n}), lambda i: '{t[0]}' || substr(' ' || {t} || ' ', i, {n}))" for t in ("host", "path") for n in SIZES)
    return f"""
WITH p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages
), rules(h, r, v) AS (VALUES {rules}
), fits AS (
  SELECT page_id, h || r AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h || r) DESC, h || r) AS k
  FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, r)
), grams AS (
  SELECT *, list_distinct(list_transform(list_concat({grams}), lambda g: CAST('0x' || substr(md5(g), 1, 8) AS BIGINT) % {BUCKETS} + 1)) AS b FROM p
), scores AS (
  SELECT *, {intercept!r} + coalesce(list_sum(list_transform(b, lambda k: CAST([{', '.join(map(repr, weights))}] AS DOUBLE[])[k])), 0) / sqrt(greatest(len(b), 1)) AS score FROM grams
)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN score > 0 THEN 'block' ELSE 'allow' END) AS verdict
FROM scores LEFT JOIN (SELECT * FROM fits WHERE k = 1) USING (page_id)
"""


def secrets_sql() -> str:
    def found(k: int, rule: SecretRule) -> str:
        pattern = rule.pattern.replace("'", "''")
        return f"""
  SELECT doc_id, {k} AS rank, '{rule.kind}' AS kind, unnest(list_transform(range(1, len(m) + 1), lambda i: [
      CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS BIGINT), length(m[i]), length(n[i])])) AS s
  FROM (SELECT doc_id, string_split_regex(t, '{pattern}') AS g, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {rule.group}) AS n FROM d WHERE regexp_matches(t, '{pattern}'))"""

    every = " UNION ALL ".join(found(k, r) for k, r in enumerate(RULES))
    least = " ".join(f"WHEN '{r.kind}' THEN {max(1, r.least)}" for r in RULES)
    base = ", ".join(f"'{r.kind}'" for r in BASE_RULES)
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE_RULES)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents
), f AS ({every}
), k AS (
  SELECT doc_id, rank, kind, s[1] AS start, kind || ':' || s[1] || ':' || (s[1] + s[2]) AS span FROM f WHERE s[3] >= CASE kind {least} END
), a AS (
  SELECT doc_id, {counts}, string_agg(span, ',' ORDER BY start, rank) FILTER (kind IN ({base})) AS base, string_agg(span, ',' ORDER BY start, rank) AS spans FROM k GROUP BY doc_id
)
SELECT doc_id, {', '.join(f'coalesce(n_{r.kind}, 0) AS n_{r.kind}' for r in BASE_RULES)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (doc_id)
"""


def similar_sql(link: int, more: str) -> str:
    """Components of documents whose sets of 5-word shingles share ``link`` per cent of their union."""
    return rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w
), e AS (
  SELECT doc_id, len(sh) AS n, unnest(sh) AS h FROM s
), links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.h = b.h AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {link} * (a.n + b.n - count(*))
), both_ways AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, y FROM reach JOIN both_ways ON reach.r = x
), least AS (
  SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id
)
SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id{more} FROM s JOIN least USING (doc_id)
"""


def divergence_sql() -> str:
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(text, '') AS t, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents
), w AS (
  SELECT r, lang, source, unnest(regexp_extract_all(translate(t, '{UPPER}', '{LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), k AS (
  SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT r) >= {LEAST_DOCUMENTS}
), v AS (
  SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang
), c AS (
  SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL
), g AS (
  SELECT DISTINCT lang, source FROM d
), t AS (
  SELECT lang, source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL
), p AS (
  SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n, 1 + ({UNIT} * (coalesce(c.n, 0) + {PRIOR})) // (t.total + {PRIOR} * v) AS p,
    1 + ({UNIT} * (k.n + {PRIOR})) // (v.total + {PRIOR} * v) AS q
  FROM t JOIN k ON k.lang = t.lang JOIN v ON v.lang = t.lang LEFT JOIN c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term
), s AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), f AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q
), o AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS k FROM f
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(k AS INT) AS rank FROM o WHERE part = 'pair' OR k <= {TOP}
"""
