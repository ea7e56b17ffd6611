"""SQL for DuckDB of the operators that SQL can express."""

from __future__ import annotations

from lexweave.llm.secret_scan import BASE, RULES
from lexweave.llm.url_filters import RULES as URL_RULES

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _url_parts(url: str) -> str:
    rest = f"CASE WHEN contains({url}, '://') THEN substr({url}, instr({url}, '://') + 3) END"
    host = f"coalesce(translate(regexp_extract({rest}, '^[^/?#]*'), '{UPPER}', '{LOWER}'), '')"
    path = f"coalesce(regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1), '')"
    query = f"regexp_replace(regexp_replace(regexp_extract(regexp_replace({rest}, '(?s)#.*$', ''), '(?s)^[^?]*(\\?.*)$', 1), '([?&])utm_[^&]*(&|$)', '\\1', 'g'), '[?&]$', '')"
    node = f"CASE WHEN contains({url}, '://') THEN {host} || CASE WHEN {path} = '' THEN '/' ELSE {path} END || {query} END"
    return f"{host} AS host, {path} AS path, {node} AS node"


URL_ALIASES = f"""WITH RECURSIVE rules(rh, rp, rv) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)}),
p AS (SELECT page_id, url, html, {_url_parts("url")} FROM pages),
links AS (SELECT node AS u, unnest(regexp_extract_all(html, '(?i)<link[^>]*\\srel="?canonical"?[^>]*>')) AS tag FROM p),
found AS (SELECT u, regexp_extract(tag, '(?i)\\shref="(https?://[^"]*)"', 1) AS url FROM links),
edges AS (SELECT u, node AS v FROM (SELECT u, {_url_parts("url")} FROM found WHERE url <> '') WHERE u IS NOT NULL AND node IS NOT NULL AND u <> node),
ties AS (SELECT u, v FROM edges UNION SELECT v, u FROM edges),
reach AS (SELECT u, v FROM ties UNION SELECT r.u, b.v FROM reach r JOIN ties b ON r.v = b.u),
comp AS (SELECT u AS node, least(u, min(v)) AS component FROM reach GROUP BY u),
places AS (SELECT DISTINCT host, path FROM p UNION SELECT host, path FROM (SELECT {_url_parts("'x://' || c.node")} FROM comp c)),
ruled AS (SELECT host, path, rh || rp AS rule, rv AS verdict, row_number() OVER (PARTITION BY host, path ORDER BY length(rh || rp) DESC, rv) AS n FROM places JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)),
best AS (SELECT * FROM ruled WHERE n = 1),
spread AS (SELECT component, bool_or(coalesce(verdict = 'block', false)) AND NOT bool_or(coalesce(verdict = 'allow', false)) AS spreads FROM (SELECT component, x.* FROM (SELECT component, {_url_parts("'x://' || c.node").replace(" AS node", " AS n2")} FROM comp c) x) LEFT JOIN best USING (host, path) GROUP BY component)
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.verdict, CASE WHEN s.spreads THEN 'block' ELSE 'allow' END) AS verdict, c.component
FROM p LEFT JOIN best b USING (host, path) LEFT JOIN comp c ON c.node = p.node LEFT JOIN spread s ON s.component = c.component"""


def _secret_rows(k: int) -> str:
    r = RULES[k]
    pattern = _quoted(r.pattern)
    found, gaps = f"regexp_extract_all(t, {pattern})", f"regexp_split_to_array(t, {pattern})"
    values = f"regexp_extract_all(t, {pattern}, {r.value_group})"
    return f"""SELECT doc_id, {k} AS rank, '{r.kind}' AS kind, CAST(before AS BIGINT) AS s, CAST(before + length(m) AS BIGINT) AS e FROM (
  SELECT doc_id, m, v, sum(length(g) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) - length(m) AS before FROM (
    SELECT doc_id, unnest({found}) AS m, unnest({values}) AS v, unnest(list_slice({gaps}, 1, len({found}))) AS g, generate_subscripts({found}, 1) AS i FROM d WHERE regexp_matches(t, {pattern})))
  WHERE length(v) >= {r.least}"""


SECRETS = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
x AS ({" UNION ALL ".join(_secret_rows(k) for k in range(len(RULES)))}),
a AS (SELECT doc_id, {", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in BASE)},
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (WHERE rank < {len(BASE)}) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans FROM x GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a ON a.doc_id = d.doc_id"""

JACCARD = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s),
e AS (SELECT doc_id, unnest(s) AS h FROM s),
k AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM e a JOIN e b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM k JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 80 * (a.n + b.n - i)),
ties AS (SELECT x AS u, y AS v FROM l UNION SELECT y, x FROM l),
r AS (SELECT u, v FROM ties UNION SELECT r.u, b.v FROM r JOIN ties b ON r.v = b.u),
c AS (SELECT u, min(v) AS m FROM r GROUP BY u)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, least(n.doc_id, coalesce(m, n.doc_id)) AS component_id FROM n LEFT JOIN c ON c.u = n.doc_id"""

LEXICAL = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
c AS (SELECT rid, doc_id, CAST(len(w) AS BIGINT) AS n FROM d WHERE len(w) > 0),
g AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS nt FROM c),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS t FROM benchmark),
e AS (SELECT rid, t, count(*) AS tf FROM (SELECT rid, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY rid, t),
f AS (SELECT t, count(*) AS df FROM e GROUP BY t),
i AS (SELECT e.rid, c.doc_id, e.t, (1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nd) // nt)) AS impact FROM e JOIN c USING (rid), g),
v AS (SELECT t, CAST(floor(1000 * ln((2.0 * nd + 2) / (2.0 * df + 1))) AS BIGINT) AS weight FROM f, g),
s AS (SELECT item_id, rid, doc_id, CAST(sum(weight * impact) AS BIGINT) AS score FROM q JOIN v USING (t) JOIN i USING (t) GROUP BY item_id, rid, doc_id),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 50"""

NEGATIVES = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM (SELECT anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS n FROM s WHERE same) WHERE n <= 5),
r AS (SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT * FROM r WHERE rank <= 5"""

ORACLE_SQL = {"op2_url_aliases": URL_ALIASES, "op7_secret_ledger": SECRETS, "op10_ngram_jaccard": JACCARD, "op11_vantage_negatives": NEGATIVES, "op12_tiered_search": LEXICAL}
