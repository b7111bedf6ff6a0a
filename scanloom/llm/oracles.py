"""DuckDB statements for the queries that SQL can express."""

LOWER = "translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all({dt}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({bt}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(len(w), 10) AS n, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS win
       FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS win
       FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT DISTINCT doc_id, s, dw.n, item FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS p FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
""".replace("{dt}", LOWER.replace("{t}", "text")).replace("{bt}", LOWER.replace("{t}", "text"))

OP3 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND vec_id IS NOT NULL),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""


def licenses_sql(templates: dict[str, str], shingle: int, percent: int) -> str:
    """Every window of every document against every template, without signatures."""
    rows = ", ".join("('" + name.replace("'", "''") + "', '" + text.replace("'", "''") + "')" for name, text in templates.items())
    return r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all({low}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
t0 AS (SELECT name, regexp_extract_all({low}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM (VALUES {rows}) AS x(name, text)),
t AS (SELECT name, w, len(w) AS l, least({k}, len(w)) AS k, greatest(1, len(w) // 4) AS step FROM t0),
ts AS (SELECT DISTINCT name, l, k, step, array_to_string(w[i:i + k - 1], ' ') AS sh FROM (SELECT *, unnest(generate_series(1, l - k + 1)) AS i FROM t)),
tn AS (SELECT name, count(*) AS n FROM ts GROUP BY name),
ks AS (SELECT DISTINCT k FROM t),
ds AS (SELECT doc_id, k, i - 1 AS pos, array_to_string(w[i:i + k - 1], ' ') AS sh FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, ks WHERE len(w) >= k)),
m AS (SELECT doc_id, name, pos, ts.sh, l, ts.k, step FROM ds JOIN ts ON ds.sh = ts.sh AND ds.k = ts.k),
g AS (SELECT doc_id, name, sh, unnest(generate_series(greatest(0, CAST(ceil((pos - (l + step - 1 - k)) / step) AS BIGINT)), pos // step)) AS win FROM m),
s AS (SELECT doc_id, name, win, count(DISTINCT sh) / max(n) AS share FROM g JOIN tn USING (name) GROUP BY doc_id, name, win),
h AS (SELECT doc_id, name, max(share) AS share FROM s WHERE share * 100 >= {percent} GROUP BY doc_id, name),
f AS (SELECT doc_id, count(*) AS n, string_agg(name, '; ' ORDER BY name) AS names, max(share) AS share FROM h GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_licenses, coalesce(names, '') AS licenses, coalesce(share, 0.0) AS containment FROM d LEFT JOIN f USING (doc_id)
""".replace("{low}", LOWER.replace("{t}", "text")).replace("{rows}", rows).replace("{k}", str(shingle)).replace("{percent}", str(percent))


OP13 = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND vec_id IS NOT NULL AND label IS NOT NULL),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_dot_product(a.e, c.e) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (
  SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM s WHERE same) WHERE r <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""


def url_rules_sql(rules: list, support: float, confidence: float) -> str:
    """Listed rules by a CASE; combinations by listing every subset of the frequent tokens of every labelled URL."""
    fits = lambda r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
    ordered = sorted(rules, key=lambda r: (-len(r.text), -len(r.host), r.text))
    runs = lambda c, m: f"list_transform(list_filter(string_split_regex(lower({c}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''), lambda x: '{m}' || x)"
    return f"""
WITH cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS tail FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(tail, '(?s)^([^/?#]*)([^?#]*)(.*)$', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(tail, '(?s)^([^/?#]*)([^?#]*)(.*)$', 2) AS path, regexp_extract(tail, '(?s)^([^/?#]*)([^?#]*)(.*)$', 3) AS rest FROM cut),
u AS (SELECT page_id, host, path, CASE {' '.join(f"WHEN {fits(r)} THEN '{r.text}'" for r in ordered)} END AS rule,
  CASE {' '.join(f"WHEN {fits(r)} THEN '{r.verdict}'" for r in ordered)} END AS ruled,
  list_sort(list_distinct(list_concat(list_concat({runs('host', 'h:')}, {runs('path', 'p:')}), {runs('rest', 'q:')}))) AS tokens FROM parts),
taught AS (SELECT tokens, ruled AS cls, count(*) AS n FROM u WHERE ruled IS NOT NULL AND len(tokens) > 0 GROUP BY ALL),
least AS (SELECT greatest(ceil({support} * sum(n)), 1) AS least FROM taught),
often AS (SELECT list(token) AS often FROM (SELECT token, sum(n) AS n FROM (SELECT unnest(tokens) AS token, n FROM taught) GROUP BY token), least WHERE n >= least),
sets AS (SELECT f AS tokens, cls, sum(n) AS n FROM (SELECT list_filter(tokens, lambda t: list_contains(often, t)) AS f, cls, n FROM taught, often) GROUP BY ALL),
subsets AS (SELECT list_filter(tokens, lambda t, i: (mask >> (i - 1)) & 1 = 1) AS tokens, cls, n FROM (SELECT *, unnest(generate_series(1, (1 << len(tokens)) - 1)) AS mask FROM sets)),
counted AS (SELECT tokens, cls, sum(n) AS n FROM subsets GROUP BY ALL),
totals AS (SELECT tokens, sum(n) AS total FROM counted GROUP BY tokens),
confident AS (SELECT c.tokens, cls, n, CAST(n AS DOUBLE) / CAST(total AS DOUBLE) AS conf FROM counted c JOIN totals t ON c.tokens = t.tokens, least WHERE n >= least AND CAST(n AS DOUBLE) / CAST(total AS DOUBLE) >= {confidence}),
beaten AS (SELECT DISTINCT a.tokens, a.cls FROM (SELECT tokens, cls, conf, list_filter(tokens, lambda x: x <> t) AS less FROM (SELECT *, unnest(tokens) AS t FROM confident)) a
  JOIN confident b ON a.less = b.tokens AND a.cls = b.cls AND b.conf >= a.conf),
kept AS (SELECT * FROM confident ANTI JOIN beaten USING (tokens, cls)),
asked AS (SELECT DISTINCT tokens FROM u WHERE ruled IS NULL),
best AS (SELECT a.tokens, k.tokens AS mined, k.cls FROM asked a JOIN kept k ON list_has_all(a.tokens, k.tokens)
  QUALIFY row_number() OVER (PARTITION BY a.tokens ORDER BY conf DESC, n DESC, len(k.tokens), k.tokens, k.cls) = 1)
SELECT page_id, host, path, rule, coalesce(ruled, cls, 'allow') AS verdict, array_to_string(CASE WHEN ruled IS NULL THEN mined END, ' ') AS mined
FROM u LEFT JOIN best ON u.tokens = best.tokens AND ruled IS NULL
"""
