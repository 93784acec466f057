"""SQL that gives the rows of the queries that SQL can express, by plain means: all windows, all pairs, all n-grams."""

from __future__ import annotations

from . import quality as Q

WORD = r"[^\x20\x09-\x0D]+"

CHAT = r"""WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
m AS (SELECT *, 4 + length(role) + length(regexp_replace(role, '[^\\#<:]', '', 'g')) + 2 + length(text) + length(regexp_replace(text, '[^\\#<]', '', 'g')) + 8 AS chars FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM m GROUP BY conv_id"""

_WORDS = rf"""d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
w AS (SELECT doc_id, unnest(range(len(ws))) AS i, unnest(ws) AS word, len(ws) AS n FROM d)"""

SUBSTRING = rf"""WITH {_WORDS},
h AS (SELECT *, CASE WHEN i + 50 <= n THEN md5(string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)) END AS win FROM w),
f AS (SELECT win, min(doc_id) AS first FROM h WHERE win IS NOT NULL GROUP BY win),
c AS (SELECT h.*, max(CASE WHEN f.first < h.doc_id THEN 1 ELSE 0 END) OVER (PARTITION BY h.doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM h LEFT JOIN f USING (win)),
k AS (SELECT doc_id, CAST(sum(gone) AS BIGINT) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM c GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""

_REACH = """r AS (SELECT id, id AS other FROM n UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.other),
c AS (SELECT id, min(other) AS component_id FROM r GROUP BY id)"""

EMBEDDINGS = f"""WITH RECURSIVE v AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
n AS (SELECT id FROM v),
l AS (SELECT p.id AS a, q.id AS b FROM v p JOIN v q ON p.label = q.label AND p.id <> q.id WHERE list_cosine_similarity(p.x, q.x) >= 0.98),
{_REACH}
SELECT id AS vec_id, (SELECT count(*) FROM l WHERE a = c.id) AS n_links, component_id, component_id = id AS kept FROM c"""

JACCARD = f"""WITH RECURSIVE {_WORDS},
s AS (SELECT DISTINCT doc_id, md5(CASE WHEN n < 5 THEN string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
  ELSE string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) END) AS g FROM w WHERE TRUE QUALIFY n < 5 OR i + 5 <= n),
z AS (SELECT doc_id, count(*) AS k FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b, p.k = za.k AND p.k = zb.k AS same FROM p JOIN z za ON za.doc_id = a JOIN z zb ON zb.doc_id = b WHERE 10 * p.k >= 8 * (za.k + zb.k - p.k)),
n AS (SELECT doc_id AS id FROM documents),
{_REACH}
SELECT id AS doc_id, least(id, (SELECT min(b) FROM l WHERE a = c.id AND same)) AS class_id, (SELECT count(*) FROM l WHERE a = c.id) AS n_links, component_id, component_id = id AS kept FROM c"""

BACKOFF = f"""WITH {_WORDS},
g AS (SELECT *, lag(word) OVER o AS p1, lag(word, 2) OVER o AS p2 FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT *, count(*) OVER (PARTITION BY word) - count(*) OVER (PARTITION BY doc_id, word) AS c1,
  count(*) OVER (PARTITION BY p1, word) - count(*) OVER (PARTITION BY doc_id, p1, word) AS c2,
  count(*) OVER (PARTITION BY p2, p1, word) - count(*) OVER (PARTITION BY doc_id, p2, p1, word) AS c3, count(*) OVER () - n AS others FROM g),
b AS (SELECT *, lag(c1) OVER o AS b2, lag(c2) OVER o AS b3 FROM c WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT doc_id, sum(CASE WHEN p2 IS NOT NULL AND c3 > 0 THEN ln(c3 / b3) WHEN p1 IS NOT NULL AND c2 > 0 THEN ln(c2 / b2) + ln(0.4)
  WHEN c1 > 0 THEN ln(c1 / others) + 2 * ln(0.4) ELSE ln(1 / (others + 1)) + 2 * ln(0.4) END) AS total FROM b GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, round(coalesce(total, 0), 6) AS log_score, round(total / nullif(len(ws), 0), 6) AS mean_log_score FROM d LEFT JOIN s USING (doc_id)"""


_FOLDED = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
LEAKS = rf"""WITH d AS (SELECT doc_id, {_FOLDED} AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_FOLDED} AS ws FROM benchmark),
p AS (SELECT DISTINCT item_id, least(10, len(ws)) AS k, array_to_string(ws[i : i + least(10, len(ws)) - 1], ' ') AS win FROM b, unnest(range(1, greatest(2, len(ws) - 8))) r(i) WHERE len(ws) > 0),
g AS (SELECT DISTINCT k, win FROM p),
x AS (SELECT doc_id, i, k, array_to_string(ws[i : i + k - 1], ' ') AS win FROM d, (SELECT DISTINCT k FROM g), unnest(range(1, len(ws) - k + 2)) r(i)),
h AS (SELECT doc_id, i, k, win FROM x JOIN g USING (k, win)),
c AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM h, unnest(range(k)) r(j) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM h JOIN p USING (k, win)) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)"""


def _cholesky(p: int, columns: str, rows: str) -> str:
    """rows (columns and c_i_j) with p_i_j, the inverse of c_i_j, and logdet. A query for each column of the factor, as
    DuckDB writes an alias that is used in its own select list out in full."""
    query = rows
    for j in range(p):
        diagonal = " - ".join([f"c_{j}_{j}", *[f"l_{j}_{k} * l_{j}_{k}" for k in range(j)]])
        query = f"SELECT *, sqrt(greatest({diagonal}, 1e-12)) AS l_{j}_{j} FROM ({query})"
        lower = [f"({' - '.join([f'c_{i}_{j}', *[f'l_{i}_{k} * l_{j}_{k}' for k in range(j)]])}) / l_{j}_{j} AS l_{i}_{j}" for i in range(j + 1, p)]
        query = f"SELECT *, {', '.join(lower)} FROM ({query})" if lower else query
    for i in range(p):
        row = [f"({' - '.join([str(float(i == j)), *[f'l_{i}_{k} * v_{k}_{j}' for k in range(j, i)]])}) / l_{i}_{i} AS v_{i}_{j}" for j in range(i + 1)]
        query = f"SELECT *, {', '.join(row)} FROM ({query})"
    inverse = [f"{' + '.join(f'v_{k}_{i} * v_{k}_{j}' for k in range(i, p))} AS p_{i}_{j}" for i in range(p) for j in range(i + 1)]
    return f"SELECT {columns}, {', '.join(inverse)}, 2 * ({' + '.join(f'ln(l_{i}_{i})' for i in range(p))}) AS logdet FROM ({query})"


def quality_sql() -> str:
    """The statistics, and the estimates with all their steps written out."""
    p, floors = len(Q.FEATURES), [f for _, f in Q.FEATURES]
    pairs = [(i, j) for i in range(p) for j in range(i + 1)]
    key, each = "level, lang, source", lambda f: ", ".join(f(i) for i in range(p))
    both = lambda f: ", ".join(f(i, j) for i, j in pairs)
    names = f"{each(lambda i: f'm{i}')}, {both(lambda i, j: f'c_{i}_{j}')}"
    model = f"{names}, {both(lambda i, j: f'p_{i}_{j}')}, logdet"
    bin_of = lambda x: f"CAST(floor(ln({x} + {Q.FLOOR}) * {Q.BINS}) AS BIGINT)"

    def quantile(rows: str, by: str, value: str, share: float) -> str:
        counts = f"SELECT {by}, {bin_of(value)} AS b, count(*) AS n FROM {rows} GROUP BY ALL"
        upto = f"SELECT *, sum(n) OVER (PARTITION BY {by} ORDER BY b) AS upto, sum(n) OVER (PARTITION BY {by}) AS total FROM ({counts})"
        return f"SELECT {by}, exp((min(b) + 1) / {Q.BINS}.0) - {Q.FLOOR} AS q FROM ({upto}) WHERE upto >= ceil(total * {share}) GROUP BY ALL"

    distance = lambda x, m: " + ".join(f"{1 if i == j else 2} * p_{i}_{j} * ({x}{i} - {m}{i}) * ({x}{j} - {m}{j})" for i, j in pairs)
    corr = lambda k, i, j: f"CASE WHEN r{k}_{i}_{i} * r{k}_{j}_{j} > 0 THEN 0.9 * r{k}_{i}_{j} / sqrt(r{k}_{i}_{i} * r{k}_{j}_{j}) ELSE 0 END" if i != j else "1.0"
    factor = Q.SUBSET / Q.gamma_p(p / 2 + 1, Q.chi_square_quantile(Q.SUBSET, p) / 2)
    parts = [
        "d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents)",
        rf"b AS (SELECT *, regexp_extract_all(text, '{WORD}') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d)",
        "h AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 7], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 6, 1))) AS i FROM b))",
        "r AS (SELECT doc_id, i FROM h QUALIFY count(*) OVER (PARTITION BY doc_id, h) > 1)",
        "k AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, range(8) t(k) GROUP BY doc_id)",
        r"""s AS MATERIALIZED (SELECT doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, len(ls) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, greatest(n_words, 1) AS w, ln(1 + n_words) AS x0, ln(1 + word_chars / w) AS x1, sqrt(n_symbols / w) AS x2,
  sqrt(n_dup_lines / greatest(n_lines, 1)) AS x3, sqrt(n_repeat_words / w) AS x4 FROM b LEFT JOIN k USING (doc_id))""",
        f"v AS MATERIALIZED (SELECT level, CASE WHEN level < 2 THEN lang ELSE '' END AS lang, CASE WHEN level < 1 THEN source ELSE '' END AS source, {each(lambda i: f'x{i}')} FROM s, range(3) t(level) WHERE NOT base_failed)",
        f"x AS ({' UNION ALL '.join(f'SELECT {key}, {i} AS j, x{i} AS x FROM v' for i in range(p))})",
        f"q AS MATERIALIZED ({quantile('x', f'{key}, j', 'x', 0.5)})",
        f"g AS MATERIALIZED ({quantile(f'(SELECT {key}, j, abs(x - q) AS x FROM x JOIN q USING ({key}, j))', f'{key}, j', 'x', 0.5)})",
        f"c AS MATERIALIZED (SELECT {key}, {each(lambda i: f'max(q.q) FILTER (j = {i}) AS m{i}')}, {each(lambda i: f'max(greatest(g.q * 1.4826, {floors[i]})) FILTER (j = {i}) AS s{i}')} FROM q JOIN g USING ({key}, j) GROUP BY ALL)",
        f"z AS (SELECT {key}, {each(lambda i: f'(x{i} - m{i}) / s{i} AS z{i}')}, greatest(sqrt({' + '.join(f'z{i} * z{i}' for i in range(p))}), {Q.FLOOR}) AS len FROM v JOIN c USING ({key}))",
        f"t AS (SELECT {key}, {both(lambda i, j: f'avg(z{i} / len * z{j} / len) AS r1_{i}_{j}, avg(tanh(z{i}) * tanh(z{j})) AS r2_{i}_{j}')} FROM z GROUP BY ALL)",
        f"a AS (SELECT {key}, st, {each(lambda i: f'm{i}')}, {both(lambda i, j: f'(CASE st WHEN 0 THEN {float(i == j)} WHEN 1 THEN {corr(1, i, j)} ELSE {corr(2, i, j)} END) * s{i} * s{j} AS c_{i}_{j}')} FROM c JOIN t USING ({key}), range(3) u(st))",
        f"m0 AS MATERIALIZED ({_cholesky(p, f'{key}, st, 0 AS n, {names}', 'SELECT * FROM a')})",
    ]
    for t in range(Q.STEPS):
        parts += [
            f"d{t} AS (SELECT {key}, st, {bin_of(f'({distance(chr(120), chr(109))})')} AS b, {each(lambda i: f'x{i} - m{i} AS g{i}')} FROM v JOIN m{t} USING ({key}))",
            f"b{t} AS MATERIALIZED (SELECT {key}, st, b, count(*) AS n, {each(lambda i: f'sum(g{i}) AS a{i}')}, {both(lambda i, j: f'sum(g{i} * g{j}) AS s_{i}_{j}')} FROM d{t} GROUP BY ALL)",
            f"r{t} AS (SELECT {key}, st, min(b) AS last, max(total) AS total FROM (SELECT *, sum(n) OVER (PARTITION BY {key}, st ORDER BY b) AS upto, sum(n) OVER (PARTITION BY {key}, st) AS total FROM b{t}) WHERE upto >= ceil(total * {Q.SUBSET}) GROUP BY ALL)",
            f"n{t} AS (SELECT {key}, st, max(total) AS n, {each(lambda i: f'sum(a{i}) / sum(n) AS e{i}')}, {both(lambda i, j: f'sum(s_{i}_{j}) / sum(n) AS f_{i}_{j}')} FROM b{t} JOIN r{t} USING ({key}, st) WHERE b <= last GROUP BY ALL)",
            f"o{t} AS (SELECT {key}, st, n{t}.n AS n, {each(lambda i: f'm{i} + e{i} AS m{i}')}, {both(lambda i, j: f'{factor} * (f_{i}_{j} - e{i} * e{j}) + {floors[i] ** 2 if i == j else 0.0} AS c_{i}_{j}')} FROM n{t} JOIN m{t} USING ({key}, st))",
            f"m{t + 1} AS MATERIALIZED ({_cholesky(p, f'{key}, st, n, {names}', f'SELECT * FROM o{t}')})",
        ]
    mix = lambda c: f"(coalesce(g.n, 0) * coalesce(g.{c}, 0) + {Q.HALF_WEIGHT} * ((coalesce(l.n, 0) * coalesce(l.{c}, 0) + {Q.HALF_WEIGHT} * e.{c}) / (coalesce(l.n, 0) + {Q.HALF_WEIGHT}))) / (coalesce(g.n, 0) + {Q.HALF_WEIGHT}) AS {c}"
    parts += [
        f"best AS MATERIALIZED (SELECT {key}, n, {model} FROM m{Q.STEPS} QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY round(logdet, 6), st) = 1)",
        f"y AS (SELECT u.lang, u.source, {each(lambda i: mix(f'm{i}'))}, {both(lambda i, j: mix(f'c_{i}_{j}'))} FROM (SELECT DISTINCT lang, source FROM s) u LEFT JOIN best g ON g.level = 0 AND g.lang = u.lang AND g.source = u.source LEFT JOIN best l ON l.level = 1 AND l.lang = u.lang LEFT JOIN best e ON e.level = 2)",
        f"j AS MATERIALIZED ({_cholesky(p, 'lang, source, ' + each(lambda i: f'm{i}'), 'SELECT * FROM y')})",
    ]
    return f"""WITH {", ".join(parts)}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce({distance("x", "m")} > {Q.CUT}, false) AS kept FROM s LEFT JOIN j USING (lang, source)"""
