"""DuckDB SQL for the operators' queries that SQL can express.

The others (windows of chat turns, template automata, extraction, language models,
tokenizers) are tested against brute force in ``tests/llm``.
"""

from __future__ import annotations

from . import clusters, near_dup, quality, spelling, urls

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _low(column: str) -> str:
    return f"translate(coalesce({column}, ''), '{_UPPER}', '{_LOWER}')"


def _names(terms) -> str:
    return ", ".join(f"'{t}'" for t in terms)


_RULES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in urls.RULES)

_POINTS = ", ".join(f"('{t}', {w})" for t, w in urls.SOFT.items())

URLS = f"""
WITH p AS (
  SELECT row_number() OVER () AS rid, page_id, coalesce(url, '') AS url, {_low("url")} AS low FROM pages
), s AS (
  SELECT *, {_low("regexp_extract(url, '://([^/?#]*)', 1)")} AS host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path,
    regexp_split_to_array(low, '[^a-z0-9]+') AS terms
  FROM p
), r(verdict, rhost, start) AS (VALUES {_RULES}),
fit AS (
  SELECT rid, arg_max(rhost || start, length(rhost || start)) AS rule, arg_max(verdict, length(rhost || start)) AS ruled
  FROM s JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, start) GROUP BY rid
), n AS (
  SELECT s.*, CAST(len(list_filter(terms, lambda x: x IN ({_names(urls.STRICT)}))) AS BIGINT) AS n_strict,
    list_distinct(list_filter(terms, lambda x: x IN ({_names(urls.SOFT)}))) AS hits FROM s
), t(term, points) AS (VALUES {_POINTS}),
k AS (SELECT rid, count(*) AS n_soft, sum(points) AS weight FROM (SELECT rid, unnest(hits) AS term FROM n) JOIN t USING (term) GROUP BY rid)
SELECT page_id, host, path, rule,
  coalesce(ruled, CASE WHEN n_strict > 0 OR (n_soft >= {urls.MIN_SOFT} AND weight >= {urls.MIN_WEIGHT}) THEN 'block' ELSE 'allow' END) AS verdict,
  n_strict, coalesce(n_soft, 0) AS n_soft, CAST(coalesce(weight, 0) AS BIGINT) AS weight
FROM n LEFT JOIN fit USING (rid) LEFT JOIN k USING (rid)
"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array({_low("text")}, '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE [array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)] END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
b AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM b JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= {near_dup.PERCENT} * (x.n + y.n - shared)),
reach AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS low FROM reach GROUP BY a)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id, doc_id <= coalesce(low, doc_id) AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""

DECONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_low("text")}, '[0-9a-z\\x{{80}}-\\x{{10ffff}}]+') AS ws FROM documents),
q AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_low("text")}, '[0-9a-z\\x{{80}}-\\x{{10ffff}}]+') AS ws FROM benchmark),
i AS (SELECT item, least(13, len(ws)) AS m, unnest([array_to_string(ws[k:k + least(13, len(ws)) - 1], ' ') FOR k IN range(1, len(ws) - least(13, len(ws)) + 2)]) AS g FROM q WHERE len(ws) > 0),
x AS (SELECT rid, m, unnest([array_to_string(ws[k:k + m - 1], ' ') FOR k IN range(1, len(ws) - m + 2)]) AS g, unnest(range(1, len(ws) - m + 2)) AS k FROM d, (SELECT DISTINCT m FROM i) WHERE len(ws) >= m),
h AS (SELECT DISTINCT rid, x.m, k, item FROM x JOIN i ON x.m = i.m AND x.g = i.g),
c AS (SELECT rid, count(DISTINCT k + j) AS n_hit FROM h, range(13) r(j) WHERE j < m GROUP BY rid),
t AS (SELECT rid, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS items FROM h GROUP BY rid)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN t USING (rid)
"""

_WHITE = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
_SOLID = lambda c: f"length(translate({c}, {_WHITE}, ''))"
_FAILS = f"""({_SOLID("x")} > 0 AND (
  len(regexp_extract_all(x, '[!%#*$&=~_+-]{{2,}}(?: |$)')) * 10 >= greatest(1, len(regexp_extract_all(x, '[^ \\t\\r\\f]+'))) * 3
  OR (length(x) - length(regexp_replace(x, '[A-Z]', '', 'g')) >= 20 AND length(x) - length(regexp_replace(x, '[A-Z]', '', 'g')) > 2 * (length(x) - length(regexp_replace(x, '[a-z]', '', 'g'))))
  OR len(regexp_extract_all(x, '(?:^| )[|>/·•-](?: |$)')) * 10 >= greatest(1, len(regexp_extract_all(x, '[^ \\t\\r\\f]+'))) * 3
  OR regexp_matches(lower(x), '{"|".join(quality.BOILERPLATE)}')))"""

_TRIM = lambda c: f"trim({c}, {_WHITE})"
_CLOSING = ", ".join("'" + c.replace("'", "''") + "'" for c in quality.CLOSING)
_SHORT = lambda c: f"(length({c}) <= {quality.SHORT} AND {_TRIM(c)} <> '' AND right({_TRIM(c)}, 1) NOT IN ({_CLOSING}))"

QUALITY = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
v AS (SELECT *, list_filter(regexp_split_to_array(t, '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') AS ws, string_split(t, chr(10)) AS ls FROM d),
short AS (SELECT rid, {_TRIM("x")} AS x FROM (SELECT rid, unnest(ls) AS x FROM v) WHERE {_SHORT("x")}),
menu AS (SELECT rid, list(x) AS again FROM (SELECT rid, x FROM short GROUP BY rid, x HAVING count(*) > 1) GROUP BY rid),
w AS (SELECT v.*, coalesce(again, []) AS again FROM v LEFT JOIN menu USING (rid)),
g AS (SELECT rid, unnest([array_to_string(ws[k:k + 2], ' ') FOR k IN range(1, len(ws) - 1)]) AS g, unnest(range(1, len(ws) - 1)) AS k FROM w WHERE len(ws) >= 3),
r AS (SELECT rid, count(DISTINCT k + j) AS n FROM (SELECT rid, k FROM g QUALIFY count(*) OVER (PARTITION BY rid, g) > 1), range(3) q(j) GROUP BY rid),
m AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST({_SOLID("t")} AS BIGINT) AS word_chars,
    CAST(length(t) - length(translate(t, '{quality.SYMBOLS}', '')) AS BIGINT) AS n_symbols,
    CAST(len(list_filter(ls, lambda x: {_SOLID("x")} > 0)) - len(list_distinct(list_filter(ls, lambda x: {_SOLID("x")} > 0))) AS BIGINT) AS n_dup_lines,
    coalesce(r.n, 0) AS n_repeat_words, coalesce(list_sum([{_SOLID("x")} FOR x IN ls IF NOT {_FAILS} AND NOT ({_SHORT("x")} AND list_contains(again, {_TRIM("x")}))]), 0) AS clean_chars
  FROM w LEFT JOIN r USING (rid)
), f AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {int(100 * quality.MAX_REPEAT)} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND clean_chars >= {1 - quality.MAX_LOST} * word_chars AS kept FROM f
"""

SPELLING = f"""
WITH RECURSIVE tab AS (SELECT list(list_reduce(range(8), lambda c, k: xor(c >> 1, (c & 1) * 3988292384), i) ORDER BY i) AS t FROM range(256) r(i)),
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents),
pairs AS (SELECT doc, run, count(*) AS n FROM runs GROUP BY ALL),
hashed AS (
  SELECT run, n, xor(list_reduce([CAST(('0x' || hex(encode(doc || ':' || run))[2 * k + 1:2 * k + 2]) AS BIGINT) FOR k IN range(octet_length(encode(doc || ':' || run)))],
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS h
  FROM pairs, tab
), thin AS (SELECT CASE WHEN h % {spelling.DELETE} = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:length(run)] ELSE run END AS word, n FROM hashed),
words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM thin WHERE length(word) >= {spelling.LENGTH} GROUP BY word HAVING sum(n) >= {spelling.TIMES}),
less AS MATERIALIZED (SELECT word, n, unnest(range(length(word))) AS k, unnest([word[1:k] || word[k + 2:length(word)] FOR k IN range(length(word))]) AS cut FROM words),
near AS (
  SELECT DISTINCT a.word AS a, b.word AS b, b.n AS nb FROM less a JOIN less b ON a.k = b.k AND a.cut = b.cut AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.cut = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.cut = b.word
), best AS (SELECT a, count(*) AS n_near, arg_min(b, (-nb, hex(encode(b)))) AS form, max(nb) AS form_n FROM near GROUP BY a),
formed AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= {spelling.FACTOR} * n THEN form END AS form, CASE WHEN form_n >= {spelling.FACTOR} * n THEN form_n END AS form_n
  FROM words LEFT JOIN best ON a = word
), chain AS (SELECT word, word AS root, form AS more FROM formed UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN formed f ON f.word = c.more)
SELECT f.word, form, root, n, n_near, form_n FROM formed f JOIN chain c ON c.word = f.word AND c.more IS NULL
"""


def _clusters() -> str:
    """The rounds of the clustering, one after another, each by a full comparison."""
    k, size = clusters.K, clusters.SIZE
    parts = [
        f"""e AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, [floor({clusters.SCALE} * CAST(v AS DOUBLE)) FOR v IN embedding] AS x FROM embeddings
  WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda v: v IS NULL OR isnan(v) OR isinf(v))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS j, x AS c FROM (SELECT sha256('{clusters.SEED}:' || vec_id) AS h, x FROM e WHERE vec_id IS NOT NULL ORDER BY h, x LIMIT {k}))",
    ]
    for r in range(clusters.ROUNDS + 1):
        parts.append(
            f"""a{r} AS MATERIALIZED (SELECT rid, min((d, j)) AS best FROM (
  SELECT rid, j, list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c) AS d FROM e, c{r}) GROUP BY rid)"""
        )
        if r < clusters.ROUNDS:
            parts.append(
                f"""s{r} AS (SELECT j, k, floor(sum(v) / count(*)) AS m FROM (SELECT best[2] AS j, unnest(x) AS v, unnest(range({size})) AS k FROM a{r} JOIN e USING (rid)) GROUP BY j, k),
c{r + 1} AS MATERIALIZED (SELECT j, coalesce(m, c) AS c FROM c{r} LEFT JOIN (SELECT j, list(m ORDER BY k) AS m FROM s{r} GROUP BY j) USING (j))"""
            )
    last = clusters.ROUNDS
    return (
        "WITH "
        + ",\n".join(parts)
        + f"""
SELECT vec_id, CAST(j AS INTEGER) AS cluster, CAST(best[1] AS BIGINT) AS distance, CAST(sum(best[1]) OVER (PARTITION BY j) AS BIGINT) AS cluster_inertia,
  CAST(sum(best[1]) OVER () AS BIGINT) AS inertia, sha256(array_to_string([CAST(v AS BIGINT) FOR v IN c], ',')) AS centroid_sha256
FROM a{last} JOIN e USING (rid) JOIN c{last} ON j = best[2]"""
    )


CLUSTERS = _clusters()

ORACLES = {
    "op2_url_filter": URLS, "op4_near_duplicates": NEAR_DUPLICATES, "op8_decontamination": DECONTAMINATION, "op9_quality_rules": QUALITY,
    "op11_spelling_variants": SPELLING, "op12_centroid_clusters": CLUSTERS,
}
