"""DuckDB twins of the training-data queries that SQL expresses over whole tables."""

from __future__ import annotations

import re

from . import secrets_scan, urlgraph

#: Bytes covered by a 50-byte string that also starts in a document of smaller doc_id.
SUFFIX = """WITH d AS MATERIALIZED (SELECT doc_id, encode(coalesce(text, '')) AS t FROM documents),
w AS MATERIALIZED (SELECT doc_id, i, t[i:i + 49] AS s FROM (SELECT doc_id, t, unnest(range(1, octet_length(t) - 48)) AS i FROM d)),
first AS (SELECT s, min(doc_id) AS doc FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT w.doc_id, w.i FROM w JOIN first USING (s) WHERE first.doc < w.doc_id),
gap AS (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS fresh FROM hit),
run AS (SELECT doc_id, g, min(i) AS a, max(i) + 49 AS z FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM gap) GROUP BY 1, 2),
cut AS (SELECT *, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM run),
kept AS (SELECT doc_id, sum(z - a + 1) AS n_removed, count(*) AS n_spans, string_agg(hex(t[before + 1:a - 1]), '' ORDER BY a) AS h, max(z) AS z FROM cut JOIN d USING (doc_id) GROUP BY 1)
SELECT d.doc_id, octet_length(t) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
sha256(unhex(coalesce(h || hex(t[z + 1:octet_length(t)]), hex(t)))) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

#: All pairs of a label, then what links reach.
EMBEDDINGS = """WITH RECURSIVE v AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS r, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
f AS MATERIALIZED (SELECT *, list_transform(x, lambda y: coalesce(y, 0.0)) AS e, len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) AS n_bad FROM v),
good AS MATERIALIZED (SELECT *, sqrt(list_dot_product(e, e)) AS n FROM f WHERE label IS NOT NULL AND len(e) > 0 AND n_bad = 0 AND list_dot_product(e, e) > 0),
link AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e)
  AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.93),
reach AS (SELECT a AS vec_id, b AS other FROM link UNION SELECT reach.vec_id, link.b FROM reach JOIN link ON reach.other = link.a),
low AS (SELECT vec_id, min(other) AS other FROM reach GROUP BY 1), n AS (SELECT a AS vec_id, count(*) AS n FROM link GROUP BY 1)
SELECT v.vec_id, coalesce(n, 0) AS n_links, least(v.vec_id, coalesce(low.other, v.vec_id)) AS component_id, least(v.vec_id, coalesce(low.other, v.vec_id)) = v.vec_id AS kept
FROM v LEFT JOIN low USING (vec_id) LEFT JOIN n USING (vec_id)"""


#: CRC-32 of a list of bytes ``b``, with the table ``tab`` made from its polynomial.
CRC_TABLE = "tab AS MATERIALIZED (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: xor(a >> 1, 3988292384 * (a & 1))) ORDER BY i) AS tab FROM range(256) r(i))"
CRC = "xor(list_reduce(list_concat([4294967295], {b}), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295)"
DIGITS = "list_transform(range(1, length({s}) + 1), lambda i: CAST(ascii({s}[i]) AS BIGINT))"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Nodes are whole prefixes; each node's sums go to all that begin its smallest member.
TRIE = f"""WITH {CRC_TABLE},
ids AS (SELECT c, CAST(c AS VARCHAR) AS s FROM (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL)),
convs AS MATERIALIZED (SELECT c, c - c % 5 AS b, {CRC.format(b=DIGITS.format(s="s"))} % 9 AS h FROM ids, tab),
t AS MATERIALIZED (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
r AS (SELECT c, 0 AS part, k, role, text FROM convs JOIN t ON t.conv_id = b WHERE k <= h UNION ALL SELECT c, 1, k, role, text FROM convs JOIN t ON t.conv_id = c WHERE k > h),
o AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, k) AS d, role, text FROM r),
p AS MATERIALIZED (SELECT c, d, text, list([role, text]) OVER (PARTITION BY c ORDER BY d) AS key FROM o UNION ALL SELECT c, 0, '', CAST([] AS VARCHAR[][]) FROM convs),
n AS MATERIALIZED (SELECT key, d, min(c) AS c, count(*) AS n_convs, any_value(text) AS text FROM p GROUP BY 1, 2),
m AS MATERIALIZED (SELECT p.c, p.d, n.c AS rep, p.d = max(p.d) OVER (PARTITION BY p.c) AS last FROM p JOIN n USING (key, d)),
kids AS (SELECT m.rep AS c, m.d, count(*) AS n_children FROM n JOIN m ON m.c = n.c AND m.d = n.d - 1 GROUP BY 1, 2),
own AS MATERIALIZED (SELECT n.c, n.d, n_convs, coalesce(n_children, 0) AS n_children, (n_convs - 1) * octet_length(encode(text)) AS saved FROM n LEFT JOIN kids USING (c, d)),
up AS (SELECT m.rep AS c, m.d, sum(saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM own JOIN m ON m.c = own.c AND m.d <= own.d GROUP BY 1, 2),
ends AS (SELECT rep AS c, d, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids FROM m WHERE last GROUP BY 1, 2)
SELECT own.c AS conv_id, own.d AS depth, m.rep AS parent_conv_id, n_convs, n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM own JOIN up USING (c, d) LEFT JOIN ends USING (c, d) LEFT JOIN m ON m.c = own.c AND m.d = own.d - 1"""

#: Pairs by the strings that deletions leave; forms are followed to the last.
SPELLING = f"""WITH RECURSIVE {CRC_TABLE},
runs AS (SELECT doc_id, unnest(regexp_extract_all({LOWER.format("text")}, '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents),
each AS MATERIALIZED (SELECT doc_id, run, count(*) AS k, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM runs GROUP BY 1, 2),
h AS (SELECT run, k, {CRC.format(b="list_transform(range(1, length(x), 2), lambda i: CAST('0x' || x[i:i + 1] AS BIGINT))")} AS h FROM each, tab),
n AS MATERIALIZED (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:length(run)] ELSE run END AS word, k FROM h) GROUP BY 1 HAVING sum(k) >= 3 AND length(word) >= 5),
cut AS MATERIALIZED (SELECT word, n, i, word[1:i - 1] || word[i + 1:length(word)] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM n)),
pair AS MATERIALIZED (SELECT a.word, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT cut.word, n.word, n.n FROM cut JOIN n ON n.word = rest UNION SELECT n.word, cut.word, cut.n FROM cut JOIN n ON n.word = rest),
near AS (SELECT word, count(*) AS n_near, min([lpad(CAST(9000000000000000000 - m AS VARCHAR), 19, '0'), other]) AS best FROM pair GROUP BY 1),
form AS MATERIALIZED (SELECT n.word, n.n, coalesce(n_near, 0) AS n_near, CASE WHEN 9000000000000000000 - CAST(best[1] AS BIGINT) >= 2 * n THEN best[2] END AS form, 9000000000000000000 - CAST(best[1] AS BIGINT) AS form_n FROM n LEFT JOIN near USING (word)),
walk AS (SELECT word, word AS reached FROM form UNION ALL SELECT walk.word, form.form FROM walk JOIN form ON form.word = reached WHERE form.form IS NOT NULL)
SELECT form.word, form.form, walk.reached AS root, form.n, form.n_near, CASE WHEN form.form IS NOT NULL THEN form.form_n END AS form_n FROM form JOIN walk USING (word) JOIN form last ON last.word = reached AND last.form IS NULL"""

#: Windows of each size in use, equal as strings.
LEAKS = f"""WITH b AS (SELECT item_id, regexp_extract_all({LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
i AS MATERIALIZED (SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[k:k + least(10, len(w)) - 1], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM b WHERE len(w) > 0)),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all({LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
p AS (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM d, (SELECT DISTINCT size FROM i) WHERE len(w) >= size),
h AS MATERIALIZED (SELECT r, p.size, k, item_id FROM p JOIN i ON i.size = p.size AND i.s = array_to_string(w[k:k + p.size - 1], ' ')),
hit AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(k, k + size)) AS x FROM (SELECT DISTINCT r, size, k FROM h)) GROUP BY 1),
ids AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM h WHERE item_id IS NOT NULL) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN hit USING (r) LEFT JOIN ids USING (r)"""


#: The rules that op4's SQL was registered with. The SQL stays as it is; the contract, and with it
#: urlgraph.RULES, allow net/de/, so the two differ there and in what follows from those seeds.
URL_RULES = [("block", *r[1:]) if r[1:] == ("net", "/de/") else r for r in urlgraph.RULES]


def urls(rules=URL_RULES, rounds: int = urlgraph.ROUNDS) -> str:
    """Rules, then the rounds of both scores written out one after another."""
    order = sorted(rules, key=lambda r: len(r[1]) + len(r[2]))[::-1]
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, k) for k, h, p in order]
    rule, ruled = (" ".join(f"WHEN {f[0]} THEN '{f[i]}'" for f in fits) for i in (1, 2))
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    bare = "regexp_replace(regexp_replace({}, '^.*@', ''), ':[0-9]*$', '')"
    link = urlgraph.ABSOLUTE.replace("'", "''")
    a, half = urlgraph.DAMPING, urlgraph.THRESHOLD
    steps = []
    for r in range(1, rounds + 1):
        steps.append(f"""g{r} AS MATERIALIZED (SELECT flow.kind, flow.dst AS host, sum(s.score * flow.part) AS got FROM flow JOIN s{r - 1} s ON s.kind = flow.kind AND s.host = flow.src GROUP BY 1, 2),
k{r} AS (SELECT kind, sum(got) AS moved FROM g{r} GROUP BY 1),
s{r} AS MATERIALIZED (SELECT kind, host, round(sum(got), 12) AS score FROM (SELECT kind, host, seed * (1 - {a} * coalesce(moved, 0)) AS got FROM seeds LEFT JOIN k{r} USING (kind)
  UNION ALL SELECT kind, host, got * {a} FROM g{r}) GROUP BY 1, 2)""")
    return f"""WITH u AS (SELECT page_id, html, {lower.format("regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)")} AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
p AS MATERIALIZED (SELECT *, {bare.format("host")} AS site, CASE {rule} END AS rule, CASE {ruled} END AS ruled FROM u),
l AS (SELECT site AS src, unnest(list_distinct(list_transform(regexp_extract_all(coalesce(html, ''), '{link}', 1), lambda h: {bare.format(lower.format("h"))}))) AS dst FROM p),
links AS MATERIALIZED (SELECT src, dst, count(*) AS weight FROM l WHERE src <> '' AND dst <> '' AND dst <> src GROUP BY 1, 2),
e AS (SELECT 'trust' AS kind, src, dst, weight FROM links UNION ALL SELECT 'distrust', dst, src, weight FROM links),
flow AS MATERIALIZED (SELECT kind, src, dst, weight / sum(weight) OVER (PARTITION BY kind, src) AS part FROM e),
h AS (SELECT site AS host, count(*) FILTER (ruled = 'allow') / count(*) AS allow, count(*) FILTER (ruled = 'block') / count(*) AS block FROM p WHERE site <> '' GROUP BY 1),
share AS (SELECT 'trust' AS kind, host, allow AS share FROM h WHERE allow >= {urlgraph.SEED_SHARE} UNION ALL SELECT 'distrust', host, block FROM h WHERE block >= {urlgraph.SEED_SHARE}),
seeds AS MATERIALIZED (SELECT kind, host, share / sum(share) OVER (PARTITION BY kind) AS seed FROM share),
s0 AS (SELECT kind, host, seed AS score FROM seeds),
{", ".join(steps)},
b AS (SELECT host, coalesce(sum(score) FILTER (kind = 'trust'), 0) AS trust, coalesce(sum(score) FILTER (kind = 'distrust'), 0) AS distrust FROM s{rounds} GROUP BY 1)
SELECT page_id, p.host, path, rule, coalesce(ruled, CASE WHEN distrust > {half} * (trust + distrust) THEN 'block' ELSE 'allow' END) AS verdict,
coalesce(trust, 0) AS trust, coalesce(distrust, 0) AS distrust FROM p LEFT JOIN b ON b.host = p.site"""


def secrets() -> str:
    """Places of matches are running lengths of what stands between them and of themselves."""
    quoted = lambda p: p.replace("'", "''")
    # RE2 folds two letters beyond ASCII into k and s, so both cases are written out.
    folded = re.sub(r"\(\?i:(.*?)\)\)", lambda m: re.sub("[a-z]", lambda x: f"[{x[0]}{x[0].upper()}]", m[1]) + ")", secrets_scan.BASE["assign"][0])
    patterns = [(folded, 2, secrets_scan.BASE["assign"][2]), *list(secrets_scan.BASE.values())[1:], (f"[{secrets_scan.RUN}]{{{secrets_scan.WINDOW},}}", 0, 0)]
    found = " UNION ALL ".join(f"SELECT r, {k} AS kind, {least} AS least, string_split_regex(t, '{quoted(p)}') AS g, regexp_extract_all(t, '{quoted(p)}', 0) AS w, regexp_extract_all(t, '{quoted(p)}', {group}) AS v FROM t" for k, (p, group, least) in enumerate(patterns))
    allowed = " OR ".join(f"regexp_matches(w, '{quoted(p)}')" for p in secrets_scan.ALLOWED)
    n, bits = secrets_scan.WINDOW, secrets_scan.LEAST_BITS
    names = " ".join(f"WHEN {k} THEN '{kind}'" for k, kind in enumerate(secrets_scan.KINDS))
    written = f"CASE kind {names} END || ':' || a || ':' || z"
    counts = ", ".join(f"count(*) FILTER (kind = {k}) AS n_{kind}" for k, kind in enumerate(secrets_scan.BASE))
    return f"""WITH t AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({found}),
e AS (SELECT r, kind, least, unnest(range(len(w))) AS i, unnest(w) AS w, unnest(v) AS v, unnest(g[1:len(w)]) AS g FROM m),
p AS MATERIALIZED (SELECT r, kind, least, w, v, CAST(sum(length(g) + length(w)) OVER (PARTITION BY r, kind ORDER BY i) AS BIGINT) AS z FROM e),
base AS (SELECT r, kind, z - length(w) AS a, z FROM p WHERE kind < {len(patterns) - 1} AND length(v) >= least),
c AS (SELECT r, z - length(w) AS a, w, CASE WHEN regexp_full_match(w, '[0-9A-Fa-f]+') THEN {bits["hex"]} ELSE {bits["word"]} END AS bits FROM p
  WHERE kind = {len(patterns) - 1} AND regexp_matches(w, '[0-9]') AND regexp_matches(w, '[A-Za-z]') AND NOT ({allowed})),
h AS (SELECT r, a, bits, i, list_entropy(string_split(w[i + 1:i + {n}], '')) AS x FROM (SELECT *, unnest(range(length(w) - {n - 1})) AS i FROM c)),
s AS (SELECT r, a + min(i) AS a, a + max(i) + {n} AS z FROM h WHERE round(x, 9) >= bits GROUP BY r, h.a),
every AS (SELECT * FROM base UNION ALL SELECT r, {len(patterns) - 1}, a, z FROM s WHERE NOT EXISTS (FROM base b WHERE b.r = s.r AND b.a <= s.a AND s.z <= b.z)),
o AS (SELECT r, {counts}, string_agg({written}, ',' ORDER BY a, kind, z) FILTER (kind < {len(patterns) - 1}) AS base, string_agg({written}, ',' ORDER BY a, kind, z) AS spans FROM every GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in secrets_scan.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN o USING (r)"""


def oracle_sql() -> dict[str, str]:
    return {"op8_secret_scans": secrets(), "op4_url_filters": urls(), "op7_suffix_array_dedup": SUFFIX, "op10_embedding_near_dedup": EMBEDDINGS, "op11_conversation_trie": TRIE, "op12_spelling_variants": SPELLING, "op13_decontamination": LEAKS}
