"""DuckDB SQL for the training-data queries that SQL can express on whole tables."""

OP5 = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 20 = 0
),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 20
"""

#: Reachability of links (u, v both ways) over nodes (id).
_REACHED = """
reached(id, c) AS (SELECT id, id FROM nodes UNION SELECT l.v, r.c FROM reached r JOIN links l ON l.u = r.id)
"""

OP6 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS sh
  FROM w
),
n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n FROM s),
e AS (SELECT doc_id, unnest(sh) AS x FROM s),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT u, v FROM p JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * k >= 75 * (a.n + b.n - k)),
links AS (SELECT u, v FROM l UNION SELECT v, u FROM l),
nodes AS (SELECT DISTINCT doc_id AS id FROM n),
{_REACHED}
SELECT n.doc_id, n.n AS n_shingles, r.c AS component_id FROM n JOIN (SELECT id, min(c) AS c FROM reached GROUP BY id) r ON r.id = n.doc_id
"""

OP7 = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding) AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
l AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.98
),
links AS (SELECT DISTINCT u, v FROM l),
nodes AS (SELECT DISTINCT vec_id AS id FROM embeddings),
{_REACHED},
k AS (SELECT u, count(*) AS n FROM l GROUP BY u)
SELECT e.vec_id, coalesce(k.n, 0) AS n_links, r.c AS component_id, e.vec_id = r.c AS kept
FROM embeddings e JOIN (SELECT id, min(c) AS c FROM reached GROUP BY id) r ON r.id = e.vec_id LEFT JOIN k ON k.u = e.vec_id
"""

#: Sizes, targets, inclusion and rank of op8's documents.
_MIX = r"""
d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS src, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents
),
x AS (SELECT *, row_number() OVER (PARTITION BY doc_id, src, size) - 1 AS nth FROM d),
s0 AS (
  SELECT src, source_size, CAST([1, 2, 3][CAST((row_number() OVER (ORDER BY src) - 1) % 3 + 1 AS INTEGER)] AS DOUBLE) AS w, CAST(source_size AS DOUBLE) * 3.0 AS c
  FROM (SELECT src, CAST(sum(size) AS BIGINT) AS source_size FROM x GROUP BY src)
),
s1 AS (
  SELECT *, sum(CAST(source_size AS DOUBLE)) OVER () AS total, sum(w) OVER (ORDER BY c / w, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_rest,
    coalesce(sum(c) OVER (ORDER BY c / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c_before
  FROM s0
),
s2 AS (SELECT *, c * w_rest <= w * (total - c_before) AS capped FROM s1),
s3 AS (SELECT *, sum(CASE WHEN capped THEN c ELSE 0 END) OVER () AS c_all, sum(CASE WHEN capped THEN 0 ELSE w END) OVER () AS w_free FROM s2),
s4 AS (SELECT src, source_size, CASE WHEN capped THEN c ELSE (total - c_all) * w / w_free END AS target FROM s3),
s AS (
  SELECT *, target - certain * CAST(source_size AS DOUBLE) AS room
  FROM (SELECT *, CAST(floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END) AS BIGINT) AS certain FROM s4)
),
h AS (SELECT src, room, size, count(*) AS k FROM x JOIN s USING (src) WHERE size > 0 AND size <= room GROUP BY ALL),
h1 AS (
  SELECT src, size, (room - coalesce(sum(CAST(size * k AS DOUBLE)) OVER (PARTITION BY src ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(pow(size, 0.5) * CAST(size * k AS DOUBLE)) OVER (PARTITION BY src ORDER BY size DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS scale
  FROM h
),
h2 AS (SELECT src, max_by(scale, size) AS scale FROM h1 WHERE scale * pow(size, 0.5) < 1 GROUP BY src),
i AS (
  SELECT x.*, s.* EXCLUDE (src), CASE WHEN size <= 0 OR size > room THEN 0 WHEN scale IS NULL THEN 1 ELSE least(1, scale * pow(size, 0.5)) END AS p,
    (CAST('0x' || substr(md5('mix-1' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '.' || nth), 1, 12) AS BIGINT) + 0.5) / 281474976710656.0 AS u
  FROM x JOIN s USING (src) LEFT JOIN h2 USING (src)
),
r AS (SELECT *, CASE WHEN p >= 1 THEN 0 WHEN p > 0 THEN 1 - 1 / (1 + u / (1 - u) / (p / (1 - p))) END AS rank FROM i),
f0 AS (
  SELECT *, coalesce(rank IS NOT NULL AND sum(CASE WHEN rank IS NOT NULL THEN size END) OVER (PARTITION BY src ORDER BY rank NULLS LAST, doc_id, size, nth ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= room, false) AS got
  FROM r
)"""

#: Of the first {k} documents of each {group} those that fit into what is left, tried in the given order.
_FILL = """
g{n} AS MATERIALIZED (SELECT *, room - coalesce(sum(CASE WHEN got THEN size END) OVER (PARTITION BY src), 0) AS gap FROM f{m}),
c{n} AS MATERIALIZED (
  SELECT src, doc_id, size, nth, gap, row_number() OVER (PARTITION BY src ORDER BY {order}) AS n
  FROM (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY rank, doc_id, size, nth) AS e FROM g{n} WHERE NOT got AND size > 0 AND gap > 0 AND size <= gap) WHERE e <= {k}
),
w{n} AS (
  SELECT src, n, doc_id, size, nth, TRUE AS took, gap - size AS gap FROM c{n} WHERE n = 1
  UNION ALL
  SELECT c.src, c.n, c.doc_id, c.size, c.nth, c.size <= w.gap, w.gap - CASE WHEN c.size <= w.gap THEN c.size ELSE 0 END FROM w{n} w JOIN c{n} c ON c.src = w.src AND c.n = w.n + 1
),
f{n} AS MATERIALIZED (
  SELECT g.* EXCLUDE (got, gap), got OR coalesce(took, FALSE) AS got
  FROM g{n} g LEFT JOIN w{n} w ON w.src = g.src AND w.doc_id IS NOT DISTINCT FROM g.doc_id AND w.size = g.size AND w.nth = g.nth
)"""

#: At last one more document, where it comes nearer than nothing.
_NEAREST = """
g{n} AS (SELECT *, room - coalesce(sum(CASE WHEN got THEN size END) OVER (PARTITION BY src), 0) AS gap FROM f{m}),
f{n} AS (
  SELECT * EXCLUDE (got, o), got OR (o = 1 AND NOT got AND size > 0 AND gap > 0 AND size < 2 * gap) AS got
  FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY CASE WHEN NOT got AND size > 0 AND gap > 0 AND size < 2 * gap THEN 0 ELSE 1 END, size, coalesce(rank, 2), doc_id, nth) AS o FROM g{n})
)"""

_FILLS = [dict(order="rank, doc_id, size, nth", group="src", k=256)] + [dict(order="size DESC, rank, doc_id, nth", group="src, length(bin(size))", k=64)] * 4

OP8 = "WITH RECURSIVE " + _MIX + "".join("," + _FILL.format(n=k + 1, m=k, **x) for k, x in enumerate(_FILLS)) + "," + _NEAREST.format(n=6, m=5) + """
SELECT doc_id, size, source_size, target, (certain + CAST(got AS BIGINT)) * size AS taken FROM f6
"""

#: op3's columns that the contract fixes: places and labels of its phrases.
LICENSES_BASE = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
),
p AS (SELECT * FROM (VALUES (['cc', 'by'], 'cc-by'), (['general', 'public', 'license'], 'gpl'), (['all', 'rights', 'reserved'], 'reserved')) t(phrase, label)),
hits AS (
  SELECT doc_id, label, unnest(list_filter(range(1, len(w) + 1), lambda i: w[i:i + len(phrase) - 1] = phrase)) - 1 AS place FROM w, p
)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, count(h.place) AS n_base, CAST(min(h.place) AS BIGINT) AS first_word, CAST(max(h.place) AS BIGINT) AS last_word,
  coalesce(string_agg(DISTINCT h.label, ',' ORDER BY h.label), '') AS base_labels
FROM w LEFT JOIN hits h ON h.doc_id = w.doc_id GROUP BY w.doc_id, w.w
"""

OP11 = r"""
WITH t AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce('0' || lang, '1') AS lang, coalesce('0' || source, '1') AS source, coalesce(text, '') AS text FROM documents
),
w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t
),
g AS (SELECT k, i, array_to_string(w[i:i + 7], ' ') AS g FROM w, unnest(range(1, len(w) - 6)) u(i)),
again AS (SELECT k, g FROM g GROUP BY k, g HAVING count(*) > 1),
rep AS (SELECT k, count(DISTINCT i + j) AS n FROM g JOIN again USING (k, g), unnest(range(0, 8)) u(j) GROUP BY k),
m AS (
  SELECT w.k, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(lines) AS BIGINT) AS n_lines
  FROM w LEFT JOIN rep ON rep.k = w.k
),
v AS (
  SELECT k, lang, source, n_words, unnest([
    {'rule': 'word_length', 'x': 1000 * word_chars // greatest(n_words, 1), 'floor': 250, 'two': true}, {'rule': 'symbols', 'x': 1000 * n_symbols // greatest(n_words, 1), 'floor': 20, 'two': false},
    {'rule': 'dup_lines', 'x': 1000 * n_dup_lines // greatest(n_lines, 1), 'floor': 100, 'two': false}, {'rule': 'repeats', 'x': 1000 * n_repeat_words // greatest(n_words, 1), 'floor': 100, 'two': false}], recursive := true)
  FROM m
),
b AS (SELECT *, CASE WHEN x < 128 THEN x ELSE (x >> (length(bin(x)) - 7)) << (length(bin(x)) - 7) END AS least FROM v WHERE n_words > 0),
q AS (
  SELECT lang, source, rule, count(*) AS n, quantile_disc(least, 0.25) AS low, quantile_disc(least, 0.75) AS high FROM b GROUP BY GROUPING SETS ((lang, source, rule), (lang, rule), (rule))
),
f AS (
  SELECT o.lang, o.source, o.rule, CASE WHEN o.n >= 200 THEN o.low WHEN l.n >= 200 THEN l.low ELSE e.low END AS low, CASE WHEN o.n >= 200 THEN o.high WHEN l.n >= 200 THEN l.high ELSE e.high END AS high
  FROM q o JOIN q l ON l.lang = o.lang AND l.source IS NULL AND l.rule = o.rule JOIN q e ON e.lang IS NULL AND e.source IS NULL AND e.rule = o.rule
  WHERE o.source IS NOT NULL
),
bad AS (
  SELECT DISTINCT v.k FROM v JOIN f USING (lang, source, rule)
  WHERE v.x > f.high + 5 * greatest(f.high - f.low, floor) OR (two AND v.x < f.low - 5 * greatest(f.high - f.low, floor))
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND bad.k IS NULL AS kept
FROM m LEFT JOIN bad ON bad.k = m.k
"""

OP12 = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
),
c AS (SELECT CAST(count(*) FILTER (len(w) > 0) AS BIGINT) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark
),
u AS (SELECT k, doc_id, len(w) AS n, unnest(w) AS t FROM d),
p AS (SELECT k, doc_id, n, t, count(*) AS tf FROM u WHERE t IN (SELECT t FROM q) GROUP BY k, doc_id, n, t),
x AS (SELECT t, CAST(floor(1000 * ln((2.0::DOUBLE * c.n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, c GROUP BY t, c.n),
s AS (
  SELECT item_id, k, doc_id, CAST(sum(x.w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * p.n * c.n) // c.l)))) AS BIGINT) AS score
  FROM q JOIN p USING (t) JOIN x USING (t), c GROUP BY item_id, k, doc_id
),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 50
"""

#: Assignment of all parts to the entries of codebook {n}, and the codebook after it.
_ASSIGNED = """
a{n} AS MATERIALIZED (
  SELECT k, p.part, p.x, min(CAST(list_dot_product(p.f, p.f) - 2 * list_dot_product(p.f, b.f) + list_dot_product(b.f, b.f) AS BIGINT) * 256 + b.entry) AS best
  FROM p JOIN b{n} b USING (part) GROUP BY k, p.part, p.x
)"""
_MOVED = """
m{n} AS (
  SELECT part, entry, list(c ORDER BY j) AS c
  FROM (SELECT part, best % 256 AS entry, j, CAST(floor(CAST(sum(x[j]) AS DOUBLE) / count(*)) AS BIGINT) AS c FROM a{n}, unnest(range(1, len(x) + 1)) u(j) GROUP BY 1, 2, 3) GROUP BY part, entry
),
b{m} AS MATERIALIZED (SELECT part, entry, coalesce(m.c, b.c) AS c, CAST(coalesce(m.c, b.c) AS DOUBLE[]) AS f FROM b{n} b LEFT JOIN m{n} m USING (part, entry))"""

OP13 = (
    """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) - 1 AS k, vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
),
p AS MATERIALIZED (SELECT k, part, x, CAST(x AS DOUBLE[]) AS f FROM (SELECT k, part, v[part * (len(v) // 4) + 1:(part + 1) * (len(v) // 4)] AS x FROM v, unnest(range(0, 4)) u(part))),
b0 AS MATERIALIZED (SELECT part, k AS entry, x AS c, f FROM p WHERE k < 256),"""
    + ",".join(_ASSIGNED.format(n=n) + "," + _MOVED.format(n=n, m=n + 1) for n in range(4))
    + ","
    + _ASSIGNED.format(n=4)
    + """,
c AS (SELECT k, string_agg(format('{:02x}', best % 256), '' ORDER BY part) AS code, CAST(sum(best // 256) AS BIGINT) AS error FROM a4 GROUP BY k),
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS h FROM b4)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM v JOIN c USING (k), h
"""
)

ORACLES = {"op5_top_k": OP5, "op6_jaccard": OP6, "op7_vector_dedup": OP7, "op8_mixing": OP8, "op11_quality_rules": OP11, "op12_lexical_search": OP12, "op13_vector_codes": OP13, "licenses_base": LICENSES_BASE}
