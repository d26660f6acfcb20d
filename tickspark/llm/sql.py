"""DuckDB SQL of the queries that SQL can express, written from their contracts and methods.

Language ID, chat windows, packing, personal data, pictures, the ring and secrets have no SQL (trained models, greedy
walks, tokenizers and compressors); brute force checks those in tests/llm.
"""

from __future__ import annotations

MIXING = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS source_rows, (ARRAY[5, 2, 1])[1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3] AS weight FROM d GROUP BY source),
o AS (SELECT *, 3 * source_size AS lim, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER w, 0) AS lft, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS weigh
    FROM s WINDOW w AS (ORDER BY 3 * source_size / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, lim * weigh <= lft * weight AS filled FROM o),
t AS (SELECT *, CASE WHEN filled THEN lim::DOUBLE ELSE weight * (SELECT arg_min(lft / weigh, lim / weight) FROM f WHERE NOT filled) END AS target FROM f),
r AS (SELECT d.doc_id, d.source, d.size, t.source_size, t.target, CASE WHEN source_size > 0 THEN target / source_size ELSE 1.0e0 END AS rate, ceil(source_rows / 64.0e0) AS strata,
    ('0x' || substr(md5(d.doc_id || '|mix'), 1, 13))::BIGINT / 4503599627370496.0e0 AS unit FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, floor(unit * strata)::BIGINT AS stratum FROM r),
n AS (SELECT *, row_number() OVER (PARTITION BY source, stratum ORDER BY size, unit, doc_id)::DOUBLE AS rnk, ('0x' || substr(md5(coalesce(source, '~') || '|' || stratum || '|mix'), 1, 13))::BIGINT / 4503599627370496.0e0 AS begins, rate - floor(rate) AS part FROM k)
SELECT doc_id, size, source_size, target, size * (floor(rate) + floor(begins + rnk * part) - floor(begins + (rnk - 1) * part))::BIGINT AS taken FROM n
"""

NEARDUP = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
g AS (SELECT DISTINCT doc_id, CASE WHEN len(words) < 3 THEN array_to_string(words, ' ') ELSE words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] END AS gram
    FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 1, 2))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(doc_id, seen) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.seen FROM reach r JOIN e ON e.a = r.doc_id WHERE r.seen <= e.b)
SELECT r.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.seen) AS component_id, r.doc_id = min(r.seen) AS kept FROM reach r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""

VECTORS = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98e0),
reach(vec_id, seen) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT p.b, r.seen FROM reach r JOIN p ON p.a = r.vec_id WHERE r.seen <= p.b),
n AS (SELECT a AS vec_id, count(*) AS n FROM p GROUP BY a)
SELECT r.vec_id, coalesce(any_value(n.n), 0)::BIGINT AS n_links, min(r.seen) AS component_id, r.vec_id = min(r.seen) AS kept FROM reach r LEFT JOIN n ON n.vec_id = r.vec_id GROUP BY r.vec_id
"""


def _merged(name: str, source: str, parent: str, branch: str) -> str:
    """Siblings pooled unless a branch's share of blocked urls differs from theirs, or isn't known."""
    return f"""
{name}_j AS (SELECT {parent}, {branch}, n, b, sum(n) OVER w AS na, sum(b) OVER w AS ba FROM {source} WINDOW w AS (PARTITION BY {parent})),
{name}_a AS (SELECT *, (b * na - n * ba)::DOUBLE * (b * na - n * ba) > 1.96e0 * 1.96e0 * n * ba * (na - ba) OR n = 0 AS alone FROM {name}_j),
{name} AS (SELECT {parent}, {branch}, n, b, CASE WHEN alone THEN n ELSE sum(n) FILTER (NOT alone) OVER w END AS pn, CASE WHEN alone THEN b ELSE sum(b) FILTER (NOT alone) OVER w END AS pb FROM {name}_a WINDOW w AS (PARTITION BY {parent}))"""


def _generalised(level: str, source: str, branch: str) -> str:
    """A level's segment, or * if it holds a digit or has less than a hundredth of its branch's urls and a share of blocked ones like its branch's."""
    return f"""g{level} AS (SELECT *, CASE WHEN regexp_matches(s{level}, '[0-9]') THEN '*' ELSE s{level} END AS seg FROM {source}),
c{level} AS (SELECT *, count(*) OVER v AS size, sum(n) OVER v AS ln, sum(b) OVER v AS lb, count(*) OVER w AS size_all, sum(n) OVER w AS na, sum(b) OVER w AS ba FROM g{level} WINDOW v AS (PARTITION BY {branch}, seg), w AS (PARTITION BY {branch})),
r{level} AS (SELECT * EXCLUDE (seg, size, ln, lb, size_all, na, ba), CASE WHEN size >= 0.01e0 * size_all OR (lb * na - ln * ba)::DOUBLE * (lb * na - ln * ba) > 1.96e0 * 1.96e0 * ln * ba * (na - ba) THEN seg ELSE '*' END AS t{level} FROM c{level})"""


#: Paths of two segments, as deep as the tables' go; tests hold deeper ones against a plain tree.
URLS = f"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
k AS (SELECT h.*, (SELECT arg_max((k.name, k.verdict), length(k.name)) FROM (VALUES ('net', '/', 'net/', 'block'), ('example.net', '/en/', 'example.net/en/', 'allow'), ('example.com', '/de/', 'example.com/de/', 'block'), ('org', '/fr/', 'org/fr/', 'allow')) k(host, path, name, verdict)
    WHERE (h.host = k.host OR ends_with(h.host, '.' || k.host)) AND starts_with(h.path, k.path)) AS found FROM h),
r AS (SELECT page_id, host, path, found[1] AS rule, found[2] AS ruled, (found IS NOT NULL)::INT AS n, (coalesce(found[2], '') = 'block')::INT AS b, regexp_extract(host, '^[^.]*\\.(.*)$', 1) AS domain,
    coalesce(str_split(path, '/')[2], '') AS s1, coalesce(str_split(path, '/')[3], '') AS s2 FROM k),
{_generalised('1', 'r', 'host')},
{_generalised('2', 'r1', 'host, t1')},
leaf AS (SELECT domain, host, t1, t2, sum(n) AS n, sum(b) AS b FROM r2 GROUP BY ALL),{_merged('two', 'leaf', 'domain, host, t1', 't2')},
mid AS (SELECT domain, host, t1, sum(n) AS n, sum(b) AS b FROM two GROUP BY ALL),{_merged('one', 'mid', 'domain, host', 't1')},
hosts AS (SELECT domain, host, sum(n) AS n, sum(b) AS b FROM one GROUP BY ALL),
domains AS (SELECT domain, sum(n) AS n, sum(b) AS b FROM hosts GROUP BY ALL),
p0 AS (SELECT CASE WHEN sum(n) > 0 THEN sum(b) / sum(n) END AS p FROM domains),
p1 AS (SELECT domain, (b + 4.0e0 * p) / (n + 4.0e0) AS p FROM domains, p0),
p2 AS (SELECT host, domain, (b + 4.0e0 * p) / (n + 4.0e0) AS p FROM hosts JOIN p1 USING (domain)),
p3 AS (SELECT host, t1, (pb + 4.0e0 * p) / (pn + 4.0e0) AS p FROM one JOIN p2 USING (host)),
p4 AS (SELECT host, t1, t2, (pb + 4.0e0 * p) / (pn + 4.0e0) AS p FROM two JOIN p3 USING (host, t1))
SELECT page_id, r2.host, path, rule, CASE WHEN rule IS NOT NULL THEN ruled WHEN p >= 0.5e0 THEN 'block' ELSE 'allow' END AS verdict, '/' || r2.t1 || '/' || r2.t2 AS template, round(p, 6) AS purity FROM r2 JOIN p4 USING (host, t1, t2)
"""

AUDIT = r"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
m AS (SELECT doc_id, part, (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT + 4 * (100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 2 * length(text))::INT
    + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)::INT AS mask FROM w),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0)::BIGINT AS good, coalesce(sum(toxic), 0)::BIGINT AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask),
f AS (SELECT chr((65 + i)::INT) AS f FROM range(5) t(i)),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT filter_order, step::INT AS step, filter_order[step] AS letter, 1 << (ascii(filter_order[step]) - 65) AS bit, coalesce(list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(filter_order[i]) - 65))), 0)::INT AS gone FROM o, range(1, 6) t(step)),
r AS (SELECT part, filter_order, step, letter, sum(CASE WHEN mask & bit = 0 AND mask & gone = 0 THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN mask & bit > 0 AND mask & gone = 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN mask & bit > 0 AND mask & gone > 0 THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN mask & bit > 0 AND mask & gone = 0 THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN mask & bit > 0 AND mask & gone = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost FROM c, s GROUP BY ALL)
SELECT * EXCLUDE (letter), (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM r
"""

#: The checksum goes byte by byte over the hexadecimal digits of each different feature.
IMPORTANCE = r"""
WITH tab AS (SELECT list(v ORDER BY i) AS crc FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) t(i))),
w AS (SELECT b, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM (SELECT 0 AS b, doc_id AS id, text FROM documents UNION ALL SELECT 1, row_number() OVER (), text FROM benchmark)),
i AS (SELECT b, id, words, unnest(range(1, len(words) + 1)) AS i FROM w),
f AS (SELECT b, id, words[i] AS feature FROM i UNION ALL SELECT b, id, words[i] || ' ' || words[i + 1] FROM i WHERE i < len(words) UNION ALL SELECT b, id, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] FROM i WHERE i + 1 < len(words)),
g AS (SELECT b, id, feature, count(*) AS n FROM f GROUP BY ALL),
u AS (SELECT DISTINCT feature FROM g),
x AS (SELECT feature, list_transform(range(1, 1 + length(hex(feature)) // 2), lambda k: (16 * (instr('123456789ABCDEF', hex(feature)[2 * k - 1]) + 0) + instr('123456789ABCDEF', hex(feature)[2 * k]))::BIGINT) AS bytes FROM u),
h AS (SELECT feature, xor(list_reduce(list_concat([4294967295::BIGINT], bytes), lambda c, y: xor(c >> 8, crc[(xor(c, y) & 255) + 1])), 4294967295) % 10000 AS bucket FROM x, tab),
p AS (SELECT b, id, bucket, sum(n) AS n FROM g JOIN h USING (feature) GROUP BY ALL),
z AS (SELECT coalesce(sum(n) FILTER (b = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (b = 1), 0)::DOUBLE AS t FROM p),
k AS (SELECT bucket, floor(1000 * ln((coalesce(sum(n) FILTER (b = 1), 0) + 1)::DOUBLE * ((SELECT s FROM z) + 10000) / ((coalesce(sum(n) FILTER (b = 0), 0) + 1)::DOUBLE * ((SELECT t FROM z) + 10000))))::BIGINT AS gain FROM p GROUP BY bucket),
v AS (SELECT id, sum(n * gain)::BIGINT AS weight FROM p JOIN k USING (bucket) WHERE b = 0 GROUP BY id),
d AS (SELECT id AS doc_id, len(words) AS words, (len(words) + greatest(len(words) - 1, 0) + greatest(len(words) - 2, 0))::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    ('0x' || substr(sha256('42:' || id), 1, 8))::BIGINT AS h FROM w LEFT JOIN v USING (id) WHERE b = 0),
e AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5e0) / 4294967296e0)))::BIGINT AS score FROM d),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM e WHERE words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 5 * n // 100 THEN rank END AS rank FROM e LEFT JOIN r USING (doc_id)
"""

SQL: dict[str, str] = {"op2_mixing": MIXING, "op4_neardup": NEARDUP, "op5_urls": URLS, "op7_vectors": VECTORS, "op11_audit": AUDIT, "op12_importance": IMPORTANCE}
