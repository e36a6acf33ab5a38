"""SQL, for DuckDB, whose rows the registered queries must give, for the operators that SQL can express."""

MIXING = r"""
WITH RECURSIVE hashed AS (
  SELECT doc_id, source, coalesce('1' || source, '0') AS src, md5('9|' || coalesce(CAST(doc_id AS VARCHAR), '') || coalesce('|' || text, '')) AS h,
         CAST(coalesce(len(list_filter(string_split_regex(text, '[ \t\n\x0B\f\r]+'), lambda w: w <> '')), 0) AS BIGINT) AS n FROM documents),
placed AS (
  SELECT *, CAST('0x' || substr(h, 1, 13) AS BIGINT) / 4503599627370496.0 AS u, CAST('0x' || substr(h, 17, 13) AS BIGINT) / 4503599627370496.0 AS v FROM hashed),
shares AS (SELECT src, CAST(sum(n) AS DOUBLE) AS tokens FROM placed GROUP BY 1),
known AS (SELECT sum(tokens) AS total, count(*) AS sources, list(tokens) AS each FROM shares WHERE tokens > 0),
parts AS (SELECT total, sources, list_transform(each, lambda t: t / total) AS p FROM known),
aim AS (SELECT *, ln(sources) * (own + 0.5 * (1 - own)) - 1e-9 AS least FROM (SELECT *, -list_sum(list_transform(p, lambda x: x * ln(x))) / ln(sources) AS own FROM parts)),
bisected AS (
  SELECT 0 AS i, CAST(0 AS DOUBLE) AS lo, CAST(1 AS DOUBLE) AS hi
  UNION ALL
  SELECT i + 1, CASE WHEN met THEN mid ELSE lo END, CASE WHEN met THEN hi ELSE mid END FROM (
    SELECT i, lo, hi, mid, ln(z) - mid * list_sum(list_transform(p, lambda x: pow(x, mid) * ln(x))) / z >= least AS met FROM (
      SELECT *, list_sum(list_transform(p, lambda x: pow(x, mid))) AS z FROM (SELECT i, lo, hi, (lo + hi) / 2 AS mid, p, least FROM bisected, aim WHERE i < 30)))),
chosen AS (SELECT CASE WHEN sources < 2 OR own >= 1 - 1e-9 THEN 1.0 ELSE (SELECT max(lo) FROM bisected WHERE i = 30) END AS alpha, total, p FROM aim),
plan AS (
  SELECT src, tokens, CASE WHEN tokens > 0 THEN pow(tokens / total, alpha) / list_sum(list_transform(p, lambda x: pow(x, alpha))) ELSE 0 END AS weight, total FROM shares, chosen),
quotas AS (SELECT src, weight, CASE WHEN tokens > 0 THEN floor((weight * total + 1e-9) / tokens) ELSE 1 END AS epochs, tokens, total FROM plan),
rests AS (SELECT *, CASE WHEN tokens > 0 THEN weight * total - epochs * tokens ELSE 0 END AS rest FROM quotas),
blocked AS (SELECT placed.*, CAST(floor(u * 1024) AS INTEGER) AS block FROM placed),
sums AS (SELECT src, block, sum(n) AS own FROM blocked GROUP BY ALL),
permuted AS (
  SELECT src, block, own, rest - sum(own) OVER w + own AS remaining, CAST(row_number() OVER w AS INTEGER) AS place FROM sums JOIN rests USING (src)
  WINDOW w AS (PARTITION BY src ORDER BY md5('9|' || src || '|' || block), block)),
inside AS (
  SELECT src, block, v, remaining, sum(n) OVER (PARTITION BY src ORDER BY v) AS upto FROM blocked JOIN permuted USING (src, block) WHERE remaining > 0 AND remaining < own),
cuts AS (SELECT src, block, max(v) AS last FROM inside WHERE upto <= remaining GROUP BY ALL)
SELECT b.doc_id, b.source, b.n AS mix_tokens, round(r.weight, 6) AS mix_weight, q.place AS mix_block,
       CAST(r.epochs + CASE WHEN r.weight > 0 AND (q.remaining >= q.own OR q.remaining > 0 AND b.v <= c.last) THEN 1 ELSE 0 END AS INTEGER) AS mix_copies
FROM blocked b JOIN rests r USING (src) JOIN permuted q USING (src, block) LEFT JOIN cuts c USING (src, block)
"""

URLS = r"""
WITH RECURSIVE split AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
named AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '\A[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '\A[^/?#]*([^?#]*)', 1), '') AS path FROM split),
ruled AS (
  SELECT *, CASE WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
                 WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
                 WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
                 WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM named),
marked AS (SELECT *, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS told FROM ruled),
urls AS (
  SELECT host, path, list_filter(string_split(path, '/'), lambda s: s <> '') AS segs, count(*) AS n, count(rule) AS labelled,
         count(*) FILTER (told = 'block') AS blocked, array_to_string(string_split(host, '.')[-2:], '.') AS domain FROM marked GROUP BY host, path),
topped AS (
  SELECT *, (own_b + 4.0 * (dom_b + 4.0 * coalesce(all_b / nullif(all_l, 0), 0)) / (dom_l + 4.0)) / (own_l + 4.0) AS purity FROM (
    SELECT *, sum(blocked) OVER () AS all_b, sum(labelled) OVER () AS all_l, sum(blocked) OVER (PARTITION BY domain) AS dom_b, sum(labelled) OVER (PARTITION BY domain) AS dom_l,
           sum(blocked) OVER (PARTITION BY host) AS own_b, sum(labelled) OVER (PARTITION BY host) AS own_l FROM urls)),
walk AS (
  SELECT 0 AS level, host, path, segs, n, labelled, blocked, '' AS template, CAST(purity AS DOUBLE) AS purity FROM topped
  UNION ALL
  SELECT level + 1, host, path, segs, n, labelled, blocked, template || '/' || new,
         CAST((sum(blocked) OVER (PARTITION BY host, template, new) + 4.0 * purity) / (sum(labelled) OVER (PARTITION BY host, template, new) + 4.0) AS DOUBLE) FROM (
    SELECT *, CASE WHEN regexp_matches(seg, '\A([0-9]+|[0-9a-fA-F-]{8,})(\.[A-Za-z0-9]+)?\z') OR kids >= 8 AND kids >= 0.2 * n_all
                     OR kid_l > 0 AND kid_l < l_all AND abs(kid_b / nullif(kid_l, 0) - b_all / nullif(l_all, 0)) <= 1.96 * sqrt(b_all / nullif(l_all, 0) * (1 - b_all / nullif(l_all, 0)) / nullif(kid_l, 0))
                   THEN '*' ELSE seg END AS new FROM (
      SELECT *, count(DISTINCT seg) OVER (PARTITION BY host, template) AS kids, sum(n) OVER (PARTITION BY host, template) AS n_all,
             CAST(sum(labelled) OVER (PARTITION BY host, template) AS DOUBLE) AS l_all, CAST(sum(blocked) OVER (PARTITION BY host, template) AS DOUBLE) AS b_all,
             CAST(sum(labelled) OVER (PARTITION BY host, template, seg) AS DOUBLE) AS kid_l, CAST(sum(blocked) OVER (PARTITION BY host, template, seg) AS DOUBLE) AS kid_b FROM (
        SELECT *, segs[level + 1] AS seg FROM walk WHERE len(segs) > level))))
SELECT m.page_id, m.host, m.path, m.rule, coalesce(m.told, CASE WHEN w.purity >= 0.6 THEN 'block' ELSE 'allow' END) AS verdict, w.template, round(w.purity, 6) AS purity
FROM marked m JOIN walk w USING (host, path) WHERE w.level = len(w.segs)
"""

#: The exact answer: on tables of a few thousand vectors the search finds all of it.
NEAREST = """
WITH usable AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
sized AS (SELECT len(v) AS size, count(*) AS n FROM usable GROUP BY 1 ORDER BY n DESC, size LIMIT 1),
kept AS (SELECT vec_id, v FROM usable, sized WHERE len(v) = size),
normed AS (SELECT vec_id, v, sqrt(list_reduce(list_transform(v, lambda x: x * x), lambda s, x: s + x)) AS norm FROM kept),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]), lambda s, x: s + x) / (q.norm * c.norm) AS score
  FROM normed q JOIN normed c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs) WHERE rank <= 5
"""

#: Exact: the join's recall is 0.999, and on tables of this size it finds every link.
NEAR_DUPLICATES = r"""
WITH RECURSIVE worded AS (
  SELECT row_number() OVER () AS row, doc_id, text, list_filter(string_split_regex(text, '[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+'), lambda w: w <> '') AS w FROM documents),
grams AS (
  SELECT row, doc_id, text IS NULL AS none, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')))) END AS g FROM worded),
sets AS (SELECT row_number() OVER () AS s, g, count(*) AS copies, min(doc_id) AS least, len(g) AS size FROM grams WHERE NOT none GROUP BY g),
entries AS (SELECT s, size, unnest(g) AS gram FROM sets),
pairs AS (SELECT a.s AS a, b.s AS b FROM entries a JOIN entries b ON a.gram = b.gram AND a.s < b.s GROUP BY a.s, b.s, a.size, b.size HAVING count(*) >= 0.8 * (a.size + b.size - count(*)) - 1e-9),
ways AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reached AS (SELECT s, s AS r FROM sets UNION SELECT reached.s, ways.b FROM reached JOIN ways ON reached.r = ways.a),
classes AS (SELECT reached.s, min(sets.least) AS class_id FROM reached JOIN sets ON reached.r = sets.s GROUP BY 1),
counts AS (SELECT ways.a AS s, sum(sets.copies) AS more FROM ways JOIN sets ON ways.b = sets.s GROUP BY 1)
SELECT g.doc_id, CASE WHEN g.none THEN g.doc_id ELSE c.class_id END AS class_id, CAST(CASE WHEN g.none THEN 0 ELSE t.copies - 1 + coalesce(n.more, 0) END AS BIGINT) AS links
FROM grams g LEFT JOIN sets t ON NOT g.none AND t.g = g.g LEFT JOIN classes c ON c.s = t.s LEFT JOIN counts n ON n.s = t.s
"""
