"""DuckDB restatements of the queries that SQL can express."""

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: Every 13-word run of every document is looked up among the items' windows.
DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS g
       FROM (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS s
             FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n, s, array_to_string(w[s:s + n - 1], ' ') AS g
       FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lens WHERE len(w) >= n)),
hits AS (SELECT r, s, dw.n AS n, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM hits) GROUP BY r),
listed AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
           FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN listed USING (r)
"""

#: Every order is applied to every mask, step by step; letters stand for filters.
FILTER_AUDIT = r"""
WITH l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad
           FROM labels GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
             regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
firsts AS (SELECT t, min(doc_id) AS first_id FROM d GROUP BY t),
m AS (SELECT part, concat(
          CASE WHEN len(w) < 100 THEN 'A' ELSE '' END,
          CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END,
          CASE WHEN 100 * length(regexp_replace(d.t, '[^A-Z]', '', 'g')) > 10 * length(d.t) THEN 'C' ELSE '' END,
          CASE WHEN regexp_matches(d.t, '[#$%&*|]') THEN 'D' ELSE '' END,
          CASE WHEN d.doc_id > first_id THEN 'E' ELSE '' END) AS fails,
          coalesce(good, 0) AS good, coalesce(bad, 0) AS bad
      FROM d JOIN firsts ON d.t = firsts.t LEFT JOIN l ON d.doc_id = l.doc_id),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM m GROUP BY part, fails),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT concat(a.x, b.x, c.x, d.x, e.x) AS filter_order FROM f a, f b, f c, f d, f e
      WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, k AS step, substr(filter_order, k, 1) AS x, substr(filter_order, 1, k - 1) AS before FROM o, unnest(range(1, 6)) AS u(k)),
r AS (SELECT part, filter_order, step, n, good, bad, fails, x, contains(fails, x) AS hit,
             length(translate(before, fails, '')) < length(before) AS gone FROM c, s),
g AS (SELECT part, filter_order, step, x,
             sum(CASE WHEN NOT gone AND NOT hit THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND hit THEN n ELSE 0 END) AS removed,
             sum(CASE WHEN gone AND hit THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = x THEN n ELSE 0 END) AS unique_fails,
             sum(CASE WHEN NOT gone AND hit THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND hit THEN bad ELSE 0 END) AS toxic_lost
      FROM r GROUP BY part, filter_order, step, x)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
FROM g
"""
