"""The registered queries restated as DuckDB SQL over the same parquet tables."""

from __future__ import annotations

from labelscope.sources import catalog

LINES = r"""
p AS (
  SELECT p_partkey AS key, p_name AS name, p_size AS size, p_type AS type,
         CAST(p_retailprice AS DECIMAL(12,2)) AS price, s.s_name, n.n_name AS nation,
         CAST(o.o_orderdate AS DATE) AS made,
         lpad(CAST(p_partkey % 1000 AS VARCHAR), 3, '0') AS digits
  FROM part
  LEFT JOIN supplier s ON s.s_suppkey = p_partkey % (SELECT count(*) FROM supplier)
  LEFT JOIN nation n ON n.n_nationkey = s.s_nationkey
  LEFT JOIN (SELECT l_partkey, min(l_orderkey) AS first_order FROM lineitem GROUP BY 1) f ON f.l_partkey = p_partkey
  LEFT JOIN orders o ON o.o_orderkey = f.first_order),
raw AS (
  SELECT key, 0 AS ord, CASE WHEN key % 5 = 0 THEN name ELSE 'Product Name: ' || name END AS text FROM p
  UNION ALL SELECT key, 1, 'Net Qty: ' || CAST(size AS VARCHAR)
    || (['g', ' kg', ' ml', ' l', '', ' gms', '9', ' gn'])[key % 8 + 1] FROM p
  UNION ALL SELECT key, 2, (['MRP Rs. ', 'MRP: ', 'Rs. ', 'Rs. '])[key % 4 + 1] || CAST(price AS VARCHAR) FROM p
  UNION ALL SELECT key, 3, (['Mfd By: ', 'Marketed By: ', 'Manufactured By: '])[key % 3 + 1] || s_name || ' Foods Private Limited' FROM p
  UNION ALL SELECT key, 4, CASE WHEN key % 7 = 0 THEN strftime(made, '%d/%m/%Y')
    ELSE 'MFG ' || strftime(made, '%d/%m/%Y') || ' EXP ' || strftime(made + INTERVAL 12 MONTH, '%d/%m/%Y') END FROM p
  UNION ALL SELECT key, 5, CASE WHEN key % 6 = 0 THEN 'Made in India. Imported by ' || s_name
    WHEN key % 2 = 1 THEN 'Made in India' ELSE 'Made in ' || nation END FROM p
  UNION ALL SELECT key, 6, CASE WHEN key % 3 = 0 THEN 'Consumer Care: 1800 ' || digits || ' 4567'
    WHEN key % 3 = 1 THEN 'Please send your questions to: help' || CAST(key AS VARCHAR) || '@example.com' END FROM p
  UNION ALL SELECT key, 7, CASE WHEN key % 4 = 3 THEN 'Rs. ' || CAST(CAST(price + 10 AS DECIMAL(12,2)) AS VARCHAR) END FROM p
  UNION ALL SELECT key, 8, CASE WHEN key % 7 = 0 THEN strftime(made + INTERVAL 12 MONTH, '%d/%m/%Y') END FROM p
  UNION ALL SELECT key, 9, CASE WHEN key % 8 = 0 THEN 'USP Rs. 0.' || digits || ' per g'
    WHEN key % 8 = 1 THEN 'Rs.0.' || substr(digits, 1, 2) || '/ml' END FROM p
  UNION ALL SELECT key, 10, CASE WHEN key % 10 = 0 THEN 'Size: ' || CAST(size AS VARCHAR) || ' x 20 cm' END FROM p
  UNION ALL SELECT key, 11, CASE WHEN key % 10 = 5 THEN (['Salted Snack', 'Cereal based namkeeh', 'Roasted Almonds',
    'wheat biscults', 'Instant Coffee Powder'])[(key // 10) % 5 + 1] END FROM p),
lines AS (
  SELECT CAST(key AS BIGINT) AS scan_id, row_number() OVER (PARTITION BY key ORDER BY ord) - 1 AS pos, ord, text,
         CAST(40 + (key * 37 + ord * 11) % 60 AS DOUBLE) / 100 AS confidence, CAST(ord * 20 AS DOUBLE) AS y0
  FROM raw WHERE text IS NOT NULL)
"""

LABEL_TABLE = r"""
p AS (
  SELECT p_partkey AS key, CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR) AS price,
         CAST(o.o_orderdate AS DATE) AS made,
         CASE WHEN p_partkey % 3 = 0 THEN 0 WHEN p_partkey % 3 = 1 THEN -25 ELSE 4 END AS shift,
         CASE WHEN p_partkey % 3 = 0 THEN 0 WHEN p_partkey % 3 = 1 THEN -1 END AS row_shift
  FROM part LEFT JOIN (SELECT l_partkey, min(l_orderkey) AS first_order FROM lineitem GROUP BY 1) f ON f.l_partkey = p_partkey
  LEFT JOIN orders o ON o.o_orderkey = f.first_order),
cells AS (
  SELECT p.*, i, (['MRP Rs.', 'USP Rs.', 'BATCH NO.', 'MFD.', 'USE BY.'])[i + 1] AS label,
         CASE WHEN i = 2 AND key % 5 = 0 THEN NULL ELSE coalesce(
           CASE i WHEN 0 THEN price WHEN 1 THEN '0.45/g' WHEN 2 THEN 'B' || key
                  WHEN 3 THEN strftime(made, '%d/%m/%y')
                  ELSE strftime(made + INTERVAL 12 MONTH, '%d/%m/%y') END, '-') END AS val
  FROM p, range(5) r(i)),
raw AS (
  SELECT key, 2 * i AS o, label AS text, 50 AS x0, 140 AS x1, 100 + 25 * i AS y0,
         CASE WHEN key % 3 <> 2 THEN i END AS row_index, CASE WHEN key % 3 <> 2 THEN 0 END AS column_index FROM cells
  UNION ALL SELECT key, 2 * i + 1, val, 180, 300, 100 + 25 * i + shift, row_shift + i,
         CASE WHEN row_shift IS NOT NULL THEN 1 END FROM cells WHERE val IS NOT NULL
  UNION ALL SELECT key, 10, '13:46', 180, 220, 194 + shift, CASE WHEN key % 3 <> 2 THEN 9 END,
         CASE WHEN key % 3 <> 2 THEN 1 END FROM p WHERE key % 7 = 0),
cell_lines AS (
  SELECT CAST(key AS BIGINT) AS scan_id, row_number() OVER (PARTITION BY key ORDER BY o) - 1 AS pos, text,
         x0, x1, y0, y0 + 16 AS y1, row_index, column_index, x0 < 160 AS is_left FROM raw)
"""

# claims of labels on values beside them; in these tables a value is beside one label at most,
# so the best claim of each label is the best of what is left at every step
GEOMETRY = """
  , sized AS (SELECT *, (y0 + y1) / 2.0 AS mid, row_number() OVER (PARTITION BY scan_id, is_left ORDER BY y0, pos) AS rk,
      count(*) FILTER (WHERE is_left) OVER (PARTITION BY scan_id) AS nl, count(*) FILTER (WHERE NOT is_left) OVER (PARTITION BY scan_id) AS nr
    FROM cell_lines),
  matched AS (
    SELECT l.scan_id, l.pos AS l_pos, l.rk AS l_rk, v.pos AS v_pos, v.x0, v.x1, v.y1, l.nl, l.nr
    FROM sized l JOIN sized v ON v.scan_id = l.scan_id AND l.is_left AND NOT v.is_left
      AND (least(l.y1, v.y1) - greatest(l.y0, v.y0)) / 16.0 >= 0.5
    QUALIFY row_number() OVER (PARTITION BY l.scan_id, l.pos ORDER BY (least(l.y1, v.y1) - greatest(l.y0, v.y0)) / 16.0 DESC,
      abs(l.mid - v.mid), v.rk DESC) = 1),
  whole AS (SELECT scan_id, max(nr) > count(*) AS spare FROM matched GROUP BY 1 HAVING count(*) = max(nl) AND max(nr) - count(*) <= 1),
  wrapped AS (
    SELECT w.scan_id, arg_max(m.l_pos, struct_pack(y := m.y1, r := -m.l_rk)) AS l_pos, w.pos AS v_pos
    FROM sized w JOIN whole ON whole.scan_id = w.scan_id AND whole.spare JOIN matched m ON m.scan_id = w.scan_id
      AND w.y0 - m.y1 BETWEEN 0 AND 24 AND least(w.x1, m.x1) > greatest(w.x0, m.x0)
    WHERE NOT w.is_left AND NOT EXISTS (SELECT 1 FROM matched d WHERE d.scan_id = w.scan_id AND d.v_pos = w.pos)
    GROUP BY w.scan_id, w.pos),
  geometry AS (
    SELECT m.scan_id, m.l_pos, m.v_pos, 1 AS part FROM matched m JOIN whole USING (scan_id)
    WHERE NOT spare OR EXISTS (SELECT 1 FROM wrapped w WHERE w.scan_id = m.scan_id)
    UNION ALL SELECT scan_id, l_pos, v_pos, 2 FROM wrapped)"""
# a complete cover by rows, then geometry where rows say nothing, then rank, then what rows say
STRATEGIES = """
  , by_row AS ({row}), by_rank AS ({rank}),
  verdicts AS (
    SELECT scan_id, CASE WHEN r = nl THEN 'row' WHEN r = 0 AND g > 0 THEN 'geometry' WHEN k > 0 THEN 'rank' WHEN r > 0 THEN 'row' END AS strategy
    FROM (SELECT scan_id, max(nl) AS nl, (SELECT count(DISTINCT l_pos) FROM by_row x WHERE x.scan_id = s.scan_id) AS r,
        (SELECT count(*) FROM geometry x WHERE x.scan_id = s.scan_id) AS g, (SELECT count(*) FROM by_rank x WHERE x.scan_id = s.scan_id) AS k
      FROM sized s GROUP BY 1)),
  chosen AS (
    SELECT p.scan_id, p.l_pos, p.v_pos, p.strategy FROM (
      SELECT scan_id, l_pos, v_pos, 'row' AS strategy FROM by_row UNION ALL SELECT scan_id, l_pos, v_pos, 'rank' FROM by_rank
      UNION ALL SELECT scan_id, l_pos, v_pos, 'geometry' FROM geometry) p JOIN verdicts USING (scan_id, strategy))"""
# label and values in one line, wrapped values last (they have a higher position), placed by top and left edge
MERGED = """
  , parts AS (
    SELECT c.scan_id, c.l_pos, l.text || ' ' || string_agg(v.text, ' ' ORDER BY v.pos) AS text, least(any_value(l.y0), min(v.y0)) AS y0,
      least(any_value(l.x0), min(v.x0)) AS x0, round_even(((60 + (c.scan_id * 7 + c.l_pos) % 40) / 100.0
        + sum((60 + (c.scan_id * 7 + v.pos) % 40) / 100.0)) / (1 + count(*)), 3) AS confidence
    FROM chosen c JOIN cell_lines l ON l.scan_id = c.scan_id AND l.pos = c.l_pos JOIN cell_lines v ON v.scan_id = c.scan_id AND v.pos = c.v_pos
    GROUP BY c.scan_id, c.l_pos, l.text),
  placed AS (SELECT scan_id, text, confidence, merged, row_number() OVER (PARTITION BY scan_id ORDER BY y0, x0, merged, o) - 1 AS pos FROM (
    SELECT scan_id, text, y0, x0, confidence, TRUE AS merged, row_number() OVER (PARTITION BY scan_id ORDER BY l_pos) AS o FROM parts
    UNION ALL SELECT scan_id, text, y0, x0, NULL, FALSE, pos FROM cell_lines))
  SELECT scan_id, pos, text, confidence FROM placed WHERE merged"""

AMOUNTS = r"""list_filter(regexp_extract_all({t}, '[\d,]+(?:\.\d{{1,2}})?'),
  lambda a: regexp_full_match(replace(a, ',', ''), '\d{{1,9}}(?:\.\d{{1,2}})?')
    AND TRY_CAST(replace(a, ',', '') AS DOUBLE) > 0 AND TRY_CAST(replace(a, ',', '') AS DOUBLE) <= 1000000)"""
USP_RX = (r"(?i)(?:unit\s*sale\s*price|usp)\s*(?:per\s*[a-zA-Z]+)?\s*[:.\s]*(rs\.?|inr|₹)?\s*"
          r"([\d,]+(?:\.\d{1,3})?)\s*(?:per|/)?\s*([a-zA-Z]+)?")
PER_RX = (r"(?i)(rs\.?|inr|₹)?\s*([\d,]+(?:\.\d{1,3})?)\s*(?:/|per\s+)\s*(?:\d+\s*)?"
          r"(g|gm|gms|gram|grams|kg|mg|ml|l|ltr|litre|liter|cl|pc|pcs|piece|unit)\b")
QTY_RX = (r"(?i)(?:net\s*(?:wt\.?|weight|qty\.?|quantity|contents)|(?:\bqty\.?|\bquantity))\s*[:\-.]?\s*"
          r"([\d]+(?:\.\d+)?)\s*([a-zA-Z\.]+)?")
MFG = r"(?i)\b(mfg|mfd|pkd|packed(?:\s*(?:on|date))?|packing\s*date|manufactured(?:\s*(?:on|date))?|manufacturing\s*date|date\s*of\s*(?:manufacture|packing|pack))\b"
EXP = r"(?i)\b(best\s*before|best\s*by|use\s*by|exp(?:iry|ires|iration)?\.?|bbd)\b"
AFTER_MRP = AMOUNTS.format(
    t=r"regexp_extract(text, '(?i)(?:mrp|m\.r\.p\.?|max(?:imum)?\.?\s+retail\s+price)(.{0,40})', 1)")
BARE_OK = AMOUNTS.format(t="bare")
PER_OK = AMOUNTS.format(t=f"regexp_extract(text, '{PER_RX}', 2)")
ALIASES = ("MAP {'gm':'g','gms':'g','grams':'g','gram':'g','kgs':'kg','kilograms':'kg','mls':'ml',"
           "'millilitres':'ml','milliliters':'ml','ltr':'l','ltrs':'l','litre':'l','litres':'l',"
           "'liter':'l','liters':'l'}")
VOCAB = ("['g','kg','ml','l','mg','cm','m','gm','gms','grams','gram','kgs','kilograms','mls',"
         "'millilitres','milliliters','ltr','ltrs','litre','litres','liter','liters']")
VALID = "('g','kg','ml','l','mg','cm','m')"

UNITS = rf"""
readings AS (
  SELECT DISTINCT regexp_extract(text, '{QTY_RX}', 1) AS number,
         nullif(regexp_extract(text, '{QTY_RX}', 2), '') AS raw_unit
  FROM lines WHERE regexp_matches(text, '{QTY_RX}')),
vocab AS (SELECT w, coalesce({ALIASES}[w], w) AS unit FROM (SELECT unnest({VOCAB}) AS w)),
near AS (
  SELECT r.raw_unit, arg_min(v.unit, struct_pack(d := levenshtein(translate(lower(trim(r.raw_unit, '.')), '90158', 'golsb'), v.w), w := v.w)) AS unit
  FROM (SELECT DISTINCT raw_unit FROM readings WHERE raw_unit IS NOT NULL) r, vocab v
  WHERE levenshtein(translate(lower(trim(r.raw_unit, '.')), '90158', 'golsb'), v.w) <= 1 GROUP BY 1),
exact AS (
  SELECT r.*, coalesce({ALIASES}[lower(trim(raw_unit, '.'))], lower(trim(raw_unit, '.'))) AS e, n.unit AS near_unit
  FROM readings r LEFT JOIN near n USING (raw_unit)),
resolved AS (
  SELECT number, raw_unit,
    CASE WHEN raw_unit IS NULL AND regexp_full_match(number, '\d*[1-9]\d*[91]')
         THEN left(number, length(number) - 1) ELSE number END AS value,
    CASE WHEN e IN {VALID} THEN e WHEN raw_unit IS NOT NULL THEN near_unit
         WHEN regexp_full_match(number, '\d*[1-9]\d*9') THEN 'g'
         WHEN regexp_full_match(number, '\d*[1-9]\d*1') THEN 'l' END AS unit,
    CASE WHEN e IN {VALID} AND e = lower(raw_unit) THEN 'exact' WHEN e IN {VALID} THEN 'alias'
         WHEN raw_unit IS NOT NULL AND near_unit IS NOT NULL THEN 'repaired'
         WHEN raw_unit IS NULL AND regexp_full_match(number, '\d*[1-9]\d*[91]') THEN 'swallowed' END AS how
  FROM exact)
"""

CONTEXT = r"""
ctx AS (
  SELECT *, concat_ws(' | ', lag(text, 2) OVER w, lag(text) OVER w, text, lead(text) OVER w, lead(text, 2) OVER w) AS ctx2,
         concat_ws(' | ', lag(text) OVER w, text, lead(text) OVER w) AS ctx1
  FROM lines WINDOW w AS (PARTITION BY scan_id ORDER BY pos))
"""

# evidence of every field as (scan_id, field, value, raw_text, confidence, pos, extras)
FIELDS = rf"""
scans AS (SELECT DISTINCT scan_id FROM lines),
maker AS (
  SELECT scan_id, arg_min(struct_pack(v := v, t := text, c := confidence, tier := tier), struct_pack(
           a := -tier, b := -hint, c := -confidence, p := pos)) AS m
  FROM (SELECT scan_id, pos, text, confidence, tier,
               CASE WHEN regexp_matches(v, '(?i)\b(?:pvt|private|ltd|limited|llp|inc|corp|corporation|industries|foods|food|enterprises|company|co\.?)\b') THEN 1 ELSE 0 END AS hint, v
        FROM (SELECT *, 1 AS tier, trim(regexp_extract(text, '(?i)(?:mfd\.?\s*by|manufactured\s*by|manufactured\s*for|manufacturer|mfg\.?\s*by)\s*[:.\-]?\s+(.+)', 1), ' .,') AS v FROM lines
              UNION ALL
              SELECT *, 0, trim(regexp_extract(text, '(?i)(?:marketed\s*by|packed\s*by|packer|packaged\s*by|imported\s*by|importer)\s*[:.\-]?\s+(.+)', 1), ' .,') FROM lines)
        WHERE v <> '') GROUP BY scan_id),
named AS (
  SELECT scan_id, arg_min(struct_pack(v := v, t := text, c := confidence, how := how),
                          struct_pack(a := tier, s := -score, c := -confidence, p := pos)) AS n FROM (
    SELECT scan_id, pos, text, confidence, 1 AS tier, 0 AS score, 'explicit_label' AS how,
           trim(regexp_extract(text, '(?i)(?:name\s*of\s*commodity|common\s*name|generic\s*name|product\s*name|commodity)\s*[:\-]\s*(.+)', 1), ' .,') AS v FROM lines
    UNION ALL
    SELECT l.scan_id, l.pos, l.text, l.confidence, 3, d.score, 'descriptor_vocabulary', trim(l.text, ' .,')
    FROM lines l JOIN descriptors d ON d.scan_id = l.scan_id AND d.pos = l.pos)
  WHERE v <> '' GROUP BY scan_id),
qty AS (
  SELECT scan_id, arg_min(struct_pack(v := r.value, t := text, c := confidence, unit := r.unit, how := r.how, raw := r.raw_unit), pos) AS q
  FROM lines l JOIN resolved r ON regexp_extract(text, '{QTY_RX}', 1) = r.number
   AND nullif(regexp_extract(text, '{QTY_RX}', 2), '') IS NOT DISTINCT FROM r.raw_unit
  WHERE regexp_matches(text, '{QTY_RX}') GROUP BY scan_id),
priced AS (
  SELECT *, regexp_matches(text, '(?i)(?:mrp|m\.r\.p\.?|max(?:imum)?\.?\s+retail\s+price)') AS is_mrp,
    {AFTER_MRP} AS tail,
    regexp_extract(text, '(?i)(?:rs\.?|inr|₹)\s*([\d,]+(?:\.\d{{1,2}})?)', 1) AS bare,
    regexp_extract(text, '{PER_RX}', 2) AS per_amount
  FROM lines WHERE NOT regexp_matches(text, '(?i)unit\s*sale\s*price|\busp\b') AND NOT regexp_matches(text, '{USP_RX}')
    AND NOT regexp_matches(text, '(?i)\b(orders?|above|minimum|discount|off\b|save|cashback|emi|cod)\b')),
prices AS (
  SELECT scan_id, pos, text, confidence, CASE WHEN is_mrp AND len(tail) > 0 THEN 1 ELSE 2 END AS tier,
    CASE WHEN is_mrp AND len(tail) > 0 THEN coalesce(list_filter(tail, lambda a: contains(a, '.'))[1], tail[1])
         WHEN bare <> '' AND len({BARE_OK}) > 0 AND bare <> per_amount THEN bare END AS amount
  FROM priced),
mrp AS (
  SELECT scan_id, arg_min(struct_pack(v := replace(amount, ',', ''), t := text, c := confidence, tier := tier),
                          struct_pack(a := tier, p := pos)) AS m,
         count(*) FILTER (WHERE tier = 2) AS n
  FROM prices WHERE amount IS NOT NULL GROUP BY scan_id),
usp AS (
  SELECT scan_id, arg_min(struct_pack(v := v, t := text, c := confidence, unit := unit, how := how),
                          struct_pack(a := tier, p := pos)) AS u
  FROM (SELECT scan_id, pos, text, confidence, 1 AS tier, replace(regexp_extract(text, '{USP_RX}', 2), ',', '') AS v,
               nullif(lower(regexp_extract(text, '{USP_RX}', 3)), '') AS unit, 'explicit_label' AS how
        FROM lines WHERE regexp_matches(text, '{USP_RX}')
        UNION ALL
        SELECT scan_id, pos, text, confidence, 2, replace(regexp_extract(text, '{PER_RX}', 2), ',', ''),
               lower(regexp_extract(text, '{PER_RX}', 3)), 'per_unit_form'
        FROM lines WHERE regexp_matches(text, '{PER_RX}')
          AND len({PER_OK}) > 0)
  GROUP BY scan_id),
dims AS (
  SELECT scan_id, arg_min(struct_pack(v := trim(regexp_extract(text, '(?i)(?:dimensions?|size)[:\s]*([\d]+(?:\.\d+)?\s*[xX×]\s*[\d]+(?:\.\d+)?(?:\s*[xX×]\s*[\d]+(?:\.\d+)?)?)\s*(cm|mm|m|in|inch(?:es)?)?', 1)),
           t := text, c := confidence,
           unit := lower(regexp_extract(text, '(?i)(?:dimensions?|size)[:\s]*([\d]+(?:\.\d+)?\s*[xX×]\s*[\d]+(?:\.\d+)?(?:\s*[xX×]\s*[\d]+(?:\.\d+)?)?)\s*(cm|mm|m|in|inch(?:es)?)?', 2))), pos) AS d
  FROM lines WHERE regexp_matches(text, '(?i)(?:dimensions?|size)[:\s]*[\d]+(?:\.\d+)?\s*[xX×]\s*\d') GROUP BY scan_id),
care AS (
  SELECT scan_id, arg_min(struct_pack(v := v, t := text, c := confidence, partial := tier > 1), struct_pack(a := tier, p := pos)) AS c
  FROM (SELECT scan_id, pos, text, confidence, 1 AS tier,
               coalesce(nullif(regexp_extract(text, '(\+?\d[\d\s\-]{{8,14}}\d)', 1), ''), nullif(regexp_extract(text, '[\w.+-]+@[\w-]+\.[\w.-]+'), '')) AS v
        FROM lines WHERE regexp_matches(text, '(?i)consumer\s*care|customer\s*care|customer\s*service|helpline|toll\s*free|for\s+complaints|careline|grievance')
        UNION ALL SELECT scan_id, pos, text, confidence, 2, nullif(regexp_extract(text, '[\w.+-]+@[\w-]+\.[\w.-]+'), '') FROM lines)
  WHERE v IS NOT NULL GROUP BY scan_id),
importers AS (SELECT DISTINCT scan_id FROM lines WHERE regexp_matches(text, '(?i)\bimported\s+by\b')),
origin AS (
  SELECT o.scan_id, o.o, i.scan_id IS NOT NULL AS importer, lower(o.o.v) IN ('india', 'in', 'bharat', 'hindustan') AS indian
  FROM (SELECT scan_id, arg_min(struct_pack(v := trim(regexp_replace(regexp_replace(v, '(?i)\s+(imported\s+by|importer|marketed\s+by|packed\s+by)\b.*$', ''), '[.,;|]\s*\S.*$', ''), ' .,;:-|'), t := text, c := confidence), pos) AS o
        FROM (SELECT *, trim(regexp_extract(text, '(?i)made\s+in\s*[:\-]?\s*(.+)', 1), ' .,') AS v FROM lines)
        WHERE regexp_matches(v, '[A-Za-z]') GROUP BY scan_id) o
  LEFT JOIN importers i USING (scan_id)),
dates AS (
  SELECT scan_id, pos, text, confidence, i, d,
    CASE WHEN regexp_matches(substr(left(text, strpos(text, d) - 1), -24), '{MFG}') AND NOT regexp_matches(substr(left(text, strpos(text, d) - 1), -24), '{EXP}') THEN 'manufacturing'
         WHEN regexp_matches(substr(left(text, strpos(text, d) - 1), -24), '{EXP}') THEN 'best_before_use_by'
         WHEN regexp_matches(text, '{MFG}') THEN 'manufacturing'
         WHEN regexp_matches(ctx1, '{MFG}') THEN 'manufacturing' WHEN regexp_matches(ctx1, '{EXP}') THEN 'best_before_use_by'
         ELSE 'unclear' END AS role,
    try_strptime(d, '%d/%m/%Y') AS day
  FROM (SELECT *, unnest(regexp_extract_all(text, '\b\d{{1,2}}/\d{{1,2}}/\d{{4}}\b')) AS d, unnest(generate_series(1, len(regexp_extract_all(text, '\b\d{{1,2}}/\d{{1,2}}/\d{{4}}\b')))) AS i FROM ctx)),
slots AS (
  SELECT scan_id,
    arg_min(struct_pack(v := d, t := text, c := confidence, role := role), pos * 10 + i) FILTER (WHERE role <> 'best_before_use_by') AS m,
    arg_min(struct_pack(v := d, t := text, c := confidence, role := role), pos * 10 + i) FILTER (WHERE role = 'best_before_use_by') AS e,
    count(*) AS n, count(*) FILTER (WHERE role <> 'unclear') AS roled,
    arg_min(struct_pack(v := d, t := text, c := confidence), day) AS early, arg_max(struct_pack(v := d, t := text, c := confidence), day) AS late,
    min(day) < max(day) AS differ
  FROM dates GROUP BY scan_id),
timed AS (SELECT *, coalesce(m.role <> 'manufacturing', true) AND e IS NULL AND n = 2 AND roled = 0 AND differ AS by_time FROM slots),
found AS (
  SELECT scan_id, 'manufacturer' AS field, m.v AS value, m.t AS raw_text, m.c AS confidence, NULL AS unit, NULL AS unit_status,
         NULL AS currency, CAST(NULL AS BOOLEAN) AS context_confirmed, NULL AS date_role, CAST(NULL AS BOOLEAN) AS origin_conflict,
         CAST(NULL AS BOOLEAN) AS inferred, CAST(NULL AS BOOLEAN) AS partial, 'exact' AS label_match,
         CASE WHEN m.tier = 1 THEN 'manufacturer' ELSE 'packer_importer_marketer' END AS label_type, NULL AS match_method FROM maker
  UNION ALL SELECT scan_id, 'common_name', n.v, n.t, n.c, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, n.how FROM named
  UNION ALL SELECT scan_id, 'net_quantity', q.v, q.t, q.c, q.unit,
         CASE WHEN q.how = 'swallowed' THEN 'ocr_corrected' WHEN q.how IS NOT NULL THEN 'confirmed_present'
              WHEN q.raw IS NOT NULL OR q.c < 0.7 THEN 'ambiguous' ELSE 'confirmed_absent' END,
         NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM qty
  UNION ALL SELECT scan_id, 'mrp', m.v, m.t, m.c, NULL, NULL, 'INR', m.tier = 1 OR n = 1, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM mrp
  UNION ALL SELECT scan_id, 'manufacturing_date', CASE WHEN by_time THEN early.v ELSE m.v END, CASE WHEN by_time THEN early.t ELSE m.t END,
         CASE WHEN by_time THEN early.c ELSE m.c END, NULL, NULL, NULL, NULL, CASE WHEN by_time THEN 'manufacturing' ELSE m.role END, NULL,
         CASE WHEN by_time THEN true END, NULL, NULL, NULL, NULL FROM timed WHERE by_time OR m IS NOT NULL
  UNION ALL SELECT scan_id, 'expiry_date', CASE WHEN by_time THEN late.v ELSE e.v END, CASE WHEN by_time THEN late.t ELSE e.t END,
         CASE WHEN by_time THEN late.c ELSE e.c END, NULL, NULL, NULL, NULL, 'best_before_use_by', NULL,
         CASE WHEN by_time THEN true END, NULL, NULL, NULL, NULL FROM timed WHERE by_time OR e IS NOT NULL
  UNION ALL SELECT scan_id, 'consumer_care', c.v, c.t, c.c, NULL, NULL, NULL, NULL, NULL, NULL, NULL, CASE WHEN c.partial THEN true END, NULL, NULL, NULL FROM care
  UNION ALL SELECT scan_id, 'country_of_origin', o.v, o.t, o.c, NULL, NULL, NULL, NULL, NULL, CASE WHEN importer AND indian THEN true END, NULL, NULL, NULL, NULL, NULL FROM origin
  UNION ALL SELECT scan_id, 'unit_sale_price', u.v, u.t, u.c, u.unit, NULL, 'INR', NULL, NULL, NULL, NULL, NULL, NULL, NULL, u.how FROM usp
  UNION ALL SELECT scan_id, 'dimensions', d.v, d.t, d.c, d.unit, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM dims),
product AS (
  SELECT s.scan_id, CASE WHEN o.scan_id IS NULL THEN CASE WHEN i.scan_id IS NOT NULL THEN true END
                         WHEN o.importer AND o.indian THEN false WHEN o.importer THEN true ELSE NOT o.indian END AS is_imported,
         CASE WHEN f.value IS NOT NULL THEN true END AS may_expire
  FROM scans s LEFT JOIN origin o USING (scan_id) LEFT JOIN importers i USING (scan_id)
  LEFT JOIN (SELECT * FROM found WHERE field = 'expiry_date') f USING (scan_id)),
field_names AS (SELECT unnest(['manufacturer','common_name','net_quantity','mrp','manufacturing_date','expiry_date','consumer_care','country_of_origin','unit_sale_price','dimensions','principal_display_panel_colocation']) AS field,
                       unnest(generate_series(1, 11)) AS ord),
evidence AS (
  SELECT s.scan_id, n.field, n.ord, f.* EXCLUDE (scan_id, field), p.is_imported, p.may_expire
  FROM scans s CROSS JOIN field_names n LEFT JOIN found f ON f.scan_id = s.scan_id AND f.field = n.field
  JOIN product p ON p.scan_id = s.scan_id)
"""

RULES = r"""
texts AS (SELECT * FROM (VALUES
  (1, 'Manufacturer/packer/importer details detected.', 'Manufacturer/packer/importer details not found.', 'Manufacturer/packer/importer text detected but confidence too low to confirm.', 'Not applicable.'),
  (2, 'Commodity name detected.', 'Commodity name not detected.', 'Text present but could not reliably identify the commodity name (e.g. only brand/slogan visible).', 'Not applicable.'),
  (3, 'Net quantity and valid unit detected.', 'Net quantity value found but no unit was declared on the package.', 'Net quantity detected but unit is ambiguous or extraction confidence is low.', 'Not applicable.'),
  (4, 'Valid MRP declaration detected.', 'No MRP declaration found.', 'A price was detected but MRP context is uncertain (e.g. multiple prices present, none confirmed as MRP).', 'Not applicable.'),
  (5, 'Manufacturing/packing date detected and confirmed as manufacturing date.', 'No manufacturing/packing date found.', 'A date was detected but its role (manufacturing vs. best-before/use-by) could not be reliably established.', 'Not applicable.'),
  (6, 'Consumer care details detected.', 'Consumer care details not found.', 'Partial consumer care information found (e.g. only a name, no contact method).', 'Not applicable.'),
  (7, 'Country of origin detected for imported product.', 'Product flagged as imported but no country of origin declared.', 'Import status or country-of-origin evidence is ambiguous.', 'Product not identified as imported; requirement does not apply.'),
  (8, 'Best before/use by date detected and confirmed.', 'Product may expire but no best before/use by date found.', 'A date was detected but its role (manufacturing vs. best-before/use-by) could not be reliably established.', 'Product not identified as perishable/time-sensitive; requirement does not apply.'),
  (9, 'Unit sale price detected.', 'Unit sale price is applicable but not found.', 'Applicability or evidence for unit sale price is ambiguous.', 'Unit sale price does not apply to this package (confirmed exemptions: combination/group/multi-piece package, or food article under FSSAI carve-out. RSP-equals-USP and wholesale-package exemptions are plausible per earlier notes but NOT independently confirmed with bare-text quotes this pass - do not cite them as certain without checking the primary source. The earlier version of this rule also cited an e-commerce exemption for unit sale price specifically; that was NOT confirmed in this verification pass - the confirmed e-commerce carve-out found (Rule 6(10)) applies to the manufacturing-date declaration, not unit sale price - so this claim has been removed pending verification).'),
  (10, 'Dimensions detected for a commodity category where they are relevant.', 'Dimensions are relevant for this commodity but not found.', 'Relevance of dimensions to this commodity category is unclear.', 'Dimensions are not relevant to this commodity category.'),
  (11, 'x', 'x', 'Placement/legibility could not be reliably confirmed from available evidence.', 'x')
) t(rule_no, pass, fail, review, na)),
rule_of AS (SELECT field, CASE field WHEN 'manufacturer' THEN 1 WHEN 'common_name' THEN 2 WHEN 'net_quantity' THEN 3 WHEN 'mrp' THEN 4
  WHEN 'manufacturing_date' THEN 5 WHEN 'consumer_care' THEN 6 WHEN 'country_of_origin' THEN 7 WHEN 'expiry_date' THEN 8
  WHEN 'unit_sale_price' THEN 9 WHEN 'dimensions' THEN 10 ELSE 11 END AS rule_no FROM field_names),
judged AS (
  SELECT e.*, r.rule_no,
    CASE WHEN r.rule_no = 7 AND is_imported IS NULL THEN 'REVIEW' WHEN r.rule_no = 7 AND NOT is_imported THEN 'N/A'
         WHEN r.rule_no = 8 AND may_expire IS NULL THEN 'REVIEW'
         WHEN r.rule_no = 9 THEN 'REVIEW' WHEN r.rule_no = 10 THEN 'N/A' WHEN r.rule_no = 11 THEN 'REVIEW'
         WHEN value IS NULL THEN 'FAIL' WHEN confidence < 0.6 THEN 'REVIEW'
         WHEN r.rule_no = 3 THEN CASE WHEN unit_status = 'ocr_corrected' THEN 'REVIEW'
              WHEN unit IS NULL THEN CASE WHEN unit_status = 'confirmed_absent' THEN 'FAIL' ELSE 'REVIEW' END
              WHEN unit IN ('g','kg','ml','l','mg','cm','m') THEN 'PASS' ELSE 'FAIL' END
         WHEN r.rule_no = 4 AND context_confirmed = false THEN 'REVIEW'
         WHEN r.rule_no IN (5, 8) AND coalesce(date_role, 'unclear') = 'unclear' THEN 'REVIEW'
         WHEN r.rule_no = 5 AND date_role <> 'manufacturing' THEN 'FAIL'
         WHEN r.rule_no = 8 AND date_role <> 'best_before_use_by' THEN 'FAIL'
         WHEN origin_conflict THEN 'REVIEW' ELSE 'PASS' END AS status
  FROM evidence e JOIN rule_of r USING (field)),
results AS (
  SELECT j.scan_id, j.rule_no, 'PCR-R' || lpad(CAST(j.rule_no AS VARCHAR), 2, '0') AS rule_id, j.field, j.status,
    CASE j.status WHEN 'PASS' THEN t.pass WHEN 'FAIL' THEN t.fail WHEN 'REVIEW' THEN t.review ELSE t.na END AS reason,
    j.rule_no < 11 AS scored,
    CASE WHEN j.status = 'N/A' OR (j.status = 'FAIL' AND j.value IS NULL) THEN NULL ELSE j.value END AS value,
    CASE WHEN j.status = 'N/A' OR (j.status = 'FAIL' AND j.value IS NULL) THEN NULL ELSE j.confidence END AS confidence
  FROM judged j JOIN texts t USING (rule_no)),
scores AS (
  SELECT scan_id,
    CAST(coalesce(round_even(100.0 * count(*) FILTER (WHERE scored AND status = 'PASS')
      / nullif(count(*) FILTER (WHERE scored AND status <> 'N/A'), 0), 0), 0) AS INTEGER) AS score,
    CASE WHEN count(*) FILTER (WHERE scored AND status = 'FAIL') > 0 THEN 'NON_COMPLIANT'
         WHEN count(*) FILTER (WHERE scored AND status = 'REVIEW') > 0 THEN 'WARNING' ELSE 'COMPLIANT' END AS overall_status
  FROM results GROUP BY scan_id),
violations AS (
  SELECT scan_id, rule_no, rule_id, field, CASE WHEN status = 'FAIL' THEN 'NON_COMPLIANT' ELSE 'WARNING' END AS status, reason, value
  FROM results WHERE scored AND status IN ('FAIL', 'REVIEW'))
"""

HISTORY = r"""
history AS (
  SELECT 'insp_' || CAST(event_id AS VARCHAR) AS id, 'user ' || CAST(user_id AS VARCHAR) AS name, event_type AS category,
    CASE WHEN event_type IN ('purchase', 'signup') THEN 'COMPLIANT' WHEN event_type = 'error' THEN 'NON_COMPLIANT' ELSE 'WARNING' END AS status,
    least(value, 100.0) AS score, ts AS raw_date, CAST(event_id % 5 AS INTEGER) AS violations_count,
    CAST(event_id % 11 AS INTEGER) AS declarations_count, CAST(event_id % 101 AS DOUBLE) / 100 AS mean_confidence,
    event_id % 10 = 0 AS is_demo
  FROM events)
"""


GATE = "AND coalesce(confidence, 1) >= 0.45"


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts)


def _extraction(tail: str) -> str:
    ctes, select = _descriptors("lines", GATE)
    return _with(LINES, CONTEXT, UNITS, ctes, f"descriptors AS ({select})", FIELDS, RULES) + tail


def _texts() -> str:
    """Catalogue texts as SQL rows: rule number and one text that the search reads."""
    rows = []
    for rule in catalog.RULES:
        number = int(rule["rule_id"][-2:])
        texts = [rule["rule_id"], rule["field"], rule["requirement"], rule["legal_reference"], rule["applicability"]["condition"],
                 rule["validation"]["type"], *rule["outputs"].values(), *rule["evidence_required"]]
        texts += [e[k] for e in catalog.EXCEPTIONS if e["applies_to_rule"] == rule["rule_id"] for k in ("id", "condition", "reasoning")]
        rows += ["({}, '{}')".format(number, t.replace("'", "''")) for t in texts]
    return "(VALUES " + ", ".join(rows) + ") x(rule_no, said)"


def _search(*words: str) -> str:
    found = " OR ".join(f"contains(lower(said), '{w}')" for w in words)
    return _extraction("SELECT scan_id, rule_id, field, status, reason FROM results "
                       f"WHERE rule_no IN (SELECT rule_no FROM {_texts()} WHERE {found})")


_FIELD_COLUMNS = {
    "manufacturer": "label_match, label_type", "common_name": "match_method",
    "net_quantity": "unit, unit_status", "mrp": "currency, context_confirmed",
    "manufacturing_date": "date_role, inferred", "expiry_date": "date_role, inferred",
    "consumer_care": "partial", "country_of_origin": "origin_conflict, is_imported",
    "unit_sale_price": "unit, currency, match_method", "dimensions": "unit",
}


def field_columns(field: str) -> list[str]:
    return ["scan_id", "value", "raw_text", "confidence", *_FIELD_COLUMNS[field].split(", ")]


DOC_LINES = r"""
doc_lines AS (
  SELECT CAST(doc_id AS BIGINT) AS scan_id, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS pos,
         unnest(string_split(text, chr(10))) AS text FROM documents)
"""
#: What the recogniser saw: two images a scan, entries of an image from 0, half a pixel more at twice the size.
PAGES = """
entries AS (
  SELECT scan_id, scan_id % 50 AS k, pos % 3 = 0 AS first, CASE WHEN pos % 3 = 0 THEN 'page10.png' ELSE 'page2.png' END AS path,
         row_number() OVER (PARTITION BY scan_id, pos % 3 = 0 ORDER BY pos) - 1 AS i, trim(text) AS text, confidence,
         pos * 10 AS x0, CAST(y0 AS BIGINT) AS y0, CASE WHEN scan_id % 3 = 0 THEN 0.5 ELSE 0.0 END AS half
  FROM lines)
"""
WORDISH = r"[\p{L}\p{N}_"
NOT_PHONE = (r"(?i)\b(mrp|m\.r\.p|maximum\s+retail|price|rs\.?|inr|net\s*(?:wt|weight|qty|quantity|contents)|batch|lot\s*no|"
             r"fssai|licence|license|best\s*before|use\s*by|mfg|mfd|exp(?:iry)?|pin\s*code|gstin|barcode|ean)\b")

def oracle_sql() -> dict[str, str]:
    from labelscope.operators.audit import DEFAULT_GUIDANCE, GUIDANCE

    q = {}
    q["line_context"] = _with(LINES, CONTEXT) + "SELECT scan_id, pos, ctx1, ctx2 FROM ctx"
    q["label_value_candidates"] = _with(LABEL_TABLE) + """
      , pairs AS (
        SELECT l.scan_id, l.pos, c.pos AS cand_pos,
          CASE WHEN c.x0 >= l.x1 - 4 AND abs((c.y0 + c.y1) / 2.0 - (l.y0 + l.y1) / 2.0) <= 9.6 AND (c.x0 - l.x1) / 16.0 <= 4
               THEN struct_pack(g := round_even((c.x0 - l.x1) / 16.0, 3), d := 0)
               WHEN c.y0 >= l.y1 - 4 AND (least(c.x1, l.x1) > greatest(c.x0, l.x0) OR abs(c.x0 - l.x0) <= 16) AND (c.y0 - l.y1) / 16.0 <= 2
               THEN struct_pack(g := round_even((c.y0 - l.y1) / 16.0, 3), d := 1) END AS s
        FROM cell_lines l JOIN cell_lines c ON c.scan_id = l.scan_id AND c.pos <> l.pos)
      SELECT scan_id, pos, CAST(row_number() OVER (PARTITION BY scan_id, pos ORDER BY s.g, s.d, cand_pos) AS INTEGER) AS place, cand_pos
      FROM pairs WHERE s IS NOT NULL QUALIFY place <= 5"""
    q["table_pairs_rank"] = _with(LABEL_TABLE) + """
      , ranked AS (SELECT *, (y0 + y1) / 2.0 AS mid, row_number() OVER (PARTITION BY scan_id, is_left ORDER BY y0, pos) AS rk,
          count(*) FILTER (WHERE is_left) OVER (PARTITION BY scan_id) AS nl, count(*) FILTER (WHERE NOT is_left) OVER (PARTITION BY scan_id) AS nr FROM cell_lines),
      zipped AS (SELECT l.scan_id, l.pos AS l_pos, v.pos AS v_pos, v.mid - l.mid AS off, l.mid - lag(l.mid) OVER (PARTITION BY l.scan_id ORDER BY l.rk) AS step
                 FROM ranked l JOIN ranked v ON l.scan_id = v.scan_id AND l.rk = v.rk WHERE l.is_left AND NOT v.is_left AND l.nl = l.nr),
      ok AS (SELECT scan_id FROM zipped GROUP BY 1 HAVING median(step) > 0 AND
             greatest(abs(max(off) - median(off)), abs(min(off) - median(off))) <= 0.6 * median(step))
      SELECT scan_id, l_pos, v_pos FROM zipped JOIN ok USING (scan_id)"""
    q["table_pairs_row"] = _with(LABEL_TABLE) + """
      , direct AS (SELECT l.scan_id, l.pos AS l_pos, v.pos AS v_pos, v.y1, v.x0, v.x1, l.row_index
                   FROM cell_lines l JOIN cell_lines v ON l.scan_id = v.scan_id AND l.row_index = v.row_index AND v.column_index > l.column_index
                   WHERE l.is_left AND NOT v.is_left),
      loose AS (SELECT * FROM cell_lines v WHERE NOT is_left AND row_index IS NOT NULL
                AND NOT EXISTS (SELECT 1 FROM direct d WHERE d.scan_id = v.scan_id AND d.v_pos = v.pos)
                AND NOT EXISTS (SELECT 1 FROM cell_lines l WHERE l.scan_id = v.scan_id AND l.is_left AND l.row_index = v.row_index)),
      hosts AS (SELECT w.scan_id, w.pos AS v_pos, w.row_index, arg_max(struct_pack(p := d.l_pos, r := d.row_index), d.y1) AS h
                FROM loose w JOIN direct d ON d.scan_id = w.scan_id AND w.y0 - d.y1 BETWEEN 0 AND 24 AND least(w.x1, d.x1) > greatest(w.x0, d.x0)
                GROUP BY ALL)
      SELECT scan_id, l_pos, v_pos FROM direct
      UNION ALL SELECT scan_id, h.p, v_pos FROM hosts x WHERE NOT EXISTS (
        SELECT 1 FROM cell_lines l WHERE l.scan_id = x.scan_id AND l.is_left AND l.row_index > x.h.r AND l.row_index < x.row_index)"""
    q["unit_resolution"] = _with(LINES, UNITS) + "SELECT number, raw_unit, value, unit, how FROM resolved"
    q["detections_read"] = _with(LINES, PAGES) + """
      , usable AS (SELECT * FROM entries WHERE NOT (first AND k = 7) AND k <> 23 AND NOT (i = 0 AND k IN (11, 13, 17))),
      images AS (SELECT scan_id, first, row_number() OVER (PARTITION BY scan_id ORDER BY first DESC) AS image_index
                 FROM (SELECT DISTINCT scan_id, first FROM usable))
      SELECT scan_id, CAST(image_index AS INTEGER) AS image_index, i AS word_ord, text,
        CAST(round_even(x0 + half, 0) AS INTEGER) AS x0, CAST(round_even(y0 + half, 0) AS INTEGER) AS y0,
        CAST(round_even(x0 + 7 * length(text) + half, 0) AS INTEGER) AS x1, CAST(round_even(y0 + 14 + half, 0) AS INTEGER) AS y1,
        CASE WHEN i = 0 AND k = 19 THEN 0.9 ELSE confidence END AS confidence
      FROM usable JOIN images USING (scan_id, first)"""
    q["detection_errors"] = _with(LINES, PAGES) + """
      SELECT NULL::BIGINT AS scan_id, NULL AS image_path, NULL::INTEGER AS i, 'unreadable record' AS reason, count(*) AS n, count(*) AS records
      FROM (SELECT DISTINCT scan_id FROM entries WHERE first AND k = 7) HAVING count(*) > 0
      UNION ALL SELECT NULL, path, NULL, 'no scan_id', count(*), 0 FROM (SELECT DISTINCT scan_id, path FROM entries WHERE k = 23) GROUP BY path
      UNION ALL SELECT scan_id, path, 0, CASE k WHEN 11 THEN 'no polygon' WHEN 13 THEN 'blank text' ELSE 'no extent' END, 1, 0
      FROM entries WHERE i = 0 AND k IN (11, 13, 17)"""
    # turned, an image has its lines from the last to the first, each from its last word to its first
    q["page_orientation"] = _with(LINES) + r"""
      , sides AS (
        SELECT scan_id, 0 AS side, ord AS y, text FROM lines
        UNION ALL SELECT scan_id, 1, -ord, array_to_string(list_reverse(string_split(text, ' ')), ' ') FROM lines),
      tagged AS (SELECT *, regexp_matches(text, '(?i)\b(m\.?r\.?p|usp|mfd|mfg|manufactured|exp|expiry|use\s*by|best\s*before|batch|net\s*(?:qty|wt|weight|quantity)|pkd|packed)\b') AS is_label
                 FROM sides),
      scored AS (
        SELECT scan_id, side, sum(CASE WHEN is_label THEN 1 + CASE WHEN EXISTS (
            SELECT 1 FROM tagged o WHERE o.scan_id = t.scan_id AND o.side = t.side AND NOT o.is_label
              AND (o.y - t.y) * 20 - 14 BETWEEN 0 AND 28) THEN 0.5 ELSE 0 END ELSE 0 END) AS score
        FROM tagged t GROUP BY ALL),
      frames AS (SELECT scan_id, CAST(max(CASE WHEN side = CASE WHEN scan_id % 4 = 0 THEN 1 ELSE 0 END THEN score END) AS DOUBLE) AS upright_score,
                 CAST(max(CASE WHEN side = CASE WHEN scan_id % 4 = 0 THEN 0 ELSE 1 END THEN score END) AS DOUBLE) AS flipped_score
               FROM scored GROUP BY 1)
      SELECT scan_id, 1 AS image_index, upright_score, flipped_score, CASE WHEN flipped_score > upright_score THEN 1 ELSE 0 END AS frame FROM frames"""
    q["detections_to_lines"] = _with(LINES) + (
        "SELECT scan_id, pos, text FROM lines")
    for field in _FIELD_COLUMNS:
        q[f"extract_{field}"] = _extraction(
            f"SELECT {', '.join(field_columns(field))} FROM evidence WHERE field = '{field}'")
    q["declarations"] = _extraction(
        "SELECT scan_id, CAST(ord AS INTEGER) AS field_ord, field, value, confidence, unit, date_role FROM evidence "
        "WHERE value IS NOT NULL AND ord < 11")
    q["rule_results"] = _extraction(
        "SELECT scan_id, rule_id, field, status, reason, scored, value, confidence FROM results")
    q["scan_scores"] = _extraction("SELECT scan_id, score, overall_status FROM scores")
    q["violations"] = _extraction("SELECT scan_id, rule_id, field, status, reason, value FROM violations")
    chain = " ".join(
        "WHEN " + " OR ".join([f"contains(lower(field), '{w}')" for w in fw] + [f"contains(lower(reason), '{w}')" for w in rw])
        + f" THEN '{text}'" for fw, rw, text in GUIDANCE)
    q["corrective_actions"] = _extraction(
        f"SELECT scan_id, rule_id, field, status, CASE {chain} ELSE '{DEFAULT_GUIDANCE}' END AS guidance FROM violations")
    q["audit_matrix"] = _extraction("""
      , answers AS (SELECT rule_no AS v_no, rule_no AS target FROM rule_of UNION SELECT 3, 9 UNION SELECT 1, 5),
      firsts AS (SELECT v.scan_id, a.target, min(v.rule_no) AS v_no FROM violations v JOIN answers a ON a.v_no = v.rule_no GROUP BY 1, 2),
      failed AS (SELECT f.scan_id, f.target, f.v_no, v.reason FROM firsts f JOIN violations v ON v.scan_id = f.scan_id AND v.rule_no = f.v_no)
      SELECT s.scan_id, 'PCR-R' || lpad(CAST(n.rule_no AS VARCHAR), 2, '0') AS rule_id, n.field,
        CASE WHEN v.reason IS NOT NULL THEN 'FAILED' WHEN e.value IS NOT NULL THEN 'PASSED' ELSE 'VERIFIED' END AS audit_status,
        CASE WHEN v.reason IS NOT NULL THEN v.reason
             WHEN e.value IS NOT NULL THEN 'Detected: "' || e.value || '" (Confidence: ' || CAST(CAST(floor(e.confidence * 100 + 0.5) AS BIGINT) AS VARCHAR) || '%)'
             ELSE 'Statutory declaration verified against standard rules' END AS detail
      FROM scans s CROSS JOIN rule_of n LEFT JOIN failed v ON v.scan_id = s.scan_id AND v.target = n.rule_no
      LEFT JOIN evidence e ON e.scan_id = s.scan_id AND e.field = n.field AND e.ord < 11
      UNION ALL
      SELECT v.scan_id, v.rule_id, v.field, 'FAILED', v.reason FROM violations v
      WHERE NOT EXISTS (SELECT 1 FROM failed f WHERE f.scan_id = v.scan_id AND f.v_no = v.rule_no)""")
    q["audit_counts"] = ("SELECT scan_id, count(*) FILTER (WHERE audit_status = 'FAILED') AS failed, "
                         f"count(*) FILTER (WHERE audit_status <> 'FAILED') AS passed FROM ({q['audit_matrix']}) GROUP BY 1")
    q["audit_violations"] = f"SELECT * FROM ({q['audit_matrix']}) WHERE audit_status = 'FAILED'"
    q["audit_compliant"] = f"SELECT * FROM ({q['audit_matrix']}) WHERE audit_status <> 'FAILED'"
    q["contract_errors"] = """
      SELECT CAST(p_partkey AS BIGINT) AS scan_id, 'EXTRACTION_FAILED' AS error_code,
        CASE p_partkey % 10 WHEN 3 THEN 'net_quantity' WHEN 4 THEN 'mrp' WHEN 5 THEN 'expiry_date' ELSE 'manufacturing_date' END AS field,
        CASE p_partkey % 10 WHEN 3 THEN 'unknown unit_status' WHEN 4 THEN 'confidence out of range'
          WHEN 5 THEN 'image_index out of range' ELSE 'unknown date_role' END AS error
      FROM part WHERE p_partkey % 10 BETWEEN 3 AND 6"""
    q["percent_boxes"] = """
      WITH b AS (SELECT CAST(l_orderkey AS BIGINT) AS scan_id, l_linenumber, CAST(CAST(l_quantity AS BIGINT) - 2 AS DOUBLE) AS x0,
          CAST(l_linenumber * 10 AS DOUBLE) AS y0, CAST(l_partkey % 80 AS DOUBLE) AS x1, CAST(l_suppkey % 60 AS DOUBLE) AS y1,
          CAST(l_partkey % 7 * 10 AS DOUBLE) AS w, CAST(l_suppkey % 5 * 10 AS DOUBLE) AS h FROM lineitem),
      c AS (SELECT *, greatest(0, least(least(x0, x1), w)) AS l, greatest(0, least(greatest(x0, x1), w)) AS r,
          greatest(0, least(least(y0, y1), h)) AS t, greatest(0, least(greatest(y0, y1), h)) AS u FROM b
        WHERE x0 >= 0 AND w > 0 AND h > 0 AND NOT (x0 = x1 AND y0 = y1))
      SELECT scan_id, l_linenumber, l / w * 100 AS left_pct, t / h * 100 AS top_pct,
        greatest(2.0, r - l) / w * 100 AS width_pct, greatest(2.0, u - t) / h * 100 AS height_pct FROM c"""
    q["table_pairs_geometry"] = _with(LABEL_TABLE) + GEOMETRY + " SELECT scan_id, l_pos, v_pos FROM geometry"
    q["table_pairs"] = _with(LABEL_TABLE) + GEOMETRY + STRATEGIES.format(
        row=q["table_pairs_row"], rank=q["table_pairs_rank"]) + " SELECT scan_id, l_pos, v_pos, strategy FROM chosen"
    q["table_merged_lines"] = _with(LABEL_TABLE) + GEOMETRY + STRATEGIES.format(
        row=q["table_pairs_row"], rank=q["table_pairs_rank"]) + MERGED
    q["findings_search"] = _search("sale", "retail price")
    for word in ("fssai", "verified", "government"):
        q[f"findings_search_{word}"] = _search(word)
    q["evidence_by_surface"] = _extraction("""
      SELECT scan_id, 'VIOLATION' AS kind, field, value FROM violations WHERE value IS NOT NULL
      UNION ALL SELECT scan_id, 'DECLARATION', field, value FROM evidence WHERE value IS NOT NULL AND ord < 11""")
    q["field_confidence"] = _extraction(
        "SELECT field, count(*) AS declared, floor(avg(confidence) * 100 * 10 + 0.5) / 10 AS score FROM evidence "
        "WHERE value IS NOT NULL GROUP BY field")
    q["top_violations"] = _extraction("""
      SELECT rule_id, n AS violations, pct AS percentage,
        CASE WHEN pct >= 25 THEN 'CRITICAL' WHEN pct >= 18 THEN 'HIGH' ELSE 'MODERATE' END AS severity
      FROM (SELECT rule_id, count(*) AS n, CAST(floor(count(*) * 100.0 / sum(count(*)) OVER () + 0.5) AS INTEGER) AS pct FROM violations GROUP BY 1)
      ORDER BY n DESC, rule_id LIMIT 4""")
    q["csv_findings"] = _extraction("""
      , head AS (
        SELECT CAST(s.scan_id AS VARCHAR) AS "Inspection ID", coalesce(nullif(trim(n.value), ''), 'Packaged Commodity') AS "Product Name",
               'packaged_commodity' AS "Commodity Type", c.overall_status AS "Overall Status", CAST(c.score AS VARCHAR) AS "Compliance Score", s.scan_id
        FROM scans s JOIN scores c USING (scan_id) LEFT JOIN (SELECT * FROM evidence WHERE field = 'common_name') n USING (scan_id)),
      boxes AS (SELECT e.scan_id, e.field, e.ord, e.value, e.confidence, l.y0 FROM evidence e JOIN lines l ON l.scan_id = e.scan_id AND l.text = e.raw_text)
      SELECT 'VIOLATION' AS "Record Type", h.* EXCLUDE (scan_id), array_to_string(list_transform(string_split(v.field, '_'), lambda w: upper(w[1]) || w[2:]), ' ') AS "Field",
        v.rule_id AS "Rule ID", v.status AS "Status / Severity", coalesce(nullif(v.value, ''), 'N/A') AS "Detected Text / Value", '1' AS "Surface Index",
        CASE WHEN v.value IS NULL THEN 'N/A' ELSE '[0; ' || CAST(CAST(b.y0 AS BIGINT) AS VARCHAR) || '; 300; ' || CAST(CAST(b.y0 AS BIGINT) + 14 AS VARCHAR) || ']' END AS "Bounding Box Coordinates",
        v.reason AS "Finding / Reason", 'N/A' AS "Confidence"
      FROM violations v JOIN head h ON h.scan_id = v.scan_id LEFT JOIN boxes b ON b.scan_id = v.scan_id AND b.field = v.field
      UNION ALL
      SELECT 'DECLARATION', h.* EXCLUDE (scan_id), array_to_string(list_transform(string_split(b.field, '_'), lambda w: upper(w[1]) || w[2:]), ' '),
        'N/A', 'COMPLIANT', b.value, '1', '[0; ' || CAST(CAST(b.y0 AS BIGINT) AS VARCHAR) || '; 300; ' || CAST(CAST(b.y0 AS BIGINT) + 14 AS VARCHAR) || ']',
        'Statutory declaration verified', CAST(CAST(floor(b.confidence * 100 + 0.5) AS BIGINT) AS VARCHAR) || '%'
      FROM boxes b JOIN head h ON h.scan_id = b.scan_id WHERE b.value IS NOT NULL AND b.ord < 11""")
    q["history_from_results"] = _extraction("""
      , conf AS (SELECT scan_id, count(*) AS n, floor(list_reduce(list(CASE WHEN confidence <> 0 THEN confidence ELSE 0.9 END ORDER BY ord), lambda a, b: a + b) / count(*) * 100 + 0.5) / 100 AS m
                 FROM evidence WHERE value IS NOT NULL AND ord < 11 GROUP BY 1)
      SELECT CAST(s.scan_id AS VARCHAR) AS id, s.overall_status AS status, CAST(s.score AS DOUBLE) AS score,
             CAST((SELECT count(*) FROM violations v WHERE v.scan_id = s.scan_id) AS INTEGER) AS violations_count,
             CAST(coalesce(c.n, 0) AS INTEGER) AS declarations_count, coalesce(c.m, 0.92) AS mean_confidence
      FROM scores s LEFT JOIN conf c USING (scan_id)""")

    for name, lines, table, gate in (("descriptor_scores", LINES, "lines", GATE),
                                     ("descriptor_scores_text", DOC_LINES, "doc_lines", "")):
        ctes, select = _descriptors(table, gate)
        q[name] = _with(lines, ctes) + select
    q["consumer_care_text"] = _with(DOC_LINES) + rf"""
      , hits AS (
        SELECT scan_id, pos, 2 AS tier, regexp_extract(text, '[\p{{L}}\p{{N}}_.+-]+@[\p{{L}}\p{{N}}_-]+\.[\p{{L}}\p{{N}}_.-]+') AS v FROM doc_lines
        UNION ALL
        SELECT scan_id, pos, 3, coalesce(
          nullif(regexp_extract(text, '\b(1800[\s\-]?\d{{2,4}}[\s\-]?\d{{3,4}})\b', 1), ''),
          nullif(regexp_extract(text, '(\+91[\s\-]?\d{{5}}[\s\-]?\d{{5}}|\+91[\s\-]?\d{{10}})', 1), ''),
          nullif(regexp_extract(text, '\b(0\d{{2,4}}[\s\-]\d{{6,8}})\b', 1), ''),
          nullif(regexp_extract(text, '(?:^|[^\d])([6-9]\d{{9}})(?:[^\d]|$)', 1), ''), '')
        FROM doc_lines WHERE NOT regexp_matches(text, '{NOT_PHONE}'))
      SELECT scan_id, arg_min(v, struct_pack(t := tier, p := pos)) AS value, min(tier) AS tier FROM hits WHERE v <> '' GROUP BY scan_id"""
    q["dates_text"] = _with(DOC_LINES) + r"""
      , hits AS (SELECT scan_id, pos, text, unnest(regexp_extract_all(text, '(?i)\b(\d{1,2}\s*[/\-., ]?\s*(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\.?\s*[/\-., ]?\s*\d{2,4}|\d{1,2}\s*[/\-.]{1,2}\s*\d{1,2}\s*[/\-.]{1,2}\s*\d{2,4}|\d{4}\s*[/\-.]{1,2}\s*\d{1,2}\s*[/\-.]{1,2}\s*\d{1,2})\b', 1)) AS d FROM doc_lines)
      SELECT scan_id, pos, trim(regexp_replace(d, '([/\-.])[/\-.]+', '\1', 'g')) AS date_text FROM hits"""

    q["labelled_case_eval"] = """
      WITH c AS (SELECT CAST(p_partkey AS BIGINT) AS case_id, p_partkey % 11 + 1 AS r, (p_partkey // 11) % 3 AS applies,
          p_partkey % 7 = 0 AS gone, CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE (p_partkey % 100) / 100.0 END AS conf,
          (p_partkey // 3) % 4 AS u, (p_partkey // 5) % 3 AS cc, (p_partkey // 2) % 4 AS dr, p_partkey % 17 = 0 AS clash,
          ['PASS', 'REVIEW', 'FAIL'][p_partkey % 3 + 1] AS expected FROM part),
      g AS (SELECT *, CASE WHEN r BETWEEN 7 AND 10 AND applies = 2 THEN 'REVIEW' WHEN r BETWEEN 7 AND 10 AND applies = 1 THEN 'N/A'
          WHEN r = 11 THEN 'REVIEW' WHEN gone THEN 'FAIL' WHEN conf < 0.6 THEN 'REVIEW'
          WHEN r = 3 AND u = 3 THEN 'REVIEW' WHEN r = 3 AND u = 1 THEN 'FAIL' WHEN r = 3 AND u = 2 THEN 'REVIEW'
          WHEN r = 4 AND cc = 1 THEN 'REVIEW' WHEN r IN (5, 8) AND dr IN (0, 3) THEN 'REVIEW'
          WHEN r = 5 AND dr = 2 THEN 'FAIL' WHEN r = 8 AND dr = 1 THEN 'FAIL' WHEN clash THEN 'REVIEW' ELSE 'PASS' END AS got FROM c)
      SELECT 'PCR-R' || lpad(CAST(r AS VARCHAR), 2, '0') AS rule_id, expected, got, count(*) AS cases FROM g GROUP BY ALL"""
    q["manifest_check"] = """
      WITH u AS (SELECT CAST(o_orderkey AS BIGINT) AS scan_id, l_linenumber AS n,
          ['jpg', 'PNG', 'webp', 'gif'][CAST((l_partkey % 23) AS INTEGER) % 4 + 1] AS ext, l_partkey, CAST(l_quantity AS BIGINT) % 29 AS len
          FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey),
      c AS (SELECT scan_id, count(n) AS images, count(*) FILTER (WHERE n IS NOT NULL AND ext = 'gif' AND l_partkey % 2 = 0) AS bad,
          count(*) FILTER (WHERE n IS NOT NULL AND len = 0) AS empty,
          arg_min('image_' || n || '.' || ext, n) FILTER (WHERE ext = 'gif' AND l_partkey % 2 = 0) AS bad_name,
          arg_min('image_' || n || '.' || ext, n) FILTER (WHERE len = 0) AS empty_name FROM u GROUP BY 1)
      SELECT scan_id, images, CASE WHEN images = 0 THEN 'MISSING_IMAGES' WHEN images > 3 THEN 'TOO_MANY_IMAGES'
        WHEN bad > 0 THEN 'UNSUPPORTED_FORMAT' WHEN empty > 0 THEN 'INVALID_IMAGE' END AS error_code,
        CASE WHEN images NOT BETWEEN 1 AND 3 THEN NULL WHEN bad > 0 THEN bad_name ELSE empty_name END AS filename FROM c"""
    kpis = """SELECT count(*) AS total, count(*) FILTER (WHERE status = 'COMPLIANT') AS compliant,
        count(*) FILTER (WHERE status = 'NON_COMPLIANT') AS non_compliant, count(*) FILTER (WHERE status = 'WARNING') AS warning,
        coalesce(floor(count(*) FILTER (WHERE status = 'COMPLIANT') * 1000.0 / nullif(count(*), 0) + 0.5) / 10, 0.0) AS compliance_rate,
        CAST(sum(violations_count) AS BIGINT) AS total_violations,
        floor(avg(CASE WHEN mean_confidence <> 0 THEN mean_confidence ELSE 0.92 END) * 1000 + 0.5) / 10 AS avg_confidence FROM history"""
    q["compliance_kpis"] = _with(HISTORY) + kpis
    q["compliance_kpis_7d"] = _with(HISTORY) + kpis + (
        " WHERE CAST(raw_date AS DATE) > (SELECT max(CAST(ts AS DATE)) FROM events) - 7")
    q["daily_trend"] = _with(HISTORY) + """
      , d AS (SELECT CAST(raw_date AS DATE) AS day, count(*) AS total, count(*) FILTER (WHERE status = 'COMPLIANT') AS passed,
              count(*) FILTER (WHERE status = 'NON_COMPLIANT') AS failed FROM history GROUP BY 1),
      s AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM d)
      SELECT s.day, coalesce(total, 0) AS total, coalesce(passed, 0) AS passed, coalesce(failed, 0) AS failed,
             coalesce(floor(passed * 100.0 / total + 0.5), 0.0) AS rate FROM s LEFT JOIN d USING (day)"""
    q["category_compliance"] = _with(HISTORY) + """
      , c AS (SELECT category, count(*) AS total, CAST(floor(count(*) FILTER (WHERE status = 'COMPLIANT') * 100.0 / count(*) + 0.5) AS INTEGER) AS rate FROM history GROUP BY 1)
      SELECT *, CASE WHEN rate >= 94 THEN 'EXCELLENT' WHEN rate >= 90 THEN 'HIGH' WHEN rate >= 75 THEN 'SATISFACTORY' ELSE 'ATTENTION' END AS band FROM c"""
    q["score_bands"] = _with(HISTORY) + """
      SELECT CASE WHEN greatest(0, least(100, floor(score + 0.5))) >= 85 THEN 'High Compliance'
                  WHEN greatest(0, least(100, floor(score + 0.5))) >= 60 THEN 'Violations Detected' ELSE 'Severe Non-Compliance' END AS band,
             count(*) AS scans FROM history GROUP BY 1"""
    q["history_search"] = _with(HISTORY) + """
      SELECT id, name, category, status, score, is_demo FROM history WHERE status = 'COMPLIANT' AND NOT is_demo
        AND (contains(lower(name), 'user 1') OR contains(id, 'user 1') OR contains(category, 'user 1'))"""
    q["history_upsert"] = _with(HISTORY) + """
      , latest AS (SELECT name AS id, arg_max(struct_pack(s := status, c := score, d := raw_date), struct_pack(d := raw_date, i := id)) AS i
                   FROM history WHERE NOT is_demo GROUP BY 1)
      SELECT id, i.s AS status, i.c AS score, i.d AS raw_date FROM latest"""
    for name, order in (("date", "raw_date DESC"), ("score", "score")):
        q[f"history_sort_{name}"] = _with(HISTORY) + (
            f"SELECT row_number() OVER (ORDER BY {order}, id) AS place, id, score, raw_date FROM history")
    q["history_load"] = _with(HISTORY) + (
        "SELECT id, status, CASE WHEN is_demo THEN 1 ELSE 0 END AS source_rank FROM history")
    return q


def _descriptors(table: str, gate: str) -> tuple[str, str]:
    """CTEs up to the known words, and the SELECT that scores lines with them."""
    from labelscope.functions.patterns import DESCRIPTORS

    words = "[" + ",".join(f"'{w}'" for w in DESCRIPTORS) + "]"
    ctes = rf"""
      vocabulary AS (SELECT unnest({words}) AS word),
      eligible AS (SELECT scan_id, pos, trim(text, ' .,') AS t FROM {table} WHERE trim(text, ' .,') <> '' AND length(trim(text, ' .,')) <= 60 {gate}
        AND NOT regexp_matches(trim(text, ' .,'), '(?i)\b(ingredients?|nutrition|nutritional|allergen|contains|energy|protein|carbohydrate|fat|sodium|recipe|serving|directions?|storage|manufactured|marketed|packed\s*by|imported|customer\s*care|consumer\s*care|mrp|maximum\s+retail|net\s*(?:wt|weight|qty|quantity)|best\s*before|use\s*by|batch|lot\s*no|fssai|licence|license)\b')),
      tokens AS (SELECT DISTINCT scan_id, pos, unnest(regexp_extract_all(lower(t), '[a-z]+')) AS token FROM eligible),
      known AS (
        SELECT token, min(word) AS word FROM (SELECT DISTINCT token FROM tokens) CROSS JOIN vocabulary
        WHERE token = word OR (NOT list_contains({words}, token) AND length(word) >= 5 AND (
          (length(token) = 4 AND length(word) = 5 AND levenshtein(token, word) = 1)
          OR (length(token) BETWEEN 5 AND 7 AND levenshtein(token, word) <= 1)
          OR (length(token) >= 8 AND levenshtein(token, word) <= 2))) GROUP BY token)
"""
    return ctes, (" SELECT scan_id, pos, CAST(count(DISTINCT word) AS INTEGER) AS score "
                  "FROM tokens JOIN known USING (token) GROUP BY ALL")
