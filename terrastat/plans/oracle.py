"""SQL for the registered queries, run by another engine on the same tables.

Written from the definitions, one branch or aggregate per question, not from the Spark plans.
Sums are cast to BIGINT, doubles rounded as in the query.
"""

from __future__ import annotations

_ESTABLISHMENTS = """
est AS (
  SELECT c_custkey AS cue, c_nationkey AS p, c_mktsegment AS d FROM customer
)"""

_BRIDGE = """
bridge AS (
  SELECT DISTINCT o_custkey AS cue,
         CAST(substring(o_orderpriority, 1, 1) AS INTEGER) - 1 AS tipo
  FROM orders
)"""

_PEOPLE = """
people AS (
  SELECT c_nationkey AS p, c_mktsegment AS d, p_size AS age, CAST(l_quantity AS BIGINT) AS n
  FROM customer
  JOIN orders ON o_custkey = c_custkey
  JOIN lineitem ON l_orderkey = o_orderkey
  JOIN part ON p_partkey = l_partkey
)"""

_HEADCOUNT = """
people AS (
  SELECT c_nationkey AS p, c_mktsegment AS d, CAST(l_quantity AS BIGINT) AS n
  FROM customer
  JOIN orders ON o_custkey = c_custkey
  JOIN lineitem ON l_orderkey = o_orderkey
)"""

_BANDS = """
nursery AS (
  SELECT p, d, CAST(sum(n) AS BIGINT) AS total FROM people WHERE age <= 5 GROUP BY p, d
),
primaries AS (
  SELECT p, d, CAST(sum(n) AS BIGINT) AS total FROM people
  WHERE p % 2 = 0 AND age BETWEEN 6 AND 12 GROUP BY p, d
  UNION ALL
  SELECT p, d, CAST(sum(n) AS BIGINT) AS total FROM people
  WHERE p % 2 = 1 AND age BETWEEN 6 AND 13 GROUP BY p, d
),
secondaries AS (
  SELECT p, d, CAST(sum(n) AS BIGINT) AS total FROM people
  WHERE p % 2 = 0 AND age BETWEEN 13 AND 19 GROUP BY p, d
  UNION ALL
  SELECT p, d, CAST(sum(n) AS BIGINT) AS total FROM people
  WHERE p % 2 = 1 AND age BETWEEN 14 AND 19 GROUP BY p, d
)"""

_PRIMARY_AGES = """
ages AS (
  SELECT DISTINCT s_nationkey AS p, 12 + s_nationkey % 3 AS last_age
  FROM supplier WHERE s_nationkey % 7 <> 0
)"""

_LEVELS = """
pairs AS (
  SELECT p, d, tipo FROM est JOIN bridge USING (cue)
),
by_level AS (
  SELECT p, d,
         count(*) FILTER (WHERE tipo < 2) AS nursery_n,
         count(*) FILTER (WHERE tipo = 2) AS primary_n,
         count(*) FILTER (WHERE tipo > 2) AS secondary_n
  FROM pairs GROUP BY p, d
)"""

_LEVEL_ROWS = f"""
{_ESTABLISHMENTS}, {_BRIDGE}, {_PEOPLE}, {_BANDS}, {_LEVELS},
report AS (
  SELECT n_name AS prov, d AS dept,
         nursery_n, nursery.total AS nursery_people,
         primary_n, primaries.total AS primary_people,
         secondary_n, secondaries.total AS secondary_people
  FROM by_level
  JOIN nursery USING (p, d)
  JOIN primaries USING (p, d)
  JOIN secondaries USING (p, d)
  JOIN nation ON n_nationkey = p
)"""

_POINTS = f"""
{_LEVEL_ROWS},
points AS (
  SELECT 'Jardines' AS nivel, CAST(nursery_people AS DOUBLE) AS x, CAST(nursery_n AS DOUBLE) AS y
  FROM report
  UNION ALL
  SELECT 'Primarias', CAST(primary_people AS DOUBLE), CAST(primary_n AS DOUBLE) FROM report
  UNION ALL
  SELECT 'Secundario', CAST(secondary_people AS DOUBLE), CAST(secondary_n AS DOUBLE) FROM report
)"""

_FIT = f"""
{_POINTS},
fit AS (
  SELECT nivel, regr_slope(y, x) AS m, regr_intercept(y, x) AS b, regr_r2(y, x) AS r2,
         min(x) AS lo, max(x) AS hi, count(*) AS n
  FROM points GROUP BY nivel
)"""

_RAW_REPORT = """
raw AS (
  SELECT o_orderkey AS seq,
         CASE WHEN o_orderkey = (SELECT max(o_orderkey) FROM orders) THEN 'RESUMEN'
              WHEN o_orderpriority = '1-URGENT'
                THEN 'AREA # ' || lpad(CAST(o_custkey AS VARCHAR), 5, '0')
              WHEN o_orderstatus = 'P' THEN 'Total'
              ELSE CAST(o_custkey % 111 AS VARCHAR) END AS label,
         CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderpriority
              ELSE CAST(CAST(trunc(o_totalprice) AS BIGINT) AS VARCHAR) END AS cell
  FROM orders
)"""

_FAULTS = """
codes AS (
  SELECT c_custkey AS seq,
         CAST((c_nationkey + 1) * 1000000 + (c_custkey % 15 + 1) * 1000 + 7 AS VARCHAR) AS digits
  FROM customer
),
typed_codes AS (
  SELECT seq, CASE seq % 13 WHEN 0 THEN NULL WHEN 1 THEN substring(digits, 1, 6)
                            WHEN 2 THEN 'x' || substring(digits, 2, 7) WHEN 3 THEN 's/d'
                            ELSE digits END AS raw
  FROM codes
),
keys AS (
  SELECT s_suppkey AS seq, CAST((s_nationkey + 1) * 1000 + (s_suppkey % 5) * 7 AS VARCHAR) AS digits
  FROM supplier
),
typed_keys AS (
  SELECT seq, CASE seq % 7 WHEN 0 THEN NULL WHEN 1 THEN '12'
                           WHEN 2 THEN 'abc' || substring(digits, 1, 2) ELSE digits END AS raw
  FROM keys
),
raw_lines AS (
  SELECT o_orderkey AS seq,
         CASE WHEN o_orderkey = (SELECT max(o_orderkey) FROM orders) THEN 'RESUMEN'
              WHEN o_orderpriority = '1-URGENT'
                THEN 'AREA # ' || CASE WHEN o_custkey % 17 = 3 THEN 's/d'
                                       ELSE lpad(CAST(o_custkey AS VARCHAR), 5, '0') END
              WHEN o_orderstatus = 'P' THEN 'Total'
              WHEN o_custkey % 17 = 6 THEN '85 y más'
              ELSE CAST(o_custkey % 111 AS VARCHAR) END AS label,
         CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderpriority
              WHEN o_custkey % 17 = 4 THEN NULL
              WHEN o_custkey % 17 = 5 THEN 'muchos'
              ELSE CAST(CAST(trunc(o_totalprice) AS BIGINT) AS VARCHAR) END AS cell
  FROM orders
),
lines AS (
  SELECT l.seq, l.label, l.cell, replace(h.label, 'AREA # ', '') AS area
  FROM raw_lines l ASOF LEFT JOIN (SELECT * FROM raw_lines WHERE label LIKE 'AREA%') h ON h.seq <= l.seq
  WHERE l.label NOT LIKE 'AREA%' AND lower(l.label) <> 'total' AND l.label <> 'RESUMEN'
),
faults AS (
  SELECT 'codes' AS source, 'customer' AS path, seq AS position, 'cod_loc' AS "column", raw,
         CASE WHEN raw IS NULL THEN 'missing' ELSE 'not 7 or 8 digits' END AS reason
  FROM typed_codes WHERE raw IS NULL OR NOT regexp_full_match(raw, '[0-9]{7,8}')
  UNION ALL
  SELECT 'keys', 'supplier', seq, 'glued', raw,
         CASE WHEN raw IS NULL THEN 'missing' ELSE 'not 4 or 5 digits' END
  FROM typed_keys WHERE raw IS NULL OR NOT regexp_full_match(raw, '[0-9]{4,5}')
  UNION ALL
  SELECT 'lines', 'orders', seq, 'area_code', area,
         CASE WHEN area IS NULL THEN 'missing' ELSE 'not an area code' END
  FROM lines WHERE area IS NULL OR area = 's/d'
  UNION ALL
  SELECT 'lines', 'orders', seq, 'Edad', label, 'not a whole number'
  FROM lines WHERE label = '85 y más'
  UNION ALL
  SELECT 'lines', 'orders', seq, 'Casos', cell,
         CASE WHEN cell IS NULL THEN 'missing' ELSE 'not a whole number' END
  FROM lines WHERE cell IS NULL OR cell = 'muchos'
)"""

_MAIL = """
centres AS (
  SELECT event_id AS id, CAST(user_id % 25 AS INTEGER) AS p, event_type AS d, value,
         CASE event_id % 8
           WHEN 0 THEN NULL
           WHEN 1 THEN ' A' || CAST(event_id % 5 AS VARCHAR) || '@Mail'
                       || CAST(user_id % 3 AS VARCHAR) || '.Com '
           WHEN 2 THEN 'a@x.org, b@y.org'
           WHEN 3 THEN 'a@x.org b@y.org'
           WHEN 4 THEN 's/d'
           WHEN 5 THEN 'a@x.org,b@z.org'
           WHEN 6 THEN 'u@'
           ELSE 'c@' || event_type || '.net'
         END AS mail
  FROM events
),
addresses AS (
  SELECT id, p, d,
         CASE WHEN strpos(head, '@') > 0 THEN translate(head, ' ,', '') END AS address
  FROM (
    SELECT id, p, d,
           split_part(trim(mail), CASE WHEN strpos(mail, ',') > 0 THEN ',' ELSE ' ' END, 1) AS head
    FROM centres
  )
)"""

_SUPPLIER_CENTRES = """
centres AS (
  SELECT s_suppkey AS id, s_nationkey AS p,
         CASE s_suppkey % 5 WHEN 0 THEN 'AUTOMOBILE' WHEN 1 THEN 'BUILDING'
              WHEN 2 THEN 'FURNITURE' WHEN 3 THEN 'HOUSEHOLD' ELSE 'MACHINERY' END AS d
  FROM supplier
)"""

_SPINE = """
spine AS (
  SELECT DISTINCT c_nationkey AS p, c_mktsegment AS d, c_mktsegment AS name FROM customer
  UNION ALL
  SELECT n_nationkey, 'ALL', 'City' FROM nation WHERE n_nationkey = 2
)"""

_AREA_COUNTS = f"""
{_ESTABLISHMENTS},
areas AS (
  SELECT n_name AS nombre, d AS id_depto, count(*) AS n
  FROM est JOIN nation ON n_nationkey = p GROUP BY n_name, d
)"""

_BOX = f"""
{_AREA_COUNTS},
quart AS (
  SELECT nombre, count(*) AS points, quantile_cont(n, 0.25) AS q1,
         quantile_cont(n, 0.5) AS median, quantile_cont(n, 0.75) AS q3
  FROM areas GROUP BY nombre
),
marked AS (
  SELECT areas.*, points, q1, median, q3,
         n < q1 - 1.5 * (q3 - q1) OR n > q3 + 1.5 * (q3 - q1) AS far
  FROM areas JOIN quart USING (nombre)
)"""

_FLAGS = " UNION ALL ".join(
    f"SELECT CASE WHEN starts_with(o_orderpriority, '{i}') THEN '1' ELSE ' ' END AS cell FROM orders"
    for i in range(1, 6)
)

ORACLE_SQL = {
    "dense_row_id": """
        SELECT CAST(row_number() OVER (ORDER BY o_orderkey) AS BIGINT) AS row_id, o_orderkey
        FROM orders""",
    "dense_row_id_by_customer": """
        SELECT CAST(row_number() OVER (ORDER BY o_custkey, o_orderkey) AS BIGINT) AS row_id,
               o_custkey, o_orderkey
        FROM orders""",
    "dense_row_id_by_name": """
        SELECT row_number() OVER (ORDER BY 'customer ' || o_custkey, o_orderkey) AS row_id,
               'customer ' || o_custkey AS customer, o_orderkey
        FROM orders""",
    "dense_row_id_by_two_keys": """
        SELECT row_number() OVER (ORDER BY o_orderpriority, o_custkey, o_orderkey) AS row_id,
               o_orderpriority, o_custkey, o_orderkey
        FROM orders""",
    "forward_fill": """
        SELECT o_orderkey,
               last_value(c IGNORE NULLS) OVER w AS customer,
               last_value(s IGNORE NULLS) OVER w AS status
        FROM (
          SELECT o_orderkey,
                 CASE WHEN o_orderstatus = 'F' THEN o_custkey END AS c,
                 CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderstatus END AS s
          FROM orders
        )
        WINDOW w AS (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "truncate_at_sentinel": """
        SELECT o_orderkey, o_custkey FROM orders
        WHERE o_orderkey < (
          SELECT min(o_orderkey) FROM orders
          WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders)
        )""",
    "truncate_by_document": """
        WITH cuts AS (
          SELECT o_orderkey // 1000 AS doc, min(o_orderkey) AS cut FROM orders
          WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 490000 GROUP BY 1
        )
        SELECT o_orderkey // 1000 AS document, o_orderkey
        FROM orders LEFT JOIN cuts ON doc = o_orderkey // 1000
        WHERE cut IS NULL OR o_orderkey < cut""",
    "sectioned_report": f"""
        WITH {_RAW_REPORT},
        marked AS (
          SELECT *,
                 CASE WHEN label LIKE 'AREA%' THEN replace(label, 'AREA # ', '') END AS code,
                 CASE WHEN label = 'RESUMEN' THEN 1 END AS summary
          FROM raw WHERE lower(label) NOT IN ('nan', 'total', 'edad')
        ),
        filled AS (
          SELECT label, cell, last_value(code IGNORE NULLS) OVER w AS code,
                 last_value(summary IGNORE NULLS) OVER w AS summary
          FROM marked
          WINDOW w AS (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
        )
        SELECT CAST(substring(code, 1, 2) AS INTEGER) AS id_prov,
               CAST(substring(code, 3, 3) AS INTEGER) AS id_depto,
               CAST(label AS INTEGER) AS "Edad", CAST(cell AS INTEGER) AS "Casos",
               code IS NULL AS is_reject
        FROM filled WHERE summary IS NULL AND label NOT LIKE 'AREA%'""",
    "not_in_null_drop": """
        SELECT o_orderkey, o_orderpriority AS label FROM orders
        WHERE o_orderstatus <> 'P' AND o_orderpriority NOT IN ('1-URGENT', '5-LOW')""",
    "code_decode": """
        WITH codes AS (
          SELECT c_custkey, c_nationkey,
                 CAST((c_nationkey + 1) * 1000000 + (c_custkey % 15 + 1) * 1000 + 7 AS VARCHAR)
                   AS digits
          FROM customer
        ),
        typed AS (
          SELECT c_custkey, c_nationkey,
                 CASE c_custkey % 13 WHEN 0 THEN NULL WHEN 1 THEN substring(digits, 1, 6)
                      WHEN 2 THEN 'x' || substring(digits, 2, 7) WHEN 3 THEN 's/d'
                      ELSE digits END AS code
          FROM codes
        )
        SELECT c_custkey,
               TRY_CAST(CASE WHEN length(code) = 7 THEN substring(code, 1, 1)
                             ELSE substring(code, 1, 2) END AS INTEGER) AS id_prov,
               CASE WHEN c_nationkey = 1 THEN TRY_CAST(substring(code, 3, 2) AS INTEGER) * 7
                    WHEN length(code) = 7 THEN TRY_CAST(substring(code, 2, 3) AS INTEGER)
                    ELSE TRY_CAST(substring(code, 3, 3) AS INTEGER) END AS id_depto,
               NOT coalesce(regexp_full_match(code, '[0-9]{7,8}'), FALSE) AS is_reject
        FROM typed""",
    "composite_key_split": """
        WITH digits AS (
          SELECT s_suppkey, CAST((s_nationkey + 1) * 1000 + (s_suppkey % 5) * 7 AS VARCHAR) AS d
          FROM supplier
        ),
        typed AS (
          SELECT s_suppkey, CASE s_suppkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '12'
                                 WHEN 2 THEN 'abc' || substring(d, 1, 2) ELSE d END AS k
          FROM digits
        )
        SELECT s_suppkey,
               TRY_CAST(substring(k, 1, CASE WHEN length(k) = 4 THEN 1 ELSE 2 END) AS INTEGER)
                 AS id_prov,
               TRY_CAST(substring(k, CASE WHEN length(k) = 4 THEN 2 ELSE 3 END) AS INTEGER)
                 AS id_depto,
               NOT coalesce(regexp_full_match(k, '[0-9]{4,5}'), FALSE) AS is_reject
        FROM typed""",
    "reject_table": f"WITH {_FAULTS} SELECT * FROM faults",
    "reject_counts": f"""
        WITH {_FAULTS},
        totals AS (
          SELECT 'codes' AS source, count(*) AS total FROM typed_codes
          UNION ALL SELECT 'keys', count(*) FROM typed_keys
          UNION ALL SELECT 'lines', count(*) FROM lines
        )
        SELECT t.source, total, count(DISTINCT position) AS rejected, count(f.position) AS faults
        FROM totals t LEFT JOIN faults f ON f.source = t.source GROUP BY t.source, total""",
    "key_remap": """
        SELECT c_custkey, c_nationkey AS id_prov,
               CAST(CASE WHEN c_nationkey = 4 AND c_custkey % 20 = 8 THEN 7
                         WHEN c_nationkey = 4 AND c_custkey % 20 = 15 THEN 14
                         ELSE c_custkey % 20 END AS INTEGER) AS id_depto
        FROM customer""",
    "first_email": f"""
        WITH {_MAIL}
        SELECT id AS id_cc, address AS mail, lower(split_part(address, '@', 2)) AS domain
        FROM addresses""",
    "unpivot_flags": f"""
        WITH {_BRIDGE}
        SELECT cue AS "Cueanexo", tipo AS id_tipo_establecimiento FROM bridge""",
    "dimension_extract": f"""
        WITH {_SPINE}
        SELECT p AS id_prov, d AS id_depto, name AS nombre FROM spine""",
    "type_dimension": f"""
        WITH {_BRIDGE},
        types(id_tipo_establecimiento, tipo_establecimiento) AS (
          VALUES (0, 'Jardin_maternal'), (1, 'Jardin_infantes'), (2, 'Primario'),
                 (3, 'Secundario'), (4, 'Secundario_tecnico')
        )
        SELECT id_tipo_establecimiento, tipo_establecimiento, count(*) AS establishments
        FROM types JOIN bridge ON tipo = id_tipo_establecimiento GROUP BY ALL""",
    "province_lookup": f"""
        WITH {_ESTABLISHMENTS}
        SELECT cue AS "Cueanexo", n_name AS nombre FROM est JOIN nation ON n_nationkey = p""",
    "department_lookup": f"""
        WITH {_SUPPLIER_CENTRES},
        dept AS (SELECT DISTINCT c_nationkey AS p, c_mktsegment AS d FROM customer)
        SELECT id AS id_cc, p AS id_prov, d AS nombre FROM centres JOIN dept USING (p, d)""",
    "band_sum": f"""
        WITH {_PEOPLE}, {_BANDS}
        SELECT p AS id_prov, d AS id_depto, total AS "Poblacion_primaria" FROM primaries""",
    "bands_wide": f"""
        WITH {_PEOPLE}, {_BANDS}
        SELECT p AS id_prov, d AS id_depto, nursery.total AS "Poblacion_jardin",
               primaries.total AS "Poblacion_primaria",
               secondaries.total AS "Poblacion_secundaria"
        FROM nursery JOIN primaries USING (p, d) JOIN secondaries USING (p, d)""",
    "bands_by_table": f"""
        WITH {_PEOPLE}, {_PRIMARY_AGES},
        aged AS (SELECT p, d, age, n, last_age FROM people LEFT JOIN ages USING (p)),
        summed AS (
          SELECT p, d,
                 sum(n) FILTER (WHERE age <= 5) AS jardin,
                 sum(n) FILTER (WHERE age > 5 AND age <= last_age) AS primaria,
                 sum(n) FILTER (WHERE age > last_age AND age <= 19) AS secundaria
          FROM aged GROUP BY p, d
        )
        SELECT p AS id_prov, d AS id_depto, CAST(jardin AS BIGINT) AS "Poblacion_jardin",
               CAST(primaria AS BIGINT) AS "Poblacion_primaria",
               CAST(secundaria AS BIGINT) AS "Poblacion_secundaria"
        FROM summed
        WHERE jardin IS NOT NULL AND primaria IS NOT NULL AND secundaria IS NOT NULL""",
    "provinces_without_edge": f"""
        WITH {_PRIMARY_AGES}
        SELECT DISTINCT c_nationkey AS id_prov FROM customer
        WHERE c_nationkey NOT IN (SELECT p FROM ages)""",
    "level_pivot": f"""
        WITH {_ESTABLISHMENTS}, {_BRIDGE}, {_LEVELS}
        SELECT p AS id_prov, d AS id_depto, nursery_n AS "Jardines", primary_n AS "Primarias",
               secondary_n AS "Secundario"
        FROM by_level""",
    "totals_with_override": f"""
        WITH {_ESTABLISHMENTS}
        SELECT p AS id_prov, d AS id_depto, count(DISTINCT cue) AS "Cantidad_ee"
        FROM est GROUP BY p, d
        UNION
        SELECT 2, 'ALL', count(DISTINCT cue) FROM est WHERE p = 2""",
    "estimated_totals": f"""
        WITH {_ESTABLISHMENTS},
        totals AS (
          SELECT p, d, count(DISTINCT cue) AS n FROM est GROUP BY p, d
          UNION
          SELECT 2, 'ALL', count(DISTINCT cue) FROM est WHERE p = 2
        )
        SELECT p AS id_prov, d AS id_depto, n AS "Cantidad_ee", TRUE AS is_near FROM totals""",
    "population_totals": f"""
        WITH {_HEADCOUNT}
        SELECT p AS id_prov, d AS id_depto, CAST(sum(n) AS BIGINT) AS "Personas"
        FROM people GROUP BY p, d
        UNION
        SELECT 2, 'ALL', CAST(sum(n) AS BIGINT) FROM people WHERE p = 2""",
    "consulta_levels": f"""
        WITH {_LEVEL_ROWS}
        SELECT prov AS "Provincia", dept AS "Departamento",
               nursery_n AS "Jardines", nursery_people AS "Poblacion_jardin",
               primary_n AS "Primarias", primary_people AS "Poblacion_primaria",
               secondary_n AS "Secundario", secondary_people AS "Poblacion_secundaria"
        FROM report""",
    "threshold_count": """
        SELECT n_name AS "Provincia", upper(event_type) AS "Departamento",
               count(*) AS "Cantidad_mayor_20"
        FROM events JOIN nation ON n_nationkey = user_id % 25
        WHERE value > 20 GROUP BY 1, 2""",
    "threshold_with_gaps": """
        SELECT n_name AS "Provincia", upper(event_type) AS "Departamento",
               count(*) AS "Cantidad_mayor_20"
        FROM events JOIN nation ON n_nationkey = user_id % 25
        WHERE value > 20 AND event_id % 5 > 1 GROUP BY 1, 2""",
    "coverage_report": f"""
        WITH {_SPINE}, {_ESTABLISHMENTS}, {_SUPPLIER_CENTRES}, {_HEADCOUNT},
        ee AS (
          SELECT p, d, count(DISTINCT cue) AS n FROM est GROUP BY p, d
          UNION ALL SELECT 2, 'ALL', count(DISTINCT cue) FROM est WHERE p = 2
        ),
        cc AS (SELECT p, d, count(*) AS n FROM centres GROUP BY p, d),
        pp AS (
          SELECT p, d, sum(n) AS n FROM people GROUP BY p, d
          UNION ALL SELECT 2, 'ALL', sum(n) FROM people WHERE p = 2
        )
        SELECT n_name AS "Provincia", name AS "Departamento", ee.n AS "Cantidad_ee",
               cc.n AS "Cantidad_cc", CAST(pp.n AS BIGINT) AS "Personas"
        FROM spine
        JOIN nation ON n_nationkey = spine.p
        LEFT JOIN ee ON ee.p = spine.p AND ee.d = spine.d
        LEFT JOIN cc ON cc.p = spine.p AND cc.d = spine.d
        LEFT JOIN pp ON pp.p = spine.p AND pp.d = spine.d""",
    "dominant_domain": f"""
        WITH {_MAIL},
        ranked AS (
          SELECT p, d, domain, rank() OVER (PARTITION BY p, d ORDER BY count(*) DESC) AS place
          FROM (SELECT p, d, lower(split_part(address, '@', 2)) AS domain FROM addresses)
          WHERE domain IS NOT NULL GROUP BY p, d, domain
        )
        SELECT n_name AS "Provincia", upper(d) AS "Departamento",
               domain AS "Dominio_mas_frecuente"
        FROM ranked JOIN nation ON n_nationkey = p WHERE place = 1""",
    "count_by_province": """
        SELECT n_name AS provincia, count(event_id) AS cantidad_cc
        FROM events JOIN nation ON n_nationkey = user_id % 25 GROUP BY n_name""",
    "group_median": f"""
        WITH {_AREA_COUNTS}
        SELECT nombre, count(*) AS points, CAST(median(n) AS DOUBLE) AS median
        FROM areas GROUP BY nombre""",
    "price_median": """
        SELECT c_nationkey AS id_prov, count(*) AS points,
               round(quantile_cont(l_extendedprice, 0.25), 4) AS q1,
               round(quantile_cont(l_extendedprice, 0.5), 4) AS median
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        GROUP BY c_nationkey""",
    "estimated_quartiles": """
        SELECT c_nationkey AS id_prov, count(*) AS points, TRUE AS q1_is_near,
               TRUE AS median_is_near, TRUE AS q3_is_near
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        GROUP BY c_nationkey""",
    "box_stats": f"""
        WITH {_BOX}
        SELECT nombre, points, q1, median, q3,
               least(q1, CAST(min(n) FILTER (WHERE NOT far) AS DOUBLE)) AS whisker_low,
               greatest(q3, CAST(max(n) FILTER (WHERE NOT far) AS DOUBLE)) AS whisker_high,
               count(*) FILTER (WHERE far) AS outliers,
               CAST(row_number() OVER (ORDER BY median, nombre) AS INTEGER) AS plot_order
        FROM marked GROUP BY nombre, points, q1, median, q3""",
    "box_outliers": f"""
        WITH {_BOX}
        SELECT nombre, id_depto, n AS "Cantidad" FROM marked WHERE far""",
    "linear_fit": f"""
        WITH {_FIT}
        SELECT nivel, round(m, 6) AS slope, round(b, 6) AS intercept, round(r2, 6) AS r2,
               lo AS x_min, hi AS x_max, n AS points
        FROM fit""",
    "fit_line_points": f"""
        WITH {_FIT},
        line AS (
          SELECT nivel, m, b, CAST(i AS INTEGER) AS i, lo + (hi - lo) * i / 999 AS x
          FROM fit, range(1000) AS steps(i)
        )
        SELECT nivel, i, round(x, 4) AS x, round(m * x + b, 4) AS y FROM line""",
    "scatter_points": f"""
        WITH {_POINTS}
        SELECT nivel, x AS poblacion, y AS cantidad,
               x BETWEEN 0 AND 15000 AND y BETWEEN 0 AND 80 AS in_view
        FROM points""",
    "rate_per_thousand": f"""
        WITH {_ESTABLISHMENTS}, {_SUPPLIER_CENTRES}, {_HEADCOUNT},
        ee AS (SELECT p, count(*) AS n FROM est GROUP BY p),
        cc AS (SELECT p, count(*) AS n FROM centres GROUP BY p),
        pp AS (SELECT p, CAST(sum(n) AS BIGINT) AS n FROM people GROUP BY p)
        SELECT n_nationkey AS id_prov, n_name AS nombre,
               round(cc.n * 1000 / pp.n, 6) AS cant_cc_cada_mil,
               round(ee.n * 1000 / pp.n, 6) AS cant_ee_cada_mil,
               round((ee.n * 1000 / pp.n) / (cc.n * 1000 / pp.n), 6) AS cociente_ee_cc
        FROM nation
        JOIN ee ON ee.p = n_nationkey JOIN cc ON cc.p = n_nationkey JOIN pp ON pp.p = n_nationkey""",
    "numeric_quality": f"""
        WITH {_RAW_REPORT}
        SELECT count(*) AS total_rows,
               count(*) FILTER (WHERE try_cast(label AS DOUBLE) IS NULL) AS non_numeric_rows,
               round(count(*) FILTER (WHERE try_cast(label AS DOUBLE) IS NULL) / count(*) * 100, 6)
                 AS pct_non_numeric
        FROM raw""",
    "numeric_coercion": """
        SELECT event_id,
               CASE event_id % 8 WHEN 4 THEN 1000.0::DOUBLE WHEN 5 THEN 5.0::DOUBLE
                    WHEN 7 THEN value END AS number
        FROM events""",
    "contact_quality": f"""
        WITH {_MAIL},
        checked AS (
          SELECT mail LIKE '%@%@%' AS several, mail LIKE '% %' OR mail NOT LIKE '%@%' AS bad
          FROM centres
        )
        SELECT count(*) AS total_rows,
               count(*) FILTER (WHERE several) AS multiple,
               count(*) FILTER (WHERE bad) AS invalid,
               round(count(*) FILTER (WHERE several) / count(*) * 100, 6) AS pct_multiple,
               round(count(*) FILTER (WHERE bad) / count(*) * 100, 6) AS pct_invalid
        FROM checked""",
    "flag_quality": f"""
        SELECT count(*) AS total_cells,
               count(*) FILTER (WHERE cell <> '1') AS unset_cells,
               round(count(*) FILTER (WHERE cell <> '1') / count(*) * 100, 6) AS pct_unset
        FROM ({_FLAGS})""",
}
