"""DuckDB SQL of the queries in ``quality``."""

_SPOTS = r"""
spots AS (
  SELECT DISTINCT kind, id, (list_min(xs) + list_max(xs)) / 2 AS x, (list_min(ys) + list_max(ys)) / 2 AS y
  FROM (
    SELECT kind, id, list_transform(v, lambda p: CAST(p[1] AS DOUBLE)) AS xs, list_transform(v, lambda p: CAST(p[2] AS DOUBLE)) AS ys
    FROM (
      SELECT kind, id, list_transform(string_split(regexp_replace(regexp_extract(geometry, '\((.*)\)', 1), '[()]', ' ', 'g'), ','),
                                      lambda p: string_split_regex(trim(p), '\s+')) AS v
      FROM (SELECT 'building' AS kind, building_id AS id, geometry FROM buildings
            UNION ALL SELECT 'service', service_id, geometry FROM services)
      WHERE geometry IS NOT NULL AND regexp_matches(geometry, '\([^)]*\d')
    )
  )
)"""

P3_FOUND = (
    "WITH " + _SPOTS + r""",
rings AS (
  SELECT block_id, unnest(regexp_extract_all(geometry, '\(([^()]+)\)', 1)) AS ring
  FROM (SELECT DISTINCT block_id, geometry FROM blocks WHERE geometry IS NOT NULL)
),
corners AS (
  SELECT block_id, list_transform(string_split(ring, ','), lambda p: list_transform(string_split_regex(trim(p), '\s+'), lambda v: CAST(v AS DOUBLE))) AS p
  FROM rings
),
sides AS (
  SELECT block_id, e[1][1] AS x1, e[1][2] AS y1, e[2][1] AS x2, e[2][2] AS y2
  FROM (SELECT block_id, unnest(list_zip(p[:-2], p[2:])) AS z FROM corners), LATERAL (SELECT [z[1], z[2]] AS e)
),
boxes AS (
  SELECT block_id, min(least(x1, x2)) AS x0, max(greatest(x1, x2)) AS x9, min(least(y1, y2)) AS y0, max(greatest(y1, y2)) AS y9
  FROM sides GROUP BY block_id
),
near AS (
  SELECT kind, id, x, y, block_id FROM spots JOIN boxes ON x BETWEEN x0 AND x9 AND y BETWEEN y0 AND y9
),
held AS (
  SELECT kind, id, near.block_id
  FROM near JOIN sides ON near.block_id = sides.block_id AND (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1
  GROUP BY kind, id, x, y, near.block_id HAVING count(*) % 2 = 1
)
SELECT DISTINCT kind || '_in_block' AS relation, id AS left_id, block_id AS right_id FROM held
UNION ALL
SELECT DISTINCT 'services_close', a.id, b.id FROM spots a JOIN spots b
  ON a.kind = 'service' AND b.kind = 'service' AND a.id < b.id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 900.0
"""
)

_REFERENCES = """
refs AS (
  SELECT 'nodes_fixed.block_id' AS ref_field, block_id, CAST(-1 AS BIGINT) AS slot_id, loaded_at AS t FROM nodes_fixed
  UNION ALL SELECT 'branches.block_id', block_id, CAST(-1 AS BIGINT), loaded_at FROM branches
  UNION ALL SELECT 'edges.src_slot', block_id, src_slot, loaded_at FROM edges
  UNION ALL SELECT 'edges.dst_slot', block_id, dst_slot, loaded_at FROM edges
),
targets AS (
  SELECT 'block' AS space, block_id, CAST(-1 AS BIGINT) AS slot_id, loaded_at, deleted_at FROM blocks
  UNION ALL SELECT 'slot', block_id, slot_id, loaded_at, NULL FROM nodes_fixed
)"""

P4_FOUND = (
    "WITH " + _REFERENCES + """,
ids AS (SELECT *, CASE WHEN ref_field LIKE 'edges%' THEN 'slot' ELSE 'block' END AS space FROM refs WHERE block_id IS NOT NULL AND slot_id IS NOT NULL),
judged AS (
  SELECT i.ref_field, i.t, i.block_id, i.slot_id, count(g.space) AS n,
         count(*) FILTER (WHERE g.loaded_at <= i.t) AS come,
         count(*) FILTER (WHERE g.loaded_at <= i.t AND (g.deleted_at IS NULL OR g.deleted_at > i.t)) AS live
  FROM (SELECT DISTINCT * FROM ids) i LEFT JOIN targets g USING (space, block_id, slot_id)
  GROUP BY ALL
)
SELECT DISTINCT ref_field, strftime(t, '%Y-%m') AS period, block_id, slot_id,
       CASE WHEN n = 0 THEN 'missing' WHEN come = 0 THEN 'late' ELSE 'deleted' END AS status
FROM judged WHERE live = 0
"""
)

P4_CURRENT = (
    "WITH " + _REFERENCES + """,
want AS (
  SELECT CASE WHEN ref_field LIKE 'edges%' THEN 'slot' ELSE 'block' END AS space, block_id, slot_id, count(*) AS n_references
  FROM refs WHERE block_id IS NOT NULL AND slot_id IS NOT NULL GROUP BY ALL
),
have AS (SELECT space, block_id, slot_id, count(*) FILTER (WHERE deleted_at IS NULL) AS live FROM targets GROUP BY ALL)
SELECT space, block_id, slot_id, n_references, CASE WHEN live IS NULL THEN 'missing' ELSE 'deleted' END AS status
FROM want LEFT JOIN have USING (space, block_id, slot_id) WHERE coalesce(live, 0) = 0
"""
)

P5_FOUND = r"""
WITH b AS (SELECT *, try_cast(regexp_extract(floors_num, '^[\s\x{00A0}]*\+?0*(\d{1,3})([.,]0*)?[\s\x{00A0}]*([-–]?[\s\x{00A0}]*\p{L}+\.?)?[\s\x{00A0}]*$', 1) AS INTEGER) AS n FROM buildings)
SELECT DISTINCT building_id, field FROM (
  SELECT building_id, 'floors_num' AS field FROM b WHERE NOT coalesce(n BETWEEN 1 AND 150, false) AND has_floors IS DISTINCT FROM false
  UNION ALL SELECT building_id, 'living_area' FROM b
    WHERE living_area IS NULL OR isnan(living_area) OR living_area < 0 OR living_area > 200000 OR (living_area = 0 AND is_living IS NOT DISTINCT FROM true)
  UNION ALL SELECT building_id, 'is_living' FROM b WHERE is_living IS NULL
  UNION ALL SELECT building_id, 'has_floors' FROM b WHERE has_floors IS NULL
)
"""

_CELLS = r"""
latest AS (
  SELECT * FROM buildings
  QUALIFY row_number() OVER (PARTITION BY building_id ORDER BY loaded_at DESC NULLS LAST, series DESC NULLS LAST, built_year DESC NULLS LAST,
    floors_num DESC NULLS LAST, living_area DESC NULLS LAST, is_living DESC NULLS LAST, has_floors DESC NULLS LAST) = 1
),
b AS (
  SELECT building_id, series, CASE WHEN built_year BETWEEN 1500 AND 2200 THEN built_year END AS year, is_living, has_floors,
         CASE WHEN n BETWEEN 1 AND 150 THEN n END AS floors,
         CASE WHEN isfinite(living_area) AND living_area BETWEEN 0 AND 200000 THEN living_area END AS area
  FROM (SELECT *, try_cast(regexp_extract(floors_num, '^[\s\x{00A0}]*\+?0*(\d{1,3})([.,]0*)?[\s\x{00A0}]*([-–]?[\s\x{00A0}]*\p{L}+\.?)?[\s\x{00A0}]*$', 1) AS INTEGER) AS n FROM latest)
),
cells AS (
  SELECT building_id, series, year, 'floors_num' AS field, floors IS NOT NULL OR has_floors IS NOT DISTINCT FROM false AS ok, CAST(floors AS DOUBLE) AS number FROM b
  UNION ALL SELECT building_id, series, year, 'living_area', area IS NOT NULL AND NOT (area = 0 AND is_living IS NOT DISTINCT FROM true), area FROM b
  UNION ALL SELECT building_id, series, year, 'is_living', is_living IS NOT NULL, CAST(is_living AS INTEGER) FROM b
  UNION ALL SELECT building_id, series, year, 'has_floors', has_floors IS NOT NULL, CAST(has_floors AS INTEGER) FROM b
)"""


def _mean(by: str) -> str:
    keys = f"{by}, " if by else ""
    where = " AND ".join(f"{c} IS NOT NULL" for c in by.split(", ")) if by else "true"
    mean = "CASE WHEN field IN ('is_living', 'has_floors') THEN CAST(avg(number) >= 0.5 AS INTEGER) ELSE sum(number) / count(number) END"
    return f"SELECT {keys}field, {mean} AS v FROM cells WHERE ok AND number IS NOT NULL AND {where} GROUP BY {keys}field"


P5_FILLED = (
    "WITH " + _CELLS + f""",
years AS ({_mean("series, year")}), per_series AS ({_mean("series")}), per_year AS ({_mean("year")}), overall AS ({_mean("")}),
missing AS (SELECT * FROM cells WHERE NOT ok),
near AS (
  SELECT m.building_id, m.field,
         max_by({{'y': y.year, 'v': y.v}}, y.year) FILTER (WHERE y.year < m.year) AS a,
         min_by({{'y': y.year, 'v': y.v}}, y.year) FILTER (WHERE y.year > m.year) AS z,
         max(y.v) FILTER (WHERE y.year = m.year) AS same
  FROM missing m JOIN years y ON m.series = y.series AND m.field = y.field GROUP BY ALL
),
joined AS (
  SELECT m.*, n.same, n.a.v AS av, n.z.v AS zv, m.year - n.a.y AS da, n.z.y - m.year AS dz, s.v AS sv, y.v AS yv, o.v AS ov
  FROM missing m LEFT JOIN near n ON m.building_id IS NOT DISTINCT FROM n.building_id AND m.field = n.field AND m.year IS NOT NULL
  LEFT JOIN per_series s ON m.series = s.series AND m.field = s.field
  LEFT JOIN per_year y ON m.year = y.year AND m.field = y.field
  LEFT JOIN overall o ON m.field = o.field
),
judged AS (
  SELECT *, CASE WHEN same IS NOT NULL THEN 'same_year'
    WHEN field IN ('floors_num', 'living_area') AND av IS NOT NULL AND zv IS NOT NULL THEN 'interpolated'
    WHEN least(da, dz) <= 10 THEN CASE WHEN dz IS NULL OR da <= dz THEN 'carried_forward' ELSE 'carried_backward' END
    WHEN sv IS NOT NULL THEN 'series_overall' WHEN yv IS NOT NULL THEN 'year_overall' WHEN ov IS NOT NULL THEN 'overall' ELSE 'none' END AS method
  FROM joined
),
valued AS (
  SELECT *, CASE method WHEN 'same_year' THEN same WHEN 'interpolated' THEN av + (zv - av) * da / (da + dz) WHEN 'carried_forward' THEN av
    WHEN 'carried_backward' THEN zv WHEN 'series_overall' THEN sv WHEN 'year_overall' THEN yv WHEN 'overall' THEN ov END AS v
  FROM judged
)
SELECT building_id, field, CASE WHEN field = 'floors_num' THEN greatest(round(v), 1) ELSE v END AS value, method,
       CASE method WHEN 'same_year' THEN 0 WHEN 'interpolated' THEN least(da, dz) WHEN 'carried_forward' THEN da WHEN 'carried_backward' THEN dz END AS distance
FROM valued
"""
)

_VALUES = """
zones AS (SELECT DISTINCT name_en FROM canon_names WHERE kind = 'zone'),
v AS (
  SELECT 'nodes_fixed' AS tbl, 'floors_num' AS col, load_id, CAST(floors_num AS VARCHAR) AS value, floors_num BETWEEN 1 AND 150 AS legal FROM nodes_fixed
  UNION ALL SELECT 'nodes_fixed', 'e_i', load_id, CAST(e_i AS VARCHAR), e_i IN (0, 1) FROM nodes_fixed
  UNION ALL SELECT 'blocks', 'zone', load_id, zone, zone IN (SELECT name_en FROM zones) FROM blocks
)"""

P6_FOUND = (
    "WITH " + _VALUES + """,
loads AS (
  SELECT tbl, col, load_id, count(*) AS n, count(*) - count(value) AS n_null, count(value) AS n_value,
         count(*) FILTER (WHERE value IS NOT NULL AND legal IS NOT TRUE) AS n_bad
  FROM v GROUP BY ALL
),
every AS (SELECT tbl, col, count(*) AS n, count(*) - count(value) AS n_null, count(value) AS n_value FROM v GROUP BY ALL),
shares AS (
  SELECT e.tbl, e.col, l.load_id, e.value,
         coalesce(p.c, 0) / l.n_value - e.c / a.n_value AS d
  FROM (SELECT tbl, col, value, count(*) AS c FROM v WHERE value IS NOT NULL GROUP BY ALL) e
  JOIN loads l USING (tbl, col) JOIN every a USING (tbl, col)
  LEFT JOIN (SELECT tbl, col, load_id, value, count(*) AS c FROM v WHERE value IS NOT NULL GROUP BY ALL) p
    ON p.tbl = e.tbl AND p.col = e.col AND p.load_id = l.load_id AND p.value = e.value
  WHERE l.n_value > 0
)
SELECT l.tbl, l.col, l.load_id, 'nulls' AS finding FROM loads l JOIN every a USING (tbl, col) WHERE abs(l.n_null / l.n - a.n_null / a.n) > 0.15
UNION ALL SELECT tbl, col, load_id, 'domain' FROM loads WHERE n_value > 0 AND n_bad / n_value > 0.05
UNION ALL SELECT tbl, col, load_id, 'shift' FROM shares GROUP BY ALL HAVING sum(abs(d)) / 2 > 0.3
"""
)

P6_PROFILE = (
    "WITH " + _VALUES + """,
x AS (SELECT *, try_cast(value AS DECIMAL(38, 6)) AS num FROM v),
per AS (
  SELECT tbl, col, load_id, count(*) AS n_rows, count(*) - count(value) AS n_null, count(DISTINCT value) AS n_distinct,
         count(*) FILTER (WHERE value IS NOT NULL AND legal IS NOT TRUE) AS n_illegal, min(value) AS min_text, max(value) AS max_text,
         CAST(min(num) AS DOUBLE) AS min_number, CAST(max(num) AS DOUBLE) AS max_number,
         count(num) AS c, sum(CAST(num AS DOUBLE)) AS s1, sum(CAST(num AS DOUBLE) ** 2) AS s2
  FROM x GROUP BY ALL
),
every AS (
  SELECT tbl, col, sum(c) AS c, sum(CAST(s1 AS DOUBLE)) / sum(c) AS m, sqrt(greatest(sum(CAST(s2 AS DOUBLE)) / sum(c) - (sum(CAST(s1 AS DOUBLE)) / sum(c)) ** 2, 0)) AS sd
  FROM per GROUP BY ALL
)
SELECT tbl, col, load_id, n_rows, n_null, n_null / n_rows AS null_share, n_distinct, n_illegal, min_text, max_text, min_number, max_number,
       CAST(s1 AS DOUBLE) / nullif(p.c, 0) AS mean, CASE WHEN sd > 0 THEN (CAST(s1 AS DOUBLE) / nullif(p.c, 0) - m) / sd END AS mean_shift_sd, true AS exact
FROM per p JOIN every e USING (tbl, col)
"""
)

SQL = {"p5_filled": P5_FILLED, "p6_profile": P6_PROFILE, "p3_found": P3_FOUND, "p4_found": P4_FOUND, "p4_current": P4_CURRENT, "p5_found": P5_FOUND, "p6_found": P6_FOUND}
