"""Queries of the spatial operators and of canonicalisation, and their SQL."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.functions import geometry as G
from blockloom.operators import canon, nearby, spatial, stats
from blockloom.plans.quality_sql import P3_FOUND
from blockloom.session import cut, table

SLOTS, NEAR = 24, 6
SERVICES = ["школа", "детскии_сад", "поликлиника"]


def shapes(spark: SparkSession, d: str, name: str, key: str) -> DataFrame:
    """(id, wkt): the latest readable geometry of each id."""
    rows = spatial.latest(table(spark, d, name).select(key, "geometry", "loaded_at"), key).select(F.col(key).alias("id"), F.col("geometry").alias("wkt"))
    return rows.filter(F.col("wkt").isNotNull() & F.col("wkt").rlike(r"\([^)]*\d"))


def buildings(spark, d):
    return shapes(spark, d, "buildings", "building_id")


def blocks(spark, d):
    return shapes(spark, d, "blocks", "block_id")


def measures(df: DataFrame) -> DataFrame:
    part = df.withColumn("part", G.largest_part(G.parts(F.col("wkt"))))
    outer = F.get("part", F.lit(0))
    return part.select("id", G.part_area(F.col("part")).alias("area"), G.length(outer).alias("perimeter"), (F.size("part") - 1).alias("n_holes"), G.reflex_corners(outer).alias("n_reflex"))


def building_measures(spark, d):
    return measures(buildings(spark, d))


def block_measures(spark, d):
    return measures(blocks(spark, d))


def min_rectangles(spark, d):
    return spatial.rectangles(buildings(spark, d)).select("id", (F.col("long") * F.col("short")).alias("rect_area"), "fill")


def shape_classes(spark, d):
    return spatial.rectangles(buildings(spark, d)).groupBy("shape").agg(F.count(F.lit(1)).alias("n"))


def pip_assign(spark, d):
    points = nearby.locations(buildings(spark, d), "id", "wkt")
    return nearby.regions_of(points, blocks(spark, d), "id", "wkt").groupBy("id").agg(F.min("region").alias("block_id"))


def overlap_assign(spark, d):
    """Overlap of buildings with blocks, by block."""
    return spatial.overlaps(buildings(spark, d), blocks(spark, d)).groupBy(F.col("b_id").alias("block_id")).agg(F.count(F.lit(1)).alias("n"), F.sum("area").alias("area"))


def assign_buildings(spark, d):
    return spatial.assign_areas(buildings(spark, d), blocks(spark, d))


def orphan_buildings(spark, d):
    return assign_buildings(spark, d).filter("area_id is null").select("id")


def empty_blocks(spark, d):
    held = assign_buildings(spark, d).select(F.col("area_id").alias("id"))
    return blocks(spark, d).select("id").join(held, "id", "left_anti")


def nesting_levels(spark, d):
    areas = blocks(spark, d)
    return spatial.nesting(areas, cut(spatial.inner_points(areas)))


def _services(spark, d):
    return spatial.latest(table(spark, d, "services"), "service_id").filter(F.col("geometry").rlike(r"\([^)]*\d"))


def services_by_building(spark, d):
    return spatial.attach_services(buildings(spark, d), _services(spark, d))[0]


def service_rows(spark, d):
    """Buildings made of area services that meet no building."""
    return spatial.attach_services(buildings(spark, d), _services(spark, d))[1].select("id", "service", "capacity")


def services_wide(spark, d):
    return spatial.services_wide(services_by_building(spark, d), SERVICES)


def block_orientation(spark, d):
    """Length-weighted axial mean of the sides of each block's outer ring."""
    sides = blocks(spark, d).select("id", F.explode(G.sides(F.get(G.largest_part(G.parts(F.col("wkt"))), F.lit(0)))).alias("e"))
    dx, dy = F.col("e.b.x") - F.col("e.a.x"), F.col("e.b.y") - F.col("e.a.y")
    w, a = F.hypot(dx, dy), F.atan2(dy, dx)
    sums = sides.select("id", (w * F.sin(2 * a)).alias("s"), (w * F.cos(2 * a)).alias("c")).groupBy("id").agg(F.sum("s").alias("s"), F.sum("c").alias("c"))
    return sums.select("id", F.round("s", 3).alias("sin_sum"), F.round("c", 3).alias("cos_sum"))


def _outer_sides(spark, d):
    return blocks(spark, d).select("id", F.explode(G.sides(F.get(G.largest_part(G.parts(F.col("wkt"))), F.lit(0)))).alias("e"))


def block_directions(spark, d):
    """Direction bin of the greatest length of a block's sides."""
    return stats.main_direction(_outer_sides(spark, d).select("id", (F.col("e.b.x") - F.col("e.a.x")).alias("dx"), (F.col("e.b.y") - F.col("e.a.y")).alias("dy")), ["id"])


def principal_angles(spark, d):
    """Share of the variance along the principal axis of a block's corners."""
    return stats.principal_angles(_outer_sides(spark, d).select("id", F.col("e.a.x").alias("x"), F.col("e.a.y").alias("y")), ["id"]).select("id", "spread")


def ring_zones(spark, d):
    """How far the buildings of a block are from its border: within 10 m, 10 to 30 m, or inner."""
    points = nearby.locations(buildings(spark, d), "id", "wkt")
    held = nearby.regions_of(points, blocks(spark, d), "id", "wkt")
    parts = blocks(spark, d).select(F.col("id").alias("region"), F.explode(G.parts(F.col("wkt"))).alias("part"))
    dist = held.join(parts, "region").groupBy("id", "region").agg(F.min(G.boundary_distance(F.col("part"), F.col("x"), F.col("y"))).alias("dist"))
    ring = F.when(F.col("dist") < 10, "ring1").when(F.col("dist") < 30, "ring2").otherwise("inner")
    return dist.select("id", F.col("region").alias("block_id"), "dist", ring.alias("ring"))


def service_degrees(spark, d):
    lon, lat = G.to_degrees(F.col("x"), F.col("y"))
    x, y = G.to_mercator(lon, lat)
    return nearby.locations(table(spark, d, "services"), "service_id").select("id", lon.alias("lon"), lat.alias("lat"), x.alias("x"), y.alias("y"))


def service_spacing(spark, d):
    sites = nearby.locations(_services(spark, d), "service_id").join(_services(spark, d).select(F.col("service_id").alias("id"), F.coalesce("service_type_name", F.lit("")).alias("service")), "id")
    return spatial.nearest_sites(sites.select("service", "id", "x", "y"), ["service"]).withColumn("score", F.coalesce(F.col("mean_nn") / 30.0, F.lit(1.0)))


def block_axes(spark, d):
    return canon.block_axes(blocks(spark, d).select(F.col("id").alias("block_id"), F.col("wkt").alias("geometry"))).select("block_id", "length", "width")


def canonical_active(spark, d):
    every = assign_buildings(spark, d).filter("area_id is not null")
    rows = every.join(buildings(spark, d), "id").select(F.col("area_id").alias("block_id"), F.col("id").alias("building_id"), F.col("wkt").alias("geometry"))
    axes = canon.block_axes(blocks(spark, d).select(F.col("id").alias("block_id"), F.col("wkt").alias("geometry")))
    return canon.nodes(canon.building_features(rows, axes), SLOTS)


def canonical_nodes(spark, d):
    return canon.padded(canonical_active(spark, d), blocks(spark, d).select(F.col("id").alias("block_id")), SLOTS)


def canonical_edges(spark, d):
    return canon.edges(cut(canonical_active(spark, d)), NEAR)


QUERIES = {f.__name__: f for f in (
    building_measures, block_measures, min_rectangles, shape_classes, pip_assign, overlap_assign, assign_buildings, orphan_buildings, empty_blocks,
    nesting_levels, services_by_building, service_rows, services_wide, block_orientation, block_directions, principal_angles, ring_zones, service_degrees, service_spacing, block_axes,
    canonical_nodes, canonical_edges,
)}
DOUBLES = {
    "building_measures": "area perimeter", "block_measures": "area perimeter", "min_rectangles": "rect_area fill", "overlap_assign": "area",
    "ring_zones": "dist", "principal_angles": "spread", "block_directions": "angle", "service_degrees": "lon lat x y", "service_spacing": "min_nn mean_nn score", "block_axes": "length width",
    "services_by_building": "capacity", "service_rows": "capacity",
}

_GEO = r"""
src AS (
  SELECT 'building' AS kind, building_id AS id, geometry, loaded_at FROM buildings UNION ALL SELECT 'block', block_id, geometry, loaded_at FROM blocks
),
g AS (SELECT kind, id, arg_max({'g': geometry}, loaded_at).g AS wkt FROM src WHERE id IS NOT NULL GROUP BY ALL),
part AS (
  SELECT kind, id, unnest(regexp_extract_all(wkt, '\(\s*(\([^()]+\)(?:\s*,\s*\([^()]+\))*)\s*\)', 1)) AS p,
         generate_subscripts(regexp_extract_all(wkt, '\(\s*(\([^()]+\)(?:\s*,\s*\([^()]+\))*)\s*\)', 1), 1) AS k
  FROM g WHERE wkt IS NOT NULL AND regexp_matches(wkt, '\([^)]*\d')
),
ring AS (SELECT kind, id, k, unnest(regexp_extract_all(p, '\(([^()]+)\)', 1)) AS r, generate_subscripts(regexp_extract_all(p, '\(([^()]+)\)', 1), 1) AS j FROM part),
corner AS (SELECT kind, id, k, j, list_transform(string_split(r, ','), lambda c: list_transform(string_split_regex(trim(c), '\s+'), lambda v: CAST(v AS DOUBLE))) AS c FROM ring),
side AS (
  SELECT kind, id, k, j, c[i][1] - c[1][1] AS x1, c[i][2] - c[1][2] AS y1, c[i + 1][1] - c[1][1] AS x2, c[i + 1][2] - c[1][2] AS y2, i, len(c) - 1 AS n,
         CASE WHEN i = len(c) - 1 THEN c[2][1] ELSE c[i + 2][1] END - c[1][1] AS x3, CASE WHEN i = len(c) - 1 THEN c[2][2] ELSE c[i + 2][2] END - c[1][2] AS y3
  FROM corner, LATERAL (SELECT unnest(range(1, len(c))) AS i)
),
ra AS (
  SELECT kind, id, k, j, sum(x1 * y2 - x2 * y1) / 2 AS a, sum(sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2)) AS len FROM side GROUP BY ALL
),
pa AS (SELECT kind, id, k, sum(CASE WHEN j = 1 THEN abs(a) ELSE -abs(a) END) AS area, max(CASE WHEN j = 1 THEN len END) AS perimeter, count(*) - 1 AS n_holes FROM ra GROUP BY ALL),
big AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY kind, id ORDER BY area DESC, k) AS q FROM pa) WHERE q = 1),
turn AS (
  SELECT s.kind, s.id, s.k, count(*) FILTER (((x2 - x1) * (y3 - y2) - (y2 - y1) * (x3 - x2)) * sign(a) < 0) AS n_reflex
  FROM side s JOIN ra ON s.kind = ra.kind AND s.id = ra.id AND s.k = ra.k AND s.j = ra.j WHERE s.j = 1 GROUP BY ALL
)"""
_MEASURE = "WITH " + _GEO + " SELECT b.id, area, perimeter, CAST(n_holes AS INTEGER) AS n_holes, CAST(n_reflex AS INTEGER) AS n_reflex FROM big b JOIN turn t ON b.kind = t.kind AND b.id = t.id AND b.k = t.k WHERE b.kind = '{}'"
_PIP = P3_FOUND[: P3_FOUND.index("SELECT DISTINCT kind || '_in_block'")]
_R = 6378137.0

SQL = {
    "building_measures": _MEASURE.replace("{}", "building"),
    "block_measures": _MEASURE.replace("{}", "block"),
    # the smallest rectangle lies along a side of the hull, so the least one along any line through two corners is it
    "min_rectangles": "WITH " + _GEO + """, pt AS (SELECT DISTINCT s.id, x1 AS x, y1 AS y FROM side s JOIN big USING (kind, id, k) WHERE kind = 'building' AND j = 1),
dir AS (SELECT DISTINCT a.id, (b.x - a.x) / sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2) AS ux, (b.y - a.y) / sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2) AS uy FROM pt a JOIN pt b ON a.id = b.id AND (a.x <> b.x OR a.y <> b.y)),
box AS (SELECT id, ux, uy, max(x * ux + y * uy) - min(x * ux + y * uy) AS w, max(y * ux - x * uy) - min(y * ux - x * uy) AS h FROM dir JOIN pt USING (id) GROUP BY ALL),
best AS (SELECT id, min(w * h) AS s FROM box GROUP BY id)
SELECT id, s AS rect_area, area / greatest(s, 1e-9) AS fill FROM best JOIN big USING (id) WHERE kind = 'building'""",
    "pip_assign": _PIP + " SELECT id, min(block_id) AS block_id FROM held WHERE kind = 'building' GROUP BY id",
    "block_orientation": "WITH " + _GEO + """ SELECT id, round(sum(2 * (x2 - x1) * (y2 - y1) / sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2)), 3) AS sin_sum, round(sum(((x2 - x1) ** 2 - (y2 - y1) ** 2) / sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2)), 3) AS cos_sum
FROM side JOIN big USING (kind, id, k) WHERE kind = 'block' AND j = 1 AND (x1 <> x2 OR y1 <> y2) GROUP BY id""",
    "service_degrees": "WITH " + P3_FOUND[P3_FOUND.index("spots AS"): P3_FOUND.index(",\nrings AS")] + f" SELECT id, x / {_R} * 180 / pi() AS lon, (2 * atan(exp(y / {_R})) - pi() / 2) * 180 / pi() AS lat, x, y FROM spots WHERE kind = 'service'",
    "ring_zones": _PIP.replace("held AS (", """d AS (
  SELECT near.id, near.block_id, min(sqrt((x - (x1 + t * (x2 - x1))) ** 2 + (y - (y1 + t * (y2 - y1))) ** 2)) AS dist
  FROM (SELECT near.kind, near.id, near.x, near.y, near.block_id, x1, y1, x2, y2, CASE WHEN x1 = x2 AND y1 = y2 THEN 0 ELSE greatest(0, least(1, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2))) END AS t
        FROM near JOIN sides ON near.block_id = sides.block_id WHERE kind = 'building') near GROUP BY ALL
),
held AS (""") + " SELECT d.id, d.block_id, dist, CASE WHEN dist < 10 THEN 'ring1' WHEN dist < 30 THEN 'ring2' ELSE 'inner' END AS ring FROM d JOIN (SELECT DISTINCT id, block_id FROM held WHERE kind = 'building') USING (id, block_id)",
    "service_spacing": "WITH " + P3_FOUND[P3_FOUND.index("spots AS"): P3_FOUND.index(",\nrings AS")] + """, s AS (SELECT coalesce(n.service_type_name, '') AS service, id, x, y FROM spots JOIN (SELECT DISTINCT service_id, service_type_name FROM services) n ON n.service_id = id WHERE kind = 'service'),
nn AS (SELECT a.service, a.id, min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) FILTER (a.x <> b.x OR a.y <> b.y) AS d FROM s a LEFT JOIN s b ON a.service = b.service GROUP BY a.service, a.id)
SELECT service, count(*) AS n, min(d) AS min_nn, avg(d) AS mean_nn, coalesce(avg(d) / 30.0, 1.0) AS score FROM nn GROUP BY service""",
    "principal_angles": "WITH " + _GEO + """, v AS (SELECT id, var_samp(x1) AS a, var_samp(y1) AS b, covar_samp(x1, y1) AS c FROM side JOIN big USING (kind, id, k) WHERE kind = 'block' AND j = 1 GROUP BY id)
SELECT id, 0.5 + sqrt((a - b) ** 2 / 4 + c * c) / (a + b) AS spread FROM v""",
    "block_directions": "WITH " + _GEO + """, s AS (SELECT id, CAST(least(floor(m * 72 / 180), 71) AS INTEGER) AS b, sqrt(dx * dx + dy * dy) AS w FROM (
  SELECT id, x2 - x1 AS dx, y2 - y1 AS dy, degrees(atan2(y2 - y1, x2 - x1)) + 90 - 180 * floor((degrees(atan2(y2 - y1, x2 - x1)) + 90) / 180) AS m FROM side JOIN big USING (kind, id, k) WHERE kind = 'block' AND j = 1)),
t AS (SELECT id, b, round(sum(w), 6) AS w FROM s GROUP BY ALL)
SELECT id, (b + 0.5) * 180 / 72 - 90 AS angle FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY w DESC, b) AS q FROM t) WHERE q = 1""",
}
