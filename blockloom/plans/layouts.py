"""Queries of rasters, grids, allocation, placement, sampling and model inputs, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.functions.scalars import number
from blockloom.operators import allocation, grid, learning, nearby, placement, raster, sampling, stats
from blockloom.plans import sequences, spatials
from blockloom.session import cut, table

N, SIDE, SIGMA = 20, 15.0, 10.0 / 15.0


def weighted_points(spark: SparkSession, d: str) -> DataFrame:
    """Points of a 300 m square per event type: fractions of the extent and a weight of 1 to 2."""
    e = table(spark, d, "events")
    x, y = (F.col("event_id") * 17) % 300 / 300e0, (F.col("event_id") * 41 + F.expr("event_id div 300")) % 300 / 300e0
    return raster.unit_weights(e.select("event_type", x.alias("x"), y.alias("y"), number(F.col("value"), 0).alias("w")), "w")


def density_hist(spark, d):
    return raster.histogram(weighted_points(spark, d), ["event_type"], F.col("x"), F.col("y"), F.col("w"), N)


def _masked(spark, d):
    hist = density_hist(spark, d)
    full = raster.lattice(hist.select("event_type").distinct(), N)
    round_mask = ((F.col("i") - 9.5) * (F.col("i") - 9.5) + (F.col("j") - 9.5) * (F.col("j") - 9.5) <= 90).cast("int")
    return full.join(hist, ["event_type", "i", "j"], "left").select("event_type", "i", "j", F.coalesce("v", F.lit(0.0)).alias("v"), round_mask.alias("mask"))


def density_smooth(spark, d):
    return raster.density(_masked(spark, d), ["event_type"], N, SIGMA, SIDE)


def density_levels(spark, d):
    return raster.levels(density_smooth(spark, d), ["event_type"])


def contour_segments(spark, d):
    rows = cut(density_smooth(spark, d).withColumn("v", F.round("v", 9)))
    return raster.contour_segments(rows, ["event_type"], raster.levels(rows, ["event_type"]))


def contour_lines(spark, d):
    """Lines of at least two cells; in raster units."""
    return raster.contour_lines(contour_segments(spark, d), ["event_type"]).filter("length >= 2")


def tagged_cells(spark, d):
    """Raster cells with the contour levels they reach."""
    rows = cut(density_smooth(spark, d).withColumn("v", F.round("v", 9)))
    cells = rows.select("event_type", F.col("i").alias("row_i"), F.col("j").alias("col_j"))
    out = grid.tag_cells(cells, rows, raster.levels(rows, ["event_type"]), ["event_type"])
    return out.select("event_type", "row_i", "col_j", F.size("level_ids").alias("n_levels"), "level")


def block_masks(spark, d):
    masks = raster.block_mask(spatials.blocks(spark, d).select(F.col("id").alias("block_id"), F.col("wkt").alias("geometry")), 32)
    return masks.select("block_id", F.aggregate("mask", F.lit(0), lambda s, v: s + v).alias("n_inside"))


def block_cells(spark, d):
    """The 50 m cells of each block: how many, and their area together."""
    cells = grid.cells_of_blocks(spatials.blocks(spark, d).select(F.col("id").alias("block_id"), F.col("wkt").alias("geometry")), 50.0)
    return cells.groupBy("block_id").agg(F.count(F.lit(1)).alias("n_cells"), F.sum("area").alias("area"), (F.max("cell_id") + 1).alias("n_ids"))


def block_cell_areas(spark, d):
    """The area of all 50 m cells of a block, which is that of the block."""
    return block_cells(spark, d).select("block_id", "area")


def board(spark: SparkSession, d: str) -> DataFrame:
    """20 x 20 grids of parts with flags."""
    p, k, s = table(spark, d, "part"), F.col("p_partkey"), F.col("p_size")
    return p.select(
        F.expr("p_partkey div 400").cast("string").alias("zone"), F.expr("(p_partkey % 400) div 20").alias("row_i"), (k % 20).alias("col_j"), (s > 15).alias("inside"),
        F.when(s % 3 != 0, s % 5).alias("level"), (s % 7 == 0).alias("small"), (s % 2 == 0).alias("residential"), (s % 3).cast("string").alias("service"), F.lit(1).alias("n_cells"), F.substring("p_type", 1, 1).alias("type"),
    )


def neighbour_counts(spark, d):
    return grid.neighbour_counts(board(spark, d), ["zone"])


def three_sides(spark, d):
    return grid.close_three_sides(board(spark, d), ["zone"]).select("zone", "row_i", "col_j", "inside", "closed")


def neighbour_levels(spark, d):
    return grid.neighbour_level(board(spark, d), ["zone"])


def building_cells(spark, d):
    return grid.building_cells(board(spark, d), ["zone"])


def diagonal_groups(spark, d):
    return grid.diagonal_groups(cut(building_cells(spark, d)), ["zone"])


def merged_groups(spark, d):
    return grid.merged_groups(board(spark, d).filter("inside"), ["zone"], "service")


def zone_centres(spark, d):
    return grid.zone_centres(board(spark, d), ["zone"])


def service_sites(spark, d):
    """Sites on the cells of every block; a cell that the border cuts below one half is outside, one with a building's centre is built."""
    at = lambda v: F.floor((F.col(f"{v}min") + F.col(f"{v}max")) / 2 / placement.CELL).alias(f"g{'i' if v == 'y' else 'j'}")
    houses = nearby.with_box(spatials.buildings(spark, d), "wkt").select(at("y"), at("x")).distinct()
    return placement.place_on_blocks(spatials.blocks(spark, d).select(F.col("id").alias("block_id"), F.col("wkt").alias("geometry")), houses, 4)


def _demand(spark, d):
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    return c.select(
        "c_custkey", F.col("c_nationkey").cast("string").alias("zone"), (F.round(F.abs("c_acctbal")) / 10 + 50).alias("area"), (k % 4 != 0).alias("living"),
        ((k * 37) % 100 + 1).cast("double").alias("distance"), (F.col("c_nationkey") * 3000e0).alias("target"), F.when(k % 8 == 0, "school").when(k % 8 == 4, "kindergarten").alias("service"),
    )


def floors_rule(spark, d):
    return _demand(spark, d).select("c_custkey", allocation.floors(F.col("area"), F.col("living"), F.col("service"), F.lit(9)).alias("floors"))


def waterfill(spark, d):
    rows = _demand(spark, d).select("c_custkey", "zone", (F.col("area") * 2).alias("cap"), (1 / F.col("distance")).alias("weight"), (F.col("target") / 2).alias("demand"))
    return allocation.water_fill(rows, ["zone"], "demand", "weight", "cap", ["c_custkey"]).select("c_custkey", "zone", "x")


def _living(spark, d):
    rows = _demand(spark, d).withColumn("floors", allocation.floors(F.col("area"), F.col("living"), F.col("service"), F.lit(9)))
    return allocation.living_area(rows, ["c_custkey"])


def living_area(spark, d):
    return _living(spark, d).select("c_custkey", "zone", "living_area", "share")


def zone_summary(spark, d):
    return allocation.zone_summary(_living(spark, d)).drop("status")


def zone_parameters(spark, d):
    zones = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("zone_id"), F.col("n_name").alias("zone"))
    by_id = spark.range(5).select(F.col("id").cast("string").alias("key"), F.when(F.col("id") != 2, F.col("id") * 100e0).alias("target"), F.when(F.col("id") == 3, F.lit(4)).alias("max_floor"))
    by_name = table(spark, d, "nation").filter("n_nationkey % 2 = 0").select(F.lower("n_name").alias("key"), F.lit(7e0).alias("target"), F.lit(5).alias("max_floor"))
    return allocation.zone_parameters(zones, by_id, by_name)


def fitted_areas(spark, d):
    rows = _demand(spark, d).select("c_custkey", "zone", "area", "living", "target")
    return allocation.fit_to_target(rows, ["zone"], "area", F.col("living"), "target").select("c_custkey", "zone", "area")


def slots_per_branch(spark, d):
    counts = sequences.slots(spark, d).groupBy("block_id", F.col("branch_local_id").alias("branch")).agg(F.count(F.lit(1)).alias("n"))
    return allocation.slots_per_branch(counts, 10)


def slot_matching(spark, d):
    """Slots of a square lattice, 5 x 5 or as large as all nodes of the block need, matched to the nodes of every block."""
    nodes = sequences.slots(spark, d).select("block_id", F.col("slot_id").alias("target_id"), F.lit(True).alias("active"), F.col("posx").alias("x"), F.col("posy").alias("y"))
    side = F.greatest(F.ceil(F.sqrt(F.count(F.lit(1)))), F.lit(5)).alias("side")
    lattice = nodes.groupBy("block_id").agg(side).withColumn("slot_id", F.explode(F.expr("sequence(0, cast(side * side - 1 as int))")))
    lattice = lattice.select("block_id", "slot_id", (F.expr("slot_id % side") * 2 / (F.col("side") - 1) - 1).alias("x"), (F.expr("slot_id div side") * 2 / (F.col("side") - 1) - 1).alias("y"))
    return placement.match_slots(lattice, nodes)


def _rects(spark, d):
    rows = sequences.slots(spark, d)
    return rows.select("block_id", F.col("slot_id").alias("id"), F.col("posx").alias("x"), F.col("posy").alias("y"), F.col("size_x").alias("w"), F.col("size_y").alias("h"), number(F.col("a_i"), 0).alias("score"))


def suppressed(spark, d):
    return placement.suppress(_rects(spark, d)).select("block_id", "id")


def repelled(spark, d):
    return placement.repel(_rects(spark, d).select("block_id", "id", "x", "y"), "block_id", 0.1)


def sampled_blocks(spark, d):
    return sampling.weighted_draws(stats.temperature_weights(table(spark, d, "blocks"), 0.5), "block_id", "weight", 2000)


def sampled_zones(spark, d):
    return sampling.uniform_by_group(stats.zone_of_blocks(table(spark, d, "blocks")), "block_id", "zone", 2000)


def batches(spark, d):
    zoned = stats.temperature_weights(table(spark, d, "blocks"), 0.5)
    major, minor = sampling.weighted_draws(zoned, "block_id", "weight", 600), sampling.uniform_by_group(zoned, "block_id", "zone", 200)
    special = stats.blocks_with_services(table(spark, d, "nodes_fixed")).filter("any_service and block_id is not null")
    return sampling.two_stream_batches(major, minor, special, "block_id", 8, 0.75)


def node_targets(spark, d):
    scale = sequences.latest_blocks(spark, d).select("block_id").join(table(spark, d, "blocks").groupBy("block_id").agg(F.max_by("scale_l", "loaded_at").alias("scale_l")), "block_id")
    return learning.node_targets(sequences.slots(spark, d), scale).select("block_id", "slot_id", F.posexplode("targets").alias("k", "v")).groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))


def block_strata(spark, d):
    profile = stats.block_profile(table(spark, d, "blocks"), table(spark, d, "nodes_fixed"))
    found = learning.strata(profile, ["occupancy", "living_share", "posx_mean", "size_x_mean"])
    return found.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))


def loss_values(spark, d):
    rows = sequences.slots(spark, d).select(
        "block_id", (F.col("posx") * 2).alias("e_logit"), (F.col("s_i") % 2).cast("double").alias("e"), F.col("posx").alias("x"), F.col("posy").alias("y"),
        F.col("size_x").alias("px"), F.col("size_y").alias("py"), number(F.col("living_area"), 0).alias("la"), F.lit(1000e0).alias("pla"),
    )
    return learning.loss_values(rows)


def collisions(spark, d):
    return learning.collisions(_rects(spark, d).select("block_id", "id", "x", "y"), 0.2)


QUERIES = {f.__name__: f for f in (
    density_hist, density_smooth, density_levels, contour_segments, contour_lines, tagged_cells, block_masks, block_cells, block_cell_areas, neighbour_counts, three_sides, neighbour_levels,
    building_cells, diagonal_groups, merged_groups, zone_centres, service_sites, floors_rule, waterfill, living_area, zone_summary, zone_parameters, fitted_areas, slots_per_branch,
    slot_matching, suppressed, repelled, sampled_blocks, sampled_zones, batches, node_targets, block_strata, loss_values, collisions,
)}
DOUBLES = {
    "density_hist": "v", "density_smooth": "v", "density_levels": "level", "contour_segments": "level x1 y1 x2 y2", "contour_lines": "level length", "tagged_cells": "level", "block_cells": "area", "block_cell_areas": "area",
    "zone_centres": "r_center c_center", "waterfill": "x", "living_area": "living_area share", "fitted_areas": "area", "zone_parameters": "target", "repelled": "x y",
    "zone_summary": "target_requested target_used cap_min cap_max mean_k sum_living_area", "node_targets": "total", "loss_values": "existence position area area_sum", "collisions": "collision",
}

_W = [round(x, 17) for x in raster.kernel(SIGMA)]
_KERNEL = "w AS (SELECT * FROM (VALUES " + ", ".join(f"({k - 3}, {x!r}::DOUBLE)" for k, x in enumerate(_W)) + ") AS t(o, w))"
_HIST = """e AS (SELECT event_type, (event_id * 17) % 300 / 300e0 AS x, (event_id * 41 + event_id // 300) % 300 / 300e0 AS y, CASE WHEN value IS NULL OR isnan(value) THEN 0.0 ELSE value END AS v FROM events),
lim AS (SELECT min(v) AS lo, max(v) AS hi FROM e),
h AS (SELECT event_type, CAST(least(floor(y * 20), 19) AS INTEGER) AS i, CAST(least(floor(x * 20), 19) AS INTEGER) AS j, sum(1 + (v - lo) / (hi - lo)) AS v FROM e, lim GROUP BY ALL)"""
_SMOOTH = _HIST + ", " + _KERNEL + """,
full_ AS (SELECT t.event_type, i, j, coalesce(h.v, 0.0) AS v, ((i - 9.5) ** 2 + (j - 9.5) ** 2 <= 90)::INTEGER AS m
  FROM (SELECT event_type, CAST(a.i AS INTEGER) AS i, CAST(b.j AS INTEGER) AS j FROM (SELECT DISTINCT event_type FROM h), range(20) a(i), range(20) b(j)) t LEFT JOIN h USING (event_type, i, j)),
s AS (SELECT t.event_type, t.i, t.j, t.m, sum(a.w * b.w * f.v) AS sv, sum(a.w * b.w * f.m) AS sm FROM full_ t, w a, w b, full_ f
  WHERE f.event_type = t.event_type AND f.i = greatest(0, least(19, t.i + a.o)) AND f.j = greatest(0, least(19, t.j + b.o)) GROUP BY ALL),
d AS (SELECT event_type, i, j, m > 0 AS inside, sv / greatest(sm, 1e-9) / 225e0 AS v FROM s)"""
_LEVELS = """q AS (SELECT event_type, quantile_cont(v, [0.60, 0.75, 0.85, 0.92, 0.97]) AS q, min(v) AS lo, max(v) AS hi FROM dd WHERE inside AND v > 0 GROUP BY ALL),
lv AS (SELECT DISTINCT event_type, round(x, 12) AS level FROM (SELECT event_type, unnest(q) AS x, lo, hi FROM q) WHERE round(x, 12) > lo AND round(x, 12) < hi)"""
_BOARD = """c AS (SELECT CAST(p_partkey // 400 AS VARCHAR) AS zone, (p_partkey % 400) // 20 AS row_i, p_partkey % 20 AS col_j, p_size > 15 AS inside, CASE WHEN p_size % 3 <> 0 THEN p_size % 5 END AS level,
p_size % 2 = 0 AS residential FROM part),
nb AS (SELECT a.zone, a.row_i, a.col_j, b.inside, b.level, (a.row_i = b.row_i OR a.col_j = b.col_j) AS side FROM c a JOIN c b ON a.zone = b.zone AND abs(a.row_i - b.row_i) <= 1 AND abs(a.col_j - b.col_j) <= 1 AND (a.row_i <> b.row_i OR a.col_j <> b.col_j)),
k AS (SELECT c.zone, c.row_i, c.col_j, c.inside, count(nb.zone) AS degree, count(*) FILTER (nb.zone IS NOT NULL AND NOT nb.inside) AS empty, count(*) FILTER (nb.side AND nb.inside) AS side_inside FROM c LEFT JOIN nb USING (zone, row_i, col_j) GROUP BY ALL)"""
_DEMAND = """c AS (SELECT c_custkey, CAST(c_nationkey AS VARCHAR) AS zone, round(abs(c_acctbal)) / 10 + 50 AS area, c_custkey % 4 <> 0 AS living, CAST((c_custkey * 37) % 100 + 1 AS DOUBLE) AS distance, c_nationkey * 3000e0 AS target,
CASE WHEN c_custkey % 8 = 0 THEN 'school' WHEN c_custkey % 8 = 4 THEN 'kindergarten' END AS service FROM customer),
f AS (SELECT *, CAST(CASE WHEN living THEN greatest(1, least(floor(area / 100.0 + 0.5), 9)) WHEN service = 'school' THEN 3 WHEN service = 'kindergarten' THEN 2 ELSE 1 END AS INTEGER) AS floors FROM c)"""


def _fill(rows: str) -> str:
    """x of rows r (c_custkey, zone, cap, weight, demand): for every item the level at which it would be the first that isn't full; the least index that fits is taken."""
    return rows + """, o AS (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY cap / weight, c_custkey) AS k FROM r),
t AS (SELECT a.zone, a.k, (a.demand - coalesce(sum(b.cap) FILTER (b.k < a.k), 0)) / sum(b.weight) FILTER (b.k >= a.k) AS level, a.cap / a.weight AS lim FROM o a JOIN o b USING (zone) GROUP BY a.zone, a.k, a.demand, a.cap, a.weight),
z AS (SELECT zone, arg_min(level, k) AS level FROM t WHERE level <= lim GROUP BY zone),
x AS (SELECT o.*, CASE WHEN z.level IS NULL THEN cap ELSE greatest(0, least(cap, z.level * weight)) END AS x FROM o LEFT JOIN z USING (zone))"""


_LIVING = "WITH " + _DEMAND + """, s AS (SELECT *, CASE WHEN living THEN area * floors ELSE 0.0 END AS size FROM f),
u AS (SELECT *, CASE WHEN target > 0 THEN greatest(sum(0.5 * size) OVER (PARTITION BY zone), least(sum(0.75 * size) OVER (PARTITION BY zone), target)) END AS used, sum(0.5 * size) OVER (PARTITION BY zone) AS low FROM s), """ + _fill(
    "r AS (SELECT *, (0.75 - 0.5) * size AS cap, 1 / (1e-6 + distance) AS weight, used - low AS demand FROM u)"
) + ", y AS (SELECT *, CASE WHEN used IS NOT NULL AND size > 0 THEN 0.5 * size + x ELSE 0.0 END AS living_area, CASE WHEN used IS NOT NULL AND size > 0 THEN greatest(0.5, least(0.75, (0.5 * size + x) / size)) END AS share FROM x) "

SQL = {
    "density_hist": f"WITH {_HIST} SELECT event_type, i, j, v FROM h",
    "density_smooth": f"WITH {_SMOOTH} SELECT * FROM d",
    "density_levels": f"WITH {_SMOOTH}, dd AS (SELECT * FROM d), {_LEVELS} SELECT * FROM lv",
    "contour_segments": f"""WITH {_SMOOTH}, dd AS (SELECT event_type, i, j, inside, round(v, 9) AS v FROM d), {_LEVELS},
sq AS (SELECT a.event_type, a.i, a.j, a.v AS a, b.v AS b, c.v AS c, e.v AS d FROM dd a JOIN dd b ON b.event_type = a.event_type AND b.i = a.i AND b.j = a.j + 1
  JOIN dd c ON c.event_type = a.event_type AND c.i = a.i + 1 AND c.j = a.j + 1 JOIN dd e ON e.event_type = a.event_type AND e.i = a.i + 1 AND e.j = a.j),
p AS (SELECT event_type, level, i, j, (a + b + c + d) / 4 >= level AS mid, a >= level AS ha,
  list_filter([CASE WHEN (a >= level) <> (b >= level) THEN [j + (level - a) / (b - a), i] END, CASE WHEN (b >= level) <> (c >= level) THEN [j + 1, i + (level - b) / (c - b)] END,
   CASE WHEN (c >= level) <> (d >= level) THEN [j + (level - d) / (c - d), i + 1] END, CASE WHEN (d >= level) <> (a >= level) THEN [j, i + (level - a) / (d - a)] END], lambda x: x IS NOT NULL) AS x
  FROM sq JOIN lv USING (event_type)),
g AS (SELECT event_type, level, i, j, x[1] AS p, CASE WHEN len(x) = 2 OR mid = ha THEN x[2] ELSE x[4] END AS q FROM p WHERE len(x) >= 2
  UNION ALL SELECT event_type, level, i, j, CASE WHEN mid = ha THEN x[3] ELSE x[2] END, CASE WHEN mid = ha THEN x[4] ELSE x[3] END FROM p WHERE len(x) = 4)
SELECT event_type, level, i, j, p[1] AS x1, p[2] AS y1, q[1] AS x2, q[2] AS y2 FROM g""",
    "tagged_cells": f"""WITH {_SMOOTH}, dd AS (SELECT event_type, i, j, inside, round(v, 9) AS v FROM d), {_LEVELS}
SELECT event_type, i AS row_i, j AS col_j, CAST(count(level) AS INTEGER) AS n_levels, max(level) AS level FROM dd LEFT JOIN lv ON lv.event_type = dd.event_type AND dd.inside AND dd.v >= lv.level GROUP BY dd.event_type, i, j""".replace("SELECT event_type, i AS row_i", "SELECT dd.event_type, i AS row_i"),
    "block_cell_areas": "WITH " + spatials._GEO + " SELECT id AS block_id, sum(area) AS area FROM pa WHERE kind = 'block' GROUP BY ALL",
    "merged_groups": """WITH RECURSIVE c AS (SELECT CAST(p_partkey // 400 AS VARCHAR) AS zone, (p_partkey % 400) // 20 AS r, p_partkey % 20 AS q, CAST(p_size % 3 AS VARCHAR) AS service, substr(p_type, 1, 1) AS type FROM part WHERE p_size > 15),
k AS (SELECT *, zone || ':' || lpad(CAST(r AS VARCHAR), 6, '0') || ':' || lpad(CAST(q AS VARCHAR), 6, '0') AS node FROM c),
e AS (SELECT a.node AS a, b.node AS b FROM k a JOIN k b ON a.zone = b.zone AND a.service = b.service AND abs(a.r - b.r) <= 1 AND abs(a.q - b.q) <= 1),
reach(a, b) AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
m AS (SELECT a AS node, min(b) AS component FROM reach GROUP BY a)
SELECT component, service, count(*) AS n_members, CAST(count(*) AS BIGINT) AS n_cells, array_to_string(list_sort(list_distinct(list(type))), ',') AS types FROM k JOIN m USING (node) GROUP BY component, service""",
    "neighbour_counts": f"WITH {_BOARD} SELECT zone, row_i, col_j, inside, degree, greatest(0, 8 - degree) AS missing, empty, side_inside FROM k",
    "three_sides": f"WITH {_BOARD} SELECT zone, row_i, col_j, inside, inside OR side_inside >= 3 AS closed FROM k",
    "neighbour_levels": f"""WITH {_BOARD}, g AS (SELECT zone, row_i, col_j, level, count(*) AS n FROM nb WHERE side AND level IS NOT NULL GROUP BY ALL),
m AS (SELECT *, row_number() OVER (PARTITION BY zone, row_i, col_j ORDER BY n DESC, level) AS q FROM g)
SELECT zone, row_i, col_j, CAST(coalesce(c.level, m.level) AS INTEGER) AS level FROM c LEFT JOIN (SELECT * FROM m WHERE q = 1) m USING (zone, row_i, col_j)""",
    "zone_centres": f"WITH {_BOARD} SELECT zone, coalesce(median(row_i) FILTER (residential), median(row_i)) AS r_center, coalesce(median(col_j) FILTER (residential), median(col_j)) AS c_center, max(level) AS top FROM c GROUP BY zone",
    "floors_rule": f"WITH {_DEMAND} SELECT c_custkey, floors FROM f",
    "waterfill": f"WITH {_DEMAND}, " + _fill("r AS (SELECT c_custkey, zone, area * 2 AS cap, 1 / distance AS weight, target / 2 AS demand FROM c)") + " SELECT c_custkey, zone, x FROM x",
    "living_area": _LIVING + "SELECT c_custkey, zone, living_area, share FROM y",
    "zone_summary": _LIVING + "SELECT zone, max(target) AS target_requested, max(used) AS target_used, sum(0.5 * size) AS cap_min, sum(0.75 * size) AS cap_max, count(*) AS n_buildings, avg(share) AS mean_k, sum(living_area) AS sum_living_area FROM y GROUP BY zone",
    "zone_parameters": """SELECT CAST(n_nationkey AS VARCHAR) AS zone_id, n_name AS zone, CASE WHEN n_nationkey < 5 AND n_nationkey <> 2 THEN n_nationkey * 100e0 WHEN n_nationkey % 2 = 0 THEN 7e0 END AS target,
CAST(CASE WHEN n_nationkey = 3 THEN 4 WHEN n_nationkey % 2 = 0 THEN 5 ELSE 9 END AS INTEGER) AS max_floor FROM nation""",
    "fitted_areas": f"WITH {_DEMAND} SELECT c_custkey, zone, CASE WHEN NOT living THEN 0.0 WHEN sum(area) FILTER (living) OVER (PARTITION BY zone) > 0 THEN area * target / sum(area) FILTER (living) OVER (PARTITION BY zone) ELSE target / count(*) FILTER (living) OVER (PARTITION BY zone) END AS area FROM c",
    "collisions": f"""WITH {sequences._C}, p AS (SELECT block_id, slot_id AS id, posx AS x, posy AS y FROM c WHERE slot_id < 24),
s AS (SELECT a.block_id, sum(greatest(0, 0.2 - sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) ** 2) AS s FROM p a JOIN p b ON a.block_id = b.block_id AND a.id < b.id GROUP BY ALL)
SELECT block_id, coalesce(s, 0.0) / greatest(n * (n - 1) / 2, 1) AS collision FROM (SELECT block_id, count(*) AS n FROM p GROUP BY ALL) LEFT JOIN s USING (block_id)""",
    "loss_values": f"""WITH {sequences._C}, r AS (SELECT block_id, 1 / (1 + exp(-posx * 2)) AS p, CAST(s_i % 2 AS DOUBLE) AS e, posx AS x, posy AS y, size_x AS px, size_y AS py, CASE WHEN living_area IS NULL OR isnan(living_area) THEN 0.0 ELSE living_area END AS la, 1000e0 AS pla FROM c)
SELECT block_id, avg(-((e * 0.95 + 0.025) * ln(greatest(p, 1e-12)) + (1 - (e * 0.95 + 0.025)) * ln(greatest(1 - p, 1e-12)))) AS existence, sum((abs(px - x) + abs(py - y)) * e) / greatest(sum(e), 1) AS position,
sum(abs(pla - la) * e) / greatest(sum(e), 1) AS area, (sum(pla * p) - sum(la * e)) ** 2 AS area_sum FROM r GROUP BY block_id""",
}
