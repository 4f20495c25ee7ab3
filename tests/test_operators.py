"""Geometry, rasters, grids, allocation, placement, sampling: closed forms and invariants."""

import math
import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from blockloom.functions import geometry as G
from blockloom.functions import planar
from blockloom.functions import scalars as S
from blockloom.operators import allocation, canon, graph, grid, learning, ordered, placement, raster, sampling, spatial, stats

SQUARE, HOLED = "POLYGON ((0 0, 4 0, 4 3, 0 3, 0 0))", "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (2 2, 2 4, 4 4, 4 2, 2 2))"
L = "POLYGON ((0 0, 10 0, 10 5, 5 5, 5 10, 0 10, 0 0))"
U = "POLYGON ((0 0, 12 0, 12 10, 10 10, 10 2, 2 2, 2 10, 0 10, 0 0))"
X = "POLYGON ((3 0, 6 0, 6 3, 9 3, 9 6, 6 6, 6 9, 3 9, 3 6, 0 6, 0 3, 3 3, 3 0))"


def one(text):
    return planar.largest(planar.read_wkt(text))


def test_shapes():
    assert [planar.shape_class(one(t)) for t in (SQUARE, L, U, X, HOLED)] == [0, 1, 2, 3, 2]
    assert [planar.reflex(one(t)[0]) for t in (SQUARE, L, U, X)] == [0, 1, 2, 4]
    assert planar.reflex(one(L)[0][::-1]) == 1


def test_measures(spark):
    rows = spark.createDataFrame([(t,) for t in (SQUARE, HOLED, L, f"MULTI{SQUARE.replace('((', '(((').replace('))', ')), ((50 50, 60 50, 60 60, 50 60, 50 50)))')}")], "t string")
    part = G.largest_part(G.parts(F.col("t")))
    got = [tuple(r) for r in rows.select(G.part_area(part), G.length(F.get(part, F.lit(0))), G.reflex_corners(F.get(part, F.lit(0)))).collect()]
    assert got == [(12.0, 14.0, 0), (96.0, 40.0, 0), (75.0, 40.0, 1), (100.0, 40.0, 0)]


@settings(max_examples=60, deadline=None)
@given(st.floats(0, 3.1), st.floats(1, 50), st.floats(1, 50), st.floats(-1e6, 1e6))
def test_least_rectangle_of_a_turned_one(angle, w, h, at):
    c, s = math.cos(angle), math.sin(angle)
    p = np.array([[at + x * c - y * s, at + x * s + y * c] for x, y in ((0, 0), (w, 0), (w, h), (0, h), (w / 2, h / 2))])
    a, b, u, v = planar.rectangle_axes(planar.least_rectangle(p))
    assert a == pytest.approx(max(w, h), rel=1e-4) and b == pytest.approx(min(w, h), rel=1e-4) and abs(float(u @ v)) < 1e-3 * a * b


@settings(max_examples=60, deadline=None)
@given(st.floats(-8, 12), st.floats(-8, 12), st.floats(1, 9), st.floats(1, 9))
def test_overlap_of_boxes(x, y, w, h):
    box = np.array([[x, y], [x + w, y], [x + w, y + h], [x, y + h]])
    want = max(0, min(10, x + w) - max(0, x)) * max(0, min(10, y + h) - max(0, y)) - max(0, min(4, x + w) - max(2, x)) * max(0, min(4, y + h) - max(2, y))
    assert planar.overlap(one(HOLED), box) == pytest.approx(want, abs=1e-6)


def test_planar_leaves():
    assert [[r.tolist() for r in p] for p in planar.read_wkb(planar.write_wkb(planar.read_wkt(HOLED)))] == [[r.tolist() for r in p] for p in planar.read_wkt(HOLED)]
    assert planar.simplified(np.array([[0, 0], [1, 0.01], [2, 0], [3, 5.0]]), 0.1).tolist() == [[0, 0], [2, 0], [3, 5]]
    p = planar.inner_point(one(U))
    e = np.vstack([np.hstack([r[:-1], r[1:]]) for r in one(U)])
    assert planar.inside(e, p[:1], p[1:])[0]


def test_intersections(spark):
    a = spark.createDataFrame([("p", "POINT (1 1)"), ("q", "POLYGON ((4 0, 6 0, 6 2, 4 2, 4 0))"), ("r", "POLYGON ((20 20, 21 20, 21 21, 20 20))"), ("s", "POLYGON ((1 1, 2 1, 2 2, 1 1))")], "id string, wkt string")
    b = spark.createDataFrame([("x", SQUARE), ("y", "POLYGON ((300 300, 600 300, 600 600, 300 600, 300 300))")], "id string, wkt string")
    assert sorted(map(tuple, spatial.intersecting(a, b).collect())) == [("p", "x"), ("q", "x"), ("s", "x")]
    got = {r.a_id: r.area for r in spatial.overlaps(a.filter("id <> 'p'"), b).collect()}
    assert got == pytest.approx({"s": 0.5})
    every = {r.id: (r.area_id, r.step) for r in spatial.assign_areas(a.filter("id <> 'p'"), b).collect()}
    assert every == {"q": (None, None), "r": (None, None), "s": ("x", "centre")}


def test_services(spark):
    buildings = spark.createDataFrame([("a", "POLYGON ((0 0, 5 0, 5 5, 0 5, 0 0))"), ("b", "POLYGON ((5 0, 9 0, 9 5, 5 5, 5 0))")], "id string, wkt string")
    rows = [("1", " Школа ", None, 7.0, None, "POLYGON ((4 1, 6 1, 6 2, 4 2, 4 1))"), ("2", "школа", float("nan"), None, None, "POINT (1 1)"), ("3", "Парк", 1.0, None, None, "POINT (1 1)"),
            ("4", "Школа", 3.0, None, None, "POLYGON ((90 90, 91 90, 91 91, 90 90))"), ("5", "Школа", 3.0, None, None, "POINT (90 90)"), ("6", None, 1.0, None, None, "POINT (1 1)")]
    services = spark.createDataFrame(rows, "service_id string, service_type_name string, capacity double, capacity_modeled double, weight_value double, geometry string")
    on, free = spatial.attach_services(buildings, services)
    assert sorted((r.building_id, r.service, r.capacity) for r in on.collect()) == [("a", "школа", 8.0), ("b", "школа", 7.0)]
    assert [(r.id, r.capacity) for r in free.collect()] == [("s:4", 3.0)]
    wide = {r.building_id: r["service_capacity__школа"] for r in spatial.services_wide(on, ["школа", "сад"]).collect()}
    assert wide == {"a": 8.0, "b": 7.0}


def test_scalars(spark):
    one_row = spark.range(1)
    texts = ["Детский сад", "Приём / Выдача", "  ", "A--b"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(S.slug(F.col("t"))).collect()]
    assert got == ["детскии_сад", "прие_м_выдача", "service", "a_b"]
    r = one_row.select(
        S.wrapped(F.lit(190.0)), S.axis_angle(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(-1.0)), S.unit(F.lit(0.0), F.lit(0.0)), S.half_up(F.lit(2.5)), S.half_even(F.lit(2.5)),
        S.lenient_number(F.lit(" YES ")), S.slots_per_side(F.lit(250.0), F.lit(90.0)), S.comma_list(F.lit(" a, ,b")), S.number(F.lit("nan"), 4),
        S.people([F.lit("-3"), F.lit("2.9")], 7), F.size(S.position_code(F.lit(0.1), F.lit(0.2))),
    ).first()
    assert r[0] == -170 and r[1] == pytest.approx(-math.pi / 2) and tuple(r[2]) == (1.0, 0.0) and r[3] == 3 and r[4] == 2.0 and r[5] == 1.0 and r[6] == 3
    assert r[7] == ["a", "b"] and r[8] == 4.0 and r[9] == 2 and r[10] == 18
    lon, lat = G.to_degrees(*G.to_mercator(F.lit(30.3), F.lit(59.9)))
    assert one_row.select(lon, lat).first() == pytest.approx((30.3, 59.9))


def test_runs(spark):
    cells = spark.createDataFrame([(0, c) for c in range(20)] + [(0, 25), (1, 3)], "r int, c int")
    kept = {(x.r, x.c) for x in ordered.run_mask(cells, ["r"], "c").filter("keep").collect()}
    assert kept == {(0, c) for c in range(20) if c not in (8, 17)} | {(0, 25), (1, 3)}


def test_knn_is_brute_force(spark):
    rng = np.random.default_rng(7)
    xy = np.vstack([rng.normal(0, 0.01, (80, 2)), rng.uniform(-9, 9, (60, 2)), [[1.0, 1.0]] * 5])
    rows = [("g", i, float(x), float(y)) for i, (x, y) in enumerate(xy)] + [("small", 0, 0.0, 0.0), ("small", 1, 1.0, 0.0), ("alone", 0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "g string, id int, x double, y double")
    near = {(r.g, r.src, r["rank"]): r.dst for r in graph.knn_near(df, ["g"], "id", "x", "y", 4).collect()}
    brute = {(r.g, r.src, r["rank"]): r.dst for r in graph.knn(df, ["g"], "id", ["x", "y"], 4).collect()}
    assert near == brute


def test_components_of_paths_and_cycles(spark):
    pairs = [(i, i + 1) for i in range(100)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(pairs, "a int, b int")).collect()}
    assert got == {**{i: 0 for i in range(101)}, 200: 200, 201: 200, 202: 200, 300: 300}


def filled(demand, weights, caps):
    x, left = np.zeros(len(caps)), list(range(len(caps)))
    while left and demand > 1e-12:
        share = demand / sum(weights[i] for i in left)
        full = [i for i in left if caps[i] <= share * weights[i]]
        if not full:
            for i in left:
                x[i] = share * weights[i]
            break
        for i in full:
            x[i] = caps[i]
            demand -= caps[i]
        left = [i for i in left if i not in full]
    return x


def test_water_fill(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for g in range(40):
        n = rng.randrange(1, 9)
        w, c = [rng.uniform(0.1, 3) for _ in range(n)], [rng.choice([0.0, rng.uniform(0, 4)]) for _ in range(n)]
        d = rng.choice([0.0, rng.uniform(0, 12)])
        want |= {(g, i): v for i, v in enumerate(filled(d, w, c))}
        rows += [(g, i, d, w[i], c[i]) for i in range(n)]
    out = allocation.water_fill(spark.createDataFrame(rows, "g int, i int, d double, w double, c double"), ["g"], "d", "w", "c", ["i"])
    got = {(r.g, r.i): r.x for r in out.collect()}
    assert got == pytest.approx(want, abs=1e-9)


def test_slots_per_branch(spark):
    rng = random.Random(5)
    rows = [(b, k, rng.randrange(1, 40)) for b in range(30) for k in range(rng.randrange(1, 14))] + [(99, k, 1) for k in range(20)]
    out = allocation.slots_per_branch(spark.createDataFrame(rows, "block_id int, branch int, n int"), 12).collect()
    for b in {r[0] for r in rows}:
        s = [r.slots for r in out if r.block_id == b]
        assert min(s) >= 1 and sum(s) == max(12, len(s))


def test_raster(spark):
    n = 9
    full = raster.lattice(spark.range(1).select(F.lit("a").alias("g")), n).withColumns({"v": ((F.col("i") * 7 + F.col("j") * 3) % 5).cast("double"), "mask": F.lit(1)})
    got = {(r.i, r.j): r.v for r in raster.smooth(full.select("g", "i", "j", "v"), ["g"], ["v"], n, 0.8).collect()}
    w = raster.kernel(0.8)
    r = len(w) // 2
    grid_v = np.array([[(i * 7 + j * 3) % 5 for j in range(n)] for i in range(n)], float)
    padded = np.pad(grid_v, r, mode="edge")
    want = {(i, j): float(np.outer(w, w).ravel() @ padded[i : i + 2 * r + 1, j : j + 2 * r + 1].ravel()) for i in range(n) for j in range(n)}
    assert got == pytest.approx(want)
    flat = raster.density(full.withColumn("v", F.lit(9.0)), ["g"], n, 0.8, 3.0)
    assert flat.filter("abs(v - 1) > 1e-9").count() == 0


def test_contour_of_a_hill(spark):
    n = 21
    hill = raster.lattice(spark.range(1).select(F.lit("a").alias("g")), n).select("g", "i", "j", (-F.hypot(F.col("i") - 10.0, F.col("j") - 10.0)).alias("v"))
    at = spark.createDataFrame([("a", -6.0)], "g string, level double")
    lines = raster.contour_lines(raster.contour_segments(hill, ["g"], at), ["g"]).collect()
    assert len(lines) == 1 and lines[0].closed and lines[0].length == pytest.approx(2 * math.pi * 6, rel=0.02)


def test_cells_of_a_block(spark):
    blocks = spark.createDataFrame([("a", "POLYGON ((0 0, 100 0, 100 100, 0 100, 0 0), (20 20, 20 40, 40 40, 40 20, 20 20))"), ("b", None)], "block_id string, geometry string")
    cells = grid.cells_of_blocks(blocks, 30.0).collect()
    assert sum(c.area for c in cells) == pytest.approx(9600) and sorted(c.cell_id for c in cells) == list(range(16))
    masks = raster.block_mask(blocks, 10).collect()
    assert len(masks) == 1 and sum(masks[0]["mask"]) == 96


def test_grid_rules(spark):
    cells = spark.createDataFrame([("z", r, c, (r, c) != (1, 1), False) for r in range(3) for c in range(3)], "zone string, row_i int, col_j int, inside boolean, small boolean")
    assert grid.close_three_sides(cells, ["zone"]).filter("not closed").count() == 0
    counts = {(r.row_i, r.col_j): (r.degree, r.missing, r.empty) for r in grid.neighbour_counts(cells, ["zone"]).collect()}
    assert counts[1, 1] == (8, 0, 0) and counts[0, 0] == (3, 5, 1)
    built = spark.createDataFrame([("z", 0, 0), ("z", 1, 1), ("z", 5, 5), ("z", 8, 8), ("z", 8, 9)], "zone string, row_i int, col_j int").withColumn("is_building", F.lit(True))
    assert grid.diagonal_groups(built, ["zone"]).count() == 2
    houses = grid.building_cells(spark.range(900).select(F.lit("z").alias("zone"), F.expr("id div 30").alias("row_i"), (F.col("id") % 30).alias("col_j"), F.lit(True).alias("inside"), F.lit(False).alias("small")), ["zone"])
    for key, at in (("row_i", "col_j"), ("col_j", "row_i")):
        runs = houses.filter("is_building").groupBy(key).agg(F.sort_array(F.collect_list(at)).alias("x")).collect()
        for r in runs:
            ids = np.split(np.array(r.x), np.flatnonzero(np.diff(r.x) > 1) + 1)
            assert max(map(len, ids)) <= 8


def test_sites_keep_their_gaps(spark):
    cells = spark.range(2 * 6400).select(
        F.expr("id div 6400").cast("string").alias("zone"), F.expr("(id % 6400) div 80").alias("row_i"), (F.col("id") % 80).alias("col_j"), (F.col("id") % 80 > 20).alias("inside"),
        F.lit(1).alias("level"), (F.col("id") % 1601 == 5).alias("is_building"),
    )
    sites = placement.place_services(cells).collect()
    assert len({(s.zone, s.site_id) for s in sites}) == len(sites) >= 6
    for a in sites:
        assert a.height * a.width * placement.CELL**2 >= placement.NORMS[a.service, a.pattern][1]
        for b in sites:
            if a.zone == b.zone and a.site_id < b.site_id:
                gap = lambda p, s, q, t: max(p - (q + t - 1), q - (p + s - 1))
                far = max(gap(a.row_i, a.height, b.row_i, b.height), gap(a.col_j, a.width, b.col_j, b.width))
                assert far >= (placement.SAME_GAP if a.service == b.service else placement.SITE_GAP)
    assert len(placement.turns(placement.PATTERNS["kindergarten"]["H7"])) == 2


def test_matching_and_repulsion(spark):
    slots = spark.createDataFrame([("b", i, i / 4, 0.0) for i in range(5)], "block_id string, slot_id long, x double, y double")
    targets = spark.createDataFrame([("b", 7, True, 0.0, 0.0), ("b", 8, True, 0.05, 0.0), ("b", 9, False, 1.0, 0.0)], "block_id string, target_id long, active boolean, x double, y double")
    got = {r.slot_id: r.target_id for r in placement.match_slots(slots, targets).collect()}
    assert got == {0: 7, 1: 8, 4: 9, 2: 8, 3: 9} or got == {0: 7, 1: 8, 4: 9, 2: 9, 3: 9}
    points = spark.createDataFrame([("b", i, 0.001 * i, 0.0) for i in range(6)], "block_id string, id int, x double, y double")
    moved = placement.repel(points, "block_id", 0.1, sweeps=400).collect()
    assert min(math.dist((a.x, a.y), (b.x, b.y)) for a in moved for b in moved if a.id < b.id) > 0.08
    rects = spark.createDataFrame([("b", 1, 0.0, 0.0, 2.0, 2.0, 5.0), ("b", 2, 0.5, 0.0, 2.0, 2.0, 4.0), ("b", 3, 9.0, 0.0, 2.0, 2.0, 1.0)], "block_id string, id int, x double, y double, w double, h double, score double")
    assert sorted(r.id for r in placement.suppress(rects).collect()) == [1, 3]


def test_sampling(spark):
    items = spark.createDataFrame([(f"k{i}", f"g{i % 3}", float(i)) for i in range(10)], "k string, g string, w double")
    draws = sampling.weighted_draws(items, "k", "w", 9000)
    n = {r.k: r["count"] for r in draws.groupBy("k").count().collect()}
    assert draws.count() == 9000 and "k0" not in n and all(abs(n[f"k{i}"] / 9000 - i / 45) < 0.02 for i in range(1, 10))
    assert sampling.uniform_by_group(items, "k", "g", 50).count() == 50 and sampling.stratified(items, "k", "w", ["g"], 51).count() == 51
    special = items.filter("k = 'k9'").select("k")
    batches = sampling.two_stream_batches(sampling.weighted_draws(items, "k", "w", 60), sampling.uniform_by_group(items, "k", "g", 20), special, "k", 8, 0.75)
    sizes = batches.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("k") == "k9").alias("s")).collect()
    assert len(sizes) == 10 and all(r.n == 8 and r.s >= 1 for r in sizes)
    assert sampling.sample_rows(items, ["k"], 4).count() == 4


def test_canonical_tables(spark):
    blocks = spark.createDataFrame([("a", "POLYGON ((0 0, 100 0, 100 50, 0 50, 0 0))"), ("b", "POLYGON ((200 0, 300 0, 300 100, 200 100, 200 0))"), ("c", "POLYGON ((900 0, 950 0, 950 10, 900 0))")], "block_id string, geometry string")
    box = lambda x, y, w, h: f"POLYGON (({x} {y}, {x + w} {y}, {x + w} {y + h}, {x} {y + h}, {x} {y}))"
    rows = [("a", f"x{i}", box(3 * i, 5 + i, 2, 4)) for i in range(30)] + [("b", "y", box(250, 50, 10, 4))]
    found = canon.building_features(spark.createDataFrame(rows, "block_id string, building_id string, geometry string"), canon.block_axes(blocks))
    active = canon.nodes(found, 12)
    every = canon.padded(active, blocks, 12).collect()
    assert len(every) == 36 and {b: sum(r.e_i for r in every if r.block_id == b) for b in "abc"} == {"a": 12, "b": 1, "c": 0}
    assert all(-1 <= r.posx <= 1 for r in every) and all(r.building_id is None for r in every if r.e_i == 0)
    edges = {(r.block_id, r.src_slot, r.dst_slot) for r in canon.edges(active, 3).collect()}
    assert edges and all((b, t, s) in edges and s != t for b, s, t in edges)


def test_learning_parts(spark):
    rows = spark.createDataFrame([("a", 0, 0.0, 0.0), ("a", 1, 0.1, 0.0), ("a", 2, 5.0, 5.0)], "block_id string, id int, x double, y double")
    assert learning.collisions(rows, 0.2).first().collision == pytest.approx(0.01 / 3)
    out = learning.decode_predictions(spark.createDataFrame([(1.0, math.log1p(2.0), 10.0, 3.0, math.log1p(50.0)), (-1.0, 0.0, 10.0, -3.0, 9.0)], "e_logit double, la_code double, scale_l double, presence double, cap_code double")).collect()
    assert out[0].exists and out[0].capacity == pytest.approx(50) and out[0].living_area == pytest.approx(200, rel=1e-6) and not out[1].exists and out[1].capacity == 0
    doubled = learning.predict(spark.range(3), lambda pdf: pdf.assign(id=pdf["id"] * 2), "id long")
    assert sorted(r.id for r in doubled.collect()) == [0, 2, 4]
    profile = spark.createDataFrame([(f"b{i}", float(i % 2)) for i in range(30)], "block_id string, f double")
    assert learning.strata(profile, ["f"], k=2).select("stratum").distinct().count() == 2
    assert learning.strata(profile.limit(1), ["f"], k=2).first().stratum == -1
    mean = graph.neighbour_mean(spark.createDataFrame([("a", 0, 2.0), ("a", 1, 4.0)], "block_id string, slot_id int, f double"), spark.createDataFrame([("a", 0, 1)], "block_id string, src_slot int, dst_slot int"), ["f"])
    assert sorted((r.slot_id, r.mean_f) for r in mean.collect()) == [(0, 0.0), (1, 2.0)]
    assert stats.split_ids(spark.createDataFrame([(f"{i}",) for i in range(5)], "block_id string"), 0.5).filter("split = 'train'").count() == 2


def test_small_additions(spark):
    texts = ["[1, 2.5]", "['3', 4]", '{"a": 5}', "x", None, "[1, oops]"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(S.number_list(F.col("t"))).collect()]
    assert got[:5] == [[1.0, 2.5], [3.0, 4.0], [5.0], None, None]
    points = spark.createDataFrame([("a", i, float(i), 2.0 * i) for i in range(5)] + [("b", 1, 5.0, 0.0), ("b", 0, 0.0, 1.0)], "g string, k int, x double, y double")
    angles = {r.g: (r.angle, r.spread) for r in stats.principal_angles(points, ["g"]).collect()}
    assert angles["a"] == pytest.approx((math.atan(2), 1.0))
    places = {(r.g, r.k): r.place for r in stats.along_axis(points, ["g"], "k").collect()}
    assert [places["a", i] for i in range(5)] == [0, 1, 2, 3, 4] and places["b", 0] == 0
    cells = spark.createDataFrame([("c", 1.0, 1.0, 2.0, 2.0), ("d", 3.0, 2.5, 5.0, 4.0)], "id string, x0 double, y0 double, x1 double, y1 double")
    zones = spark.createDataFrame([("z", SQUARE)], "k string, geometry string")
    assert {r.id: r.zone for r in grid.cells_in_zones(cells, zones, "k", "geometry").collect()} == {"c": "z", "d": None}


def one_pair_after_another(x, y, least, sweeps):
    for _ in range(sweeps):
        for i in range(len(x)):
            sx, sy = x[i], y[i]
            for j in [j for j in range(i + 1, len(x)) if math.dist((sx, sy), (x[j], y[j])) < least - 1e-12]:
                size = math.dist((x[i], y[i]), (x[j], y[j]))
                if size < least:
                    ux, uy = ((x[j] - x[i]) / size, (y[j] - y[i]) / size) if size > 1e-9 else (math.cos(i + j), math.sin(i + j))
                    px, py = ux * (least - size) / 2, uy * (least - size) / 2
                    x[i], y[i], x[j], y[j] = (min(max(v, -1.0), 1.0) for v in (x[i] - px, y[i] - py, x[j] + px, y[j] + py))
    return x, y


def test_repulsion_of_many_and_large_blocks(spark):
    rng = np.random.default_rng(4)
    for n, b, least in ((24, 2000, 0.1), (150, 3, 0.1), (12, 40, 0.7), (9, 20, 3.0)):
        place = rng.uniform(-1, 1, (n, b)) + 1j * rng.uniform(-1, 1, (n, b))
        place[1, ::3] = place[0, ::3]
        place[np.arange(n)[:, None] >= rng.integers(1, n + 1, b)] = np.nan
        began = time.time()
        got = placement.push_apart(place, least, 4, -1.0, 1.0)
        took, began = time.time() - began, time.time()
        for k in range(b):
            there = ~np.isnan(place[:, k])
            x, y = one_pair_after_another(place[there, k].real.tolist(), place[there, k].imag.tolist(), least, 4)
            assert np.allclose(got[there, k], np.array(x) + 1j * np.array(y), rtol=0, atol=1e-9)
        assert b < 1000 or took < (time.time() - began) / 4
    rows = [(None if b == 3 else f"b{b}", i, *rng.uniform(-1, 1, 2).tolist()) for b in range(30) for i in range(b)] + [("n", 0, 0.0, None), ("n", 1, 0.01, 0.0)]
    points = spark.createDataFrame(rows, "block_id string, id int, x double, y double")
    moved = {(r.block_id, r.id): (r.x, r.y) for r in placement.repel(points.repartition(7), "block_id", 0.1).collect()}
    assert len(moved) == len(rows)
    assert moved["n", 0] == (0.0, None) and moved["n", 1] == (0.01, 0.0)
    for b in range(30):
        mine = [r for r in rows if r[0] == (None if b == 3 else f"b{b}")]
        x, y = one_pair_after_another([r[2] for r in mine], [r[3] for r in mine], 0.1, 12)
        assert all(moved[r[:2]] == pytest.approx(p) for r, p in zip(mine, zip(x, y)))


def test_sites_on_whole_blocks(spark):
    rng = random.Random(6)
    ring = lambda *p: "(" + ", ".join(f"{x} {y}" for x, y in (*p, p[0])) + ")"
    turned = lambda x, y, a, b, s: ring((x, y), (x + a, y + s), (x + a - s, y + b), (x - s, y + b - s))
    shapes = [f"POLYGON ({turned(3e6 + 400 * k, 2e6, rng.randint(150, 330), rng.randint(150, 330), rng.randint(-20, 40))})" for k in range(6)]
    shapes += [f"POLYGON ({ring((0, 0), (300, 0), (300, 300), (0, 300))}, {ring((45, 45), (100, 50), (95, 130))})", f"POLYGON ({ring((900, 0), (1200, 300), (1200, 0), (900, 300))})", "POLYGON ((7 7, 7 8, 8 7, 7 7))"]
    shapes.append(f"MULTIPOLYGON (({turned(2000, -700, 200, 310, 12)}), ({turned(2260, -700, 150, 310, -9)}))")
    took = slow = 0.0
    for text in shapes:
        parts = planar.read_wkt(text)
        began = time.time()
        areas, r0, c0 = planar.cell_areas(parts, 15.0)
        took, began = took + time.time() - began, time.time()
        for (i, j), a in np.ndenumerate(areas):
            x, y = (j + c0) * 15.0, (i + r0) * 15.0
            assert a == pytest.approx(sum(planar.overlap(p, np.array([[x, y], [x + 15, y], [x + 15, y + 15], [x, y + 15]])) for p in parts), abs=1e-6)
        slow += time.time() - began
    assert took < slow / 10
    blocks = spark.createDataFrame(list(enumerate([*shapes, None])), "block_id string, geometry string")
    cells = grid.clipped_cells(blocks, 15.0).cache()
    houses = cells.filter("pmod(hash(gi, gj), 61) = 3").select("gi", "gj").distinct()
    flags = cells.join(houses.withColumn("is_building", F.lit(True)), ["gi", "gj"], "left").select(
        F.col("block_id").alias("zone"), F.col("gi").alias("row_i"), F.col("gj").alias("col_j"), (F.col("area") >= 112.5).alias("inside"), F.pmod("gi", F.lit(4)).alias("level"), F.coalesce("is_building", F.lit(False)).alias("is_building")
    )
    got, wanted = placement.place_on_blocks(blocks, houses, 4).collect(), placement.place_services(flags).collect()
    assert sorted(got) == sorted(wanted) and len({r.zone for r in got}) > 4
