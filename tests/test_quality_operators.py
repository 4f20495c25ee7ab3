"""The general data problems against brute force, with nulls, ties, repeats, empty tables and clashing columns."""

import random
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from blockloom.operators import filling, nearby, profile, references
from blockloom.operators.prefix import running_sums

T0 = datetime(2024, 1, 1)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_running_sums_with_a_hot_key(spark):
    rng = random.Random(1)
    data = [("hot" if i % 3 == 0 else rng.choice(["a", "b", None]), i, rng.choice([1, 2, None])) for i in range(900)]
    got = rows(running_sums(spark.createDataFrame(data, "k string, o int, v int"), ["k"], ["o"], ["v"], partitions=7).select("k", "o", "run_v"))
    total, want = {}, []
    for k, o, v in data:
        total[k] = total.get(k, 0) + (v or 0)
        want.append((k, o, total[k]))
    assert got == sorted(want, key=repr)
    assert running_sums(spark.createDataFrame([], "k string, o int, v int"), ["k"], ["o"], ["v"]).count() == 0


def judged(ref, targets):
    loaded = [t for t in targets if t[0] <= ref]
    if not targets:
        return "missing"
    if not loaded:
        return "late"
    return "deleted" if all(d is not None and d <= ref for _, d in loaded) else None


def test_broken_references(spark):
    rng = random.Random(2)
    at = lambda: T0 + timedelta(days=rng.randrange(40))
    targets = [(rng.choice("abcdefgh"), at(), at() if rng.random() < 0.6 else None) for _ in range(14)] + [(None, at(), None)]
    refs = [("hot" if i % 3 == 0 else rng.choice([*"abcdefgh", "z", None]), at()) for i in range(200)]
    targets += [("hot", T0 + timedelta(days=9), T0 + timedelta(days=20))]
    t = spark.createDataFrame(targets, "id string, at timestamp, gone timestamp").withColumn("field", F.lit("clash")).withColumn("k1", F.lit(1))
    r = spark.createDataFrame(refs, "id string, at timestamp").withColumn("alive", F.lit("clash"))
    got = references.broken_references(
        [references.reference_deltas(r, "s", "f", (F.col("id"), F.lit(-1)), F.col("at"))],
        [references.existence_deltas(t, "s", (F.col("id"), F.lit(-1)), F.col("at"), F.col("gone"))],
    )
    want = set()
    for k, when in refs:
        status = k and judged(when, [(a, d) for i, a, d in targets if i == k])
        if status:
            want.add(("f", when.strftime("%Y-%m"), k, -1, status))
    assert set(map(tuple, got.collect())) == want and got.count() == len(want)


def test_reference_counts_merge(spark):
    r = spark.createDataFrame([("a", T0), ("b", T0), ("b", T0), (None, T0)], "id string, at timestamp")
    t = spark.createDataFrame([("a", T0, None), ("b", T0, T0)], "id string, at timestamp, gone timestamp")
    parts = [references.reference_deltas(r, "s", "f", (F.col("id"), F.lit(0)), F.col("at")), references.existence_deltas(t, "s", (F.col("id"), F.lit(0)), F.col("at"), F.col("gone"))]
    whole = references.counts_by_key(parts)
    again = references.counts_by_key([references.counts_by_key([p]) for p in parts])
    assert rows(whole) == rows(again)
    assert rows(references.current_orphans(whole)) == [("s", "b", 0, 2, "deleted")]
    assert references.current_orphans(references.counts_by_key([p.limit(0) for p in parts])).count() == 0


def test_close_pairs_and_crowds(spark):
    rng = np.random.default_rng(3)
    xy = np.round(rng.uniform(-200, 200, (250, 2)), 2).tolist() + [[5.0, 5.0]] * 20 + [[35.0, 5.0]] * 3
    points = [(f"p{i:03d}", float(x), float(y)) for i, (x, y) in enumerate(xy)]
    got = set(map(tuple, nearby.close_pairs(spark.createDataFrame(points, "id string, x double, y double"), 30.0).collect()))
    want = {(a[0], b[0]) for i, a in enumerate(points) for b in points[i + 1 :] if (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 <= 900}
    assert got == want
    assert nearby.close_pairs(spark.createDataFrame([], "id string, x double, y double"), 30.0).count() == 0


def test_sweep_over_small_batches():
    """The active set carries pairs over batch borders."""
    import pandas as pd

    rng = np.random.default_rng(4)
    x = np.sort(rng.uniform(0, 500, 300))
    y = rng.uniform(0, 100, 300)
    whole = pd.DataFrame({"strip": np.zeros(300, int), "tile": np.zeros(300, int), "x": x, "y": y})
    run = nearby.pair_sweep(30.0, 1e6, 1e6)
    one = pd.concat(run(iter([whole])))
    many = pd.concat(run(iter([whole.iloc[i : i + 7] for i in range(0, 300, 7)])))
    assert len(one) == len(many) and set(map(tuple, one.to_numpy())) == set(map(tuple, many.to_numpy()))


def test_regions(spark):
    shapes = [
        ("hole", "POLYGON ((0 0, 100 0, 100 100, 0 100, 0 0), (40 40, 60 40, 60 60, 40 60, 40 40))"), ("multi", "SRID=3857;multipolygon(((90 90,300 90,300 300,90 300,90 90)),((-50 -50,-10 -50,-10 -10,-50 -10,-50 -50)))"),
        ("none", None), ("empty", "POLYGON EMPTY"), (None, "POLYGON ((0 0, 9 0, 9 9, 0 0))"), ("bad", "POLYGON ((0 x, 1 1, 2 2, 0 x))"), ("hole", "POLYGON ((0 0, 100 0, 100 100, 0 100, 0 0), (40 40, 60 40, 60 60, 40 60, 40 40))"),
    ]
    areas = spark.createDataFrame(shapes, "k string, geometry string").withColumn("x", F.lit("clash"))
    points = spark.createDataFrame([("a", 50.0, 50.0), ("b", 20.0, 20.0), ("c", 95.0, 95.0), ("d", -20.0, -20.0), ("e", 9999.0, 0.0)], "id string, x double, y double")
    got = {(r.id, r.region) for r in nearby.regions_of(points, areas, "k").collect()}
    assert got == {("b", "hole"), ("c", "hole"), ("c", "multi"), ("d", "multi")}
    assert nearby.regions_of(points, areas.limit(0), "k").count() == 0


def test_locations(spark):
    data = [("p", "POINT (3 4)"), ("p", "POINT (3 4)"), ("q", "srid=3857; polygon  (( 0 0 ,10 0,10 4,0 0))"), ("r", "POINT EMPTY"), ("s", ""), ("t", None), ("u", "POINT (1e2 -2.5E1)")]
    assert rows(nearby.locations(spark.createDataFrame(data, "i string, geometry string"), "i")) == [("p", 3.0, 4.0), ("q", 5.0, 2.0), ("u", 100.0, -25.0)]


def test_storeys(spark):
    texts = ["5", " 5 ", "05", "5,0", "5.00", "5 эт.", "9 этажей", "12 fl", "150", "0", "151", "-1", "9999", "нет", "?", "", None, "5-9", "1974", "5 fl"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(filling.storeys(F.col("t"))).collect()]
    assert got == [5, 5, 5, 5, 5, 5, 9, 12, 150, None, None, None, None, None, None, None, None, None, None, 5]


BUILDINGS = "building_id string, series string, built_year int, floors_num string, living_area double, is_living boolean, has_floors boolean, loaded_at timestamp"


def test_filling(spark):
    def b(i, series, year, floors, area=10.0, living=True, has=True):
        return (i, series, year, floors, area, living, has, T0)

    data = [
        b("a", "S", 1960, "4"), b("b", "S", 1970, "8"), b("c", "S", 1965, None), b("d", "S", 1960, "?"), b("e", "S", 1980, None), b("f", None, None, None, float("nan"), None, None),
        b("g", "S", 1966, "5", 0.0), b("g", "S", 1966, "5", 0.0), b("h", "T", 1500, None, None), b("i", "S", 1975, None, 5.0, True, False),
    ]
    df = spark.createDataFrame(data, BUILDINGS).withColumn("field", F.lit("clash"))
    got = {(r.building_id, r.field): (r.value, r.method, r.distance) for r in filling.fill_missing(df).collect()}
    assert got["c", "floors_num"] == (5.0, "interpolated", 1)
    assert got["d", "floors_num"] == (4.0, "same_year", 0)
    assert got["e", "floors_num"] == (8.0, "carried_forward", 10)
    assert got["g", "living_area"] == (10.0, "interpolated", 1)
    assert got["f", "is_living"][1] == "overall" and got["h", "living_area"][1] == "overall"
    assert ("i", "floors_num") not in got and ("f", "has_floors") in got
    assert filling.fill_missing(df.limit(0)).count() == 0
    alone = filling.fill_missing(spark.createDataFrame([b("x", None, None, None, None, None, None)], BUILDINGS)).collect()
    assert {(r.field, r.value, r.method) for r in alone} == {(f, None, "none") for f in ("floors_num", "living_area", "is_living", "has_floors")}


def test_profile(spark):
    loads = [(1, x) for x in (1, 2, 2, None)] + [(2, x) for x in (1, 2, 2, 2)] + [(3, x) for x in (900, None, None, None)] + [(4, None)]
    df = spark.createDataFrame(loads, "load_id int, v int").withColumn("tbl", F.lit("clash"))
    hist = profile.histogram(df, "t", {"v": F.col("v").between(1, 150)})
    got = {r.load_id: r for r in profile.profile(hist).collect()}
    assert (got[1].n_rows, got[1].n_null, got[1].n_distinct, got[3].n_illegal, got[4].max_text) == (4, 1, 2, 1, None)
    assert got[2].exact and abs(got[2].mean - 1.75) < 1e-12 and got[4].mean is None
    found = {(r.load_id, r.finding) for r in profile.findings(hist).collect()}
    assert found == {(2, "nulls"), (3, "nulls"), (4, "nulls"), (3, "domain"), (3, "shift")}
    half = [profile.histogram(df.filter(F.col("load_id") % 2 == k), "t", {"v": F.col("v").between(1, 150)}) for k in (0, 1)]
    assert rows(profile.merge(*half)) == rows(hist)
    empty = profile.histogram(df.limit(0), "t", {"v": None})
    assert profile.profile(empty).count() == 0 and profile.findings(empty).count() == 0
