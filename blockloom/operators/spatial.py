"""Spatial joins of areas: assignment, overlap, intersections, nesting, services to buildings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockloom.functions import planar
from blockloom.functions.scalars import capacity, slug
from blockloom.operators import nearby
from blockloom.session import spread_out

CELL = 256.0
EXCLUDED = ("парк",)  # service types that are no facility


def latest(df: DataFrame, key: str, at: str = "loaded_at") -> DataFrame:
    """The latest row per key; null keys are left out."""
    cells = [c for c in df.columns if c != key]
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*cells), at).alias("r")).select(key, "r.*")


def candidate_pairs(a: DataFrame, b: DataFrame, cell: float = CELL) -> DataFrame:
    """(a_id, a_wkt, b_id, b_wkt) of geometries whose boxes meet; each pair in the one cell of its larger minima."""
    def spread(df: DataFrame, p: str) -> DataFrame:
        boxes = nearby.with_box(df.select(F.col("id").alias(f"{p}_id"), F.col("wkt").alias(f"{p}_wkt")), f"{p}_wkt").withColumnsRenamed({c: f"{p}_{c}" for c in ("xmin", "xmax", "ymin", "ymax")})
        return nearby.cells(boxes, (F.col(f"{p}_xmin"), F.col(f"{p}_xmax")), (F.col(f"{p}_ymin"), F.col(f"{p}_ymax")), cell, cell)

    pairs = spread_out(spread(a, "a"), "strip", "tile").join(spread_out(spread(b, "b"), "strip", "tile"), ["strip", "tile"])
    meet = (F.col("a_xmin") <= F.col("b_xmax")) & (F.col("b_xmin") <= F.col("a_xmax")) & (F.col("a_ymin") <= F.col("b_ymax")) & (F.col("b_ymin") <= F.col("a_ymax"))
    own = (F.floor(F.greatest("a_xmin", "b_xmin") / cell) == F.col("tile")) & (F.floor(F.greatest("a_ymin", "b_ymin") / cell) == F.col("strip"))
    return pairs.filter(meet & own).select("a_id", "a_wkt", "b_id", "b_wkt")


def intersecting(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a_id, b_id) of geometries (id, wkt) that touch or overlap; points count as themselves."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            known: dict[str, np.ndarray] = {}

            def of(w: str) -> np.ndarray:
                if w not in known:
                    e = nearby.edges(w)
                    if not len(e):  # a point: a side without length
                        x, y = (float(v) for v in nearby.RING.search(w)[1].split()[:2])
                        e = np.array([[x, y, x, y]])
                    known[w] = e
                return known[w]

            yield pdf[[planar.meet(of(x), of(y)) for x, y in zip(pdf["a_wkt"], pdf["b_wkt"])]][["a_id", "b_id"]]

    return candidate_pairs(a, b).mapInPandas(run, "a_id string, b_id string").distinct()


def overlaps(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a_id, b_id, area): overlap of the convex a with any b, where it is more than nothing."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sizes = [sum(planar.overlap(p, planar.largest(planar.read_wkt(x))[0]) for p in planar.read_wkt(y)) for x, y in zip(pdf["a_wkt"], pdf["b_wkt"])]
            out = pdf[["a_id", "b_id"]].assign(area=np.array(sizes, float))
            yield out[out["area"] > 0]

    return candidate_pairs(a, b).mapInPandas(run, "a_id string, b_id string, area double")


def assign_areas(features: DataFrame, areas: DataFrame) -> DataFrame:
    """(id, area_id, step): the smallest area id that holds the centre, else the largest overlap, else null.

    features, areas: (id, wkt), one row per id.
    """
    centres = nearby.locations(features, "id", "wkt")
    held = nearby.regions_of(centres, areas, "id", "wkt").groupBy("id").agg(F.min("region").alias("area_id"))
    rest = features.join(held, "id", "left_anti")
    best = overlaps(rest, areas).groupBy(F.col("a_id").alias("id")).agg(F.min(F.struct((-F.col("area")).alias("area"), F.col("b_id").alias("area_id")))["area_id"].alias("area_id"))
    every = held.select("id", "area_id", F.lit("centre").alias("step")).unionByName(best.select("id", "area_id", F.lit("overlap").alias("step")))
    return features.select("id").join(every, "id", "left")


def nesting(areas: DataFrame, points: DataFrame) -> DataFrame:
    """(id, level): how many other areas hold an area's inner point. points: (id, x, y) of the areas (id, wkt)."""
    held = nearby.regions_of(points, areas, "id", "wkt").groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return points.select("id").join(held, "id", "left").select("id", F.greatest(F.coalesce("n", F.lit(0)) - 1, F.lit(0)).alias("level"))


def inner_points(areas: DataFrame) -> DataFrame:
    """(id, x, y): a point inside the largest part of each area."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            xy = np.array([planar.inner_point(planar.largest(planar.read_wkt(w))) for w in pdf["wkt"]]).reshape(-1, 2)
            yield pd.DataFrame({"id": pdf["id"], "x": xy[:, 0], "y": xy[:, 1]})

    return spread_out(nearby.with_box(areas, "wkt").select("id", "wkt")).mapInPandas(run, "id string, x double, y double")


def rectangles(areas: DataFrame) -> DataFrame:
    """(id, long, short, fill, inner_corners, shape): smallest rectangle and shape class of the largest part."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, w in zip(pdf["id"], pdf["wkt"]):
                part = planar.largest(planar.read_wkt(w))
                a, b, _, _ = planar.rectangle_axes(planar.least_rectangle(part[0]))
                rows.append((i, a, b, planar.fill_share(part), planar.reflex(part[0]), planar.shape_class(part)))
            yield pd.DataFrame(rows, columns=["id", "long", "short", "fill", "inner_corners", "shape"])

    return spread_out(nearby.with_box(areas, "wkt").select("id", "wkt")).mapInPandas(run, "id string, long double, short double, fill double, inner_corners int, shape int")


def attach_services(buildings: DataFrame, services: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((building_id, service, has, capacity), (id, service, capacity, wkt)): services by building, and rows for area services without one.

    Every building that a service meets gets its full capacity. Point services without a building are dropped.
    buildings: (id, wkt); services: (service_id, service_type_name, capacity, capacity_modeled, weight_value, geometry).
    """
    name = F.trim("service_type_name")
    rows = services.filter(F.col("service_type_name").isNotNull() & (name != "") & ~F.lower(name).isin(*EXCLUDED)).select(
        F.col("service_id").alias("a_id"), slug(name).alias("service"), capacity(F.col("capacity"), F.col("capacity_modeled"), F.col("weight_value")).alias("capacity"), F.col("geometry").alias("wkt")
    )
    hits = intersecting(rows.select(F.col("a_id").alias("id"), "wkt"), buildings)
    on = hits.join(rows, "a_id").groupBy(F.col("b_id").alias("building_id"), "service").agg(F.lit(True).alias("has"), F.sum("capacity").alias("capacity"))
    free = nearby.with_box(rows, "wkt").join(hits, "a_id", "left_anti").filter(F.upper("wkt").contains("POLYGON"))
    return on, free.select(F.concat(F.lit("s:"), "a_id").alias("id"), "service", "capacity", "wkt")


def services_wide(long: DataFrame, names: list[str]) -> DataFrame:
    """has_service__<name> and service_capacity__<name> columns per building."""
    wide = long.filter(F.col("service").isin(*names)).groupBy("building_id").pivot("service", names).agg(F.first("has").alias("h"), F.first("capacity").alias("c"))
    return wide.select("building_id", *[x for n in names for x in (
        F.coalesce(F.col(f"`{n}_h`"), F.lit(False)).alias(f"has_service__{n}"), F.coalesce(F.col(f"`{n}_c`"), F.lit(0.0)).alias(f"service_capacity__{n}"),
    )])


def nearest_sites(sites: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, min_nn, mean_nn): nearest-neighbour distances within a group; zero distances don't count. sites: (by, id, x, y)."""
    from blockloom.operators.graph import knn_near

    spots = sites.select(*by, "x", "y").distinct().withColumn("id", F.concat_ws(",", "x", "y"))
    near = knn_near(spots, by, "id", "x", "y", 1).select(*by, F.col("src").alias("id"), F.sqrt("d2").alias("d"))
    rows = sites.withColumn("spot", F.concat_ws(",", "x", "y")).join(near.withColumnRenamed("id", "spot"), [*by, "spot"], "left")
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("min_nn"), F.avg("d").alias("mean_nn"))


def first_area(points: DataFrame, areas: DataFrame, key: str, geometry: str) -> DataFrame:
    held = nearby.regions_of(points, areas, key, geometry)
    return held.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy("region"))).filter("k = 1").drop("k")
