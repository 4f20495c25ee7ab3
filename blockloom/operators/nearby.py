"""Points near points and regions around points, by a sweep over range-partitioned strips.

The plane is cut into horizontal strips, and each strip into tiles; a point is copied into
the strips and tiles within the radius above and beside it, a region into those its box
meets. Strips are range-partitioned and sorted by x, and every task sweeps its cells with an
active set of what lies within the radius behind the sweep line, so its memory holds the
active set and one Arrow batch. A pair belongs to the cell of its larger y and larger x,
which both points reach, so it is found once without a distinct. Equal locations are swept
once and expanded by a join, so a crowd on one spot doesn't load one task.

Defined results: null, empty and unreadable geometries have no location and no region; NaN
or infinite coordinates count as unreadable; a point on a region's edge is inside for left
and lower edges (half-open rule); repeated rows count once; empty tables give empty results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockloom.session import shuffle_partitions

STRIP, TILE = 4, 64  # strip height and tile width for points near points, in radii
REGION_STRIP, REGION_TILE = 256.0, 4096.0  # the same for regions, in units of the plane
PAIRS = 1 << 20  # candidate pairs verified at once


def coordinates(wkt: Column) -> Column:
    """ARRAY<STRUCT<x, y>> of all vertices of a WKT text, or null."""
    body = F.regexp_replace(F.regexp_extract(wkt, r"(?s)\((.*)\)", 1), r"[()]", " ")
    pair = lambda p: F.split(F.trim(p), r"\s+")
    number = lambda p, k: F.get(pair(p), F.lit(k)).try_cast("double")
    points = F.transform(F.split(body, ","), lambda p: F.struct(number(p, 0).alias("x"), number(p, 1).alias("y")))
    return F.when(F.length(F.trim(body)) > 0, points)


def with_box(df: DataFrame, geometry: str = "geometry") -> DataFrame:
    """Adds xmin, ymin, xmax, ymax; drops rows without a readable geometry."""
    def box(c: Column) -> Column:
        ends = [(f"{v}{e}", f(c[v])) for v in "xy" for e, f in (("min", F.array_min), ("max", F.array_max))]
        return F.struct(*[e.alias(n) for n, e in ends], F.exists(c, lambda p: p["x"].isNull() | p["y"].isNull()).alias("bad"))

    # a lambda and a generator: the text is parsed once, and no filter is pushed below and parses it again
    out = df.withColumn("__b", F.explode(F.transform(F.array(coordinates(F.col(geometry))), box)))
    sides = ["xmin", "xmax", "ymin", "ymax"]
    out = out.select(*df.columns, *[F.col(f"__b.{c}").alias(c) for c in sides], F.col("__b.bad").alias("__bad"))
    low, high = F.lit(-1e15), F.lit(1e15)  # NaN and infinity are above
    for c in sides:
        out = out.filter(F.col(c).between(low, high))
    return out.filter("not __bad").drop("__bad")


def locations(df: DataFrame, key: str, geometry: str = "geometry") -> DataFrame:
    """(id, x, y): the distinct centres of the bounding boxes."""
    boxes = with_box(df.select(F.col(key).alias("id"), F.col(geometry).alias("geometry")).filter("id is not null"))
    return boxes.select("id", ((F.col("xmin") + F.col("xmax")) / 2 + 0.0).alias("x"), ((F.col("ymin") + F.col("ymax")) / 2 + 0.0).alias("y")).distinct()


def cells(df: DataFrame, x: tuple[Column, Column], y: tuple[Column, Column], width: float, height: float) -> DataFrame:
    """A copy of each row per (strip, tile) that its x and y range meets."""
    steps = lambda r, size: F.sequence(F.floor(r[0] / size), F.floor(r[1] / size))
    return df.withColumn("strip", F.explode(steps(y, height))).withColumn("tile", F.explode(steps(x, width)))


def swept(df: DataFrame, order: list[str]) -> DataFrame:
    n = shuffle_partitions(df.sparkSession)  # a given number isn't coalesced by bytes, which don't tell the work
    return df.repartitionByRange(n, "strip", "tile").sortWithinPartitions("strip", "tile", *order)


def _cuts(strip: np.ndarray, tile: np.ndarray) -> list[int]:
    change = np.flatnonzero((strip[1:] != strip[:-1]) | (tile[1:] != tile[:-1])) + 1
    return [0, *change.tolist(), len(strip)]


def pair_sweep(radius: float, width: float, height: float):
    """Pairs of points at most ``radius`` apart, from rows sorted by (strip, tile, x)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, ax, ay = None, np.empty(0), np.empty(0)
        for pdf in batches:
            if pdf.empty:
                continue
            strip, tile, x, y = (pdf[c].to_numpy() for c in ("strip", "tile", "x", "y"))
            cuts = _cuts(strip, tile)
            for a, b in zip(cuts, cuts[1:]):
                now = (int(strip[a]), int(tile[a]))
                if now != cell:
                    cell, ax, ay = now, np.empty(0), np.empty(0)
                xs, ys, old = np.concatenate([ax, x[a:b]]), np.concatenate([ay, y[a:b]]), len(ax)
                right = np.arange(old, len(xs))
                low = np.searchsorted(xs, xs[right] - radius, side="left")
                counts = right - low
                ends = np.cumsum(counts)
                start = 0
                while start < len(right):
                    base = ends[start - 1] if start else 0
                    stop = max(start + 1, int(np.searchsorted(ends, base + PAIRS, side="right")))
                    c = counts[start:stop]
                    j = np.repeat(right[start:stop], c)
                    i = np.arange(len(j)) - np.repeat(np.cumsum(c) - c, c) + np.repeat(low[start:stop], c)
                    dx, dy = xs[j] - xs[i], ys[j] - ys[i]
                    keep = np.flatnonzero(dx * dx + dy * dy <= radius * radius)
                    i, j = i[keep], j[keep]
                    mine = (np.floor(np.maximum(ys[i], ys[j]) / height) == now[0]) & (np.floor(xs[j] / width) == now[1])
                    i, j = i[mine], j[mine]
                    if len(i):
                        yield pd.DataFrame({"ax": xs[i], "ay": ys[i], "bx": xs[j], "by": ys[j]})
                    start = stop
                live = xs >= xs[-1] - radius
                ax, ay = xs[live], ys[live]

    return run


def close_pairs(points: DataFrame, radius: float) -> DataFrame:
    """(left_id, right_id) of different ids at most ``radius`` apart, smaller id first. points: (id, x, y), distinct."""
    width, height = TILE * radius, STRIP * radius
    spots = points.select("x", "y").distinct()
    x, y = F.col("x"), F.col("y")
    spread = swept(cells(spots, (x, x + radius), (y, y + radius), width, height).select("strip", "tile", "x", "y"), ["x"])
    pairs = spread.mapInPandas(pair_sweep(radius, width, height), "ax double, ay double, bx double, by double")
    one, two = (points.select(F.col("id").alias(f"i{k}"), F.col("x").alias(f"{k}x"), F.col("y").alias(f"{k}y")) for k in "ab")
    apart = pairs.join(one, ["ax", "ay"]).join(two, ["bx", "by"]).filter("ia <> ib")
    same = one.join(two, (F.col("ax") == F.col("bx")) & (F.col("ay") == F.col("by")) & (F.col("ia") < F.col("ib")))
    found = apart.select(F.least("ia", "ib").alias("left_id"), F.greatest("ia", "ib").alias("right_id")).unionByName(
        same.select(F.col("ia").alias("left_id"), F.col("ib").alias("right_id"))
    )
    return found.distinct()  # an id may have several locations


RING = re.compile(r"\(([^()]+)\)")


def edges(wkt: str) -> np.ndarray:
    """(n, 4) array of the edges x1, y1, x2, y2 of all rings of a polygon or multipolygon text."""
    out = []
    for ring in RING.findall(wkt):
        xy = np.array([[float(v) for v in p.split()[:2]] for p in ring.split(",")])
        if len(xy) > 1:
            if (xy[0] != xy[-1]).any():
                xy = np.vstack([xy, xy[:1]])
            out.append(np.hstack([xy[:-1], xy[1:]]))
    return np.vstack(out) if out else np.empty((0, 4))


def inside(e: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Even-odd rule over all rings, so holes are outside."""
    out = np.zeros(len(x), bool)
    for at in range(0, len(x), 4096):
        px, py = x[at : at + 4096, None], y[at : at + 4096, None]
        x1, y1, x2, y2 = e.T
        across = (y1 > py) != (y2 > py)
        with np.errstate(divide="ignore", invalid="ignore"):
            out[at : at + 4096] = (np.sum(across & (px < (x2 - x1) * (py - y1) / (y2 - y1) + x1), axis=1) % 2).astype(bool)
    return out


def region_sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(x, y, region) of points inside regions, from rows sorted by (strip, tile, x, is_point)."""
    cell, active = None, []
    for pdf in batches:
        if pdf.empty:
            continue
        strip, tile, x, point = (pdf[c].to_numpy() for c in ("strip", "tile", "x", "is_point"))
        cuts = _cuts(strip, tile)
        for a, b in zip(cuts, cuts[1:]):
            now = (int(strip[a]), int(tile[a]))
            if now != cell:
                cell, active = now, []
            part = pdf.iloc[a:b]
            regions = part[~point[a:b].astype(bool)]
            active += [(r.region, r.x, r.xmax, r.ymin, r.ymax, edges(r.geometry)) for r in regions.itertuples()]
            points = part[point[a:b].astype(bool)]
            px, py = points["x"].to_numpy(), points["ymin"].to_numpy()
            for region, x0, x1, y0, y1, e in active if len(px) else ():
                lo, hi = np.searchsorted(px, x0, "left"), np.searchsorted(px, x1, "right")
                near = lo + np.flatnonzero((py[lo:hi] >= y0) & (py[lo:hi] <= y1))
                if len(near):
                    got = near[inside(e, px[near], py[near])]
                    if len(got):
                        yield pd.DataFrame({"x": px[got], "y": py[got], "region": region})
            last = x[b - 1]
            active = [r for r in active if r[2] >= last]


def regions_of(points: DataFrame, regions: DataFrame, key: str, geometry: str = "geometry") -> DataFrame:
    """(points' columns, region) for each point inside a region; a point may have several or none. points: (..., x, y)."""
    shapes = with_box(regions.select(F.col(key).alias("region"), F.col(geometry).alias("geometry")).filter("region is not null").distinct())
    shape_rows = cells(shapes, (F.col("xmin"), F.col("xmax")), (F.col("ymin"), F.col("ymax")), REGION_TILE, REGION_STRIP).select(
        "strip", "tile", F.col("xmin").alias("x"), F.lit(False).alias("is_point"), "xmax", "ymin", "ymax", "region", "geometry"
    )
    x, y = F.col("x"), F.col("y")
    point_rows = points.select("x", "y").distinct().select(
        F.floor(y / REGION_STRIP).alias("strip"), F.floor(x / REGION_TILE).alias("tile"), "x", F.lit(True).alias("is_point"),
        x.alias("xmax"), y.alias("ymin"), y.alias("ymax"), F.lit(None).cast("string").alias("region"), F.lit(None).cast("string").alias("geometry"),
    )
    order = ["x", "is_point"]
    found = swept(shape_rows.unionByName(point_rows), order).mapInPandas(region_sweep, "x double, y double, region string").distinct()
    return points.join(found, ["x", "y"])
