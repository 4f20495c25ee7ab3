"""Geometry as SQL expressions over ARRAY<STRUCT<x, y>> rings, and reprojection in closed form."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH = 6378137.0
PART = r"\(\s*(\([^()]+\)(?:\s*,\s*\([^()]+\))*)\s*\)"
RING = r"\(([^()]+)\)"


def ring_points(text: Column) -> Column:
    pair = lambda p: F.split(F.trim(p), r"\s+")
    return F.transform(F.split(text, ","), lambda p: F.struct(F.get(pair(p), F.lit(0)).try_cast("double").alias("x"), F.get(pair(p), F.lit(1)).try_cast("double").alias("y")))


def parts(wkt: Column) -> Column:
    """ARRAY<part ARRAY<ring ARRAY<STRUCT<x, y>>>> of a polygon or multipolygon text."""
    return F.transform(F.regexp_extract_all(wkt, F.lit(PART), F.lit(1)), lambda p: F.transform(F.regexp_extract_all(p, F.lit(RING), F.lit(1)), ring_points))


def sides(ring: Column) -> Column:
    """ARRAY<STRUCT<a, b>>: neighbouring corners of a closed ring, relative to its first corner."""
    first = F.get(ring, F.lit(0))
    near = F.transform(ring, lambda p: F.struct((p["x"] - first["x"]).alias("x"), (p["y"] - first["y"]).alias("y")))
    n = F.size(ring)
    return F.zip_with(F.slice(near, F.lit(1), n - 1), F.slice(near, F.lit(2), n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def total(xs: Column, f) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda s, e: s + f(e))


def cross(e: Column) -> Column:
    return e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]


def signed_area(ring: Column) -> Column:
    return total(sides(ring), cross) / 2


def part_area(part: Column) -> Column:
    """The outer ring without its holes."""
    return F.abs(signed_area(F.get(part, F.lit(0)))) * 2 - F.aggregate(part, F.lit(0.0), lambda s, r: s + F.abs(signed_area(r)))


def largest_part(geometry: Column) -> Column:
    sized = F.transform(geometry, lambda p, i: F.struct(part_area(p).alias("area"), (-i).alias("k")))
    return F.get(geometry, -F.array_max(sized)["k"])


def length(ring: Column) -> Column:
    return total(sides(ring), lambda e: F.hypot(e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]))


def reflex_corners(ring: Column) -> Column:
    """Corners that turn against the ring's own orientation."""
    s = sides(ring)
    turn = lambda e, f: (e["b"]["x"] - e["a"]["x"]) * (f["b"]["y"] - f["a"]["y"]) - (e["b"]["y"] - e["a"]["y"]) * (f["b"]["x"] - f["a"]["x"])
    following = F.concat(F.slice(s, F.lit(2), F.size(s) - 1), F.slice(s, 1, 1))
    turns = F.zip_with(s, following, turn)
    return F.size(F.filter(turns, lambda t: t * F.signum(signed_area(ring)) < 0))


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    dx, dy = bx - ax, by - ay
    n = dx * dx + dy * dy
    t = F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / n))).otherwise(0.0)
    return F.hypot(px - (ax + t * dx), py - (ay + t * dy))


def boundary_distance(part: Column, px: Column, py: Column) -> Column:
    """From a point to the nearest side of any ring."""
    def of(ring: Column) -> Column:
        first = F.get(ring, F.lit(0))
        d = lambda e: segment_distance(px - first["x"], py - first["y"], e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"])
        return F.array_min(F.transform(sides(ring), d))

    return F.array_min(F.transform(part, of))


def to_degrees(x: Column, y: Column) -> tuple[Column, Column]:
    """EPSG:3857 to EPSG:4326."""
    return x / EARTH * (180 / math.pi), (2 * F.atan(F.exp(y / EARTH)) - math.pi / 2) * (180 / math.pi)


def to_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """EPSG:4326 to EPSG:3857."""
    return lon * (math.pi / 180) * EARTH, F.log(F.tan(math.pi / 4 + lat * (math.pi / 360))) * EARTH


def oriented_rectangle(cx: Column, cy: Column, w: Column, h: Column, angle: Column) -> Column:
    """The four corners and the first again."""
    c, s = F.cos(angle), F.sin(angle)
    corner = lambda i, j: F.struct((cx + i * w / 2 * c - j * h / 2 * s).alias("x"), (cy + i * w / 2 * s + j * h / 2 * c).alias("y"))
    return F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1), corner(-1, -1))
