"""From blocks and buildings to the canonical tables: axes, features, slots, nodes, edges.

A block's axis is the diagonal of its smallest rectangle. All geometry of a building is a leaf
computed from its own row; order and numbering are windows per block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.functions import planar
from blockloom.operators import graph, nearby, ordered
from blockloom.session import spread_out

AXIS = "block_id string, ax double, ay double, bx double, by double, length double, width double"
FEATURES = "block_id string, building_id string, posx double, posy double, size_x double, size_y double, phi_resid double, aspect_ratio double, s_i int, a_i double"


def block_axes(blocks: DataFrame) -> DataFrame:
    """AXIS rows of blocks (block_id, geometry) with a readable polygon."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, w in zip(pdf["block_id"], pdf["geometry"]):
                c = planar.least_rectangle(planar.largest(planar.read_wkt(w))[0])
                rows.append((i, *c[0], *c[2], float(np.hypot(*(c[2] - c[0]))), planar.rectangle_axes(c)[1]))
            yield pd.DataFrame(rows, columns=["block_id", "ax", "ay", "bx", "by", "length", "width"])

    return spread_out(nearby.with_box(blocks.select("block_id", "geometry")).select("block_id", "geometry")).mapInPandas(run, AXIS)


def features(row: tuple) -> tuple:
    """posx .. a_i of one building: place along and across the axis, size, turn, shape."""
    wkt, a, b, length, width = row
    part = planar.largest(planar.read_wkt(wkt))
    axis, reach = planar.unit(b - a), max(length, 1e-6)
    to = planar.centroid(part) - a
    s = min(1.0, max(0.0, float(to @ axis) / reach))
    off = to - s * reach * axis
    side = 1.0 if axis[0] * off[1] - axis[1] * off[0] >= 0 else -1.0
    across = max(width, 1e-9)
    long, short, u, v = planar.rectangle_axes(planar.least_rectangle(part[0]))
    if abs(planar.unit(v) @ axis) > abs(planar.unit(u) @ axis):
        long, short, u = short, long, v
    u = planar.unit(u)
    turn = float(np.arccos(np.clip(u @ axis, -1, 1)))
    phi = min(turn, np.pi - turn) * (-1.0 if u[0] * axis[1] - u[1] * axis[0] < 0 else 1.0)
    return 2 * s - 1, side * 2 * float(np.hypot(*off)) / across, 2 * long / reach, 2 * short / across, phi, width / reach, planar.shape_class(part), planar.fill_share(part)


def building_features(buildings: DataFrame, axes: DataFrame) -> DataFrame:
    """FEATURES rows of buildings (block_id, building_id, geometry) in blocks with an axis."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [
                (r.block_id, r.building_id, *features((r.geometry, np.array([r.ax, r.ay]), np.array([r.bx, r.by]), r.length, r.width))) for r in pdf.itertuples()
            ]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FEATURES.split(", ")])

    rows = nearby.with_box(buildings.select("block_id", "building_id", "geometry")).select("block_id", "building_id", "geometry")
    return spread_out(rows.join(axes, "block_id")).mapInPandas(run, FEATURES)


def nodes(found: DataFrame, slots: int) -> DataFrame:
    """Slots from 0 along the axis; blocks with more buildings than slots keep an even subsample."""
    chosen = ordered.even_subsample(found, ["block_id"], ["posx", "building_id"], slots)
    rows = ordered.number_slots(chosen, ["posx", "building_id"], slots)
    return rows.withColumns({"e_i": F.lit(1), "branch_local_id": F.lit(0)})


def padded(active: DataFrame, blocks: DataFrame, slots: int) -> DataFrame:
    zero = {c: F.lit(0.0) for c in ("posx", "posy", "size_x", "size_y", "phi_resid", "aspect_ratio", "a_i")}
    return ordered.pad_slots(active, blocks, slots, {"e_i": F.lit(0), "branch_local_id": F.lit(-1), **zero, "s_i": F.lit(0), "building_id": F.lit(None)})


def edges(active: DataFrame, k: int) -> DataFrame:
    """Chain edges along the axis and the missing pairs of the k nearest slots."""
    chain = ordered.chain_edges(active)
    near = graph.knn(active, ["block_id"], "slot_id", ["posx", "posy"], k)  # a block has at most its slots
    return chain.unionByName(graph.enrich_edges(chain, near))
