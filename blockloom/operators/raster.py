"""Density rasters in long form (group, i, j, v): histogram, edge-corrected smoothing, levels, contours."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUANTILES = (0.60, 0.75, 0.85, 0.92, 0.97)


def unit_weights(df: DataFrame, weight: str, group: Sequence[str] = ()) -> DataFrame:
    """The weight scaled to 1..2 between its least and largest value; a constant weight is clipped to 0..1, plus 1."""
    w = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    low, high, v = F.min(weight).over(w), F.max(weight).over(w), F.col(weight)
    scaled = F.when(high > low, (v - low) / (high - low)).otherwise(v)
    return df.withColumn(weight, 1 + F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled)))


def lattice(df: DataFrame, n: int) -> DataFrame:
    """An n x n raster per row of df."""
    steps = lambda: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    return df.withColumn("i", steps()).withColumn("j", steps())


def histogram(points: DataFrame, group: Sequence[str], x: Column, y: Column, weight: Column, n: int) -> DataFrame:
    """(group, i, j, v): summed weights; x and y are fractions of the extent, the last bin is closed."""
    at = lambda v: F.least(F.floor(v * n), F.lit(n - 1)).cast("int")
    return points.filter(x.between(0, 1) & y.between(0, 1)).groupBy(*group, at(y).alias("i"), at(x).alias("j")).agg(F.sum(weight).alias("v"))


def kernel(sigma: float) -> list[float]:
    r = int(4 * sigma + 0.5)
    w = [math.exp(-k * k / (2 * sigma * sigma)) for k in range(-r, r + 1)]
    return [x / sum(w) for x in w]


def smooth(raster: DataFrame, group: Sequence[str], columns: Sequence[str], n: int, sigma: float) -> DataFrame:
    """Separable Gaussian of a full n x n raster; beyond the border the nearest cell counts.

    Each pass is a windowed join on clamped offsets written as an explode and a sum, so cells shuffle once per pass.
    """
    w = kernel(sigma)
    r = len(w) // 2
    offsets = F.array(*[F.struct(F.lit(k).alias("o"), F.lit(x).alias("w")) for k, x in zip(range(-r, r + 1), w)])
    for axis, other in (("i", "j"), ("j", "i")):
        # a border cell stands for every place beyond it: it reaches those cells once per clamped offset
        reach = F.explode(F.filter(F.flatten(F.transform(offsets, lambda p: F.when(
            (F.col(axis) > 0) & (F.col(axis) < n - 1), F.array(F.struct((F.col(axis) - p["o"]).alias("t"), p["w"].alias("w")))
        ).otherwise(F.filter(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda t: F.struct(t.alias("t"), p["w"].alias("w"))), lambda s: F.greatest(F.lit(0), F.least(F.lit(n - 1), s["t"] + p["o"])) == F.col(axis))))), lambda s: (s["t"] >= 0) & (s["t"] < n)))
        raster = raster.select(*group, other, *columns, reach.alias("p")).groupBy(*group, F.col("p.t").cast("int").alias(axis), other).agg(
            *[F.sum(F.col(c) * F.col("p.w")).alias(c) for c in columns]
        )
    return raster


def density(raster: DataFrame, group: Sequence[str], n: int, sigma: float, cell: float) -> DataFrame:
    """(group, i, j, inside, v): smoothed sums over smoothed mask per area; raster has v and mask for every cell."""
    soft = smooth(raster.select(*group, "i", "j", "v", F.col("mask").cast("double").alias("m")), group, ["v", "m"], n, sigma)
    rows = soft.join(raster.select(*group, "i", "j", "mask"), [*group, "i", "j"])
    return rows.select(*group, "i", "j", (F.col("mask") > 0).alias("inside"), (F.col("v") / F.greatest("m", F.lit(1e-9)) / (cell * cell)).alias("v"))


def levels(rows: DataFrame, group: Sequence[str], quantiles: Sequence[float] = QUANTILES) -> DataFrame:
    """(group, level): quantiles of the positive densities inside, strictly between the least and the largest, once each."""
    inside = rows.filter("inside and v > 0")
    q = inside.groupBy(*group).agg(F.percentile("v", F.array(*[F.lit(x) for x in quantiles])).alias("q"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    fit = F.filter(F.array_distinct(F.transform("q", lambda x: F.round(x, 12))), lambda x: (x > F.col("lo")) & (x < F.col("hi")))
    even = F.transform(F.sequence(F.lit(1), F.lit(5)), lambda k: F.round(F.col("lo") + (F.col("hi") - F.col("lo")) * k / 6, 12))
    return q.filter("hi > lo").select(*group, F.explode(F.when(F.size(fit) > 0, fit).otherwise(even)).alias("level"))


def contour_segments(rows: DataFrame, group: Sequence[str], at: DataFrame) -> DataFrame:
    """(group, level, i, j, x1, y1, x2, y2) in raster indices: marching squares, crossings by linear interpolation.

    A square with four crossings is cut according to the mean of its corners.
    """
    v = rows.select(*group, "i", "j", "v")
    corner = lambda name, di, dj: v.select(*group, (F.col("i") - di).alias("i"), (F.col("j") - dj).alias("j"), F.col("v").alias(name))
    key = [*group, "i", "j"]
    squares = v.withColumnRenamed("v", "a").join(corner("b", 0, 1), key).join(corner("c", 1, 1), key).join(corner("d", 1, 0), key)
    lines = squares.join(F.broadcast(at), list(group)) if group else squares.crossJoin(F.broadcast(at))  # a dozen levels a group at most
    lv = F.col("level")
    high = lambda n: F.col(n) >= lv
    part = lambda p, q: (lv - F.col(p)) / (F.col(q) - F.col(p))
    i, j = F.col("i").cast("double"), F.col("j").cast("double")
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    ab, bc, cd, da = point(j + part("a", "b"), i), point(j + 1, i + part("b", "c")), point(j + part("d", "c"), i + 1), point(j, i + part("a", "d"))
    cross = F.filter(F.array(
        F.when(high("a") != high("b"), ab), F.when(high("b") != high("c"), bc), F.when(high("c") != high("d"), cd), F.when(high("d") != high("a"), da)
    ), lambda p: p.isNotNull())
    pair = lambda s, p, q: F.struct(s[p].alias("p"), s[q].alias("q"))
    full = (F.col("a") + F.col("b") + F.col("c") + F.col("d")) / 4 >= lv
    # corner a high and the middle high: a and c are joined, so b and d are cut off
    saddle = F.when(full == high("a"), F.array(pair(F.col("x"), 0, 1), pair(F.col("x"), 2, 3))).otherwise(F.array(pair(F.col("x"), 0, 3), pair(F.col("x"), 1, 2)))
    out = lines.withColumn("x", cross).filter(F.size("x") >= 2).withColumn("s", F.explode(F.when(F.size("x") == 2, F.array(pair(F.col("x"), 0, 1))).otherwise(saddle)))
    return out.select(*group, "level", "i", "j", F.col("s.p.x").alias("x1"), F.col("s.p.y").alias("y1"), F.col("s.q.x").alias("x2"), F.col("s.q.y").alias("y2"))


def contour_lines(segments: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group, level, line, closed, n_points, length): segments chained at common ends. A group's segments are at most a raster's."""
    keys = [*group, "level"]
    kinds = dict(segments.dtypes)

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        ends: dict[tuple, list[int]] = {}
        rows = [((round(r.x1, 7), round(r.y1, 7)), (round(r.x2, 7), round(r.y2, 7))) for r in pdf.sort_values(["i", "j", "x1", "y1"]).itertuples()]
        rows = [r for r in rows if r[0] != r[1]]  # a level that meets a corner leaves segments without length
        for k, (p, q) in enumerate(rows):
            ends.setdefault(p, []).append(k)
            ends.setdefault(q, []).append(k)
        used, out = set(), []
        starts = [k for k, (p, q) in enumerate(rows) if len(ends[p]) == 1 or len(ends[q]) == 1] + list(range(len(rows)))
        for k in starts:
            if k in used:
                continue
            p, q = rows[k]
            if len(ends[q]) == 1 and len(ends[p]) > 1:
                p, q = q, p
            used.add(k)
            line = [p, q]
            while True:
                more = [m for m in ends[line[-1]] if m not in used]
                if not more:
                    break
                used.add(more[0])
                a, b = rows[more[0]]
                line.append(b if a == line[-1] else a)
            size = sum(math.dist(a, b) for a, b in zip(line, line[1:]))
            out.append([pdf[c].iloc[0] for c in keys] + [len(out), line[0] == line[-1], len(line), size])
        return pd.DataFrame(out, columns=[*keys, "line", "closed", "n_points", "length"])

    schema = ", ".join(f"{c} {kinds[c]}" for c in keys) + ", line int, closed boolean, n_points int, length double"
    return segments.groupBy(*keys).applyInPandas(chain, schema)


def block_mask(blocks: DataFrame, n: int) -> DataFrame:
    """(block_id, mask ARRAY<INT>): n x n cells of the bounding box, row by row from the top, 1 where the centre is inside."""
    import numpy as np

    from blockloom.operators.nearby import edges, inside, with_box

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            masks = []
            for r in pdf.itertuples():
                x = r.xmin + (np.arange(n) + 0.5) / n * (r.xmax - r.xmin)
                y = r.ymax - (np.arange(n) + 0.5) / n * (r.ymax - r.ymin)
                xx, yy = np.meshgrid(x, y)
                masks.append(inside(edges(r.geometry), xx.ravel(), yy.ravel()).astype(int).tolist())
            yield pd.DataFrame({"block_id": pdf["block_id"], "mask": masks})

    return with_box(blocks.select("block_id", "geometry")).select("block_id", "geometry", "xmin", "xmax", "ymin", "ymax").mapInPandas(run, "block_id string, mask array<int>")
