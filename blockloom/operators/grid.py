"""Regular grids (group, row_i, col_j): cells of blocks, neighbours, closing, levels, layout candidates."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockloom.functions import planar
from blockloom.operators import graph, ordered
from blockloom.operators.nearby import with_box
from blockloom.session import spread_out

AROUND = [(r, c) for r in (-1, 0, 1) for c in (-1, 0, 1) if (r, c) != (0, 0)]


def clipped_cells(blocks: DataFrame, cell: float) -> DataFrame:
    """(block_id, gi, gj, area): cells at multiples of the size, clipped to the block; gi and gj count from the origin."""
    boxes = with_box(blocks.select("block_id", "geometry"))
    at = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / cell), F.ceil(F.col(b) / cell) - 1))
    rows = boxes.filter("xmax > xmin and ymax > ymin").select("block_id", "geometry", "xmin", "xmax", at("ymin", "ymax").alias("gi")).select("*", at("xmin", "xmax").alias("gj"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts: dict[str, list] = {}
            sizes = []
            for w, i, j in zip(pdf["geometry"], pdf["gi"], pdf["gj"]):
                if w not in parts:
                    parts[w] = planar.read_wkt(w)
                x, y = j * cell, i * cell
                square = np.array([[x, y], [x + cell, y], [x + cell, y + cell], [x, y + cell]])
                sizes.append(sum(planar.overlap(p, square) for p in parts[w]))
            out = pdf[["block_id", "gi", "gj"]].assign(area=np.array(sizes, float))
            yield out[out["area"] > 1e-6]

    return spread_out(rows.select("block_id", "geometry", "gi", "gj")).mapInPandas(run, "block_id string, gi long, gj long, area double")


def cells_of_blocks(blocks: DataFrame, cell: float) -> DataFrame:
    """(block_id, cell_id, row_i, col_j, area): cells at multiples of the size, clipped to the block, numbered row by row."""
    kept = clipped_cells(blocks, cell)
    block = Window.partitionBy("block_id")
    return kept.select(
        "block_id", (F.row_number().over(block.orderBy("gi", "gj")) - 1).alias("cell_id"), (F.col("gi") - F.min("gi").over(block)).alias("row_i"), (F.col("gj") - F.min("gj").over(block)).alias("col_j"), "area"
    )


def neighbours(cells: DataFrame, group: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """(group, row_i, col_j, side, n_<keep>...): one row per cell and existing neighbour, by an equi-join on eight offsets."""
    around = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in AROUND]))
    ask = cells.select(*group, "row_i", "col_j", around.alias("o")).select(
        *group, F.col("row_i").alias("r0"), F.col("col_j").alias("c0"), (F.col("row_i") + F.col("o.r")).alias("row_i"), (F.col("col_j") + F.col("o.c")).alias("col_j"), (F.col("o.r") * F.col("o.c") == 0).alias("side")
    )
    there = cells.select(*group, "row_i", "col_j", *[F.col(k).alias(f"n_{k}") for k in keep])
    return ask.join(there, [*group, "row_i", "col_j"]).select(
        *group, F.col("r0").alias("row_i"), F.col("c0").alias("col_j"), F.col("row_i").alias("n_row"), F.col("col_j").alias("n_col"), "side", *[f"n_{k}" for k in keep]
    )


def neighbour_counts(cells: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group, row_i, col_j, inside, degree, missing, empty, side_inside). cells: (group, row_i, col_j, inside)."""
    near = neighbours(cells, group, ["inside"]).groupBy(*group, "row_i", "col_j").agg(
        F.count(F.lit(1)).alias("degree"), F.count_if(~F.col("n_inside")).alias("empty"), F.count_if(F.col("side") & F.col("n_inside")).alias("side_inside")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    rows = cells.select(*group, "row_i", "col_j", "inside").join(near, [*group, "row_i", "col_j"], "left")
    return rows.select(*group, "row_i", "col_j", "inside", zero("degree"), F.greatest(F.lit(0), 8 - F.coalesce("degree", F.lit(0))).alias("missing"), zero("empty"), zero("side_inside"))


def close_three_sides(cells: DataFrame, group: Sequence[str]) -> DataFrame:
    """Adds closed: inside, or at least three side neighbours inside; one pass on the raw flags."""
    return neighbour_counts(cells, group).withColumn("closed", F.col("inside") | (F.col("side_inside") >= 3))


def neighbour_level(cells: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group, row_i, col_j, level): a cell's own level, else the commonest of its side neighbours, the smaller at a tie."""
    near = neighbours(cells, group, ["level"]).filter("side and n_level is not null").groupBy(*group, "row_i", "col_j").agg(F.mode(F.col("n_level").cast("int"), True).alias("m"))
    return cells.join(near, [*group, "row_i", "col_j"], "left").select(*group, "row_i", "col_j", F.coalesce(F.col("level").cast("int"), "m").alias("level"))


def runs_both_ways(cells: DataFrame, group: Sequence[str], column: str, most: int) -> DataFrame:
    """The flag after bounded runs along rows, then along columns."""
    for line, at in ((["row_i"], "col_j"), (["col_j"], "row_i")):
        kept = ordered.run_mask(cells.filter(F.col(column)), [*group, *line], at, most).filter("keep").select(*group, "row_i", "col_j", F.lit(True).alias("__k"))
        cells = cells.join(kept, [*group, "row_i", "col_j"], "left").withColumn(column, F.col("__k").isNotNull()).drop("__k")
    return cells


def building_cells(cells: DataFrame, group: Sequence[str], most: int = 8, empty: int = 3) -> DataFrame:
    """Cells to build on: outer cells in bounded runs, with the best inner neighbour of each small outer cell promoted.

    cells: (group, row_i, col_j, inside, small). Adds is_building.
    """
    key = [*group, "row_i", "col_j"]
    counted = neighbour_counts(cells, group).join(cells.select(*key, "small"), key)
    outer = F.col("inside") & ((F.col("empty") >= empty) | (F.col("missing") > 0))
    first = runs_both_ways(counted.withColumn("outer", outer).withColumn("is_building", F.col("outer")), group, "is_building", most).withColumn("score", F.col("empty") + F.col("missing"))
    near = neighbours(first, group, ["inside", "is_building", "score", "empty"])
    small = first.filter("is_building and outer and small").select(*key)
    choice = near.join(small, key, "left_semi").filter("n_inside")
    side_first = Window.partitionBy(*key)
    choice = choice.withColumn("any_side", F.max(F.col("side").cast("int")).over(side_first)).filter("side or any_side = 0").filter("not n_is_building")
    best = choice.groupBy(*key).agg(F.min(F.struct("n_score", (-F.col("n_empty")).alias("e"), "n_row", "n_col")).alias("b"))
    promoted = best.select(*group, F.col("b.n_row").alias("row_i"), F.col("b.n_col").alias("col_j"), F.lit(True).alias("__p")).distinct()
    again = first.join(promoted, key, "left").withColumn("is_building", F.col("is_building") | F.col("__p").isNotNull()).drop("__p")
    return runs_both_ways(again, group, "is_building", most).select(*key, "inside", "is_building")


def diagonal_groups(cells: DataFrame, group: Sequence[str]) -> DataFrame:
    """(cell, component) of built cells that touch others only at corners, in components of at least two."""
    built = cells.filter("is_building")
    near = neighbours(built, group, [])
    key = [*group, "row_i", "col_j"]
    lonely = near.groupBy(*key).agg(F.bool_or("side").alias("s")).filter("not s").select(*key)
    name = lambda r, c: F.concat_ws(":", *group, F.lpad(F.col(r).cast("string"), 6, "0"), F.lpad(F.col(c).cast("string"), 6, "0"))
    other = lonely.withColumnsRenamed({"row_i": "n_row", "col_j": "n_col"})
    pairs = near.filter("not side").join(lonely, key, "left_semi").join(other, [*group, "n_row", "n_col"], "left_semi")
    return graph.connected_components(pairs.select(name("row_i", "col_j").alias("a"), name("n_row", "n_col").alias("b"))).withColumnRenamed("node", "cell")


def merged_groups(cells: DataFrame, group: Sequence[str], label: str) -> DataFrame:
    """(component, label, n_members, n_cells, types): cells of the same label that touch, corners included.

    cells: (group, row_i, col_j, label, n_cells, type).
    """
    name = lambda r, c: F.concat_ws(":", *group, F.lpad(F.col(r).cast("string"), 6, "0"), F.lpad(F.col(c).cast("string"), 6, "0"))
    near = neighbours(cells, [*group, label], [])
    linked = graph.connected_components(near.select(name("row_i", "col_j").alias("a"), name("n_row", "n_col").alias("b")))
    rows = cells.withColumn("node", name("row_i", "col_j")).join(linked, "node", "left")
    return rows.groupBy(F.coalesce("component", "node").alias("component"), label).agg(
        F.count(F.lit(1)).alias("n_members"), F.sum("n_cells").alias("n_cells"), F.array_join(F.array_sort(F.collect_set("type")), ",").alias("types")
    )


def zone_centres(cells: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group, r_center, c_center, top): median row and column over the residential cells, else over all, and the highest level."""
    mid = lambda c: F.coalesce(F.median(F.when(F.col("residential"), F.col(c))), F.median(c))
    return cells.groupBy(*group).agg(mid("row_i").alias("r_center"), mid("col_j").alias("c_center"), F.max("level").alias("top"))


def tag_cells(cells: DataFrame, density_rows: DataFrame, at: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group, row_i, col_j, level_ids, level): the contour levels that a cell's density reaches, and the highest, or null.

    cells: (group, row_i, col_j) on the raster's indices; at: (group, level) of a dozen levels a group.
    """
    order = Window.partitionBy(*group).orderBy("level")
    numbered = at.select(*group, "level", (F.row_number().over(order) - 1).alias("k"))
    values = density_rows.filter("inside").select(*group, F.col("i").alias("row_i"), F.col("j").alias("col_j"), "v")
    reached = values.join(numbered, list(group)).filter("v >= level").groupBy(*group, "row_i", "col_j").agg(F.array_sort(F.collect_list("k")).alias("level_ids"), F.max("level").alias("level"))
    return cells.join(reached, [*group, "row_i", "col_j"], "left").select(*cells.columns, F.coalesce("level_ids", F.array().cast("array<int>")).alias("level_ids"), "level")


def cells_in_zones(cells: DataFrame, zones: DataFrame, key: str, geometry: str) -> DataFrame:
    """(id, zone): the smallest zone that holds all four corners of a cell, or null. cells: (id, x0, y0, x1, y1)."""
    from blockloom.operators.nearby import regions_of

    corners = F.explode(F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x in ("x0", "x1") for y in ("y0", "y1")]))
    held = regions_of(cells.select("id", corners.alias("c")).select("id", "c.x", "c.y").distinct(), zones, key, geometry)
    whole = held.groupBy("id", "region").agg(F.count(F.lit(1)).alias("n")).filter("n = 4").groupBy("id").agg(F.min("region").alias("zone"))
    return cells.select("id").join(whole, "id", "left")
