"""Grouped statistics of the four dataset tables (blocks, branches, nodes, edges)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockloom.functions.columns import service_columns
from blockloom.functions.scalars import flag, number, one_if, positive_weight

SHAPES = ("Rect", "L", "U", "X")
MOMENTS = ("posx", "posy", "size_x", "size_y", "phi_resid")


def active(e: str = "e_i") -> Column:
    return number(F.col(e), 0) > 0.5


def valid_floors() -> Column:
    return active() & flag(F.col("has_floors")) & (number(F.col("floors_num"), -1) >= 0)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("name"), "n") for k, df in tables.items()])


def occupancy(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("block_id").agg(F.count(F.lit(1)).alias("n_slots"), F.count_if(active()).alias("n_active")).withColumn(
        "occupancy", F.col("n_active") / F.col("n_slots")
    )


def distribution(df: DataFrame, column: str, percents: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """One row: mean, population deviation and interpolated percentiles."""
    q = F.percentile(column, F.array(*[F.lit(p) for p in percents]))
    return df.agg(F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"), q.alias("q")).select(
        "mean", "std", *[F.col("q")[k].alias(f"p{round(p * 100)}") for k, p in enumerate(percents)]
    )


def edges_per_block(blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """Mean number of edges over all blocks, those without any included."""
    per = edges.groupBy("block_id").agg(F.count(F.lit(1)).alias("n"))
    return blocks.select("block_id").distinct().join(per, "block_id", "left").agg(F.avg(F.coalesce("n", F.lit(0))).alias("mean_edges"), F.count(F.lit(1)).alias("n_blocks"))


def zone_of_blocks(blocks: DataFrame) -> DataFrame:
    """(block_id, zone): the latest zone of each block, 'nan' where it has none."""
    return blocks.filter("block_id is not null").groupBy("block_id").agg(F.max(F.struct("loaded_at", "zone")).alias("r")).select("block_id", F.coalesce("r.zone", F.lit("nan")).alias("zone"))


def zone_rollup(nodes: DataFrame, blocks: DataFrame) -> DataFrame:
    """Active nodes, living share, mean floors and living area per zone, reduced per block before the join."""
    e, living, area = active(), flag(F.col("is_living")), number(F.col("living_area"), 0)
    per = nodes.groupBy("block_id").agg(
        F.count_if(e).alias("a"), F.count_if(e & living).alias("l"), F.sum(F.when(valid_floors(), F.col("floors_num"))).alias("f"),
        F.count_if(valid_floors()).alias("nf"), F.sum(F.when(e & living, area)).alias("la"),
    )
    return per.join(zone_of_blocks(blocks), "block_id", "left").groupBy(F.coalesce("zone", F.lit("nan")).alias("zone")).agg(
        F.sum("a").alias("active_nodes"), (F.sum("l") / (F.sum("a") + 1e-6)).alias("living_share"),
        (F.sum("f") / F.sum("nf")).alias("floors_mean"), F.coalesce(F.sum("la"), F.lit(0.0)).alias("living_area_sum"),
    )


def shape_histogram(nodes: DataFrame) -> DataFrame:
    label = F.coalesce(F.get(F.array(*[F.lit(s) for s in SHAPES]), F.col("s_i").cast("int")), F.lit("unknown"))
    return nodes.filter(active()).groupBy(label.alias("shape")).agg(F.count(F.lit(1)).alias("n"))


def moments(nodes: DataFrame, columns: Sequence[str] = MOMENTS) -> DataFrame:
    """(name, mean, std, min, max) over active nodes; NaN is left out."""
    parts = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), number(F.col(c)).alias("v")) for c in columns]))
    return nodes.filter(active()).select(parts.alias("x")).groupBy("x.name").agg(
        F.avg("x.v").alias("mean"), F.stddev_pop("x.v").alias("std"), F.min("x.v").alias("min"), F.max("x.v").alias("max")
    )


def top_values(df: DataFrame, column: str, k: int = 20) -> DataFrame:
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(k)


def services_long(nodes: DataFrame, keep: Sequence[str] = ("block_id",)) -> DataFrame:
    """One row per node and service: has, capacity."""
    cells = [F.struct(F.lit(n).alias("service"), flag(F.col(h)).alias("has"), number(F.col(c), 0).alias("capacity")) for n, h, c in service_columns(nodes)]
    return nodes.select(*keep, active().alias("is_active"), F.explode(F.array(*cells)).alias("s")).select(*keep, "is_active", "s.*")


def service_totals(nodes: DataFrame, only_active: bool = True) -> DataFrame:
    rows = services_long(nodes, []).filter("has")
    rows = rows.filter("is_active") if only_active else rows
    return rows.groupBy("service").agg(F.count(F.lit(1)).alias("n"), F.sum("capacity").alias("capacity"))


def blocks_with_services(nodes: DataFrame) -> DataFrame:
    """(block_id, any_service): whether a block has a service or capacity, by all its rows."""
    return services_long(nodes).groupBy("block_id").agg(F.bool_or(F.col("has") | (F.col("capacity") > 0)).alias("any_service"))


def split_ids(blocks: DataFrame, ratio: float) -> DataFrame:
    """(block_id, split): the first half-even round(n * ratio) ids in text order train, the others val."""
    ids = blocks.select("block_id").filter("block_id is not null").distinct()
    order = Window.orderBy("block_id")  # ids only: one column of the smallest table
    every = Window.partitionBy()
    return ids.select("block_id", F.row_number().over(order).alias("k"), F.count(F.lit(1)).over(every).alias("n")).select(
        "block_id", F.when(F.col("k") <= F.rint(F.col("n") * ratio), "train").otherwise("val").alias("split")
    )


def block_profile(blocks: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per block: occupancy, living share, mean floors, means and deviations of the geometry columns."""
    e = active()
    each = [f(F.when(e, number(F.col(c)))).alias(f"{c}_{n}") for c in MOMENTS for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
    per = nodes.groupBy("block_id").agg(
        (F.count_if(e) / F.count(F.lit(1))).alias("occupancy"),
        (F.count_if(e & flag(F.col("is_living"))) / F.greatest(F.count_if(e), F.lit(1))).alias("living_share"),
        F.avg(F.when(valid_floors(), F.col("floors_num"))).alias("floors_mean"), *each,
    )
    zeros = [F.coalesce(c, F.lit(0.0)).alias(c) for c in per.columns if c not in ("block_id", "floors_mean")]
    return blocks.select("block_id").filter("block_id is not null").distinct().join(per, "block_id", "left").select("block_id", "floors_mean", *zeros)


def label_frequencies(nodes: DataFrame) -> DataFrame:
    e = active()
    return nodes.agg(
        F.avg(F.when(e, 1.0).otherwise(0.0)).alias("p_e"), F.avg(F.when(e, one_if(F.col("is_living")))).alias("p_living"),
        F.avg(F.when(e, one_if(F.col("has_floors")))).alias("p_floors"),
        *[F.greatest(F.count_if(e & (F.col("s_i") == k)), F.lit(1)).alias(f"n_shape_{k}") for k in range(4)],
    )


def label_weights(nodes: DataFrame) -> DataFrame:
    """Positive weights of the three flags and inverse-frequency class weights with mean 1."""
    f = label_frequencies(nodes)
    inverse = [1.0 / F.col(f"n_shape_{k}") for k in range(4)]
    mean = reduce(lambda a, b: a + b, inverse) / 4
    return f.select(
        *[positive_weight(F.col(p)).alias(f"w_{p[2:]}") for p in ("p_e", "p_living", "p_floors")], *[(x / mean).alias(f"w_shape_{k}") for k, x in enumerate(inverse)]
    )


def block_totals(nodes: DataFrame) -> DataFrame:
    e = active()
    services = [x for n, h, c in service_columns(nodes) for x in (
        F.sum(F.when(e & flag(F.col(h)), number(F.col(c), 0)).otherwise(0.0)).alias(f"capacity_{n}"), F.max(F.when(e, one_if(F.col(h))).otherwise(0.0)).alias(f"present_{n}"),
    )]
    return nodes.groupBy("block_id").agg(
        F.sum(F.when(e, number(F.col("living_area"), 0)).otherwise(0.0)).alias("living_area"), F.avg(F.when(valid_floors(), F.col("floors_num"))).alias("floors_mean"), *services
    )


def vocabulary(df: DataFrame, column: str) -> DataFrame:
    """(value, id): sorted distinct texts and dense ids from 0."""
    return df.select(F.col(column).alias("value")).filter("value is not null").distinct().select("value", (F.row_number().over(Window.orderBy("value")) - 1).alias("id"))


def quantile_bins(df: DataFrame, key: str, column: str, bins: int) -> DataFrame:
    """(key, value, bin): right-closed bins at equal quantiles, repeated edges once; one bin if too few remain."""
    points = [k / bins for k in range(bins + 1)]
    edges = df.agg(F.array_distinct(F.percentile(column, F.array(*[F.lit(p) for p in points]))).alias("edges"))
    inner = F.when(F.size("edges") <= 2, F.array().cast("array<double>")).otherwise(F.slice("edges", 2, F.size("edges") - 2))
    rows = df.crossJoin(F.broadcast(edges.select(inner.alias("inner"))))  # one row
    return rows.select(key, F.col(column).alias("value"), F.size(F.filter("inner", lambda x: x < F.col(column))).alias("bin"))


def temperature_weights(blocks: DataFrame, tau: float) -> DataFrame:
    """(block_id, zone, weight): each block's weight is its zone's share to the power tau, normalised over blocks."""
    zoned = zone_of_blocks(blocks)
    share = zoned.groupBy("zone").agg(F.count(F.lit(1)).alias("n"))
    total = share.agg(F.sum("n").alias("all"))
    p = share.crossJoin(F.broadcast(total)).select("zone", F.col("n"), F.pow(F.col("n") / F.col("all"), F.lit(tau)).alias("w"))
    norm = p.agg(F.sum(F.col("n") * F.col("w")).alias("norm"))
    weights = p.crossJoin(F.broadcast(norm)).select("zone", (F.col("w") / F.col("norm")).alias("weight"))
    return zoned.join(weights, "zone").select("block_id", "zone", "weight")


def report(blocks: DataFrame, nodes: DataFrame, edges: DataFrame, branches: DataFrame) -> DataFrame:
    """(section, name, metric, value): all statistics in one long table."""
    def unpivoted(df: DataFrame, section: str, name: Column, metrics: Sequence[str]) -> DataFrame:
        cells = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]))
        return df.select(F.lit(section).alias("section"), name.alias("name"), cells.alias("x")).select("section", "name", "x.*")

    parts = [
        unpivoted(row_counts({"blocks": blocks, "nodes": nodes, "edges": edges, "branches": branches}), "global", F.col("name"), ["n"]),
        unpivoted(distribution(occupancy(nodes), "occupancy"), "global", F.lit("occupancy"), ["mean", "std", "p25", "p50", "p75"]),
        unpivoted(edges_per_block(blocks, edges), "global", F.lit("edges_per_block"), ["mean_edges"]),
        unpivoted(blocks.agg(F.avg(number(F.col("scale_l"), 0)).alias("mean"), F.stddev_pop(number(F.col("scale_l"), 0)).alias("std")), "global", F.lit("scale_l"), ["mean", "std"]),
        unpivoted(blocks.groupBy(F.coalesce("zone", F.lit("nan")).alias("zone")).agg(F.count(F.lit(1)).alias("blocks")), "zones", F.col("zone"), ["blocks"]),
        unpivoted(zone_rollup(nodes, blocks), "zones", F.col("zone"), ["active_nodes", "living_share", "floors_mean", "living_area_sum"]),
        unpivoted(shape_histogram(nodes), "shapes", F.col("shape"), ["n"]),
        unpivoted(moments(nodes), "geom", F.col("name"), ["mean", "std", "min", "max"]),
        unpivoted(top_values(nodes.filter(valid_floors()), "floors_num"), "floors", F.col("floors_num").cast("string"), ["n"]),
        unpivoted(service_totals(nodes), "services", F.col("service"), ["n", "capacity"]),
    ]
    return reduce(DataFrame.unionByName, parts)


def principal_angles(points: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group, angle, spread): direction of the largest variance of points (group, x, y) in (-pi/2, pi/2], and its share."""
    v = points.groupBy(*group).agg(F.var_samp("x").alias("vx"), F.var_samp("y").alias("vy"), F.covar_samp("x", "y").alias("c"))
    half = F.sqrt((F.col("vx") - F.col("vy")) * (F.col("vx") - F.col("vy")) / 4 + F.col("c") * F.col("c"))
    return v.select(*group, (0.5 * F.atan2(2 * F.col("c"), F.col("vx") - F.col("vy"))).alias("angle"), (0.5 + half / (F.col("vx") + F.col("vy"))).alias("spread"))


def along_axis(points: DataFrame, group: Sequence[str], key: str) -> DataFrame:
    """Adds place: the rank of a point along its group's principal axis; by x + y in groups of up to two."""
    line = Window.partitionBy(*group)
    many = F.count(F.lit(1)).over(line) > 2
    joined = points.withColumn("__many", many).join(principal_angles(points, group), list(group))
    t = F.when(F.col("__many"), F.col("x") * F.cos("angle") + F.col("y") * F.sin("angle")).otherwise(F.col("x") + F.col("y"))
    return joined.withColumn("place", F.row_number().over(line.orderBy(t, key)) - 1).drop("__many", "angle", "spread")


def main_direction(sides: DataFrame, group: Sequence[str], bins: int = 72) -> DataFrame:
    """(group, angle): the middle of the direction bin with the greatest length, in degrees of [-90, 90). sides: (group, dx, dy)."""
    degrees = F.pmod(F.degrees(F.atan2("dy", "dx")) + 90, F.lit(180.0))
    per = sides.select(*group, F.least(F.floor(degrees * bins / 180), F.lit(bins - 1)).alias("b"), F.hypot("dx", "dy").alias("w")).groupBy(*group, "b").agg(F.sum("w").alias("w"))
    return per.groupBy(*group).agg(F.max(F.struct(F.round("w", 6).alias("w"), (-F.col("b")).alias("b")))["b"].alias("b")).select(*group, ((-F.col("b") + 0.5) * 180 / bins - 90).alias("angle"))
