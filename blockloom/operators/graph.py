"""Graph operators: nearest neighbours, edge enrichment, components, neighbour means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockloom.operators.ordered import both_ways
from blockloom.session import cut


def knn(points: DataFrame, group: Sequence[str], key: str, x: Sequence[str], k: int) -> DataFrame:
    """(group, src, dst, d2, rank): the k nearest other points of the same group; ties by key.

    Groups are blocks of at most a few hundred slots; for groups without that bound use ``knn_near``.
    """
    one = points.select(*group, F.col(key).alias("src"), *[F.col(c).alias(f"a_{c}") for c in x])
    two = points.select(*group, F.col(key).alias("dst"), *[F.col(c).alias(f"b_{c}") for c in x])
    d2 = sum(((F.col(f"a_{c}") - F.col(f"b_{c}")) * (F.col(f"a_{c}") - F.col(f"b_{c}")) for c in x), F.lit(0.0))
    order = Window.partitionBy(*group, "src").orderBy("d2", "dst")
    return one.join(two, list(group)).filter("src <> dst").withColumn("d2", d2).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        *group, "src", "dst", "d2", "rank"
    )


def enrich_edges(edges: DataFrame, neighbours: DataFrame) -> DataFrame:
    """The undirected closure of neighbour pairs that aren't edges yet. edges: (block_id, src_slot, dst_slot)."""
    pairs = both_ways(neighbours.select("block_id", F.col("src").alias("a"), F.col("dst").alias("b"))).distinct()
    return pairs.join(edges, ["block_id", "src_slot", "dst_slot"], "left_anti")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node of each component, by alternating minimum of neighbours and jumps.

    Every round halves the remaining paths; it is written to the shared checkpoint folder.
    """
    both = cut(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).unionByName(edges.select(F.col(b).alias("u"), F.col(a).alias("v"))).filter("u is not null and v is not null").distinct())
    labels = cut(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.min("u")).alias("component")))
    for _ in range(rounds):
        near = both.join(labels.select(F.col("node").alias("v"), "component"), "v").groupBy(F.col("u").alias("node")).agg(F.min("component").alias("c"))
        lower = labels.join(near, "node").select("node", F.least("component", "c").alias("component"), F.col("component").alias("old"))
        jump = lower.select(F.col("node").alias("component"), F.col("component").alias("to"))
        after = cut(lower.join(jump, "component", "left").select("node", F.coalesce("to", "component").alias("component"), "old"))
        if not after.filter("component <> old").limit(1).count():
            return after.select("node", "component")
        labels = after.select("node", "component")
    raise RuntimeError(f"components are not stable after {rounds} rounds")


def neighbour_mean(nodes: DataFrame, edges: DataFrame, features: Sequence[str]) -> DataFrame:
    """(block_id, slot_id, mean_<f>): means over in-neighbours; 0 without neighbours. One layer of mean aggregation."""
    source = nodes.select("block_id", F.col("slot_id").alias("src_slot"), *features)
    means = edges.join(source, ["block_id", "src_slot"]).groupBy("block_id", F.col("dst_slot").alias("slot_id")).agg(*[F.avg(f).alias(f"mean_{f}") for f in features])
    return nodes.select("block_id", "slot_id").join(means, ["block_id", "slot_id"], "left").na.fill(0.0, [f"mean_{f}" for f in features])


def knn_near(points: DataFrame, group: Sequence[str], key: str, x: str, y: str, k: int, rounds: int = 40) -> DataFrame:
    """As ``knn`` in the plane, exact, for groups of any size: cells of about k points, searched in growing rings.

    A point is done when its k-th neighbour is nearer than the edge of the 3 x 3 cells around it, or they
    cover its group; the others are searched again with cells twice as wide. The number of candidates of
    a point is bounded by the density of its surroundings, not by its group.
    """
    group = list(group)
    box = points.groupBy(*group).agg(F.count(F.lit(1)).alias("__n"), F.min(x).alias("__x0"), F.max(x).alias("__x1"), F.min(y).alias("__y0"), F.max(y).alias("__y1"))
    span = F.greatest(F.col("__x1") - F.col("__x0"), F.col("__y1") - F.col("__y0"), F.lit(1e-12))
    sized = cut(points.select(*group, F.col(key).alias("id"), F.col(x).alias("x"), F.col(y).alias("y")).join(
        box.withColumn("__c", span / F.greatest(F.floor(F.sqrt(F.col("__n") / k)), F.lit(1))).withColumn("__span", span), group
    ))
    found, left, factor = None, sized, 1.0
    for _ in range(rounds):
        cell = F.col("__c") * factor
        at = lambda v, low: F.floor((F.col(v) - F.col(low)) / cell)  # noqa: E731, B023
        homes = sized.withColumns({"cx": at("x", "__x0"), "cy": at("y", "__y0")}).select(*group, F.col("id").alias("dst"), F.col("x").alias("dx"), F.col("y").alias("dy"), "cx", "cy")
        ask = left.withColumns({"hx": at("x", "__x0"), "hy": at("y", "__y0")})
        ask = ask.withColumn("cx", F.explode(F.sequence(F.col("hx") - 1, F.col("hx") + 1))).withColumn("cy", F.explode(F.sequence(F.col("hy") - 1, F.col("hy") + 1)))
        order = Window.partitionBy(*group, "id").orderBy("d2", "dst")
        near = ask.join(homes, [*group, "cx", "cy"]).filter("id <> dst").withColumn(
            "d2", (F.col("x") - F.col("dx")) * (F.col("x") - F.col("dx")) + (F.col("y") - F.col("dy")) * (F.col("y") - F.col("dy"))
        ).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        # distance to the nearest edge of the 3 x 3 cells
        ox, oy = (F.col(v) - F.col(lo) - F.col(h) * cell for v, lo, h in (("x", "__x0", "hx"), ("y", "__y0", "hy")))
        edge = F.least(ox + cell, oy + cell, 2 * cell - ox, 2 * cell - oy)
        per = near.groupBy(*group, "id").agg(F.count(F.lit(1)).alias("c"), F.max("d2").alias("far"), F.first(edge).alias("edge"), F.first(cell >= F.col("__span")).alias("all"))
        done = per.filter(((F.col("c") == k) & (F.sqrt("far") < F.col("edge"))) | F.col("all")).select(*group, "id")
        near, done = cut(near), cut(done)
        got = near.join(done, [*group, "id"], "left_semi").select(*group, F.col("id").alias("src"), "dst", "d2", "rank")
        found = got if found is None else found.unionByName(got)
        left = cut(left.join(done, [*group, "id"], "left_anti").filter(F.col("__n") > 1))
        if left.isEmpty():
            return found
        factor *= 2
    raise RuntimeError("nearest neighbours are not complete")
