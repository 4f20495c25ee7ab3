"""Constrained allocation: capped water-filling, living area by zone, targets, slots per branch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: floor rules and the bounds of the usable share
FLOOR_AREA, SERVICE_FLOORS, LOW, HIGH = 100.0, {"kindergarten": 2, "school": 3, "polyclinics": 4}, 0.5, 0.75


def water_fill(df: DataFrame, group: Sequence[str], demand: str, weight: str, cap: str, order: Sequence[str], out: str = "x") -> DataFrame:
    """Adds x = min(cap, level * weight) with the sum of x equal to the demand, as far as the caps allow.

    Sorted by cap / weight, the level is fixed by the first item that isn't full: prefix sums, no iteration.
    """
    g = Window.partitionBy(*group)
    line = g.orderBy(F.col(cap) / F.col(weight), *order)
    before, rest = line.rowsBetween(Window.unboundedPreceding, -1), line.rowsBetween(0, Window.unboundedFollowing)
    rows = df.withColumns({"__full": F.coalesce(F.sum(cap).over(before), F.lit(0.0)), "__w": F.sum(weight).over(rest)})
    rows = rows.withColumn("__level", (F.col(demand) - F.col("__full")) / F.col("__w"))
    fits = F.col("__level") <= F.col(cap) / F.col(weight)
    level = F.first(F.when(fits, F.col("__level")), True).over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.withColumn(out, F.when(level.isNull(), F.col(cap)).otherwise(F.greatest(F.lit(0.0), F.least(F.col(cap), level * F.col(weight))))).drop("__full", "__w", "__level")


def floors(area: Column, living: Column, service: Column, most: Column) -> Column:
    """Living buildings by area, services by their type, never above the zone's limit."""
    fixed = F.coalesce(*[F.when(service == s, F.lit(n)) for s, n in SERVICE_FLOORS.items()], F.lit(1))
    return F.when(living, F.greatest(F.lit(1), F.least(F.floor(area / FLOOR_AREA + 0.5).cast("int"), most))).otherwise(F.least(fixed, most))


def living_area(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Adds target_used, share (K) and living_area to buildings (zone, area, floors, living, distance, target).

    The target is clipped to what shares of LOW to HIGH give; what exceeds the low share is filled by weight
    1 / (1e-6 + distance to the border). A zone without a positive target gets 0 and no share.
    """
    z = Window.partitionBy("zone")
    size = F.when(F.col("living"), F.col("area") * F.col("floors")).otherwise(0.0)
    rows = df.withColumn("size", size)
    wanted = F.greatest(F.sum(LOW * F.col("size")).over(z), F.least(F.sum(HIGH * F.col("size")).over(z), F.col("target")))
    rows = rows.withColumn("target_used", F.when(F.col("target") > 0, wanted)).withColumns({
        "__more": F.col("target_used") - F.sum(LOW * F.col("size")).over(z), "__cap": (HIGH - LOW) * F.col("size"), "__weight": 1.0 / (1e-6 + F.col("distance")),
    })
    filled = water_fill(rows, ["zone"], "__more", "__weight", "__cap", order, "__x")
    total = LOW * F.col("size") + F.col("__x")
    some = F.col("target_used").isNotNull() & (F.col("size") > 0)
    return filled.withColumns({"living_area": F.when(some, total).otherwise(0.0), "share": F.when(some, F.greatest(F.lit(LOW), F.least(F.lit(HIGH), total / F.col("size"))))}).drop("__more", "__cap", "__weight", "__x")


def zone_summary(df: DataFrame) -> DataFrame:
    """Per zone: targets, bounds, buildings, mean share, living area and a status text."""
    low, high = F.sum(LOW * F.col("size")), F.sum(HIGH * F.col("size"))
    s = df.groupBy("zone").agg(
        F.max("target").alias("target_requested"), F.max("target_used").alias("target_used"), low.alias("cap_min"), high.alias("cap_max"),
        F.count(F.lit(1)).alias("n_buildings"), F.avg("share").alias("mean_k"), F.sum("living_area").alias("sum_living_area"),
    )
    return s.withColumn("status", F.when(F.col("target_used").isNull(), "no target").otherwise(
        F.format_string("T_used=%.2f; cap_min=%.2f; cap_max=%.2f", F.col("target_used"), F.col("cap_min"), F.col("cap_max"))))


def fit_to_target(df: DataFrame, group: Sequence[str], value: str, active: Column, target: str) -> DataFrame:
    """Scales the active values so that they sum to the target; spreads it evenly where they sum to 0."""
    g = Window.partitionBy(*group)
    v = F.when(active, F.greatest(F.col(value), F.lit(0.0))).otherwise(0.0)
    total, n = F.sum(v).over(g), F.sum(active.cast("int")).over(g)
    return df.withColumn(value, F.when(~active, 0.0).when(total > 0, v * F.col(target) / total).otherwise(F.col(target) / n))


def slots_per_branch(counts: DataFrame, slots: int) -> DataFrame:
    """(block_id, branch, n, slots): shares of the slots by count, at least 1 each; differences go by remainder, in turn.

    counts: (block_id, branch, n). With more branches than slots each keeps 1. Takes from branches above 1 only:
    what a branch can give is known beforehand, so the turns are ranks of (turn, remainder), not a loop.
    """
    g = Window.partitionBy("block_id")
    share = F.col("n") * slots / F.sum("n").over(g)
    rows = counts.filter("n > 0").withColumn("share", share).withColumn("base", F.greatest(F.lit(1), F.rint("share").cast("int"))).withColumn("gap", slots - F.sum("base").over(g))
    rank = g.orderBy(F.desc(F.col("share") - F.col("base")), "branch")
    low = g.orderBy(F.col("share") - F.col("base"), "branch")
    rows = rows.withColumns({"k": F.row_number().over(rank) - 1, "lk": F.row_number().over(low), "m": F.count(F.lit(1)).over(g)})
    more = F.when(F.col("gap") > 0, F.floor(F.col("gap") / F.col("m")) + (F.col("k") < F.pmod(F.col("gap"), F.col("m"))).cast("int")).otherwise(0)
    # taking: the t-th unit of a branch is taken in turn t, in order of the smallest remainder
    units = rows.filter("gap < 0 and base > 1").select("block_id", "branch", "lk", "gap", F.explode(F.sequence(F.lit(1), F.col("base") - 1)).alias("t"))
    taken = units.withColumn("r", F.row_number().over(g.orderBy("t", "lk"))).filter("r <= -gap").groupBy("block_id", "branch").agg(F.count(F.lit(1)).alias("less"))
    return rows.withColumn("more", more).join(taken, ["block_id", "branch"], "left").select(
        "block_id", "branch", "n", (F.col("base") + F.col("more") - F.coalesce("less", F.lit(0))).cast("int").alias("slots")
    )


def zone_parameters(zones: DataFrame, by_id: DataFrame, by_name: DataFrame, floors: int = 9) -> DataFrame:
    """(zone_id, zone, target, max_floor): each field from the id's entry, else the name's, else no target and ``floors``.

    by_id, by_name: (key, target, max_floor), parameter documents.
    """
    a = by_id.select(F.col("key").alias("zone_id"), F.col("target").alias("t1"), F.col("max_floor").alias("f1"))
    b = by_name.select(F.col("key").alias("__name"), F.col("target").alias("t2"), F.col("max_floor").alias("f2"))
    named = zones.withColumn("__name", F.coalesce(F.lower(F.trim("zone")), F.lit("nan")))
    return named.join(a, "zone_id", "left").join(b, "__name", "left").select(
        "zone_id", "zone", F.coalesce("t1", "t2").alias("target"), F.coalesce("f1", "f2", F.lit(floors)).alias("max_floor")
    )
