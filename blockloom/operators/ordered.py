"""Ordered analytics: runs, chains, rank-aligned edges, even subsamples, slots and padding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def run_mask(df: DataFrame, line: Sequence[str], at: str, most: int = 8, out: str = "keep") -> DataFrame:
    """Marks what stays when every run of consecutive ``at`` in a line keeps ``most``, loses one, and so on.

    Closed form of gaps and islands: at - rank is constant in a run. Repeated cells of a line share their mark.
    """
    order = Window.partitionBy(*line).orderBy(at)
    island = Window.partitionBy(*line, "__island").orderBy(at)
    return df.withColumn("__island", F.col(at) - F.dense_rank().over(order)).withColumn(
        out, (F.dense_rank().over(island) - 1) % (most + 1) != most
    ).drop("__island")


def relative_cuts(df: DataFrame, group: Sequence[str], order: str, length: str) -> DataFrame:
    """Adds start and stop: the cumulative relative length before and after each segment; (0, 1) for no length."""
    every, upto = Window.partitionBy(*group), Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("__upto", F.sum(length).over(upto))
    total, stop = F.max("__upto").over(every), F.col("__upto")  # so that the last one stops at 1 exactly
    return df.withColumns({"start": F.when(total > 0, (stop - F.col(length)) / total).otherwise(0.0), "stop": F.when(total > 0, stop / total).otherwise(1.0)}).drop("__upto")


def segment_at(cuts: DataFrame, points: DataFrame, group: Sequence[str], position: str) -> DataFrame:
    """The segment that holds a normalised position: the last one that starts before it, the first for 0."""
    rows = points.join(cuts.select(*group, "segment", "start", "stop"), list(group))
    inside = (F.col("start") < F.col(position)) & (F.col(position) <= F.col("stop"))
    return rows.filter(inside | ((F.col(position) <= 0) & (F.col("start") == 0) & (F.col("stop") > 0)))


def chain_edges(nodes: DataFrame, line: Sequence[str] = ("block_id", "branch_local_id"), order: str = "posx", slot: str = "slot_id") -> DataFrame:
    """(block_id, src_slot, dst_slot): both directions between neighbours along a branch."""
    follow = nodes.select("block_id", F.col(slot).alias("a"), F.lead(slot).over(Window.partitionBy(*line).orderBy(order, slot)).alias("b")).filter("b is not null")
    return both_ways(follow)


def both_ways(pairs: DataFrame) -> DataFrame:
    ends = F.explode(F.array(F.struct(F.col("a").alias("src_slot"), F.col("b").alias("dst_slot")), F.struct(F.col("b").alias("src_slot"), F.col("a").alias("dst_slot"))))
    return pairs.select("block_id", ends.alias("e")).select("block_id", "e.*")


def rank_edges(nodes: DataFrame) -> DataFrame:
    """Edges between rank-aligned nodes of adjacent branches (in id order), both directions."""
    line = Window.partitionBy("block_id", "branch_local_id")
    ranked = nodes.select(
        "block_id", "branch_local_id", "slot_id", (F.row_number().over(line.orderBy("posx", "slot_id")) - 1).alias("r"), F.count(F.lit(1)).over(line).alias("n")
    )
    sizes = ranked.select("block_id", "branch_local_id", "n").distinct()
    follow = Window.partitionBy("block_id").orderBy("branch_local_id")
    pairs = sizes.select(
        "block_id", F.col("branch_local_id").alias("b1"), F.col("n").alias("n1"),
        F.lead("branch_local_id").over(follow).alias("b2"), F.lead("n").over(follow).alias("n2"),
    ).filter("b2 is not null").withColumn("m", F.least("n1", "n2"))
    steps = pairs.withColumn("k", F.explode(F.sequence(F.lit(0), (F.col("m") - 1).cast("int"))))
    at = lambda n: F.rint((F.col(n) - 1) * F.col("k") / F.greatest(F.col("m") - 1, F.lit(1))).cast("int")
    steps = steps.select("block_id", "b1", "b2", at("n1").alias("r1"), at("n2").alias("r2"))
    one = ranked.select("block_id", F.col("branch_local_id").alias("b1"), F.col("r").alias("r1"), F.col("slot_id").alias("a"))
    two = ranked.select("block_id", F.col("branch_local_id").alias("b2"), F.col("r").alias("r2"), F.col("slot_id").alias("b"))
    return both_ways(steps.join(one, ["block_id", "b1", "r1"]).join(two, ["block_id", "b2", "r2"]))


def even_subsample(df: DataFrame, group: Sequence[str], order: Sequence[str], k: int) -> DataFrame:
    """At most k rows per group at half-even round(linspace(0, n - 1, k)); all rows of smaller groups."""
    w = Window.partitionBy(*group)
    rows = df.withColumns({"__r": F.row_number().over(w.orderBy(*order)) - 1, "__n": F.count(F.lit(1)).over(w)})
    places = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.rint(i * (F.col("__n") - 1) / max(k - 1, 1)).cast("int"))
    return rows.filter((F.col("__n") <= k) | F.array_contains(places, F.col("__r"))).drop("__r", "__n")


def number_slots(df: DataFrame, order: Sequence[str], slots: int) -> DataFrame:
    """Adds slot_id from 0 in the given order per block; rows beyond the slots are left out."""
    return df.withColumn("slot_id", F.row_number().over(Window.partitionBy("block_id").orderBy(*order)) - 1).filter(F.col("slot_id") < slots)


def pad_slots(nodes: DataFrame, blocks: DataFrame, slots: int, defaults: dict[str, Column]) -> DataFrame:
    """Exactly ``slots`` rows per block: present nodes, then rows with the defaults."""
    frame = blocks.select("block_id").distinct().withColumn("slot_id", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    present = nodes.withColumn("__there", F.lit(True))
    joined = frame.join(present, ["block_id", "slot_id"], "left")
    here = F.col("__there").isNotNull()
    return joined.select("block_id", "slot_id", *[F.when(here, F.col(c)).otherwise(d).alias(c) for c, d in defaults.items()])


def drop_repeats(df: DataFrame, group: Sequence[str], order: str, value: Sequence[str]) -> DataFrame:
    """Leaves out rows whose values equal those of the row before."""
    w = Window.partitionBy(*group).orderBy(order)
    both = F.struct(*value)
    return df.withColumn("__last", F.lag(both).over(w)).filter(F.col("__last").isNull() | ~both.eqNullSafe(F.col("__last"))).drop("__last")


def keep_first(df: DataFrame, key: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("__k = 1").drop("__k")
