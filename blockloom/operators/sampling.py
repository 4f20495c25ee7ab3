"""Repeatable samplers: weights, strata, batches. Draws depend on hashed counters, not on partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockloom.functions.scalars import uniform


def sample_rows(df: DataFrame, key: Sequence[str], k: int, seed: int = 42) -> DataFrame:
    """k rows without replacement, by the order of a hash of the key."""
    return df.orderBy(F.xxhash64(F.lit(seed), *key), *key).limit(k)


def weighted_draws(items: DataFrame, key: str, weight: str, n: int, seed: int = 42) -> DataFrame:
    """(draw, key): n draws with replacement by inverse distribution; the items are a dimension table (blocks, zones)."""
    line, every = Window.orderBy(key), Window.partitionBy()
    cum = items.select(key, F.sum(weight).over(line).alias("hi"), F.col(weight).alias("w"), F.sum(weight).over(every).alias("total"))
    cum = cum.select(key, (F.col("hi") - F.col("w")).alias("lo"), "hi", "total").filter("hi > lo")
    draws = items.sparkSession.range(n).select(F.col("id").alias("draw"), uniform(F.col("id"), seed=seed).alias("u"))
    # an equi-join on a grid of the unit interval, then the exact range
    grid = 1024
    cells = cum.withColumn("__g", F.explode(F.sequence(F.floor(F.col("lo") / F.col("total") * grid).cast("int"), F.floor(F.col("hi") / F.col("total") * grid).cast("int"))))
    hit = draws.withColumn("__g", F.floor(F.col("u") * grid).cast("int")).join(cells, "__g")
    at = F.col("u") * F.col("total")
    return hit.filter((at >= F.col("lo")) & (at < F.col("hi"))).select("draw", key)


def uniform_by_group(items: DataFrame, key: str, group: str, n: int, seed: int = 42) -> DataFrame:
    """(draw, key): a random group, then a random item of it."""
    groups = items.select(group).distinct().withColumn("w", F.lit(1.0))
    drawn = weighted_draws(groups, group, "w", n, seed)
    ranked = items.select(group, key, (F.row_number().over(Window.partitionBy(group).orderBy(key)) - 1).alias("__r"), F.count(F.lit(1)).over(Window.partitionBy(group)).alias("__m"))
    sizes = ranked.select(group, "__m").distinct()
    picks = drawn.join(sizes, group).withColumn("__r", F.floor(uniform(F.col("draw"), seed=seed + 1) * F.col("__m")).cast("int"))
    return picks.join(ranked.drop("__m"), [group, "__r"]).select("draw", key)


def stratified(items: DataFrame, key: str, weight: str, strata: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """Half of the draws by weight, half by uniform strata."""
    half = n // 2
    named = items.withColumn("stratum", F.concat_ws("|", *strata))
    a = weighted_draws(named, key, weight, half, seed)
    b = uniform_by_group(named, key, "stratum", n - half, seed + 7).withColumn("draw", F.col("draw") + half)
    return a.unionByName(b)


def two_stream_batches(major: DataFrame, minor: DataFrame, special: DataFrame, key: str, size: int, share: float) -> DataFrame:
    """(batch, place, key): round(size * share) of the major stream per batch, the rest minor, shuffled; one special item at least.

    major, minor: (draw, key) in drawing order. A batch without a special key takes one in place 0.
    """
    k = int(size * share + 0.5)
    part = lambda df, m, name: df.select(F.floor(F.col("draw") / m).alias("batch"), F.lit(name).alias("stream"), F.col("draw"), key)
    rows = part(major, k, "major").unionByName(part(minor, size - k, "minor"))
    full = Window.partitionBy("batch")
    rows = rows.withColumns({"n": F.count(F.lit(1)).over(full)}).filter(F.col("n") == size)
    rows = rows.withColumn("place", F.row_number().over(full.orderBy(F.xxhash64("batch", "stream", "draw"))) - 1)
    marked = rows.join(special.select(key).distinct().withColumn("is_special", F.lit(True)), key, "left").withColumn("any", F.bool_or(F.coalesce("is_special", F.lit(False))).over(full))
    pool = special.agg(F.array_sort(F.collect_set(key)).alias("pool"))  # keys of blocks with services
    picked = F.get("pool", F.pmod(F.xxhash64("batch"), F.greatest(F.size("pool"), F.lit(1))).cast("int"))
    return marked.crossJoin(F.broadcast(pool)).select("batch", "place", F.when((~F.col("any")) & (F.col("place") == 0), F.coalesce(picked, key)).otherwise(F.col(key)).alias(key))
