"""Running sums per key that no hot key can turn into one large task.

Rows are range-partitioned by (keys, order), so a key with a third of all rows is spread
over a third of the partitions. Each partition sums its own part of every key; only the
first key of a partition can have begun in an earlier one, so at most one carried offset
per partition exists and that table (rows <= partitions) is broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockloom.session import cut, shuffle_partitions

PART = "__part"


def running_sums(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], partitions: int | None = None
) -> DataFrame:
    """Adds ``run_<value>``: the sum of the value over the key's rows up to and with this one.

    (keys, order) must be unique (aggregate first). Null keys form a key of their own, null
    order values come first, null values count as 0. An empty input gives an empty result.
    """
    keys, order, values = list(keys), list(order), list(values)
    n = partitions or shuffle_partitions(df.sparkSession)
    # written once: the partition numbers must stay the same for both uses
    ranged = cut(df.repartitionByRange(n, *keys, *order).withColumn(PART, F.spark_partition_id()))
    inside = Window.partitionBy(PART, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.select("*", *[F.sum(F.coalesce(F.col(v), F.lit(0))).over(inside).alias(f"run_{v}") for v in values])
    parts = ranged.groupBy(PART, *keys).agg(*[F.sum(F.coalesce(F.col(v), F.lit(0))).alias(f"__add_{v}") for v in values])
    before = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        PART, *[F.col(k).alias(f"__k_{k}") for k in keys], F.count(F.lit(1)).over(before).alias("__earlier"),
        *[F.sum(f"__add_{v}").over(before).alias(f"__add_{v}") for v in values],
    ).filter("__earlier > 0").drop("__earlier")
    offsets = offsets.withColumnRenamed(PART, "__p")
    same = local[PART] == offsets["__p"]
    for k in keys:
        same = same & local[k].eqNullSafe(offsets[f"__k_{k}"])
    return local.join(F.broadcast(offsets), same, "left").select(
        *[local[c] for c in df.columns],
        *[(local[f"run_{v}"] + F.coalesce(offsets[f"__add_{v}"], F.lit(0))).alias(f"run_{v}") for v in values],
    )
