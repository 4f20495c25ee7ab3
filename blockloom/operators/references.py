"""Broken references: signed reference and existence counts per key, kept from change deltas.

Every change is a delta at a time: a reference adds to the reference count of its key, a
target row adds 1 to ``arrived`` and ``alive`` when it is loaded and takes 1 from ``alive``
when it is deleted. Running sums of the deltas per key give the state a reference met.

Defined results: references with a null key are no references; a reference without a time
is judged after all changes, its period is null; a target without a time exists from the
beginning; repeated rows count once in the report; empty tables give an empty report.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockloom.operators.prefix import running_sums

FIRST, LAST = "0001-01-01 00:00:00", "9999-12-31 00:00:00"


def reference_deltas(df: DataFrame, space: str, field: str, key: Sequence[Column], at: Column) -> DataFrame:
    """One delta per key, time and field of the referring rows."""
    out = df.select(
        F.lit(space).alias("space"), key[0].alias("k1"), key[1].cast("bigint").alias("k2"),
        F.coalesce(at.cast("timestamp"), F.lit(LAST).cast("timestamp")).alias("at"), F.lit(field).alias("field"),
        F.lit(1).cast("bigint").alias("refs"), F.lit(0).cast("bigint").alias("arrived"), F.lit(0).cast("bigint").alias("alive"),
    )
    return out.filter("k1 is not null and k2 is not null")


def existence_deltas(df: DataFrame, space: str, key: Sequence[Column], at: Column, deleted: Column | None = None) -> DataFrame:
    """+1 when a target row is loaded and, if it has ``deleted``, -1 when it is deleted."""
    loaded = F.coalesce(at.cast("timestamp"), F.lit(FIRST).cast("timestamp"))

    def delta(time: Column, arrived: int, alive: int) -> Column:
        return F.struct(time.alias("at"), F.lit(arrived).cast("bigint").alias("arrived"), F.lit(alive).cast("bigint").alias("alive"))

    changes = [delta(loaded, 1, 1)]
    if deleted is not None:
        gone = deleted.cast("timestamp")
        changes.append(F.when(gone.isNotNull(), delta(F.greatest(gone, loaded), 0, -1)))
    out = df.select(key[0].alias("k1"), key[1].cast("bigint").alias("k2"), F.explode(F.array(*changes)).alias("d"))
    return out.filter("k1 is not null and k2 is not null and d is not null").select(
        F.lit(space).alias("space"), "k1", "k2", "d.at", F.lit("").alias("field"), F.lit(0).cast("bigint").alias("refs"), "d.arrived", "d.alive"
    )


def counts_by_key(deltas: Sequence[DataFrame]) -> DataFrame:
    """The mergeable state: signed counts per key. States of several loads add up by the same call."""
    return reduce(DataFrame.unionByName, deltas).groupBy("space", "k1", "k2").agg(*[F.sum(c).alias(c) for c in ("refs", "arrived", "alive")])


def current_orphans(state: DataFrame) -> DataFrame:
    """Keys that are referred to and do not exist now."""
    return state.filter("refs > 0 and alive <= 0").select(
        "space", "k1", "k2", "refs", F.when(F.col("arrived") == 0, "missing").otherwise("deleted").alias("status")
    )


def broken_references(references: Sequence[DataFrame], targets: Sequence[DataFrame]) -> DataFrame:
    """(field, period, k1, k2, status) of each reference whose key did not exist at its time, once each."""
    keys, fields = ["space", "k1", "k2"], ["refs", "arrived", "alive"]
    changes = reduce(DataFrame.unionByName, [*references, *targets]).groupBy(*keys, "at").agg(
        *[F.sum(c).alias(c) for c in fields], F.collect_set(F.when(F.col("field") != "", F.col("field"))).alias("used_by")
    )
    at_time = running_sums(changes, keys, ["at"], ["arrived", "alive"])
    found = at_time.filter("refs > 0 and run_alive <= 0").select(
        *keys, F.explode("used_by").alias("field"), F.when(F.col("at") < F.lit(LAST).cast("timestamp"), F.date_format("at", "yyyy-MM")).alias("period"),
        (F.col("run_arrived") > 0).alias("came"),
    ).distinct()
    known = reduce(DataFrame.unionByName, list(targets)).select(*keys).distinct().withColumn("known", F.lit(True))
    return found.join(known, keys, "left").select(
        "field", "period", "k1", "k2",
        F.when(F.col("came"), "deleted").when(F.col("known"), "late").otherwise("missing").alias("status"),
    ).distinct()
