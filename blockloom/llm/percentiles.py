"""Exact percentiles of very large columns from mergeable value counts.

The state is (group, value, rows): states of partitions, loads or days add up by one
aggregation. Percentiles come from cumulative frequencies: the counts are range-sorted by
(group, value), every partition sums its own run, the sums of earlier partitions are added
as offsets, and the first value whose cumulative count reaches the target rank is taken. No
group is collected, however large. Error bound: 0 - the percentile is the value at rank
ceil(p / 100 * n) exactly. With ``digits`` the values are first rounded to that many
significant digits, which bounds the state, and the relative error by 10^(1 - digits) / 2.

Defined results: nulls and NaN are no values; a group without values has no row; infinite
values are values; a null group is a group; ties count by their rows; empty tables give an
empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockloom.operators.prefix import running_sums

KEYS = ["measure", "grp"]


def rounded(x: Column, digits: int) -> Column:
    scale = F.pow(F.lit(10.0), digits - 1 - F.floor(F.log10(F.abs(x))))
    return F.when((x == 0) | (F.abs(x) == float("inf")), x).otherwise(F.rint(x * scale) / scale)


def value_counts(df: DataFrame, measures: Sequence[str], group: Column, digits: int | None = None) -> DataFrame:
    """(measure, grp, value, n) of the measures of a table."""
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures]))
    rows = df.select(group.alias("grp"), cells.alias("x")).select("x.measure", "grp", (F.col("x.value") + F.lit(0.0)).alias("value"))
    rows = rows.filter("value is not null and not isnan(value)")
    if digits is not None:
        rows = rows.withColumn("value", rounded(F.col("value"), digits))
    return rows.groupBy(*KEYS, "value").agg(F.count(F.lit(1)).alias("n"))


def merge(*states: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, states).groupBy(*KEYS, "value").agg(F.sum("n").alias("n"))


def percentiles(state: DataFrame, percents: Sequence[int] = (50, 90, 99)) -> DataFrame:
    """(measure, grp, percentile, value, n) of a state."""
    total = state.groupBy(*KEYS).agg(F.sum("n").alias("total"))
    run = running_sums(state, KEYS, ["value"], ["n"])
    t = total.select(F.col("measure").alias("m"), F.col("grp").alias("g"), "total")
    rows = run.join(t, (run["measure"] == t["m"]) & run["grp"].eqNullSafe(t["g"])).withColumn(
        "percentile", F.explode(F.array(*[F.lit(p) for p in percents]))
    )
    target = F.expr("(percentile * total + 99) div 100")
    return rows.filter((F.col("run_n") >= target) & (F.col("run_n") - F.col("n") < target)).select(
        *KEYS, "percentile", "value", F.col("total").alias("n")
    )
