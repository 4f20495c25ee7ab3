"""Column profiles per load: one histogram pass, everything else from the histogram.

The histogram (table, column, load, value, rows) is the mergeable state: histograms of
loads, days or partitions add up. Its first step is a map-side aggregation, so a load, a
value or a key with a third of all rows costs one row per task. Power sums are exact
(DECIMAL(38)); a sum too large for that is null and its column says so by ``exact = false``.

Defined results: nulls are counted apart from values; NaN is a value of its own, is no
number and is outside every range; an empty table has no loads and so no rows; a load whose
values are all null has null ranges and no domain or shift finding; a null load id is a
load like any other in the profile and no case in the findings.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def histogram(df: DataFrame, name: str, columns: Mapping[str, Column | None], load: str = "load_id") -> DataFrame:
    """Rows per (tbl, col, load_id, value, legal). ``columns``: column to the condition of a legal value, or None."""
    cells = df.select(F.col(load).alias("load_id"), F.explode(F.array(*[
        F.struct(
            F.lit(c).alias("col"), F.col(c).cast("string").alias("value"),
            F.coalesce(rule if rule is not None else F.lit(True), F.lit(False)).alias("legal"),
        ) for c, rule in columns.items()
    ])).alias("x"))
    return cells.groupBy(F.lit(name).alias("tbl"), "x.col", "load_id", "x.value", "x.legal").agg(F.count(F.lit(1)).alias("n"))


def merge(*histograms: DataFrame) -> DataFrame:
    """The histogram of several loads or parts together."""
    return reduce(DataFrame.unionByName, histograms).groupBy("tbl", "col", "load_id", "value", "legal").agg(F.sum("n").alias("n"))


def profile(hist: DataFrame) -> DataFrame:
    """Nulls, distinct values, illegal values, ranges, power sums and the standardised mean difference per load."""
    number = F.expr("try_cast(value as decimal(38,6))")
    power = lambda k: reduce(lambda a, b: F.try_multiply(a, b), [number] * k)
    total = lambda e: F.try_sum(F.try_multiply(e, F.col("n").cast("decimal(20,0)")))
    per = hist.withColumn("x", number).groupBy("tbl", "col", "load_id").agg(
        F.sum("n").alias("n_rows"),
        F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("n_null"),
        F.countDistinct("value").alias("n_distinct"),
        F.sum(F.when(F.col("value").isNotNull() & ~F.col("legal"), F.col("n")).otherwise(0)).alias("n_illegal"),
        F.min("value").alias("min_text"), F.max("value").alias("max_text"),
        F.min("x").cast("double").alias("min_number"), F.max("x").cast("double").alias("max_number"),
        F.sum(F.when(F.col("x").isNotNull(), F.col("n")).otherwise(0)).alias("n_number"),
        total(power(1)).alias("sum1"), total(power(2)).alias("sum2"),
    )
    everything = Window.partitionBy("tbl", "col")  # one row per load
    mean = F.col("sum1").cast("double") / F.col("n_number")
    all_n, all_1, all_2 = (F.sum(F.col(c).cast("double")).over(everything) for c in ("n_number", "sum1", "sum2"))
    spread = F.sqrt(F.greatest(all_2 / all_n - (all_1 / all_n) * (all_1 / all_n), F.lit(0.0)))
    return per.select(
        "tbl", "col", "load_id", "n_rows", "n_null", (F.col("n_null") / F.col("n_rows")).alias("null_share"), "n_distinct", "n_illegal",
        "min_text", "max_text", "min_number", "max_number", mean.alias("mean"),
        F.when(spread > 0, (mean - all_1 / all_n) / spread).alias("mean_shift_sd"),
        (F.col("n_number") == 0).__or__(F.col("sum2").isNotNull()).alias("exact"),
    )


def findings(hist: DataFrame, nulls: float = 0.15, illegal: float = 0.05, shift: float = 0.3) -> DataFrame:
    """(tbl, col, load_id, finding) of loads that differ from all loads together."""
    col = ["tbl", "col"]
    per = hist.groupBy(*col, "load_id").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("n_null"),
        F.sum(F.when(F.col("value").isNotNull() & ~F.col("legal"), F.col("n")).otherwise(0)).alias("n_illegal"),
    )
    every = Window.partitionBy(*col)
    per = per.select(
        *col, "load_id", "n_null", "n", (F.col("n") - F.col("n_null")).alias("n_value"), "n_illegal",
        (F.sum("n_null").over(every) / F.sum("n").over(every)).alias("all_null"),
        F.sum(F.col("n") - F.col("n_null")).over(every).alias("all_value"),
    )
    # half the sum of |p - q| over all values = the sum of the positive parts of p - q, and those need a value in the load
    values = hist.filter("value is not null").groupBy(*col, "load_id", "value").agg(F.sum("n").alias("c"))
    share = values.groupBy(*col, "value").agg(F.sum("c").alias("all_c"))
    both = values.join(share, [*col, "value"]).join(
        per.select(*col, F.col("load_id").alias("__l"), "n_value", "all_value"),
        [values["tbl"] == per["tbl"], values["col"] == per["col"], F.col("load_id").eqNullSafe(F.col("__l"))],
    ).select(
        values["tbl"], values["col"], "load_id",
        F.greatest(F.col("c") / F.col("n_value") - F.col("all_c") / F.col("all_value"), F.lit(0.0)).alias("d"),
    )
    moved = both.groupBy(*col, "load_id").agg(F.sum("d").alias("d"))
    case = lambda rows, what: rows.select(*col, "load_id", F.lit(what).alias("finding"))
    return case(per.filter(F.abs(F.col("n_null") / F.col("n") - F.col("all_null")) > nulls), "nulls").unionByName(
        case(per.filter((F.col("n_value") > 0) & (F.col("n_illegal") > illegal * F.col("n_value"))), "domain")
    ).unionByName(case(moved.filter(F.col("d") > shift), "shift")).filter("load_id is not null")
