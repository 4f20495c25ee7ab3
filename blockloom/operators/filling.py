"""Missing cells of buildings, filled from buildings of the same series and near years.

An entity is a building series, its time the year of building. All observed cells are first
reduced to one row per (series, year) - mean of a number, most frequent category - so the
timeline of even a series with a third of all rows has one row per year; it is joined back
only to missing cells. A number between two observed years is interpolated, one beside a
single observed year is carried; a category is carried from the nearest observed year
within ``gap`` years (the earlier at a tie). What the series cannot give comes from all series
of that year, then from all buildings. Each filled cell has its method and distance in years.

Defined results: rows are the latest of each building_id (ties: the largest values); a null
building_id is an entity without a series; a null or impossible year has no time and takes
the series' overall value; empty tables give empty results; if no cell at all is observed,
the method is ``none`` and the value null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NUMBERS, FLAGS = ("floors_num", "living_area"), ("is_living", "has_floors")
GAP = 10
YEARS = (1500, 2200)
SALTS = 16  # parts of the cells of one time


def storeys(text: Column) -> Column:
    """The storey count that a text states (1 to 150), else null: blanks, leading zeros, zero decimals and a unit word are allowed."""
    digits = F.regexp_extract(text, r"(?U)^\s*\+?0*(\d{1,3})(?:[.,]0*)?\s*(?:[-–]?\s*\p{L}+\.?)?\s*$", 1)
    n = digits.try_cast("int")
    return F.when(n.between(1, 150), n)


def observed(df: DataFrame) -> DataFrame:
    """The latest row per building with ``ok_<field>`` for each field that holds a value."""
    cells = ("series", "built_year", *NUMBERS, *FLAGS)
    latest = df.groupBy("building_id").agg(F.max(F.struct("loaded_at", *cells)).alias("r")).select("building_id", *[f"r.{c}" for c in cells])
    floors, area = storeys(F.col("floors_num")), F.col("living_area")
    finite = area.isNotNull() & ~F.isnan(area) & area.between(0.0, 200000.0)
    return latest.select(
        "building_id", "series", F.when(F.col("built_year").between(*YEARS), F.col("built_year")).alias("year"),
        floors.cast("double").alias("floors_num"), F.when(finite, area).alias("living_area"), *FLAGS,
        (floors.isNotNull() | F.coalesce(~F.col("has_floors"), F.lit(False))).alias("ok_floors_num"),
        F.coalesce(finite & ~((area == 0) & F.coalesce(F.col("is_living"), F.lit(False))), F.lit(False)).alias("ok_living_area"),
        *[F.col(c).isNotNull().alias(f"ok_{c}") for c in FLAGS],
    )


def long_cells(rows: DataFrame) -> DataFrame:
    """(building_id, series, year, field, ok, number, flag), one row per building and field."""
    cells = [F.struct(F.lit(c).alias("field"), F.col(f"ok_{c}").alias("ok"), F.col(c).cast("double").alias("number")) for c in (*NUMBERS, *FLAGS)]
    return rows.select("building_id", "series", "year", F.explode(F.array(*cells)).alias("x")).select("building_id", "series", "year", "x.*")


def summary(known: DataFrame, by: list[str]) -> DataFrame:
    """One value per (by, field): the mean of a number, the commoner value of a flag (true at a tie)."""
    mean = F.sum("total") / F.sum("n")
    return known.groupBy(*by, "field").agg(
        F.when(F.col("field").isin(*FLAGS), (mean >= 0.5).cast("double")).otherwise(mean).alias("v")
    )


def timeline(sums: DataFrame, wanted: DataFrame, gap: int) -> DataFrame:
    """(series, year, field, v, method, distance) of the wanted times, from the nearest observed years of the series."""
    at = summary(sums, ["series", "year"]).join(wanted, ["series", "year", "field"], "full")
    entity = Window.partitionBy("series", "field").orderBy("year")  # one row per year: at most YEARS
    seen = F.when(F.col("v").isNotNull(), F.struct("year", "v"))
    before = F.last(seen, True).over(entity.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(seen, True).over(entity.rowsBetween(1, Window.unboundedFollowing))
    x = at.select("series", "year", "field", "v", before.alias("b"), after.alias("a")).withColumns({
        "db": F.col("year") - F.col("b.year"), "da": F.col("a.year") - F.col("year"), "flag": F.col("field").isin(*FLAGS),
    })
    near = F.least("db", "da")
    between = F.col("b.v") + (F.col("a.v") - F.col("b.v")) * F.col("db") / (F.col("db") + F.col("da"))
    carried = F.when(F.coalesce(F.col("db") <= F.col("da"), F.col("b").isNotNull()), F.struct(F.col("b.v").alias("v"), F.lit("carried_forward").alias("method"))) \
        .otherwise(F.struct(F.col("a.v").alias("v"), F.lit("carried_backward").alias("method")))
    got = F.when(F.col("v").isNotNull(), F.struct("v", F.lit("same_year").alias("method"), F.lit(0).alias("distance"))) \
        .when(~F.col("flag") & F.col("b").isNotNull() & F.col("a").isNotNull(), F.struct(between.alias("v"), F.lit("interpolated").alias("method"), near.alias("distance"))) \
        .when(near <= gap, F.struct(carried["v"], carried["method"], near.alias("distance")))
    return x.select("series", "year", "field", got.alias("got")).filter("got is not null").select("series", "year", "field", "got.*")


def resolved(sums: DataFrame, wanted: DataFrame, gap: int) -> DataFrame:
    """(series, year, field, best) of the wanted times, null series and years too: the first step that has a value."""
    timed = sums.filter("series is not null and year is not null")
    steps = [
        (timeline(timed, wanted.filter("series is not null and year is not null"), gap), ["series", "year", "field"], None),
        (summary(sums.filter("series is not null"), ["series"]), ["series", "field"], "series_overall"),
        (summary(sums.filter("year is not null"), ["year"]), ["year", "field"], "year_overall"),
        (summary(sums, []), ["field"], "overall"),
    ]
    out = wanted
    for k, (values, on, method) in enumerate(steps):
        values = values if method is None else values.select(*on, "v", F.lit(method).alias("method"), F.lit(None).cast("int").alias("distance"))
        values = values.select(*on, F.struct("v", "method", "distance").alias(f"s{k}"))
        if k >= 2:  # at most 4 rows per year of YEARS, and 4 rows
            values = F.broadcast(values)
        out = out.join(values, on, "left")
    best = F.coalesce(*[F.when(F.col(f"s{k}.v").isNotNull(), F.col(f"s{k}")) for k in range(len(steps))])
    return out.select("series", "year", "field", best.alias("best"))


def fill_missing(df: DataFrame, gap: int = GAP) -> DataFrame:
    """(building_id, field, value, method, distance): one row per missing cell of the buildings.

    Values are found once per time and field that lacks any (at most YEARS times 4 per series) and joined
    back to the cells, salted, so neither a series nor the cells without one load one task.
    """
    cells = long_cells(observed(df))
    missing = cells.filter("not ok").select("building_id", "series", "year", "field")
    sums = cells.filter("ok and number is not null").groupBy("series", "year", "field").agg(F.sum("number").alias("total"), F.count("number").alias("n"))
    best = resolved(sums, missing.select("series", "year", "field").distinct(), gap)
    keyed = best.select(F.struct("series", "year", "field").alias("at"), "best", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = missing.select("building_id", "field", F.struct("series", "year", "field").alias("at"), F.pmod(F.hash("building_id"), F.lit(SALTS)).alias("salt"))
    value = F.when((F.col("field") == "floors_num") & (F.col("best.v") < 1), 1.0).when(F.col("field") == "floors_num", F.round(F.col("best.v"))).otherwise(F.col("best.v"))
    return salted.join(keyed, ["at", "salt"], "left").select(
        "building_id", "field", value.alias("value"), F.coalesce("best.method", F.lit("none")).alias("method"), "best.distance"
    )


def marked(filled: DataFrame) -> DataFrame:
    """(building_id, field) of the cells that the filling marks: with the method that gave a value, or as without any."""
    return filled.filter("method <> 'none' or value is null").select("building_id", "field").distinct()
