"""All queries of the core and their DuckDB SQL, with doubles rounded alike on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.plans import layouts, quality, sequences, spatials, statistics

MODULES = (quality, statistics, sequences, spatials, layouts)
DIGITS = 6
PLACES = {"d2": 8, "rect_area": 6, "fill": 7, "position": 10}


def rounded(query: Callable, columns: list[str], digits: int = DIGITS) -> Callable[[SparkSession, str], DataFrame]:
    """The query with these columns rounded, so that the order of additions doesn't show."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        df = query(spark, d)
        return df.select(*[F.round(c, PLACES.get(c, digits)).alias(c) if c in columns else F.col(c) for c in df.columns])

    run.__name__ = query.__name__
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {}
    for m in MODULES:
        out |= {k: rounded(f, m.DOUBLES[k].split()) if k in m.DOUBLES else f for k, f in m.QUERIES.items()}
    return out


def sql() -> dict[str, str]:
    out = {}
    for m in MODULES:
        for k, text in m.SQL.items():
            columns = m.DOUBLES.get(k, "").split()
            replaced = ", ".join(f"round(CAST({c} AS DOUBLE), {PLACES.get(c, DIGITS)}) AS {c}" for c in columns)
            out[k] = f"SELECT * REPLACE ({replaced}) FROM ({text})" if columns else text
    return out
