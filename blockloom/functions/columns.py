"""Columns found by name on the analysed schema; no pass over data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: accepted column names, in order of preference
ZONE_NAMES = ("zone", "functional_zone_type_name", "functional_zone", "zone_type", "zone_name", "landuse", "category", "type")
WEIGHT_NAMES = ("e", "weight", "density", "value")


def resolve(df: DataFrame, candidates: Sequence[str], kind: str, default=None) -> Column:
    """The first candidate that is a column, as ``kind``; the default where none is."""
    names = {c.lower(): c for c in df.columns}
    for c in candidates:
        if c.lower() in names:
            return F.col(names[c.lower()]).cast(kind)
    return F.lit(default).cast(kind)


def available(df: DataFrame, wanted: Sequence[str]) -> list[str]:
    return [c for c in wanted if c in df.columns]


def service_columns(df: DataFrame) -> list[tuple[str, str, str]]:
    """(name, has column, capacity column) of each service with both, by name."""
    names = sorted(c[len("has_service__"):] for c in df.columns if c.startswith("has_service__"))
    return [(n, f"has_service__{n}", f"service_capacity__{n}") for n in names if f"service_capacity__{n}" in df.columns]
