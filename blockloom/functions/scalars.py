"""Scalar functions as Column expressions; all stay inside whole-stage code generation unless noted."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: letters that canonical decomposition splits, as their slug form
DECOMPOSED = {"й": "и_", "ё": "е_", "Й": "и_", "Ё": "е_"}
TRUE_WORDS, FALSE_WORDS = ("true", "yes", "y", "t", "1"), ("false", "no", "n", "f", "0")


def number(x: Column, default: float | None = None) -> Column:
    """A finite-or-infinite double; text that is none, null and NaN become the default."""
    n = x.try_cast("double")
    n = F.when(~F.isnan(n), n)
    return n if default is None else F.coalesce(n, F.lit(float(default)))


def flag(x: Column) -> Column:
    return F.coalesce(x.cast("boolean"), F.lit(False))


def one_if(x: Column) -> Column:
    return F.when(flag(x), 1.0).otherwise(0.0)


def first_valid(candidates: Sequence[Column], ok) -> Column:
    """The first candidate that reads as a number and satisfies ok(number)."""
    return F.coalesce(*[F.when(ok(number(c)), number(c)) for c in candidates])


def capacity(*candidates: Column) -> Column:
    """The first finite candidate, else 1."""
    return F.coalesce(first_valid(candidates, lambda n: F.abs(n) < float("inf")), F.lit(1.0))


def people(candidates: Sequence[Column], default: int) -> Column:
    """The first candidate whose whole part is positive."""
    return F.coalesce(*[F.when(number(c).cast("int") > 0, number(c).cast("int")) for c in candidates], F.lit(default))


def lenient_number(x: Column) -> Column:
    """true/yes/... as 1, false/no/... as 0, other text as the number it states, or null."""
    low = F.lower(F.trim(x))
    return F.when(low.isin(*TRUE_WORDS), 1.0).when(low.isin(*FALSE_WORDS), 0.0).otherwise(number(low))


def slug(x: Column) -> Column:
    """Lower-case words of Latin and Cyrillic letters and digits joined by single underscores; 'service' if none."""
    s = F.trim(x)
    for letter, form in DECOMPOSED.items():
        s = F.replace(s, F.lit(letter), F.lit(form))
    s = F.lower(F.replace(s, F.lit(" "), F.lit(" ")))
    s = F.regexp_replace(s, r"[\s/\\]+", "_")
    s = F.regexp_replace(s, r"[^0-9a-zа-яё_]", "_")
    s = F.regexp_replace(F.regexp_replace(s, "_+", "_"), "^_|_$", "")
    return F.when(s == "", "service").otherwise(s)


def property_key(x: Column, fallback: str = "prop") -> Column:
    s = F.regexp_replace(F.regexp_replace(x, r"(?U)[^\w]+", "_"), "^_+|_+$", "")
    return F.when(s == "", fallback).otherwise(s)


def epsg(x: Column) -> Column:
    s = F.upper(F.trim(x))
    return F.when(s.startswith("EPSG:"), s).otherwise(F.concat(F.lit("EPSG:"), s))


def padded(prefix: str, n: Column, width: int) -> Column:
    return F.concat(F.lit(prefix), F.lpad(n.cast("string"), width, "0"))


def comma_list(x: Column) -> Column:
    return F.filter(F.transform(F.split(x, ","), lambda p: F.trim(p)), lambda p: p != "")


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def half_even(x: Column) -> Column:
    return F.rint(x)


def encode_area(area: Column, scale: Column, eps: float = 1e-6) -> Column:
    return F.log1p(area / (scale * scale + eps))


def decode_area(code: Column, scale: Column, eps: float = 1e-6) -> Column:
    return F.expm1(code) * (scale * scale + eps)


def encode_capacity(c: Column) -> Column:
    return F.log1p(F.greatest(c, F.lit(0.0)))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def position_code(x: Column, y: Column, octaves: int = 4) -> Column:
    """x, y and their sines and cosines at 2^k pi: 2 + 4 * octaves values."""
    turns = F.sequence(F.lit(0), F.lit(octaves - 1))
    wave = lambda f, v: F.transform(turns, lambda k: f(v * F.pow(F.lit(2.0), k) * math.pi))
    return F.concat(F.array(x, y), wave(F.sin, x), wave(F.cos, x), wave(F.sin, y), wave(F.cos, y))


def positive_weight(share: Column) -> Column:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(0.999999), share))
    return (1 - p) / p


def wrapped(angle: Column, period: float = 360.0) -> Column:
    """The angle in [-period / 2, period / 2)."""
    return F.pmod(angle + period / 2, F.lit(period)) - period / 2


def axis_angle(ux: Column, uy: Column, vx: Column, vy: Column) -> Column:
    """The signed smaller angle between two unit axes."""
    dot = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), ux * vx + uy * vy))
    turn = F.acos(dot)
    cross = ux * vy - uy * vx
    return F.least(turn, math.pi - turn) * F.when(cross < 0, -1.0).otherwise(1.0)


def unit(x: Column, y: Column) -> Column:
    """The unit vector; (1, 0) for a vector without length."""
    n = F.hypot(x, y)
    return F.when(n <= 1e-12, F.struct(F.lit(1.0).alias("x"), F.lit(0.0).alias("y"))).otherwise(F.struct((x / n).alias("x"), (y / n).alias("y")))


def one_hot(i: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.when(k == i, 1).otherwise(0))


def slots_per_side(width: Column, height: Column, cell: float = 100.0, most: int = 5000) -> Column:
    return F.least(F.lit(most), F.greatest(F.lit(1), F.ceil(width / cell), F.ceil(height / cell)))


def site_cells(area: Column, cell: float) -> Column:
    return F.ceil(F.greatest(area, F.lit(1.0)) / (cell * cell))


def rectangles(n: Column, most: int = 12) -> Column:
    """ARRAY<STRUCT<waste, skew, r, c>>: up to ``most`` grids of at least n cells, aspect at most 3, least waste first."""
    rows = F.sequence(F.lit(1), (F.floor(F.sqrt(n)) + 12).cast("int"))
    shape = lambda r: F.struct(
        (r * F.ceil(n / r) - n).cast("int").alias("waste"), F.abs(r - F.ceil(n / r)).cast("int").alias("skew"), r.cast("int").alias("r"), F.ceil(n / r).cast("int").alias("c")
    )
    fair = F.filter(F.transform(rows, shape), lambda s: F.greatest(s["r"], s["c"]) <= 3 * F.least(s["r"], s["c"]))
    return F.slice(F.array_sort(fair), 1, most)


def uniform(*keys: Column, seed: int = 42) -> Column:
    """A number in (0, 1) that depends only on the keys."""
    return (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def number_list(x: Column) -> Column:
    """ARRAY<DOUBLE> of a JSON list or object text, or a list literal with single quotes; null for anything else."""
    text = F.translate(F.trim(x), "'()", '"[]')
    values = F.coalesce(F.from_json(text, "array<string>"), F.map_values(F.from_json(text, "map<string,string>")))
    return F.when(text.rlike(r"^[\[{]"), F.transform(values, lambda v: number(v)))
