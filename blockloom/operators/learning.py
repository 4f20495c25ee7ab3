"""Inputs, strata, loss values and predictions of a layout model, as DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockloom.functions.columns import service_columns
from blockloom.functions.scalars import encode_area, encode_capacity, number, one_hot, one_if, sigmoid
from blockloom.operators.stats import active


def node_targets(nodes: DataFrame, scale: DataFrame) -> DataFrame:
    """(block_id, slot_id, targets ARRAY<DOUBLE>): existence, place, size, turn, fill, area code, flags, services. scale: (block_id, scale_l)."""
    rows = nodes.join(scale, "block_id", "left").withColumn("scale_l", number(F.col("scale_l"), 0))
    values = [active().cast("double"), *[number(F.col(c), 0) for c in ("posx", "posy", "size_x", "size_y", "phi_resid", "a_i")]]
    values += [encode_area(F.greatest(number(F.col("living_area"), 0), F.lit(0.0)), F.col("scale_l")), one_if(F.col("is_living")), one_if(F.col("has_floors")), number(F.col("floors_num"), -1)]
    for _, h, c in service_columns(nodes):
        values += [one_if(F.col(h)), encode_capacity(number(F.col(c), 0))]
    return rows.select("block_id", "slot_id", F.array(*values).alias("targets"))


def block_features(blocks: DataFrame, zones: DataFrame) -> DataFrame:
    """(block_id, features): zone one-hot and scale. zones: (value, id), a vocabulary; its size is read once."""
    n = zones.count()
    rows = blocks.join(zones, blocks["zone"] == zones["value"], "left")
    hot = F.transform(one_hot(F.coalesce("id", F.lit(-1)), max(n, 1)), lambda v: v.cast("double"))
    return rows.select("block_id", F.concat(hot, F.array(number(F.col("scale_l"), 0))).alias("features"))


def strata(profile: DataFrame, columns: Sequence[str], k: int = 8, seed: int = 42) -> DataFrame:
    """(block_id, stratum): k-means on the profile columns; -1 for blocks with missing values or fewer blocks than clusters."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    whole = profile.dropna(subset=list(columns))
    if whole.limit(k).count() < k:
        return profile.select("block_id", F.lit(-1).alias("stratum"))
    data = VectorAssembler(inputCols=list(columns), outputCol="v").transform(whole)
    found = KMeans(k=k, seed=seed, featuresCol="v", predictionCol="stratum").fit(data).transform(data).select("block_id", "stratum")
    return profile.select("block_id").join(found, "block_id", "left").select("block_id", F.coalesce("stratum", F.lit(-1)).alias("stratum"))


def loss_values(df: DataFrame, group: str = "block_id", smoothing: float = 0.05) -> DataFrame:
    """Per block: smoothed cross-entropy of existence, masked absolute errors, squared error of the area sum.

    df: (block_id, e_logit, e, x, y, px, py, la, pla).
    """
    t = F.col("e") * (1 - smoothing) + smoothing / 2
    p = sigmoid(F.col("e_logit"))
    bce = -(t * F.log(F.greatest(p, F.lit(1e-12))) + (1 - t) * F.log(F.greatest(1 - p, F.lit(1e-12))))
    m = F.col("e")
    masked = lambda e: F.sum(e * m) / F.greatest(F.sum(m), F.lit(1.0))
    return df.groupBy(group).agg(
        F.avg(bce).alias("existence"), masked(F.abs(F.col("px") - F.col("x")) + F.abs(F.col("py") - F.col("y"))).alias("position"), masked(F.abs(F.col("pla") - F.col("la"))).alias("area"),
        F.pow(F.sum(F.col("pla") * p) - F.sum(F.col("la") * m), 2).alias("area_sum"),
    )


def collisions(points: DataFrame, least: float) -> DataFrame:
    """(block_id, collision): mean squared shortfall of distances below ``least``; only near cells are paired."""
    cell = lambda c: F.floor(F.col(c) / least)
    a = points.select("block_id", F.col("id").alias("i"), F.col("x").alias("ax"), F.col("y").alias("ay"), cell("x").alias("cx"), cell("y").alias("cy"))
    b = points.select("block_id", F.col("id").alias("j"), F.col("x").alias("bx"), F.col("y").alias("by"), F.explode(F.sequence(cell("x") - 1, cell("x") + 1)).alias("cx"), cell("y").alias("hy"))
    b = b.withColumn("cy", F.explode(F.sequence(F.col("hy") - 1, F.col("hy") + 1))).drop("hy")
    d = F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by"))
    near = a.join(b, ["block_id", "cx", "cy"]).filter("i < j").select("block_id", F.pow(F.greatest(F.lit(0.0), least - d), 2).alias("s"))
    sums = near.groupBy("block_id").agg(F.sum("s").alias("s"))
    n = points.groupBy("block_id").agg(F.count(F.lit(1)).alias("n"))
    return n.join(sums, "block_id", "left").select("block_id", (F.coalesce("s", F.lit(0.0)) / F.greatest(F.col("n") * (F.col("n") - 1) / 2, F.lit(1))).alias("collision"))


def decode_predictions(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Adds exists, and area and capacity where their presence is above one half. df: (..., e_logit, la_code, scale_l, presence, cap_code)."""
    on = sigmoid(F.col("presence")) > 0.5
    return df.withColumns({
        "exists": sigmoid(F.col("e_logit")) > threshold, "living_area": F.greatest(F.lit(0.0), F.expm1("la_code") * (F.col("scale_l") * F.col("scale_l") + 1e-6)),
        "capacity": F.when(on, F.greatest(F.lit(0.0), F.expm1("cap_code"))).otherwise(0.0),
    })


def predict(df: DataFrame, model: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Any model of batches: frames in, frames out."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield model(pdf)

    return df.mapInPandas(run, schema)


def turned(phi: Column, block_angle: Column, mean_phi: Column) -> Column:
    """The angle corrected by how far the block's direction is from the mean of its buildings', in (-pi, pi]."""
    import math

    return F.pmod(phi + F.pmod(block_angle - mean_phi + math.pi, F.lit(2 * math.pi)) - math.pi + math.pi, F.lit(2 * math.pi)) - math.pi
