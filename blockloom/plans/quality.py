"""Queries of the general data problems (3 to 6) over the tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.operators import filling, nearby, profile, references
from blockloom.plans.quality_sql import SQL  # noqa: F401
from blockloom.session import table

CLOSE_M = 30.0


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    buildings, services = (nearby.locations(table(spark, d, t), k) for t, k in (("buildings", "building_id"), ("services", "service_id")))
    both = buildings.withColumn("relation", F.lit("building_in_block")).unionByName(services.withColumn("relation", F.lit("service_in_block")))
    held = nearby.regions_of(both, table(spark, d, "blocks"), "block_id").select("relation", F.col("id").alias("left_id"), F.col("region").alias("right_id")).distinct()
    return held.unionByName(nearby.close_pairs(services, CLOSE_M).withColumn("relation", F.lit("services_close")))


def _references(spark: SparkSession, d: str) -> tuple[list[DataFrame], list[DataFrame]]:
    nodes, branches, edges, blocks = (table(spark, d, t) for t in ("nodes_fixed", "branches", "edges", "blocks"))
    block, none, at = F.col("block_id"), F.lit(-1), F.col("loaded_at")
    refs = [
        references.reference_deltas(nodes, "block", "nodes_fixed.block_id", (block, none), at),
        references.reference_deltas(branches, "block", "branches.block_id", (block, none), at),
        references.reference_deltas(edges, "slot", "edges.src_slot", (block, F.col("src_slot")), at),
        references.reference_deltas(edges, "slot", "edges.dst_slot", (block, F.col("dst_slot")), at),
    ]
    targets = [
        references.existence_deltas(blocks, "block", (block, none), at, F.col("deleted_at")),
        references.existence_deltas(nodes, "slot", (block, F.col("slot_id")), at),
    ]
    return refs, targets


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return references.broken_references(*_references(spark, d)).select(
        F.col("field").alias("ref_field"), "period", F.col("k1").alias("block_id"), F.col("k2").alias("slot_id"), "status"
    )


def p4_current(spark: SparkSession, d: str) -> DataFrame:
    """The orphan report of now: keys with references and without a live target."""
    refs, targets = _references(spark, d)
    return references.current_orphans(references.counts_by_key([*refs, *targets])).select(
        "space", F.col("k1").alias("block_id"), F.col("k2").alias("slot_id"), F.col("refs").alias("n_references"), "status"
    )


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return filling.marked(p5_filled(spark, d))


def p5_filled(spark: SparkSession, d: str) -> DataFrame:
    """Every missing cell with its filled value, the method and the distance in years."""
    return filling.fill_missing(table(spark, d, "buildings"))


def histograms(spark: SparkSession, d: str) -> DataFrame:
    canon = table(spark, d, "canon_names").filter("kind = 'zone'").agg(F.collect_set("name_en").alias("zones"))
    blocks = table(spark, d, "blocks").select("zone", "load_id").crossJoin(F.broadcast(canon))  # one row
    return profile.merge(
        profile.histogram(table(spark, d, "nodes_fixed"), "nodes_fixed", {"floors_num": F.col("floors_num").between(1, 150), "e_i": F.col("e_i").isin(0, 1)}),
        profile.histogram(blocks, "blocks", {"zone": F.array_contains("zones", F.col("zone"))}),
    )


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return profile.findings(histograms(spark, d))


def p6_profile(spark: SparkSession, d: str) -> DataFrame:
    return profile.profile(histograms(spark, d))


QUERIES = {f.__name__: f for f in (p3_found, p4_found, p4_current, p5_found, p5_filled, p6_found, p6_profile)}
DOUBLES = {"p5_filled": "value", "p6_profile": "null_share min_number max_number mean mean_shift_sd"}
