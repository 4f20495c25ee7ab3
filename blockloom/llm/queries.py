"""Queries of the problems tagged llm over the tables of a folder, and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.llm import canonical, components, encoding, leakage, percentiles, pieces
from blockloom.session import table


def vocabulary() -> str:
    """The rank file of byte_bpe_50k: $BLOCKLOOM_TOKENIZERS or the installed public_tokenizers."""
    folder = os.environ.get("BLOCKLOOM_TOKENIZERS")
    if folder:
        return os.path.join(folder, "byte_bpe_50k.tiktoken")
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}
SALTS = 16  # parts of a hot block's rows in a join with blocks


def block_ties(spark: SparkSession, d: str) -> DataFrame:
    """(token, record): blocks by the buildings and masks they have."""
    nodes, blocks = table(spark, d, "nodes_fixed"), table(spark, d, "blocks")
    held = nodes.select("building_id", "block_id").distinct().join(table(spark, d, "buildings").select("building_id").distinct(), "building_id", "left_semi")
    return held.select(F.concat(F.lit("b:"), "building_id").alias("token"), F.col("block_id").alias("record")).unionByName(
        blocks.select(F.concat(F.lit("m:"), "mask_path").alias("token"), F.col("block_id").alias("record"))
    )


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return components.groups_of(block_ties(spark, d)).select(F.col("record").alias("block_id"), "group_id")


def p1_splits(spark: SparkSession, d: str) -> DataFrame:
    """(block_id, group_id, split) of every block id of blocks, nodes_fixed and edges; weights are node rows."""
    count = lambda t, one: table(spark, d, t).filter("block_id is not null").groupBy("block_id").agg((F.count(F.lit(1)) * one).alias("w"))
    every = count("nodes_fixed", 1).unionByName(count("blocks", 0)).unionByName(count("edges", 0))
    records = every.groupBy(F.col("block_id").alias("record")).agg(F.sum("w").alias("weight"))
    return components.assign_splits(records, components.groups_of(block_ties(spark, d)), SHARES).withColumnRenamed("record", "block_id")


def typed_values(spark: SparkSession, d: str) -> DataFrame:
    services, blocks = table(spark, d, "services"), table(spark, d, "blocks")
    return services.select(F.lit("services").alias("src"), F.col("service_id").alias("rec_id"), F.lit("service").alias("kind"), F.col("service_type_name").alias("value")).unionByName(
        blocks.select(F.lit("blocks").alias("src"), F.col("block_id").alias("rec_id"), F.lit("zone").alias("kind"), F.col("functional_zone_type_name").alias("value"))
    )


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.canonical(typed_values(spark, d), table(spark, d, "canon_names")).select("src", "rec_id", "canon_id").distinct()


def p2_misses(spark: SparkSession, d: str) -> DataFrame:
    """(src, value, n): values that mean no entry."""
    found = canonical.canonical(typed_values(spark, d), table(spark, d, "canon_names"))
    return found.filter("canon_id = -1").groupBy("src", "value").agg(F.count(F.lit(1)).alias("n"))


def measure_counts(spark: SparkSession, d: str) -> DataFrame:
    """The percentile state of a_i and living_area of nodes and scale_l of blocks, by blocks.zone."""
    blocks, nodes = table(spark, d, "blocks"), table(spark, d, "nodes_fixed")
    zones = blocks.filter("block_id is not null").groupBy("block_id").agg(F.max(F.struct("loaded_at", "zone")).alias("r")).select("block_id", "r.zone")
    salted = zones.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = nodes.select("block_id", "a_i", "living_area", F.pmod(F.hash("slot_id", "loaded_at"), F.lit(SALTS)).alias("salt"))
    joined = rows.join(salted, ["block_id", "salt"], "left")
    return percentiles.merge(
        percentiles.value_counts(joined, ["a_i", "living_area"], F.col("zone")), percentiles.value_counts(blocks, ["scale_l"], F.col("zone"))
    )


def p7_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return percentiles.percentiles(measure_counts(spark, d)).withColumnRenamed("grp", "zone")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encode(table(spark, d, "documents"), vocabulary())


def p8_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, n_tokens, same): the decoded ids against the text."""
    documents = table(spark, d, "documents").select("doc_id", "text")
    ids = encoding.encode(documents.withColumn("key", F.struct("doc_id", "text")), vocabulary(), key="key")
    back = encoding.decode(ids.withColumn("key", F.struct("key.doc_id", F.col("key.text").alias("text"), F.size("ids").alias("n"))), vocabulary(), key="key")
    return back.select("key.doc_id", F.col("key.n").alias("n_tokens"), (F.coalesce("key.text", F.lit("")) == F.col("text")).alias("same"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces.split(table(spark, d, "documents"), vocabulary())


QUERIES = {f.__name__: f for f in (
    p1_found, p1_splits, p2_found, p2_misses, p7_percentiles, p8_ids, p8_round_trip, p9_found, p10_pieces
)}

_TIES = """
WITH RECURSIVE ties AS (
  SELECT DISTINCT 'b:' || building_id AS token, block_id FROM nodes_fixed
  WHERE block_id IS NOT NULL AND building_id IN (SELECT building_id FROM buildings WHERE building_id IS NOT NULL)
  UNION SELECT 'm:' || mask_path, block_id FROM blocks WHERE mask_path IS NOT NULL AND block_id IS NOT NULL
),
edges2 AS (SELECT DISTINCT a.block_id AS x, b.block_id AS y FROM ties a JOIN ties b USING (token) WHERE a.block_id <> b.block_id),
reach(x, y) AS (SELECT x, y FROM edges2 UNION SELECT r.x, e.y FROM reach r JOIN edges2 e ON r.y = e.x),
tied AS (SELECT x AS block_id, least(x, min(y)) AS group_id FROM reach GROUP BY x)
"""

P1_FOUND = _TIES + "SELECT * FROM tied"

P1_SPLITS = (
    _TIES + """,
ids AS (SELECT block_id FROM blocks UNION SELECT block_id FROM nodes_fixed UNION SELECT block_id FROM edges),
every AS (SELECT block_id, coalesce(group_id, block_id) AS group_id FROM ids LEFT JOIN tied USING (block_id) WHERE block_id IS NOT NULL),
scores AS (
  SELECT *, -share / ln((CAST('0x' || substr(md5('0|' || split || '|' || group_id), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0) AS score
  FROM every, (VALUES ('train', 0.8), ('validation', 0.1), ('test', 0.1)) s(split, share)
)
SELECT block_id, group_id, arg_max(split, score) AS split FROM scores GROUP BY ALL
"""
)

P7 = """
WITH zones AS (SELECT block_id, arg_max({'z': zone}, (loaded_at, zone)).z AS zone FROM blocks WHERE block_id IS NOT NULL GROUP BY block_id),
v AS (
  SELECT 'a_i' AS measure, zone, a_i AS value FROM nodes_fixed LEFT JOIN zones USING (block_id)
  UNION ALL SELECT 'living_area', zone, living_area FROM nodes_fixed LEFT JOIN zones USING (block_id)
  UNION ALL SELECT 'scale_l', zone, scale_l FROM blocks
),
r AS (
  SELECT measure, zone, value, row_number() OVER (PARTITION BY measure, zone ORDER BY value) AS rk, count(*) OVER (PARTITION BY measure, zone) AS n
  FROM v WHERE value IS NOT NULL AND NOT isnan(value)
)
SELECT measure, zone, percentile, value, n
FROM r, (SELECT unnest([50, 90, 99])::INTEGER AS percentile) WHERE rk = (percentile * n + 99) // 100
"""

SQL: dict[str, str] = {"p1_found": P1_FOUND, "p1_splits": P1_SPLITS, "p7_percentiles": P7}
