"""Dataset tables: per-block trees, merged tables, orphan and timeout reports, service schemas, statistics."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.functions.columns import available, service_columns

VERSION = 1


def column_names(spark: SparkSession, path: str) -> list[str]:
    """The columns of a Parquet table, from its footers."""
    return spark.read.parquet(path).columns


def read_columns(spark: SparkSession, path: str, wanted: Sequence[str]) -> DataFrame:
    """Those wanted columns that the table has; the scan reads no others."""
    df = spark.read.parquet(path)
    return df.select(*available(df, wanted))


def write_tree(df: DataFrame, path: str, key: str = "block_id", partitions: int | None = None) -> None:
    """A Parquet folder per block; rows of a block are brought together first, a hot block in several files."""
    spread = df.repartition(*([partitions] if partitions else []), key, F.pmod(F.hash(*df.columns), F.lit(8)))
    spread.write.mode("overwrite").partitionBy(key).parquet(path)


def merge_tree(spark: SparkSession, path: str, out: str, integers: Sequence[str] = ("floors_num",)) -> DataFrame:
    """One table of a tree, unreadable files left out, these columns as integers."""
    df = spark.read.option("ignoreCorruptFiles", True).option("mergeSchema", True).option("basePath", path).parquet(path)
    df = df.withColumns({c: F.col(c).try_cast("bigint") for c in integers if c in df.columns})
    df.write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


def orphan_reports(buildings: DataFrame, blocks: DataFrame, key: str = "block_id") -> tuple[DataFrame, DataFrame]:
    """(buildings without a block, blocks without a building)."""
    return buildings.filter(F.col(key).isNull()), blocks.join(buildings.filter(F.col(key).isNotNull()), key, "left_anti")


def timeout_report(packets: DataFrame) -> DataFrame:
    """(kind, ...): the block and building rows of packets (block_id, zone, geometry, buildings ARRAY<STRUCT>)."""
    block = packets.select(F.lit("block").alias("kind"), "block_id", "zone", "geometry")
    inner = packets.select(F.lit("building").alias("kind"), "block_id", F.explode("buildings").alias("b")).select("kind", "block_id", "b.*")
    return block.unionByName(inner, allowMissingColumns=True)


def kind_counts(report: DataFrame) -> DataFrame:
    return report.agg(F.count_if(F.col("kind") == "block").alias("blocks"), F.count_if(F.col("kind") == "building").alias("buildings"))


def progress(records: DataFrame) -> DataFrame:
    """Totals of status records (status, n_buildings, n_nodes, n_edges, seconds)."""
    s = F.col("status")
    return records.agg(
        F.count_if(s == "ok").alias("ok"), F.count_if(s == "empty").alias("empty"), F.count_if(s == "timeout").alias("timeout"), F.count_if(~s.isin("ok", "empty", "timeout")).alias("other"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_buildings", "n_nodes", "n_edges")], F.avg("seconds").alias("seconds"),
    )


def schema_of(nodes: DataFrame) -> list[dict[str, str]]:
    """The services of a nodes table, from its columns."""
    return [{"name": n, "slug": n, "has_column": h, "capacity_column": c} for n, h, c in service_columns(nodes)]


def write_schema(items: list[dict[str, str]], path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"version": VERSION, "services": items}, f, ensure_ascii=False, indent=1)


def load_schema(path: str) -> list[dict[str, str]]:
    """Items with a name and both columns; others are left out."""
    with open(path, encoding="utf-8") as f:
        items = json.load(f).get("services", [])
    return [{**x, "slug": x.get("slug") or x["name"].strip().lower().replace(" ", "_")} for x in items if x.get("name") and x.get("has_column") and x.get("capacity_column")]


def json_or_path(text: str | None):
    """The document in a file of that name, else the text itself as a document, else None."""
    import os

    if not text:
        return None
    try:
        if os.path.exists(text):
            with open(text, encoding="utf-8") as f:
                return json.load(f)
        return json.loads(text)
    except (ValueError, OSError):
        return None


def merged_config(base: dict, more: dict) -> dict:
    """Nested documents key by key, everything else replaced."""
    out = dict(base)
    for k, v in more.items():
        out[k] = merged_config(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def write_statistics(report: DataFrame, path: str) -> None:
    """The long statistics table (section, name, metric, value) as CSV with a header."""
    report.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
