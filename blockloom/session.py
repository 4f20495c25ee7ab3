"""Session helpers: table access, checkpoints in the shared folder, partition counts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``folder`` (a file or a directory of files)."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder of ``spark.checkpoint.dir``; own temporary folder only in single-JVM local mode."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = context.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="blockloom-checkpoint-")
    context.setCheckpointDir(path)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder; survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread_out(df: DataFrame, *keys: str) -> DataFrame:
    """The rows over all shuffle partitions: before Python work, whose cost adaptive coalescing by bytes doesn't see."""
    return df.repartition(shuffle_partitions(df.sparkSession), *keys)
