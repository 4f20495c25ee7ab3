"""Tables that arrive as files, taken in micro-batches with additive state.

Each result is a sum over rows, so the state after all batches equals the batch result. Batches
are written under their number, so a batch that is run again after a failure replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from blockloom.operators import stats


def arriving(spark: SparkSession, folder: str, schema: StructType, files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(folder)


def running_service_totals(nodes: DataFrame, checkpoint: str, name: str) -> StreamingQuery:
    """The totals of ``stats.service_totals`` over all files so far, as the in-memory table ``name``."""
    rows = stats.services_long(nodes, []).filter("has and is_active")
    totals = rows.groupBy("service").agg(F.count(F.lit(1)).alias("n"), F.sum("capacity").alias("capacity"))
    return totals.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def partial_states(rows: DataFrame, state: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Each batch's state under out/batch=<n>: for states that merge by summing (histograms, reference counts)."""
    def write(batch: DataFrame, n: int) -> None:
        state(batch).write.mode("overwrite").parquet(f"{out}/batch={n}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def per_block(rows: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """A block-wise operator over new blocks; the same as one batch run, as blocks do not depend on each other."""
    return partial_states(rows, work, out, checkpoint)
