"""Tokens of whole corpora: each text through the streaming transducer, narrow and in bounded batches.

Defined results: null and empty texts have an empty list; marker-like strings are ordinary
text; every row of the input gives one row, repeated ids too; extra columns are ignored; an
empty table gives an empty result. One very long text is one task's work, in constant memory
but for its own text and ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm.transducer import TokenDecoder, transducer

ROWS, CHARS = 512, 4 << 20  # a batch of results: at most so many rows, ended after so many characters


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with bounded rows and text."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    start = total = 0
    for k, n in enumerate(sizes):
        total += int(n)
        if total >= CHARS or k + 1 - start >= ROWS:
            yield batch.slice(start, k + 1 - start)
            start, total = k + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def lists(rows: list[list[int]]) -> pa.Array:
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    flat = np.fromiter((t for r in rows for t in r), np.int32, int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def encode(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids ARRAY<INT>) of every row. vocabulary: path of a rank file, readable on every executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(vocabulary)
        for batch in batches:
            for part in slices(batch, "text"):
                ids = [t.encode(x) if x else [] for x in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("key"), lists(ids)], ["key", "ids"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {kind}, ids array<int>").select(F.col("key").alias(key), "ids")


def decode(df: DataFrame, vocabulary: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text) of lists of ids; null for a null list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part, texts = batch.slice(at, ROWS), []
                for row in part.column("ids"):
                    if not row.is_valid:
                        texts.append(None)
                        continue
                    machine, tokens = TokenDecoder(t), row.values.to_numpy(zero_copy_only=False)
                    texts.append("".join([machine.feed(tokens[i : i + 4096].tolist()) for i in range(0, len(tokens), 4096)]) + machine.finish())
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(texts, pa.string())], ["key", "text"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.col(ids).alias("ids"))
    return rows.mapInArrow(run, f"key {kind}, text string").select(F.col("key").alias(key), "text")
