"""Helpers shared by the corpus operators: table reads, size-checked broadcasts, Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import Scratch

__all__ = ["Scratch", "batch", "few_rows_a_batch", "map_batches", "partitions", "pieces", "small_side", "table", "text_bytes"]

#: One word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

#: Largest side, in bytes as estimated from its measured rows, that is sent to every executor.
BROADCAST_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(col: str = "text") -> Column:
    """The text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(col), F.lit("")).cast("binary")


def small_side(df: DataFrame, row_bytes: Column | int, cap: int | None = None) -> DataFrame:
    """Mark ``df`` for broadcast if its measured size is within ``cap`` (``BROADCAST_BYTES``); else Spark
    shuffles the join.

    ``df`` should be a scratch table: it is read once to add up ``row_bytes``.
    """
    size = F.count(F.lit(1)) * row_bytes if isinstance(row_bytes, int) else F.sum(row_bytes)
    total = df.agg(size.cast("long").alias("bytes")).first()["bytes"] or 0
    return F.broadcast(df) if total <= (BROADCAST_BYTES if cap is None else cap) else df


#: Rows, and bytes, that a batch function sees at once.
BATCH_ROWS = 1000
BATCH_BYTES = 8 << 20


def pieces(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """``b`` in slices of at most ``BATCH_ROWS`` rows and about ``BATCH_BYTES``; one row is never cut."""
    parts = max(-(-b.num_rows // BATCH_ROWS), -(-b.nbytes // BATCH_BYTES))
    step = max(1, -(-b.num_rows // max(1, parts)))
    for at in range(0, b.num_rows, step):
        yield b.slice(at, step)


def few_rows_a_batch(spark: SparkSession) -> None:
    """Text rows are wide: where the session has Spark's default, its Arrow batches get ``BATCH_ROWS`` rows,
    as the JVM holds a whole batch outside its heap.  (Spark's own limit of 64 MB a batch stays.)"""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, BATCH_ROWS)


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with per-task state: ``make()`` runs once in a task and gives the batch function."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for b in batches:
            for piece in pieces(b):
                yield fn(piece)

    few_rows_a_batch(df.sparkSession)
    return df.mapInArrow(run, schema)


def batch(schema: pa.Schema, columns: Iterable) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )
