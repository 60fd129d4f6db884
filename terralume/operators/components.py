"""Connected components of an edge table.

Each task first contracts its own edges: what it read is replaced by stars (every node and the
smallest node it reaches), in chunks of ``TASK_EDGES``, so a hub or a long path that lies in one task
costs one row a node.  What is left goes through large-star and small-star rounds; as soon as at most
``TASK_EDGES`` edges remain, one task finishes them, which bounds its memory whatever the input's size.

Minima are written before they are joined, so both sides of every join are shuffled for the join alone
and adaptive execution may split a hub's rows.  The driver sees counts only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Scratch

#: Edges that one task holds at a time.
TASK_EDGES = 250_000

_EDGE = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node it reaches) for the nodes of the edges that are not the smallest themselves."""
    nodes, place = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    up = np.arange(len(nodes))
    while True:
        ra, rb = up[a], up[b]
        open_ = ra != rb
        if not open_.any():
            break
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(up, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            higher = up[up]
            if (higher == up).all():
                break
            up = higher
    below = np.flatnonzero(up != np.arange(len(nodes)))
    return nodes[below], nodes[up[below]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    count = 0

    def work() -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        u, v = stars(t.column(0).to_numpy(), t.column(1).to_numpy())
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], schema=_EDGE)

    for b in batches:
        held.append(b)
        count += b.num_rows
        if count >= TASK_EDGES:
            yield work()
            held, count = [], 0
    if count:
        yield work()


def _contracted(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").mapInArrow(_contract, "u long, v long")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, root (the smallest node of its component) for nodes of ``edges`` (a, b: long, non-null)."""
    pair = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now = scratch.put(_contracted(pair).distinct())
    while now.count() > TASK_EDGES:
        # large star: every node sends its larger neighbours to its smallest one
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = scratch.put(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        star = scratch.put(both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # small star: every node and its smaller neighbours go to the smallest of them
        least = scratch.put(star.groupBy("u").agg(F.min("v").alias("m")))
        moved = star.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = scratch.put(_contracted(moved.unionByName(least.select("u", F.col("m").alias("v")))).distinct())
        # done when the edges are stars: nobody is both above and below, and each has one above
        still = after.join(after.select(F.col("u").alias("v")).distinct(), "v", "left_semi").limit(1).count()
        many = 0 if still else after.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count()
        scratch.drop(now, low, star, least)
        now = after
        if not still and not many:
            break
    else:
        last = scratch.put(_contracted(now.coalesce(1)))
        scratch.drop(now)
        now = last
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
