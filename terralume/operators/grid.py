"""Tiles, blocks, splits and windows over a pixel grid."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranks import placed

TILE_M = 153.6
BLOCK_M = 1000.0


def tile_grid(spark: SparkSession, extent: Sequence[float], tile_m: float = TILE_M) -> DataFrame:
    """Tiles over (left, bottom, right, top) from the top left corner; the last ones may stick out."""
    left, bottom, right, top = extent
    cols, rows = (max(1, math.ceil(d / tile_m)) for d in (right - left, top - bottom))
    base = spark.range(rows * cols).select(F.expr(f"cast(id div {cols} as int)").alias("row"), (F.col("id") % cols).cast("int").alias("col"))
    return base.select(
        F.format_string("r%03dc%03d", "row", "col").alias("tile_id"), "row", "col",
        (left + F.col("col") * tile_m).alias("x0"), (top - F.col("row") * tile_m - tile_m).alias("y0"),
        (left + F.col("col") * tile_m + tile_m).alias("x1"), (top - F.col("row") * tile_m).alias("y1"),
    )


def with_blocks(tiles: DataFrame, block_m: float = BLOCK_M, tile_m: float = TILE_M) -> DataFrame:
    """The block of each tile, from its index, not its coordinates."""
    of = lambda c: F.floor(F.col(c) * F.lit(tile_m) / F.lit(block_m)).cast("int")
    return tiles.withColumns({"block_row": of("row"), "block_col": of("col")}).withColumn("block_id", F.concat_ws("_", F.col("block_row").cast("string"), F.col("block_col").cast("string")))


def keyed_order(seed: int, key: Column) -> Column:
    """A fixed shuffle: order by this, then by the key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))


def cv_split(tiles: DataFrame, ratios: Sequence[float] = (0.6, 0.2, 0.2), buffer_tiles: int = 1, seed: int = 42) -> DataFrame:
    """train, val and test by block; train tiles near a test tile become buffer.

    The order of blocks is by keyed hash, which any engine can repeat.
    """
    blocks = placed(tiles.select("block_id").distinct(), [keyed_order(seed, F.col("block_id")), F.col("block_id")])
    rank, n = F.col("place"), F.col("n_rows")
    n_train, n_val = F.bround(n * F.lit(ratios[0])), F.bround(n * F.lit(ratios[1]))
    split = F.when(rank < n_train, "train").when(rank < n_train + n_val, "val").otherwise("test")
    dealt = tiles.join(blocks.select("block_id", split.alias("split")), "block_id")
    if buffer_tiles <= 0:
        return dealt
    span = F.sequence(F.lit(-buffer_tiles), F.lit(buffer_tiles))
    test = dealt.filter("split = 'test'").select("row", "col")
    near = test.select(F.explode(F.transform(span, lambda d: F.col("row") + d)).alias("row"), "col")
    near = near.select("row", F.explode(F.transform(span, lambda d: F.col("col") + d)).alias("col")).distinct().withColumn("near", F.lit(True))
    joined = dealt.join(near, ["row", "col"], "left")
    return joined.withColumn("split", F.when((F.col("split") == "train") & F.col("near"), "buffer").otherwise(F.col("split"))).drop("near")


def tiles_of_axis(pixel, count, tile: float, res: float = 1.0) -> Column:
    """The tiles along one axis that a pixel meets: two where an edge cuts it."""
    p = F.col(pixel) if isinstance(pixel, str) else pixel
    first = F.floor(p * F.lit(res) / F.lit(tile)).cast("int")
    last = F.least(F.lit(count - 1), (F.ceil((p + 1) * F.lit(res) / F.lit(tile)) - 1).cast("int"))
    return F.explode(F.sequence(first, F.greatest(first, last)))


def pixels_in_tiles(pixels: DataFrame, rows: int, cols: int, tile: float, res: float = 1.0, row: str = "r", col: str = "c") -> DataFrame:
    """Each pixel with every tile that holds it: keys by arithmetic, no range join."""
    out = pixels.withColumn("tile_row", tiles_of_axis(row, rows, tile, res)).withColumn("tile_col", tiles_of_axis(col, cols, tile, res))
    return out.withColumn("tile_id", F.format_string("r%03dc%03d", "tile_row", "tile_col"))


def fixed_tiles(pixels: DataFrame, tile: int, height: int, width: int, row: str = "r", col: str = "c") -> DataFrame:
    """Whole tiles of ``tile`` pixels; a ragged edge is dropped."""
    tr, tc = F.floor(F.col(row) / tile).cast("int"), F.floor(F.col(col) / tile).cast("int")
    return pixels.withColumns({"tile_row": tr, "tile_col": tc}).filter(((F.col("tile_row") + 1) * tile <= height) & ((F.col("tile_col") + 1) * tile <= width))


def in_bbox(pixels: DataFrame, bbox: Sequence[float], left: float, top: float, res: float = 1.0, row: str = "r", col: str = "c") -> DataFrame:
    """The crop of a bounding box (x0, y0, x1, y1): floor and ceil in whole pixels."""
    x0, y0, x1, y1 = bbox
    return pixels.filter(
        (F.col(col) >= math.floor((x0 - left) / res)) & (F.col(col) < math.ceil((x1 - left) / res))
        & (F.col(row) >= math.floor((top - y1) / res)) & (F.col(row) < math.ceil((top - y0) / res))
    )


def boxes_meet(df: DataFrame, bbox: Sequence[float]) -> DataFrame:
    """Rows whose box (x0, y0, x1, y1) meets ``bbox``; a touch counts."""
    left, bottom, right, top = bbox
    return df.filter((F.col("x1") >= left) & (F.col("x0") <= right) & (F.col("y1") >= bottom) & (F.col("y0") <= top))


def extent(pixels: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    return pixels.agg(F.min(x).alias("left"), F.min(y).alias("bottom"), F.max(x).alias("right"), F.max(y).alias("top"))


def grid_warnings(a: dict, b: dict, tol: float = 1e-3) -> list[str]:
    """What keeps two grids (crs, rows, cols, left, top, res) from lying on one another."""
    out = []
    if a["crs"] != b["crs"]:
        out.append(f"crs {a['crs']} and {b['crs']} differ")
    if (a["rows"], a["cols"]) != (b["rows"], b["cols"]):
        out.append("shapes differ")
    out += [f"{k} differs" for k in ("left", "top", "res") if abs(a[k] - b[k]) > tol]
    return out


def grid_table(pixels: DataFrame, crs: str, left: float, top: float, res: float, row: str = "r", col: str = "c") -> DataFrame:
    """One row: crs, rows, cols, left, top, res of a layer whose indices start at 0."""
    size = pixels.agg((F.max(row) + 1).alias("rows"), (F.max(col) + 1).alias("cols"))
    return size.select(F.lit(crs).alias("crs"), "rows", "cols", *[F.lit(float(v)).alias(k) for k, v in (("left", left), ("top", top), ("res", res))])


def alignment(a: DataFrame, b: DataFrame, tol: float = 1e-3) -> DataFrame:
    """One row: whether two grids (``grid_table``) lie on one another, and what keeps them from it."""
    x, y = F.col("a"), F.col("b")
    apart = [("crs", x["crs"] != y["crs"]), ("shape", (x["rows"] != y["rows"]) | (x["cols"] != y["cols"]))]
    apart += [(k, F.abs(x[k] - y[k]) > tol) for k in ("left", "top", "res")]
    told = F.filter(F.array(*[F.when(off, F.lit(name)) for name, off in apart]), lambda w: w.isNotNull())
    both = a.select(F.struct("*").alias("a")).crossJoin(F.broadcast(b.select(F.struct("*").alias("b"))))  # one row each
    return both.select((F.size(told) == 0).alias("aligned"), told.alias("warnings"))


def require_crs(grid: dict, crs: str = "EPSG:2193") -> None:
    if grid["crs"] != crs:
        raise ValueError(f"grid is in {grid['crs']}, not {crs}")


def decimate(pixels: DataFrame, most: int, height: int, width: int, row: str = "r", col: str = "c") -> DataFrame:
    """Every n-th row and column, so that the longer side has about ``most`` pixels."""
    step = max(1, max(height, width) // most)
    return pixels.filter((F.col(row) % step == 0) & (F.col(col) % step == 0))


def best_window(pixels: DataFrame, value: str, win: int, height: int, width: int, metric: str = "avg", row: str = "r", col: str = "c") -> DataFrame:
    """The window (stride win // 4) with the greatest mean or spread; the first of equals.

    A pixel meets a bounded number of windows, about 16: partial sums leave each task, not pixels.
    """
    win = min(win, height, width)
    stride = max(1, win // 4)

    def anchors(c: str, size: int) -> Column:
        low = F.greatest(F.lit(0), F.ceil((F.col(c) - win + 1) / stride)).cast("int")
        high = F.least(F.lit((size - win) // stride), F.floor(F.col(c) / stride).cast("int"))
        return F.explode(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>")))

    agg = {"avg": F.avg, "stddev": F.stddev_pop}[metric]
    spread = pixels.select(anchors(row, height).alias("ay"), F.col(col), F.col(value).alias("v")).select("ay", anchors(col, width).alias("ax"), "v")
    each = spread.groupBy("ay", "ax").agg(F.round(agg("v"), 9).alias("score"))
    best = each.agg(F.max(F.struct("score", (-F.col("ay")).alias("y"), (-F.col("ax")).alias("x"))).alias("b"))
    return best.select((-F.col("b.y") * stride).cast("int").alias("y0"), (-F.col("b.x") * stride).cast("int").alias("x0"), F.lit(win).alias("win"), F.col("b.score").alias("score"))


def sample_points(pixels: DataFrame, n: int, win: int, y0: int = 0, x0: int = 0, row: str = "r", col: str = "c") -> DataFrame:
    """n x n pixels at evenly spread whole indices of a window."""
    at = [int(i * (win - 1) / (n - 1)) if n > 1 else 0 for i in range(n)]
    idx = pixels.sparkSession.createDataFrame([(i, p) for i, p in enumerate(at)], "i int, p int")  # n rows, a parameter
    ys, xs = idx.select(F.col("i").alias("gy"), (F.col("p") + y0).alias(row)), idx.select(F.col("i").alias("gx"), (F.col("p") + x0).alias(col))
    return pixels.join(F.broadcast(ys), row).join(F.broadcast(xs), col)
