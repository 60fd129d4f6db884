"""One grid onto another, by keys computed from pixel indices.

``scale`` is coarse pixel size / fine pixel size; ``dy, dx`` shift the coarse grid in fine pixels.
Nested grids (whole scale, no shift) need no explode: one grouped pass.  Otherwise a fine pixel goes to
the coarse cells it overlaps, with the area as weight.  Averages are over valid fine pixels that exist.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _axis(c: str, scale: float, shift: float) -> Column:
    """array of struct(cell, weight) along one axis."""
    a, b = (F.col(c) - shift) / scale, (F.col(c) + 1 - shift) / scale
    first, last = F.floor(a).cast("int"), (F.ceil(b) - 1).cast("int")
    part = lambda k: F.least(b, k + 1.0) - F.greatest(a, k.cast("double"))
    return F.transform(F.sequence(first, F.greatest(first, last)), lambda k: F.struct(k.alias("cell"), part(k).alias("w")))


def to_cells(fine: DataFrame, scale: float, dy: float = 0.0, dx: float = 0.0, row: str = "r", col: str = "c") -> DataFrame:
    """Fine pixels with coarse cell (cr, cc) and weight w."""
    if float(scale).is_integer() and not dy and not dx:
        cell = lambda c: F.floor(F.col(c) / int(scale)).cast("int")
        return fine.withColumns({"cr": cell(row), "cc": cell(col), "w": F.lit(1.0)})
    out = fine.withColumn("_y", F.explode(_axis(row, scale, dy))).withColumn("_x", F.explode(_axis(col, scale, dx)))
    return out.withColumns({"cr": F.col("_y.cell"), "cc": F.col("_x.cell"), "w": F.col("_y.w") * F.col("_x.w")}).drop("_y", "_x")


def average(fine: DataFrame, value: str, scale: float, dy: float = 0.0, dx: float = 0.0) -> DataFrame:
    cells = to_cells(fine, scale, dy, dx).filter(F.col(value).isNotNull())
    return cells.groupBy("cr", "cc").agg((F.sum(F.col(value) * F.col("w")) / F.sum("w")).alias(value))


def class_fractions(fine: DataFrame, scale: float, cls: str = "cls", dy: float = 0.0, dx: float = 0.0) -> DataFrame:
    """cr, cc, class, frac: all classes in one pass; absent ones have no row; class 0 fills none."""
    cells = to_cells(fine, scale, dy, dx)
    each = cells.groupBy("cr", "cc", F.col(cls).alias("cls")).agg(F.sum("w").alias("part"))
    whole = F.sum("part").over(Window.partitionBy("cr", "cc"))  # a cell has one row for each class
    return each.withColumn("frac", F.col("part") / whole).filter("cls <> 0").select("cr", "cc", "cls", "frac")


def binary_fraction(fine: DataFrame, mask: str, scale: float, dy: float = 0.0, dx: float = 0.0) -> DataFrame:
    cells = to_cells(fine, scale, dy, dx)
    hit = F.when(F.col(mask), F.col("w")).otherwise(0.0)
    return cells.groupBy("cr", "cc").agg((F.sum(hit) / F.sum("w")).alias("frac"))


def majority(fine: DataFrame, scale: float, cls: str = "cls", min_coverage: float = 0.5, dy: float = 0.0, dx: float = 0.0) -> DataFrame:
    """cr, cc, cls (largest fraction, lowest id of equals), purity, coverage; too little coverage is no data."""
    cells = to_cells(fine, scale, dy, dx)
    each = cells.groupBy("cr", "cc", F.col(cls).alias("k")).agg(F.sum("w").alias("part"))
    whole = each.groupBy("cr", "cc").agg(
        F.sum("part").alias("all"), F.sum(F.when(F.col("k") != 0, F.col("part")).otherwise(0.0)).alias("known"),
        F.max(F.when(F.col("k") != 0, F.struct("part", (-F.col("k")).alias("neg")))).alias("best"),
    )
    enough = F.col("best").isNotNull() & (F.col("known") / F.col("all") >= min_coverage)
    return whole.select(
        "cr", "cc",
        F.when(enough, -F.col("best.neg")).otherwise(0).cast("int").alias("cls"),
        F.when(enough, F.col("best.part") / F.col("known")).otherwise(0.0).alias("purity"),
        (F.col("known") / F.col("all")).alias("coverage"),
    )


def nearest(source: DataFrame, height: int, width: int, scale: float, value: str, row: str = "r", col: str = "c") -> DataFrame:
    """Each target pixel (tr, tc) takes the source pixel under its centre; ``scale`` is target / source size."""
    rows, cols = int(height / scale), int(width / scale)
    at = lambda t, n: F.least(F.floor((F.col(t) + 0.5) * scale).cast("int"), F.lit(n - 1))
    grid = source.sparkSession.range(rows * cols).select(F.expr(f"cast(id div {cols} as int)").alias("tr"), (F.col("id") % cols).cast("int").alias("tc"))
    keyed = grid.withColumns({row: at("tr", height), col: at("tc", width)})
    return keyed.join(source.select(row, col, value), [row, col], "left").select("tr", "tc", value)


def bilinear(source: DataFrame, height: int, width: int, scale: float, value: str, row: str = "r", col: str = "c") -> DataFrame:
    """Each target pixel is the weighted mean of the (up to) four source pixels around its centre."""
    rows, cols = int(height / scale), int(width / scale)
    grid = source.sparkSession.range(rows * cols).select(F.expr(f"cast(id div {cols} as int)").alias("tr"), (F.col("id") % cols).cast("int").alias("tc"))

    def around(t: str) -> Column:
        p = (F.col(t) + 0.5) * scale - 0.5
        low = F.floor(p).cast("int")
        return F.array(F.struct(low.alias("p"), (1 - (p - low)).alias("w")), F.struct((low + 1).alias("p"), (p - low).alias("w")))

    near = grid.withColumn("y", F.explode(around("tr"))).withColumn("x", F.explode(around("tc")))
    near = near.select("tr", "tc", F.col("y.p").alias(row), F.col("x.p").alias(col), (F.col("y.w") * F.col("x.w")).alias("w")).filter("w > 0")
    joined = near.join(source.filter(F.col(value).isNotNull()).select(row, col, value), [row, col])
    return joined.groupBy("tr", "tc").agg((F.sum(F.col(value) * F.col("w")) / F.sum("w")).alias(value))


def on_coarse(fine_labels: DataFrame, coarse: DataFrame, keys: Sequence[str] = ("cr", "cc")) -> DataFrame:
    return fine_labels.join(coarse, list(keys))
