"""Slope of a dense height grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def slope(dem: DataFrame, height: int, width: int, xres: float = 1.0, yres: float = 1.0, value: str = "dem", keys: tuple[str, ...] = ()) -> DataFrame:
    """``dem`` with slope_deg: central differences inside, one-sided at the edges.

    The grid is dense: a missing height is a NULL, not a missing row.  As a central difference skips
    the middle, an invalid pixel between valid ones has a slope and its neighbours have none.
    Neighbours come by two windows, along rows and along columns; ``keys`` separates grids.
    """

    def change(along: str, across: str, last: int, res: float) -> Column:
        w = Window.partitionBy(*keys, across).orderBy(along)
        before, after, here = F.lag(value).over(w), F.lead(value).over(w), F.col(value)
        ends = F.when(F.col(along) == 0, (after - here) / res).when(F.col(along) == last, (here - before) / res)
        return ends.otherwise((after - before) / (2 * res))

    out = dem.withColumn("_dx", change("c", "r", width - 1, xres)).withColumn("_dy", change("r", "c", height - 1, yres))
    return out.withColumn("slope_deg", F.degrees(F.atan(F.sqrt(F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy"))))).drop("_dx", "_dy")
