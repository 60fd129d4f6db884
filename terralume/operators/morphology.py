"""Binary morphology and connected components on sparse masks (one row for each set pixel: r, c)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Scratch
from .components import components
from .quantiles import quantiles

#: Side of the squares that one task works on.
BLOCK = 512
_SHIFT = 31


def _squares(mask: DataFrame, halo: int = 0) -> DataFrame:
    """r, c, br, bc: each pixel with its square and every square that it is within ``halo`` of."""
    at = lambda k: F.sequence(F.floor((F.col(k) - halo) / BLOCK), F.floor((F.col(k) + halo) / BLOCK))
    keyed = mask.select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"))
    if not halo:
        return keyed.withColumns({"br": F.floor(F.col("r") / BLOCK), "bc": F.floor(F.col("c") / BLOCK)})
    return keyed.withColumn("br", F.explode(at("r"))).withColumn("bc", F.explode(at("c")))


def _reshaped(pdf: pd.DataFrame, block: int, shrink: int, grow: int, height: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(r, c) of one square's own pixels after ``shrink`` erosions and ``grow`` dilations.

    The array holds the square, a halo as wide as the steps and a frame that stays unset: what is wrong at
    the frame moves in by one pixel a step and does not reach the square.
    """
    halo = shrink + grow
    r0, c0 = int(pdf["br"].iat[0]) * block - halo, int(pdf["bc"].iat[0]) * block - halo
    side = block + 2 * halo
    on = np.zeros((side + 2, side + 2), bool)
    on[pdf["r"].to_numpy() - r0 + 1, pdf["c"].to_numpy() - c0 + 1] = True
    mid, up, down, left, right = on[1:-1, 1:-1], on[:-2, 1:-1], on[2:, 1:-1], on[1:-1, :-2], on[1:-1, 2:]
    for _ in range(shrink):
        mid[:] = mid & up & down & left & right
    inside = np.zeros((side, side), bool)
    inside[max(0, -r0) : max(0, height - r0), max(0, -c0) : max(0, width - c0)] = True
    for _ in range(grow):
        mid[:] = (mid | up | down | left | right) & inside
    r, c = np.nonzero(mid[halo : halo + block, halo : halo + block])
    return r + r0 + halo, c + c0 + halo


def _steps(mask: DataFrame, shrink: int, grow: int, height: int = 0, width: int = 0) -> DataFrame:
    """One shuffle for all steps: a square and its halo are worked on in one task."""
    block = BLOCK

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        r, c = _reshaped(pdf, block, shrink, grow, height, width)
        return pd.DataFrame({"r": r, "c": c})

    out = _squares(mask, shrink + grow).groupBy("br", "bc").applyInPandas(work, "r long, c long")
    return out.select(*[F.col(k).cast(mask.schema[k].dataType).alias(k) for k in ("r", "c")])


def erode(mask: DataFrame, iterations: int = 1) -> DataFrame:
    """Pixels whose four neighbours are all set; outside the grid counts as unset."""
    return _steps(mask, iterations, 0) if iterations else mask


def dilate(mask: DataFrame, height: int, width: int, iterations: int = 1) -> DataFrame:
    """Pixels of the grid that are set or have one of their four neighbours set."""
    return _steps(mask, 0, iterations, height, width) if iterations else mask


def opening(mask: DataFrame, height: int, width: int, iterations: int = 1) -> DataFrame:
    """Erosions, then as many dilations."""
    return _steps(mask, iterations, iterations, height, width) if iterations else mask


def _label_block(r: np.ndarray, c: np.ndarray) -> pd.DataFrame:
    """The smallest pixel id of each pixel's component inside one square."""
    if not len(r):
        return pd.DataFrame({"r": r, "c": c, "local": np.empty(0, np.int64)})
    r0, c0 = r.min(), c.min()
    ids = (r.astype(np.int64) << _SHIFT) | c
    far = np.iinfo(np.int64).max
    lab = np.full((r.max() - r0 + 3, c.max() - c0 + 3), far)
    at = (r - r0 + 1, c - c0 + 1)
    lab[at] = ids
    on = np.zeros(lab.shape, bool)
    on[at] = True
    while True:
        before = lab[at]
        # sweep runs along rows and columns: a label crosses a whole run in one step
        for axis in (0, 1):
            for flip in (False, True):
                m = np.flip(lab, axis) if flip else lab
                k = np.flip(on, axis) if flip else on
                for i in range(1, m.shape[axis]):
                    here, prev = (m[i], m[i - 1]) if axis == 0 else (m[:, i], m[:, i - 1])
                    ok = (k[i] & k[i - 1]) if axis == 0 else (k[:, i] & k[:, i - 1])
                    np.minimum(here, prev, out=here, where=ok)
        if (lab[at] == before).all():
            break
    return pd.DataFrame({"r": r, "c": c, "local": lab[at]})


def label_components(mask: DataFrame) -> DataFrame:
    """r, c, comp: the smallest pixel id (r * 2^31 + c) of each 4-connected component.

    Squares are labelled alone; only pixels on their seams are joined, and only the labels that touch
    there go through the distributed components.
    """
    return opened_components(mask, 0, 0, 0)


def opened_components(mask: DataFrame, height: int, width: int, iterations: int = 1) -> DataFrame:
    """``label_components`` of the opening: squares are opened and labelled in one task, after one shuffle."""
    scratch, block = Scratch(mask.sparkSession), BLOCK

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        return _label_block(*_reshaped(pdf, block, iterations, iterations, height, width))

    squares = _squares(mask, 2 * iterations).groupBy("br", "bc")
    local = scratch.put(squares.applyInPandas(work, "r long, c long, local long"))
    edge = lambda k, at: local.filter(F.col(k) % BLOCK == at)
    low, high = edge("r", BLOCK - 1).select((F.col("r") + 1).alias("r"), "c", F.col("local").alias("a")), edge("r", 0).select("r", "c", F.col("local").alias("b"))
    left, right = edge("c", BLOCK - 1).select("r", (F.col("c") + 1).alias("c"), F.col("local").alias("a")), edge("c", 0).select("r", "c", F.col("local").alias("b"))
    seams = scratch.put(low.join(high, ["r", "c"]).select("a", "b").unionByName(left.join(right, ["r", "c"]).select("a", "b")))
    if seams.isEmpty():
        return local.withColumnRenamed("local", "comp")
    roots = components(seams, scratch)
    return local.join(roots, F.col("local") == F.col("node"), "left").select("r", "c", F.coalesce("root", "local").alias("comp"))


def drop_small(labelled: DataFrame, min_area: int) -> DataFrame:
    """Pixels of components of at least ``min_area`` pixels."""
    if min_area <= 1:
        return labelled
    big = labelled.groupBy("comp").agg(F.count(F.lit(1)).alias("area")).filter(F.col("area") >= min_area)
    return labelled.join(big.select("comp"), "comp", "left_semi")


def clean(mask: DataFrame, height: int, width: int, min_area: int, iterations: int = 1) -> DataFrame:
    """Opening, then removal of small components."""
    if min_area <= 1:
        return opening(mask, height, width, iterations)
    return drop_small(opened_components(mask, height, width, iterations), min_area).select("r", "c")


def suppress_low_green(labelled: DataFrame, green: DataFrame, threshold: float = 0.04, min_area: int = 40) -> DataFrame:
    """Without components that are large and whose median greenness is low (missing greenness is -1)."""
    large = labelled.groupBy("comp").agg(F.count(F.lit(1)).alias("area")).filter(F.col("area") >= min_area).select("comp")
    seen = labelled.join(large, "comp", "left_semi").join(green.select("r", "c", "exg"), ["r", "c"], "left").select("comp", F.coalesce("exg", F.lit(-1.0)).alias("exg"))
    roofs = quantiles(seen, "exg", {"mid": 0.5}, ["comp"]).filter(F.col("mid") < threshold)
    return labelled.join(roofs.select("comp"), "comp", "left_anti")


def burn_boxes(boxes: DataFrame, left: float, top: float, res: float, height: int, width: int, buffer: float = 0.0) -> DataFrame:
    """Pixels touched by buffered boxes (x0, y0, x1, y1): the buffer is round at the corners."""
    grown = boxes.filter("x0 IS NOT NULL AND y0 IS NOT NULL AND x1 IS NOT NULL AND y1 IS NOT NULL")
    span = lambda a, b, n: F.sequence(F.greatest(F.lit(0), F.floor(a).cast("int")), F.least(F.lit(n - 1), F.greatest(F.floor(a), F.ceil(b) - 1).cast("int")))
    held = lambda a, b, n: F.when((F.ceil(b) > 0) & (F.floor(a) < n), span(a, b, n)).otherwise(F.array().cast("array<int>"))
    cols = held((F.col("x0") - buffer - left) / res, (F.col("x1") + buffer - left) / res, width)
    rows = held((top - F.col("y1") - buffer) / res, (top - F.col("y0") + buffer) / res, height)
    px = grown.withColumn("r", F.explode(rows)).withColumn("c", F.explode(cols))
    if buffer > 0:  # the pixel square against the box
        gap = lambda lo, hi, a, b: F.greatest(F.lit(0.0), lo - b, a - hi)
        dx = gap(left + F.col("c") * res, left + (F.col("c") + 1) * res, F.col("x0"), F.col("x1"))
        dy = gap(top - (F.col("r") + 1) * res, top - F.col("r") * res, F.col("y0"), F.col("y1"))
        px = px.filter(dx * dx + dy * dy <= buffer * buffer)
    return px.select("r", "c").distinct()


def burn_polygons(polygons: DataFrame, left: float, top: float, res: float, height: int, width: int, buffer: float = 0.0) -> DataFrame:
    """Pixels touched by buffered polygons (id, ring: array of struct(x, y), closed or not)."""

    def touched(batches):
        for pdf in batches:
            out = []
            for ring in pdf["ring"]:
                pts = np.array([(p["x"], p["y"]) for p in ring], float) if ring is not None and len(ring) > 2 else np.empty((0, 2))
                if len(pts):
                    out.append(_touched(pts, left, top, res, height, width, buffer))
            rc = np.concatenate(out) if out else np.empty((0, 2), np.int64)
            yield pd.DataFrame({"r": rc[:, 0].astype(np.int32), "c": rc[:, 1].astype(np.int32)})

    return polygons.select("ring").mapInPandas(touched, "r int, c int").distinct()


def _touched(pts: np.ndarray, left: float, top: float, res: float, height: int, width: int, buffer: float) -> np.ndarray:
    """(r, c) of the pixel squares within ``buffer`` of the polygon, inside included."""
    p = np.stack([(pts[:, 0] - left) / res, (top - pts[:, 1]) / res], 1)
    b = buffer / res
    c0, r0 = np.maximum(np.floor(p.min(0) - b).astype(int), 0)
    c1, r1 = np.minimum(np.ceil(p.max(0) + b).astype(int), (width, height))
    if c1 <= c0 or r1 <= r0:
        return np.empty((0, 2), np.int64)
    cc, rr = np.meshgrid(np.arange(c0, c1), np.arange(r0, r1))
    q = np.roll(p, -1, 0)
    mid_x, mid_y = cc + 0.5, rr + 0.5
    inside = np.zeros(cc.shape, bool)
    near = np.full(cc.shape, np.inf)
    for (x0, y0), (x1, y1) in zip(p, q):
        if y0 != y1:
            crosses = (y0 > mid_y) != (y1 > mid_y)
            inside ^= crosses & (mid_x < (x1 - x0) * (mid_y - y0) / (y1 - y0) + x0)
        near = np.minimum(near, _segment_to_square(x0, y0, x1, y1, cc, rr))
    hit = inside | (near <= b + 1e-12)
    return np.stack([rr[hit], cc[hit]], 1)


def _segment_to_square(x0, y0, x1, y1, cc, rr) -> np.ndarray:
    """Distance of a segment to unit squares: 0 where it enters, else from ends and corners."""
    dx, dy = x1 - x0, y1 - y0
    t0, t1 = np.zeros(cc.shape), np.ones(cc.shape)
    open_ = np.ones(cc.shape, bool)
    for d, s, low in ((dx, x0, cc), (dy, y0, rr)):
        if d == 0:
            open_ &= (s >= low) & (s <= low + 1)
        else:
            a, b = (low - s) / d, (low + 1 - s) / d
            t0, t1 = np.maximum(t0, np.minimum(a, b)), np.minimum(t1, np.maximum(a, b))
    enters = open_ & (t0 <= t1)
    best = np.full(cc.shape, np.inf)
    for x, y in ((x0, y0), (x1, y1)):
        best = np.minimum(best, np.hypot(np.maximum(0, np.maximum(cc - x, x - cc - 1)), np.maximum(0, np.maximum(rr - y, y - rr - 1))))
    length = dx * dx + dy * dy
    for ox in (0, 1):
        for oy in (0, 1):
            t = np.clip(((cc + ox - x0) * dx + (rr + oy - y0) * dy) / length, 0, 1) if length else 0.0
            best = np.minimum(best, np.hypot(cc + ox - x0 - t * dx, rr + oy - y0 - t * dy))
    return np.where(enters, 0.0, best)
