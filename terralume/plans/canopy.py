"""Queries on the height grid: masks, tiles, slope, morphology, resampling, pseudo-labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classes, indices
from ..operators import grid, metrics, morphology, resample, terrain
from ..sources.scratch import Scratch
from . import pipelines
from . import views as V
from .views import r6

#: Pixels of a tile in the height queries: not whole, so tiles share rows and columns.
TILE = 7.68


def exg(spark, sf):
    return V.chm_px(spark, sf).select("r", "c", r6(F.col("exg")).alias("exg"))


def chm_nodata(spark, sf):
    px = V.chm_px(spark, sf).select("r", "c", F.coalesce("dsm", F.lit(-9999.0)).alias("dsm"), F.when(F.col("c") == 3, -9999.0).otherwise(F.col("dem")).alias("dem"))
    return px.select("r", "c", r6(indices.canopy_height("dsm", "dem", -9999.0, -9999.0)).alias("chm"), r6(indices.canopy_height_floor("dsm", "dem")).alias("chm_floor"))


def threshold_mask_2_3_5(spark, sf):
    px = V.chm_px(spark, sf)
    return px.agg(F.count("h").alias("valid"), *[F.count_if(F.coalesce(F.col("h") >= t, F.lit(False))).alias(f"m{t}") for t in (2, 3, 5)])


def labels_height_greenness(spark, sf):
    return V.chm_px(spark, sf).select("r", "c", classes.height_greenness_label("h", "exg").alias("cls"))


def labels_height_spectral(spark, sf):
    fine = V.chm_px(spark, sf).select(F.col("r").alias("y"), F.col("c").alias("x"), "h")
    nd = V.labelled(spark, sf).filter(F.col("year") == 1998).select("site", "y", "x", "ndvi", "ndwi")
    return nd.join(fine, ["y", "x"]).select("site", "y", "x", classes.height_spectral_label("h").alias("cls"))


def slope_deg(spark, sf):
    px = V.chm_px(spark, sf).select("r", "c", "dsm")
    h, w = V.dims(px)
    return terrain.slope(px, h, w, value="dsm").select("r", "c", r6(F.col("slope_deg")).alias("slope_deg"))


def _slope_tiles(spark, sf):
    px = V.chm_px(spark, sf).select("r", "c", F.col("dem").alias("z0"), "dsm")
    h, w = V.dims(px)
    return pipelines.tile_slope_stats(terrain.slope(px, h, w, value="dsm"), h, w, TILE)


def tile_slope_stats(spark, sf):
    got = _slope_tiles(spark, sf)
    return got.select("tile_id", *[r6(F.col(k)).alias(k) for k in ("mean_slope_deg", "p95_slope_deg", "max_slope_deg")], "slope_bin")


def _planes(spark, sf):
    """valid, raw, building, final without components: what tile statistics read."""
    return V.chm_px(spark, sf).select(
        "r", "c", F.col("h").isNotNull().alias("valid"), F.coalesce(F.col("h") >= 2, F.lit(False)).alias("raw"), ((F.col("r") % 11 < 4) & (F.col("c") % 13 < 5)).alias("building")
    ).withColumn("final", F.col("raw") & ~F.col("building"))


def tile_label_stats(spark, sf, planes=_planes):
    px = planes(spark, sf)
    h, w = V.dims(px)
    got = pipelines.tile_label_stats(px, h, w, TILE)
    return got.select("tile_id", "threshold_m", "valid_px", "canopy_px", r6(F.col("canopy_pct")).alias("canopy_pct"), r6(F.col("raw_canopy_pct")).alias("raw_canopy_pct"), "building_px", "removed_area_m2")


def _final_planes(spark, sf):
    """The planes of the whole clean-up, written once: tile statistics and city figures read them."""
    px = V.chm_px(spark, sf)
    got = pipelines.pseudo_labels(px.select("r", "c", "h", "exg"), *V.dims(px), boxes=_boxes(spark, sf), exg_threshold=-0.2, min_area=4, roof_exg=0.02, roof_area=12, top=40.0)
    return Scratch(spark).put(got.select("r", "c", "valid", "raw", "building", "final"))


def slope_bin_summary(spark, sf, planes=_planes):
    px = planes(spark, sf)
    h, w = V.dims(px)
    stats = pipelines.tile_label_stats(px, h, w, TILE).join(_slope_tiles(spark, sf).select("tile_id", "slope_bin"), "tile_id")
    got = pipelines.slope_summary(stats)
    return got.select("place", "slope_bin", "tile_count", r6(F.col("mean_raw_canopy_pct")).alias("mean_raw_canopy_pct"), r6(F.col("mean_final_canopy_pct")).alias("mean_final_canopy_pct"), "total_removed_area_m2")


def city_audit_summary(spark, sf, planes=_planes):
    px = planes(spark, sf)
    h, w = V.dims(px)
    got = pipelines.city_summary(px, pipelines.tile_label_stats(px, h, w, TILE))
    return got.select(*[r6(F.col(c)).alias(c) for c in got.columns])


def tile_grid(spark, sf):
    return grid.tile_grid(spark, (1000.0, 2000.0, 4300.0, 5100.0))


def block_assign(spark, sf):
    return grid.with_blocks(tile_grid(spark, sf)).select("tile_id", "block_row", "block_col", "block_id")


def block_cv_split(spark, sf):
    return grid.cv_split(grid.with_blocks(tile_grid(spark, sf))).select("tile_id", "block_id", "split")


def _boxes(spark, sf):
    s = V.read(spark, sf, "supplier")
    x0, y0 = (F.col("s_suppkey") * 7 % 50).cast("double") + F.lit(0.3), (F.col("s_suppkey") * 11 % 40).cast("double") + F.lit(0.6)
    return s.select(F.col("s_suppkey").alias("id"), x0.alias("x0"), y0.alias("y0"), (x0 + F.col("s_nationkey") % 3 + 1).alias("x1"), (y0 + F.col("s_nationkey") % 2 + 1).alias("y1"))


def building_burn(spark, sf):
    return morphology.burn_boxes(_boxes(spark, sf), 0.0, 40.0, 1.0, 40, 50)


def building_burn_buffered(spark, sf):
    """Round corners: the same pixels from the box rule and from the polygon rule."""
    boxes = _boxes(spark, sf)
    p = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    rings = boxes.select("id", F.array(p("x0", "y0"), p("x1", "y0"), p("x1", "y1"), p("x0", "y1")).alias("ring"))
    a = morphology.burn_boxes(boxes, 0.0, 40.0, 1.0, 40, 50, 1.0).withColumn("by_box", F.lit(True))
    b = morphology.burn_polygons(rings, 0.0, 40.0, 1.0, 40, 50, 1.0).withColumn("by_ring", F.lit(True))
    got = a.join(b, ["r", "c"], "full_outer")
    return got.select("r", "c", F.coalesce("by_box", F.lit(False)).alias("by_box"), F.coalesce("by_ring", F.lit(False)).alias("by_ring"))


def vector_clip(spark, sf):
    return grid.boxes_meet(_boxes(spark, sf), (10.0, 5.0, 30.0, 20.0)).select("id")


def _tall(spark, sf):
    return V.chm_px(spark, sf).filter(F.col("h") >= 2).select("r", "c")


def opening(spark, sf):
    h, w = V.dims(V.chm_px(spark, sf))
    return morphology.opening(_tall(spark, sf), h, w).select(F.col("r").cast("int"), F.col("c").cast("int"))


def components(spark, sf):
    h, w = V.dims(V.chm_px(spark, sf))
    return morphology.opened_components(_tall(spark, sf), h, w).groupBy("comp").agg(F.count(F.lit(1)).alias("area"))


def drop_small(spark, sf):
    h, w = V.dims(V.chm_px(spark, sf))
    return morphology.clean(_tall(spark, sf), h, w, 8).select("r", "c")


def roof_suppression(spark, sf):
    px = V.chm_px(spark, sf)
    h, w = V.dims(px)
    lab = morphology.opened_components(_tall(spark, sf), h, w)
    return morphology.suppress_low_green(lab, px.select("r", "c", "exg"), 0.05, 8).select("r", "c")


def pseudo_label_pipeline(spark, sf):
    got = pipelines.pseudo_labels(V.chm_px(spark, sf).select("r", "c", "h", "exg"), *V.dims(V.chm_px(spark, sf)), boxes=_boxes(spark, sf), exg_threshold=-0.2, min_area=4, roof_exg=0.02, roof_area=12, top=40.0)
    return got.select("r", "c", "valid", "raw", "building", "removed", "green", "final")


def _fine(spark, sf):
    px = V.chm_px(spark, sf)
    return px.withColumn("cls", F.when(F.col("h").isNull(), 0).otherwise(classes.height_greenness_label("h", "exg")))


def class_fraction_stack(spark, sf):
    return resample.class_fractions(_fine(spark, sf), 10).select("cr", "cc", "cls", r6(F.col("frac")).alias("frac"))


def coarse_label_purity(spark, sf):
    got = resample.majority(_fine(spark, sf), 10, min_coverage=0.97)
    return got.select("cr", "cc", "cls", r6(F.col("purity")).alias("purity"), r6(F.col("coverage")).alias("coverage"))


def canopy_fraction(spark, sf):
    fine = V.chm_px(spark, sf).withColumn("canopy", F.coalesce(F.col("h") >= 3, F.lit(False)))
    return resample.binary_fraction(fine, "canopy", 10).select("cr", "cc", r6(F.col("frac")).alias("frac"))


def resample_average(spark, sf):
    """Cells of 2.5 pixels, shifted by half a pixel: overlap areas are the weights."""
    return resample.average(V.chm_px(spark, sf), "exg", 2.5, 0.5, 0.5).select("cr", "cc", r6(F.col("exg")).alias("exg"))


def resample_nearest(spark, sf):
    px = V.chm_px(spark, sf)
    return resample.nearest(px, *V.dims(px), 2.5, "h")


def resample_bilinear(spark, sf):
    px = V.chm_px(spark, sf)
    return resample.bilinear(px, *V.dims(px), 2.5, "h").select("tr", "tc", r6(F.col("h")).alias("h"))


def bridge_report(spark, sf):
    """Fine classes on a coarse grid against the satellite's classes, on the common scheme."""
    sat = V.labelled(spark, sf).filter(F.col("year") == 1998).select("site", F.col("y").alias("cr"), F.col("x").alias("cc"), "cls")
    _, got = pipelines.bridge(_fine(spark, sf), sat, 2, keys=("site",))
    return got.select("site", r6(F.col("overall")).alias("overall"), r6(F.col("mean_iou")).alias("mean_iou"), "n")


def purity_mean(spark, sf):
    """Mean purity of the cells that have one, and the share of cells without a class."""
    got = resample.majority(_fine(spark, sf), 10, min_coverage=0.97)
    return got.select(F.avg(F.when(F.col("purity") > 0, F.col("purity"))).alias("p"), metrics.share(F.col("cls") == 0).alias("e")).select(r6(F.col("p")).alias("purity"), r6(F.col("e")).alias("empty"))


def best_window(spark, sf):
    px = V.chm_px(spark, sf).withColumn("v", F.coalesce("exg", F.lit(-9.0)))
    return grid.best_window(px, "v", 12, *V.dims(px)).select("y0", "x0", "win", r6(F.col("score")).alias("score"))


def contrast_window(spark, sf):
    px = V.chm_px(spark, sf).withColumn("v", F.when(F.coalesce("h", F.lit(0.0)) >= 3, 1.0).otherwise(0.0))
    return grid.best_window(px, "v", 12, *V.dims(px), metric="stddev").select("y0", "x0", "win", r6(F.col("score")).alias("score"))


def heightmap(spark, sf):
    """Heights sampled in the window of most contrast, clipped at the 99th percentile of the positive ones: pixels and summary."""
    px = V.chm_px(spark, sf).select("r", "c", F.coalesce("h", F.lit(0.0)).alias("h"))
    canopy = px.withColumn("v", F.when(F.col("h") >= 3, 1.0).otherwise(0.0))
    at = grid.best_window(canopy, "v", 40, *V.dims(px), metric="stddev").first()  # one row
    pts = grid.sample_points(px, 16, at["win"], at["y0"], at["x0"])
    top = pts.agg(F.coalesce(F.percentile(F.when(F.col("h") > 0, F.col("h")), F.lit(0.99)), F.lit(1.0)).alias("hi"))
    got = pts.crossJoin(F.broadcast(top))  # one row
    z = F.least(F.greatest("h", F.lit(0.0)), F.col("hi"))
    return got.select("gy", "gx", F.round(z, 2).alias("z"), (z >= 3).alias("canopy"))


def heightmap_summary(spark, sf):
    z = heightmap(spark, sf)
    return z.agg(F.min("z").alias("zmin"), F.max("z").alias("zmax"), F.round(metrics.share(F.col("canopy")), 2).alias("canopy_fraction"), F.count(F.lit(1)).alias("n"))


def decimate(spark, sf):
    px = V.chm_px(spark, sf)
    return grid.decimate(px, 10, *V.dims(px)).select("r", "c", "red", "green", "blue")


def crop_bbox(spark, sf):
    return grid.in_bbox(V.chm_px(spark, sf), (10.4, 5.2, 20.6, 19.9), 0.0, 40.0).select("r", "c")


_MASK = "tall AS (SELECT r, c FROM chm WHERE h >= 2)"
_D = "d(dr, dc) AS (VALUES (0, 0), (-1, 0), (1, 0), (0, -1), (0, 1))"
_DIM = "dim AS (SELECT max(r) AS mr, max(c) AS mc FROM chm)"


def _open(src: str, out: str) -> str:
    return f"""{out}_e AS (SELECT r, c FROM (SELECT r + dr AS r, c + dc AS c FROM {src}, d) GROUP BY ALL HAVING count(*) = 5),
{out} AS (SELECT DISTINCT r + dr AS r, c + dc AS c FROM {out}_e, d, dim WHERE r + dr BETWEEN 0 AND mr AND c + dc BETWEEN 0 AND mc)"""


def _label(src: str, out: str) -> str:
    return f"""{out}_w(r, c, l) AS (SELECT r, c, CAST(r AS BIGINT) * 2147483648 + c FROM {src} UNION SELECT m.r, m.c, w.l FROM {out}_w w, d, {src} m WHERE m.r = w.r + d.dr AND m.c = w.c + d.dc),
{out} AS (SELECT r, c, min(l) AS comp FROM {out}_w GROUP BY ALL)"""


_OPENED = f"WITH RECURSIVE {V.CHM}, {_DIM}, {_D}, {_MASK}, {_open('tall', 'o')}"
_ONE = f"""WITH {V.CHM}, {_DIM}, n AS (SELECT CAST(ceil((mr + 1) / {TILE}) AS INT) AS nr, CAST(ceil((mc + 1) / {TILE}) AS INT) AS nc FROM dim),
tl AS (SELECT printf('r%03dc%03d', i, j) AS tile_id, i, j FROM n, range(nr) a(i), range(nc) b(j)),
pt AS (SELECT chm.*, printf('r%03dc%03d', i, j) AS tile_id FROM chm, n, tl WHERE r >= floor(i * CAST({TILE} AS DOUBLE)) AND r < ceil((i + 1) * CAST({TILE} AS DOUBLE)) AND c >= floor(j * CAST({TILE} AS DOUBLE)) AND c < ceil((j + 1) * CAST({TILE} AS DOUBLE)))"""
_STATS = f"""{_ONE}, pl AS (SELECT tile_id, h IS NOT NULL AS valid, coalesce(h >= 2, false) AS raw, r % 11 < 4 AND c % 13 < 5 AS building FROM pt),
ls AS (SELECT tile_id, CAST(2 AS DOUBLE) AS threshold_m, count_if(valid) AS valid_px, count_if(valid AND raw AND NOT building) AS canopy_px,
  CASE WHEN count_if(valid) > 0 THEN count_if(valid AND raw AND NOT building) / count_if(valid) * 100 ELSE 0 END AS canopy_pct,
  CASE WHEN count_if(valid) > 0 THEN count_if(valid AND raw) / count_if(valid) * 100 ELSE 0 END AS raw_canopy_pct,
  count_if(building) AS building_px, CAST(count_if(raw AND building) AS DOUBLE) AS removed_area_m2 FROM pl GROUP BY tile_id)"""
_NO_BUILDING = "raw AND NOT building"
_SLOPE = """g AS (SELECT tile_id0.*, CASE WHEN c = 0 THEN lead(dsm) OVER ac - dsm WHEN c = mc THEN dsm - lag(dsm) OVER ac ELSE (lead(dsm) OVER ac - lag(dsm) OVER ac) / 2 END AS dx,
  CASE WHEN r = 0 THEN lead(dsm) OVER dn - dsm WHEN r = mr THEN dsm - lag(dsm) OVER dn ELSE (lead(dsm) OVER dn - lag(dsm) OVER dn) / 2 END AS dy
  FROM (SELECT r, c, dsm FROM chm) tile_id0, dim WINDOW ac AS (PARTITION BY r ORDER BY c), dn AS (PARTITION BY c ORDER BY r)),
sl AS (SELECT r, c, degrees(atan(sqrt(dx * dx + dy * dy))) AS slope_deg FROM g)"""
_TSL = f"""{_SLOPE}, ts AS (SELECT tl.tile_id, avg(slope_deg) AS m, quantile_cont(slope_deg, 0.95) AS p, max(slope_deg) AS x FROM tl LEFT JOIN pt USING (tile_id) LEFT JOIN sl ON sl.r = pt.r AND sl.c = pt.c GROUP BY tl.tile_id),
sb AS (SELECT *, CASE WHEN m IS NULL THEN 'unknown' WHEN m < 5 THEN 'flat' WHEN m < 10 THEN 'gentle' WHEN m < 20 THEN 'moderate' ELSE 'steep' END AS slope_bin FROM ts)"""
_HG = "CASE WHEN exg IS NULL THEN 0 WHEN exg >= 0 THEN CASE WHEN h >= 3 THEN 5 WHEN h >= 0.5 THEN 4 ELSE 3 END ELSE 1 END"
_FINE = f"fine AS (SELECT r, c, CAST(CASE WHEN h IS NULL THEN 0 ELSE {_HG} END AS INT) AS cls FROM chm)"
_COL = lambda c: f"CASE WHEN {c} IN (3, 4, 5) THEN 7 ELSE {c} END"


def _maj(k: int, cover: float) -> str:
    return f"""e AS (SELECT CAST(r // {k} AS INT) AS cr, CAST(c // {k} AS INT) AS cc, cls, CAST(count(*) AS DOUBLE) AS part FROM fine GROUP BY ALL),
w AS (SELECT cr, cc, sum(part) AS whole, coalesce(sum(part) FILTER (WHERE cls <> 0), 0) AS known, first(cls ORDER BY part DESC, cls) FILTER (WHERE cls <> 0) AS k, max(part) FILTER (WHERE cls <> 0) AS top FROM e GROUP BY ALL),
maj AS (SELECT cr, cc, CAST(CASE WHEN k IS NOT NULL AND known / whole >= {cover} THEN k ELSE 0 END AS INT) AS cls, CASE WHEN k IS NOT NULL AND known / whole >= {cover} THEN top / known ELSE 0 END AS purity, known / whole AS coverage FROM w)"""


_AGREE = """cm AS (SELECT site, a, b, count(*) AS n FROM ab WHERE a IN (7, 1, 2, 6) AND b IN (7, 1, 2, 6) GROUP BY ALL),
sd AS (SELECT site, k, sum(n)AS twosides FROM (SELECT site, a AS k, n FROM cm UNION ALL SELECT site, b, n FROM cm) GROUP BY ALL),
iou AS (SELECT sd.site, sd.k, coalesce(cm.n, 0) AS hit, coalesce(cm.n, 0) / (twosides - coalesce(cm.n, 0)) AS iou FROM sd LEFT JOIN cm ON cm.site = sd.site AND cm.a = sd.k AND cm.b = sd.k),
ag AS (SELECT cm.site, sum(n) FILTER (WHERE a = b) AS same, sum(n) AS n FROM cm GROUP BY cm.site)"""
_GRID = """t AS (SELECT printf('r%03dc%03d', CAST(r AS INT), CAST(c AS INT)) AS tile_id, CAST(r AS INT) AS row, CAST(c AS INT) AS col FROM range(21) a(r), range(22) b(c)),
bl AS (SELECT *, CAST(floor(row * CAST(153.6 AS DOUBLE) / 1000) AS INT) AS block_row, CAST(floor(col * CAST(153.6 AS DOUBLE) / 1000) AS INT) AS block_col FROM t),
blk AS (SELECT *, block_row || '_' || block_col AS block_id FROM bl)"""
_BOXES = "boxes AS (SELECT s_suppkey AS id, CAST(s_suppkey * 7 % 50 AS DOUBLE) + 0.3::DOUBLE AS x0, CAST(s_suppkey * 11 % 40 AS DOUBLE) + 0.6::DOUBLE AS y0, x0 + s_nationkey % 3 + 1 AS x1, y0 + s_nationkey % 2 + 1 AS y1 FROM supplier)"
_BURN = "SELECT DISTINCT CAST(r AS INT) AS r, CAST(c AS INT) AS c FROM boxes, range(40) a(r), range(50) b(c) WHERE c + 1 > x0 AND c < x1 AND 40 - r > y0 AND 40 - r - 1 < y1"


def _windows(value: str, agg: str, win: int) -> str:
    """CTEs up to ``best``: the window with the greatest score, the first of equals."""
    return f"""WITH {V.CHM}, {_DIM}, v AS (SELECT r, c, {value} AS v FROM chm), k AS (SELECT *, least({win}, mr + 1, mc + 1) AS win, greatest(1, least({win}, mr + 1, mc + 1) // 4) AS stride FROM dim),
a AS (SELECT i * stride AS y0, j * stride AS x0, win FROM k, range(2000) p(i), range(200) q(j) WHERE i * stride + win <= mr + 1 AND j * stride + win <= mc + 1),
w AS (SELECT y0, x0, win, round({agg}(v), 9) AS score FROM a JOIN v ON r >= y0 AND r < y0 + win AND c >= x0 AND c < x0 + win GROUP BY ALL),
best AS (SELECT * FROM w ORDER BY score DESC, y0, x0 LIMIT 1)"""


def _window(value: str, agg: str) -> str:
    return f"{_windows(value, agg, 12)} SELECT CAST(y0 AS INT) AS y0, CAST(x0 AS INT) AS x0, CAST(win AS INT) AS win, round(score, 6) AS score FROM best"


_TREES = "CASE WHEN h >= 3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
#: 16 x 16 points of the window of most contrast, and the height at which they are clipped.
_POINTS = f"""{_windows(_TREES, "stddev_pop", 40)}, ix AS (SELECT i, CAST(floor(i * (win - 1) / 15) AS INT) AS p, y0, x0 FROM range(16) t(i), best),
s AS (SELECT a.i AS gy, b.i AS gx, coalesce(h, 0) AS h FROM ix a, ix b JOIN chm ON chm.c = b.p + b.x0 WHERE chm.r = a.p + a.y0),
q AS (SELECT coalesce(quantile_cont(h, 0.99) FILTER (WHERE h > 0), 1) AS hi FROM s)"""


#: The whole clean-up: buildings, greenness, opening, small components, roofs.
_CLEANED = f"""{_D}, {_BOXES}, bb AS (SELECT DISTINCT CAST(r AS INT) AS r, CAST(c AS INT) AS c FROM boxes, range(2000) e(r), range(50) f(c) WHERE power(greatest(0, x0 - c - 1, c - x1), 2) + power(greatest(0, y0 - (40 - r), 39 - r - y1), 2) <= 1),
p0 AS (SELECT chm.r, chm.c, exg, coalesce(h >= 2, false) AS raw, bb.r IS NOT NULL AS building, coalesce(exg, -1) >= -0.2 AS green FROM chm LEFT JOIN bb ON bb.r = chm.r AND bb.c = chm.c),
tall AS (SELECT r, c FROM p0 WHERE raw AND NOT building AND green), {_open('tall', 'op')}, {_label('op', 'lb')},
big AS (SELECT * FROM lb WHERE comp IN (SELECT comp FROM lb GROUP BY comp HAVING count(*) >= 4)),
fin AS (SELECT r, c FROM big WHERE comp NOT IN (SELECT comp FROM big JOIN chm USING (r, c) GROUP BY comp HAVING count(*) >= 12 AND median(coalesce(exg, -1)) < 0.02)),
cl AS (SELECT p0.r, p0.c, raw, building, fin.r IS NOT NULL AS final FROM p0 LEFT JOIN fin ON fin.r = p0.r AND fin.c = p0.c)"""


def _on_cleaned(sql: str) -> str:
    """The SQL of an audit on the cleaned mask in place of the raw one without buildings."""
    rows = "coalesce(h >= 2, false) AS raw, r % 11 < 4 AND c % 13 < 5 AS building FROM "
    for src in ("pt", "chm"):
        sql = sql.replace(rows + src, f"raw, building, final FROM {src} JOIN cl USING (r, c)")
    head = f"WITH {V.CHM}, {_DIM}"
    return sql.replace(_NO_BUILDING, "final").replace(head, f"WITH RECURSIVE {V.CHM}, {_DIM}, {_CLEANED}")


QUERIES = {
    "exg": (exg, f"WITH {V.CHM} SELECT r, c, round(CASE WHEN abs(exg) < 5e-7 THEN 0 ELSE exg END, 6) AS exg FROM chm"),
    "chm_nodata": (chm_nodata, f"WITH {V.CHM} SELECT r, c, round(CASE WHEN c <> 3 THEN dsm - dem END, 6) AS chm, round(CASE WHEN c <> 3 THEN dsm - dem END, 6) AS chm_floor FROM chm"),
    "threshold_mask_2_3_5": (threshold_mask_2_3_5, f"WITH {V.CHM} SELECT count(h) AS valid, count_if(h >= 2) AS m2, count_if(h >= 3) AS m3, count_if(h >= 5) AS m5 FROM chm"),
    "labels_height_greenness": (labels_height_greenness, f"WITH {V.CHM} SELECT r, c, CAST({_HG} AS INT) AS cls FROM chm"),
    "labels_height_spectral": (labels_height_spectral, f"""WITH {V.INDEXED}, {V.CHM} SELECT site, y, x, CAST(CASE WHEN ndvi IS NULL THEN 0 WHEN ndvi < 0.45 AND ndwi >= 0.10 THEN 2 WHEN ndvi >= 0.45 THEN CASE WHEN h >= 3 THEN 5 WHEN h >= 0.5 THEN 4 ELSE 3 END WHEN ndvi >= 0.20 THEN 6 ELSE 1 END AS INT) AS cls
        FROM nd JOIN chm ON nd.y = chm.r AND nd.x = chm.c WHERE year = 1998"""),
    "slope_deg": (slope_deg, f"WITH {V.CHM}, {_DIM}, {_SLOPE} SELECT r, c, round(slope_deg, 6) AS slope_deg FROM sl"),
    "tile_slope_stats": (tile_slope_stats, f"{_ONE}, {_TSL} SELECT tile_id, round(m, 6) AS mean_slope_deg, round(p, 6) AS p95_slope_deg, round(x, 6) AS max_slope_deg, slope_bin FROM sb"),
    "tile_label_stats": (tile_label_stats, f"{_STATS} SELECT tile_id, threshold_m, valid_px, canopy_px, round(canopy_pct, 6) AS canopy_pct, round(raw_canopy_pct, 6) AS raw_canopy_pct, building_px, removed_area_m2 FROM ls"),
    "slope_bin_summary": (slope_bin_summary, f"""{_STATS}, {_TSL}, o(slope_bin, place) AS (VALUES ('flat', 0), ('gentle', 1), ('moderate', 2), ('steep', 3), ('unknown', 4))
        SELECT place, slope_bin, count(*) AS tile_count, round(avg(raw_canopy_pct), 6) AS mean_raw_canopy_pct, round(avg(canopy_pct), 6) AS mean_final_canopy_pct, sum(removed_area_m2) AS total_removed_area_m2 FROM ls JOIN sb USING (tile_id) JOIN o USING (slope_bin) GROUP BY ALL"""),
    "city_audit_summary": (city_audit_summary, f"""{_STATS}, px AS (SELECT h IS NOT NULL AS valid, coalesce(h >= 2, false) AS raw, r % 11 < 4 AND c % 13 < 5 AS building FROM chm),
        p AS (SELECT count_if(valid) / 1e6 AS valid_km2, count_if(raw AND NOT building) / 1e6 AS canopy_km2, count_if(raw AND NOT building) / nullif(count_if(valid), 0) * 100 AS canopy_pct, count_if(raw AND building) / 1e6 AS removed_km2 FROM px),
        s AS (SELECT CAST(count(*) AS DOUBLE) AS tiles, avg(canopy_pct) AS tile_mean, median(canopy_pct) AS tile_median, min(canopy_pct) AS tile_min, max(canopy_pct) AS tile_max FROM ls)
        SELECT {', '.join(f'round({c}, 6) AS {c}' for c in ('valid_km2', 'canopy_km2', 'canopy_pct', 'removed_km2', 'tiles', 'tile_mean', 'tile_median', 'tile_min', 'tile_max'))} FROM p, s"""),
    "tile_grid": (tile_grid, f"WITH {_GRID} SELECT tile_id, row, col, 1000 + col * 153.6::DOUBLE AS x0, 5100 - row * 153.6::DOUBLE - 153.6::DOUBLE AS y0, 1000 + col * 153.6::DOUBLE + 153.6::DOUBLE AS x1, 5100 - row * 153.6::DOUBLE AS y1 FROM t"),
    "block_assign": (block_assign, f"WITH {_GRID} SELECT tile_id, block_row, block_col, block_id FROM blk"),
    "block_cv_split": (block_cv_split, f"""WITH {_GRID}, b AS (SELECT block_id, row_number() OVER (ORDER BY md5('42:' || block_id), block_id) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT block_id FROM blk)),
        s AS (SELECT block_id, CASE WHEN i < round_even(n * 0.6::DOUBLE, 0) THEN 'train' WHEN i < round_even(n * 0.6::DOUBLE, 0) + round_even(n * 0.2::DOUBLE, 0) THEN 'val' ELSE 'test' END AS split FROM b),
        ts AS (SELECT blk.*, split FROM blk JOIN s USING (block_id)), test AS (SELECT row, col FROM ts WHERE split = 'test')
        SELECT tile_id, block_id, CASE WHEN split = 'train' AND EXISTS (SELECT 1 FROM test WHERE abs(test.row - ts.row) <= 1 AND abs(test.col - ts.col) <= 1) THEN 'buffer' ELSE split END AS split FROM ts"""),
    "building_burn": (building_burn, f"WITH {_BOXES} {_BURN}"),
    "building_burn_buffered": (building_burn_buffered, f"""WITH {_BOXES} SELECT DISTINCT CAST(r AS INT) AS r, CAST(c AS INT) AS c, true AS by_box, true AS by_ring FROM boxes, range(40) a(r), range(50) b(c)
        WHERE power(greatest(0, x0 - c - 1, c - x1), 2) + power(greatest(0, y0 - (40 - r), 39 - r - y1), 2) <= 1"""),
    "vector_clip": (vector_clip, f"WITH {_BOXES} SELECT id FROM boxes WHERE x1 >= 10 AND x0 <= 30 AND y1 >= 5 AND y0 <= 20"),
    "opening": (opening, f"{_OPENED} SELECT CAST(r AS INT) AS r, CAST(c AS INT) AS c FROM o"),
    "components": (components, f"{_OPENED}, {_label('o', 'l')} SELECT comp, count(*) AS area FROM l GROUP BY comp"),
    "drop_small": (drop_small, f"{_OPENED}, {_label('o', 'l')} SELECT CAST(r AS BIGINT) AS r, CAST(c AS BIGINT) AS c FROM l WHERE comp IN (SELECT comp FROM l GROUP BY comp HAVING count(*) >= 8)"),
    "roof_suppression": (roof_suppression, f"{_OPENED}, {_label('o', 'l')} SELECT CAST(r AS BIGINT) AS r, CAST(c AS BIGINT) AS c FROM l WHERE comp NOT IN (SELECT comp FROM l JOIN chm USING (r, c) GROUP BY comp HAVING count(*) >= 8 AND median(coalesce(exg, -1)) < 0.05)"),
    "pseudo_label_pipeline": (pseudo_label_pipeline, f"""WITH RECURSIVE {V.CHM}, {_DIM}, {_D}, {_BOXES}, bb AS (SELECT DISTINCT CAST(r AS INT) AS r, CAST(c AS INT) AS c FROM boxes, range(40) a(r), range(50) b(c) WHERE power(greatest(0, x0 - c - 1, c - x1), 2) + power(greatest(0, y0 - (40 - r), 39 - r - y1), 2) <= 1),
        p AS (SELECT chm.r, chm.c, exg, h IS NOT NULL AS valid, coalesce(h >= 2, false) AS raw, bb.r IS NOT NULL AS building, coalesce(exg, -1) >= -0.2 AS green FROM chm LEFT JOIN bb ON bb.r = chm.r AND bb.c = chm.c),
        q AS (SELECT *, raw AND NOT building AND green AS removed FROM p), tall AS (SELECT r, c FROM q WHERE removed), {_open('tall', 'o')}, {_label('o', 'l')},
        big AS (SELECT * FROM l WHERE comp IN (SELECT comp FROM l GROUP BY comp HAVING count(*) >= 4)),
        fin AS (SELECT r, c FROM big WHERE comp NOT IN (SELECT comp FROM big JOIN chm USING (r, c) GROUP BY comp HAVING count(*) >= 12 AND median(coalesce(exg, -1)) < 0.02))
        SELECT q.r, q.c, valid, raw, building, removed, green, fin.r IS NOT NULL AS final FROM q LEFT JOIN fin ON fin.r = q.r AND fin.c = q.c"""),
    "class_fraction_stack": (class_fraction_stack, f"WITH {V.CHM}, {_FINE}, e AS (SELECT CAST(r // 10 AS INT) AS cr, CAST(c // 10 AS INT) AS cc, cls, count(*) AS k FROM fine GROUP BY ALL) SELECT cr, cc, cls, round(frac, 6) AS frac FROM (SELECT *, k / sum(k) OVER (PARTITION BY cr, cc) AS frac FROM e) WHERE cls <> 0"),
    "coarse_label_purity": (coarse_label_purity, f"WITH {V.CHM}, {_FINE}, {_maj(10, 0.97)} SELECT cr, cc, cls, round(purity, 6) AS purity, round(coverage, 6) AS coverage FROM maj"),
    "purity_mean": (purity_mean, f"WITH {V.CHM}, {_FINE}, {_maj(10, 0.97)} SELECT round(avg(purity) FILTER (WHERE purity > 0), 6) AS purity, round(avg(CASE WHEN cls = 0 THEN 1.0 ELSE 0.0 END), 6) AS empty FROM maj"),
    "canopy_fraction": (canopy_fraction, f"WITH {V.CHM} SELECT CAST(r // 10 AS INT) AS cr, CAST(c // 10 AS INT) AS cc, round(avg(CASE WHEN h >= 3 THEN 1.0 ELSE 0.0 END), 6) AS frac FROM chm GROUP BY ALL"),
    "resample_average": (resample_average, f"""WITH {V.CHM}, {_DIM}, k AS (SELECT CAST(i - 1 AS INT) AS cr, CAST(j - 1 AS INT) AS cc FROM dim, range(2000) a(i), range(30) b(j) WHERE i <= mr),
        w AS (SELECT cr, cc, exg, (least(r + 1, cr * 2.5 + 3) - greatest(r, cr * 2.5 + 0.5)) * (least(c + 1, cc * 2.5 + 3) - greatest(c, cc * 2.5 + 0.5)) AS w FROM k JOIN chm ON r < cr * 2.5 + 3 AND r + 1 > cr * 2.5 + 0.5 AND c < cc * 2.5 + 3 AND c + 1 > cc * 2.5 + 0.5)
        SELECT cr, cc, round(sum(exg * w) / sum(w), 6) AS exg FROM w WHERE exg IS NOT NULL GROUP BY ALL"""),
    "resample_nearest": (resample_nearest, f"""WITH {V.CHM}, {_DIM}, t AS (SELECT CAST(i AS INT) AS tr, CAST(j AS INT) AS tc FROM dim, range(2000) a(i), range(20) b(j) WHERE i < floor((mr + 1) / 2.5) AND j < floor((mc + 1) / 2.5))
        SELECT tr, tc, h FROM t LEFT JOIN chm ON chm.r = floor((tr + 0.5) * 2.5) AND chm.c = floor((tc + 0.5) * 2.5)"""),
    "resample_bilinear": (resample_bilinear, f"""WITH {V.CHM}, {_DIM}, t AS (SELECT CAST(i AS INT) AS tr, CAST(j AS INT) AS tc, (i + 0.5) * 2.5 - 0.5 AS py, (j + 0.5) * 2.5 - 0.5 AS px FROM dim, range(2000) a(i), range(20) b(j) WHERE i < floor((mr + 1) / 2.5) AND j < floor((mc + 1) / 2.5)),
        w AS (SELECT tr, tc, h, (1 - abs(r - py)) * (1 - abs(c - px)) AS w FROM t JOIN chm ON abs(r - py) < 1 AND abs(c - px) < 1 WHERE h IS NOT NULL) SELECT tr, tc, round(sum(h * w) / sum(w), 6) AS h FROM w GROUP BY ALL"""),
    "bridge_report": (bridge_report, f"""WITH {V.LABELLED}, {V.CHM}, {_FINE}, {_maj(2, 0.5)}, ab AS (SELECT site, {_COL('maj.cls')} AS a, {_COL('lab.cls')} AS b FROM lab JOIN maj ON lab.y = maj.cr AND lab.x = maj.cc WHERE year = 1998), {_AGREE}
        SELECT ag.site, round(coalesce(same, 0) / n, 6) AS overall, round((SELECT avg(iou) FROM iou WHERE iou.site = ag.site), 6) AS mean_iou, CAST(n AS BIGINT) AS n FROM ag"""),
    "best_window": (best_window, _window("coalesce(exg, -9)", "avg")),
    "contrast_window": (contrast_window, _window(_TREES, "stddev_pop")),
    "heightmap": (heightmap, f"{_POINTS} SELECT CAST(gy AS INT) AS gy, CAST(gx AS INT) AS gx, round(least(greatest(h, 0), hi), 2) AS z, least(greatest(h, 0), hi) >= 3 AS canopy FROM s, q"),
    "heightmap_summary": (heightmap_summary, f"""{_POINTS} SELECT round(min(least(greatest(h, 0), hi)), 2) AS zmin, round(max(least(greatest(h, 0), hi)), 2) AS zmax,
        round(avg(CASE WHEN least(greatest(h, 0), hi) >= 3 THEN 1.0 ELSE 0.0 END), 2) AS canopy_fraction, count(*) AS n FROM s, q"""),
    "decimate": (decimate, f"WITH {V.CHM}, {_DIM} SELECT r, c, red, green, blue FROM chm, dim WHERE r % (greatest(mr + 1, mc + 1) // 10) = 0 AND c % (greatest(mr + 1, mc + 1) // 10) = 0"),
    "crop_bbox": (crop_bbox, f"WITH {V.CHM} SELECT r, c FROM chm WHERE c >= 10 AND c < 21 AND r >= 20 AND r < 35"),
}
QUERIES |= {
    f"{name}_final": (lambda spark, sf, query=query: query(spark, sf, _final_planes), _on_cleaned(QUERIES[name][1]))
    for name, query in {"tile_label_stats": tile_label_stats, "slope_bin_summary": slope_bin_summary, "city_audit_summary": city_audit_summary}.items()
}
