"""Queries on pixel observations: indices, composites, labels, trajectories."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classes, indices
from ..operators import metrics, temporal, trajectory
from ..operators.quantiles import quantiles
from ..sources.scratch import Scratch
from . import views as V
from .views import r6


def class_area_by_site_year(spark, sf):
    lab = V.labelled(spark, sf)
    return lab.groupBy("site", "year", "cls").agg(F.count(F.lit(1)).alias("n_px"), r6(F.avg("ndvi")).alias("mean_ndvi"))


def spectral_indices(spark, sf):
    px = V.px_obs(spark, sf)
    got = px.select("site", indices.ndvi().alias("ndvi"), indices.ndwi().alias("ndwi"), indices.ndre().alias("ndre"))
    return got.groupBy("site").agg(*[r6(F.avg(k)).alias(k) for k in ("ndvi", "ndwi", "ndre")], r6(F.min("ndvi")).alias("low"), r6(F.max("ndre")).alias("high"), F.count("ndwi").alias("n"))


def harmonised_bands(spark, sf):
    hz = temporal.harmonised(V.px_obs(spark, sf), V.BANDS, cutoff=V.CUTOFF, offset=V.OFFSET)
    return hz.groupBy("site", F.year("ts").alias("year")).agg(*[F.sum(b).alias(b) for b in V.BANDS], F.min("b03").alias("low"))


def cloud_masked_counts(spark, sf):
    clear = temporal.cloud_masked(V.px_obs(spark, sf))
    return clear.groupBy("site", F.year("ts").alias("year")).agg(F.count(F.lit(1)).alias("n_clear"))


def _composite(period):
    def run(spark, sf):
        comp = V.composite(spark, sf, period)
        return comp.select(*V.KEYS, F.to_date("period_start").alias("period"), *V.BANDS)

    return run


def _composite_sql(unit):
    return f"WITH {V.composite_sql(unit)} SELECT site, y, x, CAST(period_start AS DATE) AS period, {', '.join(V.BANDS)} FROM comp"


_SCENES = """sc AS (SELECT o_orderkey FROM orders WHERE CAST(floor(o_totalprice) AS BIGINT) % 100 < 40 AND o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1998-12-31'
  AND o_custkey % 360 - 178 >= -180 AND o_custkey % 360 - 180 <= 155 AND o_orderkey % 170 - 83 >= -80 AND o_orderkey % 170 - 85 <= 80)"""


def composite_dense_calendar(spark, sf):
    ev = V.ev_obs(spark, sf).filter(F.col("event_type") == "purchase").select(F.col("pixel"), "ts", F.col("value").alias("v"))
    some = ev.withColumn("ts", F.to_timestamp(F.date_trunc("day", "ts") + F.expr("make_interval(cast(pixel % 9 as int))")))
    comp = temporal.period_median(some, ["pixel"], ["v"], "monthly")
    full = temporal.dense_periods(comp, ["pixel"], "monthly")
    return full.select("pixel", F.to_date("period_start").alias("period"), r6(F.col("v")).alias("v"))


def catalog_search(spark, sf):
    return temporal.search_scenes(_catalog(spark, sf), (100.0, -45.0, 155.0, -10.0), "1996-01-01", "1998-12-31").select("scene_id", "cloud_cover", "west", "south")


def _catalog(spark, sf):
    o = V.read(spark, sf, "orders")
    west, south = (F.col("o_custkey") % 360 - 180).cast("double"), (F.col("o_orderkey") % 170 - 85).cast("double")
    cloud = (F.floor("o_totalprice") % 100).cast("double").alias("cloud_cover")
    return o.select(F.col("o_orderkey").alias("scene_id"), F.col("o_orderdate").alias("ts"), cloud, west.alias("west"), south.alias("south"), (west + 2).alias("east"), (south + 2).alias("north"))


def fetch_composite(spark, sf):
    """The whole chain: search, load, harmonise, mask, annual medians."""
    obs = V.px_obs(spark, sf, scene=True)
    got = temporal.fetch(obs, _catalog(spark, sf), (-180.0, -80.0, 155.0, 80.0), "1995-01-01", "1998-12-31", bands=(*V.BANDS, "scl"), max_cloud=40.0, cutoff=V.CUTOFF, offset=V.OFFSET)
    return got.select("site", "y", "x", F.to_date("period_start").alias("period"), *V.BANDS)


def solar_day_mosaic(spark, sf):
    ev = V.ev_obs(spark, sf).withColumn("lon", (F.col("pixel") % 360 - 180).cast("double"))
    ev = ev.withColumn("v", F.when(F.col("event_type") != "click", F.col("value")))
    # equal times of one pixel are told apart by value: the mosaic needs one first scene
    one = ev.groupBy("pixel", "lon", "ts").agg(F.min("v").alias("v"))
    got = temporal.solar_day_mosaic(one, ["pixel", "lon"], ["v"])
    return got.select("pixel", "solar_day", r6(F.col("v")).alias("v"))


def labels_spectral(spark, sf):
    return V.labelled(spark, sf).select(*V.KEYS, "year", "cls", r6(F.col("ndvi")).alias("ndvi"))


def class_fractions(spark, sf):
    """Every class of the scheme for each site and year, absent ones with 0, over valid pixels."""
    lab = V.labelled(spark, sf).filter("cls <> 0").groupBy("site", "year")
    wide = lab.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("cls") == k).alias(name) for k, name in classes.NAMES.items()])
    return wide.select("site", "year", *[r6(F.col(name) / F.greatest("n", F.lit(1))).alias(name) for name in classes.NAMES.values()])


def reflectance_stats(spark, sf):
    px = V.px_obs(spark, sf).select("site", indices.reflectance("b08").alias("a"), indices.reflectance(F.col("b04") * 8).alias("b"))
    return px.groupBy("site").agg(r6(F.avg("a")).alias("a"), r6(F.avg("b")).alias("b"), F.max("b").alias("top"))


def time_collapse(spark, sf):
    comp = V.composite(spark, sf)
    return temporal.time_median(comp, V.KEYS, V.BANDS).select(*V.KEYS, *V.BANDS)


def edge_periods(spark, sf):
    lab = V.labelled_table(spark, sf)
    ends = temporal.edge_period(lab, ["site"]).withColumn("edge", F.lit("first")).unionByName(temporal.edge_period(lab, ["site"], last=True).withColumn("edge", F.lit("last")))
    return ends.groupBy("site", "edge").agg(F.max("year").alias("year"), F.count(F.lit(1)).alias("n"), r6(F.avg("ndvi")).alias("ndvi"))


def cleared_footprint(spark, sf):
    return trajectory.cleared_footprint(V.labelled_table(spark, sf))


def footprint_share(spark, sf):
    lab = V.labelled_table(spark, sf)
    got = trajectory.mask_share(lab, trajectory.cleared_footprint(lab))
    return got.select("site", "n_pixels", r6(F.col("share")).alias("share"))


def _series(df):
    return df.select("site", F.year("period_start").alias("year"), r6(F.col("mean_ndvi")).alias("mean_ndvi"), r6(F.col("veg_cover_frac")).alias("veg_cover_frac"))


def cover_series(spark, sf):
    return _series(trajectory.cover_series(V.labelled(spark, sf)))


def cover_series_masked(spark, sf):
    lab = V.labelled_table(spark, sf)
    return _series(trajectory.cover_series(lab, trajectory.cleared_footprint(lab)))


def _recovery(df):
    return df.select("site", F.year("period_start").alias("year"), r6(F.col("recovery_fraction")).alias("recovery_fraction"))


def recovery_q95(spark, sf):
    s = Scratch(spark).put(trajectory.cover_series(V.labelled(spark, sf)))  # a row for each site and year
    return _recovery(trajectory.with_recovery(s, trajectory.range_anchors(s)))


def _first_year(spark, sf):
    lab = V.labelled_table(spark, sf)
    s = trajectory.cover_series(lab, trajectory.cleared_footprint(lab))
    return trajectory.with_recovery(s, trajectory.first_year_anchors(s, lab))


def recovery_first_year(spark, sf):
    return _recovery(_first_year(spark, sf))


def recovery_fit(spark, sf):
    return trajectory.recovery_time(_first_year(spark, sf))


def ndvi_gain(spark, sf):
    return temporal.gain(V.labelled(spark, sf), V.KEYS, "ndvi", 1996, 2000).select(*V.KEYS, r6(F.col("gain")).alias("gain"))


def rgb_stretch(spark, sf):
    """2 and 98 per cent of each band over a year's composite, then 0 .. 255."""
    comp = Scratch(spark).put(V.composite(spark, sf).filter(F.year("period_start") == 1997).select(*V.KEYS, "b02", "b03", "b04"))
    long = comp.select(F.explode(F.array(*[F.struct(F.lit(b).alias("band"), F.col(b).alias("v")) for b in ("b02", "b03", "b04")])).alias("o")).select("o.*")
    ends = quantiles(long, "v", {"low": 0.02, "high": 0.98}, ["band"])
    cut = ends.agg(*[F.max(F.when(F.col("band") == b, F.array("low", "high"))).alias(f"q_{b}") for b in ("b02", "b03", "b04")])
    told = comp.crossJoin(F.broadcast(cut))  # one row
    return told.select(*V.KEYS, *[indices.stretch(b, F.col(f"q_{b}")[0], F.col(f"q_{b}")[1]).alias(n) for b, n in (("b04", "red"), ("b03", "green"), ("b02", "blue"))])


def colorize(spark, sf):
    lab = V.labelled(spark, sf).filter(F.col("year") == 1997)
    return lab.join(F.broadcast(classes.class_dim(spark)), "cls").groupBy("name", "red", "green", "blue").agg(F.count(F.lit(1)).alias("n"))


def tiling_min_valid(spark, sf):
    """Tiles of 8 x 8 pixels with at least 60 per cent labelled."""
    from ..operators.grid import fixed_tiles

    lab = V.labelled(spark, sf).filter(F.col("year") == 1998)
    tiles = fixed_tiles(lab, 8, 24, 24, "y", "x").groupBy("site", "tile_row", "tile_col")
    got = tiles.agg((F.count_if(F.col("cls") != 0) / F.lit(64)).alias("valid"), F.count(F.lit(1)).alias("n"))
    return got.filter(F.col("valid") >= 0.6).select("site", "tile_row", "tile_col", r6(F.col("valid")).alias("valid"), "n")


def distinct_classes(spark, sf):
    return V.labelled(spark, sf).select("site", "cls").distinct()


def structure_vs_greenness(spark, sf):
    """Of cells the satellite calls vegetated, the share without woody structure."""
    from ..operators import resample

    fine = V.chm_px(spark, sf).withColumn("canopy", F.coalesce(F.col("h") >= 3, F.lit(False)))
    frac = resample.binary_fraction(fine, "canopy", 2).withColumnRenamed("cr", "y").withColumnRenamed("cc", "x")
    nd = V.labelled(spark, sf).filter(F.col("year") == 1998).select("site", "y", "x", "ndvi")
    both = nd.join(frac, ["y", "x"]).filter("ndvi IS NOT NULL AND frac IS NOT NULL")
    green = F.count_if(F.col("ndvi") >= 0.60)
    bare = F.count_if((F.col("ndvi") >= 0.60) & (F.col("frac") < 0.20))
    return both.groupBy("site").agg(F.count(F.lit(1)).alias("n"), r6(100.0 * bare / F.greatest(green, F.lit(1))).alias("pct"))


def canopy_ndvi_corr(spark, sf):
    from ..operators import resample

    fine = V.chm_px(spark, sf).withColumn("canopy", F.coalesce(F.col("h") >= 3, F.lit(False)))
    frac = resample.binary_fraction(fine, "canopy", 2).withColumnRenamed("cr", "y").withColumnRenamed("cc", "x")
    nd = V.labelled(spark, sf).filter(F.col("year") == 1998).select("site", "y", "x", "ndvi")
    return metrics.correlation(nd.join(frac, ["y", "x"]), "frac", "ndvi", ["site"]).select("site", r6(F.col("r")).alias("r"), "n")


_I, _L = V.INDEXED, V.LABELLED
_SERIES = "s AS (SELECT site, year, avg(ndvi) AS m, CAST(count_if(ndvi >= 0.45) AS DOUBLE) / nullif(count(ndvi), 0) AS v FROM {src} GROUP BY ALL)"
_CLEARED = "cleared AS (SELECT DISTINCT site, y, x FROM nd WHERE ndvi < 0.40 AND year = (SELECT min(year) FROM nd n2 WHERE n2.site = nd.site))"
_MASKED = _CLEARED + ", held AS (SELECT nd.* FROM nd SEMI JOIN cleared USING (site, y, x)), " + _SERIES.format(src="held")
_FRAC = V.CHM + ", frac AS (SELECT r // 2 AS y, c // 2 AS x, avg(CASE WHEN h >= 3 THEN 1.0 ELSE 0.0 END) AS frac FROM chm GROUP BY ALL)"
_REC = "round(CASE WHEN m IS NOT NULL THEN least(greatest((m - bare) / (ref - bare), 0), 1) END, 6) AS recovery_fraction"

QUERIES = {
    "class_area_by_site_year": (class_area_by_site_year, f"WITH {_L} SELECT site, year, cls, count(*) AS n_px, round(avg(ndvi), 6) AS mean_ndvi FROM lab GROUP BY ALL"),
    "ndvi_ndwi_ndre": (spectral_indices, f"""WITH {V.PX}, i AS (SELECT site, (b08 - b04) / nullif(b08 + b04, 0) AS ndvi, (b03 - b08) / nullif(b03 + b08, 0) AS ndwi, (b08 - b05) / nullif(b08 + b05, 0) AS ndre FROM px)
        SELECT site, round(avg(ndvi), 6) AS ndvi, round(avg(ndwi), 6) AS ndwi, round(avg(ndre), 6) AS ndre, round(min(ndvi), 6) AS low, round(max(ndre), 6) AS high, count(ndwi) AS n FROM i GROUP BY site"""),
    "harmonised_bands": (harmonised_bands, f"WITH {V.HARMONISED} SELECT site, CAST(year(ts) AS INT) AS year, {', '.join(f'sum({b}) AS {b}' for b in V.BANDS)}, min(b03) AS low FROM hz GROUP BY ALL"),
    "cloud_masked_counts": (cloud_masked_counts, f"WITH {V.PX} SELECT site, CAST(year(ts) AS INT) AS year, count(*) AS n_clear FROM px WHERE scl IN (2, 4, 5, 6, 7) GROUP BY ALL"),
    "composite_annual": (_composite("annual"), _composite_sql("year")),
    "composite_seasonal": (_composite("seasonal"), _composite_sql("quarter")),
    "composite_monthly": (_composite("monthly"), _composite_sql("month")),
    "composite_dense_calendar": (composite_dense_calendar, """WITH e AS (SELECT user_id AS pixel, date_trunc('day', ts) + to_years(CAST(user_id % 9 AS INT)) AS ts, value AS v FROM events WHERE event_type = 'purchase'),
        m AS (SELECT pixel, CAST(date_trunc('month', ts) AS DATE) AS period, median(v) AS v FROM e GROUP BY ALL),
        spine AS (SELECT CAST(unnest(generate_series((SELECT min(period) FROM m), (SELECT max(period) FROM m), INTERVAL 1 MONTH)) AS DATE) AS period)
        SELECT p.pixel, spine.period, round(m.v, 6) AS v FROM (SELECT DISTINCT pixel FROM m) p CROSS JOIN spine LEFT JOIN m ON m.pixel = p.pixel AND m.period = spine.period"""),
    "catalog_search": (catalog_search, """WITH c AS (SELECT o_orderkey AS scene_id, o_orderdate AS ts, CAST(CAST(floor(o_totalprice) AS BIGINT) % 100 AS DOUBLE) AS cloud_cover, CAST(o_custkey % 360 - 180 AS DOUBLE) AS west, CAST(o_orderkey % 170 - 85 AS DOUBLE) AS south FROM orders)
        SELECT scene_id, cloud_cover, west, south FROM c WHERE cloud_cover < 20 AND ts BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1998-12-31' AND west + 2 >= 100 AND west <= 155 AND south + 2 >= -45 AND south <= -10"""),
    "fetch_composite": (fetch_composite, _composite_sql("year").replace("WITH ", f"WITH {_SCENES}, ", 1).replace("FROM lineitem)", "FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM sc))", 1)),
    "solar_day_mosaic": (solar_day_mosaic, """WITH e AS (SELECT user_id AS pixel, CAST(user_id % 360 - 180 AS DOUBLE) AS lon, ts, min(CASE WHEN event_type <> 'click' THEN value END) AS v FROM events GROUP BY ALL),
        d AS (SELECT pixel, ts, v, CAST(make_timestamp(CAST(epoch_us(ts) + lon * 240000000 AS BIGINT)) AS DATE) AS solar_day FROM e)
        SELECT pixel, solar_day, round(arg_min(v, ts) FILTER (WHERE v IS NOT NULL), 6) AS v FROM d GROUP BY ALL"""),
    "labels_spectral": (labels_spectral, f"WITH {_L} SELECT site, y, x, year, cls, round(ndvi, 6) AS ndvi FROM lab"),
    "class_fractions": (class_fractions, f"WITH {_L} SELECT site, year, {', '.join(f'round(count_if(cls = {k}) / greatest(count(*), 1), 6) AS {n}' for k, n in classes.NAMES.items())} FROM lab WHERE cls <> 0 GROUP BY ALL"),
    "reflectance": (reflectance_stats, f"WITH {V.PX} SELECT site, round(avg(least(greatest(b08 / 10000, 0), 1)), 6) AS a, round(avg(least(greatest(b04 * 8 / 10000, 0), 1)), 6) AS b, max(least(greatest(b04 * 8 / 10000, 0), 1)) AS top FROM px GROUP BY site"),
    "time_collapse": (time_collapse, f"WITH {V.composite_sql()} SELECT site, y, x, {', '.join(f'median({b}) AS {b}' for b in V.BANDS)} FROM comp GROUP BY ALL"),
    "edge_periods": (edge_periods, f"""WITH {_I}, m AS (SELECT *, min(year) OVER (PARTITION BY site) AS a, max(year) OVER (PARTITION BY site) AS z FROM nd)
        SELECT site, 'first' AS edge, max(year) AS year, count(*) AS n, round(avg(ndvi), 6) AS ndvi FROM m WHERE year = a GROUP BY site UNION ALL SELECT site, 'last', max(year), count(*), round(avg(ndvi), 6) FROM m WHERE year = z GROUP BY site"""),
    "cleared_footprint": (cleared_footprint, f"WITH {_I}, {_CLEARED} SELECT site, y, x FROM cleared"),
    "footprint_share": (footprint_share, f"""WITH {_I}, {_CLEARED}, px2 AS (SELECT DISTINCT site, y, x FROM nd)
        SELECT site, count(k) AS n_pixels, round(count(k) / count(*), 6) AS share FROM px2 LEFT JOIN (SELECT *, 1 AS k FROM cleared) USING (site, y, x) GROUP BY site"""),
    "cover_series": (cover_series, f"WITH {_I}, {_SERIES.format(src='nd')} SELECT site, year, round(m, 6) AS mean_ndvi, round(v, 6) AS veg_cover_frac FROM s"),
    "cover_series_masked": (cover_series_masked, f"WITH {_I}, {_MASKED} SELECT site, year, round(m, 6) AS mean_ndvi, round(v, 6) AS veg_cover_frac FROM s"),
    "recovery_q95": (recovery_q95, f"WITH {_I}, {_SERIES.format(src='nd')}, a AS (SELECT site, min(m) AS bare, quantile_cont(m, 0.95) AS ref FROM s GROUP BY site) SELECT site, year, {_REC} FROM s JOIN a USING (site)"),
    "recovery_first_year": (recovery_first_year, f"""WITH {_I}, {_MASKED}, b AS (SELECT site, arg_min(m, year) AS bare FROM s GROUP BY site),
        t AS (SELECT site, quantile_cont(ndvi, 0.90) AS ref FROM nd WHERE year = (SELECT max(year) FROM nd n2 WHERE n2.site = nd.site) GROUP BY site) SELECT site, year, {_REC} FROM s JOIN b USING (site) JOIN t USING (site)"""),
    "recovery_fit": (recovery_fit, None),
    "ndvi_gain": (ndvi_gain, f"WITH {_I} SELECT site, y, x, round(coalesce(max(ndvi) FILTER (WHERE year = 2000) - max(ndvi) FILTER (WHERE year = 1996), -9), 6) AS gain FROM nd WHERE year IN (1996, 2000) GROUP BY ALL"),
    "rgb_stretch": (rgb_stretch, f"""WITH {_I}, c AS (SELECT * FROM nd WHERE year = 1997), q AS (SELECT {', '.join(f'quantile_cont({b}, 0.02) AS l_{b}, quantile_cont({b}, 0.98) AS h_{b}' for b in ('b02', 'b03', 'b04'))} FROM c)
        SELECT site, y, x, {', '.join(f'CAST(floor(coalesce(least(greatest(({b} - l_{b}) / (h_{b} - l_{b} + 1e-9), 0), 1), 0) * 255) AS INT) AS {n}' for b, n in (('b04', 'red'), ('b03', 'green'), ('b02', 'blue')))} FROM c, q"""),
    "colorize": (colorize, f"""WITH {_L}, dim(cls, name, red, green, blue) AS (VALUES {', '.join(str((k, classes.NAMES.get(k, 'nodata'), *classes.COLOURS[k])) for k in range(8))})
        SELECT name, red, green, blue, count(*) AS n FROM lab JOIN dim USING (cls) WHERE year = 1997 GROUP BY ALL"""),
    "tiling_min_valid": (tiling_min_valid, f"WITH {_L} SELECT site, CAST(y // 8 AS INT) AS tile_row, CAST(x // 8 AS INT) AS tile_col, round(count_if(cls <> 0) / 64, 6) AS valid, count(*) AS n FROM lab WHERE year = 1998 GROUP BY ALL HAVING count_if(cls <> 0) / 64 >= 0.6"),
    "distinct_classes": (distinct_classes, f"WITH {_L} SELECT DISTINCT site, cls FROM lab"),
    "structure_vs_greenness": (structure_vs_greenness, f"""WITH {_I}, {_FRAC} SELECT site, count(*) AS n, round(100.0 * count_if(ndvi >= 0.6 AND frac < 0.2) / greatest(count_if(ndvi >= 0.6), 1), 6) AS pct FROM nd JOIN frac USING (y, x) WHERE year = 1998 AND ndvi IS NOT NULL GROUP BY site"""),
    "canopy_ndvi_corr": (canopy_ndvi_corr, f"WITH {_I}, {_FRAC} SELECT site, round(CASE WHEN count(*) > 2 THEN corr(frac, ndvi) END, 6) AS r, count(*) AS n FROM nd JOIN frac USING (y, x) WHERE year = 1998 AND ndvi IS NOT NULL GROUP BY site"),
}
