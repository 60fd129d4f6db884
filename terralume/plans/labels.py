"""Queries on label pairs, strata, probabilities, splits and dimensions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classes, indices
from ..operators import experiments, metrics, sampling, uncertainty
from ..sources import config, rasters, sinks
from ..sources.scratch import Scratch
from . import pipelines
from . import views as V
from .views import r6


def collapse_labels(spark, sf):
    lab = V.labelled(spark, sf).withColumn("cls2", F.when(F.col("cls") == 7, F.col("x") % 3 + 3).otherwise(F.col("cls")))
    return lab.groupBy("site", classes.collapse("cls2").alias("cls")).agg(F.count(F.lit(1)).alias("n"))


def confusion(spark, sf):
    cm = metrics.confusion(V.site_labels(spark, sf), "a", "b", classes.COMMON)
    return metrics.dense(cm, classes.COMMON)


def agreement_iou(spark, sf):
    cm = metrics.confusion(V.site_labels(spark, sf), "a", "b", classes.COMMON, ["site"])
    return metrics.agreement(cm, ["site"]).select("site", r6(F.col("overall")).alias("overall"), r6(F.col("mean_iou")).alias("mean_iou"), "n")


def class_iou(spark, sf):
    cm = metrics.confusion(V.site_labels(spark, sf), "a", "b", classes.COMMON, ["site"])
    return metrics.class_iou(cm, ["site"]).select("site", "cls", "hit", r6(F.col("iou")).alias("iou"))


def _kappa(spark, sf):
    p = V.site_labels(spark, sf)
    return metrics.kappa(p.withColumns({"a": classes.lookup("a", classes.OWN_TO_COMMON, 0), "b": classes.lookup("b", classes.OWN_TO_COMMON, 0)}), "a", "b", "site")


def kappa_site_pooled(spark, sf):
    return _kappa(spark, sf).select("site", r6(F.col("kappa")).alias("kappa"), r6(F.col("overall")).alias("overall"), "n")


def kappa_quality_toxic(spark, sf):
    t = V.read(spark, sf, "labels").select(F.lit("all").alias("site"), (F.col("quality") + 1).alias("a"), (F.col("toxic") + 1).alias("b"))
    return metrics.kappa(t, "a", "b", "site").filter("site IS NULL").select(r6(F.col("kappa")).alias("kappa"), r6(F.col("overall")).alias("overall"), "n")


def cover_crosswalk(spark, sf):
    codes = V.px_obs(spark, sf).select(((F.col("y") * 24 + F.col("x")) % 11 * 10).cast("int").alias("code"))
    return codes.groupBy("code", classes.lookup("code", classes.COVER_TO_COMMON, 0).alias("common")).agg(F.count(F.lit(1)).alias("n"))


def cover_validation(spark, sf):
    """Own classes against a stand-in land cover at the same pixels, by site and pooled."""
    lab = V.labelled(spark, sf).filter(F.col("year") == 1998)
    code = lab.select("site", "y", "x", F.when(F.col("x") % 5 == 0, 10).when(F.col("cls") == 1, 60).when(F.col("cls") == 2, 80).otherwise(30).alias("code"))
    got = pipelines.validate_cover(lab, code)
    return got.select("site", r6(F.col("kappa")).alias("kappa"), r6(F.col("overall")).alias("overall"), "n")


def training_tiles(spark, sf):
    """Tiles of 4 x 4 pixels for training, as arrays; here their sums."""
    got = pipelines.training_tiles(V.labelled(spark, sf), 24, 24, 4, ("b03", "b04", "b08"))
    total = lambda c: F.aggregate(F.transform(c, lambda v: v.cast("double")), F.lit(0.0), lambda a, v: a + v)
    return got.select("tile_id", "row", "col", F.size("image").alias("n_image"), F.round(total(F.col("image")), 4).alias("image_sum"), total(F.col("mask")).cast("long").alias("mask_sum"), r6(F.col("valid")).alias("valid"))


def validation_json(spark, sf):
    return sinks.validation_json(_kappa(spark, sf), "land cover")


def strata(spark, sf):
    got = sampling.with_strata(V.tile_stats_docs(spark, sf))
    return got.select("tile_id", "canopy_bin", "building_bin", "edge_flag", "stratum", "priority", r6(F.col("removed_ratio")).alias("removed_ratio"))


def round_robin_sample(spark, sf):
    got = sampling.round_robin(sampling.with_strata(V.tile_stats_docs(spark, sf)), 50)
    return got.select("sample_id", "tile_id", "stratum", "priority", "turn")


def softmax_conf(spark, sf):
    z = V.logits(spark, sf).withColumn("p", uncertainty.softmax("z"))
    return z.select("vec_id", "pass", uncertainty.argmax("p").alias("pred"), r6(uncertainty.confidence("p")).alias("conf"))


def pseudo_labels(spark, sf):
    z = V.logits(spark, sf).withColumn("p", uncertainty.softmax("z"))
    return z.groupBy(uncertainty.pseudo_label("p", 0.8).alias("cls")).agg(F.count(F.lit(1)).alias("n"))


def kept_fraction(spark, sf):
    z = V.logits(spark, sf).withColumn("p", uncertainty.softmax("z"))
    return uncertainty.kept_fraction(z, "p", 0.8).select(r6(F.col("kept")).alias("kept"), "n")


def mc_entropy(spark, sf):
    z = V.logits(spark, sf).withColumn("p", uncertainty.softmax("z"))
    m = uncertainty.mean_over_passes(z, ["vec_id"], "p", 4)
    return m.select("vec_id", uncertainty.argmax("p").alias("pred"), r6(uncertainty.entropy("p")).alias("entropy"))


def uncertainty_sample(spark, sf):
    """Prediction and entropy of the first six units: the limit is the feature."""
    return mc_entropy(spark, sf).orderBy("vec_id").limit(6)


def train_iou(spark, sf):
    z = V.logits(spark, sf).filter(F.col("target") != classes.IGNORE).withColumn("p", uncertainty.softmax("z"))
    cm = metrics.confusion(z.withColumn("pred", uncertainty.argmax("p")), "target", "pred", range(4))
    return metrics.class_iou(cm).select("cls", "hit", r6(F.col("iou")).alias("iou"))


def _units(spark, sf):
    return V.read(spark, sf, "embeddings").select("vec_id")


def label_efficiency_splits(spark, sf):
    got = experiments.nested_subsets(_units(spark, sf), "vec_id", (0.05, 0.1, 0.25, 1.0), (0, 1, 2))
    return got.select("seed", "fraction", "n_train", "vec_id")


def validation_split(spark, sf):
    return experiments.validation_split(_units(spark, sf), "vec_id")


def self_training_splits(spark, sf):
    return experiments.self_training_split(_units(spark, sf), "vec_id", 0.1)


def union_provenance(spark, sf):
    """Labelled and pseudo-labelled units together, with where they come from."""
    roles = self_training_splits(spark, sf)
    z = V.logits(spark, sf).filter(F.col("pass") == 0).withColumn("p", uncertainty.softmax("z")).join(roles, "vec_id")
    own = z.filter("role = 'labelled'").select("vec_id", "target", F.lit("label").alias("origin"))
    told = z.filter("role = 'unlabelled'").select("vec_id", uncertainty.pseudo_label("p", 0.5).alias("target"), F.lit("pseudo").alias("origin"))
    return own.unionByName(told)


def augment_flip(spark, sf):
    e = V.read(spark, sf, "embeddings")
    flipped = uncertainty.flip("embedding", 8, 8, False, True)
    chosen = F.expr("conv(substr(md5(cast(concat('flip:', vec_id) as binary)), 1, 4), 16, 10)").cast("int") % 2 == 0
    out = F.when(chosen, flipped).otherwise(F.col("embedding"))
    return e.select("vec_id", chosen.alias("flipped"), r6(out[0].cast("double")).alias("first"), r6(out[7].cast("double")).alias("last"))


def _train_pixels(spark, sf):
    lab = V.labelled(spark, sf).filter("ndvi IS NOT NULL")
    scaled = {b: indices.reflectance(b) for b in ("b03", "b04", "b08")}
    out = lab.withColumns(scaled).withColumns({"target": classes.train_id("cls"), "unit": F.concat_ws("_", "site", (F.col("y") / 6).cast("int"), (F.col("x") / 6).cast("int"))})
    return Scratch(spark).put(out)  # read by every model


_FEATURES, _IDS = ("b03", "b04", "b08"), (0, 1, 2, 3)
_FRACTIONS, _SEEDS, _SURE = (0.05, 0.1, 0.25, 1.0), (0, 1, 2), 0.8  # as in cli.py


def transfer_matrix(spark, sf):
    return experiments.transfer_matrix(_train_pixels(spark, sf), ("A", "N", "R"), _FEATURES, _IDS, _SEEDS)


def label_efficiency(spark, sf):
    return experiments.label_efficiency(_train_pixels(spark, sf), "unit", _FEATURES, _IDS, _FRACTIONS, _SEEDS)


def self_training(spark, sf):
    px, got = _train_pixels(spark, sf), None
    for f in _FRACTIONS:
        one = experiments.self_training(px, "unit", _FEATURES, _IDS, f, _SURE)
        got = one if got is None else got.unionByName(one)
    return got


def seed_summary(spark, sf):
    """Published scores by seed are a fixture of the tests; here: means of l_tax as seeds' scores."""
    t = V.read(spark, sf, "lineitem").select(F.col("l_returnflag").alias("site"), (F.col("l_linenumber") % 3).alias("seed"), "l_tax")
    one = t.groupBy("site", "seed").agg(r6(F.avg("l_tax")).alias("score"))
    got = metrics.seed_summary(one, "score", ["site"])
    return got.select("site", r6(F.col("score_mean")).alias("score_mean"), r6(F.col("score_std")).alias("score_std"), F.array_join(F.transform("score_seeds", lambda v: F.format_string("%.4f", v)), ",").alias("seeds"))


def quadkey(spark, sf):
    c = V.read(spark, sf, "customer")
    lon, lat = (F.col("c_custkey") * 7 % 3600 / 10 - 180).cast("double"), (F.col("c_custkey") * 11 % 1600 / 10 - 80).cast("double")
    return c.select("c_custkey", indices.quadkey(lon, lat, 9).alias("quadkey"))


def site_centroids(spark, sf):
    a = config.aoi_dim(spark)
    return a.select("name", "label", "track", F.round((F.col("west") + F.col("east")) / 2, 4).alias("lon"), F.round((F.col("south") + F.col("north")) / 2, 4).alias("lat"), F.coalesce("mineral", F.lit("")).alias("mineral"))


def subwindow(spark, sf):
    """A box of 3 km around the centre: 88 km a degree of longitude, 111 of latitude."""
    a = config.aoi_dim(spark)
    cx, cy, dx, dy = (F.col("west") + F.col("east")) / 2, (F.col("south") + F.col("north")) / 2, 1.5 / 88.0, 1.5 / 111.0
    return a.select("name", r6(cx - dx).alias("west"), r6(cy - dy).alias("south"), r6(cx + dx).alias("east"), r6(cy + dy).alias("north"))


def map_projection(spark, sf):
    c = site_centroids(spark, sf).filter("track = 'satellite'")
    p, s = indices.map_point("lon", "lat", 440, 380, (112, -44, 154, -9)), indices.sphere_point("lon", "lat")
    x, y = indices.mercator("lon", "lat")
    return c.select("name", indices.pretty_name(F.concat("name", F.lit("_rehab_trajectory"))).alias("title"), r6(p["x"]).alias("px"), r6(p["y"]).alias("py"), r6(s["x"]).alias("sx"), r6(s["y"]).alias("sy"), r6(s["z"]).alias("sz"), F.round(x, 3).alias("mx"), F.round(y, 3).alias("my"))


def transverse_mercator(spark, sf):
    """Customers dealt along the central meridian of New Zealand's grid, to that grid and back."""
    c = V.read(spark, sf, "customer")
    at = c.select("c_custkey", (171.8 + F.col("c_custkey") * 7 % 240 / 100).cast("double").alias("lon"), (-47.5 + F.col("c_custkey") * 11 % 1300 / 100).cast("double").alias("lat"))
    east, north = indices.transverse_mercator("lon", "lat", 2193)
    there = at.select("c_custkey", east.alias("e"), north.alias("n"))
    lon, lat = indices.transverse_mercator_inverse("e", "n", 2193)
    return there.select("c_custkey", F.round("e", 1).alias("easting"), F.round("n", 1).alias("northing"), F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


def layer_mosaic(spark, sf):
    """Two overlapping files of one layer: the first that has a pixel wins."""
    px = V.chm_px(spark, sf).select("r", "c", F.coalesce("h", F.lit(-1.0)).alias("value"))
    parts = px.filter("c < 30").withColumn("_file", F.lit(0)).unionByName(px.filter("c >= 20").withColumns({"value": F.col("value") + 100, "_file": F.lit(1)}))
    return rasters.mosaic(parts, ["r", "c"], "_file", ["value"])




def _aoi_values() -> str:
    q = lambda s: "NULL" if s is None else "'" + s.replace("'", "''") + "'"
    edges = lambda a: ", ".join(f"CAST({a[k]} AS DOUBLE)" for k in ("west", "south", "east", "north"))
    rows = [f"({q(a['name'])}, {q(a['track'])}, {q(a['label'])}, {edges(a)}, {q(a['mineral'] or '')})" for a in config.area_records()]
    return f"aoi(name, track, label, west, south, east, north, mineral) AS (VALUES {', '.join(rows)})"


_CM = "cm AS (SELECT {k}a, b, count(*) AS n FROM pairs WHERE a IN (7, 1, 2, 6) AND b IN (7, 1, 2, 6) GROUP BY ALL)"
_IOU = """sd AS (SELECT site, k, sum(n)AS twosides FROM (SELECT site, a AS k, n FROM cm UNION ALL SELECT site, b, n FROM cm) GROUP BY ALL),
iou AS (SELECT sd.site, CAST(sd.k AS INT) AS cls, CAST(coalesce(cm.n, 0) AS BIGINT) AS hit, coalesce(cm.n, 0) / (twosides - coalesce(cm.n, 0)) AS iou FROM sd LEFT JOIN cm ON cm.site = sd.site AND cm.a = sd.k AND cm.b = sd.k)"""
_XW = lambda c: f"CASE WHEN {c} IN (7, 6) THEN 1 WHEN {c} = 1 THEN 2 WHEN {c} = 2 THEN 3 ELSE 0 END"
_KAPPA = """g AS (SELECT coalesce(site, '*') AS site, a, b, CAST(count(*) AS DOUBLE) AS n FROM kp WHERE a >= 1 AND b >= 1 GROUP BY GROUPING SETS ((site, a, b), (a, b))),
ka AS (SELECT site, a AS k, sum(n) AS x FROM g GROUP BY ALL), kb AS (SELECT site, b AS k, sum(n) AS y FROM g GROUP BY ALL),
ke AS (SELECT ka.site, sum(x * y) AS e FROM ka JOIN kb ON ka.site = kb.site AND ka.k = kb.k GROUP BY ka.site),
kw AS (SELECT site, sum(n) AS n, coalesce(sum(n) FILTER (WHERE a = b), 0) AS same FROM g GROUP BY site),
kk AS (SELECT kw.site, same / n AS po, coalesce(e, 0) / (n * n) AS pe, n FROM kw LEFT JOIN ke ON kw.site = ke.site)"""
_TOLD = "SELECT nullif(site, '*') AS site, round((po - pe) / nullif(1 - pe, 0), 6) AS kappa, round(po, 6) AS overall, CAST(n AS BIGINT) AS n FROM kk"
_STRATA = V.TILE_DOCS + """,
st0 AS (SELECT *, CASE WHEN valid_px > 0 THEN removed_area_m2 / valid_px ELSE 0 END AS removed_ratio, CASE WHEN canopy_pct < 5 THEN 'low' WHEN canopy_pct < 20 THEN 'sparse' WHEN canopy_pct < 40 THEN 'medium' WHEN canopy_pct < 60 THEN 'high' ELSE 'park' END AS canopy_bin,
  valid_px < CAST(0.9 AS DOUBLE) * max(valid_px) OVER () AS edge_flag FROM docs),
st1 AS (SELECT *, CASE WHEN removed_ratio <= 0 THEN 'none' WHEN removed_ratio < 0.05 THEN 'low' ELSE 'high' END AS building_bin FROM st0),
st AS (SELECT *, concat_ws('|', city, canopy_bin, building_bin, slope_bin) AS stratum, CAST(CASE WHEN city = 'Wellington' AND slope_bin = 'steep' AND canopy_bin IN ('medium', 'high', 'park') THEN 0 WHEN city = 'Auckland' AND building_bin = 'high' THEN 1
  WHEN city = 'Christchurch' AND canopy_bin = 'park' THEN 2 WHEN city = 'Tauranga' AND canopy_bin IN ('high', 'park') THEN 3 WHEN canopy_bin = 'low' THEN 4 ELSE 5 END AS INT) AS priority FROM st1)"""
_ARG = "CAST(CASE greatest(p0, p1, p2, p3) WHEN p0 THEN 0 WHEN p1 THEN 1 WHEN p2 THEN 2 ELSE 3 END AS INT)"
_RANK = lambda seed, src="embeddings": f"(SELECT vec_id, row_number() OVER (ORDER BY md5('{seed}:' || vec_id), vec_id) - 1 AS place, count(*) OVER () AS n FROM {src})"
_TAKE = lambda f: f"greatest(1, CAST(round_even(n * CAST({f} AS DOUBLE), 0) AS INT))"
_MC = f"""WITH {V.LOGITS}, m AS (SELECT vec_id, avg(p0) AS p0, avg(p1) AS p1, avg(p2) AS p2, avg(p3) AS p3 FROM probs GROUP BY vec_id)
        SELECT vec_id, {_ARG} AS pred, round(-(p0 * ln(greatest(p0, 1e-8)) + p1 * ln(greatest(p1, 1e-8)) + p2 * ln(greatest(p2, 1e-8)) + p3 * ln(greatest(p3, 1e-8))) / ln(4), 6) AS entropy FROM m"""
_LL = "lon AS (SELECT c_custkey, CAST(c_custkey * 7 % 3600 AS DOUBLE) / 10 - 180 AS lon, CAST(c_custkey * 11 % 1600 AS DOUBLE) / 10 - 80 AS lat FROM customer)"
_QK = " || ".join(f"CAST(((x >> {z}) & 1) + 2 * ((y >> {z}) & 1) AS VARCHAR)" for z in range(8, -1, -1))

QUERIES = {
    "collapse_labels": (collapse_labels, f"WITH {V.LABELLED}, c AS (SELECT site, CASE WHEN cls = 7 THEN x % 3 + 3 ELSE cls END AS k FROM lab) SELECT site, CAST(CASE WHEN k IN (3, 4, 5) THEN 7 ELSE k END AS INT) AS cls, count(*) AS n FROM c GROUP BY ALL"),
    "confusion": (confusion, f"WITH {V.PAIRS}, {_CM.format(k='')}, ids(i) AS (VALUES (1), (2), (6), (7)) SELECT x.i AS a_cls, y.i AS b_cls, coalesce(n, 0) AS n FROM ids x CROSS JOIN ids y LEFT JOIN cm ON cm.a = x.i AND cm.b = y.i"),
    "agreement_iou": (agreement_iou, f"WITH {V.PAIRS}, {_CM.format(k='site, ')}, {_IOU} SELECT cm.site, round(coalesce(sum(n) FILTER (WHERE a = b), 0) / sum(n), 6) AS overall, round((SELECT avg(iou) FROM iou WHERE iou.site = cm.site), 6) AS mean_iou, CAST(sum(n) AS BIGINT) AS n FROM cm GROUP BY cm.site"),
    "class_iou": (class_iou, f"WITH {V.PAIRS}, {_CM.format(k='site, ')}, {_IOU} SELECT site, cls, hit, round(iou, 6) AS iou FROM iou"),
    "kappa_site_pooled": (kappa_site_pooled, f"WITH {V.PAIRS}, kp AS (SELECT site, {_XW('a')} AS a, {_XW('b')} AS b FROM pairs), {_KAPPA} {_TOLD}"),
    "kappa_quality_toxic": (kappa_quality_toxic, f"WITH kp AS (SELECT 'all' AS site, quality + 1 AS a, toxic + 1 AS b FROM labels), {_KAPPA} SELECT kappa, overall, n FROM ({_TOLD}) WHERE site IS NULL"),
    "cover_crosswalk": (cover_crosswalk, f"WITH {V.PX}, k AS (SELECT CAST((y * 24 + x) % 11 * 10 AS INT) AS code FROM px) SELECT code, CAST(CASE WHEN code IN (10, 20, 30, 40, 90, 95, 100) THEN 1 WHEN code IN (50, 60, 70) THEN 2 WHEN code = 80 THEN 3 ELSE 0 END AS INT) AS common, count(*) AS n FROM k GROUP BY ALL"),
    "validation_json": (validation_json, f"""WITH {V.PAIRS}, kp AS (SELECT site, {_XW('a')} AS a, {_XW('b')} AS b FROM pairs), {_KAPPA},
        d AS (SELECT site, '{{' || coalesce('"kappa":' || round((po - pe) / nullif(1 - pe, 0), 3) || ',', '') || '"overall_agreement":' || round(po, 3) || ',"n_pixels":' || CAST(n AS BIGINT) || '}}' AS doc FROM kk)
        SELECT '{{"per_site":{{' || string_agg('"' || site || '":' || doc, ',' ORDER BY site) FILTER (WHERE site <> '*') || '}},"pooled":' || max(doc) FILTER (WHERE site = '*') || ',"reference":"land cover","scheme":"vegetation/bare/water"}}' AS json FROM d"""),
    "cover_validation": (cover_validation, f"""WITH {V.LABELLED}, kp AS (SELECT site, {_XW('cls')} AS a, CASE WHEN x % 5 = 0 THEN 1 WHEN cls = 1 THEN 2 WHEN cls = 2 THEN 3 ELSE 1 END AS b FROM lab WHERE year = 1998), {_KAPPA} {_TOLD}"""),
    "training_tiles": (training_tiles, f"""WITH {V.LABELLED}, t AS (SELECT *, CAST(y // 4 AS INT) AS row, CAST(x // 4 AS INT) AS col, CASE cls WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 6 THEN 2 WHEN 7 THEN 3 ELSE 255 END AS k FROM lab)
        SELECT printf('%s_%d_%03d_%03d', site, year, row, col) AS tile_id, row, col, CAST(48 AS INT) AS n_image, round(sum({' + '.join(f'CAST(CAST(least(greatest({b} / 10000, 0), 1) AS FLOAT) AS DOUBLE)' for b in ('b03', 'b04', 'b08'))}), 4) AS image_sum,
          CAST(sum(k) AS BIGINT) AS mask_sum, round(count_if(cls <> 0) / 16, 6) AS valid FROM t GROUP BY site, year, row, col HAVING count(*) = 16 AND count_if(cls <> 0) / 16 >= 0.6"""),
    "strata": (strata, f"WITH {_STRATA} SELECT tile_id, canopy_bin, building_bin, edge_flag, stratum, priority, round(removed_ratio, 6) AS removed_ratio FROM st"),
    "round_robin_sample": (round_robin_sample, f"""WITH {_STRATA}, t AS (SELECT *, CAST(row_number() OVER (PARTITION BY stratum ORDER BY md5('42:' || tile_id), tile_id) AS INT) AS turn, min(priority) OVER (PARTITION BY stratum) AS least FROM st),
        p AS (SELECT *, row_number() OVER (ORDER BY turn, least, stratum) - 1 AS i FROM t) SELECT printf('m3_%04d', i) AS sample_id, tile_id, stratum, priority, turn FROM p WHERE i < 50"""),
    "softmax_conf": (softmax_conf, f"WITH {V.LOGITS} SELECT vec_id, pass, {_ARG} AS pred, round(greatest(p0, p1, p2, p3), 6) AS conf FROM probs"),
    "pseudo_labels": (pseudo_labels, f"WITH {V.LOGITS} SELECT CAST(CASE WHEN greatest(p0, p1, p2, p3) < 0.8 THEN 255 ELSE {_ARG} END AS INT) AS cls, count(*) AS n FROM probs GROUP BY ALL"),
    "kept_fraction": (kept_fraction, f"WITH {V.LOGITS} SELECT round(avg(CASE WHEN greatest(p0, p1, p2, p3) >= 0.8 THEN 1.0 ELSE 0.0 END), 6) AS kept, count(*) AS n FROM probs"),
    "mc_entropy": (mc_entropy, _MC),
    "uncertainty_sample": (uncertainty_sample, _MC + " ORDER BY vec_id LIMIT 6"),
    "train_iou": (train_iou, f"""WITH {V.LOGITS}, cm AS (SELECT 'x' AS site, target AS a, {_ARG} AS b, count(*) AS n FROM probs WHERE target <> 255 GROUP BY ALL), {_IOU} SELECT cls, hit, round(iou, 6) AS iou FROM iou"""),
    "label_efficiency_splits": (label_efficiency_splits, " UNION ALL ".join(f"SELECT CAST({s} AS INT) AS seed, CAST({f} AS DOUBLE) AS fraction, {_TAKE(f)} AS n_train, vec_id FROM {_RANK(s)} WHERE place < {_TAKE(f)}" for s in (0, 1, 2) for f in (0.05, 0.1, 0.25, 1.0))),
    "validation_split": (validation_split, f"SELECT vec_id, place < {_TAKE(0.2)} AS is_val FROM {_RANK(0)}"),
    "self_training_splits": (self_training_splits, f"SELECT vec_id, CASE WHEN place < {_TAKE(0.1)} THEN 'labelled' ELSE 'unlabelled' END AS role FROM {_RANK(0)}"),
    "union_provenance": (union_provenance, f"""WITH {V.LOGITS}, r AS (SELECT vec_id, place < {_TAKE(0.1)} AS own FROM {_RANK(0)}) SELECT vec_id, CASE WHEN own THEN target WHEN greatest(p0, p1, p2, p3) < 0.5 THEN 255 ELSE {_ARG} END AS target, CASE WHEN own THEN 'label' ELSE 'pseudo' END AS origin FROM probs JOIN r USING (vec_id) WHERE pass = 0"""),
    "augment_flip": (augment_flip, """WITH f AS (SELECT vec_id, embedding, CAST('0x' || substr(md5('flip:' || vec_id), 1, 4) AS BIGINT) % 2 = 0 AS flipped FROM embeddings)
        SELECT vec_id, flipped, round(CAST(embedding[CASE WHEN flipped THEN 8 ELSE 1 END] AS DOUBLE), 6) AS first, round(CAST(embedding[CASE WHEN flipped THEN 1 ELSE 8 END] AS DOUBLE), 6) AS last FROM f"""),
    "transfer_matrix": (transfer_matrix, None),
    "label_efficiency": (label_efficiency, None),
    "self_training": (self_training, None),
    "seed_summary": (seed_summary, """WITH o AS (SELECT l_returnflag AS site, l_linenumber % 3 AS seed, round(avg(l_tax), 6) AS score FROM lineitem GROUP BY ALL)
        SELECT site, round(avg(score), 6) AS score_mean, round(stddev_pop(score), 6) AS score_std, string_agg(printf('%.4f', score), ',' ORDER BY seed) AS seeds FROM o GROUP BY site"""),
    "quadkey": (quadkey, f"""WITH {_LL}, s AS (SELECT *, sin(radians(lat)) AS s FROM lon), t AS (SELECT c_custkey, CAST(least(greatest(floor((lon + 180) / 360 * 512), 0), 511) AS BIGINT) AS x, CAST(least(greatest(floor((0.5 - ln((1 + s) / (1 - s)) / (4 * pi())) * 512), 0), 511) AS BIGINT) AS y FROM s)
        SELECT c_custkey, {_QK} AS quadkey FROM t"""),
    "site_centroids": (site_centroids, f"WITH {_aoi_values()} SELECT name, label, track, round((west + east) / 2, 4) AS lon, round((south + north) / 2, 4) AS lat, mineral FROM aoi"),
    "subwindow": (subwindow, f"WITH {_aoi_values()} SELECT name, round((west + east) / 2 - 1.5::DOUBLE / 88, 6) AS west, round((south + north) / 2 - 1.5::DOUBLE / 111, 6) AS south, round((west + east) / 2 + 1.5::DOUBLE / 88, 6) AS east, round((south + north) / 2 + 1.5::DOUBLE / 111, 6) AS north FROM aoi"),
    # another series than the query's: powers of the longitude difference, exact to nanometres this near the meridian
    "transverse_mercator": (transverse_mercator, """WITH k AS (SELECT 6378137.0::DOUBLE AS a, (2 - 1 / 298.257222101::DOUBLE) / 298.257222101::DOUBLE AS e2),
        g AS (SELECT c_custkey, CAST(171.8 + CAST(c_custkey * 7 % 240 AS DOUBLE) / 100 AS DOUBLE) AS lon, CAST(-47.5 + CAST(c_custkey * 11 % 1300 AS DOUBLE) / 100 AS DOUBLE) AS lat FROM customer),
        h AS (SELECT g.*, a, e2, e2 / (1 - e2) AS ep, radians(lat) AS p, radians(lon - 173) * cos(radians(lat)) AS w, power(tan(radians(lat)), 2) AS t, a / sqrt(1 - e2 * power(sin(radians(lat)), 2)) AS nu FROM g, k),
        m AS (SELECT *, ep * power(cos(p), 2) AS q, a * ((1 - e2 / 4 - 3 * e2 ** 2 / 64 - 5 * e2 ** 3 / 256 - 175 * e2 ** 4 / 16384) * p - (3 * e2 / 8 + 3 * e2 ** 2 / 32 + 45 * e2 ** 3 / 1024 + 105 * e2 ** 4 / 4096) * sin(2 * p)
            + (15 * e2 ** 2 / 256 + 45 * e2 ** 3 / 1024 + 525 * e2 ** 4 / 16384) * sin(4 * p) - (35 * e2 ** 3 / 3072 + 175 * e2 ** 4 / 12288) * sin(6 * p) + 315 * e2 ** 4 / 131072 * sin(8 * p)) AS arc FROM h)
        SELECT c_custkey, round(1600000 + 0.9996 * nu * (w + (1 - t + q) * w ** 3 / 6 + (5 - 18 * t + t ** 2 + 14 * q - 58 * t * q + 13 * q ** 2 + 4 * q ** 3 - 64 * q ** 2 * t - 24 * q ** 3 * t) * w ** 5 / 120 + (61 - 479 * t + 179 * t ** 2 - t ** 3) * w ** 7 / 5040), 1) AS easting,
            round(10000000 + 0.9996 * (arc + nu * tan(p) * (w ** 2 / 2 + (5 - t + 9 * q + 4 * q ** 2) * w ** 4 / 24 + (61 - 58 * t + t ** 2 + 270 * q - 330 * t * q + 445 * q ** 2 + 324 * q ** 3 - 680 * q ** 2 * t + 88 * q ** 4 - 600 * q ** 3 * t - 192 * q ** 4 * t) * w ** 6 / 720 + (1385 - 3111 * t + 543 * t ** 2 - t ** 3) * w ** 8 / 40320)), 1) AS northing,
            round(lon, 6) AS lon, round(lat, 6) AS lat FROM m"""),
    "map_projection": (map_projection, f"""WITH {_aoi_values()}, c AS (SELECT name, round((west + east) / 2, 4) AS lon, round((south + north) / 2, 4) AS lat FROM aoi WHERE track = 'satellite')
        SELECT name, array_to_string(list_transform(string_split(name, '_'), lambda w: upper(w[1]) || w[2:]), ' ') AS title, round((lon - 112) / 42 * 440, 6) AS px, round((-9 - lat) / 35 * 380, 6) AS py,
          round(-sin(radians(90 - lat)) * cos(radians(lon + 180)), 6) AS sx, round(cos(radians(90 - lat)), 6) AS sy, round(sin(radians(90 - lat)) * sin(radians(lon + 180)), 6) AS sz,
          round(6378137 * radians(lon), 3) AS mx, round(6378137 * ln(tan(pi() / 4 + radians(lat) / 2)), 3) AS my FROM c"""),
    "layer_mosaic": (layer_mosaic, f"WITH {V.CHM} SELECT r, c, coalesce(h, -1) + CASE WHEN c >= 30 THEN 100 ELSE 0 END AS value FROM chm"),
}
