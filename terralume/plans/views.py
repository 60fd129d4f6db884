"""Pixel views over the relational test tables, in Spark and in SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.classes import spectral_label
from ..functions.indices import exg, ndvi, ndwi
from ..operators.temporal import cloud_masked, harmonised, period_median
from ..sources.scratch import Scratch

BANDS = ("b02", "b03", "b04", "b08")
KEYS = ("site", "y", "x")
CUTOFF, OFFSET = "1999-01-01", 100.0


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column) -> Column:
    return F.round(c, 6)


def px_obs(spark: SparkSession, sf_dir: str, scene: bool = False) -> DataFrame:
    """One row for each pixel observation: site, y, x, ts, scl and bands; with ``scene`` its scene_id too."""
    t = read(spark, sf_dir, "lineitem")
    d = lambda c: c.cast("double")
    ids = [F.col("l_orderkey").alias("scene_id")] if scene else []
    return t.select(
        *ids, F.col("l_returnflag").alias("site"), (F.col("l_partkey") % 24).cast("int").alias("y"), (F.col("l_suppkey") % 24).cast("int").alias("x"),
        F.col("l_shipdate").alias("ts"), F.col("l_linenumber").alias("scl"),
        d(500 + F.floor(F.col("l_quantity") * 80)).alias("b08"), d(300 + F.col("l_orderkey") % 2000).alias("b04"),
        d(300 + F.floor(F.col("l_tax") * 20000)).alias("b03"), d(300 + F.floor(F.col("l_discount") * 15000)).alias("b02"),
        d(400 + F.col("l_orderkey") % 1500).alias("b05"),
    )


def composite(spark: SparkSession, sf_dir: str, period: str = "annual", bands=BANDS) -> DataFrame:
    """Harmonised, cloud-masked period medians."""
    obs = px_obs(spark, sf_dir).select(*KEYS, "ts", "scl", *bands)
    return period_median(cloud_masked(harmonised(obs, bands, cutoff=CUTOFF, offset=OFFSET)), KEYS, bands, period)


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annual composites with ndvi, ndwi, class and year."""
    comp = composite(spark, sf_dir, bands=("b03", "b04", "b08")).withColumns({"ndvi": ndvi(), "ndwi": ndwi()})
    return comp.withColumns({"cls": spectral_label(), "year": F.year("period_start")})


def labelled_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``labelled``, written once: for queries that read it more than once."""
    return Scratch(spark).put(labelled(spark, sf_dir))


def chm_px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dense height grid, 50 pixels wide: r, c, h, dem, dsm, size, red, green, blue, exg."""
    t = read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    base = t.select(
        F.floor(k / 50).cast("int").alias("r"), (k % 50).cast("int").alias("c"), F.col("p_size").alias("size"),
        F.when(F.col("p_size") != 50, (F.col("p_size") - 10).cast("double") / 5).alias("h"),
        (60 + k * 7 % 120).cast("int").alias("red"), (60 + (k * 13 + F.col("p_size")) % 140).cast("int").alias("green"), (50 + k * 11 % 110).cast("int").alias("blue"),
    )
    base = base.withColumn("dem", 100 + F.col("r") * F.lit(0.5) + (F.col("c") % 7) * F.lit(0.25))
    return base.withColumns({"dsm": F.col("dem") + F.col("h"), "exg": exg()})


def dims(pixels: DataFrame) -> tuple[int, int]:
    """(height, width) of a grid that starts at 0, 0."""
    got = pixels.agg(F.max("r").alias("r"), F.max("c").alias("c")).first()
    return got["r"] + 1, got["c"] + 1


def site_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of two years at the same pixel: site, y, x, a (1997), b (1998)."""
    lab = labelled(spark, sf_dir).filter(F.col("year").isin(1997, 1998))
    got = lab.groupBy(*KEYS).agg(F.max(F.when(F.col("year") == 1997, F.col("cls"))).alias("a"), F.max(F.when(F.col("year") == 1998, F.col("cls"))).alias("b"))
    return got.filter("a IS NOT NULL AND b IS NOT NULL")


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, pass 0 .. 15, z (4 logits), target (255: ignore)."""
    t = read(spark, sf_dir, "embeddings")
    z = lambda p: F.transform(F.slice("embedding", 4 * p + 1, 4), lambda v: v.cast("double") * 8)
    e = t.select("vec_id", F.when(F.col("label") >= 8, 255).otherwise(F.col("label") % 4).cast("int").alias("target"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("pass"))
    return e.select("vec_id", "target", "pass", z(F.col("pass")).alias("z"))


def tile_stats_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as tiles: tile_id, city, valid_px, canopy_pct, removed_area_m2, slope_bin."""
    t = read(spark, sf_dir, "documents")
    city = F.element_at(F.create_map(*[F.lit(x) for pair in (("en", "Wellington"), ("fr", "Auckland"), ("de", "Christchurch"), ("es", "Tauranga")) for x in pair]), F.col("lang"))
    slopes = F.array(*map(F.lit, ("flat", "gentle", "moderate", "steep")))
    return t.select(
        F.col("doc_id").alias("tile_id"), city.alias("city"), F.col("n_chars").alias("valid_px"), (F.col("doc_id") * 37 % 100).cast("double").alias("canopy_pct"),
        (F.col("n_chars") * (F.col("doc_id") % 4)).cast("double").alias("_r"), F.get(slopes, (F.col("doc_id") % 4).cast("int")).alias("slope_bin"),
    ).withColumn("removed_area_m2", F.col("_r") / 40).drop("_r")


def ev_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read(spark, sf_dir, "events")
    return t.select(F.col("user_id").alias("pixel"), "ts", "value", "event_type")


# ---- the same views for DuckDB ----

_H = lambda b: f"CASE WHEN ts >= TIMESTAMP '{CUTOFF}' THEN greatest({b} - {OFFSET}, 0) ELSE {b} END AS {b}"
PX = """px AS (SELECT l_returnflag AS site, CAST(l_partkey % 24 AS INT) AS y, CAST(l_suppkey % 24 AS INT) AS x, l_shipdate AS ts, l_linenumber AS scl,
  CAST(500 + floor(l_quantity * 80) AS DOUBLE) AS b08, CAST(300 + l_orderkey % 2000 AS DOUBLE) AS b04, CAST(300 + floor(l_tax * 20000) AS DOUBLE) AS b03,
  CAST(300 + floor(l_discount * 15000) AS DOUBLE) AS b02, CAST(400 + l_orderkey % 1500 AS DOUBLE) AS b05 FROM lineitem)"""
HARMONISED = PX + f""",
hz AS (SELECT site, y, x, ts, scl, {", ".join(map(_H, BANDS))} FROM px)"""
CLEAR = HARMONISED + """,
clear AS (SELECT * FROM hz WHERE scl IN (2, 4, 5, 6, 7))"""


def composite_sql(unit: str = "year") -> str:
    med = ", ".join(f"median({b}) AS {b}" for b in BANDS)
    return CLEAR + f""",
comp AS (SELECT site, y, x, date_trunc('{unit}', ts) AS period_start, {med} FROM clear GROUP BY ALL)"""


INDEXED = composite_sql() + """,
nd AS (SELECT *, (b08 - b04) / nullif(b08 + b04, 0) AS ndvi, (b03 - b08) / nullif(b03 + b08, 0) AS ndwi, CAST(year(period_start) AS INT) AS year FROM comp)"""
LABEL_CASE = "CASE WHEN ndvi IS NULL THEN 0 WHEN ndvi < 0.45 AND ndwi >= 0.10 THEN 2 WHEN ndvi >= 0.45 THEN 7 WHEN ndvi >= 0.20 THEN 6 ELSE 1 END"
LABELLED = INDEXED + f""",
lab AS (SELECT *, CAST({LABEL_CASE} AS INT) AS cls FROM nd)"""
CHM = """chm0 AS (SELECT CAST(p_partkey // 50 AS INT) AS r, CAST(p_partkey % 50 AS INT) AS c, p_size AS size, CASE WHEN p_size <> 50 THEN CAST(p_size - 10 AS DOUBLE) / 5 END AS h,
  CAST(60 + p_partkey * 7 % 120 AS INT) AS red, CAST(60 + (p_partkey * 13 + p_size) % 140 AS INT) AS green, CAST(50 + p_partkey * 11 % 110 AS INT) AS blue FROM part),
chm1 AS (SELECT *, 100 + r * CAST(0.5 AS DOUBLE) + (c % 7) * CAST(0.25 AS DOUBLE) AS dem, CAST(red + green + blue AS DOUBLE) AS rgb FROM chm0),
chm AS (SELECT *, dem + h AS dsm, 2 * (green / rgb) - red / rgb - blue / rgb AS exg FROM chm1)"""
PAIRS = LABELLED + """,
pairs AS (SELECT site, y, x, max(cls) FILTER (WHERE year = 1997) AS a, max(cls) FILTER (WHERE year = 1998) AS b FROM lab WHERE year IN (1997, 1998) GROUP BY ALL HAVING a IS NOT NULL AND b IS NOT NULL)"""
TILE_DOCS = """docs AS (SELECT doc_id AS tile_id, CASE lang WHEN 'en' THEN 'Wellington' WHEN 'fr' THEN 'Auckland' WHEN 'de' THEN 'Christchurch' WHEN 'es' THEN 'Tauranga' END AS city,
  n_chars AS valid_px, CAST(doc_id * 37 % 100 AS DOUBLE) AS canopy_pct, CAST(n_chars * (doc_id % 4) AS DOUBLE) / 40 AS removed_area_m2, ['flat', 'gentle', 'moderate', 'steep'][1 + doc_id % 4] AS slope_bin FROM documents)"""
LOGITS = """zs AS (SELECT vec_id, CAST(CASE WHEN label >= 8 THEN 255 ELSE label % 4 END AS INT) AS target, CAST(p AS INT) AS pass,
  CAST(embedding[4 * p + 1] AS DOUBLE) * 8 AS z0, CAST(embedding[4 * p + 2] AS DOUBLE) * 8 AS z1, CAST(embedding[4 * p + 3] AS DOUBLE) * 8 AS z2, CAST(embedding[4 * p + 4] AS DOUBLE) * 8 AS z3
  FROM embeddings, range(16) t(p)),
ez AS (SELECT vec_id, target, pass, exp(z0 - m) AS e0, exp(z1 - m) AS e1, exp(z2 - m) AS e2, exp(z3 - m) AS e3 FROM (SELECT *, greatest(z0, z1, z2, z3) AS m FROM zs)),
probs AS (SELECT vec_id, target, pass, e0 / s AS p0, e1 / s AS p1, e2 / s AS p2, e3 / s AS p3 FROM (SELECT *, e0 + e1 + e2 + e3 AS s FROM ez))"""
