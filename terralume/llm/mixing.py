"""Mixing sources to target weights, with DataFrame functions only.

Words are added up for each source (one row for each source leaves a task).  Sources in code-point
order, null last, weigh 5, 2, 1, repeating, and share ``SHARE`` times all words.  A source's target
stops at ``MOST`` times its words and the excess is shared again by weight until none is above: the
fixed point is target = min(cap, level x weight), and the level follows from running sums over the
sources ordered by cap / weight - no loop.  rate = target / words; each document is emitted
floor(rate) times plus one copy whose hash, seeded, falls below the fraction of the rate.

One draw of few documents scatters, so ``SEEDS`` fixed seeds are tried: one aggregate gives the words
that each seed would take of each source, and a source keeps the seed whose words are nearest to its
target (the first of equals).  Whatever the seed, a document's chance is the fraction.

Texts are read once for their sizes; a table of doc_id, source and size serves the later steps.  The
table of sources is joined by broadcast only if its measured size allows it; else the join is
shuffled and adaptive execution splits a hot source, as no step needs a source's rows together.

Defined results: a null or empty text has no words; a null source is a source of its own; a source
without words has target 0 and its documents are not emitted; rows that repeat a doc_id get the same
number of copies within a source; a null doc_id hashes as the empty string; a very long text is one
document, never cut; an empty table gives an empty result; other columns, whatever their names, are
returned untouched by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, small_side, table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
SEED = "mix"
SEEDS = 32
#: Hexadecimal digits of a hash that make one chance; an MD5 holds two.
_DIGITS = 13


def word_count(text: Column) -> Column:
    """The number of runs of anything but ASCII white space, without building the words."""
    bare = F.ltrim(F.coalesce(text.cast("string"), F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.length(F.regexp_replace(bare, r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", "x")).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target from rows of (source, size)."""
    per = sizes.groupBy("source").agg(F.sum("size").cast("double").alias("words"))
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    weight = F.get(F.array(*map(F.lit, WEIGHTS)), (F.row_number().over(by_name) - 1) % len(WEIGHTS))
    per = per.withColumn("weight", weight.cast("double")).withColumn("cap", F.col("words") * MOST)
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source"))
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumns(
        {
            "left": F.sum("words").over(every) * SHARE - F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
            "open": F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)),
        }
    ).withColumn("level", F.col("left") / F.col("open"))
    # "level" would be reached if just the sources before were full: it rises up to the first source
    # that is not and falls after it, so the level is the greatest
    target = F.least("cap", F.max("level").over(every) * F.col("weight"))
    return per.select("source", F.col("words").cast("long").alias("source_size"), target.alias("target"))


def chance(doc_id: Column, seed: Column | int) -> Column:
    """A number in [0, 1) for the document: ``seed`` picks the hash and which half of it."""
    seed = F.lit(seed) if isinstance(seed, int) else seed
    name = F.concat(F.lit(SEED), F.floor(seed / 2).cast("string"), F.lit(":"), F.coalesce(doc_id.cast("string"), F.lit("")))
    digits = F.substring(F.md5(name.cast("binary")), 1 + _DIGITS * (seed % 2), F.lit(_DIGITS))
    return F.conv(digits, 16, 10).cast("double") / float(1 << 4 * _DIGITS)


def _rate() -> Column:
    return F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))


def copies(doc_id: Column, seed: Column | int) -> Column:
    rate = _rate()
    return (F.floor(rate) + F.when(chance(doc_id, seed) < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def _row_bytes() -> Column:
    return F.octet_length(F.coalesce("source", F.lit(""))) + 64


def _plan(sizes: DataFrame, scratch: Scratch) -> DataFrame:
    """source, source_size, target and seed for the rows of ``sizes`` (id, source, size)."""
    aims = small_side(scratch.put(targets(sizes)), _row_bytes())
    rows = sizes.select("id", "size", F.col("source").alias("s")).join(aims, F.col("s").eqNullSafe(F.col("source")))
    # grouped by a struct, so that a hot source is added up before a shuffle of its own
    key = F.struct("source", "source_size", "target").alias("key")
    taken = rows.groupBy(key).agg(*[F.sum(copies(F.col("id"), k) * F.col("size")).alias(f"t{k}") for k in range(SEEDS)])
    off = F.array(*[F.struct(F.abs(F.col(f"t{k}") - F.col("key.target")).alias("off"), F.lit(k).alias("seed")) for k in range(SEEDS)])
    return taken.select("key.*", F.array_min(off).seed.alias("seed"))


def _planned(df: DataFrame, keep: Column) -> DataFrame:
    """source_size, target, n_copies beside ``keep`` for each row of ``df``."""
    scratch = Scratch(df.sparkSession)
    sizes = scratch.put(_sized(df))
    plan = scratch.put(_plan(sizes, scratch))
    scratch.keep(plan)
    return _taken(df, keep, plan)


def _sized(df: DataFrame) -> DataFrame:
    return df.select(F.col("doc_id").cast("long").alias("id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))


def _taken(df: DataFrame, keep: Column, plan: DataFrame) -> DataFrame:
    rows = df.select(keep.alias("row"), F.col("doc_id").cast("long").alias("id"), F.col("source").cast("string").alias("s"))
    joined = rows.join(small_side(plan, _row_bytes()), F.col("s").eqNullSafe(F.col("source")))
    return joined.select("row", "source_size", "target", copies(F.col("id"), F.col("seed")).alias("n_copies"))


def amounts(df: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and ``taken`` (words taken, repeats counted) of each row."""
    scratch = Scratch(df.sparkSession)
    sizes = scratch.put(_sized(df))
    plan = scratch.put(_plan(sizes, scratch))
    scratch.keep(sizes, plan)
    got = _taken(sizes.withColumnRenamed("id", "doc_id"), F.struct("doc_id", "size"), plan)
    return got.select("row.doc_id", "row.size", "source_size", "target", (F.col("n_copies") * F.col("row.size")).alias("taken"))


def mix(df: DataFrame) -> DataFrame:
    """The mixed rows: each row of ``df``, all columns, as often as it is taken."""
    got = _planned(df, F.struct(*[F.col(f"`{c}`") for c in df.columns])).filter("n_copies > 0")
    again = got.select("row", F.explode(F.sequence(F.lit(1), F.col("n_copies").cast("int"))))
    return again.select(*[F.col(f"row.`{c}`").alias(c) for c in df.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return amounts(table(spark, sf_dir, "documents"))


ORACLE = rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS DOUBLE) AS words FROM d GROUP BY source),
w AS (SELECT *, CAST([{", ".join(map(str, WEIGHTS))}][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)}] AS DOUBLE) AS weight, words * {MOST} AS cap FROM s),
f AS (SELECT *, (sum(words) OVER () * {SHARE} - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
l AS (SELECT max(level) AS level FROM f),
t AS (SELECT source, words, least(cap, l.level * weight) AS target FROM f, l),
r AS (SELECT doc_id, d.source, size, CAST(words AS BIGINT) AS source_size, target, CASE WHEN words > 0 THEN target / words ELSE 0 END AS rate
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT r.*, seed, CAST(CAST('0x' || substr(md5('{SEED}' || CAST(seed // 2 AS VARCHAR) || ':' || coalesce(CAST(doc_id AS VARCHAR), '')),
        CAST(1 + {_DIGITS} * (seed % 2) AS INTEGER), {_DIGITS}) AS BIGINT) AS DOUBLE) / {1 << 4 * _DIGITS} AS chance FROM r, range({SEEDS}) AS seeds(seed)),
e AS (SELECT *, CAST((floor(rate) + CASE WHEN chance < rate - floor(rate) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM c),
o AS (SELECT source, seed, abs(sum(taken) - any_value(target)) AS off FROM e GROUP BY source, seed),
b AS (SELECT source, seed FROM o QUALIFY row_number() OVER (PARTITION BY source ORDER BY off, seed) = 1)
SELECT doc_id, size, source_size, target, taken FROM e JOIN b ON e.seed = b.seed AND e.source IS NOT DISTINCT FROM b.source
"""
