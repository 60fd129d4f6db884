"""Exact duplicates by content sort, with DataFrame functions only.

1. Sampled splitters cut the order of normalised texts into ranges.  A bounded sample of texts (cut at
   ``CUT`` characters) is ordered; at each quantile the shortest beginning that tells the sampled text
   from the one before it becomes a splitter.  A text that holds several quantiles by itself - copies of
   a third of the rows - gives its range as many *parts*, dealt by a hash of the row.
2. Each row goes to its part (``repartitionById``) by comparing its whole normalised text with the
   splitters, and parts are sorted externally by the whole normalised text, then most code points, then
   smallest doc_id: equals become adjacent.
3. Each row is compared in full with its neighbour: a difference ends a run of equals, whose first row
   leads it.  In a range of one part that decides the group.
4. Runs of ranges with several parts meet once more, one row a run, and are compared by whole text.

No digest decides anything; SHA-256 is only returned.  The driver sees at most one splitter a range.

Two texts are equal when identical after deleting ASCII white space.  Defined results: null counts
as empty; all empty texts are one group; a null doc_id comes after every other; of rows that agree
in text length and doc_id one stays, the first in the lowest part; very long texts are compared whole;
an empty table gives an empty result; other columns, whatever their names, are ignored by the decision
and returned untouched by ``drop_copies``.
"""

from __future__ import annotations

from os.path import commonprefix

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, partitions, small_side, table

#: Characters of a sampled text that are looked at, and sampled texts for each range.
CUT = 4096
SAMPLE = 30
#: Rows below which a range is not cut further.
LEAST_ROWS = 8


def normalised(text: Column) -> Column:
    """The text without ASCII white space, one plain replacement a character: cheaper than a pattern."""
    out = F.coalesce(text.cast("string"), F.lit(""))
    for c in " \t\n\x0b\x0c\r":
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def _splitters(texts: DataFrame) -> list[tuple[str, int]]:
    """(least text of a range, its parts), ascending, for the column ``text``; before the first lies one more part."""
    rows = texts.count()
    ranges = min(partitions(texts.sparkSession), rows // LEAST_ROWS + 1)
    if ranges == 1:
        return []
    share = min(1.0, ranges * SAMPLE / rows)
    drawn = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 30)) < int(share * (1 << 30))
    keys = texts.filter(drawn).select(F.substring(normalised(F.col("text")), 1, CUT).alias("p"))
    keys = keys.groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    # one task: ranges x SAMPLE texts at most
    order = Window.orderBy("p")
    keys = keys.withColumns({"upto": F.sum("n").over(order), "before": F.lag("p").over(order)})
    total = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    quantile = lambda x: F.floor(x * ranges / F.col("total"))
    parts = F.least(quantile(F.col("upto")), F.lit(ranges - 1)) - quantile(F.col("upto") - F.col("n"))
    chosen = keys.withColumn("total", total).select("p", "before", parts.cast("int").alias("parts")).filter("parts > 0")
    got = sorted(chosen.collect(), key=lambda r: r.p)
    return [(r.p[: len(commonprefix([r.p, r.before])) + 1] if r.before is not None else "", r.parts) for r in got]


def _range_of(norm: Column, cuts: list[str]) -> Column:
    """How many splitters are at or below the text, by binary search in a constant array."""
    if not cuts:
        return F.lit(0)
    known, n = F.array(*map(F.lit, cuts)), len(cuts)

    def halve(acc: Column, _: Column) -> Column:
        mid = F.floor((acc.lo + acc.hi) / 2).cast("int")
        done = acc.lo >= acc.hi
        up = F.get(known, mid) <= acc.norm
        lo, hi = F.when(~done & up, mid + 1).otherwise(acc.lo), F.when(~done & ~up, mid).otherwise(acc.hi)
        return F.struct(lo.alias("lo"), hi.alias("hi"), acc.norm.alias("norm"))

    # the text travels in the state: an expression inside the function would be made anew in each step
    span = F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi"), norm.alias("norm"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(n.bit_length())), span, halve, lambda acc: acc.lo)


def _runs(rows: DataFrame, splitters: list[tuple[str, int]] | None = None) -> DataFrame:
    """``rows`` (doc_id, text, any others) with part, shared (the range has other parts), norm, n_chars,
    row_id, place (1 leads the run), run (row_id of the leader), run_rows and run_id (the leader's doc_id)."""
    splitters = _splitters(rows.select("text")) if splitters is None else splitters
    starts, held = [0], [1]
    for _, parts in splitters:
        starts.append(starts[-1] + held[-1])
        held.append(parts)
    at = _range_of(normalised(F.col("text")), [p for p, _ in splitters])
    ints = lambda xs: F.array(*map(F.lit, xs))
    salt = F.xxhash64("doc_id", F.spark_partition_id())
    dealt = rows.withColumn("_at", at).withColumn("_held", F.get(ints(held), F.col("_at")))
    dealt = dealt.withColumns({"part": (F.get(ints(starts), F.col("_at")) + F.pmod(salt, F.col("_held"))).cast("int"), "shared": F.col("_held") > 1})
    dealt = dealt.drop("_at", "_held").repartitionById(partitions(rows.sparkSession), "part")
    dealt = dealt.withColumns(
        {"norm": normalised(F.col("text")), "n_chars": F.length(F.coalesce(F.col("text"), F.lit(""))).cast("long"), "row_id": F.monotonically_increasing_id()}
    )
    # the sorted rows of a part: a group ends where a neighbour's whole text differs
    run = Window.partitionBy("part", "norm").orderBy(F.desc("n_chars"), F.asc_nulls_last("doc_id"), "row_id")
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return dealt.withColumns(
        {"place": F.row_number().over(run), "run": F.first("row_id").over(whole), "run_rows": F.count(F.lit(1)).over(whole), "run_id": F.first("doc_id").over(whole)}
    )


def _merged(leaders: DataFrame) -> DataFrame:
    """run, group_size, group_id and wins of the runs (norm, n_chars, doc_id, part, run, run_rows) whose text has others."""
    order = Window.partitionBy("norm").orderBy(F.desc("n_chars"), F.asc_nulls_last("doc_id"), "part")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    got = leaders.withColumns(
        {"rank": F.row_number().over(order), "runs": F.count(F.lit(1)).over(whole), "group_size": F.sum("run_rows").over(whole), "group_id": F.first("doc_id").over(whole)}
    )
    return got.filter("runs > 1").select(F.col("run").alias("merged_run"), "group_size", "group_id", (F.col("rank") == 1).alias("wins"))


def groups(df: DataFrame) -> DataFrame:
    """One row for each row of ``df``: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    splitters = _splitters(rows.select("text"))
    runs = _runs(rows, splitters)
    sha, leads = F.sha2("norm", 256), F.col("place") == 1
    if all(parts == 1 for _, parts in splitters):
        return runs.select("doc_id", F.col("run_id").alias("keep_id"), F.col("run_rows").alias("group_size"), leads.alias("kept"), sha.alias("text_sha256"))
    scratch = Scratch(df.sparkSession)
    meets = F.when(leads & F.col("shared"), F.col("norm"))
    runs = scratch.put(runs.select("doc_id", "part", meets.alias("norm"), "n_chars", "run", "run_rows", "run_id", leads.alias("leads"), F.unhex(sha).alias("sha")))
    merged = small_side(scratch.put(_merged(runs.filter("norm IS NOT NULL"))), 48)
    joined = runs.drop("norm").join(merged, F.col("run") == F.col("merged_run"), "left")
    alone = F.col("merged_run").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("run_id")).otherwise(F.col("group_id")).alias("keep_id"),
        F.when(alone, F.col("run_rows")).otherwise(F.col("group_size")).alias("group_size"),
        (F.col("leads") & (alone | F.col("wins"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_copies(df: DataFrame) -> DataFrame:
    """The rows of ``df`` that stay, with all their columns."""
    rest = F.struct(*[F.col(f"`{c}`") for c in df.columns if c != "text"])
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), rest.alias("rest"))
    splitters = _splitters(rows.select("text"))
    stay = _runs(rows, splitters).filter("place = 1")
    if any(parts > 1 for _, parts in splitters):
        scratch = Scratch(df.sparkSession)
        stay = scratch.put(stay.select("rest", "text", "doc_id", "part", "shared", "n_chars", "run", "run_rows"))
        others = _merged(stay.filter("shared").withColumn("norm", normalised(F.col("text")))).filter("NOT wins").select("merged_run")
        stay = stay.join(small_side(scratch.put(others), 16), F.col("run") == F.col("merged_run"), "left_anti")
    return stay.select(*[F.col("text") if c == "text" else F.col(f"rest.`{c}`").alias(c) for c in df.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n,
        regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents),
g AS (SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS rn, count(*) OVER (PARTITION BY norm) AS size
        FROM d WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT doc_id, keep_id, CAST(size AS BIGINT) AS group_size, rn = 1 AS kept, sha256(norm) AS text_sha256 FROM g
"""
