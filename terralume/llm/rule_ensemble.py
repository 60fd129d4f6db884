"""A quality classifier as a sparse rule ensemble, compiled to Spark column expressions.

1. Statistics of the text (``STATISTICS``) are column expressions; nothing else is an input.
2. At most ``SAMPLE`` labelled rows, chosen by a hash of doc_id, are brought to the driver as
   statistics (a dozen numbers each): that bound is a parameter and does not grow with the data.
3. Boosted trees of depth ``DEPTH`` are grown on quantile bins; each path from the root to a node is a
   conjunctive rule.
4. Lasso logistic regression over the rules' 0/1 values (accelerated proximal gradient) leaves few
   with a weight.
5. Those are compiled to one expression, sigmoid(bias + sum of weight x rule), that scores all texts
   in whole-stage code: no shuffle, no Python.

Rows whose crc32(doc_id as text) mod ``FOLDS`` is 0 are never learnt from.

Defined results: null and empty texts have all statistics 0 and a score like any other text; rows
without a label are scored too; without labelled rows every score is 0.5; with one class only, the
smoothed share of that class; an empty table gives an empty result; a very long text is read whole;
repeated rows score alike; where a doc_id stands for several texts or labels, each distinct pair counts
once; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .mixing import word_count

SAMPLE = 20_000
FOLDS = 5
DEPTH = 3
TREES = 40
RATE = 0.3
BINS = 32
LEAST_ROWS = 10
LASSO = 2e-3
ROUNDS = 300
THRESHOLD = 0.3

STATISTICS = ("log_chars", "log_words", "word_chars", "upper", "digits", "symbols", "marks", "pipes", "distinct_words", "distinct_lines", "words_per_line", "long_words")


def _count(text: Column, unwanted: str) -> Column:
    return F.length(F.regexp_replace(text, unwanted, "")).cast("double")


def _share(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def with_statistics(df: DataFrame) -> DataFrame:
    """doc_id and the statistics of each row's text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.withColumns(
        {
            "chars": F.length("text").cast("double"),
            "words": word_count(F.col("text")).cast("double"),
            "lines": F.split("text", "\n"),
            "tokens": F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""),
        }
    )
    told = {
        "log_chars": F.log1p("chars"),
        "log_words": F.log1p("words"),
        "word_chars": _share(F.col("chars"), F.col("words")),
        "upper": _share(_count(F.col("text"), r"[^\p{Lu}]+"), F.col("chars")),
        "digits": _share(_count(F.col("text"), r"[^0-9]+"), F.col("chars")),
        "symbols": _share(_count(F.col("text"), r"[^#*$%&<>]+"), F.col("words")),
        "marks": _share(_count(F.col("text"), r"[^!?]+"), F.col("words")),
        "pipes": _share(_count(F.col("text"), r"[^|]+"), F.col("words")),
        "distinct_words": _share(F.size(F.array_distinct("tokens")).cast("double"), F.col("words")),
        "distinct_lines": _share(F.size(F.array_distinct("lines")).cast("double"), F.size("lines").cast("double")),
        "words_per_line": _share(F.col("words"), F.size("lines").cast("double")),
        "long_words": _share(F.size(F.filter("tokens", lambda w: F.length(w) > 12)).cast("double"), F.col("words")),
    }
    return rows.select("doc_id", *[told[k].alias(k) for k in STATISTICS])


@dataclass(frozen=True)
class Rule:
    """All of (statistic, True for "above" else "at or below", cut) hold."""

    terms: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        out = None
        for name, above, cut in self.terms:
            c = F.col(name) > cut if above else F.col(name) <= cut
            out = c if out is None else out & c
        return out

    def values(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for name, above, cut in self.terms:
            v = x[:, STATISTICS.index(name)]
            out &= v > cut if above else v <= cut
        return out


@dataclass(frozen=True)
class Ensemble:
    bias: float
    rules: tuple[tuple[float, Rule], ...]

    def score(self) -> Column:
        total = F.lit(self.bias)
        for weight, rule in self.rules:
            total = total + F.when(rule.column(), weight).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-total))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def grow_rules(x: np.ndarray, y: np.ndarray) -> list[Rule]:
    """The distinct paths of boosted trees."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    codes = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], 1)
    z = np.full(len(y), np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    found: dict[frozenset, Rule] = {}

    def split(rows: np.ndarray, g: np.ndarray, h: np.ndarray):
        best = (1e-6, None, None)
        gs, hs = g[rows].sum(), h[rows].sum()
        for f in range(x.shape[1]):
            if not len(cuts[f]):
                continue
            c, size = codes[rows, f], len(cuts[f]) + 1
            n = np.cumsum(np.bincount(c, minlength=size))[:-1]
            gl = np.cumsum(np.bincount(c, g[rows], size))[:-1]
            hl = np.cumsum(np.bincount(c, h[rows], size))[:-1]
            gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
            gain[(n < LEAST_ROWS) | (len(rows) - n < LEAST_ROWS)] = 0
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], f, k)
        return best[1:]

    for _ in range(TREES):
        p = _sigmoid(z)
        g, h = y - p, p * (1 - p)
        level = [(np.arange(len(y)), ())]
        for depth in range(DEPTH + 1):
            after = []
            for rows, path in level:
                f, k = split(rows, g, h) if depth < DEPTH else (None, None)
                if f is None:
                    z[rows] += RATE * g[rows].sum() / (h[rows].sum() + 1)
                    continue
                low = codes[rows, f] <= k
                for above, part in ((False, rows[low]), (True, rows[~low])):
                    path_here = (*path, (STATISTICS[f], above, float(cuts[f][k])))
                    found.setdefault(frozenset(path_here), Rule(path_here))
                    after.append((part, path_here))
            level = after
    return list(found.values())


def lasso(m: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Bias and weights: L1-penalised logistic loss by accelerated proximal gradient."""
    n, k = m.shape
    mean = m.mean(0)
    c = m - mean
    v = np.random.default_rng(0).normal(size=k)
    for _ in range(20):  # the largest curvature, by power iteration
        v = c.T @ (c @ v)
        v /= np.linalg.norm(v) + 1e-12
    step = 1.0 / (0.25 * (np.linalg.norm(c @ v) ** 2 / n + 1) * 1.05)
    w, b = np.zeros(k), np.log((y.sum() + 1) / (n - y.sum() + 1))
    u, a, t = w, b, 1.0
    for _ in range(ROUNDS):
        r = _sigmoid(c @ u + a) - y
        w1 = u - step * (c.T @ r) / n
        w1 = np.sign(w1) * np.maximum(np.abs(w1) - step * LASSO, 0)
        b1 = a - step * r.mean()
        t1 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        u, a = w1 + (t - 1) / t1 * (w1 - w), b1 + (t - 1) / t1 * (b1 - b)
        w, b, t = w1, b1, t1
    return float(b - mean @ w), w


def fit(x: np.ndarray, y: np.ndarray) -> Ensemble:
    if not len(y):
        return Ensemble(0.0, ())
    if y.min() == y.max():
        return Ensemble(float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), ())
    rules = grow_rules(x, y)
    if not rules:
        return Ensemble(float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), ())
    bias, w = lasso(np.stack([r.values(x) for r in rules], 1).astype(float), y)
    return Ensemble(bias, tuple((float(v), r) for v, r in zip(w, rules) if abs(v) > 1e-6))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ensemble:
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y"))
    marked = marked.filter("doc_id IS NOT NULL AND y IS NOT NULL").filter(~held_out(F.col("doc_id")))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    got = with_statistics(texts.join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi"))  # at most `sample` ids
    rows = got.join(F.broadcast(chosen), "doc_id").select("doc_id", "y", *STATISTICS).distinct()
    # a doc_id may stand for several texts: the bound holds, and the same rows are taken each time
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "y", *STATISTICS).limit(2 * sample).drop("doc_id").toPandas()
    rows = rows.sort_values(list(rows.columns)).to_numpy(float)
    return fit(rows[:, 1:], rows[:, 0]) if len(rows) else fit(np.empty((0, len(STATISTICS))), np.empty(0))


def score(docs: DataFrame, model: Ensemble, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of each row."""
    s = model.score()
    got = with_statistics(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), s.alias("score"))
    return got.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
