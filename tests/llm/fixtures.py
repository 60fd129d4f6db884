"""Small corpora with every awkward case, and rows to compare."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside, as columns of the input.
CLASH = ("kept", "size", "uid", "row", "sha", "part", "norm", "class_key", "n_copies", "ids", "score", "target", "source_size", "runs", "words", "told")


def words(rng: random.Random, n: int, pool: int = 400) -> str:
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


def corpus(seed: int = 0, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    out: list[tuple] = []
    shared = words(rng, 70)
    bases = [words(rng, rng.choice((12, 40, 120, 400))) for _ in range(n)]
    for i, t in enumerate(bases):
        if i % 7 == 0:
            t = f"{t} {shared} {words(rng, 9)}"
        if i % 9 == 0:
            t = t + "\n" + t[:200] + "\n" + t[:200]
        out.append((i, t, "en", f"src{i % 4}", len(t)))
    for j in range(12):  # near copies
        w = bases[5].split()
        w[rng.randrange(len(w))] = "changed"
        out.append((100 + j, " ".join(w), "en", "src0", 1))
    for j in range(8):  # copies, one spaced differently
        out.append((200 + j, bases[3] + (" " if j == 4 else ""), "de", None, 2))
    out += [
        (300, None, None, None, None), (301, "", "en", "src1", 0), (302, " \n\t ", "en", "src1", 4), (303, "one two three", "en", "src1", 13),
        (304, "z" * 5000, "en", "src2", 5000), (305, "ab " * 4000, "en", "src2", 1), (306, words(rng, 6000, 5000), "en", "src2", 1),
        (307, "Ünïcödé <|endoftext|> 12 'll's 　 日本語 é", "en", "src3", 1), (None, "no identifier at all in this row here", "en", "src1", 3), (None, None, None, None, None),
    ]
    out += [out[10], out[10], out[62]]  # repeated rows
    return out


def frame(spark, rows=None, clash: bool = False):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(corpus() if rows is None else rows, SCHEMA)
    return df.withColumns({c: F.lit(f"<{c}>") for c in CLASH}) if clash else df


def ordered(rows) -> list:
    return sorted((tuple(r) for r in rows), key=repr)
