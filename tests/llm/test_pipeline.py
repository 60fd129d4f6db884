"""The pipeline against the stages' brute-force versions, and the queries' columns."""

import hashlib

import numpy as np

import corpus_pipeline as P
from terralume.llm import bpe, queries

from .fixtures import corpus, frame, ordered
from .test_dedup import bare, by_hand_classes
from .test_text import by_hand_copies, by_hand_repeats, libraries


def by_hand(rows):
    rows = [r for r in rows if by_hand_repeats(r[1])[-1]]
    groups = {}
    for r in rows:
        k = bare(r[1])
        if k not in groups or (-len(r[1] or ""), r[0] is None, r[0] or 0) < (-len(groups[k][1] or ""), groups[k][0] is None, groups[k][0] or 0):
            groups[k] = r
    rows = list(groups.values())
    _, classes = by_hand_classes(rows)
    keep = {min((x for x in m if x is not None), default=None) for m in classes.values()}
    rows = [r for r in rows if r[0] in keep]
    copies = by_hand_copies(rows)
    lib, _ = libraries()
    out = []
    for d, t, _, s, _ in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        row = (d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest())
        out += [row] * copies[s][d]
    return out


def test_pipeline(spark, tmp_path):
    frame(spark).write.parquet(str(tmp_path / "documents.parquet"))
    assert ordered(P.run(spark, str(tmp_path)).collect()) == ordered(by_hand(corpus()))


def test_stages_keep_the_columns(spark, tmp_path):
    docs = frame(spark, clash=True)
    empty = frame(spark, [])
    for name, stage in P.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
        assert stage(spark, empty, str(tmp_path)).count() == 0, name
    assert [n for n, _ in P.STAGES] == ["quality_rules", "exact_dedup", "near_dup", "source_mixing", "bpe_codec"]


def test_ten_queries():
    names = sorted(queries.queries(), key=lambda n: int(n[2:].split("_")[0]))
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(names)
    assert bpe.TOKEN_LIMIT == 512
