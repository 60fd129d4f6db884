"""What must hold at any size: the joins without broadcasts, chains and hubs, recall at the threshold."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terralume.llm import common, exact_dedup, mixing, near_dup, substring_dedup, url_trust
from terralume.sources.scratch import Scratch

from .fixtures import corpus, frame, ordered
from .test_dedup import bare, by_hand_classes, by_hand_cut, by_hand_groups
from .test_pipeline import by_hand
from .test_text import PAGES, by_hand_verdicts


@pytest.fixture
def shuffled(spark, monkeypatch):
    """No side is small: every join that may be broadcast is shuffled."""
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, -1)
    yield spark
    spark.conf.set(name, before)


def test_near_duplicates_shuffled(shuffled, monkeypatch):
    want, classes = by_hand_classes(corpus())
    assert ordered(near_dup.near_classes(frame(shuffled, clash=True)).collect()) == ordered(want)
    monkeypatch.setattr(near_dup, "BLOCK", 4)
    assert near_dup.drop_near(frame(shuffled)).count() == len(classes)


def test_exact_copies_shuffled(shuffled):
    shuffled.conf.set("spark.sql.shuffle.partitions", 16)
    try:
        assert ordered(exact_dedup.groups(frame(shuffled, clash=True)).collect()) == ordered(by_hand_groups(corpus()))
        assert exact_dedup.drop_copies(frame(shuffled)).count() == len({bare(t) for _, t, *_ in corpus()})
    finally:
        shuffled.conf.set("spark.sql.shuffle.partitions", 4)


@pytest.mark.parametrize("hot", [substring_dedup.HOT, 1])
def test_repeats_shuffled(shuffled, hot):
    assert ordered(substring_dedup.strip_repeats(frame(shuffled, clash=True), hot=hot, digest=True).collect()) == ordered(by_hand_cut(corpus()))


def test_mixing_and_urls_shuffled(shuffled):
    got = mixing.amounts(frame(shuffled, clash=True))
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()
    assert len(got.collect()) == len(corpus())
    df = shuffled.createDataFrame(PAGES, "page_id long, url string, html string")
    assert ordered(url_trust.judge(df).drop("trust", "distrust").collect()) == ordered(by_hand_verdicts(PAGES))


def test_pipeline_shuffled(shuffled, tmp_path):
    import corpus_pipeline as P

    frame(shuffled).write.parquet(str(tmp_path / "documents.parquet"))
    assert ordered(P.run(shuffled, str(tmp_path)).collect()) == ordered(by_hand(corpus()))


def test_chain_of_bands_stays_linear(spark, monkeypatch):
    """50,000 texts, each with the next one's bands but not alike (0.78): copies grow with the rows, not their square."""
    monkeypatch.setattr(near_dup, "BLOCK", 256)
    n = 50_000
    text = F.array_join(F.transform(F.sequence(7 * F.col("id"), 7 * F.col("id") + 59), lambda i: F.concat(F.lit("w"), i.cast("string"))), " ")
    rows = near_dup._rows(spark.range(n).select(F.col("id").alias("doc_id"), text.alias("text")))
    scratch = Scratch(spark)
    places = near_dup._candidates(scratch.put(near_dup._sketched(rows)), scratch)
    got = places.select(F.explode("places").alias("p")).agg(F.sum("p.blocks").alias("copies"), F.count_if(F.col("p.own") >= 0).alias("banded")).first()
    assert places.count() > 0.9 * n and got.banded > 0.7 * got.copies
    assert got.copies < 30 * n


def test_recall_at_the_threshold():
    """Pairs of similarity 0.80 to 0.85 share a band and outlive the Bayesian rule."""
    rng = np.random.default_rng(6)
    found = total = 0
    for _ in range(1500):
        size = int(rng.integers(40, 200))
        same = int(np.ceil(rng.uniform(0.80, 0.85) * 2 * size / 1.8))
        same = min(same, size)
        pool = rng.integers(0, 2**63, 2 * size - same).astype(np.uint64)
        a, b = np.sort(pool[:size]), np.sort(pool[size - same :])
        if not 0.8 <= same / (2 * size - same) <= 0.85:
            continue
        total += 1
        sig = near_dup.minhash([a, b])
        shared = (sig[0] == sig[1]).reshape(near_dup.BANDS, near_dup.ROWS).all(1).any()
        found += bool(shared and len(near_dup.bayes_pairs(sig[:1], sig[1:], False)[0]))
    assert total > 400 and found / total >= 0.99


def test_a_round_is_one_join_and_one_sum(spark):
    ranks = spark.createDataFrame([("a", 0, 1.0, True, 1.0), ("b", 0, 0.0, False, 0.0)], "host string, way int, seed double, sends boolean, rank double")
    moves = spark.createDataFrame([(0, "a", "b", 1.0)], "way int, src string, dst string, p double")
    plan = url_trust.spread(ranks, moves)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and plan.count("Aggregate ") == 1
    got = {r.host: r["rank"] for r in url_trust.spread(ranks, moves).collect()}
    assert got == pytest.approx({"a": 0.15, "b": 0.85})


def test_a_hub_with_a_third_of_the_links(spark):
    rng = np.random.default_rng(2)
    hosts = 400
    edges = {(int(a), int(b)): 1 for a, b in rng.integers(0, hosts, (1200, 2)) if a != b} | {(0, k): 3 for k in range(1, hosts)} | {(k, 0): 2 for k in range(1, hosts, 2)}
    seeds = {k: float(k % 7 == 0) for k in range(hosts)}
    total = sum(seeds.values())
    m = np.zeros((hosts, hosts))
    for (u, v), c in edges.items():
        m[u, v] = c
    out = m.sum(1)
    for rows_sent in (m,):
        p = np.divide(rows_sent, out[:, None], out=np.zeros_like(rows_sent), where=out[:, None] > 0)
    seed = np.array([seeds[k] / total for k in range(hosts)])
    rank = seed.copy()
    for _ in range(5):
        rank = 0.15 * seed + 0.85 * (rank @ p + np.where(out > 0, 0, rank))
    s = spark.createDataFrame([(f"h{k}", float(seed[k]), 0.0) for k in range(hosts)], "host string, allowed double, blocked double")
    e = spark.createDataFrame([(f"h{u}", f"h{v}", c) for (u, v), c in edges.items()], "src string, dst string, n long")
    got = {r.host: r.trust for r in url_trust.propagate(s, e, 5).collect()}
    assert got == pytest.approx({f"h{k}": rank[k] for k in range(hosts)})
