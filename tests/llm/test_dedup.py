"""Exact copies, near copies and repeated byte strings against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from terralume.llm import exact_dedup, near_dup, substring_dedup

from .fixtures import SCHEMA, corpus, frame, ordered


def bare(text):
    return re.sub(r"[\x20\x09-\x0D]+", "", text or "")


def by_hand_groups(rows):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[bare(text)].append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    out = []
    for norm, members in groups.items():
        members.sort()
        sha = hashlib.sha256(norm.encode()).hexdigest()
        out += [(m[3], members[0][3], len(members), k == 0, sha) for k, m in enumerate(members)]
    return out


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_exact_groups(spark, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = exact_dedup.groups(frame(spark, clash=True)).collect()
        assert ordered(got) == ordered(by_hand_groups(corpus()))
        kept = exact_dedup.drop_copies(frame(spark, clash=True))
        assert kept.columns == frame(spark, clash=True).columns
        rows = kept.collect()
        assert len(rows) == len({bare(r.text) for r in rows}) == len({bare(t) for _, t, *_ in corpus()})
        want = {(g[4], g[0]) for g in by_hand_groups(corpus()) if g[3]}
        assert {(hashlib.sha256(bare(r.text).encode()).hexdigest(), r.doc_id) for r in rows} == want
        assert {r.kept for r in rows} == {"<kept>"}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_exact_hot_group_is_split(spark):
    rows = [(i, "the same text", "en", "s", 1) for i in range(3000)] + [(5000 + i, f"other {i}", "en", "s", 1) for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA).select("doc_id", "text")
    spark.conf.set("spark.sql.shuffle.partitions", 16)
    try:
        parts = Counter(r.part for r in exact_dedup._runs(df).select("part").collect())
        assert max(parts.values()) < 1500
        got = exact_dedup.groups(df).filter("kept").collect()
        assert len(got) == 3001 and {r.keep_id for r in got if r.group_size > 1} == {0}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_exact_empty(spark):
    assert exact_dedup.groups(frame(spark, [])).count() == 0 and exact_dedup.drop_copies(frame(spark, [])).count() == 0


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def by_hand_classes(rows):
    sets = list({shingles(t) for _, t, *_ in rows})
    links, up = Counter(), {s: s for s in sets}

    def top(s):
        while up[s] != s:
            s = up[s]
        return s

    for i, a in enumerate(sets):
        for b in sets[:i]:
            if a and b and 5 * len(a & b) >= 4 * len(a | b):
                links[a] += 1
                links[b] += 1
                up[top(a)] = top(b)
    classes = defaultdict(list)
    for doc_id, t, *_ in rows:
        classes[top(shingles(t))].append(doc_id)
    out = []
    for doc_id, t, *_ in rows:
        m = classes[top(shingles(t))]
        out.append((doc_id, min((x for x in m if x is not None), default=None), len(m), links[shingles(t)], len(shingles(t))))
    return out, classes


@pytest.mark.parametrize("block", [128, 4])
def test_near_classes(spark, monkeypatch, block):
    monkeypatch.setattr(near_dup, "BLOCK", block)
    want, classes = by_hand_classes(corpus())
    assert ordered(near_dup.near_classes(frame(spark, clash=True)).collect()) == ordered(want)
    assert max(w[3] for w in want) > 5
    kept = near_dup.drop_near(frame(spark, clash=True))
    assert kept.columns == frame(spark, clash=True).columns
    rows = kept.collect()
    assert len(rows) == len(classes)
    assert ordered([(r.doc_id,) for r in rows]) == ordered([(min((x for x in m if x is not None), default=None),) for m in classes.values()])


def test_links_are_all_pairs(spark):
    sets = {}
    df = frame(spark)
    uid = {r.doc_id: r.uid for r in near_dup.members(df).collect()}
    got = {frozenset((r.a, r.b)) for r in near_dup.links(df).collect()}
    for doc_id, t, *_ in corpus():
        sets[uid[doc_id]] = shingles(t)
    ids = [u for u in sets if sets[u]]
    want = {frozenset((a, b)) for i, a in enumerate(ids) for b in ids[:i] if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    assert got == want and got


def test_near_empty(spark):
    assert near_dup.near_classes(frame(spark, [])).count() == 0 and near_dup.drop_near(frame(spark, [])).count() == 0


def test_bayes_keeps_pairs_at_the_threshold():
    rng = np.random.default_rng(0)
    lost = 0
    for _ in range(300):
        hit = rng.random(near_dup.HASHES) < 0.8
        a = np.arange(near_dup.HASHES, dtype=np.uint32)[None]
        b = np.where(hit, a, a + 1000)
        i, _ = near_dup.bayes_pairs(a, b.astype(np.uint32), False)
        lost += not len(i)
        j, _ = near_dup.bayes_pairs(a, np.where(rng.random(near_dup.HASHES) < 0.3, a, a + 1000).astype(np.uint32), False)
        assert not len(j)
    assert lost == 0


def test_more_distinct_words_than_the_memo_holds(monkeypatch):
    texts = [b"short and known", b" ".join(b"w%d" % (i % 60) for i in range(90)), b"short and known again", b"one two three four five six"]
    want = [near_dup.Shingler()(t) for t in texts]
    monkeypatch.setattr(near_dup, "CACHE", 8)
    s = near_dup.Shingler()
    for _ in range(2):
        for t, w in zip(texts, want):
            assert np.array_equal(s(t), w) and len(s.words) <= 8


def test_minhash_estimates_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 900).astype(np.uint64)
    a, b = np.sort(pool[:800]), np.sort(pool[100:])
    sig = near_dup.minhash([a, b])
    assert abs((sig[0] == sig[1]).mean() - 700 / 900) < 0.09


def by_hand_cut(rows, n=substring_dedup.LENGTH):
    texts = [(d, (t or "").encode()) for d, t, *_ in rows]
    seen = Counter(t[i : i + n] for _, t in texts for i in range(len(t) - n + 1))
    out = []
    for d, t in texts:
        step = np.zeros(len(t) + 1, int)
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                step[i] += 1
                step[i + n] -= 1
        gone = np.cumsum(step)[: len(t)] > 0
        left = bytes(np.frombuffer(t, np.uint8)[~gone]) if t else b""
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((d, len(t), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()))
    return out


@pytest.mark.parametrize(("hot", "slice_"), [(20_000, 1 << 20), (1, 1 << 20), (20_000, 700)])
def test_repeats(spark, monkeypatch, hot, slice_):
    monkeypatch.setattr(substring_dedup, "SLICE", slice_)
    got = substring_dedup.strip_repeats(frame(spark, clash=True), hot=hot, digest=True)
    assert ordered(got.collect()) == ordered(by_hand_cut(corpus()))


def test_anchors_hold_every_window_once(monkeypatch):
    rng = np.random.default_rng(3)
    text = rng.integers(97, 100, 3000).astype(np.uint8).tobytes()
    for size in (1 << 20, 450):
        monkeypatch.setattr(substring_dedup, "SLICE", size)
        got = substring_dedup.anchors([b"short", text, text[:200]], False)
        own = got["row"] == 1
        at = np.concatenate([np.arange(lo, lo + n) for lo, n in zip(got["lo"][own], got["n"][own])])
        assert sorted(at.tolist()) == list(range(len(text) - 199))
        assert (got["row"] == 2).sum() == 1 and (got["row"] == 0).sum() == 0


def test_repeats_empty_and_whole_texts(spark):
    assert substring_dedup.strip_repeats(frame(spark, [])).count() == 0
    kept = substring_dedup.strip_repeats(frame(spark, [(1, "a" * 199, "", "", 1), (2, "a" * 199, "", "", 1), (3, "b" * 201, "", "", 1)])).orderBy("doc_id").collect()
    assert [bytes(r.kept) for r in kept] == [b"a" * 199, b"a" * 199, b""]


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_exact_copies_behind_space_and_shared_beginnings(spark, parts):
    start = "the same beginning " * 53
    rows = [(i, f"{' ' * 150}{start}{i % 40}" if i % 3 == 0 else f"{start}{i % 40}\n", "", "", 1) for i in range(300)]
    rows += [(1000 + i, f"filler {i}", "", "", 1) for i in range(400)]
    rows += [(9007, " " * 200 + "one text twice with one id", "", "", 1), (9007, "one text twice with one id" + " " * 200, "", "", 1)]
    rows += [(2000 + i, "hot copy", "", "", 1) for i in range(500)] + [(None, "hot copy", "", "", 1)] * 3
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = spark.createDataFrame(rows, SCHEMA).repartition(5)
        got = exact_dedup.groups(df).collect()
        assert ordered(got) == ordered(by_hand_groups(rows))
        kept = exact_dedup.drop_copies(df).collect()
        assert ordered((r.doc_id, bare(r.text)) for r in kept) == ordered((d, bare(next(t for e, t, *_ in rows if e == d))) for d, _, _, k, _ in by_hand_groups(rows) if k)
        assert sum(bare(r.text) == "onetexttwicewithoneid" for r in kept) == 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_exact_order_of_ranges_is_the_order_of_texts(spark):
    spark.conf.set("spark.sql.shuffle.partitions", 16)
    try:
        df = frame(spark).select("doc_id", "text").union(spark.range(600).selectExpr("id + 5000", "concat('  same start ', id % 200)"))
        ends = defaultdict(list)
        for r in exact_dedup._runs(df).select("part", "shared", "norm").collect():
            if not r.shared:
                ends[r.part].append(r.norm.encode())
        spans = sorted((min(v), max(v)) for v in ends.values())
        assert len(spans) > 4 and all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
        assert [min(ends[k]) for k in sorted(ends)] == [s[0] for s in spans]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_exact_is_native(spark):
    for out in (exact_dedup.groups(frame(spark)), exact_dedup.drop_copies(frame(spark))):
        assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().executedPlan().toString())
