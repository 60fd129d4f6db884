"""Similarity join on word shingles: Jaccard of ``WORDS``-word shingle sets at or above ``LEAST``.

1. Each text becomes a set of 64-bit shingle hashes.  Texts with one set are one *class
   representative* (uid, the hash of the set); all later steps see representatives only.
2. ``HASHES`` MinHash values are taken of each set.  Candidates share a band of ``ROWS`` values; a
   pair at the threshold shares none of the ``BANDS`` bands with probability 5e-6, the only place
   where a link could be lost before the Bayesian rule.  Band keys held by one set are dropped after
   a count; the rest link to the smallest holder, and components of those links are *units*: no pair
   with a common band lies in two of them.
3. Each unit is dealt to jobs in the cheaper of two exact ways, counted beforehand.  Either all its
   pairs meet: its rows are hashed into blocks of at most about ``BLOCK`` rows and ``BLOCK_BYTES``, every
   two blocks are a job, and a row is copied once for each block.  Or only pairs that share a band meet:
   a row is copied once for each of its shared bands (``BANDS`` at most) and block of that band, and a
   pair counts in its first common band alone.  So a unit of similar texts costs what its links cost,
   and a long chain of texts that are linked by bands but not alike stays linear in its rows.
4. Bayesian pruning.  Inside a job, pairs compare MinHash values ``STEP`` at a time.  With m of n
   equal and a uniform prior, the posterior probability of similarity >= LEAST is a binomial sum;
   pairs for which it falls below ``TOLERANCE`` are dropped.
5. Pairs left are verified exactly on the shingle sets.

A job returns counts of links and a spanning forest, never the pairs; pairs can be asked for
(``links``).  Its memory is two blocks, whatever the unit's size.

Defined results: words are runs of anything but ASCII white space; a text of 1 to 4 words has one
shingle, all of them; texts without words (null, empty) have the empty set and form one class, with
no links to others; rows that repeat a doc_id are rows of their own; ``n_links`` counts other
representatives, not copies; a very long text is one row of its block; ties go to the smallest
doc_id (null last), then the smallest hash of the text; other columns, whatever their names, are
returned untouched; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb, isqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import components
from .common import Scratch, batch, map_batches, partitions, small_side, table, text_bytes

WORDS = 5
LEAST = 0.8
ROWS = 6
BANDS = 40
HASHES = ROWS * BANDS
STEP = 24
TOLERANCE = 1e-6
#: Most rows, and bytes of signatures and sets, of a block; smaller blocks, of FEW rows at least, are cut
#: while a unit gives fewer jobs than there are tasks.
BLOCK = 1024
BLOCK_BYTES = 8 << 20
FEW = 128
#: Word hashes that a task remembers, of words of at most CACHE_BYTES.
CACHE = 200_000
CACHE_BYTES = 64

_U = np.uint64
#: Odd multipliers: each permutes the 32-bit values.
_MULT = np.array([xxhash.xxh3_64_intdigest(b"minhash %d" % i) & 0xFFFFFFFF | 1 for i in range(HASHES)], np.uint32)


class _Hashes(dict):
    """Hash of each word; forgets all when full."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= CACHE_BYTES:
            if len(self) >= CACHE:
                self.clear()
            self[word] = h
        return h


class Shingler:
    """Texts to sorted arrays of shingle hashes; memory is bounded by the text and the memo."""

    def __init__(self):
        self.words = _Hashes()

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.split()
        if not words:
            return np.empty(0, _U)
        h = np.fromiter(map(self.words.__getitem__, words), _U, len(words))
        n = max(1, len(h) - WORDS + 1)
        k = min(WORDS, len(h))
        acc = np.full(n, k, _U)
        for i in range(k):
            acc = (acc ^ h[i : i + n]) * _U(0x9E3779B97F4A7C15)
            acc ^= acc >> _U(32)
        return np.unique(acc)


def minhash(sets: list[np.ndarray]) -> np.ndarray:
    """HASHES 32-bit values for each set; non-empty sets only."""
    out = np.empty((len(sets), HASHES), np.uint32)
    for i, s in enumerate(sets):
        x = (s >> _U(32)).astype(np.uint32)
        low = None
        for at in range(0, len(x), 128):
            part = (x[at : at + 128, None] * _MULT).min(0)
            low = part if low is None else np.minimum(low, part)
        out[i] = low
    return out


def least_matches(n: int) -> int:
    """The fewest equal values of n at which the posterior P(similarity >= LEAST) reaches TOLERANCE."""
    for m in range(n + 1):
        if sum(comb(n + 1, j) * LEAST**j * (1 - LEAST) ** (n + 1 - j) for j in range(m + 1)) >= TOLERANCE:
            return m
    return n + 1


_FEWEST = [(n, least_matches(n)) for n in range(STEP, HASHES + 1, STEP)]


def bayes_pairs(a: np.ndarray, b: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of the signature pairs that survive; with ``same`` only i < j."""
    n, fewest = _FEWEST[0]
    got = np.zeros((len(a), len(b)), np.uint8)
    for k in range(n):
        got += a[:, k, None] == b[None, :, k]
    alive = got >= fewest
    if same:
        alive = np.triu(alive, 1)
    i, j = np.nonzero(alive)
    count = got[i, j].astype(np.int64)
    for n, fewest in _FEWEST[1:]:
        if not len(i):
            break
        for at in range(0, len(i), 200_000):
            s = slice(at, at + 200_000)
            count[s] += (a[i[s], n - STEP : n] == b[j[s], n - STEP : n]).sum(1)
        ok = count >= fewest
        i, j, count = i[ok], j[ok], count[ok]
    return i, j


def exact_pairs(a: list[np.ndarray], b: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the pairs have Jaccard similarity LEAST or more: shingles both sides know, as 0/1 rows."""
    if not len(i):
        return np.zeros(0, bool)
    size_a, size_b = np.array([len(a[x]) for x in i]), np.array([len(b[x]) for x in j])
    both = np.zeros(len(i), np.int64)
    rows_a, rows_b = np.unique(i), np.unique(j)
    if len(i) * 8 < len(rows_a) * len(rows_b) or len(i) < 16:
        for p in range(len(i)):
            x, y = a[i[p]], b[j[p]]
            at = np.searchsorted(y, x)
            both[p] = np.count_nonzero(y[np.minimum(at, len(y) - 1)] == x)
    else:
        known = np.intersect1d(np.unique(np.concatenate([a[x] for x in rows_a])), np.unique(np.concatenate([b[x] for x in rows_b])), assume_unique=True)
        place_a, place_b = np.searchsorted(rows_a, i), np.searchsorted(rows_b, j)
        total = np.zeros((len(rows_a), len(rows_b)), np.float32)
        width = 4096

        def held(sets, rows, low, high):
            out = np.zeros((len(rows), width), np.float32)
            for r, x in enumerate(rows):
                s = sets[x]
                s = s[np.searchsorted(s, low) : np.searchsorted(s, high, side="right")]
                at = np.searchsorted(part, s)
                ok = part[np.minimum(at, len(part) - 1)] == s
                out[r, at[ok]] = 1
            return out

        for at in range(0, len(known), width):
            part = known[at : at + width]
            total += held(a, rows_a, part[0], part[-1]) @ held(b, rows_b, part[0], part[-1]).T
        both = total[place_a, place_b].astype(np.int64)
    return both >= LEAST * (size_a + size_b - both) - 1e-9


def _sketched(rows: DataFrame) -> DataFrame:
    """doc_id, text_hash, uid, shingles and band keys (none for the empty set) of each row."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("uid", pa.int64()), ("shingles", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def make():
        shingler = Shingler()

        def fn(b):
            sets = [shingler(t) for t in b.column(2).to_pylist()]
            uid = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], _U).view(np.int64)
            sig = minhash([s for s in sets if len(s)])
            keys = np.zeros((len(sig), BANDS), _U)
            for r in range(ROWS):
                keys = (keys ^ sig[:, r::ROWS].astype(_U)) * _U(0x9E3779B97F4A7C15)
                keys ^= keys >> _U(29)
            keys = ((keys + np.arange(BANDS, dtype=_U)) * _U(0xC2B2AE3D27D4EB4F)).view(np.int64)
            ends = np.concatenate(([0], np.cumsum([BANDS if len(s) else 0 for s in sets]))).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel()))
            return batch(schema, [b.column(0), b.column(1), uid, [len(s) for s in sets], bands])

        return fn

    return map_batches(rows.select("doc_id", "text_hash", "text"), make, "doc_id long, text_hash long, uid long, shingles long, bands array<long>")


_PLACES = "array<struct<grp:bigint,own:int,blocks:int>>"


def _loaded(rows: DataFrame) -> DataFrame:
    """``rows`` (uid, places, text) with signature and set in the text's place."""
    place = pa.struct([("grp", pa.int64()), ("own", pa.int32()), ("blocks", pa.int32())])
    schema = pa.schema([("uid", pa.int64()), ("places", pa.list_(place)), ("sig", pa.binary()), ("set", pa.binary())])

    def make():
        shingler = Shingler()

        def fn(b):
            sets = [shingler(t) for t in b.column(2).to_pylist()]
            return batch(schema, [b.column(0), b.column(1).cast(schema.field(1).type), [x.tobytes() for x in minhash(sets)], [s.tobytes() for s in sets]])

        return fn

    return map_batches(rows, make, f"uid long, places {_PLACES}, sig binary, set binary")


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    up = list(range(n))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for x, y in zip(i.tolist(), j.tolist()):
        a, b = top(x), top(y)
        if a != b:
            up[a] = b
            out.append((x, y))
    return out


_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])


def _first_met(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs whose first common band is ``own``."""
    keep = np.zeros(len(i), bool)
    for at in range(0, len(i), 50_000):
        s = slice(at, at + 50_000)
        upto = ROWS * (own + 1)
        same = (a[i[s], :upto] == b[j[s], :upto]).reshape(-1, own + 1, ROWS).all(2)
        keep[s] = same[:, own] & ~same[:, :own].any(1)
    return i[keep], j[keep]


def _job(rows: dict[str, list], all_pairs: bool) -> list[tuple]:
    """One pair of blocks: (a, b, 0) for forest edges or pairs, (a, null, n) for counts of links."""
    bi, bj, own = rows["bi"][0], rows["bj"][0], rows["own"][0]
    blocks = rows["block"]
    once = {u: k for k, u in enumerate(rows["uid"])}.values()  # rows that repeat a text are one
    left = [k for k in once if blocks[k] == bi]
    right = left if bi == bj else [k for k in once if blocks[k] == bj]
    if not left or not right:
        return []
    load = lambda ks, c, t: [np.frombuffer(rows[c][k], t) for k in ks]
    sig_a, sig_b = np.stack(load(left, "sig", np.uint32)), np.stack(load(right, "sig", np.uint32))
    i, j = bayes_pairs(sig_a, sig_b, bi == bj)
    if own >= 0:
        i, j = _first_met(sig_a, sig_b, i, j, own)
    ok = exact_pairs(load(left, "set", _U), load(right, "set", _U), i, j)
    i, j = i[ok], j[ok]
    if not len(i):
        return []
    uid = rows["uid"]
    ia, jb = np.array(left)[i], np.array(right)[j]
    if all_pairs:
        return [(uid[x], uid[y], 0) for x, y in zip(ia.tolist(), jb.tolist())]
    count = np.bincount(np.concatenate((ia, jb)), minlength=len(uid))
    edges = [(uid[x], uid[y], 0) for x, y in _forest(len(uid), ia, jb)]
    return edges + [(uid[k], None, int(count[k])) for k in np.flatnonzero(count)]


def _jobs(all_pairs: bool):
    keys = ("grp", "own", "bi", "bj")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] | None = None
        now = None
        out: list[tuple] = []
        for b in batches:
            cols = {k: b.column(k).to_pylist() for k in b.schema.names}
            for r, key in enumerate(zip(*(cols[k] for k in keys))):
                if key != now:
                    if held:
                        out += _job(held, all_pairs)
                    held, now = {k: [] for k in cols}, key
                for k, v in cols.items():
                    held[k].append(v[r])
            if len(out) >= 20_000:
                yield batch(_FOUND, [list(c) for c in zip(*out)])
                out = []
        if held:
            out += _job(held, all_pairs)
        if out:
            yield batch(_FOUND, [list(c) for c in zip(*out)])

    return run


def _pick() -> Column:
    """The row that stands for many: smallest doc_id (null last), then smallest hash of the text."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash"))


def _blocks(tasks: int) -> Column:
    """Blocks for rows with ``shingles``, as an aggregate."""
    rows, size = F.count(F.lit(1)), F.sum(F.col("shingles") * 8 + 4 * HASHES)
    spread = F.least(F.ceil(rows / FEW), F.lit(isqrt(2 * tasks) + 1))
    return F.greatest(F.ceil(rows / BLOCK), F.ceil(size / BLOCK_BYTES), spread).cast("int")


def _places(sketch: DataFrame, shared: DataFrame, units: DataFrame, scratch: Scratch) -> DataFrame:
    """uid, pick_id, text_hash (the row that stands for the set) and its places in jobs."""
    blocks = _blocks(partitions(sketch.sparkSession)).alias("blocks")
    picks = sketch.groupBy("uid").agg(_pick().alias("pick"), F.max("shingles").alias("shingles"))
    picks = picks.join(units, picks.uid == units.node).select("uid", "root", "shingles", F.col("pick.doc_id").alias("pick_id"), F.col("pick.text_hash").alias("text_hash"))
    picks = scratch.put(picks)
    large = scratch.put(picks.groupBy("root").agg(blocks, F.count(F.lit(1)).alias("n")).filter("blocks > 1"))
    whole = picks.join(small_side(large, 24), "root", "left")
    plain = lambda df: df.select("uid", "pick_id", "text_hash", F.array(F.struct(F.col("root").alias("grp"), F.lit(-1).alias("own"), F.coalesce("blocks", F.lit(1)).alias("blocks"))).cast(_PLACES).alias("places"))
    if large.isEmpty():
        return plain(whole)
    # rows of large units once for each shared band
    of_large = small_side(scratch.put(whole.filter("blocks IS NOT NULL").select("uid", "root", "shingles", "pick_id", "text_hash")), 48)
    same = (sketch.uid == of_large.uid) & (sketch.text_hash == of_large.text_hash) & sketch.doc_id.eqNullSafe(of_large.pick_id)
    held = sketch.join(of_large, same).select(sketch.uid, "root", sketch.shingles, F.posexplode("bands").alias("own", "band")).distinct()
    held = scratch.put(held.join(shared.select("band"), "band"))
    band = scratch.put(held.groupBy("root", "band").agg(blocks, F.count(F.lit(1)).alias("n")))
    copies = band.groupBy("root").agg(F.sum(F.col("n") * F.col("blocks")).alias("copies")).join(large, "root")
    by_band = small_side(scratch.put(copies.filter(F.col("copies") < F.col("n") * F.col("blocks")).select("root")), 16)
    placed = held.join(by_band, "root", "left_semi").join(small_side(band.filter("n > 1").select("band", "blocks"), 24), "band")
    placed = placed.groupBy("uid").agg(F.collect_list(F.struct(F.col("band").alias("grp"), "own", "blocks")).cast(_PLACES).alias("places"))
    banded = picks.join(by_band, "root", "left_semi").join(placed, "uid").select("uid", "pick_id", "text_hash", "places")
    return plain(whole.join(by_band, "root", "left_anti")).unionByName(banded)


def _candidates(sketch: DataFrame, scratch: Scratch) -> DataFrame:
    """The representatives that share a band with another, and their places in jobs."""
    held = sketch.select("uid", F.explode("bands").alias("band"))
    shared = held.groupBy("band").agg(F.min("uid").alias("low"), F.max("uid").alias("high")).filter("low <> high").select("band", "low")
    shared = small_side(scratch.put(shared), 24)
    near = held.join(shared, "band").filter("uid <> low").select(F.col("uid").alias("a"), F.col("low").alias("b"))
    return scratch.put(_places(sketch, shared, components(near, scratch), scratch))


def _found(rows: DataFrame, sketch: DataFrame, scratch: Scratch, all_pairs: bool) -> DataFrame:
    """What the jobs return: links between representatives that may be similar."""
    n = partitions(rows.sparkSession)
    places = _candidates(sketch, scratch)
    picked = small_side(places, F.size("places") * 24 + 48).withColumnRenamed("text_hash", "pick_hash")
    texts = rows.join(picked, (rows.text_hash == picked.pick_hash) & rows.doc_id.eqNullSafe(picked.pick_id))
    loaded = _loaded(texts.select("uid", "places", "text"))
    dealt = loaded.select("uid", "sig", "set", F.explode("places").alias("at"))
    other = F.explode(F.sequence(F.lit(0), F.col("at.blocks") - 1)).alias("other")
    dealt = dealt.select("at.grp", "at.own", "uid", "sig", "set", F.pmod(F.xxhash64("uid"), F.col("at.blocks").cast("long")).cast("int").alias("block"), other)
    dealt = dealt.select("grp", "own", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "block", "uid", "sig", "set")
    dealt = dealt.repartition(n, "grp", "own", "bi", "bj").sortWithinPartitions("grp", "own", "bi", "bj")
    return scratch.put(dealt.mapInArrow(_jobs(all_pairs), "a long, b long, links long"))


def _rows(df: DataFrame) -> DataFrame:
    text = text_bytes()
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def _classed(df: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, text_hash, uid, shingles, class_key, n_links of each row."""
    rows = _rows(df)
    sketch = scratch.put(_sketched(rows))
    found = _found(rows, sketch, scratch, False)
    classes = components(found.filter("b IS NOT NULL").select("a", "b"), scratch)
    counts = found.filter("b IS NULL").groupBy("a").agg(F.sum("links").alias("n_links"))
    known = scratch.put(classes.join(counts, classes.node == counts.a).select(F.col("node").alias("uid"), F.col("root").alias("class_key"), "n_links"))
    scratch.keep(sketch, known)
    joined = sketch.drop("bands").join(small_side(known, 32), "uid", "left")
    return joined.select("doc_id", "text_hash", "uid", "shingles", F.coalesce("class_key", "uid").alias("class_key"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def near_classes(df: DataFrame) -> DataFrame:
    """doc_id, class_id (smallest doc_id of the class), class_size (rows), n_links, shingles of each row."""
    scratch = Scratch(df.sparkSession)
    rows = scratch.put(_classed(df, scratch))
    scratch.keep(rows)
    # a class of one row needs no join
    classes = rows.groupBy("class_key").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size")).filter("class_size > 1")
    joined = rows.join(small_side(scratch.put(classes), 32), "class_key", "left")
    return joined.select(
        "doc_id", F.when(F.col("class_size").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"), "n_links", "shingles",
    )


def links(df: DataFrame) -> DataFrame:
    """(a, b) of every pair of representatives that are similar, and which rows have them: see ``members``."""
    scratch = Scratch(df.sparkSession)
    rows = _rows(df)
    return _found(rows, scratch.put(_sketched(rows)), scratch, True).select("a", "b")


def members(df: DataFrame) -> DataFrame:
    """doc_id and uid, the representative, of each row."""
    return _sketched(_rows(df)).select("doc_id", "uid")


def drop_near(df: DataFrame) -> DataFrame:
    """The rows of ``df``, all columns, that stay: of each class the row with the smallest doc_id.

    Rows that agree in doc_id and text count once.
    """
    scratch = Scratch(df.sparkSession)
    rows = _classed(df, scratch).groupBy("class_key", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    rows = scratch.put(rows)
    scratch.keep(rows)
    best = rows.groupBy("class_key").agg(_pick().alias("pick"), F.count(F.lit(1)).alias("kinds"))
    joined = rows.join(best.filter("kinds > 1"), "class_key")
    stays = F.col("doc_id").eqNullSafe(F.col("pick.doc_id")) & (F.col("text_hash") == F.col("pick.text_hash"))
    losers = small_side(scratch.put(joined.filter(~stays).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))), 32)
    hashed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col("doc_id").cast("long").alias("_doc"), F.xxhash64(text_bytes()).alias("_text"))
    kept = hashed.join(losers, (hashed["_text"] == losers["_hash"]) & hashed["_doc"].eqNullSafe(losers["_id"]), "left_anti")
    if not rows.filter("n > 1").isEmpty():
        kept = kept.dropDuplicates(["_doc", "_text"])
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in df.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"))
