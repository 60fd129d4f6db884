"""Repeated byte strings: every byte covered by a LENGTH-byte string that starts anywhere else goes.

The suffixes of all texts, ordered through LENGTH bytes only, fall into equal groups; the groups of
two or more are exactly the repeated windows.  Two steps first set aside what needs no ordering, then
most-significant-digit passes over the windows' own bytes decide:

1. Partition.  Each window has a *pick*, one GRAM-byte string inside it, chosen by content (the least
   hash, the rightmost of equals), and the offset at which it lies.  Equal windows have equal picks at
   equal offsets.  Consecutive windows share their pick, so this step handles *anchors* (one for about 70
   windows).  Windows whose pick occurs once are singletons and done.
2. Whole spans.  Where the bytes that two anchors' windows span have one 128-bit digest, all their windows
   repeat.  What is left are anchors that agree in the pick but not in the whole span.
3. Digits.  Those anchors' spans, one copy of each, meet by pick.  Their windows, grouped by pick and
   offset, are sorted by one digit of DIGIT bytes after another, from the first to the last of LENGTH;
   a pass drops the suffixes that are alone in their group, and what survives the last pass is equal
   byte for byte.  Picks with more than HOT different spans are not gathered in one task: there a row
   a window is dealt by a 128-bit digest of the whole window and counted by Spark.

So digests decide identical texts (64 bits and the size), identical spans and the windows of the most
frequent picks (128 bits); bytes decide every other window.  Counting before the shuffle collapses
copies: identical texts are one occurrence by content until the end, where a text that occurs in two
rows repeats in whole.  Texts longer than SLICE are cut into overlapping slices, so memory is bounded by
the slice; no window is lost.

What the documents are joined with (their runs of windows) is broadcast if its measured size allows
it; else the join is shuffled.

Defined results: a null text counts as empty; a text of under LENGTH bytes loses nothing; bytes may
be cut inside a character (the rest is a byte string); rows that repeat a doc_id are separate
occurrences; a very long text is searched whole; an empty table gives an empty result; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, batch, map_batches, partitions, small_side, table, text_bytes

LENGTH = 200
GRAM = 64
PICK = LENGTH - GRAM + 1
SLICE = 1 << 20
CHUNK = 1 << 20
HOT = 2_000
#: Spans that are sorted together.
GROUP_SPANS = 8_000
#: Bytes of a digit.
DIGIT = 8

_U = np.uint64
_MASK = _U(0xFFFFFF)
_HALF = (1 << 64) - 1
_ODD = _U(0x9E3779B97F4A7C15)
_BYTE = np.array([xxhash.xxh3_64_intdigest(bytes([b])) | 1 for b in range(256)], _U)


def _gram_hashes(flat: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of the ``width`` (a power of two) bytes from each position."""
    h, step = _BYTE[flat], 1
    while step < width:
        n = len(h) - step
        if n <= 0:
            return np.empty(0, _U)
        right = h[step:]
        h = (h[:n] * _ODD) ^ (right + (right >> _U(29)))
        step *= 2
    h = h * _ODD
    return h ^ (h >> _U(31))


def _window_min(k: np.ndarray) -> np.ndarray:
    span = 1
    while span * 2 <= PICK:
        k = np.minimum(k[:-span], k[span:])
        span *= 2
    rest = PICK - span
    return np.minimum(k[:-rest], k[rest:]) if rest else k


def _slices(texts: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
    """(row, offset, bytes) of slices that hold every window once, in chunks."""
    out, held = [], 0
    for row, text in enumerate(texts):
        for at in range(0, len(text) - LENGTH + 1, SLICE):
            part = text[at : at + SLICE + LENGTH - 1] if len(text) > SLICE else text
            out.append((row, at, part))
            held += len(part)
            if held >= CHUNK:
                yield out
                out, held = [], 0
    if out:
        yield out


def anchors(texts: list[bytes], spans: bool) -> dict[str, np.ndarray]:
    """row, lo, n, off, pick (and span) of every anchor: windows lo .. lo + n - 1 of the row's text
    have the pick at lo + off."""
    got: dict[str, list] = {k: [] for k in ("row", "lo", "n", "off", "pick", "span", "span2")}
    for chunk in _slices(texts):
        raw = b"".join(p for _, _, p in chunk)
        flat = np.frombuffer(raw, np.uint8)
        size = np.array([len(p) for _, _, p in chunk])
        start = np.cumsum(size) - size
        h = _gram_hashes(flat, GRAM)
        k = (h & ~_MASK) | (_MASK - np.arange(len(h), dtype=_U))
        least = _window_min(k)
        # windows that lie in one slice
        step = np.zeros(len(flat) + 1, np.int8)
        step[start] += 1
        step[start + size - LENGTH + 1] -= 1
        at = np.flatnonzero(np.cumsum(step[: len(least)]))
        pick = least[at]
        first = np.flatnonzero(np.concatenate(([True], pick[1:] != pick[:-1])))
        lo = at[first]
        n = np.diff(np.append(first, len(at)))
        pos = (_MASK - (pick[first] & _MASK)).astype(np.int64)
        which = np.searchsorted(start, lo, side="right") - 1
        got["row"].append(np.array([r for r, _, _ in chunk])[which])
        got["lo"].append(lo - start[which] + np.array([o for _, o, _ in chunk])[which])
        got["n"].append(n)
        got["off"].append(pos - lo)
        got["pick"].append(h[pos])
        if spans:
            view = memoryview(raw)
            digests = [xxhash.xxh3_128_intdigest(view[a:b]) for a, b in zip(lo.tolist(), (lo + n + LENGTH - 1).tolist())]
            got["span"].append(np.fromiter((x & _HALF for x in digests), _U, len(lo)))
            got["span2"].append(np.fromiter((x >> 64 for x in digests), _U, len(lo)))
    return {k: np.concatenate(v) if v else np.empty(0, _U if k in ("pick", "span", "span2") else np.int64) for k, v in got.items()}


def _long(x: np.ndarray) -> np.ndarray:
    return x.astype(_U).view(np.int64)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a ^ (b + _ODD + (a << _U(6)) + (a >> _U(2)))) * _U(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> _U(29))


def tied_windows(flat: np.ndarray, at: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Which windows (at ``at`` in ``flat``) equal another of their ``group``: passes over byte digits."""
    alive = np.arange(len(at))
    _, held = np.unique(group, return_inverse=True)
    width = np.arange(DIGIT)
    for off in range(-DIGIT, LENGTH, DIGIT):
        if off < 0:  # the groups given
            order = np.argsort(held, kind="stable")
            s = held[order]
            new = s[1:] != s[:-1]
        else:
            digit = flat[(at[alive] + off)[:, None] + width].view(">u8")[:, 0].astype(_U)
            order = np.lexsort((digit, held))
            s, d = held[order], digit[order]
            new = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
        first = np.concatenate(([True], new))
        tie = ~(first & np.concatenate((new, [True])))
        held = (np.cumsum(first) - 1)[tie]
        alive = alive[order[tie]]
        if not len(alive):
            break
    return np.sort(alive)


def _spans(rows: DataFrame, ship: DataFrame) -> DataFrame:
    """pick, hot, uid, size, lo, n, off and the bytes of the anchors in ``ship``, read from the texts."""
    schema = pa.schema(
        [("pick", pa.int64()), ("hot", pa.bool_()), ("uid", pa.int64()), ("size", pa.int64()), ("lo", pa.int64()), ("n", pa.int64()), ("off", pa.int64()), ("bytes", pa.binary())]
    )

    def make():
        def fn(b):
            out: list[list] = [[] for _ in schema]
            for uid, size, text, items in zip(*(c.to_pylist() for c in b.columns)):
                for x in items:
                    lo, n = x["lo"], x["n"]
                    for col, v in zip(out, (x["pick"], x["hot"], uid, size, lo, n, x["off"], text[lo : lo + n + LENGTH - 1])):
                        col.append(v)
            return batch(schema, out)

        return fn

    joined = rows.join(ship, ["uid", "size"]).filter("rep IS NULL OR doc_id = rep").select("uid", "size", "text", "items")
    return map_batches(joined, make, "pick long, hot boolean, uid long, size long, lo long, n long, off long, bytes binary")


_RUN = pa.schema([("uid", pa.int64()), ("size", pa.int64()), ("lo", pa.int64()), ("n", pa.int64())])


def _windows(cols: dict[str, list]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(flat bytes, place of each window in it, its span's number, its number in the span)."""
    n = np.array(cols["n"])
    raw = b"".join(cols["bytes"])
    base = np.cumsum([0, *map(len, cols["bytes"])])[:-1]
    span = np.repeat(np.arange(len(n)), n)
    j = np.arange(len(span)) - np.repeat(np.cumsum(n) - n, n)
    return np.frombuffer(raw, np.uint8), base[span] + j, span, j


def _group_runs(cols: dict[str, list]) -> pa.RecordBatch:
    """The runs of repeated windows among the spans given; equal picks are all here."""
    seen: set = set()
    keep = [i for i, k in enumerate(zip(cols["uid"], cols["size"], cols["lo"])) if k not in seen and not seen.add(k)]
    cols = {k: [v[i] for i in keep] for k, v in cols.items()}
    flat, at, span, j = _windows(cols)
    pick, off = np.array(cols["pick"]).view(_U)[span], np.array(cols["off"])[span]
    tied = tied_windows(flat, at, _mix(pick, (off - j).astype(_U)))
    s, jj = span[tied], j[tied]
    new = np.ones(len(tied), bool)
    new[1:] = (s[1:] != s[:-1]) | (jj[1:] != jj[:-1] + 1)
    first = np.flatnonzero(new)
    s0 = s[first]
    col = lambda k: np.array(cols[k], np.int64)[s0]
    return batch(_RUN, [col("uid"), col("size"), col("lo") + jj[first], np.diff(np.append(first, len(tied)))])


def _sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For spans in the order of their picks: whole groups, some thousand spans at a time."""
    held: list[pa.RecordBatch] = []
    count = 0

    def work(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts)
        return _group_runs({k: t.column(k).to_pylist() for k in t.schema.names})

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        count += b.num_rows
        if count >= GROUP_SPANS:
            picks = b.column(b.schema.get_field_index("pick")).to_numpy()
            earlier = np.flatnonzero(picks != picks[-1])
            cut = int(earlier[-1]) + 1 if len(earlier) else 0
            if cut:
                yield work([*held[:-1], b.slice(0, cut)])
                held, count = [b.slice(cut)], b.num_rows - cut
    if held:
        yield work(held)


def _hot_runs(spans: DataFrame, scratch: Scratch) -> DataFrame:
    """The same for picks with very many spans: a row for each window, grouped by Spark."""
    schema = pa.schema([("key", pa.binary()), ("uid", pa.int64()), ("size", pa.int64()), ("lo", pa.int64())])

    def make():
        def fn(b):
            cols = {k: b.column(i).to_pylist() for i, k in enumerate(b.schema.names)}
            flat, at, span, j = _windows(cols)
            view = memoryview(flat)
            keys = [xxhash.xxh3_128_digest(view[i : i + LENGTH]) for i in at.tolist()]
            col = lambda k: np.array(cols[k], np.int64)[span]
            return batch(schema, [keys, col("uid"), col("size"), col("lo") + j])

        return fn

    rows = map_batches(spans, make, "key binary, uid long, size long, lo long").withColumn("occ", F.xxhash64("uid", "size", "lo"))
    many = rows.groupBy("key").agg(F.min("occ").alias("a"), F.max("occ").alias("b")).filter("a <> b").select("key")
    return rows.join(small_side(scratch.put(many), 32), "key", "left_semi").select("uid", "size", "lo", F.lit(1).cast("long").alias("n"))


def repeated_runs(rows: DataFrame, scratch: Scratch, hot: int = HOT) -> DataFrame:
    """uid, size and ``runs`` (start * 256 + count of repeated windows) of the texts in ``rows``.

    ``rows``: doc_id, uid, size, text (binary).  Repeats by whole copies of a text are not in it.
    """
    n = partitions(rows.sparkSession)

    def picks():
        def fn(b):
            got = anchors(b.column(2).to_pylist(), False)
            if not len(got["row"]):
                return batch(pick_schema, [[], [], []])
            uid = b.column(0).to_numpy()[got["row"]].view(_U)
            occ = _mix(_mix(uid, b.column(1).to_numpy()[got["row"]].view(_U)), got["lo"].view(_U)).view(np.int64)
            order = np.argsort(got["pick"])
            pick, occ = got["pick"][order], occ[order]
            at = np.flatnonzero(np.concatenate(([True], pick[1:] != pick[:-1])))
            return batch(pick_schema, [_long(pick[at]), np.minimum.reduceat(occ, at), np.maximum.reduceat(occ, at)])

        return fn

    pick_schema = pa.schema([("pick", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])
    long_rows = rows.filter(F.col("size") >= LENGTH)
    first = map_batches(long_rows.select("uid", "size", "text"), picks, "pick long, a long, b long")
    again = first.groupBy("pick").agg(F.min("a").alias("a"), F.max("b").alias("b")).filter("a <> b").select("pick")
    again = scratch.put(again)

    span_schema = pa.schema([("pick", pa.int64()), ("span", pa.int64()), ("span2", pa.int64()), ("uid", pa.int64()), ("size", pa.int64()), ("lo", pa.int64()), ("n", pa.int64()), ("off", pa.int64())])

    def spans():
        def fn(b):
            got = anchors(b.column(2).to_pylist(), True)
            row = got["row"]
            return batch(span_schema, [_long(got["pick"]), _long(got["span"]), _long(got["span2"]), b.column(0).to_numpy()[row], b.column(1).to_numpy()[row], got["lo"], got["n"], got["off"]])

        return fn

    every = map_batches(long_rows.select("uid", "size", "text"), spans, "pick long, span long, span2 long, uid long, size long, lo long, n long, off long")
    tied = every.join(small_side(again, 16), "pick", "left_semi").withColumn("occ", F.xxhash64("uid", "size", "lo"))
    tied = scratch.put(tied)
    scratch.drop(again)
    # both are written, so that each join has shuffles of its own, which may be split at a frequent pick
    second = scratch.put(tied.groupBy("pick", "span", "span2").agg(F.min("occ").alias("a"), F.max("occ").alias("b")))
    kinds = scratch.put(second.groupBy("pick").agg(F.count(F.lit(1)).alias("kinds")))
    joined = second.join(kinds, "pick").select("pick", "span", "span2", "a", (F.col("a") != F.col("b")).alias("twice"), "kinds")
    told = scratch.put(tied.join(joined, ["pick", "span", "span2"]).filter((F.col("kinds") > 1) & (F.col("occ") == F.col("a")) | F.col("twice")))
    scratch.drop(tied, second, kinds)

    copies = rows.groupBy("uid", "size").agg(F.count(F.lit(1)).alias("rows"), F.min("doc_id").alias("rep")).filter("rows > 1").select("uid", "size", "rep")
    ship = told.filter((F.col("kinds") > 1) & (F.col("occ") == F.col("a"))).groupBy("uid", "size")
    ship = ship.agg(F.collect_list(F.struct("pick", (F.col("kinds") > hot).alias("hot"), "lo", "n", "off")).alias("items")).join(copies, ["uid", "size"], "left")
    ship = scratch.put(ship)
    gathered = scratch.put(_spans(long_rows, small_side(ship, F.size("items") * 64 + 64)))
    cold = gathered.filter("NOT hot").drop("hot").repartition(n, "pick").sortWithinPartitions("pick").mapInArrow(_sorted_groups, "uid long, size long, lo long, n long")
    runs = told.filter("twice").select("uid", "size", "lo", "n").unionByName(cold)
    if not gathered.filter("hot").isEmpty():
        runs = runs.unionByName(_hot_runs(gathered.filter("hot").drop("hot"), scratch))
    out = scratch.put(runs.groupBy("uid", "size").agg(F.collect_list(F.col("lo") * 256 + F.col("n")).alias("runs")))
    scratch.keep(out)
    return out


def cut(text: bytes, runs: list[int] | None, whole: bool) -> tuple[bytes, int, int]:
    """(what is left, bytes removed, maximal removed runs)."""
    size = len(text)
    if size < LENGTH or not (whole or runs):
        return text, 0, 0
    if whole:
        return b"", size, 1
    packed = np.array(runs)
    lo = packed >> 8
    hi = lo + (packed & 255) + LENGTH - 1
    step = np.bincount(lo, minlength=size + 1) - np.bincount(hi, minlength=size + 1)
    gone = np.cumsum(step)[:size] > 0
    spans = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
    left = np.frombuffer(text, np.uint8)[~gone].tobytes()
    return left, size - len(left), spans


def strip_repeats(df: DataFrame, hot: int = HOT, digest: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and ``kept`` (bytes; with ``digest``: ``kept_sha256``)."""
    scratch = Scratch(df.sparkSession)
    text = text_bytes()
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("uid"), F.octet_length(text).cast("long").alias("size"), text.alias("text"))
    runs = repeated_runs(rows, scratch, hot)
    copied = scratch.put(rows.filter(F.col("size") >= LENGTH).groupBy("uid", "size").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1"))
    info = scratch.put(runs.join(copied, ["uid", "size"], "full_outer").select("uid", "size", F.when(F.col("rows").isNull(), F.col("runs")).alias("runs"), F.col("rows").isNotNull().alias("whole")))
    joined = rows.join(small_side(info, F.coalesce(F.size("runs"), F.lit(0)) * 8 + 48), ["uid", "size"], "left")
    last = ("kept_sha256", pa.string()) if digest else ("kept", pa.binary())
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), last])

    def make():
        def fn(b):
            texts = b.column(1).to_pylist()
            got = [cut(*x) for x in zip(texts, b.column(2).to_pylist(), b.column(3).to_pylist())]
            kept = [hashlib.sha256(x[0]).hexdigest() if digest else x[0] for x in got]
            return batch(schema, [b.column(0), [len(t) for t in texts], [x[1] for x in got], [x[2] for x in got], kept])

        return fn

    ddl = f"doc_id long, n_bytes long, n_removed long, n_spans long, {last[0]} {'string' if digest else 'binary'}"
    return map_batches(joined.select("doc_id", "text", "runs", F.coalesce("whole", F.lit(False)).alias("whole")), make, ddl)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strip_repeats(table(spark, sf_dir, "documents"), digest=True)
