"""Quality rules from suffix arrays: repetition inside one document.

A suffix array over a document's words puts equal beginnings next to each other; the longest common
prefix (LCP) of neighbours gives its LCP intervals, and every maximal repeated substring is one of
them.  The rule limits the part of the words that lie in repeats of ``MIN_REPEAT`` words or more
(``max_covered``) and the longest repeat (``max_repeat``).  The arrays of many documents are built
together with NumPy by prefix doubling: the first key holds the document's number, so no repeat
crosses documents, and each round sorts only suffixes that are still tied.

Memory: documents are gathered up to ``CHUNK_WORDS`` words; a longer one is handled alone and needs
about 100 bytes for each of its words.

Defined results: a null or empty text has no words, fails the base rule and is not kept; repeated
rows are judged alike; a repeat may overlap itself (``a a a a`` repeats ``a a a``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, few_rows_a_batch, map_batches, pieces, table, text_bytes

#: Production parameters.
BASE_WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_WORDS = 20  # per cent of the words
MIN_REPEAT = 10
MAX_COVERED = 0.20
MAX_REPEAT = 60
CHUNK_WORDS = 400_000

#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
_SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"

_IS_SYMBOL = np.zeros(256, np.int64)
_IS_SYMBOL[list(SYMBOLS)] = 1
#: 1 for the first byte of a character that is not white space.
_IS_CHAR = np.ones(256, np.int64)
_IS_CHAR[0x80:0xC0] = 0
_IS_CHAR[list(_SPACES)] = 0


def suffix_lcp(tokens: np.ndarray, doc: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, LCP of entry k with entry k + 1) of many documents' tokens.

    ``doc`` is each token's document (ascending), ``end`` the position after that document.
    An LCP under ``BASE_WINDOW`` may be given as 0.
    """
    n = len(tokens)
    where = np.arange(n)
    key = doc * (int(tokens.max()) + 1) + tokens
    order = np.argsort(key, kind="stable")
    ranks, rank = [], np.empty(n, np.int64)

    def deal(sorted_pos: np.ndarray, sorted_key: np.ndarray, base: np.ndarray | None) -> np.ndarray:
        """Give each sorted suffix the index of its group's first one; return those still tied."""
        first = np.empty(len(sorted_pos), bool)
        first[0] = True
        np.not_equal(sorted_key[1:], sorted_key[:-1], out=first[1:])
        at = np.flatnonzero(first)
        size = np.diff(np.append(at, len(sorted_pos)))
        start = at if base is None else base[at]
        rank[sorted_pos] = np.repeat(start, size)
        return sorted_pos[np.repeat(size > 1, size)]

    tied = deal(order, key[order], None)
    ranks.append(rank.astype(np.int32))
    h = 1
    while len(tied):
        after = tied + h
        second = np.where(after < end[tied], rank[np.minimum(after, n - 1)] + 1, 0)
        old = rank[tied]
        k = old * (n + 1) + second
        o = np.argsort(k, kind="stable")
        pos, k, old = tied[o], k[o], old[o]
        lead = np.empty(len(pos), bool)
        lead[0] = True
        np.not_equal(old[1:], old[:-1], out=lead[1:])
        at = np.flatnonzero(lead)
        inside = np.arange(len(pos)) - np.repeat(at, np.diff(np.append(at, len(pos))))
        tied = deal(pos, k, old + inside)
        ranks.append(rank.astype(np.int32))
        h *= 2
    sa = np.empty(n, np.int64)
    sa[rank] = where
    lcp = np.zeros(max(n - 1, 0), np.int64)
    level = min(2, len(ranks) - 1)  # equal for four words, else the LCP is too short to matter
    pair = np.flatnonzero(ranks[level][sa[:-1]] == ranks[level][sa[1:]]) if n > 1 else np.empty(0, np.int64)
    p, q = sa[pair], sa[pair + 1]
    off = np.zeros(len(pair), np.int64)
    for j in range(len(ranks) - 1, -1, -1):
        a, b = p + off, q + off
        ok = (a < end[p]) & (b < end[q])
        same = ok & (ranks[j][np.minimum(a, n - 1)] == ranks[j][np.minimum(b, n - 1)])
        off += same.astype(np.int64) << j
    lcp[pair] = off
    return sa, lcp


def _covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    step = np.bincount(starts, minlength=n + 1) - np.bincount(starts + lengths, minlength=n + 1)
    return np.cumsum(step)[:n] > 0


def measure(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The figures of each text, in order: see the column names of ``profile``."""
    size = len(texts)
    lens = np.fromiter(map(len, texts), np.int64, size)
    flat = np.frombuffer(b"".join(texts), np.uint8)
    edge = np.concatenate(([0], np.cumsum(lens)))

    def total(weight: np.ndarray) -> np.ndarray:
        run = np.concatenate(([0], np.cumsum(weight[flat])))
        return run[edge[1:]] - run[edge[:-1]]

    out = {"word_chars": total(_IS_CHAR), "n_symbols": total(_IS_SYMBOL)}
    out |= {k: np.zeros(size, np.int64) for k in ("n_words", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat")}
    chunk: list[tuple[int, list[bytes]]] = []
    held = 0

    def flush() -> None:
        nonlocal chunk, held
        if held:
            _chunk(chunk, out)
        chunk, held = [], 0

    for i, text in enumerate(texts):
        words = text.split()
        out["n_words"][i] = len(words)
        lines = [x for x in text.split(b"\n") if x.strip()]
        out["n_dup_lines"][i] = len(lines) - len(set(lines))
        if held + len(words) > CHUNK_WORDS:
            flush()
        if words:
            chunk.append((i, words))
            held += len(words)
    flush()
    return out


def _chunk(chunk: list[tuple[int, list[bytes]]], out: dict[str, np.ndarray]) -> None:
    ids: dict[bytes, int] = {}
    flat = [w for _, words in chunk for w in words]
    for w in set(flat):
        ids[w] = len(ids)
    tokens = np.fromiter(map(ids.__getitem__, flat), np.int64, len(flat))
    n = len(tokens)
    del flat
    sizes = np.fromiter((len(w) for _, w in chunk), np.int64, len(chunk))
    which = np.repeat(np.arange(len(chunk)), sizes)
    end = np.repeat(np.cumsum(sizes), sizes)
    sa, lcp = suffix_lcp(tokens, which, end)
    best = np.zeros(n, np.int64)  # of each suffix: its longest match elsewhere in the document
    if n > 1:
        best[sa[:-1]] = lcp
        best[sa[1:]] = np.maximum(best[sa[1:]], lcp)
    rows = np.array([i for i, _ in chunk])
    base = np.flatnonzero(best >= BASE_WINDOW)
    out["n_repeat_words"][rows] = np.bincount(which[_covered(base, np.full(len(base), BASE_WINDOW), n)], minlength=len(chunk))
    long = np.flatnonzero(best >= MIN_REPEAT)
    out["covered_words"][rows] = np.bincount(which[_covered(long, best[long], n)], minlength=len(chunk))
    starts = np.cumsum(sizes) - sizes
    out["longest_repeat"][rows] = np.maximum.reduceat(np.where(best >= BASE_WINDOW, best, 0), starts)


_FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat")


def profile(df: DataFrame, max_covered: float = MAX_COVERED, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """``df``'s doc_id with the figures, ``base_failed`` and ``kept``; one row out for each row in."""
    schema = pa.schema([("doc_id", pa.int64()), *((k, pa.int64()) for k in _FIGURES), ("base_failed", pa.bool_()), ("kept", pa.bool_())])

    def make():
        def fn(b: pa.RecordBatch) -> pa.RecordBatch:
            got = measure(b.column(1).to_pylist())
            failed, kept = judge(got, max_covered, max_repeat)
            return batch(schema, [b.column(0), *(got[k] for k in _FIGURES), failed, kept])

        return fn

    ddl = "doc_id long, " + ", ".join(f"{k} long" for k in _FIGURES) + ", base_failed boolean, kept boolean"
    return map_batches(df.select(F.col("doc_id").cast("long"), text_bytes()), make, ddl)


def judge(got: dict[str, np.ndarray], max_covered: float, max_repeat: int) -> tuple[np.ndarray, np.ndarray]:
    n = got["n_words"]
    failed = (n < MIN_WORDS) | (100 * got["n_repeat_words"] > MAX_REPEAT_WORDS * n)
    return failed, ~failed & (got["covered_words"] <= max_covered * n) & (got["longest_repeat"] <= max_repeat)


def keep_good(df: DataFrame, max_covered: float = MAX_COVERED, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """The rows of ``df`` whose text the rules keep, with all their columns; no shuffle."""

    def run(batches):
        for whole in batches:
            for b in pieces(whole):
                texts = [x.encode() if x is not None else b"" for x in b.column(b.schema.get_field_index("text")).to_pylist()]
                yield b.filter(pa.array(judge(measure(texts), max_covered, max_repeat)[1]))

    few_rows_a_batch(df.sparkSession)
    return df.mapInArrow(run, df.schema)


def query(spark, sf_dir: str) -> DataFrame:
    return profile(table(spark, sf_dir, "documents")).drop("longest_repeat")


ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
b AS (SELECT doc_id, words, len(words) AS n_words,
        length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM w),
p AS (SELECT doc_id, n_words, words, unnest(range(1, n_words + 1)) AS i FROM b),
win AS (SELECT doc_id, i,
        CASE WHEN i + {BASE_WINDOW - 1} <= n_words THEN list_slice(words, i, i + {BASE_WINDOW - 1}) END AS a,
        CASE WHEN i + {MIN_REPEAT - 1} <= n_words THEN list_slice(words, i, i + {MIN_REPEAT - 1}) END AS c,
        CASE WHEN i + {MAX_REPEAT} <= n_words THEN md5(array_to_string(list_slice(words, i, i + {MAX_REPEAT}), ' ')) END AS l FROM p),
rep AS (SELECT doc_id, i,
        a IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, a) > 1 AS ra,
        c IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, c) > 1 AS rc,
        l IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, l) > 1 AS rl FROM win),
cov AS (SELECT doc_id, rl,
        bool_or(ra) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {BASE_WINDOW - 1} PRECEDING AND CURRENT ROW) AS ca,
        bool_or(rc) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {MIN_REPEAT - 1} PRECEDING AND CURRENT ROW) AS cc FROM rep),
s AS (SELECT doc_id, count_if(ca) AS n_repeat_words, count_if(cc) AS covered_words, bool_or(rl) AS too_long FROM cov GROUP BY doc_id),
r AS (SELECT b.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(covered_words, 0) AS BIGINT) AS covered_words,
        coalesce(too_long, false) AS too_long FROM b LEFT JOIN s ON b.doc_id = s.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered_words,
    n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_WORDS} * n_words AS base_failed,
    NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_WORDS} * n_words)
      AND covered_words <= {MAX_COVERED} * n_words AND NOT too_long AS kept FROM r
"""
