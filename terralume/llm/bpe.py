"""Byte-pair encoding, decoding and token counts for vocabularies in the ``tokenizers`` JSON format.

Two ways to merge one word, after the same splitting:

* ``merge_short`` (encoding): a contiguous rank array.  The word's parts and the ranks of adjacent
  parts lie in two short lists; the minimum rank is sought again and again, its boundary deleted and
  the two neighbouring ranks refreshed.  Quadratic, so it serves words of up to ``SHORT`` symbols.
* ``count_merges`` / ``merge_long`` (counting, and encoding of longer words): a heap of adjacent
  pairs over a doubly linked list.  The lowest rank (then the leftmost pair) is popped; stale entries
  are skipped.  Counting emits no identifiers: tokens = initial symbols - merges.

Both give the library's results: lowest rank first, leftmost on a tie.  A word's result depends on
nothing but the word and the vocabulary, so a Python worker remembers it across its tasks (two
generations of ``CACHE`` entries of at most ``CACHE_CHARS`` characters): memory is bounded.

The vocabulary file's path is a parameter.  The driver reads it and sends its text (under 2 MB for
50,000 tokens) to the executors, which need no file.

Defined results: a null text counts as empty (no tokens), an empty table gives an empty result; a very
long text is encoded whole, in memory that grows with it; repeated rows are encoded alike; other
columns, whatever their names, are ignored; special tokens' strings inside a text are
found before normalising and give that token, as the library does by default; a symbol the
vocabulary lacks and that has no unknown token gives nothing.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import unicodedata
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, map_batches, table

SHORT = 48
CACHE = 250_000
CACHE_CHARS = 64
TOKEN_LIMIT = 512

_NONE = 1 << 60
_BITS = 24
_PLACE = 40
_PLACE_MASK = (1 << _PLACE) - 1


@functools.cache
def newer() -> regex.Pattern:
    """Matches letters and digits that ``regex`` knows but Python's older Unicode tables do not."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    points = [ord(c) for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn"]
    starts = [c for i, c in enumerate(points) if not i or points[i - 1] != c - 1]
    ends = [c for i, c in enumerate(points) if i + 1 == len(points) or points[i + 1] != c + 1]
    return regex.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(starts, ends, strict=True)) + "]") if points else regex.compile(r"(?!)")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, spare = [""] * 256, 256
    for b in range(256):
        if b in shown:
            out[b] = chr(b)
        else:
            out[b], spare = chr(spare), spare + 1
    return out


class Bpe:
    """One vocabulary with its splitting rules."""

    def __init__(self, spec_text: str):
        spec = json.loads(spec_text)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in (self.vocab | self.special).items()}
        self.decoder = (spec.get("decoder") or {}).get("type")
        #: Rank of a pair, under left << _BITS | right.
        self.pair: dict[int, int] = {}
        self.made: list[int] = []
        for rank, (a, b) in enumerate(model["merges"]):
            self.pair[self.vocab[a] << _BITS | self.vocab[b]] = rank
            self.made.append(self.vocab[a + b])
        symbols = byte_symbols()
        self.inner = [self.vocab.get(c, -1) for c in symbols]
        self.last = [self.vocab.get(c + self.suffix, -1) for c in symbols]
        self.lower = False
        self.nfc = False
        for step in (spec.get("normalizer") or {}).get("normalizers", []):
            self.nfc |= step["type"] == "NFC"
            self.lower |= step["type"] == "Lowercase"
        pre = spec["pre_tokenizer"]
        if pre["type"] == "Sequence":
            split = next(x for x in pre["pretokenizers"] if x["type"] == "Split")
            pattern = split["pattern"]["Regex"]
        else:
            # fixed value: the pattern of byte-level pre-tokenizers
            pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        # \s as the library's engine has it: without U+001C to U+001F
        self.drops_space = pre["type"] == "Sequence"
        self.words = regex.compile(pattern.replace(r"[^\s\p", r"[^\p{White_Space}\p").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self._spec, self._split = spec_text, None
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")") if self.special else None

    def split_newer(self, text: str) -> list[str]:
        """The words of a text with characters newer than Python's tables, as bytes' symbols.

        Only the library knows which of them it takes for letters, so its splitter is asked.
        """
        if self._split is None:
            from tokenizers import Tokenizer

            self._split = Tokenizer.from_str(self._spec)
        lib = self._split
        if lib.normalizer is not None:
            text = lib.normalizer.normalize_str(text)
        back = {c: b for b, c in enumerate(byte_symbols())}
        return [bytes(back[c] for c in w) for w, _ in lib.pre_tokenizer.pre_tokenize_str(text)]

    def normalise(self, text: str) -> str:
        if text.isascii():
            return text.lower() if self.lower else text
        if self.nfc and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        if self.lower:  # character by character: no rule for a word's last sigma
            text = text.replace("Σ", "σ").lower()
        return text

    def segments(self, text: str) -> list[tuple[str, int | None]]:
        """The text between special tokens, and those tokens."""
        if self.cut is None or "<|" not in text:
            return [(text, None)]
        return [(s, self.special.get(s)) for s in self.cut.split(text) if s]

    def symbols(self, word: str | bytes) -> list[int]:
        data = word.encode() if isinstance(word, str) else word
        out = [self.inner[b] for b in data]
        if data and self.suffix:
            out[-1] = self.last[data[-1]]
        return [x for x in out if x >= 0]

    def merge_short(self, ids: list[int]) -> list[int]:
        rank_of, made = self.pair.get, self.made
        ranks = [rank_of(a << _BITS | b, _NONE) for a, b in zip(ids, ids[1:])]
        while ranks:
            low = min(ranks)
            if low == _NONE:
                break
            i = ranks.index(low)
            ids[i] = new = made[low]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank_of(ids[i - 1] << _BITS | new, _NONE)
            if i < len(ranks):
                ranks[i] = rank_of(new << _BITS | ids[i + 1], _NONE)
        return ids

    def merge_heap(self, ids: list[int]) -> int:
        """Merge in place over a linked list; a part that is merged away becomes -1.  Returns the merges.

        A heap entry is rank << _PLACE | place of the left part; it is stale if that part and the one
        after it no longer have this rank, which belongs to one pair only.
        """
        rank_of, made, n = self.pair.get, self.made, len(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [r << _PLACE | i for i in range(n - 1) if (r := rank_of(ids[i] << _BITS | ids[i + 1])) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            entry = heapq.heappop(heap)
            rank, i = entry >> _PLACE, entry & _PLACE_MASK
            j = after[i]
            if j >= n or ids[i] < 0 or rank_of(ids[i] << _BITS | ids[j]) != rank:
                continue
            ids[i] = new = made[rank]
            ids[j] = -1
            merges += 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank_of(new << _BITS | ids[k])) is not None:
                    heapq.heappush(heap, r << _PLACE | i)
            if (h := before[i]) >= 0 and (r := rank_of(ids[h] << _BITS | new)) is not None:
                heapq.heappush(heap, r << _PLACE | h)
        return merges

    def merge_long(self, ids: list[int]) -> list[int]:
        self.merge_heap(ids)
        return [x for x in ids if x >= 0]

    def encode_word(self, word: str | bytes) -> list[int]:
        ids = self.symbols(word)
        return self.merge_short(ids) if len(ids) <= SHORT else self.merge_long(ids)

    def count_word(self, word: str | bytes) -> int:
        ids = self.symbols(word)
        return len(ids) - self.merge_heap(ids)


class _Memo(dict):
    """Word -> result, made when missing.  When full, it becomes the old generation: words used since
    the last change of generations are kept, the others go at the next one."""

    def __init__(self, make: Callable):
        super().__init__()
        self.make = make
        self.old: dict = {}

    def __missing__(self, word):
        got = self.old.get(word)
        if got is None:
            got = self.make(word)
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE:
                self.old = dict(self)
                self.clear()
            self[word] = got
        return got


class Encoder:
    """Encodes whole texts to 32-bit ids and decodes them; one for each task."""

    def __init__(self, bpe: Bpe):
        self.bpe = bpe
        # what splits drops is white space, so a text may first be cut there
        self.piece = _Memo(lambda w: array("I", [i for x in bpe.words.findall(w) for i in bpe.encode_word(x)]).tobytes())

    def encode(self, text: str) -> bytes:
        """The ids, little-endian unsigned 32-bit."""
        bpe, out = self.bpe, []
        for part, special in bpe.segments(text):
            if special is not None:
                out.append(array("I", [special]).tobytes())
                continue
            if not part.isascii() and newer().search(part):
                out.extend(array("I", bpe.encode_word(w)).tobytes() for w in bpe.split_newer(part))
                continue
            part = bpe.normalise(part)
            if bpe.drops_space:
                # split() also cuts at U+001C to U+001F, which are no white space for the library
                pieces = part.split() if not _ODD.search(part) else bpe.words.findall(part)
                out.extend(map(self.piece.__getitem__, pieces))
            else:
                out.extend(map(self.piece.__getitem__, bpe.words.findall(part)))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        tokens = map(self.bpe.token.__getitem__, np.frombuffer(ids, "<u4").tolist())
        if self.bpe.decoder == "ByteLevel":
            back = {c: b for b, c in enumerate(byte_symbols())}
            return b"".join(bytes(back[c] for c in t) if all(c in back for c in t) else t.encode() for t in tokens).decode("utf-8", "replace")
        return " ".join(tokens)


_ODD = regex.compile(r"[\x1c-\x1f]")
_PLAIN_CUT = regex.compile(r"[\x1c-\x1f\s]\s|^\s|\s$|[^\S ] ")


class Counter:
    """Counts the tokens of whole texts; one for each task."""

    def __init__(self, bpe: Bpe):
        self.bpe = bpe
        self.word = _Memo(bpe.count_word)
        tokens = lambda s: sum(map(self.word.__getitem__, bpe.words.findall(s)))
        self.first = _Memo(tokens)
        self.spaced = _Memo(lambda s: tokens(" " + s))

    def count(self, text: str) -> int:
        total = 0
        for part, special in self.bpe.segments(text):
            if special is not None:
                total += 1
                continue
            if not part.isascii() and newer().search(part):
                total += sum(self.bpe.count_word(w) for w in self.bpe.split_newer(part))
                continue
            part = self.bpe.normalise(part)
            if self.bpe.drops_space or _PLAIN_CUT.search(part):
                total += sum(map(self.word.__getitem__, self.bpe.words.findall(part)))
            elif part:
                # a match never crosses the place before one space that stands between other characters
                head, *rest = part.split(" ")
                total += self.first[head] + sum(map(self.spaced.__getitem__, rest))
        return total


@functools.lru_cache(maxsize=2)
def _encoder(spec_text: str) -> Encoder:
    return Encoder(Bpe(spec_text))


@functools.lru_cache(maxsize=2)
def _counter(spec_text: str) -> Counter:
    return Counter(Bpe(spec_text))


def _sent(spark: SparkSession, path: str):
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(df: DataFrame, path: str) -> DataFrame:
    """doc_id, ``ids`` (little-endian unsigned 32-bit, binary), ``n_tokens`` and ``decoded`` of each row."""
    spec = _sent(df.sparkSession, path)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])

    def make():
        enc = _encoder(spec.value)

        def fn(b):
            ids = [enc.encode(t) if t else b"" for t in b.column(1).to_pylist()]
            return batch(schema, [b.column(0), [len(x) // 4 for x in ids], ids, [enc.decode(x) for x in ids]])

        return fn

    return map_batches(df.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), make, "doc_id long, n_tokens long, ids binary, decoded string")


def encode_digests(df: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the ids and of the decoded text.

    The same encoder and decoder as ``encode``; only the digests leave the Python worker.
    """
    spec = _sent(df.sparkSession, path)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def make():
        enc = _encoder(spec.value)

        def fn(b):
            ids = [enc.encode(t) if t else b"" for t in b.column(1).to_pylist()]
            return batch(
                schema,
                [b.column(0), [len(x) // 4 for x in ids], [hashlib.sha256(x).hexdigest() for x in ids], [hashlib.sha256(enc.decode(x).encode()).hexdigest() for x in ids]],
            )

        return fn

    return map_batches(df.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def count_tokens(df: DataFrame, path: str, limit: int = TOKEN_LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and ``over_limit`` of each row."""
    spec = _sent(df.sparkSession, path)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def make():
        counter = _counter(spec.value)

        def fn(b):
            texts = [t or "" for t in b.column(1).to_pylist()]
            return batch(schema, [b.column(0), b.column(2), [counter.count(t) for t in texts]])

        return fn

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = df.select(F.col("doc_id").cast("long"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    got = map_batches(rows, make, "doc_id long, n_bytes long, n_tokens long")
    return got.withColumn("over_limit", F.col("n_tokens") > limit)


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def count_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
