"""Byte-level BPE by monoid tree reduction.

A pretoken (one match of the pattern) is halved until its parts are short; short parts are encoded by
merging the lowest rank first. Two neighbours are joined by encoding a window of bytes around the seam
anew. The joined sequence is right as soon as each pair of tokens at the window's rims stands: a
sequence of tokens is what BPE gives for its bytes if and only if every two neighbours are what BPE
gives for theirs, and pairs inside either neighbour or inside the window stand already. Otherwise the
window grows; at the whole, it is the plain encoding. So joining is associative, and the tree's shape
doesn't matter. Decoding concatenates up the same kind of tree.

Most text is words that come again, so pieces of text (from one space to the next) and their ids are
kept in a table of at most CACHE entries per worker.

Defined results: a null text is encoded as an empty one: no ids; every text decodes to its own UTF-8
bytes; long texts and pretokens are encoded whole; rows that repeat are all returned; other columns
are ignored."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

CACHE = 1 << 18
LEAF = 32
#: A space before another space or at the end may not part pieces.
_LOOSE = re.compile(r" (?:\s|\Z)")


class Ranks:
    """The merges of a rank file."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, k in ranks.items():
            self.bytes_of[k] = token
        self._stands: dict[tuple[int, int], bool] = {}

    @classmethod
    def read(cls, path: str) -> Ranks:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(k) for a, k in map(bytes.split, f)})

    def merged(self, data: bytes) -> list[int]:
        """Merges the pair of lowest rank, the first of equals, until none is known."""
        ranks = self.ranks
        parts = [data[i : i + 1] for i in range(len(data))]
        pairs = [ranks.get(a + b) for a, b in zip(parts, parts[1:], strict=False)]
        while True:
            best, at = None, -1
            for i, r in enumerate(pairs):
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                return [ranks[p] for p in parts]
            parts[at] += parts.pop(at + 1)
            pairs.pop(at)
            if at < len(pairs):
                pairs[at] = ranks.get(parts[at] + parts[at + 1])
            if at:
                pairs[at - 1] = ranks.get(parts[at - 1] + parts[at])

    def stands(self, a: int, b: int) -> bool:
        """Whether BPE gives a, b for their bytes."""
        known = self._stands.get((a, b))
        if known is None:
            if len(self._stands) > 200_000:
                self._stands.clear()
            known = self._stands[a, b] = self.merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return known

    def joined(self, left: list[int], right: list[int]) -> list[int]:
        if not left or not right or self.stands(left[-1], right[0]):
            return left + right
        size = 2
        while True:
            i, j = max(0, len(left) - size), min(len(right), size)
            window = b"".join(map(self.bytes_of.__getitem__, [*left[i:], *right[:j]]))
            inner = self.merged(window)
            if (not i or self.stands(left[i - 1], inner[0])) and (j == len(right) or self.stands(inner[-1], right[j])):
                return left[:i] + inner + right[j:]
            size *= 2

    def encoded(self, data: bytes) -> list[int]:
        if len(data) <= LEAF:
            return self.merged(data)
        half = len(data) // 2
        return self.joined(self.encoded(data[:half]), self.encoded(data[half:]))

    def pretoken(self, data: bytes) -> list[int]:
        """As the library does: a pretoken that is itself a token is that token."""
        whole = self.ranks.get(data)
        return self.encoded(data) if whole is None else [whole]

    def decoded(self, ids: list[int]) -> bytes:
        """Neighbours concatenated up a tree."""
        parts = list(map(self.bytes_of.__getitem__, ids))
        while len(parts) > 1:
            parts = [b"".join(parts[i : i + 64]) for i in range(0, len(parts), 64)]
        return parts[0] if parts else b""


class Pieces:
    """Ids (little-endian, 32 bits) of whole texts by pieces from space to space, which no pretoken
    crosses: the pattern lets a space begin a pretoken wherever a character other than white space follows."""

    def __init__(self, miss: Callable[[str], bytes]):
        outer = self

        class Table(dict):
            def __missing__(self, piece: str) -> bytes:
                got = outer.miss(piece)
                if len(piece) < 64:
                    if len(self) >= CACHE:
                        self.clear()
                    self[piece] = got
                return got

        self.miss = miss
        self.table = Table()

    def ids(self, text: str) -> bytes:
        if _LOOSE.search(text):
            if len(text) > 1 << 16 and (spots := [m.start() for m in re.finditer(r"(?<=\S) (?=\S)", text)]):
                cuts = [0, *(spots[i] for i in range(0, len(spots), 2048))]  # whole runs of white space stay together
                return b"".join(self.miss(text[a:b]) for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True) if a < b)
            return self.miss(text)
        first, *rest = text.split(" ")
        get = self.table.__getitem__
        return (get(first) if first else b"") + b"".join([get(" " + w) for w in rest])


def _pattern_ids(path: str, pattern: str) -> tuple[Pieces, Ranks]:
    ranks = Ranks.read(path)
    find = regex.compile(pattern).findall
    known: dict[str, bytes] = {}

    def word(w: str) -> bytes:
        got = known.get(w)
        if got is None:
            got = np.array(ranks.pretoken(w.encode()), "<u4").tobytes()
            if len(w) < 64:
                if len(known) >= CACHE:
                    known.clear()
                known[w] = got
        return got

    return Pieces(lambda text: b"".join(map(word, find(text)))), ranks


_WORKER: dict[tuple, tuple] = {}


def encoder(path: str, pattern: str) -> tuple[Pieces, Ranks]:
    """Kept in the worker for its next tasks."""
    if (path, pattern) not in _WORKER:
        _WORKER[path, pattern] = _pattern_ids(path, pattern)
    return _WORKER[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """doc_id and ids, the tokens of each whole text as little-endian unsigned 32-bit integers; with
    `decoded` also data, the bytes that these ids decode to."""
    common.tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, ranks = encoder(path, pattern)
        for b in batches:
            ids = [pieces.ids(t or "") for t in b.column(1).to_pylist()]
            more = [pa.array([ranks.decoded(np.frombuffer(x, "<u4").tolist()) for x in ids], pa.binary())] if decoded else []
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary()), *more], ["doc_id", "ids", "data"][: 2 + decoded])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(run, "doc_id long, ids binary" + ", data binary" * decoded)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and data, the bytes of each sequence of ids (doc_id, ids as `encode` gives them)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, ranks = encoder(path, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([ranks.decoded(np.frombuffer(i or b"", "<u4").tolist()) for i in b.column(1).to_pylist()], pa.binary())], ["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = encode(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, decoded=True)
    return out.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("data", 256).alias("decoded_sha256"))
