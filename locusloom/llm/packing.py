"""Hierarchical multi-length packing of tokenised documents.

A document's ids (with the end id) fill whole windows of 1024 first. What is left, and every shorter
document, goes to the smallest tier (1024, 512, 256) that holds it. The longest waiting part opens a
window of its tier; the gap takes the longest part that fits, mostly from shorter tiers; where none
fits exactly, the shortest longer part is cut. So every window is full, and since tiers are powers of two
nothing is padded. What a partition has left in the end is cut into sequences of falling powers of two.
Sequences, longest first, are dealt into step groups of STEP_TOKENS tokens: their tokens are counted over all partitions, so
every step group but the very last weighs the same, and all but a few hold one length only.

Each partition packs its own documents in one pass; at most POOL parts wait at a time, each with its own ids only. Sequence ids hold the
partition's number, so no exchange is needed, and a task that runs again on the same input gives the
same rows.

Defined results: null and empty texts are the end id alone; long texts are cut into many windows; rows
that repeat are all packed; an empty table gives no rows; other columns are ignored."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

TIERS = (1024, 512, 256)
POOL, RESERVE, STEP_TOKENS = 8192, 65536, 65536
#: Below it, the libraries' character classes are the same; other texts go to the tokenizer whole.
COMMON = "\u0530"


def byte_ranks(vocabulary: dict[str, int], special: set[str]) -> dict[bytes, int]:
    """A byte-level vocabulary by bytes. Printable Latin-1 characters stand for themselves, the other bytes,
    in order, for the characters from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    return {bytes(map(byte_of.__getitem__, t)): k for t, k in vocabulary.items() if t not in special}


def tokens(path: str) -> Callable[[str], bytes]:
    """The ids of a whole text (32 bits, little-endian), as the tokenizers library gives them. Ordinary texts
    are encoded by tiktoken with the file's own vocabulary, where ids rise in the order of the merges; it
    gives the same ids three times as fast. The tokenizer itself takes texts that hold a special token or
    characters whose class depends on the Unicode version."""
    import json
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(path)
    special = {t.content for t in one.get_added_tokens_decoder().values()}
    with open(path, encoding="utf-8") as f:
        merges = json.load(f)["model"]["merges"]
    order = [one.token_to_id("".join(m) if isinstance(m, list) else m.replace(" ", "")) for m in merges]
    quick = None
    if order == sorted(order):
        quick = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_ranks(one.get_vocab(with_added_tokens=False), special), special_tokens={})
    del merges, order

    def ids(text: str) -> bytes:
        if quick is not None and not any(s in text for s in special) and (text.isascii() or max(text) < COMMON):
            return quick.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()
        return np.array(one.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    return ids


#: Kept in the worker for its next tasks.
_WORKER: dict[str, Callable[[str], bytes]] = {}


class Packer:
    """take() documents, then finish(); sequences are lists of (document, start, length)."""

    def __init__(self):
        self.waiting: list[list[tuple[int, int]]] = [[] for _ in range(TIERS[0] + 1)]
        self.lengths = 0  # bit n: a part of n ids waits
        self.parts = self.total = 0

    def push(self, doc: int, start: int, n: int) -> None:
        self.waiting[n].append((doc, start))
        self.lengths |= 1 << n
        self.parts += 1
        self.total += n

    def pop(self, n: int) -> tuple[int, int]:
        got = self.waiting[n].pop()
        if not self.waiting[n]:
            self.lengths &= ~(1 << n)
        self.parts -= 1
        self.total -= n
        return got

    def window(self, size: int) -> list[tuple[int, int, int]]:
        """A full window; size ids wait at least."""
        out, gap = [], size
        while gap:
            fits = self.lengths & ((2 << gap) - 1)
            if fits:
                n = fits.bit_length() - 1
                doc, start = self.pop(n)
                out.append((doc, start, n))
                gap -= n
            else:
                over = self.lengths >> gap
                n = gap + (over & -over).bit_length() - 1
                doc, start = self.pop(n)
                self.push(doc, start + gap, n - gap)
                out.append((doc, start, gap))
                gap = 0
        return out

    def take(self, doc: int, n: int) -> Iterator[list[tuple[int, int, int]]]:
        top = TIERS[0]
        for k in range(n // top):
            yield [(doc, k * top, top)]
        if n % top:
            self.push(doc, n - n % top, n % top)
        if self.parts >= POOL:
            yield from self.drain(RESERVE)

    def drain(self, least: int) -> Iterator[list[tuple[int, int, int]]]:
        while self.total > least and self.total >= TIERS[0]:
            longest = self.lengths.bit_length() - 1
            yield self.window(min(t for t in TIERS if t >= longest))

    def finish(self) -> Iterator[list[tuple[int, int, int]]]:
        yield from self.drain(0)
        while self.total:
            yield self.window(1 << (self.total.bit_length() - 1))


SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_length long, nth long"


def pack(docs: DataFrame, path: str, *, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: its document, its place there, its ids (32 bits, little-endian), its sequence, its
    place there, the sequence's length, and how many sequences of that length its partition made before."""
    common.tune(docs.sparkSession)
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    kinds = [pa.binary() if f.endswith("binary") else pa.int64() for f in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encode, packer = _WORKER.setdefault(path, None) or tokens(path), Packer()
        _WORKER[path] = encode
        end = np.array([end_id], "<u4").tobytes()
        held: dict[int, list] = {}  # document: id, number of ids, ids from the one named next, that one, ids not yet placed
        rows: list[tuple] = []
        made, in_tier = 0, {}

        def place(sequence: list[tuple[int, int, int]]) -> None:
            nonlocal made
            size = sum(p[2] for p in sequence)
            k = in_tier[size] = in_tier.get(size, -1) + 1
            offset = 0
            for doc, start, n in sequence:
                h = held[doc]
                rows.append((h[0], start, n, h[2][4 * (start - h[3]) : 4 * (start - h[3] + n)], h[1], (part << 32) | made, offset, size, k))
                offset += n
                h[4] -= n
                if not h[4]:
                    del held[doc]
            made += 1

        def ready() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
            rows.clear()
            return out

        doc = 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = encode(t or "") + end
                total = len(ids) // 4
                held[doc] = [i, total, ids, 0, total]
                for s in packer.take(doc, total):
                    place(s)
                if doc in held:  # the tail waits, or what a cut has left of it; full windows are out
                    held[doc][2:4] = ids[4 * (total - held[doc][4]) :], total - held[doc][4]
                doc += 1
                if len(rows) >= 2048:
                    yield ready()
        for s in packer.finish():
            place(s)
        if rows:
            yield ready()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(run, SCHEMA)


def step_groups(packed: DataFrame) -> DataFrame:
    """packed (a stored table of `pack`, with or without ids) with step_group in place of nth: the tokens of all sequences
    before, longest first, in steps of STEP_TOKENS. Lengths are powers of two and fall, so none straddles two steps."""
    part = F.shiftright("sequence_id", 32)
    own = packed.where("offset = 0").groupBy(part.alias("part"), "sequence_length").agg((F.count("*") * F.col("sequence_length")).alias("own"))
    own = common.stored(own, "tiers")  # a row for each partition and length
    sizes = own.groupBy("sequence_length").agg(F.sum("own").alias("all"))
    longer = Window.orderBy(F.col("sequence_length").desc()).rowsBetween(Window.unboundedPreceding, -1)  # a row for each length: eleven
    base = sizes.select("sequence_length", F.coalesce(F.sum("all").over(longer), F.lit(0)).alias("base"))
    before = Window.partitionBy("sequence_length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = own.select("part", "sequence_length", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("first")).join(F.broadcast(base), "sequence_length")
    first = first.select("part", "sequence_length", (F.col("base") + F.col("first")).alias("first"))
    at = F.col("first") + F.col("nth") * F.col("sequence_length")
    out = packed.withColumn("part", part).join(first, ["part", "sequence_length"])
    kept = [c for c in packed.columns if c != "nth"]
    return out.select(*kept, F.floor(at / STEP_TOKENS).cast("long").alias("step_group"))


def packed_digests(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    out = pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return step_groups(common.stored(out.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "packed"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_digests(common.table(spark, sf_dir, "documents"))
