"""Substring dedup by content-defined chunks.

A gear hash rolls over the bytes of a text; its upper bits see the last 16 bytes. A chunk ends after a
white space where the hash falls under a quarter of its range, so chunks hold 4 words on average,
and the same passage gets the same chunks wherever it stands and whatever was inserted before it.
A chunk of more than WIDE bytes, as in scripts without spaces or in encoded data, is cut further: where more than LONG bytes
have no white space, after a character where
the hash falls under a sixteenth of its range (NARROW bytes apart at least), and after MAX_BYTES at last.
Chunks are compared by
digest (without surrounding white space). A chunk that an earlier document (smaller id) holds too is
repeated there; neighbouring repeated chunks join to runs (each chunk's span reaches over the white space up to
the next one, so white space alone parts no run), and runs of MIN_WORDS words or more are
reported, and cut by `without_repeats`. Where a chunk has fewer words than one for each WORD_BYTES bytes other than white space, that number counts
instead, so the measure works without spaces. A passage of 50 words holds such a run but for some 2 in 1000;
shorter runs are everyday phrases and stay.

Only counts per digest decide: no document meets another, and per digest only the smallest and largest
id are kept, so a passage that a third of all documents share costs one row per task. The owners of the most frequent
digests (at most HEAVY, by their share of all repeated chunks) are broadcast, and their chunks are dealt out evenly.

Defined results: null and empty texts have no chunks; repeats within one document stay; rows that repeat
under one id are no repeats of each other; rows without id take no part and stay as they are; empty
tables give no rows; other columns pass through."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, texthash

MIN_WORDS, MAX_BYTES, ONE_IN = 20, 1024, 4
WIDE, LONG, NARROW, NARROW_ONE_IN, WORD_BYTES = 256, 64, 16, 16, 16
HEAVY = 1 << 16
_GEAR = np.random.default_rng(9).integers(0, 1 << 16, 256, dtype=np.uint16)
#: A span is one long: its first byte, its length (12 bits), its words (10 bits).
_LENGTH_BITS, _WORD_BITS = 12, 10


def gear(data: np.ndarray) -> np.ndarray:
    """At each byte the sum of the last 16 bytes' table values, each shifted by its distance."""
    h = _GEAR[data]
    for m in (1, 2, 4, 8):
        far = h[:-m] << np.uint16(m)
        h = h.copy()
        h[m:] += far
    return h


def chunk_ends(data: bytes) -> np.ndarray:
    a = np.frombuffer(data, np.uint8)
    h = gear(a)
    ends = np.flatnonzero(texthash.SPACES[a] & (h < (1 << 16) // ONE_IN)) + 1
    ends = np.append(ends, len(a)) if not len(ends) or ends[-1] < len(a) else ends
    wide = np.flatnonzero(np.diff(ends, prepend=0) > WIDE)
    if len(wide):
        whole = np.append(a[1:] & 0xC0 != 0x80, True)  # a character ends here
        parting = np.flatnonzero(np.append(texthash.SPACES[a], True))
        run = np.diff(parting, prepend=-1)  # bytes without white space, and the one that ends them
        spots = np.flatnonzero(whole & (h < (1 << 16) // NARROW_ONE_IN) & (np.repeat(run, run)[: len(a)] > LONG)) + 1
        more = [_narrowed(a, spots, int(ends[k - 1]) if k else 0, int(ends[k])) for k in wide]
        ends = np.unique(np.concatenate((ends, *more))).astype(np.int64)
    return ends


def _narrowed(a: np.ndarray, spots: np.ndarray, at: int, end: int) -> list[int]:
    """Further ends between two: the next spot NARROW bytes on, or after MAX_BYTES."""
    out = []
    while end - at > NARROW:
        k = np.searchsorted(spots, at + NARROW)
        to = int(spots[k]) if k < len(spots) else end
        if to - at > MAX_BYTES:
            to = at + MAX_BYTES
            while a[to] & 0xC0 == 0x80:
                to -= 1
        if to >= end:
            break
        out.append(to)
        at = to
    return out


def chunks(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Digests and packed spans of the chunks that hold a word, each up to the next such chunk's start. A span too
    long for its bits (by white space) goes on in further ones with the same digest and no words."""
    data = (text or "").encode("utf-8", "surrogatepass")
    if not data:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    ends = chunk_ends(data)
    starts = np.append(0, ends[:-1])
    inside = ~texthash.SPACES[np.frombuffer(data, np.uint8)]
    begun = np.cumsum(inside & ~np.append(False, inside[:-1]))
    n = np.diff(begun[ends - 1], prepend=0)
    solid = np.diff(np.cumsum(inside)[ends - 1], prepend=0)
    full = solid > 0
    starts, ends, n = starts[full], ends[full], np.maximum(n, solid // WORD_BYTES)[full]
    digests = np.array([xxhash.xxh3_64_intdigest(data[s:e].strip()) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)], np.uint64)
    lengths = np.append(starts[1:], len(data))[: len(starts)] - starts
    most = (1 << _LENGTH_BITS) - 1
    if len(lengths) and lengths.max() > most:
        pieces = -(-lengths // most)
        of = np.repeat(np.arange(len(lengths)), pieces)
        at = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        digests, n = digests[of], np.where(at == 0, n[of], 0)
        starts, lengths = starts[of] + at * most, np.minimum(most, lengths[of] - at * most)
    return digests, (starts << (_LENGTH_BITS + _WORD_BITS)) | (lengths << _WORD_BITS) | n


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [chunks(t) for t in b.column(2).to_pylist()]
        offsets = pa.array(np.concatenate(([0], np.cumsum([len(d) for d, _ in found]))).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([f[k] for f in found]).view(np.int64) if found else np.empty(0, np.int64))) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *lists], ["doc_id", "tag", "digests", "spans"])


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[F.Column, F.Column]:
    return F.col(id_col).cast("long").alias("doc_id"), F.hash(F.col(text_col)).alias("tag")


def repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row per repeated run: doc_id, tag (hash of the row's text), start_byte, end_byte (of the
    UTF-8 text), n_words, n_chunks, kept_doc_id (the smallest id that holds one of the chunks)."""
    common.tune(docs.sparkSession)
    doc_id, tag = _keyed(docs, id_col, text_col)
    texts = docs.where(F.col(id_col).isNotNull()).select(doc_id, tag, F.col(text_col).alias("text"))
    # chunks are cheap to make and large to store, so both uses make them
    rows = texts.mapInArrow(_chunked, "doc_id long, tag int, digests array<long>, spans array<long>")
    owners = rows.select("doc_id", F.explode("digests").alias("digest")).groupBy("digest").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"), F.count("*").alias("n"))
    owners = common.stored(owners.where("owner < last").select("digest", "owner", "n"), "owners")
    often = max(10_000, (owners.agg(F.sum("n")).first()[0] or 0) // HEAVY)
    heavy = F.broadcast(owners.where(F.col("n") >= often).select("digest", F.col("owner").alias("first")))  # HEAVY rows at most
    held = rows.select("doc_id", "tag", F.expr("inline(arrays_zip(digests, spans))")).toDF("doc_id", "tag", "digest", "span").join(heavy, "digest", "left")
    # a chunk whose owner is known goes anywhere; should it meet another owner there, it keeps its own
    held = held.withColumn("digest", F.expr("CASE WHEN first IS NULL THEN digest ELSE xxhash64(doc_id, span) END"))
    light = owners.where(F.col("n") < often).select("digest", "owner")
    hits = held.join(light, "digest", "left").select("doc_id", "tag", "span", F.coalesce("first", "owner").alias("owner"))
    hits = hits.where("doc_id > owner").groupBy("doc_id", "tag", "span").agg(F.min("owner").alias("owner"))
    start = F.expr(f"shiftright(span, {_LENGTH_BITS + _WORD_BITS})")
    length = F.expr(f"shiftright(span, {_WORD_BITS}) & {(1 << _LENGTH_BITS) - 1}")
    hits = hits.select("doc_id", "tag", "owner", start.alias("start"), (start + length).alias("end"), F.expr(f"span & {(1 << _WORD_BITS) - 1}").alias("n"))
    doc = Window.partitionBy("doc_id", "tag").orderBy("start")
    runs = hits.withColumn("new", F.coalesce((F.col("start") != F.lag("end").over(doc)).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(doc))
    runs = runs.groupBy("doc_id", "tag", "run").agg(F.min("start").alias("start_byte"), F.max("end").alias("end_byte"), F.sum("n").alias("n_words"), F.count("*").alias("n_chunks"), F.min("owner").alias("kept_doc_id"))
    return runs.where(F.col("n_words") >= min_words).drop("run")


def _cut(texts, spans):
    out = []
    for t, s in zip(texts, spans, strict=True):
        data, at, parts = t.encode("utf-8", "surrogatepass"), 0, []
        for a, b in s:
            parts.append(data[at:a])
            at = b
        out.append(b"".join([*parts, data[at:]]).decode("utf-8", "surrogatepass"))
    return out


def without_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", min_words: int = MIN_WORDS) -> DataFrame:
    """docs with repeated runs cut out of the later documents' texts; chars_col, where it exists, is
    counted anew for these. Texts without such runs aren't shuffled (but for those that share a slot)."""
    spark = docs.sparkSession
    found = common.stored(repeats(docs, id_col=id_col, text_col=text_col, min_words=min_words), "repeats")
    own, mark, spans = (common.fresh(docs, n) for n in ("_id", "_tag", "_cuts"))
    cuts = found.groupBy(F.col("doc_id").alias(own), F.col("tag").alias(mark)).agg(F.sort_array(F.collect_list(F.array("start_byte", "end_byte"))).alias(spans))
    doc_id, tag = _keyed(docs, id_col, text_col)
    near, free = common.near_slots(docs, found, "doc_id", F.col(id_col).cast("long"))
    near = near.withColumn(own, doc_id).withColumn(mark, tag).join(cuts, [own, mark], "left")

    @F.pandas_udf("string")
    def cut(texts: pd.Series, parts: pd.Series) -> pd.Series:
        return pd.Series(_cut(texts, parts))

    same = near.where(F.col(spans).isNull()).select(*docs.columns)
    other = near.where(F.col(spans).isNotNull()).withColumn(text_col, cut(F.col(text_col), F.col(spans)))
    if chars_col in docs.columns:
        other = other.withColumn(chars_col, F.length(text_col).cast(docs.schema[chars_col].dataType))
    return free.unionByName(same).unionByName(other.select(*docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(common.table(spark, sf_dir, "documents"))
