"""Nearest neighbours by inverted lists with an adaptive dimension scan.

Lists belong to centres fitted on a bounded sample of SAMPLE vectors (by a hash of ids and vectors); every
vector is indexed. A query scans the lists of its nearest centres; how many, is measured for PROBED vectors of
the sample against all rows, so that TARGET of their true neighbours are found; where these lists hold fewer than
k other rows, a query goes on to further ones until they do. Within a list, vectors are rotated at random and scanned in
blocks of COLUMNS dimensions: a candidate is abandoned as soon as its partial distance, scaled up to all
dimensions with a margin of EPSILON standard errors, exceeds the tenth best so far. What remains gets its
exact distance on the original vectors in double precision.

A list is dealt into cells of about CELL rows by a hash of the vectors. Vectors move once, to their cell; a query moves
to the cells of its lists, each of which gives it at most k rows. Of equal vectors a cell holds the k + m smallest ids, m being the
most rows that one id has: without a query's own rows these are at least k, so the others are in no result.

Defined results: null, zero or non-finite vectors, and vectors of another length than most have, take no
part; ties go to the smaller id; rows that share the query's id aren't its candidates; a query row that repeats (id and
vector) is answered once, rows of one id and other vectors each for themselves; rows without id take no part; an empty table gives no rows; other columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SAMPLE, TARGET, MAX_LISTS, CELL, PROBED, COLUMNS, EPSILON = 16384, 0.98, 4096, 16384, 256, 16, 3.0
#: Rows that Python takes at once.
ROWS = 4096
#: Distances that are held at once, 16 MB.
CELLS = 1 << 21


def rotation(d: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(64).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def fitted(sample: np.ndarray, lists: int, rounds: int = 12) -> np.ndarray:
    """Centres by Lloyd's rounds from distinct starting vectors."""
    start = np.unique(sample, axis=0)
    centres = start[np.random.default_rng(7).permutation(len(start))[:lists]].copy()
    for _ in range(rounds):
        own = nearest(sample, centres, 1)[:, 0]
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        n = np.bincount(own, minlength=len(centres))
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The n nearest centres of each row of x, a few rows at a time."""
    squares, out = (centres**2).sum(1), np.empty((len(x), min(n, len(centres))), np.int64)
    step = max(1, CELLS // len(centres))
    for s in range(0, len(x), step):
        d = x[s : s + step] @ (-2 * centres.T)
        d += squares
        out[s : s + step] = d.argmin(1)[:, None] if n == 1 else np.argsort(d, 1, kind="stable")[:, :n]
    return out


def _in_bulk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The batches' rows, about ROWS at once."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held += [b] * (b.num_rows > 0)
        if sum(x.num_rows for x in held) >= ROWS:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _closest(some: np.ndarray, centres: np.ndarray, n: int):
    """For each vector of `some` the n nearest rows of a partition: which one, squared distance, place of the row's list in its order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squares = (some**2).sum(1)[:, None]
        best, rows = np.full((len(some), n), np.inf), np.zeros((len(some), n, some.shape[1]))
        for t in _in_bulk(batches):
            x = _matrix(t.column(0).chunk(0))
            d = np.maximum(squares + (x**2).sum(1) - 2 * some @ x.T, 0)
            near = np.flatnonzero((d < best.max(1)[:, None]).any(0))
            every = np.concatenate((best, d[:, near]), 1)
            take = np.argpartition(every, n - 1, 1)[:, :n]
            old = take < n
            rows = np.where(old[:, :, None], np.take_along_axis(rows, np.where(old, take, 0)[:, :, None], 1), x[near][np.where(old, 0, take - n)] if len(near) else 0)
            best = np.take_along_axis(every, take, 1)
        at, j = np.nonzero(best < np.inf)
        if len(at):
            place = np.argsort(nearest(some, centres, len(centres)), 1)
            need = place[at, nearest(rows[at, j], centres, 1)[:, 0]]
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(best[at, j]), pa.array(need.astype(np.int32))], ["at", "distance", "need"])

    return run


def probes(vectors: DataFrame, sample: np.ndarray, centres: np.ndarray, k: int) -> int:
    """The fewest lists that hold TARGET of the true k nearest rows of PROBED vectors of the sample, among all rows."""
    some = sample[:: max(1, len(sample) // PROBED)][:PROBED]
    best = Window.partitionBy("at").orderBy("distance", "need")
    found = vectors.select("vector").mapInArrow(_closest(some, centres, k + 1), "at int, distance double, need int").withColumn("rank", F.row_number().over(best))
    need = sorted(r[0] for r in found.where(F.col("rank").between(2, k + 1)).select("need").collect())  # the first is the vector itself; k * PROBED rows
    return need[min(len(need) - 1, int(TARGET * len(need)))] + 1 if need else 1


def scan(q: np.ndarray, x: np.ndarray, rotated_q: np.ndarray, rotated: np.ndarray, ids: np.ndarray, own: int, k: int) -> list[tuple[int, float]]:
    """The k nearest rows of a block to one query, exact distances on the original vectors."""
    d = x.shape[1]
    best, far = np.empty(0), np.inf
    kept = []
    for at in range(0, len(x), 512):
        alive = at + np.flatnonzero(ids[at : at + 512] != own)
        partial = np.zeros(len(alive))
        for c in range(0, d, COLUMNS):
            part = rotated[alive, c : c + COLUMNS] - rotated_q[c : c + COLUMNS]
            partial = partial + np.einsum("ij,ij->i", part, part)
            t = min(d, c + COLUMNS)
            slack = (1 + EPSILON / np.sqrt(t)) ** 2 if t < d else 1 + 1e-9
            stay = partial <= far * (t / d) * slack + 1e-12
            alive, partial = alive[stay], partial[stay]
        kept.append(alive)
        best = np.sort(np.concatenate((best, partial)))[:k]
        far = best[-1] if len(best) == k else np.inf
    rows = np.concatenate(kept) if kept else np.empty(0, int)
    diff = x[rows] - q
    exact = np.sqrt((diff * diff).sum(1))
    order = np.lexsort((ids[rows], exact))[:k]
    return [(int(ids[rows[i]]), float(exact[i])) for i in order]


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _scanned(k: int):
    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out = []
        if queries.num_rows and rows.num_rows:
            (query_ids, q), (ids, x) = ((t["vec_id"].to_numpy(), _matrix(t["vector"].combine_chunks())) for t in (queries, rows))
            p = rotation(x.shape[1])
            rx, rq = x @ p, q @ p
            for i, query in enumerate(query_ids.tolist()):
                tag = xxhash.xxh3_64_intdigest((q[i] + 0.0).tobytes()) - (1 << 63)
                out += [(query, tag, v, s) for v, s in scan(q[i], x, rq[i], rx, ids, query, k)]
        cols = list(zip(*out, strict=True)) or [()] * 4
        return pa.Table.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.float64())], ["query_id", "tag", "vec_id", "score"])

    return run


def _listed(centres: np.ndarray):
    """The nearest list of each vector, beside its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _in_bulk(batches):
            lists = nearest(_matrix(t.column(1).chunk(0)), centres, 1)[:, 0].astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(lists), t.column(0).chunk(0)], ["list", "hash"])

    return run


def _dealt(centres: np.ndarray, cells: np.ndarray, most: int):
    """The cell of each vector. Of equal vectors that come at once only the `most` smallest ids go on."""
    first = np.cumsum(cells) - cells

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _in_bulk(batches):
            ids, hashes, x = t.column(0).to_numpy(), t.column(1).to_numpy(), _matrix(t.column(2).chunk(0))
            if len(x) > most:
                order = np.lexsort((ids, hashes))
                new = np.append(True, (x[order[1:]] != x[order[:-1]]).any(1))
                start = np.flatnonzero(new)
                kept = np.sort(order[np.arange(len(x)) - start[np.cumsum(new) - 1] < most])
                t, x, hashes = t.take(pa.array(kept)).combine_chunks(), x[kept], hashes[kept]
            lists = nearest(x, centres, 1)[:, 0]
            yield pa.RecordBatch.from_arrays([pa.array(first[lists] + hashes % cells[lists]), *(c.chunk(0) for c in t.columns)], ["cell", "vec_id", "hash", "vector", "other"])

    return run


def _asked(centres: np.ndarray, cells: np.ndarray, sizes: np.ndarray, n: int, least: int):
    """A row for each cell of each query's n nearest lists, and of further ones until they hold `least` rows."""
    first = np.cumsum(cells) - cells

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                lists = nearest(_matrix(b.column(1)), centres, len(centres))
                taken = np.minimum(np.maximum(n, 1 + (np.cumsum(sizes[lists], 1) < least).sum(1)), lists.shape[1])
                row, place = np.nonzero(np.arange(lists.shape[1]) < taken[:, None])
                of = lists[row, place]
                row, at = np.repeat(row, cells[of]), np.repeat(first[of], cells[of])
                at += np.arange(len(at)) - np.repeat(np.cumsum(cells[of]) - cells[of], cells[of])
                for s in range(0, len(at), ROWS):
                    some = b.take(pa.array(row[s : s + ROWS]))
                    yield pa.RecordBatch.from_arrays([pa.array(at[s : s + ROWS]), some.column(0), some.column(1)], ["cell", "vec_id", "vector"])

    return run


def _sampled(rows: DataFrame, n: int) -> np.ndarray:
    """SAMPLE of n rows, those of the least hashes. Counts of the hashes' ranges tell which rows can be among them, so that
    few others come to the driver: a sorted limit would send it SAMPLE rows of each partition. Equal rows come as one."""
    key = F.xxhash64("vec_id", "vector")
    at = F.shiftright(key, 48)
    most = (1 << 15) - 1
    if n > SAMPLE:
        counts = rows.groupBy(at.alias("at")).count().toArrow().sort_by("at")  # 65,536 ranges
        most = counts["at"][int(np.searchsorted(np.cumsum(counts["count"].to_numpy()), SAMPLE))].as_py()
    few = rows.where(at <= most).groupBy("vec_id", "vector").agg(F.count("*").alias("n")).orderBy(key, "vec_id", "vector").limit(SAMPLE).select("vector", "n").toArrow()
    ends = np.minimum(np.cumsum(few["n"].to_numpy()), SAMPLE)
    return np.repeat(_matrix(few["vector"].combine_chunks()), np.diff(ends, prepend=0), 0)


def search(vectors: DataFrame, is_query: F.Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that is a query its k nearest others."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    kept_type = vectors.schema[vector_col].dataType.simpleString()
    kept_type = kept_type if kept_type == "array<float>" else "array<double>"  # floats are widened in Python: half the shuffle
    least, most, inf = F.array_min("vector"), F.array_max("vector"), float("inf")
    sound = (least > -inf) & (most < inf) & ((least != 0) | (most != 0)) & ~F.array_contains("vector", F.lit(inf).cast(kept_type[6:-1]))  # NaN is above infinity; null, if a component is null
    rows = vectors.withColumn("_query", F.coalesce(is_query, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kept_type).alias("vector"), "_query").where(F.col("vec_id").isNotNull() & sound)
    sizes = rows.groupBy("vec_id", F.size("vector").alias("d")).count().groupBy("d").agg(F.sum("count").alias("n"), F.max("count").alias("own")).orderBy(F.col("n").desc(), "d").first()
    if sizes is None:
        return spark.createDataFrame([], schema)
    d, n, own = sizes  # own: rows of one id aren't each other's candidates
    rows = rows.where(F.size("vector") == d)
    common.tune(spark)
    sample = _sampled(rows.select("vec_id", "vector"), n)
    centres = fitted(sample, max(1, min(MAX_LISTS, int(n**0.5 / 2))))
    probed = probes(rows, sample, centres, k)
    hashed = F.xxhash64("vector").alias("hash")
    kinds = rows.select(hashed, "vector").mapInArrow(_listed(centres), "list int, hash long").groupBy("list", "hash").count()
    sizes, cells = np.zeros(len(centres), np.int64), np.ones(len(centres), np.int64)
    for r in kinds.groupBy("list").agg(F.sum("count"), F.sum(F.least("count", F.lit(k + own)))).collect():  # a row for each list at most
        sizes[r[0]], cells[r[0]] = r[1], -(-r[2] // CELL)
    other = F.xxhash64("vector", F.lit(1)).alias("other")  # 128 bits tell vectors apart; sorting by whole vectors takes ten times as long
    dealt = rows.select("vec_id", hashed, "vector", other).mapInArrow(_dealt(centres, cells, k + own), f"cell long, vec_id long, hash long, vector {kept_type}, other long").repartition("cell")
    alike = Window.partitionBy("cell", "hash", "other").orderBy("vec_id")
    indexed = dealt.withColumn("_n", F.row_number().over(alike)).where(F.col("_n") <= k + own).select("cell", "vec_id", "vector")
    asked = rows.where("_query").select("vec_id", "vector").distinct().mapInArrow(_asked(centres, cells, sizes, probed, k + own), f"cell long, vec_id long, vector {kept_type}")
    found = asked.groupBy("cell").cogroup(indexed.groupBy("cell")).applyInArrow(_scanned(k), "query_id long, tag long, vec_id long, score double")
    best = Window.partitionBy("query_id", "tag").orderBy("score", "vec_id")  # tag: which vector, if an id has several
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
