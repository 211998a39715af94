"""MinHash near-duplicates: one-permutation hashing with optimal densification, banded buckets,
star-shaped candidate edges, confirmation on full shingle sets, connected components.

Every text becomes its set of word shingles. Texts with equal sets form one class, so groups of
copies, however large, go on as a single representative (the smallest id). A class is hashed once
into BANDS * ROWS bins (the hash's leading part picks the bin, the bin keeps its minimum); an empty
bin borrows from the first non-empty one in its own random order of bins. Classes that agree on a
whole band share a bucket. With 4 rows and 28 bands a pair of similarity 0.8 misses all buckets with
probability 4e-7.

A bucket emits stars, never all pairs. In the first round a random member is the centre and is tested
against the others; in the second the member with most links so far, which is the original where
thousands are near copies of one text. Members that have not been a centre and are still in several
components go to an exact difference join: with D(u) the items in which u and the last centre
differ, u and v differ in |D(u)| + |D(v)| - 2 |D(u) & D(v)| items. Two members that aren't both linked
with the centre can thus be linked only if their differences share a stated number of items, so
each needs to be looked up only under its rarest differences (prefix filter). For this join all buckets whose centres
are in one component get one centre of that component, so a member is looked at once a family, not once a bucket; its
links with that centre follow from the number of its differences. No link between
components is lost, and the work follows the differences, not the pairs.

Before the stars, items that a single set holds prune: two sets share no more than either has besides its
own such items, which bounds their similarity. A member that can reach no other of its bucket even so
leaves it, and a star has no ray that can't be a link. So copies with too many changes of their own aren't
tested against the rest of a large group.

Defined results: a null or wordless text has an empty set and is linked with nothing; rows that
repeat are all returned; rows that share an id count as one document; a row without id is linked with
nothing and kept; an empty table gives no rows; other columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, texthash

BANDS, ROWS = 28, 4
_BINS = BANDS * ROWS
_EDGES = np.array([-(-i * 2**64 // _BINS) for i in range(_BINS)], np.uint64)
_rng = np.random.default_rng(41)
#: For each bin the order in which it asks other bins when it is empty.
_ORDER = np.stack([_rng.permutation(_BINS) for _ in range(_BINS)])
_MIX = _rng.integers(1, 2**63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(values: np.ndarray) -> np.ndarray:
    """The BANDS bucket keys of a non-empty sorted set of hashes."""
    at = np.searchsorted(values, _EDGES)
    ends = np.append(at[1:], len(values))
    full = at < ends
    bins = np.where(full, values[np.minimum(at, len(values) - 1)] - _EDGES, 0).astype(np.uint64)
    if not full.all():
        empty = np.flatnonzero(~full)
        order = _ORDER[empty]
        donor = order[np.arange(len(empty)), full[order].argmax(1)]
        bins[empty] = bins[donor] + donor.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return texthash.mix((bins.reshape(BANDS, ROWS) * _MIX).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64), 3)


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[np.ndarray]:
    for h in texthash.words(map(texthash.ascii_lower, batch.column(1).to_pylist())):
        yield texthash.shingles(h, k)


def _i64(x: list) -> pa.Array:
    return pa.array(np.array(x, np.uint64).view(np.int64), pa.int64())


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def _signed(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, np.uint64)
        for b in batches:
            n, hi, lo, bands = [], [], [], []
            for s in _sets(b, k):
                d = texthash.digest(s)
                n.append(len(s))
                hi.append(d[0])
                lo.append(d[1])
                bands.append(band_keys(s) if len(s) else none)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), _i64(hi), _i64(lo), _lists(bands)], ["doc_id", "n_shingles", "hi", "lo", "bands"])

    return run


def _listed(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), _lists(list(_sets(b, k)))], ["rep", "items"])

    return run


def _joined_components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (rep, comp) after the links (a, b): components hook to their smallest neighbour and
    pointers are doubled until no link joins two components."""
    while True:
        ends = links.join(labels.select(F.col("rep").alias("a"), F.col("comp").alias("x")), "a").join(labels.select(F.col("rep").alias("b"), F.col("comp").alias("y")), "b")
        across = ends.where("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
        hooks = across.select(F.col("y").alias("comp"), F.col("x").alias("to")).groupBy("comp").agg(F.min("to").alias("to"))
        hooks = common.stored(hooks, "hooks")
        if hooks.isEmpty():
            return labels
        for _ in range(2):
            far = hooks.select(F.col("comp").alias("to"), F.col("to").alias("far"))
            hooks = hooks.join(far, "to", "left").select("comp", F.coalesce("far", "to").alias("to"))
        labels = common.stored(labels.join(hooks, "comp", "left").select("rep", F.coalesce("to", "comp").alias("comp")), "labels")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    left = sets.select(F.col("rep").alias("a"), F.col("items").alias("s"))
    right = sets.select(F.col("rep").alias("b"), F.col("items").alias("t"))
    both = pairs.join(right, "b").join(left, "a")
    common_items = F.size(F.array_intersect("s", "t"))
    sized = (100 * F.least(F.size("s"), F.size("t"))) >= percent * F.greatest(F.size("s"), F.size("t"))
    return both.where(sized).select("a", "b", common_items.alias("i"), (F.size("s") + F.size("t")).alias("n")).where(F.expr(f"100 * i >= {percent} * (n - i)")).select("a", "b").distinct()


def _reachable(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """members with n (items) and most (items that some other set holds too), without those whose
    bucket holds no set that they could be linked with: a link needs (100 + percent) * most >=
    percent * (n + the other's n)."""
    alone = sets.select("rep", F.explode("items").alias("item")).groupBy("item").agg(F.min("rep").alias("rep"), F.count("*").alias("c")).where("c = 1").groupBy("rep").agg(F.count("*").alias("own"))
    sized = sets.groupBy("rep").agg(F.min(F.size("items")).alias("n"), F.max(F.size("items")).alias("top"), F.count("*").alias("rows")).join(alone, "rep", "left")
    # one id may stand for several texts: then nothing is subtracted
    sized = common.stored(sized.select("rep", "n", F.expr("CASE WHEN rows = 1 THEN n - coalesce(own, 0) ELSE top END").alias("most")), "sizes")
    rows = members.join(sized, "rep")
    least = rows.groupBy("key").agg(F.min("n").alias("least"))
    return common.stored(rows.join(least, "key").where(f"{100 + percent} * most >= {percent} * (n + least)").select("key", "rep", "n", "most"), "members")


def _linked(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(rep, comp) of all members (key, rep, n, most) of shared buckets."""
    labels = common.stored(members.select("rep", F.col("rep").alias("comp")).distinct(), "labels")
    left, rank = members, F.lit(0)
    for step in range(2):
        state = _open(left, labels, rank, step)
        centres = state.where("rank = top").select("key", F.col("rep").alias("c"), F.col("comp").alias("c_comp"), F.col("n").alias("c_n"), F.col("most").alias("c_most"))
        can = f"comp <> c_comp AND {100 + percent} * least(most, c_most) >= {percent} * (n + c_n)"
        stars = state.join(centres, "key").where(can).select(F.least("rep", "c").alias("a"), F.greatest("rep", "c").alias("b")).distinct()
        links = common.stored(_confirmed(stars, sets, percent), "links")
        labels = _joined_components(labels, links)
        ends = links.select(F.col("a").alias("rep")).unionAll(links.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count("*").alias("deg"))
        centres = centres.select("key", "c")
        left = state.join(centres.select("key", F.col("c").alias("rep")), ["key", "rep"], "left_anti").select("key", "rep", "n", "most").join(ends, "rep", "left")
        rank = F.least(F.coalesce("deg", F.lit(0)), F.lit(1 << 30))
    last = _centred(_open(left, labels, rank, 2).join(centres, "key").select("c", "rep", "comp").distinct(), labels)
    near, meeting = _differing(last, sets, percent)
    return _joined_components(labels, common.stored(near.unionAll(_confirmed(meeting, sets, percent)), "links"))


def _centred(members: DataFrame, labels: DataFrame) -> DataFrame:
    """members (c, rep, comp) of buckets under their centre c, with one centre for all buckets whose centres are in one
    component: the one of most members. So a member of many buckets of one family is looked at once."""
    sizes = members.groupBy("c").agg(F.count("*").alias("m")).join(labels.select(F.col("rep").alias("c"), F.col("comp").alias("of")), "c")
    one = sizes.groupBy("of").agg(F.max_by("c", F.struct("m", -F.col("c"))).alias("to"))
    moved = sizes.join(one, "of").select("c", "to")
    return common.stored(members.join(moved, "c").select(F.col("to").alias("c"), "rep", "comp").distinct(), "centred")


def _open(members: DataFrame, labels: DataFrame, rank: F.Column, step: int) -> DataFrame:
    """The members of buckets that hold several components, with the rank of each and the top one."""
    dice = F.pmod(F.xxhash64("rep", "key", F.lit(step)), F.lit(1 << 32))
    state = members.join(labels, "rep").select("key", "rep", "comp", "n", "most", (rank * F.lit(1 << 32) + dice).alias("rank"))
    several = state.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("rank").alias("top")).where("lo < hi").select("key", "top")
    return common.stored(state.join(several, "key"), "buckets")


def _differing(members: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Of members (c, rep, comp) under one centre c: the links (a, b) with the centre, and the pairs (a, b) whose rarest
    differences from c meet: all that can be linked, but for those in one component and those both linked with c."""
    up, down = 100 + percent, 100 - percent
    near = members.join(sets.select("rep", F.col("items").alias("t")), "rep").join(sets.select(F.col("rep").alias("c"), F.col("items").alias("s")), "c")
    rows = near.select("c", "rep", "comp", F.size("t").alias("n"), F.size("s").alias("m"), F.concat(F.array_except("t", "s"), F.array_except("s", "t")).alias("diff"))
    rows = common.stored(rows.withColumn("d", F.size("diff")), "differing")
    # two sets are linked if up * differences <= down * (size + size)
    linked = rows.where(f"rep <> c AND {up} * d <= {down} * (n + m)").select(F.least("rep", "c").alias("a"), F.greatest("rep", "c").alias("b")).distinct()
    items = rows.select("c", "rep", "comp", "n", "d", F.explode("diff").alias("item"))
    again = items.groupBy("c", "item").agg(F.count("*").alias("df")).where("df > 1")
    own = Window.partitionBy("c", "rep", "n", "d")
    # differences that no other member has come first; they needn't be looked up, but count as places
    place = F.col("d") - F.count("*").over(own) + F.row_number().over(own.orderBy("df", "item"))
    placed = common.stored(items.join(again, ["c", "item"]).withColumn("place", place).drop("df"), "differences")
    x, y = placed.alias("x"), placed.alias("y")
    share = f"(({up} * (x.d + y.d) - {down} * (x.n + y.n) + {2 * up - 1}) div {2 * up})"
    meet = f"x.c = y.c AND x.item = y.item AND x.rep < y.rep AND x.comp <> y.comp AND {share} >= 1 AND x.place <= x.d - {share} + 1 AND y.place <= y.d - {share} + 1"
    return linked, x.join(y, F.expr(meet)).selectExpr("x.rep AS a", "y.rep AS b").distinct()


def components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest id it is linked with,
    over any number of links), kept (it is that document)."""
    spark = docs.sparkSession
    common.tune(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = common.stored(texts.mapInArrow(_signed(shingle), "doc_id long, n_shingles long, hi long, lo long, bands array<long>"), "signatures")
    classes = common.stored(
        signed.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("hi", "lo", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("bands").alias("bands")), "classes"
    )
    keyed = classes.select(F.explode("bands").alias("key"), "rep")
    shared = keyed.groupBy("key").agg(F.min("rep").alias("x"), F.max("rep").alias("y")).where("x < y").select("key")
    members = common.stored(keyed.join(shared, "key").select("key", "rep").distinct(), "members")
    reps = members.select(F.col("rep").alias("doc_id")).distinct()
    sets = common.stored(common.rows_with(texts.where("doc_id IS NOT NULL"), reps, "doc_id").mapInArrow(_listed(shingle), "rep long, items array<long>"), "sets")
    labels = _linked(_reachable(members, sets, percent), sets, percent)
    found = classes.select("hi", "lo", "n_shingles", "rep", "copies").join(labels, "rep", "left").select("hi", "lo", "n_shingles", F.coalesce("comp", "rep").alias("comp"), (F.coalesce("comp", "rep") != F.col("rep")).alias("moved"), "copies")
    found = found.where("copies > 1 OR moved").select("hi", "lo", "n_shingles", "comp")
    out = signed.select("doc_id", "n_shingles", "hi", "lo").join(found, ["hi", "lo", "n_shingles"], "left")
    return out.select("doc_id", "n_shingles", F.expr("CASE WHEN doc_id IS NOT NULL THEN coalesce(comp, doc_id) END").alias("component_id")).withColumn("kept", F.expr("doc_id <=> component_id"))


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """docs without those that another document of their component stands for; all columns stay as they are."""
    gone = common.stored(components(docs, id_col=id_col, text_col=text_col, shingle=shingle, percent=percent).where("NOT kept").select(F.col("doc_id").alias(id_col)), "dropped")
    return common.rows_without(docs, gone, id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(common.table(spark, sf_dir, "documents"), shingle=4, percent=80)


#: The same by brute force over all pairs that share a shingle; components spread along links until nothing changes.
ORACLE = """
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
 '[ \\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
 ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) END) AS x FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS i FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT u, v FROM p JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * i >= 80 * (a.n + b.n - i)),
e AS MATERIALIZED (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
c AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT c.doc_id, e.v FROM c JOIN e ON e.u = c.other)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(c.other) AS component_id, min(c.other) = d.doc_id AS kept
FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY d.doc_id
"""
