"""Canonical exact fingerprints, in DataFrame functions only.

The canonical form of a text: compatibility composition (NFKC), full case folding, composition again,
every run of white space one space, none at the ends. The first two come from the ICU library that Spark
ships for its collations, called through the SQL function `reflect`. A fingerprint is 128 bits of xxhash (two
seeds) and the canonical length. Equal fingerprints are then compared byte by byte: texts whose hash occurs
more than once are grouped by hash and canonical bytes (grouping compares the bytes, and copies
collapse before the exchange), and if one hash holds several texts, each gets an ordinal. Which hashes occur
more than once is passed on as at most SLOTS slots, so few texts are shuffled for the comparison.

Defined results: a null text is an empty one; texts that differ in case, white space or compatibility
forms only have one fingerprint; rows that repeat have equal fingerprints; other columns pass through
`fingerprints`; an empty table gives no rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common


def canonical(text: F.Column) -> F.Column:
    def compose(x: F.Column) -> F.Column:
        return F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), x, F.lit(True))

    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), compose(F.coalesce(text, F.lit(""))), F.lit(True))
    return F.trim(F.regexp_replace(compose(folded), r"(?U)\s+", " "))


def _hash(form: F.Column) -> list[F.Column]:
    return [F.xxhash64(form).alias("h1"), F.xxhash64(F.lit("second"), form).alias("h2"), F.length(form).cast("long").alias("size")]


HASH = ["h1", "h2", "size"]


def shared_slots(hashed: DataFrame) -> DataFrame:
    """The slots of hashes that occur more than once, SLOTS longs at most; hashed: HASH, a row for each text."""
    return common.slots_of(hashed.groupBy(*HASH).agg(F.count("*").alias("c")).where("c > 1"), "h1")


def _ordinals(forms: DataFrame, slots: DataFrame) -> DataFrame | None:
    """(h1, h2, size, form, ordinal) of texts that share a hash with another text, from the byte comparison;
    None if no two do. forms: canonical forms, of all texts whose hash is in the slots at least."""
    texts = forms.select("form", *_hash(F.col("form"))).withColumn("_slot", common.slot(F.col("h1")))
    texts = texts.join(F.broadcast(slots), "_slot", "left_semi").groupBy(*HASH, "form").agg(F.count("*").alias("c"))
    clash = common.stored(texts.groupBy(*HASH).agg(F.count("*").alias("texts")).where("texts > 1"), "clashes")
    if clash.isEmpty():
        return None
    order = Window.partitionBy(*HASH).orderBy(F.col("form").cast("binary"))
    return texts.join(clash, HASH).select(*HASH, "form", (F.row_number().over(order) - 1).alias("ordinal"))


def _rendered(ordinal: F.Column, hashes: list[F.Column]) -> F.Column:
    h1, h2, size = hashes
    words = F.concat(F.lpad(F.lower(F.hex(h1)), 16, "0"), F.lpad(F.lower(F.hex(h2)), 16, "0"))
    return F.concat_ws("-", words, F.lower(F.hex(size)), F.when(ordinal > 0, ordinal.cast("string")))  # concat_ws leaves nulls out


def fingerprints(rows: DataFrame, text_cols: dict[str, str], compared: Callable[[DataFrame, DataFrame], DataFrame] | None = None, seen_twice: tuple[str, ...] = ()) -> DataFrame:
    """rows with a fingerprint for each text column: text_cols maps it to the new column. The text
    columns themselves are dropped; all their texts are one universe of fingerprints. Where rows are costly
    to make again, compared(hashed, slots) gives the canonical forms (form) that the byte comparison needs:
    hashed has a struct of HASH for each new column, slots those of hashes that occur more than once. New
    columns in seen_twice repeat texts of others and don't count as copies."""
    kept = [c for c in rows.columns if c not in text_cols and c not in text_cols.values()]
    names = list(text_cols.values())
    own = [common.fresh(rows, f"_form_{k}") for k in range(len(names))]
    forms = rows.select(*kept, *[canonical(F.col(c)).alias(o) for o, c in zip(own, text_cols, strict=True)])
    hashed = forms.select(*kept, *[F.struct(*_hash(F.col(o))).alias(n) for o, n in zip(own, names, strict=True)])
    hashed = common.stored(hashed, "fingerprints")
    slots = shared_slots(hashed.select(F.explode(F.array(*[n for n in names if n not in seen_twice])).alias("h")).select("h.*"))
    one = compared(hashed, slots) if compared else forms.select(F.explode(F.array(*own)).alias("form"))
    clashing = _ordinals(one, slots)
    if clashing is None:
        return hashed.select(*kept, *[_of_struct(n) for n in names])
    out = forms
    for o, n in zip(own, names, strict=True):  # equal hashes of different texts: never seen but in tests with a weakened hash
        at = common.fresh(out, "_ordinal")
        out = out.join(clashing.select(F.col("form").alias(o), F.col("ordinal").alias(at)), o, "left")
        out = out.withColumn(n, _rendered(F.col(at), _hash(F.col(o)))).drop(at)
    return out.select(*kept, *names)


def _of_struct(name: str) -> F.Column:
    h1, h2, size = (F.col(name)[c] for c in HASH)
    return F.concat_ws("-", F.concat(F.lpad(F.lower(F.hex(h1)), 16, "0"), F.lpad(F.lower(F.hex(h2)), 16, "0")), F.lower(F.hex(size))).alias(name)


def _ranges(ids: DataFrame, count: int) -> list[int]:
    """Bounds that part the ids into about equal ranges; at most `count` values reach the driver."""
    got = ids.agg(F.percentile_approx("_order", [k / count for k in range(1, count)], 10 * count).alias("b")).first()[0] if count > 1 else []
    return sorted(set(got or []))


def with_next(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text, next_id and next_text: what follows by descending id; the first follows the last. Ids are
    parted into ranges by sampled bounds, each range is sorted by itself, and takes in a copy of the
    first row of the range below; so each text is shuffled once, and no range needs all rows. Null ids
    come last; rows of equal ids are ordered by text."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("_order", F.coalesce("doc_id", F.lit(-(1 << 63))))
    bounds = _ranges(rows.select("_order"), 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    steps = list(range(len(bounds).bit_length() - 1, -1, -1))
    known = F.array(*[F.lit(b) for b in bounds]) if bounds else F.array(F.lit(0))

    def ranged(order: F.Column) -> F.Column:  # the number of bounds <= order, by binary search
        def step(at: F.Column, bit: F.Column) -> F.Column:
            to = at + F.expr("1L") * bit
            return F.when((to <= len(bounds)) & (F.get(known, (to - 1).cast("int")) <= order), to).otherwise(at)

        if not bounds:
            return F.lit(0).cast("long")
        return F.aggregate(F.array(*[F.lit(1 << s).cast("long") for s in steps]), F.lit(0).cast("long"), step)

    rows = rows.withColumn("_range", ranged(F.col("_order")))
    # the first row of each range: at most as many rows as ranges
    first = rows.groupBy("_range").agg(F.max("_order").alias("_order"))
    below = Window.orderBy(F.col("_range").desc())
    first = first.select("_range", "_order").withColumn("_to", F.lag("_range").over(below)).withColumn("_low", F.min("_range").over(Window.partitionBy()))
    firsts = first.select(F.col("_order").alias("_o"), F.coalesce("_to", "_low").alias("_to"))
    guests = rows.join(F.broadcast(firsts), F.col("_order") == F.col("_o")).groupBy("_to").agg(F.min_by(F.struct("doc_id", "text"), "text").alias("g")).select("_to", "g.*")
    every = rows.select("doc_id", "text", "_order", "_range", F.lit(0).alias("_guest")).unionByName(guests.select("doc_id", "text", F.lit(0).cast("long").alias("_order"), F.col("_to").alias("_range"), F.lit(1).alias("_guest")))
    order = Window.partitionBy("_range").orderBy("_guest", F.col("_order").desc(), "text")
    return every.withColumns({"next_id": F.lead("doc_id").over(order), "next_text": F.lead("text").over(order)}).where("_guest = 0").select("doc_id", "text", "next_id", "next_text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")

    def edits(rows: DataFrame) -> DataFrame:
        edited = F.concat(F.expr("substring(text, 1, length(text) - length(text) div 3)"), F.expr("substring(next_text, 1, length(text) div 3)"))
        return with_next(rows).withColumn("edited", edited)

    def compared(hashed: DataFrame, slots: DataFrame) -> DataFrame:
        """Whole texts as they are read; edited ones are made again only where their hash came up before, from
        these rows and their next ones (between the two there is no other, so they stay neighbours)."""
        again = hashed.withColumn("_slot", common.slot(F.col("edited_fingerprint.h1"))).join(F.broadcast(slots), "_slot", "left_semi")
        ids = again.select(F.explode(F.array("doc_id", "next_id")).alias("doc_id"))
        some = docs.withColumn("_slot", common.slot(F.col("doc_id").cast("long"))).join(F.broadcast(common.slots_of(ids, "doc_id")), "_slot", "left_semi")
        return docs.select(canonical(F.col("text")).alias("form")).unionAll(edits(some).select(canonical(F.col("edited")).alias("form")))

    rows = edits(docs).withColumn("n_chars", F.length("text").cast("long")).withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    rows = rows.select("doc_id", "next_id", "n_chars", "edited_sha256", "text", "edited", "next_text")
    out = fingerprints(rows, {"text": "fingerprint", "edited": "edited_fingerprint", "next_text": "next_fingerprint"}, compared, ("next_fingerprint",))
    alike = [(F.col("fingerprint") == F.col(f"{x}_fingerprint")).cast("double").alias(f"near_{x}") for x in ("edited", "next")]
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", *alike)
