"""Shapes of result tables: pivots, ordered vectors, matrices of model output, joins with suffixes and by row index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as seq
from .relational import ranked, with_scalars

AMINO_ACIDS = tuple(seq.AMINO_ACIDS)


def mean_or_first(df: DataFrame, by: list[str], means: list[str], firsts: list[str], order: str) -> DataFrame:
    """Per group the mean of some columns and the first non-null value, by `order`, of others."""
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in firsts]
    return df.groupBy(*by).agg(*[F.avg(c).alias(c) for c in means], *first)


def pivoted(df: DataFrame, index: list[str], columns: str, names: Sequence[str], value: str, order: str | None = None) -> DataFrame:
    """A row for each index, a column for each of `names`: the first non-null value by `order`, or the mean without one.
    Names are given, so no pass is needed to find them."""
    own = [F.when(F.col(columns) == n, F.col(value)) for n in names]
    cells = [F.avg(c) if order is None else F.min_by(c, F.when(c.isNotNull(), F.col(order))) for c in own]
    return df.groupBy(*index).agg(*[c.alias(n) for c, n in zip(cells, names, strict=True)])


def ordered_vectors(df: DataFrame, position: str, letter: str, value: str, letters: Sequence[str] = AMINO_ACIDS) -> DataFrame:
    """position and vector: the values of a position in the order of the letters; missing and NaN are 0."""
    sound = df.withColumn(value, F.nanvl(F.col(value).cast("double"), F.lit(None)))
    wide = pivoted(sound, [position], letter, letters, value)
    return wide.select(position, F.array(*[F.coalesce(c, F.lit(0.0)) for c in letters]).alias("vector"))


def tidy_logits(logits: DataFrame, outside: Sequence[str] = ("<cls>", "<eos>"), value: str = "logit") -> DataFrame:
    """seq_id, pos and one column for each amino acid, in fixed order; sites whose own token (`own`) stands outside the
    sequence are left out, and positions count anew from 0."""
    first = logits.where(~F.col("own").isin(*outside)).groupBy("seq_id").agg(F.min("pos").alias("_first"))
    inside = logits.where(~F.col("own").isin(*outside)).join(first, "seq_id").withColumn("pos", F.col("pos") - F.col("_first"))
    return pivoted(inside, ["seq_id", "pos"], "token", AMINO_ACIDS, value)


def probability_matrix(logp: DataFrame) -> DataFrame:
    """Probabilities of the 20 amino acids at each site (seq_id, pos, token, p), not renormalised over the 20."""
    return logp.where(F.col("token").isin(*AMINO_ACIDS)).select("seq_id", "pos", "token", F.exp("logp").alias("p"))


def site_changes(mutants: DataFrame, reference: DataFrame) -> DataFrame:
    """For each mutant (label, site from 1, own: log-probabilities of its own residues) and site the change against the
    reference (one row: own); null at the mutated site. Identities (no change of residue) are to be left out before."""
    sides = mutants.join(F.broadcast(reference.select(F.col("own").alias("_ref")).limit(1)))
    change = F.zip_with("own", "_ref", lambda x, r: x.cast("double") - r.cast("double"))
    rows = sides.select("label", "site", F.posexplode(change).alias("pos", "change")).withColumn("pos", F.col("pos") + 1)
    return rows.withColumn("change", F.when(F.col("pos") != F.col("site"), F.col("change"))).drop("site")


def exploded_mutations(df: DataFrame, mutations: str, name: str = "mutation") -> DataFrame:
    """A row for each mutation of a comma list; deletions are left out."""
    rows = df.withColumn(name, F.explode(F.split(mutations, ", *"))).withColumn(name, F.trim(name))
    return rows.where((F.col(name) != "") & ~F.col(name).contains("del")).drop(*({mutations} - {name}))


def rescaled_reverse(df: DataFrame, value: str, name: str) -> DataFrame:
    """1 - (x + |min|) / max(x + |min|)."""
    rows = with_scalars(df, _lo=F.abs(F.min(value)), _hi=F.max(value))
    return rows.withColumn(name, 1 - F.try_divide(F.col(value) + F.col("_lo"), F.col("_hi") + F.col("_lo"))).drop("_lo", "_hi")


def suffix_join(left: DataFrame, right: DataFrame, on: list[str], suffixes: tuple[str, str] = ("_x", "_y"), cell: int = 1 << 22) -> DataFrame:
    """Inner join in which other columns of both sides get suffixes. Keys needn't be unique: rows multiply.

    A key that gives more than `cell` rows is cut into cells of about that many: its rows of the larger side are dealt out
    by their hash, those of the smaller side go to each cell. Cells are dealt over all shuffle partitions, which Spark
    neither merges nor avoids by a broadcast, since it judges by the rows that come in."""
    both = {c for c in left.columns if c in right.columns and c not in on}
    sides = [df.withColumnsRenamed({c: c + s for c in both}) for df, s in zip((left, right), suffixes, strict=True)]
    counts = [df.groupBy(*on).agg(F.count("*").alias(n)) for df, n in zip(sides, ("_a", "_b"), strict=True)]
    rows = F.col("_a").cast("double") * F.col("_b")
    cut = counts[0].join(counts[1], on).where(rows > cell).select(*on, F.ceil(rows / cell).cast("long").alias("_cells"), (F.col("_a") <= F.col("_b")).alias("_copied"))
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = []
    for df, copied in zip(sides, (F.col("_copied"), ~F.col("_copied")), strict=True):
        hashed = [c for c, kind in df.dtypes if "map<" not in kind]
        at = F.when(F.col("_cells").isNull(), F.array(F.lit(0).cast("long"))).when(copied, F.sequence(F.lit(0).cast("long"), F.col("_cells") - 1)).otherwise(F.array(F.pmod(F.xxhash64(*hashed), F.col("_cells"))))
        dealt.append(df.join(cut, on, "left").withColumn("_cell", F.explode(at)).drop("_cells", "_copied").repartition(n, *on, "_cell"))
    return dealt[0].join(dealt[1].hint("merge"), [*on, "_cell"]).drop("_cell")


def index_join(left: DataFrame, column: str, right: DataFrame, order: str, tie: str) -> DataFrame:
    """left with the row of right whose index (from 0, in the given order) is the column's value."""
    rows = ranked(right, F.col(order).asc_nulls_last(), tie, "_index").withColumn("_index", F.col("_index") - 1)
    return left.join(rows, left[column] == F.col("_index")).drop("_index")


def pair_distances(pairs: DataFrame, position: str, other: str, mutation: str) -> DataFrame:
    """pairs with the distance along the sequence and the number of sites that each mutation affects (its rows)."""
    sites = pairs.groupBy(mutation).agg(F.count("*").alias("sites_affected"))
    return pairs.withColumn("distance_1d", F.abs(F.col(position) - F.col(other))).join(sites, mutation)


def in_order(df: DataFrame, key: str, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The rows of listed keys with their place in the list, columns in the given order."""
    places = F.create_map(*[F.lit(x) for i, k in enumerate(keys) for x in (k, i)])
    return df.withColumn("place", places[F.col(key)]).where("place IS NOT NULL").select("place", *columns)


def finite(column: str) -> Column:
    """The value, or null where it is NaN or infinite."""
    return F.when(~F.isnan(column) & (F.abs(column) != float("inf")), F.col(column))


def representation_table(df: DataFrame, representations: str, keep: Sequence[str]) -> DataFrame:
    """keep, label and vector: a row for each entry of a map from labels to vectors."""
    return df.select(*keep, F.explode(representations).alias("label", "vector"))


def flat_scores(df: DataFrame, scores: str, metrics: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """A row for each label of a map from labels to maps of metrics, a column for each of the metrics, null if missing."""
    rows = df.select(*keep, F.explode(scores).alias("label", "_m"))
    return rows.select(*keep, "label", *[F.try_element_at("_m", F.lit(m)).alias(m) for m in metrics])
