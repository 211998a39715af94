"""Regions of annotated genomes, and model output placed on alignments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequence as seq


def _nucleotides(features: DataFrame) -> DataFrame:
    part = F.expr("substring(origin, start + 1, end - start)")
    return features.withColumn("_nt", part).withColumn("_nt", F.when(F.col("strand") < 0, seq.reverse_complement("_nt")).otherwise(F.col("_nt")))


def coding_regions(features: DataFrame) -> DataFrame:
    """record, region (`gene:part`), protein: each part of a CDS is translated on its own; of equal keys the last stays."""
    cds = _nucleotides(features.where("type = 'CDS'")).select("record", F.expr("concat(gene, ':', part)").alias("region"), "gene", seq.translate("_nt").alias("protein"), F.struct("feature", "part").alias("_o"))
    return cds.groupBy("record", "region").agg(F.max_by(F.struct("gene", "protein"), "_o").alias("r")).select("record", "region", "r.*")


def mature_peptides(features: DataFrame) -> DataFrame:
    """record, region (product), gene, protein: parts (distinct by gene, place and number) end at their first stop and are
    joined in order."""
    parts = features.where("type = 'mat_peptide'").dropDuplicates(["record", "gene", "product", "start", "end", "part"])
    parts = _nucleotides(parts).withColumn("_p", seq.translate("_nt", to_stop=True))
    ordered = F.array_sort(F.collect_list(F.struct("feature", "part", "_p")))
    return parts.groupBy("record", F.col("product").alias("region")).agg(F.first("gene").alias("gene"), F.array_join(F.transform(ordered, lambda x: x["_p"]), "").alias("protein"))


def all_regions(features: DataFrame) -> DataFrame:
    """Mature peptides, and the coding regions of genes that have none."""
    peptides = mature_peptides(features)
    rest = coding_regions(features).join(peptides.select("record", "gene"), ["record", "gene"], "left_anti")
    return rest.unionByName(peptides)


def site_batches(expanded: DataFrame) -> DataFrame:
    """A deep mutational scan in batches of one site each: all variants of a site, in order."""
    return expanded.groupBy("pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("alt", "label", "variant"))), lambda x: F.struct(x["label"].alias("label"), x["variant"].alias("variant"))).alias("variants"))


def on_alignment(aligned: DataFrame, logp: DataFrame) -> DataFrame:
    """Model output on alignment columns: aligned has seq_id, ref, query (with gaps), logp has seq_id, pos (of the query's
    letters), token, logp. Columns where the reference has a gap are left out; where the query has one, token and
    logp are null. Neither side is broadcast: Spark takes exploded rows to be as large as what they were exploded from."""
    columns = aligned.select("seq_id", "ref", "query", F.expr("explode(CASE WHEN length(ref) > 0 THEN sequence(1, length(ref)) END)").alias("column"))
    columns = columns.select("seq_id", "column", F.expr("substring(ref, column, 1)").alias("r"), F.expr("substring(query, column, 1)").alias("q"))
    run = Window.partitionBy("seq_id").orderBy("column")
    placed = columns.withColumn("pos", F.when(F.col("q") != "-", F.sum((F.col("q") != "-").cast("int")).over(run))).where("r <> '-'")
    return placed.join(logp.hint("merge"), ["seq_id", "pos"], "left").select("seq_id", "column", F.col("q").alias("residue"), "pos", "token", "logp")
