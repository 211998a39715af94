"""Metrics over a long table of model output: seq_id, pos, token, logit. One exchange by (seq_id, pos) serves softmax
and entropy; sums per sequence follow with partial aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SITE = ["seq_id", "pos"]


def log_softmax(logits: DataFrame) -> DataFrame:
    """logits with logp, by log-sum-exp over each site."""
    top = logits.groupBy(*SITE).agg(F.max("logit").alias("_top"))
    shifted = logits.join(top, SITE)
    norm = shifted.groupBy(*SITE).agg(F.log(F.sum(F.exp(F.col("logit") - F.col("_top")))).alias("_log"))
    return shifted.join(norm, SITE).withColumn("logp", F.col("logit") - F.col("_top") - F.col("_log")).drop("_top", "_log")


def entropy(logp: DataFrame) -> DataFrame:
    """Shannon entropy of each site over the whole vocabulary, natural log, probabilities clamped at 1e-9."""
    p = F.exp("logp")
    return logp.groupBy(*SITE).agg((-F.sum(p * F.log(F.greatest(p, F.lit(1e-9))))).alias("entropy"))


def own(logp: DataFrame, residues: DataFrame) -> DataFrame:
    """The log-probability of each site's own residue; residues: seq_id, pos, token."""
    return logp.join(residues, ["seq_id", "pos", "token"]).select(*SITE, "token", "logp")


def sequence_grammaticality(own_logp: DataFrame, masked: DataFrame | None = None) -> DataFrame:
    """The sum over a sequence; masked sites (seq_id, pos) are left out."""
    kept = own_logp if masked is None else own_logp.join(masked.select(*SITE), SITE, "left_anti")
    return kept.groupBy("seq_id").agg(F.sum("logp").alias("sequence_grammaticality"))


def grammaticality(logp: DataFrame, mutations: DataFrame) -> DataFrame:
    """seq_id, grammaticality (sum of log p of alts), relative (less that of refs), probability; mutations: seq_id, pos,
    ref, alt. Sequences without mutations aren't in the result; their sums are 0 and the probability 1."""
    alt = mutations.join(logp.select(*SITE, F.col("token").alias("alt"), F.col("logp").alias("_alt")), [*SITE, "alt"])
    both = alt.join(logp.select(*SITE, F.col("token").alias("ref"), F.col("logp").alias("_ref")), [*SITE, "ref"])
    out = both.groupBy("seq_id").agg(F.sum("_alt").alias("grammaticality"), F.sum(F.col("_alt") - F.col("_ref")).alias("relative_grammaticality"))
    return out.withColumn("probability", F.exp("grammaticality"))


def site_ranks(logp: DataFrame, residues: DataFrame) -> DataFrame:
    """Own probability, entropy and largest other probability of each site."""
    p = logp.join(residues.select(*SITE, F.col("token").alias("ref")), SITE).withColumn("p", F.exp("logp"))
    sites = p.groupBy(*SITE, "ref").agg(F.max(F.when(F.col("token") == F.col("ref"), F.col("p"))).alias("reference_probability"), F.max(F.when(F.col("token") != F.col("ref"), F.col("p"))).alias("max_other_probability"))
    return sites.join(entropy(logp), SITE)


def scored(sequences: DataFrame, scorer, schema: str) -> DataFrame:
    """Runs a model: scorer() is called once per task and gives a function from a batch of rows to rows (pandas). Equal
    sequences are scored once. The model itself is an input; none is shipped."""

    def run(batches):
        model = scorer()
        for b in batches:
            yield model(b)

    unique = sequences.select("sequence").distinct()
    return sequences.join(unique.mapInPandas(run, schema), "sequence", "left")
