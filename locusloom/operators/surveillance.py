"""Composite operators over scores and samples: shares of variant mutations by rank, their appearance over time,
sliding windows over dated embeddings, and the annotation build."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequence as seq
from . import relational as rel

#: The receptor-binding domain, and the slices of a ranking.
DOMAIN = "pos BETWEEN 319 AND 541"
SLICES = ((0.0, 0.1), (0.1, 0.25), (0.25, 1.0))


def _long(scores: DataFrame, features: Sequence[str], regions: dict[str, str]) -> DataFrame:
    """label, feature, value, region: a row for each present score and each region it lies in."""
    typed = scores.select("label", "pos", *[F.col(f"`{c}`").cast("double").alias(c) for c in features])
    rows = typed.unpivot(["label", "pos"], [F.col(f"`{c}`") for c in features], "feature", "value").where("value IS NOT NULL AND NOT isnan(value)")
    inside = F.array_compact(F.array(*[F.when(F.expr(test), name) for name, test in regions.items()]))
    return rows.select("label", "feature", "value", F.explode(inside).alias("region"))


def _ranked(rows: DataFrame) -> DataFrame:
    """Descending ranks within feature and region, and the size n of each."""
    sizes = rows.groupBy("feature", "region").agg(F.count("*").alias("n"))  # a row per feature and region
    return rel.ranked_within(rows, ["feature", "region"], F.col("value").desc(), "label", "place").join(F.broadcast(sizes), ["feature", "region"])


def _grid(df: DataFrame, **axes: Sequence) -> DataFrame:
    """All combinations of parameter lists."""
    out = df.sparkSession.range(1)
    for name, values in axes.items():
        out = out.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return out.drop("id")


def _sliced_counts(rows: DataFrame, variants: DataFrame, features: Sequence[str], regions: Sequence[str], vocs: Sequence[str], slices) -> DataFrame:
    ranked = _ranked(rows)
    within = [F.when((F.col("place") > F.floor(F.col("n") * F.lit(lo))) & (F.col("place") <= F.floor(F.col("n") * F.lit(hi))), F.lit(hi)) for lo, hi in slices]
    cut = ranked.withColumn("proportion", F.explode(F.array_compact(F.array(*within))))
    met = cut.join(variants.select(F.col("mutation").alias("label"), *[F.col(f"`{v}`") for v in vocs]), "label")
    sums = met.groupBy("feature", "region", "proportion").agg(*[F.sum(F.col(f"`{v}`")).cast("double").alias(v) for v in vocs])
    whole = _grid(rows, feature=features, region=regions, proportion=[hi for _, hi in slices]).join(sums, ["feature", "region", "proportion"], "left").fillna(0.0, [f"`{v}`" for v in vocs])
    return whole.unpivot(["feature", "region", "proportion"], [F.col(f"`{v}`") for v in vocs], "voc", "count")


def variant_counts(scores: DataFrame, variants: DataFrame, features: Sequence[str], vocs: Sequence[str], *, slices=SLICES, domain: str = DOMAIN) -> DataFrame:
    """feature, region (spike: all; rbd: the domain), proportion, voc, count: how often each variant's mutations (variants:
    mutation and a column of counts per variant) fall into each slice of each descending ranking. Slices are cut at
    floor(n * bound); ties go to the smaller label; slices that no mutation meets count 0."""
    regions = {"spike": "true", "rbd": domain}
    return _sliced_counts(_long(scores, features, regions), variants, features, list(regions), vocs, slices)


def variant_counts_common(scores: DataFrame, variants: DataFrame, features: Sequence[str], domain_features: Sequence[str], vocs: Sequence[str], *, slices=SLICES, domain: str = DOMAIN) -> DataFrame:
    """variant_counts over rows that have all `features`, in the domain over those that have domain_features too. For the
    whole protein domain_features are reported under the name `0`, since they say nothing about it."""
    every = [*features, *domain_features]
    full = scores.dropna("any", subset=[f"`{c}`" for c in features])
    inner = full.dropna("any", subset=[f"`{c}`" for c in domain_features]) if domain_features else full
    spike = _sliced_counts(_long(full, every, {"spike": "true"}), variants, every, ["spike"], vocs, slices)
    spike = spike.withColumn("feature", F.when(F.col("feature").isin(*domain_features), "0").otherwise(F.col("feature"))) if domain_features else spike
    return spike.unionByName(_sliced_counts(_long(inner, every, {"rbd": domain}), variants, every, ["rbd"], vocs, slices))


#: For each region which scores are ranked and which samples are counted. BY_DATE counts samples of the domain for both
#: regions, as the published figures do.
BY_DATE = {"spike": ("true", "rbd"), "rbd": (DOMAIN, "rbd")}
BY_DATE_ALL = {"spike": ("true", "true"), "rbd": (DOMAIN, "rbd")}
BY_DATE_SPLIT = {"rbd": (DOMAIN, "rbd"), "outwith": (f"NOT ({DOMAIN})", "NOT rbd")}


def share_seen_by_date(scores: DataFrame, monthly: DataFrame, features: dict[str, str], proportions: Sequence[float], *, regions: dict[str, tuple[str, str]] = BY_DATE) -> DataFrame:
    """date, count, percentage, proportion, feature, method, region: of the top floor(n * proportion) of each ranking, how
    many samples (monthly: mutation, sample_date, rbd) up to each date hold one, and their share of it (null where
    it is empty). Days are counted once and summed up; features maps each feature to its method."""
    ranked = _ranked(_long(scores, list(features), {k: test for k, (test, _) in regions.items()}))
    sizes = ranked.groupBy("feature", "region").agg(F.max("n").alias("n"))
    tops = [F.when(F.col("place") <= F.floor(F.col("n") * F.lit(p)), F.lit(p)) for p in proportions]
    top = ranked.select("feature", "region", "label", F.explode(F.array_compact(F.array(*tops))).alias("proportion"))
    counted = F.array_compact(F.array(*[F.when(F.expr(test), k) for k, (_, test) in regions.items()]))
    seen = monthly.select(F.col("mutation").alias("label"), F.col("sample_date").alias("date"), F.explode(counted).alias("region"))
    daily = seen.join(top, ["label", "region"]).groupBy("feature", "region", "proportion", "date").agg(F.count("*").alias("_c"))
    days = monthly.where("sample_date IS NOT NULL").agg(F.collect_set("sample_date").alias("_days"))  # one row, a value per day
    whole = _grid(scores, feature=list(features), region=list(regions), proportion=list(proportions)).join(F.broadcast(days)).withColumn("date", F.explode("_days")).drop("_days")
    keys = ["feature", "region", "proportion"]
    run = Window.partitionBy(*keys).orderBy("date")
    out = whole.join(daily, [*keys, "date"], "left").withColumn("count", F.sum(F.coalesce("_c", F.lit(0))).over(run)).join(F.broadcast(sizes), ["feature", "region"], "left")
    methods = F.create_map(*[F.lit(x) for kv in features.items() for x in kv])
    return out.select("date", "count", F.try_divide(F.col("count").cast("double"), F.floor(F.col("n") * F.col("proportion"))).alias("percentage"), "proportion", "feature", methods[F.col("feature")].alias("method"), "region")


def sliding_windows(rows: DataFrame, *, days: int = 90, weight: str | None = None) -> DataFrame:
    """sample_date, mean_sliding_embedding, mean_sliding_sequence_grammaticality of the rows dated within `days` days up to
    each date (both ends in), each row counting `weight` times. Days are summed first, so a window reads a row per
    day and dimension."""
    w = (F.col(weight) if weight else F.lit(1)).cast("double")
    dated = rows.where("sample_date IS NOT NULL AND embedding IS NOT NULL").select("sample_date", "embedding", "sequence_grammaticality", w.alias("_w"))

    def trailing(daily: DataFrame, by: list[str]) -> DataFrame:
        span = Window.partitionBy(*by).orderBy(F.unix_date("sample_date")).rangeBetween(-days, 0)
        return daily.withColumn("_mean", F.try_divide(F.sum("_s").over(span), F.sum("_c").over(span)))

    cells = dated.select("sample_date", "_w", F.posexplode("embedding").alias("_dim", "_v")).groupBy("_dim", "sample_date").agg(F.sum(F.col("_w") * F.col("_v")).alias("_s"), F.sum("_w").alias("_c"))
    vectors = trailing(cells, ["_dim"]).groupBy("sample_date").agg(F.array_sort(F.collect_list(F.struct("_dim", "_mean"))).alias("_x"))
    vectors = vectors.select("sample_date", F.transform("_x", lambda x: x["_mean"]).alias("mean_sliding_embedding"))
    scored = F.col("sequence_grammaticality").isNotNull()
    sums = dated.groupBy("sample_date").agg(F.sum(F.col("_w") * F.col("sequence_grammaticality")).alias("_s"), F.sum(F.when(scored, F.col("_w"))).alias("_c"))
    means = trailing(sums, []).select("sample_date", F.col("_mean").alias("mean_sliding_sequence_grammaticality"))  # a row per day
    return vectors.join(means, "sample_date")


def sliding_deviation(rows: DataFrame, reference: Sequence[float], *, days: int = 90, least_length: int = 1265, more_than: int = 1, weight: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The windows with their distance from the reference's embedding, and the rows (sequence long enough without stops,
    cluster_size above more_than) with their deviation from the window at their own date; undated rows have nulls."""
    kept = rows.where((F.length(F.replace("sequence", F.lit("*"), F.lit(""))) >= least_length) & (F.col("cluster_size") > more_than))
    windows = sliding_windows(kept, days=days, weight=weight).withColumn("_r", F.lit([float(v) for v in reference]))
    windows = windows.withColumn("mean_sliding_embedding_semantic_score", seq.l1("_r", "mean_sliding_embedding")).drop("_r")
    met = kept.join(windows, "sample_date", "left")
    out = met.withColumns({"sliding_semantic_score": seq.l1("mean_sliding_embedding", "embedding"), "sliding_sequence_grammaticality": F.col("sequence_grammaticality") - F.col("mean_sliding_sequence_grammaticality")})
    return windows, out.select(*rows.columns, "sliding_semantic_score", "sliding_sequence_grammaticality")


def annotation_build(scan: DataFrame, sides: list[tuple[DataFrame, list[str]]], *, semantic: str = "semantic_score", grammatical: str = "grammaticality", impute: Sequence[str] = (), composite: dict[str, float] | None = None, score: str = "composite_score") -> DataFrame:
    """A scan (label, pos, ref, alt, both scores) made into one annotated table: mutations are ranked, own residues and masks
    have null ranks; each position's mean of both scores is joined back; sides are joined from the left; columns of
    `impute` get their means for nulls; `score` is the sum of the log-sigmoids of z-scores over the temperatures
    that composite gives for columns (sample deviation after imputation; null for a constant column or a null)."""
    true = (F.col("ref") != F.col("alt")) & ~F.col("alt").contains("mask")
    ranked = rel.priority(scan.where(true), semantic, grammatical, "label")
    out = ranked.unionByName(scan.where(~F.coalesce(true, F.lit(False))), allowMissingColumns=True)
    means = scan.where(true).groupBy("pos").agg(*[F.avg(c).alias(f"average_{c}") for c in (semantic, grammatical)])
    out = rel.annotated(out.join(means, "pos", "left"), sides)
    composite = composite or {}
    used = list(dict.fromkeys([*impute, *composite]))
    if not used:
        return out
    moments = {f"_{k}_{i}": f(c) for i, c in enumerate(used) for k, f in (("m", F.avg), ("s", F.stddev_samp), ("n", F.count), ("a", lambda _: F.count(F.lit(1))))}
    out = rel.with_scalars(out, **moments)
    total = F.lit(0.0)
    for i, c in enumerate(used):
        mean, std = F.col(f"_m_{i}"), F.col(f"_s_{i}")
        if c in impute:  # imputed rows add nothing to the sum of squares, only to the rows
            out = out.withColumn(c, F.coalesce(c, mean))
            std = std * F.sqrt(F.try_divide(F.col(f"_n_{i}") - 1, F.col(f"_a_{i}") - 1))
        if c in composite:
            total = total + rel.log_sigmoid(F.try_divide(F.col(c) - mean, std), composite[c])
    out = out.withColumn(score, total) if composite else out
    return out.drop(*moments)


def position_averages(annotated: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The distinct rows of some columns: a table per position from one per mutation."""
    return annotated.select(*columns).distinct()
