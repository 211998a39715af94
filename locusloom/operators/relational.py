"""Ranks, windows, outliers, buckets and joins over tables of scores.

Global ranks and statistics never gather all rows in one task: scalars are aggregates joined back as one
row, ranks are counted per range partition and shifted by the totals of the ranges before."""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_scalars(df: DataFrame, **aggregates: Column) -> DataFrame:
    """df with global aggregates in every row: one row is broadcast."""
    one = df.agg(*[c.alias(k) for k, c in aggregates.items()])
    return df.join(F.broadcast(one))


def ranked(df: DataFrame, by: Column, tie: str, name: str, *, parts: int | None = None) -> DataFrame:
    """Row numbers by an order with a tie-break. Rows are dealt into ranges; each range is numbered on its own and
    shifted by the sizes of those before, a table with a row for each range."""
    spark = df.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, by, F.col(tie)).withColumn("_range", F.spark_partition_id()).persist(StorageLevel.DISK_ONLY)  # both branches must see the same ranges
    own = Window.partitionBy("_range").orderBy(by, F.col(tie))
    numbered = dealt.withColumn("_own", F.row_number().over(own))
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    shift = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    return numbered.join(F.broadcast(shift), "_range").withColumn(name, (F.col("_own") + F.col("_shift")).cast("int")).drop("_range", "_own", "_shift")


def ranked_within(df: DataFrame, by: list[str], order: Column, tie: str, name: str) -> DataFrame:
    """Row numbers within groups. One sort per group: a group must fit one task's sort, which spills to disk."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(order, F.col(tie))))


def priority(df: DataFrame, semantic: str, grammatical: str, tie: str) -> DataFrame:
    """Ascending ranks by both scores, nulls last, and their sum."""
    out = ranked(df, F.col(semantic).asc_nulls_last(), tie, "semantic_rank")
    out = ranked(out, F.col(grammatical).asc_nulls_last(), tie, "grammatical_rank")
    return out.withColumn("acquisition_priority", F.col("semantic_rank") + F.col("grammatical_rank"))


def zscore(x: str, mean: str, std: str) -> Column:
    return F.try_divide(F.col(x) - F.col(mean), F.col(std))


def log_sigmoid(z: Column, temperature: float) -> Column:
    return -F.log1p(F.exp(-z / temperature))


def outliers(df: DataFrame, value: str, by: list[str], name: str) -> DataFrame:
    """Flags values more than two sample standard deviations from the mean of their group (of all rows if none)."""
    if not by:
        with_stats = with_scalars(df, _mean=F.avg(value), _std=F.stddev_samp(value))
    else:  # statistics are joined back, so that a large group isn't gathered
        with_stats = df.join(df.groupBy(*by).agg(F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_std")), by, "left")
    return with_stats.withColumn(name, F.coalesce(F.abs(F.col(value) - F.col("_mean")) > 2 * F.col("_std"), F.lit(False))).drop("_mean", "_std")


def sliced(df: DataFrame, score: str, tie: str, lo: float, hi: float) -> DataFrame:
    """Rows [floor(n lo), floor(n hi)) of the descending order of non-null scores."""
    rows = ranked(df.where(F.col(score).isNotNull()), F.col(score).desc(), tie, "_rank")
    rows = with_scalars(rows, _all=F.count("*"))
    return rows.where(f"_rank > floor(_all * {lo}) AND _rank <= floor(_all * {hi})").drop("_rank", "_all")


def unpivoted(df: DataFrame, ids: list[str], values: list[str], name: str, value: str) -> DataFrame:
    return df.unpivot(ids, values, name, value)


def annotated(df: DataFrame, sides: list[tuple[DataFrame, list[str]]]) -> DataFrame:
    """A chain of left joins; Spark broadcasts sides that are small enough."""
    return reduce(lambda left, side: left.join(side[0], side[1], "left"), sides, df)


def overriding(base: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Union in which rows of other replace rows of base with the same key."""
    return base.join(other.select(key), key, "left_anti").unionByName(other, allowMissingColumns=True)


def both_ways(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs and their mirror images."""
    rest = [c for c in pairs.columns if c not in (a, b)]
    return pairs.select(a, b, *rest).unionByName(pairs.select(F.col(b).alias(a), F.col(a).alias(b), *rest))


def percent_below(df: DataFrame, value: str, name: str) -> DataFrame:
    """The share of values strictly below, in percent: counts per value, summed up range by range."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_c"))
    spark = df.sparkSession
    dealt = counts.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), value).withColumn("_range", F.spark_partition_id()).persist(StorageLevel.DISK_ONLY)  # both branches must see the same ranges
    own = Window.partitionBy("_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    below = dealt.withColumn("_own", F.coalesce(F.sum("_c").over(own), F.lit(0)))
    sizes = dealt.groupBy("_range").agg(F.sum("_c").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    shares = below.join(F.broadcast(shift), "_range").select(value, (100.0 * (F.col("_own") + F.col("_shift")) / F.col("_all")).alias(name))
    return df.join(shares, value, "left")


def trailing_mean(df: DataFrame, day: str, value: str, days: int) -> DataFrame:
    """day, mean of the rows of the `days` days up to it (both ends in): days are summed first."""
    daily = df.groupBy(day).agg(F.sum(value).alias("_s"), F.count(value).alias("_c"))
    span = Window.orderBy(F.unix_date(day)).rangeBetween(-days, 0)  # a row for each day
    return daily.select(day, F.try_divide(F.sum("_s").over(span), F.sum("_c").over(span)).alias("trailing_mean"))


def first_seen(monthly: DataFrame, key: str, period: str, n: str, threshold: float) -> DataFrame:
    """The first period in which a key's running total exceeds the threshold."""
    run = Window.partitionBy(key).orderBy(period)
    return monthly.withColumn("_total", F.sum(n).over(run)).where(F.col("_total") > threshold).groupBy(key).agg(F.min(period).alias("first_seen"))


def epistatic_shift(df: DataFrame, mutation: str, backbone: str, value: str, reference: str) -> DataFrame:
    """Each value less that of the reference backbone for the same mutation."""
    base = df.where(F.col(backbone) == reference).groupBy(mutation).agg(F.first(value).alias("_base"))
    return df.where(F.col(backbone) != reference).join(base, mutation).withColumn("shift", F.col(value) - F.col("_base")).drop("_base")
