"""Statistics whose sums are DataFrame aggregates; only tails of distributions (scalars) are computed in Python."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import ranked


def average_ranks(df: DataFrame, value: str, name: str, by: list[str] = ()) -> DataFrame:
    """Ranks of a numeric column in which ties share their mean, within groups or over all rows. Counts of distinct values are
    dealt into ranges by sampled bounds; each range of a group is summed up by itself and shifted by the ranges
    before, so neither a large group nor the whole table meets in one task."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    parts = min(256, max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    number = F.col(value).cast("double")
    bounds = counts.agg(F.percentile_approx(number, [k / parts for k in range(1, parts)], 10_000)).first()[0] or []
    at = F.size(F.filter(F.array(*[F.lit(float(b)) for b in sorted(set(bounds))]), lambda b: b <= number)) if bounds else F.lit(0)
    counts = counts.withColumn("_range", at)
    own = Window.partitionBy("_range", *by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of a group
    shift = counts.groupBy("_range", *by).agg(F.sum("_c").alias("_n")).select("_range", *by, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    below = counts.withColumn("_own", F.coalesce(F.sum("_c").over(own), F.lit(0))).join(shift, ["_range", *by])
    ranks = below.select(*by, value, (F.col("_own") + F.col("_shift") + (F.col("_c") + 1) / 2).alias(name))
    return df.join(ranks, [*by, value])


def spearman(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """rho and n per group over rows where both values are present."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    r = average_ranks(average_ranks(rows, x, "_rx", by), y, "_ry", by)
    return r.groupBy(*by).agg(F.corr("_rx", "_ry").alias("rho"), F.count("*").alias("n"))


def mann_whitney_u(df: DataFrame, value: str, group: str, first: str) -> DataFrame:
    """U of the first group, n of both, and the tie sum of cubes."""
    rows = df.where(F.col(value).isNotNull())
    r = average_ranks(rows, value, "_r")
    sums = r.agg(F.sum(F.when(F.col(group) == first, F.col("_r"))).alias("ranks"), F.count_if(F.col(group) == first).alias("n1"), F.count_if(F.col(group) != first).alias("n2"))
    ties = rows.groupBy(value).agg(F.count("*").alias("t")).agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    return sums.join(F.broadcast(ties)).select((F.col("ranks") - F.col("n1") * (F.col("n1") + 1) / 2).alias("u"), "n1", "n2", "ties")


def mann_whitney_p(u: float, n1: int, n2: int, ties: float) -> float:
    """Two-sided, normal with tie and continuity correction."""
    n = n1 + n2
    sd = math.sqrt(n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1))))
    return min(1.0, math.erfc(max(0.0, abs(u - n1 * n2 / 2) - 0.5) / sd / math.sqrt(2))) if sd else 1.0


def hypergeometric_tail(k: int, total: int, marked: int, drawn: int) -> float:
    """P(at least k marked)."""
    def choose(n: int, r: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(r + 1) - math.lgamma(n - r + 1)

    lo, hi = max(k, drawn + marked - total, 0), min(marked, drawn)
    return min(1.0, math.fsum(math.exp(choose(marked, i) + choose(total - marked, drawn - i) - choose(total, drawn)) for i in range(lo, hi + 1)))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(tiny, abs(1 - (a + b) * x / (a + 1))) * (1 if 1 - (a + b) * x / (a + 1) >= 0 else -1)
    out = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return out


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def correlation_p(rho: float, n: int) -> float:
    """Two-sided p-value of a rank correlation, Student t with n - 2 degrees."""
    if n < 3 or abs(rho) >= 1:
        return 0.0 if n >= 3 else float("nan")
    t2 = rho * rho * (n - 2) / (1 - rho * rho)
    return incomplete_beta((n - 2) / 2, 0.5, (n - 2) / (n - 2 + t2))


def bonferroni(df: DataFrame, p: str, predictor: str) -> DataFrame:
    """p times the number of distinct predictors, not clipped, and a star below 0.05."""
    n = df.agg(F.countDistinct(predictor).alias("_n"))
    out = df.join(F.broadcast(n)).withColumn("corrected", F.col(p) * F.col("_n")).drop("_n")
    return out.withColumn("significant", F.when(F.col("corrected") < 0.05, "*").otherwise(""))


def benjamini_hochberg(df: DataFrame, p: str, tie: str, block: int = 100_000) -> DataFrame:
    """The false discovery rate. The running minimum from the end is taken within blocks of ranks, then over blocks."""
    rows = ranked(df.where(F.col(p).isNotNull()), F.col(p).asc(), tie, "_rank")
    rows = rows.join(F.broadcast(rows.agg(F.count("*").alias("_m")))).withColumn("_q", F.col(p) * F.col("_m") / F.col("_rank"))
    rows = rows.withColumn("_block", F.floor((F.col("_rank") - 1) / block))
    after = Window.partitionBy("_block").orderBy("_rank").rowsBetween(0, Window.unboundedFollowing)
    later = Window.orderBy("_block").rowsBetween(1, Window.unboundedFollowing)  # a row for each block
    blocks = rows.groupBy("_block").agg(F.min("_q").alias("_least")).select("_block", F.min("_least").over(later).alias("_later"))
    out = rows.withColumn("_q", F.min("_q").over(after)).join(F.broadcast(blocks), "_block")
    return out.withColumn("fdr", F.least(F.lit(1.0), "_q", "_later")).drop("_rank", "_m", "_q", "_block", "_later")


def confusion(truth: Column, guess: Column) -> list[Column]:
    tp, fp, fn, tn = (F.count_if(c) for c in (truth & guess, ~truth & guess, truth & ~guess, ~truth & ~guess))
    return [
        tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"),
        F.try_divide(tp, tp + fn).alias("sensitivity"), F.try_divide(tn, tn + fp).alias("specificity"), F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1"),
    ]


def ols(df: DataFrame, y: str, xs: list[str]) -> dict:
    """Least squares with intercept from one aggregate of cross products (k + 1 squared numbers)."""
    import numpy as np

    rows = df.where(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c}) AND abs({c}) < double('Infinity')" for c in [y, *xs]))
    names = ["_one", *xs]
    rows = rows.withColumn("_one", F.lit(1.0))
    terms = [F.sum(F.col(a) * F.col(b)) for a in [*names, y] for b in [*names, y]]
    k = len(names)
    m = np.array([float(v or 0) for v in rows.agg(*terms).first()]).reshape(k + 1, k + 1)
    n, xx, xy, yy = m[0, 0], m[:k, :k], m[:k, k], m[k, k]
    beta = np.linalg.solve(xx, xy)
    rss = float(yy - beta @ xy)
    tss = float(yy - m[0, k] ** 2 / n)
    df_model, df_rest = k - 1, n - k
    s2 = rss / df_rest
    se = np.sqrt(np.diag(np.linalg.inv(xx)) * s2)
    r2 = 1 - rss / tss
    loglik = -n / 2 * (math.log(2 * math.pi) + math.log(rss / n) + 1)
    t = beta / se
    return {"coef": dict(zip(["intercept", *xs], beta.tolist(), strict=True)), "se": se.tolist(), "t": t.tolist(), "p": [float(incomplete_beta(df_rest / 2, 0.5, df_rest / (df_rest + v * v))) for v in t], "r2": r2, "f": (r2 / df_model) / ((1 - r2) / df_rest), "n": int(n), "aic": 2 * k - 2 * loglik, "bic": k * math.log(n) - 2 * loglik}
