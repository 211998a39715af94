"""The registered queries over the driver's tables, each beside the same result in SQL. Long floats are rounded where the
order of summation could show."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import sequence as seq
from ..operators import model_output as mo
from ..operators import relational as rel
from ..operators import statistics as st
from ..operators import surveillance as sv

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- scores of vectors, ranks and priority ---------------------------------------------------------------------

_L1 = "list_sum(list_transform(list_zip(e.embedding, r.embedding), lambda x: abs(x[1]::DOUBLE - x[2]::DOUBLE)))"
_NORM = "list_sum(list_transform(e.embedding, lambda x: abs(x::DOUBLE)))"


@query(f"""
WITH r AS (SELECT embedding FROM embeddings WHERE vec_id = 0),
s AS (SELECT vec_id, round({_L1}, 6) AS semantic_score, round({_NORM}, 6) AS grammaticality FROM embeddings e, r)
SELECT *, row_number() OVER (ORDER BY semantic_score NULLS LAST, vec_id)::INT AS semantic_rank, row_number() OVER (ORDER BY grammaticality NULLS LAST, vec_id)::INT AS grammatical_rank,
 (row_number() OVER (ORDER BY semantic_score NULLS LAST, vec_id) + row_number() OVER (ORDER BY grammaticality NULLS LAST, vec_id))::INT AS acquisition_priority FROM s""")
def semantic_score_l1(spark: SparkSession, sf: str) -> DataFrame:
    e = t(spark, sf, "embeddings").select("vec_id", "embedding")
    ref = e.where("vec_id = 0").select(F.col("embedding").alias("ref")).limit(1)
    s = e.join(F.broadcast(ref)).select("vec_id", F.round(seq.l1("embedding", "ref"), 6).alias("semantic_score"), F.round(F.expr("aggregate(embedding, 0D, (s, x) -> s + abs(double(x)))"), 6).alias("grammaticality"))
    return rel.priority(s, "semantic_score", "grammaticality", "vec_id")


@query("""
WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings),
c AS (SELECT label, i, avg(v) AS m FROM x GROUP BY ALL)
SELECT vec_id, round(sum(abs(v - m)), 4) AS centroid_l1 FROM x JOIN c USING (label, i) GROUP BY vec_id""")
def centroid_l1(spark: SparkSession, sf: str) -> DataFrame:
    e = t(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    means = e.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    centres = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("centre"))  # as long as a vector
    return e.join(centres, "label").groupBy("vec_id").agg(F.round(F.sum(seq.l1("embedding", "centre")), 4).alias("centroid_l1"))


@query("""
SELECT p_partkey, p_size, CASE WHEN p_size % 10 = 0 THEN NULL ELSE row_number() OVER (PARTITION BY p_size % 10 = 0 ORDER BY p_retailprice, p_partkey) END::INT AS price_rank,
 CASE WHEN p_size % 10 = 0 THEN 'identity' ELSE 'mutation' END AS kind FROM part""")
def priority_rank(spark: SparkSession, sf: str) -> DataFrame:
    p = t(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    own = p.where("p_size % 10 = 0").select("p_partkey", "p_size", F.lit("identity").alias("kind"))
    rest = rel.ranked(p.where("p_size % 10 <> 0"), F.col("p_retailprice").asc(), "p_partkey", "price_rank").select("p_partkey", "p_size", "price_rank", F.lit("mutation").alias("kind"))
    return rest.unionByName(own, allowMissingColumns=True)


# --- groups, joins, unions -------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, round(avg(l_quantity) OVER (PARTITION BY l_suppkey), 6) AS mean_quantity FROM lineitem")
def position_mean_joinback(spark: SparkSession, sf: str) -> DataFrame:
    li = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    m = li.groupBy("l_suppkey").agg(F.avg("l_quantity").alias("m"))
    return li.join(m, "l_suppkey", "left").select("l_orderkey", "l_linenumber", F.round("m", 6).alias("mean_quantity"))


@query("SELECT l_suppkey, l_returnflag, round(avg(l_discount), 6) AS mean_discount, round(stddev_samp(l_discount), 6) AS std_discount, max(l_tax) AS max_tax, min(l_tax) AS min_tax FROM lineitem GROUP BY ALL")
def mean_std_by_key(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.round(F.avg("l_discount"), 6).alias("mean_discount"), F.round(F.stddev_samp("l_discount"), 6).alias("std_discount"), F.max("l_tax").alias("max_tax"), F.min("l_tax").alias("min_tax"))


@query("""
SELECT l_orderkey, l_linenumber, p_brand AS brand, s_name AS supplier, n_name AS nation, r_name AS region FROM lineitem
LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN nation ON n_nationkey = s_nationkey LEFT JOIN region ON r_regionkey = n_regionkey""")
def annotation_chain(spark: SparkSession, sf: str) -> DataFrame:
    li = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"))
    sides = [
        (t(spark, sf, "part").select(F.col("p_partkey").alias("part"), F.col("p_brand").alias("brand")), ["part"]),
        (t(spark, sf, "supplier").select(F.col("s_suppkey").alias("supp"), F.col("s_name").alias("supplier"), F.col("s_nationkey").alias("nk")), ["supp"]),
        (t(spark, sf, "nation").select(F.col("n_nationkey").alias("nk"), F.col("n_name").alias("nation"), F.col("n_regionkey").alias("rk")), ["nk"]),
        (t(spark, sf, "region").select(F.col("r_regionkey").alias("rk"), F.col("r_name").alias("region")), ["rk"]),
    ]
    return rel.annotated(li, sides).drop("part", "supp", "nk", "rk")


@query("""
SELECT c_custkey AS key, 'customer' AS source FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)
UNION ALL SELECT DISTINCT o_custkey, 'orders' FROM orders""")
def polyprotein_antijoin_union(spark: SparkSession, sf: str) -> DataFrame:
    base = t(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.lit("customer").alias("source"))
    other = t(spark, sf, "orders").select(F.col("o_custkey").alias("key")).distinct().withColumn("source", F.lit("orders"))
    return rel.overriding(base, other, "key")


_PAIRS = """SELECT cn.n_name AS a, sn.n_name AS b, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
 JOIN supplier ON s_suppkey = l_suppkey JOIN nation cn ON cn.n_nationkey = c_nationkey JOIN nation sn ON sn.n_nationkey = s_nationkey GROUP BY ALL"""


@query(f"WITH p AS ({_PAIRS}), u AS (SELECT a, b, n FROM p UNION ALL SELECT b, a, n FROM p) SELECT a, b, sum(n)::BIGINT AS n FROM u GROUP BY a, b")
def symmetric_pairs(spark: SparkSession, sf: str) -> DataFrame:
    n = t(spark, sf, "nation").select("n_nationkey", "n_name")
    c = t(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey")).join(n, "n_nationkey").select("o_custkey", F.col("n_name").alias("a"))
    s = t(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("n_nationkey")).join(n, "n_nationkey").select("l_suppkey", F.col("n_name").alias("b"))
    o = t(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey").join(c, "o_custkey").select("l_orderkey", "a")
    pairs = t(spark, sf, "lineitem").select("l_orderkey", "l_suppkey").join(o, "l_orderkey").join(s, "l_suppkey").groupBy("a", "b").agg(F.count("*").alias("n"))
    return rel.both_ways(pairs, "a", "b").groupBy("a", "b").agg(F.sum("n").alias("n"))


@query("SELECT DISTINCT least(c_nationkey, s_nationkey) AS lo, greatest(c_nationkey, s_nationkey) AS hi FROM customer JOIN supplier ON c_custkey = s_suppkey")
def unordered_pairs(spark: SparkSession, sf: str) -> DataFrame:
    c = t(spark, sf, "customer").select(F.col("c_custkey").alias("k"), "c_nationkey")
    s = t(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), "s_nationkey")
    return c.join(s, "k").select(F.least("c_nationkey", "s_nationkey").alias("lo"), F.greatest("c_nationkey", "s_nationkey").alias("hi")).distinct()


@query("""
WITH f AS (SELECT c_custkey, coalesce(nullif(c_acctbal, 0), avg(nullif(c_acctbal, 0)) OVER ()) AS v FROM customer),
z AS (SELECT c_custkey, v, (v - avg(v) OVER ()) / stddev_samp(v) OVER () AS z FROM f)
SELECT c_custkey, round(v, 4) AS filled, round(z, 6) AS z, round(-ln(1 + exp(-z)) - ln(1 + exp(-z / 2)), 6) AS composite FROM z""")
def impute_zscore_logistic(spark: SparkSession, sf: str) -> DataFrame:
    c = t(spark, sf, "customer").select("c_custkey", F.nullif("c_acctbal", F.lit(0.0)).alias("b"))
    f = rel.with_scalars(c, m=F.avg("b")).select("c_custkey", F.coalesce("b", "m").alias("v"))
    z = rel.with_scalars(f, m=F.avg("v"), s=F.stddev_samp("v")).withColumn("z", rel.zscore("v", "m", "s"))
    return z.select("c_custkey", F.round("v", 4).alias("filled"), F.round("z", 6).alias("z"), F.round(rel.log_sigmoid(F.col("z"), 1) + rel.log_sigmoid(F.col("z"), 2), 6).alias("composite"))


@query("""
SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY ALL""")
def onehot_group_sum(spark: SparkSession, sf: str) -> DataFrame:
    o = t(spark, sf, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().fillna(0)
    return o.withColumnsRenamed({"F": "f", "O": "o", "P": "p"})


@query("SELECT l_orderkey, l_linenumber, unnest(['quantity', 'discount', 'tax']) AS metric, unnest([l_quantity, l_discount, l_tax]) AS value FROM lineitem")
def unpivot_metrics(spark: SparkSession, sf: str) -> DataFrame:
    li = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))
    return rel.unpivoted(li, ["l_orderkey", "l_linenumber"], ["quantity", "discount", "tax"], "metric", "value")


@query("SELECT l_returnflag, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY ALL")
def normalised_counts(spark: SparkSession, sf: str) -> DataFrame:
    g = t(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.countDistinct("l_suppkey").alias("suppliers"))
    return rel.with_scalars(g, a=F.sum("n")).withColumn("share", F.round(F.col("n") / F.col("a"), 9)).drop("a")


@query("SELECT l_orderkey, l_linenumber, least(l_discount, l_tax) AS lo, greatest(l_discount, l_tax) AS hi, greatest(abs(l_discount), abs(l_tax)) AS top, CASE WHEN l_tax > l_discount THEN 'tax' ELSE 'discount' END AS largest, CASE WHEN l_quantity < 10 OR l_quantity > 40 THEN l_quantity END AS outside FROM lineitem")
def rowwise_extremes(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.least("l_discount", "l_tax").alias("lo"), F.greatest("l_discount", "l_tax").alias("hi"), F.greatest(F.abs("l_discount"), F.abs("l_tax")).alias("top"), F.when(F.col("l_tax") > F.col("l_discount"), "tax").otherwise("discount").alias("largest"), seq.outside("l_quantity", 10, 40).alias("outside"))


@query("SELECT event_type, dense_rank() OVER (ORDER BY event_type)::INT AS code, CASE event_type WHEN 'click' THEN 'c' WHEN 'view' THEN 'v' ELSE event_type END AS recoded, count(*) AS n FROM events GROUP BY event_type")
def category_codes(spark: SparkSession, sf: str) -> DataFrame:
    g = t(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    short = F.create_map(F.lit("click"), F.lit("c"), F.lit("view"), F.lit("v"))
    return g.select("event_type", F.dense_rank().over(Window.orderBy("event_type")).alias("code"), F.coalesce(short[F.col("event_type")], "event_type").alias("recoded"), "n")  # a row for each category


# --- slices, shares, windows in time ---------------------------------------------------------------------------


@query("""
WITH s AS (SELECT p_partkey, p_retailprice, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS r, count(*) OVER () AS n FROM part WHERE p_retailprice IS NOT NULL),
b AS (SELECT p_partkey, CASE WHEN r <= floor(n * 0.1) THEN 'top' WHEN r <= floor(n * 0.25) THEN 'middle' ELSE 'rest' END AS bucket FROM s)
SELECT bucket, count(DISTINCT p_partkey) AS parts, count(l_partkey) AS hits FROM b LEFT JOIN lineitem ON l_partkey = p_partkey AND l_returnflag = 'R' GROUP BY bucket""")
def bucket_counts(spark: SparkSession, sf: str) -> DataFrame:
    p = t(spark, sf, "part").select("p_partkey", "p_retailprice")
    r = rel.with_scalars(rel.ranked(p.where("p_retailprice IS NOT NULL"), F.col("p_retailprice").desc(), "p_partkey", "r"), n=F.count("*"))
    b = r.select("p_partkey", F.expr("CASE WHEN r <= floor(n * 0.1) THEN 'top' WHEN r <= floor(n * 0.25) THEN 'middle' ELSE 'rest' END").alias("bucket"))
    hits = t(spark, sf, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("h"))
    return b.join(hits, "p_partkey", "left").groupBy("bucket").agg(F.count("*").alias("parts"), F.coalesce(F.sum("h"), F.lit(0)).alias("hits"))


@query("""
WITH d AS (SELECT user_id, ts::DATE AS day, count(*) AS n FROM events GROUP BY ALL), c AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY day) AS total FROM d)
SELECT user_id, min(day) AS first_seen FROM c WHERE total > 20 GROUP BY user_id""")
def monthly_first_seen(spark: SparkSession, sf: str) -> DataFrame:
    d = t(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return rel.first_seen(d, "user_id", "day", "n", 20)


@query("""
WITH f AS (SELECT user_id, min(ts::DATE) AS day FROM events GROUP BY user_id), d AS (SELECT DISTINCT ts::DATE AS day FROM events)
SELECT d.day, round(count(*) FILTER (f.day <= d.day) / count(*), 6) AS share FROM d, f GROUP BY d.day""")
def share_by_date(spark: SparkSession, sf: str) -> DataFrame:
    e = t(spark, sf, "events").select("user_id", F.to_date("ts").alias("day"))
    new = e.groupBy("user_id").agg(F.min("day").alias("day")).groupBy("day").agg(F.count("*").alias("n"))
    days = e.select("day").distinct().join(new, "day", "left")  # a row for each day
    total = F.sum("n").over(Window.orderBy("day"))
    return days.select("day", F.round(total / F.sum("n").over(Window.partitionBy()), 6).alias("share"))


@query("""
WITH e AS (SELECT ts::DATE AS day, value FROM events)
SELECT day, round(avg(value) OVER (ORDER BY day RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND CURRENT ROW), 6) AS trailing_mean FROM e QUALIFY row_number() OVER (PARTITION BY day) = 1""")
def trailing_window_mean(spark: SparkSession, sf: str) -> DataFrame:
    e = t(spark, sf, "events").select(F.to_date("ts").alias("day"), "value")
    return rel.trailing_mean(e, "day", "value", 7).select("day", F.round("trailing_mean", 6).alias("trailing_mean"))


@query("""
WITH e AS (SELECT event_id, ts::DATE AS day, value FROM events), w AS (SELECT event_id, value - avg(value) OVER (ORDER BY day RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND CURRENT ROW) AS d FROM e)
SELECT event_id, round(d, 4) AS deviation FROM w""")
def trailing_deviation(spark: SparkSession, sf: str) -> DataFrame:
    e = t(spark, sf, "events").select("event_id", F.to_date("ts").alias("day"), "value")
    return e.join(rel.trailing_mean(e, "day", "value", 7), "day").select("event_id", F.round(F.col("value") - F.col("trailing_mean"), 4).alias("deviation"))


# --- shifts between backbones ----------------------------------------------------------------------------------

_CELLS = "SELECT o_orderpriority AS mutation, n_name AS backbone, avg(o_totalprice) AS v FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL"
_SHIFT = f"WITH c AS ({_CELLS}), s AS (SELECT c.mutation, c.backbone, log10(c.v / r.v) AS shift FROM c JOIN c r ON r.mutation = c.mutation AND r.backbone = 'NATION_0' WHERE c.backbone <> 'NATION_0')"


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    n = t(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("backbone"))
    c = t(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey").join(n, "c_nationkey")
    return t(spark, sf, "orders").select("o_custkey", F.col("o_orderpriority").alias("mutation"), "o_totalprice").join(c, "o_custkey").groupBy("mutation", "backbone").agg(F.avg("o_totalprice").alias("v"))


def _shifts(spark: SparkSession, sf: str) -> DataFrame:
    logs = _cells(spark, sf).withColumn("v", F.log10("v"))
    return rel.epistatic_shift(logs, "mutation", "backbone", "v", _reference(spark, sf))


def _reference(spark: SparkSession, sf: str) -> str:
    return t(spark, sf, "nation").where("n_nationkey = 0").first()["n_name"]


_SHIFT = _SHIFT.replace("'NATION_0'", "(SELECT n_name FROM nation WHERE n_nationkey = 0)")


@query(_SHIFT + " SELECT mutation, round(max(shift), 6) AS max_shift, round(min(shift), 6) AS min_shift, round(max(abs(shift)), 6) AS max_abs_shift FROM s GROUP BY mutation")
def pivot_shift(spark: SparkSession, sf: str) -> DataFrame:
    return _shifts(spark, sf).groupBy("mutation").agg(F.round(F.max("shift"), 6).alias("max_shift"), F.round(F.min("shift"), 6).alias("min_shift"), F.round(F.max(F.abs("shift")), 6).alias("max_abs_shift"))


@query(_SHIFT + " SELECT mutation, arg_max(backbone, abs(shift)) AS strongest_backbone, round(arg_max(shift, abs(shift)), 6) AS shift FROM s GROUP BY mutation")
def strongest_shift(spark: SparkSession, sf: str) -> DataFrame:
    return _shifts(spark, sf).groupBy("mutation").agg(F.max_by("backbone", F.abs("shift")).alias("strongest_backbone"), F.round(F.max_by("shift", F.abs("shift")), 6).alias("shift"))


@query(_SHIFT + " SELECT backbone, round(sum(shift), 6) AS epistatic_sum, count(*) AS sites FROM s GROUP BY backbone")
def epistatic_sum(spark: SparkSession, sf: str) -> DataFrame:
    return _shifts(spark, sf).groupBy("backbone").agg(F.round(F.sum("shift"), 6).alias("epistatic_sum"), F.count("*").alias("sites"))


# --- outliers, percentiles, top k ------------------------------------------------------------------------------

_OUT = "SELECT l_orderkey, l_linenumber, coalesce(abs(l_extendedprice - avg(l_extendedprice) OVER ({0})) > 2 * stddev_samp(l_extendedprice) OVER ({0}), false) AS outlier FROM lineitem"


def _outliers(spark: SparkSession, sf: str, by: list[str]) -> DataFrame:
    li = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    return rel.outliers(li, "l_extendedprice", by, "outlier").select("l_orderkey", "l_linenumber", "outlier")


@query(_OUT.format(""))
def outlier_global(spark: SparkSession, sf: str) -> DataFrame:
    return _outliers(spark, sf, [])


@query(_OUT.format("PARTITION BY l_suppkey"))
def outlier_by_column(spark: SparkSession, sf: str) -> DataFrame:
    return _outliers(spark, sf, ["l_suppkey"])


@query(_OUT.format("PARTITION BY l_orderkey"))
def outlier_by_row(spark: SparkSession, sf: str) -> DataFrame:
    return _outliers(spark, sf, ["l_orderkey"])


@query("WITH c AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey) SELECT l_partkey, n, n > avg(n) OVER () + 2 * stddev_samp(n) OVER () AS significant FROM c")
def count_significance(spark: SparkSession, sf: str) -> DataFrame:
    c = t(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    return rel.with_scalars(c, m=F.avg("n"), s=F.stddev_samp("n")).select("l_partkey", "n", (F.col("n") > F.col("m") + 2 * F.col("s")).alias("significant"))


@query("SELECT p_partkey, round(100.0 * (rank() OVER (ORDER BY p_retailprice) - 1) / count(*) OVER (), 6) AS percentile FROM part")
def percentile_strict_less(spark: SparkSession, sf: str) -> DataFrame:
    p = t(spark, sf, "part").select("p_partkey", "p_retailprice")
    return rel.percent_below(p, "p_retailprice", "percentile").select("p_partkey", F.round("percentile", 6).alias("percentile"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 10")
def topk_nlargest(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(10)


@query("SELECT avg(p_retailprice)::DECIMAL(18, 6)::DOUBLE AS mean, median(p_retailprice) AS median, min(p_retailprice) AS lo, max(p_retailprice) AS hi, round(stddev_pop(p_retailprice), 6) AS std FROM part")
def summary_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "part").agg(F.round(F.avg("p_retailprice"), 6).alias("mean"), F.median("p_retailprice").alias("median"), F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi"), F.round(F.stddev_pop("p_retailprice"), 6).alias("std"))


@query("SELECT user_id, arg_min(event_type, event_id) AS first_type, arg_min(value, event_id) AS first_value FROM events GROUP BY user_id")
def distinct_keep_first(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "events").groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("first_type"), F.min_by("value", "event_id").alias("first_value"))


# --- statistics ------------------------------------------------------------------------------------------------


@query("""
WITH r AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2 AS x,
 rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2 AS y FROM lineitem)
SELECT l_returnflag, round(corr(x, y), 6) AS rho, count(*) AS n FROM r GROUP BY l_returnflag""")
def spearman_by_flag(spark: SparkSession, sf: str) -> DataFrame:
    return st.spearman(t(spark, sf, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice"), "l_quantity", "l_extendedprice", ["l_returnflag"]).withColumn("rho", F.round("rho", 6))


@query("""
WITH p AS (SELECT l_suppkey AS feature, (count(*) % 100 + 1) / 1000.0::DOUBLE AS p FROM lineitem GROUP BY l_suppkey)
SELECT feature, round(p * (SELECT count(DISTINCT feature) FROM p), 9) AS corrected, CASE WHEN p * (SELECT count(DISTINCT feature) FROM p) < 0.05 THEN '*' ELSE '' END AS significant FROM p""")
def bonferroni_star(spark: SparkSession, sf: str) -> DataFrame:
    p = t(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("feature")).agg(((F.count("*") % 100 + 1) / 1000.0).alias("p"))
    return st.bonferroni(p, "p", "feature").select("feature", F.round("corrected", 9).alias("corrected"), "significant")


@query("""
WITH p AS (SELECT l_suppkey AS feature, (count(*) % 100 + 1) / 1000.0::DOUBLE AS p FROM lineitem GROUP BY l_suppkey),
q AS (SELECT *, row_number() OVER (ORDER BY p, feature) AS r, count(*) OVER () AS m FROM p)
SELECT feature, round(least(1, min(p * m / r) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 9) AS fdr FROM q""")
def bh_fdr(spark: SparkSession, sf: str) -> DataFrame:
    p = t(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("feature")).agg(((F.count("*") % 100 + 1) / 1000.0).alias("p"))
    return st.benjamini_hochberg(p, "p", "feature").select("feature", F.round("fdr", 9).alias("fdr"))


@query("""
WITH r AS (SELECT o_orderstatus, rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2 AS x FROM orders)
SELECT round(sum(x) FILTER (o_orderstatus = 'F') - count(*) FILTER (o_orderstatus = 'F') * (count(*) FILTER (o_orderstatus = 'F') + 1) / 2, 3) AS u, count(*) FILTER (o_orderstatus = 'F') AS n1, count(*) FILTER (o_orderstatus <> 'F') AS n2 FROM r""")
def mann_whitney_u(spark: SparkSession, sf: str) -> DataFrame:
    return st.mann_whitney_u(t(spark, sf, "orders").select("o_orderstatus", "o_totalprice"), "o_totalprice", "o_orderstatus", "F").select(F.round("u", 3).alias("u"), "n1", "n2")


@query("""
WITH c AS (SELECT toxic = 1 AS truth, n_chars > 2000 AS guess FROM documents JOIN labels USING (doc_id)), n AS (SELECT count(*) FILTER (truth AND guess) AS tp, count(*) FILTER (NOT truth AND guess) AS fp, count(*) FILTER (truth AND NOT guess) AS fn, count(*) FILTER (NOT truth AND NOT guess) AS tn FROM c)
SELECT *, round(tp / nullif(tp + fn, 0), 9) AS sensitivity, round(tn / nullif(tn + fp, 0), 9) AS specificity, round(2 * tp / nullif(2 * tp + fp + fn, 0), 9) AS f1 FROM n""")
def confusion_metrics(spark: SparkSession, sf: str) -> DataFrame:
    c = t(spark, sf, "documents").select("doc_id", "n_chars").join(t(spark, sf, "labels"), "doc_id")
    out = c.agg(*st.confusion(F.col("toxic") == 1, F.col("n_chars") > 2000))
    return out.withColumns({k: F.round(k, 9) for k in ("sensitivity", "specificity", "f1")})


@query("""
WITH c AS (SELECT lang, count(*) AS drawn, count(*) FILTER (quality = 1) AS hits FROM documents JOIN labels USING (doc_id) GROUP BY lang)
SELECT lang, hits, round(drawn * (sum(hits) OVER ()) / sum(drawn) OVER (), 6) AS expected, round(hits / (drawn * (sum(hits) OVER ()) / sum(drawn) OVER ()), 6) AS fold FROM c""")
def hypergeom_enrichment(spark: SparkSession, sf: str) -> DataFrame:
    c = t(spark, sf, "documents").select("doc_id", "lang").join(t(spark, sf, "labels"), "doc_id").groupBy("lang").agg(F.count("*").alias("drawn"), F.count_if(F.col("quality") == 1).alias("hits"))
    e = rel.with_scalars(c, h=F.sum("hits"), d=F.sum("drawn")).withColumn("e", F.col("drawn") * F.col("h") / F.col("d"))
    return e.select("lang", "hits", F.round("e", 6).alias("expected"), F.round(F.col("hits") / F.col("e"), 6).alias("fold"))


@query("SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY l_returnflag")
def ols_simple(spark: SparkSession, sf: str) -> DataFrame:
    y, x = "l_extendedprice", "l_quantity"
    return t(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.round(F.regr_slope(y, x), 4).alias("slope"), F.round(F.regr_intercept(y, x), 3).alias("intercept"), F.round(F.regr_r2(y, x), 6).alias("r2"))


@query()
def ols_multi(spark: SparkSession, sf: str) -> DataFrame:
    r = st.ols(t(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"])
    rows = [(k, v, se, tt, p) for (k, v), se, tt, p in zip(r["coef"].items(), r["se"], r["t"], r["p"], strict=True)]
    return spark.createDataFrame(rows, "term string, coef double, std_err double, t double, p double")


# --- model output ----------------------------------------------------------------------------------------------

_LP = """WITH x AS (SELECT user_id AS pos, event_type AS token, avg(value) / 50 AS logit FROM events GROUP BY ALL),
lp AS (SELECT pos, token, logit - max(logit) OVER w - ln(sum(exp(logit)) OVER w / exp(max(logit) OVER w)) AS logp FROM x WINDOW w AS (PARTITION BY pos))"""


def _logp(spark: SparkSession, sf: str) -> DataFrame:
    x = t(spark, sf, "events").groupBy(F.col("user_id").alias("pos"), F.col("event_type").alias("token")).agg((F.avg("value") / 50).alias("logit"))
    return mo.log_softmax(x.withColumn("seq_id", F.lit("s")))


@query(_LP + " SELECT pos, round(-sum(exp(logp) * ln(greatest(exp(logp), 1e-9))), 6) AS entropy, round(max(exp(logp)), 6) AS top_probability FROM lp GROUP BY pos")
def softmax_entropy(spark: SparkSession, sf: str) -> DataFrame:
    lp = _logp(spark, sf)
    top = lp.groupBy("pos").agg(F.round(F.max(F.exp("logp")), 6).alias("top_probability"))
    return mo.entropy(lp).select("pos", F.round("entropy", 6).alias("entropy")).join(top, "pos")


@query(_LP + " SELECT round(sum(logp), 4) AS sequence_grammaticality, round(sum(logp) FILTER (pos % 10 <> 0), 4) AS narrow_sequence_grammaticality FROM lp WHERE token = 'view'")
def sequence_grammaticality(spark: SparkSession, sf: str) -> DataFrame:
    lp = _logp(spark, sf)
    sites = lp.select("seq_id", "pos").distinct()
    own = mo.own(lp, sites.withColumn("token", F.lit("view")))
    whole, narrow = mo.sequence_grammaticality(own), mo.sequence_grammaticality(own, sites.where("pos % 10 = 0"))
    return whole.join(narrow.withColumnRenamed("sequence_grammaticality", "n"), "seq_id").select(F.round("sequence_grammaticality", 4).alias("sequence_grammaticality"), F.round("n", 4).alias("narrow_sequence_grammaticality"))


@query(_LP + """ SELECT (pos // 5)::VARCHAR AS mutant, round(sum(a.logp), 5) AS grammaticality, round(sum(a.logp - r.logp), 5) AS relative_grammaticality, round(exp(sum(a.logp)), 12) AS probability
FROM lp a JOIN lp r USING (pos) WHERE a.token = 'click' AND r.token = 'view' GROUP BY ALL""")
def grammaticality(spark: SparkSession, sf: str) -> DataFrame:
    """Every site is mutated, five neighbouring sites in one mutant, so that no probability underflows."""
    lp = _logp(spark, sf).withColumn("seq_id", F.expr("string(pos div 5)"))
    muts = lp.select("seq_id", "pos").distinct().withColumns({"ref": F.lit("view"), "alt": F.lit("click")})
    return mo.grammaticality(lp, muts).select(F.col("seq_id").alias("mutant"), F.round("grammaticality", 5).alias("grammaticality"), F.round("relative_grammaticality", 5).alias("relative_grammaticality"), F.round("probability", 12).alias("probability"))


@query(_LP + " SELECT pos, round(exp(max(logp) FILTER (token = 'view')), 6) AS reference_probability, round(exp(max(logp) FILTER (token <> 'view')), 6) AS max_other_probability FROM lp WHERE pos IN (SELECT pos FROM lp) GROUP BY pos")
def site_probabilities(spark: SparkSession, sf: str) -> DataFrame:
    lp = _logp(spark, sf)
    res = lp.select("seq_id", "pos").distinct().withColumn("token", F.lit("view"))
    return mo.site_ranks(lp, res).select("pos", F.round("reference_probability", 6).alias("reference_probability"), F.round("max_other_probability", 6).alias("max_other_probability"))


# --- sequence algebra ------------------------------------------------------------------------------------------

_PROT = "regexp_replace(upper(regexp_replace(translate(text, 'bjouxz', 'ACDEFG'), '[^A-Za-z]', '', 'g')), '[^ACDEFGHIKLMNPQRSTVWY]', '', 'g')"


def _proteins(spark: SparkSession, sf: str) -> DataFrame:
    clean = "regexp_replace(upper(regexp_replace(translate(text, 'bjouxz', 'ACDEFG'), '[^A-Za-z]', '')), '[^ACDEFGHIKLMNPQRSTVWY]', '')"
    return t(spark, sf, "benchmark").select("item_id", F.expr(clean).alias("s"))


@query(f"""
WITH p AS (SELECT item_id, {_PROT} AS s FROM benchmark), x AS (SELECT item_id, s, unnest(range(1, length(s) + 1)) AS pos FROM p)
SELECT item_id, substr(s, pos, 1) || pos || a AS label, md5(substr(s, 1, pos - 1) || a || substr(s, pos + 1)) AS variant_md5 FROM x, (SELECT unnest(string_split('{seq.AMINO_ACIDS}', '')) AS a)""")
def dms_expand(spark: SparkSession, sf: str) -> DataFrame:
    return seq.expanded(_proteins(spark, sf), "s").select("item_id", "label", F.md5(F.col("variant").cast("binary")).alias("variant_md5"))


@query(f"WITH p AS (SELECT item_id, {_PROT} AS s FROM benchmark) SELECT item_id, 'K' || substr(s, 2, 8) || 'W' || substr(s, 11) AS mutant, substr(s, 1, 1) || substr(s, 2, 8) || substr(s, 10, 1) || substr(s, 11) AS reverted FROM p")
def mutate_revert_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    p = _proteins(spark, sf).withColumn("m", F.expr("array(concat(substring(s, 1, 1), 1, 'K'), concat(substring(s, 10, 1), 10, 'W'), 'R2del', 'X3A')"))
    return p.withColumn("mutant", seq.mutate("s", "m")).select("item_id", "mutant", seq.revert("mutant", "m").alias("reverted"))


_DIFF = """WITH a AS (SELECT conv_id, turn, coalesce(text, '') AS x, lead(coalesce(text, '')) OVER (PARTITION BY conv_id ORDER BY turn) AS y FROM conversations),
p AS (SELECT conv_id, turn, rpad(translate(x, ' ', '-'), n, '-') AS x, rpad(translate(y, ' ', '-'), n, '-') AS y FROM (SELECT *, greatest(length(x), length(y))::INT AS n FROM a WHERE y IS NOT NULL)),
c AS (SELECT conv_id, turn, x, y, unnest(range(1, length(x) + 1)) AS i FROM p),
l AS (SELECT conv_id, turn, i, substr(x, i, 1) AS r, substr(y, i, 1) AS q FROM c),
d AS (SELECT *, i - count(*) FILTER (r = '-') OVER (PARTITION BY conv_id, turn ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS u FROM l)"""


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    """Each turn beside the next, spaces as gaps, the shorter one filled up with gaps."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    whole = F.coalesce("text", F.lit(""))
    c = t(spark, sf, "conversations").select("conv_id", "turn", whole.alias("x"), F.lead(whole).over(w).alias("y")).where("y IS NOT NULL")
    return c.select("conv_id", "turn", *[F.expr(f"rpad(translate({k}, ' ', '-'), greatest(length(x), length(y)), '-')").alias(k) for k in "xy"])


@query(_DIFF + """, g AS (SELECT conv_id, turn, string_agg(r || i || CASE WHEN q = '-' THEN 'del' ELSE q END, ', ' ORDER BY i) FILTER (r <> q) AS labels FROM d GROUP BY conv_id, turn)
SELECT conv_id, turn, coalesce(labels, '') AS labels FROM p LEFT JOIN g USING (conv_id, turn)""")
def diff_labels(spark: SparkSession, sf: str) -> DataFrame:
    return _turns(spark, sf).select("conv_id", "turn", F.array_join(seq.diff_labels("x", "y"), ", ").alias("labels"))


@query(_DIFF + """, g AS (SELECT conv_id, turn, count(*) FILTER (r <> q AND r <> '-' AND q <> '-') AS n, string_agg('ins' || u || q, ', ' ORDER BY i) FILTER (r = '-' AND q <> '-') AS ins,
 string_agg('del' || u, ', ' ORDER BY i) FILTER (q = '-' AND r <> '-') AS del FROM d GROUP BY conv_id, turn)
SELECT conv_id, turn, coalesce(n, 0) AS substitutions, coalesce(ins, '') AS insertions, coalesce(del, '') AS deletions FROM p LEFT JOIN g USING (conv_id, turn)""")
def indel_diff(spark: SparkSession, sf: str) -> DataFrame:
    x = _turns(spark, sf)
    return x.select("conv_id", "turn", F.size(seq.substitutions("x", "y")).cast("long").alias("substitutions"), F.array_join(seq.insertions("x", "y"), ", ").alias("insertions"), F.array_join(seq.deletions("x", "y"), ", ").alias("deletions"))


@query(_DIFF + """, g AS (SELECT conv_id, turn, string_agg(r || u || q, ', ' ORDER BY i) FILTER (r <> q AND r <> '-') AS labels FROM d GROUP BY conv_id, turn)
SELECT conv_id, turn, coalesce(labels, '') AS labels FROM p LEFT JOIN g USING (conv_id, turn)""")
def reference_diff(spark: SparkSession, sf: str) -> DataFrame:
    return _turns(spark, sf).select("conv_id", "turn", F.array_join(seq.reference_diff("x", "y"), ", ").alias("labels"))


_NT = "translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC')"


@query(f"""
WITH s AS (SELECT item_id, {_NT} AS s FROM benchmark), c AS (SELECT item_id, s, unnest(range(0, length(s) // 3)) AS i FROM s)
SELECT item_id, string_agg(substr('{seq.GENETIC_CODE}', ((instr('TCAG', substr(s, 3 * i + 1, 1)) - 1) * 16 + (instr('TCAG', substr(s, 3 * i + 2, 1)) - 1) * 4 + instr('TCAG', substr(s, 3 * i + 3, 1)))::INT, 1), '' ORDER BY i) AS protein FROM c GROUP BY item_id""")
def codon_translate(spark: SparkSession, sf: str) -> DataFrame:
    nt = "translate(regexp_replace(lower(text), '[^a-z]', ''), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC')"
    return t(spark, sf, "benchmark").select("item_id", F.expr(nt).alias("s")).select("item_id", seq.translate("s").alias("protein"))


@query("SELECT p_partkey, regexp_extract(p_brand, '[0-9]+', 0)::INT AS number, CASE WHEN p_brand LIKE 'HA2:%' THEN 10000 ELSE regexp_extract(p_brand, '[0-9]+', 0)::INT END AS place FROM part")
def canonical_label(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "part").select("p_partkey", F.regexp_extract("p_brand", "[0-9]+", 0).cast("int").alias("number"), seq.sort_position("p_brand").alias("place"))


@query("SELECT page_id, CASE WHEN url LIKE '%example.com%' THEN 'Com' WHEN url LIKE '%example.org%' THEN 'Org' ELSE 'Non-VOC' END AS voc FROM pages")
def voc_class(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "pages").select("page_id", F.when(F.col("url").contains("example.com"), "Com").when(F.col("url").contains("example.org"), "Org").otherwise("Non-VOC").alias("voc"))


@query("""
WITH x AS (SELECT c_custkey, (c_acctbal - min(c_acctbal) OVER ()) / coalesce(nullif(max(c_acctbal) OVER () - min(c_acctbal) OVER (), 0), 1) AS v FROM customer)
SELECT c_custkey, CASE WHEN v < 0.5 THEN floor(510 * v)::INT ELSE 255 END AS red, CASE WHEN v < 0.5 THEN 255 ELSE floor(510 * (1 - v))::INT END AS blue FROM x""")
def structure_color(spark: SparkSession, sf: str) -> DataFrame:
    c = rel.with_scalars(t(spark, sf, "customer").select("c_custkey", "c_acctbal"), lo=F.min("c_acctbal"), hi=F.max("c_acctbal"))
    x = c.select("c_custkey", F.expr("(c_acctbal - lo) / coalesce(nullif(hi - lo, 0), 1)").alias("v"))
    return x.select("c_custkey", F.expr("CASE WHEN v < 0.5 THEN int(floor(510 * v)) ELSE 255 END").alias("red"), F.expr("CASE WHEN v < 0.5 THEN 255 ELSE int(floor(510 * (1 - v))) END").alias("blue"))


@query("SELECT floor(l_quantity / 5)::BIGINT AS bx, floor(l_extendedprice / 10000)::BIGINT AS by, count(*) AS n FROM lineitem GROUP BY ALL")
def density_bins(spark: SparkSession, sf: str) -> DataFrame:
    from ..sources.text_formats import bins

    return bins(t(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", 5, 10000)


@query()
def align_map(spark: SparkSession, sf: str) -> DataFrame:
    """Canonical numbering of whole sequences against one reference, the first that has letters; a null or empty sequence
    has no positions."""
    from ..functions.alignment import numbered

    p = _proteins(spark, sf)
    ref = p.where("length(s) > 0").orderBy("item_id").limit(1).select(F.col("s").alias("r"))
    out = p.join(F.broadcast(ref)).select("item_id", "s", "r").withColumn("map", numbered("s", "r", signal=5, ha2_start=40))
    return out.select("item_id", F.inline("map"))


# --- composites ------------------------------------------------------------------------------------------------

_SCORES = "SELECT p_partkey::VARCHAR AS label, p_partkey * 37 % 1273 AS pos, p_retailprice::DOUBLE AS price, p_size::DOUBLE AS size FROM part"
_PLACED = f"""s AS ({_SCORES}), l AS (SELECT label, pos, 'price' AS feature, price AS value FROM s UNION ALL SELECT label, pos, 'size', size FROM s),
    r AS (SELECT *, 'spike' AS region FROM l UNION ALL SELECT *, 'rbd' FROM l WHERE pos BETWEEN 319 AND 541),
    k AS (SELECT *, row_number() OVER (PARTITION BY feature, region ORDER BY value DESC, label) AS place, count(*) OVER (PARTITION BY feature, region) AS n FROM r)"""


def _part_scores(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "part").selectExpr("string(p_partkey) AS label", "p_partkey * 37 % 1273 AS pos", "double(p_retailprice) AS price", "double(p_size) AS size")


@query(f"""
    WITH {_PLACED}, b AS (SELECT * FROM (VALUES (0::DOUBLE, 0.1::DOUBLE), (0.1, 0.25), (0.25, 1)) AS x(lo, hi)),
    v AS (SELECT l_partkey::VARCHAR AS label, l_returnflag AS voc, count(*) AS c FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY ALL),
    f AS (SELECT * FROM (VALUES ('A'), ('R')) AS y(voc))
    SELECT k.feature, k.region, b.hi AS proportion, f.voc, coalesce(sum(v.c), 0)::DOUBLE AS "count"
    FROM k JOIN b ON k.place > floor(k.n * b.lo) AND k.place <= floor(k.n * b.hi) CROSS JOIN f LEFT JOIN v ON v.label = k.label AND v.voc = f.voc GROUP BY ALL""")
def variant_counts(spark: SparkSession, sf: str) -> DataFrame:
    lines = t(spark, sf, "lineitem").groupBy(F.col("l_partkey").cast("string").alias("mutation"))
    variants = lines.agg(F.count_if(F.col("l_returnflag") == "A").alias("A"), F.count_if(F.col("l_returnflag") == "R").alias("R"))
    return sv.variant_counts(_part_scores(spark, sf), variants, ["price", "size"], ["A", "R"])


@query(f"""
    WITH {_PLACED}, q AS (SELECT * FROM (VALUES (0.1::DOUBLE), (0.5)) AS x(proportion)),
    m AS (SELECT DISTINCT l_partkey::VARCHAR AS label, date_trunc('month', l_shipdate)::DATE AS date FROM lineitem), d AS (SELECT DISTINCT date FROM m),
    top AS (SELECT feature, region, label, n, proportion FROM k JOIN q ON place <= floor(n * proportion)),
    c AS (SELECT feature, region, proportion, date, count(*) AS c FROM top JOIN m USING (label) GROUP BY ALL),
    g AS (SELECT DISTINCT feature, region, proportion, n, date FROM top CROSS JOIN d)
    SELECT date, (sum(coalesce(c, 0)) OVER w)::BIGINT AS "count", round((sum(coalesce(c, 0)) OVER w)::DOUBLE / floor(n * proportion), 9) AS percentage, proportion, feature, CASE feature WHEN 'price' THEN 'p' ELSE 's' END AS method, region
    FROM g LEFT JOIN c USING (feature, region, proportion, date) WINDOW w AS (PARTITION BY feature, region, proportion ORDER BY date)""")
def share_seen_by_date(spark: SparkSession, sf: str) -> DataFrame:
    parts = _part_scores(spark, sf)
    months = t(spark, sf, "lineitem").selectExpr("string(l_partkey) AS mutation", "date(date_trunc('month', l_shipdate)) AS sample_date").distinct()
    monthly = months.join(parts.selectExpr("label AS mutation", f"{sv.DOMAIN} AS rbd"), "mutation")
    return sv.share_seen_by_date(parts, monthly, {"price": "p", "size": "s"}, [0.1, 0.5], regions=sv.BY_DATE_ALL).withColumn("percentage", F.round("percentage", 9))
