"""Registered queries over shapes of result tables, labels and lineages, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequence as seq
from ..operators import lineages, regions, scoring, statistics, tables
from ..operators import model_output as mo
from ..operators import relational as rel
from .catalog import _PROT, QUERIES, SQL, _proteins, query, t

AA = seq.AMINO_ACIDS

# --- groups and pivots -----------------------------------------------------------------------------------------


@query("""SELECT user_id, round(avg(value), 6) AS value, arg_min(event_type, event_id) FILTER (event_type <> 'view') AS event_type
FROM events GROUP BY user_id""")
def mean_or_first(spark: SparkSession, sf: str) -> DataFrame:
    e = t(spark, sf, "events").withColumn("event_type", F.nullif("event_type", F.lit("view")))
    out = tables.mean_or_first(e, ["user_id"], ["value"], ["event_type"], "event_id")
    return out.withColumn("value", F.round("value", 6))


@query("""SELECT o_orderpriority, arg_min(o_totalprice, o_orderkey) FILTER (o_orderstatus = 'F') AS "F",
arg_min(o_totalprice, o_orderkey) FILTER (o_orderstatus = 'O') AS "O" FROM orders GROUP BY o_orderpriority""")
def pivot_first(spark: SparkSession, sf: str) -> DataFrame:
    return tables.pivoted(t(spark, sf, "orders"), ["o_orderpriority"], "o_orderstatus", ["F", "O"], "o_totalprice", "o_orderkey")


@query("""SELECT l_suppkey, round(avg(l_quantity) FILTER (l_returnflag = 'A'), 6) AS a, round(avg(l_quantity) FILTER (l_returnflag = 'R'), 6) AS r
FROM lineitem GROUP BY l_suppkey""")
def pivot_mean(spark: SparkSession, sf: str) -> DataFrame:
    out = tables.pivoted(t(spark, sf, "lineitem"), ["l_suppkey"], "l_returnflag", ["A", "R"], "l_quantity")
    return out.select("l_suppkey", F.round("A", 6).alias("a"), F.round("R", 6).alias("r"))


_LETTERED = f"SELECT l_partkey AS pos, substr('{AA}', (l_suppkey % 20 + 1)::INT, 1) AS letter, avg(l_discount) AS v FROM lineitem GROUP BY ALL"


def _lettered(spark: SparkSession, sf: str) -> DataFrame:
    letter = F.expr(f"substring('{AA}', int(l_suppkey % 20 + 1), 1)")
    return t(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("pos"), letter.alias("letter")).agg(F.avg("l_discount").alias("v"))


@query(f"""WITH x AS ({_LETTERED}), a AS (SELECT unnest(range(1, 21)) AS place)
SELECT p.pos, place, round(coalesce(v, 0), 6) AS value FROM (SELECT DISTINCT pos FROM x) p CROSS JOIN a
LEFT JOIN x ON x.pos = p.pos AND x.letter = substr('{AA}', place::INT, 1)""")
def amino_vectors(spark: SparkSession, sf: str) -> DataFrame:
    v = tables.ordered_vectors(_lettered(spark, sf), "pos", "letter", "v")
    return v.select("pos", F.posexplode("vector").alias("place", "value")).select("pos", (F.col("place") + 1).cast("long").alias("place"), F.round("value", 6).alias("value"))


# --- model output ----------------------------------------------------------------------------------------------

_TOKENS = f"""SELECT user_id AS pos, substr('{AA}X', (event_id % 21 + 1)::INT, 1) AS token, CASE WHEN user_id = 0 THEN '<cls>' ELSE 'A' END AS own,
avg(value) / 50 AS logit FROM events GROUP BY ALL"""


def _tokens(spark: SparkSession, sf: str) -> DataFrame:
    e = t(spark, sf, "events").selectExpr("user_id AS pos", f"substring('{AA}X', int(event_id % 21 + 1), 1) AS token", "CASE WHEN user_id = 0 THEN '<cls>' ELSE 'A' END AS own", "value")
    return e.groupBy("pos", "token", "own").agg((F.avg("value") / 50).alias("logit")).withColumn("seq_id", F.lit("s"))


_CELLS = ", ".join(f"round(max(logit) FILTER (token = '{a}'), 6) AS {a}" for a in AA)


@query(f"WITH x AS ({_TOKENS}) SELECT pos - (SELECT min(pos) FROM x WHERE own <> '<cls>') AS pos, {_CELLS} FROM x WHERE own <> '<cls>' GROUP BY ALL")
def tidy_logits(spark: SparkSession, sf: str) -> DataFrame:
    return tables.tidy_logits(_tokens(spark, sf)).select("pos", *[F.round(a, 6).alias(a) for a in AA])


@query(f"""WITH x AS ({_TOKENS}), p AS (SELECT pos, token, exp(logit) / sum(exp(logit)) OVER (PARTITION BY pos) AS p FROM x)
SELECT pos, token, round(p, 9) AS p FROM p WHERE token <> 'X'""")
def probability_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return tables.probability_matrix(mo.log_softmax(_tokens(spark, sf).drop("own"))).select("pos", "token", F.round("p", 9).alias("p"))


@query("""WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings)
SELECT x.vec_id, x.pos, CASE WHEN x.pos <> x.vec_id % 64 + 1 THEN round(x.v - r.v, 6) + 0.0 END AS change FROM x JOIN x r ON r.pos = x.pos AND r.vec_id = 0 WHERE x.vec_id <> 0""")
def site_changes(spark: SparkSession, sf: str) -> DataFrame:
    e = t(spark, sf, "embeddings")
    mutants = e.where("vec_id <> 0").selectExpr("vec_id AS label", "vec_id % 64 + 1 AS site", "embedding AS own")
    out = tables.site_changes(mutants, e.where("vec_id = 0").select(F.col("embedding").alias("own")))
    return out.select(F.col("label").alias("vec_id"), F.col("pos").cast("long").alias("pos"), (F.round("change", 6) + 0.0).alias("change"))


# --- labels, lists and lineages --------------------------------------------------------------------------------

_LIST = "concat('A', p_size, 'T, H', p_partkey % 50, 'del,K', p_size + 1, 'N')"


@query(f"""WITH x AS (SELECT p_partkey, trim(unnest(string_split({_LIST}, ','))) AS mutation FROM part)
SELECT * FROM x WHERE mutation NOT LIKE '%del%'""")
def exploded_mutations(spark: SparkSession, sf: str) -> DataFrame:
    return tables.exploded_mutations(t(spark, sf, "part").select("p_partkey", F.expr(_LIST).alias("mutations")), "mutations")


_MAP = "CASE WHEN n % 9 = 0 THEN NULL WHEN n <= 16 THEN concat('SP', n - 16) WHEN n <= 345 THEN concat('', n - 16) ELSE concat('HA2:', n - 345) END"


@query(f"""WITH p AS (SELECT p_partkey, p_partkey % 566 + 1 AS n FROM part),
l AS (SELECT p_partkey, n, CASE WHEN n % 11 = 0 THEN concat('ins', n) ELSE concat('K', n, 'N') END AS label, {_MAP} AS mapped FROM p)
SELECT p_partkey, CASE WHEN mapped IS NULL OR n % 11 = 0 THEN label WHEN mapped LIKE 'HA2:%' THEN concat('HA2:K', substr(mapped, 5), 'N') ELSE concat('K', mapped, 'N') END AS canonical
FROM l""")
def canonical_mutations(spark: SparkSession, sf: str) -> DataFrame:
    p = t(spark, sf, "part").selectExpr("p_partkey", "p_partkey % 566 + 1 AS n")
    numbering = p.select("n").distinct().withColumn("mapped", F.expr(_MAP))
    rows = p.withColumn("label", F.expr("CASE WHEN n % 11 = 0 THEN concat('ins', n) ELSE concat('K', n, 'N') END")).join(numbering, "n", "left")
    return rows.select("p_partkey", seq.canonical_label("label", "mapped").alias("canonical"))


_LINEAGE = """CASE p_partkey % 9 WHEN 0 THEN 'B.1.1.7.1' WHEN 1 THEN concat('Q.', p_size) WHEN 2 THEN concat('AY.', p_size) WHEN 3 THEN 'P.1' WHEN 4 THEN 'BQ.1.1'
WHEN 5 THEN concat('B.1.', p_size) WHEN 6 THEN 'B.1.1.529.1' WHEN 7 THEN 'B.1.351' ELSE 'XBB.1.5' END"""


@query(f"""WITH l AS (SELECT p_partkey, {_LINEAGE} AS lineage FROM part), h AS (SELECT *, string_split(lineage, '.')[1] AS head FROM l)
SELECT p_partkey, CASE WHEN lineage = 'B.1.1.7' OR head = 'Q' OR lineage LIKE '%B.1.1.7.%' THEN 'Alpha' WHEN lineage = 'B.1.351' OR lineage LIKE '%B.1.351.%' THEN 'Beta'
 WHEN lineage = 'P.1' OR lineage LIKE '%P.1.%' THEN 'Gamma' WHEN lineage = 'B.1.617.2' OR head = 'AY' OR lineage LIKE '%B.1.617.2.%' THEN 'Delta'
 WHEN lineage = 'B.1.1.529' OR head IN ('BA', 'BQ') OR lineage LIKE '%B.1.1.529.%' THEN 'Omicron' ELSE 'Non-VOC' END AS voc FROM h""")
def lineage_class(spark: SparkSession, sf: str) -> DataFrame:
    vocs = lineages.voc_table(spark, {"Q": "B.1.1.7", "AY": "B.1.617.2", "BA": "B.1.1.529", "BQ": "BA.5.3.1"})
    rows = t(spark, sf, "part").select("p_partkey", F.expr(_LINEAGE).alias("lineage"))
    return lineages.classified(rows, "lineage", vocs).select("p_partkey", "voc")


@query("""SELECT p_partkey, p_brand AS second, p_partkey::VARCHAR AS last, replace(regexp_replace(concat('A-', p_brand, '*-C**'), '[*]+$', ''), '-', '') AS ungapped FROM part""")
def header_fields(spark: SparkSession, sf: str) -> DataFrame:
    p = t(spark, sf, "part").withColumns({"header": F.expr("concat('id|', p_brand, '|', p_partkey)"), "s": F.expr("concat('A-', p_brand, '*-C**')")})
    return p.select("p_partkey", seq.header_field("header", 1).alias("second"), seq.header_field("header", -1).alias("last"), seq.ungapped("s").alias("ungapped"))


@query(f"""WITH p AS (SELECT item_id, {_PROT} AS s FROM benchmark), x AS (SELECT item_id, s, unnest(range(1, length(s) + 1)) AS pos FROM p)
SELECT item_id, pos::INT AS pos, 20 AS variants, md5(list_aggr(list_sort([substr(s, pos, 1) || pos || a FOR a IN string_split('{AA}', '')]), 'string_agg', ',')) AS labels_md5 FROM x""")
def site_batches(spark: SparkSession, sf: str) -> DataFrame:
    rows = seq.expanded(_proteins(spark, sf), "s")
    batches = regions.site_batches(rows.withColumn("pos", F.struct("item_id", "pos"))).select("pos.*", "variants")
    labels = F.array_join(F.array_sort(F.col("variants.label")), ",")
    return batches.select("item_id", "pos", F.size("variants").alias("variants"), F.md5(labels.cast("binary")).alias("labels_md5"))


# --- joins -----------------------------------------------------------------------------------------------------


@query("""SELECT s_suppkey, c_custkey, nation, s.name AS name_x, c.name AS name_y, s.acctbal AS acctbal_x, c.acctbal AS acctbal_y
FROM (SELECT s_suppkey, s_nationkey AS nation, s_name AS name, s_acctbal AS acctbal FROM supplier) s
JOIN (SELECT c_custkey, c_nationkey AS nation, c_name AS name, c_acctbal AS acctbal FROM customer) c USING (nation)""")
def suffix_join(spark: SparkSession, sf: str) -> DataFrame:
    s = t(spark, sf, "supplier").selectExpr("s_suppkey", "s_nationkey AS nation", "s_name AS name", "s_acctbal AS acctbal")
    c = t(spark, sf, "customer").selectExpr("c_custkey", "c_nationkey AS nation", "c_name AS name", "c_acctbal AS acctbal")
    return tables.suffix_join(s, c, ["nation"])


@query("""SELECT o_orderkey, s_suppkey FROM orders JOIN (SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal, s_suppkey) - 1 AS i FROM supplier) ON i = o_custkey % 37""")
def index_join(spark: SparkSession, sf: str) -> DataFrame:
    o = t(spark, sf, "orders").selectExpr("o_orderkey", "o_custkey % 37 AS at")
    return tables.index_join(o, "at", t(spark, sf, "supplier").select("s_suppkey", "s_acctbal"), "s_acctbal", "s_suppkey").select("o_orderkey", "s_suppkey")


_SIDE2 = "SELECT l_partkey AS k1, l_suppkey AS k2, round(max(l_tax), 6) AS top_tax FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL"
_SIDE3 = "SELECT l_partkey AS k1, l_suppkey AS k2, l_linestatus AS k3, count(*) AS n FROM lineitem WHERE l_quantity > 25 GROUP BY ALL"


@query(f"""WITH a AS ({_SIDE2}), b AS ({_SIDE3}) SELECT l_orderkey, l_linenumber, a.top_tax, b.n FROM lineitem
LEFT JOIN a ON a.k1 = l_partkey AND a.k2 = l_suppkey LEFT JOIN b ON b.k1 = l_partkey AND b.k2 = l_suppkey AND b.k3 = l_linestatus""")
def annotated_by_several_keys(spark: SparkSession, sf: str) -> DataFrame:
    li = t(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey AS k1", "l_suppkey AS k2", "l_linestatus AS k3", "l_tax", "l_quantity", "l_returnflag")
    two = li.where("l_returnflag = 'R'").groupBy("k1", "k2").agg(F.round(F.max("l_tax"), 6).alias("top_tax"))
    three = li.where("l_quantity > 25").groupBy("k1", "k2", "k3").agg(F.count("*").alias("n"))
    base = li.select("l_orderkey", "l_linenumber", "k1", "k2", "k3")
    return rel.annotated(base, [(two, ["k1", "k2"]), (three, ["k1", "k2", "k3"])]).select("l_orderkey", "l_linenumber", "top_tax", "n")


@query("""SELECT l_orderkey, l_linenumber, abs(l_partkey % 1273 - l_suppkey) AS distance_1d, count(*) OVER (PARTITION BY l_returnflag, l_linestatus) AS sites_affected FROM lineitem""")
def pair_distances(spark: SparkSession, sf: str) -> DataFrame:
    li = t(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey % 1273 AS position", "l_suppkey AS other", "concat(l_returnflag, l_linestatus) AS mutation")
    return tables.pair_distances(li, "position", "other", "mutation").select("l_orderkey", "l_linenumber", "distance_1d", "sites_affected")


@query("""SELECT CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE 2 END AS place, event_type, count(*) AS n, round(ln(count(*)), 9) AS log_n
FROM events WHERE event_type IN ('view', 'click', 'purchase') GROUP BY event_type""")
def rows_in_order(spark: SparkSession, sf: str) -> DataFrame:
    counts = t(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n")).withColumn("log_n", F.round(F.log("n"), 9))
    return tables.in_order(counts, "event_type", ["view", "click", "purchase"], ["event_type", "n", "log_n"])


# --- values ----------------------------------------------------------------------------------------------------


@query("""SELECT c_custkey, round(1 - (c_acctbal + abs(min(c_acctbal) OVER ())) / nullif(max(c_acctbal) OVER () + abs(min(c_acctbal) OVER ()), 0), 9) AS rescaled FROM customer""")
def rescaled_reverse(spark: SparkSession, sf: str) -> DataFrame:
    out = tables.rescaled_reverse(t(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "rescaled")
    return out.select("c_custkey", F.round("rescaled", 9).alias("rescaled"))


@query("SELECT p_partkey, round(p_retailprice / (p_size % 10), 6) AS ratio FROM part WHERE p_size % 10 <> 0")
def finite_ratios(spark: SparkSession, sf: str) -> DataFrame:
    p = t(spark, sf, "part").selectExpr("p_partkey", "CASE WHEN p_size % 10 = 0 THEN double('Infinity') ELSE p_retailprice / (p_size % 10) END AS ratio")
    return p.withColumn("ratio", tables.finite("ratio")).dropna(subset=["ratio"]).withColumn("ratio", F.round("ratio", 6))


_DRAWS = "SELECT lang, count(*) AS drawn, count(*) FILTER (quality = 1) AS hits FROM documents JOIN labels USING (doc_id) GROUP BY lang"
_CHOOSE = "lgamma({0} + 1) - lgamma({1} + 1) - lgamma({0} - {1} + 1)"


@query(f"""WITH c AS ({_DRAWS}), n AS (SELECT *, sum(drawn) OVER () AS total, sum(hits) OVER () AS marked FROM c),
i AS (SELECT *, unnest(range(greatest(hits, drawn + marked - total, 0)::BIGINT, least(marked, drawn)::BIGINT + 1)) AS i FROM n)
SELECT lang, hits, round(least(1, sum(exp({_CHOOSE.format('marked', 'i')} + {_CHOOSE.format('(total - marked)', '(drawn - i)')} - ({_CHOOSE.format('total', 'drawn')})))), 6) AS tail
FROM i GROUP BY lang, hits""")
def hypergeom_tail(spark: SparkSession, sf: str) -> DataFrame:
    rows = t(spark, sf, "documents").select("doc_id", "lang").join(t(spark, sf, "labels"), "doc_id").groupBy("lang").agg(F.count("*").alias("drawn"), F.count_if(F.col("quality") == 1).alias("hits"))
    rows = rel.with_scalars(rows, total=F.sum("drawn"), marked=F.sum("hits"))
    tail = F.udf(statistics.hypergeometric_tail, "double")  # a row for each group
    return rows.select("lang", "hits", F.round(tail("hits", "total", "marked", "drawn"), 6).alias("tail"))


# --- epistasis -------------------------------------------------------------------------------------------------

_CANON = "CASE WHEN p_size % 2 = 0 THEN concat('K', p_size, 'N') ELSE concat('HA2:S', p_size, 'N') END"
_BACKBONES = f"""SELECT {_CANON} AS canon, p_size, l_returnflag AS lineage, min(l_extendedprice) AS probability
FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_shipdate IS NOT NULL GROUP BY ALL"""


def _backbones(spark: SparkSession, sf: str) -> DataFrame:
    p = t(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.expr(_CANON).alias("canon"))
    rows = t(spark, sf, "lineitem").select("l_partkey", F.col("l_returnflag").alias("lineage"), F.col("l_extendedprice").alias("probability"))
    return rows.join(p, "l_partkey").groupBy("canon", "lineage").agg(F.min("probability").alias("probability"))


@query(f"""WITH c AS ({_BACKBONES}), w AS (SELECT canon, p_size, max(probability) FILTER (lineage = 'A') AS a, max(probability) FILTER (lineage = 'N') AS n, max(probability) FILTER (lineage = 'R') AS r FROM c GROUP BY ALL)
SELECT canon, round(n - a, 4) AS "N_shift", round(r - a, 4) AS "R_shift", round(greatest(abs(n - a), abs(r - a)), 4) AS max_abs_shift, round(greatest(n - a, r - a), 4) AS max_shift,
 round(least(n - a, r - a), 4) AS min_shift, CASE WHEN p_size % 2 = 0 THEN p_size ELSE 10000 + p_size END AS genomic_position FROM w WHERE a IS NOT NULL""")
def epistatic_ranking(spark: SparkSession, sf: str) -> DataFrame:
    cells = _backbones(spark, sf)
    out = scoring.epistatic_ranking(cells, "A", ["A", "N", "R"]).drop("A_shift")
    shifts = F.array("N_shift", "R_shift")
    out = out.withColumns({"max_abs_shift": F.array_max(F.transform(shifts, F.abs)), "max_shift": F.array_max(shifts), "min_shift": F.array_min(shifts)})
    return out.withColumns({c: F.round(c, 4) for c in ("N_shift", "R_shift", "max_abs_shift", "max_shift", "min_shift")})


@query(f"""WITH c AS ({_BACKBONES}), s AS (SELECT c.canon, c.lineage, c.probability AS p, r.probability AS ref, c.probability - r.probability AS shift FROM c JOIN c r ON r.canon = c.canon AND r.lineage = 'A'),
k AS (SELECT *, row_number() OVER (PARTITION BY canon ORDER BY abs(shift) DESC, lineage) AS place FROM s)
SELECT canon, lineage AS strongest_backbone, round(shift, 4) AS probability_shift, round(ref, 4) AS ref_probability, round(p, 4) AS new_probability FROM k WHERE place = 1""")
def strongest_pairs(spark: SparkSession, sf: str) -> DataFrame:
    out = scoring.strongest_pairs(_backbones(spark, sf), "A")
    return out.withColumns({c: F.round(c, 4) for c in ("probability_shift", "ref_probability", "new_probability")})


__all__ = ["QUERIES", "SQL"]
