"""Registered queries of the composite operators, each beside its SQL. Their model is a toy whose softmax can be written
down: the weights of a site's tokens are a rotation of 1, 2, ..., by its letter, its place and the whole sequence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequence as seq
from ..operators import regions, scoring, statistics, surveillance
from .catalog import _NT, _PLACED, QUERIES, SQL, _part_scores, query, t

AA = seq.AMINO_ACIDS
TOKENS = [*AA, "X", "-", "<mask>", "<unk>"]
SIZE = len(TOKENS)
#: Letters as the toy's SQL finds them, `?` standing for a mask.
LETTERS = f"{AA}X-?"


def rotation():
    """The model's scorer; nested, so that workers get it by value."""
    tokens = list(TOKENS)

    def scorer():
        import re

        import numpy as np

        at = {c: i for i, c in enumerate(tokens)}

        def output(s):
            codes = np.array([at.get(c, len(at) - 1) for c in re.findall("<[a-z]+>|.", s)], np.int64)
            if not len(codes):
                return np.zeros(2), np.zeros((0, len(at)))
            turn = 7 * codes + 3 * np.arange(len(codes)) + 5 * codes.sum()
            return np.array([codes.mean(), codes[0]]), np.log(1 + (turn[:, None] + np.arange(len(at))) % len(at))

        return lambda batch: [output(s) for s in batch]

    return scorer


def _code(letter: str) -> str:
    return f"(instr('{LETTERS}', {letter}) - 1)"


def _logp(own: str, place: str, total: str, token: str) -> str:
    """The log-probability of a token at a place (from 1) of a sequence whose codes add up to total."""
    return f"(ln(1 + (7 * {own} + 3 * ({place} - 1) + 5 * {total} + {token}) % {SIZE}) - ln({SIZE * (SIZE + 1) // 2}))"


_CLEAN = "translate(upper(p_name), 'BJOUXZ ', 'ACDEFG')"
_NAMES = f"names AS (SELECT DISTINCT {_CLEAN} AS s FROM part), sites AS (SELECT s, unnest(range(1, length(s) + 1)) AS i FROM names)"


def _names(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "part").select(F.expr(_CLEAN).alias("s")).distinct()


def _rounded(df: DataFrame, *keys: str) -> DataFrame:
    rounded = [(F.round(c, 6) + 0.0).alias(c) for c, kind in df.dtypes if kind == "double" and c not in keys]
    return df.select(*keys, *rounded)


# --- scoring against references --------------------------------------------------------------------------------

_VARIANT = "CASE WHEN (i + length(s)) % 5 = 0 THEN 'W' WHEN i % 7 = 0 THEN '-' ELSE substr(s, i, 1) END"
_SCORED = {
    "relative_sequence_grammaticality": "sum(own - r_own)", "sequence_grammaticality": "sum(own)",
    "grammaticality": "sum(CASE WHEN sub THEN r_alt ELSE 0 END)", "relative_grammaticality": "sum(CASE WHEN sub THEN r_alt - r_own ELSE 0 END)",
    "probability": "exp(sum(CASE WHEN sub THEN r_alt ELSE 0 END))",
    "narrow_sequence_grammaticality": "sum(CASE WHEN sub THEN 0 ELSE own END)",
    "relative_narrow_sequence_grammaticality": "sum(CASE WHEN sub THEN 0 ELSE own - r_own END)",
    "semantic_score": "abs(max(v_total - r_total)::DOUBLE / max(length(s))) + max(CASE WHEN i = 1 THEN abs(v - r) ELSE 0 END)",
}


@query(f"""WITH {_NAMES}, l AS (SELECT s, i, substr(s, i, 1) AS x, {_VARIANT} AS y FROM sites),
c AS (SELECT *, y <> x AND y <> '-' AS sub, y = '-' AS del, {_code('x')} AS r, {_code('y')} AS q, CASE WHEN y = '-' THEN {_code('x')} ELSE {_code('y')} END AS v FROM l),
m AS (SELECT *, sum(r) OVER (PARTITION BY s) AS r_total, sum(v) OVER (PARTITION BY s) AS v_total FROM c),
p AS (SELECT *, {_logp('v', 'i', 'v_total', 'q')} AS own, {_logp('r', 'i', 'r_total', 'r')} AS r_own, {_logp('r', 'i', 'r_total', 'q')} AS r_alt FROM m)
SELECT s, count(*) FILTER (sub)::INT AS mutation_count, coalesce(string_agg(x || i || y, ', ' ORDER BY i) FILTER (sub), '') AS mutations,
coalesce(string_agg(x || i || 'del', ', ' ORDER BY i) FILTER (del), '') AS deletions,
{', '.join(f'round({v}, 6) + 0.0 AS {k}' for k, v in _SCORED.items())} FROM p GROUP BY s""")
def scored_variants(spark: SparkSession, sf: str) -> DataFrame:
    variant = "array_join(transform(sequence(1, length(s)), i -> " + _VARIANT + "), '')"
    pairs = _names(spark, sf).select("s", F.col("s").alias("reference"), F.expr(variant).alias("sequence"))
    out = scoring.against_reference(pairs, rotation(), TOKENS)
    return _rounded(out, "s", "mutation_count", "mutations", "deletions")


_UNGAPPED = {"sequence_grammaticality": "sum(own)", "relative_sequence_grammaticality": "sum(own) - max(r_whole)"}


@query(f"""WITH {_NAMES}, r AS (SELECT *, {_code('substr(s, i, 1)')} AS r FROM sites), rt AS (SELECT s, i, r, sum(r) OVER (PARTITION BY s) AS total FROM r),
whole AS (SELECT s, sum({_logp('r', 'i', 'total', 'r')}) AS r_whole, max(total)::DOUBLE / count(*) AS mean, max(r) FILTER (i = 1) AS lead FROM rt GROUP BY s),
v AS (SELECT s, substr(s, 3) || 'KK' || left(s, 1) AS q FROM names), vs AS (SELECT s, q, unnest(range(1, length(q) + 1)) AS i FROM v),
vc AS (SELECT s, i, {_code('substr(q, i, 1)')} AS v FROM vs), vt AS (SELECT *, sum(v) OVER (PARTITION BY s) AS total FROM vc),
p AS (SELECT vt.s, i, v, total, r_whole, mean, lead, {_logp('v', 'i', 'total', 'v')} AS own FROM vt JOIN whole USING (s))
SELECT s, {', '.join(f'round({v}, 6) + 0.0 AS {k}' for k, v in _UNGAPPED.items())},
round(abs(max(total)::DOUBLE / count(*) - max(mean)) + abs(max(v) FILTER (i = 1) - max(lead)), 6) + 0.0 AS semantic_score FROM p GROUP BY s""")
def scored_with_insertions(spark: SparkSession, sf: str) -> DataFrame:
    moved = F.expr("concat(substring(s, 3), 'KK-', left(s, 1), '*')")
    pairs = _names(spark, sf).select("s", F.col("s").alias("reference"), moved.alias("sequence"))
    return _rounded(scoring.against_reference(pairs, rotation(), TOKENS, ungapped=True, scored_indels=True), "s")


# --- scans -----------------------------------------------------------------------------------------------------

_SCAN = f"""{_NAMES}, r AS (SELECT *, {_code('substr(s, i, 1)')} AS r FROM sites), rt AS (SELECT *, sum(r) OVER (PARTITION BY s) AS total FROM r),
e AS (SELECT s, i, r, total, unnest(range(0, 20)) AS a FROM rt), o AS (SELECT *, total - r + a AS v_total FROM e),
w AS (SELECT o.s, o.i, o.a, sum({_logp('CASE WHEN x.i = o.i THEN o.a ELSE x.r END', 'x.i', 'o.v_total', 'CASE WHEN x.i = o.i THEN o.a ELSE x.r END')}) AS whole
 FROM o JOIN rt x ON x.s = o.s GROUP BY ALL),
rw AS (SELECT s, sum({_logp('r', 'i', 'total', 'r')}) AS r_whole FROM rt GROUP BY s),
k AS (SELECT o.*, whole, r_whole, {_logp('r', 'o.i', 'total', 'o.a')} AS gm, {_logp('r', 'o.i', 'total', 'r')} AS r_ref, {_logp('o.a', 'o.i', 'v_total', 'o.a')} AS mutated,
 {_logp('22', 'o.i', '(total - r + 22)', 'o.a')} AS masked, substr(o.s, o.i, 1) || o.i || substr('{AA}', o.a::INT + 1, 1) AS label,
 abs(v_total - total)::DOUBLE / length(o.s) + CASE WHEN o.i = 1 THEN abs(o.a - r) ELSE 0 END AS change
 FROM o JOIN w ON w.s = o.s AND w.i = o.i AND w.a = o.a JOIN rw ON rw.s = o.s)"""
_MASKED = {
    "semantic_score": "change", "sequence_grammaticality": "whole", "relative_sequence_grammaticality": "whole - r_whole",
    "grammaticality": "gm", "mutated_grammaticality": "mutated", "masked_grammaticality": "masked",
    "relative_grammaticality": "gm - r_ref", "relative_mutated_grammaticality": "mutated - r_ref", "relative_masked_grammaticality": "masked - r_ref",
    "probability": "exp(gm)", "mutated_probability": "exp(mutated)", "masked_probability": "exp(masked)",
}


@query(f"WITH {_SCAN} SELECT s, label, {', '.join(f'round({v}, 6) + 0.0 AS {k}' for k, v in _MASKED.items())} FROM k")
def masked_scan(spark: SparkSession, sf: str) -> DataFrame:
    rows = _names(spark, sf).select("s", F.col("s").alias("reference"))
    return _rounded(scoring.masked_scan(rows, rotation(), TOKENS), "s", "label")


@query(f"""WITH {_SCAN} SELECT s, label, round(change, 6) + 0.0 AS semantic_score, round(CASE WHEN a = r THEN 0 ELSE gm END, 6) + 0.0 AS grammaticality,
round(whole, 6) + 0.0 AS sequence_grammaticality FROM k WHERE i BETWEEN 3 AND 6""")
def scan_of_a_range(spark: SparkSession, sf: str) -> DataFrame:
    rows = _names(spark, sf).select("s", F.col("s").alias("reference"))
    out = scoring.scan(rows, rotation(), TOKENS, start=2, end=5)
    return _rounded(out.select("s", "label", "semantic_score", "grammaticality", "sequence_grammaticality"), "s", "label")


# --- backbones -------------------------------------------------------------------------------------------------


@query(f"""WITH names AS (SELECT DISTINCT {_CLEAN} AS s FROM part), u AS (SELECT unnest([1, 3, 4]) AS i, unnest(['W', 'K', 'A']) AS a),
m AS (SELECT s, i, a, substr(s, i, 1) || i || a AS mutation FROM names, u), b AS (SELECT s, i, a, mutation FROM m UNION ALL SELECT s, 0, '', 'Reference' FROM names),
g AS (SELECT m.s, b.mutation AS backbone, m.mutation, m.i, m.a, CASE WHEN b.i = 0 THEN m.s ELSE left(m.s, b.i - 1) || b.a || substr(m.s, b.i + 1) END AS base FROM m JOIN b ON b.s = m.s AND b.mutation <> m.mutation),
x AS (SELECT *, unnest(range(1, length(base) + 1)) AS j FROM g), c AS (SELECT *, {_code('substr(base, j, 1)')} AS r FROM x),
n AS (SELECT *, sum(r) OVER (PARTITION BY s, backbone, mutation) AS total FROM c)
SELECT s, backbone, mutation, round(CASE WHEN r = {_code('a')} THEN 0 ELSE {_logp('r', 'i', 'total', _code('a'))} END, 6) + 0.0 AS grammaticality,
round(CASE WHEN r = {_code('a')} THEN 0 ELSE {_logp('r', 'i', 'total', _code('a'))} - {_logp('r', 'i', 'total', 'r')} END, 6) + 0.0 AS relative_grammaticality FROM n WHERE j = i""")
def pairwise_epistasis(spark: SparkSession, sf: str) -> DataFrame:
    labels = F.expr("transform(array(struct(1 AS i, 'W' AS a), struct(3 AS i, 'K' AS a), struct(4 AS i, 'A' AS a)), m -> concat(substring(s, m.i, 1), m.i, m.a))")
    rows = _names(spark, sf).select("s", F.col("s").alias("sequence"), labels.alias("labels"))
    out = scoring.against_reference(scoring.pairwise_backbones(rows), rotation(), TOKENS)
    return _rounded(out.select("s", "backbone", "mutation", "grammaticality", "relative_grammaticality"), "s", "backbone", "mutation")


_TARGET, _LONGEST = "REDWIDGETSMALLK", 15


@query(f"""WITH names AS (SELECT DISTINCT rpad({_CLEAN}, {_LONGEST}, '-') AS b FROM part), x AS (SELECT b, unnest(range(1, {_LONGEST + 1})) AS i FROM names),
l AS (SELECT b, i, substr(b, i, 1) AS r, substr('{_TARGET}', i::INT, 1) AS q, {_code("replace(substr(b, i, 1), '-', '')")} AS code FROM x),
n AS (SELECT *, sum(CASE WHEN r <> '-' THEN code ELSE 0 END) OVER (PARTITION BY b) AS total FROM l)
SELECT b AS backbone, r || i || q AS mutation, round({_logp('code', 'i', 'total', _code('q'))}, 6) + 0.0 AS grammaticality FROM n WHERE r <> q AND r <> '-'""")
def backbone_grid(spark: SparkSession, sf: str) -> DataFrame:
    names = _names(spark, sf).select(F.rpad("s", _LONGEST, "-").alias("id")).withColumn("sequence", F.col("id"))
    out = scoring.against_reference(scoring.backbone_pairs(names, _TARGET), rotation(), TOKENS)
    return _rounded(out.select("backbone", "mutation", "grammaticality"), "backbone", "mutation")


# --- sites -----------------------------------------------------------------------------------------------------


@query(f"""WITH {_NAMES}, r AS (SELECT *, {_code('substr(s, i, 1)')} AS r FROM sites), rt AS (SELECT *, sum(r) OVER (PARTITION BY s) AS total FROM r),
cells AS (SELECT s, i, r, a, exp({_logp('r', 'i', 'total', 'a')}) AS p FROM (SELECT *, unnest(range(0, {SIZE})) AS a FROM rt)),
h AS (SELECT s, i, -sum(p * ln(p)) AS entropy, max(p) FILTER (a = r) AS own, max(p) FILTER (a <> r AND a < 20) AS top FROM cells GROUP BY s, i),
k AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY own, i) AS own_rank, row_number() OVER (PARTITION BY s ORDER BY top DESC, i) AS top_rank FROM h),
m AS (SELECT k.*, (i % 13 + 0.5) / 100 AS p_mut FROM k),
b AS (SELECT m.s, m.i, 100.0 * count(*) FILTER (c.p < p_mut) / count(*) AS below FROM m JOIN cells c ON c.s = m.s AND c.a < 20 AND c.a <> c.r GROUP BY m.s, m.i)
SELECT m.s, m.i::INT AS position, round(own, 6) AS probability_reference, round(entropy, 6) AS entropy, own_rank::INT AS reference_probability_rank, round(top, 6) AS max_non_reference_probability,
top_rank::INT AS rank_max_non_reference, round(below, 6) AS probability_percentile FROM m JOIN b ON b.s = m.s AND b.i = m.i""")
def site_ranks(spark: SparkSession, sf: str) -> DataFrame:
    names = _names(spark, sf).select(F.col("s").alias("seq_id"), F.col("s").alias("sequence"))
    mutations = names.withColumn("_i", F.explode(F.expr("sequence(1, length(sequence))")))
    mutations = mutations.select("seq_id", F.expr("concat(substring(sequence, _i, 1), _i, 'W')").alias("mutation"), F.expr("double(_i % 13 + 0.5D) / 100").alias("prob_mutation"))
    outputs = scoring.sequences(names, "sequence", rotation(), TOKENS)
    outputs = outputs.withColumn("logp", F.expr("transform(logp, r -> transform(r, v -> round(v, 9)))"))  # equal weights tie, whatever the order of their sum
    out = scoring.site_table(outputs, mutations, TOKENS)
    keys = ("s", "position", "reference_probability_rank", "rank_max_non_reference")
    return _rounded(out.withColumnRenamed("seq_id", "s").drop("prob_mutation"), *keys)


# --- regions, alignments and lineages --------------------------------------------------------------------------

_FEATURES = """(VALUES (0, 'CDS', 'g', NULL, 0, 0, 30, 1), (0, 'CDS', 'g', NULL, 1, 30, 60, -1), (1, 'CDS', 'h', NULL, 0, 3, 33, -1), (2, 'mat_peptide', 'g', 'p', 0, 0, 21, 1),
(3, 'mat_peptide', 'g', 'p', 1, 21, 45, 1)) AS f(feature, type, gene, product, part, start, stop, strand)"""


@query(f"""WITH o AS (SELECT item_id, {_NT} AS origin FROM benchmark), f AS (SELECT * FROM o, {_FEATURES}),
n AS (SELECT *, CASE WHEN strand < 0 THEN reverse(translate(substr(origin, start + 1, stop - start), 'ACGT', 'TGCA')) ELSE substr(origin, start + 1, stop - start) END AS nt FROM f),
c AS (SELECT *, unnest(range(0, length(nt) // 3)) AS i FROM n),
t AS (SELECT item_id, type, gene, product, feature, part, string_agg(substr('{seq.GENETIC_CODE}', ((instr('TCAG', substr(nt, 3 * i + 1, 1)) - 1) * 16 + (instr('TCAG', substr(nt, 3 * i + 2, 1)) - 1) * 4
 + instr('TCAG', substr(nt, 3 * i + 3, 1)))::INT, 1), '' ORDER BY i) AS protein FROM c GROUP BY ALL)
SELECT item_id, gene || ':' || part AS region, gene, protein FROM t WHERE type = 'CDS' AND gene <> 'g'
UNION ALL SELECT item_id, product, gene, string_agg(string_split(protein, '*')[1], '' ORDER BY feature, part) FROM t WHERE type = 'mat_peptide' GROUP BY item_id, product, gene""")
def genome_regions(spark: SparkSession, sf: str) -> DataFrame:
    nt = _NT.replace(", 'g')", ")")
    parts = F.expr("inline(array(" + ", ".join(
        f"named_struct('feature', {f}, 'type', '{kind}', 'gene', '{g}', 'product', {p}, 'part', {k}, 'start', {a}, 'end', {b}, 'strand', {d})"
        for f, kind, g, p, k, a, b, d in (
            (0, "CDS", "g", "string(NULL)", 0, 0, 30, 1), (0, "CDS", "g", "string(NULL)", 1, 30, 60, -1), (1, "CDS", "h", "string(NULL)", 0, 3, 33, -1),
            (2, "mat_peptide", "g", "'p'", 0, 0, 21, 1), (3, "mat_peptide", "g", "'p'", 1, 21, 45, 1),
        )
    ) + "))")
    features = t(spark, sf, "benchmark").select(F.col("item_id").alias("record"), F.expr(nt).alias("origin"), parts)
    return regions.all_regions(features).select(F.col("record").alias("item_id"), "region", "gene", "protein")


_ALIGNED = "SELECT p_partkey, translate(upper(p_name), ' EA', '---') AS ref, translate(upper(p_name), 'ILN ', '--KN') AS query FROM part"


@query(f"""WITH a AS ({_ALIGNED}), c AS (SELECT *, unnest(range(1, length(ref) + 1)) AS i FROM a),
l AS (SELECT p_partkey, i, substr(ref, i, 1) AS r, substr(query, i, 1) AS q FROM c), n AS (SELECT *, sum((q <> '-')::INT) OVER (PARTITION BY p_partkey ORDER BY i) AS k FROM l)
SELECT p_partkey, i::INT AS "column", q AS residue, CASE WHEN q <> '-' THEN k::INT END AS pos, CASE WHEN q <> '-' THEN q END AS token, CASE WHEN q <> '-' THEN -k / 8.0::DOUBLE END AS logp FROM n WHERE r <> '-'""")
def output_on_alignment(spark: SparkSession, sf: str) -> DataFrame:
    aligned = spark.sql(_ALIGNED.replace("FROM part", "FROM {part}"), part=t(spark, sf, "part")).withColumnRenamed("p_partkey", "seq_id")
    output = aligned.select("seq_id", F.posexplode(F.expr("split(replace(query, '-', ''), '')")).alias("_i", "token"))
    output = output.select("seq_id", (F.col("_i") + 1).alias("pos"), "token", (-(F.col("_i") + 1) / 8.0).alias("logp"))
    return regions.on_alignment(aligned, output).withColumnRenamed("seq_id", "p_partkey")


@query(f"""WITH p AS (SELECT p_partkey, {_CLEAN} AS s FROM part)
SELECT p_partkey, unnest([1, 2, 3]) AS step, unnest(['W' || substr(s, 2), 'W' || substr(s, 2, 2) || 'K' || substr(s, 5), 'A' || substr(s, 2, 2) || 'K' || substr(s, 5)]) AS path FROM p""")
def lineage_paths(spark: SparkSession, sf: str) -> DataFrame:
    steps = "array(array(concat(left(s, 1), '1W')), array('R2del', concat(substring(s, 4, 1), '4K')), array('W1A'))"
    rows = t(spark, sf, "part").select("p_partkey", F.expr(_CLEAN).alias("s")).withColumn("steps", F.expr(steps))
    out = rows.select("p_partkey", F.posexplode(seq.cumulative_path("s", "steps")).alias("step", "path"))
    return out.withColumn("step", F.col("step") + 1)


# --- sliding windows and annotation ----------------------------------------------------------------------------

#: Whole numbers, whose sums are exact in any order.
_DATED = "SELECT l_orderkey, l_linenumber, l_shipdate::DATE AS sample_date, l_quantity::DOUBLE AS a, round(100 * l_discount)::DOUBLE AS b, round(100 * l_tax)::DOUBLE AS g FROM lineitem"


@query(f"""WITH x AS ({_DATED}), d AS (SELECT sample_date, sum(a) AS a, sum(b) AS b, sum(g) AS g, count(*) AS n FROM x WHERE sample_date IS NOT NULL GROUP BY sample_date),
w AS (SELECT sample_date, sum(a) OVER span / sum(n) OVER span AS a, sum(b) OVER span / sum(n) OVER span AS b, sum(g) OVER span / sum(n) OVER span AS g FROM d
 WINDOW span AS (ORDER BY sample_date RANGE BETWEEN INTERVAL 90 DAYS PRECEDING AND CURRENT ROW))
SELECT l_orderkey, l_linenumber, abs(x.a - w.a) + abs(x.b - w.b) AS sliding_semantic_score, x.g - w.g AS sliding_sequence_grammaticality FROM x LEFT JOIN w USING (sample_date)""")
def sliding_deviation(spark: SparkSession, sf: str) -> DataFrame:
    rows = t(spark, sf, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "date(l_shipdate) AS sample_date", "array(double(l_quantity), round(100 * l_discount)) AS embedding",
        "round(100 * l_tax) AS sequence_grammaticality", "'MK*' AS sequence", "2 AS cluster_size",
    )
    _, out = surveillance.sliding_deviation(rows, [0.0, 0.0], least_length=2)
    return out.select("l_orderkey", "l_linenumber", "sliding_semantic_score", "sliding_sequence_grammaticality")


_SPLIT = _PLACED.replace("SELECT *, 'spike' AS region FROM l UNION ALL SELECT *, 'rbd' FROM l WHERE pos BETWEEN 319 AND 541", "SELECT *, CASE WHEN pos BETWEEN 319 AND 541 THEN 'rbd' ELSE 'outwith' END AS region FROM l")


@query(f"""WITH {_SPLIT}, m AS (SELECT DISTINCT l_partkey::VARCHAR AS label, date_trunc('month', l_shipdate)::DATE AS date FROM lineitem), d AS (SELECT DISTINCT date FROM m),
top AS (SELECT feature, region, label, n FROM k WHERE place <= floor(n * 0.25::DOUBLE)), c AS (SELECT feature, region, date, count(*) AS c FROM top JOIN m USING (label) GROUP BY ALL),
g AS (SELECT DISTINCT feature, region, n, date FROM top CROSS JOIN d)
SELECT date, (sum(coalesce(c, 0)) OVER w)::BIGINT AS "count", round((sum(coalesce(c, 0)) OVER w)::DOUBLE / floor(n * 0.25::DOUBLE), 9) AS percentage, feature, region
FROM g LEFT JOIN c USING (feature, region, date) WINDOW w AS (PARTITION BY feature, region ORDER BY date)""")
def share_seen_inside_and_outside(spark: SparkSession, sf: str) -> DataFrame:
    parts = _part_scores(spark, sf)
    months = t(spark, sf, "lineitem").selectExpr("string(l_partkey) AS mutation", "date(date_trunc('month', l_shipdate)) AS sample_date").distinct()
    monthly = months.join(parts.selectExpr("label AS mutation", f"{surveillance.DOMAIN} AS rbd"), "mutation")
    out = surveillance.share_seen_by_date(parts, monthly, {"price": "p", "size": "s"}, [0.25], regions=surveillance.BY_DATE_SPLIT)
    return out.select("date", "count", F.round("percentage", 9).alias("percentage"), "feature", "region")


_COMMON = "SELECT p_partkey::VARCHAR AS label, p_partkey * 37 % 1273 AS pos, p_retailprice::DOUBLE AS price, CASE WHEN p_size % 3 <> 0 THEN p_size::DOUBLE END AS size, CASE WHEN p_size % 5 <> 0 THEN p_size / 7.0::DOUBLE END AS inner_score FROM part"


@query(f"""WITH x AS ({_COMMON}), s AS (SELECT * FROM x WHERE size IS NOT NULL), d AS (SELECT * FROM s WHERE inner_score IS NOT NULL AND pos BETWEEN 319 AND 541),
l AS (SELECT label, 'price' AS feature, price AS value, 'spike' AS region FROM s UNION ALL SELECT label, 'size', size, 'spike' FROM s UNION ALL SELECT label, '0', inner_score, 'spike' FROM s WHERE inner_score IS NOT NULL
 UNION ALL SELECT label, 'price', price, 'rbd' FROM d UNION ALL SELECT label, 'size', size, 'rbd' FROM d UNION ALL SELECT label, 'inner_score', inner_score, 'rbd' FROM d),
k AS (SELECT *, row_number() OVER (PARTITION BY feature, region ORDER BY value DESC, label) AS place, count(*) OVER (PARTITION BY feature, region) AS n FROM l),
b AS (SELECT * FROM (VALUES (0::DOUBLE, 0.1::DOUBLE), (0.1, 0.25), (0.25, 1)) AS y(lo, hi)),
v AS (SELECT l_partkey::VARCHAR AS label, count(*) FILTER (l_returnflag = 'A') AS c FROM lineitem GROUP BY ALL),
f AS (SELECT DISTINCT feature, region FROM k)
SELECT f.feature, f.region, b.hi AS proportion, 'A' AS voc, coalesce(sum(v.c), 0)::DOUBLE AS "count" FROM f CROSS JOIN b
LEFT JOIN k ON k.feature = f.feature AND k.region = f.region AND k.place > floor(k.n * b.lo) AND k.place <= floor(k.n * b.hi) LEFT JOIN v ON v.label = k.label GROUP BY ALL""")
def variant_counts_common(spark: SparkSession, sf: str) -> DataFrame:
    scores = spark.sql(_COMMON.replace("::VARCHAR", "::STRING").replace("FROM part", "FROM {part}"), part=t(spark, sf, "part"))
    lines = t(spark, sf, "lineitem").groupBy(F.col("l_partkey").cast("string").alias("mutation"))
    variants = lines.agg(F.count_if(F.col("l_returnflag") == "A").alias("A"))
    return surveillance.variant_counts_common(scores, variants, ["price", "size"], ["inner_score"], ["A"])


_SCANNED = f"""SELECT event_id AS label, user_id AS pos, substr('{AA}', (user_id % 20 + 1)::INT, 1) AS ref, substr('{AA}', (event_id % 20 + 1)::INT, 1) AS alt,
value AS semantic_score, (event_id % 97)::DOUBLE AS grammaticality FROM events"""


@query(f"""WITH x AS ({_SCANNED}), m AS (SELECT * FROM x WHERE ref <> alt),
k AS (SELECT *, row_number() OVER (ORDER BY semantic_score, label) AS sr, row_number() OVER (ORDER BY grammaticality, label) AS gr FROM m),
a AS (SELECT pos, avg(semantic_score) AS av_s, avg(grammaticality) AS av_g FROM m GROUP BY pos),
e AS (SELECT p_partkey AS pos, p_size::DOUBLE AS entropy FROM part WHERE p_size % 4 <> 0),
j AS (SELECT x.label, x.semantic_score, sr, gr, av_s, av_g, coalesce(entropy, avg(entropy) OVER ()) AS entropy FROM x LEFT JOIN k USING (label) LEFT JOIN a ON a.pos = x.pos LEFT JOIN e ON e.pos = x.pos),
z AS (SELECT *, (semantic_score - avg(semantic_score) OVER ()) / stddev_samp(semantic_score) OVER () AS zs, (entropy - avg(entropy) OVER ()) / stddev_samp(entropy) OVER () AS ze FROM j)
SELECT label, sr::INT AS semantic_rank, gr::INT AS grammatical_rank, (sr + gr)::INT AS acquisition_priority, round(av_s, 6) AS average_semantic_score, round(av_g, 6) AS average_grammaticality,
round(entropy, 6) AS entropy, round(-ln(1 + exp(-zs)) - ln(1 + exp(-ze / 2)), 6) AS composite_score FROM z""")
def annotation_build(spark: SparkSession, sf: str) -> DataFrame:
    scan = spark.sql(_SCANNED.replace("FROM events", "FROM {events}"), events=t(spark, sf, "events"))
    entropy = t(spark, sf, "part").where("p_size % 4 <> 0").selectExpr("p_partkey AS pos", "double(p_size) AS entropy")
    out = surveillance.annotation_build(scan, [(entropy, ["pos"])], impute=["entropy"], composite={"semantic_score": 1.0, "entropy": 2.0})
    rounded = [F.round(c, 6).alias(c) for c in ("average_semantic_score", "average_grammaticality", "entropy", "composite_score")]
    return out.select("label", *[F.col(c).cast("int").alias(c) for c in ("semantic_rank", "grammatical_rank", "acquisition_priority")], *rounded)


_MOMENTS = "count(*) AS n, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, sum(a * a) - sum(a) * sum(a) / count(*) AS aa, sum(b * b) - sum(b) * sum(b) / count(*) AS bb, sum(a * b) - sum(a) * sum(b) / count(*) AS ab"


@query(f"""WITH x AS (SELECT l_extendedprice::DOUBLE / 1000 AS y, l_quantity::DOUBLE AS a, l_linenumber::DOUBLE AS b FROM lineitem),
m AS (SELECT {_MOMENTS}, sum(a * y) - sum(a) * sum(y) / count(*) AS ay, sum(b * y) - sum(b) * sum(y) / count(*) AS bv, sum(y * y) - sum(y) * sum(y) / count(*) AS yy FROM x),
c AS (SELECT *, aa * bb - ab * ab AS d, (bb * ay - ab * bv) / (aa * bb - ab * ab) AS ca, (aa * bv - ab * ay) / (aa * bb - ab * ab) AS cb FROM m),
v AS (SELECT *, (yy - ca * ay - cb * bv) / (n - 3) AS s2 FROM c),
r AS (SELECT unnest(['const', 'a', 'b']) AS term, unnest([my - ca * ma - cb * mb, ca, cb]) AS coef,
 unnest([sqrt(s2 * (1.0 / n + (ma * ma * bb + mb * mb * aa - 2 * ma * mb * ab) / d)), sqrt(s2 * bb / d), sqrt(s2 * aa / d)]) AS std_err FROM v)
SELECT term, round(coef, 6) AS coef, round(std_err, 6) AS std_err, round(coef / std_err, 4) AS t FROM r""")
def ols_two_predictors(spark: SparkSession, sf: str) -> DataFrame:
    rows = t(spark, sf, "lineitem").selectExpr("double(l_extendedprice) / 1000 AS y", "double(l_quantity) AS a", "double(l_linenumber) AS b")
    fit = statistics.ols(rows, "y", ["a", "b"])
    terms = zip(fit["coef"].items(), fit["se"], fit["t"], strict=True)
    out = spark.createDataFrame([("const" if k not in ("a", "b") else k, float(v), float(se), float(x)) for (k, v), se, x in terms], "term string, coef double, std_err double, t double")
    return out.select("term", F.round("coef", 6).alias("coef"), F.round("std_err", 6).alias("std_err"), F.round("t", 4).alias("t"))


__all__ = ["QUERIES", "SQL"]
