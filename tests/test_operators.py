import math

from pyspark.sql import functions as F

from locusloom.operators import model_output as mo
from locusloom.operators import relational as rel
from locusloom.operators import statistics as st
from locusloom.operators import tables


def test_ranks_put_nulls_last_and_break_ties_by_label(spark):
    df = spark.createDataFrame([(2.0, "a"), (None, "b"), (1.0, "c"), (2.0, "d")], "x double, label string")
    got = {r.label: r.r for r in rel.ranked(df, F.col("x").asc_nulls_last(), "label", "r").collect()}
    assert got == {"c": 1, "a": 2, "d": 3, "b": 4}


def test_slices(spark):
    df = spark.createDataFrame([(float(i), str(i)) for i in range(11)] + [(None, "n")], "x double, k string")
    assert [rel.sliced(df, "x", "k", lo, hi).count() for lo, hi in ((0, 0.1), (0.1, 0.25), (0.25, 1))] == [1, 1, 9]


def test_override_and_mirror(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(2, "z")], "k int, v string")
    assert sorted(map(tuple, rel.overriding(a, b, "k").collect())) == [(1, "x"), (2, "z")]
    assert rel.both_ways(a.select("k", F.lit(9).alias("j")), "k", "j").count() == 4


def test_empty_tables(spark):
    df = spark.createDataFrame([], "x double, k string, g string")
    assert rel.ranked(df, F.col("x").asc(), "k", "r").count() == 0 and rel.percent_below(df, "x", "p").count() == 0
    assert rel.outliers(df, "x", [], "o").count() == 0 and st.benjamini_hochberg(df, "x", "k").count() == 0


def test_softmax_and_sums(spark):
    rows = [("s", p, t, v) for p in (1, 2) for t, v in zip("ACD", (10.0, 0.0, -3.0), strict=True)]
    lp = mo.log_softmax(spark.createDataFrame(rows, "seq_id string, pos int, token string, logit double"))
    norm = math.log(sum(math.exp(v) for v in (10, 0, -3)))
    res = spark.createDataFrame([("s", 1, "A"), ("s", 2, "C")], "seq_id string, pos int, token string")
    assert abs(mo.sequence_grammaticality(mo.own(lp, res)).first()[1] - (10 - 2 * norm)) < 1e-9
    muts = spark.createDataFrame([("s", 2, "A", "C")], "seq_id string, pos int, ref string, alt string")
    g = mo.grammaticality(lp, muts).first()
    assert abs(g.grammaticality + norm) < 1e-9 and abs(g.relative_grammaticality + 10) < 1e-9
    ent = -sum(math.exp(v - norm) * (v - norm) for v in (10, 0, -3))
    assert abs(mo.entropy(lp).first().entropy - ent) < 1e-9


def test_scorer_runs_once_per_sequence(spark):
    def scorer():
        def score(batch):
            batch["length"] = batch["sequence"].str.len()
            return batch

        return score

    df = spark.createDataFrame([("a", "ARN"), ("b", "ARN"), ("c", "")], "id string, sequence string")
    assert {r.id: r.length for r in mo.scored(df, scorer, "sequence string, length long").collect()} == {"a": 3, "b": 3, "c": 0}


def test_tails():
    assert abs(st.hypergeometric_tail(2, 10, 4, 3) - (4 * 3 / 2 * 6 + 4) / 120) < 1e-12
    assert abs(st.incomplete_beta(2, 3, 0.4) - 0.5248) < 1e-9
    assert abs(st.correlation_p(0.5, 12) - 0.0979) < 5e-4 and st.mann_whitney_p(50, 10, 10, 0) == 1.0


def test_ols_against_closed_form(spark):
    df = spark.createDataFrame([(float(x), 2.0 + 3.0 * x + (-1) ** x) for x in range(10)], "x double, y double")
    r = st.ols(df, "y", ["x"])
    reg = df.agg(F.regr_slope("y", "x"), F.regr_intercept("y", "x"), F.regr_r2("y", "x")).first()
    assert all(abs(a - b) < 1e-9 for a, b in zip((r["coef"]["x"], r["coef"]["intercept"], r["r2"]), reg, strict=True))


def test_spearman_ties(spark):
    df = spark.createDataFrame([("g", 1.0, 1.0), ("g", 1.0, 2.0), ("g", 3.0, 3.0), ("g", None, 9.0)], "g string, x double, y double")
    r = st.spearman(df, "x", "y", ["g"]).first()
    assert r.n == 3 and abs(r.rho - math.sqrt(3) / 2) < 1e-9


def test_average_ranks_over_ranges(spark):
    import random

    from locusloom.operators import statistics as st

    r = random.Random(3)
    rows = [(r.choice("ab"), r.choice([None, float("nan"), *(x / 7 for x in range(40))])) for _ in range(600)]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "i int, g string, v double")
    for by in ([], ["g"]):
        got = {x.i: x.rank for x in st.average_ranks(df, "v", "rank", by).collect()}
        for i, (g, v) in enumerate(rows):
            key = lambda x: (x != x, x if x == x else 0)
            others = [key(w) for h, w in rows if w is not None and (not by or h == g)]
            assert v is None and i not in got or got[i] == sum(o < key(v) for o in others) + (sum(o == key(v) for o in others) + 1) / 2
    assert st.average_ranks(df.limit(0), "v", "rank").count() == 0


def test_false_discovery_over_blocks(spark):
    import random

    from locusloom.operators import statistics as st

    r = random.Random(4)
    ps = [r.random() ** 3 for _ in range(300)] + [None]
    df = spark.createDataFrame(list(enumerate(ps)), "i int, p double")
    got = {x.i: x.fdr for x in st.benjamini_hochberg(df, "p", "i", block=17).collect()}
    order = sorted(range(300), key=lambda i: (ps[i], i))
    best, want = 1.0, {}
    for k in range(300, 0, -1):
        best = min(best, ps[order[k - 1]] * 300 / k)
        want[order[k - 1]] = best
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-12 for i in want)


def test_maps_to_flat_tables(spark):
    from locusloom.operators import tables

    df = spark.createDataFrame([("r", {"A1K": {"x": 1.0, "y": 2.0}, "A1R": {"y": None}}, {"A1K": [1.0, 2.0]}), ("s", {}, None)], "region string, scores map<string, map<string, double>>, vectors map<string, array<double>>")
    got = sorted(map(tuple, tables.flat_scores(df, "scores", ["y", "x", "z"], ["region"]).collect()))
    assert got == [("r", "A1K", 2.0, 1.0, None), ("r", "A1R", None, None, None)]
    assert [tuple(r) for r in tables.representation_table(df, "vectors", ["region"]).collect()] == [("r", "A1K", [1.0, 2.0])]


def test_suffix_join_cuts_heavy_keys(spark):
    left = spark.range(300).selectExpr("id % 3 AS k", "id AS a", "map('x', id) AS m", "id AS v")
    left = left.unionByName(left.where("a < 9")).unionByName(left.selectExpr("bigint(NULL) AS k", "a", "m", "v"))
    right = spark.range(700).selectExpr("id % 7 AS k", "id AS b", "-id AS v").unionByName(spark.range(50).selectExpr("bigint(NULL) AS k", "id AS b", "id AS v"))
    want = sorted((x.k, x.a, y.b, x.v, y.v) for x in left.where("k IS NOT NULL").collect() for y in right.collect() if x.k == y.k)
    for cell in (1, 70, 1 << 22):
        for sides, order in (((left, right), ("v_x", "v_y")), ((right, left), ("v_y", "v_x"))):
            got = tables.suffix_join(*sides, ["k"], cell=cell).select("k", "a", "b", *order)
            assert sorted(map(tuple, got.collect())) == want
    one = tables.suffix_join(spark.range(40).selectExpr("id % 1 AS k", "id AS a"), spark.range(900).selectExpr("id % 1 AS k", "id AS b"), ["k"], cell=100)
    sizes = [r["count"] for r in one.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 36_000 and len(sizes) == 4 and max(sizes) < 12_000  # one key on all four partitions
