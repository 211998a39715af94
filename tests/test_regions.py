import numpy as np

from locusloom.operators import lineages, regions, regression


def test_lineages(spark):
    vocs = lineages.voc_table(spark, {"Q.1": "B.1.1.7", "AY": "B.1.617.2", "AY.1": "AY.9", "ZZ": "X.1"})
    assert {(r.voc, r.lineage) for r in vocs.where("ord > 0").collect()} == {("Alpha", "Q.1"), ("Delta", "AY"), ("Delta", "AY.1")}
    df = spark.createDataFrame([("B.1.1.7.1",), ("B.1.1.529.1",), ("B.1.2",), ("Q.1",), ("AY.33",), ("P.1",)], "lineage string")
    got = {r.lineage: r.voc for r in lineages.classified(df, "lineage", vocs).collect()}
    assert got == {"B.1.1.7.1": "Alpha", "B.1.1.529.1": "Omicron", "B.1.2": "Non-VOC", "Q.1": "Alpha", "AY.33": "Delta", "P.1": "Gamma"}


def test_regions(spark):
    origin = "ATGGGTAAACCCGGG" * 2
    rows = [("r", 0, "CDS", "g", None, 0, 0, 9, 1, origin), ("r", 1, "CDS", "h", None, 0, 0, 6, -1, origin), ("r", 2, "mat_peptide", "g", "p", 0, 0, 3, 1, origin), ("r", 2, "mat_peptide", "g", "p", 1, 6, 12, 1, origin)]
    f = spark.createDataFrame(rows, "record string, feature int, type string, gene string, product string, part int, start int, end int, strand int, origin string")
    assert {(r.region, r.protein) for r in regions.coding_regions(f).collect()} == {("g:0", "MGK"), ("h:0", "TH")}
    assert {(r.region, r.protein) for r in regions.all_regions(f).collect()} == {("h:0", "TH"), ("p", "MKP")}


def test_output_on_alignment(spark):
    a = spark.createDataFrame([("s", "AR-ND", "A-KND")], "seq_id string, ref string, query string")
    lp = spark.createDataFrame([("s", p, t, -float(p)) for p, t in enumerate("AKND", 1)], "seq_id string, pos int, token string, logp double")
    got = [(r.column, r.residue, r.logp) for r in regions.on_alignment(a, lp).orderBy("column").collect()]
    assert got == [(1, "A", -1.0), (2, "-", None), (4, "N", -3.0), (5, "D", -4.0)]


def test_alignment_is_never_broadcast(spark):
    a = spark.range(50).selectExpr("string(id) AS seq_id", "'AR-ND' AS ref", "'A-KND' AS query")
    lp = spark.range(50).selectExpr("string(id) AS seq_id", "posexplode(split('AKND', '')) AS (pos, token)", "0D AS logp").selectExpr("seq_id", "pos + 1 AS pos", "token", "logp")
    out = regions.on_alignment(a, lp)
    assert out.where("logp IS NOT NULL").count() == 150
    plan = out._jdf.queryExecution()
    out.write.format("noop").mode("overwrite").save()
    assert "Broadcast" not in plan.executedPlan().toString() and "SortMergeJoin" in plan.executedPlan().toString()


def test_cross_validation(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((150, 3))
    rows = [(i, v.tolist(), float(v[0] - 2 * v[1]), float(np.sin(2 * v[0]) + v[2] ** 2)) for i, v in enumerate(x)]
    df = regression.with_folds(spark.createDataFrame(rows, "id long, x array<double>, line double, curve double"), "id")
    line = regression.cross_validated(df, "x", "line").collect()
    assert len(line) == 15 and min(r.rho for r in line) > 0.999 and sum(r.n for r in line) == 450
    svr, flat = (regression.summary(regression.cross_validated(df, "x", "curve", model=m)).first().mean_rho for m in ("svr", "linear"))
    assert svr > 0.6 and svr > flat + 0.2
