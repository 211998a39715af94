"""Composites over scores and samples against brute force."""

import datetime
import math
import statistics

from pyspark.sql import functions as F

from locusloom.operators import relational as rel
from locusloom.operators import surveillance as sv


def table(spark, n=60):
    rows = [(f"A{310 + i // 2}{'RN'[i % 2]}", 310 + i // 2, float((i * 37) % 23), None if i % 7 == 0 else float((i * 11) % 19)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "label string, pos int, a double, `b RBD` double")


def cut(rows, k, lo, hi):
    kept = sorted((r for r in rows if r[k] is not None), key=lambda r: (-r[k], r[0]))
    return {r[0] for r in kept[int(len(kept) * lo) : int(len(kept) * hi)]}, len(kept)


def test_ranks_within_groups(spark):
    df = spark.range(500).selectExpr("CASE WHEN id % 10 = 0 THEN 'x' ELSE 'y' END AS g", "id * 7919 % 503 AS v", "string(id) AS t")
    got = {r.t: r.r for r in rel.ranked_within(df, ["g"], F.col("v").desc(), "t", "r").collect()}
    rows = df.collect()
    for g in "xy":
        order = sorted((r for r in rows if r.g == g), key=lambda r: (-r.v, r.t))
        assert all(got[r.t] == i for i, r in enumerate(order, 1))


def test_variant_counts(spark):
    rows, scores = table(spark)
    marks = [(r[0], i % 2, int(i % 5 == 0)) for i, r in enumerate(rows) if i % 3]
    variants = spark.createDataFrame(marks, "mutation string, `P.1` int, `BA.2` int")
    inside = [r for r in rows if 319 <= r[1] <= 541]
    got = {(r.feature, r.region, r.proportion, r.voc): r["count"] for r in sv.variant_counts(scores, variants, ["a", "b RBD"], ["P.1", "BA.2"]).collect()}
    assert len(got) == 2 * 2 * 3 * 2
    for k, f in ((2, "a"), (3, "b RBD")):
        for region, part in (("spike", rows), ("rbd", inside)):
            for lo, hi in sv.SLICES:
                labels, _ = cut(part, k, lo, hi)
                for j, v in ((1, "P.1"), (2, "BA.2")):
                    assert got[f, region, hi, v] == sum(m[j] for m in marks if m[0] in labels)
    common = {(r.feature, r.region, r.proportion, r.voc): r["count"] for r in sv.variant_counts_common(scores, variants, ["a"], ["b RBD"], ["P.1"]).collect()}
    full = [r for r in inside if r[3] is not None]
    labels, _ = cut(full, 2, 0, 0.1)
    assert len(common) == 12 and common["a", "rbd", 0.1, "P.1"] == sum(m[1] for m in marks if m[0] in labels)
    assert {k[0] for k in common if k[1] == "spike"} == {"a", "0"}


def test_share_by_date(spark):
    rows, scores = table(spark)
    day = datetime.date(2021, 1, 1)
    seen = [(rows[(i * 17) % 60][0], day + datetime.timedelta(30 * (i % 4)), 319 <= rows[(i * 17) % 60][1] <= 541) for i in range(40)]
    monthly = spark.createDataFrame(seen, "mutation string, sample_date date, rbd boolean")
    got = sv.share_seen_by_date(scores, monthly, {"a": "m", "b RBD": "n"}, [0.1, 0.5], regions=sv.BY_DATE_SPLIT).collect()
    assert len(got) == 2 * 2 * 2 * 4
    for r in got:
        part = [x for x in rows if (319 <= x[1] <= 541) == (r.region == "rbd")]
        labels, n = cut(part, 2 if r.feature == "a" else 3, 0, r.proportion)
        want = sum(m in labels and d <= r.date and b == (r.region == "rbd") for m, d, b in seen)
        size = int(n * r.proportion)
        assert r["count"] == want and (r.percentage is None if not size else abs(r.percentage - want / size) < 1e-12)
        assert r.method == {"a": "m", "b RBD": "n"}[r.feature]


def test_sliding_deviation(spark):
    day = datetime.date(2021, 1, 1)
    rows = [(f"s{i}", None if i == 5 else day + datetime.timedelta(20 * (i % 8)), "A" * 6 + "*", [float(i), i * i / 7], float(-i), 1 if i == 3 else 2) for i in range(20)]
    df = spark.createDataFrame(rows, "label string, sample_date date, sequence string, embedding array<double>, sequence_grammaticality double, cluster_size int")
    windows, out = sv.sliding_deviation(df, [0.0, 1.0], days=40, least_length=6)
    kept = [r for r in rows if r[5] > 1]
    for w in windows.collect():
        near = [r for r in kept if r[1] and 0 <= (w.sample_date - r[1]).days <= 40]
        mean = [statistics.fmean(r[3][d] for r in near) for d in range(2)]
        assert max(abs(a - b) for a, b in zip(mean, w.mean_sliding_embedding, strict=True)) < 1e-9
        assert abs(w.mean_sliding_embedding_semantic_score - abs(mean[0]) - abs(mean[1] - 1)) < 1e-9
        for o in out.where(F.col("sample_date") == w.sample_date).collect():
            assert abs(o.sliding_semantic_score - sum(abs(a - b) for a, b in zip(o.embedding, mean, strict=True))) < 1e-9
            assert abs(o.sliding_sequence_grammaticality - o.sequence_grammaticality + statistics.fmean(r[4] for r in near)) < 1e-9
    assert out.count() == 19 and out.where("label = 's5'").first().sliding_semantic_score is None
    assert sv.sliding_deviation(df, [0.0, 1.0], least_length=7)[1].count() == 0


def test_annotation_build(spark):
    rows = [("A1R", 1, "A", "R", 3.0, -1.0), ("A1A", 1, "A", "A", 0.0, 0.0), ("A1N", 1, "A", "N", 1.0, -4.0), ("A1<mask>", 1, "A", "<mask>", 9.0, 9.0), ("C2R", 2, "C", "R", 2.0, -2.0)]
    scan = spark.createDataFrame(rows, "label string, pos int, ref string, alt string, semantic_score double, grammaticality double")
    side = spark.createDataFrame([("A1R", 4.0), ("C2R", 8.0)], "label string, access double")
    got = {r.label: r for r in sv.annotation_build(scan, [(side, ["label"])], impute=["access"], composite={"grammaticality": 1, "access": 2}).collect()}
    assert len(got) == 5 and got["A1A"].semantic_rank is None and got["A1<mask>"].acquisition_priority is None
    assert {k: r.semantic_rank for k, r in got.items() if r.semantic_rank} == {"A1N": 1, "C2R": 2, "A1R": 3}
    assert got["A1R"].average_semantic_score == 2.0 and got["A1N"].access == 6.0
    g = [r[5] for r in rows]
    a = [got[r[0]].access for r in rows]
    for r in rows:
        z = ((r[5] - statistics.fmean(g)) / statistics.stdev(g), (got[r[0]].access - 6) / statistics.stdev(a))
        want = sum(-math.log1p(math.exp(-v / t)) for v, t in zip(z, (1, 2), strict=True))
        assert abs(got[r[0]].composite_score - want) < 1e-9
    assert sv.position_averages(sv.annotation_build(scan, []), ["pos", "average_grammaticality"]).count() == 2
