import pytest
from pyspark.sql import functions as F

from locusloom.functions import alignment
from locusloom.functions import sequence as seq


def one(spark, expr, **cols):
    types = {str: "string", list: "array<string>"}
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} {types[type(v)]}" for k, v in cols.items()))
    return df.select(expr.alias("r")).first()["r"]


@pytest.mark.parametrize(("s", "m", "want"), [("ARNDCQE", ["A1K", "R2G", "E7D"], "KGNDCQD"), ("ARND", ["R2del", "X3A", "ins2K"], "ARND"), ("AR", ["A5K"], "ARK"), ("AR", [], "AR")])
def test_mutate(spark, s, m, want):
    assert one(spark, seq.mutate("s", "m"), s=s, m=m) == want


def test_revert(spark):
    assert one(spark, seq.revert("s", "m"), s="AKNDCQE", m=["R2K"]) == "ARNDCQE"


@pytest.mark.parametrize(("f", "a", "b", "want"), [
    (seq.diff_labels, "ARNDCQE", "ARND-QE", ["C5del"]), (seq.diff_labels, "AR-D", "ARKD", ["-3K"]), (seq.diff_labels, "", "", []),
    (seq.substitutions, "ARND-CQE", "ARNKKCQE", ["D4K"]), (seq.insertions, "ARND-CQE", "ARNKKCQE", ["ins5K"]), (seq.deletions, "ARND-CQE", "ARNKKCQE", []),
    (seq.deletions, "ARNDC", "ARN-C", ["del4"]), (seq.reference_diff, "ARND-CQE", "AKNDKCQG", ["R2K", "E7G"]),
])
def test_differences(spark, f, a, b, want):
    assert one(spark, f("a", "b"), a=a, b=b) == want


@pytest.mark.parametrize(("nt", "stop", "want"), [("ATG---GGGTAA", False, "M-G*"), ("ATGGGTTAAAAA", True, "MG"), ("ATGGG", False, "M"), ("", False, ""), ("ATGA--", False, "MX"), ("CT?", False, "L"), ("augRAY", False, "MB")])
def test_translate(spark, nt, stop, want):
    assert one(spark, seq.translate("s", stop), s=nt) == want


def test_expansion(spark):
    df = spark.createDataFrame([("AR",)], "s string")
    labels = [r.label for r in seq.expanded(df, "s").collect()]
    assert len(labels) == 40 and {"A1R", "A1A"} <= set(labels)
    assert seq.expanded(df, "s", start=1, mask=True).count() == 21


def test_labels(spark):
    df = spark.createDataFrame([("A12T",), ("A12del",), ("ins5K",), ("del4",), ("A12<mask>",)], "m string")
    rows = df.select(*[c.alias(k) for k, c in seq.parsed_label("m").items()]).collect()
    assert [(r.ref, r.pos, r.alt, r.kind) for r in rows] == [("A", 12, "T", "substitution"), ("A", 12, None, "deletion"), (None, 5, "K", "insertion"), (None, 4, None, "deletion"), ("A", 12, "<mask>", "mask")]
    assert one(spark, seq.canonical_label("m", "c"), m="S394N", c="HA2:49") == "HA2:S49N"
    assert one(spark, seq.canonical_label("m", "c"), m="K18N", c="2") == "K2N"


def test_small_functions(spark):
    df = spark.createDataFrame([(0.0,), (10.0,), (-0.1,), (10.1,)], "v double")
    assert [r[0] for r in df.select(seq.outside("v", 0, 10)).collect()] == [None, None, -0.1, 10.1]
    assert spark.sql("SELECT array(1, 2, 3) a, array(2, 3, 4) b").select(seq.l1("a", "b")).first()[0] == 3.0
    assert one(spark, seq.ungapped("s"), s="AR-D**") == "ARD" and one(spark, seq.header_field("s", -1), s="x|y|J.2") == "J.2"
    assert one(spark, seq.reverse_complement("s"), s="ATGR") == "YCAT"


def test_numbering():
    labels = dict(alignment.numbering("ARNDCQEGHILK", "ARNDCQEGHILK", signal=5))
    assert [labels[i] for i in range(7)] == ["SP-4", "SP-3", "SP-2", "SP-1", "SP0", "1", "2"]
    assert [t for _, t in alignment.numbering("ARNXXD", "ARND", signal=0)] == ["1", "2", "3", "3A", "3B", "4"]


def test_alignment_score_against_brute_force():
    import itertools
    import random

    def brute(a, b):  # all alignments of very short strings
        best = -1e9

        def go(i, j, state, s):
            nonlocal best
            if i == len(a) and j == len(b):
                best = max(best, s)
                return
            if i < len(a) and j < len(b):
                go(i + 1, j + 1, 0, s + (a[i] == b[j]))
            if i < len(a):
                go(i + 1, j, 1, s + (-0.5 if state == 1 else -1.5))
            if j < len(b):
                go(i, j + 1, 2, s + (-0.5 if state == 2 else -1.5))

        go(0, 0, 0, 0)
        return best

    rnd = random.Random(3)
    for n, m in itertools.product(range(1, 5), repeat=2):
        a, b = ("".join(rnd.choice("AB") for _ in range(k)) for k in (n, m))
        score, x, y = alignment.align(a, b, open_gap=-1.5, extend_gap=-0.5)
        assert abs(score - brute(a, b)) < 1e-9 and x.replace("-", "") == a and y.replace("-", "") == b and len(x) == len(y)


def test_alignment_column(spark):
    df = spark.createDataFrame([("ARND", "AND"), (None, "A")], "a string, b string")
    rows = [r.r for r in df.select(alignment.aligned("a", "b", "local").alias("r")).collect()]
    assert rows[0].ref == "ND" and rows[0].score == 2.0 and (rows[1] is None or rows[1].score is None)
    assert df.where("a IS NOT NULL").select(F.explode(alignment.numbered("b", "a", 0))).count() == 3
