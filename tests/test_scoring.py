"""Composite scoring against brute force in plain Python, with a toy model."""

import math
import re

import numpy as np

from locusloom.functions import alignment
from locusloom.operators import scoring
from locusloom.sources import text_formats

TOKENS = ["<cls>", *scoring.seq.AMINO_ACIDS, "X", "-", "<mask>", "<unk>"]
AT = {t: i for i, t in enumerate(TOKENS)}


def build(at=AT):
    """The toy's numbers depend on the site, its letter and the one before. Nested, so that workers get it by value."""

    def letters(s):
        return re.findall(r"<[a-z]+>|.", s)

    def output(s):
        c = letters(s)
        logits = np.array([[math.sin(3 * i + 5 * j + 7 * at[c[i]] + at[c[i - 1]]) for j in range(len(at))] for i in range(len(c))])
        return np.array([sum(at[x] for x in c) / len(c), math.cos(len(c) + at[c[0]])]), logits

    return letters, output, lambda: lambda batch: [output(s) for s in batch]


letters, output, toy = build()


def logp(s):
    z = output(s)[1]
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def whole(s, of, without=()):
    p = logp(of)
    return sum(p[i, AT[c]] for i, c in enumerate(letters(s)) if i not in without)


REF = "MKTAYIAK"


def test_all_metrics(spark):
    rows = [("same", REF), ("two", "MRTAYIWK"), ("gap", "MK-AYVAK"), ("x", "MKXAYIAK"), ("two again", "MRTAYIWK"), ("null", None)]
    pairs = spark.createDataFrame([(k, REF, s) for k, s in rows], "label string, reference string, sequence string")
    got = {r.label: r for r in scoring.against_reference(pairs, toy, TOKENS, per_site=True).collect()}
    assert set(got) == {k for k, _ in rows} and got["null"].semantic_score is None
    p = logp(REF)
    for k, s in rows[:5]:
        r = got[k]
        diff = [i for i in range(8) if s[i] != REF[i]]
        subs = [i for i in diff if s[i] not in "-X"]
        seen = "".join(s[i] if i in subs else REF[i] for i in range(8))
        gm = sum(p[i, AT[s[i]]] for i in subs)
        kept = [i for i in diff if s[i] != "-"]
        want = {
            "grammaticality": gm, "relative_grammaticality": gm - sum(p[i, AT[REF[i]]] for i in subs), "probability": math.exp(gm),
            "sequence_grammaticality": whole(s, seen), "relative_sequence_grammaticality": whole(s, seen) - whole(REF, REF),
            "narrow_sequence_grammaticality": whole(s, seen, kept), "relative_narrow_sequence_grammaticality": whole(s, seen, kept) - whole(REF, REF, kept),
            "semantic_score": abs(output(seen)[0] - output(REF)[0]).sum(), "mutation_count": len(kept),
        }
        for name, v in want.items():
            assert abs(r[name] - v) < 1e-9, (k, name)
        assert r.mutations == ", ".join(f"{REF[i]}{i + 1}{s[i]}" for i in kept)
        q = logp(seen)
        assert abs(r.entropy[3] + (np.exp(q[3]) * q[3]).sum()) < 1e-9 and abs(r.sequence_probabilities[0] - math.exp(q[0, AT[s[0]]])) < 1e-9
    assert got["gap"].deletions == "T3del"


def test_ungapped_and_with_indels(spark):
    pairs = spark.createDataFrame([("a", REF, "MK-AYVAK"), ("b", REF, "MKTAYIAKW*")], "label string, reference string, sequence string")
    a = scoring.against_reference(pairs.where("label = 'a'"), toy, TOKENS, ungapped=True).first()
    assert abs(a.sequence_grammaticality - whole("MKAYVAK", "MKAYVAK")) < 1e-9 and abs(a.grammaticality - logp(REF)[5, AT["V"]]) < 1e-9
    b = scoring.against_reference(pairs, toy, TOKENS, ungapped=True, scored_indels=True).where("label = 'b'").first()
    assert abs(b.relative_sequence_grammaticality - whole("MKTAYIAKW", "MKTAYIAKW") + whole(REF, REF)) < 1e-9 and "grammaticality" not in b


def test_scans(spark):
    refs = spark.createDataFrame([("r", "MKT")], "region string, reference string")
    rows = scoring.scan(refs, toy, TOKENS).collect()
    assert len(rows) == 60 and {r.region for r in rows} == {"r"}
    own = next(r for r in rows if r.label == "K2K")
    assert own.semantic_score == 0 and own.probability == 1
    hidden = scoring.masked_scan(refs, toy, TOKENS).collect()
    assert len(hidden) == 60
    r = next(r for r in hidden if r.label == "K2W")
    want = {"grammaticality": logp("MKT")[1, AT["W"]], "mutated_grammaticality": logp("MWT")[1, AT["W"]], "masked_grammaticality": logp("M<mask>T")[1, AT["W"]]}
    for k, v in want.items():
        assert abs(r[k] - v) < 1e-9 and abs(r["relative_" + k] - v + logp("MKT")[1, AT["K"]]) < 1e-9
    assert scoring.masked_scan(refs, toy, TOKENS, mask=False).where("masked_grammaticality IS NOT NULL").count() == 0


def test_grids(spark):
    b = spark.createDataFrame([("b1", "MKTA-I"), ("b2", "MRTAYI")], "id string, sequence string")
    got = {(r.backbone, r.canon, r.reference, r.sequence) for r in scoring.backbone_pairs(b, "MRSAY-").collect()}
    assert got == {("b1", "K2R", "MKTAI", "MRTAI"), ("b1", "T3S", "MKTAI", "MKSAI"), ("b2", "T3S", "MRTAYI", "MRSAYI")}
    one = spark.createDataFrame([("x", "MKTA", ["K2R", "T3S", "A4W"])], "id string, sequence string, labels array<string>")
    pairs = scoring.pairwise_backbones(one)
    rows = {(r.backbone, r.mutation): (r.reference, r.sequence) for r in pairs.collect()}
    assert len(rows) == 9 and rows["Reference", "K2R"] == ("MKTA", "MRTA") and rows["K2R", "T3S"] == ("MRTA", "MRSA")
    assert scoring.against_reference(pairs, toy, TOKENS).count() == 9


def test_ranking(spark):
    rows = [("K2R", "J", 0.2), ("K2R", "A", 0.5), ("K2R", "B", 0.1), ("HA2:S49N", "J", 0.3), ("HA2:S49N", "B", 0.6), ("HA2:S49N", "A", 0.0), ("T9S", "A", 0.9)]
    cells = spark.createDataFrame(rows, "canon string, lineage string, probability double")
    got = {r.canon: r for r in scoring.epistatic_ranking(cells, "J", ["A", "B", "J"]).collect()}
    assert set(got) == {"K2R", "HA2:S49N"} and got["HA2:S49N"].genomic_position == 10049
    assert abs(got["K2R"].max_abs_shift - 0.3) < 1e-12 and abs(got["K2R"].min_shift + 0.1) < 1e-12 and got["K2R"].J_shift == 0
    best = {r.canon: r for r in scoring.strongest_pairs(cells, "J").collect()}
    assert best["K2R"].strongest_backbone == "A" and best["HA2:S49N"].strongest_backbone == "A" and best["HA2:S49N"].new_probability == 0.0


def test_site_table(spark):
    s = "MKXT"
    out = scoring.modelled(spark.createDataFrame([("r", s)], "seq_id string, sequence string"), "sequence", toy)
    muts = spark.createDataFrame([("r", "K2R", 0.05), ("r", "T4W", 0.02)], "seq_id string, mutation string, prob_mutation double")
    p = np.exp(logp(s))[:, 1:21]
    aa = scoring.seq.AMINO_ACIDS
    own = [np.exp(logp(s))[i, AT[c]] for i, c in enumerate(s)]
    top = [max(v for k, v in enumerate(p[i]) if aa[k] != c) for i, c in enumerate(s)]
    blank = [aa.index(c) for c in "MKKT"]
    cells = [v for i in range(4) for k, v in enumerate(p[i]) if k != blank[i]]
    for r in scoring.site_table(out, muts, TOKENS).collect():
        i = r.position - 1
        assert abs(r.probability_reference - own[i]) < 1e-12 and r.reference_probability_rank == 1 + sum(v < own[i] for v in own)
        assert abs(r.max_non_reference_probability - top[i]) < 1e-12 and r.rank_max_non_reference == 1 + sum(v > top[i] for v in top)
        assert abs(r.probability_percentile - 100 * sum(v < r.prob_mutation for v in cells) / len(cells)) < 1e-9


def test_sites_of_a_structure(spark):
    lines = [f"ATOM  {i:5d}  CA  {r} A{n:4d}       0.000   0.000   0.000  1.00  5.00" for i, (r, n) in enumerate((("LYS", 10), ("THR", 11), ("ALA", 14), ("TYR", 15)), 1)]
    rows = [("A", int(x[22:26]), "", {"LYS": "K", "THR": "T", "ALA": "A", "TYR": "Y"}[x[17:20]], i) for i, x in enumerate(lines)]
    residues = spark.createDataFrame(rows, "chain string, resseq int, icode string, residue string, ord long")
    got = {(r.seq_pos, r.resseq) for r in text_formats.structure_sites(residues, "MKTAYK", least_score=3).collect()}
    assert got == {(2, 10), (3, 11), (4, 14), (5, 15)} and text_formats.structure_sites(residues, "MKTAYK").count() == 0
    assert alignment.located("MKTAYK", "KTAY", "local")[1:] == ("KTAY", "KTAY", 1, 0)
