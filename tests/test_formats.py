from locusloom.sources import text_formats as tf
from locusloom.streaming import trailing

PDB = """HEADER    X
ATOM      1  N   MET A   1      27.340  24.430   2.614  1.00  9.67           N
ATOM      2  CA  MET A   1      26.266  25.413   2.842  1.00 10.38           C
ATOM      3  N   LYS A   2      26.913  26.639   3.531  1.00  9.62           N
ATOM      4  N   LYS B   2      26.913  26.639   3.531  1.00  9.62           N
HETATM    5  O   HOH A 101      26.913  26.639   3.531  1.00  9.62           O
END
"""
GENBANK = """LOCUS       REC1                 30 bp
FEATURES             Location/Qualifiers
     source          1..30
     CDS             join(1..9,12..20)
                     /gene="g"
                     /product="long
                     name"
     mat_peptide     complement(1..6)
                     /product="p"
ORIGIN
        1 atgggtaaac ccgggatggg taaacccggg
//
"""


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">seq1 first one\nARND\nCQ\n>seq2\nAR-D\n>seq1 again\nKK\n")
    got = {r.seq_id: (r.sequence, r.ord) for r in tf.fasta(spark, str(tmp_path / "a.fa")).collect()}
    assert {k: v[0] for k, v in got.items()} == {"seq1": "KK", "seq2": "AR-D"} and got["seq1"][1] > got["seq2"][1]


def test_delimited(spark, tmp_path):
    (tmp_path / "a.csv").write_text(",x,y\n0,1,NaN\n1,2,0.5\n")
    df = tf.delimited(spark, str(tmp_path / "a.csv"), "i int, x int, y double", drop_index=True)
    assert [tuple(r) for r in df.orderBy("x").collect()] == [(1, None), (2, 0.5)]
    tf.written(df, str(tmp_path / "out"), sep="\t")
    tf.written(df, str(tmp_path / "out"), sep="\t", append=True)
    assert tf.delimited(spark, str(tmp_path / "out"), "x int, y double", sep="\t").count() == 4


def test_pdb(spark, tmp_path):
    (tmp_path / "a.pdb").write_text(PDB)
    atoms = tf.pdb_atoms(spark, str(tmp_path / "a.pdb"))
    assert atoms.count() == 5 and atoms.where("record = 'HETATM'").first().residue is None
    seqs = {r.chain: (r.sequence, r.monomer) for r in tf.chain_sequences(tf.pdb_residues(atoms)).collect()}
    assert seqs == {"A": ("MK", False), "B": ("K", False)}
    lines = tf.with_bfactor(atoms, spark.createDataFrame([(1, -2.345)], "resseq int, score double"), positive=True).orderBy("ord").collect()
    assert lines[0].value[60:66] == "  2.35" and lines[2].value[60:66] == "  0.00" and len(lines[0].value) == len(PDB.split("\n")[1])
    assert tf.site_command(atoms, "resseq").first()[0] == "select :1,2,101"


def test_genbank(spark, tmp_path):
    (tmp_path / "a.gb").write_text(GENBANK)
    rows = [(r.type, r.gene, r.product, r.part, r.start, r.end, r.strand) for r in tf.genbank_features(spark, str(tmp_path / "a.gb")).orderBy("feature", "part").collect()]
    assert rows == [("CDS", "g", "long name", 0, 0, 9, 1), ("CDS", "g", "long name", 1, 11, 20, 1), ("mat_peptide", None, "p", 0, 0, 6, -1)]


def test_strands_of_parts(spark, tmp_path):
    for i, (where, want) in enumerate({
        "join(complement(1..6),10..15)": [(0, 6, -1), (9, 15, 1)],
        "complement(join(1..6,10..15))": [(9, 15, -1), (0, 6, -1)],
        "order(1..6,complement(<10..>15))": [(0, 6, 1), (9, 15, -1)],
    }.items()):
        (tmp_path / f"{i}.gb").write_text(GENBANK.replace("join(1..9,12..20)", where))
        rows = tf.genbank_features(spark, str(tmp_path / f"{i}.gb")).where("type = 'CDS'").orderBy("part").collect()
        assert [(r.start, r.end, r.strand) for r in rows] == want, where


def test_models_of_several_files(spark, tmp_path):
    atom = PDB.split("\n")[1]
    (tmp_path / "a.pdb").write_text(f"MODEL        1\n{atom}\nENDMDL\nMODEL        2\n{atom}\n{atom.replace('   1   ', '   2   ')}\nENDMDL\n")
    (tmp_path / "b.pdb").write_text(PDB)
    atoms = tf.pdb_atoms(spark, str(tmp_path))
    assert {(r.file[-5:], r.model): r["count"] for r in atoms.groupBy("file", "model").count().collect()} == {("a.pdb", 1): 1, ("a.pdb", 2): 2, ("b.pdb", 1): 5}
    got = {(r.file[-5:], r.chain): (r.sequence, r.monomer) for r in tf.chain_sequences(tf.pdb_residues(atoms)).collect()}
    assert got == {("a.pdb", "A"): ("M", True), ("b.pdb", "A"): ("MK", False), ("b.pdb", "B"): ("K", False)}


def test_inferred_types(spark, tmp_path):
    (tmp_path / "a.csv").write_text(",x,y\n0,1,NaN\n1,2,0.5\n")
    df = tf.delimited(spark, str(tmp_path / "a.csv"), drop_index=True)
    assert df.dtypes == [("x", "int"), ("y", "double")] and [tuple(r) for r in df.orderBy("x").collect()] == [(1, None), (2, 0.5)]


def test_streaming_means(spark, tmp_path):
    spark.createDataFrame([("2024-01-01 10:00:00", 1.0), ("2024-01-02 10:00:00", 3.0)], "ts string, value double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts string, value double").parquet(str(tmp_path / "in"))
    q = trailing.trailing_means(stream, "ts", "value", days=2).writeStream.format("memory").queryName("means").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {str(r.day): r.trailing_mean for r in spark.table("means").collect()} == {"2024-01-01": 1.0, "2024-01-02": 2.0, "2024-01-03": 3.0}
