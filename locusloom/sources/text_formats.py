"""Readers and writers. All formats are lines of text, split by Spark, so large files are read in parallel; a record never
meets another one in a task except where a format demands it (PDB order is a column)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.alignment import traced

#: Three-letter residue names.
RESIDUES = {"ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I", "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V"}


def delimited(spark: SparkSession, path: str, schema: StructType | str | None = None, *, sep: str = ",", drop_index: bool = False) -> DataFrame:
    """CSV or TSV with a header; NaN becomes null; drop_index drops an unnamed first column. Without a schema the types
    are inferred, which reads the files once more."""
    reader = spark.read.option("header", True).option("sep", sep)
    df = (reader.option("inferSchema", True) if schema is None else reader.schema(schema)).csv(path)
    if drop_index:
        df = df.drop(df.columns[0])
    floats = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """seq_id (the header up to white space), description, ord (order in the input), sequence. Of equal ids the last
    stays. Records are parted at `>` by the reader."""
    raw = spark.read.option("lineSep", "\n>").text(path).withColumn("ord", F.monotonically_increasing_id())
    text = F.regexp_replace(F.regexp_replace("value", "\r", ""), "^>", "")
    rows = raw.withColumn("_t", text).where("trim(_t) <> ''")
    rows = rows.select("ord", F.regexp_extract("_t", r"^(\S*)", 1).alias("seq_id"), F.regexp_extract("_t", "^([^\n]*)", 1).alias("description"), F.regexp_replace(F.regexp_replace("_t", "^[^\n]*", ""), r"\s", "").alias("sequence"))
    return rows.groupBy("seq_id").agg(F.max_by(F.struct("description", "ord", "sequence"), "ord").alias("r")).select("seq_id", "r.*")


def pdb_atoms(spark: SparkSession, path: str) -> DataFrame:
    """Lines of ATOM and HETATM by columns: ord, record, atom, resname, chain, resseq, icode, x, y, z, bfactor, model,
    residue (one letter, null for others), value (the line), file. The model is that of the last MODEL line before in
    the same file, 1 without one; a file's lines are read in order by one task, as its format demands."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).withColumn("ord", F.monotonically_increasing_id())
    lines = lines.where("value LIKE 'MODEL %' OR substring(value, 1, 6) IN ('ATOM  ', 'HETATM')")
    number = F.expr("CASE WHEN value LIKE 'MODEL %' THEN try_cast(trim(substring(value, 11, 4)) AS int) END")
    before = Window.partitionBy("file").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    model = F.coalesce(F.last(number, ignorenulls=True).over(before), F.lit(1))
    atoms = lines.withColumn("model", model).where("value NOT LIKE 'MODEL %'")
    letters = F.create_map(*[F.lit(x) for kv in RESIDUES.items() for x in kv])
    part = lambda a, n, kind: F.expr(f"try_cast(trim(substring(value, {a}, {n})) AS {kind})")
    rows = atoms.select(
        "file", "ord", "model", "value", F.trim(F.substring("value", 1, 6)).alias("record"), part(13, 4, "string").alias("atom"), part(18, 3, "string").alias("resname"), part(22, 1, "string").alias("chain"),
        part(23, 4, "int").alias("resseq"), part(27, 1, "string").alias("icode"), part(31, 8, "double").alias("x"), part(39, 8, "double").alias("y"), part(47, 8, "double").alias("z"), part(61, 6, "double").alias("bfactor"),
    )
    return rows.withColumn("residue", letters[F.col("resname")])


def _chain(df: DataFrame) -> list[str]:
    """What names a chain: its letter, and its file where rows have one."""
    return [c for c in ("file", "chain") if c in df.columns]


def pdb_residues(atoms: DataFrame) -> DataFrame:
    """One row per amino acid residue of each file's first model, in order; of differing names the last stays."""
    rows = atoms.where("residue IS NOT NULL AND record = 'ATOM'")
    models = rows.groupBy(*_chain(rows), "resseq", "icode", "model").agg(F.max_by("residue", "ord").alias("residue"), F.min("ord").alias("ord"))
    first = models.groupBy(*_chain(rows)[:-1]).agg(F.min("model").alias("model"))
    return models.join(first, [*_chain(rows)[:-1], "model"]).drop("model")


def chain_sequences(residues: DataFrame) -> DataFrame:
    """file, chain, sequence, and whether the file's structure has that chain only."""
    out = residues.groupBy(*_chain(residues)).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "residue"))), lambda x: x["residue"]), "").alias("sequence"))
    return out.withColumn("monomer", F.count("*").over(Window.partitionBy(*_chain(residues)[:-1])) == 1)


def structure_sites(residues: DataFrame, sequence: str, *, least_score: float = 50.0) -> DataFrame:
    """file, chain, seq_pos (of the sequence, from 1), resseq, icode, residue: the sequence's positions in every chain whose local
    alignment with it scores at least least_score, read off the alignment."""
    keys = _chain(residues)
    one = chain_sequences(residues).select(*keys, F.lit(sequence).alias("_q"), "sequence")
    found = one.withColumn("_t", traced("_q", "sequence")).where(F.col("_t.score") >= least_score)
    pairs = found.select(*keys, F.explode("_t.pairs").alias("_p")).select(*keys, F.col("_p.ref_pos").alias("seq_pos"), F.col("_p.query_pos").alias("_at"))
    placed = residues.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy("ord")))
    return pairs.join(placed, [*keys, "_at"]).select(*keys, "seq_pos", "resseq", "icode", "residue")


def with_bfactor(atoms: DataFrame, scores: DataFrame, *, positive: bool = False) -> DataFrame:
    """PDB lines (ord, mutation if scores have it, value) whose B-factor is the residue's score (scores: resseq, score),
    0 where there is none, rounded to two places in six columns."""
    score = F.abs("score") if positive else F.col("score")
    number = F.lpad(F.format_string("%.2f", F.coalesce(score, F.lit(0.0))), 6, " ")
    joined = atoms.join(scores, "resseq", "left")
    line = F.concat(F.substring("value", 1, 60), number, F.expr("substring(value, 67)"))
    return joined.select("ord", *[c for c in ("mutation",) if c in scores.columns], line.alias("value"))


def site_command(sites: DataFrame, position: str, template: str = "select :{}") -> DataFrame:
    """A viewer command that lists distinct sites in order."""
    return sites.agg(F.concat_ws(",", F.sort_array(F.collect_set(position))).alias("_s")).select(F.format_string(template.replace("{}", "%s"), "_s").alias("command"))


def genbank_features(spark: SparkSession, path: str) -> DataFrame:
    """One row per location part of each CDS and mat_peptide: record, type, gene, product, part, start (0-based), end,
    strand; and the record's sequence. Records end at `//` lines, which part the file. Each part has its own strand;
    parts of a complement of a whole list are numbered in the order in which they are read, the last one first."""
    records = spark.read.option("lineSep", "\n//").text(path).where("value RLIKE 'LOCUS'")
    rec = records.select(
        F.regexp_extract("value", r"LOCUS\s+(\S+)", 1).alias("record"),
        F.upper(F.regexp_replace(F.regexp_extract("value", r"(?s)ORIGIN[^\n]*\n(.*)$", 1), "[^A-Za-z]", "")).alias("origin"),
        F.expr(r"regexp_extract_all(value, '(?s)\\n {5}(\\S+ +\\S(?:[^\\n]|\\n {21})*)', 1)").alias("features"),
    )
    one = rec.select("record", "origin", F.posexplode("features").alias("feature", "text"))
    one = one.withColumn("type", F.regexp_extract("text", r"^(\S+)", 1)).where("type IN ('CDS', 'mat_peptide')")
    squeezed = F.regexp_replace(F.regexp_extract("text", r"(?s)^\S+\s+(.*?)(?:\n\s+/|$)", 1), r"\s", "")
    quality = lambda k: F.expr(f"nullif(regexp_extract(text, '(?s)/{k}=\"([^\"]*)\"', 1), '')")
    one = one.withColumns({"location": squeezed, "gene": quality("gene"), "product": F.regexp_replace(quality("product"), r"\s+", " ")})
    parts = one.select("record", "origin", "feature", "type", "gene", "product", F.expr(r"location RLIKE '^complement[(](join|order)[(]'").alias("_minus"), F.expr(r"regexp_extract_all(location, '((?:complement[(])?[<>]?\\d+(?:\\.\\.[<>]?\\d+)?)', 1)").alias("_parts"))
    rows = parts.select("*", F.posexplode(F.when(F.col("_minus"), F.reverse("_parts")).otherwise(F.col("_parts"))).alias("part", "_span"))
    start = F.regexp_extract("_span", r"(\d+)", 1).cast("int") - 1
    return rows.select("record", "feature", "type", "gene", "product", "part", start.alias("start"), F.regexp_extract("_span", r"(\d+)$", 1).cast("int").alias("end"), F.when(F.col("_minus") | F.col("_span").startswith("complement"), -1).otherwise(1).alias("strand"), "origin")


def written(df: DataFrame, path: str, *, sep: str = ",", append: bool = False) -> None:
    """CSV or TSV with headers, one file a task."""
    df.write.mode("append" if append else "overwrite").option("header", True).option("sep", sep).csv(path)


def bins(df: DataFrame, x: str, y: str, width: float, height: float) -> DataFrame:
    """Counts of a two-dimensional histogram: what a density plot needs."""
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.floor(F.col(x) / width).alias("bx"), F.floor(F.col(y) / height).alias("by")).agg(F.count("*").alias("n"))
