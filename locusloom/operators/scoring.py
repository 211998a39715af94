"""Scoring of variants against references by a pluggable model: the composite operators over model_output's metrics.

A model is scorer(): called once per task, it gives a function from a list of sequences to (embedding, logits) of
each; logits are one row per token of the sequence (a letter, or `<mask>`), one column per entry of `tokens`. A
sequence's output stays in its row and all metrics are array expressions on it, so output, the bulky part, is never
shuffled; only metrics are joined back.

Defined results: a null sequence has null metrics; equal pairs are scored once; a residue outside `tokens` counts
as `<unk>`, and makes sums null if `tokens` has none."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as seq

Scorer = Callable[[], Callable[[list[str]], Iterable[tuple[np.ndarray, np.ndarray]]]]
#: References are broadcast up to this size of their output in bytes; larger sets are joined by key.
BROADCAST_BYTES = 64 << 20
#: Sequences a model sees at once, which bounds a batch of output.
CHUNK = 16
_SUM = "aggregate({}, 0D, (s, v) -> s + v)"


def modelled(rows: DataFrame, of: str, scorer: Scorer) -> DataFrame:
    """rows with embedding and logp (log-softmax, an array per token) of the sequences in column `of`."""
    names = rows.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = scorer()
        for b in batches:
            for at in range(0, len(b), CHUNK):
                part = b.iloc[at : at + CHUNK].reset_index(drop=True)
                known = [i for i, s in enumerate(part[of]) if isinstance(s, str)]
                found: list = [(None, None)] * len(part)
                for i, (embedding, logits) in zip(known, model([part[of][i] for i in known]) if known else (), strict=True):
                    z = np.asarray(logits, np.float64)
                    z = z - z.max(1, keepdims=True) if z.size else z
                    found[i] = (np.asarray(embedding, np.float64), list(z - np.log(np.exp(z).sum(1, keepdims=True))) if z.size else [])
                yield part.assign(embedding=pd.Series([x[0] for x in found], dtype=object), logp=pd.Series([x[1] for x in found], dtype=object))[[*names, "embedding", "logp"]]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(run, f"{schema}, embedding array<double>, logp array<array<double>>")


def letters(s: str) -> str:
    return f"regexp_extract_all({s}, '<[a-z]+>|.', 0)"


def _column(tokens: Sequence[str], letter: str) -> str:
    first = {t: i for i, t in reversed(list(enumerate(tokens)))}
    entries = ", ".join(f"'{t}', {i}" for t, i in first.items())
    return f"coalesce(try_element_at(map({entries}), {letter}), {first.get('<unk>', -1)})"


def own(tokens: Sequence[str], s: str, logp: str) -> str:
    """The log-probability of each own residue, as SQL."""
    return f"transform({letters(s)}, (c, i) -> get(get({logp}, i), {_column(tokens, 'c')}))"


def site_entropy(logp: str) -> Column:
    """Entropy of each site over the whole vocabulary, natural log, probabilities clamped at 1e-9."""
    return F.expr(f"transform({logp}, r -> -aggregate(r, 0D, (s, v) -> s + exp(v) * ln(greatest(exp(v), 1e-9D))))")


def _without(values: str, places: str) -> str:
    return _SUM.format(f"transform({values}, (v, i) -> CASE WHEN array_contains({places}, i) THEN 0D ELSE v END)")


def sequences(rows: DataFrame, s: str, scorer: Scorer, tokens: Sequence[str]) -> DataFrame:
    """rows with embedding, logp and sequence_grammaticality of each sequence."""
    return modelled(rows, s, scorer).withColumn("sequence_grammaticality", F.expr(_SUM.format(own(tokens, s, "logp"))))


def _with_references(rows: DataFrame, scorer: Scorer, tokens: Sequence[str]) -> DataFrame:
    """rows with r_embedding and r_logp of their references, each scored once."""
    refs = rows.select("reference").where("reference IS NOT NULL").distinct()
    size = refs.agg(F.coalesce(F.sum(F.length("reference")), F.lit(0))).first()[0] * len(tokens) * 8
    out = modelled(refs, "reference", scorer).withColumnsRenamed({"embedding": "r_embedding", "logp": "r_logp"})
    return rows.join(F.broadcast(out) if size <= BROADCAST_BYTES else out, "reference", "left")


def against_reference(pairs: DataFrame, scorer: Scorer, tokens: Sequence[str], *, per_site: bool = False, ungapped: bool = False, scored_indels: bool = False) -> DataFrame:
    """pairs (reference, sequence, any more) with all metrics. Differences are column-numbered, so both are of equal
    length. The model sees the reference with the substitutions alone; with `ungapped` the sequence itself
    without gaps and trailing stop; `scored_indels` (with ungapped) leaves out what needs columns."""
    unique = pairs.select("reference", "sequence").distinct()
    present = F.col("sequence").isNotNull()
    unique = unique.withColumn("labels", F.when(present, F.array().cast("array<string>") if scored_indels else seq.diff_labels("reference", "sequence")))
    unique = unique.withColumn("seen", seq.ungapped("sequence") if ungapped else seq.mutate("reference", "labels"))
    rows = _with_references(modelled(unique, "seen", scorer), scorer, tokens)
    # materialised as arrays of numbers once; the wide output ends here
    rows = rows.withColumns({
        "subs": F.expr("filter(labels, m -> NOT (contains(m, 'ins') OR contains(m, 'del') OR contains(m, 'X')))"),
        "kept": F.expr("filter(labels, m -> NOT contains(m, 'del'))"),
        "own": F.expr(own(tokens, "seen" if ungapped else "sequence", "logp")),
        "r_own": F.expr(own(tokens, "reference", "r_logp")),
    })
    place = "int(substring(m, 2, length(m) - 2)) - 1"
    at = f"transform(kept, m -> {place})"

    def summed(letter: str) -> str:
        return _SUM.format(f"transform(subs, m -> get(get(r_logp, {place}), {_column(tokens, letter)}))")

    whole, r_whole = _SUM.format("own"), _SUM.format("r_own")
    metrics = {"semantic_score": seq.l1("r_embedding", "embedding"), "sequence_grammaticality": F.expr(whole), "relative_sequence_grammaticality": F.expr(f"{whole} - {r_whole}")}
    if not scored_indels:
        metrics |= {"grammaticality": F.expr(summed("right(m, 1)")), "relative_grammaticality": F.expr(f"{summed('right(m, 1)')} - {summed('left(m, 1)')}"), "probability": F.exp(F.expr(summed("right(m, 1)")))}
    if not (ungapped or scored_indels):
        metrics |= {
            "narrow_sequence_grammaticality": F.expr(_without("own", at)),
            "relative_narrow_sequence_grammaticality": F.expr(f"{_without('own', at)} - {_without('r_own', at)}"),
            "mutation_count": F.expr("size(kept)"),
            "mutations": F.expr("array_join(kept, ', ')"),
            "deletions": F.expr("array_join(filter(labels, m -> contains(m, 'del')), ', ')"),
        }
    if per_site:
        metrics |= {"entropy": site_entropy("logp"), "sequence_probabilities": F.expr("transform(own, v -> exp(v))")}
    found = rows.select(F.col("reference").alias("_r"), F.col("sequence").alias("_s"), *[c.alias(k) for k, c in metrics.items()])
    out = pairs.join(found, F.col("reference").eqNullSafe(F.col("_r")) & F.col("sequence").eqNullSafe(F.col("_s")), "left")
    return out.drop("_r", "_s")


def scan(references: DataFrame, scorer: Scorer, tokens: Sequence[str], *, start: int = 0, end: int | None = None) -> DataFrame:
    """Deep mutational scan of each row's `reference`: all metrics of every variant."""
    variants = seq.expanded(references, "reference", start=start, end=end).withColumnRenamed("variant", "sequence")
    return against_reference(variants, scorer, tokens)


def masked_scan(references: DataFrame, scorer: Scorer, tokens: Sequence[str], *, start: int = 0, end: int | None = None, mask: bool = True) -> DataFrame:
    """The scan with each variant's own view of its site, and that of a model that doesn't see the site: semantic score,
    sequence grammaticality, and (relative) grammaticality and probability by the reference's, the variant's and
    the masked output. Without masks the masked metrics are null."""
    ids = references.columns
    variants = seq.expanded(references, "reference", start=start, end=end, mask=mask)
    rows = _with_references(modelled(variants, "variant", scorer), scorer, tokens)

    def cell(logp: str, letter: str) -> str:
        return f"get(get({logp}, pos - 1), {_column(tokens, letter)})"

    rows = rows.select(
        *ids, "pos", "ref", "alt", "label", seq.l1("r_embedding", "embedding").alias("semantic_score"),
        F.expr(_SUM.format(own(tokens, "variant", "logp"))).alias("sequence_grammaticality"), F.expr(_SUM.format(own(tokens, "reference", "r_logp"))).alias("_r_whole"),
        F.expr(cell("r_logp", "alt")).alias("grammaticality"), F.expr(cell("r_logp", "ref")).alias("_r_ref"), F.expr(cell("logp", "alt")).alias("mutated_grammaticality"),
        F.expr("CASE WHEN alt = '<mask>' THEN get(logp, pos - 1) END").alias("_site"),
    )
    # a site's variants meet: 21 rows at most for each distinct reference
    sites = rows.where("alt = '<mask>'").dropDuplicates(["reference", "pos"]).select("reference", "pos", F.col("_site").alias("_hidden"))
    out = rows.where("alt <> '<mask>'").drop("_site").join(sites, ["reference", "pos"], "left")
    out = out.withColumn("masked_grammaticality", F.expr(f"get(_hidden, {_column(tokens, 'alt')})"))
    less = {f"relative_{k}": F.col(k) - F.col("_r_ref") for k in ("grammaticality", "mutated_grammaticality", "masked_grammaticality")}
    odds = {k.replace("grammaticality", "probability"): F.exp(k) for k in ("grammaticality", "mutated_grammaticality", "masked_grammaticality")}
    return out.withColumns({**less, **odds, "relative_sequence_grammaticality": F.col("sequence_grammaticality") - F.col("_r_whole")}).drop("_r_ref", "_r_whole", "_hidden")


def backbone_pairs(backbones: DataFrame, target: str, numbering: DataFrame | None = None) -> DataFrame:
    """(backbone, mutation, canon, reference, sequence) of each substitution that leads from a backbone (id, sequence; all
    aligned) to the target, put on that backbone alone. numbering (pos, canonical) renames positions."""
    rows = backbones.select(F.col("id").alias("backbone"), F.col("sequence").alias("_b"), F.lit(target).alias("_t"))
    leads = F.filter(seq.diff_labels("_b", "_t"), lambda m: ~m.contains("del") & ~m.contains("-"))
    rows = rows.withColumn("mutation", F.explode(leads))
    rows = rows.withColumn("_m", F.array("mutation")).withColumn("sequence", F.replace(seq.mutate("_b", "_m"), F.lit("-"), F.lit(""))).withColumn("reference", F.expr("replace(_b, '-', '')"))
    if numbering is None:
        return rows.select("backbone", "mutation", F.col("mutation").alias("canon"), "reference", "sequence")
    placed = rows.withColumn("pos", F.expr("int(regexp_extract(mutation, '[0-9]+', 0))")).join(numbering.select("pos", "canonical"), "pos", "left")
    return placed.select("backbone", "mutation", seq.canonical_label("mutation", "canonical").alias("canon"), "reference", "sequence")


def pairwise_backbones(sequence: DataFrame, labels: str = "labels") -> DataFrame:
    """Each mutation of a row's `labels` on the row's `sequence` (backbone `Reference`) and on every other mutation's point
    mutant: n mutations give n * n rows, of one list at a time; lists of two rows never meet."""
    out = sequence.withColumn("mutation", F.explode(labels)).withColumn("backbone", F.explode(F.expr(f"concat({labels}, array('Reference'))"))).where("mutation <> backbone")
    out = out.withColumn("_on", F.expr("CASE WHEN backbone <> 'Reference' THEN array(backbone) ELSE array() END")).withColumn("_base", seq.mutate("sequence", "_on"))
    out = out.withColumn("_m", F.array("mutation")).withColumn("_v", seq.mutate("_base", "_m"))
    keep = [c for c in sequence.columns if c not in ("sequence", labels)]
    return out.select(*keep, "backbone", "mutation", F.expr("replace(_base, '-', '')").alias("reference"), F.expr("replace(_v, '-', '')").alias("sequence"))


def epistatic_ranking(cells: DataFrame, reference: str, lineages: Sequence[str], *, mutation: str = "canon", lineage: str = "lineage", value: str = "probability") -> DataFrame:
    """One row per mutation that the reference lineage has too: <lineage>_shift, largest absolute, largest and smallest
    shift, genomic_position. Of repeated cells the smallest value counts."""
    wide = cells.groupBy(mutation).pivot(lineage, list(lineages)).agg(F.min(value))
    shifts = {f"{k}_shift": F.col(f"`{k}`") - F.col(f"`{reference}`") for k in lineages}
    out = wide.where(F.col(f"`{reference}`").isNotNull()).select(mutation, *[c.alias(k) for k, c in shifts.items()])
    all_of = F.array(*[F.col(f"`{k}`") for k in shifts])
    return out.withColumns({"max_abs_shift": F.array_max(F.transform(all_of, F.abs)), "max_shift": F.array_max(all_of), "min_shift": F.array_min(all_of), "genomic_position": seq.sort_position(mutation)})


def strongest_pairs(cells: DataFrame, reference: str, *, mutation: str = "canon", lineage: str = "lineage", value: str = "probability") -> DataFrame:
    """For each mutation the lineage that shifts it most, the shift, and both values; ties to the first name."""
    one = cells.where(F.col(value).isNotNull()).groupBy(mutation, lineage).agg(F.min(value).alias("_v"))
    base = one.where(F.col(lineage) == reference).select(mutation, F.col("_v").alias("ref_probability"))
    rows = one.join(base, mutation).withColumn("_shift", F.col("_v") - F.col("ref_probability"))
    best = F.min_by(F.struct(F.col(lineage).alias("strongest_backbone"), F.col("_shift").alias("probability_shift"), "ref_probability", F.col("_v").alias("new_probability")), F.struct(-F.abs("_shift"), lineage))
    return rows.groupBy(mutation).agg(best.alias("_b")).select(mutation, "_b.*")


def site_table(outputs: DataFrame, mutations: DataFrame, tokens: Sequence[str]) -> DataFrame:
    """A row per mutation (seq_id, mutation, prob_mutation) on its sequence (outputs: seq_id, sequence, logp): own probability
    and its ascending rank, entropy, the largest other probability and its descending rank, and the percentage of
    non-reference cells below the mutation's. Ranks break ties by position. A site whose residue is none of the
    20 blanks the cell of the last standard residue before it, as published tables do."""
    aa = seq.AMINO_ACIDS
    place = f"nullif(instr('{aa}', c), 0)"
    cells = ", ".join(f"exp(get(r, {_column(tokens, repr(a))}))" for a in aa)
    rows = outputs.select("seq_id", F.expr(letters("sequence")).alias("_c"), F.expr(f"transform(logp, r -> array({cells}))").alias("_p"), F.expr(f"transform({own(tokens, 'sequence', 'logp')}, v -> exp(v))").alias("_own"), site_entropy("logp").alias("_h"))
    rows = rows.withColumn("_i", F.expr(f"transform(_c, c -> {place})"))
    rows = rows.withColumns({
        "_top": F.expr("transform(_p, (p, i) -> array_max(filter(p, (v, k) -> NOT (k + 1 <=> get(_i, i)))))"),
        "_blank": F.expr("transform(_i, (x, i) -> coalesce(x, try_element_at(filter(slice(_i, 1, i + 1), y -> y IS NOT NULL), -1)))"),
    })
    rows = rows.withColumn("_cells", F.expr("flatten(transform(_p, (p, i) -> filter(p, (v, k) -> NOT (k + 1 <=> get(_blank, i)))))")).drop("_p", "_c", "_i", "_blank")
    out = mutations.join(rows, "seq_id").withColumn("position", F.expr("int(regexp_extract(mutation, '[0-9]+', 0))"))
    at = "position - 1"
    return out.select(
        "seq_id", "mutation", "position", "prob_mutation", F.expr(f"get(_own, {at})").alias("probability_reference"), F.expr(f"get(_h, {at})").alias("entropy"),
        F.expr(f"1 + size(filter(_own, (v, i) -> v < get(_own, {at}) OR (v = get(_own, {at}) AND i < {at})))").alias("reference_probability_rank"),
        F.expr(f"get(_top, {at})").alias("max_non_reference_probability"),
        F.expr(f"1 + size(filter(_top, (v, i) -> v > get(_top, {at}) OR (v = get(_top, {at}) AND i < {at})))").alias("rank_max_non_reference"),
        F.expr("100D * size(filter(_cells, v -> v < prob_mutation)) / size(_cells)").alias("probability_percentile"),
    )
