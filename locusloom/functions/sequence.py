"""Sequence algebra as Spark expressions. Arguments are SQL expressions (column names); positions count from 1.

A mutation label is ref, position, alt (`A12T`); labels that hold `ins`, `del` or `X` are no substitutions
and are skipped by mutate and revert. Nulls give nulls, empty strings give empty results."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

AMINO_ACIDS = "ARNDCQEGHILKMFPSTWYV"
#: The standard genetic code, codons in the order TCAG, and the ambiguity letters of nucleotides.
GENETIC_CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
AMBIGUOUS = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}
_SUBSTITUTION = "NOT (contains(m, 'ins') OR contains(m, 'del') OR contains(m, 'X'))"
_POSITION = "int(substring(m, 2, length(m) - 2))"


def _written(seq: str, labels: str, letter: str) -> Column:
    put = f"concat(substring(s, 1, {_POSITION} - 1), {letter}, substring(s, {_POSITION} + 1))"
    return F.expr(f"aggregate(filter({labels}, m -> {_SUBSTITUTION}), {seq}, (s, m) -> {put})")


def mutate(seq: str, labels: str) -> Column:
    """Writes each label's alt, left to right; a position past the end appends; refs aren't checked."""
    return _written(seq, labels, "right(m, 1)")


def revert(seq: str, labels: str) -> Column:
    """Writes each label's ref."""
    return _written(seq, labels, "left(m, 1)")


def _columns(a: str, b: str, kept: str, label: str) -> Column:
    """Labels of those columns c (c.i from 0, letters c.x and c.y) of aligned sequences that are `kept`; k is a column's
    place among these. Each sequence is parted into letters once, so the work is linear in its length."""
    pairs = f"zip_with(split({a}, ''), split(substring({b}, 1, length({a})), ''), (x, y) -> struct(x, coalesce(y, '') AS y))"
    columns = f"transform({pairs}, (p, i) -> struct(i, p.x AS x, p.y AS y))"
    found = f"filter(transform(filter({columns}, c -> {kept}), (c, k) -> {label}), t -> t IS NOT NULL)"
    return F.expr(f"CASE WHEN length({a}) > 0 THEN {found} WHEN {a} IS NOT NULL THEN array() END")


def diff_labels(a: str, b: str) -> Column:
    """Column-numbered differences of aligned sequences: `A12T`, `A12del`, and `-12A` for a gap in a."""
    return _columns(a, b, "c.x <> c.y", "concat(c.x, c.i + 1, CASE WHEN c.y = '-' THEN 'del' ELSE c.y END)")


#: Where only columns with a letter of a are kept, a column's place among them is its number without gaps.
_LETTER = "c.x <> '-'"


def substitutions(a: str, b: str) -> Column:
    return _columns(a, b, _LETTER, "CASE WHEN c.x <> c.y AND c.y <> '-' THEN concat(c.x, k + 1, c.y) END")


def insertions(a: str, b: str) -> Column:
    """Numbered by the letters of a before them, plus one: all columns before that aren't gaps."""
    return _columns(a, b, "c.x = '-'", "CASE WHEN c.y <> '-' THEN concat('ins', c.i - k + 1, c.y) END")


def deletions(a: str, b: str) -> Column:
    return _columns(a, b, _LETTER, "CASE WHEN c.y = '-' THEN concat('del', k + 1) END")


def reference_diff(a: str, b: str) -> Column:
    """Numbered by the letters of a; columns where a has a gap are skipped; a gap in b is `D4-`."""
    return _columns(a, b, _LETTER, "CASE WHEN c.x <> c.y THEN concat(c.x, k + 1, c.y) END")


def _codon_table() -> str:
    """The residue of each of 15 ** 3 codons over the ambiguity letters; X where expansions differ."""
    code = dict(zip(map("".join, product("TCAG", repeat=3)), GENETIC_CODE, strict=True))
    merged = {frozenset("DN"): "B", frozenset("EQ"): "Z", frozenset("IL"): "J"}
    out = []
    for codon in product(AMBIGUOUS, repeat=3):
        residues = frozenset(code["".join(c)] for c in product(*(AMBIGUOUS[x] for x in codon)))
        out.append(next(iter(residues)) if len(residues) == 1 else merged.get(residues, "X"))
    return "".join(out)


def translate(seq: str, to_stop: bool = False) -> Column:
    """Codons to residues. `?` is N, U is T, `---` is `-`, a codon with some gaps X; one or two trailing letters
    are ignored; to_stop ends before the first `*`."""
    letters = "".join(AMBIGUOUS)
    clean = f"replace(replace(upper({seq}), '?', 'N'), 'U', 'T')"
    k = [f"instr('{letters}', substring(c, {j}, 1))" for j in (1, 2, 3)]
    one = f"CASE WHEN c = '---' THEN '-' WHEN {' * '.join(k)} = 0 THEN 'X' ELSE substring('{_codon_table()}', ({k[0]} - 1) * 225 + ({k[1]} - 1) * 15 + {k[2]}, 1) END"
    codons = f"transform(sequence(0, length({seq}) div 3 - 1), i -> substring({clean}, 3 * i + 1, 3))"
    whole = f"CASE WHEN length({seq}) >= 3 THEN array_join(transform({codons}, c -> {one}), '') WHEN {seq} IS NOT NULL THEN '' END"
    return F.expr(f"split_part({whole}, '*', 1)" if to_stop else whole)


def reverse_complement(seq: str) -> Column:
    return F.expr(f"reverse(translate(upper({seq}), 'ACGTRYSWKMBDHVN', 'TGCAYRSWMKVHDBN'))")


def expanded(df, seq: str, *, start: int = 0, end: int | None = None, mask: bool = False):
    """Deep mutational scan: each row of df with pos, alt, label and variant for all 20 residues (the own one too,
    and `<mask>` if asked) at each site of the 0-based inclusive range."""
    stop = f"length({seq})" if end is None else f"least(length({seq}), {end + 1})"
    alts = F.array(*map(F.lit, [*AMINO_ACIDS, "<mask>"] if mask else AMINO_ACIDS))
    sites = df.withColumn("pos", F.explode(F.expr(f"CASE WHEN {stop} > {start} THEN sequence({start + 1}, {stop}) END"))).withColumn("alt", F.explode(alts))
    ref = f"substring({seq}, pos, 1)"
    return sites.withColumns({"ref": F.expr(ref), "label": F.expr(f"concat({ref}, pos, alt)"), "variant": F.expr(f"concat(substring({seq}, 1, pos - 1), alt, substring({seq}, pos + 1))")})


def parsed_label(label: str) -> dict[str, Column]:
    """ref, pos, alt, kind of `A12T`, `A12del`, `ins5K`, `del4`, `A12<mask>`."""
    kind = F.expr(f"CASE WHEN {label} RLIKE '^ins[0-9]+' THEN 'insertion' WHEN {label} RLIKE 'del' THEN 'deletion' WHEN {label} RLIKE '<mask>$' THEN 'mask' WHEN {label} RLIKE '^[A-Z*-][0-9]+[A-Z*-]$' THEN 'substitution' END")
    return {
        "ref": F.expr(f"nullif(regexp_extract({label}, '^([A-Z*-])[0-9]', 1), '')"),
        "pos": F.expr(f"try_cast(nullif(regexp_extract({label}, '[0-9]+', 0), '') AS int)"),
        "alt": F.expr(f"nullif(regexp_extract({label}, '[0-9]([A-Z*-]|<mask>)$', 1), '')"),
        "kind": kind,
    }


def canonical_label(label: str, mapped_to: str) -> Column:
    """`A145K` with its position replaced by the canonical one; an `HA2:` prefix moves to the front; labels
    without a canonical position, or of another form, stay."""
    parts = [f"regexp_extract({label}, '([A-Z*-])([0-9]+)([A-Z*-])', {g})" for g in (1, 3)]
    return F.expr(f"CASE WHEN {mapped_to} IS NULL OR {parts[0]} = '' THEN {label} WHEN {mapped_to} LIKE 'HA2:%' THEN concat('HA2:', {parts[0]}, substring({mapped_to}, 5), {parts[1]}) ELSE concat({parts[0]}, {mapped_to}, {parts[1]}) END")


def sort_position(label: str) -> Column:
    """Order of canonical labels: HA2 after 10000, SP below 0, else the number, 0 without one."""
    n = f"coalesce(try_cast(nullif(regexp_extract({label}, '[0-9]+', 0), '') AS int), 0)"
    ha2 = f"coalesce(try_cast(nullif(regexp_extract({label}, 'HA2:[A-Z*-]?([0-9]+)', 1), '') AS int), 0)"
    return F.expr(f"CASE WHEN {label} LIKE 'HA2:%' THEN 10000 + {ha2} WHEN {label} LIKE 'SP%' THEN -{n} ELSE {n} END")


def cumulative_path(seq: str, steps: str) -> Column:
    """The sequence after the first, the first two, ... of an array of label arrays."""
    inner = f"aggregate(flatten(slice({steps}, 1, k)), {seq}, (s, m) -> CASE WHEN {_SUBSTITUTION} THEN concat(substring(s, 1, {_POSITION} - 1), right(m, 1), substring(s, {_POSITION} + 1)) ELSE s END)"
    return F.expr(f"CASE WHEN size({steps}) > 0 THEN transform(sequence(1, size({steps})), k -> {inner}) ELSE array() END")


def ungapped(seq: str) -> Column:
    """Without gaps and trailing stops."""
    return F.expr(f"replace(regexp_replace({seq}, '[*]+$', ''), '-', '')")


def header_field(header: str, at: int) -> Column:
    """A field of a header parted by bars; -1 is the last."""
    return F.expr(f"try_element_at(split({header}, '[|]'), {at + 1 if at >= 0 else at})")


def l1(a: str, b: str) -> Column:
    """Semantic change: the sum of absolute differences of two vectors, in double precision."""
    return F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> abs(double(x) - double(y))), 0D, (s, v) -> s + v)")


def outside(value: str, lo: float, hi: float) -> Column:
    """The value where it lies outside [lo, hi], else null."""
    return F.expr(f"CASE WHEN {value} < {lo} OR {value} > {hi} THEN {value} END")
