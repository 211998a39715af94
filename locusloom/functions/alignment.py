"""Pairwise alignment with affine gaps, and what is read off it. Dynamic programming has no DataFrame form, so
each pair is aligned in an Arrow batch; nothing is exchanged.

match 1, mismatch 0; a gap of n costs open + (n - 1) * extend. Of equal optima the traceback prefers a
pair, then a gap in the query, then a gap in the reference, from the end."""

from __future__ import annotations

from string import ascii_uppercase

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

_NONE = -1e18


def align(ref: str, query: str, mode: str = "global", open_gap: float = -10.0, extend_gap: float = -0.5) -> tuple[float, str, str]:
    """Score and both sequences with gaps; local mode gives the aligned parts only."""
    return located(ref, query, mode, open_gap, extend_gap)[:3]


def located(ref: str, query: str, mode: str = "global", open_gap: float = -10.0, extend_gap: float = -0.5) -> tuple[float, str, str, int, int]:
    """align, and how many letters of either sequence lie before the aligned parts."""
    n, m = len(ref), len(query)
    a, b = (np.frombuffer(s.encode("utf-32-le"), np.uint32) for s in (ref, query))
    local = mode == "local"
    pair, up, left = (np.full((n + 1, m + 1), _NONE) for _ in range(3))
    pair[0, 0] = 0.0
    if local:
        pair[:, 0] = pair[0, :] = 0.0
    else:
        up[1:, 0] = open_gap + extend_gap * np.arange(n)
        left[0, 1:] = open_gap + extend_gap * np.arange(m)
    steps = extend_gap * np.arange(m + 1)
    for i in range(1, n + 1):
        best = np.maximum(np.maximum(pair[i - 1], up[i - 1]), left[i - 1])
        pair[i, 1:] = best[:-1] + (b == a[i - 1])
        if local:
            pair[i, 1:] = np.maximum(pair[i, 1:], 0.0)
        up[i, 1:] = np.maximum(np.maximum(pair[i - 1, 1:], left[i - 1, 1:]) + open_gap, up[i - 1, 1:] + extend_gap)
        opened = np.maximum(pair[i], up[i]) + open_gap - steps
        left[i, 1:] = np.maximum.accumulate(opened[:-1])[: m] + steps[:-1]
    best = np.maximum(np.maximum(pair, up), left)
    i, j = np.unravel_index(int(np.argmax(pair)), pair.shape) if local else (n, m)
    score = float(pair[i, j] if local else best[i, j])
    state = 0 if local or pair[i, j] == best[i, j] else 1 if up[i, j] == best[i, j] else 2
    x, y = [], []
    while i or j:
        if state == 0:
            if local and pair[i, j] <= 0:
                break
            x.append(ref[i - 1])
            y.append(query[j - 1])
            i, j = i - 1, j - 1
            options = (pair[i, j], up[i, j], left[i, j])
        elif state == 1:
            x.append(ref[i - 1])
            y.append("-")
            here, i = up[i, j], i - 1
            options = tuple(v if abs(v + c - here) < 1e-9 else _NONE for v, c in ((pair[i, j], open_gap), (up[i, j], extend_gap), (left[i, j], open_gap)))
        else:
            x.append("-")
            y.append(query[j - 1])
            here, j = left[i, j], j - 1
            options = tuple(v if abs(v + c - here) < 1e-9 else _NONE for v, c in ((pair[i, j], open_gap), (up[i, j], open_gap), (left[i, j], extend_gap)))
        if not (i or j):
            break
        state = int(np.argmax(options))
        if not local:  # at a border only gaps are left; a local alignment ends there
            state = 2 if i == 0 else 1 if j == 0 else state
    return score, "".join(reversed(x)), "".join(reversed(y)), int(i), int(j)


def numbering(query: str, ref: str, signal: int = 16, ha2_start: int | None = None) -> list[tuple[int, str]]:
    """Canonical labels of the query's positions (0-based): the reference's signal peptide is `SP-15` .. `SP0`, mature
    positions count from 1, and from ha2_start on `HA2:1` ..; insertions take the last label, without capitals at its
    end, with A, B, ... (characters after Z follow as they are coded); the suffix counts all earlier labels that start
    with the base and are longer; a query gap advances the mature count but not the HA2 count."""
    _, x, y = align(ref, query)
    out: list[tuple[int, str]] = []
    labels: list[str] = []
    at = mature = ha2 = used = 0
    for r, q in zip(x, y, strict=True):
        if r != "-":
            used += 1
            if used <= signal:
                label = f"SP{used - signal}" if used < signal else "SP0"
            else:
                mature += 1
                in_ha2 = ha2_start is not None and mature >= ha2_start
                if in_ha2 and q != "-":
                    ha2 += 1
                label = f"HA2:{ha2}" if in_ha2 else str(mature)
            if q == "-":
                continue
        elif not labels:
            label = "N-term-Insert"
        else:
            base = labels[-1].rstrip(ascii_uppercase)
            label = base + chr(ord("A") + sum(k.startswith(base) and k != base for k in labels))
        out.append((at, label))
        labels.append(label)
        at += 1
    return out


def aligned(ref: str, query: str, mode: str = "global"):
    """A column (score, ref, query) of the aligned pair; null if either is null."""

    @F.pandas_udf("score double, ref string, query string")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = [align(x, y, mode) if isinstance(x, str) and isinstance(y, str) else (None, None, None) for x, y in zip(a, b, strict=True)]
        return pd.DataFrame(rows, columns=["score", "ref", "query"])

    return run(F.col(ref), F.col(query))


def traced(ref: str, query: str, mode: str = "local"):
    """A column (score, pairs of positions (ref_pos, query_pos), from 1, that are aligned letter to letter)."""

    @F.pandas_udf("score double, pairs array<struct<ref_pos: int, query_pos: int>>")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        out = []
        for r, q in zip(a, b, strict=True):
            if not (isinstance(r, str) and isinstance(q, str)):
                out.append((None, None))
                continue
            score, x, y, i, j = located(r, q, mode)
            pairs = []
            for u, v in zip(x, y, strict=True):
                i, j = i + (u != "-"), j + (v != "-")
                if u != "-" and v != "-":
                    pairs.append({"ref_pos": i, "query_pos": j})
            out.append((score, pairs))
        return pd.DataFrame(out, columns=["score", "pairs"])

    return run(F.col(ref), F.col(query))


def numbered(query: str, ref: str, signal: int = 16, ha2_start: int | None = None):
    """An array column of (query_pos, label); null if either is null."""

    @F.pandas_udf("array<struct<query_pos: int, label: string>>")
    def run(q: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series([[{"query_pos": p, "label": t} for p, t in numbering(x, y, signal, ha2_start)] if isinstance(x, str) and isinstance(y, str) else None for x, y in zip(q, r, strict=True)])

    return run(F.col(query), F.col(ref))
