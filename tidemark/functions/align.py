"""Global alignment of nucleotide sequences with affine gaps, as a pandas UDF.

There is no built-in for it. Each row is independent; a row's tables take one byte a cell.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Scores of equal and different bases, and a gap's cost of GAP_OPEN + n * GAP_EXTEND.
MATCH, MISMATCH, GAP_OPEN, GAP_EXTEND = 5, -4, 4, 1
_LOW = -(1 << 40)


def alignment_ops(sequence: str, reference: str) -> str:
    """One letter a column: M both, I in the sequence only, D in the reference only. From the end, ties go to I, then D, then M."""
    s, r = np.frombuffer(sequence.upper().encode(), np.uint8), np.frombuffer(reference.upper().encode(), np.uint8)
    n, m = len(s), len(r)
    # came[i, j]: bit 0-1 best state (0 I, 1 D, 2 M), bit 2 an I extends, bit 3 a D extends.
    came = np.zeros((n + 1, m + 1), np.uint8)
    best = np.full(m + 1, _LOW, np.int64)
    ins = np.full(m + 1, _LOW, np.int64)
    best[0] = 0
    best[1:] = -GAP_OPEN - GAP_EXTEND * np.arange(1, m + 1)
    came[0, 1:] = 1 | 8
    came[0, 1:2] = 1
    steps = np.arange(m + 1, dtype=np.int64) * GAP_EXTEND
    for i in range(1, n + 1):
        opened, extended = best - GAP_OPEN - GAP_EXTEND, ins - GAP_EXTEND
        ins = np.maximum(opened, extended)
        diagonal = np.full(m + 1, _LOW, np.int64)
        diagonal[1:] = best[:-1] + np.where(r == s[i - 1], MATCH, MISMATCH)
        base = np.maximum(ins, diagonal)
        # A gap in the sequence never profits from opening behind another such gap, so one running maximum gives all.
        run = np.maximum.accumulate(base + steps)
        dele = np.full(m + 1, _LOW, np.int64)
        dele[1:] = run[:-1] - GAP_OPEN - steps[1:]
        best = np.maximum(base, dele)
        state = np.where(ins == best, 0, np.where(dele == best, 1, 2)).astype(np.uint8)
        longer = np.zeros(m + 1, np.uint8)
        longer[2:] = (dele[2:] == dele[1:-1] - GAP_EXTEND) * 8
        came[i] = state | (extended >= opened) * 4 | longer
    ops, i, j, held = [], n, m, None
    while i or j:
        cell = came[i, j]
        kind = held if held is not None else int(cell & 3)
        if i == 0:
            kind = 1
        elif j == 0:
            kind = 0
        if kind == 0:
            ops.append("I")
            held = 0 if cell & 4 else None
            i -= 1
        elif kind == 1:
            ops.append("D")
            held = 1 if cell & 8 else None
            j -= 1
        else:
            ops.append("M")
            held = None
            i, j = i - 1, j - 1
    return "".join(reversed(ops))


def run_lengths(ops: str) -> str:
    out, at = [], 0
    for k in range(1, len(ops) + 1):
        if k == len(ops) or ops[k] != ops[at]:
            out.append(f"{k - at}{ops[at]}")
            at = k
    return "".join(out)


def cigar(sequence: str | None, reference: str | None) -> str | None:
    return None if sequence is None or reference is None else run_lengths(alignment_ops(sequence, reference))


def align_cigar(sequence: Column, reference: Column) -> Column:
    """The run-length string of the global alignment of two columns; null if one is null."""

    @F.pandas_udf(T.StringType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([cigar(x, y) for x, y in zip(a, b)])

    return run(sequence, reference)


def score_of(sequence: str, reference: str, runs: str) -> int:
    """What an alignment given by its run-length string scores; a gap that runs through both kinds counts as two."""
    total, i, j = 0, 0, 0
    for n, op in ((int(n), op) for n, op in re.findall(r"([0-9]+)([MID])", runs)):
        if op == "M":
            total += sum(MATCH if a == b else MISMATCH for a, b in zip(sequence.upper()[i : i + n], reference.upper()[j : j + n]))
            i, j = i + n, j + n
        else:
            total -= GAP_OPEN + n * GAP_EXTEND
            i, j = i + n * (op == "I"), j + n * (op == "D")
    return total


def alignment_score(sequence: Column, reference: Column, runs: Column) -> Column:
    """The score of an alignment (a run-length string) of two columns; null if one is null."""

    @F.pandas_udf(T.LongType())
    def run(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None or z is None else score_of(x, y, z) for x, y, z in zip(a, b, c)], dtype="Int64")

    return run(sequence, reference, runs)
