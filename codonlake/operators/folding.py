"""Approximate minimum free energy of short RNA windows.

A nearest-neighbour model with published stacking, loop initiation and terminal energies, without the special loop
tables of full folding packages: an approximation, at most 0, and 0 for what does not fold. The dynamic programme
runs over a whole Arrow batch of windows at a time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LONGEST = 90
LEAST_LOOP = 3
#: Windows that are folded at a time.
ROWS = 512
#: Unpaired bases of an interior loop or bulge, as in RNA.fold.
MOST_INTERIOR = 30
#: Fixed values (kcal/mol): Watson-Crick stacks 5'-XY-3' over 3'-X'Y'-5' by their upper strand (Xia et al. 1998).
STACKS = {
    "AA": -0.93, "AU": -1.10, "UA": -1.33, "CU": -2.08, "CA": -2.11, "GU": -2.24, "GA": -2.35, "CG": -2.36, "GG": -3.26, "GC": -3.42,
    "UU": -0.93, "AG": -2.08, "UG": -2.11, "AC": -2.24, "UC": -2.35, "CC": -3.26,
}
WOBBLE_STACK = -1.0
HAIRPIN = {3: 5.4, 4: 5.6, 5: 5.7, 6: 5.4, 7: 6.0, 8: 5.5, 9: 6.4}
BULGE = {1: 3.8, 2: 2.8, 3: 3.2, 4: 3.6, 5: 4.0, 6: 4.4}
INTERIOR = {2: 0.5, 3: 1.6, 4: 1.1, 5: 2.0, 6: 2.0}
TERMINAL = 0.45
BRANCHES, PER_BRANCH = 3.4, 0.4
CODE = {"A": 0, "C": 1, "G": 2, "U": 3}
PAIRED = np.zeros((5, 5), bool)
for _a, _b in ("AU", "UA", "GC", "CG", "GU", "UG"):
    PAIRED[CODE[_a], CODE[_b]] = True
END = np.zeros((5, 5))
for _a, _b in ("AU", "UA", "GU", "UG"):
    END[CODE[_a], CODE[_b]] = TERMINAL


def _grown(table: dict[int, float], n: int) -> float:
    """Loop initiation; beyond the table it grows with the logarithm of the size."""
    top = max(table)
    return table[n] if n in table else table[top] + 1.75 * 0.616 * float(np.log(n / top))


def _stack_table() -> np.ndarray:
    out = np.zeros((5, 5, 5, 5))
    for a in "ACGU":
        for b in "ACGU":
            for c in "ACGU":
                for d in "ACGU":  # pair a-d outside, b-c inside
                    if PAIRED[CODE[a], CODE[d]] and PAIRED[CODE[b], CODE[c]]:
                        plain = a + d in ("AU", "UA", "GC", "CG") and b + c in ("AU", "UA", "GC", "CG")
                        out[CODE[a], CODE[b], CODE[c], CODE[d]] = STACKS[a + b] if plain else WOBBLE_STACK
    return out


STACK = _stack_table()


def _loop_table() -> np.ndarray:
    """Initiation of bulges and interior loops by the unpaired bases on both sides; stacks and bulges of one base are apart."""
    out = np.full((MOST_INTERIOR + 1,) * 2, 1e6)
    for left in range(MOST_INTERIOR + 1):
        for right in range(MOST_INTERIOR + 1 - left):
            size = left + right
            if size > 1:
                out[left, right] = _grown(INTERIOR, size) + min(3.0, 0.6 * abs(left - right)) if left and right else _grown(BULGE, size)
    return out


LOOP = _loop_table()


def fold(codes: np.ndarray) -> np.ndarray:
    """Energies of windows (rows) of codes 0-3; 4 is any symbol that pairs with nothing."""
    rows, n = codes.shape
    high = 1e6
    pair = np.full((n + 1, n + 1, rows), high)  # i and j pair
    ended = np.full((n + 1, n + 1, rows), high)  # the same with the cost of its end
    multi = np.full((n + 1, n + 1, rows), high)  # at least one branch in i..j
    turned = np.full((n + 1, n + 1, rows), high)  # the same by (j, i)
    for span in range(LEAST_LOOP + 1, n):
        for i in range(n - span):
            j = i + span
            a, b = codes[:, i], codes[:, j]
            can = PAIRED[a, b]
            end = END[a, b]
            if can.any():
                low = _grown(HAIRPIN, span - 1) + end
                c, d = codes[:, i + 1], codes[:, j - 1]
                low = np.minimum(low, pair[i + 1, j - 1] + STACK[a, c, d, b])
                for k, m in ((i + 2, j - 1), (i + 1, j - 2)):
                    low = np.minimum(low, pair[k, m] + _grown(BULGE, 1) + STACK[a, codes[:, k], codes[:, m], b])
                loop = np.full(rows, high)
                most = min(MOST_INTERIOR, span - LEAST_LOOP - 3)  # bases that an inner pair leaves over
                for left in range(most + 1):
                    k, far = i + left + 1, most - left  # right sides 0..far
                    inner = ended[k, j - 1 - far : j][::-1]
                    np.minimum(loop, (inner + LOOP[left, : far + 1, None]).min(0), out=loop)
                low = np.minimum(low, loop + end)
                first, last = i + LEAST_LOOP + 3, j - LEAST_LOOP - 1  # where a second branch begins
                if first < last:
                    low = np.minimum(low, (multi[i + 1, first - 1 : last - 1] + turned[j - 1, first:last]).min(0) + BRANCHES + PER_BRANCH + end)
                pair[i, j] = np.where(can, low, high)
                ended[i, j] = pair[i, j] + end
            branch = pair[i, j] + PER_BRANCH + end
            branch = np.minimum(branch, np.minimum(multi[i + 1, j], multi[i, j - 1]))
            first, last = i + LEAST_LOOP + 2, j - LEAST_LOOP
            if first < last:
                branch = np.minimum(branch, (multi[i, first - 1 : last - 1] + turned[j, first:last]).min(0))
            multi[i, j] = turned[j, i] = branch
    # the whole window: the best of closing each pair against what lies before it
    total = np.zeros((n + 1, rows))
    for j in range(n):
        low = total[j]
        for i in range(j - LEAST_LOOP):
            low = np.minimum(low, total[i] + pair[i, j] + END[codes[:, i], codes[:, j]])
        total[j + 1] = low
    return np.minimum(total[n], 0.0)


_LOOKUP = np.full(256, 4, np.int8)
for _s, _v in (("A", 0), ("C", 1), ("G", 2), ("U", 3), ("T", 3)):
    _LOOKUP[ord(_s)] = _v


def energies(windows: pd.Series) -> pd.Series:
    """Energies of a batch; null for a null or empty window; equal windows are folded once, padded at the end."""
    texts = {w.upper() for w in windows if isinstance(w, str) and w}
    if any(len(w) > LONGEST for w in texts):
        raise ValueError(f"windows of more than {LONGEST} bases are not folded")
    found: dict[str, float] = {}
    ordered = sorted(texts, key=len)
    for at in range(0, len(ordered), ROWS):
        part = ordered[at : at + ROWS]
        codes = np.full((len(part), len(part[-1])), 4, np.int8)
        for i, w in enumerate(part):
            codes[i, : len(w)] = _LOOKUP[np.frombuffer(w.encode("ascii", "replace"), np.uint8)]
        found |= dict(zip(part, fold(codes).round(2).tolist(), strict=True))
    return pd.Series([found[w.upper()] if isinstance(w, str) and w else None for w in windows], index=windows.index, dtype="float64")


def mfe(window: Column) -> Column:
    return F.pandas_udf(energies, "double")(window)
