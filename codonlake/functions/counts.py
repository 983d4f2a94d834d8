"""Counts of words over a batch of sequences, in one pass: kernels on Arrow strings, for Arrow UDFs.

Words are counted without overlap, from the left. All places of a batch are turned into word numbers at once and counted
into a table (row, word). Only words that overlap themselves (XXX, XYX, ...) need more: their places are taken by chains
in which each begins inside the one before. Where the steps of a chain are all d (runs of one base, of one pair), every
ceil(k / d)-th place of it counts; the rare chains of mixed steps, from four letters on, are walked.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words up to this length have a table; 4 ** k columns a row.
LONGEST = 6
#: Characters that are worked on at a time, whatever the size of a batch; a longer row is a slice of its own.
SLICE = 1 << 18


def encoded(column: pa.Array, letters: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of each letter, others len(letters); where each row begins, and the last ends; characters of each row).

    A character beyond ASCII counts as one that is no letter. Null rows are empty.
    """
    column = column.cast(pa.large_string()).fill_null("")
    if not pc.all(pc.string_is_ascii(column), min_count=0).as_py():
        column = pc.replace_substring_regex(column, r"[^\x00-\x7F]", "?")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    table = np.full(256, len(letters), np.uint8)
    table[np.frombuffer(letters.encode(), np.uint8)] = np.arange(len(letters))
    codes = table[np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]]] if data is not None else np.zeros(0, np.uint8)
    return codes, bounds - bounds[0], np.diff(bounds)


def slices(column: pa.Array) -> Iterator[pa.Array]:
    """The column in parts of about SLICE bytes, in order."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes, dtype=np.int64) // SLICE
    bounds = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(column)]
    for a, b in zip(bounds, bounds[1:]):  # noqa: B905
        if b > a:
            yield column.slice(a, b - a)


def word_numbers(codes: np.ndarray, bounds: np.ndarray, k: int, letters: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, row, number) of all words of k letters, in order; words never cross rows."""
    n = len(codes) - k + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    number = np.zeros(n, np.int64)
    good = np.ones(n, bool)
    for j in range(k):
        one = codes[j : j + n]
        number = number * letters + one
        good &= one < letters
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    place = np.flatnonzero(good & (row[:n] == row[k - 1 :]))
    return place, row[place], number[place]


def overlapping(k: int, letters: int) -> np.ndarray:
    """Which words of k letters overlap themselves."""
    return np.array([any(w[p:] == w[:-p] for p in range(1, k)) for w in product(range(letters), repeat=k)])


def word_counts(column: pa.Array, k: int, letters: str) -> tuple[np.ndarray, np.ndarray]:
    """(rows x words) counts without overlap, words in the order of `letters`, and the characters of each row."""
    if not 1 <= k <= LONGEST:
        raise ValueError(f"words of {k} letters; a table has 1 to {LONGEST}")
    codes, bounds, sizes = encoded(column, letters)
    place, row, number = word_numbers(codes, bounds, k, len(letters))
    words = len(letters) ** k
    selfish = overlapping(k, len(letters))[number]
    key = row * words + number
    counts = np.bincount(key[~selfish], minlength=len(column) * words)
    if selfish.any():
        key, place = key[selfish], place[selfish]
        order = np.argsort(key, kind="stable")
        key, place = key[order], place[order]
        step = np.diff(place)
        first = np.flatnonzero(np.concatenate([[True], (np.diff(key) != 0) | (step >= k)]))
        length = np.diff(first, append=len(key))
        inner = np.append(step, 0)
        inner[np.append(first[1:], len(key)) - 1] = 0  # the step out of a chain
        largest = np.maximum.reduceat(inner, first)
        every = -(-k // np.maximum(largest, 1))
        picked = np.where(length > 1, -(-length // every), 1)
        mixed = np.flatnonzero(np.add.reduceat(inner, first) != largest * (length - 1))
        for c in mixed.tolist():
            free, n = -1, 0
            for p in place[first[c] : first[c] + length[c]].tolist():
                if p >= free:
                    free, n = p + k, n + 1
            picked[c] = n
        counts += np.bincount(key[first], picked, minlength=len(counts)).astype(counts.dtype)
    return counts.reshape(len(column), words), sizes


def frequencies(column: pa.Array, k: int, letters: str) -> pa.Array:
    """Lists of count / (characters - k + 1); null for shorter and null rows."""
    out = []
    for part in slices(column):
        counts, sizes = word_counts(part, k, letters)
        with np.errstate(divide="ignore", invalid="ignore"):
            shares = counts / (sizes - (k - 1))[:, None]
        out.append(listed(shares, (sizes < k) | np.asarray(part.is_null()), pa.float64()))
    return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.float64()))


def codons_in_frame(column: pa.Array, order: list[str], letters: str) -> pa.Array:
    """Lists of how often each codon of `order` stands in frame from the start; null for null rows."""
    parts = [_codons(part, order, letters) for part in slices(column)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))


def _codons(column: pa.Array, order: list[str], letters: str) -> pa.Array:
    codes, bounds, sizes = encoded(column, letters)
    base = len(letters) + 1
    row = np.repeat(np.arange(len(sizes)), sizes // 3)
    start = bounds[:-1][row] + 3 * (np.arange(len(row)) - np.repeat(np.cumsum(sizes // 3) - sizes // 3, sizes // 3))
    wide = codes.astype(np.int64)
    number = (wide[start] * base + wide[start + 1]) * base + wide[start + 2]
    column_of = np.full(base**3, len(order))
    column_of[[(letters.index(a) * base + letters.index(b)) * base + letters.index(c) for a, b, c in order]] = np.arange(len(order))
    counts = np.bincount(row * (len(order) + 1) + column_of[number], minlength=len(sizes) * (len(order) + 1)).reshape(len(sizes), -1)[:, :-1]
    return listed(counts, np.asarray(column.is_null()), pa.int32())


def listed(values: np.ndarray, empty: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The rows of a table as lists, null where `empty` says so."""
    n, width = values.shape
    offsets = pa.array(np.arange(n + 1, dtype=np.int32) * width, pa.int32())
    lists = pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(values).ravel()).cast(kind))
    return pc.if_else(pa.array(empty, pa.bool_()), pa.scalar(None, lists.type), lists)
