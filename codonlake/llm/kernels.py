"""Vectorised work on Arrow text columns: words, hashes and minima over a whole batch at a time."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text that one vectorised step takes (a single longer document is one step).
STEP = 1 << 20
_RNG = np.random.default_rng(20240229)
BYTE = _RNG.integers(1, 2**63, 256, dtype=np.int64).astype(U) | U(1)
BASE = U(0x9E3779B97F4A7C15)
INVERSE = U(pow(int(BASE), -1, 2**64))

LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32
#: Words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ : digits, a-z and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
#: Words [^\x20\x09-\x0D]+
SPACED = np.ones(256, bool)
SPACED[9:14] = SPACED[32] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def text_steps(column: pa.Array, step: int = STEP) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of rows of about `step` bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    bytes_ = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + step, "right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end, bytes_[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the number of words before each document (one more entry than documents)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = kind[data]
    edge = np.empty(len(data), bool)
    edge[0] = True
    np.not_equal(inside[1:], inside[:-1], out=edge[1:])
    first = edge.copy()
    first[offsets[:-1][offsets[:-1] < len(data)]] = True  # words never cross documents
    starts = np.flatnonzero(first & inside)
    last = np.empty(len(data), bool)
    last[-1] = True
    last[:-1] = first[1:]
    ends = np.flatnonzero(last & inside) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        m = max(n, STEP + 1)
        up, down = np.empty(m, U), np.empty(m, U)
        for out, b in ((up, BASE), (down, INVERSE)):
            out[0] = 1
            done, step = 1, b
            while done < m:
                take = min(done, m - done)
                out[done : done + take] = out[:take] * step
                done += take
                step = step * step
        _POWERS["up"], _POWERS["down"] = up, down
    return _POWERS["up"][:n], _POWERS["down"][:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each span's bytes, for spans of up to a few hundred bytes; spans may overlap.

    Modulo 2**64 some texts of 1024 bytes and more over two letters collide whatever the base; words have their own hash.
    """
    if not len(starts):
        return np.zeros(0, U)
    with np.errstate(over="ignore"):
        up, down = powers(len(data) + 1)
        sums = np.empty(len(data) + 1, U)
        sums[0] = 0
        np.cumsum(BYTE[data] * up[: len(data)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * down[starts])


#: Bytes up to which a word is hashed eight bytes a step; longer ones by a digest.
LONG_WORD = 64
_FIRST_BYTES = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=object).astype(U)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, the same wherever the word stands: eight bytes a step, mixed after each."""
    if not len(starts):
        return np.zeros(0, U)
    sizes = ends - starts
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))  # the eight bytes from each place on
    out = mix(sizes.astype(U) ^ BASE)
    left, at, rest = np.flatnonzero(sizes <= LONG_WORD), starts, sizes
    if len(left) < len(sizes):
        at, rest = at[left], rest[left]
        for i in np.flatnonzero(sizes > LONG_WORD).tolist():
            out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    with np.errstate(over="ignore"):
        while len(left):
            out[left] = mix(out[left] * U(0xD6E8FEB86659FD93) ^ (eight[at] & _FIRST_BYTES[np.minimum(rest, 8)]))
            more = rest > 8
            left, at, rest = left[more], at[more] + 8, rest[more] - 8
    return out


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k consecutive word hashes; documents' bounds are the caller's care."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    with np.errstate(over="ignore"):
        out = np.zeros(n, U)
        for i in range(k):
            out = out * U(0xD6E8FEB86659FD93) + hashes[i : i + n]
        return mix(out + U(k))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive entries."""
    span = 1
    while span * 2 <= w:
        x = np.minimum(x[:-span], x[span:]) if len(x) > span else x[:0]
        span *= 2
    if span < w:
        rest = w - span
        x = np.minimum(x[:-rest], x[rest:]) if len(x) > rest else x[:0]
    return x


def winnow(h: np.ndarray, w: int) -> np.ndarray:
    """Positions that are the minimum (ties all count) of some window of w entries; of a shorter row, of the whole row."""
    if not len(h):
        return np.zeros(0, np.int64)
    w = min(w, len(h))
    low = sliding_min(h, w)
    padded = np.zeros(len(low) + 2 * (w - 1), h.dtype)
    padded[w - 1 : w - 1 + len(low)] = low
    high = np.iinfo(h.dtype).max
    best = high - sliding_min(high - padded, w)  # the largest of the minima of the windows that hold the position
    return np.flatnonzero(best == h)
