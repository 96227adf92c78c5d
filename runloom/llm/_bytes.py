"""Vectorised views of Arrow string columns: byte buffers, words, lines and range hashes.

All helpers work on a chunk of whole rows: ``buf`` is the UTF-8 of the rows one after another and
``offs`` has the n+1 row boundaries in it.  A range hash is a pair of polynomials modulo the prime 2^31 - 1, each of
randomised byte values at a base of its own, so the hash of any byte range is two lookups in each of two prefix sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_rng = np.random.Generator(np.random.PCG64(20240607))
BYTE_VALUES = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
LOWER_VALUES = BYTE_VALUES.copy()
LOWER_VALUES[65:91] = BYTE_VALUES[97:123]
PRIME = 2**31 - 1
_BASES = [int(x) for x in _rng.integers(2**20, PRIME - 1, 2)]

#: The white space of the word pattern [^\x20\x09-\x0D]+
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
IS_CHAR_START = (np.arange(256) & 0xC0) != 0x80


def _fold(x: np.ndarray) -> np.ndarray:
    """A smaller value that is equal modulo PRIME: under 2^33 for x under 2^64, under 2^31 + 4 for x under 2^33."""
    return (x & np.uint64(PRIME)) + (x >> np.uint64(31))


def _fold_in(x: np.ndarray, spare: np.ndarray, times: int) -> None:
    """_fold() in place, so many times."""
    for _ in range(times):
        np.right_shift(x, np.uint64(31), out=spare)
        np.bitwise_and(x, np.uint64(PRIME), out=x)
        np.add(x, spare, out=x)


class _Powers:
    """Powers of the bases and of their inverses, modulo PRIME."""

    def __init__(self) -> None:
        self.size = 0

    def upto(self, n: int) -> _Powers:
        if self.size < n:
            self.size = max(n, 1 << 16)
            self.up, self.down = ([self._powers(b).astype(np.uint32) for b in bases] for bases in (_BASES, [pow(b, -1, PRIME) for b in _BASES]))
        return self

    def _powers(self, base: int) -> np.ndarray:
        out = np.ones(1, np.uint64)
        while len(out) < self.size:
            out = np.concatenate([out, out * np.uint64(pow(base, len(out), PRIME)) % np.uint64(PRIME)])
        return out


_POWERS = _Powers()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(32)
    return x


def text_chunks(column: pa.Array, limit: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges [lo, hi) of about ``limit`` bytes with their buffer and boundaries; null is empty text.

    A row is never cut: one longer than ``limit`` is a chunk of its own.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1)
        yield lo, hi, raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def prefix_hash(buf: np.ndarray, values: np.ndarray = BYTE_VALUES) -> np.ndarray:
    """Prefix sums from which range_hash() takes the hash of any byte range; texts of up to 2^31 bytes."""
    powers = _POWERS.upto(len(buf) + 1)
    out = np.empty((2, len(buf) + 1), np.uint64)
    out[:, 0] = 0
    x, spare = np.empty((2, len(buf)), np.uint64)
    for lane, up in enumerate(powers.up):
        ((values >> np.uint64(31 * lane)) & np.uint64(PRIME)).take(buf, out=x, mode="clip")
        np.multiply(x, up[: len(buf)], out=x)
        _fold_in(x, spare, 1)
        np.cumsum(x, out=out[lane, 1:])
    return out


def _hash_of(sums: list[np.ndarray], down: list[np.ndarray]) -> np.ndarray:
    """The hash of ranges, of each lane's differences of prefix sums (used up) and inverse powers of where they start."""
    for x, inverse in zip(sums, down, strict=True):
        spare = np.empty(len(x), np.uint64)
        _fold_in(x, spare, 2)
        np.multiply(x, inverse, out=x)
        _fold_in(x, spare, 3)
        np.minimum(x, np.subtract(x, np.uint64(PRIME), out=spare), out=x)  # a smaller one's difference is a large number
    return mix(sums[0] << np.uint64(32) | sums[1])


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return _hash_of([sums[end] - sums[start] for sums in prefix], [down[start] for down in _POWERS.upto(prefix.shape[1]).down])


def gram_hash(prefix: np.ndarray, width: int) -> np.ndarray:
    """range_hash() of every range of ``width``, in order."""
    n = prefix.shape[1] - width
    return _hash_of([sums[width:] - sums[:n] for sums in prefix], [down[:n] for down in _POWERS.upto(prefix.shape[1]).down])


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and per row the number of the first word (n+1 values)."""
    solid = ~IS_SPACE[buf]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    inner = offs[(offs > 0) & (offs < len(buf))]
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def lines(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the \\n-split lines, and per row the number of its first line (n+1 values).

    An empty row has one empty line.
    """
    cuts = np.flatnonzero(buf == 10)
    starts = np.concatenate([offs[:-1], cuts + 1])
    owner = np.concatenate([np.arange(len(offs) - 1), np.searchsorted(offs, cuts, side="right") - 1])
    order = np.lexsort((starts, owner))
    starts, owner = starts[order], owner[order]
    first = np.searchsorted(owner, np.arange(len(offs)))
    ends = np.empty(len(starts), np.int64)
    ends[:-1] = starts[1:] - 1
    ends[first[1:] - 1] = offs[1:]
    return starts, ends, first


def windows_hash(word_hash: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of runs of ``width`` words within a row, the number of their first word, and row boundaries."""
    n = len(word_hash)
    count = np.maximum(np.diff(first) - width + 1, 0)
    bounds = np.concatenate([[0], np.cumsum(count)])
    if not bounds[-1]:
        return np.empty(0, np.uint64), np.empty(0, np.int64), bounds
    h = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        h = h * np.uint64(0x9E3779B97F4A7C15) + word_hash[k : n - width + 1 + k]
    at = np.repeat(first[:-1] - bounds[:-1], count) + np.arange(bounds[-1])
    return mix(h[at]), at, bounds


def repeated(key: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per item: whether an equal key of the same row exists elsewhere, and whether one came before."""
    order = np.lexsort((key, row))
    k, r = key[order], row[order]
    same = (k[1:] == k[:-1]) & (r[1:] == r[:-1])
    twice, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
    twice[order[1:]] = same
    later[order[1:]] = same
    twice[order[:-1]] |= same
    return twice, later


def per_row(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values between boundaries, as int64."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def strings(buf: np.ndarray, offs: np.ndarray) -> list[str]:
    raw = buf.tobytes()
    return [raw[a:b].decode("utf-8", "replace") for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
