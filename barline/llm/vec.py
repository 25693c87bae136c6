"""Vectorised numpy primitives on text: word bounds, rolling 64-bit hashes, n-grams.

Hashes are polynomial in a fixed odd base modulo 2**64 over a pseudo-random table of
the symbols, finished by a bijective mixer.  They depend on content only, never on the
position, the batch or the machine.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

U64 = np.uint64
CHUNK = 1 << 18


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser (xor-shift and multiply)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@lru_cache(maxsize=8)
def byte_codes(seed: int) -> np.ndarray:
    return mix64((np.arange(256, dtype=U64) + U64(1 + 1000 * seed)) * U64(0x9E3779B97F4A7C15))


def _base(seed: int) -> int:
    return int(mix64(np.array([seed + 77], dtype=U64))[0]) | 1


@lru_cache(maxsize=8)
def powers(seed: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below ``size``."""
    base = _base(seed)
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.ones(size, dtype=U64)
        filled, step = 1, b
        while filled < size:
            m = min(filled, size - filled)
            p[filled : filled + m] = p[:m] * U64(step)
            filled += m
            step = step * step % (1 << 64)
        out.append(p)
    return out[0], out[1]


class Rolling:
    """Hashes of any slice of a sequence of 64-bit symbol codes, in O(1) each."""

    def __init__(self, codes: np.ndarray, seed: int):
        n = len(codes)
        size = 1 << max(12, int(n).bit_length())
        up, self.down = powers(seed, size)
        self.sums = np.zeros(n + 1, dtype=U64)
        np.cumsum(codes * up[:n], out=self.sums[1:])

    def slices(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sums[end] - self.sums[start]) * self.down[start]
        return mix64(raw + (end - start).astype(U64) * U64(0x9E3779B97F4A7C15))

    def windows(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        if n <= 0:
            return np.zeros(0, dtype=U64)
        return mix64((self.sums[k:] - self.sums[:n]) * self.down[:n])


SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Bytes outside words made of letters, digits and everything beyond ASCII.
NON_WORD = np.zeros(256, dtype=bool)
NON_WORD[0x00:0x30] = True
NON_WORD[0x3A:0x61] = True
NON_WORD[0x7B:0x80] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def word_bounds(buf: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end (exclusive) of every maximal run of bytes not in ``sep``."""
    flag = np.zeros(len(buf) + 2, dtype=np.int8)
    flag[1:-1] = ~sep[buf]
    d = np.diff(flag)
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


def whole(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return start, end


def word_hashes(buf: np.ndarray, sep: np.ndarray, seed: int = 1, views=(whole,)):
    """Hash, start and end of every word of a byte buffer of any length.  With several ``views``
    (functions from bounds to bounds inside the word) the hashes have a column for each."""
    starts, ends = word_bounds(buf, sep)
    hashes = np.zeros((len(starts), len(views)), dtype=U64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + CHUNK, side="right")))
        lo, hi = int(starts[at]), int(ends[to - 1])
        roll = Rolling(byte_codes(seed)[buf[lo:hi]], seed)
        for k, view in enumerate(views):
            s, e = view(starts[at:to] - lo, ends[at:to] - lo)
            hashes[at:to, k] = roll.slices(s, e)
        at = to
    return (hashes[:, 0] if len(views) == 1 else hashes), starts, ends


def chunks(sizes: np.ndarray, limit: int = CHUNK):
    """Slices (from, to) of consecutive items whose sizes sum to ``limit`` at most; an item
    beyond the limit stands alone."""
    at, n = 0, len(sizes)
    total = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    while at < n:
        to = max(at + 1, int(np.searchsorted(total, total[at] + limit, side="right")) - 1)
        yield at, to
        at = to


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of an Arrow string column; a null text is empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    buf = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]]
    return buf, off - off[0]


def segment_words(sep_starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For words sorted by start and texts given by offsets: index of the first word of each text,
    and the number of words at the end."""
    return np.searchsorted(sep_starts, offsets)


def spaced(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a blank before each, so that no word spans two texts; their new offsets."""
    n = len(offsets) - 1
    out = np.full(len(buf) + n, 0x20, dtype=np.uint8)
    out[np.arange(len(buf)) + np.repeat(np.arange(1, n + 1), np.diff(offsets))] = buf
    return out, offsets + np.arange(n + 1)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, in two passes over blocks."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    rows = -(-len(x) // width)
    pad = np.full(rows * width, np.iinfo(x.dtype).max, dtype=x.dtype)
    pad[: len(x)] = x
    block = pad.reshape(rows, width)
    before = np.minimum.accumulate(block, axis=1).ravel()
    after = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[width - 1 : width - 1 + n])


def pack(*columns: np.ndarray) -> bytes:
    """64-bit columns of equal length as compressed bytes."""
    import pyarrow as pa

    data = np.stack([np.asarray(c).view(U64) for c in columns])
    return len(columns).to_bytes(1, "little") + data.shape[1].to_bytes(4, "little") + pa.compress(data.tobytes(), codec="zstd", asbytes=True)


def unpack(blob: bytes) -> np.ndarray:
    """Columns (rows of the array) of what ``pack`` made."""
    import pyarrow as pa

    k, n = blob[0], int.from_bytes(blob[1:5], "little")
    raw = pa.decompress(blob[5:], decompressed_size=8 * k * n, codec="zstd", asbytes=True)
    return np.frombuffer(raw, dtype=U64).reshape(k, n)


def bounds_of(*keys: np.ndarray) -> np.ndarray:
    """Starts of the groups of equal keys in sorted columns, and the length at the end."""
    n = len(keys[0])
    if n == 0:
        return np.zeros(1, dtype=np.int64)
    new = np.zeros(n, dtype=bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.append(np.flatnonzero(new), n)
