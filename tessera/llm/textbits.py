"""Vectorised byte and word hashing shared by the text operators.

Everything works on an Arrow string column as it lies in memory: one flat
``uint8`` buffer and an offsets array.  Chunks of a few hundred kilobytes are handled
at a time, so temporary arrays stay small however long a batch is; a single
longer document simply makes one longer chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 400_000
U64 = np.uint64

#: `[\x20\x09-\x0D]`, the only white space of the word contracts.
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.Generator(np.random.PCG64(0x7E55E7A))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_P = U64(0x9E3779B97F4A7C15)
_Q = U64(0xD6E8FEB86659FD93)
_K1 = U64(0xBF58476D1CE4E5B9)
_K2 = U64(0x94D049BB133111EB)
_powers: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and ``base**-i`` modulo 2**64 for i < n, cached by the power of two above n."""
    size = 1 << max(16, int(n - 1).bit_length() if n > 1 else 1)
    key = (int(base), size)
    if key not in _powers:
        inverse = U64(pow(int(base), -1, 1 << 64))
        both = []
        for b in (base, inverse):
            a = np.full(size, b, dtype=np.uint64)
            a[0] = 1
            both.append(np.multiply.accumulate(a))
        if size > 1 << 21:  # a single giant document: not worth keeping
            return both[0], both[1]
        _powers[key] = (both[0], both[1])
    return _powers[key]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that makes every output bit depend on every input bit."""
    h = h ^ (h >> U64(30))
    h = h * _K1
    h ^= h >> U64(27)
    h *= _K2
    h ^= h >> U64(31)
    return h


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary Arrow array; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_binary())
    column = column.cast(pa.large_string() if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else pa.large_binary())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_large_string(column.type) else b"")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes; a longer row has a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def word_bounds(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the first word of each document (one more entry than documents)."""
    solid = ~WHITE[buf]
    before = np.empty(len(buf), bool)
    after = np.empty(len(buf), bool)
    if len(buf):
        before[0] = False
        before[1:] = solid[:-1]
        after[-1] = False
        after[:-1] = solid[1:]
        inner = offsets[(offsets > 0) & (offsets < len(buf))]
        before[inner] = False
        after[inner - 1] = False
    starts = np.flatnonzero(solid & ~before)
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def byte_prefix(buf: np.ndarray) -> np.ndarray:
    """Prefix sums with which ``span_hash`` gives the hash of any byte span."""
    forward, _ = powers(_P, len(buf) + 1)
    out = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[buf] * forward[: len(buf)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, back = powers(_P, len(prefix))
    return mix((prefix[ends] - prefix[starts]) * back[starts])


def word_hashes(buf: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hash of each word, with ``word_bounds``; ``lower`` folds A-Z only."""
    if lower:
        buf = LOWER[buf]
    starts, ends, first = word_bounds(buf, offsets)
    return span_hash(byte_prefix(buf), starts, ends), starts, ends, first


def window_hashes(words: np.ndarray, length: int, salt: int = 0) -> np.ndarray:
    """Hash of each run of ``length`` consecutive entries of ``words`` (whoever calls drops runs across documents)."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    forward, back = powers(_Q, len(words) + 1)
    prefix = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * forward[: len(words)], out=prefix[1:])
    return mix((prefix[length:] - prefix[:-length]) * back[:n] + U64(salt & (1 << 64) - 1))


def sequence_hash(words: np.ndarray) -> int:
    """Hash of a whole word sequence, salted by its length."""
    return int(window_hashes(words, len(words), 0xA5A5 + len(words))[0]) if len(words) else 0
