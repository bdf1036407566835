"""Shingle hashes of texts, a batch of Arrow buffers at a time.

Words are runs of ASCII letters and digits, lower case; a shingle is ``k`` words in a row, or all words of a text that has fewer.
Two hashes of a shingle: ``md5`` is the first 60 bits of the digest of its words joined by a space, which any system
computes; ``rolling`` is a polynomial over hashes of the words modulo 2**64, from prefix sums, so a shingle costs the
same whatever ``k`` is.  As column expressions over arrays each shingle would be cut, joined and converted as a text of its own, some
twenty times slower (README).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

U64 = np.uint64
# Fixed: bases of the polynomials over bytes and over words; both odd, so they have inverses. The finaliser is splitmix64's.
BYTE_BASE, WORD_BASE = 0x100000001B3, 0x9E3779B97F4A7C15
FINAL = ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, None))
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123)]] = True
_HASHES = pa.list_(pa.int64())


def words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word of lower-cased bytes."""
    inside = np.concatenate([[False], _WORD[np.frombuffer(raw, np.uint8)], [False]]).astype(np.int8)
    edge = np.flatnonzero(np.diff(inside))
    return edge[::2], edge[1::2]


def final(x: np.ndarray) -> np.ndarray:
    for shift, factor in FINAL:
        x = x ^ (x >> U64(shift))
        if factor:
            x = x * U64(factor)
    return x


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base & (1 << 64) - 1, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """Powers of ``base``; those of texts up to a few megabytes are kept."""
    if n > 1 << 22:
        return powers(base, n)
    if base not in _POWERS or len(_POWERS[base]) < n:
        _POWERS[base] = powers(base, 1 << max(16, n.bit_length()))
    return _POWERS[base]


def spans(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """``sum(values[j] * base ** (end - 1 - j))`` of each span, from one prefix sum."""
    n = len(values)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(values * _power(pow(base, -1, 1 << 64), n)[:n], out=prefix[1:])
    return (prefix[end] - prefix[start]) * _power(base, n + 1)[np.maximum(end - 1, 0)]


def runs(word: np.ndarray, k: int) -> np.ndarray:
    """The shingle hashes of ``rolling`` from the hashes of words in a row."""
    if not len(word):
        return np.zeros(0, np.int64)
    m = min(k, len(word))
    first = np.arange(len(word) - m + 1)
    return (final(spans(word, first, first + m, WORD_BASE)) >> U64(1)).astype(np.int64)


def rolling(raw: bytes, k: int) -> np.ndarray:
    start, end = words(raw)
    return runs(final(spans(np.frombuffer(raw, np.uint8).astype(np.uint64), start, end, BYTE_BASE)), k) if len(start) else np.zeros(0, np.int64)


def md5(raw: bytes, k: int) -> np.ndarray:
    start, end = words(raw)
    if not len(start):
        return np.zeros(0, np.int64)
    m = min(k, len(start))
    size = end - start
    joined = b" ".join(raw[a:z] for a, z in zip(start.tolist(), end.tolist(), strict=True))
    at = np.cumsum(size + 1) - size - 1
    last = at + size
    digest = hashlib.md5
    heads = b"".join(digest(joined[a:z]).digest()[:8] for a, z in zip(at[: len(at) - m + 1].tolist(), last[m - 1 :].tolist(), strict=True))
    return (np.frombuffer(heads, ">u8") >> U64(4)).astype(np.int64)


#: Shifts and addends of the rounds of MD5, and what is kept of a word of a block, and set in it, by how many bytes of the message (-1 to 4) it holds.
_SHIFT = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
_SINE = np.floor(np.abs(np.sin(np.arange(1, 65))) * 2**32).astype(np.uint32)
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_KEEP = np.array([0, 0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)
_STOP = np.array([0, 0x80, 0x8000, 0x800000, 0x80000000, 0], np.uint32)
#: Messages hashed at once (a few hundred kilobytes of state); the longest that is one block; bytes of text joined at once.
_ROWS, _BLOCK, _JOINED = 16384, 55, 1 << 20


def _heads(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The first 60 bits of MD5 of ``data[at : at + size]``, all of at most ``_BLOCK`` bytes, round by round for many at a time; 64 bytes follow the last in ``data``."""
    quads = np.lib.stride_tricks.as_strided(data.view(np.uint8)[:4].view("<u4"), (len(data) - 3,), (1,))
    out = np.empty(len(at), np.int64)
    # by length, so that most words of a block are whole for all of its messages, or are for none
    order = np.argsort(size.astype(np.uint8), kind="stable")
    for low in range(0, len(at), _ROWS):
        rows = order[low : low + _ROWS]
        begin, length = at[rows], size[rows]
        least, most = int(length[0]), int(length[-1])
        block: list[np.ndarray | None] = []
        for w in range(14):
            if 4 * w + 4 <= least:
                block.append(quads[begin + 4 * w])
            elif 4 * w <= most:
                held = np.clip(length - 4 * w, -1, 4) + 1
                block.append(quads[begin + 4 * w] & _KEEP[held] | _STOP[held])
            else:
                block.append(None)
        block += [(length * 8).astype(np.uint32), None]
        a, b, c, d = (np.full(len(begin), x, np.uint32) for x in _START)
        f, g = np.empty_like(a), np.empty_like(a)
        for i in range(64):
            if i < 16:
                np.bitwise_xor(c, d, out=f)
                f &= b
                f ^= d
                word = i
            elif i < 32:
                np.bitwise_xor(b, c, out=f)
                f &= d
                f ^= c
                word = (5 * i + 1) % 16
            elif i < 48:
                np.bitwise_xor(b, c, out=f)
                f ^= d
                word = (3 * i + 5) % 16
            else:
                np.invert(d, out=f)
                f |= b
                f ^= c
                word = 7 * i % 16
            f += a
            if block[word] is not None:
                f += block[word]
            f += _SINE[i]
            np.right_shift(f, np.uint32(32 - _SHIFT[i]), out=g)
            f <<= np.uint32(_SHIFT[i])
            f |= g
            f += b
            a, b, c, d, f = d, f, b, c, a
        first, second = ((x + np.uint32(s)).byteswap().astype(np.uint64) for x, s in ((a, _START[0]), (b, _START[1])))
        out[rows] = ((first << U64(32) | second) >> U64(4)).astype(np.int64)
    return out


def md5s(raws: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """What ``md5`` gives for each text, one after the other, and how many each has. Texts of about ``_JOINED`` bytes are hashed together."""
    found, n, at = [], np.zeros(len(raws), np.int64), 0
    total = np.cumsum([len(x) for x in raws])
    while at < len(raws):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + _JOINED, "right")))
        hashes, n[at:end] = _joined(raws[at:end], k)
        found.append(hashes)
        at = end
    return (np.concatenate(found) if found else np.zeros(0, np.int64)), n


def _joined(raws: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    # a null byte is no word's, so none goes on into the next text
    raw = np.frombuffer(b"\0".join([*raws, b""]), np.uint8)
    start, end = words(raw.tobytes())
    bounds = np.cumsum([len(x) + 1 for x in raws])
    upto = np.searchsorted(start, bounds)
    count = np.diff(upto, prepend=0)
    m = np.minimum(count, k)
    n = np.where(count > 0, count - m + 1, 0)
    if not len(start):
        return np.zeros(0, np.int64), n
    # words in a row with a space after each, from the byte behind a word
    inside = _WORD[raw]
    inside[end] = True
    text = raw.copy()
    text[end] = 32
    text = np.append(text[inside], np.zeros(64, np.uint8))
    length = end - start
    begin = np.cumsum(length + 1) - length - 1
    first = np.arange(n.sum()) + np.repeat(upto - count - np.cumsum(n) + n, n)
    last = first + np.repeat(m, n) - 1
    at = begin[first]
    size = begin[last] + length[last] - at
    short = size <= _BLOCK
    out = np.empty(len(at), np.int64)
    out[short] = _heads(text, at[short], size[short])
    for i in np.flatnonzero(~short).tolist():
        out[i] = int.from_bytes(hashlib.md5(text[at[i] : at[i] + size[i]].tobytes()).digest()[:8], "big") >> 4
    return out, n


KINDS = {"md5": md5, "rolling": rolling}


def _each(texts: pa.Array, k: int, kind: str = "md5") -> Iterator[np.ndarray]:
    """The shingle hashes of each text."""
    raws = [x.as_py().encode() for x in texts]
    if kind == "md5":
        found, n = md5s(raws, k)
        yield from np.split(found, np.cumsum(n)[:-1]) if len(raws) else ()
    else:
        yield from (KINDS[kind](raw, k) for raw in raws)


def minima(h: np.ndarray, window: int) -> np.ndarray:
    """Distinct minima of each window; of a list of at most ``window`` its one minimum."""
    if not len(h):
        return h
    step, wide = 1, min(window, len(h))
    while step * 2 <= wide:
        h = np.minimum(h[:-step], h[step:])
        step *= 2
    if rest := wide - step:
        h = np.minimum(h[:-rest], h[rest:])
    return np.unique(h)


def _column(text: Column, k: int, kind: str, one: Callable[[np.ndarray], np.ndarray]) -> Column:
    @F.arrow_udf(returnType=ArrayType(LongType()))
    def hashes(texts: pa.Array) -> pa.Array:
        found = [one(h) for h in _each(texts, k, kind)]
        offsets = np.cumsum([0, *map(len, found)])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64)))

    return hashes(F.lower(F.coalesce(text, F.lit(""))))


def shingle_hashes(text: Column, k: int, kind: str = "md5") -> Column:
    """Distinct shingle hashes, ascending; of a null text none."""
    return _column(text, k, kind, np.unique)


def winnowed(text: Column, k: int, window: int, kind: str = "md5") -> Column:
    """Distinct minima of each window of shingle hashes."""
    return _column(text, k, kind, lambda h: minima(h, window))


def sketch(text: Column, k: int, size: int, kind: str = "md5") -> Column:
    """The ``size`` smallest distinct shingle hashes, ascending."""
    return _column(text, k, kind, lambda h: np.unique(h)[:size])


def set_batches(batches: Iterable[pa.RecordBatch], k: int, rows: int = 1024, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The keys, number and list of the distinct shingle hashes of each row of ``keys..., text``; no more than ``rows``, or about ``most`` bytes of text, are held at a time."""
    for batch in batches:
        text = batch.column(batch.num_columns - 1)
        total = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            end = min(at + rows, max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right"))))
            part = batch.slice(at, end - at)
            found = [np.unique(h) for h in _each(part.column(part.num_columns - 1), k)]
            n = np.array([len(x) for x in found], np.int64)
            hs = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(np.concatenate(found)))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(n), hs], [*batch.schema.names[:-1], "n", "hs"])
            at = end


#: Bits of the map of reference hashes, a power of two: a megabyte, whatever the reference has.
MAP_BITS = 1 << 23


def hash_map(reference: DataFrame) -> np.ndarray:
    """A bitmap of ``MAP_BITS`` by the last bits of the hashes ``h`` of ``reference``: where a bit is not set, no row has the hash."""
    mask, word = MAP_BITS - 1, F.expr(f"cast(shiftrightunsigned(h & {MAP_BITS - 1}, 6) as int)")
    rows = reference.filter("h is not null").groupBy(word.alias("word")).agg(F.expr(f"bit_or(shiftleft(1L, cast(h & {mask} & 63 as int)))").alias("bits")).toPandas()
    out = np.zeros(MAP_BITS // 64, np.int64)
    out[rows["word"].to_numpy(int)] = rows["bits"].to_numpy(np.int64)
    return out.view(U64)


def marked_batches(batches: Iterable[pa.RecordBatch], k: int, size: int, bits: np.ndarray, rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """``path, met, small`` of rows of ``path, text``: the distinct hashes that ``bits`` does not rule out, and the ``size`` smallest, ascending."""
    lists = lambda found: pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.array(np.concatenate(found)))
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            found = [np.unique(h) for h in _each(part.column(1), k)]
            low = [h.view(U64) & U64(len(bits) * 64 - 1) for h in found]
            met = [h[bits[x >> U64(6)] >> (x & U64(63)) & U64(1) == 1] for h, x in zip(found, low, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), lists(met), lists([h[:size] for h in found])], ["path", "met", "small"])


def least_batches(batches: Iterable[pa.RecordBatch], size: int, ordered: bool, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Rows of ``directory, s`` (never null) with the ``size`` smallest distinct values of a directory; about ``most`` values are held at a time.

    A directory has one row if its rows follow each other (``ordered``), else few.
    """
    held: list[pa.RecordBatch] = []
    values = 0

    def merged() -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).combine_chunks()
        names = whole.column(0).combine_chunks().dictionary_encode()
        lists = whole.column(1).combine_chunks()
        code = np.repeat(names.indices.to_numpy(zero_copy_only=False), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        h = lists.flatten().to_numpy(zero_copy_only=False)
        order = np.lexsort((h, code))
        code, h = code[order], h[order]
        new = np.append(True, (code[1:] != code[:-1]) | (h[1:] != h[:-1]))[: len(h)]
        code, h = code[new], h[new]
        place = np.arange(len(h)) - np.searchsorted(code, code)
        code, h = code[place < size], h[place < size]
        ends = np.searchsorted(code, np.arange(len(names.dictionary) + 1))
        return pa.RecordBatch.from_arrays([names.dictionary, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(h))], ["directory", "s"])

    for batch in batches:
        held.append(pa.RecordBatch.from_arrays(batch.columns, ["directory", "s"]))
        values += len(batch.column(1).flatten())
        if values > most:
            held = [merged()]
            values = len(held[0].column(1).flatten())
            if values > most // 2:
                whole = held.pop()
                # the last one may go on in the next batch
                keep = 1 if ordered else 0
                yield whole.slice(0, whole.num_rows - keep)
                held = [whole.slice(whole.num_rows - keep)] if keep else []
                values = len(held[0].column(1).flatten()) if keep else 0
    if held:
        yield merged()
