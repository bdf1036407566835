"""Counts over whole texts, a chunk of documents at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tessera.llm.textbits import U64, WHITE, byte_prefix, chunks, flat, mix, span_hash, window_hashes, word_bounds

SYMBOLS = b"#*$%&|<>"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"!?\"'(),-./:;[]_{}~=+@^`\\")] = True
COUNTS = ("n_bytes", "n_chars", "n_words", "word_chars", "n_symbols", "n_upper", "n_digits", "n_marks", "n_exclaims", "n_lines", "n_dup_lines", "n_distinct_words", "n_repeat_words", "n_alone")
SCHEMA = ", ".join(f"{c} long" for c in COUNTS)


def _per_document(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.searchsorted(np.flatnonzero(mask), offsets))


def _distinct(keys: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Distinct keys of each of ``n`` owners."""
    if not len(keys):
        return np.zeros(n, np.int64)
    _, first = np.unique(mix(keys + owner.astype(np.uint64) * U64(0x9E3779B97F4A7C15)), return_index=True)
    return np.bincount(owner[first], minlength=n)


def chunk_counts(buf: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    n = len(offsets) - 1
    white = WHITE[buf]
    lead = (buf & 0xC0) != 0x80  # the first byte of a character
    prefix = byte_prefix(buf)
    starts, ends, first = word_bounds(buf, offsets)
    words = span_hash(prefix, starts, ends)
    owner = np.repeat(np.arange(n), np.diff(first))
    out = {
        "n_bytes": np.diff(offsets),
        "n_chars": _per_document(lead, offsets),
        "n_words": np.diff(first),
        "word_chars": _per_document(lead & ~white, offsets),
        "n_symbols": _per_document(_SYMBOL[buf], offsets),
        "n_upper": _per_document(_UPPER[buf], offsets),
        "n_digits": _per_document(_DIGIT[buf], offsets),
        "n_marks": _per_document(_MARK[buf], offsets),
        "n_exclaims": _per_document(buf == 0x21, offsets),
    }
    # words without a letter or digit: ASCII signs only
    sign = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((_SYMBOL | _MARK)[buf], out=sign[1:])
    out["n_alone"] = np.bincount(owner[sign[ends] - sign[starts] == ends - starts], minlength=n)
    # lines with a word
    edge = np.unique(np.concatenate([offsets[:-1], np.flatnonzero(buf == 0x0A) + 1]))
    edge = edge[edge < len(buf)]
    stop = np.append(edge[1:], len(buf))
    newline = np.zeros(len(buf) + 1, bool)
    newline[:-1] = buf == 0x0A
    stop = stop - newline[stop - 1] if len(stop) else stop
    solid = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(~white, out=solid[1:])
    full = solid[stop] > solid[edge]
    edge, stop = edge[full], stop[full]
    line_owner = np.searchsorted(offsets, edge, side="right") - 1
    out["n_lines"] = np.bincount(line_owner, minlength=n)
    out["n_dup_lines"] = out["n_lines"] - _distinct(span_hash(prefix, edge, stop), line_owner, n)
    out["n_distinct_words"] = _distinct(words, owner, n)
    # words in three-word windows that the text has twice
    out["n_repeat_words"] = np.zeros(n, np.int64)
    if len(words) >= 3:
        same = owner[2:] == owner[:-2]
        at = np.flatnonzero(same)
        key = mix(window_hashes(words, 3)[at] + owner[at].astype(np.uint64) * U64(0x9E3779B97F4A7C15))
        if len(key):
            order = np.argsort(key)
            ranked = key[order]
            again = np.zeros(len(key), bool)
            equal = ranked[1:] == ranked[:-1]
            again[1:] |= equal
            again[:-1] |= equal
            hit = at[order[again]]
            cover = np.zeros(len(words), bool)
            for k in range(3):
                cover[hit + k] = True
            out["n_repeat_words"] = np.bincount(owner[cover], minlength=n)
    return out


def column_counts(column: pa.Array) -> dict[str, np.ndarray]:
    """``COUNTS`` of each text of an Arrow column."""
    buf, offsets = flat(column)
    parts = []
    for i, j in chunks(offsets):
        lo = offsets[i]
        parts.append(chunk_counts(buf[lo : offsets[j]], offsets[i : j + 1] - lo))
    return {c: np.concatenate([p[c] for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64) for c in COUNTS}
