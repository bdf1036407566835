"""Substring dedup by difference-cover anchors.

A window is ``length`` consecutive words of one document; a word is removed
when it lies in a window whose word sequence starts anywhere else, the same
document included.  Positions in ``COVER`` modulo ``PERIOD`` carry anchors, hashes of
``length - PERIOD + 1`` words.  For any two positions some shift below the
period moves both onto the cover, so two equal windows share an aligned anchor.

First exchange: anchors that occur twice, four bytes each and once per slot.
Then each shared anchor is extended by the words around it: the windows that hold
it leave as runs of words, under the least hash of their word ``length - PERIOD + 1``-grams, which equal
windows share wherever they start.  A bucket compares windows word by word (numbers of
words, then of pairs, of fours, ...); no hash decides.

A passage that many documents hold inside different texts would bring all its surroundings under one key.  So the different runs of each key are
counted; beyond ``HEAVY`` of them each window goes by a hash of its own, and only those that are in two places leave, each in the
bucket of its hash.  No bucket gets more than ``HEAVY`` different runs for a key, and one for each slot of the same.

Defined cases: a null or empty text has no words; rows with null or equal ids
are documents of their own; documents with the same words as another are
removed whole when they have ``length`` words; other columns are ignored unless
named in ``carry``.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.slots import Copies, Slot, ask, asked, back, contents, cut, got_values, met, only, rows, send_counted, send_values, shared_counted, shared_values, short_keys, slotted, together, within
from tessera.llm.textbits import U64, chunks, mix, window_hashes, word_hashes

LENGTH = 35
PERIOD = 21
#: A perfect difference set: its differences are all residues modulo PERIOD.
COVER = (0, 1, 4, 14, 16)
#: At most so many windows in one run, so that a run's answer is one 64-bit mask.
RUN = 64
_RUN = np.dtype([("pos", "<u4"), ("bytes", "<u4"), ("n", "u1"), ("twice", "u1")])
_MARK = np.dtype([("pos", "<u4"), ("mask", "<u8")])


def words_of(text: bytes) -> bytes:
    return b" ".join(text.split())  # bytes.split() splits at exactly the white space of the contract


def covers(cover: Iterable[int], period: int) -> bool:
    cover = tuple(cover)
    return {(a - b) % period for a in cover for b in cover} == set(range(period))


def sliding_least(x: np.ndarray, wide: int) -> np.ndarray:
    """Least of each ``wide`` consecutive entries."""
    step = 1
    while step * 2 <= wide and len(x) > step:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    if (rest := wide - step) and len(x) > rest:
        x = np.minimum(x[:-rest], x[rest:])
    return x


def slot_windows(s: Slot, stands: np.ndarray, length: int, period: int, cover: tuple[int, ...]) -> dict[str, np.ndarray]:
    """Of the slot's words, counted through the slot: first and last byte, does a window begin (``fits``) and its key; and the anchors (hash, word number)."""
    wide = length - period + 1
    columns: dict[str, list[np.ndarray]] = {c: [] for c in ("anchor", "at", "key", "whole", "fits", "begin", "end")}
    on = np.zeros(period, bool)
    on[list(cover)] = True
    base = 0
    for i, j in chunks(s.offsets):
        lo = s.offsets[i]
        h, begin, end, first = word_hashes(s.buf[lo : s.offsets[j]], s.offsets[i : j + 1] - lo)
        n = np.diff(first)
        nth = np.arange(len(h)) - np.repeat(first[:-1], n)
        size = np.repeat(n * stands[i:j], n)
        grams = window_hashes(h, wide)
        a = np.flatnonzero(on[nth % period] & (nth + wide <= size) & (size >= length))
        key = np.zeros(len(h), np.uint64)
        if len(h) >= length:
            key[: len(h) - length + 1] = mix(sliding_least(grams, period))  # least hashes crowd at the low end; buckets want them spread
        whole = np.zeros(len(h), np.uint64)
        whole[: max(0, len(h) - length + 1)] = window_hashes(h, length)
        for c, x in zip(columns, (grams[a], a + base, key, whole, nth + length <= size, begin + lo, end + lo), strict=True):
            columns[c].append(x)
        base += len(h)
    kinds = {"anchor": np.uint64, "at": np.int64, "key": np.uint64, "whole": np.uint64, "fits": bool, "begin": np.int64, "end": np.int64}
    return {c: np.concatenate(x) if x else np.zeros(0, kinds[c]) for c, x in columns.items()}


def send_anchors(docs: pa.Table, known: pa.Table, copies: Copies, n: int, how: tuple) -> pa.Table:
    s = Slot(docs)
    return send_values(s.slot, np.unique(slot_windows(s, copies.known(s, known)[0], *how)["anchor"]), n)


def candidates(s: Slot, answers: pa.Table, copies: Copies, n: int, how: tuple) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """The slot's words, and key, first word and number of windows of each run of windows that extend a shared anchor."""
    w = slot_windows(s, copies.known(s, only(answers, 0))[0], *how)
    period, none = how[1], np.zeros(0, np.int64)
    value, count = np.unique(w["anchor"], return_counts=True)
    take = within(short_keys(w["anchor"], n), got_values(only(answers, 1))) | within(w["anchor"], value[count > 1])
    # a window extends a shared anchor that starts in its first ``period`` words
    total = np.zeros(len(w["key"]) + 1, np.int64)
    hit = np.zeros(len(w["key"]), np.int64)
    hit[w["at"][take]] = 1
    np.cumsum(hit, out=total[1:])
    p = np.arange(len(w["key"]))
    pos = np.flatnonzero(w["fits"] & (total[np.minimum(p + period, len(p))] > total[p]))
    if not len(pos):
        return w, np.zeros(0, np.uint64), none, none
    key = w["key"][pos]
    start = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (pos[1:] != pos[:-1] + 1)]))
    size = np.diff(np.append(start, len(pos)))
    parts = -(-size // RUN)  # periodic texts make long runs
    nth = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
    size = np.minimum(np.repeat(size, parts) - nth * RUN, RUN)
    start = np.repeat(start, parts) + nth * RUN
    return w, key[start], pos[start], size


def send_keys(docs: pa.Table, answers: pa.Table, copies: Copies, n: int, how: tuple) -> pa.Table:
    """Keys of the runs, and how many different ones the slot has of each."""
    s = Slot(docs)
    w, key, first, size = candidates(s, answers, copies, n, how)
    # a run is its first and last window and its length
    content = mix(w["whole"][first] + U64(3) * w["whole"][first + size - 1] + size.astype(np.uint64))
    return send_counted(s.slot, *contents(key, content), n)


def send_heavy(docs: pa.Table, answers: pa.Table, copies: Copies, n: int, how: tuple) -> pa.Table:
    """Hashes of the windows under heavy keys."""
    heavy = got_values(only(answers, 2), "echo")
    if not len(heavy):
        return rows(0, [])
    s = Slot(docs)
    w, key, first, size = candidates(s, answers, copies, n, how)
    take = within(short_keys(key, n), heavy)
    return send_values(s.slot, np.unique(w["whole"][_each(first[take], size[take])]), n)


def _each(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """First words of all windows of runs."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def send_runs(docs: pa.Table, answers: pa.Table, copies: Copies, n: int, how: tuple) -> pa.Table:
    """The windows that extend a shared anchor, as runs of words; the slot itself marks (echo) those of runs that it has twice."""
    s = Slot(docs)
    length = how[0]
    w, key, first, size = candidates(s, answers, copies, n, how)
    heavy = within(short_keys(key, n), got_values(only(answers, 2), "echo"))
    if heavy.any():
        at = _each(first[heavy], size[heavy])
        own = w["whole"][at]
        value, count = np.unique(own, return_counts=True)
        take = within(short_keys(own, n), got_values(only(answers, 3))) | within(own, value[count > 1])
        key, first, size = (np.concatenate([x[~heavy], y]) for x, y in ((key, own[take]), (first, at[take]), (size, np.ones(int(take.sum()), np.int64))))
    if not len(key):
        return rows(s.slot, [])
    order = np.lexsort((first, key))
    key, first, size = key[order], first[order], size[order]
    text = s.buf.tobytes()
    body = [text[a:z] for a, z in zip(w["begin"][first].tolist(), w["end"][first + size + length - 2].tolist(), strict=True)]
    known: dict[bytes, int] = {}
    same = np.fromiter((known.setdefault(x, k) for k, x in enumerate(body)), np.int64, len(body))
    twice = np.bincount(same, minlength=len(body)) > 1
    entry = np.flatnonzero(same == np.arange(len(body)))
    head = np.zeros(len(entry), _RUN)
    head["pos"], head["n"], head["twice"], head["bytes"] = first[entry], size[entry], twice[entry], [len(body[k]) for k in entry.tolist()]
    out = [[b, (j - i).to_bytes(4, "little") + head[i:j].tobytes() + b"".join(body[k] for k in entry[i:j].tolist()), b""] for b, i, j in cut(key[entry], n)]
    local = np.flatnonzero(twice[same])
    if len(local):
        marks = np.zeros(len(local), _MARK)
        marks["pos"], marks["mask"] = first[local], np.uint64(0xFFFFFFFFFFFFFFFF) >> (U64(64) - size[local].astype(np.uint64))
        out[s.slot % len(out)][2] = marks.tobytes()
    return rows(s.slot, out)


def numbered_windows(ids: np.ndarray, length: int) -> np.ndarray:
    """A number for each run of ``length`` entries, equal exactly for equal runs; made of numbers of shorter ones."""
    if len(ids) < length:
        return np.zeros(0, np.int64)
    number, size = np.unique(ids, return_inverse=True)[1].astype(np.int64), 1
    while size < length:
        step = min(size, length - size)
        pair = number[:-step] * (int(number.max()) + 1) + number[step:]
        number, size = np.unique(pair, return_inverse=True)[1].astype(np.int64), size + step
    return number


def decide_windows(table: pa.Table, length: int) -> pa.Table:
    """For each run that slots sent: which of its windows are in another place, too, compared word by word."""
    bucket, slots, bodies, echoes = asked(table)
    heads, of, weight = [], [], []
    run: dict[bytes, int] = {}
    for body in bodies:
        m = int.from_bytes(body[:4], "little")
        head = np.frombuffer(body, _RUN, m, 4)
        a = 4 + m * _RUN.itemsize
        own = np.zeros(m, np.int64)
        for k, n in enumerate(head["bytes"].tolist()):
            own[k] = run.setdefault(body[a : a + n], len(run))
            a += n
        heads.append(head)
        of.append(own)
        weight.append(1 + head["twice"].astype(np.int64))
    many = np.bincount(np.concatenate(of), np.concatenate(weight), len(run)).astype(np.int64) if run else np.zeros(0, np.int64)
    number: dict[bytes, int] = {}
    words = [[number.setdefault(w, len(number)) for w in x.split()] for x in run]
    size = np.array([len(x) for x in words], np.int64)
    first = np.cumsum(size) - size
    windows = size - length + 1
    at = np.repeat(first - (np.cumsum(windows) - windows), windows) + np.arange(int(windows.sum()))
    kind = numbered_windows(np.fromiter((w for x in words for w in x), np.int64, int(size.sum())), length)[at] if len(at) else np.zeros(0, np.int64)
    repeated = (np.bincount(kind, np.repeat(many, windows))[kind] > 1) if len(at) else np.zeros(0, bool)
    base = np.cumsum(windows) - windows
    out = []
    for slot, head, own, echo in zip(slots, heads, of, echoes, strict=True):
        marks = np.zeros(len(head), _MARK)
        if len(head):
            n = head["n"].astype(np.int64)
            entry = np.repeat(np.arange(len(head)), n)
            bit = np.arange(len(entry)) - (np.cumsum(n) - n)[entry]
            marks["pos"] = head["pos"]
            marks["mask"] = np.bitwise_or.reduceat(np.where(repeated[base[own][entry] + bit], U64(1) << bit.astype(np.uint64), U64(0)), np.cumsum(n) - n)
        body = marks[marks["mask"] != 0].tobytes()
        if body or echo:
            out.append((slot, body, echo))
    return back(bucket, out)


def marked(answers: pa.Table) -> np.ndarray:
    """Sorted distinct word numbers at which the slot's removed windows start."""
    found = []
    for name in ("body", "echo"):
        for x in answers.column(name).to_pylist():
            marks = np.frombuffer(x, _MARK)
            for bit in range(RUN):
                found.append(marks["pos"][(marks["mask"] >> U64(bit)) & U64(1) != 0] + np.uint32(bit))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint32)


def finish(docs: pa.Table, answers: pa.Table, copies: Copies, length: int) -> pa.Table:
    s = Slot(docs)
    _, many, _ = copies.known(s, only(answers, 0))
    pos = marked(only(answers, 1))
    counts, spans, kept, base = [], [], [], 0
    for i in range(s.rows):
        raw = s.raw(i)
        # words are counted as slot_windows counts them
        words = raw.split()
        n = len(words)
        counts.append(n)
        a, z = np.searchsorted(pos, (base, base + n))
        base += n
        if many[i] > 1 and n >= length:
            spans.append([(0, n)])
            kept.append("")
            continue
        if a == z:
            spans.append([])
            kept.append(b" ".join(words).decode())
            continue
        change = np.zeros(n + 1, np.int32)
        start = pos[a:z].astype(np.int64) - (base - n)
        np.add.at(change, start, 1)
        np.add.at(change, start + length, -1)
        gone = np.cumsum(change)[:n] > 0
        edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
        runs = list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))
        spans.append([(x, y - x) for x, y in runs])
        left, end = [], 0
        for x, y in runs:
            left += words[end:x]
            end = y
        kept.append(b" ".join(left + words[end:]).decode())
    columns = {
        "doc_id": s.table.column("doc_id"),
        "n_words": pa.array(counts, pa.int64()),
        "spans": pa.array([[{"start": a, "length": k} for a, k in x] for x in spans], pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))),
        "kept": pa.array(kept, pa.string()),
    }
    if "carry" in s.table.column_names:
        columns["carry"] = s.table.column("carry")
    return pa.table(columns)


def cover_dedup(docs: DataFrame, length: int = LENGTH, period: int = PERIOD, cover: tuple[int, ...] = COVER, id_col: str = "doc_id", text_col: str = "text", carry: Iterable[str] = ()) -> DataFrame:
    """``doc_id, n_words, spans (start and length of removed runs, in words), kept (words that are left)[, carry]``."""
    if not covers(cover, period) or not 1 <= period <= length:
        raise ValueError("cover must have every difference modulo period, and period be at most length")
    table, n = slotted(docs, id_col, text_col, carry)
    how = (length, period, tuple(cover))
    copies = Copies(words_of, n)
    known = copies.flags(table)
    anchors = met(table, known, partial(send_anchors, copies=copies, n=n, how=how), n, shared_values)
    keys = met(table, together(known, anchors), partial(send_keys, copies=copies, n=n, how=how), n, shared_counted)
    heavy = met(table, together(known, anchors, keys), partial(send_heavy, copies=copies, n=n, how=how), n, shared_values)
    windows = met(table, together(known, anchors, keys, heavy), partial(send_runs, copies=copies, n=n, how=how), n, partial(decide_windows, length=length))
    schema = "doc_id long, n_words long, spans array<struct<start:long,length:long>>, kept string"
    if "carry" in table.columns:
        schema += f", carry {table.schema['carry'].dataType.simpleString()}"
    return ask(table, together(known, windows), partial(finish, copies=copies, length=length), schema)


def op8_cover_dedup(spark, sf_dir: str) -> DataFrame:
    out = cover_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", F.aggregate("spans", F.lit(0).cast("long"), lambda t, x: t + x["length"]).alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))
