"""Suffix-array dedup by a depth-limited most-significant-digit radix sort.

Every document is a UTF-8 byte string.  A window is ``length`` consecutive bytes
of one document; a byte is removed when it lies in a window that also starts in
a document with a smaller id.  Suffixes are ordered only through their first
``length`` bytes, eight bytes (one digit) a pass; groups that are still equal
after the last pass are exactly the repeated windows, and suffixes that become
unique leave the sort at once.

Sorting every suffix would move fifty times the corpus.  Each window has a
content-chosen key, the least hash of its byte ``K``-grams; equal windows have equal
keys.  A first exchange finds the keys that more than one document holds, four
bytes each; only windows under such keys enter the sort, as short runs of bytes,
one copy per slot.  The key decides nothing else: runs with the same bytes are one entry of
the sort, which orders the windows of all different runs by their bytes.

A sentence that many documents share inside different texts would bring all its surroundings under one key.  So the first exchange
also counts the different runs of each key.  Beyond ``HEAVY`` of them each window goes by a hash of its own: a further exchange finds those that
two documents hold, and only these enter the sort, each in the bucket of its hash.  No bucket then gets more than ``HEAVY`` different runs for a key,
and one for each slot of the same.

Defined cases: a null or empty text has no window; a null id counts as larger
than any id; rows with the same id never remove each other's bytes (only a
smaller id does); copies of a whole text are removed whole when they have
``length`` bytes or more; other columns are ignored unless named in ``carry``.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.slots import Copies, Slot, ask, asked, back, contents, cut, got_values, met, only, packed, plain, rows, send_counted, send_values, shared_counted, shared_values, short_keys, slotted, together, within
from tessera.llm.textbits import U64, byte_prefix, chunks, mix, powers, span_hash
from tessera.llm.textbits import _P as BASE

LENGTH = 50
#: At most so many windows in one run, so that a run's answer is one 64-bit mask.
RUN = 64
_ENTRY = np.dtype([("low", "<u4"), ("n", "<u2"), ("doc", "<i8"), ("pos", "<u4")])
_MARK = np.dtype([("pos", "<u4"), ("mask", "<u8")])


def window_keys(buf: np.ndarray, length: int, prefix: np.ndarray) -> np.ndarray:
    """Least hash of the ``length // 2``-grams of each window of ``buf``."""
    k = max(1, length // 2)
    n = len(buf) - k + 1
    wide = length - k + 1
    if len(buf) < length:
        return np.zeros(0, np.uint64)
    least = mix((prefix[k:] - prefix[:-k]) * powers(BASE, len(prefix))[1][:n])
    step = 1
    while step * 2 <= wide:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if rest := wide - step:
        least = np.minimum(least[: len(least) - rest], least[rest:])
    return least


def slot_runs(s: Slot, stands: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Key, first byte, number of windows, row and content (a hash) of each run of windows with one key."""
    keys, starts, sizes, owners, contents_ = [], [], [], [], []
    for i, j in chunks(s.offsets):
        lo = s.offsets[i]
        buf, offsets = s.buf[lo : s.offsets[j]], s.offsets[i : j + 1] - lo
        prefix = byte_prefix(buf)
        least = window_keys(buf, length, prefix)
        if not len(least):
            continue
        per = np.maximum(np.diff(offsets) - length + 1, 0) * stands[i:j]
        total = int(per.sum())
        if not total:
            continue
        row = np.repeat(np.arange(j - i), per)
        first = np.cumsum(per) - per
        at = np.arange(total) - first[row] + offsets[:-1][row]
        key = least[at]
        new = np.ones(total, bool)
        new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, total))
        if (size > RUN).any():  # periodic text
            parts = -(-size // RUN)
            nth = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
            begin = np.repeat(begin, parts) + nth * RUN
            size = np.minimum(np.repeat(size, parts) - nth * RUN, RUN)
        keys.append(mix(key[begin]))  # least hashes crowd at the low end; buckets want them spread
        starts.append(at[begin] + lo)
        sizes.append(size)
        owners.append(row[begin] + i)
        contents_.append(span_hash(prefix, at[begin], at[begin] + size + length - 1))
    if not keys:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)), np.zeros(0, np.uint64)
    return tuple(map(np.concatenate, (keys, starts, sizes, owners, contents_)))


def windows_of(s: Slot, start: np.ndarray, size: np.ndarray, row: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and row of each window of runs, which come in the order of the slot."""
    at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    out = []
    for i, j in chunks(s.offsets):
        lo, hi = np.searchsorted(at, (s.offsets[i], s.offsets[j]))
        if hi > lo:
            own = at[lo:hi] - s.offsets[i]
            out.append(span_hash(byte_prefix(s.buf[s.offsets[i] : s.offsets[j]]), own, own + length))
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), at, np.repeat(row, size)


def send_keys(docs: pa.Table, copies_back: pa.Table, copies: Copies, length: int, n: int) -> pa.Table:
    s = Slot(docs)
    key, *_, content = slot_runs(s, copies.known(s, copies_back)[0], length)
    return send_counted(s.slot, *contents(key, content), n)


def send_heavy(docs: pa.Table, answers: pa.Table, copies: Copies, length: int, n: int) -> pa.Table:
    """Hashes of the windows under heavy keys."""
    heavy = got_values(only(answers, 1), "echo")
    if not len(heavy):
        return rows(0, [])
    s = Slot(docs)
    key, start, size, row, _ = slot_runs(s, copies.known(s, only(answers, 0))[0], length)
    take = within(short_keys(key, n), heavy)
    return send_values(s.slot, np.unique(windows_of(s, start[take], size[take], row[take], length)[0]), n)


def held_twice(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Sorted keys that two ids of one slot have."""
    order = np.lexsort((doc, key))
    k, d = key[order], doc[order]
    return np.unique(k[1:][(k[1:] == k[:-1]) & (d[1:] != d[:-1])])


def send_runs(docs: pa.Table, answers: pa.Table, copies: Copies, length: int, n: int) -> pa.Table:
    s = Slot(docs)
    stands = copies.known(s, only(answers, 0))[0]
    key, start, size, row, _ = slot_runs(s, stands, length)
    if not len(key):
        return rows(s.slot, [])
    # shared with another slot, or by two ids of this one
    heavy = within(short_keys(key, n), got_values(only(answers, 1), "echo"))
    take = ~heavy & (within(short_keys(key, n), got_values(only(answers, 1))) | within(key, held_twice(key, s.ids[row])))
    parts = [(key[take], start[take], size[take], row[take])]
    if heavy.any():
        own, at, of = windows_of(s, start[heavy], size[heavy], row[heavy], length)
        take = within(short_keys(own, n), got_values(only(answers, 2))) | within(own, held_twice(own, s.ids[of]))
        parts.append((own[take], at[take], np.ones(int(take.sum()), np.int64), of[take]))
    key, start, size, row = map(np.concatenate, zip(*parts, strict=True))
    order = np.lexsort((start, s.ids[row], key))
    key, start, size, row = (x[order] for x in (key, start, size, row))
    low, doc = key.astype(np.uint32), s.ids[row]
    text = s.buf.tobytes()
    first: dict[bytes, int] = {}
    entry, local = [], []
    for k, (a, m) in enumerate(zip(start.tolist(), size.tolist(), strict=True)):
        run = text[a : a + m + length - 1]
        known = first.setdefault(run, k)
        if known == k or doc[known] == doc[k]:
            entry.append(k)
        else:  # a smaller id of this slot has the same run
            local.append(k)
    entry, local = np.array(entry, np.int64), np.array(local, np.int64)
    marks = np.zeros(len(local), _MARK)
    marks["pos"], marks["mask"] = start[local], full(size[local])
    out = []
    for b, i, j in cut(key[entry], n):
        at = entry[i:j]
        head = np.zeros(len(at), _ENTRY)
        head["low"], head["n"], head["doc"], head["pos"] = low[at], size[at], doc[at], start[at]
        out.append([b, packed(len(at).to_bytes(4, "little") + head.tobytes() + b"".join(text[x : x + m + length - 1] for x, m in zip(start[at].tolist(), size[at].tolist(), strict=True))), b""])
    if len(local):
        if not out:
            out = [[s.slot % n, packed((0).to_bytes(4, "little")), b""]]
        out[s.slot % len(out)][2] = marks.tobytes()
    return rows(s.slot, out)


def full(size: np.ndarray) -> np.ndarray:
    """A mask with the lowest ``size`` bits set."""
    return np.uint64(0xFFFFFFFFFFFFFFFF) >> (U64(64) - size.astype(np.uint64))


def radix_groups(buf: np.ndarray, at: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Order suffixes ``at`` of ``buf`` within ``group`` by their first ``length`` bytes, a digit of eight bytes a pass.

    Suffixes alone in their group drop out after each pass.  Returns the index
    (into ``at``) of those that are left, and the number of the group of each.
    """
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    word = np.zeros(len(buf), np.uint64)
    for i in range(8):
        word = (word << U64(8)) | padded[i : i + len(buf)].astype(np.uint64)
    digits = [*range(0, max(1, length - 7), 8)]
    if length >= 8 and digits[-1] != length - 8:
        digits.append(length - 8)  # the last digit overlaps the one before
    left = np.arange(len(at))
    for step in (-1, *digits):
        if not len(left):
            break
        if step < 0:
            order = np.argsort(group, kind="stable")
            left, g = left[order], group[order]
            new = np.ones(len(left), bool)
            new[1:] = g[1:] != g[:-1]
        else:
            digit = word[at[left] + step]
            if length < 8:
                digit = digit >> U64(8 * (8 - length))
            order = np.lexsort((digit, g))
            left, digit, g = left[order], digit[order], g[order]
            new = np.ones(len(left), bool)
            new[1:] = (g[1:] != g[:-1]) | (digit[1:] != digit[:-1])
        number = np.cumsum(new) - 1
        alone = np.bincount(number)[number] == 1
        left, g = left[~alone], number[~alone]
    return left, (g if len(left) else np.zeros(0, np.int64))


def decide_runs(table: pa.Table, length: int) -> pa.Table:
    """For each run that slots sent: which of its windows start in a smaller id, too."""
    bucket, slots, bodies, echoes = asked(table)
    heads, parts = [], []
    for body in map(plain, bodies):
        m = int.from_bytes(body[:4], "little")
        head = np.frombuffer(body, _ENTRY, m, 4)
        heads.append(head)
        a = 4 + m * _ENTRY.itemsize
        for w in head["n"].tolist():
            parts.append(body[a : a + w + length - 1])
            a += w + length - 1
    head = np.concatenate(heads)
    kind: dict[tuple, int] = {}
    which = np.fromiter((kind.setdefault(x, len(kind)) for x in zip(head["low"].tolist(), parts, strict=True)), np.int64, len(parts))
    doc = np.full(len(kind), np.iinfo(np.int64).max, np.int64)
    np.minimum.at(doc, which, head["doc"])
    runs = [x[1] for x in kind]
    low = np.array([x[0] for x in kind], np.uint32)
    size = np.array([len(x) - length + 1 for x in runs], np.int64)
    begin = np.cumsum(size + length - 1) - (size + length - 1)
    buf = np.frombuffer(b"".join(runs), np.uint8)
    of = np.repeat(np.arange(len(runs)), size)
    first = np.cumsum(size) - size
    at = begin[of] + np.arange(len(of)) - first[of]
    least = doc[of]  # smallest id with each window
    if len(at):
        left, group = radix_groups(buf, at, low[of].astype(np.int64), length)
        if len(left):
            new = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            low_doc = np.minimum.reduceat(least[left], new)
            least[left] = np.repeat(low_doc, np.diff(np.append(new, len(left))))
    out, k = [], 0
    for slot, h, echo in zip(slots, heads, echoes, strict=True):
        own = which[k : k + len(h)]
        k += len(h)
        marks = np.zeros(len(h), _MARK)
        if len(h):
            n = size[own]
            of_entry = np.repeat(np.arange(len(h)), n)
            bit = np.arange(len(of_entry)) - (np.cumsum(n) - n)[of_entry]
            hit = least[first[own][of_entry] + bit] < h["doc"][of_entry]
            marks["pos"] = h["pos"]
            marks["mask"] = np.bitwise_or.reduceat(np.where(hit, U64(1) << bit.astype(np.uint64), U64(0)), np.cumsum(n) - n)
        body = marks[marks["mask"] != 0].tobytes()
        if body or echo:
            out.append((slot, body, echo))
    return back(bucket, out)


def finish(docs: pa.Table, answers: pa.Table, copies: Copies, length: int, as_text: bool) -> pa.Table:
    s = Slot(docs)
    stands, _, least = copies.known(s, only(answers, 0))
    starts = np.zeros(len(s.buf) + 1, np.int32)
    for name in ("body", "echo"):
        for x in only(answers, 1).column(name).to_pylist():
            marks = np.frombuffer(x, _MARK)
            for bit in range(RUN):
                starts[marks["pos"][(marks["mask"] >> U64(bit)) & U64(1) != 0] + bit] = 1
    change = starts.copy()
    change[length:] -= starts[:-length] if length < len(starts) else 0
    gone = np.cumsum(change)[:-1] > 0
    spans, kept = [], []
    for i in range(s.rows):
        a, z = int(s.offsets[i]), int(s.offsets[i + 1])
        if not stands[i] and least[i] < s.ids[i] and z - a >= length:
            spans.append([(0, z - a)])
            kept.append(b"")
            continue
        # rows that repeat the id and text of the one that stands for them share its fate
        if not stands[i] and i and s.ids[i - 1] == s.ids[i] and s.raw(i - 1) == s.raw(i):
            spans.append(spans[-1])
            kept.append(kept[-1])
            continue
        cover = gone[a:z]
        if not cover.any():
            spans.append([])
            kept.append(s.buf[a:z].tobytes())
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[False], cover, [False]]).astype(np.int8)))
        spans.append([(int(x), int(y - x)) for x, y in zip(edge[::2], edge[1::2], strict=True)])
        kept.append(s.buf[a:z][~cover].tobytes())
    columns = {
        "doc_id": s.table.column("doc_id"),
        "n_bytes": pa.array(np.diff(s.offsets), pa.int64()),
        "spans": pa.array([[{"start": a, "length": n} for a, n in x] for x in spans], pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))),
        "kept": pa.array([x.decode(errors="ignore") for x in kept], pa.string()) if as_text else pa.array(kept, pa.binary()),
    }
    if "carry" in s.table.column_names:
        columns["carry"] = s.table.column("carry")
    return pa.table(columns)


def suffix_dedup(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", carry: Iterable[str] = (), as_text: bool = False) -> DataFrame:
    """``doc_id, n_bytes, spans (start and length of each removed run), kept (bytes that are left)[, carry]``.

    With ``as_text``, ``kept`` is a string, without the bytes of characters that a cut has split.
    """
    if length < 2:
        raise ValueError("length must be 2 at least")
    table, n = slotted(docs, id_col, text_col, carry)
    copies = Copies(bytes, n)
    known = copies.flags(table)
    keys = met(table, known, partial(send_keys, copies=copies, length=length, n=n), n, shared_counted)
    heavy = met(table, together(known, keys), partial(send_heavy, copies=copies, length=length, n=n), n, shared_values)
    marks = met(table, together(known, keys, heavy), partial(send_runs, copies=copies, length=length, n=n), n, partial(decide_runs, length=length))
    schema = "doc_id long, n_bytes long, spans array<struct<start:long,length:long>>, kept " + ("string" if as_text else "binary")
    if "carry" in table.columns:
        schema += f", carry {table.schema['carry'].dataType.simpleString()}"
    return ask(table, together(known, marks), partial(finish, copies=copies, length=length, as_text=as_text), schema)


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", F.aggregate("spans", F.lit(0).cast("long"), lambda t, x: t + x["length"]).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
