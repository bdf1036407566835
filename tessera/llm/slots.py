"""Scatter and gather by slots: how corpus-wide operators meet without moving texts again.

Documents are dealt once, by a hash of their id, to slots of a few megabytes.
A phase works on one slot at a time and sends compact packed arrays to hash
buckets; a bucket answers to the slots that asked.  Each slot sends a value at
most once per bucket, so a line that a third of all documents share costs one
entry per slot, never one per document: hot values are aggregated before the
shuffle.  All phases read one exchange of the texts, which Spark reuses; the
whole operator is one lazy plan and is recomputed by lineage when an executor
is lost.

Up to ``DIRECT`` slots each slot sends a row to each bucket: at 32 GB of texts 67 million
rows of several hundred bytes.  Beyond, rows would grow with the square of the slots, so
they travel in two hops: a slot sends one parcel
to each district of about ``sqrt(n)`` buckets; tasks open the parcels of a
district, sort the parts by bucket and pass on one parcel for each bucket, which
holds the parts of many slots.  Answers go back the same way.  Rows then grow with
``n * sqrt(n)`` small parcels at most, and a part costs twelve bytes beside its values;
but each part is written to disk twice, so no input takes two hops that need not.
"""

from __future__ import annotations

import ctypes
import hashlib
import math
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.textbits import U64, flat

SLOT_BYTES = 4 << 20
LEAST_SLOTS = 64
#: Slots up to which rows go straight from slot to bucket.
DIRECT = 8192
#: Bytes of parcels that a task opens at a time between the hops.
PARCELS = 16 << 20
#: In place of the sender of a row: its body is a parcel with the parts of many.
MANY = -1
#: Stands for a null id inside a slot: larger than every id.
NO_ID = np.iinfo(np.int64).max
ROWS = "bucket int, slot int, body binary, echo binary"
BACK = "slot int, bucket int, body binary, echo binary"
_ROWS = pa.schema([("bucket", pa.int32()), ("slot", pa.int32()), ("body", pa.binary()), ("echo", pa.binary())])
_BACK = pa.schema([("slot", pa.int32()), ("bucket", pa.int32()), ("body", pa.binary()), ("echo", pa.binary())])


def slotted(docs: DataFrame, id_col: str, text_col: str, carry: Iterable[str] = ()) -> tuple[DataFrame, int]:
    """``(slot, doc_id, text[, carry])`` and the number of slots, which follows the bytes of all texts.

    Id and text decide the slot, so rows with a null or frequent id are spread; rows equal in both meet.
    """
    total = docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`").cast("string")))).first()[0] or 0
    n = max(LEAST_SLOTS, -(-int(total) // SLOT_BYTES))
    doc_id, text = F.col(f"`{id_col}`").cast("long"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    columns = [F.pmod(F.xxhash64(doc_id, text), F.lit(n)).cast("int").alias("slot"), doc_id.alias("doc_id"), text.alias("text")]
    if carry := list(carry):
        columns.append(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carry"))
    return docs.select(*columns), n


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # another C library
    _trim = None


class Slot:
    """The documents of one slot in a fixed order: by id, then text, nulls last."""

    def __init__(self, table: pa.Table):
        self.slot = table.column("slot")[0].as_py() if table.num_rows else 0
        order = pc.sort_indices(table, [("doc_id", "ascending"), ("text", "ascending")], null_placement="at_end")
        self.table = table.take(order).combine_chunks()
        self.buf, self.offsets = flat(self.table.column("text"))
        ids = self.table.column("doc_id").combine_chunks()
        self.ids = ids.fill_null(int(NO_ID)).to_numpy(zero_copy_only=False).astype(np.int64)
        self.rows = self.table.num_rows

    def raw(self, i: int) -> bytes:
        return self.buf[self.offsets[i] : self.offsets[i + 1]].tobytes()


def buckets_of(keys: np.ndarray, n: int) -> np.ndarray:
    """Bucket of each 64-bit hash, by its high bits: sorted hashes have sorted buckets."""
    return (((keys >> U64(32)) * U64(n)) >> U64(32)).astype(np.int32)


def cut(keys: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """``(bucket, from, to)`` runs of sorted ``keys``."""
    if not len(keys):
        return []
    b = buckets_of(keys, n)
    edges = np.flatnonzero(b[1:] != b[:-1]) + 1
    starts = [0, *edges.tolist()]
    return list(zip(b[starts].tolist(), starts, [*edges.tolist(), len(keys)], strict=True))


def rows(slot: int, out: list[tuple[int, bytes, bytes]]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([slot] * len(out), pa.int32()), pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.binary())], schema=_ROWS)


def back(bucket: int, out: list[tuple[int, bytes, bytes]]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([bucket] * len(out), pa.int32()), pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.binary())], schema=_BACK)


_ZSTD = pa.Codec("zstd", compression_level=1)


def packed(data: bytes) -> bytes:
    """``data`` compressed: pieces of text take a fifth less on disk than what Spark makes of them itself."""
    return len(data).to_bytes(8, "little") + _ZSTD.compress(data, asbytes=True)


def plain(data: bytes) -> bytes:
    return _ZSTD.decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)


def asked(table: pa.Table) -> tuple[int, list[int], list[bytes], list[bytes]]:
    """Bucket, and slot, body and echo of each row that a bucket got, by slot."""
    slots = table.column("slot").to_numpy()
    order = np.argsort(slots, kind="stable")
    table = table.take(order)
    return table.column("bucket")[0].as_py(), slots[order].tolist(), table.column("body").to_pylist(), table.column("echo").to_pylist()


# ---- parcels ---------------------------------------------------------------------------


def parcels(table: pa.Table, key: str, label: str) -> pa.Table:
    """One row for each value of ``key``: the labels, sizes, bodies and echoes of its parts as one binary."""
    table = table.take(np.argsort(table.column(key).to_numpy(), kind="stable"))
    keys, labels = (table.column(c).to_numpy() for c in (key, label))
    (body, b), (echo, e) = (flat(table.column(c)) for c in ("body", "echo"))
    edges = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    out = []
    for i, j in zip(edges.tolist(), [*edges[1:].tolist(), len(keys)], strict=True) if len(edges) else ():
        head = np.concatenate([[j - i], labels[i:j], np.diff(b[i : j + 1]), np.diff(e[i : j + 1])]).astype("<u4")
        out.append(b"".join((head.tobytes(), body[b[i] : b[j]].tobytes(), echo[e[i] : e[j]].tobytes())))
    return pa.table({"key": pa.array(keys[edges], pa.int32()), "body": pa.array(out, pa.binary())})


def opened(parcel: bytes) -> pa.Table:
    """``label, body, echo`` of the parts of a parcel."""
    m = int.from_bytes(parcel[:4], "little")
    label, body, echo = np.frombuffer(parcel, "<u4", 3 * m, 4).reshape(3, m)
    at, columns = 4 + 12 * m, [pa.array(label.astype(np.int32))]
    for size in (body, echo):
        offsets = np.append(0, np.cumsum(size, dtype=np.int64))
        columns.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), m, [None, pa.py_buffer(offsets), pa.py_buffer(parcel[at : at + int(offsets[-1])])]))
        at += int(offsets[-1])
    return pa.Table.from_arrays(columns, ["label", "body", "echo"])


def unpacked(table: pa.Table, key: str, label: str) -> pa.Table:
    """``table`` with a row for each part, if it came as parcels."""
    if not {key, label, "body", "echo"} <= set(table.column_names) or not table.num_rows or table.column(label)[0].as_py() != MANY:
        return table
    out = []
    rest = [c for c in table.column_names if c not in (label, "body", "echo")]
    for k, raw in enumerate(table.column("body").to_pylist()):
        parts = opened(raw)
        same = {c: pa.array(np.full(parts.num_rows, table.column(c)[k].as_py(), np.int32)) for c in rest}
        out.append(pa.table(same | {label: parts.column("label"), "body": parts.column("body").cast(pa.binary()), "echo": parts.column("echo").cast(pa.binary())}))
    return pa.concat_tables(out)


def regroup(batches, key: str, label: str):
    """Between the hops: parcels from one sender to a district become parcels from many senders to one receiver."""
    held: list[pa.Table] = []
    size = 0

    def flush() -> pa.RecordBatch:
        out = parcels(pa.concat_tables(held), "key", "sender")
        n = out.num_rows
        columns = {key: out.column("key"), label: pa.array(np.full(n, MANY, np.int32)), "body": out.column("body"), "echo": pa.array([b""] * n, pa.binary())}
        return pa.table({c: columns[c] for c in _order(key)}).combine_chunks().to_batches()[0]

    for batch in batches:
        for sender, raw in zip(batch.column(label).to_pylist(), batch.column("body").to_pylist(), strict=True):
            parts = opened(raw)
            held.append(pa.table({"key": parts.column("label"), "sender": pa.array(np.full(parts.num_rows, sender, np.int32)), "body": parts.column("body"), "echo": parts.column("echo")}))
            size += len(raw)
            if size > PARCELS:
                yield flush()
                held, size = [], 0
                tidy()
    if held:
        yield flush()


def _order(key: str) -> tuple[str, ...]:
    return ("bucket", "slot", "body", "echo") if key == "bucket" else ("slot", "bucket", "body", "echo")


def posted(table: pa.Table, key: str, label: str, n: int) -> pa.Table:
    """The first hop: what one sender has for a district, as one row."""
    if not table.num_rows:
        return table
    width = math.isqrt(n - 1) + 1
    sender = table.column(label)[0].as_py()
    table = table.append_column("district", pa.array(table.column(key).to_numpy() // width, pa.int32()))
    out = parcels(table, "district", key)
    m = out.num_rows
    columns = {key: out.column("key"), label: pa.array(np.full(m, sender, np.int32)), "body": out.column("body"), "echo": pa.array([b""] * m, pa.binary())}
    return pa.table({c: columns[c] for c in _order(key)})


def forwarded(rows_: DataFrame, key: str, label: str, schema: str) -> DataFrame:
    """The second hop; a district is shared by as many tasks as it needs, as any parcel can be opened anywhere."""
    return rows_.repartition(key, F.pmod(F.col(label), F.lit(16))).mapInArrow(lambda batches: regroup(batches, key, label), schema)


def met(docs: DataFrame, answers: DataFrame | None, send: Callable[..., pa.Table], n: int, answer: Callable[[pa.Table], pa.Table]) -> DataFrame:
    """Slots ``send`` rows to ``n`` buckets, buckets ``answer``: rows ``BACK`` for the slots."""
    hops = n > DIRECT

    def out(*tables: pa.Table) -> pa.Table:
        got = send(*tables)
        return posted(got, "bucket", "slot", n) if hops else got

    def home(table: pa.Table) -> pa.Table:
        got = answer(table)
        return posted(got, "slot", "bucket", n) if hops else got

    sent = each(docs, "slot", out, ROWS) if answers is None else ask(docs, answers, out, ROWS)
    if hops:
        sent = forwarded(sent, "bucket", "slot", ROWS)
    got = each(sent, "bucket", home, BACK)
    return forwarded(got, "slot", "bucket", BACK) if hops else got


# ---- values that several slots hold ---------------------------------------------------


def send_values(slot: int, values: np.ndarray, n: int) -> pa.Table:
    """Sorted distinct hashes to their buckets, four bytes each (the bucket has the high bits)."""
    low = values.astype(np.uint32)
    return rows(slot, [(b, low[i:j].tobytes(), b"") for b, i, j in cut(values, n)])


def shared_values(table: pa.Table) -> pa.Table:
    """Answer each slot with those of its values that another slot sent, too."""
    bucket, slots, bodies, _ = asked(table)
    arrays = [np.frombuffer(x, np.uint32) for x in bodies]
    every = np.sort(np.concatenate(arrays))
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    out = []
    for slot, a in zip(slots, arrays, strict=True):
        if len(twice):
            k = np.minimum(np.searchsorted(twice, a), len(twice) - 1)
            hit = a[twice[k] == a]
            if len(hit):
                out.append((slot, hit.tobytes(), b""))
    return back(bucket, out)


_COUNT = np.dtype([("low", "<u4"), ("n", "<u4")])
#: Different contents under one key, beyond which it is heavy.
HEAVY = 64


def send_counted(slot: int, values: np.ndarray, counts: np.ndarray, n: int) -> pa.Table:
    """As ``send_values``, with how many different contents the slot has under each value, where that is over one."""
    low = values.astype(np.uint32)
    out = []
    for b, i, j in cut(values, n):
        more = np.flatnonzero(counts[i:j] > 1) + i
        own = np.zeros(len(more), _COUNT)
        own["low"], own["n"] = low[more], counts[more]
        out.append((b, low[i:j].tobytes(), own.tobytes()))
    return rows(slot, out)


def shared_counted(table: pa.Table, heavy: int = HEAVY) -> pa.Table:
    """Answer each slot with those of its values that another slot sent, too, and (``echo``) those with over ``heavy`` contents in all."""
    bucket, slots, bodies, echoes = asked(table)
    arrays = [np.frombuffer(x, np.uint32) for x in bodies]
    value, which = np.unique(np.concatenate(arrays), return_inverse=True)
    senders = np.bincount(which, minlength=len(value))
    contents = senders.copy()
    for x in echoes:
        own = np.frombuffer(x, _COUNT)
        np.add.at(contents, np.searchsorted(value, own["low"]), own["n"].astype(np.int64) - 1)
    shared, many = senders > 1, contents > heavy
    out, k = [], 0
    for slot, a in zip(slots, arrays, strict=True):
        own = which[k : k + len(a)]
        k += len(a)
        if shared[own].any() or many[own].any():
            out.append((slot, a[shared[own]].tobytes(), a[many[own]].tobytes()))
    return back(bucket, out)


def contents(key: np.ndarray, content: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and how many different contents each has."""
    if not len(key):
        return key, np.zeros(0, np.int64)
    order = np.lexsort((content, key))
    k, c = key[order], content[order]
    new = np.append(True, (k[1:] != k[:-1]) | (c[1:] != c[:-1]))
    return np.unique(k[new], return_counts=True)


def got_values(table: pa.Table, column: str = "body") -> np.ndarray:
    """Sorted (bucket, low half) keys of the answer, comparable with ``short_keys``."""
    parts = [np.frombuffer(body, np.uint32).astype(np.uint64) | U64(b << 32) for b, body in zip(table.column("bucket").to_pylist(), table.column(column).to_pylist(), strict=True)]
    return np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def short_keys(keys: np.ndarray, n: int) -> np.ndarray:
    return (buckets_of(keys, n).astype(np.uint64) << U64(32)) | (keys & U64(0xFFFFFFFF))


def within(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which keys are in the sorted array ``known``."""
    if not len(known) or not len(keys):
        return np.zeros(len(keys), bool)
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys


# ---- exact copies ----------------------------------------------------------------------

_COPY = np.dtype([("digest", "S16"), ("doc", "<i8"), ("n", "<i8")])


def digest(data: bytes) -> bytes:
    """16 bytes without a zero byte at the end, which numpy's byte strings would lose."""
    return hashlib.blake2b(data, digest_size=15).digest() + b"\x01"


class Copies:
    """Collapses documents with equal content: each slot sends a digest once, with its smallest id and count."""

    def __init__(self, content: Callable[[bytes], bytes], n: int):
        self.content, self.n = content, n

    def of(self, s: Slot) -> list[bytes]:
        return [digest(self.content(s.raw(i))) for i in range(s.rows)]

    def send(self, table: pa.Table) -> pa.Table:
        s = Slot(table)
        found: dict[bytes, list[int]] = {}
        for d, i in zip(self.of(s), s.ids.tolist(), strict=True):
            if d in found:
                found[d][1] += 1
            else:
                found[d] = [i, 1]
        a = np.array([(d, i, k) for d, (i, k) in found.items()], dtype=_COPY)
        keys = np.frombuffer(a["digest"].tobytes(), np.uint64)[::2]
        order = np.argsort(keys, kind="stable")
        return rows(s.slot, [(b, a[order[i:j]].tobytes(), b"") for b, i, j in cut(keys[order], self.n)])

    @staticmethod
    def answer(table: pa.Table) -> pa.Table:
        bucket, slots, bodies, _ = asked(table)
        arrays = [np.frombuffer(x, _COPY) for x in bodies]
        found: dict[bytes, list[int]] = {}
        for a in arrays:
            for d, i, k in a.tolist():
                if d in found:
                    found[d] = [min(found[d][0], i), found[d][1] + k]
                else:
                    found[d] = [i, k]
        out = []
        for slot, a in zip(slots, arrays, strict=True):
            own = [(d, *found[d]) for d, i, k in a.tolist() if found[d] != [i, k]]
            if own:
                out.append((slot, np.array(own, dtype=_COPY).tobytes(), b""))
        return back(bucket, out)

    def known(self, s: Slot, table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each document: is it the one that stands for its class, the class's size and its smallest id."""
        own = self.of(s)
        size: dict[bytes, list[int]] = {}
        for d, i in zip(own, s.ids.tolist(), strict=True):
            if d in size:
                size[d][1] += 1
            else:
                size[d] = [i, 1]
        for body in table.column("body").to_pylist():
            for d, i, k in np.frombuffer(body, _COPY).tolist():
                size[d] = [i, k]
        first: set[bytes] = set()
        stands, copies, least = np.zeros(s.rows, bool), np.zeros(s.rows, np.int64), np.zeros(s.rows, np.int64)
        for row, (d, i) in enumerate(zip(own, s.ids.tolist(), strict=True)):
            least[row], copies[row] = size[d]
            if size[d][0] == i and d not in first:
                stands[row] = True
                first.add(d)
        return stands, copies, least

    def flags(self, docs: DataFrame) -> DataFrame:
        return met(docs, None, self.send, self.n, self.answer)


def only(table: pa.Table, kind: int) -> pa.Table:
    return table.filter(pc.equal(table.column("kind"), kind))


def tidy() -> None:
    """Give freed memory back: a reused worker would otherwise keep the largest group's."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def ask(docs: DataFrame, answers: DataFrame, f: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``f(slot's documents, answers to it)`` for each slot."""

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return f(left, unpacked(right, "slot", "bucket"))
        finally:
            tidy()

    return docs.groupBy("slot").cogroup(answers.groupBy("slot")).applyInArrow(both, schema)


def each(table: DataFrame, key: str, f: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """``f(group)`` for each value of ``key``."""

    def one(group: pa.Table) -> pa.Table:
        try:
            return f(unpacked(group, "bucket", "slot"))
        finally:
            tidy()

    return table.groupBy(key).applyInArrow(one, schema)


def together(*answers: DataFrame) -> DataFrame:
    """Several answers as one table, told apart by ``kind``."""
    out = None
    for k, a in enumerate(answers):
        a = a.withColumn("kind", F.lit(k))
        out = a if out is None else out.unionByName(a)
    return out
