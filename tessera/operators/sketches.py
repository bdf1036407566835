"""All pairs of sketches that share a value, with their similarity.

Where two sketches of at most ``k`` values meet, a shared value is among the m smallest of their union just if its places in both, less
the shared values before it, come to less than m.  So the places of the values that a sketch shares with any other decide, and only those travel: rows
are dealt to blocks, and the rows of two blocks meet in one group, which joins them a few million entries at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.hashing import KINDS
from tessera.operators.graph import settled

#: Copies that one row stands for, shared values of a block, blocks at least, and entries or pairs that are held at a time.
COPIES, BLOCK, LEAST_BLOCKS, JOINED = 32, 4_000_000, 6, 2_000_000


def _sketched(batches: Iterable[pa.RecordBatch], k: int, size: int, kind: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            found = [np.unique(KINDS[kind](x.as_py().encode(), k))[:size] for x in part.column(1)]
            keep = pa.array([bool(len(x)) for x in found])
            digest = pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in found], pa.binary())
            s = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(x) for x in found])), pa.int32()), pa.array(np.concatenate(found)))
            yield pa.RecordBatch.from_arrays([part.column(0), digest, s], ["doc_id", "digest", "s"]).filter(keep)


def sketches(docs: DataFrame, k: int, size: int, kind: str = "md5") -> DataFrame:
    """``doc_id, digest, s`` of ``docs(doc_id, text)``: the ``size`` smallest distinct shingle hashes, ascending; texts without words have no row.

    A map over batches, as Spark would make the hashes of a column once more for a filter on them.
    """
    texts = docs.select(F.col("doc_id").cast("long"), F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    return texts.mapInArrow(lambda batches: _sketched(batches, k, size, kind), "doc_id long, digest binary, s array<long>")


class _Block:
    """Rows of one block: their values, the places of these, and what each row stands for."""

    def __init__(self, batch: pa.Table):
        at = batch.column("at").combine_chunks()
        ids = batch.column("ids").combine_chunks()
        self.n = batch.column("n").to_numpy().astype(np.int64)
        long = np.diff(at.offsets.to_numpy())
        self.row = np.repeat(np.arange(len(self.n), dtype=np.int64), long)
        x = at.flatten()
        self.h, self.place = x.field("h").to_numpy(), x.field("p").to_numpy().astype(np.int64)
        self.ids, self.first = ids.flatten().to_numpy(), ids.offsets.to_numpy().astype(np.int64) - ids.offsets[0].as_py()
        self.end = np.append(0, np.cumsum(long))


def _runs(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``first[i], first[i] + 1, ...`` of ``count[i]`` each, one run after the other."""
    total = np.cumsum(count)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(first - (total - count), count)


def _cuts(weight: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Bounds of runs of ``weight`` of about ``most`` each, one element at least."""
    total = np.cumsum(weight)
    edge = np.unique(np.append(np.searchsorted(total, np.arange(0, total[-1] + 1 if len(total) else 1, most)[1:]) + 1, [0, len(weight)]))
    return list(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True))


def _members(a: _Block, b: _Block, x: np.ndarray, y: np.ndarray, similarity: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The documents that the rows ``x`` of ``a`` and ``y`` of ``b`` stand for, each two with other ids."""
    many = np.diff(b.first)[y]
    for lo, hi in _cuts(np.diff(a.first)[x] * many, JOINED):
        left = np.diff(a.first)[x[lo:hi]]
        p = _runs(a.first[x[lo:hi]], left)
        right = np.repeat(np.arange(lo, hi), left)
        q = _runs(b.first[y[right]], many[right])
        one, two, s = np.repeat(a.ids[p], many[right]), b.ids[q], np.repeat(similarity[right], many[right])
        other = one != two
        one, two, s = one[other], two[other], s[other]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(one, two)), pa.array(np.maximum(one, two)), pa.array(s)], ["a", "b", "similarity"])


def _met(a: _Block, b: _Block, size: int) -> Iterator[pa.RecordBatch]:
    """``a, b, similarity`` of each row of ``a`` with each of ``b`` that shares a value, of each two rows once where both are one block."""
    order = np.argsort(b.h, kind="stable")
    bh, brow, bplace = b.h[order], b.row[order], b.place[order]
    at = np.searchsorted(bh, a.h)
    count = np.searchsorted(bh, a.h, "right") - at
    of_row = np.diff(np.append(0, np.cumsum(count))[a.end])
    for lo, hi in _cuts(of_row, JOINED):
        i = slice(a.end[lo], a.end[hi])
        left = np.repeat(np.arange(i.start, i.stop), count[i])
        right = _runs(at[i], count[i])
        if a is b:
            kept = a.row[left] < brow[right]
            left, right = left[kept], right[kept]
        if not len(left):
            continue
        pair = (a.row[left] - lo) * len(b.n) + brow[right]
        # stable: the values of a pair stay ascending
        by = np.argsort(pair, kind="stable")
        pair, left, right = pair[by], left[by], right[by]
        first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
        before = np.arange(len(pair)) - np.repeat(first, np.diff(np.append(first, len(pair))))
        x, y = a.row[left[first]], brow[right[first]]
        m = np.minimum(np.minimum(a.n[x], b.n[y]), size)
        low = a.place[left] + bplace[right] - before < np.repeat(m, np.diff(np.append(first, len(pair))))
        yield from _members(a, b, x, y, np.add.reduceat(low.astype(np.int64), first) / m)


def similar_pairs(sketched: DataFrame, size: int) -> DataFrame:
    """``a, b, similarity``, ``a < b``, of ``sketched(doc_id, digest, s)``: every two documents whose sketches share a value.

    Rows with equal sketches go together, ``COPIES`` at a time.  The result has a row for each pair of copies, too, so it grows with the square of
    a group; what is exchanged grows with the shared values times the number of blocks.
    """
    made = settled(sketched.filter("doc_id is not null"))
    many = made.groupBy("digest").agg(F.ceil(F.count("*") / COPIES).alias("parts")).filter("parts > 1")
    dealt = made.join(many, "digest", "left").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.coalesce("parts", F.lit(1))))
    rows = dealt.groupBy("digest", "part").agg(F.collect_list("doc_id").alias("ids"), F.first("s").alias("s"))
    rows = settled(rows.withColumn("row", F.monotonically_increasing_id()).withColumn("n", F.size("s")).drop("digest", "part"))
    values = rows.select("row", F.posexplode("s").alias("p", "h"))
    shared = values.join(values.groupBy("h").agg(F.count("*").alias("c")).filter("c > 1").select("h"), "h", "left_semi")
    places = shared.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("h", "p"))).alias("at"))
    kept = settled(rows.select("row", "n", "ids").join(places, "row"))
    entries = kept.agg(F.sum(F.size("at"))).first()[0] or 0
    blocks = max(LEAST_BLOCKS, -(-entries // BLOCK))
    own = F.pmod(F.xxhash64("row"), F.lit(blocks))
    each = kept.select(own.alias("own"), "n", "ids", "at", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"))
    sent = each.withColumn("meet", F.least("own", "other") * blocks + F.greatest("own", "other"))

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        side = table.column("own").to_numpy()
        meet = table.column("meet")[0].as_py()
        lo, hi = meet // blocks, meet % blocks
        a = _Block(table.filter(pa.array(side == lo)))
        b = a if lo == hi else _Block(table.filter(pa.array(side == hi)))
        yield from _met(a, b, size)

    between = sent.groupBy("meet").applyInArrow(met, "a long, b long, similarity double")
    one = F.col("a") < F.col("b")
    within = rows.filter(F.size("ids") > 1).select("ids", F.explode("ids").alias("a")).select("a", F.explode("ids").alias("b")).filter(one).withColumn("similarity", F.lit(1.0))
    return between.unionByName(within)
