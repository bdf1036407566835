"""N-gram Jaccard join as a blocked sparse matrix product.

Rows of the incidence matrix are documents, columns their distinct word
``n``-grams.  Overlap counts are its product with its transpose; two documents link
when ``100 * overlap >= percent * union``.

1. Documents with the same words stand for each other.
2. Columns that one document alone holds add nothing.  Of its ``m`` n-grams a
   document may miss ``m - ceil(t m)`` in a partner, so in hash order the first
   ``m - ceil(t m) + l`` hold ``l`` of the common ones.  These prefixes go to column
   buckets, four bytes each and once per slot; a document with fewer shared
   columns than the bound for its size has no partner and leaves.
3. Of the documents that are left, the columns are counted, rare ones come first, and
   documents that share a column of the shortest prefix fall into one cluster
   (a link never leaves a cluster; a passage that many share builds none).
4. Clusters are cut into row blocks.  A block multiplies its rows, a column block
   at a time, and stops when no pair can reach its bound any more.  Members
   linked in a block are then represented by one of them, and representatives
   are multiplied again.  What is not joined to its cluster's largest component
   by then is multiplied with all blocks of the cluster.  So every link between
   components is tested, no group is ever held or paired up by one task, and a group of
   near copies costs rows times blocks only where it falls apart.

Defined cases: no words or a null text make an empty set, which links with
nothing; fewer than ``n`` words make one item of the whole sequence; a null id
links with nothing and has a null component; rows that share an id are documents
of their own; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import components, saved
from tessera.llm.slots import NO_ID, SLOT_BYTES, Copies, Slot, ask, asked, back, cut, each, got_values, met, only, rows, send_values, shared_values, short_keys, slotted, together, within
from tessera.llm.textbits import chunks, mix, sequence_hash, window_hashes, word_hashes

N, PERCENT = 5, 80
BLOCK = 256
#: Pairs that a block of columns adds at a time.
PAIRS = 2_000_000


def folded_words(text: bytes) -> bytes:
    return b" ".join(text.lower().split())  # bytes.lower() folds A-Z only


def slot_sets(s: Slot, stands: np.ndarray, n: int) -> list[np.ndarray | None]:
    """Sorted distinct n-gram hashes of each document, None where ``stands`` is false."""
    out: list[np.ndarray | None] = []
    for i, j in chunks(s.offsets):
        lo = s.offsets[i]
        h, _, _, first = word_hashes(s.buf[lo : s.offsets[j]], s.offsets[i : j + 1] - lo, lower=True)
        grams = window_hashes(h, n)
        for k, (a, z) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
            if not stands[i + k]:
                out.append(None)
            elif z - a >= n:
                x = np.sort(grams[a : z - n + 1])
                out.append(x[np.append(True, x[1:] != x[:-1])])
            else:
                out.append(np.array([sequence_hash(h[a:z])] if z > a else [], np.uint64))
    return out


def may_miss(m: np.ndarray, percent: int) -> np.ndarray:
    """Items of a set of ``m`` that a partner may lack."""
    return m - (-(-m * percent // 100))


def depth(m: np.ndarray, percent: int) -> np.ndarray:
    """How many common items the long prefix is to hold; grows with ``m``."""
    return may_miss(m, percent) + 1


def long_prefix(x: np.ndarray, percent: int) -> np.ndarray:
    m = np.int64(len(x))
    # the lowest hashes crowd at one end; buckets want them spread
    return mix(x[: int(may_miss(m, percent) + depth(m, percent))]) if m else x


def send_prefixes(docs: pa.Table, known: pa.Table, copies: Copies, n: int, grams: int, percent: int) -> pa.Table:
    s = Slot(docs)
    parts = [long_prefix(x, percent) for x in slot_sets(s, copies.known(s, known)[0], grams) if x is not None]
    return send_values(s.slot, np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64), n)


def candidates(docs: pa.Table, answers: pa.Table, copies: Copies, n: int, grams: int, percent: int, whole: bool = False) -> pa.Table:
    """Every document with its class, and the sets of those that may have a partner; with ``whole`` also what stays of it."""
    s = Slot(docs)
    stands, _, least = copies.known(s, only(answers, 0))
    sets = slot_sets(s, np.ones(s.rows, bool), grams)
    known = [k for k in range(s.rows) if stands[k] and s.ids[k] != NO_ID and len(sets[k])]
    prefixes = [long_prefix(sets[k], percent) for k in known]
    body: list[bytes | None] = [None] * s.rows
    if known:
        size = np.array([len(x) for x in prefixes])
        every = np.concatenate(prefixes)
        value, inverse, count = np.unique(every, return_inverse=True, return_counts=True)
        shared = (count > 1) | within(short_keys(value, n), got_values(only(answers, 1)))
        hits = np.add.reduceat(shared[inverse].astype(np.int64), np.cumsum(size) - size)
        large = np.array([len(sets[k]) for k in known])
        smallest = -(-large * percent // 100)  # the size of the smallest partner
        for k, ok in zip(known, hits >= depth(smallest, percent), strict=True):
            if ok:
                body[k] = sets[k].tobytes()
    empty = [not len(x) for x in sets]
    null = s.ids == NO_ID
    out = {
        "slot": pa.array([s.slot] * s.rows, pa.int32()),
        "doc_id": s.table.column("doc_id"),
        "n_shingles": pa.array([len(x) for x in sets], pa.int64()),
        "stands_in": pa.array(np.where(empty, s.ids, least), pa.int64(), mask=null),
        "items": pa.array(body, pa.binary()),
    }
    if whole:
        out["text"] = s.table.column("text")
        if "carry" in s.table.column_names:
            out["carry"] = s.table.column("carry")
        return pa.table(out).filter(pa.array(stands | np.array(empty, bool) | null))
    return pa.table(out)


_COUNT = np.dtype([("low", "<u4"), ("n", "<u4")])
_RANK = np.dtype([("low", "<u4"), ("rank", "u1")])


def send_column_counts(table: pa.Table, n: int) -> pa.Table:
    items = np.concatenate([np.frombuffer(x, np.uint64) for x in table.column("items").to_pylist()])
    value, count = np.unique(items, return_counts=True)
    body = np.zeros(len(value), _COUNT)
    body["low"], body["n"] = value.astype(np.uint32), count
    return rows(table.column("slot")[0].as_py(), [(b, body[i:j].tobytes(), b"") for b, i, j in cut(value, n)])


def column_ranks(table: pa.Table) -> pa.Table:
    """Answer each slot with its columns of two rows or more, and the logarithm of how many."""
    bucket, slots, bodies, _ = asked(table)
    arrays = [np.frombuffer(x, _COUNT) for x in bodies]
    every = np.concatenate(arrays)
    value, inverse = np.unique(every["low"], return_inverse=True)
    total = np.bincount(inverse, every["n"], len(value)).astype(np.int64)
    out = []
    for slot, a in zip(slots, arrays, strict=True):
        df = total[np.searchsorted(value, a["low"])]
        many = df > 1
        if many.any():
            x = np.zeros(int(many.sum()), _RANK)
            x["low"], x["rank"] = a["low"][many], np.log2(df[many]).astype(np.uint8)
            out.append((slot, x.tobytes(), b""))
    return back(bucket, out)


def prefix_rows(table: pa.Table, ranks: pa.Table, n: int, percent: int, places: bool = False) -> pa.Table:
    """``item, doc_id`` for the shared columns of each shortest prefix, rare columns first; with ``places`` also the set's ``size`` and the column's ``at``."""
    known = [np.frombuffer(x, _RANK) for x in ranks.column("body").to_pylist()]
    key = [x["low"].astype(np.uint64) | np.uint64(b << 32) for b, x in zip(ranks.column("bucket").to_pylist(), known, strict=True)]
    key, rank = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((key, np.uint64), ([x["rank"] for x in known], np.uint8)))
    order = np.argsort(key)
    key, rank = key[order], rank[order]
    items, docs, sizes, at = [], [], [], []
    for doc, raw in zip(table.column("doc_id").to_pylist(), table.column("items").to_pylist(), strict=True):
        x = np.frombuffer(raw, np.uint64)
        short = short_keys(x, n)
        shared = within(short, key)
        level = np.zeros(len(x), np.uint8)
        level[shared] = rank[np.searchsorted(key, short[shared])]
        first = np.lexsort((x, level))[: int(may_miss(np.int64(len(x)), percent)) + 1]
        place = np.flatnonzero(level[first] > 0)
        first = first[place]
        items.append(x[first].view(np.int64))
        docs.append(np.full(len(first), doc, np.int64))
        sizes.append(np.full(len(first), len(x), np.int64))
        at.append(place)
    columns = {"item": items, "doc_id": docs} | ({"size": sizes, "at": at} if places else {})
    return pa.table({c: np.concatenate(v) if v else pa.array([], pa.int64()) for c, v in columns.items()})


def _entries(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Column and row of each entry of the incidence matrix, columns of one row alone left out; rare columns first."""
    size = np.array([len(x) for x in sets], np.int64)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), size)
    keep = count[column] > 1
    column, row = column[keep], row[keep]
    order = np.lexsort((row, column, count[column]))
    return column[order], row[order]


def overlaps(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int) -> np.ndarray:
    """Which rows of ``left`` link with which of ``right`` (or of ``left``).

    The sparse product of the incidence matrix with its transpose, a block of columns
    at a time: each column adds one to the pairs of rows that have it.  After a block, pairs that cannot reach
    the bound for their sizes are discarded, and rows without a pair leave.
    """
    sets = left if right is None else left + right
    m, k = len(left), len(sets)
    size = np.array([len(x) for x in sets], np.int64)
    column, row = _entries(sets)
    first = 0 if right is None else m
    a_size, b_size = size[:m, None], size[first:][None, :]
    # 100 o >= p (a + b - o)
    need = -(-(percent * (a_size + b_size)) // (100 + percent))
    alive = need <= np.minimum(a_size, b_size)
    if right is None:
        np.fill_diagonal(alive, False)
    out = np.zeros(alive.shape, np.int64)
    rest = np.bincount(row, minlength=k).astype(np.int64)
    while len(column) and alive.any():
        # of each entry of ``left``: the entries of the other side in its column
        edge = np.flatnonzero(np.append(True, column[1:] != column[:-1]))
        stop = np.append(edge[1:], len(column))
        split = edge if right is None else edge + np.add.reduceat((row < m).astype(np.int64), edge)
        which = np.repeat(np.arange(len(edge)), stop - edge)
        pairs = np.cumsum(((split if right is not None else stop) - edge) * (stop - split))
        n = max(1, int(np.searchsorted(pairs, PAIRS, side="right")))
        end = int(stop[n - 1])
        at = np.arange(end)
        if right is not None:
            at = at[row[:end] < m]
        many = (stop - split)[which[at]]
        other = np.repeat(split[which[at]], many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        key = np.repeat(row[at], many) * out.shape[1] + row[other] - first
        out += np.bincount(key, minlength=out.size).reshape(out.shape)
        rest -= np.bincount(row[:end], minlength=k)
        column, row = column[end:], row[end:]
        alive &= out + np.minimum(rest[:m, None], rest[first:][None, :]) >= need
        live = np.zeros(k, bool)
        live[:m] |= alive.any(axis=1)
        live[first:] |= alive.any(axis=0)
        keep = live[row]
        column, row = column[keep], row[keep]
    alive &= out >= need
    if right is None:
        np.fill_diagonal(alive, size > 0)
    return alive


def lowest(link: np.ndarray) -> np.ndarray:
    """Smallest row number reachable by symmetric ``link``."""
    label = np.arange(len(link))
    while True:
        new = np.minimum(label, np.where(link, label[None, :], len(link)).min(axis=1, initial=len(link)))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _stars(found: list[tuple[int, int, int]]) -> pa.Table:
    a = np.array(found, np.int64).reshape(-1, 3)
    return pa.table({"cluster": pa.array(a[:, 0]), "a": pa.array(a[:, 1]), "b": pa.array(a[:, 2])})


def multiply(table: pa.Table, percent: int) -> pa.Table:
    """Each member of a block with the smallest id that it reaches inside (itself if none)."""
    cluster, doc = (table.column(c).to_numpy() for c in ("cluster", "doc_id"))
    items = table.column("items").to_pylist()
    order = np.lexsort((doc, cluster))
    edges = np.flatnonzero(np.append(True, cluster[order][1:] != cluster[order][:-1]))
    found = []
    for a, z in zip(edges, np.append(edges[1:], len(order)), strict=True):
        at = order[a:z]
        # a whole small cluster, or a block of a large one; never more rows than BLOCK by a wide margin
        label = lowest(overlaps([np.frombuffer(items[i], np.uint64) for i in at], None, percent))
        found += [(int(cluster[at[0]]), int(doc[i]), int(doc[at[k]])) for i, k in zip(at, label, strict=True)]
    return _stars(found)


def cross(table: pa.Table, percent: int) -> pa.Table:
    """Links between left-over members and a block of their cluster: for each row of either side, one partner per component."""
    side = table.column("side").to_numpy()
    doc, group = (table.column(c).to_numpy() for c in ("doc_id", "group"))
    items = table.column("items").to_pylist()
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    cluster = table.column("cluster")[0].as_py()
    if not len(left) or not len(right):
        return _stars([])
    link = overlaps([np.frombuffer(items[i], np.uint64) for i in left], [np.frombuffer(items[i], np.uint64) for i in right], percent)
    x, y = np.nonzero(link & (group[left][:, None] != group[right][None, :]))
    # one link for each pair of components that meet here says all
    pair = {(int(group[left[i]]), int(group[right[j]])): (cluster, int(doc[left[i]]), int(doc[right[j]])) for i, j in zip(x, y, strict=True)}
    return _stars(list(pair.values()))


def with_sets(docs: DataFrame, n: int, percent: int, id_col: str, text_col: str, carry: Iterable[str] | None) -> tuple[DataFrame, int]:
    """Rows of ``candidates``, written, and the number of slots."""
    if not 50 < percent <= 100:
        raise ValueError("percent must be over 50 and at most 100")
    table, slots = slotted(docs, id_col, text_col, carry or ())
    copies = Copies(folded_words, slots)
    how = {"copies": copies, "n": slots, "grams": n, "percent": percent}
    known = copies.flags(table)
    columns = met(table, known, partial(send_prefixes, **how), slots, shared_values)
    schema = "slot int, doc_id long, n_shingles long, stands_in long, items binary"
    if carry is not None:
        schema += ", text string" + (f", carry {table.schema['carry'].dataType.simpleString()}" if "carry" in table.columns else "")
    return saved(ask(table, together(known, columns), partial(candidates, **how, whole=carry is not None), schema)), slots


def _components(docs: DataFrame, n: int, percent: int, id_col: str, text_col: str, block: int, carry: Iterable[str] | None) -> tuple[DataFrame, DataFrame]:
    """Rows of ``candidates`` and ``stands_in, component`` of those that are linked."""
    every, slots = with_sets(docs, n, percent, id_col, text_col, carry)
    links = cluster_links(every.filter("items is not null").select("slot", "doc_id", "items"), slots, percent, block)
    return every, components(links).select(F.col("node").alias("stands_in"), F.col("component"))


def ngram_join(docs: DataFrame, n: int = N, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """``doc_id, n_shingles, component_id`` (the smallest id reachable by links, itself included)."""
    every, found = _components(docs, n, percent, id_col, text_col, block, None)
    return every.select("doc_id", "n_shingles", "stands_in").join(found, "stands_in", "left").select("doc_id", "n_shingles", F.coalesce("component", "stands_in").alias("component_id"))


def ngram_dedup(docs: DataFrame, n: int = N, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, carry: Iterable[str] = ()) -> DataFrame:
    """``doc_id, text[, carry]`` of one document of each group, the one with the smallest id; a null text is returned empty.

    Documents without a possible partner are settled while their text is at hand; only the others' texts
    are joined with the components.
    """
    every, found = _components(docs, n, percent, id_col, text_col, block, list(carry))
    columns = [c for c in every.columns if c in ("doc_id", "text", "carry")]
    rest = every.filter("items is not null").join(found, "stands_in", "left").filter("component is null or component = doc_id")
    return every.filter("items is null").select(columns).unionByName(rest.select(columns))


def prefixes(sets: DataFrame, slots: int, percent: int, places: bool = False) -> DataFrame:
    """``prefix_rows`` of all sets, written."""
    ranks = met(sets, None, partial(send_column_counts, n=slots), slots, column_ranks)
    schema = "item long, doc_id long" + (", size long, at long" if places else "")
    return saved(ask(sets, ranks, partial(prefix_rows, n=slots, percent=percent, places=places), schema))


def clustered(heads: DataFrame) -> DataFrame:
    """``node, component``: documents that share a column of their prefixes, directly or by way of others."""
    least = heads.groupBy("item").agg(F.min("doc_id").alias("b"), F.max("doc_id").alias("top")).filter("b < top").select("item", "b")
    return components(heads.join(least, "item").select(F.col("doc_id").alias("a"), "b").distinct())


def cluster_links(sets: DataFrame, slots: int, percent: int, block: int) -> DataFrame:
    """``(a, b)``: links that join the same documents as all links do."""
    spark = sets.sparkSession
    clusters = clustered(prefixes(sets, slots, percent))
    sets = sets.drop("slot")
    members = saved(sets.join(clusters.select(F.col("node").alias("doc_id"), F.col("component").alias("cluster")), "doc_id"))
    schema = "cluster long, a long, b long"
    found: list[DataFrame] = []
    level = members
    while True:
        count = level.groupBy("cluster").agg(F.count("*").alias("size"), F.sum(F.octet_length("items")).alias("bytes"))
        count = saved(count)
        total, large, rows = count.agg(F.sum("bytes"), F.max("size"), F.sum("size")).first()
        if not rows:
            break
        bins = max(64, -(-total // SLOT_BYTES))
        parts = F.ceil(F.col("size") / block)
        keyed = level.join(count, "cluster").select(
            "cluster", "doc_id", "items",
            F.when(F.col("size") <= block, F.pmod(F.xxhash64("cluster"), F.lit(bins))).otherwise(F.xxhash64("cluster", F.pmod(F.xxhash64("doc_id"), parts))).alias("part"),
        )
        stars = saved(each(keyed, "part", partial(multiply, percent=percent), schema))
        found.append(stars)
        if large <= block:
            break
        wide = count.filter(F.col("size") > block).select("cluster")
        heads = stars.join(wide, "cluster", "left_semi").select("cluster", F.col("b").alias("doc_id")).distinct()
        again = saved(level.join(heads, ["cluster", "doc_id"], "left_semi").select("doc_id", "items", "cluster"))
        if again.count() > 0.8 * level.join(wide, "cluster", "left_semi").count():
            break
        level = again
    if not found:
        return spark.createDataFrame([], "a long, b long")
    links = found[0]
    for x in found[1:]:
        links = links.unionByName(x)
    first = members.groupBy("cluster").count().filter(F.col("count") > block).select("cluster")
    wide = members.join(first, "cluster", "left_semi")
    if wide.isEmpty():
        return links.select("a", "b").filter("a <> b")
    links = links.unionByName(cross_links(wide, links, percent, block))
    return links.select("a", "b").filter("a <> b")


def cross_links(wide: DataFrame, links: DataFrame, percent: int, block: int) -> DataFrame:
    """Every left-over member of a large cluster against all blocks of the cluster."""
    joined = components(links.select("a", "b")).select(F.col("node").alias("doc_id"), F.col("component"))
    member = saved(wide.join(joined, "doc_id", "left").select("cluster", "doc_id", "items", F.coalesce("component", "doc_id").alias("group")))
    sizes = member.groupBy("cluster", "group").count()
    main = sizes.groupBy("cluster").agg(F.max_by("group", F.struct("count", -F.col("group"))).alias("main"), F.sum("count").alias("size"))
    member = member.join(main, "cluster")
    rest = member.filter("group <> main")
    held = rest.groupBy("cluster").agg(F.count("*").alias("rest"))
    parts = main.join(held, "cluster").select("cluster", F.ceil(F.col("size") / block).alias("blocks"), F.ceil(F.col("rest") / block).alias("pieces"))
    left = rest.join(parts, "cluster").select("cluster", "doc_id", "items", "group", F.lit(0).alias("side"), F.pmod(F.xxhash64("doc_id", F.lit(1)), "pieces").alias("piece"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    right = member.join(parts, "cluster").select("cluster", "doc_id", "items", "group", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), F.pmod(F.xxhash64("doc_id", F.lit(2)), "blocks").alias("block"))
    both = left.unionByName(right).withColumn("part", F.xxhash64("cluster", "piece", "block"))

    def product(table: pa.Table) -> pa.Table:
        out = []
        keys = list(zip(*(table.column(c).to_pylist() for c in ("cluster", "piece", "block")), strict=True))
        for key in set(keys):  # one, but for a clash of hashes
            out.append(cross(table.filter(pa.array([k == key for k in keys])), percent))
        return pa.concat_tables(out)

    return saved(both.groupBy("part").applyInArrow(product, "cluster long, a long, b long"))


def op5_ngram_join(spark, sf_dir: str) -> DataFrame:
    return ngram_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
