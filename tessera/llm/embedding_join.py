"""Embedding near-dedup as an exact metric range join.

Vectors are scaled to length one; cosine ``c`` is then the distance
``sqrt(2 - 2 c)``, a metric.  A few vectors serve as pivots and every vector belongs to the
cell of its nearest pivot.  A partner of ``x`` within radius ``r`` can lie in cell ``j`` only if
``d(x, p_j) - d(x, p_own) <= 2 r`` (triangle inequality), sharpened by the distance of ``x``
to the plane halfway between both pivots; and only if ``d(x, p_j) <= r + R_j``, ``R_j`` being the
radius of cell ``j``.  Such an ``x`` is copied to cell ``j`` when ``j`` comes before its own,
so each pair meets in one cell.  Cells are cut into blocks of bounded size and each
pair of blocks is a matrix product of its own.

A product never leaves as pairs: it gives each row its number of partners, and
one link per row and connected group, so a dense ball of vectors costs rows
times blocks.  Cosines near the threshold are decided in double precision.

The number of pivots follows the table: one for ``cell`` vectors, and from ``cell ** 2`` vectors on the square
root of their number, so the driver holds a vanishing share of them and no cell outgrows that root by design.

Defined cases: vectors that are null, empty, zero, of another dimension than most, or hold null or
non-finite components link with nothing; equal vectors are one row with a weight; rows that
share an id are vectors of their own; a null id links with nothing; ties at the
threshold link; other columns are ignored.

In data without structure distances to pivots say little: then most vectors
visit most earlier cells, and the join is a blocked product of all rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import components, saved
from tessera.llm.slots import each

COSINE = 0.95
#: Rows of a block: a pair of blocks needs a product of BLOCK x BLOCK floats.
BLOCK = 4096
#: Vectors a cell should hold; decides the number of pivots.
CELL = 16384
#: Distances to pivots that a task holds at a time.
DISTANCES = 4_000_000
NEAR = 1e-4


def _unit(raw: list[bytes], kind: str) -> np.ndarray:
    v = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    # by the largest component first: squares of 1e200 or 1e-200 have no double
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def pivot_count(total: int, cell: int) -> int:
    return max(1, min(-(-total // cell), math.isqrt(total)))


def slices(batches, wide: int):
    """Batches cut so that each row may have ``wide`` distances."""
    step = max(1, DISTANCES // max(1, wide))
    for b in batches:
        for lo in range(0, b.num_rows, step):
            yield b.slice(lo, step)


def labels(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Smallest row reachable for each of ``n`` rows by the links ``x``-``y``."""
    label = np.arange(n)
    while len(x):
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while (new[new] != new).any():
            new = new[new]
        label = new
        open_ = label[x] != label[y]
        x, y = x[open_], y[open_]
    return label


def embedding_join(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK, cell: int = CELL) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row of ``vectors``."""
    if not 0 < cosine <= 1:
        raise ValueError("cosine must be over 0 and at most 1")
    # what the table holds as floats travels as floats; sums are in double precision
    kind = "f4" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "f8"
    source = F.col(f"`{vector_col}`").cast("array<double>")
    every = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), source.alias("v"))
    fine = F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    width = every.filter(fine).groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).first()
    if width is None:
        return every.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    fine = F.coalesce(fine & (F.size("v") == width["n"]), F.lit(False))
    every = every.withColumn("fine", fine)

    def packed(batches):
        for b in batches:
            v = b.column("v")
            flat = v.flatten().to_numpy(zero_copy_only=False).astype(kind) + np.zeros((), kind)  # -0 becomes 0
            ends = np.append(0, np.cumsum(pc.list_value_length(v).to_numpy(zero_copy_only=False)))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array([flat[a:z].tobytes() for a, z in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], ["vec_id", "raw"])

    keyed = every.filter("fine").select("vec_id", "v").mapInArrow(packed, "vec_id long, raw binary").withColumn("key", F.sha2("raw", 256))
    classes = keyed.groupBy("key").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"), F.first("raw").alias("raw"))
    classes = saved(classes.withColumn("rep", F.monotonically_increasing_id()))
    total = classes.count()
    n_pivots = pivot_count(total, cell)
    # pivots by the order of the keys (hashes), so the same for any partitioning
    pivots = _unit([bytes(r["raw"]) for r in classes.orderBy("key").limit(n_pivots).collect()], kind)
    radius = float(np.sqrt(max(0.0, 2 - 2 * cosine)))

    def nearest(batches):
        for b in slices(batches, n_pivots):
            d = np.sqrt(np.maximum(0, 2 - 2 * _unit(b.column("raw").to_pylist(), kind) @ pivots.T))
            yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("weight"), b.column("raw"), pa.array(d.argmin(axis=1), pa.int32()), pa.array(d.min(axis=1))], ["rep", "weight", "raw", "cell", "far"])

    homes = saved(classes.mapInArrow(nearest, "rep long, weight long, raw binary, cell int, far double"))
    size, reach = {}, np.full(n_pivots, -1.0)
    for r in homes.groupBy("cell").agg(F.max("far").alias("far"), F.count("*").alias("n")).collect():  # a row per pivot
        size[r["cell"]], reach[r["cell"]] = r["n"], r["far"]
    blocks = np.array([-(-size.get(k, 0) // block) for k in range(n_pivots)])
    slack = 1e-9

    def placed(batches):
        """Each vector in its own cell, and in the earlier cells where a partner may be."""
        for b in slices(batches, n_pivots):
            d = np.sqrt(np.maximum(0, 2 - 2 * _unit(b.column("raw").to_pylist(), kind) @ pivots.T))
            own = b.column("cell").to_numpy()
            row = np.arange(len(own))
            d_own = d[row, own]
            between = np.sqrt(np.maximum(0, 2 - 2 * pivots[own] @ pivots.T))
            with np.errstate(divide="ignore", invalid="ignore"):
                plane = np.where(between > 0, (d**2 - (d_own**2)[:, None]) / (2 * between), 0)
            there = (d - d_own[:, None] <= 2 * radius + slack) & (plane <= radius + slack) & (d <= radius + reach[None, :] + slack) & (np.arange(n_pivots)[None, :] < own[:, None]) & (blocks > 0)[None, :]
            there[row, own] = True
            at, at_cell = np.nonzero(there)
            for lo in range(0, len(at), 8192):
                rows, k = at[lo : lo + 8192], at_cell[lo : lo + 8192]
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(own[rows] == k), *(b.column(c).take(pa.array(rows)) for c in ("rep", "weight", "raw"))], ["cell", "home", "rep", "weight", "raw"])

    spread = homes.mapInArrow(placed, "cell int, home boolean, rep long, weight long, raw binary")
    guests = dict.fromkeys(range(n_pivots), 1)
    for r in spread.filter("not home").groupBy("cell").count().collect():  # a row per pivot
        guests[r["cell"]] = -(-r["count"] // block)
    sizes = vectors.sparkSession.createDataFrame([(k, int(blocks[k]), guests[k]) for k in range(n_pivots)], "cell int, wide long, guests long")

    # home block i meets the home blocks j >= i, and every block of the cell's guests
    tasks = spread.join(sizes, "cell")
    tasks = tasks.withColumn("at", F.pmod(F.xxhash64("rep"), F.when(F.col("home"), F.col("wide")).otherwise(F.col("guests"))))
    meet_homes = F.transform(F.sequence(F.lit(0).cast("long"), F.col("wide") - 1), lambda k: F.struct(F.least(k, F.col("at")).alias("i"), F.greatest(k, F.col("at")).alias("j"), F.lit(0).alias("kind")))
    meet_guests = F.transform(F.sequence(F.lit(0).cast("long"), F.col("guests") - 1), lambda k: F.struct(F.col("at").alias("i"), k.alias("j"), F.lit(1).alias("kind")))
    meet_hosts = F.transform(F.sequence(F.lit(0).cast("long"), F.col("wide") - 1), lambda k: F.struct(k.alias("i"), F.col("at").alias("j"), F.lit(1).alias("kind")))
    tasks = tasks.withColumn("m", F.explode(F.when(F.col("home"), F.concat(meet_homes, meet_guests)).otherwise(meet_hosts)))
    tasks = tasks.select(F.concat_ws("-", "cell", "m.i", "m.j", "m.kind").alias("task"), "home", "at", F.col("m.i").alias("i"), F.col("m.j").alias("j"), F.col("m.kind").alias("kind"), "rep", "weight", "raw")

    def product(table: pa.Table) -> pa.Table:
        side = table.column("kind")[0].as_py()
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        at, home = (table.column(c).to_numpy(zero_copy_only=False) for c in ("at", "home"))
        rep, weight = table.column("rep").to_numpy(), table.column("weight").to_numpy()
        unit = _unit(table.column("raw").to_pylist(), kind)
        left = np.flatnonzero(at == i) if side == 0 else np.flatnonzero(home)
        right = np.flatnonzero(at == j) if side == 0 else np.flatnonzero(~home)
        same = side == 0 and i == j
        links = np.zeros(len(rep), np.int64)
        found_x, found_y = [], []
        single = unit.astype(np.float32)
        for lo in range(0, len(left), 512):
            rows = left[lo : lo + 512]
            c = single[rows] @ single[right].T
            x, y = np.nonzero(c >= cosine - NEAR)
            x, y = rows[x], right[y]
            close = c[c >= cosine - NEAR] < cosine + NEAR
            ok = ~close
            ok[close] = np.einsum("ij,ij->i", unit[x[close]], unit[y[close]]) >= cosine
            ok &= x != y
            x, y = x[ok], y[ok]
            np.add.at(links, x, weight[y])
            if not same:
                np.add.at(links, y, weight[x])
            part = labels(len(rep), x, y)
            tied = np.flatnonzero(part != np.arange(len(rep)))
            found_x.append(tied)
            found_y.append(part[tied])
        x, y = (np.concatenate(a) if a else np.zeros(0, np.int64) for a in (found_x, found_y))
        label = labels(len(rep), x, y)
        keep = np.flatnonzero(links)
        return pa.table({"rep": pa.array(rep[keep]), "links": pa.array(links[keep]), "other": pa.array(rep[label[keep]])})

    met = saved(each(tasks, "task", product, "rep long, links long, other long"))
    partners = met.groupBy("rep").agg(F.sum("links").alias("links"))
    found = components(met.filter("rep <> other").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    found = found.withColumnRenamed("node", "rep")
    least = found.join(classes.select("rep", "least"), "rep").groupBy("component").agg(F.min("least").alias("c"))
    found = found.join(least, "component").select("rep", "c")
    per_class = classes.select("key", "rep", "least", "weight").join(partners, "rep", "left").join(found, "rep", "left").select("key", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("c", "least").alias("c"))
    linked = keyed.select("vec_id", "key").join(per_class, "key").select("vec_id", F.col("n").alias("n_links"), F.col("c").alias("component_id"))
    alone = every.filter("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op4_embedding_join(spark, sf_dir: str) -> DataFrame:
    return embedding_join(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
