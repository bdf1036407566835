"""Merkle manifest of a dataset: leaves, a root for each group, a root of the roots, and a proof for each leaf.

A leaf is the SHA-256 of a row's columns; of a group's leaves, in order, every ``fan`` consecutive nodes become
their digest, level by level, the last run as it is.

Leaves are a hundred bytes each and are made in one pass over the table.  They are range-sorted
by group and key; counts of each group in each partition give the offset at which a partition goes on with a group.
Each partition then builds all subtrees that lie whole inside it.  At its ends ragged
nodes are left over, a few for each level; those are shuffled by their coordinate (group, level, index), some levels
at a time, until the roots are there.  Group roots are the leaves of one more such forest.  At last
each partition builds its subtrees again and hands down to its leaves the way from its ragged nodes to the root.
No task holds more than a partition of leaves or ``MEET`` nodes.  A hot group is spread by the range sort;
equal rows are told apart by a number, so they are spread, too.

Defined cases: a null column counts as ``-``; a null group comes first; null keys come last; rows with equal keys are ordered by
their leaves, so the roots do not depend on the order of rows, and repeated rows are leaves of their own; an
empty table has no rows and no roots; columns that are not named are ignored.
"""

# no postponed annotations: Spark tells functions of tables from functions of batches by their types
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.shared import saved
from tessera.llm.slots import tidy

FAN = 2
#: Leaves in a partition, about so many at most.
LEAVES = 1 << 17
#: Nodes that meet at a coordinate, at most (``fan``, if that is more).
MEET = 256
#: Leaves whose proofs are written at a time.
SLICE = 1 << 12
STEP = "array<struct<before:string,after:string>>"
_STEP = pa.struct([("before", pa.string()), ("after", pa.string())])
_STEPS = pa.list_(_STEP)


def digest_of(columns: Iterable[Column]) -> Column:
    """Digest of values: ``-`` for null, else the number of its bytes in UTF-8, ``:`` and itself."""
    text = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in text]), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that ``leaf`` and its proof (siblings before and after on each level) lead to."""
    return F.aggregate(proof, leaf, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]), 256))


# ---- whole subtrees over consecutive nodes ---------------------------------------------


def _parent(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def width_at(level: int, n: int, fan: int) -> int:
    for _ in range(level):
        n = -(-n // fan)
    return n


def subtrees(nodes: list[str], first: int, n: int, fan: int) -> tuple[list[tuple[int, list[str]]], list[tuple[int, int, str]]]:
    """Of leaves ``first`` and on of a group of ``n``: each level's first index and nodes; ``(level, index, digest)`` of nodes whose parent is not here."""
    levels, ragged, level = [], [], 0
    while True:
        levels.append((first, nodes))
        end = first + len(nodes)
        lo, hi = -(-first // fan), -(-end // fan) if end == n else end // fan
        if n == 1 or lo >= hi:
            return levels, ragged + [(level, i, nodes[i - first]) for i in range(first, end)]
        ragged += [(level, i, nodes[i - first]) for i in (*range(first, lo * fan), *range(hi * fan, end))]
        nodes = [_parent(nodes[k * fan - first : (k + 1) * fan - first]) for k in range(lo, hi)]
        first, n, level = lo, -(-n // fan), level + 1


def steps(levels: list[tuple[int, list[str]]], fan: int) -> list[tuple[int, list[str], list[str]]]:
    """Of each level but the last: index of the first node with a parent here, and siblings before and after each such node."""
    out = []
    for (first, nodes), (lo, parents) in zip(levels, levels[1:], strict=False):
        start = lo * fan
        before, after = [], []
        for k in range(lo, lo + len(parents)):
            run = nodes[k * fan - first : (k + 1) * fan - first]
            before += ["".join(run[:i]) for i in range(len(run))]
            after += ["".join(run[i + 1 :]) for i in range(len(run))]
        out.append((start, before, after))
    return out


# ---- partitions of leaves --------------------------------------------------------------

_FIELDS = {"part": "int", "at": "long", "grp": "string", "leaf": "string", "first": "long", "n": "long", "level": "int", "idx": "long", "path": STEP, "roots": "struct<subroot:string,root:string>"}


def ranged(leaves: DataFrame, order: list[Column]) -> DataFrame:
    """``leaves(grp, leaf, carry)`` in range-sorted partitions: ``part`` and ``at`` number the partitions and the rows in them."""
    spark = leaves.sparkSession
    leaves = saved(leaves.withColumn("salt", F.monotonically_increasing_id()))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-leaves.count() // LEAVES))
    order = [F.col("grp").asc_nulls_first(), *order, F.col("leaf").asc(), F.col("salt").asc()]
    out = leaves.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return saved(out.select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"), "grp", "leaf", "carry"))


def _rows(df: DataFrame, *more: str, carry: str | None = None) -> DataFrame:
    """``df`` in the common form of rows that meet in a partition."""
    have = set(df.columns)
    columns = [(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in _FIELDS.items()]
    if carry:
        columns.append((F.col("carry") if "carry" in have else F.lit(None)).cast(carry).alias("carry"))
    return df.select(*columns)


def _groups(batches: Iterator[pa.RecordBatch]):
    """Of one partition: its leaves in order, then for each group the rows that describe it, by its first leaf."""
    table = pa.Table.from_batches(list(batches))
    leaf = pc.is_valid(table.column("leaf"))
    leaves = table.filter(leaf).sort_by("at").combine_chunks()
    notes: dict[int, list[dict]] = {}
    for x in table.drop_columns([c for c in ("carry", "leaf") if c in table.column_names]).filter(pc.invert(leaf)).to_pylist():
        notes.setdefault(x["at"], []).append(x)
    return leaves, [notes[k] for k in sorted(notes)]


def ragged(table: DataFrame, fan: int) -> DataFrame:
    """The nodes that partitions cannot raise alone: ``part, at, grp, first, n, level, idx, digest``."""
    found = table.groupBy("grp", "part").agg(F.count("*").alias("m"), F.min("at").alias("at"))
    by = Window.partitionBy("grp")
    found = found.select("part", "at", "grp", (F.sum("m").over(by.orderBy("part")) - F.col("m")).alias("first"), F.sum("m").over(by).alias("n"), "m")
    # the count of leaves travels in ``idx``
    both = _rows(table.select("part", "at", "leaf")).unionByName(_rows(found.withColumn("idx", F.col("m"))))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaves, notes = _groups(batches)
        nodes, k = leaves.column("leaf").to_pylist(), 0
        for (x,) in notes:
            m = x["idx"]
            top = subtrees(nodes[k : k + m], x["first"], x["n"], fan)[1]
            k += m
            yield pa.RecordBatch.from_pylist([x | {"level": level, "idx": i, "digest": d} for level, i, d in top], _TOP)
        tidy()

    return saved(both.groupBy("part").applyInArrow(build, "part int, at long, grp string, first long, n long, level int, idx long, digest string"))


_TOP = pa.schema([("part", pa.int32()), ("at", pa.int64()), ("grp", pa.string()), ("first", pa.int64()), ("n", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("digest", pa.string())])
_LIFTED = pa.schema([*_TOP, ("way", _STEPS), ("up_level", pa.int32()), ("up", pa.int64()), ("up_digest", pa.string())])


def lifted(nodes: DataFrame, until: int, fan: int) -> DataFrame:
    """Each node with its way to the node of level ``until`` (or the root) above it; nodes meet by that coordinate."""

    def build(table: pa.Table) -> pa.Table:
        rows = table.drop_columns(["meet"]).to_pylist()
        n = rows[0]["n"]
        known: dict[tuple[int, int], str] = {(x["level"], x["idx"]): x["digest"] for x in rows}
        ways: dict[tuple[int, int], dict] = {}
        level, top = min(x["level"] for x in rows), until
        width = width_at(level, n, fan)
        while level < until:
            if width == 1:
                top = level
                break
            here = sorted(i for at, i in known if at == level)
            for k in sorted({i // fan for i in here}):
                run = range(k * fan, min((k + 1) * fan, width))
                own = [known[level, i] for i in run]
                for j, i in enumerate(run):
                    ways[level, i] = {"before": "".join(own[:j]), "after": "".join(own[j + 1 :])}
                known[level + 1, k] = _parent(own)
            level, width = level + 1, -(-width // fan)
        for x in rows:
            level, i, way = x["level"], x["idx"], []
            while level < top:
                way.append(ways[level, i])
                level, i = level + 1, i // fan
            x |= {"way": way, "up_level": level, "up": i, "up_digest": known[level, i]}
        return pa.Table.from_pylist(rows, _LIFTED)

    # of a coordinate: the index above, at level ``until``
    meet = nodes.withColumn("meet", F.expr(f"idx div cast(round(power({fan}, {until} - level)) as bigint)"))
    return saved(meet.groupBy("grp", "meet").applyInArrow(build, f"part int, at long, grp string, first long, n long, level int, idx long, digest string, way {STEP}, up_level int, up long, up_digest string"))


def risen(tops: DataFrame, fan: int) -> DataFrame:
    """``tops`` with ``path`` (steps to the root of the group) and ``root``."""
    lift = 1
    while fan ** (lift + 1) <= MEET:
        lift += 1
    most = tops.agg(F.max("n")).first()[0] or 1
    height = 0
    while width_at(height, most, fan) > 1:
        height += 1
    rounds, nodes = [], tops.filter(F.col("level") < lift)
    for until in range(lift, height + 1 + lift, lift):  # the last is above the roots
        rounds.append(lifted(nodes, until, fan))
        up = rounds[-1].filter(F.col("up_level") == until).groupBy("grp", "n", "up").agg(F.min("up_digest").alias("digest"))
        carried = up.select(F.lit(None).cast("int").alias("part"), F.lit(None).cast("long").alias("at"), "grp", F.lit(None).cast("long").alias("first"), "n", F.lit(until).alias("level"), F.col("up").alias("idx"), "digest")
        nodes = carried.unionByName(tops.filter((F.col("level") >= until) & (F.col("level") < until + lift)))
    known = None
    for rows in reversed(rounds):
        if known is None:
            out = rows.select("*", F.col("way").alias("path"), F.col("up_digest").alias("root"))
        else:
            above = known.filter("part is null").select(F.col("grp").alias("g"), F.col("level").alias("l"), F.col("idx").alias("i"), F.col("path").alias("rest"), F.col("root").alias("high"))
            met = rows.join(above, F.col("grp").eqNullSafe(F.col("g")) & (F.col("up_level") == F.col("l")) & (F.col("up") == F.col("i")), "left")
            out = met.select(*rows.columns, F.concat("way", F.coalesce("rest", F.expr(f"cast(array() as {STEP})"))).alias("path"), F.coalesce("high", "up_digest").alias("root"))
        columns = [c for c in out.columns if c not in ("way", "up_level", "up", "up_digest", "digest")]
        out = out.select(columns)
        known = out if known is None else out.unionByName(known.filter("part is not null"))
    return saved(known.filter("part is not null"))


def proved(table: DataFrame, tops: DataFrame, fan: int) -> DataFrame:
    """``grp, carry, leaf, position, n, subroot, root, proof`` of each leaf; ``tops`` has ``path`` and ``roots``."""
    carry = table.schema["carry"].dataType.simpleString()
    both = _rows(table, carry=carry).unionByName(_rows(tops, carry=carry))
    kind = table.limit(0).toArrow().schema.field("carry").type
    schema = pa.schema([("grp", pa.string()), ("carry", kind), ("leaf", pa.string()), ("position", pa.int64()), ("n", pa.int64()), ("subroot", pa.string()), ("root", pa.string()), ("proof", _STEPS)])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaves, notes = _groups(batches)
        k = 0
        for tops_ in notes:
            x = tops_[0]
            m = _length(tops_, fan)
            own = leaves.slice(k, m)
            k += m
            levels = subtrees(own.column("leaf").to_pylist(), x["first"], x["n"], fan)[0]
            known = steps(levels, fan)
            # all steps in one array: of each level, then of the paths above
            before = [s for _, b, _ in known for s in b] + [s["before"] for t in tops_ for s in t["path"]]
            after = [s for _, _, a in known for s in a] + [s["after"] for t in tops_ for s in t["path"]]
            store = pa.StructArray.from_arrays([pa.array(before, pa.string()), pa.array(after, pa.string())], fields=list(_STEP))
            base = np.cumsum([0, *(len(b) for _, b, _ in known)])
            above = int(base[-1]) + np.cumsum([0, *(len(t["path"]) for t in tops_)])
            for top in sorted(range(len(tops_)), key=lambda j: tops_[j]["idx"] * fan ** tops_[j]["level"]):
                t = tops_[top]
                depth, reach = t["level"], fan ** t["level"]
                a, z = max(t["idx"] * reach, x["first"]), min((t["idx"] + 1) * reach, x["first"] + m)
                for lo in range(a, z, SLICE):
                    at = np.arange(lo, min(z, lo + SLICE))
                    ids = [base[e] + at // fan**e - known[e][0] for e in range(depth)]
                    ids += [np.full(len(at), i) for i in range(above[top], above[top + 1])]
                    size = len(ids)
                    flat = np.stack(ids, 1).ravel() if size else np.zeros(0, np.int64)
                    proof = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * size, pa.int32()), store.take(pa.array(flat)))
                    rows = own.slice(lo - x["first"], len(at)).combine_chunks()
                    same = {c: pa.array([v] * len(at), t_) for c, v, t_ in (("n", x["n"], pa.int64()), ("subroot", t["roots"]["subroot"], pa.string()), ("root", t["roots"]["root"], pa.string()))}
                    columns = {"grp": pa.array([x["grp"]] * len(at), pa.string()), "carry": rows.column("carry"), "leaf": rows.column("leaf"), "position": pa.array(at), "proof": proof} | same
                    yield from pa.table({c: columns[c] for c in schema.names}).cast(schema).combine_chunks().to_batches()
        tidy()

    return both.groupBy("part").applyInArrow(build, f"grp string, carry {carry}, leaf string, position long, n long, subroot string, root string, proof {STEP}")


def _length(tops: list[dict], fan: int) -> int:
    """How many leaves the nodes of one partition and group stand for."""
    end = max((t["idx"] + 1) * fan ** t["level"] for t in tops)
    return min(end, tops[0]["n"]) - tops[0]["first"]


def forest(leaves: DataFrame, order: list[Column], fan: int) -> tuple[DataFrame, DataFrame]:
    """Range-sorted leaves, and the ragged nodes of their partitions with path and root."""
    table = ranged(leaves, order)
    return table, risen(ragged(table, fan), fan)


def manifest(docs: DataFrame, columns: Iterable[str], group: str = "lang", keys: Iterable[str] = ("doc_id",), fan: int = FAN, carry: dict[str, Column] | None = None) -> DataFrame:
    """``group, <keys>, <carry>, leaf, position, n`` (leaves of the group), ``subroot, root, proof``; ``fold(leaf, proof)`` is the root.

    ``carry`` names expressions over ``docs`` that stay with the rows.
    """
    if fan < 2:
        raise ValueError("fan must be 2 at least")
    keys, carry = list(keys), carry or {}
    own = F.struct(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)], *[c.alias(f"c{i}") for i, c in enumerate(carry.values())], F.lit(0).alias("one"))
    leaves = docs.select(F.col(f"`{group}`").cast("string").alias("grp"), digest_of(F.col(f"`{c}`") for c in columns).alias("leaf"), own.alias("carry"))
    table, tops = forest(leaves, [F.col(f"carry.k{i}").asc_nulls_last() for i in range(len(keys))], fan)
    subroots = tops.groupBy("grp").agg(F.min("root").alias("leaf")).select(F.lit("").alias("grp"), "leaf", F.struct(F.col("grp").alias("of")).alias("carry"))
    high, high_tops = forest(subroots, [F.col("carry.of").asc_nulls_first()], fan)
    high_tops = high_tops.withColumn("roots", F.struct(F.col("root").alias("subroot"), F.col("root").alias("root")))
    up = saved(proved(high, high_tops, fan).select(F.col("carry.of").alias("of"), F.col("leaf").alias("subroot"), "root", F.col("proof").alias("rest")))
    joined = tops.drop("root").join(up, F.col("grp").eqNullSafe(F.col("of")))
    tops = joined.select("part", "at", "grp", "first", "n", "level", "idx", F.concat("path", "rest").alias("path"), F.struct("subroot", "root").alias("roots"))
    out = proved(table, tops, fan)
    return out.select(F.col("grp").alias(group), *[F.col(f"carry.k{i}").alias(k) for i, k in enumerate(keys)], *[F.col(f"carry.c{i}").alias(c) for i, c in enumerate(carry)], "leaf", "position", "n", "subroot", "root", "proof")


COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    forged = F.when(tampered, digest_of(F.col(c) + 1 if c == "n_chars" else F.col(c) for c in COLUMNS))
    out = manifest(docs, COLUMNS, carry={"forged": forged})
    siblings = F.aggregate("proof", F.lit(""), lambda t, s: F.concat(t, s["before"], s["after"]))
    folded = out.withColumn("folded_root", fold(F.coalesce("forged", "leaf"), F.col("proof")))
    return folded.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


ORACLE_SQL = r"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
d AS (SELECT *, coalesce(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 0) AS x FROM documents, crc),
p AS (SELECT *, coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS head,
  coalesce(octet_length(encode(text)) || ':' || text, '-') AS tail, doc_id IS NOT NULL AND xor(x, 4294967295) % 7 = 0 AS bad FROM d),
f AS (SELECT *, sha256(head || coalesce(len(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf, sha256(head || coalesce(len((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || tail) AS forged FROM p),
l AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS LAST, leaf) - 1 AS pos, row_number() OVER (ORDER BY lang NULLS FIRST, doc_id NULLS LAST, leaf) AS id FROM f),
n AS (SELECT DISTINCT lang FROM l),
g AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS grp FROM n),
b AS (SELECT l.*, grp FROM l JOIN g ON l.lang IS NOT DISTINCT FROM g.lang),
t(grp, level, idx, h, n) AS (
  SELECT grp, 0, pos, leaf, count(*) OVER (PARTITION BY grp) FROM b
  UNION ALL SELECT grp, level + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (max(n) + 1) // 2 FROM t WHERE n > 1 GROUP BY grp, level, idx // 2),
s AS (SELECT grp, h AS subroot, level AS height FROM t WHERE n = 1),
u(level, idx, h, n) AS (
  SELECT 0, grp, subroot, count(*) OVER () FROM s
  UNION ALL SELECT level + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (max(n) + 1) // 2 FROM u WHERE n > 1 GROUP BY level, idx // 2),
r AS (SELECT h AS root, level AS height FROM u WHERE n = 1),
w(id, k, idx, acc, sib, grp, up) AS (
  SELECT id, 0, pos, CASE WHEN bad THEN forged ELSE leaf END, '', b.grp, false FROM b
  UNION ALL SELECT w.id, CASE WHEN w.k = s.height AND NOT w.up THEN 0 ELSE w.k + 1 END, CASE WHEN NOT w.up AND w.k = s.height THEN w.grp ELSE w.idx // 2 END,
    CASE WHEN NOT w.up AND w.k = s.height THEN w.acc WHEN w.idx % 2 = 1 THEN sha256(coalesce(t.h, u.h, '') || w.acc) ELSE sha256(w.acc || coalesce(t.h, u.h, '')) END,
    CASE WHEN NOT w.up AND w.k = s.height THEN w.sib ELSE w.sib || coalesce(t.h, u.h, '') END, w.grp, w.up OR w.k = s.height
  FROM w JOIN s ON s.grp = w.grp CROSS JOIN r
  LEFT JOIN t ON NOT w.up AND w.k < s.height AND t.grp = w.grp AND t.level = w.k AND t.idx = xor(w.idx, 1)
  LEFT JOIN u ON w.up AND u.level = w.k AND u.idx = xor(w.idx, 1)
  WHERE NOT w.up OR w.k < r.height)
SELECT b.doc_id, b.leaf, s.subroot, r.root, sha256(w.sib) AS proof_sha256, w.acc AS folded_root, w.acc = r.root AS verified
FROM b JOIN s USING (grp) CROSS JOIN r JOIN w ON w.id = b.id AND w.up AND w.k = r.height
"""
