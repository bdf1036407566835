"""How filters interact: what each removes in every order in which they can be applied.

Texts are scanned as they lie in Arrow buffers: classes of bytes and prefix sums count words, characters, capitals and
symbols.  Distinct words are sorted word hashes of one document at a time, and
neighbours with equal hashes are verified byte by byte.  Each document becomes a mask with a bit for each filter that it fails;
a digest of the text tells copies.  From then on nothing but masks, digests and ids moves:

* masks meet labels by id, and are counted by digest, language, mask and label, with the least id;
  a text that a third of all rows share is one row per task before the exchange;
* of each digest all but the rows of the least id fail the copy filter, wherever a copy was removed;
* counts by part and mask (at most 32 masks) give every order and step.  A filter is the first to remove
  a document with ``k`` failures in ``1 / k`` of the orders, which is its Shapley share.

Defined cases: a null text is an empty one; a null language is the part ``""``, as is an empty one; a null id is not smaller than
any, nor is any smaller than it, so it neither fails as a copy nor makes others fail, and it has no label;
rows with the same id do not make each other copies; a document with several labels is good (toxic) if one of them says so; an empty
table has no parts; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.slots import tidy
from tessera.llm.textbits import byte_prefix, chunks, flat, span_hash, word_bounds

FILTERS = "ABCDE"


@dataclass(frozen=True)
class Limits:
    """When a document fails: fewer words than A, less than B per cent distinct, over C per cent capitals, any sign of D."""

    words: int = 200
    distinct: int = 50
    capitals: int = 3
    signs: bytes = b"#$%&*|"


_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True


def counted(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many bytes of ``mask`` each document has."""
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return np.diff(total[offsets])


def same_bytes(buf: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Are the ``n`` bytes from ``a`` on those from ``b`` on, for each entry; no ``n`` is 0."""
    first = np.cumsum(n) - n
    step = np.arange(int(n.sum())) - np.repeat(first, n)
    return np.logical_and.reduceat(buf[np.repeat(a, n) + step] == buf[np.repeat(b, n) + step], first)


def distinct_words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and distinct words of each document."""
    starts, ends, first = word_bounds(buf, offsets)
    n_words = np.diff(first)
    if not len(starts):
        return n_words, n_words
    owner = np.repeat(np.arange(len(n_words)), n_words)
    hashes = span_hash(byte_prefix(buf), starts, ends)
    order = np.lexsort((hashes, owner))
    h, o, s, n = hashes[order], owner[order], starts[order], (ends - starts)[order]
    again = np.flatnonzero((h[1:] == h[:-1]) & (o[1:] == o[:-1])) + 1
    out = n_words - np.bincount(o[again], minlength=len(n_words))
    true = n[again] == n[again - 1]
    if true.any():
        true[true] = same_bytes(buf, s[again[true]], s[again[true] - 1], n[again[true]])
    for k in np.unique(o[again[~true]]).tolist():  # two words share a hash: count the document's words themselves
        i, j = first[k], first[k + 1]
        out[k] = len({buf[a:z].tobytes() for a, z in zip(starts[i:j].tolist(), ends[i:j].tolist(), strict=True)})
    return n_words, out


def masks(column: pa.Array, limits: Limits) -> np.ndarray:
    """Bits 0 to 3 of each text: does it fail A, B, C, D."""
    buf, offsets = flat(column)
    signs = np.zeros(256, bool)
    signs[list(limits.signs)] = True
    out = np.zeros(len(offsets) - 1, np.int32)
    for i, j in chunks(offsets):
        lo = offsets[i]
        part, at = buf[lo : offsets[j]], offsets[i : j + 1] - lo
        n_words, n_distinct = distinct_words(part, at)
        n_chars, capitals = counted((part & 0xC0) != 0x80, at), counted(_CAPITAL[part], at)
        fails = (n_words < limits.words, 100 * n_distinct < limits.distinct * n_words, 100 * capitals > limits.capitals * n_chars, counted(signs[part], at) > 0)
        out[i:j] = sum(f.astype(np.int32) << k for k, f in enumerate(fails))
    return out


def failures(docs: DataFrame, limits: Limits, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """``doc_id, part, digest, mask`` of each document, bit ``k`` of the mask for filter ``k`` of A to D."""

    def judge(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("part"), part.column("digest"), pa.array(masks(part.column("text"), limits), pa.int32())], ["doc_id", "part", "digest", "mask"])
            tidy()

    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))
    return rows.mapInArrow(judge, "doc_id long, part string, digest binary, mask int")


def counts(docs: DataFrame, labels: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``part, mask, n, n_good, n_toxic``: documents of each part by the filters that they fail, bits 0 to 4 for A to E."""
    label = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic")).filter("doc_id is not null").groupBy("doc_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    own = failures(docs, limits, id_col, text_col, lang_col).join(label, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    # by text, part, mask and label: how many, of how many the id is the least; a null id counts apart
    same = ["digest", "part", "mask", "good", "toxic"]
    by_id = own.groupBy(*same, "doc_id").agg(F.count("*").alias("n"))
    by_text = by_id.groupBy(*same).agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("n_null"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first"))
    least = F.min("first.doc_id").over(_by("digest"))
    copies = by_text.withColumn("least", least)
    first = F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(F.lit(0)) + F.col("n_null")
    split = F.explode(F.array(F.struct(F.col("mask"), first.alias("n")), F.struct(F.col("mask").bitwiseOR(F.lit(16)).alias("mask"), (F.col("n") - first).alias("n"))))
    out = copies.select("part", "good", "toxic", split.alias("x")).filter("x.n > 0")
    return out.groupBy("part", F.col("x.mask").alias("mask")).agg(F.sum("x.n").alias("n"), F.sum(F.when(F.col("good"), F.col("x.n")).otherwise(0)).alias("n_good"), F.sum(F.when(F.col("toxic"), F.col("x.n")).otherwise(0)).alias("n_toxic"))


def _by(column: str):
    from pyspark.sql import Window

    return Window.partitionBy(column)


def steps() -> list[F.Column]:
    """Columns of a row for each order and step: ``filter_order, step``, bit of the step's filter, bits of those before it."""
    orders = F.lit(",".join("".join(x) for x in itertools.permutations(FILTERS)))
    length = len(FILTERS)
    order = F.split(orders, ",")[F.floor(F.col("at") / length).cast("int")]
    step = (F.col("at") % length + 1).cast("int")
    bit = F.element_at(F.array(*[F.lit(1 << k) for k in range(length)]), F.instr(F.lit(FILTERS), F.substring(order, step, F.lit(1))))
    before = sum((F.when(F.instr(F.substring(order, F.lit(1), step - 1), name) > 0, F.lit(1 << k)).otherwise(F.lit(0)) for k, name in enumerate(FILTERS)), F.lit(0))
    return [order.alias("filter_order"), step.alias("step"), bit.alias("bit"), before.alias("before")]


def audit(counted_: DataFrame) -> DataFrame:
    """A row for each part, order and step, from ``counts``."""
    by_part = counted_.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "n_good", "n_toxic")).alias("masks"))  # 32 at most
    share = math.factorial(len(FILTERS))
    every = by_part.select("part", "masks", F.explode(F.sequence(F.lit(0), F.lit(share * len(FILTERS) - 1))).alias("at")).select("part", "masks", *steps())
    bit, before = F.col("bit"), F.col("before")

    def total(value: str, when) -> F.Column:
        return F.aggregate(F.filter("masks", when), F.lit(0).cast("long"), lambda t, x: t + x[value])

    def fails(x):
        return x["mask"].bitwiseAND(bit) != 0

    def gone(x):
        return x["mask"].bitwiseAND(before) != 0

    def removed(x):
        return fails(x) & ~gone(x)

    return every.select(
        "part",
        "filter_order",
        "step",
        total("n", lambda x: ~gone(x) & ~fails(x)).alias("kept"),
        total("n", removed).alias("removed"),
        total("n", lambda x: fails(x) & gone(x)).alias("redundant"),
        total("n", lambda x: x["mask"] == bit).alias("unique_fails"),
        total("n_good", removed).alias("good_lost"),
        total("n_toxic", removed).alias("toxic_lost"),
        F.aggregate(F.filter("masks", fails), F.lit(0).cast("long"), lambda t, x: t + (x["n"] * share / F.bit_count(x["mask"])).cast("long")).alias("shapley"),
    )


def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    return audit(counts(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))))


ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
e AS (SELECT text, min(doc_id) AS least FROM t GROUP BY 1),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
d AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, map {'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w), 'C': 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * len(text), 'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(least < doc_id, false)} AS f
  FROM t JOIN e USING (text) LEFT JOIN l USING (doc_id)),
m AS (SELECT part, good, toxic, [k FOR k IN ['A', 'B', 'C', 'D', 'E'] IF f[k]] AS f FROM d),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT [a.x, b.x, c.x, d.x, e.x] AS o FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT o, unnest(range(1, 6)) AS step FROM o),
k AS (SELECT o, step, o[step] AS own, o[1:step - 1] AS before FROM s),
c AS (SELECT part, f, count(*) AS n, count_if(good) AS n_good, count_if(toxic) AS n_toxic FROM m GROUP BY 1, 2),
r AS (SELECT part, o, step, own,
  coalesce(sum(n) FILTER (WHERE NOT list_has_any(f, before) AND NOT list_contains(f, own)), 0)::BIGINT AS kept,
  coalesce(sum(n) FILTER (WHERE NOT list_has_any(f, before) AND list_contains(f, own)), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (WHERE list_has_any(f, before) AND list_contains(f, own)), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (WHERE f = [own]), 0)::BIGINT AS unique_fails,
  coalesce(sum(n_good) FILTER (WHERE NOT list_has_any(f, before) AND list_contains(f, own)), 0)::BIGINT AS good_lost,
  coalesce(sum(n_toxic) FILTER (WHERE NOT list_has_any(f, before) AND list_contains(f, own)), 0)::BIGINT AS toxic_lost
  FROM c, k GROUP BY 1, 2, 3, 4)
SELECT part, array_to_string(o, '') AS filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r
"""
