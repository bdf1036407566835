"""Trials of the engine itself: recorded evidence derived again, and recall on mutated copies with known truth."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import hashing
from tessera.functions.bind import let


def differences(recorded: DataFrame, derived: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """``<keys>, reason, field, recorded, derived``: every way in which evidence derived again is not what was recorded.

    ``missing``: recorded, but not derived again; ``unrecorded``: derived, but not recorded; ``changed``: a field has another value, a row for
    each such field; ``repeated``: a side has a key more than once. Keys and values are compared null-safely.
    """
    side = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(f"n_{name}"), *[F.min(F.struct(F.col(v).isNull().alias("z"), F.col(v).cast("string").alias("v")))["v"].alias(f"{v}_{name}") for v in values])
    a, b = side(recorded, "r"), side(derived, "d").withColumnsRenamed({k: f"_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    met = a.join(b, on, "full_outer")
    # a key that is null on purpose has a count on its side
    key = [F.when(F.col("n_r").isNotNull(), F.col(k)).otherwise(F.col(f"_{k}")).alias(k) for k in keys]
    note = lambda reason, field, r, d: F.struct(F.lit(reason).alias("reason"), F.lit(field).alias("field"), r.alias("recorded"), d.alias("derived"))
    none = F.lit(None).cast("string")
    whole = F.array(
        F.when(F.col("n_d").isNull(), note("missing", None, none, none)),
        F.when(F.col("n_r").isNull(), note("unrecorded", None, none, none)),
        F.when(F.greatest(F.coalesce("n_r", F.lit(0)), F.coalesce("n_d", F.lit(0))) > 1, note("repeated", None, F.col("n_r").cast("string"), F.col("n_d").cast("string"))),
        *[F.when(F.col("n_r").isNotNull() & F.col("n_d").isNotNull() & ~F.col(f"{v}_r").eqNullSafe(F.col(f"{v}_d")), note("changed", v, F.col(f"{v}_r"), F.col(f"{v}_d"))) for v in values],
    )
    return met.select(*key, F.explode(F.array_compact(whole)).alias("x")).select(*keys, "x.*")


def draw(key: str, *parts: Column) -> Column:
    """A number from 0 to 99 that ``key`` and ``parts`` decide, the same on every system."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(key), *parts)), 1, 8), 16, 10).cast("long") % 100


def drawn(words: Column, key: str) -> Column:
    """Each word with its two numbers: for being called otherwise (the same wherever it stands) and for being gone from its place."""
    return F.transform(words, lambda w, i: F.struct(w.alias("word"), draw(key, F.lit("rename"), w).alias("rename"), draw(key, F.lit("delete"), i.cast("string")).alias("delete")))


def applied(draws: Column, rename: Column, delete: Column) -> Column:
    """The words of ``drawn`` that are left at these rates, under the names that they then have."""

    def changed(x: Column) -> Column:
        kept = F.filter(x["draws"], lambda d: d["delete"] >= x["delete"])
        return F.transform(kept, lambda d: F.when(d["rename"] < x["rename"], F.concat(F.lit("zz"), d["word"])).otherwise(d["word"]))

    return let(F.struct(draws.alias("draws"), rename.alias("rename"), delete.alias("delete")), changed)


def mutated(words: Column, rename: Column, delete: Column, key: str) -> Column:
    """Words as a vendor's copy would have them: of the distinct words ``rename`` per cent are called otherwise, each wherever it stands, and of the
    places ``delete`` per cent are gone."""
    return applied(drawn(words, key), rename, delete)


#: Least percentages of the recall bands.
BANDS = {"strong": 80, "partial": 50, "weak": 20}


def _draw(key: bytes, what: bytes, part: bytes) -> int:
    return int(hashlib.md5(b"|".join((key, what, part))).hexdigest()[:8], 16) % 100


def _tried(batches: Iterable[pa.RecordBatch], rates: list[tuple[int, int]], k: int, key: bytes) -> Iterator[pa.RecordBatch]:
    gone = np.zeros(0, np.int8)
    for batch in batches:
        sums = np.zeros((len(rates), 2 + len(BANDS)), np.int64)
        for text in batch.column(0):
            raw = text.as_py().encode()
            start, end = hashing.words(raw)
            if not len(start):
                continue
            if len(gone) < len(start):
                gone = np.append(gone, np.array([_draw(key, b"delete", b"%d" % i) for i in range(len(gone), 2 * len(start))], np.int8))
            plain = hashing.spans(np.frombuffer(raw, np.uint8).astype(np.uint64), start, end, hashing.BYTE_BASE)
            # the same polynomial with two letters before the word
            powers = hashing._power(hashing.BYTE_BASE, int((end - start).max()) + 2)
            other = hashing.final(plain + (powers[end - start] + powers[end - start + 1]) * hashing.U64(ord("z")))
            word = hashing.final(plain)
            _, at, back = np.unique(word, return_index=True, return_inverse=True)
            draws = np.array([_draw(key, b"rename", raw[start[i] : end[i]]) for i in at.tolist()], np.int8)[back]
            known = np.unique(hashing.runs(word, k))
            for n, (rename, delete) in enumerate(rates):
                copy = np.where(draws < rename, other, word)[gone[: len(word)] >= delete]
                held = len(np.intersect1d(known, np.unique(hashing.runs(copy, k)), assume_unique=True))
                pct = held * 100 // len(known)
                sums[n] += [1, *(pct >= least for least in BANDS.values()), pct]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (*np.array(rates).T, *sums.T)], ["rename", "delete", "docs", *BANDS, "total_pct"])


def recall(texts: DataFrame, rates: list[tuple[int, int]], k: int, key: str) -> DataFrame:
    """``rename, delete, docs, strong, partial, weak, total_pct``: how much of each ``text``'s shingles its copy, as ``mutated`` makes it at each of ``rates``, still has.

    Words are hashed and drawn once for a text, whatever the rates; a batch leaves as one row of sums for each rate.
    """
    schema = ", ".join(f"{c} long" for c in ("rename", "delete", "docs", *BANDS, "total_pct"))
    sums = texts.select(F.lower(F.coalesce("text", F.lit(""))).alias("text")).mapInArrow(lambda batches: _tried(batches, rates, k, key.encode()), schema)
    return sums.groupBy("rename", "delete").agg(*[F.sum(c).alias(c) for c in ("docs", *BANDS, "total_pct")]).filter("docs > 0")
