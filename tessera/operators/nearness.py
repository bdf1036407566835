"""Pairs of documents that are nearly the same: exact Jaccard over word shingles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.bind import let
from tessera.functions.text import shingles
from tessera.operators.graph import settled

# Fixed: words of a shingle, and the least similarity in hundredths.
WORDS, PERCENT = 5, 80
# Bounds of what tells common hashes: documents looked at, hashes kept.
SAMPLE, COMMON = 5000, 1000


def words(text: Column) -> Column:
    """Runs of anything but ASCII white space, ASCII letters in lower case."""
    folded = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(F.coalesce(folded, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))


def shingle_sets(docs: DataFrame) -> DataFrame:
    """``doc_id, h, n``: the distinct 64-bit hashes of each document's shingles, ascending; documents without words have no row.

    A text shorter than a shingle has itself as its only one, which no longer text has.
    """
    cut = let(words(F.col("text")), lambda w: F.when(F.size(w) < WORDS, F.transform(shingles(w, WORDS), lambda x: F.concat(x, F.lit("\n")))).otherwise(shingles(w, WORDS)))
    h = F.array_sort(F.array_distinct(F.transform(cut, lambda x: F.xxhash64(x))))
    return docs.select("doc_id", h.alias("h")).filter(F.size("h") > 0).withColumn("n", F.size("h"))


def rare_first(sets: DataFrame) -> DataFrame:
    """``sets`` with ``h`` in one order for all: hashes that many rows of a bounded sample have come last.

    Any common order gives the same pairs; this one keeps common passages out of the join.
    """
    some = sets.select("doc_id").orderBy(F.xxhash64("doc_id")).limit(SAMPLE)
    common = sets.join(some, "doc_id").select(F.explode("h").alias("x")).groupBy("x").agg(F.count("*").alias("c")).filter("c > 2").orderBy(F.desc("c"), "x").limit(COMMON)
    one = common.agg(F.collect_list("x").alias("common"))
    return sets.crossJoin(F.broadcast(one)).select("doc_id", "n", F.concat(F.array_except("h", "common"), F.array_intersect("h", "common")).alias("h"))


def set_pairs(sets: DataFrame) -> DataFrame:
    """``a, b, o, n``: each two rows of ``sets(doc_id, h, n)`` with the similarity asked for, their shared and their united hashes.

    Two such sets share one of their first ``n - ceil(PERCENT * n / 100) + 1`` hashes in any common order, their sizes are
    as near, and after the first hash that they share enough are left.
    """
    # integers: 4 of 5 hashes are no rounding matter
    first = F.expr(f"n - int((n * {PERCENT} + 99) div 100) + 1")
    rows = rare_first(sets).select("doc_id", "n", F.posexplode(F.slice("h", 1, first)).alias("p", "x"))
    a, b = (rows.select(F.col("doc_id").alias(c), F.col("n").alias(f"n{c}"), F.col("p").alias(f"p{c}"), "x") for c in "ab")
    near = (F.col("nb") * 100 >= F.col("na") * PERCENT) & (F.col("na") * 100 >= F.col("nb") * PERCENT)
    left_over = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    enough = left_over * (100 + PERCENT) >= (F.col("na") + F.col("nb")) * PERCENT
    candidates = settled(a.join(b, "x").filter(F.col("a") < F.col("b")).filter(near & enough).select("a", "b").distinct())
    left, right = sets.select(F.col("doc_id").alias("a"), F.col("h").alias("ha")), sets.select(F.col("doc_id").alias("b"), F.col("h").alias("hb"))
    both = candidates.join(left, "a").join(right, "b").select("a", "b", F.size(F.array_intersect("ha", "hb")).alias("o"), (F.size("ha") + F.size("hb")).alias("s"))
    return both.select("a", "b", "o", (F.col("s") - F.col("o")).alias("n")).filter(F.col("o") * 100 >= F.col("n") * PERCENT)


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``doc_id, rep`` for each document with words, the smallest id with an equal set; the sets of those.

    Both are written: what follows reads them several times, and only one set of a class is compared.
    """
    sets = settled(shingle_sets(docs))
    keyed = sets.select("doc_id", "n", F.xxhash64("h").alias("k"), F.element_at("h", 1).alias("least"))
    least = keyed.groupBy("n", "k", "least").agg(F.min("doc_id").alias("rep"))
    members = settled(keyed.join(least, ["n", "k", "least"]).select("doc_id", "rep"))
    return members, settled(sets.join(members.filter("doc_id = rep").select("doc_id"), "doc_id", "left_semi"))


def near_pairs(docs: DataFrame) -> DataFrame:
    """``a, b, similarity``, ``a < b``: the pairs of classes, each by its smallest id, and each class's members.

    Documents with equal sets are one class. A row of similarity 1 says that ``b`` is of the class of ``a``; other rows
    are of two representatives. Rows grow with the copies, not with their square, and no link between
    different texts is left out. Documents without words have no row.
    """
    members, sets = _classes(docs)
    return set_pairs(sets).select("a", "b", (F.col("o") / F.col("n")).alias("similarity")).unionByName(_copies(members).withColumn("similarity", F.lit(1.0)))


def near_links(docs: DataFrame) -> DataFrame:
    """``a, b``: links that join whatever is near; equal sets by one link each."""
    members, sets = _classes(docs)
    return set_pairs(sets).select("a", "b").unionByName(_copies(members))


def _copies(members: DataFrame) -> DataFrame:
    return members.filter("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
