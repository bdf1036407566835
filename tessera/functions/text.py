"""Tokens, shingles, hashes and winnowing as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.bind import let


def tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits, lower case; null text has none."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), F.array().cast("array<string>"))


def shingles(words: Column, k: int) -> Column:
    """Each run of ``k`` words joined by a space; a shorter non-empty list is one shingle."""

    def cut(w: Column) -> Column:
        n = F.size(w)
        long = F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.array_join(F.slice(w, i, k), " "))
        return F.when(n >= k, long).when(n > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>"))

    return let(words, cut)


def h60(x: Column) -> Column:
    """A portable non-negative 60-bit hash: signed and unsigned order agree, so bottom-k does, too."""
    return F.conv(F.substring(F.md5(x), 1, 15), 16, 10).cast("long")


def fingerprints(words: Column, k: int) -> Column:
    return F.transform(shingles(words, k), h60)


def winnow(hashes: Column, window: int) -> Column:
    """Distinct minima of each window; a list of at most ``window`` has one minimum."""

    def minima(h: Column) -> Column:
        n = F.size(h)
        many = F.array_distinct(F.transform(F.sequence(F.lit(1), n - window + 1), lambda i: F.array_min(F.slice(h, i, window))))
        return F.when(n > window, many).when(n > 0, F.array(F.array_min(h))).otherwise(F.array().cast("array<bigint>"))

    return let(hashes, minima)


def bottom_k(hashes: Column, k: int) -> Column:
    """The ``k`` smallest distinct hashes, ascending. ``bottom_k(concat(a, b))`` merges sketches exactly."""
    return F.slice(F.array_sort(F.array_distinct(hashes)), 1, k)


def kmv_similarity(a: Column, b: Column, k: int) -> Column:
    """Share of the m smallest hashes of both sketches together that both have; m is the smaller size, k at most."""
    m = F.least(F.size(a), F.size(b), F.lit(k))
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, F.greatest(m, F.lit(1)))
    return F.when(m > 0, F.size(F.array_intersect(F.array_intersect(union, a), b)) / m).otherwise(F.lit(0.0))


# Fixed: samples of a fix's windows and of whole bodies; a removed set under SEAM is only the edge of an insertion.
SAMPLE, BODY, SEAM = 128, 64, 8


def near_diff(before: Column, after: Column, tree: Column, most: float = 0.80, few: float = 0.25, related: float = 0.50, signal: int = 3) -> Column:
    """Where an edited function stands between two bodies, by shingle sets: fixed, vulnerable, unclear or unrelated; null where a fix is too small to tell."""
    added, removed = F.array_except(after, before), F.array_except(before, after)
    sets = F.struct(bottom_k(added, SAMPLE).alias("added"), bottom_k(removed, SAMPLE).alias("removed"), bottom_k(before, BODY).alias("before"), bottom_k(after, BODY).alias("after"), (F.size(added) + F.size(removed)).alias("changed"), tree.alias("tree"))

    def kin(x: Column, side: str) -> Column:
        """Similarity of the tree and a sampled body, over as many of the lowest hashes as both have."""
        return kmv_similarity(bottom_k(x["tree"], BODY), x[side], BODY)

    def share(x: Column, part: str) -> Column:
        return F.when(F.size(x[part]) > 0, F.size(F.array_intersect(x[part], x["tree"])) / F.size(x[part]))

    def verdict(x: Column) -> Column:
        fix, hole = share(x, "added"), F.when(F.size(x["removed"]) >= SEAM, share(x, "removed"))
        near = F.struct(fix.alias("fix"), hole.alias("hole"), kin(x, "before").alias("b"), kin(x, "after").alias("a"))
        said = let(
            near,
            lambda y: F.when(F.greatest(y["a"], y["b"]) < related, "unrelated")
            .when((y["fix"] >= most) & (y["hole"].isNull() | (y["hole"] <= few)), "fixed")
            .when((y["hole"] >= most) & (y["fix"].isNull() | (y["fix"] <= few)), "vulnerable")
            .when(y["hole"].isNull() & (y["fix"] <= few) & (y["b"] >= y["a"]), "vulnerable")
            .otherwise("unclear"),
        )
        return F.when((x["changed"] >= signal) & (F.size(x["before"]) > 0) & (F.size(x["after"]) > 0), said)

    return let(sets, verdict)
