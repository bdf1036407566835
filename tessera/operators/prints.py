"""Function prints: which libraries an image holds and which release, from sets of features alone.

A library ``rule`` has prints (distinct feature sets of its functions), and each release holds some of them.  An image is a set of functions with
features.  Features vote through an inverted index; a print is found in a function that has most of its features
and is not far larger.  Of prints that are versions of one function only the closest votes on the release.
A release is judged by what contradicts it: the found prints that it lacks, weighted by their size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.graph import settled


@dataclass(frozen=True)
class Prints:
    """Fixed values of the method: features of a print and share of them that a function must have, how much larger it may be, prints of a
    library that may share a feature, what makes two prints versions of one function, features of full weight, contradiction within a range,
    and found prints and share of a release that claim a library (of large and of small ones)."""

    floor: int = 2
    containment: float = 0.7
    magnet: int = 16
    most_prints: int = 40
    same: float = 0.5
    full: int = 4
    range_width: float = 2.0
    matches: int = 5
    coverage: float = 0.12
    small_matches: int = 3
    small_coverage: float = 0.5


#: Image functions with one feature beyond which its rows are dealt to several tasks, and to how many.
HOT, SALTS = 10_000, 32


def salted_join(left: DataFrame, right: DataFrame, on: str, by: list[str], hot: int = HOT) -> DataFrame:
    """``left join right`` on ``on``; rows of ``left`` under a hot value are dealt by ``by`` to ``SALTS`` keys, where those of ``right`` are repeated."""
    heavy = left.groupBy(on).agg(F.count("*").alias("_n")).filter(F.col("_n") > hot).select(on, F.lit(SALTS).alias("_salts"))
    salts = F.coalesce("_salts", F.lit(1))
    a = left.join(heavy, on, "left").withColumn("_salt", F.pmod(F.xxhash64(*by), salts).cast("int")).drop("_salts")
    b = right.join(heavy, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return a.join(b, [on, "_salt"]).drop("_salt")


def reference_prints(functions: DataFrame, rules: Prints = Prints()) -> tuple[DataFrame, DataFrame]:
    """From ``functions(rule, release, fn long, features array)``: ``prints(rule, print, f, size)`` and ``holds(rule, print, release)``.

    Functions of a library with the same features are one print, called after the smallest ``fn``.
    """
    sets = functions.select("rule", "release", "fn", F.array_sort(F.array_distinct("features")).alias("features")).filter(F.size("features") >= rules.floor)
    sets = settled(sets.withColumn("digest", F.sha2(F.array_join("features", ","), 256)))
    named = settled(sets.groupBy("rule", "digest").agg(F.min("fn").alias("print")))
    holds = sets.join(named, ["rule", "digest"]).select("rule", "print", "release").distinct()
    prints = sets.join(named.withColumnRenamed("print", "fn"), ["rule", "digest", "fn"]).select("rule", F.col("fn").alias("print"), F.size("features").alias("size"), "features").dropDuplicates(["rule", "print"])
    return settled(prints.select("rule", "print", "size", F.explode("features").alias("f"))), settled(holds)


def _digest(features):
    return F.unhex(F.sha2(F.array_join(features, ","), 256))


def feature_lists(prints: DataFrame, rules: Prints = Prints()) -> DataFrame:
    """``rule, print, size, need, digest, features, indexed``: each print once, with features of at most ``most_prints`` prints of its library, rare ones first, and how many of those a function must have."""
    often = prints.withColumn("_df", F.count("*").over(Window.partitionBy("rule", "f")))
    lists = often.groupBy("rule", "print", "size").agg(F.array_sort(F.collect_list(F.struct("_df", "f"))).alias("x"))
    need = F.greatest(F.least(F.lit(rules.floor), F.col("size")), F.ceil(rules.containment * F.col("size"))).cast("int")
    features = F.array_sort(F.transform("x", lambda y: y["f"]))
    return settled(lists.select("rule", "print", "size", need.alias("need"), _digest(features).alias("digest"), features.alias("features"), F.transform(F.filter("x", lambda y: y["_df"] <= rules.most_prints), lambda y: y["f"]).alias("indexed")))


def found(image: DataFrame, lists: DataFrame, rules: Prints = Prints()) -> DataFrame:
    """``image, fn, rule, print, size, fn_size, shared``: the prints that functions of ``image(image, fn, f)``, or ``image(image, fn, features)``, hold, and how many features both have.

    Functions of an image with the same features are one, ``fn`` being the digest of these. ``lists`` are of ``feature_lists``. A function with ``need`` of a print's indexed
    features has one of the rarest ``indexed - need + 1``: only those look for functions. What is left is compared list by list, but for a function that is the print itself.
    """
    each = image.groupBy("image", "fn").agg(F.collect_list("f").alias("features")) if "f" in image.columns else image
    each = each.filter(F.size("features") >= rules.floor).withColumn("features", F.array_sort("features"))
    each = settled(each.select("image", _digest("features").alias("fn"), "features"))
    owners = each.select("image", "fn").distinct()
    sets = settled(each.groupBy("fn").agg(F.first("features").alias("features")).withColumn("fn_size", F.size("features").cast("long")).withColumn("key", F.xxhash64("fn")))
    # a short key of the digest travels with each feature; two sets of one key are both compared
    few = lists.filter(F.size("indexed") >= F.col("need"))
    prefix = few.select("rule", "print", "size", "need", F.explode(F.slice("indexed", 1, F.size("indexed") - F.col("need") + 1)).alias("f"))
    met = salted_join(sets.select("key", "fn_size", F.explode("features").alias("f")), prefix, "f", ["key"])
    met = met.filter((F.col("fn_size") >= F.col("need")) & (F.col("fn_size") <= rules.magnet * F.col("size"))).select("key", "rule", "print").distinct()
    near = met.join(few.select("rule", "print", F.xxhash64("digest").alias("own")), ["rule", "print"]).filter(F.col("key") != F.col("own")).drop("own")
    other = near.join(few.drop("digest").withColumnRenamed("features", "whole"), ["rule", "print"]).join(sets, "key")
    both = lambda c: F.size(F.array_intersect("features", c)).cast("long")
    other = other.filter(both("indexed") >= F.col("need")).select("fn", "rule", "print", "size", "fn_size", both("whole").alias("shared"))
    same = sets.select("fn", "fn_size").join(few.withColumnRenamed("digest", "fn"), "fn").select("fn", "rule", "print", "size", "fn_size", F.col("fn_size").alias("shared"))
    return owners.join(same.unionByName(other), "fn").select("image", "fn", "rule", "print", "size", "fn_size", "shared")


def best_fits(shared: DataFrame, lists: DataFrame, rules: Prints = Prints()) -> DataFrame:
    """``image, fn, rule, print`` of the rows of ``found`` that vote: of prints that share ``same`` of the smaller one, the closest to the function.

    A function finds few prints, as a feature leads to ``most_prints`` at most and a print needs most of its features: the list that is folded is short.
    """
    lone = Window.partitionBy("image", "fn", "rule")
    many = shared.withColumn("m", F.count("*").over(lone))
    # pairs of prints that some function holds both, once each, compared list by list
    held = shared.select("fn", "rule", "print").distinct()
    pairs = held.withColumnRenamed("print", "a").join(held.withColumnRenamed("print", "b"), ["fn", "rule"]).filter("a < b").select("rule", "a", "b").distinct()
    side = lambda c: lists.select("rule", F.col("print").alias(c), F.col("size").alias(f"size_{c}"), F.col("features").alias(f"features_{c}"))
    alike = pairs.join(side("a"), ["rule", "a"]).join(side("b"), ["rule", "b"]).filter(F.size(F.array_intersect("features_a", "features_b")) >= rules.same * F.least("size_a", "size_b")).select("rule", "a", "b")
    alike = settled(alike)
    rivals = alike.unionByName(alike.select("rule", F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("rule", F.col("a").alias("print")).agg(F.collect_list("b").alias("rivals"))
    union = F.col("size") + F.col("fn_size") - F.col("shared")
    ranked = many.filter("m > 1").join(rivals, ["rule", "print"], "left").select("image", "fn", "rule", F.struct((-F.col("shared") / union).alias("far"), (-F.col("shared") / F.col("size")).alias("missing"), "print", F.coalesce("rivals", F.expr("cast(array() as array<bigint>)")).alias("rivals")).alias("x"))
    none = F.expr("cast(array() as array<bigint>)")
    kept = F.aggregate(F.array_sort("xs"), none, lambda k, x: F.when(F.arrays_overlap(k, x["rivals"]), k).otherwise(F.array_append(k, x["print"])))
    chosen = ranked.groupBy("image", "fn", "rule").agg(F.collect_list("x").alias("xs")).select("image", "fn", "rule", F.explode(kept).alias("print"))
    return many.filter("m = 1").select("image", "fn", "rule", "print").unionByName(chosen)


def print_matches(image: DataFrame, prints: DataFrame, holds: DataFrame, rules: Prints = Prints()) -> DataFrame:
    """``image, rule, release, matched, own, coverage, low, high``: libraries in each image, the first of the best releases, and the range of those
    that are contradicted little more.  Releases are in the order of their values."""
    lists = feature_lists(prints, rules)
    matches = settled(found(image, lists, rules))
    fits = best_fits(matches, lists, rules)
    weight = F.least(F.lit(rules.full - 1), F.greatest(F.col("size") - 1, F.lit(1)))  # in parts of full - 1, so sums are exact
    sizes = lists.select("rule", "print", "size")
    anchored = matches.groupBy("image", "rule").agg(F.countDistinct("print").alias("direct")).filter(F.col("direct") >= rules.small_matches)
    voters = settled(fits.select("image", "rule", "print").distinct().join(sizes, ["rule", "print"]).withColumn("w", weight))
    total = anchored.join(voters.groupBy("image", "rule").agg(F.sum("w").alias("total")), ["image", "rule"])
    agree = voters.join(holds, ["rule", "print"]).groupBy("image", "rule", "release").agg(F.sum("w").alias("agree"))
    covered = matches.select("image", "rule", "print").distinct().join(holds, ["rule", "print"]).groupBy("image", "rule", "release").agg(F.count("*").alias("matched"))
    own = holds.groupBy("rule", "release").agg(F.count("*").alias("own"))
    every = total.join(own, "rule").join(agree, ["image", "rule", "release"], "left").join(covered, ["image", "rule", "release"], "left").fillna(0, ["agree", "matched"])
    scored = every.withColumn("against", F.col("total") - F.col("agree"))
    best = scored.groupBy("image", "rule").agg(F.min(F.struct("against", "release", "matched", "own")).alias("b"))
    near = scored.join(best, ["image", "rule"]).filter(F.col("against") <= F.col("b.against") + rules.range_width * (rules.full - 1))
    out = near.groupBy("image", "rule").agg(F.first("b").alias("b"), F.min("release").alias("low"), F.max("release").alias("high"))
    coverage = F.col("b.matched") / F.col("b.own")
    claim = F.when(F.col("b.matched") >= rules.matches, coverage >= rules.coverage).otherwise((F.col("b.matched") >= rules.small_matches) & (coverage >= rules.small_coverage))
    return out.filter(claim).select("image", "rule", "b.release", "b.matched", "b.own", coverage.alias("coverage"), "low", "high")


def strangers(image: DataFrame, prints: DataFrame, rules: Prints = Prints()) -> DataFrame:
    """``rule, images, pairs, hits, rate``: the negative control. ``image(image, truth, fn, f)`` or with ``features``; each library against all images that are not its own.

    Scores exist only for pairs with a shared feature; the pairs without any are counted by complement, not made.
    """
    held = found(image.drop("truth"), feature_lists(prints, rules), rules).groupBy("image", "rule").agg(F.countDistinct("print").alias("n")).filter(F.col("n") >= rules.small_matches)
    truth = image.select("image", "truth").distinct()
    hits = held.join(truth, "image").filter(F.col("truth") != F.col("rule")).groupBy("rule").agg(F.count("*").alias("hits"))
    by_truth = truth.groupBy("truth").agg(F.count("*").alias("own"))
    total = truth.agg(F.count("*").alias("images"))
    libraries = prints.select("rule").distinct()
    every = libraries.join(by_truth, F.col("rule") == F.col("truth"), "left").join(hits, "rule", "left").withColumn("one", F.lit(1)).join(total.withColumn("one", F.lit(1)), "one")
    pairs = F.col("images") - F.coalesce("own", F.lit(0))
    return every.select("rule", "images", pairs.alias("pairs"), F.coalesce("hits", F.lit(0)).cast("long").alias("hits"), F.when(pairs > 0, F.coalesce("hits", F.lit(0)) / pairs).otherwise(F.lit(0.0)).alias("rate"))
