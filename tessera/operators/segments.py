"""Whose a value is that several owners hold: the bundled owner's, when every other holder bundles it, else nobody's.

An owner is a component with releases; ``table(owner, release, h)`` has its values; with a column ``w``, ``h`` stands for that many values that the same releases hold.  A host bundles a part when nearly all of one release of
the part lies inside the host and what they share is a small share of the host.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.graph import settled


@dataclass(frozen=True)
class Bundling:
    """``least`` values and ``of_largest`` of the part's largest release make a release count; ``of_part`` of it inside a host,
    at most ``of_host`` of the host, is a bundle. Values of over ``most_owners`` owners are everybody's."""

    least: int = 40
    of_largest: float = 0.5
    of_part: float = 0.80
    of_host: float = 0.10
    most_owners: int = 16


def _weighed(table: DataFrame) -> DataFrame:
    w = F.col("w") if "w" in table.columns else F.lit(1)
    return settled(table.select("owner", "release", "h", w.alias("w")).distinct())


def shared_pairs(table: DataFrame, rules: Bundling) -> tuple[DataFrame, DataFrame]:
    """``h, w, host, part`` for values that both hold, by joinable values only; and ``owner, n`` (distinct values).

    A value joins ``most_owners`` owners at most, which bounds the pairs of a value; values of more owners join nothing.
    Pairs that share too little for the smallest release that counts are dropped before anything else is asked of them.
    """
    own = table.select("owner", "h", "w").distinct()
    size = own.groupBy("owner").agg(F.sum("w").alias("n"))
    held = own.join(own.groupBy("h").agg(F.count("*").alias("c")).filter(F.col("c").between(2, rules.most_owners)).select("h"), "h", "left_semi")
    both = held.select("h", "w", F.col("owner").alias("host")).join(held.select("h", F.col("owner").alias("part")), "h").filter("host <> part")
    return both, size


def release_sizes(table: DataFrame, rules: Bundling) -> DataFrame:
    """``part, release, size`` of releases that are large enough to prove anything."""
    size = table.groupBy(F.col("owner").alias("part"), "release").agg(F.sum("w").alias("size"))
    largest = F.max("size").over(Window.partitionBy("part"))
    return size.withColumn("largest", largest).filter((F.col("size") >= rules.least) & (F.col("size") >= rules.of_largest * F.col("largest"))).drop("largest")


def holdings(table: DataFrame, rules: Bundling = Bundling()) -> DataFrame:
    """``host, part, shared, host_share, release, inside, size, state`` of each pair in which a host holds nearly all of a release of the part.

    ``release`` is the one held most completely, the latest of equals.  ``state``: kept (a small share of its host), lineage (each holds a
    release of the other: a fork or a split) or lost (a copy that is too large a share of its host).
    """
    table = _weighed(table)
    both, size = shared_pairs(table, rules)
    pairs = settled(both.groupBy("host", "part").agg(F.sum("w").alias("shared")).filter(F.col("shared") >= rules.of_part * rules.least))
    return settled(_inside(table, both, pairs, size, rules))


def _inside(table: DataFrame, both: DataFrame, pairs: DataFrame, size: DataFrame, rules: Bundling) -> DataFrame:
    sizes = release_sizes(table, rules)
    common = both.join(pairs.select("host", "part"), ["host", "part"], "left_semi")
    inside = common.join(table.select(F.col("owner").alias("part"), "release", "h"), ["part", "h"]).groupBy("host", "part", "release").agg(F.sum("w").alias("inside"))
    whole = inside.join(sizes, ["part", "release"]).filter(F.col("inside") >= rules.of_part * F.col("size"))
    best = whole.groupBy("host", "part").agg(F.max(F.struct((F.col("inside") / F.col("size")).alias("share"), "release", "inside", "size")).alias("b"))
    found = best.join(pairs, ["host", "part"]).join(size.select(F.col("owner").alias("host"), "n"), "host")
    found = found.select("host", "part", "shared", (F.col("shared") / F.col("n")).alias("host_share"), "b.release", "b.inside", "b.size")
    back = found.select(F.col("part").alias("host"), F.col("host").alias("part"), F.lit(True).alias("mutual"))
    state = F.when(F.col("host_share") <= rules.of_host, "kept").when(F.col("mutual"), "lineage").otherwise("lost")
    return found.join(back, ["host", "part"], "left").withColumn("state", state).drop("mutual")


def segmented(table: DataFrame, rules: Bundling = Bundling()) -> DataFrame:
    """``h, owners, owner``: whose each value is; null where it is nobody's.

    Relational division: of the holders of a value the one that all the others bundle.  A holder that carries only a part of a bundled
    owner counts as bundling it for values that some whole copy holds, too.
    """
    table = _weighed(table)
    both, size = shared_pairs(table, rules)
    both = settled(both)
    all_pairs = settled(both.groupBy("host", "part").agg(F.sum("w").alias("shared")).join(size.select(F.col("owner").alias("host"), "n"), "host").filter(F.col("shared") <= rules.of_host * F.col("n")).select("host", "part", "shared"))
    found = _inside(table, both, all_pairs.filter(F.col("shared") >= rules.of_part * rules.least), size, rules)
    bundles = settled(found.filter("state = 'kept'").select("host", "part").withColumn("whole", F.lit(1)))
    # part of an owner that somebody bundles whole, where neither bundles the other
    partial = all_pairs.join(bundles.select("part").distinct(), "part", "left_semi").join(bundles, ["host", "part"], "left_anti")
    partial = partial.join(bundles.select(F.col("part").alias("host"), F.col("host").alias("part")), ["host", "part"], "left_anti").select("host", "part", F.lit(0).alias("whole"))
    kin = bundles.unionByName(partial)
    votes = both.join(kin, ["host", "part"]).groupBy("h", F.col("part").alias("owner")).agg(F.count("*").alias("votes"), F.sum("whole").alias("whole"))
    own = table.select("owner", "h").distinct().groupBy("h").agg(F.count("*").alias("owners"), F.min("owner").alias("sole"))
    keeper = votes.join(own.select("h", "owners"), "h").filter("votes = owners - 1 and whole >= 1").groupBy("h").agg(F.min("owner").alias("keeper"))
    return own.join(keeper, "h", "left").select("h", "owners", F.when(F.col("owners") == 1, F.col("sole")).otherwise(F.col("keeper")).alias("owner"))
