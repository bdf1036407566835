"""Selection among the directories of a tree: a directory stands for all below it only where it says more than they do together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.graph import settled
from tessera.operators.paths import exploded


def majorities(files: DataFrame, signals: list[str], cost: int = 1) -> DataFrame:
    """``path, files, score`` of each directory over ``files(path, <signals>)``.

    A signal (a name's prefix, a holder) says as much as its most frequent value has files more than all others have; files
    without a value count against it. ``cost`` is what naming a directory takes off, so one directory beats two that say the same.
    """
    below = exploded(files).select(F.col("ancestor").alias("path"), *signals)
    out = below.groupBy("path").agg(F.count("*").alias("files"))
    score = F.lit(-cost).cast("long")
    for k, s in enumerate(signals):
        most = below.filter(F.col(s).isNotNull()).groupBy("path", s).agg(F.count("*").alias("n")).groupBy("path").agg(F.max("n").alias(f"most_{k}"))
        out = out.join(most, "path", "left")
        score = score + 2 * F.coalesce(f"most_{k}", F.lit(0)) - F.col("files")
    return out.select("path", "files", score.alias("score"))


def parent(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")


def selected(directories: DataFrame) -> DataFrame:
    """``path, score, below`` of the directories to report, from ``directories(path, score)``.

    A dynamic program, the deepest level first: a directory is worth its own score or the sum of what its children are worth,
    whichever is more; it is taken where its own score is positive and more.  Of those, what no taken one encloses is reported.
    ``below`` is what the children were worth.  Each level is one join with the sums of the level under it, written once.
    """
    rows = settled(directories.select("path", "score", F.size(F.split("path", "/")).alias("depth"), parent(F.col("path")).alias("parent")))
    taken = sums = None
    for depth in range(rows.agg(F.max("depth")).first()[0] or 0, 0, -1):
        here = rows.filter(F.col("depth") == depth).select("path", "parent", "score")
        here = here.join(sums, here["path"] == sums["of"], "left").drop("of") if sums is not None else here.withColumn("below", F.lit(0).cast("long"))
        here = settled(here.withColumn("below", F.coalesce("below", F.lit(0))))
        sums = here.groupBy(F.col("parent").alias("of")).agg(F.sum(F.greatest("score", "below", F.lit(0))).alias("below"))
        own = here.filter((F.col("score") > F.col("below")) & (F.col("score") > 0)).select("path", "score", "below")
        taken = own if taken is None else taken.unionByName(own)
    if taken is None:
        return rows.select("path", "score", F.lit(0).cast("long").alias("below"))
    taken = settled(taken)
    inner = exploded(taken.select("path")).join(taken.select(F.col("path").alias("ancestor")), "ancestor", "left_semi").select("path").distinct()
    return taken.join(inner, "path", "left_anti")
