"""Pattern inventories with capped evidence, dated policies and weighted signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed: statuses from the best.
STATUS = ("ok", "due", "deprecated", "fail")


def hits(df: DataFrame, key: str, text: str, patterns: dict[str, str]) -> DataFrame:
    """``key, family, n``: how often each pattern occurs in each text; one scan, one pass per pattern."""
    counts = F.explode(F.array(*[F.struct(F.lit(f).alias("family"), F.regexp_count(F.col(text), F.lit(p)).cast("long").alias("n")) for f, p in patterns.items()]))
    return df.select(key, counts.alias("x")).select(key, "x.family", "x.n").filter("n > 0")


def capped(found: DataFrame, by: str, n: str, tie: str, most: int = 20) -> DataFrame:
    """Each family's first ``most`` occurrences, largest ``n`` first, with ``rank``, and its ``total`` over all.

    Parts of a family are ranked alone before their best meet, so a frequent family is never sorted in one task.
    """
    order = [F.desc(n), F.asc(tie)]
    part = F.pmod(F.xxhash64(tie), F.lit(64))
    best = found.withColumn("_part", part).withColumn("rank", F.row_number().over(Window.partitionBy(by, "_part").orderBy(*order))).filter(F.col("rank") <= most)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("rank") <= most).drop("_part")
    return best.join(found.groupBy(by).agg(F.sum(n).alias("total")), by)


def policy_status(as_of: Column, deprecated_after: Column, disallowed_after: Column) -> Column:
    """No dates: fail; past the second: fail; past the first: deprecated; else due."""
    return F.when(deprecated_after.isNull() & disallowed_after.isNull(), "fail").when(as_of > disallowed_after, "fail").when(as_of > deprecated_after, "deprecated").otherwise("due")


def worst_status(status: Column) -> Column:
    rank = F.max(F.array_position(F.array(*[F.lit(s) for s in STATUS]), status))
    return F.element_at(F.array(*[F.lit(s) for s in STATUS]), rank.cast("int"))


def signals(df: DataFrame, key: str, weights: dict[str, tuple[float, Column]], threshold: float) -> DataFrame:
    """``key, score, reasons`` of rows whose weighted signals reach ``threshold``."""
    score = F.lit(0.0)
    for weight, holds in weights.values():
        score = score + F.when(holds, weight).otherwise(0.0)
    reasons = F.array_join(F.array_compact(F.array(*[F.when(h, F.lit(n)) for n, (_, h) in weights.items()])), ",")
    return df.select(key, score.alias("score"), reasons.alias("reasons")).filter(F.col("score") >= threshold)


def metrics(df: DataFrame, by: str, truth: Column, said: Column) -> DataFrame:
    """Recall and precision per group and overall (null group), by grouping sets."""
    rows = df.select(F.col(by), F.coalesce(truth, F.lit(False)).alias("t"), F.coalesce(said, F.lit(False)).alias("s"))
    got = rows.rollup(by).agg(F.count_if(F.col("t") & F.col("s")).alias("hits"), F.count_if("t").alias("wanted"), F.count_if("s").alias("said"), F.grouping(by).alias("overall"))
    return got.select(by, "overall", "hits", "wanted", "said", F.when(F.col("wanted") > 0, F.col("hits") / F.col("wanted")).alias("recall"), F.when(F.col("said") > 0, F.col("hits") / F.col("said")).alias("precision"))


def patch_verdict(fixed_exact: Column, hole_exact: Column, fixed_abstract: Column, hole_abstract: Column, named: Column) -> Column:
    """State of one function: exact matches decide, then abstract ones, then the name alone."""
    return F.when(fixed_exact, "fixed").when(hole_exact, "vulnerable").when(fixed_abstract & ~hole_abstract, "fixed").when(hole_abstract & ~fixed_abstract, "vulnerable").when(named, "modified").otherwise("absent")


def patch_state(functions: DataFrame, by: list[str]) -> DataFrame:
    """One state from those of a patch's functions: all alike, else partial; absent functions say nothing."""
    has = lambda s: F.bool_or(F.col("state") == s)
    wide = functions.groupBy(*by).agg(has("fixed").alias("f"), has("vulnerable").alias("v"), has("modified").alias("m"))
    return wide.select(*by, F.when(F.col("f") & F.col("v"), "partial").when(F.col("v"), "vulnerable").when(F.col("f") & F.col("m"), "partial").when(F.col("f"), "fixed").when(F.col("m"), "modified").otherwise("absent").alias("state"))
