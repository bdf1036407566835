"""Competing claims: the winner of a group, its alternatives, merges and folds of conflicting records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed: states of a match, the most serious first.
STATES = ("exploitable", "in_triage", "not_affected", "resolved", "false_positive")


def winners(claims: DataFrame, by: list[str], order: list[Column], name: str, confidence: str, share: float = 0.6, most: int = 3) -> DataFrame:
    """Each group's first claim with ``alternatives``: up to ``most`` names of other claims of ``share`` of its confidence.

    Claims that ``order`` leaves equal go by name, then by their other columns, so neither the winner nor its alternatives depend on
    how rows are dealt; both are read off one pass.
    """
    rest = [F.asc(c) for c in claims.columns if c not in (*by, name)]
    w = Window.partitionBy(*by).orderBy(*order, F.asc(name), *rest)
    ranked = claims.withColumn("_n", F.row_number().over(w)).withColumn("_top", F.first(confidence).over(w)).withColumn("_name", F.first(name).over(w))
    rival = (F.col("_n") > 1) & (F.col(confidence) >= share * F.col("_top")) & (F.col(name) != F.col("_name"))
    ranked = ranked.withColumn("_k", F.sum(rival.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    others = F.collect_list(F.when(rival & (F.col("_k") <= most), F.struct("_k", name))).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    best = ranked.withColumn("_others", others).filter("_n = 1")
    names = F.transform(F.array_sort("_others"), lambda x: x[name].cast("string"))
    return best.select(*claims.columns, F.array_join(names, ",").alias("alternatives"))


def first_wins(df: DataFrame, key: list[str], order: str, values: list[str]) -> DataFrame:
    """One row per key; each value is the one of the lowest ``order`` among those that are not null. An aggregate: no key is sorted in one task."""
    return df.groupBy(*key).agg(*[F.min_by(v, F.when(F.col(v).isNotNull(), F.col(order))).alias(v) for v in values])


def state_rank(state: Column) -> Column:
    out = F.lit(len(STATES))
    for k, s in enumerate(STATES):
        out = F.when(state == s, k).otherwise(out)
    return out


def state_of(verdict: Column, distro: Column, fork: Column) -> Column:
    """Outside the range: not affected; undecided, a distribution's package or a fork: triage; else exploitable."""
    return F.when(~verdict, "not_affected").when(verdict.isNull() | F.coalesce(distro, F.lit(False)) | F.coalesce(fork, F.lit(False)), "in_triage").otherwise("exploitable")


def merged_states(matches: DataFrame, by: list[str]) -> DataFrame:
    """One state per vulnerability and component from rows ``channel, state, authoritative, unplaced``.

    A restatement of the sequential fold that does not depend on the order of rows: an authoritative
    verdict stands; then, rows that place the version outrank those that cannot; then, an exploitable and a
    not-affected from different channels leave it to a person; else the most serious state.
    """
    placed = ~F.col("unplaced")
    return (
        matches.groupBy(*by)
        .agg(
            F.min(F.when(F.col("authoritative"), state_rank(F.col("state")))).alias("_authority"),
            F.min(F.when(placed, state_rank(F.col("state")))).alias("_placed"),
            F.min(state_rank(F.col("state"))).alias("_any"),
            F.array_sort(F.collect_set(F.when(placed & (F.col("state") == "exploitable"), F.col("channel")))).alias("_hit"),
            F.array_sort(F.collect_set(F.when(placed & (F.col("state") == "not_affected"), F.col("channel")))).alias("_miss"),
        )
        .withColumn("_disputed", (F.size("_hit") > 0) & (F.size("_miss") > 0) & (F.size(F.array_union("_hit", "_miss")) > 1))
        .withColumn("_rank", F.coalesce(F.col("_authority"), F.when(F.col("_disputed"), F.lit(1)), F.col("_placed"), F.col("_any")))
        .select(*by, F.element_at(F.array(*[F.lit(s) for s in STATES]), F.col("_rank") + 1).alias("state"))
    )


def state_summary(matches: DataFrame) -> DataFrame:
    """``state, n`` over all states, zero where none."""
    every = matches.sparkSession.createDataFrame([(s,) for s in STATES], "state string")
    return every.join(matches.groupBy("state").count(), "state", "left").select("state", F.coalesce("count", F.lit(0)).alias("n"))


def worst_per_key(df: DataFrame, key: list[str], tie: list[Column]) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(state_rank(F.col("state")), *tie)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def full_diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """``key, change, old, new``: added, removed or changed rows by lower-case key; equal rows are left out."""
    a = old.select(F.lower(key).alias("k"), F.col(value).alias("old"), F.lit(True).alias("in_old"))
    b = new.select(F.lower(key).alias("k"), F.col(value).alias("new"), F.lit(True).alias("in_new"))
    both = a.join(b, "k", "full_outer")
    change = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return both.withColumn("change", change).filter("change is not null").select(F.col("k").alias(key), "change", "old", "new")


def confidence(identity: Column, version: Column, has_version: Column) -> Column:
    """Half of the identity's without a version, else the lesser of both."""
    return F.when(has_version, F.least(identity, version)).otherwise(identity / 2)


def completeness(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """``element, passed, total, share`` of each minimum element."""
    aggs = [F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in checks.items()]
    wide = df.agg(F.count("*").alias("_total"), *aggs)
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("element"), F.col(n).alias("passed")) for n in checks]))
    return wide.select("_total", pairs.alias("x")).select("x.element", "x.passed", F.col("_total").alias("total"), (F.col("x.passed") / F.col("_total")).alias("share"))
