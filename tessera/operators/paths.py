"""Trees of paths: ancestors, the nearest enclosing one, and what a match above or below shadows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ancestors(path: Column) -> Column:
    """Proper ancestors of a slash-separated path, nearest the root first, however deep it is."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    n = F.size(parts) - 1
    return F.when(n >= 1, F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).otherwise(F.array().cast("array<string>"))


def clean(path: Column) -> Column:
    return F.array_join(F.filter(F.split(path, "/"), lambda x: x != ""), "/")


def exploded(df: DataFrame, path: str = "path") -> DataFrame:
    """``df`` with a row for each ``ancestor``: a prefix join becomes an equi-join."""
    return df.withColumn("ancestor", F.explode(ancestors(F.col(path))))


def nearest_enclosing(df: DataFrame, holders: DataFrame, key: str, path: str = "path") -> DataFrame:
    """``df`` with ``holder``: the longest of ``holders(holder)`` that encloses ``path`` or is it, null if none."""
    own = df.select(key, path)
    up = exploded(own, path).select(key, F.col("ancestor").alias("holder")).unionByName(own.select(key, clean(F.col(path)).alias("holder")))
    found = up.join(holders.select("holder").distinct(), "holder").groupBy(key).agg(F.max_by("holder", F.length("holder")).alias("holder"))
    return df.join(found, key, "left")


def without_nested(df: DataFrame, key: list[str], path: str = "path") -> DataFrame:
    """Rows that no row of equal ``key`` encloses."""
    tops = df.select(*key, clean(F.col(path)).alias("ancestor")).distinct()
    return df.join(exploded(df.select(*key, path).distinct(), path).join(tops, [*key, "ancestor"], "left_semi").select(*key, path).distinct(), [*key, path], "left_anti")


def without_shadowed(df: DataFrame, score: str, path: str = "path") -> DataFrame:
    """Rows below which no row scores at least as much: a broad match gives way to the place that explains it."""
    below = exploded(df.select(path, score), path).groupBy("ancestor").agg(F.max(score).alias("below"))
    return df.withColumn("ancestor", clean(F.col(path))).join(below, "ancestor", "left").filter(F.col("below").isNull() | (F.col("below") < F.col(score))).drop("ancestor", "below")


def outside(df: DataFrame, holders: DataFrame, path: str = "path") -> DataFrame:
    """Rows that none of ``holders(holder)`` encloses."""
    inside = exploded(df.select(path).distinct(), path).join(holders.select(F.col("holder").alias("ancestor")).distinct(), "ancestor", "left_semi").select(path).distinct()
    return df.join(inside, path, "left_anti")


def located(files: DataFrame, wanted: DataFrame, deepest: int = 4) -> DataFrame:
    """``wanted_path, path``: the exact path, else the one file of that name at most ``deepest`` levels down, else null."""
    named = files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), (F.size(F.split("path", "/")) - 1).alias("depth"))
    want = wanted.select("wanted_path", F.element_at(F.split("wanted_path", "/"), -1).alias("name"))
    exact = want.join(files.select(F.col("path").alias("wanted_path")).distinct().withColumn("exact", F.col("wanted_path")), "wanted_path", "left")
    only = named.filter(F.col("depth") <= deepest).groupBy("name").agg(F.count("*").alias("n"), F.min("path").alias("only")).filter("n = 1").select("name", "only")
    return exact.join(only, "name", "left").select("wanted_path", F.coalesce("exact", "only").alias("path"))


def ranked(df: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
