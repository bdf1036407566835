"""Reachability and groups over edge tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _folder(spark: SparkSession) -> str:
    """The folder that all executors see; the warehouse stands in for it where executors are in this process."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
    return f"{path or spark.conf.get('spark.sql.warehouse.dir').rstrip('/') + '/_shared'}/graph-{spark.sparkContext.applicationId}"


def forget(spark: SparkSession) -> None:
    """Delete what ``settled`` has written in this application, once no result that rests on it is wanted."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def settled(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read again, so lineage and plan end here."""
    path = f"{_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def reachable(edges: DataFrame, seeds: DataFrame, depth: int = 12) -> DataFrame:
    """``seed, vertex, hops``: everything within ``depth`` edges of ``seeds(seed, vertex)``, by its shortest path.

    One frontier for all seeds at once; visited vertices leave it by an anti-join.  Edges are written once, so
    no hop computes them again.
    """
    edges = settled(edges.select("src", "dst").distinct())
    seen = settled(seeds.select("seed", "vertex").distinct().withColumn("hops", F.lit(0)))
    frontier = seen
    for hop in range(1, depth + 1):
        step = frontier.join(edges, frontier["vertex"] == edges["src"]).select("seed", F.col("dst").alias("vertex")).distinct()
        frontier = settled(step.join(seen, ["seed", "vertex"], "left_anti").withColumn("hops", F.lit(hop)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def groups(links: DataFrame) -> DataFrame:
    """``node, component``: smallest node of each connected group of ``links(a, b)``.

    Rounds go on until no label moves.  Each halves the way of a label along a chain, so they grow with the logarithm of the longest one.
    """
    edges = settled(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    label = settled(edges.groupBy("a").agg(F.least("a", F.min("b")).alias("component")).withColumnRenamed("a", "node"))
    moving = True
    while moving:
        near = edges.join(label, edges["b"] == label["node"]).groupBy("a").agg(F.min("component").alias("near"))
        step = label.join(near, label["node"] == near["a"]).select("node", F.least("component", "near").alias("component"), (F.col("near") < F.col("component")).alias("moved"))
        # jump to the label's own label, which halves long chains
        hop = step.select(F.col("node").alias("component"), F.col("component").alias("next"))
        step = settled(step.join(hop, "component", "left").select("node", F.least("component", F.coalesce("next", "component")).alias("component"), "moved"))
        label = step.select("node", "component")
        moving = not step.filter("moved").isEmpty()
    return label


def call_edges(functions: DataFrame) -> DataFrame:
    """``src, dst, directory`` from ``functions(directory, name, calls array)``: a call goes to the definition of its directory, else to any."""
    defined = functions.select("directory", "name").distinct()
    calls = functions.select("directory", F.col("name").alias("src"), F.explode("calls").alias("dst"))
    near = calls.join(defined.withColumnRenamed("name", "dst"), ["directory", "dst"], "left_semi")
    far = calls.join(near, ["directory", "src", "dst"], "left_anti").join(defined.select(F.col("name").alias("dst")).distinct(), "dst", "left_semi")
    return near.select("src", "dst", "directory").unionByName(far.select("src", "dst", "directory")).distinct()


def reach_verdict(symbols: DataFrame, defined: DataFrame, reached: DataFrame, discarded: DataFrame) -> DataFrame:
    """``symbol, verdict``: reachable, discarded by the linker, unreachable, or absent from the sources."""
    flag = lambda t, n: t.select("symbol").distinct().withColumn(n, F.lit(True))
    j = symbols.join(flag(defined, "d"), "symbol", "left").join(flag(reached, "r"), "symbol", "left").join(flag(discarded, "x"), "symbol", "left")
    return j.select("symbol", F.when(F.col("x"), "discarded").when(F.col("r"), "reachable").when(F.col("d"), "unreachable").otherwise("absent").alias("verdict"))


def prose_symbols(text):
    """Function names that advisory prose gives: before ``()``, after "function", before "function", in backticks; distinct, in order."""
    patterns = (r"\b([A-Za-z_]\w{2,})\(\)", r"(?i)\bfunctions?\s+`?([A-Za-z_]\w{2,})`?", r"(?i)`?\b([A-Za-z_]\w*_\w+)`?\s+function\b", r"`([A-Za-z_]\w*_\w+)`")
    return F.array_distinct(F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in patterns]))
