"""Folders that all executors see, and connected components over a table of links."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset and all executors are in this process, one beside the warehouse."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
    return path or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"


def _own(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tessera-{spark.sparkContext.applicationId}"


def forget(spark: SparkSession) -> None:
    """Delete what ``saved`` has written in this application, once no result that rests on it is wanted."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def saved(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage ends there, whoever is lost later."""
    path = f"{_own(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``links(a long, b long)``; component is the smallest node reachable.

    Large-star and small-star rounds: the number of rows stays that of the
    links, and a hub is a row per link, never one list.  Each round is written
    to the shared folder, so neither plan nor lineage grows.  Nulls and loops link nothing.
    """
    e = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()
    e = saved(e)
    last = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large star: every larger neighbour to the smallest neighbour
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b").distinct()
        # small star: every smaller neighbour, and the node, to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b").filter("a > b").distinct()
        e = saved(small)
        state = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == last:
            break
        last = state
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
