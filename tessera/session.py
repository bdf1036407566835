"""A session with the settings the engine relies on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "tessera", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution and ANSI mode; ``master`` only where no cluster sets one."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.ui.enabled": "false"} | conf
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to all cores if its scan has fewer parts than there are cores; a scan of a large table is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
