"""Structured Streaming forms: incremental analysis of arriving files, and event-time windows with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import fingerprints, tokens


def stream_table(spark: SparkSession, folder: str, schema, most_files: int = 100) -> DataFrame:
    """Parquet files as they arrive in ``folder``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).parquet(folder)


def new_contents(files: DataFrame, stamp: str, late: str = "1 day") -> DataFrame:
    """Each content once within the watermark, so that only what changed is analysed."""
    return files.withColumn("sha", F.sha2("text", 256)).withWatermark(stamp, late).dropDuplicatesWithinWatermark(["sha"])


def containment_stream(docs: DataFrame, reference: DataFrame, k: int = 4) -> DataFrame:
    """A stream of documents against a static table ``item_id, h``: rows ``doc_id, item_id, h`` for the sink to count."""
    hashes = docs.select("doc_id", F.explode(F.array_distinct(fingerprints(tokens(F.col("text")), k))).alias("h"))
    return hashes.join(reference, "h").select("doc_id", "item_id", "h")


def windowed(events: DataFrame, stamp: str = "ts", late: str = "10 minutes", size: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """Counts and sums per window and type; rows later than ``late`` are dropped by the watermark."""
    window = F.window(stamp, size, slide) if slide else F.window(stamp, size)
    out = events.withWatermark(stamp, late).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, stamp: str = "ts", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    out = events.withWatermark(stamp, late).groupBy(F.session_window(stamp, gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def upsert_batches(stream: DataFrame, folder: str, key: str, stamp: str, checkpoint: str):
    """Each micro-batch keeps the newest row per key and appends; readers take the newest by ``stamp``."""

    def write(batch: DataFrame, number: int) -> None:
        fields = [c for c in batch.columns if c != key]
        newest = batch.groupBy(key).agg(F.max_by(F.struct(*fields), stamp).alias("x")).select(key, "x.*")
        newest.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
