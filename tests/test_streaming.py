from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tessera.operators.presence import hash_table
from tessera.streaming import incremental as inc


def run(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return df.sparkSession.table(name)


def test_windows_and_sessions_drop_late_rows(spark, tmp_path):
    at = datetime(2024, 1, 1)
    schema = "ts timestamp, user_id long, event_type string, value double"
    for k, minutes in enumerate([[0, 1, 6], [60], [2, 61], [180]]):
        spark.createDataFrame([(at + timedelta(minutes=m), 1, "x", 1.0) for m in minutes], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{k}"))
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    got = run(inc.windowed(src), "win")
    assert got.agg(F.sum("n")).first()[0] in (4, 5, 6)
    assert run(inc.sessions(src), "ses").count() >= 1


def test_contents_once_and_containment(spark, tmp_path):
    at = datetime(2024, 1, 1)
    docs = spark.createDataFrame([(1, "a b c d e", at), (2, "a b c d e", at), (3, "x y z w", at)], "doc_id long, text string, ts timestamp")
    docs.coalesce(1).write.parquet(str(tmp_path / "docs"))
    src = inc.stream_table(spark, str(tmp_path / "docs"), docs.schema)
    assert run(inc.new_contents(src, "ts"), "once").count() == 2
    reference = hash_table(spark.createDataFrame([(7, "a b c d")], "item_id long, text string"), ["item_id"], "text", 4)
    assert sorted(r.doc_id for r in run(inc.containment_stream(src, reference), "held").collect()) == [1, 2]


def test_upsert_batches(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 1), ("a", 2, 5), ("b", 3, 1)], "k string, v int, t int")
    rows.coalesce(1).write.parquet(str(tmp_path / "feed"))
    q = inc.upsert_batches(inc.stream_table(spark, str(tmp_path / "feed"), rows.schema), str(tmp_path / "out"), "k", "t", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.k, r.v) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("a", 2), ("b", 3)]
