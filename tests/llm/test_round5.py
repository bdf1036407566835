"""Findings of round 4: what op2 writes on its way from slots to buckets."""

from tessera.llm import slots, suffix_dedup


def test_a_thousand_slots_and_more_write_each_part_once(spark, monkeypatch):
    monkeypatch.setattr(slots, "SLOT_BYTES", 1)
    docs = spark.createDataFrame([(k, "x" * 150) for k in range(10)], "doc_id long, text string")
    plan = suffix_dedup.suffix_dedup(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert slots.slotted(docs, "doc_id", "text")[1] == 1500
    assert "MapInArrow" not in plan


def test_runs_travel_compressed():
    body = b"".join(b"%d of the words that many documents share, " % k for k in range(100))
    assert slots.plain(slots.packed(body)) == body and slots.plain(slots.packed(b"")) == b""
    assert 2 * len(slots.packed(body)) < len(body)
