import re

import numpy as np
import pytest

from tessera.llm import pii
from tests.conftest import SF

corpus_pipeline = pytest.importorskip("corpus_pipeline")
pytest.importorskip("public_tokenizers")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    sizes = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == names
        docs = spark.createDataFrame(docs.toPandas(), docs.schema)
        sizes.append(docs.count())
    total = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert total > sizes[0] > sizes[1] == sizes[2] == sizes[3] > 0.5 * total
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in last} == {r.doc_id for r in docs.collect()}


def test_run_and_entry(spark):
    import __spark_entry__ as entry

    assert entry.queries()["pipeline"] is corpus_pipeline.run
    assert sum(k.startswith("op") for k in entry.queries()) == 13


def plain_rest(rows, tokenizer):
    """The stages after the classifier for ``rows`` of (doc_id, text), one document after the other: ids of each piece by document and start."""
    words = {i: tuple(re.sub(r"[A-Z]", lambda m: chr(ord(m[0]) + 32), w) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows}
    sets = {i: {w[k : k + 5] for k in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}
    group = {i: i for i in sets}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                group[y] = x
    seen, out = set(), {}
    surrogates = pii.Surrogates(corpus_pipeline.KEY.encode())
    for i, t in sorted(rows):
        if root(i) != i:
            continue
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - 49):
            if raw[k : k + 50] in seen:
                gone[k : k + 50] = b"\x01" * 50
        seen.update(raw[k : k + 50] for k in range(len(raw) - 49))
        text = pii.replace(bytes(b for b, g in zip(raw, gone, strict=True) if not g).decode(errors="ignore"), surrogates)[0]
        whole = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        at = 0
        while at < len(whole):
            size = 1024
            while size > len(whole) - at:
                size //= 2
            out[i, at] = whole[at : at + size]
            at += size
    return out


def test_run_is_the_plain_pipeline(spark):
    """All stages but the learned one against plain Python, on the documents that the classifier keeps; held-out labels test that one."""
    from tokenizers import Tokenizer

    kept = corpus_pipeline.quality(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).select("doc_id", "text").collect()
    want = plain_rest([(r.doc_id, r.text) for r in kept], Tokenizer.from_file(corpus_pipeline.tokenizer_path()))
    got = {(r.doc_id, r.start): np.frombuffer(r.ids, "<u4").tolist() for r in corpus_pipeline.run(spark, SF).collect()}
    assert len(got) > 100 and got == want


def test_stages_take_empty_and_odd_tables(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    odd = [(1, None, None, None, None), (1, "", "en", "s", 0), (None, "x " * 60, "en", "s", 120), (2, "x " * 60, None, "s", None), (2, "x " * 60, None, "s", None)]
    for rows in ([], odd):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, SF).count() <= len(rows)
        # each row is pieces that begin at 0
        assert corpus_pipeline.packing(spark, docs, SF).filter("start = 0").count() == len(rows)
