"""Manifest, filter audit and decontamination against plain versions."""

import hashlib
import itertools
import re
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import decontaminate as dc
from tessera.llm import filter_audit as fa
from tessera.llm import manifest as mf

# ---- manifest ----------------------------------------------------------------------------


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(nodes, fan):
    """Root and, for each node, its siblings level by level."""
    ways, where = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(where):
            run = range(i // fan * fan, min((i // fan + 1) * fan, len(nodes)))
            ways[k].append(("".join(nodes[j] for j in run if j < i), "".join(nodes[j] for j in run if j > i)))
        nodes = [H(*nodes[i : i + fan]) for i in range(0, len(nodes), fan)]
        where = [i // fan for i in where]
    return nodes[0] if nodes else None, ways


def plain_manifest(rows, fan=2):
    """{(doc_id, leaf): (subroot, root, proof)} as lists, for rows (doc_id, text, lang, source, n_chars)."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups = {}
    for i, text, lang, source, n in rows:
        groups.setdefault(lang, []).append(((i is None, i or 0), H(*map(field, (i, source, lang, n, text))), i))
    order = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    built = {g: tree([x[1] for x in sorted(groups[g], key=lambda x: x[:2])], fan) for g in order}
    root, up = tree([built[g][0] for g in order], fan)
    out = []
    for g, rest in zip(order, up, strict=True):
        for (_, leaf, i), way in zip(sorted(groups[g], key=lambda x: x[:2]), built[g][1], strict=True):
            out.append((i, leaf, built[g][0], root, tuple(way + rest)))
    return sorted(out, key=str)


def rows_of(n):
    langs = ["en", "de", None, "", "日", "en", "en"]
    out = [(None if k % 13 == 0 else k // 2, None if k % 11 == 0 else f"text {k // 2} é", langs[k * k % 7], f"s{k % 3}" if k % 5 else None, None if k % 4 == 0 else k) for k in range(n)]
    return out + [(5, "same", "en", "s", 4)] * min(n, 40)


@pytest.mark.parametrize(("n", "fan"), [(0, 2), (1, 2), (9, 2), (300, 2), (300, 3), (120, 300)])
def test_manifest_is_the_plain_tree(spark, monkeypatch, n, fan):
    monkeypatch.setattr(mf, "MEET", 8)
    rows = rows_of(n)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    got = mf.manifest(docs.withColumn("part", F.lit("clash")), mf.COLUMNS, fan=fan)
    assert sorted([(r.doc_id, r.leaf, r.subroot, r.root, tuple((s.before, s.after) for s in r.proof)) for r in got.collect()], key=str) == plain_manifest(rows, fan)
    assert got.filter(mf.fold(F.col("leaf"), F.col("proof")) != F.col("root")).count() == 0


def test_tampered_rows_do_not_verify(spark, tmp_path):
    rows = [r for r in rows_of(200) if r[0] is not None]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = mf.op11_manifest(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    changed = {r[0] for r in rows if r[4] is not None}
    for r in got:
        assert r.verified or zlib.crc32(str(r.doc_id).encode()) % 7 == 0
        if zlib.crc32(str(r.doc_id).encode()) % 7 == 0 and r.doc_id in changed and r.leaf in {x[1] for x in plain_manifest([y for y in rows if y[4] is not None])}:
            assert not r.verified


def test_subtrees_leave_few_nodes():
    nodes = [H(str(k)) for k in range(1000)]
    for first, m in ((0, 1000), (1, 700), (513, 487), (7, 1), (999, 1)):
        levels, ragged = mf.subtrees(nodes[first : first + m], first, 1000, 2)
        assert sum(2**level for level, _, _ in ragged) >= m and len(ragged) <= 2 * len(levels)


# ---- filter audit ------------------------------------------------------------------------


def plain_audit(docs, labels):
    good, toxic = ({x[0] for x in labels if x[0] is not None and x[k] == 1} for k in (1, 2))
    out, fails = {}, []
    for i, text, lang in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        f = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text or "")) > 3 * len(text or ""), "D": bool(re.search(r"[#$%&*|]", text or ""))}
        f["E"] = i is not None and any(j is not None and j < i and (u or "") == (text or "") for j, u, _ in docs)
        fails.append((lang or "", {k for k in f if f[k]}, i in good, i in toxic))
    for part in {x[0] for x in fails}:
        own = [x for x in fails if x[0] == part]
        share = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            for k, name in enumerate(order):
                alive = [x for x in own if not x[1] & set(order[:k])]
                hit = [x for x in alive if name in x[1]]
                share[name] += len(hit)
                out[part, "".join(order), k + 1] = [len(alive) - len(hit), len(hit), sum(name in x[1] for x in own) - len(hit), sum(x[1] == {name} for x in own), sum(x[2] for x in hit), sum(x[3] for x in hit)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(share[order[step - 1]])
    return out


def test_audit_is_the_plain_one(spark):
    long = " ".join(f"w{k}" for k in range(210))
    texts = ["", None, long, long + " #", "A B C", "x " * 300, long.upper(), long, "x " * 300, "é Ü " * 110, "\x00 a\x1fb"]
    docs = [(k // 2 if k % 9 else None, texts[k % 11], ["en", None, "", "de"][k % 4]) for k in range(60)]
    labels = [(k, k % 2, k % 3 == 0) for k in range(20)] + [(3, 0, 1), (None, 1, 1), (4, None, None)]
    labels = [(i, q, None if t is None else int(t)) for i, q, t in labels]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("mask", F.lit("clash"))
    got = fa.audit(fa.counts(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    assert {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in got.collect()} == plain_audit(docs, labels)
    none = frame.limit(0)
    assert fa.audit(fa.counts(none, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))).count() == 0


def test_equal_hashes_are_verified(monkeypatch):
    monkeypatch.setattr(fa, "span_hash", lambda prefix, a, z: ((z - a) % 3).astype(np.uint64))
    texts = ["aa bb aa cc", "", "a a a", "long words and short ones and long words"]
    buf = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    assert fa.distinct_words(buf, offsets)[1].tolist() == [len(set(t.split())) for t in texts]


# ---- decontamination -----------------------------------------------------------------------


def words_of(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain_hits(text, items, length, coverage=1.0):
    words, hit, found = words_of(text), set(), set()
    for name, item in items:
        own = words_of(item)
        if not own:
            continue
        m = min(length, max(1, -(-int(coverage * 1000) * len(own) // 1000)))
        windows = {tuple(own[k : k + m]) for k in range(len(own) - m + 1)}
        for k in range(len(words) - m + 1):
            if tuple(words[k : k + m]) in windows:
                hit |= set(range(k, k + m))
                found.add(name)
    return len(words), hit, sorted(found - {None})


TEXT = st.lists(st.sampled_from(["a", "b", "C", "dé", "-", "日本", "e.f"]), max_size=30).map(" ".join)


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, max_size=6), st.lists(TEXT, min_size=1, max_size=5), st.integers(1, 5), st.sampled_from([1.0, 0.5]))
def test_hits_are_the_plain_ones(items, texts, length, coverage):
    import pyarrow as pa

    named = [(f"i{k}", x) for k, x in enumerate(items)]
    parts = [(n, [w.encode() for w in words_of(x)]) for n, x in named if words_of(x)]
    auto = dc.Automaton(parts, [min(length, max(1, int(np.ceil(coverage * len(w))))) for _, w in parts])
    buf, offsets = dc.flat(pa.array(texts))
    starts, ends, first, hit, found = dc.hits(auto, dc.LOWER[buf], offsets)
    for k, text in enumerate(texts):
        n, want, names = plain_hits(text, named, length, coverage)
        assert first[k + 1] - first[k] == n
        assert set(np.flatnonzero(hit[first[k] : first[k + 1]]).tolist()) == want
        assert sorted(auto.ids[x] for x in found.get(k, ())) == names


@pytest.mark.parametrize("block", [1 << 20, 64])
def test_decontaminate_cuts_whole_texts(spark, block):
    item = "One two three four five six seven eight nine ten eleven twelve"
    items = [(1, item), (2, "short one"), (3, None), (4, "..."), (None, "only here now"), (10, item), (5, "x " * 50 + item)]
    texts = ["see: " + item + "! end", "Short-ONE", "", None, "nothing", "only here now.", item[:40], "w " * 300_000 + item + " tail", "two three four five six seven eight nine ten eleven / 日本"]
    docs = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "doc_id long, text string, items string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in dc.decontaminate(docs, bench, block_bytes=block, carry=["items"]).collect()}
    for k, text in enumerate(texts):
        n, want, names = plain_hits(text, [(None if i is None else str(i), t) for i, t in items], 10)
        r = got[k]
        assert (r.n_words, sum(s.length for s in r.spans), r["items"], r.carry["items"]) == (n, len(want), names, "clash")
        kept = [w for j, w in enumerate(words_of(text)) if j not in want]
        assert words_of(r.text) == kept and (r.text is None) == (text is None)
    assert got[0].text == "see: ! end" and got[1].text == ""
    empty = dc.decontaminate(docs, bench.limit(0)).collect()
    assert {r.doc_id: r.text for r in empty} == dict(enumerate(texts))


def test_a_false_hash_is_no_hit(monkeypatch):
    import pyarrow as pa

    parts = [("i", [b"aa", b"b"])]
    auto = dc.Automaton(parts, [2])
    monkeypatch.setattr(auto, "tokens", lambda buf, a, z: np.array([0, 1, 0, 1, -1][: len(a)]))
    buf, offsets = dc.flat(pa.array(["aa b cc b x"]))
    assert dc.hits(auto, buf, offsets)[3].tolist() == [True, True, False, False, False]


def test_long_periodic_text_is_linear():
    auto = dc.Automaton([("i", [b"a"] * 400), ("j", [b"a", b"b"] * 200)], [10, 10])
    buf = np.frombuffer(b"a a b " * 170_000, np.uint8)
    start = time.perf_counter()
    dc.hits(auto, buf, np.array([0, len(buf)]))
    assert time.perf_counter() - start < 5
