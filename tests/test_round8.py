"""Findings of round 4, as projected to 6 GB: what the scan of a tree and the matching of prints send and hold."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tessera.functions import hashing
from tessera.operators import prints, scan


def test_many_texts_are_hashed_as_one_by_one(monkeypatch):
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choices("abz09", k=rng.choice((1, 3, 9, 30)))) for _ in range(rng.randint(0, 60))).encode() for _ in range(200)]
    texts += [b"", b" ", b"a", b"a-b--c", b"\0a\0", "éa bé".encode(), *(b"x" * n + b" a b c" for n in range(45, 60)), b"y" * 200, *(b"q" * n for n in range(1, 70)), b""]
    monkeypatch.setattr(hashing, "_JOINED", 500)  # texts meet in many groups
    for k in (1, 4):
        found, n = hashing.md5s(texts, k)
        want = [hashing.md5(x, k) for x in texts]
        assert n.tolist() == [len(x) for x in want] and found.tolist() == np.concatenate(want).tolist()
    assert [len(x) for x in hashing.md5s([], 4)] == [0, 0]


@pytest.mark.parametrize("ordered", [True, False])
def test_least_values_of_directories_are_merged_in_bounded_pieces(ordered):
    rng = random.Random(4)
    rows = [(rng.choice("abcdefgh"), sorted({rng.randrange(200) for _ in range(rng.randint(1, 9))})) for _ in range(400)]
    rows = sorted(rows) if ordered else rows
    batches = [pa.record_batch([pa.array([d for d, _ in rows[i : i + 7]]), pa.array([s for _, s in rows[i : i + 7]], pa.list_(pa.int64()))], ["directory", "small"]) for i in range(0, 400, 7)]
    out = [x for b in hashing.least_batches(iter(batches), 5, ordered, most=20) for x in zip(*b.to_pydict().values(), strict=True)]
    want, got = defaultdict(set), defaultdict(set)
    for d, s in rows:
        want[d] |= set(s)
    for d, s in out:
        assert len(s) <= 5
        got[d] |= set(s)
    assert {d: sorted(s)[:5] for d, s in want.items()} == {d: sorted(s)[:5] for d, s in got.items()}
    assert len(out) < len(rows) and (not ordered or len(out) == len(want))


def test_marks_leave_out_what_no_rule_has_but_nothing_that_one_has(spark, monkeypatch):
    monkeypatch.setattr(hashing, "MAP_BITS", 1 << 10)
    text = " ".join(f"w{k}" for k in range(300))
    every = np.unique(hashing.md5(text.encode(), 4))
    rules = spark.createDataFrame([(int(h),) for h in every[::20]] + [(1 << 62,), (None,)], "h long")
    (row,) = scan.marked(spark.createDataFrame([("a/b", text)], "path string, text string"), rules, 4, 8).collect()
    assert row.small == every[:8].tolist() and set(every[::20].tolist()) <= set(row.met) and len(row.met) < 40


def test_texts_do_not_travel_to_their_probes(spark):
    files = spark.createDataFrame([("a//b/v.h", "v 1.2"), ("v.h", "v 3.4"), ("a/xv.h", "v 5.6"), ("c/b/v.h", "none"), ("d/v.h/", "v 7.8"), (None, "v 9.9")], "path string, text string")
    probes = spark.createDataFrame([(1, "v.h", 1, "", "v ([0-9])"), (1, "v.h", 2, ".", "[.]([0-9])"), (2, "b/v.h", 1, "", "v ([0-9])")], "rule_id int, file string, part int, lead string, pattern string")
    hits = scan.probe_hits(files, probes)
    assert {tuple(r) for r in hits.collect()} == {("a/b", 1, "1.2"), ("a", 2, "1"), ("d", 1, "7.8")}
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "text" not in "".join(x for x in plan.splitlines() if "Exchange hash" in x)


def test_copies_of_a_function_look_for_prints_once(spark):
    rng = random.Random(6)
    base = [rng.sample(range(300), rng.randint(2, 12)) for _ in range(12)]
    functions = spark.createDataFrame([("x", "1", n, f) for n, f in enumerate(base)] + [("y", "1", 50 + n, f[:-1] + [400 + n]) for n, f in enumerate(base)], "rule string, release string, fn long, features array<long>")
    reference, _ = prints.reference_prints(functions)
    rows = [("i", k, base[0]) for k in range(30)] + [("i", 90, base[1] + [777]), ("j", 91, base[1] + [778]), ("j", 92, base[2] + list(range(1000, 1300)))]
    lists = prints.feature_lists(reference)
    flat = spark.createDataFrame([(i, k, x) for i, k, f in rows for x in f], "image string, fn int, f long")
    got = sorted((r.image, r.fn_size, r.rule, r.print, r.size, r.shared) for r in prints.found(flat, lists).collect())
    sets = {(r.rule, r.print): set(r.features) for r in lists.collect()}
    want = {(i, len(f), rule, p, len(s), len(s & set(f))) for i, _, f in rows for (rule, p), s in sets.items() if len(s & set(f)) >= max(min(2, len(s)), 0.7 * len(s)) and len(f) <= 16 * len(s)}
    assert got == sorted(want) and want
    lined = spark.createDataFrame(rows, "image string, fn int, features array<long>")
    assert sorted((r.image, r.fn_size, r.rule, r.print, r.size, r.shared) for r in prints.found(lined, lists).collect()) == got
