"""Findings of round 4, as projected to 6 GB: steps whose work grew faster than their input."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.functions import hashing
from tessera.functions.text import tokens
from tessera.operators import compose, expansion, presence, sketches, trials


def plain_similarities(rows, size):
    out = Counter()
    for x, s in rows:
        for y, t in rows:
            if x < y and set(s) & set(t):
                m = min(len(s), len(t), size)
                out[x, y, len(set(sorted({*s, *t})[:m]) & set(s) & set(t)) / m] += 1
    return out


def test_sketches_meet_as_plainly_in_blocks(spark, monkeypatch):
    rng = random.Random(3)
    base = [sorted(rng.sample(range(400), rng.randint(1, 12))) for _ in range(60)]
    rows = [(k, s) for k, s in enumerate(base)]
    rows += [(100 + k, base[7]) for k in range(40)] + [(200 + k, sorted({*base[9], 1000 + k})) for k in range(20)]
    rows += [(1, [3, 5000]), (1, base[1]), (None, base[7])]  # ids that repeat are rows of their own, as in SQL
    df = spark.createDataFrame([(i, repr(s).encode(), s) for i, s in rows], "doc_id long, digest binary, s array<long>")
    monkeypatch.setattr(sketches, "COPIES", 3)
    monkeypatch.setattr(sketches, "BLOCK", 100)
    monkeypatch.setattr(sketches, "JOINED", 50)
    got = Counter((r.a, r.b, r.similarity) for r in sketches.similar_pairs(df, 8).collect())
    assert got == plain_similarities([r for r in rows if r[0] is not None], 8)


def test_joined_sketches_are_held_a_few_at_a_time(monkeypatch):
    monkeypatch.setattr(sketches, "JOINED", 1000)
    n, size = 150, 20
    at = pa.array([[{"h": h, "p": h} for h in range(size)]] * n)
    block = sketches._Block(pa.table({"at": at, "ids": pa.array([[k] for k in range(n)]), "n": pa.array([size] * n)}))
    batches = list(sketches._met(block, block, size))
    assert sum(b.num_rows for b in batches) == n * (n - 1) // 2 and max(b.num_rows for b in batches) <= 1000 + n
    assert all(np.all(b.column(2).to_numpy() == 1) for b in batches)


def test_a_chain_of_macros_takes_few_rounds(spark, monkeypatch):
    rounds = []
    kept = expansion.settled
    monkeypatch.setattr(expansion, "settled", lambda df: rounds.append(df.columns) or kept(df))
    monkeypatch.setattr(expansion, "USED", 2)
    n = 40
    bodies = [(f"m{k}", f"m{k + 1}") for k in range(n)] + [(f"m{k}", f"s{k}") for k in range(n)] + [("m30", "m20")]
    uses = [("f", "m0"), ("f", "m7"), ("f", "s3"), ("f", "m25"), ("g", "m39"), ("h", None), (None, "m39")]
    got = {(r.fn, r.symbol): r.through for r in expansion.expanded_calls(spark.createDataFrame(uses, "fn string, token string"), spark.createDataFrame(bodies, "macro string, token string")).collect()}
    want = {("f", f"s{k}"): "m0" for k in range(n)} | {("g", "s39"): "m39", ("g", "m40"): "m39", (None, "s39"): "m39", (None, "m40"): "m39", ("f", "m40"): "m0", ("f", "s3"): None, ("h", None): None}
    assert got == want
    assert len(rounds) < 20


def test_recall_is_that_of_mutated_copies(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(("a", "zz", "zza", "Lib", "x9", "b-c", "İd")) + str(rng.randrange(40)) for _ in range(n)) for n in (1, 3, 4, 5, 60, 700)] + ["", " . ", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    rates = [(0, 0), (25, 0), (0, 20), (15, 25), (100, 0), (0, 100)]
    words = tokens(F.col("text"))
    want = {}
    cut = lambda w: {tuple(w[i : i + 4]) for i in range(max(len(w) - 3, 1))} if w else set()
    for rename, delete in rates:
        made = df.select(words.alias("w"), trials.mutated(words, F.lit(rename), F.lit(delete), "k").alias("u")).filter(F.size("w") > 0).collect()
        pct = [100 * len(cut(r.w) & cut(r.u)) // len(cut(r.w)) for r in made]
        want[rename, delete] = (len(pct), *(sum(p >= least for p in pct) for least in (80, 50, 20)), sum(pct))
    out = trials.recall(df, rates, 4, "k")
    assert {(r.rename, r["delete"]): (r.docs, r.strong, r.partial, r.weak, r.total_pct) for r in out.collect()} == want
    assert "ArrowEvalPython" not in out._jdf.queryExecution().toString()  # no arrays of words or hashes go to and fro


def test_hash_tables_are_made_a_few_megabytes_at_a_time(spark):
    texts = ["one two three four five " * 10, "x" * 300 + " y", "", "a b c d e f"] * 50
    batch = pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array(["k"] * 200), pa.array(texts)], ["id", "kind", "text"])
    parts = list(hashing.set_batches([batch], 4, 64, 1000))
    assert [x for p in parts for x in p.column(0).to_pylist()] == list(range(200))
    assert all(p.num_rows <= 64 and (p.num_rows == 1 or sum(len(texts[i]) for i in p.column(0).to_pylist()) <= 1000) for p in parts)
    df = spark.createDataFrame([(k, "s", t) for k, t in enumerate([*texts[:4], None])], "id int, kind string, text string")
    out = presence.hash_table(df, ["id", "kind"], "text", 4)
    want = Counter((r.id, "s", r.h) for r in df.select("id", F.explode(hashing.shingle_hashes(F.col("text"), 4)).alias("h")).collect())
    assert Counter((r.id, r.kind, r.h) for r in out.collect()) == want
    assert "ArrowEvalPython" not in out._jdf.queryExecution().toString()


def plain_groups(claims, named=8, unnamed=40):
    left, out = {}, []
    for d, path, owner, held, own, by_name in claims:
        if held >= 0.8 * own and (held >= 3 or by_name):
            left.setdefault((d, owner), {})[path] = (held, by_name)
    rank = lambda d, o: (-any(x for _, x in left[d, o].values()), -sum(h for h, _ in left[d, o].values()), o)
    while left:
        d, o = min(left, key=lambda k: (k[0], rank(*k)))
        by_name, n, _ = rank(d, o)
        got = left.pop((d, o))
        if got and -n >= (named if by_name else unnamed):
            out.append((d, o, len(got), -n))
            for k in left:
                if k[0] == d:
                    left[k] = {p: x for p, x in left[k].items() if p not in got}
    return sorted(out)


def test_loose_files_go_as_plainly_in_numbers(spark):
    rng = random.Random(8)
    claims = sorted({(d, str(p), f"o{rng.randrange(25)}"): None for d in "xy" for p in range(80) for _ in range(rng.randint(1, 3))})
    claims = [(*c, (n := rng.randint(1, 9)), n + rng.choice((0, 0, 1, 5)), rng.random() < 0.03) for c in claims]
    claims += [("z", f"p{k}", "lone", 5, 5, False) for k in range(500)] + [("z", f"q{k}", f"small{k}", 4, 4, False) for k in range(500)] + [("z", "n", "null", 50, 50, None)]
    df = spark.createDataFrame(claims, "directory string, path string, owner string, held long, own long, named boolean")
    want = plain_groups([(*c[:5], bool(c[5])) for c in claims])
    out = compose.loose_groups(df)
    assert sorted((r.directory, r.owner, r.files, r.functions) for r in out.collect()) == want and ("z", "lone", 500, 2500) in want
    assert "FlatMapGroupsInArrow" in out._jdf.queryExecution().toString()
