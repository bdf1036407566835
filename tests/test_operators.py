from pyspark.sql import functions as F

from tessera.operators import advisories, graph, inventory, nearness, paths, presence, resolve


def rows(df, *columns):
    return sorted(tuple(r[c] for c in (columns or df.columns)) for r in df.collect())


def test_release_range_takes_sides(spark):
    # release 1 adds 10..19 to release 0, release 2 replaces 15..19
    common = list(range(10))
    sig = [("r", v, h) for v, hs in enumerate([common, common + list(range(10, 20)), common + list(range(10, 15)) + list(range(30, 35))]) for h in hs]
    signature = spark.createDataFrame(sig, "rule_id string, version_ix int, h long")
    present = spark.createDataFrame([("d", h) for h in common + list(range(10, 20))] + [("e", h) for h in common], "doc_id string, h long")
    got = rows(presence.release_range(present, signature), "doc_id", "best_ix", "low_ix", "high_ix")
    assert got == [("d", 1, 1, 1)]  # "e" holds only what every release has: no voter


def test_bands_bundles_owners(spark):
    table = spark.createDataFrame([("host", h) for h in range(1000)] + [("part", h) for h in range(50)] + [("other", h) for h in range(5000, 5100)], "owner string, h long")
    assert rows(presence.bundles(table, "owner")) == [("host", "part", 50, 50, 1000)]
    assert presence.owners(table, "owner").filter("owners = 2").count() == 50
    assert [presence.band(F.lit(x))._jc is not None for x in (0.9,)] == [True]


def test_paths(spark):
    files = spark.createDataFrame([(1, "a/b/c.c", 5), (2, "a/b", 9), (3, "a", 9), (4, "x/y/z/c.c", 1), (5, "d.c", 2)], "id int, path string, score int")
    assert rows(paths.without_nested(files.withColumn("k", F.lit(1)), ["k"]), "id") == [(3,), (4,), (5,)]
    assert rows(paths.without_shadowed(files, "score"), "id") == [(1,), (2,), (4,), (5,)]
    holders = spark.createDataFrame([("a",), ("a/b",), ("x/y",)], "holder string")
    assert rows(paths.nearest_enclosing(files, holders, "id"), "id", "holder")[0] == (1, "a/b")
    assert rows(paths.outside(files, holders), "id") == [(3,), (5,)]
    wanted = spark.createDataFrame([("d.c",), ("lib/c.c",), ("none.c",), ("q/d.c",)], "wanted_path string")
    assert sorted((r[0], r[1] or "") for r in paths.located(files.select("path"), wanted).collect()) == [("d.c", "d.c"), ("lib/c.c", ""), ("none.c", ""), ("q/d.c", "d.c")]


def test_merge_is_order_free(spark):
    schema = "v string, channel string, state string, authoritative boolean, unplaced boolean"
    data = [("a", "cpe", "exploitable", False, False), ("a", "purl", "not_affected", False, False), ("b", "cpe", "in_triage", False, True), ("b", "purl", "not_affected", False, False), ("c", "cpe", "exploitable", False, False), ("c", "purl", "not_affected", True, False), ("d", "cpe", "in_triage", False, True)]
    want = [("a", "in_triage"), ("b", "not_affected"), ("c", "not_affected"), ("d", "in_triage")]
    for x in (data, data[::-1]):
        assert rows(resolve.merged_states(spark.createDataFrame(x, schema), ["v"])) == want
    assert dict(rows(resolve.state_summary(spark.createDataFrame([("exploitable",)], "state string"))))["resolved"] == 0


def test_null_verdict_survives(spark):
    components = spark.createDataFrame([("c", "k", "deadbeef", False, False), ("d", "k", "1.5", False, False), ("e", "k", "3.0", False, False), ("f", "k", "1.5", False, True)], "component string, key string, version string, distro boolean, fork boolean")
    ranges = spark.createDataFrame([("A", "CVE-1", "k", "1.0", None, "2.0", None)], "advisory_id string, vuln_key string, key string, introduced string, start_excluding string, fixed string, last_affected string")
    assert rows(advisories.matched(components, ranges, "cpe"), "component", "state") == [("c", "in_triage"), ("d", "exploitable"), ("e", "not_affected"), ("f", "in_triage")]
    key = advisories.vulnerability_key(F.lit("GHSA-1"), F.array(F.lit("x"), F.lit("CVE-2020-1")))
    assert spark.range(1).select(key).first()[0] == "CVE-2020-1"


def test_graph(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (9, 10)], "src int, dst int")
    seeds = spark.createDataFrame([(1, 1), (9, 9)], "seed int, vertex int")
    assert rows(graph.reachable(edges, seeds, 12), "seed", "vertex", "hops") == [(1, 1, 0), (1, 2, 1), (1, 3, 2), (1, 4, 3), (9, 9, 0), (9, 10, 1)]
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert dict(rows(graph.groups(chain))) == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_policy_and_patches(spark):
    d = lambda x: F.lit(x).cast("date")
    s = inventory.policy_status
    assert tuple(spark.range(1).select(s(d("2020-01-01"), d(None), d(None)), s(d("2020-01-01"), d("2019-01-01"), d("2021-01-01")), s(d("2022-01-01"), d("2019-01-01"), d("2021-01-01")), s(d("2018-01-01"), d("2019-01-01"), d(None))).first()) == ("fail", "deprecated", "fail", "due")
    f = spark.createDataFrame([("p", "fixed"), ("p", "absent"), ("q", "fixed"), ("q", "vulnerable"), ("r", "absent")], "p string, state string")
    assert rows(inventory.patch_state(f, ["p"])) == [("p", "fixed"), ("q", "partial"), ("r", "absent")]


def test_upsert_and_first_hit(spark):
    old, new = spark.createDataFrame([("a", 1, 1), ("b", 2, 5)], "k string, v int, t int"), spark.createDataFrame([("a", 9, 1), ("b", 3, 4)], "k string, v int, t int")
    assert rows(advisories.upsert(old, new, "k", "t"), "k", "v") == [("a", 9), ("b", 2)]


def test_near_pairs_by_brute_force(spark):
    import random
    import re

    rng = random.Random(3)
    texts = {1: None, 2: "", 3: "a b c", 4: "A b  c", 5: "a b c d e", 6: "a b c"}
    for k in range(10, 60):
        words = [rng.choice("abcdefghé日") + str(rng.randint(0, 60)) for _ in range(rng.randint(5, 60))] if k % 5 == 0 else list(words)
        if k % 5 > 1:
            words[rng.randrange(len(words))] = f"new{k}"
        texts[k] = " ".join(words)

    def cut(t):
        w = re.findall(r"[^ \t-\r]+", (t or "").lower())
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {k: cut(t) for k, t in texts.items()}
    want = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = nearness.near_pairs(docs).collect()
    assert len(want) > 20
    # pairs of the smallest ids of equal sets, and each further member with its own
    first = {k: min(j for j in sets if sets[j] == sets[k]) for k in sets if sets[k]}
    pairs = [(a, b) for a, b in want if first[a] == a and first[b] in (a, b)]
    assert sorted((r.a, r.b) for r in got) == sorted(pairs) and 0 < len(pairs) < len(want)
    assert all(abs(r.similarity - len(sets[r.a] & sets[r.b]) / len(sets[r.a] | sets[r.b])) < 1e-12 for r in got)
    groups = dict(rows(graph.groups(nearness.near_links(docs)), "node", "component"))
    assert set(groups) == {x for p in want for x in p} and all(groups[a] == groups[b] for a, b in want)
