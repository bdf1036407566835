"""The scan: each kind of evidence and the weighing of all against plain versions, and a small tree from end to end."""

import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from tessera.operators import scan

RELEASES = [f"1.{k}" for k in range(3)] + ["1.3.0", "1.3.1", "git-0a1b2c3"]


def plain(row):
    """The chain of tiers a step at a time; None where nothing identifies the directory."""
    found = [RELEASES[i] for i in row["anchors"] or []]
    identity, version, source = (0.98 if found else 0.0), None, None
    if len(found) == 1:
        version, source = found[0], "anchor"
    body = 0.0
    if row["exact"] is not None:
        body = next((i for least, i, _ in scan.CONTAINED if row["exact"] >= least), 0.0)
        identity = max(identity, body)
        if body and source != "anchor" and row["low_ix"] is not None:
            low, high = RELEASES[row["low_ix"]], RELEASES[row["high_ix"]]
            version, source = low if low == high else f"{low}~{high}", "functions"
    sketch, tree, copy = None, 0.0, False
    if row["exact"] is None or identity == 0:
        sketch, copy = row["sketch"], bool(row["exact_copy"])
        if sketch is not None:
            tree = next((c for least, c in ((0.98, 0.95), (0.85, 0.9), (0.6, 0.75), (0.35, 0.5)) if sketch >= least), 0.0)
            if tree == 0.95 and version is None and row["reference_ix"] is not None:
                version, source = RELEASES[row["reference_ix"]], "signature-reference"
        identity = max(identity, tree, 0.98 if copy else 0.0)
    demoted = False
    if found and sketch is not None:
        if sketch < 0.35:
            return None
        if sketch < 0.6:
            demoted, identity, version, source = True, min(identity, 0.5), None, None
    if not identity:
        return None
    probed = row["probed"]
    if probed:
        span = RELEASES[row["low_ix"] : row["high_ix"] + 1] if source == "functions" and "~" in version else []
        kept = [v for v in span if v == probed or v.startswith(probed + ".")]
        if kept and len(kept) < len(span):
            version = kept[0] if len(kept) == 1 else f"{kept[0]}~{kept[-1]}"
        elif source == "functions" and all(v.startswith(probed + ".") for v in version.split("~")):
            pass
        elif source != "anchor":
            version, source = probed, "probe"
        elif probed != version and not version.startswith("git-") and not version.startswith(probed + ".") and probed not in RELEASES:
            version, source = probed, "probe"
        if not demoted and identity < 0.75:
            identity = 0.75
    if len(found) > 1 and version not in found:
        version, source = f"{found[0]}~{found[-1]}", "anchor-shared"
    if row["manifest"] and source in (None, "signature-reference"):
        version, source = row["manifest"], "manifest"
    if row["place"]:
        identity = min(identity + 0.02, 1.0)
    identity = round(min(identity, row["ceiling"] or 1.0), 3)
    witnesses = bool(found or copy) + bool(body or tree) + demoted + bool(probed) + bool(row["manifest"])
    return identity, version, source, round(min(scan.VERSION.get(source, 0.0), identity), 3), witnesses


SCHEMA = "n int, anchors array<int>, exact double, low_ix int, high_ix int, sketch double, reference_ix int, exact_copy boolean, probed string, manifest string, place int, ceiling double"


def test_every_tier_is_weighed_as_plainly(spark):
    rng = random.Random(5)
    rows = []
    for n in range(6000):
        exact = rng.choice([None, 0.0, 0.2, 0.5, 0.79, 0.8, 1.0])
        low, told = rng.randrange(6), rng.random() < 0.9
        rows.append(
            {
                "n": n,
                "anchors": rng.choice([None, None, sorted(rng.sample(range(6), rng.choice([1, 1, 2, 3])))]),
                "exact": exact,
                "low_ix": low if exact is not None and told else None,
                "high_ix": rng.randrange(low, 6) if exact is not None and told else None,
                "sketch": rng.choice([None, 0.0, 0.34, 0.35, 0.6, 0.85, 0.98, 1.0]),
                "reference_ix": rng.choice([None, 2]),
                "exact_copy": rng.choice([None, False, True]),
                "probed": rng.choice([None, "1", "1.1", "1.3", "1.3.1", "9.9"]),
                "manifest": rng.choice([None, "4.0"]),
                "place": rng.choice([None, 0, 1, 2]),
                "ceiling": rng.choice([None, 1.0, 0.6]),
            }
        )
    df = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)
    releases = F.array(*[F.struct(F.lit(k).alias("ix"), F.lit(v).alias("version")) for k, v in enumerate(RELEASES)])
    got = {r.n: (r.identity, r.version, r.source, r.version_confidence, r.witnesses) for r in scan.judged(df.withColumn("releases", releases)).collect()}
    want = {r["n"]: said for r in rows if (said := plain(r))}
    assert got == want
    assert {v[2] for v in want.values()} == {*scan.VERSION, None}


def test_anchored_files_are_found_by_path_then_by_a_unique_name(spark):
    files = [("a/lib/x.h", "1"), ("a/y.h", "2"), ("b/lib/x.h", "9"), ("b/deep/x.h", "1"), ("c/1/2/3/y.h", "2"), ("d/1/2/3/4/y.h", "2"), ("e/p/y.h", "2"), ("e/q/y.h", "2"), ("f/y.h", None), ("x.h", "1"), ("g/lib/x.h", "1"), ("g/y.h", "2")]
    anchors = [(1, 0, "lib/x.h", 3, "1"), (1, 0, "lib/x.h", 4, "1"), (1, 0, "lib/x.h", 5, "9"), (1, 1, "y.h", 7, "2"), (1, 1, "y.h", 7, "2")]
    got = {(r.directory, tuple(r.anchors)) for r in scan.anchor_hits(spark.createDataFrame(files, "path string, sha string"), spark.createDataFrame(anchors, "rule_id int, at int, path string, version_ix int, sha string")).collect()}
    # "b" has another file at the path, so the equal one elsewhere does not count; "e" has two of the name, "d" one that lies too deep
    assert {x for x in got if "/" not in x[0]} == {("a", (3, 4)), ("b", (5,)), ("c", (7,)), ("g", (3, 4))}
    assert {("b/deep", (3, 4)), ("d/1", (7,)), ("e/p", (7,)), ("a/lib", (3, 4))} <= got


def test_sketches_of_directories_are_those_of_all_their_files(spark):
    rng = random.Random(1)
    files = [("/".join(rng.choice("ab") for _ in range(rng.randint(1, 3))) + f"/{n}.c", " ".join(rng.choice("pqrstu") for _ in range(rng.randint(0, 40)))) for n in range(60)] + [("a/null.c", None), ("top.c", "p q r s")]
    df = spark.createDataFrame(files, "path string, text string")
    per = {r.path: r.h for r in df.select("path", scan.shingle_hashes(F.col("text"), 3).alias("h")).collect()}
    want = defaultdict(set)
    for path, hs in per.items():
        parts = path.split("/")
        for k in range(1, len(parts)):
            want["/".join(parts[:k])] |= set(hs)
    got = {r.directory: r.s for r in scan.tree_sketches(scan.marked(df, spark.createDataFrame([], "h long"), 3, 16), 16).collect()}
    assert got == {d: sorted(hs)[:16] for d, hs in want.items() if hs}


def test_probes_need_all_their_parts(spark):
    files = [("a/v.h", "MAJOR 2\nMINOR 5"), ("b/v.h", "MAJOR 2"), ("c/v.h", None), ("d/inc/w.h", "W 7"), ("d/v.h", "MINOR 1 MAJOR 0")]
    probes = [(1, "v.h", 1, "", r"MAJOR (\d+)"), (1, "v.h", 2, ".", r"MINOR (\d+)"), (1, "inc/w.h", 1, "w", r"W (\d+)"), (2, "v.h", 1, "", r"MAJOR (\d+)")]
    got = {(r.directory, r.rule_id, r.probed) for r in scan.probe_hits(spark.createDataFrame(files, "path string, text string"), spark.createDataFrame(probes, "rule_id int, file string, part int, lead string, pattern string")).collect()}
    assert got == {("a", 1, "2.5"), ("a", 2, "2"), ("b", 2, "2"), ("d", 1, "w7"), ("d", 2, "0")}


def tree(spark, files):
    sha = lambda t: t if t is None else hashlib.sha256(t.encode()).hexdigest()
    return spark.createDataFrame([(p, sha(t), t) for p, t in files], "path string, sha string, text string")


def parts(spark, anchors=(), signature=(), sketches=(), probes=(), declared=()):
    return (
        spark.createDataFrame([(1, "one", ["ext/one"], "uno", 0, None), (2, "two", [], None, 1, 1.0)], "rule_id int, name string, globs array<string>, ships_as string, specificity int, ceiling double"),
        spark.createDataFrame([(r, k, f"1.{k}") for r in (1, 2) for k in range(3)], "rule_id int, version_ix int, version string"),
        spark.createDataFrame(list(anchors), "rule_id int, at int, path string, version_ix int, sha string"),
        spark.createDataFrame(list(signature), "rule_id int, version_ix int, h long"),
        spark.createDataFrame(list(sketches), "rule_id int, s array<long>, reference_ix int"),
        spark.createDataFrame(list(probes), "rule_id int, file string, part int, lead string, pattern string"),
        spark.createDataFrame(list(declared), "directory string, manifest string"),
    )


def test_scan_from_end_to_end(spark):
    words = lambda a, b: " ".join(f"w{k}" for k in range(a, b))
    both, old, new, other = words(0, 40), words(0, 40) + " o1 o2 o3 o4 o5", words(0, 44), words(100, 130)
    hashes = {n: [r.h for r in tree(spark, [("x", t)]).select(F.explode(scan.shingle_hashes(F.col("text"), 4)).alias("h")).collect()] for n, t in (("old", old), ("new", new), ("other", other))}
    files = [("ext/one/src/a.c", new), ("ext/one/version.h", "V 1.9"), ("mine/uno/a.c", old), ("mine/b.c", other), ("mine/copy/b.c", other), ("bare/uno/a.c", both), ("void/n.c", None), ("void/e.c", "")]
    given = parts(
        spark,
        anchors=[(2, 0, "b.c", 2, hashlib.sha256(other.encode()).hexdigest())],
        signature=[(1, 0, h) for h in hashes["old"]] + [(1, 1, h) for h in hashes["new"]],
        sketches=[(2, sorted(hashes["other"])[:64], 2)],
        probes=[(1, "version.h", 1, "", r"V ([0-9.]+)")],
        declared=[("mine/copy", "8.0")],
    )
    got = {r.directory: (r.name, r.identity, r.version, r.source, r.place, r.alternatives) for r in scan.scan(tree(spark, files), *given, k=4, size=64).collect()}
    assert got["ext/one"] == ("one", 0.97, "1.9", "probe", 2, "")
    assert got["ext/one/src"] == ("one", 0.95, "1.1", "functions", 0, "")
    assert got["mine/uno"] == ("one", 0.97, "1.0", "functions", 1, "")
    assert got["mine/copy"] == ("two", 0.98, "1.2", "anchor", 0, "")
    # all that is there is in every release: no version
    assert got["bare/uno"] == ("one", 0.97, None, None, 1, "")
    # most of "mine" is the other component: the tree speaks against the anchored file
    assert got["mine"][:4] == ("one", 0.95, "1.0", "functions")
    assert "void" not in got
    only = scan.scan(tree(spark, files), *given, k=4, size=64, candidates=spark.createDataFrame([("mine/uno",), ("nowhere",)], "directory string"))
    assert [r.directory for r in only.collect()] == ["mine/uno"]


def test_scan_of_nothing(spark):
    assert scan.scan(tree(spark, []), *parts(spark), k=4, size=8).collect() == []
    assert scan.scan(tree(spark, [("a/b.c", "w x y z"), ("c.c", None)]), *parts(spark), k=4, size=8).collect() == []
