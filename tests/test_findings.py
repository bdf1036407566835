from pyspark.sql import functions as F

from tessera.operators import findings


def _overrides(spark, rows):
    return spark.createDataFrame(rows, "position long, rule string, name string, directory string, version string, status string, ends string")


def _stamps(spark, found, overrides, rules):
    f = spark.createDataFrame(found, "id long, rule string, name string, directory string, version string")
    r = spark.createDataFrame(rules, "rule string, status string, ends string")
    return {x.id: (x.status, x.ends, x.origin) for x in findings.stamped(f, _overrides(spark, overrides), r).collect()}


def test_stamps(spark):
    found = [(1, "r1", "Alpha", "lib/a/b", "1"), (2, "r1", "Beta", "lib/a.c", None), (3, "r2", "beta", "x", "2"), (4, None, None, None, None), (5, "r3", "Gamma", "y(1)", "1")]
    rules = [("r1", "supported", "2030"), ("r2", None, "2031")]
    overrides = [(3, None, "BETA", None, None, "late", None), (2, "r1", None, "lib/a.?", None, "dot", "2032"), (9, None, None, None, "1", "one", None), (1, "r1", None, "lib/*/b", "2", "other version", None), (8, None, None, "y(*)", None, "glob", None)]
    assert _stamps(spark, found, overrides, rules) == {1: ("one", None, "file"), 2: ("dot", "2032", "file"), 3: ("late", None, "file"), 4: ("unknown", None, "none"), 5: ("glob", None, "file")}
    assert _stamps(spark, found, [], rules) == {1: ("supported", "2030", "rule"), 2: ("supported", "2030", "rule"), 3: ("unknown", None, "none"), 4: ("unknown", None, "none"), 5: ("unknown", None, "none")}
    # an override that asks for nothing fits all, and the first in the file decides
    assert set(_stamps(spark, found, [(7, None, None, None, None, "all", None), (8, "r1", None, None, None, "never", None)], rules).values()) == {("all", None, "file")}
    assert _stamps(spark, [], overrides, rules) == {}


def test_globs(spark):
    fits = lambda glob, path: spark.range(1).select(F.rlike(F.lit(path), findings.whole_glob(F.lit(glob)))).first()[0]
    assert fits("a*", "a/b/c") and fits("a?c", "a/c") and fits("[!b]*", "abc") and fits("x(1)+$", "x(1)+$")
    assert not fits("a.c", "abc") and not fits("[!a]*", "abc") and not fits("b", "abc")


def test_counts_and_order(spark):
    rows = spark.createDataFrame([("a", 0.5, "unknown", "z"), ("a", 0.4, "unknown", "b"), ("a", 0.9, "supported", "c"), ("b", 0.5, "unknown", "a")], "rule string, identity double, status string, directory string")
    assert {tuple(r) for r in findings.report_counts(rows, "rule", 0.5).collect()} == {("a", 2, 1, 1), ("b", 1, 0, 1)}
    assert [r.directory for r in findings.ordered(rows, "identity").collect()] == ["c", "a", "z", "b"]


def test_licence_differs(spark):
    cases = [("MIT OR Zlib", ["mit"], False), ("MIT", ["MIT", "Zlib"], True), (None, ["MIT"], False), ("", ["MIT"], False), ("MIT", [], False), ("MIT", None, False), ("GPL-2.0-only WITH x-exception", ["gpl-2.0-only"], False)]
    df = spark.createDataFrame(cases, "d string, o array<string>, w boolean")
    assert all(r.got == r.w for r in df.select("w", findings.licence_differs(F.col("d"), F.col("o")).alias("got")).collect())
