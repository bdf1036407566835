import json

from pyspark.sql import functions as F

from tessera.operators import evidence

ANCHORS = "rule string, path string, release string, sha string"


def test_rules_in_layers(spark, tmp_path):
    for k, (name, rules) in enumerate([("a/one.json", [{"id": "x", "upstream": {"name": "old"}}, {"id": "y", "upstream": {"name": "kept"}}, {"upstream": {"name": "no id"}}]), ("a/two.json", {"id": "z", "upstream": {"name": "single"}}), ("b/one.json", {"id": "x", "upstream": {"name": "new"}, "identity": {"anchors": [{"path": "v.h", "sha256": {"1.0": "AB", "1.1": "cd"}}]}})]):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(json.dumps(rules))
    roots = [str(tmp_path / "a"), str(tmp_path / "b")]
    rules = evidence.read_rules(spark, roots)
    assert {r.id: r.upstream.name for r in rules.collect()} == {"x": "new", "y": "kept", "z": "single"}
    assert {r.id: r.upstream.name for r in evidence.read_rules(spark, roots[::-1]).collect()}["x"] == "old"
    assert sorted(evidence.anchors(rules).collect()) == [("x", "v.h", "1.0", "ab"), ("x", "v.h", "1.1", "cd")]
    assert evidence.read_rules(spark, []).count() == 0


def test_anchored_releases(spark):
    files = spark.createDataFrame([("r", "v.h", "AB"), ("r", "v.h", "AB"), ("s", "v.h", "cd"), ("t", "v.h", None), ("u", "other.h", "ab")], "root string, path string, sha string")
    anchors = spark.createDataFrame([("x", "v.h", "1.0", "ab"), ("x", "v.h", "1.1", "ab"), ("x", "v.h", "2.0", "cd"), ("y", "v.h", "9", "cd")], ANCHORS)
    got = {(r.root, r.rule): (r.releases, r.version) for r in evidence.anchored_releases(files, anchors).collect()}
    assert got == {("r", "x"): (["1.0", "1.1"], None), ("s", "x"): (["2.0"], "2.0"), ("s", "y"): (["9"], "9")}
    assert evidence.anchored_releases(files.filter("false"), anchors).count() == 0


def test_macros(spark):
    texts = ["#define A 1\n# define B(x) x\n/* #define C 1 */ // #define C\n#define D\n#define E 1 /* why\n */ \r\n#define F a \\\n  b\nx #define G 1", "#define A 2\n#define D 1\n  #\tundef E\n#define F a b // same\n#undef H", None, ""]
    files = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "path string, text string")
    assert {r.name: (r.value, r.certain) for r in evidence.harvested_macros(files).collect()} == {"A": (None, False), "D": ("1", True), "E": (None, False), "F": ("a b", True), "H": (None, False)}


def test_declared_models(spark):
    models = spark.createDataFrame([("m/a.gguf", "AB"), ("m/a.gguf", "AB"), ("m/sub/b.onnx", "cd"), ("c.onnx", None), ("n[1].bin", "ef"), (None, None)], "path string, sha256 string")
    said = [(3, "m/*", None, "folder", None, None), (4, None, "ab", "digest", "1", "mit"), (1, "*.onnx", None, "any", None, None), (0, "x/*", None, "never", None, None), (2, "m/sub/?.onnx", None, "late", None, None), (5, None, "zz", "none", None, None)]
    declared = spark.createDataFrame(said, "position long, glob string, sha256 string, name string, version string, licence string")
    got = evidence.declared_models(models, declared).collect()
    assert sorted((r.path or "", r.name, r.declared_by) for r in got if r.name) == [("c.onnx", "any", "path"), ("m/a.gguf", "digest", "sha256"), ("m/a.gguf", "digest", "sha256"), ("m/sub/b.onnx", "any", "path")]
    assert sorted((r.path or "") for r in got if not r.name) == ["", "n[1].bin"]


def test_patch_records(spark):
    schema = "patch long, path string, name string, exact string, abstract string"
    before = spark.createDataFrame([(1, "a.c", "f", "1", "p"), (1, "a.c", "same", "2", None), (1, "a.c", "gone", "3", None), (1, "a.c", "twice", "5", None), (1, "a.c", "twice", "6", None), (2, "b.c", "g", "1", None), (2, "b.c", "h", "2", None)], schema)
    after = spark.createDataFrame([(1, "a.c", "f", "9", "q"), (1, "a.c", "same", "2", None), (1, "a.c", "new", "4", None), (1, "a.c", "twice", "6", None), (1, "a.c", "twice", "5", None), (2, "b.c", "g", "8", None), (2, "b.c", "h", "8", None)], schema)
    got = {(r.patch, r.name): (r.hole, r.fixed, r.hole_abstract, r.fixed_abstract) for r in evidence.patch_records(before, after, ["patch"]).collect()}
    assert got == {(1, "f"): (["1"], ["9"], ["p"], ["q"]), (1, "gone"): (["3"], None, [], None), (1, "new"): (None, ["4"], None, []), (2, "g"): (["1"], ["8"], [], []), (2, "h"): (["2"], ["8"], [], [])}
    assert {r.patch for r in evidence.patch_records(before, after, ["patch"], most=2).collect()} == {2}
    assert evidence.patch_records(before, before, ["patch"]).filter(F.lit(True)).count() == 0
