import gzip
import io
import json
import lzma

import pytest

from tessera.sources import exchange, feeds


def _text(document):
    return "\n".join(r.line for r in document.collect())


def _tables(spark):
    components = spark.createDataFrame([("b", "1.0", "pkg:npm/b@1.0"), ("a", None, None), ("a", None, None), ('c"\n', "2", "pkg:npm/c@2")], "name string, version string, purl string")
    depends = spark.createDataFrame([("pkg:npm/b@1.0", "pkg:npm/c@2"), ("pkg:npm/b@1.0", "pkg:npm/gone"), (None, "pkg:npm/c@2")], "purl string, on string")
    states = spark.createDataFrame([("CVE-2020-1234", "pkg:x/y", "exploitable", 9.8, "seen"), ("CVE-2020-1234", "pkg:x/z", "not_affected", None, None), ("GHSA-1", "pkg:x/y", "in_triage", None, None), ("GHSA-2", None, None, None, None)], "vuln_key string, purl string, state string, cvss double, detail string")
    return components, depends, states


def test_spdx3(spark):
    components, depends, _ = _tables(spark)
    text = _text(exchange.spdx3(components, depends, "n", 0))
    assert text == _text(exchange.spdx3(components.repartition(3), depends, "n", 0))
    graph = json.loads(text)["@graph"]
    packages = {x["name"]: x for x in graph if x["type"] == "software_Package"}
    assert sorted(packages) == ["a", "b", 'c"\n'] and "software_packageVersion" not in packages["a"]
    links = [x for x in graph if x["type"] == "Relationship"]
    assert [(x["from"], x["to"]) for x in links] == [(packages["b"]["spdxId"], [packages['c"\n']["spdxId"]])]
    assert len({x.get("spdxId", x.get("@id")) for x in graph}) == len(graph)
    empty = json.loads(_text(exchange.spdx3(components.filter("false"), depends, "n", 0)))["@graph"]
    assert sorted(x["type"] for x in empty) == ["CreationInfo", "SoftwareAgent", "SpdxDocument"]


def test_cyclonedx(spark):
    schema = "ref string, name string, version string, purl string, cpe string, licence string, confidence double, technique string, paths array<string>, ancestor string, patched boolean"
    rows = [("a", "A", "1", "pkg:x/a@1", None, "MIT OR ISC", 0.9, "source-code-analysis", ["src/b.c", "src/a.c"], "pkg:x/a@1.0", True), ("b", "B", None, None, "cpe:2.3:a:v:b:*", None, None, None, None, None, None), ("c", "C", "2", None, None, None, None, None, [], "pkg:x/c", None)]
    components = spark.createDataFrame(rows, schema)
    depends = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "c"), ("a", "gone"), ("gone", "a"), (None, "a")], "ref string, on string")
    text = _text(exchange.cyclonedx(components, depends, 0))
    assert text == _text(exchange.cyclonedx(components.repartition(3), depends, 0))
    bom = json.loads(text)
    a, b, c = bom["components"]
    assert a["evidence"]["occurrences"] == [{"location": "src/a.c"}, {"location": "src/b.c"}] and a["evidence"]["identity"][0]["methods"] == [{"technique": "source-code-analysis", "confidence": 0.9}]
    assert a["pedigree"] == {"ancestors": [{"type": "library", "name": "A", "purl": "pkg:x/a@1.0"}], "patches": [{"type": "unofficial"}]} and a["licenses"] == [{"expression": "MIT OR ISC"}]
    assert sorted(b) == ["bom-ref", "cpe", "name", "type"] and "patches" not in c["pedigree"] and "evidence" not in c
    assert bom["dependencies"] == [{"ref": "a", "dependsOn": ["b"]}, {"ref": "a", "dependsOn": ["c"]}]
    empty = json.loads(_text(exchange.cyclonedx(components.filter("false"), depends, 0)))
    assert empty["components"] == [] and empty["dependencies"] == []


def test_vex(spark):
    states = _tables(spark)[2]
    said = json.loads(_text(exchange.cyclonedx_vex(states, 0)))["vulnerabilities"]
    assert sorted((x["id"], x["analysis"].get("state"), x["analysis"].get("justification")) for x in said if x["id"] != "GHSA-2") == [("CVE-2020-1234", "exploitable", None), ("CVE-2020-1234", "not_affected", "code_not_present"), ("GHSA-1", "in_triage", None)]
    csaf = json.loads(_text(exchange.csaf(states, "me", "https://me.test", 0)))
    ids = {x["name"]: x["product_id"] for x in csaf["product_tree"]["full_product_names"] if "name" in x}
    got = {(x.get("cve") or x["ids"][0]["text"], *x["product_status"]): x for x in csaf["vulnerabilities"]}
    assert sorted(got) == [("CVE-2020-1234", "known_affected"), ("CVE-2020-1234", "known_not_affected"), ("GHSA-1", "under_investigation"), ("GHSA-2", "under_investigation")]
    assert got["CVE-2020-1234", "known_affected"]["remediations"][0]["product_ids"] == [ids["pkg:x/y"]]
    assert got["CVE-2020-1234", "known_not_affected"]["flags"][0]["product_ids"] == [ids["pkg:x/z"]]
    assert json.loads(_text(exchange.csaf(states.filter("false"), "me", "https://me.test")))["vulnerabilities"] == []


def test_bills_and_tables(spark, tmp_path):
    assets = spark.createDataFrame([("RSA", "vulnerable", 2, 5, "a.c"), ("AES", "symmetric", 1, 1, "b.c")], "family string, class string, files long, hits long, first string")
    bom = json.loads(_text(exchange.cbom(assets, 0)))["components"]
    assert [(x["name"], x["evidence"]["occurrences"]) for x in bom] == [("AES", [{"location": "b.c"}]), ("RSA", [{"location": "a.c"}])]
    models = spark.createDataFrame([("m/a.gguf", "GGUF", "00", None, "1", "mit", "llama"), ("b.onnx", "ONNX", None, None, None, None, None)], "path string, format string, sha256 string, name string, version string, licence string, architecture string")
    bom = {x["name"]: x for x in json.loads(_text(exchange.aibom(models, 0)))["components"]}
    assert bom["a.gguf"]["modelCard"]["modelParameters"]["modelArchitecture"] == "llama" and "hashes" not in bom["b.onnx"]
    rows = spark.createDataFrame([("b|c\nd", 1), ("a", None)], "id string, n long")
    assert _text(exchange.markdown(rows, ["id", "n"], "T")) == "# T\n\n| id | n |\n|-|-|\n| a |  |\n| b\\|c<br>d | 1 |"
    exchange.write(exchange.cbom(assets, 0), str(tmp_path / "out"))
    parts = sorted((tmp_path / "out").glob("part-*"))
    assert json.loads("".join(p.read_text() for p in parts))["components"][0]["name"] == "AES"


LEGACY = {
    "CVE_data_type": "CVE",
    "CVE_Items": [
        {
            "cve": {"CVE_data_meta": {"ID": "CVE-2"}, "description": {"description_data": [{"lang": "en", "value": "old ] } é"}]}, "references": {"reference_data": [{"url": "u"}]}},
            "configurations": {"nodes": [{"operator": "AND", "children": [{"cpe_match": [{"vulnerable": True, "cpe23Uri": "cpe:2.3:a:v:p:*:*:*:*:*:*:*:*", "versionEndExcluding": "3"}]}], "cpe_match": []}]},
            "impact": {"baseMetricV3": {"cvssV3": {"version": "3.0", "baseScore": 7.5, "baseSeverity": "HIGH"}}, "baseMetricV2": {"cvssV2": {"baseScore": 5.0}, "severity": "MEDIUM"}},
        },
        {"cve": {"CVE_data_meta": {"ID": "CVE-3"}}},
    ],
}


def test_packed_feeds(spark, tmp_path):
    folder = tmp_path / "nvd"
    folder.mkdir()
    (folder / "old.json.xz").write_bytes(lzma.compress(json.dumps(LEGACY).encode()))
    (folder / "mirror.json.gz").write_bytes(gzip.compress(json.dumps({"cve_items": [{"id": "CVE-4", "metrics": {"cvssMetricV2": [{"cvssData": {"baseScore": 4.0}, "baseSeverity": "LOW"}]}}]}).encode()))
    (folder / "none.json").write_text("{}")
    (folder / "empty.json").write_text('{"vulnerabilities": []}')
    got = feeds.read_nvd(spark, str(folder))
    assert sorted((r.advisory_id, r.cvss, r.severity, r.summary) for r in got.collect()) == [("CVE-2", 7.5, "high", "old ] } é"), ("CVE-3", None, None, None), ("CVE-4", 4.0, "low", None)]
    assert [(r.advisory_id, r.key, r.fixed) for r in feeds.nvd_ranges(got).collect()] == [("CVE-2", "v:p", "3")]
    (tmp_path / "epss.csv.xz").write_bytes(lzma.compress(b"#model_version:v1\ncve,epss,percentile\nCVE-1,0.5,0.9\r\nCVE-2,0.25,0.1\n"))
    assert sorted(feeds.read_epss(spark, str(tmp_path / "epss.csv.xz")).collect()) == [("CVE-1", 0.5, 0.9), ("CVE-2", 0.25, 0.1)]


@pytest.mark.parametrize("size", [1, 7, 1 << 20])
def test_records_are_streamed(size):
    items = [{"n": k, "text": "[]{}," * k} for k in range(9)]
    text = json.dumps({"head": {"a": [1]}, "cve_items": items, "tail": 1})
    assert [x for _, x in feeds.records(io.StringIO(text), size=size)] == items
    with pytest.raises(ValueError, match="breaks off"):
        list(feeds.records(io.StringIO(text[:-60]), size=size))
