import json
import struct

from pyspark.sql import functions as F

from tessera.sources import build, csource, declared, documents, feeds, models

CODE = '''/* skip f(x) { } */ extern "C" {
static int add(int a, int b) { int t = a + b; return t > 10UL ? t : 0; }
#if A
int two(void) { if (1) { x = 1; y = 2;
#else
int two(void) { if (2) { x = 3; z = 4;
#endif
 } return 0; }
int old(a) int a; { a = a + 1; a = a * 2; return a; }
}
int tiny(void) { ; }
int proto(int);
'''


def test_functions_and_tokens():
    assert [(f["name"], f["line"]) for f in csource.functions(CODE)] == [("add", 2), ("two", 4), ("old", 9)]
    assert [t for t, _ in csource.tokenize('x = 0x10UL; // no\n"a // b"')] == ["x", "=", "0x10", ";", '"a // b"']
    add = csource.functions(CODE)[0]["tokens"]
    renamed = csource.functions(CODE.replace("add", "sum").replace(" t ", " total "))[0]["tokens"]
    assert add != renamed and csource.abstract(add) == csource.abstract(renamed)


def test_function_rows_analyse_contents_once(spark):
    files = spark.createDataFrame([("a.c", CODE), ("copy/a.c", CODE), ("e.c", ""), ("n.c", None)], "path string, text string")
    got = csource.function_rows(files).groupBy("path").count().collect()
    assert {r["path"]: r["count"] for r in got} == {"a.c": 3, "copy/a.c": 3}


def test_conditions_are_three_valued():
    m = {"ON": 1, "ZERO": 0, "MAYBE": None}
    cases = {"ON": True, "ZERO": False, "NONE": False, "MAYBE": None, "MAYBE && 0": False, "MAYBE || 1": True, "defined(ON) && !defined(NONE)": True, "defined MAYBE": None, "ON + 1 == 2": True, "IS_ENABLED(ON)": True, "F(1)": None, "1 /": None, "(ON": None}
    assert {k: csource.evaluate(k, m) for k in cases} == cases
    text = "#if ON\na\n#elif MAYBE\nb\n#else\nc\n#endif\n#if MAYBE\nd\n#else\ne\n#endif\n#ifndef ON\nf\n#endif"
    assert csource.inactive_lines(text, m) == [4, 6, 14]


def test_build_records(spark):
    text = "Discarded input sections\n .text 0x0 0x10 libn.a(b.o)\n .text.x 0x0 0x1 libn.a(c.o)\nLinker script and memory map\n .text 0x10 0x20 libn.a(c.o)\n .text 0x10 0x0 empty.o\n .data 0x30 0x4 main.o\n"
    assert build.link_map(text) == [{"archive": None, "member": "main.o", "kept": True}, {"archive": "libn.a", "member": "b.o", "kept": False}, {"archive": "libn.a", "member": "c.o", "kept": True}]
    assert build.kconfig('CONFIG_A=y\n# CONFIG_B is not set\nCONFIG_C="x"\n# note\n')[1] == {"symbol": "CONFIG_B", "value": None, "state": False}
    values = spark.createDataFrame([("CONFIG_A", False), ("CONFIG_B", True)], "symbol string, state boolean")
    parts = spark.createDataFrame([("off", ["CONFIG_A"]), ("on", ["CONFIG_A", "CONFIG_B"]), ("unknown", ["CONFIG_A", "CONFIG_Z"])], "component string, alternatives array<string>")
    assert [r[0] for r in build.gated_off(parts, values).collect()] == ["off"]
    members = build.per_file(spark.createDataFrame([("m.map", text)], "path string, text string"), build.link_map, build.LINK_MEMBERS)
    sources = spark.createDataFrame([("src/b.c",), ("src/c.c",), ("src/q.c",)], "path string")
    assert {r.path: r.linked for r in build.linked_sources(sources, members).collect()} == {"src/b.c": False, "src/c.c": True, "src/q.c": None}
    iar = "<project><fileVersion>3</fileVersion><group><name>g</name><excluded/><file><name>$PROJ_DIR$\\a.c</name></file></group><file><name>b.c</name></file></project>"
    assert build.ide_project(iar) == [{"source": "b.c", "excluded": False}, {"source": "./a.c", "excluded": True}]
    assert build.compile_commands('[{"file": "a.c", "directory": "/x"}]') == [{"file": "a.c", "directory": "/x", "output": None}]


def test_declarations(spark):
    files = {
        "/p/Cargo.lock": '[[package]]\nname = "zlib-sys"\nversion = "1.2.3"\n[[package]]\nname = "serde"\nversion = "1.0.0"\n', "/r/var/lib/dpkg/status": "Package: zlib1g\nStatus: install ok installed\nVersion: 1:1.2.11-4\n\nPackage: gone\nStatus: deinstall ok config-files\nVersion: 1\n",
        "/r/lib/apk/db/installed": "P:musl\nV:1.2.4-r0\n\n", "/p/vcpkg.json": '{"dependencies": ["fmt", {"name": "cmake-tool", "host": true}], "overrides": [{"name": "fmt", "version": "9.1.0"}]}', "/p/s/zlib.wrap": "[wrap-file]\ndirectory = zlib-1.3\nsource_url = http://x\n",
        "/p/CMakeLists.txt": "FetchContent_Declare(json GIT_REPOSITORY https://g/j GIT_TAG v3.11.2) CPMAddPackage(\"gh:fmtlib/fmt#10.0.0\") FetchContent_Declare(dev GIT_REPOSITORY u GIT_TAG main)", "/p/library.properties": "name=Servo\nversion=1.1.8\n",
        "/p/platformio.ini": "[env]\nlib_deps =\n  bblanchon/ArduinoJson @ 6.19.4\n  Other @ ^1.0\n", "/p/dependencies.lock": "dependencies:\n  espressif/mdns:\n    version: 1.2.0\n", "/p/conan.lock": '{"requires": ["zlib/1.2.13#x", "b/[>1]"]}', "/p/conanfile.txt": "[requires]\nfmt/9.1.0\n[generators]\n",
        "/p/MODULE.bazel": 'bazel_dep(name = "zlib", version = "1.3.bcr.1")\nbazel_dep(name = "t", version = "1", dev_dependency = True)', "/k/Makefile": "VERSION = 5\nPATCHLEVEL = 10\nSUBLEVEL = 1\nNAME = X\n", "/w/Makefile": "PKG_NAME:=curl\nPKG_VERSION:=8.0.1\n", "/b/busybox.mk": "BUSYBOX_VERSION = 1.36.1\n",
        "/o/README.OpenSource": '[{"Name": "zlib", "Version Number": "v1.2.11"}]', "/x/deploy/i.manifest": "busybox core 1.35.0-r0\n", "/q/a.pdsc": '<name>ARM</name><release version="5.9.0">', "/t/packages/pkgs.json": '[{"name": "cJSON", "ver": "v1.7.15"}]', "/bad/Cargo.lock": "not toml [",
    }
    got = {(r.ecosystem, r.name, r.version) for r in declared.declarations(spark.createDataFrame(list(files.items()), "path string, text string")).collect()}
    assert got == {
        ("cargo", "zlib-sys", "1.2.3"), ("dpkg", "zlib1g", "1:1.2.11-4"), ("apk", "musl", "1.2.4-r0"), ("vcpkg", "fmt", "9.1.0"), ("meson", "zlib", "1.3"), ("cmake", "json", "3.11.2"), ("cmake", "fmt", "10.0.0"), ("cmake", "dev", None), ("arduino", "Servo", "1.1.8"),
        ("platformio", "ArduinoJson", "6.19.4"), ("platformio", "Other", None), ("idf", "espressif/mdns", "1.2.0"), ("conan", "zlib", "1.2.13"), ("conan", "b", None), ("conan", "fmt", "9.1.0"), ("bazel", "zlib", "1.3"), ("kbuild", "kernel", "5.10.1"), ("openwrt", "curl", "8.0.1"),
        ("buildroot", "busybox", "1.36.1"), ("openharmony", "zlib", "v1.2.11"), ("yocto", "busybox", "1.35.0"), ("cmsis-pack", "ARM", "5.9.0"), ("rtthread", "cJSON", "1.7.15"),
    }


def test_feeds(spark, tmp_path):
    match = {"vulnerable": True, "criteria": "cpe:2.3:a:v:p:*:*:*:*:*:*:*:*", "versionEndExcluding": "2.0"}
    nvd = {"vulnerabilities": [{"cve": {"id": "CVE-1", "descriptions": [{"lang": "en", "value": "s"}], "metrics": {"cvssMetricV31": [{"cvssData": {"baseScore": 9.8, "baseSeverity": "CRITICAL"}}]}, "configurations": [{"nodes": [{"cpeMatch": [match, match | {"vulnerable": False}, {"vulnerable": True, "criteria": "cpe:2.3:a:v:q:1.5:*:*"}]}]}]}}]}
    (tmp_path / "nvd.json").write_text(json.dumps(nvd))
    records = feeds.read_nvd(spark, str(tmp_path / "nvd.json"))
    assert (records.first().cvss, records.first().severity) == (9.8, "critical")
    assert sorted((r.key, r.introduced, r.fixed, r.last_affected) for r in feeds.nvd_ranges(records).collect()) == [("v:p", None, "2.0", None), ("v:q", "1.5", None, "1.5")]
    wanted = spark.createDataFrame([("v:q",)], "key string")
    assert feeds.nvd_ranges(records, wanted).count() == 1
    osv = {"id": "OSV-1", "aliases": ["CVE-9"], "upstream": ["CVE-8"], "affected": [{"package": {"purl": "pkg:npm/x"}, "ranges": [{"type": "SEMVER", "events": [{"introduced": "0"}, {"fixed": "1.2"}, {"introduced": "2.0"}]}, {"type": "GIT", "events": [{"introduced": "abc"}]}], "versions": ["1.0"]}]}
    (tmp_path / "osv.json").write_text(json.dumps(osv))
    got = feeds.read_osv(spark, str(tmp_path / "osv.json"))
    assert got.first().aliases == ["CVE-9", "CVE-8"]
    r = {x.kind: x for x in feeds.osv_ranges(got).collect()}
    assert [tuple(i) for i in r["SEMVER"].intervals] == [("0", "1.2", None), ("2.0", None, None)] and r["GIT"].intervals is None and r["GIT"].tags == ["1.0"]
    (tmp_path / "cn.csv").write_text('﻿编号,说明\nX-1,"about, CVE-2020-1234"\nX-2,none\n', encoding="utf-8")
    assert [r.cve for r in feeds.read_cn_csv(spark, str(tmp_path / "cn.csv")).collect()] == ["CVE-2020-1234", None]


def test_documents(spark, tmp_path):
    rows = spark.createDataFrame([("b", "1.0", "pkg:npm/b@1.0", None), ("a", None, None, "cpe:2.3:a:v:a:*")], "name string, version string, purl string, cpe string")
    first = documents.cyclonedx(rows, 0)
    assert first == documents.cyclonedx(rows.repartition(3), 0)
    (tmp_path / "bom.json").write_text(first)
    keys = documents.channel_keys(documents.read_cyclonedx(spark, str(tmp_path / "bom.json")))
    assert sorted((r.channel, r.key) for r in keys.collect()) == [("cpe", "v:a"), ("purl", "npm/b")]
    assert json.loads(documents.spdx(rows, "n", 0))["packages"][1]["versionInfo"] == "1.0"
    states = spark.createDataFrame([("CVE-1", "pkg:x/y", "in_triage"), ("CVE-1", "pkg:x/z", "not_affected")], "vuln_key string, purl string, state string")
    assert [s["status"] for s in json.loads(documents.openvex(states, "me", 0))["statements"]] == ["under_investigation", "not_affected"]


def test_models(spark):
    text = lambda s: struct.pack("<Q", len(s)) + s.encode()
    gguf = b"GGUF" + struct.pack("<IQQ", 3, 0, 2) + text("general.name") + struct.pack("<I", 8) + text("tiny") + text("n") + struct.pack("<II", 4, 7)
    files = spark.createDataFrame([("a.bin", bytearray(gguf)), ("b.onnx", bytearray(b"x")), ("c.onnx", bytearray(b"abcdTFL3")), ("d.txt", bytearray(b""))], "path string, content binary")
    assert sorted((r.path, r.format, r.by) for r in models.sniffed(files).collect()) == [("a.bin", "GGUF", "magic"), ("b.onnx", "ONNX", "suffix"), ("c.onnx", "TFLite", "magic")]
    assert models.gguf_details(files).first().details == {"general.name": "tiny", "n": "7"}


def test_tree_scan(spark, tmp_path):
    for p in ("src/a.c", ".git/x.c", "src/__pycache__/y.c"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("int x;")
    assert [r.path.endswith("src/a.c") for r in build.whole_files(spark, str(tmp_path)).select("path").collect()] == [True]
    assert build.whole_files(spark, str(tmp_path)).filter(F.length("text") == 6).count() == 1
