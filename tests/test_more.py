import gzip
import io
import struct
import zipfile
import zlib

from pyspark.sql import functions as F

from tessera.functions import packages
from tessera.operators import advisories, compose, crypto, graph
from tessera.sources import binaries, build, containers


def test_package_keys_order():
    dpkg = ["~~", "~", "1.0~rc1", "1.0", "1.0-1", "1.0a", "1.0+b", "1.2", "1.10", "1:0.1"]
    keys = [packages.dpkg_key(v) for v in dpkg]
    assert keys == sorted(keys) and len(set(keys)) == len(keys)
    assert packages.dpkg_key("1.0") == packages.dpkg_key("0:1.0-0") and packages.dpkg_key("not a version") is None
    apk = ["1.2_alpha1", "1.2_beta", "1.2_rc1", "1.2_rc2", "1.2", "1.2-r1", "1.2_git20200101", "1.2_p1", "1.2a", "1.2.0", "1.10"]
    keys = [packages.apk_key(v) for v in apk]
    assert keys == sorted(keys) and len(set(keys)) == len(keys)


def test_distro_verdicts_must_agree(spark):
    row = spark.range(1).select(*[packages.distro_verdict(F.lit(x).cast("array<boolean>")).alias(f"c{k}") for k, x in enumerate([[True, True], [True, False], [True, None], []])]).first()
    assert tuple(row) == (True, None, None, None)


def test_containers(spark):
    image = bytes(range(32))
    hexa = b":10000000" + image[:16].hex().upper().encode() + b"%02X\n" % (-(0x10 + sum(image[:16])) & 0xFF) + b":00000001FF\n"
    assert containers.intel_hex(hexa) == image[:16] and containers.intel_hex(hexa.replace(b"00", b"01", 1)) is None
    body = bytes([3 + 4, 0, 0]) + b"\1\2\3\4"
    assert containers.srec(b"S1" + (body + bytes([~sum(body) & 0xFF])).hex().encode()) == b"\1\2\3\4"
    block = struct.pack("<8I", 0x0A324655, 0x9E5D5157, 0, 0x100, 4, 0, 1, 0) + b"abcd".ljust(476, b"\0") + struct.pack("<I", 0x0AB16F30)
    assert containers.uf2(block) == b"abcd"
    name = b"etc/x\0"
    head = b"070701" + b"%08X" * 13 % (1, 0o100644, 0, 0, 1, 0, 3, 0, 0, 0, 0, len(name), 0) + name
    archive = head + b"\0" * (-len(head) % 4) + b"hey\0" + b"070701" + b"%08X" * 13 % (0, 0, 0, 0, 1, 0, 0, 0, 0, 0, 0, 11, 0) + b"TRAILER!!!\0"
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("root.cpio.gz", gzip.compress(archive))
    files = spark.createDataFrame([("a.zip", bytearray(packed.getvalue())), ("junk", bytearray(b"\x1f\x8bnot gzip")), ("none", None)], "path string, content binary")
    got = {(r.inside, r.depth): bytes(r.content) for r in containers.expanded(files).collect()}
    assert got["root.cpio.gz/gzip/etc/x", 3] == b"hey" and len(got) == 3


def elf_file():
    names = b"\0init_lib\0local\0"
    symbols = struct.pack("<IBBHQQ", 0, 0, 0, 0, 0, 0) + struct.pack("<IBBHQQ", 1, 0x12, 0, 1, 0, 0) + struct.pack("<IBBHQQ", 10, 0x02, 0, 1, 0, 0)
    at = 64
    sections = [(0, 0, 0, 0, 0), (0, 2, at, len(symbols), 2), (0, 3, at + len(symbols), len(names), 0)]
    table = at + len(symbols) + len(names)
    head = b"\x7fELF\x02\x01\x01" + b"\0" * 9 + struct.pack("<HHIQQQIHHHHHH", 2, 183, 1, 0, 0, table, 0, 64, 0, 0, 64, len(sections), 0)
    return head + symbols + names + b"".join(struct.pack("<IIQQQQIIQQ", n, k, 0, 0, b, s, link, 0, 0, 0) for n, k, b, s, link in sections)


def test_binaries(spark):
    files = spark.createDataFrame([("a.so", bytearray(elf_file())), ("b", bytearray(b"\x7fELFbroken")), ("c", bytearray(b"text that is long enough\0x"))], "path string, content binary")
    row = binaries.elf_rows(files).collect()
    assert [(r.path, r.machine, r.bits, r.symbols) for r in row] == [("a.so", "aarch64", 64, ["init_lib"])]
    wanted = spark.createDataFrame([("lib", "init_lib", 1), ("two", "init_lib", 2)], "library string, symbol string, need int")
    assert [r.library for r in binaries.libraries(binaries.elf_rows(files).select("path", F.explode("symbols").alias("symbol")), wanted).collect()] == ["lib"]
    assert "text that is long enough" in {r.s for r in binaries.string_rows(files).collect()}
    noise = b"".join(zlib.crc32(bytes([k & 255, k >> 8])).to_bytes(4, "big") for k in range(4000))
    assert binaries.incompressible(noise) and not binaries.incompressible(b"a" * 9000) and not binaries.incompressible(b"x")


def test_other_link_maps():
    iar = "IAR ELF Linker V9\n*** MODULE SUMMARY\n\nC:\\proj\\obj: [1]\n    main.o   100  4\n    dead.o\nm7M_tl.a: [2]\n    abs.o   6\n*** ENTRY LIST\n"
    assert [(r["archive"], r["member"], r["kept"]) for r in build.link_map(iar)] == [(None, "dead.o", False), (None, "main.o", True), ("m7M_tl.a", "abs.o", True)]
    arm = "Component: ARM Compiler 5\n    Removing gone.o(.text), (10 bytes).\nImage component sizes\n  Code (inc. data) RO Data RW Data ZI Data Debug Object Name\n   10  2  4  0  8  100   main.o\n Code Library Member Name\n   10  2  4  0  8  100   __main.o\n"
    assert {(r["member"], r["kept"]) for r in build.link_map(arm)} >= {("main.o", True), ("gone.o", False)}
    ti = "TI ARM Linker Unix v20\nMODULE SUMMARY\n       Module   code\n    ./src/\n       main.obj   100 0 4\n    rtsv7.lib\n       memcpy.obj  20 0 0\nLINKER GENERATED\n"
    assert {(r["archive"], r["member"]) for r in build.link_map(ti)} == {(None, "main.obj"), ("rtsv7.lib", "memcpy.obj")}
    gnu = "Discarded input sections\n .text.dead\n                0x0 0x10 a.o\nLinker script and memory map\n .text.live 0x10 0x20 a.o\n"
    assert build.function_sections(gnu) == [{"function": "dead", "object": "a.o", "kept": False}, {"function": "live", "object": "a.o", "kept": True}]


def test_crypto(spark):
    files = spark.createDataFrame([("a.c", "mbedtls_aes_init(); x = caesar_cipher; AES_encrypt(k);"), ("b.c", "description = 3; MD5_Init(&c); sm2_sign();")], "path string, text string")
    got = {r.family: (r["class"], r.hits) for r in crypto.inventory(files).collect()}
    assert got == {"AES": ("symmetric", 2), "MD5": ("broken", 1), "SM2": ("vulnerable", 1)}
    assert [r["class"] for r in crypto.readiness(crypto.inventory(files)).collect()] == ["vulnerable", "broken", "symmetric"]
    assert crypto.failing(crypto.inventory(files)).count() == 2 and len(crypto.FAMILIES) == 25


def test_composition(spark):
    rows = [("d1", 1, "r1", "zlib", None, "pkg:g/zlib", None, {"a": "1"}), ("d2", 1, "r9", "zlib", "1.3", "pkg:g/zlib", "NOASSERTION", {"b": "2"}), ("d2", 2, "r8", "x", "1", None, "me", None)]
    t = spark.createDataFrame(rows, "document string, ordinal int, ref string, name string, version string, purl string, supplier string, properties map<string,string>")
    got = {r.name: (r.version, r.supplier, r.kept_ref, r.documents, len(r.properties)) for r in compose.merged_boms(t).collect()}
    assert got == {"zlib": ("1.3", None, "r1", ["d1", "d2"], 2), "x": ("1", "me", "r8", ["d2"], 0)}
    claims = spark.createDataFrame([("d", "a.c", "big", 50, 50, False), ("d", "a.c", "nam", 9, 10, True), ("d", "b.c", "big", 45, 50, False), ("d", "c.c", "low", 5, 50, False)], "directory string, path string, owner string, held long, own long, named boolean")
    assert sorted((r.owner, r.files, r.functions) for r in compose.loose_groups(claims).collect()) == [("big", 1, 45), ("nam", 1, 9)]
    score = compose.standard_score(spark.createDataFrame([("s", 1.0), ("s", 0.5)], "standard string, share double")).first()
    assert score.out_of_ten == 7.5


def test_evidence(spark):
    entries = spark.createDataFrame([("C1", "CVE-1", "high", "t"), ("C2", None, "low", "Flaw in zlib before 1"), ("C3", None, "low", "zlibber")], "cn_id string, cve string, severity_cn string, title string")
    matches = spark.createDataFrame([("CVE-1", "low"), ("CVE-2", "low")], "vuln_key string, severity string")
    assert sorted((r.vuln_key, r.cn_id, r.severity_disagrees) for r in advisories.cn_enriched(matches, entries).collect()) == [("CVE-1", "C1", True), ("CVE-2", None, None)]
    parts = spark.createDataFrame([("zlib", "https://github.com/madler/zlib.git"), ("ab", None)], "component string, repository string")
    assert [tuple(r) for r in advisories.cn_candidates(parts, entries).collect()] == [("zlib", "C2")]
    refs = spark.createDataFrame([("cpe:2.3:a:z:zlib:1", "https://github.com/madler/zlib/commit/1"), ("cpe:2.3:a:q:zlib:1", "https://x.org/a"), ("cpe:2.3:a:z:other:1", "https://github.com/madler/zlib2/x")], "cpe string, url string")
    assert sorted((r.cpe, r.strength) for r in advisories.cpe_evidence(refs, parts).collect()) == [("cpe:2.3:a:q:zlib:1", "weak"), ("cpe:2.3:a:z:zlib:1", "strong")]
    table = spark.createDataFrame([("r", "TLS", "1.0", "2.0"), ("r", "old", None, "1.0"), ("r", "all", None, None)], "rule_id string, capability string, since string, until string")
    got = {r.capability: r.verdict for r in advisories.capabilities(spark.createDataFrame([("c", "r", "1.5")], "component string, rule_id string, version string"), table).collect()}
    assert got == {"TLS": True, "old": False, "all": True}


def test_calls(spark):
    f = spark.createDataFrame([("d", "main", ["f", "printf"]), ("d", "f", ["g"]), ("e", "g", []), ("e", "f", [])], "directory string, name string, calls array<string>")
    edges = graph.call_edges(f)
    assert sorted((r.src, r.dst) for r in edges.collect()) == [("f", "g"), ("main", "f")]
    one = lambda *x: spark.createDataFrame([(v,) for v in x], "symbol string")
    assert sorted(map(tuple, graph.reach_verdict(one("f", "g", "q", "x"), one("f", "g", "x"), one("f"), one("x")).collect())) == [("f", "reachable"), ("g", "unreachable"), ("q", "absent"), ("x", "discarded")]
    text = F.lit("The parse_header() call and function inflate_fast, or the `read_chunk` one; my_func function.")
    assert spark.range(1).select(graph.prose_symbols(text)).first()[0] == ["parse_header", "inflate_fast", "my_func", "read_chunk"]


def test_deep_paths_and_long_chains(spark):
    from tessera.operators import paths

    deep = "/".join(f"d{k}" for k in range(15))
    rows = spark.createDataFrame([(1, deep + "/x.c"), (2, "a/b.c")], "id int, path string")
    holders = spark.createDataFrame([("/".join(deep.split("/")[:12]),), ("d0",)], "holder string")
    assert {r.id: r.holder for r in paths.nearest_enclosing(rows, holders, "id").collect()} == {1: "/".join(deep.split("/")[:12]), 2: None}
    n = 5000
    chain = spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = graph.groups(chain)
    assert got.count() == n and {r.component for r in got.select("component").distinct().collect()} == {0}


def test_holders(spark):
    from tessera.functions import provenance

    heads = {
        "/* Copyright (c) 2011-2021 The Blue Harbour Systems Ltd. All rights reserved */": "blue harbour", "// Copyright notice\n// Copyright 2018, Ines Vega <ines@y.org>": "ines vega", "// SPDX-License-Identifier: MIT OR ISC": "license:mit",
        "Licensed under the Apache License, Version 2.0": "license:apache-2.0", "nothing here": None, "Copyright 2001-2003 by the authors": None, "see https://x.org for copyright of others": None, "COPYRIGHT 1999 Orla": "orla",
    }
    t = spark.createDataFrame(list(heads), "string").toDF("head")
    assert {r.head: r.holder for r in t.select("head", provenance.holder(F.col("head")).alias("holder")).collect()} == heads
    names = {"ring_push": "ring", "tskDelay": "tsk", "__main_loop": None, "x_y": None, "plain": None, "ACME_RTT_Write": "acme"}
    t = spark.createDataFrame(list(names), "string").toDF("n")
    assert {r.n: r.p for r in t.select("n", provenance.name_prefix(F.col("n")).alias("p")).collect()} == names


def test_probes_and_reports(spark):
    from tessera.operators import discover

    text = F.lit("#define MAJOR 2\n#define VERSION 0x0a\nEXTRA = rc2\n")
    got = spark.range(1).select(
        discover.probe(text, {"a": r"MAJOR (\d+)", "hex_b": r"VERSION (0x[0-9a-f]+)", "dash_c": r"EXTRA = (\w*)"}, "v{a}.{b}{c}"), discover.probe(text, {"a": r"MINOR (\d+)"}, "{a}"),
        discover.patched(F.lit(False), F.lit(0), F.lit(False), F.lit("1"), F.lit("1")), discover.patched(F.lit(None).cast("boolean"), F.lit(None).cast("int"), F.lit(False), F.lit("1"), F.lit("2")),
        discover.licences_differ(F.lit("MIT OR ISC"), F.array(F.lit("isc"))), discover.licences_differ(F.lit("MIT"), F.array(F.lit("MIT"), F.lit("Zlib"))), discover.licences_differ(F.lit(None).cast("string"), F.array(F.lit("MIT"))),
        discover.band(F.lit(0.85))["name"], discover.derivative(F.lit(300), F.lit(1001)), discover.derivative(F.lit(300), F.lit(1000)),
    ).first()
    assert tuple(got) == ("v2.10-rc2", None, True, False, False, True, False, "strong", False, True)
    rows = discover.asserted(spark.createDataFrame([(0.5,), (0.9,), (None,)], "identity double"), 0.6).collect()
    assert [r.possible for r in rows] == [True, False, True]
