import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import identity, licences, provenance, severity, text, versions


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_shingles_and_sketches(spark):
    words = text.tokens(F.lit("The quick, brown fox! The QUICK brown fox jumps"))
    assert one(spark, F.size(words), F.size(text.shingles(words, 4)), F.size(text.shingles(F.slice(words, 1, 2), 4)), F.size(text.shingles(F.slice(words, 1, 0), 4))) == (9, 6, 1, 0)
    h = F.array(*[F.lit(x).cast("long") for x in (9, 3, 7, 1, 8, 2)])
    assert one(spark, text.winnow(h, 3), text.winnow(h, 10), text.bottom_k(h, 2)) == ([3, 1], [1], [1, 2])
    assert one(spark, text.h60(F.lit("abc"))) == (648541476951500027,)


def test_sketch_merge_is_exact_and_tracks_jaccard(spark):
    rng = random.Random(1)
    a, b = {rng.getrandbits(60) for _ in range(3000)}, {rng.getrandbits(60) for _ in range(3000)}
    b |= set(sorted(a)[::2])
    rows = spark.createDataFrame([(sorted(a), sorted(b))], "a array<bigint>, b array<bigint>")
    k = 256
    merged, whole, similar = rows.select(text.bottom_k(F.concat(text.bottom_k("a", k), text.bottom_k("b", k)), k), text.bottom_k(F.concat("a", "b"), k), text.kmv_similarity(text.bottom_k("a", k), text.bottom_k("b", k), k)).first()
    assert merged == whole
    assert abs(similar - len(a & b) / len(a | b)) < 0.08


def test_near_diff(spark):
    s = lambda *x: F.array(*[F.lit(v).cast("long") for v in x])
    base, hole, fix = range(100, 130), range(200, 210), range(300, 310)
    before, after = s(*base, *hole), s(*base, *fix)
    trees = [s(*base, *fix, 900), s(*base, *hole, 900), s(1, 2, 3), s(*base, *hole, *fix), s(*base, *range(300, 305), *range(200, 205))]
    assert one(spark, *[text.near_diff(before, after, t) for t in trees]) == ("fixed", "vulnerable", "unrelated", "unclear", "unclear")
    # an insertion removes nothing but its seam: lacking it is enough
    assert one(spark, text.near_diff(s(*base, 200), after, s(*base, 200)), text.near_diff(s(*base), s(*base, 300), s(*base))) == ("vulnerable", None)


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [("1.1.1w", "1.1.1", 1), ("1.0.2za", "1.0.2z", 1), ("1.0-rc1", "1.0", -1), ("1.0~rc1", "1.0", -1), ("1.0a1", "1.0", -1), ("R0.14b", "R0.14a", 1), ("1.0.dev1", "1.0-alpha", -1), ("1.0-SNAPSHOT", "1.0-rc9", 1),
     ("0.2-265-gad902ca", "0.2", 1), ("0.2-265-gad902ca", "0.2.1", None), ("0.2-3-gad902ca", "0.2-4-gbbb902c", None), ("deadbeef", "1.0", None), ("10.4.0~10.4.2", "10.4.1", None), ("v2", "2.0.0", 0), ("main", "1", None), (None, "1", None)],
)
def test_compare(spark, a, b, want):
    assert one(spark, versions.compare(F.lit(a).cast("string"), F.lit(b))) == (want,)


@pytest.mark.parametrize(
    ("version", "bounds", "want"),
    [("1.5", ("1.0", None, "2.0", None), True), ("2.0", ("1.0", None, "2.0", None), False), ("2.0", (None, None, None, "2.0"), True), ("1.0", (None, "1.0", None, None), False), ("git-1", ("1.0", None, None, None), None),
     ("1.5", (None, None, None, None), None), ("1.5", ("0", None, None, None), True), ("1.2~1.4", ("1.0", None, "2.0", None), True), ("1.2~2.4", ("1.0", None, "2.0", None), None), ("2.1~2.4", ("1.0", None, "2.0", None), False), ("0.5", ("1.0", None, "main", None), False)],
)
def test_in_range(spark, version, bounds, want):
    assert one(spark, versions.in_range(F.lit(version), *[F.lit(b).cast("string") for b in bounds])) == (want,)


def test_tags_and_events(spark):
    tag = lambda t: versions.normal_tag(F.lit(t))
    assert one(spark, *map(tag, ("v1.7.15", "STABLE-2_2_0_RELEASE", "openssl-3.0.1", "OpenSSL_1_1_1w", "V_9_8_P1", "v1.6.0-chrome48", "1.0-rc2", "none", "t-2015-11-19-1"))) == ("1.7.15", "2.2.0", "3.0.1", "1.1.1w", "9.8p1", None, "1.0-rc2", None, None)
    event = F.array(F.struct(F.lit("1.0").alias("introduced"), F.lit("1.2").alias("fixed"), F.lit(None).cast("string").alias("last_affected")))
    assert one(spark, *[versions.in_events(F.lit(v), event) for v in ("1.1", "1.2", "main")]) == (True, False, None)


def test_identity(spark):
    assert one(spark, identity.purl_key(F.lit("pkg:pypi/My_Pkg@1.0?x=1")), identity.cpe_key(F.lit(r"cpe:2.3:a:a\:b:c:1")), identity.repository_purl(F.lit("git@github.com:Own/Repo.git")), identity.repository_purl(F.lit("https://git.kernel.org/pub/scm/x.git/"))) == ("pypi/my-pkg", r"a\:b:c", "pkg:github/own/repo", "pkg:generic/git.kernel.org/pub/scm/x")
    assert one(spark, identity.spliced(F.lit("pkg:a/b@1?q=1"), F.lit("2")), identity.spliced(F.lit("pkg:a/b"), F.lit("1~2"))) == ("pkg:a/b@2?q=1", "pkg:a/b")
    import re

    for glob, yes, no in [("src/*.c", "src/a.c", "src/x/a.c"), ("**/a.c", "x/y/a.c", "x/ba.c"), ("a?.[ch]", "ab.h", "a/.h"), ("lib/**", "lib/x/y", "li/x"), ("[!a]b", "cb", "ab")]:
        assert re.search(identity.glob_regex(glob), yes) and not re.search(identity.glob_regex(glob), no)


def test_licences_and_severity(spark):
    assert one(spark, licences.incompatible(F.lit("Apache-2.0"), F.lit("GPL-2.0-only")), licences.incompatible(F.lit("GPL-3.0-only"), F.lit("GPL-2.0-only")), licences.incompatible(F.lit("Apache-2.0"), F.lit("GPL-3.0-only"))) == (True, True, False)
    assert one(spark, licences.spdx_headers(F.lit("/* SPDX-License-Identifier: MIT OR ISC */\n// SPDX-License-Identifier: 0BSD\n"))) == (["MIT OR ISC", "0BSD"],)
    assert one(spark, licences.text_licence(F.lit("Redistribution and use in source and binary forms\n * neither the name"))) == ("BSD-3-Clause",)
    assert one(spark, severity.method(F.lit("CVSS:4.0/AV:N")), severity.base_score(F.lit("CVSS:3.1/AV:N/AC:L"))) == ("CVSSv4", None)


def test_version_macros(spark):
    text_ = '#define LFS_VERSION "2.4.1"\n#define CJSON_VERSION_STRING 1.7\n#define X 3\n'
    assert one(spark, provenance.version_macros(F.lit(text_))) == (["lfs=2.4.1", "cjson=1.7"],)
