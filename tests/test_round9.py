"""Findings of round 5: places of nulls among tied claims, names that are met once."""

import duckdb
from pyspark.sql import functions as F

from tessera.functions import versions
from tessera.operators import aliases
from tessera.plans import registry
from tests.test_round5 import most_joined

_SCHEMA = "range_id int, vuln_key string, purl string, cpe string, introduced string, start_excluding string, fixed string, last_affected string"


def test_claims_without_a_line_come_last_as_in_the_sql(spark, tmp_path):
    rows = [(g, n, line, price) for g, lines in enumerate([(None, 1), (2, None, 1), (None, 4, 3)]) for n, (line, price) in enumerate(zip(lines, (10.0, 10.0, 9.0)), 5 * g)]
    rows += [(7, 1, 1, None), (7, 2, 2, 5.0), (8, None, 1, 9.0), (8, 4, 2, 8.0)]
    t = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_linenumber int, l_extendedprice double")
    t.write.parquet(f"{tmp_path}/lineitem.parquet")
    got = registry.queries()["alternatives_top3"](spark, str(tmp_path))
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    rel = duck.sql(registry.oracle_sql()["alternatives_top3"])
    assert sorted(map(tuple, got.select(*rel.columns).collect()), key=str) == sorted(rel.fetchall(), key=str)


def test_a_range_is_met_once_whatever_keys_its_name_has(spark):
    components = spark.createDataFrame([(k, "pkg:deb/debian/u@1", None, f"{k}.0") for k in range(20)], "component int, purl string, cpe string, version string")
    rules = spark.createDataFrame([], "rule string, purls array<string>, cpe string")
    ranges = spark.createDataFrame([(k, f"CVE-{k}", "pkg:deb/debian/u", None, None, None, f"{k % 5}.0", None) for k in range(30)], _SCHEMA)
    got = aliases.aliased_matches(components, rules, ranges)
    assert most_joined(got) <= 600 == got.count() and got.filter("verdict").count() == 6 * (0 + 1 + 2 + 3 + 4)


def test_matches_under_aliases_are_those_of_each_key(spark):
    purls = ["pkg:github/own/u", "pkg:github/Own/U@2", "pkg:deb/debian/u", "pkg:deb/echo/u-1.2?arch=x", "pkg:npm/u", "pkg:npm/other", "no purl", None]
    cpes = [None, None, "cpe:2.3:a:own:u:*", "cpe:2.3:a:b", "cpe:2.3:a:own:x:1"]
    components = spark.createDataFrame([(k, purls[k % 8], cpes[k % 5], [None, "1.0", "2.0", "git-1", "1.0~3.0"][k // 8 % 5]) for k in range(80)], "component int, purl string, cpe string, version string")
    rules = spark.createDataFrame([("a", ["pkg:github/own/u", "pkg:deb/debian/u"], "cpe:2.3:a:own:u:*"), ("b", ["pkg:npm/u", "pkg:deb/debian/u", "pkg:x"], None)], "rule string, purls array<string>, cpe string")
    bounds = [(None, None, "2.0", None), ("1.0", None, None, None), (None, None, None, None), ("0", "1.0", None, "2.0"), (None, None, "git-2", None)]
    # range 3 has two rows, range 5 a purl and a CPE
    rows = [(k, f"CVE-{k % 7}", purls[k % 8], cpes[k // 2 % 5], *bounds[k % 5]) for k in range(40)] + [(3, "CVE-3", "pkg:npm/u", None, *bounds[3]), (None, None, "pkg:npm/u", None, *bounds[0])]
    ranges = spark.createDataFrame(rows, _SCHEMA)
    got = aliases.aliased_matches(components, rules, ranges)

    own = components.select("component", F.lit("cpe").alias("channel"), aliases.cpe_key(F.col("cpe")).alias("key"), F.lit(False).alias("alias"))
    found = aliases.alias_cpes(components.filter("cpe is null"), rules).select("component", F.lit("cpe").alias("channel"), aliases.cpe_key(F.col("cpe")).alias("key"), F.lit(True).alias("alias"))
    every = aliases.alias_keys(components, rules).select("component", F.lit("purl").alias("channel"), "key", "alias").union(own).union(found)
    filed = ranges.select("*", F.lit("purl").alias("channel"), F.explode(aliases.purl_keys(F.col("purl"))).alias("key")).union(ranges.select("*", F.lit("cpe").alias("channel"), aliases.cpe_key(F.col("cpe")).alias("key"))).drop("purl", "cpe")
    met = components.select("component", "version").join(every, "component").join(filed, ["channel", "key"])
    met = met.withColumn("verdict", versions.in_range(F.col("version"), *[F.col(b) for b in ("introduced", "start_excluding", "fixed", "last_affected")]))
    want = met.groupBy("component", "channel", "range_id", "vuln_key").agg(F.bool_and("alias").alias("alias"), F.first("verdict").alias("verdict")).drop("range_id")
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert {r.verdict for r in got.collect()} == {True, False, None} and {(r.channel, r.alias) for r in got.collect()} == {(c, a) for c in ("purl", "cpe") for a in (True, False)}
