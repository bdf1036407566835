"""Queries of evidence: advisories by two channels, anchored files, macros, records of patches. Inputs are made of parts and suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import advisories, evidence, resolve
from tessera.plans.components import cases
from tessera.plans.registry import register
from tessera.session import table

# Twenty parts for a supplier, as in the tables, so each range meets twenty components by each channel at every size.
_COMPONENT = {
    "component": "p_partkey",
    "version": "CASE WHEN p_partkey % 11 <> 0 THEN (p_size % 10) || '.' || (p_partkey % 20) END",
    "distro": "p_partkey % 13 = 0",
    "fork": "p_size = 50",
    "cpe": "'c' || CAST(floor(p_partkey / 20) AS BIGINT)",
    "purl": "'p' || CAST(floor((p_partkey + 10) / 20) AS BIGINT)",
}
_RANGE = {
    "advisory_id": "'CVE-2024-' || CAST(1000 + floor(s_suppkey / 2) AS BIGINT)",
    "channel": cases("s_suppkey", "'cpe'", "'purl'", "'purl'"),
    "key": cases("s_suppkey", "'c' || s_suppkey", "'p' || s_suppkey", "'p' || (s_suppkey - 1)"),
    "introduced": cases("s_suppkey", "(s_suppkey % 7) || '.3'", "NULL", "(s_suppkey % 7) || '.0'", "NULL", "NULL"),
    "start_excluding": cases("s_suppkey", "NULL", "NULL", "NULL", "NULL", "(s_suppkey % 7) || '.5'"),
    "fixed": cases("s_suppkey", "(s_suppkey % 7 + 2) || '.1'", "(s_suppkey % 9) || '.9'", "NULL", "NULL", "NULL"),
    "last_affected": cases("s_suppkey", "NULL", "NULL", "NULL", "(s_suppkey % 8) || '.10'", "(s_suppkey % 7 + 3) || '.0'"),
}


def _columns(of: dict[str, str]) -> str:
    return ", ".join(f"{x} AS {n}" for n, x in of.items())


def _number(version: str) -> str:
    return f"(CAST(split_part({version}, '.', 1) AS INTEGER) * 1000 + CAST(split_part({version}, '.', 2) AS INTEGER))"


_MATCHED = f"""WITH p AS (SELECT {_columns(_COMPONENT)} FROM part), r AS (SELECT {_columns(_RANGE)} FROM supplier),
j AS (SELECT component, distro, fork, advisory_id, channel, {_number("version")} AS v, {_number("introduced")} AS i, {_number("start_excluding")} AS s, {_number("fixed")} AS f, {_number("last_affected")} AS l
  FROM p JOIN r ON key = CASE channel WHEN 'cpe' THEN cpe ELSE purl END),
d AS (SELECT *, CASE WHEN v IS NOT NULL THEN coalesce(v >= i, true) AND coalesce(v > s, true) AND coalesce(v < f, true) AND coalesce(v <= l, true) END AS verdict FROM j),
m AS (SELECT advisory_id AS vuln_key, component, channel, verdict IS NULL AS unplaced, CASE WHEN NOT verdict THEN 2 WHEN verdict IS NULL OR distro OR fork THEN 1 ELSE 0 END AS rank FROM d)"""


def _matched(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(*[F.expr(x).alias(n) for n, x in _COMPONENT.items()])
    ranges = table(spark, sf_dir, "supplier").select(*[F.expr(x).cast("string").alias(n) for n, x in _RANGE.items()])
    channels = F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).alias("key")) for c in ("cpe", "purl")]))
    keyed = parts.select("component", "version", "distro", "fork", channels.alias("x")).select("component", "version", "distro", "fork", "x.*")
    return advisories.matched(keyed, ranges.withColumnRenamed("advisory_id", "vuln_key"))


@register(
    "advisory_states",
    _MATCHED
    + """, g AS (SELECT vuln_key, component, min(rank) FILTER (WHERE NOT unplaced) AS placed, min(rank) AS worst,
  count(DISTINCT channel) FILTER (WHERE NOT unplaced AND rank IN (0, 2)) > 1 AND bool_or(NOT unplaced AND rank = 0) AND bool_or(NOT unplaced AND rank = 2) AS disputed FROM m GROUP BY 1, 2)
SELECT vuln_key, component, ['exploitable', 'in_triage', 'not_affected'][1 + CASE WHEN disputed THEN 1 ELSE coalesce(placed, worst) END] AS state FROM g""",
)
def advisory_states(spark, sf_dir):
    return resolve.merged_states(_matched(spark, sf_dir), ["vuln_key", "component"])


@register(
    "advisory_coverage",
    _MATCHED
    + """, v AS (SELECT component, vuln_key, bool_or(channel = 'cpe') AS c, bool_or(channel = 'purl') AS p FROM m GROUP BY 1, 2)
SELECT component, count(*) AS n, count(*) FILTER (WHERE c) AS by_cpe, count(*) FILTER (WHERE p) AS by_purl, count(*) FILTER (WHERE c AND p) AS by_both, count(*) FILTER (WHERE NOT c AND p) AS only_purl FROM v GROUP BY 1""",
)
def advisory_coverage(spark, sf_dir):
    return advisories.coverage(_matched(spark, sf_dir), ["component"])


_FILE = {"root": "CAST(floor(p_partkey / 10) AS BIGINT)", "path": "'src/f' || (p_partkey % 10) || '.c'", "said": "CAST(p_size % 50 AS STRING)"}
_ANCHOR = {"rule": "'u' || (s_suppkey % 3)", "path": "'src/f' || (s_suppkey % 10) || '.c'", "release": "'1.' || (s_suppkey % 400)", "said": "CAST(s_suppkey % 50 AS STRING)"}


@register(
    "anchored_releases",
    f"""WITH f AS (SELECT DISTINCT {_columns(_FILE)} FROM part), a AS (SELECT DISTINCT {_columns(_ANCHOR)} FROM supplier)
SELECT root, rule, path, array_to_string(list_sort(list(DISTINCT release)), ' ') AS releases, CASE WHEN count(DISTINCT release) = 1 THEN min(release) END AS version FROM f JOIN a USING (path, said) GROUP BY 1, 2, 3""",
)
def anchored_releases(spark, sf_dir):
    made = lambda name, of: table(spark, sf_dir, name).select(*[F.expr(x).alias(n) for n, x in of.items()]).withColumn("sha", F.sha2("said", 256)).drop("said")
    found = evidence.anchored_releases(made("part", _FILE), made("supplier", _ANCHOR).distinct())
    return found.withColumn("releases", F.array_join("releases", " "))


_MACRO, _GONE = "'M_' || CAST(floor(p_partkey / 4) AS BIGINT)", "p_partkey % 17 = 0"


@register(
    "harvested_macros",
    f"""WITH d AS (SELECT {_MACRO} AS name, {_GONE} AS gone, CASE WHEN NOT ({_GONE}) THEN CASE p_size % 3 WHEN 0 THEN '1' ELSE '(1 << 2)' END END AS value FROM part),
g AS (SELECT name, count(DISTINCT value) = 1 AND NOT bool_or(gone) AS certain, min(value) AS value FROM d GROUP BY 1) SELECT name, CASE WHEN certain THEN value END AS value, certain FROM g""",
)
def harvested_macros(spark, sf_dir):
    line = F.when(F.expr(_GONE), F.concat(F.lit("#undef "), F.expr(_MACRO))).otherwise(F.concat(F.lit("# define "), F.expr(_MACRO), F.when(F.col("p_size") % 3 == 0, " // on").otherwise(" (1 \\\n <<  2) /* two */")))
    text = F.concat(F.lit("int x; /* a\n#define COMMENTED 1\n*/\n#define CALL(x) x\n"), line, F.lit("\n"))
    return evidence.harvested_macros(table(spark, sf_dir, "part").select(F.col("p_name").alias("path"), text.alias("text")))


_BODY = {"patch": "CAST(floor(p_partkey / 8) AS BIGINT)", "path": "'a.c'", "name": "'f' || (p_partkey % 8)"}
_FIXED = cases("p_size", "p_brand", "p_brand || 'x'", "p_brand", "NULL")


@register(
    "patch_records",
    f"""WITH c AS (SELECT {_columns(_BODY)}, p_brand AS hole, {_FIXED} AS fixed FROM part WHERE p_brand IS DISTINCT FROM {_FIXED})
SELECT patch, path, name, hole, coalesce(fixed, '') AS fixed FROM c QUALIFY count(*) OVER (PARTITION BY patch) <= 3""",
)
def patch_records(spark, sf_dir):
    side = lambda exact: table(spark, sf_dir, "part").select(*[F.expr(x).alias(n) for n, x in _BODY.items()], F.expr(exact).alias("exact"), F.lit(None).cast("string").alias("abstract")).filter("exact is not null")
    found = evidence.patch_records(side("p_brand"), side(_FIXED), ["patch"], most=3)
    return found.select("patch", "path", "name", F.array_join("hole", " ").alias("hole"), F.coalesce(F.array_join("fixed", " "), F.lit("")).alias("fixed"))
