"""Queries of the report: support of findings, gaps, order, licences seen against declared. Parts are findings, suppliers overrides."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import findings
from tessera.plans.components import cases
from tessera.plans.registry import register
from tessera.session import table

_FINDING = {
    "id": "p_partkey",
    "rule": "p_brand",
    "name": "p_type",
    "directory": "'lib/' || p_name || '/' || p_size",
    "version": "CASE WHEN p_size % 3 <> 0 THEN '1.' || (p_size % 5) END",
    "identity": "(p_size % 20) / 20.0",
}
_OVERRIDE = {
    "position": "s_suppkey",
    "rule": cases("s_suppkey", "'Brand#' || (s_suppkey % 25)", "NULL", "'Brand#' || (s_suppkey % 20)", "NULL", "NULL"),
    "name": cases("s_suppkey", "NULL", "'economy'", "'Small'", "NULL", "'LARGE'"),
    "directory": cases("s_suppkey", "'lib/*/2*'", "'*/' || (s_suppkey % 50)", "NULL", "'lib/red*/4?'", "'lib/[!b]*/1?'"),
    "version": cases("s_suppkey", "NULL", "NULL", "'1.' || (s_suppkey % 5)", "'1.3'", "NULL"),
    "status": cases("s_suppkey", "'supported'", "'ended'", "'unknown'"),
    "ends": cases("s_suppkey", "'2031-01-01'", "NULL"),
}
_RULE_STATUS = "CASE WHEN p_brand LIKE '%1' THEN 'supported' WHEN p_brand LIKE '%2' THEN 'ended' END"
_BELOW = 0.5


def _columns(of: dict[str, str]) -> str:
    return ", ".join(f"{x} AS {n}" for n, x in of.items())


_STAMPED = f"""WITH f AS (SELECT {_columns(_FINDING)}, {_RULE_STATUS} AS own FROM part),
o AS (SELECT {_columns(_OVERRIDE)} FROM supplier),
h AS (SELECT f.id, o.status, o.ends FROM f JOIN o ON (o.rule IS NULL OR o.rule = f.rule) AND (o.name IS NULL OR lower(o.name) = lower(f.name)) AND (o.directory IS NULL OR f.directory GLOB o.directory) AND (o.version IS NULL OR o.version = coalesce(f.version, ''))
  QUALIFY row_number() OVER (PARTITION BY f.id ORDER BY o.position) = 1),
s AS (SELECT f.id, f.rule, f.identity, coalesce(h.status, own, 'unknown') AS status, CASE WHEN h.id IS NOT NULL THEN h.ends WHEN own IS NOT NULL THEN '2030-06-30' END AS ends, CASE WHEN h.id IS NOT NULL THEN 'file' WHEN own IS NOT NULL THEN 'rule' ELSE 'none' END AS origin FROM f LEFT JOIN h USING (id))"""


def _findings(spark, sf_dir):
    return table(spark, sf_dir, "part").select(*[F.expr(x).alias(n) for n, x in _FINDING.items()])


def _stamped(spark, sf_dir):
    overrides = table(spark, sf_dir, "supplier").select(*[F.expr(x).alias(n) for n, x in _OVERRIDE.items()])
    rules = table(spark, sf_dir, "part").select(F.col("p_brand").alias("rule"), F.expr(_RULE_STATUS).alias("status"), F.lit("2030-06-30").alias("ends")).distinct()
    return findings.stamped(_findings(spark, sf_dir), overrides, rules)


@register("support_stamping", f"{_STAMPED} SELECT id, status, ends, origin FROM s")
def support_stamping(spark, sf_dir):
    return _stamped(spark, sf_dir)


@register("support_gaps", f"{_STAMPED} SELECT rule, count(*) FILTER (identity >= {_BELOW}) AS asserted, count(*) FILTER (identity < {_BELOW}) AS possible, count(*) FILTER (identity >= {_BELOW} AND status = 'unknown') AS gaps FROM s GROUP BY 1")
def support_gaps(spark, sf_dir):
    rows = _findings(spark, sf_dir).select("id", "rule", "identity").join(_stamped(spark, sf_dir).select("id", "status"), "id")
    return findings.report_counts(rows, "rule", _BELOW)


@register("findings_order", f"SELECT p_partkey AS id, {_FINDING['directory']} AS directory, ({_FINDING['identity']})::DOUBLE AS confidence FROM part ORDER BY confidence DESC, directory")
def findings_order(spark, sf_dir):
    return findings.ordered(_findings(spark, sf_dir).select("id", "directory", F.col("identity").cast("double").alias("confidence")))


_DECLARED = cases("p_partkey", "'MIT OR Apache-2.0'", "'mit'", "NULL", "''", "'(GPL-2.0-only AND MIT) OR zlib'")
_OBSERVED = cases("p_size", "'MIT'", "'mit,Zlib'", "''", "'GPL-2.0-only'")


@register(
    "licence_observed",
    f"""WITH l AS (SELECT p_partkey, {_DECLARED} AS declared, list_filter(string_split({_OBSERVED}, ','), lambda x: x <> '') AS observed FROM part),
k AS (SELECT *, list_filter(regexp_extract_all(lower(coalesce(declared, '')), '[a-z0-9.+-]+'), lambda x: x NOT IN ('and', 'or')) AS known FROM l)
SELECT p_partkey, len(known) > 0 AND len(list_filter(observed, lambda x: NOT list_contains(known, lower(x)))) > 0 AS differs FROM k""",
)
def licence_observed(spark, sf_dir):
    seen = F.filter(F.split(F.expr(_OBSERVED), ","), lambda x: x != "")
    return table(spark, sf_dir, "part").select("p_partkey", findings.licence_differs(F.expr(_DECLARED), seen).alias("differs"))
