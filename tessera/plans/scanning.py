"""Queries of the scan: candidate directories, tiers of evidence, licences of headers, linkage and blind spots."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import discover
from tessera.plans.components import cases
from tessera.plans.registry import register
from tessera.session import table

# Each page's path is a file; the last letter of its folder makes it a manifest, a licence or a source.
_FILE = "regexp_replace(regexp_extract(url, '^[a-z]+://([^?#]+)', 1), '/+$', '') || " + cases("page_id", "'/package.json'", "'/LICENSE.txt'", "'/a.c'", "'/src/lib.h'", "'/src/lib.c'", "'/readme.md'")
_MARKERS = [("one", "src/lib.h"), ("one", "src/lib.c"), ("two", "LICENSE.txt"), ("two", "package.json")]


@register(
    "candidate_directories",
    f"""WITH f AS (SELECT DISTINCT list_filter(string_split({_FILE}, '/'), lambda x: x <> '') AS p FROM pages),
d AS (SELECT array_to_string(p, '/') AS path, array_to_string(p[1:len(p) - 1], '/') AS directory, p[len(p)] AS name, len(p) - 1 AS depth FROM f),
t AS (SELECT * FROM d WHERE depth < 10),
g AS (SELECT DISTINCT directory FROM t WHERE directory <> ''),
m AS (SELECT rule_id, rtrim(path[1:length(path) - length(marker)], '/') AS directory, count(DISTINCT marker) AS held FROM t JOIN (VALUES ('one', 'src/lib.h'), ('one', 'src/lib.c'), ('two', 'LICENSE.txt'), ('two', 'package.json')) v(rule_id, marker) ON path = marker OR ends_with(path, '/' || marker) GROUP BY 1, 2),
s AS (SELECT directory, 0 AS r FROM m WHERE held = 2 UNION ALL SELECT directory, 1 FROM g WHERE ends_with(directory, '/en/src') UNION ALL SELECT directory, 2 FROM g WHERE regexp_matches(directory, '(^|/)(de|fr)$')
  UNION ALL SELECT directory, 3 FROM t WHERE name = 'package.json' UNION ALL SELECT directory, 4 FROM t WHERE name = 'LICENSE.txt' UNION ALL SELECT directory, 6 FROM t WHERE regexp_matches(name, '[.](c|h)$') GROUP BY directory HAVING count(*) >= 2)
SELECT directory, (['markers', 'rule-path', 'rule-name', 'manifest', 'license-file', 'submodule', 'deep'])[min(r) + 1] AS reason FROM s GROUP BY 1""",
)
def candidate_directories(spark, sf_dir):
    files = table(spark, sf_dir, "pages").select(F.expr(_FILE).alias("path")).distinct()
    one = lambda rows, name: spark.createDataFrame([(x,) for x in rows], f"{name} string")
    markers = spark.createDataFrame(_MARKERS, "rule_id string, marker string")
    return discover.candidate_directories(files, one(["en/src"], "suffix"), one(["de", "fr"], "name"), markers, one([], "directory"), deep=True, least_sources=2)


_TIERS = {
    "anchor": "CASE WHEN p_partkey % 7 = 0 THEN '2.' || p_size % 5 || '.1' END",
    "exact": "CASE WHEN p_partkey % 3 <> 0 THEN p_partkey % 101 / 100.0 END",
    "abstract": "CASE WHEN p_partkey % 4 <> 0 THEN p_size * 7 % 101 / 100.0 END",
    "functions": "CASE WHEN p_size % 3 = 0 THEN '1.0' || '~1.' || p_size ELSE '1.' || p_size END",
    "matched": "p_partkey % 700",
    "present": "p_partkey % 700 + p_size * 40",
    "sketch": "CASE WHEN p_partkey % 5 <> 0 THEN p_partkey % 97 / 96.0 END",
    "probed": "CASE WHEN p_partkey % 6 = 0 THEN '2.' || p_size % 5 WHEN p_partkey % 6 = 1 THEN '9.' || p_size % 2 END",
    "manifest": "CASE WHEN p_partkey % 8 = 0 THEN '4.' || p_size END",
    "at_path": "p_partkey % 10 = 0",
}
_BAND = "CASE WHEN {0} >= 0.98 THEN 0.95 WHEN {0} >= 0.85 THEN 0.9 WHEN {0} >= 0.6 THEN 0.75 WHEN {0} >= 0.35 THEN 0.5 ELSE 0 END"


@register(
    "tiered_identity",
    f"""WITH r AS (SELECT p_partkey, {", ".join(f"{x} AS {n}" for n, x in _TIERS.items())} FROM part),
a AS (SELECT *, CASE WHEN anchor IS NOT NULL THEN CASE WHEN sketch IS NULL OR sketch >= 0.6 THEN 'held' WHEN sketch >= 0.35 THEN 'demoted' ELSE 'rejected' END END AS how,
  CASE WHEN exact < 0.85 AND abstract >= exact + 0.05 THEN abstract ELSE exact END AS share FROM r),
b AS (SELECT *, {_BAND.format('share')}::DOUBLE AS fc, {_BAND.format('sketch')}::DOUBLE AS sc FROM a),
t AS (SELECT *, CASE WHEN how = 'held' THEN 'anchor' WHEN fc > 0 THEN 'functions' WHEN matched >= 300 AND matched >= 0.3 * present THEN 'derivative' WHEN sc > 0 THEN 'sketch' WHEN manifest IS NOT NULL THEN 'manifest' ELSE 'none' END AS tier FROM b),
u AS (SELECT *, CASE tier WHEN 'anchor' THEN 0.98 WHEN 'functions' THEN fc WHEN 'derivative' THEN 0.5 WHEN 'sketch' THEN sc WHEN 'manifest' THEN 0.75 ELSE 0 END::DOUBLE AS i,
  CASE tier WHEN 'anchor' THEN anchor WHEN 'functions' THEN functions WHEN 'sketch' THEN CASE WHEN how = 'demoted' THEN anchor END WHEN 'manifest' THEN manifest END AS v FROM t),
p AS (SELECT *, CASE WHEN v IS NULL THEN false ELSE len(list_filter(string_split(v, '~'), lambda x: NOT starts_with(x, probed || '.'))) = 0 END AS shorter FROM u),
q AS (SELECT *, i > 0 AND probed IS NOT NULL AND CASE WHEN v IS NULL THEN true WHEN tier = 'functions' THEN NOT coalesce(shorter, false) WHEN tier = 'anchor' THEN probed <> v AND NOT shorter AND probed NOT IN ('9.1') ELSE true END AS taken FROM p),
w AS (SELECT *, CASE WHEN i > 0 AND i < 0.75 AND probed IS NOT NULL AND coalesce(how, '') <> 'demoted' THEN 0.75 ELSE i END AS j FROM q)
SELECT p_partkey, round(CASE WHEN at_path AND j > 0 AND j < 0.95 THEN least(j + 0.02, 0.95) ELSE j END, 4)::DOUBLE AS identity, CASE WHEN taken THEN probed ELSE v END AS version, CASE WHEN taken THEN 'probe' ELSE tier END AS source FROM w""",
)
def tiered_identity(spark, sf_dir):
    double = ("exact", "abstract", "sketch")
    rows = table(spark, sf_dir, "part").select("p_partkey", *[F.expr(x).cast("double").alias(n) if n in double else F.expr(x).alias(n) for n, x in _TIERS.items()], F.array(F.lit("9.1")).alias("recorded"))
    return discover.identified(rows).select("p_partkey", "identity", "version", "source")


@register(
    "licence_header_counts",
    r"""WITH h AS (SELECT DISTINCT source, doc_id, unnest(regexp_extract_all(text, 'Licensed under ([^\n]*)', 1)) AS expression FROM documents),
c AS (SELECT source, expression, count(DISTINCT doc_id) AS files FROM h GROUP BY 1, 2)
SELECT source, expression, files, (row_number() OVER (PARTITION BY source ORDER BY files DESC, expression))::INT AS rank FROM c QUALIFY rank <= 8""",
)
def licence_header_counts(spark, sf_dir):
    headers = table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("file"), F.explode(F.regexp_extract_all("text", F.lit(r"Licensed under ([^\n]*)"), F.lit(1))).alias("expression"))
    return discover.header_counts(headers, "source")


_STATE_OF = cases("l_partkey", "'exploitable'", "'in_triage'", "'not_affected'", "'exploitable'", "'resolved'")


@register(
    "linkage_demotion",
    f"""WITH m AS (SELECT {_STATE_OF} AS state, CASE WHEN l_suppkey % 4 <> 0 THEN l_returnflag <> 'R' END AS linked, l_linestatus = 'O' AS subsystem FROM lineitem)
SELECT state, CASE WHEN state IN ('exploitable', 'in_triage') AND linked = false THEN 'in_triage' WHEN state = 'exploitable' AND subsystem THEN 'in_triage' ELSE state END AS after, count(*) AS n FROM m GROUP BY 1, 2""",
)
def linkage_demotion(spark, sf_dir):
    state, linked = F.expr(_STATE_OF), F.when(F.col("l_suppkey") % 4 != 0, F.col("l_returnflag") != "R")
    after = discover.demoted(state, linked, F.col("l_linestatus") == "O")
    return table(spark, sf_dir, "lineitem").groupBy(state.alias("state"), after.alias("after")).agg(F.count("*").alias("n"))


_PURL = cases("p_partkey", "'pkg:generic/' || p_partkey", "'pkg:generic/' || p_size || '/x@1'", "'pkg:github/a/b'", "'pkg:npm/'", "'pkg:generic/a@1/2'")


@register(
    "blind_spots",
    f"""WITH c AS (SELECT p_partkey, p_size % 3 = 0 AS cpe, p_size % 5 <> 0 AS known, {_PURL} AS purl FROM part),
k AS (SELECT *, regexp_replace(regexp_replace(purl, '^pkg:/*', ''), '[@?#].*$', '') AS body FROM c)
SELECT NOT cpe AND NOT known AS blind, NOT cpe AND known AND NOT (regexp_matches(body, '^[^/]+/.') AND (body NOT LIKE 'generic/%' OR regexp_matches(body, '^generic/.*/'))) AS name_only, NOT cpe AS without_cpe, count(*) AS n FROM k GROUP BY 1, 2, 3""",
)
def blind_spots(spark, sf_dir):
    none = F.array().cast("array<string>")
    parts = table(spark, sf_dir, "part").select(F.when(F.col("p_size") % 3 == 0, F.array(F.lit("cpe:2.3:a:v:p"))).otherwise(none).alias("cpes"), F.when(F.col("p_size") % 5 != 0, F.array(F.expr(_PURL))).alias("purls"))
    return discover.blind_spots(parts).groupBy("blind", "name_only", "without_cpe").agg(F.count("*").alias("n"))
