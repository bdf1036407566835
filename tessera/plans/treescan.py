"""The scan of a tree of files, from where rules meet it to the component that each directory is."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.hashing import sketch
from tessera.operators import scan
from tessera.operators.graph import settled
from tessera.plans.corpus import K, _SIG, _shingles_sql, _signature
from tessera.plans.registry import register, _SQL
from tessera.session import spread, table

#: Values of a sketch.
SIZE = 64
_LEAF = "coalesce(source, '-') || '/' || coalesce(lang, '-') || '/' || (doc_id {div} 8)"
_NAME = "(doc_id % 8) || '.txt'"
# A rule looks for its version in one file, in two parts: digits before and after a dot.
_PROBES = [(r, f"{r}.txt", part, lead, pattern) for r in range(4) for part, lead, pattern in ((1, "", r"([0-9]+)\.[0-9]"), (2, ".", r"[0-9]\.([0-9]+)"))]
# Rules 0 to 3 know bodies of passages by release, 4 to 6 only a sketch of theirs; labelled documents are anchored files of all.
_RULES = [(r, f"lib{r}", ["en/?", "src*/de/[!0-4]*"] if r % 2 else [f"src{r}*/**"], "fr" if r % 3 == 0 else None, r % 4, 0.95 if r == 5 else 1.0) for r in range(7)]

_RANGE = _SQL["version_range"].split("top AS", 1)[1].rsplit("\nSELECT doc_id, rule_id, best_ix", 1)[0]


@register(
    "scanned_components",
    rf"""WITH f AS (SELECT {_LEAF.format(div='//')} AS leaf, {_NAME} AS name, text, sha256(text) AS sha, 'x' AS x, string_split({_LEAF.format(div='//')}, '/') AS s FROM documents),
g AS (SELECT array_to_string(s[1:k], '/') AS doc_id, array_to_string(s[k + 1:], '/') || CASE WHEN k < len(s) THEN '/' ELSE '' END || name AS rel, name, text, sha FROM (SELECT *, unnest(range(1, len(s) + 1)) AS k FROM f)),
a AS (SELECT DISTINCT (doc_id % 7)::INT AS rule_id, (doc_id % 8)::INT AS place, {_NAME} AS path, (quality + 2 * toxic)::INT AS ix, sha256(text) AS sha FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND toxic IS NOT NULL),
one AS (SELECT doc_id, name, min(sha) AS sha FROM g WHERE len(string_split(rel, '/')) <= 4 GROUP BY 1, 2 HAVING count(*) = 1),
met AS (SELECT doc_id, rule_id, place, ix FROM g JOIN a ON g.rel = a.path AND g.sha = a.sha
  UNION ALL SELECT doc_id, rule_id, place, ix FROM one JOIN a ON one.name = a.path AND one.sha = a.sha WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.doc_id = one.doc_id AND g.rel = a.path)),
hit AS (SELECT doc_id, rule_id, list_sort(list(DISTINCT ix)) AS anchors FROM met JOIN (SELECT doc_id, rule_id, min(place) AS place FROM met GROUP BY 1, 2) USING (doc_id, rule_id, place) GROUP BY 1, 2),
{_shingles_sql('d', 'g', 'doc_id')},
{_SIG.removeprefix(_shingles_sql('d', 'documents', 'doc_id') + ',').lstrip()},
top AS{_RANGE},
fn AS (SELECT doc_id, rule_id, best_ix, min(version_ix) AS low_ix, max(version_ix) AS high_ix FROM near ANTI JOIN against USING (doc_id, rule_id, version_ix) GROUP BY 1, 2, 3),
sz AS (SELECT rule_id, version_ix AS best_ix, count(*) AS size FROM sig GROUP BY 1, 2),
hd AS (SELECT fn.doc_id, fn.rule_id, count(*) AS held FROM fn JOIN sig ON sig.rule_id = fn.rule_id AND sig.version_ix = fn.best_ix JOIN d ON d.doc_id = fn.doc_id AND d.h = sig.h GROUP BY 1, 2),
ru AS (SELECT DISTINCT rule_id, h FROM sig),
al AS (SELECT doc_id, rule_id, count(*) AS held_any FROM d JOIN ru USING (h) GROUP BY 1, 2),
body AS (SELECT doc_id, al.rule_id, low_ix, high_ix, CASE WHEN fn.best_ix IS NULL THEN held_any::DOUBLE / (SELECT count(*) FROM ru WHERE ru.rule_id = al.rule_id) ELSE coalesce(held, 0)::DOUBLE / size END AS exact
  FROM al LEFT JOIN fn USING (doc_id, rule_id) LEFT JOIN sz ON sz.rule_id = al.rule_id AND sz.best_ix = fn.best_ix LEFT JOIN hd USING (doc_id, rule_id)),
tree AS (SELECT doc_id, (list_sort(list(h)))[1:{SIZE}] AS s FROM d GROUP BY 1),
sk AS (SELECT (4 + item_id % 3)::INT AS rule_id, (list_sort(list(DISTINCT h)))[1:{SIZE}] AS r FROM r GROUP BY 1),
pr AS (SELECT doc_id, rule_id FROM hit UNION SELECT doc_id, rule_id FROM body UNION SELECT doc_id, rule_id FROM (SELECT doc_id, unnest(s) AS h FROM tree) JOIN (SELECT rule_id, unnest(r) AS h FROM sk) USING (h)),
m AS (SELECT doc_id, rule_id, s, r, least(len(s), len(r)) AS m, (list_sort(list_distinct(list_concat(s, r))))[1:least(len(s), len(r))] AS u FROM pr JOIN tree USING (doc_id) JOIN sk USING (rule_id)),
sim AS (SELECT doc_id, rule_id, len(list_filter(u, lambda v: list_contains(s, v) AND list_contains(r, v)))::DOUBLE / m AS sketch, 3 AS ref FROM m),
pb AS (SELECT doc_id, v.rule_id, regexp_extract(text, '([0-9]+)\.[0-9]', 1) || '.' || regexp_extract(text, '[0-9]\.([0-9]+)', 1) AS probed FROM g JOIN (VALUES (0), (1), (2), (3)) v(rule_id) ON rel = v.rule_id || '.txt' WHERE regexp_matches(text, '[0-9]\.[0-9]')),
pl AS (SELECT doc_id, rule_id, CASE WHEN rule_id % 2 = 0 AND regexp_matches(doc_id, '(^|/)src' || rule_id || '[^/]*/') OR rule_id % 2 = 1 AND regexp_matches(doc_id, '(^|/)(en/[^/]|src[^/]*/de/[^0-4/][^/]*)$') THEN 2 WHEN rule_id % 3 = 0 AND regexp_matches(doc_id, '(^|/)fr$') THEN 1 ELSE 0 END AS place FROM pr),
kn AS (SELECT DISTINCT item_id % 4 AS rule_id, '1.' || item_id // 4 AS probed FROM benchmark),
mf AS (SELECT leaf AS doc_id, '7.' || length(text) % 10 AS manifest FROM f WHERE name = '2.txt'),
j AS (SELECT pr.doc_id, pr.rule_id, anchors, low_ix, high_ix, exact, sketch, ref, pb.probed, place, manifest, coalesce(len(anchors), 0) AS n, CASE WHEN exact >= 0.8 THEN 0.95 WHEN exact >= 0.5 THEN 0.8 WHEN exact >= 0.2 THEN 0.5 ELSE 0 END::DOUBLE AS bd, kn.probed IS NOT NULL AS known
  FROM pr LEFT JOIN hit USING (doc_id, rule_id) LEFT JOIN body USING (doc_id, rule_id) LEFT JOIN sim USING (doc_id, rule_id) LEFT JOIN pb USING (doc_id, rule_id) LEFT JOIN pl USING (doc_id, rule_id) LEFT JOIN mf USING (doc_id) LEFT JOIN kn ON kn.rule_id = pr.rule_id AND kn.probed = pb.probed),
k1 AS (SELECT *, greatest(CASE WHEN n > 0 THEN 0.98 ELSE 0 END, bd)::DOUBLE AS i1 FROM j),
k2 AS (SELECT *, CASE WHEN exact IS NULL OR i1 = 0 THEN sketch END AS q FROM k1),
k3 AS (SELECT *, CASE WHEN q >= 0.98 THEN 0.95 WHEN q >= 0.85 THEN 0.9 WHEN q >= 0.6 THEN 0.75 WHEN q >= 0.35 THEN 0.5 ELSE 0 END::DOUBLE AS sb, coalesce(n > 0 AND q < 0.6, false) AS low FROM k2 WHERE NOT coalesce(n > 0 AND q < 0.35, false)),
k4 AS (SELECT *, CASE WHEN low THEN least(greatest(i1, sb), 0.5) ELSE greatest(i1, sb) END AS i2,
  CASE WHEN low THEN NULL WHEN n = 1 THEN 'anchor' WHEN bd > 0 AND low_ix IS NOT NULL THEN 'functions' WHEN q >= 0.98 THEN 'signature-reference' END AS s1,
  CASE WHEN low THEN NULL WHEN n = 1 THEN '1.' || anchors[1] WHEN bd > 0 AND low_ix IS NOT NULL THEN '1.' || low_ix || CASE WHEN high_ix > low_ix THEN '~1.' || high_ix ELSE '' END WHEN q >= 0.98 THEN '1.' || ref END AS v1 FROM k3),
k5 AS (SELECT *, list_filter(range(low_ix, high_ix + 1), lambda x: '1.' || x = probed OR starts_with('1.' || x, probed || '.')) AS kept FROM k4 WHERE i2 > 0),
k6 AS (SELECT *, s1 = 'functions' AND low_ix < high_ix AND len(kept) > 0 AND len(kept) < high_ix - low_ix + 1 AS cut, coalesce(len(list_filter(string_split(v1, '~'), lambda x: NOT starts_with(x, probed || '.'))) = 0, false) AS fine FROM k5),
k7 AS (SELECT *, CASE WHEN coalesce(cut, false) THEN 'functions' WHEN probed IS NULL THEN s1 WHEN v1 IS NULL THEN 'probe' WHEN s1 = 'functions' AND fine THEN s1 WHEN s1 = 'anchor' AND (probed = v1 OR fine OR known) THEN s1 ELSE 'probe' END AS s2 FROM k6),
k8 AS (SELECT *, CASE WHEN coalesce(cut, false) THEN '1.' || kept[1] || CASE WHEN len(kept) > 1 THEN '~1.' || kept[-1] ELSE '' END WHEN s2 = 'probe' THEN probed ELSE v1 END AS v2, CASE WHEN probed IS NOT NULL AND NOT low AND i2 < 0.75 THEN 0.75 ELSE i2 END AS i3 FROM k7),
k9 AS (SELECT *, n > 1 AND (v2 IS NULL OR NOT list_contains(list_transform(anchors, lambda x: '1.' || x), v2)) AS sh FROM k8),
k10 AS (SELECT *, CASE WHEN sh THEN '1.' || anchors[1] || '~1.' || anchors[-1] ELSE v2 END AS v3, CASE WHEN sh THEN 'anchor-shared' ELSE s2 END AS s3 FROM k9),
k11 AS (SELECT *, CASE WHEN manifest IS NOT NULL AND (s3 IS NULL OR s3 = 'signature-reference') THEN 'manifest' ELSE s3 END AS source, CASE WHEN manifest IS NOT NULL AND (s3 IS NULL OR s3 = 'signature-reference') THEN manifest ELSE v3 END AS version,
  round(least(CASE WHEN place > 0 THEN least(i3 + 0.02, 1.0) ELSE i3 END, CASE WHEN rule_id = 5 THEN 0.95 ELSE 1.0 END), 3)::DOUBLE AS identity,
  (n > 0)::INT + (bd > 0 OR sb > 0)::INT + low::INT + (probed IS NOT NULL)::INT + (manifest IS NOT NULL)::INT AS witnesses FROM k10),
k12 AS (SELECT *, round(least(CASE source WHEN 'anchor' THEN 0.98 WHEN 'manifest' THEN 0.9 WHEN 'probe' THEN 0.85 WHEN 'functions' THEN 0.88 WHEN 'signature-reference' THEN 0.7 WHEN 'anchor-shared' THEN 0.88 ELSE 0 END, identity), 3)::DOUBLE AS version_confidence FROM k11),
rk AS (SELECT *, row_number() OVER w AS nth, first(identity) OVER w AS best FROM k12
  WINDOW w AS (PARTITION BY doc_id ORDER BY identity DESC, place DESC, witnesses DESC, version IS NOT NULL DESC, version IS NOT NULL DESC, version_confidence DESC, CASE WHEN place > 0 THEN rule_id % 4 ELSE -(rule_id % 4) END DESC, rule_id DESC)),
alt AS (SELECT doc_id, array_to_string((list('lib' || rule_id ORDER BY nth))[1:3], ',') AS alternatives FROM rk WHERE nth > 1 AND identity >= 0.6 * best GROUP BY 1)
SELECT doc_id AS directory, rule_id, 'lib' || rule_id AS name, identity, version, source, version_confidence, witnesses::INT AS witnesses, place::INT AS place, coalesce(alternatives, '') AS alternatives FROM rk LEFT JOIN alt USING (doc_id) WHERE nth = 1""",
)
def scanned_components(spark, sf_dir):
    """Documents are files, eight to a folder below their source and language; passages of the benchmark are the bodies of rules' releases."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"))
    leaf, name = F.expr(_LEAF.format(div="div")), F.expr(_NAME)
    files = docs.select(F.concat(leaf, F.lit("/"), name).alias("path"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"), "text")
    labels = table(spark, sf_dir, "labels").filter("quality is not null and toxic is not null").select("doc_id", F.expr("cast(quality + 2 * toxic as int)").alias("version_ix"))
    # what else is asked of a text is read once; joins would carry the texts
    facts = settled(docs.select("doc_id", leaf.alias("directory"), name.alias("path"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"), F.length("text").alias("n")))
    anchors = facts.join(labels, "doc_id").select(F.expr("cast(doc_id % 7 as int)").alias("rule_id"), F.expr("cast(doc_id % 8 as int)").alias("at"), "path", "version_ix", "sha")
    items = table(spark, sf_dir, "benchmark").select(F.expr("cast(4 + item_id % 3 as int)").alias("rule_id"), F.lit(3).alias("reference_ix"), F.explode(sketch(F.col("text"), K, SIZE)).alias("h")).distinct()
    sketches = items.groupBy("rule_id", "reference_ix").agg(F.slice(F.array_sort(F.collect_list("h")), 1, SIZE).alias("s"))
    known = table(spark, sf_dir, "benchmark").select(F.expr("cast(item_id % 4 as int)").alias("rule_id"), F.expr("cast(item_id div 4 as int)").alias("version_ix"))
    sketched = spark.range(4, 7).select(F.col("id").cast("int").alias("rule_id"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("version_ix"))
    releases = known.unionByName(sketched).withColumn("version", F.concat(F.lit("1."), F.col("version_ix")))
    rules = spark.createDataFrame(_RULES, "rule_id int, name string, globs array<string>, ships_as string, specificity int, ceiling double")
    probes = spark.createDataFrame(_PROBES, "rule_id int, file string, part int, lead string, pattern string")
    declared = facts.filter("path = '2.txt'").select("directory", F.concat(F.lit("7."), F.col("n") % 10).alias("manifest"))
    out = scan.scan(files, rules, releases, anchors, _signature(spark, sf_dir), sketches, probes, declared, K, SIZE)
    return out.select("directory", "rule_id", "name", "identity", "version", "source", "version_confidence", "witnesses", "place", "alternatives")
