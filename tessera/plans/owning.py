"""Queries over owners of shared code: bundles, their states, and whose a shared value is."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import holders, segments
from tessera.plans.corpus import _shingles_sql
from tessera.plans.registry import register
from tessera.session import spread, table

RULES = segments.Bundling(least=40, of_largest=0.2, of_part=0.03, of_host=0.35, most_owners=16)

_T = f"{_shingles_sql('d', 'documents', 'source, lang')}, t AS (SELECT DISTINCT source AS owner, lang AS release, h FROM d), own AS (SELECT DISTINCT owner, h FROM t)"
_PAIRS = f"""size AS (SELECT owner, count(*) AS n FROM own GROUP BY 1),
held AS (SELECT * FROM own WHERE h IN (SELECT h FROM own GROUP BY 1 HAVING count(*) BETWEEN 2 AND {RULES.most_owners})),
both_ AS (SELECT a.h, a.owner AS host, b.owner AS part FROM held a JOIN held b ON a.h = b.h AND a.owner <> b.owner),
pair AS (SELECT host, part, count(*) AS shared, any_value(n) AS n FROM both_ JOIN size ON owner = host GROUP BY 1, 2),
rel AS (SELECT owner AS part, release, count(*) AS size, max(count(*)) OVER (PARTITION BY owner) AS largest FROM t GROUP BY 1, 2),
ins AS (SELECT host, b.part, release, count(*) AS inside FROM both_ b JOIN t ON t.owner = b.part AND t.h = b.h GROUP BY 1, 2, 3),
found AS (SELECT i.host, i.part, shared, shared::DOUBLE / n AS host_share, release, inside, size FROM ins i JOIN rel USING (part, release) JOIN pair p ON p.host = i.host AND p.part = i.part
  WHERE size >= {RULES.least} AND size >= {RULES.of_largest} * largest AND inside >= {RULES.of_part} * size AND shared >= {RULES.of_part} * {RULES.least}
  QUALIFY row_number() OVER (PARTITION BY i.host, i.part ORDER BY inside::DOUBLE / size DESC, release DESC) = 1)"""


def _sets(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("source", "lang", "text"))
    return holders.holder_sets(docs, "source", "lang", 4)


@register(
    "bundle_states",
    f"""WITH {_T}, {_PAIRS}
SELECT f.host, f.part, f.shared, f.host_share, f.release, f.inside, f.size, CASE WHEN f.host_share <= {RULES.of_host} THEN 'kept' WHEN g.host IS NOT NULL THEN 'lineage' ELSE 'lost' END AS state
FROM found f LEFT JOIN found g ON g.host = f.part AND g.part = f.host""",
)
def bundle_states(spark, sf_dir):
    return segments.holdings(holders.holdings(_sets(spark, sf_dir)), RULES)


@register(
    "segmented_owners",
    f"""WITH {_T}, {_PAIRS},
bundle AS (SELECT host, part FROM found WHERE host_share <= {RULES.of_host}),
part_ AS (SELECT host, part FROM pair p WHERE shared <= {RULES.of_host} * n AND part IN (SELECT part FROM bundle)
  AND NOT EXISTS (SELECT 1 FROM bundle b WHERE (b.host = p.host AND b.part = p.part) OR (b.host = p.part AND b.part = p.host))),
kin AS (SELECT host, part, 1 AS whole FROM bundle UNION ALL SELECT host, part, 0 FROM part_),
deg AS (SELECT h, count(*) AS owners, min(owner) AS sole FROM own GROUP BY 1),
kept AS (SELECT h, min(part) AS keeper FROM (SELECT b.h, b.part FROM both_ b JOIN kin k ON k.host = b.host AND k.part = b.part JOIN deg USING (h) GROUP BY 1, 2, owners HAVING count(*) = owners - 1 AND sum(whole) >= 1) GROUP BY 1)
SELECT owners, coalesce(CASE WHEN owners = 1 THEN sole ELSE keeper END, '') AS owner, count(*) AS hashes, sum(h % 1000)::BIGINT AS checksum FROM deg LEFT JOIN kept USING (h) GROUP BY 1, 2""",
)
def segmented_owners(spark, sf_dir):
    """How many values each owner keeps, by the number of holders; owner "" is nobody."""
    sets = _sets(spark, sf_dir)
    out = segments.segmented(holders.holdings(sets), RULES).join(sets.select(F.col("id").alias("h"), "n", "checksum"), "h")
    return out.groupBy("owners", F.coalesce("owner", F.lit("")).alias("owner")).agg(F.sum("n").alias("hashes"), F.sum("checksum").alias("checksum"))
