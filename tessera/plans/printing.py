"""Queries of function prints: a document is a function, its language the library, its source the release and the image."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.hashing import winnowed
from tessera.operators import prints
from tessera.operators.graph import settled
from tessera.plans.corpus import _HASH, _TOKENS
from tessera.plans.registry import register
from tessera.session import spread, table

K, WINDOW = 4, 8
R = prints.Prints()

_FEATURES = f"""h AS (SELECT doc_id, lang, source, CASE WHEN len(t) >= {K} THEN list_transform(range(1, len(t) - {K} + 2), lambda i: {_HASH.format(f"array_to_string(t[i:i + {K} - 1], ' ')")})
  WHEN len(t) > 0 THEN [{_HASH.format("array_to_string(t, ' ')")}] ELSE [] END AS h FROM (SELECT doc_id, lang, source, {_TOKENS} AS t FROM documents)),
fs AS (SELECT doc_id, lang, source, list_sort(list_distinct(CASE WHEN len(h) > {WINDOW} THEN list_transform(range(1, len(h) - {WINDOW} + 2), lambda i: list_min(h[i:i + {WINDOW} - 1])) WHEN len(h) > 0 THEN [list_min(h)] ELSE [] END)) AS f FROM h),
big AS (SELECT * FROM fs WHERE len(f) >= {R.floor}),
named AS (SELECT lang AS rule, f, min(doc_id) AS print FROM big GROUP BY 1, 2),
holds AS (SELECT DISTINCT lang AS rule, print, source AS release FROM big b JOIN named n ON n.rule = b.lang AND n.f = b.f),
pf AS (SELECT rule, print, len(f) AS size, unnest(f) AS f FROM named),
ix AS (SELECT * FROM pf QUALIFY count(*) OVER (PARTITION BY rule, f) <= {R.most_prints}),
img AS (SELECT source AS image, doc_id AS fn, len(f) AS fn_size, unnest(f) AS f FROM fs),
m AS (SELECT image, fn, rule, print, size, fn_size FROM img JOIN ix USING (f) WHERE fn_size >= {R.floor} GROUP BY ALL
  HAVING count(*) >= least({R.floor}, size) AND count(*) >= {R.containment} * size AND fn_size <= {R.magnet} * size)"""


def _functions(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"))
    return settled(docs.select(F.col("lang").alias("rule"), F.col("source").alias("release"), F.col("doc_id").alias("fn"), winnowed(F.col("text"), K, WINDOW).alias("features")))


def _image(functions):
    return functions.filter(F.size("features") > 0).select(F.col("release").alias("image"), F.col("rule").alias("truth"), "fn", "features")


@register(
    "print_matches",
    f"""WITH RECURSIVE {_FEATURES},
sh AS (SELECT m.*, (SELECT count(*) FROM pf JOIN img i ON i.f = pf.f WHERE pf.rule = m.rule AND pf.print = m.print AND i.fn = m.fn AND i.image = m.image) AS shared FROM m),
rk AS (SELECT *, row_number() OVER (PARTITION BY image, fn, rule ORDER BY shared::DOUBLE / (size + fn_size - shared) DESC, shared::DOUBLE / size DESC, print) AS k FROM sh),
pr AS (SELECT DISTINCT a.rule, a.print AS a, b.print AS b, least(a.size, b.size) AS small FROM m a JOIN m b ON a.image = b.image AND a.fn = b.fn AND a.rule = b.rule AND a.print <> b.print),
al AS (SELECT p.rule, a, b FROM pr p JOIN pf x ON x.rule = p.rule AND x.print = a JOIN pf y ON y.rule = p.rule AND y.print = b AND y.f = x.f GROUP BY p.rule, a, b, small HAVING count(*) >= {R.same} * small),
rv AS (SELECT rule, a AS print, list(b) AS rivals FROM al GROUP BY 1, 2),
st(image, fn, rule, k, kept) AS (
  SELECT image, fn, rule, k, [print] FROM rk WHERE k = 1
  UNION ALL SELECT r.image, r.fn, r.rule, r.k, CASE WHEN list_has_any(s.kept, coalesce(v.rivals, [])) THEN s.kept ELSE list_append(s.kept, r.print) END
  FROM st s JOIN rk r ON r.image = s.image AND r.fn = s.fn AND r.rule = s.rule AND r.k = s.k + 1 LEFT JOIN rv v ON v.rule = r.rule AND v.print = r.print),
vt AS (SELECT DISTINCT image, rule, unnest(kept) AS print FROM (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY image, fn, rule ORDER BY k DESC) = 1)),
vw AS (SELECT vt.*, least({R.full - 1}, greatest(len(n.f) - 1, 1)) AS w FROM vt JOIN named n USING (rule, print)),
an AS (SELECT image, rule FROM m GROUP BY 1, 2 HAVING count(DISTINCT print) >= {R.small_matches}),
tot AS (SELECT image, rule, sum(w) AS total FROM vw JOIN an USING (image, rule) GROUP BY 1, 2),
ag AS (SELECT image, rule, release, sum(w) AS agree FROM vw JOIN holds USING (rule, print) GROUP BY 1, 2, 3),
cv AS (SELECT image, rule, release, count(*) AS matched FROM (SELECT DISTINCT image, rule, print FROM m) JOIN holds USING (rule, print) GROUP BY 1, 2, 3),
ow AS (SELECT rule, release, count(*) AS own FROM holds GROUP BY 1, 2),
sc AS (SELECT image, rule, release, total - coalesce(agree, 0) AS against, coalesce(matched, 0) AS matched, own FROM tot JOIN ow USING (rule) LEFT JOIN ag USING (image, rule, release) LEFT JOIN cv USING (image, rule, release)),
be AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY image, rule ORDER BY against, release) = 1),
nr AS (SELECT sc.image, sc.rule, min(sc.release) AS low, max(sc.release) AS high FROM sc JOIN be USING (image, rule) WHERE sc.against <= be.against + {R.range_width * (R.full - 1)} GROUP BY 1, 2)
SELECT image, rule, release, matched::BIGINT AS matched, own, matched::DOUBLE / own AS coverage, low, high FROM be JOIN nr USING (image, rule)
WHERE CASE WHEN matched >= {R.matches} THEN matched::DOUBLE / own >= {R.coverage} ELSE matched >= {R.small_matches} AND matched::DOUBLE / own >= {R.small_coverage} END""",
)
def print_matches(spark, sf_dir):
    functions = _functions(spark, sf_dir)
    reference, holds = prints.reference_prints(functions)
    return prints.print_matches(_image(functions).drop("truth"), reference, holds)


@register(
    "print_strangers",
    f"""WITH {_FEATURES},
im AS (SELECT source || '/' || lang AS image, lang AS truth, doc_id AS fn, f FROM fs WHERE len(f) > 0),

hit AS (SELECT i.image, m.rule FROM m JOIN (SELECT DISTINCT image, fn, truth FROM im) i ON i.fn = m.fn WHERE i.truth <> m.rule GROUP BY 1, 2 HAVING count(DISTINCT print) >= {R.small_matches}),
tr AS (SELECT DISTINCT image, truth FROM im)
SELECT r.rule, (SELECT count(*) FROM tr) AS images, (SELECT count(*) FROM tr WHERE truth <> r.rule) AS pairs, coalesce(h.hits, 0)::BIGINT AS hits,
  CASE WHEN (SELECT count(*) FROM tr WHERE truth <> r.rule) > 0 THEN coalesce(h.hits, 0)::DOUBLE / (SELECT count(*) FROM tr WHERE truth <> r.rule) ELSE 0.0 END AS rate
FROM (SELECT DISTINCT rule FROM named) r LEFT JOIN (SELECT rule, count(*) AS hits FROM hit GROUP BY 1) h USING (rule)""",
)
def print_strangers(spark, sf_dir):
    """Images are the documents of one source and language; no language should be found in another's images."""
    functions = _functions(spark, sf_dir)
    image = functions.filter(F.size("features") > 0).select(F.concat_ws("/", "release", "rule").alias("image"), F.col("rule").alias("truth"), "fn", "features")
    return prints.strangers(image, prints.reference_prints(functions)[0])
