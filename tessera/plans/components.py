"""Queries over the tables that stand in for components, ranges, claims, paths and policies."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import identity, licences, packages, provenance, severity, versions
from tessera.operators import advisories, compose, graph, inventory, paths, resolve
from tessera.plans.registry import register
from tessera.session import spread, table


def values(rows: list[tuple], schema: str):
    """A small fixed table for Spark, and the same as a SQL VALUES list."""
    names = [x.split()[0] for x in schema.split(", ")]

    def sql(x) -> str:
        return "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)

    return (lambda spark: spark.createDataFrame(rows, schema)), f"(VALUES {', '.join('(' + ', '.join(map(sql, r)) + ')' for r in rows)}) AS v({', '.join(names)})"


# ---- resolution -----------------------------------------------------------------------------


@register(
    "winner_per_group",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_quantity DESC, l_linenumber) = 1",
)
def winner_per_group(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    return paths.ranked(t, ["l_orderkey"], [F.desc("l_extendedprice"), F.desc("l_quantity"), F.asc("l_linenumber")]).filter("rank = 1").drop("rank", "l_quantity")


@register(
    "alternatives_top3",
    """WITH r AS (SELECT *, row_number() OVER w AS n, first_value(l_extendedprice) OVER w AS top, first_value(l_partkey) OVER w AS name FROM lineitem
  WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber)),
q AS (SELECT *, (n > 1 AND l_extendedprice >= 0.6 * top AND l_partkey <> name) AS rival FROM r),
k AS (SELECT *, sum(rival::INT) OVER (PARTITION BY l_orderkey ORDER BY n ROWS UNBOUNDED PRECEDING) AS k FROM q)
SELECT l_orderkey, max(l_partkey) FILTER (WHERE n = 1) AS l_partkey, coalesce(string_agg(l_partkey::VARCHAR, ',' ORDER BY k) FILTER (WHERE rival AND k <= 3), '') AS alternatives FROM k GROUP BY 1""",
)
def alternatives_top3(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return resolve.winners(t, ["l_orderkey"], [F.desc("l_extendedprice"), F.asc_nulls_last("l_linenumber")], "l_partkey", "l_extendedprice").select("l_orderkey", "l_partkey", "alternatives")


# ---- paths ----------------------------------------------------------------------------------

_PATH = "regexp_replace(regexp_extract(url, '^[a-z]+://([^?#]+)', 1), '/+$', '')"


def _pages(spark, sf_dir):
    path = F.regexp_replace(F.regexp_extract("url", r"^[a-z]+://([^?#]+)", 1), "/+$", "")
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path"))


_ANC = f"""p AS (SELECT page_id, {_PATH} AS path FROM pages),
a AS (SELECT page_id, path, list_filter(string_split(path, '/'), lambda x: x <> '') AS s FROM p),
e AS (SELECT page_id, path, array_to_string(s[1:k], '/') AS ancestor FROM (SELECT page_id, path, s, unnest(range(1, len(s))) AS k FROM a))"""


@register("url_ancestors", f"WITH {_ANC} SELECT ancestor, count(DISTINCT path) AS paths, count(*) AS n FROM e GROUP BY 1")
def url_ancestors(spark, sf_dir):
    return paths.exploded(_pages(spark, sf_dir)).groupBy("ancestor").agg(F.countDistinct("path").alias("paths"), F.count("*").alias("n"))


@register(
    "nearest_enclosing",
    f"""WITH {_ANC}, h AS (SELECT DISTINCT ancestor AS holder FROM e WHERE length(ancestor) % 2 = 0),
u AS (SELECT page_id, ancestor AS holder FROM e UNION ALL SELECT page_id, array_to_string(s, '/') FROM a)
SELECT p.page_id, f.holder FROM p LEFT JOIN (SELECT page_id, arg_max(holder, length(holder)) AS holder FROM u SEMI JOIN h USING (holder) GROUP BY 1) f USING (page_id)""",
)
def nearest_enclosing(spark, sf_dir):
    p = _pages(spark, sf_dir)
    holders = paths.exploded(p).filter(F.length("ancestor") % 2 == 0).select(F.col("ancestor").alias("holder"))
    return paths.nearest_enclosing(p, holders, "page_id").select("page_id", "holder")


@register(
    "shadowed_anti",
    f"""WITH {_ANC}, s AS (SELECT page_id, path, array_to_string(s, '/') AS me, (page_id * 7919) % 101 AS score FROM a),
b AS (SELECT e.ancestor, max(s.score) AS below FROM e JOIN s USING (page_id) GROUP BY 1)
SELECT page_id, path, score FROM s LEFT JOIN b ON b.ancestor = s.me WHERE below IS NULL OR below < score""",
)
def shadowed_anti(spark, sf_dir):
    p = _pages(spark, sf_dir).withColumn("score", (F.col("page_id") * 7919) % 101)
    return paths.without_shadowed(p, "score").select("page_id", "path", "score")


@register("nested_anti", f"WITH {_ANC} SELECT DISTINCT path FROM p WHERE path NOT IN (SELECT e.path FROM e JOIN (SELECT DISTINCT array_to_string(s, '/') AS me FROM a) t ON t.me = e.ancestor)")
def nested_anti(spark, sf_dir):
    p = _pages(spark, sf_dir).select("path").distinct().withColumn("k", F.lit(1))
    return paths.without_nested(p, ["k"]).select("path")


@register(
    "repository_purls",
    r"""SELECT page_id, CASE WHEN path = '' OR host = '' THEN NULL ELSE 'pkg:generic/' || host || '/' || path END AS purl FROM (
SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)), '^www\.', '') AS host, regexp_replace(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]+/([^?#]*)', 1), '/+$', ''), '\.git$', '') AS path FROM pages)""",
)
def repository_purls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", identity.repository_purl(F.col("url")).alias("purl"))


def cases(key: str, *values: str) -> str:
    """SQL that both engines read: the value at ``key`` modulo their number."""
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(values)) + " END"


def _parts(spark, sf_dir, **columns: str):
    """Parts with columns made of their key, name, brand and size."""
    return table(spark, sf_dir, "part").select("p_partkey", *[F.expr(x).alias(n) for n, x in columns.items()])


_PURL = cases("p_partkey", "'pkg:npm/%40' || replace(p_name, ' ', '-') || '/Pkg.' || p_partkey || '@1.' || p_size || '?arch=x#sub'", "'pkg:pypi/My_' || replace(p_name, ' ', '__.') || '@' || p_size", "'pkg:github/Owner/' || replace(p_name, ' ', '')", "p_name", "NULL", "'pkg:generic/' || p_size || '@b/c@1'")


@register(
    "purl_keys",
    f"""SELECT p_partkey, CASE WHEN purl LIKE 'pkg:%' AND strpos(body, '/') > 1 THEN CASE WHEN body LIKE 'pypi/%' THEN 'pypi/' || regexp_replace(body[6:], '[-_.]+', '-', 'g') ELSE body END END AS key FROM (
SELECT p_partkey, purl, lower(url_decode(regexp_replace(regexp_replace(regexp_replace(trim(purl), '[?#].*$', ''), '@[^@/]*$', ''), '^pkg:/*', ''))) AS body FROM (SELECT p_partkey, {_PURL} AS purl FROM part))""",
)
def purl_keys(spark, sf_dir):
    return _parts(spark, sf_dir, purl=_PURL).select("p_partkey", identity.purl_key(F.col("purl")).alias("key"))


_CPE = cases("p_partkey", "'cpe:2.3:a:' || p_brand || ':' || replace(p_name, ' ', '_') || ':' || p_size || ':*:*:*:*:*:*:*'", "'cpe:2.3:a:ven' || chr(92) || ':' || p_size || ':pro' || chr(92) || ':duct:1'", "'cpe:/a:old:' || p_name", "NULL")


@register("cpe_keys", f"SELECT p_partkey, CASE WHEN cpe LIKE 'cpe:2.3:%' THEN lower(replace(s[4] || ':' || s[5], chr(1), '\\:')) END AS key FROM (SELECT p_partkey, cpe, string_split(replace(cpe, '\\:', chr(1)), ':') AS s FROM (SELECT p_partkey, {_CPE} AS cpe FROM part))")
def cpe_keys(spark, sf_dir):
    return _parts(spark, sf_dir, cpe=_CPE).select("p_partkey", identity.cpe_key(F.col("cpe")).alias("key"))


# ---- versions -------------------------------------------------------------------------------

_plain = ["1.0", "1.0.0", "1.0.1", "v1.10", "1.9", "1.0-rc1", "1.0-rc2", "1.0-beta", "1.0-dev", "2.0-snapshot", "1.1.1a", "1.1.1w", "1.1.1", "deadbeef1", "git-123", "main", "20250612"]
_, _versions_sql = values([(i, v) for i, v in enumerate(_plain)], "id int, version string")


def _one_of(words: list[str], key: str) -> str:
    """SQL of Spark: the word at ``key`` modulo their number."""
    return f"element_at(array({', '.join(f"'{w}'" for w in words)}), cast({key} % {len(words)} + 1 as int))"


_KEY_SQL = f"""k AS (SELECT id, version, (version NOT LIKE 'git-%' AND regexp_matches(version, '[0-9]') AND NOT (regexp_matches(version, '^[0-9a-f]{{7,40}}$') AND regexp_matches(version, '[a-f]'))) AS ok,
  regexp_replace(version, '^v', '') AS v FROM {_versions_sql}),
n AS (SELECT id, version, ok, regexp_extract(v, '-(dev|beta|rc|snapshot)([0-9]*)$', 1) AS word, coalesce(TRY_CAST(regexp_extract(v, '-(dev|beta|rc|snapshot)([0-9]*)$', 2) AS BIGINT), 0) AS phase,
  regexp_replace(v, '-(dev|beta|rc|snapshot)[0-9]*$', '') AS core FROM k),
m AS (SELECT id, version, ok, CASE word WHEN 'dev' THEN -1 WHEN 'beta' THEN 1 WHEN 'rc' THEN 3 WHEN 'snapshot' THEN 3.5 ELSE 4 END AS rank, phase,
  list_transform(regexp_extract_all(core, '[0-9]+'), lambda x: x::BIGINT) || CASE WHEN regexp_matches(core, '[0-9][a-z]$') THEN [ascii(right(core, 1)) - 96] ELSE [] END AS nums FROM n),
key AS (SELECT id, version, ok, rank, phase, nums || list_transform(range(len(nums), 8), lambda x: 0::BIGINT) AS nums FROM m)"""


@register(
    "version_compare_matrix",
    f"""WITH {_KEY_SQL} SELECT p_partkey, a.version AS a, b.version AS b, CASE WHEN a.ok AND b.ok THEN
CASE WHEN (a.nums, a.rank, a.phase) < (b.nums, b.rank, b.phase) THEN -1 WHEN (a.nums, a.rank, a.phase) > (b.nums, b.rank, b.phase) THEN 1 ELSE 0 END END AS "order" FROM part JOIN key a ON a.id = p_partkey % {len(_plain)} JOIN key b ON b.id = p_size * 5 % {len(_plain)}""",
)
def version_compare_matrix(spark, sf_dir):
    """Two releases of each part, chosen by its key and its size."""
    chosen = _parts(spark, sf_dir, a=_one_of(_plain, "p_partkey"), b=_one_of(_plain, "p_size * 5"))
    return chosen.select("p_partkey", "a", "b", versions.compare(F.col("a"), F.col("b")).alias("order"))


_RANGES = [(1, "1.0", None, "1.0.1", None), (2, None, "1.0", None, "v1.10"), (3, "0", None, None, None), (4, None, None, None, None), (5, "1.0-rc1", None, "1.0", None), (6, "main", None, "2.0", None), (7, "1.1.1", None, "1.1.1w", None)]
_ranges, _ranges_sql = values(_RANGES, "range_id int, introduced string, start_excl string, fixed string, last_affected string")


@register(
    "version_in_range",
    f"""WITH {_KEY_SQL}, c AS (SELECT a.version AS a, b.version AS b, CASE WHEN a.ok AND b.ok THEN CASE WHEN (a.nums, a.rank, a.phase) < (b.nums, b.rank, b.phase) THEN -1 WHEN (a.nums, a.rank, a.phase) > (b.nums, b.rank, b.phase) THEN 1 ELSE 0 END END AS o FROM key a, key b),
r AS (SELECT * FROM {_ranges_sql}),
j AS (SELECT p_partkey, k.version, r.*, i.o AS oi, s.o AS os, f.o AS oof, l.o AS ol FROM part JOIN r ON r.range_id = p_size % {len(_RANGES)} + 1 JOIN key k ON k.id = p_partkey % {len(_plain)} LEFT JOIN c i ON i.a = k.version AND i.b = r.introduced LEFT JOIN c s ON s.a = k.version AND s.b = r.start_excl
  LEFT JOIN c f ON f.a = k.version AND f.b = r.fixed LEFT JOIN c l ON l.a = k.version AND l.b = r.last_affected)
SELECT p_partkey, range_id, version, CASE WHEN introduced IS NOT NULL AND introduced <> '0' AND oi IS NULL THEN NULL WHEN introduced <> '0' AND oi < 0 THEN false
  WHEN start_excl IS NOT NULL AND os IS NULL THEN NULL WHEN os <= 0 THEN false WHEN fixed IS NOT NULL AND oof IS NULL THEN NULL WHEN oof >= 0 THEN false
  WHEN last_affected IS NOT NULL AND ol IS NULL THEN NULL WHEN ol > 0 THEN false WHEN coalesce(introduced, start_excl, fixed, last_affected) IS NOT NULL THEN true END AS verdict FROM j""",
)
def version_in_range(spark, sf_dir):
    """One release of each part against one range, chosen by its key and its size."""
    chosen = _parts(spark, sf_dir, version=_one_of(_plain, "p_partkey"), range_id=f"cast(p_size % {len(_RANGES)} + 1 as int)")
    pairs = chosen.join(F.broadcast(_ranges(spark)), "range_id")  # seven ranges
    last = versions.in_range(F.col("version"), F.col("introduced"), F.col("start_excl"), F.col("fixed"), F.col("last_affected"))
    return pairs.select("p_partkey", "range_id", "version", last.alias("verdict"))


_TAGS = ("v1.0", "release-1.1", "V1.2", "REL-2_0_0", "tools-build-20")
_TAGGED = cases("p_partkey", "'v' || p_size % 4 || '.' || p_partkey % 7", "p_size % 4 || '.' || p_partkey % 7 || '.' || p_size % 3", "'deadbeef' || p_size % 10", "'app-' || p_size % 5 || '_' || p_partkey % 3")


@register(
    "tag_membership",
    f"""WITH t AS (SELECT p_partkey, p_size % 2 = 0 AS open, {_TAGGED} AS version FROM part),
n AS (SELECT *, CASE WHEN version NOT LIKE 'deadbeef%' THEN regexp_extract_all(version, '[0-9]+') END AS n FROM t),
k AS (SELECT *, array_to_string(n, '.') AS plain, list_resize(list_transform(n, lambda x: x::INT), 3, 0) AS key FROM n)
SELECT p_partkey, CASE WHEN n IS NULL THEN NULL WHEN plain IN ('1.0', '1.1', '1.2', '2.0.0', '20') THEN true WHEN key < [1, 0, 0] THEN false WHEN key > [2, 0, 0] THEN open END AS verdict FROM k""",
)
def tag_membership(spark, sf_dir):
    tags = F.array(*[F.lit(t) for t in _TAGS])
    chosen = _parts(spark, sf_dir, version=_TAGGED, open="p_size % 2 = 0")
    # many parts have one version: each is asked for once
    said = chosen.select(F.col("version").alias("v"), F.col("open").alias("o")).distinct().withColumn("verdict", versions.in_tags(F.col("v"), tags, F.col("o")))
    return chosen.join(said, F.col("version").eqNullSafe(F.col("v")) & F.col("open").eqNullSafe(F.col("o"))).select("p_partkey", "verdict")


_METRICS = {"AV": ("NALP", "p_partkey"), "AC": ("LH", "p_size"), "PR": ("NLH", "p_partkey"), "UI": ("NR", "p_partkey % 11"), "S": ("UC", "p_partkey % 5"), "C": ("HLN", "p_partkey % 13"), "I": ("HLN", "p_partkey % 17"), "A": ("HLN", "p_size")}
_LETTER = {n: f"substr('{letters}', {key} % {len(letters)} + 1, 1)" for n, (letters, key) in _METRICS.items()}
_VECTOR = "CASE WHEN p_partkey % 23 = 0 THEN NULL WHEN p_partkey % 29 = 0 THEN 'AV:N/AC:L/Au:N/C:P/I:P/A:P' ELSE 'CVSS:3.' || p_partkey % 2 || " + " || ".join(f"'/{n}:' || {x}" for n, x in _LETTER.items()) + " END"
_IMPACTS = "CASE {} WHEN 'H' THEN 0.56 WHEN 'L' THEN 0.22 ELSE 0 END"


@register(
    "cvss_base_scores",
    f"""WITH v AS (SELECT p_partkey, {", ".join(f"{x} AS {n}" for n, x in _LETTER.items())} FROM part WHERE p_partkey % 23 <> 0 AND p_partkey % 29 <> 0),
w AS (SELECT p_partkey, S, (1 - (1 - {_IMPACTS.format('C')}) * (1 - {_IMPACTS.format('I')}) * (1 - {_IMPACTS.format('A')}))::DOUBLE AS i,
  8.22::DOUBLE * CASE AV WHEN 'N' THEN 0.85 WHEN 'A' THEN 0.62 WHEN 'L' THEN 0.55 ELSE 0.2 END * CASE AC WHEN 'L' THEN 0.77 ELSE 0.44 END * CASE UI WHEN 'N' THEN 0.85 ELSE 0.62 END
  * CASE PR WHEN 'N' THEN 0.85 WHEN 'L' THEN CASE S WHEN 'U' THEN 0.62 ELSE 0.68 END ELSE CASE S WHEN 'U' THEN 0.27 ELSE 0.5 END END AS e FROM v),
m AS (SELECT *, CASE S WHEN 'U' THEN 6.42 * i ELSE 7.52 * (i - 0.029) - 3.25 * pow(i - 0.02, 15) END AS m FROM w),
r AS (SELECT p_partkey, CASE WHEN m <= 0 THEN 0 ELSE ceil(round(least(CASE S WHEN 'U' THEN 1 ELSE 1.08 END * (m + e), 10)::DOUBLE * 100000) / 10000) / 10 END::DOUBLE AS score FROM m)
SELECT p_partkey, score, CASE WHEN score = 0 THEN 'none' WHEN score < 4 THEN 'low' WHEN score < 7 THEN 'medium' WHEN score < 9 THEN 'high' WHEN score IS NOT NULL THEN 'critical' END AS level FROM part LEFT JOIN r USING (p_partkey)""",
)
def cvss_base_scores(spark, sf_dir):
    scored = _parts(spark, sf_dir, vector=_VECTOR).select("p_partkey", severity.base_score(F.col("vector")).alias("score"))
    return scored.select("p_partkey", "score", severity.level(F.col("score")).alias("level"))


# ---- advisories ---------------------------------------------------------------------------------

_BOUND = {
    "introduced": "CASE WHEN s_suppkey % 7 = 0 THEN NULL WHEN s_suppkey % 11 = 0 THEN '0' ELSE s_suppkey % 40 || '.' || s_nationkey % 4 END",
    "start_excluding": "CASE WHEN s_suppkey % 7 = 0 AND s_suppkey % 2 = 0 THEN s_suppkey % 30 || '.1' END",
    "fixed": "CASE WHEN s_suppkey % 5 <> 0 THEN s_suppkey % 40 + 9 || '.' || s_nationkey END",
    "last_affected": "CASE WHEN s_suppkey % 10 = 0 THEN s_suppkey % 40 + 20 || '.0' END",
}
_COMPONENT = "CASE WHEN p_partkey % 19 = 0 THEN 'git-' || p_size ELSE p_size || '.' || p_partkey % 10 END"


@register(
    "advisory_range_join",
    f"""WITH p AS (SELECT p_partkey, p_partkey % 1000 AS key, {_COMPONENT} AS version FROM part),
a AS (SELECT s_suppkey, s_suppkey % 1000 AS key, {", ".join(f"{x} AS {n}" for n, x in _BOUND.items())} FROM supplier),
k AS (SELECT p_partkey, s_suppkey, version NOT LIKE 'git-%' AS ok, list_transform(string_split(version, '.'), lambda x: try_cast(x AS INT)) AS v, introduced, {", ".join(f"list_transform(string_split({n}, '.'), lambda x: try_cast(x AS INT)) AS {n}_n" for n in _BOUND)} FROM p JOIN a USING (key)),
o AS (SELECT *, introduced IS NOT NULL AND introduced <> '0' AS has_i, start_excluding_n IS NOT NULL AS has_s, fixed_n IS NOT NULL AS has_f, last_affected_n IS NOT NULL AS has_l FROM k)
SELECT p_partkey, s_suppkey, CASE WHEN NOT (introduced IS NOT NULL OR has_s OR has_f OR has_l) THEN NULL WHEN NOT ok THEN CASE WHEN has_i OR has_s OR has_f OR has_l THEN NULL ELSE true END
  WHEN has_i AND v < introduced_n THEN false WHEN has_s AND v <= start_excluding_n THEN false WHEN has_f AND v >= fixed_n THEN false WHEN has_l AND v > last_affected_n THEN false ELSE true END AS verdict FROM o""",
)
def advisory_range_join(spark, sf_dir):
    """Components by product key against the ranges of advisories; what cannot be ordered stays null."""
    components = _parts(spark, sf_dir, key="p_partkey % 1000", version=_COMPONENT)
    ranges = table(spark, sf_dir, "supplier").select("s_suppkey", F.expr("s_suppkey % 1000").alias("key"), *[F.expr(x).alias(n) for n, x in _BOUND.items()])
    return advisories.range_join(components, ranges).select("p_partkey", "s_suppkey", "verdict")


# ---- ranges, channels, states ----------------------------------------------------------------

_BANDS = "SELECT r_regionkey AS band, CASE WHEN r_regionkey = 0 THEN NULL ELSE 900.0 + 150 * r_regionkey END AS low, CASE WHEN r_regionkey IN (3, 0) THEN NULL ELSE 1300.0 + 150 * r_regionkey END AS high FROM region"


def _bands(spark, sf_dir):
    k = F.col("r_regionkey")
    return table(spark, sf_dir, "region").select(k.alias("band"), F.when(k != 0, 900.0 + 150 * k).alias("low"), F.when(~k.isin(0, 3), 1300.0 + 150 * k).alias("high"))


_VERDICT = "CASE WHEN low IS NULL AND high IS NULL THEN NULL ELSE coalesce(p_retailprice >= low, true) AND coalesce(p_retailprice < high, true) END"


def _band_matches(spark, sf_dir):
    # the bands are one row per region
    joined = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice").join(F.broadcast(_bands(spark, sf_dir)), F.pmod(F.col("p_size"), F.lit(5)) != F.col("band"))
    return joined.withColumn("verdict", advisories.numeric_verdict(F.col("p_retailprice"), F.col("low"), F.col("high")))


@register("range_join_3vl", f"WITH b AS ({_BANDS}) SELECT p_partkey, band, {_VERDICT} AS verdict FROM part JOIN b ON p_size % 5 <> band")
def range_join_3vl(spark, sf_dir):
    return _band_matches(spark, sf_dir).select("p_partkey", "band", "verdict")


_STATE = f"""WITH b AS ({_BANDS}), v AS (SELECT p_partkey, p_size, band, {_VERDICT} AS verdict FROM part JOIN b ON p_size % 5 <> band),
m AS (SELECT p_partkey, CASE WHEN band % 2 = 0 THEN 'cpe' ELSE 'purl' END AS channel, verdict IS NULL AS unplaced, p_size = 50 AS fork, band = 4 AND p_size % 3 = 0 AS authoritative,
  CASE WHEN verdict = false THEN 'not_affected' WHEN verdict IS NULL OR p_size = 50 THEN 'in_triage' ELSE 'exploitable' END AS state FROM v)"""
_RANK = "CASE state WHEN 'exploitable' THEN 0 WHEN 'in_triage' THEN 1 ELSE 2 END"


def _matches(spark, sf_dir):
    m = _band_matches(spark, sf_dir)
    return m.select("p_partkey", F.when(F.col("band") % 2 == 0, "cpe").otherwise("purl").alias("channel"), F.col("verdict").isNull().alias("unplaced"), ((F.col("band") == 4) & (F.col("p_size") % 3 == 0)).alias("authoritative"), resolve.state_of(F.col("verdict"), F.lit(False), F.col("p_size") == 50).alias("state"))


@register("state_summary", _STATE + " SELECT s.state, count(m.state) AS n FROM (VALUES ('exploitable'), ('in_triage'), ('not_affected'), ('resolved'), ('false_positive')) s(state) LEFT JOIN m USING (state) GROUP BY 1")
def state_summary(spark, sf_dir):
    return resolve.state_summary(_matches(spark, sf_dir).select("state"))


@register(
    "merge_worst_state",
    _STATE + f""", g AS (SELECT p_partkey, min({_RANK}) FILTER (WHERE authoritative) AS auth, min({_RANK}) FILTER (WHERE NOT unplaced) AS placed, min({_RANK}) AS any_,
  list_sort(list_distinct(list(channel) FILTER (WHERE NOT unplaced AND state = 'exploitable'))) AS hit, list_sort(list_distinct(list(channel) FILTER (WHERE NOT unplaced AND state = 'not_affected'))) AS miss FROM m GROUP BY 1)
SELECT p_partkey, ['exploitable', 'in_triage', 'not_affected'][1 + coalesce(auth, CASE WHEN len(hit) > 0 AND len(miss) > 0 AND len(list_distinct(list_concat(hit, miss))) > 1 THEN 1 END, placed, any_)] AS state FROM g""",
)
def merge_worst_state(spark, sf_dir):
    return resolve.merged_states(_matches(spark, sf_dir), ["p_partkey"])


_COVER = _STATE + ", c AS (SELECT {by}, bool_or(channel = 'cpe') AS cpe, bool_or(channel = 'purl') AS purl FROM m WHERE state <> 'not_affected' GROUP BY ALL)"


@register("channel_coverage", _COVER.format(by="state, p_partkey") + " SELECT state, count(*) AS n, count_if(cpe) AS by_cpe, count_if(purl) AS by_purl, count_if(cpe AND purl) AS by_both, count_if(NOT cpe AND purl) AS only_purl FROM c GROUP BY 1")
def channel_coverage(spark, sf_dir):
    return advisories.coverage(_matches(spark, sf_dir).filter("state <> 'not_affected'").withColumnRenamed("p_partkey", "vuln_key"), ["state"])


@register(
    "era_status_cube",
    "SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping(o_orderstatus)::INT AS all_status, grouping(o_orderpriority)::INT AS all_priority FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
)
def era_status_cube(spark, sf_dir):
    return table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.grouping("o_orderstatus").cast("int").alias("all_status"), F.grouping("o_orderpriority").cast("int").alias("all_priority"))


@register(
    "threat_enrichment",
    """WITH i AS (SELECT doc_id, unnest([doc_id + 1000000, doc_id + 1, doc_id]) AS id, unnest([0, 1, 2]) AS pos FROM documents),
f AS (SELECT i.doc_id, arg_min(l.quality, pos) AS quality, arg_min(l.toxic, pos) AS toxic FROM i JOIN labels l ON l.doc_id = i.id GROUP BY 1)
SELECT d.doc_id, quality, toxic FROM documents d LEFT JOIN f USING (doc_id)""",
)
def threat_enrichment(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id")
    ids = F.array(F.col("doc_id") + 1000000, F.col("doc_id") + 1, F.col("doc_id"))
    facts = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic")
    return advisories.first_hit(d, "doc_id", ids, facts, "id", ["quality", "toxic"])


@register("risk_order_topk", "SELECT user_id, event_type, value, event_id FROM events ORDER BY CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 ELSE 2 END, value DESC, event_id LIMIT 50")
def risk_order_topk(spark, sf_dir):
    rank = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "click", 1).otherwise(2)
    return table(spark, sf_dir, "events").select("user_id", "event_type", "value", "event_id").orderBy(rank, F.desc("value"), "event_id").limit(50)


@register("feed_upsert", "SELECT c_custkey, arg_max(c_acctbal, (stamp, fresh)) AS c_acctbal, max(stamp) AS stamp FROM (SELECT c_custkey, c_acctbal, c_nationkey AS stamp, 0 AS fresh FROM customer UNION ALL SELECT c_custkey, -c_acctbal, 12, 1 FROM customer WHERE c_custkey % 3 = 0) GROUP BY 1")
def feed_upsert(spark, sf_dir):
    old = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", F.col("c_nationkey").alias("stamp"))
    new = old.filter("c_custkey % 3 = 0").select("c_custkey", (-F.col("c_acctbal")).alias("c_acctbal"), F.lit(12).alias("stamp"))
    return advisories.upsert(old, new, "c_custkey", "stamp")


@register("semi_anti_prefilter", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 45) AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_discount >= 0.09)")
def semi_anti_prefilter(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    key = F.col("l_orderkey") == F.col("o_orderkey")
    return orders.join(items.filter("l_quantity >= 45").select("l_orderkey"), key, "left_semi").join(items.filter("l_discount >= 0.09").select("l_orderkey"), key, "left_anti")


# ---- inventory, policy, licences ------------------------------------------------------------------

PATTERNS = {"mail": r"[A-Za-z0-9.]+@[a-z0-9.]+[a-z]", "licence": "Licensed under|GNU General Public License", "address": r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "secret": "token = \"[0-9a-f]+\"", "mark": "[#*]{3}"}
_HITS = " UNION ALL ".join("SELECT doc_id, '{}' AS family, len(regexp_extract_all(text, '{}'))::BIGINT AS n FROM documents".format(f, p.replace("'", "''")) for f, p in PATTERNS.items())


def _hits(spark, sf_dir):
    return inventory.hits(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text", PATTERNS)


@register("pattern_inventory", f"SELECT family, count(*) AS docs, sum(n)::BIGINT AS hits, max(n) AS most FROM ({_HITS}) WHERE n > 0 GROUP BY 1")
def pattern_inventory(spark, sf_dir):
    return _hits(spark, sf_dir).groupBy("family").agg(F.count("*").alias("docs"), F.sum("n").alias("hits"), F.max("n").alias("most"))


@register("capped_evidence", f"SELECT family, doc_id, n, (sum(n) OVER (PARTITION BY family))::BIGINT AS total, (row_number() OVER (PARTITION BY family ORDER BY n DESC, doc_id))::INT AS rank FROM ({_HITS}) WHERE n > 0 QUALIFY rank <= 20")
def capped_evidence(spark, sf_dir):
    return inventory.capped(_hits(spark, sf_dir), "family", "n", "doc_id").select("family", "doc_id", "n", "total", "rank")


@register(
    "policy_status",
    """SELECT o_orderpriority, CASE WHEN dep IS NULL AND dis IS NULL THEN 'fail' WHEN o_orderdate::DATE > dis THEN 'fail' WHEN o_orderdate::DATE > dep THEN 'deprecated' ELSE 'due' END AS status, count(*) AS n
FROM (SELECT *, CASE WHEN o_orderpriority LIKE '1%' THEN NULL ELSE DATE '1995-06-30' END AS dep, CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN NULL ELSE DATE '1997-01-01' END AS dis FROM orders) GROUP BY 1, 2""",
)
def policy_status(spark, sf_dir):
    p = F.col("o_orderpriority")
    dep = F.when(~p.startswith("1"), F.lit("1995-06-30").cast("date"))
    dis = F.when(~p.startswith("1") & ~p.startswith("2"), F.lit("1997-01-01").cast("date"))
    status = inventory.policy_status(F.col("o_orderdate").cast("date"), dep, dis)
    return table(spark, sf_dir, "orders").groupBy(p, status.alias("status")).agg(F.count("*").alias("n"))


_KNOWN = {"MIT": 0, "GPL-2.0-only": 2, "LGPL-2.1+": 1, "AGPL-3.0-only": 3, "MPL-2.0": 1, "Custom": 4, "Apache-2.0": 0, "GPL-3.0-or-later": 2}
_A, _B, _C = (cases(f"({key})", *[f"'{x}'" for x in _KNOWN]) for key in ("p_partkey", "p_size", "p_partkey % 13"))
_EXPRESSION = cases("(p_partkey % 31)", _A, f"({_A}) || ' OR ' || ({_B})", f"({_A}) || ' AND ' || ({_B}) || ' or ' || ({_C})", f"'(' || ({_A}) || ' OR ' || ({_B}) || ') WITH Classpath-exception-2.0'", "''")
_CLASS_RANK = "CASE {} " + " ".join(f"WHEN '{x}' THEN {r}" for x, r in _KNOWN.items()) + " END"


@register(
    "licence_expression_class",
    f"""WITH r AS (SELECT p_partkey, p_partkey % 31 % 5 AS kind, {", ".join(f"{_CLASS_RANK.format(x)} AS {n}" for n, x in (("a", _A), ("b", _B), ("c", _C)))} FROM part)
SELECT p_partkey, (['permissive', 'weak', 'strong', 'network', 'unknown'])[1 + CASE kind WHEN 0 THEN a WHEN 2 THEN least(greatest(a, b), c) WHEN 4 THEN 4 ELSE least(a, b) END] AS class FROM r""",
)
def licence_expression_class(spark, sf_dir):
    return _parts(spark, sf_dir, expression=_EXPRESSION).select("p_partkey", licences.expression_class(F.col("expression")).alias("class"))


_IDS = ["Apache-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "AGPL-3.0-only", "OpenSSL", "CDDL-1.0", "EPL-1.0", "MIT"]
_ID_SQL = f"(['{"', '".join(_IDS)}'])[{{}} % {len(_IDS)} + 1]"
_GPL = "regexp_matches({}, '^A?GPL-[0-9]\\.0-(only|or-later)$')"
_WAY = "(({x} = 'Apache-2.0' AND {y} IN ('GPL-2.0-only', 'AGPL-2.0-only')) OR ({x} IN ('GPL-2.0-only', 'AGPL-2.0-only') AND {y} = 'GPL-3.0-only') OR ({x} LIKE 'AGPL%' AND {y} IN ('GPL-2.0-only', 'AGPL-2.0-only')) OR (({x} IN ('OpenSSL', 'EPL-1.0') OR {x} LIKE 'CDDL%') AND " + _GPL.format("{y}") + "))"


@register("licence_conflicts", f"SELECT p_partkey, a, b FROM (SELECT p_partkey, {_ID_SQL.format('p_partkey')} AS a, {_ID_SQL.format('(p_size * 4 + p_partkey // 9)')} AS b FROM part) WHERE {_WAY.format(x='a', y='b')} OR {_WAY.format(x='b', y='a')}")
def licence_conflicts(spark, sf_dir):
    """Parts whose two licences, chosen by key and size, cannot be met at once."""
    chosen = _parts(spark, sf_dir, a=_one_of(_IDS, "p_partkey"), b=_one_of(_IDS, "(p_size * 4 + p_partkey div 9)"))
    return chosen.filter(licences.incompatible(F.col("a"), F.col("b"))).select("p_partkey", "a", "b")


@register(
    "spdx_and_licence_lines",
    r"""SELECT doc_id, n, CASE WHEN t LIKE '%apache license%' AND t LIKE '%version 2.0%' THEN 'Apache-2.0' WHEN t LIKE '%mozilla public license%' AND t LIKE '%2.0%' THEN 'MPL-2.0'
  WHEN t LIKE '%permission is hereby granted, free of charge, to any person obtaining a copy%' THEN 'MIT' END AS licence FROM (
SELECT doc_id, len(regexp_extract_all(text, 'Licensed under [^\n]*'))::INT AS n, lower(regexp_replace(regexp_replace(text, '[#*/;]+', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM documents) WHERE n > 0""",
)
def spdx_and_licence_lines(spark, sf_dir):
    n = F.regexp_count("text", F.lit(r"Licensed under [^\n]*"))
    return table(spark, sf_dir, "documents").select("doc_id", n.alias("n"), licences.text_licence(F.col("text")).alias("licence")).filter("n > 0")


# ---- diff, merge, score ------------------------------------------------------------------------------


@register(
    "sbom_diff_full_outer",
    """WITH a AS (SELECT lower(c_name) AS k, c_mktsegment AS old FROM customer WHERE c_custkey % 7 <> 0), b AS (SELECT lower(c_name) AS k, CASE WHEN c_custkey % 5 = 0 THEN 'MOVED' ELSE c_mktsegment END AS new FROM customer WHERE c_custkey % 11 <> 0)
SELECT coalesce(a.k, b.k) AS c_name, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'changed' END AS change, old, new FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR old IS DISTINCT FROM new""",
)
def sbom_diff_full_outer(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    old = c.filter("c_custkey % 7 <> 0").select("c_name", F.col("c_mktsegment").alias("v"))
    new = c.filter("c_custkey % 11 <> 0").select("c_name", F.when(F.col("c_custkey") % 5 == 0, "MOVED").otherwise(F.col("c_mktsegment")).alias("v"))
    return resolve.full_diff(old, new, "c_name", "v")


@register(
    "first_wins_merge",
    """WITH t AS (SELECT c_nationkey, c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS segment, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS balance FROM customer)
SELECT c_nationkey, arg_min(segment, c_custkey) FILTER (WHERE segment IS NOT NULL) AS segment, arg_min(balance, c_custkey) FILTER (WHERE balance IS NOT NULL) AS balance FROM t GROUP BY 1""",
)
def first_wins_merge(spark, sf_dir):
    t = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).alias("segment"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("balance"))
    return resolve.first_wins(t, ["c_nationkey"], "c_custkey", ["segment", "balance"])


@register(
    "completeness_score",
    """WITH c AS (SELECT count(*) AS total, count_if(s_name <> '') AS name, count_if(s_acctbal > 0) AS balance, count_if(s_nationkey < 13) AS nation FROM supplier)
SELECT element, passed, total, passed::DOUBLE / total AS share FROM (SELECT total, unnest(['name', 'balance', 'nation']) AS element, unnest([name, balance, nation]) AS passed FROM c)""",
)
def completeness_score(spark, sf_dir):
    t = table(spark, sf_dir, "supplier")
    return resolve.completeness(t, {"name": F.col("s_name") != "", "balance": F.col("s_acctbal") > 0, "nation": F.col("s_nationkey") < 13})


@register(
    "eval_metrics",
    """SELECT lang, grouping(lang)::INT AS overall, count_if(t AND s) AS hits, count_if(t) AS wanted, count_if(s) AS said, count_if(t AND s)::DOUBLE / nullif(count_if(t), 0) AS recall, count_if(t AND s)::DOUBLE / nullif(count_if(s), 0) AS precision
FROM (SELECT lang, coalesce(quality = 0, false) AS t, coalesce(regexp_matches(text, '[#*$%&]{3}'), false) AS s FROM documents JOIN labels USING (doc_id)) GROUP BY ROLLUP (lang)""",
)
def eval_metrics(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("text").rlike("[#*$%&]{3}").alias("s")).join(table(spark, sf_dir, "labels"), "doc_id")
    return inventory.metrics(rows, "lang", F.col("quality") == 0, F.col("s")).withColumn("overall", F.col("overall").cast("int"))


# ---- graphs, patches, unknown ---------------------------------------------------------------------------


@register(
    "reachable_vertices",
    """WITH RECURSIVE e AS (SELECT DISTINCT 'n' || c_nationkey AS src, 'c' || c_custkey AS dst FROM customer UNION SELECT DISTINCT 'c' || o_custkey, 'o' || o_orderkey FROM orders UNION SELECT DISTINCT 'o' || l_orderkey, 's' || l_suppkey FROM lineitem),
w(seed, vertex, hops) AS (SELECT DISTINCT src, src, 0 FROM e WHERE src IN ('n3', 'n7') UNION SELECT w.seed, e.dst, w.hops + 1 FROM w JOIN e ON e.src = w.vertex WHERE w.hops < 4)
SELECT seed, vertex, min(hops) AS hops FROM w GROUP BY 1, 2""",
)
def reachable_vertices(spark, sf_dir):
    edge = lambda t, a, x, b, y: table(spark, sf_dir, t).select(F.concat(F.lit(a), x).alias("src"), F.concat(F.lit(b), y).alias("dst"))
    edges = edge("customer", "n", "c_nationkey", "c", "c_custkey").unionByName(edge("orders", "c", "o_custkey", "o", "o_orderkey")).unionByName(edge("lineitem", "o", "l_orderkey", "s", "l_suppkey")).distinct()
    seeds = spark.createDataFrame([("n3", "n3"), ("n7", "n7")], "seed string, vertex string")
    return graph.reachable(edges, seeds, 4)


@register(
    "patch_presence",
    """WITH f AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'fixed' WHEN l_returnflag = 'A' AND l_tax < 0.03 THEN 'vulnerable' WHEN l_linestatus = 'F' THEN 'modified' ELSE 'absent' END AS s FROM lineitem),
g AS (SELECT l_orderkey, bool_or(s = 'fixed') AS f, bool_or(s = 'vulnerable') AS v, bool_or(s = 'modified') AS m FROM f GROUP BY 1)
SELECT state, count(*) AS n FROM (SELECT CASE WHEN f AND v THEN 'partial' WHEN v THEN 'vulnerable' WHEN f AND m THEN 'partial' WHEN f THEN 'fixed' WHEN m THEN 'modified' ELSE 'absent' END AS state FROM g) GROUP BY 1""",
)
def patch_presence(spark, sf_dir):
    none = F.lit(False)
    state = inventory.patch_verdict(F.col("l_returnflag") == "R", (F.col("l_returnflag") == "A") & (F.col("l_tax") < 0.03), none, none, F.col("l_linestatus") == "F")
    return inventory.patch_state(table(spark, sf_dir, "lineitem").select("l_orderkey", state.alias("state")), ["l_orderkey"]).groupBy("state").agg(F.count("*").alias("n"))


@register(
    "unknown_signals",
    """SELECT doc_id, score, reasons FROM (SELECT doc_id, (CASE WHEN regexp_matches(text, 'Licensed under') THEN 2.0 ELSE 0 END + CASE WHEN regexp_matches(text, '[0-9a-f]{40}') THEN 1.5 ELSE 0 END + CASE WHEN n_chars > 2000 THEN 1.0 ELSE 0 END + CASE WHEN lang <> 'en' THEN 0.5 ELSE 0 END)::DOUBLE AS score,
array_to_string(list_filter([CASE WHEN regexp_matches(text, 'Licensed under') THEN 'licence' END, CASE WHEN regexp_matches(text, '[0-9a-f]{40}') THEN 'secret' END, CASE WHEN n_chars > 2000 THEN 'long' END, CASE WHEN lang <> 'en' THEN 'foreign' END], lambda x: x IS NOT NULL), ',') AS reasons FROM documents) WHERE score >= 3""",
)
def unknown_signals(spark, sf_dir):
    weights = {"licence": (2.0, F.col("text").rlike("Licensed under")), "secret": (1.5, F.col("text").rlike("[0-9a-f]{40}")), "long": (1.0, F.col("n_chars") > 2000), "foreign": (0.5, F.col("lang") != "en")}
    return inventory.signals(table(spark, sf_dir, "documents"), "doc_id", weights, 3.0)


_DPKG = ("p_size % 3 || ':' || p_partkey % 9 || '.' || p_size || CASE WHEN p_partkey % 4 = 0 THEN '~rc' || p_size % 5 ELSE '' END || '-' || p_partkey % 11", "p_partkey % 3 || ':' || p_size % 9 || '.' || p_partkey % 50 || CASE WHEN p_size % 4 = 0 THEN '~rc' || p_partkey % 5 ELSE '' END || '-' || p_size % 11")
_APK = tuple(x.replace("|| ':'", "|| '.'").replace("~rc", "_rc").replace("'-'", "'-r'") for x in _DPKG)
_PKG_KEYS = ("[p_size % 3, p_partkey % 9, p_size, CASE WHEN p_partkey % 4 = 0 THEN p_size % 5 ELSE 99 END, p_partkey % 11]", "[p_partkey % 3, p_size % 9, p_partkey % 50, CASE WHEN p_size % 4 = 0 THEN p_partkey % 5 ELSE 99 END, p_size % 11]")


@register(
    "package_order",
    f"""WITH k AS (SELECT p_partkey, {_PKG_KEYS[0]}::BIGINT[] AS a, {_PKG_KEYS[1]}::BIGINT[] AS b FROM part)
SELECT p_partkey, kind, CASE WHEN a < b THEN -1 WHEN a > b THEN 1 ELSE 0 END AS "order" FROM k, (VALUES ('dpkg'), ('apk')) v(kind)""",
)
def package_order(spark, sf_dir):
    t = _parts(spark, sf_dir, dpkg_a=_DPKG[0], dpkg_b=_DPKG[1], apk_a=_APK[0], apk_b=_APK[1])
    of = lambda kind: t.select("p_partkey", F.lit(kind).alias("kind"), packages.compared(F.col(f"{kind}_a"), F.col(f"{kind}_b"), kind).alias("order"))
    return of("dpkg").unionByName(of("apk"))


@register(
    "minimum_elements",
    """WITH c AS (SELECT count(*) AS total, count_if(p_name <> '') AS name, count_if(p_size > 25) AS version, count_if(p_partkey % 3 = 0) AS identifier, count_if(p_brand <> 'none') AS supplier, count_if(p_partkey % 5 = 0) AS hash, 0 AS license FROM part)
SELECT standard, element, passed, total, passed::DOUBLE / total AS share FROM (SELECT total, unnest(['ntia-2021', 'ntia-2021', 'ntia-2021', 'ntia-2021', 'cisa-2026', 'cisa-2026', 'cisa-2026', 'cisa-2026', 'cisa-2026', 'cisa-2026']) AS standard,
unnest(['name', 'version', 'identifier', 'supplier', 'name', 'version', 'identifier', 'supplier', 'hash', 'license']) AS element, unnest([name, version, identifier, supplier, name, version, identifier, supplier, hash, license]) AS passed FROM c)""",
)
def minimum_elements(spark, sf_dir):
    key = F.col("p_partkey")
    t = table(spark, sf_dir, "part").select(
        F.col("p_name").alias("name"), F.when(F.col("p_size") > 25, F.col("p_size").cast("string")).otherwise("NOASSERTION").alias("version"), F.col("p_brand").alias("supplier"), F.when(key % 3 == 0, F.concat(F.lit("pkg:part/"), key.cast("string"))).alias("purl"),
        F.lit("n/a").alias("cpe"), F.when(key % 5 == 0, F.array(F.lit("h"))).alias("hashes"), F.array().cast("array<string>").alias("licenses"),
    )
    return compose.minimum_elements(t)


@register(
    "declared_on_found",
    """WITH f AS (SELECT c_nationkey AS directory, 'n' || min(c_custkey) AS name, CASE WHEN c_nationkey % 2 = 0 THEN '1.0' END AS version, 0.6 AS identity FROM customer WHERE c_nationkey < 20 GROUP BY c_nationkey),
d AS (SELECT c_nationkey AS directory, CASE WHEN c_nationkey % 5 = 0 THEN 'other' ELSE 'N' || min(c_custkey) END AS name, CASE WHEN c_nationkey % 3 = 0 THEN '2.0' ELSE '1.0' END AS version FROM customer WHERE c_nationkey > 4 GROUP BY c_nationkey),
j AS (SELECT coalesce(f.directory, d.directory) AS directory, f.name AS fn, d.name AS dn, f.version AS fv, d.version AS dv, identity, CASE WHEN f.name IS NULL THEN 'declared' WHEN d.name IS NULL THEN 'found' WHEN lower(f.name) <> lower(d.name) THEN 'disputed'
  WHEN f.version IS NULL THEN 'completed' WHEN d.version IS NULL OR f.version = d.version THEN 'confirmed' ELSE 'disagrees' END AS outcome FROM f FULL JOIN d ON f.directory = d.directory)
SELECT directory, coalesce(fn, dn) AS name, CASE WHEN outcome IN ('declared', 'completed') THEN dv ELSE fv END AS version, (CASE WHEN outcome IN ('declared', 'confirmed', 'completed') THEN 0.9 ELSE identity END)::DOUBLE AS identity, outcome FROM j""",
)
def declared_on_found(spark, sf_dir):
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("directory")).agg(F.min("c_custkey").cast("string").alias("k"))
    even = F.when(F.col("directory") % 2 == 0, "1.0")
    found = c.filter("directory < 20").select("directory", F.concat(F.lit("n"), "k").alias("name"), even.alias("version"), F.lit(0.6).alias("identity"))
    declared = c.filter("directory > 4").select("directory", F.when(F.col("directory") % 5 == 0, "other").otherwise(F.concat(F.lit("N"), "k")).alias("name"), F.when(F.col("directory") % 3 == 0, "2.0").otherwise("1.0").alias("version"))
    return compose.with_declarations(found, declared)


@register("loose_assignment")
def loose_assignment(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 97).alias("d"), "l_partkey", "l_suppkey").agg(F.sum("l_quantity").cast("long").alias("held"))
    claims = items.select(F.col("d").cast("string").alias("directory"), F.col("l_partkey").cast("string").alias("path"), F.col("l_suppkey").cast("string").alias("owner"), "held", (F.col("held") + F.col("l_partkey") % 9).alias("own"), (F.col("l_partkey") % 50 == F.col("l_suppkey") % 50).alias("named"))
    return compose.loose_groups(claims)


def _any_of(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


_LICENCE_SQL = "(list_sort([x FOR x IN [" + ", ".join(f"CASE WHEN {' AND '.join(f"contains(w, ' {c} ')" for c in clauses)} THEN {{'size': {sum(map(len, clauses))}, 'spdx': '{spdx.lower()}'}} END" for spdx, clauses in licences.CLAUSES.items()) + "] IF x IS NOT NULL], 'DESC'))[1].spdx"


@register(
    "copyright_holders",
    rf"""WITH l AS (SELECT doc_id, text, list_filter(string_split_regex(coalesce(text, ''), '\r\n|\r|\n'), lambda x: regexp_matches(lower(x), 'copyright([^a-z0-9_]|$)')) AS l,
  ' ' || regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g') || ' ' AS w,
  list_filter(string_split_regex(substr(text, 1, 1024), '\r\n|\r|\n'), lambda x: contains(x, 'SPDX-License-Identifier:')) AS h FROM documents),
t AS (SELECT doc_id, w, h, list_transform(l, lambda x: list_filter(list_transform(string_split_regex(regexp_replace(lower(x), '^.*?copyright([^a-z0-9_]|$)', '\1'), '[\s,;]+'),
  lambda v: CASE WHEN regexp_matches(v, '@|://|^<.*>$') THEN '' ELSE regexp_replace(regexp_replace(v, '^[^a-z0-9]+', ''), '[^a-z0-9+]+$', '') END), lambda v: regexp_matches(v, '^[a-z]'))) AS c FROM l),
f AS (SELECT doc_id, w, h, list_filter(c, lambda x: len(x) > 0 AND NOT list_contains([{_any_of(provenance.PROSE)}], x[1]))[1] AS c FROM t),
n AS (SELECT doc_id, nullif(array_to_string(list_filter(c, lambda x: len(x) > 1 AND NOT list_contains([{_any_of(provenance.AROUND)}], x))[1:2], ' '), '') AS name, {_LICENCE_SQL} AS licence,
  lower(regexp_extract(rtrim(trim(string_split(string_split(string_split(h[1], 'SPDX-License-Identifier:')[-1], '*')[1], '-->')[1]), '.'), '^\S+')) AS tag FROM f)
SELECT doc_id, coalesce(name, 'license:' || coalesce(nullif(tag, ''), licence)) AS holder FROM n""",
)
def copyright_holders(spark, sf_dir):
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", provenance.holder(F.col("text")).alias("holder"))


_NAME = cases("p_partkey", "replace(p_name, ' ', '_')", "'__get_' || p_partkey", "substr(p_name, 1, 3) || 'Task' || p_size", "replace(p_name, ' ', '')", "'X_' || p_brand", "upper(p_name) || '_Init'")


@register(
    "name_prefixes",
    f"""WITH n AS (SELECT p_partkey, {_NAME} AS name FROM part),
p AS (SELECT p_partkey, lower(CASE WHEN regexp_matches(name, '^_*[A-Za-z0-9]+_') THEN regexp_extract(name, '^_*([A-Za-z0-9]+)_', 1) ELSE regexp_extract(name, '^_*([a-z]+)[A-Z]', 1) END) AS p FROM n)
SELECT p_partkey, CASE WHEN length(p) > 1 AND p NOT IN ({_any_of(provenance.COMMON)}) THEN p END AS prefix FROM p""",
)
def name_prefixes(spark, sf_dir):
    return _parts(spark, sf_dir, name=_NAME).select("p_partkey", provenance.name_prefix(F.col("name")).alias("prefix"))
