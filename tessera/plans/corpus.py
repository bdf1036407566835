"""Queries over documents and reference passages: tokens, shingles, sketches, containment, releases, owners."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import hashing
from tessera.functions.hashing import shingle_hashes, sketch, winnowed
from tessera.functions.text import tokens
from tessera.operators import graph, holders, nearness, presence, sketches
from tessera.plans.registry import register
from tessera.session import spread, table

K = 4
#: DuckDB: distinct h60 hashes of 4-token shingles, as presence.hash_table makes them.
_HASH = "('0x' || substr(md5({}), 1, 15))::BIGINT"


def _shingles_sql(name: str, source: str, key: str, extra: str = "") -> str:
    """CTEs ``{name}_t`` (tokens) and ``{name}`` (distinct shingle hashes)."""
    return f"""{name}_t AS (SELECT {key}{extra}, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS t FROM {source}),
{name} AS (SELECT DISTINCT {key}{extra}, {_HASH.format('s')} AS h FROM (
  SELECT {key}{extra}, unnest(CASE WHEN len(t) >= {K} THEN list_transform(range(1, len(t) - {K} + 2), lambda i: array_to_string(t[i:i + {K} - 1], ' '))
    WHEN len(t) > 0 THEN [array_to_string(t, ' ')] ELSE [] END) AS s FROM {name}_t))"""


_CONTAINMENT = f"""WITH {_shingles_sql('d', 'documents', 'doc_id')},
{_shingles_sql('r', 'benchmark', 'item_id')},
own AS (SELECT item_id, count(*) AS own FROM r GROUP BY 1),
p AS (SELECT doc_id, item_id, count(*) AS held FROM d JOIN r USING (h) GROUP BY 1, 2),
s AS (SELECT doc_id, item_id, held, own, held::DOUBLE / own AS containment FROM p JOIN own USING (item_id))"""
_BAND = "CASE WHEN containment >= 0.8 THEN 'strong' WHEN containment >= 0.5 THEN 'partial' WHEN containment >= 0.2 THEN 'weak' ELSE 'below' END"


def _docs(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _items(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", "text")


@register(
    "containment_best_match",
    f"""{_CONTAINMENT}
SELECT doc_id, item_id, held, own, containment, {_BAND} AS band FROM s WHERE containment >= 0.2
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY containment DESC, held DESC, item_id) = 1""",
)
def containment_best_match(spark, sf_dir):
    return presence.containment_best(_docs(spark, sf_dir), _items(spark, sf_dir), K).select("doc_id", "item_id", "held", "own", "containment", "band")


@register("containment_all_pairs", f"{_CONTAINMENT} SELECT doc_id, item_id, held, own, containment, {_BAND} AS band FROM s")
def containment_all_pairs(spark, sf_dir):
    pairs = presence.overlaps(presence.hash_table(_docs(spark, sf_dir), ["doc_id"], "text", K), presence.hash_table(_items(spark, sf_dir), ["item_id"], "text", K), "doc_id", "item_id")
    return pairs.withColumn("containment", F.col("held") / F.col("own")).withColumn("band", presence.band(F.col("containment")))


@register("jaccard_pairs", f"{_CONTAINMENT}, n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY 1) SELECT doc_id, item_id, held::DOUBLE / (n + own - held) AS jaccard FROM s JOIN n USING (doc_id)")
def jaccard_pairs(spark, sf_dir):
    present, reference = presence.counted(_docs(spark, sf_dir), "doc_id", "text", K), presence.hash_table(_items(spark, sf_dir), ["item_id"], "text", K)
    own = reference.groupBy("item_id").agg(F.count("*").alias("own"))
    pairs = present.join(reference, "h").groupBy("doc_id", "n", "item_id").agg(F.count("*").alias("held")).join(own, "item_id")
    return pairs.select("doc_id", "item_id", (F.col("held") / (F.col("n") + F.col("own") - F.col("held"))).alias("jaccard"))


_TOKENS = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')"


@register("token_counts", f"SELECT doc_id, len(t)::INT AS n_tokens, len(list_distinct(t))::INT AS n_distinct FROM (SELECT doc_id, {_TOKENS} AS t FROM documents)")
def token_counts(spark, sf_dir):
    t = tokens(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.size(t).alias("n_tokens"), F.size(F.array_distinct(t)).alias("n_distinct"))


@register("shingle_counts", f"WITH {_shingles_sql('d', 'documents', 'doc_id')} SELECT doc_id, count(*) AS n_shingles, min(h) AS first_hash FROM d GROUP BY 1")
def shingle_counts(spark, sf_dir):
    found = _docs(spark, sf_dir).select("doc_id", shingle_hashes(F.col("text"), K).alias("h")).select("doc_id", F.size("h").cast("long").alias("n_shingles"), F.array_min("h").alias("first_hash"))
    return found.filter("n_shingles > 0")


@register(
    "line_dup_counts",
    r"""SELECT doc_id, count(*) AS n_lines, count(DISTINCT l) AS n_distinct_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents)
WHERE regexp_matches(l, '[^ \t\n\v\f\r]') GROUP BY 1""",
)
def line_dup_counts(spark, sf_dir):
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]"))
    return _docs(spark, sf_dir).withColumn("l", lines).filter(F.size("l") > 0).select("doc_id", F.size("l").cast("long").alias("n_lines"), F.size(F.array_distinct("l")).cast("long").alias("n_distinct_lines"))


#: Words of a shingle, window and sketch.
_K, _WINDOW, _SKETCH = 16, 8, 256
_DOC_HASHES = f"""h AS (SELECT doc_id, CASE WHEN len(t) >= {_K} THEN list_transform(range(1, len(t) - {_K} + 2), lambda i: {_HASH.format(f"array_to_string(t[i:i + {_K} - 1], ' ')")})
  WHEN len(t) > 0 THEN [{_HASH.format("array_to_string(t, ' ')")}] ELSE [] END AS h FROM (SELECT doc_id, {_TOKENS} AS t FROM documents))"""


@register(
    "winnow_fingerprints",
    f"""WITH {_DOC_HASHES}
SELECT DISTINCT doc_id, unnest(CASE WHEN len(h) > {_WINDOW} THEN list_transform(range(1, len(h) - {_WINDOW} + 2), lambda i: list_min(h[i:i + {_WINDOW} - 1])) WHEN len(h) > 0 THEN [list_min(h)] ELSE [] END) AS h FROM h""",
)
def winnow_fingerprints(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.explode(winnowed(F.col("text"), _K, _WINDOW)).alias("h"))


_SKETCHES = f"{_DOC_HASHES}, s AS (SELECT doc_id, (list_sort(list_distinct(h)))[1:{_SKETCH}] AS s FROM h WHERE len(h) > 0)"


@register("bottomk_sketch", f"WITH {_SKETCHES} SELECT doc_id, unnest(s) AS h, unnest(range(1, len(s) + 1))::INT AS n FROM s")
def bottomk_sketch(spark, sf_dir):
    s = sketch(F.col("text"), _K, _SKETCH)
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(s).alias("p", "h")).select("doc_id", "h", (F.col("p") + 1).alias("n"))


def _rolling_sql() -> str:
    """CTE ``s(doc_id, n, h)``: rolling hashes of all shingles, as ``hashing.rolling`` makes them."""
    fold = lambda values, base: f"list_reduce(list_prepend(0::UHUGEINT, {values}), lambda a, b: (a * {base} + b) % 18446744073709551616::UHUGEINT)"

    def finished(name: str, keys: str) -> str:
        out = ""
        for n, (shift, factor) in enumerate(hashing.FINAL):
            x = f"xor(x, x >> {shift})"
            out += f"{name}{n + 1} AS (SELECT {keys}, {f'({x}::UHUGEINT * {factor} % 18446744073709551616::UHUGEINT)::UBIGINT' if factor else x} AS x FROM {name}{n}),\n"
        return out

    codes = "list_transform(string_split(w, ''), lambda c: ascii(c)::UHUGEINT)"
    return f"""t AS (SELECT doc_id, {_TOKENS} AS t FROM documents),
w0 AS (SELECT w, {fold(codes, hashing.BYTE_BASE)}::UBIGINT AS x FROM (SELECT DISTINCT unnest(t) AS w FROM t)),
{finished("w", "w")}
p AS (SELECT doc_id, list(x::UHUGEINT ORDER BY n) AS h FROM (SELECT doc_id, unnest(t) AS w, generate_subscripts(t, 1) AS n FROM t) JOIN w3 USING (w) GROUP BY 1),
f0 AS (SELECT doc_id, unnest(range(1, greatest(len(h) - {_K} + 2, 2))) AS n, unnest(list_transform(range(1, greatest(len(h) - {_K} + 2, 2)), lambda i: {fold(f"h[i:i + {_K} - 1]", hashing.WORD_BASE)}))::UBIGINT AS x FROM p),
{finished("f", "doc_id, n")}
s AS (SELECT doc_id, n, (x >> 1)::BIGINT AS h FROM f3)"""


@register("rolling_sketch", f"WITH {_rolling_sql()} SELECT doc_id, h, n::INT AS n FROM (SELECT doc_id, h, row_number() OVER (PARTITION BY doc_id ORDER BY h) AS n FROM (SELECT DISTINCT doc_id, h FROM s)) WHERE n <= {_SKETCH}")
def rolling_sketch(spark, sf_dir):
    s = sketch(F.col("text"), _K, _SKETCH, "rolling")
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(s).alias("p", "h")).select("doc_id", "h", (F.col("p") + 1).alias("n"))


@register(
    "rolling_winnow",
    f"""WITH {_rolling_sql()}, m AS (SELECT doc_id, n, min(h) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN CURRENT ROW AND {_WINDOW - 1} FOLLOWING) AS h, max(n) OVER (PARTITION BY doc_id) AS top FROM s)
SELECT DISTINCT doc_id, h FROM m WHERE n <= greatest(top - {_WINDOW - 1}, 1)""",
)
def rolling_winnow(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.explode(winnowed(F.col("text"), _K, _WINDOW, "rolling")).alias("h"))


@register(
    "kmv_similarity",
    f"""WITH {_SKETCHES},
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.s AS x, b.s AS y, least(len(a.s), len(b.s), {_SKETCH}) AS m FROM s a JOIN s b ON a.doc_id < b.doc_id AND list_has_any(a.s, b.s))
SELECT a, b, len(list_intersect(list_intersect((list_sort(list_distinct(list_concat(x, y))))[1:m], x), y))::DOUBLE / m AS similarity FROM p""",
)
def kmv_pairs(spark, sf_dir):
    # two sketches with no common value are 0 alike: only those that share one are compared
    return sketches.similar_pairs(sketches.sketches(_docs(spark, sf_dir), _K, _SKETCH), _SKETCH)


_NEAR = r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS t FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(t) >= 5 THEN list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i + 4], ' ')) WHEN len(t) > 0 THEN [array_to_string(t, ' ') || chr(10)] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b, o::DOUBLE / (x.n + y.n - o) AS similarity FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o))"""


@register(
    "near_duplicate_pairs",
    f"""{_NEAR}, c AS (SELECT b, min(a) AS rep FROM l WHERE similarity = 1 GROUP BY 1)
SELECT a, b, similarity FROM l WHERE a NOT IN (SELECT b FROM c) AND b NOT IN (SELECT b FROM c) UNION ALL SELECT rep, b, 1.0 FROM c""",
)
def near_duplicate_pairs(spark, sf_dir):
    return nearness.near_pairs(_docs(spark, sf_dir))


@register(
    "connected_groups",
    f"""{_NEAR}, e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
w(node, other) AS (SELECT a, a FROM e UNION SELECT w.node, e.b FROM w JOIN e ON e.a = w.other) SELECT node, min(other) AS component FROM w GROUP BY 1""",
)
def connected_groups(spark, sf_dir):
    return graph.groups(nearness.near_links(_docs(spark, sf_dir)))


@register("exact_copies", "SELECT sha256(text) AS digest, min(doc_id) AS first_doc, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def exact_copies(spark, sf_dir):
    d = _docs(spark, sf_dir).filter("text is not null").select("doc_id", F.sha2("text", 256).alias("digest"))
    return d.groupBy("digest").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies")).filter("copies > 1")


_THOUSAND = "sha256(string_agg(d, '' ORDER BY d))"


@register(
    "fileset_digest_by_source",
    f"""WITH f AS (SELECT source, doc_id // 1000 AS a, doc_id // 1000000 AS b, lpad(doc_id::VARCHAR, 20, '0') || sha256(text) AS d FROM documents WHERE text IS NOT NULL),
x AS (SELECT source, b, lpad(a::VARCHAR, 20, '0') || {_THOUSAND} AS d, count(*) AS n FROM f GROUP BY source, a, b),
y AS (SELECT source, lpad(b::VARCHAR, 20, '0') || {_THOUSAND} AS d, sum(n) AS n FROM x GROUP BY source, b)
SELECT source, sum(n)::BIGINT AS files, {_THOUSAND} AS fileset FROM y GROUP BY 1""",
)
def fileset_digest_by_source(spark, sf_dir):
    """A tree of digests: of each thousand ids, of each thousand of these, of the source; no list outgrows what is below it."""
    named = lambda k, d: F.concat(F.lpad(k.cast("string"), 20, "0"), d)
    digest = F.sha2(F.array_join(F.array_sort(F.collect_list("d")), ""), 256)
    files = table(spark, sf_dir, "documents").filter("text is not null").select("source", F.expr("doc_id div 1000").alias("a"), F.expr("doc_id div 1000000").alias("b"), named(F.col("doc_id"), F.sha2("text", 256)).alias("d"))
    low = files.groupBy("source", "a", "b").agg(F.count("*").alias("n"), digest.alias("x")).select("source", "b", "n", named(F.col("a"), F.col("x")).alias("d"))
    middle = low.groupBy("source", "b").agg(F.sum("n").alias("n"), digest.alias("x")).select("source", "n", named(F.col("b"), F.col("x")).alias("d"))
    return middle.groupBy("source").agg(F.sum("n").alias("files"), digest.alias("fileset"))


# ---- releases: item_id % 4 is the rule, item_id // 4 the release -------------------------

_SIG = f"""{_shingles_sql('d', 'documents', 'doc_id')},
{_shingles_sql('r', 'benchmark', 'item_id')},
sig AS (SELECT DISTINCT (item_id % 4)::INT AS rule_id, (item_id // 4)::INT AS version_ix, h FROM r),
rel AS (SELECT rule_id, count(DISTINCT version_ix) AS releases FROM sig GROUP BY 1),
vote AS (SELECT rule_id, h FROM sig JOIN rel USING (rule_id) GROUP BY rule_id, h, releases HAVING count(DISTINCT version_ix) < releases OR releases = 1),
size AS (SELECT rule_id, version_ix, count(*) AS size FROM sig JOIN vote USING (rule_id, h) GROUP BY 1, 2),
voters AS (SELECT doc_id, rule_id, count(*) AS voters FROM d JOIN vote USING (h) GROUP BY 1, 2),
ov AS (SELECT doc_id, rule_id, version_ix, count(*) AS overlap FROM d JOIN sig USING (h) JOIN vote USING (rule_id, h) GROUP BY 1, 2, 3),
sc AS (SELECT doc_id, rule_id, version_ix, coalesce(overlap, 0) AS overlap, size, voters, coalesce(overlap, 0)::DOUBLE / (voters + size - coalesce(overlap, 0)) AS score
  FROM voters JOIN size USING (rule_id) LEFT JOIN ov USING (doc_id, rule_id, version_ix))"""


def _signature(spark, sf_dir):
    items = _items(spark, sf_dir).select((F.col("item_id") % 4).cast("int").alias("rule_id"), F.floor(F.col("item_id") / 4).cast("int").alias("version_ix"), "text")
    return presence.hash_table(items, ["rule_id", "version_ix"], "text", K).distinct()


def _present(spark, sf_dir):
    return presence.hash_table(_docs(spark, sf_dir), ["doc_id"], "text", K)


@register("version_overlap_scores", f"WITH {_SIG} SELECT doc_id, rule_id, version_ix, overlap, size, voters, score FROM sc")
def version_overlap_scores(spark, sf_dir):
    return presence.release_scores(_present(spark, sf_dir), _signature(spark, sf_dir)).select("doc_id", "rule_id", "version_ix", "overlap", "size", "voters", "score")


@register(
    "version_range",
    f"""WITH {_SIG},
top AS (SELECT *, max(score) OVER (PARTITION BY doc_id, rule_id) AS top FROM sc),
best AS (SELECT doc_id, rule_id, min(version_ix) AS best_ix, any_value(top) AS support FROM top WHERE score = top GROUP BY 1, 2),
near AS (SELECT t.doc_id, t.rule_id, t.version_ix, b.best_ix, b.support FROM top t JOIN best b USING (doc_id, rule_id) WHERE score >= top * 0.95),
against AS (SELECT n.doc_id, n.rule_id, n.version_ix FROM near n WHERE n.version_ix <> n.best_ix
  AND (SELECT count(*) FROM sig b JOIN d ON d.h = b.h AND d.doc_id = n.doc_id WHERE b.rule_id = n.rule_id AND b.version_ix = n.best_ix AND NOT EXISTS (SELECT 1 FROM sig o WHERE o.rule_id = n.rule_id AND o.version_ix = n.version_ix AND o.h = b.h))
    >= greatest(3, 0.5 * (SELECT count(*) FROM sig b WHERE b.rule_id = n.rule_id AND b.version_ix = n.best_ix AND NOT EXISTS (SELECT 1 FROM sig o WHERE o.rule_id = n.rule_id AND o.version_ix = n.version_ix AND o.h = b.h)))
  AND NOT EXISTS (SELECT 1 FROM sig o JOIN d ON d.h = o.h AND d.doc_id = n.doc_id WHERE o.rule_id = n.rule_id AND o.version_ix = n.version_ix AND NOT EXISTS (SELECT 1 FROM sig b WHERE b.rule_id = n.rule_id AND b.version_ix = n.best_ix AND b.h = o.h)))
SELECT doc_id, rule_id, best_ix, min(version_ix) AS low_ix, max(version_ix) AS high_ix, any_value(support) AS support
FROM near ANTI JOIN against USING (doc_id, rule_id, version_ix) GROUP BY 1, 2, 3""",
)
def version_range(spark, sf_dir):
    return presence.release_range(_present(spark, sf_dir), _signature(spark, sf_dir))


@register(
    "subset_cover",
    f"""WITH {_SIG},
n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY 1),
held AS (SELECT doc_id, rule_id, count(*) AS held FROM d JOIN (SELECT DISTINCT rule_id, h FROM sig) USING (h) GROUP BY 1, 2),
cov AS (SELECT doc_id, rule_id, version_ix, count(*) AS covered FROM d JOIN sig USING (h) GROUP BY 1, 2, 3)
SELECT doc_id, rule_id, held, n, min(version_ix) AS low_ix, max(version_ix) AS high_ix FROM held JOIN n USING (doc_id) JOIN cov USING (doc_id, rule_id)
WHERE held >= 5 AND held >= 0.02 * n AND covered = held GROUP BY 1, 2, 3, 4""",
)
def subset_cover(spark, sf_dir):
    return presence.subset_cover(presence.counted(_docs(spark, sf_dir), "doc_id", "text", K), _signature(spark, sf_dir), least=5, share=0.02)


# ---- owners: the source of a document -----------------------------------------------------

_OWNED = f"{_shingles_sql('d', 'documents', 'source, lang')}, o AS (SELECT DISTINCT source, h FROM d)"


def _owned(spark, sf_dir):
    return holders.holder_sets(spread(table(spark, sf_dir, "documents").select("source", "text")), "source", None, K)


@register("segmented_hashes", f"WITH {_OWNED} SELECT owners, count(*) AS hashes, sum(h % 1000)::BIGINT AS checksum FROM (SELECT h, count(DISTINCT source) AS owners FROM o GROUP BY 1) GROUP BY 1")
def segmented_hashes(spark, sf_dir):
    sets = _owned(spark, sf_dir).withColumn("owners", F.size(F.array_compact("owners")).cast("long"))
    return sets.groupBy("owners").agg(F.sum("n").alias("hashes"), F.sum("checksum").alias("checksum"))


@register(
    "bundle_pairs",
    f"""WITH {_OWNED}, size AS (SELECT source, count(*) AS n FROM o GROUP BY 1),
held AS (SELECT source, h FROM o WHERE h IN (SELECT h FROM o GROUP BY 1 HAVING count(*) BETWEEN 2 AND 16))
SELECT a.source AS host, b.source AS part, count(*) AS shared, any_value(y.n) AS part_size, any_value(x.n) AS host_size
FROM held a JOIN held b ON a.h = b.h AND a.source <> b.source JOIN size x ON x.source = a.source JOIN size y ON y.source = b.source
GROUP BY 1, 2 HAVING count(*) >= 5 AND count(*) >= 0.001 * any_value(y.n) AND count(*) <= 0.9 * any_value(x.n)""",
)
def bundle_pairs(spark, sf_dir):
    return presence.bundles(holders.holdings(_owned(spark, sf_dir)), "owner", least=5, of_part=0.001, of_host=0.9)
