"""Advisory ranges against components: two channels, three-valued range joins, enrichment and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.versions import facts, in_range, limits, within
from tessera.operators.graph import settled
from tessera.operators.resolve import state_of


def vulnerability_key(id_: Column, aliases: Column) -> Column:
    """The first CVE id among the id and its aliases, else the id."""
    every = F.concat(F.array(id_), F.coalesce(aliases, F.array().cast("array<string>")))
    return F.coalesce(F.try_element_at(F.filter(every, lambda x: F.upper(x).startswith("CVE-")), F.lit(1)), id_)


_BOUNDS = ("introduced", "start_excluding", "fixed", "last_affected")


def range_join(components: DataFrame, ranges: DataFrame, key: str | list[str] = "key") -> DataFrame:
    """Equi-join on the product key; the range is a column, not a join condition, so "cannot tell" survives as null.

    ``components(component, key, version)``, ``ranges(advisory_id, key, introduced, start_excluding, fixed, last_affected)``. Under a key many
    components have one version and many ranges the same bounds: each version meets each bounds once, and verdicts go back to ranges, then to
    components. The last join makes all rows from little input, so its parts are dealt by number: joined by size they would be a few tasks.
    """
    by = [key] if isinstance(key, str) else list(key)
    parsed = components.select(*by, "version").distinct().withColumn("_facts", facts(F.col("version")))
    bounds = ranges.select(*by, *_BOUNDS).distinct().withColumn("_limits", limits(*[F.col(b) for b in _BOUNDS]))
    said = parsed.join(bounds, by).withColumn("verdict", within(F.col("_facts"), F.col("_limits"))).drop("_facts", "_limits")
    met = _alike(ranges, said, [*by, *_BOUNDS], ["version", "verdict"])
    parts = int(components.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = _alike(components.repartition(parts, *by, "version"), met, [*by, "version"], [c for c in met.columns if c not in (*by, "version")])
    return out.select(*by, *[c for c in components.columns if c not in by], *[c for c in ranges.columns if c not in by], "verdict")


def verdicts(pairs: DataFrame) -> DataFrame:
    """``pairs(version, introduced, start_excluding, fixed, last_affected, ...)`` with ``verdict``.

    For pairs under many small keys, where a key has little twice but all keys have the same versions and bounds: each version and each bounds are parsed
    once and compared once, whatever keys they meet under. ``pairs`` is computed twice, once for that.
    """
    on = ["version", *_BOUNDS]
    met = settled(pairs.select(*on).distinct())
    parsed = settled(met.select("version").distinct()).withColumn("_facts", facts(F.col("version")))
    bounds = settled(met.select(*_BOUNDS).distinct()).withColumn("_limits", limits(*[F.col(b) for b in _BOUNDS]))
    said = _alike(_alike(met, parsed, ["version"], ["_facts"]), bounds, list(_BOUNDS), ["_limits"])
    said = settled(said.select(*on, within(F.col("_facts"), F.col("_limits")).alias("verdict")))
    return _alike(pairs, said, on, ["verdict"])


def _alike(left: DataFrame, right: DataFrame, on: list[str], more: list[str]) -> DataFrame:
    """``left`` with the columns ``more`` of the rows of ``right`` that are the same in ``on``, nulls included."""
    right = right.select(*[F.col(c).alias(f"_on{k}") for k, c in enumerate(on)], *more)
    same = F.lit(True)
    for k, c in enumerate(on):
        same = same & left[c].eqNullSafe(right[f"_on{k}"])
    return left.join(right, same).drop(*[f"_on{k}" for k in range(len(on))])


def matched(components: DataFrame, ranges: DataFrame, channel: str | None = None) -> DataFrame:
    """``vuln_key, component, channel, state, authoritative, unplaced`` for each range that a component meets; without ``channel`` both sides have it as a column."""
    rows = range_join(components, ranges, "key" if channel else ["channel", "key"])
    by = F.lit(channel).alias("channel") if channel else F.col("channel")
    return rows.select("vuln_key", "component", by, state_of(F.col("verdict"), F.col("distro"), F.col("fork")).alias("state"), F.lit(False).alias("authoritative"), F.col("verdict").isNull().alias("unplaced"))


def numeric_verdict(x: Column, low: Column, high: Column) -> Column:
    """Half-open ``[low, high)``; a null bound is open, both null or a null value cannot tell."""
    return F.when(x.isNull() | (low.isNull() & high.isNull()), F.lit(None).cast("boolean")).otherwise(F.coalesce(x >= low, F.lit(True)) & F.coalesce(x < high, F.lit(True)))


def alias_classes(aliases: DataFrame) -> DataFrame:
    """``key, class`` where ``aliases(class, key)`` names a key under one class; keys of several classes are dropped."""
    return aliases.groupBy("key").agg(F.min("class").alias("class"), F.countDistinct("class").alias("n")).filter("n = 1").drop("n")


def first_hit(rows: DataFrame, id_: str, ids: Column, facts: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Left join on the first of an ordered list of ids that ``facts`` has."""
    wide = rows.select(id_, F.posexplode(ids).alias("_pos", key))
    found = wide.join(facts, key).groupBy(id_).agg(*[F.min_by(v, "_pos").alias(v) for v in values])
    return rows.join(found, id_, "left")


def coverage(matches: DataFrame, by: list[str]) -> DataFrame:
    """Per vulnerability, by which channel it was reached, then counted: ``by, n, by_cpe, by_purl, by_both, only_purl``."""
    per = matches.groupBy(*by, "vuln_key").agg(F.bool_or(F.col("channel") == "cpe").alias("cpe"), F.bool_or(F.col("channel") == "purl").alias("purl"))
    return per.groupBy(*by).agg(F.count("*").alias("n"), F.count_if("cpe").alias("by_cpe"), F.count_if("purl").alias("by_purl"), F.count_if(F.col("cpe") & F.col("purl")).alias("by_both"), F.count_if(~F.col("cpe") & F.col("purl")).alias("only_purl"))


def upsert(old: DataFrame, new: DataFrame, key: str, stamp: str) -> DataFrame:
    """Feed refresh: per key the row fetched last; of equal stamps the new one."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    fields = [c for c in both.columns if c not in (key, "_new")]
    return both.groupBy(key).agg(F.max_by(F.struct(*fields), F.struct(stamp, "_new")).alias("x")).select(key, "x.*")


def cn_enriched(matches: DataFrame, entries: DataFrame) -> DataFrame:
    """Matches with the Chinese entry of their CVE, and whether its severity says otherwise.

    ``matches(vuln_key, severity, ...)``, ``entries(cn_id, cve, severity_cn)`` with severities in one vocabulary.
    """
    first = entries.filter("cve is not null").groupBy(F.col("cve").alias("vuln_key")).agg(F.min_by(F.struct("cn_id", "severity_cn"), "cn_id").alias("cn"))
    joined = matches.join(first, "vuln_key", "left")
    return joined.withColumn("cn_id", F.col("cn.cn_id")).withColumn("severity_disagrees", F.col("cn.severity_cn") != F.col("severity")).drop("cn")


def cn_candidates(components: DataFrame, entries: DataFrame, least: int = 3) -> DataFrame:
    """``component, cn_id``: entries without a CVE that name a component as a word; for a person to look at.

    An equi-join on words: each title is split once, so there is no cross join of titles and names.
    """
    words = entries.filter("cve is null").select("cn_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("title"), F.lit("[a-z0-9][a-z0-9_.+-]*"), F.lit(0)))).alias("word"))
    named = components.select("component", F.lower("component").alias("word")).filter(F.length("word") >= least)
    return named.join(words, "word").select("component", "cn_id").distinct()


def cpe_evidence(references: DataFrame, components: DataFrame) -> DataFrame:
    """``component, cpe, strength, n``: CPE names whose advisories cite a component's repository (strong) or whose product is its name (weak).

    ``references(cpe, url)``, ``components(component, repository)``.
    """
    key = lambda c: F.lower(F.regexp_extract(c, r"^[a-z+]+://(?:www\.)?([^/?#]+/[^/?#]+/[^/?#]+?)(?:\.git)?(?:[/?#].*)?$", 1))
    cited = references.select("cpe", key(F.col("url")).alias("repo")).filter("repo <> ''").join(components.select("component", key(F.col("repository")).alias("repo")).filter("repo <> ''"), "repo")
    strong = cited.groupBy("component", "cpe").agg(F.count("*").alias("n")).withColumn("strength", F.lit("strong"))
    product = F.lower(F.try_element_at(F.split("cpe", r"(?<!\\):"), F.lit(5)))
    weak = references.select("cpe").distinct().withColumn("name", product).join(components.select("component", F.lower("component").alias("name")), "name").select("component", "cpe", F.lit(1).cast("long").alias("n"), F.lit("weak").alias("strength"))
    return strong.unionByName(weak.join(strong, ["component", "cpe"], "left_anti"))


def capabilities(components: DataFrame, table: DataFrame) -> DataFrame:
    """Library capabilities whose release span has the component's version: ``component, capability, verdict`` (null: cannot tell)."""
    none = F.lit(None).cast("string")
    joined = components.join(table, "rule_id")
    return joined.select("component", "capability", F.when(F.col("since").isNull() & F.col("until").isNull(), F.lit(True)).otherwise(in_range(F.col("version"), F.col("since"), none, F.col("until"), none)).alias("verdict"))
