"""Findings on their way to a report: support of each, what is asserted, gaps, order, licences seen against declared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.licences import alternatives

UNKNOWN = "unknown"


def whole_glob(glob: Column) -> Column:
    """A regular expression for a glob whose ``*`` and ``?`` cross folders."""
    plain = F.regexp_replace(glob, r"([.\\+^$(){}|])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(F.replace(F.replace(plain, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("[!"), F.lit("[^")), F.lit("$"))


def stamped(findings: DataFrame, overrides: DataFrame, rules: DataFrame) -> DataFrame:
    """``id, status, ends, origin`` for each of ``findings(id, rule, name, directory, version)``.

    The first of ``overrides(position, rule, name, directory, version, status, ends)`` that fits decides, then the finding's
    own of ``rules(rule, status, ends)``, else nothing is known. A null field of an override fits anything, names fit
    in any case, directories by glob; a finding without a version has an empty one.
    """
    # null stands for "anything" on the overrides' side, so each finding looks under its sixteen keys: an equi-join.
    # The first folder of a glob, where it is plain, is a key, too, so overrides by directory alone do not meet all findings
    either = lambda c: (c, F.lit(None).cast("string"))
    top = F.substring_index("directory", "/", 1)
    keys = [F.struct(r.alias("r"), n.alias("n"), v.alias("v"), h.alias("h")) for r in either(F.col("rule")) for n in either(F.col("_name")) for v in either(F.col("_version")) for h in either(top)]
    same = ["rule", "_name", "_version", "directory"]
    named = findings.select("id", "rule", F.lower("name").alias("_name"), F.coalesce("version", F.lit("")).alias("_version"), "directory")
    kinds = named.select(*same).distinct().withColumn("kind", F.struct(*same))
    asked = kinds.select("kind", "directory", F.explode(F.array_distinct(F.array(*keys))).alias("key"))
    # of overrides that ask the same only the first can decide: what is met grows with the different ones
    said = overrides.groupBy(F.col("rule").alias("r"), F.lower("name").alias("n"), F.col("version").alias("v"), "directory").agg(F.min_by(F.struct("position", "status", "ends"), "position").alias("said"))
    given = said.select("r", "n", "v", F.when(~top.rlike(r"[*?\[]"), top).alias("h"), whole_glob(F.col("directory")).alias("glob"), "said.position", F.struct("said.status", "said.ends").alias("said"))
    fits = asked["key.r"].eqNullSafe(given["r"]) & asked["key.n"].eqNullSafe(given["n"]) & asked["key.v"].eqNullSafe(given["v"]) & asked["key.h"].eqNullSafe(given["h"])
    first = asked.join(given, fits).filter(F.col("glob").isNull() | F.rlike("directory", F.col("glob"))).groupBy("kind").agg(F.min_by("said", "position").alias("said"))
    own = rules.filter("status is not null").select("rule", F.struct("status", "ends").alias("own"))
    asks = named.select("id", "rule", F.struct(*same).alias("kind"))
    both = asks.join(own, "rule", "left").join(first, asks["kind"].eqNullSafe(first["kind"]), "left")
    found = F.coalesce("said", "own")
    origin = F.when(F.col("said").isNotNull(), "file").when(F.col("own").isNotNull(), "rule").otherwise("none")
    return both.select("id", F.coalesce(found["status"], F.lit(UNKNOWN)).alias("status"), found["ends"].alias("ends"), origin.alias("origin"))


def asserted(identity: Column, below: float) -> Column:
    """Whether a finding is asserted; those under ``below`` are only possible."""
    return identity >= below


def report_counts(findings: DataFrame, by: str, below: float) -> DataFrame:
    """``by, asserted, possible, gaps`` from ``identity`` and ``status``; gaps are asserted findings of unknown support."""
    firm = asserted(F.col("identity"), below)
    return findings.groupBy(by).agg(F.count_if(firm).alias("asserted"), F.count_if(~firm).alias("possible"), F.count_if(firm & (F.col("status") == UNKNOWN)).alias("gaps"))


def ordered(findings: DataFrame, confidence: str = "confidence", directory: str = "directory") -> DataFrame:
    """The surest first, equal ones by directory."""
    return findings.orderBy(F.desc(confidence), F.asc(directory))


def licence_differs(declared: Column, observed: Column) -> Column:
    """Whether a licence was seen that the declared expression does not name; nothing declared or nothing seen says nothing."""
    known = F.transform(F.flatten(alternatives(declared)), F.lower)
    more = F.exists(observed, lambda x: ~F.array_contains(known, F.lower(x)))
    return F.coalesce((F.trim(declared) != "") & more, F.lit(False))
