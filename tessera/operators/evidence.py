"""Evidence that rules, declarations and trees give: rule sets in layers, anchored files, macros, declared models, records of patches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.findings import whole_glob

RULE = (
    "id string, component struct<path_globs:array<string>,ships_as:string>, "
    "upstream struct<name:string,purl:string,cpe:string,license:string,supplier:string,source:struct<kind:string,url:string,ref:string>>, "
    "identity struct<include:array<string>,anchors:array<struct<path:string,sha256:map<string,string>>>>, "
    "version struct<probes:array<struct<file:string,patterns:map<string,string>,template:string>>>"
)


def read_rules(spark: SparkSession, roots: list[str]) -> DataFrame:
    """Rules of JSON files (one object or a list each) of all ``roots``; of rules of one id that of the last root counts.

    Inside a root, the last file by name counts. Rules without an id are left out; without roots there are no rules.
    """
    layers = None
    for k, root in enumerate(roots):
        layer = spark.read.schema(RULE).json(root, multiLine=True).withColumn("_at", F.struct(F.lit(k).alias("root"), F.col("_metadata.file_path").alias("file")))
        layers = layer if layers is None else layers.unionByName(layer)
    return overlaid(layers, "id", "_at") if layers is not None else spark.createDataFrame([], RULE)


def overlaid(rows: DataFrame, key: str, layer: str) -> DataFrame:
    """Per key the row of the greatest ``layer``; rows of one layer that differ are settled by their content, so that the result is stable."""
    fields = [c for c in rows.columns if c not in (key, layer)]
    best = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*fields), F.struct(layer, F.to_json(F.struct(*fields)).alias("content"))).alias("x"))
    return best.select(key, "x.*")


def anchors(rules: DataFrame) -> DataFrame:
    """``rule, path, release, sha`` of the anchored files of rules."""
    a = rules.select(F.col("id").alias("rule"), F.explode("identity.anchors").alias("a"))
    return a.select("rule", "a.path", F.explode("a.sha256").alias("release", "sha")).withColumn("sha", F.lower("sha"))


def anchored_releases(files: DataFrame, anchors: DataFrame) -> DataFrame:
    """``root, rule, path, releases, version``: releases whose anchored file has the digest of the file found.

    ``files(root, path, sha)``, ``anchors(rule, path, release, sha)``; paths are relative to the root. One release is a point, several are a
    span and leave ``version`` null. Files without a digest meet nothing.
    """
    met = files.filter("sha is not null").select("root", "path", F.lower("sha").alias("sha")).distinct().join(anchors, ["path", "sha"])
    spans = met.groupBy("root", "rule", "path").agg(F.array_sort(F.collect_set("release")).alias("releases"))
    return spans.withColumn("version", F.when(F.size("releases") == 1, F.col("releases")[0]))


_DEFINE = r"^[ \t]*#[ \t]*define[ \t]+([A-Za-z_][A-Za-z0-9_]*)(?![A-Za-z0-9_(])(.*)$"
_UNDEFINE = r"^[ \t]*#[ \t]*undef[ \t]+([A-Za-z_][A-Za-z0-9_]*)"


def harvested_macros(files: DataFrame) -> DataFrame:
    """``name, value, certain``: macros that ``files(path, text)`` define.

    A macro of one value everywhere is certain; one that is defined differently, or undefined somewhere, may have any value (null). A name
    without a value is 1, as on a command line. Macros with parameters are left out; comments and continued lines are resolved first.
    """
    whole = F.regexp_replace(F.regexp_replace("text", r"\\\r?\n", " "), r"(?s)/\*.*?\*/|//[^\n]*", " ")
    line = files.select(F.explode(F.split(whole, r"\r?\n")).alias("line"))
    name = F.coalesce(F.nullif(F.regexp_extract("line", _DEFINE, 1), F.lit("")), F.nullif(F.regexp_extract("line", _UNDEFINE, 1), F.lit("")))
    gone = F.regexp_like("line", F.lit(_UNDEFINE))
    value = F.trim(F.regexp_replace(F.regexp_extract("line", _DEFINE, 2), r"\s+", " "))
    said = line.filter(F.contains("line", F.lit("#"))).select(name.alias("name"), gone.alias("gone"), F.when(~gone, F.when(value == "", "1").otherwise(value)).alias("value")).filter("name is not null")
    # equal definitions meet before the shuffle: least and greatest tell whether there is one value
    per = said.groupBy("name").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.bool_or("gone").alias("gone"))
    certain = (F.col("low") == F.col("high")) & ~F.col("gone")
    return per.select("name", F.when(certain, F.col("low")).alias("value"), F.coalesce(certain, F.lit(False)).alias("certain"))


def declared_models(models: DataFrame, declarations: DataFrame) -> DataFrame:
    """``models(path, sha256, ...)`` with the declaration that fits best: ``name, version, licence, declared_by`` (``sha256``, ``path`` or null).

    ``declarations(position, glob, sha256, name, version, licence)``: a digest goes before a glob, then the first in the file counts. A glob's
    ``*`` and ``?`` cross folders; globs are tried against distinct paths.
    """
    said = F.struct("name", "version", "licence")
    by_sha = declarations.filter("sha256 is not null").groupBy(F.lower("sha256").alias("_sha")).agg(F.min_by(said, "position").alias("_exact"))
    # the folders before a glob's first wildcard are an equi-join with the folders of the path
    folder = F.regexp_extract("glob", r"^((?:[^*?\[/]*/)*)", 1)
    globs = declarations.filter("glob is not null and sha256 is null").select("position", folder.alias("_folder"), whole_glob(F.col("glob")).alias("_like"), said.alias("_said"))
    names = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(0), F.size(names) - 1), lambda k: F.when(k == 0, "").otherwise(F.concat(F.array_join(F.slice(names, 1, k), "/"), F.lit("/"))))
    paths = models.select("path").filter("path is not null").distinct().select("path", F.explode(folders).alias("_folder"))
    by_path = paths.join(globs, "_folder").filter(F.expr("path rlike _like")).groupBy("path").agg(F.min_by("_said", "position").alias("_loose"))
    found = models.withColumn("_sha", F.lower("sha256")).join(by_sha, "_sha", "left").join(by_path, "path", "left")
    best = F.coalesce("_exact", "_loose")
    by = F.when(F.col("_exact").isNotNull(), "sha256").when(F.col("_loose").isNotNull(), "path")
    return found.select(*models.columns, best["name"].alias("name"), best["version"].alias("version"), best["licence"].alias("licence"), by.alias("declared_by"))


MOST_FUNCTIONS = 40  # the rule's own bound: a patch that touches more says nothing about a single fault


def patch_records(before: DataFrame, after: DataFrame, by: list[str], most: int = MOST_FUNCTIONS) -> DataFrame:
    """``by, path, name, hole, fixed, hole_abstract, fixed_abstract``: the functions that a patch changes, with their bodies' digests.

    Both sides are ``(by, path, name, exact, abstract)`` as functions are extracted. Added functions have no hole and removed ones no fix; where a
    path defines a name more than once (branches of conditionals), the sides are compared as sets. Patches of over ``most`` functions make no record.
    """
    key = [*by, "path", "name"]
    side = lambda df, exact, loose: df.groupBy(*key).agg(F.array_sort(F.collect_set("exact")).alias(exact), F.array_sort(F.collect_set("abstract")).alias(loose))
    both = side(before, "hole", "hole_abstract").join(side(after, "fixed", "fixed_abstract"), key, "full_outer")
    changed = both.filter(~F.col("hole").eqNullSafe(F.col("fixed")))
    small = changed.groupBy(*by).agg(F.count("*").alias("_n")).filter(F.col("_n") <= most).drop("_n")
    return changed.join(small, by, "left_semi")
