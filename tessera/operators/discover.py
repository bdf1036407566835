"""From a table of files to findings: candidate directories, evidence in tiers, versions read from the tree, and what is left unsaid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.bind import let
from tessera.operators.findings import asserted as firm
from tessera.operators.findings import licence_differs
from tessera.operators.graph import settled

# Fixed: files that declare a component, names of licence files, endings of sources.
MANIFESTS = ("package.json", "Cargo.toml", "pyproject.toml", "setup.py", "go.mod", "conanfile.py", "conanfile.txt", "vcpkg.json", "idf_component.yml", "library.json", "library.properties", "module.yml", "pom.xml", "meson.build")
LICENCE_STEMS = ("license", "licence", "licenses", "licences", "unlicense", "copying", "copyright", "notice", "notices", "eula")
CODE_ENDINGS = ("c", "cc", "cpp", "cxx", "h", "hh", "hpp", "inc", "s", "py", "js", "ts", "java", "go", "rs", "sh", "cmake", "json", "png", "svg")
SOURCE_FILE = r"(?i)\.(?:c|cc|cpp|cxx|h|hh|hpp|s)$"
# Fixed: why a directory is a candidate, the strongest sign first.
REASONS = ("markers", "rule-path", "rule-name", "manifest", "license-file", "submodule", "deep")
# Fixed: similarity from which a band begins, its confidence and name; and the confidences of the other tiers.
BANDS = ((0.98, 0.95, "exact"), (0.85, 0.90, "strong"), (0.60, 0.75, "partial"), (0.35, 0.50, "weak"))
ANCHOR, PROBED, NUDGE, CEILING = 0.98, 0.75, 0.02, 0.95
RENAMED_MARGIN = 0.05
DERIVED_LEAST, DERIVED_SHARE, DERIVED = 300, 0.30, 0.50


def licence_file(name: Column) -> Column:
    """Does a file name say that the file is a licence: its first word does, and its ending is not that of code."""
    parts = F.split(F.lower(name), "[^a-z0-9]")
    return F.element_at(parts, 1).isin(*LICENCE_STEMS) & ((F.size(parts) == 1) | ~F.element_at(parts, -1).isin(*CODE_ENDINGS))


# ---- candidates ---------------------------------------------------------------------------------


def _parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: x != "")


def suffixes(path: Column) -> Column:
    """Every ending of a path at a slash, the path itself included: a suffix join becomes an equi-join."""
    return let(_parts(path), lambda p: F.when(F.size(p) > 0, F.transform(F.sequence(F.lit(1), F.size(p)), lambda k: F.array_join(F.slice(p, k, F.size(p)), "/"))).otherwise(F.array().cast("array<string>")))


def candidate_directories(files: DataFrame, rule_paths: DataFrame, rule_names: DataFrame, markers: DataFrame, submodules: DataFrame, deep: bool = False, least_sources: int = 3, max_depth: int = 10) -> DataFrame:
    """``directory, reason`` of directories above ``max_depth`` that show a sign of being a component.

    ``files(path)``, ``rule_paths(suffix)``, ``rule_names(name)``, ``markers(rule_id, marker)`` (all markers of a rule must be
    there), ``submodules(directory)``. Each sign is a join or aggregate of its own; the strongest is reported.
    """
    parts = _parts(F.col("path"))
    file = files.select(F.array_join(parts, "/").alias("path"), F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/").alias("directory"), F.element_at(parts, -1).alias("name")).filter("name is not null")
    depth = F.when(F.col("directory") == "", 0).otherwise(F.size(F.split("directory", "/")))
    there = settled(file.filter(depth < max_depth))
    seen = there.groupBy("directory").agg(F.bool_or(F.col("name").isin(*MANIFESTS)).alias("manifest"), F.bool_or(licence_file(F.col("name"))).alias("licence"), F.count_if(F.col("name").rlike(SOURCE_FILE)).alias("sources"))
    seen = settled(seen)
    signs = seen.select("directory", F.explode(F.array_compact(F.array(F.when(F.col("manifest"), "manifest"), F.when(F.col("licence"), "license-file"), F.when(F.lit(deep) & (F.col("sources") >= least_sources), "deep")))).alias("reason"))
    below = seen.filter("directory <> ''").select("directory")
    by_path = below.withColumn("suffix", F.explode(suffixes(F.col("directory")))).join(rule_paths.select("suffix").distinct(), "suffix").select("directory", F.lit("rule-path").alias("reason"))
    by_name = below.withColumn("name", F.element_at(F.split("directory", "/"), -1)).join(rule_names.select("name").distinct(), "name").select("directory", F.lit("rule-name").alias("reason"))
    by_module = below.join(submodules.select("directory").distinct(), "directory").select("directory", F.lit("submodule").alias("reason"))
    wanted = markers.groupBy("rule_id").agg(F.countDistinct("marker").alias("wanted"))
    ended = there.select("path", F.explode(suffixes(F.col("path"))).alias("marker")).join(markers, "marker")
    base = F.rtrim(F.substr("path", F.lit(1), F.length("path") - F.length("marker")), F.lit("/"))
    held = ended.select("rule_id", base.alias("directory"), "marker").groupBy("rule_id", "directory").agg(F.countDistinct("marker").alias("held"))
    by_marker = held.join(wanted, "rule_id").filter("held = wanted").select("directory", F.lit("markers").alias("reason"))
    every = signs.unionByName(by_path).unionByName(by_name).unionByName(by_module).unionByName(by_marker)
    rank = F.array_position(F.array(*[F.lit(r) for r in REASONS]), F.col("reason"))
    return every.groupBy("directory").agg(F.min_by("reason", rank).alias("reason"))


# ---- evidence -------------------------------------------------------------------------------------


def band(similarity: Column) -> Column:
    """``confidence, name`` of a similarity; 0 and "none" below all bands."""
    out = F.struct(F.lit(0.0).alias("confidence"), F.lit("none").alias("name"))
    for least, confidence, name in reversed(BANDS):
        out = F.when(similarity >= least, F.struct(F.lit(confidence).alias("confidence"), F.lit(name).alias("name"))).otherwise(out)
    return out


def containment(exact: Column, abstract: Column) -> Column:
    """``share, renamed``: bodies without their names count where exact ones fall short of strong and names were changed."""
    renamed = F.coalesce((exact < BANDS[1][0]) & (abstract >= exact + RENAMED_MARGIN), F.lit(False))
    return F.struct(F.when(renamed, abstract).otherwise(exact).alias("share"), renamed.alias("renamed"))


def derivative(matched: Column, present: Column) -> Column:
    """A trimmed and rewritten port: many functions of the component, a fair share of the directory's, but no release."""
    return F.coalesce((matched >= DERIVED_LEAST) & (matched >= DERIVED_SHARE * present), F.lit(False))


def anchored(sketch: Column) -> Column:
    """What a sketch of the tree leaves of an anchor: ``held``, ``demoted`` below the partial band, ``rejected`` below all; held without a sketch."""
    return F.when(sketch.isNull() | (sketch >= BANDS[2][0]), "held").when(sketch >= BANDS[3][0], "demoted").otherwise("rejected")


def with_probe(version: Column, source: Column, probed: Column, recorded: Column) -> Column:
    """``version, source`` after the tree's own version definition has been heard.

    It fills a gap and corrects functions, but for a span whose ends it only shortens; an anchored release gives way only to a
    release that no rule records (``recorded``), and never to a prefix of itself.
    """
    shorter = F.coalesce(F.forall(F.split(version, "~"), lambda v: v.startswith(F.concat(probed, F.lit(".")))), F.lit(False))
    news = (probed != version) & ~version.startswith("git-") & ~shorter & ~F.coalesce(F.array_contains(recorded, probed), F.lit(False))
    taken = probed.isNotNull() & F.when(version.isNull(), True).when(source == "functions", ~shorter).when(source == "anchor", news).otherwise(True)
    return F.struct(F.when(taken, probed).otherwise(version).alias("version"), F.when(taken, "probe").otherwise(source).alias("source"))


def identified(rows: DataFrame) -> DataFrame:
    """``rows`` with ``identity, version, source, band``: the tiers for a directory and a rule, in order.

    ``rows`` has ``anchor`` (release of an anchored file), ``exact`` and ``abstract`` (containment of function bodies), ``functions``
    (release they point to), ``matched, present`` (functions), ``sketch`` (similarity of the tree), ``probed``, ``recorded``, ``manifest``
    (declared version) and ``at_path`` (the rule names the path); nulls where a tier has nothing to say.
    """
    anchor = F.when(F.col("anchor").isNotNull(), anchored(F.col("sketch")))
    share = containment(F.col("exact"), F.col("abstract"))
    first = rows.withColumn("_anchor", anchor).withColumn("_share", share["share"]).withColumn("_function", band(share["share"])).withColumn("_sketch", band(F.col("sketch")))
    derived = derivative(F.col("matched"), F.col("present"))
    fits = F.coalesce(F.col("_function.confidence") > 0, F.lit(False))
    sketched = F.coalesce(F.col("_sketch.confidence") > 0, F.lit(False))
    said = lambda identity, version, source, name: F.struct(identity.alias("identity"), version.alias("version"), F.lit(source).alias("source"), name.alias("band"))
    nothing = F.lit(None).cast("string")
    tier = (
        F.when(F.col("_anchor") == "held", said(F.lit(ANCHOR), F.col("anchor"), "anchor", F.lit("anchor")))
        .when(fits, said(F.col("_function.confidence"), F.col("functions"), "functions", F.col("_function.name")))
        .when(derived, said(F.lit(DERIVED), nothing, "derivative", F.lit("weak")))
        .when(sketched, said(F.col("_sketch.confidence"), F.when(F.col("_anchor") == "demoted", F.col("anchor")), "sketch", F.col("_sketch.name")))
        .when(F.col("manifest").isNotNull(), said(F.lit(PROBED), F.col("manifest"), "manifest", F.lit("declared")))
        .otherwise(said(F.lit(0.0), nothing, "none", F.lit("none")))
    )
    found = first.withColumn("_t", tier)
    heard = with_probe(F.col("_t.version"), F.col("_t.source"), F.col("probed"), F.col("recorded"))
    found = found.withColumn("_v", F.when(F.col("_t.identity") > 0, heard).otherwise(F.struct(F.col("_t.version").alias("version"), F.col("_t.source").alias("source"))))
    weak = (F.col("_t.identity") > 0) & (F.col("_t.identity") < PROBED) & F.col("probed").isNotNull() & ~F.coalesce(F.col("_anchor") == "demoted", F.lit(False))
    identity = F.when(weak, PROBED).otherwise(F.col("_t.identity"))
    nudged = F.when(F.coalesce(F.col("at_path"), F.lit(False)) & (identity > 0) & (identity < CEILING), F.least(identity + NUDGE, F.lit(CEILING))).otherwise(identity)
    return found.select(*rows.columns, F.round(nudged, 4).alias("identity"), F.col("_v.version").alias("version"), F.col("_v.source").alias("source"), F.col("_t.band").alias("band"))


def probe(text: Column, patterns: dict[str, str], template: str) -> Column:
    """A version put together from a file: each named pattern must be found; ``hex_`` names are read as hexadecimal, ``dash_`` ones get a dash."""
    out, rest = [], template
    for name, pattern in patterns.items():
        plain = name.removeprefix("hex_").removeprefix("dash_")
        found = F.when(F.regexp_like(text, F.lit(pattern)), F.regexp_extract(text, pattern, 1))
        if name.startswith("hex_"):
            found = F.conv(F.regexp_replace(found, "^0[xX]", ""), 16, 10)
        elif name.startswith("dash_"):
            found = F.when(found == "", "").otherwise(F.concat(F.lit("-"), found))
        head, mark, rest = rest.partition("{" + plain + "}")
        if not mark:
            raise ValueError(f"the template must use {plain}, in the order of the patterns")
        out += [F.lit(head), found]
    return F.concat(*out, F.lit(rest))


def patched(declared: Column, changed: Column, exact_copy: Column, version: Column, reference: Column) -> Column:
    """Does a copy differ from the release it claims to be: declared so, functions changed, or no exact copy of the release that files are known of."""
    return F.coalesce(declared, F.lit(False)) | F.coalesce(changed > 0, F.lit(False)) | F.coalesce(~exact_copy & (version == reference), F.lit(False))


# ---- what is reported -----------------------------------------------------------------------------


def asserted(findings: DataFrame, possible_below: float) -> DataFrame:
    """``findings`` with ``possible``: those too weak to assert, or of unknown identity; nothing is dropped."""
    return findings.withColumn("possible", F.coalesce(~firm(F.col("identity"), possible_below), F.lit(True)))


#: One rule for licences seen and declared, wherever it is asked for.
licences_differ = licence_differs


def header_counts(headers: DataFrame, by: str, most: int = 8) -> DataFrame:
    """``by, expression, files, rank``: the licences that most files of a component carry. ``headers(by, file, expression)``."""
    counts = headers.groupBy(by, "expression").agg(F.countDistinct("file").alias("files"))
    # one bounded list for each component: expressions are few, whatever the files
    best = counts.groupBy(by).agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("files")).alias("n"), "expression"))), 1, most).alias("best"))
    return best.select(by, F.posexplode("best").alias("p", "x")).select(by, "x.expression", (-F.col("x.n")).alias("files"), (F.col("p") + 1).alias("rank"))


def demoted(state: Column, linked: Column, subsystem: Column, mark_not_affected: bool = False) -> Column:
    """State of a match after the link map: what is not in the image is not exploitable, an umbrella's advisory is for a person to read."""
    open_ = state.isin("exploitable", "in_triage")
    out = F.lit("not_affected") if mark_not_affected else F.lit("in_triage")
    return F.when(open_ & F.coalesce(~linked, F.lit(False)), out).when((state == "exploitable") & F.coalesce(subsystem, F.lit(False)), "in_triage").otherwise(state)


def keyable(purl: Column) -> Column:
    """Does an advisory database file anything under the purl: not under a bare generic name."""
    body = F.regexp_replace(F.regexp_replace(purl, r"^pkg:/*", ""), r"[@?#].*$", "")
    kind, rest = F.substring_index(body, "/", 1), F.substr(body, F.length(F.substring_index(body, "/", 1)) + 2)
    return (rest != "") & ((kind != "generic") | F.contains(rest, F.lit("/")))


def blind_spots(components: DataFrame) -> DataFrame:
    """``components(cpes, purls)`` with ``blind`` (no channel at all), ``name_only`` (no purl that a database knows) and ``without_cpe``."""
    none = lambda c: F.coalesce(F.size(c), F.lit(0)) == 0
    return components.withColumn("blind", none("cpes") & none("purls")).withColumn("name_only", none("cpes") & ~none("purls") & ~F.coalesce(F.exists("purls", keyable), F.lit(False))).withColumn("without_cpe", none("cpes"))
