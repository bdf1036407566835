"""From a table of files to components: where rules meet a tree, what each kind of evidence says there, and the claim that holds.

Evidence is a join for each kind (anchored files, function bodies, sketches, version definitions, declarations, places), with a row for a
directory and a rule; one expression weighs it, and the claims on a directory are ranked. A directory holds all files below it.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.hashing import hash_map, least_batches, marked_batches, shingle_hashes  # noqa: F401 (the last for its users)
from tessera.functions.text import kmv_similarity
from tessera.operators import discover, globs, presence
from tessera.operators.graph import settled
from tessera.operators.resolve import winners

# Fixed: identity of each containment band, and confidence in a version by where it comes from.
CONTAINED = ((presence.STRONG, 0.95, "strong"), (presence.PARTIAL, 0.80, "partial"), (presence.FLOOR, 0.50, "weak"))
VERSION = {"anchor": 0.98, "manifest": 0.90, "probe": 0.85, "functions": 0.88, "signature-reference": 0.70, "anchor-shared": 0.88}
DEMOTED, PLACED = 0.50, 0.02
#: Levels below a directory at which an anchored file of a unique name is still its file.
DEEPEST = 4
PAIR = ["directory", "rule_id"]


def below(files: DataFrame) -> DataFrame:
    """``files(path, ...)`` with a row for each directory above: ``directory``, ``rel`` (the path from there) and ``depth`` (names in it)."""
    parts = F.filter(F.split("path", "/"), lambda x: x != "")
    at = files.withColumn("_s", parts).withColumn("depth", F.explode(F.sequence(F.lit(1), F.greatest(F.size("_s") - 1, F.lit(1))))).filter(F.size("_s") > F.col("depth"))
    cut = F.size("_s") - F.col("depth")
    return at.withColumn("directory", F.array_join(F.slice("_s", 1, cut), "/")).withColumn("rel", F.array_join(F.slice("_s", cut + 1, F.col("depth")), "/")).drop("_s")


# ---- one kind of evidence each ------------------------------------------------------------------


def anchor_hits(files: DataFrame, anchors: DataFrame, deepest: int = DEEPEST) -> DataFrame:
    """``directory, rule_id, anchors``: the releases (``version_ix``, ascending) whose digest the first matching anchored file has.

    ``files(path, sha)``, ``anchors(rule_id, at, path, version_ix, sha)``, ``at`` being the anchor's place in its rule. A file is found at
    the anchor's path, else by its name where only one file within ``deepest`` levels has it. Digests meet by equi-join after that, so a
    name that every directory has costs a row for each directory, not for each rule.
    """
    last = lambda c: F.element_at(F.split(c, "/"), -1)
    wanted = settled(anchors.distinct())
    names = wanted.select(last(F.col("path")).alias("name")).distinct()
    near = settled(below(files.select("path", "sha", last(F.col("path")).alias("name")).join(names, "name", "left_semi")).select("directory", "rel", "name", "depth", "sha"))
    exact = near.join(wanted.withColumnRenamed("path", "rel"), ["rel", "sha"]).select(*PAIR, "at", "version_ix")
    only = near.filter(F.col("depth") <= deepest).groupBy("directory", "name").agg(F.count("*").alias("n"), F.min("sha").alias("sha")).filter("n = 1 and sha is not null")
    loose = only.join(wanted.withColumn("name", last(F.col("path"))), ["name", "sha"]).withColumnRenamed("path", "rel")
    loose = loose.join(near.select("directory", "rel").distinct(), ["directory", "rel"], "left_anti").select(*PAIR, "at", "version_ix")
    met = exact.unionByName(loose).groupBy(*PAIR, "at").agg(F.array_sort(F.collect_set("version_ix")).alias("ix"))
    return met.groupBy(*PAIR).agg(F.min_by("ix", "at").alias("anchors"))


def marked(files: DataFrame, signature: DataFrame, k: int, size: int) -> DataFrame:
    """``path, met, small``: of each file's hashes those that a rule may have (all that one has), and its ``size`` smallest. Texts are hashed once for both.

    A map of the rules' hashes of fixed size goes to the tasks, so that other hashes of a text do not leave the batch that makes them.
    """
    texts = files.select("path", F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    return settled(texts.mapInArrow(partial(marked_batches, k=k, size=size, bits=hash_map(signature)), "path string, met array<long>, small array<long>"))


def function_hits(marks: DataFrame, signature: DataFrame) -> DataFrame:
    """``directory, rule_id, low_ix, high_ix, exact``: the releases that a directory's bodies point to, and how much of the best it holds.

    ``marks`` as ``marked`` gives them, ``signature(rule_id, version_ix, h)`` distinct. Only hashes that some rule has go up to the directories
    above, each once for a directory. Where no hash tells releases apart, the releases are null and all of the rule's hashes count together.
    """
    known = marks.select("path", F.explode("met").alias("h")).join(signature.select("h").distinct(), "h", "left_semi")
    present = settled(below(known).select(F.col("directory").alias("doc_id"), "h").distinct())
    found = settled(presence.release_range(present, signature))
    size = signature.groupBy("rule_id", F.col("version_ix").alias("best_ix")).agg(F.count("*").alias("size"))
    best = found.join(signature.withColumnRenamed("version_ix", "best_ix"), ["rule_id", "best_ix"]).join(present, ["doc_id", "h"]).groupBy("doc_id", "rule_id").agg(F.count("*").alias("held"))
    best = found.join(size, ["rule_id", "best_ix"]).join(best, ["doc_id", "rule_id"], "left").select("doc_id", "rule_id", "low_ix", "high_ix", (F.coalesce("held", F.lit(0)) / F.col("size")).alias("of_best"))
    every = presence.overlaps(present, signature.select("rule_id", "h").distinct(), "doc_id", "rule_id").join(best, ["doc_id", "rule_id"], "left")
    return every.select(F.col("doc_id").alias("directory"), "rule_id", "low_ix", "high_ix", F.coalesce("of_best", F.col("held") / F.col("own")).alias("exact"))


def tree_sketches(marks: DataFrame, size: int) -> DataFrame:
    """``directory, s``: the ``size`` smallest distinct hashes below each directory, ascending.

    Sketches of files, in ``marks`` of at least that size, are merged: a directory keeps as many values of each task's before they are exchanged.
    """
    each = below(marks.filter(F.size("small") > 0).select("path", "small")).select("directory", "small")
    least = lambda df, ordered: df.mapInArrow(partial(least_batches, size=size, ordered=ordered), "directory string, s array<long>")
    return least(least(each, False).repartition("directory").sortWithinPartitions("directory"), True)


def sketch_hits(trees: DataFrame, sketches: DataFrame, pairs: DataFrame, size: int) -> DataFrame:
    """``directory, rule_id, sketch, reference_ix``: the similarity of tree and rule where they share a value, and for ``pairs`` also where they do not.

    ``trees(directory, s)``, ``sketches(rule_id, s, reference_ix)``; rules without a sketch have no row.
    """
    shared = trees.select("directory", F.explode("s").alias("h")).join(sketches.select("rule_id", F.explode("s").alias("h")), "h").select(*PAIR).distinct()
    every = shared.unionByName(pairs.select(*PAIR)).distinct()
    both = every.join(trees, "directory").join(sketches.withColumnRenamed("s", "r"), "rule_id")
    return both.select(*PAIR, kmv_similarity(F.col("s"), F.col("r"), size).alias("sketch"), "reference_ix")


def probe_hits(files: DataFrame, probes: DataFrame) -> DataFrame:
    """``directory, rule_id, probed``: the version that a file of the tree defines.

    ``files(path, text)``, ``probes(rule_id, file, part, lead, pattern)``: ``file`` is a path from the directory, the first group of each
    ``pattern`` follows its ``lead``, in the order of ``part``; all parts must be found. Of several files of a rule the first by name that defines a version counts.
    """
    parts = settled(probes.distinct()).withColumn("name", F.element_at(F.split("file", "/"), -1))
    # a text meets the probes of its name, few as they are, and does not travel; what they read does
    names = F.filter(F.split("path", "/"), lambda x: x != "")
    named = files.select(F.array_join(names, "/").alias("path"), F.element_at(names, -1).alias("name"), "text")
    at = (F.length("path") > F.length("file") + 1) & F.col("path").endswith(F.concat(F.lit("/"), F.col("file")))
    value = F.when(F.regexp_like("text", F.col("pattern")), F.call_function("regexp_extract", F.col("text"), F.col("pattern"), F.lit(1)))
    directory = F.left("path", F.length("path") - F.length("file") - 1).alias("directory")
    said = named.join(parts, "name").filter(at).select(directory, "rule_id", F.col("file").alias("rel"), F.struct("part", F.concat("lead", value).alias("v")).alias("x"))
    whole = said.groupBy(*PAIR, "rel").agg(F.count_if(F.col("x.v").isNull()).alias("missing"), F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["v"]), "").alias("v")).filter("missing = 0")
    return whole.groupBy(*PAIR).agg(F.min_by("v", "rel").alias("probed"))


def place_hits(directories: DataFrame, rules: DataFrame) -> DataFrame:
    """``directory, rule_id, place``: 2 where a glob of the rule ends at the directory, 1 where only its name is the rule's.

    ``rules(rule_id, globs array, ships_as)``; globs meet paths by the index of ``operators.globs``.
    """
    glob = rules.select("rule_id", F.explode("globs").alias("g")).select("rule_id", F.when(F.col("g").startswith("**"), F.col("g")).otherwise(F.concat(F.lit("**/"), F.col("g"))).alias("glob")).distinct()
    at = globs.matched(directories.select(F.col("directory").alias("path")), glob).select(F.col("path").alias("directory"), "rule_id", F.lit(2).alias("place"))
    named = directories.withColumn("ships_as", F.element_at(F.split("directory", "/"), -1)).join(rules.select("rule_id", "ships_as"), "ships_as").select(*PAIR, F.lit(1).alias("place"))
    return at.unionByName(named).groupBy(*PAIR).agg(F.max("place").alias("place"))


# ---- all of it together ---------------------------------------------------------------------------


def _span(low: Column, high: Column) -> Column:
    return F.when(low == high, low).otherwise(F.concat(low, F.lit("~"), high))


def _named(releases: Column, ix: Column) -> Column:
    return F.element_at(F.filter(releases, lambda r: r["ix"] == ix), 1)["version"]


def narrowed(releases: Column, low: Column, high: Column, probed: Column) -> Column:
    """The part of a span that a version definition leaves: releases that are it or begin with it; null if that is none or all."""
    span = F.filter(releases, lambda r: (r["ix"] >= low) & (r["ix"] <= high))
    kept = F.filter(span, lambda r: (r["version"] == probed) | r["version"].startswith(F.concat(probed, F.lit("."))))
    return F.when((low < high) & (F.size(kept) > 0) & (F.size(kept) < F.size(span)), _span(F.element_at(kept, 1)["version"], F.element_at(kept, -1)["version"]))


def judged(rows: DataFrame) -> DataFrame:
    """``rows`` with ``identity, version, source, version_confidence, witnesses``; rows that nothing identifies are left out.

    ``rows`` has ``releases`` (array of ``ix, version``, ascending), ``anchors`` (of ``version_ix``), ``exact, low_ix, high_ix`` (functions),
    ``sketch, reference_ix, exact_copy`` (tree), ``probed``, ``manifest`` (declared version), ``place`` and ``ceiling``; null where a kind has nothing to say.
    A sketch is asked where there are no functions or they say nothing, and then overrules an anchor, which is about one file.
    """
    r, nothing = F.col("releases"), F.lit(None).cast("string")
    state = lambda version, source: F.struct(version.cast("string").alias("version"), source.cast("string").alias("source"))
    n = F.coalesce(F.size("anchors"), F.lit(0))
    shared = F.transform("anchors", lambda ix: _named(r, ix))
    body, said = F.lit(0.0), F.col("exact").isNotNull()
    for least, identity, _ in reversed(CONTAINED):
        body = F.when(said & (F.col("exact") >= least), identity).otherwise(body)
    out = rows.withColumn("_n", n).withColumn("_shared", shared).withColumn("_body", body)
    out = out.withColumn("_i", F.greatest(F.when(F.col("_n") > 0, discover.ANCHOR).otherwise(0.0), F.col("_body")))
    functions = (F.col("_body") > 0) & (F.col("_n") != 1) & F.col("low_ix").isNotNull()
    out = out.withColumn("_v", F.when(F.col("_n") == 1, state(F.col("_shared")[0], F.lit("anchor"))).when(functions, state(_span(_named(r, F.col("low_ix")), _named(r, F.col("high_ix"))), F.lit("functions"))).otherwise(state(nothing, nothing)))
    asked = ~said | (F.col("_i") == 0)
    out = out.withColumn("_sketch", F.when(asked, F.col("sketch"))).withColumn("_copy", asked & F.coalesce("exact_copy", F.lit(False)))
    band = discover.band(F.col("_sketch"))
    out = out.withColumn("_band", band).withColumn("_i", F.greatest("_i", F.col("_band.confidence"), F.when(F.col("_copy"), discover.ANCHOR).otherwise(0.0)))
    pointed = F.col("_v.version").isNull() & (F.col("_band.name") == "exact") & F.col("reference_ix").isNotNull()
    out = out.withColumn("_v", F.when(pointed, state(_named(r, F.col("reference_ix")), F.lit("signature-reference"))).otherwise(F.col("_v")))
    floor, weak = discover.BANDS[3][0], discover.BANDS[2][0]
    out = out.filter(~F.coalesce((F.col("_n") > 0) & (F.col("_sketch") < floor), F.lit(False))).withColumn("_demoted", F.coalesce((F.col("_n") > 0) & (F.col("_sketch") < weak), F.lit(False)))
    out = out.withColumn("_i", F.when(F.col("_demoted"), F.least("_i", F.lit(DEMOTED))).otherwise(F.col("_i"))).withColumn("_v", F.when(F.col("_demoted"), state(nothing, nothing)).otherwise(F.col("_v"))).filter("_i > 0")
    part = F.when(F.col("_v.source") == "functions", narrowed(r, F.col("low_ix"), F.col("high_ix"), F.col("probed")))
    heard = discover.with_probe(F.col("_v.version"), F.col("_v.source"), F.col("probed"), F.transform(r, lambda x: x["version"]))
    out = out.withColumn("_v", F.when(part.isNotNull(), state(part, F.lit("functions"))).otherwise(heard))
    raised = F.col("probed").isNotNull() & ~F.col("_demoted") & (F.col("_i") < discover.PROBED)
    out = out.withColumn("_i", F.when(raised, discover.PROBED).otherwise(F.col("_i")))
    unsettled = (F.col("_n") > 1) & ~F.coalesce(F.array_contains("_shared", F.col("_v.version")), F.lit(False))
    out = out.withColumn("_v", F.when(unsettled, state(_span(F.col("_shared")[0], F.element_at("_shared", -1)), F.lit("anchor-shared"))).otherwise(F.col("_v")))
    declared = F.col("manifest").isNotNull() & (F.col("_v.source").isNull() | (F.col("_v.source") == "signature-reference"))
    out = out.withColumn("_v", F.when(declared, state(F.col("manifest"), F.lit("manifest"))).otherwise(F.col("_v")))
    place = F.coalesce("place", F.lit(0))
    identity = F.round(F.least(F.when(place > 0, F.least(F.col("_i") + PLACED, F.lit(1.0))).otherwise(F.col("_i")), F.coalesce("ceiling", F.lit(1.0))), 3)
    sure = F.lit(0.0)
    for source, confidence in VERSION.items():
        sure = F.when(F.col("_v.source") == source, confidence).otherwise(sure)
    kinds = [(F.col("_n") > 0) | F.col("_copy"), (F.col("_body") > 0) | (F.col("_band.confidence") > 0), F.col("_demoted"), F.col("probed").isNotNull(), F.col("manifest").isNotNull()]
    witnesses = sum((F.coalesce(k, F.lit(False)).cast("int") for k in kinds), F.lit(0))
    kept = [c for c in rows.columns if c not in ("place", "releases")]
    return out.select(*kept, place.alias("place"), identity.alias("identity"), F.col("_v.version").alias("version"), F.col("_v.source").alias("source"), F.round(F.least(sure, identity), 3).alias("version_confidence"), witnesses.alias("witnesses"))


def orderable(version: Column) -> Column:
    """Can a version be set against a range: not a commit's name, with a digit somewhere; both ends of a span."""
    one = lambda v: ~F.lower(v).rlike("^(git|sha|commit)-") & ~(F.lower(v).rlike("^[0-9a-f]{7,40}$") & F.lower(v).rlike("[a-f]")) & v.rlike("[0-9]")
    return F.coalesce(F.forall(F.split(version, "~"), one), F.lit(False))


def resolved(claims: DataFrame, name: str = "name") -> DataFrame:
    """The claim that holds on each ``directory``, with ``alternatives``. ``claims`` are rows of ``judged`` with ``specificity`` and ``name``.

    A rule at home counts for more the narrower it is, elsewhere for less; ``rule_id`` settles what is left.
    """
    special = F.when(F.col("place") > 0, F.col("specificity")).otherwise(-F.col("specificity"))
    order = [F.desc("identity"), F.desc("place"), F.desc("witnesses"), F.desc(F.col("version").isNotNull()), F.desc(orderable(F.col("version"))), F.desc("version_confidence"), special.desc(), F.desc("rule_id")]
    return winners(claims, ["directory"], order, name, "identity")


def scan(files: DataFrame, rules: DataFrame, releases: DataFrame, anchors: DataFrame, signature: DataFrame, sketches: DataFrame, probes: DataFrame, declared: DataFrame, k: int, size: int, candidates: DataFrame | None = None) -> DataFrame:
    """``directory, rule_id, name, identity, version, source, version_confidence, witnesses, place, alternatives``: a tree's components.

    ``files(path, sha, text)``; ``rules(rule_id, name, globs, ships_as, specificity, ceiling)``; ``releases(rule_id, version_ix, version)``;
    ``declared(directory, manifest)``, a row for a directory; the rest as for the kinds of evidence above. ``candidates(directory)`` keeps
    to those, without it any directory can be a component. A place alone is no claim. Paths occur once; null texts and digests meet nothing, and empty
    tables leave their kind without a say. Partial copies, derivatives and abstracted bodies are judged by ``presence`` and ``discover``.
    """
    inside = (lambda hits: hits.join(candidates.select("directory").distinct(), "directory", "left_semi")) if candidates is not None else (lambda hits: hits)
    anchored = settled(inside(anchor_hits(files, anchors)))
    signature = settled(signature.select("rule_id", "version_ix", "h").distinct())
    marks = marked(files, signature, k, size)
    bodies = settled(inside(function_hits(marks, signature)))
    pairs = anchored.select(*PAIR).unionByName(bodies.select(*PAIR)).distinct()
    sketched = settled(inside(sketch_hits(settled(tree_sketches(marks, size)), sketches, pairs, size)))
    every = settled(pairs.unionByName(sketched.filter(F.col("sketch") >= discover.BANDS[3][0]).select(*PAIR)).distinct())
    probed = settled(inside(probe_hits(files, probes)))
    places = settled(place_hits(every.select("directory").distinct(), rules))
    listed = releases.groupBy("rule_id").agg(F.array_sort(F.collect_set(F.struct(F.col("version_ix").alias("ix"), "version"))).alias("releases"))
    rows = every.join(listed, "rule_id", "left").join(rules.select("rule_id", "name", "specificity", "ceiling"), "rule_id")
    for hits, on in ((anchored, PAIR), (bodies, PAIR), (sketched, PAIR), (probed, PAIR), (places, PAIR), (declared.select("directory", "manifest"), ["directory"])):
        rows = rows.join(hits, on, "left")
    # written once, so that the weighing is planned apart from the joins
    claims = judged(settled(rows.withColumn("exact_copy", F.lit(None).cast("boolean"))))
    return resolved(claims.select(*PAIR, "name", "specificity", "place", "identity", "version", "source", "version_confidence", "witnesses")).drop("specificity")
