"""Which reference sets a document holds, how much of each, and which release it is."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.hashing import set_batches
from tessera.operators.graph import settled

# Fixed: containment bands and the confidence of each.
STRONG, PARTIAL, FLOOR = 0.80, 0.50, 0.20


def _hashed(df: DataFrame, keys: list[str], text: str, k: int) -> DataFrame:
    """``keys, n, hs``: a map over batches, as Spark would make the hashes of a column once more for the filter that it puts before an explode,
    and a column's batches hold 10,000 texts with all their hashes."""
    texts = df.select(*keys, F.lower(F.coalesce(text, F.lit(""))).alias("_text"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields[:-1]]
    return texts.mapInArrow(partial(set_batches, k=k), ", ".join([*kinds, "n long", "hs array<long>"]))


def hash_table(df: DataFrame, keys: list[str], text: str, k: int) -> DataFrame:
    """``keys, h``: the distinct ``k``-word shingle hashes of each row; a key is a row each time it occurs."""
    return _hashed(df, keys, text, k).select(*keys, F.explode("hs").alias("h"))


def counted(df: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """``key, n, h``: as ``hash_table``, with how many hashes the row has."""
    return _hashed(df, [key], text, k).select(key, "n", F.explode("hs").alias("h"))


def overlaps(present: DataFrame, reference: DataFrame, doc: str, owner: str) -> DataFrame:
    """``doc, owner, held, own``: how many of the owner's distinct hashes each document holds; rows of both sides are distinct.

    Only hashes that both sides have are paired, so cost follows the matches.
    """
    own = reference.groupBy(owner).agg(F.count("*").alias("own"))
    return present.join(reference, "h").groupBy(doc, owner).agg(F.count("*").alias("held")).join(own, owner).select(doc, owner, "held", "own")


def band(containment: Column) -> Column:
    return F.when(containment >= STRONG, "strong").when(containment >= PARTIAL, "partial").when(containment >= FLOOR, "weak").otherwise("below")


def best(scored: DataFrame, by: str, order: list[Column]) -> DataFrame:
    """The first row of each ``by`` in ``order``, which ends in a unique key."""
    w = Window.partitionBy(by).orderBy(*order)
    return scored.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def containment_best(docs: DataFrame, items: DataFrame, k: int = 4, floor: float = FLOOR) -> DataFrame:
    """``doc_id, item_id, held, own, containment, band``: the reference passage that each document holds most of."""
    present, reference = hash_table(docs, ["doc_id"], "text", k), hash_table(items, ["item_id"], "text", k)
    pairs = overlaps(present, reference, "doc_id", "item_id").withColumn("containment", F.col("held") / F.col("own"))
    return best(pairs.filter(F.col("containment") >= floor), "doc_id", [F.desc("containment"), F.desc("held"), F.asc("item_id")]).withColumn("band", band(F.col("containment")))


#: Releases in one bitmap.
BITS = 64


def release_bitmaps(signature: DataFrame) -> DataFrame:
    """``rule_id, h, word, bits``: in which releases of a rule a hash is, bit ``version_ix % 64`` of bitmap ``version_ix // 64``."""
    marks = signature.select("rule_id", "h", F.expr(f"cast(version_ix div {BITS} as int)").alias("word"), F.expr(f"cast(version_ix % {BITS} as int)").alias("at"))
    return marks.groupBy("rule_id", "h", "word").agg(F.expr("bit_or(shiftleft(1L, at))").alias("bits"))


def newest(signature: DataFrame, releases: int = BITS) -> DataFrame:
    """The rows of the newest ``releases`` of each rule, which one bitmap can tell apart: older ones rarely ship."""
    known = signature.select("rule_id", "version_ix").distinct()
    kept = known.withColumn("n", F.row_number().over(Window.partitionBy("rule_id").orderBy(F.desc("version_ix")))).filter(F.col("n") <= releases).drop("n")
    return signature.join(kept, ["rule_id", "version_ix"], "left_semi")


def _by_release(counts: DataFrame, name: str) -> DataFrame:
    """Counts of distinct bitmaps as counts of releases."""
    keys = [c for c in counts.columns if c not in ("word", "bits", name)]
    at = F.explode(F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.getbit("bits", i) == 1))
    return counts.select(*keys, "word", name, at.alias("at")).groupBy(*keys, (F.col("word") * BITS + F.col("at")).alias("version_ix")).agg(F.sum(name).alias(name))


def release_scores(present: DataFrame, signature: DataFrame) -> DataFrame:
    """``doc_id, rule_id, version_ix, overlap, size, voters, score``.

    ``present(doc_id, h)``, ``signature(rule_id, version_ix, h)``.  Only hashes that not all
    releases of a rule share vote (all, where a rule has one release); the score is
    the Jaccard similarity over voters.  Releases share most of their bitmaps, so hashes are counted by distinct
    bitmap, before and after the exchange, and spread over releases last.
    """
    releases = signature.groupBy("rule_id").agg(F.countDistinct("version_ix").alias("releases"))
    maps = release_bitmaps(signature)
    spread = maps.groupBy("rule_id", "h").agg(F.sum(F.bit_count("bits")).alias("in_releases")).join(releases, "rule_id")
    voting = spread.filter((F.col("in_releases") < F.col("releases")) | (F.col("releases") == 1)).select("rule_id", "h")
    marked = maps.join(voting, ["rule_id", "h"], "left_semi")
    size = _by_release(marked.groupBy("rule_id", "word", "bits").agg(F.count("*").alias("size")), "size")
    held = present.join(marked, "h").groupBy("doc_id", "rule_id", "word", "bits").agg(F.count("*").alias("overlap"))
    overlap = _by_release(held, "overlap")
    voters = present.join(voting, "h").groupBy("doc_id", "rule_id").agg(F.count("*").alias("voters"))
    every = voters.join(size, "rule_id").join(overlap, ["doc_id", "rule_id", "version_ix"], "left").withColumn("overlap", F.coalesce("overlap", F.lit(0)))
    return every.withColumn("score", F.col("overlap") / (F.col("voters") + F.col("size") - F.col("overlap")))


def release_range(present: DataFrame, signature: DataFrame, margin: float = 0.95, least: int = 3, share: float = 0.5) -> DataFrame:
    """``doc_id, rule_id, best_ix, low_ix, high_ix, support``.

    The range is every release that scores within ``margin`` of the best, but for those the document takes
    sides against: it holds ``least`` and ``share`` of what only the best has, and nothing that only the other has.
    """
    signature = settled(signature)
    # only hashes that the reference has matter: filtered once, then used by every step
    present = settled(present.join(signature.select("h").distinct(), "h", "left_semi"))
    scores = release_scores(present, signature)
    w = Window.partitionBy("doc_id", "rule_id")
    scores = settled(scores.select("doc_id", "rule_id", "version_ix", "score", F.max("score").over(w).alias("top")))
    first = scores.filter("score = top").groupBy("doc_id", "rule_id").agg(F.min("version_ix").alias("best_ix"), F.first("top").alias("support"))
    near = scores.filter(F.col("score") >= F.col("top") * margin).select("doc_id", "rule_id", "version_ix").join(first, ["doc_id", "rule_id"])
    near = settled(near)
    # what the best and another release have apart
    b, o = signature.alias("b"), signature.alias("o")
    pairs = near.filter("version_ix <> best_ix").select("rule_id", "best_ix", "version_ix").distinct()
    only_best = pairs.join(b, (F.col("b.rule_id") == pairs["rule_id"]) & (F.col("b.version_ix") == F.col("best_ix"))).select(pairs["rule_id"], "best_ix", pairs["version_ix"].alias("other"), F.col("b.h").alias("h"))
    only_best = only_best.join(o.select(F.col("o.rule_id").alias("rule_id"), F.col("o.version_ix").alias("other"), F.col("o.h").alias("h")), ["rule_id", "other", "h"], "left_anti")
    only_other = pairs.join(o, (F.col("o.rule_id") == pairs["rule_id"]) & (F.col("o.version_ix") == pairs["version_ix"])).select(pairs["rule_id"], "best_ix", pairs["version_ix"].alias("other"), F.col("o.h").alias("h"))
    only_other = only_other.join(b.select(F.col("b.rule_id").alias("rule_id"), F.col("b.version_ix").alias("best_ix"), F.col("b.h").alias("h")), ["rule_id", "best_ix", "h"], "left_anti")
    total = only_best.groupBy("rule_id", "best_ix", "other").agg(F.count("*").alias("only_best"))
    rivals = near.filter("version_ix <> best_ix").select("doc_id", "rule_id", "best_ix", F.col("version_ix").alias("other"))
    held = rivals.join(only_best, ["rule_id", "best_ix", "other"]).join(present, ["doc_id", "h"]).groupBy("doc_id", "rule_id", "best_ix", "other").agg(F.count("*").alias("held"))
    foreign = rivals.join(only_other, ["rule_id", "best_ix", "other"]).join(present, ["doc_id", "h"]).select("doc_id", "rule_id", "best_ix", "other").distinct()
    against = held.join(total, ["rule_id", "best_ix", "other"]).filter((F.col("held") >= least) & (F.col("held") >= share * F.col("only_best"))).join(foreign, ["doc_id", "rule_id", "best_ix", "other"], "left_anti")
    kept = near.join(against.select("doc_id", "rule_id", F.col("other").alias("version_ix")), ["doc_id", "rule_id", "version_ix"], "left_anti")
    return kept.groupBy("doc_id", "rule_id", "best_ix").agg(F.min("version_ix").alias("low_ix"), F.max("version_ix").alias("high_ix"), F.first("support").alias("support"))


def subset_cover(present: DataFrame, signature: DataFrame, least: int = 40, share: float = 0.90) -> DataFrame:
    """``doc_id, rule_id, held, n, low_ix, high_ix``: documents made of one rule's hashes, and the releases that hold all of them.

    ``present`` as of ``counted``: hashes are made once, and only those that a rule has are kept.
    """
    met = settled(present.join(signature, "h").select("doc_id", "n", "rule_id", "version_ix", "h"))
    held = met.select("doc_id", "n", "rule_id", "h").distinct().groupBy("doc_id", "n", "rule_id").agg(F.count("*").alias("held")).filter((F.col("held") >= least) & (F.col("held") >= share * F.col("n")))
    cover = met.groupBy("doc_id", "rule_id", "version_ix").agg(F.count("*").alias("covered"))
    return held.join(cover, ["doc_id", "rule_id"]).filter("covered = held").groupBy("doc_id", "rule_id", "held", "n").agg(F.min("version_ix").alias("low_ix"), F.max("version_ix").alias("high_ix"))


def owners(table: DataFrame, owner: str) -> DataFrame:
    """``h, owners, owner``: how many owners a hash has; the owner where it is one. Rows of ``table`` are distinct and their owners known."""
    return table.groupBy("h").agg(F.count(owner).alias("owners"), F.when(F.count(owner) == 1, F.min(owner)).alias("owner"))


def bundles(table: DataFrame, owner: str, least: int = 40, of_part: float = 0.80, of_host: float = 0.10, most_owners: int = 16) -> DataFrame:
    """``host, part, shared, part_size, host_size``: owners whose hashes lie, mostly and as a small share, inside another's.

    Hashes of more than ``most_owners`` owners are everybody's and join nothing, which also bounds the pairs of a hash. With a column
    ``w``, ``h`` stands for that many hashes of the same owners.
    """
    table = table if "w" in table.columns else table.withColumn("w", F.lit(1))
    size = table.groupBy(owner).agg(F.sum("w").alias("n"))
    held = table.join(table.groupBy("h").agg(F.count("*").alias("c")).filter((F.col("c") > 1) & (F.col("c") <= most_owners)).select("h"), "h")
    a, b = held.select("h", "w", F.col(owner).alias("host")), held.select("h", F.col(owner).alias("part"))
    pairs = a.join(b, "h").filter("host <> part").groupBy("host", "part").agg(F.sum("w").alias("shared"))
    pairs = pairs.join(size.select(F.col(owner).alias("host"), F.col("n").alias("host_size")), "host").join(size.select(F.col(owner).alias("part"), F.col("n").alias("part_size")), "part")
    return pairs.filter((F.col("shared") >= least) & (F.col("shared") >= of_part * F.col("part_size")) & (F.col("shared") <= of_host * F.col("host_size"))).select("host", "part", "shared", "part_size", "host_size")
