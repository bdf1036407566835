"""Quality rules: robust multivariate outliers.

Statistics of each whole text are turned into a vector of variance-stabilised
shares and logarithms.  For each language and source a minimum-covariance-
determinant estimate is found: from several starts (medians with absolute
deviations; mean with covariance; covariance of vectors drawn in to the ball that
half of them fill), concentration steps take the share ``core`` of documents with the smallest
Mahalanobis distance and estimate mean and covariance on them; after two steps the start with the least
determinant goes on until that settles.  One reweighting step estimates once more
on all documents within the ``inner`` quantile of the chi-square distribution, and a
document is rejected when its squared distance exceeds the ``outer`` quantile.

Two things keep the distances those of a chi-square variable.  Covariances of
central parts are scaled by the factor that makes them consistent for normal data.  And
shares are counts in short texts: a share over ``m`` words has a standard deviation of about
``1 / (2 sqrt(m))`` after the arcsine, even where most documents of the group have none at all.
The square of that deviation, for the group's median document, is added to the variances.

All steps are aggregates: documents with one vector are first one row
with a weight, quantiles come from counts of narrow bins (so they do not depend on the order of
rows), and only moments of a group meet in one place, never its rows.

Groups of fewer than ``least`` documents are judged by what is left of their
language, that by what is left altogether; if that is fewer, too, nothing is rejected by
distance.  Documents that fail the base rule do not shape an estimate.

Defined cases: a null or empty text has statistics of zero and fails the base
rule; null languages and sources are values of their own; repeated rows and null ids are
documents of their own; documents at the edge of a core (ties) belong to it; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import saved
from tessera.llm.slots import tidy
from tessera.llm.stats import column_counts

CORE = 0.5
LEAST = 50
#: Steps of every start; the best start of a group goes on. Steps end at ``STEPS`` at the latest.
FIRST, STEPS = 2, 20
#: A logarithm of the determinant that falls by less has settled.
SETTLED = 1e-4
INNER, OUTER = 0.975, 0.999
DIMENSION = 7
#: Parts of a group in joins with its estimate.
SALTS = 32
#: Bins for each unit of a coordinate, and of the logarithm of a squared distance.
FINE, DISTANCE_FINE = 10_000, 1_000
_BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_X = [f"x{k}" for k in range(DIMENSION)]


def vector(c: dict[str, np.ndarray]) -> np.ndarray:
    words = np.maximum(c["n_words"], 1)
    chars = np.maximum(c["n_chars"], 1)
    share = lambda a, b: np.arcsin(np.sqrt(np.clip(a / b, 0, 1)))
    return np.stack(
        [
            np.log(np.maximum(c["word_chars"], 1) / words),
            share(c["n_symbols"], words),
            share(c["n_upper"], chars),
            share(c["n_exclaims"] + c["n_alone"], words),
            share(c["n_dup_lines"], np.maximum(c["n_lines"], 1)),
            share(c["n_repeat_words"], words),
            share(c["n_digits"], chars),
        ],
        axis=1,
    ).astype(np.float64)


def noise(words: float, lines: float) -> np.ndarray:
    """Variance of each coordinate from counting alone, in a document of so many words and lines.

    What comes in clumps counts as fewer: repeated words come by two windows of three, digits by numbers.
    """
    words, lines = max(words, 1.0), max(lines, 1.0)
    return 1 / (4 * np.array([words, words, words, words, lines, max(words / 6, 1.0), words]))


def gamma_share(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function, by its series."""
    if x <= 0:
        return 0.0
    term = total = 1 / a
    n = a
    while term > total * 1e-15:
        n += 1
        term *= x / n
        total += term
    return total * math.exp(a * math.log(x) - x - math.lgamma(a))


def chi_square(p: float, d: int = DIMENSION) -> float:
    """The ``p`` quantile of a chi-square variable with ``d`` degrees, by bisection."""
    low, high = 0.0, 10.0 * d + 100
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if gamma_share(d / 2, middle / 2) < p else (low, middle)
    return high


def consistency(share: float, d: int = DIMENSION) -> float:
    """By how much the covariance of the central ``share`` of normal data is too small."""
    return share / gamma_share(d / 2 + 1, chi_square(share, d) / 2)


def measure(batches):
    for b in batches:
        c = column_counts(b.column("text"))
        yield pa.RecordBatch.from_arrays(
            [*(b.column(k) for k in ("doc_id", "lang", "source")), *(pa.array(c[k]) for k in _BASE), pa.array(c["n_lines"]), *(pa.array(x) for x in vector(c).T)],
            ["doc_id", "lang", "source", *_BASE, "n_lines", *_X],
        )
        tidy()


def with_group(rows: DataFrame, table: DataFrame, salt: Column, how: str = "inner") -> DataFrame:
    """``rows`` with their group's row of ``table``; a group is dealt to ``SALTS`` tasks, whatever its share."""
    salted = rows.withColumn("salt", F.pmod(salt, F.lit(SALTS)))
    return salted.join(table.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["grp", "salt"], how).drop("salt")


def reached(rows: DataFrame, by: list[str], bins: dict[str, Column], q: float) -> DataFrame:
    """``by`` and, for each name, the lowest bin at which the weights sum up to the share ``q``."""
    every = rows.select(*by, "weight", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), c.cast("long").alias("bin")) for n, c in bins.items()])).alias("b"))
    counts = every.groupBy(*by, "b.name", "b.bin").agg(F.sum("weight").alias("weight"))
    group = Window.partitionBy(*by, "name")
    sums = counts.select(*by, "name", "bin", F.sum("weight").over(group.orderBy("bin")).alias("sum"), F.sum("weight").over(group).alias("all")).filter(F.col("sum") >= q * F.col("all"))
    return sums.groupBy(*by).agg(*[F.min(F.when(F.col("name") == n, F.col("bin"))).alias(n) for n in bins])


def distance_bin(d: Column) -> Column:
    """Squared distances in steps of one in a thousand."""
    return F.floor(F.log(F.greatest(d, F.lit(1e-12))) * DISTANCE_FINE)


def _squared(mean: str = "mean", precision: str = "precision") -> Column:
    """Squared Mahalanobis distance of x to a group's estimate."""
    d = [F.col(f"x{k}") - F.element_at(mean, k + 1) for k in range(DIMENSION)]
    total = F.lit(0.0)
    for i in range(DIMENSION):
        inner = F.lit(0.0)
        for j in range(DIMENSION):
            inner = inner + d[j] * F.element_at(precision, i * DIMENSION + j + 1)
        total = total + d[i] * inner
    return total


def estimates(batches, factor: float):
    """Mean, precision matrix and logarithm of the determinant of each group from its moments."""
    for b in batches:
        n = b.column("n").to_numpy()
        s = np.stack([b.column(f"s{i}").to_numpy() for i in range(DIMENSION)], axis=1).reshape(-1, DIMENSION)
        q = np.zeros((b.num_rows, DIMENSION, DIMENSION))
        for i in range(DIMENSION):
            for j in range(i, DIMENSION):
                q[:, i, j] = q[:, j, i] = b.column(f"q{i}_{j}").to_numpy()
        mean = s / n[:, None]
        # sums in another order differ in their last bits; estimates are rounded
        cov = np.round(q / n[:, None, None] - mean[:, :, None] * mean[:, None, :], 9) * factor
        floor = zip(b.column("words").to_pylist(), b.column("lines").to_pylist(), strict=True)
        cov = cov + np.array([np.diag(noise(*x)) for x in floor]).reshape(-1, DIMENSION, DIMENSION)
        precision = np.linalg.inv(cov) if b.num_rows else cov
        yield pa.RecordBatch.from_arrays(
            [b.column("grp"), b.column("start"), pa.array(list(np.round(mean, 9)), pa.list_(pa.float64())), pa.array(list(precision.reshape(b.num_rows, -1)), pa.list_(pa.float64())), pa.array(np.round(np.linalg.slogdet(cov)[1], 6) if b.num_rows else np.zeros(0))],
            ["grp", "start", "mean", "precision", "det"],
        )


def moments(rows: DataFrame, size: DataFrame, factor: float = 1.0) -> DataFrame:
    """Estimates from ``rows`` (group, start, weight and x); ``size`` has each group's median words and lines."""
    w = F.col("weight")
    sums = [F.sum(w * F.col(x)).alias(f"s{i}") for i, x in enumerate(_X)]
    sums += [F.sum(w * F.col(_X[i]) * F.col(_X[j])).alias(f"q{i}_{j}") for i in range(DIMENSION) for j in range(i, DIMENSION)]
    return rows.groupBy("grp", "start").agg(F.sum(w).cast("double").alias("n"), *sums).join(size, "grp").mapInArrow(partial(estimates, factor=factor), "grp string, start int, mean array<double>, precision array<double>, det double")


def starts(shaped: DataFrame, size: DataFrame, salt: Column) -> DataFrame:
    """Three estimates for each group to begin with."""
    bins = reached(shaped, ["grp"], {f"m{k}": F.round(F.col(x) * FINE) for k, x in enumerate(_X)}, 0.5)
    middle = saved(bins.select("grp", *[(F.col(f"m{k}") / FINE).alias(f"m{k}") for k in range(DIMENSION)]))
    near = with_group(shaped, middle, salt)
    spread = reached(near, ["grp"], {f"a{k}": F.round(F.abs(F.col(x) - F.col(f"m{k}")) * FINE) for k, x in enumerate(_X)}, 0.5)
    words, lines = F.greatest("words", F.lit(1.0)), F.greatest("lines", F.lit(1.0))
    floor = [1 / (4 * x) for x in (words, words, words, words, lines, F.greatest(words / 6, F.lit(1.0)), words)]
    scale = [F.pow(F.col(f"a{k}") / FINE * 1.4826, 2) + floor[k] for k in range(DIMENSION)]
    middle = saved(middle.join(spread, "grp").join(size, "grp").select("grp", *[f"m{k}" for k in range(DIMENSION)], *[scale[k].alias(f"v{k}") for k in range(DIMENSION)]))
    diagonal = F.array(*[1 / F.col(f"v{i}") if i == j else F.lit(0.0) for i in range(DIMENSION) for j in range(DIMENSION)])
    first = middle.select("grp", F.lit(0).alias("start"), F.array(*[f"m{k}" for k in range(DIMENSION)]).alias("mean"), diagonal.alias("precision"), F.lit(float("inf")).alias("det"))
    # vectors outside the ball of median radius are drawn in to its surface
    radius = F.sqrt(sum((F.pow(F.col(x) - F.col(f"m{k}"), 2) / F.col(f"v{k}") for k, x in enumerate(_X)), F.lit(0.0)))
    drawn = F.least(F.lit(1.0), math.sqrt(chi_square(0.5)) / F.greatest(radius, F.lit(1e-9)))
    inside = with_group(shaped, middle, salt).withColumn("f", drawn).select("grp", "weight", F.lit(2).alias("start"), *[(F.col(f"m{k}") + F.col("f") * (F.col(x) - F.col(f"m{k}"))).alias(x) for k, x in enumerate(_X)])
    both = shaped.select("grp", "weight", F.lit(1).alias("start"), *_X).unionByName(inside)
    return first.unionByName(moments(both, size).withColumn("det", F.lit(float("inf"))))


def concentrated(shaped: DataFrame, found: DataFrame, size: DataFrame, core: float) -> DataFrame:
    """One concentration step of each estimate in ``found``."""
    salt = F.xxhash64(*_X)
    near = with_group(shaped, found.select("grp", "start", "mean", "precision"), salt).select("grp", "start", "weight", distance_bin(_squared()).alias("d"), *_X)
    edge = saved(reached(near, ["grp", "start"], {"edge": F.col("d")}, core)).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    central = near.withColumn("salt", F.pmod(salt, F.lit(SALTS))).join(edge, ["grp", "start", "salt"]).filter("d <= edge")
    return saved(moments(central, size, consistency(core)))


def robust(shaped: DataFrame, size: DataFrame, core: float, steps: int, inner: float) -> DataFrame:
    """``grp, mean, precision`` by minimum covariance determinant, reweighted.

    Each start takes ``FIRST`` steps; the best of a group goes on until its determinant settles, and then leaves the loop.
    """
    salt = F.xxhash64(*_X)
    found = saved(starts(shaped, size, salt))
    for _ in range(FIRST):
        found = concentrated(shaped, found, size, core)
    least = F.min_by(F.struct("start", "mean", "precision", "det"), F.struct("det", "start")).alias("e")
    moving = saved(found.groupBy("grp").agg(least).select("grp", "e.*"))
    settled = []
    for _ in range(steps - FIRST):
        step = concentrated(shaped, moving, size, core)
        judged = saved(step.join(moving.select("grp", F.col("det").alias("last")), "grp").withColumn("moves", F.col("det") < F.col("last") - SETTLED))
        settled.append(judged.filter("not moves").drop("moves", "last"))
        moving = judged.filter("moves").drop("moves", "last")
        if moving.isEmpty():
            break
    for x in settled:
        moving = moving.unionByName(x)
    best = saved(moving.select("grp", F.lit(0).alias("start"), "mean", "precision"))
    near = with_group(shaped, best, salt).filter(_squared() <= chi_square(inner))
    return moments(near, size, consistency(inner)).select("grp", "mean", "precision")


def outliers(docs: DataFrame, core: float = CORE, outer: float = OUTER, inner: float = INNER, least: int = LEAST, steps: int = STEPS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance (squared), kept``."""
    if not 0 < core <= inner < 1:
        raise ValueError("core must be over 0 and at most inner, inner below 1")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{source_col}`").cast("string").alias("source"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    every = saved(rows.mapInArrow(measure, "doc_id long, lang string, source string, " + ", ".join(f"{k} long" for k in (*_BASE, "n_lines")) + ", " + ", ".join(f"{x} double" for x in _X)))
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    every = every.withColumn("base_failed", base_failed)

    # the group of each row: its language and source, what is left of the language, or the rest
    sizes = every.filter("not base_failed").groupBy("lang", "source").count()
    sizes = sizes.withColumn("large", F.col("count") >= least)
    rest = sizes.filter("not large").groupBy(F.col("lang").alias("r_lang")).agg(F.sum("count").alias("rest"))
    own = F.when(F.col("large"), _key(["lang", "source"])).when(F.col("rest") >= least, _key(["lang"])).otherwise("rest")
    groups = saved(sizes.join(rest, F.col("lang").eqNullSafe(F.col("r_lang")), "left").select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), own.alias("grp"), "count"))
    enough = saved(groups.groupBy("grp").agg(F.sum("count").alias("total")).filter(F.col("total") >= least).select("grp"))
    # a hot source is dealt to many tasks; numbers of rows come from files, so they stay when a task runs again
    dealt = every.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    salted = groups.drop("count").withColumn("g_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    grouped = dealt.join(salted, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")) & (F.col("salt") == F.col("g_salt")), "left").drop("g_lang", "g_source", "g_salt")
    grouped = saved(grouped)

    fit = grouped.filter("not base_failed").groupBy("grp", *_X).agg(F.count("*").alias("weight"))
    shaped = saved(fit.join(enough, "grp", "left_semi"))
    counted = grouped.filter("not base_failed").groupBy("grp", "n_words", "n_lines").agg(F.count("*").alias("weight"))
    size = saved(reached(counted, ["grp"], {"words": F.col("n_words"), "lines": F.col("n_lines")}, 0.5).select("grp", F.col("words").cast("double").alias("words"), F.col("lines").cast("double").alias("lines")))
    final = saved(robust(shaped, size, core, steps, inner))
    judged = with_group(grouped, final, F.col("salt"), "left").withColumn("distance", _squared())
    verdict = F.coalesce(F.col("distance") <= chi_square(outer), F.lit(True))
    return judged.select("doc_id", *_BASE, "base_failed", "distance", (~F.col("base_failed") & verdict).alias("kept"))


def _key(columns: Iterable[str]) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def op7_outliers(spark, sf_dir: str) -> DataFrame:
    return outliers(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", *_BASE, "base_failed", "kept")
