"""Quality classifier: Bradley-Terry pairwise ranking.

A document's strength is a weighted sum of statistics of its whole text.  The weights
come from preference pairs (a document labelled 1 over one labelled 0) by
logistic loss on the differences of their statistics; then a quantile of the
scores, the share of label 0 among the labelled documents, becomes the threshold.

The classifier is fitted on a bounded sample of labelled rows (``most`` of them,
lowest hash of the id first) and of their pairs (``pairs`` at most, ``rounds`` for each document of the
more frequent label), on the driver; scoring is a map without a shuffle.

Defined cases: null and empty texts have statistics of zero and are scored like
any text; labels with a null id or value, or that contradict each other, are not learned
from; of rows that repeat a labelled id those statistics that sort first are learned from; without labels of both kinds
every score is ``cut``; a score equal to ``cut`` passes, so ties at the threshold pass together; repeated rows and
null ids are scored each by its text; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.slots import tidy
from tessera.llm.stats import column_counts

MOST = 20_000
PAIRS = 200_000
ROUNDS = 32
CUT = 0.7


def features(c: dict[str, np.ndarray]) -> np.ndarray:
    words = np.maximum(c["n_words"], 1)
    chars = np.maximum(c["n_chars"], 1)
    share = lambda a, b: np.arcsin(np.sqrt(np.clip(a / b, 0, 1)))
    log_words = np.log1p(c["n_words"])
    repeat = share(c["n_repeat_words"], words)
    columns = [
        log_words,
        log_words**2,
        np.log1p(c["word_chars"] / words),
        share(c["n_symbols"], words),
        share(c["n_symbols"], chars),
        share(c["n_upper"], chars),
        share(c["n_digits"], chars),
        share(c["n_marks"], chars),
        share(c["n_exclaims"], words),
        share(c["n_alone"], words),
        share(c["n_dup_lines"], np.maximum(c["n_lines"], 1)),
        share(c["n_distinct_words"], words),
        repeat,
        repeat * log_words,
        np.log1p(words / np.maximum(c["n_lines"], 1)),
        (c["n_words"] == 0).astype(float),
    ]
    return np.stack(columns, axis=1).astype(np.float64)


@dataclass
class Ranking:
    """A fitted ranking; ``score`` is ``cut`` exactly at the threshold."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    middle: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.ones(0))
    threshold: float = 0.0
    cut: float = CUT

    def strength(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.middle) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(x), self.cut)
        z = self.strength(x) - self.threshold + np.log(self.cut / (1 - self.cut))
        return np.where(z >= 0, 1 / (1 + np.exp(-np.abs(z))), np.exp(-np.abs(z)) / (1 + np.exp(-np.abs(z))))


def bradley_terry(x: np.ndarray, label: np.ndarray, rounds: int = ROUNDS, cut: float = CUT, ridge: float = 1.0, steps: int = 30, pairs: int = PAIRS) -> Ranking:
    """Newton steps on the logistic loss of ``x[better] - x[worse]`` over fixed pairings."""
    good, bad = x[label == 1], x[label == 0]
    if not len(good) or not len(bad):
        return Ranking(cut=cut)
    middle, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1
    good, bad = (np.clip((v - middle) / scale, -8, 8) for v in (good, bad))
    n = max(len(good), len(bad))
    k = np.arange(max(n, min(n * rounds, pairs)))
    # pairings walk both lists with different strides, so rounds differ
    d = good[(k * 7919 + k // n) % len(good)] - bad[(k + k // n) % len(bad)]
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(d @ w, -40, 40)))
        gradient = d.T @ p - ridge * w
        hessian = (d * (p * (1 - p))[:, None]).T @ d + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    ranking = Ranking(w, middle, scale, 0.0, cut)
    ranking.threshold = float(np.quantile(ranking.strength(x), len(bad) / len(x)))
    return ranking


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; 0 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4, F.lit(0))


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST, rounds: int = ROUNDS, cut: float = CUT, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", held: int = 2) -> Ranking:
    """Learn from the labelled documents whose fold is not ``held``."""
    known = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)").filter(fold(F.col("doc_id")) != held)
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("top")).filter("label = top").select("doc_id", "label")
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    # the sample has at most ``most`` rows of two numbers, whatever the corpus
    rows = rows.join(F.broadcast(sample), "doc_id")

    def measure(batches):
        for b in batches:
            x = features(column_counts(b.column("text")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "label", "x"])

    measured = rows.select("doc_id", "label", "text").mapInArrow(measure, "doc_id long, label int, x array<double>")
    got = measured.groupBy("doc_id", "label").agg(F.min("x").alias("x")).orderBy("doc_id").collect()  # a label per id: ``most`` rows at most
    if not got:
        return Ranking(cut=cut)
    return bradley_terry(np.array([r["x"] for r in got]), np.array([r["label"] for r in got]), rounds, cut)


def score(docs: DataFrame, ranking: Ranking, text_col: str = "text", keep: Iterable[str] = ("doc_id",)) -> DataFrame:
    """``keep`` columns of ``docs`` with ``score``."""
    keep = list(keep)
    names = [f"c{k}" for k in range(len(keep))]

    def rate(batches):
        for b in batches:
            s = ranking.score(features(column_counts(b.column("text"))))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(s)], [*names, "score"])
            tidy()

    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)], F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    schema = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)
    out = rows.mapInArrow(rate, f"{schema}, score double")
    return out.select(*[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)], "score")


def op1_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ranking = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, ranking).select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
