"""Quality by Bradley-Terry pairwise ranking.

Pairs of a better and a worse labelled document give preferences; the weights
of a linear score minimise the logistic loss of the score difference.  The
threshold is the quantile of the training scores at the share of rejected
labels; a slope, fitted with that threshold fixed, turns scores into (0, 1).
"""

from __future__ import annotations

import operator
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearth.llm.common import held_out, labelled_sample, table
from hearth.llm.linear import fit_logistic, sigmoid
from hearth.llm.registry import register

STATS = ["log_words", "log_chars", "word_length", "upper", "punctuation", "digits", "distinct", "repeats", "top_word",
         "distinct_lines", "bare_signs", "marked_words", "longest", "capitals"]
MARGINS = (0.02, 0.1, 0.5, 0.9, 0.98)  # training quantiles at which each statistic may bend


def _classes() -> np.ndarray:
    """0 other, 1 space, 2 lower or caseless letter, 3 upper, 4 digit, 5 sign, by code point of the first plane."""
    kind = {"Z": 1, "N": 4, "P": 5, "S": 5}
    out = np.zeros(65536, np.uint8)
    for c in range(65536):
        k = unicodedata.category(chr(c))
        out[c] = 1 if chr(c).isspace() else (3 if k == "Lu" else 2) if k[0] == "L" else kind.get(k[0], 0)
    return out


def statistics(text: str | None, classes: np.ndarray) -> list[float]:
    """The statistics of one whole text; all 0 for null, empty and white space."""
    words = text.split() if text else []
    if not words:
        return [0.0] * len(STATS)
    n, size = len(words), len(text)
    kinds = np.bincount(classes[np.minimum(np.frombuffer(text.encode("utf-32-le", "replace"), "<u4"), 65535)], minlength=6)
    count = Counter(words)
    solid = max(1, size - int(kinds[1]))
    lines = [x for x in text.split("\n") if x]
    signs = sum(k for w, k in count.items() if not any(map(str.isalnum, w)))
    marked = sum(k for w, k in count.items() if len(w) > 2 and not w[-1].isalnum() and not w[-2].isalnum())
    capital = sum(k for w, k in count.items() if len(w) > 1 and w.isupper())
    return [np.log1p(n), np.log1p(size), solid / n, kinds[3] / solid, kinds[5] / solid, kinds[4] / solid, len(count) / n,
            sum(map(operator.eq, words, words[1:])) / n, max(count.values()) / n, len(set(lines)) / max(1, len(lines)), signs / n,
            marked / n, float(np.log1p(max(map(len, count)))), capital / n]


class Ranker:
    """The fitted score."""

    def __init__(self, x: np.ndarray, y: np.ndarray, pairs_per_row: int = 4, l2: float = 1.0, seed: int = 5):
        good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        self.fitted = len(good) > 0 and len(bad) > 0
        if not self.fitted:
            return
        self.knots = np.quantile(x, MARGINS, axis=0)
        self.scale = np.maximum(x.std(axis=0), 1e-6)
        f = self.features(x)
        # every labelled row is compared with some of the other side
        rng = np.random.default_rng(seed)
        better = np.concatenate([np.repeat(good, pairs_per_row), rng.choice(good, len(bad) * pairs_per_row)])
        worse = np.concatenate([rng.choice(bad, len(good) * pairs_per_row), np.repeat(bad, pairs_per_row)])
        difference = f[better] - f[worse]
        flip = np.where(np.arange(len(difference)) % 2 == 0, 1.0, -1.0)
        self.weights = fit_logistic(difference * flip[:, None], (flip + 1) / 2, l2)
        s = np.sort(f @ self.weights)
        at = min(max(len(bad), 1), len(s) - 1)
        self.threshold = (s[at - 1] + s[at]) / 2  # the quantile at the share of rejected rows
        slope = fit_logistic((f @ self.weights - self.threshold)[:, None], y.astype(float), 1e-3)[0]
        self.slope = float(np.clip(slope, 0.25, 4.0))

    def features(self, x: np.ndarray) -> np.ndarray:
        bends = [np.clip((x - k) / self.scale, 0, 6) for k in self.knots]
        return np.concatenate([np.clip((x - self.knots[2]) / self.scale, -6, 6), *bends], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """0.5 for all rows if there was nothing to learn from."""
        return sigmoid(self.slope * (self.features(x) @ self.weights - self.threshold)) if self.fitted else np.full(len(x), 0.5)


def _with_statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """(doc_id, <keep>, x array<double>) of ``docs(doc_id, text, <keep>)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = _classes()
        for b in batches:
            x = pa.array([statistics(t.as_py(), classes) for t in b.column("text")], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", *keep)), x], ["doc_id", *keep, "x"])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *keep)
    return rows.mapInArrow(run, ", ".join(["doc_id long", *(f"{c} int" for c in keep), "x array<double>"]))


def learn_quality(docs: DataFrame, labels: DataFrame, modulus: int = 3, remainder: int = 1, rows: int = 16_384,
                  seed: int = 17) -> Ranker:
    """Fits the ranker on at most ``rows`` labelled documents (``labels(doc_id,
    quality)``, 1 better, 0 worse) whose crc32(doc_id) mod ``modulus`` is not
    ``remainder``.  The bound is the same at every input size, so what reaches
    the driver is ``rows`` short vectors: of rows that share a doc_id, the one
    with the smallest hash of its text stands for all."""
    sample = labelled_sample(labels, "quality", modulus, remainder, rows, seed)
    told = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most ``rows`` pairs of numbers
    told = told.withColumn("h", F.hash(F.col("text").cast("string")))
    got = (_with_statistics(told, "y", "h").groupBy("doc_id", "y").agg(F.min(F.struct("h", "x")).alias("first"))
           .select("first.x", "y").toPandas())
    x = np.array(got["x"].tolist(), dtype=float).reshape(len(got), len(STATS))
    order = np.lexsort([*x.T, got["y"]])  # the fit does not depend on the order of arrival
    return Ranker(x[order], got["y"].to_numpy(int)[order])


def score_quality(docs: DataFrame, ranker: Ranker) -> DataFrame:
    """(doc_id, score) for each row of ``docs(doc_id, text)``: whole texts; null,
    empty and white-space texts are scored by their zero statistics.  Repeated
    rows repeat; no rows give none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = _classes()
        for b in batches:
            x = np.array([statistics(t.as_py(), classes) for t in b.column("text")], dtype=float).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ranker.score(x), pa.float64())], ["doc_id", "score"])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")


def keep_quality(docs: DataFrame, ranker: Ranker) -> DataFrame:
    """The rows of ``docs`` (all columns) that score 0.5 or more."""
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        classes = _classes()
        for texts in batches:
            x = np.array([statistics(t, classes) for t in texts], dtype=float).reshape(-1, len(STATS))
            yield pd.Series(ranker.score(x))
    return docs.where(score(F.col("text").cast("string")) >= 0.5)


@register("op9_quality")
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole document; learned without the rows whose crc32(doc_id) mod 3 is 1."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ranker = learn_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, ranker).select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score",
                                              (F.col("score") >= 0.5).cast("int").alias("predicted"))
