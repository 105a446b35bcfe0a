"""Toxicity by weak supervision.

Voters are words (a lexicon) and word prefixes (patterns) that go with toxic
labels in a bounded training sample; there are many, and they overlap.  A
generative model with the true class hidden explains the votes: expectation
maximisation estimates each voter's rates of firing, the labels' own accuracy
and the correlations that remain between voters given the class, by which
dependent voters are discounted.  A logistic regression on the votes is trained
on the posterior labels and scores whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearth.llm.common import held_out, labelled_sample, table
from hearth.llm.linear import fit_logistic, sigmoid
from hearth.llm.registry import register
from hearth.session import cut_lineage

LETTERS = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6)
DEPENDENT = 0.3  # correlations given the class below this are taken for noise


def tokens(text: str | None) -> set[str]:
    """Distinct lower-case words, and their prefixes marked ``4:``, ``5:``, ``6:``."""
    words = set(LETTERS.findall(text.lower())) if text else set()
    return words.union(*({f"{k}:{w[:k]}" for w in words if len(w) > k} for k in PREFIXES))


def family(text: str | None) -> int:
    """Smallest hash of the text's word triples: copies, near copies too, share
    it as a rule, so that a group of copies teaches like one document."""
    import xxhash
    words = LETTERS.findall(text.lower()) if text else []
    return min((xxhash.xxh64_intdigest(" ".join(words[i:i + 3])) for i in range(max(1, len(words) - 2))), default=0) >> 1


class LabelModel:
    """Posterior of the class from votes ``v`` (rows x voters, 0/1) and noisy labels ``y``."""

    def __init__(self, v: np.ndarray, y: np.ndarray, rounds: int = 300):
        n = len(y)
        p = np.where(y == 1, 0.95, 0.05)
        for turn in range(rounds):
            one, zero = p.sum(), (1 - p).sum()
            self.prior = (one + 1) / (n + 2)
            # rates at which each voter fires in either class, and labels say "toxic"
            self.fires1, self.fires0 = (p @ v + 0.5) / (one + 1), ((1 - p) @ v + 0.5) / (zero + 1)
            self.said1 = np.clip((p @ y + 1) / (one + 2), 0.6, 0.995)
            self.said0 = np.clip(((1 - p) @ y + 1) / (zero + 2), 0.005, 0.4)
            # correlations left between voters given the class: one vote in many guises counts once
            if turn % 10 == 0:
                left = v - np.outer(p, self.fires1) - np.outer(1 - p, self.fires0)
                spread = np.sqrt((left ** 2).mean(axis=0) + 1e-9)
                corr = (left.T @ left) / n / np.outer(spread, spread)
                self.weight = 1.0 / np.maximum(np.where(corr > DEPENDENT, corr, 0).sum(axis=1), 1.0)
            odds = (np.log(self.prior / (1 - self.prior))
                    + v @ (self.weight * np.log(self.fires1 / self.fires0))
                    + (1 - v) @ (self.weight * np.log((1 - self.fires1) / (1 - self.fires0)))
                    + np.where(y == 1, np.log(self.said1 / self.said0), np.log((1 - self.said1) / (1 - self.said0))))
            new = sigmoid(odds)
            done = np.abs(new - p).max() < 1e-4
            p = new
            if done:
                break
        self.posterior = p


class Scorer:
    """Linear classifier over votes, trained on posterior labels."""

    def __init__(self, voters: list[str], v: np.ndarray, y: np.ndarray, l2: float = 0.03):
        self.voters = voters
        self.constant = float(y.mean()) if len(y) else 0.5
        self.fitted = bool(voters) and 0 < y.sum() < len(y)
        if self.fitted:
            self.model = LabelModel(v, y)
            w = fit_logistic(self.design(v), self.model.posterior, l2, free=1)
            self.weights = w
        self.words = {t: i for i, t in enumerate(voters) if ":" not in t}
        self.prefixes = {k: {t[2:]: i for i, t in enumerate(voters) if t.startswith(f"{k}:")} for k in PREFIXES}

    @staticmethod
    def design(v: np.ndarray) -> np.ndarray:
        """The votes, how many there are, whether there is any, and 1."""
        n = v.sum(axis=1, keepdims=True)
        return np.concatenate([v, np.log1p(n), n > 0, np.ones((len(v), 1))], axis=1)

    def votes(self, text: str | None) -> list[int]:
        """Voters that fire on the whole text."""
        words = set(LETTERS.findall(text.lower())) if text else set()
        out = [self.words[w] for w in words & self.words.keys()]
        for k, known in self.prefixes.items():
            if known:
                out += [known[x] for x in {w[:k] for w in words if len(w) > k} & known.keys()]
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not self.fitted:
            return np.full(len(texts), self.constant)
        v = np.zeros((len(texts), len(self.voters)), np.float32)
        for i, t in enumerate(texts):
            v[i, self.votes(t)] = 1
        return sigmoid(self.design(v) @ self.weights)


def mine_voters(told: DataFrame, voters: int, least: int, gain: float) -> list[str]:
    """The ``voters`` tokens that go with label 1 most clearly (log-likelihood
    ratio at least ``gain``, seen in at least ``least`` families of toxic
    documents and three times as often there), from ``told(text, y)``."""
    def run(batches):
        for b in batches:
            for text, y in zip(b.column("text"), b.column("y").to_pylist()):
                got = sorted(tokens(text.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array([y], pa.int32()), pa.array([got], pa.list_(pa.string()))], ["y", "tokens"])
    sizes = {r["y"]: r["n"] for r in told.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = float(sizes.get(1, 0)), float(sizes.get(0, 0))
    if not n1 or not n0:
        return []
    seen = (told.select("text", "y").mapInArrow(run, "y int, tokens array<string>").select("y", F.explode("tokens").alias("t"))
            .groupBy("t").agg(F.sum("y").cast("double").alias("a"), F.sum(1 - F.col("y")).cast("double").alias("b")))
    a, b = F.col("a"), F.col("b")
    base = F.lit(n1 / (n1 + n0))
    part = F.when(b > 0, b * F.log(b / ((a + b) * (1 - base)))).otherwise(0.0)
    strong = (seen.where((a >= least) & (a / n1 > 3 * b / n0))
              .withColumn("g", 2 * (a * F.log(a / ((a + b) * base)) + part)).where(F.col("g") >= gain))
    return [r["t"] for r in strong.orderBy(F.desc("g"), "t").limit(voters).collect()]


def learn_toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 3, remainder: int = 1, rows: int = 12_288,
                   voters: int = 300, least: int = 4, gain: float = 25.0, seed: int = 29) -> Scorer:
    """Learns from at most ``rows`` labelled documents (``labels(doc_id,
    toxic)``) whose crc32(doc_id) mod ``modulus`` is not ``remainder``, one of
    each family of copies; of rows that share a doc_id, the one with the
    smallest hash of its text stands for all.  The bound is the same at every input size; what
    reaches the driver is at most ``rows`` lists of votes of ``voters`` voters."""
    sample = labelled_sample(labels, "toxic", modulus, remainder, rows, seed)

    def kin(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array([family(t.as_py()) for t in b.column("text")], pa.int64())],
                                             ["doc_id", "y", "family"])
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    told = texts.join(F.broadcast(sample), "doc_id")  # at most ``rows`` pairs of numbers
    told = cut_lineage(told.groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text")))
    heads = (told.select("doc_id", "text", "y").mapInArrow(kin, "doc_id long, y int, family long")
             .groupBy("family", "y").agg(F.min("doc_id").alias("doc_id")))
    chosen = heads.select("doc_id", "y").toPandas().sort_values(["doc_id", "y"])  # at most ``rows`` pairs of numbers
    spark = docs.sparkSession
    heads = F.broadcast(spark.createDataFrame(list(chosen.itertuples(index=False, name=None)), "doc_id long, y int"))
    told = told.join(heads, ["doc_id", "y"])
    found = mine_voters(told, voters, least, gain)
    probe = Scorer(found, np.zeros((0, len(found))), np.zeros(0))

    def vote(batches):
        for b in batches:
            got = [probe.votes(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(got, pa.list_(pa.int32()))], ["doc_id", "y", "votes"])
    cast = told.select("doc_id", "text", "y").mapInArrow(vote, "doc_id long, y int, votes array<int>").select("doc_id", "y", "votes").toPandas()
    cast = cast.sort_values(["doc_id", "y"], kind="stable").reset_index(drop=True)
    v = np.zeros((len(cast), len(found)))
    for i, hit in enumerate(cast["votes"]):
        v[i, hit] = 1
    return Scorer(found, v, cast["y"].to_numpy(float))


def score_toxicity(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """(doc_id, score) for each row of ``docs(doc_id, text)``, whole texts.  Texts
    in which no voter fires, null and empty ones too, get the score of no vote.
    Without both labels to learn from the score is the share of toxic labels
    (0.5 without any).  Repeated rows repeat; no rows give none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = scorer.score([t.as_py() for t in b.column("text")])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(got, pa.float64())], ["doc_id", "score"])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")


@register("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole document; learned without the rows whose crc32(doc_id) mod 3 is 1."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scorer = learn_toxicity(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, scorer).select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score",
                                               (F.col("score") >= 0.7).cast("int").alias("predicted"))
