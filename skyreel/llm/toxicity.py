"""Toxicity by multiple-instance learning.

Labels name documents, not sentences. A sentence's score is a logistic function of the words in it (whole words and their
beginnings); a document's score is the noisy-or of its sentences, and the weights are fitted to the document labels
through that noisy-or. The fitted weights then locate the offending sentences.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Memo
from .common import checkpointed, prepared, tidied

SAMPLE_ROWS = 16_000
"""Labelled documents the model is fitted on at most, those with the smallest hashes of their ids."""
FEATURES = 1_024
"""Words and beginnings of words that carry a weight at most, those that tell the labels apart best."""
LEAST_DOCUMENTS = 4
BEGINNINGS = (3, 4, 5, 6)
ROUNDS, RATE, RIDGE = 400, 0.1, 1e-3
SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"\w+")


def features(word: str) -> list[str]:
    return [f"{word}$", *(word[:n] for n in BEGINNINGS if n <= len(word))]


@dataclass
class Model:
    bias: float
    weights: dict[str, float] = field(default_factory=dict)
    share: float | None = None
    """Without a feature: the score of every text with a word."""

    def of_word(self, word: str) -> float:
        return sum(self.weights.get(f, 0.0) for f in features(word))


def _sampled(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(y, text) of at most SAMPLE_ROWS labelled documents, a row a doc_id (of several texts the smallest)."""
    known = labels.where("doc_id is not null and y is not null").groupBy("doc_id").agg(F.max("y").alias("y"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    return documents.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.max("y").alias("y"), F.min("text").alias("text")).select("y", F.coalesce("text", F.lit("")).alias("text"))


def _chosen(sample: DataFrame) -> list[str]:
    """The features found oftener in toxic documents, by the log-likelihood ratio of their document counts."""

    def count(batches):
        met = (Counter(), Counter())
        for batch in batches:
            for y, text in zip(batch.column("y").to_pylist(), batch.column("text").to_pylist()):
                met[y].update({f for w in set(WORD.findall(text.lower())) for f in features(w)})
        for y in (0, 1):
            names = list(met[y])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(np.full(len(names), y, np.int32)), pa.array([met[y][f] for f in names], pa.int64())], ["f", "y", "n"])

    totals = {r.y: r.n for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    if not bad or not good:
        return []
    counted = sample.mapInArrow(tidied(count), "f string, y int, n long").groupBy("f").agg(
        F.coalesce(F.sum(F.when(F.col("y") == 1, F.col("n"))), F.lit(0)).alias("a"), F.coalesce(F.sum(F.when(F.col("y") == 0, F.col("n"))), F.lit(0)).alias("c")
    )
    share = (F.col("a") + F.col("c")) / F.lit(bad + good)
    part = lambda n, total: F.when(F.col(n) > 0, F.col(n) * F.log(F.col(n) / (F.lit(total) * share))).otherwise(0.0)
    ratio = part("a", bad) + part("c", good)
    told = counted.where((F.col("a") + F.col("c") >= LEAST_DOCUMENTS) & (F.col("a") * good > F.col("c") * bad)).select("f", ratio.alias("g"))
    return [r.f for r in told.where("g > 3").orderBy(F.desc("g"), "f").limit(FEATURES).collect()]


def train(documents: DataFrame, labels: DataFrame) -> Model:
    """Fit to ``labels`` (doc_id, y: 0 or 1). Without labels of both kinds, or without a feature that tells them
    apart, the score is the share of label 1 for any text with a word, however long, and no sentence offends."""
    prepared(documents.sparkSession)
    sample = checkpointed(_sampled(documents, labels).where("y in (0, 1)").select(F.col("y").cast("int").alias("y"), "text"))
    names = _chosen(sample)
    at = {f: k for k, f in enumerate(names)}

    def encode(batches):
        memo = Memo(lambda w: [at[f] for f in features(w) if f in at])
        for batch in batches:
            bare, told = [], []
            for text in batch.column("text").to_pylist():
                sentences = [set(WORD.findall(s)) for s in SENTENCE.findall(text.lower())]
                found = [[k for w in s for k in memo[w]] for s in sentences if s]
                told.append([f for f in found if f])
                bare.append(sum(not f for f in found))
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(bare, pa.int64()), pa.array(told, pa.list_(pa.list_(pa.int32())))], ["y", "bare", "told"])

    got = sample.mapInArrow(tidied(encode), "y int, bare long, told array<array<int>>").toArrow()
    y = got["y"].to_numpy().astype(float)
    if not len(y):
        return Model(-50.0)
    if not names:
        share = min(max(y.mean(), 1e-9), 1 - 1e-9)
        return Model(-50.0, share=float(share))
    bare = got["bare"].to_numpy().astype(float)
    told = got["told"].combine_chunks()
    told = told.combine_chunks() if isinstance(told, pa.ChunkedArray) else told
    document = np.repeat(np.arange(len(y)), told.value_lengths().to_numpy(zero_copy_only=False))
    sentences = told.flatten()
    sentence = np.repeat(np.arange(len(sentences)), sentences.value_lengths().to_numpy(zero_copy_only=False))
    feature = sentences.flatten().to_numpy(zero_copy_only=False)
    return _fitted(names, y, bare, document, sentence, feature)


def _fitted(names, y, bare, document, sentence, feature) -> Model:
    """Adam over the noisy-or log-likelihood, all rows each round."""
    theta = np.zeros(len(names) + 1)
    theta[-1] = -4.0
    slow, fast = np.zeros_like(theta), np.zeros_like(theta)
    count = len(document)
    for step in range(1, ROUNDS + 1):
        w, b = theta[:-1], theta[-1]
        z = b + np.bincount(sentence, w[feature], count)
        none = np.logaddexp(0, b)
        total = np.bincount(document, np.logaddexp(0, z), len(y)) + bare * none
        total = np.maximum(total, 1e-12)
        slope = np.where(y > 0, -np.exp(-total) / -np.expm1(-total), 1.0) / len(y)
        inner = slope[document] / (1 + np.exp(-z))
        grad = np.empty_like(theta)
        grad[:-1] = np.bincount(feature, inner[sentence], len(names)) + RIDGE * w / len(names)
        grad[-1] = inner.sum() + (slope * bare).sum() / (1 + np.exp(-b))
        slow = 0.9 * slow + 0.1 * grad
        fast = 0.999 * fast + 0.001 * grad**2
        theta -= RATE * (slow / (1 - 0.9**step)) / (np.sqrt(fast / (1 - 0.999**step)) + 1e-9)
    return Model(float(theta[-1]), {f: float(v) for f, v in zip(names, theta[:-1]) if abs(v) > 1e-6})


SCORED = "doc_id long, score double, offending array<struct<begin:int,end:int,score:double>>"


def scored(documents: DataFrame, model: Model, bar: float = 0.5) -> DataFrame:
    """doc_id, score, offending: the sentences (as places in the text, in characters) whose own score reaches ``bar``.

    Null and empty texts, and texts without a word, score 0. Every row is scored, also one with a null doc_id.
    """
    prepared(documents.sparkSession)

    def run(batches):
        memo = Memo(model.of_word)
        for batch in batches:
            scores, spots = [], []
            for text in batch.column("text").to_pylist():
                total, found = 0.0, []
                if model.share is not None:
                    scores.append(model.share if WORD.search(text or "") else 0.0)
                    spots.append(found)
                    continue
                for m in SENTENCE.finditer(text or ""):
                    words = set(WORD.findall(m[0].lower()))
                    if not words:
                        continue
                    z = model.bias + sum(map(memo.__getitem__, words))
                    total += np.logaddexp(0, z) if z > -30 else np.exp(z)
                    if z >= 0 and 1 / (1 + np.exp(-z)) >= bar:
                        found.append({"begin": m.start(), "end": m.end(), "score": float(1 / (1 + np.exp(-z)))})
                scores.append(float(-np.expm1(-total)))
                spots.append(found)
            kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(spots, kind)], ["doc_id", "score", "offending"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidied(run), SCORED)


def without_toxic(documents: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """``documents`` without the rows that score ``threshold`` or more; the other rows and all columns stay."""
    prepared(documents.sparkSession)

    def run(batches):
        memo = Memo(model.of_word)
        for batch in batches:
            keep = []
            for text in batch.column("text").to_pylist():
                if model.share is not None:
                    keep.append(model.share < threshold or not WORD.search(text or ""))
                    continue
                total = 0.0
                for s in SENTENCE.findall((text or "").lower()):
                    if words := set(WORD.findall(s)):
                        z = model.bias + sum(map(memo.__getitem__, words))
                        total += np.logaddexp(0, z) if z > -30 else np.exp(z)
                keep.append(bool(-np.expm1(-total) < threshold))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return documents.mapInArrow(tidied(run), documents.schema)
