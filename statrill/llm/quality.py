"""A quality classifier learned from positive and unlabelled texts.

Texts become a few dozen measures of their shape (case, symbols, repetition, word and line lengths) and the set of their
words, hashed into BUCKETS. Each measure is cut at quantiles, and a linear model over the resulting indicators and the
words' buckets minimises the non-negative unbiased risk: positives weigh with the class prior, unlabelled texts stand for the
mixture, and the negative part of the risk is not let below zero. Words' weights shrink the more, the fewer texts there are.
The prior is estimated from positives and unlabelled texts alone, as in "best bin estimation": a first model ranks texts it
was not fitted on, and the prior is the least ratio of the unlabelled and the positive texts above a score, each share with a
bound on its error, so that few texts give a high prior and reject little. Of four such estimates, by two ways of halving the
texts, the median counts.

The fit uses at most FIT_ROWS trusted positives and as many unlabelled texts, those of the least hashes of their ids;
scores are given to every text. Where every text is labelled, the trusted texts of either label stand for the mixture.
Labels, language, source and ids are no inputs of a score. Null texts count as empty and are scored like any; very long
texts are measured whole. Rows of a null doc_id are never held out. Repeated rows give repeated results; labels that are
null do not count, and those repeated with both values count each. With no positive label or no text to fit, every score is
PRIOR; with one text or two of either kind, PRIOR is the prior. Of a doc_id repeated with several texts one is fitted. An empty table gives an empty one. A column named like the score is replaced by it.
"""

from __future__ import annotations

import re
import string
from collections import Counter
from collections.abc import Iterator
from copy import copy

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free, table, texts
from .ngram_join import word_hashes

FIT_ROWS, FOLDS, THRESHOLD, PRIOR = 6000, 5, 0.3, 0.8
CUTS, STEPS, RATE, DECAY = 12, 250, 0.1, 1e-4
#: Measures of a text.
SHAPES = 18
#: Buckets of hashed words, and the decay of their weights, in texts: divided by the texts of the rarer kind.
BUCKETS, WORD_DECAY = 1024, 10.0
_PUNCTUATION = str.maketrans("", "", string.punctuation)
_SYMBOLS = re.compile(r"[#$%&*+<=>@\\^_`{|}~]+")
_ENDS = re.compile(r"[!?]+")


def measures(text: str) -> list[float]:
    """Measures of a text's shape; all 0 for a text without words."""
    words, lines = text.split(), text.split("\n")
    if not words:
        return [0.0] * SHAPES
    n, w = len(text), len(words)
    letters = sum(map(len, re.findall(r"[^\W\d_]+", text)))
    often, lower = Counter(words), text.lower()
    upper = sum(a != b for a, b in zip(text, lower, strict=False)) if len(lower) == n else 0
    symbols, ends = _SYMBOLS.findall(text), _ENDS.findall(text)
    sizes = [len(x) for x in often]
    return [
        np.log1p(n), np.log1p(w), letters / n, upper / max(1, letters), sum(map(len, symbols)) / n, len(symbols) / w, sum(map(len, ends)) / n, len(ends) / w,
        len(often) / w, max(often.values()) / w, sum(map(str.__eq__, words, words[1:])) / w, len(set(zip(words, words[1:], strict=False))) / w,
        sum(sizes) / len(sizes), n / w, np.log1p(n / len(lines)), len(set(lines)) / len(lines), sum(map(str.isupper, often)) / len(often), sum(map(str.istitle, often)) / len(often),
    ]


def buckets(text: str) -> bytes:
    """The set of a text's hashed words, as a bitmap."""
    out = np.zeros(BUCKETS, bool)
    out[(word_hashes(text) % np.uint64(BUCKETS)).astype(np.int64)] = True
    return np.packbits(out).tobytes()


class Texts:
    """Measures of texts, and the bitmaps of their words."""

    def __init__(self, x: list[list[float]], words: list[bytes]):
        self.x = np.array(x, dtype=float).reshape(len(x), SHAPES)
        self.words = np.frombuffer(b"".join(words), np.uint8).reshape(len(x), BUCKETS // 8)

    def __len__(self) -> int:
        return len(self.x)

    def half(self, k: int) -> Texts:
        """Halves 0 and 1, and the same of another way of halving, 2 and 3."""
        some = np.arange(len(self)) >> k // 2 & 1 == k % 2
        out = copy(self)
        out.x, out.words = self.x[some], self.words[some]
        return out


class Model:
    """Cuts of each measure, and a weight for each indicator of lying above a cut and for each bucket of words."""

    def __init__(self, cuts: list[np.ndarray]):
        self.cuts, self.shapes = cuts, sum(map(len, cuts))
        self.weights, self.bias = np.zeros(self.shapes + BUCKETS, np.float32), 0.0

    def features(self, texts: Texts) -> np.ndarray:
        """Indicators, and the words' buckets at unit length."""
        out = np.empty((len(texts), len(self.weights)), np.float32)
        out[:, : self.shapes] = np.concatenate([texts.x[:, i : i + 1] > c for i, c in enumerate(self.cuts)], axis=1)
        words = np.unpackbits(texts.words, axis=1)
        out[:, self.shapes :] = words / np.sqrt(np.maximum(1, words.sum(1, keepdims=True, dtype=np.float32)))
        return out

    def logits(self, texts: Texts) -> np.ndarray:
        return (self.features(texts) @ self.weights + self.bias).astype(float)

    def score(self, texts: Texts) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logits(texts)))


def fit(positive: Texts, unlabelled: Texts, prior: float) -> Model:
    """Gradient steps (Adam) on the non-negative unbiased risk of the logistic loss."""
    both = np.concatenate([positive.x, unlabelled.x])
    model = Model([np.unique(np.quantile(both[:, i], np.arange(1, CUTS) / CUTS)) for i in range(both.shape[1])])
    p, u = model.features(positive), model.features(unlabelled)
    theta = np.concatenate([model.weights, [np.log(prior / (1 - prior))]]).astype(float)
    decay = np.concatenate([np.full(model.shapes, DECAY), np.full(BUCKETS, WORD_DECAY / min(len(p), len(u))), [0]])
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    for step in range(1, STEPS + 1):
        w = theta[:-1].astype(np.float32)
        zp, zu = (p @ w + theta[-1]).astype(float), (u @ w + theta[-1]).astype(float)
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        up, down = -prior * sigmoid(-zp) / len(p), (sigmoid(zu) / len(u), -prior * sigmoid(zp) / len(p))
        gp, gu = (up + down[1], down[0]) if negative >= 0 else (-down[1], -down[0])
        grad = np.concatenate([gp.astype(np.float32) @ p + gu.astype(np.float32) @ u, [gp.sum() + gu.sum()]]) + decay * theta
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        theta -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    model.weights, model.bias = theta[:-1].astype(np.float32), float(theta[-1])
    return model


def share_above(positive: np.ndarray, unlabelled: np.ndarray, sure: float = 0.1, gamma: float = 0.01) -> float:
    """The class prior: the least ratio of the shares of unlabelled and positive scores above a bar, where the bar is the one
    at which that ratio, with bounds on both errors at confidence 1 - sure, is least."""
    bars = np.unique(positive)
    above = lambda x: 1 - np.searchsorted(np.sort(x), bars, side="left") / len(x)
    p, u = above(positive), above(unlabelled)
    error = np.sqrt(np.log(4 / sure) / (2 * len(positive))) + np.sqrt(np.log(4 / sure) / (2 * len(unlabelled)))
    at = int(np.argmin(u / p + (1 + gamma) * error / p))
    return float(u[at] / p[at])


def estimated(positive: Texts, unlabelled: Texts, prior: float = PRIOR) -> Model:
    """A model with the prior that halves of the texts give, ranked by a first model of the other halves; with the prior
    given, if there are no halves."""
    if min(len(positive), len(unlabelled)) > 2:
        found = []
        for k in range(4):
            ranked = fit(positive.half(k), unlabelled.half(k), 0.5)
            found.append(share_above(ranked.logits(positive.half(k ^ 1)), ranked.logits(unlabelled.half(k ^ 1))))
        prior = float(np.median(found))
    return fit(positive, unlabelled, min(0.99, max(0.01, prior)))


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def _measured(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"x": [measures(t) for t in batch], "words": [buckets(t) for t in batch]})


def learn(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model | None:
    """A model from trusted positives (label 1, not held out) and texts without a label."""
    labels = labels.select("doc_id", F.col("quality").alias("label")).where("doc_id is not null and label is not null")
    trusted = labels.where(~held_out(F.col("doc_id"))).join(docs.select("doc_id"), "doc_id", "left_semi")
    ids = lambda df, kind: df.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).withColumn("kind", F.lit(kind))
    unlabelled = docs.select("doc_id").where("doc_id is not null").join(labels, "doc_id", "left_anti")
    if not unlabelled.head(1):
        unlabelled = trusted
    chosen = ids(trusted.where("label = 1"), 1).union(ids(unlabelled, 0))
    measured = F.pandas_udf(_measured, "x array<double>, words binary")
    met = texts(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "kind").agg(F.min("text").alias("text"))
    got = met.select("kind", F.xxhash64("doc_id").alias("order"), measured("text").alias("of")).select("kind", "order", "of.*").toPandas()  # 2 * rows short lists
    got = got.sort_values("order")  # halves do not depend on how rows were dealt
    parts = [Texts(some["x"].tolist(), some["words"].tolist()) for some in (got[got["kind"] == k] for k in (1, 0))]
    return estimated(*parts) if all(map(len, parts)) else None


def score_of(model: Model | None):
    """The score of texts by a model, as a column function: texts alone go to Python, in batches bounded by bytes."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            known = model is not None and len(batch)
            yield pd.Series(model.score(Texts([measures(t) for t in batch], [buckets(t) for t in batch])) if known else PRIOR, index=range(len(batch)), dtype=float)

    return score


def scored(docs: DataFrame, labels: DataFrame, name: str = "score") -> DataFrame:
    """The documents with their score from 0 to 1 in a column of the name given."""
    return docs.withColumn(name, score_of(learn(docs, labels))(F.coalesce("text", F.lit(""))))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score so much or more, as they are."""
    score = free(docs, "score")
    return scored(docs, labels, score).where(F.col(score) >= threshold).drop(score)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(table(spark, sf_dir, "documents"))
    out = scored(docs, table(spark, sf_dir, "labels"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
